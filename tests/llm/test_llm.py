"""Each operator against a brute-force version, and on nulls, empties, ties, repeats and odd tables."""

import base64
import collections
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import buffers, exact_dedup, flac, language_id, near_dedup, packing, pieces, queries, sharding, shingles, substring_dedup, token_counts, vocabulary, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empties, blanks, repeats, ties, other alphabets, a long text without blanks.
ODD = [None, "", " ", "\n\n", "a", "a b c d", "A B C D", "one two three four five", "one two three four five", "日本語 テスト\nです", "é́ ß İ", "x" * 3000, "12 34 !!", "the cat " * 200]


def frame(spark, texts, extra=False):
    rows = [(i, t, "en" if i % 2 else "de", None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"id": F.lit("x"), "score": F.lit(1), "shard": F.lit("s"), "kept": F.lit("k"), "bucket": F.lit(0)}) if extra else df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_buffers_handle_slices_and_nulls():
    a = pa.array(["ab", None, "", "cde"])[1:]
    data, offsets = buffers.raw(a)
    assert data.tobytes() == b"cde" and offsets.tolist() == [0, 0, 0, 3]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 10] * 5)})
    assert [s.num_rows for s in buffers.slices(batch, "text", 25)] == [2, 2, 1]
    assert [s.num_rows for s in buffers.slices(batch, "text", 3)] == [1] * 5


# 1


def test_language_id_learns_only_from_rows_not_held_out(spark, docs):
    model = language_id.learn(docs)
    rows = language_id.identify(docs, model).withColumn("held", language_id.held_out()).collect()
    held = [r for r in rows if r.held]
    assert len(rows) == docs.count() and held and all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.9
    flipped = docs.withColumn("lang", F.when(language_id.held_out(), "xx").otherwise(F.col("lang")))
    assert "xx" not in language_id.learn(flipped).langs


def test_language_id_odd_texts(spark, docs):
    got = language_id.identify(frame(spark, ODD, extra=True), language_id.learn(docs)).orderBy("doc_id").collect()
    for r, t in zip(got, ODD, strict=True):
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= r.score <= 1
    assert language_id.identify(frame(spark, []), language_id.learn(docs)).count() == 0
    nothing = language_id.learn(frame(spark, []))
    assert nothing.langs == [] and {r.lang_pred for r in language_id.identify(frame(spark, ["abc"]), nothing).collect()} == {"und"}


@pytest.mark.parametrize("k", [1, 2, 4, 7, 12])
def test_codewords_are_distinct(k):
    code = language_id.codewords(k)
    assert code.shape[0] == k and len({c.tobytes() for c in code}) == k


# 2


def test_flac_round_trip_of_odd_payloads():
    r = random.Random(1)
    payloads = [bytes(r.randrange(256) for _ in range(n)) for n in (1, 2, 9, 575, 576, 577, 2000)] + [b"a" * 576, bytes(range(256)) * 9, bytes([0, 255] * 600), bytes(576) + b"\xff" * 576]
    for block in (576, 100, 4096):
        assert flac.decode(flac.encode(payloads, block))[0] == payloads


def test_flac_reads_few_seek_points_and_checks_sums():
    payload = b"some text to be heard " * 200
    stream = flac.encode([payload])[0]
    bare = stream[:4] + bytes([0x80]) + stream[5:8] + stream[8:42] + stream[46 + int.from_bytes(stream[43:46], "big") :]  # STREAMINFO alone
    assert flac.decode([bare])[0] == [payload]
    for at in (len(stream) - 1, len(stream) - 300, 30):
        broken = bytearray(stream)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])


def test_flac_rice_partitions_and_escapes():
    """A subframe written bit by bit: fixed order 1, two partitions, the second one escaped to 5 raw bits."""
    x = [3, 4, 6, 5, 9, 12, 10, 8]
    res = [b - a for a, b in zip(x[:-1], x[1:], strict=True)]
    bits = f"{0b0001001 << 1:08b}" + f"{x[0] & 255:08b}" + "00" + "0001" + f"{1:04b}"
    for v in res[:3]:
        u = v * 2 if v >= 0 else -2 * v - 1
        bits += "0" * (u >> 1) + "1" + f"{u & 1:b}"
    bits += "1111" + f"{5:05b}" + "".join(f"{v & 31:05b}" for v in res[3:])
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    head = bytes([0xFF, 0xF8, 6 << 4 | 4, 2, 0, 7])
    frame_ = head + bytes(flac.crc8(np.frombuffer(head, np.uint8)[None, :])) + body
    padded = frame_ if len(frame_) % 2 == 0 else b"\0" + frame_
    frame_ += int(flac.crc16(np.frombuffer(padded, np.uint8)[None, :])[0]).to_bytes(2, "big")
    payload = bytes((v + 128) & 255 for v in x)
    assert flac.decode([flac.container(payload, [frame_], 8)])[0] == [payload]


def plain_crc(data, poly, width):
    """Bit by bit, from the definition."""
    crc = 0
    for byte in data:
        for bit in range(7, -1, -1):
            top = crc >> (width - 1) & 1
            crc = (crc << 1 & (1 << width) - 1) ^ (poly if top ^ (byte >> bit & 1) else 0)
    return crc


def test_flac_reads_a_fixed_stream():
    """A stream written by hand from the format's definition: LPC of order 2, Rice parameter 2; its sums are worked out apart."""
    x = [10, 12, 13, 17, 16, 20, 25, 21]
    bits = f"{0b0_100001_0:08b}" + "".join(f"{v & 255:08b}" for v in x[:2]) + f"{5 - 1:04b}" + f"{2:05b}" + f"{7:05b}" + f"{-3 & 31:05b}" + "00" + "0000" + f"{2:04b}"
    for i in range(2, len(x)):
        v = x[i] - ((7 * x[i - 1] - 3 * x[i - 2]) >> 2)
        u = 2 * v if v >= 0 else -2 * v - 1
        bits += "0" * (u >> 2) + "1" + f"{u & 3:02b}"
    bits = bits.ljust(-(-len(bits) // 8) * 8, "0")
    head = bytes([0xFF, 0xF8, 6 << 4 | 4, 2, 0, 7])
    assert (plain_crc(b"123456789", 0x07, 8), plain_crc(b"123456789", 0x8005, 16)) == (0xF4, 0xFEE8)  # the sums' published check values
    frame_ = head + bytes([plain_crc(head, 0x07, 8)]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    frame_ += plain_crc(frame_, 0x8005, 16).to_bytes(2, "big")
    info = (8).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 0 << 41 | 7 << 36 | 8).to_bytes(8, "big") + hashlib.md5(bytes(v & 255 for v in x)).digest()
    stream = b"fLaC" + bytes([0x80, 0, 0, 34]) + info + frame_
    assert flac.decode([stream]) == ([bytes(v + 128 for v in x)], [[33]])


def test_flac_query_contract(spark, texts):
    rows = queries.op2_flac_round_trip(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id].encode()
        p = t + b"\xff" * (-len(t) % 576 if t else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    odd = flac.from_flac(flac.to_flac(frame(spark, ODD, extra=True))).collect()
    assert {r.doc_id: bytes(r.payload) for r in odd} == {i: flac.payload_of((t or "").encode()) for i, t in enumerate(ODD)}
    twice = spark.createDataFrame([(1, "a" * 700), (1, "a" * 700), (None, "b" * 2000), (None, None)], "doc_id long, text string")
    assert sorted(bytes(r.payload)[:3] for r in flac.from_flac(flac.to_flac(twice)).collect()) == [b"aaa", b"aaa", b"bbb", b"\xff" * 3]
    long = "long text, no end " * 130_000  # beyond a slice and a batch
    assert bytes(flac.from_flac(flac.to_flac(frame(spark, ["a", long, "b"]))).filter("doc_id = 1").first().payload).startswith(long.encode())
    blocks = flac.pcm_blocks(flac.to_flac(frame(spark, ["z" * 1500]))).orderBy("block").collect()
    assert [b.sample_offset for b in blocks] == [0, 576, 1152] and b"".join(bytes(b.pcm) for b in blocks)[:1500] == b"z" * 1500
    assert flac.from_flac(flac.to_flac(frame(spark, []))).count() == 0


# 3


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(sets):
    part = {i: i for i in sets}
    ids = sorted(i for i in sets if sets[i])

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                part[b] = a
    return {i: find(i) for i in sets}


def near(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(df).collect()}


def test_shingle_sets_against_brute_force(texts):
    own = [t for t in texts.values()] + [t or "" for t in ODD]
    data, offsets = buffers.raw(pa.array(own))
    held, sizes = shingles.shingle_sets(data, offsets)
    assert sizes.tolist() == [len(shingle_set(t)) for t in own]


def test_sketch_fills_every_bin_and_agrees_for_equal_sets():
    r = np.random.default_rng(1)
    sizes = np.array([0, 1, 2, 5, 100, 3000])
    held = np.concatenate([np.sort(r.integers(0, 2**51, n)) for n in sizes])
    sketch = shingles.sketches(held, sizes)
    assert not sketch[0].any() and (sketch[1:] != 2**64 - 1).all() and ((sketch[1:] >> np.uint64(32)) < 256).all()
    alone = shingles.sketches(held[1:3], np.array([2]))
    assert (alone[0] == sketch[2]).all()


def test_near_dedup_on_families(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = list(ODD)
    for _ in range(6):
        base = [r.choice(words) for _ in range(r.choice([8, 40, 120]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(r.randrange(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append(" ".join(copy))
    want = {i: shingle_set(t) for i, t in enumerate(rows)}
    part = components(want)
    got = near(frame(spark, rows, extra=True))
    assert got == {i: (len(want[i]), part[i], part[i] == i) for i in want}
    assert near(frame(spark, [])) == {}


def test_near_dedup_of_a_large_family_with_far_copies(spark):
    """Copies with up to 14 changes from few words: many miss the centre, and some of those meet each other only."""
    r = random.Random(12)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for _ in range(150):
        copy = list(base)
        for _ in range(r.randrange(0, 8)):
            at = r.randrange(80)
            copy[at] = r.choice("xyz")
            copy[at + 1] = r.choice(["p", copy[at + 1]])
        rows.append(" ".join(copy[: 90 - r.randrange(0, 6)]))
    want = {i: shingle_set(t) for i, t in enumerate(rows)}
    part = components(want)
    assert len(set(part.values())) > 10
    assert {i: g[1] for i, g in near(frame(spark, rows)).items()} == part


def test_near_dedup_where_only_a_third_text_links(spark):
    """a - b - c: neighbours are similar, a and c are not; and a hub whose far members pair up among themselves."""
    w = [f"t{i}" for i in range(100)]
    a, b, c = w[:80], w[5:85], w[10:90]
    far = w[:60] + [f"u{i}" for i in range(40)]
    rows = [" ".join(x) for x in (b, a, c, far, far[:98] + ["v1", "v2"], w)]
    want = {i: shingle_set(t) for i, t in enumerate(rows)}
    assert {i: g[1] for i, g in near(frame(spark, rows)).items()} == components(want)


# 4


def brute_cut(texts, least):
    count = collections.Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        covered = [False] * len(t)
        for i in range(len(t) - least + 1):
            if count[t[i : i + least]] > 1:
                covered[i : i + least] = [True] * least
        runs = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        out.append((len(t), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(t, covered, strict=True) if not c)).hexdigest()))
    return out


def test_interval_expansion_against_brute_force():
    r = random.Random(3)
    for _ in range(150):
        letters = bytes(range(65, 65 + r.choice([1, 2, 3, 20])))
        base = bytes(r.choice(letters) for _ in range(60))
        own = [bytes(r.choice(letters) for _ in range(r.randrange(9))) + base[(a := r.randrange(40)) : a + r.randrange(25)] for _ in range(r.randrange(1, 8))]
        least = r.choice([1, 2, 5, 12])
        count = collections.Counter(p[i : i + least] for p in own for i in range(len(p) - least + 1))
        want = [i + least <= len(p) and count[p[i : i + least]] > 1 for p in own for i in range(len(p) + 1)]
        assert substring_dedup.repeated_starts(own, least).tolist() == want


@pytest.mark.parametrize("hot", [4000, 2])
def test_substring_dedup_against_brute_force(spark, hot):
    r = random.Random(4)
    passage = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = [*ODD, "y" * 700, passage * 3]
    for _ in range(25):
        a = r.randrange(200)
        rows.append("".join(r.choice("abcdé \n") for _ in range(r.randrange(150))) + passage[a : a + r.randrange(140)] + "".join(r.choice("xyz") for _ in range(r.randrange(50))))
    rows += rows[-3:]
    for least in (50, 90):
        got = substring_dedup.substring_dedup(frame(spark, rows, extra=True), least=least, hot_segments=hot).collect()
        assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(got, key=lambda r: r.doc_id)] == brute_cut([(t or "").encode() for t in rows], least)


def test_substring_dedup_with_repeated_and_null_ids(spark):
    text = "".join(random.Random(5).choice("abcdef") for _ in range(200))
    rows = [(1, text), (1, text), (None, text[:150]), (1, "other " * 3), (2, None)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), least=100).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == [(0, 150, 150), (1, 18, 0), (1, 200, 200), (1, 200, 200), (2, 0, 0)]
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def test_substring_tiles_of_one_long_text(spark, monkeypatch):
    r = random.Random(6)
    part = "".join(r.choice("abcdefghij") for _ in range(1500))
    rows = [part + "".join(r.choice("klm") for _ in range(3000)) + part, part[200:900]]
    monkeypatch.setattr(substring_dedup, "TILE", 1024)
    found = [x for run in [substring_dedup.find_segments(60)] for x in run(iter([pa.RecordBatch.from_pydict({"row": [0, 1], "text": pa.array([t.encode() for t in rows])})]))]
    covered = collections.Counter()
    for b in found:
        for row, start, strings in zip(*(b.column(c).to_pylist() for c in ("row", "start", "strings")), strict=True):
            covered.update((row, start + k) for k in range(strings))
    assert covered == collections.Counter((i, k) for i, t in enumerate(rows) for k in range(len(t) - 59))


# 5


def test_special_strings_keep_their_case():
    path = queries.tokenizer_path("word_bpe_49k.json")
    own = ["x <|ENDOFTEXT|> y", "X <|endoftext|> Y", "A<|EndOfText|>B <|STARTOFTEXT|>", "Plain Text", "", None, "<|x|> THE Cat"]
    encoder = vocabulary.ChunkEncoder(path)
    for texts in (own, own[3:], own):
        ids, sizes, _, _ = encoder.encode(pa.array(texts, pa.string()))
        got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert 49407 not in got[0] and 49407 in got[1]


def brute_cost(places, penalties, width):
    best = [0] + [10**9] * (len(places) - 1)
    for j in range(1, len(places)):
        best[j] = min(best[i] + width - (places[j] - places[i]) + penalties[j] for i in range(j) if places[j] - places[i] <= width)
    return best[-1]


def test_best_cuts_are_optimal():
    r = random.Random(7)
    for _ in range(200):
        width = r.choice([8, 20])
        places = np.cumsum([0] + [r.randrange(1, width + 1) for _ in range(r.randrange(1, 25))])
        penalties = np.array([r.choice([0, 0, 3, 9]) for _ in places])
        chosen = packing.best_cuts(places, penalties, width)
        cost = sum(width - (places[b] - places[a]) + penalties[b] for a, b in zip(chosen[:-1], chosen[1:], strict=True))
        assert cost == brute_cost(places.tolist(), penalties.tolist(), width)


def check_packing(rows, texts, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        ids = [*tok.encode(texts[d] or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_packing_contract(spark, texts):
    path = queries.tokenizer_path("word_bpe_49k.json")
    rows = queries.op5_order_preserving_packing(spark, SF).collect()
    check_packing(rows, texts, path)
    assert len({r.sequence_id for r in rows}) * 4096 < sum(r.length for r in rows) * 1.02 + 4096
    small = packing.pack(frame(spark, ODD, extra=True), path, block=64).collect()
    check_packing(small, dict(enumerate(ODD)), path)
    assert packing.pack(frame(spark, []), path).count() == 0


def test_chunks_give_the_tokenizers_own_ids():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tok, r = Tokenizer.from_file(path), random.Random(8)
    own = [t or "" for t in ODD] + ["<|endoftext|> x<|startoftext|>", "ÀÉ É ΣΑΣ"] + ["".join(r.choice("aB'é \n\t\x0b\x1c日s.1́ΣİK") for _ in range(40)) for _ in range(400)]
    ids, sizes, _, _ = vocabulary.ChunkEncoder(path).encode(pa.array(own))
    edge = np.concatenate([[0], np.cumsum(sizes)])
    assert all(ids[edge[i] : edge[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids for i, t in enumerate(own))


# 6


def test_pieces_are_the_librarys(spark, texts):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    lib, r = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(9)
    own = [*texts.values(), *[t or "" for t in ODD], "▁x", "  a", "a  b ", *["".join(r.choice("ab c\n▁é日the ") for _ in range(r.randrange(30))) for _ in range(500)]]
    assert pieces.Encoder(path).encode(pa.array(own)).to_pylist() == lib.encode(own)
    back = pieces.decode(pieces.encode(frame(spark, ODD, extra=True), path), path).collect()
    assert {r.doc_id: bytes(r.text).decode() for r in back} == {i: t or "" for i, t in enumerate(ODD)}
    assert pieces.encode(frame(spark, []), path).count() == 0


def test_unigram_viterbi_is_optimal():
    model = pieces.Model.__new__(pieces.Model)
    words = ["a", "b", "c", "ab", "bc", "abc", "ca"]
    r = random.Random(10)
    model.pieces, model.scores = words, [-r.random() * 5 for _ in words]
    model.place, model.tails = {w: i for i, w in enumerate(words)}, {w[i:] for w in words for i in range(len(w))}
    model.type, model.least, model.met, model.byte, model.unknown = pieces.UNIGRAM, -20.0, {}, {}, 99

    def best(word):
        return max((model.scores[i] + best(word[len(w) :]) for i, w in enumerate(words) if word.startswith(w)), default=0.0) if word else 0.0

    own = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(80)})
    for word, ids in zip(own, model.segment(own), strict=True):
        assert "".join(words[i] for i in ids) == word and abs(sum(model.scores[i] for i in ids) - best(word)) < 1e-9


# 7


def test_lines_of_the_communication_matrix():
    counts = np.array([5, 0, 17, 3])
    ends = np.concatenate([[0], np.cumsum(counts)])
    m = np.array([sharding.share_of(ends, p, 4, 1) for p in range(4)])
    assert m.sum(axis=1).tolist() == [5, 0, 17, 3] and m.sum(axis=0).tolist() == [7, 6, 6, 6] and (m >= 0).all()
    many = np.array([sharding.share_of(np.array([0, 30, 40, 100]), 1, 4, seed) for seed in range(4000)])
    assert np.allclose(many.mean(axis=0), 2.5, atol=0.08) and np.allclose(many.var(axis=0), 10 * 0.25 * 0.75 * 90 / 99, atol=0.12)


def test_hypergeometric_draws_of_large_populations(monkeypatch):
    draw = np.random.default_rng(3)
    good, bad, sample = 3 * 10**9, 21 * 10**9, 10**9
    x = np.array([sharding.hypergeometric(draw, good, bad, sample) for _ in range(300)], float)
    mean, var = sample / 8, sample / 8 * 7 / 8 * (23 / 24)
    assert abs(x.mean() - mean) < 5 * np.sqrt(var / 300) and 0.7 < x.var() / var < 1.35
    monkeypatch.setattr(sharding, "_MOST", 0)
    got = np.bincount([sharding.hypergeometric(draw, 5, 7, 4) for _ in range(20_000)], minlength=5) / 20_000
    want = np.array([35, 175, 210, 70, 5]) / 495
    assert np.allclose(got, want, atol=0.015)
    assert [sharding.hypergeometric(draw, *x) for x in ((0, 9, 4), (9, 0, 4), (3, 3, 6), (2, 2, 0))] == [0, 4, 3, 0]


def test_sharding_contract(spark, texts):
    rows = queries.op7_hypergeometric_shards(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "rows", None)
    count = collections.Counter(r.shard for r in rows)
    assert set(count) <= set(range(24)) and max(count.values()) - min(count[s] for s in range(24)) <= 1
    for s in count:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))


def test_sharding_in_blocks_and_odd_tables(spark):
    from shelfmark.llm.store import materialise

    rows = materialise(spark.range(0, 1000, 1, 7).select("id", F.lit(None).cast("string").alias("shard_name")), "t")
    got = sharding.shard_rows(rows, shards=3, block_rows=20).collect()
    assert sorted(r.id for r in got) == list(range(1000))
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(334 if s == 0 else 333))
    assert sharding.shard_rows(materialise(spark.range(0), "t"), shards=3).count() == 0
    few = materialise(spark.createDataFrame([(None,), (None,)], "id long"), "t")
    assert sharding.shard_rows(few, shards=5).count() == 2


# 8


def test_token_counts_against_brute_force(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    tok, r = Tokenizer.from_file(path), random.Random(11)
    tok.encode_special_tokens = True
    own = [t or "" for t in ODD] + ["a\n\n\nb \n c\n", "<|endoftext|> x"] + ["".join(r.choice("ab c\n\né日 ") for _ in range(r.randrange(30))) for _ in range(400)]

    def brute(s):
        lines = re.findall("[^\n]*\n|[^\n]+", s) or [""]
        edge = np.concatenate([[0], np.cumsum([len(x.encode()) for x in lines])]).tolist()
        n, cross, at = [0] * len(lines), [0] * len(lines), 0
        for i in tok.encode(s).ids:
            end = at + len(tok.id_to_token(i))
            parts = [max(0, min(end, edge[j + 1]) - max(at, edge[j])) for j in range(len(lines))]
            n[parts.index(max(parts))] += 1
            on = [j for j, p in enumerate(parts) if p]
            for j in on if len(on) > 1 else []:
                cross[j] += 1
            at = end
        return [(j, sum(map(len, lines[:j])), len(lines[j]), n[j], cross[j]) for j in range(len(lines))]

    got = collections.defaultdict(list)
    for row in token_counts.count_tokens(frame(spark, own, extra=True), path).collect():
        got[row.doc_id].append((row.section, row.start, row.chars, row.tokens, row.crossing))
    assert {i: sorted(v) for i, v in got.items()} == {i: brute(t) for i, t in enumerate(own)}
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


def test_tokens_across_blanks_and_other_white_space():
    encoder, r = token_counts.SpanEncoder(queries.tokenizer_path("byte_bpe_50k.json")), random.Random(12)
    own = ["a \u00a0 \u00a0 b", "a \u00a0 \u00a0 ", "\u3000 \u3000 b"] + ["".join(r.choice("ab  \n\t\u00a0\u00a0\u0085\u2003\u2028\u3000") for _ in range(r.randrange(20))) for _ in range(2000)]
    sizes, tokens = encoder.token_bytes(pa.array(own))
    got = np.split(sizes, np.cumsum(tokens)[:-1])
    assert [x.tolist() for x in got] == [encoder.bytes_of[e.ids].tolist() for e in map(encoder.tokenizer.encode, own)]
    assert tokens[0] == 3


# 9


def test_perfect_hash_is_perfect():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(3000)), np.uint8).reshape(-1, 32)
    h = exact_dedup.PerfectHash(digests)
    assert sorted(h.slot_of_input.tolist()) == list(range(3000)) and (h.lookup(digests) == h.slot_of_input).all()
    twins = digests[:4].copy()
    twins[:, :16] = 7  # agree in all bytes that the levels look at
    h = exact_dedup.PerfectHash(twins)
    assert sorted(h.lookup(twins).tolist()) == [0, 1, 2, 3]
    assert exact_dedup.PerfectHash(digests[:0]).lookup(digests[:5]).tolist() == [-1] * 5


@pytest.mark.parametrize("bucket_rows", [3, 1000])
def test_exact_dedup_against_brute_force(spark, bucket_rows):
    rows = [*ODD, *ODD[3:9], "a", "a"]
    got = exact_dedup.exact_dedup(frame(spark, rows, extra=True), bucket_rows=bucket_rows).collect()
    own = collections.defaultdict(list)
    for i, t in enumerate(rows):
        own[t or ""].append(i)
    want = {i: (max(own[t or ""]), len(own[t or ""]), max(own[t or ""]) == i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(rows)}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want


@pytest.mark.parametrize("history", [F.lit, None])
def test_exact_dedup_whatever_the_history(spark, history):
    rows = [(None, "x"), (None, "x"), (3, "y"), (3, "y"), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for held in (True, False) if history else (None,):
        got = exact_dedup.exact_dedup(df, history=F.lit(held) if history else None).collect()
        assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in got) == [(0, 4, 3, False), (0, 4, 3, False), (3, 3, 2, True), (3, 3, 2, True), (4, 4, 3, True)]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    assert [r.kept for r in exact_dedup.exact_dedup(spark.createDataFrame([(None, "q")], "doc_id long, text string")).collect()] == [True]


# 10


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\nv", None), (4, "u", ""), (5, "u", "é" * 5000), (6, "u", "<p>x</p>"), (None, "n", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    got = warc.read_archives(warc.write_archives(pages, volume_bytes=300)).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == {
        i: (len((t or "").encode()), digest(t), "revisit" if ref else "response", ref) for (i, _, t), ref in zip(rows, [None, 1, None, 3, None, 1, None], strict=True)
    }
    assert {r.page_id: r.target_uri for r in got if r.page_id in (2, 3)} == {2: "about:blank", 3: "u%0D%0Av"}
    assert [bytes(r.payload).decode() for r in got if r.page_id == 5] == ["é" * 5000]
    assert warc.read_archives(warc.write_archives(pages, least_bytes=6)).filter("record_type = 'response' and page_id in (3, 4)").count() == 2
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_reader_rejects_damage():
    good = warc._record(1, "u", b"payload", base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), None, 6)
    assert [r[2] for r in warc.parse("a", [good + good])] == ["response", "response"]
    bad = warc._record(1, "u", b"payload", "A" * 32, None, 6)
    for content in (good[:-5], bad, b"junk", zlib.compress(b"x")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.parse("a", [content]))


def test_warc_files(spark, tmp_path):
    record = warc._record(7, "u", b"p" * 100, base64.b32encode(hashlib.sha1(b"p" * 100).digest()).decode(), None, 6)
    (tmp_path / "one.warc.gz").write_bytes(record * 3)
    assert warc.read_files(spark, str(tmp_path)).count() == 3 == warc.read_files(spark, str(tmp_path), through_spark=True).count()
    pages = spark.createDataFrame([(i, "u", bytes([i]) * 50) for i in range(9)], "page_id long, url string, payload binary")
    written = warc.write_files(warc.write_archives(pages, volume_bytes=300), f"file://{tmp_path}/out")
    assert written.agg({"records": "sum"}).first()[0] == 9
    assert {r.page_id: bytes(r.payload) for r in warc.read_files(spark, f"{tmp_path}/out").collect()} == {i: bytes([i]) * 50 for i in range(9)}


def foreign(kind, block, *headers, kind_of="application/http; msgtype=response"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", f"Content-Type: {kind_of}", *headers, f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_warc_reader_takes_archives_of_other_writers():
    """warcinfo, request, chunked and unsized responses, metadata; in chunks of any size, across members."""
    sha = "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"hello world").digest()).decode()
    http = b"HTTP/1.1 200 OK\r\n"
    data = b"".join([
        foreign("warcinfo", b"software: x\r\n", kind_of="application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Target-URI: <http://a/>", kind_of="application/http; msgtype=request"),
        foreign("response", http + b"Transfer-Encoding: chunked\r\n\r\n6\r\nhello \r\n5;x=y\r\nworld\r\n0\r\n\r\n", "WARC-Target-URI: http://a/", sha),
        foreign("response", http + b"Server: s\r\n folded\r\n\r\nhello world"),
        foreign("response", http + b"Content-Length: 99\r\n\r\nhello", "WARC-Truncated: length", sha),
        foreign("revisit", http + b"\r\n", sha),
        foreign("resource", b"raw bytes", kind_of="image/png"),
        foreign("metadata", b"a: b\r\n", kind_of="application/warc-fields"),
    ])
    for step in (1, 7, 1000, len(data)):
        got = list(warc.parse("f", [data[i : i + step] for i in range(0, len(data), step)]))
        assert [(r[2], r[-1]) for r in got] == [("warcinfo", None), ("request", None), ("response", b"hello world"), ("response", b"hello world"), ("response", b"hello"), ("revisit", None), ("resource", b"raw bytes"), ("metadata", None)]
        assert got[2][4] == "http://a/" == got[1][4] and got[3][8] == got[2][8] == got[5][8] and got[0][5] is None
    for bad in (foreign("response", http + b"\r\nother", sha), foreign("response", http + b"Content-Length: 9\r\n\r\nother"), foreign("resource", b"x", sha, kind_of="text/plain"), data[:-3], b"plain text"):
        with pytest.raises(ValueError, match="^f: "):
            list(warc.parse("f", [bad]))


# all


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.ORACLES) <= set(queries.QUERIES)
