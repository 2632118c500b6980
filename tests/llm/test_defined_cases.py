"""What operators and queries promise beyond usual tables: repeated and null ids, texts longer than a slice, whole queries."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import buffers, exact_dedup, language_id, near_dedup, packing, pieces, queries, shingles, substring_dedup, token_counts, warc
from shelfmark.llm.store import materialise
from tests.llm.test_llm import SF, frame

#: Ids that repeat with one text and with two, and null ids.
ROWS = [(1, "the same row, twice over"), (1, "the same row, twice over"), (2, "one id"), (2, "two texts under it"), (None, "no id here"), (None, None), (3, "")]


@pytest.fixture(scope="module")
def odd_ids(spark):
    return spark.createDataFrame([(i, t, "en") for i, t in ROWS], "doc_id long, text string, lang string")


def answers(rows, *columns):
    return sorted((r.doc_id if r.doc_id is not None else -1, *(r[c] for c in columns)) for r in rows)


def test_repeated_and_null_ids(spark, odd_ids):
    sizes = sorted((i if i is not None else -1, len((t or "").encode())) for i, t in ROWS)
    found = language_id.identify(odd_ids, language_id.learn(odd_ids)).collect()
    assert answers(found, "lang_pred") == sorted((i if i is not None else -1, "en" if t else "und") for i, t in ROWS)
    word, piece, byte = (queries.tokenizer_path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"))
    packed = packing.pack(odd_ids, word).collect()
    tok = Tokenizer.from_file(word)
    assert answers(packed, "doc_tokens") == sorted((i if i is not None else -1, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in ROWS)
    for own in {r.sequence_id: [x for x in packed if x.sequence_id == r.sequence_id] for r in packed}.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
    back = pieces.decode(pieces.encode(odd_ids, piece), piece).collect()
    assert answers(back, "text") == sorted((i if i is not None else -1, bytearray((t or "").encode())) for i, t in ROWS)
    spans = token_counts.count_tokens(odd_ids, byte).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.chars) for r in spans) == sizes
    near = near_dedup.near_dedup(odd_ids).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near) == sorted((i or 0, i or 0, True) for i, _ in ROWS)


#: Longer than any slice or batch that operators work on.
LONG = " ".join(f"w{i % 977}x{i % 1013}" for i in range(500_000))


def test_texts_longer_than_a_slice(spark, tmp_path):
    assert len(LONG) > 4 << 20
    docs = materialise(frame(spark, ["short one", LONG, "short two", LONG[: 1 << 20] + "!"]), "t")
    digest = hashlib.sha256(LONG.encode()).hexdigest()
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert got[1].text_sha256 == digest and got[1].group_size == 1
    words = LONG.split()
    near = {r.doc_id: r for r in near_dedup.near_dedup(docs).collect()}
    assert near[1].n_shingles == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}) and near[0].n_shingles == 1
    found = {r.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    assert set(found.values()) <= {"de", "en"}
    piece = queries.tokenizer_path("piece_bpe_32k.model")
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, piece), piece).collect()}
    assert hashlib.sha256(back[1]).hexdigest() == digest
    spans = token_counts.count_tokens(docs, queries.tokenizer_path("byte_bpe_50k.json")).filter("doc_id = 1").collect()
    assert [(r.start, r.chars) for r in spans] == [(0, len(LONG))]
    packed = [r for r in packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json")).collect() if r.doc_id == 1]
    at = 0
    for r in sorted(packed, key=lambda r: r.start):
        assert r.start == at and r.offset + r.length <= 4096
        at += r.length
    assert at == packed[0].doc_tokens
    pages = docs.selectExpr("doc_id page_id", "'u' url", "cast(text as binary) payload")
    read = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert hashlib.sha256(read[1].payload).hexdigest() == digest and read[1].payload_bytes == len(LONG)


# 1


def direct_margins(texts, langs, code, asked):
    """Bit classifiers worked out from the definition with dictionaries of n-grams, no hashing, no arrays."""

    def grams(t):
        t = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in t.lower()).encode()
        return [t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1) if b"  " not in t[i : i + n]]

    names = sorted(set(langs))
    count = {x: collections.Counter() for x in names}
    for t, x in zip(texts, langs, strict=True):
        count[x].update(grams(t))
    share = {}
    for x in names:
        for n, room in ((2, language_id.PAIRS), (3, language_id.TRIPLES)):
            total = sum(k for g, k in count[x].items() if len(g) == n) + language_id.SMOOTH * room
            share[x, n] = lambda g, x=x, total=total: (count[x][g] + language_id.SMOOTH) / total

    def margin(t, bit):
        own = grams(t)
        side = lambda g, s: np.mean([share[x, len(g)](g) for x, c in zip(names, code, strict=True) if c[bit] == s])
        return sum(math.log(side(g, 1) / side(g, -1)) for g in own) / max(len(own), 1)

    return [[margin(t, b) for b in range(code.shape[1])] for t in asked]


def test_language_id_against_a_direct_version():
    """Few n-grams, so that hashing them seldom makes two one: margins, codeword distances and predictions agree."""
    r = random.Random(5)
    alphabet = {"aa": "abc", "bb": "bcd", "cc": "cda"}
    langs = [x for x in alphabet for _ in range(12)]
    texts = [" ".join("".join(r.choice(alphabet[x]) for _ in range(r.randrange(2, 6))) for _ in range(15)) for x in langs]
    model = language_id.model_of({x: sum(language_id.gram_counts(pa.array([t]))[0] for t, y in zip(texts, langs, strict=True) if y == x) for x in alphabet})
    asked = texts[::5] + ["abcd dcba", "a", "b1b, b"]
    counts = language_id.gram_counts(pa.array(asked))
    want = np.array(direct_margins(texts, langs, model.code, asked))
    got = (counts @ model.weights) / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    assert np.abs(got - want).max() < 0.15 and np.abs(got - want).mean() < 0.03  # a few n-grams share a place of the tables
    best = model.predict(counts)[0]
    loss = [[sum(w * math.log1p(math.exp(-language_id.SHARPNESS * c * z)) for w, c, z in zip(model.trust, row, m, strict=True)) for row in model.code] for m in want]
    assert best.tolist() == [int(np.argmin(x)) for x in loss]


def test_language_query(spark):
    rows = queries.op1_error_correcting_language_id(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs) and list(rows[0].asDict())[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", docs[r.doc_id].text or ""))


# 4


def test_substring_query_at_400_bytes(spark):
    rows = {r.doc_id: r for r in queries.op4_bwt_substring_dedup(spark, SF).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(rows) == set(texts)
    count = collections.Counter(t[k : k + 400] for t in texts.values() for k in range(len(t) - 399))
    some = 0
    for i, t in texts.items():
        keep = np.ones(len(t), bool)
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                keep[k : k + 400] = False
        left = np.frombuffer(t, np.uint8)[keep].tobytes()
        runs = int((np.diff(np.concatenate([[True], keep]).astype(int)) == -1).sum())
        some += runs
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == (len(t), len(t) - len(left), runs, hashlib.sha256(left).hexdigest())
        assert rows[i].text == left.decode(errors="ignore")
    assert some


@pytest.mark.parametrize("broadcast", ["-1", "3000"])
def test_substring_dedup_where_joins_are_planned_anew(spark, broadcast):
    """No anchor's segments are parted by what adaptive execution does to joins: splits of skewed ones, local reads of small ones."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    shared = " ".join(word() for _ in range(60))
    rows = [" ".join(word() for _ in range(r.randrange(20))) + shared[k % 40 :][: 60 + k % 150] + " ".join(word() for _ in range(r.randrange(20))) for k in range(300)]
    count = collections.Counter(t[k : k + 50] for t in rows for k in range(len(t) - 49))
    settings = {"spark.sql.autoBroadcastJoinThreshold": broadcast, "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.01", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000", "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {x.doc_id: bytes(x.kept).decode() for x in substring_dedup.substring_dedup(frame(spark, rows).repartition(5), least=50, hot_segments=40).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for i, t in enumerate(rows):
        keep = np.ones(len(t), bool)
        for k in range(len(t) - 49):
            if count[t[k : k + 50]] > 1:
                keep[k : k + 50] = False
        assert got[i] == "".join(c for c, k in zip(t, keep, strict=True) if k)


def test_substring_dedup_splits_the_joins_of_one_hot_anchor(spark, monkeypatch):
    r = random.Random(7)
    some = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage = some(60)
    rows = [some(30) + passage + some(30) for _ in range(3000)]
    share = {}

    def watched(df, name):
        out = materialise(df, name)
        if name in ("repeat-met", "repeat-shared"):
            hot = out.groupBy("anchor").count().orderBy("count", ascending=False).first()
            parts = out.filter(out.anchor == hot.anchor).groupBy(F.input_file_name()).count().collect()
            share[name] = max(p["count"] for p in parts) / hot["count"]
        return out

    monkeypatch.setattr(substring_dedup, "materialise", watched)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.01", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = [(x.n_removed, bytes(x.kept).decode()) for x in substring_dedup.substring_dedup(frame(spark, rows).repartition(8), least=50).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(rows) and all(n >= 60 and passage not in t for n, t in got)
    assert set(share) == {"repeat-met", "repeat-shared"} and max(share.values()) < 0.6, share


def test_substring_dedup_keeps_characters_whole_if_asked(spark):
    a = "é" * 100
    docs = frame(spark, ["x" + a + "ü", "y" + a + "ö", "a genuine � stays"])
    bytes_ = {r.doc_id: bytes(r.kept) for r in substring_dedup.substring_dedup(docs, least=50).collect()}
    whole = {r.doc_id: bytes(r.kept) for r in substring_dedup.substring_dedup(docs, least=50, whole_characters=True).collect()}
    assert bytes_[0] == b"x" + "ü".encode()[1:] and whole[0] == b"x" and whole[1] == b"y" and whole[2] == bytes_[2] == "a genuine � stays".encode()


# 5


def test_packing_costs_no_more_in_blocks():
    """Windows that are closed block by block cost no more than one window's padding above the optimum of the whole stream."""
    r = np.random.default_rng(4)
    sizes = np.concatenate([r.integers(1, 60, 900), r.integers(100, 900, 60)])
    r.shuffle(sizes)
    ends = np.sort(r.choice(int(sizes.sum()), 700, replace=False))
    width = 256
    places, penalties = packing.boundaries(sizes, ends)
    whole = packing.best_cuts(np.concatenate([[0], places]), np.concatenate([[0], penalties]), width)
    cost = lambda cuts: sum(width - (b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    at = np.concatenate([[0], places])
    pen = np.concatenate([[0], penalties])
    best = cost(at[whole].tolist()) + int(pen[whole].sum())
    stream, got, edge = packing.Stream(0, width), [], np.concatenate([[0], np.cumsum(sizes)])
    for i in range(0, len(sizes), 40):
        own, lo, hi = sizes[i : i + 40], edge[i], edge[min(i + 40, len(sizes))]
        inside = ends[(ends > lo) & (ends <= hi)] - lo
        stream.add(list(range(i, i + len(own))), np.arange(lo, hi, dtype=np.uint32), own, inside)
        if stream.size >= 2048 and (out := stream.close(last=False)) is not None:
            got += out.to_pylist()
    got += stream.close(last=True).to_pylist()
    lengths = collections.Counter()
    for p in got:
        lengths[p["sequence_id"]] += p["length"]
    cuts = np.concatenate([[0], np.cumsum([lengths[k] for k in sorted(lengths)])]).tolist()
    place = {p: c for p, c in zip(at.tolist(), pen.tolist(), strict=True)}
    mine = cost(cuts) + sum(place[c] for c in cuts)
    assert best <= mine <= best * 1.02 + width


# 6, 8


def test_piece_and_token_queries(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op6_shared_prefix_pieces(spark, SF).collect()}
    assert {i: r.decoded_sha256 for i, r in rows.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    assert {i: r.n_pieces for i, r in rows.items()} == {i: len(lib.encode(t)) for i, t in texts.items()}
    tok = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    total = collections.Counter()
    for r in queries.op8_offset_token_counts(spark, SF).collect():
        total[r.doc_id] += r.tokens
    assert {i: total[i] for i in texts} == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_sets_of_hashes_are_those_of_words():
    r = random.Random(2)
    own = [" ".join(r.choice(["a", "b", "c", "d"]) for _ in range(r.randrange(0, 300))) for _ in range(200)]
    _, sizes = shingles.shingle_sets(*buffers.raw(pa.array(own)))
    words = [t.split() for t in own]
    assert sizes.tolist() == [len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else bool(w) for w in words]
