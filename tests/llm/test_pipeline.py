"""The pipeline against a brute-force version of all its stages."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from shelfmark.llm import queries
from tests.llm.test_llm import ODD, check_packing, components, frame, shingle_set

SF = "/root/testdata/sf0.001"


def survivors(texts, least=250):
    """{doc_id: text} after the first four stages; languages play no part beyond rejecting texts without letters."""
    own = {i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    last = {}
    for i, t in own.items():
        last[t] = max(i, last.get(t, i))
    own = {i: t for i, t in own.items() if last[t] == i}
    part = components({i: shingle_set(t) for i, t in own.items()})
    own = {i: t.encode() for i, t in own.items() if part[i] == i}
    count = {}
    for t in own.values():
        for k in range(len(t) - least + 1):
            h = hashlib.blake2b(t[k : k + least], digest_size=12).digest()
            count[h] = count.get(h, 0) + 1
    out = {}
    for i, t in own.items():
        keep = np.ones(len(t), bool)
        for k in range(len(t) - least + 1):
            if count[hashlib.blake2b(t[k : k + least], digest_size=12).digest()] > 1:
                keep[k : k + least] = False
        left = bytes(np.frombuffer(t, np.uint8)[keep]).decode(errors="ignore")
        if keep.all() or left.strip():
            out[i] = left
    return out


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language id", "exact dedup", "near dedup", "substring dedup", "packing"]


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = survivors({r.doc_id: r.text for r in docs.collect()})
    check_packing(corpus_pipeline.run(spark, SF).collect(), want, queries.tokenizer_path("word_bpe_49k.json"))


@pytest.mark.parametrize("texts", [ODD, []])
def test_odd_tables_pass_every_stage(spark, texts):
    docs = frame(spark, texts, extra=True)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    check_packing(docs.collect(), survivors(dict(enumerate(texts))), queries.tokenizer_path("word_bpe_49k.json"))


def test_null_and_repeated_ids_pass(spark):
    """Nothing crashes, no text is given to another row, and each rule of the docstring holds."""
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh ") for _ in range(900))
    rows = [(1, "one two three four five six"), (1, "another text under the same id"), (None, "no id, own text here"), (None, "one two three four five six"), (2, long), (None, "start " + long[:500])]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        if name == "language id":
            assert sorted(x.text for x in docs.collect()) == sorted(t for _, t in rows)  # none lacks letters, and no lang is there to learn from
    left = {(x.doc_id, x.text) for x in docs.collect()}
    assert left == {(1, rows[0][1]), (1, rows[1][1]), (None, rows[2][1]), (2, long[500:]), (None, "start ")}


def test_passages_of_51_words_go_and_short_repeats_stay(spark):
    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 6))) for _ in range(n))
    passage, line = words(51), words(30)
    assert len(passage) >= corpus_pipeline.PASSAGE_BYTES > len(line)
    rows = [(i, f"{words(80)} é{passage}é {words(60)}\ufffd {line}") for i in range(3)] + [(3, words(90)), (4, f"{words(70)}\ufffd {line}")]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {x.doc_id: (x.text, x.n_chars) for x in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    for i, t in rows:
        want = t.replace(f" é{passage}é ", "")
        assert left[i] == (want, len(want) if i < 3 else 1)


def test_one_of_repeated_rows_survives(spark):
    """A row that comes twice, also without an id, is one document; it is not lost as a repeat of itself."""
    r = random.Random(4)
    a, b, c, d = ("".join(r.choice("abcdefgh ") for _ in range(600)) for _ in range(4))
    rows = [(1, a, "t"), (1, a, None), (1, a, "s"), (None, b, None), (None, b, None), (3, c, None), (None, c, None), (4, d, None)]
    docs = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_exact_copies(spark, docs, SF)
    assert sorted((x.doc_id or 0, x.text, x.source or "") for x in kept.collect()) == [(0, b, ""), (1, a, ""), (3, c, ""), (4, d, "")]
    docs = spark.createDataFrame(kept.collect(), docs.schema)
    for _, stage in corpus_pipeline.STAGES[2:4]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    assert sorted((x.doc_id or 0, x.text) for x in docs.collect()) == [(0, b), (1, a), (3, c), (4, d)]


def test_near_copies_go_by_row_where_ids_repeat(spark):
    """Of two texts under one id only the near copy goes; what is near the other text is not joined through the id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (9, a + " more"), (9, b), (12, b + " more"), (7, c), (7, c + " more"), (None, a + " other"), (3, "alone")]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(x.doc_id or 0, x.text) for x in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert [x for x in sorted(left) if x[0] != 7] == [(0, a + " other"), (3, "alone"), (5, a), (9, b)]
    assert len([x for x in left if x[0] == 7]) == 1


def test_crc_is_the_contracts():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")
