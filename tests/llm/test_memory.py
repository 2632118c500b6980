"""What the workers hold beside the JVM: temporaries of a task, and what is left of them when it ends."""

import gc
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import buffers, flac, queries, substring_dedup, vocabulary
from tests.llm.test_llm import frame


def random_text(n: int) -> str:
    r = random.Random(n)
    return "".join(r.choices("abcdefghij ", k=n))


def test_temporaries_of_segments_are_bounded():
    texts = pa.RecordBatch.from_pydict({"row": pa.array(range(400), pa.int64()), "text": pa.array([random_text(10_000 + i) for i in range(400)], pa.binary())})
    run = substring_dedup.find_segments(250)
    list(run(iter([texts.slice(0, 10)])))  # the tables of powers
    gc.collect()
    tracemalloc.start()
    for _ in run(iter([texts])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20


def test_temporaries_of_flac_are_bounded():
    texts = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(60), pa.int64()), "text": pa.array([random_text(50_000 + i) for i in range(60)])})
    streams = list(flac.to_streams(iter([texts])))
    for run, given in ((flac.to_streams, [texts]), (flac.to_samples, streams)):
        gc.collect()
        tracemalloc.start()
        rows = 0
        for batch in run(iter(given)):
            rows += batch.num_rows
            assert batch.num_rows == 1 or batch.nbytes < 2 << 20
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == 60 and peak < 36 << 20


def test_streams_are_read_by_one_worker_a_task(spark, monkeypatch):
    """Blocks sent on to another mapInArrow take a second worker beside each task."""
    back = flac.from_flac(flac.to_flac(frame(spark, ["a" * 700])).localCheckpoint())
    assert back._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    calls = []
    monkeypatch.setattr(buffers, "give_back", lambda: calls.append(1))
    texts = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a" * 700]})
    assert [r["payload"][0].as_py()[:700] for r in flac.to_samples(flac.to_streams(iter([texts])))] == [b"a" * 700] and calls == [1, 1]


@pytest.mark.parametrize("stop_early", [False, True])
def test_memory_is_given_back_when_a_task_ends(monkeypatch, stop_early):
    calls = []
    monkeypatch.setattr(buffers, "give_back", lambda: calls.append(1))
    batches = [pa.RecordBatch.from_pydict({"x": [i]}) for i in range(3)]
    out = buffers.lean(iter)(iter(batches))
    assert next(out) is batches[0] and not calls
    if stop_early:
        out.close()
    else:
        assert list(out) == batches[1:]
    assert calls == [1]


def words(r: random.Random, n: int) -> list[str]:
    marks = ["", "", ",", "...", "'s", "!%", "(", "é.", "日", "1", "İ", "İ,", "́", "<|endoftext|>", "　", "." + '"' * 9]
    return ["".join(r.choices("abcdefghijklmnopqrstuvwxyzßñ", k=r.randrange(3, 9))) + r.choice(marks) for _ in range(n)]


def test_the_encoders_cache_is_compact():
    """A dictionary of strings takes more than 170 bytes for each chunk."""
    encoder = vocabulary.ChunkEncoder(queries.tokenizer_path("word_bpe_49k.json"))
    r = random.Random(5)
    own = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(100_000)]
    texts = [pa.array([" ".join(own[i : i + 5000])]) for i in range(0, len(own), 5000)]
    tracemalloc.start()
    for text in texts:
        encoder.encode(text)
    gc.collect()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 100 * len(set(own))


def test_few_texts_go_to_the_tokenizer(monkeypatch):
    """A call for each word costs more than the words' ids."""
    encoder = vocabulary.ChunkEncoder(queries.tokenizer_path("word_bpe_49k.json"))
    sent = []
    real = encoder.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, add_special_tokens):
            sent.extend(texts)
            return real.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    encoder.tokenizer = Counting()
    r = random.Random(6)
    own = ["".join(r.choices("abcdefghij", k=7)) + r.choice(["", ","]) for _ in range(4000)]
    ids, *_ = encoder.encode(pa.array([" ".join(own)]))
    assert ids.tolist() == real.encode(" ".join(own), add_special_tokens=False).ids and len(sent) < 20


@pytest.mark.parametrize("same_hash", [False, True])
@pytest.mark.parametrize("most", [5_000_000, 300])
def test_ids_are_the_tokenizers_whatever_the_cache(monkeypatch, same_hash, most):
    """Also where chunks share a hash, the cache starts anew, and words put together are more than they look like."""
    monkeypatch.setattr(vocabulary, "MOST_IDS", most)
    if same_hash:
        monkeypatch.setattr(vocabulary, "chunk_keys", lambda data, offsets: (np.diff(offsets) % 3).astype(np.uint64))
    encoder = vocabulary.ChunkEncoder(queries.tokenizer_path("word_bpe_49k.json"))
    assert encoder.last is not None
    r = random.Random(7)
    known = words(r, 300) + ["x" * 90, "y" * 90 + ","]
    for _ in range(6):
        texts = [" ".join(r.choices(known, k=r.randrange(60))) for _ in range(20)] + ["", None, " a  b "]
        ids, sizes, ends, per_row = encoder.encode(pa.array(texts, pa.string()))
        edge = np.concatenate([[0], np.cumsum(sizes)])
        for i, t in enumerate(texts):
            assert ids[edge[i] : edge[i + 1]].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids
        assert per_row.tolist() == [sum(re.search(r"[.!?…。！？][\"'”’»)\]]*\Z", c[-8:]) is not None for c in re.split(r"[ \t\n\v\f\r]+", t or "")) for t in texts]
        assert len(ends) == per_row.sum()
