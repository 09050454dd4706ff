"""What the Python workers hold: two share an executor with its JVM, and they outlive their tasks."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kestrelix.llm import minhash, packing, quality, textops


def lines(seed, n_bytes):
    """Text of letters and digits of which most n-grams come once."""
    rng = np.random.default_rng(seed)
    return np.frombuffer(b"abcdefghijklmnopqrstuvwxyz 0123\n", np.uint8)[rng.integers(0, 32, n_bytes)].tobytes().decode()


def counted(batches):
    total = Counter(), Counter()
    for batch in quality._count(batches):
        for g, n, c in zip(*(x.to_pylist() for x in batch.columns)):
            total[0][g] += n
            total[1][g] += c
    return total


@pytest.mark.parametrize("most, piece", [(quality.MERGE, quality.PIECE), (3000, 1 << 10), (60_000, 1 << 12)])
def test_counts_however_they_are_merged(monkeypatch, most, piece):
    """No n-gram is lost or counted twice, whether runs are merged, kept or sent on."""
    monkeypatch.setattr(quality, "MERGE", most)
    monkeypatch.setattr(quality, "PIECE", piece)
    rng = random.Random(3)
    texts = [lines(i % 7, rng.randrange(1, 5000)) for i in range(40)]
    good = [i % 3 == 0 for i in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 9]), pa.array(good[i : i + 9])], names=["text", "trusted"]) for i in range(0, 40, 9)]
    pad = bytes([quality.START]) * (quality.ORDER - 1)
    grams = [[int.from_bytes((pad + t.encode())[i : i + quality.ORDER]) for i in range(len(t))] for t in texts]
    n, c = counted(batches)
    assert n == Counter(g for x in grams for g in x)
    assert {g: k for g, k in c.items() if k} == Counter(g for x, y in zip(grams, good) if y for g in x)
    assert counted([]) == (Counter(), Counter())


def test_counting_holds_little_more_than_the_distinct_ngrams():
    """Eight million places of half a million n-grams, 24 bytes each: they never take 120 MB."""
    text = lines(1, 1 << 19)
    batch = pa.RecordBatch.from_arrays([pa.array([text, text]), pa.array([True, False])], names=["text", "trusted"])
    tracemalloc.start()
    try:
        places = sum(sum(b.column("n").to_pylist()) for b in quality._count(batch for _ in range(8)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert places == 8 * 2 * len(text)
    assert peak < 120e6


def test_span_hashes_of_long_buffers(monkeypatch):
    """The hash of a span does not depend on its place, and no table is longer than a segment or a span."""
    monkeypatch.setattr(textops, "SEGMENT", 100)
    rng = random.Random(4)
    words = [lines(rng.randrange(30), rng.choice([1, 7, 99, 100, 101, 350])).encode() for _ in range(200)]
    bound = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    got = textops.span_hashes(np.frombuffer(b"".join(words), np.uint8), bound[:-1], bound[1:])
    alone = [textops.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])) for w in words]
    for k in (0, 1):
        assert got[k].tolist() == [int(x[k][0]) for x in alone]
        assert len(set(got[k].tolist())) == len(set(words))
    none = np.zeros(0, np.int64)
    assert [len(x) for x in textops.span_hashes(np.zeros(0, np.uint8), none, none)] == [0, 0]


def test_tables_of_powers_go_with_the_task(monkeypatch):
    class Task:
        def partitionId(self):
            return 0

    monkeypatch.setattr(packing.TaskContext, "get", Task)
    text = lines(2, 200_000)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([1])], names=["doc_id", "text", "text_key"])
    ranks, pattern, added = packing.default_vocabulary()
    for task in (packing._tokenise([batch], ranks, pattern, added, 2, 1024), minhash._sign([batch], 5)):
        next(task)
        assert textops._powers
        assert not list(task)
        assert not textops._powers
