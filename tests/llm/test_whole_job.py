"""Cases that a shortened job would lose."""

import os
import random

import pytest

from kestrelix.llm.decontaminate import find_leaks
from test_operators import SCHEMA, benchmark, sentence


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("length, step", [(40, 4), (20, 3), (10, 3), (5, 3)])
def test_leaks_with_scattered_changes(spark, length, step):
    """Every ``step``-th word is another one: no run is longer than step - 1 words."""
    rng = random.Random(length)
    item = sentence(rng, length).split(" ")
    altered = " ".join("other" if i % step == step - 1 else w for i, w in enumerate(item))
    docs = table(spark, [f"{'so ' * before}{altered} {'end ' * 9}" for before in range(9)])
    rows = find_leaks(docs, benchmark(spark, [(1, " ".join(item)), (2, sentence(rng, 30))])).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(i, 1) for i in range(9)]
    assert {r["start_word"] for r in rows} == set(range(9))


def test_leaks_with_opening_names_changed(spark):
    item = "Alice has 12 apples and gives 3. Bob has 7 apples and 4 pears. How many in total?"
    copy = "Maria has 15 apples and gives 6. Piotr has 9 apples and 5 pears. How many in total?"
    mixed = "Maria has 15 apples and gives 6. Maria has 9 apples and 5 pears. How many in total?"
    docs = table(spark, [f"{'so ' * before}\n{t}" for t in (copy, mixed) for before in range(8)])
    rows = {r["doc_id"]: r for r in find_leaks(docs, benchmark(spark, [(1, item)])).collect()}
    assert [rows[i]["coverage"] for i in range(8)] == [1.0] * 8
    assert [rows[i]["coverage"] for i in range(8, 16)] == [pytest.approx(16 / 18)] * 8  # one name for two does not count


def test_pipeline_drops_copies_from_four_fifths(spark):
    """Of 46 shingles the copies keep 41: a similarity of 41/51, between 0.80 and 0.85."""
    import corpus_pipeline

    words = sentence(random.Random(6), 50).split(" ")
    copy = " ".join("other" if i == 20 else w for i, w in enumerate(words))
    docs = table(spark, [" ".join(words), copy, sentence(random.Random(7), 50)])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]


def files_below(folder):
    return {os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_nothing_stays_that_no_plan_reads(spark, tmp_path, monkeypatch):
    """After an operator the shared folder holds what its result reads, and after the pipeline its last table."""
    from kestrelix.llm import minhash, scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    rng = random.Random(2)
    texts = [sentence(rng, 40) for _ in range(12)] + [sentence(rng, 30)] * 3
    out = minhash.near_duplicates(table(spark, texts))
    read = {p.removeprefix("file:") for p in scratch.paths_read(out)}
    assert files_below(tmp_path / "shared") and {os.path.dirname(f) for f in files_below(tmp_path / "shared")} <= read
    assert out.where("not kept").count() == 2


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    """Null ids are judged like others, repeated ids by their texts, and an empty table stays empty."""
    import corpus_pipeline
    from test_operators import awkward, labels

    leak = sentence(random.Random(5), 30)
    clean = "an ordinary row that holds nothing"
    rows = [*awkward(), (None, f"x {leak} y", "en", "a", 1), (50, f"x {leak} y", "en", "a", 1), (50, clean, "en", "a", 1)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA + ", text_key string")
    benchmark(spark, [(None, leak), (2, None)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    labels(spark, [(4, 1, 0), (None, 1, 0), (6, 1, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(left) == len(rows) - 2 and (50, clean) in left and not any(leak in (t or "") for _, t in left)
    stages = [s for _, s in corpus_pipeline.STAGES[:-1]]
    assert all(s(spark, docs.drop("text_key"), str(tmp_path)).columns == corpus_pipeline.COLUMNS for s in stages[:3])
    docs.where("false").select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_partial_and_edited_leaks(spark):
    """The first 11 of 15 words (0.73), and a word changed in the middle, wherever they stand."""
    item = sentence(random.Random(19), 15).split(" ")
    parts = (item[:11], item[:7] + ["other"] + item[8:], item, item[:9])
    texts = [" ".join(["so"] * before + part + ["end"] * 9) for before in range(16) for part in parts]
    rows = find_leaks(table(spark, texts), benchmark(spark, [(1, " ".join(item))])).collect()
    assert sorted(r["doc_id"] for r in rows) == [i for i in range(64) if i % 4 < 3]


def test_glued_units_are_slots(spark):
    text = "a train goes {}km in {}h while one old tractor needs {}kg of coal and some {}l of water so who is slow".format
    docs = table(spark, [text(31, 6, 44, 9), text(31, 31, 31, 99)])
    rows = {r["doc_id"]: r for r in find_leaks(docs, benchmark(spark, [(1, text(30, 5, 40, 7))])).collect()}
    assert rows[0]["consistent"] and rows[0]["coverage"] == 1.0 and rows[0]["n_slots"] == 8
    assert not rows[1]["consistent"] and rows[1]["coverage"] == pytest.approx(23 / 27)  # three values became one
