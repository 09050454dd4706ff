"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and all
but the last return the columns of documents. ``run`` writes each stage as Parquet in the
shared folder and reads it again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelix.llm.decontaminate import find_leaks
from kestrelix.llm.line_dedup import dedup_lines
from kestrelix.llm.minhash import near_duplicates
from kestrelix.llm.packing import packed_digest
from kestrelix.llm.quality import score_quality
from kestrelix.llm.scratch import paths_read, remove, tidy, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BROADCAST_ROWS = 1_000_000  # ids and keys of 16 bytes


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The rows whose id and text are not in ``gone`` (doc_id, text_key); few of these are
    broadcast, many are shuffled. A null id is an id like any other."""
    gone, _ = written(gone.select("doc_id", "text_key").distinct(), name)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("key_"))
    return rows.join(gone, (rows.key_ == gone.text_key) & rows.doc_id.eqNullSafe(gone.doc_id), "left_anti").select(*COLUMNS)


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Rows with a null id are judged like any others; null and empty texts stay; rows that
    repeat id and text are answered alike; an empty table stays empty.
    """
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where("not keep"), "rejected")


def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen earlier go, and documents that lose all their lines with them.

    Null texts stay null; a row with a null id comes first in the order; of equal lines the
    earliest by (id, place) stays; an empty table stays empty.
    """
    done = dedup_lines(docs, carry=("lang", "source"))
    done = done.where((F.col("n_removed") == 0) | (F.btrim("kept_text", F.lit(" \t\n\x0b\x0c\r")) != ""))
    text = F.col("kept_text")
    return done.select("doc_id", text.alias("text"), "carried.lang", "carried.source", F.length(text).cast("long").alias("n_chars"))


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; stages link from a similarity of 0.8.

    The one with the smallest id stays. Rows with a null id, and null or blank texts, are
    linked with nothing and stay; rows that repeat id and text are one document and stay or
    go together; an empty table stays empty.
    """
    return _without(docs, near_duplicates(docs, percent=80).where("not kept"), "copies")


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, those with a null id, too.

    Null and empty texts hold none; an empty table, of documents or items, removes nothing.
    """
    return _without(docs, find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "leaks")


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in packed sequences.

    Null texts are empty, every row yields at least its end id; an empty table gives no rows.
    """
    return packed_digest(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: tokens, signatures and the language model are beyond SQL; tests compare with brute force
ORACLE_SQL = None


@tidy
def _done(docs: DataFrame, name: str, stage, spark, sf_dir: str) -> DataFrame:
    """A stage's result, written; all tables it made on the way go."""
    return written(stage(spark, docs, sf_dir), name)[0]


def run(spark, sf_dir: str) -> DataFrame:
    """Pieces of the documents that pass all stages; an empty table of documents gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made: list[str] = []
    for name, stage in STAGES[:-1]:
        docs = _done(docs, name, stage, spark, sf_dir)
        remove(spark, *made)
        made = paths_read(docs)
    packed = STAGES[-1][1](spark, docs, sf_dir)
    if not set(made) & set(paths_read(packed)):
        remove(spark, *made)
    return packed
