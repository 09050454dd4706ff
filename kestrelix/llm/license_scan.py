"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word n-gram of a text is hash-joined with the n-grams of the templates. A
hit at word p with template offset o votes for diagonal p - o: all n-grams of one
occurrence vote alike. Votes are summed by (row, template, diagonal) and neighbouring
diagonals, which insertions or deletions cause, are merged. The words themselves are compared
in the join; a merged span is verified by reading it from left to right: only offsets that
rise count, each once, and enough of the words between its ends have to be template words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: base phrases and their labels
BASE_PHRASES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
#: further templates of this scan, with labels of its own
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("gpl-notice", "this work is licensed under the gnu general public license version"),
    ("mit", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
BROADCAST_ROWS = 500_000  # n-grams of a table of templates, of about 60 bytes
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text):
    """Lower-cased (A-Z) words; null counts as empty."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _grams(spark, extra) -> DataFrame:
    """Word n-grams (3 words, 2 for a phrase of 2) of the templates; one-word templates have none."""
    base = spark.createDataFrame(BASE_PHRASES, "label string, phrase string").withColumn("base", F.lit(True))
    if not isinstance(extra, DataFrame):
        extra = spark.createDataFrame(list(extra), "label string, text string")
    texts = base.unionByName(extra.select("label", F.col("text").alias("phrase"), F.lit(False).alias("base")))
    rows = texts.select("label", "base", word_array(F.col("phrase")).alias("w")).where("label is not null and size(w) > 1").distinct()
    rows = rows.withColumn("k", F.least(F.lit(3), F.size("w"))).withColumn("total", F.size("w") - F.col("k") + 1)
    rows = rows.withColumn("t", F.xxhash64("w")).select("*", F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("o"))
    word = lambda i: F.get("w", F.col("o") + i)
    grams = rows.select("label", "base", "t", "k", "o", "total", word(0).alias("a"), word(1).alias("b"), F.when(F.col("k") == 3, word(2)).otherwise("").alias("c"))
    return grams.withColumn("h", F.xxhash64("a", "b"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra=None, coverage: float = 0.75, shift: int = 2) -> DataFrame:
    """One row a document: words, base places, labels and the spans that grant them.

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label,
    first, last word, share). A base place needs all words of its phrase in a row. ``extra``
    holds further templates, whole notices if wanted: a list of (label, text) or a table with
    these columns (default: TEMPLATES); several texts may share a label. Such a template gives
    its label where diagonals at most ``shift`` apart hold, in order, a share of ``coverage``
    of its n-grams, and that share of the words between the first and last of them is its own.
    score is the best share of n-grams. A null or empty text has no words and no labels (empty
    strings and spans, null places, score 0). Rows with a null id and repeated rows are
    answered once each, equal shares change nothing; an empty table gives no rows; other
    columns are ignored.
    """
    grams = _grams(docs.sparkSession, TEMPLATES if extra is None else extra)
    grams = F.broadcast(grams) if not isinstance(extra, DataFrame) or grams.count() <= BROADCAST_ROWS else grams
    rows = docs.select(F.col(id_col).alias("doc_id"), word_array(F.col(text_col)).alias("w"), F.monotonically_increasing_id().alias("u_"))
    # the blank after the last word marks the end of a row, so that rows without a hit stay
    rows = rows.select("doc_id", "u_", F.size("w").cast("long").alias("n_words"), F.concat("w", F.array(F.lit(""), F.lit(""), F.lit(""))).alias("w"))
    at = rows.select("doc_id", "u_", "n_words", "w", F.posexplode("w").alias("p", "w0")).where("p <= n_words")
    at = at.select("doc_id", "u_", "n_words", "p", "w0", F.get("w", F.col("p") + 1).alias("w1"), F.get("w", F.col("p") + 2).alias("w2"))
    at = at.withColumn("g", F.xxhash64("w0", "w1"))
    same = (at.g == grams.h) & (at.w0 == grams.a) & (at.w1 == grams.b) & ((grams.k == 2) | (at.w2 == grams.c))
    hits = at.join(grams, same, "left").where("label is not null or p = n_words").select("doc_id", "u_", "n_words", "label", "base", "t", "total", "k", "o", "p")

    keys = ["doc_id", "u_", "n_words", "label", "base", "t", "total"]
    by_start = Window.partitionBy(*keys).orderBy("d", "o")
    hits = hits.withColumn("d", F.col("p") - F.col("o"))
    hits = hits.withColumn("new", F.coalesce(F.col("d") - F.lag("d").over(by_start) > shift, F.lit(True)).cast("int"))
    hits = hits.withColumn("run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    hits = hits.withColumn("votes", F.count("o").over(Window.partitionBy(*keys, "d")))
    # read from left to right, an n-gram counts if it lies behind all before it in the template, too
    reading = Window.partitionBy(*keys, "run").orderBy("p", "o").rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("behind", F.col("o") - F.max("o").over(reading)).withColumn("counts", F.coalesce(F.col("behind") > 0, F.col("o").isNotNull()))
    start = F.col("base") & (F.col("votes") == F.col("total")) & (F.col("o") == 0)
    counted = lambda x: F.when(F.col("counts"), x)
    spans = hits.groupBy(*keys, "run").agg(
        (F.count(counted(F.lit(1))) / F.col("total")).alias("share"),
        F.sum(counted(F.least("k", F.coalesce("behind", "k")))).alias("own"),
        F.min(counted(F.col("p"))).alias("from"),
        (F.max(counted(F.col("p") + F.col("k"))) - 1).alias("to"),
        F.count(F.when(start, 1)).alias("places"),
        F.min(F.when(start, F.col("d"))).alias("first"),
        F.max(F.when(start, F.col("d"))).alias("last"),
    )
    verified = (F.col("share") >= coverage) & (F.col("own") >= coverage * (F.col("to") - F.col("from") + 1))
    granted = F.when(F.col("base"), F.col("places") > 0).otherwise(verified)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    span = F.struct("label", F.col("from").cast("long").alias("first"), F.col("to").cast("long").alias("last"), "share")
    return (
        spans.groupBy("doc_id", "u_", "n_words")
        .agg(
            F.sum("places").cast("long").alias("n_base"),
            F.min("first").cast("long").alias("first_word"),
            F.max("last").cast("long").alias("last_word"),
            joined(F.when(F.col("base") & granted, F.col("label"))).alias("base_labels"),
            joined(F.when(granted, F.col("label"))).alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(granted, span))).alias("spans"),
        )
        .drop("u_")
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
