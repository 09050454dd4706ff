"""Near-duplicate line removal by deletion neighbourhoods, in DataFrame operations only.

Two lines within one word edit agree after one word is deleted from one or both of them.
Each candidate line emits its whole-line key and, for every word, the key of the line
without it. Keys are XORs of hashes of (word, place), so all variants of a line cost one
running total over its words. Lines that share (variant, deleted place) differ in that word
alone; a line whose whole key equals another's variant is that line without one word. Both
are decided from the earliest line of each key: no pairs are formed within a group.

Half keys select the candidates without loss: one edit leaves the first or the second half
of two lines equal, so a line that shares neither half with another has no near copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrelix.llm.scratch import tidy, written

MIN_WORDS = 8
BROADCAST_ROWS = 1_000_000
_BLANKS = r"[\x20\x09-\x0D]+"


def _words(line):
    return F.array_remove(F.split(line, _BLANKS), "")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _half_keys(w, n):
    """Keys of the halves that a partner of the same length or one word less or more shares."""

    def pair(m):
        h = F.floor(m / 2).cast("int")
        head = F.xxhash64(F.lit("head"), m, F.slice(w, 1, h))
        tail = F.xxhash64(F.lit("tail"), m, F.slice(w, n - (m - h) + 1, m - h))
        return [head, tail]

    return F.array(*pair(n), *pair(n - 1))


def _place():
    return F.struct("doc_id", "key", "line_no")


def _near(lines: DataFrame, distinct: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier one within one word edit."""
    long = distinct.where(F.col("n") >= min_words - 1)  # the shorter of two may have a word less
    halves = long.select("h1", F.explode(F.array_distinct("halves")).alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("half")
    near, _ = written(halves.join(shared, "half", "left_semi").select("h1").distinct(), "sharing")
    picked, _ = written(long.select("h1", "h2", "first").join(_few(near), "h1", "left_semi"), "picked")
    texts = lines.join(_few(picked.select("h1", "h2")), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line"))
    texts, _ = written(texts.join(picked, ["h1", "h2"]).select("h1", "h2", "first", _words(F.col("line")).alias("w")), "texts")

    at = texts.select("h1", "h2", "first", F.size("w").alias("n"), F.posexplode("w").alias("p", "word"))
    # the hash of a word at its place, and at the place before, where it stands after a deletion
    at = at.withColumn("here", F.xxhash64("word", "p")).withColumn("back", F.xxhash64("word", F.col("p") - 1))
    line = Window.partitionBy("h1", "h2")
    upto = line.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("a", F.bit_xor("here").over(upto)).withColumn("b", F.bit_xor("back").over(upto))
    at = at.withColumn("whole", F.bit_xor("here").over(line)).withColumn("backs", F.bit_xor("back").over(line))
    variant = F.col("a").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("backs")).bitwiseXOR(F.col("b"))
    deleted = at.where(F.col("n") >= min_words).select("h1", "h2", "first", "p", (F.col("n") - 1).alias("m"), variant.alias("v"))
    itself = at.where("p = 0").select("h1", "h2", "first", F.lit(-1).alias("p"), F.col("n").alias("m"), F.col("whole").alias("v"))
    keys, _ = written(deleted.unionByName(itself), "variants")

    # the earliest line for each (variant, place), and for each variant among its two kinds
    e = F.struct("first", "h1", "h2", "p")
    by_place, _ = written(keys.groupBy("v", "m", "p").agg(F.min(e).alias("e"), F.count("*").alias("c")), "places")
    both = by_place.groupBy("v", "m").agg(
        F.min(F.when(F.col("p") < 0, F.col("e"))).alias("e_self"), F.min(F.when(F.col("p") >= 0, F.col("e"))).alias("e_del")
    )
    mate = both.where("e_self is not null and e_del is not null")
    changed = keys.where("p >= 0").join(by_place.where("p >= 0 and c > 1").select("v", "m", "p", "e"), ["v", "m", "p"])
    longer = keys.where("p >= 0").join(mate.select("v", "m", F.col("e_self").alias("e")), ["v", "m"])
    shorter = keys.where("p < 0").join(mate.select("v", "m", F.col("e_del").alias("e")), ["v", "m"])
    cols = ["h1", "h2", "p", F.col("e.h1").alias("o1"), F.col("e.h2").alias("o2"), F.col("e.p").alias("q")]
    found = [x.where("e.first < first").select(*cols) for x in (changed, longer, shorter)]
    found = found[0].unionByName(found[1]).unionByName(found[2])

    # verify on the words themselves: equal once the places p and q are left out
    def without(a, i):
        return F.when(i < 0, a).otherwise(F.concat(F.slice(a, F.lit(1), F.greatest(i, F.lit(0))), F.slice(a, F.greatest(i, F.lit(0)) + 2, F.size(a))))

    mine = texts.select("h1", "h2", "w")
    other = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("w").alias("x"))
    pairs = found.join(mine, ["h1", "h2"]).join(other, ["o1", "o2"])
    return pairs.where(without(F.col("w"), F.col("p")) == without(F.col("x"), F.col("q"))).select("h1", "h2").distinct()


@tidy
def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, carry: tuple = ()) -> DataFrame:
    """doc_id, kept_text, n_lines, n_removed and the struct ``carried`` for every row.

    A line goes if an earlier one, in the order (id, place), is equal but for outer white
    space or, where the longer has at least ``min_words`` words, differs by one word inserted,
    deleted or replaced. Blank lines stay. A null text stays null with no lines. Rows that
    repeat both id and text are one document and are answered alike; a null id comes first;
    columns other than those of ``carry`` are ignored; an empty table gives no rows.
    """
    carried = F.struct(*carry) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), carried.alias("carried")).withColumn("key", F.xxhash64("text"))
    cut = rows.where("text is not null").select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    cut = cut.withColumn("line", F.btrim("line", F.lit(" \t\n\x0b\x0c\r"))).where("line <> ''")
    lines = cut.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))
    w = lines.withColumn("w", _words(F.col("line"))).withColumn("n", F.size("w"))
    halves = F.when(F.col("n") >= min_words - 1, _half_keys(F.col("w"), F.col("n")))
    table, _ = written(w.select("doc_id", "key", "line_no", "h1", "h2", "n", halves.alias("halves")), "lines")
    distinct, _ = written(
        table.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("halves").alias("halves")),
        "distinct",
    )
    near, _ = written(_near(lines, distinct, min_words), "near")
    again = distinct.where("copies > 1").select("h1", "h2", "first")
    gone = table.join(again, ["h1", "h2"]).where(_place() != F.col("first")).select("doc_id", "key", "line_no")
    gone = gone.union(table.join(near, ["h1", "h2"], "left_semi").select("doc_id", "key", "line_no"))
    drops, _ = written(gone.groupBy("doc_id", "key").agg(F.collect_set("line_no").alias("gone")), "gone")
    total = drops.agg(F.sum(F.size("gone"))).first()[0] or 0
    listed = F.broadcast(drops) if total <= 4 * BROADCAST_ROWS else drops  # of 4 bytes, and 24 a row
    same = rows.doc_id.eqNullSafe(listed.doc_id) & (rows.key == listed.key)
    out = rows.join(listed, same, "left").select(rows.doc_id, "text", "carried", "gone")
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda x, i: ~F.array_contains("gone", i))
    return out.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        "carried",
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
