"""Benchmark decontamination over canonical templates, in DataFrame operations only.

Numbers, measured units and names become typed placeholders, so that a question whose
parameters were changed keeps its template. The windows of a document at every offset are
hash-joined with those of the benchmark items. They hold three words, in a row (XXX) or with a
gap (XX_X): an item of which 70 % of the words stand in place shares one with the document,
wherever the others were changed. A word with a placeholder is indexed in both readings; for
the windows every capitalised word may be a name. Hits are verified word by word on their
diagonal, and the slots have to be filled consistently: one value of the item, one value of
the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelix.llm.scratch import tidy, written

BROADCAST_ROWS = 500_000  # benchmark windows of 24 bytes
ITEM_ROWS = 20_000  # items of about 2 kB
LINKED = 5  # words in a row that let a diagonal add to others (a passage with words put in or left out)
NUMBER, UNIT, NAME = "0", "unitq", "nameq"
# fixed values: units that follow a number
UNITS = [
    "km", "m", "cm", "mm", "kg", "g", "mg", "l", "ml", "s", "ms", "min", "h", "mph", "kmh",
    "meters", "metres", "miles", "feet", "inches", "grams", "pounds", "liters", "litres",
    "seconds", "minutes", "hours", "days", "weeks", "months", "years", "percent",
    "dollars", "euros", "cents", "usd", "eur", "degrees",
]
_SPLIT = r"[^\p{L}\p{N}]+"
# the look-behinds come after the first letter: they are tried at few places only
_NAMED = r"\p{Lu}(?<=[\p{Ll}\p{N},;:] \p{Lu})[\p{Ll}]+"
_CAPITAL = r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{Ll}+"
_MEASURED = r"(\p{N}) ?(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"


def raw_words(text):
    """Lower-cased words; a unit is a word of its own, also where it is glued to its number."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), _MEASURED, "$1 $2"), _SPLIT), "")


def template_words(text, names: bool = True):
    """As many words as :func:`raw_words`, with placeholders for numbers, units and names."""
    if names:
        text = F.regexp_replace(text, _NAMED, NAME)
    text = F.regexp_replace(F.lower(text), _MEASURED, f"$1 {UNIT}")
    return F.array_remove(F.split(F.regexp_replace(text, r"\p{Nd}+", NUMBER), _SPLIT), "")


def _slot(word):
    return word.isin(NUMBER, UNIT, NAME)


def _marked(text):
    """As many words as :func:`raw_words`, numbers replaced, units and capitalised words marked."""
    text = F.regexp_replace(F.regexp_replace(text, r"\p{Nd}+", NUMBER), _CAPITAL, f"{NAME}$0{NAME}")
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), _MEASURED, f"$1 {UNIT}$2{UNIT}"), _SPLIT), "")


def _readings(words):
    """Hashes (b, a) of each marked word as it is and with its placeholder."""

    def both(w):
        bare = F.replace(F.replace(w, F.lit(NAME), F.lit("")), F.lit(UNIT), F.lit(""))
        held = F.regexp_replace(F.regexp_replace(w, f"{NAME}.*{NAME}", NAME), f"{UNIT}.*{UNIT}", UNIT)
        marked = F.contains(w, F.lit(NAME)) | F.contains(w, F.lit(UNIT))
        return F.struct(F.xxhash64(F.when(marked, bare).otherwise(w)).alias("b"), F.when(marked, F.xxhash64(held)).alias("a"))

    return F.transform(words, both)


def _windows(rows: DataFrame, gapped: bool) -> DataFrame:
    """(..., p, h) of the windows at every offset p of ``r``, in all readings; ``r`` is dropped."""
    kept = [c for c in rows.columns if c != "r"]
    # outer: no filter on the array is inferred that would read every text twice
    rows = rows.select(*kept, "r", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("r") - 3, F.lit(0)))).alias("p"))
    at = lambda i: F.get("r", F.col("p") + i)
    rows = rows.select(*kept, "p", *[at(i)[x].alias(f"{x}{i}") for i in range(4) for x in "ba"]).where("b2 is not null")

    def hashes(kind, places):
        read = [F.xxhash64(*[F.col(f"b{i}") for i in places], F.lit(kind))]
        for c in range(1, 8):
            named = [i for j, i in enumerate(places) if c >> j & 1]
            h = F.xxhash64(*[F.col(f"{'a' if i in named else 'b'}{i}") for i in places], F.lit(kind))
            for i in named:
                h = F.when(F.col(f"a{i}").isNotNull(), h)
            read.append(h)
        return F.when(F.coalesce(*[F.col(f"a{i}") for i in places]).isNull(), F.array(read[0])).otherwise(F.array(*read))

    h = hashes(0, (0, 1, 2))
    if gapped:
        h = F.concat(h, F.when(F.col("b3").isNotNull(), hashes(1, (0, 1, 3))).otherwise(F.array().cast("array<bigint>")))
    return rows.select(*kept, "p", F.explode_outer(h).alias("h")).where("h is not null")


@tidy
def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    coverage: float = 0.7,
    min_words: int = 5,
) -> DataFrame:
    """One row for each document (id and text) and benchmark item that it contains.

    doc_id, text_key (xxhash64 of the text), item_id, coverage (share of the item's words found
    in place; words in slots count if the filling is consistent: different values of the item
    stay different), n_slots, consistent, start_word. Items of fewer than ``min_words`` words
    and null texts never match. A null id, of a document or an item, is an id like any other.
    Rows that repeat id and text count once, as do items; the first of equal places is
    reported; an empty table on either side gives no rows; other columns are ignored.

    A changed capitalised word at the start of a text, sentence or line counts if it is a
    name in both and no other name contradicts it. No match of a ``coverage`` of 0.7 or more
    on one diagonal is lost; words on several diagonals add up where LINKED of them stand in a row.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("t")).where("t is not null")
    items = items.select("item_id", raw_words(F.col("t")).alias("raw"), template_words(F.col("t")).alias("item"), _marked(F.col("t")).alias("marked"))
    items, _ = written(items.where(F.size("raw") >= min_words).dropDuplicates(["item_id", "raw"]), "items")

    # at most ``missing`` words are changed and spoil three windows each; a diagonal that only adds to others has LINKED words in a row
    size = F.size("raw")
    missing = F.floor(size * (1 - coverage) + 1e-9).cast("int")
    need = F.greatest(F.lit(1), F.least(size - 2 - 3 * missing, F.lit(LINKED - 2)))
    # runs of two words can be all that is left of these: they need the windows with a gap
    short = F.ceil((size - missing) / (missing + 1)) < 3
    index = items.select("item_id", need.alias("need"), short.alias("short"), _readings(F.col("marked")).alias("r"))
    index = _windows(index.where("not short"), False).unionByName(_windows(index.where("short"), True))
    index, _ = written(index.select("item_id", "need", F.col("p").alias("o"), "h").distinct(), "windows")
    gapped = bool(items.where(short).limit(1).count())
    index = F.broadcast(index) if index.count() <= BROADCAST_ROWS else index

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    cut = rows.select("doc_id", F.xxhash64("text").alias("key"), _readings(_marked(F.col("text"))).alias("r"))
    hits = _windows(cut, gapped).join(index, "h").select("doc_id", "key", "item_id", "need", (F.col("p") - F.col("o")).alias("d"), "o")
    hits = hits.groupBy("doc_id", "key", "item_id", "d", "need").agg(F.countDistinct("o").alias("n")).where("n >= need").select("doc_id", "key", "item_id", "d").distinct()
    hits, _ = written(hits, "hits")

    few = hits.groupBy("doc_id", "key").agg(F.collect_list(F.struct("item_id", "d")).alias("hit"))
    few, _ = written(few, "candidates")
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    # repeated rows give repeated words of an item, which are counted once; no text is shuffled while few are broadcast
    rows = rows.withColumn("key", F.xxhash64("text"))
    texts = rows.join(few, (rows.key == few.key) & rows.doc_id.eqNullSafe(few.doc_id)).select(rows.doc_id, rows.key, "text", "hit")
    texts = texts.select("doc_id", "key", "hit", raw_words(F.col("text")).alias("doc_raw"), template_words(F.col("text")).alias("doc_words"), _marked(F.col("text")).alias("doc_marked"))
    texts = texts.withColumn("hit", F.explode_outer("hit")).select("doc_id", "key", "hit.*", "doc_raw", "doc_words", "doc_marked")
    items = F.broadcast(items) if items.count() <= ITEM_ROWS else items
    pairs = texts.join(items, texts.item_id.eqNullSafe(items.item_id)).drop(items.item_id)
    # the stretch of the document on the diagonal, word by word against the item
    now = lambda c, i: F.when(F.col("d") + i >= 0, F.get(c, F.col("d") + i))
    capital = lambda w: F.coalesce(F.startswith(w, F.lit(NAME)), F.lit(False))
    lined = F.transform(
        F.sequence(F.lit(0), F.size("raw") - 1),
        lambda i: F.struct(
            i.alias("i"),
            F.get("raw", i).alias("was"),
            now("doc_raw", i).alias("now"),
            now("doc_words", i).alias("form"),
            F.get("item", i).alias("slot"),
            (capital(F.get("marked", i)) & capital(now("doc_marked", i))).alias("name"),
        ),
    )
    same = lambda x: F.coalesce((x["was"] == x["now"]) | (x["slot"] == x["form"]), F.lit(False))
    agree = lambda rows: lambda x: F.forall(rows, lambda y: (x["was"] == y["was"]) == (x["now"] == y["now"]))
    on = ["doc_id", "key", "item_id", "d", "m"]
    pairs = pairs.select("doc_id", "key", "item_id", "d", F.size("raw").alias("m"), lined.alias("lined"))
    pairs = pairs.select(
        *on,
        F.filter("lined", same).alias("met"),
        F.filter("lined", lambda x: same(x) & _slot(x["slot"])).alias("slots"),
        F.filter("lined", lambda x: x["name"]).alias("names"),
    )
    pairs = pairs.withColumn("consistent", F.forall("slots", agree(F.col("slots")))).withColumn("known", F.transform("met", lambda x: x["i"]))
    pairs = pairs.withColumn("started", F.filter("names", lambda x: ~F.array_contains("known", x["i"]) & agree(F.col("names"))(x)))
    counted = F.filter("met", lambda x: F.col("consistent") | ~_slot(x["slot"]) | (x["was"] == x["now"]))
    # started words only complete a diagonal that reaches the coverage by itself
    enough = (F.size(counted) + F.size("started")) / F.col("m") >= coverage
    counted = F.concat(counted, F.when(enough, F.col("started")).otherwise(F.filter("started", lambda x: F.lit(False))))
    pairs = pairs.select(*on, "consistent", (F.size("slots") + F.size("started")).alias("n_slots"), F.transform(counted, lambda x: x["i"]).alias("at"))
    # written: a filter on ``at`` would be pushed down and compare all words again
    pairs, _ = written(pairs, "lined")
    in_row = F.exists("at", lambda i: F.forall(F.sequence(F.lit(1), F.lit(LINKED - 1)), lambda s: F.array_contains("at", i + s)))
    pairs = pairs.where(in_row | (F.size("at") / F.col("m") >= coverage)).select(*on, "consistent", "n_slots", F.explode("at").alias("i"))
    found = pairs.groupBy("doc_id", F.col("key").alias("text_key"), "item_id", "m").agg(
        (F.countDistinct("i") / F.col("m")).alias("coverage"),
        F.max("n_slots").alias("n_slots"),
        F.max("consistent").alias("consistent"),
        F.min(F.greatest(F.col("d"), F.lit(0))).alias("start_word"),
    )
    return found.where(F.col("coverage") >= coverage).drop("m")


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_key")
