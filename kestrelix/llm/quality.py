"""Quality filter: interpolated modified Kneser-Ney over character n-grams.

The model is trained on all trusted texts. It keeps every distinct run of ORDER bytes, so its
tables grow with the text; no symbols are folded and nothing is pruned. They are never held
whole by a task: n-grams are pre-aggregated in every partition and summed by key, the
statistics of Kneser-Ney smoothing (continuation counts, totals and discounts of contexts,
lower orders) are joins and aggregations of these sharded tables, and so is the probability
of each distinct n-gram of the corpus, which backs off through the orders by joins.

Documents meet that table in a join with split hot keys: the ``HOT`` commonest n-grams (a
fixed number of 12 bytes each) are broadcast and summed where the text is; the others leave
the pass as (row, n-gram, count) and are joined with the sharded table. As the commonest are
gone, no key of that join holds more than one in HOT of all positions. A text is rejected if
its perplexity exceeds a quantile of trusted texts of its language that the model has not
seen: one in HELD, chosen by a hash of the text, so that copies go together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelix.llm.scratch import remove, tidy, written
from kestrelix.llm.textops import mix, pieces, release, text_buffer

ORDER, BITS = 6, 8
HOT = 1 << 20
LABEL_ROWS = 1_000_000  # of 8 bytes, broadcast up to here
START = 10  # before a text stand ORDER - 1 line breaks
PIECE = 1 << 19  # bytes of text at once
MERGE = 2 << 20  # n-grams that a task holds
HELD = 4  # one in so many trusted texts only sets the thresholds
GRADES = 32  # grades of frequency for each doubling


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram codes ending at each byte of whole texts (each text after ORDER - 1 starts),
    the bytes of each text, and n + 1 bounds."""
    buf, offsets = text_buffer(column)
    n, pad = len(offsets) - 1, ORDER - 1
    out = np.full(len(buf) + n * pad, START, np.uint8)
    at = np.arange(len(buf)) + np.repeat(pad * np.arange(1, n + 1), np.diff(offsets))
    out[at] = buf
    code = np.zeros(max(0, len(out) - pad), np.int64)
    for j in range(ORDER):
        code <<= BITS
        code |= out[j : j + len(code)]
    return code[at - pad] if len(buf) else np.zeros(0, np.int64), np.diff(offsets), offsets


def _merge(runs: list[tuple[np.ndarray, ...]], few: int) -> None:
    """Merges the last runs (keys in order, and their counts) until ``few`` are left, each pair into one."""
    while len(runs) > few:
        (a, *have), (b, *more) = runs[-2:]
        del runs[-2:]
        k = np.concatenate([a, b])
        del a, b
        order = np.argsort(k, kind="stable")
        k = k[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        k = k[first]
        for i in range(len(have)):  # one column at a time
            c = np.concatenate([have[i], more[i]])
            have[i] = more[i] = None
            have[i] = np.add.reduceat(c[order], first) if len(k) else c
        runs.append((k, *have))


def _count(batches):
    """(g, n, c): distinct n-grams of a partition, their places and those in trusted texts.

    The runs of the pieces are merged as soon as two have a similar length, so little more is
    held than the distinct n-grams.
    """
    runs: list[tuple[np.ndarray, ...]] = []
    for whole in batches:
        for batch in pieces(whole, "text", PIECE):
            code, sizes, _ = symbols(batch.column("text"))
            trusted = np.repeat(batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool), sizes)
            for good in (True, False):
                k, n = np.unique(code[trusted == good], return_counts=True)
                runs.append((k, n, n if good else np.zeros_like(n)))
            del code, trusted, k, n
            while len(runs) > 1 and len(runs[-2][0]) < 2 * len(runs[-1][0]):
                _merge(runs, len(runs) - 1)
            if sum(len(r[0]) for r in runs) > MERGE:
                _merge(runs, 1)
                if len(runs[0][0]) > MERGE // 2:  # a partition of very many: sent on, the sum by key follows
                    yield from _count_rows(*runs.pop())
    _merge(runs, 1)
    if runs:
        yield from _count_rows(*runs.pop())
    release()


def _count_rows(*columns: np.ndarray):
    for at in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names=["g", "n", "c"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [i - (i + 1) * y * (b / a) if a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.05 * i), 0.95 * i) for i, x in zip((1, 2, 3), d))


def _suffix(g, k: int):
    return g.bitwiseAND((1 << (BITS * k)) - 1)


def kneser_ney(counts: DataFrame, order: int = ORDER) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """From (g, c) of the highest order: for each order k smoothed (g, p) and back-off weights (ctx, w).

    ``g`` packs the symbols of an n-gram, the last in the lowest bits. All steps are joins
    and aggregations of tables keyed by n-gram or context.
    """
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k], _ = written(tables[k + 1].groupBy(_suffix(F.col("g"), k).alias("g")).agg(F.count("*").alias("c")), f"counts-{k}")
    of = [F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    seen = None
    for k, table in tables.items():
        row = table.agg(*of).withColumn("k", F.lit(k))
        seen = row if seen is None else seen.unionByName(row)
    seen = {r["k"]: discounts(*(r[f"n{i}"] for i in (1, 2, 3, 4))) for r in seen.collect()}  # a row for each order
    probabilities, weights = {}, {}
    for k in range(1, order + 1):
        table, d = tables[k], seen[k]
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = table.withColumn("ctx", F.shiftright("g", BITS)).withColumn("off", off)
        context = rows.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum("off") / F.sum("c")).alias("w"))
        rows = rows.join(context, "ctx")
        own = (F.col("c") - F.col("off")) / F.col("total")
        if k == 1:
            now = rows.select("g", (own + F.col("w") / (1 << BITS)).alias("p"))
        else:
            low = probabilities[k - 1].select(F.col("g").alias("low"), F.col("p").alias("q"))
            now = rows.withColumn("low", _suffix(F.col("g"), k - 1)).join(low, "low").select("g", (own + F.col("w") * F.col("q")).alias("p"))
        probabilities[k], _ = written(now, f"order-{k}")
        weights[k] = context.select("ctx", "w")
    return probabilities, weights


def resolve(grams: DataFrame, probabilities: dict[int, DataFrame], weights: dict[int, DataFrame]) -> DataFrame:
    """Adds ``lp``, the log probability of each distinct n-gram ``g``, seen in training or not.

    What an order does not know goes on to the next lower one with the weight of its context.
    """
    kept = [c for c in grams.columns]
    left = grams.withColumn("at", F.col("g")).withColumn("lw", F.lit(0.0))
    out = None
    for k in range(max(probabilities), 0, -1):
        known = probabilities[k].select(F.col("g").alias("at"), "p")
        met, path = written(left.join(known, "at", "left"), f"backoff-{k}")
        done = met.where("p is not null").select(*kept, (F.col("lw") + F.ln("p")).alias("lp"))
        out = done if out is None else out.unionByName(done)
        context = weights[k].withColumnRenamed("ctx", "over")
        left = met.where("p is null").drop("p").withColumn("over", F.shiftright("at", BITS)).join(context, "over", "left")
        left = left.select(*kept, _suffix(F.col("at"), k - 1).alias("at"), (F.col("lw") + F.coalesce(F.ln("w"), F.lit(0.0))).alias("lw"))
    last = left.select(*kept, (F.col("lw") - float(np.log(1 << BITS))).alias("lp"))
    return out.unionByName(last)


class HotTable:
    """Log probabilities of a fixed set of n-grams: one slot a hash, the rest in a sorted list."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length())
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        at = self._slot(keys)
        self.key[at], self.value[at] = keys, values
        rest = self.key[at] != keys
        order = np.argsort(keys[rest])
        self.more, self.more_value = np.append(keys[rest][order], np.iinfo(np.int64).max), np.append(values[rest][order], 0).astype(np.float32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where missing) and the places that are missing."""
        at = self._slot(keys)
        out = self.value[at]
        other = np.flatnonzero(self.key[at] != keys)
        near = np.searchsorted(self.more, keys[other])
        out[other] = self.more_value[near]
        gone = other[self.more[near] != keys[other]]
        out[gone] = 0
        return out, gone


def _score(batches, shared):
    """Per row: bytes, summed log probability of the hot n-grams, and the others with counts."""
    keys, values = shared.value
    table = HotTable(keys, values)  # for one task: workers that stay alive do not keep it
    for whole in batches:
        for batch in pieces(whole, "text", PIECE):
            code, sizes, bound = symbols(batch.column("text"))
            lp, gone = table.find(code)
            total = np.concatenate([[0.0], np.cumsum(lp, dtype=np.float64)])
            owner = np.searchsorted(bound, gone, "right") - 1
            order = np.lexsort((code[gone], owner))
            g, owner = code[gone][order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])])) if len(g) else np.zeros(0, np.int64)
            cut = np.searchsorted(owner[first], np.arange(len(sizes) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (g[first], np.diff(np.append(first, len(g))))]
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sizes), pa.array(total[bound[1:]] - total[bound[:-1]]), *lists], names=[*kept, "n_bytes", "hot", "g", "k"]
            )
    del table, keys, values
    release()


def _hot(resolved: DataFrame, most: int) -> DataFrame:
    """The commonest n-grams, at most ``most``: those above a grade of frequency (no sort of all)."""
    graded = resolved.withColumn("grade", F.floor(F.log2("n") * GRADES))
    sizes = sorted(((r["grade"], r["s"]) for r in graded.groupBy("grade").agg(F.count("*").alias("s")).collect()), reverse=True)
    total, least = 0, None
    for grade, s in sizes:  # GRADES for each doubling: some thousand rows at most
        if total + s > most:
            break
        total, least = total + s, grade
    return graded.where(F.lit(False) if least is None else F.col("grade") >= least).select("g", "lp")


def held_back(text):
    """Marks the trusted texts that set the thresholds and train nothing."""
    return F.pmod(F.xxhash64(F.lit("held"), text), F.lit(HELD)) == 0


@tidy
def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quantile: float = 0.995,
    slack: float = 1.05,
    prior: int = 40,
    least: int = 20,
    hot: int = HOT,
) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), lang, n_bytes, perplexity, steadied, threshold, keep for every row.

    Trusted texts are those whose id ``labels`` (doc_id, quality, toxic) gives quality 1 and
    toxic 0 in some row and nothing else in another; a null id is never trusted. The threshold
    of a language is ``slack`` times the ``quantile`` of the steadied perplexities of its held
    back texts, of those of all languages if it has fewer than ``least`` (of all trusted texts
    if none is held back); a language without any (a null one is a language of its own) takes
    the largest threshold. A null or empty text has no perplexity and is kept; without any trusted text
    everything is kept. Rows with a null id are scored like any others, repeated rows are
    answered once each, ties in frequency change nothing (``hot`` only decides where an n-gram
    is looked up); an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    good = labels.groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good")).where("good = 1 and doc_id is not null")
    good, _ = written(good.select("doc_id"), "trusted")
    good = F.broadcast(good) if good.count() <= LABEL_ROWS else good
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), held_back(F.col(text_col)).alias("held"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    marked = rows.join(good.withColumn("trusted", F.lit(True)), "doc_id", "left").select("text", (F.coalesce("trusted", F.lit(False)) & ~held_back(F.col("text"))).alias("trusted"))
    grams = marked.where("text <> ''").mapInArrow(_count, "g long, n long, c long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    grams, _ = written(grams, "grams")
    trained = grams.where("c > 0").select("g", "c")
    if not trained.limit(1).count():
        none = F.lit(None).cast("double")
        return rows.select("doc_id", "text_key", F.nullif("lang", F.lit("")).alias("lang"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), none.alias("perplexity"), none.alias("steadied"), none.alias("threshold"), F.lit(True).alias("keep"))
    resolved, _ = written(resolve(grams.select("g", "n"), *kneser_ney(trained)), "resolved")
    top = _hot(resolved, hot).toArrow()  # at most ``hot`` rows of 16 bytes
    shared = spark.sparkContext.broadcast((top["g"].to_numpy(), top["lp"].to_numpy().astype(np.float32)))
    kind = dict(rows.dtypes)["doc_id"]
    summed, summed_path = written(
        rows.mapInArrow(lambda batches: _score(batches, shared), f"doc_id {kind}, text_key long, held boolean, lang string, n_bytes long, hot double, g array<long>, k array<long>").withColumn("u_", F.monotonically_increasing_id()), "summed"
    )
    rare = summed.where("size(g) > 0").select("u_", F.explode(F.arrays_zip("g", "k")).alias("x")).select("u_", "x.g", "x.k")
    rare = rare.join(resolved.select("g", "lp"), "g").groupBy("u_").agg(F.sum(F.col("k") * F.col("lp")).alias("rare"))
    ppl = F.when(F.col("n_bytes") > 0, F.exp(-(F.col("hot") + F.coalesce("rare", F.lit(0.0))) / F.col("n_bytes")))
    scored, _ = written(summed.drop("g", "k").join(rare, "u_", "left").select("doc_id", "text_key", "held", "lang", "n_bytes", ppl.alias("perplexity")), "scored")
    remove(spark, summed_path)
    # short texts say little: a prior worth ``prior`` bytes at the mean of their language steadies them
    own = scored.join(good, "doc_id", "left_semi").where("perplexity is not null")
    bits = F.col("n_bytes") * F.ln("perplexity")
    means = {r["lang"]: r["m"] for r in own.groupBy("lang").agg((F.sum(bits) / F.sum("n_bytes")).alias("m")).collect()}
    per_lang = lambda x: F.create_map(*[F.lit(v) for kv in sorted(x.items()) for v in kv])[F.col("lang")]
    mean = F.coalesce(per_lang(means), F.lit(max(means.values())))
    steady = F.exp((bits + prior * mean) / (F.col("n_bytes") + prior))
    among = lambda x: F.percentile_approx(x, quantile, 10_000)
    judged = own.where("held") if own.where("held").limit(1).count() else own
    every = judged.agg(among(steady).alias("t")).first()["t"]
    found = judged.groupBy("lang").agg(among(steady).alias("t"), F.count("*").alias("n")).collect()  # a row for each language
    limits = {r["lang"]: (r["t"] if r["n"] >= least else every) * slack for r in found}
    cut = F.coalesce(per_lang(limits), F.lit(max([every * slack, *limits.values()])))
    return scored.select(
        "doc_id",
        "text_key",
        F.nullif("lang", F.lit("")).alias("lang"),
        "n_bytes",
        "perplexity",
        steady.alias("steadied"),
        cut.alias("threshold"),
        F.coalesce(steady <= cut, F.lit(True)).alias("keep"),
    )


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text_key")
