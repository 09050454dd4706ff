"""Readers, writers and validators of catalogues, judged queries, logs and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S = T.StringType()
CATALOG = T.StructType(
    [T.StructField(n, S) for n in ("id", "title", "description", "category", "brand", "colour", "image_path")]
    + [
        T.StructField("price", T.IntegerType()),
        T.StructField("attributes", T.MapType(S, S)),
        T.StructField("tags", T.ArrayType(S)),
        T.StructField("search_text_hi", S),
    ]
)
TEXT_EVAL = T.StructType([T.StructField("query", S), T.StructField("type", S), T.StructField("relevance", T.MapType(S, T.IntegerType()))])
IMAGE_EVAL = T.StructType([T.StructField("query_product_id", S), T.StructField("relevant_product_ids", T.ArrayType(S)), T.StructField("label_rule", S)])
GOLDEN = T.StructType(
    [T.StructField(n, S) for n in ("query_id", "query", "language", "modality", "query_type", "query_image_id")]
    + [T.StructField("relevant_document_ids", T.ArrayType(S)), T.StructField("graded_relevance", T.MapType(S, T.IntegerType())), T.StructField("notes", S)]
)
MODALITIES = ["text", "image", "multimodal"]


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; blank lines are skipped and a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, CATALOG)


def coerce_golden(rows: DataFrame) -> DataFrame:
    """Defaults: grade 1 for each relevant id, relevant ids from the grades, unknown language."""
    relevant, grades = F.col("relevant_document_ids"), F.col("graded_relevance")
    ones = F.map_from_arrays(relevant, F.transform(relevant, lambda x: F.lit(1)))
    has = lambda c: c.isNotNull() & (F.size(c) > 0)
    return rows.select(
        "query_id",
        F.coalesce("query", F.lit("")).alias("query"),
        F.coalesce("language", F.lit("unknown")).alias("language"),
        "modality",
        F.coalesce("query_type", F.lit("unknown")).alias("query_type"),
        "query_image_id",
        F.when(has(relevant), relevant).otherwise(F.map_keys(grades)).alias("relevant_document_ids"),
        F.when(has(grades), grades).otherwise(ones).alias("graded_relevance"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    )


def golden_violations(rows: DataFrame) -> DataFrame:
    """(query_id, violation): every rule that a judged query breaks, and duplicate ids."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rules = [
        (blank(F.col("query_id")), "query_id is required"),
        (~F.coalesce(F.col("modality").isin(MODALITIES), F.lit(False)), "unsupported modality"),
        ((F.col("modality") == "text") & blank(F.col("query")), "text query has no text"),
        (F.col("modality").isin("image", "multimodal") & blank(F.col("query_image_id")), "query needs query_image_id"),
        (F.coalesce(F.size("graded_relevance"), F.lit(0)) <= 0, "no relevance labels"),
    ]
    each = rows.select("query_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules]))).alias("violation"))
    twice = rows.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1").select("query_id", F.lit("duplicate query_id").alias("violation"))
    return each.unionByName(twice)


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """Coerced judged queries; raises ValueError with the first violations."""
    rows = coerce_golden(read_jsonl(spark, path, GOLDEN))
    found = golden_violations(rows).orderBy("query_id", "violation").take(5)
    if found:
        raise ValueError("; ".join(f"{r['violation']}: {r['query_id']}" for r in found))
    return rows


def language_of(query_type):
    return F.when(query_type == "hindi", "hi").when(query_type == "hinglish", "hinglish").otherwise("en")


def golden_text(rows: DataFrame, prefix: str, order: list[str], language=None) -> DataFrame:
    """Judged text queries (query, type, relevance) numbered as prefix-001, prefix-002, ..."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.orderBy(*order))  # judged sets are small and curated
    return rows.select(
        F.format_string(f"{prefix}-%03d", number).alias("query_id"),
        "query",
        (language_of(F.col("type")) if language is None else F.lit(language)).alias("language"),
        F.lit("text").alias("modality"),
        F.coalesce("type", F.lit("unknown")).alias("query_type"),
        F.map_keys("relevance").alias("relevant_document_ids"),
        F.col("relevance").alias("graded_relevance"),
    )


def golden_images(rows: DataFrame, order: list[str]) -> DataFrame:
    """Judged image queries (query_product_id, relevant_product_ids, label_rule), numbered image-001, ..."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.orderBy(*order))  # judged sets are small and curated
    relevant = F.col("relevant_product_ids")
    return rows.select(
        F.format_string("image-%03d", number).alias("query_id"), F.lit("").alias("query"), F.lit("none").alias("language"), F.lit("image").alias("modality"),
        F.lit("image_to_image").alias("query_type"), F.col("query_product_id").alias("query_image_id"), relevant.alias("relevant_document_ids"),
        F.map_from_arrays(relevant, F.transform(relevant, lambda x: F.lit(1))).alias("graded_relevance"), F.col("label_rule").alias("notes"),
    )


def golden_multimodal(rows: DataFrame, order: list[str], language: str = "en") -> DataFrame:
    """Judged image-with-text queries (query_image_id, query, relevance), numbered multimodal-001, ..."""
    text = golden_text(rows.withColumn("type", F.lit("image_plus_text")), "multimodal", order, language)
    from pyspark.sql import Window

    images = rows.select(F.format_string("multimodal-%03d", F.row_number().over(Window.orderBy(*order))).alias("query_id"), "query_image_id")
    return text.join(images, "query_id").withColumn("modality", F.lit("multimodal")).withColumn("notes", F.lit(""))


def golden_union(*parts: DataFrame) -> DataFrame:
    """All judged queries under one schema; columns that a source lacks are null."""
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return coerce_golden(out)


def judgements(golden: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade)."""
    return golden.select("query_id", F.explode("graded_relevance").alias("doc_id", "grade"))


SLOTS = 256
SLOT_ROWS = 20_000  # digests of 72 bytes in one slot


def content_hash(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(rows, content_hash): sha256 over the sorted row digests, whatever the partitioning.

    Digests are sorted in slots by their first hex digits, at least two; more of them for more
    rows, so that no slot grows with the table. The hashes of four-digit slots are hashed by
    their first two digits, and so on up to one.
    """
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    depth = 2
    total = rows.count()
    while total > SLOT_ROWS * 16**depth:
        depth += 2
    slots = rows.select(F.substring(digest, 1, depth).alias("slot"), F.concat_ws(":", F.col(key).cast("string"), digest).alias("d"))
    joined = lambda c: F.sha2(F.array_join(c, "\n"), 256)
    parts = slots.groupBy("slot").agg(joined(F.array_sort(F.collect_list("d"))).alias("h"), F.count("*").alias("n"))
    listed = joined(F.transform(F.array_sort(F.collect_list(F.struct("slot", "h"))), lambda x: x["h"]))
    while depth > 2:
        depth -= 2
        parts = parts.groupBy(F.substring("slot", 1, depth).alias("up")).agg(listed.alias("h"), F.sum("n").alias("n")).withColumnRenamed("up", "slot")
    return parts.agg(F.sum("n").alias("rows"), listed.alias("content_hash"))


def manifest(rows: DataFrame, key: str, columns: list[str], mode: str, dim: int, backend: str) -> DataFrame:
    """One row that names what an index was built from."""
    return content_hash(rows, key, columns).select(F.lit(1).alias("version"), F.lit(mode).alias("mode"), "rows", "content_hash", F.lit(dim).alias("dim"), F.lit(backend).alias("backend"))


def manifest_matches(stored: DataFrame, current: DataFrame) -> bool:
    """Whether an index built under ``stored`` still serves; anything unreadable means no."""
    try:
        return stored.exceptAll(current).limit(1).count() == 0 and stored.count() == 1
    except Exception:
        return False


def log_rows(queries: DataFrame, understood: DataFrame, mode: str, latency_ms: float | None = None) -> DataFrame:
    """Rows of search_queries for a batch: what was asked, how it was read, and when."""
    parsed = [c for c in understood.columns if c.startswith("c_")]
    read = understood.select("query_id", F.col("query").alias("normalized_query"), F.to_json(F.struct(*[F.col(c).alias(c[2:]) for c in parsed])).alias("parsed_attributes"))
    return queries.select("query_id", F.col("query").alias("original_query")).join(read, "query_id", "left").select(
        "query_id", "original_query", "normalized_query", "parsed_attributes", F.lit(mode).alias("mode"), F.lit(latency_ms).cast("double").alias("latency_ms"), F.current_timestamp().alias("created_at")
    )


def append_log(queries: DataFrame, events: DataFrame, path: str) -> bool:
    """Appends a batch of searches and their result events; never fails the search itself."""
    try:
        queries.write.mode("append").parquet(f"{path}/search_queries")
        events.write.mode("append").parquet(f"{path}/search_events")
        return True
    except Exception:
        return False


def seed(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``existing`` and the rows of ``incoming`` whose key it lacks."""
    return existing.unionByName(incoming.join(existing.select(key), key, "left_anti").select(*existing.columns))


def create_tables(spark: SparkSession, prefix: str = "") -> None:
    """The five tables of the service: products, images, searches, events and index versions."""
    columns = {
        "products": "id STRING, title STRING, description STRING, category STRING, brand STRING, colour STRING, price INT, attributes MAP<STRING,STRING>, tags ARRAY<STRING>",
        "product_images": "product_id STRING, image_path STRING",
        "search_queries": "query_id STRING, original_query STRING, normalized_query STRING, parsed_attributes STRING, mode STRING, latency_ms DOUBLE, created_at TIMESTAMP",
        "search_events": "query_id STRING, product_id STRING, rank INT, score DOUBLE",
        "index_versions": "version INT, product_count BIGINT, dense_model STRING, visual_model STRING, build_seconds DOUBLE, created_at TIMESTAMP",
    }
    for name, cols in columns.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({cols}) USING parquet")
