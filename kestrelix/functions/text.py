"""Tokenising and query understanding as column expressions.

Only the fuzzy spelling match needs Python (an Arrow-batched pandas UDF over distinct
tokens); everything else stays in the JVM.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_-]+"
WORD = r"[\p{L}\p{N}_]"

# fixed values: rewrites of query words, in the order they apply
HINDI = [
    ("काले", "black"), ("काला", "black"), ("ब्लैक", "black"), ("नीले", "blue"), ("नीली", "blue"), ("नीला", "blue"),
    ("रनिंग", "running"), ("जूते", "shoes"), ("जूता", "shoe"), ("कुर्ती", "kurti"), ("कॉटन", "cotton"),
    ("वायरलेस", "wireless"), ("ईयरबड्स", "earbuds"), ("हेडफोन", "headphones"), ("घड़ी", "watch"),
    ("स्मार्टवॉच", "smartwatch"), ("बैग", "bag"), ("बैकपैक", "backpack"), ("लैपटॉप", "laptop"),
    ("सस्ता", "cheaper"), ("अंदर", "under"), ("से", ""), ("कम", "under"), ("महिला", "women"),
]
HINGLISH = [
    ("ke andar", "under"), ("k andar", "under"), ("se kam", "under"), ("se niche", "under"),
    ("kaale", "black"), ("kale", "black"), ("neela", "blue"), ("neeli", "blue"), ("jute", "shoes"),
    ("mahila", "women"), ("sasta", "cheaper"), ("saste", "cheaper"),
]
ALIASES = {
    "samsoong": "samsung", "samung": "samsung", "samsng": "samsung", "wirless": "wireless", "wireles": "wireless",
    "hedphones": "headphones", "hedphone": "headphones", "runing": "running", "addidas": "adidas", "nik": "nike",
    "cotn": "cotton", "earbud": "earbuds", "tshirt": "t-shirt", "earbuds": "earbuds",
}
STOPWORDS = ["the", "a", "an", "for", "with", "and", "or", "to", "of", "in", "on", "but", "same", "style", "this", "like", "me", "show"]
COLOURS = ["black", "blue", "red", "white", "grey", "green", "navy", "pink", "brown", "beige", "silver", "gold"]
BRANDS = [
    "nike", "puma", "adidas", "asics", "campus", "sparx", "skechers", "biba", "aurelia", "libas", "samsung", "boat",
    "jbl", "oneplus", "realme", "sony", "logitech", "hp", "sandisk", "anker", "portronics", "wildcraft", "skybags",
    "mokobara", "lavie", "casio", "titan", "fastrack", "noise", "timex", "philips", "wipro", "milton", "cello",
    "prestige", "bajaj", "wakefit",
]
MATERIALS = ["cotton", "rayon", "mesh", "polyester", "denim", "fleece", "leather", "metal", "plastic", "canvas", "silicone", "steel", "wood", "knit"]
CATEGORIES = [
    ("wireless earbuds", ["wireless earbuds", "earbuds", "buds", "tws"]),
    ("wireless headphones", ["wireless headphones", "bluetooth headphones", "headphones"]),
    ("running shoes", ["running shoes", "running shoe", "road running", "sports shoes", "jogging shoes"]),
    ("walking shoes", ["walking shoes", "walking shoe"]),
    ("trail shoes", ["trail shoes", "trail running"]),
    ("sneakers", ["sneakers", "sneaker"]),
    ("kurti", ["kurti", "kurta"]),
    ("sports t-shirt", ["sports t-shirt", "training t-shirt", "gym t-shirt", "sports tshirt"]),
    ("t-shirt", ["t-shirt", "tee"]),
    ("shirt", ["formal shirt", "shirt"]),
    ("hoodie", ["hoodie"]),
    ("jeans", ["jeans", "denim"]),
    ("backpack", ["backpack", "college bag", "laptop backpack"]),
    ("duffel bag", ["duffel", "gym bag"]),
    ("tote bag", ["tote"]),
    ("sling bag", ["sling"]),
    ("laptop bag", ["messenger bag", "laptop bag"]),
    ("smartwatch", ["smartwatch", "fitness watch"]),
    ("analog watch", ["analog watch", "formal watch"]),
    ("digital watch", ["digital watch"]),
    ("wireless mouse", ["wireless mouse", "bluetooth mouse"]),
    ("portable SSD", ["portable ssd", "ssd"]),
    ("charger", ["charger"]),
    ("power bank", ["power bank"]),
    ("wireless keyboard", ["wireless keyboard", "bluetooth keyboard"]),
    ("desk lamp", ["desk lamp", "study lamp"]),
    ("water bottle", ["water bottle", "bottle"]),
    ("electric kettle", ["electric kettle", "kettle"]),
    ("pillow", ["pillow"]),
    ("bedsheet", ["bedsheet"]),
    ("storage basket", ["storage basket"]),
    ("table clock", ["table clock"]),
]


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits, underscore and hyphen."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def whole(phrase: str) -> str:
    """A pattern that finds ``phrase`` as whole words, by look-around instead of \\b."""
    return rf"(?<!{WORD})(?:{phrase})(?!{WORD})"


def quoted(x: str) -> str:
    return x.replace("-", r"\-")


def search_document(title, description, category, brand, colour, attributes, tags, extra) -> Column:
    """The searchable text of a product, null parts counting as empty."""
    parts = [title, description, category, brand, colour, F.array_join(F.map_values(attributes), " "), F.array_join(tags, " "), extra]
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def rewrite(text: Column) -> Column:
    """Currency spacing, dictionary rewrites, ``3k`` prices and sign cleaning, in this order."""
    t = F.replace(F.lower(F.trim(text)), F.lit("₹"), F.lit(" ₹ "))
    t = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), HINDI, t)
    t = reduce(lambda c, kv: F.regexp_replace(c, whole(kv[0]), kv[1]), HINGLISH, t)
    t = expand_thousands(t)
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\p{M}\s₹.-]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def expand_thousands(text: Column) -> Column:
    """``2.5k`` becomes ``2500``: the parts around each match are joined with its value."""
    pattern = rf"(?<!{WORD})(\d+(?:\.\d+)?)\s*[kK](?!{WORD})"
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    parts = F.split(text, pattern)
    value = lambda i: F.get(values, i).cast("decimal(30,9)") * 1000
    joined = F.transform(parts, lambda p, i: F.when(i < F.size(values), F.concat(p, F.floor(value(i)).cast("bigint").cast("string"))).otherwise(p))
    return F.when(F.size(values) > 0, F.array_join(joined, "")).otherwise(text)


def _sequence_ratio(pair: pd.DataFrame) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(pair.iloc[:, 0], pair.iloc[:, 1])], dtype="float64")


def correct(queries: DataFrame, vocabulary: DataFrame, threshold: float = 0.82, band: int = 3) -> DataFrame:
    """(query_id, original, normalized, corrected, corrections, confidence) for (query_id, query).

    Tokens found in the alias table are replaced with confidence 0.99; other unknown words
    of four letters or more take the vocabulary word with the best matching-block ratio if it
    reaches ``threshold``, ties to the smaller word. Lengths may differ by ``band``: an
    equi-join on the possible lengths, over distinct tokens only.
    """
    base = queries.select("query_id", F.trim("query").alias("original"), rewrite(F.col("query")).alias("normalized"))
    words = base.select("query_id", F.posexplode(F.filter(F.split("normalized", " "), lambda x: x != "")).alias("pos", "token"))
    words = words.withColumn("bare", F.regexp_replace("token", r"^[.-]+|[.-]+$", ""))
    aliases = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    vocab = vocabulary.select("word").union(queries.sparkSession.createDataFrame([(x,) for x in sorted(set(ALIASES.values()))], "word string")).distinct()
    open_ = (F.length("bare") >= 4) & ~F.col("bare").isin(STOPWORDS) & ~F.col("bare").rlike(r"^\p{Nd}+$") & F.try_element_at(aliases, F.col("bare")).isNull()
    asked = words.where(open_).select("bare").distinct().join(vocab, F.col("bare") == F.col("word"), "left_anti")
    lengths = asked.withColumn("n", F.explode(F.sequence(F.length("bare") - band, F.length("bare") + band)))
    ratio = F.pandas_udf(_sequence_ratio, "double")
    close = lengths.join(vocab.withColumn("n", F.length("word")), "n").select("bare", "word", ratio(F.struct("bare", "word")).alias("r"))
    best = close.where(F.col("r") >= threshold).groupBy("bare").agg(F.min_by(F.struct("word", "r"), F.struct(-F.col("r"), F.col("word"))).alias("b"))
    fixed = words.join(best, "bare", "left").withColumn("alias", F.try_element_at(aliases, F.col("bare")))
    out = F.coalesce("alias", "b.word", "token")
    confidence = F.when(F.col("alias").isNotNull(), 0.99).otherwise(F.col("b.r"))
    change = F.when(confidence.isNotNull(), F.struct("bare", out.alias("to")))
    lines = fixed.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", out.alias("o")))), lambda x: x["o"]), " ").alias("corrected"),
        F.map_from_entries(F.array_sort(F.collect_set(change))).alias("corrections"),
        F.avg(confidence).alias("confidence"),
    )
    empty = F.create_map().cast("map<string,string>")
    return base.join(lines, "query_id", "left").select(
        "query_id", "original", "normalized", F.coalesce("corrected", F.lit("")).alias("corrected"),
        F.coalesce("corrections", empty).alias("corrections"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )


def _first_number(q: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.expr("cast(null as int)"), *[F.nullif(F.regexp_extract(q, p, 1), F.lit("")).try_cast("int") for p in patterns]])


# fixed values: price phrases
MAX_PRICE = [r"(?:under|below|less than|upto|up to)\s*₹?\s*(\d+)", r"₹\s*(\d+)\s*(?:or less|max)", rf"(?:^|\s)(\d+)\s*(?:under|below)(?!{WORD})"]
MIN_PRICE = [r"(?:above|over|more than|at least)\s*₹?\s*(\d+)"]


def first_word(q: Column, listed: list[str]) -> Column:
    """The first listed word that occurs as a whole word."""
    return F.coalesce(*[F.when(q.rlike(whole(quoted(x))), F.lit(x)) for x in listed])


def constraints(query: Column) -> dict[str, Column]:
    """Constraint columns parsed from a query; null where the query does not state one."""
    q = F.lower(query)
    brand = first_word(q, sorted(BRANDS, key=lambda b: (-len(b), b)))
    category = F.coalesce(*[F.when(q.rlike(whole("|".join(map(quoted, names)))), F.lit(c)) for c, names in CATEGORIES])
    return {
        "price_max": _first_number(q, MAX_PRICE),
        "price_min": _first_number(q, MIN_PRICE),
        "colour": first_word(q, sorted(COLOURS)),
        "brand": F.when(brand == "boat", F.lit("boAt")).otherwise(F.initcap(brand)),
        "category": category,
        "material": first_word(q, sorted(MATERIALS)),
        "gender": F.when(q.rlike(whole("women|woman|female|ladies")), "women").when(q.rlike(whole("men|man|male")), "men"),
        "comparative": F.when(q.contains("cheaper"), "cheaper"),
        "similar": F.when(q.contains("similar") | q.contains("same style"), True),
    }


def attribute_match(c: dict[str, Column], product: dict[str, Column]) -> tuple[Column, Column]:
    """(share of stated constraints met, labels of those met in a fixed order)."""
    hit, asked, labels = [], [], []

    def check(stated: Column, met: Column, label: Column):
        met = stated & F.coalesce(met, F.lit(False))
        asked.append(stated.cast("int"))
        hit.append(met.cast("int"))
        labels.append(F.when(met, label))

    for key in ("colour", "brand", "material", "gender"):
        check(c[key].isNotNull(), F.lower(product[key]) == F.lower(c[key]), F.concat(F.lit(f"{key}="), c[key]))
    check(c["category"].isNotNull(), category_hit(c["category"], product), F.concat(F.lit("category="), c["category"]))
    check(c["price_max"].isNotNull(), product["price"] <= c["price_max"], F.concat(F.lit("price≤₹"), c["price_max"].cast("string")))
    check(c["price_min"].isNotNull(), product["price"] >= c["price_min"], F.concat(F.lit("price≥₹"), c["price_min"].cast("string")))
    total = reduce(lambda a, b: a + b, asked)
    score = F.when(total > 0, reduce(lambda a, b: a + b, hit) / total).otherwise(F.lit(0.0))
    return score.cast("double"), F.array_compact(F.array(*labels))


def category_hit(category: Column, product: dict[str, Column]) -> Column:
    """Any word of the stated category is a substring of the product's category and type."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(product["category"], F.lit("")), F.coalesce(product["product_type"], F.lit(""))))
    return F.exists(F.split(F.lower(category), " "), lambda w: F.contains(hay, w))


def price_allowed(c: dict[str, Column], price: Column) -> Column:
    """Only the price is a hard filter; a constraint that is not stated lets all through."""
    return F.coalesce(price <= c["price_max"], F.lit(True)) & F.coalesce(price >= c["price_min"], F.lit(True))
