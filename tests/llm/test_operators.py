"""Every operator against a brute-force version, and on awkward tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kestrelix.llm import line_dedup, minhash, packing, quality, sharding
from kestrelix.llm.components import components
from kestrelix.llm.decontaminate import find_leaks
from kestrelix.llm.language_id import identify_languages
from kestrelix.llm.license_scan import scan_licenses
from kestrelix.llm.substring_dedup import FingerprintIndex, dedup_substrings
from kestrelix.llm.topk_search import topk_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [a + b for a in ("ka", "lo", "mi", "re", "su", "ti", "va") for b in ("n", "r", "s", "t", "l", "m")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside, as extra columns of other types
CLASH = "key string, node string, w string, u_ string, cluster string, fp string, shard string, length string, h1 string, label string, n string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=5, n=60):
    """Random texts with exact copies, near copies, shared passages and repeated lines."""
    rng = random.Random(seed)
    passage = sentence(rng, 70)
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and texts:
            texts.append(rng.choice(texts))
        elif kind == 2 and texts:
            w = texts[-1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind == 3:
            texts.append(sentence(rng, 20) + " " + passage + " " + sentence(rng, 15))
        elif kind == 4:
            texts.append("\n".join(sentence(rng, 12) for _ in range(4)) + "\nthe same line that many of the documents do hold")
        else:
            texts.append(sentence(rng, rng.randrange(3, 160)))
    return [(i, t, ("en", "fr", "de")[i % 3], f"src{i % 2}", len(t)) for i, t in enumerate(texts)]


def awkward():
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, "   \n\t ", "en", "a", 5), (4, long, "fr", "a", len(long)),
        (5, "one", "en", "a", 3), (5, "one", "en", "a", 3), (6, "ÉTÉ İK ßtraße 日本  x", "de", "a", 9), (None, "a row without an id here", "en", "a", 9),
        (7, long, "fr", None, len(long)), (8, "12 345 !!", "en", "a", 9), (9, "x" * 30_000, None, "a", 30_000),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    extra = ", ".join([SCHEMA, CLASH])
    return spark.createDataFrame([r + ("x",) * 11 for r in awkward()], extra)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# -- packing


def test_plan_fills_bins():
    rng = random.Random(1)
    sizes = Counter(rng.randrange(1, 101) for _ in range(2000))
    plan = packing.plan_bins(sizes, 100)
    placed = Counter()
    for times, filling in plan:
        assert sum(n * c for n, c in filling.items()) <= 100
        for n, c in filling.items():
            placed[n] += times * c
    assert placed == sizes
    bins, least = sum(t for t, _ in plan), -(-sum(n * c for n, c in sizes.items()) // 100)
    assert bins <= 1.02 * least


def check_packing(rows, texts, capacity=1024):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc, text in texts:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        cut = len(ids) % capacity or min(len(ids), capacity)
        start = piece = 0
        while start < len(ids):
            part = np.array(ids[start : start + (cut if not start else capacity)], np.uint32)
            want[(doc, piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
            start, piece = start + len(part), piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing(docs, odd, none):
    for table in (docs, odd):
        check_packing(packing.packed_digest(table).collect(), [(r["doc_id"], r["text"]) for r in table.collect()])
    assert packing.packed_digest(none).count() == 0


def test_packing_of_added_tokens(spark):
    end = "<|endoftext|>"
    texts = [f"hello {end} world", end, f"{end}{end} {end}", f"{end} at both ends {end}", f"a\n \n{end}  \n b", "<|endoftext|", f"x{end}'s {end}\t", None]
    table = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    rows = packing.packed_digest(table).collect()
    check_packing(rows, list(enumerate(texts)))
    hello = np.array([31373, 220, 50256, 995, 2], np.uint32)
    assert next(r["ids_crc32"] for r in rows if r["doc_id"] == 0) == zlib.crc32(hello.tobytes())


def test_batches_of_chunks_equal_whole_texts():
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = packing.ChunkTokenizer(*packing.default_vocabulary())
    true = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    parts = ["ab", "é", " ", " ", " ", "  ", "\n", " \n", "\t", "12", "'s", "!", "日", "à", "\u00a0", "\u3000", "word", "<|endoftext|>", "\x1f", "\u2028"]
    for size in (1, 7, 400):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(size)] + ["", None, " ", "x ", " x", "a b a b"]
        ids, bound = tok.batch(pa.array(texts), 2)
        for i, t in enumerate(texts):
            assert ids[bound[i] : bound[i + 1]].tolist() == true.encode(t or "", add_special_tokens=False).ids + [2], repr(t)
    assert tok.batch(pa.array([], pa.string()), 2)[1].tolist() == [0]


# -- exact top-k


def brute_topk(rows, k=5, every=50):
    x = {i: np.floor(256 * np.array(v, np.float64)).astype(int) for i, v in rows if i is not None and v is not None and all(a is not None and np.isfinite(a) for a in v)}
    out = []
    for q in x:
        if q % every == 0:
            best = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q and len(v) == len(x[q]))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_topk(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((400, 8)).astype(np.float32)
    v[10:30] = v[9]  # ties
    rows = [(i, [float(a) for a in x]) for i, x in enumerate(v)]
    rows += [(450, None), (500, [1.0, None] + [0.5] * 6), (550, [float("nan")] + [0.5] * 7), (600, [1.0, 2.0]), (601, [2.0, 1.0]), (650, []), (None, [1.0] * 8), (700, [0.0] * 8)]
    df = spark.createDataFrame([r + ("x",) for r in rows], "vec_id long, embedding array<float>, score string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search(df).collect())
    assert got == brute_topk([(i, x and [None if a is None else float(np.float32(a)) for a in x]) for i, x in rows])
    assert topk_search(df.where("false")).count() == 0


def test_topk_repeated_ids(spark, monkeypatch):
    """Rows of one id are queries and candidates of their own, also when their vectors are equal."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = []
    for i, (q, x) in enumerate(rows):
        if q % 50 == 0:
            best = sorted((-round(65536 * (x[0] * y[0] + x[1] * y[1])), v) for j, (v, y) in enumerate(rows) if j != i)
            want += [(q, r, v, -s) for r, (s, v) in enumerate(best, 1)]
    from kestrelix.llm import topk_search as module

    for cells in (1 << 22, 1):  # by broadcast, and on the grid
        monkeypatch.setattr(module, "BROADCAST_CELLS", cells)
        monkeypatch.setattr(module, "QUERY_BLOCK", 1)
        monkeypatch.setattr(module, "BLOCK", 2)
        monkeypatch.setattr(module, "CELL_BLOCKS", 1)
        got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search(df).collect()]
        assert sorted(got) == sorted(want)


# -- sharding


def test_sharding(docs, odd, none):
    for table in (docs, odd):
        rows = sharding.assign_shards(table).collect()
        texts = Counter((r["doc_id"], r["text"]) for r in table.collect())
        assert len(rows) == sum(texts.values())
        want = Counter()
        for (i, t), c in texts.items():
            b = (t or "").encode()
            want[(i, len(b) + 1, zlib.crc32(b))] += c
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
        counts = Counter(r["shard"] for r in rows)
        assert max(counts[s] for s in range(16)) - min(counts[s] for s in range(16)) <= 1
        for s, n in counts.items():
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    assert sharding.assign_shards(none).count() == 0


def shard_table(spark, sizes):
    """Groups of equal text of the given sizes, interleaved."""
    texts = [f"g{g}" for g, n in enumerate(sizes) for _ in range(n)]
    random.Random(1).shuffle(texts)
    return spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA), texts


def shards_of(spark, sizes, shards=16):
    table, texts = shard_table(spark, sizes)
    rows = sharding.assign_shards(table, shards=shards).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts) and max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    spread = defaultdict(set)
    for r in rows:
        spread[texts[r["doc_id"]]].add(r["shard"])
    return spread


@pytest.mark.parametrize("pairs", [800])
def test_full_shards_exchange_pairs(spark, pairs):
    """Every row is linked, so no shard has any room beside them: still no pair is cut."""
    assert all(len(s) == 1 for s in shards_of(spark, [2] * pairs).values())


def test_hot_text_uses_as_few_shards_as_it_can(spark):
    spread = shards_of(spark, [1600] + [2] * 800 + [3] * 200 + [1] * 1000)
    assert len(spread["g0"]) == -(-1600 // 300)
    assert all(len(s) == 1 for g, s in spread.items() if g != "g0")


@pytest.mark.parametrize("sizes", [[4, 3, 2, 1], [7, 2, 2, 1]])
def test_sharding_cuts_no_more_groups_than_needed(spark, sizes):
    total = sum(sizes)
    least = len(sizes)
    for mask in range(3 ** len(sizes)):  # each group in shard 0, in shard 1, or cut
        where = [mask // 3**i % 3 for i in range(len(sizes))]
        whole = [sum(n for n, w in zip(sizes, where) if w == s) for s in (0, 1)]
        if max(whole) <= -(-total // 2) and min(whole) <= total // 2:
            least = min(least, where.count(2))
    assert sum(len(s) > 1 for s in shards_of(spark, sizes, 2).values()) == least


def test_admission_credits_departures():
    ring = [(s, 0, (s + 1) % 4, 5) for s in range(4)]
    assert len(sharding.admit(ring, [10] * 4, [10] * 4)) == 4  # all exchange at once
    assert sharding.admit(ring[:3], [10] * 4, [10] * 4) == []  # shard 0 sends nothing away: the chain is trimmed
    assert len(sharding.admit(ring[:3], [10] * 4, [15, 10, 10, 10])) == 3


# -- near-duplicates


def brute_near(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("cluster", [400, 2])
def test_near_duplicates(docs, spark, cluster, monkeypatch):
    monkeypatch.setattr(minhash, "CLUSTER", cluster)
    monkeypatch.setattr(minhash, "BLOCK", 3 if cluster == 2 else 256)
    rows = minhash.near_duplicates(docs).collect()
    want = brute_near([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_awkward(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == 11
    by = {(r["doc_id"], r["component_id"]) for r in rows}
    assert (7, 4) in by and (1, 1) in by and (2, 2) in by and (None, None) in by and (5, 5) in by
    assert all(r["n_shingles"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert minhash.near_duplicates(none).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(8)
    shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 50, 50))
    for scale in (1, 30):
        x, y = np.concatenate([shared[: 300 // scale], a[: 50 // scale + 1]]), np.concatenate([shared[: 300 // scale], b[: 50 // scale + 1]])
        sig = minhash.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        true = (300 // scale) / (len(x) + len(y) - 300 // scale)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


# -- decontamination


def test_leaks(spark, odd, none):
    rng = random.Random(4)
    items = [(i, sentence(rng, 14 + i)) for i in range(6)] + [(6, "Train 12 leaves at 30 km per hour and train 15 at 12 km so when do both meet"), (7, None), (8, "too short")]
    fill = lambda: sentence(rng, 25)
    texts = [
        (0, f"{fill()} {items[0][1]} {fill()}"), (1, f"{fill()} {items[1][1].upper()}\n{fill()}"), (2, fill()),
        (3, f"{fill()} train 7 leaves at 45 km per hour and train 9 at 7 km so when do both meet {fill()}"),  # 12 -> 7 in both places
        (4, f"{fill()} {items[2][1]} {items[3][1]}"), (4, f"{fill()} {items[2][1]} {items[3][1]}"),
        (5, " ".join(items[4][1].split(" ")[:4]) + " " + fill()), (6, None), (7, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts], SCHEMA)
    rows = find_leaks(docs, benchmark(spark, items)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(0, 0), (1, 1), (3, 6), (4, 2), (4, 2), (4, 3), (4, 3)]  # two texts under one id
    assert all(r["consistent"] for r in rows)
    assert find_leaks(odd, benchmark(spark, items)).count() == 0
    assert find_leaks(none, benchmark(spark, items)).count() == 0
    assert find_leaks(docs, benchmark(spark, [])).count() == 0


def test_inconsistent_slots_do_not_count(spark):
    item = [(1, "7 and 7 and 7 and 7 and 7 and 7 and 7")]
    docs = spark.createDataFrame([(1, "1 and 2 and 3 and 4 and 5 and 6 and 8", "en", "a", 0), (2, "5 and 5 and 5 and 5 and 5 and 5 and 5", "en", "a", 0)], SCHEMA)
    assert [r["doc_id"] for r in find_leaks(docs, benchmark(spark, item)).collect()] == [2]


# -- quality


def brute_model(texts):
    """Interpolated modified Kneser-Ney by dictionaries."""
    order = quality.ORDER
    counts, pad = [None] + [Counter() for _ in range(order)], order - 1
    code = lambda t: [quality.START] * pad + list(t.encode())
    for t in texts:
        s = code(t)
        for i in range(pad, len(s)):
            counts[order][tuple(s[i - pad : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    off, total, weight = {}, [None] + [Counter() for _ in range(order)], [None] + [Counter() for _ in range(order)]
    for k in range(1, order + 1):
        d = quality.discounts(*(sum(c == i for c in counts[k].values()) for i in (1, 2, 3, 4)))
        off[k] = lambda c, d=d: d[min(c, 3) - 1]
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            weight[k][g[:-1]] += off[k](c)

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / 256
        t = total[k][g[:-1]]
        if not t:
            return lower
        c = counts[k][g]
        return (c - off[k](c) if c else 0) / t + weight[k][g[:-1]] / t * lower

    def perplexity(t):
        s = code(t)
        return float(np.exp(-np.mean([np.log(p(tuple(s[i - pad : i + 1]))) for i in range(pad, len(s))])))

    return perplexity


@pytest.mark.parametrize("hot", [quality.HOT, 200])
def test_quality(spark, docs, odd, none, hot):
    """Where an n-gram is looked up, in the broadcast or by the join, changes no result."""
    rows = docs.collect()
    judged = labels(spark, [(r["doc_id"], int(r["doc_id"] % 2 == 0), 0) for r in rows])
    noise = spark.createDataFrame([(1000, "%$ #@! ZZZ ||| %%% QQQ" * 5, "en", "a", 0), (1001, None, "en", "a", 0), (1002, "", None, "a", 0)], SCHEMA)
    got = {r["doc_id"]: r for r in quality.score_quality(docs.unionByName(noise), judged, hot=hot).collect()}
    held = {r["doc_id"] for r in docs.where(quality.held_back("text")).collect()}
    assert 5 < len(held) < 30
    model = brute_model([r["text"] for r in rows if r["doc_id"] % 2 == 0 and r["doc_id"] not in held])
    for r in rows[:12]:
        assert got[r["doc_id"]]["perplexity"] == pytest.approx(model(r["text"]), rel=1e-4)
    assert got[1000]["perplexity"] == pytest.approx(model("%$ #@! ZZZ ||| %%% QQQ" * 5), rel=1e-4)
    assert not got[1000]["keep"] and got[1001]["keep"] and got[1002]["keep"] and got[1001]["perplexity"] is None
    trusted = [got[r["doc_id"]]["keep"] for r in rows if r["doc_id"] % 2 == 0]
    assert sum(trusted) >= len(trusted) - 1
    if hot != 200:
        return
    assert quality.score_quality(none, judged).count() == 0
    assert all(r["keep"] for r in quality.score_quality(docs, judged.where("false")).collect())
    assert quality.score_quality(odd, labels(spark, [(6, 1, 0), (6, 1, None), (4, 1, 1)])).count() == 11


def test_quality_tables_grow_with_the_text(spark):
    """No symbols are folded: the model holds as many n-grams as the trusted texts have."""
    sizes = []
    for n in (20, 80):
        rng = random.Random(31)
        texts = [" ".join("".join(rng.choices("aeiounrstlmé", k=9)) for _ in range(40)) for _ in range(n)]
        table = spark.createDataFrame([(t, True) for t in texts], "text string, trusted boolean")
        got = {r["g"]: (r["n"], r["c"]) for r in table.mapInArrow(quality._count, "g long, n long, c long").groupBy("g").agg({"n": "sum", "c": "sum"}).toDF("g", "n", "c").collect()}
        pad = bytes([quality.START]) * (quality.ORDER - 1)
        want = Counter(int.from_bytes((pad + t.encode())[i : i + quality.ORDER]) for t in texts for i in range(len(t.encode())))
        assert got == {g: (c, c) for g, c in want.items()}
        sizes.append(len(got))
    assert sizes[1] > 2 * sizes[0]


def test_hot_table():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 48, 5000))
    table = quality.HotTable(keys[::2], np.arange(len(keys[::2]), dtype=np.float32) + 1)
    found, gone = table.find(keys)
    assert gone.tolist() == list(range(1, len(keys), 2))
    assert found[::2].tolist() == (np.arange(len(keys[::2])) + 1).tolist() and not found[1::2].any()


# -- licenses


def test_licenses(spark, docs, odd, none):
    text = "CC-BY x cc by! General  public\nLicense. all rights all Rights reserved ccby"
    table = spark.createDataFrame(
        [(1, text, "en", "a", 0), (2, "Licensed under the Apache License, Version 2.0.", "en", "a", 0), (3, "licensed under the new apache license, version 2.0", "en", "a", 0), (4, None, "en", "a", 0), (5, "Kİ under the", "en", "a", 0)], SCHEMA
    )
    got = {r["doc_id"]: r for r in scan_licenses(table).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (14, 4, 0, 10)
    assert got[1]["base_labels"] == "cc-by,gpl,reserved" and got[1]["score"] == 1.0
    assert got[2]["labels"] == "apache-2.0" and got[2]["base_labels"] == "" and got[2]["first_word"] is None
    assert got[3]["score"] < 1 and got[4]["n_words"] == 0 and got[4]["score"] == 0 and got[5]["labels"] == ""
    assert got[5]["n_words"] == 3
    assert scan_licenses(docs).count() == docs.count() and scan_licenses(odd).count() == 11 and scan_licenses(none).count() == 0


def test_license_spans_are_verified(spark):
    notice = " ".join(f"word{i}" for i in range(40))
    words = notice.split(" ")
    texts = [
        f"so {notice} end",
        "so " + " ".join(words[:20] + ["put", "in"] + words[20:]),  # two words put in
        "so " + " ".join(words[:20] + ["put"] * 60 + words[20:]),  # two halves far apart
        " ".join(" ".join(words[:3]) for _ in range(40)),  # one n-gram again and again
        " ".join(" ".join(words[i : i + 3]) for i in reversed(range(38))),  # all n-grams, the wrong way round
        " ".join(words[:20]),
    ]
    table = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    for extra in ([("own", notice)], spark.createDataFrame([("own", notice), ("none", None)], "label string, text string")):
        got = {r["doc_id"]: r for r in scan_licenses(table, extra=extra).collect()}
        assert [got[i]["labels"] for i in range(6)] == ["own", "own", "", "", "", ""]
        assert [tuple(x) for x in got[0]["spans"]] == [("own", 1, 40, 1.0)]
        assert [tuple(x)[:3] for x in got[1]["spans"]] == [("own", 1, 42)] and got[1]["spans"][0]["share"] == pytest.approx(36 / 38)


# -- lines


def brute_lines(rows, least=8):
    def near(a, b):
        if max(len(a), len(b)) < least:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if abs(len(a) - len(b)) != 1:
            return False
        s, t = sorted((a, b), key=len)
        return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))

    seen, out = [], {}
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            q = line.strip(" \t\n\x0b\x0c\r")
            w = re.findall(r"[^\x20\x09-\x0D]+", q)
            if q and any(q == p or near(w, v) for p, v in seen):
                pass
            else:
                kept.append(line)
            if q:
                seen.append((q, w))
        out[i] = "\n".join(kept)
    return out


def test_lines(spark, docs, odd, none):
    rng = random.Random(9)
    base = [sentence(rng, n) for n in (7, 8, 9, 20)]
    texts = [r["text"] for r in docs.collect()][:30]
    for b in base:
        w = b.split(" ")
        for j in range(len(w)):
            texts += ["\n".join(["", " ".join(w[:j] + w[j + 1 :]), " ".join(w[:j] + ["new"] + w[j:]), " ".join(w[:j] + ["other"] + w[j + 1 :]), f" {b}\t", " ".join(w[::-1])])]
    rng.shuffle(texts)
    table = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(table).collect()}
    assert got == brute_lines(list(enumerate(texts)))
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == 11 and sum(r["kept_text"] is None for r in rows) == 1
    assert next(r for r in rows if r["doc_id"] == 7)["n_removed"] == 1
    assert line_dedup.dedup_lines(none).count() == 0


# -- passages


def brute_passages(rows, k=50):
    first, out = {}, {}
    for i, text in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
        keep = [True] * len(w)
        for j, g in enumerate(grams):
            if first.get(g, i) < i:
                keep[j : j + k] = [False] * k
        for g in grams:
            first.setdefault(g, i)
        left = [x for x, y in zip(w, keep) if y]
        out[i] = (len(w), len(w) - len(left), " ".join(left))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_passages(docs, batches):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in dedup_substrings(docs, batches=batches).collect()}
    assert got == brute_passages(rows)


def test_passages_awkward(odd, none):
    rows = dedup_substrings(odd).collect()
    assert len(rows) == 11
    assert {r["n_removed"] for r in rows if r["doc_id"] == 7} == {60_000}
    assert sum(r["n_removed"] for r in rows if r["doc_id"] != 7) == 0
    assert dedup_substrings(none).count() == 0


def test_index_goes_on_in_another_session(spark, docs, tmp_path):
    """Three batches, each with an index opened anew, give what one table gives; runs are merged by size."""
    path, got, least = f"file://{tmp_path}/index", {}, 0
    for most in (20, 40, 60):
        part, before = docs.where(f"doc_id >= {least} and doc_id < {most}"), docs.where(f"doc_id < {least}")
        index = FingerprintIndex(spark.newSession(), fan_in=2, path=path)
        assert index.version == 0 if not least else index.version > 0
        for r in index.add(part, before if least else None).collect():
            got[r["doc_id"]] = (r["n_words"], r["n_removed"], r["kept_text"])
        least = most
    assert got == brute_passages([(r["doc_id"], r["text"]) for r in docs.collect()])
    index.compact(everything=True)
    again = FingerprintIndex(spark, path=path)
    assert len(again.runs) == len(again.texts) == 1 and again.version == index.version
    assert sorted(os.path.basename(p) for p, _ in again.runs) == os.listdir(tmp_path / "index" / "runs")
    (tmp_path / "index" / "manifests" / "999999999-cut.json").write_text('{"version": 9')
    assert FingerprintIndex(spark, path=path).version == again.version


# -- languages


def test_languages(spark, odd, none):
    rng = random.Random(7)
    parts = {"aa": ["bo", "ka", "ri"], "bb": ["xen", "qui", "zot"], "cc": ["ähn", "öst", "üb"]}
    rows = []
    for i in range(300):
        lang = sorted(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30)), lang, "a", 0))
    rows += [(900, None, "aa", "a", 0), (901, "123 !!", "bb", "a", 0), (902, "", None, "a", 0)]
    got = {r["doc_id"]: r for r in identify_languages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [r for r in rows[:300] if got[r[0]]["held_out"]]
    assert held and all(got[i]["lang_pred"] == lang for i, _, lang, _, _ in held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert identify_languages(odd).count() == 11 and identify_languages(none).count() == 0


def test_languages_with_repeated_rows(spark):
    rng = random.Random(12)
    one, few = "bo ka ri bo ri ka", [" ".join(rng.choice(["xen", "qui", "zot"]) for _ in range(8)) for _ in range(40)]
    rows = [(i, one, "aa", "a", 0) for i in range(3000)] + [(5000 + i, t, "bb", "a", 0) for i, t in enumerate(few)]
    got = {r["doc_id"]: r["lang_pred"] for r in identify_languages(spark.createDataFrame(rows, SCHEMA), sample=10).collect()}
    assert {got[i] for i in range(3000)} == {"aa"} and {got[5000 + i] for i in range(40)} == {"bb"}


def test_texts_without_letters(spark):
    texts = ["Ⅷ Ⅸ 12", "½ ² ①", "_ 7", "ª", "日", "a1"]
    rows = [(i, t, None, "a", 0) for i, t in enumerate(texts)] + [(100 + i, "some words here", "en", "a", 0) for i in range(8)]
    got = {r["doc_id"]: r for r in identify_languages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["und"] * 3 + ["en"] * 3
    assert all(got[i]["score"] == 0 for i in range(3))


def brute_centroids(train, texts):
    """Nearest mean of unit TF-IDF vectors, by dictionaries of hashed byte n-grams."""

    def counts(t):
        b = bytes(c + 32 if 65 <= c < 91 else c if 97 <= c < 123 or c >= 128 else 32 for c in t.encode())
        return Counter(int.from_bytes(b[i : i + n]) * 2654435761 % 2**32 >> 20 for n in (2, 3) for i in range(len(b) - n + 1))

    df = Counter(f for t, _ in train for f in counts(t))
    idf = lambda f: np.log((1 + len(train)) / (1 + df[f])) + 1

    def unit(v):
        n = sum(x * x for x in v.values()) ** 0.5
        return {f: x / n for f, x in v.items()}

    vector = lambda t: unit({f: np.log1p(c) * idf(f) for f, c in counts(t).items()})
    means = {}
    for lang in sorted({x for _, x in train}):
        total = Counter()
        for t in {t for t, x in train if x == lang}:
            total.update(vector(t))
        means[lang] = unit(total)
    out = []
    for t in texts:
        v = vector(t)
        out.append(max(((sum(x * m.get(f, 0) for f, x in v.items()), lang) for lang, m in means.items()), key=lambda x: x[0])[::-1])
    return out


def test_languages_against_dictionaries(spark, docs):
    rng = random.Random(21)
    rows = [(i, sentence(rng, 12) + (" über" if i % 3 else " the end"), ("de", "en")[i % 3 == 0], "a", 0) for i in range(90)]
    got = {r["doc_id"]: r for r in identify_languages(spark.createDataFrame(rows, SCHEMA), clusters=1).collect()}
    train = [(t, lang) for i, t, lang, _, _ in rows if not got[i]["held_out"]]
    for (i, *_), (lang, cos) in zip(rows, brute_centroids(train, [r[1] for r in rows])):
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(cos, abs=1e-4)


# -- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, lang, s, n) for i, t, lang, s, n in corpus(11, 40)]
    item = (1, sentence(random.Random(77), 30))
    rows.append((500, f"{sentence(random.Random(78), 40)} {item[1]} {sentence(random.Random(79), 40)}", "en", "a", 1))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(i, 1, 0) for i in range(40)]).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark, [item]).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    texts = {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "line_dedup":
            want = {i: t for i, t in brute_lines(sorted(texts.items())).items() if t.strip()}
            assert now == {i: want[i] for i in now} and set(now) == set(want)
        if name == "minhash_near_dedup":
            assert set(now) == {i for i, (_, c) in brute_near(texts.items()).items() if i == c}
        if name == "benchmark_decontamination":
            assert set(texts) - set(now) == {500}
        texts = now
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), texts.items())


def test_sha_digest_of_lines(spark, tmp_path):
    spark.createDataFrame(corpus(3, 12), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    full = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    for r in line_dedup.op8_line_dedup(spark, str(tmp_path)).collect():
        assert r["kept_sha256"] == hashlib.sha256(full[r["doc_id"]].encode()).hexdigest()


def test_registered_once_for_each_operator():
    from kestrelix.llm.queries import oracle_sql, queries

    assert [sum(q.startswith(f"op{n}_") for q in queries()) for n in range(1, 11)] == [1] * 10
    assert set(oracle_sql()) <= set(queries())
    assert os.path.basename(packing.default_vocabulary()[0]) == "byte_bpe_50k.tiktoken"
