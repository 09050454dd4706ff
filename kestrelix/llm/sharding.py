"""Balanced label propagation: linked documents end up in the same shard.

1. Documents of equal text are linked, a group is a clique of links. Groups above a fixed
   share of a shard are few; they are labelled first, whole where they fit, and a group
   larger than a shard fills as few shards as it can.
2. All other linked documents start with labels dealt out by a hash. In each round the
   neighbours' labels are counted (joins and aggregations of one row a group and label, so
   that no group is ever gathered) and the documents of a group want the commonest. Flows
   between shards are admitted under the quotas, departures credited: what overfills a
   shard is trimmed until all of it fits at once, so full shards can exchange documents.
3. Groups that are cut after the last round, or sit in an overfull shard, are lifted out and
   dealt whole into the rooms left, the largest first; only what fits nowhere is split.
4. Documents without links are ballast and fill every shard to exactly its share of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrelix.llm.scratch import tidy, written

CELLS = 256  # units of admission for each wanted shard
HEAVY = 64  # a group above 1 / HEAVY of a shard is labelled first: fewer than 2 * HEAVY * shards of them
HOT_KEYS = 2000
KEY = ["k1", "k2"]


def dealt(df: DataFrame, key: list[str], by: list[str], name: str) -> DataFrame:
    """Adds ``name``: gapless from 0 within each value of ``key``, in no order to rely on.

    ``key`` has few values and ``by`` is unique. Rows are numbered within small hash buckets
    of ``by``, and the bucket sums give each bucket its base, so that no task holds all rows
    of a key. Nulls in ``key`` are not allowed, in ``by`` they are. An empty table stays empty.
    """
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    cells = max(64, 4 * int(n))
    df = df.withColumn("cell_", F.pmod(F.xxhash64(*by, F.lit(7)), F.lit(cells)))
    within = Window.partitionBy(*key, "cell_").orderBy(*by)
    sums = df.groupBy(*key, "cell_").agg(F.count("*").alias("n_"))
    upto = Window.partitionBy(*key).orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base_", F.coalesce(F.sum("n_").over(upto), F.lit(0))).drop("n_")
    # cells x values of key rows, whatever the number of documents
    out = df.withColumn("nth_", F.row_number().over(within) - 1).join(F.broadcast(base), [*key, "cell_"])
    return out.withColumn(name, (F.col("base_") + F.col("nth_")).cast("long")).drop("cell_", "base_", "nth_")


def place_heavy(sizes: list[tuple], room: list[int]) -> list[tuple]:
    """(group, low, high, shard) for (group, size), largest first; ``room`` is used up.

    A group goes whole into the tightest shard that takes it; else it fills the emptiest
    shards, so that it meets as few as possible. Ties go to the smaller group and shard.
    """
    plan = []
    for group, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        at = 0
        while at < size:
            left = size - at
            fits = [s for s in range(len(room)) if room[s] >= left]
            s = min(fits, key=lambda x: (room[x], x)) if fits else max(range(len(room)), key=lambda x: (room[x], -x))
            take = min(left, room[s])
            plan.append((group, at, at + take, s))
            room[s] -= take
            at += take
    return plan


def admit(flows: list[tuple[int, int, int, int]], held: list[int], quota: list[int]) -> list[tuple[int, int]]:
    """The (want, cell) units of (want, cell, from, n) that fit at once, departures credited.

    Starts with all of them and trims what overfills a shard, the smallest units first; a
    trimmed unit stays where it is, which may overfill its shard in turn. A shard that is too
    full without any arrival admits nobody.
    """
    units: dict[tuple[int, int], dict[int, int]] = {}
    load = list(held)
    for want, cell, source, n in flows:
        units.setdefault((want, cell), {})[source] = n
        load[want] += n
        load[source] -= n
    waiting = {s: sorted((u for u in units if u[0] == s), key=lambda u: (-sum(units[u].values()), u)) for s in range(len(quota))}
    over = [s for s in range(len(quota)) if load[s] > quota[s]]
    while over:
        s = over.pop()
        while load[s] > quota[s] and waiting[s]:
            gone = units.pop(waiting[s].pop())
            load[s] -= sum(gone.values())
            for source, n in gone.items():
                load[source] += n
                if load[source] > quota[source] and source not in over and waiting[source]:
                    over.append(source)
    return sorted(units)


def propagate(state: DataFrame, quota: list[int], rounds: int) -> DataFrame:
    """Label propagation over (k1, k2, start, shard, n): the n documents of a group that started
    in ``start`` and are in ``shard``. Ties between labels are decided by a hash that changes
    with the round; an empty table stays empty. Returns the table with its last labels.
    """
    spark = state.sparkSession
    state, _ = written(state, "labels")
    for turn in range(rounds):
        votes = state.groupBy(*KEY, "shard").agg(F.sum("n").alias("votes"))
        # a group that is in one shard has nothing to move
        torn = votes.groupBy(*KEY).agg(F.max_by("shard", F.struct("votes", F.xxhash64(*KEY, "shard", F.lit(turn)), "shard")).alias("want"), F.count("*").alias("labels"))
        moves = state.join(torn.where("labels > 1").select(*KEY, "want"), KEY, "left")
        moves = moves.withColumn("cell", F.pmod(F.xxhash64(*KEY, F.lit(turn)), F.lit(CELLS)).cast("int"))
        moves, _ = written(moves, "moves")
        held = [0] * len(quota)
        for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            held[r["shard"]] = r["n"]
        # at most shards * shards * CELLS rows
        flows = [tuple(r) for r in moves.where("want <> shard").groupBy("want", "cell", "shard").agg(F.sum("n").alias("n")).collect()]
        units = admit(flows, held, quota)
        if not units:
            break
        ok = F.broadcast(spark.createDataFrame(units, "want int, cell int").withColumn("ok", F.lit(True)))
        moved = moves.join(ok, ["want", "cell"], "left")
        state, _ = written(moved.select(*KEY, "start", F.when(F.col("ok"), F.col("want")).otherwise(F.col("shard")).alias("shard"), "n"), "labels")
    return state


def settle(state: DataFrame, quota: list[int]) -> DataFrame:
    """(k1, k2, shard) of the groups that end whole, from the last labels of :func:`propagate`.

    Cut groups and the smallest cells of overfull shards are lifted and dealt anew by size,
    the largest first. Groups that fit nowhere are left out.
    """
    spark = state.sparkSession
    groups = state.groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("shard").alias("shard"), F.max("shard").alias("last"))
    groups = groups.withColumn("cell", F.pmod(F.xxhash64(*KEY, F.lit(-1)), F.lit(CELLS)).cast("int"))
    groups, _ = written(groups, "groups")
    whole = groups.where("shard = last")
    room, lifted = list(quota), []
    by_shard: dict[int, list] = {}
    for r in whole.groupBy("shard", "cell").agg(F.sum("n").alias("n")).collect():  # shards * CELLS rows at most
        by_shard.setdefault(r["shard"], []).append((r["n"], r["cell"]))
    for s, cells in by_shard.items():
        excess = sum(n for n, _ in cells) - quota[s]
        for n, cell in sorted(cells):
            if excess > 0:
                lifted.append((s, cell))
                excess -= n
            else:
                room[s] -= n
    up = F.broadcast(spark.createDataFrame(lifted, "shard int, cell int"))
    stay = whole.join(up, ["shard", "cell"], "left_anti").select(*KEY, "shard")
    loose = groups.where("shard <> last").unionByName(whole.join(up, ["shard", "cell"], "left_semi")).select(*KEY, "n")
    loose, _ = written(dealt(loose, ["n"], KEY, "r"), "loose")
    # one row a size: at most the square root of twice the number of rows
    plan = []
    for size, count in sorted(((r["n"], r["c"]) for r in loose.groupBy("n").agg(F.count("*").alias("c")).collect()), reverse=True):
        at = 0
        for s in sorted(range(len(room)), key=lambda x: (-room[x], x)):
            take = min(count - at, room[s] // size)
            if take > 0:
                plan.append((size, at, at + take, s))
                room[s] -= take * size
                at += take
    plan = F.broadcast(spark.createDataFrame(plan, "n long, low long, high long, shard int"))
    return stay.unionByName(loose.join(plan, "n").where("low <= r and r < high").select(*KEY, "shard"))


@tidy
def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, rounds: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Documents of equal text are linked. The law is ``rows``: shard counts differ by one at
    most; ``slot`` is gapless from 0 within a shard; grown_shard is null. size is the UTF-8
    length of the text plus 1 (null text: 1, crc 0, linked with nothing). Repeated rows and
    null ids are dealt like any others, ties are decided by hashes and by the smaller shard;
    fewer rows than shards leave shards empty; an empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    binary = text.cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(binary), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("k1"),
        F.when(text.isNotNull(), F.xxhash64(F.lit(1), text)).alias("k2"),
        F.monotonically_increasing_id().alias("u_"),
    )
    rows, _ = written(rows, "rows")
    total = rows.count()
    share = [total // shards + (s < total % shards) for s in range(shards)]
    groups, _ = written(rows.where("k1 is not null").groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    limit = max(1, min(share) // HEAVY)

    # groups above the limit are few; they are labelled on the driver and numbered by distributed ranks
    large = groups.where(F.col("n") > limit)
    room = list(share)
    plan = [(*g, low, high, s) for g, low, high, s in place_heavy([((r["k1"], r["k2"]), r["n"]) for r in large.collect()], room)]
    plan = F.broadcast(spark.createDataFrame(plan, "k1 long, k2 long, low long, high long, shard int"))
    heavy = dealt(rows.join(F.broadcast(large.select(*KEY)), KEY).select(*KEY, "u_"), KEY, ["u_"], "r")
    heavy = heavy.join(plan, KEY).where("low <= r and r < high").select("u_", "shard")

    # the others start in shards dealt out by a hash in proportion to the rooms
    light = groups.where(F.col("n") <= limit)
    hot = F.col("n") >= max(2, total // HOT_KEYS)  # HOT_KEYS groups at most
    point = F.pmod(F.xxhash64("u_", F.lit(5)), F.lit(max(1, sum(room))))
    start, at = F.lit(shards - 1), sum(room)
    for s in reversed(range(1, shards)):
        at -= room[s]
        start = F.when(point < at, s - 1).otherwise(start)
    linked = rows.select(*KEY, "u_", start.cast("int").alias("start"))
    cells = linked.join(F.broadcast(light.where(hot).select(*KEY)), KEY).unionByName(linked.join(light.where(~hot).select(*KEY), KEY))
    cells = cells.groupBy(*KEY, "start").agg(F.count("*").alias("n")).withColumn("shard", F.col("start"))
    ends, _ = written(settle(propagate(cells, room, rounds), room).join(light, KEY), "ends")
    of = lambda part: rows.select(*KEY, "u_").join(part.select(*KEY, "shard"), KEY).select("u_", "shard")
    placed = heavy.unionByName(of(F.broadcast(ends.where(hot)))).unionByName(of(ends.where(~hot)))
    placed, _ = written(placed, "placed")

    held = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    ballast = rows.join(placed, "u_", "left_anti").select("u_", F.lit(0).alias("all_"))
    ballast = dealt(ballast, ["all_"], ["u_"], "nth")
    at, bounds = 0, []
    for s in range(shards):
        at += share[s] - held.get(s, 0)
        bounds.append(at)
    shard = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        shard = F.when(F.col("nth") < bounds[s], s).otherwise(shard)
    ballast = ballast.select("u_", shard.cast("int").alias("shard"))
    ended, _ = written(placed.unionByName(ballast), "ended")
    done = dealt(rows.join(ended, "u_").drop("k1", "k2"), ["shard"], ["u_"], "slot")
    return done.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
