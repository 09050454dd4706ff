"""Best-fit sequence packing by minimum bin slack.

1. One pass tokenises whole texts, each distinct chunk of a batch once, and cuts the few that are longer than a sequence.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the corpus
   size) goes to the driver. There each bin is opened with the longest piece left, and a
   bitset subset-sum over all available lengths finds the fullest way to complete it. The
   same filling is used as often as the histogram allows, so the plan stays small.
3. Pieces of one length are interchangeable: a distributed rank among them looks up
   sequence and offset in the plan.
"""

from __future__ import annotations

import base64
from collections import Counter
import json
from functools import lru_cache, partial
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrelix.llm.scratch import tidy, written
from kestrelix.llm.textops import pieces, release, span_hashes, text_buffer

BROADCAST_ROWS = 2_000_000  # of 20 bytes: at most 40 MB
PIECE = 2 << 20  # bytes of text whose chunks are encoded together


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Minimum bin slack over a histogram of lengths: (how often, {length: pieces})."""
    left = Counter({n: c for n, c in histogram.items() if c > 0})
    plan = []
    while left:
        first = max(left)
        left[first] -= 1
        room = capacity - first
        lengths = sorted((n for n, c in left.items() if c > 0 and n <= room), reverse=True)
        reach, states = 1, []
        full = 1 << room
        for n in lengths:
            states.append(reach)
            count, step = min(left[n], room // n), 1
            while count > 0:
                step = min(step, count)
                reach |= reach << (n * step)
                count -= step
                step *= 2
            reach &= (full << 1) - 1
            if reach & full:
                break
        at = reach.bit_length() - 1
        filling = Counter({first: 1})
        for n, before in zip(reversed(lengths[: len(states)]), reversed(states)):
            while not before >> at & 1:
                filling[n] += 1
                at -= n
        left[first] += 1
        times = min(left[n] // c for n, c in filling.items())
        for n, c in filling.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
        plan.append((times, dict(filling)))
    return plan


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


#: last bytes of white space beyond ASCII, in UTF-8
_WIDE_LAST = np.zeros(256, bool)
_WIDE_LAST[[0x85, 0xA0, 0x9F, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)]] = True
_WIDE_FIRST = np.zeros(256, bool)
_WIDE_FIRST[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


class ChunkTokenizer:
    """Ids of whole texts.

    A text is first cut at the vocabulary's added tokens (``added``: string to id), each of
    which is one id. No other token crosses a blank that has no white space beside it, so texts
    are cut there into chunks, and each distinct chunk of a batch is encoded once: all of them
    in one string, whose ids are dealt back by the bytes they stand for. Texts with an added
    token, or with other white space beside a blank, are encoded one by one.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None):
        encoding, self.bytes_of = _encoder(ranks_path, pattern)
        self.encode = encoding.encode_ordinary
        self.added = {t: np.array([i], np.uint32) for t, i in (added or {}).items()}
        longest_first = sorted(self.added, key=lambda t: (-len(t), t))
        self.cuts = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None

    def ids(self, text: str) -> np.ndarray:
        """One text, encoded in one go but for the added tokens."""
        if self.cuts is None or not self.cuts.search(text):
            return np.array(self.encode(text), np.uint32)
        parts = [self.added[x] if x in self.added else np.array(self.encode(x), np.uint32) for x in self.cuts.split(text) if x]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def _alone(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Marks the texts that are encoded one by one."""
        n = len(buf)
        blank = np.flatnonzero(buf == 32)
        before, after = buf[np.maximum(blank - 1, 0)], buf[np.minimum(blank + 1, n - 1)]
        owner = np.searchsorted(offsets, blank, "right") - 1
        inner = (_SPACE[before] | _WIDE_LAST[before]) & (blank > offsets[owner])
        outer = (_SPACE[after] | _WIDE_FIRST[after]) & (blank + 1 < offsets[owner + 1])
        alone = np.zeros(len(offsets) - 1, bool)
        alone[owner[inner | outer]] = True
        whole = buf.tobytes()
        for token in self.added:
            at = whole.find(token.encode())
            while at >= 0:
                alone[np.searchsorted(offsets, at, "right") - 1] = True
                at = whole.find(token.encode(), at + 1)
        return alone

    def _pool(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the given chunks, and for each its place among them and how many it has."""
        # a chunk without a blank in front, or with white space behind, would join its neighbours
        last, length = buf[end - 1], end - start
        plain = (buf[start] == 32) & (length > 1) & ~_SPACE[last] & ~_WIDE_LAST[last]
        sizes, place, flat = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.zeros(0, np.uint32)
        joined = np.flatnonzero(plain)
        if len(joined):
            n = length[joined]
            ends = np.cumsum(n)
            joint = buf[np.repeat(start[joined] - (ends - n), n) + np.arange(ends[-1])]
            flat = np.array(self.encode(joint.tobytes().decode()), np.uint32)
            reach = np.cumsum(self.bytes_of[flat])
            at = np.searchsorted(reach, ends)
            if at[-1] < len(reach) and (reach[at] == ends).all():
                place[joined] = np.concatenate([[0], at[:-1] + 1])
                sizes[joined] = at + 1 - place[joined]
            else:  # a token across two chunks: never seen, and each is encoded for itself
                plain[:], flat = False, np.zeros(0, np.uint32)
        parts, total = [flat], len(flat)
        for i in np.flatnonzero(~plain).tolist():
            parts.append(np.array(self.encode(buf[start[i] : end[i]].tobytes().decode()), np.uint32))
            sizes[i], place[i] = len(parts[-1]), total
            total += len(parts[-1])
        return np.concatenate(parts), place, sizes

    def batch(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and n + 1 bounds; null counts as empty."""
        buf, offsets = text_buffer(column)
        n = len(offsets) - 1
        alone = self._alone(buf, offsets) if len(buf) else np.zeros(n, bool)
        blank = np.flatnonzero(buf == 32)
        blank = blank[~alone[np.searchsorted(offsets, blank, "right") - 1]] if len(blank) else blank
        filled = np.flatnonzero(np.diff(offsets) > 0)
        start = np.sort(np.concatenate([offsets[filled], blank]))  # a text that stands alone is one chunk
        start = start[np.concatenate([[True], start[1:] != start[:-1]])] if len(start) else start
        owner = np.searchsorted(offsets, start, "right") - 1
        end = np.minimum(np.append(start[1:], len(buf)), offsets[owner + 1])
        one, two = span_hashes(buf, start, end)
        _, first, entry = np.unique(one, return_index=True, return_inverse=True)
        lone = alone[owner[first]]
        if not (two == two[first][entry]).all():  # two chunks of one hash: each for itself
            first, entry = np.arange(len(start)), np.arange(len(start))
            lone = alone[owner]
        usual, whole = np.flatnonzero(~lone), np.flatnonzero(lone)
        ids, at, length = self._pool(buf, start[first[usual]], end[first[usual]])
        extra = [self.ids(buf[a:b].tobytes().decode()) for a, b in zip(start[first[whole]].tolist(), end[first[whole]].tolist())]
        pool = np.concatenate([ids, *extra, np.array([end_id], np.uint32)])
        sizes, place = np.zeros(len(first) + 1, np.int64), np.zeros(len(first) + 1, np.int64)
        sizes[usual], place[usual] = length, at
        sizes[whole] = [len(x) for x in extra]
        place[whole] = len(ids) + np.cumsum(sizes[whole]) - sizes[whole]
        sizes[-1], place[-1] = 1, len(pool) - 1
        # after the chunks of each text its end
        order = np.argsort(np.concatenate([2 * owner, 2 * np.arange(n) + 1]), kind="stable")
        entry = np.concatenate([entry, np.full(n, len(first))])[order]
        length = sizes[entry]
        total = np.cumsum(length)
        at = np.repeat(place[entry] - (total - length), length) + np.arange(total[-1] if len(total) else 0)
        ends = total[order >= len(start)]
        return pool[at], np.concatenate([[0], ends])


def _tokenise(batches, ranks_path: str, pattern: str, added: dict[str, int], end_id: int, capacity: int):
    tok = ChunkTokenizer(ranks_path, pattern, added)
    part = TaskContext.get().partitionId()
    seen: Counter = Counter()
    for whole in batches:
        for batch in pieces(whole, "text", PIECE):
            ids, bound = tok.batch(batch.column("text"), end_id)
            cols = ([], [], [], [], [], [])
            for doc, low, high in zip(batch.column("doc_id").to_pylist(), bound[:-1].tolist(), bound[1:].tolist()):
                n = high - low
                stop = n % capacity or min(n, capacity)
                start = piece = 0
                while start < n:
                    size = stop - start
                    for c, x in zip(cols, (doc, piece, start, size, ids[low + start : low + stop].tobytes(), seen[size])):
                        c.append(x)
                    seen[size] += 1
                    start, stop, piece = stop, stop + capacity, piece + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cols[0], batch.schema.field("doc_id").type),
                    pa.array(cols[1], pa.int32()),
                    pa.array(cols[2], pa.int64()),
                    pa.array(cols[3], pa.int64()),
                    pa.array(cols[4], pa.binary()),
                    pa.array(cols[5], pa.int64()),
                    pa.array([part] * len(cols[0]), pa.int32()),
                ],
                names=["doc_id", "piece", "start", "length", "ids", "nth", "part"],
            )
    release()


@tidy
def pack_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    added: dict[str, int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    One row a piece: doc_id, piece, start, length, ids (little-endian uint32 bytes),
    sequence_id, offset. A null text counts as empty, so every row yields its end id. A
    longer document is cut into full pieces, the first of which may be shorter. The strings of
    ``added`` (none if not given) become their ids wherever a text holds them. Repeated
    rows and null ids are packed like any others; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    cut = rows.mapInArrow(
        partial(_tokenise, ranks_path=ranks_path, pattern=pattern, added=added or {}, end_id=end_id, capacity=capacity),
        f"doc_id {kind}, piece int, start long, length long, ids binary, nth long, part int",
    )
    table, _ = written(cut, "pieces")

    # rank of a piece among those of its length: its place in its part after all parts before
    parts, _ = written(table.groupBy("part", "length").agg(F.count("*").alias("n")), "parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    sequence, segments = 0, []
    used: Counter = Counter()
    for times, filling in plan_bins(histogram, capacity):
        offset = 0
        for n, c in sorted(filling.items(), reverse=True):
            segments.append((n, used[n], used[n] + times * c, c, sequence, offset))
            used[n] += times * c
            offset += n * c
        sequence += times
    plan = spark.createDataFrame(segments, "length long, low long, high long, each long, first long, at long")

    small = parts.count() <= BROADCAST_ROWS
    base = parts.select("part", "length", "base")
    ranked = table.join(F.broadcast(base) if small else base, ["part", "length"]).withColumn("r", F.col("base") + F.col("nth"))
    # the plan has at most a few rows for each possible filling of one sequence
    placed = ranked.join(F.broadcast(plan), ["length"]).where("low <= r and r < high")
    nth = F.col("r") - F.col("low")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids",
        (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (nth % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def default_vocabulary() -> tuple[str, str, dict[str, int]]:
    """The 50k byte-level vocabulary: path of its ranks, word pattern, and added tokens of its JSON."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added


def packed_digest(docs: DataFrame) -> DataFrame:
    packed = pack_documents(docs, *default_vocabulary())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
