"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common
from .bpe import default_path, encode

CAPACITY = 2048
#: Pieces that a bucket of the ranking holds on average.
PER_BUCKET = 20_000


class Sizes:
    """A multiset of sizes by count; every operation is in the number of distinct sizes, never in the number of items."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.order.pop(bisect.bisect_left(self.order, size))

    def largest(self, most: int) -> int | None:
        i = bisect.bisect_right(self.order, most)
        return self.order[i - 1] if i else None

    def smallest(self, n: int) -> list[int]:
        """The n smallest items (fewer if there are fewer)."""
        out: list[int] = []
        for s in self.order:
            out += [s] * min(self.count[s], n - len(out))
            if len(out) == n:
                break
        return out

    def best_pair(self, most: int) -> int:
        """The largest sum of two items that is at most ``most``; 0 if no two fit."""
        best, i, j = 0, 0, len(self.order) - 1
        while i <= j:
            a, b = self.order[i], self.order[j]
            if a + b > most or i == j and self.count[a] < 2:
                j -= 1
            else:
                best = max(best, a + b)
                i += 1
        return best


def pack_sizes(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """Pack a multiset of sizes into bins.

    Returns slots (size, first rank, how many, first bin, offset): the items of that size with ranks first..first+how
    many-1 lie one each in as many consecutive bins, at that offset; then the number of bins, and of those fixed by
    dominance. Work and result depend on the number of distinct sizes (at most ``capacity``), not of items.

    The reduction takes the largest item x with room r beside it and fixes its bin for good when one set dominates
    every other feasible one: x alone if nothing fits; x and an item of exactly r; x and the largest item that fits, if
    no two others fit together, or if at most two fit and no two sum to more than that item. The rest is best-fit in
    decreasing order.
    """
    left, used, slots, bins = Sizes(counts), dict.fromkeys(counts, 0), [], 0

    def place(size: int, n: int, first_bin: int, offset: int) -> None:
        slots.append((size, used[size], n, first_bin, offset))
        used[size] += n

    rest: dict[int, int] = {}
    while left.order:
        x = left.order[-1]
        room, n = capacity - x, left.count[x]
        left.take(x, n)  # what stands beside x is looked for among the others
        y = left.largest(room)
        few = left.smallest(3)
        if room >= x and room == x:
            pairs = n // 2
            place(x, pairs, bins, 0)
            place(x, pairs, bins, x)
            bins, n = bins + pairs, n % 2
        elif room > x:  # others of the same size fit too: best-fit does these
            rest[x] = rest.get(x, 0) + n
            continue
        if not n:
            continue
        if y is None:
            place(x, n, bins, 0)
            bins += n
            continue
        exact = y == room
        lone = len(few) < 2 or few[0] + few[1] > room
        if exact or lone or (len(few) < 3 or sum(few) > room) and y >= left.best_pair(room):
            m = min(n, left.count[y])
            left.take(y, m)
            place(x, m, bins, 0)
            place(y, m, bins, x)
            bins += m
            if n > m:  # y ran out: look again
                left.count[x] = n - m
                left.order.append(x)
            continue
        rest[x] = rest.get(x, 0) + n
    fixed = bins
    rooms: dict[int, list[tuple[int, int]]] = {}  # by room: bins (first, how many)
    order: list[int] = []

    def free(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in rooms:
                bisect.insort(order, room)
            rooms.setdefault(room, []).append((first, n))

    for size in sorted(rest, reverse=True):
        n = rest[size]
        while n:
            i = bisect.bisect_left(order, size)
            if i == len(order):  # open new bins, each filled with this size as far as it goes
                each = capacity // size
                full, over = divmod(n, each)
                for k in range(each if full else 0):
                    place(size, full, bins, k * size)
                free(capacity - each * size, bins, full)
                bins += full
                for k in range(over):
                    place(size, 1, bins, k * size)
                if over:
                    free(capacity - over * size, bins, 1)
                    bins += 1
                n = 0
                continue
            room = order[i]
            first, have = rooms[room].pop()
            m = min(n, have)
            if have > m:
                rooms[room].append((first + m, have - m))
            elif not rooms[room]:
                del rooms[room]
                order.pop(i)
            place(size, m, first, capacity - room)
            free(room - size, first, m)
            n -= m
    return slots, bins, fixed


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise each text, add ``end_id`` and cut what is longer than ``capacity``: doc_id, piece, start, length, ids_crc32."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            keys, out = batch.column(0), ([], [], [], [], [])
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = memoryview((encode(text, path).tobytes() if text else b"") + end)
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for column, x in zip(out, (row, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", "doc_id")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all texts into as few sequences of at most ``capacity`` tokens as it can.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are the end
    id alone; repeated rows are packed each; an empty table gives no rows; other columns are not read.

    Pieces of one length are interchangeable, so only the count of each length (at most ``capacity`` numbers) goes to
    the driver, which packs the counts; each piece then finds its slot by its rank among those of its length. Ranks are
    taken within buckets of bounded size, whose totals give the buckets' starts, so no task sees all pieces of a
    frequent length.
    """
    spark = common.ready(docs.sparkSession)
    # equal rows, as those of one repeated or null id, are told apart by a number that is written with them
    numbered = cut(docs, path or default_path(), capacity, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    pieces = common.settle(numbered, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _, _ = pack_sizes(counts, capacity)
    buckets = max(1, sum(counts.values()) // PER_BUCKET)
    schema = T.StructType([T.StructField(x, T.LongType(), False) for x in ("length", "first_rank", "n", "first_bin", "offset")])
    lists = F.broadcast(  # at most `capacity` rows; a length's slots are few and ordered by rank
        spark.createDataFrame(slots, schema).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "first_bin", "offset"))).alias("slots"))
    )
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(buckets)).cast("int"))
    starts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("start_rank", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.select("length", "bucket", F.coalesce("start_rank", F.lit(0)).alias("start_rank"))
    ranked = keyed.withColumn("place", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "row")) - 1)
    ranked = ranked.join(starts, ["length", "bucket"]).withColumn("rank", F.col("start_rank") + F.col("place"))
    slot = F.element_at(F.filter("slots", lambda s: s["first_rank"] <= F.col("rank")), -1)
    placed = ranked.join(lists, "length").withColumn("slot", slot)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("slot.first_bin") + F.col("rank") - F.col("slot.first_rank")).alias("sequence_id"), F.col("slot.offset").alias("offset"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens of byte_bpe_50k.json."""
    return pack(common.table(spark, sf_dir, "documents"))
