"""Compression of vectors to codes: a codebook of up to 64 entries for each of 16 equal parts, in whole numbers.

Parts are assigned by exponion search: of a part whose entry was ``e`` in the round before, at distance u, only entries
within 2u of ``e`` can be as near. Each entry holds the others in the order of their distance from it, so these are the
beginning of its list; the list is gone through in stretches of doubling length, as far as the part's own radius goes.
All distances are squared whole numbers (the radius is 4 u^2), so no rounding can hide an entry; of equally near ones the
lowest index wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows that a task takes up at a time.
AT_ONCE = 16_384


def largest(dims: int) -> int:
    """The greatest component, after scaling, for which no squared distance of whole vectors can pass 63 bits."""
    return int((2**61 / max(1, dims)) ** 0.5)


def scaled(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, whole numbers): which vectors are kept, and their components as floor(256 x)."""
    lists = lists.cast(pa.list_(lists.type.value_type))
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == dims)
    values = lists.take(pa.array(right)).flatten()
    if values.null_count:
        values = values.fill_null(float("nan")) if pa.types.is_floating(values.type) else values.cast(pa.float64()).fill_null(float("nan"))
    x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(right), dims)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(x * SCALE)
        fine = (np.abs(x) <= largest(dims)).all(axis=1)  # False for what isn't finite
    return right[fine], x[fine].astype(np.int64)


class Codebook:
    """The entries of one part, and for each the others in the order of their distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of each row, from the entries it had before; and how many distances were computed."""
        k, looked = len(self.entries), len(x)
        far = ((x - self.entries[before]) ** 2).sum(axis=1)
        best, least = before.astype(np.int64), far.copy()
        reach = np.zeros(len(x), np.int64)  # how many of the entry's list lie within the radius
        order = np.argsort(before, kind="stable")
        edges = np.searchsorted(before[order], np.arange(k + 1))
        for e in range(k):
            own = order[edges[e] : edges[e + 1]]
            if not len(own):
                continue
            reach[own] = np.searchsorted(self.apart[e], 4 * far[own], side="right")
            start, step = 0, 2
            while len(own) and start < k:
                end = min(k, start + step)
                near = self.order[e, start:end]
                d = ((x[own][:, None, :] - self.entries[near][None, :, :]) ** 2).sum(axis=2)
                looked += d.size
                low = d.min(axis=1)
                index = np.where(d == low[:, None], near[None, :], k).min(axis=1)
                better = (low < least[own]) | ((low == least[own]) & (index < best[own]))
                best[own[better]], least[own[better]] = index[better], low[better]
                start, step = end, step * 2
                own = own[reach[own] > start]
        return best, least, looked


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of a task put together to tables of AT_ONCE rows or a little more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= AT_ONCE:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _rows(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def first_vectors(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> list:
    """The whole-number vectors of the ENTRIES smallest ids that are kept; of an id that repeats, the smallest vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict = {}
        for batch in batches:
            kept, x = scaled(batch.column(1), dims)
            for i, own in zip(batch.column(0).take(pa.array(kept)).to_pylist(), x.tolist(), strict=True):
                if i is not None and (i not in low or own < low[i]):
                    low[i] = own
            low = {i: low[i] for i in sorted(low)[:ENTRIES]}
        yield pa.RecordBatch.from_arrays([pa.array(list(low), kind), pa.array(list(low.values()), pa.list_(pa.int64()))], ["id", "x"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(vectors.schema[id_col].dataType)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"))
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<long>")
    return [r["x"] for r in found.groupBy("id").agg(F.min("x").alias("x")).orderBy("id").limit(ENTRIES).collect()]


def assigned(rows: DataFrame, books: np.ndarray, first: bool, last: bool, kinds: str) -> DataFrame:
    """Rows (id, label, x, code, error): parts assigned to the entries of ``books`` (part, entry, position).

    The first pass reads vectors and begins at entry 0; others read whole numbers and begin at the code before. The last
    pass leaves the numbers out. Only the codebooks go to the tasks, whose size is set by the vectors' length.
    """
    parts, entries, width = books.shape
    known = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Codebook(b) for b in known.value]
        for table in _held(batches):
            if first:
                kept, x = scaled(table.column("x").combine_chunks(), parts * width)
                table = table.take(pa.array(kept))
                before = np.zeros((len(x), parts), np.uint8)
            else:
                x = _rows(table.column("x"), np.int64, parts * width)
                before = _rows(table.column("code"), np.uint8, parts)
            code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, book in enumerate(held):
                code[:, p], far, _ = book.assign(x[:, p * width : (p + 1) * width], before[:, p])
                error += far
            columns = [table.column("id").combine_chunks(), table.column("label").combine_chunks(), *([] if last else [_binary(x)]), _binary(code), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", *([] if last else ["x"]), "code", "error"])

    return rows.mapInArrow(run, f"{kinds}, {'' if last else 'x binary, '}code binary, error long")


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries as the componentwise floor of their parts' means; entries without a part stay.

    Each task adds up its own rows, so as many rows as the codebooks have numbers come from it and are added by key.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for table in _held(batches):
            x, code = _rows(table.column("x"), np.int64, parts * width), _rows(table.column("code"), np.uint8, parts)
            for p in range(parts):
                at = code[:, p].astype(np.int64)
                order = np.argsort(at, kind="stable")
                found, begin = np.unique(at[order], return_index=True)
                total[p * entries + found] += np.add.reduceat(x[order, p * width : (p + 1) * width], begin, axis=0)
                count[p * entries + found] += np.diff(np.append(begin, len(order)))
        at = np.flatnonzero(count)
        cells = (at[:, None] * width + np.arange(width)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[at].ravel()), pa.array(np.repeat(count[at], width))], ["cell", "total", "n"])

    sums = rows.select("x", "code").mapInArrow(run, "cell int, total long, n long").groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    new = books.copy().reshape(-1)
    for r in sums.collect():  # one row a number of the codebooks at most
        new[r["cell"]] = int(r["total"]) // r["n"]
    return new.reshape(books.shape)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows (id, label, code binary, error), codebooks by part, entry and position).

    Vectors that are null, hold a null or a non-finite component, or whose length isn't that of the first kept id's are
    dropped, and so are those with a component so large (2^30.5 / sqrt(length) after scaling) that a squared distance
    might pass 64 bits. The length must be a multiple of 16. Rows that repeat an id are all coded; the codebooks start
    from distinct ids, of a repeated one from its smallest vector; rows without an id are coded, and start none. With
    fewer than 64 ids the codebooks are as much smaller; without any there are no rows. Other columns aren't read.
    """
    spark = common.ready(vectors.sparkSession)
    kinds = ", ".join(f"{new} {vectors.schema[c].dataType.simpleString()}" for new, c in (("id", id_col), ("label", label_col)))
    whole = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))
    one = whole.select(F.min(F.struct(F.col(id_col).alias("id"), F.size(vector_col).alias("n"))).alias("x")).first()["x"]
    if one is None:
        return vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.lit(None).cast("binary").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), np.zeros((PARTS, 0, 0), np.int64)
    dims = one["n"]
    if dims % PARTS:
        raise ValueError(f"vectors of {dims} components can't be cut into {PARTS} equal parts")
    start = np.array(first_vectors(vectors, dims, id_col, vector_col), np.int64).reshape(-1, PARTS, dims // PARTS)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    rows, held = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x")), None
    if not books.size:
        return rows.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), books
    for i in range(rounds):
        new = common.settle(assigned(rows, books, i == 0, False, kinds), "vector-codes")
        if held is not None:
            common.discard(held)
        rows = held = new
        books = moved(rows, books)
    out = common.settle(assigned(rows, books, rounds == 0, True, kinds), "vector-codes")
    if held is not None:
        common.discard(held)
    common.freed(spark)
    return out, books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, two hex digits a part, with their errors and those summed over equal labels."""
    rows, books = compress(common.table(spark, sf_dir, "embeddings"))
    total = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    found = rows.join(common.handed(total), F.col("label").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
