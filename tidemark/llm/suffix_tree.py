"""Language-model scores by a probabilistic suffix tree.

Symbols are all words, each by its hash, and the end of a text. A context (a suffix of what came before, of any length
up to a greatest one) is a state of the tree if it occurs often enough, by a count that doesn't depend on the corpus, and
its next-word distribution diverges from that of its longest retained suffix; a token is scored by the longest state that
fits. Contexts and what follows them are tables, which grow with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .language import fold
from .near_dups import _LOWER, _hashes, word_hashes

#: Occurrences from which a context is looked at, at any size of the corpus.
LEAST = 32
#: Words, states and pairs of this share of all training tokens are known to every task, at most 1 / share of them a depth.
HELD_SHARE = 2e-6
#: Contexts fall in 2 ** CELL_BITS cells.
CELL_BITS = 24
#: Cells of the filter of keys: 2 ** FILTER_BITS at most, 32 MB.
FILTER_BITS = 28
#: Parts of the documents that are scored one after the other, each part's keys being given back before the next.
SLICES = 5
#: Parts of the pairs, if all tokens are in one, that are counted one after the other, in a pass over the texts each; a part
#: is settled before the next. A depth whose contexts stand at fewer places has as many parts fewer.
PARTS = 2
#: Tokens for each bucket of pairs and of keys, and tokens that a task counts before it sends what it has counted.
PER_BUCKET, STRETCH = 2_000_000, 500_000
DEPTH = 3
#: Nats of divergence from which a context is retained, and the weight of its suffix's distribution in its own.
DIVERGENCE, WEIGHT = 0.02, 50.0
END = 0
#: The hash that stands for the end of a text, and the base of the contexts' polynomials.
FINAL, STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
#: How often a word must follow a context to be known there, in the query: what stands once is left to the suffix.
FOLLOW = 2
#: Texts that a task takes up at a time; their numbers fit in a byte.
PER_BATCH = 200
#: Bytes of texts that are hashed together.
TOGETHER = 1 << 16


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts, one text after the other, and how many words each text has.

    They are those of ``word_hashes``; texts are hashed together, a blank apart, as a call for each costs more than its words.
    """
    out, each, first = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64), 0
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(x) + 1 for x in data])
    while first < len(data):
        begin = ends[first] - len(data[first]) - 1
        last = max(first + 1, int(np.searchsorted(ends, begin + TOGETHER, "right")))
        if last == first + 1:  # it may be long
            out.append(word_hashes(texts[first] or ""))
            each[first] = len(out[-1])
        else:
            raw = np.frombuffer(b" ".join(data[first:last]).translate(_LOWER), np.uint8)
            out.append(_hashes(raw))
            word = raw != 32
            starts = np.flatnonzero(word & np.concatenate(([True], ~word[:-1]))[: len(raw)])
            each[first:last] = np.diff(np.searchsorted(starts, ends[first:last] - begin), prepend=0)
        first = last
    return np.concatenate(out), each


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (w, c): how often each word's hash stands in all texts, and under FINAL how often a text ends."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["w", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held += [words_of(batch.column(0).to_pylist())[0], np.full(batch.num_rows, FINAL, np.uint64)]
            size += len(held[-2]) + len(held[-1])
            if size >= 4 * STRETCH:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


@dataclass
class Tree:
    """A tree over few symbols, held whole (the query's own is in tables, see ``states``): sorted packed contexts, and for each a row of log10 probabilities; the root's row alone."""

    symbols: int
    root: np.ndarray
    keys: list[np.ndarray] = field(default_factory=list)
    rows: list[np.ndarray] = field(default_factory=list)

    def score(self, text: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """log10 of each symbol's probability after those before it; the first of each document only begins it."""
        out = self.root[text].astype(np.float64)
        packed = np.zeros(len(text), np.int64)
        for depth, (keys, rows) in enumerate(zip(self.keys, self.rows, strict=True), 1):
            at, packed = contexts(text, doc, depth, self.symbols, packed)
            if not len(keys):
                continue
            state = np.minimum(np.searchsorted(keys, packed[at]), len(keys) - 1)
            hit = keys[state] == packed[at]
            out[at[hit]] = rows[state[hit], text[at[hit]]]
        return out


def contexts(text: np.ndarray, doc: np.ndarray, depth: int, symbols: int, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places with ``depth`` symbols of their document before them, and every place's packed context of that depth."""
    if len(text) <= depth:
        return np.zeros(0, np.int64), shorter
    at = np.flatnonzero(doc[depth:] == doc[:-depth]) + depth
    packed = shorter.copy()
    packed[depth:] += text[:-depth] * symbols ** (depth - 1)
    return at, packed


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after the other as symbols, each with an END before and after, and each symbol's document."""
    arrays = [np.frombuffer(t, "<u2") for t in texts]
    doc = np.repeat(np.arange(len(arrays)), [len(a) + 2 for a in arrays])
    edge = np.zeros(1, np.uint16)
    return (np.concatenate([x for a in arrays for x in (edge, a, edge)]) if arrays else edge[:0]).astype(np.int64), doc


def next_counts(coded: DataFrame, keys: np.ndarray, depth: int, symbols: int) -> np.ndarray:
    """How often each symbol follows each of the contexts: contexts x symbols, of bounded size."""
    known = coded.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = known.value, np.zeros(len(known.value) * symbols, np.int64)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for first in range(0, len(rows), 500):
                text, doc = joined(rows[first : first + 500])
                packed = np.zeros(len(text), np.int64)
                at = np.zeros(0, np.int64)
                for d in range(1, depth + 1):
                    at, packed = contexts(text, doc, d, symbols, packed)
                state = np.minimum(np.searchsorted(keys, packed[at]), len(keys) - 1)
                hit = keys[state] == packed[at]
                found, n = np.unique(state[hit] * symbols + text[at[hit]], return_counts=True)
                counts[found] += n
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["key", "n"])

    total = coded.select("coded").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(keys) * symbols, np.int64)
    out[total["key"].to_numpy(np.int64)] = total["n"].to_numpy(np.int64)
    return out.reshape(len(keys), symbols)


def grow(coded: DataFrame, root_counts: np.ndarray, depth: int = DEPTH, share: float = 5e-4, divergence: float = DIVERGENCE, weight: float = WEIGHT) -> Tree:
    """Grow the tree depth by depth: only an extension of a frequent context can be frequent."""
    symbols, n = len(root_counts), int(root_counts.sum())
    root = (root_counts + 1) / (n + symbols)
    tree = Tree(symbols, np.log10(root).astype(np.float32))
    keys, least = np.flatnonzero(root_counts >= max(2, share * n)), max(2, share * n)
    parents: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(1, depth + 1):
        if not len(keys):
            break
        counts = next_counts(coded, keys, d, symbols)
        total = counts.sum(axis=1, keepdims=True)
        parent = np.tile(root, (len(keys), 1))
        for shorter, (found, rows) in enumerate(parents, 1):  # the longest retained suffix, as the last one found stays
            suffix = keys % symbols**shorter
            if len(found):
                at = np.minimum(np.searchsorted(found, suffix), len(found) - 1)
                hit = found[at] == suffix
                parent[hit] = rows[at[hit]]
        own = (counts + weight * parent) / (total + weight)
        kept = (own * np.log(own / parent)).sum(axis=1) >= divergence
        parents.append((keys[kept], own[kept]))
        tree.keys.append(keys[kept])
        tree.rows.append(np.log10(own[kept]).astype(np.float32))
        context, symbol = np.nonzero(counts >= least)
        inner = symbol != END  # nothing follows an end
        keys = np.sort(keys[context[inner]] * symbols + symbol[inner])
    return tree


def places(words: np.ndarray, each: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Documents of so many words each, one after the other, with FINAL before and after: the words, each word's document,
    and for each depth the places with so many words before them and their contexts.

    The context of the words a, b, c is a B^3 + b B^2 + c B, so that of a longer history follows from that of a shorter.
    """
    doc = np.repeat(np.arange(len(each)), each + 2)
    text = np.full(len(doc), FINAL, np.uint64)
    text[np.arange(len(words)) + 2 * np.repeat(np.arange(len(each)), each) + 1] = words
    out, packed, power = [], np.zeros(len(text), np.uint64), np.ones(1, np.uint64)
    for d in range(1, depth + 1):
        if len(text) <= d:
            break
        power = power * STEP
        packed[d:] += text[:-d] * power
        at = np.flatnonzero(doc[d:] == doc[:-d]) + d
        out.append((at, packed[at]))
    return text, doc, out


def cells(contexts: DataFrame) -> np.ndarray:
    """A bit for each cell, of a fixed number, that a context lies in: what isn't in one needn't be shuffled."""
    found = contexts.select(F.shiftrightunsigned("ctx", 64 - CELL_BITS).cast("int").alias("cell")).distinct().toArrow()
    out = np.zeros(1 << CELL_BITS, bool)
    out[found.column(0).to_numpy()] = True
    return np.packbits(out)


def order_of(keys: np.ndarray) -> np.ndarray:
    """The places of the keys in increasing order, equal ones by place: a plain sort with the places in the low bits."""
    bits = np.uint64(max(1, (len(keys) - 1).bit_length()))
    packed = (keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    found = keys[order]
    if (found[1:] < found[:-1]).any():  # some differ in their low bits alone
        order = order[np.argsort(found, kind="stable")]
    return order


def begins(ordered: np.ndarray) -> np.ndarray:
    """Where each different value of an ordered array begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))


def pair_counts(texts: DataFrame, contexts: DataFrame, depth: int, units: int, follow: int = 1, parts: int | None = None) -> list[DataFrame]:
    """Rows (ctx, w, n): how often each word follows each of the contexts, if ``follow`` times at least, and some others
    that share a cell with one. Each of the tables, PARTS if not given, has all of the pairs whose hash falls in it.

    What a task counts in a stretch of texts goes to each bucket in one row: its contexts, the number of pairs of each,
    and the pairs' words and counts. A pair's bucket comes from both of its parts, so frequent contexts are split.
    """
    known = texts.sparkSession.sparkContext.broadcast(cells(contexts))
    buckets, parts = max(32, units // PER_BUCKET), parts or PARTS

    def packed(ctx: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        order = order_of(ctx ^ w)
        first = begins((ctx ^ w)[order])
        n = np.diff(np.append(first, len(order))).astype("<u4")
        ctx, w = ctx[order[first]], w[order[first]]
        bucket = ((ctx ^ w) >> np.uint64(20)) % np.uint64(buckets)
        bits = np.uint64(buckets.bit_length())
        order = order_of((bucket << (np.uint64(64) - bits)) | (ctx >> bits))
        ctx, w, n, bucket = ctx[order], w[order], n[order], bucket[order]
        new = np.flatnonzero(np.concatenate(([True], (ctx[1:] != ctx[:-1]) | (bucket[1:] != bucket[:-1]))))
        each = np.diff(np.append(new, len(ctx))).astype("<u4")
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        at = np.searchsorted(new, edges)
        rows = [(ctx[new[i:j]].tobytes(), each[i:j].tobytes(), w[a:b].tobytes(), n[a:b].tobytes()) for a, b, i, j in zip(edges, edges[1:], at, at[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), *(pa.array(x, pa.binary()) for x in zip(*rows, strict=True))], ["bucket", "ctx", "each", "w", "n"])

    def run(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            text, _, found = places(*words_of(batch.column(0).to_pylist()), depth)
            if len(found) == depth:
                at, ctx = found[-1]
                w = text[at]
                some = np.flatnonzero((ctx ^ w) % np.uint64(parts) == part)
                some = some[filtered(known.value, ctx[some])]
                held.append((ctx[some], w[some]))
                size += len(held[-1][0])
            if size >= STRETCH:
                yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def merged(table: pa.Table) -> pa.Table:
        ctx, each, w, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("ctx", "<u8"), ("each", "<u4"), ("w", "<u8"), ("n", "<u4")))
        ctx = np.repeat(ctx, each)
        order = order_of(ctx ^ w)
        ctx, w, n = ctx[order], w[order], n[order].astype(np.int64)
        first = begins(ctx ^ w)
        total = np.add.reduceat(n, first)
        kept = total >= follow
        return pa.table({"ctx": ctx[first][kept].view(np.int64), "w": w[first][kept].view(np.int64), "n": total[kept]})

    sent = [texts.select("text").mapInArrow(partial(run, k), "bucket int, ctx binary, each binary, w binary, n binary") for k in range(parts)]
    return [x.groupBy("bucket").applyInArrow(merged, "ctx long, w long, n long") for x in sent]


def onward(pairs: DataFrame) -> DataFrame:
    """Rows (ctx, suffix, total): the contexts that frequent words after frequent contexts make; nothing follows an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ctx, suffix, w = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(((ctx + w) * STEP).view(np.int64)), pa.array(((suffix + w) * STEP).view(np.int64)), batch.column(3)], ["ctx", "suffix", "total"])

    return pairs.select("ctx", "suffix", "w", "n").mapInArrow(run, "ctx long, suffix long, total long")


def states(texts: DataFrame, vocabulary: DataFrame, units: int, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE, weight: float = WEIGHT, follow: int = 1) -> list[tuple[DataFrame, DataFrame]]:
    """The tree, depth by depth: tables of retained contexts (ctx, total, back) and of what follows them (key, n, gain).

    ``back`` is the log10 of the share that a word which isn't known to follow has in a state over its share in the
    state's suffix, and ``gain`` how much more it is for one that does follow. A context is looked at if it occurs
    ``least`` times, and a word follows it if it does so ``follow`` times; what rarer ones occur goes to the suffix's
    distribution, whose weight it adds to. Only an extension of a context of that count can be one, so each depth takes
    its contexts from the pairs of the one before.
    """
    spark = texts.sparkSession
    last = int(np.uint64(FINAL).view(np.int64))
    frequent = vocabulary.where(F.col("c") >= least).select(F.lit(0).cast("long").alias("ctx"), F.lit(0).cast("long").alias("suffix"), "w", F.col("c").alias("n"))
    contexts = common.settle(onward(frequent).withColumn("suffix", F.lit(0).cast("long")), "contexts")
    known = vocabulary.select(F.lit(0).cast("long").alias("suffix"), "w", ((F.col("c") + 1) / F.lit(float(units))).alias("parent"), "c")
    out: list[tuple[DataFrame, DataFrame]] = []
    before: list[DataFrame] = []
    own = (F.col("n") + F.col("left") * F.col("parent")) / (F.col("total") + weight)
    rest = F.col("left") / (F.col("total") + weight)
    for d in range(1, depth + 1):
        if contexts.isEmpty():
            break
        asked, parts = common.handed(contexts.select("ctx", "suffix")), []
        stands = contexts.agg(F.sum("total")).first()[0]  # what is sent to be counted, but for contexts that share a cell
        for part in pair_counts(texts, contexts, d, units, follow, max(1, math.ceil(PARTS * stands / units))):
            parts.append(common.settle(part.join(asked, "ctx"), "counted"))
            common.freed(spark)
        counted = reduce(DataFrame.unionByName, parts)
        often = F.broadcast(known.where(F.col("c") >= max(2.0, HELD_SHARE * units)).drop("c"))  # at most 1 / HELD_SHARE
        first = counted.join(often, ["suffix", "w"], "left")
        columns = ["ctx", "w", "n", "parent"]
        far = first.where("parent IS NULL").drop("parent").join(known.where(F.col("c") < max(2.0, HELD_SHARE * units)), ["suffix", "w"])
        pairs = common.settle(first.where("parent IS NOT NULL").select(columns).unionByName(far.select(columns)), "pairs")
        common.discard(counted, *before)
        common.freed(spark)
        sums = pairs.groupBy("ctx").agg(F.sum("n").alias("following")).join(common.handed(contexts.select("ctx", "total")), "ctx")
        sums = common.settle(sums.select("ctx", "total", (F.col("total") - F.col("following") + weight).alias("left")), "sums")
        seen = pairs.join(common.handed(sums), "ctx").groupBy("ctx").agg(F.first("total").alias("total"), F.first("left").alias("left"), F.sum(own * F.log(own / F.col("parent"))).alias("kl"), F.sum("parent").alias("mass"))
        unseen = rest * F.log(rest) * F.greatest(F.lit(0.0), 1 - F.col("mass"))
        kept = common.settle(seen.where(F.col("kl") + unseen >= divergence).select("ctx", "total", "left", F.log10(rest).alias("back")), "states")
        gains = pairs.join(common.handed(kept), "ctx").select(F.col("ctx").bitwiseXOR(F.col("w")).alias("key"), "n", (F.log10(own / F.col("parent")) - F.col("back")).alias("gain"))
        out.append((kept, common.settle(gains, "gains")))
        longer = pairs.where((F.col("n") >= least) & (F.col("w") != last)).join(common.handed(contexts.select("ctx", "suffix")), "ctx")
        longer = common.settle(onward(longer), "contexts")
        common.discard(contexts, sums)
        contexts = longer
        wanted = contexts.select(F.col("suffix").alias("ctx")).distinct()
        marked = pairs.join(common.handed(wanted), "ctx", "left_semi").join(common.handed(kept), "ctx", "left")
        known = marked.select(F.col("ctx").alias("suffix"), "w", F.when(F.col("back").isNull(), F.col("parent")).otherwise(own).alias("parent"), F.col("n").alias("c"))
        before = [pairs]
        common.freed(spark)
    common.discard(contexts, *before)
    return out


def planes(values: np.ndarray) -> bytes:
    """Numbers of eight bytes with the first bytes of all, then the second, and so on, so that bytes which hardly change
    compress; of integers, which are in order, the differences."""
    if values.dtype.kind == "u":
        values = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes, kind: str) -> np.ndarray:
    values = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=values.dtype) if values.dtype.kind == "u" else values


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key: ranges of their upper half, so that keys in order are in order of their buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def packed_keys(rows: DataFrame, word: bool, buckets: int, bits: int) -> DataFrame:
    """Rows (key, value) as one row for each bucket: the keys in order, their values, whether they are words, and which of
    2 ** ``bits`` cells they lie in, a bit each, from the byte ``first`` of all cells on."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            key, value = (np.concatenate(x) for x in zip(*held, strict=True))
            order = order_of(key)
            key, value = key[order], value[order]
            bucket = bucket_of(key, buckets)
            edges = np.append(begins(bucket), len(key))
            blobs = [[planes(x[a:b]) for a, b in zip(edges, edges[1:], strict=False)] for x in (key, value)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), *(pa.array(x, pa.binary()) for x in blobs)], ["bucket", "keys", "value"])

        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= STRETCH:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def merged(table: pa.Table) -> pa.Table:
        key, value = (np.concatenate([unpacked(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("keys", "<u8"), ("value", "<f8")))
        order = order_of(key)
        key, value = key[order], value[order]
        cell = (key >> np.uint64(64 - bits)).astype(np.int64)
        first = int(cell[0]) >> 3
        held = np.zeros(((int(cell[-1]) >> 3) - first + 1) * 8, bool)
        held[cell - first * 8] = True
        row = [table.column("bucket")[0].as_py(), planes(key), planes(value), word, first, np.packbits(held).tobytes()]
        return pa.table([pa.array([x], kind) for x, kind in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], ["bucket", "keys", "value", "word", "first", "cells"])

    sent = rows.select("key", "value").mapInArrow(spread, "bucket int, keys binary, value binary")
    return sent.groupBy("bucket").applyInArrow(merged, "bucket int, keys binary, value binary, word boolean, first long, cells binary")


def filtered(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys lie in a cell of the filter."""
    cell = keys >> np.uint64(64 - (len(bits).bit_length() + 2))
    return (bits[cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, follow: int = 1) -> DataFrame:
    """Score whole texts, learning from those for which the column ``held_out`` is not true.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10). Null and empty texts are one
    end; repeated rows are scored, and learned from, each; null ids aren't held out. Without training texts every token
    is unknown.

    A score is the base score and, for each state that fits a token, what it gives over its suffix. Words, states and
    pairs of at least HELD_SHARE / 4 of the tokens (at most 4 / HELD_SHARE of them a depth) go to every task. The other
    keys of a batch of texts travel to the tables that hold them, in one row for each bucket of keys, and only sums go
    back to the documents.
    """
    spark = common.ready(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = source.where("NOT held_out")
    vocabulary = common.settle(word_counts(training), "vocabulary")
    common.freed(spark)
    whole = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(whole["n"] or 0), int(whole["v"])
    often = max(2.0, HELD_SHARE * n / 4)
    last = int(np.uint64(FINAL).view(np.int64))
    ends = sum(r["c"] for r in vocabulary.where(F.col("w") == last).collect())
    unit, end_score = math.log10(n + v + 1), math.log10(ends + 1)
    tree = states(training, vocabulary, n + v + 1, least=least, follow=follow)

    # Rows (key, c, value): what a key adds to a text's score. Each table is given back when its keys are packed.
    rows = [(vocabulary.where(F.col("w") != last).select(F.col("w").alias("key"), "c", F.log10(F.col("c") + 1).alias("value")), [vocabulary])]
    for kept, gains in tree:
        states_of = kept.select(F.col("ctx").alias("key"), F.col("total").alias("c"), F.col("back").alias("value"))
        rows.append((states_of.unionByName(gains.select("key", F.col("n").alias("c"), F.col("gain").alias("value"))), [kept, gains]))
    # Eight cells a key for the filter of keys; what lies in no cell of it needn't be looked up.
    bits = min(FILTER_BITS, max(16, (8 * sum(x.count() for _, x in rows for x in x)).bit_length()))
    buckets = max(32, (n + v) // PER_BUCKET)
    retained = spark.sparkContext.broadcast([cells(kept) for kept, _ in tree])
    near, distant, known = [], [], np.zeros(1 << (bits - 3), np.uint8)
    for k, (table, sources) in enumerate(rows):
        near.append(table.where(F.col("c") >= often).select("key", "value").toArrow())
        distant.append(common.settle(packed_keys(table.where(F.col("c") < often), k == 0, buckets, bits), "keys"))
        common.discard(*sources)
        found = distant[-1].select("first", "cells").toArrow()
        for first, held in zip(found.column("first").to_pylist(), found.column("cells").to_pylist(), strict=True):
            known[first : first + len(held)] |= np.frombuffer(held, np.uint8)
        common.freed(spark)
    near = pa.concat_tables(near)
    keys = near.column("key").to_numpy().view(np.uint64)
    order = order_of(keys)
    near_table = spark.sparkContext.broadcast((keys[order], near.column("value").to_numpy()[order]))
    known_keys = spark.sparkContext.broadcast(known)
    kind = source.schema["doc_id"].dataType
    doc_type = to_arrow_type(kind)
    doc_columns = ["row", "doc_id", "held_out", "n_tokens", "base", "gain"]
    doc_types = [pa.int64(), doc_type, pa.bool_(), pa.int64(), pa.float64(), pa.float64()]
    sum_columns = ["far_known", "far", "far_gain"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, value = near_table.value
        close = np.zeros(1 << CELL_BITS, bool)
        close[keys >> np.uint64(64 - CELL_BITS)] = True
        close = np.packbits(close)
        row = TaskContext.get().partitionId() << 40
        for batch in (whole.slice(i, PER_BATCH) for whole in batches for i in range(0, whole.num_rows, PER_BATCH)):
            words, each = words_of(batch.column(2).to_pylist())
            text, doc, found = places(words, each, len(retained.value))
            doc, size = doc.astype(np.uint8), len(each)
            asked, docs = [words], [np.repeat(np.arange(size, dtype=np.uint8), each)]
            for known, (at, ctx) in zip(retained.value, found, strict=False):
                some = filtered(known, ctx)
                at, ctx = at[some], ctx[some]
                asked += [ctx, ctx ^ text[at]]
                docs += [doc[at]] * 2
            key, docs = np.concatenate(asked), np.concatenate(docs)
            order = order_of(key)
            key, docs, word = key[order], docs[order], order < len(words)  # keys of words came first
            first = begins(key)
            different = key[first]
            some = np.flatnonzero(filtered(close, different))  # none without keys
            found_at = np.minimum(np.searchsorted(keys, different[some]), max(0, len(keys) - 1))
            equal = keys[found_at] == different[some]
            at, hit = found_at[equal], np.zeros(len(different), bool)
            hit[some[equal]] = True
            times = np.diff(np.append(first, len(key)))
            near = np.repeat(hit, times)
            add, own = np.repeat(value[at], times[hit]), docs[near]
            word = word[near]
            near_n, base = np.bincount(own[word], minlength=size), np.bincount(own[word], add[word], size)
            gain = np.bincount(own[~word], add[~word], size)
            far = ~hit & filtered(known_keys.value, different)
            different, times, docs = different[far], times[far], docs[np.repeat(far, times)]
            bucket = bucket_of(different, buckets)
            edges = np.append(begins(bucket), len(bucket))
            ends = np.concatenate(([0], np.cumsum(times)))[edges]
            blobs = [(planes(different[a:b]), times[a:b].astype("<u4").tobytes(), docs[i:j].tobytes()) for a, b, i, j in zip(edges, edges[1:], ends, ends[1:], strict=False)]
            n_blobs = len(blobs)
            spread = (np.arange(row, row + size) % buckets).astype(np.int32)
            own = [np.arange(row, row + size), batch.column(0).cast(doc_type), batch.column(1), each + 1, base.astype(np.float64), gain.astype(np.float64)]
            nothing = [pa.nulls(n_blobs, t) for t in doc_types[1:]]
            columns = [pa.concat_arrays([pa.array(x) if isinstance(x, np.ndarray) else x, y]) for x, y in zip(own, [pa.array(np.full(n_blobs, row)), *nothing], strict=True)]
            columns += [pa.array(np.concatenate((near_n, np.zeros(n_blobs, np.int64)))), pa.array(np.concatenate((spread, bucket[edges[:-1]])))]
            columns += [pa.concat_arrays([pa.nulls(size, pa.binary()), pa.array([x[i] for x in blobs], pa.binary())]) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, [*doc_columns, "near_n", "bucket", "keys", "times", "docs"])
            row += size

    def weigh(sent: pa.Table, table: pa.Table) -> pa.Table:
        own = sent.filter(pc.is_null(sent.column("keys")))
        sent = sent.filter(pc.is_valid(sent.column("keys")))
        out = pa.table([*(own.column(c) for c in doc_columns), own.column("near_n"), *(pa.array(np.zeros(own.num_rows)) for _ in range(2))], [*doc_columns, *sum_columns])
        if not sent.num_rows or not table.num_rows:
            return out
        runs = table.column("keys").to_pylist()
        held, value = (np.concatenate([unpacked(x, kind) for x in xs]) for xs, kind in ((runs, "<u8"), (table.column("value").to_pylist(), "<f8")))
        word = np.repeat(table.column("word").to_numpy(zero_copy_only=False).astype(bool), [len(x) // 8 for x in runs])
        order = order_of(held)
        held, value, word = held[order], value[order], word[order]
        blobs = sent.column("keys").to_pylist()
        key = np.concatenate([unpacked(x, "<u8") for x in blobs])
        times, docs = (np.frombuffer(b"".join(sent.column(c).to_pylist()), kind) for c, kind in (("times", "<u4"), ("docs", "u1")))
        first = np.repeat(sent.column("row").to_numpy(), [len(b) // 8 for b in blobs])
        order = order_of(key)
        at = np.empty(len(key), np.int64)
        at[order] = np.minimum(np.searchsorted(held, key[order]), len(held) - 1)
        hit = held[at] == key
        row = (np.repeat(first, times) + docs)[np.repeat(hit, times)].astype(np.uint64)
        at = np.repeat(at[hit], times[hit])
        order = order_of(row)
        row, at = row[order], at[order]
        new = begins(row)
        if not len(new):
            return out
        sums = [np.add.reduceat(weights, new) for weights in (word[at].astype(np.int64), np.where(word[at], value[at], 0.0), np.where(word[at], 0.0, value[at]))]
        nothing = [pa.nulls(len(new), t) for t in doc_types[1:]]
        return pa.concat_tables([out, pa.table([pa.array(row[new].astype(np.int64)), *nothing, *map(pa.array, sums)], out.column_names)])

    plain = f"row long, doc_id {kind.simpleString()}, held_out boolean, n_tokens long, base double, gain double"
    lookup = reduce(DataFrame.unionByName, distant).select("bucket", "keys", "value", "word")
    one = lambda c: F.max(c).alias(c)  # noqa: E731  only one of a document's rows has it
    scored = []
    for k in range(SLICES):
        some = source.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLICES)) == k).select("doc_id", "held_out", "text")
        sent = some.mapInArrow(encode, f"{plain}, near_n long, bucket int, keys binary, times binary, docs binary")
        weighed = sent.groupBy("bucket").cogroup(lookup.groupBy("bucket")).applyInArrow(weigh, f"{plain}, far_known long, far double, far_gain double")
        scored.append(common.settle(weighed.groupBy("row").agg(*map(one, doc_columns[1:]), *[F.sum(c).alias(c) for c in sum_columns]), "scores"))
        common.freed(spark)
    sums = reduce(DataFrame.unionByName, scored)
    common.discard(*distant)
    base = F.col("base") + F.col("far") + F.lit(end_score) - F.col("n_tokens") * F.lit(unit)
    return sums.select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("far_known") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("gain") + F.col("far_gain")).alias("score"),
    )


def op4_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those outside fold 2 of 7."""
    return score_texts(common.table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2, follow=FOLLOW)
