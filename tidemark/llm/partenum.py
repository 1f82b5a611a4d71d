"""Exact n-gram Jaccard joins by PartEnum signatures.

Sets of similar sizes are in one band. A band deals the domain of 63-bit shingle hashes into ranges, the cells, three to
each first-level partition. Two sets whose Jaccard similarity reaches the threshold differ in so few elements that one
of sufficiently many partitions has at most one of them, and so two of its three cells are equal. All subsets of two of
three cells are enumerated, each subset's content (and its place) is a signature, and similar sets share one.

A cell is kept as the number of its elements and a hash of them. Cells that differ bound the number of elements that
differ from below, which tells most candidates from links without their texts; all others are compared on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components
from .near_dups import mix, shingles, verified

PERCENT, WORDS = 90, 3
#: Sets of a band differ in size by this factor at most.
WIDTH = 1.5
#: Elements that the two cells of a subset need for it to tell sets apart.
STRONG = 3
#: Members up to which the pairs of a list are made by a join; longer lists are compared block by block.
SMALL_LIST, BLOCK = 64, 1024
_CELLS = 3  # of a first-level partition; one of them may differ


def most_apart(a: int, b: int, percent: int = PERCENT) -> int:
    """The elements in which sets of a and b elements may differ at most: I >= p U means |A - B| + |B - A| <= (a + b) (1 - p) / (1 + p)."""
    return (a + b) * (100 - percent) // (100 + percent)


class Bands:
    """Sizes by bands: where each begins, and the partitions it has."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.begins = percent, [1]
        while most_apart(self.begins[0], self.begins[0] * 100 // percent, percent) == 0:
            self.begins[0] += 1  # smaller sets are similar to equal ones alone
        while self.begins[-1] < 1 << 40:
            self.begins.append(int(-(-self.begins[-1] * WIDTH // 1)))

    def of(self, n: int) -> int:
        """The band of a size; -1 for sets that are similar to equal ones alone."""
        return int(np.searchsorted(self.begins, n, side="right")) - 1

    def used(self, n: int, band: int) -> list[tuple[int, int]]:
        """(partitions that tell, how many more of them than one must be equal in two cells), for each size of a smaller partner.

        Each two elements that differ spoil one partition at most. The smaller set of a pair is of the band itself, and
        the pair's bound is that of its size; the last entry, of partners as large as the set, is what the set uses.
        """
        most = min(n, self.begins[band + 1] - 1)
        least = max(-(-n * self.percent // 100), self.begins[band])
        first, last = (most_apart(k, k * 100 // self.percent, self.percent) // 2 for k in (min(least, most), most))
        return [(spoilt + 1 + spare, spare) for spoilt in range(first, last + 1) for spare in [(spoilt + 3) // 6]]

    def partitions(self, band: int) -> int:
        return self.used(self.begins[band + 1] - 1, band)[-1][0]

    def joined(self, n: int) -> list[int]:
        """The bands that a set belongs to: its own, and the one below as a guest if smaller partners may be there."""
        own = self.of(n)
        return [] if own < 0 else [own] if own == 0 or -(-n * self.percent // 100) >= self.begins[own] else [own, own - 1]


@lru_cache(maxsize=8)
def bands(percent: int = PERCENT) -> Bands:
    return Bands(percent)


def cells(s: np.ndarray, count: int) -> np.ndarray:
    """A sorted set's cells: the number of elements (255 at most) in the top byte, a hash of them in the others."""
    edges = np.searchsorted(s, _edges(count))
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s + np.uint64(0x9E37)), dtype=np.uint64)))
    held = np.minimum(np.diff(edges), 255).astype(np.uint32)
    return held << np.uint32(24) | (mix(running[edges[1:]] - running[edges[:-1]]) >> np.uint64(40)).astype(np.uint32)


@lru_cache(maxsize=256)
def _edges(count: int) -> np.ndarray:
    return np.array([i * (1 << 63) // count for i in range(count + 1)], np.uint64)


def signatures(own: np.ndarray, n: int, band: int, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set in a band, from its cells there.

    Subsets of fewer than STRONG elements say little, and many sets share them. They are left out where, for each size
    that a smaller partner may have, no more partitions have one than the pair has to spare: then some partition whose
    subsets all tell is equal in two cells.
    """
    steps = bands(percent).used(n, band)
    use = steps[-1][0]
    held = own[: use * _CELLS].reshape(use, _CELLS).astype(np.uint64)
    counts = held >> np.uint64(24)
    place = np.arange(use, dtype=np.uint64) * np.uint64(_CELLS) + np.uint64(band << 40)
    out, weak = [], []
    for left in range(_CELLS):
        x, y = (i for i in range(_CELLS) if i != left)
        out.append(mix(mix(held[:, x] << np.uint64(32) | held[:, y]) + (place + np.uint64(left)) * np.uint64(0x9E3779B97F4A7C15)))
        weak.append(counts[:, x] + counts[:, y] < STRONG)
    out, weak = np.stack(out, 1), np.stack(weak, 1)
    some = np.cumsum(weak.any(axis=1))
    return (out[~weak] if all(some[k - 1] <= spare for k, spare in steps) else out.ravel()).astype(np.int64)


def least_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the elements that differ, for cells along the last axis.

    Cells with different numbers differ by as much at least; different cells with equal numbers in two elements.
    """
    ca, cb = (a >> np.uint32(24)).astype(np.int16), (b >> np.uint32(24)).astype(np.int16)
    other = np.abs(ca - cb)
    return (other + ((a != b) & (other == 0)) * np.where(ca < 255, 2, 1)).sum(axis=-1)


def sets_of(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, print (equal for equal sets), band, own and below: the set's cells in its band and, as a guest, below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rule = bands(percent)
        for batch in batches:
            n, prints, band, held = [], [], [], ([], [])
            for text in batch.column(1).to_pylist():
                s = shingles(text, words)
                joined = rule.joined(len(s))
                n.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                band.append(joined[0] if joined else -1)
                for i in range(2):
                    held[i].append(cells(s, rule.partitions(joined[i]) * _CELLS).tobytes() if i < len(joined) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(band, pa.int32()), *(pa.array(h, pa.binary()) for h in held)], ["doc_id", "n", "print", "band", "own", "below"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n long, print binary, band int, own binary, below binary")


def signed(classes: DataFrame, percent: int, full: bool) -> DataFrame:
    """Rows (sig) or, if ``full``, (sig, node, n, band, home): all signatures of the classes; band is the list's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sigs, band, home = [], [np.zeros(0, np.int64)], [], []
            sizes, own = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, row in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                for j, held in enumerate(row):
                    if held is not None:
                        new = signatures(np.frombuffer(held, np.uint32), sizes[i], own[i] - j, percent)
                        sigs.append(new)
                        at.append(np.full(len(new), i))
                        band.append(np.full(len(new), own[i] - j, np.int32))
                        home.append(np.full(len(new), j == 0))
            sig = pa.array(np.concatenate(sigs))
            if not full:
                yield pa.RecordBatch.from_arrays([sig], ["sig"])
                continue
            join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            at = pa.array(join(at, np.int64))
            yield pa.RecordBatch.from_arrays([sig, batch.column(0).take(at), batch.column(1).take(at), pa.array(join(band, np.int32)), pa.array(join(home, bool))], ["sig", "node", "n", "band", "home"])

    kind = classes.schema["node"].dataType.simpleString()
    rows = classes.where("own IS NOT NULL").select("node", "n", "band", "own", "below")
    return rows.mapInArrow(run, f"sig long, node {kind}, n long, band int, home boolean" if full else "sig long")


def close_in_size(a: Column | str, b: Column | str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that their cells allow to be links: (a, b, na, nb)."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("band").alias(f"band_{c}"), F.col("own").alias(f"own_{c}"), F.col("below").alias(f"below_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(close_in_size(F.col("na"), F.col("nb"), percent))
    low = F.least("band_a", "band_b")
    at = lambda c: F.when(F.col(f"band_{c}") == low, F.col(f"own_{c}")).when(F.col(f"band_{c}") == low + 1, F.col(f"below_{c}"))
    ready = both.select("a", "b", "na", "nb", at("a").alias("ca"), at("b").alias("cb")).where("ca IS NOT NULL AND cb IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = [int(least_apart(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32))) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (100 - percent)
            keep = pa.array(np.array(apart, np.int64) * (100 + percent) <= most)
            yield batch.select(["a", "b", "na", "nb"]).filter(keep)

    kind = pairs.schema["a"].dataType.simpleString()
    return ready.mapInArrow(run, f"a {kind}, b {kind}, na long, nb long")


def stars(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each list's members with the smallest one there of about their size."""
    sized = lists.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int"))
    low = sized.groupBy("sig", "size").agg(F.count("*").alias("m"), F.min("node").alias("a")).where("m > 1").select("sig", "size", "a")
    return sized.join(low, ["sig", "size"]).where("a <> node").select("a", F.col("node").alias("b")).distinct()


def across(lists: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) that share a signature, have different labels so far, and may be links by their cells.

    Of lists with the same members one is enough. Pairs of guests are left to their own band.
    """
    marked = lists.join(labels, "node", "left").select("sig", "node", "n", "band", "home", F.coalesce("label", "node").alias("label"))
    seen = marked.groupBy("sig").agg(F.count("*").alias("m"), F.max("home").alias("lived"), F.min("node").alias("first"), F.first("band").alias("of"), F.sum(F.xxhash64("node", "home").cast("decimal(20,0)")).alias("members"), F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = seen.where("lived AND low <> high").groupBy("of", "m", "first", "members").agg(F.min("sig").alias("sig")).select("sig", "m")
    rest = common.settle(marked.join(mixed, "sig"), "mixed-lists")
    few = rest.where(F.col("m") <= SMALL_LIST)
    side = lambda a: few.select("sig", *[F.col(c).alias(f"{c}_{a}") for c in ("node", "n", "label", "home")])
    met = side("a").join(side("b"), "sig").where("node_a < node_b AND label_a <> label_b AND (home_a OR home_b)")
    near = met.where(close_in_size(F.col("n_a"), F.col("n_b"), percent)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    found = possible(near, classes, percent).unionByName(blockwise(rest.where(F.col("m") > SMALL_LIST), classes, percent))
    out = common.settle(found, "across")
    common.discard(rest)
    common.freed(out.sparkSession)
    return out


def blockwise(long: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The same for long lists: members are dealt into blocks of bounded size, and each pair of blocks is one group."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = long.withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.join(classes.select("node", "n", F.col("own").alias("x"), F.col("below").alias("y")), ["node", "n"])
    dealt = dealt.withColumn("cells", F.when(F.col("home"), F.col("x")).otherwise(F.col("y")))
    placed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("sig", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "n", "label", "home", "cells")
    kind = long.schema["node"].dataType.simpleString()

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        part = table.column("part").to_numpy()
        one, two = (table, table) if i == j else (table.filter(pa.array(part == i)), table.filter(pa.array(part == j)))
        (na, la, ha), (nb, lb, hb) = ([t.column(c).to_numpy(zero_copy_only=False) for c in ("n", "label", "home")] for t in (one, two))
        ca, cb = (np.frombuffer(b"".join(t.column("cells").to_pylist()), np.uint32).reshape(t.num_rows, -1) for t in (one, two))
        x, y = [], []
        for row in range(one.num_rows):
            fine = (lb != la[row]) & (hb | ha[row]) & (np.minimum(nb, na[row]) * 100 >= np.maximum(nb, na[row]) * percent)
            if i == j:
                fine[: row + 1] = False
            at = np.flatnonzero(fine)
            at = at[least_apart(ca[row][None, :], cb[at]) * (100 + percent) <= (nb[at] + na[row]) * (100 - percent)]
            x.append(np.full(len(at), row))
            y.append(at)
        x, y = (pa.array(np.concatenate([np.zeros(0, np.int64), *v])) for v in (x, y))
        return pa.table({"a": one.column("node").take(x), "b": two.column("node").take(y), "na": one.column("n").take(x), "nb": two.column("n").take(y)})

    return placed.groupBy("sig", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}, na long, nb long").where("a <> b")


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, and component_id: the smallest id reachable by links.

    Links join documents with 100 * intersection >= percent * union of their shingle sets; no such pair escapes, and
    every link is confirmed on full sets. Null, empty and blank texts have the empty set and no link. Rows that repeat an
    id count as one document in the links and are returned each; rows with a null id link with nothing. No other column
    is read.

    Equal sets are one class. Signatures are counted first, by 8 bytes each and combined before they travel, and only
    shared ones are joined to their classes. Each list then links its members with its smallest one, and only lists
    whose members still have different labels are gone through pair by pair, across labels. No text or list goes to the
    driver.
    """
    spark = common.ready(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
    found = common.settle(sets_of(docs, words, percent, id_col, text_col), "sets")
    usable = found.where("n > 0 AND doc_id IS NOT NULL")
    classes = common.settle(usable.groupBy("print").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n", "band", "own", "below")]), "classes")
    rows = common.settle(found.select("doc_id", "n", "print"), "prints")
    common.discard(found)
    usable = rows.where("n > 0 AND doc_id IS NOT NULL")
    repeated = usable.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select(F.col("doc_id").alias("node"))
    same = []
    if not repeated.isEmpty():  # each text of such an id once; its classes are one
        some = common.handed(common.settle(repeated, "repeated"))
        source = source.join(some, "node", "left_anti").unionByName(source.join(some, "node", "left_semi").distinct())
        several = usable.select(F.col("doc_id").alias("id"), "print").join(some.withColumnRenamed("node", "id"), "id", "left_semi").distinct().join(classes.select("print", "node"), "print")
        low = several.groupBy("id").agg(F.min("node").alias("a"))
        same = [common.settle(several.join(low, "id").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "links")]
    shared = common.settle(signed(classes, percent, False).groupBy("sig").agg(F.count("*").alias("m")).where("m > 1").select("sig"), "shared")
    common.freed(spark)
    lists = common.settle(signed(classes, percent, True).join(common.handed(shared), "sig"), "lists")
    common.discard(shared)
    common.freed(spark)
    links = reduce(DataFrame.unionByName, same, verified(possible(stars(lists, percent), classes, percent), source, words, percent))
    labels = components(links)
    pairs = across(lists, labels, classes, percent)
    common.discard(lists)
    more = verified(pairs, source, words, percent)
    joined = components(links.unionByName(more))
    common.discard(links, more, labels, pairs)
    ids = usable.join(classes.select("print", "node"), "print").join(joined, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "node")).alias("component_id"))
    out = common.settle(rows.join(ids, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "jaccard-join")
    common.discard(rows, classes, joined)
    common.freed(spark)
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id")


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all documents whose sets of three-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_join(common.table(spark, sf_dir, "documents"))
