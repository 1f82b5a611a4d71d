"""Phrase collocations by position bitmaps: shift, AND and population counts extend phrases within shards of text.

Texts of a language are laid out in shards of bounded size, a position a word and an empty position after each piece, so
a shift by one never leads from one piece into another. A shard keeps a bitmap of positions for each word, compressed to
the 64-bit blocks that aren't zero. A phrase's bitmap marks where its last word stands: shifted by one and ANDed with a
word's it gives the longer phrase's, whose bits are counted. Shards are gone through subtree by subtree of first words,
depth-first; counts are summed over shards between the lengths, so that only phrases which are frequent everywhere are
extended, by words that frequently follow their last one.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

LEAST, MOST_WORDS, TOP, SCALE, SHARE = 10, 3, 2000, 1_000_000, 50
#: Positions of a shard, and of all shards that a task has open.
SHARD, OPEN = 1 << 20, 1 << 22
#: Blocks of bitmaps that are extended at a time.
SUBTREE = 1 << 18
#: Numbers that may go to every task (16 MB); beyond, they are joined to their shards.
HELD = 1 << 21

_TABLE = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BLOCK = 32  # bits of a block's number in a bitmap's key


@contextmanager
def few_at_once(spark: SparkSession, rows: int = 2):
    """Shards are large rows: a Python worker takes up few of them at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shards(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Rows (shard, lang, words, counts, places): places holds for each position the word's number from 1, or 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held = TaskContext.get().partitionId() << 24, 0, {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal made
            known, places = held.pop(lang)
            numbers = np.frombuffer(places, np.int32)
            counts = np.bincount(numbers, minlength=len(known) + 1)[1:]
            made += 1
            one = lambda x, kind: pa.array([x], kind)
            return pa.RecordBatch.from_arrays([pa.array([first + made]), pa.array([lang]), one([w.decode("utf-8", "replace") for w in known], pa.list_(pa.string())), one(counts.tolist(), pa.list_(pa.int64())), one(numbers.tobytes(), pa.binary())], ["shard", "lang", "words", "counts", "places"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in text.encode("utf-8", "replace").translate(_TABLE).split(b"\n") if text else ():
                    words = piece.split()
                    if not words:
                        continue
                    if lang not in held:
                        held[lang] = ({}, array("i"))
                    known, places = held[lang]
                    places.extend([known.setdefault(w, len(known) + 1) for w in words])
                    places.append(0)
                    if len(places) >= SHARD:
                        yield close(lang)
            while sum(len(p) for _, p in held.values()) > OPEN:
                yield close(max(held, key=lambda x: len(held[x][1])))
        for lang in list(held):
            yield close(lang)

    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "shard long, lang string, words array<string>, counts array<long>, places binary")


class Bitmaps:
    """The compressed bitmaps of a shard: blocks (word, number) in order, each with a mask of 64 positions."""

    def __init__(self, places: np.ndarray):
        self.places = np.concatenate((places, np.zeros(130, places.dtype)))
        at = np.flatnonzero(places)
        at = at[np.argsort(places[at], kind="stable")]
        keys = self.places[at].astype(np.uint64)
        keys <<= np.uint64(_BLOCK)
        keys |= (at >> 6).astype(np.uint64)
        new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        self.keys = keys[start]
        self.masks = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), start) if len(start) else np.zeros(0, np.uint64)
        self.block_of = np.zeros(len(self.places), np.int32)
        self.block_of[at] = np.cumsum(new, dtype=np.int32) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, block, mask) of all words."""
        return self.keys >> np.uint64(_BLOCK), self.keys & np.uint64((1 << _BLOCK) - 1), self.masks

    def extend(self, prefix: np.ndarray, block: np.ndarray, mask: np.ndarray, open_: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(prefix, word, block, mask) of all phrases of one word more.

        ``prefix``, ``block`` and ``mask`` are blocks of phrases' bitmaps. These are shifted by one, a block's last bit into
        the next block. The words to AND with are read where bits stand; ``open_`` has the positions that may end a phrase.
        """
        one, last = np.uint64(1), np.uint64(63)
        carried = np.flatnonzero(mask >> last)
        prefix, block = np.concatenate((prefix, prefix[carried])), np.concatenate((block, block[carried] + one))
        mask = np.concatenate((mask << one, mask[carried] >> last))
        if open_ is not None:
            mask = mask & open_[block.astype(np.int64)]
        out, left, entry = [], mask.copy(), np.flatnonzero(mask)
        left = left[entry]
        while len(entry):
            bit = left & (~left + one)
            at = (block[entry] << np.uint64(6) | np.bitwise_count(bit - one)).astype(np.int64)
            found = self.places[at] != 0
            own, at_bit = entry[found], bit[found]
            both = mask[own] & self.masks[self.block_of[at[found]]]
            first = both & (~both + one) == at_bit  # each word of an entry once
            out.append((prefix[own[first]], self.places[at[found][first]].astype(np.uint64), block[own[first]], both[first]))
            left = left & ~bit
            more = np.flatnonzero(left)
            entry, left = entry[more], left[more]
        return tuple(np.concatenate([np.zeros(0, np.uint64), *x]) for x in (zip(*out, strict=True) if out else [()] * 4))


def summed(keys: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the bits of its masks."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(np.bitwise_count(masks[order]).astype(np.int64), start) if len(start) else np.zeros(0, np.int64)


def subtrees(held: Bitmaps) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The words' bitmaps, so many blocks at a time that whole words are together."""
    word, block, mask = held.words()
    start = 0
    while start < len(word):
        end = min(len(word), start + SUBTREE)
        if end < len(word):
            begin = int(np.searchsorted(word, word[end]))
            end = begin if begin > start else int(np.searchsorted(word, word[end], side="right"))
        yield word[start:end], block[start:end], mask[start:end]
        start = end


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first << np.uint64(32) | second


def pairs_of(places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair, count) of the phrases of two words, subtree by subtree."""
    held = Bitmaps(places)
    for word, block, mask in subtrees(held):
        first, second, _, both = held.extend(word, block, mask)
        yield summed(pair_key(first, second), both)


def triples_of(places: np.ndarray, frequent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, third word, count) of the phrases of three words whose first and last two are frequent (in order)."""
    held = Bitmaps(places)
    if not len(held.keys) or not len(frequent):
        return
    grown, open_ = [], np.zeros(len(held.places) // 64 + 2, np.uint64)
    for word, block, mask in subtrees(held):
        first, second, block, both = held.extend(word, block, mask)
        keys = pair_key(first, second)
        order = np.argsort(keys, kind="stable")
        distinct, index = np.unique(keys[order], return_inverse=True)
        known = frequent[np.minimum(np.searchsorted(frequent, distinct), len(frequent) - 1)] == distinct
        keep = order[known[index]]
        grown.append((keys[keep], block[keep], both[keep]))
        np.bitwise_or.at(open_, block[keep].astype(np.int64), both[keep])
    for keys, block, mask in grown:
        pair, third, _, both = held.extend(keys, block, mask, open_)
        order = np.lexsort((third, pair))
        pair, third = pair[order], third[order]
        new = np.append(True, (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])) if len(pair) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        if len(start):
            yield pair[start], third[start], np.add.reduceat(np.bitwise_count(both[order]).astype(np.int64), start)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """The rows with an ``id`` from 1, below their number times the unevenness of their partitions; written, so that it stays."""
    held = common.settle(rows, name)
    parts, at = held.rdd.getNumPartitions(), F.monotonically_increasing_id()
    out = common.settle(held.withColumn("id", at.bitwiseAND((1 << 33) - 1) * parts + F.shiftright(at, 33) + 1), name)
    common.discard(held)
    if (out.agg(F.max("id").alias("x")).first()["x"] or 0) >= 1 << 31:
        raise ValueError("more frequent words than numbers for them")
    return out


def coded(laid: DataFrame, words: DataFrame, lang: str = "lang") -> DataFrame:
    """Rows (shard, places) with the frequent words' ids at their positions, and 0 where no frequent one stands."""
    vocabulary = laid.select("shard", lang, F.posexplode("words").alias("at", "word"))
    own = vocabulary.join(words.select(lang, "word", "id"), [lang, "word"]).groupBy("shard").agg(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), "id")).alias("ids"))
    ids = common.settle(own, "word-ids")
    small = (ids.agg(F.sum(2 * F.size("ids"))).first()[0] or 0) <= HELD
    both = laid.select("shard", "places").join(F.broadcast(ids) if small else ids, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places, own in zip(batch.column(1), batch.column(2), strict=True):
                places, own = np.frombuffer(places.as_buffer(), np.int32), own.values
                to = np.zeros(max(int(places.max(initial=0)), 0) + 1, np.uint32)
                to[own.field("at").to_numpy() + 1] = own.field("id").to_numpy()
                out.append(to[places].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["shard", "places"])

    with few_at_once(laid.sparkSession):
        out = common.settle(both.select("shard", "places", "ids").mapInArrow(run, "shard long, places binary"), "coded")
    common.discard(ids)
    return out


def _places(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for places in batch.column(1):
        yield np.frombuffer(places.as_buffer(), np.uint32)


def frequent_pairs(laid: DataFrame, least: int) -> DataFrame:
    """(pair, f) of the phrases of two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places in _places(batch):
                for keys, counts in pairs_of(places):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["pair", "f"])

    counted = laid.mapInArrow(run, "pair long, f long").groupBy("pair").agg(F.sum("f").alias("f"))
    with few_at_once(laid.sparkSession):
        return common.settle(counted.where(F.col("f") >= least), "pairs")


def frequent_triples(laid: DataFrame, pairs: DataFrame, least: int, held: int) -> DataFrame:
    """(pair, third, f) of the phrases of three words.

    Which pairs are frequent goes to every task while they are few; else each shard is joined to those it has.
    """
    spark = laid.sparkSession
    known = None
    if pairs.count() <= held:
        known = spark.sparkContext.broadcast(packed(pairs))
        asked = laid.select("shard", "places")
    else:
        asked = laid.join(pairs_by_shard(laid, pairs), "shard").select("shard", "places", "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, places in enumerate(_places(batch)):
                frequent = known.value if known is not None else np.sort(batch.column(2)[i].values.to_numpy()).astype(np.uint64)
                for pair, third, counts in triples_of(places, frequent):
                    yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(third.astype(np.int64)), pa.array(counts)], ["pair", "third", "f"])

    counted = asked.mapInArrow(run, "pair long, third long, f long").groupBy("pair", "third").agg(F.sum("f").alias("f"))
    with few_at_once(spark):
        return common.settle(counted.where(F.col("f") >= least), "triples")


def packed(pairs: DataFrame) -> np.ndarray:
    """All pairs in order; they come packed, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [batch.column(0).to_numpy() for batch in batches]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([np.zeros(0, np.int64), *own]).tobytes()], pa.binary())], ["pairs"])

    held = [np.frombuffer(r["pairs"], np.uint64) for r in pairs.select("pair").mapInArrow(run, "pairs binary").collect()]
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *held]))


def pairs_by_shard(laid: DataFrame, pairs: DataFrame) -> DataFrame:
    """(shard, pairs): the frequent pairs of each shard, of which a shard of bounded size has a bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, places in zip(batch.column(0).to_pylist(), _places(batch), strict=True):
                for keys, _ in pairs_of(places):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), shard)), pa.array(keys.astype(np.int64))], ["shard", "pair"])

    own = laid.mapInArrow(run, "shard long, pair long").join(pairs.select("pair"), "pair")
    return own.groupBy("shard").agg(F.collect_list("pair").alias("pairs"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE a^2 / (l r)), exactly: counts have up to 15 digits, so no product passes 38."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (a * a), left * right).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, lang_col: str = "lang", text_col: str = "text", held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two or three words.

    A phrase that occurs ``least`` times or more is scored by its worst cut, and dropped if a longer candidate that holds
    it occurs ``share`` percent as often or more. Ranks go by score and a, descending, then by phrase. A null language is
    ``und``; null, empty and blank texts have no words; repeated rows count as often as they are there. Other columns
    aren't read. With no words there are no rows.

    Words are lower-cased A to Z and told apart exactly; the numbers that stand for them are theirs alone. What goes to
    every task is bounded; shards, counts and candidates are tables.
    """
    spark = common.ready(docs.sparkSession)
    laid = common.settle(shards(docs, lang_col, text_col), "shards")
    entries = laid.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    total = common.settle(laid.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("c")).groupBy("lang").agg(F.sum("c").alias("n")), "totals")
    words = numbered(entries.groupBy("lang", "word").agg(F.sum("c").alias("n")).where(F.col("n") >= least), "words")
    places = coded(laid, words)
    common.discard(laid)
    common.freed(spark)
    pairs = frequent_pairs(places, least)
    common.freed(spark)
    triples = frequent_triples(places, pairs, least, held)
    common.discard(places)
    common.freed(spark)
    counts = words.select("id", F.col("n").alias("w"))
    first, second = F.shiftrightunsigned("pair", 32), F.col("pair").bitwiseAND((1 << 32) - 1)
    two = pairs.select("pair", "f", first.alias("w1"), second.alias("w2"))
    two = two.join(counts.toDF("w1", "n1"), "w1").join(counts.toDF("w2", "n2"), "w2")
    two = common.settle(two.select("pair", "f", "w1", "w2", "n1", "n2"), "scored-pairs")
    behind = F.shiftleft(F.col("pair").bitwiseAND((1 << 32) - 1), 32).bitwiseOR(F.col("third"))
    three = triples.select("pair", "third", F.col("f").alias("a"), behind.alias("next"))
    three = three.join(two.select("pair", F.col("f").alias("f12"), "w1", "w2", "n1"), "pair").join(two.select(F.col("pair").alias("next"), F.col("f").alias("f23"), F.col("n2").alias("n3")), "next")
    three = common.settle(three, "scored-triples")
    longer = three.select("pair", "a").unionByName(three.select(F.col("next").alias("pair"), "a")).groupBy("pair").agg(F.max("a").alias("longer"))
    cut = lambda k, left, right, a: F.struct(_score(a, left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))
    c = F.col
    ones = two.join(longer, "pair", "left").where(F.coalesce(c("longer") * 100 < c("f") * share, F.lit(True))).select("w1", "w2", F.lit(None).cast("long").alias("w3"), c("f").alias("a"), cut(1, c("n1"), c("n2"), c("f")).alias("x"))
    others = three.select("w1", "w2", c("third").alias("w3"), "a", F.least(cut(1, c("n1"), c("f23"), c("a")), cut(2, c("f12"), c("n3"), c("a"))).alias("x"))
    scored = ones.unionByName(others).join(words.select(c("id").alias("w1"), "lang", c("word").alias("t1")), "w1").select("lang", "w2", "w3", "t1", "a", c("x.score").alias("score"), c("x.l").alias("l"), c("x.r").alias("r"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = scored.withColumn("place", F.rank().over(order)).where(c("place") <= top)  # with all that are as good as the last
    named = reduce(lambda df, k: df.join(words.select(c("id").alias(f"w{k}"), c("word").alias(f"t{k}")), f"w{k}", "left"), (2, 3), best)
    named = named.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(c("rank") <= top)
    out = common.settle(ranked.join(F.broadcast(total) if total.count() <= 10_000 else total, "lang").select("lang", c("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    common.discard(total, words, pairs, triples, two, three)
    common.freed(spark)
    return out


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two or three words of each language in all documents."""
    return collocations(common.table(spark, sf_dir, "documents"))
