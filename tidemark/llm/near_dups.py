"""Near duplicates by bottom-k sketches of one hash function, inverted lists of retained values, and exact Jaccard.

Documents with equal shingle sets are one class. A class keeps the k smallest hashes of its set. Of these, only the
rarest go into inverted lists: two sketches that share at least t of k values must share one of the k - t + 1 rarest of
each (the same global order for all), so a pair that is similar enough meets in some list, and passages that very many
documents share hardly ever make a list. Of a pair that meets, the sketch of the union (the k smallest values of both
sketches) estimates the similarity by the share of its values that both have; what may reach the threshold is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components

#: Values that a sketch retains, and the standard deviations by which an estimate may lie below the threshold: a pair at
#: the threshold is missed with a chance of about one in 10^8.
RETAINED, SIGMAS = 64, 6.0
#: Values of the sketches by which members of long lists are compared with each other.
WIDE = 512
PERCENT = 80
WORDS = 5
#: Bytes of a text that are hashed at a time.
STRETCH = 4_000_000
#: Members up to which the pairs of a list are made by a join; longer lists are compared block by block, tile by tile.
SMALL_LIST = 64
BLOCK, TILE = 4096, 1024
#: Values of pairs that a task compares at a time.
AT_ONCE = 1 << 20
#: Shingles of the texts that are verified together, and pairs of such a bucket.
BUCKET_SHINGLES, BUCKET_PAIRS = 2_000_000, 200_000

_LOWER = bytes(32 if b in b" \t\n\x0b\x0c\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _bytes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, made longer as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                run = np.full(size, np.uint64(base), np.uint64)
                run[0] = 1
                setattr(self, name, np.cumprod(run, dtype=np.uint64))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def word_hashes(text: str, table: bytes = _LOWER) -> np.ndarray:
    """A 64-bit hash of each word in turn, of all words at once: differences of a running polynomial of the bytes.

    Of a long text, stretches of whole words are done one after the other, so what is held beside it is bounded.
    """
    data = text.encode("utf-8", "surrogatepass").translate(table)
    out, start = [], 0
    while len(data) - start > STRETCH:
        end = data.rfind(b" ", start, start + STRETCH)
        end = end if end > start else data.find(b" ", start + STRETCH)
        if end < 0:
            break
        out.append(_hashes(np.frombuffer(data, np.uint8, end - start, start)))
        start = end
    out.append(_hashes(np.frombuffer(data, np.uint8, len(data) - start, start)))
    return np.concatenate(out) if len(out) > 1 else out[0]


def _hashes(raw: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, np.uint64)
    up, down = POWERS.of(len(raw))
    word = np.concatenate(([False], raw != 32, [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_bytes()[raw] * up, dtype=np.uint64)))
    return mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of a document's shingles as sorted 63-bit hashes; of fewer words than a shingle has, the whole sequence."""
    hashes = word_hashes(text) if text else np.zeros(0, np.uint64)
    n = len(hashes)
    if not n:
        return hashes
    size = min(words, n)
    rolled = np.full(n - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + hashes[i : n - size + 1 + i]
    return np.unique(mix(rolled) >> np.uint64(1))


def sketches(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", size: int | None = None) -> DataFrame:
    """doc_id, n (set size), print (equal for equal sets) and sketch (the ``size`` (RETAINED) smallest hashes, in order)."""
    size = size or RETAINED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            n, prints, kept = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                kept.append(s[:size].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(kept, pa.list_(pa.int64()))], ["doc_id", "n", "print", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n long, print binary, sketch array<long>")


def least_shared(n, size: int | None = None, sqrt=np.sqrt, most=np.maximum, up=np.ceil):
    """How many of its ``size`` (RETAINED) smallest values the union of a set of n and a similar one has in both, at the least.

    They are a sample of the union without replacement, and the union has n / 0.8 values at most. The bound lies SIGMAS
    standard deviations below the mean: of 64 it falls from 43 for n = 64 to 32 for the largest sets.
    """
    share, size = PERCENT / 100, size or RETAINED
    spread = share * (1 - share) * size * most(1 - size * share / n, 0.0)
    return up(size * share - SIGMAS * sqrt(spread) - 1e-9)


def needed(n):
    """How many retained values a set of n shares at least with any that is similar enough.

    Below RETAINED this is sure: of two such sets the larger, of m values, shares PERCENT of them, and if it isn't
    retained whole, it retains RETAINED and so at most (1 - PERCENT) m of these are its own.
    """
    whole = F.ceil(n * PERCENT / 100)
    beside = F.ceil(RETAINED - n * (100 - PERCENT) / PERCENT)  # the partner has at most n * 100 / PERCENT values
    return F.when(n < RETAINED, F.least(whole, beside)).otherwise(_least(n)).cast("int")


def _least(n):
    return least_shared(n, None, F.sqrt, lambda x, y: F.greatest(x, F.lit(y)), F.ceil)


def prefixes(classes: DataFrame) -> DataFrame:
    """Rows (node, n, vs): the rarest retained values of each class, as many as a similar pair needs, that others have too."""
    values = classes.select("node", F.col("n").cast("int").alias("n"), F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("often")).where("often > 1")
    kept = values.join(often, "v").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("often", "v"))).alias("vs"))
    length = F.size("vs") - needed(F.col("n")) + 1  # values that no other has come first in the order, and take up places
    return kept.where(length > 0).select("node", F.col("n").cast("long").alias("n"), F.slice("vs", F.lit(1), length).alias("vs")).select("node", "n", F.col("vs.v").alias("vs"))


def close_in_size(a, b, percent: int = PERCENT):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def union_sketch(a, b, whole):
    """(values in both, all values) of the union's own sketch: the RETAINED smallest of both sketches; all of whole sets."""
    both = F.array_sort(F.array_union(a, b))
    sketch = F.slice(both, F.lit(1), F.when(whole, F.size(both)).otherwise(F.lit(RETAINED)))
    return F.size(F.array_intersect(sketch, F.array_intersect(a, b))), F.size(sketch)


def alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) whose union sketch estimates a similarity that may reach the threshold; n are set sizes.

    A value of the union's sketch that either set has is in that one's own sketch, so the share of them that both have
    is an unbiased estimate of the similarity. If both sets are retained whole, the sketch is the union itself.
    """
    sketch = classes.select("node", "n", "sketch")
    first = sketch.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    second = sketch.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(first, "a").join(second, "b").where(close_in_size(F.col("na"), F.col("nb")))
    whole = F.greatest("na", "nb") <= RETAINED
    shared, size = union_sketch(F.col("sa"), F.col("sb"), whole)
    enough = F.when(whole, shared * 100 >= size * PERCENT).otherwise(shared >= _least(F.least("na", "nb")))
    return both.where(enough).select("a", "b", "na", "nb")


def verified(pairs: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of (a, b, na, nb) whose full sets have 100 * intersection >= percent * union.

    Pairs are dealt into buckets by b, of a bounded sum of shingles, and by a too where pairs are many for their texts.
    A text goes once to each bucket that asks for it, however many pairs it has there, and becomes a set there.
    """
    pairs = common.settle(pairs.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb")), "pairs")
    common.freed(pairs.sparkSession)
    sizes = pairs.select(F.col("a").alias("node"), F.col("na").alias("n")).union(pairs.select("b", "nb")).groupBy("node").agg(F.max("n").alias("n"))
    total, n_pairs = sizes.agg(F.sum("n")).first()[0] or 0, pairs.count()
    deal = max(24, -(-total // BUCKET_SHINGLES))
    split = max(1, round((n_pairs / deal / BUCKET_PAIRS) ** 0.5))
    bucket = F.pmod(F.xxhash64("b"), F.lit(deal)) * split + F.pmod(F.xxhash64("a"), F.lit(split))
    dealt = pairs.select("a", "b", bucket.alias("bucket"))
    wanted = dealt.select("bucket", F.col("a").alias("node")).union(dealt.select("bucket", F.col("b").alias("node"))).distinct()
    wanted = common.settle(wanted, "wanted")
    sent = texts.select("node", "text").join(common.handed(wanted), "node").select("bucket", "node", "text")

    def share(a: np.ndarray, b: np.ndarray) -> bool:
        if not len(a) or not len(b):
            return False
        both = int((a[np.minimum(a.searchsorted(b), len(a) - 1)] == b).sum())
        return 100 * both >= percent * (len(a) + len(b) - both)

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        held: dict = {}
        for node, text in zip(texts.column("node").to_pylist(), texts.column("text").to_pylist(), strict=True):
            held.setdefault(node, []).append(text)
        sets = {node: [shingles(t, words) for t in dict.fromkeys(own)] for node, own in held.items()}  # an id may have several
        a, b = pairs.column("a").to_pylist(), pairs.column("b").to_pylist()
        keep = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if any(share(p, q) for p in sets[x] for q in sets[y])]
        return pairs.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    kind = pairs.schema["a"].dataType.simpleString()
    out = common.settle(dealt.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(run, f"a {kind}, b {kind}"), "links")
    common.discard(pairs, wanted)
    common.freed(out.sparkSession)
    return out


def sized(lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Adds ``band``: sets of similar documents are in the same band of sizes or in neighbouring ones."""
    return lists.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int"))


def stars(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's members with the smallest one of their band there."""
    seen = lists.groupBy("v", "band").agg(F.count("*").alias("m"), F.min("node").alias("a")).where("m > 1").select("v", "band", "a")
    return lists.join(seen, ["v", "band"]).where("a <> node").select("a", F.col("node").alias("b")).distinct()


def gathered(long: DataFrame) -> DataFrame:
    """Long lists of a band in most of whose members one label prevails, made into one list without repeats.

    The lists of a group of near copies have nearly the same members; so they are compared once. No pair is lost.
    """
    most = long.groupBy("v", "band", "label").agg(F.count("*").alias("k"), F.first("m").alias("m"))
    most = most.where("k * 2 > m").select("v", "band", F.col("label").alias("top"))
    own = F.coalesce("top", F.bitwise_not("v"))  # a list without such a label stays alone; values are positive
    marked = long.select("v", "band").distinct().join(most, ["v", "band"], "left").withColumn("key", F.struct(F.col("top").isNull().alias("alone"), own.cast("string").alias("of")))
    first = marked.groupBy("band", "key").agg(F.min("v").alias("to"))
    to = marked.join(first, ["band", "key"]).select("v", "band", "to")
    rows = long.drop("m").join(to, ["v", "band"]).select(F.col("to").alias("v"), "band", "node", "n", "label", "home").distinct()
    return rows.join(rows.groupBy("v", "band").agg(F.count("*").alias("m")), ["v", "band"])


def across(lists: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """Pairs (a, b, na, nb) that meet in a list and have different labels so far, if their union sketches allow the similarity.

    A list is gone through band by band, each with the members of the band below as guests; pairs of guests are left
    to their own band. Of lists with the same members one is enough.
    """
    marked = lists.join(labels, "node", "left").select("v", "band", "node", "n", F.coalesce("label", "node").alias("label"))
    both = marked.withColumn("home", F.lit(True)).unionByName(marked.withColumn("band", F.col("band") + 1).withColumn("home", F.lit(False)))
    seen = both.groupBy("v", "band").agg(F.count("*").alias("m"), F.max("home").alias("lived"), F.min("node").alias("first"), F.sum(F.xxhash64("node", "home").cast("decimal(20,0)")).alias("members"), F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = seen.where("lived AND low <> high").groupBy("band", "m", "first", "members").agg(F.min("v").alias("v")).select("v", "band", "m")
    rest = common.settle(both.join(mixed, ["v", "band"]), "mixed-lists")
    common.freed(rest.sparkSession)
    few = rest.where(F.col("m") <= SMALL_LIST)
    side = lambda a: few.select("v", "band", *[F.col(c).alias(f"{c}_{a}") for c in ("node", "n", "label", "home")])
    met = side("a").join(side("b"), ["v", "band"])
    met = met.where("node_a < node_b AND label_a <> label_b AND (home_a OR home_b)").where(close_in_size(F.col("n_a"), F.col("n_b")))
    near = met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    long = common.settle(gathered(rest.where(F.col("m") > SMALL_LIST)), "long-lists")
    asked = common.settle(long.select("node").distinct(), "asked")
    wide = common.settle(sketches(texts.join(common.handed(asked), "node", "left_semi"), words, "node", size=WIDE), "wide")
    common.freed(rest.sparkSession)
    out = common.settle(alike(near, classes).unionByName(blockwise(long, wide)), "across")
    common.discard(rest, long, asked, wide)
    common.freed(out.sparkSession)
    return out


def flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of arrays, and the row of each value."""
    arrays = table.column(name).combine_chunks()
    lengths = arrays.value_lengths().to_numpy()
    return arrays.flatten().to_numpy(), np.repeat(np.arange(len(lengths)), lengths)


def overlaps(a: tuple[np.ndarray, np.ndarray], na: int, b: tuple[np.ndarray, np.ndarray], nb: int, often: int = 64, step: int = 4096) -> np.ndarray:
    """How many values each of na rows shares with each of nb others; a and b are (values, row of each).

    Values that more than ``often`` rows have are done by products of 0-1 matrices of bounded width, and there are few of
    them; of the others each pair of rows that meets is counted, AT_ONCE of them at a time.
    """
    shared = np.intersect1d(a[0], b[0])
    sides = []
    for values, rows in (a, b):
        column = np.searchsorted(shared, values)
        known = shared[np.minimum(column, len(shared) - 1)] == values if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(column[known], kind="stable")
        sides.append((column[known][order], rows[known][order]))
    (ca, ra), (cb, rb) = sides
    fa, fb = (np.bincount(c, minlength=len(shared)) for c in (ca, cb))
    heavy = (fa > often) | (fb > often)
    out = np.zeros(na * nb, np.float32)
    ends = np.cumsum(fb)
    light = ~heavy[ca]
    column, rows = ca[light], ra[light]
    each = fb[column]
    edges = np.append(np.flatnonzero(np.diff(np.cumsum(each) // AT_ONCE, prepend=-1)), len(each))
    for i, j in zip(edges, edges[1:], strict=False):
        some = each[i:j]
        at = np.arange(int(some.sum())) + np.repeat(ends[column[i:j]] - np.cumsum(some), some)
        out += np.bincount(np.repeat(rows[i:j], some) * nb + rb[at], minlength=na * nb)
    out = out.reshape(na, nb)
    place = np.cumsum(heavy) - 1
    for first in range(0, int(heavy.sum()), step):
        held = []
        for c, r, n in ((ca, ra, na), (cb, rb, nb)):
            some = heavy[c] & (place[c] >= first) & (place[c] < first + step)
            matrix = np.zeros((n, min(step, int(heavy.sum()) - first)), np.float32)
            matrix[r[some], place[c[some]] - first] = 1
            held.append(matrix)
        out += held[0] @ held[1].T
    return out


def padded(values: np.ndarray, rows: np.ndarray, n: int, width: int) -> np.ndarray:
    """Each row's values, in order, in a row of fixed width; the rest is greater than any value."""
    out = np.full((n, width), np.iinfo(np.int64).max, np.int64)
    first = np.searchsorted(rows, np.arange(n))
    out[rows, np.arange(len(rows)) - first[rows]] = values
    return out


def union_shares(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Of the ``size`` smallest values of each row pair's union, how many are in both."""
    both = np.concatenate((a, b), axis=1)
    both.sort(axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = both[:, 1:] == both[:, :-1]
    return (again & (np.cumsum(~again, axis=1, dtype=np.int32) <= size)).sum(axis=1)


def pair_shares(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """The same for the rows i of a, each with that of the rows j of b, of which few are copied at a time."""
    step = max(1, AT_ONCE // (a.shape[1] + b.shape[1]))
    return np.concatenate([np.zeros(0, np.int64), *(union_shares(a[i[k : k + step]], b[j[k : k + step]], size) for k in range(0, len(i), step))])


def blockwise(rest: DataFrame, wide: DataFrame) -> DataFrame:
    """The same for long lists: members are dealt into blocks of bounded size, and each pair of blocks is one group.

    A group compares its sketches tile by tile: those of RETAINED values first, and what may be similar by those of WIDE
    values, which leave few pairs. A pair that meets in several long lists leaves the first of them alone.
    """
    rest = rest.join(rest.groupBy("node", "band").agg(F.collect_list("v").alias("lists")), ["node", "band"])
    blocks = F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK)).cast("int")
    dealt = rest.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.join(wide.select(F.col("doc_id").alias("node"), "n", "sketch"), ["node", "n"])
    placed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("v", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "label", "home", "lists", "sketch")
    kind = rest.schema["node"].dataType.simpleString()

    def compare(table: pa.Table) -> pa.Table:
        i, j, v = (table.column(c)[0].as_py() for c in ("i", "j", "v"))
        own = table.column("own").to_numpy()
        left = table if i == j else table.filter(pa.array(own == i))
        right = table if i == j else table.filter(pa.array(own == j))
        out = [table.select(["node", "node", "n", "n"]).slice(0, 0).rename_columns(["a", "b", "na", "nb"])]
        for x in range(0, left.num_rows, TILE):
            for y in range(0, right.num_rows, TILE):
                out.append(tile(left.slice(x, TILE), right.slice(y, TILE), v, i == j))
        return pa.concat_tables(out)

    def tile(one: pa.Table, two: pa.Table, v: int, same: bool) -> pa.Table:
        node, n, label, home = ([t.column(c).to_numpy(zero_copy_only=False) for t in (one, two)] for c in ("node", "n", "label", "home"))
        values = [flat(t, "sketch") for t in (one, two)]
        fine = (label[0][:, None] != label[1][None, :]) & (home[0][:, None] | home[1][None, :])
        fine &= np.minimum.outer(*n) * 100 >= np.maximum.outer(*n) * PERCENT
        fine &= (node[0][:, None] < node[1][None, :]) if same else (node[0][:, None] != node[1][None, :])
        if not fine.any():
            return one.select(["node", "node", "n", "n"]).slice(0, 0).rename_columns(["a", "b", "na", "nb"])
        earlier = [(x[0][x[0] < v], x[1][x[0] < v]) for x in (flat(t, "lists") for t in (one, two))]
        fine &= overlaps(earlier[0], one.num_rows, earlier[1], two.num_rows) == 0
        for size in (RETAINED, WIDE):
            some = [(x[0][at < size], x[1][at < size]) for x in values for at in [np.arange(len(x[1])) - np.searchsorted(x[1], x[1])]]
            overlap = overlaps(some[0], one.num_rows, some[1], two.num_rows)
            whole = np.maximum.outer(*n) <= size
            least = np.maximum.outer(*(least_shared(x, size) for x in n)).astype(np.float32)  # it falls with n
            fine &= np.where(whole, overlap * 100 >= (np.add.outer(*n) - overlap) * PERCENT, (overlap >= least) | (np.minimum.outer(*n) < size))
            x, y = np.nonzero(fine)
            sketch = [padded(*f, t.num_rows, size) for f, t in zip(some, (one, two), strict=True)]
            fine[x, y] = whole[x, y] | (pair_shares(sketch[0], x, sketch[1], y, size) >= least[x, y])
        x, y = np.nonzero(fine)
        x, y = pa.array(x), pa.array(y)
        a, b, na, nb = one.column("node").take(x), two.column("node").take(y), one.column("n").take(x), two.column("n").take(y)
        swap = pc.greater(a, b)
        return pa.table({k: pc.if_else(swap, two, one) for k, one, two in (("a", a, b), ("b", b, a), ("na", na, nb), ("nb", nb, na))})

    return placed.groupBy("v", "band", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}, na long, nb long")


def near_duplicates(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and kept (whether it is its own).

    Links join documents with 100 * intersection >= 80 * union of their shingle sets, and every link is confirmed on the
    full sets. Null, empty and blank texts have the empty set and no link. Rows that repeat an id count as one document
    in the links and are returned each; rows with a null id link with nothing and are kept. No other column is read.

    First, each list links its members with its smallest one; this joins most of a group of copies at the price of a
    pair per member. Only lists whose members then still have different labels are gone through pair by pair, and only
    across labels, which loses no link between groups, whatever their size. Tables of every step are given back when
    the next has read them; the result lies in the shared folder.
    """
    spark = common.ready(docs.sparkSession)
    if spark.conf.get("spark.sql.adaptive.skewJoin.enabled", "true") != "true":
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    source = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
    sketched = common.settle(sketches(docs, words, id_col=id_col, text_col=text_col), "sketches")
    with_set = "n > 0 AND doc_id IS NOT NULL"
    classes = common.settle(sketched.where(with_set).groupBy("print").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    rows = common.settle(sketched.drop("sketch"), "prints")
    usable = rows.where(with_set)
    common.discard(sketched)
    repeated = usable.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select(F.col("doc_id").alias("node"))
    same = []
    if not repeated.isEmpty():  # each text of such an id once; its classes are one
        some = common.handed(common.settle(repeated, "repeated"))
        source = source.join(some, "node", "left_anti").unionByName(source.join(some, "node", "left_semi").distinct())
        several = usable.select(F.col("doc_id").alias("node"), "print").join(some, "node", "left_semi").distinct()
        several = several.select(F.col("node").alias("id"), "print").join(classes.select("print", "node"), "print")
        low = several.groupBy("id").agg(F.min("node").alias("a"))
        same = [common.settle(several.join(low, "id").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "links")]
    rarest = common.settle(prefixes(classes), "prefixes")
    common.freed(spark)
    lists = sized(rarest.select("node", "n", F.explode("vs").alias("v")))
    links = reduce(DataFrame.unionByName, same, verified(alike(stars(lists), classes), source, words))
    labels = components(links)
    pairs = across(lists, labels, classes, source, words)
    common.discard(rarest)
    more = verified(pairs, source, words)
    joined = components(links.unionByName(more))
    common.discard(links, more, labels, pairs)
    ids = usable.join(classes.select("print", "node"), "print").join(joined, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "node")).alias("component_id"))
    out = common.settle(rows.join(ids, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "near-duplicates")
    common.discard(rows, classes, joined)
    common.freed(spark)
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents, by shingles of two words, as the query's contract has them."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), words=2)
