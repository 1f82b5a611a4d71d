"""Document fingerprints by I-Match, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: The band of document frequency, as shares of all documents: terms outside are dropped. Where more terms than LEXICON
#: are in it, the band begins at the frequency that leaves so many.
LOWEST, HIGHEST, LEXICON = 0.005, 0.25, 50_000
#: Randomised subsets of the lexicon: of each share 1/2, 1/4, ... there are EACH, so a term is in about as many. The large
#: ones tell texts apart that differ in few terms, the small ones grade the likeness of texts that differ in many.
LEVELS, EACH = 6, 8
SUBSETS = LEVELS * EACH
#: Cells of the first count, whose number doesn't grow with the corpus.
CELLS = 1 << 20
#: Ids whose texts are looked at together for their neighbours, and ranges of ids that one task may order.
SPAN, ORDERED = 512, 65_536
NO_ID = -(1 << 63)


#: The hashes of a text's distinct terms: runs of letters and digits, and of whatever isn't ASCII, in lower case.
TERMS = r"array_remove(array_distinct(transform(split(lower({}), r'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), t -> xxhash64(t))), xxhash64(''))"


def lexicon(texts: DataFrame, lowest: float = LOWEST, highest: float = HIGHEST, most: int = LEXICON) -> list[int]:
    """The hashes of the terms within the band of document frequency, in order; of bounded number.

    Terms are counted twice: by cells of a fixed number first, so that the second count need only shuffle the terms of
    cells in which a term of the band can be. Both counts combine before the shuffle.
    """
    hashed = texts.select(F.explode(F.expr(TERMS.format("text"))).alias("term"))
    n = texts.count()
    least, largest = max(2.0, lowest * n), max(2.0, highest * n)
    cell = F.pmod("term", F.lit(CELLS)).cast("int")
    cells = hashed.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cell")
    heavy = hashed.withColumn("cell", cell).join(F.broadcast(cells), "cell")  # at most CELLS numbers
    counted = heavy.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n").between(least, largest))
    counted = common.settle(counted, "terms")
    sizes = counted.groupBy("n").agg(F.count("*").alias("terms")).orderBy(F.desc("n"))
    total, from_ = 0, None
    for row in sizes.toLocalIterator():
        total += row["terms"]
        if total > most:
            break
        from_ = row["n"]
    known = [] if from_ is None else sorted(r["term"] for r in counted.where(F.col("n") >= from_).select("term").collect())
    common.discard(counted)
    common.freed(texts.sparkSession)
    return known


def drawn(term: str) -> str:
    """SQL for the subsets that a term is in, as bits: bit EACH * l + j is set with the chance 1/2 ** (l + 1), one at least."""
    every = (1 << EACH) - 1

    def level(k: int, bits: str) -> str:
        own, last = f"(m{k} & {every << (EACH * k)}L)", k == LEVELS - 1
        return f"transform(array({bits}), m{k} -> {own if last else f'{own} | ' + level(k + 1, f'm{k} & xxhash64({term}, {k + 2})')})[0]"

    return f"transform(array({level(0, f'xxhash64({term}, 1)')}), x -> if(x = 0, 1L, x))[0]"


def fingerprint(text: str, known: list[int]) -> Column:
    """One hash for each subset of the lexicon: of the text's distinct terms in it, in order; null where it has none.

    Every term is in some subset, so texts with other terms have other fingerprints. ``text`` names a column. A text with
    no term in the lexicon is printed by all of its terms. A lambda over an array of one element gives a value a name,
    so that each is computed once.
    """
    inside = f"filter(found, t -> t IN ({', '.join(map(str, known)) or 'NULL'}))"
    terms = f"transform(array_sort(if(size(inside) > 0, inside, found)), t -> named_struct('t', t, 'drawn', {drawn('t')}))"
    each = "transform(array(filter(terms, x -> (x.drawn & bit) != 0)), own -> if(size(own) > 0, CAST(xxhash64(transform(own, x -> x.t)) & 2147483647 AS INT), NULL))[0]"
    bits = ", ".join(f"{1 << j}L" for j in range(SUBSETS))
    named = f"transform(array({inside}), inside -> transform(array({terms}), terms -> transform(array({bits}), bit -> {each}))[0])[0]"
    return F.expr(f"transform(array({TERMS.format(text)}), found -> {named})[0]")


def likeness(a: Column, b: Column) -> Column:
    """Of the subsets in which either text has terms, the share with equal hashes; 1 if the fingerprints are equal."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    some = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    equal = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(some == 0, F.lit(1.0)).otherwise(equal / some)


def shown(prints: Column) -> Column:
    """A fingerprint as text: each hash in hex, nothing for a subset without terms."""
    return F.array_join(F.transform(prints, lambda h: F.coalesce(F.hex(h), F.lit(""))), ".")


def previous(ids: DataFrame) -> DataFrame:
    """Rows (id, sub, before): the greatest (id, sub) that is smaller, null for the smallest. ``ids`` has no null and no repeat.

    Ids are looked at within ranges of ORDERED, so a task orders at most as many; the first of each range takes the last
    of the range before, which is found the same way among the ranges.
    """
    one = F.struct("id", "sub")
    if ids.count() <= ORDERED:
        return ids.select("id", "sub", F.lag(one).over(Window.orderBy("id", "sub")).alias("before"))
    ranged = ids.withColumn("range", F.shiftright("id", 16))
    within = ranged.withColumn("near", F.lag(one).over(Window.partitionBy("range").orderBy("id", "sub")))
    ends = ranged.groupBy("range").agg(F.max(one).alias("last"))
    chain = previous(ends.select(F.col("range").alias("id"), F.lit(0).alias("sub")))
    jump = chain.select(F.col("id").alias("range"), F.col("before.id").alias("below")).join(ends.select(F.col("range").alias("below"), "last"), "below").select("range", "last")
    return within.join(jump, "range", "left").select("id", "sub", F.coalesce("near", "last").alias("before"))


def with_next(texts: DataFrame, name: str, derived: Column, span: int = SPAN) -> DataFrame:
    """Rows (key, text, ``name``) and the same of the next row by descending ``key``; after the last, the first.

    ``derived`` is computed from the text where it is read. A row moves once, with those of its range of keys; only the
    greatest of each range is read again, for the range above. Rows that repeat a key follow one another. A range in
    which keys repeat very often is split by key, and a key's rows by their text and by where they are read, so no task
    gets all rows of one key.
    """
    spark = texts.sparkSession
    ranged = texts.withColumn("range", F.floor(F.col("key") / span)).withColumn("row", F.monotonically_increasing_id())
    sizes = common.settle(ranged.groupBy("range").agg(F.count("*").alias("m")), "ranges")
    hot = common.handed(sizes.where(F.col("m") > 4 * span).select("range", F.ceil(F.col("m") / (64 * span)).alias("parts")))
    part = F.pmod(F.xxhash64("text"), F.col("parts")) * 64 + F.pmod("row", F.lit(64))
    ranged = ranged.join(hot, "range", "left").withColumn("id", F.when(F.col("parts").isNull(), F.col("range") * span).otherwise(F.col("key")))
    ranged = ranged.withColumn("sub", F.coalesce(part, F.lit(0)).cast("int")).select("id", "sub", "key", "text")
    order = Window.partitionBy("id", "sub").orderBy("key", "text")
    inner = ranged.withColumn(name, derived)
    for c in ("text", name):
        inner = inner.withColumn(f"near_{c}", F.lag(F.struct(c)).over(order))
    inner = inner.withColumn("first", F.row_number().over(order) == 1)
    ends = common.settle(ranged.groupBy("id", "sub").agg(F.max("key").alias("key")), "ends")
    tops = ranged.join(common.handed(ends), ["id", "sub", "key"]).groupBy("id", "sub").agg(F.max("text").alias("text")).withColumn(name, derived)
    ranges = ends.select("id", "sub")
    wrap = ranges.agg(F.max(F.struct("id", "sub")).alias("greatest"))  # one row
    filled = previous(ranges).crossJoin(F.broadcast(wrap)).select("id", "sub", F.coalesce("before", "greatest").alias("before"))
    filled = common.settle(filled.select("id", "sub", F.col("before.id").alias("low"), F.col("before.sub").alias("low_sub")), "before")
    common.freed(spark)
    above = filled.join(tops.select(F.col("id").alias("low"), F.col("sub").alias("low_sub"), F.struct("text", name).alias("top")), ["low", "low_sub"]).select("id", "sub", "top")
    out = inner.join(above, ["id", "sub"])
    return out.select("key", "text", name, *[F.when(F.col("first"), F.col(f"top.{c}")).otherwise(F.col(f"near_{c}.{c}")).alias(f"next_{c}") for c in ("text", name)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint and its likeness to that of its edited text and of the next document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document in
    descending order of id (null ids last; after the last, the first). Null texts are empty; rows that repeat an id
    follow one another; no other column is read. Ids must be whole numbers, and the smallest 64-bit one counts as null.
    If no term is within the band, every text is printed by all of its terms. DataFrame functions only: no Python runs on
    the executors.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    known = lexicon(texts)
    rows = with_next(texts, "prints", fingerprint("text", known))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn("edited_prints", fingerprint("edited", known))
    return rows.select(
        F.when(F.col("key") != NO_ID, F.col("key")).alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("prints")).alias("fingerprint"),
        shown(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of all documents and of their edited texts."""
    return fingerprints(common.table(spark, sf_dir, "documents"))
