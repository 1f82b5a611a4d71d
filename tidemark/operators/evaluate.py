"""Search quality and the confidence floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.shared import settle
from . import vectors

LOWEST_FLOOR, HIGHEST_FLOOR, DEFAULT_FLOOR, MARGIN = 0.20, 0.70, 0.45, 0.02


def first_relevant(hits: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (query_id, rank): the rank of each query's first relevant hit, null if there is none.

    ``relevant`` has (query_id, path), or path alone where the same ones are relevant to all queries.
    """
    found = hits.join(relevant, [c for c in ("query_id", "path") if c in relevant.columns], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return queries.select("query_id").join(found, "query_id", "left")


def metrics(ranks: DataFrame) -> DataFrame:
    """One row: queries, r_at_1, r_at_3, r_at_5, mrr."""
    at = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"r_at_{k}")
    return ranks.agg(F.count("*").alias("queries"), at(1), at(3), at(5), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: the second's metrics less the first's."""
    a, b = metrics(first), metrics(second)
    names = ("r_at_1", "r_at_3", "r_at_5", "mrr")
    return a.select(*[F.col(n).alias(f"a_{n}") for n in names]).crossJoin(b.select(*[F.col(n).alias(f"b_{n}") for n in names])).select(*[(F.col(f"b_{n}") - F.col(f"a_{n}")).alias(n) for n in names])


def percentile(values: Column, q: float) -> Column:
    """Of an array the value at floor(n * q), counted from 0 in order; null if it is empty."""
    at = F.least(F.floor(F.size(values) * F.lit(q)), F.size(values) - 1).cast("int")
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), at + 1))


def floor_of(positives: Column, negatives: Column) -> Column:
    """The similarity under which a result isn't trusted, of arrays of them."""
    return F.when(F.size(positives) == 0, F.lit(DEFAULT_FLOOR)).otherwise(floor_between(percentile(positives, 0.10), percentile(negatives, 0.90)))


def floor_between(low: Column, high: Column) -> Column:
    """Just above the high end of negatives, not above the low end of positives; the default without positives."""
    chosen = F.when(high.isNull(), low).otherwise(F.least(high + MARGIN, low))
    return F.when(low.isNull(), F.lit(DEFAULT_FLOOR)).otherwise(F.greatest(F.lit(LOWEST_FLOOR), F.least(F.lit(HIGHEST_FLOOR), chosen)))


def nearest_by_label(rows: DataFrame) -> DataFrame:
    """Rows (chunk_id, label, own, other): each vector's cosine to the nearest other one of its label, and of another; null without one.

    Vectors are scaled to length 1, where the nearest have the greatest cosine, put in blocks and searched for
    themselves. Those without a direction have neither; a null label is like any other.
    """
    index = vectors.in_blocks(rows.select("chunk_id", "embedding", "label"), unit=True)
    asked = rows.select(F.col("chunk_id").alias("query_id"), "embedding", "label")
    found = vectors.nearest(asked, index, 1, apart=True, by_label=True, unit=True)
    known = lambda c, same: F.max(F.when(F.col("same") == same, F.col("cosine"))).alias(c)
    both = found.groupBy(F.col("query_id").alias("chunk_id")).agg(known("own", True), known("other", False))
    return rows.select("chunk_id", "label").join(both, "chunk_id", "left")


def selected(values: DataFrame, share: float, buckets: int = 1024, few: int = 4096) -> DataFrame:
    """Rows (label, value): of each label's values, in order, the one at floor(n * share), counted from 0.

    Exact, and no label's values come together: they are counted by ranges of equal width between the label's bounds, the
    range that holds the wanted place becomes the new bounds, and so on until it holds few values or equal ones alone.
    Null values don't count; a label without values has no row.
    """
    rows = values.where("value IS NOT NULL").select("label", "value")
    bounds = settle(rows.groupBy("label").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).withColumn("at", F.least(F.floor(F.col("n") * F.lit(share)), F.col("n") - 1)), "bounds")
    within = lambda: rows.join(bounds, rows["label"].eqNullSafe(bounds["label"])).drop(bounds["label"]).where((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))
    while not bounds.where((F.col("n") > few) & (F.col("low") < F.col("high"))).isEmpty():
        width = F.col("high") - F.col("low")
        part = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("low")) / width * buckets), F.lit(buckets - 1))).otherwise(0)
        counted = within().withColumn("part", part).groupBy("label", "at", "part").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        before = F.sum("n").over(Window.partitionBy("label").orderBy("part")) - F.col("n")  # of as many rows as there are ranges
        held = counted.withColumn("before", before).where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n")))
        bounds = settle(held.select("label", "n", "low", "high", (F.col("at") - F.col("before")).alias("at")), "bounds")
    ordered = within().where("low < high").withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("value")) - 1)
    return ordered.where("place = at").select("label", "value").unionByName(bounds.where("low = high").select("label", F.col("low").alias("value")))


def floors_by_label(nearest: DataFrame) -> DataFrame:
    """Rows (label, floor): the nearest of each label's own vectors are the positives, those of others the negatives."""
    rows = settle(nearest.select("label", "own", "other"), "nearest")
    low = selected(rows.select("label", F.col("own").alias("value")), 0.10).select(F.col("label").alias("of"), F.col("value").alias("low"))
    high = selected(rows.select("label", F.col("other").alias("value")), 0.90).select(F.col("label").alias("against"), F.col("value").alias("high"))
    labels = rows.select("label").distinct()
    found = labels.join(low, F.col("label").eqNullSafe(F.col("of")), "left").join(high, F.col("label").eqNullSafe(F.col("against")), "left")
    return found.select("label", floor_between(F.col("low"), F.col("high")).alias("floor"))


def stride_sample(rows: DataFrame, key: str, n: int = 40) -> DataFrame:
    """About ``n`` rows evenly through the order of ``key`` (fewer than twice as many).

    Only rows up to the last wanted place matter to the result, and places come from ranks within ranges of the key whose
    sizes are summed, so no task orders all rows.
    """
    total = rows.count()
    step = max(1, total // n)
    ordered = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    sizes = {r["_part"]: r["n"] for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for part in sorted(sizes):
        starts += [F.lit(part), F.lit(before)]
        before += sizes[part]
    if not starts:
        return rows
    place = F.create_map(*starts)[F.col("_part")] + F.col("_at")
    return ordered.where(place % step == 0).drop("_part", "_at")
