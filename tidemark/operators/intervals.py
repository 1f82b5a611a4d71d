"""Spans and places: what encloses a place, what encloses a span, and which span ended last before a place.

``spans`` has span_id, start and end (exclusive, whole numbers), ``points`` has point_id and at; both have the columns of
``keys``, such as the file that they lie in. Spans may overlap. Spans without a length, and rows with a null key, start,
end or place, enclose nothing and are in nothing; points keep a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a cell of places holds on average.
CELL_ROWS = 1000


def _usable(spans: DataFrame, keys: list[str]) -> DataFrame:
    return spans.where("start < end").dropna(subset=keys)


def _cells(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Each span once or twice: by its level, the power of two that its length just fits in, and the cells it touches there."""
    usable = _usable(spans, keys).withColumn("level", F.length(F.bin(F.col("end") - F.col("start") - 1)))
    cells = F.array_distinct(F.array(F.expr("shiftright(start, level)"), F.expr("shiftright(end - 1, level)")))
    return usable.select(*keys, "level", F.explode(cells).alias("cell"), "span_id", "start", "end")


def _around(places: DataFrame, spans: DataFrame, keys: list[str], inside: Column, carry: list[str], first: Column) -> DataFrame:
    """The spans that share a cell with a place and enclose it, by an equality join on keys, level and cell.

    A place has a row for each level in use, of which there are 64 at most, and meets only spans that begin or end within
    their own length of it.
    """
    held = _cells(spans, keys)
    levels = [r["level"] for r in held.select("level").distinct().collect()]
    asked = places.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("cell", F.expr("shiftright(at, level)"))
    return asked.join(held, [*keys, "level", "cell"]).where((F.col("start") <= F.col("at")) & inside).groupBy(*keys, *carry).agg(first.alias("first"))


def innermost(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Every point with the span around it that begins last (then the shortest, then the smallest id); null without one."""
    found = _around(points.select(*keys, "point_id", "at"), spans, keys, F.col("at") < F.col("end"), ["point_id", "at"], F.min(F.struct((-F.col("start")).alias("late"), "end", "span_id")))
    return points.join(found.select(*keys, "point_id", "at", F.col("first.span_id").alias("span_id")), [*keys, "point_id", "at"], "left")


def parents(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Every span with the one that encloses it and begins last; of spans with equal bounds the smaller id is the outer one."""
    own = spans.select(*keys, F.col("span_id").alias("child"), F.col("start").alias("at"), F.col("end").alias("until")).where("at < until")
    outer = (F.col("end") >= F.col("until")) & ((F.col("start") < F.col("at")) | (F.col("end") > F.col("until")) | (F.col("span_id") < F.col("child")))
    found = _around(own, spans, keys, outer, ["child", "at", "until"], F.max(F.struct("start", (-F.col("end")).alias("short"), "span_id")))
    held = found.select(*keys, F.col("child").alias("span_id"), F.col("at").alias("start"), F.col("until").alias("end"), F.col("first.span_id").alias("parent"))
    return spans.join(held, [*keys, "span_id", "start", "end"], "left")


def last_before(points: DataFrame, spans: DataFrame, keys: list[str], cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every point with the span that ended last at or before it (then the later start, then the greater id); null without one.

    Running maxima in two steps: within cells of places, and over the cells of a key, so no task goes through all rows of a
    frequent key one by one.
    """
    ended = F.struct(F.col("end").alias("e"), F.col("start").alias("s"), F.col("span_id").alias("i"))
    mine = _usable(spans, keys).select(*keys, F.col("end").alias("at"), ended.alias("span"), F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"), F.lit(False).alias("asked"))
    rows = mine.unionByName(points.select(*keys, "at", F.lit(None).cast(mine.schema["span"].dataType).alias("span"), "point_id", F.lit(True).alias("asked")))
    about = rows.agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).first()
    width = max(1, ((about["high"] or 0) - (about["low"] or 0)) * cell_rows // max(1, about["n"]))
    rows = rows.withColumn("cell", F.expr(f"at div {width}L"))
    within = Window.partitionBy(*keys, "cell").orderBy("at")  # up to the place itself, and all that is at it
    cells = rows.groupBy(*keys, "cell").agg(F.max("span").alias("top"))
    over = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(*keys, "cell", F.max("top").over(over).alias("carried"))
    found = rows.withColumn("own", F.max("span").over(within)).where("asked").join(carried, [*keys, "cell"], "left")
    return found.select(*keys, "point_id", "at", F.coalesce(F.col("own.i"), F.col("carried.i")).alias("span_id"))
