"""Which search a read came from: as-of joins with a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOLERANCE_SECONDS = 60


def attribute(reads: DataFrame, searches: DataFrame, key: list[str], tolerance: int = TOLERANCE_SECONDS) -> DataFrame:
    """Rows (read_id, search_id, lag): for each read the latest search with its keys, at most ``tolerance`` seconds before.

    Times are in whole seconds (read_at, search_at). Searches are also dealt into intervals as long as the tolerance, so
    a read meets only those of its own interval and the one before, however many a key has. A search counts once, for
    its first read.
    """
    bin_of = lambda c: F.floor(F.col(c) / tolerance)
    left = reads.select(*key, "read_id", "read_at").withColumn("bin", F.explode(F.array(bin_of("read_at"), bin_of("read_at") - 1)))
    right = searches.select(*key, "search_id", "search_at").withColumn("bin", bin_of("search_at"))
    met = left.join(right, [*key, "bin"]).withColumn("lag", F.col("read_at") - F.col("search_at")).where(F.col("lag").between(0, tolerance))
    latest = Window.partitionBy("read_id").orderBy("lag", F.desc("search_id"))
    first = Window.partitionBy("search_id").orderBy("read_at", "read_id")
    chosen = met.withColumn("_k", F.row_number().over(latest)).where("_k = 1")
    return chosen.withColumn("_j", F.row_number().over(first)).where("_j = 1").select("read_id", "search_id", "lag")
