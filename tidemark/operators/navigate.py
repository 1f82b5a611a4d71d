"""Links between chunks: resolving them, and walking them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..plans.shared import settle

DEEPEST = 5


def resolve_symbol_links(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fill target_chunk_id and confidence of links that name a symbol.

    A definition in the link's own file comes first (the last one there) and is exact; else the smallest chunk with the
    symbol, exact if it is the only one and else a name match. What no chunk defines has neither.
    """
    named = chunks.where("symbol IS NOT NULL AND symbol <> ''")
    anywhere = named.groupBy(F.col("symbol").alias("target_symbol")).agg(F.min("chunk_id").alias("any_id"), F.count("*").alias("n"))
    inside = named.groupBy("path", F.col("symbol").alias("target_symbol")).agg(F.max("chunk_id").alias("own_id"))
    paths = chunks.select(F.col("chunk_id").alias("source_chunk_id"), F.col("path"))
    rows = links.drop("target_chunk_id", "confidence", "path").join(paths, "source_chunk_id").join(inside, ["path", "target_symbol"], "left").join(anywhere, "target_symbol", "left")
    target = F.coalesce("own_id", "any_id")
    confidence = F.when(F.col("own_id").isNotNull() | (F.col("n") == 1), "exact").when(F.col("any_id").isNotNull(), "name_match")
    kept = [c for c in links.columns if c not in ("target_chunk_id", "confidence")]
    return rows.withColumn("target_chunk_id", target).withColumn("confidence", confidence).select(*[c for c in kept if c != "path"], "target_chunk_id", "confidence")


def resolve_note_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Fill target_path and confidence of note links (link_id, title, want): by path if it has one, else by title.

    A path matches a file that is it or ends with / and it, both in lower case without .md; every suffix of every file's
    path is a row, so the join is on equality. A title matches a file's name. Of several the smallest path is taken; the
    link is exact if there is one. Files are counted by suffix and by name first, so a link meets one row of either kind,
    however many files are alike.
    """
    files = files.select("path").distinct()
    lower = F.regexp_replace(F.lower("path"), r"\.md$", "")
    parts = F.split(lower, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
    by_path = files.select("path", F.explode(suffixes).alias("_want")).groupBy("_want").agg(F.min("path").alias("_path"), F.count("*").alias("_n"))
    by_title = files.groupBy(F.lower(tx.stem(F.col("path"))).alias("_title")).agg(F.min("path").alias("_named"), F.count("*").alias("_names"))
    want = F.regexp_replace(F.lower("want"), r"\.md$", "")
    asked = links.withColumns({"_want": F.when(want != "", want), "_title": F.lower("title")})
    n = F.coalesce("_n", "_names")
    found = asked.join(by_path, "_want", "left").join(by_title, "_title", "left")
    return found.select(*links.columns, F.coalesce("_path", "_named").alias("target_path"), F.when(n == 1, "exact").when(n > 1, "name_match").alias("confidence"))


def _with_paths(links: DataFrame, chunks: DataFrame) -> DataFrame:
    place = chunks.select("chunk_id", "path")
    resolved = links.where("target_chunk_id IS NOT NULL")
    return resolved.join(place.select(F.col("chunk_id").alias("source_chunk_id"), F.col("path").alias("source_path")), "source_chunk_id").join(place.select(F.col("chunk_id").alias("target_chunk_id"), F.col("path").alias("target_file")), "target_chunk_id")


def backlinks(links: DataFrame, chunks: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (path, linked_from): files that link to another one; to ``path`` only, if it is given."""
    rows = _with_paths(links, chunks).where("source_path <> target_file").select(F.col("target_file").alias("path"), F.col("source_path").alias("linked_from")).distinct()
    return rows if path is None else rows.where(F.col("path") == path).orderBy("linked_from")


def forward_links(links: DataFrame, chunks: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (path, links_to): the other way round."""
    rows = _with_paths(links, chunks).where("source_path <> target_file").select(F.col("source_path").alias("path"), F.col("target_file").alias("links_to")).distinct()
    return rows if path is None else rows.where(F.col("path") == path).orderBy("links_to")


def callers(calls: DataFrame, targets: DataFrame, depth: int = 3) -> DataFrame:
    """Rows (target, caller, dist): what calls each target, directly or through others, up to ``depth`` steps.

    ``calls`` has (caller, callee). A caller stands once for every distance at which it occurs, as cycles can make
    several; each step joins only the rows that the last one made, without repeats, and is written before the next.
    """
    edges = calls.select("caller", "callee").distinct()
    step = targets.select(F.col("target"), F.col("target").alias("at"))
    out = None
    for dist in range(1, max(1, min(DEEPEST, depth)) + 1):
        step = settle(step.join(edges, F.col("at") == F.col("callee")).select("target", F.col("caller").alias("at")).distinct(), "callers")
        rows = step.select("target", F.col("at").alias("caller"), F.lit(dist).alias("dist"))
        out = rows if out is None else out.unionByName(rows)
    return out


def find_implementations(links: DataFrame, chunks: DataFrame, symbols: DataFrame | str, limit: int = 20) -> DataFrame:
    """Rows (symbol_asked, path, chunk_id, symbol, place): what says that it implements each symbol, resolved or not."""
    asked = links.sparkSession.createDataFrame([(symbols,)], "symbol string") if isinstance(symbols, str) else symbols
    said = links.where("kind = 'implements'").select(F.col("target_symbol").alias("symbol_asked"), F.col("source_chunk_id").alias("chunk_id")).distinct()
    rows = said.join(asked.select(F.col("symbol").alias("symbol_asked")).distinct(), "symbol_asked").join(chunks.select("chunk_id", "path", "symbol"), "chunk_id")
    order = Window.partitionBy("symbol_asked").orderBy("path", "chunk_id")
    placed = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(1, min(100, limit)))
    return placed.select("symbol_asked", "path", "chunk_id", "symbol", "place")


def find_definitions(chunks: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    """Rows (symbol_asked, chunk_id, path, symbol, priority): exact names first, then aliases, at most ``limit`` each."""
    defined = chunks.where("kind <> 'prose' AND symbol IS NOT NULL AND symbol <> ''")
    exact = defined.join(symbols.select(F.col("symbol").alias("symbol_asked")), F.col("symbol") == F.col("symbol_asked")).select("symbol_asked", "chunk_id", "path", "symbol", F.lit(0).alias("priority"))
    names = defined.select("chunk_id", "path", "symbol", F.explode(F.transform(tx.aliases(F.col("symbol"), F.lit(None).cast("string")), tx.ascii_lower)).alias("name"))
    asked = symbols.select(F.col("symbol").alias("symbol_asked"), tx.ascii_lower(F.col("symbol")).alias("name"))
    other = names.join(asked, "name").where("symbol <> symbol_asked").select("symbol_asked", "chunk_id", "path", "symbol", F.lit(1).alias("priority")).distinct()
    order = Window.partitionBy("symbol_asked").orderBy("priority", "path", "chunk_id")
    return exact.unionByName(other).withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(1, min(50, limit)))


def longest_prefix(paths: DataFrame, contexts: DataFrame) -> DataFrame:
    """Rows (path, description, path_prefix): of each path the context whose prefix is it or an ancestor, the longest.

    Every ancestor of a path is a row, so the join is on equality; a path without a context has null.
    """
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    ancestors = paths.select("path").distinct().select("path", F.explode(F.array_distinct(F.concat(F.array(F.lit("/")), above))).alias("path_prefix"))
    found = ancestors.join(contexts, "path_prefix").groupBy("path").agg(F.max_by(F.struct("description", "path_prefix"), F.length("path_prefix")).alias("x"))
    return paths.join(found, "path", "left").select(*paths.columns, "x.description", "x.path_prefix")
