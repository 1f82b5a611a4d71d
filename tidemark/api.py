"""The library's tools over named, indexed sources: each takes plain arguments and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import evaluate, navigate, retrieval, usage
from .operators.incremental import Store
from .plans import index
from .plans.shared import settle
from .sources import files as sources
from .sources.registry import Registry, summary

# Prompts that no corpus answers.
NONSENSE = (
    "the most contrarian opinion I hold",
    "something I changed my mind about",
    "advice I would give my younger self",
    "what is the meaning of life",
    "my favorite childhood memory",
    "how do I feel about the weather today",
)


def clamped(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


class Library:
    """Sources by name, each with its index below ``folder``."""

    def __init__(self, spark: SparkSession, registry: Registry, folder: str):
        self.spark, self.registry, self.folder = spark, registry, folder.rstrip("/")

    def store(self, source: str) -> Store:
        return Store(self.spark, f"{self.folder}/{source}")

    def names(self, source: str | None = None) -> list[str]:
        return [source] if source else [s.name for s in self.registry.sources if self.store(s.name).manifest()["version"]]

    def refresh(self, source: str) -> DataFrame:
        return index.refresh(self.spark, self.registry.find(source), self.store(source))

    def _of(self, table: str, source: str | None) -> DataFrame | None:
        """A table of one source or of all indexed ones, with the source's name."""
        out = None
        for name in self.names(source):
            one = self.store(name).read(table)
            if one is not None:
                one = one.withColumn("source", F.lit(name))
                out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def list_sources(self) -> DataFrame:
        chunks = self._of("chunks", None)
        chunks = self.spark.createDataFrame([], "source string, path string") if chunks is None else chunks
        return summary(chunks, self.registry.frame(self.spark))

    def search(self, texts: list[str], source: str | None = None, top_k: int = 10, output: str = "chunks", all_of: list[str] | None = None, none_of: list[str] | None = None, log: bool = False, **options) -> tuple[DataFrame, DataFrame]:
        """(hits, confidence) of a batch of queries over one source or all; the best source decides the confidence.

        ``output='files'`` leaves the texts out. With ``log`` the searches are added to the sources' usage log.
        """
        queries = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
        sides = lambda terms: None if not terms else self.spark.createDataFrame([(q, i, t) for q in range(len(texts)) for i, t in enumerate(terms)], "query_id long, side int, text string")
        hits = trust = None
        for name in self.names(source):
            floor = self.registry.find(name).floor()
            found, own = index.search(self.store(name), queries, top_k=top_k, floor=self.store(name).manifest()["meta"].get("floor", floor), all_of=sides(all_of), none_of=sides(none_of), **options)
            found, own = found.withColumn("source", F.lit(name)), own.withColumn("source", F.lit(name))
            if log:
                self._log(name, queries, found)
            hits, trust = (found, own) if hits is None else (hits.unionByName(found, allowMissingColumns=True), trust.unionByName(own))
        if hits is None:
            raise ValueError("no source is indexed")
        merged = retrieval.merge_sources(hits, clamped(top_k, 1, 50))
        if output == "files":
            merged = merged.withColumn("snippet", F.lit("")).withColumn("heading_path", F.lit(""))
        best = hits.where("rank = 1").select("query_id", "source", "score")
        joined = trust.join(best, ["query_id", "source"])
        verdict = joined.groupBy("query_id").agg(F.bool_and("low_confidence").alias("low_confidence"), F.max_by("confidence", F.struct("score", "source")).alias("confidence"))
        return merged, verdict

    def _log(self, name: str, queries: DataFrame, hits: DataFrame) -> None:
        """Append the searches and what they returned to the source's log."""
        listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("returned_chunks"))
        rows = queries.join(listed, "query_id", "left").select(F.expr("uuid()").alias("search_id"), "text", "returned_chunks", F.unix_timestamp().alias("created_at"))
        rows.write.mode("append").parquet(f"{self.folder}/{name}/usage")

    def attribute(self, source: str, reads: DataFrame) -> DataFrame:
        """Which logged search each read (read_id, chunk_id, read_at) came from."""
        log = self.spark.read.parquet(f"{self.folder}/{source}/usage")
        searches = log.select("search_id", F.explode("returned_chunks").alias("chunk_id"), F.col("created_at").alias("search_at"))
        return usage.attribute(reads, searches, ["chunk_id"])

    def find_definition(self, symbol: str, source: str | None = None, limit: int = 10) -> DataFrame:
        asked = self.spark.createDataFrame([(symbol,)], "symbol string")
        return navigate.find_definitions(self._of("chunks", source), asked, clamped(limit, 1, 50))

    def find_callers(self, symbol: str, source: str | None = None, depth: int = 1, limit: int = 20) -> DataFrame:
        """Nearest callers first, over all sources."""
        asked, out = self.spark.createDataFrame([(symbol,)], "symbol string"), None
        for name in self.names(source):
            one = index.find_callers(self.store(name), asked, depth, limit).withColumn("source", F.lit(name))
            out = one if out is None else out.unionByName(one)
        return out.orderBy("dist", "source", "path", "caller").limit(clamped(limit, 1, 100))

    def find_implementations(self, symbol: str, source: str | None = None, limit: int = 20) -> DataFrame:
        return navigate.find_implementations(self._of("links", source).drop("path"), self._of("chunks", source).drop("source", "kind"), symbol, limit)

    def repo_map(self, source: str, focus_paths: list[str] | None = None, token_budget: int = 2000) -> DataFrame:
        return index.outline(self.store(source), focus_paths, token_budget)

    def multi_get(self, source: str, pattern: str, max_bytes: int = sources.MANY_BYTES) -> DataFrame:
        return sources.multi_get(self._bodies(source), pattern, max_bytes)

    def get(self, source: str, path: str) -> DataFrame:
        return sources.get_document(self._bodies(source), path)

    def _bodies(self, source: str) -> DataFrame:
        known = self.registry.find(source)
        entries = sources.walk(self.spark, known.path, known.mode, source, known.ignore)
        indexed = self.store(source).read("files").select("path")
        return sources.bodies(self.spark, known.path, entries.join(indexed, "path", "left_semi"))

    def backlinks(self, source: str, path: str) -> tuple[DataFrame, DataFrame]:
        """(files that link to the path, files that it links to)."""
        links, chunks = self.store(source).read("links"), self.store(source).read("chunks")
        return navigate.backlinks(links.drop("path"), chunks, path), navigate.forward_links(links.drop("path"), chunks, path)

    def explain(self, text: str, source: str, top_k: int = 10) -> DataFrame:
        return index.explain(self.store(source), self.spark.createDataFrame([(0, text)], "query_id long, text string"), top_k)

    def calibrate(self, source: str) -> float:
        """Set the source's confidence floor: from how near its own headings, and nonsense, come to its chunks."""
        store = self.store(source)
        chunks, vectors = store.read("chunks"), store.read("vectors")
        heading = F.trim(F.element_at(F.split(F.coalesce("heading_path", F.lit("")), r"[>/]"), -1))
        start = F.array_join(F.slice(F.split(F.trim("content"), r"\s+"), 1, 8), " ")
        own = evaluate.stride_sample(chunks.select("chunk_id", F.when(F.octet_length(heading) >= 4, heading).otherwise(start).alias("text")), "chunk_id", 40)
        positives = own.select(F.col("chunk_id").alias("query_id"), "text")
        others = [(i, t) for i, t in enumerate(NONSENSE)]
        for name in self.names():
            if name != source:
                far = evaluate.stride_sample(self.store(name).read("chunks").select("chunk_id", "content"), "chunk_id", 8)
                others += [(len(others) + i, r["t"]) for i, r in enumerate(far.select(F.array_join(F.slice(F.split(F.trim("content"), r"\s+"), 1, 8), " ").alias("t")).collect())]
        negatives = self.spark.createDataFrame(others, "query_id long, text string")
        floor = self.spark.range(1).select(evaluate.floor_of(F.array(*map(F.lit, self._nearest(positives, vectors))).cast("array<double>"), F.array(*map(F.lit, self._nearest(negatives, vectors))).cast("array<double>"))).first()[0]
        store.write({}, {"floor": float(floor)})
        return float(floor)

    def _nearest(self, queries: DataFrame, vectors: DataFrame) -> list[float]:
        """The cosine of each query's nearest vector: a handful of numbers, as the queries are a bounded sample."""
        from .functions import vector as vx

        asked = settle(index.query_vectors(queries), "asked")
        first = retrieval.vector_arm(asked.select("query_id", "embedding"), vectors, 1)
        joined = first.join(asked.select("query_id", F.col("embedding").alias("q")), "query_id").join(vectors.select("chunk_id", "embedding"), "chunk_id")
        return [r[0] for r in joined.select(vx.cosine(F.col("q"), F.col("embedding"))).collect()]

    def evaluate(self, source: str, queries: DataFrame, top_k: int = 5, use_graph: bool = True) -> DataFrame:
        """Recall and reciprocal rank of queries (query_id, text, relevant)."""
        hits, _ = index.search(self.store(source), queries.select("query_id", "text"), top_k=top_k, use_graph=use_graph)
        relevant = queries.select("query_id", F.explode("relevant").alias("path"))
        return evaluate.metrics(evaluate.first_relevant(hits, relevant, queries))

    def describe_path(self, source: str, prefix: str, description: str) -> None:
        """Set the description of a path and what lies below it; the latest one counts."""
        rows = self.spark.createDataFrame([(prefix, description)], "path_prefix string, description string").withColumn("updated_at", F.unix_timestamp())
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/{source}/contexts")

    def contexts(self, source: str) -> DataFrame:
        """The descriptions of a source's paths; an empty one removes its prefix."""
        order = Window.partitionBy("path_prefix").orderBy(F.desc("updated_at"), F.desc("description"))
        rows = self.spark.read.parquet(f"{self.folder}/{source}/contexts").withColumn("_k", F.row_number().over(order))
        return rows.where("_k = 1 AND description <> ''").drop("_k").orderBy("path_prefix")

    def chunk_kinds(self, source: str | None = None) -> DataFrame:
        """Rows (source, kind, n): the chunks of each kind, most first."""
        return self._of("chunks", source).groupBy("source", "kind").agg(F.count("*").alias("n")).orderBy("source", F.desc("n"), "kind")

    def embedding_cost(self, source: str, per_million: float) -> DataFrame:
        """One row: chunks, tokens they may have (a quarter of the bytes that an embedder sees), and the cost at so much a million."""
        size = F.coalesce(F.sum(F.octet_length(index.embedded())), F.lit(0))
        counted = self.store(source).read("chunks").agg(F.count("*").alias("chunks"), F.floor(size / 4).alias("tokens"))
        return counted.withColumn("cost", F.col("tokens") / 1_000_000 * F.lit(float(per_million)))

    def health(self) -> DataFrame:
        rows = [(s.name, s.path, *(lambda h: (h["age_seconds"], h["schema_matches"], ",".join(h["tables"])))(self.store(s.name).health())) for s in self.registry.sources]
        return self.spark.createDataFrame(rows, "name string, path string, age_seconds long, schema_matches boolean, tables string")
