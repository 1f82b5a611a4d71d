"""Folders of files as tables: metadata first, contents only of what is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..plans.shared import settle

_BASE = (".git", "node_modules")
# Extensions and folders left out, by mode.
EXTENSIONS = {"obsidian": ("md",), "notes": ("md",), "docs": ("md", "mdx", "rst"), "code": ("rs", "py", "pyi", "ts", "tsx", "js", "jsx", "go", "java", "rb"), "claude-code": ("jsonl",), "codex": ("jsonl",)}
IGNORED = {"obsidian": (*_BASE, ".obsidian", ".trash"), "notes": _BASE, "docs": (*_BASE, "build", "site", "_build", "dist"), "code": (*_BASE, "target", "dist", "build", ".venv", "__pycache__", ".next", ".turbo"), "claude-code": _BASE, "codex": _BASE}
#: Bytes of a body that a batch read and a single read return at most.
MANY_BYTES, ONE_BYTES = 102_400, 1 << 20
#: Files that one scan names.
LISTED = 20_000


def _raw(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(root)


def walk(spark: SparkSession, root: str, mode: str = "notes", source: str = "default", ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows (source, path, mtime, size, uri): the files of a folder that the mode takes, by paths below it.

    No content is read. Folders are left out by their exact name, wherever they are.
    """
    base = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    prefix = root.split("://", 1)[-1].rstrip("/").lstrip("/")
    relative = F.regexp_replace(base, "^/*" + _quoted(prefix) + "/+", "")
    rows = _raw(spark, root).select(F.lit(source).alias("source"), relative.alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), F.col("path").alias("uri"))
    parts = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    left_out = [*IGNORED[mode], *ignore]
    return rows.where(~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in left_out])) | (F.size(parts) == 0)).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS[mode]))


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def bodies(spark: SparkSession, root: str, entries: DataFrame) -> DataFrame:
    """Adds content and content_hash to entries: only their files are opened. What isn't UTF-8 fails the read.

    The files are named to the reader in lists of bounded length, and none is if there are no entries.
    """
    entries = settle(entries, "entries")
    raw, names = None, []

    def close():
        nonlocal raw, names
        part = spark.read.format("binaryFile").option("__globPaths__", "false").load(names).select(F.col("path").alias("uri"), "content")
        raw, names = part if raw is None else raw.unionByName(part), []

    for row in entries.select("uri").toLocalIterator():
        names.append(row["uri"])
        if len(names) == LISTED:
            close()
    if names:
        close()
    raw = spark.createDataFrame([], "uri string, content binary") if raw is None else raw
    joined = entries.join(raw, "uri")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "path")))
    return joined.withColumn("content_hash", F.sha2("content", 256)).withColumn("content", text)


def detect_mode(entries: DataFrame, root: str = "") -> str:
    """What a folder looks like: code if it has at least twice as many code files as notes."""
    name = root.rstrip("/")
    if "/.claude" in name or name.endswith("claude-code"):
        return "claude-code"
    if "/.codex" in name or name.endswith("codex"):
        return "codex"
    if name:
        context = entries.sparkSession.sparkContext
        vault = context._jvm.org.apache.hadoop.fs.Path(f"{name}/.obsidian")
        if vault.getFileSystem(context._jsc.hadoopConfiguration()).exists(vault):
            return "obsidian"
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    row = entries.agg(F.count_if(extension.isin(*EXTENSIONS["code"])).alias("code"), F.count_if(extension == "md").alias("md")).first()
    return "code" if row["code"] and row["code"] >= 2 * row["md"] else "notes"


def list_paths(files: DataFrame, pattern: str) -> DataFrame:
    """The paths that fit a glob, in order."""
    return files.where(tx.glob_match(F.col("path"), pattern)).select("path").orderBy("path")


def multi_get(files: DataFrame, pattern: str, max_bytes: int = MANY_BYTES) -> DataFrame:
    """Rows (path, content, byte_count, truncated) of the files that fit a glob, each cut between characters."""
    fit = files.where(tx.glob_match(F.col("path"), pattern) & F.col("content").isNotNull())
    return fit.select("path", tx.cut_bytes(F.col("content"), max_bytes).alias("content"), F.octet_length("content").cast("long").alias("byte_count"), (F.octet_length("content") > max_bytes).alias("truncated")).orderBy("path")


def get_document(files: DataFrame, path: str, max_bytes: int = ONE_BYTES) -> DataFrame:
    """One file of the index; a path that leaves the folder is refused."""
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"not a path below the folder: {path!r}")
    return files.where(F.col("path") == path).select("path", tx.cut_bytes(F.col("content"), max_bytes).alias("content"), F.octet_length("content").cast("long").alias("byte_count"), (F.octet_length("content") > max_bytes).alias("truncated"))


def transcript_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, line, value): the lines of transcripts in order, also of a file that is read by many tasks."""
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return rows.select("path", F.row_number().over(Window.partitionBy("path").orderBy("block", "at")).alias("line"), "value")
