"""Keeping an index up to date: snapshot differences, renames, and a store of versions."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA_VERSION, CHUNKER_VERSION = "5", "6"
SETTLE_SECONDS, STALE_SECONDS = 60, 2
#: Manifests of a store that are kept, with their tables.
KEPT = 3
#: Segments of a table beyond which the newest are merged.
SEGMENTS = 8


def settled(entries: DataFrame, now: int, seconds: int = SETTLE_SECONDS) -> DataFrame:
    """Only files that haven't changed lately: others are still being written and are left for the next run."""
    return entries.where(F.col("mtime") <= now - seconds)


def snapshot_diff(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (path, action, old_path): insert, update, touch, delete, rename or skip for every path of either side.

    Both have path, mtime, size and content_hash. Same time and size: skip; same content: touch. Of new and gone files
    with the same content, pairs are renames, one to one, in the order of their paths.
    """
    new = entries.select("path", *[F.col(c).alias(f"new_{c}") for c in ("mtime", "size", "content_hash")], F.lit(True).alias("is_new"))
    old = files.select("path", *[F.col(c).alias(f"old_{c}") for c in ("mtime", "size", "content_hash")], F.lit(True).alias("is_old"))
    same = (F.col("new_mtime") == F.col("old_mtime")) & (F.col("new_size") == F.col("old_size"))
    action = F.when(F.col("is_old").isNull(), "insert").when(F.col("is_new").isNull(), "delete").when(same, "skip").when(F.col("new_content_hash") == F.col("old_content_hash"), "touch").otherwise("update")
    rows = new.join(old, "path", "full_outer").select("path", action.alias("action"), F.coalesce("new_content_hash", "old_content_hash").alias("hash"))
    came, gone = rows.where("action = 'insert'").select("path", "hash"), rows.where("action = 'delete'").select(F.col("path").alias("old_path"), "hash")
    # only contents that both came and went are put in order: many new files with equal contents, empty ones say, are not
    shared = rows.where("action IN ('insert', 'delete')").groupBy("hash").agg(F.min("action").alias("a"), F.max("action").alias("b")).where("a <> b").select("hash")
    place = lambda df, path: df.join(shared, "hash").withColumn("k", F.row_number().over(Window.partitionBy("hash").orderBy(path)))
    renames = place(came, "path").join(place(gone, "old_path"), ["hash", "k"]).select("path", "old_path")
    rest = rows.where("action NOT IN ('insert', 'delete')").select("path", "action", F.lit(None).cast("string").alias("old_path"))
    inserts = came.join(renames.select("path"), "path", "left_anti").select("path", F.lit("insert").alias("action"), F.lit(None).cast("string").alias("old_path"))
    deletes = gone.join(renames.select("old_path"), "old_path", "left_anti").select(F.col("old_path").alias("path"), F.lit("delete").alias("action"), F.lit(None).cast("string").alias("old_path"))
    return rest.unionByName(inserts).unionByName(deletes).unionByName(renames.select("path", F.lit("rename").alias("action"), "old_path"))


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("action").agg(F.count("*").alias("n"))


def last_write(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Of rows with the same keys the latest: what an upsert would leave."""
    order = Window.partitionBy(*keys).orderBy(F.desc(at))
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def carry_over(old: DataFrame, diff: DataFrame, fresh: DataFrame) -> DataFrame:
    """A table by path in its next version: kept rows, renamed ones under their new path, and ``fresh`` ones."""
    moved = diff.where("action = 'rename'").select(F.col("old_path").alias("path"), F.col("path").alias("new_path"))
    gone = diff.where("action IN ('update', 'delete', 'insert')").select("path")
    kept = old.join(gone, "path", "left_anti").join(moved, "path", "left")
    kept = kept.withColumn("path", F.coalesce("new_path", "path")).select(*old.columns)
    return kept.unionByName(fresh.select(*old.columns))


class Store:
    """Named tables in versions under a folder: a version is whole once the manifest names it.

    A version is written beside the last one, and then a manifest of the next number, which is renamed into place when it
    is whole; readers take the one of the highest number, so they see either version and never a half. A writer whose
    number another has taken meanwhile takes up that one's tables and tries the next. Tables that only older manifests
    than the last KEPT name are removed.

    A table is a list of segments in the order of their numbers. ``append`` writes a small one, and with it the keys
    whose rows in earlier segments are dead; ``read`` leaves those out. ``compact`` makes one segment of the newest ones
    that are about as large together as the one before them, so a row is written again as often as the logarithm of the
    table's size.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        path, fs = self._fs()
        if not fs.exists(path):
            return []
        found = (re.fullmatch(r"manifest-(\d+)\.json", f.getPath().getName()) for f in fs.listStatus(path))
        return sorted(int(m[1]) for m in found if m)

    def _load(self, number: int) -> dict:
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/manifest-{number:012d}.json").collect()))

    def manifest(self) -> dict:
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else {"version": None, "meta": {}, "tables": {}, "dead": {}, "last": 0}

    def read(self, table: str) -> DataFrame | None:
        held = self.manifest()
        segments = held["tables"].get(table)
        return self._live(segments, held["dead"].get(table, [])) if segments else None

    def _live(self, segments: list, dead: list) -> DataFrame:
        """The rows of segments (number, folder) without those whose keys died in a later one."""
        rows = None
        for number, where in segments:
            one = self.spark.read.parquet(where)
            later = [self.spark.read.parquet(d) for n, d in dead if n > number]
            if later:
                keys = later[0]
                for more in later[1:]:
                    keys = keys.unionByName(more)
                one = one.join(keys, keys.columns, "left_anti").select(one.columns)
            rows = one if rows is None else rows.unionByName(one)
        return rows

    def write(self, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], meta: dict | None = None, partition_by: dict[str, str] | None = None) -> str:
        """Write whole tables as a new version; tables that aren't given stay as they are.

        A function in place of a table is given those written before it, as they will be read.
        """
        version, written = f"v{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}", {}
        for name, df in tables.items():
            if callable(df):
                df = df({k: self.spark.read.parquet(where) for k, where in written.items()})
            written[name] = f"{self.folder}/{version}/{name}"
            writer = df.write
            if partition_by and name in partition_by:
                writer = writer.partitionBy(partition_by[name])
            writer.parquet(written[name])

        def change(now: dict, number: int) -> None:
            for name, where in written.items():
                now["tables"][name] = [[number, where]]
                now["dead"].pop(name, None)

        return self._commit(version, change, meta)

    def append(self, fresh: dict[str, DataFrame], dead: dict[str, DataFrame], meta: dict | None = None, order: dict[str, str] | None = None) -> str:
        """Add rows to tables, whose earlier rows with keys in ``dead`` (rows of some of their columns) are no longer read.

        Files are as many as the rows' size asks for, and sorted by the column in ``order``.
        """
        version, written, gone = f"v{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}", {}, {}
        for kind, tables, into in (("", fresh, written), ("-dead", dead, gone)):
            for name, df in tables.items():
                into[name] = f"{self.folder}/{version}/{name}{kind}"
                df = df.hint("rebalance")
                if order and name in order and not kind:
                    df = df.sortWithinPartitions(order[name])
                df.write.parquet(into[name])

        def change(now: dict, number: int) -> None:
            for name, where in gone.items():
                now["dead"].setdefault(name, []).append([number, where])
            for name, where in written.items():
                now["tables"].setdefault(name, []).append([number, where])

        return self._commit(version, change, meta)

    def compact(self, most: int = SEGMENTS) -> list[str]:
        """Merge the newest segments of each table of more than ``most``; returns the tables that were."""
        held, done, version = self.manifest(), {}, f"v{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        path, fs = self._fs()
        size = lambda where: fs.getContentSummary(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)).getLength()
        for name, segments in held["tables"].items():
            if len(segments) <= most:
                continue
            first, total = len(segments) - 1, size(segments[-1][1])
            while first and (size(segments[first - 1][1]) <= 2 * total or first + 1 > most):
                first -= 1
                total += size(segments[first][1])
            if first == len(segments) - 1:
                continue
            where = f"{self.folder}/{version}/{name}"
            self._live(segments[first:], held["dead"].get(name, [])).write.parquet(where)
            done[name] = (segments[first:], [segments[-1][0], where])

        def change(now: dict, number: int) -> None:
            for name, (merged, one) in done.items():
                segments = now["tables"].get(name, [])
                if all(m in segments for m in merged):  # else another writer has replaced them
                    at = segments.index(merged[0])
                    now["tables"][name] = [*segments[:at], one, *segments[at + len(merged) :]]
                    oldest = now["tables"][name][0][0]
                    now["dead"][name] = [d for d in now["dead"].get(name, []) if d[0] > oldest]

        if done:
            self._commit(version, change, None)
        return sorted(done)

    def _commit(self, version: str, change: Callable[[dict, int], None], meta: dict | None) -> str:
        """Write the next manifest: the last one with a change, which is told the number of its segments."""
        context = self.spark.sparkContext
        jvm, (folder, fs) = context._jvm, self._fs()
        while True:
            numbers = self._numbers()
            now = self._load(numbers[-1]) if numbers else {"meta": {}, "tables": {}, "dead": {}, "last": 0}
            now["last"] += 1
            change(now, now["last"])
            now |= {"version": version, "meta": now["meta"] | (meta or {}) | {"schema_version": SCHEMA_VERSION, "chunker_version": CHUNKER_VERSION, "last_walk_at": int(time.time())}}
            number = numbers[-1] + 1 if numbers else 1
            temporary, final = (jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{x}") for x in (f"new-{uuid.uuid4().hex}.json", f"manifest-{number:012d}.json"))
            out = fs.create(temporary, True)
            out.write(bytearray(json.dumps(now).encode()))
            out.close()
            none = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            try:
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration()).rename(temporary, final, none)
                break
            except Exception:
                fs.delete(temporary, False)
                if number not in self._numbers():
                    raise
        self._clean()
        return version

    @staticmethod
    def _named(held: dict) -> set[str]:
        return {where for group in (held["tables"], held["dead"]) for segments in group.values() for _, where in segments}

    def _clean(self) -> None:
        """Remove all but the last manifests, and the tables that none of these names."""
        jvm, (folder, fs) = self.spark.sparkContext._jvm, self._fs()
        numbers = self._numbers()
        kept = {where for n in numbers[-KEPT:] for where in self._named(self._load(n))}
        for n in numbers[:-KEPT]:
            gone = self._named(self._load(n)) - kept
            for where in gone:
                fs.delete(jvm.org.apache.hadoop.fs.Path(where), True)
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest-{n:012d}.json"), False)

    def stale(self, seconds: int = STALE_SECONDS) -> bool:
        return time.time() - self.manifest()["meta"].get("last_walk_at", 0) >= seconds

    def matches(self, embedder: str, dims: int) -> bool:
        """Whether an index was made with this schema, chunker and embedder; otherwise it must be built anew."""
        meta = self.manifest()["meta"]
        return (meta.get("schema_version"), meta.get("chunker_version"), meta.get("embedder"), meta.get("dims")) == (SCHEMA_VERSION, CHUNKER_VERSION, embedder, dims)

    def health(self) -> dict:
        meta, tables = self.manifest()["meta"], self.manifest()["tables"]
        return {"tables": sorted(tables), "age_seconds": int(time.time() - meta.get("last_walk_at", 0)), "schema_matches": meta.get("schema_version") == SCHEMA_VERSION}
