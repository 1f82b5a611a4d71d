"""Named sources, their settings and their contexts, kept as TOML or as tables."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"[A-Za-z0-9._-]{1,64}")
FIELDS = {"name", "path", "description", "mode", "ignore", "embedder", "ann_floor"}
# The similarity floor by embedder family.
FLOORS = {"code": 0.40, "gemma": 0.50}
DEFAULT_FLOOR = 0.45


@dataclass
class Source:
    name: str
    path: str
    description: str = ""
    mode: str = "notes"
    ignore: tuple[str, ...] = ()
    embedder: str = "hashed-64"
    ann_floor: float | None = None

    def __post_init__(self):
        if not NAME.fullmatch(self.name):
            raise ValueError(f"not a source name: {self.name!r}")

    def floor(self) -> float:
        """The configured floor, or the embedder's."""
        return self.ann_floor if self.ann_floor is not None else next((f for k, f in FLOORS.items() if k in self.embedder), DEFAULT_FLOOR)


@dataclass
class Registry:
    sources: list[Source] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Registry:
        """From TOML with [[source]] tables; unknown fields are an error."""
        out = cls()
        for entry in tomllib.loads(text).get("source", []):
            if unknown := set(entry) - FIELDS:
                raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
            out.add(Source(**entry | ({"ignore": tuple(entry["ignore"])} if "ignore" in entry else {})))
        return out

    def add(self, source: Source) -> None:
        if any(s.name == source.name for s in self.sources):
            raise ValueError(f"there is a source {source.name!r} already")
        self.sources.append(source)

    def register(self, path: str) -> Source:
        """The source of a folder, made with a free name if there is none yet."""
        path = path.rstrip("/")
        if found := next((s for s in self.sources if s.path.rstrip("/") == path), None):
            return found
        base = re.sub(r"[^A-Za-z0-9._-]+", "-", path.rsplit("/", 1)[-1]).strip("-")[:60] or "source"
        name, i = base, 2
        while any(s.name == name for s in self.sources):
            name, i = f"{base}-{i}", i + 1
        self.add(Source(name, path))
        return self.sources[-1]

    def remove(self, name: str) -> bool:
        before = len(self.sources)
        self.sources = [s for s in self.sources if s.name != name]
        return len(self.sources) < before

    def rename(self, name: str, new: str) -> None:
        if any(s.name == new for s in self.sources):
            raise ValueError(f"there is a source {new!r} already")
        self.find(name).name = Source(new, "").name

    def describe(self, name: str, description: str) -> None:
        self.find(name).description = description

    def find(self, name: str) -> Source:
        for s in self.sources:
            if s.name == name:
                return s
        raise KeyError(name)

    def resolve(self, path: str) -> Source | None:
        """The source with the longest folder that is the path or above it."""
        held = [s for s in self.sources if path == s.path.rstrip("/") or path.startswith(s.path.rstrip("/") + "/")]
        return max(held, key=lambda s: len(s.path), default=None)

    def select(self, include: list[str] | None = None, exclude: list[str] | None = None) -> list[Source]:
        if include and exclude:
            raise ValueError("either include or exclude sources")
        for name in [*(include or []), *(exclude or [])]:
            self.find(name)
        chosen = [s for s in self.sources if (not include or s.name in include) and s.name not in (exclude or [])]
        if not chosen:
            raise ValueError("no source is left")
        return chosen

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s.name, s.path, s.description) for s in self.sources], "name string, path string, description string")

    def text(self) -> str:
        """As TOML that ``parse`` reads back: every field."""
        out = []
        for s in self.sources:
            lines = [f"{k} = {json.dumps(getattr(s, k))}" for k in ("name", "path", "description", "mode", "embedder")]
            lines.append(f"ignore = [{', '.join(map(json.dumps, s.ignore))}]")
            if s.ann_floor is not None:
                lines.append(f"ann_floor = {float(s.ann_floor)!r}")
            out.append("\n".join(["[[source]]", *lines, ""]))
        return "\n".join(out)


class RegistryFile:
    """A registry kept in a TOML file: read again when the file has changed; what can't be read leaves the last one."""

    def __init__(self, path: str):
        self.path, self.seen, self.held, self.error = path, None, Registry(), None

    def current(self) -> Registry:
        try:
            found = os.stat(self.path)
            if (found.st_mtime_ns, found.st_size) != self.seen:
                self.seen = (found.st_mtime_ns, found.st_size)
                with open(self.path, encoding="utf-8") as f:
                    self.held, self.error = Registry.parse(f.read()), None
        except (OSError, ValueError, TypeError) as e:
            self.error = e
        return self.held

    def save(self, registry: Registry) -> None:
        """Replace the file's content at once."""
        with open(f"{self.path}.new", "w", encoding="utf-8") as f:
            f.write(registry.text())
        os.replace(f"{self.path}.new", self.path)


def eval_queries(spark: SparkSession, text: str) -> DataFrame:
    """Queries of an evaluation from TOML with [[query]] tables: name, query, relevant."""
    rows = []
    for entry in tomllib.loads(text).get("query", []):
        if unknown := set(entry) - {"name", "query", "relevant"}:
            raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
        rows.append((len(rows), entry.get("name", entry["query"]), entry["query"], list(entry["relevant"])))
    return spark.createDataFrame(rows, "query_id long, name string, text string, relevant array<string>")


def summary(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Each source with the files and chunks it has."""
    counted = chunks.groupBy("source").agg(F.countDistinct("path").alias("files"), F.count("*").alias("chunks"))
    return sources.join(counted, F.col("name") == F.col("source"), "left").select("name", "path", "description", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
