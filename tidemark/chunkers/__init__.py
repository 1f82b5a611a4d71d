"""Chunkers: a file's text becomes rows of chunks and links.

``chunk_files`` runs one over a table of files (source, path, content). Each file stands alone, so this is a narrow
pass; byte offsets are those of the UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import ready

CHUNK_SCHEMA = "source string, path string, chunk_idx int, heading_path string, content string, start_byte int, end_byte int, kind string, symbol string, parent_chunk_idx int"
LINK_SCHEMA = "source string, path string, source_chunk_idx int, kind string, target_symbol string, target_path string"


@dataclass
class Chunk:
    idx: int
    heading: str
    content: str
    start: int
    end: int
    kind: str = "prose"
    symbol: str | None = None
    parent: int | None = None


@dataclass
class Link:
    chunk: int
    kind: str
    symbol: str
    path: str | None = None


@dataclass
class Parsed:
    chunks: list[Chunk] = field(default_factory=list)
    links: list[Link] = field(default_factory=list)


Chunker = Callable[[str, str], Parsed]


def chunker_for(mode: str, thinking: bool = False) -> Chunker:
    """The chunker of a mode (obsidian, notes, docs, code, claude-code, codex)."""
    from . import code, markdown, transcripts

    if mode in markdown.SIZES:
        return markdown.Markdown(*markdown.SIZES[mode])
    if mode == "code":
        return code.parse
    if mode in transcripts.DIALECTS:
        return transcripts.Transcript(mode, thinking)
    raise ValueError(f"no chunker for mode {mode!r}")


def chunk_files(files: DataFrame, mode: str, thinking: bool = False) -> DataFrame:
    """Rows of chunks; a file of which nothing is left gives none. Null contents are empty."""
    ready(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = chunker_for(mode, thinking)
        for batch in batches:
            rows = [(s, p, c.idx, c.heading, c.content, c.start, c.end, c.kind, c.symbol, c.parent) for s, p, text in zip(batch["source"], batch["path"], batch["content"], strict=True) for c in parse(text or "", p).chunks]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CHUNK_SCHEMA.split(", ")]).astype({"parent_chunk_idx": "Int32"})

    return files.select("source", "path", "content").mapInPandas(run, CHUNK_SCHEMA)


def link_files(files: DataFrame, mode: str, thinking: bool = False) -> DataFrame:
    """Rows of links, from the chunk in which each begins."""
    ready(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = chunker_for(mode, thinking)
        for batch in batches:
            rows = [(s, p, x.chunk, x.kind, x.symbol, x.path) for s, p, text in zip(batch["source"], batch["path"], batch["content"], strict=True) for x in parse(text or "", p).links]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in LINK_SCHEMA.split(", ")])

    return files.select("source", "path", "content").mapInPandas(run, LINK_SCHEMA)


def with_ids(chunks: DataFrame) -> DataFrame:
    """Adds chunk_id: a hash of source, path and place, the same in every run."""
    return chunks.withColumn("chunk_id", F.xxhash64("source", "path", "chunk_idx"))


def links_with_ids(links: DataFrame) -> DataFrame:
    return links.withColumn("source_chunk_id", F.xxhash64("source", "path", F.col("source_chunk_idx")))
