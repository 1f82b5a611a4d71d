"""Benchmark passages in documents, by an FM-index of each shard and backward search of the benchmark's windows."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .fm_index import FMIndex
from .licenses import WORDS
from .near_dups import word_hashes

WINDOW = 8
#: Words of one shard, whose index is made once and searched for every block of the benchmark.
SHARD = 1_000_000
#: Bytes of benchmark text in one block; each block is searched in turn, so what a task holds of it is bounded.
BLOCK_BYTES = 8_000_000
WORD = re.compile(rb"[^ ]+")
Spans = list[tuple[int, int]]


class Phrases:
    """The windows of a block of benchmark items as rows of word hashes, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        found: dict[bytes, set[str | None]] = defaultdict(set)
        for name, text in items:
            words = word_hashes(text, WORDS)
            for i in range(max(1, len(words) - window + 1) if len(words) else 0):
                found[words[i : i + window].tobytes()].add(name)
        keys = sorted(found)
        self.items = [sorted(found[key], key=_order) for key in keys]
        self.lengths = np.array([len(key) // 8 for key in keys], np.int64)
        self.rows = np.zeros((len(keys), window), np.uint64)
        for row, key in enumerate(keys):
            self.rows[row, : len(key) // 8] = np.frombuffer(key, np.uint64)


def _order(name: str | None) -> tuple[bool, str]:
    return name is not None, name or ""


def merge(spans: Spans) -> Spans:
    out: Spans = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass
class Found:
    """A batch of documents and what has been found in each so far."""

    batch: pa.RecordBatch
    n_words: list[int] = field(default_factory=list)
    spans: dict[int, Spans] = field(default_factory=lambda: defaultdict(list))
    items: dict[int, set] = field(default_factory=lambda: defaultdict(set))


class Shard:
    """Runs of words of documents, each run ended by a 0, that get one FM-index."""

    def __init__(self):
        self.runs: list[tuple[Found, int, int]] = []  # the batch, the document and the run's first word in it
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, found: Found, doc: int, first: int, words: np.ndarray) -> None:
        self.runs.append((found, doc, first))
        self.parts.append(words)
        self.size += len(words)

    def search(self, blocks: list) -> None:
        """Hand each document the word spans and the items of the windows that occur in it."""
        if not self.size:
            return
        vocabulary, ids = np.unique(np.concatenate(self.parts), return_inverse=True)
        ends = np.cumsum([len(p) for p in self.parts])
        text = np.insert(ids.astype(np.int32) + 1, ends, 0)
        begins = ends - [len(p) for p in self.parts] + np.arange(len(ends))
        index = FMIndex(text, len(vocabulary))
        for block in blocks:
            phrases = block.value
            symbols = np.minimum(np.searchsorted(vocabulary, phrases.rows), len(vocabulary) - 1)
            known = (vocabulary[symbols] == phrases.rows) | (np.arange(phrases.rows.shape[1]) >= phrases.lengths[:, None])
            some = np.flatnonzero(known.all(axis=1))
            low, high = index.search(symbols[some] + 1, phrases.lengths[some])
            n = high - low
            which = np.repeat(some, n)
            at = index.locate(np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n))
            run = np.searchsorted(begins, at, "right") - 1
            for r, a, phrase in zip(run.tolist(), (at - begins[run]).tolist(), which.tolist(), strict=True):
                found, doc, first = self.runs[r]
                found.spans[doc].append((first + a, first + a + int(phrases.lengths[phrase])))
                found.items[doc].update(phrases.items[phrase])
            if len(blocks) > 1:  # one block at a time; it is read again from where Spark keeps it
                block.__dict__.pop("_value", None)


def cut_words(text: str, spans: Spans) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw.translate(WORDS))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of at most ``limit`` bytes (or one item), fetched partition by partition."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
    for name, text in rows.toLocalIterator():
        if block and size + len(text) * 4 > limit:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += len(text.encode("utf-8", "surrogatepass"))
    if block:
        yield block


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", carry: tuple[str, ...] = (), cut: bool = False) -> DataFrame:
    """Each row's id, ``text``, ``n_words``, merged word ``spans``, ``items`` (sorted names) and ``carry`` columns.

    With ``cut`` the text comes without the words of the spans, which count words of the text as it was.

    A narrow pass over the documents. A task gathers SHARD words of whole texts (of longer ones, pieces that overlap by
    all but one word of a window), indexes them once, and searches each block of the benchmark in the index. Words are
    compared by 64-bit hashes. Null texts have no words; items without words have no window; repeated rows, items and
    null ids are kept; an item without an id is counted but has no name; an empty benchmark hits nothing.
    """
    spark = common.ready(docs.sparkSession)
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    blocks = [spark.sparkContext.broadcast(Phrases(b, window)) for b in _blocks(benchmark, item_col, item_text, block_bytes)]

    def done(found: Found) -> pa.RecordBatch:
        n = found.batch.num_rows
        spans = [merge(found.spans[i]) if i in found.spans else [] for i in range(n)]
        items = [sorted(found.items[i], key=_order) if i in found.items else [] for i in range(n)]
        texts = found.batch.column(1)
        if cut and found.spans:
            texts = pa.array([cut_words(t, s) if s else t for t, s in zip(texts.to_pylist(), spans, strict=True)], pa.string())
        columns = [pa.array(found.n_words, pa.int64()), pa.array([[{"first": a, "end": b} for a, b in x] for x in spans], span), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([found.batch.column(0), texts, *columns, *found.batch.columns[2:]], ["_id", "_text", "_n", "_spans", "_items", *found.batch.schema.names[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting = Shard(), []
        for batch in batches:
            found, closed = Found(batch), False
            for doc, text in enumerate(batch.column(1).to_pylist()):
                words = word_hashes(text, WORDS) if text else np.zeros(0, np.uint64)
                found.n_words.append(len(words))
                for first in range(0, max(1, len(words) - window + 1) if len(words) else 0, SHARD):
                    shard.add(found, doc, first, words[first : first + SHARD + window - 1])
                    if shard.size >= SHARD:
                        shard.search(blocks)
                        shard, closed = Shard(), True
            if closed:  # what came before this batch has been searched whole
                yield from map(done, waiting)
                waiting = []
            waiting.append(found)
        shard.search(blocks)
        yield from map(done, waiting)

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields]
    rows = rows.mapInArrow(run, ", ".join([*kinds[:2], "_n long, _spans array<struct<first:bigint,end:bigint>>, _items array<string>", *kinds[2:]]))
    return rows.select(F.col("_id").alias(id_col), F.col("_text").alias("text"), F.col("_n").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    n_items = F.size("items").cast("long")
    return found.select(id_col, "n_words", hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op8_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, by windows of eight words."""
    return digest(find_passages(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")))
