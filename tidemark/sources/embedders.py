"""Vectors of chunks from a model behind an HTTP service, asked for in batches from the tasks."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import ready


@dataclass
class HttpEmbedder:
    """A service that answers {"model", "input": [texts]} with {"data": [{"index", "embedding"}]}.

    A request that fails on the way, is refused for now (429) or fails in the service (5xx) is sent again, ``attempts``
    times in all, after a wait that doubles up to ``longest`` seconds or that the service asks for in Retry-After. Any
    other answer is an error, and so are answers of another number or length of vectors than asked for.
    """

    url: str
    model: str
    dims: int
    key: str = ""
    send_dims: bool = False
    batch: int = 100
    attempts: int = 4
    first_wait: float = 0.2
    longest: float = 4.0
    timeout: float = 60.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        """The vectors of texts, in their order."""
        return [v for i in range(0, len(texts), self.batch) for v in self._ask(texts[i : i + self.batch])]

    def _ask(self, texts: list[str]) -> list[list[float]]:
        body = {"model": self.model, "input": texts} | ({"dimensions": self.dims} if self.send_dims else {})
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        wait = self.first_wait
        for left in range(self.attempts - 1, -1, -1):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), head), timeout=self.timeout) as answer:
                    return self._checked(json.load(answer), len(texts))
            except urllib.error.HTTPError as e:
                if not left or not (e.code == 429 or e.code >= 500):
                    raise RuntimeError(f"the embedder answered {e.code}: {e.read(300).decode('utf-8', 'replace')}") from e
                asked = e.headers.get("Retry-After", "")
                time.sleep(float(asked) if asked.isdigit() else wait)
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                if not left:
                    raise RuntimeError(f"the embedder can't be reached: {e}") from e
                time.sleep(wait)
            wait = min(2 * wait, self.longest)
        raise AssertionError("not reached")

    def _checked(self, answer: dict, n: int) -> list[list[float]]:
        rows = sorted(answer["data"], key=lambda x: x["index"])
        if [x["index"] for x in rows] != list(range(n)):
            raise RuntimeError(f"the embedder gave {len(rows)} vectors for {n} texts")
        if odd := next((len(x["embedding"]) for x in rows if len(x["embedding"]) != self.dims), None):
            raise RuntimeError(f"the embedder gave a vector of {odd} numbers instead of {self.dims}")
        return [x["embedding"] for x in rows]

    def vectors(self, rows: DataFrame, text: Column, keep: tuple[str, ...] = ("chunk_id", "path")) -> DataFrame:
        """The ``keep`` columns and the ``embedding`` of each row's text; null texts are asked for as empty ones."""
        ready(rows.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, whole.num_rows, self.batch):  # what is asked at a time is held at a time
                    part = whole.slice(i, self.batch)
                    found = pa.array(self.embed([t or "" for t in part.column(len(keep)).to_pylist()]), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], found], [*keep, "embedding"])

        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
        return rows.select(*keep, text.alias("_text")).mapInArrow(run, f"{kinds}, embedding array<double>")
