"""Language identification by nearest centroid: TF-IDF n-gram vectors, several clustered centroids per language, cosine."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Buckets that the n-grams are hashed into, and the longest n-gram.
BUCKETS, LONGEST = 8192, 3
#: The bound on the sample of labelled texts that the model is fitted to, for each language.
PER_LANGUAGE = 600
#: Centroids of each language.
CENTROIDS = 4
#: A text is rejected where its cosine is below this share of the one that all but so many of the fitted texts of its
#: language reach; so single odd texts among them don't matter.
REJECT_SHARE, ODD = 0.35, 0.05
UNKNOWN = "und"
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is none."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            out[c] = ord(x.lower()[0])
    return out


def counts(text: str) -> np.ndarray | None:
    """How often each bucket's n-grams stand in the whole text; None if it has no letter."""
    points = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate((np.array([32], np.uint32), points, np.array([32], np.uint32)))
    space = points == 32
    points = points[~(space & np.concatenate(([False], space[:-1])))]  # runs of others count as one space
    if len(points) < 2:
        return None
    out, mixed = np.zeros(BUCKETS, np.float32), np.zeros(len(points), np.uint32)
    for n in range(1, LONGEST + 1):
        mixed = (mixed[: len(points) - n + 1] if n > 1 else mixed) * np.uint32(0x01000193) + points[n - 1 :] * _ODD[n - 1]
        out += np.bincount((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19), minlength=BUCKETS)
    return out


assert BUCKETS == 1 << (32 - 19)


class Centroids:
    """The model: inverse document frequencies, unit centroids, their languages, and the cosine that nearly all texts of each reach."""

    def __init__(self, vectors: dict[str, list[np.ndarray]], per_language: int = CENTROIDS):
        n = sum(map(len, vectors.values()))
        seen = sum(((v > 0).astype(np.float64) for vs in vectors.values() for v in vs), np.zeros(BUCKETS))
        self.idf = (np.log((n + 1) / (seen + 1)) + 1).astype(np.float32)
        self.names = sorted(vectors, key=lambda x: (-len(vectors[x]), x))  # of equals, the most frequent comes first
        centres, owner, self.least = [], [], []
        for i, name in enumerate(self.names):
            units = self.units(np.array(vectors[name]))
            found = clusters(units, per_language)
            centres.append(found)
            owner += [i] * len(found)
            self.least.append(float(np.quantile((units @ found.T).max(axis=1), ODD)))
        self.centres = np.concatenate(centres) if centres else np.zeros((0, BUCKETS), np.float32)
        self.owner = np.array(owner, np.int64)

    def units(self, rows: np.ndarray) -> np.ndarray:
        weighed = np.log1p(rows) * self.idf
        return weighed / np.maximum(np.linalg.norm(weighed, axis=1, keepdims=True), 1e-12)

    def predict(self, rows: np.ndarray) -> tuple[list[str], np.ndarray, list[bool]]:
        """Language, cosine and whether it is rejected as too far from every centroid."""
        near = self.units(rows) @ self.centres.T
        best = near.argmax(axis=1)
        score = np.clip(near[np.arange(len(near)), best], 0, 1).astype(np.float64)
        owner = self.owner[best].tolist()
        return [self.names[i] for i in owner], score, [bool(s < REJECT_SHARE * self.least[i]) for s, i in zip(score, owner, strict=True)]


def clusters(units: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; it starts from the row nearest to the mean and then the row farthest from all chosen."""
    chosen = [int((units @ units.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(units)):
        far = (units @ units[chosen].T).max(axis=1)
        if far.min() > 1 - 1e-6:
            break
        chosen.append(int(far.argmin()))
    centres = units[chosen]
    for _ in range(rounds):
        own = (units @ centres.T).argmax(axis=1)
        sums = np.array([units[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        new = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centres):
            break
        centres = new
    return centres.astype(np.float32)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, text_col: str = "text", lang_col: str = "lang") -> Centroids:
    """Fit to a bounded sample: of each language about ``per_language`` different texts, chosen by their hashes, and no more.

    Frequencies by language come from all rows; of copies one is taken. The sampled texts are counted whole where they
    lie, and only a vector of BUCKETS numbers of each goes to the driver, however long it is. Rows with a null text or
    language, or without a letter, teach nothing.
    """
    common.ready(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Centroids({}, centroids)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t) for t in batch.column(1).to_pylist()]
            packed = [None if v is None else zlib.compress(v.astype("<f4").tobytes(), 1) for v in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["lang", "place", "vector"])

    sample = rows.withColumn("place", place).where(F.col("place") < share[F.col("lang")]).dropDuplicates(["lang", "text"])
    vectors: dict[str, list[tuple[float, bytes]]] = {}
    for row in sample.select("lang", "text", "place").mapInArrow(count, "lang string, place double, vector binary").where("vector IS NOT NULL").toLocalIterator():
        vectors.setdefault(row["lang"], []).append((row["place"], bytes(row["vector"])))
    taken = {lang: [np.frombuffer(zlib.decompress(v), "<f4") for _, v in sorted(own)[:per_language]] for lang, own in vectors.items()}
    return Centroids(taken, centroids)


def identify(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row's id, ``lang_pred``, ``score`` (cosine) and ``rejected``, and the ``carry`` columns.

    A narrow pass over whole texts, by the text alone. A null text or one without a letter is ``und``, score 0, and
    rejected; so is every text if the model has learned no language. Of centroids equally near, the language with more
    fitted rows wins. Repeated rows and null ids are kept.
    """
    known = common.ready(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), [True] * len(texts)
            rows: list[int] = []
            vectors: list[np.ndarray] = []
            for i, text in enumerate(texts):
                if text and model.names and (v := counts(text)) is not None:
                    rows.append(i)
                    vectors.append(v)
                if rows and (len(rows) == 128 or i == len(texts) - 1):
                    for j, name, s, r in zip(rows, *model.predict(np.array(vectors)), strict=True):
                        lang[j], score[j], rejected[j] = name, s, r
                    rows, vectors = [], []
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(score), pa.array(rejected), *batch.columns[1:]], ["_lang", "_score", "_rejected", *batch.schema.names[1:]])

    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    found = rows.mapInArrow(run, f"_lang string, _score double, _rejected boolean, {', '.join(kinds)}")
    return found.select(F.col("_id").alias(id_col), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])


def fold(id_col: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside fold 2 of 4."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 4) != 2))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
