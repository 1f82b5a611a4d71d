"""Short licence notices, exact and with a few errors: pigeonhole seeds find candidates, bounded-error matching verifies."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Phrases whose exact places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices searched with errors, and their labels.
NOTICES = {
    "general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "all rights reserved": "reserved",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under the apache license": "apache",
    "permission is hereby granted free of charge": "mit",
    "released under the mit license": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "dedicated to the public domain": "public-domain",
    "free and unencumbered software released into the public domain": "unlicense",
    "do what the fuck you want to public license": "wtfpl",
    "permission to use copy modify and or distribute this software": "isc",
}
#: One error is allowed for so many characters of a notice.
PER_ERROR = 10
#: Bytes of words: digits, small letters and whatever isn't ASCII; the rest becomes space.
WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The words of a text, in UTF-8, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split()


class Notice:
    """A phrase of words with the errors it may have, its seeds and its pattern.

    With k errors at most, one of k + 1 parts of the phrase stands in the text unchanged.
    """

    def __init__(self, phrase: str, label: str, per_error: int = PER_ERROR):
        import regex

        self.phrase, self.label, self.errors = phrase, label, len(phrase) // per_error
        n, parts = len(phrase), self.errors + 1
        edges = [i * n // parts for i in range(parts + 1)]
        self.seeds = [(phrase[a:b].encode(), a) for a, b in zip(edges, edges[1:], strict=False)]
        self.pattern = regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(phrase, literal_spaces=True)}){{e<={self.errors}}}(?![^ ])")

    def matches(self, window: str) -> list:
        """The best match, and likewise those in what lies before it and after it, from left to right."""
        found, open_parts = [], [(0, len(window))]
        while open_parts:
            start, end = open_parts.pop()
            if end - start >= len(self.phrase) - self.errors and (m := self.pattern.search(window, start, end)):
                found.append(m)
                open_parts += [(start, m.start()), (m.end(), end)]
        return sorted(found, key=lambda m: m.start())

    def places(self, line: bytes) -> Iterator[tuple[int, int, int]]:
        """(start, end, errors) in bytes of ``line``, words with one space between and around them; from left to right, not overlapping, better ones first where some would overlap."""
        windows: list[list[int]] = []
        n, e = len(self.phrase), self.errors
        for seed, offset in self.seeds:
            at = line.find(seed)
            while at >= 0:
                windows.append([max(0, at - offset - e - 1), min(len(line), at - offset + n + e + 1)])
                at = line.find(seed, at + 1)
        merged: list[list[int]] = []
        for a, b in sorted(windows):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            a, b = line.rfind(b" ", 0, a + 1), line.find(b" ", b - 1)  # whole words only
            a, b = max(a, 0), b if b >= 0 else len(line)
            window = line[a:b].decode("utf-8", "replace")
            at, done = a, 0  # bytes of the line and characters of the window that have been gone through
            for m in self.matches(window):
                start = at + len(window[done : m.start()].encode())
                at, done = start + len(window[m.start() : m.end()].encode()), m.end()
                yield start + (line[start : start + 1] == b" "), at, sum(m.fuzzy_counts)


@lru_cache(maxsize=8)
def notices(items: tuple[tuple[str, str], ...], per_error: int) -> list[Notice]:
    return [Notice(p, label, per_error) for p, label in items]


def base_places(words: list[bytes], line: bytes, base: dict[str, str]) -> list[tuple[int, str]]:
    """(first word, label) for each place where a phrase's words stand one after the other."""
    out = []
    for phrase, label in base.items():
        look = b" " + phrase.encode() + b" "
        at, done, word = line.find(look), 0, -1
        while at >= 0:
            word += line.count(b" ", done, at + 1)
            done = at + 1
            out.append((word, label))
            at = line.find(look, at + 1)
    return out


def scan(text: str, base: dict[str, str], fuzzy: list[Notice]) -> dict:
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    exact = base_places(words, line, base)
    spans = []
    for notice in fuzzy:
        done, first = 0, -1
        for start, end, errors in notice.places(line):
            first, done = first + line.count(b" ", done, start), start
            spans.append({"label": notice.label, "first_word": first, "last_word": first + line.count(b" ", start, end), "errors": errors, "score": 1 - errors / len(notice.phrase)})
    return {"n_words": len(words), "base": [{"label": x, "word": w} for w, x in sorted(exact)], "spans": sorted(spans, key=lambda s: (s["first_word"], s["label"]))}


def find_notices(docs: DataFrame, base: dict[str, str] | None = None, phrases: dict[str, str] | None = None, per_error: int = PER_ERROR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, ``n_words``, exact places ``base`` and fuzzy ``spans`` (label, words, errors, score).

    A narrow pass over whole texts. Null and empty texts have no words; repeated rows and null ids are kept; no other
    column is read.
    """
    common.ready(docs.sparkSession)
    base = BASE if base is None else base
    items = tuple((NOTICES if phrases is None else phrases).items())
    kind = "struct<n_words:bigint,base:array<struct<label:string,word:bigint>>,spans:array<struct<label:string,first_word:bigint,last_word:bigint,errors:bigint,score:double>>>"
    arrow = pa.struct([("n_words", pa.int64()), ("base", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int64()), ("score", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fuzzy = notices(items, per_error)
        for batch in batches:
            found = [scan(t or "", base, fuzzy) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], ["id", "found"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, found {kind}")
    return found.select(F.col("id").alias(id_col), "found.*")


def op3_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    found = find_notices(common.table(spark, sf_dir, "documents"))
    labels = lambda *columns: F.array_join(F.array_sort(F.array_distinct(F.concat(*columns))), ",")
    exact = F.col("base.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        labels(exact).alias("base_labels"),
        labels(exact, F.col("spans.label")).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.score"), F.lit(0.0))).alias("score"),
        F.to_json("spans").alias("spans"),
    )
