"""Phrase collocations by bitmaps against plain counts and SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.llm import collocations, registry
from tidemark.llm.sql import ORACLES

FOLDER = "/root/testdata/sf0.001"


def brute(rows, least=10, top=2000, share=50):
    """The contract in plain Python: rows (lang, text) -> tuples of the result."""
    counts, total = {}, Counter()
    for lang, text in rows:
        own = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(words)
            for k in (1, 2, 3):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cand.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        rows = []
        for p, a in cand.items():
            if len(p) == 2 and longer[p] and 100 * longer[p] >= share * a:
                continue
            score, k = min((collocations.SCALE * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], total[lang], -r[0]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out)


def check(df, **how):
    got = sorted(tuple(r) for r in collocations.collocations(df, **how).collect())
    assert got == brute([(r["lang"], r["text"]) for r in df.collect()], **{k: v for k, v in how.items() if k != "held"})


def texts(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Été", "THE", "the", "a\x00b", "İ", "naïve"]
    fixed = ["one two three", "two three four", "the the the the", "New York"]
    out = []
    for _ in range(n):
        text = " ".join(rng.choice(fixed) if rng.random() < 0.2 else rng.choice(words) + rng.choice(["", "", "", ".", ",", "\t", "\n", "\x0b", " ;"]) for _ in range(rng.randint(0, 120)))
        out.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return out + [("en", "hot words stay together")] * 80


@pytest.mark.parametrize("seed,held,shard", [(1, 1 << 22, 1 << 21), (2, 0, 256), (3, 1 << 22, 64)])
def test_whole_results(spark, monkeypatch, seed, held, shard):
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "HELD", held)
    df = spark.createDataFrame(texts(seed), "lang string, text string").repartition(3)
    check(df, held=held)
    check(df, least=20, top=7, share=90, held=held)


def test_edges(spark, edge_rows):
    check(edge_rows)
    assert collocations.collocations(edge_rows.limit(0)).count() == 0
    assert collocations.collocations(edge_rows.where("text IS NULL OR text = ''")).count() == 0


def test_bitmaps_count_as_positions_do(monkeypatch):
    monkeypatch.setattr(collocations, "SUBTREE", 50)
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 128, 5000):
        places = (rng.zipf(1.4, size) % 40).astype(np.uint32)  # 0 is no word
        rows = list(zip(places.tolist(), places[1:].tolist(), strict=False))
        want = Counter((x << 32) | y for x, y in rows if x and y)
        got = Counter()
        for keys, counts in collocations.pairs_of(places):
            assert len(set(keys.tolist())) == len(keys) and not set(keys.tolist()) & set(got)  # a subtree has whole words
            got.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        assert got == want
        frequent = {k for k, n in want.items() if n >= 4}
        want3 = Counter(((x << 32) | y, z) for (x, y), (_, z) in zip(rows, rows[1:], strict=False) if x and y and z and (x << 32) | y in frequent and (y << 32) | z in frequent)
        got3 = Counter()
        for pair, third, counts in collocations.triples_of(places, np.array(sorted(frequent), np.uint64)):
            got3.update(dict(zip(zip(pair.tolist(), third.tolist(), strict=True), counts.tolist(), strict=True)))
        assert got3 == want3


def test_products_of_large_counts_are_exact(spark):
    a, left, right = 999_999_999_999_989, 999_999_999_999_999, 999_999_999_999_997
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations._score(*(collocations.F.col(c) for c in "alr")).alias("x")).first()["x"]
    assert got == collocations.SCALE * a * a // (left * right)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(ORACLES["op13_phrase_collocations"]).df().sort_values(["lang", "rank"]).reset_index(drop=True)
    got = registry.queries()["op13_phrase_collocations"](spark, FOLDER).toPandas().sort_values(["lang", "rank"]).reset_index(drop=True)
    assert (got[list(want.columns)] == want).all().all()
