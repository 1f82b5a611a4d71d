"""PartEnum joins: no similar pair escapes, bounds never exceed the truth, and whole results against brute force and SQL."""

import random
import re

import duckdb
import numpy as np
import pytest

from tidemark.llm import partenum, registry
from tidemark.llm.sql import ORACLES

FOLDER = "/root/testdata/sf0.001"


def sets(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words=3, percent=90):
    held = {}
    for i, text in rows:
        if i is not None:
            held.setdefault(i, []).append(sets(text, words))
    label = {i: i for i in held}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(held)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in held[a] for y in held[b]):
                p, q = root(a), root(b)
                label[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def check(spark, rows, df, words=3, percent=90):
    got = partenum.jaccard_join(df, words, percent).collect()
    want = brute(rows, words, percent)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted((str(i), len(sets(t, words)), str(want.get(i))) for i, t in rows)


def emitted(s, percent=90):
    rule = partenum.bands(percent)
    return {x for band in rule.joined(len(s)) for x in partenum.signatures(partenum.cells(s, rule.partitions(band) * 3), len(s), band, percent).tolist()}


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_every_pair_at_the_threshold_shares_a_signature(percent):
    rng = np.random.default_rng(percent)
    for trial in range(1500):
        a = int(rng.choice([rng.integers(5, 60), rng.integers(60, 1500)]))
        b = int(rng.integers(a, a * 100 // percent + 1))
        common = -(-percent * (a + b) // (100 + percent))  # the least intersection that links them
        if common > a:
            continue
        domain = np.unique(rng.integers(0, 1 << 63, a + b + 10, dtype=np.uint64))
        rng.shuffle(domain)
        if trial % 3 == 0:  # all differences in one corner of the domain, or all of the sets
            domain = np.sort(domain)
        x, y = np.sort(domain[:a]), np.sort(np.concatenate((domain[:common], domain[a : a + b - common])))
        assert 100 * common >= percent * (a + b - common)
        if a != b or (x != y).any():
            assert emitted(x, percent) & emitted(y, percent), (a, b)


def test_cells_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(500):
        n, apart, count = int(rng.integers(1, 900)), int(rng.integers(0, 300)), int(rng.integers(3, 300))
        domain = np.unique(rng.integers(0, 1 << (63 if rng.random() < 0.7 else 58), n + apart, dtype=np.uint64))
        rng.shuffle(domain)
        cut = int(rng.integers(0, n))
        x, y = np.sort(domain[:n]), np.sort(domain[cut:])
        true = len(np.setxor1d(x, y))
        assert partenum.least_apart(partenum.cells(x, count), partenum.cells(y, count)) <= true


def test_edges(spark, edge_rows):
    check(spark, [(r["doc_id"], r["text"]) for r in edge_rows.collect()], edge_rows)
    assert partenum.jaccard_join(edge_rows.limit(0)).count() == 0
    named = edge_rows.withColumn("doc_id", edge_rows["doc_id"].cast("string"))
    check(spark, [(r["doc_id"], r["text"]) for r in named.collect()], named)


@pytest.mark.parametrize("seed,small", [(1, 64), (2, 8), (3, 8)])
def test_whole_results(spark, monkeypatch, seed, small):
    monkeypatch.setattr(partenum, "SMALL_LIST", small)
    monkeypatch.setattr(partenum, "BLOCK", 16)
    rng = random.Random(seed)
    out = [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice([12, 60, 150, 400]))] for _ in range(12)]
    while len(out) < 220:  # chains of copies whose ends aren't similar any more, and a large group
        new = list(out[0] if rng.random() < 0.4 else rng.choice(out))
        for _ in range(rng.randint(0, max(1, len(new) // 30))):
            new[rng.randrange(len(new))] = f"x{rng.randint(0, 10**6)}"
        out.append(new if rng.random() < 0.8 else new + [f"y{rng.randint(0, 9)}" for _ in range(len(new) // 15)])
    rows = [(i, " ".join(w)) for i, w in enumerate(out)] + [(300 + i, "Same Text of a hot group that is there often, ten words") for i in range(60)] + [(5, "another text of document five which has two of them now")]
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string"))


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(ORACLES["op12_ngram_jaccard"]).df().sort_values("doc_id").reset_index(drop=True)
    got = registry.queries()["op12_ngram_jaccard"](spark, FOLDER).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[list(want.columns)] == want).all().all()
