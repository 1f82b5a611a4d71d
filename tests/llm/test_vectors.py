"""Vector codes by exponion search, against plain nearest entries and SQL."""

import math
import random

import duckdb
import numpy as np
import pytest

from tidemark.llm import registry, vector_codes
from tidemark.llm.sql import ORACLES

FOLDER = "/root/testdata/sf0.001"


def brute(rows, rounds=2):
    """The contract in plain Python: rows (id, vector, label) -> {id: [(code, error)]}, codebooks."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // 16
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    books = [[cut(first[i], p) for i in sorted(first)[:64]] for p in range(16)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min((dist(cut(v, p), e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(16):
            own = {}
            for _, v, _ in kept:
                own.setdefault(nearest(v, p)[1], []).append(cut(v, p))
            for j, parts in own.items():
                new[p][j] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
        books = new
    out = []
    for i, v, label in kept:
        best = [nearest(v, p) for p in range(16)]
        out.append((i, label, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best)))
    return out, books


def check(spark, rows, kind="long"):
    df = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>, label int")
    got, books = vector_codes.compress(df)
    want, wanted = brute(rows)
    assert books.tolist() == wanted
    assert sorted((str(r["id"]), str(r["label"]), r["code"].hex(), r["error"]) for r in got.collect()) == sorted((str(i), str(x), c, e) for i, x, c, e in want)


@pytest.mark.parametrize("seed", range(3))
def test_codes_equal_plain_search(spark, seed):
    rng = random.Random(seed)
    vector = lambda: [rng.choice([rng.gauss(0, 1), rng.randint(-3, 3) / 256, 0.0]) for _ in range(32)]
    rows = [(i, vector(), rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(1000 + i, list(rows[7][1]), 5) for i in range(200)]  # a hot vector
    check(spark, rows)


def test_edges(spark):
    base = [i / 16 for i in range(16)]
    rows = [(3, base, 1), (3, base, 1), (3, [x + 1 for x in base], 1), (1, None, 1), (2, [], 1), (4, [None, *base[1:]], 1), (5, [float("nan"), *base[1:]], 1), (6, [float("-inf"), *base[1:]], None)]
    rows += [(None, [x - 1 for x in base], None), (8, [-x for x in base], None)]
    check(spark, rows)
    check(spark, [(None if i is None else f"v{i}", v, x) for i, v, x in rows], "string")


def test_other_lengths_and_huge_components_are_dropped(spark):
    rows = [(1, [0.5] * 16, 1), (2, [0.5] * 32, 1), (3, [1e30] + [0.5] * 15, 1), (4, [0.25] * 16, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(r["id"] for r in vector_codes.compress(df)[0].collect()) == [1, 4]
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 15, 1)], "vec_id long, embedding array<double>, label int"))


def test_no_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert vector_codes.compress(df)[0].count() == 0
    df = spark.createDataFrame([(1, [0.5] * 16, 1, 9, "x", b"c", 4)], "vec_id long, embedding array<double>, label int, id int, x string, code binary, error int")
    assert [(r["id"], r["error"]) for r in vector_codes.compress(df)[0].collect()] == [(1, 0)]


def test_radius_is_sufficient_and_saves_distances():
    rng = np.random.default_rng(1)
    entries = rng.integers(-200, 200, (64, 4)) + 1000 * rng.integers(0, 8, (64, 1))
    x = entries[rng.integers(0, 64, 5000)] + rng.integers(-40, 40, (5000, 4))
    book = vector_codes.Codebook(entries)
    before = rng.integers(0, 64, 5000).astype(np.uint8)
    d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    code, far, _ = book.assign(x, before)
    assert (code == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
    again, _, looked = book.assign(x, code.astype(np.uint8))
    assert (again == code).all() and looked < 0.35 * d.size


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    want = con.execute(ORACLES["op11_vector_codes"]).df().sort_values("vec_id").reset_index(drop=True)
    got = registry.queries()["op11_vector_codes"](spark, FOLDER).toPandas().sort_values("vec_id").reset_index(drop=True)
    assert (got[list(want.columns)] == want).all().all()
