import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import vector as vx
from tidemark.operators import retrieval


def values(spark, data, column, schema="a string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in data], schema).select(column.alias("x")).collect()]


def test_tokens_and_identifiers(spark):
    assert values(spark, ["Café au-lait, foo_bar 2x", ""], tx.tokens(F.col("a"))) == [["cafe", "au", "lait", "foo", "bar", "2x"], []]
    assert values(spark, ["HTTPServer2Go", "snake_case-name", "ns::deep.path"], tx.identifier_words(F.col("a"))) == [["http", "server", "2", "go"], ["snake", "case", "name"], ["ns", "deep", "path"]]
    names = ["a_b", "orders_by", "orders_by_day", "lineItem", "lineItemKey", "LINEITEMKEY", "lineitemkey", "l_ineitem", "éé_éé"]
    assert values(spark, names, tx.is_real_identifier(F.col("a"))) == [len(n.encode()) >= 8 and ("_" in n or n == "lineItem" or n == "lineItemKey") for n in names]


def test_aliases(spark):
    named = spark.createDataFrame([("shipOrder", "cart/Depot::Dock"), ("ship", "cart"), ("ship", ""), ("ship", None), ("", "cart"), (None, "cart"), ("a-b", None)], "s string, h string")
    assert [r[0] for r in named.select(tx.aliases(F.col("s"), F.col("h"))).collect()] == [
        ["shipOrder", "ship order", "ship_order", "ship-order", "cart/Depot::Dock::shipOrder", "cart/Depot::Dock.shipOrder", "cart.Depot.Dock.shipOrder"],
        ["ship", "cart::ship", "cart.ship"],
        ["ship"],
        ["ship"],
        [],
        [],
        ["a-b", "a b", "a_b"],
    ]


def test_snippet_frontmatter_and_cut(spark):
    assert values(spark, ["---\na: 1\n---\n\n  First line \nrest", "x" * 150], tx.snippet(F.col("a"))) == ["First line", "x" * 140 + "…"]
    assert values(spark, ["aé中b"], tx.cut_bytes(F.col("a"), 5)) == ["aé"]
    assert values(spark, ["aé中b"], tx.cut_bytes(F.col("a"), 6)) == ["aé中"]
    assert values(spark, ["ab\ncd\nef"], tx.line_of(F.col("a"), F.lit(4))) == [2]


@pytest.mark.parametrize(("pattern", "path", "fits"), [("*.md", "a.md", True), ("*.md", "x/a.md", False), ("**/*.md", "x/y/a.md", True), ("**/*.md", "a.md", True), ("src/{a,b}?.rs", "src/a1.rs", True), ("src/[!a]*.rs", "src/abc.rs", False)])
def test_glob(spark, pattern, path, fits):
    assert values(spark, [path], tx.glob_match(F.col("a"), pattern)) == [fits]


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(vx.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_bm25_is_that_of_fts5(spark):
    texts = ["the quick brown fox", "the lazy dog and the quick cat", "foo_bar baz foo-bar", "café culture, brown dog", "brown brown brown", "nothing here", "a foo and a bar"]
    asked = ["quick brown", "foo_bar", "cafe dog", "brown brown quick", "foo-bar baz"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(c)")
    con.executemany("INSERT INTO t(rowid, c) VALUES (?, ?)", enumerate(texts))
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieval.bm25_scores(queries, chunks).collect()}
    for i, q in enumerate(asked):
        match = " OR ".join(f'"{w}"' for w in q.split())
        want = {(i, rowid): -score for rowid, score in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
        assert {k: round(v, 9) for k, v in got.items() if k[0] == i} == {k: round(v, 9) for k, v in want.items()}


def arm_of(spark, ids):
    return spark.createDataFrame([(7, c, 1.0, r) for r, c in enumerate(ids, 1)], "query_id long, chunk_id long, score double, rank int")


def test_fusion_by_its_formula(spark):
    """Every chunk's sum over the arms that hold it, with what the first three ranks get besides, and weights by name."""
    lists = {"fts": [10, 20, 30, 40, 50], "prf": [50, 60, 10], "own": [70]}
    fused = {r["chunk_id"]: r for r in retrieval.fuse({k: arm_of(spark, ids) for k, ids in lists.items()}, {"fts": 2.0, "prf": 0.5, "own": 1.0}).collect()}
    for chunk in {c for ids in lists.values() for c in ids}:
        want = 0.0
        for name, ids in lists.items():
            if chunk in ids:
                rank = ids.index(chunk) + 1
                assert fused[chunk][f"{name}_rank"] == rank
                want += {"fts": 2.0, "prf": 0.5, "own": 1.0}[name] * (1 / (60 + rank) + (0.05 if rank == 1 else 0.02 if rank < 4 else 0))
        assert abs(fused[chunk]["score"] - want) < 1e-12


def test_overlays(spark):
    scored = spark.createDataFrame([(7, 10, 0.9), (7, 20, 0.6), (7, 30, 0.3), (8, 10, 5.0)], "query_id long, chunk_id long, score double")
    normal = {(r["query_id"], r["chunk_id"]): round(r["score"], 9) for r in retrieval.normalise(scored).collect()}
    assert normal == {(7, 10): 1.0, (7, 20): round(2 / 3, 9), (7, 30): round(1 / 3, 9), (8, 10): 1.0}
    sides = spark.createDataFrame([(7, 0, 20, 4.0), (7, 0, 30, 1.0), (7, 1, 20, 2.0), (7, 1, 10, 8.0)], "query_id long, side int, chunk_id long, score double")
    both = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieval.intersect(scored, sides).collect()}
    assert both.keys() == {(7, 20), (8, 10)}  # a query without sides keeps what it has
    assert abs(both[7, 20] - 3 / (1 / (2 / 3) + 1 / 1.0 + 1 / 0.25)) < 1e-9
    left = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieval.exclude(retrieval.normalise(scored), sides.where("side = 0")).collect()}
    assert left.keys() == {(7, 10), (7, 30), (8, 10)} and abs(left[7, 30] - (1 / 3 - 0.5 * 0.25)) < 1e-9


def test_confidence_by_rule(spark):
    """All ways in which arms can agree, against the rule in plain words."""
    cases = [(sim, same_chunk, same_file, literal) for sim in (None, 0.1, 0.449, 0.5, 0.9) for same_chunk in (False, True) for same_file in (False, True) for literal in (False, True) if same_file or not same_chunk]
    chunks = spark.createDataFrame([(1, "f"), (2, "f"), (3, "g")], "chunk_id long, path string")
    ids = range(len(cases))
    arm = lambda of: spark.createDataFrame([(i, of(cases[i]), 1) for i in ids], "query_id long, chunk_id long, rank int")
    ann = arm(lambda c: 1 if c[1] else 2 if c[2] else 3)
    literal = spark.createDataFrame([(i, 1 if cases[i][3] else 3) for i in ids], "query_id long, chunk_id long")
    final = spark.createDataFrame([(i, 1, 0.5, 1) for i in ids], "query_id long, chunk_id long, score double, rank int")
    similarity = spark.createDataFrame([(i, cases[i][0]) for i in ids], "query_id long, top_ann_similarity double")
    got = {r["query_id"]: r for r in retrieval.confidence(arm(lambda c: 1), ann, literal, final, chunks, similarity, floor=0.45).collect()}
    for i, (sim, same_chunk, same_file, exact) in enumerate(cases):
        known = sim or 0.0
        assert got[i]["low_confidence"] == (not exact and not same_file and known < 0.45)
        assert got[i]["confidence"] == (1.0 if exact else max(known, 0.6) if same_file else known)
        assert (got[i]["file_agreement"], got[i]["chunk_agreement"], got[i]["strong_literal"]) == (same_file, same_chunk, exact)


def test_aliases_part_a_name_once(spark):
    named = spark.createDataFrame([("shipOrder", "cart")], "s string, h string").select(tx.aliases(F.col("s"), F.col("h")).alias("names"))
    plan = named._jdf.queryExecution().analyzed().toString()
    assert plan.count(r"(\p{Ll})(\p{Lu})") == 1  # it was parted anew for each way of spelling
