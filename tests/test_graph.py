import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, graph, navigate, usage


def dense_pagerank(edges, seeds, rounds=30, damping=0.85):
    """Power iteration with a full matrix."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)} | {n for n, _ in seeds})
    at, n = {x: i for i, x in enumerate(nodes)}, len(nodes)
    step = np.zeros((n, n))
    for a, b, w in edges:
        step[at[b], at[a]] += w
    out = step.sum(axis=0)
    step = np.where(out > 0, step / np.where(out > 0, out, 1), 1 / n)
    seed = np.zeros(n)
    for x, w in seeds:
        seed[at[x]] += w
    seed = seed / seed.sum() if seed.sum() else np.full(n, 1 / n)
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        rank = (1 - damping) * seed + damping * step @ rank
    return dict(zip(nodes, rank.tolist(), strict=True))


@pytest.mark.parametrize("held", [graph.HELD_EDGES, 0])
def test_pagerank_by_power_iteration(spark, held):
    rng = random.Random(held)
    edges = [(rng.randint(0, 25), rng.randint(0, 30), rng.choice([0.3, 0.5, 1.0])) for _ in range(60)]
    seeds = {0: [(3, 1.0)], 1: [(4, 2.0), (99, 1.0)], 2: [(5, 0.0), (6, 0.0)]}
    rows = [(q, n, w) for q, own in seeds.items() for n, w in own]
    found = graph.personalized_pagerank(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame(rows, "query_id long, node long, weight double"), held=held).collect()
    for q, own in seeds.items():
        want = dense_pagerank(edges, own)
        got = {r["node"]: r["mass"] for r in found if r["query_id"] == q}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


@pytest.mark.parametrize("sinks", [True])
def test_pushed_mass_is_within_its_bound(spark, sinks):
    rng = random.Random(5)
    edges = [(f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 30)}", rng.choice([0.3, 0.5, 1.0])) for _ in range(60)]
    if not sinks:
        edges += [(b, a, w) for a, b, w in edges]
    seeds = {0: [("n3", 1.0)], 1: [("n4", 2.0), ("far", 1.0)], 2: [("n5", 0.0)]}
    frame = spark.createDataFrame(edges, "src string, dst string, weight double")
    rows = spark.createDataFrame([(q, n, w) for q, own in seeds.items() for n, w in own], "query_id long, node string, weight double")
    near, rest = graph.pushed_pagerank(frame, rows, least=1e-3)
    for r in rest.where("query_id = 0").collect():
        want = dense_pagerank(edges, seeds[0], rounds=300)
        got = {x["node"]: x["mass"] for x in near.where("query_id = 0").collect()}
        assert all(got[x] <= want[x] + 1e-9 for x in got) and 1 - r["lost"] - sum(got.values()) <= r["left"] + 1e-9
    wanted = spark.createDataFrame([(q, n) for q in seeds for n in ("n1", "n7", "far")], "query_id long, node string")
    found = {(r["query_id"], r["node"]): r["mass"] for r in graph.mass_around(frame, rows, wanted, held=0, least=1e-4).collect()}
    for q, own in seeds.items():
        want = dense_pagerank(edges, own, rounds=300)
        for n in ("n1", "n7", "far"):
            assert (q, n) in found if n in want else (q, n) not in found
        heaviest = max(want.values())
        assert q == 2 or any(abs(v - heaviest) < 5e-3 for (k, _), v in found.items() if k == q)
        assert all(abs(v - want[n]) < 5e-3 for (k, n), v in found.items() if k == q)


def test_keyphrase_edges(spark):
    texts = ["Copper pipe fittings, and copper pipe sealant", "copper pipe sealant for the roof", "a roof of slate", "pipe"]
    phrases = graph.keyphrases(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string"))
    first = {r["phrase"]: round(r["score"], 6) for r in phrases.where("chunk_id = 0").collect()}
    assert first == {"copper pipe fittings": 9.0, "copper pipe sealant": 9.0}  # each of the words is in runs of three alone
    assert [(r["src"], r["dst"], r["weight"]) for r in graph.keyphrase_edges(phrases).collect()] == [(0, 1, 3.0)]
    assert graph.keyphrase_edges(phrases, most_chunks=1).count() == 0 and graph.keyphrases(spark.createDataFrame([(1, "the of"), (2, ""), (3, None)], "chunk_id long, content string")).count() == 0


def test_keyphrases_of_pieces_of_a_batch(monkeypatch):
    monkeypatch.setattr(graph, "PHRASE_WORDS", 50)
    rng = random.Random(8)
    words = ["the", "of", "a", "7", "x1", "été", "ab", "abc", *[f"w{i}" for i in range(9)]]
    texts = [[rng.choice(words) for _ in range(k)] for k in [0, 1, 300, *[rng.randint(0, 40) for _ in range(60)]]] + [None, ["the", "7"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100, 100 + len(texts))), pa.array(texts, pa.list_(pa.string()))], ["chunk_id", "words"])
    found = list(graph.phrase_batches(batch, 4))
    assert len(found) > 5  # so a batch of long chunks isn't held at once
    want = []
    for i, text in enumerate(texts):
        runs = [r.split() for r in " ".join("|" if w in ("the", "of", "a", "7") else w for w in text or ()).split("|") if r.strip()]
        often, degree = Counter(w for r in runs for w in r), Counter()
        for r in runs:
            for w in r:
                degree[w] += len(r)
        scored = {" ".join(r): sum(degree[w] / often[w] for w in r) for r in runs if len(" ".join(r).encode()) >= 4}
        best = sorted((-round(x, 9), phrase) for phrase, x in scored.items())[:4]
        want += [(100 + i, phrase, round(-x, 6), k + 1) for k, (x, phrase) in enumerate(best)]
    assert [(r["chunk_id"], r["phrase"], round(r["score"], 6), r["phrase_rank"]) for b in found for r in b.to_pylist()] == want


def test_keyphrase_edges_hand_on_a_bounded_number_of_chunks_of_a_word(spark):
    rows = [(i, f"every{' four' if i < 4 else ''}{' five' if i < 5 else ''}{' pair twin' if i in (7, 9) else ''}") for i in range(400)]
    rows += [(0, "four four"), (2, "five"), (None, "four"), (3, None)]  # repeated, and one without an id
    phrases = spark.createDataFrame(rows, "chunk_id long, phrase string").repartition(4)
    edges = graph.keyphrase_edges(phrases, most_chunks=5)
    assert {(r["src"], r["dst"], r["weight"]) for r in edges.collect()} == {(a, b, 2.0) for a in range(4) for b in range(a + 1, 4)} | {(7, 9, 2.0)}
    assert graph.keyphrase_edges(phrases, most_chunks=4).count() == 1  # the row without an id is a chunk of its own
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "WindowGroupLimit" in plan.split("hashpartitioning(word")[-1]  # before the shuffle too


def test_note_links(spark):
    files = spark.createDataFrame([("a/Plan.md",), ("b/Plan.md",), ("a/b/Costs 2024.md",), ("Harbour.md",)], "path string")
    asked = {10: ("harbour", None), 11: ("Costs 2024", "b/costs 2024"), 12: ("plan", None), 13: ("plan", "b/plan.md"), 14: ("x", "a/none"), 15: ("Harbour", "zzz"), 16: ("nothing", None)}
    links = spark.createDataFrame([(k, t, w) for k, (t, w) in asked.items()], "link_id long, title string, want string")
    got = {r["link_id"]: (r["target_path"], r["confidence"]) for r in navigate.resolve_note_links(links, files).collect()}
    assert got == {10: ("Harbour.md", "exact"), 11: ("a/b/Costs 2024.md", "exact"), 12: ("a/Plan.md", "name_match"), 13: ("b/Plan.md", "exact"), 14: (None, None), 15: ("Harbour.md", "exact"), 16: (None, None)}


def test_contexts(spark):
    given = {"/": "everything", "/sea": "water", "/sea/north": "cold water", "/land/hills": "high"}
    contexts = spark.createDataFrame(list(given.items()), "path_prefix string, description string")
    paths = ["/sea", "/sea/north", "/sea/north/ice.md", "/sea/northern.md", "/seaside.md", "/land", "/land/hills/a/b", "/land/hillside"]
    found = {r["path"]: r["path_prefix"] for r in navigate.longest_prefix(spark.createDataFrame([(p,) for p in paths], "path string"), contexts).collect()}
    assert found == {p: max((c for c in given if c == "/" or p == c or p.startswith(c + "/")), key=len) for p in paths}
    assert navigate.longest_prefix(spark.createDataFrame([("/x",)], "path string"), contexts.where("path_prefix <> '/'")).first()["description"] is None


def test_callers_of_a_cycle(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "caller string, callee string")
    found = navigate.callers(calls, spark.createDataFrame([("c",)], "target string"), 4).collect()
    assert sorted((r["caller"], r["dist"]) for r in found) == [("a", 2), ("b", 1), ("b", 4), ("c", 3)]


def test_definitions_by_alias(spark):
    rows = [(1, "b.py", "function", "drainTank"), (2, "a.py", "method", "drain_tank"), (3, "c.py", "prose", "drainTank"), (4, "a.py", "class", "Tank")]
    chunks = spark.createDataFrame(rows, "chunk_id long, path string, kind string, symbol string")
    asked = spark.createDataFrame([("drain_tank",), ("Drain Tank",), ("gauge",)], "symbol string")
    found = [(r["symbol_asked"], r["chunk_id"], r["priority"]) for r in navigate.find_definitions(chunks, asked).orderBy("symbol_asked", "place").collect()]
    assert found == [("Drain Tank", 2, 1), ("Drain Tank", 1, 1), ("drain_tank", 2, 0), ("drain_tank", 1, 1)]
    assert [r["chunk_id"] for r in navigate.find_definitions(chunks, asked.where("symbol = 'drain_tank'"), limit=1).collect()] == [2]


def test_usage_counts_a_search_once(spark):
    reads = spark.createDataFrame([(1, "p", 100), (2, "p", 110), (3, "p", 300)], "read_id long, path string, read_at long")
    searches = spark.createDataFrame([(7, "p", 95), (8, "p", 40)], "search_id long, path string, search_at long")
    assert [(r["read_id"], r["search_id"]) for r in usage.attribute(reads, searches, ["path"]).collect()] == [(1, 7)]


def test_metrics_and_floor(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "query_id long, rank int")
    row = evaluate.metrics(ranks).first()
    assert [round(row[c], 6) for c in ("r_at_1", "r_at_3", "r_at_5", "mrr")] == [0.333333, 0.666667, 0.666667, 0.444444]
    floors = spark.createDataFrame([([0.6, 0.7, 0.8], [0.1, 0.2, 0.3]), ([0.9], [0.95]), ([0.1], []), ([], [0.5])], "p array<double>, n array<double>")
    assert [round(r[0], 6) for r in floors.select(evaluate.floor_of(F.col("p"), F.col("n"))).collect()] == [0.32, 0.7, 0.2, 0.45]


def test_stride_sample(spark):
    got = sorted(r["id"] for r in evaluate.stride_sample(spark.range(100), "id", 10).collect())
    assert got == list(range(0, 100, 10))


def test_repo_map_budget(spark):
    ranks = spark.createDataFrame([("b.py", 0.7), ("a.py", 0.3)], "path string, rank double")
    definitions = spark.createDataFrame([("b.py", "function", "f" * 50, i * 10) for i in range(20)] + [("a.py", "class", "A", 0)], "path string, kind string, symbol string, start_byte int")
    lines = [r["line"] for r in graph.repo_map(ranks, definitions, 200).orderBy("position").collect()]
    assert lines[0] == "b.py (score 0.7000)" and "a.py (score 0.3000)" in lines and sum(len(x) + 1 for x in lines) <= 800


def test_repo_map_lines(spark):
    ranks = spark.createDataFrame([("none.py", 0.9), ("a.rs", 0.06254)], "path string, rank double")
    rows = [("a.rs", "method", "turn", 30, "Wheel"), ("a.rs", "struct", "Wheel", 10, ""), ("a.rs", "interface", "Spins", 20, None), ("a.rs", "macro", "spin", 40, None), ("a.rs", "const", None, 50, None)]
    definitions = spark.createDataFrame(rows, "path string, kind string, symbol string, start_byte int, heading_path string")
    lines = [r["line"] for r in graph.repo_map(ranks, definitions).orderBy("position").collect()]
    assert lines == ["a.rs (score 0.0625)", "  struct Wheel", "  iface Spins", "  fn Wheel::turn", "  macro! spin"]


@pytest.mark.parametrize("share", [0.1, 0.9])
def test_selection_by_ranges(spark, share):
    rng = random.Random(int(share * 10))
    rows = [(1, rng.gauss(0, 1)) for _ in range(3000)] + [(1, 0.25)] * 2000 + [(2, 7.0)] * 500 + [(None, float(i)) for i in range(40)] + [(3, None), (4, 1.5), (1, 1e9)]
    want = {}
    for label in {r[0] for r in rows}:
        own = sorted(v for k, v in rows if k == label and v is not None)
        if own:
            want[label] = own[min(int(len(own) * share), len(own) - 1)]
    got = evaluate.selected(spark.createDataFrame(rows, "label int, value double"), share, buckets=8, few=16)
    assert {r["label"]: r["value"] for r in got.collect()} == want


@pytest.mark.parametrize("budget,seed", [(200, 1), (200, 2), (700, 3), (10_000, 4)])
def test_outline_by_a_loop(spark, budget, seed):
    rng = random.Random(seed)
    ranks = [(f"f{i:02d}" + "x" * rng.choice([0, 5, 120]), rng.choice([0.1, 0.2, 0.3])) for i in range(40)]
    defined = [(p, rng.choice(["function", "class"]), "s" * rng.choice([1, 4, 30, 200]) + str(k), k, rng.choice(["", "A"])) for p, _ in ranks[:35] for k in range(rng.choice([1, 3, 12]))]
    out, used, limit = [], 0, 4 * budget
    for path, rank in sorted(ranks[:35], key=lambda r: (-r[1], r[0])):
        header = f"{path} (score {rank:.4f})"
        if used + len(header) + 2 > limit:
            break
        used += len(header) + 2
        out.append(header)
        for _, kind, symbol, _, heading in sorted((d for d in defined if d[0] == path), key=lambda d: d[3]):
            line = f"  {'fn' if kind == 'function' else kind} {heading + '::' if heading else ''}{symbol}"
            if used + len(line) + 1 > limit:
                break
            used += len(line) + 1
            out.append(line)
    got = graph.repo_map(spark.createDataFrame(ranks, "path string, rank double"), spark.createDataFrame(defined, "path string, kind string, symbol string, start_byte int, heading_path string"), budget)
    assert [r["line"] for r in got.orderBy("position").collect()] == out



@pytest.mark.parametrize("held", [0, 1000])
def test_pagerank_makes_its_edges_once(spark, held):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    derived = spark.range(40).selectExpr("id AS src", "(id * 7 + 1) % 40 AS dst", "'similarity' AS kind", "1.0D AS weight").mapInArrow(count, "src long, dst long, kind string, weight double")
    links = spark.createDataFrame([], "source_chunk_id long, target_chunk_id long, kind string")
    seeds = spark.createDataFrame([(0, 3, 1.0)], "query_id long, node long, weight double")
    mass = graph.personalized_pagerank(graph.ranking_edges(links, derived), seeds, iterations=2, held=held)
    assert round(sum(r["mass"] for r in mass.collect()), 9) == 1
    assert made.value == 40


def test_note_links_to_a_common_title_make_no_pairs(spark):
    files = spark.range(3000).selectExpr("concat('d', id, '/index.md') AS path")
    links = spark.range(3000).selectExpr("id AS link_id", "'index' AS title", "CAST(NULL AS string) AS want")
    found = navigate.resolve_note_links(links, files)
    assert {(r["target_path"], r["confidence"]) for r in found.select("target_path", "confidence").distinct().collect()} == {("d0/index.md", "name_match")}
    spark.sparkContext.setLogLevel("ERROR")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # it ran over a row for each link and file of its title


def test_last_push_is_made_only_if_what_it_leaves_is_asked_for(spark, monkeypatch):
    names, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, name: names.append(name) or settle(df, name))
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(5, 0, 1.0)], "query_id long, node long, weight double")
    near, rest = graph.pushed_pagerank(edges, seeds, least=0.0, rounds=3)
    assert names.count("waiting") == 3  # the seeds, and two of three rounds
    assert {r["node"]: round(r["mass"], 9) for r in near.collect()} == {0: 0.15, 1: 0.1275, 2: 0.108375}
    assert [round(r["left"], 9) for r in rest.collect()] == [round(0.85**3, 9)]


def test_mass_is_pushed_where_the_edges_are_held(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGE_PIECE", 7, raising=False)
    rng = random.Random(6)
    edges = [(rng.randint(0, 80) << 40, rng.randint(0, 99) << 40, rng.choice([0.3, 0.5, 1.0])) for _ in range(300)]
    seeds = [(f"q{q}", rng.randint(0, 99) << 40, rng.random()) for q in range(9) for _ in range(4)] + [("q1", 5, 0.5), ("q2", 3 << 40, 1.0), ("q2", 3 << 40, 1.0), ("alone", 77, 1.0), ("none", 1 << 40, 0.0)]
    wanted = [(q, n << 40) for q in sorted({q for q, _, _ in seeds}) for n in rng.sample(range(120), 20)] + [("q1", 5), ("other", 0)]
    links, first = spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame(seeds, "query_id string, node long, weight double")
    near, _ = graph.pushed_pagerank(links, first, least=0.0, rounds=5)
    mass = {(r["query_id"], r["node"]): r["mass"] for r in near.collect()}
    top = {q: max(m for (p, _), m in mass.items() if p == q) for q, _ in mass}
    written = []
    real = graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, name: (written.append(name), real(df, name))[1])
    for held in (10**6, 0):
        written.clear()
        got = {(r["query_id"], r["node"]): r["mass"] for r in graph.pushed_around(links, first, spark.createDataFrame(wanted, "query_id string, node long"), 5, held=held).collect()}
        assert {k: v for k, v in got.items() if k in set(wanted)} == {k: pytest.approx(mass[k], rel=1e-9) for k in wanted if k in mass}
        assert len(set(got) - set(wanted)) <= len(top) and set(got) <= set(mass)
        assert {q: max(m for (p, _), m in got.items() if p == q) for q, _ in got} == {q: pytest.approx(m, rel=1e-9) for q, m in top.items()}
        assert ("waiting" in written) == (held == 0)  # mass that waits was written in each round
