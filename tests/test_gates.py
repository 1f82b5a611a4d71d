"""Search quality on a small linked garden of notes: floors, and that the graph helps where words don't."""

import pytest

from tidemark.operators import evaluate, incremental
from tidemark.plans import index
from tidemark.sources.registry import Source, eval_queries

NOTES = {
    "tides": "# Tides\n\nThe moon pulls the sea twice a day; spring tides come with the full moon.",
    "moorings": "# Moorings\n\nChain and swivel are checked each spring. A worn shackle parts in a gale. See [[Tides]].",
    "pilotage": "# Pilotage\n\nLeading marks, buoys and the depth over the bar. See [[Tides]] and [[Harbour]].",
    "harbour": "# Harbour\n\nBerths, fuel and water. The office opens at eight. See [[Moorings]].",
    "rigging": "# Rigging\n\nStays and shrouds; tune the rig before the season.",
    "galley": "# Galley\n\nBread at sea: flour, yeast, a covered pan and a steady flame.",
    "weather": "# Weather\n\nA falling barometer and high cirrus foretell a gale.",
    "logbook": "# Logbook\n\nEach watch writes course, speed and wind. See [[Weather]].",
    "engine": "# Engine\n\nBleed the diesel filter; check the impeller and the belt.",
    "knots": "# Knots\n\nBowline, clove hitch and sheet bend for every rope aboard.",
}
QUERIES = {"spring tides full moon": "tides", "worn shackle chain": "moorings", "leading marks buoys bar": "pilotage", "office berths fuel": "harbour", "tune stays shrouds": "rigging", "bread flour yeast": "galley", "falling barometer cirrus": "weather", "watch writes course speed": "logbook", "diesel filter impeller": "engine", "bowline sheet bend": "knots"}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("garden")
    for name, text in NOTES.items():
        (root / f"{name}.md").write_text(text + "\n")
    held = incremental.Store(spark, str(tmp_path_factory.mktemp("index") / "store"))
    index.refresh(spark, Source("garden", str(root), mode="obsidian"), held)
    return held


def ranks(spark, store, graph):
    text = "".join(f'[[query]]\nquery = "{q}"\nrelevant = ["{p}.md"]\n' for q, p in QUERIES.items())
    queries = eval_queries(spark, text)
    relevant = queries.selectExpr("query_id", "explode(relevant) AS path")
    hits = index.search(store, queries, top_k=5, use_graph=graph)[0]
    return evaluate.first_relevant(hits, relevant, queries)


def test_floors_with_and_without_the_graph(spark, store):
    on, off = ranks(spark, store, True), ranks(spark, store, False)
    for found in (on, off):
        row = evaluate.metrics(found).first()
        assert row["queries"] == len(QUERIES) and row["r_at_1"] >= 0.9 and row["r_at_5"] == 1.0 and row["mrr"] >= 0.95
    gain = evaluate.compare(off, on).first()
    assert all(gain[k] >= 0 for k in ("r_at_1", "r_at_3", "r_at_5", "mrr"))


def test_the_graph_raises_what_is_linked(spark, store):
    asked = spark.createDataFrame([(0, "spring tides full moon")], "query_id long, text string")
    score = {g: {r["path"]: r["score"] for r in index.search(store, asked, top_k=10, use_graph=g)[0].collect()} for g in (True, False)}
    raised = {p for p, s in score[True].items() if s > score[False].get(p, 0) + 1e-9}
    assert "pilotage.md" in raised or "moorings.md" in raised
