import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, incremental
from tidemark.plans import index
from tidemark.sources import files as sources
from tidemark.sources.registry import Registry, RegistryFile, Source, eval_queries
from tidemark.streaming import refresh as streaming

NOTES = {
    "billing/price.md": "# Raising prices\n\nWe raised the price of every plan by ten percent. See [[Churn]].\n",
    "billing/Churn.md": "# Cancellations\n\nCustomers who leave tell us why in a survey.\n",
    "garden/tomato.md": "# Tomatoes\n\nWater tomato plants early in the morning.\n",
    "garden/compost.md": "# Compost\n\nCompost needs air, water and time.\n",
    "kitchen/bread.md": "# Bread\n\nSourdough bread needs flour, salt and patience.\n",
}


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "notes"
    for path, text in NOTES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / ".obsidian").mkdir()
    (root / ".obsidian/x.md").write_text("hidden")
    return root


def actions(df):
    return {r["action"]: r["n"] for r in df.collect()}


def test_index_search_and_refresh(spark, folder, tmp_path):
    source = Source("n", str(folder), mode="obsidian")
    store = incremental.Store(spark, str(tmp_path / "index"))
    assert actions(index.refresh(spark, source, store)) == {"insert": 5}
    assert actions(index.refresh(spark, source, store)) == {"skip": 5}
    queries = eval_queries(spark, '[[query]]\nquery = "tomato plants water"\nrelevant = ["garden/tomato.md"]\n[[query]]\nquery = "sourdough flour"\nrelevant = ["kitchen/bread.md"]\n')
    hits, trust = index.search(store, queries, top_k=3)
    relevant = queries.select("query_id", F.explode("relevant").alias("path"))
    row = evaluate.metrics(evaluate.first_relevant(hits, relevant, queries)).first()
    assert (row["r_at_1"], row["mrr"]) == (1.0, 1.0)
    assert trust.count() == 2 and hits.where("rank = 1 AND fts_rank = 1").count() == 2
    # graph: the note that is linked from the hit gains
    asked = spark.createDataFrame([(0, "price plan percent")], "query_id long, text string")
    on, off = (index.search(store, asked, top_k=5, use_graph=g)[0] for g in (True, False))
    score = lambda df: {r["path"]: r["score"] for r in df.collect()}
    on, off = score(on), score(off)
    assert on["billing/Churn.md"] > off.get("billing/Churn.md", 0)
    only = index.search(store, asked, path_prefix="garden/")[0]
    assert {r["path"].split("/")[0] for r in only.collect()} <= {"garden"}
    sides = spark.createDataFrame([(0, 0, "survey")], "query_id long, side int, text string")
    assert index.search(store, asked, none_of=sides)[0].count() <= len(off)
    assert index.explain(store, asked, 2).where("arm = 'fts'").count() >= 1
    # changes
    (folder / "garden/tomato.md").write_text("# Tomatoes\n\nPick tomatoes when they are red.\n")
    os.rename(folder / "kitchen/bread.md", folder / "kitchen/loaf.md")
    (folder / "garden/compost.md").unlink()
    (folder / "new.md").write_text("A new note.\n")
    before = {r["chunk_id"] for r in store.read("chunks").where("path = 'kitchen/bread.md'").collect()}
    assert actions(index.refresh(spark, source, store)) == {"skip": 2, "update": 1, "rename": 1, "delete": 1, "insert": 1}
    chunks = store.read("chunks")
    assert {r["path"] for r in chunks.select("path").distinct().collect()} == {"billing/price.md", "billing/Churn.md", "garden/tomato.md", "kitchen/loaf.md", "new.md"}
    assert {r["chunk_id"] for r in chunks.where("path = 'kitchen/loaf.md'").collect()} == before
    assert store.health()["schema_matches"] and store.matches("hashed-64", 64)


def test_code_index(spark, tmp_path):
    root = tmp_path / "code"
    root.mkdir()
    (root / "a.py").write_text("import b\nimport sys\n\ndef first_step(x):\n    return second_step(x)\n")
    (root / "b.py").write_text("def second_step(x):\n    return third_step(x)\n\ndef third_step(x):\n    return x\n")
    source, store = Source("c", str(root), mode="code"), incremental.Store(spark, str(tmp_path / "code-index"))
    index.refresh(spark, source, store)
    found = index.find_callers(store, spark.createDataFrame([("third_step",)], "symbol string"), 3).collect()
    assert [(r["caller"], r["dist"]) for r in sorted(found, key=lambda r: r["dist"])] == [("second_step", 1), ("first_step", 2)]
    lines = [r["line"] for r in index.outline(store).orderBy("position").collect()]
    assert lines[0].startswith("b.py (score 0.") and "  fn third_step" in lines


def test_walk_reads_and_modes(spark, folder):
    entries = sources.walk(spark, str(folder), "obsidian")
    assert sorted(r["path"] for r in entries.collect()) == sorted(NOTES)
    assert sources.detect_mode(sources.walk(spark, str(folder), "notes"), str(folder)) == "obsidian"
    files = sources.bodies(spark, str(folder), entries)
    assert [r["path"] for r in sources.list_paths(files, "garden/*.md").collect()] == ["garden/compost.md", "garden/tomato.md"]
    row = sources.multi_get(files, "kitchen/*", 10).first()
    assert row["truncated"] and len(row["content"].encode()) <= 10 and row["byte_count"] == len(NOTES["kitchen/bread.md"])
    with pytest.raises(ValueError):
        sources.get_document(files, "../x")


def test_diff_pairs_renames_one_to_one(spark):
    schema = "path string, mtime long, size long, content_hash string"
    new = spark.createDataFrame([("x1", 1, 1, "h"), ("x2", 1, 1, "h"), ("t", 2, 1, "k")], schema)
    old = spark.createDataFrame([("o", 1, 1, "h"), ("t", 1, 1, "k")], schema)
    assert {(r["path"], r["action"], r["old_path"]) for r in incremental.snapshot_diff(new, old).collect()} == {("x1", "rename", "o"), ("x2", "insert", None), ("t", "touch", None)}


def test_registry():
    reg = Registry.parse('[[source]]\nname = "a"\npath = "/w"\n[[source]]\nname = "b"\npath = "/w/deep"\n')
    assert reg.resolve("/w/deep/x").name == "b" and reg.resolve("/w/deeper").name == "a" and reg.resolve("/z") is None
    assert reg.register("/other/a").name == "a-2"
    with pytest.raises(ValueError):
        Source("bad name", "/x")
    with pytest.raises(ValueError):
        Registry.parse('[[source]]\nname = "a"\npath = "/w"\nodd = 1\n')
    reg.sources[0] = Source("q", '/x "y"', "é\n", "code", ("x", "y z"), "gemma-300", 0.6)
    assert Registry.parse(reg.text()) == reg


def test_registry_file_is_read_again(tmp_path):
    held = RegistryFile(str(tmp_path / "sources.toml"))
    assert held.current().sources == []
    held.save(Registry([Source("a", "/a")]))
    assert [s.name for s in held.current().sources] == ["a"] and held.current() is held.current()
    (tmp_path / "sources.toml").write_text("[[source]]\nname =")
    assert [s.name for s in held.current().sources] == ["a"] and held.error is not None
    held.save(Registry([Source("a", "/a"), Source("b", "/b")]))
    assert [s.name for s in held.current().sources] == ["a", "b"] and held.error is None


def test_only_changed_files_are_opened(spark, folder, tmp_path, monkeypatch):
    source, store, opened = Source("n", str(folder), mode="obsidian"), incremental.Store(spark, str(tmp_path / "index")), []
    load = type(spark.read).load

    def counted(self, path=None, *more, **options):
        opened.extend(path if isinstance(path, list) else [])
        return load(self, path, *more, **options)

    monkeypatch.setattr(type(spark.read), "load", counted)
    index.refresh(spark, source, store)
    assert len(opened) == 5
    opened.clear()
    index.refresh(spark, source, store)
    assert opened == []
    (folder / "odd [x]*.md").write_text("# Odd\n\nA name with signs.\n")
    index.refresh(spark, source, store)
    assert len(opened) == 1 and store.read("files").count() == 6


def test_store_versions(spark, tmp_path):
    store, other = (incremental.Store(spark, str(tmp_path / "store")) for _ in range(2))
    assert store.manifest()["version"] is None
    numbers, missed, done = [], [], threading.Event()

    def look():
        while not done.is_set():
            found = store.manifest()["tables"]
            if numbers and "a" not in found:
                missed.append(found)

    reader = threading.Thread(target=look)
    reader.start()
    for i in range(5):
        store.write({"a": spark.range(i)})
        numbers.append(i)
    done.set()
    reader.join()
    assert not missed and store.read("a").count() == 4
    assert len(store._numbers()) == incremental.KEPT and sum(p.is_dir() and p.name.startswith("v") and any(p.iterdir()) for p in (tmp_path / "store").iterdir()) == incremental.KEPT
    # two writers of different tables, the second of which has taken the number that the first wants
    numbers_of, first = incremental.Store._numbers, []

    def late(self):
        found = numbers_of(self)
        if self is store and not first:
            first.append(other.write({"b": spark.range(7)}))
        return found

    incremental.Store._numbers = late
    try:
        store.write({"c": spark.range(8)})
    finally:
        incremental.Store._numbers = numbers_of
    assert {t: store.read(t).count() for t in "abc"} == {"a": 4, "b": 7, "c": 8}


def test_watch_waits_until_a_source_is_quiet(spark, tmp_path):
    inbox, seen = tmp_path / "in", []
    schema = "source string, path string, kind string, ts timestamp"
    put = lambda n, path: spark.sql(f"SELECT 's' AS source, '{path}' AS path, 'modify' AS kind, now() AS ts").coalesce(1).write.mode("append").parquet(str(inbox))
    put(0, "a.md")
    query = streaming.watch(spark.readStream.schema(schema).parquet(str(inbox)), lambda s: seen.append((s, time.time())), str(tmp_path / "cp"), quiet_ms=4000)
    for i in range(2):
        time.sleep(2)
        put(i, f"b{i}.md")
    last, end = time.time(), time.time() + 60
    while not seen and time.time() < end:
        time.sleep(0.2)
    query.stop()
    assert [s for s, _ in seen] == ["s"] and seen[0][1] >= last + 2


def test_streaming_refresh(spark, tmp_path):
    inbox = tmp_path / "in"
    rows = [("s1", "a.md", "modify", "2026-01-01 00:00:00"), ("s1", "b.md", "create", "2026-01-01 00:00:00.3"), ("s1", "c.md", "modify", "2026-01-01 00:00:02"), ("s2", ".git/x", "modify", "2026-01-01 00:00:00"), ("s3", "a.md", "access", "2026-01-01 00:00:00")]
    table = spark.createDataFrame(rows, "source string, path string, kind string, ts string").withColumn("ts", F.to_timestamp("ts"))
    table.write.parquet(str(inbox))
    assert [(r["source"], r["n"]) for r in streaming.bursts(table).orderBy("first").collect()] == [("s1", 2), ("s1", 1)]
    seen = []
    query = streaming.watch(spark.readStream.schema(table.schema).parquet(str(inbox)), seen.append, str(tmp_path / "cp"), once=True)
    query.awaitTermination(60)
    assert seen == ["s1"]
    assert time.time() > 0
