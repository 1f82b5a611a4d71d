from tidemark.api import Library
from tidemark.sources.registry import Registry, Source, eval_queries


def test_tools(spark, tmp_path):
    notes, code = tmp_path / "notes", tmp_path / "code"
    for root, path, text in ((notes, "a.md", "# Apples\n\nApples keep well in a cool cellar. See [[b]].\n"), (notes, "b.md", "# Pears\n\nPears ripen off the tree.\n"), (code, "m.py", "class Base:\n    pass\n\nclass Store(Base):\n    def read_all(self):\n        return load_table()\n\ndef load_table():\n    return []\n")):
        root.mkdir(exist_ok=True)
        (root / path).write_text(text)
    library = Library(spark, Registry([Source("notes", str(notes)), Source("code", str(code), mode="code")]), str(tmp_path / "index"))
    library.refresh("notes")
    library.refresh("code")
    assert {(r["name"], r["files"]) for r in library.list_sources().collect()} == {("notes", 2), ("code", 1)}
    hits, trust = library.search(["apples cellar"], log=True)
    first = hits.where("rank = 1").first()
    assert (first["source"], first["path"]) == ("notes", "a.md") and trust.count() == 1
    reads = spark.sql(f"SELECT 1L AS read_id, {first['chunk_id']}L AS chunk_id, unix_timestamp() + 1 AS read_at")
    assert library.attribute("notes", reads).count() == 1
    assert library.search(["apples"], source="notes", output="files")[0].first()["snippet"] == ""
    assert [r["path"] for r in library.find_definition("load table").collect()] == ["m.py"]
    assert [(r["caller"], r["dist"]) for r in library.find_callers("load_table").collect()] == [("read_all", 1)]
    assert [r["symbol"] for r in library.find_implementations("Base").collect()] == ["Store"]
    assert library.repo_map("code").orderBy("position").first()["line"].startswith("m.py (score ")
    assert {(r["kind"], r["n"]) for r in library.chunk_kinds("code").collect()} >= {("class", 2), ("function", 1)}
    cost = library.embedding_cost("notes", 20.0).first()
    assert cost["chunks"] == 2 and cost["tokens"] > 0 and cost["cost"] == cost["tokens"] * 20 / 1_000_000
    assert library.multi_get("notes", "*.md").count() == 2 and library.get("notes", "b.md").first()["byte_count"] > 0
    inbound, outbound = library.backlinks("notes", "b.md")
    assert [r["linked_from"] for r in inbound.collect()] == ["a.md"] and outbound.count() == 0
    assert library.explain("pears", "notes").count() > 0
    assert 0.2 <= library.calibrate("notes") <= 0.7
    queries = eval_queries(spark, '[[query]]\nquery = "ripen tree"\nrelevant = ["b.md"]\n')
    assert library.evaluate("notes", queries).first()["mrr"] == 1.0
    library.describe_path("notes", "/", "fruit")
    assert library.contexts("notes").first()["description"] == "fruit"
    assert library.health().count() == 2
