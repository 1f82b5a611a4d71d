"""The store of segments: small writes, equal reads before and after compaction, and an index equal to one built anew."""

import os
import random

from tidemark.operators import incremental
from tidemark.plans import index
from tidemark.sources.registry import Source

TABLES = ("chunks", "vectors", "postings", "links", "edges")


def note(rng, i, n, vocabulary=3000):
    words = " ".join(f"w{rng.randint(0, vocabulary)} w{rng.randint(0, vocabulary)} the" for _ in range(n))
    return f"# Note {i}\n\n{words}\n\nsee [[note{rng.randint(0, 30)}]]\n"


def rows(store, name):
    df = store.read(name)
    keep = sorted(c for c in df.columns if c not in ("indexed_at", "chunk_id", "source_chunk_id", "target_chunk_id", "src", "dst", "source"))
    return sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(*keep).collect())


def size(root):
    return sum(p.stat().st_size for p in root.rglob("*") if p.is_file())


def test_rows_die_and_segments_merge(spark, tmp_path):
    store, rng, want = incremental.Store(spark, str(tmp_path / "store")), random.Random(1), {}
    seen = []
    for step in range(14):
        keys = [rng.randint(0, 20) for _ in range(rng.randint(1, 5))]
        for k in keys:
            want[k] = [(k, step * 100 + i) for i in range(rng.randint(0, 3))]
        fresh = spark.createDataFrame([r for k in set(keys) for r in want[k]], "k long, v long")
        if step:
            store.append({"t": fresh}, {"t": spark.createDataFrame([(k,) for k in set(keys)], "k long")})
        else:
            store.write({"t": fresh})
        seen.append(store.read("t"))
        if step % 3 == 2:
            before = sorted(map(tuple, store.read("t").collect()))
            store.compact(3)
            assert sorted(map(tuple, store.read("t").collect())) == before
        assert sorted(map(tuple, store.read("t").collect())) == sorted(r for own in want.values() for r in own)
        seen[-1].count()  # what was read before the merge can still be
        assert len(store.manifest()["tables"]["t"]) <= 6
    store.compact(1)
    assert len(store.manifest()["tables"]["t"]) == 1 and not store.manifest()["dead"]["t"]


def test_refreshed_index_equals_one_built_anew(spark, tmp_path):
    rng, root = random.Random(4), tmp_path / "notes"
    root.mkdir()
    for i in range(25):
        (root / f"note{i}.md").write_text(note(rng, i, 12, 60))
    source, store = Source("n", str(root), mode="obsidian"), incremental.Store(spark, str(tmp_path / "index"))
    index.refresh(spark, source, store)
    asked = spark.createDataFrame([(0, "w1 w2 w3"), (1, "note 7 w9")], "query_id long, text string")
    for step in range(3):
        for _ in range(5):
            i, what = rng.randint(0, 30), rng.random()
            path = root / f"note{i}.md"
            if what < 0.2 and path.exists():
                path.unlink()
            elif what < 0.4 and path.exists():
                os.rename(path, root / f"moved{step}_{i}.md")
            else:
                path.write_text(note(rng, i, 12, 60))
        index.refresh(spark, source, store)
    anew = incremental.Store(spark, str(tmp_path / "anew"))
    index.refresh(spark, source, anew)
    for name in TABLES:
        assert rows(store, name) == rows(anew, name), name
    held, other = (index.index_of(s, s.read("chunks")) for s in (store, anew))
    assert (held.n, round(held.mean, 9)) == (other.n, round(other.mean, 9)) and set(map(tuple, held.frequency.collect())) == set(map(tuple, other.frequency.collect()))
    found = lambda s: sorted((r["query_id"], r["path"], round(r["score"], 9)) for r in index.search(s, asked, use_graph=False)[0].collect())
    first = found(store)
    assert first == found(anew)
    store.compact(1)
    assert found(store) == first
    for name in TABLES:
        assert rows(store, name) == rows(anew, name), name


def test_one_file_of_many_writes_little(spark, tmp_path):
    rng, root, place = random.Random(2), tmp_path / "notes", tmp_path / "index"
    root.mkdir()
    for i in range(1000):
        (root / f"note{i}.md").write_text(note(rng, i, 120, 6000))
    source, store = Source("n", str(root), mode="obsidian"), incremental.Store(spark, str(place))
    index.refresh(spark, source, store)
    whole = size(place)
    (root / "note500.md").write_text(note(rng, 500, 120, 6000))
    index.refresh(spark, source, store)
    written = size(place) - whole
    assert 0 < written < 0.02 * whole, (written, whole)
    index.refresh(spark, source, store)
    assert size(place) - whole - written < 4096  # a manifest alone
