"""Near duplicates, components, fingerprints, archives, and the pipeline."""

import hashlib
import importlib.util
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import graph, imatch, near_dups, registry, warc
from tidemark.llm.sql import ORACLES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(12)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def sets(text, words=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute_links(rows, words=2):
    shingles = {}
    for i, text in rows:
        if i is not None:
            shingles.setdefault(i, []).append(sets(text, words))
    label = {i: i for i in shingles}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(shingles)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in shingles[a] for y in shingles[b]):
                p, q = root(a), root(b)
                label[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def check_near(spark, rows, df, words=2):
    got = near_dups.near_duplicates(df, words).collect()
    want = brute_links(rows, words)
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(i, want.get(i), i == want.get(i)) for i, _ in rows}
    assert sorted((str(r["doc_id"]), r["n_shingles"]) for r in got) == sorted((str(i), len(sets(t, words))) for i, t in rows)


def copies(n, words, seed, edits):
    """A chain of texts: each a copy of some earlier one with a few words changed."""
    rng = random.Random(seed)
    out = [[f"w{rng.randint(0, 400)}" for _ in range(words)]]
    while len(out) < n:
        new = list(rng.choice(out))
        for _ in range(rng.randint(0, edits)):
            new[rng.randrange(len(new))] = f"x{rng.randint(0, 10**6)}"
        out.append(new)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize(("n", "words", "edits"), [(150, 60, 5), (150, 400, 30), (120, 190, 14), (90, 70, 5), (60, 3000, 300)])
def test_near_duplicates_by_brute_force(spark, monkeypatch, n, words, edits):
    monkeypatch.setattr(near_dups, "SMALL_LIST", 8)
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    monkeypatch.setattr(near_dups, "TILE", 7)
    monkeypatch.setattr(near_dups, "BUCKET_PAIRS", 3)
    texts = copies(n, words, n + words, edits) + copies(20, words, 99, 2)
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    check_near(spark, rows, spark.createDataFrame(rows, "doc_id long, text string"))


def test_near_duplicates_of_five_words(spark):
    """Five words are the operator's default; rows of one id with several texts are one document."""
    texts = copies(80, 120, 5, 3)
    rows = [(i // 2 if i < 20 else i, t) for i, t in enumerate(texts)] + [(3, texts[6])] * 30
    check_near(spark, rows, spark.createDataFrame(rows, "doc_id long, text string"), near_dups.WORDS)
    assert near_dups.WORDS == 5


def test_long_lists_are_compared_whole(spark, monkeypatch):
    """Texts that share most of a passage meet in long lists without being copies; the copies among them are found."""
    monkeypatch.setattr(near_dups, "SMALL_LIST", 8)
    monkeypatch.setattr(near_dups, "BLOCK", 32)
    monkeypatch.setattr(near_dups, "TILE", 10)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(120)]
    texts = []
    for i in range(60):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(90)]
        at = rng.randrange(90)
        texts.append(" ".join(own[:at] + passage + own[at:]))
        if i % 6 == 0:
            texts.append(" ".join(own[:at] + passage + own[at:-4] + ["x", "y", "z", f"{i}"]))
    rows = list(enumerate(texts))
    check_near(spark, rows, spark.createDataFrame(rows, "doc_id long, text string"))


def test_a_tile_is_compared_in_bounded_memory():
    """A tile's rows meet in eight million values, and 32,768 pairs of wide sketches are judged, in a few MB at a time."""
    rng = np.random.default_rng(2)
    n, size = 256, near_dups.WIDE
    rows = np.repeat(np.arange(n), size)
    a, b = (np.stack([np.sort(rng.permutation(size * 4)[:size]) for _ in range(n)]).astype(np.int64) for _ in range(2))
    each = (a.reshape(-1), rows), (b.reshape(-1), rows)
    want = np.array([[len(np.intersect1d(x, y)) for y in b[:9]] for x in a])
    i, j = np.repeat(np.arange(n), 128), np.tile(np.arange(128), n)
    union = [[np.unique(np.concatenate((x, y)))[:size] for y in b[:3]] for x in a]
    tracemalloc.start()
    try:
        for often in (8, 1000):  # all by products, and all pair by pair
            assert (near_dups.overlaps(each[0], n, each[1], n, often=often)[:, :9] == want).all()
        shares = near_dups.pair_shares(a, i, b, j, size).reshape(n, 128)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all(shares[x, y] == len(np.intersect1d(union[x][y], np.intersect1d(a[x], b[y]))) for x in range(n) for y in range(3))
    assert peak < 100_000_000


@pytest.mark.parametrize("size", [100, 400, 5000])
def test_union_sketch_recall(size):
    """Of pairs at the threshold, all pass the union sketch; of pairs at half of it, none but a few."""
    rng = np.random.default_rng(size)
    k, found = near_dups.RETAINED, {}
    for percent in (80, 40):
        both = size * 2 * percent // (100 + percent)
        passed = 0
        for _ in range(2000):
            values = np.sort(rng.choice(1 << 62, 2 * size - both, replace=False))
            owner = rng.permutation(len(values))
            a, b = values[np.sort(np.flatnonzero(owner < size))], values[np.sort(np.flatnonzero(owner >= size - both))]
            passed += near_dups.union_shares(a[None, :k], b[None, :k], k)[0] >= near_dups.least_shared(size)
        found[percent] = passed / 2000
    assert found[80] == 1.0 and found[40] < 0.1


def test_near_duplicate_edges(spark, edge_rows):
    check_near(spark, [(r["doc_id"], r["text"]) for r in edge_rows.collect()], edge_rows)
    check_near(spark, [(r["doc_id"], r["text"]) for r in edge_rows.collect()], edge_rows, 5)
    assert near_dups.near_duplicates(edge_rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = registry.queries()[name](spark, FOLDER).toPandas()
    tidy = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist()))
    assert sorted(got.columns) == sorted(want.columns) and tidy(got) == tidy(want)


def edited(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0)))
    out = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("span", [2, 512])
def test_imatch_edits_by_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(imatch, "SPAN", span)
    monkeypatch.setattr(imatch.with_next, "__defaults__", (span,))
    rows = [(i * i - 20, "word é " * (i % 5) + f"own{i % 7} and some more") for i in range(25)] + [(10**15, "far away"), (None, "no id"), (3, None), (2, "")]
    got = imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == edited(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r["doc_id"]] or "", set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(p) == 1 for p in by_text.values())


def test_imatch_neighbours_of_many_ids(spark, monkeypatch):
    monkeypatch.setattr(imatch, "ORDERED", 4)
    ids = sorted(random.Random(3).sample(range(-(2**40), 2**40), 60) + list(range(100, 130)))
    rows = [(i, sub) for i in ids for sub in range(1 + i % 2)]
    got = {(r["id"], r["sub"]): r["before"] and tuple(r["before"]) for r in imatch.previous(spark.createDataFrame(rows, "id long, sub int")).collect()}
    assert got == dict(zip(rows, [None, *rows[:-1]], strict=True))


def brute_prints(texts, lowest=imatch.LOWEST, highest=imatch.HIGHEST, most=imatch.LEXICON):
    """Fingerprints by plain Python: band of document frequency, subsets, hashes of sorted distinct terms."""
    from collections import Counter

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    long = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed=seed)
    terms = lambda t: {signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())}
    often = Counter(t for text in texts for t in terms(text))
    inside = sorted((n for n in often.values() if max(2.0, lowest * len(texts)) <= n <= max(2.0, highest * len(texts))), reverse=True)
    least = min((n for n in inside if sum(x >= n for x in inside) <= most), default=10**9)
    band = {t for t, n in often.items() if least <= n <= max(2.0, highest * len(texts))}

    def subsets(t):
        bits, out = (1 << 64) - 1, 0
        for level in range(imatch.LEVELS):
            bits &= xxhash.xxh64_intdigest((level + 1).to_bytes(4, "little"), seed=long(t, 42))
            out |= bits & (((1 << imatch.EACH) - 1) << (imatch.EACH * level))
        return out or 1

    def prints(text):
        found = terms(text)
        found = sorted(found & band or found)
        drawn, out = {t: subsets(t) for t in found}, []
        for j in range(imatch.SUBSETS):
            h, own = 42, [t for t in found if drawn[t] >> j & 1]
            for t in own:
                h = long(t, h)
            out.append(h & 0x7FFFFFFF if own else None)
        return out

    return prints


def brute_likeness(a, b):
    some = [(x, y) for x, y in zip(a, b, strict=True) if x is not None or y is not None]
    return sum(x == y for x, y in some) / len(some) if some else 1.0


@pytest.mark.parametrize("most", [imatch.LEXICON, 40])
def test_imatch_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(imatch.lexicon, "__defaults__", (imatch.LOWEST, imatch.HIGHEST, most))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), reverse=True)
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs).collect()}
    prints, shown = brute_prints([t for _, t in rows], most=most), lambda p: ".".join("" if x is None else f"{x:X}" for x in p)
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        own, edit = prints(text), prints(text[: len(text) - half] + after[:half])
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (shown(own), shown(edit))
        assert abs(got[i]["near_edited"] - brute_likeness(own, edit)) < 1e-12 and abs(got[i]["near_next"] - brute_likeness(own, prints(after))) < 1e-12
    assert sum(r["near_edited"] for r in got.values()) > sum(r["near_next"] for r in got.values())


def test_imatch_lengths_and_edits_by_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute("""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS x, length(t) // 2 AS h FROM t)
        SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - h) || left(x, h)) AS edited_sha256 FROM n""").fetchall()
    got = registry.queries()["op9_imatch"](spark, FOLDER).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(want) == sorted(map(tuple, got))


def test_imatch_splits_ids_that_repeat(spark, monkeypatch):
    """Rows of one id follow one another in some order, wherever they are read."""
    monkeypatch.setattr(imatch.with_next, "__defaults__", (2,))
    rows = [(1, f"t{i % 3}") for i in range(60)] + [(None, "")] * 40 + [(0, "low"), (2, "high"), (3, "top")]
    df = spark.createDataFrame([(-(1 << 63) if i is None else i, t) for i, t in rows], "key long, text string").repartition(5)
    got = imatch.with_next(df, "size", F.char_length("text")).collect()
    assert sorted((r["key"], r["text"]) for r in got) == sorted((-(1 << 63) if i is None else i, t) for i, t in rows)
    assert all(r["size"] == len(r["text"]) and r["next_size"] == len(r["next_text"]) for r in got)
    assert sorted(r["next_text"] for r in got) == sorted(t for _, t in rows)  # each follows one other
    after = {r["key"]: r["next_text"] for r in got if r["key"] in (0, 2, 3)}
    assert after[3] == "high" and after[2] in ("t0", "t1", "t2") and after[0] == ""
    assert sum(r["key"] == 1 and r["next_text"] == "low" for r in got) == 1 and sum(r["key"] < 0 and r["next_text"] == "top" for r in got) == 1


def test_imatch_edge_tables(spark, edge_rows):
    assert imatch.fingerprints(edge_rows).count() == edge_rows.count()
    assert imatch.fingerprints(edge_rows.limit(0)).count() == 0
    assert imatch.fingerprints(edge_rows.where("doc_id = 5")).first()["near_next"] == 1.0


def test_imatch_uses_every_term(spark):
    """Texts with other terms of the lexicon, or of none, have other fingerprints, and none is empty."""
    rng = random.Random(8)
    texts = [f"term{i}" for i in range(300)] + sorted({" ".join(f"term{i}" for i in sorted(rng.sample(range(300), 12))) for _ in range(50)})
    texts += [t + " term300" for t in texts[300:]]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    terms = [r[0] for r in spark.range(301).select(F.xxhash64(F.concat(F.lit("term"), F.col("id").cast("string")))).collect()]
    for known in (terms, []):
        prints = [r["p"] for r in df.select(imatch.shown(imatch.fingerprint("text", known)).alias("p")).collect()]
        assert len(set(prints)) == len(texts) and all(p.strip(".") for p in prints)


def pages(spark):
    long = "<p>" + "shared text " * 20 + "</p>"
    rows = [(5, "http://a/", long), (2, "http://b/\n x", long), (9, None, long), (1, "http://c/", "short"), (3, "http://d/", "short"), (4, "http://e/", None), (6, "u", "é" * 60), (7, "u", "é" * 60), (8, "u", ""), (8, "u", "")]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, size string")


@pytest.mark.parametrize("roll", [1, 10**9])
def test_warc_round_trip(spark, tmp_path, roll):
    rows, df = pages(spark)
    got = warc.archive_round_trip(df, f"file://{tmp_path}/w", roll_bytes=roll).collect()
    first = {}
    for i, _, html in sorted(rows):
        first.setdefault(html or "", i)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        other = len(raw) >= 100 and first[html] != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if other else "response", first[html] if other else None))
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    assert warc.archive_round_trip(df.limit(0), f"file://{tmp_path}/empty").count() == 0


def test_warc_names_of_any_text(spark, tmp_path):
    long = "x" * 200
    ids = ["a>b", "", "line\r\nend", "ü %41", None, "plain", "<urn:page:>"]
    got = warc.archive_round_trip(spark.createDataFrame([(i, "u", long) for i in ids], "page_id string, url string, html string"), f"file://{tmp_path}/names").collect()
    assert sorted(map(str, ids)) == sorted(str(r["page_id"]) for r in got)
    assert {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got} == {i: ("response", None) if i == "" else ("revisit", "") for i in ids}
    assert not (tmp_path / "names" / "raw").exists()


def test_warc_streams_of_any_shape():
    whole = [warc.record(i, "u", bytes([65 + i]) * n, "d", None, False) for i, n in enumerate((0, 10, 3_000_000))]
    one = zlib.compressobj(6, zlib.DEFLATED, 31)
    single = one.compress(b"".join(whole)) + one.flush()
    many = b"".join((e := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(w) + e.flush() for w in whole)
    import io

    for data in (single, many):
        assert list(warc.records(warc.inflated(io.BytesIO(data)))) == whole
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(io.BytesIO(zlib.compress(whole[1][:-5], wbits=31)))))


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is left out")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, FOLDER)
        assert now.columns == docs.columns and dict(now.dtypes) == dict(docs.dtypes)
        now = spark.createDataFrame(now.collect(), now.schema)
    kept = {r["doc_id"] for r in now.collect()}
    links = brute_links([(r["doc_id"], r["text"]) for r in docs.collect()], 5)
    groups = {links[i] for i in kept}
    assert len(groups) == len(kept) >= 0.95 * len(set(links.values()))
    packed = corpus_pipeline.run(spark, FOLDER)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is left out")
@pytest.mark.parametrize("stage", range(4))
def test_pipeline_stages_at_the_edges(spark, edge_rows, stage):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing columns, and no rows at all."""
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    more = spark.createDataFrame([(1, "another text under the same id, longer than a few words", "en", "s1", 5)] + [(None, "a row without an id", "en", "s3", 19)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    docs = edge_rows.unionByName(more, allowMissingColumns=True)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    got = run(spark, docs, FOLDER)
    assert got.columns == columns and [f.dataType for f in got.schema] == [docs.schema[c].dataType for c in columns]
    rows = [tuple(r) for r in got.collect()]
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in rows)
    given = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    texts = sorted(str(r[:2]) for r in rows)
    if name == "near duplicates":
        kept = {i: min((t for d, t, *_ in given if d == i and t is not None), default=None) for i in {1, 2, 3, 4, 5, 7, 8}}
        assert sorted(str((r[0], r[1])) for r in rows if r[0] is not None and r[0] not in (6, 9)) == sorted(str(x) for x in kept.items())
        assert sum(r[0] is None for r in rows) == sum(d is None for d, *_ in given) and not {6, 9} & {r[0] for r in rows if r[0] == 9}
    if name == "benchmark decontamination":
        assert texts == sorted(str(r[:2]) for r in given)
    if name == "personal data":
        assert len(rows) == len(given) and all("@" not in (r[1] or "") for r in rows)
    if name == "language id":
        assert all(any(c.isalpha() for c in r[1] or "") for r in rows) and {r[0] for r in rows} >= {1, 6, 7, 9}
    assert run(spark, docs.limit(0), FOLDER).count() == 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is left out")
def test_pipeline_near_duplicates_by_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    links = brute_links([(r["doc_id"], r["text"]) for r in docs.collect()], 5)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert {r["doc_id"] for r in got.collect()} == {i for i, low in links.items() if i == low}
