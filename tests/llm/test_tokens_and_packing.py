import random
import zlib

import pytest

from tidemark.llm import bpe, packing, token_count

PIECES = ["a", "b", "XY", "01", " ", "  ", "\n", "\t", "\r", "'s", "'ll", ".", ",", "!", "-", "_", "<|endoftext|>", "é", "ß", "中", "　", "\xa0", "²", "😀", " the", "İ", "\x1c", "\x85", "٣", "tion"]


def texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_counts_and_ids_are_the_librarys():
    path = bpe.default_path()
    library, counter = bpe.library(path), bpe.HeapCounter(path, keep=50)
    for text in texts(4000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert counter(text) == len(ids), repr(text)
        assert bpe.encode(text, path).tolist() == ids, repr(text)


def test_long_text_and_long_word():
    path = bpe.default_path()
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000)) + " word" * 5000
    assert bpe.HeapCounter(path)(text) == len(bpe.library(path).encode(text, add_special_tokens=False).ids)


def test_count_table(spark, edge_rows):
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_count.count_tokens(edge_rows).collect()}
    library = bpe.library(bpe.default_path())
    assert got == {(r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in edge_rows.collect()}
    assert token_count.count_tokens(edge_rows.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_packing_of_sizes_is_whole(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 2048])
    counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(0, 40))}
    slots, bins, fixed = packing.pack_sizes(counts, capacity)
    content, seen = {}, set()
    for size, rank, n, first, offset in slots:
        for k in range(n):
            content.setdefault(first + k, []).append((offset, size))
            assert (size, rank + k) not in seen
            seen.add((size, rank + k))
    assert seen == {(s, k) for s, c in counts.items() for k in range(c)}
    assert sorted(content) == list(range(bins)) and fixed <= bins
    for held in content.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= capacity


def test_small_packings_are_best():
    """The reduction never costs a bin: against exhaustive search."""

    def best(items, capacity):
        items, out = sorted(items, reverse=True), [len(items)]

        def go(i, rooms):
            if len(rooms) >= out[0]:
                return
            if i == len(items):
                out[0] = len(rooms)
                return
            for j in range(len(rooms)):
                if rooms[j] >= items[i]:
                    go(i + 1, rooms[:j] + [rooms[j] - items[i]] + rooms[j + 1 :])
            go(i + 1, [*rooms, capacity - items[i]])

        go(0, [])
        return out[0]

    rng, excess = random.Random(5), 0
    for _ in range(150):
        items = [rng.randint(1, 12) for _ in range(rng.randint(1, 8))]
        counts = {s: items.count(s) for s in items}
        got, want = packing.pack_sizes(counts, 12)[1], best(items, 12)
        assert want <= got <= want + 1
        excess += got - want
    assert excess <= 8


def test_pack_table(spark, edge_rows):
    got = packing.pack(edge_rows).collect()
    library = bpe.library(bpe.default_path())
    want = []
    for r in edge_rows.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048 if len(ids) > 2048 else len(ids)
        edges = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want.append((r["doc_id"], i, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(edge_rows.limit(0)).count() == 0


def test_ids_of_all_documents_are_the_librarys():
    import pyarrow.parquet as pq

    path = bpe.default_path()
    library = bpe.library(path)
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist():
        if text:
            assert bpe.encode(text, path).tolist() == library.encode(text, add_special_tokens=False).ids


def test_many_rows_of_one_id_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_BUCKET", 20)
    rows = spark.createDataFrame([(None if i % 2 else 7, "one text of a few words") for i in range(400)], "doc_id long, text string").repartition(4)
    got = packing.pack(rows).collect()
    length = got[0]["length"]
    each = 2048 // length
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) == 400 and all(r["offset"] % length == 0 for r in got)
    assert len({r["sequence_id"] for r in got}) == -(-400 // each)


def test_a_very_long_text_is_cut(spark):
    rows = spark.createDataFrame([(1, "word and " * 60_000), (2, "x")], "doc_id long, text string")
    got = packing.pack(rows).collect()
    long = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 1)
    assert [p for p, _, _ in long] == list(range(len(long))) and all(n == 2048 for _, _, n in long[1:]) and sum(n for _, _, n in long) == 120_001 + 1 or sum(n for _, _, n in long) > 100_000
