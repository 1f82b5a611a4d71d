"""Personal data, licence notices, benchmark passages."""

import hashlib
import random
import re

import pytest

from tidemark.llm import decontaminate, licenses, pii
from tidemark.llm.fm_index import FMIndex

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return out


def test_plain_spans_by_brute_force():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789..@@ab-_%+ ()é1234567890") for _ in range(rng.randint(0, 60)))
        assert pii.detect(text) == plain(text)
    assert pii.detect("1" * 200_000 + " x" + "a" * 200_000) == []  # in linear time


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john dot doe at example dot com now", "email", "john dot doe at example dot com"),
        ("john [at] example [dot] com", "email", "john [at] example [dot] com"),
        ("jоhn@exаmple.com!", "email", "jоhn@exаmple.com"),
        ("jo​hn@ex​ample.com", "email", "jo​hn@ex​ample.com"),
        ("a&#64;b.com", "email", "a&#64;b.com"),
        ("call plus one five five five two one two three four five six", "phone", "plus one five five five two one two three four five six"),
        ("at 192[.]168[.]1[.]10", "ip", "192[.]168[.]1[.]10"),
        ("at 192 dot 168 dot 1 dot 9", "ip", "192 dot 168 dot 1 dot 9"),
        ("４111 1111 1111 1111", "card", "４111 1111 1111 1111"),
    ],
)
def test_disguises_map_back(text, kind, span):
    base, added = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in added] == [(kind, span)] and base == []


@pytest.mark.parametrize(
    ("text", "span"),
    [("to 192 dot 168 dot one dot two ok", (3, 30)), ("one nine two dot one six eight dot zero dot one", (0, 47)), ("is Ten dot zero dot zero point one.", (3, 34)), ("é 10 dot zero dot 0 dot nine", (2, 28))],
)
def test_lone_spelled_digits_of_an_address(text, span):
    assert pii.find(text) == ([], [("ip", *span)])


@pytest.mark.parametrize("text", ["look at example.com", "arrive at 10.0.0.1 port", "here at shop.example dot org", "one point two and three point four", "look at the dot com boom", "one of two at home.", "we met at noon. Then one by one", "x [at] y"])
def test_plain_words_stay(text):
    assert pii.find(text) == ([], [])


def test_pii_table(spark, edge_rows):
    got = {(r["doc_id"], r["base_sha256"], r["n_email"], r["n_phone"]) for r in pii.digest(pii.find_pii(edge_rows)).collect()}
    want = set()
    for r in edge_rows.collect():
        spans = plain(r["text"] or "")
        want.add((r["doc_id"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), sum(k == "email" for k, _, _ in spans), sum(k == "phone" for k, _, _ in spans)))
    assert got == want
    texts = {r["doc_id"]: r["redacted"] for r in pii.find_pii(edge_rows).collect()}
    assert texts[2] is None and "<EMAIL>" in texts[7] and "<PHONE>" in texts[7] and "@" not in texts[7]
    assert pii.digest(pii.find_pii(edge_rows.limit(0))).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_notice_places_and_errors(spark):
    fuzzy = licenses.notices(tuple(licenses.NOTICES.items()), licenses.PER_ERROR)
    found = licenses.scan("x CC-BY, All rights reserved. ALL RIGHTS RESERVED", licenses.BASE, fuzzy)
    assert [(b["label"], b["word"]) for b in found["base"]] == [("cc-by", 1), ("reserved", 3), ("reserved", 6)] and found["n_words"] == 9
    for text, label in (("the genral public licence", "gpl"), ("al rights reserved", "reserved"), ("GNU Lesser General Public Licnse", "lgpl"), ("under creative common attribution", "cc-by")):
        spans = licenses.scan(text, licenses.BASE, fuzzy)["spans"]
        assert label in {s["label"] for s in spans} and all(s["errors"] > 0 or s["score"] == 1 for s in spans)
    assert licenses.scan("generally the public is licensed to reserve rights", licenses.BASE, fuzzy)["spans"] == []


def test_bounded_errors_by_brute_force():
    """Every place that a plain search with the same bound finds is found from the seeds."""
    import regex

    rng, notice = random.Random(4), licenses.Notice("all rights reserved", "r")
    pattern = regex.compile(r"(?b)(?<![^ ])(?:all\ rights\ reserved){e<=1}(?![^ ])")
    for _ in range(300):
        text = list("all rights reserved")
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(text))
            text[i] = rng.choice(["", "x", text[i] * 2])
        line = f"aa {''.join(text)} bb"
        line = " " + " ".join(line.split()) + " "
        assert bool(list(notice.places(line.encode()))) == bool(pattern.search(line)), line


def test_notice_table(spark, edge_rows):
    got = licenses.find_notices(edge_rows)
    assert {(r["doc_id"], r["n_words"]) for r in got.collect()} == {(r["doc_id"], len(words(r["text"]))) for r in edge_rows.collect()}
    assert got.count() == edge_rows.count() and licenses.find_notices(edge_rows.limit(0)).count() == 0


def test_fm_index_by_brute_force():
    rng = random.Random(1)
    import numpy as np

    for _ in range(150):
        most = rng.choice([2, 3, 9])
        text = [rng.randint(0, most) for _ in range(rng.randint(1, 60))] + [0]
        index = FMIndex(np.array(text, np.int32), most, rng.choice([1, 3, 8]))
        phrases = [tuple(rng.randint(1, most) for _ in range(rng.randint(1, 4))) for _ in range(10)]
        rows, lengths = np.zeros((10, 4), np.int64), np.array([len(p) for p in phrases])
        for i, p in enumerate(phrases):
            rows[i, : len(p)] = p
        low, high = index.search(rows, lengths)
        for i, p in enumerate(phrases):
            want = [j for j in range(len(text)) if tuple(text[j : j + len(p)]) == p]
            assert sorted(index.locate(np.arange(low[i], high[i])).tolist()) == want


@pytest.mark.parametrize(("block_bytes", "shard"), [(10, 1_000_000), (8_000_000, 1_000_000), (60, 50), (8_000_000, 700)])
def test_passages_by_brute_force(spark, edge_rows, monkeypatch, block_bytes, shard):
    monkeypatch.setattr(decontaminate, "SHARD", shard)  # shards span batches, or texts several shards
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = random.Random(7)
    some = ["ab", "cd", "ef", "gh"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(edge_rows.select("doc_id", "text"))
    items = [(1, " ".join(texts[0].split()[:12])), (2, "ab cd, EF"), (3, None), (4, "..."), (5, "ab cd, EF"), (6, " ".join(texts[1].split()[3:14])), (7, "quick brown fox jumps over the lazy dog and runs")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.find_passages(rows.coalesce(2), benchmark, block_bytes=block_bytes)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[i : i + 8]), set()).add(str(name))
    want = []
    for r in rows.collect():
        w, hit, found = words(r["text"]), set(), set()
        for i in range(len(w)):
            for n in {len(k) for k in windows}:
                if names := windows.get(tuple(w[i : i + n])) if i + n <= len(w) else None:
                    hit.update(range(i, i + n))
                    found |= names
        want.append((r["doc_id"], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_items_without_an_id_or_a_row(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "x"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "b c"), ("null", "x"), ("i", None)], "item_id string, text string")
    got = {r["doc_id"]: (r["items"], [tuple(s) for s in r["spans"]]) for r in decontaminate.find_passages(docs, items).collect()}
    assert got == {1: ([None], [(1, 3)]), 2: (["null"], [(0, 1)]), 3: ([], [])}
    assert {len(r["items"]) for r in decontaminate.find_passages(docs, items.limit(0)).collect()} == {0}
    assert decontaminate.digest(decontaminate.find_passages(docs.limit(0), items)).count() == 0


def test_long_texts_are_hashed_in_stretches(monkeypatch):
    from tidemark.llm import near_dups

    text = "one two " + "x" * 50 + "  three " * 9 + "y" * 30
    whole = near_dups.word_hashes(text)
    monkeypatch.setattr(near_dups, "STRETCH", 11)
    assert near_dups.word_hashes(text).tolist() == whole.tolist() and len(whole) == len(text.split())


def test_cut_words():
    assert decontaminate.cut_words("One, two. THREE four!", [(1, 3)]) == "One,  four!"


@pytest.mark.parametrize("text", ["john  at  example.com", "john\tat\texample.com", "john at\texample.com", "john\tat\texample\tdot\tcom", "john@example_dot_com", "john@example point com", "plus 1 555 123 4567"])
def test_blanks_do_not_hide_disguises(text):
    assert len(pii.find(f"write to {text} today")[1]) == 1


def test_quick_look_is_as_wide_as_the_transducers():
    rng = random.Random(11)
    words = ["john", "example", "com", "at", "AT", "dot", "Point", "plus", "_at_", "_dot_", "@", "7", "192", "one", "ſix", "fıve", "the", ".", "[at]", "(dot)", "&#64;", "＠", "-"]
    changed = 0
    for _ in range(20_000):
        text = "".join(rng.choice(words) + rng.choice(["", " ", " ", "  ", "\t", "\n", " ", " \n"]) for _ in range(rng.randint(2, 9)))
        if pii.undisguised(text).text != text:
            changed += 1
            assert pii.normalise(text) is not None, repr(text)
    assert changed > 1000


def test_a_better_notice_does_not_hide_one_before_it():
    notice = licenses.Notice("all rights reserved", "reserved")
    for line, want in ((b" al rights reserved x all rights reserved ", [1, 0]), (b" al rights reserved all rights reserved all rights reservd ", [1, 0, 1]), (b" all rights reserved " * 2000, [0] * 2000)):
        found = list(notice.places(b" " + b" ".join(line.split()) + b" "))
        assert [errors for *_, errors in found] == want
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


@pytest.mark.parametrize(
    ("text", "want"),
    [("one 22 three 4 x", "1223 4 x"), ("12 one two", "12 12"), ("7, one 33", "71 33"), ("x one 33-4", "x 1334"), ("five 12 34", "51234"), ("3 4 5", "3 4 5"), ("fıve-ſix", "56"), ("1 22 one", "1221")],
)
def test_runs_of_spelled_digits(text, want):
    assert pii.undisguised(text).text == want


def test_long_texts_take_linear_time():
    import time

    begin = time.process_time()
    for text in ("one " + "1 " * 1_000_000, "a​b" + " " * 2_000_000, "[at " * 500_000 + "​", "one 22 " * 300_000, "a at b" + " " * 2_000_000 + "dot c"):
        pii.find(text)
    assert time.process_time() - begin < 60


FOLDER = "/root/testdata/sf0.001"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def documents():
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    return con


def test_base_notices_by_sql(spark):
    want = documents().execute(rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        p(phrase, label) AS (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')),
        h AS (SELECT doc_id, i - 1 AS word, label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), p WHERE ws[i : i + len(phrase) - 1] = phrase)
        SELECT w.doc_id, len(ws), count(word), min(word), max(word), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM w LEFT JOIN h ON h.doc_id = w.doc_id GROUP BY 1, 2""").fetchall()
    got = licenses.op3_license_notices(spark, FOLDER).collect()
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_emails_and_addresses_by_sql(spark):
    want = documents().execute(r"""
        SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')),
        len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda y: y::HUGEINT)) <= 255)) FROM documents""").fetchall()
    assert sorted(want) == sorted((r["doc_id"], r["n_email"], r["n_ip"]) for r in pii.op2_pii_spans(spark, FOLDER).select("doc_id", "n_email", "n_ip").collect())


def test_many_notices_take_linear_time():
    import time

    fuzzy = licenses.notices(tuple(licenses.NOTICES.items()), licenses.PER_ERROR)
    begin = time.process_time()
    found = licenses.scan("all rights reserved and " * 20_000, licenses.BASE, fuzzy)
    assert len(found["base"]) == 20_000 and [b["word"] for b in found["base"]] == list(range(0, 80_000, 4)) and time.process_time() - begin < 60
    assert [s["first_word"] for s in found["spans"]] == list(range(0, 80_000, 4))
