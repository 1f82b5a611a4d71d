import json

import pytest

from tidemark.chunkers import chunk_files, chunker_for, link_files, transcripts
from tidemark.sources import files as sources


def test_markdown_sections_windows_and_spans():
    long = "\n\n".join(f"paragraph {i} " + "word " * 40 for i in range(12))
    text = f"# Top\n\nintro\n\n## Inner ##\n\n{long}\n\n```\n# no heading\n[[No]]\n```\n\n# Last\n\nsee [[folder/Note|x]], [t](other.md) and [[Solo#h]] é\n"
    parsed = chunker_for("notes")(text, "a/b.md")
    raw = text.encode()
    assert [c.heading for c in parsed.chunks][0] == "Top" and parsed.chunks[-1].heading == "Last"
    assert {c.heading for c in parsed.chunks[1:-1]} == {"Top > Inner"} and len(parsed.chunks) > 3
    assert all(len(c.content.encode()) <= 1800 for c in parsed.chunks)
    assert "see [[folder" in raw[parsed.chunks[-1].start : parsed.chunks[-1].end].decode()
    assert parsed.chunks[2].content.split("\n\n")[0] in parsed.chunks[1].content  # overlap
    assert [(x.symbol, x.path, x.chunk) for x in parsed.links] == [("Note", "folder/Note", parsed.chunks[-1].idx), ("other", "other.md", parsed.chunks[-1].idx), ("Solo", None, parsed.chunks[-1].idx)]


def test_markdown_small_blank_and_frontmatter():
    parse = chunker_for("docs")
    assert parse(" \n", "a.md").chunks == []
    assert [c.content for c in parse("# A\n\nshort\n", "a.md").chunks] == ["# A\n\nshort\n"]
    said = parse('---\ntitle: "x"\ncreated: 1\ntags:\n- [[y]]\n- z\n---\n', "my_note-1.md").chunks[0].content
    assert said == "my note 1. Title: x. Tags: y, z"


def test_markdown_of_headings_alone():
    text = "\n".join(f"## Part {i} of the long list of parts" for i in range(80))
    chunk, = chunker_for("notes")(text, "a.md").chunks
    assert (chunk.content, chunk.start, chunk.end, chunk.heading) == (text, 0, len(text.encode()), "")


def test_code_languages():
    parse = chunker_for("code")
    kinds = lambda text, path: [(c.kind, c.symbol, c.heading) for c in parse(text, path).chunks]
    assert kinds("import os\nimport sys\n\nclass A(B):\n    def f(self):\n        return g(1)\n\ndef g(x):\n    return x\n", "p.py") == [("module", "p", ""), ("class", "A", ""), ("method", "f", "A"), ("function", "g", "")]
    assert kinds("pub fn alpha(x: u8) -> u8 { beta(x) }\nimpl Show for S {\n    fn show(&self) {}\n}\n", "a.rs") == [("function", "alpha", ""), ("impl", "S", ""), ("method", "show", "S")]
    assert ("class", "Foo", "") in kinds("class Foo\n  def bar\n    baz(1)\n  end\nend\n", "a.rb")
    assert ("interface", "I", "") in kinds("export interface I { a: string }\nexport class C implements I {\n  go(x: number) { return h(x); }\n}\n", "a.ts")
    assert ("method", "Do", "") in kinds("package p\n\nfunc (s *S) Do(x int) int {\n\treturn f(x)\n}\n", "a.go")
    assert ("method", "run", "R") in kinds("class R implements Q {\n  public void run() {\n    go();\n  }\n}\n", "R.java")
    assert kinds("just words\n", "x.txt") == [("module", "x", "")]
    links = {(x.kind, x.symbol) for x in parse("class A(B):\n    def f(self):\n        return g(1)\n", "p.py").links}
    assert links == {("implements", "B"), ("calls", "g")}


def test_transcripts():
    lines = [{"type": "user", "timestamp": "2031-11-02T07:09:41Z", "cwd": "/w/quarry", "gitBranch": "west", "message": {"content": " count the stones "}}, {"type": "assistant", "message": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, {"type": "tool_use", "name": "Read", "input": {"file_path": "a.py"}}]}}, {"type": "user", "timestamp": "", "message": {"content": [{"type": "tool_result", "content": [{"text": "body"}]}]}}]
    text = "\n".join([json.dumps(lines[0]), "{broken", *map(json.dumps, lines[1:])])
    chunks = chunker_for("claude-code")(text, "s.jsonl").chunks
    assert chunks[0].heading == "quarry · 2031-11-02 07:09 · branch:west"
    assert chunks[0].content == "USER: count the stones\n\nASSISTANT:\nok\n[tool: Read a.py]\n" and "tool result: body" in chunks[1].content
    plain = json.dumps({"type": "assistant", "message": {"content": "words alone"}})
    assert chunker_for("claude-code")(f"{text}\n{plain}", "s.jsonl").chunks[-1].content == chunks[-1].content
    assert "[thinking] hm" in chunker_for("claude-code", True)(text, "s.jsonl").chunks[0].content
    items = [{"type": "session_meta", "payload": {"cwd": "/w/p2"}}, {"timestamp": "2026-01-02T03:04:05Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"text": "hello"}]}}, {"type": "response_item", "payload": {"type": "function_call", "call_id": "1", "name": "sh", "arguments": '{"cmd": "ls"}'}}, {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "1", "output": "Code: 0\nOutput:\na b"}}]
    chunk = chunker_for("codex")("\n".join(map(json.dumps, items)), "s.jsonl").chunks[0]
    assert chunk.heading == "p2 · 2026-01-02 03:04 · codex" and chunk.content == "USER: hello\n\nASSISTANT:\n[tool: sh ls]\n[tool result sh: a b]\n"


def test_chunk_tables(spark):
    files = spark.createDataFrame([("s", "a.md", "# A\n\nsee [[B]]\n"), ("s", "b.md", None)], "source string, path string, content string")
    assert [(r["path"], r["chunk_idx"]) for r in chunk_files(files, "notes").collect()] == [("a.md", 0)]
    assert [(r["kind"], r["target_symbol"]) for r in link_files(files, "notes").collect()] == [("wikilink", "B")]


@pytest.mark.parametrize("dialect", ["claude-code", "codex"])
@pytest.mark.parametrize("thinking", [False, True])
def test_turns_by_line_are_those_of_files(spark, tmp_path, dialect, thinking):
    block = lambda **b: b
    claude = [
        {"type": "assistant", "message": {"content": [block(type="text", text="before any user")]}},
        {"type": "user", "timestamp": "2031-11-02T07:09:41Z", "cwd": "/w/quarry/", "gitBranch": "west", "message": {"content": " count \u00e9 "}},
        {"type": "assistant", "message": {"content": [block(type="thinking", thinking="hm"), block(type="text", text="ok"), block(type="tool_use", name="Read", input={"file_path": "a.py"})]}},
        {"type": "user", "timestamp": "", "message": {"content": [block(type="tool_result", content=[{"text": "body  of it"}])]}},
        {"type": "summary", "cwd": "/later"},
        {"type": "user", "message": {"content": ""}},
        {"type": "user", "timestamp": "2031", "message": {"content": "last"}},
    ]
    item = lambda **p: {"type": "response_item", "timestamp": "2026-01-02T03:04:05Z", "payload": p}
    codex = [
        {"type": "session_meta", "payload": {"cwd": "/w/p2"}},
        item(type="message", role="user", content=[{"text": "hello"}]),
        item(type="function_call_output", call_id="1", output="early\u2028x"),
        item(type="reasoning", summary=[{"text": "so"}]),
        item(type="function_call", call_id="1", name="sh", arguments='{"cmd": "ls"}'),
        item(type="function_call_output", call_id="1", output="Code: 0\nOutput:\na b " + "c" * 300),
        item(type="function_call_output", call_id="2", output="none"),
        item(type="message", role="user", content=[{"text": " "}]),
        item(type="message", role="assistant", content=[{"text": "done"}]),
    ]
    folder = tmp_path / "t"
    folder.mkdir()
    texts = {}
    for k, own in enumerate((claude if dialect == "claude-code" else codex, [], (claude if dialect == "claude-code" else codex)[3:])):
        texts[f"s{k}.jsonl"] = "\n".join(x for r in own for x in (json.dumps(r, ensure_ascii=k == 0), *(["{broken", "", "[1]"] if k == 2 else []))) + "\n" * (k == 0)
        (folder / f"s{k}.jsonl").write_text(texts[f"s{k}.jsonl"])
    files = spark.createDataFrame([("s", p, t) for p, t in texts.items()], "source string, path string, content string")
    want = sorted(map(tuple, chunk_files(files, dialect, thinking).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # a file is read by several tasks
    try:
        lines = sources.transcript_lines(spark, str(folder)).selectExpr("'s' AS source", "substring_index(path, '/', -1) AS path", "line", "value")
        got = sorted(map(tuple, transcripts.turns_by_line(lines, dialect, thinking).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want and len(want) >= 3

