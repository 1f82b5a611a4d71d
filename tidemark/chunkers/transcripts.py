"""Transcripts of coding sessions in JSON lines: one chunk for each turn of the user."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.shared import ready, settle
from . import CHUNK_SCHEMA, Chunk, Parsed

DIALECTS = ("claude-code", "codex")
INPUT_CHARS, RESULT_CHARS = 80, 200
# The fields of a tool's input that tell most, in order.
TELLING = {"claude-code": "file_path command query pattern path url".split(), "codex": "cmd command file_path path query pattern url".split()}
MARKER = "Output:\n"
#: Stands for the name of a call until it is known; no text of JSON holds it, as it is no character.
CALLED = "\ufdd0"


def shortened(text: str, most: int) -> str:
    """One line of at most so many characters; an ellipsis where it was cut."""
    line = " ".join(text.split())
    return line if len(line) <= most else line[:most] + "…"


def minute(stamp: str) -> str:
    day, parted, rest = stamp.partition("T")
    return f"{day} {':'.join(rest.split(':')[:2])}" if parted else stamp


def records(text: str) -> Iterator[tuple[dict, int, int]]:
    """(record, start, end) for each line that is a JSON object; others are passed over."""
    at = 0
    for line in text.split("\n"):
        end = at + len(line.encode("utf-8", "surrogatepass"))
        if line.strip():
            try:
                value = json.loads(line)
            except ValueError:
                value = None
            if isinstance(value, dict):
                yield value, at, end
        at = end + 1


def compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def text_of(value) -> str:
    """A string as it is, the texts of an array of blocks, or else the JSON."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return " ".join(b["text"] for b in value if isinstance(b, dict) and isinstance(b.get("text"), str))
    return "" if value is None else compact(value)


def tool_line(name: str, summary: str) -> str:
    return f"[tool: {name} {shortened(summary, INPUT_CHARS)}]" if summary else f"[tool: {name}]"


def telling(value, dialect: str) -> str:
    if isinstance(value, dict):
        for key in TELLING[dialect]:
            if isinstance(value.get(key), str) and value[key]:
                return value[key]
    return "" if value is None else compact(value)


class Turn:
    def __init__(self, stamp: str, start: int, end: int, said: str):
        self.stamp, self.start, self.end, self.said, self.events = stamp, start, end, said, []

    def content(self) -> str:
        body = f"USER: {self.said}\n" if self.said else ""
        if self.events:
            body += "\nASSISTANT:\n" + "".join(f"{e}\n" for e in self.events)
        return body


class Transcript:
    """Either dialect; with ``thinking``, reasoning is kept too."""

    def __init__(self, dialect: str, thinking: bool = False):
        self.dialect, self.thinking = dialect, thinking

    def line(self, r: dict) -> tuple[str, str, str, list[str], str, str, str | None, str | None]:
        """(role, stamp, said, events, project, branch, call, name) of one record, on its own.

        The role is user, more (of the turn before) or none. An event of a call's result has CALLED for the call's name,
        and the line names the call; a line that makes a call names it and what it calls.
        """
        if self.dialect == "claude-code":
            text = lambda key: r[key] if isinstance(r.get(key), str) else ""
            role = {"user": "user", "assistant": "more"}.get(r.get("type"), "none")
            return role, r.get("timestamp") or "", self._user(r) if role == "user" else "", self._events(r) if role == "more" else [], text("cwd"), text("gitBranch"), None, None
        p = r["payload"] if isinstance(r.get("payload"), dict) else {}
        if r.get("type") == "session_meta":
            return "none", "", "", [], p.get("cwd") or "", "", None, None
        if r.get("type") != "response_item" or not p:
            return "none", "", "", [], "", "", None, None
        if p.get("type") == "message" and p.get("role") == "user":
            return "user", r.get("timestamp") or "", self._said(p), [], "", "", None, None
        call = p.get("call_id") or None
        return "more", "", "", self._item(p, {call or "": CALLED}), "", "", call, p.get("name") if p.get("type") == "function_call" else None

    def __call__(self, text: str, path: str) -> Parsed:
        found = list(records(text))
        turns, heading = self._blocks(found) if self.dialect == "claude-code" else self._items(found)
        return Parsed([Chunk(i, heading(t), t.content(), t.start, t.end) for i, t in enumerate(turns) if t.said or t.events])

    def _blocks(self, found):
        first = lambda key: next((r[key] for r, _, _ in found if isinstance(r.get(key), str) and r[key]), "")
        project, branch = first("cwd"), first("gitBranch")
        project = os.path.basename(project.rstrip("/")) or project
        turns: list[Turn] = []
        for r, start, end in found:
            if r.get("type") == "user":
                turns.append(Turn(r.get("timestamp") or "", start, end, self._user(r)))
            elif r.get("type") == "assistant" and turns:
                turns[-1].end = end
                turns[-1].events += self._events(r)
        return turns, lambda t: " · ".join(x for x in (project, minute(t.stamp), branch and f"branch:{branch}") if x)

    def _user(self, r: dict) -> str:
        content = (r.get("message") or {}).get("content")
        if isinstance(content, str):
            return content.strip()
        out = []
        for b in content if isinstance(content, list) else []:
            if b.get("type") == "text" and isinstance(b.get("text"), str) and b["text"].strip():
                out.append(b["text"].strip())
            elif b.get("type") == "tool_result":
                out.append(f"[tool result: {shortened(text_of(b.get('content')), RESULT_CHARS)}]")
        return "\n".join(out)

    def _events(self, r: dict) -> list[str]:
        content, out = (r.get("message") or {}).get("content"), []
        for b in content if isinstance(content, list) else []:
            kind = b.get("type")
            if kind == "text" and isinstance(b.get("text"), str) and b["text"].strip():
                out.append(b["text"].strip())
            elif kind == "thinking" and self.thinking and isinstance(b.get("thinking"), str) and b["thinking"].strip():
                out.append(f"[thinking] {b['thinking'].strip()}")
            elif kind == "tool_use":
                out.append(tool_line(b.get("name") or "?", telling(b.get("input"), self.dialect)))
            elif kind == "tool_result":
                out.append(f"[tool result: {shortened(text_of(b.get('content')), RESULT_CHARS)}]")
        return out

    def _items(self, found):
        payload = lambda r: r["payload"] if isinstance(r.get("payload"), dict) else {}
        meta = next((payload(r) for r, _, _ in found if r.get("type") == "session_meta"), {})
        project = meta.get("cwd") or ""
        project = os.path.basename(project.rstrip("/")) or project
        names = {p["call_id"]: p["name"] for r, _, _ in found if (p := payload(r)).get("type") == "function_call" and p.get("call_id") and p.get("name")}
        turns: list[Turn] = []
        for r, start, end in found:
            p = payload(r)
            if r.get("type") != "response_item" or not p:
                continue
            if p.get("type") == "message" and p.get("role") == "user":
                turns.append(Turn(r.get("timestamp") or "", start, end, self._said(p)))
            elif turns:
                turns[-1].end = end
                turns[-1].events += self._item(p, names)
        return turns, lambda t: " · ".join(x for x in (project, minute(t.stamp), "codex") if x)

    def _said(self, p: dict) -> str:
        texts = [b["text"].strip() for b in p.get("content") or [] if isinstance(b, dict) and isinstance(b.get("text"), str)]
        return "\n".join(x for x in texts if x)

    def _item(self, p: dict, names: dict[str, str]) -> list[str]:
        kind = p.get("type")
        if kind == "message":
            return [said] if (said := self._said(p)) else []
        if kind == "reasoning" and self.thinking:
            said = " ".join(b["text"] for b in p.get("summary") or [] if isinstance(b, dict) and isinstance(b.get("text"), str))
            return [f"[reasoning] {shortened(said, RESULT_CHARS)}"] if said.strip() else []
        if kind == "function_call":
            raw = p.get("arguments") if isinstance(p.get("arguments"), str) else ""
            try:
                parsed = json.loads(raw)
            except ValueError:
                parsed = None
            summary = next((parsed[k] for k in TELLING["codex"] if isinstance(parsed.get(k), str) and parsed[k]), raw) if isinstance(parsed, dict) else raw
            return [tool_line(p.get("name") or "?", summary)]
        if kind == "function_call_output":
            output = p.get("output") if isinstance(p.get("output"), str) else ""
            output = output.partition(MARKER)[2] if MARKER in output else output
            return [f"[tool result {names.get(p.get('call_id') or '', '?')}: {shortened(output, RESULT_CHARS)}]"]
        return []


LINES = "source string, path string, line long, start long, end long, role string, stamp string, said string, events array<string>, project string, branch string, call string, name string"


def turns_by_line(lines: DataFrame, dialect: str, thinking: bool = False) -> DataFrame:
    """The chunks of transcripts, from rows (source, path, line, value) of their lines in order: what the chunker makes of files.

    No file comes together in a row: a line is read on its own, its bytes and its turn are running sums over the file, the
    names of calls are joined by their ids, and a turn's events are put together in order. Lines that aren't JSON objects
    count for the bytes alone; null values are empty lines.
    """
    ready(lines.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Transcript(dialect, thinking).line
        for batch in batches:
            rows = []
            for source, path, line, start, end, value in batch.itertuples(index=False):
                for r, _, _ in records(value or ""):
                    rows.append((source, path, line, start, end, *read(r)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in LINES.split(", ")])

    file, c = ["source", "path"], F.col
    so_far = Window.partitionBy(*file).orderBy("line")
    size = F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")
    placed = lines.withColumn("end", F.sum(size + 1).over(so_far) - 1).withColumn("start", c("end") - size)
    parsed = settle(placed.select(*file, c("line").cast("long").alias("line"), "start", "end", "value").mapInPandas(run, LINES), "transcript-lines")
    firsts = [F.min_by(k, F.when(c(k) != "", c("line"))).alias(k) for k in ("project", "branch")]
    marks = parsed.groupBy(*file).agg(*firsts)
    calls = parsed.where("call IS NOT NULL AND name IS NOT NULL AND name <> ''").groupBy(*file, "call").agg(F.max_by("name", "line").alias("called"))
    numbered = parsed.withColumn("turn", F.sum((c("role") == "user").cast("int")).over(so_far)).where("role <> 'none' AND turn > 0")
    named = numbered.join(calls, [*file, "call"], "left")
    events = F.transform("events", lambda e: F.replace(e, F.lit(f"[tool result {CALLED}:"), F.concat(F.lit("[tool result "), F.coalesce("called", F.lit("?")), F.lit(":"))))
    own = lambda k: F.max(F.when(c("role") == "user", c(k))).alias(k)
    turns = named.groupBy(*file, "turn").agg(own("stamp"), own("said"), F.min("start").alias("start"), F.max("end").alias("end"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", events.alias("events")))), lambda x: x["events"])).alias("events"))
    turns = turns.join(marks, file).where((c("said") != "") | (F.size("events") > 0))
    body = F.concat(F.when(c("said") != "", F.concat(F.lit("USER: "), "said", F.lit("\n"))).otherwise(""), F.when(F.size("events") > 0, F.concat(F.lit("\nASSISTANT:\n"), F.array_join("events", "\n"), F.lit("\n"))).otherwise(""))
    trimmed = F.rtrim(c("project"), F.lit("/"))
    base = F.when(F.element_at(F.split(trimmed, "/"), -1) != "", F.element_at(F.split(trimmed, "/"), -1)).otherwise(c("project"))
    day = F.when(F.contains("stamp", F.lit("T")), F.concat(F.substring_index("stamp", "T", 1), F.lit(" "), F.substring_index(F.substring("stamp", F.instr("stamp", "T") + 1, F.length("stamp")), ":", 2))).otherwise(c("stamp"))
    last = F.lit("codex") if dialect == "codex" else F.when(c("branch") != "", F.concat(F.lit("branch:"), "branch"))
    heading = F.array_join(F.filter(F.array(base, day, last), lambda x: x != ""), " · ")
    return turns.select(*file, (c("turn") - 1).cast("int").alias("chunk_idx"), heading.alias("heading_path"), body.alias("content"), c("start").cast("int").alias("start_byte"), c("end").cast("int").alias("end_byte"), F.lit("prose").alias("kind"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("int").alias("parent_chunk_idx"))
