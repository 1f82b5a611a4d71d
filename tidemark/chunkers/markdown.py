"""Notes in Markdown: sections by heading, long ones in windows of paragraphs that overlap; links between notes."""

from __future__ import annotations

import os
import re
from bisect import bisect_right

from . import Chunk, Link, Parsed

# Bytes of a window, of a file that stays whole, and of the overlap, by mode.
SIZES = {"obsidian": (1800, 1600, 270), "notes": (1800, 1600, 270), "docs": (1200, 1000, 180)}
# Frontmatter keys that say nothing of the topic.
NOISY_KEYS = "imdbId imdb_id url cover image coordinates created modified published last id uuid".split()
LEAST_BODY = 50
# Fixed value: what a heading of a note is.
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
NOTE_LINK = re.compile(r"\[\[([^\]\[|#\n]*)(?:#[^\]\[|\n]*)?(?:\|[^\]\[\n]*)?\]\]")
MARKDOWN_LINK = re.compile(r"\[[^\]\n]*\]\(([^)\s#]+?\.md)(?:#[^)\s]*)?\)")


def frontmatter(text: str) -> tuple[str | None, str]:
    """The block between a first and a second line of ---, and what follows; None if the text has none."""
    lines = text.removeprefix("﻿").split("\n")
    if lines[0].rstrip("\r") != "---":
        return None, text
    for i, line in enumerate(lines[1:], 1):
        if line.rstrip("\r") == "---":
            return "\n".join(lines[1:i]), "\n".join(lines[i + 1 :])
    return None, text


def _plain(value: str) -> str:
    value = value.strip().strip('"').strip("'")
    while value.startswith("[["):
        value = value[2:]
    while value.endswith("]]"):
        value = value[:-2]
    return value.strip()


def from_frontmatter(path: str, block: str) -> str:
    """A sentence for a note that has hardly more than its frontmatter: its title and its fields."""
    fields: list[tuple[str, list[str]]] = []
    for line in block.splitlines():
        line = line.strip()
        if line.startswith("- "):
            if fields and (value := _plain(line[2:])):
                fields[-1][1].append(value)
        elif ":" in line:
            key, _, rest = line.partition(":")
            fields.append((key.strip(), [value] if (value := _plain(rest)) else []))
    title = os.path.splitext(os.path.basename(path))[0].replace("_", " ").replace("-", " ")
    said = [f"{(k := key.replace('_', ' '))[:1].upper()}{k[1:]}: {', '.join(values)}" for key, values in fields if values and key not in NOISY_KEYS]
    return ". ".join([title, *said])


def lines_with_bytes(text: str):
    """(line without its end, first byte, byte after its end) for each line."""
    at = 0
    for line in text.splitlines(keepends=True) if "\r" not in text else re.findall(r"[^\n]*\n|[^\n]+", text):
        size = len(line.encode("utf-8", "surrogatepass"))
        yield line.rstrip("\n").rstrip("\r"), at, at + size
        at += size


def fenced(line: str) -> bool:
    return line.lstrip().startswith(("```", "~~~"))


def sections(text: str) -> list[tuple[str, str, int, int]]:
    """(heading path, body, start, end): what stands under each heading; blank bodies are left out."""
    out, stack, fence = [], [], False
    raw = text.encode("utf-8", "surrogatepass")
    begin = end = 0

    def close():
        body = raw[begin:end].decode("utf-8", "surrogatepass")
        if body.strip():
            out.append((" > ".join(t for _, t in stack), body, begin, end))

    for line, start, after in lines_with_bytes(text):
        if fenced(line):
            fence = not fence
        found = None if fence else HEADING.match(line)
        if found:
            close()
            level = len(found[1])
            stack = [x for x in stack if x[0] < level] + [(level, found[2])]
            begin = after
        end = after
    close()
    if not out and text.strip():  # headings alone
        out.append(("", text, 0, len(raw)))
    return out


def paragraphs(body: str, offset: int) -> list[tuple[str, int, int]]:
    """Blocks between blank lines, with their bytes; a fenced block is never parted."""
    out, held, fence, begin, end = [], [], False, offset, offset
    for line, start, after in lines_with_bytes(body):
        if not line.strip() and not fence:
            if held:
                out.append(("\n".join(held), begin, end))
            held = []
            continue
        if fenced(line):
            fence = not fence
        if not held:
            begin = offset + start
        held.append(line)
        end = offset + after
    if held:
        out.append(("\n".join(held), begin, end))
    return out


def size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def tail(text: str, overlap: int) -> str:
    """The last whole paragraphs within ``overlap`` bytes; nothing if the text is no longer than that."""
    raw = text.encode("utf-8", "surrogatepass")
    if not overlap or len(raw) <= overlap:
        return ""
    cut = raw.find(b"\n\n", len(raw) - overlap)
    return raw[cut + 2 :].decode("utf-8", "surrogatepass") if cut >= 0 else ""


def windows(body: str, offset: int, target: int, overlap: int) -> list[tuple[str, int, int]]:
    """Paragraphs gathered up to ``target`` bytes; each window begins with the end of the one before.

    A window's bytes are those of its own paragraphs, without what it carries over.
    """
    out: list[tuple[str, int, int]] = []
    text, begin, end = "", offset, offset
    for block, start, after in paragraphs(body, offset):
        if text and size(text) + 2 + size(block) > target:
            out.append((text, begin, end))
            text, begin = tail(text, overlap), start
        elif not text:
            begin = start
        text, end = f"{text}\n\n{block}" if text else block, after
    if text.strip():
        out.append((text, begin, end))
    return out


def fenced_bytes(text: str) -> list[tuple[int, int]]:
    out, begin = [], None
    for line, start, after in lines_with_bytes(text):
        if fenced(line):
            if begin is None:
                begin = start
            else:
                out.append((begin, after))
                begin = None
    if begin is not None:
        out.append((begin, size(text)))
    return out


def note_links(text: str) -> list[tuple[int, str, str | None]]:
    """(byte, title, path) of each link to a note outside fences; the path as it is written, only if the link names a
    folder or is one in brackets and parentheses."""
    shut, out = fenced_bytes(text), []
    begins = [a for a, _ in shut]
    for pattern, always in ((NOTE_LINK, False), (MARKDOWN_LINK, True)):
        at, last = 0, 0
        for m in pattern.finditer(text):
            target = m[1].strip()
            at, last = at + size(text[last : m.start()]), m.start()  # bytes go on from the link before
            if not target or "://" in target:
                continue
            around = bisect_right(begins, at) - 1
            if around >= 0 and at < shut[around][1]:
                continue
            title = target.rsplit("/", 1)[-1].removesuffix(".md")
            out.append((at, title, target if always or "/" in target else None))
    return sorted(out, key=lambda x: x[0])


class Markdown:
    def __init__(self, target: int, whole: int, overlap: int):
        self.target, self.whole, self.overlap = target, whole, overlap

    def chunks(self, text: str, path: str) -> list[Chunk]:
        if not text.strip():
            return []
        block, body = frontmatter(text)
        if block is not None and size(body.strip()) < LEAST_BODY:
            said = from_frontmatter(path, block)
            return [Chunk(0, "", f"{said}\n\n{body.strip()}".strip() if body.strip() else said, 0, size(text))]
        if size(text) <= self.whole:
            return [Chunk(0, "", text, 0, size(text))]
        out: list[Chunk] = []
        for heading, content, start, end in sections(text):
            parts = [(content, start, end)] if size(content) <= self.target else windows(content, start, self.target, self.overlap)
            out += [Chunk(len(out) + i, heading, c, a, b) for i, (c, a, b) in enumerate(parts)]
        return out

    def __call__(self, text: str, path: str) -> Parsed:
        chunks = self.chunks(text, path)
        links = [Link(holder(chunks, at), "wikilink", title, target) for at, title, target in note_links(text)] if chunks else []
        return Parsed(chunks, links)


def holder(chunks: list[Chunk], at: int) -> int:
    """The chunk whose bytes hold the place; else the last that begins before it; else the first."""
    inside = next((c.idx for c in chunks if c.start <= at < c.end), None)
    if inside is not None:
        return inside
    return next((c.idx for c in reversed(chunks) if c.start <= at), chunks[0].idx)
