"""Personal data in disguised text: normalise by transducers that keep offsets, detect, map spans back to the source."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
DIGIT = re.compile(r"[0-9]")
DOTTED = re.compile(r"[0-9][0-9.]*+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping addresses, in time linear in the text: a match is what stands before an @ and its domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and not LOCAL_END.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield "email", start, found.end()
            end = found.end()
        at = text.find("@", max(end, at + 1))


def detect(text: str) -> list[Span]:
    """The plain identifiers, by kind as listed in KINDS and then by start; matches that fail their test are dropped."""
    out: list[Span] = []
    if "@" in text:
        out += emails(text)
    if not DIGIT.search(text):
        return out
    for run in DOTTED.finditer(text) if "." in text else ():
        for m in IP.finditer(text, run.start(), run.end()) if run[0].count(".") >= 3 else ():
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := NOT_DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


@dataclass
class Aligned:
    """A text with the source span of each of its characters."""

    text: str
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, text: str) -> Aligned:
        places = np.arange(len(text) + 1)
        return cls(text, places[:-1], places[1:])

    def rewrite(self, pattern: re.Pattern, output) -> Aligned:
        """One transducer: what the pattern matches becomes ``output(match)``; its characters share the match's span."""
        return self.replace([(m.start(), m.end(), output(m)) for m in pattern.finditer(self.text)])

    def replace(self, spans: list[tuple[int, int, str]]) -> Aligned:
        """The text with new words for some of its spans, which are in order and don't overlap."""
        parts, starts, ends, last = [], [], [], 0
        for a, b, new in spans:
            parts += [self.text[last:a], new]
            starts += [self.starts[last:a], np.full(len(new), self.starts[a])]
            ends += [self.ends[last:a], np.full(len(new), self.ends[b - 1])]
            last = b
        if not spans:
            return self
        return Aligned("".join(parts) + self.text[last:], np.concatenate([*starts, self.starts[last:]]), np.concatenate([*ends, self.ends[last:]]))

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.ends[end - 1])


# Letters of other scripts that look like a Latin one, and the Latin ones in the same order.
_LOOK = "аеорсхуіјѕԁӏһԛԝАВЕКМНОРСТХІЈЅαορνικτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
_LATIN = "aeopcxyijsdlhqwABEKMHOPCTXIJSaopviktABEZHIKMNOPTYX"
#: Signs that stand for one of the signs in identifiers.
_SIGNS = {"\uff20": "@", "\ufe6b": "@", "\u2024": ".", "\u3002": ".", "\uff0e": ".", "\ufe52": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\uff0d": "-", "\uff0b": "+", "\ufe62": "+", "\uff3f": "_", "\uff08": "(", "\uff09": ")", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " "}
#: What shows nothing: it is deleted.
_HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def _glyphs() -> dict[int, str]:
    out = dict(zip(map(ord, _LOOK), _LATIN, strict=True)) | {ord(k): v for k, v in _SIGNS.items()}
    out |= {0xFF10 + i: str(i) for i in range(10)} | {0xFF21 + i: chr(65 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
    out |= {zero + i: str(i) for zero in (0x660, 0x6F0, 0x966) for i in range(10)}  # digits of other scripts
    out |= {0x1D7CE + i: str(i % 10) for i in range(50)} | {0x2080 + i: str(i) for i in range(10)} | {0x2460 + i: str(i + 1) for i in range(9)}  # mathematical, low, ringed
    out |= {0x1D400 + i: chr((65 if i % 52 < 26 else 71) + i % 52) for i in range(13 * 52)}  # mathematical letters
    return out


GLYPHS = _glyphs()
STRANGE = re.compile("[" + "".join(map(re.escape, map(chr, GLYPHS))) + _HIDDEN + "]")
FAR = re.compile("[\u00ad\u0370-\U0010ffff]")
ENTITY = re.compile(r"&#0*(64|46|43|45|95|4[89]|5[0-7]);|&#x0*(40|2e|2b|2d|5f|3[0-9]);|&(commat|period|plus|lowbar|hyphen);|%40", re.I)
_NAMED = {"commat": "@", "period": ".", "plus": "+", "lowbar": "_", "hyphen": "-"}
# A word in brackets stands for its sign wherever it is; a bare one only between parts of an address.
# Blanks before a bracket belong to the match from their first on, so a run of them is gone through once.
BRACKETED = re.compile(r"(?:(?<!\s)\s++)?[\[({<]\s*+(at|@|dot|point|\.|dash|hyphen|minus|underscore|plus)\s*+[\])}>]\s*+", re.I)
WORD_AT = re.compile(r"(?<=[A-Za-z0-9])(?:\s+at\s+|\s+@\s*|@\s+)(?!(?:the|an?|this|that|my|your|our|its?)\b)(?=[A-Za-z0-9-]+(?:(?:\s+(?:dot|point)\s+|\.)[A-Za-z0-9-]+)+)|(?<=[A-Za-z0-9])_at_(?=[A-Za-z0-9-]+(?:_dot_|\.))", re.I)
OPEN_SIGN = re.compile(r"[\[({<]\s*(?:at|@|dot|point|\.|dash|hyphen|minus|underscore|plus)\s*[\])}>]", re.I)
LOOSE_AT = re.compile(r"\s@|@\s")
#: Quick looks at the lower-cased text, each beginning with a fixed string and at least as wide as its transducer: is
#: there a word that could be a sign? The second stand for dots, which count beside an @ or between digits only.
_LOOK_SIGN = {"at": re.compile(r"at(?<=\sat)\s+[a-z0-9-]+(?:\.[a-z0-9-]|\s+(?:dot|point)\s)"), "_at_": re.compile("_at_"), "plus": re.compile(r"plus\s+[0-9]")}
_LOOK_DOT = {"dot": re.compile(r"dot(?:(?<=\sdot)\s|(?<=_dot)_)"), "point": re.compile(r"point(?<=\spoint)\s")}
#: Capitals and small letters that patterns without case take for Latin ones, though lower() doesn't.
_FOLDED = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}
_SMALL = str.maketrans(_FOLDED)
WORD_DOT = re.compile(r"(?<=[A-Za-z0-9])(?:\s+(?:dot|point)\s+|_dot_)(?=[A-Za-z0-9])", re.I)
_SIGN_WORDS = {"at": "@", "@": "@", "dot": ".", "point": ".", ".": ".", "dash": "-", "hyphen": "-", "minus": "-", "underscore": "_", "plus": "+"}
_DIGIT_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0", "null": "0"}
_NUMBER = "|".join(_DIGIT_WORDS)
#: Spelled numbers and digits one after the other, each run gone through once; and one of its members.
NUMBERS = re.compile(rf"\b(?:{_NUMBER}|[0-9]++)\b(?:(?:[\s,]{{1,3}}|-)(?:{_NUMBER}|[0-9]++)\b)*+", re.I)
MEMBER = re.compile(rf"({_NUMBER})|[0-9]+", re.I)
#: Four numbers with spelled dots between, of which single digits and ten may be spelled too.
_PART = rf"(?:{_NUMBER}|ten|[0-9]{{1,3}})"
FOUR_NUMBERS = re.compile(rf"\b{_PART}(?:\s+(?:dot|point)\s+{_PART}){{3}}\b", re.I)
NUMBER_WORD = re.compile(rf"\b(?:{_NUMBER}|ten)\b", re.I)
#: Words that stand before "at" and a host's name without being a mailbox.
NO_MAILBOX = frozenset("look looks looking looked arrive arrives arrived stay stays stayed meet met see seen find found be is are was were am available hosted host located visit here there me us it them you him her us online live listens listening running runs start starts stop stops sold buy order work works working shop only not and or also even point points read more live call".split())
PLUS_WORD = re.compile(r"\bplus\s+(?=[0-9])", re.I)
_LOOK_NUMBER = {w: re.compile(rf"{w}\b(?<=\b{w})") for w in _DIGIT_WORDS}


def _entity(m: re.Match) -> str:
    if m[1]:
        return chr(int(m[1]))
    if m[2]:
        return chr(int(m[2], 16))
    return _NAMED[m[3].lower()] if m[3] else "@"


def spelled(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans that a spelled number and its neighbours make, and their digits.

    In a run of members a span goes from the first that is spelled or a single digit to the last that is spelled; if
    that is the same one, the digits after it follow.
    """
    for run in NUMBERS.finditer(text):
        members = [(m.start(), m.end(), m[1]) for m in MEMBER.finditer(text, run.start(), run.end())]
        words = [i for i, (_, _, word) in enumerate(members) if word]
        if not words:
            continue
        last = words[-1]
        first = next(i for i, (a, b, word) in enumerate(members) if word or b - a == 1 and i < last)
        if first == last:
            last = len(members) - 1
        if first < last:
            own = members[first : last + 1]
            yield own[0][0], own[-1][1], "".join(_DIGIT_WORDS[word.lower().translate(_SMALL)] if word else text[a:b] for a, b, word in own)


def disguised(text: str) -> bool:
    """A quick look: False only if no transducer would change the text."""
    plain = text.isascii() or not any(c in text for c in _FOLDED)
    small = (text if plain else text.translate(_SMALL)).lower()
    if not text.isascii() and FAR.search(text) and STRANGE.search(text) or ("&" in text or "%40" in text) and ENTITY.search(text):
        return True
    if any(w in small and look.search(small) for w, look in _LOOK_NUMBER.items()):
        return True
    if any(x in text for x in "[({<") and OPEN_SIGN.search(text) or "@" in text and LOOSE_AT.search(text):
        return True
    if any(x in small and look.search(small) for x, look in _LOOK_SIGN.items()):
        return True
    dots = any(x in small and look.search(small) for x, look in _LOOK_DOT.items())
    return bool(dots and ("@" in text or SOME_DIGIT_DOT.search(text)))


def undisguised(text: str) -> Aligned:
    """The text after all transducers."""
    out = Aligned.of(text)
    out = out.rewrite(STRANGE, lambda m: GLYPHS.get(ord(m[0]), ""))
    out = out.rewrite(ENTITY, _entity)
    out = out.rewrite(BRACKETED, lambda m: _SIGN_WORDS[m[1].lower()])
    out = out.replace(list(spelled(out.text)))
    chained = [(m.start(), m.end(), "10" if m[0].lower() == "ten" else _DIGIT_WORDS[m[0].lower().translate(_SMALL)]) for chain in FOUR_NUMBERS.finditer(out.text) for m in NUMBER_WORD.finditer(out.text, chain.start(), chain.end())]
    if chained:
        out = out.replace(chained)
    out = out.rewrite(PLUS_WORD, lambda m: "+")
    out = out.rewrite(WORD_AT, lambda m: "@")
    if "@" in out.text or SOME_DIGIT_DOT.search(out.text):
        out = out.rewrite(WORD_DOT, lambda m: ".")
    return out


def normalise(text: str) -> Aligned | None:
    """The undisguised text, or None if nothing in it is disguised."""
    if not disguised(text):
        return None
    out = undisguised(text)
    return out if out.text != text else None


SOME_DIGIT_DOT = re.compile(r"[0-9]\s+(?:dot|point)\s+[0-9]", re.I)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, disguised spans) in code points of the source, end exclusive.

    A disguised one that lies within a plain span, or overlaps a plain one of its kind without containing it, says
    nothing new and is left out.
    """
    base = detect(text)
    normal = normalise(text)
    if normal is None:
        return base, []
    added = []
    held = sorted((s, e, k) for k, s, e in base)
    reach = list(accumulate((e for _, e, _ in held), max))
    for kind, a, b in detect(normal.text):
        start, end = normal.source(a, b)
        if kind == "email" and "@" not in text[start:end] and no_mailbox(normal.text[a:b], text[start:end]):
            continue
        i = bisect_left(reach, start + 1)  # those before end at or before it
        near = []
        while i < len(held) and held[i][0] < end:
            near.append(held[i])
            i += 1
        if not any(s <= start and end <= e or k == kind and s < end and start < e and not (start <= s and e <= end) for s, e, k in near):
            added.append((kind, start, end))
    return base, added


def no_mailbox(address: str, written: str) -> bool:
    """Whether what was written with the word "at" is a place on the net rather than a mailbox there."""
    local, host = address.split("@", 1)
    return WORD_AT.search(written) is not None and (local.lower() in NO_MAILBOX or host.rsplit(".", 1)[-1].isdigit())


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in capitals and angle brackets."""
    out, last, label, begin = [], 0, "", 0
    runs: list[list] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if runs and s < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], e)
        else:
            runs.append([kind, s, e])
    for label, begin, end in runs:
        out += [text[last:begin], f"<{label.upper()}>"]
        last = end
    return "".join(out) + text[last:]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row's spans: id, ``base`` and ``added`` array<struct<kind,start,end>>, ``redacted`` text and ``carry`` columns.

    A narrow pass over whole texts. Null texts have no spans and stay null; empty texts, repeated rows, null ids and
    columns of any other name are passed or left alone.
    """
    common.ready(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added, texts = [], [], []
            for text in batch.column(0).to_pylist():
                b, a = find(text) if text else ([], [])
                base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in b])
                added.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in a])
                texts.append(redacted(text, b + a) if b or a else text)
            yield pa.RecordBatch.from_arrays([pa.array(base, span), pa.array(added, span), pa.array(texts, pa.string()), *batch.columns[1:]], ["_base", "_added", "_redacted", *batch.schema.names[1:]])

    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    found = rows.mapInArrow(run, f"_base {spans}, _added {spans}, _redacted string, {', '.join(kinds)}")
    return found.select(F.col("_id").alias(id_col), F.col("_base").alias("base"), F.col("_added").alias("added"), F.col("_redacted").alias("redacted"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of plain spans by kind, their digest, and all spans as text."""
    place = F.array(*[F.lit(k) for k in KINDS])

    def text(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(place, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    of = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, plain and disguised."""
    return digest(find_pii(common.table(spark, sf_dir, "documents")))


def base_digest(text: str) -> str:
    """The digest of a text's plain spans, for tests."""
    return hashlib.sha256(joined(detect(text)).encode()).hexdigest()
