"""Text functions as Spark columns: tokens, phrases, identifiers, snippets, globs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic.
STOPWORDS = """
a about above after again against all also am an and any are aren as at back be because been before being below
between both but by can come could couldn day did didn do does doesn doing don down during each either end even every
few first for from further get give go going good got had hadn has hasn have haven having he her here hers herself him
himself his how however i if in into is isn it its itself just know last left let like look made make making many may me
might more most mustn my myself need needs new no nor not now of off on once one only or other others our ours ourselves
out over own part people put rather really right said same say see seen set shall shan she should shouldn show since so
some still such take taken than that the their theirs them themselves then there these they thing things this those
though through thus time to too two under until up upon us use used uses using very via want wants was wasn way ways we
well were weren what when where whether which while who whom whose why will with within without won would wouldn yes yet
you your yours yourself yourselves
""".split()


@lru_cache(maxsize=1)
def accents() -> tuple[str, str]:
    """Latin letters with a mark, and the plain letters in the same order; by canonical decomposition."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    marked, plain = accents()
    return F.translate(F.lower(text), marked, plain)


def tokens(text: Column) -> Column:
    """The runs of letters and digits, folded: what full-text search compares."""
    return F.array_remove(F.split(folded(text), r"[^\p{L}\p{N}]+"), "")


def query_phrases(text: Column) -> Column:
    """The phrases a query asks for, as arrays of tokens: each word without signs but - and _, which join two tokens."""
    words = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_-]", ""))
    return F.filter(F.transform(F.filter(words, lambda w: w != ""), tokens), lambda p: F.size(p) > 0)


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z alone, as LIKE compares."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def identifier_words(name: Column) -> Column:
    """The words of an identifier in lower case: parted at signs, case changes, between letters and digits."""
    parted = F.regexp_replace(name, r"[_\-:./\s]+", " ")
    parted = F.regexp_replace(parted, r"(\p{Ll})(\p{Lu})", "$1 $2")
    parted = F.regexp_replace(parted, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    parted = F.regexp_replace(parted, r"(\p{L})(\p{N})", "$1 $2")
    parted = F.regexp_replace(parted, r"(\p{N})(\p{L})", "$1 $2")
    return F.array_remove(F.split(F.lower(F.trim(parted)), r"\s+"), "")


def aliases(symbol: Column, heading: Column) -> Column:
    """The names under which a symbol can be found, without repeats, in order."""
    nothing = F.array().cast("array<string>")
    dotted = F.regexp_replace(heading, "::|/", ".")
    under = F.when(F.coalesce(heading, F.lit("")) != "", F.array(F.concat(heading, F.lit("::"), symbol), F.concat(heading, F.lit("."), symbol), F.concat(dotted, F.lit("."), symbol))).otherwise(nothing)
    spelled = lambda words: F.when(F.size(words) > 1, F.array(F.array_join(words, " "), F.array_join(words, "_"), F.array_join(words, "-"))).otherwise(nothing)
    parted = F.transform(F.array(identifier_words(symbol)), spelled)[0]  # a name is parted once
    return F.when(F.coalesce(symbol, F.lit("")) == "", nothing).otherwise(F.array_distinct(F.concat(F.array(symbol), parted, under)))


def is_real_identifier(name: Column) -> Column:
    """A name long and mixed enough to mean one thing: 8 bytes or more, with _ or a change from lower to upper case."""
    return (F.octet_length(name) >= 8) & (F.contains(name, F.lit("_")) | name.rlike("[a-z][A-Z]"))


def without_frontmatter(text: Column) -> Column:
    """The text after a leading block between two lines of ---; unchanged if there is none."""
    return F.regexp_replace(text, r"(?s)^﻿?---[ \t]*\r?\n(?:.*?\r?\n)??---[ \t]*(?:\r?\n|$)", "")


def snippet(text: Column, most: int = 140) -> Column:
    """The first line that isn't blank, trimmed; longer than ``most`` characters it ends in an ellipsis."""
    line = F.trim(F.regexp_extract(without_frontmatter(text), r"(?m)^[ \t]*(\S[^\r\n]*)", 1))
    return F.when(F.char_length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def line_of(content: Column, byte: Column) -> Column:
    """The line, from 1, on which a byte of a UTF-8 text stands."""
    head = F.substring(content.cast("binary"), F.lit(1), byte.cast("int")).cast("string")
    return F.octet_length(head) - F.octet_length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression over whole paths: * and ? stay within a name, ** crosses names, {a,b} and [..] too."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return f"^{out}$"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def stem(path: Column) -> Column:
    """A path's last name without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def embedded_text(path: Column, heading: Column, content: Column, names: Column) -> Column:
    """What an embedder sees of a chunk: where it stands, its heading, its content and its aliases."""
    head = F.concat_ws("\n", without_extension(path), F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit("["), heading, F.lit("]"))))
    return F.concat(head, F.lit("\n\n"), content, F.when(F.size(names) > 0, F.concat(F.lit("\n\naliases:\n"), F.array_join(names, "\n"))).otherwise(""))


def indexed_text(heading: Column, names: Column, content: Column) -> Column:
    """What full-text search sees of a chunk."""
    heading = F.when(heading != "", heading)
    return F.concat_ws("\n", heading, F.when(F.size(names) > 0, F.array_join(names, "\n")), content)


def cut_bytes(text: Column, most: int) -> Column:
    """The text up to ``most`` bytes, never within a character."""
    head = F.substring(text.cast("binary"), 1, most)
    whole = F.decode(F.substring(head, F.lit(1), F.octet_length(head) - _torn(head)), "UTF-8")
    return F.when(F.octet_length(text) <= most, text).otherwise(whole)


def _torn(head: Column) -> Column:
    """How many bytes at the end begin a character that isn't whole."""
    hexed = F.hex(head)
    tail = F.regexp_extract(hexed, r"(?:^|.*?)((?:F[0-7](?:[89AB][0-9A-F]){0,2}|E[0-9A-F](?:[89AB][0-9A-F]){0,1}|[CD][0-9A-F]))$", 1)
    return F.when(F.length(hexed) % 2 == 0, F.floor(F.length(tail) / 2)).otherwise(0).cast("int")
