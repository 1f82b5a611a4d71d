"""Byte-pair tokenizers: the library's own ids, and a counter that merges with a heap and a linked list."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

#: Texts of these characters alone are split alike by every engine, whatever its Unicode version.
UNUSUAL = re.compile("[^\\t\\n\\r -~¡-ɏ‐-‧€]")
#: Where the text can't be split at single spaces and line ends.
KNOTTED = re.compile(r"\s\s|[\t\r]")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizers library's tokenizer for a .json file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = dict.fromkeys(plain)
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=4)
def fast_encoder(json_path: str):
    """An encoder with the same vocabulary and merge order that returns numpy ids, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(json_path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = {c: b for b, c in enumerate(byte_letters())}
    ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items()}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def specials(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(x["content"] for x in json.load(f).get("added_tokens", []))


def encode(text: str, path: str):
    """The library's ids for a text, as a uint32 array.

    Ordinary texts take the faster encoder, whose ids are the same (tested); those with unusual characters or
    special strings take the library itself.
    """
    import numpy as np

    if UNUSUAL.search(text) or any(s in text for s in specials(path)):
        return np.array(library(path).encode(text, add_special_tokens=False).ids, dtype="<u4")
    return fast_encoder(path).encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


class HeapCounter:
    """Counts a text's tokens by merging pairs, lowest rank first, without ever making identifiers.

    A piece's symbols form a linked list; a heap holds the adjacent pairs that can merge, by rank and place. The count
    is the number of initial symbols less the number of merges. Counts of pieces between spaces are kept up to
    ``keep`` entries, after which the store starts anew, so memory is bounded.
    """

    def __init__(self, path: str, keep: int = 700_000):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = spec["model"]["merges"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges)
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.letters = byte_letters()
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.split_library = library(path).pre_tokenizer.pre_tokenize_str
        added = [x["content"] for x in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.counts = _Counts(self, keep)

    def merge(self, symbols: list[str]) -> int:
        """Tokens left of a piece's initial symbols."""
        n = len(symbols)
        if n < 2:
            return n
        ranks, symbols = self.ranks.get, list(symbols)
        heap = [(r, i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks(pair)) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, merges = [*range(1, n), -1], [*range(-1, n - 1)], 0
        while heap:
            rank, i = heapq.heappop(heap)
            if (left := symbols[i]) is None or (j := after[i]) < 0 or ranks((left, symbols[j])) != rank:
                continue  # one of the pair has merged with another since
            symbols[i], symbols[j] = left + symbols[j], None
            merges += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges

    def pieces(self, text: str) -> int:
        """Tokens of a short run of text of usual characters."""
        return sum(map(self.counts.piece, self.find(text)))

    def segment(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        if UNUSUAL.search(text):
            return sum(self.merge(list(piece)) for piece, _ in self.split_library(text))
        if KNOTTED.search(text):
            return sum(map(self.counts.piece, self.find(text)))
        first, *rest = text.replace("\n", " \n\n").split(" ")
        return (self.pieces(first) if first else 0) + sum(map(self.counts.__getitem__, rest))

    def __call__(self, text: str) -> int:
        if self.special is None or not (found := self.special.findall(text)):
            return self.segment(text)
        return len(found) + sum(map(self.segment, self.special.split(text)))


class _Counts(dict):
    """Token counts by what stands between spaces; after a line end the key begins with two of them, for no space."""

    def __init__(self, counter: HeapCounter, keep: int):
        self.counter, self.keep = counter, keep
        self.whole: dict[str, int] = {}

    def __missing__(self, key: str) -> int:
        if len(self) >= self.keep:
            self.clear()
        n = self.counter.pieces(key[1:] if key[:2] == "\n\n" else " " + key)
        self[key] = n
        return n

    def piece(self, piece: str) -> int:
        if (n := self.whole.get(piece)) is None:
            if len(self.whole) >= self.keep:
                self.whole.clear()
            letters = self.counter.letters
            n = self.whole[piece] = self.counter.merge([letters[b] for b in piece.encode()])
        return n
