"""Byte-level BPE over whole texts, one encoding for each distinct piece of text.

A place where a space follows a character that is no white space always starts a new pre-token, so pieces cut
there encode on their own exactly as inside the text. Texts are split at these places and the pieces' results
are kept in a memo of bounded size.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

_SAFE_SPACE = re.compile(r"(?<=\S) ")
_SAFE_INSIDE = re.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
KEEP_CHARS = 48
LONG_PIECE = 1 << 16


def split_safely(text: str) -> list[str]:
    """Pieces of a text; a space stands between one piece and the next."""
    return _SAFE_SPACE.split(text)


def cut_long(piece: str, limit: int = LONG_PIECE) -> list[str]:
    """Cut a piece without spaces at other safe boundaries: before white space, between letter and digit.

    A run that offers no boundary stays whole, as its encoding cannot be derived from parts.
    """
    if len(piece) <= limit:
        return [piece]
    out, start, last = [], 0, 0
    for m in _SAFE_INSIDE.finditer(piece):
        if m.start() - start > limit and last > start:
            out.append(piece[start:last])
            start = last
        last = m.start()
    if last > start and len(piece) - start > limit:
        out.append(piece[start:last])
        start = last
    out.append(piece[start:])
    return out


class PieceMemo:
    """Results by piece, in two generations: the older one goes when the younger one is full."""

    def __init__(self, compute: Callable[[list[str]], list], join: Callable[[list], object], limit: int) -> None:
        self.compute, self.join, self.limit = compute, join, limit
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def direct(self, piece: str):
        return self.join(self.compute(cut_long(piece)))

    def results(self, texts: list[str]) -> list:
        """The joined results of each text."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        parts = [t.split(" ") for t in texts]
        young, old, new = self.young, self.old, set()
        for p in parts:
            new.update(p[1:])
        new.difference_update(young)
        unsafe, fresh = set(), []
        for w in new:
            if not w or w[-1].isspace() or len(w) > KEEP_CHARS:
                unsafe.add(w)
            elif w in old:
                young[w] = old[w]
            else:
                fresh.append(w)
        young.update(zip(fresh, self.compute([" " + w for w in fresh])))
        out = []
        for text, p in zip(texts, parts):
            rest = p[1:]
            if p[0] and not p[0][-1].isspace() and (not unsafe or unsafe.isdisjoint(rest)):
                found = [self.direct(p[0])]
                found.extend(map(young.__getitem__, rest))
            else:
                pieces = split_safely(text)
                found = [self.direct(pieces[0])]
                for w in pieces[1:]:
                    got = young.get(w)
                    found.append(self.direct(" " + w) if got is None else got)
            out.append(self.join(found))
        return out


_LOADED: dict[tuple[str, str], PieceMemo] = {}


def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def counter(path: str, limit: int = 200_000) -> PieceMemo:
    """Token counts by the ``tokenizers`` library, one memo per worker."""
    key = ("counts", path)
    if key not in _LOADED:
        tokenizer = _tokenizer(path)

        def compute(pieces: list[str]) -> list[int]:
            return [len(e) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

        _LOADED[key] = PieceMemo(compute, sum, limit)
    return _LOADED[key]


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE vocabularies: visible Latin-1 stands for itself, the rest follow."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in visible}
    table.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))})
    return table


def id_encoder(path: str, limit: int = 150_000) -> PieceMemo:
    """Token ids as little-endian unsigned 32-bit bytes, one memo per worker.

    Pieces of Latin letters go through the tiktoken encoder with the ranks of the same vocabulary file, which is
    several times faster and gives the same ids; all other pieces go through the ``tokenizers`` library.
    """
    key = ("ids", path)
    if key not in _LOADED:
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        tokenizer = _tokenizer(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        fast = tiktoken.Encoding("same-vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        names = tuple(special)

        def one(piece: str) -> list[int]:
            if (piece.isascii() or max(piece) < "ɐ") and not any(s in piece for s in names):
                return fast.encode_ordinary(piece)
            return tokenizer.encode(piece, add_special_tokens=False).ids

        def compute(pieces: list[str]) -> list[bytes]:
            return [array("I", one(p)).tobytes() for p in pieces]

        _LOADED[key] = PieceMemo(compute, b"".join, limit)
    return _LOADED[key]
