"""Tokenizing whole texts inside tasks with a public vocabulary, a cached piece at a time.

A token of these vocabularies never crosses from one run of letters, digits, other signs or white space to the
next, so a text is cut at such places (before blanks, around line ends, before a comma or full stop after a letter
or digit), each distinct piece is encoded once per worker, and the ids are gathered. Where a cut might not be such a
place (white space touching white space or the text's ends, a sign before the comma) it isn't made, or the text is
encoded whole: the same ids, slower. Cutting, counting distinct pieces and gathering run on Arrow and numpy arrays.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = "\x01"
#: Texts that are encoded whole where white space is kept: white space but blanks and line ends, or touching.
_WHOLE = r"[\t\v\f\r\x01\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$|^$"
#: A comma or full stop that doesn't follow a letter or digit.
_SIGN_FIRST = r"(?:^|[^\pL\pN])[.,][ \n]"
#: Texts with doubled signs are cut between a letter or digit and a sign.
_DOUBLED = r"!!|##|\$\$|%%|&&|\*\*"
_BEFORE_SIGN = r"([\pL\pN])([^\pL\pN\s\x01])"
#: Outside these, lower-casing before composing characters might not equal composing first.
_NOT_PLAIN = r"[^\x00-\x{12f}\x{131}-\x{24f}]"
#: Bytes of text that are cut at once.
_STRETCH = 1 << 20
#: Pieces that the tokenizer is given at once: while it works it takes some hundreds of bytes for each.
_AT_ONCE = 8192
#: Pieces that a worker caches, and how many of the oldest, so mostly the commonest, it keeps when it is full.
_CACHED, _KEPT = 400_000, 300_000


class Encoder:
    """ids of texts as little-endian bytes of the numpy type ``kind`` (two bytes where the vocabulary allows)."""

    #: True where white space is part of a token.
    keeps_space: bool
    #: What can stand between two pieces in one text: it becomes one token, which no piece without it holds.
    mark: str

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The strings of special tokens in a text are ordinary text.
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.cache: dict[str, bytes] = {}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        # Of a piece of letters alone, the token that begins it (with its blank) or ends it.
        self.apart = self.tokenizer.encode_batch_fast([self.mark.strip(" ")], add_special_tokens=False)[0].ids
        self.edge = np.array([x.startswith("Ġ") if self.keeps_space else x.endswith("</w>") for x in names])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def split(self, pieces: list[str], text: str, at: Callable[[np.ndarray], tuple]) -> list[str]:
        """Caches the ids of pieces from one text of them all, cut at ``at``; returns those that it can't tell."""
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        starts, ends = at(ids)
        if len(starts) != len(pieces):
            return pieces
        size, data = ids.itemsize, ids.tobytes()
        self.cache.update(zip(pieces, (data[a:b] for a, b in zip((starts * size).tolist(), (ends * size).tolist()))))
        return []

    def learn(self, pieces: tuple[str, ...]) -> None:
        """Caches the ids of pieces: those of letters alone told apart by their edges, the others by the mark."""
        lead = " " if self.keeps_space else ""
        plain, marked, alone = [], [], []
        for x in pieces:
            body = x.removeprefix(lead)
            (plain if body.isalpha() and len(body) + len(lead) == len(x) else marked if body and self.mark.strip(" ") not in x and not any(map(str.isspace, body)) else alone).append(x)

        def by_edges(ids: np.ndarray) -> tuple:
            edges = np.flatnonzero(self.edge[ids])
            return (edges, np.append(edges[1:], len(ids))) if self.keeps_space else (np.append(0, edges[:-1] + 1), edges + 1)

        def by_marks(ids: np.ndarray) -> tuple:
            marks = np.flatnonzero(ids == self.apart[0])
            return np.append(0, marks + 1), np.append(marks, len(ids))
        if plain:
            alone += self.split(plain, ("" if lead else " ").join(plain), by_edges)
        if marked:
            alone += self.split(marked, self.mark.join(marked), by_marks) if len(self.apart) == 1 else marked
        for x in alone:
            self.cache[x] = self.whole(x)

    def whole_ones(self, texts: pa.Array) -> np.ndarray:
        """Which texts can't be cut."""
        raise NotImplementedError

    def cuts(self, texts: pa.Array) -> pa.Array:
        """The pieces of each text, as lists."""
        raise NotImplementedError

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """ids of each text; nulls are taken as empty."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        out: list[np.ndarray] = []
        while len(out) < len(texts):
            at = len(out)
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _STRETCH, "right")))
            out += self.stretch(texts.slice(at, stop - at))
        return out

    def stretch(self, texts: pa.Array) -> list[np.ndarray]:
        whole = self.whole_ones(texts)
        found = iter(self.gathered(self.cuts(texts.filter(pa.array(~whole)))) if not whole.all() else [])
        return [np.frombuffer(self.whole(texts[i].as_py()), self.kind) if w else next(found) for i, w in enumerate(whole.tolist())]

    def gathered(self, lists: pa.Array) -> list[np.ndarray]:
        pieces = lists.flatten().dictionary_encode()
        words, at = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        unknown = set(itertools.filterfalse(self.cache.__contains__, words))
        if len(self.cache) + len(unknown) > _CACHED:
            self.cache = dict(itertools.islice(self.cache.items(), _KEPT))
            unknown = set(itertools.filterfalse(self.cache.__contains__, words))
        for some in itertools.batched(unknown, _AT_ONCE):
            self.learn(some)
        each = [self.cache[w] for w in words]
        flat = np.frombuffer(b"".join(each), self.kind)
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // flat.itemsize
        first = np.cumsum(sizes) - sizes
        n = sizes[at]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.concatenate([[0], ends])[lists.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in zip(stops, stops[1:])]


def _matches(texts: pa.Array, pattern: str) -> pa.Array:
    return pc.match_substring_regex(texts, pattern)


class DroppedSpace(Encoder):
    """For vocabularies that drop white space and case and end words with a mark."""

    keeps_space = False
    mark = " ~ "

    def whole_ones(self, texts: pa.Array) -> np.ndarray:
        return np.zeros(len(texts), bool)

    def cuts(self, texts: pa.Array) -> pa.Array:
        plain = pc.invert(_matches(texts, _NOT_PLAIN))
        texts = pc.replace_substring(pc.if_else(plain, pc.utf8_lower(texts), texts), "\n", " ")
        signs = pc.and_(plain, _matches(texts, _DOUBLED))
        tight = pc.invert(pc.or_(signs, _matches(texts, _SIGN_FIRST)))
        apart = pc.replace_substring(pc.replace_substring(texts, ", ", " , "), ". ", " . ")
        texts = pc.if_else(tight, apart, texts)
        if pc.any(signs).as_py():
            texts = pc.if_else(signs, pc.replace_substring_regex(texts, _BEFORE_SIGN, r"\1 \2"), texts)
        return pc.split_pattern(texts, " ")


class KeptSpace(Encoder):
    """For byte-level vocabularies, whose tokens take the blank before a word."""

    keeps_space = True
    mark = "\n"

    def whole_ones(self, texts: pa.Array) -> np.ndarray:
        return _matches(texts, _WHOLE).to_numpy(zero_copy_only=False)

    def cuts(self, texts: pa.Array) -> pa.Array:
        signs = _matches(texts, _DOUBLED)
        tight = pc.invert(pc.or_(signs, _matches(texts, _SIGN_FIRST)))
        if pc.any(signs).as_py():
            texts = pc.if_else(signs, pc.replace_substring_regex(texts, _BEFORE_SIGN, "\\1\x01\\2"), texts)
        texts = pc.replace_substring(pc.replace_substring(texts, " ", "\x01 "), "\n", "\x01\n\x01")
        apart = texts
        for old, new in ((",\x01 ", "\x01,\x01 "), (".\x01 ", "\x01.\x01 "), (".\x01\n", "\x01.\x01\n")):
            apart = pc.replace_substring(apart, old, new)
        return pc.split_pattern(pc.if_else(tight, apart, texts), _CUT)


@functools.cache
def dropped_space(path: str) -> DroppedSpace:
    """One a worker process, so tasks share what it has cached."""
    return DroppedSpace(path)


@functools.cache
def kept_space(path: str) -> KeptSpace:
    return KeptSpace(path)


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
