"""Exact BPE over whole texts by pieces that no token can cross.

A hard boundary stands before an ASCII white-space byte that follows a byte that is
surely not white space, and before an ASCII mark but | that follows an ASCII letter
or digit.  Neither pre-tokenizer pattern can match across it or look back over it, no
special token's text holds one, and no composed character spans one, so a text's ids
are the ids of its pieces end to end.  Distinct pieces are encoded once per worker and
looked up from then on; a word is the same piece with a mark after it or without.
Where the vocabulary lower-cases, ASCII letters are folded before that, save those that
a combining mark may follow and those of special tokens' texts in any case, and white
space becomes a blank.  New pieces that a blank leads and that hold nothing a normaliser
would change (printable ASCII and letters of Latin-1, lower-cased where the vocabulary
lower-cases) are encoded end to end without it, and told apart by the bytes their tokens
spell; other new pieces by the library's offsets.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import LOWER, SPACE, gather_runs

#: Bytes that may end a Unicode white-space character, or a control some patterns take for white space: no hard boundary after these.
DOUBTFUL = np.zeros(256, dtype=bool)
DOUBTFUL[list(range(0x1C, 0x20))] = True
DOUBTFUL[SPACE] = True
STOP = np.zeros(256, dtype=bool)
STOP_TEXT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~"
STOP[[ord(c) for c in STOP_TEXT]] = True
FOLD = np.where(SPACE, np.uint8(0x20), LOWER)
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True
PRINTABLE = np.zeros(256, dtype=bool)
PRINTABLE[0x20:0x7F] = True

_encoders: dict[tuple[str, int], PieceEncoder] = {}


def hard_boundaries(data: np.ndarray) -> np.ndarray:
    """For each byte, whether a hard boundary stands before it."""
    cut = np.zeros(len(data), dtype=bool)
    np.logical_and(SPACE[data[1:]], ~DOUBTFUL[data[:-1]], out=cut[1:])
    at = np.flatnonzero(cut)
    at = at[data[at - 1] >= 0x80]
    doubt = (data[np.maximum(at - 2, 0)] == 0xC2) | ((data[np.maximum(at - 3, 0)] >= 0xE1) & (data[np.maximum(at - 3, 0)] <= 0xE3))
    cut[at[doubt]] = False
    cut[1:] |= STOP[data[1:]] & ALNUM[data[:-1]]
    return cut


def folded(data: np.ndarray, whole: list[bytes]) -> np.ndarray:
    """White space as blanks; letters in lower case, but before a byte over 0x7F, at the end, and where that would make one of the texts `whole`."""
    stays = np.append(data[1:] >= 0x80, True) & ~SPACE[data]
    out = np.where(stays, data, FOLD[data])
    raw = FOLD[data].tobytes()
    for x in whole:
        at = raw.find(x)
        while at >= 0:
            out[at : at + len(x)] = data[at : at + len(x)]
            at = raw.find(x, at + 1)
    return out


def pieces_of(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(index of each piece, distinct pieces) of the byte ranges between sorted cuts, first and last included."""
    coded = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


SPACE_TEXT = "\x20\x09\x0a\x0b\x0c\x0d"


def parted(left: str, right: str) -> bool:
    """Whether a hard boundary surely stands between two pieces put end to end."""
    if right[0] in SPACE_TEXT:
        return left[-1].isalnum() or "!" <= left[-1] <= "~"
    return right[0] in STOP_TEXT and left[-1].isascii() and left[-1].isalnum()


class PieceEncoder:
    """ids of pieces, each distinct one encoded once while it stays in a bounded store."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most = most
        told = json.loads(self.tokenizer.to_str())
        held = told["normalizer"] or {}
        self.folds = [x["type"] for x in held.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.bare = Tokenizer.from_str(json.dumps(told | {"normalizer": None})) if self.folds else None if held else self.tokenizer
        self.specials = [FOLD[np.frombuffer(x.content.encode(), np.uint8)].tobytes() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        suffix = told["model"].get("end_of_word_suffix") or ""
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.vocab)]
        self.size = np.fromiter((len(t.removesuffix(suffix)) for t in tokens), np.int64, self.vocab)  # a character a byte
        self.blanks = self.bare is not None and self.size[self.bare.encode(" a", add_special_tokens=False).ids].sum() == 2  # tokens spell them
        self.as_is = PRINTABLE.copy()
        self.as_is[65:91] = not self.folds
        self.clear()

    def clear(self) -> None:
        self.where: dict[bytes, int] = {}
        self.store = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def lookup(self, values: list[bytes]) -> np.ndarray:
        """Store entry of each of the distinct pieces, encoding those not yet held."""
        if len(self.where) + len(values) > self.most and self.where:
            self.clear()
        where = self.where
        entry = np.fromiter(map(where.get, values, itertools.repeat(-1)), np.int64, len(values))
        fresh = np.flatnonzero(entry < 0)
        if len(fresh):
            new = [values[i] for i in fresh.tolist()]
            flat, sizes = self.encode_new(new)
            first, n = len(where), len(new)
            while self.used + len(flat) > len(self.store):
                self.store = np.concatenate((self.store, np.zeros_like(self.store)))
            while first + n > len(self.start):
                self.start, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length))
            self.store[self.used : self.used + len(flat)] = flat
            self.start[first : first + n] = self.used + np.cumsum(sizes) - sizes
            self.length[first : first + n] = sizes
            self.used += len(flat)
            where.update(zip(new, range(first, first + n), strict=True))
            entry[fresh] = np.arange(first, first + n)
        return entry

    def encode_new(self, pieces: list[bytes], together: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many each piece has)."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        edges = np.concatenate(([0], np.cumsum(size)))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        plain = self.plain(data, edges)
        first, sizes = self.encode_plain(data[np.repeat(plain, size)], size[plain], together)
        if sizes is None:
            first, plain = first[:0], np.zeros(len(pieces), bool)
        if plain.all():
            return first, sizes
        rest, others = self.encode_told_apart([pieces[i] for i in np.flatnonzero(~plain).tolist()], together)
        count, start = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        for own, n, base in ((plain, sizes, 0), (~plain, others, len(first))):
            if own.any():
                count[own], start[own] = n, base + np.cumsum(n) - n
        return gather_runs(np.concatenate((first, rest)), start, count), count

    def plain(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Which pieces a blank leads and no normaliser changes, and that end in what surely isn't white space."""
        if self.bare is None:
            return np.zeros(len(edges) - 1, bool)
        good = self.as_is[data]
        latin = (data[:-1] == 0xC3) & (data[1:] >= (0x9F if self.folds else 0x80)) & (data[1:] < 0xC0)
        good[:-1] |= latin
        good[1:] |= latin
        odd = np.concatenate(([0], np.cumsum(~good)))
        return (odd[edges[1:]] == odd[edges[:-1]]) & (data[edges[:-1]] == 0x20) & (data[edges[1:] - 1] != 0x20)

    def encode_plain(self, data: np.ndarray, size: np.ndarray, together: int) -> tuple[np.ndarray, np.ndarray | None]:
        """encode_new() of plain() pieces; None if their bytes aren't those that the tokens spell."""
        edges = np.concatenate(([0], np.cumsum(size)))
        cuts = np.append(edges[:-1:together], edges[-1]).tolist()
        raw = memoryview(data)
        found = [x.ids for x in self.bare.encode_batch_fast([str(raw[a:b], "utf-8") for a, b in zip(cuts, cuts[1:], strict=False)], add_special_tokens=False)] if len(size) else []
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, sum(map(len, found)))
        want = edges if self.blanks else np.concatenate(([0], np.cumsum(data != 0x20)))[edges]
        spelt = np.concatenate(([0], np.cumsum(self.size[ids])))
        at = np.searchsorted(spelt, want)
        right = spelt[-1] == want[-1] and (spelt[at] == want).all()
        return ids, np.diff(at) if right else None

    def encode_told_apart(self, pieces: list[bytes], together: int) -> tuple[np.ndarray, np.ndarray]:
        """encode_new() of any pieces; those with hard boundaries between them are encoded many at a time."""
        groups: list[list[str]] = [[]]
        whole = [x.decode("utf-8", "replace") for x in pieces]
        for x in whole:
            if len(groups[-1]) >= together or (groups[-1] and not parted(groups[-1][-1], x)):
                groups.append([])
            groups[-1].append(x)
        flat, sizes = [], []
        for group, out in zip(groups, self.tokenizer.encode_batch(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = out.ids
            flat.append(np.fromiter(ids, np.uint32, len(ids)))
            if len(group) == 1:
                sizes.append(np.array([len(ids)]))
                continue
            begin = np.fromiter((a for a, _ in out.offsets), np.int64, len(ids))
            edges = np.cumsum([0, *map(len, group)])
            edges[-1] += 1
            sizes.append(np.diff(np.searchsorted(begin, edges)))
        return np.concatenate(flat), np.concatenate(sizes)

    def encode(self, data: np.ndarray, bounds: np.ndarray, boundaries: Callable = hard_boundaries) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, first id of each text with the end appended); bounds: the texts' byte offsets."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        if self.folds:
            data = folded(data, self.specials)
        cut = boundaries(data)
        cut[bounds[bounds < len(data)]] = True
        cuts = np.append(np.flatnonzero(cut), len(data))
        index, values = pieces_of(data, cuts)
        entry = self.lookup(values.to_pylist())
        size = self.length[entry]
        own = gather_runs(self.store, self.start[entry], size)  # what the distinct pieces have: few, so near at hand
        length = size[index]
        ids = gather_runs(own, (np.cumsum(size) - size)[index], length)
        at = np.concatenate(([0], np.cumsum(length)))
        return ids, at[np.searchsorted(cuts, bounds)]


def encoder(path: str, most: int = 1_000_000) -> PieceEncoder:
    """The worker's encoder of a vocabulary file."""
    key = (path, most)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, most)
    return _encoders[key]
