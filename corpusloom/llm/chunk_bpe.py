"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over bytes ends a chunk wherever its low bits are 0, so equal passages
fall into equal chunks whatever stands before them.  A chunk's core, from its first to
its last hard boundary (see bpe), is encoded once for all documents of a task that
share the chunk, from the ids of its pieces, each of which the library has encoded
once.  Where two cores join, what lies between them is encoded
anew by the library, together with the last stretch of the left core and the first of the right one.
The ids of both stretches must be those that the cores have there; a core that doesn't
agree is given up and the join grows over it, until all joins agree.  The ids are
exactly those of the whole text.  Vocabularies with another pre-tokenizer than the
byte-level one are refused.

Null text counts as empty, which has no ids.  Ids of rows aren't used, so null and
equal ones are no special case.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import gather_runs, offsets_of, slices, texts

CHUNK_BITS, LEAST, SPAN = 9, 64, 32
#: Bytes of chunks a worker keeps.
KEPT_BYTES = 48 << 20

_stores: dict[str, ChunkStore] = {}
_spellings: dict[str, tuple] = {}


def gear() -> np.ndarray:
    """A random 32-bit number for each byte."""
    return np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)


GEAR = gear()


def chunk_cuts(data: np.ndarray, bounds: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Chunk ends: hash of the SPAN bytes before them ends in `bits` zeros, with no such place in the LEAST bytes before; and the texts' bounds."""
    rolling, reach = GEAR[data], 1
    while reach < SPAN:
        rolling[reach:] += rolling[:-reach] << np.uint32(reach) if reach < len(rolling) else 0
        reach *= 2
    at = np.flatnonzero((rolling >> np.uint32(32 - bits)) == 0) + 1
    text = np.searchsorted(bounds, at, side="right")
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) >= LEAST) | (text[1:] != text[:-1])
    inside = at - bounds[np.maximum(text - 1, 0)] >= max(LEAST, SPAN)
    cut = np.zeros(len(data) + 1, bool)
    cut[at[fresh & inside]] = True
    cut[bounds] = True
    return np.flatnonzero(cut)


class ChunkStore:
    """ids of the cores of chunks, and the library's tokenizer behind them.

    reused, encoded: cores looked up and cores encoded; repaired: cores given up because
    a join's ids didn't agree with theirs.
    """

    def __init__(self, path: str, most: int = KEPT_BYTES):
        self.pieces = bpe.encoder(path)
        self.tokenizer = self.pieces.tokenizer
        told = json.loads(self.tokenizer.to_str())
        split = told["pre_tokenizer"] or {}
        if told["normalizer"] or (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) != ("ByteLevel", False, True):
            raise ValueError(f"{path}: chunks are joined for byte-level vocabularies with their own pattern and no normaliser")
        self.size, self.most = spelling(path)[2], most
        self.reused = self.encoded = self.repaired = 0
        self.clear()

    def clear(self) -> None:
        self.where: dict[bytes, int] = {}
        self.bytes = 0
        self.cores: list[tuple[np.ndarray, int, int]] = []  # ids, how many before the second boundary, how many from the last but one on

    def library(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, first of each) of stretches of bytes, each encoded as a text of its own."""
        raw = memoryview(np.ascontiguousarray(data))
        some = [str(raw[a:b], "utf-8", "replace") for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(at[-1])), at

    def tokens_in(self, ids: np.ndarray, start: np.ndarray, span: np.ndarray) -> np.ndarray:
        """How many ids from `start` on spell exactly `span` bytes; -1 if no token ends there."""
        spelt = np.concatenate(([0], np.cumsum(self.size[ids])))
        want = spelt[start] + span
        at = np.minimum(np.searchsorted(spelt, want), len(spelt) - 1)
        return np.where(spelt[at] == want, at - start, -1)

    def learn(self, names: list[bytes], data: np.ndarray, edges: np.ndarray) -> None:
        """Encodes cores; edges: first, second, last but one and last boundary of each."""
        first, second, before, last = edges
        size = last - first
        ids, at = self.pieces.encode(gather_runs(data, first, size), np.concatenate(([0], np.cumsum(size))))
        head = self.tokens_in(ids, at[:-1], second - first)
        body = self.tokens_in(ids, at[:-1], before - first)
        for k, x in enumerate(names):
            own = ids[at[k] : at[k + 1]].copy()
            self.where[x] = len(self.cores)
            self.cores.append((own, int(head[k]), len(own) - int(body[k]) if body[k] >= 0 else -1))
            self.bytes += len(x) + 4 * len(own) + 250
        self.encoded += len(names)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, first id of each text with the end appended)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        if self.bytes > self.most:
            self.clear()
        cuts = chunk_cuts(data, bounds)
        index, values = bpe.pieces_of(data, cuts)
        hard = np.flatnonzero(bpe.hard_boundaries(data))
        low, high = np.searchsorted(hard, cuts[:-1] + 3), np.searchsorted(hard, cuts[1:])
        cored = np.flatnonzero(high - low >= 4)  # other chunks are part of what is encoded anew
        edges = np.stack((hard[low[cored]], hard[low[cored] + 1], hard[high[cored] - 2], hard[high[cored] - 1])) if len(cored) else np.zeros((4, 0), np.int64)
        one = np.full(len(values), -1)
        one[index[cored]] = np.arange(len(cored))  # a chunk of each kind
        kinds = np.flatnonzero(one >= 0)
        names = values.take(pa.array(kinds)).to_pylist()
        fresh = [k for k, x in enumerate(names) if x not in self.where]
        self.reused += len(cored) - len(fresh)
        if fresh:
            self.learn([names[k] for k in fresh], data, edges[:, one[kinds[fresh]]])
        held = [self.cores[self.where[x]] for x in names]
        size = np.fromiter((len(x[0]) for x in held), np.int64, len(held))
        store, start = np.concatenate([x[0] for x in held]) if held else np.zeros(0, np.uint32), np.cumsum(size) - size
        of_kind = np.zeros(len(values), np.int64)
        of_kind[kinds] = np.arange(len(kinds))
        kind = of_kind[index[cored]]
        head, tail = (np.fromiter((x[i] for x in held), np.int64, len(held))[kind] for i in (1, 2))
        active = np.flatnonzero((head >= 0) & (tail >= 0))
        while True:
            # what lies between cores, and a stretch of the core on either side, is encoded anew
            first, second, before, last = edges[:, active]
            ends = np.unique(bounds)
            place = np.sort(np.concatenate((ends[:-1], last)))  # where each join begins
            after = np.searchsorted(first, place)  # the core that follows it
            until = ends[np.searchsorted(ends, place, side="right")]
            own = np.searchsorted(last, place)
            left, right = own < len(active), after < len(active)
            left[left], right[right] = last[own[left]] == place[left], first[after[right]] < until[right]
            begin, end = place.copy(), until.copy()
            begin[left], end[right] = before[own[left]], second[after[right]]
            ids, at = self.library(data, begin, end)
            skip, more = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            skip[left] = self.tokens_in(ids, at[:-1][left], (last - before)[own[left]])
            inner = self.tokens_in(ids, at[:-1][right], first[after[right]] - begin[right])
            more[right] = np.where(inner >= 0, np.diff(at)[right] - inner, -1)
            bad = np.zeros(len(active), bool)
            core = kind[active]
            for joins, cores, n, from_join, from_core in (
                (left, own, tail, at[:-1], start[core] + size[core] - tail[active]),
                (right, after, head, at[1:] - more, start[core]),
            ):
                c = cores[joins]
                told = (skip if joins is left else more)[joins]
                same = told == n[active][c]
                count = np.where(same, told, 0)
                unlike = gather_runs(ids, from_join[joins], count) != gather_runs(store, from_core[c], count)
                same[np.repeat(np.arange(len(c)), count)[unlike]] = False
                bad[c[~same]] = True
            if not bad.any():
                break
            self.repaired += int(bad.sum())
            active = active[~bad]  # their joins grow over them
        run_at = np.concatenate((start[core], at[:-1] + skip))
        run_size = np.concatenate((size[core], np.diff(at) - skip - more))
        spot = np.concatenate((first, place))
        order = np.argsort(spot, kind="stable")
        run_at[: len(core)] += len(ids)
        run_at, run_size, spot = run_at[order], run_size[order], spot[order]
        out = gather_runs(np.concatenate((ids, store)), run_at, run_size)
        return out, np.concatenate(([0], np.cumsum(run_size)))[np.searchsorted(spot, bounds)]


def chunk_store(path: str) -> ChunkStore:
    if path not in _stores:
        _stores[path] = ChunkStore(path)
    return _stores[path]


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def spelling(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, size) of every id's text, and of its decimal number with a comma."""
    if path not in _spellings:
        coder, chars = bpe.encoder(path), byte_of_char()
        out = []
        tokens = [coder.tokenizer.id_to_token(i) or "" for i in range(coder.vocab)]
        for spelt in ([bytes(map(chars.__getitem__, t)) if all(c in chars for c in t) else t.encode() for t in tokens], [b"%d," % i for i in range(coder.vocab)]):
            size = np.fromiter(map(len, spelt), np.int64, len(spelt))
            out += [np.frombuffer(b"".join(spelt), np.uint8), np.cumsum(size) - size, size]
        _spellings[path] = tuple(out)
    return _spellings[path]


def decode_ids(path: str, ids: np.ndarray) -> bytes:
    """The text of ids in UTF-8, what isn't UTF-8 replaced as the tokenizers library does."""
    store, start, size, *_ = spelling(path)
    raw = gather_runs(store, start[ids], size[ids]).tobytes()
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()
    return raw


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = chunk_store(vocabulary)
        for batch in slices(batches):
            bounds, data = offsets_of(batch.column(1))
            ids, at = store.encode(data, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from encode()'s rows; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode_ids(vocabulary, np.array(x, np.int64)).decode() for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    ids = F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), ids.alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens and the digests of the ids and of the text decoded from them, by encode()'s and decode()'s kernels in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = chunk_store(vocabulary)
        letters, letter_at, letter_n, digits, digit_at, digit_n = spelling(vocabulary)
        for batch in slices(batches):
            bounds, data = offsets_of(batch.column(1))
            ids, at = store.encode(data, bounds)
            spelt, numbers = memoryview(gather_runs(letters, letter_at[ids], letter_n[ids])), memoryview(gather_runs(digits, digit_at[ids], digit_n[ids]))
            spelt_at, number_at = (np.concatenate(([0], np.cumsum(x[ids])))[at].tolist() for x in (letter_n, digit_n))
            by_ids, by_text = [], []
            for i in range(batch.num_rows):
                by_ids.append(hashlib.sha256(numbers[number_at[i] : max(number_at[i], number_at[i + 1] - 1)]).hexdigest())
                raw = bytes(spelt[spelt_at[i] : spelt_at[i + 1]])
                by_text.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(by_ids), pa.array(by_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
