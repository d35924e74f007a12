"""Byte-level BPE on padded matrices: all words of a length class merge at once.

Each worker cuts its texts into pre-tokens, puts the distinct ones that it hasn't met into
matrices by length class, and merges the leftmost pair of lowest rank of every row each round.
Pairs are looked up in an open-addressing hash table held in arrays; finished rows leave the
matrix. Nothing is shuffled, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from driftline.llm import parts

NONE = np.iinfo(np.int32).max
#: Wider words are merged one by one with a heap, as a round costs as much as the row is wide.
WIDEST = 1024
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512, WIDEST)
CELLS = 1 << 20
CACHED = 500_000


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Rank files have a line for each token: base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


class PairTable:
    """(left id, right id) -> id of the merged token, by linear probing in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(size, NONE, dtype=np.int32)
        at, keys, values, self.probes = self._home(keys), keys.copy(), values.copy(), 1
        while len(keys):
            free = np.flatnonzero(self.keys[at] == np.uint64(0xFFFFFFFFFFFFFFFF))
            slots, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[slots], self.values[slots] = keys[put], values[put]
            left = np.ones(len(keys), dtype=bool)
            left[put] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & (size - 1)
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, or NONE; ids below zero are padding and match nothing."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)
        at = self._home(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.values[at] != NONE))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            here = at[open_]
            hit = self.keys[here] == keys[open_]
            out[open_[hit]] = self.values[here[hit]]
            open_ = open_[~hit & (self.values[here] != NONE)]
        return out


class Merger:
    """Merges the leftmost pair of lowest id in each word until no pair is left.

    ``pairs`` maps ``left << 32 | right`` to the id of the merged token; ids are in the order in which
    pairs merge. ``last_ids`` are those of a word's last byte, where they differ.
    """

    def __init__(self, pairs: dict[int, int], byte_ids: Sequence[int], last_ids: Sequence[int] | None = None):
        self.pairs, self.kind = pairs, np.dtype("<u4")
        self.byte_ids = np.array(byte_ids, dtype=np.int32)
        self.last_ids = self.byte_ids if last_ids is None else np.array(last_ids, dtype=np.int32)
        self.table = PairTable(
            np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        )

    @classmethod
    def of_file(cls, content: bytes) -> Merger | None:
        """From a byte-level BPE file of ``tokenizers``; None if its ids aren't in the order of its merges."""
        model = json.loads(content)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        # Byte-level files spell bytes as printable characters: those that are stay, others follow from 256.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [x for x in range(256) if x not in set(plain)]
        spelled = {x: chr(x) for x in plain} | {x: chr(256 + i) for i, x in enumerate(others)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = [vocab.get(a + b, -1) for a, b in merges]
        letters = [spelled[x] for x in range(256)]
        if ids != sorted(ids) or not ids or not all(x in vocab and x + end in vocab for x in letters) or min(ids) < 256:
            return None
        pairs = {vocab[a] << 32 | vocab[b]: i for (a, b), i in zip(merges, ids, strict=True)}
        return cls(pairs, [vocab[x] for x in letters], [vocab[x + end] for x in letters])

    # Words to ids

    def encode_words(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of each word, which is not split any further, as little-endian 32-bit integers."""
        out: list = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        classes = np.searchsorted(np.array(WIDTHS), lengths)
        for c, width in enumerate(WIDTHS):
            rows = np.flatnonzero(classes == c)
            step = max(1, CELLS // width)
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                self._matrix([words[i] for i in part], lengths[part], width, part, out)
        for i in np.flatnonzero(classes == len(WIDTHS)):
            out[i] = self._long(words[i])
        return out

    def _matrix(self, words, lengths, width, rows, out) -> None:
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((len(words), width), -1, dtype=np.int32)
        joined = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids[inside] = self.byte_ids[joined]
        ids[np.arange(len(words)), lengths - 1] = self.last_ids[joined[np.cumsum(lengths) - 1]]
        lengths = lengths.copy()
        ranks = np.full((len(words), width), NONE, dtype=np.int32)  # of the pair that begins here
        both = inside[:, 1:]
        ranks[:, :-1][both] = self.table.find(ids[:, :-1][both], ids[:, 1:][both])
        columns = np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)  # the leftmost of equal ranks
            every = np.arange(len(rows))
            best = ranks[every, at]
            done = best == NONE
            if done.any():
                flat, item = ids[done].astype(self.kind).tobytes(), self.kind.itemsize
                starts = range(0, len(flat), item * ids.shape[1])
                for start, to, n in zip(starts, rows[done].tolist(), (item * lengths[done]).tolist(), strict=True):
                    out[to] = flat[start : start + n]
                go = ~done
                ids, ranks, lengths, rows, at, best = ids[go], ranks[go], lengths[go], rows[go], at[go], best[go]
                if not len(rows):
                    return
                wide = int(lengths.max())
                ids, ranks, columns = ids[:, :wide], ranks[:, :wide], columns[:wide]
                every = np.arange(len(rows))
            # Close the gap behind the merged pair.
            source = columns + (columns > at[:, None])
            source[source >= len(columns)] = len(columns) - 1
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            lengths = lengths - 1
            ids[every, at] = best
            outside = columns >= lengths[:, None]
            ids[outside] = -1
            ranks[outside] = NONE
            last = lengths - 1
            ranks[every, last] = NONE
            right = np.flatnonzero(at < last)
            ranks[right, at[right]] = self.table.find(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.table.find(ids[left, at[left] - 1], ids[left, at[left]])

    def _long(self, word: bytes) -> bytes:
        """The same merges for one very long word, with a heap over a linked list."""
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        ids[-1] = int(self.last_ids[word[-1]])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def offer(i: int) -> list[tuple[int, int, int, int]]:
            j = after[i]
            rank = self.pairs.get(ids[i] << 32 | ids[j]) if j < n else None
            return [] if rank is None else [(rank, i, ids[i], ids[j])]

        heap = [x for i in range(n - 1) for x in offer(i)]
        heapq.heapify(heap)
        while heap:
            rank, i, one, two = heapq.heappop(heap)
            if ids[i] != one or (j := after[i]) >= n or ids[j] != two:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    for x in offer(k):
                        heapq.heappush(heap, x)
        return np.array([x for x in ids if x >= 0], dtype=self.kind).tobytes()


class ByteBPE(Merger):
    """Encoder and decoder for a rank file, in which ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        super().__init__(pairs, [ranks[bytes([b])] for b in range(256)])
        size = max(ranks.values()) + 1
        self.lengths = np.zeros(size, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.starts = np.cumsum(self.lengths) - self.lengths
        flat = [b""] * size
        for token, rank in ranks.items():
            flat[rank] = token
        self.flat = np.frombuffer(b"".join(flat), dtype=np.uint8)
        self.cache, self.words = parts.Cache(CACHED), parts.Cache(CACHED)

    # Texts to ids

    def _values(self, keys: list[str]) -> list[bytes | None]:
        """Ids of each key's text; None for parts at which a text may not be cut."""
        cut: list[Sequence[str] | None] = []
        for k in keys:
            if plain := parts.PLAIN(k):
                word, mark = plain.groups()
                cut.append((" " + word, mark) if mark else (" " + word,))
            else:
                cut.append(self.pattern.findall(parts.spelled(k)) if parts.clean(k) else None)
        return self._joined(cut)

    def _joined(self, cut: list[Sequence[str] | None]) -> list[bytes | None]:
        self.words.learn(
            chain.from_iterable(c for c in cut if c),
            lambda words: self.encode_words([w.encode() for w in words]),
        )
        get = self.words.__getitem__
        return [None if c is None else get(c[0]) if len(c) == 1 else b"".join(map(get, c)) for c in cut]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        keys = [parts.cut(t) for t in texts]
        self.cache.learn(chain.from_iterable(keys), self._values)
        out, get = [], self.cache.__getitem__
        for text, own in zip(texts, keys, strict=True):
            try:
                out.append(b"".join(map(get, own)) if text else b"")
            except TypeError:  # runs of white space: no cutting at spaces
                out.append(self._joined([self.pattern.findall(text)])[0])
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of little-endian ids."""
        ids = np.frombuffer(ids, dtype="<u4")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        return self.flat[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)].tobytes()


def round_trip(
    documents: DataFrame, rank_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text", ids: bool = False
) -> DataFrame:
    """Encode every whole text, decode the ids, and give digests of both.

    Returns ``doc_id, n_tokens long, ids_sha256, decoded_sha256`` for every input row, repeated
    rows included, and with ``ids`` the ids themselves as ``array<int>``. A null text counts as
    empty; an empty text has no ids; a null doc_id stays null; other columns are left out.
    ``rank_file`` is read on the driver and sent to the workers, so it must be a vocabulary
    file, of a few MB at most.
    """
    spark = documents.sparkSession
    with open(rank_file, "rb") as file:
        content = file.read()
    if len(content) > 64 << 20:
        raise ValueError(f"{rank_file} is too large for a vocabulary")
    shipped = spark.sparkContext.broadcast(content)
    kind = documents.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(shipped.value, pattern)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for start, end in parts.groups(texts):
                coded = bpe.encode(texts[start:end])
                columns = [
                    batch.column(0).slice(start, end - start),
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(c)).hexdigest() for c in coded], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array([np.frombuffer(c, "<i4") for c in coded], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return documents.select(doc_id, text).mapInArrow(run, schema + (", ids array<int>" if ids else ""))


_ENCODERS: dict = {}


def _encoder(content: bytes, pattern: str) -> ByteBPE:
    """One encoder a worker for the same vocabulary and pattern, with its cache."""
    key = hashlib.sha256(content + b"\0" + pattern.encode()).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ByteBPE(read_ranks(content), pattern)
    return _ENCODERS[key]
