"""Packing of documents into sequences that keep a target mixture of sources.

Sources are queues that a deficit round-robin serves: each round, which is worth one sequence, a
queue earns its share of tokens, hands out as many whole ones as it has earned, and carries the
rest over. What a queue has handed out before a round is thus a formula of the round's number, so
every document finds its rounds, sequences and offsets from its place in its queue alone, and
queues run across partitions through sums by partition. Queues that earn less than ``least`` tokens
a round share one lane, in which their documents are merged in proportion.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm import parts
from driftline.llm.bpe import Merger
from driftline.session import cut_lineage

SEQUENCE = 4096
#: Queues that earn fewer tokens a round share a lane; it hands out this many at a time.
LEAST = 64
#: Fractions of a token that deficits carry, in bits.
FRACTION = 16
#: Ranges of the shared lane that are ordered apart.
RANGES = 4096
CACHED = 700_000
PIECES = 40_000


class Coder:
    """Ids of texts by a ``tokenizers`` file whose splitter drops white space, with a worker cache."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # The library says itself whether texts may be cut at spaces and before marks, and lower-cased.
        whole, cut = "It's a Test,  of 12 'words' né.\n", ["it's", "a", "test", ",", "of", "12", "'words'", "né", "."]
        if self._ids([whole])[0] != b"".join(self._ids(cut)):
            raise ValueError("this tokenizer keeps white space or case, or joins letters and marks")
        self.merger = Merger.of_file(content)
        probes = ["of", "internationalization", "née", "straße", "x"]
        if self.merger is not None:
            self.merger.kind = self.kind
            self.merger = self.merger if self._words(probes) == self._ids(probes) else None
        self.marks = dict(zip(("", ",", "."), self._ids(["", ",", "."]), strict=True))
        self.cache, self.words = parts.Cache(CACHED), parts.Cache(CACHED)

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        code = "H" if self.kind.itemsize == 2 else "I"
        return [array(code, e.ids).tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of small letters, which merge in matrices."""
        if self.merger is None:
            return self._ids(words)
        return self.merger.encode_words([w.encode() for w in words])

    def _values(self, keys: list[str]) -> list[bytes]:
        """Ids of parts; words are looked up without the case and the mark that follow from them."""
        cut = [m.groups() if (m := parts.PLAIN(k)) else None for k in keys]
        lower = [None if c is None else c[0].lower() for c in cut]
        self.words.learn((w for w in lower if w is not None), self._words)
        others = iter(self._ids([k for k, c in zip(keys, cut, strict=True) if c is None]))
        get, marks = self.words.__getitem__, self.marks
        return [next(others) if c is None else get(w) + marks[c[1]] for c, w in zip(cut, lower, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        keys = [t.replace("\n", " ").split(" ") for t in texts]
        self.cache.learn(chain.from_iterable(keys), self._values)
        get = self.cache.__getitem__
        out = [b"".join(map(get, own)) for own in keys]
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = self._ids([text])[0]
        return out


_CODERS: dict = {}


def _coder(content: bytes) -> Coder:
    key = hashlib.sha256(content).digest()
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(content)
    return _CODERS[key]


def tokenized(documents: DataFrame, tokenizer_file: str, end_id: int, doc_id: str, text: str, source: str) -> DataFrame:
    """A written table of ids, with each document's place among its source's tokens of its partition."""
    with open(tokenizer_file, "rb") as file:
        content = file.read()
    if len(content) > 64 << 20:
        raise ValueError(f"{tokenizer_file} is too large for a vocabulary")
    shipped = documents.sparkSession.sparkContext.broadcast(content)
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before = _coder(shipped.value), {}
        end = np.array([end_id], dtype=coder.kind).tobytes()
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            sources = batch.column(2).to_pylist()
            for start, stop in parts.groups(texts):
                ids = [x + end for x in coder.encode(texts[start:stop])]
                sizes, places = [len(x) // coder.kind.itemsize for x in ids], []
                for own, n in zip(sources[start:stop], sizes, strict=True):
                    places.append(before.get(own, 0))
                    before[own] = places[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start), batch.column(2).slice(start, stop - start),
                        pa.array(sizes, pa.int64()), pa.array(places, pa.int64()), pa.array(ids, pa.binary()),
                    ],
                    ["doc_id", "source", "n", "before", "ids"],
                )

    # A null source is a queue of its own.
    queue = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("source")
    coded = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), queue).select(
        "doc_id", "text", "source"
    ).mapInArrow(run, f"doc_id {kind}, source string, n long, before long, ids binary")
    numbered = coded.withColumn("row", F.monotonically_increasing_id())
    return cut_lineage(numbered.withColumn("part", F.shiftright("row", 33)), "packing-ids")


@dataclass(frozen=True)
class Lanes:
    """Tokens and earnings by round (in ``1 / 2**FRACTION`` tokens) of each lane; the last is shared."""

    tokens: np.ndarray
    earns: np.ndarray
    shifts: np.ndarray

    @classmethod
    def of(cls, tokens: list[int], weights: list[float]) -> Lanes:
        total = sum(weights) or 1.0
        # A lane without a weight earns a token a round, so that it ends as well.
        earns = [round(max(1.0, SEQUENCE * w / total) * (1 << FRACTION)) for w in weights]
        shifts = [0] * (len(tokens) - 1) + [LEAST.bit_length() - 1]
        return cls(*(np.array(x, dtype=np.int64) for x in (tokens, earns, shifts)))

    def out(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each lane has handed out before these rounds (rounds x lanes)."""
        units = (rounds[:, None] * self.earns) >> (FRACTION + self.shifts)
        return np.minimum(self.tokens, units << self.shifts)

    def rounds(self, lanes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The round in which a lane hands out the token at a place."""
        shift = self.shifts[lanes]
        worth = ((places >> shift) + 1) << (FRACTION + shift)
        return -(-worth // self.earns[lanes]) - 1

    def pieces(self, lanes: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, start, length, sequence and offset of each piece."""
        first, last = self.rounds(lanes, places), self.rounds(lanes, places + sizes - 1)
        counts = last - first + 1
        doc = np.repeat(np.arange(len(places)), counts)
        round_ = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + first[doc]
        before, after = self.out(round_), self.out(round_ + 1)
        lane, every = lanes[doc], np.arange(len(doc))
        start = np.maximum(places[doc], before[every, lane])
        stop = np.minimum((places + sizes)[doc], after[every, lane])
        given = np.cumsum(after - before, axis=1) - (after - before)
        at = before.sum(axis=1) + given[every, lane] + start - before[every, lane]
        some = stop > start
        doc, start, stop, at = doc[some], (start - places[doc])[some], (stop - places[doc])[some], at[some]
        # A piece that passes the end of a sequence goes on in the next.
        while True:
            room = SEQUENCE - at % SEQUENCE
            long = np.flatnonzero(stop - start > room)
            if not len(long):
                return doc, start, stop - start, at // SEQUENCE, at % SEQUENCE
            rest = doc[long], (start + room)[long], stop[long], (at + room)[long]
            stop[long] = (start + room)[long]
            doc, start, stop, at = (np.concatenate(x) for x in zip((doc, start, stop, at), rest, strict=True))


def _placed(stored: DataFrame, weights: Mapping[str | None, float] | None) -> tuple[DataFrame, Lanes]:
    """Each document's lane and place in it, and the lanes."""
    by_part = stored.groupBy("source", "part").agg(F.sum("n").alias("n"))
    sums = cut_lineage(
        by_part.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("part")))
        .withColumn("base", F.col("upto") - F.col("n")),
        "packing-sums",
    )
    queues = sums.groupBy("source").agg(F.sum("n").alias("tokens"))
    wanted = {"" if k is None else f"={k}": float(v) for k, v in (weights or {}).items()}
    if weights is None:
        queues = queues.withColumn("weight", F.col("tokens").cast("double"))
    else:
        given = stored.sparkSession.createDataFrame(
            [(k, v) for k, v in wanted.items()], "source string, weight double"
        )
        queues = queues.join(given, "source", "left").na.fill(0.0, ["weight"])
    tokens, weight = queues.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    # At most SEQUENCE / LEAST queues earn so much.
    own = queues.where(F.col("weight") * SEQUENCE >= F.lit(LEAST * weight)).orderBy("source").collect() if weight else []
    lanes = Lanes.of(
        [r.tokens for r in own] + [tokens - sum(r.tokens for r in own)],
        [r.weight for r in own] + [max(0.0, weight - sum(r.weight for r in own))],
    )
    numbers = F.create_map(*chain.from_iterable((F.lit(r.source), F.lit(i)) for i, r in enumerate(own))) if own else None
    lane = F.lit(len(own)) if numbers is None else F.coalesce(numbers[F.col("source")], F.lit(len(own)))
    placed = stored.join(sums.select("source", "part", "base"), ["source", "part"]).withColumn("lane", lane).withColumn(
        "place", F.col("base") + F.col("before")
    ).drop("base", "before", "part")
    alone = placed.where(F.col("lane") < len(own)).drop("source")
    # The shared lane: its queues are merged by how far through its queue a document's middle lies. Each
    # queue begins somewhere else, so that queues of one document don't meet in one place.
    begins = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / (1 << 20)
    joint = placed.where(F.col("lane") == len(own)).drop("ids").join(queues, "source").withColumn(
        "through", F.pmod((F.col("place") + F.col("n") / 2) / F.col("tokens") + begins, F.lit(1.0))
    ).withColumn("range", F.floor(F.col("through") * RANGES))
    before = (
        joint.groupBy("range").agg(F.sum("n").alias("n"))
        .withColumn("base", F.sum("n").over(Window.orderBy("range")) - F.col("n"))  # at most RANGES rows
        .select("range", "base")
    )
    along = Window.partitionBy("range").orderBy("through", "source", "row")
    merged = (
        joint.withColumn("inside", F.sum("n").over(along) - F.col("n")).join(before, "range")
        .select("row", F.lit(len(own)).alias("lane"), (F.col("base") + F.col("inside")).alias("place"))
    )
    shared = stored.drop("source", "before", "part").join(merged, "row")
    columns = ["doc_id", "n", "ids", "lane", "place"]
    return (alone.select(columns) if tokens == lanes.tokens[:-1].sum()
            else alone.select(columns).unionByName(shared.select(columns))), lanes


def pack(
    documents: DataFrame, tokenizer_file: str, end_id: int = 2, weights: Mapping[str | None, float] | None = None,
    ids: bool = False, doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Pieces of documents in sequences of ``SEQUENCE`` tokens; all but the last are full.

    ``weights`` are target shares of tokens by source (``None`` is the key of null sources); sources
    that have none come when the others are used up or in the shared lane. Without ``weights``
    each source gets its share of all tokens, so that all last to the end. A queue that has run dry
    leaves its share to the others.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids`` as
    ``array<int>`` if asked for. Every document ends with ``end_id``; a null or empty text is that
    id alone. A null doc_id stays null, repeated rows are packed each, no rows give no sequences,
    and other columns are left out.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    stored = tokenized(documents, tokenizer_file, end_id, doc_id, text, source)
    placed, lanes = _placed(stored, weights)
    with open(tokenizer_file, "rb") as file:
        item = Coder(file.read()).kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lane, place = (np.asarray(batch.column(c)).astype(np.int64) for c in ("n", "lane", "place"))
            rounds = lanes.rounds(lane, place + n - 1) - lanes.rounds(lane, place) + 1
            group = np.cumsum(rounds) // PIECES
            for start in np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(n) else []:
                stop = start + np.searchsorted(group[start:], group[start], side="right")
                doc, begin, length, sequence, offset = lanes.pieces(lane[start:stop], place[start:stop], n[start:stop])
                coded = [
                    memoryview(np.frombuffer(x.as_py(), item).astype("<u4").tobytes())
                    for x in batch.column("ids").slice(start, stop - start)
                ]
                cut = [coded[d][4 * b : 4 * e] for d, b, e in
                       zip(doc.tolist(), begin.tolist(), (begin + length).tolist(), strict=True)]
                columns = {
                    "doc_id": batch.column("doc_id").take(pa.array(doc + start)),
                    "start": pa.array(begin, pa.int64()), "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                    "doc_tokens": pa.array(n[start:stop][doc], pa.int64()),
                    "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64()),
                }
                if ids:
                    columns["ids"] = pa.array([np.frombuffer(x, "<i4") for x in cut], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return placed.mapInArrow(
        run,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + (", ids array<int>" if ids else ""),
    )
