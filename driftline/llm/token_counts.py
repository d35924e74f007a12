"""Token counts by a two-tier lookup on the map side.

A first pass finds the parts of texts that are frequent in the whole corpus: each task keeps
bounded counters and hands on its most frequent parts, and their sums give a table of at most
``frequent`` parts, whose lengths in tokens are broadcast. The second pass adds up lengths; parts
that the table lacks go through a bounded cache in each worker, filled by the tokenizer itself.
Texts and their pre-tokens are never shuffled.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import parts

#: Entries of the broadcast table, and the parts that one task of the first pass hands on.
FREQUENT = 32_768
HANDED_ON = 4_096
#: Distinct parts that a task counts before it lets go of the rarer half.
COUNTED = 200_000
CACHED = 500_000
LONGEST_PART = 64


def frequent_parts(documents: DataFrame, text: str = "text", most: int = FREQUENT) -> list[tuple[str, int]]:
    """The most frequent parts of all texts, with (nearly exact) counts; at most ``most`` rows.

    Every text is counted. A task that meets more than ``COUNTED`` distinct parts drops the rarer
    half each time, so counts of rare parts may be low; they only decide which parts are looked
    up in the table and which in the caches, and never a result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for own in batch.column(0).to_pylist():
                if own:
                    counts.update(own.split(" "))
                if len(counts) > COUNTED:
                    counts = Counter(dict(counts.most_common(COUNTED // 2)))
        top = [(k, n) for k, n in counts.most_common(HANDED_ON) if n > 1 and len(k) <= LONGEST_PART and parts.clean(k)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["part", "n"]
        )

    summed = documents.select(text).mapInArrow(run, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    return [tuple(r) for r in summed.orderBy(F.desc("n"), "part").limit(most).collect()]


class Lengths:
    """Numbers of tokens by part, for one tokenizer in one worker."""

    def __init__(self, encode: Callable[[list[str]], list[int]], special: list[str], frequent: dict[str, int]):
        self.encode, self.special = encode, special
        self.cache = parts.Cache(CACHED + len(frequent), frequent)

    def _values(self, keys: list[str]) -> list[float]:
        good = [k for k in keys if parts.clean(k)]
        found = dict(zip(good, self.encode([parts.spelled(k) for k in good]), strict=True))
        return [found.get(k, math.nan) for k in keys]

    def of(self, texts: list[str]) -> list[int]:
        keys = [parts.cut(t) for t in texts]
        self.cache.learn(chain.from_iterable(keys), self._values)
        get = self.cache.__getitem__
        sums = [sum(map(get, own)) for own in keys]
        # Runs of white space or a special string: the whole text in one call.
        whole = [
            i for i, (t, n) in enumerate(zip(texts, sums, strict=True)) if n != n or any(s in t for s in self.special)
        ]
        for i, n in zip(whole, self.encode([texts[i] for i in whole]), strict=True):
            sums[i] = n
        return sums


def tokenizer_encoder(content: bytes) -> tuple[Callable[[list[str]], list[int]], list[str]]:
    """Counting function and special strings of a ``tokenizers`` file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def count(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    return count, special


_LENGTHS: dict = {}


def _lengths(content: bytes, frequent: tuple[bytes, bytes]) -> Lengths:
    key = hashlib.sha256(content + frequent[0]).digest()
    if key not in _LENGTHS:
        _LENGTHS.clear()
        encode, special = tokenizer_encoder(content)
        names = frequent[0].decode().split(" ") if frequent[1] else []
        sizes = memoryview(frequent[1]).cast("H").tolist()
        _LENGTHS[key] = Lengths(encode, special, dict(zip(names, sizes, strict=True)))
    return _LENGTHS[key]


def count_tokens(
    documents: DataFrame, tokenizer_file: str, limit: int = 1024, frequent: int = FREQUENT,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Tokens of every whole text as a byte-level BPE file of ``tokenizers`` gives them.

    Returns ``doc_id, n_bytes long, n_tokens long, over_limit boolean`` for every input row,
    repeated rows included. No special tokens are added; special strings inside texts are special
    tokens, as is the library's default. A null text counts as empty and has no tokens; a null
    doc_id stays null; other columns are left out.
    """
    spark = documents.sparkSession
    with open(tokenizer_file, "rb") as file:
        content = file.read()
    if len(content) > 64 << 20:
        raise ValueError(f"{tokenizer_file} is too large for a vocabulary")
    # The compact table: names joined by the one character that no part holds, and their lengths.
    encode, _ = tokenizer_encoder(content)
    names = [part for part, _ in frequent_parts(documents, text, frequent)]
    sizes = encode([parts.spelled(k) for k in names])
    table = (" ".join(names).encode(), b"".join(n.to_bytes(2, "little") for n in sizes))
    shipped = spark.sparkContext.broadcast((content, table))
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(*shipped.value)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for start, end in parts.groups(texts):
                own = texts[start:end]
                n = [c if t else 0 for t, c in zip(own, lengths.of(own), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        pa.array([len(t.encode()) for t in own], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x > limit for x in n], pa.bool_()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return documents.select(doc_id, text).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
