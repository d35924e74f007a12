"""Encoding, counting and packing against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
import tiktoken
from tokenizers import Tokenizer

from driftline.llm import bpe, packing, token_counts

RANKS, COUNTS, WORDS = map(P.path, ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(3)
    odd = ["".join(rnd.choices(" \n\tab'sé1!,.  日\x1f\x85", k=rnd.randint(0, 40))) for _ in range(400)]
    return [*odd, "x" * 2500, "ab" * 1500 + " z", "  a", "a ", "'s 'll", "é" * 1400]


def test_encoder_is_the_library(library, odd_texts):
    coder = bpe.ByteBPE(bpe.read_ranks(open(RANKS, "rb").read()), P.PATTERN)
    for text, ids in zip(odd_texts, coder.encode(odd_texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_round_trip(documents, corpus, library):
    rows = {r.doc_id: r for r in bpe.round_trip(documents, RANKS, P.PATTERN, ids=True).collect()}
    assert len(rows) == len(corpus)
    for doc_id, text, *_ in corpus:
        ids = library.encode_ordinary(text or "")
        assert rows[doc_id].ids == ids and rows[doc_id].n_tokens == len(ids)
        assert rows[doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_counts(documents, corpus):
    tokenizer = Tokenizer.from_file(COUNTS)
    rows = {r.doc_id: r for r in token_counts.count_tokens(documents, COUNTS, frequent=50).collect()}
    for doc_id, text, *_ in corpus:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert tuple(rows[doc_id]) == (doc_id, len((text or "").encode()), n, n > 1024)


def test_counts_of_odd_texts(odd_texts):
    encode, special = token_counts.tokenizer_encoder(open(COUNTS, "rb").read())
    texts = [*odd_texts, "a<|endoftext|>b c", "<|endoftext|> "]
    assert token_counts.Lengths(encode, special, {}).of(texts) == encode(texts)


def test_a_full_cache_starts_anew():
    from driftline.llm.parts import Cache

    cache = Cache(4, {"k": 0})
    for keys in (["a", "b"], ["c", "d", "e"], ["a", "k"]):
        cache.learn(keys, lambda missing: [x.upper() for x in missing])
        assert all(cache[x] == x.upper() for x in keys if x != "k") and cache["k"] == 0


def packed(documents, **more):
    return packing.pack(documents, WORDS, ids=True, **more).collect()


def assert_whole(rows, corpus):
    tokenizer = Tokenizer.from_file(WORDS)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
    assert set(by_doc) == {c[0] for c in corpus}
    for doc_id, text, *_ in corpus:
        ids = []
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == len(ids)
            ids += r.ids
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert {r.doc_tokens for r in by_doc[doc_id]} == {len(ids)}
    for number, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == packing.SEQUENCE or number == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.parametrize("weights", [None, {"src1": 3.0, "src0": 1.0}, {None: 1.0}, {"no such": 1.0}])
def test_every_id_is_packed_once(documents, corpus, weights):
    assert_whole(packed(documents, weights=weights), corpus)


def test_small_queues_share_a_lane(spark):
    corpus = [(i, f"word{i} " * (i % 50), f"s{i}", 0) for i in range(300)] + [(1000, "big " * 40000, "large", 0)]
    rows = packed(spark.createDataFrame(corpus, "doc_id long, text string, source string, offset int").repartition(4))
    assert_whole(rows, corpus)


def test_a_long_tail_of_sources_fills_all_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGES", 64)
    rows = spark.range(100_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("site"), "id").alias("source"), F.lit(8).cast("long").alias("n"),
        F.lit(0).cast("long").alias("before"), F.lit(b"x").alias("ids"), F.col("id").alias("row"),
        F.shiftright("id", 15).alias("part"))
    placed, lanes = packing._placed(rows, None)
    places = sorted(r.place for r in placed.select("place").collect())
    assert places == list(range(0, 800_000, 8)) and lanes.tokens.tolist() == [800_000]
    # Neighbours in the lane come from everywhere, and no range holds twice the mean.
    first = [r.doc_id for r in placed.where("place < 8 * 1000").collect()]
    assert len({i // 10_000 for i in first}) == 10
    begins = F.pmod(F.xxhash64(F.concat(F.lit("="), "source")), F.lit(1 << 20)) / (1 << 20)
    sizes = rows.groupBy(F.floor(F.pmod(F.lit(0.5) + begins, F.lit(1.0)) * 64).alias("range")).count().collect()
    assert len(sizes) == 64 and max(r["count"] for r in sizes) < 2 * 100_000 / 64


def test_windows_hold_the_target_mixture(spark):
    corpus = [(i, "word " * 997, "ab"[i % 4 == 0]) for i in range(80)]
    rows = packed(spark.createDataFrame(corpus, "doc_id long, text string, source string"), weights=None)
    share = {}
    for r in rows:
        if corpus[r.doc_id][2] == "b":
            share[r.sequence_id] = share.get(r.sequence_id, 0) + r.length
    full = max(r.sequence_id for r in rows)
    assert all(abs(share[s] - packing.SEQUENCE / 4) <= 2 for s in range(full))


def test_empty_tables(spark, documents):
    none = documents.where("false")
    assert bpe.round_trip(none, RANKS, P.PATTERN).count() == 0
    assert token_counts.count_tokens(none, COUNTS).count() == 0
    assert packed(none) == []


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(None, "a b", "s", 1, "x", "y"), (7, "a b", "s", 2, "x", "y"), (7, "a b", "s", 2, "x", "y")]
    given = spark.createDataFrame(
        rows, "doc_id long, text string, source string, n_tokens int, ids string, part string"
    )
    assert sorted(str(r.doc_id) for r in bpe.round_trip(given, RANKS, P.PATTERN).collect()) == ["7", "7", "None"]
    assert [r.n_tokens for r in token_counts.count_tokens(given, COUNTS).collect()] == [2, 2, 2]
    assert sum(r.length for r in packed(given)) == 9
