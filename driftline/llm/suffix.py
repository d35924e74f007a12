"""Removal of repeated passages with suffix arrays.

A byte goes if a string of ``length`` bytes that covers it starts at another place too. Each window
of that length belongs to the leftmost of its smallest gram hashes, and equal windows have it at the
same distance. So the corpus is cut into pieces of neighbouring windows with one such place, which
have less than twice the length; hashes that occur once are done with, and the pieces of the others
meet by hash, in shards that are sorted by induced sorting. Places whose suffix shares ``length``
bytes with a neighbour's in order start a repeated window. Texts are only moved if they hold such a
hash, and equal pieces only once.

Passages of a second length are found on the way. The smallest hash of a longer window is that of a
shorter one inside it as well, so the pieces of the shorter windows serve for both, reaching as far
around their place as the longer windows do. Pieces that share too little around their place with
any other are not sorted: a repeated window needs one of four strings around it to recur.

A hash with a crowd of different pieces is not gathered. Its pieces are aligned at the place of the
hash, so equal windows begin at the same distance from it; distances are taken in ranges, and what
all windows of a range share, and what they cover together, is counted by digests. Most ranges are
settled so, and only the others are counted window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from driftline.llm.needed import maybe_needed, only_needed
from driftline.llm.sais import common_prefixes, suffix_array
from driftline.llm.windows import GRAM, gram_hashes, window_minima
from driftline.session import fresh_path

LENGTH = 400
#: Fifty words of running text have more bytes than this, but for one passage in a hundred.
PASSAGE = 240
#: Bytes that are sorted together, and of a partition of pieces.
SHARD, PARTITION = 4_000_000, 24_000_000
#: Hashes with more different pieces than this are counted by digests; distances that are taken together.
CROWD, RANGE = 4096, 16
#: Never occurs in UTF-8.
SEPARATOR = b"\xf8"
#: Covered bytes, and the length of the repeated strings that cover them.
SPANS = "array<struct<start:int,stop:int,length:int>>"
SPAN_LISTS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("length", pa.int32())]))
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "left_over")
PASSAGE_RESULTS = ("n_passage_bytes", "n_passages", "without_passages")
#: Strings around its place of which a piece must share one with another to be sorted.
PARTS = 4


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder, packed tightly as it holds texts, and go on from there."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _covered(starts: np.ndarray, stops: np.ndarray, length: int) -> list[dict]:
    """Ascending spans, joined where they touch."""
    if not len(starts):
        return []
    first = np.flatnonzero(np.r_[True, starts[1:] > stops[:-1]])
    last = np.r_[first[1:], len(starts)] - 1
    return [
        {"start": a, "stop": b, "length": length}
        for a, b in zip(starts[first].tolist(), stops[last].tolist(), strict=True)
    ]


def _reach(first, place, stop, length: int, greater=np.maximum, smaller=np.minimum) -> tuple:
    """Bytes of a piece that its windows of ``length`` cover; if these are fewer, it has none.

    They hold the gram at the place, and do not leave the piece.
    """
    return greater(first, place - (length - GRAM)), smaller(stop, place + length)


def _runs(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leftmost places of the smallest gram hash, and the first and last window that has it there."""
    width = length - GRAM + 1
    low = window_minima(hashes, width)
    # The leftmost place of the minimum changes if it leaves the window, or if a smaller one enters.
    first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (hashes[: len(low) - 1] == low[:-1])])
    last = np.r_[first[1:], len(low)] - 1
    windows = np.lib.stride_tricks.sliding_window_view(hashes, width)
    place = first.copy()
    for i in range(0, len(first), 1024):
        own = first[i : i + 1024]
        place[i : i + 1024] += (windows[own] == low[own, None]).argmax(axis=1)
    return place, first, last


def _cut(data: bytes, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[dict]]:
    """Hash, start, place and end of each different piece, and spans of pieces that the text repeats."""
    hashes = gram_hashes(np.frombuffer(data, np.uint8), GRAM)
    place, first, last = _runs(hashes, lengths[0])
    stop = last + lengths[0]
    for length in lengths[1:]:
        if len(data) >= length:
            further, start, last = _runs(hashes, length)
            own = np.searchsorted(place, further)
            first[own], stop[own] = start, last + length
    values = hashes[place].view(np.int64)
    _, number, many = np.unique(values, return_inverse=True, return_counts=True)
    later, repeated = np.zeros(len(first), bool), np.zeros(len(first), bool)
    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(many[number] > 1).tolist():
        same = seen.setdefault(xxhash.xxh3_128_digest(data[first[i] : stop[i]]), i)
        if same != i:
            later[i] = repeated[i] = repeated[same] = True
    inside = []
    for length in lengths if repeated.any() else ():
        start, end = _reach(first[repeated], place[repeated], stop[repeated], length)
        has = end - start >= length
        inside += _covered(start[has], end[has], length)
    return values[~later], first[~later], place[~later], stop[~later], inside


def _named(documents: DataFrame, text: str) -> DataFrame:
    """The bytes of all texts under 128 bits of their digest."""
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return documents.select(F.substring(F.unhex(F.sha2(data, 256)), 1, 16).alias("digest"), data.alias("data"))


def _measured(documents: DataFrame, lengths: tuple[int, ...], text: str) -> DataFrame:
    """Digest of each text of the least length or more, its pieces, and what the text repeats itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, SPAN_LISTS]
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                cut = [_cut(t.as_py(), lengths) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array([c[i] for c in cut], k) for i, k in enumerate(kinds)]],
                    ["digest", "hashes", "firsts", "places", "stops", "inside"],
                )

    return _named(documents, text).where(F.octet_length("data") >= lengths[0]).mapInArrow(
        run, f"digest binary, hashes array<long>, firsts array<int>, places array<int>, stops array<int>, inside {SPANS}"
    )


def _texts(documents: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """``wanted`` (by ``digest``) with the text of each, once."""
    given = only_needed(_named(documents, text), F.col("digest"), wanted, F.col("digest"))
    return given.groupBy("digest").agg(F.first("data").alias("data")).join(wanted.hint("merge"), "digest")


def _pieces(texts: DataFrame) -> DataFrame:
    """The digest of each wanted piece, and where in it its place is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                digest, data, pieces = (batch.column(c)[r].as_py() for c in (0, 1, 2))
                for i in range(0, len(pieces), 5000):
                    part = pieces[i : i + 5000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p["hash"] for p in part], pa.int64()),
                            pa.array([xxhash.xxh3_128_digest(data[p["first"] : p["stop"]]) for p in part], pa.binary()),
                            pa.array([digest] * len(part), pa.binary()),
                            pa.array([p["first"] for p in part], pa.int32()),
                            pa.array([p["place"] - p["first"] for p in part], pa.int32()),
                            pa.array([p["stop"] - p["first"] for p in part], pa.int32()),
                        ],
                        ["hash", "piece", "digest", "first", "at", "size"],
                    )

    return texts.select("digest", "data", "pieces").mapInArrow(
        run, "hash long, piece binary, digest binary, first int, at int, size int"
    )


def _bytes(texts: DataFrame) -> DataFrame:
    """The bytes of pieces, from one text that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                data, pieces = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                for i in range(0, len(pieces), 5000):
                    part = pieces[i : i + 5000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p["hash"] for p in part], pa.int64()), pa.array([p["piece"] for p in part], pa.binary()),
                            pa.array([p["at"] for p in part], pa.int32()), pa.array([p["size"] for p in part], pa.int32()),
                            pa.array([data[p["first"] : p["first"] + p["size"]] for p in part], pa.binary()),
                        ],
                        ["hash", "piece", "at", "size", "data"],
                    )

    return texts.select("data", "pieces").mapInArrow(run, "hash long, piece binary, at int, size int, data binary")


def _spans(starts: np.ndarray, length: int, shift: int = 0) -> list[dict]:
    """Bytes covered by windows that begin at ``starts`` (ascending)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    first = starts[np.r_[0, cut + 1]] + shift
    last = starts[np.r_[cut, len(starts) - 1]] + shift
    return [{"start": a, "stop": b + length, "length": length} for a, b in zip(first.tolist(), last.tolist(), strict=True)]


def repeated_in(pieces: list[bytes], at: list[int], lengths: tuple[int, ...]) -> list[list[dict]]:
    """Spans of each piece that its windows cover which start elsewhere among the pieces too."""
    joined = SEPARATOR.join(pieces) + SEPARATOR
    text = np.append(np.frombuffer(joined, np.uint8) + np.uint8(1), np.uint8(0))
    order = suffix_array(text)
    shared = common_prefixes(text, order, lengths[-1])[1][order]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes + 1)
    begin = ends - sizes - 1
    places = np.array(at, np.int64)
    out: list[list[dict]] = [[] for _ in pieces]
    for length in lengths:
        # Windows that a longer reach brings into a piece belong to others, and are counted there.
        low, high = _reach(np.zeros_like(sizes), places, sizes, length)
        tied = shared >= length
        near = np.flatnonzero(tied | np.append(tied[1:], False))
        group, starts = np.cumsum(~tied)[near], order[near].astype(np.int64)
        own = np.minimum(np.searchsorted(ends, starts, side="right"), len(pieces) - 1)
        inside = starts - begin[own]
        valid = (inside >= low[own]) & (inside + length <= high[own])
        group, starts = group[valid], starts[valid]
        if not len(starts):
            continue
        starts = np.sort(starts[np.bincount(group)[group] > 1])
        bounds = np.searchsorted(starts, np.append(begin, len(joined)))
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            out[i] += _spans(starts[bounds[i] : bounds[i + 1]] - begin[i], length)
    return out


def _partnered(pieces: list[tuple], length: int) -> list[tuple]:
    """Of pieces with one hash (hash, name, place, bytes), those that may hold a window of another.

    A window that begins ``d`` bytes in front of the place reaches over the string that begins at the
    last multiple of ``step`` up to ``d``, and ends as far behind the gram as is sure.
    """
    step = (length - GRAM) // PARTS
    out = [False] * len(pieces)
    for i in range(PARTS):
        seen: dict[bytes, int] = {}
        for k, (_, _, at, data) in enumerate(pieces):
            start, stop = at - i * step, at + GRAM + (PARTS - 1 - i) * step
            if start >= 0 and stop <= len(data):
                same = seen.setdefault(data[start:stop], k)
                if same != k:
                    out[k] = out[same] = True
    return [piece for piece, has in zip(pieces, out, strict=True) if has]


def _sorted_shards(pieces: DataFrame, lengths: tuple[int, ...], n_bytes: int) -> DataFrame:
    """Repeated spans of different pieces that share a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[tuple]) -> pa.RecordBatch:
            spans = repeated_in([x[3] for x in held], [x[2] for x in held], lengths)
            keep = [i for i, own in enumerate(spans) if own]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([held[i][0] for i in keep], pa.int64()), pa.array([held[i][1] for i in keep], pa.binary()),
                    pa.array([spans[i] for i in keep], SPAN_LISTS),
                ],
                ["hash", "piece", "spans"],
            )

        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held: list[tuple] = []
        size = 0
        for _, group in groupby(rows, itemgetter(0)):
            met = _partnered(list(group), lengths[0])
            held += met
            size += sum(len(x[3]) for x in met)
            if size >= SHARD:
                yield found(held)
                held, size = [], 0
        if held:
            yield found(held)

    n = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PARTITION))
    ordered = pieces.select("hash", "piece", "at", "data").repartition(n, "hash").sortWithinPartitions("hash")
    return ordered.mapInArrow(run, f"hash long, piece binary, spans {SPANS}")


def _reaching(pieces: DataFrame, length: int) -> DataFrame:
    """What windows of ``length`` cover of each piece that has any, and where in the piece it begins (``low``)."""
    low, high = _reach(F.lit(0), F.col("at"), F.col("size"), length, F.greatest, F.least)
    reached = pieces.withColumns({"low": low, "high": high}).where(F.col("high") - F.col("low") >= length)
    return reached.select(
        "hash", "piece", "low", (F.col("at") - F.col("low")).alias("at"),
        F.substring("data", F.col("low") + 1, F.col("high") - F.col("low")).alias("data"),
    )


def _distances(at: int, data: bytes, length: int) -> tuple[int, int]:
    """The least and greatest distance of a window's start from the place of the hash."""
    return at - (len(data) - length), at


def _ranges(pieces: DataFrame, length: int) -> DataFrame:
    """For each range of distances of a piece: digests of what its windows share, and of what they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for hash_, piece, _, place, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                least, most = _distances(place, data, length)
                for r in range(least // RANGE, most // RANGE + 1):
                    name = f"{hash_}:{r}:".encode()
                    start, stop = place - RANGE * r - (RANGE - 1), place - RANGE * r + length
                    core = xxhash.xxh3_128_digest(name + data[start + RANGE - 1 : stop - RANGE + 1])
                    inside = start >= 0 and stop <= len(data)
                    rows.append((hash_, piece, r, core, xxhash.xxh3_128_digest(name + data[start:stop]) if inside else None))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["hash", "piece", "range", "core", "cover"]
            )

    return pieces.mapInArrow(run, "hash long, piece binary, range int, core binary, cover binary")


def _windows(pieces: DataFrame, length: int) -> DataFrame:
    """Digests of all windows in the named ranges of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hash_, piece, _, place, data, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                least, most = _distances(place, data, length)
                starts = [
                    place - d for r in ranges for d in range(max(least, RANGE * r), min(most, RANGE * r + RANGE - 1) + 1)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([hash_] * len(starts), pa.int64()), pa.array([piece] * len(starts), pa.binary()),
                        pa.array(starts, pa.int32()),
                        pa.array([xxhash.xxh3_128_digest(data[i : i + length]) for i in starts], pa.binary()),
                    ],
                    ["hash", "piece", "start", "window"],
                )

    return pieces.mapInArrow(run, "hash long, piece binary, start int, window binary")


def _counted(pieces: DataFrame, length: int) -> DataFrame:
    """Repeated spans of the windows of ``_reaching`` pieces of crowded hashes, by digests; no hash is gathered.

    A range whose shared part occurs once has no repeated window; one whose cover occurs twice has
    only such; the windows of all others are counted one by one.
    """
    pieces = written(_reaching(pieces, length), "suffix-reaching")
    ranges = written(_ranges(pieces, length), "suffix-ranges")
    twice = {
        name: ranges.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(
            name, F.lit(True).alias(f"{name}_twice")) for name in ("core", "cover")
    }
    live = written(
        ranges.join(twice["core"], "core").join(twice["cover"], "cover", "left")
        .select("hash", "piece", "range", "core", "cover", "cover_twice"), "suffix-live",
    )
    open_ = live.where("cover_twice IS NULL")
    # Windows of open ranges may also occur in settled ones, one of which stands for all with its cover.
    settled = live.where("cover_twice").join(open_.select("core").distinct(), "core", "left_semi").groupBy("cover").agg(
        F.min(F.struct("hash", "piece", "range")).alias("one")
    )
    asked = open_.select("hash", "piece", "range").union(settled.select("one.*")).groupBy("hash", "piece").agg(
        F.collect_list("range").alias("ranges")
    )
    windows = written(_windows(pieces.join(asked, ["hash", "piece"]), length), "suffix-windows")
    often = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    single = windows.join(often, "window", "left_semi").groupBy("hash", "piece").agg(F.collect_list("start").alias("starts"))
    whole = live.where("cover_twice").groupBy("hash", "piece").agg(F.collect_list("range").alias("ranges"))
    marked = pieces.join(single, ["hash", "piece"], "left").join(whole, ["hash", "piece"], "left").where(
        "starts IS NOT NULL OR ranges IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, low, place, _, starts, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                inside = [place - d for r in ranges or [] for d in range(RANGE * r, RANGE * r + RANGE)]
                found.append(_spans(np.array(sorted([*(starts or []), *inside]), np.int64), length, low))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, SPAN_LISTS)], ["hash", "piece", "spans"])

    return marked.mapInArrow(run, f"hash long, piece binary, spans {SPANS}")


def _joined(spans: DataFrame) -> DataFrame:
    """Sorted spans of each text, joined where those of one length touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own in batch.column(1).to_pylist():
                out: list[dict] = []
                last: dict[int, dict] = {}
                for s in own:
                    before = last.get(s["length"])
                    if before and s["start"] <= before["stop"]:
                        before["stop"] = max(before["stop"], s["stop"])
                    else:
                        out.append(s)
                        last[s["length"]] = s
                found.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPAN_LISTS)], ["digest", "spans"])

    return spans.select("digest", "spans").mapInArrow(run, f"digest binary, spans {SPANS}")


def repeated_spans(
    documents: DataFrame, lengths: tuple[int, ...], text: str, crowd: int = CROWD
) -> tuple[DataFrame, DataFrame]:
    """By digest of the text: covered spans in order, and the texts that occur twice.

    Those go as a whole, and are left out of the spans. ``lengths`` ascend.
    """
    texts = written(
        _measured(documents, lengths, text).groupBy("digest").agg(
            F.count("*").alias("copies"),
            *[F.first(c).alias(c) for c in ("hashes", "firsts", "places", "stops", "inside")],
        ),
        "suffix-texts",
    )
    cut = texts.select("digest", F.inline(F.arrays_zip("hashes", "firsts", "places", "stops"))).toDF(
        "digest", "hash", "first", "place", "stop")
    often = cut.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    # Which joins broadcast at small sizes would only hide what they shuffle at large ones.
    wanted = cut.join(often.hint("merge"), "hash").groupBy("digest").agg(
        F.collect_list(F.struct("hash", "first", "place", "stop")).alias("pieces")
    )
    wanted = written(wanted, "suffix-wanted")
    pieces = written(_pieces(_texts(documents, wanted, text)), "suffix-pieces")
    different = written(
        pieces.groupBy("hash", "piece").agg(
            F.count("*").alias("n"), F.min(F.struct("digest", "first", "at", "size")).alias("one")),
        "suffix-different",
    )
    hashes = different.groupBy("hash").agg(F.count("*").alias("many")).where("many > 1")
    met = written(different.join(hashes, "hash"), "suffix-met")
    n_bytes, most = met.agg(F.sum("one.size"), F.max("many")).first()

    def bytes_of(kind: Column) -> DataFrame:
        asked = met.where(kind).groupBy("one.digest").agg(
            F.collect_list(F.struct("hash", "piece", "one.first", "one.at", "one.size")).alias("pieces"))
        return _bytes(_texts(documents, written(asked, "suffix-asked"), text))

    found = written(_sorted_shards(bytes_of(F.col("many") <= crowd), lengths, n_bytes or 0), "suffix-found")
    if (most or 0) > crowd:
        crowds = written(bytes_of(F.col("many") > crowd), "suffix-crowds")
        for length in lengths:
            found = found.unionByName(_counted(crowds, length))
    whole = different.where("n > 1").select("hash", "piece", F.lit(True).alias("whole"))
    places = pieces.join(found.hint("merge"), ["hash", "piece"], "left").join(whole.hint("merge"), ["hash", "piece"], "left")
    reached = [
        (length, *_reach(F.lit(0), F.col("at"), F.col("size"), length, F.greatest, F.least)) for length in lengths
    ]
    every_window = F.filter(
        F.array(*[F.struct(a.alias("start"), b.alias("stop"), F.lit(n).alias("length")) for n, a, b in reached]),
        lambda s: s["stop"] - s["start"] >= s["length"],
    )
    covered = F.transform(F.when(F.col("whole"), every_window).otherwise(F.col("spans")), lambda s: F.struct(
        (s["start"] + F.col("first")).alias("start"), (s["stop"] + F.col("first")).alias("stop"), s["length"].alias("length")))
    every = places.select("digest", covered.alias("spans")).union(texts.select("digest", "inside"))
    spans = every.where(F.size("spans") > 0).groupBy("digest").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")
    )
    spans = spans.join(texts.where("copies > 1").select("digest"), "digest", "left_anti")
    return written(_joined(spans), "suffix-spans"), texts.where("copies > 1").select("digest")


def _removed(data: bytes, spans: list[dict], whole: bool, length: int) -> tuple[bytes, int]:
    """What is left without the spans of ``length``, and how many went."""
    if whole:
        return (b"", 1) if len(data) >= length else (data, 0)
    own = [s for s in spans if s["length"] == length]
    edges = [0, *(x for s in own for x in (s["start"], s["stop"])), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(own)


def _left_over(
    documents: DataFrame, spans: DataFrame, copied: DataFrame, text: str, length: int, passage: int | None = None
) -> DataFrame:
    """All rows, as a struct ``row``, with what is left of their text and how much went.

    With ``passage``, also how much goes by strings of that length, and what is left of the text then.

    Only texts that may have lost something are shuffled to their spans, and copies of one text go to
    several tasks.
    """
    salts = 16
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.sha2(data, 256).alias("sha256"),
    ).withColumn("digest", F.substring(F.unhex("sha256"), 1, 16))
    data = F.coalesce(F.col("row").getField(text), F.lit("")).cast("binary").alias("data")
    changed = written(
        spans.select("digest", "spans", F.lit(False).alias("whole")).union(
            copied.select("digest", F.lit(None).cast(SPANS), F.lit(True))), "suffix-changed",
    )
    flagged = maybe_needed(rows, F.col("digest"), changed, F.col("digest"), "touched")
    same = flagged.where("NOT touched").select(
        "row", F.octet_length(data).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.col("sha256").alias("kept_sha256"), data.alias("kept"),
        F.coalesce(F.col("row").getField(text), F.lit("")).alias("left_over"),
        *([F.lit(0).cast("long").alias("n_passage_bytes"), F.lit(0).cast("long").alias("n_passages"),
           F.coalesce(F.col("row").getField(text), F.lit("")).alias("without_passages")] if passage else []),
    )
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    met = flagged.where("touched").select("row", "digest", salt.alias("salt")).join(
        changed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["digest", "salt"], "left"
    ).select("row", data, "spans", F.coalesce("whole", F.lit(False)).alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = []
                for r in range(part.num_rows):
                    data, spans, whole = (part.column(c)[r].as_py() for c in (1, 2, 3))
                    kept, n = _removed(data, spans or [], whole, length)
                    row = [len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept, kept.decode(errors="ignore")]
                    if passage:
                        rest, n = _removed(data, spans or [], whole, passage)
                        row += [len(data) - len(rest), n, rest.decode(errors="ignore")]
                    rows.append(row)
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["row", *names]
                )

    names = [*RESULTS, *(PASSAGE_RESULTS if passage else ())]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    kinds += [pa.int64(), pa.int64(), pa.string()] if passage else []
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, left_over string"
    fields += ", n_passage_bytes long, n_passages long, without_passages string" if passage else ""
    schema = StructType([StructField("row", rows.schema["row"].dataType), *StructType.fromDDL(fields).fields])
    return same.unionByName(met.mapInArrow(run, schema))


def without_repeats(
    documents: DataFrame, length: int = LENGTH, text: str = "text", crowd: int = CROWD,
) -> DataFrame:
    """The documents themselves, all columns and rows, with what ``remove_repeats`` leaves as text.

    Characters of which bytes are removed go as a whole; a text that goes entirely becomes empty, a
    null text stays null. Texts shorter than ``length`` stay as they are; rows that repeat a text of
    that length are all emptied, as copies are. An empty table stays empty; other columns, whatever
    their names, keep their values.
    """
    spans, copied = repeated_spans(documents, (length,), text, crowd)
    left = _left_over(documents, spans, copied, text, length)
    return left.select(*[
        (F.when(F.col("row").getField(c).isNotNull(), F.col("left_over")) if c == text else F.col("row").getField(c)).alias(c)
        for c in documents.columns
    ])


def remove_repeats(
    documents: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD,
    passage: int | None = None,
) -> DataFrame:
    """Documents without the bytes of repeated passages; one row for each input row.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and what is left as ``kept`` (the
    bytes) and ``text`` (the characters that are left whole). Strings of ``length`` bytes are compared
    within texts and between them, on the input, and never across documents; all their places are
    removed, the first included. A null or empty text has no bytes; shorter texts than ``length``
    stay whole; rows that repeat a text are removed if it is long enough, as copies are. A null
    doc_id stays null; an empty table gives no rows; other columns are left out.

    With ``passage``, three columns follow by the same rules for strings of that many bytes, in place
    of ``length``: ``n_passage_bytes`` and ``n_passages`` (bytes and runs that go), and
    ``without_passages`` (the characters that are left whole). The others stay as they are.
    """
    spans, copied = repeated_spans(documents, tuple(sorted({length, passage or length})), text, crowd)
    given = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    left = _left_over(given, spans, copied, "text", length, passage)
    return left.select(
        F.col("row").getField("doc_id").alias("doc_id"), *RESULTS[:-1], F.col("left_over").alias("text"),
        *(PASSAGE_RESULTS if passage else ()),
    )
