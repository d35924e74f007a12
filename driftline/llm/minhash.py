"""Near-duplicate detection with a forest of sorted MinHash signatures.

Documents with equal shingle sets are one class. The signatures of the classes are sorted in several
slot orders; classes that stand together and share a prefix are candidates. A region of classes with
a common prefix that is small gives all its pairs; a larger one gives its neighbours, and goes one
slot deeper, until its parts are small. Candidates whose signatures agree enough are confirmed on
the full sets, and links are followed to components. Large regions with a class in common are one
crowd; its classes that are still apart then meet all others of it, block by block, and a pair of
blocks gives no more links than it needs to hold together what they link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.shingles import STEP, mixed, shingles
from driftline.session import cut_and_count, cut_lineage

WORDS = 5
#: Slots of a signature; each order begins with four slots of its own.
SLOTS, FIRST, TAIL = 128, 4, 12
ORDERS = SLOTS // FIRST
#: Regions up to this size give all their pairs.
SMALL = 32
#: Slots of a tail that a pair must share; a pair at the threshold shares nine on average.
TAIL_AGREES = 4
#: Slots of 128 that a pair at 0.75 misses less than once in ten million times.
AGREES = 70
#: Rows that one task sorts, about.
ROWS = 400_000
FACTORS = (mixed(np.arange(1, SLOTS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
BLOCK = 1024


def signature(hashes: np.ndarray) -> np.ndarray:
    """Low halves of the minima of ``SLOTS`` hash functions over a set."""
    low = np.full(SLOTS, 0xFFFFFFFF, dtype=np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), BLOCK):
        np.minimum(low, np.multiply.outer(short[i : i + BLOCK], FACTORS).min(axis=0), out=low)
    return (low & np.uint32(0xFFFF)).astype(np.uint16)


def _signed(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Size, digest and signature of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sets = [shingles(t.as_py(), WORDS) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([signature(s).tobytes() for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n", "digest", "signature"],
                )

    given = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, "doc_id long, n long, digest binary, signature binary")


def _sorted_rows(classes: DataFrame) -> DataFrame:
    """A row for each class and order: four slots as a key and the next twelve, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                slots = np.frombuffer(b"".join(part.column(1).to_pylist()), ">u2").reshape(-1, SLOTS)
                for order in range(ORDERS):
                    at = (np.arange(FIRST + TAIL) + order * FIRST) % SLOTS
                    packed = np.ascontiguousarray(slots[:, at]).view(">u8").astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(packed), order, np.int8)),
                         *[pa.array(packed[:, i]) for i in range(4)], part.column(0)],
                        ["o", "k", "t0", "t1", "t2", "node"],
                    )

    rows = classes.select("node", "signature").mapInArrow(
        run, "o byte, k long, t0 long, t1 long, t2 long, node long"
    )
    return rows


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Number of the run of equal rows that each row is in."""
    new = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


#: What a row of ``_neighbours`` is: a candidate pair, a class and the first one of its large region, or
#: the first class of a region at the edge of a range and the region's key.
PAIR, TOGETHER, EDGE = 0, 1, 2


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs, and the members of large regions, of one range of sorted rows."""
    tables = [pa.Table.from_batches([b]) for b in batches]
    if not tables:
        return
    rows = pa.concat_tables(tables)
    o, k, t0, t1, t2, node = (np.asarray(c.combine_chunks()) for c in rows.columns)
    if not len(node):
        return

    def found(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b)], ["kind", "a", "b"]
        )

    run = _runs(o, k)
    sizes = np.bincount(run)
    tails = np.stack([t0, t1, t2], axis=1).view(np.uint16)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    first = node[starts]
    # A region may go on in the neighbouring range.
    edges = np.unique(run[[0, -1]])
    yield found(EDGE, first[edges], (mixed(k.astype(np.uint64) + o.astype(np.uint64) * STEP)).view(np.int64)[starts[edges]])
    crowded = np.flatnonzero((sizes[run] > SMALL) | np.isin(run, edges))
    yield found(TOGETHER, node[crowded], first[run[crowded]])
    active = np.flatnonzero(sizes[run] > 1)
    run, node, tails = run[active], node[active], tails[active]
    deeper = np.stack([t0, t1, t2], axis=1)[active].byteswap().view(np.uint16).reshape(-1, TAIL)

    def pairs(i: np.ndarray, distance: int) -> pa.RecordBatch:
        a, b = node[i], node[i + distance]
        good = ((tails[i] == tails[i + distance]).sum(axis=1) >= TAIL_AGREES) & (a != b)
        a, b = a[good], b[good]
        return found(PAIR, np.minimum(a, b), np.maximum(a, b))

    open_ = np.ones(len(run), dtype=bool)
    for depth in range(TAIL + 1):
        if not open_.any():
            break
        sizes = np.bincount(run)
        small = open_ & (sizes[run] <= SMALL)
        for distance in range(1, SMALL):
            i = np.flatnonzero(small[:-distance] & small[distance:] & (run[:-distance] == run[distance:]))
            if not len(i):
                break
            yield pairs(i, distance)
        large = open_ & ~small
        for distance in (1, 2):  # neighbours with the longest common prefixes
            i = np.flatnonzero(large[:-distance] & large[distance:] & (run[:-distance] == run[distance:]))
            if len(i) and depth in (0, TAIL):
                yield pairs(i, distance)
        open_ = large
        if depth < TAIL:
            run = _runs(run, deeper[:, depth])


def candidates(classes: DataFrame, n_classes: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs of classes that stand together in some order, and links between those in large regions."""
    tasks = max(
        int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_classes * ORDERS // ROWS)
    )
    ordered = _sorted_rows(classes).repartitionByRange(tasks, "o", "k", "t0", "t1", "t2", "node")
    found = ordered.sortWithinPartitions("o", "k", "t0", "t1", "t2", "node").mapInArrow(
        _neighbours, "kind byte, a long, b long"
    )
    found = cut_lineage(found, "minhash-found")
    pairs, together, edges = (found.where(F.col("kind") == kind).drop("kind") for kind in (PAIR, TOGETHER, EDGE))
    # A few rows for each range: the parts of a region that lies in several.
    across = edges.join(edges.groupBy("b").agg(F.min("a").alias("first")), "b").select("a", F.col("first").alias("b"))
    together = together.union(across).where("a != b").distinct()
    return pairs.distinct(), cut_lineage(together, "minhash-together")


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sizes allow a link and whose signatures agree enough, with the number of equal slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, SLOTS)
                    for c in ("a_signature", "b_signature"))
            agree = (a == b).sum(axis=1)
            good = np.flatnonzero(agree >= AGREES)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(pa.array(good)), batch.column("b").take(pa.array(good)),
                 pa.array(agree[good], pa.int32())], ["a", "b", "agree"],
            )

    joined = pairs
    for side in "ab":
        own = classes.select(
            F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("signature").alias(f"{side}_signature")
        )
        joined = joined.join(own, side)
    possible = joined.where(F.least("a_n", "b_n") * 4 >= F.greatest("a_n", "b_n") * 3)
    return possible.select("a", "b", "a_signature", "b_signature").mapInArrow(run, "a long, b long, agree int")


#: Bits of the filter that tells which documents' sets are needed; a full one lets all pass.
FILTER_BITS = 1 << 22


def _sets(documents: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Full sets of the documents that stand for the classes in ``nodes``, each set of a doc_id once."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    # At most FILTER_BITS / 64 rows, whatever the number of documents.
    words = nodes.select(bit("node").alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")
    )
    given = documents.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    with_bit = given.withColumn("bit", bit("node"))
    wanted = with_bit.join(F.broadcast(words), F.shiftright("bit", 6) == F.col("word"), "left").where(
        F.col("node").isNull() | (F.expr("shiftright(bits, cast(bit & 63 as int)) & 1") == 1)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingles(t.as_py(), WORDS) for t in part.column(1)]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                names = [
                    unnamed(d) if i is None else i for i, d in zip(part.column(0).to_pylist(), digests, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "digest", "set"],
                )

    found = wanted.select("node", "text").mapInArrow(run, "node long, digest binary, set binary")
    return found.dropDuplicates(["node", "digest"])


#: Classes without any doc_id get numbers below this one.
UNNAMED = -(1 << 62)


def unnamed(digest: bytes) -> int:
    return UNNAMED - 1 - (int.from_bytes(digest[:7], "big"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with ``100 * intersection >= 75 * union`` on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in (2, 3))
                both = np.concatenate([a, b])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= 75 * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("a", "b")
    for side in "ab":
        joined = joined.join(sets.select(F.col("node").alias(side), F.col("set").alias(f"{side}_set")), side)
    return joined.select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long").distinct()


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of links between ``a`` and ``b``, and the smallest node each one leads to."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(nodes))
    while (apart := least[a] != least[b]).any():
        a, b = a[apart], b[apart]
        one, two = least[a], least[b]
        # Roots are tied to smaller roots, and then everybody to their root.
        np.minimum.at(least, np.maximum(one, two), np.minimum(one, two))
        while (up := least[least])[least != up].size:
            least = up
    return nodes, nodes[least]


#: Links that one task follows by itself.
LINKS = 2_000_000


def _followed(links: DataFrame, tasks: int) -> DataFrame:
    """Links of each task's nodes to the smallest one that its own links lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches]
        if tables:
            rows = pa.concat_tables(tables)
            nodes, least = smallest_reached(*(np.asarray(rows[c].combine_chunks()) for c in "ab"))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["a", "b"])

    return links.coalesce(tasks).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for all nodes of ``links`` (``a, b``); the component is its smallest node.

    Each task follows the links it has; what is left of them is at most one for each of its nodes.
    If there are several tasks, large and small stars follow in turn: a round ties neighbours to the
    smallest one, without ever gathering a node's neighbours, until only stars are left.
    """
    state = None
    links, n = cut_and_count(links.select("a", "b"), "links")
    while True:
        tasks = max(1, -(-n // LINKS))
        links = _followed(links, tasks)
        if tasks == 1:
            return cut_lineage(links, "links").toDF("node", "component")
        links = cut_lineage(links.where("a != b"), "links")
        around = links.union(links.select("b", "a")).toDF("u", "v")
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").where("v > u AND v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.distinct(), "links")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v != m").select("v", "m").union(least.select("u", "m")).toDF("a", "b")
        links, n = cut_and_count(small.distinct(), "links")
        now = n, links.agg(F.sum(F.xxhash64("a", "b") % (1 << 40))).first()[0]
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                links.select("b", "b").distinct()
            )
        state = now


def _best(pairs: DataFrame) -> DataFrame:
    """For each class its pair of best agreement and the one with the smallest partner of good agreement."""
    sides = pairs.select("a", "b", "agree").union(pairs.select("b", "a", "agree")).toDF("node", "other", "agree")
    best = sides.groupBy("node").agg(
        F.max_by("other", F.struct("agree", -F.col("other"))).alias("best"),
        F.min(F.when(F.col("agree") >= SLOTS * 13 // 16, F.col("other"))).alias("first"),
    )
    both = best.select("node", F.explode(F.array("best", "first")).alias("other")).where("other IS NOT NULL")
    return both.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of different components, with both components."""
    for side in "ab":
        own = known.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in"))
        pairs = pairs.join(own, side, "left").withColumn(f"{side}_in", F.coalesce(f"{side}_in", side))
    return pairs.where("a_in != b_in")


#: Bytes of a block, those of a class beside its set, and the blocks that smaller crowds are cut into.
BLOCK_BYTES, BESIDE, SPREAD, LEAST = 16 << 20, 300, 8, 128


def _blocks(crowds: DataFrame, sets: DataFrame, classes: DataFrame, known: DataFrame) -> DataFrame:
    """Classes of crowds that aren't one component yet, by pairs of blocks.

    The largest component of a crowd has blocks of its own, which only meet those of the rest: its
    classes need no comparison with each other.
    """
    placed = crowds.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = cut_lineage(placed.join(classes.select("node", "digest", "n"), "node"), "minhash-crowds")
    sizes = placed.groupBy("crowd", "component").agg(F.count("*").alias("many"), F.sum("n").alias("shingles"))
    largest = sizes.groupBy("crowd").agg(
        F.max_by("component", F.struct("many", -F.col("component"))).alias("main"),
        F.max_by(F.struct("many", "shingles"), F.struct("many", -F.col("component"))).alias("inside"),
        F.sum("many").alias("many"), F.sum("shingles").alias("shingles"), F.count("*").alias("parts"),
    ).where("parts > 1")

    def blocks(many: F.Column, shingles: F.Column) -> F.Column:
        spread = F.least(F.ceil(many / LEAST), F.lit(SPREAD))
        return F.greatest(spread, F.ceil((shingles * 8 + many * BESIDE) / BLOCK_BYTES), F.lit(1)).cast("int")

    inside = F.col("inside")
    open_ones = largest.select(
        "crowd", "main", blocks(F.col("many") - inside["many"], F.col("shingles") - inside["shingles"]).alias("open"),
        blocks(inside["many"], inside["shingles"]).alias("closed"),
    )
    block = F.pmod(F.xxhash64("digest", "node"), F.when(F.col("component") == F.col("main"), F.col("closed")).otherwise(F.col("open")))
    met = placed.join(open_ones, "crowd").withColumn(
        "block", F.when(F.col("component") == F.col("main"), F.col("open")).otherwise(F.lit(0)) + block.cast("int")
    )
    others = F.when(
        F.col("component") == F.col("main"), F.sequence(F.lit(0), F.col("open") - 1)
    ).otherwise(F.sequence(F.lit(0), F.col("open") + F.col("closed") - 1))
    spread = met.withColumn("other", F.explode(others)).select(
        "crowd", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node",
        "digest", "component",
    )
    full = classes.select("node", "digest", "signature").join(sets, ["node", "digest"])
    columns = ["crowd", "i", "j", "block", "node", "component", "signature", "set"]
    return spread.join(full, ["node", "digest"]).select(columns).repartition("crowd", "i", "j").sortWithinPartitions(
        "crowd", "i", "j"
    )


def compared(block: np.ndarray, component: np.ndarray, slots: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of places that link classes of two blocks, or of one, on full sets: a forest over components.

    A row meets those after it whose component it hasn't been linked with yet, whose size allows a link
    and whose signature agrees enough; shared shingles are counted for all of them at once.
    """
    n = np.array([len(s) for s in sets])
    ends = np.cumsum(n)
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mine = np.zeros(shingle.max(initial=-1) + 1, dtype=bool)
    kinds, group = np.unique(component, return_inverse=True)  # numbers, joined when linked
    several = block.min() != block.max()
    closed = group == np.bincount(group, minlength=len(kinds)).argmax()
    links = []
    # All pairs of two components have a member outside of the most common one.
    for r in np.flatnonzero(~closed).tolist():
        may = (group != group[r]) & (4 * np.minimum(n, n[r]) >= 3 * np.maximum(n, n[r]))
        may[:r] &= closed[:r]  # other pairs have been met from the other side
        if several:
            may &= block != block[r]
        others = np.flatnonzero(may)
        if not len(others):
            continue
        others = others[(slots[others] == slots[r]).sum(axis=1) >= AGREES]
        if not len(others):
            continue
        mine[shingle[ends[r] - n[r] : ends[r]]] = True
        for start in range(0, len(others), 1000):
            part = others[start : start + 1000]
            places = np.repeat(ends[part] - np.cumsum(n[part]), n[part]) + np.arange(n[part].sum())
            common = np.add.reduceat(mine[shingle[places]], np.cumsum(n[part]) - n[part], dtype=np.int64)
            for p in part[100 * common >= 75 * (n[part] + n[r] - common)].tolist():
                if group[p] != group[r]:
                    links.append((r, p))
                    group[group == group[p]] = group[r]
        mine[shingle[ends[r] - n[r] : ends[r]]] = False
    return links


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows that are sorted by cell."""
    keys = ("crowd", "i", "j")

    def linked(rows: pa.Table) -> pa.RecordBatch:
        block, node, component = (np.asarray(rows[c].combine_chunks()) for c in ("block", "node", "component"))
        slots = np.frombuffer(b"".join(rows["signature"].to_pylist()), "<u2").reshape(-1, SLOTS)
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for c in rows["set"].chunks for s in c]
        links = np.array(compared(block, component, slots, sets), dtype=np.int64).reshape(-1, 2)
        ends = node[links]
        return pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = _runs(*(np.asarray(batch.column(c)) for c in keys))
        edges = [*np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]).tolist(), batch.num_rows]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(start, stop - start)
            if held and any(held[0].column(c)[0] != part.column(c)[0] for c in keys):
                yield linked(pa.Table.from_batches(held))
                held = []
            held.append(part)
    if held:
        yield linked(pa.Table.from_batches(held))


def link(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Near-duplicate components of documents by sets of five-word shingles.

    Returns ``doc_id, n_shingles, component_id, kept``, one row for every input row. Documents are
    linked if their sets share 75 % or more of their union; ``component_id`` is the smallest doc_id
    that links lead to, and ``kept`` tells whether that is the document's own. A null or empty text
    has an empty set and is linked with nothing. A text of fewer than five words is one shingle.
    Rows with one doc_id are one node. A null doc_id stays null and takes part; a component without
    any doc_id has a null ``component_id`` and its rows are kept. doc_ids are above ``-2**62``. Other
    columns are left out.

    Links are exact; candidates come from ``ORDERS`` signature orders, which miss a pair at the
    threshold in small regions less than once in 100,000 times. Classes of large regions meet all
    classes of their crowd that are in other components.
    """
    signed = cut_lineage(_signed(documents, doc_id, text), "minhash-signed")
    low = F.conv(F.substring(F.hex("digest"), 1, 14), 16, 10).cast("long")
    classes, n_classes = cut_and_count(
        signed.where("n > 0").groupBy("digest", "n")
        .agg(F.min("doc_id").alias("least"), F.first("signature").alias("signature"))
        .withColumn("node", F.coalesce("least", F.lit(UNNAMED - 1) - low)).drop("least"),
        "minhash-classes",
    )
    near, together = candidates(classes, n_classes)
    pairs = cut_lineage(_agreeing(near, classes), "minhash-pairs")
    crowds = cut_lineage(components(together).toDF("node", "crowd"), "minhash-crowds")
    needed = reduce(DataFrame.union, [pairs.select("a"), pairs.select("b"), crowds.select("node")]).toDF("node")
    sets = cut_lineage(_sets(documents, needed, doc_id, text), "minhash-sets")
    # First each class's best pairs; then what those links haven't yet brought together.
    first = cut_lineage(_confirmed(_best(pairs), sets), "minhash-links")
    rest = _apart(pairs, components(first)).drop("a_in", "b_in")
    links = first.union(cut_lineage(_confirmed(rest, sets), "minhash-links"))
    # Classes of large regions may have missed each other.
    blocks = _blocks(crowds, sets, classes, components(links))
    found = components(links.union(blocks.mapInArrow(_cells, "a long, b long")))
    named = classes.select("digest", "n", "node").join(found, "node", "left").select(
        "digest", "n", F.coalesce("component", "node").alias("component")
    )
    out = signed.select("doc_id", "digest", "n").join(named, ["digest", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(
        F.when(F.col("component") >= UNNAMED, F.col("component"))
    )
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
