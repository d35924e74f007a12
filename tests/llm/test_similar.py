"""Near-duplicates, repeated passages and exact search against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import minhash, queries, sais, suffix, topk
from driftline.llm.shingles import shingles


def words(text):
    out = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_shingles_are_the_words_runs():
    for text in (None, "", " \n", "A b", "a B c d e f a b c d e f", "é x \x1cq\x0b\x0cw"):
        assert len(shingles(text)) == len(shingle_set(text))


def near_corpus():
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for family in range(6):
        base = rnd.choices(vocabulary, k=rnd.choice([30, 120, 200]))
        for _ in range(rnd.randint(1, 12)):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append(" ".join(copy))
    # One large family, around the threshold.
    base = rnd.choices(vocabulary, k=150)
    for _ in range(150):
        copy = list(base)
        for _ in range(rnd.randint(0, 4)):
            copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
        rows.append(" ".join(copy))
    return list(enumerate(rows))


def test_components(spark, corpus):
    rows = [(i, t) for i, t, *_ in corpus] + [(100 + i, t) for i, t in near_corpus()]
    expected = linked_components(rows)
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in minhash.link(given).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())


def test_components_of_rows_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, 1), (5, text, 1), (9, text + " more", 1), (9, text + " more", 1), (None, "alone", 1), (None, None, 1)]
    given = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    found = sorted((str((r.doc_id, r.component_id, r.kept)) for r in minhash.link(given).collect()))
    assert found == sorted(map(str, [
        (None, 5, False), (5, 5, True), (9, 5, False), (9, 5, False), (None, None, True), (None, None, True)]))
    assert minhash.link(given.where("false")).count() == 0


def edited(base, places, rnd):
    copy = list(base)
    for i in places:
        copy[i] = f"e{rnd.random()}"
    return copy


def light_and_heavy(rnd, base):
    """A text, copies with one edit, and copies with four that are linked to that text alone."""
    heavy = rnd.sample(list(itertools.combinations(range(70, 145, 5), 4)), 40)
    return [base] + [edited(base, [rnd.randrange(4, 61)], rnd) for _ in range(300)] + [edited(base, h, rnd) for h in heavy]


def several_hubs(rnd, base):
    """Texts that are linked to each other, each with copies that are linked to that one alone."""
    hubs = [edited(base, [i], rnd) for i in range(5, 65, 5)]
    far = rnd.sample(list(itertools.combinations(range(70, 145, 5), 4)), 25 * len(hubs))
    return hubs + [edited(hubs[i % len(hubs)], h, rnd) for i, h in enumerate(far)]


@pytest.mark.parametrize("group", [light_and_heavy, several_hubs])
def test_crowds_are_linked_whole(spark, group):
    rnd = random.Random(4)
    texts = [" ".join(t) for t in group(rnd, [f"w{i}" for i in range(150)])]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    expected = linked_components(rows)
    assert {component for _, component in expected.values()} == {0}
    found = minhash.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def joined(pairs, known):
    """Components of ``known`` (node to component) after more links."""
    known = dict(known)
    for a, b in pairs:
        low, high = sorted((known[a], known[b]))
        known = {node: low if component == high else component for node, component in known.items()}
    return known


@pytest.mark.parametrize("several", [False, True])
def test_blocks_give_a_forest_of_their_links(several):
    rnd = random.Random(6)
    texts = [" ".join(t) for t in light_and_heavy(rnd, [f"w{i}" for i in range(150)])[230:]]
    texts += [" ".join(rnd.choices(texts[0].split(), k=150)) for _ in range(5)] + ["few words", "few other words"]
    rnd.shuffle(texts)
    sets = [shingles(t) for t in texts]
    slots = np.stack([minhash.signature(s) for s in sets])
    block = np.array([rnd.randrange(2) if several else 4 for _ in texts])
    component = np.array([rnd.choice([7, 7, 7, 100 + i]) for i in range(len(texts))])
    every = [
        (a, b) for a, b in itertools.combinations(range(len(texts)), 2)
        if (not several or block[a] != block[b])
        and 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
    ]
    found = minhash.compared(block, component, slots, sets)
    assert {tuple(sorted(p)) for p in found} <= set(every)
    before = dict(enumerate(component.tolist()))
    assert joined(found, before) == joined(every, before)
    assert len(found) == len(set(before.values())) - len(set(joined(every, before).values()))


def test_blocks_of_a_crowd_meet_in_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LEAST", 10)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 1 << 14)
    rnd = random.Random(6)
    texts = [" ".join(t) for t in several_hubs(rnd, [f"w{i}" for i in range(150)])]
    rows = list(enumerate(texts))
    given = spark.createDataFrame(rows, "doc_id long, text string")
    classes = minhash._signed(given, "doc_id", "text").withColumnRenamed("doc_id", "node").cache()
    crowds = classes.select("node", F.lit(0).cast("long").alias("crowd"))
    sets = minhash._sets(given, classes, "doc_id", "text")
    known = spark.createDataFrame([(i, 0) for i in range(50)], "node long, component long")
    blocks = minhash._blocks(crowds, sets, classes, known)
    sizes = blocks.groupBy("i", "j").agg(F.sum(F.length("set")).alias("bytes")).collect()
    assert max(r["bytes"] for r in sizes) <= 4 << 14
    assert len(sizes) > 20 and all(r["i"] < 25 for r in sizes)
    links = [(r.a, r.b) for r in blocks.mapInArrow(minhash._cells, "a long, b long").collect()]
    assert len(links) < blocks.count()
    assert set(joined(links, {i: 0 if i < 50 else i for i in range(len(texts))}).values()) == {0}


def test_repeated_rows_give_one_set(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text)] * 50 + [(3, "another")] * 20 + [(None, text)] * 30 + [(8, text + " more")]
    nodes = spark.createDataFrame([(3,), (8,)], "node long")
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = minhash._sets(given, nodes, "doc_id", "text").groupBy("node").count().collect()
    assert sorted(r["count"] for r in found) == [1, 1, 2]


@pytest.mark.parametrize("links", [2_000_000, 20])
def test_stars_follow_long_chains(spark, monkeypatch, links):
    monkeypatch.setattr(minhash, "LINKS", links)
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    two = chain.union(spark.range(100, 110).select(F.col("id"), F.lit(99).cast("long"))).repartition(8)
    found = {r.node: r.component for r in minhash.components(two).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 99 for i in range(99, 110)}}
    assert minhash.components(two.limit(0)).count() == 0


def test_links_are_followed_in_arrays():
    rnd = random.Random(3)
    for n in (0, 1, 5, 40, 400):
        pairs = [(rnd.randrange(-n, n), rnd.randrange(-n, n)) for _ in range(n)]
        least = {x: x for p in pairs for x in p}
        for _ in least:
            for a, b in pairs:
                least[a] = least[b] = min(least[a], least[b])
        ends = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        nodes, found = minhash.smallest_reached(ends[:, 0], ends[:, 1])
        assert dict(zip(nodes.tolist(), found.tolist(), strict=True)) == least


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_array(letters, monkeypatch):
    monkeypatch.setattr(sais, "SHORT", 3)
    rng = np.random.default_rng(letters)
    for n in [1, 2, 5, 60, 300]:
        text = np.append(rng.integers(1, letters + 1, n), 0).astype(np.uint8)
        whole = text.tobytes()
        order = sais.suffix_array(text)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: whole[i:])
        for most in (8, 20):
            before, shared = sais.common_prefixes(text, order, most)
            for j, i in zip(order.tolist(), order[1:].tolist(), strict=False):
                k = 0
                while k < most and max(i, j) + k <= n and whole[i + k] == whole[j + k]:
                    k += 1
                assert before[i] == j and shared[i] == k


def without_repeats(rows, length):
    seen = {}
    for number, (_, text) in enumerate(rows):
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            seen.setdefault(data[i : i + length], set()).add((number, i))
    out = []
    for number, (doc_id, text) in enumerate(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, dtype=bool)
        for i in range(len(data) - length + 1):
            if len(seen[data[i : i + length]]) > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeating(rnd):
    """Texts with periods, recurring lines, and passages of all lengths in several places."""
    shared = ["".join(rnd.choices("abcdefé ", k=150)) for _ in range(3)]
    line = "".join(rnd.choices("pqrst", k=60)) + "\n"

    def noise(n):
        return "".join(rnd.choices("abcdefg ", k=n))

    rows = [(200 + i, noise(120) + rnd.choice(shared) + "".join(rnd.choices("xyz", k=90))) for i in range(25)]
    rows += [(None, shared[0] * 3), (300, "z" * 1500), (301, noise(50) + "z" * 130), (302, "abcdefghijk" * 90)]
    rows += [(303, "".join(line + noise(rnd.randint(20, 90)) for _ in range(12))), (304, "z" * 900 + noise(200) + "z" * 900)]
    rows += [(310 + i, noise(40) + shared[1][i : 60 + 3 * i] + noise(60) + line * (i % 4)) for i in range(30)]
    return rows


@pytest.mark.parametrize(("length", "crowd"), [(400, 4096), (100, 4096), (100, 1), (64, 3), (400, 0)])
def test_repeats_are_removed(spark, corpus, length, crowd):
    rows = [(i, t) for i, t, *_ in corpus]
    rows += [*repeating(random.Random(2)), (7, rows[7][1])]
    names = ("digest", "data", "row", "left_over", "__digest", "n_bytes", "salt", "with.dot")
    given = spark.createDataFrame([(*r, *range(8)) for r in rows], "doc_id long, text string, " + ", ".join(
        f"`{n}` int" for n in names)).repartition(3)
    found = suffix.remove_repeats(given, length, crowd=crowd).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == without_repeats(rows, length)
    for r in found:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
        assert bytes(r.kept).decode(errors="ignore") == r.text
    left = suffix.without_repeats(given, length, crowd=crowd)
    assert left.columns == given.columns
    texts = sorted(((r.doc_id, r.text) for r in found), key=str)
    assert sorted(((r.doc_id, r.text or "") for r in left.collect()), key=str) == texts
    assert {tuple(r)[2:] for r in left.collect()} == {tuple(range(8))}


@pytest.mark.parametrize(("length", "passage", "crowd"), [(400, 240, 4096), (400, 240, 2), (100, 64, 0), (64, 100, 4096)])
def test_passages_of_a_second_length(spark, corpus, length, passage, crowd):
    rows = [*[(i, t) for i, t, *_ in corpus], *repeating(random.Random(3))]
    rows += [(7, rows[7][1]), (8, "q" + rows[7][1][-300:]), (9, rows[7][1][:300]), (9, rows[7][1][:300])]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = suffix.remove_repeats(given, length, crowd=crowd, passage=passage).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == without_repeats(rows, length)
    expected = sorted(((r[0], r[1], r[2], r[3]) for r in without_repeats(rows, passage)), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_passage_bytes, r.n_passages) for r in found), key=str) == expected
    alone = suffix.remove_repeats(given, passage, crowd=crowd).collect()
    assert sorted(((r.doc_id, r.without_passages) for r in found), key=str) == sorted(
        ((r.doc_id, r.text) for r in alone), key=str)


def test_query_shows_passages_of_fifty_words(spark, tmp_path):
    """Passages of 51 words and less than 400 bytes that two documents share, among documents of their own."""
    rnd = random.Random(6)

    def prose(n):
        return " ".join("".join(rnd.choices("aeinrst", k=rnd.randint(3, 6))) for _ in range(n))

    shared = [prose(51) for _ in range(10)]
    assert max(map(len, shared)) < 400
    rows = [(i, f"{prose(90)} {shared[i % 10]} {prose(80)}") for i in range(20)] + [(i, prose(220)) for i in range(20, 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op7_suffix_array_dedup(spark, str(tmp_path)).collect()
    texts = dict(rows)
    for r in found:
        assert (r.n_removed, r.text) == (0, texts[r.doc_id])
        assert (r.n_passage_bytes > 0) == (r.n_passages == 1) == (r.doc_id < 20)
        assert (shared[r.doc_id % 10] in r.without_passages) is False
        assert r.doc_id < 20 or r.without_passages == texts[r.doc_id]


def test_no_texts_have_no_repeats(documents):
    assert suffix.remove_repeats(documents.where("false")).count() == 0
    assert suffix.without_repeats(documents.where("text IS NULL")).collect()[0].text is None


def best(rows, k, every):
    good = [(i, [np.floor(64 * float(x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            scores = sorted((-int(np.dot(a, b)), i) for i, b in good if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 420)]  # ties
    rows += [(500, None), (520, [None] * 8), (540, [float("nan")] * 8), (560, [float("inf")] + [0.0] * 7), (None, [1.0] * 8),
             (580, [1.0, 2.0]), (600, [3.0, 1.0]), (620, []), (621, [])]
    given = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    for cell, queries in ((topk.CELL, topk.QUERIES), (64, 5)):
        monkeypatch.setattr(topk, "CELL", cell)
        monkeypatch.setattr(topk, "QUERIES", queries)
        assert sorted(tuple(r) for r in topk.top_k(given, k=7).collect()) == best(rows, 7, 20)
    assert topk.top_k(given.where("false")).count() == 0
    assert sorted(tuple(r) for r in topk.top_k(given.where("vec_id <= 3")).collect()) == best(rows[:4], 20, 20)
