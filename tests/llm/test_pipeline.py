"""All stages of the pipeline against brute force, on one fixture with null and repeated ids."""

import random

import numpy as np
import public_tokenizers
import regex
from test_similar import linked_components
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, `row` int, `key` int"


def accepted(text):
    """The verdict of the rules, spelled out."""
    text = text or ""
    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    chars, n = sum(map(len, words)), len(words)
    failed = [
        n < 20, 100 * len(repeated) > 30 * n, 4 * sum(text.count(c) for c in "#*$%&|<>") > n,
        100 * (len(lines) - len(set(lines))) > 50 * len(lines), chars < 2 * n, chars > 25 * n,
        100 * len(regex.findall(r"\p{Lu}", text)) > 60 * chars,
        100 * sum(bool(regex.search(r"\p{L}\p{L}", w)) for w in words) < 50 * n, 50 * len(set(words)) < min(n, 1000),
    ]
    return not any(failed)


def one_of_each_group(rows):
    groups = linked_components([(i, text) for i, (_, text) in enumerate(rows)])
    best = {}
    for i, row in enumerate(rows):
        order = (row[0] is None, row[0] or 0, i)
        best[groups[i][1]] = min(best.get(groups[i][1], (order, i)), (order, i))
    return [rows[i] for _, i in best.values()]


def without_passages(rows, length):
    seen = {}
    for n, (_, text) in enumerate(rows):
        data = text.encode()
        for i in range(len(data) - length + 1):
            seen.setdefault(data[i : i + length], set()).add((n, i))
    out = []
    for doc_id, text in rows:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if len(seen[data[i : i + length]]) > 1:
                gone[i : i + length] = True
        out.append((doc_id, bytes(b for b, g in zip(data, gone, strict=True) if not g).decode(errors="ignore")))
    return out


def fixture(corpus):
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choices("aeinrstdlöé", k=rnd.randint(3, 8))) for _ in range(2000)]
    prose = lambda n: " ".join(rnd.choices(vocabulary, k=n)) + "."
    passage, base = prose(52), prose(200)
    rows = [(i, t) for i, t, *_ in corpus]
    rows += [(100 + i, prose(60) + " " + passage + " " + prose(40 + i)) for i in range(6)]
    rows += [(None, base), (None, base), (60, base.replace(" ", "  ", 3)), (61, base + " " + prose(8)), (62, prose(90))]
    rows += [(62, prose(70)), (62, prose(75)), (None, prose(65)), (None, prose(66))]
    rows += [(70 + i, prose(30) + "\n" + " ".join(passage.split()[: 20 + 4 * i]) + "\n" + prose(30)) for i in range(5)]
    return rows


def test_every_stage_is_its_brute_force(spark, corpus):
    import corpus_pipeline as pipeline

    rows = fixture(corpus)
    docs = spark.createDataFrame([(i, t, "en", f"s{n % 4}", len(t or ""), n, 7) for n, (i, t) in enumerate(rows)], SCHEMA)
    docs = docs.repartition(5)
    ids = docs.schema.names
    as_set = lambda table: sorted(((r.doc_id, r.text) for r in table.collect()), key=str)
    rules, near, passages, packing = (stage for _, stage in pipeline.STAGES)

    docs = rules(spark, docs, "").cache()
    rows = [r for r in rows if accepted(r[1])]
    assert len(rows) > 20 and as_set(docs) == sorted(rows, key=str)
    docs = near(spark, docs, "").cache()
    rows = one_of_each_group(rows)
    assert as_set(docs) == sorted(rows, key=str)
    docs = passages(spark, docs, "").cache()
    cut = without_passages(rows, pipeline.PASSAGE)
    assert as_set(docs) == sorted(cut, key=str) and docs.schema.names == ids
    # The planted passages of over 50 words are gone everywhere, and texts without one are whole.
    planted = {i: (t, dict(rows)[i]) for i, t in cut if i is not None and 100 <= i < 106}
    assert all(len(was.split()) - len(left.split()) in (51, 52, 53) for left, was in planted.values())
    assert {i for (i, left), (_, was) in zip(cut, rows, strict=True) if left != was} <= {*range(100, 106), *range(70, 75)} | {10, 11}
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = {}
    for r in packing(spark, docs.withColumnRenamed("key", "key2"), "").collect():
        packed.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, list(r.ids)))
    found = sorted((str(doc_id), sum(len(p) for _, p in pieces)) for (doc_id, _), pieces in packed.items())
    expected = {}
    for doc_id, text in cut:
        tokens = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        key = str(doc_id), len(tokens)
        expected[key] = expected.get(key, 0) + len(tokens)
    assert found == sorted((doc_id, n) for (doc_id, _), n in expected.items())
    for doc_id, text in cut:
        tokens = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        pieces = sorted(packed[doc_id, len(tokens)])
        if sum(len(p) for _, p in pieces) == len(tokens):
            assert [t for _, p in pieces for t in p] == tokens
