"""Pages, licenses, quality rules, dialogues and the pipeline."""

import random
import re

import pytest
from pyspark.sql import functions as F

from driftline.llm import chat, html, licenses, quality

PAGES = [
    ("<p>One<p>two <b>bold</b>\n  text", "One\n\ntwo bold text"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>after", "- a\n- b\n  3. x\n  4. y\n- c\n\nafter"),
    ("<table><caption>Cap</caption><tr><th>Name<th>Value<tr><td>long name<td>1<tr><td colspan=2>wide"
     "<tr><td>x<td>two<br>lines</table>end",
     "Cap\nName       Value\nlong name  1\nwide\nx          two\n           lines\n\nend"),
    ("a<div hidden>no</div><div style='display: none'>no <p>no</div><script>var a='</p>';</script>b", "ab"),
    ("<span style='visibility:hidden'>h<i style='visibility:visible'>v</i></span><!-- c -->w", "vw"),
    ("<pre>a\n  b\n\nc</pre>", "a\n  b\n\nc"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<td>d</table>", "a  b\n   c  d"),
    ("<table><tr><td rowspan=2>a<br>second<td>b<tr><td>c<tr><td colspan=2>wide one<td>z</table>",
     "a       b\nsecond  c\nwide one   z"),
    ("x<svg><title>T</title><desc>D</desc><defs><text>no</text></defs><text>Axis &amp; one</text><text>two</text></svg>y",
     "x\nAxis & one\ntwo\ny"),
    ("<p>So <math><mi>E</mi><mo>=</mo><mi>m</mi><semantics><mn>2</mn><annotation>tex</annotation></semantics></math>.",
     "So E=m2."),
    ("<style>.no, #gone{display:none} p.yes{display:block} @media print{b{display:none}} i{visibility:hidden}</style>"
     "<p class='no'>1<p class='no yes'>2<div id=gone>3</div><b>4</b><i>5</i><p class=no style='display:block'>6",
     "2\n\n4\n\n6"),
    ("<table>early<tr><td>a</table>", "early\n\na"),
    ("a &amp; b&nbsp;c<br>d", "a & b\xa0c\nd"),
    ("<head><title>T</title><style>x</style></head><body><h1>H</h1>t", "H\n\nt"),
    ("<dl><dt>t<dd>d</dl><blockquote>q</blockquote>", "t\n  d\n\n  q"),
    ("<table><tr><td>a<table><tr><td>i<td>j</table><td>b</table>", "a     b\n\ni  j"),
    ("1 < 2 and a<b", "1 < 2 and a<b"),
    ("", ""), ("<!-- never closed", ""), ("</p>x</li></table>", "x"),
]


@pytest.mark.parametrize(("source", "text"), PAGES)
def test_rendering(source, text):
    assert html.render(source)[0] == text


def layout(node, depth=0):
    """Lines of a generated block, by plain recursion; None stands for a blank line."""
    kind, inside = node
    if kind == "p":
        return [None, inside, None]
    if kind == "div":
        return [line for child in inside for line in layout(child, depth)]
    if kind in ("ul", "ol"):
        lines = []
        for n, (text, more) in enumerate(inside, 1):
            lines.append("  " * depth + ("- " if kind == "ul" else f"{n}. ") + text)
            lines += layout(more, depth + 1) if more else []
        return [None, *lines, None] if depth == 0 else lines
    columns = max(len(row) for row in inside)
    widths = [max((len(row[c]) for row in inside if c < len(row)), default=0) for c in range(columns)]
    rows = ["  ".join(cell.ljust(w) for cell, w in zip(row, widths, strict=False)).rstrip() for row in inside]
    return [None, *rows, None]


def markup(node, rnd):
    """The block as a page would have it; end tags that authors leave out are left out at times."""
    kind, inside = node
    end = lambda tag: f"</{tag}>" if rnd.random() < 0.5 else ""
    if kind == "p":
        return f"<p>{inside}</p>"
    if kind == "div":
        return "<div>" + "\n".join(markup(child, rnd) for child in inside) + "</div>"
    if kind in ("ul", "ol"):
        items = "".join(f"<li>{text}{markup(more, rnd) if more else ''}{end('li')}" for text, more in inside)
        return f"<{kind}>{items}</{kind}>"
    rows = "".join("<tr>" + "".join(f"<td> {cell} {end('td')}" for cell in row) + end("tr") for row in inside)
    return f"<table>{'<tbody>' if rnd.random() < 0.5 else ''}{rows}</table>"


def test_generated_pages_are_laid_out_as_by_recursion():
    rnd = random.Random(4)
    text = lambda: " ".join("".join(rnd.choices("abcdef", k=rnd.randint(1, 6))) for _ in range(rnd.randint(1, 4)))

    def block(depth, lists=False):
        kind = rnd.choice(["ul", "ol"] if lists else ["p", "div", "ul", "ol", "table"])
        if kind == "p":
            return kind, text()
        if kind == "div":
            return kind, [block(depth + 1) for _ in range(rnd.randint(1, 3))] if depth < 3 else [("p", text())]
        if kind in ("ul", "ol"):
            deeper = lambda: block(depth + 1, True) if depth < 3 and rnd.random() < 0.3 else None
            return kind, [(text(), deeper()) for _ in range(rnd.randint(1, 4))]
        return kind, [[text() for _ in range(rnd.randint(1, 4))] for _ in range(rnd.randint(1, 4))]

    for _ in range(400):
        blocks = [block(0) for _ in range(rnd.randint(1, 5))]
        lines = []
        for line in (line for b in blocks for line in layout(b)):
            if line is not None or (lines and lines[-1] != ""):
                lines.append(line or "")
        expected = "\n".join(lines).strip("\n")
        source = "".join(markup(b, rnd) for b in blocks)
        assert html.render(source)[0] == expected, source


def test_broken_pages_end():
    for source in ("<div>" * 20000 + "x", "<table><tr><td>" * 2000 + "x", '<b a="x' * 2000, "<ul><li>" * 2000 + "x", "<" * 5000):
        html.render(source)


def test_pages(spark):
    rows = [(1, "<title>A  b</title>x", "u"), (1, "<title>A  b</title>x", "u"), (2, None, "u"), (None, "<p>y\n<p>z", "u")]
    given = spark.createDataFrame(rows, "page_id long, html string, title string")
    found = sorted((tuple(r) for r in html.extract(given).collect()), key=str)
    assert found == sorted([(1, "A b", "x", 1, 1)] * 2 + [(2, None, "", 0, 0), (None, None, "y\n\nz", 4, 3)], key=str)
    assert html.extract(given.where("false")).count() == 0


def license_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_licenses(spark, corpus):
    rnd = random.Random(8)
    some = ["GNU General Public License", "MIT-license", "cc BY", "the apache.license", "mit", "license", "x y", "cc", "by",
            "gnu general public", "Kelvin", "É"]
    rows = [(i, t) for i, t, *_ in corpus]
    rows += [(100 + i, " ".join(rnd.choices(some, k=rnd.randint(1, 30)))) for i in range(60)] + [(None, "cc by cc by"), (100, "mit license")]
    given = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    found = sorted((tuple(r)[:6] for r in licenses.scan(given).drop("labels", "score", "spans").collect()), key=str)
    expected = []
    for doc_id, text in rows:
        w = license_words(text)
        at = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w))
              if w[i : i + len(phrase.split())] == phrase.split()]
        expected.append((doc_id, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None,
                         ",".join(sorted({label for _, label in at}))))
    assert found == sorted(expected, key=str)
    assert licenses.scan(given.where("false")).count() == 0


def test_notices_are_found_with_small_changes(spark):
    notice = next(k for k, v in licenses.NOTICES.items() if v == "mit-notice").split()
    changed = ["word"] * 5 + [w for i, w in enumerate(notice) if i not in (6, 12)] + ["tail"]
    inserted = notice[:8] + ["very"] + notice[8:]
    texts = [(0, " ".join(changed)), (1, " ".join(inserted)), (2, " ".join(notice[:8])), (3, " ".join(notice))]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [found[i].labels for i in range(4)] == ["mit-notice", "mit-notice", "", "mit-notice"]
    assert found[3].score == 1.0 and found[2].score == 0.0 and 0.8 <= found[0].score < 1
    assert (found[0].spans[0].start, found[3].spans[0].stop) == (5, len(notice))


def test_scattered_words_are_voted_down(spark, monkeypatch):
    notice = next(k for k, v in licenses.NOTICES.items() if v == "mit-notice").split()
    # One triple and two of every three words stand on the diagonal.
    scattered = [w if i < 3 or i % 3 else "other" for i, w in enumerate(notice)]
    texts = [(0, " ".join(scattered)), (1, " ".join(notice)), (2, "// SPDX-License-Identifier: BSD-3-Clause\ncode")]
    given = spark.createDataFrame(texts, "doc_id long, text string")
    scan = lambda: {r.doc_id: r for r in licenses.scan(given, covered=0.6).collect()}
    found = scan()
    assert [found[i].labels for i in range(3)] == ["", "mit-notice", "bsd-3-clause"]
    assert found[2].n_base == 0 and found[2].base_labels == ""
    # Without the votes the first text would be taken by its words alone.
    monkeypatch.setattr(licenses, "VOTES", 0.0)
    assert scan()[0].labels == "mit-notice"


def test_whole_license_texts_from_files(spark, tmp_path):
    import random

    rnd = random.Random(9)
    clauses = [f"clause{i} " + " ".join(f"w{rnd.randrange(900)}" for _ in range(12)) for i in range(60)]
    (tmp_path / "Long-1.0.txt").write_text("\n".join(clauses))
    (tmp_path / "tiny.txt").write_text("no words")
    given = licenses.read_templates(spark, str(tmp_path))
    assert [(t.label, len(t.words)) for t in given] == [("Long-1.0", 780)]
    edited = [c for i, c in enumerate(clauses) if i % 20]
    texts = [(0, "intro " * 30 + "\n".join(edited)), (1, "\n".join(clauses[:20]))]
    found = {r.doc_id: r for r in licenses.scan(
        spark.createDataFrame(texts, "doc_id long, text string"), given, shift=13).collect()}
    assert found[0].labels == "Long-1.0" and found[0].spans[0].start == 30 and found[0].score > 0.9
    assert found[1].labels == ""


def base_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)} if len(words) < 2000 else None
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            None if covered is None else len(covered))


def test_quality(spark, documents, corpus):
    rows = {r.doc_id: r for r in quality.assess(documents).collect()}
    assert len(rows) == len(corpus)
    for doc_id, text, *_ in corpus:
        r, expected = rows[doc_id], base_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == expected[:4]
        if expected[4] is not None:
            assert r.n_repeat_words == expected[4]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert rows[10].kept and rows[12].kept and not rows[0].kept and not rows[19].kept


def test_the_verdict_can_be_filtered_and_rows_carried(spark, documents):
    kept = quality.assess(documents, keep=["source", "text"]).where("kept")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.assess(documents).collect() if r.kept}
    assert "text" in kept.columns
    assert quality.assess(documents.where("false")).count() == 0


def test_no_rule_order_changes_the_verdict(spark, documents):
    backwards = quality.assess(documents, rules=quality.RULES[::-1], sample_rows=5)
    assert sorted(map(tuple, backwards.collect())) == sorted(map(tuple, quality.assess(documents).collect()))


def test_dialogues(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Yo <|end|>"), (1, 3, "ann", None), (1, 3, "ann", None),
            (2, 0, "system", "alone"), (None, None, None, "?"), (3, 70, "a|b", "late")]
    given = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn int, role string, text string, speaker int")
    found = {(r.conv_id, r.speaker): r for r in chat.rotate(given).collect()}
    assert set(found) == {(1, "ann"), (1, "bob"), (2, None), (None, "unknown"), (3, "a_b")}
    ann = found[1, "ann"]
    assert ann.text == ("<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi<|end|>\n<|user:bob|>\nYo < |end|><|end|>\n"
                        "<|assistant|>\n<|end|>\n")
    assert [ann.text[s.start : s.stop] for s in ann.spans] == ["Hi<|end|>\n", "<|end|>\n"]
    assert (ann.n_messages, ann.n_rows, ann.n_learn) == (4, 5, 18)
    bob = found[1, "bob"]
    assert [bob.text[s.start : s.stop] for s in bob.spans] == ["Yo < |end|><|end|>\n"] and "<|user:ann|>" in bob.text
    assert found[2, None].spans == [] and {r.segment for r in found.values()} == {0} and {r.opening for r in found.values()} == {""}
    assert chat.rotate(given.where("false")).count() == 0


def plain_dialogue(messages, speaker):
    """A whole dialogue from one side, and the spans to learn from."""
    text, spans = "", []
    for _, role, said in messages:
        text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == speaker else f"<|user:{role}|>\n"
        if role == speaker:
            spans.append((len(text), len(text) + len(said) + len("<|end|>\n")))
        text += said + "<|end|>\n"
    return text, spans


def test_long_dialogues_are_whole_from_every_side(spark, monkeypatch):
    import random

    monkeypatch.setattr(chat, "TOGETHER", 3)
    rnd = random.Random(1)
    long = [(i, rnd.choice(["ann", "system", "ann", "cy"]), f"m{rnd.random()}") for i in range(300)]
    long = [(0, "system", "Be kind."), *long[1:], *[(299, "bob", f"late {i}") for i in range(40)]]
    crowd = [(5, rnd.choice("uvw"), f"x{rnd.random()}") for _ in range(500)] + [(4, "v", "before"), (7, "z", "after")]
    talks = {1: long, None: crowd, 3: [(0, "system", "alone")] * 3}
    rows = [(c, *m, 1, 2) for c, messages in talks.items() for m in messages]
    given = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, segment int, place int").repartition(5)
    found = chat.rotate(given, segment=16).collect()
    assert max(r.n_messages for r in found) == 16
    for conv, messages in talks.items():
        ordered = sorted(set(messages))
        speakers = {role for _, role, _ in messages} - {"system"} or {None}
        assert {r.speaker for r in found if r.conv_id == conv} == speakers
        opening = "".join(f"<|system|>\n{said}<|end|>\n" for _, role, said in ordered[:16] if role == "system")
        for speaker in speakers:
            own = sorted((r for r in found if (r.conv_id, r.speaker) == (conv, speaker)), key=lambda r: r.segment)
            text, spans = plain_dialogue(ordered, speaker)
            assert "".join(r.text for r in own) == text
            assert [(r.offset + s.start, r.offset + s.stop) for r in own for s in r.spans] == spans
            assert [r.segment for r in own] == list(range(-(-len(ordered) // 16)))
            assert [r.opening for r in own] == ["", *[opening] * (len(own) - 1)]
            assert sum(r.n_rows for r in own) == len(messages)


def test_pipeline(spark, documents, corpus):
    import corpus_pipeline as pipeline

    docs, kept = documents, {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == documents.columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    rules, near, cut = kept.values()
    assert set(rules) == {r.doc_id for r in quality.assess(documents).collect() if r.kept}
    assert 7 in near and not {8, 9} & set(near) and set(near) <= set(rules)
    assert set(cut) == set(near) and cut[12] == near[12] and len(cut[10]) < len(near[10])
    packed = pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == set(cut) and all(len(r.ids) == r.length for r in packed)


def test_stages_keep_the_columns_they_are_given(spark, documents):
    import corpus_pipeline as pipeline

    more = documents.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(1))
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, more, "").columns == more.columns


def test_pipeline_keeps_one_copy_whatever_the_ids(spark):
    import random

    import corpus_pipeline as pipeline

    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choices("aeinrstdl", k=rnd.randint(3, 7))) for _ in range(900)]
    first, second, third, fourth = (" ".join(rnd.sample(vocabulary, 150)) + "." for _ in range(4))
    rows = [(None, first), (4, first), (None, first), (None, second), (None, second), (6, third), (6, fourth), (6, third)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema).repartition(3)
    expected = sorted([(4, first), (None, second), (6, third), (6, fourth)], key=str)
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        if name != "quality rules":
            assert sorted([(r.doc_id, r.text) for r in docs.collect()], key=str) == expected
    packed = pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted({str(r.doc_id) for r in packed}) == ["4", "6", "None"]
    assert sum(r.length for r in packed if r.start == 0) > 0 and sum(r.start == 0 for r in packed) == 4
