"""License scans by diagonal voting.

Every rolling pair or triple of words of every text is joined to the places where license templates
have it. A hit votes for the diagonal ``place in text - place in template``; votes are counted by
diagonal, neighbouring diagonals are merged, so that a few inserted or missing words do no harm, and
only spans with enough votes are verified: they count once enough of the template's words are in them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that must be found wherever their words stand consecutively.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening words of public license notices.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu"
    " general public license as published by the free software foundation": "gpl-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and"
    " associated documentation files": "mit-notice",
    "redistribution and use in source and binary forms with or without modification are permitted"
    " provided that the following conditions are met": "bsd-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Tags that files carry instead of a notice; found like phrases.
TAGS = {
    "spdx license identifier mit": "mit",
    "spdx license identifier isc": "isc",
    "spdx license identifier apache 2 0": "apache-2.0",
    "spdx license identifier bsd 2 clause": "bsd-2-clause",
    "spdx license identifier bsd 3 clause": "bsd-3-clause",
    "spdx license identifier mpl 2 0": "mpl-2.0",
    "spdx license identifier gpl 2 0": "gpl-2.0",
    "spdx license identifier gpl 3 0": "gpl-3.0",
    "spdx license identifier lgpl 2 1": "lgpl-2.1",
    "spdx license identifier agpl 3 0": "agpl-3.0",
    "spdx license identifier cc by 4 0": "cc-by-4.0",
    "spdx license identifier cc0 1 0": "cc0-1.0",
    "spdx license identifier unlicense": "unlicense",
}
#: Share of a notice's words that a span must have, and of its triples of words that must vote for it.
COVERED, VOTES = 0.8, 0.3
#: Diagonals this far apart are still one span.
SHIFT = 2
#: Words of templates that may be broadcast.
MOST_WORDS = 100_000


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    exact: bool
    base: bool = False

    @property
    def grams(self) -> int:
        return len(self.words) - (1 if self.exact else 2)

    @property
    def votes(self) -> int:
        """How many grams must agree before a span is looked at."""
        return self.grams if self.exact else max(1, math.ceil(VOTES * self.grams))


def templates(
    phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, tags: dict[str, str] = TAGS
) -> list[Template]:
    groups = ((phrases, True, True), (tags, True, False), (notices, False, False))
    return [
        Template(tuple(text.split()), label, exact, base) for group, exact, base in groups for text, label in group.items()
    ]


def words_of(text: Column | str) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A to Z lower-cased."""
    text = F.col(text) if isinstance(text, str) else text
    # The Kelvin sign is the one character beyond ASCII that would become an ASCII letter.
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def read_templates(spark: SparkSession, path: str, names: str = "*") -> list[Template]:
    """Whole license texts as templates, one file each, labelled by file name without its ending.

    Texts of fewer than three words are left out.
    """
    files = spark.read.option("pathGlobFilter", names).text(path, wholetext=True)
    label = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[a-z]+$", "")
    rows = files.select(label.alias("label"), words_of("value").alias("words")).where(F.size("words") > 2)
    if (rows.agg(F.sum(F.size("words"))).first()[0] or 0) > MOST_WORDS:
        raise ValueError("too many templates to broadcast")
    return [Template(tuple(r["words"]), r["label"], False) for r in rows.orderBy("label").collect()]


def _places(spark: SparkSession, given: Sequence[Template]) -> tuple[DataFrame, DataFrame]:
    """Pairs of neighbouring words of templates, notices ask for the third word as well; and the templates."""
    if any(t.grams < 1 for t in given):
        raise ValueError("a phrase has two words at least, a notice three")
    if sum(len(t.words) for t in given) > MOST_WORDS:
        raise ValueError("too many templates to broadcast")
    rows, heads = [], []
    for number, t in enumerate(given):
        heads.append((number, t.label, t.exact, t.base, list(t.words), t.votes))
        grams = zip(t.words, t.words[1:], t.words[2:] if not t.exact else [None] * len(t.words), strict=False)
        rows += [(number, len(t.words), place, a, b, c) for place, (a, b, c) in enumerate(grams)]
    places = spark.createDataFrame(rows, "template int, t_size int, t_place int, a string, b string, c string")
    known = spark.createDataFrame(
        heads, "template int, label string, exact boolean, base boolean, t_words array<string>, needed int")
    return places.withColumn("t_hash", F.xxhash64("a", "b")), known


def scan(
    documents: DataFrame, given: Sequence[Template] | None = None, covered: float = COVERED, shift: int = SHIFT,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Licenses named or quoted in each text; one row for every input row.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``, and
    ``spans``: ``label, start, stop`` in words, and ``share`` of the template that was verified.
    Words are runs of digits, letters and characters beyond ASCII, with A to Z lower-cased; phrases
    and tags match exactly, notices by ``covered`` of their words if enough of their triples vote for
    the span. Labels are distinct and sorted; ``score`` is the highest share, 0 without a span. A null
    or empty text has no words; a null doc_id stays null; repeated rows are scanned each; other
    columns are left out.
    """
    spark = documents.sparkSession
    given = templates() if given is None else list(given)
    places, known = _places(spark, given)
    texts = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words_of(text).alias("words"))
    most = F.size("words")
    grams = texts.select(
        "row", "doc_id", "words", most.cast("long").alias("n_words"),
        F.posexplode_outer(F.arrays_zip(
            F.col("words").alias("a"), F.slice("words", 2, most).alias("b"), F.slice("words", 3, most).alias("c")
        )).alias("place", "gram"),
    ).select("row", "doc_id", "words", "n_words", "place", *[F.col("gram")[x].alias(f"w_{x}") for x in "abc"])
    hits = grams.join(
        F.broadcast(places),
        (F.xxhash64("w_a", "w_b") == F.col("t_hash")) & (F.col("w_a") == F.col("a")) & (F.col("w_b") == F.col("b"))
        & (F.col("c").isNull() | (F.col("c") == F.col("w_c"))),
        "left",
    )
    # One row for each text goes along, so that none is lost. A hit brings the words that its diagonal lays
    # beside the template.
    begin = F.greatest(F.col("place") - F.col("t_place"), F.lit(0))
    kept = hits.where(F.col("template").isNotNull() | (F.coalesce("place", F.lit(0)) == 0)).select(
        "row", "doc_id", "n_words", "template", (F.col("place") - F.col("t_place")).alias("diagonal"),
        F.slice("words", begin + 1, F.col("t_size")).alias("beside"),
    )
    diagonals = kept.repartition("row").groupBy("row", "doc_id", "n_words", "template", "diagonal").agg(
        F.count("*").alias("votes"), F.first("beside").alias("beside")
    ).join(F.broadcast(known), "template", "left")
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(along) > shift)
    numbered = diagonals.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "span", F.sum("apart").over(along)
    )
    voted = numbered.withColumn("votes", F.sum("votes").over(Window.partitionBy("row", "template", "span")))
    begin = F.greatest("diagonal", F.lit(0))
    verified = F.filter(
        F.sequence(F.lit(0), F.size("t_words") - 1),
        lambda i: (i + F.col("diagonal") >= 0) & (F.get("t_words", i) == F.get("beside", i + F.col("diagonal") - begin)),
    )
    # Spans without enough votes stay without words, as their text needs a row.
    agree = F.when(F.col("votes") >= F.col("needed"), verified).otherwise(F.array().cast("array<int>"))
    words = F.array_distinct(F.flatten(F.collect_list("agree")))
    spans = voted.withColumn("agree", agree).groupBy(
        "row", "doc_id", "n_words", "template", "label", "exact", "base", F.size("t_words").alias("t_size"), "span"
    ).agg(
        F.size(words).alias("n_agree"), F.min(F.col("diagonal") + F.array_min("agree")).cast("long").alias("start"),
        F.max(F.col("diagonal") + F.array_max("agree") + 1).cast("long").alias("stop"),
    )
    share = F.col("n_agree") / F.col("t_size")
    good = F.when(F.col("exact"), F.col("n_agree") == F.col("t_size")).otherwise(share >= covered)
    base = good & F.col("base")
    return (
        spans.groupBy("row", "doc_id", "n_words").agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.when(good, F.col("label")))), ",").alias("labels"),
            F.coalesce(F.max(F.when(good, share)), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(good, F.struct("start", "stop", "label", share.alias("share")))))
            .alias("spans"),
        ).drop("row")
    )
