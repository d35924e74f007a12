"""Quality rules as a short-circuit cascade of column expressions.

Counts that the rules share are computed once per text. The rules themselves are ordered by what
they reject per unit of cost, both estimated on a bounded sample, and evaluated as one ``CASE``
chain, so that a text leaves the cascade at the first rule that rejects it. The order affects the
time only: a text is kept if no rule rejects it, in whatever order they are asked.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import cut_lineage

SPACES = " \t\n\x0b\f\r"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Bound of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 500
#: Longer texts are left out of the sample (and of nothing else).
LONGEST_SAMPLED = 100_000


@dataclass(frozen=True)
class Rule:
    """A named condition under which a text is rejected, on the columns of ``measured``."""

    name: str
    rejects: Callable[[], Column]


def _letters(words: str) -> Column:
    """Words with at least two letters in a row."""
    return F.size(F.filter(words, lambda w: w.rlike(r"\p{L}\p{L}")))


RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda: F.col("n_symbols") * 4 > F.col("n_words")),
    Rule("duplicate_lines", lambda: F.col("n_dup_lines") * 100 > F.col("n_lines") * 50),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words"))
         | (F.col("word_chars") > 25 * F.col("n_words"))),
    Rule("shouting", lambda: F.length(F.regexp_replace("text_", r"\P{Lu}+", "")) * 100
         > F.col("word_chars") * 60),
    Rule("few_words_with_letters", lambda: _letters("words") * 100 < F.col("n_words") * 50),
    Rule("one_word", lambda: F.size(F.array_distinct("words")) * 50 < F.least("n_words", F.lit(1000))),
)


def measured(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The base counts of each text, next to ``text_`` and ``words``."""
    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    given = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text_"), *kept)
    trimmed = F.btrim("text_", F.lit(SPACES))
    split = given.withColumn(
        "words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    ).withColumn("lines", F.filter(F.split("text_", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    counted = split.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        sum((F.length("text_") - F.length(F.replace("text_", F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0))
        .cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    ).drop("lines")
    windows = F.when(
        F.col("n_words") > WINDOW,
        F.transform(
            F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int")),
            lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)),
        ),
    )
    return repeated(counted.withColumn("windows", windows).drop("hashes"))


def repeated(windowed: DataFrame) -> DataFrame:
    """``n_repeat_words``: words in windows that a text holds twice or more.

    Only texts with an equal pair of windows sort them; then equal ones stand side by side, and
    the words that their start positions cover are added up.
    """
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.when(
        again, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    sorted_ = windowed.withColumn("pairs", pairs).drop("windows")
    twice = F.filter(
        F.transform(
            "pairs",
            lambda x, i: F.when(
                (F.get("pairs", i - 1)["h"] == x["h"]) | (F.get("pairs", i + 1)["h"] == x["h"]), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    starts = sorted_.withColumn("starts", F.array_sort(twice)).drop("pairs")
    covered = F.aggregate(
        F.transform("starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b,
    )
    return starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def estimated_order(documents: DataFrame, rules: Sequence[Rule], rows: int, text: str = "text") -> list[Rule]:
    """Rules by rejected share per second, most first, as measured on ``rows`` rows at most."""
    spark = documents.sparkSession
    texts = documents.select(F.col(text).alias("text"))
    spread = texts.where((F.pmod(F.xxhash64("text"), F.lit(16)) == 0) & (F.length("text") <= LONGEST_SAMPLED))
    # Spark takes rows from as few partitions as it needs.
    taken = spark.createDataFrame([(0, r.text) for r in spread.take(rows)], "doc_id int, text string")
    sample = cut_lineage(measured(taken).drop("doc_id"), "quality-sample")

    def timed(condition: Column) -> tuple[float, int]:
        started = time.perf_counter()
        n = sample.agg(F.count_if(condition)).first()[0]
        return time.perf_counter() - started, n

    timed(F.lit(False))
    floor = min(timed(F.lit(False))[0] for _ in range(2))
    gains = []
    for place, rule in enumerate(rules):
        took, n = timed(rule.rejects())
        gains.append((-(n + 1) / max(took - floor, 0.001), place))
    return [rules[place] for _, place in sorted(gains)]


def assess(
    documents: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS,
    doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = (),
) -> DataFrame:
    """Counts and verdict for every text.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long),
    ``base_failed`` and ``kept``, one row for every input row, and the columns named in ``keep``
    after them. A null text has no words and fails the base rule, as an empty one does. A null
    doc_id stays null; other columns are left out.
    """
    order = estimated_order(documents, rules, sample_rows, text)
    cascade = F.when(base_failed(), F.lit(False))
    for rule in order:
        cascade = cascade.when(rule.rejects(), F.lit(False))
    return measured(documents, doc_id, text, keep).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        # Always true, and not deterministic for the optimizer: a filter on the verdict must not be
        # pushed below the columns it is made of, as each array would be built anew for each element.
        (cascade.otherwise(F.lit(True)) & (F.monotonically_increasing_id() >= 0)).alias("kept"),
        *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)],
    )
