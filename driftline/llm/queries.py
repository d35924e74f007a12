"""The registered queries of this package on the driver tables, each with its SQL if there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import (
    bpe, centroids, chat, html, licenses, minhash, novelty, packing, quality, suffix, token_counts, topk, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document, and of the bytes decoded from them."""
    return bpe.round_trip(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
    )


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


@query(r"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND NOT (n_symbols * 4 > n_words)
  AND NOT (n_dup_lines * 100 > n_lines * 50)
  AND NOT (word_chars < 2 * n_words OR word_chars > 25 * n_words)
  AND NOT (n_capitals * 100 > word_chars * 60)
  AND NOT (n_lettered * 100 < n_words * 50)
  AND NOT (n_different * 50 < least(n_words, 1000)) AS kept
FROM (
  SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed
  FROM (
    SELECT doc_id, len(words) AS n_words, coalesce(list_sum([length(w) for w in words]), 0)::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
      length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS n_capitals,
      len([w for w in words if regexp_matches(w, '\p{L}\p{L}')]) AS n_lettered,
      len(list_distinct(words)) AS n_different,
      coalesce(r.n, 0) AS n_repeat_words
    FROM (
      SELECT doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        [l for l in string_split(coalesce(text, ''), chr(10)) if regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines
      FROM documents) d
    LEFT JOIN (
      SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (
        SELECT doc_id, unnest(range(s, s + 8)) AS p FROM (
          SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, w) AS c FROM (
            SELECT doc_id, unnest(range(1, len(words) - 6)) AS s,
              unnest([array_to_string(words[i:i + 7], ' ') for i in range(1, len(words) - 6)]) AS w
            FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents)))
        WHERE c > 1) GROUP BY doc_id) r USING (doc_id)))
""")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdict of every document."""
    return quality.assess(table(spark, sf_dir, "documents"))


@query(r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(regexp_replace(role, '[<|>\n]', '_', 'g'), 'unknown') AS role,
    replace(coalesce(text, ''), '<|', '< |') AS text, count(*) AS copies
  FROM conversations GROUP BY ALL),
speakers AS (
  SELECT conv_id, role AS speaker FROM m WHERE role <> 'system' GROUP BY ALL
  UNION ALL SELECT conv_id, NULL FROM m GROUP BY ALL HAVING count(*) FILTER (WHERE role <> 'system') = 0),
s AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1) // 64 AS segment FROM m),
openings AS (
  SELECT conv_id, string_agg('<|system|>' || chr(10) || text || '<|end|>' || chr(10), ''
    ORDER BY turn NULLS FIRST, role, text) AS opening
  FROM s WHERE segment = 0 AND role = 'system' GROUP BY conv_id),
pieces AS (
  SELECT s.*, p.speaker, coalesce(role = p.speaker, false) AS learn,
    CASE WHEN role = 'system' THEN '<|system|>' WHEN role = p.speaker THEN '<|assistant|>'
      ELSE '<|user:' || role || '|>' END || chr(10) AS head,
    text || '<|end|>' || chr(10) AS body
  FROM s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker
    ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS began FROM pieces),
sides AS (SELECT *, min(began) OVER (PARTITION BY conv_id, speaker, segment) AS "offset" FROM placed)
SELECT d.conv_id, speaker, segment, "offset", count(*) AS n_messages, sum(copies)::BIGINT AS n_rows,
  CASE WHEN segment > 0 THEN coalesce(opening, '') ELSE '' END AS opening,
  string_agg(head || body, '' ORDER BY began) AS text,
  coalesce(string_agg((began - "offset" + length(head)) || '-' || (began - "offset" + length(head) + length(body)), ','
    ORDER BY began) FILTER (WHERE learn), '') AS spans,
  coalesce(sum(length(body)) FILTER (WHERE learn), 0)::BIGINT AS n_learn
FROM sides d LEFT JOIN openings o ON d.conv_id IS NOT DISTINCT FROM o.conv_id
GROUP BY d.conv_id, speaker, segment, "offset", opening
""")
def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from every speaker's side."""
    sides = chat.rotate(table(spark, sf_dir, "conversations"))
    as_text = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
    return sides.withColumn("spans", as_text)


@query("""
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def _template_rows() -> str:
    return ", ".join(
        f"({n}, '{t.label}', {t.exact}, {t.base}, {t.votes}, string_split('{' '.join(t.words)}', ' '))"
        for n, t in enumerate(licenses.templates())
    )


@query(r"""
WITH t(template, label, exact, base, needed, t_words) AS (VALUES """ + _template_rows() + r"""),
places AS (
  SELECT template, i - 1 AS t_place, t_words[i] AS a, t_words[i + 1] AS b, CASE WHEN NOT exact THEN t_words[i + 2] END AS c
  FROM (SELECT *, unnest(range(1, len(t_words) + CASE WHEN exact THEN 0 ELSE -1 END)) AS i FROM t)),
d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
grams AS (
  SELECT doc_id, words, i - 1 AS place, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT *, unnest(range(1, len(words))) AS i FROM d WHERE len(words) > 1)),
diagonals AS (
  SELECT doc_id, words, template, place - t_place AS diagonal, count(*) AS votes
  FROM grams g JOIN places p ON g.a = p.a AND g.b = p.b AND (p.c IS NULL OR p.c = g.c) GROUP BY ALL),
apart AS (
  SELECT g.*, label, exact, base, needed, t_words,
    CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER w > 2, true) THEN 1 ELSE 0 END AS n
  FROM diagonals g JOIN t USING (template) WINDOW w AS (PARTITION BY doc_id, g.template ORDER BY diagonal)),
numbered AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM apart),
voted AS (
  SELECT *, unnest(range(0, len(t_words))) AS i FROM (
    SELECT * FROM numbered QUALIFY sum(votes) OVER (PARTITION BY doc_id, template, span) >= needed)),
spans AS (
  SELECT doc_id, label, base, exact, count(DISTINCT i) / len(t_words) AS share, min(diagonal + i) AS start
  FROM voted WHERE i + diagonal >= 0 AND i + diagonal < len(words) AND t_words[i + 1] = words[i + diagonal + 1]
  GROUP BY doc_id, template, label, base, exact, t_words, span),
good AS (SELECT * FROM spans WHERE share >= CASE WHEN exact THEN 1 ELSE 0.8 END)
SELECT d.doc_id, len(d.words) AS n_words, count(g.label) FILTER (WHERE base) AS n_base,
  min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0) AS score
FROM d LEFT JOIN good g USING (doc_id) GROUP BY d.doc_id, d.words
""")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named or quoted in every document."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


@query()
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


@query()
def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.link(table(spark, sf_dir, "documents"))


@query()
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents lose to strings of 400 bytes that occur elsewhere; then, to those of a passage's length."""
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"), passage=suffix.PASSAGE)
    return found.drop("kept")  # ``text`` holds the same


@query()
def op11_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by pattern and by novelty in every document."""
    found = novelty.scan(table(spark, sf_dir, "documents"))

    def written(spans) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != novelty.NOVEL)
    return found.withColumns({
        "base_sha256": F.sha2(written(base).cast("binary"), 256), "spans": written(F.col("spans")),
    })


@query()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on 16 whitened components, with the fit's exact and floating checks."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def _cluster_rounds(rounds: int) -> str:
    return "".join(f""",
a{i} AS MATERIALIZED (
  SELECT r, min({{'d': list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), 'k': k}}) AS m
  FROM v, c{i} GROUP BY r),
c{i + 1} AS MATERIALIZED (
  SELECT k, coalesce(moved, c) AS c FROM c{i} LEFT JOIN (
    SELECT k, list(f ORDER BY place) AS moved FROM (
      SELECT m.k AS k, place, floor(sum(e) / count(*)) AS f
      FROM (SELECT r, m, unnest(x) AS e, generate_subscripts(x, 1) AS place FROM a{i} JOIN v USING (r)) GROUP BY ALL)
    GROUP BY k) USING (k))""" for i in range(rounds))


@query("""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor(1024 * e::DOUBLE) for e in embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([1 for e in embedding if e IS NULL OR NOT isfinite(e)]) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS k, x AS c
  FROM (SELECT x, sha256('3:' || vec_id) AS h FROM v) ORDER BY h NULLS LAST, x LIMIT 8)""" + _cluster_rounds(10) + """,
last AS (
  SELECT r, min({'d': list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), 'k': k}) AS m
  FROM v, c10 GROUP BY r)
SELECT vec_id, m.k::INT AS cluster, m.d::BIGINT AS distance,
  (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string([e::BIGINT for e in c], ',')) AS centroid_sha256
FROM last JOIN v USING (r) JOIN c10 ON c10.k = last.m.k
""")
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings after ten rounds."""
    return centroids.with_digests(centroids.cluster(table(spark, sf_dir, "embeddings")))
