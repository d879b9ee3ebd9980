"""The registered corpus queries and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.llm import (
    centroids,
    decontaminate,
    html_text,
    importance,
    language,
    licenses,
    lm_scores,
    near_dedup,
    packing,
    part_codes,
    pieces,
    quality_rules,
    secret_scan,
)
from asofkit.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids")


ORACLES["op7_decontaminate"] = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
items AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
item_windows AS (
  SELECT item_id, least(len(words), 13) AS n, unnest(list_transform(range(0, greatest(len(words) - 12, 1)),
    lambda i: array_to_string(words[i + 1:i + least(len(words), 13)], ' '))) AS w FROM items WHERE len(words) > 0),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, unnest(range(0, len(words) - n + 1)) AS s,
    unnest(list_transform(range(0, len(words) - n + 1), lambda i: array_to_string(words[i + 1:i + n], ' '))) AS w
  FROM docs, lengths WHERE len(words) >= n),
hits AS (SELECT doc_id, s, d.n, item_id FROM doc_windows d JOIN item_windows i ON d.w = i.w AND d.n = i.n),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents")).drop("row_key", "all_spans")


@query
def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


@query
def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.scores(table(spark, sf_dir, "documents"))


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


@query
def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.sampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = part_codes.compressed(table(spark, sf_dir, "embeddings"))
    return part_codes.with_label_error(codes, books)


def part_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, width: int = 8, factor: int = 4096) -> str:
    """The same rounds as plain comparisons, one step of the query per round."""
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS r, * FROM (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {parts * width}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
        f"""points AS MATERIALIZED (SELECT r, vec_id, label, p, list_transform(embedding[p * {width} + 1:(p + 1) * {width}],
    lambda x: floor({factor} * x::DOUBLE)::BIGINT) AS v FROM kept, range({parts}) t(p))""",
        f"""books0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id NULLS LAST, v) - 1 AS e, v AS c
    FROM points WHERE r IN (SELECT r FROM kept ORDER BY vec_id NULLS LAST, embedding LIMIT {entries}))""",
    ]
    square = " + ".join(f"(v[{j}] - c[{j}]) * (v[{j}] - c[{j}])" for j in range(1, width + 1))
    mean = ", ".join(f"((s{j} - ((s{j} % n) + n) % n) // n)::BIGINT" for j in range(1, width + 1))
    sums = ", ".join(f"sum(v[{j}]) AS s{j}" for j in range(1, width + 1))
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT r, vec_id, label, p, any_value(v) AS v, min({square}) AS d, arg_min(e, ({square}) * 256 + e) AS e
    FROM points JOIN books{k} USING (p) GROUP BY r, vec_id, label, p)""")
        if k < rounds:
            steps.append(f"""books{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM books{k} LEFT JOIN
    (SELECT p, e, [{mean}] AS m FROM (SELECT p, e, count(*) AS n, {sums} FROM near{k} GROUP BY p, e)) USING (p, e))""")
    steps.append(f"""coded AS (SELECT r, vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
    FROM near{rounds} GROUP BY r, vec_id, label)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM books{rounds}) AS codebooks_sha256
FROM coded"""


ORACLES["op11_part_codes"] = part_codes_sql()


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def centroids_sql(clusters: int = 40, rounds: int = 5, dim: int = 64, factor: int = 256, seed: str = "2") -> str:
    """The same rounds as plain comparisons of all vectors with all centroids."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({factor} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""centroids0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS w FROM
    (SELECT v, sha256('{seed}:' || vec_id) AS h FROM kept ORDER BY h, v LIMIT {clusters}))""",
    ]
    square = " + ".join(f"(v[{j}] - w[{j}]) * (v[{j}] - w[{j}])" for j in range(1, dim + 1))
    mean = ", ".join(f"((s{j} - ((s{j} % n) + n) % n) // n)::BIGINT" for j in range(1, dim + 1))
    sums = ", ".join(f"sum(v[{j}]) AS s{j}" for j in range(1, dim + 1))
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT r, vec_id, any_value(v) AS v, min(d) AS d, arg_min(c, d * 1024 + c) AS c
    FROM (SELECT r, vec_id, v, c, {square} AS d FROM kept, centroids{k}) GROUP BY r, vec_id)""")
        if k < rounds:
            steps.append(f"""centroids{k + 1} AS MATERIALIZED (SELECT c, coalesce(m, w) AS w FROM centroids{k} LEFT JOIN
    (SELECT c, [{mean}] AS m FROM (SELECT c, count(*) AS n, {sums} FROM near{k} GROUP BY c)) USING (c))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM near{rounds} JOIN centroids{rounds} USING (c)"""


ORACLES["op12_centroids"] = centroids_sql()


@query
def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encoded(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
