"""Registered queries of the operators over the whole given tables, with DuckDB twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstrata.llm import codes, extraction, forest, labelled, lexicon, packing, pii, quality, simhash, substrings, tiles, tokencount, toxicity, vafile
from gridstrata.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.token_counts(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("rest.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op2_substring_dedup"] = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, s AS start, array_to_string(words[s:s + 19], ' ') AS k
  FROM texts, unnest(range(1, len(words) - 18)) AS t(s)),
repeated AS (
  SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY k ORDER BY doc_id, start) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, start + i AS pos FROM repeated, range(20) AS r(i)),
words AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts),
kept AS (
  SELECT w.doc_id, count(g.pos) AS n_removed, string_agg(w.word, ' ' ORDER BY w.pos) FILTER (WHERE g.pos IS NULL) AS kept
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY w.doc_id)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, table(spark, sf_dir, "labels")).select(F.col("row.doc_id").alias("doc_id"), "score")
    predicted = (F.col("score") >= quality.CUT).cast("int").alias("predicted")
    return scored.select("doc_id", labelled.held_out(quality.FOLDS, quality.LEFT).alias("held_out"), "score", predicted)


@query
def op4_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    fingerprint = F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint")
    return found.select("doc_id", fingerprint, "component_id")


@query
def op5_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("rest.doc_id", "text", "pii", F.size("pii").alias("n_pii"))


@query
def op6_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.neighbours(table(spark, sf_dir, "embeddings"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op8_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op8_int8_tiles"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x,
         coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
                  AND len(list_filter(embedding, lambda c: c <> 0)) > 0, false) AS usable
  FROM embeddings),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a, v b
  WHERE a.vec_id <> b.vec_id AND a.usable AND b.usable AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id, vec_id AS node FROM v UNION SELECT r.vec_id, l.v FROM reach r JOIN links l ON r.node = l.u),
least AS (SELECT vec_id, min(node) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, l.component_id, l.component_id = v.vec_id AS kept
FROM v JOIN least l ON v.vec_id = l.vec_id LEFT JOIN n ON n.u = v.vec_id
"""


@query
def op9_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = lexicon.round_trip(table(spark, sf_dir, "documents"))
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, table(spark, sf_dir, "labels")).select(F.col("row.doc_id").alias("doc_id"), "score")
    predicted = (F.col("score") >= toxicity.CUT).cast("int").alias("predicted")
    return scored.select("doc_id", labelled.held_out(toxicity.FOLDS, toxicity.LEFT).alias("held_out"), "score", predicted)


@query
def op11_va_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.report(*vafile.clusters(table(spark, sf_dir, "embeddings")))


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_SQUARED = "CAST(list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
_FLOORED = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"


def _cluster_sql(rounds: int = 3) -> str:
    ctes = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND {_FINITE})",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < 16)"]
    for r in range(rounds + 1):
        away = _SQUARED.format("k.v", f"c{r}.v")
        ctes.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, v, c, d FROM (SELECT k.vec_id, k.v, c, {away} AS d FROM kept k, c{r}) "
            "QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if r < rounds:
            ctes.append(
                f"m{r} AS (SELECT c, list(x ORDER BY pos) AS v FROM (SELECT c, pos, CAST({_FLOORED} AS BIGINT) AS x FROM "
                f"(SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{r}) GROUP BY c, pos) GROUP BY c)")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)")
    return (
        f"WITH {', '.join(ctes)} SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} f ON a.c = f.c")


ORACLES["op11_va_clusters"] = _cluster_sql()


@query
def op12_hilbert_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.report(*codes.quantise(table(spark, sf_dir, "embeddings")))


def _code_sql(rounds: int = 2) -> str:
    ctes = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE {_FINITE})",
        "parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v FROM kept, range(16) AS r(p))",
        "b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY e < 64)"]
    for r in range(rounds + 1):
        away = _SQUARED.format("t.v", "b.v")
        ctes.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, p, v, e, d FROM (SELECT t.vec_id, t.p, t.v, b.e, {away} AS d FROM parts t JOIN b{r} b ON t.p = b.p) "
            "QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)")
        if r < rounds:
            ctes.append(
                f"m{r} AS (SELECT p, e, list(x ORDER BY pos) AS v FROM (SELECT p, e, pos, CAST({_FLOORED} AS BIGINT) AS x FROM "
                f"(SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{r}) GROUP BY p, e, pos) GROUP BY p, e)")
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.e = m.e)")
    return (
        f"WITH {', '.join(ctes)}, per AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id), "
        f"books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}) "
        "SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept k JOIN per ON k.vec_id = per.vec_id, books")


ORACLES["op12_hilbert_codes"] = _code_sql()


@query
def op13_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages"))
