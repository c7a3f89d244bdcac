"""The registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprint import edit_fingerprints
from .mixing import mix_counts
from .near_dup import near_duplicates
from .pieces import encode
from .pivot_index import near_vectors
from .quality import fit_quality, score_quality
from .secret_scan import find_secrets, fit_secrets, spell
from .token_counts import token_counts
from .url_filter import judge_urls
from .warc_zip import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_counts(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    model = fit_quality(docs, labels.where(fold != 0))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, fit_secrets(docs))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spell(F.col("base_spans")), 256).alias("base_sha256"), spell(F.col("all_spans")).alias("spans"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(_table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


#: The rules of the query, in the order given.
URL_RULES = [
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "url_score")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(_table(spark, sf_dir, "documents"), digests=True)
    best = F.array_join(F.transform("best_scores", lambda x: F.format_string("%.4f", x)), ";")
    return coded.select("doc_id", "n_pieces", "score", "ids_sha256", best.alias("best_scores"), "best_sha256", "decoded_sha256", "decoded_equal")


# --- columns of the operators that SQL can express, as queries of their own ---------------

def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of the sources of op1."""
    mixed = mix_counts(_table(spark, sf_dir, "documents"))
    return mixed.groupBy("source").agg(
        F.sum("size").alias("words"), F.max("source_size").alias("source_size"), F.round(F.max("target"), 4).alias("target"),
        F.sum("taken").alias("taken"),
    )


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of base spans of op4."""
    return op4_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and edited texts of op5."""
    return op5_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, paths and rules of op7, and the verdicts of the rules."""
    judged = op7_urls(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_token_counts": op2_token_counts,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_fingerprints": op5_fingerprints,
    "op6_embeddings": op6_embeddings,
    "op7_urls": op7_urls,
    "op8_near_dedup": op8_near_dedup,
    "op9_warc": op9_warc,
    "op10_sentencepiece": op10_sentencepiece,
    "mix_targets": mix_targets,
    "secret_counts": secret_counts,
    "edited_texts": edited_texts,
    "url_rules": url_rules,
}
_USABLE = (
    "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL "
    "AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0"
)
_RULES = "CASE " + " ".join(
    f"WHEN (host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}') THEN {{{k}}}"
    for k, (rule, _) in sorted(enumerate(URL_RULES), key=lambda x: -len(x[1][0]))
) + " END"
SQL: dict[str, str] = {
    "op6_embeddings": f"""
        WITH RECURSIVE good AS (
            SELECT row_number() OVER () AS k, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE {_USABLE}
        ), pairs AS (
            SELECT a.k AS a, b.k AS b FROM good a JOIN good b ON a.label = b.label AND a.k <> b.k AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.93
        ), reach(a, b) AS (
            SELECT k, k FROM good UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
        ), named AS (
            SELECT r.a AS k, min(g.vec_id) AS component_id FROM reach r JOIN good g ON g.k = r.b GROUP BY r.a
        ), degrees AS (SELECT a AS k, count(*) AS n FROM pairs GROUP BY a)
        SELECT g.vec_id, coalesce(d.n, 0) AS n_links, m.component_id, g.vec_id = m.component_id AS kept
        FROM good g JOIN named m USING (k) LEFT JOIN degrees d USING (k)
        UNION ALL
        SELECT vec_id, 0, vec_id, vec_id IS NOT NULL FROM embeddings WHERE ({_USABLE}) IS NOT TRUE""",
    "op9_warc": """
        WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS g FROM pages),
        f AS (SELECT g, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY g)
        SELECT page_id, n AS payload_bytes, d.g AS payload_digest, CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to, true AS intact
        FROM d LEFT JOIN f ON d.g = f.g""",
    # Sources whose share is above three times their size are those of least size by weight.
    "mix_targets": r"""
        WITH s AS (
            SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS n FROM documents GROUP BY source
        ), w AS (SELECT source, n, 1.0 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
        o AS (
            SELECT source, n, w, row_number() OVER o AS k, (SELECT sum(n) FROM s) - coalesce(sum(3 * n) OVER b, 0) AS rest,
                (SELECT sum(w) FROM w) - coalesce(sum(w) OVER b, 0) AS scale
            FROM w WINDOW o AS (ORDER BY n / w, source), b AS (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), f AS (SELECT rest / scale AS each FROM o WHERE 3 * n / w >= rest / scale ORDER BY k LIMIT 1)
        SELECT source, n AS words, n AS source_size, round(least(3 * n, each * w), 4) AS target, round_even(least(3 * n, each * w), 0) AS taken FROM w, f""",
    "secret_counts": r"""
        SELECT doc_id, len([x FOR x IN regexp_extract_all(coalesce(text, ''),
                '(?i:(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 2) IF len(x) >= 12]) AS n_assign,
            len([x FOR x IN regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+') IF len(x) >= 18]) AS n_access,
            len([x FOR x IN regexp_extract_all(coalesce(text, ''), '[0-9a-f]+') IF len(x) >= 16]) AS n_hex
        FROM documents""",
    "edited_texts": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        d AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS after FROM t)
        SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(after, 1, length(t) // 2)) AS edited_sha256 FROM d""",
    "url_rules": f"""
        WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
        SELECT page_id, host, path, {_RULES.format(*[f"'{rule}'" for rule, _ in URL_RULES])} AS rule,
            {_RULES.format(*[f"'{verdict}'" for _, verdict in URL_RULES])} AS ruled
        FROM h""",
}
