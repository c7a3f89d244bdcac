"""Registered queries of the navigation operators on analytic tables, with their SQL.

The tables hold no source code, so urls stand for paths, documents for folders, embeddings
for folder vectors, and source text is generated from part rows where a table function
needs some.  Scores are rounded to six digits after ranking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import digests, paths, tokens
from .functions import vectors as V
from .functions.common_terms import common_terms
from .operators import extract, hints, search
from .plans import index

TERMS = ["the", "and", "der", "que", "les"]
COMMON = ["and"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


# --- shared pieces ---------------------------------------------------------------------

def _vector(spark, sf_dir, vec_id: int = 0) -> list[float]:
    """The query: one vector."""
    return [float(x) for x in _table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


def _words(text: str):
    return F.array_distinct(F.split(F.lower(F.col(text)), r"\s+"))


def _url_paths(spark, sf_dir) -> DataFrame:
    """``page_id, path, folder, file_name, hash`` of pages, as of files."""
    path = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    rows = _table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.sha2("html", 256).alias("hash"))
    return rows.select("page_id", "path", paths.folder_of(F.col("path")).alias("folder"), paths.file_of(F.col("path")).alias("file_name"), "hash")


_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_Q = "q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)"
_PATHS = (
    "p AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS path, sha256(html) AS hash FROM pages), "
    "f AS (SELECT page_id, path, CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '.' "
    "ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS folder, regexp_extract(path, '([^/]*)$', 1) AS file_name, hash FROM p)"
)
_WORDS = r"list_distinct(string_split_regex(lower(d.text), '\s+'))"


def _camel_sql(s: str) -> str:
    return rf"regexp_replace(regexp_replace({s}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g')"


def _strip_sql(s: str) -> str:
    return rf"CASE WHEN length({s}) > 2 AND regexp_matches({s}, '^I\p{{Lu}}') THEN substr({s}, 2) ELSE {s} END"


def _segment_sql(s: str) -> str:
    return f"list_filter(string_split_regex(lower({_camel_sql(_strip_sql(s))}), '[-_. ]'), lambda w: w <> '')"


def _distinct_sql(l: str) -> str:
    return f"list_filter({l}, lambda w, i: list_position({l}, w) = i)"


def _path_tokens_sql(path: str) -> str:
    return f"flatten(list_transform(string_split({path}, '/'), lambda s: {_segment_sql('s')}))"


# --- vectors and ranking ---------------------------------------------------------------

@query(f"WITH {_Q} SELECT vec_id, round({_DOT.format(a='embedding', b='q.e')}, 6) AS score FROM embeddings, q "
       f"ORDER BY {_DOT.format(a='embedding', b='q.e')} DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.array().cast("array<string>").alias("tokens"))
    best = search.search(rows, _vector(spark, sf_dir), [], top=10, tie_col="vec_id")
    return best.select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_Q} SELECT vec_id, round({_DOT.format(a='embedding', b='q.e')}, 6) AS score FROM embeddings, q "
       f"WHERE {_DOT.format(a='embedding', b='q.e')} >= 0.2")
def vector_min_score(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.array().cast("array<string>").alias("tokens"))
    best = search.search(rows, _vector(spark, sf_dir), [], top=None, min_score=0.2, tie_col="vec_id")
    return best.select("vec_id", F.round("score", 6).alias("score"))


def _hybrid_rows(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", _words("text").alias("tokens"))
    return _table(spark, sf_dir, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id")).select("vec_id", "embedding", "tokens", "label")


_HYBRID = (
    f"WITH {_Q}, s AS (SELECT vec_id, {_DOT.format(a='e.embedding', b='q.e')} + 0.3 * "
    f"len(list_intersect(['the', 'der', 'que', 'les'], {_WORDS})) / 4 AS s, {_WORDS} AS w "
    "FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id, q) "
)


@query(_HYBRID + "SELECT vec_id, round(s, 6) AS score FROM s ORDER BY round(s, 9) DESC, vec_id LIMIT 20")
def hybrid_topk(spark, sf_dir):
    scored = search.score(_hybrid_rows(spark, sf_dir), _vector(spark, sf_dir), TERMS, common=COMMON)
    best = search.rank(scored.withColumn("score", F.round("score", 9)), 20, tie_col="vec_id")
    return best.select("vec_id", F.round("score", 6).alias("score"))


_MEANS = (
    "m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i "
    "FROM embeddings) GROUP BY label, i), "
    "n AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m)"
)


@query(f"WITH {_MEANS} SELECT label, (i - 1)::INT AS pos, round(x, 6) AS x FROM n")
def centroid_normalised(spark, sf_dir):
    means = V.mean_vectors(_table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


@query(
    f"WITH {_MEANS}, c AS (SELECT list(x ORDER BY i) AS v FROM n WHERE label = 3), "
    f"s AS (SELECT vec_id, {_DOT.format(a='e.embedding', b='c.v')} AS d, {_WORDS} AS w FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id, c) "
    "SELECT vec_id, round(d, 6) AS must_dot, CASE WHEN len(list_intersect(w, ['keit', 'und'])) > 0 THEN 0.15 WHEN d > 0.82 THEN -0.2 ELSE 0.0 END AS adjustment FROM s"
)
def must_adjust(spark, sf_dir):
    rows = _hybrid_rows(spark, sf_dir)
    means = V.mean_vectors(_table(spark, sf_dir, "embeddings").where("label = 3"), ["label"], "embedding").first()
    must = search.array_literal(means["centroid"] if means else [], "double")
    alike = V.dot(F.col("embedding"), must)
    adjusted = V.must_adjustment(search.array_literal(["keit", "und"], "string"), F.col("tokens"), alike)
    return rows.select("vec_id", F.round(alike, 6).alias("must_dot"), adjusted.alias("adjustment"))


@query(
    "WITH v AS (SELECT list(embedding ORDER BY vec_id) AS m FROM embeddings WHERE vec_id IN (1, 2, 3)), "
    "i AS (SELECT unnest(range(1, len(m[1]) + 1)) AS i, m FROM v), s AS (SELECT i, m[1][i]::DOUBLE + m[2][i]::DOUBLE + m[3][i]::DOUBLE AS x FROM i) "
    "SELECT i - 1 AS pos, round(x / (SELECT sqrt(sum(x * x)) FROM s), 6) AS x FROM s"
)
def must_sum(spark, sf_dir):
    """The state of several must texts: the normalised sum of their vectors."""
    unit, _ = search.must_state([_vector(spark, sf_dir, k) for k in (1, 2, 3)], [[], [], []])
    return spark.range(1).select(F.posexplode(search.array_literal(unit, "double")).alias("pos", "x")).select("pos", F.round("x", 6).alias("x"))


@query(
    f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_DOT.format(a='e.embedding', b='q.embedding')} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s) "
    "SELECT query_id, vec_id, rank::INT AS rank, round(s, 6) AS score FROM r WHERE rank <= 5"
)
def batched_topk(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    best = search.search_many(rows, asked, "query_id", "v", 5, "vec_id", digits=9)
    return best.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(
    f"SELECT d.doc_id, len(list_intersect(['the', 'and', 'der', 'que', 'les'], {_WORDS}))::INT AS n_matched, "
    f"round(len(list_intersect(['the', 'and', 'der', 'que', 'les'], {_WORDS})) / 5, 6) AS fraction FROM documents d"
)
def match_fraction(spark, sf_dir):
    terms = search.array_literal(TERMS, "string")
    rows = _table(spark, sf_dir, "documents").select("doc_id", _words("text").alias("w"))
    return rows.select("doc_id", V.match_count(terms, F.col("w")).alias("n_matched"), F.round(V.match_fraction(terms, F.col("w")), 6).alias("fraction"))


@query(
    f"WITH w AS (SELECT d.doc_id, unnest({_WORDS}) AS term FROM documents d) "
    "SELECT term, count(*) AS n_folders FROM w GROUP BY term HAVING count(*) > 0.15 * (SELECT count(*) FROM documents)"
)
def low_rank_terms(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", _words("text").alias("tokens"))
    return common_terms(rows, "doc_id", "tokens")


@query(f"WITH {_Q} SELECT count(*) AS n, sum(len(embedding)) AS numbers, round(sum({_DOT.format(a='embedding', b='q.e')}), 4) AS total FROM embeddings, q")
def vector_codec(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select(V.unpack(V.pack(F.col("embedding"))).alias("v"))
    dot = V.dot(F.col("v"), search.array_literal(_vector(spark, sf_dir), "double"))
    return rows.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("numbers"), F.round(F.sum(dot), 4).alias("total"))


# --- paths, tokens and folders -----------------------------------------------------------

@query(f"WITH {_PATHS}, t AS (SELECT page_id, {_path_tokens_sql('path')} AS l FROM f) SELECT page_id, array_to_string({_distinct_sql('l')}, ' ') AS tokens FROM t")
def tokenize_path(spark, sf_dir):
    return _url_paths(spark, sf_dir).select("page_id", tokens.tokenize_path(F.col("path")).alias("tokens"))


@query(
    f"WITH {_PATHS} SELECT page_id, array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), "
    f"lambda s: {_camel_sql(_strip_sql('s'))}), ' ') AS phrase FROM f"
)
def path_phrase(spark, sf_dir):
    return _url_paths(spark, sf_dir).select("page_id", tokens.path_phrase(F.col("path")).alias("phrase"))


_IDENTIFIER = "'I' || upper(p_name[1]) || replace(substr(p_name, 2), ' ', 'HTTPClient') || '_' || replace(p_brand, '#', '') || '.cs'"


def _identifiers(spark, sf_dir) -> DataFrame:
    name = F.concat(
        F.lit("I"), F.upper(F.substring("p_name", 1, 1)), F.replace(F.substring("p_name", 2, 1000), F.lit(" "), F.lit("HTTPClient")),
        F.lit("_"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".cs"),
    )
    return _table(spark, sf_dir, "part").select("p_partkey", "p_name", name.alias("name"))


@query(
    f"WITH i AS (SELECT p_partkey, p_name, {_IDENTIFIER} AS name FROM part), b AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS base FROM i) "
    f"SELECT p_partkey, array_to_string({_segment_sql('base')}, ' ') AS file_tokens, {_camel_sql(_strip_sql('base'))} AS file_phrase, "
    f"{_camel_sql('base')} AS method_phrase, array_to_string({_distinct_sql('list_concat(' + _segment_sql('base') + ', string_split(lower(p_name), chr(32)))')}, ' ') AS query_tokens FROM b"
)
def identifier_tokens(spark, sf_dir):
    name, base = F.col("name"), tokens.strip_extension(F.col("name"))
    return _identifiers(spark, sf_dir).select(
        "p_partkey", tokens.tokenize_file_name(name).alias("file_tokens"), tokens.file_name_phrase(name).alias("file_phrase"),
        tokens.method_phrase(base).alias("method_phrase"),
        F.array_join(tokens.query_tokens(F.concat_ws(" ", base, "p_name")), " ").alias("query_tokens"),
    )


@query(f"WITH {_PATHS} SELECT folder, count(DISTINCT upper(file_name)) AS n_files, string_agg(DISTINCT file_name, '|' ORDER BY file_name) AS filename_set FROM f GROUP BY folder")
def group_by_folder(spark, sf_dir):
    rows = index.group_folders(_url_paths(spark, sf_dir))
    return rows.select(F.col("path").alias("folder"), F.size("file_hashes").cast("long").alias("n_files"), "filename_set")


@query(
    f"WITH {_PATHS}, u AS (SELECT folder, file_name, max(hash) AS hash FROM f GROUP BY folder, file_name) "
    "SELECT folder, sha256('{' || string_agg('\"' || file_name || '\":\"' || hash || '\"', ',' ORDER BY file_name) || '}') AS json_sha FROM u GROUP BY folder"
)
def folder_hashes_json(spark, sf_dir):
    rows = index.group_folders(_url_paths(spark, sf_dir))
    return rows.select(F.col("path").alias("folder"), F.sha2(digests.hashes_json(F.col("file_hashes")), 256).alias("json_sha"))


@query(f"WITH {_PATHS} SELECT page_id, folder, file_name FROM f WHERE NOT list_has_any(string_split(lower(path), '/'), ['de', 'es'])")
def segment_exclusion(spark, sf_dir):
    rows = _url_paths(spark, sf_dir)
    return rows.where(~paths.has_segment(F.col("path"), ("DE", "Es"))).select("page_id", "folder", "file_name")


@query(
    f"WITH {_PATHS} SELECT folder, upper(sha256('main' || chr(10) || string_agg(DISTINCT page_id::VARCHAR || ':' || hash, chr(10) ORDER BY page_id::VARCHAR || ':' || hash))[1:16]) "
    "AS state_key FROM f GROUP BY folder"
)
def state_key(spark, sf_dir):
    entry = F.concat_ws(":", F.col("page_id").cast("string"), "hash")
    return _url_paths(spark, sf_dir).groupBy("folder").agg(digests.state_key(F.lit("main"), F.collect_set(entry)).alias("state_key"))


@query(f"WITH {_PATHS} SELECT page_id, path FROM f WHERE regexp_matches(path, '^.*/en/[^/]*\\.html$')")
def glob_match(spark, sf_dir):
    rows = _url_paths(spark, sf_dir)
    return rows.where(paths.glob_match(F.col("path"), "**/en/*.html")).select("page_id", "path")


@query(
    f"WITH {_PATHS} SELECT page_id, len(list_filter(string_split(folder, '/'), lambda s: s <> '' AND s <> '.')) >= 2 AS narrow, "
    "regexp_matches(lower(path), '\\.(cs|tsx?)$') AS supported FROM f"
)
def path_predicates(spark, sf_dir):
    return _url_paths(spark, sf_dir).select("page_id", paths.is_narrow(F.col("folder")).alias("narrow"), paths.is_supported(F.col("path")).alias("supported"))


@query(
    f"WITH {_PATHS}, g AS (SELECT folder, string_agg(DISTINCT file_name, '|' ORDER BY file_name) AS s FROM f GROUP BY folder), "
    f"t AS (SELECT folder, s, flatten([{_path_tokens_sql('folder')}, flatten(list_transform(string_split(s, '|'), "
    f"lambda n: {_segment_sql(chr(114) + 'egexp_replace(n, ' + chr(39) + chr(92) + '.[^.]*$' + chr(39) + ', ' + chr(39) * 2 + ')')}))]) AS l FROM g) "
    f"SELECT folder, array_to_string({_distinct_sql('l')}, ' ') AS tokens, "
    f"trim(array_to_string(list_transform(list_filter(string_split(folder, '/'), lambda x: x <> ''), lambda x: {_camel_sql(_strip_sql('x'))}), ' ') || '. Files: ' || "
    f"array_to_string(list_transform(string_split(s, '|'), lambda n: regexp_replace(n, '\\.[^.]*$', '')), ', ')) AS embedding_text FROM t"
)
def folder_texts(spark, sf_dir):
    rows = index.group_folders(_url_paths(spark, sf_dir))
    names, none = F.split("filename_set", r"\|", -1), F.array().cast("array<string>")
    return rows.select(
        F.col("path").alias("folder"), F.array_join(tokens.combined_tokens(F.col("path"), names, none), " ").alias("tokens"),
        tokens.embedding_text(F.col("path"), names, none).alias("embedding_text"),
    )


@query(
    "WITH k AS (SELECT array_to_string(list_sort(json_keys(props)), '|') AS filename_set FROM events) SELECT filename_set, count(*) AS n FROM k GROUP BY filename_set"
)
def json_keys(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy(digests.json_file_set(F.col("props")).alias("filename_set")).agg(F.count("*").alias("n"))


# --- index maintenance ------------------------------------------------------------------

def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Folders by source and language: all documents, and those of good quality before."""
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("/", "source", "lang").alias("path"), F.sha2("text", 256).alias("hash")
    )
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    fold = lambda d: d.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string").alias("k"), "hash"))).alias("file_hashes"))
    return fold(docs), fold(docs.join(good, "doc_id", "left_semi"))


_SNAP = (
    "d AS (SELECT doc_id, source || '/' || lang AS path, sha256(text) AS hash FROM documents), "
    "l AS (SELECT path, string_agg(doc_id::VARCHAR || ':' || hash, ',' ORDER BY doc_id) AS h, count(*) AS n FROM d GROUP BY path), "
    "o AS (SELECT path, string_agg(doc_id::VARCHAR || ':' || hash, ',' ORDER BY doc_id) AS h FROM d "
    "WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY path)"
)


@query(f"WITH {_SNAP} SELECT l.path, n FROM l LEFT JOIN o ON l.path = o.path WHERE o.h IS NULL OR o.h <> l.h")
def incremental_diff(spark, sf_dir):
    live, stored = _snapshots(spark, sf_dir)
    return index.changed(live, stored).select("path", F.size("file_hashes").cast("long").alias("n"))


@query(
    "WITH n AS (SELECT doc_id, 10 + toxic AS value FROM labels WHERE toxic = 1) "
    "SELECT doc_id, n_chars AS value FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, value FROM n"
)
def upsert(spark, sf_dir):
    old = _table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("value"))
    new = _table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", (F.lit(10) + F.col("toxic")).cast("long").alias("value"))
    return index.upserted(old, new, "doc_id")


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def prune(spark, sf_dir):
    return index.pruned(_table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), _table(spark, sf_dir, "labels"), "doc_id")


@query(
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
)
def working_tree_difference(spark, sf_dir):
    gone = _table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return _table(spark, sf_dir, "documents").select("doc_id", "source").join(gone, "doc_id", "left_anti")


# --- hints, filters and sinks -------------------------------------------------------------

@query(
    f"WITH {_Q}, s AS (SELECT label, 0.9 + {_DOT.format(a='embedding', b='q.e')} / 100 AS s FROM embeddings, q), "
    "g AS (SELECT label, count(*) AS n, min(s) AS low, max(s) AS high FROM s GROUP BY label), h AS (SELECT *, (high - low) / (n - 1) AS gap FROM g) "
    "SELECT label, n, round(low, 6) AS low, round(high, 6) AS high, n >= 5 AND gap <= 0.01 AND low > 0.7 AS tight, "
    "CASE WHEN n >= 5 AND gap <= 0.01 AND low > 0.7 THEN round(low - gap, 6) END AS suggested FROM h"
)
def cluster_hint(spark, sf_dir):
    dot = V.dot(F.col("embedding"), search.array_literal(_vector(spark, sf_dir), "double"))
    rows = _table(spark, sf_dir, "embeddings").select("label", (F.lit(0.9) + dot / 100).alias("score"))
    return hints.cluster_hint(rows, ["label"]).select(
        "label", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "tight", F.round("suggested", 6).alias("suggested")
    )


@query(
    "WITH x AS (SELECT source, len(string_split(text, chr(10))) AS lines FROM documents), "
    "g AS (SELECT source, count(*) AS n_files, (sum(lines) // count(*))::BIGINT AS mean_lines FROM x GROUP BY source) "
    "SELECT source, n_files, mean_lines, n_files > 30 AS broad, n_files <= 20 AND mean_lines <= 50 AS small FROM g"
)
def folder_hint(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("source", F.size(F.split("text", "\n", -1)).alias("lines"))
    return hints.folder_hints(rows, "source", "lines")


@query(
    "SELECT conv_id, turn, role FROM conversations WHERE regexp_matches(coalesce(role, '') || chr(9) || 'turn' || chr(9) || coalesce(text, ''), 'USER.*(passwort|th?e )|assistant\\tturn\\tde', 'i')"
)
def regex_signatures(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.coalesce("role", F.lit("")).alias("containing_type"), F.lit("turn").alias("member_name"), F.coalesce("text", F.lit("")).alias("signature")
    )
    return extract.filter_signatures(rows, r"USER.*(passwort|th?e )\|assistant\tturn\tde").select("conv_id", "turn", "role")


@query(
    "WITH n AS (SELECT p_name AS member_name, min(p_partkey) AS k FROM part WHERE contains(lower(p_name), 'ring') OR contains('ring', lower(p_name)) GROUP BY p_name) "
    "SELECT member_name FROM n ORDER BY k, member_name LIMIT 10"
)
def suggest(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(
        F.lit("part").alias("path"), F.col("p_partkey").alias("start_char"), F.col("p_name").alias("member_name"), F.lit(None).cast("string").alias("error")
    )
    return extract.suggest_names(rows, "RING")


@query(f"WITH {_Q}, s AS (SELECT vec_id, {_DOT.format(a='embedding', b='q.e')} AS s FROM embeddings, q) SELECT vec_id, printf('%.4f', round(s, 4)) || chr(9) || vec_id AS value FROM s")
def ranked_lines(spark, sf_dir):
    dot = V.dot(F.col("embedding"), search.array_literal(_vector(spark, sf_dir), "double"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", V.rounded(dot, 4).alias("score"), F.col("vec_id").cast("string").alias("path"))
    return rows.select("vec_id", search.ranked_line(F.col("score"), F.col("path")).alias("value"))


# --- table functions on generated source ---------------------------------------------------

def _sharp_files(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("using System;\nnamespace Parts {\n  public class Part"), key, F.lit(" {\n    private int _n; // field\n    public Part"), key,
        F.lit("(int n) { _n = n; }\n    public int Size { get; private set; }\n    /* "), F.col("p_name"),
        F.lit(" */\n    public string Describe(string a, int b)\n    {\n      // "), F.col("p_brand"), F.lit("\n      return \"{ "), F.col("p_name"),
        F.lit(" }\";\n    }\n    class Inner { void Hidden() { } }\n  }\n}\n"),
    )
    return _table(spark, sf_dir, "part").select(F.concat(F.lit("src/Part"), key, F.lit(".cs")).alias("path"), text.alias("content"))


def _script_files(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    text = F.concat(
        F.lit("import x from 'y';\nexport class C"), key, F.lit(" {\n  private id: number;\n  constructor(id: number) { this.id = id; }\n  public async load(q: string): Promise<void> {\n    // "),
        F.col("c_name"), F.lit("\n    const s = `${q}"), F.col("c_mktsegment"), F.lit("`;\n  }\n}\nexport function make"), key, F.lit("(a: number): C { return 1; }\n"),
    )
    return _table(spark, sf_dir, "customer").select(F.concat(F.lit("src/c"), key, F.lit(".ts")).alias("path"), text.alias("content"))


_K, _C = "p_partkey::VARCHAR", "c_custkey::VARCHAR"


@query(
    f"SELECT 'src/Part' || {_K} || '.cs' AS path, u.line::INT AS line, replace(u.t, '@', {_K}) AS containing_type, replace(u.m, '@', {_K}) AS member_name, replace(u.s, '@', {_K}) AS signature, "
    "u.kind AS kind, u.pub AS is_public FROM part, (VALUES (5, 'Part@', 'Part@', 'public Part@(int n)', 'constructor', false), "
    "(6, 'Part@', 'Size', 'public int Size { get; private set; }', 'property', false), (8, 'Part@', 'Describe', 'public string Describe(string a, int b)', 'method', true), "
    "(13, 'Part@.Inner', 'Hidden', 'void Hidden()', 'method', false)) u(line, t, m, s, kind, pub)"
)
def extract_csharp(spark, sf_dir):
    rows = extract.extract_members(_sharp_files(spark, sf_dir)).where("error is null")
    return rows.select("path", "line", "containing_type", "member_name", "signature", "kind", "is_public")


@query(
    f"SELECT 'src/c' || {_C} || '.ts' AS path, u.line::INT AS line, replace(u.t, '@', {_C}) AS containing_type, replace(u.m, '@', {_C}) AS member_name, replace(u.s, '@', {_C}) AS signature, "
    "u.kind AS kind, u.pub AS is_public FROM customer, (VALUES (3, 'C@', 'id', 'private id: number', 'field', false), (4, 'C@', 'constructor', 'constructor(id: number)', 'constructor', false), "
    "(5, 'C@', 'load', 'public async load(q: string): Promise<void>', 'method', true), (10, '<global>', 'make@', 'function make@(a: number): C', 'function', true)) u(line, t, m, s, kind, pub)"
)
def extract_typescript(spark, sf_dir):
    rows = extract.extract_members(_script_files(spark, sf_dir)).where("error is null")
    return rows.select("path", "line", "containing_type", "member_name", "signature", "kind", "is_public")


@query(f"SELECT 'src/c' || {_C} || '.ts' AS path, 'load|make' || {_C} AS names FROM customer UNION ALL SELECT 'src/Part' || {_K} || '.cs', 'Describe' FROM part")
def public_names(spark, sf_dir):
    files = _script_files(spark, sf_dir).unionByName(_sharp_files(spark, sf_dir))
    return extract.public_names(extract.extract_members(files)).select("path", F.array_join("names", "|").alias("names"))


_HEAD = "'public string Describe(string a, int b)'"
_BODY = "'{' || chr(10) || '      // ' || p_brand || chr(10) || '      return \"{ ' || p_name || ' }\";' || chr(10) || '    }'"
_BARE = "'{' || chr(10) || '      ' || chr(10) || '      return \"{ ' || p_name || ' }\";' || chr(10) || '    }'"


def _source_query(mode: str):
    def run(spark, sf_dir):
        members = extract.extract_members(_sharp_files(spark, sf_dir))
        rows = extract.member_source(members, "Describe", None, mode)
        return rows.select("file", "containing_type", "mode", "start_line", "end_line", (F.col("end_char") - F.col("start_char")).alias("n_chars"), "content")

    return run


for _mode, _text, _span, _first, _last in (
    (extract.SIGNATURE_PLUS_BODY, f"{_HEAD} || chr(10) || '    ' || {_BODY}", None, 8, 12), (extract.SIGNATURE_ONLY, _HEAD, None, 8, 8),
    (extract.BODY_ONLY, _BODY, None, 9, 12), (extract.BODY_WITHOUT_COMMENTS, _BARE, _BODY, 9, 12),
):
    QUERIES[f"method_source_{_mode}"] = _source_query(_mode)
    SQL[f"method_source_{_mode}"] = (
        f"SELECT 'src/Part' || {_K} || '.cs' AS file, 'Part' || {_K} AS containing_type, '{_mode}' AS mode, {_first}::INT AS start_line, {_last}::INT AS end_line, "
        f"length({_span or _text})::INT AS n_chars, {_text} AS content FROM part"
    )


@query(
    f"SELECT 'src/Part' || {_K} || '.cs' AS path, 'src/Part' || {_K} || '.cs' || chr(10) || '  8' || chr(9) || 'Part' || {_K} || chr(9) || 'Describe' || chr(9) || {_HEAD} AS block FROM part"
)
def signature_blocks(spark, sf_dir):
    rows = extract.signatures(extract.extract_members(_sharp_files(spark, sf_dir)))
    return extract.signature_blocks(extract.filter_signatures(rows, "describe"))


@query()
def wordpiece(spark, sf_dir):
    from .functions.wordpiece import wordpiece as encode

    vocabulary = {w: 200 + k for k, w in enumerate(["the", "of", "der", "##er", "##en", "th", "e", "t", "##h", "##e", "on"])}
    rows = _table(spark, sf_dir, "documents").select("doc_id", encode(F.col("text"), vocabulary).alias("c"))
    return rows.select("doc_id", F.aggregate("c.attention_mask", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"), F.array_join(F.col("c.input_ids").cast("array<string>"), " ").alias("ids"))


# A vector of the asked size and of length one; its numbers are hashes.
@query(f"SELECT folder, 64 AS size, 1.0 AS norm FROM ({SQL['folder_texts']}) t")
def embed_folders(spark, sf_dir):
    from .functions.embedding import HashEmbedder, embed_column

    texts = folder_texts(spark, sf_dir)
    rows = texts.select("folder", embed_column(F.col("embedding_text"), HashEmbedder(64)).alias("v"))
    return rows.select("folder", F.size("v").alias("size"), F.round(V.norm(F.col("v")), 5).alias("norm"))


# --- listings, sinks and small functions ----------------------------------------------------

def _listing(spark, sf_dir) -> DataFrame:
    """Parts stand for tracked files, those of size 11 are gone, suppliers are new files."""
    part = _table(spark, sf_dir, "part")
    path = F.concat(F.when(F.col("p_size") % 7 == 0, F.lit("src/Tests/")).otherwise(F.concat(F.lit("src/"), "p_type", F.lit("/"))), F.col("p_partkey").cast("string"), F.lit(".cs"))
    tracked = part.select(path.alias("path"), F.substring(F.sha2("p_name", 256), 1, 8).alias("hash"), F.lit("tracked").alias("origin"))
    gone = part.where("p_size = 11").select(path.alias("path"), F.lit("").alias("hash"), F.lit("deleted").alias("origin"))
    new = _table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("src/new/s"), F.col("s_suppkey").cast("string"), F.when(F.col("s_nationkey") % 2 == 0, F.lit(".TS")).otherwise(F.lit(".md"))).alias("path"),
        F.concat_ws(":", F.lit("wt"), F.col("s_suppkey").cast("string")).alias("hash"), F.lit("untracked").alias("origin"),
    )
    return tracked.unionByName(gone).unionByName(new)


@query(
    "SELECT 'src/' || p_type || '/' || p_partkey || '.cs' AS path, 'src/' || p_type AS folder, p_partkey || '.cs' AS file_name, sha256(p_name)[1:8] AS hash "
    "FROM part WHERE p_size % 7 <> 0 AND p_size <> 11 UNION ALL SELECT 'src/new/s' || s_suppkey || '.TS', 'src/new', 's' || s_suppkey || '.TS', 'wt:' || s_suppkey "
    "FROM supplier WHERE s_nationkey % 2 = 0"
)
def working_tree(spark, sf_dir):
    from .sources.git import working_tree as tree

    return tree(_listing(spark, sf_dir))


@query(f"WITH {_SNAP} SELECT l.path, CASE WHEN o.h IS NULL THEN 'Missing' WHEN o.h = l.h THEN 'Fresh' ELSE 'Stale' END AS status FROM l LEFT JOIN o ON l.path = o.path")
def folder_status(spark, sf_dir):
    live, stored = _snapshots(spark, sf_dir)
    return index.folder_status(live, stored)


@query(
    f"SELECT 'src/Part' || {_K} || '.cs:' || u.line || chr(9) || replace(u.t, '@', {_K}) || chr(9) || replace(u.m, '@', {_K}) || chr(9) || replace(u.s, '@', {_K}) AS value FROM part, "
    "(VALUES (5, 'Part@', 'Part@', 'public Part@(int n)'), (6, 'Part@', 'Size', 'public int Size { get; private set; }'), "
    "(8, 'Part@', 'Describe', 'public string Describe(string a, int b)'), (13, 'Part@.Inner', 'Hidden', 'void Hidden()')) u(line, t, m, s)"
)
def signature_lines(spark, sf_dir):
    return extract.signature_lines(extract.signatures(extract.extract_members(_sharp_files(spark, sf_dir))))


@query(f"SELECT 'src/Part' || {_K} || '.cs' AS file, 'Hidden' AS member_name, 'Part' || {_K} || '.Inner' AS containing_type, 'void Hidden() {{ }}' AS content FROM part")
def member_of_type(spark, sf_dir):
    rows = extract.member_source(extract.extract_members(_sharp_files(spark, sf_dir)), "Hidden", "Inner")
    return rows.select("file", "member_name", "containing_type", "content")


@query(f"SELECT DISTINCT n AS member_name FROM customer, unnest(['id', 'constructor', 'load', 'make' || {_C}]) t(n)")
def member_names(spark, sf_dir):
    return extract.extract_members(_script_files(spark, sf_dir)).where("error is null").select("member_name").distinct()


@query(
    "SELECT doc_id, (length(text) // 2 + length(regexp_replace(substr(text, 1, (length(text) // 2)::BIGINT), '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::INT AS utf16, "
    "len(string_split(substr(text, 1, (length(text) // 2)::BIGINT), chr(10)))::INT AS line FROM documents"
)
def text_offsets(spark, sf_dir):
    half = F.floor(F.length("text") / 2).cast("int")
    return _table(spark, sf_dir, "documents").select(
        "doc_id", extract.utf16_offset(F.col("text"), half).alias("utf16"), extract.line_of(F.col("text"), half).alias("line")
    )


@query(
    f"SELECT 'src/Part' || {_K} || '.cs' AS file, '{{\"file\":\"src/Part' || {_K} || '.cs\",\"member_name\":\"Size\",\"containing_type\":\"Part' || {_K} || '\",\"start_line\":6,\"content\":\"public int Size {{ get; private set; }}\"}}' AS json FROM part"
)
def json_rows(spark, sf_dir):
    rows = extract.member_source(extract.extract_members(_sharp_files(spark, sf_dir)), "Size")
    return rows.select("file", F.to_json(F.struct("file", "member_name", "containing_type", "start_line", "content")).alias("json"))


@query("SELECT event_id::VARCHAR AS path, event_type AS tokens, event_type AS embedding_text, 'k' AS filename_set, regexp_extract(props, ': (.*)}', 1) AS value FROM events")
def migrate_index(spark, sf_dir):
    old = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.col("event_type").alias("combined_tokens"), F.col("props").alias("file_hashes"))
    rows = index.migrate(old)
    return rows.select("path", F.array_join("tokens", " ").alias("tokens"), "embedding_text", "filename_set", F.col("file_hashes")["k"].alias("value"))


@query(
    "WITH n AS (SELECT upper(p_name[1]) || substr(p_name, 2) AS name, p_partkey FROM part UNION ALL SELECT p_name, p_partkey FROM part) SELECT upper(name) AS key, count(DISTINCT p_partkey) AS n FROM n GROUP BY upper(name)"
)
def distinct_without_case(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    both = part.select(F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1000)).alias("name"), "p_partkey").union(part.select("p_name", "p_partkey"))
    return both.groupBy(F.upper("name").alias("key")).agg(F.countDistinct("p_partkey").alias("n"))


@query(
    "SELECT p_partkey, 'src/Part' || p_size || ' small' AS p0, array_to_string(list_filter(l, lambda w, i: list_position(l, w) = i), ' ') AS tokens, "
    "'src Part' || p_size || '. Files: ' || upper(p_name[1]) || substr(p_name, 2) || '. Methods: Get Http Status, Run' AS embedding_text "
    "FROM (SELECT *, list_concat(['src', 'part' || p_size], [lower(p_name)], ['get', 'http', 'status', 'run']) AS l FROM part)"
)
def combined_tokens(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    path = F.concat(F.lit("src/Part"), F.col("p_size").cast("string"))
    names = F.array(F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1000), F.lit(".cs")))
    methods = F.array(F.lit("GetHttpStatus"), F.lit("Run"))
    return part.select(
        "p_partkey", F.concat(path, F.lit(" small")).alias("p0"), F.array_join(tokens.combined_tokens(path, names, methods), " ").alias("tokens"),
        tokens.embedding_text(path, names, methods).alias("embedding_text"),
    )
