"""Registered queries of the corpus operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 1024 tokens."""
    from tablelens.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def _decided(scores: DataFrame, by: int, held: int, *more: str) -> DataFrame:
    return scores.select("doc_id", F.coalesce(remainder(F.col("doc_id"), by) == held, F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), *more)


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression score of every document; labels from rows with crc32 mod 5 not 0."""
    from tablelens.llm.quality import score_quality
    scores = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                           remainder(F.col("doc_id"), 5) != 0)
    return _decided(scores, 5, 0, "difference")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counterfactually regularised score of every document; labels from rows with crc32 mod 4 not 2."""
    from tablelens.llm.toxicity import score_toxicity
    scores = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                            remainder(F.col("doc_id"), 4) != 2)
    return _decided(scores, 4, 2)


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    from tablelens.llm.licenses import scan
    found = scan(table(spark, sf_dir, "documents"))
    base, more = F.col("places.label"), F.col("matches.label")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first_word").alias("first_word"), F.array_max("places.first_word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.share"), F.lit(0.0))).alias("score"))


def _license_sql() -> str:
    from tablelens.llm.licenses import PHRASES, TEMPLATES, THRESHOLD
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    fold = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in PHRASES)
    templates = ", ".join(f"('{label}', list_distinct({phrase.split()!r}))" for phrase, label in TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all({fold.format('text')}, '{word}') AS w FROM documents),
p(label, words) AS (VALUES {phrases}),
t(label, words) AS (VALUES {templates}),
place AS (SELECT r, label, i - 1 AS pos FROM d, p, generate_series(1, len(w) - len(words) + 1) AS g(i)
          WHERE w[i:i + len(words) - 1] = words),
paragraph AS (SELECT r, unnest(regexp_split_to_array({fold.format('text')}, '\\n[\\x09-\\x0D\\x20]*\\n')) AS x FROM d),
block AS (SELECT r, list_distinct(regexp_extract_all(x, '{word}')) AS b FROM
          (SELECT r, x FROM paragraph UNION ALL SELECT r, unnest(string_split(x, chr(10))) FROM paragraph)),
hit AS (SELECT r, label, len(list_intersect(b, words)) / len(words) AS share FROM block, t
        WHERE len(list_intersect(b, words)) / len(words) >= {THRESHOLD}),
base AS (SELECT r, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY r),
both_ AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM
          (SELECT r, label, 1.0::DOUBLE AS share FROM place UNION ALL SELECT r, label, share FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, base.lo AS first_word, base.hi AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(both_.labels, '') AS labels, coalesce(share, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN both_ USING (r)"""


ORACLE["op5_license_scan"] = _license_sql()

#: The mixture of the registered query: long documents before short ones, English before the other languages.
MIX_WEIGHTS = {("short",): 1, ("medium",): 3, ("long",): 4} | {(d, "en"): 4 for d in ("short", "medium", "long")}
MIX_SHARE, MIX_PASSES, MIX_SEED = (3, 5), 3, "7"


def mix_levels() -> dict:
    """Domain by length in characters, language, source."""
    n = F.length("text")
    return {"domain": F.when(n < 500, "short").when(n < 5000, "medium").otherwise("long"),
            "lang": F.col("lang"), "source": F.col("source")}


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fifths of all tokens, shared out by domain, language and source."""
    from tablelens.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_PASSES, MIX_SEED)


def mixing_sql(docs: str, share: tuple[int, int], passes: int) -> str:
    """DuckDB SQL of :func:`op6_source_mixing` over the table ``docs``."""
    own = " ".join(f"WHEN domain = '{k[0]}' THEN {v}" for k, v in MIX_WEIGHTS.items() if len(k) == 1)
    langs = " ".join(f"WHEN domain = '{k[0]}' AND lang = '{k[1]}' THEN {v}" for k, v in MIX_WEIGHTS.items() if len(k) == 2)
    sql = f"""
counted AS (SELECT * FROM (SELECT doc_id, CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) < 5000 THEN 'medium' ELSE 'long' END AS domain,
    coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS tokens FROM {docs}) WHERE tokens > 0),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS available, (sum(tokens) * {passes})::BIGINT AS capacity FROM counted GROUP BY ALL),
b0 AS (SELECT least(sum(capacity), (sum(available) * {share[0]}) // {share[1]})::HUGEINT AS budget FROM leaves)"""
    levels = [("domain", f"CASE {own} ELSE 1 END"), ("lang", f"CASE {langs} ELSE 1 END"), ("source", "1")]
    path: list[str] = []
    for k, (name, weight) in enumerate(levels, 1):
        above, path = ", ".join(path), [*path, name]
        cols, by = ", ".join(path), f"PARTITION BY {above}" if above else ""
        order = f"{by} ORDER BY capacity / weight, {name}"
        sql += f""",
n{k} AS (SELECT l.*, budget FROM (SELECT {cols}, sum(capacity)::HUGEINT AS capacity, sum(available)::HUGEINT AS available, {weight} AS weight FROM leaves GROUP BY {cols}) l
    JOIN b{k - 1} ON {' AND '.join(f'l.{c} = b{k - 1}.{c}' for c in path[:-1]) or 'true'}),
f{k} AS (SELECT *, capacity * sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (budget - sum(capacity) OVER ({order} ROWS UNBOUNDED PRECEDING) + capacity) * weight AS fits FROM n{k}),
u{k} AS (SELECT *, bool_and(fits) OVER ({order} ROWS UNBOUNDED PRECEDING) AS used_up FROM f{k}),
r{k} AS (SELECT *, budget - sum(CASE WHEN used_up THEN capacity ELSE 0 END) OVER ({by}) AS rest,
    sum(CASE WHEN used_up THEN 0 ELSE weight END) OVER ({by}) AS free,
    sum(CASE WHEN used_up THEN 0 ELSE weight END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS upto FROM u{k}),
b{k} AS (SELECT {cols}, available, CASE WHEN used_up THEN capacity ELSE (rest * upto) // free - (rest * (upto - weight)) // free END AS budget FROM r{k})"""
    return sql + f""",
ranked AS (SELECT c.*, budget, budget // available AS whole, budget % available AS rest,
    md5('{MIX_SEED}:' || (budget // available)::VARCHAR || ':' || coalesce(c.doc_id::VARCHAR, '')) AS ord
    FROM counted c JOIN b3 ON c.domain = b3.domain AND c.lang = b3.lang AND c.source = b3.source),
cut AS (SELECT *, greatest(0, least(tokens, rest - (sum(tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY ('0x' || ord[1:4])::INT % {1024}, ord, doc_id, tokens ROWS UNBOUNDED PRECEDING) - tokens))) AS cut FROM ranked),
mixed AS (SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, (whole + CASE WHEN cut > 0 THEN 1 ELSE 0 END)::BIGINT AS copies,
    (whole * tokens + cut)::BIGINT AS tokens_taken, budget::BIGINT AS budget FROM cut)"""


ORACLE["op6_source_mixing"] = f"WITH {mixing_sql('documents', MIX_SHARE, MIX_PASSES)} SELECT * FROM mixed WHERE copies > 0"


@query
def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of every document; learned from rows with crc32 mod 7 not 2."""
    from tablelens.llm.ctw import score
    out = score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)
    return out.withColumn("bits_per_byte", -F.col("score") * 3.321928094887362 / F.col("n_bytes"))


@query
def op2_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share three quarters of their five-word shingles."""
    from tablelens.llm.minhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE["op2_minhash_near_duplicates"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d
LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id"""


@query
def op3_cover_tree_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of embeddings of one label with a cosine of at least 0.98."""
    from tablelens.llm.covertree import threshold_components
    return threshold_components(table(spark, sf_dir, "embeddings"))


ORACLE["op3_cover_tree_near_duplicates"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x)
SELECT d.vec_id, (SELECT count(*) FROM l WHERE l.x = d.vec_id) AS n_links, c.component_id, d.vec_id = c.component_id AS kept
FROM embeddings d JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.vec_id"""


@query
def op7_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest inner products of every 50th embedding with all others."""
    from tablelens.llm.kdtree import top_k
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op7_kd_tree_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE a.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM
  (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 5"""


@query
def op10_html_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from tablelens.llm.blocklabeller import main_text
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op11_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty clusters of all embeddings after five rounds."""
    from tablelens.llm.bisector import cluster, inertia
    return inertia(*cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5))


def _cluster_sql(k: int = 40, rounds: int = 5) -> str:
    sql = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::BIGINT AS cluster, e AS c FROM v ORDER BY 1 LIMIT {k})"""
    for n in range(rounds + 1):
        # distance and number in one integer: the smallest distance, then the smallest number
        sql += f""",
a{n} AS MATERIALIZED (SELECT r, min(list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT * 64 + cluster) AS best
    FROM v, c{n} GROUP BY r)"""
        if n < rounds:
            sql += f""",
s{n} AS (SELECT best % 64 AS cluster, i, sum(e[i])::BIGINT AS s, count(*) AS n FROM a{n} JOIN v USING (r), generate_series(1, 64) AS g(i) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (SELECT c{n}.cluster, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN
    (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{n} GROUP BY cluster) m USING (cluster))"""
    return sql + f"""
SELECT vec_id, (best % 64)::INTEGER AS cluster, best // 64 AS distance, (sum(best // 64) OVER (PARTITION BY best % 64))::BIGINT AS cluster_inertia,
    (sum(best // 64) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c{rounds}.cluster = best % 64"""


ORACLE["op11_bisector_clusters"] = _cluster_sql()


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of them with repeated tails."""
    from tablelens.llm.runs import longest, periodic_runs, periodic_tail
    return longest(periodic_runs(table(spark, sf_dir, "documents"), periodic_tail))


@query
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that a document of smaller id holds."""
    from tablelens.llm.suffixes import remove_repeated
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r.length)
    return remove_repeated(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
