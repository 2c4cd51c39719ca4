"""Chunking, TF-IDF and retrieval queries (V1-V7)."""

from pyspark.sql import functions as F

from tablelens.catalog.base import register, table
from tablelens.functions import lexicon as L
from tablelens.functions.stats import materialize, rnd
from tablelens.operators import retrieval as V

SEP = "chr(57344)"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in L.STOP_WORDS)
TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def chunks_sql(src, id_col, text_col, size=900, overlap=120):
    s = size - overlap
    k = f"CASE WHEN length(sent) > {size} THEN CAST(ceil((length(sent) - {size}) / {float(s)}) AS BIGINT) ELSE 0 END"
    step = f"""lambda acc, sent: {{
        'done': CASE WHEN length(acc.cur) + length(sent) <= {size} THEN acc.done
                     ELSE list_concat(CASE WHEN acc.cur <> '' THEN list_append(acc.done, acc.cur) ELSE acc.done END,
                                      list_transform(range(0, {k}), lambda j: substring(sent, j * {s} + 1, {size}))) END,
        'cur': CASE WHEN length(acc.cur) + length(sent) <= {size} THEN {TRIM.format(x="acc.cur || ' ' || sent")}
                    ELSE substring(sent, {k} * {s} + 1) END}}"""
    return f"""
d AS (SELECT {id_col}, {text_col} AS text,
             string_split(regexp_replace({text_col}, '([.!?])\\s+', '\\1' || {SEP}, 'g'), {SEP}) AS sents
      FROM {src}),
r AS (SELECT {id_col}, text, list_reduce(sents, {step}, {{'done': []::VARCHAR[], 'cur': ''}}) AS res FROM d),
c AS (SELECT {id_col}, CASE WHEN text IS NULL OR length({TRIM.format(x='text')}) = 0 THEN []::VARCHAR[]
                            WHEN res.cur <> '' THEN list_append(res.done, res.cur) ELSE res.done END AS chunks FROM r),
ch AS (SELECT {id_col}, CAST(generate_subscripts(chunks, 1) - 1 AS BIGINT) AS chunk_id, unnest(chunks) AS text
       FROM c)"""


register("chunk_documents", f"""WITH {chunks_sql('documents', 'doc_id', 'text')}
SELECT doc_id, chunk_id, text, CAST(length(text) AS BIGINT) AS n_chars FROM ch
""")(lambda s, d: V.chunk_documents(table(s, d, "documents"), "doc_id", "text"))

register("chunk_documents_native", f"""WITH {chunks_sql('documents', 'doc_id', 'text')}
SELECT doc_id, chunk_id, text, CAST(length(text) AS BIGINT) AS n_chars FROM ch
""")(lambda s, d: V.chunk_documents(table(s, d, "documents"), "doc_id", "text"))


def tfidf_sql(src, id_col, text_col, prefix, idf_from=None, max_features=5000):
    """CTEs {prefix}tf, {prefix}w (id, term, weight normalised); vocabulary/idf
    fitted on ``src`` unless ``idf_from`` names an existing idf CTE."""
    p = prefix
    fit = "" if idf_from else f""",
{p}n AS (SELECT count(*) AS n FROM {src}),
{p}df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM {p}tf GROUP BY term),
{p}idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM {p}df, {p}n ORDER BY total DESC, term
           LIMIT {max_features})"""
    idf = idf_from or f"{p}idf"
    return f"""
{p}tf AS (SELECT {id_col}, term, count(*) AS tf FROM (
           SELECT {id_col}, unnest(regexp_extract_all(lower({text_col}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
           FROM {src}) WHERE term NOT IN ({_STOP}) GROUP BY ALL){fit},
{p}raw AS (SELECT {id_col}, term, tf * idf AS w FROM {p}tf JOIN {idf} USING (term)),
{p}nm AS (SELECT {id_col}, sqrt(sum(w * w)) AS norm FROM {p}raw GROUP BY {id_col}),
{p}w AS (SELECT {id_col}, term, w / norm AS weight FROM {p}raw JOIN {p}nm USING ({id_col}))"""


register("tfidf", f"""WITH {tfidf_sql('documents', 'doc_id', 'text', 'd_')}
SELECT doc_id, term, round(weight, 6) AS weight FROM d_w
""")(lambda s, d: V.tfidf(table(s, d, "documents"), "doc_id", "text").withColumn("weight", rnd("weight", 6)))


def _search_sql(qid, did, qw, dw, k):
    return f"""
s AS (SELECT {qid}, {did}, round(sum(q.weight * x.weight), 6) AS score
      FROM {qw} q JOIN {dw} x USING (term) GROUP BY ALL HAVING sum(q.weight * x.weight) > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY {qid} ORDER BY score DESC, {did}) AS rank FROM s),
hits AS (SELECT {qid}, {did}, score, CAST(rank AS BIGINT) AS rank FROM rk WHERE rank <= {k})"""


register("tfidf_topk", f"""WITH {tfidf_sql('documents', 'doc_id', 'text', 'd_')},
{tfidf_sql('benchmark', 'item_id', 'text', 'q_', idf_from='d_idf')},
{_search_sql('item_id', 'doc_id', 'q_w', 'd_w', 5)}
SELECT * FROM hits
""")(lambda s, d: _tfidf_topk(s, d))


def _tfidf_topk(s, d):
    docs, bench = table(s, d, "documents"), table(s, d, "benchmark")
    tf = V.term_rows(docs, "doc_id", "text")
    idf = V.fit_idf(docs, "doc_id", "text", tf=tf)
    items = V.transform_tfidf(bench, "item_id", "text", idf)
    return V.search(V.weight_rows(tf, idf), "doc_id", items, "item_id", 5)


register("cosine_topk", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY label, i),
c AS (SELECT label, list(x ORDER BY i) AS c FROM x GROUP BY label),
s AS (SELECT c.label, e.vec_id, list_dot_product(e.v, c.c) /
             (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.c, c.c))) AS score FROM e, c),
r AS (SELECT label, vec_id, round(score, 6) AS score FROM s WHERE score > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM r)
SELECT label, vec_id, score, CAST(rank AS BIGINT) AS rank FROM rk WHERE rank <= 5
""")(lambda s, d: _cosine(s, d))


def _cosine(s, d):
    emb = table(s, d, "embeddings")
    cen = V.centroids(emb, "label", "embedding")
    return V.dense_topk(emb, "vec_id", "embedding", cen, "label", "centroid", 5)


register("rag_context", f"""WITH {chunks_sql('documents', 'doc_id', 'text')},
chk AS (SELECT doc_id || '_' || chunk_id AS chunk_key, doc_id, text FROM ch),
{tfidf_sql('chk', 'chunk_key', 'text', 'd_')},
{tfidf_sql('benchmark', 'item_id', 'text', 'q_', idf_from='d_idf')},
{_search_sql('item_id', 'chunk_key', 'q_w', 'd_w', 3)}
SELECT item_id, coalesce(context, 'No relevant context retrieved.') AS context
FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN (
SELECT item_id, string_agg('[' || rank || '] (' || doc_id || ') ' || {TRIM.format(x='text')}, chr(10) || chr(10)
                           ORDER BY rank) AS context
FROM hits JOIN chk USING (chunk_key) GROUP BY item_id) USING (item_id)
""")(lambda s, d: _rag(s, d))


def _rag(s, d):
    ch, idf, index = V.build_index(table(s, d, "documents"), "doc_id", "text")
    q = V.transform_tfidf(table(s, d, "benchmark"), "item_id", "text", idf)
    hits = V.search(index, "chunk_key", q, "item_id", 3)
    return V.build_context(hits, "item_id", ch.select("chunk_key", "doc_id", "text"), ["chunk_key"], "doc_id",
                           table(s, d, "benchmark"))



def _svd(s, d):
    from tablelens.operators.svd import embed_texts
    return embed_texts(table(s, d, "documents"), "doc_id", "text", k=200)


register("svd_embed")(_svd)


def _svd_topk(s, d):
    """Benchmark items in the space of the documents, and the 5 documents nearest to each."""
    from tablelens.operators.svd import fit_components, fold_in
    docs, bench = table(s, d, "documents"), table(s, d, "benchmark")
    tf = V.term_rows(docs, "doc_id", "text")
    idf = V.fit_idf(docs, "doc_id", "text", tf=tf)
    weights = materialize(V.weight_rows(tf, idf).where(F.size("terms") > 0))
    components = fit_components(weights, "doc_id")
    items = fold_in(V.transform_tfidf(bench, "item_id", "text", idf), "item_id", components)
    return V.dense_topk(fold_in(weights, "doc_id", components), "doc_id", "vector", items, "item_id", "vector", 5)


register("svd_topk")(_svd_topk)


def _index_roundtrip(s, d):
    """An index founded on the English documents, the others added later, reopened and searched."""
    from tablelens.sources import index_store, sinks
    docs, bench = table(s, d, "documents"), table(s, d, "benchmark")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    base = sinks.scratch_dir(s, "index")
    index_store.create(base, docs.where(english), "doc_id", "text")
    index_store.add(s, base, docs.where(~english))
    index = index_store.load(s, base)
    items = V.transform_tfidf(bench, "item_id", "text", index.vocabulary)
    return V.search(index.rows, "chunk_key", items, "item_id", 3)


register("index_roundtrip", f"""WITH {chunks_sql('documents', 'doc_id', 'text')},
chk AS (SELECT ch.doc_id || '_' || chunk_id AS chunk_key, lang, ch.text FROM ch JOIN documents USING (doc_id)),
en AS (SELECT chunk_key, text FROM chk WHERE lang = 'en'),
{tfidf_sql('en', 'chunk_key', 'text', 'e_')},
{tfidf_sql('chk', 'chunk_key', 'text', 'd_', idf_from='e_idf')},
{tfidf_sql('benchmark', 'item_id', 'text', 'q_', idf_from='e_idf')},
{_search_sql('item_id', 'chunk_key', 'q_w', 'd_w', 3)}
SELECT * FROM hits
""")(_index_roundtrip)
