"""Sentiment and word-frequency queries."""

from tablelens.catalog.base import register, table
from tablelens.catalog.fixtures import REVIEW_EVENTS_SQL, review_events
from tablelens.functions import lexicon as L
from tablelens.operators import sentiment as X


def _lst(ws):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in ws)


TOKS = "regexp_extract_all(lower({x}), '[a-z'']+')"
VAL = f"""list_transform(t, lambda w, i:
    CASE WHEN w IN ({_lst(L.POS_WORDS)}) THEN 1.0
         WHEN w IN ({_lst(L.NEG_WORDS)}) THEN CASE WHEN w IN ({_lst(L.STRONG_NEGATIVE)}) THEN -1.8 ELSE -1.0 END END
    * CASE WHEN list_has_any(t[greatest(i - 2, 1):i - 1], [{_lst(L.NEGATORS)}]) THEN 0.7 ELSE 1.0 END
    * CASE WHEN i > 1 AND list_contains([{_lst(L.INTENSIFIERS)}], t[i - 1]) THEN 1.5 ELSE 1.0 END)"""
SCORE = ("CASE WHEN len(h) = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, list_sum(h) / len(h))) END")
NONBLANK = "{x} IS NOT NULL AND length(regexp_replace({x}, '^\\s+|\\s+$', '', 'g')) > 0"
LABEL = "CASE WHEN {v} >= 0.05 THEN 'positive' WHEN {v} <= -0.05 THEN 'negative' ELSE 'neutral' END"


def scored(src, text, cols):
    """Rows of ``src`` with non-blank ``text`` plus the raw valence ``v``."""
    return f"""(SELECT {cols}, {SCORE} AS v FROM (
      SELECT *, list_filter({VAL}, lambda x: x IS NOT NULL) AS h FROM (
        SELECT *, {TOKS.format(x=text)} AS t FROM {src} WHERE {NONBLANK.format(x=text)})))"""


register("sentiment_rows", f"""
SELECT doc_id, text, lang, source, n_chars, round(v, 4) AS compound, {LABEL.format(v='v')} AS label
FROM {scored('documents', 'text', 'doc_id, text, lang, source, n_chars')}
""")(lambda s, d: X.score_rows(table(s, d, "documents"), "text"))

register("sentiment_reviews", f"""
SELECT event_id, ts, event_type, review, round(v, 4) AS compound, {LABEL.format(v='v')} AS label
FROM {scored(REVIEW_EVENTS_SQL, 'review', 'event_id, ts, event_type, review')}
""")(lambda s, d: X.score_rows(review_events(s, d), "review"))


def _summary_sql(src, col):
    return f"""
WITH x AS (SELECT v, {LABEL.format(v='v')} AS l FROM {scored(src, col, col)})
SELECT '{col}' AS "column", CAST(count(*) AS BIGINT) AS n,
       round(100.0 * count_if(l = 'positive') / count(*), 2) AS positive_pct,
       round(100.0 * count_if(l = 'neutral') / count(*), 2) AS neutral_pct,
       round(100.0 * count_if(l = 'negative') / count(*), 2) AS negative_pct,
       round(avg(v), 4) AS avg_compound, CAST(count_if(l = 'positive') AS BIGINT) AS n_positive,
       CAST(count_if(l = 'neutral') AS BIGINT) AS n_neutral, CAST(count_if(l = 'negative') AS BIGINT) AS n_negative
FROM x"""


register("sentiment_summary", _summary_sql("conversations", "text"))(
    lambda s, d: X.sentiment_summary(table(s, d, "conversations"), ["text"]))
register("sentiment_summary_reviews", _summary_sql(REVIEW_EVENTS_SQL, "review"))(
    lambda s, d: X.sentiment_summary(review_events(s, d), ["review"]))

_WORDS_FILTER = f"NOT (word IN ({_lst(L.STOP_WORDS)})) AND length(word) > 2"


def _words_sql(src, col, k=12):
    return f"""
WITH x AS (SELECT {LABEL.format(v='v')} AS label, {col} AS txt FROM {scored(src, col, col)}),
w AS (SELECT label, unnest({TOKS.format(x='txt')}) AS word FROM x WHERE label <> 'neutral'),
c AS (SELECT label, word, count(*) AS cnt FROM w WHERE {_WORDS_FILTER} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cnt DESC, word) AS rank FROM c)
SELECT '{col}' AS "column", label, word, CAST(cnt AS BIGINT) AS count, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= {k}"""


register("sentiment_words", _words_sql(REVIEW_EVENTS_SQL, "review"))(
    lambda s, d: X.sentiment_words(review_events(s, d), ["review"]))
register("sentiment_words_docs", _words_sql("documents", "text"))(
    lambda s, d: X.sentiment_words(table(s, d, "documents"), ["text"]))

register("themes", f"""
WITH w AS (SELECT unnest({TOKS.format(x='text')}) AS word FROM documents WHERE text IS NOT NULL),
c AS (SELECT word, count(*) AS cnt FROM w WHERE {_WORDS_FILTER} GROUP BY word),
r AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, word) AS rank FROM c)
SELECT word, CAST(cnt AS BIGINT) AS count, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 8
""")(lambda s, d: X.themes(table(s, d, "documents"), ["text"]))


def _by_sql(src, text, by):
    return f"""
WITH x AS (SELECT coalesce(CAST({by} AS VARCHAR), '(null)') AS "group", v FROM {scored(src, text, by)})
SELECT "group", CAST(count(*) AS BIGINT) AS n, round(avg(v), 4) AS avg_compound,
       round(100.0 * count_if(v >= 0.05) / count(*), 2) AS positive_pct,
       round(100.0 * count_if(v <= -0.05) / count(*), 2) AS negative_pct
FROM x GROUP BY 1"""


register("sentiment_by_role", _by_sql("conversations", "text", "role"))(
    lambda s, d: X.sentiment_by(table(s, d, "conversations"), "text", "role"))
register("sentiment_by_lang", _by_sql("documents", "text", "lang"))(
    lambda s, d: X.sentiment_by(table(s, d, "documents"), "text", "lang"))
register("sentiment_by_type", _by_sql(REVIEW_EVENTS_SQL, "review", "event_type"))(
    lambda s, d: X.sentiment_by(review_events(s, d), "review", "event_type"))

_DAYS = f"(SELECT *, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM {REVIEW_EVENTS_SQL})"
register("sentiment_over_time", f"""
SELECT CAST("group" AS TIMESTAMP) AS bucket, n, avg_compound, positive_pct, negative_pct FROM ({_by_sql(_DAYS, "review", "day")})
""")(lambda s, d: X.sentiment_over_time(review_events(s, d), "review", "ts", "D"))
