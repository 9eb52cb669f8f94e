"""Registered corpus analyses (A1-A8) and oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import analyses as A
from quarry.registry import duck as D
from quarry.registry.oracle import CATALOG, oracle, with_
from quarry.registry.queries import query
from quarry.sources import derived
from quarry.sources.tables import table

ASPECT = "the"
RANGE = ("2024-01-01 00:00:00", "2024-12-31 23:59:59")
TYPES = ["pdf", "md", "html"]
DATES = {"start": "2024-01-03 05:00:00", "end": "2024-02-20 12:00:00"}


def terms_sql(x: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower({x}), {D.q(A.TERM_SPLIT)}), "
            f"lambda t_: t_ <> '')")


def sentences_sql(x: str) -> str:
    marked = f"regexp_replace({x}, {D.q(A.SENTENCE_END)}, '\\1' || chr(1), 'g')"
    return f"list_transform(string_split({marked}, chr(1)), lambda s_: {D.py_strip('s_')})"


TFIDF_SQL = f"""t_terms AS (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t_terms GROUP BY doc_id, term),
dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
tfidf AS (SELECT tf.doc_id, tf.term, tf.tf,
                 tf.tf * ln((SELECT count(*) FROM documents) / dfreq.df) AS tfidf
          FROM tf JOIN dfreq USING (term))"""

SENTS_SQL = f"""sents AS (
    SELECT doc_id, CAST(generate_subscripts(a_, 1) - 1 AS BIGINT) AS pos, unnest(a_) AS sentence
    FROM (SELECT doc_id, {sentences_sql('text')} AS a_ FROM documents))"""


LEXICON_SQL = f"""lex AS (
        SELECT word, CASE WHEN rn % 2 = 1 THEN 1 ELSE -1 END AS polarity FROM (
          SELECT word, row_number() OVER (ORDER BY n DESC, word) AS rn FROM (
            SELECT term AS word, count(*) AS n FROM (SELECT unnest({terms_sql('text')}) AS term
            FROM documents) GROUP BY term)) WHERE rn <= 40)"""


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query("a3_key_terms")
def a3(spark, sf):
    return A.key_terms(_docs(spark, sf), n=5)


@oracle("a3_key_terms")
def a3_sql():
    return with_(TFIDF_SQL) + """
    SELECT doc_id, rank, term, tf, round(tfidf, 6) AS tfidf FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 9) DESC, term)
                     AS BIGINT) AS rank FROM tfidf) WHERE rank <= 5"""


@query("a1_summarise")
def a1(spark, sf):
    return A.summarise(_docs(spark, sf), n=3)


@oracle("a1_summarise")
def a1_sql():
    return with_(TFIDF_SQL, SENTS_SQL, f"""tok AS (
        SELECT doc_id, pos, unnest({terms_sql('sentence')}) AS term FROM sents WHERE sentence <> '')""",
                 """sc AS (SELECT tok.doc_id, tok.pos, avg(x.tfidf) AS score FROM tok
                   JOIN tfidf x ON x.doc_id = tok.doc_id AND x.term = tok.term
                   GROUP BY tok.doc_id, tok.pos)""") + """
    SELECT doc_id, pos, sentence, round(score, 6) AS score FROM (
      SELECT sc.doc_id, sc.pos, s.sentence, sc.score,
             row_number() OVER (PARTITION BY sc.doc_id ORDER BY round(sc.score, 9) DESC, sc.pos) AS r_
      FROM sc JOIN sents s ON s.doc_id = sc.doc_id AND s.pos = sc.pos) WHERE r_ <= 3"""


def _labelled(spark, sf):
    return _docs(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"),
                                 "doc_id", "left")


@query("a2_compare")
def a2(spark, sf):
    return A.compare(_labelled(spark, sf), ASPECT, "quality")


@oracle("a2_compare")
def a2_sql():
    return with_(f"""t AS (SELECT d.doc_id, l.quality, unnest({terms_sql('d.text')}) AS term
        FROM documents d LEFT JOIN labels l USING (doc_id))""", f"""g AS (
        SELECT quality, count(DISTINCT doc_id) AS n_docs, count(*) AS n_terms,
               CAST(sum(CASE WHEN term = '{ASPECT}' THEN 1 ELSE 0 END) AS BIGINT) AS n_aspect
        FROM t GROUP BY quality)""") + """
    SELECT quality, n_docs, n_terms, n_aspect, round(n_aspect / n_terms, 6) AS rate,
           round(sum(n_aspect) OVER () / sum(n_terms) OVER (), 6) AS overall_rate,
           round(n_aspect / n_terms - sum(n_aspect) OVER () / sum(n_terms) OVER (), 6) AS diff
    FROM g"""


@query("a4_timeline")
def a4(spark, sf):
    ev = table(spark, sf, "events")
    return A.timeline(ev, F.col("event_type") == "error", start=RANGE[0], end=RANGE[1])


@oracle("a4_timeline")
def a4_sql():
    return f"""
    SELECT event_id, ts, user_id, event_type, value, props,
           lag(ts) OVER (ORDER BY ts, event_id) AS prev_ts,
           date_diff('microsecond', lag(ts) OVER (ORDER BY ts, event_id), ts) / 1e6 AS gap_seconds
    FROM events WHERE event_type = 'error'
      AND ts BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'"""


@query("a5_technical_mentions")
def a5(spark, sf):
    return A.technical_mentions(_docs(spark, sf))


@oracle("a5_technical_mentions")
def a5_sql():
    units = "[" + ", ".join(D.q(u) for u in A.UNITS) + "]"
    unit_re = D.q(r"^[0-9]+(\.[0-9]+)?(" + "|".join(A.UNITS) + r")\z")
    num = D.q(r"^[0-9]+(\.[0-9]+)?\z")
    kind = (f"CASE WHEN regexp_matches(t_, {D.q(r'^[vV]?[0-9]+(\.[0-9]+)+\z')}) THEN 'version' "
            f"WHEN regexp_matches(lower(t_), {unit_re}) THEN 'quantity' "
            f"WHEN regexp_matches(t_, {num}) AND list_contains({units}, lower(toks[i_ + 1])) THEN 'quantity' "
            f"WHEN regexp_matches(t_, {D.q(r'^[A-Z]{2,}[-_]?[0-9]+\z')}) THEN 'identifier' END")
    mention = (f"CASE WHEN regexp_matches(t_, {num}) AND list_contains({units}, lower(toks[i_ + 1])) "
               f"THEN t_ || ' ' || toks[i_ + 1] ELSE t_ END")
    strip = D.q(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+\z")
    return with_(SENTS_SQL, f"""tk AS (SELECT doc_id, pos,
        list_transform({D.words('sentence')}, lambda w_: regexp_replace(w_, {strip}, '', 'g')) AS toks
        FROM sents)""", f"""f AS (SELECT doc_id, pos, list_filter(list_transform(toks,
        lambda t_, i_: {{'kind': {kind}, 'mention': {mention}}}), lambda s_: s_.kind IS NOT NULL) AS found
        FROM tk)""") + """
    SELECT doc_id, pos, CAST(generate_subscripts(found, 1) - 1 AS BIGINT) AS i,
           unnest(found).kind AS kind, unnest(found).mention AS mention FROM f"""


@query("a6_sentiment")
def a6(spark, sf):
    return A.sentiment(_labelled(spark, sf), derived.lexicon(spark, sf), "quality")


@oracle("a6_sentiment")
def a6_sql():
    return with_(LEXICON_SQL,
                 f"""t AS (SELECT d.doc_id, l.quality, unnest({terms_sql('d.text')}) AS term
        FROM documents d LEFT JOIN labels l USING (doc_id))""", """pd AS (
        SELECT doc_id, quality, sum(coalesce(polarity, 0)) / count(*) AS score
        FROM t LEFT JOIN lex ON lex.word = t.term GROUP BY doc_id, quality)""") + """
    SELECT quality, count(*) AS n_docs, round(avg(score), 6) AS mean_score,
           round(min(score), 6) AS min_score, round(max(score), 6) AS max_score
    FROM pd GROUP BY quality"""


@query("a7_trend")
def a7(spark, sf):
    return A.trend(table(spark, sf, "events"), F.col("event_type") == "click",
                   fill=True)


def _trend_sql(match, unit, step, label, first, last, window=3):
    return f"""
    WITH sel AS (SELECT date_trunc('{unit}', ts) AS p FROM events WHERE {match}),
    calendar AS (SELECT unnest(generate_series({first}, {last}, INTERVAL {step})) AS p)
    SELECT {label} AS period, n, n - lag(n) OVER (ORDER BY p) AS change,
           round(avg(n) OVER (ORDER BY p ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW), 6)
               AS moving_avg
    FROM (SELECT c.p, count(sel.p) AS n FROM calendar c LEFT JOIN sel ON sel.p = c.p GROUP BY c.p)"""


@oracle("a7_trend")
def a7_sql():
    return _trend_sql("event_type = 'click'", "day", "1 DAY", "CAST(p AS DATE)",
                      "(SELECT min(p) FROM sel)", "(SELECT max(p) FROM sel)")


@query("a7_trend_hours")
def a7_hours(spark, sf):
    """Purchases of one user in twenty, by the hour over a fixed range: most hours have none."""
    return A.trend(table(spark, sf, "events"),
                   (F.col("event_type") == "purchase") & (F.col("user_id") % 20 == 0), period="hour",
                   window=24, start="2023-12-30 06:00:00", end="2024-01-20 17:30:00")


@oracle("a7_trend_hours")
def a7_hours_sql():
    return _trend_sql(
        "event_type = 'purchase' AND user_id % 20 = 0 AND ts >= TIMESTAMP '2023-12-30 06:00:00' "
        "AND ts <= TIMESTAMP '2024-01-20 17:30:00'", "hour", "1 HOUR", "p",
        "TIMESTAMP '2023-12-30 06:00:00'", "TIMESTAMP '2024-01-20 17:00:00'", 24)


@query("a8_recommendations")
def a8(spark, sf):
    return A.recommendations(_docs(spark, sf))


@oracle("a8_recommendations")
def a8_sql():
    words = "[" + ", ".join(D.q(w) for w in A.DIRECTIVE_WORDS) + "]"
    low = f"' ' || array_to_string({terms_sql('sentence')}, ' ') || ' '"
    phrases = " OR ".join(f"contains({low}, {D.q(' ' + p + ' ')})" for p in A.DIRECTIVE_PHRASES)
    return with_(SENTS_SQL) + f"""
    SELECT doc_id, pos, sentence FROM sents
    WHERE list_has_any({terms_sql('sentence')}, {words}) OR {phrases}"""


# --- analyses of chosen file types and dates ----------------------------------------------

def _dated(spark, sf):
    cat = derived.catalog(spark, sf).select(F.col("id").alias("doc_id"), "file_type", "created_at")
    return _docs(spark, sf).join(cat, "doc_id")


def _chosen_sql(types=True, dates=True, term=None):
    """The CTE ``chosen`` (doc_id, text, file_type) and the rules that pick its documents; materialised,
    as DuckDB fails on the inlined join."""
    rules = []
    if types:
        rules.append("c.file_type IN (" + ", ".join(D.q(t) for t in TYPES) + ")")
    if dates:
        rules.append(f"c.created_at BETWEEN TIMESTAMP '{DATES['start']}' AND "
                     f"TIMESTAMP '{DATES['end']}'")
    if term:
        rules.append(f"list_contains({terms_sql('d.text')}, {D.q(term)})")
    return CATALOG + f""", chosen AS MATERIALIZED (SELECT d.doc_id, d.text, c.file_type FROM documents d
        JOIN catalog c ON c.id = d.doc_id WHERE {' AND '.join(rules)})"""


def _of_chosen(sql: str) -> str:
    return sql.replace("FROM documents", "FROM chosen")


@query("a1_summarise_chosen")
def a1_chosen(spark, sf):
    return A.summarise(_dated(spark, sf), n=2, topic=ASPECT, filters={"date_range": DATES})


@oracle("a1_summarise_chosen")
def a1_chosen_sql():
    rest = _of_chosen(a1_sql().removeprefix("WITH ")).replace("r_ <= 3", "r_ <= 2")
    return with_(_chosen_sql(types=False, term=ASPECT), rest)


@query("a2_compare_chosen")
def a2_chosen(spark, sf):
    return A.compare(_dated(spark, sf), ASPECT, "file_type", filters={"date_range": DATES})


@oracle("a2_compare_chosen")
def a2_chosen_sql():
    return with_(_chosen_sql(types=False), f"""t AS (
        SELECT doc_id, file_type, unnest({terms_sql('text')}) AS term FROM chosen)""", f"""g AS (
        SELECT file_type, count(DISTINCT doc_id) AS n_docs, count(*) AS n_terms,
               CAST(sum(CASE WHEN term = '{ASPECT}' THEN 1 ELSE 0 END) AS BIGINT) AS n_aspect
        FROM t GROUP BY file_type)""") + """
    SELECT file_type, n_docs, n_terms, n_aspect, round(n_aspect / n_terms, 6) AS rate,
           round(sum(n_aspect) OVER () / sum(n_terms) OVER (), 6) AS overall_rate,
           round(n_aspect / n_terms - sum(n_aspect) OVER () / sum(n_terms) OVER (), 6) AS diff
    FROM g"""


@query("a3_key_terms_chosen")
def a3_chosen(spark, sf):
    return A.key_terms(_dated(spark, sf), n=5, subject=ASPECT, filters={"file_type": TYPES})


@oracle("a3_key_terms_chosen")
def a3_chosen_sql():
    return with_(_chosen_sql(dates=False, term=ASPECT), _of_chosen(TFIDF_SQL)) + """
    SELECT doc_id, rank, term, tf, round(tfidf, 6) AS tfidf FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 9) DESC, term)
                     AS BIGINT) AS rank FROM tfidf) WHERE rank <= 5"""


@query("a5_technical_chosen")
def a5_chosen(spark, sf):
    return A.technical_mentions(_dated(spark, sf), filters={"file_type": TYPES})


@oracle("a5_technical_chosen")
def a5_chosen_sql():
    return with_(_chosen_sql(dates=False), _of_chosen(a5_sql().removeprefix("WITH ")))


@query("a6_sentiment_chosen")
def a6_chosen(spark, sf):
    return A.sentiment(_dated(spark, sf), derived.lexicon(spark, sf), "file_type", topic=ASPECT,
                       filters={"date_range": DATES})


@oracle("a6_sentiment_chosen")
def a6_chosen_sql():
    return with_(_chosen_sql(types=False, term=ASPECT), LEXICON_SQL, f"""t AS (
        SELECT doc_id, file_type, unnest({terms_sql('text')}) AS term FROM chosen)""", """pd AS (
        SELECT doc_id, file_type, sum(coalesce(polarity, 0)) / count(*) AS score
        FROM t LEFT JOIN lex ON lex.word = t.term GROUP BY doc_id, file_type)""") + """
    SELECT file_type, count(*) AS n_docs, round(avg(score), 6) AS mean_score,
           round(min(score), 6) AS min_score, round(max(score), 6) AS max_score
    FROM pd GROUP BY file_type"""
