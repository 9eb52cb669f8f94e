"""Registered prompt, query-typing, encoding and template queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import PY_WS
from quarry.functions.validate import validate_query
from quarry.operators import prompts as P
from quarry.registry import duck as D
from quarry.registry.oracle import oracle, with_
from quarry.registry.queries import query
from quarry.sources.tables import table


def _prompt_sql(template: str, **cols: str) -> str:
    """SQL concat for a template whose fields map to SQL expressions."""
    import string
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(D.q(literal))
        if field is not None:
            parts.append(f"CAST({cols[field]} AS VARCHAR)")
    return " || ".join(parts)


def _conv(spark, sf):
    return table(spark, sf, "conversations")


@query("v3_validate_query")
def v3(spark, sf):
    return _conv(spark, sf).select("conv_id", "turn", validate_query("text").alias("r")).select(
        "conv_id", "turn", "r.ok", "r.error")


@oracle("v3_validate_query")
def v3_sql():
    err = (f"CASE WHEN text IS NULL OR {D.rr('text', PY_WS + '+')} = '' THEN 'Query cannot be empty' "
           f"WHEN length(text) > 1000 THEN 'Query too long' END")
    return f"SELECT conv_id, turn, ({err}) IS NULL AS ok, coalesce({err}, '') AS error FROM conversations"


@query("l1_summary_prompt")
def l1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.summary_prompt("text").alias("prompt"))


@oracle("l1_summary_prompt")
def l1_sql():
    return (f"SELECT doc_id, {_prompt_sql(P.SUMMARY_PROMPT, text='text')} "
            f"AS prompt FROM documents")


@query("l2_classify_query")
def l2(spark, sf):
    return _conv(spark, sf).filter(F.col("role") == "user").select(
        "conv_id", "turn", P.classify_query("text").alias("query_type"))


@oracle("l2_classify_query")
def l2_sql():
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(text), {D.q(c)})" for c in cues) + f" THEN '{t}'"
        for t, cues in P.QUERY_TYPES)
    return (f"SELECT conv_id, turn, CASE {cases} ELSE 'semantic' END AS query_type "
            f"FROM conversations WHERE role = 'user'")


@query("l3_analysis_prompt")
def l3(spark, sf):
    return _conv(spark, sf).filter(F.col("role") == "user").select(
        "conv_id", "turn", P.analysis_prompt("text").alias("prompt"))


@oracle("l3_analysis_prompt")
def l3_sql():
    return (f"SELECT conv_id, turn, {_prompt_sql(P.ANALYSIS_PROMPT, query='text')} AS prompt "
            f"FROM conversations WHERE role = 'user'")


@query("l6_reword_prompt")
def l6(spark, sf):
    return _conv(spark, sf).filter(F.col("role") == "user").select(
        "conv_id", "turn", P.reword_prompt("text").alias("prompt"))


@oracle("l6_reword_prompt")
def l6_sql():
    return (f"SELECT conv_id, turn, {_prompt_sql(P.REWORD_PROMPT, query='text', num_queries='4')} "
            f"AS prompt FROM conversations WHERE role = 'user'")


@query("l8_base64")
def l8(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    enc = d.select("doc_id", "text", P.encode_b64(F.encode("text", "UTF-8")).alias("b64"))
    rt = P.decode_b64("b64")
    raw = P.decode_b64("text")
    return enc.select("doc_id", "b64",
                      (F.decode(rt["data"], "UTF-8") == F.col("text")).alias("round_trip"),
                      F.coalesce(raw["error"], F.lit("")).alias("raw_error"))


@oracle("l8_base64")
def l8_sql():
    t = D.rr("text", r"[\t\n\r ]")
    return f"""SELECT doc_id, to_base64(encode(text)) AS b64,
                      decode(from_base64(to_base64(encode(text)))) = text AS round_trip,
                      CASE WHEN {D.rm(t, P.B64_RE)} THEN '' ELSE {D.q(P.B64_ERROR)} END AS raw_error
               FROM documents"""


@query("l11_format_query")
def l11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return P.format_query(d, "key_insights", out="query", subject="source", file_type="lang"
                          ).select("doc_id", "query")


@oracle("l11_format_query")
def l11_sql():
    tpl = P.TEMPLATE_BY_KEY["key_insights"][2]
    return f"SELECT doc_id, {_prompt_sql(tpl, subject='source', file_type='lang')} AS query FROM documents"


@query("l12_templates")
def l12(spark, sf):
    users = _conv(spark, sf).filter(F.col("role") == "user")
    return P.template_demand(spark, users)


@oracle("l12_templates")
def l12_sql():
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(text), {D.q(c)})" for c in cues) + f" THEN '{t}'"
        for t, cues in P.QUERY_TYPES)
    cat = ", ".join(f"({D.q(k)}, {D.q(n)}, {D.q(d)}, {D.q(','.join(ps))})"
                    for k, n, _, d, ps in P.TEMPLATES)
    serve = ", ".join(f"({D.q(t)}, {D.q(k)})" for t, k in P.TEMPLATE_FOR_TYPE)
    return f"""
    WITH cat(key, name, description, parameters) AS (VALUES {cat}),
    serve(query_type, key) AS (VALUES {serve}),
    q AS (SELECT CASE {cases} ELSE 'semantic' END AS query_type FROM conversations WHERE role = 'user'),
    d AS (SELECT s.key, count(*) AS n_questions FROM q JOIN serve s USING (query_type) GROUP BY s.key)
    SELECT c.key, c.name, c.description, c.parameters,
           CAST(coalesce(d.n_questions, 0) AS BIGINT) AS n_questions
    FROM cat c LEFT JOIN d USING (key)"""
