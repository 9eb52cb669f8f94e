"""Prompt assembly, query typing and result display.

A template is parsed once on the driver into literal pieces and field names and becomes a
single ``concat`` of literals and columns, so values that contain braces are never
re-interpreted and the expression stays native.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import col_

# Prompt texts, exactly as the reference sends them.
SUMMARY_PROMPT = ("Generate a comprehensive summary of the following text. \n"
                  "            Focus on key points, main ideas, and important details:\n\n"
                  "            {text}\n\n"
                  "            Summary:")
ANALYSIS_PROMPT = ("Analyze the following query and provide:\n"
                   "            1. The main intent or purpose\n"
                   "            2. Key concepts or entities mentioned\n"
                   "            3. Type of analysis requested (e.g., summary, comparison, timeline)\n"
                   "            4. Expected response format\n\n"
                   "            Query: {query}\n\n"
                   "            Analysis:")
REWORD_PROMPT = ("Generate similar queries based on the following query.\n\n"
                 "            Query: {query}\n\n"
                 "            Output: ({num_queries} queries)")
ANSWER_PROMPT = ("\n        Answer the following question based on this context:\n\n"
                 "        {context}\n\n"
                 "        Question: {query}\n        ")
IMAGE_PROMPT = "Provide a detailed description of this image."
IMAGE_URL_PREFIX = "data:image/jpeg;base64,"
SUMMARY_LIMIT = 4000
EXTRACT_LIMIT = 500
CONTEXT_SEPARATOR = ", "

# Query types and their cue substrings, tested in this order on the
# lower-cased query; the first hit wins, otherwise "semantic".
QUERY_TYPES = [
    ("comparative", ["compare", "difference", "versus", "vs"]),
    ("temporal", ["when", "timeline", "chronological"]),
    ("sentiment", ["sentiment", "opinion", "feel"]),
    ("trend", ["trend", "pattern", "change over time"]),
]

# The query templates (key, name, template, description, parameters).
TEMPLATES = [
    ("summary", "Document Summary",
     "Provide a comprehensive summary of {topic} from the documents",
     "Get a detailed summary about a specific topic", ["topic"]),
    ("comparison", "Compare Documents",
     "Compare and contrast how {aspect} is discussed in documents from {date_range}",
     "Compare how a specific aspect is covered across different documents",
     ["aspect", "date_range"]),
    ("key_insights", "Key Insights",
     "What are the key insights about {subject} mentioned in the {file_type} documents?",
     "Extract key insights about a specific subject", ["subject", "file_type"]),
    ("timeline", "Timeline Analysis",
     "Create a timeline of events related to {event} from the documents within {date_range}",
     "Generate a chronological analysis of events", ["event", "date_range"]),
    ("technical_details", "Technical Details",
     "Extract technical specifications and details about {technology} from {file_type} documents",
     "Get detailed technical information about a specific topic", ["technology", "file_type"]),
    ("sentiment_analysis", "Sentiment Analysis",
     "Analyze the sentiment and opinions about {topic} in documents from {date_range}",
     "Understand the overall sentiment and opinions on a specific topic",
     ["topic", "date_range"]),
    ("trend_analysis", "Trend Analysis",
     "Identify and analyze trends related to {subject} in {file_type} documents from {date_range}",
     "Track and analyze trends over time", ["subject", "file_type", "date_range"]),
    ("recommendations", "Recommendations",
     "What recommendations are given regarding {topic} in the documents?",
     "Extract recommendations and suggested actions", ["topic"]),
]
TEMPLATE_BY_KEY = {t[0]: t for t in TEMPLATES}


def _as_col(v) -> Column:
    if isinstance(v, Column):
        return v.cast("string")
    return F.lit(str(v))


def format_template(template: str, **params) -> Column:
    """``template.format(**params)`` as one ``concat``. Values are columns or literals;
    a missing parameter raises KeyError (as str.format does), extras are ignored."""
    parts: list[Column] = []
    for literal, field, spec, conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if field not in params:
                raise KeyError(field)
            parts.append(_as_col(params[field]))
    return F.concat(*parts) if parts else F.lit("")


def format_query(df: DataFrame, template_key: str, out: str = "query", **params) -> DataFrame:
    """L11 over a DataFrame: parameters name columns of ``df`` (str) or are Columns."""
    tpl = TEMPLATE_BY_KEY[template_key][2]
    cols = {k: (F.col(v) if isinstance(v, str) and v in df.columns else v)
            for k, v in params.items()}
    return df.withColumn(out, format_template(tpl, **cols))


def templates(spark: SparkSession) -> DataFrame:
    """The template catalog."""
    return spark.createDataFrame(
        [(k, n, t, d, p) for k, n, t, d, p in TEMPLATES],
        "key string, name string, template string, description string, parameters array<string>")


# The template that serves each query type (L2 → L12).
TEMPLATE_FOR_TYPE = [("comparative", "comparison"), ("temporal", "timeline"),
                     ("sentiment", "sentiment_analysis"), ("trend", "trend_analysis"),
                     ("semantic", "summary")]


def template_demand(spark: SparkSession, questions: DataFrame, text: str = "text") -> DataFrame:
    """L12 with usage: the template catalog and, per template, how many questions are of
    the query type it serves (L2). The catalog has 8 rows, so the join broadcasts a
    constant."""
    by_type = questions.select(classify_query(text).alias("query_type")).groupBy(
        "query_type").agg(F.count(F.lit(1)).alias("n_questions"))
    serve = spark.createDataFrame(TEMPLATE_FOR_TYPE, "query_type string, key string")
    demand = by_type.join(F.broadcast(serve), "query_type").select("key", "n_questions")
    cat = templates(spark).select("key", "name", "description",
                                  F.array_join("parameters", ",").alias("parameters"))
    return cat.join(F.broadcast(demand), "key", "left").select(
        "key", "name", "description", "parameters",
        F.coalesce("n_questions", F.lit(0)).cast("bigint").alias("n_questions"))


def summary_prompt(text, limit: int | None = None) -> Column:
    """L1: the summary prompt over the whole text, or over its first ``limit`` characters."""
    body = col_(text) if limit is None else F.substring(col_(text), 1, limit)
    return format_template(SUMMARY_PROMPT, text=body)


def classify_query(q) -> Column:
    """L2: query type by substring cues (so "vs" also matches inside words)."""
    low = F.lower(col_(q))
    expr = None
    for qtype, cues in QUERY_TYPES:
        hit = None
        for cue in cues:
            c = F.contains(low, F.lit(cue))
            hit = c if hit is None else (hit | c)
        expr = F.when(hit, F.lit(qtype)) if expr is None else expr.when(hit, F.lit(qtype))
    return expr.otherwise(F.lit("semantic"))


def analysis_prompt(q) -> Column:
    """L3."""
    return format_template(ANALYSIS_PROMPT, query=col_(q))


def build_context(results: DataFrame, key: str | list[str] = "qid", rank: str = "rank",
                  content: str = "page_content", out: str = "context") -> DataFrame:
    """L4: result texts of each question in rank order joined by ", " (groups are the k
    results of one question, so the list is bounded by k)."""
    keys = [key] if isinstance(key, str) else key
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"),
                                                   F.col(content).alias("c"))))
    return results.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda s: s["c"]), CONTEXT_SEPARATOR).alias(out))


def answer_prompt(context, question) -> Column:
    """Context plus the original question."""
    return format_template(ANSWER_PROMPT, context=col_(context), query=col_(question))


def reword_prompt(q, n: int = 4) -> Column:
    """L6."""
    return format_template(REWORD_PROMPT, query=col_(q), num_queries=n)


B64_RE = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"
B64_ERROR = "Invalid base64 data"


def encode_b64(b) -> Column:
    """Standard base64 without line breaks."""
    return F.regexp_replace(F.base64(col_(b)), r"[\r\n]", "")


def decode_b64(s) -> Column:
    """struct(data, error); whitespace is ignored, anything else invalid is an error."""
    t = F.regexp_replace(col_(s), r"[\t\n\r ]", "")
    ok = t.rlike(B64_RE)
    return F.struct(F.when(ok, F.unbase64(t)).alias("data"),
                    F.when(~ok, F.lit(B64_ERROR)).alias("error"))


def image_request(content) -> Column:
    """The chat message content for an image, as JSON (always image/jpeg, detail high)."""
    text_part = F.struct(F.lit("text").alias("type"), F.lit(IMAGE_PROMPT).alias("text"),
                         F.lit(None).cast("struct<url:string,detail:string>").alias("image_url"))
    img_part = F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"),
                        F.struct(F.concat(F.lit(IMAGE_URL_PREFIX), encode_b64(content)).alias("url"),
                                 F.lit("high").alias("detail")).alias("image_url"))
    return F.to_json(F.array(text_part, img_part))


def display_extract(content, filename=None, n: int = EXTRACT_LIMIT) -> tuple[Column, Column]:
    """(filename or 'Unknown', first ``n`` characters + '...' only when longer)."""
    c = col_(content)
    extract = F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
    name = F.coalesce(col_(filename), F.lit("Unknown")) if filename is not None else F.lit("Unknown")
    return name, extract
