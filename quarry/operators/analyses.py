"""Corpus analyses (A1-A8): deterministic Spark jobs behind the reference's analysis templates.

Shared building blocks:
* ``terms``: lower-cased letter/digit runs of a text;
* ``sentences``: a text cut after ., ! or ? followed by whitespace;
* ``tfidf``: (doc, term, tf, df, tfidf) with idf = ln(N / df). Texts are cut into terms once: the
  (doc, term, tf) counts are a written table. Document frequencies are partial aggregates over
  it, joined back with hot terms salted (``weighted``).

``filters`` (as in ``catalog.apply_filters``: file types and a date range) choose the documents of
an analysis before anything else, so they reach the scan; all counts are then over these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import PY_WS, col_, py_strip, words
from quarry.operators.catalog import apply_filters
from quarry.plans.ordered import lag_column, with_sequence
from quarry.session import scratch_path

TERM_SPLIT = r"[^\p{L}\p{N}]+"
SENTENCE_END = rf"([.!?]){PY_WS}+"
MARK = "\x01"
RANK_DIGITS = 9
#: Terms of over 1/HOT_SHARE of all (document, term) rows, and of over HOT_ROWS rows, are salted.
HOT_SHARE = 1000
HOT_ROWS = 100_000
#: Document frequencies that are broadcast, the most frequent terms first.
MAX_BROADCAST_TERMS = 500_000

# Directive cues marking a recommendation (A8), matched on whole lower-cased
# words, and two-word cues matched as phrases.
DIRECTIVE_WORDS = ["should", "must", "recommend", "recommended", "recommends", "recommendation",
                   "advise", "advised", "suggest", "suggested", "suggests", "ought"]
DIRECTIVE_PHRASES = ["need to", "have to", "best practice"]
# Units recognised after a number (A5).
UNITS = ["%", "ms", "s", "kb", "mb", "gb", "tb", "hz", "khz", "mhz", "ghz", "px", "kg", "g", "km",
         "m", "cm", "mm"]


def terms(c) -> Column:
    return F.filter(F.split(F.lower(col_(c)), TERM_SPLIT), lambda t: t != "")


def sentences(c) -> Column:
    """array<string> of sentences (stripped; empty ones kept so positions are stable)."""
    marked = F.regexp_replace(col_(c), SENTENCE_END, "$1" + MARK)
    return F.transform(F.split(marked, MARK), py_strip)


def doc_terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.explode(terms(text)).alias("term"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def weighted(tf: DataFrame, n_docs: int, key: str = "doc_id", hot_share: int = HOT_SHARE,
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, term, tf, df, tfidf) of the counts ``tf`` (key, term, tf and maybe more; read several
    times, so a stored table). The frequencies of the ``MAX_BROADCAST_TERMS`` most frequent terms are
    broadcast to the rows, which stay where they are. Any other term's rows are joined to its document frequency in one piece, or, where they
    exceed both 1/``hot_share`` of all rows and ``hot_rows``, in as many salted pieces as keep
    each within that size: no task holds a hot term. At most ``hot_share`` terms can be hot, so
    their salts (a hash and a number each) are a broadcast of bounded size."""
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    most = max(hot_rows, -(-tf.count() // hot_share))
    df = _written(df, "term-docs")
    value = (F.col("tf") * F.log(F.lit(float(n_docs)) / F.col("df"))).alias("tfidf")
    rest = [c for c in tf.columns if c not in (key, "term", "tf")]
    cols = [key, "term", "tf", *rest, "df", value]
    # The most frequent terms, most of all rows, are a broadcast; the rest is joined by its terms.
    often = df if df.count() <= MAX_BROADCAST_TERMS else _written(
        df.orderBy(F.desc("df"), "term").limit(MAX_BROADCAST_TERMS), "often")
    seldom = df.join(F.broadcast(often.select("term")), "term", "left_anti")
    hot = F.broadcast(seldom.filter(F.col("df") > most).groupBy(F.xxhash64("term").alias("_h")).agg(
        F.max(F.ceil(F.col("df") / most)).cast("int").alias("_n")))
    pieces = F.coalesce("_n", F.lit(1))
    left = (tf.join(F.broadcast(often.select("term")), "term", "left_anti")
            .withColumn("_h", F.xxhash64("term")).join(hot, "_h", "left")
            .withColumn("_salt", F.pmod(F.xxhash64(F.col(key)), pieces).cast("int"))
            .drop("_h", "_n"))
    right = (seldom.withColumn("_h", F.xxhash64("term")).join(hot, "_h", "left")
             .select("term", "df", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("_salt")))
    return tf.join(F.broadcast(often), "term").select(*cols).unionByName(
        left.join(right, ["term", "_salt"]).select(*cols))


def _by_document(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A document's terms are counted in the task that holds it: texts are shuffled, not terms."""
    return docs.select(key, text).repartition(key)


def tfidf(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_share: int = HOT_SHARE,
          hot_rows: int = HOT_ROWS) -> DataFrame:
    tf = _written(doc_terms(_by_document(docs, key, text), key, text).groupBy(key, "term").agg(
        F.count(F.lit(1)).alias("tf")), "term-counts")
    return weighted(tf, docs.count(), key, hot_share, hot_rows)


def key_terms(docs: DataFrame, n: int = 5, key: str = "doc_id", text: str = "text",
              subject: str | None = None, filters: dict | None = None) -> DataFrame:
    """A3: the ``n`` highest TF-IDF terms of each document (ties by term); with
    ``subject``, only documents that contain that term."""
    docs = apply_filters(docs, filters)
    if subject:
        docs = docs.filter(F.array_contains(terms(text), subject.lower()))
    t = tfidf(docs, key, text)
    w = Window.partitionBy(key).orderBy(F.desc(F.round("tfidf", RANK_DIGITS)), "term")
    return (t.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .filter(F.col("rank") <= n)
            .select(key, "rank", "term", "tf", F.round("tfidf", 6).alias("tfidf")))


def summarise(docs: DataFrame, n: int = 3, key: str = "doc_id", text: str = "text",
              topic: str | None = None, filters: dict | None = None) -> DataFrame:
    """A1: extractive summary - the ``n`` sentences with the highest mean TF-IDF of their
    terms, returned with their position so they read in the original order. ``key`` is unique.

    Terms are counted per document once (a written table), with the sentences that hold them: a
    term never spans two. The texts are read again for the chosen positions only."""
    docs = apply_filters(docs, filters)
    if topic:
        docs = docs.filter(F.array_contains(terms(text), topic.lower()))
    cut = sentences(text)
    found = (_by_document(docs, key, text)
             .select(key, F.posexplode(cut).alias("pos", "sentence"))
             .select(key, "pos", F.explode(terms("sentence")).alias("term")))
    tf = _written(found.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"),
                                                 F.collect_list("pos").alias("at")), "term-counts")
    scored = (weighted(tf, docs.count(), key).select(key, "tfidf", F.explode("at").alias("pos"))
              .groupBy(key, "pos").agg((F.sum("tfidf") / F.count(F.lit(1))).alias("score")))
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", RANK_DIGITS)), "pos")
    top = scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return top.join(docs.select(key, cut.alias("_sentences")), key).select(
        key, F.col("pos").cast("bigint").alias("pos"),
        F.element_at("_sentences", F.col("pos") + 1).alias("sentence"),
        F.round("score", 6).alias("score"))


def compare(docs: DataFrame, aspect: str, by: str, key: str = "doc_id",
            text: str = "text", filters: dict | None = None) -> DataFrame:
    """A2: how often ``aspect`` occurs per group of ``by`` against the whole corpus."""
    t = apply_filters(docs, filters).select(key, by, F.explode(terms(text)).alias("term"))
    g = t.groupBy(by).agg(
        F.count_distinct(key).alias("n_docs"),
        F.count(F.lit(1)).alias("n_terms"),
        F.sum(F.when(F.col("term") == aspect.lower(), 1).otherwise(0)).cast("bigint").alias(
            "n_aspect"))
    everything = Window.partitionBy()  # one row per group: tiny
    overall = F.sum("n_aspect").over(everything) / F.sum("n_terms").over(everything)
    rate = F.col("n_aspect") / F.col("n_terms")
    return g.select(by, "n_docs", "n_terms", "n_aspect", F.round(rate, 6).alias("rate"),
                    F.round(overall, 6).alias("overall_rate"),
                    F.round(rate - overall, 6).alias("diff"))


def timeline(rows: DataFrame, match: Column, ts: str = "ts", tie: str = "event_id",
             start=None, end=None) -> DataFrame:
    """A4: matching rows in time order with the gap (seconds) to the previous match. The
    order is a global sequence (range partitioning), not a single-partition window."""
    sel = rows.filter(match)
    if start is not None:
        sel = sel.filter(F.col(ts).between(F.lit(start).cast("timestamp_ntz"),
                                           F.lit(end).cast("timestamp_ntz")))
    seq = with_sequence(sel, [F.col(ts), F.col(tie)])
    out = lag_column(seq, ts, "prev_ts")
    gap = F.expr(f"timestampdiff(MICROSECOND, prev_ts, {ts})") / F.lit(1e6)
    return out.select(*[c for c in sel.columns], "prev_ts", gap.alias("gap_seconds"))


def technical_mentions(docs: DataFrame, key: str = "doc_id", text: str = "text",
                       term: str | None = None, filters: dict | None = None) -> DataFrame:
    """A5: versions, numbers with units and upper-case identifiers in sentences (that
    mention ``term``), one row per mention with its kind."""
    sents = apply_filters(docs, filters).select(key, F.posexplode(sentences(text)).alias("pos", "sentence"))
    if term:
        sents = sents.filter(F.array_contains(terms("sentence"), term.lower()))
    sents = sents.select(key, "pos", F.transform(words("sentence"), lambda w: F.regexp_replace(
        w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+\z", "")).alias("_toks"))
    toks = F.col("_toks")  # materialised: the lambdas below index into it
    units = F.array(*[F.lit(u) for u in UNITS])

    def kind(t, i):
        nxt = F.lower(F.try_element_at(toks, i + 2))
        return (F.when(t.rlike(r"^[vV]?[0-9]+(\.[0-9]+)+\z"), F.lit("version"))
                .when(F.lower(t).rlike(r"^[0-9]+(\.[0-9]+)?(" + "|".join(UNITS) + r")\z"),
                      F.lit("quantity"))
                .when(t.rlike(r"^[0-9]+(\.[0-9]+)?\z") & F.array_contains(units, nxt),
                      F.lit("quantity"))
                .when(t.rlike(r"^[A-Z]{2,}[-_]?[0-9]+\z"), F.lit("identifier")))

    def mention(t, i):
        nxt = F.try_element_at(toks, i + 2)
        paired = t.rlike(r"^[0-9]+(\.[0-9]+)?\z") & F.array_contains(units, F.lower(nxt))
        return F.when(paired, F.concat(t, F.lit(" "), nxt)).otherwise(t)

    found = F.filter(F.transform(toks, lambda t, i: F.struct(
        kind(t, i).alias("kind"), mention(t, i).alias("mention"))), lambda s: s["kind"].isNotNull())
    return sents.select(key, F.col("pos").cast("bigint").alias("pos"),
                        F.posexplode(found).alias("i", "m")).select(
        key, "pos", F.col("i").cast("bigint").alias("i"), "m.kind", "m.mention")


def sentiment(docs: DataFrame, lexicon: DataFrame, by: str, key: str = "doc_id",
              text: str = "text", topic: str | None = None, filters: dict | None = None
              ) -> DataFrame:
    """Document score = sum of lexicon polarities of its terms / number of terms;
    per group: documents, mean, min and max score. With ``topic``, only documents that contain
    that term."""
    docs = apply_filters(docs, filters)
    if topic:
        docs = docs.filter(F.array_contains(terms(text), topic.lower()))
    t = docs.select(key, by, F.posexplode(terms(text)).alias("i", "term"))
    lex = lexicon.select(F.col("word").alias("term"), "polarity")  # AQE sizes the join
    scored = t.join(lex, "term", "left")
    per_doc = scored.groupBy(key, by).agg(
        (F.sum(F.coalesce("polarity", F.lit(0))) / F.count(F.lit(1))).alias("score"))
    return per_doc.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.min("score"), 6).alias("min_score"),
        F.round(F.max("score"), 6).alias("max_score"))


#: Periods that start at midnight: their label is a date, shorter ones keep the time.
WHOLE_DAYS = {"day", "dd", "week", "month", "mon", "mm", "quarter", "year", "yyyy", "yy"}


#: Steps of the calendar for names of periods that no interval has.
PERIOD_STEPS = {"day": "1 day", "dd": "1 day", "week": "7 days", "month": "1 month",
                "mon": "1 month", "mm": "1 month", "quarter": "3 months", "year": "1 year",
                "yyyy": "1 year", "yy": "1 year", "hour": "1 hour", "minute": "1 minute",
                "second": "1 second"}


def trend(rows: DataFrame, match: Column, ts: str = "ts", period: str = "day",
          window: int = 3, start=None, end=None, fill: bool | None = None) -> DataFrame:
    """Matching rows per period, change from the previous period and the moving average over
    the last ``window`` periods. With ``fill`` (by default when a range is given) every period
    between the first and the last one has a row, with 0 where nothing matches: of the matching rows,
    or of the range ``start`` to ``end`` (both included). Without it, only periods with matches have
    rows, and the previous period is the previous row. Windows run over the periods (one row each),
    not over the rows."""
    fill = (start is not None or end is not None) if fill is None else fill

    def floor(c: Column) -> Column:
        return F.date_trunc(period, c.cast("timestamp_ntz"))
    sel = rows.filter(match & F.col(ts).isNotNull())
    first, last = F.min(floor(F.col(ts))), F.max(floor(F.col(ts)))
    if start is not None:
        sel = sel.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
        first = floor(F.lit(start))
    if end is not None:
        sel = sel.filter(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
        last = floor(F.lit(end))
    found = sel.groupBy(floor(F.col(ts)).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    per = found
    if fill:
        unit = PERIOD_STEPS.get(period.lower(), period)
        edges = sel.agg(first.alias("a"), last.alias("b")).filter("a IS NOT NULL AND b >= a")
        calendar = edges.select(F.explode(F.expr(f"sequence(a, b, interval {unit})"))
                                .alias("period"))
        per = calendar.join(found, "period", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if period.lower() in WHOLE_DAYS:
        per = per.withColumn("period", F.to_date("period"))
    w = Window.orderBy("period")
    return per.select("period", "n", (F.col("n") - F.lag("n").over(w)).alias("change"),
                      F.round(F.avg("n").over(w.rowsBetween(-(window - 1), 0)), 6).alias(
                          "moving_avg"))


def recommendations(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    topic: str | None = None) -> DataFrame:
    """Sentences with a directive cue (about ``topic`` when given)."""
    sents = docs.select(key, F.posexplode(sentences(text)).alias("pos", "sentence"))
    t = terms("sentence")
    cue = F.arrays_overlap(t, F.array(*[F.lit(w) for w in DIRECTIVE_WORDS]))
    low = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    for p in DIRECTIVE_PHRASES:
        cue = cue | F.contains(low, F.lit(f" {p} "))
    if topic:
        cue = cue & F.array_contains(t, topic.lower())
    return sents.filter(cue).select(key, F.col("pos").cast("bigint").alias("pos"), "sentence")
