"""Bounded breadth-first crawl inside one host, for many start URLs at once.

Pages that yield text ("ok") are numbered in url order; the filtered links between them are edges of
numbers (links of failed pages are never followed, failed pages are never counted, so neither needs
a row). The crawl then goes by strides of several levels, not by one job per level:

1. ``balls``: for every page the pages within 1, 2, 4, ... up to ``STRIDE`` links, (u, v, d), found
   by doubling: what lies L links away is joined with what lies within L links of that. With
   ``max_pages`` = P each page keeps its P nearest only. That loses nothing: whatever lies nearer to
   a page on the way also lies nearer to the start, so a page outside the P nearest of one on the
   way is outside the P nearest of the start.
2. From the starts, the pages at exactly the last depth reached are joined with their balls; what
   wasn't known is the next stride. Starts that have P pages go no further.

A start takes depth / stride rounds; each is a few joins whose sizes follow starts x P. Doubling stops
early where the balls would exceed ``BALL_ROWS`` rows a page on average, and isn't done without
``max_pages`` (a ball could be the whole host): the stride is one level then. The driver only reads
counts. Every round is written once to the session's shared checkpoint folder, so a lost executor
recomputes one round at most and plans stay small.

Semantics per start: pages missing from ``pages`` or without text are visited but not counted;
the crawl of a start covers the whole host, or the first ``max_pages`` pages by (depth, url). Within
a level the reference's order comes from a set; this one is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.urls import url_ok
from quarry.operators.web import crawlable_links, scrape
from quarry.plans.ordered import SEQ, with_sequence
from quarry.session import checkpoint_dir, scratch_path

STRIDE = 16               # levels of one round
BALL_ROWS = 32            # rows a page on average, beyond which balls don't grow
MAX_BALL = 1_000          # pages of one ball; beyond that max_pages the stride is one level


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "crawl")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crawl_edges(ok_pages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, url) of the ok pages, numbered in url order, and (u, v), the links between them."""
    ok = _stored(ok_pages.select("url").distinct())
    nodes = _stored(with_sequence(ok, ["url"]).select(F.col(SEQ).alias("id"), "url"))
    ends = crawlable_links(links).select("src", "dst")
    edges = (ends.join(nodes.select(F.col("url").alias("src"), F.col("id").alias("u")), "src")
             .join(nodes.select(F.col("url").alias("dst"), F.col("id").alias("v")), "dst")
             .filter("u != v").select("u", "v").distinct())
    return nodes, _stored(edges)


def _nearest(rows: DataFrame, key: str, depth: str, n: int | None) -> DataFrame:
    """The ``n`` first rows of each ``key`` by (depth, page)."""
    if n is None:
        return rows
    w = Window.partitionBy(key).orderBy(depth, "v")
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def balls(edges: DataFrame, n_pages: int, max_pages: int | None, stride: int | None = None
          ) -> tuple[DataFrame, int]:
    """(u, v, d): the pages within some number of links of each page, nearest ``max_pages`` only, and
    that number."""
    ball, reach = edges.select("u", "v", F.lit(1).alias("d")), 1
    if max_pages is None or max_pages > MAX_BALL:
        return ball, reach
    ball = _stored(_nearest(ball, "u", "d", max_pages))
    while reach * 2 <= (stride or STRIDE) and ball.count() <= BALL_ROWS * n_pages:
        # Pages that have max_pages already are done: what lies further is of no use.
        far = (ball.groupBy("u").agg(
                   F.count(F.lit(1)).alias("n"),
                   F.collect_list(F.when(F.col("d") == reach, F.col("v"))).alias("rim"))
               .filter(F.col("n") < max_pages).select("u", F.explode("rim").alias("m")))
        onward = far.join(ball.select(F.col("u").alias("m"), "v", (F.col("d") + reach).alias("d")),
                          "m").filter("u != v").select("u", "v", "d")
        grown = ball.unionByName(onward).groupBy("u", "v").agg(F.min("d").alias("d"))
        ball, reach = _stored(_nearest(grown, "u", "d", max_pages)), reach * 2
    return ball, reach


def crawl(pages: DataFrame, links: DataFrame, starts: DataFrame | list[str],
          max_pages: int | None = None, max_levels: int | None = None,
          ok_pages: DataFrame | None = None, checkpoint_every: int = 8,
          stride: int | None = None) -> DataFrame:
    """Return (start, url, depth, rank) for the successful pages of each crawl: all of them, or
    the first ``max_pages``.

    ``pages``: (url, html); ``links``: (src, dst); ``starts``: start URLs (DataFrame with a
    ``start`` column, or a list). ``ok_pages`` (url) may be given when the scrape is already
    known. The rounds' results are joined into one every ``checkpoint_every`` rounds. Raises
    ValueError for a malformed start URL.
    """
    spark = pages.sparkSession
    checkpoint_dir(spark)
    if isinstance(starts, list):
        starts = spark.createDataFrame([(s,) for s in starts], "start string")
    starts = _stored(starts.select("start").distinct())
    bad = starts.filter(~url_ok("start")).limit(1).collect()
    if bad:
        raise ValueError(f"Invalid start URL: {bad[0][0]}")

    nodes, edges = crawl_edges(scrape(pages) if ok_pages is None else ok_pages, links)
    ball, reach = balls(edges, nodes.count(), max_pages, stride)

    at, rounds = 0, 0
    known = frontier = _stored(starts.join(nodes.withColumnRenamed("url", "start"), "start").select(
        F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("depth")))
    while max_levels is None or at + 1 < max_levels:
        nxt = (frontier.select("s", F.col("v").alias("u"), F.col("depth").alias("_from"))
               .join(ball, "u")
               .groupBy("s", "v").agg(F.min(F.col("_from") + F.col("d")).alias("depth"))
               .join(known.select("s", "v"), ["s", "v"], "left_anti"))
        nxt = _stored(_nearest(nxt, "s", "depth", max_pages))
        known = known.unionByName(nxt)
        at, rounds = at + reach, rounds + 1
        if rounds % checkpoint_every == 0:
            known = _stored(known)
        frontier = nxt.filter(F.col("depth") == at)
        if max_pages is not None:
            unfinished = known.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(
                F.col("n") < max_pages)
            frontier = frontier.join(unfinished.select("s"), "s")
        if frontier.isEmpty():
            break
    if max_levels is not None:
        known = known.filter(F.col("depth") < max_levels)
    found = _nearest(known, "s", "depth", max_pages)
    found = (found.join(nodes.select(F.col("id").alias("s"), F.col("url").alias("start")), "s")
             .join(nodes.select(F.col("id").alias("v"), "url"), "v"))
    if max_pages is not None:
        w = Window.partitionBy("start").orderBy("depth", "url")
        result = found.withColumn("rank", F.row_number().over(w).cast("bigint"))
    else:       # a whole host may be large: ranks from a global order, not from one task
        ordered = with_sequence(found.select("start", "url", "depth"), ["start", "depth", "url"])
        first = ordered.groupBy("start").agg(F.min(SEQ).alias("_first"))
        result = ordered.join(first, "start").withColumn(
            "rank", (F.col(SEQ) - F.col("_first") + 1).cast("bigint"))
    return _stored(result.select("start", "url", F.col("depth").cast("bigint").alias("depth"),
                                 "rank"))
