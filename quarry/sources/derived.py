"""Tables derived from the supplied ones (FIXTURES §2), built by Spark from whole tables.

The same definitions are written in SQL for the DuckDB oracle (quarry.registry.oracle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import words
from quarry.functions.urls import url_host
from quarry.operators.chunk import window_count, chunk_words
from quarry.plans.ordered import neighbours, with_sequence
from quarry.sources.tables import table

# Extension by doc_id % 4 for the catalog.
CATALOG_EXTS = ["pdf", "md", "txt", "html"]
EPOCH = "2024-01-01 00:00:00"


def _ext_by_mod(idcol, exts):
    e = F.element_at(F.array(*[F.lit(x) for x in exts]), (idcol % len(exts) + 1).cast("int"))
    return e


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows from documents: id, filename doc_<id>.<ext>, created_at = epoch + id hours,
    total_chunks = C3 count; status from the insert rule (S8)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.size(words("text")).alias("_n"))
    ext = _ext_by_mod(F.col("doc_id"), CATALOG_EXTS)
    total = window_count(F.col("_n"))
    created = F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.col("doc_id").cast("int"))
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("filename"),
        ext.alias("file_type"),
        F.lit(None).cast("string").alias("summary"),
        F.to_json(F.struct("lang", "source")).alias("metadata"),
        F.when(total > 1, "processing").otherwise("completed").alias("processing_status"),
        total.alias("total_chunks"),
        F.lit(0).cast("bigint").alias("processed_chunks"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three progress events per catalog row (by id % 3), plus events for ids that
    are not in the catalog (id % 50 = 0, shifted by 10^9). The last event ends at
    total_chunks, one below it when id % 5 = 0, and carries status 'failed' when
    id % 17 = 0."""
    cat = catalog(spark, sf_dir).select("id", "total_chunks", "created_at")
    n = (F.col("id") % 3 + 1)
    ev = cat.select("*", n.alias("n"), F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("k"))
    last = F.col("k") == F.col("n")
    processed = (F.when(last & (F.col("id") % 5 == 0),
                        F.greatest(F.col("total_chunks") - 1, F.lit(0)))
                 .when(last, F.col("total_chunks"))
                 .otherwise(F.floor(F.col("total_chunks") * F.col("k") / F.col("n"))))
    known = ev.select(
        (F.col("id") * 10 + F.col("k")).cast("bigint").alias("event_id"),
        F.col("id").alias("doc_id"),
        F.col("k").cast("bigint").alias("seq"),
        (F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("k") * 7)
         ).alias("event_ts"),
        processed.cast("bigint").alias("processed_chunks"),
        F.when(last & (F.col("id") % 17 == 0), F.lit("failed")).alias("status"),
    )
    unknown = cat.filter(F.col("id") % 50 == 0).select(
        (F.col("id") * 10 + 9).cast("bigint").alias("event_id"),
        (F.col("id") + 1_000_000_000).alias("doc_id"),
        F.lit(1).cast("bigint").alias("seq"),
        F.col("created_at").alias("event_ts"),
        F.col("total_chunks").alias("processed_chunks"),
        F.lit(None).cast("string").alias("status"),
    )
    return known.unionByName(unknown)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src = page url; dst = the next and the one-after-next page of the same host by
    page_id. Built with a global sequence (range partitioning) instead of a window per
    host, so a host holding a third of all pages is still spread over many tasks."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    pages = pages.withColumn("host", url_host("url"))
    seq = with_sequence(pages, [F.col("host"), F.col("page_id")])
    nb = neighbours(seq, [1, 2], ["url"], same=["host"], prefix="nxt")
    return nb.select(F.col("url").alias("src"), F.col("nxt_url").alias("dst"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 chunks of documents with catalog metadata and the embedding of vec_id =
    doc_id % (number of embeddings)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cat = catalog(spark, sf_dir).select(F.col("id").alias("doc_id"), "filename", "file_type",
                                        "created_at")
    ch = chunk_words(docs.join(cat, "doc_id"), "text")
    emb = table(spark, sf_dir, "embeddings")
    n_emb = emb.count()
    return ch.withColumn("vec_id", F.col("doc_id") % n_emb).join(
        emb.select("vec_id", "embedding"), "vec_id").drop("vec_id")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload-like rows from documents: (doc_id, filename, file_type, length, text).
    Names cycle through doc_<id>.pdf / .MD / notes.<id>.txt / .html / .exe / README_<id>
    (no dot) / bundle_<id>.ZIP by doc_id % 7; length is the UTF-8 size, except
    doc_id % 50 = 0 → 10485760 (exactly the cap) and doc_id % 50 = 1 → 10485761."""
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    m = F.col("doc_id") % 7
    name = (F.when(m == 0, F.concat(F.lit("doc_"), i, F.lit(".pdf")))
            .when(m == 1, F.concat(F.lit("doc_"), i, F.lit(".MD")))
            .when(m == 2, F.concat(F.lit("notes."), i, F.lit(".txt")))
            .when(m == 3, F.concat(F.lit("doc_"), i, F.lit(".html")))
            .when(m == 4, F.concat(F.lit("doc_"), i, F.lit(".exe")))
            .when(m == 5, F.concat(F.lit("README_"), i))
            .otherwise(F.concat(F.lit("bundle_"), i, F.lit(".ZIP"))))
    length = (F.when(F.col("doc_id") % 50 == 0, F.lit(10485760))
              .when(F.col("doc_id") % 50 == 1, F.lit(10485761))
              .otherwise(F.octet_length("text"))).cast("bigint")
    from quarry.functions.validate import file_type_of
    return docs.select("doc_id", name.alias("filename"), file_type_of(name).alias("file_type"),
                       length.alias("length"), "text")


def lexicon(spark: SparkSession, sf_dir: str, n: int = 40) -> DataFrame:
    """The ``n`` most frequent terms (lower-cased letter/digit runs) of documents, ties by
    word; polarity +1 for odd rank, -1 for even rank."""
    from quarry.operators.analyses import terms
    docs = table(spark, sf_dir, "documents")
    toks = docs.select(F.explode(terms("text")).alias("word"))
    freq = toks.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = freq.orderBy(F.desc("n"), "word").limit(n)  # a top-n report: the limit is the feature
    from pyspark.sql import Window
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "word")))
    return ranked.select("word", F.when(F.col("rank") % 2 == 1, 1).otherwise(-1).alias(
        "polarity"))


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied pages inside elements nested in their own kind, with ``>`` in attribute values:
    a menu in a menu, the page (its articles made sections) in a div in a div whose class marks
    the main text, up to 40 divs deep by page_id, and text outside of it. Its links carry a title
    with a tag in it."""
    n = F.col("page_id").cast("string")
    deep = (F.col("page_id") % 40).cast("int")
    inner = F.replace(F.replace("html", F.lit("article"), F.lit("section")), F.lit("<a href"),
                      F.lit('<a title="x > <a href=y>" href'))
    html = F.concat(
        F.lit('<html><head><title data-n="1 > 0">Page '), n, F.lit(' inside</title><meta title="a > b" '
              'name="description" content="more > less '), n, F.lit('"></head><body class="x > y">'
              '<nav title="m > n">menu <nav>sub <a title="<a href=z>" href="/menu/'), n,
        F.lit('">entry</a></nav> end of the menu here</nav><div title="<div class=content>">'
              '<div data-t="p > q" class="page-content">'),
        F.repeat(F.lit('<div title="</div>">'), deep), inner, F.repeat(F.lit("</div>"), deep),
        F.lit('<p title="z > y">closing words of page '), n,
        F.lit("</p></div><p>text outside of the region</p></div><footer><footer>f</footer>foot of "
              "the page</footer></body></html>"))
    return table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))
