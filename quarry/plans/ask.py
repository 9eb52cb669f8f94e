"""The ask flow for many questions at once.

questions (qid, question) → V3 → L6 reword prompt → client (rewordings) → R6 expanded text →
R1 embedding → R2 top-k over the index → R5 unique → L4 context → L5 answer prompt (with the
original question) → client (answer). Every step is a DataFrame operation; the two model calls
run in Arrow batches on the executors with per-row error capture (L7). The reworded, embedded
questions are checkpointed: the search reads them more than once, and a model asked again may
answer otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.validate import validate_query
from quarry.operators import prompts as P
from quarry.operators.embed import embed
from quarry.operators.generate import generate
from quarry.operators.search import search, unique_union
from quarry.session import checkpoint_dir


def expand_query(questions: DataFrame, client: Callable[[str], str], question: str = "question",
                 out: str = "expanded") -> DataFrame:
    """The questions with ``out``, each question followed by the client's rewordings of it on
    lines of their own, and ``reword_error``. A failed rewording leaves the question as it is; a
    null question stays null and is not sent."""
    asked = questions.withColumn("prompt", P.reword_prompt(question))
    got = generate(asked, client, out="_rewordings")
    text = F.when(F.col(question).isNotNull(), F.concat_ws("\n", question, "_rewordings"))
    return got.select(*questions.columns, text.alias(out), F.col("error").alias("reword_error"))


def ask(questions: DataFrame, index: DataFrame, embedder, client: Callable[[str], str],
        k: int = 5, ids: list[str] | None = None, filters: dict | None = None) -> DataFrame:
    """Return (qid, question, answer, error, context, results) per valid question; invalid
    questions come back with their validation error and no answer. A failed rewording leaves the
    question as it is and shows in ``error`` if the answer has none of its own. ``filters`` (as in
    ``apply_filters``) choose the chunks that are searched."""
    checkpoint_dir(questions.sparkSession)
    ids = ids or ["doc_id", "pos"]
    v = questions.withColumn("_v", validate_query("question"))
    invalid = v.filter(~F.col("_v.ok")).select(
        "qid", "question", F.lit(None).cast("string").alias("answer"),
        F.col("_v.error").alias("error"), F.lit(None).cast("string").alias("context"))
    valid = v.filter(F.col("_v.ok")).drop("_v")
    expanded = expand_query(valid, client).withColumnRenamed("reword_error", "_reword_error")
    qv = embed(expanded, embedder, text="expanded").select(
        "qid", "embedding", "_reword_error").checkpoint()
    res = search(qv.select("qid", "embedding"), index, k=k, ids=ids, payload=["page_content", "filename"],
                 filters=filters)
    uniq = unique_union(res.drop("distance"), ["qid", "page_content", "filename"], "rank")
    ctx = P.build_context(uniq, "qid")
    prompts = valid.join(ctx, "qid", "left").withColumn(
        "prompt", P.answer_prompt(F.coalesce("context", F.lit("")), "question"))
    answered = generate(prompts, client, out="answer").select(
        "qid", "question", "answer", "error", "context")
    answered = answered.join(
        qv.groupBy("qid").agg(F.max("_reword_error").alias("_reword_error")), "qid", "left"
    ).withColumn("error", F.coalesce("error", "_reword_error")).drop("_reword_error")
    return answered.unionByName(invalid)
