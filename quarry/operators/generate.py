"""Batch generation with a caller-supplied client.

``generate(df, client)`` sends each row's prompt to ``client(prompt) -> str`` inside Arrow
batches on the executors, retries a failing call a bounded number of times, and records a
failure in an ``error`` column while the other rows keep their results. Row order within a
partition is kept. A client object can also expose ``batch(prompts) -> list[str]``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _runner(client, prompt: str, out: str, retries: int, backoff: float):
    def call(p):
        last = None
        for attempt in range(retries):
            try:
                return client(p), None
            except Exception as e:  # recorded, the row fails alone
                last = e
                if backoff:
                    time.sleep(backoff * (attempt + 1))
        return None, f"{type(last).__name__}: {last}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            res = [call(p) if p is not None else (None, "empty prompt") for p in pdf[prompt]]
            pdf = pdf.copy()
            pdf[out] = [r for r, _ in res]
            pdf["error"] = [e for _, e in res]
            yield pdf
    return run


def generate(df: DataFrame, client: Callable[[str], str], prompt: str = "prompt",
             out: str = "result", retries: int = 3, backoff: float = 0.0,
             key: str | None = None, order: str | None = None) -> DataFrame:
    """One result per row; with ``key`` (and an ``order`` column), one per key: the last
    row by ``order`` wins, as a later duplicate overwrites an earlier one in a dict."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.StringType()),
                                                    T.StructField("error", T.StringType())])
    res = df.mapInPandas(_runner(client, prompt, out, retries, backoff), schema)
    if key is None:
        return res
    from pyspark.sql import functions as F
    others = [c for c in res.columns if c != key]
    last = res.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r"))
    return last.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


class ExtractiveClient:
    """A deterministic local client: answers with the first sentence of the text that
    follows the prompt's first blank line (the context or document), or raises when there is
    none. Used where no model is configured, and in tests."""

    def __call__(self, prompt: str) -> str:
        body = prompt.split("\n\n", 1)
        if len(body) < 2 or not body[1].strip():
            raise ValueError("prompt has no body")
        text = body[1].strip()
        for end in (". ", "! ", "? ", "\n"):
            i = text.find(end)
            if i > 0:
                return text[:i + 1].strip()
        return text[:200]
