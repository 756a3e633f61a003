"""Model services as injectable columns: embedding, judging, answering, translating; deterministic stand-ins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def text_model(load: Callable[[], Callable[[list[str]], list[str]]]) -> Callable[[Column], Column]:
    """A column function from a loader of a batch model, loaded once a task."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            yield pd.Series(model([x or "" for x in s]))

    return run


def vector_model(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[Column], Column]:
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            yield pd.Series(list(np.asarray(model([x or "" for x in s]), np.float32)))

    return run


def hashed_embedding(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Signed hashes of words summed up: a stand-in for an embedding model."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                d = hashlib.md5(w.encode()).digest()
                out[i, d[0] % dims] += 1 if d[1] & 1 else -1
        return out

    return embed


def with_prefix(text: Column, model: str, role: str) -> Column:
    """`query: ` or `passage: ` before texts for models of the e5 family."""
    return F.concat(F.lit(f"{role}: "), text) if "e5" in model.lower() else text


def gated_answer(question: Column, context: Column, answerable: Column, authored: Column, model: Callable[[Column], Column], refusal: str) -> Column:
    """struct<text, refused, gate>: refused before the model unless the gate or an authored text lets it pass, and after
    it if its answer holds the refusal token."""
    text = F.when(answerable | (F.coalesce(authored, F.lit("")) != ""), model(F.concat_ws("\n\n", question, authored, context)))
    gate = F.when(text.isNull(), "retrieval").when(text.contains(refusal), "generation").otherwise("none")
    return F.struct(F.when(gate == "none", text).otherwise("").alias("text"), (gate != "none").alias("refused"), gate.alias("gate"))
