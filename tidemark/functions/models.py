"""Hooks for models: an embedder and a judge, each with a deterministic offline default.

Both work on whole Arrow batches.  Retries of a remote model belong inside the hook.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Judge(Protocol):
    def answer(self, prompts: list[str]) -> list[str]: ...


class HashingEmbedder:
    """Signed feature hashing of lower-cased words, scaled to length 1; the same text always gives the same vector."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dims] += 1.0 if h >> 63 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1)).tolist()


class LengthJudge:
    """Scores a text by its length; answers in the JSON a model would give."""

    def answer(self, prompts: list[str]) -> list[str]:
        return [json.dumps({"score": round(min(1.0, len(p or "") / 500), 3), "reasoning": "length", "memory_type": "episodic"}) for p in prompts]


def embed_column(embedder: Embedder) -> Callable[[Column], Column]:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(embedder.embed(texts.tolist()))

    return run


def judge_column(judge: Judge) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series(judge.answer(prompts.tolist()))

    return run


def with_retries(call: Callable[[], object], attempts: int = 3, first_wait: float = 1.0, sleep: Callable[[float], None] | None = None) -> object:
    """Calls until it succeeds, waiting twice as long each time; timeouts aren't retried."""
    import time

    sleep = sleep or time.sleep
    for attempt in range(attempts):
        try:
            return call()
        except TimeoutError:
            raise
        except Exception:
            if attempt + 1 == attempts:
                raise
            sleep(first_wait * 2**attempt)
    return None
