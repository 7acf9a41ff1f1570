"""Vectors for texts: a provider for each partition, called in batches."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Deterministic unit vectors of hashed words; needs no service."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts):
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for w in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
            if not out[i].any():
                out[i, 0] = 1
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).tolist()


class HttpEmbedder:
    """A service that takes ``{"model", "prompt"}`` and gives ``{"embedding"}``."""

    def __init__(self, url: str, model: str, timeout: float = 60):
        self.url, self.model, self.timeout = url, model, timeout

    def embed(self, texts):
        out = []
        for text in texts:
            body = json.dumps({"model": self.model, "prompt": text}).encode()
            request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                out.append(json.load(answer)["embedding"])
        return out


def with_vectors(df: DataFrame, text: str, provider: Provider) -> DataFrame:
    """``df`` with an ``embedding`` of its column ``text``, which is dropped."""
    columns = [c for c in df.columns if c != text]
    schema = StructType([*df.select(columns).schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(batches):
        for batch in batches:
            vectors = provider.embed(batch[text].fillna("").tolist()) if len(batch) else []
            yield pd.DataFrame({**{c: batch[c] for c in columns}, "embedding": vectors})

    return df.mapInPandas(run, schema)
