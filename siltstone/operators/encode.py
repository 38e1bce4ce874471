"""Document vectors from passages: what goes into them, and a model, supplied by the caller, that encodes them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions.vectors import CONTENT, WITH_CONTENT, WITHOUT_CONTENT

VERSION = 6
# What stands before each kind of passage.
PREFIXES = {"title": "название документа: ", "folders": "каталоги документа: ", "entities": "типы переменных в названии: "}

#: Makes, on an executor, a function from texts to an array of unit vectors.
Encoder = Callable[[], Callable[[list[str]], np.ndarray]]


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors: means of the hidden states where the mask is set."""
    m = mask[..., None].astype(hidden.dtype)
    out = (hidden * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def pending(catalog: DataFrame, key: Column) -> DataFrame:
    """Rows whose vector is of another version, missing, or made from other names."""
    s = "similarity"
    done = (F.col(f"{s}.embedding_version") == VERSION) & (F.size(F.coalesce(f"{s}.embedding", F.array().cast("array<float>"))) > 0) & (F.col(f"{s}.metadata_key") == key)
    return catalog.filter(~F.coalesce(done, F.lit(False)))


def passages(catalog: DataFrame, samples: str = "samples", paths: str = "paths") -> DataFrame:
    """(path, passages array<struct<text, weight, content>>): content shares 0.60 evenly, title, folders and
    entities the rest; without content they share all. Weights of what is there sum to 1."""
    m = X.metadata_features(F.col(paths))
    rows = catalog.select("path", F.coalesce(F.col(samples), F.array().cast("array<string>")).alias("s"), m.alias("m"))
    has = F.size("s") > 0
    meta = [F.struct(F.concat(F.lit(f"passage: {PREFIXES[k]}"), F.col(f"m.{k}")).alias("text"), F.when(has, WITH_CONTENT[i]).otherwise(WITHOUT_CONTENT[i]).alias("weight"), (F.length(f"m.{k}") == 0).alias("none")) for i, k in enumerate(PREFIXES)]
    named = F.transform(F.filter(F.array(*meta), lambda p: ~p["none"]), lambda p: F.struct(p["text"].alias("text"), p["weight"].alias("weight"), F.lit(False).alias("content")))
    body = F.transform("s", lambda t: F.struct(F.concat(F.lit("passage: "), t).alias("text"), (F.lit(CONTENT) / F.size("s")).alias("weight"), F.lit(True).alias("content")))
    both = F.concat(body, named)
    total = F.aggregate(both, F.lit(0.0), lambda a, p: a + p["weight"])
    return rows.select("path", F.transform(both, lambda p: F.struct(p["text"].alias("text"), (p["weight"] / total).alias("weight"), p["content"].alias("content"))).alias("passages"))


def encode(rows: DataFrame, encoder: Encoder) -> DataFrame:
    """(path, embedding, content_embedding, content_embedding_norm, failed): the weighted sum of a document's
    passages, and of those of its content, as unit vectors. The model is made once for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for batch in batches:
            out = []
            for path, parts in zip(batch["path"], batch["passages"], strict=True):
                try:
                    if not len(parts):
                        raise ValueError("nothing to encode")
                    vectors = np.asarray(model([p["text"] for p in parts]), float)
                    weight, body = np.array([p["weight"] for p in parts]), np.array([p["content"] for p in parts])
                    whole, inner = weight @ vectors, (weight * body) @ vectors
                    share = weight[body].sum()
                    n, k = np.linalg.norm(whole), np.linalg.norm(inner)
                    out.append((path, (whole / n).astype("float32"), (inner / k).astype("float32") if k else None, float(k / share) if share else 0.0, False))
                except Exception:  # a document that can't be encoded stays unmatched
                    out.append((path, None, None, 0.0, True))
            yield pd.DataFrame(out, columns=["path", "embedding", "content_embedding", "content_embedding_norm", "failed"])

    return rows.mapInPandas(run, "path string, embedding array<float>, content_embedding array<float>, content_embedding_norm double, failed boolean")
