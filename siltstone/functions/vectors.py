"""Vectors as array<float> columns, and the packed form they are exchanged in."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 384
# Weights of the pair score and of a document's parts.
SEMANTIC, LEXICAL, TEXT, LAYOUT = 0.60, 0.40, 0.55, 0.45
CONTENT, WITH_CONTENT, WITHOUT_CONTENT = 0.60, (0.23, 0.12, 0.05), (0.62, 0.33, 0.05)
TITLE_WEIGHT, FOLDER_WEIGHT, PAIR_WEIGHT = 1.0, 0.8, 1.5
LEXICAL_NOISE = ("персона", "дата", "номер")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector of length 1; null for a zero vector."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def pair_score(semantic: Column, lexical: Column, lexical_known: Column, layout: Column) -> Column:
    """Text likeness, or its mix with layout likeness where that is higher. ``layout`` is null where one has none."""
    text = F.when(lexical_known, SEMANTIC * semantic + LEXICAL * lexical).otherwise(semantic)
    return F.when(layout.isNull(), text).otherwise(F.greatest(text, TEXT * text + LAYOUT * layout))


def lexical_terms(title: Column, folders: Column) -> Column:
    """array<struct<term, weight>>: words and neighbours' pairs of title and folders, weighted."""
    from siltstone.functions.text import tokens

    def field(text: Column, weight: float) -> Column:
        words = F.filter(tokens(text), lambda w: ~w.isin(*LEXICAL_NOISE))
        single = F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(weight).alias("weight")))
        nexts = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
        pairs = F.filter(F.zip_with(words, nexts, lambda a, b: F.struct(F.concat(a, F.lit("_"), b).alias("term"), F.lit(weight * PAIR_WEIGHT).alias("weight"))), lambda p: p["term"].isNotNull())
        return F.concat(single, pairs)

    return F.concat(field(title, TITLE_WEIGHT), field(folders, FOLDER_WEIGHT))


def hashed_place(term: Column, dimensions: int = DIMENSIONS) -> tuple[Column, Column]:
    """(dimension, sign) of a term, from its SHA-256."""
    digest = F.sha2(term, 256)
    place = F.pmod(F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long"), F.lit(dimensions).cast("long")).cast("int")
    return place, F.when(F.pmod(F.conv(F.substring(digest, 10, 1), 16, 10).cast("int"), F.lit(2)) == 1, 1.0).otherwise(-1.0)


def refreshed(content: Column, content_norm: Column, metadata: Column) -> Column:
    """New vector from the cached content part and the weighted sum of new metadata vectors."""
    zero = F.transform(F.coalesce(content, metadata), lambda x: F.lit(0.0))
    part = F.coalesce(scale(content, CONTENT * F.coalesce(content_norm, F.lit(1.0))), zero)
    return unit(add(F.coalesce(metadata, zero), part))


def pack(vector: np.ndarray) -> str:
    return base64.b64encode(zlib.compress(np.asarray(vector, "<f2").tobytes())).decode("ascii")


def unpack(packed: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The unit vector of a packed one; ValueError for anything else."""
    try:
        vector = np.frombuffer(zlib.decompress(base64.b64decode(packed, validate=True)), "<f2").astype(np.float32)
    except (zlib.error, TypeError, ValueError) as error:
        raise ValueError("not a packed vector") from error
    length = float(np.linalg.norm(vector)) if vector.shape == (dimensions,) else 0.0
    if not length or not np.isfinite(length):
        raise ValueError("not a vector of this size")
    return vector / length


@F.pandas_udf(T.StringType())
def pack_udf(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else pack(v))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_udf(packed: pd.Series) -> pd.Series:
    """Null for what can't be unpacked: such a row stays unmatched."""

    def one(p):
        try:
            return unpack(p) if p else None
        except ValueError:
            return None

    return packed.map(one)
