"""What the operators of this subpackage share: the scratch folder, row keys and Arrow word lists."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.sources.scratch import materialise, shared_dir  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
#: Equal rows that are dealt out by one row of ``numbered_copies``.
COPIES = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashable(value: Column, kind: T.DataType) -> Column:
    """The value with every map in it as its entries in order of their keys: maps have no hash."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(hashable(e["key"], kind.keyType).alias("k"), hashable(e["value"], kind.valueType).alias("v")))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda e: hashable(e, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[hashable(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def row_key(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of every column, where each says which columns are null; equal rows have equal keys."""
    cols = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        cols.append(hashable(col, f.dataType) if "map<" in f.dataType.simpleString() else col)
    nulls = [c.isNull() for c in cols]  # a null leaves a hash as it is: without them (x, null) and (null, x) would meet
    return [F.xxhash64(F.lit(0), *nulls, *cols).alias("_k1"), F.xxhash64(F.lit(1), *nulls, *reversed(cols)).alias("_k2")]


def numbered_copies(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with equal rows numbered 1, 2, ...: the same numbers on any partitioning.

    Equal rows are counted, which combines before the exchange, and dealt out again in runs of COPIES that
    are spread over all tasks: one row that is repeated without end fills no task."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    counted = df.groupBy(*cols).agg(F.count("*").alias("_n"))
    runs = counted.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), "_n", F.lit(COPIES).cast("long"))))
    runs = runs.repartition(*cols, F.col("_from"))
    return runs.withColumn(name, F.explode(F.sequence("_from", F.least("_n", F.col("_from") + COPIES - 1)))).drop("_n", "_from")


def take_copies(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions`` (_k1, _k2, copies): each row of ``df`` as often as said, equal rows together.

    Equal rows share a key, so their copies are summed and one of them is repeated. Rows without a
    decision, or with 0 copies, go. The join and the numbering need one exchange of ``df``; rows with more
    than COPIES copies, where there are any, are dealt over all tasks in a second one.
    """
    k1, k2 = row_key(df)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), k1, k2)
    copies = materialise(decisions.groupBy("_k1", "_k2").agg(F.sum("copies").cast("long").alias("_n")).filter("_n > 0"), "copies")
    first = Window.partitionBy("_k1", "_k2").orderBy("_k1")

    def one_of_each(wanted: DataFrame) -> DataFrame:
        return rows.join(wanted, ["_k1", "_k2"]).withColumn("_r", F.row_number().over(first)).filter("_r = 1")

    few = one_of_each(copies.filter(F.col("_n") <= COPIES)).withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select("_row.*")
    many = copies.filter(F.col("_n") > COPIES)
    if many.isEmpty():
        return few
    runs = one_of_each(many).withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), "_n", F.lit(COPIES).cast("long")))).repartition("_k1", "_k2", "_from")
    return few.unionByName(runs.withColumn("_c", F.explode(F.sequence("_from", F.least("_n", F.col("_from") + COPIES - 1)))).select("_row.*"))


def give_back() -> None:
    """Returns to the system what Arrow and malloc keep of freed arrays: the driver's Python outlives each model by many stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: pa.Array, most: int = 2 << 20):
    """(first row, rows) pieces of at most ``most`` bytes, or one row: bounds what is expanded at a time."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > most:
            yield start, i - start
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes) - start


def split_words(texts: pa.Array, letters: bool = False) -> tuple[list[str] | pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each word in order, first word of each row and the end).

    Words are runs without ASCII white space, A-Z in lower case; with ``letters`` they are runs of
    letters and marks in Unicode lower case, from a letter on: marks alone are no word. A null text has no words.
    """
    texts = pc.fill_null(texts, "")
    if letters:
        low = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " ")
        low = pc.replace_substring_regex(low, r"(^| )\p{M}+", " ")
    else:
        low = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(low)
    flat, starts = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    starts = starts - starts[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0)) if len(flat) else np.zeros(0, bool)
    if not full.all():
        flat = flat.filter(pa.array(full))
        starts = np.concatenate([[0], np.cumsum(full)])[starts]
    enc = flat.dictionary_encode()
    return enc.dictionary, np.asarray(enc.indices).astype(np.int64), starts


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i + 1]]; empty segments give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def text_place(df: DataFrame, text_col: str) -> int:
    """Where the text column stands. Texts go to Python once, with the row they belong to."""
    at = df.columns.index(text_col)
    if df.schema[at].dataType.simpleString() != "string":
        raise TypeError(f"{text_col} is not a string column")
    return at


def batches_with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with result columns added; an input column of the same name, in any case, is replaced."""
    low = {c.lower() for c in columns}
    kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n.lower() not in low]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(columns.values()), names=[n for n, _ in kept] + list(columns))
