"""Mixing sources to target weights with the cube method (Deville and Tille, balanced sampling).

A source's target is its weight's share of all sizes, at most ``most`` times its own size; what is over is
dealt again by weight. With rate = target / size, each record is taken floor(rate) times, and once more
with inclusion probability frac(rate). The flight phase moves these probabilities through the null space
of two constraints, the source's document total and its token total, until each is 0 or 1. It runs in
blocks of bounded size; the at most two records that a block leaves open go to the next level, where
they meet those of other blocks. The last block of a source ends with a
landing problem of LANDING records at most, solved by trying every outcome.

No task sees more than a block, so a source with most of the rows is only more blocks. The draws come
from a seed, the source's rank and the block: reruns agree. Sources order by code point, null last. A null
text has size 0; a source of size 0 has target 0. Repeated rows are drawn each on their own. Of a very long
text only its size is held. An empty table gives an empty result. Only the named columns are read, so
others may have any name.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, numbered_copies, row_key, take_copies, word_count
from siltstone.operators.ranking import numbered

BLOCK_ROWS = 4000
EPS = 1e-9
LANDING = 14


def with_targets(sources: DataFrame, weights: Sequence[float], most: float = 3.0) -> DataFrame:
    """``sources`` (_source, source_size, rows) with its number _s from 0 on by code point, null last, and target.

    A target is the level times the weight, or ``most`` times the size where that is less. The level rises as
    sources reach their bound and leave the rest to the others; each round is one aggregate, and the level is
    all that comes to the driver, so there may be as many sources as rows."""
    ranked = numbered(sources, [(F.col("_source").isNull(), False), (F.col("_source"), False)], "_s").withColumn("_s", F.col("_s") - 1)
    held = materialise(ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_s") % len(weights) + 1).cast("int"))), "sources")
    total = held.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    bound, level = F.col("source_size") * F.lit(float(most)), -1.0
    while True:
        full = (F.col("source_size") == 0) | (bound <= F.lit(level) * F.col("_w"))
        open_weight, at_bound = held.agg(F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0.0)), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0))).first()
        if not open_weight or (total - most * at_bound) / open_weight <= level:
            break
        level = (total - most * at_bound) / open_weight
    return held.withColumn("target", F.when(full, bound).otherwise(F.lit(level) * F.col("_w"))).drop("_w")


def flight(prob: list[float], size: Sequence[float], draw: random.Random) -> list[int]:
    """Move ``prob`` in place until at most two are fractional; sum and size-weighted sum stay.

    Returns the places left open. Three open places and two constraints leave one direction; of its two
    ends one is drawn so that each probability keeps its expectation.
    """
    held: list[int] = []
    for i in range(len(prob)):
        if not EPS < prob[i] < 1 - EPS:
            prob[i] = float(round(prob[i]))
            continue
        held.append(i)
        if len(held) == 3:
            a, b, c = held
            _move(prob, held, (size[b] - size[c], size[c] - size[a], size[a] - size[b]), draw)
        if len(held) == 2 and size[held[0]] == size[held[1]]:
            _move(prob, held, (1.0, -1.0), draw)
    return held


def _move(prob: list[float], held: list[int], along: Iterable[float], draw: random.Random) -> None:
    steps = tuple(along)
    if not any(steps):
        steps = (1.0, -1.0, 0.0)[: len(held)]
    ahead = back = math.inf
    for i, u in zip(held, steps, strict=True):
        if u > 0:
            ahead, back = min(ahead, (1 - prob[i]) / u), min(back, prob[i] / u)
        elif u < 0:
            ahead, back = min(ahead, prob[i] / -u), min(back, (1 - prob[i]) / -u)
    by = ahead if draw.random() * (ahead + back) < back else -back
    for i, u in zip(list(held), steps, strict=True):
        prob[i] += by * u
        if prob[i] <= EPS or prob[i] >= 1 - EPS:
            prob[i] = float(round(prob[i]))
            held.remove(i)


def land(prob: list[float], size: Sequence[float], held: list[int]) -> None:
    """The open places, LANDING at most, take the outcome nearest to their expected size, then count."""
    x, p = np.array([size[i] for i in held], float), np.array([prob[i] for i in held], float)
    ends = np.arange(2 ** len(held))[:, None] >> np.arange(len(held)) & 1
    best = np.lexsort([np.abs(ends.sum(axis=1) - p.sum()).round(9), np.abs(ends @ x - p @ x).round(6)])[0]
    for i, e in zip(held, ends[best], strict=True):
        prob[i] = float(e)


def decide(prob: list[float], size: Sequence[float], draw: random.Random) -> None:
    """Flight and landing of a source's last block. Places spread over all sizes stay out of the flight,
    so that those that land can make up for a large record."""
    by_size = sorted((i for i in range(len(prob)) if EPS < prob[i] < 1 - EPS), key=lambda i: (size[i], i))
    n = LANDING - 2
    kept = by_size if len(by_size) <= LANDING else [by_size[(2 * k + 1) * len(by_size) // (2 * n)] for k in range(n)]
    out = set(kept)
    flown = [i for i in range(len(prob)) if i not in out]
    own = [prob[i] for i in flown]
    held = flight(own, [size[i] for i in flown], draw)
    for i, p in zip(flown, own, strict=True):
        prob[i] = p
    land(prob, size, [flown[i] for i in held] + kept)


def _level(seed: int, level: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_h", "_size"], kind="stable")
        prob, size = rows["_p"].tolist(), rows["_size"].astype(float).tolist()
        (decide if last else flight)(prob, size, random.Random(f"{seed}/{key[0]}/{level}/{key[1]}"))
        return rows.assign(_p=prob)

    return run


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 17, block_rows: int = BLOCK_ROWS, extra: Sequence[Column] = ()) -> DataFrame:
    """(id, size, source_size, target, copies, taken, and ``extra``) of all rows; copies is how often a row is taken."""
    size = word_count(F.col("text")) if size is None else size
    kept = [c.alias(f"_x{i}") for i, c in enumerate(extra)]
    base = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").cast("string").alias("_source"), size.alias("_size"), *kept)
    base = materialise(numbered_copies(base), "sizes")  # so that no key decides a block alone
    sums = base.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("rows"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = with_targets(sums, weights, most).withColumn("_whole", F.floor(rate + EPS)).withColumn("_rate", F.greatest(F.lit(0.0), rate - F.col("_whole")))
    plan = materialise(plan.withColumn("_blocks", F.ceil(F.col("rows") / block_rows).cast("long")).drop("rows"), "plan")
    keyed = base.join(plan.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of"))).drop("_source", "_of")
    hashed = keyed.withColumn("_h", F.xxhash64("_id", "_size", "_row", F.lit(seed))).withColumn("_b", F.pmod("_h", "_blocks")).withColumn("_p", F.col("_rate"))
    columns = ["_id", "_size", "_row", *(f"_x{i}" for i in range(len(extra))), "_s", "source_size", "target", "_whole", "_h", "_b", "_p"]
    rows, level, done = hashed.select(*columns), 0, []
    blocks_now = plan.agg(F.max("_blocks")).first()[0] or 1
    while True:
        last = blocks_now <= 1
        moved = materialise(rows.groupBy("_s", "_b").applyInPandas(_level(seed, level, last), rows.schema), f"level{level}")
        is_open = (F.col("_p") > EPS) & (F.col("_p") < 1 - EPS)
        done.append(moved.filter(~is_open))
        if last:
            break
        blocks_now, level = -(-blocks_now * 2 // block_rows), level + 1
        rows = moved.filter(is_open).withColumn("_b", F.pmod("_b", F.lit(blocks_now).cast("long")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("_whole") + F.round("_p").cast("long")).alias("copies")
    names = [F.col(f"_x{i}") for i in range(len(extra))]
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", copies, *names).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    decided = mix(df, id_col, source_col, extra=row_key(df), **options)
    return take_copies(df, decided.select(F.col("_x0").alias("_k1"), F.col("_x1").alias("_k2"), "copies"))
