"""The order of a catalog by content: near-duplicates and classes first, then names, then type and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import grouping as G
from siltstone.operators import sketch as K
from siltstone.operators.components import components
from siltstone.operators.ranking import numbered
from siltstone.operators.view import size_only
from siltstone.sources.scratch import materialise


def index_keys(content: str) -> Column:
    """All keys under which a content struct is looked up: sampled hashes by kind, image bands, whole hashes."""
    c = lambda f: F.col(f"{content}.{f}")
    tag = lambda t, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda h: F.concat(F.lit(t), h))
    whole = F.array_compact(F.array(F.concat(F.lit("s:"), c("sha256")), F.when(c("words") >= K.TEXT_WORDS, F.concat(F.lit("w:"), c("text_sha256")))))
    bands = F.transform(F.coalesce(K.visual_bands(c("visual")), F.array().cast("array<struct<slot:string,band:int,digits:string>>")), lambda b: F.concat_ws(":", F.lit("v"), b["slot"], b["band"].cast("string"), b["digits"]))
    return F.array_distinct(F.concat(tag("b:", c("binary")), tag("t:", c("text")), tag("c:", c("chunks")), whole, bands))


def content_edges(units: DataFrame) -> DataFrame:
    """(a, b, score) of the units (id, content) whose contents match: candidates share a key, matches are confirmed."""
    keys = units.select("id", F.explode(index_keys("content")).alias("k"))
    pairs = keys.alias("x").join(keys.alias("y"), F.expr("x.k = y.k and x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    both = pairs.join(units.select(F.col("id").alias("a"), F.col("content").alias("ca")), "a").join(units.select(F.col("id").alias("b"), F.col("content").alias("cb")), "b")
    return both.select("a", "b", K.content_match("ca", "cb").alias("m")).filter("m is not null").select("a", "b", "m.score")


def content_order(catalog: DataFrame, classes: DataFrame | None = None, least_names: float = 0.4) -> DataFrame:
    """(path, stage, group, rank) of every row of (path, size, content).

    Rows of identical content are one unit. Units that match are linked completely, and joined with those
    of the same class (path, class). Rows left alone are grouped by name within a type and a factor of two
    in size, and what is left then by type and size bands. Failed, unknown and very large contents never
    match. Groups go by stage, then the largest first; ranks by group, type, size and path."""
    content = F.when(~size_only(F.col("size")), F.col("content"))
    rows = materialise(catalog.select("path", F.coalesce("size", F.lit(0)).cast("long").alias("size"), X.suffix(F.col("path")).alias("type"), content.alias("content")).withColumn("key", K.fingerprint_key("content")), "rows")
    known = rows.filter("key is not null")
    units = materialise(known.groupBy("key").agg(F.min("path").alias("id"), F.first("content").alias("content")), "units")
    linked = G.complete_groups(content_edges(units))
    member = known.select("path", "key").join(units.select("key", "id"), "key").select("path", "id")
    ties = linked.select(F.col("id").alias("a"), F.col("cluster").alias("b"))
    if classes is not None:
        ties = ties.union(member.join(classes.select("path", "class"), "path").select(F.col("id").alias("a"), F.concat(F.lit("\x7fclass:"), "class").alias("b")))
    roots = components(ties).select(F.col("node").alias("id"), "root")
    placed = member.join(roots, "id", "left").select("path", F.coalesce("root", "id").alias("cluster"))
    placed = placed.join(placed.groupBy("cluster").agg(F.count("*").alias("n")), "cluster").filter("n > 1")
    first = materialise(rows.select("path", "type", "size").join(placed.select("path", "cluster"), "path", "left"), "first")
    rest = first.filter("cluster is null").drop("cluster")
    by_name = materialise(G.residual_name_groups(rest, least_names), "by_name")
    several = by_name.join(by_name.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster"), "cluster").select("path", "cluster")
    alone = rest.join(several.select("path"), "path", "left_anti")
    sized = G.bands(alone).select("path", F.concat_ws("\0", "type", F.col("band").cast("string")).alias("cluster"))
    stages = [first.filter("cluster is not null").select("path", "cluster", F.lit("content").alias("stage"), F.lit(0).alias("s")), several.select("path", "cluster", F.lit("names").alias("stage"), F.lit(1).alias("s")), sized.select("path", "cluster", F.lit("size").alias("stage"), F.lit(2).alias("s"))]
    everything = stages[0].unionByName(stages[1]).unionByName(stages[2]).join(rows.select("path", "type", "size"), "path")
    everything = materialise(everything, "everything")
    groups = everything.groupBy("s", "cluster").agg(F.count("*").alias("n"), F.min(F.struct("type", "size")).alias("least"), F.min(F.lower("path")).alias("path"))
    by_size = F.when(F.col("s") < 2, -F.col("n")).otherwise(0)
    ranked = numbered(groups, [(F.col("s"), False), (by_size, False), (F.col("least.type"), False), (F.col("least.size"), False), (F.col("path"), False), (F.col("cluster"), False)], "group")
    out = everything.join(ranked.select("s", "cluster", (F.col("group") - 1).alias("group")), ["s", "cluster"])
    return numbered(out, [(F.col("group"), False), (F.col("type"), False), (F.col("size"), False), (F.col("path"), False)], "rank").select("path", "stage", "group", (F.col("rank") - 1).alias("rank"))
