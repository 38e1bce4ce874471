"""The provenance manifest: a portable CSV of where every file was, and its reconciliation with another copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X

SCHEMA_TAG = "corpus-structure-v1"
NAMES = ("schema", "kind", "current_path", "original_path", "size", "sha256", "origin_candidates")
BOM = "﻿"


def ancestors(path: Column) -> Column:
    """All folders above a path."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def directories(catalog: DataFrame, *more: DataFrame) -> DataFrame:
    """(path) of every folder of current and original paths, and of ``more`` (path) folders with theirs."""
    found = catalog.select(F.explode(F.array_distinct(F.concat(ancestors(F.col("path")), ancestors(F.col("origin"))))).alias("path"))
    for d in more:
        found = found.union(d.select(F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("path")))
    return found.distinct()


def manifest_rows(catalog: DataFrame, tag: str = SCHEMA_TAG, *more: DataFrame) -> DataFrame:
    """The manifest's rows, folders and files, with guarded cells; ``part`` puts folders first."""
    origins = F.coalesce("origins", F.array("origin")) if "origins" in catalog.columns else F.array("origin")
    none = F.lit("")
    folders = directories(catalog, *more).select(F.lit(0).alias("part"), F.lit(tag).alias("schema"), F.lit("directory").alias("kind"), none.alias("current_path"), X.encode_cell(F.col("path")).alias("original_path"), none.alias("size"), none.alias("sha256"), F.lit("[]").alias("origin_candidates"))
    files = catalog.select(F.lit(1).alias("part"), F.lit(tag).alias("schema"), F.lit("file").alias("kind"), X.encode_cell(F.col("path")).alias("current_path"), X.encode_cell(F.col("origin")).alias("original_path"), F.col("size").cast("string").alias("size"), F.col("hash").alias("sha256"), F.to_json(F.array_sort(origins)).alias("origin_candidates"))
    return folders.unionByName(files)


def write_manifest(catalog: DataFrame, path: str, tag: str = SCHEMA_TAG) -> None:
    """A folder of CSV files in range order: folders, then files, by path. Cells are ``;``-separated; the
    first header cell carries the byte order mark that spreadsheets look for."""
    rows = manifest_rows(catalog, tag).sort("part", "original_path", "current_path").drop("part")
    rows.withColumnRenamed("schema", BOM + "schema").write.option("sep", ";").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_manifest(spark: SparkSession, path: str, tag: str = SCHEMA_TAG) -> DataFrame:
    """(kind, current_path, original_path, size, sha256, origins), validated: a wrong row raises when it is read.

    Columns go by their names in the header, in any order and with others among them; a missing one raises at
    once. A size may be missing; a file without candidates has its original path as the only one. Folders
    need a safe path and nothing else."""
    raw = spark.read.option("sep", ";").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    held = {c.lstrip(BOM).strip('"'): F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in raw.columns}
    if missing := [n for n in NAMES if n not in held]:
        raise ValueError(f"manifest: no column {', '.join(missing)}")
    cells = raw.select(*[held[n].alias(n) for n in NAMES])
    original, hash_, listed = X.decode_cell(F.col("original_path")), F.col("sha256"), F.col("origin_candidates")
    strings = (listed == "") | F.coalesce(F.schema_of_variant(F.try_parse_json(listed)).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
    said = F.when(listed == "", F.array().cast("array<string>")).otherwise(F.from_json(listed, "array<string>"))
    origins = F.when(F.size(said) > 0, said).otherwise(F.array(original))
    size, is_file = F.expr("try_cast(size AS BIGINT)"), F.col("kind") == "file"
    problems = (
        (F.col("schema") != tag, "unknown schema"),
        (~F.col("kind").isin("file", "directory"), "unknown kind"),
        (~X.is_safe(original), "unsafe path"),
        (is_file & (F.col("size") != "") & ~F.coalesce(size >= 0, F.lit(False)), "wrong size"),
        (is_file & (hash_ != "") & ~hash_.rlike("^[0-9a-f]{64}$"), "wrong hash"),
        (is_file & (~strings | F.coalesce(F.exists(said, lambda o: o.isNull() | ~X.is_safe(o)), F.lit(True))), "wrong origins"),
    )
    why = F.coalesce(*[F.when(bad, F.lit(what)) for bad, what in problems])
    checked = F.when(why.isNull(), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("manifest: "), why, F.lit(": "), original)))
    return cells.select(checked.alias("kind"), X.decode_cell(F.col("current_path")).alias("current_path"), original.alias("original_path"), size.alias("size"), hash_.alias("sha256"), F.when(is_file, origins).otherwise(F.array().cast("array<string>")).alias("origins"))


def known_origins(manifest: DataFrame) -> DataFrame:
    """(hash, size, origins): the sorted set of origins of each content: the candidates where there are any,
    else the original path."""
    files = manifest.filter("kind = 'file' and sha256 <> ''")
    candidates = F.when(F.size("origins") > 0, F.col("origins")).otherwise(F.array("original_path"))
    each = files.select(F.col("sha256").alias("hash"), "size", F.explode(candidates).alias("origin")).distinct()
    return each.groupBy("hash", "size").agg(F.array_sort(F.collect_list("origin")).alias("origins"))


def reconcile(catalog: DataFrame, manifest: DataFrame) -> DataFrame:
    """The catalog with origin, origins and origin_match (matched, ambiguous, unmatched), by hash and size.
    More than one origin leaves the current path as the origin and keeps all as candidates; rows that the
    manifest does not know keep the origins they had."""
    before = F.col("origins") if "origins" in catalog.columns else F.lit(None).cast("array<string>")
    rows = catalog.withColumn("_before", before).drop("origins", "origin_match")
    known = known_origins(manifest).select(F.col("hash").alias("_hash"), F.col("size").alias("_size"), F.col("origins").alias("_found"))
    found = rows.join(known, (F.col("hash") == F.col("_hash")) & F.col("size").eqNullSafe(F.col("_size")), "left")
    n = F.coalesce(F.size("_found"), F.lit(0))
    origin = F.when(n == 1, F.element_at("_found", 1)).when(n > 1, F.col("path")).otherwise(F.col("origin"))
    match = F.when(n == 1, "matched").when(n > 1, "ambiguous").otherwise("unmatched")
    return found.withColumns({"origin": origin, "origins": F.coalesce("_found", "_before"), "origin_match": match}).drop("_before", "_hash", "_size", "_found")


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    """matched counts the ambiguous too."""
    return reconciled.agg(F.count_if(F.col("origin_match") != "unmatched").alias("matched"), F.count_if(F.col("origin_match") == "ambiguous").alias("ambiguous"), F.count_if(F.col("origin_match") == "unmatched").alias("unmatched"))


def replay(moves: DataFrame, journal: DataFrame) -> DataFrame:
    """Moves with ``done``: those whose id the journal (value: JSON lines) holds. A torn last line counts for nothing."""
    ids = journal.select(F.get_json_object("value", "$.id").alias("id")).filter("id is not null").distinct().withColumn("_d", F.lit(True))
    return moves.drop("done").join(ids, "id", "left").withColumn("done", F.coalesce("_d", F.lit(False))).drop("_d")
