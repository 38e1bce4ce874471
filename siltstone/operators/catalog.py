"""The catalog: one row for each document, exact duplicates and what to keep, and its refresh from a new listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as X

# A mode's file type bits, those of a symbolic link, and the bit of a reparse tag that marks a surrogate.
FORMAT_BITS, LINK_FORMAT, SURROGATE = 0o170000, 0o120000, 0x20000000

IDENTITY = "struct<dev:bigint,ino:bigint,size:bigint,mtime_ns:bigint>"


def of_documents(docs: DataFrame) -> DataFrame:
    """A table of texts as a catalog: source/lang/doc_<id>.txt, with size and hash of the UTF-8 bytes."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    raw = F.col("text").cast("binary")
    return docs.select("doc_id", path.alias("path"), path.alias("origin"), F.coalesce(F.octet_length(raw), F.lit(0)).cast("long").alias("size"), F.coalesce(F.sha2(raw, 256), F.lit("")).alias("hash"))


def scan_files(spark: SparkSession, root: str, hash_files: bool = True, pattern: str | None = None) -> DataFrame:
    """The files under ``root``. Without hashes only their metadata is read.

    This listing has no inodes: ``identity.ino`` is 0, so ``refresh`` takes no row for a renamed one, and
    moves are told by their hash in ``fill_hashes``. A listing with inodes can be given to ``refresh``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("path"), r"\+", "%2B")), "^[a-z]+:/+" + "".join("\\" + c if not c.isalnum() else c for c in base) + "/", "")
    identity = F.struct(F.lit(0).cast("long").alias("dev"), F.lit(0).cast("long").alias("ino"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    hashed = F.sha2("content", 256) if hash_files else F.lit("")
    found = files.select(path.alias("path"), F.col("length").alias("size"), identity.alias("identity"), hashed.alias("hash"))
    return found.filter(X.is_safe(F.col("path"))).withColumn("origin", F.col("path"))


def without_links(listing: DataFrame) -> DataFrame:
    """A listing without links: rows whose ``mode`` says symbolic link, or whose ``reparse_tag`` marks one name
    standing for another. A missing mode or tag is that of a plain file."""
    mode, tag = F.coalesce("mode", F.lit(0)).cast("long"), F.coalesce("reparse_tag", F.lit(0)).cast("long")
    link = (mode.bitwiseAND(F.lit(FORMAT_BITS)) == LINK_FORMAT) | (tag.bitwiseAND(F.lit(SURROGATE)) != 0)
    return listing.filter(~link)


def walk_key(path: Column) -> Column:
    """Sorts as a walk does: a folder's files before its subfolders, both by name."""
    parts = F.split(path, "/")
    folders = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.concat(F.lit("\x02"), p))
    return F.array_join(F.concat(folders, F.array(F.concat(F.lit("\x01"), F.element_at(parts, -1)))), "\0")


def with_duplicates(catalog: DataFrame) -> DataFrame:
    """Add ``duplicate``: the rank of the hash among the hashes of more than one row, 0 for others.

    Only repeated hashes are ranked. They are ranked in ranges by their first four digits, each range
    starting at the number of repeated hashes before it: at most 65 536 counts, so no task sorts them all.
    """
    repeated = catalog.filter("hash <> ''").groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").withColumn("_p", F.left("hash", F.lit(4)))
    counts = repeated.groupBy("_p").agg(F.count("*").alias("c"))
    before = counts.withColumn("_before", F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    placed = repeated.join(F.broadcast(before.select("_p", F.coalesce("_before", F.lit(0)).alias("_before"))), "_p")
    ranked = placed.select("hash", (F.row_number().over(Window.partitionBy("_p").orderBy("hash")) + F.col("_before")).cast("int").alias("_rank"))
    return catalog.join(ranked, "hash", "left").withColumn("duplicate", F.coalesce("_rank", F.lit(0))).drop("_rank")


def duplicate_plan(catalog: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(hash, keep, remove) for every copy: the one nearest to the root stays, then by name.

    Rows without a hash, or with an error, take no part. ``only``: paths that may be removed."""
    rows = catalog.filter("hash <> ''")
    if "error" in catalog.columns:
        rows = rows.filter(F.coalesce("error", F.lit("")) == "")
    # the first of a hash is an aggregate, so a hash that most rows share is no sort in one task
    order = F.struct(X.depth(F.col("path")).alias("d"), F.lower("path").alias("l"), F.col("path").alias("p"))
    keep = rows.groupBy("hash").agg(F.min(order)["p"].alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    plan = rows.join(keep, "hash").filter("path <> keep").select("hash", "keep", F.col("path").alias("remove"))
    return plan if only is None else plan.join(only.select(F.col("path").alias("remove")), "remove", "left_semi").select("hash", "keep", "remove")


def duplicate_summary(catalog: DataFrame) -> DataFrame:
    """files, hashed, unchecked, duplicate groups and the copies beyond one of each."""
    by_hash = catalog.groupBy("hash").agg(F.count("*").alias("n"))
    known = F.col("hash") != ""
    return by_hash.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("files"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).cast("long").alias("hashed"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).cast("long").alias("unchecked"),
        F.count_if(known & (F.col("n") > 1)).alias("groups"),
        F.coalesce(F.sum(F.when(known & (F.col("n") > 1), F.col("n") - 1)), F.lit(0)).cast("long").alias("extra_copies"),
    )


def verified_removals(plan: DataFrame, now: DataFrame) -> DataFrame:
    """Add ``ok``: keeper and copy differ in path and both still have the planned hash. ``now``: (path, hash)."""
    keeper = now.select(F.col("path").alias("keep"), F.col("hash").alias("_k"))
    copy = now.select(F.col("path").alias("remove"), F.col("hash").alias("_c"))
    checked = plan.join(keeper, "keep", "left").join(copy, "remove", "left")
    ok = (F.col("keep") != F.col("remove")) & F.col("_k").eqNullSafe(F.col("hash")) & F.col("_c").eqNullSafe(F.col("hash"))
    return checked.select("hash", "keep", "remove", ok.alias("ok"))


def unchanged(catalog: DataFrame, now: DataFrame) -> DataFrame:
    """Rows whose identity is what the catalog says. ``now``: (path, identity)."""
    return catalog.join(now.select("path", F.col("identity").alias("_now")), "path").filter(F.col("identity").eqNullSafe(F.col("_now"))).drop("_now")


def refresh(old: DataFrame, listing: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """The catalog after a new listing (path, identity), hashes still to be filled where ``hash`` is ''.

    A row of the same identity is reused whole. A path without an old row takes the one old row of its
    identity whose path is gone: it was renamed outside. A path whose identity changed keeps only its
    origin. A completed move to a path (source, destination, origin, identity) restores its origin.
    """
    before = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns])
    gone = before.join(listing.select(F.col("path").alias("o_path")), "o_path", "left_anti").filter("o_identity.ino <> 0")
    alone = gone.groupBy("o_identity").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("o_identity").alias("_i"))
    renamed = gone.join(alone, gone["o_identity"] == alone["_i"], "left_semi")
    # only an identity that one old row had at all counts
    once = before.groupBy("o_identity").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("o_identity").alias("_i"))
    renamed = renamed.join(once, renamed["o_identity"] == once["_i"], "left_semi")
    at_path = listing.join(before, listing["path"] == before["o_path"], "left")
    known, new = at_path.filter("o_path is not null"), at_path.filter("o_path is null").select(*listing.columns)
    by_identity = new.join(renamed, new["identity"] == renamed["o_identity"], "left")
    both = known.unionByName(by_identity)
    same = F.col("identity").eqNullSafe(F.col("o_identity"))
    keep = [c for c in old.columns if c not in ("path", "origin", "origins", "identity", "error")]
    out = both.select(
        "path",
        F.coalesce("o_origin", "path").alias("origin"),
        *([F.col("o_origins").alias("origins")] if "origins" in old.columns else []),
        "identity",
        *[F.when(same, F.col(f"o_{c}")).otherwise(F.lit("") if t == "string" else F.lit(None).cast(t)).alias(c) for c, t in old.dtypes if c in keep],
        F.lit("").alias("error"),
    )
    if moves is not None:
        done = moves.select(F.col("destination").alias("path"), F.col("origin").alias("_origin"), F.col("identity").alias("_moved"))
        out = out.join(done, "path", "left").withColumn("origin", F.when(F.col("identity").eqNullSafe(F.col("_moved")), F.col("_origin")).otherwise(F.col("origin"))).drop("_origin", "_moved")
    return out


def fill_hashes(catalog: DataFrame, hashes: DataFrame, old: DataFrame | None = None, moves: DataFrame | None = None) -> DataFrame:
    """Hashes (path, hash) for the rows without one. An equal hash in ``old`` carries note and stats over; a
    completed move to a path (destination, origin, hash) with an equal hash restores its origin, also where
    its identity is another, as after a copy to another disk. Without inodes, as in an object store, this is
    how moves are told: ``refresh`` needs an inode."""
    new = hashes.select("path", F.col("hash").alias("_new"))
    filled = catalog.join(new, "path", "left").withColumn("hash", F.when(F.col("hash") == "", F.coalesce("_new", F.lit(""))).otherwise(F.col("hash"))).drop("_new")
    known = F.col("hash") != ""
    if moves is not None:
        done = moves.select(F.col("destination").alias("path"), F.col("origin").alias("_origin"), F.col("hash").alias("_moved"))
        there = known & F.col("hash").eqNullSafe(F.col("_moved"))
        filled = filled.join(done, "path", "left").withColumn("origin", F.when(there, F.col("_origin")).otherwise(F.col("origin"))).drop("_origin", "_moved")
    carried = [c for c in ("note", "stats") if old is not None and c in old.columns and c in catalog.columns]
    if not carried:
        return filled
    before = old.select("path", F.col("hash").alias("_h"), *[F.col(c).alias(f"_{c}") for c in carried])
    same = known & F.col("hash").eqNullSafe(F.col("_h"))
    return filled.join(before, "path", "left").withColumns({c: F.when(same, F.col(f"_{c}")).otherwise(F.col(c)) for c in carried}).drop("_h", *[f"_{c}" for c in carried])


def without(catalog: DataFrame, plan: DataFrame) -> DataFrame:
    """The catalog after removals (remove, ok): only what was verified is gone, a copy that failed its check stays."""
    return catalog.join(plan.filter("ok").select(F.col("remove").alias("path")), "path", "left_anti")
