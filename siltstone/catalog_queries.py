"""The registered queries over the catalog operators. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions import vectors as V
from siltstone.operators import catalog as C
from siltstone.operators import grouping as G
from siltstone.operators import labels as L
from siltstone.operators import names as N
from siltstone.operators import ordering as O
from siltstone.operators import sketch as K
from siltstone.operators import view as W
from siltstone.operators.ranking import numbered
from siltstone.plans import naming as P
from siltstone.sources import manifest as M

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.of_documents(read(spark, sf_dir, "documents"))


def with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id", "left")


def page_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: host and path of the address, .html."""
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), F.lit(".html"))
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path"), path.alias("origin"))


def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.text_sketch(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query
def catalog_scan(spark, sf_dir):
    return W.with_columns(catalog(spark, sf_dir)).select("doc_id", "path", "name", "folder", "type", "size", "hash")


@query
def duplicate_groups(spark, sf_dir):
    return C.with_duplicates(catalog(spark, sf_dir)).select("doc_id", "hash", "duplicate")


@query
def duplicate_plan(spark, sf_dir):
    return C.duplicate_plan(catalog(spark, sf_dir))


@query
def duplicate_summary(spark, sf_dir):
    return C.duplicate_summary(catalog(spark, sf_dir))


@query
def duplicate_labels(spark, sf_dir):
    found = C.with_duplicates(catalog(spark, sf_dir))
    return found.select("doc_id", W.duplicate_label(F.col("duplicate"), F.col("hash")).alias("label"))


@query
def verified_removals(spark, sf_dir):
    """The plan checked against a listing in which texts of one source have changed since."""
    rows = catalog(spark, sf_dir)
    now = rows.select("path", F.when(F.col("path").startswith("src1/"), F.lit("changed")).otherwise(F.col("hash")).alias("hash"))
    return C.verified_removals(C.duplicate_plan(rows), now)


def _filtered(spark, sf_dir, rule):
    return W.matching(read(spark, sf_dir, "documents"), {"text": rule}).select("doc_id", "lang", "source")


@query
def filter_text_all(spark, sf_dir):
    return _filtered(spark, sf_dir, W.TextRule(include="license the"))


@query
def filter_text_any(spark, sf_dir):
    return _filtered(spark, sf_dir, W.TextRule(include="trash license", any=True))


@query
def filter_text_whole(spark, sf_dir):
    return _filtered(spark, sf_dir, W.TextRule(include="under that", whole=True))


@query
def filter_text_exclude(spark, sf_dir):
    return _filtered(spark, sf_dir, W.TextRule(include="license", exclude="apache mit"))


@query
def filter_numeric_unknown(spark, sf_dir):
    rows = with_labels(spark, sf_dir)
    return W.matching(rows, {"quality": W.NumberRule(0, 1), "size": W.NumberRule(100, 5000)}).select("doc_id", "quality", "size")


@query
def search_global(spark, sf_dir):
    return W.search(catalog(spark, sf_dir), "SRC1/En/").select("doc_id", "path")


@query
def sort_multi_nulls(spark, sf_dir):
    rows = with_labels(spark, sf_dir)
    return numbered(rows, W.sort_keys([("quality", True), ("size", False)], "doc_id"), "place").select("doc_id", "place")


@query
def sort_natural(spark, sf_dir):
    rows = W.with_columns(catalog(spark, sf_dir))
    return numbered(rows, W.sort_keys([("name", True)], "doc_id"), "place").select("doc_id", "place")


@query
def walk_order(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    return numbered(rows, [(C.walk_key(F.col("path")), False), (F.col("doc_id"), False)], "place").select("doc_id", "place")


@query
def totals_partial(spark, sf_dir):
    return W.totals(with_labels(spark, sf_dir), ["quality", "toxic"], word_only=("toxic",))


@query
def metric_labels(spark, sf_dir):
    return with_labels(spark, sf_dir).select("doc_id", W.metric(F.col("quality"), F.col("toxic") == 1).alias("quality"))


def flat_copy(spark, sf_dir):
    name = F.concat(F.lit("flat_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return catalog(spark, sf_dir).withColumns({"path": name, "origin": name})


def backup_manifest(spark, sf_dir):
    rows = catalog(spark, sf_dir).filter("hash <> ''")
    return rows.select(F.lit("file").alias("kind"), F.col("path").alias("original_path"), "size", F.col("hash").alias("sha256"), F.array("origin").alias("origins"))


@query
def provenance_match(spark, sf_dir):
    found = M.reconcile(flat_copy(spark, sf_dir), backup_manifest(spark, sf_dir))
    return found.select("doc_id", "origin", F.coalesce(F.array_join("origins", "|"), F.lit("")).alias("origins"), "origin_match")


@query
def provenance_summary(spark, sf_dir):
    return M.reconcile_summary(M.reconcile(flat_copy(spark, sf_dir), backup_manifest(spark, sf_dir)))


@query
def manifest_rows(spark, sf_dir):
    return M.manifest_rows(catalog(spark, sf_dir)).select("kind", "current_path", "original_path", "size", "sha256", "origin_candidates")


@query
def empty_directories(spark, sf_dir):
    """Folders of the backup without a file once all texts of two languages are gone."""
    rows = catalog(spark, sf_dir)
    left = rows.filter(~F.col("path").rlike("/(fr|es)/"))
    return P.empty_directories(M.directories(rows), left)


@query
def origin_tag(spark, sf_dir):
    key = X.folder_key(F.array("origin"))
    return catalog(spark, sf_dir).select("doc_id", X.folder_tag(key).alias("tag"), F.round(X.folder_hue(key), 6).alias("hue"))


@query
def metadata_keys(spark, sf_dir):
    return catalog(spark, sf_dir).select("doc_id", X.metadata_key(X.metadata_paths(F.col("path"), F.concat(F.lit("Old  "), F.col("path")), F.lit(None))).alias("key"))


@query
def composed_names(spark, sf_dir):
    return catalog(spark, sf_dir).select("doc_id", X.composed_name(F.col("path"), "root", "new text", 2).alias("before"), X.composed_name(F.col("path"), "root", "", 1, True).alias("after"))


@query
def anonymized_text(spark, sf_dir):
    """Texts without dates and numbers, as hashes of what is left."""
    rows = read(spark, sf_dir, "documents").filter("text is not null")
    return rows.select("doc_id", F.regexp_count(X.anonymize(F.col("text")), F.lit("число")).alias("numbers"))


@query
def preview_text(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").filter("text is not null")
    return rows.select("doc_id", F.sha2(X.limited_text(F.col("text"), 5, 400), 256).alias("preview"), X.progress_label(F.substring("text", 1, 120)).alias("label"))


@query
def guarded_cells(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    cell = F.concat(F.when(F.col("value") < 50, F.lit("-")).when(F.col("value") < 60, F.lit("'")).otherwise(""), F.col("event_type"))
    return rows.select("event_id", X.encode_cell(cell).alias("cell"), (X.decode_cell(X.encode_cell(cell)) == cell).alias("same"))


def part_files(spark, sf_dir):
    """Parts as files; those of size 1 are already in a series."""
    path = F.when(F.col("p_size") == 1, F.concat(F.lit("parts/item #"), F.col("p_partkey").cast("string"), F.lit(".txt"))).otherwise(F.concat(F.lit("parts/"), "p_type", F.lit("/"), F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".txt")))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), path.alias("path"), "p_size", "p_name")


@query
def name_key_groups(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(X.name_key(F.concat("p_name", F.lit(".txt"))).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("n"))


def part_names(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("path"))
    return N.distinct_names(rows)


@query
def name_tfidf(spark, sf_dir):
    return N.features(part_names(spark, sf_dir)).select("name", "kind", "feature", F.round("weight", 4).alias("weight"))


@query
def name_pairs(spark, sf_dir):
    return N.scored_pairs(N.features(part_names(spark, sf_dir))).select("a", "b", F.round("score", 4).alias("score"))


@query
def name_groups(spark, sf_dir):
    return N.name_groups(part_names(spark, sf_dir))


@query
def text_sketch(spark, sf_dir):
    return sketches(spark, sf_dir).select(F.col("id").alias("doc_id"), "words", "text_sha256", F.sha2(F.array_join("sample", ","), 256).alias("sample_sha256"), F.size("sample").alias("sampled"))


@query
def near_dup_candidates(spark, sf_dir):
    return K.candidate_pairs(K.text_classes(sketches(spark, sf_dir)))


@query
def near_dup_pairs(spark, sf_dir):
    return K.text_matches(K.text_classes(sketches(spark, sf_dir))).select("a", "b", F.round("score", 6).alias("score"))


@query
def near_dup_groups(spark, sf_dir):
    return G.complete_groups(K.text_matches(K.text_classes(sketches(spark, sf_dir))))


@query
def cross_corpus_pairs(spark, sf_dir):
    """Documents of some sources against those of all others, as two corpora."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    mine, other = (K.text_classes(K.text_sketch(rows.filter(c))) for c in ("source < 'src2'", "source >= 'src2'"))
    return K.text_matches(mine, other).select("a", "b", F.round("score", 6).alias("score"))


@query
def byte_sketches(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").cast("binary").alias("content"))
    return K.bytes_sketch(rows, "item_id").select("item_id", "sha256", "bytes", "binary_method", F.size("chunks").alias("chunks"), F.size("binary").alias("binary"))


@query
def content_order(spark, sf_dir):
    """The benchmark's items as files, by content, names and size."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", "text", F.col("text").cast("binary").alias("raw"))
    path = F.concat(F.lit("items/"), F.concat_ws("_", F.slice(F.split("text", " "), 1, 2)), F.lit("_"), F.col("item_id").cast("string"), F.lit(".txt"))
    texts = K.text_sketch(rows.select("item_id", path.alias("path"), "text")).withColumnRenamed("sample", "text_sample").drop("text")
    found = texts.join(K.bytes_sketch(rows.select("item_id", F.col("raw").alias("content")), "item_id"), "item_id")
    empty = F.array().cast("array<struct<slot:string,hash:string,tone:int,aspect:double>>")
    content = F.struct("sha256", "text_sha256", "words", "bytes", "binary_method", "binary", "chunks", F.col("text_sample").alias("text"), empty.alias("visual"), F.lit(0).alias("visual_pages"), F.lit(False).alias("failed"))
    return O.content_order(found.select("path", F.col("bytes").alias("size"), content.alias("content")))


@query
def metadata_lexical(spark, sf_dir):
    """Signed hashed features of page names: (page_id, dimension, value) of unit vectors."""
    rows = page_catalog(spark, sf_dir).select("page_id", X.metadata_features(F.array("path")).alias("m"))
    terms = rows.select("page_id", F.explode(V.lexical_terms(F.col("m.title"), F.col("m.folders"))).alias("t"))
    place, sign = V.hashed_place(F.col("t.term"))
    sums = terms.groupBy("page_id", place.alias("dimension")).agg(F.sum(sign * F.col("t.weight")).alias("v")).filter(F.abs("v") > 1e-9)
    length = sums.groupBy("page_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return sums.join(length, "page_id").select("page_id", "dimension", (F.round(F.col("v") / F.col("n"), 4) + 0.0).alias("value"))


@query
def vector_pairs(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("semantic"))
    return G.near_pairs(rows, 0.3).select("a", "b", F.round("score", 4).alias("score"))


@query
def pair_score_blend(spark, sf_dir):
    """Blend of the whole vector as meaning, its first half as words and its last quarter as layout, of
    neighbours in id order; layout is known for odd labels only."""
    rows = read(spark, sf_dir, "embeddings")
    part = lambda e, a, n: V.unit(F.slice(e, a, n))
    x, y = rows.alias("x"), rows.alias("y")
    both = x.join(y, F.col("y.vec_id") == F.col("x.vec_id") + 1)
    d = lambda a, n: V.dot(part(F.col("x.embedding"), a, n), part(F.col("y.embedding"), a, n))
    layout = F.when((F.col("x.label") % 2 == 1) & (F.col("y.label") % 2 == 1), d(49, 16))
    score = V.pair_score(V.dot(F.col("x.embedding"), F.col("y.embedding")), d(1, 32), F.lit(True), layout)
    return both.select(F.col("x.vec_id").alias("a"), F.col("y.vec_id").alias("b"), (F.round(score, 4) + 0.0).alias("score"))  # no negative zero


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("semantic"))


@query
def vector_groups(spark, sf_dir):
    found = G.average_groups(_vectors(spark, sf_dir), 0.35)
    return G.ranked_groups(found.withColumn("path", F.lpad(F.col("id").cast("string"), 12, "0"))).select("id", "group", "rank", "confidence", G.note(0.35, F.col("confidence"), F.lit(None), F.lit(None), F.array().cast("array<string>")).alias("note"))


@query
def group_id_remap(spark, sf_dir):
    old, new = G.average_groups_at(_vectors(spark, sf_dir), [0.45, 0.35])
    return G.stable_ids(old.select("id", "cluster"), new.select("id", "cluster"))


@query
def weak_label_terms(spark, sf_dir):
    found = L.terms(page_catalog(spark, sf_dir), "page_id")
    return found.groupBy("term").agg(F.count_distinct("id").alias("df"))


@query
def open_set_classes(spark, sf_dir):
    """Labels of the vectors' own classes for the even ids, extended to the others."""
    rows = read(spark, sf_dir, "embeddings")
    labels = rows.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, F.array(F.concat(F.lit("class_"), F.col("label").cast("string")))).otherwise(F.array().cast("array<string>")).alias("labels"))
    return L.open_set_classes(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), labels)


@query
def residual_names(spark, sf_dir):
    rows = part_files(spark, sf_dir).select("path", F.col("p_size").cast("long").alias("size"))
    return G.residual_name_groups(rows)


@query
def rename_series_plan(spark, sf_dir):
    files = part_files(spark, sf_dir)
    return P.series_plan(files.filter("p_size > 1"), "item", files)


@query
def trim_prefix_plan(spark, sf_dir):
    """Names without their first character, a digit in most: many meet, and the first in order gets the name."""
    first = F.when(F.col("p_partkey") % 9 == 0, F.lit("")).otherwise(F.right("p_brand", F.lit(1)))
    path = F.concat(F.lit("p/"), first, "p_name", F.lit(" "), (F.col("p_size") % 10).cast("string"), F.lit(".txt"))
    files = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), path.alias("path"))
    return P.trim_prefix_plan(files.groupBy("path").agg(F.min("number").alias("number")), 1, files)


@query
def flatten_plan(spark, sf_dir):
    """All texts at one level; file names meet, as they are only language and size there."""
    rows = catalog(spark, sf_dir)
    path = F.concat(X.folder(F.col("path")), F.lit("/"), F.col("size").cast("string"), F.lit(".txt"))
    return P.flatten_plan(rows.select(F.col("doc_id").alias("number"), F.concat(F.col("doc_id").cast("string"), F.lit("/"), path).alias("path")))


@query
def shortening_plan(spark, sf_dir):
    rows = page_catalog(spark, sf_dir).select(F.concat(F.lit("pages/"), "path").alias("path")).distinct()
    return P.shortening_plan(rows, "C:/archive", 48)


def _identity(ino, size):
    return F.struct(F.lit(1).cast("long").alias("dev"), ino.cast("long").alias("ino"), size.cast("long").alias("size"), F.lit(7).cast("long").alias("mtime_ns"))


@query
def incremental_refresh(spark, sf_dir):
    """A catalog against a later listing: one source was moved to another folder, and short texts were edited."""
    rows = catalog(spark, sf_dir)
    old = rows.select("path", F.concat(F.lit("first/"), "path").alias("origin"), _identity(F.col("doc_id") + 1, F.col("size")).alias("identity"), "hash")
    new_path = F.when(F.col("path").startswith("src2/"), F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    new_size = F.when(F.col("size") < 200, F.col("size") + 1).otherwise(F.col("size"))
    listing = rows.select(new_path.alias("path"), _identity(F.col("doc_id") + 1, new_size).alias("identity"))
    return C.refresh(old, listing).select("path", "origin", "hash", F.col("identity.size").alias("size"))


@query
def carried_groups(spark, sf_dir):
    """Groups by folder after short texts were edited."""
    rows = catalog(spark, sf_dir).withColumn("group", X.folder(F.col("path")))
    old = rows.select("path", _identity(F.col("doc_id") + 1, F.col("size")).alias("identity"), "group")
    new_size = F.when(F.col("size") < 200, F.col("size") + 1).otherwise(F.col("size"))
    listing = rows.select("path", _identity(F.col("doc_id") + 1, new_size).alias("identity"))
    return G.carried_groups(old, listing).withColumnRenamed("group", "folder")
