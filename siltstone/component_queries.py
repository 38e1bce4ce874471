"""Queries over single components of the catalog operators, each with its DuckDB SQL beside it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.catalog_oracles import CAT, LABELS, PAGES, PART_NAMES, TOKENS
from siltstone.catalog_queries import _identity, backup_manifest, catalog, flat_copy, page_catalog, part_names, read, with_labels
from siltstone.functions import text as X
from siltstone.functions import vectors as V
from siltstone.operators import catalog as C
from siltstone.operators import grouping as G
from siltstone.operators import labels as L
from siltstone.operators import names as N
from siltstone.operators import sketch as K
from siltstone.operators import view as W
from siltstone.operators.ranking import numbered
from siltstone.plans import naming as P
from siltstone.sources import formats as S
from siltstone.sources import manifest as M
from siltstone.sources.scratch import shared_dir
from siltstone.sources.state import load_state, save_state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


COPIES = "r AS (SELECT hash, row_number() OVER (ORDER BY hash) AS k FROM cat WHERE hash <> '' GROUP BY hash HAVING count(*) > 1)"
PLAN = """o AS (
  SELECT hash, path, first_value(path) OVER w AS keep, row_number() OVER w AS k FROM cat WHERE hash <> ''
  WINDOW w AS (PARTITION BY hash ORDER BY len(string_split(path, '/')), lower(path), path)),
plan AS (SELECT hash, keep, path AS remove FROM o WHERE k > 1)"""


@query(f"""WITH {CAT}, c AS (SELECT doc_id, path, CASE WHEN hash = '' THEN path ELSE hash END AS cluster FROM cat),
    st AS (SELECT cluster, count(*) AS n, min(lower(path)) AS f FROM c GROUP BY cluster),
    g AS (SELECT cluster, CAST(row_number() OVER (ORDER BY CASE WHEN n > 1 THEN -n ELSE 0 END, f, cluster) - 1 AS INT) AS "group" FROM st)
    SELECT doc_id, "group", row_number() OVER (ORDER BY "group", lower(path), path) - 1 AS rank FROM c JOIN g USING (cluster)""")
def ranked_copies(spark, sf_dir):
    """Groups of equal texts in their order, and every row's rank."""
    rows = catalog(spark, sf_dir).withColumn("cluster", F.when(F.col("hash") == "", F.col("path")).otherwise(F.col("hash")))
    return G.ranked_groups(rows).select("doc_id", "group", "rank")


@query(f"WITH {CAT}, {PLAN} SELECT hash, keep, remove FROM plan WHERE remove LIKE '%/en/%'")
def duplicate_plan_selected(spark, sf_dir):
    """Copies to remove among the English ones only."""
    rows = catalog(spark, sf_dir)
    return C.duplicate_plan(rows, rows.filter(F.contains("path", F.lit("/en/"))).select("path"))


@query(f"""WITH {CAT}, {PLAN}, gone AS (SELECT remove FROM plan WHERE keep NOT LIKE 'src1/%' AND remove NOT LIKE 'src1/%')
    SELECT doc_id, path FROM cat WHERE path NOT IN (SELECT remove FROM gone)""")
def catalog_without_removed(spark, sf_dir):
    """The catalog after removals; copies that failed their check, as one source changed, stay."""
    rows = catalog(spark, sf_dir)
    now = rows.select("path", F.when(F.col("path").startswith("src1/"), F.lit("changed")).otherwise(F.col("hash")).alias("hash"))
    return C.without(rows, C.verified_removals(C.duplicate_plan(rows), now)).select("doc_id", "path")


@query(f'WITH {CAT} SELECT lng AS "new", src AS old, count(*) AS n FROM cat GROUP BY 1, 2')
def group_overlaps(spark, sf_dir):
    """Documents that old groups, by source, and new ones, by language, have in common."""
    rows = catalog(spark, sf_dir).withColumn("parts", F.split("path", "/"))
    return G.overlaps(rows.select(F.col("doc_id").alias("id"), F.col("parts")[0].alias("cluster")), rows.select(F.col("doc_id").alias("id"), F.col("parts")[1].alias("cluster")))


@query(f"""WITH {CAT} SELECT doc_id, size * 100000 > 134217728 AS size_only, doc_id % 10 = 0 AS transient, doc_id % 10 <> 0 AND doc_id % 4 = 1 AS parallel,
      doc_id % 10 <> 0 AND doc_id % 4 = 2 AS office, doc_id % 10 <> 0 AND doc_id % 4 IN (1, 2) AS cacheable FROM cat""")
def format_predicates(spark, sf_dir):
    """Files 100 000 times as large, of three kinds, each tenth with the name of a lock file."""
    end = F.when(F.col("doc_id") % 4 == 1, ".PDF").when(F.col("doc_id") % 4 == 2, ".docx").otherwise(".txt")
    name = F.concat(F.when(F.col("doc_id") % 10 == 0, "~$").otherwise(""), X.stem(F.col("path")), end)
    kinds = [f(name).alias(n) for n, f in (("transient", W.is_transient), ("parallel", W.is_parallel), ("office", W.is_office), ("cacheable", W.is_cacheable))]
    return catalog(spark, sf_dir).select("doc_id", W.size_only(F.col("size") * 100000).alias("size_only"), *kinds)


@query(f"WITH {CAT} SELECT count(*) AS files, count(*) FILTER (hash = '') AS errors FROM cat")
def scan_status(spark, sf_dir):
    return W.status(catalog(spark, sf_dir).withColumn("error", F.when(F.col("hash") == "", "no content").otherwise(F.lit(None))))


@query(f"""WITH {CAT}, {COPIES} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM cat JOIN r USING (hash)""")
def scope_selected(spark, sf_dir):
    """Totals of the selected rows: those that have copies."""
    rows = C.with_duplicates(catalog(spark, sf_dir))
    return W.totals(W.scope(rows, rows.filter("duplicate > 0")), [])


@query(f"""WITH {CAT}, {COPIES} SELECT doc_id, row_number() OVER (ORDER BY coalesce(k, 9223372036854775807), size DESC, doc_id) AS place FROM cat LEFT JOIN r USING (hash)""")
def sort_grouped(spark, sf_dir):
    """Groups of copies first, by size within them; rows without a group come last."""
    rows = C.with_duplicates(catalog(spark, sf_dir)).withColumn("duplicate_group", F.when(F.col("duplicate") > 0, F.col("duplicate")))
    return numbered(rows, W.sort_keys([("size", True)], "doc_id", "duplicate_group"), "place").select("doc_id", "place")


@query(f"""WITH {CAT}, l AS (SELECT max(doc_id) AS l FROM cat WHERE src = 'src1'), kept AS (SELECT doc_id, path FROM cat WHERE src <> 'src1')
    SELECT coalesce((SELECT arg_min(path, doc_id) FROM kept, l WHERE doc_id > l), (SELECT arg_max(path, doc_id) FROM kept)) AS path""")
def next_row(spark, sf_dir):
    """The row to select once a source is gone."""
    rows = catalog(spark, sf_dir)
    return W.next_after(rows, rows.filter(F.col("path").startswith("src1/")), "doc_id")


@query(f"""WITH w AS (SELECT doc_id, {TOKENS.format("text")} AS w, text FROM documents),
    k AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM w WHERE text IS NOT NULL)
    SELECT min(doc_id) AS first, count(*) AS n FROM k GROUP BY h UNION ALL SELECT doc_id, 1 FROM w WHERE text IS NULL""")
def collapsed_contents(spark, sf_dir):
    """Documents of one content collapsed to the first; unknown contents stay apart."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("sha256"))
    sketched = K.text_sketch(rows).withColumn("content", F.struct("sha256", "text_sha256", "words", F.col("sample").alias("text"), F.lit(False).alias("failed")))
    key = K.fingerprint_key("content", ("sha256", "text_sha256", "words", "text"))
    keyed = sketched.select("doc_id", F.coalesce(F.sha2(key, 256), F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).drop("key")


@query(f"""WITH {CAT}, c AS (SELECT doc_id, quality, toxic, size % 50 AS p, doc_id % 7 <> 0 AS good FROM cat LEFT JOIN labels USING (doc_id))
    SELECT doc_id, coalesce(CASE WHEN good THEN p ELSE quality END, -1) AS pages, NOT good AS pages_estimated,
      coalesce(CASE WHEN good AND doc_id % 3 <> 0 THEN p + 1 ELSE toxic END, -1) AS figures FROM c""")
def refined_counts(spark, sf_dir):
    """Estimated statistics replaced by exact ones; each seventh count failed, each third misses its figures. What nobody knows is -1."""
    rows = with_labels(spark, sf_dir).select("doc_id", "path", "size", F.col("quality").cast("long").alias("pages"), F.col("toxic").cast("long").alias("figures"), F.lit(None).cast("long").alias("tables"), F.lit(True).alias("pages_estimated"))
    pages = F.col("size") % 50
    counts = rows.select("path", pages.alias("pages"), F.when(F.col("doc_id") % 3 != 0, pages + 1).alias("figures"), F.lit(None).cast("long").alias("tables"), (F.col("doc_id") % 7 == 0).alias("failed"))
    known = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return S.refined(rows, counts).select("doc_id", known("pages"), "pages_estimated", known("figures"))


KEYS = f"""{CAT}, b AS (SELECT doc_id, path, size, hex(encode(coalesce(text, ''))) AS h FROM cat JOIN documents USING (doc_id)),
k AS (SELECT doc_id, sha256(path || chr(0) || size || chr(0) || CAST(doc_id * 1000000 AS VARCHAR)) AS exact_key, sha256(path) AS path_key,
  sha256(encode(CAST(size AS VARCHAR)) || unhex(left(h, 8192)) || unhex(right(h, 8192))) AS content_key FROM b)"""


def _keys(spark, sf_dir):
    rows = catalog(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    files = rows.select("path", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"), F.col("size").alias("length"), F.timestamp_seconds("doc_id").alias("modificationTime"))
    return S.cache_keys(files, 4096).join(rows.select("path", "doc_id"), "path")


@query(f"WITH {KEYS} SELECT doc_id, exact_key, path_key, content_key FROM k")
def cache_keys(spark, sf_dir):
    """Keys of every text as a file, by 4096 bytes at both ends."""
    return _keys(spark, sf_dir).select("doc_id", "exact_key", "path_key", "content_key")


@query(f"""WITH {KEYS}, f AS (SELECT content_key, min(doc_id) AS first FROM k GROUP BY content_key)
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'exact' WHEN doc_id % 3 = 0 THEN 'path' ELSE 'content ' || first END AS value FROM k JOIN f USING (content_key)""")
def cache_lookup(spark, sf_dir):
    """What a cache answers that holds some documents by all three keys, some by path and all by content."""
    keys = _keys(spark, sf_dir)
    held = lambda name, mod, value: keys.filter(F.col("doc_id") % mod == 0).select(F.col(name).alias("key"), F.lit(value).alias("value"))
    by_content = keys.groupBy(F.col("content_key").alias("key")).agg(F.concat(F.lit("content "), F.min("doc_id").cast("string")).alias("value"))
    cache = held("exact_key", 5, "exact").unionByName(held("path_key", 3, "path")).unionByName(by_content)
    return S.cached(keys, cache).select("doc_id", "value")


@query(f"WITH {CAT} SELECT doc_id, path FROM cat WHERE size >= 200")
def checked_documents(spark, sf_dir):
    """Rows that still are what the catalog says; short texts were edited."""
    rows = catalog(spark, sf_dir).withColumn("identity", _identity(F.col("doc_id") + 1, F.col("size")))
    now = rows.select("path", _identity(F.col("doc_id") + 1, F.when(F.col("size") < 200, F.col("size") + 1).otherwise(F.col("size"))).alias("identity"))
    return C.unchanged(rows, now).select("doc_id", "path")


@query("""WITH files AS (SELECT p_partkey AS number, CASE WHEN p_partkey % 4 = 0 THEN 'p/New ' ELSE 'p/' END || p_name || ' ' || p_size || '.txt' AS path FROM part),
    mine AS (SELECT path, min(number) AS number FROM files GROUP BY path),
    sel AS (SELECT path, number, 'p/new ' || substr(path, 3) AS d FROM mine WHERE path NOT LIKE 'p/New %'),
    t AS (SELECT path, d, lower(d) IN (SELECT lower(path) FROM files) AS taken FROM sel)
    SELECT path, CASE WHEN NOT taken THEN d END AS destination, CASE WHEN taken THEN 'name exists' END AS error FROM t""")
def add_prefix_plan(spark, sf_dir):
    """A prefix that a quarter of the files carries already: those names are taken, in any case."""
    start = F.when(F.col("p_partkey") % 4 == 0, F.lit("p/New ")).otherwise(F.lit("p/"))
    files = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), F.concat(start, "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(".txt")).alias("path"))
    mine = files.filter(~F.col("path").startswith("p/New ")).groupBy("path").agg(F.min("number").alias("number"))
    return P.add_prefix_plan(mine, "new ", files)


@query("""SELECT page_id, 'read "<path>" of ?' || url AS message FROM pages""")
def error_messages(spark, sf_dir):
    """Messages with a Windows path and a control character."""
    said = F.concat(F.lit('read "C:\\archive\\p '), F.col("page_id").cast("string"), F.lit('.html" of \x07'), F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", X.sanitize(said).alias("message"))


@query(f"WITH {PAGES} SELECT page_id, page_id % 7 IN (0, 4) AS safe FROM pg")
def safe_paths(spark, sf_dir):
    """Paths of pages as they are, and made unsafe in five ways."""
    path, kind = F.col("path"), F.col("page_id") % 7
    made = (
        F.when(kind == 1, F.concat(F.lit("/"), path)).when(kind == 2, F.concat(F.lit("a/../"), path)).when(kind == 3, F.concat(F.lit("C:"), path)).when(kind == 5, F.concat(F.lit("a//"), path))
        .when(kind == 6, F.concat(F.lit("a\\"), path)).when(kind == 4, F.concat(F.lit("a/..b/"), path)).otherwise(path)
    )
    return page_catalog(spark, sf_dir).select("page_id", X.is_safe(made).alias("safe"))


@query(f"""WITH {CAT} SELECT 'now/' || path AS path, CASE WHEN src = 'src2' THEN 'first/' || path ELSE 'now/' || path END AS origin, hash FROM cat""")
def refresh_moves(spark, sf_dir):
    """A tree copied to another disk, where nothing has its identity: completed moves of one source, told by
    their hash, restore the origin."""
    rows = catalog(spark, sf_dir)
    old = rows.select("path", F.concat(F.lit("first/"), "path").alias("origin"), _identity(F.col("doc_id") + 1, F.col("size")).alias("identity"), "hash")
    listing = rows.select(F.concat(F.lit("now/"), "path").alias("path"), _identity(F.lit(0), F.col("size")).alias("identity"))
    moves = rows.filter(F.col("path").startswith("src2/") & (F.col("hash") != "")).select(F.concat(F.lit("now/"), "path").alias("destination"), F.concat(F.lit("first/"), "path").alias("origin"), "hash")
    hashes = rows.select(F.concat(F.lit("now/"), "path").alias("path"), "hash")
    return C.fill_hashes(C.refresh(old, listing), hashes, moves=moves).select("path", "origin", "hash")


@query(f"""WITH {CAT}, c AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE size END AS s FROM cat), o AS (SELECT hash, s, list_sort(list_distinct(list(path))) AS origins FROM c WHERE hash <> '' GROUP BY ALL)
    SELECT doc_id, CASE WHEN len(o.origins) = 1 THEN o.origins[1] ELSE 'flat_' || doc_id || '.txt' END AS origin, coalesce(array_to_string(o.origins, '|'), '') AS origins,
      CASE WHEN len(o.origins) = 1 THEN 'matched' WHEN len(o.origins) > 1 THEN 'ambiguous' ELSE 'unmatched' END AS origin_match FROM c LEFT JOIN o ON c.hash = o.hash AND c.s IS NOT DISTINCT FROM o.s""")
def manifest_round_trip(spark, sf_dir):
    """A manifest written, read back and matched with a flat copy; some rows have no size, copies are ambiguous."""
    sized = lambda rows: rows.withColumn("size", F.when(F.col("doc_id") % 11 != 0, F.col("size")))
    path = f"{shared_dir(spark)}/siltstone/{uuid.uuid4().hex}/manifest"
    M.write_manifest(sized(catalog(spark, sf_dir)).filter("hash <> ''"), path)
    found = M.reconcile(sized(flat_copy(spark, sf_dir)), M.read_manifest(spark, path))
    return found.select("doc_id", "origin", F.coalesce(F.array_join("origins", "|"), F.lit("")).alias("origins"), "origin_match")


@query(f"""WITH {CAT}, o AS (SELECT DISTINCT hash, size FROM cat WHERE hash <> '') SELECT hash, size, list_sort(list_distinct(list(path)))[1] AS first, CAST(count(DISTINCT path) AS INT) AS n FROM cat JOIN o USING (hash, size) GROUP BY ALL""")
def content_origins(spark, sf_dir):
    return M.known_origins(backup_manifest(spark, sf_dir).withColumn("kind", F.lit("file"))).select("hash", "size", F.element_at("origins", 1).alias("first"), F.size("origins").alias("n"))


@query(f"WITH {CAT} SELECT doc_id AS id, path AS source, doc_id % 2 = 0 AS done FROM cat")
def journal_replay(spark, sf_dir):
    """Moves against a journal that has every even one, some twice, and a torn last line."""
    moves = catalog(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("path").alias("source"))
    line = F.concat(F.lit('{"id": "'), "id", F.lit('", "state": "done"}'))
    even = moves.filter(F.col("id").cast("long") % 2 == 0)
    journal = even.select(line.alias("value")).unionByName(even.filter(F.col("id").cast("long") % 3 == 0).select(line.alias("value")))
    torn = moves.filter("id = '1'").select(F.lit('{"id": "1", "sta').alias("value"))
    return M.replay(moves, journal.unionByName(torn)).select(F.col("id").cast("long").alias("id"), "source", "done")


HEX = "SELECT doc_id, sha256(coalesce(text, '')) || sha256('x' || coalesce(text, '')) AS h FROM documents"


def _hashed(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.sha2(text, 256), F.sha2(F.concat(F.lit("x"), text), 256)).alias("h"))


@query(f"""WITH v AS ({HEX}) SELECT x.doc_id, round(1 - bit_count(xor(CAST(unhex(x.h) AS BIT), CAST(unhex(y.h) AS BIT))) / 512.0, 6) AS score FROM v x JOIN v y ON y.doc_id = x.doc_id + 1""")
def hash_likeness(spark, sf_dir):
    """The share of equal bits in 512-bit hashes of neighbours in id order."""
    rows = _hashed(spark, sf_dir)
    both = rows.join(rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("g")), "doc_id")
    return both.select("doc_id", F.round(K.hamming512(F.col("h"), F.col("g")), 6).alias("score"))


@query(f"""WITH v AS ({HEX}), b AS (SELECT doc_id, i AS band, substr(h, CAST(i * 4 + 1 AS BIGINT), 4) AS digits FROM v, range(0, 32) AS r(i))
    SELECT 'page' AS slot, CAST(band AS INT) AS band, digits, count(*) AS n FROM b GROUP BY band, digits HAVING count(*) > 1""")
def visual_band_counts(spark, sf_dir):
    """Bands of image hashes that more than one document has; hashes stand in for images."""
    visual = F.array(F.struct(F.lit("page").alias("slot"), F.col("h").alias("hash")))
    keys = _hashed(spark, sf_dir).select("doc_id", F.explode(K.visual_bands(visual)).alias("k"))
    return keys.groupBy("k.slot", "k.band", "k.digits").agg(F.count("*").alias("n")).filter("n > 1")


@query(f"""WITH {PART_NAMES}, wf AS (SELECT name, kind, feature, df FROM weighted JOIN df USING (kind, feature)),
    tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY df, kind DESC, feature) AS r FROM wf) WHERE r <= 24 AND df <= 512),
    sh AS (SELECT x.name AS b, y.name AS a, count(*) AS n FROM tr x JOIN wf y ON x.kind = y.kind AND x.feature = y.feature AND y.name < x.name GROUP BY 1, 2)
    SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS r FROM sh) WHERE r <= 64""")
def rare_name_candidates(spark, sf_dir):
    """For each name the earlier ones that share most of its rarest features."""
    return N.rare_candidates(N.features(part_names(spark, sf_dir)))


@query(r"""SELECT doc_id, CAST(length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS INT) AS units FROM documents""")
def utf16_units(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.units(F.col("text")).alias("units"))


@query(f"""WITH RECURSIVE {CAT}, s AS (SELECT DISTINCT size FROM cat),
    anchor(a) AS (SELECT min(size) FROM s UNION ALL
      SELECT (SELECT min(size) FROM s WHERE size > a AND (a = 0 OR a / CAST(size AS DOUBLE) < 0.95)) FROM anchor WHERE a IS NOT NULL AND a < (SELECT max(size) FROM s))
    SELECT path, '.txt' AS type, size, CAST((SELECT count(*) FROM anchor WHERE a <= size) - 1 AS INT) AS band FROM cat""")
def size_bands(spark, sf_dir):
    return G.bands(catalog(spark, sf_dir))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT vec_id, list_transform(range(1, 65), lambda i: e[i] * 0.6 * 0.8 + e[65 - i] * 0.4) AS s FROM v)
    SELECT vec_id, round(s[1] / sqrt(list_dot_product(s, s)), 4) + 0.0 AS first, round(s[64] / sqrt(list_dot_product(s, s)), 4) + 0.0 AS last FROM s""")
def refreshed_vectors(spark, sf_dir):
    """Vectors made again from their cached content part, of norm 0.8, and new metadata: the reversed vector at 0.4."""
    rows = read(spark, sf_dir, "embeddings")
    made = V.refreshed(F.col("embedding"), F.lit(0.8), V.scale(F.reverse("embedding"), 0.4))
    return rows.select("vec_id", made.alias("v")).select("vec_id", (F.round(F.col("v")[0], 4) + 0.0).alias("first"), (F.round(F.col("v")[63], 4) + 0.0).alias("last"))


@query(f"WITH RECURSIVE {PAGES}, {LABELS} SELECT term, label FROM named")
def weak_label_aliases(spark, sf_dir):
    """The label of every usable term: terms that nearly the same pages have are one."""
    rows = page_catalog(spark, sf_dir)
    found = L.terms(rows, "page_id")
    return L.aliases(found, L.usable_terms(found, rows.count()))


@query(f"WITH RECURSIVE {PAGES}, {LABELS} SELECT label, count(DISTINCT page_id) AS support FROM held JOIN named USING (term) GROUP BY label")
def weak_label_support(spark, sf_dir):
    return L.weak_labels(page_catalog(spark, sf_dir), "page_id")[1]


@query(f"""WITH RECURSIVE {PAGES}, {LABELS}, g AS (
      SELECT page_id, list_sort(list_distinct(coalesce(list(label) FILTER (in_name), []))) AS n, list_sort(list_distinct(coalesce(list(label) FILTER (in_folder), []))) AS f FROM held JOIN named USING (term) GROUP BY page_id)
    SELECT page_id, coalesce(array_to_string(CASE WHEN len(n) = 1 THEN n ELSE list_sort(list_distinct(n || f)) END, '|'), '') AS labels FROM pg LEFT JOIN g USING (page_id)""")
def weak_labels(spark, sf_dir):
    labels, _ = L.weak_labels(page_catalog(spark, sf_dir), "page_id")
    return labels.select(F.col("id").alias("page_id"), F.array_join("labels", "|").alias("labels"))


@query(f"WITH {CAT} SELECT doc_id, path FROM cat WHERE doc_id % 5 <> 1 AND doc_id % 7 <> 2")
def listing_without_links(spark, sf_dir):
    """A listing in which each fifth file is a symbolic link, and each seventh a surrogate for another."""
    rows = catalog(spark, sf_dir)
    mode = F.when(F.col("doc_id") % 5 == 1, 0o120777).when(F.col("doc_id") % 5 == 2, F.lit(None)).otherwise(0o100644)
    tag = F.when(F.col("doc_id") % 7 == 2, F.lit(0xA0000003)).when(F.col("doc_id") % 7 == 3, F.lit(0x80000013))
    return C.without_links(rows.withColumns({"mode": mode, "reparse_tag": tag})).select("doc_id", "path")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 4 END + 2 AS person, doc_id % 4 AS date, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS org FROM documents""")
def entity_totals(spark, sf_dir):
    """Counts of entities from names and from contents; each third content has none."""
    own = F.create_map(F.lit("person"), F.lit(2), F.lit("date"), (F.col("doc_id") % 4).cast("int"))
    found = F.when(F.col("doc_id") % 3 != 0, F.create_map(F.lit("person"), (F.col("doc_id") % 4).cast("int"), F.lit("org"), F.lit(1)))
    total = read(spark, sf_dir, "documents").select("doc_id", G.entity_totals(own, found).alias("t"))
    return total.select("doc_id", *[F.coalesce(F.try_element_at("t", F.lit(k)), F.lit(0)).alias(k) for k in ("person", "date", "org")])


@query(f"""WITH {CAT} SELECT doc_id, doc_id % 3 = 0 AS countable FROM cat WHERE doc_id % 4 <> 0""")
def pending_statistics(spark, sf_dir):
    """Rows to analyse again: statistics missing, of an old schema or failed; some can't be counted at all."""
    left = F.col("doc_id") % 4
    stats = F.when(left != 1, F.struct(F.when(left == 2, 1).otherwise(2).alias("schema"), (left == 3).alias("failed")))
    path = F.concat(X.folder(F.col("path")), F.lit("/"), F.when(F.col("doc_id") % 3 == 1, "~$").otherwise(""), X.stem(F.col("path")), F.when(F.col("doc_id") % 3 == 2, ".txt").otherwise(".docx"))
    rows = catalog(spark, sf_dir).withColumn("stats", stats)
    return S.to_analyze(rows).select("doc_id", S.can_count(path).alias("countable"))


@query(f"""WITH {CAT}, c AS (SELECT doc_id % 3 <> 2 AS able, doc_id % 7 <> 0 AND size >= 200 AND doc_id % 13 <> 0 AS good FROM cat)
    SELECT count(*) FILTER (able AND good) AS updated, count(*) FILTER (able AND NOT good) AS errors, count(*) FILTER (NOT able) AS skipped FROM c""")
def refinement_summary(spark, sf_dir):
    """A refinement in which each third file is no word document, each seventh count failed, each thirteenth
    is missing, and short texts were edited."""
    path = F.concat(F.regexp_replace("path", "[.]txt$", ""), F.when(F.col("doc_id") % 3 == 2, ".txt").otherwise(".docx"))
    rows = catalog(spark, sf_dir).withColumn("path", path).withColumn("identity", _identity(F.col("doc_id") + 1, F.col("size")))
    now = _identity(F.col("doc_id") + 1, F.when(F.col("size") < 200, F.col("size") + 1).otherwise(F.col("size")))
    counts = rows.filter(F.col("doc_id") % 13 != 0).select("path", now.alias("identity"), F.when(F.col("doc_id") % 7 == 0, True).alias("failed"))
    return S.refinement_summary(rows, counts)


@query("""SELECT CASE WHEN doc_id % 4 = 2 THEN '.docx' ELSE '.txt' END AS suffix, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1""")
def uncached_suffixes(spark, sf_dir):
    """What a cache that knows each fifth document lacks, by suffix."""
    path = F.concat(X.folder(F.col("path")), F.lit("/"), X.stem(F.col("path")), F.when(F.col("doc_id") % 4 == 2, ".docx").otherwise(".txt"))
    return S.uncached_by_suffix(catalog(spark, sf_dir).select(path.alias("path"), F.when(F.col("doc_id") % 5 == 0, "known").alias("value")))


@query(f"WITH {CAT} SELECT doc_id, path FROM cat WHERE size < 200 ORDER BY doc_id LIMIT 10")
def first_errors(spark, sf_dir):
    """The first ten rows with an error, as a report shows them; short texts stand for those."""
    return W.first_rows(catalog(spark, sf_dir).filter("size < 200"), [F.col("doc_id")], 10).select("doc_id", "path")


@query(f"WITH {CAT} SELECT doc_id, path, hash, size + 1 AS size FROM cat")
def state_versions(spark, sf_dir):
    """The catalog saved twice, the second time with other sizes, and loaded."""
    path = f"{shared_dir(spark)}/siltstone/{uuid.uuid4().hex}/state"
    rows = catalog(spark, sf_dir).select("doc_id", "path", "hash", "size")
    save_state(rows, path)
    save_state(load_state(spark, path).withColumn("size", F.col("size") + 1), path)
    return load_state(spark, path)
