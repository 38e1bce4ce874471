"""DuckDB SQL for the registered queries over the catalog operators. Sequential and iterative operators have none."""

CAT = r"""cat AS (
  SELECT doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') || '/doc_' || doc_id || '.txt' AS path,
    coalesce(source, 'unknown') AS src, coalesce(lang, 'unknown') AS lng,
    CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS size, coalesce(sha256(text), '') AS hash
  FROM documents)"""
TOKENS = r"regexp_extract_all(replace(lower(coalesce({0}, '')), 'ё', 'е'), '[\p{{L}}\p{{N}}]+')"
SKETCH = r"""w AS (
  SELECT {id} AS id, {tokens} AS w FROM {table}
), sk AS (
  SELECT id, len(w) AS words, sha256(array_to_string(w, chr(0)) || CASE WHEN len(w) > 0 THEN chr(0) ELSE '' END) AS class,
    list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: substr(sha256(array_to_string(w[i:i + 4], chr(0))), 1, 16))))[1:256] AS sample
  FROM w
), cls AS (SELECT class, min(id) AS id, any_value(words) AS words, any_value(sample) AS sample FROM sk WHERE words >= 10 GROUP BY class)"""
DOC_SKETCH = SKETCH.format(id="doc_id", tokens=TOKENS.format("text"), table="documents")
CANDIDATES = r""", e AS (SELECT id, class, words, unnest(sample) AS h FROM cls),
cand AS (
  SELECT x.id AS a, y.id AS b, count(*) AS shared FROM e x JOIN e y ON x.h = y.h AND x.id < y.id
  WHERE x.words >= y.words * 0.8 AND y.words >= x.words * 0.8 GROUP BY 1, 2)"""
SCORE = r"""len(list_intersect(list_sort(list_distinct(x.sample || y.sample))[1:256], list_intersect(x.sample, y.sample)))
    / CAST(len(list_sort(list_distinct(x.sample || y.sample))[1:256]) AS DOUBLE)"""
PART_NAMES = r"""n AS (
  SELECT DISTINCT array_to_string(list_sort(regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_type), '[\p{L}\p{N}]+')), ' ') AS name FROM part
), words AS (SELECT name, unnest(string_split(name, ' ')) AS word FROM n),
f AS (
  SELECT name, 'w' AS kind, word AS feature FROM words WHERE length(word) > 1 AND word NOT IN ('копия', 'copy', 'final', 'версия')
  UNION ALL
  SELECT name, 'c', substr(word, i, k) FROM words, (VALUES (3), (4)) AS k(k), range(1, 200) AS r(i)
  WHERE NOT regexp_full_match(word, '[0-9]+') AND i + k - 1 <= length(word)
), tf AS (SELECT name, kind, feature, count(*) AS tf FROM f GROUP BY ALL),
df AS (SELECT kind, feature, count(*) AS df FROM tf GROUP BY ALL),
raw AS (
  SELECT name, kind, feature, (1 + ln(tf)) * (1 + ln((1.0 + (SELECT count(*) FROM n)) / (1 + df)))
    * CASE WHEN regexp_full_match(feature, '[0-9]+') THEN 0.25 ELSE 1.0 END AS raw FROM tf JOIN df USING (kind, feature)
), weighted AS (SELECT name, kind, feature, raw / sqrt(sum(raw * raw) OVER (PARTITION BY name, kind)) AS weight FROM raw)"""
PARTS = r"""files AS (
  SELECT p_partkey AS number, p_size, CASE WHEN p_size = 1 THEN 'parts/item #' || p_partkey || '.txt'
    ELSE 'parts/' || p_type || '/' || p_name || ' ' || p_partkey || '.txt' END AS path FROM part)"""
PAGES = r"""pg AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || '.html' AS path FROM pages)"""
LABEL_TERMS = r"""piece AS (
  SELECT page_id, true AS in_name, regexp_replace(regexp_replace(path, '^.*/', ''), '(.)\.[^.]+$', '\1') AS piece FROM pg
  UNION ALL SELECT page_id, false, unnest(string_split(regexp_replace(path, '(^|/)[^/]*$', ''), '/')) FROM pg
), tok AS (
  SELECT page_id, in_name, list_transform(regexp_extract_all(replace(lower(piece), 'ё', 'е'), '[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*'), lambda t: replace(t, '-', '_')) AS t FROM piece
), useful AS (
  SELECT page_id, in_name, list_transform(t, lambda x: CASE WHEN x NOT IN ('без', 'для', 'документ', 'документы', 'копия', 'новый', 'новая', 'новое', 'от', 'по', 'проект',
    'редакция', 'скан', 'файл', 'файлы', 'and', 'copy', 'document', 'documents', 'file', 'final', 'new', 'the', 'version') AND length(x) >= 2
    AND NOT regexp_full_match(x, '(?:v|ver|версия)?[0-9]+[a-zа-я]?') AND regexp_matches(x, '\p{L}') THEN x END) AS u FROM tok
), term AS (
  SELECT page_id, in_name, unnest(u) AS term FROM useful
  UNION ALL SELECT page_id, in_name, unnest(list_transform(range(1, len(u)), lambda i: u[i] || '_' || u[i + 1])) FROM useful
)"""
LABELS = (
    LABEL_TERMS
    + r""", found AS (SELECT page_id, term, bool_or(in_name) AS in_name, bool_or(NOT in_name) AS in_folder FROM term WHERE term IS NOT NULL GROUP BY 1, 2),
usable AS (SELECT term, count(*) AS df FROM found GROUP BY term HAVING count(*) >= 5 AND count(*) < greatest(5, CAST(floor((SELECT count(*) FROM pg) * CAST(0.8 AS DOUBLE)) AS BIGINT) + 1)),
held AS (SELECT page_id, term, df, in_name, in_folder FROM found JOIN usable USING (term)),
edge AS (SELECT x.term AS a, y.term AS b FROM held x JOIN held y ON x.page_id = y.page_id AND x.term < y.term GROUP BY x.term, y.term, x.df, y.df
  HAVING count(*) / least(x.df, y.df) >= 0.85 AND greatest(x.df, y.df) / least(x.df, y.df) <= 1.25),
both_ways AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge),
reach(term, root) AS (SELECT term, term FROM usable UNION SELECT both_ways.b, reach.root FROM reach JOIN both_ways ON reach.term = both_ways.a),
rooted AS (SELECT term, min(root) AS root FROM reach GROUP BY term),
best AS (SELECT root, first(term ORDER BY contains(term, '_') DESC, length(term), term) AS label FROM rooted GROUP BY root),
named AS (SELECT term, label FROM rooted JOIN best USING (root))"""
)

ORACLES: dict[str, str] = {
    "catalog_scan": f"WITH {CAT} SELECT doc_id, path, 'doc_' || doc_id || '.txt' AS name, src || '/' || lng AS folder, '.txt' AS type, size, hash FROM cat",
    "duplicate_groups": f"""WITH {CAT}, r AS (SELECT hash, CAST(row_number() OVER (ORDER BY hash) AS INT) AS k FROM cat WHERE hash <> '' GROUP BY hash HAVING count(*) > 1)
        SELECT doc_id, hash, coalesce(k, 0) AS duplicate FROM cat LEFT JOIN r USING (hash)""",
    "duplicate_labels": f"""WITH {CAT}, r AS (SELECT hash, row_number() OVER (ORDER BY hash) AS k FROM cat WHERE hash <> '' GROUP BY hash HAVING count(*) > 1)
        SELECT doc_id, CASE WHEN k IS NOT NULL THEN '#' || k WHEN hash = '' THEN 'Не проверен' ELSE '—' END AS label FROM cat LEFT JOIN r USING (hash)""",
    "duplicate_plan": f"""WITH {CAT}, o AS (
          SELECT hash, path, first_value(path) OVER w AS keep, row_number() OVER w AS k FROM cat WHERE hash <> ''
          WINDOW w AS (PARTITION BY hash ORDER BY len(string_split(path, '/')), lower(path), path))
        SELECT hash, keep, path AS remove FROM o WHERE k > 1""",
    "duplicate_summary": f"""WITH {CAT}, g AS (SELECT hash, count(*) AS n FROM cat GROUP BY hash)
        SELECT CAST(sum(n) AS BIGINT) AS files, CAST(coalesce(sum(n) FILTER (hash <> ''), 0) AS BIGINT) AS hashed, CAST(coalesce(sum(n) FILTER (hash = ''), 0) AS BIGINT) AS unchecked,
          count(*) FILTER (hash <> '' AND n > 1) AS groups, CAST(coalesce(sum(n - 1) FILTER (hash <> '' AND n > 1), 0) AS BIGINT) AS extra_copies FROM g""",
    "verified_removals": f"""WITH {CAT}, o AS (
          SELECT hash, path, first_value(path) OVER w AS keep, row_number() OVER w AS k FROM cat WHERE hash <> ''
          WINDOW w AS (PARTITION BY hash ORDER BY len(string_split(path, '/')), lower(path), path))
        SELECT hash, keep, path AS remove, keep NOT LIKE 'src1/%' AND path NOT LIKE 'src1/%' AS ok FROM o WHERE k > 1""",
    "filter_text_all": "SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'the')",
    "filter_text_any": "SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'trash')",
    "filter_text_whole": f"SELECT doc_id, lang, source FROM documents WHERE list_contains({TOKENS.format('text')}, 'under') AND list_contains({TOKENS.format('text')}, 'that')",
    "filter_text_exclude": "SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'license') AND NOT contains(lower(text), 'apache') AND NOT contains(lower(text), 'mit')",
    "filter_numeric_unknown": f"WITH {CAT} SELECT doc_id, quality, size FROM cat LEFT JOIN labels USING (doc_id) WHERE quality BETWEEN 0 AND 1 AND size BETWEEN 100 AND 5000",
    "search_global": f"WITH {CAT} SELECT doc_id, path FROM cat WHERE contains(lower(path || ' ' || path), 'src1/en/')",
    "sort_multi_nulls": f"WITH {CAT} SELECT doc_id, row_number() OVER (ORDER BY coalesce(quality, -1) DESC, size, doc_id) AS place FROM cat LEFT JOIN labels USING (doc_id)",
    "sort_natural": "SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS place FROM documents",
    "walk_order": f"WITH {CAT} SELECT doc_id, row_number() OVER (ORDER BY src, lng, 'doc_' || doc_id || '.txt') AS place FROM cat",
    "totals_partial": f"""WITH {CAT} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(quality) AS BIGINT) AS quality, count(quality) AS quality_known,
          count(quality) < count(*) AS quality_incomplete, CAST(sum(toxic) AS BIGINT) AS toxic, count(toxic) AS toxic_known, true AS toxic_incomplete FROM cat LEFT JOIN labels USING (doc_id)""",
    "metric_labels": "SELECT doc_id, CASE WHEN quality IS NULL THEN '—' WHEN toxic = 1 THEN '≈' || quality ELSE '' || quality END AS quality FROM documents LEFT JOIN labels USING (doc_id)",
    "provenance_match": f"""WITH {CAT}, o AS (SELECT hash, size, list_sort(list_distinct(list(path))) AS origins FROM cat WHERE hash <> '' GROUP BY ALL)
        SELECT doc_id, CASE WHEN len(origins) = 1 THEN origins[1] ELSE 'flat_' || doc_id || '.txt' END AS origin, coalesce(array_to_string(origins, '|'), '') AS origins,
          CASE WHEN len(origins) = 1 THEN 'matched' WHEN len(origins) > 1 THEN 'ambiguous' ELSE 'unmatched' END AS origin_match FROM cat LEFT JOIN o USING (hash, size)""",
    "provenance_summary": f"""WITH {CAT}, o AS (SELECT hash, size, count(DISTINCT path) AS n FROM cat WHERE hash <> '' GROUP BY ALL)
        SELECT count(n) AS matched, count(*) FILTER (n > 1) AS ambiguous, count(*) - count(n) AS unmatched FROM cat LEFT JOIN o USING (hash, size)""",
    "manifest_rows": f"""WITH {CAT} SELECT 'file' AS kind, path AS current_path, path AS original_path, CAST(size AS VARCHAR) AS size, hash AS sha256, '["' || path || '"]' AS origin_candidates FROM cat
        UNION ALL SELECT DISTINCT 'directory', '', d, '', '', '[]' FROM (SELECT src AS d FROM cat UNION SELECT src || '/' || lng FROM cat)""",
    "empty_directories": f"""WITH {CAT}, d AS (SELECT src AS d FROM cat UNION SELECT src || '/' || lng FROM cat),
        k AS (SELECT src AS d FROM cat WHERE lng NOT IN ('fr', 'es') UNION SELECT src || '/' || lng FROM cat WHERE lng NOT IN ('fr', 'es'))
        SELECT d AS path, CAST(len(string_split(d, '/')) AS INT) AS depth FROM d ANTI JOIN k USING (d)""",
    "origin_tag": f"""WITH {CAT} SELECT doc_id, 'source-folder-' || substr(sha256(lower(src || '/' || lng)), 1, 12) AS tag,
          round(CAST('0x' || substr(sha256(lower(src || '/' || lng)), 1, 8) AS BIGINT) / 4294967296.0, 6) AS hue FROM cat""",
    "metadata_keys": f"WITH {CAT} SELECT doc_id, sha256('old ' || lower(path) || chr(0) || lower(path)) AS key FROM cat",
    "composed_names": f"WITH {CAT} SELECT doc_id, 'new_text_' || src || '_' || lng || '_doc_' || doc_id || '.txt' AS before, 'doc_' || doc_id || '_' || lng || '.txt' AS after FROM cat",
    "preview_text": r"""WITH r AS (SELECT doc_id, text, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS r FROM documents WHERE text IS NOT NULL),
        k AS (SELECT doc_id, left(text, 120) AS head, len(r) AS n, array_to_string(r[1:5], chr(10)) AS k FROM r)
        SELECT doc_id, sha256(CASE WHEN n > 5 OR length(k) > 400 THEN rtrim(left(k, 400)) || chr(10) || '…' ELSE k END) AS preview,
          CASE WHEN length(head) > 86 THEN left(head, 42) || '…' || right(head, 42) ELSE head END AS label FROM k""",
    "guarded_cells": """SELECT event_id, CASE WHEN value < 50 THEN '''-' || event_type WHEN value < 60 THEN '''''' || event_type ELSE event_type END AS cell, true AS same FROM events""",
    "name_key_groups": r"SELECT array_to_string(list_sort(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+')), ' ') AS name, count(*) AS n FROM part GROUP BY 1",
    "name_tfidf": f"WITH {PART_NAMES} SELECT name, kind, feature, round(weight, 4) AS weight FROM weighted",
    "name_pairs": f"""WITH {PART_NAMES} SELECT x.name AS a, y.name AS b, round(sum(x.weight * y.weight * CASE WHEN x.kind = 'w' THEN 0.65 ELSE 0.35 END), 4) AS score
        FROM weighted x JOIN weighted y ON x.kind = y.kind AND x.feature = y.feature AND x.name < y.name
        GROUP BY 1, 2 HAVING sum(x.weight * y.weight * CASE WHEN x.kind = 'w' THEN 0.65 ELSE 0.35 END) >= 0.62 - 1e-7""",
    "text_sketch": f"WITH {DOC_SKETCH} SELECT id AS doc_id, CAST(words AS BIGINT) AS words, class AS text_sha256, sha256(array_to_string(sample, ',')) AS sample_sha256, CAST(len(sample) AS INT) AS sampled FROM sk",
    "near_dup_candidates": f"WITH {DOC_SKETCH}{CANDIDATES} SELECT a, b, shared FROM cand",
    "near_dup_pairs": f"""WITH {DOC_SKETCH}{CANDIDATES}, s AS (
          SELECT a, b, {SCORE} AS score FROM cand JOIN cls x ON x.id = a JOIN cls y ON y.id = b)
        SELECT a, b, round(score, 6) AS score FROM s WHERE score >= 0.82""",
    "cross_corpus_pairs": f"""WITH {DOC_SKETCH}, own AS (SELECT doc_id AS id, source < 'src2' AS mine FROM documents), able AS (SELECT * FROM sk JOIN own USING (id) WHERE words >= 10 AND mine IS NOT NULL),
        one AS (SELECT mine, class, min(id) AS id, any_value(words) AS words, any_value(sample) AS sample FROM able GROUP BY mine, class),
        e AS (SELECT mine, id, class, words, unnest(sample) AS h FROM one),
        pr AS (SELECT DISTINCT e1.id AS a, e2.id AS b FROM e e1 JOIN e e2 USING (h) WHERE e1.mine AND NOT e2.mine AND e1.class <> e2.class AND e1.words >= e2.words * 0.8 AND e2.words >= e1.words * 0.8),
        s AS (SELECT a, b, {SCORE} AS score FROM pr JOIN one x ON x.id = a JOIN one y ON y.id = b
          UNION ALL SELECT x.id, y.id, 1.0 FROM one x JOIN one y USING (class) WHERE x.mine AND NOT y.mine)
        SELECT a, b, round(score, 6) AS score FROM s WHERE score >= 0.82""",
    "vector_pairs": """SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 4) AS score
        FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) >= 0.3""",
    "pair_score_blend": """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.e, y.e) AS s,
          list_dot_product(x.e[1:32], y.e[1:32]) / sqrt(list_dot_product(x.e[1:32], x.e[1:32])) / sqrt(list_dot_product(y.e[1:32], y.e[1:32])) AS l,
          CASE WHEN x.label % 2 = 1 AND y.label % 2 = 1 THEN list_dot_product(x.e[49:64], y.e[49:64]) / sqrt(list_dot_product(x.e[49:64], x.e[49:64])) / sqrt(list_dot_product(y.e[49:64], y.e[49:64])) END AS g
          FROM v x JOIN v y ON y.vec_id = x.vec_id + 1)
        SELECT a, b, round(CASE WHEN g IS NULL THEN 0.6 * s + 0.4 * l ELSE greatest(0.6 * s + 0.4 * l, 0.55 * (0.6 * s + 0.4 * l) + 0.45 * g) END, 4) + 0.0 AS score FROM p""",
    "weak_label_terms": f"WITH {PAGES}, {LABEL_TERMS} SELECT term, count(DISTINCT page_id) AS df FROM term WHERE term IS NOT NULL GROUP BY term",
    "rename_series_plan": f"""WITH {PARTS}, occ AS (SELECT number AS n FROM files WHERE p_size = 1),
        sel AS (SELECT path, row_number() OVER (ORDER BY number) AS r FROM files WHERE p_size > 1),
        free AS (SELECT n, row_number() OVER (ORDER BY n) AS r FROM (SELECT unnest(range(1, (SELECT count(*) FROM files) + 1)) AS n) WHERE n NOT IN (SELECT n FROM occ)),
        al AS (SELECT path, n FROM sel JOIN free USING (r) UNION ALL SELECT path, number FROM files WHERE p_size = 1),
        wd AS (SELECT greatest(2, max(length(CAST(n AS VARCHAR)))) AS w FROM al),
        pl AS (SELECT path, CASE WHEN path LIKE 'parts/item #%' THEN 'parts' ELSE regexp_replace(path, '/[^/]*$', '') END || '/item #' || lpad(CAST(n AS VARCHAR), CAST(w AS INT), '0') || '.txt' AS destination FROM al, wd)
        SELECT path, destination FROM pl WHERE path <> destination""",
    "trim_prefix_plan": """WITH files AS (SELECT p_partkey AS number, 'p/' || CASE WHEN p_partkey % 9 = 0 THEN '' ELSE right(p_brand, 1) END || p_name || ' ' || p_size % 10 || '.txt' AS path FROM part),
        sel AS (SELECT path, min(number) AS number, 'p/' || substr(path, 4) AS d FROM files GROUP BY path),
        t AS (SELECT *, lower(d) IN (SELECT lower(path) FROM files) AS taken FROM sel),
        o AS (SELECT *, row_number() OVER (PARTITION BY lower(d) ORDER BY number) AS r FROM t)
        SELECT path, CASE WHEN NOT taken AND r = 1 THEN d END AS destination, CASE WHEN taken OR r > 1 THEN 'name exists' END AS error FROM o""",
    "incremental_refresh": f"""WITH {CAT} SELECT CASE WHEN src = 'src2' THEN 'moved/' ELSE '' END || path AS path,
          CASE WHEN src = 'src2' AND size < 200 THEN 'moved/' || path ELSE 'first/' || path END AS origin, CASE WHEN size < 200 THEN '' ELSE hash END AS hash,
          CASE WHEN size < 200 THEN size + 1 ELSE size END AS size FROM cat""",
    "carried_groups": f"""WITH {CAT}, g AS (SELECT path, src || '/' || lng AS f, size < 200 AS changed FROM cat), st AS (SELECT f, bool_or(changed) AS stale FROM g GROUP BY f)
        SELECT path, CASE WHEN NOT changed THEN f END AS folder, CASE WHEN changed THEN false ELSE stale END AS stale FROM g JOIN st USING (f)""",
}
