"""DuckDB SQL for the registered queries of this subpackage, where SQL can express them."""

from __future__ import annotations

from siltstone.llm.licenses import ANCHORS, IMPLIES, RULES, SENTENCES, SPDX_COLON

OP6_NEARDUP = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
  FROM d
), n AS (SELECT doc_id, len(g) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 85 * (na.n_shingles + nb.n_shingles - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT n.doc_id, CAST(n.n_shingles AS BIGINT) AS n_shingles, min(reach.b) AS component_id, n.doc_id = min(reach.b) AS kept
FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""

_KNOWN = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in SENTENCES) + "]"


def _ids(lines: str) -> str:
    held = rf"list_filter(string_split_regex(regexp_replace({lines}, '{SPDX_COLON}', '\1 ', 'g'), '[.!?;:]+(?:\s+|$)|\n+'), lambda x: regexp_matches(x, '(?i){ANCHORS}'))"
    norm = rf"trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9.+-]+', ' ', 'g'), '[.+ -]+$', ''))"
    found = f"list_filter(list_transform({held}, lambda x: list_position({_KNOWN}, {norm}) - 1), lambda i: i >= 0)"
    return f"CASE WHEN len({found}) > 0 THEN '|' || array_to_string({found}, '|') || '|' ELSE '' END"


def _licenses() -> str:
    """Licence and its condition on ``l`` and ``p``, the identifiers with their bars doubled."""
    hit: dict[str, list[str]] = {}
    for name, rule in RULES:
        pattern = "%" + "%".join(f"|{i}|" for i in rule) + "%"
        hit.setdefault(name, []).append(f"(l LIKE '{pattern}' OR p LIKE '{pattern}')")
    cond = {name: "(" + " OR ".join(c) + ")" for name, c in hit.items()}
    for longer, shorter in IMPLIES.items():
        cond[shorter] = f"({cond[shorter]} AND NOT {cond[longer]})"
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {cond[n]} THEN '{n}' END" for n in sorted(cond)) + "], lambda x: x IS NOT NULL), ',')"


OP5_LICENSES = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '([^\n])\n([^\n])', '\1 \2', 'g') AS w FROM documents),
i AS (SELECT doc_id, {_ids("t")} AS by_line, {_ids("w")} AS by_paragraph FROM t),
d AS (SELECT *, replace(by_line, '|', '||') AS l, replace(by_paragraph, '|', '||') AS p FROM i)
SELECT doc_id, by_line, by_paragraph, {_licenses()} AS licenses FROM d
"""

ORACLES: dict[str, str] = {"op5_licenses": OP5_LICENSES, "op6_neardup": OP6_NEARDUP}
