"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import re

from .licenses import TEMPLATES, words_of

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of letters, digits and all beyond ASCII; runs of what is no white space.
PLAIN, SPACED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


def low(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{CAPITALS}', '{CAPITALS.lower()}')"


def words(text: str, pattern: str) -> str:
    return f"regexp_extract_all({low(text)}, '{pattern}')"


DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("text", PLAIN)} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS id, {words("text", PLAIN)} AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT DISTINCT id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM (SELECT id, w, least(8, len(w)) AS n, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM i),
x AS (SELECT r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, s, x.n, id FROM x JOIN i ON x.win = i.win AND x.n = i.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
own AS (SELECT r, count(DISTINCT id) AS n_items, array_to_string(list_sort(list_distinct(list(id))), ',') AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words("text", SPACED)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + least(4, len(w)) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_in AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT reach.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reach.b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.a GROUP BY 1
"""

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
win AS (SELECT r, s, count(*) OVER (PARTITION BY r, g) AS times
  FROM (SELECT r, s, array_to_string(list_slice(w, s, s + 2), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) > 2))),
again AS (SELECT r, count(DISTINCT p) AS c FROM (SELECT r, unnest([s, s + 1, s + 2]) AS p FROM win WHERE times > 1) GROUP BY r),
f AS (SELECT doc_id, x, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines, coalesce(c, 0) AS n_repeat_words FROM d LEFT JOIN again USING (r)),
g AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(length(x), 1) AS size FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 6 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR n_dup_lines * 3 > len(string_split(x, chr(10))) * 2
    OR length(regexp_replace(x, '[^\p{{L}}]+', '', 'g')) * 2 < size OR length(regexp_replace(x, '[^\p{{Lu}}]+', '', 'g')) * 10 > size * 4
    OR 10 * len(list_filter(string_split(x, ' '), lambda v: v = '|')) > 3 * n_words) AS kept
FROM g
"""


def template_regex(markup: str) -> str:
    """A template as a regex over words that each end with a blank."""
    out = []
    for piece in re.split(r"(<<[^>]*>>)", markup):
        if not piece.startswith("<<"):
            out += [w.decode() + " " for w in words_of(piece.encode())]
            continue
        kind, _, rest = piece[2:-2].partition(" ")
        if kind == "fill":
            out.append("(?:[^ ]+ ){" + rest.replace("-", ",") + "}")
        else:
            out.append({"optional": "(?:", "end": ")?"}.get(kind) or f"(?:{rest}) ")
    return " " + "".join(out)


def licenses() -> str:
    accepted = ", ".join(
        f"CASE WHEN {' OR '.join(f"regexp_matches(t, '{template_regex(m)}')" for m in own)} THEN '{label}' END" for label, own in TEMPLATES.items()
    )
    places = " UNION ALL ".join(
        f"SELECT r, s, '{label}' AS label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d) WHERE array_to_string(list_slice(w, s, s + {k - 1}), ' ') = '{phrase}'"
        for phrase, label, k in (("mit license", "mit", 2), ("apache license", "apache", 2), ("general public license", "gpl", 3))
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("text", PLAIN)} AS w FROM documents),
places AS ({places}),
base AS (SELECT r, count(*) AS n, min(s) - 1 AS first_word, max(s) - 1 AS last_word, list_distinct(list(label)) AS labels FROM places GROUP BY r),
own AS (SELECT r, list_filter([{accepted}], lambda v: v IS NOT NULL) AS labels FROM (SELECT r, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d))
SELECT doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_concat(coalesce(base.labels, []), own.labels)), ','), '') AS labels, CASE WHEN len(own.labels) > 0 THEN 1.0 WHEN base.n > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN own USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": DECONTAMINATE, "op7_jaccard": JACCARD, "op9_licenses": licenses(), "op10_quality_rules": QUALITY}
