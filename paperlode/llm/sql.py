"""SQL twins of queries, for a second engine over the same tables."""

from __future__ import annotations

import unicodedata

from .unify import LOOK_ALIKE, SAME_DASH


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _looks(column: str) -> str:
    """The consistent form where no composed letter of another script occurs (no SQL function decomposes)."""
    spaces = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Zs" and c != 32] + ["\t"]
    wide = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFFE7) if unicodedata.decomposition(chr(c)).startswith("<wide>")}
    one = LOOK_ALIKE | SAME_DASH | {x: " " for x in spaces} | {a: b for a, b in wide.items() if len(b) == 1}
    text = f"translate({column}, {_literal(''.join(one))}, {_literal(''.join(one.values()))})"
    for ligature, letters in {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "\r\n": "\n", "\r": "\n"}.items():
        text = f"replace({text}, {_literal(ligature)}, {_literal(letters)})"
    return f"nfc_normalize(regexp_replace({text}, '[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]', '', 'g'))"


P1_FOUND = f"""
WITH t AS (SELECT DISTINCT chunk_id, doc_id, text_utf8, {_looks("text_utf8")} AS look FROM chunks WHERE active AND text_utf8 IS NOT NULL)
SELECT DISTINCT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b
FROM t a JOIN t b ON a.look = b.look AND a.chunk_id < b.chunk_id AND a.doc_id <> b.doc_id AND a.text_utf8 <> b.text_utf8
"""

P1_UNIFIED = f"SELECT DISTINCT chunk_id, doc_id, {_looks('text_utf8')} AS text_unified FROM chunks WHERE active"

P1_CLASSES = f"""
WITH t AS (SELECT DISTINCT chunk_id, text_utf8, {_looks("text_utf8")} AS look FROM chunks WHERE active AND text_utf8 IS NOT NULL)
SELECT chunk_id, min(chunk_id) OVER (PARTITION BY look) AS class_id, n AS forms
FROM t JOIN (SELECT look, count(DISTINCT text_utf8) AS n FROM t GROUP BY look) USING (look)
"""


P1_COPIES = f"""
WITH t AS (SELECT DISTINCT chunk_id, text_utf8, {_looks("text_utf8")} AS look FROM chunks WHERE active AND text_utf8 IS NOT NULL),
mixed AS (SELECT look FROM t GROUP BY look HAVING count(DISTINCT text_utf8) > 1)
SELECT chunk_id, min(chunk_id) OVER (PARTITION BY text_utf8) AS form_id, count(*) OVER (PARTITION BY text_utf8) AS copies FROM t JOIN mixed USING (look)
"""

P2_COPIES = """
WITH t AS (SELECT DISTINCT chunk_id, doc_id, text_norm_ascii AS x FROM chunks WHERE active AND length(text_norm_ascii) >= 400)
SELECT chunk_id, class_id, n FROM (SELECT chunk_id, min(chunk_id) OVER w AS class_id, count(*) OVER w AS n, min(doc_id) OVER w AS lo, max(doc_id) OVER w AS hi FROM t WINDOW w AS (PARTITION BY x)) WHERE lo <> hi
"""

_SETS = """
w AS (SELECT doc_id, regexp_extract_all(text_norm_ascii, '[a-z0-9]+') AS a FROM (SELECT DISTINCT doc_id, text_norm_ascii FROM chunks WHERE active AND text_norm_ascii IS NOT NULL)),
g AS (SELECT DISTINCT doc_id, a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] AS g FROM (SELECT doc_id, a, unnest(range(1, len(a) - 1)) AS i FROM w)),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id HAVING count(*) >= 40),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
pair AS (SELECT a, b, c / (s.n + t.n - c)::DOUBLE AS similarity FROM common JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE c / (s.n + t.n - c)::DOUBLE >= 0.6)
"""

P3_FOUND = f"WITH {_SETS} SELECT a AS doc_id_a, b AS doc_id_b FROM pair"

P3_GROUPS = f"""
WITH RECURSIVE {_SETS},
class AS (SELECT doc_id, min(other) AS class_id FROM (SELECT doc_id, doc_id AS other FROM size UNION ALL SELECT a, b FROM pair WHERE similarity = 1 UNION ALL SELECT b, a FROM pair WHERE similarity = 1) GROUP BY doc_id),
link AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair) p JOIN class x ON x.doc_id = p.a JOIN class y ON y.doc_id = p.b WHERE x.class_id <> y.class_id),
reach AS (SELECT DISTINCT class_id AS a, class_id AS b FROM class UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT doc_id, class_id, (SELECT min(b) FROM reach WHERE a = class_id) AS group_id, (SELECT count(*) FROM link WHERE a = class_id) AS links FROM class
"""

P6_FOUND = "SELECT DISTINCT chunk_id FROM chunks WHERE active AND length(text_utf8) > 1200"

P6_REJOINED = "SELECT DISTINCT chunk_id, text_utf8 FROM chunks WHERE active AND length(text_utf8) > 1200"

P6_RANGES = "SELECT DISTINCT chunk_id, 0::INTEGER AS missing, length(text_utf8) AS chars, 0::BIGINT AS too_long, 0::BIGINT AS overlap_off FROM chunks WHERE active AND length(text_utf8) > 1200"

# the words of a document and of each stretch of half an item, a space on either side
P9_FOUND = r"""
WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{Nd}\p{Nl}\p{No}]+'), ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{Nd}\p{Nl}\p{No}]+') AS a FROM eval_items WHERE passage IS NOT NULL),
r AS (SELECT item_id, ' ' || array_to_string(a[k:k + ceil(len(a) / 2.0)::BIGINT - 1], ' ') || ' ' AS p FROM (SELECT item_id, a, unnest(range(1, len(a) - ceil(len(a) / 2.0)::BIGINT + 2)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM d JOIN r ON contains(d.t, r.p)
"""


def statements() -> dict[str, str]:
    return {name.lower(): text for name, text in globals().items() if name.isupper() and name[0] != "_" and isinstance(text, str)}
