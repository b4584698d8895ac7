"""SQL spellings of the text functions, for the second engine that checks results."""

from __future__ import annotations

from ..schema import PREVIEW_BYTES, SNIPPET_BYTES, WINDOW_CHARS, WINDOW_STEP


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ASCII spellings, written out here so that the second engine's answer doesn't rest on the tables it checks.
_LATIN = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "ð": "d", "Ð": "D", "Đ": "D", "ⁿ": "n", "þ": "th", "ı": "i", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ª": "a", "º": "o"}
_SIGNS = {
    "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "«": "<<", "»": ">>", "‹": "<", "›": ">", "–": "-", "—": "--", "‐": "-", "‑": "-", "−": "-", "…": "...", "•": "*", "·": "*", "×": "x", "÷": "/", "¡": "!", "¿": "?",
    "°": "d", "€": "EUR", "™": "tm", "©": "(c)", "®": "(r)", "½": "1/2", "¼": "1/4", "¾": "3/4", "²": "2", "³": "3", "¹": "1", "\u00ad": "", "\u200b": "", "\u200c": "", "\u200d": "", "\u2060": "", "\ufeff": "", "\u200e": "",
    "¨": " ", "¯": " ", "´": " ", "¸": " ", "˜": " ", "ˆ": "u2c6", "µ": "m", "ƒ": "u192", "\u00a0": " ", "\u2009": " ", "\u202f": " ", "\u2003": " ", "\u2002": " ", "\u3000": " ",
    "˘": " ", "˙": " ", "˚": " ", "˝": " ", "˛": " ", **{chr(c): " " for c in (*range(0x80, 0xA0), *range(0x2000, 0x200B))},
}
_CYRILLIC = dict(zip("абвгдежзиклмнопрстуфхцчшщъыьэюяѕіјљњђћџєґ", ("a", "b", "v", "g", "d", "e", "zh", "z", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "ch", "sh", "shch", "'", "y", "'", "e", "iu", "ia", "dz", "i", "j", "lj", "nj", "dj", "k", "dz", "e", "g")))
_GREEK = dict(zip("αβγδεζηθικλμνξοπρστυφχψω", ("a", "b", "g", "d", "e", "z", "e", "th", "i", "k", "l", "m", "n", "x", "o", "p", "r", "s", "t", "y", "f", "kh", "ps", "o")))


def normalize(x: str) -> str:
    """Spelled by the fixed values, full-width forms by their distance, accents by the engine; numbers for the rest."""
    scripts = _CYRILLIC | _GREEK
    spelled = _LATIN | _SIGNS | scripts | {c.upper(): to.capitalize() for c, to in scripts.items()} | {chr(c + 0xFEE0): chr(c) for c in range(33, 127)}
    one = {c: to for c, to in spelled.items() if len(to) < 2}
    first = sorted(one, key=lambda c: not one[c])  # those that go away stand last
    x = f"translate({x}, {literal(''.join(first))}, {literal(''.join(one.values()))})"
    for c, to in spelled.items():
        if len(to) > 1 and not to.startswith("u2") and not to.startswith("u1"):
            x = f"replace({x}, {literal(c)}, {literal(to)})"
    x = f"translate(strip_accents({x}), {literal(''.join(c for c in first if one[c]))}, {literal(''.join(one[c] for c in first if one[c]))})"
    each = "list_transform(string_split({0}, ''), lambda c: CASE WHEN ord(c) < 128 THEN c ELSE 'u' || lower(hex(ord(c))) END)"
    x = f"(CASE WHEN regexp_matches({x}, '[^\\x00-\\x7f]') THEN array_to_string({each.format(x)}, '') ELSE {x} END)"
    return rf"trim(regexp_replace(lower({x}), '[\x00-\x20]+', ' ', 'g'), ' ')"


def display(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\p{{Z}}\p{{Cc}}]+', ' ', 'g'), ' ')"


def is_blank(x: str) -> str:
    return rf"regexp_full_match({x}, '[\p{{Z}}\t-\r\x{{85}}]*')"


def preview(x: str) -> str:
    return f"left({display(x)}, list_max(list_filter(range(0, {PREVIEW_BYTES + 1}), lambda n: strlen(left({display(x)}, n)) <= {PREVIEW_BYTES}))::BIGINT)"


def filename(path: str) -> str:
    return f"CASE WHEN regexp_extract({path}, '[^/]*$') = '' THEN {path} ELSE regexp_extract({path}, '[^/]*$') END"


def snap(data: str, at: str) -> str:
    """Byte offset moved left to the start of a character."""
    inner = lambda i: f"hex({data}[({i}) + 1:({i}) + 1]) BETWEEN '80' AND 'BF'"
    return f"CASE WHEN {at} >= octet_length({data}) THEN octet_length({data}) WHEN {at} <= 0 OR NOT ({inner(at)}) THEN {at} WHEN NOT ({inner(at + ' - 1')}) THEN {at} - 1 WHEN NOT ({inner(at + ' - 2')}) THEN {at} - 2 ELSE {at} - 3 END"


PAGES = """
pages AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INTEGER AS page_no, page_text FROM (
    SELECT doc_id, unnest(p) AS page_text, unnest(range(len(p))) AS i FROM (
      SELECT doc_id, CASE WHEN text = '' THEN [] WHEN a[-1] = '' THEN a[:-2] ELSE a END AS p
      FROM (SELECT doc_id, text, string_split(text, chr(12)) AS a FROM documents WHERE text IS NOT NULL))))
"""

WINDOWS = f"""
{PAGES},
windows AS (
  SELECT doc_id, page_no, k::INTEGER AS chunk_ord, strlen(left(page_text, k * {WINDOW_STEP}))::INTEGER AS char_start, substr(page_text, k * {WINDOW_STEP} + 1, {WINDOW_CHARS}) AS text_utf8
  FROM (SELECT *, unnest(generate_series(0, greatest(0, ceil((length(page_text) - {WINDOW_CHARS}) / {WINDOW_STEP}.0))::BIGINT)) AS k FROM pages WHERE NOT {is_blank("page_text")})
)
"""

ITEMS = f"""
items AS (
  SELECT DISTINCT c.chunk_id, c.doc_id, d.path, {filename("d.path")} AS filename, c.page_no, c.chunk_ord, c.text_utf8, c.text_norm_ascii, c.preview, d.mtime_ns AS doc_mtime_ns
  FROM chunks c JOIN documents d ON c.doc_id = d.doc_id WHERE c.active AND d.status = 'ok')
"""


def snippets(source: str, centre: str, length: str) -> str:
    """CTEs that add ``snippet`` to a relation with text_utf8, as relation ``shown``."""
    d = "encode(text_utf8)"
    return f"""
    s1 AS (SELECT *, least(({centre})::BIGINT, strlen(text_utf8)) AS c0 FROM {source}),
    s2 AS (SELECT *, {snap(d, "c0")} AS c1 FROM s1),
    s3 AS (SELECT *, greatest(c1 - {SNIPPET_BYTES}, 0) AS l0, least(least(c1 + {length}, strlen(text_utf8)) + {SNIPPET_BYTES}, strlen(text_utf8)) AS r0 FROM s2),
    s4 AS (SELECT *, {snap(d, "l0")} AS l1, {snap(d, "r0")} AS r1 FROM s3),
    shown AS (SELECT *, CASE WHEN r1 > l1 THEN {display(f"decode({d}[l1 + 1:r1])")} ELSE '' END AS snippet FROM s4)
    """


def at_norm(offset: str) -> str:
    """Byte of the text for a byte of the searchable form."""
    return f"CASE WHEN strlen(text_norm_ascii) = 0 THEN 0 ELSE round(strlen(text_utf8) * (({offset}) / strlen(text_norm_ascii)::DOUBLE)) END"
