"""Search queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.highlight import segments_column
from ..functions.hits import rank_text
from ..functions.text import normalize_query
from ..operators import bigram_index as bi
from ..schema import FUZZY_PROBES
from ..session import table
from . import grams, search
from . import sqltext as sx
from .corpus import active_items

#: Queries that the registered plans run.
PHRASE, PATTERN, NAME, LIMIT = "the ledger", r"table \d+\.", "scan", 200
TYPO = "lattise explains"


def snapshot(spark: SparkSession, sf_dir: str, index: bool = False) -> search.Snapshot:
    base = search.items(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "documents"))
    built = bi.BigramIndex.build(base.select("chunk_id", "text_norm_ascii").dropDuplicates(["chunk_id"])) if index else None
    return search.Snapshot(base, index=built, repeated=True)


def _distinct_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_items(spark, sf_dir).select("chunk_id", "text_norm_ascii")


def literal_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk that holds the phrase, with its byte."""
    return search.literal_matches(snapshot(spark, sf_dir), normalize_query(PHRASE)).select("chunk_id", "doc_id", "page_no", "chunk_ord", F.col("_at").alias("match_offset"))


def literal_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.literal(snapshot(spark, sf_dir), PHRASE, LIMIT, rank=True)


def regex_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.regex_matches(snapshot(spark, sf_dir), PATTERN).select("chunk_id", "doc_id", F.col("_at").alias("match_offset"), F.col("_length").alias("match_length"))


def regex_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.regex(snapshot(spark, sf_dir), PATTERN, LIMIT, rank=True)


def bigram_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.frequencies(_distinct_norms(spark, sf_dir))


def bigram_tracked_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _distinct_norms(spark, sf_dir)
    return bi.tracked(bi.frequencies(rows), bi.sizes(rows))


def literal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that pass the bigram test of the phrase."""
    s = snapshot(spark, sf_dir, index=True)
    test = bi.literal_candidates(s.index, normalize_query(PHRASE), F.col("text_norm_ascii"))
    rows = s.live() if test is None else s.live().where(test)
    return s.once(rows).select("chunk_id", "doc_id")


def regex_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that pass the bigram test of the pattern."""
    s = snapshot(spark, sf_dir, index=True)
    test = bi.evaluate(s.index, grams.regex_query(PATTERN), F.col("text_norm_ascii"))
    rows = s.live() if test is None else s.live().where(test)
    return s.once(rows).select("chunk_id", "doc_id")


def fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that hold enough probes of a query with a typo."""
    s = snapshot(spark, sf_dir, index=True)
    test = bi.fuzzy_candidates(s.index, grams.fuzzy_probes(normalize_query(TYPO), FUZZY_PROBES), F.col("text_norm_ascii"))
    rows = s.live() if test is None else s.live().where(test)
    return s.once(rows).select("chunk_id", "doc_id")


def fuzzy_filename_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.filename_band(snapshot(spark, sf_dir), normalize_query(NAME), LIMIT)
    return rows.select("doc_id", "chunk_id", "filename", F.col("_rank").alias("rank"))


def fuzzy_body_cheap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshot(spark, sf_dir)
    needle = normalize_query(PHRASE)
    return search.body_cheap(search.body_candidates(s, needle), needle, LIMIT).select("chunk_id", "doc_id", F.col("_rank").alias("rank"))


def fuzzy_body_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshot(spark, sf_dir, index=True)
    needle = normalize_query(TYPO)
    return search.body_scored(search.body_candidates(s, needle), needle, LIMIT).select("chunk_id", "doc_id", F.col("_score").alias("score"), F.col("_rank").alias("rank"))


def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuzzy(snapshot(spark, sf_dir, index=True), PHRASE, LIMIT)


def rank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = active_items(spark, sf_dir)
    return rows.select("chunk_id", rank_text(rows).alias("rank_text"))


def highlight_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the ranked hits' snippets."""
    hits = search.literal(snapshot(spark, sf_dir), PHRASE, LIMIT)
    return hits.select("chunk_id", F.posexplode(segments_column(F.col("snippet"), PHRASE)).alias("position", "s")).select("chunk_id", "position", "s.text", "s.kind")


_Q, _N = sx.literal(PHRASE), len(PHRASE)
_FIRST = f"{sx.ITEMS}, found AS (SELECT *, strpos(text_norm_ascii, {_Q}) - 1 AS pos FROM items WHERE contains(text_norm_ascii, {_Q})), top AS (SELECT * FROM found ORDER BY doc_id, chunk_ord, chunk_id LIMIT {LIMIT})"
_HIT = "chunk_id, doc_id, path, filename, page_no, chunk_ord, 1.0::FLOAT AS score, snippet"
_RX = sx.literal("(?i)" + PATTERN)
_REGEX = f"{sx.ITEMS}, found AS (SELECT *, regexp_extract(text_utf8, {_RX}) AS m FROM items WHERE regexp_matches(text_utf8, {_RX})), placed AS (SELECT *, strlen(left(text_utf8, strpos(text_utf8, m) - 1)) AS pos, strlen(m) AS len FROM found)"
_GRAMS = """
grams AS (
  SELECT DISTINCT chunk_id, skip, (ord(a) * 256 + ord(b))::INTEGER AS key FROM (
    SELECT chunk_id, skip, lower(substr(text_norm_ascii, i, 1)) AS a, lower(substr(text_norm_ascii, i + 1 + skip::INTEGER, 1)) AS b
    FROM (SELECT chunk_id, text_norm_ascii, unnest(range(1, greatest(length(text_norm_ascii), 1))) AS i FROM items), (VALUES (false), (true)) v(skip)
  ) WHERE b <> '' AND ord(a) BETWEEN 32 AND 126 AND ord(b) BETWEEN 32 AND 126),
freq AS (SELECT skip, key, count(*) AS df FROM grams GROUP BY ALL),
size AS (SELECT count(*) AS items, count_if(strlen(text_norm_ascii) >= 2) AS populated FROM items),
tracked AS (SELECT skip, key, df FROM freq, size WHERE NOT 10 * df >= 9 * populated AND CASE WHEN skip THEN 100 * df >= 12 * populated ELSE 4 * df >= 8 * ceil(items / 64.0) END)
"""


def _pairs_sql(pairs: list[grams.Pair]) -> str:
    return ", ".join(f"({str(p.skip).lower()}, {p.a * 256 + p.b})" for p in pairs)


def _literal_sql() -> str:
    pairs = _pairs_sql(grams.pairs_of(PHRASE))
    return f"WITH {sx.ITEMS}, {_GRAMS}, wanted AS (SELECT t.skip, t.key FROM tracked t JOIN (VALUES {pairs}) w(skip, key) ON t.skip = w.skip AND t.key = w.key) SELECT chunk_id, doc_id FROM items i WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM grams g WHERE g.chunk_id = i.chunk_id AND g.skip = w.skip AND g.key = w.key))"


def _regex_sql() -> str:
    def test(q: grams.Query) -> str:
        """An untracked pair says nothing, which in a condition without negation is the same as true."""
        if isinstance(q, grams.Pair):
            key = f"skip = {str(q.skip).lower()} AND key = {q.a * 256 + q.b}"
            return f"(NOT EXISTS (SELECT 1 FROM tracked WHERE {key}) OR i.chunk_id IN (SELECT chunk_id FROM grams WHERE {key}))"
        return "(" + (" AND " if isinstance(q, grams.And) else " OR ").join(sorted(test(x) for x in q.of)) + ")" if not isinstance(q, grams.Any) else "true"

    return f"WITH {sx.ITEMS}, {_GRAMS} SELECT chunk_id, doc_id FROM items i WHERE {test(grams.regex_query(PATTERN))}"


def _fuzzy_sql() -> str:
    probes = grams.fuzzy_probes(TYPO, FUZZY_PROBES)
    rows = ", ".join(f"({n}, {p.a * 256 + p.b})" for n, p in enumerate(probes.keys))
    return f"WITH {sx.ITEMS}, {_GRAMS}, probe AS (SELECT n, p.key, t.key IS NOT NULL AS known FROM (VALUES {rows}) p(n, key) LEFT JOIN tracked t ON NOT t.skip AND t.key = p.key), hit AS (SELECT g.chunk_id, count(*) AS n FROM grams g JOIN probe p ON NOT g.skip AND g.key = p.key AND p.known GROUP BY g.chunk_id) SELECT i.chunk_id, i.doc_id FROM items i LEFT JOIN hit h ON h.chunk_id = i.chunk_id WHERE coalesce(h.n, 0) + (SELECT count(*) FROM probe WHERE NOT known) >= {probes.need}"


_TERMS = PHRASE.split()


def _rank(query: str) -> str:
    """The place of a shown hit: phrase, terms, earliest byte of the phrase or else of a term, page, document, chunk."""
    low, terms = "lower(snippet)", [sx.literal(t) for t in query.split()]
    byte = lambda t: f"(CASE WHEN contains({low}, {t}) THEN strlen(left({low}, strpos({low}, {t}) - 1)) ELSE 2147483647 END)"
    whole = f"contains({low}, {sx.literal(query)})"
    place = f"CASE WHEN {whole} THEN {byte(sx.literal(query))} ELSE least({', '.join(map(byte, terms))}) END"
    return f"row_number() OVER (ORDER BY {whole} DESC, {' + '.join(f'contains({low}, {t})::INTEGER' for t in terms)} DESC, {place}, page_no, doc_id, chunk_id)::INTEGER AS rank"


SQL = {
    "literal_search_hits": f"WITH {_FIRST} SELECT chunk_id, doc_id, page_no, chunk_ord, pos::INTEGER AS match_offset FROM found",
    "literal_search_ranked": f"WITH {_FIRST}, {sx.snippets('top', sx.at_norm('pos'), str(_N))} SELECT {_HIT}, {_rank(PHRASE)} FROM shown",
    "regex_search_hits": f"WITH {_REGEX} SELECT chunk_id, doc_id, pos::INTEGER AS match_offset, len::INTEGER AS match_length FROM placed",
    "regex_search_ranked": f"WITH {_REGEX}, top AS (SELECT * FROM placed ORDER BY doc_id, chunk_ord, chunk_id LIMIT {LIMIT}), {sx.snippets('top', 'pos', 'len')} SELECT {_HIT}, {_rank(PATTERN)} FROM shown",
    "bigram_document_frequency": f"WITH {sx.ITEMS}, {_GRAMS} SELECT skip, key, df FROM freq",
    "bigram_tracked_columns": f"WITH {sx.ITEMS}, {_GRAMS} SELECT skip, key, df FROM tracked",
    "literal_candidates": _literal_sql(),
    "regex_candidates": _regex_sql(),
    "fuzzy_candidates": _fuzzy_sql(),
    "fuzzy_filename_band": f"WITH {sx.ITEMS}, named AS (SELECT *, {sx.normalize('filename')} AS n FROM items), firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_ord, chunk_id) AS k FROM named WHERE contains(n, '{NAME}')), best AS (SELECT doc_id, chunk_id, filename, row_number() OVER (ORDER BY strpos(n, '{NAME}'), strlen(n), doc_id)::INTEGER AS rank FROM firsts WHERE k = 1) SELECT * FROM best WHERE rank <= {LIMIT}",
    "fuzzy_body_cheap": f"WITH {sx.ITEMS}, found AS (SELECT * FROM items WHERE contains(text_norm_ascii, {_Q}) AND NOT ({' AND '.join(f'contains({sx.normalize("filename")}, {sx.literal(t)})' for t in _TERMS)})), numbered AS (SELECT chunk_id, doc_id, row_number() OVER (ORDER BY doc_id, chunk_ord, chunk_id)::INTEGER AS rank FROM found) SELECT * FROM numbered WHERE rank <= {LIMIT}",
    "rank_texts": f"WITH {sx.ITEMS} SELECT chunk_id, filename || ' ' || path || ' page ' || page_no || ' ' || preview AS rank_text FROM items",
}
QUERIES = {
    f.__name__: f
    for f in (literal_search_hits, literal_search_ranked, regex_search_hits, regex_search_ranked, bigram_document_frequency, bigram_tracked_columns, literal_candidates, regex_candidates, fuzzy_candidates, fuzzy_filename_band, fuzzy_body_cheap, fuzzy_body_scored, fuzzy_search, rank_texts, highlight_segments)
}
