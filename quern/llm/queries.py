"""The queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import graph_words, leakage, mojibake, neighbours, splitting, terms, tokenizer
from quern.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = terms.term_statistics(table(spark, sf_dir, "memory_records"))
    return stats.filter(F.col("mark").isNotNull()).select("field", "term", "mark")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_statistics(table(spark, sf_dir, "memory_records"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = graph_words.text_distinctiveness(table(spark, sf_dir, "memory_records"), min_tf=3, max_df=5)
    return scored.select(F.col("rec_id").alias("chunk_id"), "term")


def p3_text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = graph_words.text_distinctiveness(table(spark, sf_dir, "memory_records"))
    return scored.select(F.col("rec_id").alias("chunk_id"), "term", "tf", "degree", "df", F.round("score", 6).alias("score"))


def p3_vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = graph_words.vector_distinctiveness(table(spark, sf_dir, "memory_records"))
    return scored.select(F.col("rec_id").alias("chunk_id"), "term", "df", F.round("score", 6).alias("score"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.nearest_records(table(spark, sf_dir, "memory_records"), min_score=0.9)
    pair = near.select(F.least("rec_id", "other_id").alias("chunk_id_a"), F.greatest("rec_id", "other_id").alias("chunk_id_b"))
    return pair.distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.nearest_records(table(spark, sf_dir, "memory_records"))
    return near.select(F.col("rec_id").alias("chunk_id"), "rank", F.col("other_id").alias("neighbour_id"), F.round("score", 6).alias("score"))


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, chunks = table(spark, sf_dir, "pages"), table(spark, sf_dir, "chunks")
    items = pages.select(F.lit("page").alias("item"), "source", F.col("page_no").cast("bigint").alias("item_no"), "text").unionByName(
        chunks.select(F.lit("chunk").alias("item"), "source", F.col("chunk_id").alias("item_no"), "text")
    )
    return splitting.split_oversized(items, ["item", "source", "item_no"])


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oversized(spark, sf_dir).drop("item_hash").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case is hard if a stretch longer than a piece has no break; splitting may still find other boundaries in it, such as U+2029."""
    pieces = _oversized(spark, sf_dir)
    hard = F.max(F.col("unbroken") > 800)
    return pieces.groupBy("item", "source", "item_no").agg(F.when(hard, "hard").otherwise("soft").alias("cut"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_passages(spark, sf_dir).select("doc_id", "item_id")


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a passage of an item, whatever its share of the item."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose passages, in any order, cover at least half of an item."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_coverage=0.5)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_tokens(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restore_texts(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p3_found, p3_text_scores, p3_vector_scores, p4_found, p4_neighbours, p5_found, p5_pieces, p6_ids, p7_found, p7_passages, p7_leaks, p8_found, p8_restored)}

#: Blocks whose characters have compatibility forms that strip_accents leaves, for the words of p7 (fixed values).
_COMPATIBLE = ((0xA0, 0x300), (0x2030, 0x2060), (0x2070, 0x20A0), (0x2100, 0x2190), (0x2460, 0x2500), (0x3000, 0x3001), (0xFB00, 0xFB07), (0xFF00, 0xFFF0), (0x1D400, 0x1D800))


def _words(column: str) -> str:
    """SQL of the words of a text as p7 defines them: compatibility forms by hand, accents by strip_accents, each ideograph a word."""
    forms = {chr(c): unicodedata.normalize("NFKD", chr(c)) for low, high in _COMPATIBLE for c in range(low, high)}
    forms = {c: f for c, f in forms.items() if f != unicodedata.normalize("NFD", c)}
    one = {c: f for c, f in forms.items() if len(f) == 1 and f != "'"}
    sql = f"translate({column}, '{''.join(one)}', '{''.join(one.values())}')"
    for c, f in forms.items():
        if len(f) > 1:
            sql = f"replace({sql}, '{c}', '{f}')"
    plain = f"lower(regexp_replace(strip_accents({sql}), '[\\p{{Mn}}\\p{{Cf}}]', '', 'g'))"
    return f"regexp_extract_all(regexp_replace({plain}, '([㐀-鿿])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')"


_RECORDS = "(SELECT DISTINCT ON (chunk_id) chunk_id, text, map_entries(vector) AS entries FROM memory_records WHERE chunk_id IS NOT NULL)"
_TERMS = """
WITH r AS {records},
 t AS (SELECT chunk_id, 'text' AS field, lower(w) AS term FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+|[一-鿿]')) AS w FROM r)
  UNION ALL SELECT chunk_id, 'vector' AS field, unnest(list_transform(entries, lambda e: e.key)) AS term FROM r),
 n AS (SELECT 'text' AS field, count(text) AS n FROM r UNION ALL SELECT 'vector', count(entries) FROM r),
 s AS (SELECT field, term, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT chunk_id) AS BIGINT) AS n_docs FROM t GROUP BY field, term),
 m AS (SELECT field, term, occurrences, n_docs, CASE WHEN n_docs <= 2 THEN 'rare' WHEN n_docs > 0.25 * n THEN 'common' END AS mark FROM s JOIN n USING (field))
""".format(records=_RECORDS)
_GRAPH = f"""
WITH r AS {_RECORDS},
 l AS (SELECT chunk_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+|[一-鿿]'), lambda w: lower(w)) AS ws FROM r WHERE text IS NOT NULL),
 t AS (SELECT chunk_id, unnest(ws) AS term, unnest(range(len(ws))) AS i FROM l),
 n AS (SELECT count(*) AS n FROM l),
 f AS (SELECT chunk_id, term, count(*) AS tf FROM t GROUP BY ALL),
 e AS (SELECT chunk_id, a.term AS term, count(DISTINCT b.term) AS degree FROM t a JOIN (SELECT chunk_id, term, i, unnest(range(i - 3, i + 4)) AS near FROM t) b USING (chunk_id)
   WHERE b.near = a.i AND a.term <> b.term GROUP BY ALL),
 d AS (SELECT term, count(*) AS df FROM f GROUP BY term)
"""
SQL = {
    "p1_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p1_terms": _TERMS + "SELECT field, term, occurrences, n_docs, mark FROM m",
    "p3_found": _GRAPH + "SELECT chunk_id, term FROM f JOIN d USING (term) WHERE tf >= 3 AND df <= 5",
    "p3_text_scores": _GRAPH
    + """SELECT f.chunk_id, f.term, CAST(tf AS BIGINT) AS tf, CAST(coalesce(degree, 0) AS BIGINT) AS degree, CAST(df AS BIGINT) AS df,
  round(coalesce(degree, 0) * ln((n + 1) / df), 6) AS score FROM f JOIN d USING (term) CROSS JOIN n LEFT JOIN e ON e.chunk_id = f.chunk_id AND e.term = f.term""",
    "p3_vector_scores": f"""WITH r AS {_RECORDS}, t AS (SELECT chunk_id, unnest(entries) AS e FROM r), d AS (SELECT e.key AS term, count(*) AS df FROM t GROUP BY ALL),
 n AS (SELECT count(entries) AS n FROM r)
SELECT chunk_id, term, CAST(df AS BIGINT) AS df, round(e.value * ln((n + 1) / df), 6) AS score FROM t JOIN d ON d.term = t.e.key CROSS JOIN n WHERE e.value IS NOT NULL""",
    "p4_found": f"""WITH r AS {_RECORDS}, e AS (SELECT chunk_id, unnest(entries) AS e FROM r), w AS (SELECT chunk_id, e.key AS term, e.value AS x FROM e WHERE isfinite(e.value) AND e.value <> 0),
 n AS (SELECT chunk_id, sqrt(sum(x * x)) AS size FROM w GROUP BY chunk_id), u AS (SELECT chunk_id, term, x / size AS x FROM w JOIN n USING (chunk_id)),
 p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, sum(a.x * b.x) AS score FROM u a JOIN u b USING (term) WHERE a.chunk_id <> b.chunk_id GROUP BY ALL),
 k AS (SELECT a, b, score, rank() OVER (PARTITION BY a ORDER BY round(score, 6) DESC, b) AS rk FROM p)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM k WHERE rk <= 10 AND score >= 0.9""",
    "p7_found": f"""WITH d AS (SELECT DISTINCT doc_id, {_words("text")} AS ws FROM documents WHERE text IS NOT NULL), b AS (SELECT DISTINCT item_id, {_words("text")} AS ws FROM benchmark WHERE text IS NOT NULL),
 n AS (SELECT item_id, ws, least(12, len(ws)) AS n FROM b WHERE len(ws) > 0),
 i AS (SELECT DISTINCT item_id, n, array_to_string(ws[at_word:at_word + n - 1], ' ') AS seed FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS at_word FROM n)),
 x AS (SELECT DISTINCT doc_id, n, array_to_string(ws[at_word:at_word + n - 1], ' ') AS seed FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS at_word FROM d CROSS JOIN (SELECT DISTINCT n FROM i) WHERE len(ws) >= n))
SELECT DISTINCT doc_id, item_id FROM x JOIN i USING (n, seed)""",
    "p5_found": """
WITH i AS (SELECT 'page' AS item, source, CAST(page_no AS BIGINT) AS item_no, text FROM pages UNION ALL SELECT 'chunk', source, chunk_id, text FROM chunks),
 h AS (SELECT item, source, item_no, regexp_matches(text, '[^ \\t\\n\\r\\x{00A0}\\x{2028}\\x{3000}.,;:!?。，、；：！？]{801}') AS hard FROM i WHERE length(text) > 800)
SELECT item, source, item_no, CASE WHEN bool_or(hard) THEN 'hard' ELSE 'soft' END AS cut FROM h GROUP BY ALL""",
}
