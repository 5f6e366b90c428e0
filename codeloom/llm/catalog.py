"""Queries of the training-data operators on the given tables, with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.catalog.registry import table
from codeloom.llm.ann import nearest_neighbours
from codeloom.llm.common import shared_path
from codeloom.llm.exact_dedup import exact_dedup
from codeloom.llm.jaccard_join import jaccard_classes
from codeloom.llm.lexical_search import lexical_search
from codeloom.llm.line_dedup import MIN_WORDS, dedup_lines
from codeloom.llm.mixing import mix_sources
from codeloom.llm.packing import pack_documents
from codeloom.llm.phrases import collocations
from codeloom.llm.token_counts import token_counts
from codeloom.llm.token_files import read_token_files, write_token_files
from codeloom.llm.toxicity import toxicity
from codeloom.llm.url_filter import SOFT, STRICT, Rule, judge_urls
from codeloom.llm.warc import page_of, read_warc, write_warc

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedup_lines(docs)


OP1_SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
n AS (SELECT *, trim(regexp_replace(line, '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS n FROM l),
w AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id) AS total, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS fin
  FROM (SELECT doc_id, pos, n, len(string_split(n, ' ')) AS words FROM n WHERE n <> '')),
s AS (SELECT *, fin - words AS begin FROM w),
win AS (
  SELECT doc_id, pos AS first, max(pos) OVER f AS last, string_agg(n, chr(10)) OVER f AS c FROM s
  WINDOW f AS (PARTITION BY doc_id ORDER BY begin RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
  QUALIFY total - begin >= {MIN_WORDS}
  UNION
  SELECT doc_id, min(pos) OVER b, pos, string_agg(n, chr(10)) OVER b FROM s
  WINDOW b AS (PARTITION BY doc_id ORDER BY fin RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)
  QUALIFY fin >= {MIN_WORDS}),
later AS (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY c ORDER BY doc_id, first) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM later),
kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL) AS text, count(*) AS n_lines, count(gone.pos) AS n_deleted
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted
FROM documents d LEFT JOIN kept USING (doc_id)
"""


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, folder, "labels")).drop("text")


def op3_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM t
"""


def op6_pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack_documents(table(spark, folder, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_classes(table(spark, folder, "documents")).drop("place")


def op8_judge_urls(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), URL_RULES)


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(table(spark, folder, "pages"), path)
    return read_warc(spark, path).select(
        page_of(F.col("record_id")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of(F.col("refers_to")).cast("long").alias("refers_to"),
    )


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write_token_files(table(spark, folder, "documents"), path)
    docs = read_token_files(spark, path)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
all_docs AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
m AS (SELECT doc_id, 25 + (75 * n * n_docs) // n_terms AS m FROM size, all_docs),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM f GROUP BY ALL), all_docs),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY ALL),
known AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING a >= 100),
kept AS (
  SELECT * FROM known c WHERE k > 1 AND NOT EXISTS (
    FROM known b WHERE b.lang = c.lang AND b.k > c.k AND 100 * b.a >= 100 * c.a
      AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(list_slice(string_split(phrase, ' '), 1, cut), ' ') AS head,
         array_to_string(list_slice(string_split(phrase, ' '), cut + 1, k), ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, h.a AS l, t.a AS r, n, ((1000::HUGEINT * c.a * n) // (h.a::HUGEINT * t.a))::BIGINT AS score
  FROM cuts c JOIN known h ON h.lang = c.lang AND h.phrase = c.head JOIN known t ON t.lang = c.lang AND t.phrase = c.tail
  JOIN totals ON totals.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored QUALIFY rank <= 2000
"""


def _url_sql() -> str:
    def hits(terms) -> str:
        return " + ".join(
            rf"regexp_matches(lower(url), '(^|[^\p{{L}}\p{{N}}]){t}($|[^\p{{L}}\p{{N}}])')::INT" for t in sorted(terms)
        )

    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    rules = sorted(URL_RULES, key=lambda r: -len(r.text))
    rule = " ".join(f"WHEN {fits.format(r.host, r.path)} THEN '{r.text}'" for r in rules)
    verdict = " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in rules)
    return rf"""
WITH parts AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (
  SELECT *, CASE {rule} END AS rule, coalesce({hits(STRICT)}, 0) AS strict_hits,
         coalesce({hits(set(SOFT) - set(STRICT))}, 0) AS soft_hits
  FROM parts)
SELECT page_id, host, path, rule, strict_hits, soft_hits,
       CASE rule {verdict} ELSE CASE WHEN strict_hits > 0 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END END AS verdict
FROM judged
"""


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_mix_sources": op4_mix_sources,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_pack_documents": op6_pack_documents,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_judge_urls": op8_judge_urls,
    "op9_warc": op9_warc,
    "op10_token_files": op10_token_files,
    "op11_token_counts": op11_token_counts,
    "op12_lexical_search": op12_lexical_search,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op8_judge_urls": _url_sql(),
    "op12_lexical_search": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
