"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm._common import table
from corvane.llm.decontaminate import find_contamination
from corvane.llm.exact_dedup import exact_groups
from corvane.llm.lang_id import identify
from corvane.llm.license_scan import BASE_PHRASES, TEMPLATES, scan_licenses
from corvane.llm.mixing import mix_documents
from corvane.llm.secret_scan import scan_secrets
from corvane.llm.sharding import assign_shards
from corvane.llm.simhash import near_duplicates
from corvane.llm.toxicity import grade_toxicity
from corvane.llm.warc import archive_pages


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return assign_shards(table(spark, sf_dir, "documents"), shards=8, carry=False)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return exact_groups(table(spark, sf_dir, "documents")).drop("row")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of all documents."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the words a 5:2:1 mix of sources takes of each."""
    return mix_documents(table(spark, sf_dir, "documents"), carry=False).drop("copies")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, by trees fitted on a sample of those not held out."""
    return identify(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of all documents, the model fitted on a sample of the labelled ones."""
    return grade_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back through the capture index."""
    return archive_pages(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, the models trained on them."""
    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in spans shared with the benchmark."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_exact_dedup, op3_licenses, op4_mixing, op5_simhash, op6_language_id, op7_toxicity, op8_warc, op9_secrets, op10_decontamination)}

OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS coin
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
ranked AS (SELECT source, s, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1 AS i FROM totals),
weighed AS (SELECT source, s, i, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM ranked),
levels AS (
  SELECT source, s, i, w, s / w AS r,
         CAST(sum(s) OVER () - coalesce(sum(3 * s) OVER before, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS lv
  FROM weighed WINDOW before AS (ORDER BY s / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT lv FROM levels WHERE lv * w <= 3 * s ORDER BY r, i LIMIT 1),
targets AS (SELECT source, s, least(CAST(3 * s AS DOUBLE), coalesce((SELECT lv FROM level) * w, CAST(3 * s AS DOUBLE))) AS target FROM levels),
rated AS (
  SELECT doc_id, size, s, target, coin, CASE WHEN s > 0 THEN target / s ELSE CAST(0 AS DOUBLE) END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, s AS source_size, target,
       CAST(size * (CAST(floor(rate) AS BIGINT) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""

OP2_SQL = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(t) AS text_sha256
FROM bare WINDOW best AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST)
"""

OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
f AS (SELECT *, n >= 100 AND page_id IS NOT NULL AND row_number() OVER (PARTITION BY t ORDER BY page_id NULLS LAST) > 1 AS again, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(t) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM f
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _grams(k: str) -> str:
    """All runs of k words of the list w and their places from 0, a row each."""
    return f"unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) AS gram, unnest(range(0, len(w) - {k} + 1)) AS pos"


OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
spans AS (SELECT DISTINCT item, k, gram FROM (SELECT item, k, {_grams("k")} FROM (SELECT *, least(len(w), 10) AS k FROM b WHERE len(w) > 0))),
places AS (SELECT doc_id, k, {_grams("k")} FROM d, (SELECT DISTINCT k FROM spans) WHERE len(w) >= k),
hits AS (SELECT doc_id, pos, k, item FROM places JOIN spans USING (k, gram)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM (SELECT DISTINCT doc_id, pos, k FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_PHRASES = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, pos FROM (SELECT doc_id, {_grams(str(len(phrase)))} FROM d WHERE len(w) >= {len(phrase)}) WHERE gram = '{' '.join(phrase)}'" for label, phrase in BASE_PHRASES)
_TEMPLATES = ", ".join(f"({t}, '{label}', string_split('{text}', ' '), '{key}')" for t, (label, text, key) in enumerate(TEMPLATES))

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT *, key = '' OR contains(' ' || gram || ' ', ' ' || key || ' ') AS told FROM (SELECT tid, label, key, len(w) - 2 AS n_of, {_grams("3")} FROM (VALUES {_TEMPLATES}) v(tid, label, w, key))),
g AS (SELECT doc_id, {_grams("3")} FROM d WHERE len(w) >= 3),
votes AS (SELECT doc_id, tid, label, n_of, g.pos - t.pos AS diag, count(*) AS v, min(g.pos) AS lo, max(g.pos) AS hi, bool_or(told) AS told FROM g JOIN t USING (gram) GROUP BY 1, 2, 3, 4, 5),
opened AS (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY doc_id, tid ORDER BY diag) <= 2 THEN 0 ELSE 1 END AS opens FROM votes),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, tid ORDER BY diag) AS island FROM opened),
spans AS (SELECT doc_id, tid, label, n_of, sum(v) AS v, least(CAST(1 AS DOUBLE), sum(v) / n_of) AS share, min(lo) AS lo, max(hi) + 3 AS hi, bool_or(told) AS told FROM islands GROUP BY doc_id, tid, label, n_of, island),
notices AS (SELECT *, max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi, tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM spans WHERE share >= 0.6 AND hi - lo <= 2 * (n_of + 2) AND told),
rivals AS (SELECT *, sum(CASE WHEN lo < reached THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY lo, hi, tid ROWS UNBOUNDED PRECEDING) AS rival FROM notices),
found AS (SELECT doc_id, label, share FROM rivals QUALIFY row_number() OVER (PARTITION BY doc_id, rival ORDER BY v DESC, share DESC, lo, label, hi) = 1),
base AS ({_PHRASES}),
b AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM base GROUP BY 1),
l AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM found) GROUP BY 1),
s AS (SELECT doc_id, max(share) AS share FROM found GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.lo AS BIGINT) AS first_word, CAST(b.hi AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, CAST(CASE WHEN b.n > 0 THEN 1 ELSE coalesce(s.share, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op3_licenses": OP3_SQL, "op4_mixing": OP4_SQL, "op8_warc": OP8_SQL, "op10_decontamination": OP10_SQL}
