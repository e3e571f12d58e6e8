"""The corpus queries, and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fold_of, table
from tessera.llm.decontamination import contaminated, contaminated_sql
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.fixity import audit, damaged, warc_record
from tessera.llm.jaccard_join import jaccard_join
from tessera.llm.lexical_search import ranked_search
from tessera.llm.mixing import mix
from tessera.llm.pipeline import run
from tessera.llm.quality import quality
from tessera.llm.secrets import scan, scan_sql, secret_digests
from tessera.llm.substring_dedup import without_repeats
from tessera.llm.suffix_dedup import without_repeated_strings
from tessera.llm.token_counts import token_counts, tokenizer_path
from tessera.llm.toxicity import toxicity
from tessera.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_of("doc_id", 5) == 0
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held_out, threshold=0.3)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(scan(table(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512)


def op6_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as a WARC archive, audited against a replica with the damage that ``damaged`` does."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", warc_record(F.col("url"), F.col("html")).alias("record"))
    return audit(pages, damaged(pages, ["page_id", "url"]), ["page_id", "url"], added=True).drop("copy")


OP6_SQL = r"""
WITH records AS (
  SELECT page_id, url,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:md5:'
         || md5(url || chr(10) || html) || '>' || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
         || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages)),
placed AS (
  SELECT page_id, url, CAST(strlen(record) AS BIGINT) AS length,
         row_number() OVER (ORDER BY page_id, url) - 1 AS pos,
         CAST(sum(strlen(record)) OVER (ORDER BY page_id, url ROWS UNBOUNDED PRECEDING) - strlen(record) AS BIGINT) AS "offset",
         CAST('0x' || substr(md5(CAST(page_id AS VARCHAR) || '|' || url), 1, 8) AS BIGINT) % 64 AS fate
  FROM records)
SELECT page_id, url, pos, "offset", length,
       CASE fate WHEN 0 THEN NULL WHEN 1 THEN length - 1 ELSE length END AS replica_length,
       CASE fate WHEN 0 THEN 'missing' WHEN 1 THEN 'resized' ELSE 'altered' END AS state
FROM placed WHERE fate < 3
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, what it loses and a digest of what it keeps."""
    kept = without_repeats(table(spark, sf_dir, "documents"))
    places = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["stop"])), ",")
    return kept.select("doc_id", "n_chars", F.size("removed").cast("bigint").alias("n_removed"), "removed_chars", places.alias("removed_spans"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_of("doc_id", 3) == 1
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held_out, threshold=0.7)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


#: Weights of the sources by code point, repeating, and most copies of a document.
MIX_WEIGHTS, MIX_REPEATS = [5, 2, 1], 3


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_REPEATS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(docs: str) -> str:
    """The mix as SQL over a relation with doc_id, source and text."""
    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source,
         CAST(length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM {docs}),
classed AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE 2 * length(bin(size))
         + CAST(CAST(size AS DOUBLE) * size >= pow(2.0::DOUBLE, 2 * length(bin(size)) - 1) AS INT) END AS class
  FROM sized),
weighed AS (
  SELECT source, sum(size) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS place
  FROM classed GROUP BY source),
caps AS (
  SELECT *, [5, 2, 1][CAST((place - 1) % 3 + 1 AS INT)] AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS words FROM weighed),
levels AS (
  SELECT *, cap * (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) <= weight * (words - coalesce(sum(cap) OVER before, 0)) AS is_full
  FROM caps
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         CASE WHEN is_full THEN CAST(cap AS DOUBLE)
              ELSE weight * (CAST(words - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0) AS DOUBLE)
                   / CAST(sum(CASE WHEN NOT is_full THEN weight END) OVER () AS DOUBLE)) END AS target
  FROM levels),
shares AS (
  SELECT *, coalesce(target / nullif(source_size, 0), 0) AS copies FROM targets),
strata AS (
  SELECT source, class, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS words, CAST(sum(size * size) AS BIGINT) AS squares,
         row_number() OVER (PARTITION BY source ORDER BY class DESC) AS k
  FROM classed WHERE class > 0 GROUP BY source, class),
draws AS (
  SELECT source, CAST(0 AS BIGINT) AS k, CAST(0 AS INT) AS class, CAST(0 AS BIGINT) AS n_draw, 0.0::DOUBLE AS carry FROM weighed
  UNION ALL
  SELECT source, k, class, n_draw, want - n_draw * mean FROM (
    SELECT s.source, s.k, CAST(s.class AS INT) AS class, w.want, CAST(s.squares AS DOUBLE) / s.words AS mean,
           CAST(greatest(0, least(s.n_docs, floor(w.want / (CAST(s.squares AS DOUBLE) / s.words) + 0.5))) AS BIGINT) AS n_draw
    FROM (SELECT d.source, d.k, (h.copies - floor(h.copies)) * t.words + d.carry AS want
          FROM draws d JOIN shares h ON d.source IS NOT DISTINCT FROM h.source
          JOIN strata t ON t.source IS NOT DISTINCT FROM d.source AND t.k = d.k + 1) w
    JOIN strata s ON s.source IS NOT DISTINCT FROM w.source AND s.k = w.k + 1)),
ranked AS (
  SELECT c.doc_id, c.source, c.size, c.class, h.source_size, h.target, floor(h.copies) AS whole, d.n_draw,
         least(1.0::DOUBLE, CAST(d.n_draw AS DOUBLE) * c.size / s.words) AS p, c.u
  FROM classed c JOIN shares h ON c.source IS NOT DISTINCT FROM h.source
  LEFT JOIN draws d ON c.source IS NOT DISTINCT FROM d.source AND c.class = d.class AND c.class > 0
  LEFT JOIN strata s ON c.source IS NOT DISTINCT FROM s.source AND c.class = s.class),
keyed AS (
  SELECT *, (u / (1.0::DOUBLE - u)) * ((1.0::DOUBLE - p) / nullif(p, 0)) AS odds FROM ranked)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (whole + CASE WHEN n_draw > 0 AND row_number() OVER (
         PARTITION BY source, class ORDER BY odds / (1.0::DOUBLE + odds) ASC NULLS LAST, doc_id) <= n_draw THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM keyed
"""


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, what it loses and a digest of what it keeps."""
    kept = without_repeated_strings(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["stop"] - r["start"])
    return kept.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


#: Documents that a search returns for each item.
SEARCH_TOP = 10


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), SEARCH_TOP)


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc_no, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents WHERE text IS NOT NULL),
items AS (
  SELECT row_number() OVER () AS item_no, item_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL),
lowered AS (
  SELECT doc_no, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
asked AS (
  SELECT item_no, term, count(*) AS times FROM (
    SELECT item_no, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM items) GROUP BY item_no, term),
postings AS (
  SELECT doc_no, term, count(*) AS tf FROM lowered WHERE term IN (SELECT term FROM asked) GROUP BY doc_no, term),
totals AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS all_terms FROM docs WHERE len(words) > 0),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM postings, totals GROUP BY term, n_docs),
added AS (
  SELECT p.doc_no, p.term, w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * CAST(len(d.words) AS BIGINT) * t.n_docs) // t.all_terms))) AS gain
  FROM postings p JOIN weights w USING (term) JOIN docs d USING (doc_no), totals t),
scored AS (
  SELECT a.item_no, p.doc_no, CAST(sum(a.times * p.gain) AS BIGINT) AS score
  FROM asked a JOIN added p USING (term) GROUP BY a.item_no, p.doc_no),
ranked AS (
  SELECT i.item_id, d.doc_id, s.score,
         row_number() OVER (PARTITION BY s.item_no ORDER BY s.score DESC, d.doc_id ASC NULLS LAST) AS rank
  FROM scored s JOIN items i USING (item_no) JOIN docs d USING (doc_no) WHERE s.score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {"op1_exact_dedup": op1_exact_dedup, "op2_quality": op2_quality, "op3_secret_scan": op3_secret_scan, "op5_token_counts": op5_token_counts, "op4_decontamination": op4_decontamination, "op6_fixity_audit": op6_fixity_audit, "op7_substring_dedup": op7_substring_dedup, "op8_toxicity": op8_toxicity, "op9_jaccard_join": op9_jaccard_join, "op10_mix_sources": op10_mix_sources, "op11_suffix_dedup": op11_suffix_dedup, "op12_lexical_search": op12_lexical_search, "op13_whitening": op13_whitening, "pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op3_secret_scan": scan_sql(), "op4_decontamination": contaminated_sql(), "op6_fixity_audit": OP6_SQL, "op10_mix_sources": mix_sql("documents"), "op12_lexical_search": OP12_SQL}
