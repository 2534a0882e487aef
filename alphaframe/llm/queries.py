"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_repeats import remove_repeats
from .common import stored, table
from .exact_dedup import exact_dedup
from .language_id import identify
from .line_rules import BOILERPLATE, MARKS, MENU, SEPARATORS, SYMBOLS, clean_lines
from .maxent_lm import score_texts
from .ngram_join import near_duplicates
from .packing import best_fit_pack, token_pieces
from .piece_codec import encode_pieces
from .secret_scan import scan_secrets
from .term_scan import search
from .turn_repair import damaged, repair_reports
from .vector_forest import near_vectors
from .warc import archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op1_vector_forest"] = r"""
WITH RECURSIVE fine AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(vec_id, other) AS (
  SELECT a, b FROM link UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other
), low AS (SELECT vec_id, min(other) AS low FROM reach GROUP BY 1
), n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)
"""


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op2_ngram_jaccard_join"] = r"""
WITH RECURSIVE worded AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ 	-
]+') AS w FROM documents
), shingle AS MATERIALIZED (
  SELECT doc_id, hash(s) AS h, s FROM (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM worded)
), size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1
), pair AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingle a JOIN shingle b ON a.h = b.h AND a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS MATERIALIZED (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach(doc_id, other) AS (
  SELECT a, b FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY 1) USING (doc_id)
"""


@query
def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


ORACLES["op3_warc_index"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, regexp_replace(coalesce(url, ''), '^.*?://', '') AS rest FROM pages
), keyed AS (
  SELECT page_id, html, strlen(html) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first_page,
         regexp_extract(rest, '^[^/?#]*') AS host, rest FROM p
), named AS (
  SELECT *, array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || substr(rest, length(host) + 1) AS url_key
  FROM keyed
)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_page THEN first_page END AS refers_to,
       url_key, row_number() OVER (ORDER BY url_key, page_id) - 1 AS position
FROM named
"""


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return best_fit_pack(stored(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@query
def op7_piece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op9_exact_dedup"] = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)
"""


@query
def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


@query
def op13_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "removed.navigation", "removed.boilerplate", "removed.punctuation", "lost_chars")


ORACLES["op13_line_rules"] = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), win AS MATERIALIZED (
  SELECT k, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda j: array_to_string(w[j:j + 7], ' '))) AS s FROM d
), again AS (SELECT k, i FROM (SELECT *, count(*) OVER (PARTITION BY k, s) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT k, sum(least(8, i - coalesce(before, -8))) AS n FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM again) GROUP BY 1
), line AS (
  SELECT k, unnest(lines) AS line FROM d
), sized AS (
  SELECT k, line, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         length(line) - length(translate(line, '{SEPARATORS}', '')) AS between,
         length(line) - length(translate(line, '{SYMBOLS}', '')) AS symbols,
         length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM line
), judged AS (
  SELECT k, line, chars, CASE WHEN words = 0 THEN NULL
           WHEN regexp_matches(low, '{MENU}') OR (between >= 2 AND 4 * between >= words) THEN 'navigation'
           WHEN regexp_matches(low, '{BOILERPLATE}') THEN 'boilerplate'
           WHEN 3 * symbols > words OR (words >= 8 AND NOT regexp_matches(line, '{MARKS}')) THEN 'punctuation' END AS fails, words FROM sized
), per AS (
  SELECT k, count(*) FILTER (words > 0) AS n_lines, count(*) FILTER (words > 0) - count(DISTINCT line) FILTER (words > 0) AS n_dup_lines,
         count(*) FILTER (fails = 'navigation') AS navigation, count(*) FILTER (fails = 'boilerplate') AS boilerplate,
         count(*) FILTER (fails = 'punctuation') AS punctuation, coalesce(sum(chars) FILTER (fails IS NOT NULL), 0)::BIGINT AS lost_chars,
         sum(chars)::BIGINT AS word_chars FROM judged GROUP BY 1
), based AS (
  SELECT doc_id, len(w) AS n_words, word_chars, length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
         n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, n_lines, navigation, boilerplate, punctuation, lost_chars
  FROM d JOIN per USING (k) LEFT JOIN covered USING (k)
), failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM based)
SELECT *, NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept FROM failed
"""


@query
def op11_term_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_term_scan"] = r"""
WITH words AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), sized AS MATERIALIZED (SELECT k, doc_id, len(w) AS n FROM words WHERE len(w) > 0
), whole AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized
), item AS MATERIALIZED (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL
), hit AS MATERIALIZED (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM item) GROUP BY ALL
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM hit, whole GROUP BY term, big_n
), gain AS (
  SELECT k, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))) AS gain
  FROM hit JOIN weight USING (term) JOIN sized USING (k), whole
), scored AS (
  SELECT item_id, k, CAST(sum(times * gain) AS BIGINT) AS score FROM item JOIN gain USING (term) GROUP BY 1, 2
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored JOIN sized USING (k) WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""


@query
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    reports = repair_reports(damaged(rows))
    named = rows.select(F.col("conv_id").alias("id")).distinct()
    figures = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return named.join(reports, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *figures, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


ORACLES["op12_turn_repair"] = r"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS hit FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE hit <> 0
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), faulted AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au') AS illegal FROM placed
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (illegal) AS illegal, max(i) AS last FROM faulted GROUP BY 1
), ins(state, more, here) AS (  -- 0 start, 1 after system, 2 after user, 3 after assistant
  VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)
), edit(here, kind, next) AS (
  VALUES (0, 'R', 2), (1, 'R', 2), (2, 'R', 3), (3, 'R', 2), (0, 'D', 0), (1, 'D', 1), (2, 'D', 2), (3, 'D', 3),
         (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), added AS (
  SELECT state, more, here, list_transform(range(1, more + 1), lambda k: CASE WHEN (state IN (0, 1, 3)) = (k % 2 = 1) THEN 'user:' ELSE 'assistant:' END) AS turns FROM ins
), walk(conv_id, i, state, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'turns': []::VARCHAR[]} FROM figures
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.next, min({
      'cost': w.best.cost + 3 * n.more + CASE e.kind WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN f.fault = 'truncated' AND e.kind <> 'D' THEN 3 ELSE 0 END,
      'audit': w.best.audit || repeat('I', n.more) || CASE WHEN e.kind IN ('D', 'R') THEN e.kind ELSE 'K' END,
      'turns': list_concat(list_concat(w.best.turns, n.turns), CASE e.kind WHEN 'D' THEN []::VARCHAR[]
        WHEN 'R' THEN [(CASE e.next WHEN 2 THEN 'user:' ELSE 'assistant:' END) || f.text] ELSE [f.role || ':' || f.text] END)})
  FROM walk w JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN added n ON n.state = w.state JOIN edit e ON e.here = n.here
  WHERE (e.kind IN ('D', 'R') OR e.kind = f.role[1]) AND (e.kind = 'D' OR coalesce(f.fault, '') NOT IN ('blank', 'duplicate'))
  GROUP BY 1, 2, 3
), done AS (
  SELECT w.conv_id, min({'cost': w.best.cost + 3 * n.more, 'audit': w.best.audit || repeat('I', n.more), 'turns': list_concat(w.best.turns, n.turns)}) AS best
  FROM walk w JOIN figures g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.last = w.i JOIN added n ON n.state = w.state WHERE n.here IN (0, 3) GROUP BY 1
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(d.best.cost, 0)::BIGINT AS cost, coalesce(d.best.audit, '') AS audit,
       sha256(coalesce(array_to_string(d.best.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
