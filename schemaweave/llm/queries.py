"""The registered queries of this subpackage, with their parameters, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import brown, chat, exact, langid, linedup, minhash, mixing, packing, quality, rules
from .store import bound_batches, stash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> F.Column:
    """The remainder by which rows are held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(3) == 1)
    stats = stash(quality.features(docs, ("doc_id", "held_out")), "stats")
    model = quality.fit(stats, table(spark, sf_dir, "labels"), ~F.col("held_out"))
    scored = quality.score(stats, model, ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(7) == 2)
    model, counts = brown.fit(docs.where(~F.col("held_out")))
    return brown.score(docs, model, counts, ("doc_id", "held_out"))


def op3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


EXTRA_TURN = r"\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_TURN), (-7, 1, "assistant", EXTRA_TURN)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 85).select("doc_id", "n_shingles", "component_id", "kept")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(4) == 2)
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, ("doc_id", "held_out"))


def op8_line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.deduplicate_lines(table(spark, sf_dir, "documents"), 80, width=1)


def op8_line_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = linedup.linked_lines(table(spark, sf_dir, "documents"), 80, width=1)
    number = lambda c: (F.col(c) + 1).cast("long")
    return lines.select("doc_id", number("line_no").alias("line_no"), F.col("first.doc_id").alias("class_doc"), number("first.line_no").alias("class_line"), "n_links")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.verdict(F.col("failed"), rules.BASE)).alias("base_failed"),
        rules.verdict(F.col("failed"), rules.DEFAULT).alias("kept"), "failed",
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality, op2_brown, op3_exact, op4_packing, op5_chat, op6_minhash, op7_langid, op8_line_words, op8_line_links, op9_rules, op10_mixing]
    return {f.__name__: f for f in found}


SQL_OP3 = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (g ORDER BY doc_id) = 1 AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""

SQL_OP9 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lines.n, 0) AS n_lines, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: length(x) > 40)) AS n_long_words,
         length(text) - length(regexp_replace(text, '[A-Za-z]|[^\x00-\x7F]', '', 'g')) AS n_letters,
         CAST(coalesce(list_sum(list_transform(range(2, len(w) + 1), lambda i: CAST(w[i] = w[i - 1] AS INTEGER))), 0) AS BIGINT) AS n_stutters
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
), f AS (
  SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
         + (CASE WHEN 20 * n_symbols > word_chars THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 3 THEN 8 ELSE 0 END)
         + (CASE WHEN word_chars > 12 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 10 * n_long_words > n_words THEN 32 ELSE 0 END)
         + (CASE WHEN 2 * n_letters < word_chars THEN 64 ELSE 0 END) + (CASE WHEN n_words = 0 THEN 128 ELSE 0 END) + (CASE WHEN 10 * n_stutters > 3 * n_words THEN 256 ELSE 0 END) AS BIGINT) AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

SQL_OP10 = r"""
WITH d AS (
  SELECT doc_id, CAST(source AS VARCHAR) AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         coalesce(CAST(doc_id AS VARCHAR), '') AS name FROM documents
), k AS (
  SELECT *, CAST('0x' || substr(md5('17:' || name), 1, 13) AS BIGINT) AS draw FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS BIGINT) AS weight, source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s
), l AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS full_at FROM w
), v AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM l
), x AS (
  SELECT (SELECT level FROM v WHERE level * weight <= cap ORDER BY full_at, rank LIMIT 1) AS water
), t AS (
  SELECT source, source_size, least(coalesce(water, 0.0) * weight, CAST(cap AS DOUBLE)) AS target FROM v, x
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), p AS (
  SELECT *, greatest(CAST(floor(target + 0.5) AS BIGINT) - whole * source_size, 0) AS missing FROM r
), c AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.whole, p.missing,
         CAST(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.draw, k.name) AS BIGINT) AS upto
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, whole * size + greatest(0, least(size, missing - (upto - size))) AS taken FROM c
"""


SQL_OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), n AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + len(list_filter(range(1, length(text) - 1), lambda i: substr(text, i, 3) = '###')) + len(list_filter(range(1, length(text) - 5), lambda i: substr(text, i, 7) = '</turn>')) AS text_chars,
    length(role) + length(role) - length(replace(replace(role, '\', ''), ':', '')) + len(list_filter(range(1, length(role) - 1), lambda i: substr(role, i, 3) = '###')) + len(list_filter(range(1, length(role) - 5), lambda i: substr(role, i, 7) = '</turn>')) AS role_chars
  FROM t
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(role_chars + text_chars + 15) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""

SQL_OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), u AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), r(doc_id, seen) AS (
  SELECT a, b FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.seen
), c AS (
  SELECT doc_id, min(seen) AS low FROM r GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, least(w.doc_id, coalesce(low, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

SQL_OP8 = r"""
WITH x AS (
  SELECT doc_id, line_no, regexp_extract_all(translate(lines[line_no], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))
), t AS (
  SELECT doc_id, line_no, list_sort(list_distinct(w)) AS s FROM x WHERE len(w) > 0
), f AS (
  SELECT s, min({'d': doc_id, 'l': line_no}) AS first, row_number() OVER (ORDER BY min({'d': doc_id, 'l': line_no})) AS k FROM t GROUP BY s
), g AS (
  SELECT k, len(s) AS n, unnest(s) AS g FROM f
), c AS (
  SELECT g, count(*) AS df FROM g GROUP BY g
), r AS (
  SELECT k, n, g, row_number() OVER (PARTITION BY k ORDER BY df, g) AS pos FROM g JOIN c USING (g)
), p AS (
  SELECT k, n, g FROM r WHERE pos <= n - (80 * n + 99) // 100 + 1
), q AS (
  SELECT DISTINCT y.k AS a, z.k AS b FROM p y JOIN p z ON y.g = z.g AND y.k < z.k AND 100 * least(y.n, z.n) >= 80 * greatest(y.n, z.n)
), m AS (
  SELECT DISTINCT b FROM (SELECT b, y.s AS u, z.s AS v, len(list_intersect(y.s, z.s)) AS common FROM q JOIN f y ON y.k = a JOIN f z ON z.k = b) WHERE 100 * common >= 80 * (len(u) + len(v) - common)
), o AS (
  SELECT t.doc_id, first <> {'d': t.doc_id, 'l': line_no} AS exact, m.b IS NOT NULL AS near FROM t JOIN f USING (s) LEFT JOIN m ON m.b = f.k
)
SELECT d.doc_id, count(exact) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (NOT exact AND near) AS n_near, count(*) FILTER (NOT exact AND NOT near) AS n_left
FROM documents d LEFT JOIN o USING (doc_id) GROUP BY d.doc_id
"""

SQL_OP8_LINKS = (
    SQL_OP8[: SQL_OP8.index(", m AS (")]
    + r""", m AS (
  SELECT a, b FROM (SELECT a, b, y.s AS u, z.s AS v, len(list_intersect(y.s, z.s)) AS common FROM q JOIN f y ON y.k = a JOIN f z ON z.k = b) WHERE 100 * common >= 80 * (len(u) + len(v) - common)
), e AS (
  SELECT k, count(*) AS n FROM (SELECT a AS k FROM m UNION ALL SELECT b FROM m) GROUP BY k
)
SELECT t.doc_id, t.line_no, first.d AS class_doc, first.l AS class_line, coalesce(e.n, 0) AS n_links FROM t JOIN f USING (s) LEFT JOIN e USING (k)
"""
)


def oracle_sql() -> dict[str, str]:
    return {"op3_exact": SQL_OP3, "op5_chat": SQL_OP5, "op6_minhash": SQL_OP6, "op8_line_words": SQL_OP8, "op8_line_links": SQL_OP8_LINKS, "op9_rules": SQL_OP9, "op10_mixing": SQL_OP10}
