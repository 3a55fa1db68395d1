"""Named queries over the star-schema tables, one or more for each operator, with the SQL that gives the same rows.

Inputs that the tables lack (blanks, malformed dates, padded numbers, tax numbers, phone numbers) are made by SQL
expressions that Spark and the oracle read alike.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import decimals, headers, sketches
from .functions import detectors as det
from .functions import similarity as sim
from .functions import text as t
from .model import EngineConfig, SourceColumn, TargetField, TargetSchema
from .operators import dryrun as dry
from .operators import evaluate, knowledge, layout, scoring
from .operators import profile as prof
from .plans import plan as planning
from .plans import steps
from .plans.plan import Step
from .session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Inputs

DAY = "lpad(CAST(k % {n} + 1 AS STRING), 2, '0')"
DIRTY = {
    "c0": "CASE WHEN k % 11 = 0 THEN ' ' ELSE '  ' || c_name || ' ' END",
    "c1": "CASE WHEN k % 7 = 0 THEN 'not-an-email' WHEN k % 13 = 0 THEN '' WHEN k % 17 = 0 THEN 'odd@place' ELSE 'user' || CAST(k AS STRING) || '@example.com' END",
    "c2": "CASE WHEN k % 9 = 0 THEN 'x,y' WHEN k % 8 = 0 THEN '1.' || lpad(CAST(k % 1000 AS STRING), 3, '0') || ',25' ELSE CAST(k AS STRING) || ',50' END",
    "c3": f"CASE WHEN k % 5 = 0 THEN '31/02/2026' WHEN k % 3 = 0 THEN '2026-01-' || {DAY.format(n=31)} ELSE {DAY.format(n=28)} || '/' || {DAY.format(n=12)} || '/2026' END",
    "c4": "CASE WHEN k % 4 = 0 THEN '529.982.247-25' WHEN k % 4 = 1 THEN '11144477735' WHEN k % 4 = 2 THEN '111.111.111-11' ELSE lpad(CAST(k * 104729 AS STRING), 11, '0') END",
    "c5": "CASE WHEN k % 6 = 0 THEN '+55 (11) 9' || lpad(CAST(k AS STRING), 8, '0') WHEN k % 6 = 1 THEN '(05) 3333-4444' WHEN k % 6 = 2 THEN 'none' ELSE '21' || lpad(CAST(k AS STRING), 9, '9') END",
    "c6": "CASE WHEN k % 5 = 0 THEN 'sim' WHEN k % 5 = 1 THEN 'não' WHEN k % 5 = 2 THEN 'TRUE' WHEN k % 5 = 3 THEN 'no' ELSE 'talvez' END",
    "c7": "CASE WHEN k % 10 = 0 THEN lpad(CAST(k AS STRING), 8, '0') WHEN k % 21 = 0 THEN '99999999999999999999' ELSE CAST(k AS STRING) END",
}
DIRTY_SQL = "SELECT k, " + ", ".join(f"{e} AS {c}" for c, e in DIRTY.items()) + " FROM (SELECT c_custkey AS k, c_name FROM customer)"


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_number and eight untidy text columns made from the customers."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return rows.selectExpr("k AS record_number", *[f"{e} AS {c}" for c, e in DIRTY.items()])


MIXED = {  # table -> key and text columns
    "orders": ("o_orderkey", {"o_orderstatus": "o_orderstatus", "o_totalprice": "CAST(CAST(o_totalprice AS DECIMAL(38,2)) AS STRING)", "o_orderdate": None, "o_orderpriority": "o_orderpriority"}),
    "part": ("p_partkey", {"p_name": "p_name", "p_brand": "p_brand", "p_size": "CAST(p_size AS STRING)", "p_retailprice": "CAST(CAST(p_retailprice AS DECIMAL(38,2)) AS STRING)"}),
}


MIXED_SQL = " UNION ALL ".join(
    f"SELECT {key} AS k, '{c}' AS col, " + (e or f"strftime({c}, '%Y-%m-%d')") + f" AS raw FROM {name}" for name, (key, columns) in MIXED.items() for c, e in columns.items()
)


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified cells of orders and parts as text."""
    out = None
    for name, (key, columns) in MIXED.items():
        exprs = [(e or f"date_format({c}, 'yyyy-MM-dd')") + f" AS {c}" for c, e in columns.items()]
        cells = prof.unpivot(table(spark, sf_dir, name).selectExpr(f"{key} AS record_number", *exprs), list(columns))
        out = cells if out is None else out.union(cells)
    return prof.classified(out)


def dirty_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.classified(prof.unpivot(dirty(spark, sf_dir), list(DIRTY)))


def _cells_sql(source: str) -> str:
    """CTEs up to ``cells``: k, col, raw, v, blank, type, pattern, len, bucket."""
    return f"""
WITH raw AS ({source}), s AS (SELECT k, col, raw, trim(raw, chr(32) || chr(9) || chr(10) || chr(13)) AS v FROM raw), cells AS (
  SELECT k, col, raw, v, v = '' AS blank, length(raw) AS len,
    CASE WHEN v = '' THEN 'EMPTY' WHEN regexp_full_match(v, '(?i)(true|false|yes|no|sim|nao|não)') THEN 'BOOLEAN'
      WHEN regexp_full_match(v, '[-+]?[0-9]+') AND NOT regexp_full_match(v, '[-+]?0[0-9]+') THEN 'INTEGER'
      WHEN regexp_full_match(v, '[-+]?[0-9]+[.,][0-9]+') THEN 'DECIMAL'
      WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN 'DATE' ELSE 'TEXT' END AS type,
    CASE WHEN v = '' THEN NULL WHEN regexp_full_match(v, '[^\\s@]+@[^\\s@]+') THEN 'EMAIL_LIKE'
      WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN 'DATE_LIKE'
      WHEN regexp_full_match(v, '[-+]?[0-9]+') THEN 'INTEGER_LIKE' WHEN regexp_full_match(v, '[-+]?[0-9]+[.,][0-9]+') THEN 'DECIMAL_LIKE'
      WHEN regexp_full_match(v, '[\\p{{L}}0-9_-]+') THEN 'ALPHANUMERIC' WHEN regexp_full_match(v, '[\\p{{L}}\\s.''-]+') THEN 'TEXT_WORDS' ELSE 'OTHER' END AS pattern,
    CASE WHEN v = '' THEN NULL WHEN length(raw) <= 4 THEN '1-4' WHEN length(raw) <= 8 THEN '5-8' WHEN length(raw) <= 12 THEN '9-12' WHEN length(raw) <= 20 THEN '13-20'
      WHEN length(raw) <= 40 THEN '21-40' WHEN length(raw) <= 80 THEN '41-80' ELSE '81+' END AS bucket FROM s
)"""


DIRTY_CELLS_SQL = _cells_sql(" UNION ALL ".join(f"SELECT k, '{c}' AS col, {c} AS raw FROM ({DIRTY_SQL})" for c in DIRTY))
MIXED_CELLS_SQL = _cells_sql(MIXED_SQL)
VOTES_SQL = "v AS (SELECT col, type, count(*) AS n FROM cells WHERE type <> 'EMPTY' GROUP BY col, type), tot AS (SELECT col, sum(n) AS total FROM v GROUP BY col)"
INFERRED_SQL = "inf AS (SELECT col, CASE WHEN max(n) >= 0.8 * max(total) THEN max_by(type, n) ELSE 'MIXED' END AS inferred FROM v JOIN tot USING (col) GROUP BY col)"


# Profile

MIXED_COLUMNS = [c for _, columns in MIXED.values() for c in columns]


def _profiles(cells: DataFrame, names: list[str], values: bool = True) -> list[prof.ColumnProfile]:
    """The engine's profiles of classified cells, without detectors and samples."""
    columns = tuple(SourceColumn(c, k, c, c) for k, c in enumerate(names))
    return prof.profile_cells(cells, columns, (), EngineConfig(sample_size=0), locations=False, values=values)


@query(MIXED_CELLS_SQL + f", {VOTES_SQL}, {INFERRED_SQL}, c AS (SELECT col, raw, count(*) AS n FROM cells WHERE NOT blank GROUP BY col, raw) "
       "SELECT col AS column_name, inferred, CAST(sum(n) AS BIGINT) AS observed, count(*) AS distinct_values, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c JOIN inf USING (col) GROUP BY col, inferred")  # fmt: skip
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _profiles(mixed(spark, sf_dir), MIXED_COLUMNS)
    rows = [(p.column.id, p.inferred, p.observed, p.distinct, p.entropy) for p in found]
    return spark.createDataFrame(rows, "column_name string, inferred string, observed long, distinct_values long, entropy double").withColumn("entropy", F.round("entropy", 6))


@query(DIRTY_CELLS_SQL + " SELECT col AS column_name, count(*) AS n_rows, count(*) FILTER (blank) AS nulls, min(len) FILTER (NOT blank) AS min_length, max(len) FILTER (NOT blank) AS max_length, round(avg(len) FILTER (NOT blank), 9) AS avg_length, round(count(*) FILTER (blank) / count(*), 9) AS null_ratio FROM cells GROUP BY col")
def profile_counts_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube, full = prof.shape_cube(dirty_cells(spark, sf_dir)), F.col("type") != "EMPTY"
    nulls = F.coalesce(F.sum(F.when(~full, F.col("n"))), F.lit(0))
    observed = F.sum(F.when(full, F.col("n")))
    return cube.groupBy(F.col("column").alias("column_name")).agg(
        F.sum("n").alias("n_rows"), nulls.alias("nulls"), F.min(F.when(full, F.col("min_length"))).cast("long").alias("min_length"), F.max(F.when(full, F.col("max_length"))).cast("long").alias("max_length"),
        F.round(F.sum(F.when(full, F.col("sum_length"))) / observed, 9).alias("avg_length"), F.round(nulls / F.sum("n"), 9).alias("null_ratio"),
    )


@query(DIRTY_CELLS_SQL + " SELECT col AS column_name, type, count(*) AS votes FROM cells GROUP BY col, type")
def physical_type_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.shape_cube(dirty_cells(spark, sf_dir)).groupBy(F.col("column").alias("column_name"), "type").agg(F.sum("n").alias("votes"))


@query(DIRTY_CELLS_SQL + f", {VOTES_SQL}, {INFERRED_SQL} SELECT col AS column_name, inferred, round(1 - max(n) / max(total), 9) AS mixed_ratio FROM v JOIN tot USING (col) JOIN inf USING (col) GROUP BY col, inferred")
def inferred_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _profiles(dirty_cells(spark, sf_dir), list(DIRTY), values=False)
    return spark.createDataFrame([(p.column.id, p.inferred, p.mixed_ratio) for p in found], "column_name string, inferred string, mixed_ratio double").withColumn("mixed_ratio", F.round("mixed_ratio", 9))


@query(MIXED_CELLS_SQL + " SELECT col AS column_name, pattern, count(*) AS n FROM cells WHERE NOT blank GROUP BY col, pattern")
def pattern_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.shape_cube(mixed(spark, sf_dir)).where("pattern IS NOT NULL").groupBy(F.col("column").alias("column_name"), "pattern").agg(F.sum("n").alias("n"))


@query(MIXED_CELLS_SQL + " SELECT col AS column_name, bucket, count(*) AS n FROM cells WHERE NOT blank GROUP BY col, bucket")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.shape_cube(mixed(spark, sf_dir)).where("bucket IS NOT NULL").groupBy(F.col("column").alias("column_name"), "bucket").agg(F.sum("n").alias("n"))


@query(MIXED_CELLS_SQL + " SELECT col AS column_name, count(DISTINCT raw) AS distinct_values, round(count(DISTINCT raw) / count(*), 9) AS unique_ratio FROM cells WHERE NOT blank GROUP BY col")
def exact_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prof.value_summary(prof.value_counts(mixed(spark, sf_dir)))
    return s.select(F.col("column").alias("column_name"), F.col("distinct").alias("distinct_values"), F.round(F.col("distinct") / F.col("nonblank"), 9).alias("unique_ratio"))


@query("SELECT 'event_type' AS column_name, round(entropy(event_type), 6) AS entropy FROM events UNION ALL SELECT 'user_id', round(entropy(user_id), 6) FROM events")
def entropy_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS record_number", "event_type", "CAST(user_id AS STRING) AS user_id")
    cells = prof.classified(prof.unpivot(rows, ["event_type", "user_id"]))
    return prof.value_summary(prof.value_counts(cells)).select(F.col("column").alias("column_name"), F.round("entropy", 6).alias("entropy"))


@query(MIXED_CELLS_SQL + ", c AS (SELECT col, raw, count(*) AS n FROM cells WHERE NOT blank GROUP BY col, raw) SELECT col AS column_name, rank, '<redacted:length=' || length(raw) || '>' AS value, n FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, raw) AS rank FROM c) WHERE rank <= 10")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = prof.top_values(prof.value_counts(mixed(spark, sf_dir)), 10)
    return top.select(F.col("column").alias("column_name"), F.col("rank").cast("long").alias("rank"), t.redact(F.col("value")).alias("value"), "n")


@query(MIXED_CELLS_SQL + ", x AS (SELECT col, TRY_CAST(replace(v, ',', '.') AS DOUBLE) AS d FROM cells WHERE type IN ('INTEGER', 'DECIMAL')) SELECT col AS column_name, count(d) AS n, round(avg(d), 4) AS mean, round(var_pop(d) / avg(d) / avg(d), 6) AS relative_variance, min(d) AS low, max(d) AS high FROM x GROUP BY col")
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _profiles(mixed(spark, sf_dir), MIXED_COLUMNS, values=False)
    rows = [(p.column.id, x["count"], x["mean"], x["variance"] / x["mean"] ** 2, x["min"], x["max"]) for p in found if (x := p.numeric)]
    made = spark.createDataFrame(rows, "column_name string, n long, mean double, relative_variance double, low double, high double")
    return made.withColumns({"mean": F.round("mean", 4), "relative_variance": F.round("relative_variance", 6)})


# wrapping multiplication modulo 2**64 in two halves
WRAP = "(((({h} >> 32) * {m}) % 4294967296) * 4294967296 + ({h} % 4294967296) * {m}) % 18446744073709551616"


@query(f"""
WITH x AS (SELECT DISTINCT 'o_custkey' AS col, CAST(o_custkey AS VARCHAR) AS v FROM orders UNION SELECT 'o_orderpriority', o_orderpriority FROM orders),
h0 AS (SELECT col, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(v, ''), lambda c: CAST(unicode(c) AS HUGEINT))), lambda a, c: xor(a, c) * 1099511628211 % 18446744073709551616) AS h FROM x),
h1 AS (SELECT col, xor(h, h >> 33) AS h FROM h0), h2 AS (SELECT col, {WRAP.format(h="h", m="18397679294719823053::HUGEINT")} AS h FROM h1),
h3 AS (SELECT col, xor(h, h >> 33) AS h FROM h2), h4 AS (SELECT col, {WRAP.format(h="h", m="14181476777654086739::HUGEINT")} AS h FROM h3),
h5 AS (SELECT col, xor(h, h >> 33) AS h FROM h4),
r AS (SELECT col, h >> 54 AS idx, max(CASE WHEN h % 18014398509481984 = 0 THEN 55 ELSE 64 - length(bin(CAST((h % 18014398509481984) * 1024 AS UBIGINT))) + 1 END) AS rnk FROM h5 GROUP BY ALL),
s AS (SELECT col, sum(pow(2.0, -rnk)) AS s, count(*) AS used FROM r GROUP BY col),
e AS (SELECT col, used, 0.7213 / (1 + 1.079 / 1024) * 1024 * 1024 / (s + (1024 - used)) AS raw FROM s)
SELECT col AS column_name, CAST(round(CASE WHEN raw <= 2560 AND used < 1024 THEN 1024 * ln(1024.0 / (1024 - used)) ELSE raw END) AS BIGINT) AS estimate FROM e
""")
def hll_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_number"), F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderpriority")
    cells = prof.unpivot(rows, ["o_custkey", "o_orderpriority"])
    regs = sketches.registers(cells.select("column", "raw"), "raw", "column")
    return sketches.estimate(regs, "column").withColumnRenamed("column", "column_name")


@query(MIXED_CELLS_SQL + " SELECT col AS column_name, count(DISTINCT raw) > 0 AS ok FROM cells WHERE NOT blank GROUP BY col")
def estimated_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = mixed(spark, sf_dir).where("NOT blank")
    both = cells.groupBy(F.col("column").alias("column_name")).agg(F.hll_sketch_estimate(F.hll_sketch_agg("raw", F.lit(12))).alias("e"), F.count_distinct("raw").alias("d"))
    return both.select("column_name", (F.abs(F.col("e") - F.col("d")) <= 0.1 * F.col("d") + 1).alias("ok"))


@query()
def cardinality_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimates themselves; estimated_cardinality only says that they are near, as its SQL does."""
    cells = mixed(spark, sf_dir).where("NOT blank")
    return cells.groupBy(F.col("column").alias("column_name")).agg(F.hll_sketch_estimate(F.hll_sketch_agg("raw", F.lit(12))).alias("estimate"))


@query(DIRTY_CELLS_SQL + """, n AS (SELECT col, count(*) AS total, count(*) FILTER (blank) AS nulls FROM cells GROUP BY col),
p AS (SELECT col, 'RARE_FORMAT' AS code, pattern AS bucket, count(*) AS n, min(k) AS first FROM cells WHERE NOT blank GROUP BY col, pattern UNION ALL SELECT col, 'RARE_LENGTH', bucket, count(*), min(k) FROM cells WHERE NOT blank GROUP BY col, bucket),
q AS (SELECT *, max(n) OVER w AS top, sum(n) OVER w AS observed, count(*) OVER w AS buckets FROM p WINDOW w AS (PARTITION BY col, code)),
t AS (SELECT col, max(n) AS top, sum(n) AS observed FROM (SELECT col, type, count(*) AS n FROM cells WHERE NOT blank GROUP BY col, type) GROUP BY col)
SELECT col AS column_name, 'NULL_PRESENT' AS code, '' AS bucket, nulls AS n, CAST(NULL AS BIGINT) AS first_record FROM n WHERE nulls > 0 AND total > nulls
UNION ALL SELECT col, CASE WHEN top >= 0.8 * observed THEN 'PHYSICAL_TYPE_OUTLIER' ELSE 'MIXED_PHYSICAL_TYPES' END, '', CAST(observed - top AS BIGINT), NULL FROM t WHERE observed > top
UNION ALL SELECT col, code, bucket, n, first FROM q WHERE observed >= 20 AND buckets >= 2 AND top >= 0.8 * observed AND n <= 0.05 * observed""")
def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for p in _profiles(dirty_cells(spark, sf_dir), list(DIRTY), values=False):
        for a in p.anomalies:
            bucket = a.explanation.removeprefix("rare bucket ") if a.code.startswith("RARE_") else ""
            rows.append((p.column.id, a.code, bucket, a.count, a.locations[0][0] if a.locations else None))
    return spark.createDataFrame(rows, "column_name string, code string, bucket string, n long, first_record long")


@query(DIRTY_CELLS_SQL + " SELECT col AS column_name, k AS record_number, place FROM (SELECT col, k, row_number() OVER (PARTITION BY col ORDER BY k) AS place FROM cells WHERE blank) WHERE place <= 3")
def null_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    found = prof.first_rows(dirty_cells(spark, sf_dir), F.col("blank"), 3)
    place = F.row_number().over(Window.partitionBy("column").orderBy("record_number")).cast("long")
    return found.select(F.col("column").alias("column_name"), "record_number", place.alias("place"))


def _detector_query(d: det.Detector, column: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = t.strip(F.col(column))
        rows = dirty(spark, sf_dir).where(~t.blank(F.col(column)))
        return rows.agg(F.count("*").alias("observed"), F.count_if(d.shape(v)).alias("shape"), F.count_if(d.valid(v)).alias("valid"), F.count_if(d.ambiguous(v)).alias("ambiguous"))

    return run


def _detector_sql(column: str, shape: str, valid: str, ambiguous: str = "false") -> str:
    return f"SELECT count(*) AS observed, count(*) FILTER ({shape}) AS shape, count(*) FILTER ({valid}) AS valid, count(*) FILTER ({ambiguous}) AS ambiguous FROM (SELECT trim({column}) AS v FROM ({DIRTY_SQL})) WHERE v <> ''"


SLASH = "regexp_full_match(v, '[0-9]{2}/[0-9]{2}/[0-9]{4}')"
DMY, MDY = f"({SLASH} AND try_strptime(v, '%d/%m/%Y') IS NOT NULL)", f"({SLASH} AND try_strptime(v, '%m/%d/%Y') IS NOT NULL)"
ISO = "(regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_strptime(v, '%Y-%m-%d') IS NOT NULL)"
CPF_D = "replace(replace(v, '.', ''), '-', '')"
CPF_SUM = "(list_sum(list_transform(range(0, {n}), lambda i: CAST(substr({d}, CAST(i + 1 AS BIGINT), 1) AS INTEGER) * ({n} + 1 - i))) * 10 % 11 % 10 = CAST(substr({d}, {n} + 1, 1) AS INTEGER))"
CPF_OK = f"CASE WHEN regexp_full_match({CPF_D}, '[0-9]{{11}}') AND {CPF_D} <> repeat(substr({CPF_D}, 1, 1), 11) THEN {CPF_SUM.format(n=9, d=CPF_D)} AND {CPF_SUM.format(n=10, d=CPF_D)} ELSE false END"
PHONE_D = "regexp_replace(v, '[^0-9]', '', 'g')"
for _name, _d, _c, _sql in (
    ("semantic_email", det.EMAIL, "c1", ("regexp_full_match(v, '[^\\s@]+@[^\\s@]+')", "regexp_full_match(v, '[^\\s@]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')")),
    ("semantic_date", det.DATE, "c3", (f"({SLASH} OR regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'))", f"({ISO} OR {DMY} OR {MDY})", f"({DMY} AND {MDY} AND substr(v, 1, 2) <> substr(v, 4, 2))")),
    ("semantic_cpf", det.CPF, "c4", ("regexp_full_match(v, '[0-9]{11}|[0-9]{3}\\.[0-9]{3}\\.[0-9]{3}-[0-9]{2}')", CPF_OK)),
    ("semantic_phone", det.PHONE, "c5", (f"length({PHONE_D}) BETWEEN 10 AND 11", f"length({PHONE_D}) BETWEEN 10 AND 11 AND TRY_CAST(substr({PHONE_D}, 1, 2) AS INTEGER) >= 11", "regexp_full_match(v, '[0-9]{11}')")),
):
    QUERIES[_name] = _detector_query(_d, _c)
    SQL[_name] = _detector_sql(_c, *_sql)


@query("WITH d AS (" + SQL["semantic_phone"] + ") SELECT observed, round(valid / observed, 9) AS validity, round(least(1.0, observed / 20) * (1 - least(1.0, ambiguous / observed)), 9) AS reliability, round(valid / observed * least(1.0, observed / 20) * (1 - least(1.0, ambiguous / observed)), 9) AS confidence FROM d")
def reliability_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = QUERIES["semantic_phone"](spark, sf_dir).first()
    e = prof.evidence_of(det.PHONE, r.observed, r["shape"], r.valid, r.ambiguous, 20)
    made = spark.createDataFrame([(e.observed, e.validity, e.reliability, e.confidence)], "observed long, validity double, reliability double, confidence double")
    return made.select("observed", *[F.round(c, 9).alias(c) for c in ("validity", "reliability", "confidence")])


# Similarity

NAMES_SQL = "SELECT a.p_partkey AS k, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with consecutive keys."""
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("x"))
    return a.join(a.select((F.col("k") - 1).alias("k"), F.col("x").alias("y")), "k")


def _pair_query(f: Callable[[Column, Column], Column]) -> Query:
    return lambda spark, sf_dir: name_pairs(spark, sf_dir).select("k", F.round(f(F.col("x"), F.col("y")), 9).alias("value"))


TOK = "list_distinct(list_filter(string_split_regex({x}, '\\s+'), lambda q: q <> ''))"
TX, TY = TOK.format(x="x"), TOK.format(x="y")
GRAMS = "list_transform(range(1, greatest(length({x}) + 2 - 2, 1) + 1), lambda i: substr('^' || {x} || '$', CAST(i AS BIGINT), 3))"
GX, GY = GRAMS.format(x="x"), GRAMS.format(x="y")
for _name, _f, _expr in (
    ("dice_tokens", sim.dice, f"2.0 * len(list_intersect({TX}, {TY})) / (len({TX}) + len({TY}))"),
    ("jaccard_tokens", sim.jaccard, f"len(list_intersect({TX}, {TY})) / (len({TX}) + len({TY}) - len(list_intersect({TX}, {TY})))"),
    ("levenshtein_normalized", sim.levenshtein, "CASE WHEN x = y THEN 1.0 ELSE CAST(1.0 AS DOUBLE) - CAST(levenshtein(x, y) AS DOUBLE) / greatest(length(x), length(y)) END"),
    ("trigram_dice", sim.trigram_dice, f"2.0 * len(list_intersect(list_distinct({GX}), list_distinct({GY}))) / (len(list_distinct({GX})) + len(list_distinct({GY})))"),
    ("trigram_cosine", sim.trigram_cosine, None),
    ("jaro", sim.jaro, None),
    ("jaro_winkler", sim.jaro_winkler, None),
    ("lexical_score", lambda x, y: sim.lexical(x, F.replace(x, F.lit(" "), F.lit("")), y, F.replace(y, F.lit(" "), F.lit(""))), None),
):
    QUERIES[_name] = _pair_query(_f)
    if _expr:
        SQL[_name] = f"SELECT k, round(CAST({_expr} AS DOUBLE), 9) AS value FROM ({NAMES_SQL})"
SQL["trigram_cosine"] = f"""
WITH p AS ({NAMES_SQL}), a AS (SELECT k, g, count(*) AS n FROM (SELECT k, unnest({GX}) AS g FROM p) GROUP BY k, g), b AS (SELECT k, g, count(*) AS n FROM (SELECT k, unnest({GY}) AS g FROM p) GROUP BY k, g),
d AS (SELECT a.k, sum(a.n * b.n) AS dot FROM a JOIN b ON a.k = b.k AND a.g = b.g GROUP BY a.k)
SELECT p.k, round(coalesce(dot, 0) / sqrt((SELECT sum(n * n) FROM a WHERE a.k = p.k) * (SELECT sum(n * n) FROM b WHERE b.k = p.k)), 9) AS value FROM p LEFT JOIN d ON d.k = p.k
"""


JARO_SQL = """
WITH RECURSIVE p AS (SELECT k, {x} AS a, {y} AS b, greatest(0, greatest(length({x}), length({y})) // 2 - 1) AS reach FROM ({pairs})),
m(k, a, b, reach, i, taken, lefts) AS (
  SELECT k, a, b, reach, 1::BIGINT, repeat('0', length(b)), '' FROM p
  UNION ALL SELECT k, a, b, reach, i + 1, CASE WHEN j IS NULL THEN taken ELSE substr(taken, 1, j - 1) || '1' || substr(taken, j + 1) END, CASE WHEN j IS NULL THEN lefts ELSE lefts || substr(a, i, 1) END
  FROM (SELECT *, list_filter(range(greatest(1, i - reach), least(length(b), i + reach) + 1), lambda q: substr(b, q, 1) = substr(a, i, 1) AND substr(taken, q, 1) = '0')[1] AS j FROM m WHERE i <= length(a))
), f AS (
  SELECT k, a, b, lefts, array_to_string(list_transform(list_filter(range(1, length(b) + 1), lambda q: substr(taken, q, 1) = '1'), lambda q: substr(b, q, 1)), '') AS rights FROM m WHERE i = length(a) + 1
), t AS (
  SELECT k, a, b, CAST(length(lefts) AS DOUBLE) AS n, len(list_filter(range(1, length(lefts) + 1), lambda q: substr(lefts, q, 1) <> substr(rights, q, 1))) / 2 AS half FROM f
), jaro AS (
  SELECT k, a, b, CASE WHEN a = b THEN 1.0 WHEN n = 0 THEN 0.0 ELSE (n / length(a) + n / length(b) + (n - half) / n) / 3.0 END AS j FROM t
), jw AS (
  SELECT k, j, CASE WHEN j < 0.7 THEN j ELSE j + len(list_filter(range(1, 5), lambda q: length(a) >= q AND length(b) >= q AND substr(a, 1, q) = substr(b, 1, q))) * 0.1 * (1.0 - j) END AS w FROM jaro
)
"""
SQL["jaro"] = JARO_SQL.format(x="x", y="y", pairs=NAMES_SQL) + "SELECT k, round(j, 9) AS value FROM jw"
SQL["jaro_winkler"] = JARO_SQL.format(x="x", y="y", pairs=NAMES_SQL) + "SELECT k, round(w, 9) AS value FROM jw"
CX, CY = "replace(x, ' ', '')", "replace(y, ' ', '')"
CGX, CGY = GRAMS.format(x=CX), GRAMS.format(x=CY)
SQL["lexical_score"] = JARO_SQL.format(x=CX, y=CY, pairs=NAMES_SQL) + f"""
, n AS ({NAMES_SQL}), ga AS (SELECT k, g, count(*) AS c FROM (SELECT k, unnest({CGX}) AS g FROM n) GROUP BY k, g), gb AS (SELECT k, g, count(*) AS c FROM (SELECT k, unnest({CGY}) AS g FROM n) GROUP BY k, g),
dot AS (SELECT ga.k, sum(ga.c * gb.c) AS d FROM ga JOIN gb ON ga.k = gb.k AND ga.g = gb.g GROUP BY ga.k), na AS (SELECT k, sum(c * c) AS q FROM ga GROUP BY k), nb AS (SELECT k, sum(c * c) AS q FROM gb GROUP BY k),
z AS (SELECT n.k, CAST(len(list_intersect({TX}, {TY})) AS DOUBLE) AS common, len({TX}) AS tx, len({TY}) AS ty, CASE WHEN {CX} = {CY} THEN 1.0 ELSE CAST(1.0 AS DOUBLE) - CAST(levenshtein({CX}, {CY}) AS DOUBLE) / greatest(length({CX}), length({CY})) END AS lev, j, w,
  CAST(2.0 * len(list_intersect(list_distinct({CGX}), list_distinct({CGY}))) AS DOUBLE) / (len(list_distinct({CGX})) + len(list_distinct({CGY}))) AS tri, coalesce(d, 0) / sqrt(na.q * nb.q) AS cosine
  FROM n JOIN jw ON jw.k = n.k JOIN na ON na.k = n.k JOIN nb ON nb.k = n.k LEFT JOIN dot ON dot.k = n.k)
SELECT k, round(0.4 * (4 * common / (tx + ty) + common / (tx + ty - common)) / 3 + 0.35 * (lev + j + w) / 3 + 0.25 * (tri + cosine) / 2, 9) AS value FROM z
"""


@query(f"SELECT k, round((CAST(2.0 * len(list_intersect({TX}, {TY})) / (len({TX}) + len({TY})) AS DOUBLE) + CASE WHEN x = y THEN 1.0 ELSE CAST(1.0 AS DOUBLE) - CAST(levenshtein(replace(x, ' ', ''), replace(y, ' ', '')) AS DOUBLE) / greatest(length(replace(x, ' ', '')), length(replace(y, ' ', ''))) END) / 2, 9) AS value FROM ({NAMES_SQL})")
def baseline_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    squeeze = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    names = F.array(F.struct(F.col("y").alias("name_comparable"), squeeze("y").alias("name_compact")))
    pairs = name_pairs(spark, sf_dir).select(F.col("k").alias("column_id"), F.lit("t").alias("target"), F.col("x").alias("comparable"), squeeze("x").alias("compact"), names.alias("names"))
    return scoring.with_lexical(pairs, "baseline").select(F.col("column_id").alias("k"), F.round("lexical", 9).alias("value"))


@query("SELECT r_regionkey AS k, lower(r_name) AS comparable, replace(lower(r_name), ' ', '') AS compact, CAST(len(string_split(lower(r_name), ' ')) AS BIGINT) AS tokens FROM region")
def header_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    normalize = headers.HeaderNormalizer()

    @F.udf("comparable string, compact string, tokens long")
    def run(name: str):
        h = normalize(name)
        return h.comparable, h.compact, len(h.tokens)

    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), run("r_name").alias("h")).select("k", "h.*")


@query("SELECT c_custkey AS k, 'acao cust no ' || c_custkey || ' data' AS comparable, 'acaocustno' || c_custkey || 'data' AS compact, CAST(5 AS BIGINT) AS tokens FROM customer")
def header_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accents, camel case, digits and an expansion."""
    ship(spark)
    normalize = headers.HeaderNormalizer(headers.PT_BR)

    @F.pandas_udf("comparable string, compact string, tokens long")
    def run(names: pd.Series) -> pd.DataFrame:
        found = [normalize(n) for n in names]
        return pd.DataFrame({"comparable": [h.comparable for h in found], "compact": [h.compact for h in found], "tokens": [len(h.tokens) for h in found]})

    header = F.concat(F.lit(" Ação  custNo"), F.col("c_custkey").cast("string"), F.lit("Dt"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), run(header).alias("h")).select("k", "h.*")


# Scoring

TARGETS = [("order.key", "orderkey"), ("order.customer", "custkey"), ("order.status", "order status"), ("order.price", "total price"), ("order.date", "order date"), ("order.priority", "priority"), ("order.comment", "comment")]
SOURCES = ["orderkey", "custkey", "orderstatus", "totalprice", "orderdate", "orderpriority", "custkey"]
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
RANKED_SQL = f"""
WITH s(column_id, name) AS (VALUES {_values([(f"c{k}", n) for k, n in enumerate(SOURCES)])}), t(target, name) AS (VALUES {_values(TARGETS)}),
p AS (SELECT column_id, target, s.name AS x, t.name AS y FROM s CROSS JOIN t),
l AS (SELECT column_id, target, (CAST(2.0 * len(list_intersect({TX}, {TY})) / (len({TX}) + len({TY})) AS DOUBLE)
  + CASE WHEN x = replace(y, ' ', '') THEN 1.0 ELSE CAST(1.0 AS DOUBLE) - CAST(levenshtein(x, replace(y, ' ', '')) AS DOUBLE) / greatest(length(x), length(replace(y, ' ', ''))) END) / 2 AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY column_id ORDER BY score DESC, target) AS rank FROM l),
m AS (SELECT column_id, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS margin FROM r GROUP BY column_id)
"""


def _ranked(spark: SparkSession) -> DataFrame:
    ship(spark)
    columns = spark.createDataFrame([(f"c{k}", k, n, n, "TEXT", 0, []) for k, n in enumerate(SOURCES)], "column_id string, position int, comparable string, compact string, inferred string, observed long, evidence array<struct<type:string,validity:double,shape:double,reliability:double,confidence:double,strong:boolean>>")
    names = [(k, i, n, "TEXT", [], True, [(0, n, n.replace(" ", ""))]) for k, (i, n) in enumerate(TARGETS)]
    targets = spark.createDataFrame(names, "ordinal int, target string, display_name string, expected string, accepts array<string>, exclusive boolean, names array<struct<at:int,name_comparable:string,name_compact:string>>")
    history = spark.createDataFrame([], "target string, source_name string, history_score double, history_reliability double")
    pairs = scoring.generated(scoring.paired(columns, targets, history), EngineConfig()).where("retained")
    return scoring.ranked(scoring.scored(scoring.with_lexical(pairs, "baseline"), EngineConfig()))


def _decided(spark: SparkSession) -> list[tuple[str, list, scoring.Decision]]:
    """Each column with its candidates in order and the engine's decision."""
    found: dict[str, list] = {}
    margins = {}
    for r in _ranked(spark).orderBy("column_id", "rank").collect():
        found.setdefault(r.column_id, []).append(scoring._candidate(r, EngineConfig()))
        margins[r.column_id] = r.margin
    return [(c, few, scoring.decide(c, [x for x in few if x.eligible], margins[c], (), EngineConfig())) for c, few in found.items()]


@query(RANKED_SQL + "SELECT column_id, target, rank, round(score, 9) AS score FROM r WHERE rank <= 3")
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark).where("rank <= 3").select("column_id", "target", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query(RANKED_SQL + "SELECT r.column_id, target, round(margin, 9) AS margin, CASE WHEN score < 0.5 THEN 'NO_MATCH' WHEN score >= 0.7 THEN 'REVIEW_RECOMMENDED' ELSE 'LOW_CONFIDENCE' END AS status FROM r JOIN m USING (column_id) WHERE rank = 1")
def decision_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c, found[0].target, d.margin, d.status) for c, found, d in _decided(spark)]
    return spark.createDataFrame(rows, "column_id string, target string, margin double, status string").withColumn("margin", F.round("margin", 9))


@query(RANKED_SQL + "SELECT target, count(*) AS claims FROM r WHERE rank = 1 AND score >= 0.5 GROUP BY target HAVING count(*) > 1")
def target_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = TargetSchema("orders", "1", [TargetField(i, n) for i, n in TARGETS])
    return spark.createDataFrame(list(scoring.collisions([d for _, _, d in _decided(spark)], schema).items()), "target string, claims long")


@query("SELECT column_id, count(*) FILTER (kept) AS retained, count(*) FILTER (NOT kept) AS pruned FROM (SELECT column_id, s.name = replace(t.name, ' ', '') OR len(list_intersect(string_split(s.name, ' '), string_split(t.name, ' '))) > 0 AS kept FROM "
       + f"(VALUES {_values([(f'c{k}', n) for k, n in enumerate(SOURCES)])}) AS s(column_id, name) CROSS JOIN (VALUES {_values(TARGETS)}) AS t(target, name)) GROUP BY column_id")
def candidate_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    schema = TargetSchema("orders", "1", [TargetField(i, n) for i, n in TARGETS])
    normalizer = headers.HeaderNormalizer()
    columns = spark.createDataFrame([(f"c{k}", k, n, n, "TEXT", 0, []) for k, n in enumerate(SOURCES)], "column_id string, position int, comparable string, compact string, inferred string, observed long, evidence array<struct<type:string,validity:double,shape:double,reliability:double,confidence:double,strong:boolean>>")
    targets = scoring.target_frame(spark, schema, normalizer).withColumn("names", F.slice("names", 1, 1))
    history = scoring.history_frame(None, spark, schema)
    found = scoring.generated(scoring.paired(columns, targets, history), EngineConfig(pruning_threshold=3))
    return found.groupBy("column_id").agg(F.count_if("retained").alias("retained"), F.count_if(~F.col("retained")).alias("pruned"))


EVENTS_SQL = """
SELECT CAST(event_id AS VARCHAR) AS feedback_id, '2026-01-01T00:00:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || 'Z' AS ts,
 CASE WHEN event_id % 3 = 0 THEN 'CONFIRMED' WHEN event_id % 3 = 1 THEN 'REJECTED' ELSE 'CORRECTED' END AS type, event_type AS name, 'user' || CAST(user_id % 20 AS VARCHAR) AS locale FROM events
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo feedback: the target is "a" where confirmed or corrected to, "b" where rejected or corrected from."""
    kind = F.when(F.col("event_id") % 3 == 0, "CONFIRMED").when(F.col("event_id") % 3 == 1, "REJECTED").otherwise("CORRECTED")
    rows = table(spark, sf_dir, "events").withColumn("type", kind)
    return rows.select(
        F.col("event_id").cast("string").alias("feedback_id"), F.concat(F.lit("2026-01-01T00:00:"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit("Z")).alias("timestamp"), "type", F.col("event_type").alias("source_name"),
        F.lit("s").alias("schema_id"), F.lit("1").alias("schema_version"), F.lit("f").alias("schema_fingerprint"), F.concat(F.lit("user"), (F.col("user_id") % 20).cast("string")).alias("locale"), F.lit("").alias("context"),
        F.when(F.col("type") == "CONFIRMED", "").otherwise("b").alias("suggested"), F.when(F.col("type") == "REJECTED", "").otherwise("a").alias("human"),
    )


HISTORY_SQL = f"""
WITH e AS ({EVENTS_SQL}), v AS (SELECT name, locale, 'a' AS target, 1 AS pos, 0 AS neg, ts FROM e WHERE type <> 'REJECTED' UNION ALL SELECT name, locale, 'b', 0, 1, ts FROM e WHERE type <> 'CONFIRMED'),
g AS (SELECT name, locale, target, sum(pos) AS p, sum(neg) AS n, max(ts) AS last FROM v GROUP BY ALL)
SELECT name AS source_name, locale, target, CAST(p AS BIGINT) AS positive, CAST(n AS BIGINT) AS negative, round((p - n) / (p + n + 2.0), 9) AS signed,
 round(least(1.0, ln(1 + p + n) / ln(9)) * abs((p - n) / (p + n + 2.0)), 9) AS reliability, last FROM g
"""


@query(HISTORY_SQL)
def history_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = knowledge.snapshot(_events(spark, sf_dir))
    return s.select("source_name", "locale", "target", (F.col("confirmed") + F.col("corrected_to")).alias("positive"), (F.col("rejected") + F.col("corrected_from")).alias("negative"), F.round("signed", 9).alias("signed"), F.round("reliability", 9).alias("reliability"), F.coalesce("last_positive", "last_negative").alias("last"))


@query(f"WITH h AS ({HISTORY_SQL}), k AS (SELECT DISTINCT event_type AS source_name FROM events) SELECT k.source_name, t.target, round(coalesce(h.reliability, 0), 9) AS reliability FROM k CROSS JOIN (VALUES ('a'), ('b'), ('z')) AS t(target) LEFT JOIN h ON h.source_name = k.source_name AND h.target = t.target AND h.locale = 'user7'")
def history_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = TargetSchema("s", "1", [TargetField(x, x) for x in "abz"], locale="user7")
    evidence = knowledge.snapshot(_events(spark, sf_dir)).withColumn("schema_fingerprint", F.lit(schema.fingerprint))
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("comparable")).distinct()
    targets = spark.createDataFrame([("a",), ("b",), ("z",)], "target string")
    out = scoring.paired(names, targets, scoring.history_frame(evidence, spark, schema))
    return out.select(F.col("comparable").alias("source_name"), "target", F.round(F.coalesce("history_reliability", F.lit(0.0)), 9).alias("reliability"))


# Layouts

EXPECTED = [("c0", 0, "name", "TEXT", "", 9), ("c1", 1, "contact", "TEXT", "core:email", 9), ("c2", 2, "contact", "TEXT", "br:phone", 9), ("c3", 3, "amount", "DECIMAL", "", 9), ("c4", 4, "old", "DATE", "", 9)]
CURRENT = [("c0", 0, "contact", "TEXT", "core:email", 9), ("c1", 1, "name", "TEXT", "", 9), ("c2", 2, "contact", "TEXT", "core:email", 9), ("c3", 3, "amount", "INTEGER", "", 9), ("c4", 4, "new", "TEXT", "", 0)]
LAYOUT_COLUMNS = "id string, position int, header string, observed_type string, semantic string, observed long"
KEYED_SQL = "SELECT *, header || '#' || CAST(row_number() OVER (PARTITION BY header ORDER BY position) - 1 AS VARCHAR) AS key FROM (VALUES {v}) AS x(id, position, header, observed_type, semantic, observed)"


@query(f"SELECT id, key AS structural_key FROM ({KEYED_SQL.format(v=_values(CURRENT))})")
def header_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.keyed(spark.createDataFrame(CURRENT, LAYOUT_COLUMNS)).select("id", "structural_key")


@query(f"""
WITH e AS ({KEYED_SQL.format(v=_values(EXPECTED))}), c AS ({KEYED_SQL.format(v=_values(CURRENT))})
SELECT coalesce(e.key, c.key) AS structural_key, e.id AS e_id, c.id AS c_id, concat_ws(',', CASE WHEN c.id IS NULL THEN 'REMOVED_COLUMN' END, CASE WHEN e.id IS NULL THEN 'ADDED_COLUMN' END,
  CASE WHEN e.position <> c.position THEN 'REORDERED_COLUMN' END, CASE WHEN e.observed_type <> c.observed_type AND e.observed_type <> 'EMPTY' AND c.observed_type <> 'EMPTY' THEN 'TYPE_DRIFT' END,
  CASE WHEN c.observed >= 3 AND e.semantic <> c.semantic THEN 'SEMANTIC_DRIFT' END) AS drift FROM e FULL OUTER JOIN c ON e.key = c.key
""")
def layout_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.matched(spark.createDataFrame(EXPECTED, LAYOUT_COLUMNS), spark.createDataFrame(CURRENT, LAYOUT_COLUMNS))
    return found.select("structural_key", "e_id", "c_id", F.array_join("drift", ",").alias("drift"))


TYPES = ("EMPTY", "BOOLEAN", "INTEGER", "DECIMAL", "DATE", "TEXT", "MIXED")


@query(f"SELECT a AS expected, b AS observed, a IN ('EMPTY', 'MIXED', 'TEXT') OR b IN ('EMPTY', 'MIXED') OR a = b OR (a = 'DECIMAL' AND b = 'INTEGER') AS ok FROM (VALUES {_values([(x,) for x in TYPES])}) AS x(a) CROSS JOIN (VALUES {_values([(x,) for x in TYPES])}) AS y(b)")
def type_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([(a, b) for a in TYPES for b in TYPES], "expected string, observed string")
    return pairs.withColumn("ok", layout.compatible(F.col("expected"), F.col("observed")))


@query("SELECT o_orderkey AS record_number, o_orderstatus AS c0 FROM orders ORDER BY o_orderkey LIMIT 64")
def guard_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.guard_rows(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_number"), F.col("o_orderstatus").alias("c0")))


@query()
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.reservoir(dirty_cells(spark, sf_dir), 20, 42).withColumnRenamed("column", "column_name")


# Projections and steps


@query(f"SELECT k, c0 || '-' || c7 AS joined, CASE WHEN trim(c0) <> '' THEN c0 WHEN trim(c1) <> '' THEN c1 ELSE '' END AS first_filled FROM ({DIRTY_SQL})")
def project_concat_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planning
    joined = steps.project(p.derived("CONCAT", p.column("c0"), p.constant("-"), p.column("c7")), "").raw
    first = steps.project(p.derived("COALESCE", p.column("c0"), p.column("c1")), "").raw
    return dirty(spark, sf_dir).select(F.col("record_number").alias("k"), joined.alias("joined"), first.alias("first_filled"))


PLAIN_SQL = "CASE WHEN {x} = 0 THEN '0' ELSE rtrim(rtrim(CAST({x} AS VARCHAR), '0'), '.') END"
ARITH_SQL = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS e, CAST(l_discount AS DECIMAL(18,2)) AS d FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, {PLAIN_SQL.format(x='(q + e + d)')} AS added, {PLAIN_SQL.format(x='(e - q)')} AS subtracted, {PLAIN_SQL.format(x='(CAST(q AS DECIMAL(9,2)) * e)')} AS multiplied, CASE WHEN d = 0 THEN 'DERIVED_DIVISION_BY_ZERO' END AS division_code, round(CASE WHEN d = 0 THEN NULL ELSE CAST(e AS DOUBLE) / CAST(d AS DOUBLE) END, 4) AS divided FROM ({ARITH_SQL})")
def project_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(f"l_{n}").cast("decimal(18,2)").cast("string").alias(c) for n, c in (("quantity", "q"), ("extendedprice", "e"), ("discount", "d"))])
    out = {n: decimals.arithmetic(op, [F.col(c) for c in cs], "en-US") for n, op, cs in (("a", "ADD", "qed"), ("s", "SUBTRACT", "eq"), ("m", "MULTIPLY", "qe"), ("v", "DIVIDE", "ed"))}
    done = rows.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in out.items()])
    return done.select("l_orderkey", "l_linenumber", F.col("a.value").alias("added"), F.col("s.value").alias("subtracted"), F.col("m.value").alias("multiplied"), F.col("v.code").alias("division_code"), F.round(F.col("v.value").cast("double"), 4).alias("divided"))


def _steps_query(column: str, made: list[tuple[str, Step, str]]) -> Query:
    """Value and code of transformers on one untidy column; (label, step, locale)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = dirty(spark, sf_dir)
        out = [F.col("record_number").alias("k")]
        for label, step, locale in made:
            o = steps.TRANSFORMERS[step.id][0](F.col(column), step, locale)
            out += [o.value.alias(f"{label}_value"), o.code.alias(f"{label}_code")]
        return rows.select(*out)

    return run


PT_OK = "regexp_full_match(c2, '[+-]?([0-9]{1,3}(\\.[0-9]{3})+|[0-9]+)(,[0-9]+)?')"
QUERIES["locale_decimal"] = _steps_query("c2", [("pt", Step.of("core:big-decimal", locale="pt-BR"), ""), ("none", Step.of("core:big-decimal"), ""), ("fr", Step.of("core:big-decimal", locale="fr"), "")])
SQL["locale_decimal"] = f"SELECT k, CASE WHEN {PT_OK} THEN replace(replace(c2, '.', ''), ',', '.') END AS pt_value, CASE WHEN NOT {PT_OK} THEN 'INVALID_DECIMAL' END AS pt_code, CAST(NULL AS VARCHAR) AS none_value, 'AMBIGUOUS_DECIMAL' AS none_code, CAST(NULL AS VARCHAR) AS fr_value, 'UNSUPPORTED_LOCALE' AS fr_code FROM ({DIRTY_SQL})"
QUERIES["date_formats"] = _steps_query("c3", [("iso", Step.of("core:local-date"), ""), ("pt", Step.of("core:local-date", formats="uuuu-MM-dd|dd/MM/uuuu"), ""), ("both", Step.of("core:local-date", formats="dd/MM/uuuu|MM/dd/uuuu"), "")])
_DATE = lambda ok, f: f"CASE WHEN {ok} THEN strftime(try_strptime(v, '{f}'), '%Y-%m-%d') END"
SQL["date_formats"] = f"""
WITH x AS (SELECT k, c3 AS v FROM ({DIRTY_SQL})), d AS (SELECT k, v, {_DATE(ISO, '%Y-%m-%d')} AS i, {_DATE(DMY, '%d/%m/%Y')} AS a, {_DATE(MDY, '%m/%d/%Y')} AS b FROM x)
SELECT k, i AS iso_value, CASE WHEN i IS NULL THEN CASE WHEN {SLASH} THEN 'AMBIGUOUS_DATE' ELSE 'INVALID_DATE' END END AS iso_code, coalesce(i, a) AS pt_value, CASE WHEN coalesce(i, a) IS NULL THEN 'INVALID_DATE' END AS pt_code,
 CASE WHEN a <> b THEN NULL ELSE coalesce(a, b) END AS both_value, CASE WHEN a <> b THEN 'AMBIGUOUS_DATE' WHEN coalesce(a, b) IS NULL THEN 'INVALID_DATE' END AS both_code FROM d
"""
QUERIES["boolean_locale"] = _steps_query("c6", [("pt", Step.of("core:boolean"), "pt-BR"), ("en", Step.of("core:boolean"), "en-US")])
SQL["boolean_locale"] = f"""
WITH x AS (SELECT k, lower(c6) AS v FROM ({DIRTY_SQL})), d AS (SELECT k, CASE WHEN v IN ('true', 'sim') THEN 'true' WHEN v IN ('false', 'não', 'nao') THEN 'false' END AS p, CASE WHEN v IN ('true', 'yes') THEN 'true' WHEN v IN ('false', 'no') THEN 'false' END AS e FROM x)
SELECT k, p AS pt_value, CASE WHEN p IS NULL THEN 'INVALID_BOOLEAN' END AS pt_code, e AS en_value, CASE WHEN e IS NULL THEN 'INVALID_BOOLEAN' END AS en_code FROM d
"""
QUERIES["integer_guard"] = _steps_query("c7", [("int", Step.of("core:integer"), ""), ("long", Step.of("core:long"), ""), ("loose", Step.of("core:long", allowLeadingZeros="true"), "")])
SQL["integer_guard"] = f"""
WITH x AS (SELECT k, c7 AS v, c7 LIKE '0_%' AS z FROM ({DIRTY_SQL}))
SELECT k, CASE WHEN NOT z THEN CAST(TRY_CAST(v AS INTEGER) AS VARCHAR) END AS int_value, CASE WHEN z THEN 'IDENTIFIER_LIKE_NUMBER' WHEN TRY_CAST(v AS INTEGER) IS NULL THEN 'INVALID_INTEGER' END AS int_code,
 CASE WHEN NOT z THEN CAST(TRY_CAST(v AS BIGINT) AS VARCHAR) END AS long_value, CASE WHEN z THEN 'IDENTIFIER_LIKE_NUMBER' WHEN TRY_CAST(v AS BIGINT) IS NULL THEN 'INVALID_LONG' END AS long_code,
 CAST(TRY_CAST(v AS BIGINT) AS VARCHAR) AS loose_value, CASE WHEN TRY_CAST(v AS BIGINT) IS NULL THEN 'INVALID_LONG' END AS loose_code FROM x
"""
QUERIES["cpf_canonical"] = _steps_query("c4", [("cpf", Step.of("br:cpf-canonical"), ""), ("cep", Step.of("br:cep-canonical"), "")])
SQL["cpf_canonical"] = f"""
WITH x AS (SELECT k, regexp_replace(c4, '[^0-9]', '', 'g') AS d, regexp_full_match(c4, '[0-9\\-\\s]+') AS plain FROM ({DIRTY_SQL}))
SELECT k, CASE WHEN length(d) = 11 THEN d END AS cpf_value, CASE WHEN length(d) <> 11 THEN 'INVALID_CPF_FORMAT' END AS cpf_code, CASE WHEN plain AND length(d) = 8 THEN d END AS cep_value, CASE WHEN NOT plain OR length(d) <> 8 THEN 'INVALID_CEP_FORMAT' END AS cep_code FROM x
"""
QUERIES["phone_canonical"] = _steps_query("c5", [("phone", Step.of("br:phone-canonical"), "")])
SQL["phone_canonical"] = f"""
WITH x AS (SELECT k, regexp_full_match(c5, '[0-9+()\\-\\s]+') AS plain, regexp_replace(c5, '[^0-9]', '', 'g') AS d FROM ({DIRTY_SQL})), y AS (SELECT k, plain, CASE WHEN length(d) BETWEEN 12 AND 13 AND d LIKE '55%' THEN substr(d, 3) ELSE d END AS d FROM x)
SELECT k, CASE WHEN plain AND length(d) BETWEEN 10 AND 11 THEN d END AS phone_value, CASE WHEN NOT plain OR length(d) NOT BETWEEN 10 AND 11 THEN 'INVALID_PHONE_FORMAT' END AS phone_code FROM y
"""
QUERIES["string_normalize"] = _steps_query("c0", [("lower", Step.of("core:string-normalize", case="lower"), ""), ("keep", Step.of("core:string-normalize"), "")])
SQL["string_normalize"] = f"SELECT k, lower(trim(c0)) AS lower_value, CASE WHEN lower(trim(c0)) <> c0 THEN 'STRING_NORMALIZED' END AS lower_code, trim(c0) AS keep_value, CASE WHEN trim(c0) <> c0 THEN 'STRING_NORMALIZED' END AS keep_code FROM ({DIRTY_SQL})"

CHECKS = [
    ("required", "c0", Step.of("core:required")), ("regex", "c1", Step.of("core:regex", pattern=r"^[^\s@]+@[^\s@]+\.[^\s@]+$")), ("length", "c7", Step.of("core:length", min="2", max="6")),
    ("enum", "c6", Step.of("core:enum", values="sim|não")), ("range", "c7", Step.of("core:numeric-range", min="10", max="1000")), ("dates", "c3", Step.of("core:date-range", min="2026-01-10")),
    ("cpf", "c4", Step.of("br:cpf-checksum")), ("option", "c0", Step.of("core:regex")),
]


@query(f"""
SELECT k, CASE WHEN trim(c0) = '' THEN 'REQUIRED_VALUE_MISSING' END AS required, CASE WHEN NOT regexp_full_match(c1, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') THEN 'REGEX_MISMATCH' END AS regex,
 CASE WHEN length(c7) NOT BETWEEN 2 AND 6 THEN 'LENGTH_OUT_OF_RANGE' END AS length, CASE WHEN c6 NOT IN ('sim', 'não') THEN 'VALUE_NOT_IN_ENUM' END AS enum,
 CASE WHEN CAST(c7 AS HUGEINT) NOT BETWEEN 10 AND 1000 THEN 'NUMERIC_OUT_OF_RANGE' END AS range, CASE WHEN NOT regexp_full_match(c3, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'INVALID_DATE_VALUE' WHEN c3 < '2026-01-10' THEN 'DATE_OUT_OF_RANGE' END AS dates,
 CASE WHEN NOT ({CPF_OK.replace(CPF_D, "c4")}) THEN 'INVALID_CPF_CHECKSUM' END AS cpf, 'INVALID_VALIDATOR_OPTION' AS option FROM ({DIRTY_SQL})
""")
def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [steps.VALIDATORS[s.id](F.col(c), F.col(c), s).alias(label) for label, c, s in CHECKS]
    return dirty(spark, sf_dir).select(F.col("record_number").alias("k"), *checks)


@query("SELECT doc_id, '<redacted:length=' || CAST(length(text) AS VARCHAR) || '>' AS text FROM documents WHERE NOT regexp_matches(text, '[\\x{10000}-\\x{10FFFF}]')")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows: a null text counts as empty, a code point beyond the basic plane as two. The SQL leaves both kinds of rows out."""
    return table(spark, sf_dir, "documents").select("doc_id", t.redact(F.col("text")).alias("text"))


# Dry runs

DRY_SCHEMA = TargetSchema("customers", "1", [
    TargetField("customer.name", "Name", required=True), TargetField("customer.email", "Email", semantic_types=["core:email"]), TargetField("customer.amount", "Amount", physical_type="DECIMAL"),
    TargetField("customer.since", "Since", physical_type="DATE"), TargetField("customer.document", "Document", semantic_types=["br:cpf"]), TargetField("customer.phone", "Phone", semantic_types=["br:phone"]),
    TargetField("customer.active", "Active", physical_type="BOOLEAN"), TargetField("customer.number", "Number", physical_type="INTEGER"),
], locale="pt-BR")


def dry_plan() -> planning.Plan:
    bindings = []
    for k, f in enumerate(DRY_SCHEMA.fields):
        made = (Step.of("core:string-normalize"),) if k == 0 else planning.default_transformations(f, "pt-BR")
        bindings.append(planning.Binding(f.id, planning.column(f"c{k}"), made, planning.default_validations(f)))
    return planning.sealed(planning.Plan("", "customers", "", "customers", "1", DRY_SCHEMA.fingerprint, "", tuple(bindings)))


def _dry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dry.measured(dry.evaluated(dirty(spark, sf_dir), dry_plan(), DRY_SCHEMA, list(DIRTY)))


DRY_SQL = f"""
WITH x AS ({DIRTY_SQL}), p AS (SELECT k, v, d FROM (SELECT k, c5 AS v, CASE WHEN length(regexp_replace(c5, '[^0-9]', '', 'g')) BETWEEN 12 AND 13 AND regexp_replace(c5, '[^0-9]', '', 'g') LIKE '55%' THEN substr(regexp_replace(c5, '[^0-9]', '', 'g'), 3) ELSE regexp_replace(c5, '[^0-9]', '', 'g') END AS d FROM x)),
f AS (
 SELECT k, 0 AS field, 'customer.name' AS target, 0 AS kind, 'STRING_NORMALIZED' AS code, length(c0) AS len FROM x WHERE trim(c0) <> '' AND trim(c0) <> c0
 UNION ALL SELECT k, 0, 'customer.name', 1, 'REQUIRED_VALUE_MISSING', length(c0) FROM x WHERE trim(c0) = ''
 UNION ALL SELECT k, 1, 'customer.email', 1, 'REGEX_MISMATCH', length(c1) FROM x WHERE trim(c1) <> '' AND NOT regexp_full_match(c1, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+')
 UNION ALL SELECT k, 2, 'customer.amount', 1, 'INVALID_DECIMAL', length(c2) FROM x WHERE NOT {PT_OK}
 UNION ALL SELECT k, 3, 'customer.since', 1, 'INVALID_DATE', length(v) FROM (SELECT k, c3 AS v FROM x) WHERE NOT ({ISO} OR {DMY})
 UNION ALL SELECT k, 4, 'customer.document', 1, 'INVALID_CPF_FORMAT', length(c4) FROM x WHERE length({CPF_D.replace('v', 'c4')}) <> 11
 UNION ALL SELECT k, 4, 'customer.document', 1, 'INVALID_CPF_CHECKSUM', length(v) FROM (SELECT k, c4 AS v FROM x) WHERE length({CPF_D}) = 11 AND NOT ({CPF_OK})
 UNION ALL SELECT k, 5, 'customer.phone', 1, 'INVALID_PHONE_FORMAT', length(v) FROM p WHERE NOT regexp_full_match(v, '[0-9+()\\-\\s]+') OR length(d) NOT BETWEEN 10 AND 11
 UNION ALL SELECT k, 6, 'customer.active', 1, 'INVALID_BOOLEAN', length(c6) FROM x WHERE lower(c6) NOT IN ('true', 'false', 'sim', 'não', 'nao')
 UNION ALL SELECT k, 7, 'customer.number', 1, CASE WHEN c7 LIKE '0_%' THEN 'IDENTIFIER_LIKE_NUMBER' ELSE 'INVALID_LONG' END, length(c7) FROM x WHERE c7 LIKE '0_%' OR TRY_CAST(c7 AS BIGINT) IS NULL
), r AS (SELECT x.k, count(*) FILTER (kind = 1) AS e, count(*) FILTER (kind = 0) AS w FROM x LEFT JOIN f USING (k) GROUP BY x.k)
"""


@query(DRY_SQL + """
, t AS (SELECT count(*) AS rows_processed, count(*) FILTER (e = 0 AND w = 0) AS rows_valid, count(*) FILTER (e = 0 AND w > 0) AS rows_with_warnings, count(*) FILTER (e > 0) AS rows_bad, CAST(sum(e) AS BIGINT) AS total_errors, CAST(sum(w) AS BIGINT) AS total_warnings FROM r),
c AS (SELECT count(*) * 8 AS cells, CAST(sum((trim(c0) <> '')::INT + (trim(c1) <> '')::INT + 6) AS BIGINT) AS non_empty_cells, CAST(sum(length(c0 || c1 || c2 || c3 || c4 || c5 || c6 || c7)) AS BIGINT) AS characters, CAST(sum((trim(c0) <> '')::INT + 6) AS BIGINT) AS transformations FROM x)
SELECT t.*, c.* FROM t, c""")
def dry_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dry.counters(_dry_rows(spark, sf_dir)).drop("validations")


@query(DRY_SQL + "SELECT kind, target, code, count(*) AS n FROM f GROUP BY ALL")
def dry_run_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dry.issues(_dry_rows(spark, sf_dir), dry_plan()).groupBy("kind", "target", "code").agg(F.count("*").alias("n"))


@query(DRY_SQL + "SELECT k AS record_number, target, code, '<redacted:length=' || CAST(len AS VARCHAR) || '>' AS value FROM f ORDER BY k, field, kind, code LIMIT 100")
def dry_run_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dry.issues(_dry_rows(spark, sf_dir), dry_plan()).orderBy("record_number", "field", "kind", "at").limit(100)
    return found.select("record_number", "target", "code", F.concat(F.lit("<redacted:length="), F.col("length").cast("string"), F.lit(">")).alias("value"))


@query(DRY_SQL + """, s AS (SELECT k, field, sum(count(*)) OVER (ORDER BY k, field) AS total FROM f WHERE kind = 1 GROUP BY k, field), stop AS (SELECT k, field FROM s WHERE total >= 50 ORDER BY k, field LIMIT 1)
SELECT 'MAX_ERRORS_REACHED' AS termination_code, count(DISTINCT x.k) AS rows_processed, CAST((SELECT count(*) FROM f, stop WHERE f.kind = 1 AND (f.k < stop.k OR (f.k = stop.k AND f.field <= stop.field))) AS BIGINT) AS total_errors FROM x, stop WHERE x.k <= stop.k""")
def dry_run_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    r = dry.dry_run(dirty(spark, sf_dir), dry_plan(), DRY_SCHEMA, list(DIRTY), dry.DryRunOptions(max_errors=50))
    return spark.createDataFrame([(r.termination_code, r.rows_processed, r.total_errors)], "termination_code string, rows_processed long, total_errors long")


@query(DRY_SQL + "SELECT 'FAIL_FAST_DATA_ERROR' AS termination_code, (SELECT count(*) FROM x WHERE k <= (SELECT min(k) FROM r WHERE e > 0)) AS rows_processed, (SELECT e FROM r WHERE e > 0 ORDER BY k LIMIT 1) AS total_errors")
def dry_run_fail_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    r = dry.dry_run(dirty(spark, sf_dir), dry_plan(), DRY_SCHEMA, list(DIRTY), dry.DryRunOptions("FAIL_FAST"))
    return spark.createDataFrame([(r.termination_code, r.rows_processed, r.total_errors)], "termination_code string, rows_processed long, total_errors long")


@query(DRY_SQL + "SELECT count(*) AS rows_processed, count(*) FILTER (e = 0 AND w = 0) AS rows_valid, count(*) FILTER (e > 0) AS rows_skipped, CAST(0 AS BIGINT) AS rows_invalid, false AS terminated FROM r")
def dry_run_skip_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    r = dry.dry_run(dirty(spark, sf_dir), dry_plan(), DRY_SCHEMA, list(DIRTY), dry.DryRunOptions("SKIP_ROW", max_errors=2**31 - 1))
    return spark.createDataFrame([(r.rows_processed, r.rows_valid, r.rows_skipped, r.rows_invalid, r.terminated)], "rows_processed long, rows_valid long, rows_skipped long, rows_invalid long, terminated boolean")


# Evaluation

LABELS = [("d", "c0", "a", "s:x", False), ("d", "c1", "b", None, False), ("d", "c2", None, None, True), ("d", "c3", "c", "s:y", True), ("e", "c0", None, "s:x", False), ("e", "c9", "z", None, False)]
FOUND = [("d", "c0", ["a", "b"], "a", 0.95, 0.3, 0.8, "s:x", True), ("d", "c1", ["c", "b"], "c", 0.92, 0.2, 0.7, "", True), ("d", "c2", ["a"], None, 0.2, None, 0.3, "", True), ("d", "c3", ["c"], "c", 0.75, 0.1, 0.9, "s:x", True), ("e", "c0", ["q"], "q", 0.6, 0.2, 0.9, "s:x", False)]


def _judged(spark: SparkSession) -> DataFrame:
    labels = spark.createDataFrame(LABELS, "dataset string, column_id string, expected string, expected_semantic string, abstain boolean")
    return evaluate.judged(labels, spark.createDataFrame(FOUND, "dataset string, column_id string, top array<string>, decided string, score double, margin double, coverage double, semantic string, eligible boolean"))


_sql = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "[" + ", ".join(map(_sql, x)) + "]" if isinstance(x, list) else f"'{x}'" if isinstance(x, str) else str(x)
JUDGED_SQL = f"""
WITH l(dataset, column_id, expected, expected_semantic, abstain) AS (VALUES {", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in LABELS)}),
s(dataset, column_id, top, decided, score, margin, coverage, semantic, eligible) AS (VALUES {", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in FOUND)}),
j AS (SELECT *, coalesce(top[1] = expected, false) AS top1, coalesce(list_contains(top[1:3], expected), false) AS top3, coalesce(score >= 0.9 AND margin >= 0.15 AND coverage >= 0.6 AND eligible, false) AS auto, decided IS NULL AS none FROM l LEFT JOIN s USING (dataset, column_id))
"""


@query(JUDGED_SQL + """SELECT count(*) FILTER (expected IS NOT NULL) AS mappable, count(*) FILTER (expected IS NOT NULL AND top1) AS top1, count(*) FILTER (expected IS NOT NULL AND top3) AS top3, count(*) FILTER (auto) AS auto_mapped, count(*) FILTER (auto AND top1) AS auto_right,
 count(*) FILTER (auto AND top1) / count(*) FILTER (auto) AS auto_precision, count(*) FILTER (auto AND NOT top1) / count(*) FILTER (expected IS NULL OR NOT top1) AS auto_false_rate, count(*) FILTER (abstain) AS abstain, count(*) FILTER (abstain AND NOT auto) AS abstained,
 count(*) FILTER (expected IS NULL) AS no_match, count(*) FILTER (expected IS NULL AND none) AS no_match_right, count(*) FILTER (NOT auto AND NOT none) / count(*) AS review_rate FROM j""")
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.quality(_judged(spark))


@query(JUDGED_SQL + "SELECT CASE WHEN coalesce(expected_semantic, '') = '' THEN 'UNKNOWN' ELSE expected_semantic END AS expected_semantic, CASE WHEN coalesce(semantic, '') = '' THEN 'UNKNOWN' ELSE semantic END AS semantic, count(*) AS n FROM j GROUP BY 1, 2")
def semantic_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_judged(spark))


@query(JUDGED_SQL + "SELECT dataset, column_id, expected, top[1] AS suggested FROM j WHERE CASE WHEN expected IS NOT NULL THEN NOT top1 ELSE NOT none END")
def quality_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.failures(_judged(spark))
