"""Dry runs: a confirmed plan compiled once to Catalyst expressions and counted over all rows. Nothing is written.

Each binding becomes a struct of its projected text, steps, warnings and errors. Without an early stop one aggregation
gives all counters. With one (the error limit, or failing fast) the place of the stop is found first: it lies within
the first ``max_errors`` rows with errors, so a bounded ordered set decides, and the counters cover what comes before.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..model import EngineError, TargetSchema, redacted
from ..plans.plan import Binding, Plan
from ..plans.steps import TRANSFORMERS, VALIDATORS, check_steps, project

POLICIES = ("COLLECT_ERRORS", "SKIP_ROW", "FAIL_FAST")
#: What issue codes mean.
REASONS = {
    "REQUIRED_VALUE_MISSING": "a required target is empty",
    "INVALID_CPF_FORMAT": "not an accepted form of a CPF",
    "INVALID_CPF_CHECKSUM": "the check digits of the CPF are wrong",
    "INVALID_PHONE_FORMAT": "not an accepted form of a Brazilian phone number",
    "INVALID_CEP_FORMAT": "not an accepted form of a CEP",
    "AMBIGUOUS_DATE": "the date can be read in several ways",
    "INVALID_DATE": "the date fits no accepted format",
    "AMBIGUOUS_DECIMAL": "the separators need a locale",
    "INVALID_DECIMAL": "not a number of the wanted type",
    "INVALID_INTEGER": "not a number of the wanted type",
    "INVALID_LONG": "not a number of the wanted type",
    "DERIVED_INVALID_NUMBER": "an operand is no number in this locale",
    "DERIVED_DIVISION_BY_ZERO": "the divisor is zero",
    "DERIVED_ARITHMETIC_ERROR": "the operation has no result",
    "REGEX_MISMATCH": "the value does not fit the pattern",
    "LENGTH_OUT_OF_RANGE": "the length is out of range",
    "VALUE_NOT_IN_ENUM": "the value is not in the list",
    "NUMERIC_OUT_OF_RANGE": "the number is out of range",
    "DATE_OUT_OF_RANGE": "the date is out of range",
}


def reason(code: str) -> str:
    return REASONS.get(code, f"a step reported {code}")


@dataclass(frozen=True)
class DryRunOptions:
    policy: str = "COLLECT_ERRORS"
    max_errors: int = 1_000
    max_samples: int = 100
    max_codes: int = 256

    def __post_init__(self):
        if self.policy not in POLICIES or self.max_errors < 1 or self.max_samples < 0 or self.max_codes < 1:
            raise EngineError("INVALID_DRY_RUN_OPTIONS", "unknown policy or a bound out of range")


@dataclass
class DryRunResult:
    plan_id: str
    rows_processed: int = 0
    rows_valid: int = 0
    rows_with_warnings: int = 0
    rows_invalid: int = 0
    rows_skipped: int = 0
    cells: int = 0
    non_empty_cells: int = 0
    characters: int = 0
    fields_mapped: int = 0
    transformations: int = 0
    validations: int = 0
    manual_review: int = 0
    total_errors: int = 0
    total_warnings: int = 0
    errors_by_field: dict[str, int] = field(default_factory=dict)
    errors_by_code: dict[str, int] = field(default_factory=dict)
    warnings_by_code: dict[str, int] = field(default_factory=dict)
    samples: list[dict] = field(default_factory=list)
    terminated: bool = False
    termination_code: str = ""


FIELD = "struct<length:int,warnings:array<string>,errors:array<string>,transformations:int,validations:int,transformer:string,validator:string>"


def evaluated(rows: DataFrame, plan: Plan, schema: TargetSchema, columns: list[str]) -> DataFrame:
    """record_number, physical_line, cells, non_empty, characters, and ``fields``: one struct for each mapped binding.

    Bindings are evaluated together in layers (projected text, each transformer, the validators), a projection for each,
    so that an expression never holds copies of the ones before it.
    """
    bindings = plan.mapped
    for b in bindings:
        check_steps(b.transformations, b.validations, schema.field(b.target).physical_type)
    cells = [t.cell(F.col(c)) for c in columns]
    zero = F.lit(0)
    line = F.col("physical_line") if "physical_line" in rows.columns else F.lit(None).cast("long")
    filled = sum(((~t.blank(c)).cast("int") for c in cells), zero)
    chars = sum((t.utf16_length(c) for c in cells), zero)
    projected = [project(b.projection, schema.locale) for b in bindings]
    inputs = []
    for i, p in enumerate(projected):
        inputs += [t.cell(p.raw).alias(f"p{i}_raw"), p.raw.isNull().alias(f"p{i}_none"), p.code.alias(f"p{i}_code")]
    out = rows.select("record_number", line.alias("physical_line"), F.lit(len(columns)).alias("cells"), filled.alias("non_empty"), chars.alias("characters"), *inputs)
    # plain columns, not structs: a struct whose fields are taken apart again is inlined into every use
    out = out.withColumns({f"p{i}_filled": ~t.blank(F.col(f"p{i}_raw")) & F.col(f"p{i}_code").isNull() for i in range(len(bindings))})
    value = {i: F.col(f"p{i}_raw") for i in range(len(bindings))}
    failed = {i: F.lit(False) for i in range(len(bindings))}
    for depth in range(max([len(b.transformations) for b in bindings], default=0)):
        made, next_ = {}, {}
        for i, b in enumerate(bindings):
            if depth < len(b.transformations):
                s, at = b.transformations[depth], f"t{i}_{depth}"
                runs, o = F.col(f"p{i}_filled") & ~failed[i], TRANSFORMERS[s.id][0](value[i], s, schema.locale)
                made |= {f"{at}_ran": runs, f"{at}_out": o.value, f"{at}_code": F.when(runs, o.code), f"{at}_bad": runs & o.failed}
                next_ |= {f"{at}_value": F.when(F.col(f"{at}_ran"), F.col(f"{at}_out")).otherwise(value[i]), f"{at}_failed": failed[i] | F.col(f"{at}_bad")}
                value[i], failed[i] = F.col(f"{at}_value"), F.col(f"{at}_failed")
        out = out.withColumns(made).withColumns(next_) if made else out
    fields = [_field(i, b, projected[i].operations, value[i], failed[i]) for i, b in enumerate(bindings)]
    made = F.array(*fields) if fields else F.array().cast(f"array<{FIELD}>")
    return out.select("record_number", "physical_line", "cells", "non_empty", "characters", made.alias("fields"))


def _field(i: int, b: Binding, operations: int, value: Column, failed: Column) -> Column:
    """The ``FIELD`` struct of a binding whose transformers are evaluated."""
    raw, code, filled = F.col(f"p{i}_raw"), F.col(f"p{i}_code"), F.col(f"p{i}_filled")
    count, warnings, errors = F.lit(operations), [], [code]
    transformer, validator = F.lit(""), F.lit("")
    for depth, s in enumerate(b.transformations):
        ran, bad, said = (F.col(f"t{i}_{depth}_{x}") for x in ("ran", "bad", "code"))
        count = count + ran.cast("int")
        transformer = F.when(ran, s.id).otherwise(transformer)
        errors.append(F.when(bad, said))
        warnings.append(F.when(~bad, said))
    checks = F.lit(0)
    for s in b.validations:
        runs = code.isNull() & ~failed & (F.lit(True) if s.id == "core:required" else filled)
        checks = checks + runs.cast("int")
        validator = F.when(runs, s.id).otherwise(validator)
        errors.append(F.when(runs, VALIDATORS[s.id](raw, value, s)))
    return F.struct(
        F.when(F.col(f"p{i}_none"), 0).otherwise(t.utf16_length(raw)).alias("length"),
        (F.array_compact(F.array(*warnings)) if warnings else F.array().cast("array<string>")).alias("warnings"),
        F.array_compact(F.array(*errors)).alias("errors"),
        count.alias("transformations"),
        checks.alias("validations"),
        transformer.alias("transformer"),
        validator.alias("validator"),
    )


def _total(name: str, upto: Column | None = None) -> Column:
    source = F.col("fields") if upto is None else F.slice("fields", 1, upto)
    return F.aggregate(source, F.lit(0), lambda a, f: a + (F.size(f[name]) if name in ("errors", "warnings") else f[name]))


def measured(rows: DataFrame) -> DataFrame:
    """Adds n_errors, n_warnings, n_transformations and n_validations of each row."""
    return rows.withColumns({f"n_{x}": _total(x) for x in ("errors", "warnings", "transformations", "validations")})


def counters(rows: DataFrame) -> DataFrame:
    """All totals of measured rows in one row."""
    bad, warned = F.col("n_errors") > 0, (F.col("n_errors") == 0) & (F.col("n_warnings") > 0)
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    return rows.agg(
        F.count("*").alias("rows_processed"),
        F.count_if((F.col("n_errors") == 0) & (F.col("n_warnings") == 0)).alias("rows_valid"),
        F.count_if(warned).alias("rows_with_warnings"),
        F.count_if(bad).alias("rows_bad"),
        *[total(c).alias(a) for c, a in (("cells", "cells"), ("non_empty", "non_empty_cells"), ("characters", "characters"), ("n_transformations", "transformations"), ("n_validations", "validations"), ("n_errors", "total_errors"), ("n_warnings", "total_warnings"))],
    )


def issues(rows: DataFrame, plan: Plan) -> DataFrame:
    """One row per issue: record_number, physical_line, field (its place), target, source, kind (0 warning, 1 error), at, code, and the last steps."""
    names = F.array(*[F.struct(F.lit(b.target).alias("target"), F.lit(",".join(b.projection.sources)).alias("source")) for b in plan.mapped])
    # outer forms: for inner ones Catalyst would evaluate all steps once more to infer that arrays are not empty
    each = rows.where((F.col("n_errors") > 0) | (F.col("n_warnings") > 0)).select("record_number", "physical_line", F.posexplode_outer("fields").alias("field", "f"))
    tag = lambda kind, name: F.transform(F.col(f"f.{name}"), lambda c, k: F.struct(F.lit(kind).alias("kind"), k.alias("at"), c.alias("code")))
    out = each.select("record_number", "physical_line", "field", "f", F.explode_outer(F.concat(tag(0, "warnings"), tag(1, "errors"))).alias("i")).where("i IS NOT NULL")
    at = F.element_at(names, F.col("field") + 1)
    return out.select("record_number", "physical_line", "field", at["target"].alias("target"), at["source"].alias("source"), "i.*", F.col("f.length").alias("length"), F.col("f.transformer").alias("transformer"), F.col("f.validator").alias("validator"))


def stop_point(rows: DataFrame, options: DryRunOptions) -> tuple[int, int, bool] | None:
    """(record, number of fields of it that count, whether by the error limit) where the run stops, or None.

    Only the first rows with errors, as many as the limit at most, come to the driver, with their error counts.
    """
    first = rows.where("n_errors > 0").select("record_number", F.transform("fields", lambda f: F.size(f["errors"])).alias("errors")).orderBy("record_number")
    total = 0
    for r in first.limit(1 if options.policy == "FAIL_FAST" else options.max_errors).collect():
        for k, n in enumerate(r.errors):
            total += n
            if total >= options.max_errors and n:
                return r.record_number, k + 1, True
        if options.policy == "FAIL_FAST":
            return r.record_number, len(r.errors), False
    return None


def dry_run(rows: DataFrame, plan: Plan, schema: TargetSchema, columns: list[str], options: DryRunOptions = DryRunOptions()) -> DryRunResult:
    for b in plan.mapped:
        if set(b.projection.sources) - set(columns) or schema.field(b.target) is None:
            raise EngineError("PLAN_STRUCTURE_MISMATCH", "the plan names an unavailable column or field")
    all_rows = measured(evaluated(rows, plan, schema, columns)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _run(all_rows, plan, options)
    finally:
        all_rows.unpersist()


def _run(all_rows: DataFrame, plan: Plan, options: DryRunOptions) -> DryRunResult:
    """The result of measured rows; they are evaluated once and read for counters, the stop and the issues."""
    result = DryRunResult(plan.plan_id, fields_mapped=len(plan.mapped))
    first = counters(all_rows).first()
    stop = None
    if first.total_errors and (options.policy == "FAIL_FAST" or first.total_errors >= options.max_errors):
        stop = stop_point(all_rows, options)
    if stop:
        record, upto, by_limit = stop
        cut = F.when(F.col("record_number") == record, F.slice("fields", 1, upto)).otherwise(F.col("fields"))
        all_rows = measured(all_rows.where(F.col("record_number") <= record).withColumn("fields", cut))
        first = counters(all_rows).first()
        result.terminated = True
        result.termination_code = "FAIL_FAST_DATA_ERROR" if options.policy == "FAIL_FAST" else "MAX_ERRORS_REACHED"
    for name in ("rows_processed", "rows_valid", "rows_with_warnings", "cells", "non_empty_cells", "characters", "transformations", "validations", "total_errors", "total_warnings"):
        setattr(result, name, first[name])
    if options.policy == "SKIP_ROW":
        result.rows_skipped = first.rows_bad
    else:
        result.rows_invalid = first.rows_bad
    result.manual_review = first.rows_bad + first.rows_with_warnings
    if first.total_errors or first.total_warnings:
        found = issues(all_rows, plan)
        order = ["record_number", "field", "kind", "at"]
        seen = F.min(F.struct(*order)).alias("seen")
        by = found.groupBy("kind", "target", "code").agg(F.count("*").alias("n"), seen).collect()
        result.errors_by_code = _bounded(((r.code, r.n, r.seen) for r in by if r.kind == 1), options.max_codes)
        result.warnings_by_code = _bounded(((r.code, r.n, r.seen) for r in by if r.kind == 0), options.max_codes)
        result.errors_by_field = _bounded(((r.target, r.n, r.seen) for r in by if r.kind == 1), options.max_codes)
        for r in found.orderBy(*order).limit(options.max_samples).collect():
            result.samples.append({"record": r.record_number, "line": r.physical_line, "source": r.source, "target": r.target, "transformer": r.transformer, "validator": r.validator, "code": r.code, "reason": reason(r.code), "value": redacted(r.length)})
    return result


def _bounded(found, cap: int) -> dict[str, int]:
    """Counts by key of the keys that were seen first."""
    total, first = Counter(), {}
    for key, n, seen in found:
        total[key] += n
        first[key] = min(first.get(key, seen), seen)
    return {k: total[k] for k in sorted(total, key=lambda k: first[k])[:cap]}
