"""Steps, plans, dry runs and their stops."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from schemaweave.model import EngineError, IncompatiblePlan, TargetField, TargetSchema
from schemaweave.operators import dryrun as dry
from schemaweave.plans import plan as p
from schemaweave.plans import steps
from schemaweave.plans.plan import Step


def run_step(spark, id_, values, locale="", **options):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    o = steps.TRANSFORMERS[id_][0](F.col("v"), Step.of(id_, **options), locale)
    return [(r.value, r.code) for r in frame.select("k", o.value.alias("value"), o.code.alias("code")).orderBy("k").collect()]


def test_transformers(spark):
    assert run_step(spark, "core:string-normalize", ["  A  b ", "x"], case="lower") == [("a b", "STRING_NORMALIZED"), ("x", None)]
    assert run_step(spark, "core:string-normalize", ["x"], case="odd")[0][1] == "INVALID_TRANSFORMER_OPTION"
    assert run_step(spark, "core:integer", [" 12 ", "007", "2147483648", "1.5"]) == [("12", None), (None, "IDENTIFIER_LIKE_NUMBER"), (None, "INVALID_INTEGER"), (None, "INVALID_INTEGER")]
    assert run_step(spark, "core:long", ["007", "2147483648"], allowLeadingZeros="true") == [("7", None), ("2147483648", None)]
    assert run_step(spark, "core:big-decimal", ["1.234,56", "1,2,3", "10"], locale="pt-BR") == [("1234.56", None), (None, "INVALID_DECIMAL"), ("10", None)]
    assert run_step(spark, "core:big-decimal", ["1,5", "10"]) == [(None, "AMBIGUOUS_DECIMAL"), ("10", None)]
    assert run_step(spark, "core:big-decimal", ["1"], locale="fr")[0][1] == "UNSUPPORTED_LOCALE"
    assert run_step(spark, "core:local-date", ["2026-02-28", "2026-02-30", "01/02/2026"]) == [("2026-02-28", None), (None, "INVALID_DATE"), (None, "AMBIGUOUS_DATE")]
    assert run_step(spark, "core:local-date", ["01/02/2026", "02/02/2026", "31/12/2026"], formats="dd/MM/uuuu|MM/dd/uuuu|bad") == [(None, "AMBIGUOUS_DATE"), ("2026-02-02", None), ("2026-12-31", None)]
    assert [c for _, c in run_step(spark, "core:boolean", ["Sim", "não", "yes"], locale="pt-BR")] == [None, None, "INVALID_BOOLEAN"]
    assert run_step(spark, "br:cpf-canonical", ["529.982.247-25", "529/982"]) == [("52998224725", None), (None, "INVALID_CPF_FORMAT")]
    assert run_step(spark, "br:cep-canonical", ["01310-100", "0131"]) == [("01310100", None), (None, "INVALID_CEP_FORMAT")]
    assert run_step(spark, "br:phone-canonical", ["+55 (11) 99999-0001", "+44 11 99999 0001", "123"]) == [("11999990001", None), (None, "INVALID_PHONE_FORMAT"), (None, "INVALID_PHONE_FORMAT")]


def test_checksum_of_a_short_value_is_a_row_error(spark):
    frame = spark.createDataFrame([("123",)], "v string")
    assert frame.select(steps.cpf_checksum(F.col("v"), F.col("v"), Step.of("br:cpf-checksum")).alias("c")).first().c == "INVALID_CPF_CHECKSUM"


def test_projections_are_checked():
    for bad in (lambda: p.constant("a\nb"), lambda: p.derived("DIVIDE", p.column("c0")), lambda: p.derived("ADD", p.derived("ADD", p.column("c0"))), lambda: p.derived("POWER", p.column("c0"), p.column("c1")), lambda: p.derived("CONCAT", *[p.column("c0")] * 33)):
        with pytest.raises(IncompatiblePlan):
            bad()
    with pytest.raises(EngineError, match="UNMAPPED_TARGET"):
        steps.project(p.UNMAPPED, "")


def test_unknown_steps_are_refused():
    with pytest.raises(EngineError, match="UNKNOWN_TRANSFORMER"):
        steps.check_steps((Step.of("core:none"),), (), "TEXT")
    with pytest.raises(EngineError, match="TRANSFORMER_TYPE_MISMATCH"):
        steps.check_steps((Step.of("core:long"), Step.of("core:boolean")), (), "TEXT")
    with pytest.raises(EngineError, match="UNKNOWN_VALIDATOR"):
        steps.check_steps((), (Step("core:required", "2"),), "TEXT")


SCHEMA = TargetSchema("s", "1", [TargetField("name", "Name", required=True), TargetField("quantity", "Quantity", physical_type="INTEGER", required=True)])


def plan_of(schema, columns):
    bindings = [p.Binding(f.id, p.column(c), ((Step.of("core:string-normalize"),) if f.physical_type == "TEXT" else p.default_transformations(f, schema.locale)), p.default_validations(f)) for f, c in zip(schema.fields, columns, strict=True)]
    return p.sealed(p.Plan("", "x", "", schema.id, "1", "", "", tuple(bindings)))


def frame_of(spark, rows):
    return spark.createDataFrame([(k + 2, k + 2, *r) for k, r in enumerate(rows)], "record_number long, physical_line long, c0 string, c1 string")


def test_counters(spark):
    r = dry.dry_run(frame_of(spark, [("Ana", "1"), ("", "x")]), plan_of(SCHEMA, ["c0", "c1"]), SCHEMA, ["c0", "c1"])
    assert (r.cells, r.non_empty_cells, r.transformations, r.validations, r.total_errors, r.rows_valid, r.rows_invalid) == (4, 3, 3, 3, 2, 1, 1)
    assert r.errors_by_code == {"REQUIRED_VALUE_MISSING": 1, "INVALID_LONG": 1} and r.errors_by_field == {"name": 1, "quantity": 1}
    assert [s["value"] for s in r.samples] == ["<redacted:length=0>", "<redacted:length=1>"] and not r.terminated


@pytest.mark.parametrize(
    ("options", "rows", "skipped", "errors", "code"),
    [
        (dry.DryRunOptions(max_errors=1), 1, 0, 1, "MAX_ERRORS_REACHED"), (dry.DryRunOptions("SKIP_ROW"), 2, 2, 4, ""), (dry.DryRunOptions("FAIL_FAST"), 1, 0, 2, "FAIL_FAST_DATA_ERROR"),
        (dry.DryRunOptions("FAIL_FAST", max_errors=1), 1, 0, 1, "FAIL_FAST_DATA_ERROR"), (dry.DryRunOptions(max_errors=3), 2, 0, 3, "MAX_ERRORS_REACHED"),
    ],
)
def test_stops(spark, options, rows, skipped, errors, code):
    r = dry.dry_run(frame_of(spark, [("", " "), ("", "")]), plan_of(SCHEMA, ["c0", "c1"]), SCHEMA, ["c0", "c1"], options)
    assert (r.rows_processed, r.rows_skipped, r.total_errors, r.termination_code) == (rows, skipped, errors, code)


def test_bounded_code_maps(spark):
    r = dry.dry_run(frame_of(spark, [("", "x"), ("", "007")]), plan_of(SCHEMA, ["c0", "c1"]), SCHEMA, ["c0", "c1"], dry.DryRunOptions(max_codes=2))
    assert r.errors_by_code == {"REQUIRED_VALUE_MISSING": 2, "INVALID_LONG": 1} and r.total_errors == 4


def test_order_of_bindings_and_identity():
    fields = [TargetField(f"t{k}", "x") for k in range(3)]
    schema = TargetSchema("s", "1", fields)
    a = plan_of(schema, ["c10", "c2", "c1"])
    assert [b.projection.column for b in a.bindings] == ["c10", "c1", "c2"]
    b = p.configure(a, "t0", validations=[Step.of("core:required")])
    assert b.plan_id != a.plan_id and p.configure(b, "t0", validations=[]).plan_id == a.plan_id


def test_derived_values_run_through_the_steps(spark):
    schema = TargetSchema("s", "1", [TargetField("total", "Total", physical_type="DECIMAL"), TargetField("label", "Label")], locale="en-US")
    bindings = (p.Binding("total", p.derived("DIVIDE", p.column("c0"), p.column("c1")), p.default_transformations(schema.fields[0], "en-US"), (Step.of("core:numeric-range", max="3"),)), p.Binding("label", p.derived("CONCAT", p.column("c0"), p.constant("-"))))
    plan = p.sealed(p.Plan("", "x", "", "s", "1", "", "", bindings))
    r = dry.dry_run(frame_of(spark, [("10", "4"), ("1", "0"), ("9", "2"), ("x", "1")]), plan, schema, ["c0", "c1"])
    assert r.errors_by_code == {"DERIVED_DIVISION_BY_ZERO": 1, "NUMERIC_OUT_OF_RANGE": 1, "DERIVED_INVALID_NUMBER": 1}
    assert r.transformations == 4 * 2 + 2 and r.fields_mapped == 2


def test_missing_columns_are_refused(spark):
    with pytest.raises(EngineError, match="PLAN_STRUCTURE_MISMATCH"):
        dry.dry_run(frame_of(spark, []), plan_of(SCHEMA, ["c0", "c9"]), SCHEMA, ["c0", "c1"])


def shown(spark, values, *columns):
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    return {r[0]: tuple(r[1:]) for r in frame.select("v", *[c.alias(f"x{k}") for k, c in enumerate(columns)]).collect()}


def test_numbers_of_any_size(spark):
    v = F.col("v")
    plain = steps.big_decimal(v, Step.of("core:big-decimal"), "")
    long = "9" * 41
    got = shown(spark, ["1E-5", "15E-1", "1E5", "-12e-3", "12E-9", "1e99999999999", long, "1,5"], plain.value, plain.code)
    assert [got[x][0] for x in ("1E-5", "15E-1", "1E5", "-12e-3", "12E-9", long)] == ["0.00001", "1.5", "1E+5", "-0.012", "1.2E-8", long]
    assert got["1e99999999999"] == (None, "INVALID_DECIMAL") and got["1,5"] == (None, "AMBIGUOUS_DECIMAL")
    values = ["1.0000000000004", "1", "0.99999999999999999", "123456789012345678901234567890", "-5", "1e400", ".5", "5.", "-1e-3", "-0.0010", "-0.00100001", "0", "-0e7", "1e-400"]
    for low, high in ((None, "1"), ("-1e-3", "5"), ("0", None), ("-1E400", "1.00000000000039"), ("0.5", "0.5")):
        given = {k: x for k, x in (("min", low), ("max", high)) if x is not None}
        got = shown(spark, values, steps.numeric_range(v, v, Step.of("core:numeric-range", **given)))
        for x in values:
            out = low is not None and Decimal(x) < Decimal(low) or high is not None and Decimal(x) > Decimal(high)
            assert got[x] == ("NUMERIC_OUT_OF_RANGE" if out else None,), (x, low, high)
    assert shown(spark, ["", "abc"], steps.numeric_range(v, v, Step.of("core:numeric-range", max="1"))) == {"": ("INVALID_NUMERIC_VALUE",), "abc": ("INVALID_NUMERIC_VALUE",)}


def test_patterns_are_those_of_the_machine_that_runs_them(spark):
    v = F.col("v")
    check = lambda pattern: shown(spark, ["a"], steps.regex(v, v, Step.of("core:regex", pattern=pattern)))["a"][0]
    assert check("(?P<x>a)") == "INVALID_VALIDATOR_OPTION" and check("(?<x>a)") is None and check(r"\p{javaUpperCase}") == "REGEX_MISMATCH"


def test_date_patterns(spark):
    v = F.col("v")
    date = lambda pattern: (lambda o: F.coalesce(o.value, o.code))(steps.local_date(v, Step.of("core:local-date", formats=pattern), ""))
    values = ["5/1/2026", "05/01/2026", "31/2/2026", "5 de 1 de 2026", "26-1-5"]
    got = shown(spark, values, date("d/M/uuuu"), date("dd/MM/uuuu"), date("d 'de' M 'de' uuuu"), date("uu-M-d"), date("QQQ"))
    assert got["5/1/2026"] == ("2026-01-05", "INVALID_DATE", "INVALID_DATE", "INVALID_DATE", "INVALID_DATE")
    assert got["05/01/2026"][:2] == ("2026-01-05", "2026-01-05") and got["31/2/2026"][0] == "INVALID_DATE"
    assert got["5 de 1 de 2026"][2] == "2026-01-05" and got["26-1-5"][3] == "2026-01-05"
