"""Text predicates, similarities, detectors, sketches and exact decimals."""

import random

import pytest
from pyspark.sql import functions as F

from schemaweave import catalog
from schemaweave.functions import decimals, detectors, sketches
from schemaweave.functions import similarity as sim
from schemaweave.functions import text as t
from schemaweave.functions.headers import PT_BR, HeaderNormalizer


def column(spark, values, *exprs):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [tuple(r)[1:] for r in frame.select("k", *exprs).orderBy("k").collect()]


def test_blank_strip_and_length(spark):
    values = [None, "", " \t 　", " ", " x", " a ", "a😀b", "\x1fa\x1c"]
    got = column(spark, values, t.blank(F.col("v")), t.strip(t.cell(F.col("v"))), t.utf16_length(t.cell(F.col("v"))))
    assert [g[0] for g in got] == [True, True, True, False, False, False, False, False]
    assert [g[1] for g in got][3:] == [" ", " x", "a", "a😀b", "a"]
    assert got[6][2] == 4


def test_physical_types_and_patterns(spark):
    table = {
        "TRUE": ("BOOLEAN", "ALPHANUMERIC"), "NÃO": ("BOOLEAN", "ALPHANUMERIC"), "12": ("INTEGER", "INTEGER_LIKE"), "-0": ("INTEGER", "INTEGER_LIKE"), "007": ("TEXT", "INTEGER_LIKE"), "1,5": ("DECIMAL", "DECIMAL_LIKE"),
        "99/99/9999": ("DATE", "DATE_LIKE"), "2026-01-01\n": ("TEXT", "OTHER"), "a@b": ("TEXT", "EMAIL_LIKE"), "x y": ("TEXT", "TEXT_WORDS"), "é-1_": ("TEXT", "ALPHANUMERIC"), "a;b": ("TEXT", "OTHER"),
    }
    assert column(spark, table, t.physical_type(F.col("v")), t.pattern_class(F.col("v"))) == list(table.values())


def test_length_buckets_and_numbers(spark):
    got = column(spark, ["a" * n for n in (1, 4, 5, 12, 13, 40, 80, 81)], t.length_bucket(F.length("v")))
    assert [g[0] for g in got] == ["1-4", "1-4", "5-8", "9-12", "13-20", "21-40", "41-80", "81+"]
    assert column(spark, ["1,5", "-3", "x", "1e999"], t.number(F.col("v"))) == [(1.5,), (-3.0,), (None,), (None,)]


def test_headers():
    n = HeaderNormalizer(PT_BR)
    assert n("dtNasc").comparable == "data nascimento" and n("dtNasc").compact == "datanascimento"
    assert n("  Endereço_Residencial2 ").tokens == ("endereco", "residencial", "2")
    assert HeaderNormalizer()("Cod. Cli").comparable == "cod cli" and n("Cod. Cli").comparable == "codigo cliente"
    assert n(None).compact == "" and n.fingerprint != HeaderNormalizer().fingerprint


def both(spark, pairs):
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    a, b = F.col("a"), F.col("b")
    metrics = [sim.dice, sim.jaccard, sim.levenshtein, sim.jaro, sim.jaro_winkler, sim.trigram_dice, sim.trigram_cosine]
    return [tuple(r)[1:] for r in frame.select("k", *[m(a, b) for m in metrics]).orderBy("k").collect()]


def test_published_similarities(spark):
    got = both(spark, [("a b", "b c"), ("kitten", "sitting"), ("MARTHA", "MARHTA"), ("", ""), ("a", ""), ("same", "same")])
    assert got[0][0] == 0.5 and got[0][1] == pytest.approx(1 / 3)
    assert got[1][2] == pytest.approx(4 / 7)
    assert got[2][3] == pytest.approx(0.944444, abs=1e-6) and got[2][4] == pytest.approx(0.961111, abs=1e-6)
    assert got[3] == (1.0,) * 7 and got[4] == (0.0,) * 7 and got[5] == pytest.approx((1.0,) * 7)


def test_similarities_are_symmetric_and_bounded(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 23)))
    pairs = [(word(), word()) for _ in range(400)]
    one, two = both(spark, pairs), both(spark, [(b, a) for a, b in pairs])
    for x, y in zip(one, two, strict=True):
        assert all(0 <= v <= 1 for v in x) and x == pytest.approx(y)


def test_detectors(spark):
    def checked(d, values):
        return [tuple(int(x) for x in r) for r in column(spark, values, d.shape(F.col("v")), d.valid(F.col("v")), d.ambiguous(F.col("v")))]

    assert checked(detectors.EMAIL, ["a@b.co", "a@b", "a b"]) == [(1, 1, 0), (1, 0, 0), (0, 0, 0)]
    assert checked(detectors.DATE, ["2026-02-30", "2026-02-28", "01/02/2026", "02/02/2026", "31/12/2026", "1/2/2026"]) == [(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 1, 0), (1, 1, 0), (0, 0, 0)]
    assert checked(detectors.CPF, ["52998224725", "529.982.247-25", "52998224724", "111.111.111-11", "5299822472"]) == [(1, 1, 0), (1, 1, 0), (1, 0, 0), (1, 0, 0), (0, 0, 0)]
    assert checked(detectors.PHONE, ["(11) 99999-0001", "11999990001", "(05) 3333-4444", "123"]) == [(1, 1, 0), (1, 1, 1), (1, 0, 0), (0, 0, 0)]


def test_sketch_is_close_and_mergeable(spark):
    frame = spark.range(100_000).select(F.lit("x").alias("g"), F.concat(F.lit("value-"), F.col("id").cast("string")).alias("v"))
    found = sketches.estimate(sketches.registers(frame, "v", "g"), "g").first().estimate
    assert abs(found - 100_000) < 10_000
    small = sketches.estimate(sketches.registers(frame.limit(7), "v", "g"), "g").first().estimate
    assert small == 7
    assert len(set(sketches.hash_units(["a", "b", "ab", "", "😀"]).tolist())) == 5


@pytest.mark.parametrize(
    ("operation", "values", "locale", "want"),
    [
        ("ADD", ["10", "25,00"], "pt-BR", ("35", None)), ("SUBTRACT", ["10", "25,00"], "pt-BR", ("-15", None)), ("MULTIPLY", ["10", "25,00"], "pt-BR", ("250", None)), ("DIVIDE", ["25,00", "10"], "pt-BR", ("2.5", None)),
        ("DIVIDE", ["1", "0,0"], "pt-BR", (None, "DERIVED_DIVISION_BY_ZERO")), ("ADD", ["1", "x"], "pt-BR", (None, "DERIVED_INVALID_NUMBER")), ("ADD", ["1,5", "1"], "", (None, "DERIVED_INVALID_NUMBER")),
        ("DIVIDE", ["1", "3"], "en-US", ("0." + "3" * 34, None)), ("ADD", ["9" * 40, "1"], "", ("1" + "0" * 40, None)), ("MULTIPLY", ["1.234.567,5", "2"], "pt-BR", ("2469135", None)), ("ADD", ["0.00", "0"], "en-US", ("0", None)),
    ],
)
def test_exact_decimals(operation, values, locale, want):
    assert decimals.fold(operation, values, locale) == want


def test_redaction_keeps_every_row(spark, tmp_path):
    values = [None, "", "plain", "a😀b", "😀" * 3, "ÀÉ"]
    spark.createDataFrame(list(enumerate(values)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in catalog.redaction(spark, str(tmp_path)).collect()}
    assert got == {k: f"<redacted:length={len((v or '').encode('utf-16-le')) // 2}>" for k, v in enumerate(values)}


def test_cardinality_estimates_are_near_the_exact_counts(spark):
    sf = "/root/testdata/sf0.01"
    exact = {r["column"]: r.n for r in catalog.mixed(spark, sf).where("NOT blank").groupBy("column").agg(F.count_distinct("raw").alias("n")).collect()}
    got = {r.column_name: r.estimate for r in catalog.cardinality_estimates(spark, sf).collect()}
    assert got.keys() == exact.keys() and max(exact.values()) > 1000
    # 4096 registers: a standard error of at most 1.04 / 64
    assert all(abs(got[c] - n) <= 4 * 1.04 / 64 * n for c, n in exact.items())
