"""The labelled tables end to end: profiles, suggestions and the published aggregate quality."""

import pytest
from corpora import ALL, as_csv, clientes, financeiro, pedidos

from schemaweave.facade import Engine, to_json
from schemaweave.operators import evaluate


@pytest.fixture(scope="module")
def analyses(spark):
    engine, out = Engine(spark), {}
    for make in ALL:
        headers, rows, schema, labels = make()
        source = engine.source(as_csv(headers, rows), f"{make.__name__}.csv")
        out[make.__name__] = (engine.analyze(source, schema), labels)
    return out


def _profile(analysis, column):
    return next(p for p in analysis.profiles if p.column.id == column)


def test_profile_facts_of_customers(analyses):
    a, _ = analyses["clientes"]
    document = _profile(a, "c1")
    assert (document.dominant, round(document.valid_ratio, 9)) == ("br:cpf", 0.95)
    invalid = next(x for x in document.anomalies if x.code == "SEMANTIC_INVALID")
    assert invalid.count == 1 and invalid.locations == ((21, 21, "<redacted:length=7>"),)
    assert _profile(a, "c4").inferred == "TEXT"
    assert _profile(a, "c3").dominant == ""


def test_mixed_contact_is_no_match(analyses):
    a, _ = analyses["financeiro"]
    assert a.scored.decisions["c4"].status == "NO_MATCH"
    assert _profile(a, "c4").evidence["br:phone"].validity == 0.5
    a, _ = analyses["pedidos"]
    assert a.scored.decisions["c5"].status == "NO_MATCH" and _profile(a, "c5").dominant == ""


def test_aggregate_quality(spark, analyses):
    labels, found = [], []
    for name, (a, expected) in analyses.items():
        for k, (target, semantic, abstain) in enumerate(expected):
            c = f"c{k}"
            labels.append((name, c, target, semantic, abstain))
            d, cands = a.scored.decisions[c], a.scored.candidates[c]
            found.append((name, c, [x.target for x in cands], d.target, d.score, d.margin, d.coverage, _profile(a, c).dominant, bool(cands and cands[0].eligible)))
    rows = evaluate.judged(
        spark.createDataFrame(labels, "dataset string, column_id string, expected string, expected_semantic string, abstain boolean"),
        spark.createDataFrame(found, "dataset string, column_id string, top array<string>, decided string, score double, margin double, coverage double, semantic string, eligible boolean"),
    )
    q = evaluate.quality(rows).first()
    assert (q.mappable, q.no_match, q.abstain) == (23, 5, 7)
    assert (q.top1, q.top3, q.no_match_right) == (22, 23, 5)
    assert evaluate.failures(rows).first().column_id == "c1"
    assert q.auto_precision in (None, 1.0) and q.abstained == 7


def test_nothing_raw_in_reports(analyses):
    for a, _ in analyses.values():
        text = to_json(a)
        assert "529.982" not in text and "Sintetico" not in text and "99999-" not in text


def test_same_input_same_report(spark, analyses):
    headers, rows, schema, _ = clientes()
    engine = Engine(spark)
    again = engine.analyze(engine.source(as_csv(headers, rows), "clientes.csv"), schema)
    assert to_json(again) == to_json(analyses["clientes"][0])
    assert financeiro()[2].fingerprint != pedidos()[2].fingerprint
