"""Layouts, feedback, the facade and the command line."""

import json

import pytest
from corpora import as_csv, clientes

from schemaweave import cli
from schemaweave.facade import Engine, failure
from schemaweave.functions.headers import PT_BR, HeaderNormalizer
from schemaweave.model import EngineConfig, EngineError, IncompatiblePlan, InvalidSchema, SourceColumn, TargetField, TargetSchema, schema_from_json
from schemaweave.operators import layout as lay
from schemaweave.operators import profile as prof
from schemaweave.operators.knowledge import Feedback, JsonLinesKnowledgeBase, KnowledgeBase, snapshot
from schemaweave.plans import plan as p
from schemaweave.sources.base import from_bytes

HEADERS = ["Produto", "Quantidade", "Valor Unitario", "Comentario", "Cor da Linha"]
ROW = ["Produto A", "10", '"25,00"', "interno", "azul"]
SCHEMA = TargetSchema("orders", "1", [
    TargetField("product.name", "Produto", ["Item"], required=True), TargetField("order.quantity", "Quantidade", physical_type="INTEGER"), TargetField("order.unitPrice", "Valor Unitario", physical_type="DECIMAL"),
    TargetField("order.total", "Total", physical_type="DECIMAL"), TargetField("order.status", "Status"),
], locale="pt-BR")
SELECTIONS = {"product.name": "c0", "order.quantity": "c1", "order.unitPrice": "c2", "order.total": p.derived("MULTIPLY", p.column("c1"), p.column("c2")), "order.status": p.constant("NOVO")}


def csv_of(headers=HEADERS, row=ROW, n=3):
    return as_csv(headers, [row] * n)


@pytest.fixture(scope="module")
def confirmed(spark):
    engine = Engine(spark)
    source = from_bytes(csv_of(), "orders.csv")
    analysis = engine.analyze(source, SCHEMA)
    plan = engine.plan(analysis, SCHEMA, SELECTIONS, ("c3", "c4"))
    engine.registry.register(engine.create_layout_template(source, plan, "orders"))
    return engine, source, plan


def test_plan_runs_and_is_bound_to_its_source(confirmed):
    engine, source, plan = confirmed
    result = engine.process(source, SCHEMA, plan=plan)
    assert (result.status, result.route, result.dry_run.rows_valid, result.dry_run.fields_mapped) == ("SUCCESS", "CONFIRMED_PLAN", 3, 5)
    with pytest.raises(IncompatiblePlan, match="INVALIDATE_PLAN"):
        engine.dry_run(from_bytes(csv_of(n=4), "orders.csv"), plan, SCHEMA)
    with pytest.raises(IncompatiblePlan, match="REQUIRE_REANALYSIS"):
        engine.dry_run(source, plan, SCHEMA, {"header": "first"})
    partial = p.sealed(p.Plan(**{**plan.__dict__, "bindings": plan.bindings[1:]}))
    with pytest.raises(IncompatiblePlan, match="INCOMPLETE_PLAN"):
        engine.dry_run(source, p.sealed(p.Plan(**{**partial.__dict__, "bindings": tuple(b for b in plan.bindings if b.target != "product.name")})), SCHEMA)


def recognized(engine, headers, row=ROW, schema=SCHEMA, name="next.csv"):
    return engine.recognize_layout(from_bytes(csv_of(headers, row), name), schema)


def kinds(r):
    return {k for k, _, _ in r.drift}


def test_known_layouts(confirmed):
    engine, _, _ = confirmed
    same = recognized(engine, HEADERS)
    assert (same.route, same.classification, same.candidate_pairs, same.inference_skipped) == (lay.FAST, "EXACT", 0, True)
    result = engine.process(from_bytes(csv_of(), "later.csv"), SCHEMA)
    assert (result.status, result.route, result.dry_run.rows_valid) == ("SUCCESS", lay.FAST, 3)
    order = [1, 0, 2, 3, 4]
    moved = recognized(engine, [HEADERS[k] for k in order], [ROW[k] for k in order])
    assert (moved.route, moved.classification) == (lay.FAST, "COMPATIBLE")
    assert {b.target: b.projection.column for b in moved.plan.bindings if b.projection.column}["product.name"] == "c1"


def test_drifted_layouts(confirmed):
    engine, _, _ = confirmed
    renamed = recognized(engine, ["Item", *HEADERS[1:]])
    assert (renamed.route, renamed.candidate_pairs, renamed.affected) == (lay.ADAPTIVE, 1, ("product.name",))
    more = recognized(engine, [*HEADERS, "Extra"], [*ROW, "x"])
    assert (more.route, more.plan.unmapped) == (lay.ADAPTIVE, ("c5",))
    missing = recognized(engine, HEADERS[1:], ROW[1:])
    assert missing.route == lay.FULL and "REQUIRED_SOURCE_MISSING" in kinds(missing) and missing.plan is None
    retyped = recognized(engine, HEADERS, ["Produto A", "muitos", *ROW[2:]])
    assert retyped.route == lay.FULL and "TYPE_DRIFT" in kinds(retyped)
    twice = recognized(engine, [*HEADERS, "Produto"], [*ROW, "x"])
    assert twice.route == lay.FULL
    ignored = recognized(engine, [*HEADERS[:4], "Outra"])
    assert kinds(ignored) == {"REMOVED_COLUMN", "ADDED_COLUMN"} and ignored.route == lay.ADAPTIVE and "c4" in ignored.plan.ignored
    schema2 = TargetSchema("orders", "2", SCHEMA.fields, locale="pt-BR")
    assert "TARGET_SCHEMA_CHANGED" in kinds(recognized(engine, HEADERS, schema=schema2))
    other = recognized(engine, ["a", "b"], ["x", "y"], TargetSchema("else", "1", [TargetField("z", "Z")]))
    assert (other.route, other.classification) == (lay.FULL, "UNKNOWN")


def test_ambiguous_duplicate_headers(spark, confirmed):
    _, _, plan = confirmed
    normalizer = HeaderNormalizer()

    def signed(headers):
        seen, columns = {}, []
        for k, h in enumerate(headers):
            columns.append(lay.SignatureColumn(f"c{k}", k, h, seen.get(h, 0), "TEXT", "", 5))
            seen[h] = seen.get(h, 0) + 1
        return lay.Signature(tuple(columns), "csv", "UTF-8", ",", True, (), "n")

    bindings = (p.Binding("product.name", p.column("c0")), p.Binding("order.status", p.column("c1")))
    template = lay.Template("t", "1", "orders", "1", SCHEMA.fingerprint, "f", signed(["a", "a", "b"]), bindings, ("c2",))
    check = lambda headers: lay.assess(spark, template, signed(headers), SCHEMA, "f", normalizer)
    assert check(["a", "a", "b"]).route == lay.FAST
    moved = check(["b", "a", "a"])
    assert moved.route == lay.FULL and "DUPLICATE_HEADER" in kinds(moved)
    more = check(["a", "a", "b", "b"])
    assert more.route == lay.FULL and "DUPLICATE_HEADER" in kinds(more)


def test_registry_and_templates(confirmed):
    engine, source, plan = confirmed
    t = engine.registry.get("orders", "1")
    engine.registry.register(t)
    with pytest.raises(EngineError, match="TEMPLATE_CONFLICT"):
        engine.registry.register(lay.Template(**{**t.__dict__, "ignored": ()}))
    assert cli.template_from_json(json.loads(json.dumps(cli.template_json(t)))) == t
    both = lay.CompositeRegistry(lay.Registry(), engine.registry)
    assert both.get("orders", "1") == t and len(both.candidates(SCHEMA.fingerprint, t.layout)) == 1
    loose = p.sealed(p.Plan(**{**plan.__dict__, "unmapped": ("c4",)}))
    with pytest.raises(IncompatiblePlan, match="TEMPLATE_INCOMPLETE"):
        engine.create_layout_template(source, loose, "x")


def test_observer(spark, confirmed):
    _, source, plan = confirmed
    seen = []
    Engine(spark, observer=seen.append).process(source, SCHEMA, plan=plan)
    assert [e.kind for e in seen] == ["STARTED", "ROUTE_SELECTED", "COMPLETED"] and seen[-1].status == "SUCCESS"
    with pytest.raises(EngineError, match="OBSERVER_FAILED"):
        Engine(spark, observer=lambda e: 1 / 0).process(source, SCHEMA, plan=plan)
    with pytest.raises(EngineError, match="INVALID_REQUEST"):
        Engine(spark).process(source, SCHEMA, plan=plan, analyze_only=True)


def event(k, kind="REJECTED", suggested="customer.email", human="", schema=None, **over):
    base = dict(feedback_id=f"f{k}", timestamp="2026-01-01T00:00:00Z", type=kind, source_column="c0", position=0, header_length=7, tokens=1, source_name="contato", schema_id=schema.id, schema_version="1", schema_fingerprint=schema.fingerprint, locale="pt-BR", context="customer-contact", suggested=suggested, human=human)
    return Feedback(**{**base, **over})


CONTACT = TargetSchema("feedback-contact", "1", [TargetField("customer.email", "Email", semantic_types=["core:email"]), TargetField("customer.phone", "Telefone", ["Contato"], semantic_types=["br:phone"])], "customer-contact", "pt-BR")


def test_published_effect_of_feedback(spark):
    def email(base):
        engine = Engine(spark, knowledge=base)
        found = engine.analyze(from_bytes(b"Contato\ncanal-x\ncanal-y\n", "contact.csv"), CONTACT, {"header": "first", "delimiter": ","})
        return next(c.score for c in found.scored.candidates["c0"] if c.target == "customer.email")

    base = KnowledgeBase()
    assert email(base) == pytest.approx(0.138076, abs=1e-6)
    for k in range(8):
        base.record(event(k, schema=CONTACT))
    assert email(base) == pytest.approx(0.112683, abs=1e-6)


def test_feedback_store(spark, tmp_path):
    path = str(tmp_path / "events.jsonl")
    base = JsonLinesKnowledgeBase(path)
    assert base.id == "NO_KNOWLEDGE"
    one, two = event(1, schema=CONTACT), event(2, "CORRECTED", human="customer.phone", schema=CONTACT)
    for e in (one, two, one):
        base.record(e)
    with pytest.raises(EngineError, match="FEEDBACK_CONFLICT"):
        base.record(event(1, "CONFIRMED", "", "customer.phone", schema=CONTACT))
    again, other = JsonLinesKnowledgeBase(path), KnowledgeBase()
    for e in (two, one):
        other.record(e)
    assert again.id == base.id == other.id and len(again.events) == 2
    got = {r.target: r for r in snapshot(again.frame(spark)).collect()}
    assert (got["customer.email"].rejected, got["customer.email"].corrected_from, got["customer.phone"].corrected_to) == (1, 1, 1)
    with open(path, "a") as f:
        f.write("{")
    with pytest.raises(EngineError, match="FEEDBACK_FILE_INVALID"):
        JsonLinesKnowledgeBase(path)
    for bad in ({"timestamp": "yesterday"}, {"human": "x"}, {"previous_score": 2.0}, {"position": -1}):
        with pytest.raises(EngineError, match="INVALID_FEEDBACK"):
            event(9, schema=CONTACT, **bad)


def test_profiler_numbers(spark):
    rows = [(k, k, "on" if k % 2 else "off", "" if k == 20 else "x" if k == 19 else str(k), "broken" if k == 20 else f"u{k}@example.test") for k in range(1, 21)]
    frame = spark.createDataFrame(rows, "record_number long, physical_line long, c0 string, c1 string, c2 string")
    from schemaweave.functions.detectors import CORE

    columns = tuple(SourceColumn(f"c{k}", k, h, h) for k, h in enumerate(("status", "quantity", "email")))
    status, quantity, email = prof.profile(frame, columns, CORE, EngineConfig())
    assert status.entropy == pytest.approx(1.0) and status.distinct == 2 and status.top[0][2] == 10
    assert quantity.numeric["mean"] == pytest.approx(9.5) and quantity.numeric["variance"] == pytest.approx((18**2 - 1) / 12)
    codes = {a.code: a for a in quantity.anomalies}
    assert codes["NULL_PRESENT"].locations == ((20, 20, "<redacted:length=0>"),) and codes["PHYSICAL_TYPE_OUTLIER"].count == 1
    assert email.valid_ratio == 0.95 and {a.code for a in email.anomalies} >= {"RARE_FORMAT", "SEMANTIC_INVALID"}
    capped = prof.profile(frame, columns, CORE, EngineConfig(exact_cap=3, top_k=2))
    assert capped[2].distinct_accuracy == capped[2].entropy_accuracy == "ESTIMATED" and abs(capped[2].distinct - 20) <= 2


def test_pruning(spark):
    fields = [TargetField(x, f"{x} unrelated") for x in "abcd"] + [TargetField("exact", "Nome Completo")]
    headers, rows, _, _ = clientes()
    found = Engine(spark, EngineConfig(pruning_threshold=3, shortlist=1)).analyze(from_bytes(as_csv(headers[:2], [r[:2] for r in rows]), "a.csv"), TargetSchema("s", "1", fields))
    assert found.scored.candidates["c0"][0].target == "exact" and len(found.scored.pruned["c0"]) == 4


def test_configuration_and_schema_checks():
    for bad in ({"weights": {"odd": 1.0}}, {"min_margin": 2.0}, {"low_threshold": 0.95}, {"lexical_strategy": "x"}):
        with pytest.raises(EngineError, match="INVALID_CONFIG"):
            EngineConfig(**bad)
    with pytest.raises(InvalidSchema):
        TargetSchema("s", "1", [TargetField("a", "A"), TargetField("a", "B")])
    with pytest.raises(InvalidSchema):
        TargetField("a", "A", semantic_types=["Bad Type"])
    good = {"formatVersion": "1.0", "schemaId": "s", "schemaVersion": "1", "fields": [{"id": "a", "displayName": "A", "physicalType": "DATE"}]}
    assert schema_from_json(json.dumps(good)).fields[0].physical_type == "DATE"
    for change in ({"formatVersion": "2.0"}, {"extra": 1}, {"fields": [{"id": "a"}]}):
        with pytest.raises(InvalidSchema):
            schema_from_json(json.dumps({**good, **change}))
    assert failure(EngineError("PLAN_STRUCTURE_MISMATCH")) is IncompatiblePlan
    assert HeaderNormalizer(PT_BR)("cel").comparable == "celular"


def test_command_line(spark, tmp_path, capsys):
    engine = Engine(spark)
    path = lambda n: str(tmp_path / n)
    (tmp_path / "a.csv").write_bytes(csv_of())
    fields = [{"id": f.id, "displayName": f.display_name, "aliases": list(f.aliases), "physicalType": f.physical_type, "required": f.required} for f in SCHEMA.fields]
    (tmp_path / "s.json").write_text(json.dumps({"formatVersion": "1.0", "schemaId": "orders", "schemaVersion": "1", "locale": "pt-BR", "fields": fields}))
    run = lambda *a: cli.main([*a], engine)
    base = ["--input", path("a.csv"), "--schema", path("s.json")]
    assert run("analyze", *base, "--output", path("r.json")) == 0
    assert "Produto A" not in (tmp_path / "r.json").read_text()
    assert run("explain", "--report", path("r.json"), "--header", "Produto") == 0
    assert json.loads(capsys.readouterr().out)["candidates"][0]["target"] == "product.name"
    assert run("plan", *base, "--map", "product.name=c0", "--map", "order.quantity=c1", "--ignore", "c2", "--ignore", "c3", "--ignore", "c4", "--output", path("p.json")) == 0
    assert run("dry-run", *base, "--plan", path("p.json"), "--output", path("d.json")) == 0
    assert json.loads((tmp_path / "d.json").read_text())["rows_valid"] == 3
    assert run("template", "create", "--input", path("a.csv"), "--plan", path("p.json"), "--id", "t", "--output", path("t.json")) == 0
    assert run("recognize", *base, "--template", path("t.json"), "--output", path("g.json")) == 0
    assert json.loads((tmp_path / "g.json").read_text())["route"] == lay.FAST
    assert run("feedback", "confirm", *base, "--knowledge", path("k.jsonl"), "--column", "c0", "--human", "product.name") == 0
    assert len(JsonLinesKnowledgeBase(path("k.jsonl")).events) == 1
    assert run("explain-plan", "--plan", path("p.json")) == 0 and "product.name <- c0" in capsys.readouterr().out
    assert run("analyze", *base, "--output", path("a.csv")) == cli.REFUSED
    assert run("analyze", "--input", path("none.csv"), "--schema", path("s.json")) == cli.REFUSED
    assert run("nothing") == cli.USAGE
    report = json.loads((tmp_path / "r.json").read_text())
    report["structure"]["columns"][1]["header"] = "Produto"
    (tmp_path / "r2.json").write_text(json.dumps(report))
    assert run("explain", "--report", path("r2.json"), "--header", "Produto") == cli.AMBIGUOUS
    assert run("explain", "--report", path("r2.json"), "--column", "c1") == 0


def test_stream_guard(spark, tmp_path):
    from schemaweave.functions.detectors import CORE
    from schemaweave.streaming.guard import guard_stream

    spark.createDataFrame([(k, f"v{k}") for k in range(10)], "record_number long, c0 string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("record_number long, c0 string").parquet(str(tmp_path / "in"))
    seen = []
    guard_stream(stream, (SourceColumn("c0", 0, "A", "a"),), CORE, EngineConfig(sample_size=0), lambda n, ps: seen.append(ps[0].rows), str(tmp_path / "check")).awaitTermination()
    assert sum(seen) == 10
