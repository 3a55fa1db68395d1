"""Command line: analyze, explain, plan, dry-run, feedback, template, recognize, explain-plan.

Exit codes: 0 done, 2 wrong usage, 3 the engine refused, 4 an ambiguous request.
"""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from dataclasses import asdict
from datetime import datetime, timezone

from .facade import Analysis, Engine, to_json, write_json
from .model import EngineConfig, EngineError, schema_from_json
from .operators.dryrun import POLICIES, DryRunOptions
from .operators.knowledge import Feedback, JsonLinesKnowledgeBase, KnowledgeBase
from .operators.layout import Signature, SignatureColumn, Template
from .plans.plan import Plan, plan_from_json
from .session import build_session

USAGE, REFUSED, AMBIGUOUS = 2, 3, 4
REPORTS = ("1.0", "1.1", "1.2", "1.3")


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def template_json(t: Template) -> dict:
    return asdict(t)


def template_from_json(data: dict) -> Template:
    layout = data["layout"]
    columns = tuple(SignatureColumn(**c) for c in layout["columns"])
    signature = Signature(columns, layout["format"], layout["charset"], layout["delimiter"], layout["header_present"], tuple(tuple(x) for x in layout["attributes"]), layout["normalizer"])
    bindings = plan_from_json({"format": "1.2", "bindings": data["bindings"], **dict.fromkeys(("plan_id", "source_id", "source_fingerprint", "schema_id", "schema_version", "schema_fingerprint", "config_fingerprint", "engine_version"), "")}).bindings
    plain = {k: data[k] for k in ("id", "version", "schema_id", "schema_version", "schema_fingerprint", "config_fingerprint", "engine_version", "format")}
    return Template(layout=signature, bindings=bindings, ignored=tuple(data["ignored"]), **plain)


def _options(pairs: list[str]) -> dict[str, str]:
    out = {}
    for p in pairs or []:
        key, eq, value = p.partition("=")
        if not eq or key in out:
            raise EngineError("INVALID_READER_OPTION", "options are key=value, once each")
        out[key] = value
    return out


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="schemaweave")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *needs: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for n in needs:
            c.add_argument(f"--{n}", required=True)
        c.add_argument("--option", action="append", default=[])
        c.add_argument("--output")
        return c

    command("analyze", "input", "schema").add_argument("--knowledge")
    explain = command("explain", "report")
    explain.add_argument("--column")
    explain.add_argument("--header")
    plan = command("plan", "input", "schema")
    plan.add_argument("--map", action="append", default=[], help="target=cN")
    plan.add_argument("--ignore", action="append", default=[])
    run = command("dry-run", "input", "schema", "plan")
    run.add_argument("--policy", choices=POLICIES, default=POLICIES[0])
    run.add_argument("--max-errors", type=int, default=1_000)
    feedback = command("feedback", "input", "schema", "knowledge", "column")
    feedback.add_argument("kind", choices=("confirm", "reject", "correct"))
    feedback.add_argument("--suggested", default="")
    feedback.add_argument("--human", default="")
    template = command("template", "input", "plan", "id")
    template.add_argument("action", choices=("create",))
    recognize = command("recognize", "input", "schema")
    recognize.add_argument("--template", action="append", default=[])
    command("explain-plan", "plan")
    return p


def _show(value, output: str | None, *inputs: str) -> None:
    if output:
        write_json(value, output, inputs)
    else:
        print(to_json(value) if not isinstance(value, dict) else json.dumps(value, ensure_ascii=False, indent=2))


def _plan(path: str) -> Plan:
    return plan_from_json(json.loads(_read(path)))


def explain(report: dict, column: str | None, header: str | None) -> dict:
    """Candidates and decision of one column; a header that several columns share is refused."""
    if report.get("format") not in REPORTS:
        raise EngineError("UNSUPPORTED_REPORT", "unsupported report format")
    columns = report["structure"]["columns"]
    found = [c["id"] for c in columns if c["id"] == column or header is not None and c["header"] == header]
    if len(found) > 1:
        raise EngineError("AMBIGUOUS_HEADER", "name the column by its id")
    if not found:
        raise EngineError("UNKNOWN_COLUMN", "no such column")
    scored = report["scored"]
    return {"column": found[0], "decision": scored["decisions"][found[0]], "candidates": scored["candidates"][found[0]], "pruned": scored.get("pruned", {}).get(found[0], []), "history": scored.get("history", {}).get(found[0], [])}


def explain_plan(plan: Plan) -> list[str]:
    lines = [f"plan {plan.plan_id[:12]} for {plan.source_id}, route {plan.route}"]
    for b in plan.bindings:
        p = b.projection
        source = {"SOURCE_COLUMN": p.column, "CONSTANT": "a constant", "UNMAPPED": "nothing"}.get(p.kind, f"{p.operation}({', '.join(o.column or 'constant' for o in p.operands)})")
        lines.append(f"{b.target} <- {source}; {', '.join(s.id for s in (*b.transformations, *b.validations)) or 'no steps'}")
    return lines + [f"ignored: {', '.join(plan.ignored) or '-'}", f"unmapped: {', '.join(plan.unmapped) or '-'}"]


def feedback_event(analysis: Analysis, engine: Engine, schema, kind: str, column: str, suggested: str, human: str) -> Feedback:
    c = next((c for c in analysis.structure.columns if c.id == column), None)
    if c is None:
        raise EngineError("UNKNOWN_COLUMN", "no such column")
    h = engine.normalizer(c.header)
    known = [x for x in analysis.scored.candidates[column] if x.target == suggested]
    kinds = {"confirm": "CONFIRMED", "reject": "REJECTED", "correct": "CORRECTED"}
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return Feedback(str(uuid.uuid4()), now, kinds[kind], c.id, c.position, len(c.header), len(h.tokens), h.comparable, schema.id, schema.version, schema.fingerprint, schema.locale, schema.context, suggested, human, known[0].score if known else None, "cli", analysis.engine_version, analysis.config_fingerprint)


def run(args: argparse.Namespace, engine: Engine | None = None) -> int:
    if args.command == "explain":
        _show(explain(json.loads(_read(args.report)), args.column, args.header), None)
        return 0
    if args.command == "explain-plan":
        print("\n".join(explain_plan(_plan(args.plan))))
        return 0
    base = JsonLinesKnowledgeBase(args.knowledge) if getattr(args, "knowledge", None) else KnowledgeBase()
    engine = engine or Engine(build_session(), EngineConfig())
    engine.knowledge = base
    options = _options(args.option)
    if args.command == "template":
        t = engine.create_layout_template(args.input, _plan(args.plan), args.id, options=options)
        _show(t, args.output, args.input, args.plan)
        return 0
    schema = schema_from_json(_read(args.schema))
    if args.command == "analyze":
        _show(engine.analyze(args.input, schema, options), args.output, args.input, args.schema)
    elif args.command == "plan":
        chosen = dict(m.split("=", 1) for m in args.map)
        _show(engine.plan(engine.analyze(args.input, schema, options), schema, chosen, tuple(args.ignore)), args.output, args.input, args.schema)
    elif args.command == "dry-run":
        _show(engine.dry_run(args.input, _plan(args.plan), schema, options, DryRunOptions(args.policy, args.max_errors)), args.output, args.input, args.schema, args.plan)
    elif args.command == "feedback":
        base.record(feedback_event(engine.analyze(args.input, schema, options), engine, schema, args.kind, args.column, args.suggested, args.human))
    elif args.command == "recognize":
        for path in args.template:
            engine.registry.register(template_from_json(json.loads(_read(path))))
        _show(engine.recognize_layout(args.input, schema, options), args.output, args.input, args.schema, *args.template)
    return 0


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else 0
    try:
        return run(args, engine)
    except EngineError as e:
        print(f"{e.code}", file=sys.stderr)
        return AMBIGUOUS if e.code == "AMBIGUOUS_HEADER" else REFUSED
    except (OSError, ValueError, KeyError):
        print("INVALID_INPUT", file=sys.stderr)
        return REFUSED


if __name__ == "__main__":
    sys.exit(main())
