"""Mapping plans: explicit, source-bound recipes, and the templates and bindings that make them anew."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..model import ENGINE_VERSION, EngineError, IncompatiblePlan, TargetField, TargetSchema, fingerprint

FORMAT = "1.2"
READABLE = ("1.0", "1.1", "1.2")
MAX_OPERANDS, MAX_CONSTANT = 32, 16_384
OPERATIONS = {"CONCAT": (1, MAX_OPERANDS), "COALESCE": (1, MAX_OPERANDS), "ADD": (1, MAX_OPERANDS), "MULTIPLY": (1, MAX_OPERANDS), "SUBTRACT": (2, 2), "DIVIDE": (2, 2)}
REASON = "explicit caller confirmation"


@dataclass(frozen=True)
class Projection:
    """Where a target's value comes from: a column, a constant, an operation over these, or nowhere."""

    kind: str
    column: str = ""
    text: str = ""
    operation: str = ""
    operands: tuple[Projection, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "operands", tuple(self.operands))
        ok = self.kind in ("SOURCE_COLUMN", "CONSTANT", "UNMAPPED", "DERIVED")
        if self.kind == "SOURCE_COLUMN":
            ok = bool(self.column.strip())
        elif self.kind == "CONSTANT":
            ok = len(self.text) <= MAX_CONSTANT and not set(self.text) & {"\n", "\r"}
        elif self.kind == "DERIVED":
            least, most = OPERATIONS.get(self.operation, (1, 0))
            ok = least <= len(self.operands) <= most and all(o.kind in ("SOURCE_COLUMN", "CONSTANT") for o in self.operands)
        if not ok:
            raise IncompatiblePlan("INVALID_PROJECTION", "the projection is not well formed")

    @property
    def sources(self) -> tuple[str, ...]:
        return (self.column,) if self.kind == "SOURCE_COLUMN" else tuple(dict.fromkeys(o.column for o in self.operands if o.kind == "SOURCE_COLUMN"))

    def rebound(self, to: dict[str, str]) -> Projection:
        if self.kind == "SOURCE_COLUMN":
            if self.column not in to:
                raise IncompatiblePlan("TEMPLATE_BINDING_UNRESOLVED", "a column of the template is missing")
            return replace(self, column=to[self.column])
        return replace(self, operands=tuple(o.rebound(to) for o in self.operands))


def column(id_: str) -> Projection:
    return Projection("SOURCE_COLUMN", column=id_)


def constant(text: str) -> Projection:
    return Projection("CONSTANT", text=text)


def derived(operation: str, *operands: Projection) -> Projection:
    return Projection("DERIVED", operation=operation, operands=operands)


UNMAPPED = Projection("UNMAPPED")


@dataclass(frozen=True)
class Step:
    id: str
    version: str = "1"
    options: tuple[tuple[str, str], ...] = ()

    @classmethod
    def of(cls, id_: str, **options: str) -> Step:
        return cls(id_, "1", tuple(sorted(options.items())))

    def option(self, name: str, default: str | None = None) -> str | None:
        return dict(self.options).get(name, default)


@dataclass(frozen=True)
class Binding:
    target: str
    projection: Projection
    transformations: tuple[Step, ...] = ()
    validations: tuple[Step, ...] = ()
    reason: str = REASON

    @property
    def order(self) -> str:
        """Direct columns by source and target (as text), all others after them by target."""
        return f"{self.projection.column}|{self.target}" if self.projection.kind == "SOURCE_COLUMN" else f"~{self.target}"


@dataclass(frozen=True)
class Plan:
    plan_id: str
    source_id: str
    source_fingerprint: str
    schema_id: str
    schema_version: str
    schema_fingerprint: str
    config_fingerprint: str
    bindings: tuple[Binding, ...]
    ignored: tuple[str, ...] = ()
    unmapped: tuple[str, ...] = ()
    route: str = "FULL_ANALYSIS"
    format: str = FORMAT
    engine_version: str = ENGINE_VERSION

    @property
    def mapped(self) -> list[Binding]:
        return [b for b in self.bindings if b.projection.kind != "UNMAPPED"]


def sealed(plan: Plan) -> Plan:
    """Bindings in order, and the id that follows from the plan's content."""
    bindings = tuple(sorted(plan.bindings, key=lambda b: b.order))
    key = fingerprint("plan", plan.source_fingerprint, plan.schema_fingerprint, plan.config_fingerprint, bindings, plan.ignored)
    return replace(plan, bindings=bindings, plan_id=key)


def default_transformations(f: TargetField, locale: str) -> tuple[Step, ...]:
    for kind in ("cpf", "phone", "cep"):
        if f"br:{kind}" in f.semantic_types:
            return (Step.of(f"br:{kind}-canonical"),)
    options = {"locale": locale} if locale.strip() else {}
    formats = {"pt-br": "uuuu-MM-dd|dd/MM/uuuu", "en-us": "uuuu-MM-dd|MM/dd/uuuu"}.get(locale.lower())
    table = {
        "INTEGER": Step.of("core:long"),
        "DECIMAL": Step.of("core:big-decimal", **options),
        "DATE": Step.of("core:local-date", **({"formats": formats} if formats else {})),
        "BOOLEAN": Step.of("core:boolean", **options),
    }
    return (table[f.physical_type],) if f.physical_type in table else ()


def default_validations(f: TargetField) -> tuple[Step, ...]:
    steps = [Step.of("core:required")] if f.required else []
    if "br:cpf" in f.semantic_types:
        steps.append(Step.of("br:cpf-checksum"))
    if "core:email" in f.semantic_types:
        steps.append(Step.of("core:regex", pattern=r"^[^\s@]+@[^\s@]+\.[^\s@]+$"))
    return tuple(steps)


def create(analysis, schema: TargetSchema, selections: dict[str, Projection | str], ignored: tuple[str, ...] = ()) -> Plan:
    """A plan from what the caller confirms: target id -> projection (or a column id). Nothing is mapped by itself."""
    if analysis.engine_version != ENGINE_VERSION:
        raise IncompatiblePlan("PLAN_ENGINE_MISMATCH", "the analysis is of another engine version")
    if (analysis.schema_id, analysis.schema_version, analysis.schema_fingerprint) != (schema.id, schema.version, schema.fingerprint):
        raise IncompatiblePlan("PLAN_SCHEMA_MISMATCH", "the analysis is of another schema")
    have = [c.id for c in analysis.structure.columns]
    bindings = []
    for target, projection in selections.items():
        projection = column(projection) if isinstance(projection, str) else projection
        f = schema.field(target)
        if f is None:
            raise IncompatiblePlan("UNKNOWN_TARGET", "no such target field")
        if set(projection.sources) - set(have):
            raise IncompatiblePlan("UNKNOWN_SOURCE", "no such source column")
        steps = (default_transformations(f, schema.locale), default_validations(f)) if projection.kind != "UNMAPPED" else ((), ())
        bindings.append(Binding(target, projection, *steps))
    used = {s for b in bindings for s in b.projection.sources}
    if set(ignored) - set(have):
        raise IncompatiblePlan("UNKNOWN_SOURCE", "no such source column")
    if used & set(ignored):
        raise IncompatiblePlan("IGNORED_COLUMN_USED", "a column is both used and ignored")
    unmapped = tuple(c for c in have if c not in used and c not in ignored)
    return sealed(
        Plan("", analysis.source_id, analysis.source_fingerprint, schema.id, schema.version, schema.fingerprint, analysis.config_fingerprint, tuple(bindings), tuple(sorted(set(ignored))), unmapped)
    )


def configure(plan: Plan, target: str, transformations: list[Step] | None = None, validations: list[Step] | None = None) -> Plan:
    """The plan with other steps for a target; its id changes with them."""
    if target not in {b.target for b in plan.bindings}:
        raise IncompatiblePlan("UNKNOWN_TARGET", "the plan has no such target")

    def changed(b: Binding) -> Binding:
        if b.target != target:
            return b
        return replace(b, transformations=b.transformations if transformations is None else tuple(transformations), validations=b.validations if validations is None else tuple(validations))

    return sealed(replace(plan, bindings=tuple(map(changed, plan.bindings))))


def plan_from_json(data: dict) -> Plan:
    """Any readable format; fields that older ones lack get their defaults."""
    if data.get("format") not in READABLE:
        raise EngineError("UNSUPPORTED_PLAN", "unsupported plan format")

    def projection(x: dict) -> Projection:
        return Projection(x["kind"], x.get("column", ""), x.get("text", ""), x.get("operation", ""), tuple(map(projection, x.get("operands", ()))))

    def steps(xs) -> tuple[Step, ...]:
        return tuple(Step(x["id"], x.get("version", "1"), tuple((k, v) for k, v in x.get("options", ()))) for x in xs)

    bindings = tuple(Binding(b["target"], projection(b["projection"]), steps(b.get("transformations", ())), steps(b.get("validations", ())), b.get("reason", REASON)) for b in data["bindings"])
    plain = {k: data[k] for k in ("plan_id", "source_id", "source_fingerprint", "schema_id", "schema_version", "schema_fingerprint", "config_fingerprint")}
    return Plan(**plain, bindings=bindings, ignored=tuple(data.get("ignored", ())), unmapped=tuple(data.get("unmapped", ())), route=data.get("route", "FULL_ANALYSIS"), format=data["format"], engine_version=data["engine_version"])
