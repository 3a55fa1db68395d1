"""The engine's public surface: analyse, plan, dry-run, recognise, and one call that takes the right route."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .functions.detectors import BRAZIL, CORE, Detector
from .functions.headers import PT_BR, HeaderNormalizer
from .model import ENGINE_VERSION, EngineConfig, EngineError, IncompatiblePlan, InvalidSchema, InvalidSource, SourceStructure, TargetSchema
from .operators import dryrun as dry
from .operators import layout as lay
from .operators.knowledge import KnowledgeBase, snapshot
from .operators.profile import ColumnProfile, profile
from .operators.scoring import Scored, score
from .plans import plan as planning
from .plans.plan import Plan, Projection, Step
from .plans.steps import TRANSFORMERS, VALIDATORS
from .session import ship
from .sources.base import Rows, Source, from_bytes, guarded
from .sources.csv import CsvReader
from .sources.frame import from_frame
from .sources.xls import XlsReader
from .sources.xlsx import XlsxReader


@dataclass
class Analysis:
    source_id: str
    source_fingerprint: str
    schema_id: str
    schema_version: str
    schema_fingerprint: str
    config_fingerprint: str
    structure: SourceStructure
    rows: int
    profiles: list[ColumnProfile]
    scored: Scored
    warnings: list[str]
    knowledge_id: str
    calibration: str = "UNCALIBRATED"
    format: str = "1.3"
    engine_version: str = ENGINE_VERSION


@dataclass
class Recognition:
    route: str
    classification: str
    template_id: str = ""
    template_version: str = ""
    drift: tuple = ()
    affected: tuple = ()
    plan: Plan | None = None
    signature: lay.Signature | None = None
    rows_read: int = 0
    candidate_pairs: int = 0
    metrics: int = 0
    inference_skipped: bool = False


@dataclass
class ProcessResult:
    status: str
    route: str
    analysis: Analysis | None = None
    recognition: Recognition | None = None
    dry_run: dry.DryRunResult | None = None


@dataclass(frozen=True)
class Event:
    """What observers get: STARTED, ROUTE_SELECTED, COMPLETED or FAILED."""

    kind: str
    source_id: str
    route: str = ""
    status: str = ""
    code: str = ""


@dataclass
class Engine:
    """Configuration, detectors, readers and stores of one user."""

    spark: SparkSession
    config: EngineConfig = field(default_factory=EngineConfig)
    detectors: tuple[Detector, ...] = (*CORE, *BRAZIL)
    normalizer: HeaderNormalizer = field(default_factory=lambda: HeaderNormalizer(PT_BR))
    knowledge: KnowledgeBase = field(default_factory=KnowledgeBase)
    registry: lay.Registry = field(default_factory=lay.Registry)
    observer: Callable[[Event], None] | None = None
    readers: tuple = field(default_factory=lambda: (CsvReader(), XlsxReader(), XlsReader()))

    def __post_init__(self):
        types = [d.type for d in self.detectors]
        if len(set(types)) != len(types):
            raise EngineError("DUPLICATE_DETECTOR", "a semantic type has one detector")
        ship(self.spark)

    # Sources

    def source(self, given: str | bytes | Source, name: str = "") -> Source:
        if isinstance(given, Source):
            return given
        return Source(given) if isinstance(given, str) else from_bytes(given, name)

    def _open(self, source: Source, options: dict[str, str]) -> tuple[Rows, SourceStructure]:
        if source.size(self.spark) > self.config.limits.max_bytes:
            raise InvalidSource("SOURCE_TOO_LARGE", "source exceeds the byte limit")
        reader = next((r for r in self.readers if r.supports(self.spark, source)), None)
        if reader is None:
            raise InvalidSource("UNSUPPORTED_SOURCE", "no reader takes this source")
        structure = guarded(lambda: reader.detect(self.spark, source, options, self.config.limits))
        return reader.open(self.spark, source, structure, options, self.config.limits), structure

    def fingerprint(self, options: dict[str, str]) -> str:
        return self.config.fingerprint(options, self.normalizer.fingerprint, [d.type for d in self.detectors], sorted(TRANSFORMERS), sorted(VALIDATORS))

    def _timed(self, started: float) -> None:
        if self.config.limits.max_seconds and time.monotonic() - started > self.config.limits.max_seconds:
            raise EngineError("TIME_LIMIT", "the time limit is over")

    # Workflow

    def analyze(self, given, schema: TargetSchema, options: dict[str, str] | None = None) -> Analysis:
        """Profile every column and score it against the schema; the source is hashed before and after."""
        started, options, source = time.monotonic(), options or {}, self.source(given)
        rows, structure = self._open(source, options)
        before = source.sha256(self.spark)
        with rows.spread() as frame:
            profiles = guarded(lambda: profile(frame, structure.columns, self.detectors, self.config))
        self._timed(started)
        n = profiles[0].rows if profiles else 0
        if n > self.config.limits.max_records:
            raise InvalidSource("RECORD_LIMIT", "source exceeds the record limit")
        if source.sha256(self.spark) != before:
            raise InvalidSource("SOURCE_CHANGED", "source changed during the analysis")
        return self._scored(source.name, before, structure, n, profiles, schema, options, list(structure.warnings) + rows.warnings)

    def analyze_frame(self, frame: DataFrame, schema: TargetSchema, name: str, order: str | None = None) -> Analysis:
        """The same for any DataFrame; its identity is its name and schema."""
        rows = from_frame(frame, order, limits=self.config.limits)
        profiles = profile(rows.frame, rows.structure.columns, self.detectors, self.config)
        return self._scored(name, hashlib.sha256(f"{name}|{frame.schema.json()}".encode()).hexdigest(), rows.structure, profiles[0].rows if profiles else 0, profiles, schema, {}, list(rows.structure.warnings))

    def _scored(self, name, before, structure, n, profiles, schema, options, warnings) -> Analysis:
        evidence = snapshot(self.knowledge.frame(self.spark)) if self.knowledge.events else None
        found = score(self.spark, profiles, schema, self.config, self.normalizer, evidence)
        warnings = (warnings + found.warnings)[: self.config.limits.max_warnings]
        return Analysis(name, before, schema.id, schema.version, schema.fingerprint, self.fingerprint(options), structure, n, profiles, found, warnings, self.knowledge.id)

    def plan(self, analysis: Analysis, schema: TargetSchema, selections: dict[str, Projection | str], ignored: tuple[str, ...] = ()) -> Plan:
        return planning.create(analysis, schema, selections, ignored)

    def configure_plan(self, plan: Plan, target: str, transformations: list[Step] | None = None, validations: list[Step] | None = None) -> Plan:
        return planning.configure(plan, target, transformations, validations)

    def dry_run(self, given, plan: Plan, schema: TargetSchema, options: dict[str, str] | None = None, run: dry.DryRunOptions = dry.DryRunOptions()) -> dry.DryRunResult:
        """Check the plan against source, schema and configuration, then count what it would do."""
        started, options, source = time.monotonic(), options or {}, self.source(given)
        if plan.format not in planning.READABLE:
            raise IncompatiblePlan("UNSUPPORTED_PLAN", "unsupported plan format")
        if plan.engine_version != ENGINE_VERSION:
            raise IncompatiblePlan("REQUIRE_REANALYSIS", "the plan is of another engine version")
        if plan.source_id != source.name or plan.source_fingerprint != source.sha256(self.spark):
            raise IncompatiblePlan("INVALIDATE_PLAN", "the source is not the analysed one")
        if (plan.schema_id, plan.schema_version, plan.schema_fingerprint) != (schema.id, schema.version, schema.fingerprint) or plan.config_fingerprint != self.fingerprint(options):
            raise IncompatiblePlan("REQUIRE_REANALYSIS", "schema or configuration differ from the analysis")
        mapped = {b.target for b in plan.mapped}
        if any(f.required and f.id not in mapped for f in schema.fields):
            raise IncompatiblePlan("INCOMPLETE_PLAN", "a required target is not mapped")
        rows, structure = self._open(source, options)
        with rows.spread() as frame:
            result = guarded(lambda: dry.dry_run(frame, plan, schema, [c.id for c in structure.columns], run))
        self._timed(started)
        if source.sha256(self.spark) != plan.source_fingerprint:
            raise IncompatiblePlan("INVALIDATE_PLAN", "the source changed during the dry run")
        return result

    def _signature(self, rows: Rows, structure: SourceStructure, n: int) -> tuple[lay.Signature, int]:
        guard = lay.guard_rows(rows.frame, n, rows.ordered)
        profiles = guarded(lambda: profile(guard, structure.columns, self.detectors, self.config, locations=False, values=False))
        return lay.signature(structure, profiles, self.normalizer), profiles[0].rows if profiles else 0

    def create_layout_template(self, given, plan: Plan, id_: str, version: str = "1", options: dict[str, str] | None = None) -> lay.Template:
        rows, structure = self._open(self.source(given), options or {})
        return lay.create_template(id_, version, plan, self._signature(rows, structure, lay.GUARD_ROWS)[0])

    def recognize_layout(self, given, schema: TargetSchema, options: dict[str, str] | None = None, guard: int = lay.GUARD_ROWS) -> Recognition:
        """Find a confirmed layout by a bounded guard; a route other than full analysis carries a new plan."""
        options, source = options or {}, self.source(given)
        before = source.sha256(self.spark)
        rows, structure = self._open(source, options)
        current, read = self._signature(rows, structure, guard)
        if source.sha256(self.spark) != before:
            raise InvalidSource("SOURCE_CHANGED", "source changed during recognition")
        found = [lay.assess(self.spark, t, current, schema, self.fingerprint(options), self.normalizer) for t in self.registry.candidates(schema.fingerprint, current)]
        best = lay.choose(found)
        if best is None:
            return Recognition(lay.FULL, "UNKNOWN", signature=current, rows_read=read)
        plan = lay.instantiate(best, current, source.name, before) if best.route != lay.FULL else None
        return Recognition(best.route, best.classification, best.template.id, best.template.version, best.drift, best.affected, plan, current, read, best.candidate_pairs, best.metrics, best.route == lay.FAST)

    # One call

    def _tell(self, event: Event) -> None:
        if self.observer:
            try:
                self.observer(event)
            except Exception:
                raise EngineError("OBSERVER_FAILED", "the observer failed") from None

    def process(self, given, schema: TargetSchema, plan: Plan | None = None, template: lay.Template | None = None, analyze_only: bool = False, options: dict[str, str] | None = None, run: dry.DryRunOptions = dry.DryRunOptions()) -> ProcessResult:
        """A plan is dry-run; else a known layout is reused; else the source is analysed for review."""
        if plan and (template or analyze_only):
            raise EngineError("INVALID_REQUEST", "a plan excludes a template and analysis alone")
        source = self.source(given)
        self._tell(Event("STARTED", source.name))
        try:
            result = self._process(source, schema, plan, template, analyze_only, options, run)
        except EngineError as e:
            if e.code != "OBSERVER_FAILED":
                self._tell(Event("FAILED", source.name, status="FAILED", code=e.code))
            raise
        self._tell(Event("COMPLETED", source.name, result.route, result.status))
        return result

    def _process(self, source, schema, plan, template, analyze_only, options, run) -> ProcessResult:
        route = lambda r: self._tell(Event("ROUTE_SELECTED", source.name, r))
        if plan:
            route("CONFIRMED_PLAN")
            result = self.dry_run(source, plan, schema, options, run)
            return ProcessResult(status_of(result), "CONFIRMED_PLAN", dry_run=result)
        recognition = None
        if not analyze_only:
            if template:
                self.registry.register(template)
            recognition = self.recognize_layout(source, schema, options)
            if recognition.plan:
                route(recognition.route)
                result = self.dry_run(source, recognition.plan, schema, options, run)
                return ProcessResult(status_of(result), recognition.route, recognition=recognition, dry_run=result)
        route(lay.FULL)
        analysis = self.analyze(source, schema, options)
        return ProcessResult("REVIEW_REQUIRED", "ANALYZE_ONLY" if analyze_only else lay.FULL, analysis, recognition)


def status_of(result: dry.DryRunResult) -> str:
    if result.total_errors or result.terminated:
        return "INVALID"
    return "SUCCESS_WITH_WARNINGS" if result.total_warnings else "SUCCESS"


def failure(e: EngineError) -> type[EngineError]:
    """The kind of a failure by its code."""
    if isinstance(e, (InvalidSource, InvalidSchema, IncompatiblePlan)):
        return type(e)
    for kind, marks in ((InvalidSchema, ("SCHEMA",)), (IncompatiblePlan, ("PLAN", "REANALYSIS", "TEMPLATE")), (InvalidSource, ("SOURCE", "CSV", "XLS", "EXCEL", "LIMIT", "IRREGULAR"))):
        if any(m in e.code for m in marks):
            return kind
    return EngineError


def to_json(value) -> str:
    return json.dumps(asdict(value), ensure_ascii=False, indent=2, default=lambda x: sorted(x) if isinstance(x, (set, frozenset)) else str(x))


def write_json(value, path: str, inputs: tuple[str, ...] = ()) -> None:
    """Write a report whole or not at all; an input is never overwritten."""
    if any(os.path.exists(i) and os.path.exists(path) and os.path.samefile(i, path) for i in inputs):
        raise EngineError("OUTPUT_IS_INPUT", "an input would be overwritten")
    at, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(at, "w") as out:
        out.write(to_json(value))
    os.replace(name, path)
