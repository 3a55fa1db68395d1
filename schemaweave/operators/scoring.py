"""Scores of source columns against target fields: candidate generation, components, ranking and decisions.

Columns and targets meet in a join of two small frames, target names are expanded to one row each, similarities are
computed where Catalyst or Arrow can, and ranks, margins and collisions are windows over the scored pairs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as t
from ..functions.headers import HeaderNormalizer
from ..model import EngineConfig, TargetSchema
from .profile import ColumnProfile

COMPONENTS = ("lexical", "physicalType", "semantic", "pattern", "distribution", "history")


@dataclass(frozen=True)
class Component:
    id: str
    available: bool
    value: float | None
    weight: float
    reliability: float
    contribution: float
    evidence: str = ""


@dataclass(frozen=True)
class Candidate:
    target: str
    display_name: str
    score: float
    coverage: float
    confidence: float
    eligible: bool
    components: tuple[Component, ...]
    contradictions: tuple[str, ...]


@dataclass(frozen=True)
class Decision:
    column: str
    target: str | None
    status: str
    score: float
    coverage: float
    margin: float | None
    confidence: float
    blockers: tuple[str, ...]


@dataclass
class Scored:
    candidates: dict[str, list[Candidate]]
    pruned: dict[str, list[tuple[str, str]]]
    decisions: dict[str, Decision]
    unmatched: list[str]
    conflicts: list[str]
    warnings: list[str] = field(default_factory=list)
    history: dict[str, list[dict]] = field(default_factory=dict)


def features(spark: SparkSession, profiles: list[ColumnProfile], normalizer: HeaderNormalizer) -> DataFrame:
    """One row per source column: all that scoring needs of a profile."""
    rows = []
    for p in profiles:
        h = normalizer(p.column.header)
        evidence = [(e.type, e.validity, e.shape_score, e.reliability, e.confidence, e.strong) for e in p.evidence.values()]
        rows.append((p.column.id, p.column.position, h.comparable, h.compact, p.inferred, p.observed, evidence))
    return spark.createDataFrame(
        rows,
        "column_id string, position int, comparable string, compact string, inferred string, observed long, evidence array<struct<type:string,validity:double,shape:double,reliability:double,confidence:double,strong:boolean>>",
    )


def target_frame(spark: SparkSession, schema: TargetSchema, normalizer: HeaderNormalizer) -> DataFrame:
    """One row per target field with its normalised names, in order: display name, id, aliases."""
    rows = []
    for k, f in enumerate(schema.fields):
        names = [normalizer(n) for n in (f.display_name, f.id, *f.aliases)]
        rows.append((k, f.id, f.display_name, f.physical_type, list(f.semantic_types), f.exclusive, [(i, n.comparable, n.compact) for i, n in enumerate(names)]))
    return spark.createDataFrame(
        rows, "ordinal int, target string, display_name string, expected string, accepts array<string>, exclusive boolean, names array<struct<at:int,name_comparable:string,name_compact:string>>"
    )


def history_frame(evidence: DataFrame | None, spark: SparkSession, schema: TargetSchema) -> DataFrame:
    """target, source_name, history_score, history_reliability for this schema, locale and context."""
    if evidence is None:
        return spark.createDataFrame([], "target string, source_name string, history_score double, history_reliability double")
    here = (
        (F.col("schema_id") == schema.id) & (F.col("schema_version") == schema.version) & (F.col("schema_fingerprint") == schema.fingerprint) & (F.col("locale") == schema.locale) & (F.col("context") == schema.context)
    )
    return evidence.where(here).select("target", "source_name", F.col("score").alias("history_score"), F.col("reliability").alias("history_reliability"))


def paired(columns: DataFrame, targets: DataFrame, history: DataFrame) -> DataFrame:
    """Every source column with every target field; both sides are as small as a table is wide."""
    pairs = columns.join(F.broadcast(targets), how="cross")
    return pairs.join(F.broadcast(history), (pairs.target == history.target) & (pairs.comparable == history.source_name), "left").drop(history.target).drop("source_name")


def generated(pairs: DataFrame, config: EngineConfig) -> DataFrame:
    """Adds ``retained`` and ``why``: with many targets only exact aliases and the best of the supported ones stay."""
    exact = F.exists("names", lambda n: n["name_compact"] == F.col("compact"))
    overlap = F.array_max(F.transform("names", lambda n: sim.jaccard(F.col("comparable"), n["name_comparable"])))
    accepted = F.filter("evidence", lambda e: F.array_contains("accepts", e["type"]))
    semantic = F.coalesce(F.array_max(F.transform(accepted, lambda e: e["confidence"])), F.lit(0.0))
    specific = (F.col("expected") != "TEXT") & (F.col("expected") == F.col("inferred"))
    known = F.col("history_score").isNotNull()
    foreign = F.exists("evidence", lambda e: e["strong"] & ~F.array_contains("accepts", e["type"]))
    past = F.when(known, config.weight("history") * F.col("history_reliability") * F.col("history_score")).otherwise(0.0)
    signal = 0.65 * F.col("overlap") + 0.30 * F.col("semantic_signal") + F.when(specific, 0.05).otherwise(0.0) + past
    out = pairs.withColumns({"exact": exact, "overlap": overlap, "semantic_signal": semantic})
    supported = F.col("exact") | (F.col("overlap") > 0) | (F.col("semantic_signal") > 0) | specific | known
    out = out.withColumns({"supported": supported, "signal": signal, "foreign": foreign})
    order = Window.partitionBy("column_id", "supported", "exact").orderBy(F.desc("signal"), "target")
    many = (F.count("*").over(Window.partitionBy("column_id")) > config.pruning_threshold) & (F.col("compact") != "")
    out = out.withColumns({"place": F.row_number().over(order), "many": many})
    stays = ~F.col("many") | F.col("supported") & (F.col("exact") | (F.col("place") <= config.shortlist))
    why = (
        F.when(F.col("supported"), "below the shortlist")
        .when(F.col("foreign"), "strong semantic incompatibility and no lexical or type support")
        .otherwise("no alias, token, semantic or specific type support")
    )
    return out.withColumns({"retained": stays, "why": why}).drop("place", "many", "signal", "supported", "exact", "overlap", "semantic_signal")


def with_lexical(pairs: DataFrame, strategy: str = "combined") -> DataFrame:
    """Adds ``lexical``: of all names of a target the best combined score (the first on ties), or the older mean of two maxima."""
    keys = ["column_id", "target"]
    names = pairs.select(*keys, "comparable", "compact", F.explode("names").alias("n")).select(*keys, "comparable", "compact", "n.*")
    if strategy == "baseline":
        a = sim.dice(F.col("comparable"), F.col("name_comparable"))
        b = sim.levenshtein(F.col("compact"), F.col("name_compact"))
        best = names.groupBy(*keys).agg(((F.max(a) + F.max(b)) / 2.0).alias("lexical"))
    else:
        each = names.withColumn("combined", sim.lexical(F.col("comparable"), F.col("compact"), F.col("name_comparable"), F.col("name_compact")))
        best = each.groupBy(*keys).agg(F.max("combined").alias("lexical"))
    return pairs.join(best, keys, "left").withColumn("lexical", F.when(F.col("compact") != "", F.col("lexical")))


def scored(pairs: DataFrame, config: EngineConfig) -> DataFrame:
    """Adds the value and reliability of each component, score, coverage, confidence, eligible and contradictions."""
    accepted = F.filter("evidence", lambda e: F.array_contains("accepts", e["type"]))
    best = F.reduce(accepted, F.lit(None).cast("struct<type:string,validity:double,shape:double,reliability:double,confidence:double,strong:boolean>"), lambda a, e: F.when(a.isNull() | (e["validity"] > a["validity"]), e).otherwise(a))
    foreign = F.transform(F.filter("evidence", lambda e: e["strong"] & ~F.array_contains("accepts", e["type"])), lambda e: e["type"])
    some = F.col("observed") > 0
    fits = (F.col("expected") == "TEXT") | (F.col("expected") == F.col("inferred"))
    out = pairs.withColumns({"best": best, "contradictions": foreign})
    nothing = F.lit(None).cast("double")
    values: dict[str, tuple[Column, Column]] = {
        "lexical": (F.col("lexical"), F.lit(1.0)),
        "physicalType": (F.when(some, F.when(fits, 1.0).when(F.col("inferred") == "MIXED", 0.5).otherwise(0.0)), F.least(F.lit(1.0), F.col("observed") / config.min_evidence)),
        "semantic": (F.col("best")["validity"], F.col("best")["reliability"]),
        "pattern": (F.col("best")["shape"], F.col("best")["reliability"]),
        "distribution": (nothing, F.lit(0.0)),
        "history": (F.col("history_score"), F.col("history_reliability")),
    }
    sums, parts = F.lit(0.0), F.lit(0.0)
    for name in COMPONENTS:
        value, trust = values[name]
        trust = F.when(value.isNotNull(), F.coalesce(trust, F.lit(0.0))).otherwise(0.0)
        out = out.withColumns({f"{name}_value": value, f"{name}_reliability": trust})
        sums = sums + config.weight(name) * F.col(f"{name}_reliability") * F.coalesce(F.col(f"{name}_value"), F.lit(0.0))
        parts = parts + config.weight(name) * F.col(f"{name}_reliability")
    total = math.fsum(config.weights.values())
    out = out.withColumns({"numerator": sums, "denominator": parts, "eligible": F.size("contradictions") == 0})
    out = out.withColumn("score", t.unit(F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator")).otherwise(0.0)))
    out = out.withColumn("coverage", t.unit(F.col("denominator") / total))
    return out.withColumn("confidence", F.when(F.col("eligible"), t.unit(F.col("score") * F.col("coverage"))).otherwise(0.0))


def ranked(pairs: DataFrame) -> DataFrame:
    """Adds ``rank`` and ``margin`` (score of the first eligible less that of the second) by column."""
    column = Window.partitionBy("column_id")
    order = column.orderBy(F.desc("eligible"), F.desc("score"), "target")
    out = pairs.withColumn("rank", F.row_number().over(order))
    pick = lambda k: F.max(F.when((F.col("rank") == k) & F.col("eligible"), F.col("score"))).over(column)
    return out.withColumn("margin", pick(1) - pick(2))


def decide(column: str, eligible: list[Candidate], margin: float | None, outside: tuple[str, ...], config: EngineConfig) -> Decision:
    if not eligible:
        return Decision(column, None, "NO_MATCH", 0.0, 0.0, margin, 0.0, outside)
    best, blockers = eligible[0], list(outside)
    if margin is None:
        blockers.append("margin unavailable with a single candidate")
    elif margin < config.min_margin:
        blockers.append("candidate margin below minimum")
    if best.coverage < config.min_coverage:
        blockers.append("evidence coverage below minimum")
    if not config.auto_map_enabled:
        blockers.append("automatic mapping is disabled")
    status, target = "LOW_CONFIDENCE", best.target
    if best.score < config.low_threshold:
        status, target = "NO_MATCH", None
    elif config.auto_map_enabled and not blockers and best.score >= config.auto_map_threshold:
        status = "AUTO_MAP"
    elif best.score >= config.review_threshold:
        status = "REVIEW_RECOMMENDED"
    return Decision(column, target, status, best.score, best.coverage, margin, best.confidence, tuple(blockers))


def _candidate(r, config: EngineConfig) -> Candidate:
    parts = []
    for name in COMPONENTS:
        value, trust, weight = r[f"{name}_value"], r[f"{name}_reliability"], config.weight(name)
        parts.append(Component(name, value is not None, value, weight, trust, weight * trust * (value or 0.0)))
    why = tuple(f"strong semantic evidence {x} is incompatible with target" for x in r.contradictions)
    return Candidate(r.target, r.display_name, r.score, r.coverage, r.confidence, r.eligible, tuple(parts), why)


def collisions(decisions: Iterable[Decision], schema: TargetSchema) -> dict[str, int]:
    """The exclusive targets that several columns claim, and how many do."""
    claims = Counter(d.target for d in decisions if d.target and schema.field(d.target).exclusive)
    return {target: n for target, n in claims.items() if n > 1}


def score(spark: SparkSession, profiles: list[ColumnProfile], schema: TargetSchema, config: EngineConfig, normalizer: HeaderNormalizer, evidence: DataFrame | None = None) -> Scored:
    columns, targets = features(spark, profiles, normalizer), target_frame(spark, schema, normalizer)
    pairs = generated(paired(columns, targets, history_frame(evidence, spark, schema)), config).persist()
    cap = config.limits.max_pruned_explanations
    by_target = Window.partitionBy("column_id").orderBy("target")
    lost = pairs.where("NOT retained").select("column_id", "target", "why", F.row_number().over(by_target).alias("n"), F.count("*").over(Window.partitionBy("column_id")).alias("total"))
    pruned: dict[str, list] = {p.column.id: [] for p in profiles}
    warnings = {}
    if len(schema.fields) > config.pruning_threshold:
        for r in lost.where(F.col("n") <= cap).orderBy("column_id", "n").collect():
            pruned[r.column_id].append((r.target, r.why))
            if r.total > cap:
                warnings[r.column_id] = f"candidate pruning for source {r.column_id} retained {cap} of {r.total} explanations"
    top = ranked(scored(with_lexical(pairs.where("retained"), config.lexical_strategy), config))
    reported: dict[str, list[Candidate]] = {p.column.id: [] for p in profiles}
    margins, past = {}, {p.column.id: [] for p in profiles}
    for r in top.where(F.col("rank") <= config.limits.max_candidates).orderBy("position", "rank").collect():
        reported[r.column_id].append(_candidate(r, config))
        margins[r.column_id] = r.margin
        if r.history_score is not None:
            past[r.column_id].append({"target": r.target, "score": r.history_score, "reliability": r.history_reliability})
    pairs.unpersist()
    eligible = {c: [x for x in found if x.eligible] for c, found in reported.items()}
    decisions = {c: decide(c, eligible[c], margins.get(c), (), config) for c in reported}
    unmatched = [c for c, d in decisions.items() if d.target is None]
    collided = sorted(collisions(decisions.values(), schema))
    for c, d in decisions.items():
        if d.target in collided:
            decisions[c] = decide(c, eligible[c], d.margin, ("exclusive target collision",), config)
    return Scored(reported, pruned, decisions, unmatched, [f"exclusive target collision: {x}" for x in collided], [warnings[c] for c in reported if c in warnings], past)
