"""Schema, configuration, limits, reports and errors: small values that live on the driver."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, is_dataclass
from enum import Enum

ENGINE_VERSION = "schemaweave-0.1"
PHYSICAL_TYPES = ("EMPTY", "BOOLEAN", "INTEGER", "DECIMAL", "DATE", "TEXT", "MIXED")
SEMANTIC_ID = re.compile(r"[a-z][a-z0-9-]*:[a-z][a-z0-9-]*")


class EngineError(Exception):
    """A failure with a stable code; the message never holds a cell's value."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


class InvalidSource(EngineError):
    pass


class InvalidSchema(EngineError):
    pass


class IncompatiblePlan(EngineError):
    pass


def canonical(value) -> str:
    """Canonical JSON of dataclasses, enums, sets and plain values."""

    def plain(x):
        if is_dataclass(x) and not isinstance(x, type):
            return plain(asdict(x))
        if isinstance(x, Enum):
            return x.value
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (set, frozenset)):
            return sorted(plain(v) for v in x)
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return x

    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def fingerprint(*values) -> str:
    return hashlib.sha256(canonical(list(values)).encode()).hexdigest()


def semantic_type(name: str) -> str:
    name = name.strip().lower()
    if not SEMANTIC_ID.fullmatch(name):
        raise InvalidSchema("INVALID_SEMANTIC_TYPE", "a semantic type is namespace:name")
    return name


@dataclass(frozen=True)
class TargetField:
    id: str
    display_name: str
    aliases: tuple[str, ...] = ()
    physical_type: str = "TEXT"
    semantic_types: tuple[str, ...] = ()
    required: bool = False
    exclusive: bool = True

    def __post_init__(self):
        if not self.id.strip() or not self.display_name.strip():
            raise InvalidSchema("INVALID_TARGET_FIELD", "a field has an id and a display name")
        if self.physical_type not in PHYSICAL_TYPES:
            raise InvalidSchema("INVALID_TARGET_FIELD", "unknown physical type")
        object.__setattr__(self, "aliases", tuple(self.aliases))
        object.__setattr__(self, "semantic_types", tuple(semantic_type(t) for t in self.semantic_types))


@dataclass(frozen=True)
class TargetSchema:
    id: str
    version: str
    fields: tuple[TargetField, ...]
    context: str = ""
    locale: str = ""

    def __post_init__(self):
        object.__setattr__(self, "fields", tuple(self.fields))
        ids = [f.id for f in self.fields]
        if not self.id.strip() or not self.version.strip() or not ids:
            raise InvalidSchema("INVALID_SCHEMA", "a schema has an id, a version and fields")
        if len(set(ids)) != len(ids):
            raise InvalidSchema("INVALID_SCHEMA", "field ids are unique")

    def field(self, id_: str) -> TargetField | None:
        return next((f for f in self.fields if f.id == id_), None)

    @property
    def fingerprint(self) -> str:
        return fingerprint("schema", self)


SCHEMA_KEYS = {"formatVersion", "schemaId", "schemaVersion", "context", "locale", "fields"}
FIELD_KEYS = {"id", "displayName", "aliases", "physicalType", "semanticTypes", "required", "exclusive"}


def schema_from_json(text: str) -> TargetSchema:
    """Reads format 1.0; unknown properties are refused."""
    try:
        data = json.loads(text)
    except ValueError:
        raise InvalidSchema("INVALID_SCHEMA", "not JSON") from None
    if not isinstance(data, dict) or data.get("formatVersion") != "1.0":
        raise InvalidSchema("INVALID_SCHEMA", "formatVersion is 1.0")
    if set(data) - SCHEMA_KEYS or any(set(f) - FIELD_KEYS for f in data.get("fields", [])):
        raise InvalidSchema("INVALID_SCHEMA", "unknown property")
    try:
        fields = [
            TargetField(f["id"], f["displayName"], f.get("aliases", ()), f.get("physicalType", "TEXT"), f.get("semanticTypes", ()), f.get("required", False), f.get("exclusive", True))
            for f in data["fields"]
        ]
        return TargetSchema(data["schemaId"], data["schemaVersion"], fields, data.get("context") or "", data.get("locale") or "")
    except KeyError:
        raise InvalidSchema("INVALID_SCHEMA", "missing property") from None


@dataclass(frozen=True)
class Limits:
    """Bounds of inputs and reports."""

    max_bytes: int = 1 << 40
    max_records: int = 1 << 40
    max_columns: int = 2_000
    max_field_chars: int = 1_000_000
    max_header_chars: int = 1_000
    max_candidates: int = 3
    max_pruned_explanations: int = 100
    max_warnings: int = 100
    max_errors: int = 100
    max_anomalies: int = 20
    max_locations: int = 3
    max_seconds: float = 0.0  # 0: no limit

    def __post_init__(self):
        if any(v < 0 or v == 0 and k != "max_seconds" for k, v in asdict(self).items()):
            raise EngineError("INVALID_CONFIG", "limits are positive")


#: Component weights: fixed values.
WEIGHTS = {"lexical": 0.30, "semantic": 0.30, "physicalType": 0.10, "pattern": 0.15, "distribution": 0.05, "history": 0.10}


@dataclass(frozen=True)
class EngineConfig:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    min_evidence: int = 20
    auto_map_threshold: float = 0.90
    review_threshold: float = 0.70
    low_threshold: float = 0.50
    min_margin: float = 0.15
    min_coverage: float = 0.60
    auto_map_enabled: bool = False
    lexical_strategy: str = "combined"  # or "baseline"
    pruning_threshold: int = 128
    shortlist: int = 32
    top_k: int = 10
    sample_size: int = 20
    exact_cap: int = 0  # 0: always exact; else distinct counts above it are estimated
    seed: int = 42
    limits: Limits = field(default_factory=Limits)

    def __post_init__(self):
        if set(self.weights) - set(WEIGHTS) or any(not 0 <= w <= 1 for w in self.weights.values()) or sum(self.weights.values()) <= 0:
            raise EngineError("INVALID_CONFIG", "weights are known components within 0 and 1")
        if not 0 <= self.low_threshold <= self.review_threshold <= self.auto_map_threshold <= 1:
            raise EngineError("INVALID_CONFIG", "thresholds ascend within 0 and 1")
        if not 0 <= self.min_margin <= 1 or not 0 <= self.min_coverage <= 1 or self.min_evidence < 1 or self.shortlist < 1 or self.top_k < 1:
            raise EngineError("INVALID_CONFIG", "margins, coverage and counts are in range")
        if self.lexical_strategy not in ("combined", "baseline"):
            raise EngineError("INVALID_CONFIG", "unknown lexical strategy")

    def weight(self, name: str) -> float:
        return self.weights.get(name, 0.0)

    def fingerprint(self, options: dict[str, str], *names) -> str:
        return fingerprint("config", self, options, list(names))


@dataclass(frozen=True)
class SourceColumn:
    """Identity is positional: duplicate headers are legal."""

    id: str
    position: int
    header: str
    normalized: str


@dataclass(frozen=True)
class SourceStructure:
    format: str
    columns: tuple[SourceColumn, ...]
    header_present: bool
    charset: str = ""
    delimiter: str = ""
    warnings: tuple[str, ...] = ()
    attributes: dict[str, str] = field(default_factory=dict)


def redacted(length: int) -> str:
    return f"<redacted:length={length}>"
