"""Human feedback as append-only events, aggregated into evidence by key.

Events hold no cell values and no raw headers. An event that is recorded twice counts once; the same id with another
body is refused.
"""

from __future__ import annotations

import fcntl
import json
import math
import os
import re
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EngineError, fingerprint

KEY = ("schema_id", "schema_version", "schema_fingerprint", "target", "source_name", "locale", "context")
EVENT_TYPES = ("CONFIRMED", "REJECTED", "CORRECTED")
MAX_EVENTS, MAX_BYTES, MAX_LINE = 100_000, 10 << 20, 16 << 10
EVENT_SCHEMA = "feedback_id string, timestamp string, type string, source_column string, position int, header_length int, tokens int, source_name string, schema_id string, schema_version string, schema_fingerprint string, locale string, context string, suggested string, human string, previous_score double, provenance string, engine_version string, config_fingerprint string"


@dataclass(frozen=True)
class Feedback:
    feedback_id: str
    timestamp: str
    type: str
    source_column: str
    position: int
    header_length: int
    tokens: int
    source_name: str
    schema_id: str
    schema_version: str
    schema_fingerprint: str
    locale: str
    context: str
    suggested: str
    human: str
    previous_score: float | None = None
    provenance: str = "human"
    engine_version: str = ""
    config_fingerprint: str = ""

    def __post_init__(self):
        def need(ok: bool) -> None:
            if not ok:
                raise EngineError("INVALID_FEEDBACK", "the event is not consistent")

        need(self.type in EVENT_TYPES and bool(self.feedback_id.strip()) and bool(self.source_name.strip()))
        need(bool(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?Z", self.timestamp)))
        try:
            datetime.fromisoformat(self.timestamp.replace("Z", "+00:00"))
        except ValueError:
            need(False)
        need(self.position >= 0 and self.header_length >= 0 and self.tokens >= 0)
        need(self.previous_score is None or 0 <= self.previous_score <= 1)
        if self.type == "CONFIRMED":
            need(bool(self.human) and self.suggested in ("", self.human))
        elif self.type == "REJECTED":
            need(bool(self.suggested) and not self.human)
        else:
            need(bool(self.suggested) and bool(self.human) and self.suggested != self.human)


def votes(events: DataFrame) -> DataFrame:
    """One row for each vote: a correction is one against the suggestion and one for the human's choice."""
    vote = lambda target, kind: F.struct(F.col(target).alias("target"), F.lit(kind).alias("kind"))
    both = F.array(vote("suggested", "corrected_from"), vote("human", "corrected_to"))
    each = F.when(F.col("type") == "CONFIRMED", F.array(vote("human", "confirmed"))).when(F.col("type") == "REJECTED", F.array(vote("suggested", "rejected"))).otherwise(both)
    return events.withColumn("vote", F.explode(each)).select(*[k for k in KEY if k != "target"], "timestamp", "vote.target", "vote.kind")


def strength(positive: Column, negative: Column) -> dict[str, Column]:
    """signed, score, reliability from the counts for and against."""
    total = positive + negative
    signed = (positive - negative) / (total + 2.0)
    support = F.least(F.lit(1.0), F.log1p(total.cast("double")) / math.log(9))
    return {"signed": signed, "score": F.when(signed > 0, 1.0).when(signed < 0, 0.0).otherwise(0.5), "reliability": support * F.abs(signed)}


def snapshot(events: DataFrame) -> DataFrame:
    """Evidence for each key: counts by kind, latest times, signed strength, score and reliability."""
    kinds = ("confirmed", "rejected", "corrected_to", "corrected_from")
    good = F.col("kind").isin("confirmed", "corrected_to")
    counted = votes(events).groupBy(*KEY).agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.max(F.when(good, F.col("timestamp"))).alias("last_positive"), F.max(F.when(~good, F.col("timestamp"))).alias("last_negative")
    )
    return counted.withColumns(strength(F.col("confirmed") + F.col("corrected_to"), F.col("rejected") + F.col("corrected_from")))


class KnowledgeBase:
    """Events in memory; ``NO_KNOWLEDGE`` while there is none."""

    def __init__(self):
        self._events: dict[str, Feedback] = {}

    def record(self, event: Feedback) -> None:
        known = self._events.get(event.feedback_id)
        if known is not None and known != event:
            raise EngineError("FEEDBACK_CONFLICT", "the id stands for another event")
        if known is None:
            if len(self._events) >= MAX_EVENTS:
                raise EngineError("FEEDBACK_LIMIT", "too many events")
            self._store(event)
            self._events[event.feedback_id] = event

    def _store(self, event: Feedback) -> None:
        """For bases that persist."""

    @property
    def events(self) -> list[Feedback]:
        return [self._events[k] for k in sorted(self._events)]

    @property
    def id(self) -> str:
        """Independent of the order of recording."""
        return fingerprint("knowledge", self.events) if self._events else "NO_KNOWLEDGE"

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(e).values()) for e in self.events], EVENT_SCHEMA)


class JsonLinesKnowledgeBase(KnowledgeBase):
    """Events in a file of JSON lines: appended under a lock and synced; damaged files are refused."""

    def __init__(self, path: str):
        super().__init__()
        self.path = path
        if os.path.islink(path):
            raise EngineError("FEEDBACK_FILE_INVALID", "a link is not accepted")
        if os.path.exists(path):
            self._load()

    def _load(self) -> None:
        if os.path.getsize(self.path) > MAX_BYTES:
            raise EngineError("FEEDBACK_LIMIT", "the file is too large")
        with open(self.path, "rb") as f:
            data = f.read()
        if data and not data.endswith(b"\n"):
            raise EngineError("FEEDBACK_FILE_INVALID", "the last line is cut off")
        for line in data.splitlines():
            try:
                event = Feedback(**json.loads(line))
            except (ValueError, TypeError):
                raise EngineError("FEEDBACK_FILE_INVALID", "a line is not an event") from None
            if len(line) > MAX_LINE or event.feedback_id in self._events or len(self._events) >= MAX_EVENTS:
                raise EngineError("FEEDBACK_FILE_INVALID", "a line is too long or repeated")
            self._events[event.feedback_id] = event

    def _store(self, event: Feedback) -> None:
        line = json.dumps(asdict(event), ensure_ascii=False).encode() + b"\n"
        size = os.path.getsize(self.path) if os.path.exists(self.path) else 0
        if len(line) > MAX_LINE or size + len(line) > MAX_BYTES:
            raise EngineError("FEEDBACK_LIMIT", "the event or the file is too large")
        at = os.open(self.path, os.O_WRONLY | os.O_APPEND | os.O_CREAT | os.O_NOFOLLOW, 0o600)
        with os.fdopen(at, "ab") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.write(line)
            f.flush()
            os.fsync(f.fileno())
