"""Named immutable benchmarks: a JSON snapshot beside the candles as Parquet and a copy of the source file."""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from tickloom.operators import scoring
from tickloom.sources.csv_scan import CsvOptions, fingerprint
from tickloom.sources.storage import Folder
from tickloom.validation import NOT_COMPLETED, Fatal, Report

CONTRACT_VERSION = 1


def safe_name(name: str) -> str:
    """Lower case, blanks as dashes, letters, digits, dashes and underscores only, no repeated or outer dashes."""
    text = unicodedata.normalize("NFC", name).strip().lower()
    text = re.sub(r"-{2,}", "-", re.sub(r"[^a-z0-9_-]", "", re.sub(r"\s+", "-", text))).strip("-")
    if not text:
        raise Fatal("INVALID_ARGUMENT", f"{name!r} is no benchmark name")
    return text


@dataclass(frozen=True)
class Snapshot:
    name: str
    instrument: str
    timeframe: str
    profile: str
    source: dict
    options: dict
    coverage: dict
    counts: dict
    scores: dict
    average: dict
    contract_version: int = CONTRACT_VERSION


def exact(value: Fraction | None) -> dict | None:
    return None if value is None else {"ratio": f"{value.numerator}/{value.denominator}", "rounded": scoring.shown(value)}


def read_exact(data: dict | None) -> Fraction | None:
    """The ratio, refused if it rounds to something else than what is stored beside it."""
    if data is None:
        return None
    value = Fraction(data["ratio"])
    if scoring.shown(value) != data["rounded"]:
        raise Fatal("INVALID_STRUCTURE", "A stored score doesn't agree with its rounding.")
    return value


def eligible(report: Report) -> str | None:
    """Why a report can't become a benchmark, or null."""
    if report.score is None or report.score.average is None:
        return "A benchmark needs a score."
    if len(report.checks) != len(scoring.METRICS) or any(state == NOT_COMPLETED for state, _ in report.checks.values()):
        return "A benchmark needs all six checks."
    return None


def snapshot(name: str, instrument: str, report: Report) -> Snapshot:
    p, o = report.prepared, report.prepared.options
    options = {k: getattr(o, k) for k in CsvOptions.__dataclass_fields__}
    scores = {m.metric: {"state": m.state, "count": m.count, "population": m.population, "score": exact(m.score)} for m in report.score.metrics}
    return Snapshot(safe_name(name), instrument, str(report.timeframe), report.profile, {k: v for k, v in vars(p.identity).items() if k != "modified"}, options, {"examined": p.examined, "accepted": p.accepted, "malformed": p.rejected}, dict(report.counts), scores, exact(report.score.average))


class BenchmarkStore:
    """One folder per benchmark below ``root``, any path that Spark takes. Saving fails if the name is taken and leaves nothing behind
    if it breaks off."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Folder(spark, root)

    def exists(self, name: str) -> bool:
        return self.files.exists(f"{safe_name(name)}/benchmark.json")

    def names(self) -> list[str]:
        return sorted((n for n in self.files.names() if not n.startswith(".") and self.files.exists(f"{n}/benchmark.json")), key=str.lower)

    def save(self, name: str, instrument: str, report: Report, source_path: str) -> Snapshot:
        if why := eligible(report):
            raise Fatal("INVALID_ARGUMENT", why)
        if self.exists(name):
            raise Fatal("INVALID_ARGUMENT", f"Benchmark {safe_name(name)} exists already.")
        if fingerprint(self.spark, source_path).sha256 != report.prepared.identity.sha256:
            raise Fatal("SOURCE_CHANGED", "The source changed during the run.")
        made, staged = snapshot(name, instrument, report), f".{safe_name(name)}-{uuid.uuid4().hex}"
        self.files.make(staged)
        try:
            report.prepared.candles.write.parquet(self.files.path(f"{staged}/candles"))
            self.files.copy_from(os.path.abspath(source_path) if "://" not in source_path else source_path, f"{staged}/source.csv")
            self.files.write(f"{staged}/benchmark.json", json.dumps(vars(made), indent=1))
            if not self.files.rename(staged, safe_name(name)):
                raise Fatal("INVALID_ARGUMENT", f"Benchmark {safe_name(name)} exists already.")
        except BaseException:
            self.files.delete(staged)
            raise
        return made

    def load(self, name: str) -> tuple[Snapshot, DataFrame]:
        """The snapshot and its candles; the stored source must still have its fingerprint."""
        if not self.exists(name):
            raise Fatal("INVALID_ARGUMENT", f"There is no benchmark {safe_name(name)}.")
        at = safe_name(name)
        data = json.loads(self.files.read(f"{at}/benchmark.json"))
        if data.get("contract_version") != CONTRACT_VERSION or set(data) != set(Snapshot.__dataclass_fields__):
            raise Fatal("INVALID_STRUCTURE", "The snapshot is of another version.")
        for s in data["scores"].values():
            read_exact(s["score"])
        read_exact(data["average"])
        if fingerprint(self.spark, self.files.path(f"{at}/source.csv")).sha256 != data["source"]["sha256"]:
            raise Fatal("SOURCE_CHANGED", "The benchmark's source was changed.")
        return Snapshot(**data), self.spark.read.parquet(self.files.path(f"{at}/candles"))

    def delete(self, name: str) -> None:
        if not self.exists(name):
            raise Fatal("INVALID_ARGUMENT", f"There is no benchmark {safe_name(name)}.")
        self.files.delete(safe_name(name))
