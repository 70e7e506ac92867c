"""Transport-neutral run API: submit, status, result, export, retry. Driver-side state only; the data stays in Spark."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from fractions import Fraction
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import SparkSession

from tickloom.functions.plans import Scope, scope
from tickloom.operators import comparison, scoring
from tickloom.sinks import reports
from tickloom.sources.benchmark_store import BenchmarkStore
from tickloom.sources.calendar_json import CalendarError, load_calendar
from tickloom.sources.csv_scan import CsvOptions, safe_base_name
from tickloom.validation import Fatal, Report, Timeframe, validate

VALIDATE, ESTABLISH, COMPARE = "validate", "establish", "compare"
PENDING, RUNNING, CLEAN, WITH_FINDINGS, FAILED = "Pending", "Running", "CompletedClean", "CompletedWithFindings", "Failed"
#: The allowed transitions of a run, and how an export may look.
ALLOWED = {PENDING: (RUNNING, FAILED), RUNNING: (CLEAN, WITH_FINDINGS, FAILED), FAILED: (PENDING,), CLEAN: (), WITH_FINDINGS: ()}
CONCISE, DETAILED, JSON_V2 = "ConciseText", "DetailedText", "JsonV2"
#: The concise export's labels, of which one differs from the command line's.
CONCISE_LABELS = ("Missing candles", "Duplicate records", "Invalid OHLC", "Closed market records", "Time gaps", "Malformed rows")
_SEPARATOR = "\x1f"


@dataclass(frozen=True)
class RunOptions:
    csv: CsvOptions = field(default_factory=CsvOptions)
    market: str = "forex"
    calendar: str | None = None
    timeframe: str | None = None
    report_version: int = 2
    score: bool = False
    score_weights: str | None = None
    instrument: str | None = None
    benchmark: str | None = None
    tolerances: str | None = None


def check_options(operation: str, o: RunOptions) -> None:
    """Raises ``Fatal`` for combinations that make no sense, before a byte is read."""

    def no(reason: str, guidance: str) -> None:
        raise Fatal("INVALID_ARGUMENT", reason, guidance)

    if operation not in (VALIDATE, ESTABLISH, COMPARE):
        no(f"There is no operation {operation}.", "Validate, establish or compare.")
    if o.report_version not in (1, 2):
        no("The report version is not 1 or 2.", "Select 1 or 2.")
    if o.score_weights is not None and not o.score:
        no("Weights were given without scoring.", "Enable scoring.")
    if o.score and o.report_version != 2:
        no("Version 1 has no scores.", "Use report version 2.")
    if operation == VALIDATE:
        if (o.instrument or "").strip() or (o.benchmark or "").strip():
            no("An instrument or benchmark was given for a plain validation.", "Remove it or select another operation.")
    else:
        if not o.score:
            no("Benchmark operations require scoring.", "Enable scoring with report version 2.")
        if not (o.instrument or "").strip() or "/" in o.instrument or "\\" in o.instrument:
            no("Benchmark operations require an instrument without path separators.", "Name the instrument.")
        if not (o.benchmark or "").strip():
            no("Benchmark operations require a benchmark name.", "Name the benchmark.")
    if o.tolerances is not None and operation != COMPARE:
        no("Tolerances were given without a comparison.", "Select the comparison.")
    if o.timeframe is not None and str(Timeframe.parse(o.timeframe)) != o.timeframe:
        no("The timeframe is no canonical code.", "Use a code such as M15, H1 or D1.")
    if o.calendar is not None and o.market != "custom":
        no("A calendar requires the custom market.", "Select the custom market.")
    if o.score_weights is not None:
        try:
            scoring.parse_weights(o.score_weights)
        except ValueError as e:
            no("The weights are invalid.", str(e))


def run_id(sha256: str, operation: str, o: RunOptions) -> str:
    """The same content and options give the same run; a null differs from an empty text."""
    flat = {f"csv.{k}": v for k, v in asdict(o.csv).items()} | {k: v for k, v in asdict(o).items() if k != "csv"}
    parts = [f"{k}={json.dumps(v)}" for k, v in flat.items()]
    return hashlib.sha256(_SEPARATOR.join([sha256, "v1", f"op={operation}", *parts]).encode()).hexdigest()


class UploadStore:
    """Content-addressed files, each written once."""

    def __init__(self, root: str):
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    def store(self, name: str, content: BinaryIO) -> tuple[str, str]:
        """(sha256, path): hashed while copied, then moved to its place."""
        staged, digest = self.root / f".{uuid.uuid4().hex}", hashlib.sha256()
        try:
            with staged.open("wb") as f:
                while block := content.read(1 << 20):
                    digest.update(block)
                    f.write(block)
            folder = self.root / digest.hexdigest()
            folder.mkdir(exist_ok=True)
            existing = next(folder.iterdir(), None)
            if existing is None:
                existing = folder / safe_base_name(name)
                os.replace(staged, existing)
            return digest.hexdigest(), str(existing)
        finally:
            staged.unlink(missing_ok=True)


class RunStore:
    """One JSON file per run, created once and replaced atomically along the allowed transitions."""

    def __init__(self, root: str):
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    def _at(self, run: str) -> Path:
        return self.root / f"{run}.json"

    def create(self, run: str, record: dict) -> bool:
        try:
            with self._at(run).open("x", encoding="utf-8") as f:
                json.dump(record | {"status": PENDING}, f)
            return True
        except FileExistsError:
            return False

    def find(self, run: str) -> dict | None:
        return json.loads(self._at(run).read_text(encoding="utf-8")) if self._at(run).exists() else None

    def move(self, run: str, status: str, **more: object) -> dict:
        record = self.find(run)
        if record is None or status not in ALLOWED[record["status"]]:
            raise ValueError(f"a run can't go from {record and record['status']} to {status}")
        record |= {"status": status, "changed": dt.datetime.now(dt.timezone.utc).isoformat()} | more
        staged = self.root / f".{uuid.uuid4().hex}"
        staged.write_text(json.dumps(record), encoding="utf-8")
        os.replace(staged, self._at(run))
        return record


@dataclass
class Result:
    report: Report
    comparison: reports.Comparison | None = None
    tables: Scope = field(default_factory=Scope)


class ValidationService:
    """Runs are executed when submitted, unless ``enqueue`` hands them to something else."""

    def __init__(self, spark: SparkSession, root: str, enqueue: Callable[[str], None] | None = None):
        self.spark, self.root = spark, Path(root)
        self.uploads, self.runs = UploadStore(str(self.root / "uploads")), RunStore(str(self.root / "runs"))
        self.benchmarks = BenchmarkStore(spark, str(self.root / "benchmarks"))
        self.results: dict[str, Result] = {}
        self.enqueue = enqueue or self.execute

    def submit(self, name: str, content: BinaryIO, operation: str = VALIDATE, options: RunOptions | None = None) -> tuple[str, bool]:
        """(run id, whether an existing run was joined). Rejected options store nothing."""
        options = options or RunOptions()
        check_options(operation, options)
        sha256, path = self.uploads.store(name, content)
        run = run_id(sha256, operation, options)
        record = {"operation": operation, "path": path, "sha256": sha256, "name": safe_base_name(name), "options": asdict(options)}
        if not self.runs.create(run, record):
            return run, True
        self.enqueue(run)
        return run, False

    def status(self, run: str) -> str | None:
        record = self.runs.find(run)
        return record and record["status"]

    def result(self, run: str) -> Result | None:
        return self.results.get(run)

    def retry(self, run: str) -> None:
        """Only a failed run may run again."""
        self.runs.move(run, PENDING)
        self.enqueue(run)

    def execute(self, run: str) -> None:
        record = self.runs.move(run, RUNNING)
        stored = dict(record["options"])
        o = RunOptions(**stored | {"csv": CsvOptions(**stored["csv"])})
        try:
            with scope() as tables:
                made = run_operation(self.spark, record["path"], record["operation"], o, self.benchmarks)
                made.tables = tables
        except Fatal as e:
            tables.remove(self.spark)
            self.runs.move(run, FAILED, code=e.code, reason=e.reason)
        except Exception as e:
            tables.remove(self.spark)
            self.runs.move(run, FAILED, code="VALIDATION_INCOMPLETE", reason=type(e).__name__)
            raise
        else:
            self.results[run] = made
            self.runs.move(run, CLEAN if made.report.clean else WITH_FINDINGS)

    def export(self, run: str, kind: str):
        """Lines of a report of a completed run."""
        made = self.results.get(run)
        if made is None:
            raise Fatal("INVALID_ARGUMENT", "The run has no result.")
        if kind == CONCISE:
            return (f"{label}: {n}" for label, n in zip(CONCISE_LABELS, reports._counts(made.report), strict=True))
        if kind == DETAILED:
            return reports.verbose_text(made.report)
        if kind == JSON_V2:
            return reports.json_v2(made.report, made.comparison)
        raise Fatal("INVALID_ARGUMENT", f"There is no export {kind}.")


def run_operation(spark: SparkSession, path: str, operation: str, o: RunOptions, store: BenchmarkStore) -> Result:
    """Validates, and establishes a benchmark or compares with one."""
    try:
        custom = load_calendar(o.calendar) if o.calendar else None
    except CalendarError as e:
        raise Fatal("INVALID_CALENDAR", str(e)) from e
    weights: dict[str, Fraction] | None = scoring.parse_weights(o.score_weights) if o.score_weights else None
    report = validate(spark, path, o.csv, o.market, custom, o.timeframe, o.score, weights)
    if operation == ESTABLISH:
        store.save(o.benchmark, o.instrument, report, path)
        return Result(report)
    if operation == COMPARE:
        snapshot, candles = store.load(o.benchmark)
        try:
            overrides = comparison.read_overrides(o.tolerances) if o.tolerances else None
        except (ValueError, KeyError, TypeError) as e:
            raise Fatal("INVALID_ARGUMENT", f"The tolerances are invalid: {e}") from e
        return Result(report, reports.Comparison(snapshot, candles, report, o.instrument, overrides))
    return Result(report)


def discard(service: ValidationService) -> None:
    """Removes all that the service stored."""
    for made in service.results.values():
        made.report.prepared.release()
        made.tables.remove(service.spark)
    shutil.rmtree(service.root, ignore_errors=True)


