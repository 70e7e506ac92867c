"""A delimited candle file as DataFrames: accepted candles, malformed rows, coverage and identity.

Files are read in byte ranges: one pass counts line feeds per range, small prefix sums number the lines, and a second pass reads
the ranges, so a file of any size gets physical line numbers without a single task reading it whole. Line feeds inside quotes belong
to their record. Blank lines are skipped but counted in the numbering.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import netformat, zones
from tickloom.functions.numbers import with_decimals
from tickloom.functions.plans import settled
from tickloom.operators import malformed, timestamps

RANGE_BYTES = 64 * 1024 * 1024
READ_BYTES = 4 * 1024 * 1024
PRICES = ("open", "high", "low", "close", "volume")
#: Formats tried for a combined timestamp without a format of its own, in this order.
COMBINED_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-ddTHH:mm:ss'Z'", "O")
TIME_FORMATS = "HH:mm or HH:mm:ss"


class ScanError(ValueError):
    """A file that can't be read as a whole; ``code`` is the fatal code."""

    def __init__(self, code: str, reason: str):
        super().__init__(reason)
        self.code, self.reason = code, reason


@dataclass(frozen=True)
class CsvOptions:
    """How a file is written. ``timestamp_column`` is a header name or a number from 1."""

    has_header: bool = False
    delimiter: str | None = None
    date_format: str | None = None
    time_format: str | None = None
    timestamp_format: str | None = None
    timestamp_column: str | None = None
    tz_offset: str = zones.DEFAULT_OFFSET

    def __post_init__(self) -> None:
        if (self.date_format is None) != (self.time_format is None):
            raise ScanError("INVALID_ARGUMENT", "a date format and a time format go together")
        if self.timestamp_format and self.date_format:
            raise ScanError("INVALID_ARGUMENT", "a timestamp format excludes date and time formats")
        if self.timestamp_column and not self.has_header and not self.timestamp_column.isdigit():
            raise ScanError("INVALID_ARGUMENT", "without a header the timestamp column is a number")
        if self.timestamp_column and not self.has_header and not self.timestamp_format:
            raise ScanError("INVALID_ARGUMENT", "a timestamp column without a header needs a format")
        offset_seconds(self.tz_offset)


def offset_seconds(text: str) -> int:
    """Seconds of ``+HH:mm`` or ``-HH:mm`` within 14 hours."""
    m = re.fullmatch(r"([+-])(\d{2}):(\d{2})", text)
    seconds = m and (int(m[2]) * 3600 + int(m[3]) * 60) * (-1 if m[1] == "-" else 1)
    if m is None or int(m[3]) > 59 or abs(seconds) > zones.MAX_OFFSET_S:
        raise ScanError("INVALID_ARGUMENT", f"{text!r} is no offset of at most 14 hours")
    return seconds


def offset_text(seconds: int) -> str:
    return f"{'-' if seconds < 0 else '+'}{abs(seconds) // 3600:02d}:{abs(seconds) // 60 % 60:02d}"


def parse_delimiter(text: str) -> str:
    """comma, semicolon, tab or any single character."""
    named = malformed.DELIMITERS.get(text.lower(), text)
    if len(named) != 1:
        raise ScanError("INVALID_ARGUMENT", f"{text!r} is no delimiter")
    return named


def detect_delimiter(first_line: str) -> str:
    """The one of comma, semicolon and tab most frequent outside quotes; a comma for a blank line; an error for a tie or none."""
    if not first_line.strip():
        return ","
    bare = re.sub(r'"(?:[^"]|"")*"', "", first_line)
    counts = sorted(((bare.count(d), d) for d in malformed.DELIMITERS.values()), reverse=True)
    if counts[0][0] == 0 or counts[0][0] == counts[1][0]:
        raise ScanError("INVALID_STRUCTURE", "the delimiter can't be told from the first line")
    return counts[0][1]


def split_line(line: str, delimiter: str) -> list[str]:
    """Fields of one line, quotes removed."""
    out, text, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if c == '"' and quoted and line[i + 1 : i + 2] == '"':
            text, i = text + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif c == delimiter and not quoted:
            out.append(text)
            text = ""
        else:
            text += c
        i += 1
    return [*out, text]


@dataclass(frozen=True)
class Layout:
    """Positions of the fields: (timestamp,) or (date, time), then the five numbers."""

    stamp: tuple[int, ...]
    numbers: tuple[int, ...]
    column: str | None = None

    @property
    def combined(self) -> bool:
        return len(self.stamp) == 1

    @property
    def width(self) -> int:
        return max(*self.stamp, *self.numbers) + 1


def resolve_layout(first: list[str], options: CsvOptions) -> Layout:
    """From the header's names, trimmed and in any case, or from the order of a file without one."""
    if not options.has_header:
        if options.timestamp_column:
            at = int(options.timestamp_column) - 1
            if at < 0:
                raise ScanError("INVALID_ARGUMENT", "columns are counted from 1")
            return Layout((at,), tuple(range(at + 1, at + 6)), options.timestamp_column)
        return Layout((0, 1), tuple(range(2, 7)))
    names = [n.strip().lower() for n in first]
    if len(set(names)) != len(names):
        raise ScanError("INVALID_STRUCTURE", "a header name occurs twice")

    def place(name: str) -> int:
        if name.lower() not in names:
            raise ScanError("INVALID_STRUCTURE", f"column {name} is absent")
        return names.index(name.lower())

    numbers = tuple(map(place, PRICES))
    if options.timestamp_column:
        chosen = options.timestamp_column
        at = int(chosen) - 1 if chosen.isdigit() and chosen.lower() not in names else place(chosen)
        if not 0 <= at < len(names):
            raise ScanError("INVALID_STRUCTURE", f"column {chosen} is absent")
        return Layout((at,), numbers, chosen)
    if "timestamp" in names and not options.date_format:
        return Layout((place("timestamp"),), numbers, "Timestamp")
    return Layout((place("date"), place("time")), numbers)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def _files(path: str) -> list[tuple[str, int]]:
    fs, at = _filesystem(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise ScanError("SOURCE_UNAVAILABLE", f"{os.path.basename(path)} doesn't exist")
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    prefix = path[: path.index("://") + 3] if "://" in path else ""
    return sorted((prefix + f.path if prefix and "://" not in f.path else f.path, f.size) for f in found if f.type == pafs.FileType.File and not os.path.basename(f.path).startswith(("_", ".")))


#: Why a line can't be read at all.
ENCODING, QUOTING = "encoding", "quoting"


def numbered_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, source_line, text, broken) of every record of a file or folder, numbered by the physical line on which it begins.

    Line feeds between an odd and an even quote belong to the record. A final carriage return and a leading byte order mark are removed.
    ``broken`` says what is wrong with the bytes: no UTF-8, or a quote that is open where the file ends. Each range is read twice: a first
    pass counts line feeds and quotes, so that a range knows its first line's number and whether it begins inside quotes."""
    ranges = [(p, start, min(start + range_bytes, size)) for p, size in _files(path) for start in range(0, size, range_bytes)]
    table = spark.createDataFrame(ranges, "path string, start bigint, stop bigint").repartition(max(1, len(ranges)))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                fs, at = _filesystem(r["path"])
                with fs.open_input_file(at) as f:
                    f.seek(r["start"])
                    left, feeds, quotes = r["stop"] - r["start"], 0, 0
                    while left > 0 and (block := f.read(min(left, READ_BYTES))):
                        feeds, quotes, left = feeds + block.count(b"\n"), quotes + block.count(b'"'), left - len(block)
                r["feeds"], r["quotes"] = feeds, quotes
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("start", "stop", "feeds", "quotes"))]))

    fed = table.mapInArrow(counts, "path string, start bigint, stop bigint, feeds bigint, quotes bigint")
    # One row per range of a file; the window over a file's ranges is as small as its number of ranges.
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = fed.select("path", "start", "stop", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("feeds", "quotes")))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, at = _filesystem(r["path"])
                with fs.open_input_file(at) as f:
                    yield from _batches(r["path"], _records(f, r["start"], r["stop"], r["feeds"] + 1, r["quotes"] % 2 == 1))

    return placed.repartition(max(1, len(ranges)), "path", "start").mapInArrow(lines, "path string, source_line bigint, text string, broken string")


def _records(f: pa.NativeFile, start: int, stop: int, number: int, quoted: bool) -> Iterator[tuple[int, bytes, bool]]:
    """(line number, bytes, whether a quote is left open) of the records that begin in the range; the last is read to its end beyond it.

    ``number`` is that of the line in which the range begins, ``quoted`` whether its first byte lies between quotes."""
    before = b"\n"
    if start:
        f.seek(start - 1)
        before = f.read(1)
    else:
        f.seek(0)
    skip = quoted or before != b"\n"  # the rest of a record that began earlier
    position, record, first, rest = start, [], number, b""
    while True:
        block = f.read(READ_BYTES)
        parts = (rest + block).split(b"\n")
        rest = parts.pop() if block else b""
        for i, part in enumerate(parts):
            last = not block and i == len(parts) - 1
            if last and not part and not record:
                return
            if not record and not skip and position >= stop:
                return
            record.append(part)
            quoted ^= part.count(b'"') % 2 == 1
            position, number = position + len(part) + 1, number + 1
            if not quoted or last:
                if not skip:
                    yield first, b"\n".join(record), quoted
                skip, record, first = False, [], number
            if skip and position >= stop and not quoted:
                return
        if not block:
            return


def _batches(path: str, records: Iterator[tuple[int, bytes, bool]]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(records, 50_000)):
        texts, broken = [], []
        for number, raw, open_quote in part:
            raw = raw.removesuffix(b"\r")
            try:
                text, wrong = raw.decode(), QUOTING if open_quote else None
            except UnicodeDecodeError:
                text, wrong = raw.decode("utf-8", "replace"), ENCODING
            texts.append(text.removeprefix("\ufeff") if number == 1 else text)
            broken.append(wrong)
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([n for n, _, _ in part], pa.int64()), pa.array(texts), pa.array(broken, pa.string())], names=["path", "source_line", "text", "broken"])


@dataclass(frozen=True)
class SourceIdentity:
    """What a source was when it was read. A folder's hash is that of its files' names and hashes in order of name."""

    file_name: str
    byte_size: int
    sha256: str
    modified: str = ""


def safe_base_name(path: str) -> str:
    return os.path.basename(path.rstrip("/").replace("\\", "/")) or "source"


def _stamped(path: str) -> tuple[int, str]:
    """Size and times of last change of a file or of a folder's files."""
    files = _files(path)
    times = [str(fs.get_file_info(at).mtime_ns) for fs, at in (_filesystem(p) for p, _ in files)]
    return sum(n for _, n in files), ",".join(times) if len(times) < 100 else hashlib.sha256(",".join(times).encode()).hexdigest()


def fingerprint(spark: SparkSession, path: str) -> SourceIdentity:
    """One task hashes each file, as SHA-256 runs through a file in order; the driver reads no data."""
    try:
        files, (size, modified) = _files(path), _stamped(path)
    except OSError as e:
        raise ScanError("SOURCE_UNAVAILABLE", f"{safe_base_name(path)} can't be read") from e

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, out = batch.column(0).to_pylist(), []
            for name in names:
                fs, at = _filesystem(name)
                digest = hashlib.sha256()
                with fs.open_input_stream(at) as f:
                    while block := f.read(READ_BYTES):
                        digest.update(block)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(out)], names=["path", "sha"])

    table = spark.createDataFrame([(p,) for p, _ in files], "path string").repartition(max(1, len(files)))
    rows = sorted((r["path"], r["sha"]) for r in table.mapInArrow(hashed, "path string, sha string").collect())  # one per file
    if len(rows) == 1:
        whole = rows[0][1]
    else:
        whole = hashlib.sha256("".join(f"{os.path.basename(p)}:{h}\n" for p, h in rows).encode()).hexdigest()
    return SourceIdentity(safe_base_name(path), size, whole, modified)


@dataclass
class Prepared:
    """A scanned file. ``rows`` is kept for the checks that follow; call ``release`` when done."""

    candles: DataFrame
    malformed: DataFrame
    identity: SourceIdentity
    examined: int
    accepted: int
    rejected: int
    first_ts: object
    last_ts: object
    delimiter: str
    layout: Layout
    options: CsvOptions
    rows: DataFrame = field(repr=False)

    def release(self) -> None:
        self.rows.unpersist()


def _first_line(path: str) -> str:
    files = _files(path)
    if not files:
        return ""
    fs, at = _filesystem(files[0][0])
    with fs.open_input_stream(at) as f:
        head = b""
        while b"\n" not in head and (block := f.read(65_536)):
            head += block
    return head.split(b"\n", 1)[0].removesuffix(b"\r").decode("utf-8-sig", "replace")


def _stamp_parts(fields: Column, layout: Layout, options: CsvOptions) -> Column:
    """The parts of the canonical form of a row's timestamp by the first of its formats that fits, or null."""
    get = lambda i: F.btrim(F.get(fields, F.lit(i)))
    if layout.combined:
        formats = [options.timestamp_format] if options.timestamp_format else list(COMBINED_FORMATS)
        text = get(layout.stamp[0])
    else:
        text = F.concat_ws(" ", get(layout.stamp[0]), get(layout.stamp[1]))
        formats = [f"{options.date_format} {options.time_format}"] if options.date_format else [f"{timestamps.DEFAULT_DATE} HH:mm", f"{timestamps.DEFAULT_DATE} HH:mm:ss"]
    parts = None
    for pattern in formats:
        regex, replacement = netformat.translate(pattern, zone_suffix=False)
        value = F.split(F.regexp_replace(text, regex, replacement), r"\|", -1)
        parts = F.when(text.rlike(regex), value) if parts is None else parts.when(text.rlike(regex), value)
    return parts


def parsed(lines: DataFrame, layout: Layout, delimiter: str, options: CsvOptions) -> DataFrame:
    """The lines (source_line, text and whatever else) with ts, the five numbers, their texts, ``reason`` (null for a good row) and ``_width``."""
    rows = lines.withColumn("fields", F.transform(malformed.cells(F.col("text"), F.lit(delimiter)), malformed._content))
    rows = rows.withColumn("_misquoted", F.exists("fields", lambda c: c.isNull()))
    rows = timestamps.with_parts(rows.withColumn("_parts", _stamp_parts(F.col("fields"), layout, options)), "_parts")
    rows = zones.with_offset(rows, "_zone_text", "_explicit")
    offset = F.coalesce("_explicit", F.lit(offset_seconds(options.tz_offset)))
    rows = rows.withColumn("ts", F.timestamp_micros(F.col("_us") - offset.cast("bigint") * 1_000_000))
    rows = rows.withColumns({f"{name}_text": F.btrim(F.get("fields", F.lit(at))) for name, at in zip(PRICES, layout.numbers, strict=True)})
    rows = with_decimals(rows, {name: F.col(f"{name}_text") for name in PRICES})
    bad = F.when(F.col("ts").isNull(), "The timestamp doesn't parse.")
    for name in PRICES:
        bad = bad.when(F.col(name).isNull(), f"The {name} is no decimal number.")
    rows = rows.withColumn("reason", bad).withColumn("_width", F.size("fields")).drop("fields", "_parts", "_us", "_unit", "_zone_text", "_explicit")
    return settled(rows, "reason")


def scan(spark: SparkSession, path: str, options: CsvOptions) -> Prepared:
    """Reads a file, or the files of a folder that are all written alike, once and keeps the parsed rows.

    A line shorter than the layout, bytes that are no UTF-8 and a quote out of place are fatal; a value that doesn't parse
    makes its row malformed; further columns are ignored. A header without rows gives empty DataFrames. Lines are numbered within
    their file. Runs jobs: the files' hashes, and the rows' totals."""
    identity = fingerprint(spark, path)
    head = _first_line(path)
    delimiter = parse_delimiter(options.delimiter) if options.delimiter else detect_delimiter(head)
    layout = resolve_layout(split_line(head, delimiter), options)
    lines = numbered_lines(spark, path).where((F.btrim("text") != "") | F.col("broken").isNotNull())
    if options.has_header:
        lines = lines.where((F.col("source_line") > 1) | F.col("broken").isNotNull())
    rows = parsed(lines, layout, delimiter, options).persist(StorageLevel.MEMORY_AND_DISK)
    good = F.col("reason").isNull()
    at = F.when(good, F.col("ts"))
    short = F.col("_width") < layout.width
    first = lambda test: F.min(F.when(test, F.col("source_line")))
    totals = rows.agg(
        F.count("*").alias("examined"), F.count(F.when(good, 1)).alias("accepted"), F.count(F.when(~good, 1)).alias("rejected"), first(short).alias("line"),
        first(F.col("broken") == ENCODING).alias("encoding"), first((F.col("broken") == QUOTING) | F.col("_misquoted")).alias("quoting"), F.min(at).alias("first"), F.max(at).alias("last"),
    ).first()
    for code, name, reason in (("INVALID_ENCODING", "encoding", "is no UTF-8"), ("INVALID_CSV", "quoting", "has a quote out of place"), ("INVALID_STRUCTURE", "line", "has too few columns")):
        if totals[name] is not None:
            rows.unpersist()
            raise ScanError(code, f"line {totals[name]} {reason}")
    if (identity.byte_size, identity.modified) != _stamped(path):
        rows.unpersist()
        raise ScanError("SOURCE_CHANGED", f"{identity.file_name} changed while it was read")
    kept = rows.where(good).select("ts", *PRICES, "source_line", *(f"{n}_text" for n in PRICES[:4]))
    lost = rows.where(~good).select("source_line", "ts", "reason", F.lit("").alias("raw_text"))
    return Prepared(kept, lost, identity, totals["examined"], totals["accepted"], totals["rejected"], totals["first"], totals["last"], delimiter, layout, options, rows)
