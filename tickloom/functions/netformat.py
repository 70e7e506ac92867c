"""Translation of .NET date and time patterns to regular expressions, done once for each distinct pattern.

A translated pattern is a regular expression and a replacement that turns a matching text into the canonical form
``yyyy|MM|dd|HH|mm|ss|fraction|AM/PM|zone`` with empty places for absent parts, so each row needs one regular-expression pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = ("y", "M", "d", "H", "m", "s", "f", "t", "z")
#: Zone texts: Z, UTC and offsets, or an abbreviation.
ZONE = r"[Zz]|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?(?::\d{2})?|[A-Za-z]{2,5}"
ROUND_TRIP = "yyyy-MM-ddTHH:mm:ss.fffffffK"

TRANSLATED = "pattern string, regex string, canonical string"

_TOKENS = re.compile(r"'[^']*'|\\.|yyyy|MMMM|MMM|MM|M|dd|d|HH|H|hh|h|mm|m|ss|s|[.,]?F{1,7}|f{1,7}|tt|zzz|zz|z|K|.", re.S)
_PARTS = {
    "yyyy": ("y", r"\d{4}"),
    "MMM": ("M", r"[A-Za-z]{3}"),
    "MMMM": ("M", r"[A-Za-z]{3,9}"),
    "MM": ("M", r"\d{2}"),
    "M": ("M", r"\d{1,2}"),
    "dd": ("d", r"\d{2}"),
    "d": ("d", r"\d{1,2}"),
    "HH": ("H", r"\d{2}"),
    "H": ("H", r"\d{1,2}"),
    "hh": ("H", r"\d{2}"),
    "h": ("H", r"\d{1,2}"),
    "mm": ("m", r"\d{2}"),
    "m": ("m", r"\d{1,2}"),
    "ss": ("s", r"\d{2}"),
    "s": ("s", r"\d{1,2}"),
    "tt": ("t", r"[AaPp][Mm]"),
    "zzz": ("z", r"[+-]\d{2}:\d{2}"),
    "zz": ("z", r"[+-]\d{2}"),
    "z": ("z", r"[+-]\d{1,2}"),
    "K": ("z", r"(?:[Zz]|[+-]\d{2}:\d{2})?"),
}


def translate(pattern: str, zone_suffix: bool = True) -> tuple[str, str]:
    """(regex, canonical replacement) of a .NET custom pattern or ``O``.

    ``zone_suffix`` also accepts a zone after a pattern that has no zone part. A part named twice takes its first place.
    Text in quotes or after a backslash is literal; other letters than the listed ones are literal too."""
    regex, groups = "", {}
    for token in _TOKENS.findall(ROUND_TRIP if pattern in ("O", "o") else pattern):
        name, body = _PARTS.get(token, ("", ""))
        if re.fullmatch(r"f+", token):
            name, body = "f", rf"\d{{{len(token)}}}"
        elif re.fullmatch(r"[.,]?F+", token):
            regex += rf"(?:{re.escape(token[0])}" if token[0] in ".," else "(?:"
            groups.setdefault("f", len(groups) + 1)
            regex += rf"(\d{{1,{token.count('F')}}}))?"
            continue
        if name and name not in groups:
            groups[name] = len(groups) + 1
            regex += f"({body})"
        elif name:
            regex += f"(?:{body})"
        else:
            literal = token[1:-1] if token[:1] == "'" and len(token) > 1 else token[1:] if token[:1] == "\\" and len(token) > 1 else token
            regex += re.escape(literal)
    if zone_suffix and "z" not in groups:
        groups["z"] = len(groups) + 1
        regex += rf"(?:\s*({ZONE}))?"
    return f"^{regex}$", "|".join(f"${groups[k]}" if k in groups else "" for k in PLACES)


def patterns(frame: DataFrame, column: str, zone_suffix: bool) -> DataFrame:
    """The distinct patterns of ``column``, translated."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [translate(p, zone_suffix) for p in f["pattern"]]
            yield pd.DataFrame({"pattern": f["pattern"], "regex": [r for r, _ in done], "canonical": [c for _, c in done]})

    ids = frame.select(F.col(column).alias("pattern")).where(F.col("pattern").isNotNull()).distinct()
    return ids.mapInPandas(run, TRANSLATED)


def canonical(text: Column, options: list[tuple[Column | str, Column | str]]) -> Column:
    """The canonical form of ``text`` by the first (regex, replacement) that matches; a text that none matches stays as it is.

    Each option is one pass over what the option before it left: a canonical form holds bars, which no notation but the first may match,
    so a form once found passes through. A text that has a bar itself is null."""
    out = F.when(~text.contains("|"), text)
    for regex, replacement in options:
        out = F.regexp_replace(out, regex if isinstance(regex, Column) else F.lit(regex), replacement if isinstance(replacement, Column) else F.lit(replacement))
    return out
