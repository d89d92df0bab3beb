"""Mixed timestamp notations and zones brought to one unambiguous form.

An ordered cascade of anchored patterns, each parsed strictly, is tried on the value without its outer blanks. The first
pattern that matches decides; if its parts make no valid date or time, the value has no normal form. Local times are
placed in the zone found for the row's site. The cascade runs in Arrow batches: as one native expression it grew beyond what
the optimiser and code generation handle (minutes of planning). The result doesn't depend on the session's time zone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names as they occur in English and German exports.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "januar": 1, "jänner": 1, "februar": 2, "märz": 3, "maerz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12,
    "mär": 3, "okt": 10, "dez": 12,
}

# Offsets in minutes of zone abbreviations. IST is India's.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "IST": 330, "SGT": 480, "JST": 540, "AWST": 480,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_WEEKDAY = r"(?:(?:[Mm]on|[Tt]ue|[Ww]ed|[Tt]hu|[Ff]ri|[Ss]at|[Ss]un)[a-z]*\.?,?\s+)?"
_ZONE = r"(Z|[A-Z]{3,4}|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?)?(?:\[[A-Za-z_/+\-0-9]+\])?"
_AMPM = r"([AaPp])\.?[Mm]\.?"


@dataclass(frozen=True)
class Notation:
    """An anchored pattern and what its groups hold: y, m, d, name (of a month), a, b (in the site's order), H, M, S, f, ap, zone, epoch."""

    name: str
    pattern: str
    groups: tuple[str, ...]


#: Ordered: the first whose pattern matches the whole value decides.
CASCADE = (
    Notation("epoch", r"^(\d{10}|\d{13}|\d{16})$", ("epoch",)),
    Notation("basic_instant", r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?" + _ZONE + "$", ("y", "m", "d", "H", "M", "S", "f", "zone")),
    Notation("basic_date", r"^(\d{4})(\d{2})(\d{2})$", ("y", "m", "d")),
    Notation("iso_date", r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", ("y", "", "m", "d")),
    Notation("iso_instant", r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:[Tt]|\s+)" + _CLOCK + r"\s*" + _ZONE + "$", ("y", "", "m", "d", "H", "M", "S", "f", "zone")),
    Notation("numeric_date", r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})$", ("a", "", "b", "y")),
    Notation("numeric_12h", r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2}),?\s+" + _CLOCK + r"\s*" + _AMPM + r"\s*" + _ZONE + "$", ("a", "", "b", "y", "H", "M", "S", "f", "ap", "zone")),
    Notation("numeric_24h", r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2}),?\s+" + _CLOCK + r"\s*" + _ZONE + "$", ("a", "", "b", "y", "H", "M", "S", "f", "zone")),
    Notation("month_first", "^" + _WEEKDAY + r"([^\W\d_]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})$", ("name", "d", "y")),
    Notation("month_first_12h", "^" + _WEEKDAY + r"([^\W\d_]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4}),?\s+" + _CLOCK + r"\s*" + _AMPM + r"\s*" + _ZONE + "$", ("name", "d", "y", "H", "M", "S", "f", "ap", "zone")),
    Notation("month_first_24h", "^" + _WEEKDAY + r"([^\W\d_]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4}),?\s+" + _CLOCK + r"\s*" + _ZONE + "$", ("name", "d", "y", "H", "M", "S", "f", "zone")),
    Notation("day_first", "^" + _WEEKDAY + r"(\d{1,2})\.?[-\s]\s*([^\W\d_]{3,9})\.?[-\s,]\s*(\d{4})$", ("d", "name", "y")),
    Notation("day_first_12h", "^" + _WEEKDAY + r"(\d{1,2})\.?[-\s]\s*([^\W\d_]{3,9})\.?[-\s,]\s*(\d{4}),?\s+" + _CLOCK + r"\s*" + _AMPM + r"\s*" + _ZONE + "$", ("d", "name", "y", "H", "M", "S", "f", "ap", "zone")),
    Notation("day_first_24h", "^" + _WEEKDAY + r"(\d{1,2})\.?[-\s]\s*([^\W\d_]{3,9})\.?[-\s,]\s*(\d{4}),?\s+" + _CLOCK + r"(?:\s*Uhr)?\s*" + _ZONE + "$", ("d", "name", "y", "H", "M", "S", "f", "zone")),
)


_COMPILED = tuple((re.compile(n.pattern), n.groups) for n in CASCADE)
_BLANKS = re.compile(r"\s+")
_NUMERIC_ZONE = re.compile(r"([+-])(\d{2}):?(\d{2})?$")
_EPOCH = datetime(1970, 1, 1)


@lru_cache(maxsize=1024)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (ZoneInfoNotFoundError, ValueError):
        return None


def _offset_minutes(zone: str) -> int | None:
    """Minutes east of UTC of a zone text; None for an unknown abbreviation."""
    m = _NUMERIC_ZONE.search(zone)
    if not m:
        return ABBREVIATIONS.get(zone.upper())
    hours, minutes = int(m[2]), int(m[3] or 0)
    return (-1 if m[1] == "-" else 1) * (hours * 60 + minutes) if hours <= 18 and minutes < 60 else None


def _to_utc(local: datetime, zone: ZoneInfo) -> datetime:
    """Of a time that occurs twice the earlier instant (fold 0); for one that was skipped, fold 0 applies the offset before the gap, which moves it forward by the skipped span."""
    return local - local.replace(tzinfo=zone).utcoffset()


def normal_form(value: str | None, tz: str | None, order: str | None) -> str | None:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ`` for an instant, ``YYYY-MM-DD`` for a bare date, None for anything else.

    ``tz`` is the IANA zone of the source; ``order`` is ``mdy``, ``dmy`` or ``ymd`` for all-number dates in which the year doesn't
    come first (``ymd`` and None are read day first). Null, blank and unreadable values give None, as does an instant without zone whose
    ``tz`` is null or unknown. Finer digits than milliseconds are cut off.
    """
    if value is None:
        return None
    v = _BLANKS.sub(" ", value).strip()
    for pattern, groups in _COMPILED:
        if m := pattern.match(v):
            break
    else:
        return None
    part = {g: m[i + 1] for i, g in enumerate(groups) if g}
    try:
        if "epoch" in part:
            n = int(part["epoch"])
            return _text_form(_EPOCH + timedelta(microseconds=n * {10: 1_000_000, 13: 1000, 16: 1}[len(v)]))
        year = int(part["y"]) + (2000 if len(part["y"]) == 2 else 0)
        if "a" in part:
            month, day = (part["a"], part["b"]) if order == "mdy" else (part["b"], part["a"])
        else:
            month, day = part["m"] if "m" in part else MONTHS[part["name"].lower()], part["d"]
        if "H" not in part:
            return date(year, int(month), int(day)).isoformat()
        hour = int(part["H"])
        if "ap" in part:
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if part["ap"] in "pP" else 0)
        local = datetime(year, int(month), int(day), hour, int(part["M"]), int(part["S"] or 0), int((part["f"] or "0").ljust(3, "0")[:3]) * 1000)
        if part["zone"]:
            offset = _offset_minutes(part["zone"])
            return None if offset is None else _text_form(local - timedelta(minutes=offset))
        zone = _zone(tz)
        return None if zone is None else _text_form(_to_utc(local, zone))
    except (ValueError, OverflowError, KeyError):
        return None


def _text_form(t: datetime) -> str:
    return f"{t.isoformat(timespec='milliseconds')}Z"


def normal_form_column(value: Column, tz: Column, order: Column) -> Column:
    """``normal_form`` in Arrow batches."""

    @F.pandas_udf("string")
    def run(v: pd.Series, z: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([normal_form(*x) for x in zip(v, z, o, strict=True)], dtype="object")

    return run(value, tz, order)


def normalise_timestamps(rows: DataFrame, sites: DataFrame, fields: list[str], row_id: str, src_table: str) -> DataFrame:
    """One row per value of ``fields`` that states a valid instant or date: src_table, row_id, field_name, normal_form.

    ``sites`` (site_code, tz_name, date_order) is a lookup of one row per site; a site that isn't in it leaves zoneless instants
    without normal form. Repeated rows of ``rows`` count by their own id; repeated sites count once; extra columns of either side are ignored.
    """
    lookup = sites.select(F.col("site_code").alias("_site"), F.col("tz_name").alias("_tz"), F.col("date_order").alias("_order")).filter("_site IS NOT NULL").dropDuplicates(["_site"])
    kept = rows.select(F.col(row_id).alias("row_id"), F.col("site_code").alias("_code"), *fields)
    flat = kept.unpivot(["row_id", "_code"], fields, "field_name", "value").filter("value IS NOT NULL")
    # No hint: the size of the lookup decides between a broadcast and a shuffle, and AQE splits a hot site.
    joined = flat.join(lookup, flat["_code"] == lookup["_site"], "left")
    return joined.select(F.lit(src_table).alias("src_table"), "row_id", "field_name", normal_form_column(F.col("value"), F.col("_tz"), F.col("_order")).alias("normal_form")).filter("normal_form IS NOT NULL")
