"""Report text: sizes, counts, shortened paths, status labels, scan times."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status codes 0..12 and their labels.
STATUS_LABELS = [
    "Unknown",
    "Registered",
    "Ready",
    "Not Ready",
    "Pending",
    "Scanning",
    "Progressing",
    "Synced",
    "Missing",
    "Marked for Deletion",
    "Ready for Deletion",
    "Deleting",
    "Deleted",
]
UNLISTED_STATUS = "unknown"
SIZE_UNITS = ["KB", "MB", "GB", "TB", "PB", "EB"]
NEVER_SCANNED = "Never scanned"

STATUS = {label: code for code, label in enumerate(STATUS_LABELS)}


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def human_size(size) -> Column:
    """`N B` below 1024, else one decimal in the largest fitting unit, ties to even.

    Decimal arithmetic keeps the tie exact up to the largest long.
    """
    size = _c(size)
    text = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in enumerate(SIZE_UNITS, start=1):
        scaled = size.cast("decimal(20,0)") / F.lit(1024**power).cast("decimal(19,0)")
        shown = F.concat(F.bround(scaled, 1).cast("string"), F.lit(f" {unit}"))
        text = text.otherwise(shown) if unit == SIZE_UNITS[-1] else text.when(size < 1024 ** (power + 1), shown)
    return text


def thousands(number) -> Column:
    return F.format_number(_c(number), 0)


def short_path(path, width: int) -> Column:
    """The end of a path longer than `width`, behind dots."""
    path = _c(path)
    return F.when(F.length(path) > width, F.concat(F.lit("..."), F.right(path, F.lit(width - 3)))).otherwise(path)


def status_label(code) -> Column:
    labels = F.array(*[F.lit(label) for label in STATUS_LABELS])
    code = _c(code)
    return F.when(code.between(0, len(STATUS_LABELS) - 1), F.get(labels, code)).otherwise(UNLISTED_STATUS)


def utc_text(seconds) -> Column:
    """Epoch seconds as `yyyy-MM-dd HH:mm:ss` in UTC, whatever the session's zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", _c(seconds), epoch).cast("string")


def iso_time(seconds) -> Column:
    """Epoch seconds as `yyyy-MM-ddTHH:mm:ssZ`; null stays null."""
    return F.concat(F.replace(utc_text(seconds), F.lit(" "), F.lit("T")), F.lit("Z"))


def utc_midnight(date: str) -> int:
    """Epoch seconds at which a `YYYY-MM-DD` day begins in UTC, for cut-off parameters."""
    return int(datetime.strptime(date, "%Y-%m-%d").replace(tzinfo=timezone.utc).timestamp())


def scan_time_text(seconds) -> Column:
    return F.coalesce(F.concat(utc_text(seconds), F.lit(" UTC")), F.lit(NEVER_SCANNED))
