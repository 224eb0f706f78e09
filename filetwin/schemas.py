"""Schemas of the catalog tables. Rows refer to each other by path; times are epoch seconds."""

from pyspark.sql import types as T


def _schema(*fields):
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()

ROOTS = _schema(
    ("root_path", _S, False),
    ("agent_id", _L, True),
    ("traverse_links", _I, False),
    ("last_scan_date", _L, True),
    ("folder_count", _L, False),
    ("file_count", _L, False),
    ("total_size", _L, False),
)

FOLDERS = _schema(
    ("folder_path", _S, False),
    ("parent_path", _S, True),
    ("root_path", _S, False),
    ("error_status", _S, True),
    ("first_scanned_at", _L, False),
    ("last_scanned_at", _L, False),
    ("removed", _I, False),
)

FILES = _schema(
    ("path", _S, False),
    ("size", _L, False),
    ("mtime", _L, False),
    ("hash_value", _S, True),
    ("hash_algorithm", _S, True),
    ("error_status", _S, True),
    ("first_scanned_at", _L, False),
    ("last_scanned_at", _L, False),
    ("removed", _I, False),
    ("folder_path", _S, False),
    ("root_path", _S, False),
)

SCANS = _schema(
    ("scan_id", _L, False),
    ("root_path", _S, False),
    ("scan_mode", _S, False),
    ("current_folder_path", _S, True),
    ("last_processed_file", _S, True),
    ("started_at", _L, False),
    ("updated_at", _L, False),
    ("completed", _I, False),
)

SCAN_EVENTS = _schema(
    ("scan_id", _L, False),
    ("root_path", _S, False),
    ("scan_mode", _S, True),
    ("event", _S, False),
    ("folder_path", _S, True),
    ("file_path", _S, True),
    ("at", _L, False),
    ("seq", _L, False),
)

AGENTS = _schema(
    ("id", _L, False),
    ("name", _S, False),
    ("guid", _S, False),
    ("enabled", _I, False),
    ("updated", _L, False),
    ("status", _I, False),
)

LISTING = _schema(
    ("path", _S, False),
    ("size", _L, False),
    ("mtime", _L, False),
    ("folder_path", _S, False),
    ("root_path", _S, False),
)

OBSERVATIONS = _schema(
    ("seq", _L, False),
    ("ts", _L, False),
    ("root_path", _S, False),
    ("path", _S, False),
    ("size", _L, True),
    ("hash_value", _S, True),
)

# Names accepted by the catalog's value rules.
ALGORITHMS = ["sha256", "sha512", "sha3-256"]
DEFAULT_ALGORITHM = "sha512"
SCAN_MODES = ["all", "folders", "files"]
