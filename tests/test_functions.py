import posixpath

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filetwin.functions import paths, text

from .conftest import rows


def _column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def _expected_clean(path):
    """Python's own normalisation, which differs in keeping a leading '//'."""
    clean = posixpath.normpath(path)
    return clean[1:] if clean.startswith("//") else clean


def test_clean_path_cases(spark):
    given_paths = ["", "/", "//", "a", "a/", "/a//b", "/a/./b/", "/a/../b", "/../a", "../a", "../../a/../b", "a/..", "./a", "/a/b/../../..", "..", "a/b/../../../c"]
    wanted = [".", "/", "/", "a", "a", "/a/b", "/a/b", "/b", "/a", "../a", "../../b", ".", "a", "/", "..", "../c"]
    assert _column(spark, given_paths, paths.clean_path) == wanted


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", ".", "..", "a", "B.c", "...", "x y"]), max_size=7).map("/".join), min_size=20, max_size=60))
def test_clean_path_agrees_with_normpath(spark, values):
    assert _column(spark, values, paths.clean_path) == [_expected_clean(v) for v in values]


def test_storage_path_raises_drive_letter(spark):
    assert _column(spark, ["c:/x/", "/c:/x", "D:/y"], paths.storage_path) == ["C:/x", "/c:/x", "D:/y"]


def test_path_key_ignores_case_and_form(spark):
    assert _column(spark, ["/R/A.txt", "/r//a.TXT"], paths.path_key) == ["/r/a.txt", "/r/a.txt"]


def test_is_under_is_strict_and_anchored(spark):
    under = lambda parent: lambda v: paths.is_under(v, F.lit(parent))
    children = ["/r/docs", "/r/docs/a", "/r/docs2", "/r/docs/../x", "/r"]
    assert _column(spark, children, under("/r/docs")) == [False, True, False, False, False]
    assert _column(spark, ["/", "/a"], under("/")) == [False, True]


def test_parent_and_depth(spark):
    assert _column(spark, ["/a/b", "/a", "/", "a/b", "a"], paths.parent_of) == ["/a", "/", None, "a", None]
    assert _column(spark, ["/a/b", "/a", "/"], paths.depth_of) == [2, 1, 0]


def test_ancestors_from_top_to_path(spark):
    up = lambda top: lambda v: paths.ancestors(v, F.lit(top))
    assert _column(spark, ["/r/a/b", "/r", "/rx/a", "/q"], up("/r")) == [["/r", "/r/a", "/r/a/b"], ["/r"], [], []]
    assert _column(spark, ["/a/b", "/"], up("/")) == [["/", "/a", "/a/b"], ["/"]]


def test_human_size(spark):
    sizes = [0, 1023, 1024, 1280, 1792, 1048575, 1048576, 1073741824, 5 * 1024**4, 1024**5, 2**63 - 1]
    shown = ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.8 KB", "1024.0 KB", "1.0 MB", "1.0 GB", "5.0 TB", "1.0 PB", "8.0 EB"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s bigint")
    assert [r[1] for r in rows(df.select("i", text.human_size("s")))] != []
    assert [r.x for r in df.select("i", text.human_size("s").alias("x")).orderBy("i").collect()] == shown


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=2**52), min_size=50, max_size=80))
def test_human_size_rounds_like_printf(spark, sizes):
    def wanted(n):
        if n < 1024:
            return f"{n} B"
        power = min((n.bit_length() - 1) // 10, 6)
        return f"{n / 1024**power:.1f} {' KMGTPE'[power]}B"

    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s bigint")
    shown = [r.x for r in df.select("i", text.human_size("s").alias("x")).orderBy("i").collect()]
    assert shown == [wanted(n) for n in sizes]


def test_counts_paths_labels_times(spark):
    df = spark.createDataFrame([(1234567, "/a/very/long/path", 9, 0), (0, "/short", 99, None)], "n bigint, p string, s int, t bigint")
    shown = df.select(
        text.thousands("n"),
        text.short_path("p", 10),
        text.status_label("s"),
        text.scan_time_text("t"),
        text.iso_time("t"),
    )
    assert rows(shown) == [
        ("0", "/short", "unknown", "Never scanned", None),
        ("1,234,567", "...ng/path", "Marked for Deletion", "1970-01-01 00:00:00 UTC", "1970-01-01T00:00:00Z"),
    ]


def test_time_text_does_not_depend_on_session_zone(spark):
    df = spark.createDataFrame([(1711850400,)], "t bigint")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert rows(df.select(text.utc_text("t"))) == [("2024-03-31 02:00:00",)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_cut_off_is_utc_midnight():
    assert text.utc_midnight("2025-01-01") == 1735689600
