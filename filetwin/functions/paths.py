"""Path expressions. Paths use '/' and are stored in their clean form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Anything a clean path cannot contain: empty, doubled or trailing slash, '.' or '..' segment.
_UNCLEAN = r"^$|//|(^|/)\.{1,2}(/|$)|./$"


def _c(path) -> Column:
    return F.col(path) if isinstance(path, str) else path


def clean_path(path) -> Column:
    """Lexically shortest equal path; already clean paths take the short way out."""
    path = _c(path)
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        empty,
        lambda done, s: F.when(s != "..", F.concat(done, F.array(s)))
        .when(
            (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != ".."),
            F.slice(done, F.lit(1), F.size(done) - 1),
        )
        .when(rooted, done)
        .otherwise(F.concat(done, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    tidy = F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)
    return F.when(path.rlike(_UNCLEAN), tidy).otherwise(path)


def storage_path(path) -> Column:
    """Clean path with an upper-case drive letter."""
    clean = clean_path(path)
    return F.when(
        clean.rlike("^[a-z]:"), F.concat(F.upper(F.substring(clean, 1, 1)), F.substring(clean, 2, 1 << 30))
    ).otherwise(clean)


def path_key(path) -> Column:
    """Key under which two paths count as the same one: clean and without case."""
    return F.lower(clean_path(path))


def is_under(child, parent) -> Column:
    """True when `child` lies strictly below `parent`."""
    child, parent = clean_path(child), clean_path(parent)
    return F.startswith(child, F.when(parent == "/", parent).otherwise(F.concat(parent, F.lit("/")))) & (
        child != parent
    )


def parent_of(path) -> Column:
    """Path without its last segment; null for a top-level name and for '/'."""
    path = _c(path)
    cut = F.regexp_extract(path, r"^(.*)/[^/]+$", 1)
    return (
        F.when(~path.contains("/") | (path == "/"), F.lit(None).cast("string"))
        .when(cut == "", F.lit("/"))
        .otherwise(cut)
    )


def base_name(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def depth_of(path) -> Column:
    """Number of segments; '/' has depth 0."""
    path = _c(path)
    return F.when(path == "/", F.lit(0)).otherwise(F.size(F.split(path, "/")) - F.when(path.startswith("/"), 1).otherwise(0))


def ancestors(path, top) -> Column:
    """Array of `path` and all its ancestors at or below `top`, topmost first.

    Empty when `path` does not lie at or below `top`.
    """
    path, top = _c(path), _c(top)
    below_slash = top == "/"
    inside = (path == top) | F.startswith(path, F.when(below_slash, top).otherwise(F.concat(top, F.lit("/"))))
    segments = F.split(path, "/")
    first = F.when(below_slash, F.lit(1)).otherwise(F.size(F.split(top, "/")))
    last = F.when(path == "/", F.lit(1)).otherwise(F.size(segments))
    prefixes = F.transform(
        F.sequence(first, F.greatest(first, last)),
        lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/"),
    )
    named = F.transform(prefixes, lambda p: F.when(p == "", F.lit("/")).otherwise(p))
    return F.when(inside, named).otherwise(F.array().cast("array<string>"))


def tree_key(path, root) -> Column:
    """A text by whose order a folder comes directly before all that lies below it in its root.

    The slash sorts before any character of a name; `subtree_end` of a folder is beyond the keys below it.
    """
    plain = lambda p: F.replace(_c(p), F.lit("/"), F.lit("\0"))
    return F.concat(plain(root), F.lit("\1"), plain(path))


def subtree_end(key) -> Column:
    return F.concat(_c(key), F.lit("\1"))
