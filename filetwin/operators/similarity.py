"""Identical and similar folders, and what differs between two of them.

Folders are never compared all with all. Identical folders meet through an order-free signature
that is summed up the tree and then checked exactly; similar folders meet through the rarest of
their contents (prefix filtering), which is exact for every threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, parent_of
from ..session import materialize
from .duplicates import CONTENT
from .skew import lookup

# Four lanes of 28 bits: a lane's sum over 2^35 files of one folder still fits a long.
LANE_BITS = 28
LANE_MASK = (1 << LANE_BITS) - 1
LANES = ["_l0", "_l1", "_l2", "_l3"]
SCOPES = ("subtree", "direct")


def _lanes() -> list[Column]:
    """Summed lanes of two independent 64-bit hashes of the content."""
    columns = []
    for number, name in enumerate(LANES):
        word = F.xxhash64(F.lit(number // 2), *CONTENT)
        lane = F.shiftrightunsigned(word, LANE_BITS * (number % 2)).bitwiseAND(F.lit(LANE_MASK))
        columns.append(F.sum(lane).alias(name))
    return columns


def _masked(names: list[str]) -> list[Column]:
    return [F.col(name).bitwiseAND(F.lit(LANE_MASK)).alias(name) for name in names]


def _scope(scope: str) -> str:
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    return scope


def _reach(holders: DataFrame) -> DataFrame:
    """(holder, folder_path): a folder with files and each folder whose subtree it lies in."""
    above = F.explode(ancestors("folder_path", "root_path")).alias("_above")
    return holders.select(F.col("folder_path").alias("holder"), above).withColumnRenamed("_above", "folder_path")


SUMS = ["files", "bytes", "_unhashed", *LANES]


def folder_sums(files: DataFrame) -> DataFrame:
    """Per folder its live files' number, bytes, unhashed ones and summed lanes, as a written table."""
    hashed = F.col("hash_value").isNotNull() & F.col("error_status").isNull()
    sums = (
        files.where(F.col("removed") == 0)
        .groupBy("folder_path", "root_path")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("size").alias("bytes"),
            F.count_if(~hashed).alias("_unhashed"),
            *_lanes(),
        )
    )
    return materialize(
        sums.select("folder_path", "root_path", "files", "bytes", "_unhashed", *_masked(LANES)), "folder-sums"
    )


def folder_signatures(sums: DataFrame, scope: str = "subtree", **skew) -> DataFrame:
    """Signature of each folder whose files are all hashed, from `folder_sums`.

    Only the sums are repeated for the ancestors, not the files. In subtree scope a folder that
    holds all files of its parent is left out, so a chain of folders shows as its topmost one.
    """
    whole = sums
    if _scope(scope) == "subtree":
        whole = materialize(
            sums.select(F.explode(ancestors("folder_path", "root_path")).alias("folder_path"), *SUMS)
            .groupBy("folder_path")
            .agg(*[F.sum(name).alias(name) for name in SUMS])
            .select("folder_path", "files", "bytes", "_unhashed", *_masked(LANES)),
            "subtree-sums",
        )
        parents = whole.select(F.col("folder_path").alias("_parent"), "files")
        whole = materialize(
            lookup(
                whole.withColumn("_parent", parent_of("folder_path")),
                parents,
                ["_parent", "files"],
                "left_anti",
                spread="folder_path",
                measure=False,
                **skew,
            ),
            "topmost-folders",
        )
    return whole.where(F.col("_unhashed") == 0).select("folder_path", "files", "bytes", *LANES)


def _check_groups(contents: DataFrame, keys: list[str] = CONTENT) -> None:
    """Fails should two different folders share a signature.

    Every member of a group must hold the same contents equally often; counted per (group,
    content), which combines before the shuffle.
    """
    same = contents.groupBy("group_folder", "copies", *keys).agg(
        F.count(F.lit(1)).alias("c"), F.min("k").alias("lo"), F.max("k").alias("hi")
    )
    clash = same.where((F.col("c") != F.col("copies")) | (F.col("lo") != F.col("hi")))
    if not clash.isEmpty():
        raise ValueError("two different folders share a signature")


def duplicate_folders(files: DataFrame, scope: str = "subtree", verify: bool = True, **skew) -> DataFrame:
    """Folders with the same multiset of contents as another: group_folder, folder_path, copies.

    `verify` compares the candidates' contents one by one, with counts per (group, content) that
    combine before the shuffle; only files of candidate folders are read for it.
    """
    signature = ["files", "bytes", *LANES]
    sums = folder_sums(files)
    signed = folder_signatures(sums, scope, **skew)
    groups = signed.groupBy(*signature).agg(
        F.count(F.lit(1)).alias("copies"), F.min("folder_path").alias("group_folder")
    )
    counts = groups.select(*signature, F.col("copies").alias("n"))
    members = lookup(
        signed, groups.where(F.col("copies") >= 2), signature, "inner", spread="folder_path", counts=counts, **skew
    ).select("group_folder", "folder_path", "copies", "files", "bytes")
    if not verify:
        return members
    members = materialize(members, "folder-groups")
    grouped = members.select("folder_path", "group_folder", "copies")
    if scope == "direct":
        reach = grouped.withColumn("holder", F.col("folder_path"))
    else:
        reach = materialize(
            lookup(_reach(sums), grouped, ["folder_path"], "inner", spread="holder", **skew), "folder-reach"
        )
    live = files.where(F.col("removed") == 0)
    held = live.select(F.col("folder_path").alias("holder"), _content_key(live))
    held = materialize(held.groupBy("holder", "key").agg(F.count(F.lit(1)).alias("k")), "held-contents")
    contents = (
        lookup(held, reach, ["holder"], "inner", spread="key", measure=False, **skew)
        .groupBy("group_folder", "copies", "folder_path", "key")
        .agg(F.sum("k").alias("k"))
    )
    _check_groups(contents, ["key"])
    return members


def folder_contents(files: DataFrame, scope: str = "direct", include_empty: bool = True) -> DataFrame:
    """The set of contents of each folder: folder_path, hash_value, size, k (how often)."""
    hashed = files.where(
        F.col("hash_value").isNotNull() & (F.col("removed") == 0) & F.col("error_status").isNull()
    ).where(F.col("size") >= (0 if include_empty else 1))
    per_holder = hashed.groupBy("folder_path", "root_path", *CONTENT).agg(F.count(F.lit(1)).alias("k"))
    if _scope(scope) == "direct":
        return per_holder.drop("root_path")
    return (
        per_holder.select(F.explode(ancestors("folder_path", "root_path")).alias("folder_path"), *CONTENT, "k")
        .groupBy("folder_path", *CONTENT)
        .agg(F.sum("k").alias("k"))
    )


def folder_shapes(contents: DataFrame, verify: bool = True, **skew) -> DataFrame:
    """Folders with equal content sets share a shape: folder_path, group_folder, copies, contents.

    The shape is named by its first folder. Contents are compared as sets here.
    """
    signature = ["contents", *LANES]
    signed = materialize(
        contents.groupBy("folder_path")
        .agg(F.count(F.lit(1)).alias("contents"), *_lanes())
        .select("folder_path", "contents", *_masked(LANES)),
        "set-signatures",
    )
    groups = signed.groupBy(*signature).agg(
        F.count(F.lit(1)).alias("copies"), F.min("folder_path").alias("group_folder")
    )
    counts = groups.select(*signature, F.col("copies").alias("n"))
    members = lookup(signed, groups, signature, "inner", spread="folder_path", counts=counts, **skew).select(
        "folder_path", "group_folder", "copies", "contents"
    )
    members = materialize(members, "shapes")
    if not verify:
        return members
    repeated = members.where(F.col("copies") >= 2).select("folder_path", "group_folder", "copies")
    held = lookup(contents.drop("k"), repeated, ["folder_path"], "inner", spread="hash_value", **skew)
    _check_groups(held.withColumn("k", F.lit(1)))
    return members


def _ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / F.lit(b)).cast("bigint")


SMALL_SHAPE = 64
# A folder with more files is cut into parts of about so many contents, by the contents' hash.
PART_CONTENTS = 1024
SEEDS = 16


def _content_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *CONTENT)


def _content_key(contents: DataFrame) -> Column:
    """A 64-bit key of a content, under the first seed that gives no two contents of the table the same one.

    Contents are told apart here by a second 64-bit hash.
    """
    for seed in range(0, 2 * SEEDS, 2):
        key, other = (_content_hash(seed + k) for k in (0, 1))
        twice = contents.groupBy(key.alias("key")).agg(F.min(other).alias("lo"), F.max(other).alias("hi"))
        if twice.where(F.col("lo") != F.col("hi")).isEmpty():
            return key.alias("key")
    raise ValueError("no seed gives all contents different keys")


def folder_sets(held: DataFrame, **skew) -> DataFrame:
    """The set of content keys of each folder, as a written table: folder_path, parts, part, keys.

    `held`: folder_path, key, in any number; other columns are grouped by as well. A folder of up to PART_CONTENTS rows is one row; a larger one has its
    keys dealt to several by their hash, so no row and no task holds a whole large folder.
    """
    counts = held.groupBy("folder_path").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / PART_CONTENTS).cast("int").alias("parts")
    large = materialize(counts.where(F.col("n") > PART_CONTENTS).select("folder_path", parts), "large-folders")
    cut = F.coalesce("parts", F.lit(1))
    named = [column for column in held.columns if column != "key"]
    dealt = lookup(held, large, ["folder_path"], "left", spread="key", measure=False, **skew).select(
        *named, "key", cut.alias("parts"), F.pmod(F.xxhash64("key"), cut).cast("int").alias("part")
    )
    sets = dealt.groupBy(*named, "parts", "part").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    return materialize(sets, "folder-sets")


def _set_lanes() -> list[Column]:
    """Summed lanes of two independent 64-bit hashes of the keys of a row."""
    columns = []
    for number, name in enumerate(LANES):
        seed, shift = F.lit(number // 2), LANE_BITS * (number % 2)
        lane = lambda key: F.shiftrightunsigned(F.xxhash64(seed, key), shift).bitwiseAND(F.lit(LANE_MASK))  # noqa: B023, E731
        columns.append(F.aggregate("keys", F.lit(0).cast("bigint"), lambda total, key: total + lane(key)).alias(name))  # noqa: B023
    return columns


def _alike(sets: DataFrame, name: str, also: list[str], found: list[Column], **skew) -> tuple[DataFrame, DataFrame]:
    """Sets with the same number of keys, lanes and `also` as others get the aggregates `found` of all of them.

    These are null for a set that is like no other: only repeated signatures are joined. Returned are the rows of `sets`
    with `known` (keys of the set), as a written table, and one row without keys per set.
    """
    lists = ["parts", "part", "keys", "ords"]
    told = [column for column in sets.columns if column not in lists]
    signature = [*also, "known", *LANES]
    own = sets.withColumns({"known": F.size("keys").cast("bigint")}).select("*", *_set_lanes())
    one = own.where(F.col("parts") == 1).select(*sets.columns, "known", *_masked(LANES))
    many = own.where(F.col("parts") > 1)
    sums = many.groupBy(*told).agg(*[F.sum(column).alias(column) for column in ("known", *LANES)])
    sums = materialize(sums.select(*told, "known", *_masked(LANES)), "cut-signatures")
    each = one.select(*told, "known", *LANES).unionByName(sums)
    groups = each.groupBy(*signature).agg(F.count(F.lit(1)).alias("n"), *found)
    several = materialize(groups.where(F.col("n") >= 2), "repeated-signatures")
    counts = several.select(*signature, "n")
    side = several.drop("n")

    def joined(rows: DataFrame) -> DataFrame:
        return lookup(rows, side, signature, "left", spread=name, counts=counts, measure=False, **skew).drop(*LANES)

    sums = materialize(joined(sums), "cut-sets")
    new = [column for column in sums.columns if column not in told]
    many, sides = sets.where(F.col("parts") > 1), sums.select(name, *new)
    cut = lookup(many, sides, [name], "inner", spread="part", measure=False, **skew)
    rows = materialize(joined(one).unionByName(cut), "alike-sets")
    singles = rows.where(F.col("parts") == 1).select(*sums.columns)
    return rows, singles.unionByName(sums)


def _met(direct: DataFrame, shapes: DataFrame, **skew) -> DataFrame:
    """Keys of the contents that two folders can have in common of which neither lies in the other.

    A content whose holders have one parent and one shape is otherwise found only in folders above all of them.
    """
    shape_of = shapes.select("folder_path", "shape")
    held = lookup(direct, shape_of, ["folder_path"], "inner", spread="part", measure=False, **skew)
    places = [F.xxhash64(F.lit(k), F.coalesce(parent_of("folder_path"), F.lit("")), "shape") for k in (0, 1)]
    place = F.struct(*[place.alias(f"p{k}") for k, place in enumerate(places)])
    placed = held.select(place.alias("place"), F.explode("keys").alias("key"))
    ends = placed.groupBy("key").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    return ends.where(F.col("lo") != F.col("hi")).select("key")


def _classes(
    sets: DataFrame, verify: bool, direct: DataFrame | None, **skew
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Shapes of folders, classes of shapes with shared contents, the classes' sets of these, and how many shapes hold each.

    Shapes: folder_path, shape, copies, contents. Classes, one row per shape: shape, class_folder, folders, shapes,
    squares, contents, shared. Sets: shape (of the class), n, copies (its folders), parts, part, keys and ords (their
    order values, where a set is larger than SMALL_SHAPE), both from rare to frequent within a part.
    """
    counted = [F.min("folder_path").alias("shape"), F.count(F.lit(1)).alias("copies")]
    rows, shapes = _alike(sets, "folder_path", [], counted, **skew)
    named = {"shape": F.coalesce("shape", "folder_path"), "copies": F.coalesce("copies", F.lit(1).cast("bigint"))}
    rows, shapes = (df.withColumns(named).withColumnRenamed("known", "contents") for df in (rows, shapes))
    if verify:
        repeated = rows.where(F.col("copies") >= 2).select(
            F.col("shape").alias("group_folder"), "copies", F.explode("keys").alias("key"), F.lit(1).alias("k")
        )
        _check_groups(repeated, ["key"])

    first = rows.where(F.col("folder_path") == F.col("shape"))
    whole = F.col("contents") <= SMALL_SHAPE
    held = first.select(
        *["shape", "contents", "copies"],
        F.when(whole, 1).otherwise(F.col("parts")).alias("parts"),
        F.when(whole, 0).otherwise(F.col("part")).alias("part"),
        F.explode("keys").alias("key"),
    )
    common = held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    if direct is not None:
        common = common.join(_met(direct, shapes, **skew), "key", "left_semi")
    common = materialize(common, "common-contents")
    order = F.col("df") * 64 + F.pmod("key", F.lit(64))
    items = F.sort_array(F.collect_list(F.struct(order.alias("ord"), F.col("key"))))
    shared = (
        lookup(held, common.withColumnRenamed("n", "df"), ["key"], "inner", spread="shape", counts=common, measure=False, **skew)
        .groupBy("shape", "contents", "copies", "parts", "part")
        .agg(items.alias("items"))
        .select(
            *["shape", "contents", "copies", "parts", "part"],
            F.col("items.key").alias("keys"),
            F.when(F.col("contents") > SMALL_SHAPE, F.col("items.ord")).alias("ords"),
        )
    )
    shared = materialize(shared, "shared-contents")
    copies = F.col("copies")
    counted = [
        F.min("shape").alias("class_folder"),
        F.count(F.lit(1)).alias("shapes"),
        F.sum(copies).alias("folders"),
        F.sum(copies * copies).alias("squares"),
    ]
    rows, folded = _alike(shared, "shape", ["contents"], counted, **skew)
    named = {
        "class_folder": F.coalesce("class_folder", "shape"),
        "shapes": F.coalesce("shapes", F.lit(1).cast("bigint")),
        "folders": F.coalesce("folders", copies),
        "squares": F.coalesce("squares", copies * copies),
    }
    rows, folded = (df.withColumns(named) for df in (rows, folded))
    if verify:
        several = rows.where(F.col("shapes") >= 2).select(
            F.col("class_folder").alias("group_folder"),
            F.col("shapes").alias("copies"),
            F.explode("keys").alias("key"),
            F.lit(1).alias("k"),
        )
        _check_groups(several, ["key"])
    tokens = rows.where(F.col("shape") == F.col("class_folder")).select(
        "shape", F.col("contents").alias("n"), F.col("folders").alias("copies"), "parts", "part", "keys", "ords"
    )
    folded = folded.drop("copies").withColumnRenamed("known", "shared")
    other = folded.where(F.col("shape") != F.col("class_folder")).groupBy("class_folder")
    other = materialize(other.agg(F.min("shape").alias("other_folder")), "other-folders")
    folded = lookup(folded, other, ["class_folder"], "left", spread="shape", measure=False, **skew)
    return shapes, folded, tokens, common


def _alone() -> dict[str, Column]:
    """The class of a shape that has no shared contents."""
    copies = F.col("copies")
    number = lambda n: F.lit(n).cast("bigint")
    return {
        "class_folder": F.col("shape"),
        "shapes": number(1),
        "folders": copies,
        "squares": copies * copies,
        "shared": number(0),
    }


def _members(shapes: DataFrame, classes: DataFrame, **skew) -> DataFrame:
    """One row per folder with its shape and class; a shape without shared contents is a class of its own."""
    found = lookup(shapes, classes.drop("contents"), ["shape"], "left", spread="folder_path", measure=False, **skew)
    return found.withColumns({name: F.coalesce(name, value) for name, value in _alone().items()})


def folder_classes(
    contents: DataFrame, verify: bool = True, direct: DataFrame | None = None, **skew
) -> tuple[DataFrame, DataFrame]:
    """Shapes folded into classes, and the shared contents of each class.

    A content that only one shape holds cannot be common to two. Shapes with the same number of contents and the same
    set of contents that occur in two shapes or more are therefore as similar to every other folder as each other:
    they are a class, named by its first folder. Any two shapes of a class have just these shared
    contents in common. A shape without shared contents is a class of its own. With the `direct` contents, those of
    whole subtrees being `contents`, a content that only folders within each other share does not count as shared.

    Members: folder_path, shape, copies (folders of the shape), class_folder, other_folder (the first one of another shape), folders and
    shapes (of the class), squares (sum of squared copies), contents, shared (numbers of contents). Contents: class_folder, n, folders, key
    (see `_content_key`).
    """
    key = _content_key(contents)
    sets = folder_sets(contents.select("folder_path", key), **skew)
    if direct is not None:
        direct = folder_sets(direct.select("folder_path", key), **skew)
    shapes, classes, tokens, _ = _classes(sets, verify, direct, **skew)
    held = tokens.select(
        F.col("shape").alias("class_folder"), "n", F.col("copies").alias("folders"), F.explode("keys").alias("key")
    )
    return _members(shapes, classes, **skew), held


def _scoped_sets(files: DataFrame, scope: str, include_empty: bool, **skew) -> tuple[DataFrame, DataFrame | None]:
    """The sets of all folders and, for subtrees, those of the contents that lie directly in each."""
    hashed = files.where(
        F.col("hash_value").isNotNull() & (F.col("removed") == 0) & F.col("error_status").isNull()
    ).where(F.col("size") >= (0 if include_empty else 1))
    key = _content_key(hashed)
    if _scope(scope) == "direct":
        return folder_sets(hashed.select("folder_path", key), **skew), None
    direct = folder_sets(hashed.select("folder_path", "root_path", key), **skew)
    reach = direct.select(F.explode(ancestors("folder_path", "root_path")).alias("above"), "keys")
    return folder_sets(reach.select(F.col("above").alias("folder_path"), F.explode("keys").alias("key")), **skew), direct


def _large_places(shared: DataFrame, **skew) -> DataFrame:
    """Lower bound of the place of each content, from a histogram of the shape's order values."""
    histogram = shared.groupBy("shape", "n", "ord").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("shape")
    earlier = whole.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rare = F.col("n") - F.sum("c").over(whole)
    places = histogram.select(
        "shape", "ord", (rare + F.coalesce(F.sum("c").over(earlier), F.lit(0)) + 1).alias("place")
    )
    counts = histogram.select("shape", "ord", F.col("c").alias("n"))
    return lookup(shared, places, ["shape", "ord"], "inner", spread="key", counts=counts, **skew).select(
        "shape", "n", "copies", "key", "place", F.lit(None).cast("array<bigint>").alias("keys")
    )


def shape_pairs(sets: DataFrame, common: DataFrame, threshold: int, **skew) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes that reach the threshold, and those that may: x (not larger), y, nx, ny, cx, cy.

    `sets` and `common` (key, n, the rows a key can have): see `_classes`. Contents are
    ordered from rare to frequent. Two sets of sizes nx <= ny at the threshold share at least
    o = ceil(t (nx + ny) / (100 + t)) contents, so their first shared one is at most at place
    nx - o + 1 and ny - o + 1; the smaller set needs only its index prefix, the larger its probe
    prefix. Small sets carry their keys in that order, so a pair of them is settled (with `common`) where it meets in its
    first shared content; of larger ones places come from a histogram over (frequency, hash bucket) as lower
    bounds, so no task ever sorts a whole large shape and no pair is lost; their pairs are the second result.
    """
    t = threshold
    n = F.col("n")
    place = (n - F.size("keys") + F.col("pos") + 1).alias("place")
    small = sets.where(n <= SMALL_SHAPE)
    small = small.select("shape", "n", "copies", "keys", F.posexplode("keys")).select(
        "shape", "n", "copies", F.col("col").alias("key"), place, "keys"
    )
    large = sets.where(n > SMALL_SHAPE).select("shape", "n", "copies", F.explode(F.arrays_zip("keys", "ords")).alias("item"))
    large = large.select(
        *["shape", "n", "copies"],
        F.col("item.keys").alias("key"),
        F.col("item.ords").alias("ord"),
    )
    wanted = F.col("place") <= n - _ceil_div(n * t, 100) + 1
    far = materialize(_large_places(large, **skew).where(wanted), "placed-contents")

    def side(placed: DataFrame, names: dict[str, str]) -> DataFrame:
        return placed.where(wanted).select("key", *[F.col(old).alias(new) for old, new in names.items()])

    ys = {"shape": "y", "n": "ny", "copies": "cy", "place": "py", "keys": "ky"}
    xs = {"shape": "x", "n": "nx", "copies": "cx", "place": "px", "keys": "kx"}
    nx, ny = F.col("nx"), F.col("ny")
    overlap = _ceil_div((nx + ny) * t, 100 + t)

    def met(probed: DataFrame, indexed: DataFrame) -> DataFrame:
        # Both sides of one table are shuffled once; the index prefix follows from the conditions on both.
        return lookup(side(probed, ys), side(indexed, xs), ["key"], "inner", spread="y", counts=common, measure=False, **skew).where(
            (nx <= ny)
            & (nx * 100 >= ny * t)
            & ((nx < ny) | (F.col("x") < F.col("y")))
            & (F.col("px") <= nx - overlap + 1)
            & (F.col("py") <= ny - overlap + 1)
        )

    both = F.array_intersect("kx", "ky")
    settled = (
        met(small, small)
        .withColumn("_both", both)
        .where((F.size("_both") >= overlap) & (F.get("_both", 0) == F.col("key")))
        .select("x", "y", "nx", "ny", "cx", "cy", F.size("_both").cast("bigint").alias("common"))
    )
    open_ = met(far, far.unionByName(small.where(n * 100 > SMALL_SHAPE * t)))
    return settled, open_.select("x", "y", "nx", "ny", "cx", "cy").distinct()


def _counted_pairs(pairs: DataFrame, sets: DataFrame, **skew) -> DataFrame:
    """The given pairs, compared content by content, with `common`."""
    pairs = materialize(pairs, "class-pairs")
    involved = pairs.select(F.explode(F.array("x", "y")).alias("shape")).distinct()
    kept = lookup(sets.select("shape", "part", "keys"), involved, ["shape"], "left_semi", spread="part", **skew)
    compared = materialize(kept.select("shape", F.explode("keys").alias("key")), "compared-contents")
    smaller, larger = (compared.withColumnRenamed("shape", side) for side in "xy")
    listed = lookup(pairs, smaller, ["x"], "inner", spread="y", measure=False, **skew)
    return (
        lookup(listed, larger, ["y", "key"], "left_semi", spread="x", measure=False, **skew)
        .groupBy("x", "y", "nx", "ny", "cx", "cy")
        .agg(F.count(F.lit(1)).alias("common"))
    )


def similar_folders(
    files: DataFrame,
    threshold: int = 50,
    scope: str = "direct",
    include_empty: bool = True,
    verify: bool = True,
    **skew,
) -> DataFrame:
    """Folders whose common ÷ distinct contents reach `threshold` percent.

    Folders that are equally similar to all others are one class (see `folder_classes`), so a row is a pair of
    classes, named by their first folders, with the number of folder pairs it stands for. A class is a row with
    itself for its folders with equal contents, and another for those that differ in contents nobody else holds,
    which is named by its first folder and the first one with other contents. So a million folders around a common
    core are two rows. In subtree scope pairs of a folder and its own
    ancestor are left out. `similar_members` lists the folders of each class.
    """
    if not 1 <= threshold <= 100:
        raise ValueError("threshold is a percentage from 1 to 100")
    sets, direct = _scoped_sets(files, scope, include_empty, **skew)
    shapes, every, tokens, shared = _classes(sets, verify, direct, **skew)
    settled, open_ = shape_pairs(tokens, shared, threshold, **skew)
    x_first = F.col("x") < F.col("y")
    enough = F.col("common") * 100 >= F.col("distinct_contents") * threshold
    across = (
        settled.unionByName(_counted_pairs(open_, tokens, **skew))
        .withColumn("distinct_contents", F.col("nx") + F.col("ny") - F.col("common"))
        .where(enough)
        .select(
            F.least("x", "y").alias("left_folder"),
            F.greatest("x", "y").alias("right_folder"),
            F.lit(False).alias("_same"),
            "common",
            "distinct_contents",
            F.when(x_first, F.col("cx")).otherwise(F.col("cy")).alias("left_copies"),
            F.when(x_first, F.col("cy")).otherwise(F.col("cx")).alias("right_copies"),
            (F.col("cx") * F.col("cy")).alias("folder_pairs"),
            F.lit(None).cast("string").alias("_other"),
        )
    )
    folded = materialize(every.where(F.col("shape") == F.col("class_folder")), "classes")
    repeated = shapes.where((F.col("folder_path") == F.col("shape")) & (F.col("copies") >= 2))
    alone = lookup(repeated, every.select("shape"), ["shape"], "left_anti", spread="shape", measure=False, **skew)
    alone = alone.withColumns(_alone()).withColumn("other_folder", F.lit(None).cast("string"))
    classes = folded.unionByName(alone.select(*folded.columns))
    folders, n = F.col("folders"), F.col("contents")

    def within(same: bool, common: Column, distinct: Column, pairs: str) -> DataFrame:
        return (
            classes.select(
                F.col("class_folder").alias("left_folder"),
                F.col("class_folder").alias("right_folder"),
                F.lit(same).alias("_same"),
                common.alias("common"),
                distinct.alias("distinct_contents"),
                folders.alias("left_copies"),
                folders.alias("right_copies"),
                F.expr(f"({pairs}) div 2").alias("folder_pairs"),
                (F.lit(None).cast("string") if same else F.col("other_folder")).alias("_other"),
            )
            .where(F.col("folder_pairs") > 0)
            .where(enough)
        )

    equal = within(True, n, n, "squares - folders")
    unequal = within(False, F.col("shared"), 2 * n - F.col("shared"), "folders * folders - squares")
    found = across.unionByName(equal).unionByName(unequal.where(F.col("common") > 0))
    if scope == "subtree":
        related = _related_classes(files, _members(shapes, every, **skew), threshold, **skew)
        found = (
            found.join(related, ["left_folder", "right_folder", "_same"], "left")
            .withColumn("folder_pairs", F.col("folder_pairs") - F.coalesce("_related", F.lit(0)))
            .where(F.col("folder_pairs") > 0)
            .drop("_related")
        )
    percent = F.round(F.col("common") * 100 / F.col("distinct_contents"), 2)
    found = found.withColumn("right_folder", F.coalesce("_other", "right_folder")).drop("_same", "_other")
    return found.withColumn("similarity", percent)


def similar_members(
    files: DataFrame, scope: str = "direct", include_empty: bool = True, verify: bool = True, **skew
) -> DataFrame:
    """The folders behind the names and numbers of `similar_folders`.

    class_folder (the name of the class), folder_path, shape_folder (the first folder with the same contents), copies (folders of
    that shape), folders (of the class), contents, shared (those that other shapes hold as well).
    """
    sets, direct = _scoped_sets(files, scope, include_empty, **skew)
    shapes, classes, _, _ = _classes(sets, verify, direct, **skew)
    return _members(shapes, classes, **skew).select(
        "class_folder", "folder_path", F.col("shape").alias("shape_folder"), "copies", "folders", "contents", "shared"
    )


def _related_classes(files: DataFrame, members: DataFrame, threshold: int, **skew) -> DataFrame:
    """Per pair of classes the number of (folder, own ancestor) pairs between them, those of one shape apart.

    Only of classes whose numbers of contents allow the threshold.
    """
    holders = files.where(F.col("removed") == 0).select("folder_path", "root_path").distinct()
    tree = (
        holders.select("root_path", F.explode(ancestors("folder_path", "root_path")).alias("folder_path"))
        .distinct()
        .select("folder_path", F.explode(ancestors("folder_path", "root_path")).alias("_above"))
        .where(F.col("_above") != F.col("folder_path"))
    )
    tree = materialize(tree, "folders-above")
    members = materialize(members.select("folder_path", "class_folder", "shape", "contents"), "class-members")
    names = ["class_folder", "shape", "contents"]
    lower = members.select("folder_path", *[F.col(name).alias(f"{name}_a") for name in names])
    upper = members.select(F.col("folder_path").alias("_above"), *[F.col(name).alias(f"{name}_b") for name in names])
    upper = lookup(upper, tree.select("_above").distinct(), ["_above"], "left_semi", spread="_above", **skew)
    upper = materialize(upper, "upper-folders")
    both = lookup(
        lookup(tree, upper, ["_above"], "inner", spread="folder_path", measure=False, **skew),
        lower,
        ["folder_path"],
        "inner",
        spread="_above",
        measure=False,
        **skew,
    ).where(F.least("contents_a", "contents_b") * 100 >= F.greatest("contents_a", "contents_b") * threshold)
    return both.groupBy(
        F.least("class_folder_a", "class_folder_b").alias("left_folder"),
        F.greatest("class_folder_a", "class_folder_b").alias("right_folder"),
        (F.col("shape_a") == F.col("shape_b")).alias("_same"),
    ).agg(F.count(F.lit(1)).alias("_related"))


def _packed_hash() -> list[Column]:
    """A hash in lower-case hex as its bytes, any other one as it is."""
    value = F.col("hash_value")
    is_hex = value.rlike("^([0-9a-f]{2})+$")
    return [F.when(is_hex, F.unhex(value)).alias("_digest"), F.when(~is_hex, value).alias("_text")]


def folder_differences(files: DataFrame, pairs: DataFrame, scope: str = "direct", **skew) -> DataFrame:
    """For each given pair (left_folder, right_folder) what keeps its folders from being equal.

    `missing_left` / `missing_right`: a content the folder lacks; `different_date`: a name below
    both with unequal times. Both come from aggregates per pair, not from a join of the folders.
    """
    live = files.where(F.col("removed") == 0)
    wanted = pairs.where(F.col("left_folder") != F.col("right_folder")).select("left_folder", "right_folder")
    sides = wanted.select(
        "*",
        F.explode(
            F.array(
                F.struct(F.lit("L").alias("side"), F.col("left_folder").alias("folder_path")),
                F.struct(F.lit("R").alias("side"), F.col("right_folder").alias("folder_path")),
            )
        ).alias("_s"),
    ).select("left_folder", "right_folder", "_s.side", "_s.folder_path")
    if _scope(scope) == "direct":
        reach = sides.withColumn("holder", F.col("folder_path"))
    else:
        holders = live.select("folder_path", "root_path").distinct()
        reach = lookup(_reach(holders), sides, ["folder_path"], "inner", spread="holder", **skew)
    held = live.select(F.col("folder_path").alias("holder"), "path", *_packed_hash(), "size", "mtime")
    below = F.substring(F.col("path"), F.length("folder_path") + 2, F.length("path"))
    rows = materialize(
        lookup(held, reach, ["holder"], "inner", spread="path", **skew)
        .withColumn("name", below)
        .drop("path", "holder", "folder_path"),
        "compared-folders",
    )
    pair = ["left_folder", "right_folder"]
    on_left, on_right = F.col("side") == "L", F.col("side") == "R"
    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    contents = (
        rows.where(F.col("_digest").isNotNull() | F.col("_text").isNotNull())
        .groupBy(*pair, "_digest", "_text", "size")
        .agg(F.max(on_left).alias("_in_left"), F.max(on_right).alias("_in_right"))
        .where(F.col("_in_left") != F.col("_in_right"))
        .select(
            *pair,
            F.when(F.col("_in_left"), "missing_right").otherwise("missing_left").alias("difference"),
            F.coalesce(F.lower(F.hex("_digest")), "_text").alias("hash_value"),
            "size",
            text.alias("name"),
            number.alias("left_mtime"),
            number.alias("right_mtime"),
        )
    )
    dates = (
        rows.groupBy(*pair, "name")
        .agg(
            F.max(F.when(on_left, F.col("mtime"))).alias("left_mtime"),
            F.max(F.when(on_right, F.col("mtime"))).alias("right_mtime"),
        )
        .where(F.col("left_mtime") != F.col("right_mtime"))
        .select(
            *pair,
            F.lit("different_date").alias("difference"),
            text.alias("hash_value"),
            number.alias("size"),
            "name",
            "left_mtime",
            "right_mtime",
        )
    )
    return contents.unionByName(dates)
