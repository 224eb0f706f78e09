"""The folder tree: hierarchy, states and inherited labels.

Files are reduced to one row per folder before anything is repeated for the folder's ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, depth_of, parent_of
from ..functions.text import STATUS
from ..session import materialize
from .skew import lookup


def folder_tree(files: DataFrame) -> DataFrame:
    """Every folder between the roots and the files, with its parent (null at the top)."""
    holders = files.select("folder_path", "root_path").distinct()
    above = F.explode(ancestors("folder_path", "root_path"))
    tree = holders.select("root_path", above.alias("folder_path")).distinct()
    parent = F.when(F.col("folder_path") != F.col("root_path"), parent_of("folder_path"))
    return tree.select("folder_path", parent.alias("parent_path"), "root_path")


def folder_hierarchy(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Live registered folders with depth, folders, files and bytes below and first registration."""
    live_folders = folders.where(F.col("removed") == 0)
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    holders = (
        files.where(F.col("removed") == 0)
        .groupBy("folder_path", "root_path")
        .agg(F.count(F.lit(1)).alias("f"), F.sum("size").alias("s"))
        .select("folder_path", "root_path", zero.alias("d"), "f", "s")
    )
    itself = live_folders.select("folder_path", "root_path", one.alias("d"), zero.alias("f"), zero.alias("s"))
    below = (
        holders.unionByName(itself)
        .select(F.explode(ancestors("folder_path", "root_path")).alias("folder_path"), "d", "f", "s")
        .groupBy("folder_path")
        .agg(
            (F.sum("d") - 1).alias("folders_below"),
            F.sum("f").alias("files_below"),
            F.sum("s").alias("bytes_below"),
        )
    )
    return live_folders.select(
        "folder_path",
        "root_path",
        (depth_of("folder_path") - depth_of("root_path")).alias("depth"),
        F.col("first_scanned_at").alias("registered_at"),
    ).join(below, "folder_path")


def folder_states(folders: DataFrame, files: DataFrame) -> DataFrame:
    """One step of the folder life cycle from the children's states.

    `folders`: folder_path, parent_path, status; `files`: folder_path, status. A progressing folder
    whose children are all synced becomes synced; a folder marked for deletion without children
    becomes ready for deletion. Other states stay.
    """
    synced = (F.col("status") == STATUS["Synced"]).cast("int").alias("ok")
    children = folders.select(F.col("parent_path").alias("folder_path"), synced).where(
        F.col("folder_path").isNotNull()
    )
    per_folder = (
        children.unionByName(files.select("folder_path", synced))
        .groupBy("folder_path")
        .agg(F.count(F.lit(1)).alias("children"), F.min("ok").alias("all_synced"))
    )
    joined = folders.join(per_folder, "folder_path", "left").withColumn(
        "children", F.coalesce("children", F.lit(0).cast("bigint"))
    )
    status = F.col("status")
    has = F.col("children") > 0
    return joined.select(
        "folder_path",
        "children",
        status.alias("old_status"),
        F.when((status == STATUS["Progressing"]) & has & (F.col("all_synced") == 1), STATUS["Synced"])
        .when((status == STATUS["Marked for Deletion"]) & ~has, STATUS["Ready for Deletion"])
        .otherwise(status)
        .alias("new_status"),
    )


def settle_folders(folders: DataFrame, files: DataFrame, missing: DataFrame | None = None, **skew) -> DataFrame:
    """The folder life cycle carried through the whole tree at once: folder_path, children, old_status, new_status.

    `folders`: folder_path, parent_path, root_path, status; `files`: folder_path, status; `missing`: folder_path of folders that a
    listing did not find. Missing folders go from Scanning, Progressing and Synced to Missing, from Deleting to Deleted. A
    scanned folder without children is synced, one with children progresses; a progressing folder is synced when all
    its children are, those included that become so here. A folder marked for deletion without children is ready for it.

    Levels are not walked. What can never become synced blocks the scanned and progressing folders above it up to
    the first folder in another state, which its parents see as it is. So each folder that directly holds
    something blocking is repeated for its ancestors once, whatever it holds and however many levels there are.
    """
    status = F.col("status")

    def among(*labels: str) -> Column:
        return status.isin(*[STATUS[label] for label in labels])

    told = folders.select("folder_path", "parent_path", "root_path", "status", status.alias("old_status"))
    if missing is not None:
        gone = missing.select("folder_path").distinct().withColumn("_gone", F.lit(True))
        told = told.join(gone, "folder_path", "left").withColumn(
            "status",
            F.when(F.col("_gone") & among("Scanning", "Progressing", "Synced"), STATUS["Missing"])
            .when(F.col("_gone") & among("Deleting"), STATUS["Deleted"])
            .otherwise(status),
        )
    moving = among("Scanning", "Progressing")

    per_parent = told.where(F.col("parent_path").isNotNull()).groupBy(F.col("parent_path").alias("folder_path"))
    per_folder = files.groupBy("folder_path")
    counted = per_parent.agg(F.count(F.lit(1)).alias("n"), F.max(~moving & ~among("Synced")).alias("stuck")).unionByName(
        per_folder.agg(F.count(F.lit(1)).alias("n"), F.max(~among("Synced")).alias("stuck"))
    )
    held = counted.groupBy("folder_path").agg(F.sum("n").alias("children"), F.max("stuck").alias("_stuck"))
    known = materialize(
        told.join(held, "folder_path", "left").select(
            "folder_path",
            "parent_path",
            "root_path",
            "old_status",
            "status",
            F.coalesce("children", F.lit(0).cast("bigint")).alias("children"),
            F.coalesce("_stuck", F.lit(False)).alias("_stuck"),
        ),
        "folder-states",
    )
    # A progressing folder without children stays as it is, so it blocks its parent.
    idle = known.where(among("Progressing") & (F.col("children") == 0)).select(F.col("parent_path").alias("folder_path"))
    blockers = known.where(F.col("_stuck")).select("folder_path").unionByName(idle.where("folder_path is not null"))
    blockers = lookup(
        known.select("folder_path", "root_path"), blockers.distinct(), ["folder_path"], "left_semi", spread="root_path", **skew
    )
    above = blockers.select(
        F.col("folder_path").alias("_from"),
        F.posexplode(ancestors("folder_path", "root_path")).alias("_depth", "folder_path"),
    )
    states = known.select("folder_path", moving.alias("_moving"))
    path = lookup(above, states, ["folder_path"], "inner", spread="_from", **skew)
    # The deepest ancestor in another state hides the blocker from all above it.
    hidden = path.groupBy("_from").agg(F.max(F.when(~F.col("_moving"), F.col("_depth"))).alias("_hidden"))
    blocked = lookup(path, hidden, ["_from"], "inner", spread="folder_path", **skew)
    blocked = blocked.where(F.col("_hidden").isNull() | (F.col("_depth") > F.col("_hidden")))
    blocked = blocked.select("folder_path").distinct().withColumn("_blocked", F.lit(True))

    has = F.col("children") > 0
    return known.join(blocked, "folder_path", "left").select(
        "folder_path",
        "children",
        "old_status",
        F.when(moving & F.col("_blocked"), STATUS["Progressing"])
        .when(among("Scanning") | (among("Progressing") & has), STATUS["Synced"])
        .when(among("Marked for Deletion") & ~has, STATUS["Ready for Deletion"])
        .otherwise(status)
        .alias("new_status"),
    )


LABELS = ["owner", "purpose", "policy"]


def folder_labels(folders: DataFrame, labels: DataFrame, kinds: list[str] | None = None, **skew) -> DataFrame:
    """Each folder's labels, every kind from the nearest folder at or above it that has one."""
    kinds = kinds or LABELS
    exploded = folders.select(
        "folder_path", F.posexplode(ancestors("folder_path", "root_path")).alias("_depth", "_above")
    )
    given = labels.select(F.col("folder_path").alias("_above"), *kinds)
    found = lookup(exploded, given, ["_above"], "inner", spread="folder_path", **skew)
    nearest = [F.max_by(kind, F.when(F.col(kind).isNotNull(), F.col("_depth"))).alias(kind) for kind in kinds]
    per_folder = found.groupBy("folder_path").agg(*nearest)
    return folders.select("folder_path").join(per_folder, "folder_path", "left")


def file_labels(files: DataFrame, labelled_folders: DataFrame, kinds: list[str] | None = None, **skew) -> DataFrame:
    """Files with the labels of their folder."""
    kinds = kinds or LABELS
    return lookup(
        files.select("path", "folder_path"),
        labelled_folders.select("folder_path", *kinds),
        ["folder_path"],
        "left",
        spread="path",
        **skew,
    )


def rule_ranks(labelled_folders: DataFrame, rules: DataFrame, **skew) -> DataFrame:
    """Rank of each folder by the first rule that its labels meet: folder_path, rank; folders that meet none are left out.

    `rules`: rule_no, owner, purpose, policy, rank. A rule holds for a folder that has all labels the rule names; a null stands for any
    label or none. The rule with the smallest number wins, of several with one number the one with the smallest rank. Rules are
    looked up under each of the eight ways to leave labels out, for every distinct combination of labels once.
    """
    combinations = labelled_folders.select(*LABELS).distinct()
    kept = F.explode(F.sequence(F.lit(0), F.lit(2 ** len(LABELS) - 1))).alias("_kept")
    keys = combinations.select("*", kept)
    for bit, kind in enumerate(LABELS):
        keys = keys.withColumn(f"_{kind}", F.when(F.col("_kept").bitwiseAND(1 << bit) != 0, F.col(kind)))
    keys = keys.drop("_kept").distinct()
    named = rules.select(*[F.col(kind).alias(f"r_{kind}") for kind in LABELS], F.struct("rule_no", "rank").alias("_rule"))
    named = named.groupBy(*[f"r_{kind}" for kind in LABELS]).agg(F.min("_rule").alias("_rule"))
    meets = F.lit(True)
    for kind in LABELS:
        meets = meets & F.col(f"_{kind}").eqNullSafe(F.col(f"r_{kind}"))
    first = keys.join(named, meets).groupBy(*LABELS).agg(F.min("_rule")["rank"].alias("rank"))
    # A key of its own, as labels may be null; folders of one combination may be any share of all.
    key = F.to_json(F.array(*LABELS)).alias("_labels")
    ranks = first.select(key, "rank")
    return lookup(
        labelled_folders.select("folder_path", key), ranks, ["_labels"], "inner", spread="folder_path", **skew
    ).select("folder_path", "rank")
