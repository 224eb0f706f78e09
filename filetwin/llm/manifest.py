"""Merkle manifest of a corpus: a tree per source, a tree over the sources, and a proof for every document.

A leaf is the SHA-256 of a row's five fields. Within a source, leaves ascend by `doc_id`; every 16
consecutive nodes become their hash until one is left, the source's subroot. The subroots, ordered by source
(null first, then by UTF-8 bytes), are built up likewise to the root.

Building: leaves are numbered by a prefix scan over range partitions, so a source may hold any share of
the rows. Each level is one grouping by (tree, place div 16) and is written as node rows that name their
parent; the number of levels is the logarithm of the largest source.

Proving: a Spark recursive query starts from the leaves and climbs to the root along the parent links. A row
of the climb holds the leaves of one run, which have the same path above them: every step appends the
siblings of the path once per run and folds the own, perhaps altered, hash of each of the run's leaves.
Nodes above at least a thousandth of all leaves are at most a thousand a level; a second recursive query climbs
through these with a broadcast join. The first one joins all others by their key, and none of those
keys meets more than a thousandth of the rows.

An empty table gives no rows. Null fields are hashed as `-`; rows with a null `doc_id` come first in their source
and are never altered by the query. Rows that share a `doc_id` are ordered by their leaf, so equal rows are
interchangeable. Texts of any length stay in the first task; only hashes are shuffled. Columns other than the five are
not looked at, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from ..operators.skew import lookup
from ..session import materialize
from .common import crc_mod

WIDTH = 16
#: Nodes above at least one in HEAVY leaves are broadcast: at most HEAVY a level.
HEAVY = 1000
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: The number of the tree over the sources; the sources' own trees count from 0.
TOP = -1

_EMPTY = "cast('' as binary)"


class Manifest(NamedTuple):
    """`runs`: the leaves, WIDTH a row; `nodes`: everything above them, each with its parent's key."""

    runs: DataFrame
    nodes: DataFrame
    leaves: int


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _node(children: Column) -> Column:
    return _digest(F.lower(F.hex(children)))


def leaf_hash(**changed: Column) -> Column:
    """The leaf of a row, with some of its fields replaced."""
    parts = []
    for name in FIELDS:
        text = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return _digest(F.concat(*parts))


def _joined(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(b""), lambda all_, row: F.concat(all_, row["hash"]))


def _level(below: DataFrame, level: int) -> DataFrame:
    """Nodes over `below` (tree, size, pos, hash, leaves; size: nodes of that tree on that level)."""
    members = F.array_sort(F.collect_list(F.struct((F.col("pos") % WIDTH).alias("slot"), "hash")))
    return (
        below.groupBy("tree", "size", F.expr(f"pos div {WIDTH}").alias("pos"))
        .agg(members.alias("members"), F.sum("leaves").alias("leaves"))
        .select(
            "tree",
            F.lit(level).alias("level"),
            "pos",
            F.expr(f"(size + {WIDTH - 1}) div {WIDTH}").alias("size"),
            _joined(F.col("members")).alias("children"),
            "leaves",
        )
        .withColumn("hash", _node(F.col("children")))
    )


def _parent(tree_top: Column) -> list[Column]:
    """The key of the parent and the own slot there: in the own tree, or for a subroot in the tree over the sources."""
    size, pos, tree = F.col("size"), F.col("pos"), F.col("tree")
    above, top = size > 1, (tree != TOP) & tree_top
    return [
        F.when(above, tree).when(top, F.lit(TOP)).cast("long").alias("up_tree"),
        F.when(above, F.col("level") + 1).when(top, F.lit(1)).cast("int").alias("up_level"),
        F.when(above, F.expr(f"pos div {WIDTH}")).when(top, F.expr(f"tree div {WIDTH}")).alias("up_pos"),
        F.when(above, pos % WIDTH).when(top, tree % WIDTH).cast("int").alias("slot"),
    ]


def _built(first: DataFrame, largest: int, label: str) -> list[DataFrame]:
    """All levels of trees of at most `largest` leaves, `first` being the level above the leaves."""
    levels = [materialize(first, f"{label}-1")]
    while (largest := -(-largest // WIDTH)) > 1:
        above = _level(levels[-1].where(F.col("size") > 1), len(levels) + 1)
        levels.append(materialize(above, f"{label}-{len(levels) + 1}"))
    return levels


def build_manifest(leaves: DataFrame) -> Manifest:
    """Trees over `leaves`: source, doc_id, leaf, own (binary; `own` is the hash that is folded later)."""
    spark = leaves.sparkSession
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("key")
    rows = leaves.select(key, "doc_id", "leaf", "own", F.monotonically_increasing_id().alias("row"))
    # Rows equal in all else are spread by their place in the input.
    rows = numbered(rows, ["key", "doc_id", "leaf", "row"], "place", "manifest-leaves").drop("row")
    sources = rows.groupBy("key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"))
    sources = materialize(numbered(sources, ["key"], "tree", "manifest-sources"), "manifest-trees")
    n_sources, largest, total = sources.agg(
        F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))
    ).first()

    placed = lookup(rows, sources, ["key"], spread="place", counts=sources.select("key", F.col("size").alias("n")))
    placed = placed.withColumn("pos", F.col("place") - F.col("first"))
    item = F.struct((F.col("pos") % WIDTH).cast("int").alias("slot"), "doc_id", F.col("leaf").alias("hash"), "own")
    runs = materialize(
        placed.groupBy("tree", "size", F.expr(f"pos div {WIDTH}").alias("run")).agg(
            F.array_sort(F.collect_list(item)).alias("items")
        ),
        "manifest-runs",
    )

    bottom = (
        runs.where(F.col("size") > 1)
        .select(
            "tree",
            F.lit(1).alias("level"),
            F.col("run").alias("pos"),
            F.expr(f"(size + {WIDTH - 1}) div {WIDTH}").alias("size"),
            _joined(F.col("items")).alias("children"),
            F.size("items").cast("long").alias("leaves"),
        )
        .withColumn("hash", _node(F.col("children")))
    )
    levels = _built(bottom, largest, "manifest-source") if largest > 1 else []
    alone = F.col("items")[0]["hash"].alias("hash"), F.lit(1).cast("long").alias("leaves")
    subroots = runs.where(F.col("size") == 1).select("tree", *alone)
    for level in levels:
        subroots = subroots.unionByName(level.where(F.col("size") == 1).select("tree", "hash", "leaves"))
    over = subroots.select(
        F.lit(TOP).cast("long").alias("tree"),
        F.lit(n_sources).cast("long").alias("size"),
        F.col("tree").alias("pos"),
        "hash",
        "leaves",
    )
    if n_sources > 1:
        levels += _built(_level(over, 1), n_sources, "manifest-top")

    has_top = F.lit(n_sources > 1)
    nodes = None
    for level in levels:
        linked = level.select("tree", "level", "pos", "children", "hash", "leaves", *_parent(has_top))
        nodes = linked if nodes is None else nodes.unionByName(linked)
    if nodes is None:
        nodes = spark.createDataFrame(
            [],
            "tree long, level int, pos long, children binary, hash binary, leaves long, "
            "up_tree long, up_level int, up_pos long, slot int",
        )
    start = runs.select("tree", "run", "items", "size", F.lit(0).alias("level"), F.col("run").alias("pos"))
    linked = start.select(
        "tree",
        "run",
        "items",
        *[
            F.when(F.col("size") > 1, value).otherwise(other).alias(name)
            for value, other, name in (
                (F.col("tree"), F.when(has_top, F.lit(TOP).cast("long")), "up_tree"),
                (F.lit(1), F.when(has_top, F.lit(1)), "up_level"),
                (F.col("run"), F.when(has_top, F.expr(f"tree div {WIDTH}")), "up_pos"),
                (F.lit(-1), F.when(has_top, (F.col("tree") % WIDTH).cast("int")), "slot"),
            )
        ],
    )
    return Manifest(linked, nodes, total)


# One step: the row meets its parent. `slot` -1 is a run of leaves, each of which has its own slot.
_LEFT = "substring(n.children, 1, 32 * {slot})"
_RIGHT = f"substring(n.children, 32 * {{slot}} + 33, {32 * WIDTH})"
_CLIMB = f"""
with recursive climb(tree, run, up_tree, up_level, up_pos, slot, folds, proof, subroot, root, done) as (
  select tree, run, up_tree, up_level, up_pos, slot, folds, proof, subroot, root, false from {{start}}
  union all
  select
    c.tree,
    c.run,
    if(n.tree is null, c.up_tree, n.up_tree),
    if(n.tree is null, c.up_level, n.up_level),
    if(n.tree is null, c.up_pos, n.up_pos),
    if(n.tree is null, c.slot, n.slot),
    if(n.tree is null, c.folds, transform(c.folds, (own, i) -> unhex(sha2(cast(lower(hex(concat(
      {_LEFT.format(slot="if(c.slot < 0, i, c.slot)")}, own, {_RIGHT.format(slot="if(c.slot < 0, i, c.slot)")}
    ))) as binary), 256)))),
    if(n.tree is null or c.slot < 0, c.proof,
      concat(c.proof, {_LEFT.format(slot="c.slot")}, {_RIGHT.format(slot="c.slot")})),
    if(n.tree = {TOP} and c.subroot is null, substring(n.children, 32 * c.slot + 1, 32), c.subroot),
    coalesce(n.hash, c.root),
    n.tree is null
  from climb c left join {{nodes}} n on c.up_tree = n.tree and c.up_level = n.level and c.up_pos = n.pos
  where not c.done
)
select tree, run, up_tree, up_level, up_pos, slot, folds, proof, subroot, root from climb where done limit all
"""


def _climb(start: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of `start` moved up along the parent links for as long as the parent is in `nodes`."""
    return start.sparkSession.sql(_CLIMB, start=start, nodes=nodes)


def prove(manifest: Manifest) -> DataFrame:
    """Per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    start = manifest.runs.select(
        "tree",
        "run",
        "up_tree",
        "up_level",
        "up_pos",
        "slot",
        F.col("items.own").alias("folds"),
        F.lit(b"").alias("proof"),
        F.lit(None).cast("binary").alias("subroot"),
        F.lit(None).cast("binary").alias("root"),
    )
    heavy = F.col("leaves") * HEAVY >= manifest.leaves
    low = materialize(_climb(start, manifest.nodes.where(~heavy)), "manifest-climb")
    ends = _climb(low, F.broadcast(manifest.nodes.where(heavy)))
    ends = ends.select("tree", "run", "folds", "proof", "subroot", F.col("root").alias("top"))
    met = ends.join(manifest.runs.select("tree", "run", "items"), ["tree", "run"])
    leaves = met.select("*", F.posexplode("items").alias("i", "item"), _joined(F.col("items")).alias("run_hashes"))

    def text(value: Column) -> Column:
        return F.lower(F.hex(value))

    leaf = F.col("item.hash")
    root = F.coalesce("top", leaf)
    others = F.expr(f"concat(substring(run_hashes, 1, 32 * i), substring(run_hashes, 32 * i + 33, {32 * WIDTH}), proof)")
    folded = F.element_at("folds", F.col("i") + 1)
    return leaves.select(
        F.col("item.doc_id").alias("doc_id"),
        text(leaf).alias("leaf"),
        text(F.coalesce("subroot", root)).alias("subroot"),
        text(root).alias("root"),
        F.sha2(text(others), 256).alias("proof_sha256"),
        text(folded).alias("folded_root"),
        (folded == root).alias("verified"),
    )


def lower_a_to_z(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit(docs: DataFrame, tampered: Column, text: Column) -> DataFrame:
    """Proofs of all rows of `docs`, those for which `tampered` holds being folded with `text` in place of theirs."""
    altered = F.coalesce(tampered, F.lit(False))
    own = F.when(altered, leaf_hash(text=text)).otherwise(F.col("leaf"))
    leaves = docs.select(*FIELDS, leaf_hash().alias("leaf")).select("source", "doc_id", "leaf", own.alias("own"))
    return prove(build_manifest(leaves))


def tampered_documents(docs: DataFrame) -> DataFrame:
    """The audit of the query: every fifth document by its checksum had its text lower-cased."""
    return audit(docs, crc_mod("doc_id", 5) == 0, lower_a_to_z(F.col("text")))
