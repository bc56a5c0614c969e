"""Parent-child rows to full hierarchies, with loops reported.

From the roots, level-wise frontier joins extend root, depth and path one level
at a time; nodes are reached once, as each has one parent.  The walk goes on while
a level reaches at least ``least_gain`` of what is left (or to ``frontier_levels``).  What no frontier reached
then lies on a loop, hangs below one, or on a thin chain far down: the rest is
finished by jumps that grow fourfold, so a chain of a million levels or a
loop over all rows takes some ten rounds.  Either way gives the same rows.
Ancestor pairs are the exploded paths.

Defined results
---------------
* Rows with a null id are left out.  Of several rows of one id the smallest
  non-empty parent counts; a null or empty parent means none.
* A parent id that does not exist makes the node an orphan: its own root at depth 0.
* A node on a loop (its own parent included) has state ``cycle``, a node whose chain
  of parents leads into one ``below``; both have root '' and depth -1, and no path.
* An empty table gives an empty result.  Extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import materialise, release


def parent_edges(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """One row per id: ``id``, ``parent`` (null for none)."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.nullif(F.col(parent_col).cast("string"), F.lit("")).alias("parent"))
    return rows.groupBy("id").agg(F.min("parent").alias("parent"))


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", with_paths: bool = False, frontier_levels: int | None = None, least_gain: float = 0.02) -> DataFrame:
    """``id``, ``parent``, ``root_id``, ``depth``, ``state`` (root, tree, orphan, cycle, below) of each id.

    ``with_paths`` adds ``path``: the ids from the root to the node (empty for loops).
    """
    nodes = materialise(parent_edges(df, id_col, parent_col))
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    edges = materialise(nodes.where("parent is not null").join(known, "parent", "left"))
    inner = edges.where("known").select("id", "parent")
    lone = edges.where("known is null").select("id", "parent", F.lit("orphan").alias("state"))
    top = nodes.where("parent is null").select("id", "parent", F.lit("root").alias("state")).unionByName(lone)
    path = [F.array("id").alias("path")] if with_paths else []
    reached = [top.select("id", "parent", F.col("id").alias("root_id"), F.lit(0).cast("long").alias("depth"), "state", *path)]

    kept = ["id", "root_id", "path"] if with_paths else ["id", "root_id"]
    frontier, rest, fresh = reached[0].select(*kept), inner, None
    left, level = inner.count(), 0
    while left:
        level += 1
        grown = [F.concat("up.path", F.array("e.id")).alias("path")] if with_paths else []
        step = materialise(
            rest.alias("e").join(frontier.alias("up"), F.col("e.parent") == F.col("up.id"))
            .select("e.id", "e.parent", "up.root_id", F.lit(level).cast("long").alias("depth"), F.lit("tree").alias("state"), *grown)
        )
        found = step.count()
        if found:
            reached.append(step)
            frontier = step.select(*kept)
            fresh = fresh.unionByName(step.select("id")) if fresh is not None else step.select("id")
        left -= found
        if not found or found < least_gain * left or level == frontier_levels:
            break
        if level + 1 & level == 0:  # at 1, 3, 7, ...: shrink what later levels scan
            rest, fresh = materialise(rest.join(fresh, "id", "left_anti")), None
    so_far = reached[0]
    for r in reached[1:]:
        so_far = so_far.unionByName(r)
    if not left:
        return so_far
    rest = materialise(rest.join(fresh, "id", "left_anti") if fresh is not None else rest)
    return so_far.unionByName(_jump(rest, so_far, left, with_paths))


def _jump(rest: DataFrame, reached: DataFrame, n_rest: int, with_paths: bool) -> DataFrame:
    """Finishes the unreached nodes by ever longer jumps along their parents."""
    cols = ["root_id", "depth"] + (["path"] if with_paths else [])
    land = reached.select(F.col("id").alias("parent"), *(F.col(c).alias(f"at_{c}") for c in cols))
    # landed: the ancestor ``anc`` lies in the reached part; steps: how far up it is
    state = rest.join(land, "parent", "left").select("id", "parent", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("steps"), F.col("at_root_id").isNotNull().alias("landed"))
    state, span = materialise(state), 1
    while span <= n_rest:
        far = state.select(F.col("id").alias("anc"), F.col("anc").alias("next"), F.col("steps").alias("more"), F.col("landed").alias("next_landed"))
        moved = state.where("not landed")
        for _ in range(3):  # three jumps along one written table make the next one four times as long
            landed = F.col("landed") | F.coalesce("next_landed", F.lit(False))
            moved = moved.join(far, "anc", "left").select("id", "parent", F.coalesce("next", "anc").alias("anc"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), landed.alias("landed"))
        fresh = materialise(state.where("landed").unionByName(moved))
        release(state)
        state, span = fresh, span * 4
    # after as many steps as there are nodes, whoever has not landed stands on a loop
    loop = state.where("not landed").select(F.col("anc").alias("id")).distinct().withColumn("on_loop", F.lit(True))
    loops = state.where("not landed").join(loop, "id", "left").select(
        "id", "parent", F.lit("").alias("root_id"), F.lit(-1).cast("long").alias("depth"), F.when(F.col("on_loop"), "cycle").otherwise("below").alias("state"),
        *([F.array().cast("array<string>").alias("path")] if with_paths else []),
    )
    base = land.select(F.col("parent").alias("anc"), *(f"at_{c}" for c in cols))
    deep = state.where("landed").join(base, "anc").select("id", "parent", F.col("at_root_id").alias("root_id"), (F.col("at_depth") + F.col("steps")).alias("depth"), F.lit("tree").alias("state"), *(["at_path"] if with_paths else []))
    if with_paths:
        deep = _deep_paths(deep, materialise(state.where("landed").select("id", "parent")))
    return deep.unionByName(loops)


def _deep_paths(deep: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``path`` to landed nodes: segments below the reached part, joined by doubling."""
    seg = edges.select("id", F.col("parent").alias("anc"), F.array("id").alias("seg"))
    while True:
        up = seg.select(F.col("id").alias("anc"), F.col("anc").alias("next"), F.col("seg").alias("above"))
        joined = materialise(seg.join(up, "anc", "left").select("id", F.coalesce("next", "anc").alias("anc"), F.when(F.col("above").isNull(), F.col("seg")).otherwise(F.concat("above", "seg")).alias("seg"), F.col("next").isNotNull().alias("moved")))
        if joined.where("moved").isEmpty():
            return deep.join(joined.select("id", "seg"), "id").select("id", "parent", "root_id", "depth", "state", F.concat("at_path", "seg").alias("path"))
        seg = joined.drop("moved")


def descendants(tree: DataFrame) -> DataFrame:
    """``ancestor_id``, ``descendant_id``, ``distance`` from a hierarchy with paths, the node itself excluded."""
    pairs = tree.where(F.size("path") > 1).select(F.col("id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "ancestor_id"))
    return pairs.where("at < depth").select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))
