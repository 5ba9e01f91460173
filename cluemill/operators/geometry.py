"""Grid geometry: entries to cells, crossings, runs, numbering, symmetry, connected regions."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cluemill.session import ensure_checkpoint_dir, materialize


def cells(entries: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A row per letter of each entry: keep, n (from 0), x, y, letter. Entries without a positive length have none."""
    n = F.explode(F.when(F.col("n_cells") > 0, F.sequence(F.lit(0), F.col("n_cells") - 1)))
    across = F.col("direction") == "across"
    return entries.select(*keep, "pos_x", "pos_y", "direction", "solution", n.alias("n")).select(
        *keep, "direction", "n", (F.col("pos_x") + F.when(across, F.col("n")).otherwise(0)).alias("x"), (F.col("pos_y") + F.when(across, 0).otherwise(F.col("n"))).alias("y"),
        F.substring("solution", F.col("n") + 1, F.lit(1)).alias("letter"),
    )


def crossings(cell_rows: DataFrame, grid: str, entry: str) -> DataFrame:
    """Pairs of entries that share a cell, each once from either side. A cell belongs to few entries of its grid."""
    a = cell_rows.select(grid, "x", "y", F.col(entry).alias("entry"), F.col("n").alias("at"))
    b = cell_rows.select(grid, "x", "y", F.col(entry).alias("other"), F.col("n").alias("other_at"))
    return a.join(b, [grid, "x", "y"]).where(F.col("entry") != F.col("other"))


def checking(cell_rows: DataFrame, grid: str, entry: str) -> DataFrame:
    """(grid, n_entries, unchecked): mean over entries of the share of their cells that only one entry uses."""
    used = F.count(F.lit(1)).over(Window.partitionBy(grid, "x", "y"))
    share = cell_rows.withColumn("used", used).groupBy(grid, entry).agg(F.avg(F.when(F.col("used") < 2, 1.0).otherwise(0.0)).alias("share"))
    return share.groupBy(grid).agg(F.count(F.lit(1)).alias("n_entries"), F.round(F.avg("share"), 6).alias("unchecked"))


def longest_runs(rows: DataFrame, keys: Sequence[str], at: str, flag: str) -> DataFrame:
    """Longest run of consecutive at whose flag holds, per key; 0 where none does (gaps and islands)."""
    hit = rows.where(F.col(flag))
    island = F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    runs = hit.withColumn("_i", island).groupBy(*keys, "_i").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("longest"))
    return rows.select(*keys).distinct().join(runs, list(keys), "left").select(*keys, F.coalesce("longest", F.lit(0)).alias("longest"))


def numbering(starts: DataFrame, grid: str) -> DataFrame:
    """Number of each start cell in reading order."""
    return starts.withColumn("number", F.dense_rank().over(Window.partitionBy(grid).orderBy("y", "x")))


def not_symmetric(cell_rows: DataFrame, grid: str, rows: str, cols: str) -> DataFrame:
    """Cells whose partner under half a turn is no cell of their grid."""
    lit = cell_rows.select(grid, "x", "y", rows, cols).distinct()
    turned = lit.select(grid, (F.col(cols) - 1 - F.col("x")).alias("x"), (F.col(rows) - 1 - F.col("y")).alias("y"))
    return lit.join(turned, [grid, "x", "y"], "left_anti").select(grid, "x", "y")


def through_cuts(lit: DataFrame, grid: str) -> DataFrame:
    """(grid, least): over all borders between neighbouring rows and between neighbouring columns, the least number of places
    where both sides are open."""
    def borders(along: str, other: str) -> DataFrame:
        next_ = lit.select(grid, other, (F.col(along) - 1).alias(along))
        return lit.join(next_, [grid, "x", "y"]).groupBy(grid, F.col(along).alias("at")).agg(F.count(F.lit(1)).alias("n"))

    return borders("y", "x").unionByName(borders("x", "y")).groupBy(grid).agg(F.min("n").alias("least"))


def _roots(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    """The least member of each one's component, by union and find."""
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def regions(lit: DataFrame, grid: str) -> DataFrame:
    """(grid, x, y, region): connected parts of each grid's open cells, numbered by their first cell in reading order.

    A grid is one group: it has as many cells as rows times columns, whatever the number of grids.
    """
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "ascending"), ("x", "ascending")])
        cells = list(zip(table.column("x").to_pylist(), table.column("y").to_pylist()))
        at = {cell: n for n, cell in enumerate(cells)}
        pairs = [(at[x, y], at[near]) for x, y in cells for near in ((x + 1, y), (x, y + 1)) if near in at]
        return table.select([grid, "x", "y"]).append_column("region", pa.array(_roots(len(cells), pairs), pa.int32()))

    types = dict(lit.dtypes)
    return lit.select(grid, "x", "y").distinct().groupBy(grid).applyInArrow(run, f"`{grid}` {types[grid]}, x {types['x']}, y {types['y']}, region int")


def group_components(edges: DataFrame, group: str) -> DataFrame:
    """(group, id, component): the smallest id reachable from each over undirected edges (group, a, b) within its group; an
    edge from an id to itself is a node alone. For groups that fit a task; components is for graphs without any."""
    def run(table: pa.Table) -> pa.Table:
        a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
        ids = sorted({*a, *b})
        at = {k: n for n, k in enumerate(ids)}
        roots = _roots(len(ids), [(at[x], at[y]) for x, y in zip(a, b)])
        return pa.table({group: pa.repeat(table.column(group)[0], len(ids)), "id": pa.array(ids, pa.string()), "component": pa.array([ids[r] for r in roots], pa.string())})

    return edges.select(group, "a", "b").groupBy(group).applyInArrow(run, f"`{group}` {dict(edges.dtypes)[group]}, id string, component string")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each node over undirected edges (a, b).

    Each round takes the least component of the neighbours and then of the component's own component, so labels travel
    far; it ends when a round changes nothing. The labels are checkpointed each round.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = nodes.select("id", F.col("id").alias("component")).distinct().checkpoint()
    while True:
        near = both.join(labels, both.a == labels.id).groupBy(F.col("b").alias("id")).agg(F.min("component").alias("near"))
        nearest = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("near", "component")).alias("c"), "component")
        own = labels.select(F.col("id").alias("c"), F.col("component").alias("further"))
        stepped = nearest.join(own, "c", "left").select("id", F.least("c", F.coalesce("further", "c")).alias("next"), "component").checkpoint()
        changed = not stepped.where(F.col("next") != F.col("component")).isEmpty()
        labels = stepped.select("id", F.col("next").alias("component"))
        if not changed:
            return labels
