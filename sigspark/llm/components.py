"""Connected components of a graph of any size, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.lineage import Tables

#: Tasks that the links of one node, or the members of one component, are dealt to.
SALTS = 8


def connected_components(links: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): root is the smallest node of the component.

    Each round takes the smallest root among neighbours and then the root of that root, so that chains
    shorten geometrically. A node's links and a component's members are dealt to SALTS tasks, to each of which goes a copy of the one row that
    they meet. Nothing but a count of changes comes to the driver. No links give no rows.
    """
    salted = lambda column: F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int").alias("salt")
    copies = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    both = tables.cut(links.select("a", "b").union(links.select("b", "a")).distinct().select("a", "b", salted("a")))
    roots = found = tables.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        before = found
        told = roots.select(F.col("node").alias("b"), F.col("root").alias("r"), copies)
        near = both.join(told, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("r").alias("near"))
        met = tables.cut(roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"), salted("node")))
        following = met.select(F.col("node").alias("root"), F.col("root").alias("next"), copies)
        found = tables.cut(met.join(following, ["root", "salt"]).select("node", "old", F.least("root", "next").alias("root")))
        changed = found.filter("root <> old").limit(1).count()
        tables.drop(before, met)
        roots = found.select("node", "root")
        if not changed:
            tables.drop(both)
            return roots
