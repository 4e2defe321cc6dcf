"""Connected components of an edge table, by alternating large-star and small-star rounds.

Edges never meet on the driver. First those of every partition are contracted to a spanning forest in bounded chunks, so that a
node with very many edges sends on at most one edge a chunk. Each round then links every node's neighbours to its smallest one
with partial aggregation and joins that Spark can split when a key is hot. What has
become a star by itself is done and takes no part in the next round; the rounds end when nothing is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, returning, shuffle_partitions

#: Edges contracted together.
CHUNK = 100_000


class UnionFind(dict):
    """Nodes to parents; the smallest node of a set is its root."""

    def root(self, x):
        at = x
        while (up := self.get(at, at)) != at:
            at = up
        while (up := self.get(x, x)) != at:
            self[x] = at
            x = up
        return at

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self[b] = a
        return True


def forest(pairs):
    """The edges (node, root) of a spanning forest of the pairs."""
    found = UnionFind()
    for a, b in pairs:
        found.join(a, b)
    return [(x, found.root(x)) for x in list(found)]


def contract(edges: DataFrame) -> DataFrame:
    """Fewer edges a, b with the same components, by partition."""
    def run(batches):
        import pyarrow as pa

        waiting, found = 0, UnionFind()

        def flush():
            out = [(x, r) for x in list(found) if (r := found.root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], kind)], ["a", "b"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.join(a, b)
            waiting += batch.num_rows
            if waiting >= CHUNK:
                yield flush()
                waiting, found = 0, UnionFind()
        if kind is not None:
            yield flush()

    return edges.select("a", "b").mapInArrow(returning(run), edges.select("a", "b").schema)


def _star(edges: DataFrame, parts: int) -> DataFrame:
    """One large-star and one small-star step over edges with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    large = both.join(least, F.col("a") == F.col("u")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where(F.col("a") != F.col("b")).coalesce(parts).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    small = large.join(least, F.col("a") == F.col("u"))
    small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return small.where(F.col("a") != F.col("b")).coalesce(parts).distinct().coalesce(parts)


def _marked(edges: DataFrame, parts: int) -> DataFrame:
    """edges with ``open``: false for those of a whole star, whose leaves have no other edge, as a leaf or a root, and whose root
    is no leaf; such a star is a component."""
    roots = edges.select(F.col("b").alias("own_root")).distinct()
    several = (F.count(F.lit(1)).over(Window.partitionBy("a")) > 1) | F.col("own_root").isNotNull()
    leaves = edges.join(roots, F.col("a") == F.col("own_root"), "left").withColumn("several", several).coalesce(parts)
    ends = leaves.select(F.col("b").alias("node"), "several").unionByName(edges.select(F.col("a").alias("node"), F.lit(True).alias("several")))
    ends = ends.groupBy("node").agg(F.max("several").alias("open"))
    return edges.join(ends, F.col("b") == F.col("node")).select("a", "b", "open").coalesce(parts)


def connected(space: Workspace, edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge in edges (a, b), the root being the component's smallest node."""
    # Edges are far smaller than what they come from: an eighth of its partitions hold them.
    parts = max(1, shuffle_partitions(space.spark) // 8)
    now, stars = space.save(contract(edges.where(F.col("a") != F.col("b"))).distinct().coalesce(parts)), []
    while True:
        marked = space.save(_marked(now, parts))
        space.drop(now)
        stars.append(marked.where(~F.col("open")).select("a", "b"))
        left = marked.where("open").select("a", "b")
        if left.isEmpty():
            break
        now = space.save(_star(left, parts))
    now = reduce(DataFrame.unionByName, stars)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
