"""Approximate nearest neighbours on robust-pruned directed graphs, one a shard.

Vectors are dealt to shards by a hash of their id (at least ``SHARDS``, of about ``SHARD`` vectors at most). A shard's graph
is built by inserting its vectors in batches: a greedy beam search over the graph so far proposes neighbours, and relaxed
pruning keeps the nearest one, drops every candidate that is ``ALPHA`` times nearer to it than to the vector, and goes on
with the next, so that up to ``DEGREE`` diverse edges stay; reverse edges are added and pruned alike. Queries, in blocks,
beam-search every shard, and the shards' best are merged by exact cosine in double precision. Shards are dealt to at most ``PARTS``
parts; a block of queries is sent to each part once, whatever its number of shards, and never to the driver.

Equal vectors of a shard share one node, which keeps as many of the smallest ids as a query can return; so ties are exact and
a vector that holds a third of all rows costs one node a shard.

Defined results: null, empty or zero vectors and those with null or non-finite components take no part, nor do rows without
an id; repeated rows count once; an id of several vectors is as near as its nearest one, to any of the query's, and is returned
once; vectors are compared only to those of their own dimension; fewer candidates than wanted
give all; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Set together from measured recall: in a full shard of random 64-dimensional vectors a beam of 64 finds 0.90 of the five
#: nearest, 128 0.975, 192 0.994, 256 0.998.
SHARDS, SHARD, BLOCK, PARTS = 8, 5_000, 1024, 64
DEGREE, BEAM, QUERY_BEAM, ALPHA, SEEDS, BATCH = 24, 48, 256, 1.2, 16, 256


def _beam(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam's nodes (-1: none) and squared distances for every query, nearest first."""
    m, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((m, len(x)), bool)
    ids = np.broadcast_to(entry, (m, len(entry))).copy()
    seen[:, entry] = True
    dist = (2 - 2 * queries @ x[entry].T).astype(np.float32)
    open_ = np.ones(ids.shape, bool)

    def cut(ids, dist, open_):
        order = np.argsort(dist, 1, kind="stable")[:, :beam]
        return ids[rows, order], dist[rows, order], open_[rows, order]

    ids, dist, open_ = cut(ids, dist, open_)
    while True:
        todo = open_ & np.isfinite(dist)
        at = todo.argmax(1)
        busy = np.flatnonzero(todo[np.arange(m), at])
        if not len(busy):
            return np.where(np.isfinite(dist), ids, -1), dist
        open_[busy, at[busy]] = False
        near = graph[ids[busy, at[busy]]]
        fresh = (near >= 0) & ~seen[busy[:, None], near]
        seen[busy[:, None], near] |= near >= 0
        found = 2 - 2 * np.einsum("bd,brd->br", queries[busy], x[near])
        new_ids, new_dist = np.full((m, near.shape[1]), -1), np.full((m, near.shape[1]), np.inf, np.float32)
        new_ids[busy], new_dist[busy] = near, np.where(fresh, found, np.inf)
        ids, dist, open_ = cut(np.hstack([ids, new_ids]), np.hstack([dist, new_dist]), np.hstack([open_, np.isfinite(new_dist)]))


def _prune(x: np.ndarray, own: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each own among its candidates near (-1: none)."""
    out = np.full((len(own), degree), -1, np.int32)
    ordered = np.sort(near, 1)
    repeated = np.zeros(near.shape, bool)
    repeated[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
    near = np.where(repeated | (ordered == own[:, None]), -1, ordered)
    points = x[near]
    dist = np.where(near >= 0, 2 - 2 * np.einsum("bd,bcd->bc", x[own], points), np.inf)
    between = 2 - 2 * points @ points.transpose(0, 2, 1)
    rows = np.arange(len(own))
    for k in range(degree):
        best = dist.argmin(1)
        live = np.isfinite(dist[rows, best])
        if not live.any():
            break
        out[live, k] = near[rows, best][live]
        gone = ALPHA * between[rows, best] <= dist
        gone[rows, best] = True
        dist[live[:, None] & gone] = np.inf
    return out


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n x DEGREE, -1: none) and entry points of unit vectors x."""
    n = len(x)
    graph, rng = np.full((n, DEGREE), -1, np.int32), np.random.default_rng(n)
    order = rng.permutation(n)
    middle = int((x @ x.mean(0)).argmax())
    order = np.concatenate(([middle], order[order != middle]))
    done = 1
    while done < n:
        batch = order[done : done + max(1, min(BATCH, done))]
        entry = order[: min(SEEDS, done)]
        near, _ = _beam(x, graph, entry, x[batch], BEAM)
        graph[batch] = _prune(x, batch, near, DEGREE)
        source, target = np.repeat(batch, DEGREE), graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.lexsort((2 - 2 * np.einsum("id,id->i", x[source], x[target]), target))
        source, target = source[by], target[by]
        first = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.empty(0, np.int64)
        rank = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        own = target[first]
        more = np.full((len(own), DEGREE), -1, np.int32)  # the nearest of those that point to it
        some = rank < DEGREE
        more[np.searchsorted(own, target[some]), rank[some]] = source[some]
        for at in range(0, len(own), 1024):
            part = own[at : at + 1024]
            graph[part] = _prune(x, part, np.hstack([graph[part], more[at : at + 1024]]), DEGREE)
        done += len(batch)
    return graph, order[: min(SEEDS, n)].astype(np.int32)


def usable(vector: Column) -> Column:
    """True for a vector that takes part."""
    v = vector.cast("array<double>")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~odd & F.exists(v, lambda c: c != 0), F.lit(False))


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(float)
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _raw(column, dim: int) -> np.ndarray:
    """A row a vector, in the precision of the column; zeros have no sign."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) + np.float32(0)


def _doubles(blob: np.ndarray, dim: int, n: int) -> np.ndarray:
    """n vectors from bytes of single or double precision."""
    return blob.view(np.float32 if len(blob) == 4 * n * dim else float).reshape(n, dim).astype(float)


_GRAPH = "dim int, shard long, n int, ids binary, counts binary, vectors binary, edges binary, entry binary"


def index(space: Workspace, vectors: DataFrame, *, k: int = 5) -> tuple[DataFrame, int]:
    """The written graphs of vectors (id long, vector array of float or double), one row a dimension and shard, and the number of shards."""
    count = vectors.count()
    shards = max(SHARDS, math.ceil(count / SHARD))
    kept = k + 1

    def run(group):
        import pyarrow as pa

        ids = group.column("id").to_numpy()
        dim = group.column("dim")[0].as_py()
        raw = _raw(group.column("vector"), dim)
        order = np.argsort(ids, kind="stable")
        ids, raw = ids[order], raw[order]
        _, first, node = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * dim))).ravel(), return_index=True, return_inverse=True)
        raw = raw[first]
        by = np.argsort(node, kind="stable")
        by = by[np.append(True, (node[by][1:] != node[by][:-1]) | (ids[by][1:] != ids[by][:-1]))]  # repeated rows count once
        by.sort()
        ids, node = ids[by], node[by]
        by = np.argsort(node, kind="stable")
        begin = np.searchsorted(node[by], np.arange(len(first)))
        rank = np.arange(len(ids)) - begin[node[by]]
        names, some = np.zeros((len(first), kept), np.int64), rank < kept
        names[node[by][some], rank[some]] = ids[by][some]
        counts = np.minimum(np.bincount(node), kept).astype(np.uint8)
        graph, entry = build(_unit(raw))
        row = [dim, group.column("shard")[0].as_py(), len(first), names.tobytes(), counts.tobytes(), raw.tobytes(), graph.tobytes(), entry.tobytes()]
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], [c.split()[0] for c in _GRAPH.split(", ")])

    dealt = vectors.select("id", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
    return space.save(dealt.groupBy("dim", "shard").applyInArrow(run, _GRAPH)), shards


def _packed(queries: DataFrame, blocks: int) -> DataFrame:
    """Blocks of queries as one row each."""
    def run(group):
        import pyarrow as pa

        dim = group.column("dim")[0].as_py()
        raw = _raw(group.column("vector"), dim)
        row = [dim, group.column("id").to_numpy().tobytes(), raw.tobytes()]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.binary(), pa.binary()))], ["q_dim", "q_ids", "q_vectors"])

    dealt = queries.select("id", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    return dealt.groupBy("dim", "block").applyInArrow(run, "q_dim int, q_ids binary, q_vectors binary")


def search(graphs: DataFrame, shards: int, queries: DataFrame, *, k: int = 5, beam: int = QUERY_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for queries (id, vector), without rows of the query's own id."""
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    parts = min(shards, PARTS)
    none = [F.lit(None).cast("binary").alias(c) for c in ("counts", "edges", "entry")]
    asked = _packed(queries, blocks).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(True).alias("asks"), F.col("q_dim").alias("dim"),
        (F.length("q_ids") / 8).cast("int").alias("n"), F.col("q_ids").alias("ids"), F.col("q_vectors").alias("vectors"), *none)
    # No join: its planner takes what explode multiplies for as small as what goes in, and may send it all to the driver to be broadcast.
    both = graphs.select(F.pmod("shard", F.lit(parts)).alias("part"), F.lit(False).alias("asks"), "dim", "n", "ids", "vectors", "counts", "edges", "entry").unionByName(asked)
    both = both.repartition(parts, "part").sortWithinPartitions("part", "asks")

    def best(graph, own, q, asks):
        x, raw, norm, ids, counts, edges, entry = graph
        found, _ = _beam(x, edges, entry, _unit(q), beam)
        for j, row in enumerate(found):
            row = row[row >= 0][: 4 * k]
            score = raw[row] @ q[j] / (norm[row] * np.linalg.norm(q[j]))
            asks[j] += [(-s, v) for s, r in zip(score.tolist(), row) for v in ids[r, : counts[r]].tolist() if v != own[j]]
            nearest = {}
            for s, v in sorted(asks[j]):
                nearest.setdefault(v, s)
            asks[j] = [(s, v) for v, s in nearest.items()][:k]

    def run(batches):
        import pyarrow as pa

        part, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda c, i=i, batch=batch: batch.column(c)[i]
                get = lambda c, t, value=value: np.frombuffer(value(c).as_buffer(), t)
                dim, n = value("dim").as_py(), value("n").as_py()
                if part != (part := value("part").as_py()):
                    held = {}
                raw, ids = _doubles(get("vectors", np.uint8), dim, n), get("ids", np.int64)
                if not value("asks").as_py():
                    held.setdefault(dim, []).append((_unit(raw), raw, np.linalg.norm(raw, axis=1), ids.reshape(n, -1), get("counts", np.uint8), get("edges", np.int32).reshape(n, DEGREE), get("entry", np.int32)))
                    continue
                out = []
                for at in range(0, n, BATCH):
                    q, own = raw[at : at + BATCH], ids[at : at + BATCH]
                    asks = [[] for _ in own]
                    for graph in held.get(dim, ()):
                        best(graph, own, q, asks)
                    out += [(int(name), v, -s) for name, hits in zip(own, asks) for s, v in hits]
                columns = list(zip(*out)) or [()] * 3
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, beam: int = QUERY_BEAM) -> DataFrame:
    """The k nearest rows found for each row of table that meets is_query (a condition on column ``id``)."""
    space = Workspace(table.sparkSession, "graph-search")
    rows = table.where(usable(F.col(vector)) & F.col(vec_id).isNotNull())
    single = table.select(F.col(vector).alias("v")).schema["v"].dataType.simpleString() == "array<float>"
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("vector"))
    graphs, shards = index(space, rows, k=k)
    return search(graphs, shards, rows.where(is_query), k=k, beam=beam)
