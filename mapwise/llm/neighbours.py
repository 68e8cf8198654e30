"""Nearest vectors by largest inner product: a hierarchical navigable small-world graph for each shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mapwise.llm.storage import stored
from mapwise.llm.words import mixed

#: Vectors of a shard and queries of a block, about; links of a node above and at the ground layer.
SHARD, QUERY_BLOCK, LINKS = 8192, 2048, 16
#: Candidates from which a node's links are chosen, and width of the search.
BUILD_WIDTH, SEARCH_WIDTH = 48, 80
#: Queries of a block whose graph answers are held against all vectors of the shard, and the share of hits below which
#: the whole block looks at all vectors.
PROBES, LEAST_RECALL = 64, 0.95


def lifted(vectors: np.ndarray) -> np.ndarray:
    """The vectors with one more component that makes all norms equal: largest inner product is then nearest."""
    norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
    return np.concatenate([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None].astype(np.float32)], axis=1)


def _layer(points: np.ndarray, most: int) -> np.ndarray:
    """Neighbour array (n, most) of one layer, -1 where a node has fewer links.

    A node's nearest candidates are taken in order unless one is nearer to a link already taken than to the node, so
    links point in different directions; links are made both ways, a node's own first, then the nearest.
    """
    n = len(points)
    width = min(BUILD_WIDTH, n - 1)
    if width < 1:
        return np.full((n, most), -1, np.int32)
    sources, targets, near, own = [], [], [], []
    for begin in range(0, n, 512):
        block = np.arange(begin, min(begin + 512, n))
        sims = points[block] @ points.T
        sims[np.arange(len(block)), block] = -np.inf
        top = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        score = np.take_along_axis(sims, top, axis=1)
        order = np.argsort(-score, axis=1, kind="stable")
        top, score = np.take_along_axis(top, order, axis=1), np.take_along_axis(score, order, axis=1)
        between = np.matmul(points[top], points[top].transpose(0, 2, 1))
        taken = np.zeros(top.shape, bool)
        for c in range(width):
            hidden = ((between[:, c, :] > score[:, c, None]) & taken).any(axis=1)
            taken[:, c] = ~hidden & (taken.sum(axis=1) < most // 2)
        rows, columns = np.nonzero(taken)
        for a, b, first in ((block[rows], top[rows, columns], 0), (top[rows, columns], block[rows], 1)):
            sources.append(a)
            targets.append(b)
            near.append(score[rows, columns])
            own.append(np.full(len(a), first))
    source, target, score, kind = map(np.concatenate, (sources, targets, near, own))
    order = np.lexsort((target, -score, kind, source))
    source, target = source[order], target[order]
    _, first = np.unique(source.astype(np.int64) * n + target, return_index=True)
    keep = np.sort(first)  # of a link made from both ends, the better place
    source, target = source[keep], target[keep]
    rank = np.arange(len(source)) - np.searchsorted(source, source)
    links = np.full((n, most), -1, np.int32)
    fits = rank < most
    links[source[fits], rank[fits]] = target[fits]
    return links


def build(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the ground up: (nodes, flat neighbour array). A node's highest layer is geometric in its place's hash."""
    points = lifted(vectors)
    draws = (mixed(np.arange(1, len(points) + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    heights = np.floor(-np.log(draws + 1e-18) / np.log(LINKS)).astype(int)
    layers = [(np.arange(len(points), dtype=np.int32), _layer(points, 2 * LINKS))]
    level = 1
    while (nodes := np.flatnonzero(heights >= level)).size > 1:
        links = _layer(points[nodes], LINKS)
        layers.append((nodes.astype(np.int32), np.where(links >= 0, nodes[links], -1).astype(np.int32)))
        level += 1
    return layers


def search(vectors: np.ndarray, layers: list, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """Places of the vectors found for each query, at least min(k, all) of them; many queries go side by side."""
    points = lifted(vectors)
    n, out = len(points), []
    width = min(max(SEARCH_WIDTH, k), n)
    rows_of = [np.full(n, -1) for _ in layers]
    for place, (nodes, _) in zip(rows_of, layers, strict=True):
        place[nodes] = np.arange(len(nodes))
    for begin in range(0, len(queries), 256):
        q = np.concatenate([queries[begin : begin + 256], np.zeros((len(queries[begin : begin + 256]), 1), np.float32)], axis=1)
        every = np.arange(len(q))
        now = np.full(len(q), layers[-1][0][0])
        best = (points[now] * q).sum(axis=1)
        for place, (_, links) in zip(rows_of[:0:-1], layers[:0:-1], strict=True):
            while True:
                around = links[place[now]]
                sims = np.where(around >= 0, np.einsum("bld,bd->bl", points[around], q), -np.inf)
                step = sims.argmax(axis=1)
                better = sims[every, step] > best
                if not better.any():
                    break
                now = np.where(better, around[every, step], now)
                best = np.maximum(best, sims[every, step])
        seen = np.zeros((len(q), n), bool)
        seen[every, now] = True
        beam, scores = np.full((len(q), width), -1), np.full((len(q), width), -np.inf)
        done = np.zeros((len(q), width), bool)
        beam[:, 0], scores[:, 0] = now, best
        ground = layers[0][1]
        while True:
            waiting = np.where(done, -np.inf, scores)
            pick = waiting.argmax(axis=1)
            live = np.flatnonzero(np.isfinite(waiting[every, pick]))
            if not len(live):
                break
            done[live, pick[live]] = True
            around = ground[beam[live, pick[live]]]
            fresh = (around >= 0) & ~seen[live[:, None], around]
            sims = np.where(fresh, np.einsum("bld,bd->bl", points[around], q[live]), -np.inf)
            seen[live[:, None], np.where(fresh, around, beam[live, pick[live]][:, None])] = True
            ids = np.concatenate([beam[live], around], axis=1)
            both = np.concatenate([scores[live], sims], axis=1)
            flags = np.concatenate([done[live], np.zeros(sims.shape, bool)], axis=1)
            keep = np.argpartition(-both, width - 1, axis=1)[:, :width]
            beam[live] = np.take_along_axis(ids, keep, axis=1)
            scores[live] = np.take_along_axis(both, keep, axis=1)
            done[live] = np.take_along_axis(flags, keep, axis=1)
        for i in range(len(q)):
            found = beam[i][np.isfinite(scores[i])]
            # A graph with parts that no link joins: look at the whole shard.
            out.append(found if len(found) >= min(k, n) else np.argsort(-(points @ q[i]), kind="stable")[: max(k, width)])
    return out


def scan(vectors: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """Places of the min(k, all) largest inner products for each query, from all vectors; the first of equal ones."""
    wide, out = vectors.astype(np.float64), []
    k = min(k, len(wide))
    for begin in range(0, len(queries), 256):
        for scores in queries[begin : begin + 256].astype(np.float64) @ wide.T:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            above = np.flatnonzero(scores > least)
            out.append(np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]]))
    return out


def answers(vectors: np.ndarray, layers: list, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """Places found for each query: by the graph if it finds what the probes' exact answers hold, else by ``scan``.

    The graph's links are those of near vectors, which large inner products need not be if norms are uneven or the
    vectors lie in far groups. So some queries of the block are answered both ways first.
    """
    some = np.unique(np.linspace(0, len(queries) - 1, PROBES).astype(int))
    wanted = scan(vectors, queries[some], k)
    met = sum(len(np.intersect1d(a, b)) for a, b in zip(search(vectors, layers, queries[some], k), wanted, strict=True))
    if met < LEAST_RECALL * sum(map(len, wanted)):
        return scan(vectors, queries, max(k, SEARCH_WIDTH))
    return search(vectors, layers, queries, k)


def _usable(vector: str) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, k: int = 20, every: int = 20, shard: int = SHARD, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose ``vec_id`` is divisible by ``every``, its ``k`` nearest others.

    Nearness is the largest inner product, given in double precision of the stored vectors; ties go to the smaller
    ``vec_id``. Equal vectors are one node that carries its k + 1 smallest ids, all that a result can need, so a vector
    that a third of the rows share costs one node. Nodes are dealt to shards by a hash; each shard's graph is built
    from exact neighbours within the shard and stored as flat arrays; blocks of queries meet every shard, and the shards'
    best are merged. A block whose probes the graph of a shard answers too poorly, as with uneven norms, is held
    against all vectors of that shard. Vectors that are null, zero, empty or hold null or non-finite components take no part, nor do rows
    with a null ``vec_id``; vectors are only compared with those of their own length. Repeated rows count once.
    Columns other than ``vec_id`` and ``embedding`` are not read.
    """
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vector"))
    good = good.filter(_usable("vector") & F.col("vec_id").isNotNull()).groupBy("vector", "vec_id").agg(F.lit(1).alias("one"))
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    firsts = good.select("vector", "vec_id", place.alias("place")).filter(F.col("place") <= k + 1)
    nodes = firsts.groupBy("vector").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = stored(nodes.withColumn("dim", F.size("vector")), "neighbours-nodes")
    asked = good.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector")
    asked = stored(asked.join(nodes.select("vector", "node", "dim"), "vector").select("query_id", "node", "dim"), "neighbours-asked")
    unique = asked.select("node", "dim").distinct().join(nodes.select("node", "vector", "dim"), ["node", "dim"])
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    turns = unique.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))

    def graph(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        vectors = np.array(table["vector"].to_pylist(), np.float32)
        layers = build(vectors)
        return pa.table({
            "dim": pa.array([vectors.shape[1]], pa.int32()), "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
            "ids": pa.array([table["ids"].to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
            "nodes": pa.array([[a.tobytes() for a, _ in layers]], pa.list_(pa.binary())),
            "links": pa.array([[b.tobytes() for _, b in layers]], pa.list_(pa.binary())),
        })

    dealt = nodes.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("node"), "shards").cast("int"))
    graphs = stored(
        dealt.select("dim", "shard", "node", "ids", "vector").groupBy("dim", "shard").applyInArrow(
            graph, "dim int, shard int, ids array<array<long>>, vectors binary, nodes array<binary>, links array<binary>"),
        "neighbours-graphs")

    def ask(key: tuple, queries: pa.Table, graphs: pa.Table) -> pa.Table:
        columns: list = [[], [], []]
        if queries.num_rows and graphs.num_rows:
            dim = key[0].as_py()
            ids = graphs["ids"][0].as_py()
            vectors = np.frombuffer(graphs["vectors"][0].as_py(), np.float32).reshape(-1, dim)
            layers = [
                (np.frombuffer(a, np.int32), np.frombuffer(b, np.int32).reshape(len(a) // 4, -1))
                for a, b in zip(graphs["nodes"][0].as_py(), graphs["links"][0].as_py(), strict=True)
            ]
            queries = queries.sort_by("node")
            asked = np.array(queries["vector"].to_pylist(), np.float32)
            wide, names = vectors.astype(np.float64), queries["node"].to_pylist()
            for name, one, found in zip(names, asked.astype(np.float64), answers(vectors, layers, asked, k + 1), strict=True):
                scores = (wide[found] * one).sum(axis=1)
                hits = sorted((-s, i) for s, f in zip(scores.tolist(), found.tolist(), strict=True) for i in ids[f])[: k + 1]
                columns[0] += [name] * len(hits)
                columns[1] += [i for _, i in hits]
                columns[2] += [-s for s, _ in hits]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)],
                        names=["node", "vec_id", "score"])

    blocks = unique.join(F.broadcast(turns), "dim").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int"))
    blocks = blocks.join(F.broadcast(sizes), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    meet = graphs.join(F.broadcast(turns), "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["dim", "shard", "block"]
    hits = blocks.select(*keys, "node", "vector").groupBy(*keys).cogroup(meet.drop("blocks").groupBy(*keys)).applyInArrow(
        ask, "node long, vec_id long, score double")
    best = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = asked.join(hits, "node").filter("vec_id != query_id").withColumn("rank", F.row_number().over(own))
    return found.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
