"""Approximate nearest neighbours by balanced posting lists.

1. A bounded sample (``SAMPLE`` vectors on the driver) is halved again and again at the median along its main direction: the parts are equal, and their means
   are the centroids, about one for ``LIST`` vectors, ``MAX_LISTS`` at most: beyond MAX_LISTS * LIST vectors lists get longer, and a query reads the same
   share of the table rather than the same number of rows (always whole lists, so that nothing is lost by it).
2. Centroids are the nodes of a neighbour graph in memory, searched best-first; that and the centroids is all that executors are sent (a bounded size).
3. Every vector goes to its nearest centroid's list, and, if it lies at a boundary, to those of up to ``REPLICAS`` centroids within ``CLOSURE`` times the least distance.
4. A query reads the lists whose centroids are within ``ratio`` times its least distance. The ratio is learned: on ``PROBES`` sample queries with exact
   neighbours from one full scan it is the least that finds ``GOAL`` of them, so easy data read few lists and hard data many. More lists
   follow, if need be, until they hold enough vectors for k distinct neighbours.
5. Queries and postings meet by list in matrix products; lists of more than ``BLOCK`` vectors are cut into blocks. Each block sends on k distinct ids per query, each by its best row;
   scores are exact cosines of the original vectors in double precision.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows with a null id, take no part; vectors of another length than
the query's are no candidates; rows that repeat an id are candidates for other ids only, and an id is reported once, by its best row; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import map_arrow, written
from tessera.llm.vecdup import cosines, matrix, unit, usable

SAMPLE, LIST, MAX_LISTS, REPLICAS, CLOSURE, PROBES, GOAL, BLOCK, DEGREE = 30_000, 128, 4096, 4, 1.05, 200, 0.98, 8192, 24


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """Unit means of ``lists`` (about) equal parts of the unit vectors x."""
    rng, parts = np.random.default_rng(seed), [np.arange(len(x))]
    while len(parts) < lists and max(map(len, parts)) > 1:
        parts.sort(key=len)
        p = parts.pop()
        y = x[p]
        d = y[rng.integers(len(p))] - y.mean(axis=0)
        for _ in range(4):  # towards the main direction
            d = (y - y.mean(axis=0)).T @ ((y - y.mean(axis=0)) @ d)
            d /= np.linalg.norm(d) or 1
        order = np.argsort(y @ d, kind="stable")
        parts += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
    c = np.array([x[p].mean(axis=0) for p in parts])
    c[~c.any(axis=1)] = x[0]
    return unit(c)


@dataclass
class Graph:
    centroids: np.ndarray
    edges: np.ndarray
    entries: np.ndarray

    @classmethod
    def over(cls, c: np.ndarray, seed: int = 5) -> Graph:
        n, rng = len(c), np.random.default_rng(seed)
        near = [np.argsort(-(c[at : at + 512] @ c.T), axis=1, kind="stable")[:, 1 : DEGREE + 1] for at in range(0, n, 512)]
        ring = rng.permutation(n)
        after = np.empty(n, np.int64)
        after[ring] = np.roll(ring, 1)  # one ring through all nodes: none is out of reach
        return cls(c, np.concatenate([np.concatenate(near), after[:, None], rng.integers(0, n, (n, 2))], axis=1), rng.permutation(n)[: min(n, 16)])

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids found, nearest first: distances and numbers."""
        c, b = self.centroids, len(q)
        beam = min(beam, len(c))
        seen = np.zeros((b, len(c)), bool)
        seen[:, self.entries] = True
        ids = np.broadcast_to(self.entries, (b, len(self.entries)))
        sim = q @ c[self.entries].T
        done = np.zeros(ids.shape, bool)
        row = np.arange(b)[:, None]
        while True:
            order = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
            ids, sim, done = ids[row, order], sim[row, order], done[row, order]
            open_ = ~done & (sim > -9)
            if not open_.any():
                return np.sqrt(np.maximum(0, 2 - 2 * sim)), ids
            pick = np.argsort(~open_, axis=1, kind="stable")[:, :4]  # the nearest four not yet expanded
            live = open_[row, pick]
            done[row, pick] = True
            nxt = self.edges[ids[row, pick]]
            nxt = np.where(live[:, :, None], nxt, ids[:, :1, None]).reshape(b, -1)
            new = ~seen[row, nxt]
            nxt_sorted = np.sort(np.where(new, nxt, -1), axis=1)
            first = (nxt_sorted >= 0) & (np.diff(nxt_sorted, axis=1, prepend=-2) != 0)
            seen[row, np.where(first, nxt_sorted, self.entries[0])] = True
            s = np.where(first, np.einsum("bd,bmd->bm", q, c[np.where(first, nxt_sorted, 0)]), -10)
            ids, sim, done = np.concatenate([ids, nxt_sorted], axis=1), np.concatenate([sim, s], axis=1), np.concatenate([done, ~first], axis=1)

    def within(self, q: np.ndarray, ratio: float, sizes: np.ndarray | None = None, least: int = 0) -> list[np.ndarray]:
        """For each query the centroids within ``ratio`` times its least distance, and more until their lists hold ``least``; the beam doubles as long as
        they fill it."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        todo, beam = np.arange(len(q)), 64
        while len(todo):
            dist, ids = self.search(q[todo], beam)
            keep = dist <= ratio * np.maximum(dist[:, :1], 1e-6)
            if least:
                keep |= np.cumsum(sizes[ids], axis=1) - sizes[ids] < least
            full = keep[:, -1] & (dist.shape[1] < len(self.centroids))
            for r in np.flatnonzero(~full):
                out[todo[r]] = ids[r][keep[r] & (ids[r] >= 0)]
            todo, beam = todo[full], beam * 2
        return out


def _by_id(s: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and of each the best column of s."""
    order = np.argsort(ids, kind="stable")
    own, first = np.unique(ids[order], return_index=True)
    return (s, ids) if len(own) == len(ids) else (np.maximum.reduceat(s[:, order], first, axis=1), own)


def _exact(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, dim: int) -> DataFrame:
    """The k nearest of all vectors for each of some queries: one scan, k ids per query and batch."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, x = batch.column(0).to_numpy(), matrix(batch.column(1), dim)
        s = unit(q) @ unit(x).T
        s[ids[:, None] == own[None, :]] = -2
        s, own = _by_id(s, own)
        top = np.argpartition(-s, min(k, len(own)) - 1, axis=1)[:, :k]
        i = np.repeat(np.arange(len(q)), top.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(own[top.ravel()]), pa.array(s[i, top.ravel()])], names=["query_id", "vec_id", "score"])

    found = map_arrow(vectors.select("id", "v"), one, "query_id long, vec_id long, score double", rows=4096)
    return _best(found.where("score > -2"), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _post(vectors: DataFrame, graph: Graph, dim: int) -> DataFrame:
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        dist, ids = graph.search(unit(matrix(batch.column(1), dim)), 16)
        keep = dist <= CLOSURE * dist[:, :1]
        keep[:, 0], keep[:, REPLICAS:] = True, False
        i, j = np.nonzero(keep)
        return pa.RecordBatch.from_arrays([pa.array(ids[i, j]), batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i))], names=["list", "id", "v"])

    return map_arrow(vectors.select("id", "v"), one, "list long, id long, v " + vectors.schema["v"].dataType.simpleString(), rows=256)


def _ask(queries: DataFrame, graph: Graph, dim: int, ratio: float, sizes: np.ndarray, blocks: np.ndarray, least: int) -> DataFrame:
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = graph.within(unit(matrix(batch.column(1), dim)), ratio, sizes, least)
        i = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        at = np.concatenate(lists)
        i, block, at = np.repeat(i, blocks[at]), np.concatenate([np.arange(n) for n in blocks[at]] or [np.zeros(0, np.int64)]), np.repeat(at, blocks[at])
        take = pa.array(i)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(block, pa.int64()), batch.column(0).take(take), batch.column(1).take(take)], names=["list", "block", "qid", "qv"])

    return map_arrow(queries.select("id", "v"), one, "list long, block long, qid long, qv " + queries.schema["v"].dataType.simpleString(), rows=64)


def _meet(k: int, dim: int):
    def block(q: pa.Table, p: pa.Table) -> pa.Table:
        qid, ids = q.column("qid").to_numpy(), p.column("id").to_numpy()
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(qid) and len(ids):
            qx, x = matrix(q.column("qv").combine_chunks(), dim), matrix(p.column("v").combine_chunks(), dim)
            qu, u = unit(qx), unit(x)
            for at in range(0, len(qid), 256):
                s = qu[at : at + 256] @ u.T
                s[qid[at : at + 256, None] == ids[None, :]] = -2
                best, own = _by_id(s, ids)
                least = np.partition(best, max(0, len(own) - k), axis=1)[:, max(0, len(own) - k)]
                i, j = np.nonzero((s >= np.maximum(least, -1.5)[:, None] - 1e-9) & (s > -1.5))  # with what may tie
                exact = np.concatenate([cosines(qx[at + i[n : n + 50_000]], x[j[n : n + 50_000]]) for n in range(0, len(i), 50_000)]) if len(i) else np.zeros(0)
                order = np.lexsort((ids[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                if len(own) < len(ids):  # of a repeated id the best row
                    first = np.sort(np.unique(np.stack([i, ids[j]]), axis=1, return_index=True)[1])
                    i, j, exact = i[first], j[first], exact[first]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                out[0].append(qid[at + i[nth < k]])
                out[1].append(ids[j[nth < k]])
                out[2].append(exact[nth < k])
        return pa.table({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})

    return block


def search(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score. Queries are the rows for which ``is_query`` holds (over the column ``id``), candidates all rows."""
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    own = written(own.where(F.col("id").isNotNull() & usable(F.col("v"))), "vectors")
    out = None
    for dim, n in sorted(map(tuple, own.groupBy(F.size("v").alias("dim")).count().collect())):  # one row for each length of vector
        base = own.where(F.size("v") == dim)
        picked = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().combine_chunks()
        raw = matrix(picked.column("v").combine_chunks() if isinstance(picked.column("v"), pa.ChunkedArray) else picked.column("v"), dim)
        sample = unit(raw)
        graph = Graph.over(balanced_centroids(sample, max(1, min(MAX_LISTS, math.ceil(n / LIST)))))
        lists = len(graph.centroids)
        posted = written(_post(base, graph, dim), "postings")
        sizes, distinct = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
        for at, count, different in posted.groupBy("list").agg(F.count("*"), F.count_distinct("id")).collect():  # MAX_LISTS rows at most
            sizes[at], distinct[at] = count, different
        blocks = np.maximum(1, -(-sizes // BLOCK))

        probe, ids = raw[:PROBES], picked.column("id").to_numpy()[:PROBES]
        truth = _exact(base, ids, probe, k, dim).select("query_id", F.col("vec_id").alias("id"))
        near = posted.join(F.broadcast(truth), "id").select("query_id", "id", "list").collect()  # PROBES * k * REPLICAS rows at most, but for repeated ids
        ratio = 1.0
        if near:
            d = np.sqrt(np.maximum(0, 2 - 2 * (sample[:PROBES] @ graph.centroids.T)))
            place = {q: i for i, q in enumerate(ids)}
            need: dict[tuple[int, int], float] = {}
            for q, v, at in near:
                r = d[place[q], at] / max(d[place[q]].min(), 1e-6)
                need[q, v] = min(need.get((q, v), math.inf), r)
            ratio = float(np.quantile(list(need.values()), GOAL)) * (1 + 1e-9)
        asked = _ask(base.where(is_query), graph, dim, ratio, distinct, blocks, least=8 * (k + 1))
        nb = F.element_at(F.split(F.lit(",".join(map(str, blocks))), ",").cast("array<long>"), (F.col("list") + 1).cast("int"))
        cut = posted.withColumn("block", F.pmod(F.xxhash64("id"), nb))
        found = asked.groupBy("list", "block").cogroup(cut.groupBy("list", "block")).applyInArrow(_meet(k, dim), "query_id long, vec_id long, score double")
        out = found if out is None else out.union(found)
    if out is None:
        return own.where("false").select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    return _best(out, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
