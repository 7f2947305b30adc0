"""Near-duplicate embeddings: a forest of random-projection trees with spill overlap, compared within leaves, verified and united.

1. Equal vectors of one label are one class; its smallest id stands for it (a group of copies is one vector from here on).
2. Each tree splits recursively along random directions near the median of a bounded sample (``SAMPLE`` vectors on the driver). Where the sample is too small to
   split on, leaves that would still get too many rows are split further along random directions through the centre of the sample that they hold, as often as
   their expected size asks for: leaves stay bounded at any number of rows, and what is sent to the executors doesn't grow with it. A vector within the
   overlap of a split goes to both sides; a pair at the threshold is parted by one split with probability of about 0.01, and there are as many trees (``TREES`` or
   more, by the logarithm of the rows) as leave all of them with under 2e-6.
3. One Arrow pass sends every vector down all trees. Leaves of one label are compared as matrices, in double precision. A pair counts only in its first
   common leaf, so each leaf sends on sums of links and a spanning star of its components, never its pairs.
4. A leaf of more than ``BLOCK`` members is cut into blocks, and all pairs of blocks are compared: no cap, and bounded memory.
5. The stars are united by distributed star contraction.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link with nothing; so do vectors of another length than their
partner's; a null id has component null and is kept; repeated ids share a component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import map_arrow, written

TREES, LEAF, SAMPLE, BLOCK, OVERLAP = 5, 500, 20_000, 2048, 0.65


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list column as doubles; all must have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1 if dim is None else dim) if len(column) else np.zeros((0, dim or 1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very small or large components are lost
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, each by the same operations whatever the others are, so that equal vectors tie."""
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


@dataclass
class Tree:
    directions: np.ndarray
    at: np.ndarray
    children: np.ndarray  # (nodes, 2); a leaf has -1
    overlap: float
    levels: np.ndarray  # further splits of a leaf
    centres: np.ndarray
    turns: np.ndarray  # (dim, levels): their directions, the same for all leaves

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row reaches."""
        rows, leaf, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            node, r = todo.pop()
            if not len(r):
                continue
            if self.children[node, 0] < 0:
                code = np.zeros(len(r), np.int64)
                for k in range(self.levels[node]):
                    p = (x[r] - self.centres[node]) @ self.turns[:, k]
                    low, high = p <= self.overlap, p >= -self.overlap
                    r, code = np.concatenate([r[low], r[high]]), np.concatenate([code[low] * 2, code[high] * 2 + 1])
                rows.append(r)
                leaf.append((code << 15) + node)
                continue
            p = x[r] @ self.directions[node] - self.at[node]
            todo += [(self.children[node, 0], r[p <= self.overlap]), (self.children[node, 1], r[p >= -self.overlap])]
        return np.concatenate(rows), np.concatenate(leaf)


def grow(sample: np.ndarray, rows: int, threshold: float, seed: int, leaf: float = LEAF) -> Tree:
    """A tree over unit vectors whose leaves get about ``leaf`` of ``rows`` vectors, at most about four times as many."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    overlap = OVERLAP * math.sqrt(max(0.0, 2 - 2 * threshold) / dim)
    scale = rows / max(1, len(sample))
    directions, at, children, levels, centres = [], [], [], [], []
    deep = 32 * scale > leaf
    enough = 32 if deep else 8  # a centre that leaves are split through wants more of the sample

    def node(members: np.ndarray) -> int:
        me = len(at)
        directions.append(np.zeros(dim))
        at.append(0.0)
        children.append([-1, -1])
        levels.append(min(16, math.ceil(math.log2(max(1.0, len(members) * scale / leaf)))) if deep else 0)
        centres.append(sample[members].mean(axis=0) if deep and len(members) else np.zeros(dim if deep else 0))
        if len(members) * scale > leaf and len(members) >= enough:
            d = rng.standard_normal(dim)
            d /= np.linalg.norm(d)
            p = sample[members] @ d
            s = np.quantile(p, rng.uniform(0.4, 0.6))
            low, high = members[p <= s + overlap], members[p >= s - overlap]
            if max(len(low), len(high)) < 0.9 * len(members):
                directions[me], at[me] = d, s
                children[me] = [node(low), node(high)]
        return me

    node(np.arange(len(sample)))
    turns = rng.standard_normal((dim, max(levels)))
    return Tree(np.array(directions), np.array(at), np.array(children), overlap, np.array(levels), np.array(centres), turns / np.maximum(np.linalg.norm(turns, axis=0), 1e-9))


def tree_count(rows: int, leaf: float, least: int = TREES) -> int:
    """So many trees that all of them part a pair at the threshold with probability under 2e-6: deeper ones part it more often."""
    parted = min(0.5, 0.0105 * max(1.0, math.log2(max(1.0, rows / leaf))))
    return max(least, math.ceil(math.log(2e-6) / math.log(parted)))


def _route(classes: DataFrame, trees: list[Tree], dim: int) -> DataFrame:
    """A row for each (vector, leaf), with the list of all the vector's leaves: leaf numbers are tree * 2**32 + node."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = unit(matrix(batch.column(3), dim))
        rows, leaf = zip(*((r, n + (i << 32)) for i, t in enumerate(trees) for r, n in [t.leaves(x)]), strict=True)
        rows, leaf = np.concatenate(rows), np.concatenate(leaf)
        order = np.lexsort((leaf, rows))
        rows, leaf = rows[order], leaf[order]
        ends = np.searchsorted(rows, np.arange(len(x) + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf, pa.int64()))
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), *(batch.column(i).take(take) for i in range(4)), lists.take(take)], names=["leaf", "id", "label", "n", "v", "leaves"])

    schema = classes.select("id", "label", "n", "v")
    return map_arrow(schema, one, f"leaf long, id long, label {schema.schema['label'].dataType.simpleString()}, n long, v array<{schema.schema['v'].dataType.elementType.simpleString()}>, leaves array<long>", rows=2048)


def _earlier(leaves: list[list[int]], leaf: int) -> np.ndarray:
    """(vector, leaf) as 0 or 1 for the leaves before ``leaf``: two rows' product counts the earlier leaves that they share."""
    place: dict[int, int] = {}
    at = [[place.setdefault(x, len(place)) for x in own if x < leaf] for own in leaves]
    out = np.zeros((len(leaves), max(1, len(place))), np.float32)
    for row, own in zip(out, at, strict=True):
        row[own] = 1
    return out


def _compare(threshold: float, dim: int):
    def leaf(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, n, block = t.column("id").to_numpy(), t.column("n").to_numpy(), t.column("block").to_numpy()
        x = matrix(t.column("v").combine_chunks() if isinstance(t.column("v"), pa.ChunkedArray) else t.column("v"), dim)
        u, earlier = unit(x), _earlier(t.column("leaves").to_pylist(), t.column("leaf")[0].as_py())
        across = t.column("b1")[0].as_py() != t.column("b2")[0].as_py()
        links, up = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at in range(0, len(ids), 1024):
            s = u[at : at + 1024] @ u.T
            i, j = np.nonzero(s >= threshold - 1e-9)
            i += at
            own = i < j
            if across:
                own &= block[i] != block[j]
            i, j = i[own], j[own]
            exact = np.concatenate([cosines(x[i[k : k + 50_000]], x[j[k : k + 50_000]]) for k in range(0, len(i), 50_000)]) if len(i) else np.zeros(0)
            i, j = i[exact >= threshold], j[exact >= threshold]
            if not len(i):
                continue
            while True:  # smallest member of each component so far
                low = np.minimum(up[i], up[j])
                before = up.copy()
                np.minimum.at(up, i, low)
                np.minimum.at(up, j, low)
                up = up[up]
                if (up == before).all():
                    break
            first = (earlier[at : at + 1024] @ earlier.T)[i - at, j] == 0
            np.add.at(links, i[first], n[j[first]])
            np.add.at(links, j[first], n[i[first]])
        some = (links > 0) | (up != np.arange(len(ids)))
        return pa.table({"id": ids[some], "links": links[some], "up": ids[up[some]]})

    return leaf


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    classes = written(good.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vectors")
    joined = good.join(classes, ["label", "v"]).select("vec_id", "id", F.col("n"))
    parts = classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("rows")).collect()  # one row for each length of vector
    sums = None
    for dim, count in sorted(map(tuple, parts)):
        own = classes.where(F.size("v") == dim)
        # leaves are compared label by label: a leaf may hold as many times more as there are labels (by inverse Simpson index, so one hot label counts)
        square = own.groupBy("label").count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0]
        room = leaf * max(1.0, count * count / square)
        picked = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
        sample = unit(matrix(picked.column("v").combine_chunks(), dim))
        forest = [grow(sample, count, threshold, seed, room) for seed in range(tree_count(count, room, trees))]
        routed = written(_route(own, forest, dim), "leaves")
        blocks = routed.groupBy("leaf", "label").count().select("leaf", "label", F.ceil(F.col("count") / BLOCK).cast("int").alias("nb"))
        many = routed.join(blocks.where("nb > 1"), ["leaf", "label"], "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
        many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other"))
        found = many.drop("nb", "other").groupBy("leaf", "label", "b1", "b2").applyInArrow(_compare(threshold, dim), "id long, links long, up long")
        sums = found if sums is None else sums.union(found)
    if sums is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sums = written(sums, "leaf-links")
    stars = sums.select(F.col("id").alias("a"), F.col("up").alias("b"))
    copies = joined.where("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    nodes = components(stars.union(copies)).withColumnRenamed("node", "vec_id")
    total = sums.groupBy("id").agg(F.sum("links").alias("links"))
    linked = joined.join(total, "id", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    linked = linked.groupBy("vec_id").agg(F.max("links").alias("links"))  # an id that repeats with other vectors
    component = F.coalesce("component", F.col("vec_id"))
    takes_part = F.col("label").isNotNull() & usable(F.col("v"))
    return (
        rows.withColumn("part", takes_part).select("vec_id", "part").join(linked, "vec_id", "left").join(nodes, "vec_id", "left")
        .select("vec_id", F.when(F.col("part"), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
    )


#: DuckDB's form of the query at 0.98: all pairs of a label.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
edges AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(node, comp) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT edges.y, reach.comp FROM reach JOIN edges ON reach.node = edges.x),
comps AS (SELECT node, min(comp) AS component_id FROM reach GROUP BY node),
n AS (SELECT x, count(*) AS n_links FROM edges GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comps ON node = vec_id LEFT JOIN n ON x = vec_id
"""
