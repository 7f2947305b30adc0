"""Near-duplicate documents: min-hash signatures joined by Hamming distance over several indexes, confirmed on full sets.

1. One Arrow pass over whole texts gives each document its set's size, a 128-bit fingerprint of the set, and a signature: ``SYMBOLS`` min-hashes of
   16 bits each. Documents with equal sets are one class; its smallest id stands for it from here on.
2. Signatures are cut into ``CHUNKS`` chunks. By pigeonhole, signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 symbols have a chunk
   that differs in at most ERRORS; all sets of ERRORS places of a chunk are left out in turn, and the rest is an index key. Every such pair shares a key.
   (At similarity 0.8 a pair shares none with probability 2e-5.)
3. Round one confirms, for each key, the pairs of its smallest id with the others: of a group of thousands of near copies that is one pair each.
   Confirmed links give components. Round two takes only keys that still hold several components, and confirms all pairs across them whose
   finer sketches (``SKETCH`` min-hashes of 4 bits; a pair at the threshold passes but for 1e-5) are near: no link between components is lost, and
   no group is expanded into all its pairs once it is connected.
4. Confirmation compares the full sets of 64-bit shingle hashes; texts are read again only for documents that share a key.

Hot keys: a key of more than ``BLOCK`` members in several components is compared block by block; counts per key are partial sums before the shuffle; the join back to the members splits skewed keys (adaptive execution).

Defined cases: null, empty or blank text: n_shingles 0, linked with nothing; fewer words than the width: one shingle; a null id: counted, linked
with nothing, component_id null, kept; repeated rows: rows of their own that share a component; an empty table: an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import WordHashes, map_arrow, mix64, shingles, split_words, written

SYMBOLS, CHUNKS, ERRORS, SKETCH, BLOCK = 40, 8, 1, 512, 4096
_A = mix64(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mix64(np.arange(1001, 1001 + SKETCH, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_state: dict[str, WordHashes] = {}


def _sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    known = _state.setdefault("words", WordHashes())
    words = [split_words(t) for t in texts]
    hashes = known(list(chain.from_iterable(words)))
    out, at = [], 0
    for w in words:
        out.append(np.unique(shingles(hashes[at : at + len(w)], width)))
        at += len(w)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SYMBOLS 16-bit min-hashes for each set, none of which may be empty."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    flat = np.concatenate(sets)
    out = np.empty((len(sets), SYMBOLS), dtype=np.uint16)
    for i in range(SYMBOLS):
        out[:, i] = mix64(np.minimum.reduceat(flat * _A[i], starts)) >> np.uint64(48)
    return out


def keys(sig: np.ndarray) -> np.ndarray:
    """Index keys of signatures: for every chunk and every choice of ERRORS places to leave out."""
    size = SYMBOLS // CHUNKS
    parts = sig.reshape(len(sig), CHUNKS, size).astype(np.uint64)
    out = []
    for j, left_out in enumerate(combinations(range(size), ERRORS)):
        k = np.zeros(parts.shape[:2], dtype=np.uint64)
        for p in range(size):
            if p not in left_out:
                k = mix64(k * np.uint64(65599) + parts[:, :, p] + np.uint64(1))
        out.append(mix64(k + (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(64) + np.uint64(j))))
    return np.concatenate(out, axis=1).view(np.int64)


def describe(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, c1, c2 (fingerprint of the set), sig; the last three null for an empty set."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        sets = _sets(batch.column(1).to_pylist(), width)
        full = [s for s in sets if len(s)]
        sig = iter(signatures(full)) if full else iter(())
        c1, c2, sigs = [], [], []
        for s in sets:
            if len(s):
                d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
                c1.append(int(d[0]))
                c2.append(int(d[1]))
                sigs.append(next(sig).tobytes())
            else:
                c1.append(None)
                c2.append(None)
                sigs.append(None)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(sigs, pa.binary())],
            names=["doc_id", "n_shingles", "c1", "c2", "sig"],
        )

    return map_arrow(docs, one, "doc_id long, n_shingles long, c1 long, c2 long, sig binary")


def _index(reps: DataFrame) -> DataFrame:
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
        k = keys(sig)
        return pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), k.shape[1]))], names=["key", "id"])

    return map_arrow(reps.select("id", "sig"), one, "key long, id long", rows=4096)


def sketch(values: np.ndarray) -> np.ndarray:
    """``SKETCH`` min-hashes of 4 bits of one non-empty set, 16 to a word: a much finer estimate than the index's signature."""
    mins = np.empty(SKETCH, dtype=np.uint64)
    for at in range(0, SKETCH, 32):
        mins[at : at + 32] = (values[None, :] * _B[at : at + 32, None]).min(axis=1)
    nibbles = (mix64(mins) >> np.uint64(60)).reshape(-1, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def sketch_limit(percent: int) -> int:
    """Differing places that sketches of sets at the threshold exceed with probability 1e-5."""
    p = (1 - percent / 100) * 15 / 16
    return math.ceil(SKETCH * p + 4.3 * math.sqrt(SKETCH * p * (1 - p)))


def _full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, set, sketch of the given documents: their texts are read again, and cross the network once."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = _sets(batch.column(1).to_pylist(), width)
        words = [sketch(s).tobytes() if len(s) else bytes(SKETCH // 2) for s in sets]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(words, pa.binary())], names=["id", "set", "sketch"])

    # always hashed, never broadcast: the ids grow with the documents
    own = docs.join(ids.select(F.col("id").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    # a repeated id may have several texts; a pair is confirmed if any of them are near
    return written(map_arrow(own.select("doc_id", "text"), one, "id long, set array<long>, sketch binary", rows=128), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those with 100 * intersection >= percent * union, on full sets."""
    own = sets.select("id", "set")
    left = own.withColumnsRenamed({"id": "a", "set": "sa"}).join(pairs.select("a").distinct().hint("shuffle_hash"), "a", "left_semi")
    right = own.withColumnsRenamed({"id": "b", "set": "sb"}).join(pairs.select("b").distinct().hint("shuffle_hash"), "b", "left_semi")
    both = left.join(pairs.hint("shuffle_hash"), "a").join(right.hint("shuffle_merge"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(F.least(F.size("sa"), F.size("sb")) * 100 >= F.greatest(F.size("sa"), F.size("sb")) * percent).where(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b").distinct()


def _size_ok(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes allow the similarity."""
    n = classes.select("id", "n_shingles")
    p = pairs.join(n.withColumnsRenamed({"id": "a", "n_shingles": "na"}), "a").join(n.withColumnsRenamed({"id": "b", "n_shingles": "nb"}), "b")
    return p.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b")


def _across(limit: int) -> Callable[[pa.Table], pa.Table]:
    """Pairs of one key's members that are in different components and whose sketches are near."""
    ones = np.uint64(0x1111111111111111)

    def pairs(members: pa.Table) -> pa.Table:
        members = members.sort_by("id")
        ids, comp, block = (members.column(c).to_numpy() for c in ("id", "comp", "block"))
        across = members.column("b1")[0].as_py() != members.column("b2")[0].as_py()
        sk = np.frombuffer(b"".join(members.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
        a, b = [], []
        step = max(1, 4_000_000 // len(ids))
        for at in range(0, len(ids), step):
            s = slice(at, at + step)
            own = (ids[s, None] < ids[None, :]) & (comp[s, None] != comp[None, :])
            i, j = np.nonzero(own & (block[s, None] != block[None, :]) if across else own)
            for k in range(0, len(i), 50_000):
                x = sk[s][i[k : k + 50_000]] ^ sk[j[k : k + 50_000]]
                x |= x >> np.uint64(2)
                x = (x | (x >> np.uint64(1))) & ones
                near = np.bitwise_count(x).sum(axis=1) <= limit
                a.append(ids[s][i[k : k + 50_000][near]])
                b.append(ids[j[k : k + 50_000][near]])
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return pairs


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (one document of each component)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = written(describe(docs, width), "minhash")
    usable = rows.where("doc_id IS NOT NULL AND c1 IS NOT NULL")
    classes = usable.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "sig", "n_shingles")).alias("m"), F.count("*").alias("n"))
    classes = written(classes.select("c1", "c2", "n", F.col("m.doc_id").alias("id"), F.col("m.sig").alias("sig"), F.col("m.n_shingles").alias("n_shingles")), "classes")
    copies = usable.join(classes.where("n > 1").select("c1", "c2", "id"), ["c1", "c2"]).where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))

    # hints keep one plan at every size: none of these sides is bounded, so none is broadcast
    index = written(_index(classes), "index")
    shared = index.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("key", "first")
    members = written(index.join(shared.hint("shuffle_merge"), "key"), "members")

    star = written(_size_ok(members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), classes, percent), "star")
    sets = _full_sets(docs, members.select("id"), width)
    links = written(_confirmed(star, sets, percent), "links")
    found = components(copies.union(links))

    comp = F.coalesce("component", F.col("id"))
    seen = members.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", comp.alias("comp"))
    # a key of more than BLOCK members is cut into blocks, and all pairs of blocks are looked through
    open_keys = seen.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("low <> high").select("key", "blocks")
    left = seen.join(open_keys, "key").join(sets.groupBy("id").agg(F.first("sketch").alias("sketch")), "id")
    left = left.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "id", "comp", "sketch")
    more = left.groupBy("key", "b1", "b2").applyInArrow(_across(sketch_limit(percent)), "a long, b long").distinct()
    more = written(_size_ok(more.join(star, ["a", "b"], "left_anti"), classes, percent), "more")
    if not more.isEmpty():
        found = components(copies.union(links).union(written(_confirmed(more, sets, percent), "links")))
    component = F.coalesce("component", F.col("doc_id"))
    return rows.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (columns doc_id, text and any others) without near copies: of each component the document of the smallest id stays.

    Rows without an id or without words stay. Where an id repeats, rows of equal text are copies and one stays.
    """
    dropped = near_duplicates(docs, width=width, percent=percent).where("NOT kept").select("doc_id").distinct()
    kept = docs.join(dropped.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    again = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


#: DuckDB's form of the query with two words and 0.8: all pairs that share a shingle and whose sizes allow it, then reachability.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM words),
classes AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
each AS (SELECT rep, n, unnest(s) AS g FROM classes),
links AS (
  SELECT a.rep AS x, b.rep AS y FROM each a JOIN each b ON a.g = b.g AND a.rep < b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
half AS (SELECT x, y FROM links UNION SELECT rep, doc_id FROM sets JOIN classes USING (s) WHERE rep <> doc_id),
edges AS (SELECT x, y FROM half UNION SELECT y, x FROM half),
reach(node, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT edges.y, reach.comp FROM reach JOIN edges ON reach.node = edges.x),
comps AS (SELECT node, min(comp) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comps ON node = doc_id
"""
