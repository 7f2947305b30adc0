"""Packing documents into sequences: overlong documents are first cut into full windows, the rest goes by best fit, longest first.

One Arrow pass turns each whole text into ids and at once into pieces: full windows of ``window`` ids, then one remainder. Only narrow rows are
shuffled (no ids): pieces go to shards by a hash of their id and start, about ``shard_rows`` documents a shard, and each shard packs
its remainders with a segment tree indexed by remaining capacity, which finds the tightest open sequence in log(window) steps. A shard
leaves a handful of sequences badly filled, so padding doesn't depend on the number of shards. Shards are independent: a lost one is packed again alike.

Ids are those of ``tokenizers`` for the vocabulary file at ``tokenizer``; where the same vocabulary also lies beside it as ``.tiktoken`` ranks, the
faster library computes them (equal ids, tested), except for texts that hold the file's special token as a string.

Defined cases: null text is empty; an empty document is the end id alone; a null id is allowed; repeated rows are packed as rows of their own;
an empty table gives an empty result; other columns are not read; a very long text is cut like any other.
"""

from __future__ import annotations

import base64
import math
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import map_arrow, written

WINDOW, END_ID, SHARD_ROWS = 2048, 1, 100_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"

_encoders: dict[str, Callable[[list[str]], list[list[int]]]] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """texts → ids, as ``Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)``. One for a process."""
    if path in _encoders:
        return _encoders[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow: list[Tokenizer] = []

    def exact(texts: list[str]) -> list[list[int]]:
        if not slow:
            slow.append(Tokenizer.from_file(path))
        return [e.ids for e in slow[0].encode_batch(texts, add_special_tokens=False)]

    ranks_at = path.removesuffix(".json") + ".tiktoken"
    encode = exact
    if os.path.exists(ranks_at):
        import json

        import public_tokenizers
        import tiktoken

        with open(ranks_at, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(texts: list[str]) -> list[list[int]]:
            return [exact([t])[0] if any(s in t for s in special) else fast.encode_ordinary(t) for t in texts]

    _encoders[path] = encode
    return encode


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Every document as full windows and one remainder, with the ids' checksum; columns ``PIECES``."""
    path = tokenizer or default_tokenizer()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(path)
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        out: list[list] = [[], [], [], [], []]
        for one, text in zip(ids, texts, strict=True):
            tokens = encode([text.as_py() or ""])[0] if text.is_valid else []
            a = np.array([*tokens, end_id], dtype="<u4")
            for at in range(0, len(a), window):
                part = a[at : at + window]
                for col, v in zip(out, (one, at, len(part), zlib.crc32(part.tobytes()), len(a)), strict=True):
                    col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), cut, PIECES, rows=256)


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Sequence and offset for each length, given longest first; and the number of sequences.

    Leaf r of the tree counts the open sequences with r ids left; a node counts its leaves. The tightest fit for a length is the first
    non-empty leaf at or above it: climb while nothing lies right of the path, then descend leftmost.
    """
    size = 1 << window.bit_length()
    tree = [0] * (2 * size)
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    seq, off, n = [], [], 0
    for length in lengths:
        node = size + length
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node > 1:
                node += 1
                while node < size:
                    node *= 2
                    if not tree[node]:
                        node += 1
        if node > 1:
            left = node - size
            s = open_at[left].pop()
            i = node
            while i:
                tree[i] -= 1
                i >>= 1
        else:
            left, s, n = window, n, n + 1
        seq.append(s)
        off.append(window - left)
        if left := left - length:
            open_at[left].append(s)
            i = size + left
            while i:
                tree[i] += 1
                i >>= 1
    return seq, off, n


def _pack_shard(window: int) -> Callable[[pa.Table], pa.Table]:
    def pack(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        t = t.drop_columns(["shard"])
        # a total order, so that a shard that is computed again gives the same sequences
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending")])
        seq, off, _ = best_fit(t.column("length").to_pylist(), window)
        return t.append_column("sequence_id", pa.array(np.array(seq, dtype=np.int64) + (shard << 36))).append_column("offset", pa.array(off, pa.int64()))

    return pack


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: ``PACKED``. A sequence's pieces lie in it without gaps from 0.

    Full windows are sequences as they are: only remainders, of which a document has one at most, are grouped, about ``shard_rows`` to a task."""
    p = written(pieces(docs, doc_id=doc_id, text=text, tokenizer=tokenizer, window=window, end_id=end_id), "pieces")
    full, rest = p.where(F.col("length") == window), p.where(F.col("length") < window)
    shards = max(1, math.ceil(rest.count() / shard_rows))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)))
    numbered = full.select("*", (F.monotonically_increasing_id() + F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rest.groupBy("shard").applyInArrow(_pack_shard(window), PACKED).union(numbered)


def unpack(packed: Iterator[dict]) -> dict[int | None, list[tuple[int, int]]]:
    """(start, length) by document, for tests and readers."""
    out: dict[int | None, list[tuple[int, int]]] = {}
    for r in packed:
        out.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    return {k: sorted(v) for k, v in out.items()}
