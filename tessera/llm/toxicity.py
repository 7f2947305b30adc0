"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, trained in numpy.

A word's input is its hashed embedding beside the mean embedding of its hashed byte n-grams; channel 0 of both starts as the training documents' log
odds. Every text is read in overlapping windows of ``STEPS`` words, all of them; a document's score is that of its worst window. Labels are of
documents, so training picks each toxic document's worst window, at first by log odds, then by the network itself.

Training sees at most ``max_per_class`` labelled documents of each class, of at most ``max_chars`` characters each, chosen by a hash of their id, none of
the held-out ones; scoring sees all texts whole. Only the network (a fixed size, about 1 MB) is sent to the executors; scoring shuffles nothing.

Defined cases: null, empty or blank text scores 0; a null id counts as an empty text for the held-out rule and scores like any other; repeated rows are
rows of their own; without labelled documents of both classes every score is 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import held_out, map_arrow, mix64

STEPS, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM, ATTEND, BUCKETS, GRAMS = 32, 24, 16, 8, 8, 8, 1 << 14, (3, 5)
CUT = 0.3  # the score that a calibrated network gives at its threshold
_STRIP = ".,;:!?\"'()[]{}<>*#$%&|"


def _inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words; buckets of all their byte n-grams, word after word; where each word's begin."""
    if len(words) > 8192:  # bounded scratch space
        parts = [_inputs(words[at : at + 8192]) for at in range(0, len(words), 8192)]
        shift = np.cumsum([0, *(len(c) for _, c, _ in parts[:-1])])
        return np.concatenate([w for w, _, _ in parts]), np.concatenate([c for _, c, _ in parts]), np.concatenate([s + k for (_, _, s), k in zip(parts, shift, strict=True)])
    raw = [b"^" + w.encode("utf-8", "surrogatepass") + b"$" for w in words]
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    ends = np.cumsum([len(r) for r in raw])
    of = np.repeat(np.arange(len(raw), dtype=np.int32), np.diff(ends, prepend=0))
    hashes, owner = [], []
    for n in GRAMS:
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            h = h * np.uint64(257) + flat[i : i + len(h)]
        inside = of[: len(h)] == of[n - 1 :]
        hashes.append((mix64(h[inside]) & np.uint64(BUCKETS - 1)).astype(np.uint16))
        owner.append(of[: len(h)][inside])
    owner_all, h_all = np.concatenate(owner), np.concatenate(hashes)
    order = np.argsort(owner_all, kind="stable")
    h_all, owner_all = h_all[order], owner_all[order]
    # a running polynomial over each word stands for the word itself
    p = np.zeros(len(raw), dtype=np.uint64)
    powers = np.add.reduceat(mix64(flat * np.uint64(1315423911) + (np.arange(len(flat), dtype=np.uint64) - np.repeat(ends - np.diff(ends, prepend=0), np.diff(ends, prepend=0)).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)), ends - np.diff(ends, prepend=0))
    p += powers
    starts = np.searchsorted(owner_all, np.arange(len(raw)))
    return (mix64(p) & np.uint64(BUCKETS - 1)).astype(np.uint16), h_all, starts


def _windows(n: int) -> np.ndarray:
    """First words of the windows that cover n words."""
    if n <= STEPS:
        return np.zeros(1, dtype=np.int64)
    return np.append(np.arange(0, n - STEPS, STRIDE), n - STEPS)


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Net:
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int = 7) -> Net:
        r, d = np.random.default_rng(seed), WORD_DIM + CHAR_DIM
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else s[0])).astype(np.float32)
        return cls({
            "word": (r.standard_normal((BUCKETS, WORD_DIM)) * 0.05).astype(np.float32), "char": (r.standard_normal((BUCKETS, CHAR_DIM)) * 0.05).astype(np.float32),
            "wx": f(2, d, 3 * HIDDEN), "bx": np.zeros((2, 1, 3 * HIDDEN), np.float32), "uh": f(2, HIDDEN, 3 * HIDDEN),
            "wa": f(2 * HIDDEN, ATTEND), "va": f(ATTEND), "wo": f(2 * HIDDEN), "bo": np.full(1, -1.0, np.float32),
        })

    def embed(self, wb: np.ndarray, cb: np.ndarray, starts: np.ndarray) -> np.ndarray:
        counts = np.diff(np.append(starts, len(cb)))
        c = np.add.reduceat(self.p["char"][cb], np.minimum(starts, len(cb) - 1)) / np.maximum(counts, 1)[:, None]
        c[counts == 0] = 0
        return np.concatenate([self.p["word"][wb], c], axis=1).astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions: (2, words, 3 * HIDDEN)."""
        return np.matmul(x[None], self.p["wx"]) + self.p["bx"]

    def forward(self, gx: np.ndarray, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows. gx: gate inputs of distinct words; ids: (windows, STEPS), -1 where a window has no more words."""
        b, t = ids.shape
        h, mask = np.zeros((2, b, HIDDEN), np.float32), ids >= 0
        out = np.zeros((t, b, 2 * HIDDEN), np.float32)
        tape, u = [], self.p["uh"]
        for k in range(t):
            at = (ids[:, k], ids[:, t - 1 - k])
            m = np.stack([mask[:, k], mask[:, t - 1 - k]])[:, :, None]
            g = np.stack([gx[0][at[0]], gx[1][at[1]]])
            a = np.matmul(h, u)
            rz = 1 / (1 + np.exp(-(g[:, :, : 2 * HIDDEN] + a[:, :, : 2 * HIDDEN])))
            r, z = rz[:, :, :HIDDEN], rz[:, :, HIDDEN:]
            an = a[:, :, 2 * HIDDEN :]
            n = np.tanh(g[:, :, 2 * HIDDEN :] + r * an)
            new = np.where(m, h + z * (n - h), h)
            if keep:
                tape.append((h, r, z, n, an, m))
            h = new
            out[k, :, :HIDDEN] = h[0]
            out[t - 1 - k, :, HIDDEN:] = h[1]
        s = np.tanh(out @ self.p["wa"])
        e = np.where(mask.T, s @ self.p["va"], -1e9)
        e = np.exp(e - e.max(axis=0))
        w = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", w, out)
        return pooled @ self.p["wo"] + self.p["bo"], {"tape": tape, "out": out, "s": s, "w": w, "pooled": pooled, "mask": mask}

    def backward(self, d: np.ndarray, c: dict, ids: np.ndarray, x: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters but for the embeddings, and of the words' inputs x. d: of the logits."""
        p, g = self.p, {}
        b, t = ids.shape
        g["wo"], g["bo"] = c["pooled"].T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["wo"]
        dw = np.einsum("bh,tbh->tb", dp, c["out"])
        de = c["w"] * (dw - (c["w"] * dw).sum(axis=0))
        ds = de[:, :, None] * p["va"] * (1 - c["s"] ** 2)
        g["va"] = np.einsum("tb,tba->a", de, c["s"])
        g["wa"] = np.einsum("tbh,tba->ha", c["out"], ds)
        dout = c["w"][:, :, None] * dp[None] + ds @ p["wa"].T
        dg = np.zeros((2, len(x), 3 * HIDDEN), np.float32)
        g["uh"], dh = np.zeros_like(p["uh"]), np.zeros((2, b, HIDDEN), np.float32)
        for k in reversed(range(t)):
            h, r, z, n, an, m = c["tape"][k]
            dh = dh + np.stack([dout[k, :, :HIDDEN], dout[t - 1 - k, :, HIDDEN:]])
            live = dh * m
            dz, dn = live * (n - h), live * z * (1 - n**2)
            dr = dn * an
            da = np.concatenate([dr * r * (1 - r), dz * z * (1 - z), dn], axis=2)
            rec = np.concatenate([da[:, :, : 2 * HIDDEN], dn * r], axis=2)
            g["uh"] += np.matmul(h.transpose(0, 2, 1), rec)
            for i, col in enumerate((k, t - 1 - k)):
                ok = ids[:, col] >= 0
                np.add.at(dg[i], ids[ok, col], da[i][ok])
            dh = np.where(m, dh - dh * z + np.matmul(rec, p["uh"].transpose(0, 2, 1)), dh)
        g["wx"] = np.matmul(x.T[None], dg)
        g["bx"] = dg.sum(axis=1, keepdims=True)
        return g, np.matmul(dg, p["wx"].transpose(0, 2, 1)).sum(axis=0)


class _Texts:
    """Words of some texts as numbers of distinct words."""

    def __init__(self, texts: list[str | None]):
        known: dict[str, int] = {}
        number = known.setdefault
        self.docs = [np.array([number(w, len(known)) for w in (t or "").lower().split()], dtype=np.int64) for t in texts]
        self.words = [w.strip(_STRIP) for w in known]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """All windows as word numbers, and the document of each; documents without words have none."""
        ids, owner = [], []
        for i, d in enumerate(self.docs):
            if len(d):
                at = _windows(len(d))[:, None] + np.arange(STEPS)
                ids.append(np.where(at < len(d), d[np.minimum(at, len(d) - 1)], -1))
                owner.append(np.full(len(at), i))
        return (np.concatenate(ids), np.concatenate(owner)) if ids else (np.zeros((0, STEPS), np.int64), np.zeros(0, np.int64))


def _log_odds(buckets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Smoothed log odds of the toxic class by bucket, from the documents that hold it."""
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, label in zip(buckets, y, strict=True):
        (pos if label else neg)[np.unique(b)] += 1
    total = pos + neg
    odds = np.log((pos + 1) / (y.sum() + 2)) - np.log((neg + 1) / ((1 - y).sum() + 2))
    return (odds * total / (total + 3)).astype(np.float32)


def train(texts: list[str], labels: list[int], *, epochs: int = 4, least_steps: int = 120, rounds: int = 3, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Net | None:
    y = np.array(labels)
    t = _Texts(texts)
    ids, owner = t.windows()
    if not len(ids) or len({*y[np.unique(owner)]}) < 2:
        return None
    rng, net = np.random.default_rng(seed), Net.new(seed)
    wb, cb, starts = _inputs(t.words)
    ends = np.append(starts[1:], len(cb))
    net.p["word"][:, 0] = _log_odds([wb[d] for d in t.docs], y) / 3
    net.p["char"][:, 0] = _log_odds([np.concatenate([cb[starts[w] : ends[w]] for w in np.unique(d)]) if len(d) else np.zeros(0, np.int64) for d in t.docs], y) / 3
    # every seventh document only sets the threshold, if there are enough toxic ones for that
    aside = (np.arange(len(y)) % 7 == 0) & ((y[::7] == 1).sum() >= 20)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    counts = np.maximum(ends - starts, 1)
    odds = net.p["word"][wb, 0] + np.add.reduceat(net.p["char"][cb, 0], np.minimum(starts, len(cb) - 1)) / counts
    worst = np.where(ids >= 0, odds[ids], -9).max(axis=1)
    step = 0
    for again in range(rounds):
        order = np.lexsort((-worst, owner))
        first = np.ones(len(order), bool)
        first[1:] = owner[order][1:] != owner[order][:-1]
        top = order[first]
        top = top[~aside[owner[top]]]
        clean = np.flatnonzero((y[owner] == 0) & ~aside[owner])
        pick = np.concatenate([top, rng.choice(clean, min(len(clean), 3 * len(top)), replace=False)])
        for _ in range(max(epochs, least_steps * batch // len(pick))):
            rng.shuffle(pick)
            for at in range(0, len(pick), batch):
                rows = pick[at : at + batch]
                used, inv = np.unique(ids[rows], return_inverse=True)
                local = inv.reshape(len(rows), STEPS) - (used[0] < 0)
                used = used[used >= 0]
                parts = [cb[starts[w] : ends[w]] for w in used]
                c, s = np.concatenate(parts), np.cumsum([0, *(len(q) for q in parts[:-1])])
                x = net.embed(wb[used], c, s)
                logits, tape = net.forward(net.project(x), local, keep=True)
                target = y[owner[rows]]
                d = ((_sig(logits) - target) / len(rows)).astype(np.float32)
                g, dx = net.backward(d, tape, local, x)
                g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
                np.add.at(g["word"], wb[used], dx[:, :WORD_DIM])
                n = np.array([len(q) for q in parts])
                np.add.at(g["char"], c, np.repeat(dx[:, WORD_DIM:] / np.maximum(n, 1)[:, None], n, axis=0))
                step += 1
                for k, v in g.items():
                    m1, m2 = state[k]
                    m1 += 0.1 * (v - m1)
                    m2 += 0.001 * (v * v - m2)
                    net.p[k] -= (rate * 0.5**again * (0.3 if k in ("word", "char") else 1) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if again + 1 < rounds:
            worst = _score_known(net, wb, cb, starts, ids)
    if aside.any():
        own = np.flatnonzero(aside[owner])
        at = np.flatnonzero(np.diff(owner[own], prepend=-1))
        net.p["bo"] -= np.float32(np.clip(_threshold(np.maximum.reduceat(_score_known(net, wb, cb, starts, ids[own]), at), y[owner[own[at]]]) - np.log(CUT / (1 - CUT)), -1, 4))
    return net


def _threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """Where the fewest documents are on the wrong side: a quarter into the widest such gap."""
    order = np.argsort(logits)
    s, label = logits[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(label)]) + np.concatenate([np.cumsum((1 - label)[::-1])[::-1], [0]])
    edges = np.concatenate([[s[0] - 2], s, [s[-1] + 2]])
    best = np.flatnonzero(wrong == wrong.min())
    k = best[np.argmax((edges[1:] - edges[:-1])[best])]
    return float(edges[k] + (edges[k + 1] - edges[k]) / 4)


def _some(cb: np.ndarray, starts: np.ndarray, ends: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-gram buckets of some words, and where each word's begin."""
    parts = [cb[starts[w] : ends[w]] for w in used]
    return np.concatenate(parts), np.cumsum([0, *(len(q) for q in parts[:-1])])


def _score_known(net: Net, wb: np.ndarray, cb: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Logits of windows, some at a time: memory doesn't follow the number of distinct words."""
    ends, out = np.append(starts[1:], len(cb)), []
    for at in range(0, len(ids), 1024):
        used, inv = np.unique(ids[at : at + 1024], return_inverse=True)
        local = inv.reshape(-1, STEPS) - (used[0] < 0)
        used = used[used >= 0]
        out.append(net.forward(net.project(net.embed(wb[used], *_some(cb, starts, ends, used))), local)[0])
    return np.concatenate(out)


def _score_windows(net: Net, t: _Texts, ids: np.ndarray) -> np.ndarray:
    gx = net.project(net.embed(*_inputs(t.words)))
    return np.concatenate([net.forward(gx, ids[at : at + 1024])[0] for at in range(0, len(ids), 1024)]) if len(ids) else np.zeros(0, np.float32)


def score(net: Net | None, texts: list[str | None]) -> np.ndarray:
    """The worst window's probability for each whole text; 0 without words."""
    out = np.zeros(len(texts))
    if net is None:
        return out
    t = _Texts(texts)
    ids, owner = t.windows()
    if len(ids):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[starts]] = _sig(np.maximum.reduceat(_score_windows(net, t, ids), starts).astype(np.float64))
    return out


def fit(docs: DataFrame, labels: DataFrame, *, max_per_class: int = 1200, max_chars: int = 65_536) -> Net | None:
    """Learns from at most ``max_per_class`` documents of each label, none held out and none longer than ``max_chars``. An id that repeats counts once with each label."""
    d = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") <= max_chars)).select("doc_id")
    own = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", "toxic").distinct().join(d, "doc_id", "left_semi")
    chosen = own.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class).union(own.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class))
    own = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(chosen), "doc_id")  # 2 * max_per_class ids at most
    rows = own.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["text"]))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = CUT, net: Net | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    net = net or fit(docs, labels)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = score(net, batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), one, "doc_id long, held_out boolean, score double, predicted int", rows=128)


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = CUT) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns. The score is taken row by row, so repeated ids don't matter."""
    net, columns = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels), docs.columns
    at = columns.index("text")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(score(net, batch.column(at).to_pylist()) < threshold))

    return map_arrow(docs, one, docs.schema, rows=128)
