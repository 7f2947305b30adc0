"""Language of whole texts: a convolutional network over bytes, trained in numpy on labelled text.

Bytes are embedded; filters of several widths run over them; each filter's largest value in a window, rectified, is a feature; softmax gives the
language. Texts are read in windows of ``WINDOW`` bytes, all of them, which overlap by the widest filter; a text's language is that of the
largest mean probability, and that mean is its score.

For scoring, embedding and filters are folded into tables by byte and by pair of bytes, so that a position costs a few look-ups.

Training sees at most ``per_language`` documents of each language, of at most ``max_chars`` characters each, chosen by a hash of the id, none of the
held-out ones. Only the network (about 20 kB) is sent to the executors, and scoring shuffles nothing.

Defined cases: null text or text without a letter: ``und``, score 0; a null lang is not learned from; a null id counts as an empty text for the held-out
rule; repeated rows are rows of their own; without any labelled text all is ``und``; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import held_out, map_arrow

WINDOW, DIM, FILTERS, WIDTHS, CHUNK = 256, 8, 24, (2, 3, 4), 128
_STRIDE = WINDOW - max(WIDTHS) + 1


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text; the last is filled with zero bytes."""
    n = max(1, -(-(len(raw) - max(WIDTHS) + 1) // _STRIDE))
    flat = np.zeros((n - 1) * _STRIDE + WINDOW, dtype=np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::_STRIDE]


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray  # (256, DIM); the zero byte stays zero
    filters: list[np.ndarray]  # (width, DIM, FILTERS) each
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray  # (features, langs)
    base: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width: by byte at each place."""
        return [[(self.embed @ f[j]).astype(np.float32) for j in range(len(f))] for f in self.filters]

    def pair_tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """For each width: (place, table), by pair of bytes where two places are left, else by byte."""
        out = []
        for t in self.tables():
            parts, j = [], 0
            while j < len(t):
                if j + 1 < len(t):
                    parts.append((j, (t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS)))
                    j += 2
                else:
                    parts.append((j, t[j]))
                    j += 1
            out.append(parts)
        return out

    def features(self, w: np.ndarray, tables: list[list[tuple[int, np.ndarray]]]) -> np.ndarray:
        """Rectified largest filter values of windows (n, WINDOW)."""
        one = w.astype(np.int32)
        pair = one[:, :-1] * 256 + one[:, 1:]
        out = []
        for width, parts in zip(WIDTHS, tables, strict=True):
            n, acc = WINDOW - width + 1, None
            for j, t in parts:
                v = np.take(t, (pair if len(t) > 256 else one)[:, j : j + n], axis=0)
                acc = v if acc is None else np.add(acc, v, out=acc)
            out.append(acc.max(axis=1))
        return np.maximum(np.concatenate(out, axis=1) + self.bias, 0)

    def probabilities(self, f: np.ndarray) -> np.ndarray:
        z = f @ self.out + self.base
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], *, per_text: int = 8, epochs: int = 10, least_steps: int = 300, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Net | None:
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    rows, ys = [], []
    for t, label in zip(texts, labels, strict=True):
        w = windows(t.encode("utf-8", "surrogatepass"))
        pick = rng.permutation(len(w))[:per_text]
        rows.append(w[pick])
        ys += [langs.index(label)] * len(pick)
    w, y = np.concatenate(rows).astype(np.int64), np.array(ys)
    k = len(WIDTHS) * FILTERS
    r = lambda *s, by: (rng.standard_normal(s) / np.sqrt(by)).astype(np.float32)
    net = Net(langs, r(256, DIM, by=1), [r(n, DIM, FILTERS, by=n * DIM) for n in WIDTHS], np.zeros(k, np.float32), r(k, len(langs), by=k), np.zeros(len(langs), np.float32))
    net.embed[0] = 0
    params = {"embed": net.embed, "bias": net.bias, "out": net.out, "base": net.base} | {f"f{i}": f for i, f in enumerate(net.filters)}
    state = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in params.items()}
    step = 0
    for _ in range(max(epochs, least_steps * batch // len(w))):
        order = rng.permutation(len(w))
        for at in range(0, len(w), batch):
            x, target = w[order[at : at + batch]], y[order[at : at + batch]]
            tables, peaks, values = net.tables(), [], []
            for width, t in zip(WIDTHS, tables, strict=True):
                n = WINDOW - width + 1
                acc = t[0][x[:, :n]]
                for j in range(1, width):
                    acc += t[j][x[:, j : j + n]]
                peaks.append(acc.argmax(axis=1))
                values.append(np.take_along_axis(acc, peaks[-1][:, None, :], axis=1)[:, 0])
            f = np.maximum(np.concatenate(values, axis=1) + net.bias, 0)
            p = net.probabilities(f)
            p[np.arange(len(x)), target] -= 1
            p /= len(x)
            g = {"out": f.T @ p, "base": p.sum(axis=0), "embed": np.zeros_like(net.embed)}
            df = (p @ net.out.T) * (f > 0)
            g["bias"] = df.sum(axis=0)
            for i, width in enumerate(WIDTHS):
                part = df[:, i * FILTERS : (i + 1) * FILTERS]
                g[f"f{i}"] = np.zeros_like(net.filters[i])
                for j in range(width):
                    seen = np.take_along_axis(x, peaks[i] + j, axis=1)
                    dt = np.zeros((256, FILTERS), np.float32)
                    np.add.at(dt, (seen, np.arange(FILTERS)), part)
                    g[f"f{i}"][j] = net.embed.T @ dt
                    g["embed"] += dt @ net.filters[i][j].T
            g["embed"][0] = 0
            step += 1
            for n, v in g.items():
                m1, m2 = state[n]
                m1 += 0.1 * (v - m1)
                m2 += 0.001 * (v * v - m2)
                params[n] -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    def __init__(self, net: Net):
        self.net, self.tables = net, net.pair_tables()

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        own = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not own:
            return langs, scores
        parts = [windows(texts[i].encode("utf-8", "surrogatepass")) for i in own]
        counts = np.array([len(p) for p in parts])
        w = np.concatenate(parts)
        f = np.concatenate([self.net.features(w[at : at + CHUNK], self.tables) for at in range(0, len(w), CHUNK)])
        p = np.add.reduceat(self.net.probabilities(f), np.cumsum(counts) - counts, axis=0) / counts[:, None]
        best = p.argmax(axis=1)
        for i, b, q in zip(own, best, p[np.arange(len(own)), best], strict=True):
            langs[i], scores[i] = self.net.langs[b], min(1.0, float(q))
        return langs, scores


def fit(docs: DataFrame, *, per_language: int = 400, max_chars: int = 65_536) -> Net | None:
    """Learns from at most ``per_language`` documents of each language, none held out and none longer than ``max_chars``; of each from at most eight of its windows,
    taken at random (``per_text`` of ``train``). An id that repeats counts once: what is collected is bounded by these numbers."""
    d = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = d.select("lang", "doc_id", F.xxhash64("doc_id", F.length("text")).alias("h")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language)
    chosen = F.broadcast(ids.select(F.col("lang").alias("l"), F.col("doc_id").alias("i"), F.col("h").alias("x")))  # per_language ids a language
    own = d.select("lang", "doc_id", "text", F.xxhash64("doc_id", F.length("text")).alias("h"))
    same = (F.col("lang") == F.col("l")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("x"))
    rows = sorted(own.join(chosen, same, "left_semi").groupBy("lang", "doc_id", "h").agg(F.min("text").alias("text")).select("lang", "text").collect())
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def languages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", net: Net | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    net = net or fit(docs)
    own: list[Scorer] = []

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        if net is None:
            langs, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
        else:
            own or own.append(Scorer(net))
            langs, scores = own[0](batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), one, "doc_id long, held_out boolean, lang_pred string, score double", rows=128)
