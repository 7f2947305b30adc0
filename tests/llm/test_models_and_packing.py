"""Toxicity and language by held-out accuracy, packing by an exact round trip."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid, packing, toxicity

SYLLABLES = {"en": ["th", "er", "on", "an", "re", "he", "in", "ed"], "fr": ["é", "eau", "oi", "que", "ou", "è", "tre"], "de": ["sch", "ung", "ein", "ä", "ver", "ch", "ö"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity(spark, docs):
    rng, texts, labels = random.Random(1), [], []
    for i in range(240):
        words = prose(rng, "en", rng.randint(30, 200)).split()
        if i % 3 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "Scum", "moron,", "trash"])
        texts.append(" ".join(words))
        labels.append((i, 1, int(i % 3 == 0)))
    d, lab = docs(*texts, None, "", " \n"), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, lab).collect()}
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    out = [i for i in range(240) if held(i)]
    assert np.mean([got[i]["predicted"] == labels[i][2] for i in out]) >= 0.9
    assert [got[i]["score"] for i in (240, 241, 242)] == [0, 0, 0]
    kept = toxicity.without_toxic(d, lab)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert {r["score"] for r in toxicity.toxicity(d, lab.where("false")).collect()} == {0.0}
    assert toxicity.toxicity(d.where("false"), lab).count() == 0


def test_gradients():
    """Backward passes agree with finite differences."""
    net = toxicity.Net.new(3)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6, toxicity.WORD_DIM + toxicity.CHAR_DIM)).astype(np.float32)
    ids = rng.integers(-1, 6, (4, toxicity.STEPS))
    ids[:, 0] = 1
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64)
    d = np.ones(4)
    _, tape = net.forward(net.project(x.astype(np.float64)), ids, keep=True)
    g, dx = net.backward(d, tape, ids, x.astype(np.float64))
    total = lambda xx: net.forward(net.project(xx), ids)[0].sum()
    for name, at in (("uh", (0, 1, 20)), ("wx", (1, 2, 5)), ("wa", (3, 2)), ("va", (1,)), ("wo", (4,)), ("bx", (0, 0, 40))):
        e, old = 1e-3, net.p[name][at]
        net.p[name][at] = old + e
        up = total(x.astype(np.float64))
        net.p[name][at] = old - e
        down = total(x.astype(np.float64))
        net.p[name][at] = old
        assert abs((up - down) / (2 * e) - g[name][at]) < 1e-2 * max(1, abs(g[name][at])), name
    y = x.astype(np.float64)
    y[1, 3] += 1e-3
    z = x.astype(np.float64)
    z[1, 3] -= 1e-3
    assert abs((total(y) - total(z)) / 2e-3 - dx[1, 3]) < 1e-2 * max(1, abs(dx[1, 3]))


def test_windows_cover():
    for n in (1, 31, 32, 33, 56, 57, 1000):
        w = toxicity._windows(n)
        assert {p for s in w for p in range(s, min(n, s + toxicity.STEPS))} == set(range(n))
    for n in (0, 1, 255, 256, 257, 5000):
        raw = bytes(i % 255 + 1 for i in range(n))
        w = langid.windows(raw)
        back = b"".join(bytes(x[: langid._STRIDE]) for x in w[:-1]) + bytes(w[-1])
        assert back.rstrip(b"\0") == raw


def test_languages(docs):
    rng = random.Random(2)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(300)]
    d = docs(*(prose(rng, x, rng.randint(20, 120)) for x in langs), None, "123 !", "", "é", langs=[*langs, "en", None, "en", None])
    got = {r["doc_id"]: r for r in langid.languages(d).collect()}
    out = [i for i in range(300) if held(i)]
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in out]) >= 0.95
    assert [got[i]["lang_pred"] for i in (300, 301, 302)] == ["und"] * 3 and got[303]["lang_pred"] in SYLLABLES
    assert all(0 <= r["score"] <= 1 and r["held_out"] == held(i) for i, r in got.items())
    none = langid.languages(d.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert langid.languages(d.where("false")).count() == 0


def test_folded_tables_equal_filters():
    net = langid.train(["abc def ghi " * 30, "éàü öß " * 50], ["x", "y"], epochs=1, least_steps=1)
    w = langid.windows(("abc é " * 100).encode())
    e = net.embed[w]
    slow = np.concatenate([np.stack([sum(e[:, j : j + langid.WINDOW - n + 1] @ f[j] for j in range(n))])[0].max(axis=1) for n, f in zip(langid.WIDTHS, net.filters, strict=True)], axis=1)
    assert np.allclose(net.features(w, net.pair_tables()), np.maximum(slow + net.bias, 0), atol=1e-4)


def check_pack(docs_df, texts, **kw):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs_df, **kw).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_doc) == sorted(texts)
    for i, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
    return by_seq


def test_packing(docs):
    rng = random.Random(3)
    texts = [prose(rng, "en", rng.randint(1, 900)) for _ in range(120)] + [None, "", "a", "x " * 9000, "<|endoftext|> and <|endoftext|>", "a" * 30000, "é😀 \n\n\t z"]
    d = docs(*texts)
    for shard_rows in (1000, 40):
        seqs = check_pack(d, dict(enumerate(texts)), shard_rows=shard_rows)
        padding = [packing.WINDOW - sum(r["length"] for r in rs) for rs in seqs.values()]
        assert sum(padding) < 0.05 * packing.WINDOW * len(seqs) * (1 if shard_rows == 1000 else 4)
    assert packing.pack(d.where("false")).count() == 0
    twice = d.where("doc_id < 3").union(d.where("doc_id < 3"))
    assert packing.pack(twice).count() == 2 * packing.pack(d.where("doc_id < 3")).count()


def test_best_fit_is_tightest():
    rng = random.Random(4)
    lengths = sorted((rng.randint(1, 64) for _ in range(500)), reverse=True)
    seq, off, n = packing.best_fit(lengths, 64)
    left: list[int] = []
    for length, s, o in zip(lengths, seq, off, strict=True):
        fits = [x for x in left if x >= length]
        if fits:
            assert left[s] == min(fits) and o == 64 - left[s]
        else:
            assert s == len(left) and o == 0
            left.append(64)
        left[s] -= length
    assert n == len(left)


def test_toxicity_scores_against_plain_loops():
    """Whole texts, short and very long: every window of words, one word after the other in both directions, attention, and the worst window."""
    rng, net = random.Random(5), toxicity.Net.new(2)
    texts = [prose(rng, "en", n) for n in (1, 2, toxicity.STEPS - 1, toxicity.STEPS, toxicity.STEPS + 1, 3 * toxicity.STEPS + 5, 700)] + [None, "", "Idiot! idiot"]
    h, sig = toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))

    def gru(xs, way):
        state, out = np.zeros(h), []
        for x in xs:
            g, a = x @ net.p["wx"][way] + net.p["bx"][way][0], state @ net.p["uh"][way]
            r, z = sig(g[:h] + a[:h]), sig(g[h : 2 * h] + a[h : 2 * h])
            state = state + z * (np.tanh(g[2 * h :] + r * a[2 * h :]) - state)
            out.append(state)
        return out

    def one(text):
        words = (text or "").lower().split()
        if not words:
            return 0.0
        own = toxicity._Texts([text])
        vectors = net.embed(*toxicity._inputs(own.words))[own.docs[0]]
        assert len(vectors) == len(words)
        starts = [*range(0, len(words) - toxicity.STEPS, toxicity.STRIDE), max(0, len(words) - toxicity.STEPS)]
        scores = []
        for s in starts:
            xs = vectors[s : s + toxicity.STEPS]
            both = [np.concatenate(p) for p in zip(gru(xs, 0), gru(xs[::-1], 1)[::-1], strict=True)]
            e = np.array([np.tanh(o @ net.p["wa"]) @ net.p["va"] for o in both])
            w = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            scores.append(sig(sum(a * o for a, o in zip(w, both, strict=True)) @ net.p["wo"] + net.p["bo"][0]))
        return max(scores)

    assert np.allclose(toxicity.score(net, texts), [one(t) for t in texts], atol=1e-5)


def test_language_scores_against_plain_loops():
    """Whole texts, short and very long: every filter at every place of every window, the largest value, softmax, and the mean."""
    rng, r = random.Random(6), np.random.default_rng(4)
    k = len(langid.WIDTHS) * langid.FILTERS
    net = langid.Net(["a", "b", "c"], r.standard_normal((256, langid.DIM)).astype(np.float32), [r.standard_normal((n, langid.DIM, langid.FILTERS)).astype(np.float32) for n in langid.WIDTHS], r.standard_normal(k).astype(np.float32), r.standard_normal((k, 3)).astype(np.float32), np.zeros(3, np.float32))
    net.embed[0] = 0
    texts = [prose(rng, "de", n) for n in (1, 30, 90, 400)] + ["é", "1 2", "", None]

    def one(text):
        raw = (text or "").encode()
        if not any(map(str.isalpha, text or "")):
            return "und", 0.0
        step = langid.WINDOW - max(langid.WIDTHS) + 1
        starts = [0]
        while starts[-1] + langid.WINDOW < len(raw):
            starts.append(starts[-1] + step)
        total = np.zeros(3)
        for s in starts:
            b = raw[s : s + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            f = np.concatenate([np.max([sum(net.embed[b[i + j]] @ flt[j] for j in range(n)) for i in range(langid.WINDOW - n + 1)], axis=0) for n, flt in zip(langid.WIDTHS, net.filters, strict=True)])
            z = np.maximum(f + net.bias, 0) @ net.out + net.base
            total += np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        return net.langs[int(total.argmax())], total.max() / len(starts)

    langs, scores = langid.Scorer(net)(texts)
    want = [one(t) for t in texts]
    assert langs == [w[0] for w in want] and np.allclose(scores, [w[1] for w in want], atol=1e-4)


def test_fast_ids_are_those_of_tokenizers(spark):
    """Over every whole text of the tables: what computes ids fast computes the same ids."""
    import os

    import pytest
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    if not os.path.exists("/root/testdata/sf0.1/documents.parquet"):
        pytest.skip("no tables")
    texts = [r["text"] for t, c in (("documents", "text"), ("conversations", "text"), ("benchmark", "text")) for r in spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet").where(f"{c} IS NOT NULL").select(F.col(c).alias("text")).collect()]
    encode, before = packing.encoder(path), os.environ.get("TOKENIZERS_PARALLELISM")
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    try:
        slow = Tokenizer.from_file(path)
        for at in range(0, len(texts), 2000):
            part = texts[at : at + 2000]
            assert encode(part) == [e.ids for e in slow.encode_batch(part, add_special_tokens=False)]
    finally:
        os.environ["TOKENIZERS_PARALLELISM"] = before or "false"


def test_what_is_collected_for_training_is_bounded(spark, docs):
    """An id that repeats ten thousand times is learned from once."""
    d = docs(*["le chat noir est là"] * 5, *["the black cat"] * 5, langs=["fr"] * 5 + ["en"] * 5)
    many = d.union(d.where("doc_id = 1").crossJoin(spark.range(10_000)).drop("id"))
    seen = {}
    for module, call in ((langid, lambda: langid.fit(many.select("doc_id", "text", "lang"))), (toxicity, lambda: toxicity.fit(many.select("doc_id", "text"), spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")))):
        train = module.train
        module.train = lambda texts, labels, name=module.__name__, **kw: seen.setdefault(name, len(texts)) and None
        try:
            call()
        finally:
            module.train = train
    assert max(seen.values()) <= 10 and len(seen) == 2
