"""Near-duplicates, passages, vectors and components against brute force; the pipeline stage by stage."""

import random
import time
from collections import defaultdict
from itertools import accumulate, chain

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, neardup, passages, shared, vecdup
from tessera.llm.components import components
from tessera.llm.shared import split_words


def union(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return find


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 200)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(150)] + [(7, 7)]
    find = union(edges)
    d = spark.createDataFrame([*edges, *edges[:5], (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(d).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert components(d.where("false")).count() == 0


def corpus(rng):
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 150))] for _ in range(150)]
    texts = [" ".join(w) for w in base]
    for w in base[:60]:
        for rate in (0.01, 0.03, 0.05, 0.08):
            texts.append(" ".join(rng.choice(words) if rng.random() < rate else x for x in w))
    texts += [texts[5]] * 30 + [texts[6].upper()] * 3 + ["a", "A", "a b", "a b a b", "", " \n\t", None, "é", "É", "x " * 5000, "x " * 4000, "a b"]
    return texts


def sets(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


@pytest.mark.parametrize(("width", "block"), [(2, 3), (5, 4096)])
def test_near_duplicates(docs, monkeypatch, width, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = corpus(random.Random(1))
    s = [sets(t, width) for t in texts]
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    find = union(links)
    d = docs(*texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(d, width=width).collect()}
    assert got == {i: (len(s[i]), find(i), find(i) == i) for i in range(len(s))}
    if width == 5:
        kept = neardup.without_near_copies(d)
        assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(s)) if find(i) == i]
        again = neardup.without_near_copies(d.union(d.where("doc_id = 0")))
        assert again.count() == kept.count()


def test_near_duplicates_cases(docs):
    assert neardup.near_duplicates(docs("a").where("false")).count() == 0
    got = [tuple(r) for r in neardup.near_duplicates(docs("a b c", "a b c", "a b c", ids=[None, 5, 3])).orderBy("doc_id").collect()]
    assert got == [(None, 1, None, True), (3, 1, 3, True), (5, 1, 3, False)]


def test_pigeonhole():
    """Signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 places always share a key."""
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (300, neardup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(neardup.SYMBOLS, neardup.CHUNKS * (neardup.ERRORS + 1) - 1, replace=False)
        row[at] ^= rng.integers(1, 1 << 16, len(at)).astype(np.uint16)
    assert all(set(x) & set(y) for x, y in zip(neardup.keys(a), neardup.keys(b), strict=True))


def test_compact_windows():
    """Equal runs have equal centres wherever they lie; only runs of one repeated place have none; l and r tell which runs share a centre."""
    rng, seed = np.random.default_rng(1), 4
    for kinds in (2, 3, 60):
        v = rng.integers(0, kinds, 400).astype(np.uint32)
        starts, ends = np.array([0, 3, 3, 203]), np.array([3, 3, 203, 400])
        windows = list(zip(*passages.compact_windows(v, starts, ends, seed), strict=True))
        assert len({c for _, c, _ in windows}) == len(windows)
        seen = {}
        for s, e in zip(starts, ends, strict=True):
            for i in range(s, e - seed + 1):
                run = tuple(v[i : i + seed])
                found = [c - i for l, c, r in windows if l <= i and i + seed - 1 <= r and i <= c < i + seed]
                assert len(found) == (len(set(run)) > 1), (run, found)
                assert seen.setdefault(run, found) == found
    assert [len(x) for x in passages.compact_windows(np.zeros(0, np.uint32), np.array([0]), np.array([0]), seed)] == [0, 0, 0]


def test_passages(docs):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    p50, p60, near = text(50), text(60), text(120)
    edited = [rng.choice(words) if i in (40, 90) else w for i, w in enumerate(near)]
    d = [text(100) for _ in range(40)]
    d[1][20:20] = p50
    d[2][0:0] = p50
    d[5] += p60
    d[6][33:33] = [w.upper() for w in p60]
    d[9][10:10] = near
    d[8][50:50] = edited
    d[11][5:5] = text(5)[:1] * 80
    d[12] = d[11][5:85] + text(30)
    d[13][3:3] = p50[:49]
    d += [d[20], d[20]]
    full = docs(*(" ".join(x) for x in d), None, "", "short", "w " * 3000)
    got = {r["doc_id"]: r for r in passages.repeated_passages(full).collect()}
    assert sorted(got) == [1, 2, 5, 6, 8, 9, 11, 12, 20, 40, 41]
    assert got[1]["spans"] == "20:70" and got[2]["spans"] == "0:50" and got[1]["cut_spans"] == "" and got[2]["cut_spans"] == "0:50"
    assert got[5]["spans"] == "100:160" and got[6]["spans"] == "33:93" and got[6]["component_id"] == 5
    assert got[8]["spans"] == "50:170" and got[9]["spans"] == "10:130" and got[41]["component_id"] == 20 and got[41]["dup_words"] == 100
    assert passages.repeated_passages(full.where("false")).count() == 0
    assert passages.repeated_passages(full.where("doc_id IN (30, 31)")).count() == 0


def shared_words(texts, n=50):
    """For each document the places of words in runs of n that another document has too, and the documents that share a run."""
    words, where = [(t or "").lower().split() for t in texts], defaultdict(set)
    for i, w in enumerate(words):
        for k in range(len(w) - n + 1):
            where[tuple(w[k : k + n])].add(i)
    places, links = defaultdict(set), []
    for i, w in enumerate(words):
        for k in range(len(w) - n + 1):
            if len(own := where[tuple(w[k : k + n])]) > 1:
                places[i] |= set(range(k, k + n))
                links.append((i, min(own)))
    return places, links


@pytest.mark.parametrize(("seed", "parts", "block"), [(1, 1, 4096), (2, 16, 4096), (3, 3, 4), (5, 7, 2)])
def test_passages_against_brute_force(docs, monkeypatch, seed, parts, block):
    """Passages of 50 to 140 words, fragments of them that smaller and larger ids hold, repeated words and lines: every run of 50 equal words is reported."""
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    whole, line = [text(rng.randint(50, 140)) for _ in range(8)], text(13)
    d = []
    for _ in range(90):
        words = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(whole)
            n = rng.choice((20, 30, 45, 49, 50, 51, 60, len(p)))
            at = rng.randrange(max(1, len(p) - n + 1))
            words += p[at : at + n] + text(rng.randint(12, 40))
        if rng.random() < 0.3:
            words += [rng.choice(("la", "lo"))] * rng.randint(1, 160) + text(12)
        if rng.random() < 0.3:
            words += line * rng.randint(1, 6) + text(12)
        d.append(" ".join(words))
    d += [d[3], d[3].upper(), None, "", "la", "la " * 30_000]
    places, links = shared_words(d)
    find = union(links)
    got = {r["doc_id"]: r for r in passages.repeated_passages(docs(*d).repartition(parts)).collect()}
    for i, own in places.items():
        spans = [tuple(map(int, x.split(":"))) for x in got[i]["spans"].split(",")]
        assert own <= {k for s, e in spans for k in range(s, e)}, i
        assert got[i]["dup_words"] == sum(e - s for s, e in spans) and got[i]["n_passages"] == len(spans)
    for i, j in links:
        assert got[i]["component_id"] == got[j]["component_id"] <= find(i)
    assert sum(len(p) for p in places.values()) >= 0.95 * sum(r["dup_words"] for r in got.values())  # the rest are near passages


def test_near_passages(docs):
    """Passages with single-word edits, near enough by their whole sets: at least 0.9 of the pairs are found."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(5000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    d, near = [], 0
    while near < 60:
        p = text(rng.randint(50, 200))
        q = [y for x in p for y in ([x] if rng.random() > 0.015 else rng.choice(([], [rng.choice(vocabulary)], [x, rng.choice(vocabulary)])))]
        a, b = sets(" ".join(p), 5), sets(" ".join(q), 5)
        if p == q or min(len(p), len(q)) < 50 or 100 * len(a & b) < 80 * len(a | b):
            continue
        near += 1
        d += [" ".join(text(30) + p + text(30)), " ".join(text(40) + q + text(20))]
    got = {r["doc_id"]: r["component_id"] for r in passages.repeated_passages(docs(*d)).collect()}
    assert sum(got.get(i) == got.get(i + 1) == i for i in range(0, len(d), 2)) >= 0.9 * near


def test_groups_of_many_classes(monkeypatch):
    """Beyond ``SMALL`` classes leaders stand in for all pairs: classes with a near passage are still found."""
    import pyarrow as pa

    p, rng = passages.Shape(), np.random.default_rng(3)
    base = rng.integers(0, 60_000, 91).astype(np.uint16)
    rows = []
    for _ in range(300):
        v = base.copy()
        for at in rng.integers(0, 87, rng.integers(0, 5)):
            if not 30 <= at <= 50:
                v[at : at + 5] = rng.integers(0, 60_000, 5)
        rows.append(v)
    for _ in range(300):  # fragments: the middle alone
        v = rng.integers(0, 60_000, 91).astype(np.uint16)
        v[35:60] = base[35:60]
        rows.append(v)
    n = len(rows)
    ids = pa.array(np.arange(n))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), ids, ids, ids, ids, pa.array([v.tobytes() for v in rows], pa.binary())], names=["g", "key", "same", "lo", "hi", "view"])

    def covered():
        out = pa.Table.from_batches(list(passages._meet(p)(iter([batch.slice(0, 100), batch.slice(100)]))))
        return set(out.filter(out.column("keep")).column("same").to_pylist())

    some = covered()
    monkeypatch.setattr(passages, "SMALL", n + 1)
    every = covered()
    assert some <= every and len(some) >= 0.97 * len(every) and len(every) >= 200 and max(every) < 300


@pytest.mark.parametrize("several", [1, 3])
def test_large_groups_compare_all_pairs(monkeypatch, several):
    """Groups beyond ``SMALL`` give what comparing all pairs gives: what of each class smaller documents have, and the links, also of classes of several documents."""
    import pyarrow as pa

    p, rng = passages.Shape(), np.random.default_rng(11)
    base = rng.integers(0, 1 << 15, 91, dtype=np.uint16)
    rows = []
    for i in range(400):
        v = rng.integers(0, 1 << 15, 91, dtype=np.uint16)
        first, last = (22, 70) if i % 5 else (0, 91)
        v[first:last] = base[first:last]
        for at in rng.choice(range(22, 66), rng.integers(1, 4)):
            if not 31 <= at <= 55:
                v[at : at + 5] = rng.integers(0, 1 << 15, 5, dtype=np.uint16) if rng.random() < 0.3 else base[at : at + 5] + rng.integers(1, 4).astype(np.uint16)
        rows.append(v)
    n = len(rows)
    lo = rng.integers(0, n // several, n)
    hi = lo + rng.integers(0, several, n)
    columns = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n), lo, hi]
    batch = pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), pa.array([v.tobytes() for v in rows], pa.binary())], names=["g", "key", "same", "lo", "hi", "view"])

    def effects():
        out = pa.Table.from_batches(list(passages._meet(p)(iter([batch]))))
        find, most = union([(int(a), int(b)) for a, b in zip(out["m"].to_numpy(), out["lo"].to_numpy(), strict=True)]), defaultdict(list)
        for same, m, s, e in sorted(zip(*(out.filter(out["keep"])[c].to_pylist() for c in ("same", "m", "s", "e")), strict=True)):
            s, e = min([s, *(x[1] for x in most[same])]), max([e, *(x[2] for x in most[same])])
            most[same].append((m, s, e))
        return dict(most), {int(x): find(int(x)) for x in lo}

    some = effects()
    with monkeypatch.context() as m:
        m.setattr(passages, "SMALL", n + 1)
        assert effects() == some and len(some[0]) >= 200
    monkeypatch.setattr(passages, "PAIRS", 700)
    assert effects() == some


def test_pairs_are_compared_in_small_batches(monkeypatch):
    """Batches beyond the processor's caches took up to twice the time; how many are compared at once changes nothing."""
    p, rng, sizes, compare = passages.Shape(), np.random.default_rng(5), [], passages.near_passages
    base = rng.integers(1, 1 << 31, 2 * p.sight + 1).astype(np.uint32)
    view = np.stack([np.where(np.abs(np.arange(len(base)) - p.sight - rng.integers(15, 60) * rng.choice([-1, 1])) < 3, rng.integers(1, 1 << 31, len(base)), base) for _ in range(120)]).astype(np.uint32)
    monkeypatch.setattr(passages, "near_passages", lambda a, b, p: sizes.append(len(a)) or compare(a, b, p))
    lo = np.arange(120)
    found = list(passages._large_group(view, lo, lo, passages._equal_runs(view, np.zeros(120, np.int64), lo, lo, p), p))
    assert len(found) and sum(sizes) > passages.AT_ONCE >= max(sizes)
    i, j = np.triu_indices(120, 1)
    once, parts = compare(view[i], view[j], p), [compare(view[i[at : at + 700]], view[j[at : at + 700]], p) for at in range(0, len(i), 700)]
    assert once[0].any() and all(np.array_equal(x, np.concatenate(y)) for x, y in zip(once, zip(*parts, strict=True), strict=True))


def test_bridges_between_near_passages(docs):
    """Two clusters of passages of 58 words that differ in one word each. Only two passages of 50 words link them, which are near each other and all of their own cluster."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(9000)]
    text = lambda n: rng.sample(words, n)
    d = []
    for _ in range(3):
        one = text(58)
        other = [*one[:40], *text(1), *one[41:]]
        d += [[*x[:42], y, *x[43:]] for x in (one, other) for y in text(20)] + [one[:50], other[:50]]
    got = {r["doc_id"]: r["component_id"] for r in passages.repeated_passages(docs(*(" ".join(text(30) + x + text(30)) for x in d))).collect()}
    assert got == {i: i - i % 42 for i in range(len(d))}


def test_near_passages_of_uneven_edits(docs):
    """One edit of a words into b words in the middle of 80, also phrases said twice: near however a and b differ."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(9000)]
    text = lambda n: rng.sample(words, n)
    pairs = [(p := text(80), [*p[:40], *text(b), *p[40 + a :]]) for a in range(6) for b in range(6 - a) if a + b]
    pairs += [(p := text(80), [*p[:40], *p[40 - n : 40], *p[40:]]) for n in range(1, 10)]
    assert all(100 * len((x := sets(" ".join(p), 5)) & (y := sets(" ".join(q), 5))) >= 80 * len(x | y) for p, q in pairs)
    d = [" ".join(text(30) + x + text(30)) for pair in pairs for x in pair]
    got = {r["doc_id"]: r["component_id"] for r in passages.repeated_passages(docs(*d)).collect()}
    assert got == {i: i - i % 2 for i in range(len(d))}


def test_near_passages_of_long_edits(docs):
    """Two runs of 44 words with an edit of twelve words in all between: near, wherever in a run the centre is."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(9000)]
    text = lambda n: rng.sample(words, n)
    pairs = [(p := text(88 + a), [*p[:44], *text(12 - a), *p[44 + a :]]) for a in (0, 3, 6, 9, 12) for _ in range(6)]
    d = [" ".join(text(30) + x + text(30)) for pair in pairs for x in pair]
    got = {r["doc_id"]: r["component_id"] for r in passages.repeated_passages(docs(*d)).collect()}
    assert got == {i: i - i % 2 for i in range(len(d))}


@pytest.mark.parametrize("block", [4096, 3])
def test_passages_beside_fragments(docs, monkeypatch, block):
    """Passages of 55 words in two documents each, of which smaller documents quote 45 words: too few to be reported, yet they lead every key."""
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [text(55) for _ in range(6)]
    d = [text(60) + p[(at := rng.randrange(11)) : at + 45] + text(60) for p in shared for _ in range(12)]
    d += [text(60) + p + text(60) for p in shared for _ in range(2)]
    got = {r["doc_id"]: (r["component_id"], r["spans"], r["cut_spans"]) for r in passages.repeated_passages(docs(*(" ".join(x) for x in d))).collect()}
    assert got == {72 + i: (72 + i - i % 2, "60:115", "60:115" if i % 2 else "") for i in range(12)}


def test_word_hashes():
    """The words of ``split_words``, whatever their length and wherever a slice begins; equal hashes are of equal words only."""
    import pyarrow as pa

    rng = random.Random(10)
    odd = [None, "", " ", "A b\tc\nd\x0be\x0cf\rg\x1ch", "a\x00 a", "Ä ä Z z " + "x" * 64 + " " + "Y" * 65, "last", "first", None]
    texts = odd + [" ".join("aB"[rng.random() < 0.5] * rng.choice((1, 7, 8, 9, 16, 17, 63, 64, 65, 200)) + rng.choice("cd") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    word, value = {}, {}
    for first in (0, 3, 8, len(texts)):
        h, to = passages.word_hashes(pa.array(texts, pa.string()).slice(first))
        words = [split_words(t) for t in texts[first:]]
        assert to.tolist() == list(accumulate(len(w) for w in words))
        assert all(value.setdefault(w, x) == x and word.setdefault(x, w) == w for w, x in zip(chain.from_iterable(words), h.tolist(), strict=True))
        s, ends = passages.sequences(pa.array(texts, pa.string()).slice(first), 5)
        assert np.diff(ends, prepend=0).tolist() == [max(0, len(w) - 4) for w in words] and len(s) == sum(max(0, len(w) - 4) for w in words)
    assert len(word) > 20


def test_groups_within_others(spark):
    """Groups that lie within another one are left out; classes that meet in any group still meet in one that stays."""
    rng = random.Random(11)
    classes = [(k := rng.randrange(40), 100 + (k // 4 if rng.random() < 0.9 else rng.randrange(12)) if rng.random() < 0.8 else None, rng.randrange(90)) for _ in range(200)]
    classes += [(50, 150, 1), (50, 150, 2), (51, 151, 1), (51, 151, 2), (51, None, 3), (52, 152, 7), (52, 152, 7), (53, None, 4), (53, None, 5)]
    rows = [(g, b, d, d) for k, o, d in classes for g, b in ((k, o), (o, k)) if g is not None]
    members = defaultdict(set)
    for i, (k, o, _) in enumerate(classes):
        for g in (k, o):
            members[g].add(i)
    alive = {g for g, own in members.items() if g is not None and len({classes[i][2] for i in own}) > 1}
    kept = {r["group"]: r["n"] for r in passages._groups(spark.createDataFrame(rows, "group long, beside long, lo long, hi long")).collect()}
    meet = lambda groups: {(i, j) for g in groups for i in members[g] for j in members[g] if i < j}
    assert kept == {g: len(members[g]) for g in kept} and meet(kept) == meet(alive) and len(kept) < len(alive) - 10
    assert kept.keys() & {50, 150, 51, 151, 52, 152, 53} == {50, 51, 53}


def test_passages_take_little_disk(spark, docs, monkeypatch, tmp_path):
    """Of long documents only what surrounds shared windows takes room, and what is over goes: the table of windows, and the shuffle files."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60_000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    d = [text(3000) for _ in range(60)]
    for i in range(30):
        d[i][1500:1500] = d[i + 30][900:900] = text(60)

    def left():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(x.length() for x in map(files.apply, range(files.size())) if x.getName().startswith("shuffle_"))

    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    found = passages.repeated_passages(docs(*(" ".join(x) for x in d)))
    until = time.monotonic() + 20  # Spark deletes them in a thread of its own
    while left() > 200_000 and time.monotonic() < until:
        time.sleep(0.2)
    assert left() <= 200_000
    got = {r["doc_id"]: (r["spans"], r["cut_spans"], r["component_id"]) for r in found.collect()}
    assert got == {i: ("1500:1560", "", i) if i < 30 else ("900:960", "900:960", i - 30) for i in range(60)}
    size = {p.name.split("-")[0]: sum(f.stat().st_size for f in p.glob("*.parquet")) for p in tmp_path.iterdir()}
    assert "windows" not in size and 0 < size["sequences"] < 0.25 * 4 * 60 * 3056


def test_passages_of_repeated_ids(docs):
    """A short text and a long one by the same id: what is shared far in the long one says nothing of the texts that come after the short one."""
    rng = random.Random(13)
    words = [f"w{i}" for i in range(60_000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    long = [text(3000) for _ in range(40)]
    for i in range(0, 40, 2):
        long[i][2000:2000] = long[i + 1][1193 + 7 * (i + 1) : 1193 + 7 * (i + 1)] = text(60)
    rows = [(i, x) for i in range(40) for x in (long[i], text(60))]
    got = {r["doc_id"]: (r["spans"], r["component_id"]) for r in passages.repeated_passages(docs(*(" ".join(x) for _, x in rows), ids=[i for i, _ in rows]).repartition(1)).collect()}
    assert got == {i: (f"{1193 + 7 * i}:{1253 + 7 * i}", i - 1) if i % 2 else ("2000:2060", i) for i in range(40)}


def vectors(spark, rng, n=400):
    base = rng.standard_normal((40, 16))
    x = [base[i % 40] + rng.standard_normal(16) * 0.02 * (i % 7) for i in range(n)]
    rows = [(i, [float(v) for v in x[i]], i % 3 if i % 11 else None, "c") for i in range(n)]
    rows += [(n, rows[0][1], 0, "c"), (n + 1, [2 * v for v in rows[0][1]], 0, "c"), (n + 2, None, 0, "c"), (n + 3, [0.0] * 16, 0, "c"), (n + 4, [float("nan")] * 16, 0, "c"), (n + 5, [None] * 16, 0, "c"), (n + 6, [float("inf")] * 16, 0, "c"), (n + 7, [1.0, 2.0], 0, "c"), (None, rows[0][1], 0, "c")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n string")


def good(v):
    return v is not None and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)


@pytest.mark.parametrize(("leaf", "block"), [(400, 4096), (30, 8)])
def test_near_vectors(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(vecdup, "BLOCK", block)
    rows, d = vectors(spark, np.random.default_rng(0))
    own = [r for r in rows if r[0] is not None and r[2] is not None and good(r[1])]
    x = np.array([r[1] for r in own])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    links = [(i, j) for i in range(len(own)) for j in range(len(own)) if i != j and own[i][2] == own[j][2] and s[i, j] >= 0.98]
    n, find = defaultdict(int), union((own[i][0], own[j][0]) for i, j in links)
    for i, _ in links:
        n[own[i][0]] += 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vecdup.near_vectors(d, leaf=leaf).collect()}
    want = {r[0]: (n[r[0]], find(r[0]) if r[0] is not None else None, r[0] is None or find(r[0]) == r[0]) for r in rows}
    assert got == want
    assert vecdup.near_vectors(d.where("false")).count() == 0


def test_search(spark):
    rng = np.random.default_rng(1)
    rows, d = vectors(spark, rng, 2000)
    d = d.where("size(embedding) = 16 OR embedding IS NULL")
    own = [r for r in rows if r[0] is not None and good(r[1])]
    x = np.array([r[1] for r in own])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    got = defaultdict(list)
    for r in ann.search(d, F.col("id") % 50 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids, hits, total = [r[0] for r in own], 0, 0
    for i, q in enumerate(ids):
        if q % 50:
            assert q not in got
            continue
        s = u @ u[i]
        best = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[j], ids[j]))[:5]
        hits += len({ids[j] for j in best} & {v for v, _ in got[q]})
        total += 5
        assert len(got[q]) == 5 and all(abs(sc - s[ids.index(v)]) < 1e-12 for v, sc in got[q])
        assert [sc for _, sc in got[q]] == sorted((sc for _, sc in got[q]), reverse=True)
    assert hits / total >= 0.9
    few = ann.search(d.where("vec_id IN (0, 1, 2)"), F.col("id") % 50 == 0, k=5).collect()
    assert sorted(r["rank"] for r in few) == [1, 2] and ann.search(d.where("false"), F.lit(True)).count() == 0


def test_search_repeated_ids(spark):
    """Ten near copies of one id beside a query take one place, not all five."""
    rng = np.random.default_rng(7)
    q = rng.standard_normal(16)
    rows = [(0, q)] + [(1, q + rng.standard_normal(16) * 0.001) for _ in range(10)] + [(i, q + rng.standard_normal(16) * 0.01 * i) for i in range(2, 30)]
    d = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    score = {}
    for i, v in rows[1:]:
        score[i] = max(score.get(i, -1), float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)))
    best = sorted(score, key=lambda i: (-score[i], i))[:5]
    got = ann.search(d, F.col("id") == 0, k=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == best and best[0] == 1 and all(abs(r["score"] - score[r["vec_id"]]) < 1e-12 for r in got)


def test_graph_finds_nearest():
    rng = np.random.default_rng(2)
    c = vecdup.unit(rng.standard_normal((500, 8)))
    g, q = ann.Graph.over(c), vecdup.unit(rng.standard_normal((50, 8)))
    _, ids = g.search(q, 32)
    assert np.mean(ids[:, 0] == np.argmax(q @ c.T, axis=1)) >= 0.98
    d = np.sqrt(2 - 2 * q @ c.T)
    for r, found in enumerate(g.within(q, 1.5)):
        want = set(np.flatnonzero(d[r] <= 1.5 * d[r].min()))
        assert len(want & set(found)) >= 0.95 * len(want)


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(3)
    words = [f"word{i}" for i in range(800)]
    texts, labels = [], []
    for i in range(160):
        w = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        if i % 4 == 0:
            w[5:5] = ["idiot", "scum", "moron"]
        texts.append(" ".join(w))
        labels.append((i, 1, int(i % 4 == 0)))
    texts += [texts[1], texts[2], texts[3] + " mail a@b.co", None, ""]
    documents = docs(*texts, sources=["s", "t", None][:1] * 100 + ["t"] * 60 + [None] * 5).select("doc_id", "text", "lang", "source", "n_chars")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = documents, {}
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    for i, (name, stage) in enumerate(p.STAGES):
        now = stage(spark, now, str(tmp_path))
        if i < 4:
            assert now.columns == documents.columns
        now.write.parquet(f"{tmp_path}/out{i}")
        now = spark.read.parquet(f"{tmp_path}/out{i}")
        seen[name] = now.collect()
    ids = {n: {r["doc_id"] for r in seen[n]} for n in seen}
    assert len([i for i in ids["toxicity"] if i < 160 and i % 4 == 0]) <= 6 and len(ids["toxicity"] & {i for i in range(165) if i % 4 or i > 159}) >= 115
    assert ids["near_dedup"] == ids["toxicity"] - {160, 161, 162} and {163, 164} <= ids["near_dedup"]
    assert all("a@b.co" not in (r["text"] or "") for r in seen["pii"]) and len(seen["pii"]) == len(seen["near_dedup"])
    copies = defaultdict(int)
    for r in seen["mixing"]:
        copies[r["doc_id"]] += 1
    assert max(copies.values()) <= 3 and set(copies) <= ids["pii"]
    pieces = defaultdict(int)
    for r in seen["packing"]:
        pieces[r["doc_id"]] += r["start"] == 0
    assert pieces == copies
    assert p.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_pipeline_cases(spark, docs, tmp_path):
    """No rows, no labels; null columns, a very long text, repeated rows, columns that clash."""
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(60_000))
    d = docs("one two three four five six", None, "", long, "one two three four five six", "no id here at all", "mail me a@b.co today", ids=[1, 2, 3, 4, 1, None, 6], sources=["a", None, "a", "b", "a", None, "c"])
    d = d.withColumn("__pii", F.lit(1)).withColumn("__mix_rank", F.lit("x"))
    for rows, want in ((d.where("false"), {}), (d, {1: 1, 4: 1, None: 1, 6: 1})):
        now = rows
        for i, (_, stage) in enumerate(p.STAGES):
            now = stage(spark, now, str(tmp_path))
            if i < 4:
                assert now.columns == rows.columns
            if i == 2 and want:
                kept = {r["doc_id"]: r["text"] for r in now.collect()}
                assert set(kept) == {1, 2, 3, 4, None, 6} and kept[6] == "mail me <EMAIL> today" and kept[4] == long and now.count() == 6
        got = now.where("start = 0").groupBy("doc_id").count().collect()
        assert {r["doc_id"]: min(1, r["count"]) for r in got} == want and all(r["count"] <= 3 for r in got)


@pytest.mark.parametrize("rows", [50_000, 10**6, 10**8])
def test_leaves_stay_bounded(rows):
    """Leaves don't grow with the table, though the sample stays as it is; pairs at the threshold still meet in some tree."""
    rng = np.random.default_rng(0)
    x = vecdup.unit(rng.standard_normal((60_000, 64)))
    sample, probe = x[: vecdup.SAMPLE], x[vecdup.SAMPLE :]
    d = rng.standard_normal((2000, 64))
    a = probe[:2000]
    d = vecdup.unit(d - np.einsum("ij,ij->i", d, a)[:, None] * a)
    b = 0.981 * a + np.sqrt(1 - 0.981**2) * d
    met = np.zeros(2000, bool)
    for seed in range(vecdup.tree_count(rows, vecdup.LEAF)):
        tree = vecdup.grow(sample, rows, 0.98, seed)
        _, leaf = tree.leaves(probe)
        size = np.bincount(np.unique(leaf, return_inverse=True)[1])
        # of a leaf's rows by size: where a row of it finds itself
        mean = (size.astype(float) ** 2).sum() / size.sum() * rows / len(probe)
        assert rows > 10**6 or mean <= 4 * vecdup.LEAF
        assert tree.directions.nbytes + tree.centres.nbytes < 8e6 and tree.children.shape[0] < 1 << 15
        if rows > 10**6:  # too few probes to a leaf: count rows by the share of the nodes, and the splits beyond
            own = np.flatnonzero(tree.children[:, 0] < 0)
            share = np.bincount(leaf & 0x7FFF, minlength=len(tree.levels))[own] / len(probe)
            assert (share * rows / 2.0 ** tree.levels[own]).max() <= 8 * vecdup.LEAF
        (ra, la), (rb, lb) = tree.leaves(a), tree.leaves(b)
        together = np.intersect1d((la << 20) + ra, (lb << 20) + rb)
        met[together & ((1 << 20) - 1)] = True
    assert met.mean() >= 0.9995
