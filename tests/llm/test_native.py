"""PII, mixing and URL filter against brute force, and their plans."""

import hashlib
import re
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.llm import mixing, pii, urls

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out, counts = [], []
    for kind, p in BASE.items():
        n = 0
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            n += 1
            out.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return (*counts, hashlib.sha256(",".join(out).encode()).hexdigest())


def check_pii(docs, texts):
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.pii_report(docs(*texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_pii_cases(docs):
    check_pii(docs, ["a@b.c_d@e.f x..y@z.a.b..c 1.2.3.4.5.6.7.8 999.1.1.1", None, "", "😀 a@b.co 😀 4111-1111-1111-1111 +1 (555) 010-9999 )", "4111 1111 1111 1111 4111111111111111 5", "1" * 5000, "+1" + " " * 5000, "1 " * 5000, "0.0.0.255 0255.1.1.1 1.1.1.256", "@.@a.b@ é@b.co a@b.c\na@b.d"])


@given(st.lists(st.text(alphabet="a1.@-+ (4😀\n", max_size=40), min_size=1, max_size=40))
@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
def test_pii_random(docs, texts):
    check_pii(docs, texts)


def test_pii_own_kinds_and_redaction(docs):
    d = docs("IBAN DE89 3704 0044 0532 0130 00, not DE88370400440532013000; ssn 078-05-1120", "no context 078-05-1120", None, "mail a@b.co now")
    got = [r["spans"] for r in pii.pii_report(d).orderBy("doc_id").collect()]
    assert got == ["iban:5:32,ssn:66:77".replace("66:77", f"{len('IBAN DE89 3704 0044 0532 0130 00, not DE88370400440532013000; ssn ')}:{len('IBAN DE89 3704 0044 0532 0130 00, not DE88370400440532013000; ssn ') + 11}"), "", "", "email:5:11"]
    red = [r["text"] for r in pii.redacted(d).orderBy("doc_id").collect()]
    assert red[3] == "mail <EMAIL> now" and red[2] is None and pii.redacted(d).columns == d.columns


def test_pii_context_and_account_numbers(docs):
    """Words count across a neighbouring match; an account number ends where its country says."""
    d = docs("SSN: 123-45-6789, 219-09-9999", "DE89 3704 0044 0532 0130 00 AND MORE 12", "GB82 WEST 1234 5698 7654 32, iban", "DE89370400440532013000AND")
    got = [r["spans"] for r in pii.pii_report(d).orderBy("doc_id").collect()]
    assert got == ["ssn:5:16,ssn:18:29", "iban:0:27", "iban:0:27", ""]


def brute_redacted(text):
    """From the report's spans: the one that starts first covers those that begin before its end, then the longer."""
    return lambda spans: _cover(text, sorted(((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)), key=lambda x: (x[0], -x[1])))


def _cover(text, spans):
    out, end = "", 0
    for s, e, k in spans:
        if s >= end:
            out += text[end:s] + f"<{k.upper()}>"
        end = max(end, e)
    return out + text[end:]


def test_redaction_against_brute_force(docs):
    many = " ".join(f"p{i}@b{i % 7}.co, +1 555 010 {i:04d} é😀" for i in range(400))
    texts = [many, "4111 1111 1111 1111 +4111111111111111 mail x@1.2.3.4", "", None, "plain", "a@b.co" * 300]
    d = docs(*texts).withColumnRenamed("key", "__pii")
    spans = {r["doc_id"]: r["spans"] for r in pii.pii_report(d).collect()}
    got = pii.redacted(d)
    assert got.columns == d.columns and {r["doc_id"]: r["text"] for r in got.collect()} == {i: t and brute_redacted(t)(spans[i]) for i, t in enumerate(texts)}
    assert {r["__pii"] for r in got.collect()} == {"x"}


def test_pii_time_is_linear(docs):
    """Twice the spans take at most 2.5 times as long."""
    import time

    def took(n):
        d = docs(" ".join(f"u{i}@mail.example" for i in range(n)))
        best = 1e9
        for _ in range(2):
            began = time.perf_counter()
            assert pii.pii_report(d).first()["n_email"] == n and pii.redacted(d).first()["text"].count("<EMAIL>") == n
            best = min(best, time.perf_counter() - began)
        return best

    took(100)
    assert took(32_000) <= 2.5 * took(16_000)


def test_pii_empty_table_and_plan(docs, spark):
    assert pii.pii_report(docs("x").where("false")).count() == 0
    plan = pii.pii_report(docs("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def water(sizes, times=3):
    """Targets by repeated sharing, as the contract says it."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, weight = total - sum(times * sizes[s] for s in capped), sum(w[s] for s in sizes if s not in capped)
        t = {s: times * sizes[s] if s in capped else rest * w[s] / weight for s in sizes}
        if not (over := {s for s in sizes if t[s] > times * sizes[s] + 1e-9}):
            return t
        capped |= over


def test_mixing(docs):
    texts, sources = [], []
    for s, n, k in (("b", 300, 5), ("a", 20, 3), (None, 10, 4), ("c", 3, 2), ("é", 40, 7)):
        for i in range(n):
            texts.append(" ".join(["w"] * (1 + i % k * 3)))
            sources.append(s)
    texts += [None, "", " \t\n", "w " * 20000]
    sources += ["a", "b", "c", "b"]
    d = docs(*texts, sources=sources)
    for block_rows in (10_000, 20):
        got = mixing.mix_plan(d, block_rows=block_rows).collect()
        assert sorted((r["doc_id"], r["size"]) for r in got) == [(i, len((t or "").split())) for i, t in enumerate(texts)]
        sizes, taken, target = defaultdict(int), defaultdict(int), {}
        for r in got:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
            assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        assert target == pytest.approx(water(dict(sizes)))
        assert sum(target.values()) == pytest.approx(sum(sizes.values()))
        for s, t in target.items():
            assert abs(taken[s] - t) <= (20_000 if s == "b" else 40 if block_rows > 20 else 60)
        assert sorted(got) == sorted(mixing.mix_plan(d, block_rows=block_rows).collect())
    out = mixing.mixed(d)
    assert out.columns == d.columns and out.count() == sum(r["copies"] for r in mixing.mix_plan(d).collect())
    assert mixing.mix_plan(d.where("false")).count() == 0
    assert "Python" not in mixing.mix_plan(d)._jdf.queryExecution().executedPlan().toString()


def ref_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    h = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in h), re.match(r"[^?#]*", rest[len(h) :])[0]


def test_urls(spark):
    names = [None, "", "x", "http://", "HTTP://A.Example.ORG/es/1?x", "https://example.org/en/12", "https://example.org/en/2", "https://myexample.org/es/", "http://a.com/de/", "http://a.com/fr/x#y", "http://com/de/x", "http://m.lucky-casino-slots.example.net/en/1", "http://ththre.example.net/en/1", "http://x.net?://y", "http://x.org", "ftp://a\nb.net/c", "http://ÀB.net/É"]
    d = spark.createDataFrame([(i, u, "html", "dup") for i, u in enumerate(names)] + [(None, "http://a.net/", "h", "d")], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: r for r in urls.url_filter(d).collect()}
    for i, u in enumerate(names):
        assert (got[i]["host"], got[i]["path"]) == ref_url(u), u
    assert [got[i]["rule"] for i in (4, 5, 6, 7, 8, 9, 10, 14)] == ["example.org/es/", "example.org/en/1", "org/", "org/", "com/de/", "com/fr/", "com/de/", None]
    assert [got[i]["verdict"] for i in (0, 4, 5, 6, 8, 9, 11, 12)] == ["allow", "block", "block", "allow", "block", "allow", "block", "allow"]
    assert urls.url_filter(d.where("false")).count() == 0
    plan = urls.url_filter(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_url_training_is_logistic_regression(spark):
    """The weights from one number per example are those of gradient descent on the weights themselves."""
    import math

    from pyspark.sql import functions as F

    rows = [("http://aaaa.net/x", 1), ("http://aaab.net/y", 1), ("http://bbbb.net/x", 0), ("http://cccc.net/z", 0)]
    d = spark.createDataFrame(rows, "url string, blocked int")
    got, bias = urls.train(d)
    feats = []
    for r in d.select(urls.ngrams(urls.host(F.col("url")), urls.path(F.col("url"))).alias("g")).collect():
        c = defaultdict(int)
        for b in r["g"]:
            c[b] += 1
        norm = math.sqrt(sum(v * v for v in c.values()))
        feats.append({b: v / norm for b, v in c.items()})
    import numpy as np

    n, buckets = len(rows), sorted({b for f in feats for b in f})
    x = np.array([[f.get(b, 0.0) for b in buckets] for f in feats])
    y, mean = np.array([float(v) for _, v in rows]), x.mean(axis=0)
    z = np.hstack([x - mean, np.full((n, 1), math.sqrt(urls.BIAS))])  # centred n-grams, and the intercept's
    rate = 4 * n / np.abs(z @ z.T).sum(axis=1).max()
    w = last = u = np.zeros(z.shape[1])
    for t in range(1, urls.STEPS + 1):
        last, w = w, u * (1 - rate * urls.DECAY) + rate * z.T @ (y - 1 / (1 + np.exp(-z @ u))) / n
        u = w + t / (t + 3) * (w - last)
    assert bias == pytest.approx(w[-1] * math.sqrt(urls.BIAS) - w[:-1] @ mean, abs=1e-6)
    assert all(got[b] == pytest.approx(v, abs=1e-6) for b, v in zip(buckets, w, strict=False))


def test_labelled_names_are_not_in_the_tables(spark):
    """The model must know no name of the tables it is tried on; and it separates names held out from it better than chance."""
    import glob

    names = {*urls._BAD, *urls._GOOD}
    assert len(names) == len(urls._BAD) + len(urls._GOOD) and len(names) <= urls.MAX_LABELLED
    for d in glob.glob("/root/testdata/*/pages.parquet"):
        hosts = {label for r in spark.read.parquet(d).select(urls.host("url").alias("h")).distinct().collect() for label in r["h"].split(".")}
        assert not names & hosts, d
