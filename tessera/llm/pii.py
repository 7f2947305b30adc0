"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Native: DataFrame operations only, one pass over the whole texts, no shuffle. Spark finds matches but not their places, so the text is split by
the same pattern: lengths of the gaps and of the matches, added up, give every start in code points.

Patterns give the matches of the plain forms below, leftmost and not overlapping, but in linear time: possessive repeats
(nothing after them could use what they would give back) and a look-behind that starts runs at their beginning.

Kinds: email, ip, card (Luhn), phone, always; iban (mod-97) and ssn (kept only where nearby words lift its score to ``min_score``) are
this method's own additions. Base spans are kept whatever their score.

Defined cases: null text counts as empty and gives no span; a null id is allowed; repeated rows are rows of their own; an empty table gives an empty
result; other columns are not read; very long texts take linear time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import let

_L = "A-Za-z0-9._%+-"
#: kind → (a quick test for what every match holds, linear pattern)
PATTERNS: dict[str, tuple[str, str]] = {
    "email": ("@", rf"(?:\G|(?<![{_L}]))[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": ("", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "ssn": ("-", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
}
BASE = ("email", "ip", "card", "phone")
CONTEXT: dict[str, str] = {
    "email": r"(?i)mail|contact|write|reach",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": r"(?i)card|credit|visa|pay|account",
    "phone": r"(?i)phone|tel|call|mobile|fax|contact",
    "iban": r"(?i)iban|account|bank|transfer|konto|compte|cuenta",
    "ssn": r"(?i)\bssn\b|social security|taxpayer",
}
#: Score before context; a checksum counts for more than a shape.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
LIFT, REACH, MIN_SCORE = 0.3, 40, 0.5
#: Spans that are folded at a time.
CHUNK = 128


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes Luhn's test."""
    back = F.rpad(F.reverse(digits), 20, "0")
    total = sum(
        (F.substring(F.translate(back, "0123456789", "0246813579") if i % 2 else back, i + 1, 1).cast("int") for i in range(20)),
        F.lit(0),
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without blanks leaves 1 modulo 97 after its first four characters move to the end."""
    text = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    code = lambda c: F.ascii(c)
    step = lambda acc, c: F.when(code(c) >= 65, acc * 100 + code(c) - 55).otherwise(acc * 10 + code(c) - 48) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)).cast("int")) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.split(m, r"\.")
        return F.forall(parts, lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(parts, lambda p: F.substring(F.lpad(F.ltrim(p, F.lit("0")), 3, "0"), 1, 3) <= "255")
    if kind == "card":
        d = F.translate(m, " -", "")
        return F.length(d).between(13, 19) & luhn(F.when(F.length(d) <= 19, d).otherwise("1"))
    if kind == "phone":
        return F.length(F.translate(m, "+ ().-", "")).between(9, 15)
    if kind == "iban":
        d = F.translate(m, " ", "")
        return F.length(d).between(15, 34) & mod97(d)
    return F.lit(True)


def _chunks(array: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.floor((F.size(array) - 1) / CHUNK), F.lit(0)).cast("int"))


def _chunk(array: Column, i: Column) -> Column:
    return F.slice(array, i * CHUNK + 1, CHUNK)


def _running(values: Column, start: Column, add: Callable[[Column, Column], Column]) -> Column:
    """The running value before each element. Appending copies what is there: only for as many elements as there are chunks, or as a chunk has."""
    state = F.struct(start.cast("long").alias("now"), F.array().cast("array<bigint>").alias("seen"))
    return F.aggregate(values, state, lambda acc, x: F.struct(add(acc["now"], x).cast("long").alias("now"), F.concat(acc["seen"], F.array(acc["now"])).alias("seen")))["seen"]


def _starts(sizes: Column) -> Column:
    """Sums of all sizes before each, chunk by chunk, so that time stays in proportion to their number."""
    plus = lambda x, y: x + y
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), plus)

    def of(s: Column) -> Column:
        parts = F.transform(_chunks(s), lambda i: _chunk(s, i))
        return let(parts, lambda p: F.flatten(F.zip_with(p, _running(F.transform(p, total), F.lit(0), plus), lambda part, at: _running(part, at, plus))))

    return let(sizes, of)


#: Characters of an account number by country; a run may go on with other words after a blank.
IBAN = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _own(kind: str, m: Column) -> Column:
    """The part of a match that is meant: an account number ends where its country's length says, if a blank follows there."""
    if kind != "iban":
        return m
    n = F.try_element_at(F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in IBAN.items()) + ")"), F.substring(m, 1, 2))
    first = F.call_function("regexp_extract", m, F.concat(F.lit("^(?:[A-Z0-9]\\x20?){"), (F.coalesce(n, F.lit(34)) - 1).cast("string"), F.lit("}[A-Z0-9](?=\\x20)")), F.lit(0))
    return F.when(F.length(F.translate(m, " ", "")) <= F.coalesce(n, F.lit(34)), m).when(first != "", first).otherwise(m)


def find(text: Column, kind: str) -> Column:
    """All confirmed spans of one kind in order: array of (kind, start, end, score); code points, end exclusive."""
    test, pattern = PATTERNS[kind]
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(p: Column) -> Column:
        """p: each match m with the gap g before it; last comes the text's rest, without a match."""

        def near(x: Column, i: Column) -> Column:
            # the REACH characters on either side, beyond the neighbouring match too
            before, after, later = F.get(p, i - 1), F.get(p, i + 1), F.get(p, i + 2)
            end = lambda c: F.coalesce(F.substring(c, -REACH, REACH), F.lit(""))
            begin = lambda c: F.coalesce(F.substring(c, 1, REACH), F.lit(""))
            left = F.concat(F.when(i > 0, F.concat(end(before["g"]), end(before["m"]))).otherwise(""), end(x["g"]))
            return F.concat(end(left), F.lit("\n"), begin(F.concat(begin(after["g"]), begin(after["m"]), begin(later["g"]))))

        sizes = F.transform(p, lambda x: (F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0))).cast("long"))

        def one(x: Column, i: Column, at: Column) -> Column:
            score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near(x, i).rlike(CONTEXT[kind]), LIFT).otherwise(0.0))
            start = at + F.length(x["g"])
            return F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), (start + F.length(_own(kind, x["m"]))).cast("long").alias("end"), score.alias("score"))

        placed = F.zip_with(p, _starts(sizes), lambda x, at: F.struct(x["g"].alias("g"), x["m"].alias("m"), at.alias("at")))
        found = F.transform(placed, lambda x, i: F.when(x["m"].isNotNull() & _valid(kind, _own(kind, x["m"])), one(x, i, x["at"])))
        return F.array_compact(found)

    found = let(F.zip_with(gaps, hits, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), spans)
    if kind not in BASE:
        found = F.filter(found, lambda s: s["score"] >= MIN_SCORE)
    likely = text.rlike({"ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"}[kind]) if not test else F.contains(text, F.lit(test))
    return F.when(likely, found).otherwise(none)


def pii_spans(docs: DataFrame, *, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with one more column: all spans, by kind as listed, then start."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(out, F.concat(*(find(t, k) for k in PATTERNS)))


def _said(text: Column, spans: Column) -> Column:
    """The text with each span, in order, replaced by its kind; one that begins before the end of those before it is covered by them.

    Chunk by chunk: a text's characters are counted from its beginning for each chunk, not for each span."""
    parts = F.transform(_chunks(spans), lambda i: _chunk(spans, i))

    def of(p: Column) -> Column:
        most = F.transform(p, lambda part: F.coalesce(F.array_max(F.transform(part, lambda s: s["end"])), F.lit(0)).cast("long"))
        seen = _running(most, F.lit(0), F.greatest)
        last = F.array_max(most)

        def one(part: Column, begin: Column, end: Column) -> Column:
            own = F.substring(text, (begin + 1).cast("int"), (F.greatest(begin, end) - begin).cast("int"))
            piece = lambda x, s: F.substring(x, (s["from"] - begin + 1).cast("int"), (s["to"] - s["from"]).cast("int"))
            step = lambda acc, s: F.struct(
                F.greatest(acc["end"], s["end"]).alias("end"),
                F.when(s["start"] >= acc["end"], F.concat(acc["out"], F.array(F.struct(acc["end"].alias("from"), s["start"].alias("to"), F.upper(s["kind"]).alias("kind"))))).otherwise(acc["out"]).alias("out"),
            )
            kept = F.aggregate(part, F.struct(begin.alias("end"), F.array().cast("array<struct<from:bigint,to:bigint,kind:string>>").alias("out")), step)["out"]
            return let(own, lambda x: F.array_join(F.transform(kept, lambda s: F.concat(piece(x, s), F.lit("<"), s["kind"], F.lit(">"))), ""))

        placed = F.zip_with(p, F.zip_with(seen, most, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda part, at: one(part, at["a"], at["b"]))
        return F.concat(F.array_join(placed, ""), F.substring(text, (last + 1).cast("int"), F.length(text)))

    return let(parts, of)


def redacted(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by ``<KIND>``; where spans overlap, the one that starts first covers, then the longer."""
    name = "__pii"
    while name in docs.columns:
        name += "_"
    order = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["end"] != b["end"], F.when(a["end"] > b["end"], -1).otherwise(1)).otherwise(0)
    found = pii_spans(docs, text=text, out=name).withColumn(name, F.array_sort(name, order))
    return found.withColumn(text, F.when(F.size(name) > 0, _said(F.col(text), F.col(name))).otherwise(F.col(text))).drop(name)


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by base kind, a digest of the base spans, all spans, and the best score."""
    found = pii_spans(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    s = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(digest(F.filter(s, lambda x: x["kind"].isin(*BASE))).cast("binary"), 256).alias("base_sha256"),
        digest(s).alias("spans"),
        F.array_max(F.transform(s, lambda x: x["score"])).alias("max_score"),
    )
