"""Text schemas: attributes ``@name = value`` and ``column: Type[format]`` with optional ``@metadata={json}``; reading and writing of typed CSV by them."""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ESCAPES = {"\\t": "\t", "\\0": "\0", "semicolon": ";"}
_SIMPLE = {"String": T.StringType, "Double": T.DoubleType, "Float": T.FloatType, "Integer": T.IntegerType, "Long": T.LongType, "Boolean": T.BooleanType, "Byte": T.ByteType, "Short": T.ShortType, "Timestamp": T.TimestampType, "Date": T.DateType}
_TRIMMED = {"Double", "Float", "Integer", "Long", "Decimal", "Timestamp", "Date"}


@dataclass(frozen=True)
class CsvAttributes:
    delimiter: str = ","
    quote: str = '"'
    header: bool = False


@dataclass(frozen=True)
class Entry:
    name: str
    kind: str
    args: tuple[str, ...] = ()
    metadata: dict = field(default_factory=dict)

    @property
    def type(self) -> T.DataType:
        if self.kind == "Decimal":
            a = [int(x) for x in self.args]
            return T.DecimalType(*([10, 0] if not a else [*a, 0][:2]))
        if self.kind == "Map":
            return T.MapType(*(_entry_type(a) for a in self.args))
        if self.kind == "Array":
            return T.ArrayType(_entry_type(self.args[0]))
        return _SIMPLE[self.kind]()

    @property
    def text(self) -> str:
        return self.kind + (f"[{','.join(self.args)}]" if self.args else "")


def _split_args(text: str) -> tuple[str, ...]:
    out, depth = [""], 0
    for ch in text:
        depth += (ch == "[") - (ch == "]")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return tuple(x.strip() for x in out)


def parse_type(text: str) -> tuple[str, tuple[str, ...]]:
    m = re.fullmatch(r"\s*(\w+)\s*(?:\[\s*(.*?)\s*\])?\s*", text, re.S)
    kind = m and m[1][0].upper() + m[1][1:]
    if not m or kind not in {*_SIMPLE, "Decimal", "Map", "Array"}:
        raise ValueError(f"unsupported type: {text.strip()}")
    if not m[2]:
        return kind, ()
    return kind, _split_args(m[2]) if kind in ("Decimal", "Map", "Array", "String") else (m[2],)


def _entry_type(text: str) -> T.DataType:
    return Entry("", *parse_type(text)).type


def read_cell(c: Column, kind: str, args: tuple[str, ...]) -> Column:
    """A string cell as a value; what can't be read is null."""
    if kind == "String":
        return F.nullif(c, F.lit(args[1] if len(args) > 1 else ""))
    c = F.nullif(F.trim(c) if kind in _TRIMMED else c, F.lit(""))
    if kind == "Timestamp":
        return F.try_to_timestamp(c, F.lit(args[0])) if args else F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss.S")), F.try_to_timestamp(c))
    if kind == "Date":
        return F.try_to_timestamp(c, F.lit(args[0] if args else "yyyy-MM-dd")).cast("date")
    if kind == "Array":
        one = parse_type(args[0])
        return F.transform(F.split(c, r"\|", -1), lambda x: read_cell(x, *one))
    if kind == "Map":
        k, v = parse_type(args[0]), parse_type(args[1])
        parts = F.split(c, r"\|", -1)
        at = lambda i, off: F.element_at(parts, i * 2 + off)
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), lambda i: F.struct(read_cell(at(i, 1), *k).alias("k"), read_cell(at(i, 2), *v).alias("v")))
        return F.map_from_entries(pairs)
    return c.try_cast(Entry("", kind, args).type)


def write_cell(c: Column, kind: str, args: tuple[str, ...]) -> Column:
    """A value as text, before quoting; null stays null."""
    if kind == "Timestamp":
        return F.date_format(c, args[0] if args else "yyyy-MM-dd HH:mm:ss.S")
    if kind == "Date":
        return F.date_format(c, args[0] if args else "yyyy-MM-dd")
    if kind == "Array":
        one = parse_type(args[0])
        return F.array_join(F.transform(c, lambda x: F.coalesce(write_cell(x, *one), F.lit(""))), "|")
    if kind == "Map":
        k, v = parse_type(args[0]), parse_type(args[1])
        return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("|", write_cell(e["key"], *k), F.coalesce(write_cell(e["value"], *v), F.lit("")))), "|")
    return c.cast("string")


@dataclass(frozen=True)
class TextSchema:
    entries: tuple[Entry, ...]
    attributes: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str, separator: str = "\n") -> TextSchema:
        entries, attributes = [], {}
        for line in text.split(separator) if separator != "\n" else text.splitlines():
            line = re.sub(r"(//|#).*$", "", line).strip().rstrip(";").strip()
            if not line:
                continue
            if m := re.fullmatch(r"@\s*([\w-]+)\s*=\s*(\S+)\s*", line):
                attributes[m[1]] = m[2]
                continue
            m = re.fullmatch(r"([^:]+):\s*(.*?)(?:\s*@metadata\s*=\s*(\{.*\}))?\s*", line, re.S)
            if not m:
                raise ValueError(f"not a schema line: {line}")
            entries.append(Entry(m[1].strip(), *parse_type(m[2]), json.loads(m[3]) if m[3] else {}))
        return cls(tuple(entries), attributes)

    @classmethod
    def of(cls, df: DataFrame, attributes: dict[str, str] | None = None) -> TextSchema:
        def text(t: T.DataType) -> str:
            if isinstance(t, T.DecimalType):
                return f"Decimal[{t.precision},{t.scale}]"
            if isinstance(t, T.ArrayType):
                return f"Array[{text(t.elementType)}]"
            if isinstance(t, T.MapType):
                return f"Map[{text(t.keyType)},{text(t.valueType)}]"
            name = type(t).__name__.removesuffix("Type").removesuffix("NTZ")
            if name not in _SIMPLE:
                raise ValueError(f"unsupported type: {t.simpleString()}")
            return name

        return cls(tuple(Entry(f.name, *parse_type(text(f.dataType)), dict(f.metadata)) for f in df.schema), attributes or {})

    @property
    def csv(self) -> CsvAttributes:
        get = lambda k, d: _ESCAPES.get(self.attributes.get(k, d), self.attributes.get(k, d))
        return CsvAttributes(get("delimiter", ","), get("quote-char", '"'), self.attributes.get("has-header", "true").lower() == "true")

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(e.name, e.type, True, e.metadata) for e in self.entries])

    def lines(self) -> list[str]:
        return [f"@{k} = {v}" for k, v in self.attributes.items()] + [f"{e.name}: {e.text}" + (f" @metadata={json.dumps(e.metadata)}" if e.metadata else "") for e in self.entries]

    @property
    def hash(self) -> int:
        return zlib.crc32("\n".join(self.lines()).encode())


def schema_path(path: str) -> str:
    """Where the schema of a data file lies: ``.gz``, ``.csv``, ``.tsv`` give way to ``.schema``."""
    return re.sub(r"\.(csv|tsv)$", "", re.sub(r"\.gz$", "", path)) + ".schema"


def typed(raw: DataFrame, schema: TextSchema, reject: str | None = None, torn: Column | None = None) -> DataFrame:
    """String columns in order as the schema's types. ``reject``: a column that tells whether some cell couldn't be read, or the row is ``torn``."""
    cells = [(F.col(c), e) for c, e in zip(raw.columns, schema.entries, strict=False)]
    values = [read_cell(c, e.kind, e.args) for c, e in cells]
    out = [v.alias(e.name, metadata=e.metadata) for v, (_, e) in zip(values, cells, strict=True)]
    if reject:
        bad = F.lit(False) if torn is None else torn
        for v, (c, e) in zip(values, cells, strict=True):
            empty = F.trim(c) == "" if e.kind != "String" else F.lit(True)
            bad = bad | (v.isNull() & c.isNotNull() & ~empty)
        out.append(bad.alias(reject))
    return raw.select(*out)


def read_csv(spark: SparkSession, paths: str | list[str], schema: TextSchema, attributes: CsvAttributes | None = None, fail: bool = True) -> DataFrame:
    """Typed CSV. With ``fail`` an unreadable row is an error when it is read; else it is left out. Headers are dropped for each file."""
    a = attributes or schema.csv
    names = [f"_{i}" for i in range(len(schema.entries))]
    bad = "__bad"
    options = {"sep": a.delimiter, "header": str(a.header).lower(), "quote": "" if a.quote == "\0" else a.quote, "escape": a.quote if a.quote == '"' else "\\", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "enforceSchema": "true", "nullValue": "\0", "emptyValue": ""}
    raw = spark.read.options(**options).csv(paths, T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField(bad, T.StringType())]))
    # a torn row has its text in the corrupt-record column
    cells = raw.select(*(F.coalesce(n, F.lit("")).alias(n) for n in names), bad)
    out = typed(cells, schema, "__unread", F.col(bad).isNotNull())
    wrong = F.col("__unread")
    if fail:
        wrong = F.when(wrong, F.raise_error(F.lit("a CSV row can't be read")).cast("boolean")).otherwise(F.lit(False))
    return out.where(~wrong).drop("__unread")


def read_inline(spark: SparkSession, schema: str, data: str | None) -> DataFrame:
    """Rows from a string, rows parted by ``;``; there is no header row."""
    s = TextSchema.parse(schema, ";")
    rows = [r.strip() for r in (data or "").split(";") if r.strip() or len(s.entries) == 1 and data]
    if not rows:
        return spark.createDataFrame([], s.struct())
    a = s.csv
    struct = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(s.entries))])
    parsed = F.from_csv("value", struct.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": a.delimiter, "quote": a.quote, "escape": a.quote, "nullValue": "\0", "emptyValue": ""})
    raw = spark.createDataFrame([(r,) for r in rows], "value string").select(parsed.alias("x")).select("x.*")
    return typed(raw.select(*(F.coalesce(c, F.lit("")).alias(c) for c in raw.columns)), s)


def csv_lines(df: DataFrame, schema: TextSchema | None = None) -> DataFrame:
    """One text column ``value``: cells by type, strings, arrays and maps quoted; a null cell is empty."""
    s = schema or TextSchema.of(df)
    a = s.csv
    cells = []
    for e in s.entries:
        text = write_cell(F.col(e.name), e.kind, e.args)
        if e.kind in ("String", "Array", "Map") and a.quote != "\0":
            inner = F.replace(text, F.lit(a.quote), F.lit(a.quote * 2 if a.quote == '"' else "\\" + a.quote))
            text = F.concat(F.lit(a.quote), inner, F.lit(a.quote))
        cells.append(F.coalesce(text, F.lit("")))
    return df.select(F.concat_ws(a.delimiter, *cells).alias("value"))


def write_csv(df: DataFrame, path: str, schema: TextSchema | None = None) -> None:
    """CSV files without headers, and the schema beside them, written last: it marks success."""
    s = schema or TextSchema.of(df, {"has-header": "false"})
    csv_lines(df, s).write.mode("overwrite").text(path)
    df.sparkSession.createDataFrame([(x,) for x in s.lines()], "value string").coalesce(1).write.mode("overwrite").text(schema_path(path))


def export_csv(df: DataFrame, path: str, n: int | None = None) -> None:
    """A local file with a header, row by row, and its schema file."""
    own = df if n is None else df.limit(n)
    s = TextSchema.of(df, {"has-header": "true"})
    with open(path, "w", encoding="utf-8") as f:
        f.write(s.csv.delimiter.join(f'"{c}"' for c in df.columns) + "\n")
        for r in csv_lines(own, s).toLocalIterator():
            f.write(r["value"] + "\n")
    with open(schema_path(path), "w", encoding="utf-8") as f:
        f.write("\n".join(s.lines()) + "\n")


_DATES = ("MM/dd/yyyy", "MM-dd-yyyy", "MMM/dd/yyyy", "MMM-dd-yyyy", "dd-MMM-yyyy", "ddMMMyyyy", "yyyy-MM-dd")
_STAMPS = tuple(f"{d} HH:mm:ss{s}" for d in _DATES for s in ("", ".S"))
_PARTS = {"yyyy": r"(?P<y>\d{1,4})", "MMM": "(?P<b>[A-Za-z]+)", "MM": r"(?P<m>\d{1,2})", "dd": r"(?P<d>\d{1,2})", "HH": r"(?P<H>\d{1,2})", "mm": r"(?P<M>\d{1,2})", "ss": r"(?P<S>\d{1,2})", "S": r"\d+"}
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_WHOLE, _REAL = 1_431_655_765, 3.4028234663852886e38 / 1.5


def _fits(value: str, fmt: str) -> bool:
    """Whether the whole text is a date or time of the format, all parts in their ranges; numbers may lack leading zeros."""
    import datetime as dt

    m = re.fullmatch("".join(_PARTS.get(x, re.escape(x)) for x in re.findall("yyyy|MMM|MM|dd|HH|mm|ss|S|.", fmt)), value)
    if not m:
        return False
    p = m.groupdict()
    month = next((i + 1 for i, n in enumerate(_MONTHS) if p["b"].lower() in (n, n[:3])), 0) if "b" in p else int(p["m"])
    try:
        dt.datetime(int(p["y"]), month, int(p["d"]), int(p.get("H", 0)), int(p.get("M", 0)), int(p.get("S", 0)))
    except ValueError:
        return False
    return True


def _is(value: str, kind: str) -> bool:
    if kind in ("Integer", "Long"):
        return bool(re.fullmatch(r"[+-]?\d+", value)) and (-(2**31) <= int(value) < _WHOLE if kind == "Integer" else -(2**63) <= int(value) < 2**63)
    if kind in ("Float", "Double"):
        real = re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[fFdD]?\s*|[+-]?(NaN|Infinity)", value)
        return bool(real) and (kind == "Double" or float(value.strip().rstrip("fFdD") or 0) < _REAL if not real[3] else real[3] == "Infinity" and value[0] == "-" or kind == "Double")
    return value.lower() in ("true", "false") if kind == "Boolean" else kind == "String"


#: What a column of a type becomes when a value doesn't fit it, in order of preference.
_NEXT = {None: ("Integer", "Long", "Float", "Double", "Boolean"), "Integer": ("Integer", "Long", "Float", "Double"), "Long": ("Long", "Double"), "Float": ("Float", "Double"), "Double": ("Double",), "Boolean": ("Boolean",)}
_COMPACT = "Date[yyyyMMdd]"


def _compact_date(value: str) -> bool:
    return bool(re.fullmatch(r"\d{8}", value)) and _fits(f"{value[:4]}-{value[4:6]}-{value[6:]}", "yyyy-MM-dd")


def promote(kind: str | None, value: str) -> str:
    """The type of a column that had ``kind`` so far (None: no value yet) once it holds ``value`` too. Formats of dates and times don't change."""
    if kind is None and _compact_date(value):
        return _COMPACT
    if kind == _COMPACT:
        return kind if _compact_date(value) else next((k for k in ("Integer", "Long", "Float", "Double") if _is(value, k)), "String")
    if kind in _NEXT:
        found = next((k for k in _NEXT[kind] if _is(value, k)), None)
        if found or kind:
            return found or "String"
        return next((f"Timestamp[{f}]" for f in _STAMPS if _fits(value, f)), None) or next((f"Date[{f}]" for f in _DATES if _fits(value, f)), "String")
    m = re.fullmatch(r"(?:Timestamp|Date)\[(.*)\]", kind)
    return kind if m and _fits(value, m[1]) else "String"


def discover_schema(spark: SparkSession, path: str, n: int = 100_000, attributes: CsvAttributes = CsvAttributes(header=True)) -> TextSchema:
    """A schema from the first n lines: the narrowest type that fits all values of a column. Torn lines are skipped; none left is an error."""
    import csv

    from tessera.operators.columns import value_to_column_name

    lines = [r["value"] for r in spark.read.text(path).limit(n + attributes.header).collect()]
    rows = list(csv.reader(lines, delimiter=attributes.delimiter, quotechar=None if attributes.quote == "\0" else attributes.quote, quoting=csv.QUOTE_NONE if attributes.quote == "\0" else csv.QUOTE_MINIMAL))
    if not rows:
        raise ValueError("the file is empty")
    names = [value_to_column_name(x.strip()) for x in rows[0]] if attributes.header else [f"f{i + 1}" for i in range(len(rows[0]))]
    kinds: list[str | None] = [None] * len(names)
    seen: list[str] = [""] * len(names)
    good = 0
    for r in rows[attributes.header :]:
        if len(r) != len(names):
            continue
        good += 1
        for i, v in enumerate(x.strip() for x in r):
            if v:
                seen[i] = seen[i] or v
                kinds[i] = promote(kinds[i], v)
    if not good:
        raise ValueError("no line fits the header")
    d = {"\t": "\\t", ";": "semicolon"}.get(attributes.delimiter, attributes.delimiter)
    return TextSchema(tuple(Entry(name, *parse_type(k or "String"), {"description": s}) for name, k, s in zip(names, kinds, seen, strict=True)), {"has-header": str(attributes.header).lower(), "delimiter": d, "quote-char": "\\0" if attributes.quote == "\0" else attributes.quote})
