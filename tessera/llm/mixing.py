"""Mixing sources to target weights by systematic sampling. Native: DataFrame operations only.

Every document of a source has the same expected number of copies, target / source size. The documents of a source stand in one
order; the prefix sums of their expected copies, moved by one random offset for the source, cross integers, and a document is emitted once for
each integer that its own step crosses. Sums are exact integers (units of 2**-24 copies), so that no partitioning changes the result.

Order and scale: documents stand by size, so a source's taken words differ from the target by about one document's size. The order is cut
into blocks (leading digits of the size, then a residue of the id) of about ``block_rows`` rows. A window runs inside each
block; offsets come from counts of blocks. A source, or a single size, that holds a third of all rows is thus many tasks.

Defined cases: null text has size 0; size 0 is never taken; null source is a source of its own and the last; a null id is allowed; repeated
rows are rows of their own; an empty table gives an empty result; extra columns pass through ``mixed`` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import WORD, written

UNIT = 1 << 24
BLOCK_ROWS = 250_000
_KEY, _BAND, _SUB, _SIZE, _TIE = "__mix_key", "__mix_band", "__mix_sub", "__mix_size", "__mix_tie"


def word_count(text: Column) -> Column:
    """Number of words of the whole text; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def block_count(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    return max(1, math.ceil(rows / block_rows))


def _offset(source: Column) -> Column:
    """The random offset of a source, in units: the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(source, F.lit("\x00"))).cast("binary")), 1, 6), 16, 10).cast("long")


def targets(sizes: DataFrame, max_repeat: int = 3) -> DataFrame:
    """From one row per source (source, source_size): weight and target.

    Weights are 1, 2, 3, repeating, by code point, null last. Targets share the total by weight; one that passes ``max_repeat`` times
    its source's size stops there, and the rest is shared again: after sorting by size per weight the stopped ones are a prefix.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    whole = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sizes.withColumn("weight", ((F.row_number().over(everything) - 1) % 3 + 1).cast("long"))
        .withColumn("room", max_repeat * F.col("source_size") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(whole) - max_repeat * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("level", F.first(F.when(F.col("room") >= F.col("level"), F.col("level")), ignorenulls=True).over(whole))
        .withColumn("target", F.least((max_repeat * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def _prepared(docs: DataFrame, text: str, source: str, doc_id: str, blocks: int) -> DataFrame:
    size = F.col(_SIZE)
    digits = size.cast("string")
    return (
        docs.withColumn(_SIZE, word_count(F.col(text)))
        .withColumn(_KEY, F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")))
        .withColumn(_BAND, F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int"))
        .withColumn(_SUB, F.pmod(F.pmod(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), F.lit(1_000_003)) * 7919, F.lit(blocks)))
    )


def _copies(rows: DataFrame, source: str, doc_id: str, counts: DataFrame, max_repeat: int) -> DataFrame:
    blocks = counts.groupBy(_KEY, _BAND, _SUB).agg(F.first(source).alias("source"), F.sum("n").alias("n"), F.sum("words").alias("words"))
    sizes = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(sizes, max_repeat).withColumn(_KEY, F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    earlier = Window.partitionBy(_KEY).orderBy(_BAND, _SUB).rowsBetween(Window.unboundedPreceding, -1)
    step = F.coalesce(F.floor(F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat))) * UNIT), F.lit(0))
    blocks = (
        blocks.withColumn("__mix_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("__mix_u", _offset(F.col("source")))
        .drop("n", "words", "source")
        .join(plan, _KEY)
        .select(_KEY, _BAND, _SUB, "__mix_before", "__mix_u", F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"), F.when(F.col("source_size") > 0, step).otherwise(0).alias("__mix_step"))
    )
    inside = Window.partitionBy(_KEY, _BAND, _SUB).orderBy(_SIZE, doc_id, _TIE)
    upto = (F.col("__mix_before") + F.col("__mix_rank")) * F.col("__mix_step") + F.col("__mix_u")
    crossed = F.floor(upto / UNIT) - F.floor((upto - F.col("__mix_step")) / UNIT)
    return (
        rows.withColumn("__mix_rank", F.row_number().over(inside))
        .join(blocks, [_KEY, _BAND, _SUB])
        .withColumn("__mix_copies", F.when(F.col(_SIZE) > 0, crossed).otherwise(0).cast("long"))
    )


def _counts(rows: DataFrame, source: str) -> DataFrame:
    return rows.groupBy(_KEY, _BAND, _SUB).agg(F.first(source).alias(source), F.count("*").alias("n"), F.sum(_SIZE).alias("words"))


def mix_plan(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", max_repeat: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One narrow row per document: doc_id, source, size, source_size, target, copies, taken. The text is read once."""
    blocks = block_count(docs.count(), block_rows)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    narrow = written(_prepared(narrow, "text", "source", "doc_id", blocks).withColumn(_TIE, F.xxhash64("text")).drop("text"), "mix")
    return _copies(narrow, "source", "doc_id", _counts(narrow, "source"), max_repeat).select(
        "doc_id", "source", F.col(_SIZE).alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"),
        F.col("__mix_copies").alias("copies"), (F.col("__mix_copies") * F.col(_SIZE)).alias("taken"),
    )


def mixed(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", max_repeat: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    blocks = block_count(docs.count(), block_rows)
    rows = _prepared(docs, text, source, doc_id, blocks).withColumn(_TIE, F.xxhash64(text))
    out = _copies(rows, source, doc_id, _counts(_prepared(docs, text, source, doc_id, blocks), source), max_repeat)
    return out.where("__mix_copies > 0").withColumn("__mix_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))).select(*docs.columns)


#: DuckDB's form of the query: the same integers from the same order.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
n AS (SELECT greatest(1, ceil(count(*) / 250000.0))::BIGINT AS blocks FROM documents),
placed AS (
  SELECT s.*, length(size::VARCHAR) * 100 + left(size::VARCHAR, 2)::INT AS band,
    ((coalesce(doc_id, 0) % 1000003 + 1000003) % 1000003 * 7919) % n.blocks AS sub FROM sized s, n),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sizes),
roomy AS (SELECT *, 3 * source_size / weight::DOUBLE AS room FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM roomy),
level AS (SELECT arg_min(level, (room, coalesce(source, chr(1114111)))) AS level FROM levels WHERE room >= level),
plan AS (
  SELECT source, source_size, least(3.0 * source_size, level.level * weight)::DOUBLE AS target,
    ('0x' || left(md5('mix:' || coalesce(source, chr(0))), 6))::BIGINT AS u FROM roomy, level),
steps AS (SELECT *, CASE WHEN source_size > 0 THEN floor(least(target / source_size, 3.0) * 16777216)::BIGINT ELSE 0 END AS step FROM plan),
ranked AS (
  SELECT p.doc_id, p.size, s.source_size, s.target, s.step,
    row_number() OVER (PARTITION BY p.source ORDER BY band, sub, size, p.doc_id) * s.step + s.u AS upto
  FROM placed p JOIN steps s ON p.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN (upto // 16777216 - (upto - step) // 16777216) * size ELSE 0 END)::BIGINT AS taken FROM ranked
"""
