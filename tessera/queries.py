"""Queries over the driver's tables, one or more for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from tessera.functions import aggregates as agg
from tessera.functions import dates, scalar, similarity
from tessera.operators import columns as cols
from tessera.operators import discovery, joins, profile, quality
from tessera.operators.keyed import Keyed, dedup_by_key, dedup_by_key_with_order, keyed, row_index, top_n
from tessera.operators.panels import month, week

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ROUND = 6


def _r(c, n: int = _ROUND):
    return F.round(c, n)


# windows and joins


@query("""SELECT o.o_custkey AS o_custkey, c.c_name, c.c_mktsegment, o.o_orderkey, o.o_totalprice FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) o JOIN customer c ON o.o_custkey = c.c_custkey WHERE rn <= 3""")
def top_orders_per_customer(spark, d):
    top = keyed(_t(spark, d, "orders"), "o_custkey").top_n(3, F.desc("o_totalprice"), F.asc("o_orderkey"))
    c = cols.rename(_t(spark, d, "customer"), {"c_custkey": "o_custkey"})
    return joins.join_by_key(top, c, ["o_custkey"]).select("o_custkey", "c_name", "c_mktsegment", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(spark, d):
    return top_n(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT * EXCLUDE (rn) FROM (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn FROM orders) WHERE rn = 1")
def dedup_latest_order(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return dedup_by_key_with_order(o, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def dedup_keys_only(spark, d):
    return dedup_by_key(_t(spark, d, "orders"), "o_custkey", "o_orderstatus").select("o_custkey", "o_orderstatus")


@query("SELECT c.k, c.name, c.nation, s.name AS _name, s.nation AS _nation FROM (SELECT c_custkey k, c_name AS name, c_nationkey nation FROM customer) c JOIN (SELECT s_suppkey k, s_name AS name, s_nationkey nation FROM supplier) s USING (k)")
def join_key_collision(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return joins.join_by_key(c, s, ["k"])


def _cs(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    s = _t(spark, d, "supplier").select((F.col("s_suppkey") * 20).alias("k"), F.col("s_acctbal").alias("bal"))
    return c, s


_CS = "WITH c AS (SELECT c_custkey k, c_acctbal bal FROM customer), s AS (SELECT s_suppkey * 20 AS k, s_acctbal bal FROM supplier) "


@query(_CS + "SELECT coalesce(c.k, s.k) k, c.bal, s.bal AS _bal FROM c FULL JOIN s ON c.k = s.k")
def join_outer_coalesce(spark, d):
    return joins.join_by_key(*_cs(spark, d), ["k"], "outer")


@query(_CS + "SELECT s.k, c.bal, s.bal AS _bal FROM c RIGHT JOIN s ON c.k = s.k")
def join_right_coalesce(spark, d):
    return joins.join_by_key(*_cs(spark, d), ["k"], "rightouter")


@query(_CS + "SELECT c.k, c.bal, s.bal AS _bal FROM c LEFT JOIN s ON c.k = s.k")
def join_left(spark, d):
    return joins.join_by_key(*_cs(spark, d), ["k"], "leftouter")


@query(_CS + "SELECT * FROM c WHERE k IN (SELECT k FROM s)")
def join_semi(spark, d):
    return joins.join_by_key(*_cs(spark, d), ["k"], "leftsemi")


@query(_CS + "SELECT * FROM c WHERE k NOT IN (SELECT k FROM s)")
def join_anti(spark, d):
    return joins.join_by_key(*_cs(spark, d), ["k"], "leftanti")


@query("WITH a AS (SELECT nullif(n_regionkey, 0) k, n_name FROM nation), b AS (SELECT nullif(r_regionkey, 0) k, r_name FROM region) SELECT a.k, n_name, r_name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(spark, d):
    a = _t(spark, d, "nation").select(F.nullif(F.col("n_regionkey"), F.lit(0)).alias("k"), "n_name")
    b = _t(spark, d, "region").select(F.nullif(F.col("r_regionkey"), F.lit(0)).alias("k"), "r_name")
    return joins.join_by_key(a, b, ["k"], null_safe=True)


@query("SELECT s.k, s.bal, c.bal AS _bal FROM (SELECT s_nationkey k, s_acctbal bal FROM supplier) s JOIN (SELECT c_nationkey k, c_acctbal bal FROM customer) c ON s.k = c.k AND s.bal > c.bal + 9000")
def join_condition(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("bal"))
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return joins.join_unique_names(s, c, (F.col("k") == F.col("_k")) & (F.col("bal") > F.col("_bal") + 9000)).select("k", "bal", "_bal")


@query("""SELECT coalesce(x.k, o.k) AS k, x.v, x.v_s, o.v AS v_o FROM (SELECT c.k, c.v, s.v AS v_s FROM (SELECT c_custkey k, c_name v FROM customer) c JOIN (SELECT s_suppkey k, s_name v FROM supplier) s USING (k)) x
  FULL JOIN (SELECT p_partkey k, p_name v FROM part) o ON x.k = o.k""")
def multi_join(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    o = _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"))
    return joins.MultiJoin(c, ["k"]).join_with(s, "_s").join_with(o, "_o", "outer").do_join()


@query("SELECT o_custkey, count(*) AS n, sum(o_totalprice)::DECIMAL(20, 2)::DOUBLE AS total, min(c_name) AS name FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def skew_join(spark, d):
    o, c = _t(spark, d, "orders"), cols.rename(_t(spark, d, "customer"), {"c_custkey": "o_custkey"})
    hot = [r[0] for r in joins.most_frequent_values(o, "o_custkey", 5).collect()]
    j = joins.skew_join(o, c, "o_custkey", hot)
    return j.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").cast("decimal(20,2)").cast("double").alias("total"), F.min("c_name").alias("name"))


@query("SELECT o_custkey, count(o_custkey) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def most_frequent_values(spark, d):
    return joins.most_frequent_values(_t(spark, d, "orders"), "o_custkey", 10)


@query("""WITH a AS (SELECT c_custkey AS id, c_name AS name, c_nationkey || '/' || c_mktsegment AS block FROM customer), b AS (SELECT id + 1 AS i, replace(name, '0', 'O') AS n, block AS k FROM a),
  same AS (SELECT id, i FROM a JOIN b ON id = i * 7), x AS (SELECT id, i, right(name, 2) = right(n, 2) AS tail, (1::FLOAT - (levenshtein(name, n) / greatest(length(name), length(n)))::FLOAT)::FLOAT AS v
    FROM a JOIN b ON block = k WHERE id NOT IN (SELECT id FROM same) AND i NOT IN (SELECT i FROM same))
  SELECT id, i AS _id, true AS same, NULL::BOOLEAN AS tail, NULL::BOOLEAN AS close, NULL::DOUBLE AS close_Value, '100' AS "MatchBitmap" FROM same
  UNION ALL SELECT id, i, false, tail, v > 0.5, round(v::DOUBLE, 4), '0' || tail::INT || (v > 0.5)::INT FROM x WHERE tail OR v > 0.5""")
def entity_match(spark, d):
    a = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("block"))
    b = a.select((F.col("id") + 1).alias("_id"), F.regexp_replace("name", "0", "O").alias("_name"), F.col("block").alias("_block"))
    levels = [joins.ExactLevel("tail", F.right("name", F.lit(2)) == F.right("_name", F.lit(2))), joins.FuzzyLevel("close", F.lit(True), similarity.norm_levenshtein("name", "_name"), 0.5, digits=4)]
    return joins.EntityMatcher("id", "_id", levels, ("same", F.col("id"), F.col("_id") * 7), (F.col("block"), F.col("_block"))).match(a, b)


@query("""SELECT c_custkey, c_nationkey, CASE WHEN n = 1 THEN NULL ELSE round(p, 6) END AS c_acctbal_pctrnk FROM (SELECT c_custkey, c_nationkey, percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) p, count(*) OVER (PARTITION BY c_nationkey) n FROM customer)""")
def percent_rank(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return keyed(c, "c_nationkey").percent_rank(["c_acctbal"]).select("c_custkey", "c_nationkey", _r(F.when(F.count("*").over(Window.partitionBy("c_nationkey")) > 1, F.col("c_acctbal_pctrnk"))).alias("c_acctbal_pctrnk"))


@query("SELECT c_custkey, c_nationkey, least(floor(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) * 10 + 1), 10)::INT AS c_acctbal_quantile FROM customer")
def quantile10(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return keyed(c, "c_nationkey").quantile(["c_acctbal"], 10, ignore_null=False).select("c_custkey", "c_nationkey", "c_acctbal_quantile")


@query("SELECT s_suppkey, round(CASE WHEN lo = hi THEN 50 ELSE (s_acctbal - lo) / (hi - lo) * 100 END, 6) AS s_acctbal_scaled FROM (SELECT *, min(s_acctbal) OVER (PARTITION BY s_nationkey) lo, max(s_acctbal) OVER (PARTITION BY s_nationkey) hi FROM supplier)")
def scale_balance(spark, d):
    return keyed(_t(spark, d, "supplier"), "s_nationkey").scale({"s_acctbal": (0, 100)}).select("s_suppkey", _r(F.col("s_acctbal_scaled")).alias("s_acctbal_scaled"))


@query("SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END v FROM events)")
def fill_forward(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return keyed(e, "user_id").fill_forward([F.asc("ts"), F.asc("event_id")], ["v"]).select("event_id", "user_id", "v")


@query("SELECT event_id, round(sum(value) OVER w, 4) AS total, count(value) OVER w AS n, max(value) OVER w AS top FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_sum(spark, d):
    e = _t(spark, d, "events")
    out = keyed(e, "user_id").running([F.asc("ts"), F.asc("event_id")], [("sum", "value", "total"), ("count", "value", "n"), ("max", "value", "top")], plus=True)
    return out.select("event_id", _r(F.col("total"), 4).alias("total"), "n", "top")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS row FROM nation")
def row_numbers(spark, d):
    return row_index(_t(spark, d, "nation"), "row", 1).select("n_nationkey", "row")


# reshaping


@query("SELECT o_custkey, " + ", ".join(f"coalesce(sum(CASE WHEN o_orderstatus = '{s}' THEN o_shippriority END), 0)::BIGINT AS o_shippriority_{s}" for s in "FOP") + " FROM (SELECT *, (o_orderkey % 7)::INT AS o_shippriority FROM orders) GROUP BY 1")
def pivot_sum_status(spark, d):
    o = _t(spark, d, "orders").withColumn("o_shippriority", (F.col("o_orderkey") % 7).cast("int"))
    return keyed(o, "o_custkey").pivot_sum([["o_orderstatus"]], ["o_shippriority"], list("FOP"))


@query("SELECT user_id, " + ", ".join(f"max(CASE WHEN event_type = '{e}' THEN n END) AS n_{e}" for e in ("click", "view", "purchase")) + " FROM (SELECT user_id, event_type, count(*) n FROM events GROUP BY ALL) GROUP BY 1")
def pivot_coalesce(spark, d):
    n = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return keyed(n, "user_id").pivot_coalesce([["event_type"]], ["n"], ["click", "view", "purchase"])


@query("SELECT n_regionkey, max(CASE WHEN r = 0 THEN n_name END) AS n_name_0, max(CASE WHEN r = 1 THEN n_name END) AS n_name_1 FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 r FROM nation) GROUP BY 1")
def pivot_ranked(spark, d):
    return keyed(_t(spark, d, "nation").select("n_regionkey", "n_name"), "n_regionkey").pivot_coalesce([], ["n_name"], ["0", "1"])


@query("SELECT p_partkey, 'p_brand' AS \"column\", p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part")
def unpivot_parts(spark, d):
    return cols.unpivot(_t(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"])


@query("SELECT p_partkey, '1' AS Index, p_name AS A, p_brand AS B FROM part UNION ALL SELECT p_partkey, '2', p_type, NULL FROM part")
def unpivot_regex(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.col("p_name").alias("A_1"), F.col("p_type").alias("A_2"), F.col("p_brand").alias("B_1"))
    return cols.unpivot_regex(p, ["A_1", "A_2", "B_1"], r"(\w+)_(\d+)")


@query("SELECT CASE WHEN grouping(l_returnflag) = 1 THEN '*' ELSE l_returnflag END AS l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN '*' ELSE l_linestatus END AS l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_returnflag(spark, d):
    return Keyed(_t(spark, d, "lineitem"), ()).cube(["l_returnflag", "l_linestatus"], F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


@query("SELECT c_nationkey, CASE WHEN grouping(c_mktsegment) = 1 THEN '*' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN grouping(o_orderstatus) = 1 THEN '*' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, ROLLUP (c_mktsegment, o_orderstatus)")
def rollup_segment(spark, d):
    j = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return keyed(j, "c_nationkey").rollup(["c_mktsegment", "o_orderstatus"], F.count("*").alias("n"))


@query("SELECT c_name AS name, c_acctbal AS bal, c_mktsegment AS segment, NULL::INT AS nation FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, s_nationkey FROM supplier")
def union_by_name(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    s = _t(spark, d, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return cols.union_by_name(c, s)


@query("SELECT c_custkey, c_acctbal * 2 AS c_acctbal, c_acctbal + 1 AS more FROM customer")
def select_with_replace(spark, d):
    return cols.select_with_replace(_t(spark, d, "customer").select("c_custkey", "c_acctbal"), c_acctbal=F.col("c_acctbal") * 2, more=F.col("c_acctbal") + 1)


@query("SELECT x_n_nationkey AS id, x_n_name, x_n_regionkey, 1 AS one FROM (SELECT n_nationkey x_n_nationkey, n_name x_n_name, n_regionkey x_n_regionkey FROM nation)")
def renames(spark, d):
    n = cols.prefix_names(_t(spark, d, "nation"), "x_")
    return cols.select_plus(cols.rename(n, {"x_n_nationkey": "id", "absent": "b"}), F.lit(1).alias("one"))


@query("SELECT n_nationkey, n_name AS a, n_regionkey AS b FROM nation")
def expand_structs(spark, d):
    n = _t(spark, d, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("a"), F.col("n_regionkey").alias("b")).alias("s"))
    return cols.expand_structs(n, "s")


# sampling and checks


def _step(h: str, k: str, r: int) -> str:
    """A step of the 32-bit hash in SQL."""
    turn = lambda x, n: f"(({x} * {1 << n}::UBIGINT) % 4294967296 + {x} // {1 << 32 - n}::UBIGINT)"
    k = f"({turn(f'({k} * 3432918353::UBIGINT % 4294967296)', 15)} * 461845907::UBIGINT % 4294967296)"
    return f"({turn(f'xor({h}, {k})', r)} * 5 + 3864292196) % 4294967296"


_LAST = "xor(h, 18::UBIGINT)"


@query(f"""WITH u AS (SELECT c_custkey, c_name, list_transform(range(1, 19, 2), lambda i: (unicode(c_name[i]) * 65536 + unicode(c_name[i + 1]))::UBIGINT) AS k FROM customer WHERE length(c_name) = 18),
  a AS (SELECT c_custkey, c_name, xor(list_reduce(k, lambda h, x: {_step("h", "x", 13)}, 23::UBIGINT), 18::UBIGINT) AS h FROM u),
  b AS (SELECT c_custkey, c_name, xor(h, h // 65536) * 2246822507::UBIGINT % 4294967296 AS h FROM a), c AS (SELECT c_custkey, c_name, xor(h, h // 8192) * 3266489909::UBIGINT % 4294967296 AS h FROM b)
  SELECT c_custkey, c_name FROM c WHERE xor(h, h // 65536) % 2147483648 < 2147483647 * 0.3""")
def hash_sample(spark, d):
    return discovery.hash_sample(_t(spark, d, "customer").select("c_custkey", "c_name"), "c_name", 0.3)


@query("SELECT k, concat((max(c))::VARCHAR, (max(o))::VARCHAR, (max(p))::VARCHAR) AS flag FROM (SELECT c_custkey k, 1 c, 0 o, 0 p FROM customer UNION ALL SELECT o_custkey, 0, 1, 0 FROM orders UNION ALL SELECT p_partkey, 0, 0, 1 FROM part) GROUP BY k")
def overlap_flags(spark, d):
    return discovery.overlap_check("k", _t(spark, d, "customer").select(F.col("c_custkey").alias("k")), _t(spark, d, "orders").select(F.col("o_custkey").alias("k")), _t(spark, d, "part").select(F.col("p_partkey").alias("k")))


@query("SELECT l_orderkey, l_linenumber, n AS _N, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) n FROM lineitem) WHERE n > 1")
def dupe_check(spark, d):
    return discovery.dupe_check(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], None)


@query("SELECT 'o_orderkey' AS keys, count(DISTINCT o_orderkey) AS n FROM orders")
def discover_key(spark, d):
    keys, n = discovery.discover_key(_t(spark, d, "orders"), None)
    return spark.createDataFrame([(",".join(keys), n)], "keys string, n long")


# aggregates and histograms


@query("""SELECT o_custkey, count(*) FILTER (o_totalprice > 100000) AS big, count(*) FILTER (NOT o_totalprice > 100000) AS small, count(DISTINCT o_orderstatus || o_orderpriority) AS kinds, coalesce(stddev_samp(o_totalprice), 0)::DECIMAL(20, 3)::DOUBLE AS sd,
  coalesce(sum(CASE WHEN o_totalprice > 400000 THEN o_orderkey END), 0)::BIGINT AS s0, coalesce(bool_or(o_orderstatus = 'F'), false) AS any_f FROM orders GROUP BY 1""")
def aggregate_functions(spark, d):
    big = F.col("o_totalprice") > 100000
    return keyed(_t(spark, d, "orders"), "o_custkey").agg(
        agg.count_true(big).alias("big"), agg.count_false(big).alias("small"), agg.count_distinct_with_null("o_orderstatus", "o_orderpriority").alias("kinds"), agg.stddev0("o_totalprice").cast("decimal(20,3)").cast("double").alias("sd"),
        agg.sum0(F.when(F.col("o_totalprice") > 400000, F.col("o_orderkey"))).cast("long").alias("s0"), agg.any_true(F.col("o_orderstatus") == "F").alias("any_f"),
    )


@query("SELECT c_nationkey, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL")
def histogram_string(spark, d):
    h = agg.histogram(_t(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", "h")
    return h.select("c_nationkey", F.inline("h"))


@query("SELECT * EXCLUDE m FROM (SELECT *, max(n) OVER (PARTITION BY c_nationkey) m FROM (SELECT c_nationkey, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL)) WHERE n = m")
def most_frequent(spark, d):
    return agg.most_frequent(_t(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", "h").select("c_nationkey", F.inline("h"))


_BINS = """WITH r AS (SELECT l_returnflag, l_quantity v, min(l_quantity) OVER (PARTITION BY l_returnflag) lo, max(l_quantity) OVER (PARTITION BY l_returnflag) hi FROM lineitem),
  b AS (SELECT *, least(floor((v - lo) / ((hi - lo) / 10)), 9) b, (hi - lo) / 10 w FROM r), h AS (SELECT l_returnflag, lo + b * w AS low, lo + b * w + w AS high, count(*) AS n FROM b GROUP BY ALL) """


@query(_BINS + "SELECT l_returnflag, round(low, 6) AS low, round(high, 6) AS high, n FROM h")
def bin_histogram(spark, d):
    h = keyed(_t(spark, d, "lineitem"), "l_returnflag").bin_histogram({"l_quantity": 10})
    return h.select("l_returnflag", F.inline("l_quantity_bin")).select("l_returnflag", _r(F.col("low")).alias("low"), _r(F.col("high")).alias("high"), "n")


@query(_BINS + """, c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY low) run, sum(n) OVER (PARTITION BY l_returnflag) total, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, low) mode FROM h)
  SELECT l_returnflag, round(min((low + high) / 2) FILTER (run >= total * 0.5), 6) AS median, round(min((low + high) / 2) FILTER (mode = 1), 6) AS mode FROM c GROUP BY 1""")
def bin_percentile(spark, d):
    h = keyed(_t(spark, d, "lineitem"), "l_returnflag").bin_histogram({"l_quantity": 10})
    return h.select("l_returnflag", _r(scalar.bin_percentile("l_quantity_bin", 50.0)).alias("median"), _r(scalar.bin_mode("l_quantity_bin")).alias("mode"))


@query("""SELECT count(l_tax) AS cnt, count(*) - count(l_tax) AS nct, round(avg(l_tax), 6) AS avg, round(stddev_samp(l_tax), 6) AS std, min(l_tax) AS min, max(l_tax) AS max FROM lineitem""")
def profile_numeric(spark, d):
    s = profile.summary(_t(spark, d, "lineitem"), "l_tax")
    pick = lambda t: F.max(F.when(F.col("task") == t, F.col("value").cast("double")))
    return s.groupBy().agg(pick("cnt").cast("long").alias("cnt"), pick("nct").cast("long").alias("nct"), _r(pick("avg")).alias("avg"), _r(pick("std")).alias("std"), pick("min").alias("min"), pick("max").alias("max"))


_NUMERIC = [f"SELECT '{c}' AS \"column\", '{t}' AS task, round({e.format(c)}, 3)::DOUBLE AS number, NULL AS text FROM orders" for c in ("o_orderkey", "o_custkey", "o_totalprice") for t, e in (("cnt", "count({})"), ("nct", "count(*) - count({})"), ("avg", "avg({})"), ("std", "stddev_samp({})"), ("min", "min({})"), ("max", "max({})"))]
_TEXTUAL = [f"SELECT '{c}', '{t}', {e.format(c)}::DOUBLE, NULL FROM orders" for c in ("o_orderstatus", "o_orderpriority") for t, e in (("cnt", "count({})"), ("nct", "count(*) - count({})"), ("mil", "min(length({}))"), ("mal", "max(length({}))"))]
_TIMED = [f"SELECT 'o_orderdate', '{t}', NULL, strftime({e}(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders" for t, e in (("tmi", "min"), ("tma", "max"))]


@query(" UNION ALL ".join(_NUMERIC + _TEXTUAL + _TIMED))
def profile_all(spark, d):
    s = profile.summary(_t(spark, d, "orders")).where("kind = 'stat' AND task <> 'dct'")  # approximate, see approximate_distinct
    text = F.col("task").isin("tmi", "tma")
    return s.select("column", "task", _r(F.when(~text, F.col("value").try_cast("double")), 3).alias("number"), F.when(text, F.replace(F.col("value"), F.lit('"'), F.lit(""))).alias("text"))


@query("SELECT floor(l_quantity / 5) * 5 AS value, count(*) AS n FROM lineitem GROUP BY 1")
def profile_bins(spark, d):
    h = profile.bin_hist(_t(spark, d, "lineitem"), {"l_quantity": 5.0})
    return h.select(F.explode(F.from_json(F.get_json_object("value", "$.hist"), "map<string,long>")).alias("value", "n")).select(F.col("value").cast("double").alias("value"), "n")


@query("SELECT 'p_brand' AS \"column\", count(*) FILTER (p_brand IS NULL) / count(*)::DOUBLE AS rate FROM part")
def null_rates(spark, d):
    return profile.null_rate(_t(spark, d, "part"), "p_brand").select("column", F.col("value").cast("double").alias("rate"))


@query("SELECT n AS value, count(*) AS groups FROM (SELECT count(*) n FROM orders GROUP BY o_custkey) GROUP BY 1")
def count_hist(spark, d):
    h = profile.count_hist(_t(spark, d, "orders"), ["o_custkey"])
    return h.select(F.explode(F.from_json(F.get_json_object("value", "$.hist"), "map<string,long>")).alias("value", "groups")).select(F.col("value").cast("double").cast("long").alias("value"), "groups")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 300000 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')")
def dqm_rule_fix(spark, d):
    q = quality.Quality([quality.set_rule("o_orderstatus", ["F", "O"])], [quality.Fix(F.col("o_totalprice") > 300000, "o_totalprice", F.lit(300000.0), "cap")])
    return q.attach(_t(spark, d, "orders"))[0].select("o_orderkey", "o_totalprice")


# panels


@query("""WITH p AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1996-12-01', INTERVAL 1 MONTH)) m), k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01')
  SELECT k.o_custkey, 'M' || strftime(m, '%Y%m') AS period, count(o_orderkey) AS n FROM k CROSS JOIN p LEFT JOIN orders o ON o.o_custkey = k.o_custkey AND date_trunc('month', o_orderdate) = m GROUP BY ALL""")
def panel_monthly(spark, d):
    return keyed(_t(spark, d, "orders"), "o_custkey").time_panel_agg("o_orderdate", month(1996, 1), month(1996, 12), F.count("o_orderkey").alias("n"))


@query("""SELECT event_type, 'W' || strftime(date_trunc('week', ts), '%Y%m%d') AS period, count(event_id) AS n FROM events WHERE date_trunc('week', ts) BETWEEN '2024-01-01' AND '2024-01-22' GROUP BY ALL""")
def panel_weekly(spark, d):
    return keyed(_t(spark, d, "events"), "event_type").time_panel_agg("ts", week(2024, 1, 3), week(2024, 1, 22), F.count("event_id").alias("n"))


@query("SELECT n_regionkey, n_name, n_nationkey FROM nation UNION ALL SELECT r_regionkey, 'NOWHERE', NULL FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def fill_expected(spark, d):
    return keyed(_t(spark, d, "nation").select("n_regionkey", "n_name", "n_nationkey"), "n_regionkey").fill_expected("n_name", ["NOWHERE"])


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, quarter(o_orderdate)::INT AS q, day(o_orderdate)::INT AS d, isodow(o_orderdate)::INT AS dow, hour(o_orderdate)::INT AS h,
  date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INT AS d70, ((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1)::INT AS m70, 'D' || strftime(o_orderdate, '%Y%m%d') AS dc, 'Q' || year(o_orderdate) || '0' || quarter(o_orderdate) AS qc FROM orders""")
def date_parts(spark, d):
    c = "o_orderdate"
    return _t(spark, d, "orders").select("o_orderkey", dates.year(c).alias("y"), dates.month(c).alias("m"), dates.quarter(c).alias("q"), dates.day_of_month(c).alias("d"), dates.day_of_week(c).alias("dow"), dates.hour(c).alias("h"), dates.day70(c).alias("d70"), dates.month70(c).alias("m70"), dates.day_code(c).alias("dc"), dates.quarter_code(c).alias("qc"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS d, o_orderdate + INTERVAL 14 DAY AS w, o_orderdate + to_months((o_orderkey % 5)::INT) AS m, o_orderdate + INTERVAL 1 YEAR AS y FROM orders")
def plus_months(spark, d):
    c = "o_orderdate"
    return _t(spark, d, "orders").select("o_orderkey", dates.plus_days(c, 3).alias("d"), dates.plus_weeks(c, 2).alias("w"), dates.plus_months(c, (F.col("o_orderkey") % 5).cast("int")).alias("m"), dates.plus_years(c, 1).alias("y"))


@query("SELECT o_orderkey, 'quarter' AS kind, ((year(o_orderdate) - 1970) * 4 + quarter(o_orderdate) - 1)::INT AS i, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS label, date_trunc('quarter', o_orderdate)::TIMESTAMP AS start FROM orders")
def period_decode(spark, d):
    q = _t(spark, d, "orders").select("o_orderkey", dates.quarter_code("o_orderdate").alias("c"))
    return q.select("o_orderkey", dates.code_to_type("c").alias("kind"), dates.code_to_index("c").alias("i"), dates.code_to_label("c").alias("label"), dates.code_to_timestamp("c").alias("start"))


# scalar functions


@query("SELECT c_custkey, 'k_' || md5(c_mktsegment || c_nationkey::VARCHAR) AS h, c_mktsegment || '_' || coalesce(nullif(c_nationkey, 3)::VARCHAR, '') AS s, CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END || CASE WHEN c_nationkey = 3 THEN '1' ELSE '0' END AS bits FROM customer")
def string_functions(spark, d):
    c = _t(spark, d, "customer")
    return c.select("c_custkey", scalar.hash_key("c_mktsegment", "c_nationkey", prefix="k_").alias("h"), scalar.str_cat("c_mktsegment", F.nullif(F.col("c_nationkey"), F.lit(3)), sep="_").alias("s"), scalar.bools_to_bitmap(F.col("c_acctbal") > 0, F.col("c_nationkey") == 3).alias("bits"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN 0.0 WHEN c_nationkey = 0 THEN -1.0 ELSE round(c_acctbal / c_nationkey, 6) END AS div, floor(c_acctbal / 250) * 250 AS coarse,
  CASE WHEN c_acctbal < 0 THEN floor(c_acctbal / 1000) * 1000 WHEN c_acctbal = 0 THEN 0 WHEN c_acctbal < 10 THEN 0.01 WHEN c_acctbal < 200 THEN floor(c_acctbal / 10) * 10 WHEN c_acctbal < 1000 THEN floor(c_acctbal / 50) * 50 ELSE floor(c_acctbal / 500) * 500 END::DOUBLE AS money FROM customer""")
def binning(spark, d):
    c = _t(spark, d, "customer")
    return c.select("c_custkey", _r(scalar.safe_div("c_acctbal", "c_nationkey", -1)).alias("div"), scalar.coarse_grain("c_acctbal", 250).alias("coarse"), scalar.money_bin("c_acctbal").alias("money"))


@query("SELECT n_nationkey, coalesce(CASE n_regionkey WHEN 0 THEN 'a' WHEN 1 THEN 'b' END, '?') AS v, regexp_replace(n_name, '[^a-zA-Z0-9]+', '_', 'g') AS name FROM nation")
def lookups(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", scalar.lookup("n_regionkey", {0: "a", 1: "b"}, "?").alias("v"), scalar.column_name_text("n_name").alias("name"))


@query("SELECT n_nationkey, n_regionkey IN (1, 2) OR n_nationkey IN (1, 2) AS some, n_regionkey IN (1, 2) AND n_nationkey IN (1, 2) AS every, (n_regionkey = 1 OR n_nationkey = 1) AS has FROM nation")
def array_functions(spark, d):
    a = F.array(F.col("n_regionkey"), F.col("n_nationkey"))
    return _t(spark, d, "nation").select("n_nationkey", scalar.any_in(a, 1, 2).alias("some"), scalar.all_in(a, 1, 2).alias("every"), scalar.contains_all(a, 1).alias("has"))


_PAIRS = "SELECT a.n_name x, b.n_name y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"


def _pairs(spark, d):
    n = _t(spark, d, "nation")
    return n.select("n_regionkey", F.col("n_name").alias("x")).join(n.select("n_regionkey", F.col("n_name").alias("y")), "n_regionkey").select("x", "y")


@query(f"SELECT x, y, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 4)::DOUBLE AS lev, round(jaro_winkler_similarity(x, y), 4) AS jw FROM ({_PAIRS})")
def similarities(spark, d):
    return _pairs(spark, d).select("x", "y", _r(similarity.norm_levenshtein("x", "y").cast("double"), 4).alias("lev"), _r(similarity.jaro_winkler("x", "y").cast("double"), 4).alias("jw"))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    from tessera.streaming.windows import windowed

    return windowed(_t(spark, d, "events"), "ts", ["event_type"], "1 day", "1 hour", F.count("*").alias("n"))


from tessera import query_details, query_sources  # noqa: E402, F401  they register their queries here
