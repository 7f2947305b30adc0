"""More queries over the driver's tables: projections, metadata, groupings, reshaping, dates, strings, profiles and quality, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import aggregates as agg
from tessera.functions import dates, scalar, similarity
from tessera.operators import columns as cols
from tessera.operators import discovery, joins, keyed, profile, quality
from tessera.queries import _r, _t, query

# projections and metadata


@query("SELECT n_nationkey + 1 AS next, n_nationkey, n_name, n_regionkey, 'next' AS named FROM nation")
def prepend_columns(spark, d):
    n, more = _t(spark, d, "nation"), (F.col("n_nationkey") + 1).alias("next")
    return cols.select_plus(cols.prepend(n, more), F.lit(cols.column_name(n, more)).alias("named"))


@query("SELECT n_nationkey AS n_nationkey_x, n_regionkey AS n_regionkey_x, 1 AS n_nationkey_x_y FROM nation")
def select_minus(spark, d):
    n = cols.postfix_names(cols.select_minus(_t(spark, d, "nation"), "n_name"), "_x")
    return cols.select_plus(n, F.lit(1).alias(cols.unique_name(n.columns, "n_nationkey_x", postfix="_y")))


@query("SELECT * FROM (VALUES ('r_regionkey', 'key of a region'), ('r_name', '')) t(name, about)")
def described_columns(spark, d):
    table = spark.createDataFrame([("r_regionkey", "key of a region"), ("r_name", "its name"), ("absent", "x")], "name string, about string")
    r = cols.remove_descriptions(cols.describe_from(_t(spark, d, "region"), table), "r_name")
    return spark.createDataFrame(cols.descriptions(cols.rename(cols.rename(r, {"r_name": "n"}), {"n": "r_name"})), "name string, about string")


@query("SELECT c_custkey, c_name FROM customer")
def labelled_columns(spark, d):
    c = cols.add_labels(_t(spark, d, "customer"), ["c_custkey", "c_name", "c_acctbal"], ["id", "shown"])
    return cols.select_by_label(cols.remove_labels(c, ["c_acctbal"], ["id"]), "id", "shown")


# sampling, joins, groupings


@query("SELECT count(*) AS rows_seen, max(o_totalprice) AS top FROM orders")
def pipe_count(spark, d):
    o, seen = discovery.pipe_count(_t(spark, d, "orders"))
    top = o.agg(F.max("o_totalprice")).first()[0]
    return spark.createDataFrame([(seen.get["n"], top)], "rows_seen long, top double")


@query("SELECT n_nationkey AS a, r_regionkey AS b, '1' AS \"MatchBitmap\", true AS near FROM nation JOIN region ON abs(n_nationkey - r_regionkey * 5) <= 1")
def match_all_pairs(spark, d):
    n, r = _t(spark, d, "nation").select(F.col("n_nationkey").alias("a")), _t(spark, d, "region").select(F.col("r_regionkey").alias("b"))
    return joins.EntityMatcher("a", "b", [joins.ExactLevel("near", F.abs(F.col("a") - F.col("b") * 5) <= 1)]).match(n, r)


@query("SELECT c_nationkey, c_nationkey % 5 AS first, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, count(*) FILTER (c_acctbal < 0) AS no_balance FROM customer GROUP BY c_nationkey")
def first_and_sets(spark, d):
    c = _t(spark, d, "customer").withColumn("region", F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey") % 5)).withColumn("bal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return keyed.keyed(c, "c_nationkey").agg(
        agg.first_value("region", non_null=True).alias("first"), F.array_join(F.array_sort(agg.collect_values("c_mktsegment", T.StringType())), ",").alias("segments"), agg.count_null("bal").alias("no_balance"),
    )


@query("SELECT o_custkey, 1::BIGINT AS parts, count(*) AS n FROM orders GROUP BY 1")
def repartitioned(spark, d):
    o = keyed.keyed(_t(spark, d, "orders"), "o_custkey").repartition(8).select("o_custkey", F.spark_partition_id().alias("part"))
    return o.groupBy("o_custkey").agg(F.count_distinct("part").alias("parts"), F.count("*").alias("n"))


@query("SELECT 'c_name' AS \"column\", true AS near UNION ALL SELECT 'c_mktsegment', true")
def approximate_distinct(spark, d):
    c = _t(spark, d, "customer")
    true = c.agg(F.count_distinct("c_name").alias("c_name"), F.count_distinct("c_mktsegment").alias("c_mktsegment")).select(F.explode(F.create_map(F.lit("c_name"), "c_name", F.lit("c_mktsegment"), "c_mktsegment")).alias("column", "n"))
    return profile.summary(c, "c_name", "c_mktsegment").where("task = 'dct'").join(true, "column").select("column", (F.abs(F.col("value").cast("double") / F.col("n") - 1) < 0.05).alias("near"))


@query("SELECT v, n FROM (SELECT n_regionkey AS v FROM nation INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey > 1), (SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier))")
def set_operations(spark, d):
    t = lambda name, c: _t(spark, d, name).select(F.col(c).alias("v"))
    both = t("nation", "n_regionkey").intersect(t("region", "r_regionkey").where("v > 1"))
    return both.join(t("customer", "c_nationkey").exceptAll(t("supplier", "s_nationkey")).distinct().join(t("supplier", "s_nationkey"), "v", "left_anti").agg(F.count("*").alias("n")))


# reshaping


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, " + ", ".join(f"CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END AS \"o_totalprice_{s}\"" for s in "FOP") + " FROM orders")
def pivot_rows(spark, d):
    return keyed.pivot(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), [["o_orderstatus"]], ["o_totalprice"], list("FOP"))


@query("SELECT n_regionkey, " + ", ".join(f"CASE WHEN n_nationkey % 2 = {i} THEN n_nationkey END AS n_nationkey_{i}" for i in (0, 1)) + " FROM nation")
def pivot_found_names(spark, d):
    n = _t(spark, d, "nation").withColumn("odd", F.col("n_nationkey") % 2)
    return keyed.keyed(n, "n_regionkey").pivot([["odd"]], ["n_nationkey"])


@query("SELECT p_partkey, '1' AS nth, p_size::BIGINT AS size, p_name AS word FROM part UNION ALL SELECT p_partkey, '2', p_partkey, NULL FROM part UNION ALL SELECT p_partkey, '10', NULL, p_brand FROM part")
def unpivot_by_function(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("size1"), F.col("p_partkey").alias("size2"), F.col("p_name").alias("word1"), F.col("p_brand").alias("word10"))
    return cols.unpivot_by(p, ["size1", "size2", "word1", "word10"], lambda c: (c.rstrip("0123456789"), c.lstrip("abcdefghijklmnopqrstuvwxyz")), "nth")


# dates, numbers, strings, arrays


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS said, o_orderdate AS back, strftime(o_orderdate + INTERVAL 330 MINUTE, '%d.%m. %H:%M') AS there, strftime(o_orderdate + INTERVAL (o_orderkey % 3) HOUR, '%H') AS here, true AS bad FROM orders""")
def date_strings(spark, d):
    o = _t(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    said = dates.timestamp_to_str("ts", "yyyy/MM/dd HH:mm")
    zone = F.concat(F.lit("+0"), (F.col("o_orderkey") % 3).cast("string"), F.lit(":00"))
    return o.select("o_orderkey", said.alias("said"), dates.str_to_timestamp(said, "yyyy/MM/dd HH:mm").cast("timestamp_ntz").alias("back"), dates.timestamp_to_str("ts", "dd.MM. HH:mm", "+05:30").alias("there"), dates.timestamp_to_str("ts", "HH", zone).alias("here"), dates.str_to_timestamp(F.lit("2012-13-01"), "yyyy-MM-dd").isNull().alias("bad"))


_FIRST = "date_trunc('week', o_orderdate)::DATE"
_WED = "(o_orderdate::DATE - ((isodow(o_orderdate) - 3 + 7) % 7)::INT)"


@query(f"""SELECT o_orderkey, 'W' || strftime({_FIRST}, '%Y%m%d') AS week, floor((date_diff('day', DATE '1970-01-01', {_FIRST}) - 4) / 7)::INT + 1 AS week_index, 'Week of ' || strftime({_FIRST}, '%Y-%m-%d') AS week_label,
  'W(3)' || strftime({_WED}, '%Y%m%d') AS wednesday, 'week_start_on_Wednesday' AS kind, {_WED}::TIMESTAMP AS start, strftime(o_orderdate, '%Y-%m') AS month_label, ((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1)::INT AS month_index, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INT AS day_index FROM orders""")
def period_codes(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", *(f("o_orderdate").alias(n) for n, f in (("week", dates.week_code), ("m", dates.month_code), ("d", dates.day_code))), dates.week_code("o_orderdate", 3).alias("wednesday"))
    return o.select(
        "o_orderkey", "week", dates.code_to_index("week").alias("week_index"), dates.code_to_label("week").alias("week_label"), "wednesday", dates.code_to_type("wednesday").alias("kind"),
        dates.code_to_timestamp("wednesday").cast("timestamp_ntz").alias("start"), dates.code_to_label("m").alias("month_label"), dates.code_to_index("m").alias("month_index"), dates.code_to_index("d").alias("day_index"),
    )


@query("SELECT c_custkey, CASE WHEN c_custkey = 100 THEN 90.0 ELSE floor(c_custkey / 10) * 10 END::DOUBLE AS bin, c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS some FROM customer WHERE c_custkey <= 100")
def numeric_bins(spark, d):
    c = _t(spark, d, "customer").where("c_custkey <= 100")
    return c.select("c_custkey", scalar.numeric_bin("c_custkey", 0, 100, 10).alias("bin"), scalar.has_non_null(*(F.when(F.col("c_custkey") % n == 0, 1) for n in (2, 3))).alias("some"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN NULL WHEN n_nationkey % 2 = 0 THEN n_regionkey || '-' || n_name || '-' || n_name ELSE n_regionkey || '-' || n_name END AS flat, CASE WHEN n_nationkey = 3 THEN '' ELSE n_name END || '/' || n_regionkey AS joined FROM nation""")
def nested_arrays(spark, d):
    n = _t(spark, d, "nation").withColumn("name", F.when(F.col("n_nationkey") != 3, F.col("n_name")))
    inner = F.array(F.array(F.col("n_regionkey").cast("string"), "n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.array("n_name")))
    return n.select("n_nationkey", F.array_join(scalar.flatten_arrays(F.when(F.col("name").isNotNull(), inner)), "-").alias("flat"), scalar.array_cat("/", F.array("name", F.col("n_regionkey").cast("string"))).alias("joined"))


_WORDS = "(SELECT DISTINCT p_name AS x, p_type AS y FROM part)"


def _grams(c: str, n: int) -> str:
    return f"list_transform(range(1, (length({c}) - {n - 2})::BIGINT), lambda i: substr({c}, i, {n}))"


def _alike(n: int) -> str:
    count = lambda c: f"len(list_filter({c}, lambda h: h = g))"
    return f"list_sum([0] || list_transform(list_distinct({_grams('x', n)}), lambda g: least({count(_grams('x', n))}, {count(_grams('y', n))})))"


@query(f"""SELECT x, y, round((CASE WHEN length(x) >= 2 AND length(y) >= 2 THEN s2 / greatest(length(x) - 1, length(y) - 1) END)::DOUBLE, 4) AS n2, round((CASE WHEN length(x) >= 3 AND length(y) >= 3 THEN s3 / greatest(length(x) - 2, length(y) - 2) END)::DOUBLE, 4) AS n3,
  round((CASE WHEN length(x) >= 2 AND length(y) >= 2 THEN 2 * s2 / (length(x) + length(y) - 2) END)::DOUBLE, 4) AS dice FROM (SELECT x, y, {_alike(2)} AS s2, {_alike(3)} AS s3 FROM (SELECT x, upper(x) || y AS y FROM (SELECT upper(x) AS x, y FROM {_WORDS})))""")
def ngrams(spark, d):
    p = _t(spark, d, "part").select(F.upper("p_name").alias("x"), F.concat(F.upper("p_name"), "p_type").alias("y")).distinct()
    return p.select("x", "y", *(_r(f("x", "y").cast("double"), 4).alias(n) for n, f in (("n2", similarity.ngram2), ("n3", similarity.ngram3), ("dice", similarity.dice_sorensen))))


@query("""WITH w AS (SELECT c_mktsegment AS w FROM customer UNION SELECT p_type FROM part),
  c AS (SELECT w, upper(w[1]) || replace(replace(upper(w)[2:], 'H', ''), 'W', '') AS s FROM w), k AS (SELECT w, translate(s, 'ABCDEFGIJKLMNOPQRSTUVXYZHW', '01230120224550126230120200') AS k FROM c)
  SELECT w, upper(w[1]) || rpad(substr(coalesce(array_to_string(list_transform(list_filter(range(2, (length(k) + 1)::BIGINT), lambda i: k[i] <> k[i - 1] AND k[i] <> '0'), lambda i: k[i]), ''), ''), 1, 3), 3, '0') AS sound FROM k""")
def soundex(spark, d):
    w = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("w")).union(_t(spark, d, "part").select("p_type")).distinct()
    return w.select("w", F.soundex("w").alias("sound"))


@query()
def metaphone(spark, d):
    w = _t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return w.select("w", similarity.metaphone("w").alias("sound"))


# profiles


@query("SELECT c_mktsegment, count(c_acctbal) AS cnt, round(avg(c_acctbal), 4) AS avg, min(c_acctbal) AS min, min(length(c_name))::BIGINT AS mil FROM customer GROUP BY 1")
def profile_by_key(spark, d):
    s = profile.summary(_t(spark, d, "customer"), "c_acctbal", "c_name", keys=["c_mktsegment"])
    pick = lambda c, t: F.max(F.when((F.col("column") == c) & (F.col("task") == t), F.col("value").cast("double")))
    return s.groupBy("c_mktsegment").agg(pick("c_acctbal", "cnt").cast("long").alias("cnt"), _r(pick("c_acctbal", "avg"), 4).alias("avg"), pick("c_acctbal", "min").alias("min"), pick("c_name", "mil").cast("long").alias("mil"))


def _bars(p):
    """A profile's histograms as rows."""
    bars = p.select("column", "task", F.explode(F.from_json(F.get_json_object("value", "$.hist"), "map<string,long>")).alias("bar", "n"))
    return bars.withColumn("bar", F.replace(F.col("bar"), F.lit('"'), F.lit("")))


@query("""SELECT 'ts' AS "column", 'yea' AS task, strftime(ts, '%Y') AS bar, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'ts', 'mon', strftime(ts, '%m'), count(*) FROM events GROUP BY ALL
  UNION ALL SELECT 'ts', 'dow', (dayofweek(ts) + 1)::VARCHAR, count(*) FROM events GROUP BY ALL UNION ALL SELECT 'ts', 'hou', strftime(ts, '%H'), count(*) FROM events GROUP BY ALL
  UNION ALL SELECT 'big', 'boo', coalesce((value > 50)::VARCHAR, 'null'), count(*) FROM events GROUP BY ALL""")
def time_histograms(spark, d):
    e = _t(spark, d, "events").select("ts", (F.col("value") > 50).alias("big"))
    return _bars(profile.summary(e, "ts", "big").where("kind = 'hist'"))


@query("""SELECT 'c_mktsegment' AS "column", 'key' AS task, coalesce(nullif(c_mktsegment, 'BUILDING'), 'null') AS bar, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'c_nationkey', 'nkh', c_nationkey || '.0', count(*) FROM customer GROUP BY ALL
  UNION ALL SELECT 'c_acctbal', 'amt', CASE WHEN c_acctbal < 0 THEN floor(c_acctbal / 1000) * 1000 WHEN c_acctbal = 0 THEN 0 WHEN c_acctbal < 10 THEN 0.01 WHEN c_acctbal < 200 THEN floor(c_acctbal / 10) * 10 WHEN c_acctbal < 1000 THEN floor(c_acctbal / 50) * 50 ELSE floor(c_acctbal / 500) * 500 END::DOUBLE::VARCHAR, count(*) FROM customer GROUP BY ALL""")
def histograms(spark, d):
    c = _t(spark, d, "customer").withColumn("c_mktsegment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return _bars(profile.histograms(c, "c_mktsegment", "c_nationkey", profile.AmountHist("c_acctbal")))


@query("SELECT 'l_returnflag_l_linestatus' AS \"column\", 'key' AS task, l_returnflag || '_' || l_linestatus AS bar, count(*) AS n FROM lineitem GROUP BY ALL")
def joint_histogram(spark, d):
    return _bars(profile.concat_hist(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]))


@query("SELECT row_number() OVER (ORDER BY n DESC, c_mktsegment) AS place, c_mktsegment AS bar, n FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)")
def frequency_histogram(spark, d):
    lines = profile.report(profile.freq_hist(_t(spark, d, "customer"), "c_mktsegment")).splitlines()[1:]
    return spark.createDataFrame([(i + 1, x.split()[0], int(x.split()[1])) for i, x in enumerate(lines)], "place long, bar string, n long")


@query("SELECT * FROM (VALUES ('same', true, 0::BIGINT), ('more rows', false, 3::BIGINT)) t(what, alike, differences)")
def profile_compare(spark, d):
    c = _t(spark, d, "customer").select("c_nationkey")
    a, b = profile.summary(c), profile.summary(c.union(c.limit(0)))
    more = profile.summary(c.union(spark.createDataFrame([(1000,)], "c_nationkey int")))
    rows = [("same", *profile.compare(a, b)), ("more rows", *profile.compare(a.where("task IN ('cnt', 'max', 'avg', 'min')"), more.where("task IN ('cnt', 'max', 'avg', 'min')")))]
    return spark.createDataFrame([(w, ok, len(x)) for w, ok, x in rows], "what string, alike boolean, differences long")


# quality

_BAD = "count(*) FILTER (NOT (o_totalprice >= 1000 AND o_totalprice < 400000))"
_FIXED = "count(*) FILTER (o_totalprice >= 1000 AND o_totalprice < 400000 AND o_orderstatus NOT IN ('F', 'O'))"


@query(f"""SELECT unnest(['BoundRule(o_totalprice)', 'SetFix(o_orderstatus)', 'FailParserCountPolicy(1)', 'FailTotalRuleCountPolicy(10)', 'FailTotalFixCountPolicy(1000000)', 'FailTotalRulePercentPolicy(0.5)', 'FailTotalFixPercentPolicy(0.0001)']) AS task,
  unnest([{_BAD} < 0.01 * count(*), {_FIXED} < 1, true, {_BAD} < 10, {_FIXED} < 1000000, {_BAD} < 0.5 * count(*), {_FIXED} < 0.0001 * count(*)]) AS passed, unnest([{_BAD}, {_FIXED}, 0, {_BAD}, {_FIXED}, {_BAD}, {_FIXED}]) AS n FROM orders""")
def quality_policies(spark, d):
    q = quality.Quality(
        [quality.bound_rule("o_totalprice", 1000, 400000, policy=quality.fail_percent(0.01))], [quality.set_fix("o_orderstatus", ["F", "O"], "O", policy=quality.fail_any())],
        [quality.parser_count(1), quality.total_rule_count(10), quality.total_fix_count(1_000_000), quality.total_rule_percent(0.5), quality.total_fix_percent(0.0001)],
    )
    checked, seen = q.attach(_t(spark, d, "orders"))
    checked.write.format("noop").mode("overwrite").save()
    out = q.validate(seen, fail=False)
    rules, fixes = (sum(x.values()) for x in ({k: v["total"] for k, v in out["dqmStateSnapshot"]["ruleErrors"].items()}, out["dqmStateSnapshot"]["fixCounts"]))
    rows = [(k, v == "true", 0 if "Parser" in k else rules if "Rule" in k else fixes) for m in out["errorMessages"] for k, v in m.items()]
    return spark.createDataFrame(rows, "task string, passed boolean, n long")


@query("SELECT c_custkey, c_name, CASE WHEN c_mktsegment SIMILAR TO '[A-M].*' THEN c_mktsegment ELSE 'other' END AS c_mktsegment FROM customer WHERE c_name SIMILAR TO 'Customer#0*[1-9]+' AND c_custkey IS NOT NULL")
def format_rules(spark, d):
    q = quality.Quality([quality.format_rule("c_name", "Customer#0*[1-9]+")], [quality.format_fix("c_mktsegment", "[A-M].*", "other")])
    return q.attach(_t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))[0]


@query("SELECT unnest(['fewer than before', 'too few']) AS message, unnest([7, 3]) AS rows_now")
def historical_validators(spark, d):
    less = lambda now, history: "fewer than before" if history and now["n"] < history[0]["n"] else None
    few = lambda now, history: "too few" if now["n"] < 5 else None

    @quality.historical(less)
    @quality.historical(few)
    class Checked:
        pass

    seen, rows = [], []
    for n in (10, 12, 7, 3):
        said = Checked().validate_metadata({"n": n}, seen)
        rows += [(m, n) for m in (said or "").split(";") if m and (n != 3 or m == "too few")]
        seen.insert(0, {"n": n})
    return spark.createDataFrame(rows, "message string, rows_now int")
