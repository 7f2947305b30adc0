"""Queries that go through sources, sinks and the module framework: what is written and read again must be the table it was."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.quality import Quality, bound_rule
from tessera.plans import flow
from tessera.queries import _t, query
from tessera.sources import tables
from tessera.sources.schema import TextSchema, csv_lines, discover_schema, export_csv, read_csv, read_inline, write_csv
from tessera.sources.storage import Storage, scratch

# files


def _files(path: str) -> tables.Connection:
    return tables.Connection("files", "files", {"path": path})


@query("SELECT * FROM customer")
def csv_round_trip(spark, d):
    path = scratch(spark, "csv")
    write_csv(_t(spark, d, "customer"), f"{path}/customer.csv")
    return tables.csv_file(spark, _files(path), "customer.csv")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal, s_acctbal > 0 AS good FROM supplier WHERE s_nationkey < 20")
def csv_folder(spark, d):
    """Several files, each with its header, by the schema beside their folder; and a hook that is run on what was read."""
    path, s = scratch(spark, "csv"), _t(spark, d, "supplier")
    s.repartition(3).write.option("header", True).csv(path)
    Storage(spark).write(f"{path}.schema", "\n".join(TextSchema.of(s, {"has-header": "true"}).lines()))
    return tables.csv_directory(spark, path, run=lambda df: df.where("s_nationkey < 20").withColumn("good", F.col("s_acctbal") > 0))


@query("SELECT * FROM (VALUES (1, 'x', 2.5::DOUBLE), (2, NULL, 0.1), (3, 'q,z', NULL)) t(a, b, c)")
def inline_rows(spark, d):
    return read_inline(spark, "a: Integer; b: String; c: Double", '1,x,2.5; 2,,0.1; 3,"q,z",')


@query("SELECT * FROM region")
def xml_rows(spark, d):
    path, r = scratch(spark, "xml"), _t(spark, d, "region")
    r.write.format("xml").option("rowTag", "region").save(path)
    Storage(spark).write(f"{path}.json", r.schema.json())
    return tables.xml_file(spark, path, "region", f"{path}.json")


@query("SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_regionkey = 1")
def jdbc_round_trip(spark, d):
    """Through the database that comes with Spark, in memory."""
    own = tables.Connection("derby", "jdbc", {"url": f"jdbc:derby:memory:{scratch(spark, 'db').rsplit('/', 1)[1]};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    n = _t(spark, d, "nation")
    tables.write_jdbc(n, own, "nation", "overwrite")
    tables.write_jdbc(n.where("n_regionkey = 1"), own, "nation", "append")
    return tables.jdbc_table(spark, own, "nation").toDF(*n.columns)


@query("SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_regionkey = 1")
def catalog_round_trip(spark, d):
    path, n = scratch(spark, "table"), _t(spark, d, "nation")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    tables.write_catalog_table(n, name, path=path)
    tables.write_catalog_table(n.where("n_regionkey = 1"), name, "append")
    tables.write_catalog_table(n, name, "ignore")
    return tables.catalog_table(spark, name)


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def sql_over_csv(spark, d):
    path, c = scratch(spark, "csv"), _t(spark, d, "customer")
    write_csv(c, f"{path}/c.csv")
    return tables.sql_csv(spark, f"{path}/c.csv", TextSchema.of(c, {"has-header": "false"}), "select c_mktsegment, count(*) as n from df group by 1")


@query("SELECT * FROM (VALUES ('o_orderkey', 'Integer'), ('o_day', 'Date[yyyyMMdd]'), ('o_time', 'Timestamp[MM/dd/yyyy HH:mm:ss]'), ('o_month', 'Date[ddMMMyyyy]'), ('o_price', 'Float'), ('o_long', 'Long'), ('o_late', 'Boolean'), ('o_status', 'String')) t(name, kind)")
def discovered_schema(spark, d):
    path, day = scratch(spark, "csv"), lambda f, n: F.date_format("o_orderdate", f).alias(n)
    o = _t(spark, d, "orders").select("o_orderkey", day("yyyyMMdd", "o_day"), day("MM/dd/yyyy HH:mm:ss", "o_time"), day("ddMMMyyyy", "o_month"), F.col("o_totalprice").alias("o_price"), (F.col("o_orderkey") + 3_000_000_000).alias("o_long"), (F.col("o_custkey") > 9).alias("o_late"), F.col("o_orderstatus").alias("o_status"))
    o.coalesce(1).write.option("header", True).csv(path)
    return spark.createDataFrame([(e.name, e.text) for e in discover_schema(spark, path, 1000).entries], "name string, kind string")


@query("SELECT '\"r_regionkey\",\"r_name\"' AS line UNION ALL SELECT r_regionkey || ',\"' || r_name || '\"' FROM region")
def exported_csv(spark, d):
    path = f"{tempfile.mkdtemp(prefix='tessera-')}/region.csv"  # a file of the driver's own machine is what this sink is for
    export_csv(_t(spark, d, "region"), path)
    with open(path, encoding="utf-8") as f:
        return spark.createDataFrame([(x.rstrip("\n"),) for x in f], "line string")


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '_NullString_') AS c_mktsegment FROM customer")
def null_text_csv(spark, d):
    path = scratch(spark, "csv")
    tables.write_csv_output(_t(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment")), f"{path}/c.csv")
    return tables.csv_file(spark, _files(path), "c.csv")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber <> 3")
def csv_rejects(spark, d):
    """Rows with an unreadable cell are left out."""
    path, line = scratch(spark, "csv"), _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    csv_lines(line).select(F.when(F.col("value").rlike("^[0-9]+,3,"), F.concat("value", F.lit("x"))).otherwise(F.col("value"))).write.text(path)
    return read_csv(spark, path, TextSchema.of(line, {"has-header": "false"}), fail=False)


@query("SELECT * FROM (VALUES ('a.csv', false), ('b', true), ('c.csv', false)) t(name, folder)")
def listing(spark, d):
    path, storage = scratch(spark, "list"), Storage(spark)
    for name in ("c.csv", "a.csv", "b/x.csv", "gone.csv"):
        storage.write(f"{path}/{name}", name)
    storage.purge(path, {"a.csv", "b", "c.csv"})
    assert _files(path).contents(spark) == [e.name for e in storage.list(path)]
    return spark.createDataFrame([(e.name, e.folder) for e in storage.list(path)], "name string, folder boolean")


@query("SELECT unnest(['r_regionkey: Integer; r_name: String', '0,AFRICA', 'r_name:string = AFRICA']) AS line")
def peek_and_dump(spark, d):
    path, r = scratch(spark, "peek"), _t(spark, d, "region").where("r_regionkey = 0")
    tables.peek_save(r, path, pattern=".*name")
    return spark.createDataFrame([(x,) for x in [*tables.dump(r).splitlines(), *Storage(spark).read(path).splitlines()]], "line string")


# modules


class Orders(flow.Module):
    ephemeral, config_keys = True, ("tables",)

    def run(self, inputs):
        return self.app.spark.read.parquet(f"{self.app.config['tables']}/orders.parquet")


class ByStatus(flow.SqlModule):
    def tables(self):
        return {"o": Orders}

    def query(self):
        return "select o_orderstatus, count(*) as n, max(o_totalprice) as top from o group by 1"


class AsCsv(ByStatus):
    persist = "csv"


class AsJson(ByStatus):
    persist = "json"


class Cut(flow.ModelModule):
    def requires(self):
        return [ByStatus]

    def run(self, inputs):
        return {r["o_orderstatus"]: r["top"] / 2 for r in inputs[ByStatus].collect()}


class Dear(flow.ModelExecModule):
    def model(self):
        return Cut

    def data(self):
        return [flow.link(Orders)]

    def execute(self, inputs, model):
        cut = F.create_map(*(F.lit(x) for kv in model.items() for x in kv))
        return inputs[Orders].where(F.col("o_totalprice") > F.try_element_at(cut, F.col("o_orderstatus"))).select("o_orderkey")


class Checked(flow.Module):
    def requires(self):
        return [Orders]

    def run(self, inputs):
        return inputs[Orders].select("o_orderkey", "o_totalprice")

    def quality(self):
        return Quality([bound_rule("o_totalprice", 1000, 400000)])


def _app(spark: SparkSession, d: str, **config) -> flow.App:
    path = scratch(spark, "app")
    return flow.App(spark, {"data": path, "publish": f"{path}/publish", "tables": d, **config}, [Orders, ByStatus, AsCsv, AsJson, Cut, Dear, Checked])


_BY_STATUS = "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1"


def _twice(spark: SparkSession, d: str, module: type[flow.Module]) -> DataFrame:
    """Made, then found by another application over the same folder."""
    app = _app(spark, d, lock=True)
    app.run(module)
    again = flow.App(spark, app.config, [module])
    assert again.resolve(module).persisted()
    return again.run(module)


@query(_BY_STATUS)
def flow_parquet(spark, d):
    return _twice(spark, d, ByStatus)


@query(_BY_STATUS)
def flow_csv(spark, d):
    return _twice(spark, d, AsCsv)


@query(_BY_STATUS)
def flow_json(spark, d):
    return _twice(spark, d, AsJson)


@query("SELECT o_orderkey FROM orders JOIN (SELECT o_orderstatus s, max(o_totalprice) / 2 AS cut FROM orders GROUP BY 1) ON o_orderstatus = s AND o_totalprice > cut")
def flow_model(spark, d):
    return _twice(spark, d, Dear)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 400000")
def flow_quality(spark, d):
    return _twice(spark, d, Checked)


@query("SELECT 3::BIGINT AS runs, count(*) AS records, count(*) FILTER (NOT (o_totalprice >= 1000 AND o_totalprice < 400000)) AS dropped, 2::BIGINT AS columns FROM orders")
def flow_history(spark, d):
    app = _app(spark, d, edd=True)
    for _ in range(3):
        app.run(Checked, force=True)
    state = app.run_info[Checked.name()]["dqm"]["dqmStateSnapshot"]
    return spark.createDataFrame([(len(app.history(Checked)), state["totalRecords"], sum(r["total"] for r in state["ruleErrors"].values()), len(app.history(Checked)[0]["columns"]))], "runs long, records long, dropped long, columns long")


@query("SELECT * FROM (VALUES ('ByStatus', 'Cut'), ('Cut', 'Dear'), ('Orders', 'AsCsv'), ('Orders', 'AsJson'), ('Orders', 'ByStatus'), ('Orders', 'Checked'), ('Orders', 'Dear'), ('ancestor', 'ByStatus'), ('ancestor', 'Cut'), ('ancestor', 'Orders'), ('dead', 'AsCsv'), ('dead', 'AsJson'), ('dead', 'Checked')) t(a, b)")
def flow_graph(spark, d):
    app, short = _app(spark, d), lambda name: name.rsplit(".", 1)[1]
    edges = [(short(a), short(b)) for a, b in json.loads(app.graph())["edges"]]
    return spark.createDataFrame([*edges, *(("ancestor", c.__name__) for c in app.ancestors(Dear)), *(("dead", c.__name__) for c in app.dead([Dear]))], "a string, b string")


@query(_BY_STATUS)
def flow_publish(spark, d):
    app = _app(spark, d)
    path = app.publish("ByStatus", "v1")
    assert all(app.storage.exists(path.removesuffix(".csv") + x) for x in (".meta", ".hist"))
    return tables.csv_file(spark, _files(path.rsplit("/", 1)[0]), path.rsplit("/", 1)[1])


@query("SELECT 'line' AS kind, o_orderstatus || '|' || count(*) AS line FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'set', 'rows of orders'")
def flow_command(spark, d):
    """The command line: settings from a file, a module by name, an export."""
    path, out = scratch(spark, "app"), f"{tempfile.mkdtemp(prefix='tessera-')}/out.csv"
    Storage(spark).write(f"{path}/app.conf", f"# tables\ntables = {d}\nshown : rows \\\n  of orders\n")
    flow.main(["--code", __name__, "-m", "ByStatus", "--config", f"{path}/app.conf", f"{path}/absent", "--data", path, "--export-csv", out], spark)
    with open(out, encoding="utf-8") as f:
        rows = [("line", "|".join(x.split(",")[:2]).replace('"', "")) for x in f.readlines()[1:]]
    return spark.createDataFrame([*rows, ("set", flow.load_config(Storage(spark), [f"{path}/app.conf"])["shown"])], "kind string, line string")


@query("SELECT * FROM (VALUES ('a', 'command'), ('b', 'user'), ('c', 'app'), ('d', 'default'), ('warehouse', 'jdbc')) t(k, v)")
def config_layers(spark, d):
    path, storage = scratch(spark, "conf"), Storage(spark)
    storage.write(f"{path}/app", "a=app\nb=app\nc=app\ncon.warehouse.type=jdbc\ncon.warehouse.url=jdbc:x\n")
    storage.write(f"{path}/user", "a = user\nb = user\n")
    config = flow.load_config(storage, [f"{path}/app", f"{path}/home", f"{path}/user"], {"a": "command", "b": None}, {"d": "default", "c": "default"})
    return spark.createDataFrame([*((k, config[k]) for k in "abcd"), *((n, c.kind) for n, c in flow.connections(config).items())], "k string, v string")


@query("SELECT unnest(['inside', 'after']) AS moment, unnest([false, true]) AS free")
def flow_lock(spark, d):
    path, storage, rows = f"{scratch(spark, 'lock')}/a.lock", Storage(spark), []
    with flow.lock(storage, path):
        rows.append(("inside", storage.create(path)))
    rows.append(("after", storage.create(path)))
    return spark.createDataFrame(rows, "moment string, free boolean")


@query("SELECT unnest(['conn', 'conn.jdbc', 'conn.jdbc.derby']) AS kind")
def registry(spark, d):
    r = flow.Registry()
    for kind in ("conn", "conn.jdbc", "conn.jdbc.derby", "connector", "plugin"):
        r.register(kind)(type(kind, (), {}))
    return spark.createDataFrame([(k,) for k in r.of("conn")], "kind string")
