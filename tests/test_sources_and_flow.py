import pytest
from support import rows

from tessera.operators.quality import Quality, bound_rule, fail_any
from tessera.plans import flow
from tessera.sources import tables
from tessera.sources.schema import CsvAttributes, TextSchema, discover_schema, export_csv, read_csv, write_csv


def test_schema_text():
    s = TextSchema.parse('@has-header = false\n@delimiter = |\n// comment\nname: String; # more\nage: integer\nm: Map[String, Integer]\nd: Decimal[12]\nt: Timestamp[ddMMyyyy] @metadata={"d": 1}\n')
    assert s.csv == CsvAttributes("|", '"', False)
    assert s.struct().simpleString() == "struct<name:string,age:int,m:map<string,int>,d:decimal(12,0),t:timestamp>"
    assert s.entries[4].metadata == {"d": 1} and TextSchema.parse("\n".join(s.lines())) == s
    with pytest.raises(ValueError):
        TextSchema.parse("a: Struct")


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"name","id"\n"Bob ""B"", Jr",1\nAl, 2 \n')
    s = TextSchema.parse("name: String\nid: Integer")
    d = read_csv(spark, str(tmp_path / "a.csv"), s)
    assert rows(d) == ["Al,2", 'Bob "B", Jr,1']
    write_csv(d, str(tmp_path / "b.csv"))
    back = tables.csv_file(spark, tables.Connection("x", "files", {"path": str(tmp_path)}), "b.csv")
    assert rows(back) == rows(d)
    export_csv(d, str(tmp_path / "c.csv"))
    assert (tmp_path / "c.csv").read_text().splitlines()[0] == '"name","id"'


def test_rejects(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a1,10\na2,x\na3,2\na4,\na5,y\n")
    s = TextSchema.parse("@has-header=false\na: String\nb: Integer")
    assert rows(read_csv(spark, str(tmp_path / "r.csv"), s, fail=False)) == ["a1,10", "a3,2", "a4,"]
    with pytest.raises(Exception, match="can't be read"):
        read_csv(spark, str(tmp_path / "r.csv"), s).collect()


def test_maps_and_arrays(frame):
    d = frame("m:Map[String,Integer];a:Array[Integer]", "x|1|y|2,1|2|3")
    assert d.first()["m"] == {"x": 1, "y": 2} and d.first()["a"] == [1, 2, 3]


def test_discovery(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,name,age,big,when,flag\n1,a,20,3000000000,20150102,true\n2,b,x,1,20150203,false\ntorn,line\n")
    s = discover_schema(spark, str(tmp_path / "t.csv"))
    assert [e.text for e in s.entries] == ["Integer", "String", "String", "Long", "Date[yyyyMMdd]", "Boolean"]


def test_xml_and_sql(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<R><ROW><year>2012</year><make>T</make></ROW><ROW><year>1997</year><make>F</make></ROW></R>")
    assert rows(tables.xml_file(spark, str(tmp_path / "x.xml"), "ROW").select("year", "make")) == ["1997,F", "2012,T"]
    (tmp_path / "q.csv").write_text("a,b\n1,x\n2,y\n")
    assert rows(tables.sql_csv(spark, str(tmp_path / "q.csv"), TextSchema.parse("a:Integer\nb:String"), "select b from df where a = 2")) == ["y"]


class Raw(flow.InlineData):
    schema, data = "a:Integer;b:Double", "1,0.3;0,0.2;3,0.5"


class Small(flow.Module):
    runs = 0

    def requires(self):
        return [Raw]

    def run(self, inputs):
        Small.runs += 1
        return inputs[Raw].where("b < 0.4")


class Total(flow.SqlModule):
    def tables(self):
        return {"small": Small}

    def query(self):
        return "select sum(a) as s from small"


class Model(flow.ModelModule):
    def requires(self):
        return [Total]

    def run(self, inputs):
        return {"s": inputs[Total].first()["s"]}


class Bad(flow.Module):
    def requires(self):
        return [Raw]

    def run(self, inputs):
        return inputs[Raw]

    def quality(self):
        return Quality([bound_rule("a", 1, 10, policy=fail_any())])


class A(flow.Module):
    def requires(self):
        return [B]


class B(flow.Module):
    def requires(self):
        return [A]


def test_flow(spark, tmp_path):
    config = {"data": str(tmp_path), "publish": str(tmp_path / "pub"), "lock": True}
    app = flow.App(spark, config, [Raw, Small, Total, Model])
    assert app.run("Model") == {"s": 1} and Small.runs == 1
    again = flow.App(spark, config, [Raw, Small, Total, Model])
    assert again.run(Total).first()["s"] == 1 and Small.runs == 1
    assert again.dead([Small]) == [Total, Model] and Total in again.descendants(Small) and Raw in again.ancestors(Model)
    assert "->" in again.graph("dot") and again.history(Small)[0]["columns"][0]["name"] == "a"
    assert again.publish(Total, "v1").endswith(".csv") and again.purge() == []
    with pytest.raises(ValueError, match="Cycle"):
        flow.App(spark, config).run(A)
    with pytest.raises(ValueError):
        flow.App(spark, config).run(Bad)


@pytest.mark.parametrize(("values", "kind"), [
    (["12/06/2012 10:22:14.0"], "Timestamp[MM/dd/yyyy HH:mm:ss.S]"), (["May-01-1905 23:11:01"], "Timestamp[MMM-dd-yyyy HH:mm:ss]"), (["01May1905 23:11:01.125"], "Timestamp[ddMMMyyyy HH:mm:ss.S]"),
    (["2018-01-01 10:22:14"], "Timestamp[yyyy-MM-dd HH:mm:ss]"), (["1/2/2012"], "Date[MM/dd/yyyy]"), (["31-Jan-1999", "1-December-2001"], "Date[dd-MMM-yyyy]"), (["2018-01-01", "01/02/2018"], "String"), (["20150102", "20151302"], "Integer"),
    (["1", "2.5"], "Float"), (["1", "3000000000"], "Long"), (["3000000000", "1.5"], "Double"), (["1.5", "1e300"], "Double"), (["true", "FALSE"], "Boolean"), (["true", "1"], "String"), (["13/13/2012"], "String"), (["1500000000"], "Long"),
])
def test_discovered_kinds(values, kind):
    from tessera.sources.schema import promote

    found = None
    for v in values:
        found = promote(found, v)
    assert found == kind


def test_storage(spark, tmp_path):
    from tessera.sources.storage import Storage

    s, root = Storage(spark), f"file://{tmp_path}/a"
    s.write(f"{root}/x/é.txt", "texté\n")
    assert s.read(f"{root}/x/é.txt") == "texté\n" and s.exists(f"{root}/x") and not s.exists(f"{root}/y")
    assert s.create(f"{root}/lock") and not s.create(f"{root}/lock") and s.modified(f"{root}/lock") > 0
    assert [(e.name, e.folder) for e in s.list(root)] == [("lock", False), ("x", True)]
    assert s.move(f"{root}/x", f"{root}/z") and s.purge(root, {"z"}) == ["lock"] and s.delete(root) and not s.delete(root)


def test_properties_and_connections():
    p = flow.properties("# c\n! c\na = 1\nb: two \\\n  words\nc\n con.db.type = jdbc\ncon.db.url=jdbc:x=y\n")
    assert p == {"a": "1", "b": "two words", "c": "", "con.db.type": "jdbc", "con.db.url": "jdbc:x=y"}
    assert flow.connections(p) == {"db": tables.Connection("db", "jdbc", {"url": "jdbc:x=y"})}


_CLUSTER = """
import importlib.util, os, sys, tempfile
from pathlib import Path

home = tempfile.mkdtemp()
for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # the executors' folders go to work in Spark's home
    if p.name != "work":
        os.symlink(p, f"{home}/{p.name}")
os.mkdir(f"{home}/work")
os.environ |= {"SPARK_HOME": home, "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
from pyspark.sql import SparkSession
from tessera.query_sources import jdbc_round_trip

conf = {"spark.master": "local-cluster[1,1,1024]", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{home}/shared", "spark.sql.shuffle.partitions": "1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.range(25).selectExpr("CAST(id AS INT) n_nationkey", "CONCAT('N', id) n_name", "CAST(id % 5 AS INT) n_regionkey").write.parquet(f"{home}/d/nation.parquet")
print("rows", sorted(r.n_nationkey for r in jdbc_round_trip(spark, f"{home}/d").collect()), flush=True)
os._exit(0)
"""


def test_embedded_database_where_executors_are_other_processes():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", _CLUSTER], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300).stdout
    assert f"rows {sorted([*range(25), *range(1, 25, 5)])}" in out


def test_embedded_database_keeps_types_and_modes(spark):
    own = tables.Connection("derby", "jdbc", {"url": "jdbc:derby:memory:kinds;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "batchsize": "7"})
    kinds = ("id n", "CAST(id AS INT) i", "id + 5000000000 l", "id / 3 d", "CAST(id AS FLOAT) f", "CAST(id / 4 AS DECIMAL(12, 2)) m", "CONCAT('é', id) s", "id % 2 = 0 b", "CAST(CONCAT('x', id) AS BINARY) y", "DATE'1969-12-30' + CAST(id AS INT) t", "TIMESTAMP'2024-02-29 12:34:56.123456' z")
    df = spark.range(20).selectExpr(kinds[0], *(f"CASE WHEN id % 6 <> 4 THEN {k.rpartition(' ')[0]} END {k.rpartition(' ')[2]}" for k in kinds[1:]))
    tables.write_jdbc(df, own, "kinds")
    found = tables.jdbc_table(spark, own, "kinds").toDF(*df.columns)
    assert found.dtypes == df.dtypes and sorted(found.collect(), key=lambda r: r.n) == sorted(df.collect(), key=lambda r: r.n)
    tables.write_jdbc(df.limit(3), own, "kinds", "ignore")
    tables.write_jdbc(df.limit(3), own, "kinds", "append")
    assert tables.jdbc_table(spark, own, "kinds").count() == 23
    with pytest.raises(Exception, match="already exists"):
        tables.write_jdbc(df, own, "kinds")
    tables.write_jdbc(df.where("n < 2"), own, "kinds", "overwrite")
    assert tables.jdbc_table(spark, own, "kinds").count() == 2
