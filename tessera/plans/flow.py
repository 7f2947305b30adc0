"""Datasets as a graph of named, versioned modules: resolved, run once, persisted by content, published."""

from __future__ import annotations

import argparse
import importlib
import inspect
import io
import json
import re
import time
import tokenize
import zlib
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.operators.profile import summary
from tessera.operators.quality import Quality
from tessera.sources.schema import TextSchema, read_csv, read_inline, schema_path
from tessera.sources.storage import Storage
from tessera.sources.tables import Connection, load_model, save_model, write_catalog_table, write_csv, write_jdbc


def _plain(source: str) -> str:
    """Source without comments and blank lines."""
    tokens = [t for t in tokenize.generate_tokens(io.StringIO(inspect.cleandoc(source)).readline) if t.type not in (tokenize.COMMENT, tokenize.NL)]
    return " ".join(t.string for t in tokens if t.string.strip())


class Module:
    """A dataset. Subclasses define ``requires`` and ``run``; results that aren't ephemeral are kept under the folder ``data`` by content version.

    ``persist`` is how: parquet, csv (with a text schema, written last) or json (with a JSON schema, written last)."""

    ephemeral = False
    persist = "parquet"
    history_size = 5
    config_keys: Sequence[str] = ()

    def __init__(self, app: App):
        self.app = app
        self.inputs: dict[type[Module], Module] = {}

    def requires(self) -> Sequence[type[Module]]:
        return ()

    def run(self, inputs: dict[type[Module], Any]) -> Any:
        raise NotImplementedError

    def quality(self) -> Quality | None:
        return None

    def metadata(self, df: Any) -> dict:
        return {}

    def validate_metadata(self, now: dict, history: list[dict]) -> str | None:
        return None

    def instance_hash(self) -> int:
        """What the result depends on besides code: files, tables."""
        return 0

    @classmethod
    def name(cls) -> str:
        return f"{cls.__module__}.{cls.__qualname__}"

    def own_hash(self) -> int:
        own = [c for c in type(self).__mro__ if issubclass(c, Module) and not c.__module__.startswith("tessera.plans.")]
        text = "".join(_plain(inspect.getsource(c)) for c in own) + json.dumps({k: self.app.config.get(k) for k in self.config_keys}, default=str)
        return (zlib.crc32(text.encode()) + self.instance_hash()) & 0x7FFFFFFF

    def hash(self) -> int:
        """Of this module and all it needs."""
        h = self.own_hash()
        for m in self.inputs.values():
            h = zlib.crc32(f"{h}:{m.hash()}".encode())
        return h & 0x7FFFFFFF

    @property
    def version(self) -> str:
        return f"{self.name()}_{self.hash():08x}"

    # persistence: the last file written marks success
    def path(self) -> str:
        return f"{self.app.config['data']}/output/{self.version}"

    def _mark(self) -> str:
        path = f"{self.path()}.{self.persist}"
        return {"parquet": f"{path}/_SUCCESS", "csv": f"{schema_path(path)}/_SUCCESS", "json": f"{path}.schema"}[self.persist]

    def persisted(self) -> bool:
        return not self.ephemeral and self.app.storage.exists(self._mark())

    def save(self, result: DataFrame) -> None:
        path = f"{self.path()}.{self.persist}"
        self.app.storage.delete(self._mark())
        if self.persist == "csv":
            write_csv(result, path)
        elif self.persist == "json":
            result.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
            self.app.storage.write(self._mark(), result.schema.json())
        else:
            result.write.mode("overwrite").parquet(path)

    def load(self) -> Any:
        path, spark = f"{self.path()}.{self.persist}", self.app.spark
        if self.persist == "csv":
            return read_csv(spark, path, TextSchema.parse("\n".join(r["value"] for r in spark.read.text(schema_path(path)).collect())))
        if self.persist == "json":
            return spark.read.schema(T.StructType.fromJson(json.loads(self.app.storage.read(self._mark())))).json(path)
        return spark.read.parquet(path)


class SqlModule(Module):
    """``tables`` names modules for the query's text."""

    def tables(self) -> dict[str, type[Module]]:
        return {}

    def query(self) -> str:
        raise NotImplementedError

    def requires(self) -> Sequence[type[Module]]:
        return list(self.tables().values())

    def run(self, inputs: dict[type[Module], Any]) -> DataFrame:
        for name, m in self.tables().items():
            inputs[m].createOrReplaceTempView(name)
        try:
            return self.app.spark.sql(self.query())
        finally:
            for name in self.tables():
                self.app.spark.catalog.dropTempView(name)


class ModelModule(Module):
    """The result is any object that can be pickled."""

    def persisted(self) -> bool:
        return self.app.storage.exists(self.path() + ".pickle")

    def save(self, result: Any) -> None:
        save_model(self.app.spark, result, self.path() + ".pickle")

    def load(self) -> Any:
        return load_model(self.app.spark, self.path() + ".pickle")


class ModelExecModule(Module):
    """Applies a model: ``execute`` takes the other inputs and the model's result."""

    def model(self) -> type[ModelModule]:
        raise NotImplementedError

    def data(self) -> Sequence[type[Module]]:
        return ()

    def execute(self, inputs: dict[type[Module], Any], model: Any) -> DataFrame:
        raise NotImplementedError

    def requires(self) -> Sequence[type[Module]]:
        return [self.model(), *self.data()]

    def run(self, inputs: dict[type[Module], Any]) -> DataFrame:
        return self.execute({k: v for k, v in inputs.items() if k is not self.model()}, inputs[self.model()])


def link(module: type[Module]) -> type[Module]:
    """A module of another application as an input: the module itself."""
    return module


class InlineData(Module):
    """Rows written in the code."""

    ephemeral = True
    schema = ""
    data: str | None = ""

    def run(self, inputs: dict[type[Module], Any]) -> DataFrame:
        return read_inline(self.app.spark, self.schema, self.data)

    def instance_hash(self) -> int:
        return zlib.crc32((self.schema + (self.data or "")).encode())


@contextmanager
def lock(storage: Storage, path: str, wait: float = 10.0, limit: float = 3600.0):
    """Holds a lock file, created exclusively."""
    until = time.monotonic() + limit
    while not storage.create(path):
        if time.monotonic() > until:
            raise TimeoutError(path)
        time.sleep(wait)
    try:
        yield
    finally:
        storage.delete(path)


def layered(*layers: dict[str, Any]) -> dict[str, Any]:
    """Settings, later layers over earlier ones."""
    return {k: v for layer in layers for k, v in layer.items() if v is not None}


def properties(text: str) -> dict[str, str]:
    """``key = value`` lines; ``#`` and ``!`` begin comments, a backslash at a line's end joins the next."""
    lines = re.sub(r"\\\n\s*", "", text).splitlines()
    pairs = (re.split(r"\s*[=:]\s*", x.strip(), maxsplit=1) for x in lines if x.strip() and x.strip()[0] not in "#!")
    return {p[0]: p[1] if len(p) > 1 else "" for p in pairs}


def load_config(storage: Storage, files: Sequence[str] = (), command: dict[str, Any] | None = None, defaults: dict[str, Any] | None = None) -> dict[str, Any]:
    """Defaults, then property files in order (application, runtime, connections, home, user; missing ones are skipped), then the command line."""
    return layered(defaults or {}, *(properties(storage.read(f)) for f in files if storage.exists(f)), command or {})


def connections(config: dict[str, Any], prefix: str = "con.") -> dict[str, Connection]:
    """Connections from settings ``con.<name>.type`` and ``con.<name>.<setting>``."""
    out: dict[str, dict[str, str]] = {}
    for k, v in config.items():
        if k.startswith(prefix) and k.count(".") >= 2:
            name, setting = k.removeprefix(prefix).split(".", 1)
            out.setdefault(name, {})[setting] = v
    return {n: Connection(n, s.get("type", "files"), {k: v for k, v in s.items() if k != "type"}) for n, s in out.items()}


class App:
    """Runs modules. ``config``: data (a folder), lock (bool), edd (bool), publish (a folder), and any others."""

    def __init__(self, spark: SparkSession, config: dict[str, Any], modules: Sequence[type[Module]] = ()):
        self.spark, self.config, self.known = spark, config, {m.name(): m for m in modules}
        self.storage = Storage(spark)
        self._loaded: dict[type[Module], Module] = {}
        self._results: dict[str, Any] = {}
        self.run_info: dict[str, dict] = {}

    def find(self, name: str) -> type[Module]:
        """By full name or the end of one."""
        hits = [n for n in self.known if n == name or n.endswith("." + name)]
        if len(hits) != 1:
            raise KeyError(f"{name}: {'ambiguous: ' + ', '.join(hits) if hits else 'no such module'}")
        return self.known[hits[0]]

    def resolve(self, cls: type[Module], path: tuple[type[Module], ...] = ()) -> Module:
        if cls in path:
            raise ValueError("Cycle found: " + " -> ".join(c.name() for c in (*path, cls)))
        if cls not in self._loaded:
            m = cls(self)
            m.inputs = {r: self.resolve(r, (*path, cls)) for r in m.requires()}
            self._loaded[cls] = m
            self.known.setdefault(cls.name(), cls)
        return self._loaded[cls]

    def order(self, *roots: Module, prune: bool = False) -> list[Module]:
        """Modules before those that need them; with ``prune`` nothing above a persisted one."""
        out: list[Module] = []

        def visit(m: Module) -> None:
            if m in out:
                return
            if not (prune and m.persisted()):
                for i in m.inputs.values():
                    visit(i)
            out.append(m)

        for r in roots:
            visit(r)
        return out

    def run(self, cls: type[Module] | str, force: bool = False, quick: bool = False) -> Any:
        """The result. ``quick``: nothing is persisted or validated; ``force``: persisted results are made again."""
        root = self.resolve(self.find(cls) if isinstance(cls, str) else cls)
        for m in self.order(root, prune=not force):
            self._compute(m, force, quick)
        return self._results[root.version]

    def _compute(self, m: Module, force: bool, quick: bool) -> None:
        if m.version in self._results and not force:
            return
        if m.persisted() and not force:
            self._results[m.version] = m.load()
            return
        self.spark.sparkContext.setJobDescription(m.name())
        began = time.time()
        result = m.run({c: self._results[i.version] for c, i in m.inputs.items()})
        seen, q = None, m.quality()
        if q and isinstance(result, DataFrame):
            result, seen = q.attach(result)
        if not quick:
            if not m.ephemeral:
                if self.config.get("lock"):
                    with lock(self.storage, m.path() + ".lock"):
                        if force or not m.persisted():
                            m.save(result)
                else:
                    m.save(result)
                result = m.load()
            elif seen is not None:
                result = result.cache()
                result.count()  # an ephemeral result has no action of its own before it is judged
            self._record(m, result, q.validate(seen, fail=False) if q and seen is not None else {}, time.time() - began)
        self._results[m.version] = result
        self.spark.sparkContext.setJobDescription(None)

    def _record(self, m: Module, result: Any, quality: dict, seconds: float) -> None:
        info = {"name": m.name(), "version": m.version, "at": time.time(), "seconds": round(seconds, 3), "dqm": quality, "user": m.metadata(result)}
        if isinstance(result, DataFrame):
            info["columns"] = [{"name": f.name, "type": f.dataType.simpleString(), "metadata": dict(f.metadata)} for f in result.schema]
            if self.config.get("edd"):
                info["edd"] = [r.asDict() for r in summary(result).collect()]
        history = self.history(type(m))
        message = m.validate_metadata(info, history)
        self.run_info[m.name()] = info
        if not m.ephemeral:
            self.storage.write(self._history(type(m)), json.dumps([info, *history][: m.history_size], default=str))
        if quality and not quality["passed"] or message:
            raise ValueError(f"{m.name()}: {message or json.dumps(quality)}")

    def _history(self, cls: type[Module]) -> str:
        return f"{self.config['data']}/history/{cls.name()}.json"

    def history(self, cls: type[Module]) -> list[dict]:
        at = self._history(cls)
        return json.loads(self.storage.read(at)) if self.storage.exists(at) else []

    def purge(self) -> list[str]:
        """Removes persisted results of other versions than the known modules' own; their names."""
        keep = {self.resolve(c).version + end for c in self.known.values() for end in (".parquet", ".pickle", ".csv", ".json", ".schema", ".json.schema")}
        return self.storage.purge(f"{self.config['data']}/output", keep)

    # publishing
    def publish(self, cls: type[Module] | str, version: str) -> str:
        m = self.resolve(self.find(cls) if isinstance(cls, str) else cls)
        path = f"{self.config['publish']}/{version}/{m.name()}"
        write_csv(self.run(type(m)), path + ".csv")
        self.storage.write(path + ".meta", json.dumps(self.run_info.get(m.name(), {}), default=str))
        self.storage.write(path + ".hist", json.dumps(self.history(type(m)), default=str))
        return path + ".csv"

    def publish_jdbc(self, cls: type[Module] | str, connection: Connection, table: str | None = None) -> None:
        """Appends to a table, by default of the module's name."""
        m = self.resolve(self.find(cls) if isinstance(cls, str) else cls)
        write_jdbc(self.run(type(m)), connection, table or type(m).__name__, "append")

    def publish_table(self, cls: type[Module], table: str, sql: str | None = None) -> None:
        """As a catalog table, or by statements parted by ``;`` over the view ``dftable``."""
        df = self.run(cls)
        if not sql:
            write_catalog_table(df, table)
            return
        df.createOrReplaceTempView("dftable")
        for statement in filter(str.strip, sql.split(";")):
            self.spark.sql(statement)

    # introspection
    def descendants(self, cls: type[Module]) -> list[type[Module]]:
        return [c for c in list(self.known.values()) if c is not cls and self.resolve(cls) in self.order(self.resolve(c))]

    def ancestors(self, cls: type[Module]) -> list[type[Module]]:
        return [type(m) for m in self.order(self.resolve(cls)) if type(m) is not cls]

    def dead(self, outputs: Sequence[type[Module]]) -> list[type[Module]]:
        """Known modules that no output needs."""
        used = {type(m) for o in outputs for m in self.order(self.resolve(o))}
        return [c for c in list(self.known.values()) if c not in used]

    def graph(self, kind: str = "json") -> str:
        all_ = self.order(*(self.resolve(c) for c in list(self.known.values())))
        edges = [(i.name(), m.name()) for m in all_ for i in m.inputs.values()]
        if kind == "dot":
            return "digraph {\n" + "".join(f'  "{m.name()}";\n' for m in all_) + "".join(f'  "{a}" -> "{b}";\n' for a, b in edges) + "}"
        return json.dumps({"nodes": [m.name() for m in all_], "edges": edges})


class Registry:
    """Classes by a dotted kind; asking for a kind finds its subkinds too."""

    def __init__(self) -> None:
        self._of: dict[str, type] = {}

    def register(self, kind: str) -> Callable[[type], type]:
        def add(cls: type) -> type:
            self._of[kind] = cls
            return cls

        return add

    def of(self, kind: str) -> dict[str, type]:
        return {k: c for k, c in self._of.items() if k == kind or k.startswith(kind + ".")}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """``python -m tessera.plans.flow --code pkg.modules -m Name``"""
    p = argparse.ArgumentParser(description="Run modules of a data application")
    p.add_argument("--code", required=True, help="the Python module that defines the modules")
    p.add_argument("-m", "--run", nargs="*", default=[], help="modules to run")
    p.add_argument("--run-app", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--dead", action="store_true")
    p.add_argument("--graph", choices=("json", "dot"))
    p.add_argument("--force-run-all", action="store_true")
    p.add_argument("--publish", metavar="VERSION")
    p.add_argument("--publish-table", action="store_true")
    p.add_argument("--publish-jdbc", metavar="CONNECTION", help="a connection of the settings, con.<name>.url and others")
    p.add_argument("--config", nargs="*", default=[], metavar="FILE", help="property files, later ones over earlier ones")
    p.add_argument("-s", "--stage", nargs="*", default=[], help="run all modules whose package or class is of this name")
    p.add_argument("--export-csv", metavar="FILE")
    p.add_argument("--purge", action="store_true")
    p.add_argument("--data", default="data")
    p.add_argument("--set", nargs="*", default=[], metavar="KEY=VALUE")
    a = p.parse_args(argv)
    code = importlib.import_module(a.code)
    own = [c for c in vars(code).values() if inspect.isclass(c) and issubclass(c, Module) and c.__module__ == code.__name__]
    spark = spark or SparkSession.builder.getOrCreate()
    config = load_config(Storage(spark), a.config, dict(x.split("=", 1) for x in a.set), {"data": a.data, "publish": f"{a.data}/publish", **getattr(code, "CONFIG", {})})
    app = App(spark, config, own)
    chosen = own if a.run_app else [app.find(n) for n in a.run] + [c for c in own if any(c.name().startswith(s + ".") for s in a.stage)]
    if a.graph:
        print(app.graph(a.graph))
    if a.dead:
        print("\n".join(c.name() for c in app.dead(chosen)))
    if a.dry_run:
        print("\n".join(m.name() for m in app.order(*(app.resolve(c) for c in chosen), prune=True) if not m.persisted()))
        return 0
    if a.purge:
        app.purge()
    for c in chosen:
        result = app.run(c, force=a.force_run_all)
        if a.publish:
            app.publish(c, a.publish)
        if a.publish_table:
            app.publish_table(c, c.__name__)
        if a.publish_jdbc:
            app.publish_jdbc(c, connections(config)[a.publish_jdbc])
        if a.export_csv:
            from tessera.sources.schema import export_csv

            export_csv(result, a.export_csv)
    return 0


def schema_of(df: DataFrame) -> str:
    return "; ".join(TextSchema.of(df).lines())


if __name__ == "__main__":
    raise SystemExit(main())
