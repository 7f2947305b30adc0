"""Helpers that the corpus operators share: tables, the shared folder, Arrow batches, word splitting."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks that separate words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session. Where that is unset it is an error, but for a session on one machine (tests):
    that gets a new temporary one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


_made: list[str] = []


def discard(spark: SparkSession) -> None:
    """Deletes all that ``written`` has written so far in this program: to be called once the results that came from it are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def spent(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes these tables, each one that ``written`` gave, once nothing reads them any more, and the shuffle files of all queries that are over: Spark keeps those until
    the driver collects its garbage, which it is asked to do here."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for file in [x for t in tables for x in t.inputFiles()[:1]]:
        for made in [x for x in _made if x.rpartition("/")[2] == file.split("/")[-2]]:
            _made.remove(made)
            path = jvm.org.apache.hadoop.fs.Path(made)
            path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: it cuts the lineage, is computed once, and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 modulo 4. A null id counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), fn)[0]


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 512) -> DataFrame:
    """``fn`` over slices of at most ``rows`` rows, so that a task's memory doesn't follow Arrow's batch size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                if (out := fn(batch.slice(at, rows))) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def split_words(text: str | None) -> list[bytes]:
    """Words of the whole text, A-Z in lower case (and no other letter changed); null gives none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's last steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words, equal in every process; remembers at most ``room`` words."""

    def __init__(self, room: int = 400_000):
        import xxhash

        self._of, self._known, self._room = xxhash.xxh3_64_intdigest, {}, room

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self._known) > self._room:
            self._known.clear()
        known, of = self._known, self._of
        get = known.get
        out = [get(w) for w in words]
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    w = words[i]
                    out[i] = known[w] = of(w)
        return np.array(out, dtype=np.uint64)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole sequence as one, if there are fewer; none of no words."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out
