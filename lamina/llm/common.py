"""Shared plumbing of the training-data operators: inputs, lineage cuts, checked broadcasts, ranks."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Records in an Arrow batch sent to a Python worker; texts can be long, so batches stay small.
ARROW_ROWS = 256
#: Bytes of values (see row_bytes) that may be broadcast; beyond it a join shuffles.
BROADCAST_BYTES = 16 << 20
#: Parts into which the rows of a key are dealt in a join by shuffle whose keys may be hot.
SALTS = 32
#: Rows of a key from which on it is hot, and hot keys at most.
HOT_ROWS, HOT_KEYS = 200, 100_000

#: ASCII white space as the operators that compare words or characters see it.
BLANKS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """At most ARROW_ROWS texts at once for a Python worker.

    Plans read the setting when they run, after an operator has returned; so it stays set in the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a session on one machine may go without naming one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lamina-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder that cut lineage; they outlive the loss of any executor.

    Tables go when they are dropped, the rest when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/lamina-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        try:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        except Exception:  # the driver's JVM may have ended before
            pass

    def keep(self, df: DataFrame, free: bool = False) -> DataFrame:
        """Write df and read it back. free: what was shuffled for it goes at once, not when the driver next collects garbage."""
        self.n += 1
        path = f"{self.root}/t{self.n}"
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        was = self.spark.conf.get(key, "false")
        try:
            if free:
                self.spark.conf.set(key, "true")
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(key, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lamina_path = path
        return out

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            self._remove(df._lamina_path)


def _reads_files(docs: DataFrame) -> bool:
    """Whether every row of docs is one row of a file, so that file and place tell rows apart."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def settled(docs: DataFrame) -> DataFrame:
    """docs, written first if its rows don't come straight from files: a task that runs again must see the same rows."""
    return docs if _reads_files(docs) else Scratch(docs.sparkSession).keep(docs)


def row_of(docs: DataFrame) -> Column:
    """What tells rows of a settled table apart, repeated ones too: file and place in it, whatever the splits."""
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a settled table whose row_of isn't in gone's column row; texts are only shuffled if many rows go."""
    name = "__row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    gone = Scratch(docs.sparkSession).keep(gone.select(F.col("row").alias(name)))
    return docs.withColumn(name, row_of(docs)).join(bounded(gone), name, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def _bytes_of(c: Column, t: T.DataType) -> Column | int:
    if isinstance(t, (T.StringType, T.BinaryType, T.VarcharType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(t, T.ArrayType):
        each = _bytes_of(F.lit(None), t.elementType)
        if isinstance(each, int):
            return F.coalesce(F.size(c), F.lit(0)).cast("long") * each + 24
        none = F.lit(24).cast("long")
        return F.coalesce(F.aggregate(c, none, lambda a, x: a + _bytes_of(x, t.elementType)), none)
    if isinstance(t, T.StructType):
        out: Column | int = 16
        for f in t:
            out = out + _bytes_of(c[f.name], f.dataType)
        return out
    return 8


def row_bytes(df: DataFrame) -> Column | int:
    """About as many bytes as a row takes in Spark's row format; a number where all columns are of fixed size."""
    out: Column | int = 24
    for f in df.schema:
        out = out + _bytes_of(F.col(f"`{f.name}`"), f.dataType)
    return out


def small(written: DataFrame, limit: int | None = None) -> bool:
    """Whether a written table has limit bytes at most: counted where it lies, by one sum."""
    limit = BROADCAST_BYTES if limit is None else limit
    size = row_bytes(written)
    if isinstance(size, int):
        return written.count() * size <= limit
    return (written.agg(F.sum(size)).first()[0] or 0) <= limit


def bounded(written: DataFrame, limit: int | None = None) -> DataFrame:
    """A written table with a broadcast hint if it is small, else as it is."""
    return F.broadcast(written) if small(written, limit) else written


def meet(df: DataFrame, written: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """df, which has a column row, joined with a written table by a key of which df may have any number of rows.

    By broadcast if the table is small; else by shuffle, where df's rows of a key are dealt over SALTS tasks and
    the table's go to each of them.
    """
    if small(written, limit):
        return df.join(F.broadcast(written), key)
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    copies = written.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [key, "__salt"]).drop("__salt")


def meet_counted(df: DataFrame, written: DataFrame, keys: list[str], total: int, count: str = "n", how: str = "inner", limit: int | None = None, hot: int | None = None) -> DataFrame:
    """df, of about total rows, joined with a written table by unique keys; its column count says how many rows of df have them.

    A small table is broadcast. Of a large one, keys of more than hot rows are: at most HOT_KEYS of them, as hot is a
    share of the total. The others go by shuffle, where no key then fills a task. count isn't in the result.
    """
    if small(written, limit):
        return df.join(F.broadcast(written.drop(count)), keys, how)
    hot = max(HOT_ROWS, total // HOT_KEYS) if hot is None else hot
    few = written.where(F.col(count) > hot).drop(count)
    rest = written.where(F.col(count) <= hot).drop(count)
    if few.isEmpty():
        return df.join(rest, keys, how)
    others = df if how == "inner" else df.join(F.broadcast(few.select(*keys)), keys, "left_anti")
    return others.join(rest, keys, how).unionByName(df.join(F.broadcast(few), keys))


def pieces(rows: int, each: int = 250_000) -> int:
    """Buckets for per-bucket windows over so many rows: they grow with the data, a bucket doesn't."""
    return max(64, math.ceil(rows / each))


def dense_index(df: DataFrame, scratch: Scratch, keys: list[str], by: str, order: list[Column], name: str, n: int) -> DataFrame:
    """A gapless number from 0 within keys, ordered by bucket and then order, without a task per key.

    by: an integer column that deals the rows of a key into n buckets. Counts per bucket are summed up
    first, so the window only ever sorts one bucket of one key. df is read twice: it should be a written table.
    """
    from pyspark.sql import Window as W

    bucket = F.pmod(F.col(by), F.lit(n)).cast("int")
    d = df.withColumn("__b", bucket)
    sums = d.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    ranked = d.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "__b").orderBy(*order)) - 1)
    out = ranked.join(bounded(scratch.keep(starts)), [*keys, "__b"])
    return out.withColumn(name, (F.col("__r") + F.col("__at")).cast("long")).drop("__b", "__r", "__at")


#: What the operator that runs last in a Python worker keeps there between tasks; that of the one before goes.
_held: tuple[Any, Any] | None = None


def held(key: Any, make: Callable[[], Any]) -> Any:
    """In a Python worker: what make() gave for key, as long as no other operator's tasks ran here meanwhile.

    Workers serve one operator after another, and what each of them keeps must not add up.
    """
    global _held
    if _held is None or _held[0] != key:
        if _held is not None:
            _held = None
            give_back()
        _held = key, make()
    return _held[1]


def give_back() -> None:
    """In a Python worker: return freed memory to the system, as idle workers live on beside others."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass
