"""Stripe tables: immutable Parquet stripes under a versioned manifest, with deletes merged on read."""

from __future__ import annotations

import datetime as dt
import io
import re
import uuid
import warnings
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

import pyarrow.parquet as pq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CommitConflict, DuplicateKey, MultipleMatches, NotAStripeTable, StripeError
from ..bounds import decoded, encode_bounds, footer_stats
from ..manifest import Deletes, Log, Manifest, Stripe
from ..plans.pruning import Conjunct, ScanReport, conjuncts_of, prune
from ..storage import Store
from ..types import schema_of

CODECS = {"none": "uncompressed", "lz4": "lz4_raw", "zstd": "zstd"}
#: Bytes of a scan's deleted rows that are broadcast at most, a row taken as DELETE_BYTES and its file's name; beyond it the
#: anti join shuffles.
BROADCAST_DELETES, DELETE_BYTES = 32 << 20, 48
#: Bytes of a Parquet file's end that are read first for its footer.
FOOTER_BYTES = 1 << 16
#: An ordered insert of more stripes than ALONE has them share files, as row groups: FILE_STRIPES of them, FILE_ROWS rows at most.
ALONE, FILE_STRIPES, FILE_ROWS = 1000, 1000, 1_000_000
#: Attempts of DELETE, UPDATE and compact when a rival changes the stripes that they touch.
ATTEMPTS = 5

_FILE, _ROW, _START = "__file", "__row", "__start"
_DELETES = T.StructType([T.StructField(_FILE, T.StringType()), T.StructField(_ROW, T.LongType())])
#: A row's place with the first row of its stripe in the file; null in vectors from before stripes shared files.
_PLACE = T.StructType(_DELETES.fields + [T.StructField(_START, T.LongType())])


#: Marks a folder of stripes or deleted rows whose commit was made, and lists stripes that left the table: what a rebuild goes by.
_DONE, _LEFT = "_committed", "_left"


class StripeTable:
    """cache_mb: bytes of stripes (as their files have them) whose rows scans keep in memory; 0 keeps none.

    single_writer: the word that no other writer is at work, which stores without atomic renames need.
    """

    def __init__(self, spark: SparkSession, path: str, cache_mb: int = 0, single_writer: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, self.path, single_writer)
        self.counters = {f"{c}_{n}": 0 for c in ("metadata", "stats", "bitmap", "ipc") for n in ("hits", "misses")} | {"ipc_bytes_cached": 0}
        self.log = Log(self.store, self.counters)
        self.cache_bytes = cache_mb << 20
        self._held: OrderedDict[tuple, tuple[DataFrame, DataFrame, int]] = OrderedDict()  # what a scan gives, of it what is kept, its bytes
        self._vectors: dict[tuple[str, ...], DataFrame] = {}

    # -- life cycle ----------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema, codec: str = "zstd", rows_per_stripe: int = 10_000, **how) -> StripeTable:
        """An empty table. schema: a StructType or {column: SQL type}; types are checked here."""
        t = cls(spark, path, **how)
        if codec not in CODECS:
            raise StripeError(f"codec {codec!r} is not one of {', '.join(CODECS)}")
        first = Manifest(1, schema_of(schema), options={"codec": codec, "rows_per_stripe": rows_per_stripe})
        if t.log.versions() or not t.log.publish(first):
            raise StripeError(f"{path} is a stripe table already")
        return t

    @classmethod
    def open(cls, spark: SparkSession, path: str, **how) -> StripeTable:
        t = cls(spark, path, **how)
        t.log.load()
        return t

    def drop(self) -> None:
        self.uncache()
        self.store.delete()
        self.log.cached.clear()
        self.log.parts.clear()

    @property
    def schema(self) -> T.StructType:
        return self.log.load().schema

    @property
    def version(self) -> int:
        return self.log.load().version

    # -- writing -------------------------------------------------------------------------------------------

    def _conformed(self, df: DataFrame, schema: T.StructType) -> DataFrame:
        """By name, missing columns as null, extra ones refused, types cast as an assignment would."""
        extra = {c.lower() for c in df.columns} - {f.name.lower() for f in schema}
        if extra:
            raise StripeError(f"columns not in the table: {', '.join(sorted(extra))}")
        have = {c.lower() for c in df.columns}
        return df.select(*[(F.col(f"`{f.name}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def _put(self, df: DataFrame, folder: str, **options) -> None:
        key = "spark.sql.parquet.outputTimestampType"
        was = self.spark.conf.get(key)
        self.spark.conf.set(key, "TIMESTAMP_MICROS")  # the other form has no bounds
        try:
            df.write.options(**options).parquet(self.store.path(folder))
        finally:
            self.spark.conf.set(key, was)

    def _write(self, df: DataFrame, m: Manifest, codec: str, rows: int, share: int = 0) -> list[Stripe]:
        """Stripes of df's rows, written but in no manifest yet; ids are given on commit. Folders sort as they were written.

        share: rows of a file in which stripes are row groups; the folder's name then ends with their rows.
        """
        folder = f"stripes/{m.next_id:012d}-{uuid.uuid4().hex}" + (f"-{rows}" if share else "")
        groups = {"parquet.block.row.count.limit": rows} if share else {}
        self._put(df, folder, maxRecordsPerFile=share or rows, compression=CODECS[codec], **groups)
        try:
            return self._measured(folder, m, codec)
        except _Uneven:
            self.store.delete(folder)
            raise

    def _write_ordered(self, df: DataFrame, m: Manifest, codec: str, rows: int) -> list[Stripe]:
        """Stripes of exactly so many rows in df's order. df is evaluated once and staged; its rows are numbered by the
        counts of the staged files and dealt to tasks by whole stripes."""
        staged = f"staged/{uuid.uuid4().hex}"
        try:
            self._put(df, staged)
            read = self.spark.read.schema(m.schema).parquet(self.store.path(staged))
            names = [F.col(f"`{f.name}`") for f in m.schema]
            counts = read.select(F.col("_metadata.file_name").alias(_FILE)).groupBy(_FILE).count()
            starts, total = [], 0
            for r in sorted(counts.toLocalIterator(), key=lambda r: _in_order(r[_FILE])):  # a row per task of df
                starts.append((r[_FILE], total))
                total += r["count"]
            if not total:
                return []
            place = self.spark.createDataFrame(starts, T.StructType([_PLACE[_FILE], _PLACE[_START]]))
            numbered = read.select(*names, F.col("_metadata.file_name").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))
            numbered = numbered.join(F.broadcast(place), _FILE).withColumn(_ROW, F.col(_ROW) + F.col(_START))
            stripes = -(-total // rows)

            def dealt(n: int) -> DataFrame:
                """n rows in order in each task."""
                tasks = -(-total // n)
                return numbered.repartitionById(tasks, F.expr(f"CAST({_ROW} DIV {n} AS INT)")).sortWithinPartitions(_ROW).select(*names)

            share = rows * min(FILE_STRIPES, FILE_ROWS // rows)
            if stripes > ALONE and share > rows:
                try:
                    return self._write(dealt(share), m, codec, rows, share)
                except _Uneven:  # rows so wide that row groups ended before their count
                    pass
            return self._write(dealt(rows * -(-stripes // self.spark.sparkContext.defaultParallelism)), m, codec, rows)
        finally:
            self.store.delete(staged)

    def _footer(self, name: str, size: int):
        data = self.store.tail(name, size, FOOTER_BYTES)
        need = int.from_bytes(data[-8:-4], "little") + 8
        return pq.read_metadata(io.BytesIO(data if need <= len(data) else self.store.tail(name, size, need)))

    def _files(self, folder: str) -> list[tuple[str, int]]:
        return sorted(((n, size) for n, size in self.store.names(folder) if n.endswith(".parquet")), key=lambda f: _in_order(f[0]))

    def _measured(self, folder: str, m: Manifest, codec: str | None) -> list[Stripe]:
        """Row counts and column bounds of all stripes in a folder: from its footers, and of columns whose bounds a footer
        lacks by reading these columns. Without a codec it is read too."""
        files, each = self._files(folder), _rows_of(folder)
        names = {v.removesuffix("_raw").replace("uncompressed", "none"): k for k, v in CODECS.items()}

        def stripes_of(file: tuple[str, int]) -> list[Stripe]:
            n, size = file
            footer = self._footer(f"{folder}/{n}", size)
            if not footer.num_rows:
                return []
            own = codec or names.get(footer.row_group(0).column(0).compression.lower().removesuffix("_raw").replace("uncompressed", "none"), "none")
            if not each:
                return [Stripe(0, f"{folder}/{n}", footer.num_rows, size, own, 0, footer_stats(footer, m.kinds))]
            out = []
            for i in range(footer.num_row_groups):
                g = footer.row_group(i)
                if g.num_rows != min(each, footer.num_rows - i * each):
                    raise _Uneven
                own_size = sum(g.column(c).total_compressed_size for c in range(g.num_columns))
                out.append(Stripe(0, f"{folder}/{n}", g.num_rows, own_size, own, 0, footer_stats(footer, m.kinds, [g]), i * each, each, footer.num_rows))
            return out

        with ThreadPoolExecutor(8) as pool:
            found = [s for of_file in pool.map(stripes_of, files) for s in of_file]
        stats = {s.key: s.stats for s in found}
        counts = {s.key: s.rows for s in found}
        lacking = {c: k for c, k in m.kinds.items() if any(c not in s for s in stats.values())}
        if lacking:
            aggs = []
            for i, c in enumerate(lacking):
                col = F.col(f"`{c}`")
                aggs += [F.min(col).alias(f"a{i}"), F.max(col).alias(f"b{i}"), F.count(col).alias(f"c{i}")]
            row = F.col("_metadata.row_index")
            start = (row - row % each if each else F.lit(0)).alias(_START)
            read = self.spark.read.schema(m.schema).parquet(self.store.path(folder)).select(*[f"`{c}`" for c in lacking], F.col("_metadata.file_name").alias(_FILE), start)
            for r in read.groupBy(_FILE, _START).agg(*aggs).toLocalIterator():  # a row per stripe that was written just now
                key = r[_FILE], r[_START]
                for i, (c, k) in enumerate(lacking.items()):
                    low, high = r[f"a{i}"], r[f"b{i}"]
                    if k == "timestamptz" and low is not None:
                        low, high = (x.astimezone(dt.timezone.utc) for x in (low, high))
                    a, b, nan = encode_bounds(k, low, high)
                    stats[key][c] = [a, b, counts[key] - r[f"c{i}"], nan]
        return found

    def _commit(self, change: Callable[[Manifest], Manifest], new: list[Stripe] = (), vector: str | None = None, left: list[Stripe] = ()) -> Manifest:
        """Commit; mark what it brings, and list what leaves, for a rebuild. Nothing is marked if there is no commit."""
        marks = [f"{f}/{_DONE}" for f in {s.file.rpartition("/")[0] for s in new} | ({vector} if vector else set())]
        if left:
            marks.append(f"{_LEFT}/{uuid.uuid4().hex}")
            self.store.mkdirs(_LEFT)
        for x in marks:
            self.store.write(x, "\n".join(s.place for s in left) if x.startswith(f"{_LEFT}/") else "")
        try:
            return self.log.commit(change)
        except BaseException:
            for x in marks:
                self.store.delete(x)
            raise

    def _discard(self, new: list[Stripe]) -> None:
        for folder in {s.file.rpartition("/")[0] for s in new}:
            self.store.delete(folder)

    def insert(self, df: DataFrame, codec: str | None = None, rows_per_stripe: int | None = None, cluster_by: list[str | Column] | None = None, ordered: bool = False, unique: list[str] | None = None) -> Manifest:
        """Append df's rows as new stripes in one commit.

        ordered: stripes of exactly rows_per_stripe rows in df's order, more than ALONE of them in shared files. cluster_by: rows sorted by range
        of these columns or expressions, so that pruning on them works. unique: columns whose values must be new and distinct; it is
        checked against the very version that the commit follows, so that of writers that race one gets DuplicateKey.
        """
        m = self.log.load()
        df = self._conformed(df, m.schema)
        if cluster_by:
            df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
        new = (self._write_ordered if ordered and not cluster_by else self._write)(df, m, codec or m.options["codec"], rows_per_stripe or m.options["rows_per_stripe"])

        def change(last: Manifest) -> Manifest:
            if unique and new:
                self._check_new(unique, new, last)
            return self.log.added(last, new)

        try:
            return self._commit(change, new)
        except DuplicateKey:
            self._discard(new)
            raise

    def _check_new(self, keys: list[str], new: list[Stripe], m: Manifest) -> None:
        """DuplicateKey if written rows clash among themselves or with live rows of m: only stripes whose bounds meet theirs are read."""
        rows = self.spark.read.schema(m.schema).parquet(*dict.fromkeys(self.store.path(s.file) for s in new)).select(*keys).na.drop(subset=keys)
        twice = rows.groupBy(*keys).count().where("count > 1").limit(1).collect()
        if twice:
            raise DuplicateKey(f"{dict(zip(keys, twice[0][: len(keys)]))} occurs {twice[0][-1]} times")
        conjuncts = []
        for c in (c for c in keys if c in m.kinds):
            each = [s.stats.get(c) for s in new]
            if all(s is not None and s[0] is not None and s[1] is not None and not s[3] for s in each):
                lows, highs = ([decoded(m.kinds[c], s[i]) for s in each] for i in (0, 1))
                order = str.encode if m.kinds[c] == "string" else None
                conjuncts += [Conjunct(c, ">=", min(lows, key=order)), Conjunct(c, "<=", max(highs, key=order))]
        met, _ = prune(m, conjuncts)
        if met:
            clash = self._rows(m, met).select(*keys).join(rows, keys, "left_semi").limit(1).collect()
            if clash:
                raise DuplicateKey(f"{dict(zip(keys, clash[0]))} is in the table")

    def insert_csv(self, path: str, header: bool = False, **options) -> Manifest:
        """COPY ... FROM a CSV file with the table's columns in order."""
        read = self.spark.read.schema(self.schema).options(header=header, mode="FAILFAST", **options)
        return self.insert(read.csv(path))

    def upsert(self, df: DataFrame, keys: list[str]) -> int:
        """Insert the rows whose keys the table doesn't hold, of several with the same keys one; those it holds stay as they
        are, and a key with a null is never held. Returns the number of rows inserted; starts again if a rival commits."""
        df = self._conformed(df, self.schema)
        null = F.lit(False)
        for k in keys:
            null = null | F.col(f"`{k}`").isNull()

        def once(m: Manifest) -> int:
            fresh = df.where(~null).dropDuplicates(keys)
            stripes = [s for s in m.stripes if s.rows > s.deleted]
            if stripes:
                fresh = fresh.join(self._rows(m, stripes).select(*keys), keys, "left_anti")
            fresh = fresh.select(*[f"`{f.name}`" for f in m.schema]).unionByName(df.where(null))
            new = self._write(fresh, m, m.options["codec"], m.options["rows_per_stripe"])

            def change(last: Manifest) -> Manifest:
                if last.version != m.version:
                    raise _Touched
                return self.log.added(last, new)

            if not new:
                return 0
            try:
                self._commit(change, new)
            except _Touched:
                self._discard(new)
                raise
            return sum(s.rows for s in new)

        return self._attempt(once)

    def check_unique(self, keys: list[str]) -> None:
        """DuplicateKey if several live rows have the same keys; keys with a null never clash."""
        twice = self.scan().select(*keys).na.drop(subset=keys).groupBy(*keys).count().where("count > 1").limit(1).collect()
        if twice:
            raise DuplicateKey(f"{dict(zip(keys, twice[0][: len(keys)]))} occurs {twice[0][-1]} times")

    # -- scanning ------------------------------------------------------------------------------------------

    def _deleted(self, m: Manifest, stripes: list[Stripe]) -> DataFrame:
        """Rows (file, row) that delete vectors hold for the stripes, and maybe for others."""
        wanted = {s.id for s in stripes}
        folders = tuple(d.folder for d in m.deletes if wanted.intersection(d.ids))
        if folders in self._vectors:
            self.counters["bitmap_hits"] += 1
        else:
            self.counters["bitmap_misses"] += 1
            read = self.spark.read.schema(_DELETES).parquet(*[self.store.path(f) for f in folders])
            self._vectors[folders] = read if len(folders) == 1 else read.distinct()
        return self._vectors[folders]

    def _rows(self, m: Manifest, stripes: list[Stripe], located: bool = False) -> DataFrame:
        """Live rows of stripes; located: with their file, place in it and the first place of their stripe."""
        schema = m.schema
        names = [F.col(f"`{f.name}`") for f in schema]
        row = F.col("_metadata.row_index")

        def read(some: list[Stripe], at: bool) -> list[DataFrame]:
            """Their rows; at: with their places. Of files of which some stripes aren't wanted, rows are picked by stripe."""
            wanted: dict[str, int] = {}
            for s in some:
                wanted[s.file] = wanted.get(s.file, 0) + s.rows
            out = []
            for each in sorted({s.each for s in some}):
                place = [F.col("_metadata.file_name").alias(_FILE), row.alias(_ROW), (row - row % each if each else F.lit(0).cast("long")).alias(_START)]
                for partly in (False, True):
                    own = [s for s in some if s.each == each and partly == (each > 0 and wanted[s.file] < s.held)]
                    if not own:
                        continue
                    df = self.spark.read.schema(schema).parquet(*dict.fromkeys(self.store.path(s.file) for s in own))
                    df = df.select(*names, *(place if at or partly else []))
                    if partly:
                        picked = self.spark.createDataFrame([s.key for s in own], T.StructType([_PLACE[_FILE], _PLACE[_START]]))
                        few = len(own) * (DELETE_BYTES + len(own[0].name)) <= BROADCAST_DELETES
                        df = df.join(F.broadcast(picked) if few else picked.hint("merge"), [_FILE, _START], "left_semi")
                    out.append(df.select(*names, *([_FILE, _ROW, _START] if at else [])))
            return out

        dirty_files = {s.file for s in stripes if s.deleted}  # each file is read once
        clean, dirty = [s for s in stripes if s.file not in dirty_files], [s for s in stripes if s.file in dirty_files]
        parts = read(clean, located)
        if dirty:
            gone = self._deleted(m, dirty)
            touched = {i for d in m.deletes if {s.id for s in dirty}.intersection(d.ids) for i in d.ids}
            small = sum(m.dirty.get(i, 0) for i in touched) * (DELETE_BYTES + max(len(s.name) for s in dirty)) <= BROADCAST_DELETES
            # without a hint Spark goes by the bytes of files, in which names that repeat take next to nothing
            gone = F.broadcast(gone) if small else gone.hint("merge")
            for df in read(dirty, True):
                live = df.join(gone, [_FILE, _ROW], "left_anti")
                parts.append(live.select(*names, *([_FILE, _ROW, _START] if located else [])))
        if not parts:
            empty = T.StructType(schema.fields + (_PLACE.fields if located else []))
            return self.spark.createDataFrame([], empty)
        return reduce(DataFrame.unionByName, parts)

    def _kept(self, m: Manifest, stripes: list[Stripe]) -> DataFrame:
        """Live rows of stripes through the cache: what scans of the same stripes read is kept, the longest unused goes first.

        Of a scan of more than the cache holds, the first stripes that fit are kept; the others are read each time.
        """
        if not self.cache_bytes or not stripes:
            return self._rows(m, stripes)
        key = tuple((s.file, s.first, s.deleted) for s in stripes)
        if key in self._held:
            self.counters["ipc_hits"] += 1
            self._held.move_to_end(key)
            return self._held[key][0]
        self.counters["ipc_misses"] += 1
        size = fit = 0
        while fit < len(stripes) and size + stripes[fit].size <= self.cache_bytes:
            size += stripes[fit].size
            fit += 1
        if not fit:
            return self._rows(m, stripes)
        kept = self._rows(m, stripes[:fit]).persist()
        # the filter keeps Spark from merging a union with the next one, which it wouldn't find in the cache
        df = kept if fit == len(stripes) else kept.where(F.lit(True)).unionByName(self._rows(m, stripes[fit:]))
        self._held[key] = df, kept, size
        self.counters["ipc_bytes_cached"] += size
        while self.counters["ipc_bytes_cached"] > self.cache_bytes:
            _, (_, old, freed) = self._held.popitem(last=False)
            old.unpersist()
            self.counters["ipc_bytes_cached"] -= freed
        return df

    def plan(self, where: str | None = None, prune_by: list[tuple] | None = None, version: int | None = None) -> tuple[Manifest, list[Stripe], ScanReport]:
        m = self.log.load(version)
        conjuncts = [Conjunct(*p) for p in prune_by or []]
        if where:
            conjuncts += conjuncts_of(self.spark, where, m.schema)
        return m, *prune(m, conjuncts)

    def scan(self, where: str | None = None, columns: list[str] | None = None, prune_by: list[tuple] | None = None, version: int | None = None) -> DataFrame:
        """Live rows of the latest (or a given) version. where: SQL condition, always applied in full.

        prune_by: further (column, op, value) conjuncts of the query that may skip stripes; rows aren't filtered by them.
        """
        m, stripes, _ = self.plan(where, prune_by, version)
        df = self._kept(m, stripes)
        df = df.where(where) if where else df
        return df.select(*columns) if columns else df

    def explain(self, where: str | None = None, prune_by: list[tuple] | None = None) -> ScanReport:
        return self.plan(where, prune_by)[2]

    def lookup(self, **key) -> DataFrame:
        """Rows with these column values: a point lookup that opens only the stripes whose bounds admit them."""
        df = self.scan(prune_by=[(c, "=", v) for c, v in key.items()])
        for c, v in key.items():
            df = df.where(F.col(c) == F.lit(v))
        return df

    def sample(self, fraction: float, seed: int = 0) -> DataFrame:
        return self.scan().sample(fraction, seed)

    def row_range(self, stripe_id: int, first: int, last: int) -> DataFrame:
        """Live rows of a stripe at places first to last, from 0."""
        m = self.log.load()
        own = [s for s in m.stripes if s.id == stripe_id]
        return self._rows(m, own, True).where((F.col(_ROW) - F.col(_START)).between(first, last)).drop(_FILE, _ROW, _START)

    def create_view(self, name: str) -> None:
        self.scan().createOrReplaceTempView(name)

    def cache(self, mb: int = 256) -> None:
        """From now on keep what scans read, up to so many MB of stripes (as their files have them); 0 keeps none."""
        self.uncache()
        self.cache_bytes = mb << 20

    def uncache(self) -> None:
        for _, kept, _ in self._held.values():
            kept.unpersist()
        self._held.clear()
        self.counters["ipc_bytes_cached"] = 0

    # -- deleting and updating -----------------------------------------------------------------------------

    def _commit_rows(self, base: Manifest, stripes: list[Stripe], marked: DataFrame, new: list[Stripe]) -> int:
        """Commit new stripes and the deletion of marked rows of base's stripes, named by file, row and the stripe's first
        row; _Touched if a rival touched these."""
        folder = f"dv/{uuid.uuid4().hex}"
        marked.write.parquet(self.store.path(folder))
        written = self.spark.read.schema(_PLACE).parquet(self.store.path(folder))
        counts = {(r[_FILE], r[_START]): r["count"] for r in written.groupBy(_FILE, _START).count().toLocalIterator()}  # a row per stripe touched
        if not counts:
            self.store.delete(folder)
            return 0
        before = {s.key: s for s in stripes if s.key in counts}

        def change(last: Manifest) -> Manifest:
            now = before if last.version == base.version else {s.key: s for s in last.each() if s.key in counts}
            if any(n not in now or now[n].deleted != before[n].deleted for n in counts):
                raise _Touched
            dirty = last.dirty | {now[n].id: now[n].deleted + k for n, k in counts.items()}
            gone = Deletes(folder, tuple(sorted(now[n].id for n in counts)))
            return self.log.added(replace(last, dirty=dirty, deletes=last.deletes + (gone,)), new)

        try:
            self._commit(change, new, folder)
        except _Touched:
            self.store.delete(folder)
            self._discard(new)
            raise
        return sum(counts.values())

    def _attempt(self, once) -> int:
        for _ in range(ATTEMPTS):
            try:
                return once(self.log.load())
            except _Touched:
                continue
        raise CommitConflict(f"{self.path}: its stripes were changed by other writers {ATTEMPTS} times")

    def delete(self, where: str) -> int:
        """Delete the rows for which the condition is true, not null; returns their number."""

        def once(m: Manifest) -> int:
            stripes, _ = prune(m, conjuncts_of(self.spark, where, m.schema))
            if not stripes:
                return 0
            return self._commit_rows(m, stripes, self._rows(m, stripes, True).where(where).select(_FILE, _ROW, _START), [])

        return self._attempt(once)

    def delete_range(self, first: int, last: int, stripe_id: int | None = None) -> int:
        """Delete the live rows at places first to last, from 0, of a stripe or of each; returns their number."""

        def once(m: Manifest) -> int:
            stripes = [s for s in m.each() if stripe_id in (None, s.id) and first < s.rows and s.deleted < s.rows]
            if not stripes:
                return 0
            return self._commit_rows(m, stripes, self._rows(m, stripes, True).where((F.col(_ROW) - F.col(_START)).between(first, last)).select(_FILE, _ROW, _START), [])

        return self._attempt(once)

    def update(self, set_: dict[str, str | Column], where: str | None = None) -> int:
        """Set columns in the rows for which the condition is true; updated rows move to the end. Returns their number."""

        def once(m: Manifest) -> int:
            stripes, _ = prune(m, conjuncts_of(self.spark, where, m.schema) if where else [])
            if not stripes:
                return 0
            hit = self._rows(m, stripes, True)
            hit = hit.where(where) if where else hit
            return self._replace_rows(m, stripes, hit, {c: F.expr(e) if isinstance(e, str) else e for c, e in set_.items()})

        return self._attempt(once)

    def _replace_rows(self, m: Manifest, old: list[Stripe], hit: DataFrame, exprs: dict[str, Column]) -> int:
        """Rows with their places, replaced by new values. They are evaluated once and written: what is deleted and what is
        added come from the same rows, whatever their source gives the next time."""
        unknown = set(exprs) - {f.name for f in m.schema}
        if unknown:
            raise StripeError(f"columns not in the table: {', '.join(sorted(unknown))}")
        staged = f"staged/{uuid.uuid4().hex}"
        new = [(exprs.get(f.name, F.col(f"`{f.name}`"))).cast(f.dataType).alias(f.name) for f in m.schema]
        try:
            hit.select(_FILE, _ROW, _START, *new).write.parquet(self.store.path(staged))
            rows = self.spark.read.schema(T.StructType(_PLACE.fields + m.schema.fields)).parquet(self.store.path(staged))
            twice = rows.groupBy(_FILE, _ROW).count().where("count > 1").limit(1).collect()
            if twice:
                raise MultipleMatches(f"{twice[0]['count']} source rows match one row")
            stripes = self._write(rows.select(*[f"`{f.name}`" for f in m.schema]), m, m.options["codec"], m.options["rows_per_stripe"])
            return self._commit_rows(m, old, rows.select(_FILE, _ROW, _START), stripes)
        finally:
            self.store.delete(staged)

    def update_from(self, source: DataFrame, on: list[str], set_: dict[str, str], where: str | None = None) -> int:
        """UPDATE ... FROM: set_ may use source's columns as src.<column>; several source rows for one are an error."""

        def once(m: Manifest) -> int:
            live = [s for s in m.each() if s.rows > s.deleted]
            rows = self._rows(m, live, True).alias("t")
            other = source.select(*[F.col(c).alias(f"__src_{c}") for c in source.columns])
            joined = rows.join(other, [F.col(f"t.{c}") == F.col(f"__src_{c}") for c in on])
            packed = joined.withColumn("src", F.struct(*[F.col(f"__src_{c}").alias(c) for c in source.columns]))
            packed = packed.where(where) if where else packed
            return self._replace_rows(m, live, packed, {c: F.expr(e) for c, e in set_.items()})

        return self._attempt(once)

    def truncate(self) -> Manifest:
        def once(m: Manifest) -> Manifest:
            def change(last: Manifest) -> Manifest:
                if last.version != m.version:
                    raise _Touched
                return replace(last, parts=(), dirty={}, deletes=())

            return self._commit(change, left=m.stripes)

        return self._attempt(once)

    # -- maintenance ---------------------------------------------------------------------------------------

    def vacuum(self, keep_versions: int = 1) -> DataFrame:
        """Take dead stripes out of the manifest and delete files that the last keep_versions versions don't use.

        Files of a commit that is still being written have no version yet: vacuum only when no writer is active.
        """
        dead: list[Stripe] = []

        def change(last: Manifest) -> Manifest:
            dead[:] = [s for s in last.stripes if s.deleted >= s.rows]
            return self.log.without(last, {s.id for s in dead}) if dead else last

        m = self.log.load()
        gone = [s for s in m.stripes if s.deleted >= s.rows]
        if gone:
            m = self._commit(change, left=gone)
        versions = self.log.versions()
        kept = [self.log.load(v) for v in versions[-keep_versions:]]
        used = {x for mm in kept for x in [*(s.file.rpartition("/")[0] for s in mm.each()), *(d.folder for d in mm.deletes)]}
        parts = {p.file.rpartition("/")[2] for mm in kept for p in mm.parts}
        removed = 0
        for kind in ("stripes", "dv", "staged"):
            for folder in self._folders(kind):
                if f"{kind}/{folder}" not in used:
                    removed += self.store.delete(f"{kind}/{folder}")
        for name, _ in self.store.names(_LEFT):  # lists of stripes of which no file is left
            if not any(self.store.exists(f) for f in {x.partition("#")[0] for x in self.store.read(f"{_LEFT}/{name}").splitlines()}):
                self.store.delete(f"{_LEFT}/{name}")
        for v in versions[:-keep_versions]:
            self.store.delete(f"_manifest/v{v:020d}.json")
            self.log.cached.pop(v, None)
        for name, _ in self.store.names("_manifest"):
            if name.startswith("part-") and name not in parts:
                self.store.delete(f"_manifest/{name}")
        return self.spark.createDataFrame([(len(dead), removed, m.live_rows)], "stripes_removed int, folders_removed int, live_rows long")

    def _folders(self, kind: str) -> list[str]:
        p = self.store._path(self.store.path(kind))
        return [s.getPath().getName() for s in self.store.fs.listStatus(p)] if self.store.fs.exists(p) else []

    def compact(self) -> DataFrame:
        """Rewrite the stripes that are partly deleted; fully deleted ones are left for vacuum."""
        done = [0, 0]

        def once(m: Manifest) -> int:
            part = [s for s in m.stripes if 0 < s.deleted < s.rows]
            done[:] = [len(part), sum(s.rows - s.deleted for s in part)]
            if not part:
                return 0
            new = self._write(self._rows(m, part), m, m.options["codec"], m.options["rows_per_stripe"])
            old = {s.id: s.deleted for s in part}

            def change(last: Manifest) -> Manifest:
                now = {s.id: s.deleted for s in last.stripes if s.id in old}
                if now != old:
                    raise _Touched
                return self.log.added(self.log.without(last, set(old)), new)

            try:
                self._commit(change, new, left=part)
            except _Touched:
                self._discard(new)
                raise
            return len(part)

        self._attempt(once)
        return self.spark.createDataFrame([tuple(done)], "stripes_compacted int, rows_compacted long")

    def optimize(self, cluster_by: list[str], rows_per_stripe: int | None = None) -> Manifest:
        """Rewrite all live rows in ranges of cluster_by."""
        m = self.log.load()
        old = m.stripes
        df = self._rows(m, old).repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
        new = self._write(df, m, m.options["codec"], rows_per_stripe or m.options["rows_per_stripe"])

        def change(last: Manifest) -> Manifest:
            if last.version != m.version:
                raise CommitConflict(f"{self.path} was changed meanwhile")
            return self.log.added(replace(last, parts=(), dirty={}, deletes=()), new)

        return self._commit(change, new, left=old)

    def rebuild_metadata(self) -> DataFrame:
        """A new version from the table's folder alone, whether or not a manifest is left; run it when no writer is active.

        Folders of committed stripes and of committed deleted rows are listed, less the stripes that are listed as
        gone; schema, row counts, bounds, codecs and deleted rows come from the files. A file that can't be read is
        left out with a warning. Only the options come from the last manifest, where there is one.
        """
        left = {f for name, _ in self.store.names(_LEFT) for f in self.store.read(f"{_LEFT}/{name}").splitlines()}
        committed = {k: [f"{k}/{f}" for f in sorted(self._folders(k)) if self.store.exists(f"{k}/{f}/{_DONE}")] for k in ("stripes", "dv")}
        last = self.log.load() if self.log.versions() else None
        schema = last.schema if last else self._schema_of(committed["stripes"])
        base = Manifest(0, schema)
        found: list[Stripe] = []
        for folder in committed["stripes"]:
            files, each = [(n, size) for n, size in self._files(folder) if f"{folder}/{n}" not in left], _rows_of(folder)
            measured: dict[str, list[Stripe]] = {}
            try:
                for s in self._measured(folder, base, None) if files else []:
                    measured.setdefault(s.file, []).append(s)
            except Exception:  # some file is broken: one by one, to find what can be read, without bounds
                measured = {}
                for n, size in files:
                    try:
                        rows = self.spark.read.schema(schema).parquet(self.store.path(f"{folder}/{n}")).count()
                        firsts = range(0, rows, each) if each else [0]
                        measured[f"{folder}/{n}"] = [Stripe(0, f"{folder}/{n}", min(each, rows - i) if each else rows, size // len(firsts), "none", first=i, each=each, held=rows if each else 0) for i in firsts]
                    except Exception as e:
                        warnings.warn(f"{folder}/{n} can't be read: {type(e).__name__}", stacklevel=2)
            found += [s for n, _ in files for s in measured.get(f"{folder}/{n}", []) if s.place not in left]
        ids = {s.key: i for i, s in enumerate(found, 1)}
        dirty: dict[int, int] = {}
        deletes = []
        for folder in committed["dv"]:
            rows = self.spark.read.schema(_PLACE).parquet(self.store.path(folder)).fillna(0, [_START])
            counts = {ids[r[_FILE], r[_START]]: r["n"] for r in rows.groupBy(_FILE, _START).agg(F.count_distinct(_ROW).alias("n")).toLocalIterator() if (r[_FILE], r[_START]) in ids}
            if counts:
                deletes.append(Deletes(folder, tuple(sorted(counts))))
                dirty = {i: dirty.get(i, 0) + counts.get(i, 0) for i in dirty.keys() | counts.keys()}
        codecs = [s.codec for s in found]
        options = last.options if last else {"codec": max(set(codecs), key=codecs.count) if codecs else "zstd", "rows_per_stripe": max([10_000, *(s.rows for s in found)])}

        def change(now: Manifest) -> Manifest:
            if last is None or now.version != last.version:
                raise CommitConflict(f"{self.path} was changed meanwhile")
            return replace(self.log.added(replace(base, version=now.version, options=options), found), dirty=dirty, deletes=tuple(deletes))

        if last:
            new = self.log.commit(change)
        else:
            new = replace(self.log.added(replace(base, version=1, options=options), found), version=1, dirty=dirty, deletes=tuple(deletes))
            if not self.log.publish(new):
                raise CommitConflict(f"{self.path} was changed meanwhile")
        return self.spark.createDataFrame([(len(found), new.live_rows)], "stripes_rebuilt int, rows_total long")

    def _schema_of(self, folders: list[str]) -> T.StructType:
        for folder in folders:
            try:
                read = self.spark.read.parquet(self.store.path(folder)).schema
                return schema_of(T.StructType([T.StructField(f.name, f.dataType) for f in read]))
            except Exception as e:
                warnings.warn(f"{folder} can't be read: {type(e).__name__}", stacklevel=2)
        raise NotAStripeTable(f"{self.path} has no stripes to take a schema from")

    # -- introspection -------------------------------------------------------------------------------------

    def stripe_info(self) -> DataFrame:
        rows = [(s.id, s.rows, s.size, s.codec, s.deleted, any(x[0] is not None for x in s.stats.values())) for s in self.log.load().stripes]
        return self.spark.createDataFrame(rows, "stripe_id int, row_count long, file_size long, compression string, deleted_rows long, has_stats boolean")

    def relation_size(self) -> int:
        """Bytes of all files of the table, metadata too; 0 if it has none."""
        return self.store.size()

    def row_count(self) -> int:
        """Live rows, from the manifest alone."""
        return self.log.load().live_rows

    def estimate(self) -> tuple[int, int]:
        """Rows and 8 KiB pages, as a planner wants them."""
        m = self.log.load()
        return m.live_rows, -(-m.bytes // 8192)

    def cache_stats(self) -> DataFrame:
        """Of this handle so far, lookups of manifests, of parts with their bounds, of delete vectors and of cached rows that
        found what they wanted in memory (cached rows: as much of it as the cache holds) or not; and bytes of stripes (as their files have them) whose rows are kept."""
        return self.spark.createDataFrame([tuple(self.counters.values())], ", ".join(f"{k} long" for k in self.counters))

    def analyze(self, columns: list[str] | None = None, top: int = 10, buckets: int = 10) -> DataFrame:
        """Statistics of columns, a row each: exact counts of rows, nulls and distinct values, minimum and maximum, the top
        most common values with their counts (ties by value; as text, of columns that repeat any), and bounds that cut
        a column of numbers into buckets of about equal counts (null for others)."""
        df = self.scan()
        columns = columns or df.columns
        aggs = [F.count(F.lit(1)).alias("n")]
        numeric = {f.name for f in df.schema if isinstance(f.dataType, (T.NumericType,))}
        for i, c in enumerate(columns):
            col = F.col(f"`{c}`")
            aggs += [F.count(col).alias(f"c{i}"), F.count_distinct(col).alias(f"d{i}"), F.min(col).cast("string").alias(f"a{i}"), F.max(col).cast("string").alias(f"b{i}")]
            cuts = F.percentile_approx(col.cast("double"), [k / buckets for k in range(buckets + 1)], 10_000) if c in numeric else F.lit(None).cast("array<double>")
            aggs.append(cuts.alias(f"h{i}"))
        one = df.agg(*aggs)
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("row_count"), (F.col("n") - F.col(f"c{i}")).alias("null_count"), F.col(f"d{i}").alias("n_distinct"), F.col(f"a{i}").alias("min_value"), F.col(f"b{i}").alias("max_value"), F.col(f"h{i}").alias("histogram")) for i, c in enumerate(columns)])
        out = one.select(F.explode(rows).alias("r")).select("r.*")
        common = None
        for c in columns:
            v = F.col(f"`{c}`")
            often = df.where(v.isNotNull()).groupBy(v.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count")).where("count > 1").orderBy(F.desc("count"), "value").limit(top)
            own = often.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "value", "count"))).alias("l")).select(F.lit(c).alias("column_name"), F.transform("l", lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias("most_common"))
            common = own if common is None else common.unionByName(own)
        return out.join(F.broadcast(common), "column_name", "left")  # a row per column


class _Touched(Exception):
    """A rival changed a stripe that this commit touches: start again from the new version."""


class _Uneven(Exception):
    """Row groups of a shared file aren't of the rows that its stripes should have."""


def _in_order(name: str) -> tuple[int, int, str]:
    """Order in which Spark writes files: by task, then by number, of which both outgrow their zeros."""
    found = re.match(r"part-(\d+)-.*-c(\d+)\.", name)
    return (int(found[1]), int(found[2]), name) if found else (0, 0, name)


def _rows_of(folder: str) -> int:
    """Rows of each stripe in a folder whose stripes share files, from its name; 0 if each has its own."""
    tail = folder.rpartition("/")[2].split("-")[2:]
    return int(tail[0]) if tail else 0


def is_stripe_table(spark: SparkSession, path: str) -> bool:
    try:
        StripeTable.open(spark, path)
    except (NotAStripeTable, AnalysisException):
        return False
    return True
