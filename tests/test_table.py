import datetime as dt
import random
import shutil
import threading
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina import manifest, storage
from lamina.errors import DuplicateKey, MultipleMatches, NotAStripeTable, StripeError, UnsafeStore, UnsupportedType
from lamina.functions.generate import generate_series
from lamina.sources import arrow_stripes
from lamina.streaming.sink import append_stream
from lamina.operators import table
from lamina.plans import queries
from lamina.operators.table import StripeTable, is_stripe_table
from lamina.types import sql_type

ALL = {"c_bool": "bool", "c_i16": "smallint", "c_i32": "int", "c_i64": "bigint", "c_f32": "real", "c_f64": "double precision", "c_text": "text", "c_varchar": "varchar", "c_bytea": "bytea", "c_date": "date", "c_ts": "timestamp", "c_tstz": "timestamptz", "c_uuid": "uuid", "c_numeric": "numeric(38,10)"}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_all_types(spark, tmp_path):
    t = StripeTable.create(spark, str(tmp_path / "t"), ALL)
    utc = dt.datetime(2020, 5, 5, 12)
    rows = [
        (None,) * 14,
        (True, 32767, 2**31 - 1, 2**63 - 1, float("inf"), float("nan"), "é\U0001f642", "", b"", dt.date(9999, 12, 31), dt.datetime(1969, 1, 1), utc, "0b0e7c1e-0000-4000-8000-000000000000", Decimal("1.5")),
        (False, -32768, -(2**31), -(2**63), -0.0, 1e-300, "", "x", b"\x00\xff", dt.date(1900, 1, 1), dt.datetime(2100, 1, 1), utc, "", Decimal("-99999999999999999999.0000000001")),
    ]
    df = spark.createDataFrame(rows, t.schema)
    for codec in ("none", "lz4", "zstd"):
        t.insert(df, codec=codec)
    assert list(map(repr, rows_of(t.scan()))) == list(map(repr, rows_of(df.union(df).union(df))))
    assert {r.compression for r in t.stripe_info().collect()} == {"none", "lz4", "zstd"}
    assert t.scan("c_f64 > 5").count() == 3  # NaN is greater than all numbers
    assert t.scan("c_tstz = timestamp'2020-05-05 12:00:00'").count() == 6


def test_types_are_checked_on_creation(spark, tmp_path):
    for bad in ("json", "interval", "int[]"):
        with pytest.raises(UnsupportedType):
            sql_type(bad)
    with pytest.raises(UnsupportedType):
        StripeTable.create(spark, str(tmp_path / "t"), T.StructType([T.StructField("a", T.ArrayType(T.LongType()))]))
    with pytest.raises(NotAStripeTable):
        StripeTable.open(spark, str(tmp_path / "none"))
    assert not is_stripe_table(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("n", [0, 1, 9_999, 10_000, 10_001, 20_000])
def test_stripe_boundaries(spark, tmp_path, n):
    t = StripeTable.create(spark, str(tmp_path / "t"), {"id": "bigint"})
    t.insert(generate_series(spark, 1, n, name="id"), ordered=True)
    assert t.row_count() == t.scan().count() == n
    assert [r.row_count for r in t.stripe_info().orderBy("stripe_id").collect()] == [10_000] * (n // 10_000) + [n % 10_000] * (n % 10_000 > 0)
    if n == 20_000:
        assert (t.explain("id = 15000").total, t.explain("id = 15000").skipped) == (2, 1)
        assert [r.id for r in t.lookup(id=15_000).collect()] == [15_000]
        assert [r.id for r in t.row_range(2, 0, 1).collect()] == [10_001, 10_002]


def test_random_changes_against_a_list(spark, tmp_path):
    rng = random.Random(5)
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint", "v": "int"}, rows_per_stripe=20)
    model: list[tuple[int, int | None]] = []
    for step in range(14):
        what = rng.choice(["insert", "delete", "update", "vacuum", "compact", "rebuild", "optimize"]) if step else "insert"
        k = rng.randrange(5)
        if what == "insert":
            new = [(rng.randrange(50), rng.choice([None, rng.randrange(9)])) for _ in range(60)]
            t.insert(spark.createDataFrame(new, t.schema), ordered=True)
            model += new
        elif what == "delete":
            n = t.delete(f"v = {k} AND k < 40")
            kept = [r for r in model if not (r[1] == k and r[0] < 40)]
            assert n == len(model) - len(kept)
            model = kept
        elif what == "update":
            t.update({"v": "v + 10"}, f"k % 5 = {k}")
            model = [(a, None if b is None else b + 10) if a % 5 == k else (a, b) for a, b in model]
        else:
            {"vacuum": t.vacuum, "compact": t.compact, "rebuild": t.rebuild_metadata, "optimize": lambda: t.optimize(["k"])}[what]()
        assert t.row_count() == len(model), what
    assert rows_of(t.scan()) == sorted(model, key=repr)
    assert rows_of(t.scan("k BETWEEN 10 AND 20")) == sorted((r for r in model if 10 <= r[0] <= 20), key=repr)


def test_update_from(spark, tmp_path):
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint", "v": "text"})
    t.insert(spark.createDataFrame([(1, "a"), (2, "b")], t.schema))
    assert t.update_from(spark.createDataFrame([(2, "z")], "k long, w string"), ["k"], {"v": "src.w"}) == 1
    assert rows_of(t.scan()) == [(1, "a"), (2, "z")]
    with pytest.raises(MultipleMatches):
        t.update_from(spark.createDataFrame([(2, "y"), (2, "x")], "k long, w string"), ["k"], {"v": "src.w"})


def test_keys_columns_and_snapshots(spark, tmp_path):
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint", "v": "text"})
    t.insert(spark.createDataFrame([(1, "a"), (None, "n")], t.schema), unique=["k"])
    with pytest.raises(DuplicateKey):
        t.insert(spark.createDataFrame([(1, "b")], t.schema), unique=["k"])
    t.insert(spark.createDataFrame([(None, "m")], t.schema), unique=["k"])
    t.insert(spark.createDataFrame([(7,)], "k long"))
    with pytest.raises(StripeError):
        t.insert(spark.createDataFrame([(7,)], "other long"))
    t.upsert(spark.createDataFrame([(7, "x"), (8, "y")], t.schema), ["k"])
    assert rows_of(t.scan()) == sorted([(1, "a"), (None, "n"), (None, "m"), (7, None), (8, "y")], key=repr)
    before = t.version
    t.truncate()
    assert t.scan().count() == 0 and t.scan(version=before).count() == 5
    assert t.relation_size() > 0
    t.drop()
    assert not is_stripe_table(spark, str(tmp_path / "t"))


def test_cache_and_statistics(spark, tmp_path):
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint"})
    t.insert(generate_series(spark, 1, 100, name="k"))
    t.cache()
    assert t.scan("k > 90").count() == 10
    assert t.scan("k > 95").count() == 5
    stats = t.cache_stats().first()
    assert (stats.ipc_hits, stats.ipc_misses) == (0, 1) or stats.ipc_hits == 1
    assert stats.ipc_bytes_cached > 0 and len(stats) == 9
    t.delete("k = 1")
    assert t.scan().count() == 99  # another version isn't read from the cache
    row = t.analyze().first()
    assert (row.row_count, row.n_distinct, row.min_value, row.max_value) == (99, 99, "2", "100")
    assert t.sample(0.5, 3).count() == t.sample(0.5, 3).count() > 0
    assert t.estimate()[0] == 99


def test_writers_that_race(spark, tmp_path):
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint"})
    t.insert(generate_series(spark, 1, 100, name="k"))
    jobs = [threading.Thread(target=lambda i=i: StripeTable.open(spark, t.path).insert(generate_series(spark, 1000 * i, 1000 * i + 9, name="k"))) for i in range(1, 5)]
    jobs += [threading.Thread(target=lambda i=i: StripeTable.open(spark, t.path).delete(f"k = {i} OR k = {i + 50}")) for i in (1, 2)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert StripeTable.open(spark, t.path).scan().count() == t.row_count() == 100 + 40 - 4


def test_files_without_commit_are_not_read(spark, tmp_path):
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint"})
    t.insert(generate_series(spark, 1, 10, name="k"))
    t._write(generate_series(spark, 1, 10, name="k"), t.log.load(), "zstd", 10)  # a writer that died before its commit
    assert t.scan().count() == 10
    t.vacuum()
    assert t.scan().count() == 10 and len(t._folders("stripes")) == 1


def test_rebuild_leaves_unreadable_stripes_out(spark, tmp_path):
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint"})
    t.insert(generate_series(spark, 1, 10, name="k"))
    t.insert(generate_series(spark, 11, 20, name="k").coalesce(1))
    broken = t.log.load().stripes[-1].file
    (tmp_path / "t" / broken).write_bytes(b"not parquet")
    for crc in (tmp_path / "t" / broken).parent.glob(".*.crc"):
        crc.unlink()
    with pytest.warns(UserWarning):
        row = t.rebuild_metadata().first()
    assert row.rows_total == 10 and t.scan().count() == 10


def test_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text("1,a\n2,\n")
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint", "v": "text"})
    t.insert_csv(str(tmp_path / "in.csv"))
    assert rows_of(t.scan()) == [(1, "a"), (2, None)]


@pytest.mark.parametrize("codec", ["none", "lz4", "zstd"])
def test_arrow_stripes(spark, tmp_path, codec):
    arrow_stripes.register(spark)
    df = spark.range(25).select("id", F.col("id").cast("string").alias("s")).coalesce(1)
    df.write.format("arrow_stripes").mode("append").options(path=str(tmp_path), codec=codec, rows="10").save()
    names = sorted(p.name for p in tmp_path.glob("*.arrow"))
    assert names == ["stripe_000001.arrow", "stripe_000002.arrow", "stripe_000003.arrow"]
    (tmp_path / "stripe_000002.deleted").write_bytes(bytes([0b101, 0]))
    got = sorted(r.id for r in spark.read.format("arrow_stripes").load(str(tmp_path)).collect())
    assert got == [i for i in range(25) if i not in (10, 12)]


def test_stream_is_stored_once(spark, tmp_path):
    t = StripeTable.create(spark, str(tmp_path / "t"), {"id": "bigint"})
    spark.range(50).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        append_stream(stream, t, str(tmp_path / "cp"), "s").awaitTermination()
    assert t.scan().count() == 50


def test_the_cache_is_bounded(spark, tmp_path):
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint"}, rows_per_stripe=10)
    t.insert(generate_series(spark, 1, 40, name="k"), ordered=True)
    size = max(s.size for s in t.log.load().stripes)
    t.cache()
    t.cache_bytes = 2 * size
    for k in (5, 15, 5, 25, 5, 15):
        assert t.scan(f"k = {k}").count() == 1
    assert t.scan().count() == 40  # larger than the cache: not kept
    stats = t.cache_stats().first()
    assert (stats.ipc_hits, stats.ipc_misses) == (2, 5) and stats.ipc_bytes_cached <= 2 * size
    t.uncache()
    assert t.cache_stats().first().ipc_bytes_cached == 0


def test_keys_stay_unique_when_writers_race(spark, tmp_path):
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint", "v": "int"})
    t.insert(spark.createDataFrame([(0, 0)], t.schema), unique=["k"])
    rows = lambda i: spark.createDataFrame([(100, i), (200 + i, i)], t.schema)
    outcome = []

    def insert(i):
        try:
            StripeTable.open(spark, t.path).insert(rows(i), unique=["k"])
            outcome.append("in")
        except DuplicateKey:
            outcome.append("twice")

    jobs = [threading.Thread(target=insert, args=(i,)) for i in range(4)]
    jobs += [threading.Thread(target=lambda i=i: StripeTable.open(spark, t.path).upsert(spark.createDataFrame([(300, i), (400 + i, i), (None, i)], t.schema), ["k"])) for i in range(3)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    t.check_unique(["k"])
    assert sorted(outcome) == ["in", "twice", "twice", "twice"]
    keys = [r.k for r in t.scan().collect()]
    assert keys.count(100) == keys.count(300) == 1 and keys.count(None) == 3 and len(keys) == 1 + 2 + 4 + 3


def test_an_update_sees_its_source_once(spark, tmp_path):
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint", "v": "double precision"})
    t.insert(generate_series(spark, 1, 2000, name="k").withColumn("v", F.lit(0.0)))
    n = t.update_from(spark.range(1, 2001).where(F.rand() < 0.5).select(F.col("id").alias("k")), ["k"], {"v": "rand() + 1"})
    assert 0 < n < 2000 and t.scan().count() == 2000 and t.scan().select("k").distinct().count() == 2000
    assert t.scan("v > 0").count() == n and not t._folders("staged")


@pytest.mark.parametrize("lost", [True, False])
def test_rebuild_from_the_folder_alone(spark, tmp_path, lost):
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint", "v": "text"}, "lz4", 20)
    t.insert(spark.createDataFrame([(i, f"v{i}") for i in range(100)], t.schema), ordered=True)
    t.delete("k < 10")
    t.compact()
    t.update({"v": "'new'"}, "k % 10 = 3")
    t.delete("k = 50")
    t._write(t.scan(), t.log.load(), "zstd", 10)  # never committed
    want = rows_of(t.scan())
    if lost:
        shutil.rmtree(tmp_path / "t" / "_manifest")
    t = StripeTable(spark, t.path)
    row = t.rebuild_metadata().first()
    assert row.rows_total == len(want) and rows_of(t.scan()) == want and t.row_count() == len(want)
    assert t.explain("k = 99").skipped > 0 and {r.compression for r in t.stripe_info().collect()} == {"lz4"}
    t.insert(spark.createDataFrame([(1000, "x")], t.schema))
    t.delete("k = 1000")
    assert rows_of(t.scan()) == want


def test_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "PART_STRIPES", 4)
    monkeypatch.setattr(manifest, "PARTS_HELD", 2)
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint"}, rows_per_stripe=5)
    for i in range(4):
        t.insert(generate_series(spark, 100 * i, 100 * i + 49, name="k"), ordered=True)
    m = t.log.load()
    assert m.count == 40 and all(p.count <= 4 for p in m.parts) and [s.id for s in m.stripes] == list(range(1, 41))
    t = StripeTable.open(spark, t.path)
    assert [r.k for r in t.lookup(k=312).collect()] == [312]
    assert t.counters["stats_misses"] == 1  # the other parts weren't read
    t.delete("k % 100 = 7 OR k >= 300")
    t.compact()
    t.vacuum()
    assert sorted(r.k for r in t.scan().collect()) == [100 * i + j for i in range(3) for j in range(50) if j != 7]
    assert t.explain("k = 20").skipped == t.explain("k = 20").total - 1


def test_bounds_from_footers(spark, tmp_path):
    t = StripeTable.create(spark, str(tmp_path / "t"), ALL)
    utc = dt.datetime(2020, 5, 5, 12)
    row = lambda i: (True, i, i, i, float(i), float(i), f"é{i}", "", b"", dt.date(2020, 1, 1 + i), utc + dt.timedelta(days=i), utc + dt.timedelta(days=i), "", Decimal(i))
    t.insert(spark.createDataFrame([row(1), row(2), (None,) * 14], t.schema).coalesce(1))
    (s,) = t.log.load().stripes
    assert s.stats["c_i64"] == [1, 2, 1, False] and s.stats["c_text"] == ["é1", "é2", 1, False] and s.stats["c_f64"] == [1.0, 2.0, 1, False]
    assert s.stats["c_date"] == ["2020-01-02", "2020-01-03", 1, False] and s.stats["c_ts"][:2] == ["2020-05-06T12:00:00", "2020-05-07T12:00:00"]
    assert s.stats["c_tstz"][:2] == ["2020-05-06T12:00:00+00:00", "2020-05-07T12:00:00+00:00"] and [Decimal(x) for x in s.stats["c_numeric"][:2]] == [1, 2]


def test_versions_are_published_where_names_can_be_claimed(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(f"fs.viewfs.mounttable.other.link.{tmp_path}", f"file://{tmp_path}")
    t = StripeTable.create(spark, f"viewfs://other{tmp_path}/t", {"k": "bigint"})  # a view of a local disk: by hard link
    t.insert(generate_series(spark, 1, 10, name="k"))
    assert t.scan().count() == 10 and not t.log.publish(t.log.load(1))
    store = storage.Store(spark, str(tmp_path / "s"))
    store.write("a", "x")
    store.scheme_of = lambda p: "far"
    with pytest.raises(UnsafeStore):
        store.publish("a", "b")
    store.write("a", "x")
    store.single_writer = True
    assert store.publish("a", "b") and store.read("b") == "x"


def test_analyze_common_values_and_histogram(spark, tmp_path):
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "int", "v": "text"})
    t.insert(spark.createDataFrame([(i, "abc"[min(i // 10, 2)]) for i in range(101)] + [(None, None)], t.schema))
    k, v = (r for r in t.analyze(top=2, buckets=4).orderBy("column_name").collect())
    assert [(x["value"], x["count"]) for x in v.most_common] == [("c", 81), ("a", 10)] and v.histogram is None
    assert k.histogram == [0.0, 25.0, 50.0, 75.0, 100.0] and k.most_common == [] and (k.null_count, k.n_distinct) == (1, 101)


def test_many_deleted_rows_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Their files are small, as names repeat in them, but not their rows."""
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint"}, rows_per_stripe=20)
    t.insert(generate_series(spark, 1, 100, name="k"))
    monkeypatch.setattr(table, "BROADCAST_DELETES", 0)
    t.delete("k % 3 = 0")
    t.delete("k % 5 = 0")
    live = t.scan()
    assert sorted(r.k for r in live.collect()) == [k for k in range(1, 101) if k % 3 and k % 5]
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_places_are_deleted_in_all_stripes_at_once(spark, tmp_path):
    """Whatever the keys: these repeat and have nulls."""
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint", "v": "int"}, rows_per_stripe=10)
    t.insert(spark.createDataFrame([(None if i % 2 else 1, i) for i in range(45)], t.schema).coalesce(1), ordered=True)
    assert t.delete_range(0, 2) == 15 and t.delete_range(0, 3) == 5 and t.delete_range(8, 20, 1) == 2 and t.delete_range(60, 70) == 0
    assert sorted(r.v for r in t.scan().collect()) == [i for i in range(45) if i % 10 > 3 and i not in (8, 9)]


def test_compact_counts_reads_no_stripe_alone(spark, small, monkeypatch):
    """It took a job for each stripe, and all keys in one condition."""
    monkeypatch.setattr(StripeTable, "row_range", None)
    assert queries.compact_counts(spark, small).first() == (2, 1500 - 20)


def test_the_cache_keeps_what_fits_of_a_larger_scan(spark, tmp_path):
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint"}, rows_per_stripe=10)
    t.insert(generate_series(spark, 1, 40, name="k"), ordered=True)
    size = max(s.size for s in t.log.load().stripes)
    t.cache()
    t.cache_bytes = 2 * size
    t.delete("k IN (5, 35)")
    rows = [sorted(r.k for r in t.scan().collect()) for _ in range(2)]
    assert rows[0] == rows[1] == [k for k in range(1, 41) if k not in (5, 35)]
    stats = t.cache_stats().first()
    assert (stats.ipc_hits, stats.ipc_misses) == (1, 1) and 0 < stats.ipc_bytes_cached <= 2 * size
    assert "InMemoryTableScan" in t.scan()._jdf.queryExecution().executedPlan().toString()
    t.delete("k = 6")
    assert t.scan().count() == 37


def test_cache_stats_of_a_table_larger_than_the_cache(spark, small, monkeypatch):
    monkeypatch.setattr(StripeTable, "cache", lambda t, mb=256: setattr(t, "cache_bytes", sum(s.size for s in t.log.load().stripes) // 2))
    assert tuple(queries.cache_stats(spark, small).first())[:3] == (1, 2, True)


@pytest.fixture
def shared(monkeypatch):
    """Ordered inserts of more than two stripes have them share files, three at most."""
    monkeypatch.setattr(table, "ALONE", 2)
    monkeypatch.setattr(table, "FILE_STRIPES", 3)


def test_cache_stats_writes_no_file_per_stripe(spark, small, shared, monkeypatch):
    """A table of 100 rows a stripe took a file, a footer and a path for each of them, all written by one task."""
    read = []
    monkeypatch.setattr(StripeTable, "_footer", lambda t, n, size, was=StripeTable._footer: (read.append(n), was(t, n, size))[1])
    assert tuple(queries.cache_stats(spark, small).first()) == (1, 2, True, 2 * 1500 + 500)
    assert len(read) == 5


@pytest.mark.parametrize("broadcast", [0, 32 << 20])
def test_stripes_that_share_files(spark, tmp_path, shared, monkeypatch, broadcast):
    monkeypatch.setattr(table, "BROADCAST_DELETES", broadcast)
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint", "v": "text", "d": "double precision"}, rows_per_stripe=10)
    t.insert(spark.createDataFrame([(i, f"v{i}", float("nan") if i == 33 else i / 2) for i in range(95)], t.schema).repartition(7).orderBy("k"), ordered=True)
    m = t.log.load()
    assert [(s.id, s.rows, s.first, s.held, s.stats["k"][:2]) for s in m.stripes] == [(i + 1, 5 if i == 9 else 10, i % 3 * 10, 5 if i == 9 else 30, [10 * i, min(10 * i + 9, 94)]) for i in range(10)]
    assert len({s.file for s in m.stripes}) == 4 and m.stripes[3].stats["d"][3] and not m.stripes[4].stats["d"][3] and m.stripes[4].stats["d"][:2] == [20.0, 24.5]
    assert t.relation_size() > sum(s.size for s in m.stripes) and not t._folders("staged")
    keys = lambda df: sorted(r.k for r in df.collect())
    want = list(range(95))
    assert keys(t.scan()) == want and keys(t.scan(prune_by=[("k", "<", 20)])) == want[:20] and keys(t.scan(prune_by=[("k", "=", 94)])) == want[90:]
    assert t.explain("k = 20").skipped == 9 and keys(t.row_range(5, 2, 30)) == want[42:50] and keys(t.lookup(k=55)) == [55]
    assert t.delete("k % 10 = 7 AND k < 60") == 6 and t.delete_range(0, 1) == 20 and t.delete_range(3, 40, 4) == 6 and t.delete("k BETWEEN 50 AND 59") == 7
    gone = {k for k in want if k % 10 < 2 or k % 10 == 7 and k < 60 or 33 <= k < 40 or 50 <= k < 60}
    want = [k for k in want if k not in gone]
    assert keys(t.scan()) == want and t.row_count() == len(want) and keys(t.scan(prune_by=[("k", "<", 20)])) == [k for k in want if k < 20]
    assert keys(t.row_range(4, 0, 9)) == [32] and {r.stripe_id: r.deleted_rows for r in t.stripe_info().collect()} == {i: {4: 9, 6: 10}.get(i, 3 if i < 7 else 2) for i in range(1, 11)}
    assert t.update({"v": "'new'"}, "k IN (2, 72, 94)") == 3
    with pytest.raises(DuplicateKey):
        t.insert(spark.createDataFrame([(82, "x", 0.0)], t.schema), unique=["k"])
    t.vacuum()  # stripe 6 alone, not its file
    assert 6 not in {s.id for s in t.log.load().stripes} and keys(t.scan()) == want
    fresh = StripeTable(spark, t.path)
    shutil.rmtree(tmp_path / "t" / "_manifest")
    assert fresh.rebuild_metadata().first().rows_total == len(want) and keys(fresh.scan()) == want
    assert fresh.compact().first().rows_compacted == len([k for k in want if k not in (2, 72, 94)]) and keys(fresh.scan()) == want
    fresh.vacuum()
    again = StripeTable(spark, t.path)
    shutil.rmtree(tmp_path / "t" / "_manifest")
    assert again.rebuild_metadata().first().rows_total == len(want) and keys(again.scan()) == want
    assert sorted(r.k for r in again.scan("v = 'new'").collect()) == [2, 72, 94]


def test_the_cache_holds_a_part_of_a_shared_file(spark, tmp_path, shared):
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint"}, rows_per_stripe=10)
    t.insert(generate_series(spark, 1, 60, name="k"), ordered=True)
    t.cache()
    t.cache_bytes = sum(s.size for s in t.log.load().stripes[:2])
    for _ in range(2):
        assert sorted(r.k for r in t.scan().collect()) == list(range(1, 61))
    t.delete("k = 35")
    assert t.scan().count() == 59 and t.scan("k < 5").count() == 4
    stats = t.cache_stats().first()
    assert (stats.ipc_hits, stats.ipc_misses) == (1, 3) and stats.ipc_bytes_cached <= t.cache_bytes


def test_an_ordered_insert_reads_its_source_once(spark, tmp_path, shared):
    """Rows keep the order of the source, whatever its partitions; ten stripes and more of a task are in order too."""
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint", "r": "double precision"}, rows_per_stripe=7)
    t.insert(spark.range(1000, numPartitions=13).where("id % 5 < 3").select(F.col("id").alias("k"), F.rand().alias("r")), ordered=True)
    bounds = [s.stats["k"][:2] for s in t.log.load().stripes]
    keys = [k for k in range(1000) if k % 5 < 3]
    assert bounds == [[keys[i], keys[min(i + 6, 599)]] for i in range(0, 600, 7)]
    assert t.scan().select("r").distinct().count() == 600


def test_wide_rows_share_no_file(spark, tmp_path, shared, monkeypatch):
    """Their row groups end by bytes, before they have the rows of a stripe."""
    monkeypatch.setattr(StripeTable, "_put", lambda t, df, folder, was=StripeTable._put, **o: was(t, df, folder, **(o | {"parquet.block.row.count.limit": 6} if "parquet.block.row.count.limit" in o else o)))
    t = StripeTable.create(spark, str(tmp_path / "t"), {"k": "bigint"}, rows_per_stripe=10)
    t.insert(generate_series(spark, 1, 45, name="k"), ordered=True)
    assert [(s.rows, s.each, s.stats["k"][0]) for s in t.log.load().stripes] == [(10, 0, 1), (10, 0, 11), (10, 0, 21), (10, 0, 31), (5, 0, 41)]
    assert t.scan().count() == 45 and len(t._folders("stripes")) == 1
