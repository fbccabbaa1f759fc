"""The engine's queries over the base tables, each with the same result in SQL.

Sums of money are taken over decimals, so that no order of addition shows in them.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DuplicateKey
from ..functions.generate import CATEGORIES, REGIONS, fact_orders, generate_series
from ..functions.scalar import add_days, array_get, date_trunc_ntz, int_div, round_to_int
from ..scratch import work_path
from ..sources.tables import base_table, register, write_delimited
from ..operators.table import StripeTable, is_stripe_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def total(c: Column) -> Column:
    return F.sum(c).cast("double")


# -- the benchmark's ten queries, on lineitem as a stripe table ---------------------------------------------------

_lineitems: dict[tuple[str, str], StripeTable] = {}


def lineitem(spark: SparkSession, d: str) -> StripeTable:
    """lineitem as a stripe table, loaded once for all queries of a session."""
    key = spark.sparkContext.applicationId, d
    if key not in _lineitems:
        df = base_table(spark, d, "lineitem")
        t = StripeTable.create(spark, work_path(spark, "lineitem"), df.schema, "zstd", 100_000)
        t.insert(df)
        _lineitems[key] = t
    return _lineitems[key]


PRICE, NET = "CAST(l_extendedprice AS DECIMAL(18,2))", "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))"


@query("SELECT count(*) AS n FROM lineitem")
def q01_count(spark, d):
    return lineitem(spark, d).scan().agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CAST(sum({PRICE}) AS DOUBLE) AS total FROM lineitem")
def q02_sum(spark, d):
    return lineitem(spark, d).scan().agg(total(money("l_extendedprice")).alias("total"))


@query(f"SELECT CAST(sum({PRICE}) AS DOUBLE) AS revenue, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_discount, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS units FROM lineitem")
def q03_multi_sum(spark, d):
    return lineitem(spark, d).scan().agg(total(money("l_extendedprice")).alias("revenue"), (total(money("l_discount")) / F.count(F.lit(1))).alias("mean_discount"), total(money("l_quantity")).alias("units"))


@query(f"SELECT CAST(sum({PRICE}) AS DOUBLE) AS total FROM lineitem WHERE l_returnflag = 'R'")
def q04_filter_wide(spark, d):
    return lineitem(spark, d).scan("l_returnflag = 'R'").agg(total(money("l_extendedprice")).alias("total"))


@query(f"SELECT count(*) AS n, CAST(sum({PRICE}) AS DOUBLE) / count(*) AS avg_amount, CAST(sum({PRICE}) AS DOUBLE) AS total FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity < 2")
def q05_filter_narrow(spark, d):
    rows = lineitem(spark, d).scan("l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity < 2")
    return rows.agg(F.count(F.lit(1)).alias("n"), (total(money("l_extendedprice")) / F.count(F.lit(1))).alias("avg_amount"), total(money("l_extendedprice")).alias("total"))


@query(f"SELECT l_returnflag, count(*) AS n, CAST(sum({PRICE}) AS DOUBLE) AS revenue, CAST(sum({PRICE}) AS DOUBLE) / count(*) AS avg_amount FROM lineitem GROUP BY l_returnflag ORDER BY revenue DESC")
def q06_group_order(spark, d):
    g = lineitem(spark, d).scan().groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), total(money("l_extendedprice")).alias("revenue"), (total(money("l_extendedprice")) / F.count(F.lit(1))).alias("avg_amount"))
    return g.orderBy(F.desc("revenue"))


@query(f"SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS month, CAST(sum({PRICE}) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31' GROUP BY 1 ORDER BY 1")
def q07_date_range(spark, d):
    rows = lineitem(spark, d).scan("l_shipdate BETWEEN '1995-01-01' AND '1995-12-31'")
    return rows.groupBy(date_trunc_ntz("month", F.col("l_shipdate")).alias("month")).agg(total(money("l_extendedprice")).alias("revenue"), F.count(F.lit(1)).alias("n")).orderBy("month")


@query("SELECT min(l_orderkey) AS min_key, max(l_orderkey) AS max_key, min(l_extendedprice) AS min_amount, max(l_extendedprice) AS max_amount FROM lineitem")
def q08_two_columns(spark, d):
    return lineitem(spark, d).scan().agg(F.min("l_orderkey").alias("min_key"), F.max("l_orderkey").alias("max_key"), F.min("l_extendedprice").alias("min_amount"), F.max("l_extendedprice").alias("max_amount"))


@query("SELECT count(*) AS n FROM lineitem WHERE (l_returnflag = 'R') = TRUE")
def q09_boolean_count(spark, d):
    return lineitem(spark, d).scan("(l_returnflag = 'R') = TRUE").agg(F.count(F.lit(1)).alias("n"))


Q10_SQL = f"SELECT l_linestatus AS region, l_returnflag AS category, count(*) AS n, CAST(sum({PRICE}) AS DOUBLE) AS revenue, CAST(sum({PRICE}) AS DOUBLE) / count(*) AS mean_amount, CAST(sum({NET}) AS DOUBLE) AS net, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned FROM lineitem GROUP BY 1, 2 ORDER BY revenue DESC LIMIT 20"


@query(Q10_SQL)
def q10_analytics(spark, d):
    amount = money("l_extendedprice")
    g = lineitem(spark, d).scan().groupBy(F.col("l_linestatus").alias("region"), F.col("l_returnflag").alias("category"))
    g = g.agg(F.count(F.lit(1)).alias("n"), total(amount).alias("revenue"), (total(amount) / F.count(F.lit(1))).alias("mean_amount"), total(amount * (F.lit(1) - money("l_discount"))).alias("net"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"))
    return g.orderBy(F.desc("revenue")).limit(20)


# -- stripe tables: scans ------------------------------------------------------------------------------------


def orders_table(spark, d: str, codec: str = "zstd", rows: int = 2_000, **how) -> StripeTable:
    """orders as a stripe table, in the order of its key."""
    df = base_table(spark, d, "orders")
    t = StripeTable.create(spark, work_path(spark, "orders"), df.schema, codec, rows)
    t.insert(df, **({"cluster_by": ["o_orderkey"]} | how))
    return t


def _roundtrip(codec: str) -> Query:
    return lambda spark, d: orders_table(spark, d, codec).scan()


for _codec in ("none", "lz4", "zstd"):
    query("SELECT * FROM orders", f"scan_roundtrip_{_codec}")(_roundtrip(_codec))


@query("SELECT * FROM orders")
def scan_roundtrip_mixed(spark, d):
    df = base_table(spark, d, "orders")
    t = StripeTable.create(spark, work_path(spark, "orders"), df.schema)
    for i, codec in enumerate(("none", "lz4", "zstd")):
        t.insert(df.where(F.col("o_orderkey") % 3 == i), codec=codec)
    return t.scan()


PRUNED = {
    "lt": "o_orderkey < 500",
    "le": "o_orderkey <= 500",
    "eq": "o_orderkey = 500",
    "ge": "o_orderkey >= 14000",
    "gt": "o_orderkey > 14000",
    "between": "o_orderkey BETWEEN 4000 AND 4500",
    "commuted": "500 > o_orderkey",
    "in": "o_orderkey IN (7, 5000, 11111)",
    "and": "o_orderkey >= 1000 AND o_orderkey < 1500 AND o_orderstatus = 'O'",
    "or": "o_orderkey < 100 OR o_totalprice > 400000",
}


def _pruned(where: str) -> Query:
    return lambda spark, d: orders_table(spark, d).scan(where)


for _k, _where in PRUNED.items():
    query(f"SELECT * FROM orders WHERE {_where}", f"scan_prune_{_k}")(_pruned(_where))


@query("SELECT * FROM orders WHERE o_orderkey = 777")
def scan_point_lookup(spark, d):
    return orders_table(spark, d).lookup(o_orderkey=777)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 1000")
def scan_projection(spark, d):
    return orders_table(spark, d).scan("o_orderkey < 1000", ["o_orderkey", "o_totalprice"])


@query("SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F'")
def scan_union_all(spark, d):
    a, b = orders_table(spark, d), orders_table(spark, d, "lz4")
    return a.scan().unionByName(b.scan("o_orderstatus = 'F'"))


@query("SELECT * FROM orders")
def scan_snapshot(spark, d):
    t = orders_table(spark, d)
    before = t.version
    t.delete("o_orderkey < 1000")
    return t.scan(version=before)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def scan_cached(spark, d):
    t = orders_table(spark, d)
    t.cache()
    out = t.scan().groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return out


@query("SELECT * FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10)")
def scan_row_range(spark, d):
    df = base_table(spark, d, "orders").orderBy("o_orderkey")
    t = StripeTable.create(spark, work_path(spark, "orders"), df.schema)
    t.insert(df, ordered=True)
    return t.row_range(1, 0, 9)


@query()
def scan_sample(spark, d):
    return orders_table(spark, d).sample(0.1, 7)


@query("SELECT TRUE AS inside, TRUE AS repeatable, TRUE AS near_a_tenth")
def scan_sample_share(spark, d):
    """A sample holds rows of the table, the same ones for the same seed, and about the share asked for."""
    t = orders_table(spark, d)
    keys = lambda: t.sample(0.1, 7).select("o_orderkey")
    n, total = keys().count(), t.row_count()
    inside = keys().join(base_table(spark, d, "orders"), "o_orderkey", "left_anti").isEmpty()
    return spark.createDataFrame([(inside, keys().exceptAll(keys()).isEmpty(), 0.05 * total < n < 0.15 * total)], "inside boolean, repeatable boolean, near_a_tenth boolean")


@query("SELECT * FROM orders")
def scan_arrow_stripes(spark, d):
    """orders written as Arrow stripes in the shared folder and read again."""
    from ..sources import arrow_stripes

    arrow_stripes.register(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(work_path(spark, "arrow"))
    path = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    df = base_table(spark, d, "orders")
    df.write.format("arrow_stripes").mode("append").options(path=path, codec="zstd").save()
    return spark.read.format("arrow_stripes").schema(df.schema).load(path)


# -- stripe tables: rows in -----------------------------------------------------------------------------------


@query("SELECT * FROM orders WHERE o_totalprice > 100000")
def ins_select(spark, d):
    df = base_table(spark, d, "orders")
    t = StripeTable.create(spark, work_path(spark, "big_orders"), df.schema)
    t.insert(df.where("o_totalprice > 100000"))
    return t.scan()


@query("SELECT range AS id, 'sensor_' || (range % 10) AS sensor, CAST((range * 7919) % 10000 AS DOUBLE) / 100 AS value FROM range(1, 100001)")
def ins_generate_series(spark, d):
    t = StripeTable.create(spark, work_path(spark, "measurements"), {"id": "bigint", "sensor": "text", "value": "double precision"})
    g = F.col("g")
    t.insert(generate_series(spark, 1, 100_000, name="g").select(g.alias("id"), F.concat(F.lit("sensor_"), (g % 10).cast("string")).alias("sensor"), (((g * 7919) % 10000).cast("double") / 100).alias("value")))
    return t.scan()


@query("SELECT sensor, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_value FROM (SELECT 'sensor_' || (range % 10) AS sensor, CAST((range * 7919) % 10000 AS DOUBLE) / 100 AS value FROM range(1, 100001)) GROUP BY sensor ORDER BY sensor")
def ins_group_avg(spark, d):
    g = ins_generate_series(spark, d).groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), (total(money("value")) / F.count(F.lit(1))).alias("avg_value"))
    return g.orderBy("sensor")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def ins_csv(spark, d):
    df = base_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = work_path(spark, "nation_csv")
    write_delimited(df, path, header=True)
    t = StripeTable.create(spark, work_path(spark, "nation"), df.schema)
    t.insert_csv(path, header=True)
    return t.scan()


@query("SELECT * FROM (VALUES (CAST(1 AS INTEGER), 'a'), (2, 'b'), (3, 'c')) AS v(id, val)")
def ins_values(spark, d):
    t = StripeTable.create(spark, work_path(spark, "vals"), {"id": "int", "val": "text"})
    t.insert(spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, 'c') AS v(id, val)"))
    return t.scan()


@query("SELECT * FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_custkey, 'U', o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0")
def ins_upsert(spark, d):
    """Keys that the table holds stay, the others come in."""
    df = base_table(spark, d, "orders")
    t = StripeTable.create(spark, work_path(spark, "orders"), df.schema, rows_per_stripe=2_000)
    t.insert(df.where("o_orderkey % 3 <> 0"))
    t.upsert(df.withColumn("o_orderstatus", F.lit("U")), ["o_orderkey"])
    return t.scan()


_GEN = {i: c for i, c in enumerate(CATEGORIES, 1)}, {i: r for i, r in enumerate(REGIONS, 1)}
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
FACT_SQL = f"""SELECT g AS order_id, CAST(g % 50000 + 1 AS INTEGER) AS customer_id, CAST(g % 5000 + 1 AS INTEGER) AS product_id,
({_LIST(CATEGORIES)})[g % 10 + 1] AS category, ({_LIST(REGIONS)})[g % 5 + 1] AS region,
CAST((g * 7919) % 99900 + 100 AS DOUBLE) / 100 AS amount, CAST(g % 20 + 1 AS INTEGER) AS quantity, CAST((g * 104729) % 3001 AS DOUBLE) / 10000 AS discount,
g % 10 = 0 AS is_returned, DATE '2020-01-01' + CAST(g % 1461 AS INTEGER) AS order_date,
CAST(DATE '2020-01-01' + CAST(g % 1461 AS INTEGER) AS TIMESTAMP) + to_seconds(CAST(g % 86400 AS INTEGER)) AS created_at
FROM (SELECT range AS g FROM range(1, 1000001))"""


@query(FACT_SQL)
def ins_fact_orders(spark, d):
    df = fact_orders(spark, 1_000_000)
    t = StripeTable.create(spark, work_path(spark, "fact"), df.schema, rows_per_stripe=100_000)
    t.insert(df)
    return t.scan()


@query(f"SELECT region, category, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue, CAST(sum(CASE WHEN is_returned THEN 1 ELSE 0 END) AS BIGINT) AS returned FROM ({FACT_SQL}) GROUP BY 1, 2")
def fact_analytics(spark, d):
    return ins_fact_orders(spark, d).groupBy("region", "category").agg(F.count(F.lit(1)).alias("n"), total(money("amount")).alias("revenue"), F.sum(F.when(F.col("is_returned"), 1).otherwise(0)).alias("returned"))


@query("SELECT count(*) AS rows, count(*) > count(DISTINCT o_custkey) AS customers_twice, count(*) > count(DISTINCT o_orderkey) AS orders_twice, TRUE AS refused FROM orders")
def unique_check(spark, d):
    """Which keys the operator finds twice, and that an insert of rows with keys that are there is refused and changes nothing."""
    t = orders_table(spark, d)

    def twice(f, *args, **how) -> bool:
        try:
            f(*args, **how)
        except DuplicateKey:
            return True
        return False

    refused = twice(t.insert, base_table(spark, d, "orders"), unique=["o_orderkey"])
    row = t.row_count(), twice(t.check_unique, ["o_custkey"]), twice(t.check_unique, ["o_orderkey"]), refused
    return spark.createDataFrame([row], "rows long, customers_twice boolean, orders_twice boolean, refused boolean")


# -- stripe tables: rows out and changed ------------------------------------------------------------------------


@query("SELECT * FROM orders WHERE (o_orderkey < 1000) IS NOT TRUE")
def del_simple(spark, d):
    t = orders_table(spark, d)
    t.delete("o_orderkey < 1000")
    return t.scan()


@query("SELECT * FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 50000 OR o_orderkey % 7 = 0) IS NOT TRUE")
def del_compound(spark, d):
    t = orders_table(spark, d)
    t.delete("o_orderstatus = 'F' AND o_totalprice > 50000 OR o_orderkey % 7 = 0")
    return t.scan()


@query("SELECT * FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders) WHERE (status = 'O') IS NOT TRUE")
def del_null_cond(spark, d):
    t = StripeTable.create(spark, work_path(spark, "nullable"), {"o_orderkey": "bigint", "status": "text"})
    t.insert(base_table(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'F')").alias("status")))
    t.delete("status = 'O'")
    return t.scan()


@query("SELECT * FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0")
def del_twice(spark, d):
    t = orders_table(spark, d)
    t.delete("o_orderkey % 3 = 0")
    t.delete("o_orderkey % 5 = 0")
    return t.scan()


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders")
def upd_simple(spark, d):
    t = orders_table(spark, d)
    t.update({"o_orderstatus": "'X'", "o_totalprice": "o_totalprice * 2"}, "o_orderkey % 10 = 0")
    return t.scan()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, coalesce(c_mktsegment, o_orderpriority) AS o_orderpriority FROM orders LEFT JOIN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey")
def upd_from_subquery(spark, d):
    t = orders_table(spark, d)
    rich = base_table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    t.update_from(rich, ["o_custkey"], {"o_orderpriority": "src.c_mktsegment"})
    return t.scan()


@query("SELECT * FROM orders")
def trunc_then_insert(spark, d):
    t = orders_table(spark, d)
    t.truncate()
    t.insert(base_table(spark, d, "orders"))
    return t.scan()


# -- stripe tables: maintenance ---------------------------------------------------------------------------------


@query("SELECT * FROM orders WHERE o_orderkey >= 2500")
def vacuum_rows(spark, d):
    t = orders_table(spark, d)
    t.delete("o_orderkey < 2500")
    t.vacuum()
    return t.scan()


@query("SELECT * FROM orders WHERE o_orderkey % 4 <> 1")
def compact_rows(spark, d):
    t = orders_table(spark, d)
    t.delete("o_orderkey % 4 = 1")
    t.compact()
    return t.scan()


@query("SELECT * FROM orders WHERE o_orderkey % 4 <> 1")
def rebuild_rows(spark, d):
    """The table's manifests are deleted; what they held comes from its folder."""
    t = orders_table(spark, d)
    t.delete("o_orderkey % 4 = 1")
    t.store.delete("_manifest")
    t = StripeTable(spark, t.path)
    t.rebuild_metadata()
    return t.scan()


@query("SELECT count(*) AS rows_total FROM orders WHERE o_orderkey % 4 <> 1")
def rebuild_count(spark, d):
    t = orders_table(spark, d)
    t.delete("o_orderkey % 4 = 1")
    return t.rebuild_metadata().select("rows_total")


@query("SELECT CAST(ceil(count(*) / 1000.0) AS INTEGER) AS stripes_compacted, CAST(count(*) FILTER (WHERE (rn - 1) % 1000 >= 10) AS BIGINT) AS rows_compacted FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)")
def compact_counts(spark, d):
    """Of stripes of 1,000 rows the first ten rows go, so that each of them is rewritten."""
    df = base_table(spark, d, "orders").orderBy("o_orderkey")
    t = StripeTable.create(spark, work_path(spark, "orders"), df.schema, rows_per_stripe=1_000)
    t.insert(df, ordered=True)
    t.delete_range(0, 9)
    return t.compact()


@query("SELECT CAST(ceil(count(*) / 1000.0) AS BIGINT) AS stripes, count(*) AS rows, CAST(0 AS BIGINT) AS deleted FROM orders")
def stripe_info_summary(spark, d):
    info = orders_table(spark, d, rows=1_000, cluster_by=None, ordered=True).stripe_info()
    return info.agg(F.count(F.lit(1)).alias("stripes"), F.sum("row_count").alias("rows"), F.sum("deleted_rows").alias("deleted"))


@query("SELECT 'o_orderkey' AS column_name, count(*) AS row_count, CAST(0 AS BIGINT) AS null_count, count(DISTINCT o_orderkey) AS n_distinct, CAST(min(o_orderkey) AS VARCHAR) AS min_value, CAST(max(o_orderkey) AS VARCHAR) AS max_value FROM orders UNION ALL SELECT 'o_orderstatus', count(*), 0, count(DISTINCT o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders")
def analyze_stats(spark, d):
    return orders_table(spark, d).analyze(["o_orderkey", "o_orderstatus"]).drop("histogram", "most_common")


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def analyze_common(spark, d):
    """The three most common values, as ANALYZE keeps them."""
    return orders_table(spark, d).analyze(["o_orderpriority"], top=3).select(F.explode("most_common").alias("v")).select("v.value", F.col("v.count").alias("n"))


@query("SELECT CAST(i AS INTEGER) AS i, CAST(greatest(1, 25 * i) AS DOUBLE) AS bound FROM range(0, 5) AS r(i)")
def analyze_histogram(spark, d):
    """Bounds of four buckets of 1 to 100."""
    t = StripeTable.create(spark, work_path(spark, "hundred"), {"k": "bigint"})
    t.insert(generate_series(spark, 1, 100, name="k"))
    return t.analyze(["k"], buckets=4).select(F.posexplode("histogram").alias("i", "bound"))


@query("SELECT * FROM orders WHERE o_orderkey % 100 = 3")
def ins_cluster_expression(spark, d):
    """Stripes in the order of an expression, as an index on one would have it, and of a part of the rows."""
    df = base_table(spark, d, "orders")
    t = StripeTable.create(spark, work_path(spark, "orders"), df.schema, rows_per_stripe=1_000)
    t.insert(df.where("o_orderkey % 100 = 3"), cluster_by=[F.expr("o_orderkey % 7"), "o_orderkey"])
    t.insert(df.where("o_orderkey % 100 <> 3"))
    return t.scan("o_orderkey % 100 = 3")


@query("SELECT * FROM orders")
def optimize_rows(spark, d):
    t = orders_table(spark, d)
    t.optimize(["o_totalprice"])
    return t.scan()


@query("SELECT TRUE AS covers_stripes, TRUE AS covers_metadata, CAST(0 AS BIGINT) AS after_drop")
def relation_size(spark, d):
    t = orders_table(spark, d)
    stripes = t.stripe_info().agg(F.sum("file_size")).first()[0]
    size = t.relation_size()
    t.drop()
    return spark.createDataFrame([(size >= stripes, size > stripes, t.relation_size())], "covers_stripes boolean, covers_metadata boolean, after_drop long")


@query("SELECT CAST(1 AS BIGINT) AS ipc_hits, CAST(2 AS BIGINT) AS ipc_misses, TRUE AS cached, CAST(2 * count(*) + count(*) FILTER (WHERE o_orderkey < 500) AS BIGINT) AS rows FROM orders")
def cache_stats(spark, d):
    """Of three scans, two of the same stripes."""
    t = orders_table(spark, d, ordered=True, cluster_by=None, rows=100)
    t.cache()
    rows = sum(t.scan(w).count() for w in (None, None, "o_orderkey < 500"))
    row = t.cache_stats().first()
    t.uncache()
    return spark.createDataFrame([(row.ipc_hits, row.ipc_misses, row.ipc_bytes_cached > 0, rows)], "ipc_hits long, ipc_misses long, cached boolean, rows long")


@query("SELECT 'o_orderkey < 500' AS quals, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS stripes_total, CAST(ceil(count(*) / 1000.0) - ceil(count(*) FILTER (WHERE o_orderkey < 500) / 1000.0) AS BIGINT) AS stripes_skipped FROM orders")
def explain_report(spark, d):
    df = base_table(spark, d, "orders").orderBy("o_orderkey")
    t = StripeTable.create(spark, work_path(spark, "orders"), df.schema, rows_per_stripe=1_000)
    t.insert(df, ordered=True)
    r = t.explain("o_orderkey < 500 AND upper(o_orderstatus) = 'O'")
    return spark.createDataFrame([(" AND ".join(r.quals), r.total, r.skipped)], "quals string, stripes_total long, stripes_skipped long")


@query("SELECT count(*) AS n, TRUE AS gone FROM orders")
def drop_table(spark, d):
    t = orders_table(spark, d)
    n = t.row_count()
    t.drop()
    return spark.createDataFrame([(n, not is_stripe_table(spark, t.path))], "n long, gone boolean")


@query("SELECT count(*) AS rows, TRUE AS has_pages FROM orders")
def estimate(spark, d):
    rows, pages = orders_table(spark, d).estimate()
    return spark.createDataFrame([(rows, pages > 0)], "rows long, has_pages boolean")


@query("SELECT CAST(2 * count(*) AS BIGINT) AS rows, count(*) AS read_before FROM orders")
def metadata_versions(spark, d):
    """A handle sees what another commits, and goes on reading the version before."""
    a = orders_table(spark, d)
    before = a.version
    StripeTable.open(spark, a.path).insert(base_table(spark, d, "orders"))
    return spark.createDataFrame([(a.row_count(), a.scan(version=before).count())], "rows long, read_before long")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name NOT LIKE 'between%' AND c_mktsegment = 'BUILDING'")
def scan_prune_function(spark, d):
    """Functions of three arguments, and strings that hold between, aren't taken for BETWEEN."""
    df = base_table(spark, d, "customer")
    t = StripeTable.create(spark, work_path(spark, "customer"), df.schema, rows_per_stripe=100)
    t.insert(df, cluster_by=["c_name"])
    return t.scan("like(c_name, 'C%', '/') AND NOT like(c_name, 'between%', '/') AND replace(c_mktsegment, 'between', '') = c_mktsegment AND c_mktsegment = 'BUILDING'", ["c_custkey", "c_name"])


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-03-01'")
def scan_prune_date_text(spark, d):
    return orders_table(spark, d, cluster_by=["o_orderdate"]).scan("o_orderdate >= '1998-01-01' AND o_orderdate < '1998-03-01'", ["o_orderkey", "o_orderdate"])


@query("SELECT * FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey IS NOT NULL AND o_orderpriority > '2'")
def scan_prune_unusable(spark, d):
    """Conditions that prune nothing, or hold for no stripe alone."""
    return orders_table(spark, d).scan("o_orderstatus <> 'F' AND o_orderkey IS NOT NULL AND o_orderpriority > '2' AND (o_orderkey = NULL) IS NOT TRUE")


@query("SELECT o_orderkey, nullif(o_orderkey % 2, 0) AS odd, o_orderkey % 3 = 0 AS third FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 = 0")
def scan_prune_nulls(spark, d):
    """A column that is null in whole stripes, and one of truth values."""
    df = base_table(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderkey % 2, 0)").alias("odd"), F.expr("o_orderkey % 3 = 0").alias("third"))
    t = StripeTable.create(spark, work_path(spark, "odd"), df.schema, rows_per_stripe=1_000)
    t.insert(df, cluster_by=["odd", "o_orderkey"])
    return t.scan("odd = 1 AND third = TRUE")


# -- functions written by the user --------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice * 1.5 + 1 AS raised FROM orders")
def fn_udf(spark, d):
    @F.pandas_udf("double")
    def raised(x: pd.Series) -> pd.Series:
        return x * 1.5 + 1

    return orders_table(spark, d).scan().select("o_orderkey", raised("o_totalprice").alias("raised"))


@query("SELECT o_orderstatus, CAST(max(o_orderkey) - min(o_orderkey) AS BIGINT) AS spread FROM orders GROUP BY o_orderstatus")
def fn_udaf(spark, d):
    """An aggregate in Python, over what each group and task have been summed up to before."""
    @F.pandas_udf("long")
    def spread(lo: pd.Series, hi: pd.Series) -> int:
        return int(hi.max() - lo.min())

    parts = orders_table(spark, d).scan().groupBy("o_orderstatus", F.spark_partition_id().alias("p")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    return parts.groupBy("o_orderstatus").agg(spread("lo", "hi").alias("spread"))


@query("SELECT count(*) AS n, TRUE AS within, TRUE AS spread FROM orders")
def fn_random(spark, d):
    """random() is in 0 to 1 and differs from row to row."""
    r = orders_table(spark, d).scan().select(F.rand(3).alias("r"))
    return r.agg(F.count(F.lit(1)).alias("n"), ((F.min("r") >= 0) & (F.max("r") < 1)).alias("within"), (F.approx_count_distinct("r") > 0.8 * F.count("r")).alias("spread"))


@query("SELECT count(*) AS n FROM events WHERE ts < CAST(now() AS TIMESTAMP) - INTERVAL '1' HOUR")
def fn_now_interval(spark, d):
    return base_table(spark, d, "events").where("ts < localtimestamp() - INTERVAL '1' HOUR").agg(F.count(F.lit(1)).alias("n"))


# -- relational surface -----------------------------------------------------------------------------------------

VIEWS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def both(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        register(spark, d, VIEWS)
        return spark.sql(spark_sql)

    query(duck_sql or spark_sql, name)(run)


both("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
both("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
both("join_right", "SELECT n_name, c_custkey FROM (SELECT * FROM customer WHERE c_acctbal > 9000) RIGHT JOIN nation ON c_nationkey = n_nationkey")
both("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20")
both("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
both("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
for _hint in ("MERGE", "SHUFFLE_HASH", "BROADCAST"):
    _plain = "o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0"
    both(f"join_hint_{_hint.lower()}", f"SELECT /*+ {_hint}(customer) */ {_plain}", f"SELECT {_plain}")
both("join_theta", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey < n_regionkey")
both("join_lateral", "SELECT n_name, c_name FROM nation, LATERAL (SELECT c_name FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9500)")
both("join_cross_const", "SELECT n_name, r_name FROM nation CROSS JOIN (SELECT r_name FROM region WHERE r_regionkey = 0)")
both("win_rank", "SELECT o_custkey, o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS BIGINT) AS rn, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus)")
both("win_lag", "SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id) OVER w AS next, first_value(event_id) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
both("win_nth", "SELECT o_orderkey, nth_value(o_orderkey, 2) OVER w AS second, last_value(o_orderkey) OVER w AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
both("win_frame_rows", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS top FROM orders")
both("win_frame_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS n FROM orders")
both("win_ntile", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS quarter FROM customer")
both("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
both("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
both("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
both("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
both("grp_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("grp_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
both("grp_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
both("grp_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus")
both("grp_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
both("grp_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(*) AS n FROM orders GROUP BY o_orderstatus")
both("grp_stats", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS cr FROM lineitem GROUP BY l_returnflag")
both("grp_percentile", "SELECT o_orderstatus, percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS median FROM orders GROUP BY o_orderstatus")
both("grp_listagg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
both("grp_array", "SELECT n_regionkey, array_join(array_sort(array_agg(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), ',') AS names FROM nation GROUP BY n_regionkey")
both("grp_bool", "SELECT o_custkey, bool_or(o_totalprice > 300000) AS some, bool_and(o_totalprice > 1000) AS every FROM orders GROUP BY o_custkey")
both("grp_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderkey < 0")
both("sub_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
both("sub_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
both("sub_in", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
both("sub_cte", "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers FROM t GROUP BY n")
both("sub_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, n * n AS sq FROM t")
both("ord_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
both("ord_distinct_on", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
both("ord_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
both("fn_string", "SELECT c_custkey, upper(c_name) AS u, substring(c_name, 1, 4) AS s, c_name || '-' || c_mktsegment AS c, CAST(length(c_name) AS BIGINT) AS n, trim('  x ') AS t, replace(c_name, '0', 'o') AS r, lpad(c_mktsegment, 12, '*') AS l FROM customer")
both("fn_regex", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS r, p_type LIKE '%BRASS%' AS brass FROM part", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r, p_type LIKE '%BRASS%' AS brass FROM part")
both("fn_date", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, CAST(o_orderdate AS DATE) + INTERVAL '10' DAY AS later FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, datediff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS days, CAST(CAST(o_orderdate AS DATE) + INTERVAL '10' DAY AS DATE) AS later FROM orders")
both("fn_math", "SELECT o_orderkey, abs(o_totalprice) AS a, sqrt(o_totalprice) AS s, round(o_totalprice, 1) AS r, CAST(floor(o_totalprice) AS BIGINT) AS f, CAST(ceil(o_totalprice) AS BIGINT) AS c, o_orderkey % 7 AS m, power(2, o_orderkey % 10) AS p FROM orders")
both("fn_conditional", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 10000 THEN 'mid' ELSE 'small' END AS size, coalesce(nullif(o_orderstatus, 'F'), 'done') AS st, greatest(o_orderkey, o_custkey) AS g, least(o_orderkey, o_custkey) AS l FROM orders")
both("fn_array", "SELECT n_nationkey, element_at(array('a', 'b', 'c'), CAST(n_nationkey % 3 + 1 AS INT)) AS e, CAST(size(array(1, 2, 3)) AS BIGINT) AS n FROM nation", "SELECT n_nationkey, (['a', 'b', 'c'])[n_nationkey % 3 + 1] AS e, len([1, 2, 3]) AS n FROM nation")
both("fn_array_more", "SELECT n_nationkey, array_join(array_sort(split(n_name, '_')), ',') AS parts, CAST(array_position(split(n_name, '_'), 'NATION') AS BIGINT) AS at, array_contains(split(n_name, '_'), '1') AS one FROM nation", "SELECT n_nationkey, array_to_string(list_sort(string_split(n_name, '_')), ',') AS parts, CAST(coalesce(list_position(string_split(n_name, '_'), 'NATION'), 0) AS BIGINT) AS at, list_contains(string_split(n_name, '_'), '1') AS one FROM nation")
both("fn_regex_more", "SELECT p_partkey, regexp_extract(p_type, '([A-Z]+)$', 1) AS last, CAST(regexp_count(p_name, '[aeiou]') AS BIGINT) AS vowels, p_type RLIKE '^S' AS s FROM part", "SELECT p_partkey, regexp_extract(p_type, '([A-Z]+)$', 1) AS last, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS BIGINT) AS vowels, regexp_matches(p_type, '^S') AS s FROM part")
both("fn_string_more", "SELECT c_custkey, CAST(position('#' IN c_name) AS BIGINT) AS at, reverse(c_name) AS rev, left(c_name, 3) AS l, right(c_name, 3) AS r, repeat('ab', 2) AS rep, split_part(c_name, '#', 2) AS num, md5(c_name) AS h, CAST(ascii(c_name) AS BIGINT) AS a FROM customer", "SELECT c_custkey, CAST(position('#' IN c_name) AS BIGINT) AS at, reverse(c_name) AS rev, left(c_name, 3) AS l, right(c_name, 3) AS r, repeat('ab', 2) AS rep, split_part(c_name, '#', 2) AS num, md5(c_name) AS h, CAST(ascii(c_name) AS BIGINT) AS a FROM customer")
both("fn_json", "SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")


@query("SELECT o_orderkey, o_custkey // 7 AS q, CAST(round(o_totalprice) AS INTEGER) AS r, (['a', 'b', 'c', 'd', 'e'])[o_orderkey % 5 + 1] AS pick, CAST(o_orderdate AS DATE) + 30 AS due FROM orders")
def fn_host_semantics(spark, d):
    o = base_table(spark, d, "orders")
    return o.select("o_orderkey", int_div(F.col("o_custkey"), F.lit(7).cast("long")).alias("q"), round_to_int(F.col("o_totalprice")).alias("r"), array_get(list("abcde"), F.col("o_orderkey") % 5 + 1).alias("pick"), add_days(F.col("o_orderdate").cast("date"), 30).alias("due"))
