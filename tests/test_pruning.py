"""A pruned scan has the rows of a full one, whatever the bounds hold."""

import datetime as dt
import math
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from lamina.bounds import encode_bounds
from lamina.manifest import Manifest, Stripe
from lamina.operators.table import StripeTable
from lamina.plans.pruning import Conjunct, conjuncts_of, excludes, prune

OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b}


def stripe(kind, values):
    real = [v for v in values if v is not None]
    key = (lambda v: (math.isnan(v), v)) if kind == "float" else None
    low, high = (min(real, key=key), max(real, key=key)) if real else (None, None)
    a, b, nan = encode_bounds(kind, low, high)
    return Stripe(1, "f", len(values), 1, "zstd", 0, {"c": [a, b, len(values) - len(real), nan]})


def spark_compare(op, a, b):
    """NaN is equal to itself and greater than all else."""
    if isinstance(a, float) and math.isnan(a):
        return op in (">", ">=")
    return OPS[op](a, b)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(width=32)), min_size=1, max_size=6), st.sampled_from(list(OPS)), st.one_of(st.floats(allow_nan=False), st.integers(-5, 5), st.decimals(allow_nan=False, allow_infinity=False, places=2, min_value=-99, max_value=99)))
def test_floats(values, op, k):
    hit = any(v is not None and spark_compare(op, v, float(k)) for v in values)
    assert not (hit and excludes(stripe("float", values), "float", Conjunct("c", op, k)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), min_size=1, max_size=6), st.sampled_from(list(OPS)), st.one_of(st.integers(-(2**63), 2**63 - 1), st.floats(-1e19, 1e19)))
def test_integers(values, op, k):
    same = (lambda v: float(v)) if isinstance(k, float) else (lambda v: v)  # a bigint is compared with a double as a double
    hit = any(v is not None and OPS[op](same(v), k) for v in values)
    assert not (hit and excludes(stripe("int", values), "int", Conjunct("c", op, k)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dates(), min_size=1, max_size=5), st.sampled_from(list(OPS)), st.one_of(st.dates(), st.datetimes()))
def test_dates(values, op, k):
    up = (lambda v: dt.datetime.combine(v, dt.time())) if isinstance(k, dt.datetime) else (lambda v: v)
    hit = any(OPS[op](up(v), k) for v in values)
    assert not (hit and excludes(stripe("date", values), "date", Conjunct("c", op, k)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=5), st.sampled_from(list(OPS)), st.text(max_size=80))
def test_strings(values, op, k):
    hit = any(OPS[op](v.encode(), k.encode()) for v in values)
    values.sort(key=str.encode)
    a, b, _ = encode_bounds("string", values[0], values[-1])
    s = Stripe(1, "f", len(values), 1, "zstd", 0, {"c": [a, b, 0, False]})
    assert not (hit and excludes(s, "string", Conjunct("c", op, k)))


def test_truth_table():
    s = stripe("int", [5, 9])
    skipped = {(op, k) for op in OPS for k in range(3, 12) if excludes(s, "int", Conjunct("c", op, k))}
    assert skipped == {("<", 3), ("<", 4), ("<", 5), ("<=", 3), ("<=", 4), ("=", 3), ("=", 4), ("=", 10), ("=", 11), (">=", 10), (">=", 11), (">", 9), (">", 10), (">", 11)}


def test_nulls_and_unknowns():
    assert excludes(stripe("int", [None, None]), "int", Conjunct("c", "=", 1))
    assert excludes(stripe("int", [1]), "int", Conjunct("c", "is_null"))
    assert not excludes(stripe("int", [1, None]), "int", Conjunct("c", "is_null"))
    assert excludes(stripe("int", [None]), "int", Conjunct("c", "is_not_null"))
    assert excludes(stripe("int", [5, 6]), "int", Conjunct("c", "in", (1, None, 9)))
    assert not excludes(stripe("int", [5]), "int", Conjunct("c", "=", "5"))
    assert not excludes(stripe("int", [5]), "int", Conjunct("c", "=", None))
    assert not excludes(stripe("timestamp", [dt.datetime(2020, 1, 1)]), "timestamp", Conjunct("c", ">", dt.datetime(2021, 1, 1, tzinfo=dt.timezone.utc)))
    m = Manifest.of(T.StructType([T.StructField("c", T.LongType())]), [stripe("int", [1]), Stripe(2, "g", 3, 1, "zstd")])
    kept, report = prune(m, [Conjunct("c", ">", 5), Conjunct("other", "=", 1)])
    assert [s.id for s in kept] == [2] and report.skipped == 1 and report.quals == ["c > 5"]


def test_conditions_in_sql(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("d", T.DateType()), T.StructField("x", T.DoubleType())])
    got = lambda s: [(c.column, c.op, c.value) for c in conjuncts_of(spark, s, schema)]
    assert got("id < 5 AND 3 <= id") == [("id", "<", 5), ("id", ">=", 3)]
    assert got("ID BETWEEN 1 AND 9") == [("id", ">=", 1), ("id", "<=", 9)]
    assert got("d = DATE '2020-02-01'") == [("d", "=", dt.date(2020, 2, 1))]
    assert got("x > 1.5") == [("x", ">", Decimal("1.5"))]
    assert got("id IN (1, 2)") == [("id", "in", (1, 2))]
    assert got("id IS NULL") == [("id", "is_null", None)]
    assert got("id = 1 OR id = 2") == [] and got("id <> 1") == [] and got("id = x") == [] and got("abs(id) = 1") == []
    assert got("like(id, 'between%', '/')") == [] and got("overlay(id, 'between', 3)") == [] and got("`between`(id, 1, 9)") == [("id", ">=", 1), ("id", "<=", 9)]
    assert got("d >= '2020-02-01'") == [("d", ">=", dt.date(2020, 2, 1))] and got("d BETWEEN '2020-02-01' AND 'x'") == [("d", ">=", dt.date(2020, 2, 1)), ("d", "<=", "x")]


WORDS = ["between us", "zeta", "a", "", "2020-02-01", "BETWEEN", None]
DAYS = ["2019-12-31", "2020-02-01", "2020-06-15", "2021-01-01"]


def conditions():
    text = st.sampled_from([w for w in WORDS if w is not None] + ["between%", "%e%", "b"])
    day = st.sampled_from([*DAYS, "2020-02-01 10:00:00", "2020-02-30", "junk"])
    op = st.sampled_from(list(OPS))
    leaf = st.one_of(
        st.builds("name {} '{}'".format, op, text),
        st.builds("like(name, '{}', '/')".format, text),
        st.builds("replace(name, '{}', 'x') = name".format, text),
        st.builds("startswith(name, '{}')".format, text),
        st.builds("translate(name, 'between', '{}') = name".format, text),
        st.builds("name BETWEEN '{}' AND '{}'".format, text, text),
        st.builds("coalesce(name, 'between', '{}') = name".format, text),
        st.builds("id BETWEEN {} AND {}".format, st.integers(0, 30), st.integers(0, 30)),
        st.builds("if(id > {}, true, name = 'between')".format, st.integers(0, 30)),
        st.builds("try_cast(d AS string) {} '{}'".format, op, day),
        st.builds("d {} DATE '{}'".format, op, st.sampled_from(DAYS)),
        st.builds("d {} '{}'".format, op, st.sampled_from(DAYS)),
        st.builds("d IN ('{}', '{}')".format, st.sampled_from(DAYS), st.sampled_from(DAYS)),
        st.builds("at {} '{}'".format, op, st.sampled_from([*DAYS, "2020-02-01 10:00:00", "2020-02-01 10:00:00.5"])),
        st.builds("tz {} '{}'".format, op, st.sampled_from([*DAYS, "2020-02-01 10:00:00"])),
        st.builds("at BETWEEN '{}' AND '{}'".format, st.sampled_from(DAYS), st.sampled_from(DAYS)),
    )
    return st.one_of(leaf, st.builds("{} AND {}".format, leaf, leaf), st.builds("({} OR {})".format, leaf, leaf), st.builds("NOT ({})".format, leaf))


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    rows = [(i, WORDS[i // 4 % len(WORDS)], dt.date.fromisoformat(DAYS[i // 7]), dt.datetime.fromisoformat(DAYS[i // 7]) + dt.timedelta(hours=i), dt.datetime.fromisoformat(DAYS[i // 7]) + dt.timedelta(hours=i)) for i in range(28)]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("d", T.DateType()), T.StructField("at", T.TimestampNTZType()), T.StructField("tz", T.TimestampType())])
    t = StripeTable.create(spark, str(tmp_path_factory.mktemp("mixed") / "t"), schema, rows_per_stripe=4)
    df = spark.createDataFrame(rows, schema)
    t.insert(df, ordered=True)
    return t, df.cache()


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(where=conditions())
def test_conditions_give_the_same_rows_pruned_and_full(mixed, where):
    t, df = mixed
    want = sorted(r.id for r in df.where(where).collect())
    assert sorted(r.id for r in t.scan(where).collect()) == want


def test_string_literals_prune_dates(mixed):
    t, _ = mixed
    for where in ("d >= '2021-01-01'", "at >= '2021-01-01'", "tz >= '2021-01-01'", "d BETWEEN '2019-01-01' AND '2019-12-31'"):
        assert t.explain(where).skipped > 0, where
