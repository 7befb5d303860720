import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions.arithmetic import day_number, is_code, mentions
from tessera.functions.positions import numbered, with_next
from tessera.operators import aggregates as A
from tessera.operators import boundaries as B
from tessera.operators import indexes as I
from tessera.operators import ordering as O
from tessera.operators import relational as R
from tessera.operators import sets as S
from tessera.schema import UnknownColumn
from tests.conftest import rows


def df(spark, data, cols):
    types = ", ".join(f"`{c}` long" for c in cols)
    return spark.createDataFrame(data, types)


def test_project_orders_and_keeps_repeats(spark):
    d = df(spark, [(1, 2, 3), (1, 2, 3)], "abc")
    assert R.project(d, ["c", "a"]).columns == ["c", "a"]
    assert rows(R.project(d, ["c", "a"])) == [(3, 1), (3, 1)]
    with pytest.raises(UnknownColumn):
        R.project(d, ["z"])


def test_filters(spark):
    d = df(spark, [(1, 1), (2, 5), (7, 5), (None, 5)], "ab")
    assert rows(R.where(d, "b", "==", scalar=5)) == [(2, 5), (7, 5), (None, 5)]
    assert rows(R.where(d, "a", "<", scalar=2)) == [(1, 1)]
    assert rows(R.where(d, "a", "<", other="b")) == [(2, 5)]
    assert rows(R.where(d, "a", "==", other="b")) == [(1, 1)]
    with pytest.raises(ValueError):
        R.where(d, "a", "<")
    with pytest.raises(ValueError):
        R.where(d, "a", "like", scalar=1)


def test_filter_by_keeps_repeats_and_nulls(spark):
    d, k = df(spark, [(1, 10), (1, 10), (2, 20), (None, 30)], "ab"), df(spark, [(1,), (1,), (3,)], "k")
    assert rows(R.keep_listed(d, "a", k)) == [(1, 10), (1, 10)]
    assert rows(R.keep_listed(d, "a", k, negate=True)) == [(2, 20), (None, 30)]
    with pytest.raises(ValueError):
        R.keep_listed(d, "a", d)


def test_column_names_may_be_digits(spark):
    d = df(spark, [(1, 4), (2, 4)], ["0", "12"])
    assert rows(R.where(R.project(d, ["12", "0"]), "0", "<", other="12")) == [(4, 1), (4, 2)]
    assert rows(A.count_by(d, ["12"], "total")) == [(4, 2)]


def test_arithmetic(spark):
    d = df(spark, [(7, 2), (-7, 2)], "ab")
    assert rows(R.multiply(d, "a", ["a", "b", 3])) == [(-42, 2), (42, 2)]
    assert rows(R.multiply(d, "c", ["a", 2, 5])) == [(-7, 2, -70), (7, 2, 70)]
    assert rows(R.divide(d, "a", ["a", "b"])) == [(-3, 2), (3, 2)]
    assert rows(R.divide(d, "c", ["a", "b"], floats=True)) == [(-7, 2, -3.5), (7, 2, 3.5)]
    with pytest.raises(ValueError):
        R.multiply(d, "a", [3, "a"])
    with pytest.raises(ValueError):
        R.multiply(d, "b", ["a", 2])


def test_division_by_zero(spark):
    d = df(spark, [(7, 0)], "ab")
    assert rows(R.divide(d, "c", ["a", "b"], on_zero="null")) == [(7, 0, None)]
    with pytest.raises(PySparkException):
        R.divide(d, "c", ["a", "b"]).collect()


def test_overflow_raises(spark):
    d = df(spark, [(2**62, 4)], "ab")
    with pytest.raises(PySparkException):
        R.multiply(d, "a", ["a", "b"]).collect()


def test_join_column_order_and_bag(spark):
    left, right = df(spark, [(1, 1, 5), (2, 1, 6), (2, 1, 6)], ["x", "k", "y"]), df(spark, [(9, 1), (8, 1), (7, 2)], ["z", "q"])
    j = R.join(left, right, ["k"], ["q"])
    assert j.columns == ["k", "x", "y", "z"] and j.count() == 6
    assert rows(R.join(left, right, ["k"], ["q"], salt=3)) == rows(j)
    with pytest.raises(ValueError):
        R.join(left, left, ["k"], ["k"])


def parts_of(result):
    return [r["count"] for r in result.groupBy(F.spark_partition_id().alias("part")).count().collect()]


@pytest.mark.parametrize("most", [1, 3, 40, 10**9])
def test_a_spread_join_is_the_join(spark, most):
    left = df(spark, [(1, i % 9) for i in range(30)] + [(2, 7), (2, 7), (3, 1), (None, 1), (4, None)] + [(5, 5)] * 6, "kv")
    right = df(spark, [(1, i) for i in range(8)] + [(2, i) for i in range(20)] + [(4, None), (5, 1), (5, 1), (6, 1), (None, 2)], "qw")
    assert rows(R.join(left, right, ["k"], ["q"], spread=most)) == rows(R.join(left, right, ["k"], ["q"]))
    assert rows(R.join(right, left, ["q"], ["k"], spread=most)) == rows(R.join(right, left, ["q"], ["k"]))
    assert rows(R.join(left, right, ["k", "v"], ["q", "w"], spread=most)) == rows(R.join(left, right, ["k", "v"], ["q", "w"]))
    assert R.join(left.where("k > 9"), right, ["k"], ["q"], spread=most).count() == 0


def test_a_spread_join_is_dealt_by_rows_of_its_result(spark):
    left, right = df(spark, [(1, i) for i in range(300)], "kv"), df(spark, [(1, i) for i in range(200)], "qw")
    assert max(parts_of(R.join(left, right, ["k"], ["q"]))) == 60_000
    found = R.join(left, right, ["k"], ["q"], spread=1000)
    parts = parts_of(found)
    assert sum(parts) == 60_000 and len(parts) > 20 and max(parts) < 10_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 4  # each side before its rows are copied, and after
    with pytest.raises(ValueError):
        R.join(left, right, ["k"], ["q"], spread=0)
    with pytest.raises(ValueError):
        R.join(left, right.withColumn("q", F.col("q").cast("string")), ["k"], ["q"], spread=10)


def test_join_on_several_keys_and_nulls(spark):
    a, b = df(spark, [(1, 2, 3), (1, None, 4)], "abc"), df(spark, [(1, 2, 5), (1, None, 6)], "xyz")
    assert rows(R.join(a, b, ["a", "b"], ["x", "y"])) == [(1, 2, 3, 5)]


def test_pub_join_repeats_rows_as_the_join_does(spark):
    a, b = df(spark, [(2, 7), (1, 8), (3, 9)], "kv"), df(spark, [(1,), (1,), (2,)], "k")
    assert [tuple(r) for r in R.aligned_with_join(a, "k", b, "k").collect()] == [(1, 8), (1, 8), (2, 7)]


def test_aggregates(spark):
    d = df(spark, [(1, 1, 2), (1, 1, 4), (2, 1, -5), (2, 2, 5)], "gha")
    assert rows(A.aggregate(d, ["g"], "a", "sum", "t")) == [(1, 6), (2, 0)]
    assert rows(A.aggregate(d, ["g", "h"], "a", "sum", "t", salt=4)) == [(1, 1, 6), (2, 1, -5), (2, 2, 5)]
    assert rows(A.count_by(d, ["g"], "n")) == [(1, 2), (2, 2)]
    assert rows(A.aggregate(d, ["g"], None, "count", "n", salt=3)) == [(1, 2), (2, 2)]
    assert rows(A.aggregate(d, ["g"], "a", "mean", "m")) == [(1, 3.0), (2, 0.0)]
    assert rows(A.aggregate(d, ["g"], "a", "std_dev", "m")) == [(1, 1.0), (2, 25.0)]
    assert rows(A.aggregate(d, ["g"], "a", "stddev_pop", "m")) == [(1, 1.0), (2, 5.0)]
    assert rows(A.weighted_mean(df(spark, [(1, 7, 2), (1, 8, 2)], "gan"), ["g"], "a", "n", "m")) == [(1, 3)]
    with pytest.raises(ValueError):
        A.aggregate(d, ["g"], "a", "median", "m")
    with pytest.raises(ValueError):
        A.aggregate(d, ["g"], "a", "count", "m")


def test_global_counts(spark):
    d = df(spark, [(1,), (1,), (None,)], "a")
    assert rows(A.distinct_count(d, "a")) == [(1,)] and A.distinct_count(d, "a").columns == ["a"]
    assert rows(A.row_count(d)) == [(3,)]
    assert rows(A.row_count(d.limit(0))) == [(0,)]


def test_index_aggregates_keep_zero_groups(spark):
    d = df(spark, [(0, 5, 3), (1, 6, -2), (2, 5, -3)], ["index", "g", "a"])
    m = df(spark, [(0, 0), (2, 0), (1, 1)], ["row_idx", "key_idx"])
    assert rows(A.index_aggregate(d, ["g"], "a", "t", m)) == [(5, 0), (6, -2)]
    keys = df(spark, [(0, 5), (1, 6)], ["key_idx", "g"])
    assert rows(A.leaky_index_aggregate(d, "a", "t", m, keys)) == [(5, 0), (6, -2)]


def test_order(spark):
    d = df(spark, [(3, 1), (1, 2), (2, 3)], "ab")
    assert [r.a for r in O.sort_by(d, "a").collect()] == [1, 2, 3]
    assert rows(O.limit(d, 2, ["a"])) == [(1, 2), (2, 3)]
    assert rows(O.index(d, order_by=["a"])) == [(0, 1, 2), (1, 2, 3), (2, 3, 1)]
    assert rows(O.shuffle(d, 1)) == rows(d)
    assert [tuple(r) for r in O.unpermute(d, "b", order_by=["a"]).collect()] == [(2, 3, 1), (0, 1, 2), (1, 2, 3)]
    with pytest.raises(ValueError):
        O.index(d, "a")


def test_index_without_order_follows_the_scan(spark):
    d = spark.range(0, 100, 1, 7)
    assert rows(O.index(d)) == [(i, i) for i in range(100)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.integers(-3, 3)), max_size=30))
def test_numbers_and_neighbours(spark, values):
    d = df(spark, [(v,) for v in values], "a")
    ordered = sorted(values, key=lambda v: (v is not None, v or 0))
    assert [tuple(r) for r in numbered(d, ["a"]).orderBy("index").collect()] == list(enumerate(ordered))
    got = with_next(d, "a", ["a"]).orderBy("index").collect()
    assert [(r.value, r.next, r.is_last) for r in got] == [(v, ordered[i + 1] if i + 1 < len(ordered) else None, i + 1 == len(ordered)) for i, v in enumerate(ordered)]
    flags = sorted(r.a for r in O.compare_neighbours(d, "a").collect())
    assert flags == sorted(int(a == b) for a, b in zip(ordered, ordered[1:]))


def test_whole_numbers_divide_exactly(spark):
    d = df(spark, [(9007199254740993, 1), (-9007199254740993, 2), (2**63 - 1, 3), (7, 0)], "ab")
    assert rows(R.divide(d, "c", ["a", "b"], on_zero="null").select("c")) == [(-4503599627370496,), (9007199254740993,), (3074457345618258602,), (None,)]
    m = df(spark, [(1, 9007199254740993, 1), (1, 9007199254740993, 1), (2, -7, 2)], "gan")
    assert rows(A.weighted_mean(m, ["g"], "a", "n", "m")) == [(1, 9007199254740993), (2, -3)]


def test_neighbours_and_public_join_with_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(O, "RUN", 100)
    values = [5] * 4500 + [None] * 30 + list(range(470)) + [1]
    d = spark.createDataFrame([(v,) for v in values], "a long").repartition(5)
    got = [r.a for r in O.compare_neighbours(d, "a").collect()]
    assert len(got) == len(values) - 1 and sum(got) == len(values) - len(set(values))
    assert O.compare_neighbours(d.limit(0), "a").count() == 0 and [r.a for r in O.compare_neighbours(d.where("a = 7"), "a").collect()] == []
    assert max(r["n"] for r in O.compare_neighbours(d, "a").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()) < 4000
    one = df(spark, [(5, 8), (7, 9)], "kv")
    assert R.aligned_with_join(one, "k", d.toDF("k"), "k").groupBy("v").count().orderBy("v").collect() == [(8, 4501), (9, 1)]


def test_sets(spark):
    a, b = df(spark, [(1, 1), (2, 1), (2, 1)], "ab"), df(spark, [(2, 5), (3, 6)], "cd")
    assert rows(S.concat([a, b])) == [(1, 1), (2, 1), (2, 1), (2, 5), (3, 6)] and S.concat([a, b], ["p", "q"]).columns == ["p", "q"]
    assert rows(S.union(a, b, "a", "c")) == [(1,), (2,), (3,)]
    assert rows(S.intersect(a, b, "a", "c")) == [(2,)]
    assert rows(S.distinct(a, ["b"])) == [(1,)]
    with pytest.raises(ValueError):
        S.concat([a])
    with pytest.raises(ValueError):
        S.concat([a, a.select("a")])


def test_concat_cols(spark):
    a, b = df(spark, [(1, 10), (2, 20)], "ab"), df(spark, [(5,), (3,)], "c")
    assert rows(S.concat_cols([a, b], [["a"], ["c"]])) == [(1, 10, 3), (2, 20, 5)]
    assert rows(S.concat_cols([a, a.toDF("x", "y")], [["a"], ["x"]], use_mult=True)) == [(1, 100), (4, 400)]
    with pytest.raises(PySparkException):
        S.concat_cols([a, b.limit(1)], [["a"], ["c"]]).collect()
    with pytest.raises(ValueError):
        S.concat_cols([a, a])


def test_flags_and_indexes(spark):
    l, r = df(spark, [(0, 7, 1), (1, 8, 2)], ["i", "k", "v"]), df(spark, [(0, 8, 5), (1, 7, 6), (2, 7, 7)], ["j", "q", "w"])
    flags = I.join_flags(l, r, "k", "q", "i", "j")
    assert rows(flags) == [(0, 0, 0), (0, 1, 1), (0, 2, 1), (1, 0, 1), (1, 1, 0), (1, 2, 0)]
    want = [(7, 1, 6), (7, 1, 7), (8, 2, 5)]
    assert rows(I.flag_join(l, r, flags, "i", "j", "q")) == want
    assert rows(I.index_join(l, r, I.matching_pairs(l, r, "k", "q", "i", "j"), "i", "j", "q")) == want
    assert rows(I.hybrid_join(l.drop("i"), r.drop("j"), "k", "q")) == want
    lookup, every = df(spark, [(1,), (1,)], ["index"]), df(spark, [(0,), (1,), (2,)], ["index"])
    assert rows(I.indexes_to_flags(lookup, every)) == [(0, 0), (1, 1), (2, 0)]
    assert rows(I.arranged(lookup, 2)) == [(0, 1, 1), (1, None, 0)]
    assert rows(I.gather(l.withColumnRenamed("i", "index"), lookup)) == [(8, 2), (8, 2)]


def test_boundaries_and_blackbox(spark):
    d = df(spark, [(1,), (2,)], "a")
    assert rows(B.open_(B.flagged_filter(B.close(d, "keep"), F.col("a") > 1), "keep")) == [(2,)]
    assert rows(B.send(B.open_(B.close(d)))) == [(1,), (2,)]
    assert B.persist(d, "kept table").count() == 2 and spark.table("kept_table").count() == 2
    assert rows(R.blackbox([d], "select a + 1 from in0", ["b"])) == [(2,), (3,)]
    assert rows(R.blackbox([d, d], lambda x, y: x.crossJoin(y.limit(1)), ["b", "c"])) != []
    with pytest.raises(ValueError):
        R.blackbox([d], lambda x: x, ["b", "c"])


def test_dates_and_codes(spark):
    d = spark.createDataFrame([("01/02/70", "414.01", "Aspirin 80"), ("01/01/02", "250", "other")], "d string, c string, m string")
    assert rows(d.select(day_number(F.col("d"), "MM/dd/yy"))) == [(11688,), (36526,)]
    assert rows(d.select(is_code(F.col("c"), "414"), mentions(F.col("m"), "aspirin"))) == [(1, 1), (2, 2)]
