import pytest

from tessera import frontend as cc
from tessera.workflow import Config, run_workflow
from tests.conftest import rows


def conf(tmp_path, **user):
    return Config.from_dict({"user_config": {"pid": 1, "all_pids": [1, 2, 3], "workflow_name": "w", "paths": {"input_path": str(tmp_path)}, **user}})


def read(spark, done, name):
    return rows(spark.read.option("header", True).option("inferSchema", True).csv(done.paths[name]))


def test_function_style_protocol(spark, tmp_path):
    for i, text in ((1, "a,b\n1,10\n2,20\n"), (2, "a,b\n2,5\n3,7\n")):
        (tmp_path / f"in{i}.csv").write_text(text)

    def protocol():
        one, two = (cc.create(f"in{i}", [cc.defCol("a", "INTEGER", i, 3), cc.defCol("b", "INTEGER", i)], {i}) for i in (1, 2))
        both = cc.concat([one, two], "both")
        total = cc.aggregate(both, "total", ["a"], "b", "sum", "s")
        cc.collect(cc.sort_by(cc.multiply(total, "twice", "s", ["s", 2]), "sorted", "a"), 1)
        cc.collect(cc.distinct_count(cc.filter_by(both, "kept", "a", cc.project(two, "keys", ["a"])), "n", "a"), 2)
        return {one, two}

    done = run_workflow(protocol, conf(tmp_path), spark)
    assert read(spark, done, "sorted") == [(1, 20), (2, 50), (3, 14)] and read(spark, done, "n") == [(2,)]
    assert [r.owners for r in done.outputs] == [{1}, {2}]
    assert "hybrid, party 3 helps" in done.report([1, 2, 3])


def test_floats_keep_fractions(spark, tmp_path):
    (tmp_path / "in1.csv").write_text("a,b\n7,2\n")

    def protocol():
        x = cc.create("in1", [cc.defCol("a", "INTEGER", 1), cc.defCol("b", "INTEGER", 1)], {1})
        cc.collect(cc.divide(x, "q", "a", ["a", "b"]), 1)

    assert read(spark, run_workflow(protocol, conf(tmp_path, use_floats=1), spark), "q") == [(3.5, 2)]
    assert read(spark, run_workflow(protocol, conf(tmp_path), spark), "q") == [(3, 2)]


def test_all_functions(spark, tmp_path):
    a = spark.createDataFrame([(0, 1, 10), (1, 2, 20), (2, 2, 30)], "index long, k long, v long")
    b = spark.createDataFrame([(0, 2, 7), (1, 3, 8)], "index long, q long, w long")

    def protocol(ctx):
        l = cc.create("l", [cc.defCol(c, "INTEGER", 1) for c in a.columns], {1}, a)
        r = cc.create("r", [cc.defCol(c, "INTEGER", 2) for c in b.columns], {2}, b)
        flags = cc._join_flags(l, r, "f", ["k"], ["q"])
        pairs = cc.project(cc.cc_filter(flags, "ones", "flags", "==", scalar=1), "pairs", ["l_idx", "r_idx"])
        want = [(2, 20, 7), (2, 30, 7)]
        assert rows(cc._flag_join(l, r, "fj", ["k"], ["q"], flags).df) == want and rows(cc._index_join(l, r, "ij", ["k"], ["q"], pairs).df) == want
        lv, rw = cc.project(l, "lv", ["k", "v"]), cc.project(r, "rw", ["q", "w"])
        assert rows(cc.join(lv, rw, "j", ["k"], ["q"]).df) == want
        assert rows(cc._pub_join(lv, "pj", "k", rw, "q").df) == [(2, 20), (2, 30)] and rows(cc._pub_intersect(lv, "pi", "k", rw, "q").df) == [(2,)]
        assert rows(cc.union(lv, rw, "u", "k", "q").df) == [(1,), (2,), (3,)]
        assert rows(cc.index_aggregate(l, "ia", ["k"], "v", "sum", "s").df) == [(1, 10), (2, 50)]
        keys = cc.create("keys", [cc.defCol("key_idx"), cc.defCol("k")], {1}, spark.createDataFrame([(0, 1), (1, 2)], "key_idx long, k long"))
        to = cc.create("map", [cc.defCol("row_idx"), cc.defCol("key_idx")], {1}, spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "r long, c long"))
        assert rows(cc._leaky_index_aggregate(l, "la", ["k"], "v", "sum", "s", keys, to).df) == [(1, 10), (2, 50)]
        assert rows(cc.aggregate_count(l, "ac", ["k"], "n").df) == [(1, 1), (2, 2)] and rows(cc.num_rows(l, "nr").df) == [(3,)]
        assert rows(cc.limit(cc.distinct(l, "d", ["k"]), "lim", 1, ["k"]).df) == [(1,)]
        assert rows(cc._comp_neighs(l, "cn", "k").df) == [(0,), (1,)]
        assert rows(cc.index(lv, "ix", order_by=["v"]).df) == [(0, 1, 10), (1, 2, 20), (2, 2, 30)]
        assert rows(cc._unpermute(lv, "up", "v", "i", ["v"]).df) == [(0, 1, 10), (1, 2, 20), (2, 2, 30)]
        assert rows(cc._indexes_to_flags(cc.project(l, "li", ["index"]), r, "itf").df) == [(0, 1), (1, 1), (2, 0)]
        assert rows(cc.concat_cols([cc.project(l, "x", ["k"]), cc.project(l, "y", ["v"])], "cc", order_by=[["k"], ["v"]]).df) == [(1, 10), (2, 20), (2, 30)]
        assert rows(cc.blackbox([l], "bb", ["m"], "spark", "select max(v) from in0").df) == [(30,)]
        with pytest.raises(ValueError):
            cc.blackbox([l], "bb", ["m"], "other", "")
        with pytest.raises(ValueError):
            cc._indexes_to_flags(l, r, "x", stage=1)
        return cc._open(cc._close(cc._persist(cc.shuffle(cc.divide(lv, "dv", "v", ["v", 10]), "sh", 1), "kept"), "cl", {1, 2}), "op", 1)

    assert read(spark, run_workflow(protocol, conf(tmp_path), spark), "op") == [(1, 1), (2, 2), (2, 3)]


def test_a_workflow_without_outputs_raises(spark, tmp_path):
    with pytest.raises(ValueError):
        run_workflow(lambda ctx: None, conf(tmp_path), spark)
