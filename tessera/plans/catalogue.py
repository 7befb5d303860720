"""One query per operator and workload over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.positions import numbered
from tessera.operators import aggregates, boundaries, indexes, ordering, relational, sets
from tessera.plans import workloads as W
from tessera.relation import Relation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def halves(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(key) % 2 == 0), df.where(F.col(key) % 2 == 1)


# --- scans and projections


@query("select * from nation")
def scan_create(spark, d):
    return t(spark, d, "nation")


@query("select o_custkey, o_orderkey from orders")
def project(spark, d):
    return relational.project(t(spark, d, "orders"), ["o_custkey", "o_orderkey"])


# --- filters


@query("select l_orderkey, l_linenumber from lineitem where l_linenumber = 1")
def filter_eq_scalar(spark, d):
    return relational.where(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_linenumber", "==", scalar=1)


@query("select l_orderkey, l_quantity from lineitem where l_quantity < 10")
def filter_lt_scalar(spark, d):
    return relational.where(t(spark, d, "lineitem").select("l_orderkey", "l_quantity"), "l_quantity", "<", scalar=10)


@query("select l_suppkey, l_partkey from lineitem where l_suppkey < l_partkey")
def filter_lt_column(spark, d):
    return relational.where(t(spark, d, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "<", other="l_partkey")


@query("select l_linenumber, l_suppkey from lineitem where l_linenumber = l_suppkey")
def filter_eq_column(spark, d):
    return relational.where(t(spark, d, "lineitem").select("l_linenumber", "l_suppkey"), "l_linenumber", "==", other="l_suppkey")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_nationkey < 5)")
def filter_by_in(spark, d):
    keys = t(spark, d, "customer").where("c_nationkey < 5").select("c_custkey")
    return relational.keep_listed(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", keys)


@query("select o_orderkey, o_custkey from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_nationkey < 5)")
def filter_by_not_in(spark, d):
    keys = t(spark, d, "customer").where("c_nationkey < 5").select("c_custkey")
    return relational.keep_listed(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", keys, negate=True)


# --- arithmetic


@query("select l_orderkey, cast(l_linenumber as bigint) * l_suppkey * 3 as l_linenumber, l_suppkey from lineitem")
def multiply_inplace(spark, d):
    return relational.multiply(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_linenumber", ["l_linenumber", "l_suppkey", 3])


@query("select l_orderkey, l_linenumber, l_suppkey, cast(l_linenumber as bigint) * l_suppkey * 2 * 5 as product from lineitem")
def multiply_new_col(spark, d):
    return relational.multiply(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "product", ["l_linenumber", "l_suppkey", 2, 5])


@query("select case when l_suppkey <> 0 then l_partkey // l_suppkey end as l_partkey, l_suppkey from lineitem")
def divide_int(spark, d):
    return relational.divide(t(spark, d, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", ["l_partkey", "l_suppkey"], on_zero="null")


@query("select l_orderkey, l_linenumber, 9007199254740993 + l_orderkey as n, (9007199254740993 + l_orderkey) // l_linenumber as part from lineitem")
def divide_wide(spark, d):
    """Beyond 2^53, where doubles have gaps."""
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.lit(9007199254740993) + F.col("l_orderkey")).alias("n"))
    return relational.divide(rows, "part", ["n", "l_linenumber"])


@query("select o_orderkey, o_custkey, o_orderkey // 7 // 3 as part from orders")
def divide_new_col(spark, d):
    return relational.divide(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "part", ["o_orderkey", 7, 3])


# --- joins


@query("select o_orderkey, o_custkey, l_partkey, l_quantity from orders join lineitem on o_orderkey = l_orderkey")
def join_diff_names(spark, d):
    return relational.join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), ["o_orderkey"], ["l_orderkey"])


@query("select c_nationkey as k, c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey")
def join_single_key(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    return relational.join(c, t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey"), ["k"], ["k"], spread=relational.TASK_ROWS)


@query("""select a.l_orderkey as ok, a.l_suppkey as sk, a.l_quantity as q1, b.l_tax as t2
from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_suppkey = b.l_suppkey""")
def join_multi_key(spark, d):
    li = t(spark, d, "lineitem")
    a = li.select(F.col("l_orderkey").alias("ok"), F.col("l_suppkey").alias("sk"), F.col("l_quantity").alias("q1"))
    b = li.select(F.col("l_orderkey").alias("ok2"), F.col("l_suppkey").alias("sk2"), F.col("l_tax").alias("t2"))
    return relational.join(a, b, ["ok", "sk"], ["ok2", "sk2"])


@query("select o_custkey, o_orderkey, c_nationkey from orders join customer on o_custkey = c_custkey")
def join_salted(spark, d):
    return relational.join(t(spark, d, "orders").select("o_custkey", "o_orderkey"), t(spark, d, "customer").select("c_custkey", "c_nationkey"), ["o_custkey"], ["c_custkey"], salt=4)


@query("select c_custkey, c_nationkey from customer join orders on c_custkey = o_custkey")
def pub_join(spark, d):
    return relational.aligned_with_join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", t(spark, d, "orders").select("o_custkey"), "o_custkey")


@query("select o_orderkey, o_custkey, l_suppkey from orders join lineitem on o_orderkey = l_orderkey")
def pub_join_part(spark, d):
    o, li = t(spark, d, "orders").select("o_orderkey", "o_custkey"), t(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return relational.partitioned_join(halves(o, "o_orderkey"), halves(li, "l_suppkey"), ["o_orderkey"], ["l_orderkey"])


@query("select s_suppkey, s_nationkey, l_partkey from supplier join lineitem on s_suppkey = l_suppkey")
def hybrid_join(spark, d):
    return indexes.hybrid_join(t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), t(spark, d, "lineitem").select("l_suppkey", "l_partkey"), "s_suppkey", "l_suppkey")


@query("select s_nationkey, s_suppkey, n_regionkey from supplier join nation on s_nationkey = n_nationkey")
def public_join(spark, d):
    return indexes.public_join(t(spark, d, "supplier").select("s_nationkey", "s_suppkey"), t(spark, d, "nation").select("n_nationkey", "n_regionkey"), "s_nationkey", "n_nationkey")


def _keyed(spark, d):
    n = numbered(t(spark, d, "nation").select("n_regionkey", "n_nationkey"), ["n_nationkey"])
    r = numbered(t(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"])
    return n, r


_NUMBERED = """with l as (select row_number() over (order by n_nationkey) - 1 as i, n_regionkey, n_nationkey from nation),
r as (select row_number() over (order by r_regionkey) - 1 as j, r_regionkey, r_name from region) """


@query(_NUMBERED + "select i as l_idx, j as r_idx, case when n_regionkey = r_regionkey then 1 else 0 end as flag from l cross join r")
def join_flags(spark, d):
    n, r = _keyed(spark, d)
    return indexes.join_flags(n, r, "n_regionkey", "r_regionkey", "index", "index")


@query("select n_regionkey, n_nationkey, r_name from nation join region on n_regionkey = r_regionkey")
def flag_join(spark, d):
    n, r = _keyed(spark, d)
    return indexes.flag_join(n, r, indexes.matching_flags(n, r, "n_regionkey", "r_regionkey", "index", "index"), "index", "index", "r_regionkey")


@query("select n_regionkey, n_nationkey, r_name from nation join region on n_regionkey = r_regionkey")
def index_join(spark, d):
    n, r = _keyed(spark, d)
    return indexes.index_join(n, r, indexes.matching_pairs(n, r, "n_regionkey", "r_regionkey", "index", "index"), "index", "index", "r_regionkey")


@query("""select i as index, case when exists (select 1 from supplier where s_nationkey = i) then 1 else 0 end as flag
from (select row_number() over (order by n_nationkey) - 1 as i from nation)""")
def indexes_to_flags(spark, d):
    rows = numbered(t(spark, d, "nation").select("n_nationkey"), ["n_nationkey"]).select("index")
    return indexes.indexes_to_flags(t(spark, d, "supplier").select(F.col("s_nationkey").alias("index")), rows)


@query("""with k as (select distinct s_nationkey as i from supplier), n as (select row_number() over (order by i) - 1 as place, i from k)
select cast(r.range as bigint) as place, i as index, case when i is null then 0 else 1 end as is_real from range(40) r left join n on n.place = r.range""")
def indexes_to_flags_arranged(spark, d):
    return indexes.arranged(t(spark, d, "supplier").select(F.col("s_nationkey").alias("index")), 40)


# --- aggregates


@query("select l_suppkey, cast(sum(l_linenumber) as bigint) as total from lineitem group by l_suppkey")
def agg_sum(spark, d):
    return aggregates.aggregate(t(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber", "sum", "total")


@query("select l_suppkey, l_returnflag, cast(sum(l_linenumber) as bigint) as total from lineitem group by l_suppkey, l_returnflag")
def agg_sum_multi_key(spark, d):
    return aggregates.aggregate(t(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], "l_linenumber", "sum", "total")


@query("select l_returnflag, cast(sum(l_linenumber) as bigint) as total from lineitem group by l_returnflag")
def agg_sum_salted(spark, d):
    return aggregates.aggregate(t(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_orderkey"), ["l_returnflag"], "l_linenumber", "sum", "total", salt=8)


@query("select o_custkey, count(*) as n from orders group by o_custkey")
def agg_count(spark, d):
    return aggregates.count_by(t(spark, d, "orders"), ["o_custkey"], "n")


@query("select l_suppkey, avg(l_linenumber) as mean from lineitem group by l_suppkey")
def agg_mean(spark, d):
    return aggregates.aggregate(t(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber", "mean", "mean")


@query("select l_suppkey, floor(var_pop(l_linenumber) * 10000 + 0.5) / 10000 as dev from lineitem group by l_suppkey")
def agg_std_dev(spark, d):
    return aggregates.aggregate(t(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber", "std_dev", "dev").withColumn("dev", F.floor(F.col("dev") * 10000 + 0.5) / 10000)


@query("select l_suppkey, floor(stddev_pop(l_linenumber) * 10000 + 0.5) / 10000 as dev from lineitem group by l_suppkey")
def agg_stddev_pop(spark, d):
    return aggregates.aggregate(t(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber", "stddev_pop", "dev").withColumn("dev", F.floor(F.col("dev") * 10000 + 0.5) / 10000)


@query("select l_suppkey, cast(sum(l_partkey) // sum(l_linenumber) as bigint) as mean from lineitem group by l_suppkey")
def agg_mean_with_count(spark, d):
    return aggregates.weighted_mean(t(spark, d, "lineitem"), ["l_suppkey"], "l_partkey", "l_linenumber", "mean")


@query("select l_suppkey, cast(sum(9007199254740993 + l_partkey) // count(*) as bigint) as mean from lineitem group by l_suppkey")
def agg_mean_with_count_wide(spark, d):
    """Sums beyond 2^53."""
    rows = t(spark, d, "lineitem").select("l_suppkey", (F.lit(9007199254740993) + F.col("l_partkey")).alias("n"), F.lit(1).alias("one"))
    return aggregates.weighted_mean(rows, ["l_suppkey"], "n", "one", "mean")


def _index_map(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("amount"))
    rows = numbered(orders, ["o_orderkey"])
    keys = numbered(orders.select("o_custkey").distinct(), ["o_custkey"], "key_idx")
    pairs = rows.select("index", "o_custkey").join(keys, "o_custkey").select(F.col("index").alias("row_idx"), "key_idx")
    return rows, keys, pairs


@query("select o_custkey, cast(sum(o_orderkey) as bigint) as total from orders group by o_custkey")
def index_aggregate(spark, d):
    rows, _, pairs = _index_map(spark, d)
    return aggregates.index_aggregate(rows, ["o_custkey"], "amount", "total", pairs)


@query("select o_custkey, cast(sum(o_orderkey) as bigint) as total from orders group by o_custkey")
def leaky_index_aggregate(spark, d):
    rows, keys, pairs = _index_map(spark, d)
    return aggregates.leaky_index_aggregate(rows, "amount", "total", pairs, keys)


@query("select o_custkey, cast(sum(o_orderkey) as bigint) as total from orders group by o_custkey")
def hybrid_aggregate(spark, d):
    return aggregates.hybrid_aggregate(t(spark, d, "orders"), ["o_custkey"], "o_orderkey", "total")


@query("select count(distinct l_suppkey) as l_suppkey from lineitem")
def distinct_count(spark, d):
    return aggregates.distinct_count(t(spark, d, "lineitem"), "l_suppkey")


@query("select count(*) as len from lineitem")
def num_rows(spark, d):
    return aggregates.row_count(t(spark, d, "lineitem"))


# --- order


@query("select o_orderkey, o_totalprice from orders order by o_totalprice")
def sort_by(spark, d):
    return ordering.sort_by(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("select o_orderkey, o_custkey from orders order by o_orderkey limit 100")
def limit(spark, d):
    return ordering.limit(t(spark, d, "orders").select("o_orderkey", "o_custkey"), 100, ["o_orderkey"])


@query("select p_partkey, p_retailprice from part order by p_retailprice, p_partkey limit 25")
def top_k(spark, d):
    return ordering.limit(t(spark, d, "part").select("p_partkey", "p_retailprice"), 25, ["p_retailprice", "p_partkey"])


@query("select row_number() over (order by o_orderkey) - 1 as index, o_orderkey, o_custkey from orders")
def index(spark, d):
    return ordering.index(t(spark, d, "orders").select("o_orderkey", "o_custkey"), order_by=["o_orderkey"])


@query("""select case when l_suppkey = nxt then 1 else 0 end as l_suppkey from
(select l_suppkey, lead(l_suppkey) over (order by l_suppkey) as nxt, row_number() over (order by l_suppkey) as i, count(*) over () as n from lineitem) where i < n""")
def comp_neighs(spark, d):
    return ordering.compare_neighbours(t(spark, d, "lineitem").select("l_suppkey"), "l_suppkey")


@query("select * from customer")
def shuffle(spark, d):
    return ordering.shuffle(t(spark, d, "customer"), 42)


@query("select row_number() over (order by c_acctbal, c_custkey) - 1 as index, c_custkey, c_acctbal from customer")
def unpermute(spark, d):
    return ordering.unpermute(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", order_by=["c_acctbal", "c_custkey"])


# --- sets


@query("select distinct o_custkey from orders")
def distinct(spark, d):
    return sets.distinct(t(spark, d, "orders"), ["o_custkey"])


@query("select distinct l_returnflag, l_linestatus from lineitem")
def distinct_multi(spark, d):
    return sets.distinct(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("select c_custkey, c_nationkey from customer union all select s_suppkey, s_nationkey from supplier")
def concat(spark, d):
    return sets.concat([t(spark, d, "customer").select("c_custkey", "c_nationkey"), t(spark, d, "supplier").select("s_suppkey", "s_nationkey")])


@query("""select c_custkey as k, c_nationkey as n from customer union all select s_suppkey, s_nationkey from supplier
union all select cast(n_nationkey as bigint), n_regionkey from nation""")
def concat_renamed(spark, d):
    parts = [t(spark, d, "customer").select("c_custkey", "c_nationkey"), t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), t(spark, d, "nation").select("n_nationkey", "n_regionkey")]
    return sets.concat(parts, ["k", "n"])


@query("""select c_custkey, c_nationkey, o from (select row_number() over (order by c_custkey) as i, c_custkey, c_nationkey from customer)
join (select row_number() over (order by c_acctbal desc, c_custkey) as i, c_custkey as o from customer) using (i)""")
def concat_cols(spark, d):
    c = t(spark, d, "customer")
    right = c.select(F.col("c_custkey").alias("o"), (-F.col("c_acctbal")).alias("b"))
    numbers = numbered(right, ["b", "o"], "at").select(F.col("at").cast("long"), "o")
    left = c.select("c_custkey", "c_nationkey")
    pasted = sets.concat_cols([left, numbers], [["c_custkey"], ["at"]])
    return pasted.select("c_custkey", "c_nationkey", "o")


@query("""select s_suppkey * m as s_suppkey, cast(s_nationkey as bigint) * n as s_nationkey from (select row_number() over (order by s_suppkey) as i, s_suppkey, s_nationkey from supplier)
join (select row_number() over (order by s_suppkey) as i, s_suppkey + 1 as m, s_nationkey + 2 as n from supplier) using (i)""")
def concat_cols_mult(spark, d):
    s = t(spark, d, "supplier")
    return sets.concat_cols([s.select("s_suppkey", "s_nationkey"), s.select((F.col("s_suppkey") + 1).alias("m"), (F.col("s_nationkey") + 2).alias("n"))], [["s_suppkey"], ["m"]], use_mult=True)


@query("select c_custkey from customer union select o_custkey from orders")
def union_keys(spark, d):
    return sets.union(t(spark, d, "customer"), t(spark, d, "orders"), "c_custkey", "o_custkey")


@query("select o_custkey from orders where o_orderkey % 2 = 0 intersect select o_custkey from orders where o_orderkey % 2 = 1")
def pub_intersect(spark, d):
    return sets.intersect(*halves(t(spark, d, "orders"), "o_orderkey"), "o_custkey")


# --- boundaries and steps of the user's own


@query("select n_nationkey, n_name from nation where n_regionkey < 3")
def persist_open_close(spark, d):
    closed = boundaries.close(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "keep")
    flagged = boundaries.flagged_filter(closed, F.col("n_regionkey") < 3)
    return boundaries.open_(boundaries.persist(flagged, "flagged"), "keep").select("n_nationkey", "n_name")


@query("select l_suppkey as k, cast(max(l_partkey) as bigint) as top from lineitem group by l_suppkey")
def blackbox(spark, d):
    return relational.blackbox([t(spark, d, "lineitem")], "select l_suppkey, max(l_partkey) from {in0} group by l_suppkey", ["k", "top"])


@query("select o_custkey as k, count(*) as n from orders group by o_custkey")
def blackbox_function(spark, d):
    return relational.blackbox([t(spark, d, "orders")], lambda df: df.groupBy("o_custkey").count(), ["k", "n"])


# --- workloads


@query("""with r as (select l_suppkey as company, cast(sum(cast(trunc(l_extendedprice) as bigint)) // 1000 as bigint) as local_rev from lineitem group by l_suppkey),
s as (select cast(local_rev * 100 // (select sum(local_rev) from r) as bigint) as share from r)
select cast(0 as bigint) as "companyID", cast(sum(share * share) as bigint) as hhi from s""")
def market_concentration(spark, d):
    return W.market_concentration(spark, d)


@query("select event_type, count(*) as total from events group by event_type order by total")
def comorbidity(spark, d):
    return W.comorbidity(W.parties(t(spark, d, "events"), "event_id", 2, "diagnosis", ["event_type"]), "event_type").df


def _cohort_parties(spark, d, n):
    e = t(spark, d, "events").select("event_id", F.col("user_id").alias("p"), F.col("ts").alias("day"), "event_type")
    meds = e.select("event_id", "p", (F.col("event_type") == "purchase").cast("int").alias("drug"), F.col("day").alias("drug_day"))
    diags = e.select("event_id", F.col("p").alias("q"), (F.col("event_type") == "view").cast("int").alias("code"), F.col("day").alias("code_day"))
    # the first and last filters of the workload, moved in front of the join by Catalyst
    return W.parties(meds, "event_id", n, "medication", ["p", "drug", "drug_day"]), W.parties(diags, "event_id", n, "diagnosis", ["q", "code", "code_day"])


@query("""select count(distinct m.user_id) as p from events m join events v on m.user_id = v.user_id
where m.event_type = 'purchase' and v.event_type = 'view' and v.ts < m.ts""")
def cohort_distinct_patients(spark, d):
    meds, diags = _cohort_parties(spark, d, 2)
    return W.cohort(meds, diags, ("p", "q"), "drug", "drug_day", "code", "code_day").df


@query("""with a as (select distinct user_id from events where event_id % 2 = 0), b as (select distinct user_id from events where event_id % 2 = 1),
s as (select user_id from a intersect select user_id from b),
j as (select m.user_id as u, m.event_id % 2 as mp, v.event_id % 2 as vp, m.user_id in (select user_id from s) as shared from events m join events v on m.user_id = v.user_id
  where m.event_type = 'purchase' and v.event_type = 'view' and v.ts < m.ts)
select 0 as part, count(distinct u) as p from j where shared
union all select 1, count(distinct u) from j where not shared and mp = 0 and vp = 0
union all select 2, count(distinct u) from j where not shared and mp = 1 and vp = 1""")
def cohort_shared_patients(spark, d):
    meds, diags = _cohort_parties(spark, d, 2)
    joint, own = W.shared_cohort(meds, diags, ("p", "q"), "drug", "drug_day", "code", "code_day")
    return sets.concat([r.df.select(F.lit(i).alias("part"), "p") for i, r in enumerate([joint, *own])])


@query("""select c_nationkey, cast(sum(cast(trunc(o_totalprice) as bigint)) as bigint) as total from customer join orders on c_custkey = o_custkey group by c_nationkey""")
def credit_score(spark, d):
    register = Relation.create(t(spark, d, "customer").select("c_custkey", "c_nationkey"), "register", owners={1})
    scores = W.parties(t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("long").alias("score")), "o_orderkey", 2, "company", ["o_custkey", "score"])
    return W.credit_score(register, scores, ("c_custkey", "o_custkey"), "c_nationkey", "score").df


@query("select location, count(*) as by_location from (select l_suppkey % 50 as location from lineitem) group by location")
def heatmap_counts(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 50).alias("location"))
    return W.location_counts(W.parties(rows, "l_orderkey", 3, "in", ["location"])).df
