"""One query for each operator, over the star-schema tables; SQL beside each.

Floating results are rounded alike on both sides, money is summed as decimals, and
every column is named, so that rows compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import gridframe as g
from gridframe.plans.expr import as_expr

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

i, j, k = g.Ix("i"), g.Ix("j"), g.Ix("k")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vector(spark, d, name, key, value) -> g.NdFrame:
    return g.from_table(table(spark, d, name), [key], value)


def named(a: g.NdFrame, *names: str, value: str = "v", round_to: int | None = None) -> DataFrame:
    v = F.round(F.col("v").cast("double"), round_to) if round_to is not None else F.col("v")
    return a.df.select(*(F.col(f"d{n}").alias(x) for n, x in enumerate(names)), v.alias(value))


def cents(c) -> F.Column:
    """Money as a whole number of cents, so that sums are exact."""
    return F.round(c * 100).cast("bigint")


def embeddings(spark, d) -> g.NdFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("d", "x"))
    n = table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return g.from_table(rows, ["vec_id", "d"], F.col("x").cast("double"), (n, 64), check=False)


def lines(spark, d, *values) -> list[g.NdFrame]:
    """lineitem has no unique key: its rows are unordered particles."""
    df = table(spark, d, "lineitem")
    first = g.rows_of(df, values[0])
    return [first, *(g.NdFrame(first.source, v, (-1,), df.select(v).schema[0].dataType.simpleString()) for v in values[1:])]


def days(spark, d, value=None) -> g.NdFrame:
    """Daily event counts, or sums of a value: a dense array of 30 days."""
    df = table(spark, d, "events")
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    a = g.rows_of(df, F.lit(1) if value is None else value)
    at = g.NdFrame(a.source, day.cast("int"), (-1,), "int")
    return scatter_rows([(at, "drop", 30)], a)


def scatter_rows(dests, a: g.NdFrame, op=g.Add) -> g.NdFrame:
    """A scatter of rows without coordinates."""
    policy = {"drop": g.drop, "clamp": g.clamp, "wrap": g.wrap}
    return g.scatter(tuple(policy[p](c[i] if isinstance(c, g.NdFrame) else c, n) for c, p, n in dests), a[i], i, op=op).eval()


# ---------------------------------------------------------------- scatters and histograms

_BIN = "floor((l_extendedprice - 900.0) * (64 / (105000.0 - 900.0)))"


def _hist(spark, d, policy) -> DataFrame:
    one, price = lines(spark, d, F.lit(1), F.col("l_extendedprice"))
    return named(scatter_rows([(g.bins(price[i], 900.0, 105000.0, 64), policy, 64)], one), "bin", value="n")


def _hist_sql(cell: str, where: str = "") -> str:
    return f"select r.range as bin, coalesce(c.n, 0)::int as n from range(64) r left join (select {cell} as bin, count(*) as n from lineitem {where} group by 1) c on c.bin = r.range"


@query(_hist_sql(f"least(greatest({_BIN}, 0), 63)::bigint"))
def hist_price(spark, d):
    return _hist(spark, d, "clamp")


@query(_hist_sql(f"{_BIN}::bigint", f"where {_BIN} between 0 and 63"))
def hist_drop(spark, d):
    return _hist(spark, d, "drop")


@query(_hist_sql(f"((({_BIN})::bigint % 64) + 64) % 64"))
def hist_wrap(spark, d):
    return _hist(spark, d, "wrap")


@query("""with e as (select min(p_retailprice) lo, max(p_retailprice) hi from part), b as (select least(greatest(floor((p_retailprice - lo) * (20 / (hi - lo))), 0), 19)::bigint as bin from part, e)
select r.range as bin, coalesce(n, 0)::int as n, round(lo + r.range * ((hi - lo) / 20), 6) as edge from range(20) r cross join e left join (select bin, count(*) n from b group by 1) c on c.bin = r.range""")
def stats_histogram(spark, d):
    h = g.stats.histogram(vector(spark, d, "part", "p_partkey", "p_retailprice"), 20)
    return named(h.counts, "bin", value="n").join(named(h.edges, "bin", value="edge", round_to=6), "bin")


@query("""with c as (select case when l_quantity >= 51 then 5 when l_quantity >= 40 then 4 when l_quantity >= 30 then 3 when l_quantity >= 20 then 2 when l_quantity >= 10 then 1 when l_quantity >= 1 then 0 else -1 end as cell, round(l_extendedprice * 100)::bigint as v from lineitem)
select r.range as cell, coalesce(sum(v), 0)::bigint as cents from range(5) r left join c on c.cell = r.range group by 1""")
def cuts_qty(spark, d):
    price, qty = lines(spark, d, cents(F.col("l_extendedprice")), F.col("l_quantity").cast("double"))
    return named(scatter_rows([(g.cuts(qty[i], (1, 10, 20, 30, 40, 51)), "drop", None)], price), "cell", value="cents")


@query("""with x as (select (case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end) as flag, l_linenumber - 1 as line, round(l_extendedprice * 100)::bigint as v from lineitem)
select f.range as flag, n.range as line, coalesce(sum(v), 0)::bigint as cents from range(3) f cross join range(7) n left join x on x.flag = f.range and x.line = n.range group by 1, 2""")
def scatter_2d(spark, d):
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    price, f, n = lines(spark, d, cents(F.col("l_extendedprice")), flag, F.col("l_linenumber") - 1)
    return named(scatter_rows([(f, "drop", 3), (n, "drop", 7)], price), "flag", "line", value="cents")


@query("""select r.range as nation, coalesce(max(s_acctbal), -1.7976931348623157e308) as most, coalesce(min(s_acctbal), 1.7976931348623157e308) as least, coalesce(bit_xor(s_suppkey), 0)::bigint as mixed, coalesce(bool_or(s_acctbal < 0), false) as owes, coalesce(bool_and(s_acctbal < 0), true) as all_owe, coalesce(bit_or(s_suppkey), 0)::bigint as any_bit, coalesce(bit_and(s_suppkey), -1)::bigint as all_bits
from range(30) r left join supplier on s_nationkey = r.range group by 1""")
def scatter_ops(spark, d):
    df = table(spark, d, "supplier")
    key = g.rows_of(df, "s_suppkey")
    nation, bal = (g.NdFrame(key.source, F.col(c), (-1,), t) for c, t in (("s_nationkey", "int"), ("s_acctbal", "double")))
    owes = g.NdFrame(key.source, F.col("s_acctbal") < 0, (-1,), "boolean")
    out = None
    for name, a, op in (("most", bal, g.Max), ("least", bal, g.Min), ("mixed", key, g.BitXor), ("owes", owes, g.Or), ("all_owe", owes, g.And), ("any_bit", key, g.BitOr), ("all_bits", key, g.BitAnd)):
        one = named(scatter_rows([(nation, "drop", 30)], a, op), "nation", value=name)
        out = one if out is None else out.join(one, "nation")
    return out


@query("select r.range as cell, round(coalesce(exp(sum(ln(1 + l_discount))), 1), 6) as grown from range(8) r left join (select * from lineitem where l_orderkey < 40) on l_linenumber = r.range group by 1")
def scatter_product(spark, d):
    df = table(spark, d, "lineitem").where("l_orderkey < 40")
    a = g.rows_of(df, 1 + F.col("l_discount"))
    at = g.NdFrame(a.source, F.col("l_linenumber"), (-1,), "int")
    return named(scatter_rows([(at, "drop", 8)], a, g.Mul), "cell", value="grown", round_to=6)


@query("select o_orderkey as cell, round(exp(sum(coalesce(l_discount, 0))), 6) as grown from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def scatter_product_orders(spark, d):
    # every line of the table: an order has few, so that the products stay finite whatever its size
    grown, order = lines(spark, d, F.exp("l_discount"), F.col("l_orderkey"))
    n = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] + 1
    return named(scatter_rows([(order, "drop", n)], grown, g.Mul), "cell", value="grown", round_to=6)


def _by_customer(spark, d, op) -> g.NdFrame:
    orders = table(spark, d, "orders")
    price = g.from_table(orders, ["o_orderkey"], "o_totalprice")
    who = price.with_value(F.col("o_custkey"), "bigint")
    n = table(spark, d, "customer").agg(F.max("c_custkey")).first()[0] + 1
    return g.scatter(g.drop(who[i], n), price[i], i, op=op).eval()


@query("select c_custkey as customer, round(coalesce(avg(o_totalprice), 'nan'::double), 6) as mean, round(coalesce(var_samp(o_totalprice), 'nan'::double) / 1e9, 6) as var from customer left join orders on o_custkey = c_custkey group by 1")
def scatter_welford(spark, d):
    return _by_customer(spark, d, g.Welford).df.select(F.col("d0").alias("customer"), F.round("v.mean", 6).alias("mean"), F.round(F.col("v.var") / 1e9, 6).alias("var"))


@query("select c_custkey as customer, coalesce(min(o_totalprice), 'nan'::double) as lo, coalesce(max(o_totalprice), 'nan'::double) as hi from customer left join orders on o_custkey = c_custkey group by 1")
def scatter_minmax(spark, d):
    return _by_customer(spark, d, g.MinMax).df.select(F.col("d0").alias("customer"), "v.lo", "v.hi")


def _arg_sql(order: str) -> str:
    return f"select c_custkey as customer, coalesce(o_totalprice, 'nan'::double) as value, coalesce(o_orderkey, 4294967295) as at from customer left join (select *, row_number() over (partition by o_custkey order by o_totalprice {order}, o_orderkey) rn from orders) o on o_custkey = c_custkey and rn = 1"


@query(_arg_sql("desc"))
def scatter_argmax(spark, d):
    return _by_customer(spark, d, g.ArgMax).df.select(F.col("d0").alias("customer"), "v.value", "v.at")


@query(_arg_sql("asc"))
def scatter_argmin(spark, d):
    return _by_customer(spark, d, g.ArgMin).df.select(F.col("d0").alias("customer"), "v.value", "v.at")


@query("with e as (select label, unnest(embedding) x, generate_subscripts(embedding, 1) - 1 as d from embeddings) select label::bigint as label, d::bigint as d, round(sum(x::double), 6) as total from e group by 1, 2")
def scatter_survivor(spark, d):
    e = embeddings(spark, d)
    label = g.from_table(table(spark, d, "embeddings"), ["vec_id"], "label")
    return named(g.scatter(g.wrap(label[i], 10), e[i, j], i).eval(), "label", "d", value="total", round_to=6)


@query("select (event_id * 8) // (select count(*) from events) as cell, round(sum(value), 4) as total from events group by 1")
def ix_bins(spark, d):
    v = vector(spark, d, "events", "event_id", "value")
    return named(g.scatter(g.drop(g.bins(i, 8)), v[i]).eval(), "cell", value="total", round_to=4)


@query("select case when n_nationkey >= 12 then 2 when n_nationkey >= 5 then 1 else 0 end::bigint as cell, sum(n_regionkey)::int as total from nation group by 1")
def ix_cuts(spark, d):
    v = vector(spark, d, "nation", "n_nationkey", "n_regionkey")
    return named(g.scatter(g.drop(g.cuts(i, (0, 5, 12, 25))), v[i]).eval(), "cell", value="total")


@query("select o_orderkey % 2 as parity, sum(round(o_totalprice * 100)::bigint)::bigint as cents from orders group by 1")
def ix_wrap(spark, d):
    v = g.from_table(table(spark, d, "orders"), ["o_orderkey"], cents(F.col("o_totalprice")))
    return named(g.scatter(g.wrap(i, 2), v[i]).eval(), "parity", value="cents")


@query("select r.range as nation, round(sqrt(count(c_custkey)), 6) as root from range(25) r left join customer on c_nationkey = r.range group by 1")
def scatter_epilogue(spark, d):
    bal = vector(spark, d, "customer", "c_custkey", F.lit(1))
    nation = bal.with_value(F.col("c_nationkey"), "int")
    return named(g.math.sqrt(g.scatter(g.drop(nation[i], 25), bal[i])).eval(), "nation", value="root", round_to=6)


@query("select p_partkey as part, (case when p_size >= 40 then 2 when p_size >= 20 then 1 when p_size >= 1 then 0 else -1 end)::int as label from part")
def cuts_labels(spark, d):
    return named(g.evaluate(g.cuts(vector(spark, d, "part", "p_partkey", "p_size"), (1, 20, 40))), "part", value="label")


# ---------------------------------------------------------------- folds and contractions

_E = "with e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as d from embeddings) "


@query(_E + "select vec_id as row, round(sum(x * (d / 64.0)), 6) as y from e group by 1")
def matvec(spark, d):
    w = g.gen.iota(spark, (64,), 0, "double") / 64.0
    return named(g.fold(embeddings(spark, d)[i, j] * w[j], j).eval(), "row", value="y", round_to=6)


@query(_E + "select a.d::bigint as p, b.d::bigint as q, round(sum(a.x * b.x), 6) as dot from e a join e b using (vec_id) group by 1, 2")
def gram(spark, d):
    e = embeddings(spark, d)
    return named(g.fold(e[i, j] * e[i, k], i).eval(), "p", "q", value="dot", round_to=6)


@query("select a.n_nationkey::bigint as p, b.n_nationkey::bigint as q, (a.n_regionkey * b.n_regionkey)::int as v from nation a cross join nation b")
def outer_product(spark, d):
    v = vector(spark, d, "nation", "n_nationkey", "n_regionkey")
    return named((v[i] * v[j]).eval(), "p", "q")


@query(_E + "select vec_id as row, x as v from e where vec_id = d")
def diagonal(spark, d):
    e = embeddings(spark, d)
    # the square around the whole table; subscripts that it has no cell for are not read
    square = g.from_table(e.source.df, ["vec_id", "d"], e.value, (max(e.shape),) * 2, check=False)
    return named(square[i, i].eval(), "row")


@query(_E + "select d::bigint as p, vec_id as q, x as v from e")
def transpose(spark, d):
    return named(embeddings(spark, d)[i, j].eval((j, i)), "p", "q")


@query(_E + "select vec_id as row, x as v from e where d = 0")
def constant_subscript(spark, d):
    return named(embeddings(spark, d)[i, 0].eval(), "row")


@query(_E + ", n as (select vec_id, sqrt(sum(x * x)) as n from e group by 1), t as (select d, x from e where vec_id = 0) select e.vec_id as row, round(sum(e.x * t.x) / any_value(n.n), 6) as cosine from e join t using (d) join n using (vec_id) group by 1")
def cosine(spark, d):
    e = embeddings(spark, d)
    norm = g.math.sqrt(g.fold(e[i, j] * e[i, j], j)).eval()
    dot = g.fold(e[i, j] * e[0, j], j)
    return named((dot / norm[i]).eval(), "row", value="cosine", round_to=6)


@query(_E + "select d::bigint as d, max(x) as most from e group by 1")
def fold_axis_max(spark, d):
    return named(g.fold(embeddings(spark, d), 0, op=g.Max).eval(), "d", value="most")


@query("select sum(round(o_totalprice * 100)::bigint)::bigint as total from orders")
def fold_all(spark, d):
    return named(g.fold(vector(spark, d, "orders", "o_orderkey", cents(F.col("o_totalprice")))).eval(), value="total")


@query("select round(sqrt(sum(value * value)), 4) as norm from events")
def norm(spark, d):
    v = vector(spark, d, "events", "event_id", "value")
    return named(g.math.sqrt(g.fold(v[i] * v[i])).eval(), value="norm", round_to=4)


@query("select min(c_acctbal) as lo, max(c_acctbal) as hi from customer")
def fold_minmax(spark, d):
    return g.fold(vector(spark, d, "customer", "c_custkey", "c_acctbal"), op=g.MinMax).eval().df.select("v.lo", "v.hi")


@query("select value, event_id as at from events order by value desc, event_id limit 1")
def fold_argmax(spark, d):
    return g.fold(vector(spark, d, "events", "event_id", "value"), op=g.ArgMax).eval().df.select("v.value", "v.at")


@query("select c_custkey as at, c_acctbal as value from customer order by c_acctbal, c_custkey limit 1")
def fold_argmin(spark, d):
    return g.fold(vector(spark, d, "customer", "c_custkey", "c_acctbal"), op=g.ArgMin).eval().df.select("v.at", "v.value")


@query("select bit_and(o_custkey | 1)::bigint as a, bit_or(o_custkey)::bigint as o, bit_xor(o_custkey)::bigint as x, bool_and(o_totalprice > 0) as every, bool_or(o_totalprice > 500000) as any from orders")
def fold_bits(spark, d):
    c = vector(spark, d, "orders", "o_orderkey", "o_custkey")
    p = c.with_value(F.col("o_totalprice"), "double")
    parts = [g.fold(c[i] | 1, op=g.BitAnd), g.fold(c[i], op=g.BitOr), g.fold(c[i], op=g.BitXor), g.fold(p[i] > 0.0, op=g.And), g.fold(p[i] > 500000.0, op=g.Or)]
    out = None
    for name, e in zip(("a", "o", "x", "every", "any"), parts, strict=True):
        one = named(e.eval(), value=name)
        out = one if out is None else out.crossJoin(one)
    return out


@query("select sum(case when o_totalprice > 100000 then round(o_totalprice * 100)::bigint else 0 end)::bigint as v from orders")
def mask_fold(spark, d):
    p = g.from_table(table(spark, d, "orders"), ["o_orderkey"], cents(F.col("o_totalprice")))
    return named(g.fold(1 * (p[i] > 10000000) * p[i]).eval())


@query("with s as (select sum((o_orderkey % 7) * (o_custkey % 5)) v from orders) select v::bigint as v from s")
def fold_generated(spark, d):
    c = vector(spark, d, "orders", "o_orderkey", "o_custkey")
    n = c.size
    return named(g.fold((g.gen.iota(spark, (n,))[i] % 7) * (c[i] % 5)).eval())


@query("select round(max(a), 6) as v from (select abs(c_acctbal) a from customer)")
def user_op(spark, d):
    biggest = g.user_op("biggest", lambda a, b: F.greatest(a, b), float("-inf"), lift=F.abs)
    return named(g.fold(vector(spark, d, "customer", "c_custkey", "c_acctbal"), op=biggest).eval(), round_to=6)


# ---------------------------------------------------------------- reads: gathers, stencils, convolution

_DAYS = "with e as (select datediff('day', date '2024-01-01', ts::date) as day, value from events), f as (select r.range as t, coalesce(count(e.day), 0)::bigint as n from range(30) r left join e on e.day = r.range group by 1) "


@query("select c_custkey as customer, n_regionkey as region from customer join nation on n_nationkey = least(greatest(c_nationkey, 0), 24)")
def gather_nation(spark, d):
    region = vector(spark, d, "nation", "n_nationkey", "n_regionkey")
    nation = vector(spark, d, "customer", "c_custkey", "c_nationkey")
    return named(region[g.clamp(nation[i])].eval(), "customer", value="region")


@query("select o_orderkey as order_, coalesce(c_acctbal, -1.0) as balance from orders left join customer on c_custkey = o_custkey * 2")
def gather_pad(spark, d):
    bal = vector(spark, d, "customer", "c_custkey", "c_acctbal")
    who = vector(spark, d, "orders", "o_orderkey", "o_custkey")
    return named(bal[g.pad((who * 2)[i], -1.0)].eval(), "order_", value="balance")


def _stencil_sql(miss: str, key: str) -> str:
    return _DAYS + f"select a.t as day, ({miss.format('l')} - 2 * a.n + {miss.format('r')})::bigint as v from f a left join f l on l.t = {key.format('a.t - 1')} left join f r on r.t = {key.format('a.t + 1')}"


def _stencil(spark, d, at) -> DataFrame:
    f = days(spark, d)
    f = f.with_value(f.value, "bigint")
    return named((f[at(i - 1)] - 2 * f[i] + f[at(i + 1)]).eval(), "day")


@query(_stencil_sql("coalesce({}.n, 0)", "{}"))
def stencil_zero(spark, d):
    return _stencil(spark, d, g.zero)


@query(_stencil_sql("coalesce({}.n, 5)", "{}"))
def stencil_pad(spark, d):
    return _stencil(spark, d, lambda t: g.pad(t, 5))


@query(_stencil_sql("{}.n", "least(greatest({}, 0), 29)"))
def stencil_clamp(spark, d):
    return _stencil(spark, d, g.clamp)


@query(_stencil_sql("{}.n", "((({}) % 30) + 30) % 30"))
def stencil_wrap(spark, d):
    return _stencil(spark, d, g.wrap)


@query(_DAYS + "select a.t as day, coalesce(l.n, 0)::bigint as v from f a left join f l on l.t = (case when a.t + 1 between 0 and 29 then ((a.t + 1 - 1) % 30 + 30) % 30 end)")
def read_chain(spark, d):
    f = days(spark, d)
    f = f.with_value(f.value, "bigint")
    return named((f[g.wrap(g.zero(i + 1) - 1)] + 0 * f[i]).eval(), "day")


@query(_DAYS + "select x.t as day, coalesce(sum(a.n * b.n), 0)::bigint as v from f x left join f b on true left join f a on a.t = x.t - b.t group by 1")
def affine_conv(spark, d):
    f = days(spark, d)
    f = f.with_value(f.value, "bigint")
    out = g.Ix("t")
    return named(g.fold(f[g.zero(out - j)] * f[j], j).eval(), "day")


@query("""with c as (select n_nationkey, sum(n_regionkey + 1) over (order by n_nationkey) / 75.0 as cdf from nation), u as (select range as c_custkey, (range % 100) / 100.0 as u from range(300))
select c_custkey as draw, count(*) filter (where u > cdf)::int as at from u cross join c group by 1""")
def cdf_lookup(spark, d):
    p = vector(spark, d, "nation", "n_nationkey", F.col("n_regionkey") + 1)
    cdf = (g.scan(p[j], j) / 75.0).eval()
    u = (g.gen.iota(spark, (300,)) % 100) / 100.0
    return named(g.fold(1 * (u[i] > cdf[j]), j).eval(), "draw", value="at")


@query("select o_orderkey as order_, (r_regionkey * 10 + c_nationkey)::int as v from orders join customer on c_custkey = least(o_custkey, (select max(c_custkey) from customer)) join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey")
def gather_chain(spark, d):
    who = vector(spark, d, "orders", "o_orderkey", "o_custkey")
    nation = vector(spark, d, "customer", "c_custkey", "c_nationkey")
    region = vector(spark, d, "nation", "n_nationkey", "n_regionkey")
    at = nation[g.clamp(who[i])]
    return named((region[g.clamp(at)] * 10 + at).eval(), "order_")


# ---------------------------------------------------------------- scans


@query(_DAYS + "select t as day, sum(n) over (order by t)::bigint as v from f")
def scan_add(spark, d):
    f = days(spark, d)
    f = f.with_value(f.value, "bigint")
    return named(g.scan(f[i], i).eval(), "day")


@query("select event_id as event, round(sum(value) over (order by event_id rows unbounded preceding), 4) as v from events")
def scan_long(spark, d):
    return named(g.scan(vector(spark, d, "events", "event_id", "value")[i], i).eval(), "event", round_to=4)


@query(_E + "select vec_id as row, d::bigint as d, max(x) over (partition by vec_id order by d) as most, min(x) over (partition by vec_id order by d) as least from e")
def scan_extrema(spark, d):
    e = embeddings(spark, d)
    most, least = (g.scan(e[i, j], j, op).eval() for op in (g.Max, g.Min))
    return named(most, "row", "d", value="most").join(named(least, "row", "d", value="least"), ["row", "d"])


@query("select n_nationkey::bigint as nation, bit_xor(n_nationkey) over (order by n_nationkey)::int as x, bit_or(n_nationkey) over (order by n_nationkey)::int as o, bool_and(n_regionkey < 4) over (order by n_nationkey) as every, round(exp(sum(ln(n_regionkey + 1)) over (order by n_nationkey)) / 1e6, 4) as p from nation")
def scan_bits(spark, d):
    key = vector(spark, d, "nation", "n_nationkey", "n_nationkey")
    region = key.with_value(F.col("n_regionkey"), "int")
    out = named(g.scan(key[i], i, g.BitXor).eval(), "nation", value="x")
    out = out.join(named(g.scan(key[i], i, g.BitOr).eval(), "nation", value="o"), "nation")
    out = out.join(named(g.scan(region[i] < 4, i, g.And).eval(), "nation", value="every"), "nation")
    p = g.scan(1.0 * (region[i] + 1), i, g.Mul) / 1e6
    return out.join(named(p.eval(), "nation", value="p", round_to=4), "nation")


def _wrapping(xs: str, step: str) -> str:
    """A list of integers reduced modulo 2 ** 64 by ``step`` of a and b, as a signed number."""
    m = "18446744073709551616"
    low = f"list_transform({xs}, lambda x: ((x::hugeint % {m} + {m}) % {m})::uhugeint)"
    return f"list_reduce({low}, lambda a, b: ({step}) % {m}::uhugeint)"


def _signed(p: str) -> str:
    return f"case when {p} >= 9223372036854775808 then ({p}::hugeint - 18446744073709551616)::bigint else {p}::bigint end"


_FACTOR = "(case when o_orderkey % 3 = 0 then -1 else 1 end * (2 * o_custkey + 94906267))"


@query(f"with p as (select o_custkey % 5 as c, {_wrapping(f'list({_FACTOR})', 'a * b')} as p, {_wrapping(f'list({_FACTOR} * 90000000007)', 'a + b')} as s, {_wrapping('list(o_orderkey % 7 + 1)', 'a * b')} as q from orders group by 1) select c, {_signed('p')} as product, {_signed('s')} as total, {_signed('q')} as twos from p")
def fold_product_int(spark, d):
    """Products and sums far beyond 64 bits wrap around, as machine integers do."""
    o = table(spark, d, "orders")
    key = g.from_table(o, ["o_orderkey"], F.col("o_custkey"))
    odd = (2 * F.col("o_custkey") + 94906267) * F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1)
    cell = key.with_value(F.col("o_custkey") % 5, "bigint")
    out = None
    for name, v, op in (("product", odd, g.Mul), ("total", odd * 90000000007, g.Add), ("twos", F.col("o_orderkey") % 7 + 1, g.Mul)):
        one = named(g.scatter(g.drop(cell[i], 5), key.with_value(v, "bigint")[i], i, op=op).eval(), "c", value=name)
        out = one if out is None else out.join(one, "c")
    return out


@query(f"with l as (select n_nationkey as nation, list(2 * n_nationkey + 94906267) over (order by n_nationkey) as x, list((n_nationkey + 1) * 368934881474191) over (order by n_nationkey) as y from nation), p as (select nation, {_wrapping('x', 'a * b')} as p, {_wrapping('y', 'a + b')} as s from l) select nation::bigint as nation, {_signed('p')} as product, {_signed('s')} as total from p")
def scan_product_int(spark, d):
    key = vector(spark, d, "nation", "n_nationkey", F.col("n_nationkey").cast("bigint"))
    product = g.scan(key.with_value(2 * F.col("n_nationkey").cast("bigint") + 94906267, "bigint")[i], i, g.Mul)
    total = g.scan(key.with_value((F.col("n_nationkey").cast("bigint") + 1) * 368934881474191, "bigint")[i], i)
    return named(product.eval(), "nation", value="product").join(named(total.eval(), "nation", value="total"), "nation")


@query(_E + "select vec_id as row, d::bigint as d, round(sum(x) over (partition by vec_id order by d), 4) as along, max(x) over (partition by d order by vec_id) as down from e")
def scan_axis(spark, d):
    """Running reductions along an axis by its number."""
    e = embeddings(spark, d)
    return named(g.scan(e, 1).eval(), "row", "d", value="along", round_to=4).join(named(g.scan(e, -2, g.Max).eval(), "row", "d", value="down"), ["row", "d"])


@query(_DAYS + "select t as day, coalesce(sum(n) over (order by t rows between unbounded preceding and 1 preceding), 0)::bigint as v from f")
def scan_exclusive(spark, d):
    f = days(spark, d)
    s = g.scan(f.with_value(f.value, "bigint")[i], i).eval()
    return named((s[g.pad(i - 1, 0)] + 0 * s[i]).eval(), "day")


# ---------------------------------------------------------------- elementwise operators and functions


def _columns(spark, d, source: g.NdFrame, key: str, exprs: dict) -> DataFrame:
    """Several expressions over one array, each evaluated, side by side: one shuffle brings a cell's values together."""
    done = {n: e.eval().df for n, e in exprs.items()}
    kinds = {n: a.schema["v"].dataType for n, a in done.items()}
    rows = [a.select(F.col("d0").alias(key), *(F.struct(F.col("v")).alias(x) if x == n else F.lit(None).cast(f"struct<v:{kinds[x].simpleString()}>").alias(x) for x in done)) for n, a in done.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.groupBy(key).agg(*(F.max(x)["v"].alias(x) for x in done))


@query("""select o_orderkey as k, -o_custkey as neg, ~o_custkey as inv, o_custkey + o_orderkey as plus, o_custkey - o_orderkey as minus, o_custkey * 3 as times, (o_custkey - 700) // 7 as over, (o_custkey - 700) % 7 as rest,
o_custkey & 255 as band, o_custkey | 255 as bor, xor(o_custkey, 255) as bxor, (o_custkey << 2)::bigint as shl, o_custkey >> 2 as shr from orders""")
def elementwise_int(spark, d):
    c = vector(spark, d, "orders", "o_orderkey", "o_custkey")
    a, key = as_expr(c), as_expr(c.with_value(F.col("o_orderkey"), "bigint"))
    return _columns(spark, d, c, "k", {"neg": -a, "inv": ~a, "plus": a + key, "minus": a - key, "times": a * 3, "over": (a - 700) / 7, "rest": (a - 700) % 7, "band": a & 255, "bor": a | 255, "bxor": a ^ 255, "shl": a << 2, "shr": a >> 2})


@query("""select c_custkey as k, c_acctbal < 1000 as lt, c_acctbal > 1000 as gt, c_acctbal <= 0 as le, c_acctbal >= 0 as ge, c_acctbal = c_nationkey as eq, c_acctbal <> c_nationkey as ne, c_acctbal > 0 and c_nationkey > 5 as both_, c_acctbal > 0 or c_nationkey > 5 as either, not (c_acctbal > 0) as neither from customer""")
def elementwise_compare(spark, d):
    c = vector(spark, d, "customer", "c_custkey", "c_acctbal")
    a, n = as_expr(c), as_expr(c.with_value(F.col("c_nationkey"), "int"))
    return _columns(spark, d, c, "k", {"lt": a < 1000, "gt": a > 1000, "le": a <= 0, "ge": a >= 0, "eq": a == n, "ne": a != n, "both_": (a > 0).logical_and(n > 5), "either": (a > 0).logical_or(n > 5), "neither": (a > 0).logical_not()})


@query("select c_custkey as k, round(case when c_nationkey = 0 then case when c_acctbal > 0 then 'inf'::double when c_acctbal < 0 then '-inf'::double else 'nan'::double end else c_acctbal / c_nationkey end, 6) as ratio, c_nationkey // 3 as third, round(c_acctbal * 2 + c_nationkey - 1.5, 6) as mixed from customer")
def elementwise_float(spark, d):
    c = vector(spark, d, "customer", "c_custkey", "c_acctbal")
    n = c.with_value(F.col("c_nationkey"), "int")
    a, b = as_expr(c), as_expr(n)
    return _columns(spark, d, c, "k", {"ratio": a / b, "third": b / 3, "mixed": a * 2 + b - 1.5}).withColumns({"ratio": F.round("ratio", 6), "mixed": F.round("mixed", 6)})


def _math(spark, d, exprs) -> DataFrame:
    c = vector(spark, d, "customer", "c_custkey", F.col("c_acctbal") / 1000)
    out = _columns(spark, d, c, "k", exprs(as_expr(c)))
    return out.select("k", *(F.round(x, 6).alias(x) for x in out.columns[1:]))


_X = "(c_acctbal / 1000)"
_POS = f"case when {_X} < 0 then 'nan'::double when {_X} = 0 then '-inf'::double else {{}}(greatest({_X}, 1e-300)) end"


@query(f"select c_custkey as k, round(exp({_X}), 6) as exp, round(exp({_X}) - 1, 6) as expm1, round(2 ** {_X}, 6) as exp2, round({_POS.format('ln')}, 6) as log, round({_POS.format('log2')}, 6) as log2, round({_POS.format('log10')}, 6) as log10, round(case when {_X} < -1 then 'nan'::double else ln(greatest(1 + {_X}, 1e-300)) end, 6) as log1p, round(abs({_X}) ** 1.5, 6) as pow, round(case when {_X} < 0 then 'nan'::double else sqrt(greatest({_X}, 0)) end, 6) as sqrt, round(cbrt({_X}), 6) as cbrt, round(sqrt({_X} * {_X} + 4), 6) as hypot, round(sqrt({_X} * {_X} + 13), 6) as hypot3 from customer")
def math_powers(spark, d):
    m = g.math
    return _math(spark, d, lambda x: {"exp": m.exp(x), "expm1": m.expm1(x), "exp2": m.exp2(x), "log": m.log(x), "log2": m.log2(x), "log10": m.log10(x), "log1p": m.log1p(x), "pow": m.pow(m.abs(x), 1.5), "sqrt": m.sqrt(x), "cbrt": m.cbrt(x), "hypot": m.hypot(x, 2.0), "hypot3": m.hypot(x, 2.0, 3.0)})


_U = f"({_X} / 10)"


@query(f"select c_custkey as k, round(sin({_U}), 6) as sin, round(cos({_U}), 6) as cos, round(tan({_U}), 6) as tan, round(asin({_U}), 6) as asin, round(acos({_U}), 6) as acos, round(atan({_U}), 6) as atan, round(atan2({_U}, 0.5), 6) as atan2, round(sinh({_U}), 6) as sinh, round(cosh({_U}), 6) as cosh, round(tanh({_U}), 6) as tanh, round(asinh({_U}), 6) as asinh, round(acosh(1 + abs({_U})), 6) as acosh, round(atanh({_U} * 0.9), 6) as atanh from customer")
def math_trig(spark, d):
    m = g.math

    def exprs(x):
        u = x / 10.0
        return {"sin": m.sin(u), "cos": m.cos(u), "tan": m.tan(u), "asin": m.asin(u), "acos": m.acos(u), "atan": m.atan(u), "atan2": m.atan2(u, 0.5), "sinh": m.sinh(u), "cosh": m.cosh(u), "tanh": m.tanh(u), "asinh": m.asinh(u), "acosh": m.acosh(1.0 + m.abs(u)), "atanh": m.atanh(u * 0.9)}

    return _math(spark, d, exprs)


@query(f"select c_custkey as k, floor({_X}) + 0.0 as floor, ceil({_X}) + 0.0 as ceil, case when {_X} < 0 then -floor(-{_X} + 0.5) else floor({_X} + 0.5) end + 0.0 as round, trunc({_X}) + 0.0 as trunc, round({_X} - 3 * trunc({_X} / 3), 6) as fmod, round(abs({_X}), 6) as abs, round(greatest({_X} - 1, 0), 6) as fdim, round(least({_X}, 2), 6) as fmin, round(greatest({_X}, 2), 6) as fmax, round({_X} * 2 + 1, 6) as fma from customer")
def math_rounding(spark, d):
    m = g.math
    out = _math(spark, d, lambda x: {"floor": m.floor(x), "ceil": m.ceil(x), "round": m.round(x), "trunc": m.trunc(x), "fmod": m.fmod(x, 3.0), "abs": m.abs(x), "fdim": m.fdim(x, 1.0), "fmin": m.fmin(x, 2.0), "fmax": m.fmax(x, 2.0), "fma": m.fma(x, 2.0, 1.0)})
    return out.select("k", *((F.col(c) + 0.0).alias(c) for c in out.columns[1:]))


@query(f"select c_custkey as k, round({_X}, 6) as re, round({_X} * {_X} + 4, 6) as norm, round(atan2(2, {_X}), 6) as arg, round({_X} * {_X} + 4, 6) as square, round(sqrt({_X} * {_X} + 4), 6) as size from customer")
def math_complex(spark, d):
    m = g.math

    def exprs(x):
        z = m.complex_of(x, 2.0)
        return {"re": m.real(z), "norm": m.norm(z), "arg": m.arg(z), "square": m.real(m.cmul(z, m.conj(z))), "size": m.cabs(z)}

    return _math(spark, d, exprs)


_V = f"({_X} / 10.37)"


@query(f"select c_custkey as k, round(gamma(abs({_X}) + 1), 3) as tgamma, round(lgamma(abs({_X}) + 1), 6) as lgamma, round((5 * {_V} ** 3 - 3 * {_V}) / 2, 6) as legendre, round(8 * {_V} ** 3 - 12 * {_V}, 6) as hermite, round(({_V} ** 2 - 4 * {_V} + 2) / 2, 6) as laguerre from customer")
def math_special(spark, d):
    m = g.math
    out = _math(spark, d, lambda x: {"tgamma": m.tgamma(m.abs(x) + 1.0), "lgamma": m.lgamma(m.abs(x) + 1.0), "legendre": m.legendre(3, x / 10.37), "hermite": m.hermite(3, x / 10.37), "laguerre": m.laguerre(2, x / 10.37)})
    return out.withColumn("tgamma", F.round("tgamma", 3))


def _series(n: int, term: str) -> str:
    """Sum of ``term`` over t = 0 .. n - 1."""
    return f"list_sum(list_transform(range({n}), lambda t: {term}))"


def _integral(to: str, f: str, n: int = 400) -> str:
    """Simpson's rule for f of s from 0."""
    at = f.replace("s_", f"(({to}) * t / {n})")
    return f"(({to}) / {3 * n} * list_sum(list_transform(range({n + 1}), lambda t: (case when t in (0, {n}) then 1 when t % 2 = 1 then 4 else 2 end) * {at})))"


_Y, _H = "(u + 0.1)", "(0.9 * u)"
_SPECIAL = {
    "erf": f"2 / sqrt(pi()) * {_series(40, '(-1) ** t * u ** (2 * t + 1) / (gamma(t + 1) * (2 * t + 1))')}",
    "erfc": f"1 - 2 / sqrt(pi()) * {_series(40, '(-1) ** t * u ** (2 * t + 1) / (gamma(t + 1) * (2 * t + 1))')}",
    "beta": "1 / ((u + 1) * (u + 2))",
    "expint": f"0.57721566490153286061 + ln({_Y}) + {_series(40, f'{_Y} ** (t + 1) / ((t + 1) * gamma(t + 2))')}",
    "zeta": f"{_series(30, '(t + 1.0) ** (-(u + 2))')} + 30 ** (-(u + 1)) / (u + 1) - 30 ** (-(u + 2)) / 2 + (u + 2) * 30 ** (-(u + 3)) / 12 - (u + 2) * (u + 3) * (u + 4) * 30 ** (-(u + 5)) / 720",
    "j": f"sqrt(2 / (pi() * {_Y})) * (sin({_Y}) / {_Y} - cos({_Y}))",
    "i": f"{_series(30, '(u / 2) ** (2 * t + 1.5) / (gamma(t + 1) * gamma(t + 2.5))')}",
    "k_": f"sqrt(pi() / (2 * {_Y})) * exp(-{_Y}) * (1 + 1 / {_Y})",
    "y": f"-sqrt(2 / (pi() * {_Y})) * (cos({_Y}) / {_Y} + sin({_Y}))",
    "sj": f"sqrt(pi()) / 2 * u * u / 4 * {_series(30, '(-1) ** t * (u / 2) ** (2 * t) / (gamma(t + 1) * gamma(t + 3.5))')}",
    "sy": f"(1 - 3 / ({_Y} * {_Y})) * cos({_Y}) / {_Y} - 3 * sin({_Y}) / ({_Y} * {_Y})",
    "al": "15 * u * (1 - u * u)",
    "sl": "sqrt(7 / (480 * pi())) * 15 * cos(u) * sin(u) ** 2",
    "ag": "-u ** 3 / 6 + 5 * u ** 2 / 2 - 10 * u + 10",
    "e1": _integral("u", "1 / sqrt(1 - 0.25 * sin(s_) ** 2)"),
    "e2": _integral("u", "sqrt(1 - 0.25 * sin(s_) ** 2)"),
    "e3": _integral("u", "1 / ((1 - 0.3 * sin(s_) ** 2) * sqrt(1 - 0.25 * sin(s_) ** 2))"),
    "c1": _integral("pi() / 2", f"1 / sqrt(1 - ({_H} * sin(s_)) ** 2)"),
    "c2": _integral("pi() / 2", f"sqrt(1 - ({_H} * sin(s_)) ** 2)"),
    "c3": _integral("pi() / 2", f"1 / ((1 - 0.3 * sin(s_) ** 2) * sqrt(1 - ({_H} * sin(s_)) ** 2))"),
    "rem": "x - 3 * round_even(x / 3, 0)",
    "sign": "case when x < 0 then -u else u end",
}


@query(f"with q as (select c_custkey as k, {_X} as x, abs({_X}) / 10 as u from customer) select k, {', '.join(f'round({e}, 6) as {n}' for n, e in _SPECIAL.items())} from q")
def math_special_all(spark, d):
    m = g.math

    def exprs(x):
        u = m.abs(x) / 10.0
        return {"erf": m.erf(u), "erfc": m.erfc(u), "beta": m.beta(u + 1.0, 2.0), "expint": m.expint(u + 0.1), "zeta": m.riemann_zeta(u + 2.0), "j": m.cyl_bessel_j(1.5, u + 0.1), "i": m.cyl_bessel_i(1.5, u), "k_": m.cyl_bessel_k(1.5, u + 0.1), "y": m.cyl_neumann(1.5, u + 0.1), "sj": m.sph_bessel(2, u), "sy": m.sph_neumann(2, u + 0.1), "al": m.assoc_legendre(3, 2, u), "sl": m.sph_legendre(3, 2, u), "ag": m.assoc_laguerre(3, 2, u), "e1": m.ellint_1(0.5, u), "e2": m.ellint_2(0.5, u), "e3": m.ellint_3(0.5, 0.3, u), "c1": m.comp_ellint_1(u * 0.9), "c2": m.comp_ellint_2(u * 0.9), "c3": m.comp_ellint_3(u * 0.9, 0.3), "rem": m.remainder(x, 3.0), "sign": m.copysign(u, x)}

    return _math(spark, d, exprs)


@query("select c_custkey as k, round(c_acctbal * 2 + 1, 6) as v from customer")
def map_udf(spark, d):
    return named(g.map_by(lambda x: x * 2 + 1, vector(spark, d, "customer", "c_custkey", "c_acctbal")).eval(), "k", round_to=6)


# ---------------------------------------------------------------- generators, sampling, statistics, files


@query("select range as at, round(2.0 * (1 - range / 10.0) + 5.0 * (range / 10.0), 9) as v from range(11)")
def gen_linspace(spark, d):
    return named(g.gen.linspace(spark, 11, 2.0, 5.0).eval(), "at", round_to=9)


@query("select range // 4 as p, range % 4 as q, range + 7 as v from range(12)")
def gen_iota(spark, d):
    return named(g.gen.iota(spark, (3, 4), 7).eval(), "p", "q")


@query("select range as at, 2.5::double as v from range(6)")
def gen_fill(spark, d):
    return named(g.gen.fill(spark, (6,), 2.5).eval(), "at")


@query("select range // 3 as p, range % 3 as q, ((range // 3) * 10 + range % 3)::double as v from range(12)")
def fill_by(spark, d):
    return named(g.fill_by(spark, (4, 3), lambda a, b: a * 10 + b), "p", "q")


@query("select true as uniform, true as normal, true as exponential, true as choice")
def rng_moments(spark, d):
    """Means and variances of 40,000 draws lie within five standard errors."""
    g.gen.seed(2024)
    n = (40_000,)
    cases = {"uniform": (g.gen.uniform(spark, n), 0.5, 1 / 12), "normal": (g.gen.normal(spark, n), 0.0, 1.0), "exponential": (g.gen.exponential(spark, n, 2.0), 0.5, 0.25), "choice": (g.gen.choice(spark, n, [1.0, 2.0, 4.0], [1, 1, 2]), 2.75, 1.6875)}
    out = None
    for name, (e, mean, var) in cases.items():
        v = g.stats.mean_var(e).df
        ok = (F.abs(F.col("v.mean") - mean) < 5 * (var / n[0]) ** 0.5) & (F.abs(F.col("v.var") / var - 1) < 0.08)
        one = v.select(ok.alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def _philox_sql(cells: int, seed: int, streams: int) -> str:
    """Table p of Philox words a, b, c, d for each stream and cell, and table u with their uniform draws u and v."""
    mask, keys = (1 << 64) - 1, []
    for n in range(streams):
        x = g.gen._mix64(seed ^ g.gen._mix64(n)) & mask
        keys.append(f"({n}, {x & 0xFFFFFFFF}::ubigint, {x >> 32}::ubigint)")
    (m0, m1), (b0, b1), low = g.gen._MULTIPLY, g.gen._BUMP, 0xFFFFFFFF
    return f"""with recursive p as (select stream, range as cell, 0 as step, range::ubigint as a, 0::ubigint as b, 0::ubigint as c, 0::ubigint as d, k0, k1 from range({cells}), (values {', '.join(keys)}) s(stream, k0, k1)
union all select stream, cell, step + 1, xor(xor((c * {m1}) >> 32, b), k0), (c * {m1}) & {low}, xor(xor((a * {m0}) >> 32, d), k1), (a * {m0}) & {low}, (k0 + {b0}) & {low}, (k1 + {b1}) & {low} from p where step < {g.gen.ROUNDS}),
u as (select stream, cell, xor(a << 21, b >> 11)::double * 2.0 ** -53 as u, xor(c << 21, d >> 11)::double * 2.0 ** -53 as v from p where step = {g.gen.ROUNDS})"""


_OPEN = "(u + 2.0 ** -54)"
_NORMAL = "sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v)"


def _draws(*of_stream: str) -> str:
    """A column for each named expression over its stream's draws."""
    return ", ".join(f"round(max({x}) filter (stream = {n}), 5) as {name}" for n, (name, x) in enumerate(zip(of_stream[::2], of_stream[1::2], strict=True)))


@query(_philox_sql(2000, 2024, 6) + f"select cell as at, {_draws('uniform', 'u', 'normal', _NORMAL, 'exponential', '-ln(1 - u) / 2', 'weighted', 'case when u < 0.25 then 1.0 when u < 0.5 then 2.0 else 4.0 end', 'even', 'case when u < 0.5 then 3.0 else 5.0 end', 'sample', 'u + 10 * v')} from u group by cell")
def rng_draws(spark, d):
    """Every draw by its value: the generator's words are computed in SQL as well."""
    g.gen.seed(2024)
    n = (2000,)
    makers = {"uniform": g.gen.uniform(spark, n), "normal": g.gen.normal(spark, n), "exponential": g.gen.exponential(spark, n, 2.0), "weighted": g.gen.choice(spark, n, [1.0, 2.0, 4.0], [1, 1, 2]), "even": g.gen.choice(spark, n, [3.0, 5.0]), "sample": g.gen.sample(spark, n, lambda s: s.uniform() + 10 * s.uniform())}
    out = None
    for name, e in makers.items():
        one = named(e.eval(), "at", value=name, round_to=5)
        out = one if out is None else out.join(one, "at")
    return out


@query(_philox_sql(2000, 7, 9) + f"select cell as at, {_draws('rayleigh', 'sqrt(-2 * ln(1 - u))', 'weibull', '-ln(1 - u)', 'pareto', '1 / (1 - u)', 'lognormal', f'exp({_NORMAL})', 'cauchy', f'tan(pi() * ({_OPEN} - 0.5))', 'gumbel', f'-ln(-ln({_OPEN}))', 'logistic', f'ln({_OPEN} / (1 - {_OPEN}))')}, round(max(case stream when 7 then ln(1 - u) end) * -1 + max(case stream when 8 then ln(1 - u) end), 5) as laplace from u group by cell")
def rng_distributions(spark, d):
    g.gen.seed(7)
    n = (2000,)
    makers = {"rayleigh": g.gen.rayleigh, "weibull": g.gen.weibull, "pareto": g.gen.pareto, "lognormal": g.gen.lognormal, "cauchy": g.gen.cauchy, "gumbel": g.gen.gumbel, "logistic": g.gen.logistic, "laplace": g.gen.laplace}
    out = None
    for name, f in makers.items():
        one = named(f(spark, n).eval(), "at", value=name, round_to=5)
        out = one if out is None else out.join(one, "at")
    return out


@query("select round(avg(p_size), 6) as mean, round(var_samp(p_size), 6) as var, round(stddev_samp(p_size), 6) as std from part")
def stats_moments(spark, d):
    v = vector(spark, d, "part", "p_partkey", F.col("p_size").cast("double"))
    parts = {"mean": g.stats.mean(v), "var": g.stats.var(v), "std": g.stats.std(v)}
    out = None
    for name, a in parts.items():
        one = named(a, value=name, round_to=6)
        out = one if out is None else out.crossJoin(one)
    return out


@query("""with e as (select min(c_acctbal) lo, max(c_acctbal) hi from customer), b as (select least(greatest(floor((c_acctbal - lo) * (16 / (hi - lo))), 0), 15) as bin, count(*) n from customer, e group by 1)
select round((lo + bin * ((hi - lo) / 16) + lo + (bin + 1) * ((hi - lo) / 16)) / 2, 6) as mode from b, e order by n desc, bin limit 1""")
def stats_mode(spark, d):
    return named(g.stats.mode(vector(spark, d, "customer", "c_custkey", "c_acctbal"), 16), value="mode", round_to=6)


@query("select c_custkey as k, c_acctbal as v from customer")
def npy_round_trip(spark, d):
    import tempfile

    # a file on the driver's disk: for a session whose executors share it
    path = f"{tempfile.mkdtemp()}/a.npz"
    v = vector(spark, d, "customer", "c_custkey", "c_acctbal")
    g.npy.savez(path, {"balance": v})
    return named(g.npy.loadz(spark, path, {"balance": ("double", v.shape)})["balance"], "k")
