"""Queries on catalogue and orders: parts are products, line items their SKUs' movements."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import commerce as ops


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _skus(spark, d):
    p = _t(spark, d, "part")
    return p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("spec"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 5).alias("stock"))


def product_search(spark, d):
    """SKUs in stock of one brand family within a price range."""
    return ops.search(_skus(spark, d), low=950.0, high=1400.0, specs=("E",)).select("product_id", "brand", "price")


def catalog_prices(spark, d):
    """Brands with their least price and SKUs in stock."""
    s = _skus(spark, d).where("stock > 0").drop("product_id").withColumnRenamed("brand", "product_id")
    return ops.price_from(s).select(F.col("product_id").alias("brand"), "price_from", "skus")


def catalog_nested(spark, d):
    """Products with what their line items add up to, and their three largest suppliers."""
    li = _t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    ranked = li.withColumn("r", F.row_number().over(W.partitionBy("l_partkey").orderBy(F.desc("q"), "l_suppkey"))).where("r <= 3")
    top = ranked.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "l_suppkey"))), lambda x: x["l_suppkey"]), ",").alias("suppliers"))
    return _t(spark, d, "part").join(top, "p_partkey", "left").select("p_partkey", "p_brand", F.coalesce("suppliers", F.lit("")).alias("suppliers"))


def _ladder(spark, d, suppliers):
    n = suppliers.select(F.col("s_suppkey").alias("need_id"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 60).alias("brand_wanted"), (F.col("s_suppkey") % 50).alias("size_wanted"))
    brand, size = {"p_brand": "brand_wanted"}, {"p_size": "size_wanted"}
    levels = [(F.col("p_retailprice") < 1200, brand | size), (None, brand | size), (None, size)]
    return ops.relaxed_counts(_t(spark, d, "part"), n, levels, "p_partkey")


def relaxation_ladder(spark, d):
    """The rows of relaxation_ladder_all, under its earlier name."""
    return relaxation_ladder_all(spark, d)


def relaxation_ladder_all(spark, d):
    """For each need, products of the first level that finds any: brand, size and price; brand and size; size."""
    return _ladder(spark, d, _t(spark, d, "supplier"))


def recommend_same_brand(spark, d):
    """The three cheapest other products of the brand, for every hundredth product."""
    p = _t(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice").where("p_brand is not null")
    price = F.col("p_retailprice").asc_nulls_last()
    # a product's three are of the four cheapest keys of its brand, as one of these may be its own; three rows of a key are enough
    rows = p.withColumn("_r", F.row_number().over(W.partitionBy("p_brand", "p_partkey").orderBy(price))).where("_r <= 3").drop("_r")
    keys = rows.groupBy("p_brand", "p_partkey").agg(F.min("p_retailprice").alias("p_retailprice"))
    keys = keys.withColumn("_r", F.row_number().over(W.partitionBy("p_brand").orderBy(price, "p_partkey"))).where("_r <= 4").select("p_brand", "p_partkey")
    a = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("product"), "p_brand")
    j = a.join(rows.join(keys, ["p_brand", "p_partkey"], "left_semi"), "p_brand").where("product <> p_partkey")
    r = F.row_number().over(W.partitionBy("product").orderBy(price, "p_partkey"))
    return j.withColumn("rank", r).where("rank <= 3").select("product", F.col("p_partkey").alias("other"), F.col("rank").cast("long").alias("rank"))


def category_paths(spark, d):
    """Suppliers by region and nation, with sums that roll up."""
    s = _t(spark, d, "supplier").join(F.broadcast(_t(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(_t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.rollup("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


def _security(spark, d, customers):
    o, c = _t(spark, d, "orders"), customers.select("c_custkey")
    asked = o.withColumn("asks", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1))
    return asked.join(c, F.col("asks") == F.col("c_custkey")).groupBy("asks").agg(F.count("*").alias("asked"), F.count_if(F.col("asks") == F.col("o_custkey")).alias("seen"))


def order_security(spark, d):
    """The rows of order_security_all, under its earlier name."""
    return order_security_all(spark, d)


def order_security_all(spark, d):
    """Orders a customer may see when asking for the neighbour's: none; and their own."""
    return _security(spark, d, _t(spark, d, "customer"))


def order_expiry(spark, d):
    """The two hundred oldest open orders past their time to pay."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("paid").alias("status"), F.col("o_orderdate").alias("placed_at"))
    return ops.expired(o, F.expr("timestamp_ntz '1998-01-01 00:00:00'"), "30 MINUTES", 200).select("order_id", "placed_at")


# Which event moves an order of users' logs from where to where.
MOVES = [("view", ["new"], "seen"), ("click", ["seen", "lost"], "wanted"), ("purchase", ["wanted"], "bought"), ("error", ["seen", "wanted"], "lost"), ("signup", ["bought"], "new")]


def order_states(spark, d):
    """Users' states after folding all their events, and moves refused."""
    return ops.fold_states(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", MOVES, "new")


def stock_fold(spark, d):
    """Stock of every supplier's part after taking and restoring in order, from thirty each."""
    li = _t(spark, d, "lineitem")
    e = li.select((F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("sku"), F.col("l_shipdate").alias("at"), "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(-F.col("l_quantity")).cast("long").alias("change"))
    return ops.fold_stock(e, "sku", ["at", "l_orderkey", "l_linenumber"], "change", F.lit(30))


def idempotent_orders(spark, d):
    """Orders kept when a customer's orders of one day are one request, the least key first."""
    o = _t(spark, d, "orders")
    r = F.row_number().over(W.partitionBy("o_custkey", F.to_date("o_orderdate")).orderBy("o_orderkey"))
    return o.withColumn("r", r).where("r = 1").groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def monthly_mart(spark, d):
    """Line items by month and flag, with price, discount and tax summed up."""
    li = _t(spark, d, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy(F.date_format("l_shipdate", "yyyyMM").alias("ym"), "l_returnflag").agg(F.round(F.sum(net), 2).alias("revenue"), F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("charge"), F.count("*").alias("lines"))


def shelf_blockers(spark, d):
    """Products that nothing ever sold of, or without stock."""
    p = _skus(spark, d)
    sold = _t(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("product_id")).distinct().withColumn("sold", F.lit(True))
    j = p.join(sold, "product_id", "left")
    why = F.array_compact(F.array(F.when(F.col("sold").isNull(), "no_sales"), F.when(F.col("stock") == 0, "no_stock")))
    return j.select("product_id", F.array_join(why, "+").alias("why")).where("why <> ''")


def interval_overlaps(spark, d):
    """Pairs of a user's spans, one a click and one a view, that overlap; spans are ten hours long."""
    e = _t(spark, d, "events")
    span = lambda kind: e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("begin"), (F.unix_seconds(F.col("ts").cast("timestamp")) + 36000).alias("end"))
    o = ops.overlapping(span("click"), span("view"), "user_id", 36000)
    return o.groupBy("user_id").agg(F.count("*").alias("pairs"), F.sum(F.least("a_end", "b_end") - F.greatest("a_begin", "b_begin")).alias("seconds"))


def top_customers(spark, d):
    """The three customers of most spending in each nation."""
    c = _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", "c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("spent"), "c_custkey")).cast("long")).where("rank <= 3")


QUERIES = {f.__name__: f for f in (product_search, catalog_prices, catalog_nested, relaxation_ladder, relaxation_ladder_all, recommend_same_brand, category_paths, order_security, order_security_all, order_expiry, order_states, stock_fold, idempotent_orders, monthly_mart, shelf_blockers, interval_overlaps, top_customers)}

ORACLES = {
    "product_search": "select p_partkey product_id, p_brand brand, p_retailprice price from part where p_size % 5 > 0 and p_retailprice between 950 and 1400 and contains(p_type, 'E')",
    "catalog_prices": "select p_brand brand, min(p_retailprice) price_from, count(*) skus from part where p_size % 5 > 0 group by 1",
    "catalog_nested": """with q as (select l_partkey, l_suppkey, row_number() over (partition by l_partkey order by sum(l_quantity) desc, l_suppkey) r from lineitem group by 1, 2), t as (select l_partkey, string_agg(l_suppkey::varchar, ',' order by r) s from q where r <= 3 group by 1)
        select p_partkey, p_brand, coalesce(s, '') suppliers from part left join t on p_partkey = l_partkey""",
    "relaxation_ladder": """with n as (select s_suppkey need_id, 'Brand#' || (s_suppkey % 60) b, s_suppkey % 50 z from supplier),
        f as (select need_id, p_partkey, (case when p_brand = b and p_retailprice < 1200 then 0 when p_brand = b then 1 else 2 end)::int as level from n join part on p_size = z), g as (select *, min(level) over (partition by need_id) m from f)
        select need_id, level, count(*) products, min(p_partkey) first_product from g where level = m group by all""",
    "recommend_same_brand": "with j as (select a.p_partkey product, b.p_partkey other, row_number() over (partition by a.p_partkey order by b.p_retailprice, b.p_partkey) as rank from part a join part b on a.p_brand = b.p_brand and a.p_partkey <> b.p_partkey where a.p_partkey % 100 = 0) select * from j where rank <= 3",
    "category_paths": "select r_name, n_name, count(*) suppliers, round(sum(s_acctbal), 2) balance from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)",
    "order_security": "with a as (select *, case when o_orderkey % 2 = 0 then o_custkey else o_custkey + 1 end asks from orders) select asks, count(*) asked, count(*) filter (asks = o_custkey) seen from a where asks in (select c_custkey from customer) group by 1",
    "order_expiry": "select o_orderkey order_id, o_orderdate placed_at from orders where o_orderstatus = 'O' and o_orderdate < timestamp '1998-01-01' - interval 30 minutes order by o_orderdate, o_orderkey limit 200",
    "order_states": """with recursive o as (select user_id, event_type e, row_number() over (partition by user_id order by ts, event_id) i from events),
        f as (select distinct user_id, 0::bigint i, 'new' s, 0::bigint r from events union all
          select f.user_id, o.i, coalesce(t.t, f.s), f.r + (t.t is null)::int from f join o on o.user_id = f.user_id and o.i = f.i + 1
          left join (values ('view', 'new', 'seen'), ('click', 'seen', 'wanted'), ('click', 'lost', 'wanted'), ('purchase', 'wanted', 'bought'), ('error', 'seen', 'lost'), ('error', 'wanted', 'lost'), ('signup', 'bought', 'new')) t(e, s, t) on t.e = o.e and t.s = f.s)
        select user_id, arg_max(s, i) as state, max(r) refused from f group by 1""",
    "stock_fold": """with recursive o as (select l_partkey * 100000 + l_suppkey sku, case when l_returnflag = 'R' then l_quantity else -l_quantity end::bigint d, row_number() over (partition by l_partkey, l_suppkey order by l_shipdate, l_orderkey, l_linenumber, case when l_returnflag = 'R' then l_quantity else -l_quantity end) i from lineitem),
        f as (select distinct sku, 0::bigint i, 30::bigint l, 0::bigint s, 0::bigint r from o union all
          select f.sku, o.i, case when f.l + d >= 0 then f.l + d else f.l end, case when f.l + d >= 0 and d < 0 then f.s - d else f.s end, f.r + (f.l + d < 0)::int from f join o on o.sku = f.sku and o.i = f.i + 1)
        select sku, arg_max(l, i) as left, arg_max(s, i) sold, arg_max(r, i) refused from f group by 1""",
    "idempotent_orders": "with a as (select *, row_number() over (partition by o_custkey, o_orderdate::date order by o_orderkey) r from orders) select o_orderstatus, count(*) orders, round(sum(o_totalprice), 2) total from a where r = 1 group by 1",
    "monthly_mart": "select strftime(l_shipdate, '%Y%m') ym, l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) charge, count(*) as lines from lineitem group by all",
    "shelf_blockers": "with a as (select p_partkey product_id, concat_ws('+', case when p_partkey not in (select l_partkey from lineitem where l_quantity > 49) then 'no_sales' end, case when p_size % 5 = 0 then 'no_stock' end) why from part) select * from a where why <> ''",
    "interval_overlaps": """with s as (select user_id, event_type k, floor(epoch(ts))::bigint b, floor(epoch(ts))::bigint + 36000 e from events) select a.user_id, count(*) pairs, sum(least(a.e, b.e) - greatest(a.b, b.b))::bigint as seconds from s a join s b on a.user_id = b.user_id and a.k = 'click' and b.k = 'view' and a.e > b.b and a.b < b.e group by 1""",
    "top_customers": "with a as (select c_nationkey, c_custkey, round(sum(o_totalprice), 2) spent from customer join orders on c_custkey = o_custkey group by all), b as (select *, row_number() over (partition by c_nationkey order by spent desc, c_custkey) as rank from a) select * from b where rank <= 3",
}
# The whole tables, by the SQL of the subsets.
ORACLES["relaxation_ladder_all"] = ORACLES["relaxation_ladder"]
ORACLES["order_security_all"] = ORACLES["order_security"]
