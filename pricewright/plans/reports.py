"""Small reports that operators had without a query: first rows, shares, weights, histories, presence, agreement and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.functions.columns import settled
from pricewright.operators import backtest, factors, forecast, metrics
from pricewright.operators import panel as op
from pricewright.plans.registry import query
from pricewright.sources.tables import table

R = "round(({}) + 1e-9, 6)"


@query("first_arrivals", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """The row of each key that came first, later ones dropped."""
    return op.latest(table(spark, d, "events"), ["user_id", "event_type"], [F.asc("event_id")]).select("user_id", "event_type", "event_id")


@query("moving_average_50", f"""SELECT l_orderkey, l_linenumber, l_suppkey, {R.format('m')} AS moving FROM (
  SELECT *, avg(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS m,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) AS n FROM lineitem) WHERE n >= 50""")
def moving_average_50(spark: SparkSession, d: str) -> DataFrame:
    """The mean of a supplier's last fifty lines, where there are fifty."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows = table(spark, d, "lineitem").withColumns({"m": F.avg("l_quantity").over(order.rowsBetween(-49, 0)), "n": F.row_number().over(order)})
    return rows.where("n >= 50").select("l_orderkey", "l_linenumber", "l_suppkey", settled(F.col("m")).alias("moving"))


@query("level_shares", f"""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_nationkey, c_mktsegment, n, {R.format('n / sum(n) OVER (PARTITION BY c_nationkey)::DOUBLE')} AS share FROM c
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) <= 3""")
def level_shares(spark: SparkSession, d: str) -> DataFrame:
    """The three commonest levels of each group and their shares of all its rows."""
    return op.top_levels(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", 3).withColumn("share", settled(F.col("share")))


@query("redundancy_weights", f"SELECT c_custkey, {R.format('1.0::DOUBLE / count(*) OVER (PARTITION BY c_nationkey, c_mktsegment)')} AS weight FROM customer")
def redundancy_weights(spark: SparkSession, d: str) -> DataFrame:
    """Each row weighs one over the size of its cluster."""
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    sizes = rows.groupBy("c_nationkey", "c_mktsegment").agg((1.0 / F.count("*")).alias("weight"))
    return rows.join(sizes, ["c_nationkey", "c_mktsegment"]).select("c_custkey", settled(F.col("weight")).alias("weight"))


@query("price_summary", f"""SELECT p_brand, {R.format('avg(p_retailprice)')} AS mean, {R.format('stddev_pop(p_retailprice)')} AS std, {R.format('quantile_cont(p_retailprice, 0.05)')} AS p05,
  {R.format('quantile_cont(p_retailprice, 0.5)')} AS p50, {R.format('quantile_cont(p_retailprice, 0.95)')} AS p95 FROM part GROUP BY 1""")
def price_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.summary(table(spark, d, "part"), "p_retailprice", ["p_brand"])
    return rows.select("p_brand", *[settled(F.col(c)).alias(c) for c in ("mean", "std", "p05", "p50", "p95")])


@query("mapped_markets", "SELECT s_suppkey, CASE n_regionkey WHEN 1 THEN 'US' WHEN 3 THEN 'EU' END AS market FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (1, 3)")
def mapped_markets(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers under the market that a fixed map gives their region; regions that it lacks go."""
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return op.mapped(rows, "n_regionkey", {1: "US", 3: "EU"}, "market").select("s_suppkey", "market")


@query("order_price_history", f"""WITH h AS (SELECT l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS units FROM lineitem GROUP BY 1, 2),
o AS (SELECT l_suppkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT h.l_suppkey, h.week, {R.format('units')} AS units, {R.format('price')} AS price FROM h LEFT JOIN o ON h.l_suppkey = o.l_suppkey AND h.week = o.week""")
def order_price_history(spark: SparkSession, d: str) -> DataFrame:
    """The shipped weeks of each supplier with the mean price of what was ordered in that week, where anything was."""
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    week = lambda c: F.to_date(F.date_trunc("week", c)).alias("week")
    shipped = line.groupBy("l_suppkey", week("l_shipdate")).agg(F.sum("l_quantity").alias("units"))
    bought = line.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", week("o_orderdate"))
    prices = bought.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    joined = shipped.join(prices, ["l_suppkey", "week"], "left")
    return joined.select("l_suppkey", "week", settled(F.col("units")).alias("units"), settled(F.col("price")).alias("price"))


@query("others_of_cluster", """WITH p AS (SELECT p_brand, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey END AS id, p_retailprice AS price FROM part), t AS (SELECT p_brand, min(id) AS target FROM p GROUP BY 1)
SELECT p.p_brand, t.target, count(*) AS n, round(sum(price) + 1e-6, 2) AS total FROM p JOIN t USING (p_brand) WHERE id IS DISTINCT FROM target GROUP BY 1, 2""")
def others_of_cluster(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a target's own cluster without the target; rows without an id stay."""
    part = table(spark, d, "part").select("p_brand", F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey")).alias("id"), F.col("p_retailprice").alias("price"))
    targets = part.groupBy("p_brand").agg(F.min("id").alias("target"))
    rows = part.join(targets, "p_brand").where(~F.col("id").eqNullSafe(F.col("target")))
    return rows.groupBy("p_brand", "target").agg(F.count("*").alias("n"), F.round(F.sum("price") + 1e-6, 2).alias("total"))


@query("presence_cells", """WITH l AS (SELECT l_partkey AS row_id, 'tax' AS feature, CAST(l_tax AS VARCHAR) AS value FROM lineitem UNION ALL SELECT l_partkey, 'discount', CAST(l_discount AS VARCHAR) FROM lineitem
  UNION ALL SELECT l_partkey, 'flag', CASE WHEN l_returnflag = 'R' THEN 'R' END FROM lineitem)
SELECT DISTINCT row_id, feature FROM l WHERE value IS NOT NULL AND trim(value) <> '' AND coalesce(TRY_CAST(value AS DOUBLE) <> 0, true)""")
def presence_cells(spark: SparkSession, d: str) -> DataFrame:
    """(row, feature) where any value is there, zeros and blanks not counting."""
    of = {"tax": F.col("l_tax").cast("string"), "discount": F.col("l_discount").cast("string"), "flag": F.when(F.col("l_returnflag") == "R", F.lit("R"))}
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in of.items()]))
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("row_id"), cells.alias("c"))
    return factors.presence(rows.select("row_id", "c.feature", "c.value"))


@query("order_agreement", f"""WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice / 1e5 AS price, month(o_orderdate) / 12.0::DOUBLE AS month, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END AS done,
  row_number() OVER w AS n, lag(o_totalprice / 1e5) OVER w AS pp, lag(month(o_orderdate) / 12.0::DOUBLE) OVER w AS pm, lag(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) OVER w AS pd
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, {R.format('pow((0.5 * exp(-(price - pp) * (price - pp)) + 0.5 * exp(-(month - pm) * (month - pm)) + exp(-(done - pd) * (done - pd))) / 2, 3)')} AS agreement FROM o WHERE n > 1""")
def order_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How far each order agrees with the customer's one before, redundant features weighing less."""
    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    of = {"price": F.col("o_totalprice") / 1e5, "month": F.month("o_orderdate") / 12.0, "done": F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)}
    rows = table(spark, d, "orders").withColumns({f"a_{k}": v for k, v in of.items()}).withColumn("n", F.row_number().over(before))
    rows = rows.withColumns({f"b_{k}": F.lag(f"a_{k}").over(before) for k in of}).where("n > 1")
    return rows.select("o_orderkey", settled(backtest.agreement(rows, list(of), [0, 0, 1])).alias("agreement"))


@query("guess_reconstruction", f"""WITH m AS (SELECT l_suppkey, avg(l_discount) AS guess FROM lineitem GROUP BY 1), e AS (SELECT l_discount AS y, guess FROM lineitem JOIN m USING (l_suppkey))
SELECT {R.format('sqrt(sum((guess - y) * (guess - y))) / sqrt(sum(y * y))')} AS relative_frobenius, {R.format('sqrt(avg((guess - y) * (guess - y)))')} AS rmse, {R.format('avg(abs(guess - y))')} AS mae FROM e""")
def guess_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    means = line.groupBy("l_suppkey").agg(F.avg("l_discount").alias("guess"))
    found = metrics.reconstruction(line.join(means, "l_suppkey"), "l_discount", "guess")
    return found.select(*[settled(F.col(c)).alias(c) for c in found.columns])


@query("model_evaluation", f"""WITH s AS (SELECT lang AS model, quality::DOUBLE AS y, (n_chars % 1000) / 1000.0::DOUBLE AS p FROM labels JOIN documents USING (doc_id) WHERE lang IS NOT NULL AND quality IS NOT NULL AND n_chars IS NOT NULL),
m AS (SELECT model, avg(y) AS mean FROM s GROUP BY 1), f AS (SELECT model, count(*) AS n, 1 - sum((p - y) * (p - y)) / nullif(sum((y - mean) * (y - mean)), 0) AS r2, avg((p - y) * (p - y)) AS mse, avg(abs(p - y)) AS mae FROM s JOIN m USING (model) GROUP BY 1),
r AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS r FROM s),
a AS (SELECT model, (sum(CASE WHEN y = 1 THEN r END) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc FROM r GROUP BY 1),
g AS (SELECT model, p, sum(y) AS hits, count(*) AS n FROM s GROUP BY 1, 2), c AS (SELECT model, hits, sum(hits) OVER w / sum(n) OVER w::DOUBLE AS prec FROM g WINDOW w AS (PARTITION BY model ORDER BY p DESC)),
v AS (SELECT model, sum(hits * prec) / sum(hits) AS ap FROM c GROUP BY 1)
SELECT model, f.n, {R.format('r2')} AS r2, {R.format('mse')} AS mse, {R.format('mae')} AS mae, {R.format('auc')} AS auc, {R.format('ap')} AS average_precision FROM f JOIN a USING (model) JOIN v USING (model)""")
def model_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation table of a guess by group: fit, error, and both areas."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    rows = rows.where("lang is not null").select(F.col("lang").alias("model"), F.col("quality").cast("double").alias("y"), ((F.col("n_chars") % 1000) / 1000.0).alias("guess"))
    rows = rows.where("y is not null and guess is not null")
    found = forecast.evaluated(rows).join(metrics.average_precision(rows, F.col("y") == 1, "guess", ["model"]), "model")
    return found.select("model", "n", *[settled(F.col(c)).alias(c) for c in ("r2", "mse", "mae", "auc", "average_precision")])
