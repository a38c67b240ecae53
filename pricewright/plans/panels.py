"""Panel, join, aggregate, window and set queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.functions import columns as fc
from pricewright.functions.columns import ratio, settled, share
from pricewright.operators import panel as op
from pricewright.operators.asof import asof_nearest
from pricewright.plans.registry import query
from pricewright.sources.tables import keys_of, matching, table, union_of

KEYS = ("brand", "region")
R = "round(({}) + 1e-9, 6)"


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with the brand and the region that stand for product and marketplace."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    place = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    return (
        line.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(place, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("p_brand").alias("brand"),
            F.col("n_regionkey").alias("region"),
            F.to_date("l_shipdate").alias("day"),
            "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        )
    )


SALES = """
sales AS (
  SELECT p_brand AS brand, n_regionkey AS region, CAST(l_shipdate AS DATE) AS day, l_orderkey, l_quantity,
         l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey)"""


def spine(spark: SparkSession, d: str) -> DataFrame:
    """Weekly traffic, units, revenue and the prices that come with them."""
    rows = sales(spark, d)
    weeks = op.weekly(
        rows, KEYS, "day",
        sessions=F.count("*"),
        units=F.count_if(F.col("l_returnflag") == "R"),
        revenue=F.sum("l_extendedprice"),
        quantity=F.sum("l_quantity"),
        listing_price=F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice") / F.col("l_quantity"))),
        buybox_pct=share(F.col("l_linestatus") == "F") * 100,
    )
    weeks = weeks.withColumn("implied_price", ratio(F.col("revenue"), F.col("quantity")))
    weeks = weeks.withColumn("cvr", ratio(F.col("units"), F.col("sessions")))
    return weeks.withColumn("raw_price", F.col("listing_price"))


SPINE = SALES + """,
spine AS (
  SELECT brand, region, CAST(date_trunc('week', day) AS DATE) AS week, count(*) AS sessions,
         count(*) FILTER (WHERE l_returnflag = 'R') AS units, sum(l_extendedprice) AS revenue, sum(l_quantity) AS quantity,
         avg(CASE WHEN l_returnflag = 'A' THEN l_extendedprice / l_quantity END) AS listing_price,
         avg(CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS buybox_pct
  FROM sales GROUP BY ALL),
priced AS (
  SELECT *, revenue / nullif(quantity, 0) AS implied_price, units::DOUBLE / nullif(sessions, 0) AS cvr,
         listing_price AS raw_price FROM spine)"""


@query("weekly_spine", f"WITH {SPINE} SELECT brand, region, week, sessions, units, {R.format('revenue')} AS revenue, "
       f"{R.format('implied_price')} AS implied_price, {R.format('cvr')} AS cvr, {R.format('buybox_pct')} AS buybox_pct FROM priced")  # fmt: skip
def weekly_spine(spark: SparkSession, d: str) -> DataFrame:
    rows = spine(spark, d)
    doubles = ("revenue", "implied_price", "cvr", "buybox_pct")
    return rows.select(*KEYS, "week", "sessions", "units", *[settled(F.col(c)).alias(c) for c in doubles])


def offers(spark: SparkSession, d: str) -> DataFrame:
    """Weekly competitor figures by region: distinct orders, spread, extremes and rates."""
    return op.weekly(
        sales(spark, d), ("region",), "day",
        n_sellers=F.countDistinct("l_orderkey"),
        lowest=F.min("l_extendedprice"),
        highest=F.max("l_extendedprice"),
        price_dispersion=F.stddev_samp("l_extendedprice"),
        discount=F.avg("l_discount"),
        is_fba=share(F.col("l_linestatus") == "F"),
        any_returned=F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)),
    )


OFFERS = """
offers AS (
  SELECT region, CAST(date_trunc('week', day) AS DATE) AS week, count(DISTINCT l_orderkey) AS n_sellers,
         min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest, stddev_samp(l_extendedprice) AS price_dispersion,
         avg(l_discount) AS discount, avg(CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS is_fba,
         max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS any_returned
  FROM sales GROUP BY ALL)"""


@query("offer_week", f"WITH {SALES}, {OFFERS} SELECT region, week, n_sellers, lowest, highest, "
       f"{R.format('price_dispersion')} AS price_dispersion, {R.format('discount')} AS discount, {R.format('is_fba')} AS is_fba, any_returned FROM offers")  # fmt: skip
def offer_week(spark: SparkSession, d: str) -> DataFrame:
    doubles = ("price_dispersion", "discount", "is_fba")
    return offers(spark, d).select(
        "region", "week", "n_sellers", "lowest", "highest", *[settled(F.col(c)).alias(c) for c in doubles], "any_returned"
    )


def month_orders(spark: SparkSession, d: str) -> DataFrame:
    """Monthly order facts by region of the customer."""
    orders, customer, nation = (table(spark, d, n) for n in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    rows = rows.select(F.col("n_regionkey").alias("region"), F.to_date("o_orderdate").alias("day"), "o_totalprice", "o_orderstatus")
    return op.monthly(
        rows, ("region",), "day",
        positive_share=F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))),
        n_customers=F.count("*"),
    )


MONTHS = """
months AS (
  SELECT n_regionkey AS region, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS positive_share, count(*) AS n_customers
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""

FILL = """
filled AS (
  SELECT *, coalesce(last_value(raw_price IGNORE NULLS) OVER past, first_value(raw_price IGNORE NULLS) OVER ahead) AS filled_price
  FROM priced
  WINDOW past AS (PARTITION BY brand, region ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY brand, region ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("cvr_panel", f"""WITH {SPINE}, {OFFERS}, {FILL}
SELECT f.brand, f.region, f.week, CAST(weekofyear(f.week) AS INTEGER) AS week_of_year, CAST(month(f.week) AS INTEGER) AS month,
       {R.format('f.cvr')} AS cvr, f.units, f.sessions, {R.format('coalesce(f.filled_price, f.implied_price)')} AS price,
       o.lowest AS lowest_price, {R.format('coalesce(f.filled_price, f.implied_price) / nullif(o.lowest, 0)')} AS price_vs_lowest,
       o.n_sellers
FROM filled f LEFT JOIN offers o ON f.region = o.region AND f.week = o.week""")  # fmt: skip
def cvr_panel(spark: SparkSession, d: str) -> DataFrame:
    """The weekly conversion panel: coalesced prices, gaps filled both ways, offers joined."""
    rows = op.filled(spine(spark, d), KEYS, "week", ["raw_price"])
    rows = rows.withColumn("price", F.coalesce("raw_price", "implied_price"))
    side = offers(spark, d).select("region", "week", F.col("lowest").alias("lowest_price"), "n_sellers")
    rows = op.price_relations(op.attach(rows, side, ["region", "week"]))
    return rows.select(
        *KEYS, "week", F.weekofyear("week").alias("week_of_year"), F.month("week").alias("month"),
        settled(F.col("cvr")).alias("cvr"), "units", "sessions", settled(F.col("price")).alias("price"), "lowest_price",
        settled(F.col("price_vs_lowest")).alias("price_vs_lowest"), "n_sellers",
    )


@query("bbox_panel", f"""WITH {SPINE}, {OFFERS}, {MONTHS}, {FILL},
fees AS (SELECT brand, region, CAST(date_trunc('week', day) AS DATE) AS week, sum(l_tax * l_extendedprice) / nullif(sum(l_quantity), 0) AS fba_fee
         FROM sales GROUP BY ALL)
SELECT f.brand, f.region, f.week, {R.format('f.buybox_pct')} AS buybox_pct, {R.format('f.filled_price')} AS price,
       o.highest AS bb_price, {R.format('f.filled_price / nullif(o.highest, 0)')} AS price_vs_bb, {R.format('e.fba_fee')} AS fba_fee,
       {R.format('m.positive_share')} AS positive_share, m.n_customers,
       CASE WHEN f.buybox_pct >= 100 THEN 'WON' WHEN f.buybox_pct <= 0 THEN 'LOST' ELSE 'MIXED' END AS outcome
FROM filled f LEFT JOIN offers o ON f.region = o.region AND f.week = o.week
LEFT JOIN fees e ON f.brand = e.brand AND f.region = e.region AND f.week = e.week
LEFT JOIN months m ON f.region = m.region AND m.month = CAST(date_trunc('month', f.week) AS DATE)""")  # fmt: skip
def bbox_panel(spark: SparkSession, d: str) -> DataFrame:
    """The weekly featured-offer panel: price block, offers, fees, monthly facts and the outcome class."""
    rows = op.filled(spine(spark, d), KEYS, "week", ["raw_price"]).withColumn("price", F.col("raw_price"))
    side = offers(spark, d).select("region", "week", F.col("highest").alias("bb_price"))
    fees = op.weekly(
        sales(spark, d), KEYS, "day", fba_fee=ratio(F.sum(F.col("l_tax") * F.col("l_extendedprice")), F.sum("l_quantity"))
    )
    rows = op.attach(op.attach(rows, side, ["region", "week"]), fees, [*KEYS, "week"])
    rows = op.attach_monthly(rows, month_orders(spark, d), ["region"])
    rows = rows.withColumn("price_vs_bb", ratio(F.col("price"), F.col("bb_price")))
    doubles = {c: settled(F.col(c)).alias(c) for c in ("buybox_pct", "price", "price_vs_bb", "fba_fee", "positive_share")}
    return rows.select(
        *KEYS, "week", doubles["buybox_pct"], doubles["price"], "bb_price", doubles["price_vs_bb"], doubles["fba_fee"],
        doubles["positive_share"], "n_customers", outcome(F.col("buybox_pct")).alias("outcome"),
    )


def outcome(pct):
    """WON at 100 %, LOST at 0 %, MIXED between; null stays null."""
    return F.when(pct >= 100, "WON").when(pct <= 0, "LOST").when(pct.isNotNull(), "MIXED")


@query("asof_nearest", """
WITH l AS (SELECT event_id, user_id % 50 AS k, ts FROM events WHERE event_type = 'purchase'),

r2 AS (SELECT event_id AS seq, user_id % 50 AS k, ts, value FROM events WHERE event_type = 'click'),
c AS (SELECT l.event_id, l.ts AS at, r2.ts AS matched, r2.value,
  row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r2.ts)), CASE WHEN r2.ts <= l.ts THEN 0 ELSE 1 END,
    CASE WHEN r2.ts <= l.ts THEN -r2.seq ELSE r2.seq END) AS place
  FROM l LEFT JOIN r2 ON l.k = r2.k)
SELECT event_id, matched, round(value + 1e-9, 6) AS value FROM c WHERE place = 1""")
def asof(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the nearest click of its group."""
    rows = table(spark, d, "events").withColumn("k", F.col("user_id") % 50)
    left = rows.where("event_type = 'purchase'").select("event_id", "k", "ts")
    right = rows.where("event_type = 'click'").select("k", "ts", "value", "event_id")
    out = asof_nearest(left, right, "ts", ["k"], ["value"], "event_id")
    return out.select("event_id", F.col("ts_matched").alias("matched"), settled(F.col("value")).alias("value"))


@query("latest_snapshot", """
SELECT user_id, event_id, event_type, round(value + 1e-9, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    rows = op.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return rows.select("user_id", "event_id", "event_type", settled(F.col("value")).alias("value"))


@query("semi_tracked", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_tracked(spark: SparkSession, d: str) -> DataFrame:
    tracked = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    orders = table(spark, d, "orders")
    return orders.join(tracked, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("anti_leakfree", """SELECT p_partkey, p_brand FROM part p WHERE NOT EXISTS (
  SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)""")
def anti_leakfree(spark: SparkSession, d: str) -> DataFrame:
    """Parts that share no key with a target set."""
    target = table(spark, d, "lineitem").where("l_quantity > 45")
    part = table(spark, d, "part")
    return part.join(target, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_brand")


@query("set_coverage", """
WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders),
j AS (SELECT a.k AS l, b.k AS r FROM a FULL JOIN b ON a.k = b.k)
SELECT count(l) AS n_left, count(r) AS n_right, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS n_both,
  count(l) - count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS n_left_only,
  round(100.0 * count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) / count(l) + 1e-9, 6) AS covered_pct FROM j""")
def set_coverage(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return op.key_overlap(left, right, "k").withColumn("covered_pct", settled(F.col("covered_pct")))


@query("key_intersection", "SELECT user_id AS k FROM events INTERSECT SELECT c_custkey FROM customer")
def key_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("k")).intersect(table(spark, d, "customer").select("c_custkey"))


@query("case_insensitive_terms", """SELECT min(t) AS term FROM (
  SELECT c_mktsegment AS t FROM customer UNION ALL SELECT lower(c_mktsegment) FROM customer UNION ALL SELECT r_name FROM region)
  WHERE t IS NOT NULL AND trim(t) <> '' GROUP BY lower(t)""")
def case_insensitive_terms(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").select(F.col("c_mktsegment").alias("term"))
    rows = union_of([names, names.select(F.lower("term").alias("term")), table(spark, d, "region").select(F.col("r_name").alias("term"))])
    return op.distinct_ignoring_case(rows, "term")


@query("term_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%Red%'")
def term_search(spark: SparkSession, d: str) -> DataFrame:
    return matching(table(spark, d, "part"), "p_name", "RED", allowed=("p_name",)).select("p_partkey", "p_name")


@query("distinct_keys", "SELECT DISTINCT trim(c_mktsegment) AS c_mktsegment FROM customer WHERE trim(c_mktsegment) <> ''")
def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return keys_of(table(spark, d, "customer"), "c_mktsegment")


@query("lookback_window", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
  WHERE CAST(o_orderdate AS DATE) >= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - INTERVAL 90 DAY""")
def lookback_window(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return op.since(rows, "day", 90)


@query("quality_filter", """SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 0 AND o_orderpriority IS NOT NULL
  AND o_orderpriority <> '' AND o_custkey IS NOT NULL""")
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where("o_orderstatus <> 'P' and o_totalprice > 0")
    return rows.where("o_orderpriority is not null and o_orderpriority <> '' and o_custkey is not null").select("o_orderkey")


@query("delivery_days", """SELECT o_orderpriority, round(avg(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) + 1e-9, 6) AS days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def delivery_days(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return rows.groupBy("o_orderpriority").agg(settled(F.avg(days)).alias("days"))


@query("fee_fan_out", """SELECT p_brand, round(sum(o_totalprice) / nullif(sum(l_quantity), 0) + 1e-9, 6) AS fee_per_unit, count(*) AS n
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def fee_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Order-level fees over order lines, fanned out as they are booked."""
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    fee = settled(ratio(F.sum("o_totalprice"), F.sum("l_quantity")))
    return rows.groupBy("p_brand").agg(fee.alias("fee_per_unit"), F.count("*").alias("n"))


@query("lookup_join", """SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey""")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select("s_suppkey", "n_name", "r_name")


@query("multiway_inner", """SELECT a.k, a.n_lines, b.n_orders, c.n_events FROM
  (SELECT l_suppkey AS k, count(*) AS n_lines FROM lineitem GROUP BY 1) a
  JOIN (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1) b ON a.k = b.k
  JOIN (SELECT user_id AS k, count(*) AS n_events FROM events GROUP BY 1) c ON a.k = c.k""")
def multiway_inner(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are in every table."""
    out = None
    for name, key, alias in (("lineitem", "l_suppkey", "n_lines"), ("orders", "o_custkey", "n_orders"), ("events", "user_id", "n_events")):
        one = table(spark, d, name).groupBy(F.col(key).alias("k")).agg(F.count("*").alias(alias))
        out = one if out is None else out.join(one, "k")
    return out


@query("pivot_backtest", """SELECT strftime(CAST(date_trunc('week', day) AS DATE) + 3, '%Y') || '-W' || lpad(CAST(weekofyear(day) AS VARCHAR), 2, '0') AS week,
""" + ", ".join(
    f"round(sum(CASE WHEN region = {r} THEN l_quantity END) + 1e-9, 6) AS r{r}_units, min(CASE WHEN region = {r} THEN l_extendedprice END) AS r{r}_price"
    for r in range(5)) + f" FROM (WITH {SALES} SELECT * FROM sales) GROUP BY 1")
def pivot_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Weeks by region and measure, wide, for a fixed list of regions."""
    rows = sales(spark, d).groupBy(fc.iso_label(F.col("day")).alias("week"), F.concat(F.lit("r"), "region").alias("r"))
    rows = rows.agg(settled(F.sum("l_quantity")).alias("units"), F.min("l_extendedprice").alias("price"))
    return op.pivot_first(rows, "week", "r", [f"r{i}" for i in range(5)], ["units", "price"])


@query("seasonal_index", """WITH w AS (SELECT CAST(greatest(1, least(52, weekofyear(l_shipdate))) AS INTEGER) AS week, avg(l_quantity) AS mean FROM lineitem GROUP BY 1),
k AS (SELECT count(*) AS n, avg(mean) AS whole FROM w), f AS (
  SELECT CAST(s.week AS INTEGER) AS week, coalesce(w.mean, k.whole) AS full_mean, k.n FROM range(1, 53) s(week) LEFT JOIN w ON s.week = w.week, k)
SELECT week, round(CASE WHEN n >= 26 THEN full_mean / avg(full_mean) OVER () ELSE 1.0 END + 1e-9, 6) AS season FROM f""")
def seasonal(spark: SparkSession, d: str) -> DataFrame:
    rows = op.seasonal_index(table(spark, d, "lineitem"), "l_shipdate", "l_quantity")
    return rows.select("week", settled(F.col("season")).alias("season"))


@query("nb_dispersion", """WITH u AS (SELECT l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, round(CASE WHEN count(n) < 8 THEN 1.0 WHEN var_pop(n) <= avg(n) THEN 10.0 ELSE avg(n) * avg(n) / (var_pop(n) - avg(n)) END + 1e-9, 6) AS r
FROM u GROUP BY 1""")
def nb_dispersion(spark: SparkSession, d: str) -> DataFrame:
    months = op.monthly(table(spark, d, "lineitem"), ("l_partkey",), "l_shipdate", n=F.count("*"))
    return months.groupBy("l_partkey").agg(settled(op.dispersion(F.col("n"))).alias("r"))


@query("coverage", """SELECT * FROM (VALUES ('o_orderkey', (SELECT avg((o_orderkey IS NOT NULL)::INT::DOUBLE) FROM orders)),
  ('o_totalprice', (SELECT avg((o_totalprice IS NOT NULL)::INT::DOUBLE) FROM orders))) t("column", share)""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return op.coverage(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"])


@query("value_histogram", """SELECT CAST(least(floor(value / 0.5::DOUBLE) + 1, 20) AS INTEGER) AS bin, count(*) AS n
  FROM events WHERE value BETWEEN 0 AND 10 GROUP BY 1""")
def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    return op.histogram(table(spark, d, "events"), "value", 0.0, 10.0, 20)


@query("price_cv", f"""WITH {SPINE}, g AS (SELECT brand, region, count(listing_price) AS n, stddev_samp(listing_price) / nullif(avg(listing_price), 0) AS cv FROM spine GROUP BY 1, 2)
SELECT brand, region, n, {R.format('cv')} AS cv, n >= 8 AND cv >= 0.02 AS eligible FROM g""")
def price_cv(spark: SparkSession, d: str) -> DataFrame:
    """Series with enough priced weeks and enough movement to be studied."""
    rows = spine(spark, d).groupBy(*KEYS).agg(
        F.count("listing_price").alias("n"), ratio(F.stddev_samp("listing_price"), F.avg("listing_price")).alias("cv")
    )
    return rows.select(*KEYS, "n", settled(F.col("cv")).alias("cv"), ((F.col("n") >= 8) & (F.col("cv") >= 0.02)).alias("eligible"))


@query("won_lost_profile", f"""WITH {SPINE}, c AS (SELECT CASE WHEN buybox_pct >= 100 THEN 'WON' WHEN buybox_pct <= 0 THEN 'LOST' ELSE 'MIXED' END AS outcome, * FROM priced)
SELECT outcome, count(*) AS n, {R.format('count(*)::DOUBLE / sum(count(*)) OVER ()')} AS share, {R.format('median(implied_price)')} AS price,
  {R.format('avg(cvr)')} AS cvr FROM c GROUP BY 1""")
def won_lost_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = spine(spark, d).groupBy(outcome(F.col("buybox_pct")).alias("outcome")).agg(
        F.count("*").alias("n"), F.median("implied_price").alias("price"), F.avg("cvr").alias("cvr")
    )
    whole = F.sum("n").over(Window.partitionBy())
    return rows.select(
        "outcome", "n", settled(F.col("n") / whole).alias("share"), settled(F.col("price")).alias("price"), settled(F.col("cvr")).alias("cvr")
    )


@query("linear_trend", f"""SELECT p_brand, {R.format('corr(p_retailprice, p_size)')} AS r, {R.format('regr_slope(p_retailprice, p_size)')} AS slope,
  {R.format('regr_intercept(p_retailprice, p_size)')} AS intercept FROM part GROUP BY 1""")
def linear_trend(spark: SparkSession, d: str) -> DataFrame:
    y, x = F.col("p_retailprice"), F.col("p_size")
    aggs = {"r": F.corr(y, x), "slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x)}
    return table(spark, d, "part").groupBy("p_brand").agg(*[settled(v).alias(k) for k, v in aggs.items()])


@query("snapshot_features", """SELECT c_nationkey, round(median(c_acctbal) + 1e-9, 6) AS balance, min(m) AS segment FROM (
  SELECT c_nationkey, c_acctbal, (SELECT c2.c_mktsegment FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS m FROM customer c) GROUP BY 1""")
def snapshot_features(spark: SparkSession, d: str) -> DataFrame:
    """Median of the numbers and smallest mode of the categories of each key."""
    rows = table(spark, d, "customer").groupBy("c_nationkey")
    return rows.agg(settled(F.median("c_acctbal")).alias("balance"), F.mode("c_mktsegment", True).alias("segment"))


@query("moving_profit", """SELECT o_orderkey, round(sum(o_totalprice) OVER w + 1e-6, 2) AS cumulative,
  CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) >= 5 THEN round(avg(o_totalprice) OVER m + 1e-6, 2) END AS moving
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING),
  m AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def moving_profit(spark: SparkSession, d: str) -> DataFrame:
    """Running total, and the moving average where its window is full."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    total = F.sum("o_totalprice").over(order.rowsBetween(Window.unboundedPreceding, 0))
    moving = F.avg("o_totalprice").over(order.rowsBetween(-4, 0))
    full = F.row_number().over(order) >= 5
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(total + 1e-6, 2).alias("cumulative"), F.when(full, F.round(moving + 1e-6, 2)).alias("moving")
    )


@query("best_product", "SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS units FROM lineitem GROUP BY 1 ORDER BY units DESC, l_partkey LIMIT 1")
def best_product(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("units"))
    return rows.orderBy(F.desc("units"), "l_partkey").limit(1)


@query("ranked_budget", """SELECT p_partkey, p_retailprice FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS k FROM part) WHERE k <= 3""")
def ranked_budget(spark: SparkSession, d: str) -> DataFrame:
    """The three best of each brand; ties at the cut stay."""
    place = F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice")))
    return table(spark, d, "part").withColumn("k", place).where("k <= 3").select("p_partkey", "p_retailprice")


@query("date_features", """SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS DATE) AS week_label,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS month, strftime(CAST(date_trunc('week', o_orderdate) AS DATE) + 3, '%Y') || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS label,
  CAST(greatest(1, least(52, weekofyear(o_orderdate))) AS INTEGER) AS week52,
  CAST(greatest(1, least(12, CAST(floor((greatest(1, least(52, weekofyear(o_orderdate))) - 1) / 4.345) AS INTEGER) + 1)) AS INTEGER) AS month_of_week,
  CAST((weekofyear(o_orderdate) - 1 + 10) % 52 + 1 AS INTEGER) AS ten_later FROM orders""")
def date_features(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", fc.week_start(day).alias("week"), fc.week_end(day).alias("week_label"), fc.month_start(day).alias("month"),
        fc.iso_label(day).alias("label"), fc.week_of_52(day).alias("week52"), fc.month_of_week(fc.week_of_52(day)).alias("month_of_week"),
        fc.week_after(F.weekofyear(day), F.lit(10)).alias("ten_later"),
    )


@query("rank_sample", """SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY md5('s7' || CAST(p_partkey AS VARCHAR)), p_partkey) AS n FROM part) WHERE n <= 100""")
def rank_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample without replacement: the rows with the smallest keyed hashes."""
    place = F.md5(F.concat(F.lit("s7"), F.col("p_partkey").cast("string")).cast("binary"))
    return table(spark, d, "part").orderBy(place, "p_partkey").limit(100).select("p_partkey")


@query("undersample", """WITH s AS (SELECT event_id, event_type = 'purchase' AS positive, row_number() OVER (PARTITION BY event_type = 'purchase' ORDER BY md5('u1' || CAST(event_id AS VARCHAR)), event_id) AS n FROM events)
SELECT event_id, positive FROM s WHERE positive OR n <= (SELECT count(*) FROM s WHERE positive)""")
def undersample_events(spark: SparkSession, d: str) -> DataFrame:
    from pricewright.operators.sampling import undersampled

    rows = table(spark, d, "events").select("event_id", (F.col("event_type") == "purchase").alias("positive"))
    return undersampled(rows, F.col("positive"), "event_id", "u1")


@query("stratified_split", """SELECT c_custkey, n <= ceil(0.6 * total) AS train FROM (SELECT c_custkey,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('t0' || CAST(c_custkey AS VARCHAR)), c_custkey) AS n, count(*) OVER (PARTITION BY c_mktsegment) AS total FROM customer)""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    from pricewright.operators.sampling import stratified

    return stratified(table(spark, d, "customer"), "c_mktsegment", "c_custkey", 0.6, "t0").select("c_custkey", "train")
