"""The two full weekly panels: every side fact of the conversion and the featured-offer panel.

Facts of one grain are one aggregate with conditions inside, so a panel is a spine and three joins however many facts it has:
the week of shipping, the week of ordering, the month, and the product in its market. A fact without rows is null, as a left
join to it would leave it. The SQL that the queries are compared with has each fact by itself.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions.columns import month_start, ratio, settled, share, week_start
from pricewright.operators import panel as op
from pricewright.plans.registry import query
from pricewright.sources.steps import stored
from pricewright.sources.tables import table

KEYS = ("brand", "region")


#: Facts that are counted as distinct values, and the column of the lines that each needs.
COUNTED = {"n_sellers": "l_suppkey", "unique_customers": "o_custkey", "siblings": "p_partkey"}


def lines(spark: SparkSession, d: str, counted: Collection[str] = tuple(COUNTED)) -> DataFrame:
    """Order lines with product, market and order: the one join that all facts share."""
    line, part, orders, supplier, nation = (table(spark, d, n) for n in ("lineitem", "part", "orders", "supplier", "nation"))
    place = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    rows = line.join(part.select("p_partkey", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    bought = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    rows = rows.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    named = rows.select(
        F.col("p_brand").alias("brand"), F.col("n_regionkey").alias("region"), F.to_date("l_shipdate").alias("day"), F.to_date("o_orderdate").alias("bought"),
        "l_orderkey", "l_linenumber", "l_suppkey", "p_partkey", "o_custkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "o_totalprice", "o_orderpriority", "p_type", "p_size",
    )
    named = named.drop(*[column for fact, column in COUNTED.items() if fact not in counted])
    return stored(named, "order-lines").withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))


def _distinct(facts: DataFrame, rows: DataFrame, keys: tuple[str, ...], at: Column | None, name: str) -> DataFrame:
    """Facts with the number of distinct values of their group, counted by itself: beside other measures each of these would move with every value.

    Lines that lack the column were made for a panel without the fact.
    """
    value = COUNTED[name]
    if value not in rows.columns:
        return facts
    grain = [c for c in facts.columns if c in (*keys, "week", "month")]
    every = [F.col(k) for k in keys] + ([at.alias(grain[-1])] if at is not None else [])
    counts = rows.select(*every, value).distinct().groupBy(*grain).agg(F.count(value).alias(name))
    return op.attach(facts, counts, grain)


def _some(count: Column) -> Column:
    return F.nullif(count, F.lit(0))


def shipped_facts(rows: DataFrame) -> DataFrame:
    """Traffic, offers, stock, issues, listings, ranks and offer dispersion by week of shipping."""
    new, old, open_ = F.col("l_returnflag") == "N", F.col("l_returnflag") == "A", F.col("l_linestatus") == "O"
    bad = F.col("l_discount") >= 0.08
    avg = lambda condition, value: F.avg(F.when(condition, value))
    yes = lambda condition: condition.cast("double")
    worst = lambda flag: F.max(F.when(bad, flag.cast("int")))
    weeks = op.weekly(
        rows, KEYS, "day",
        sessions=F.count("*"), units=F.count_if(F.col("l_returnflag") == "R"), revenue=F.sum("l_extendedprice"),
        browser_sessions=F.count_if(open_), mobile_sessions=F.count_if(~open_), page_views=F.sum("l_linenumber"),
        buybox_pct=share(F.col("l_linestatus") == "F") * 100,
        lowest_price=avg(new, F.col("unit") * (1 - F.col("l_discount"))), bb_price=avg(new, F.col("unit")),
        offer_count=avg(new, F.col("l_linenumber")), bb_is_fba=avg(new, yes(F.col("l_linestatus") == "F")),
        bb_is_prime=avg(new, yes(F.col("l_discount") > 0.05)), bb_shipping=avg(new, F.col("l_tax")),
        fulfillable=avg(open_, F.col("l_quantity")), total_qty=avg(open_, F.col("l_quantity") + F.col("l_linenumber")),
        frac_oos=avg(open_, yes(F.col("l_quantity") < 5)),
        is_suppressed=worst(F.col("l_tax") > 0.07), is_inactive=worst(F.col("l_quantity") < 3), is_defect=worst(F.col("l_returnflag") == "R"),
        issue_count=_some(F.count_if(bad)),
        listing_price=avg(old, F.col("unit")),
        best_rank=F.min("l_linenumber"), rank_value=F.avg("l_linenumber"),
        price_dispersion=F.stddev("unit"), min_landed=F.min("unit"), max_landed=F.max("unit"),
        frac_offers_fba=share(F.col("l_linestatus") == "F"), avg_feedback=F.avg("l_discount"),
    )
    return _distinct(weeks, rows, KEYS, week_start(F.col("day")), "n_sellers")


def ordered_facts(rows: DataFrame) -> DataFrame:
    """Realised prices and fees by week of ordering; fees of an order are booked on each of its lines."""
    quantity = F.sum("l_quantity")
    return op.weekly(
        rows, KEYS, "bought",
        oi_price=ratio(F.sum("l_extendedprice"), quantity),
        own_shipping=ratio(F.sum(F.col("l_tax") * F.col("l_extendedprice")), quantity),
        fba_fee=-ratio(F.sum("o_totalprice"), quantity),
        commission=-ratio(F.sum(F.col("l_discount") * F.col("l_extendedprice")), quantity),
    )


def monthly_facts(rows: DataFrame) -> DataFrame:
    """Review shares and customers by month."""
    told = lambda first: F.avg(F.when(F.col("o_orderpriority").startswith(first), F.col("l_tax")))
    months = op.monthly(rows, KEYS, "day", positive_share=told("1"), negative_share=told("5"))
    return _distinct(months, rows, KEYS, month_start(F.col("day")), "unique_customers")


def product_facts(rows: DataFrame) -> DataFrame:
    """What holds for a product in a market at all times: the last content, pictures, returns, delivery, siblings."""
    returned = F.col("l_returnflag") == "R"
    last = F.max(F.struct("day", "l_orderkey", "l_linenumber", "p_type", "p_size", "l_discount"))
    topics = lambda first: F.count_if(F.col("o_orderpriority").startswith(first))
    out = rows.groupBy(*KEYS).agg(
        last.alias("last"),
        _some(F.count_if(F.col("l_linenumber") == 1)).alias("image_count"),
        F.bool_or(F.col("p_size") >= 45).alias("has_aplus"),
        F.sum(F.when(returned, F.col("l_quantity"))).alias("returned"),
        F.sum(F.when(returned, F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0))).alias("defective"),
        F.sum("l_quantity").alias("total"),
        F.avg(F.datediff("day", "bought")).alias("delivery_days"),
        topics("1").alias("pos_topics"),
        topics("5").alias("neg_topics"),
    )
    out = _distinct(out, rows, KEYS, None, "siblings")
    return out.select(
        *KEYS, F.col("last.p_type").alias("product_type"), F.col("last.p_size").alias("maker"), F.col("last.l_discount").alias("repeat_rate"),
        "image_count", "has_aplus", ratio(F.col("returned"), F.col("total")).alias("return_rate"),
        ratio(F.col("defective"), F.col("total")).alias("defect_rate"), "delivery_days", *[c for c in ("siblings",) if c in out.columns], "pos_topics", "neg_topics",
    )


def market_panel(spark: SparkSession, d: str, counted: Collection[str] = tuple(COUNTED)) -> DataFrame:
    """All facts on the spine of weeks with traffic, prices filled, and the relations between them; of ``COUNTED`` those asked for."""
    rows = lines(spark, d, counted)
    panel = op.attach(shipped_facts(rows), ordered_facts(rows), [*KEYS, "week"])
    panel = op.attach(op.attach_monthly(panel, monthly_facts(rows), KEYS), product_facts(rows), KEYS)
    panel = panel.withColumn("implied_price", ratio(F.col("revenue"), F.col("units")))
    panel = panel.withColumn("cvr", ratio(F.col("units"), F.col("sessions")))
    panel = panel.withColumn("raw_price", F.coalesce("oi_price", "implied_price", "listing_price"))
    panel = panel.withColumn("price", F.col("raw_price"))
    return op.price_relations(op.filled(panel, KEYS, "week", ["price"]))


#: Columns of the two panels, each with whether it is a fraction that the comparison rounds.
CVR = ("cvr 1|implied_price 1|oi_price 1|listing_price 1|raw_price 1|units 0|sessions 0|revenue 1|browser_sessions 0|mobile_sessions 0|page_views 0|"
       "buybox_pct 1|lowest_price 1|bb_price 1|offer_count 1|fulfillable 1|total_qty 1|product_type 0|maker 0|image_count 0|has_aplus 0|pos_topics 0|"
       "neg_topics 0|repeat_rate 1|rank_value 1|price 1|price_vs_lowest 1")  # fmt: skip
BBOX = ("buybox_pct 1|implied_price 1|oi_price 1|listing_price 1|raw_price 1|own_shipping 1|lowest_price 1|bb_price 1|offer_count 1|bb_is_fba 1|"
        "bb_is_prime 1|bb_shipping 1|fulfillable 1|total_qty 1|frac_oos 1|is_suppressed 0|is_inactive 0|is_defect 0|issue_count 0|product_type 0|maker 0|"
        "image_count 0|has_aplus 0|return_rate 1|defect_rate 1|delivery_days 1|best_rank 0|n_sellers 0|price_dispersion 1|min_landed 1|max_landed 1|"
        "frac_offers_fba 1|avg_feedback 1|fba_fee 1|commission 1|positive_share 1|negative_share 1|unique_customers 0|siblings 0|units 0|sessions 0|"
        "revenue 1|price 1|price_vs_lowest 1|price_vs_bb 1|own_landed 1|landed_vs_bb 1|days_of_supply 1|est_margin 1|net_sentiment 1")  # fmt: skip


def columns_of(of: str) -> list[tuple[str, bool]]:
    return [(c.split()[0], c.endswith("1")) for c in of.split("|")]


PANEL_SQL = """
WITH s AS (
  SELECT l.*, p_brand AS brand, n_regionkey AS region, CAST(l_shipdate AS DATE) AS day, CAST(o_orderdate AS DATE) AS bought, p_type, p_size, p_partkey,
         l_extendedprice / l_quantity AS unit, o_custkey, o_totalprice, o_orderpriority,
         CAST(date_trunc('week', l_shipdate) AS DATE) AS week, CAST(date_trunc('week', o_orderdate) AS DATE) AS bought_week,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS month
  FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN orders ON l_orderkey = o_orderkey),
st AS (SELECT brand, region, week, count(*) AS sessions, count(*) FILTER (WHERE l_returnflag = 'R') AS units, sum(l_extendedprice) AS revenue,
       count(*) FILTER (WHERE l_linestatus = 'O') AS browser_sessions, count(*) FILTER (WHERE l_linestatus <> 'O') AS mobile_sessions,
       CAST(sum(l_linenumber) AS BIGINT) AS page_views, avg(CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) * 100 AS buybox_pct FROM s GROUP BY ALL),
comp AS (SELECT brand, region, week, avg(unit * (1 - l_discount)) AS lowest_price, avg(unit) AS bb_price, avg(l_linenumber) AS offer_count,
       avg(CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS bb_is_fba, avg(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS bb_is_prime,
       avg(l_tax) AS bb_shipping FROM s WHERE l_returnflag = 'N' GROUP BY ALL),
stock AS (SELECT brand, region, week, avg(l_quantity) AS fulfillable, avg(l_quantity + l_linenumber) AS total_qty,
       avg(CASE WHEN l_quantity < 5 THEN 1.0::DOUBLE ELSE 0 END) AS frac_oos FROM s WHERE l_linestatus = 'O' GROUP BY ALL),
issues AS (SELECT brand, region, week, max(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) AS is_suppressed, max(CASE WHEN l_quantity < 3 THEN 1 ELSE 0 END) AS is_inactive,
       max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS is_defect, count(*) AS issue_count FROM s WHERE l_discount >= 0.08 GROUP BY ALL),
oi AS (SELECT brand, region, bought_week AS week, sum(l_extendedprice) / nullif(sum(l_quantity), 0) AS oi_price,
       sum(l_tax * l_extendedprice) / nullif(sum(l_quantity), 0) AS own_shipping FROM s GROUP BY ALL),
listed AS (SELECT brand, region, week, avg(unit) AS listing_price FROM s WHERE l_returnflag = 'A' GROUP BY ALL),
prod AS (SELECT brand, region, p_type AS product_type, p_size AS maker FROM (SELECT *, row_number() OVER (PARTITION BY brand, region
       ORDER BY day DESC, l_orderkey DESC, l_linenumber DESC, p_type DESC, p_size DESC, l_discount DESC) AS n FROM s) WHERE n = 1),
rep AS (SELECT brand, region, l_discount AS repeat_rate FROM (SELECT *, row_number() OVER (PARTITION BY brand, region
       ORDER BY day DESC, l_orderkey DESC, l_linenumber DESC, p_type DESC, p_size DESC, l_discount DESC) AS n FROM s) WHERE n = 1),
pics AS (SELECT brand, region, count(*) AS image_count FROM s WHERE l_linenumber = 1 GROUP BY ALL),
aplus AS (SELECT DISTINCT brand, region, true AS has FROM s WHERE p_size >= 45),
ret AS (SELECT brand, region, sum(l_quantity) AS returned FROM s WHERE l_returnflag = 'R' GROUP BY ALL),
tot AS (SELECT brand, region, sum(l_quantity) AS total FROM s GROUP BY ALL),
deliv AS (SELECT brand, region, avg(day - bought) AS delivery_days FROM s GROUP BY ALL),
defect AS (SELECT brand, region, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS defective FROM s WHERE l_returnflag = 'R' GROUP BY ALL),
ranks AS (SELECT brand, region, week, min(l_linenumber) AS best_rank, avg(l_linenumber) AS rank_value FROM s GROUP BY ALL),
raw_off AS (SELECT brand, region, week, count(DISTINCT l_suppkey) AS n_sellers, stddev_samp(unit) AS price_dispersion, min(unit) AS min_landed, max(unit) AS max_landed,
       avg(CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS frac_offers_fba, avg(l_discount) AS avg_feedback FROM s GROUP BY ALL),
fin AS (SELECT brand, region, bought_week AS week, -sum(o_totalprice) / nullif(sum(l_quantity), 0) AS fba_fee,
       -sum(l_discount * l_extendedprice) / nullif(sum(l_quantity), 0) AS commission FROM s GROUP BY ALL),
rev AS (SELECT brand, region, month, avg(CASE WHEN o_orderpriority LIKE '1%' THEN l_tax END) AS positive_share,
       avg(CASE WHEN o_orderpriority LIKE '5%' THEN l_tax END) AS negative_share FROM s GROUP BY ALL),
topics AS (SELECT brand, region, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS pos_topics, count(*) FILTER (WHERE o_orderpriority LIKE '5%') AS neg_topics FROM s GROUP BY ALL),
buyers AS (SELECT brand, region, month, count(DISTINCT o_custkey) AS unique_customers FROM s GROUP BY ALL),
var AS (SELECT brand, region, count(DISTINCT p_partkey) AS siblings FROM s GROUP BY ALL),
joined AS (
  SELECT st.*, units::DOUBLE / nullif(sessions, 0) AS cvr, revenue / nullif(units, 0) AS implied_price, oi_price, own_shipping, listing_price,
         coalesce(oi_price, revenue / nullif(units, 0), listing_price) AS raw_price, lowest_price, bb_price, offer_count, bb_is_fba, bb_is_prime, bb_shipping,
         fulfillable, total_qty, frac_oos, is_suppressed, is_inactive, is_defect, issue_count, product_type, maker, repeat_rate, image_count,
         (a.has IS NOT NULL) AS has_aplus, returned / nullif(total, 0) AS return_rate, defective / nullif(total, 0) AS defect_rate, delivery_days,
         best_rank, rank_value, n_sellers, price_dispersion, min_landed, max_landed, frac_offers_fba, avg_feedback, fba_fee, commission,
         positive_share, negative_share, pos_topics, neg_topics, unique_customers, siblings
  FROM st LEFT JOIN comp c ON c.brand = st.brand AND c.region = st.region AND c.week = st.week
  LEFT JOIN stock k ON k.brand = st.brand AND k.region = st.region AND k.week = st.week
  LEFT JOIN issues i ON i.brand = st.brand AND i.region = st.region AND i.week = st.week
  LEFT JOIN oi o ON o.brand = st.brand AND o.region = st.region AND o.week = st.week
  LEFT JOIN listed l ON l.brand = st.brand AND l.region = st.region AND l.week = st.week
  LEFT JOIN prod p ON p.brand = st.brand AND p.region = st.region LEFT JOIN rep e ON e.brand = st.brand AND e.region = st.region
  LEFT JOIN pics q ON q.brand = st.brand AND q.region = st.region LEFT JOIN aplus a ON a.brand = st.brand AND a.region = st.region
  LEFT JOIN ret r ON r.brand = st.brand AND r.region = st.region LEFT JOIN tot t ON t.brand = st.brand AND t.region = st.region
  LEFT JOIN deliv d ON d.brand = st.brand AND d.region = st.region LEFT JOIN defect f ON f.brand = st.brand AND f.region = st.region
  LEFT JOIN ranks n ON n.brand = st.brand AND n.region = st.region AND n.week = st.week
  LEFT JOIN raw_off w ON w.brand = st.brand AND w.region = st.region AND w.week = st.week
  LEFT JOIN fin x ON x.brand = st.brand AND x.region = st.region AND x.week = st.week
  LEFT JOIN rev v ON v.brand = st.brand AND v.region = st.region AND v.month = CAST(date_trunc('month', st.week) AS DATE)
  LEFT JOIN buyers b ON b.brand = st.brand AND b.region = st.region AND b.month = CAST(date_trunc('month', st.week) AS DATE)
  LEFT JOIN topics g ON g.brand = st.brand AND g.region = st.region LEFT JOIN var y ON y.brand = st.brand AND y.region = st.region),
priced AS (
  SELECT *, coalesce(last_value(raw_price IGNORE NULLS) OVER (PARTITION BY brand, region ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(raw_price IGNORE NULLS) OVER (PARTITION BY brand, region ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM joined),
panel AS (
  SELECT *, price / nullif(lowest_price, 0) AS price_vs_lowest, price / nullif(bb_price, 0) AS price_vs_bb, price + coalesce(own_shipping, 0) AS own_landed,
         (price + coalesce(own_shipping, 0)) / nullif(bb_price, 0) AS landed_vs_bb, fulfillable * 7 / nullif(units, 0) AS days_of_supply,
         price + coalesce(fba_fee, 0) + coalesce(commission, 0) AS est_margin, positive_share - negative_share AS net_sentiment FROM priced)
"""


def _oracle(of: str, more: str = "") -> str:
    columns = ", ".join(f"round({c} + 1e-9, 6) AS {c}" if fraction else c for c, fraction in columns_of(of))
    return f"{PANEL_SQL} SELECT brand, region, week, {more}{columns} FROM panel"


def _selected(panel: DataFrame, of: str, *more: Column) -> DataFrame:
    return panel.select(*KEYS, "week", *more, *[settled(F.col(c)).alias(c) if fraction else F.col(c) for c, fraction in columns_of(of)])


@query("full_cvr_panel", _oracle(CVR, "CAST(weekofyear(week) AS INTEGER) AS week_of_year, CAST(month(week) AS INTEGER) AS month, "))
def full_cvr_panel(spark: SparkSession, d: str) -> DataFrame:
    calendar = (F.weekofyear("week").alias("week_of_year"), F.month("week").alias("month"))
    return _selected(market_panel(spark, d, ()), CVR, *calendar)


@query("full_bbox_panel", _oracle(BBOX))
def full_bbox_panel(spark: SparkSession, d: str) -> DataFrame:
    return _selected(market_panel(spark, d), BBOX)
