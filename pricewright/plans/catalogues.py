"""Catalogue, fold-in and back-test queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions.columns import settled, week_start
from pricewright.operators import backtest, catalogue, panel
from pricewright.operators.asof import asof_nearest
from pricewright.plans.panels import SPINE, spine
from pricewright.plans.registry import query
from pricewright.sources.tables import table


@query("paragraph_style", r"""WITH p AS (SELECT doc_id, 'paragraph_' || i AS section, p FROM (SELECT doc_id, unnest(s) AS p, generate_subscripts(s, 1) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE trim(p) <> '')
SELECT doc_id AS row_id, section, round(len(regexp_extract_all(p, '[^\p{L}\p{N}_\s]')) / greatest(length(p), 1)::DOUBLE + 1e-9, 6) AS value FROM p""")
def paragraph_style(spark: SparkSession, d: str) -> DataFrame:
    """Style features of each paragraph as a long table; one of them compared."""
    sections = catalogue.paragraphs(table(spark, d, "documents"), "doc_id", "text")
    rows = catalogue.style_long(sections, ["punctuation_ratio"])  # a filter on the names would come after all have been found
    return rows.select("row_id", "section", settled(F.col("value")).alias("value"))


@query("scrape_fold_in", """WITH s AS (SELECT user_id % 25 AS k, CAST(date_trunc('week', ts) AS DATE) AS week, avg(value) AS exact FROM events GROUP BY 1, 2),
w AS (SELECT DISTINCT user_id % 25 AS k, CAST(date_trunc('week', ts) AS DATE) AS week FROM events WHERE event_type = 'click')
SELECT w.k, w.week, round(s.exact + 1e-9, 6) AS exact FROM w LEFT JOIN s ON w.k = s.k AND w.week = s.week""")
def scrape_fold_in(spark: SparkSession, d: str) -> DataFrame:
    """Scraped measures averaged for their exact week; nearest-in-time ones are covered by ``asof_nearest``."""
    rows = table(spark, d, "events").withColumn("k", F.col("user_id") % 25)
    exact = panel.weekly(rows, ["k"], "ts", exact=F.avg("value"))
    weeks = rows.where("event_type = 'click'").select("k", week_start(F.col("ts")).alias("week")).distinct()
    joined = panel.attach(weeks, exact, ["k", "week"])
    return joined.select("k", "week", settled(F.col("exact")).alias("exact"))


@query("static_fold_in")
def static_fold_in(spark: SparkSession, d: str) -> DataFrame:
    """Weeks with the nearest scraped row of their key."""
    rows = table(spark, d, "events").withColumn("k", F.col("user_id") % 25)
    weeks = rows.select("k", week_start(F.col("ts")).alias("day")).distinct()
    scraped = rows.select("k", F.to_date("ts").alias("day"), "value", "event_id")
    return asof_nearest(weeks, scraped, "day", ["k"], ["value"], "event_id")


@query("quantisation", f"""WITH {SPINE} , x AS (SELECT buybox_pct / 100 AS share, count(*) AS n FROM priced WHERE buybox_pct IS NOT NULL GROUP BY 1),
d AS (SELECT share, n, k, row_number() OVER (PARTITION BY share ORDER BY round(abs(share - round(share * k) / k), 12), k) AS place FROM x, range(1, 31) r(k))
SELECT count(*) AS shares, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS denominators, CAST(sum(k * n) AS BIGINT) AS weighed FROM d WHERE place = 1""")
def quantisation(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct shares there are, and the sums of the sample sizes inferred for each of them."""
    rows = spine(spark, d).select((F.col("buybox_pct") / 100).alias("share"))
    sizes = backtest.inferred_sizes(rows, "share")
    k = F.col("denominator")
    return sizes.agg(F.count("*").alias("shares"), F.sum("n").alias("n"), F.sum(k).alias("denominators"), F.sum(k * F.col("n")).alias("weighed"))


@query("backtest_draws")
def backtest_draws(spark: SparkSession, d: str) -> DataFrame:
    """Simulated demand around each part's mean monthly sales."""
    months = panel.monthly(table(spark, d, "lineitem"), ("l_partkey",), "l_shipdate", n=F.count("*"))
    fitted = months.groupBy("l_partkey").agg(F.avg("n").alias("mean"), panel.dispersion(F.col("n")).alias("r"))
    return backtest.demand_draws(fitted, "mean", "r", "l_partkey", 200)


@query("catalogue_build")
def catalogue_build(spark: SparkSession, d: str) -> DataFrame:
    """Spec sheets made from parts, typed and scaled."""
    part = table(spark, d, "part")
    sheet = F.format_string('[{"key":"Weight","value":"%s kg"},{"key":"Farbe","value":"%s"}]', F.col("p_size").cast("string"), F.col("p_type"))
    rows = part.select("p_partkey", sheet.alias("data"))
    return catalogue.build_catalogue(catalogue.sheet_long(rows, "p_partkey", "data", "ttf_")).table
