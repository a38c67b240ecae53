"""Similarity, graph, factor, model, metric and simulation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions.columns import gaussian, ratio, settled
from pricewright.operators import agents, boosting, factors, graphs, market, metrics, similarity, standardise, treefit
from pricewright.operators import typing as ty
from pricewright.plans.panels import SPINE, sales, spine
from pricewright.plans.registry import query
from pricewright.plans.standard import part_cells
from pricewright.sources.steps import stored
from pricewright.sources.tables import table

R = "round(({}) + 1e-9, 6)"


def codes(spark: SparkSession, d: str) -> DataFrame:
    """Part features as codes, long, clustered by brand; a third of the sizes are missing."""
    part = table(spark, d, "part")
    named = lambda feature, code: F.struct(F.lit(feature).alias("feature"), code.alias("code"))
    pairs = F.array(
        named("type", F.col("p_type")),
        named("size", F.when(F.col("p_partkey") % 3 != 0, (F.col("p_size") % 10).cast("string"))),
        named("band", F.floor(F.col("p_retailprice") / 300).cast("string")),
    )
    rows = part.select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("row_id"), F.explode(pairs).alias("x"))
    return rows.select("cluster", "row_id", "x.feature", "x.code").where("code is not null")


CODES = """codes AS (SELECT p_brand AS cluster, p_partkey AS row_id, 'type' AS feature, p_type AS code FROM part UNION ALL
  SELECT p_brand, p_partkey, 'size', CAST(p_size % 10 AS VARCHAR) FROM part WHERE p_partkey % 3 <> 0 UNION ALL
  SELECT p_brand, p_partkey, 'band', CAST(CAST(floor(p_retailprice / 300) AS BIGINT) AS VARCHAR) FROM part)"""
COPRESENT = CODES + """, votes AS (SELECT a.cluster, a.row_id AS i, b.row_id AS j, sum((a.code = b.code)::INT)::DOUBLE / count(*) AS score
  FROM codes a JOIN codes b ON a.cluster = b.cluster AND a.feature = b.feature AND a.row_id < b.row_id GROUP BY 1, 2, 3)"""
COSINE = CODES + """, present AS (SELECT cluster, feature, count(*) AS present FROM codes GROUP BY 1, 2),
freq AS (SELECT cluster, feature, code, count(*) AS freq FROM codes GROUP BY 1, 2, 3),
w AS (SELECT cluster, feature, code, -ln(freq / present::DOUBLE) AS w FROM freq JOIN present USING (cluster, feature)),
t AS (SELECT cluster, row_id, feature, code, w FROM codes JOIN w USING (cluster, feature, code)),
l AS (SELECT cluster, row_id, sqrt(sum(w * w)) AS len FROM t GROUP BY 1, 2),
votes AS (SELECT a.cluster, a.row_id AS i, b.row_id AS j, sum(a.w * b.w) / (x.len * y.len) AS score FROM t a JOIN t b
  ON a.cluster = b.cluster AND a.feature = b.feature AND a.code = b.code AND a.row_id < b.row_id
  JOIN l x ON x.cluster = a.cluster AND x.row_id = a.row_id JOIN l y ON y.cluster = b.cluster AND y.row_id = b.row_id GROUP BY 1, 2, 3, x.len, y.len)"""


@query("vote_copresent", f"WITH {COPRESENT} SELECT cluster, i, j, {R.format('score')} AS score FROM votes")
def vote_copresent(spark: SparkSession, d: str) -> DataFrame:
    return similarity.copresent_classes(codes(spark, d)).settled().expanded()


@query("vote_cosine", f"WITH {COSINE} SELECT cluster, i, j, {R.format('score')} AS score FROM votes WHERE score > 0")
def vote_cosine(spark: SparkSession, d: str) -> DataFrame:
    return similarity.cosine_classes(codes(spark, d)).settled().expanded()


@query("otsu_pairs", f"""WITH {COPRESENT}, p AS (SELECT cluster, round(score + 1e-9, 6) AS score FROM votes WHERE score > 0), lim AS (SELECT cluster, min(score) AS lo, max(score) AS hi FROM p GROUP BY 1),
b AS (SELECT cluster, lo, hi, CASE WHEN hi > lo THEN least(floor((score - lo) / ((hi - lo) / 256)), 255) ELSE 0 END AS bin, count(*) AS n FROM p JOIN lim USING (cluster) GROUP BY ALL),
c AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 256) AS mid FROM b),
s AS (SELECT *, sum(n) OVER o / sum(n) OVER a::DOUBLE AS w, sum(n * mid) OVER o / sum(n) OVER a AS m, sum(n * mid) OVER a / sum(n) OVER a AS mt FROM c
  WINDOW o AS (PARTITION BY cluster ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY cluster)),
g AS (SELECT *, CASE WHEN w > 0 AND w < 1 THEN (mt * w - m) * (mt * w - m) / (w * (1 - w)) ELSE 0 END AS gain FROM s)
SELECT cluster, round(mid + 1e-9, 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(gain, 9) DESC, bin) AS k FROM g) WHERE k = 1""")  # fmt: skip
def otsu_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = similarity.copresent_classes(codes(spark, d)).pairs.withColumn("score", settled(F.col("score")))
    return similarity.otsu(pairs.where("score > 0"), "score", ["cluster"], weight="n").withColumn("threshold", settled(F.col("threshold")))


@query("kept_votes", f"""WITH {COSINE}, p AS (SELECT cluster, i, j, round(score + 1e-9, 6) AS score FROM votes WHERE score > 0), lim AS (SELECT cluster, min(score) AS lo, max(score) AS hi FROM p GROUP BY 1),
b AS (SELECT cluster, lo, hi, CASE WHEN hi > lo THEN least(floor((score - lo) / ((hi - lo) / 256)), 255) ELSE 0 END AS bin, count(*) AS n FROM p JOIN lim USING (cluster) GROUP BY ALL),
c AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 256) AS mid FROM b),
s AS (SELECT *, sum(n) OVER o / sum(n) OVER a::DOUBLE AS w, sum(n * mid) OVER o / sum(n) OVER a AS m, sum(n * mid) OVER a / sum(n) OVER a AS mt FROM c
  WINDOW o AS (PARTITION BY cluster ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY cluster)),
g AS (SELECT *, CASE WHEN w > 0 AND w < 1 THEN (mt * w - m) * (mt * w - m) / (w * (1 - w)) ELSE 0 END AS gain FROM s),
cut AS (SELECT cluster, mid FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(gain, 9) DESC, bin) AS k FROM g) WHERE k = 1)
SELECT p.cluster, i, j, score FROM p JOIN cut ON p.cluster = cut.cluster WHERE score >= mid""")
def kept_votes(spark: SparkSession, d: str) -> DataFrame:
    voted = similarity.cosine_classes(codes(spark, d)).settled()
    return similarity.Voted(stored(voted.pairs, "class-votes"), voted.members).kept().expanded()


@query("k_modes")
def k_modes(spark: SparkSession, d: str) -> DataFrame:
    placed, _ = similarity.k_modes(table(spark, d, "customer"), "c_custkey", ["c_mktsegment", "c_nationkey"], 4)
    return similarity.purity(placed, ["c_mktsegment", "c_nationkey"])


@query("knn_topk", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-12)) AS v FROM e),
p AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.v, b.v), 12) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS n FROM p) SELECT i, j, round(sim + 1e-9, 6) AS sim FROM k WHERE n <= 15""")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return similarity.knn(table(spark, d, "embeddings"), "vec_id", "embedding", 15).withColumn("sim", settled(F.col("sim")))


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges between parts and suppliers that trade, and the region as a community."""
    line, sup, nat = (table(spark, d, n) for n in ("lineitem", "supplier", "nation"))
    edges = line.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst"))
    edges = edges.agg(F.count("*").cast("double").alias("weight"))
    home = sup.join(nat, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    parts = edges.join(home, F.col("src") == F.col("s_suppkey")).groupBy("dst").agg(F.min("n_regionkey").alias("r"))
    labels = home.join(edges.select("src").distinct(), F.col("s_suppkey") == F.col("src")).select(F.col("src").alias("node"), F.col("n_regionkey").alias("community"))
    return edges, labels.union(parts.select("dst", "r"))


GRAPH = """edges AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2),
home AS (SELECT s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
labels AS (SELECT DISTINCT src AS node, n_regionkey AS community FROM edges JOIN home ON src = s_suppkey UNION ALL
  SELECT dst, min(n_regionkey) FROM edges JOIN home ON src = s_suppkey GROUP BY 1),
deg AS (SELECT node, sum(weight) AS degree FROM (SELECT src AS node, weight FROM edges UNION ALL SELECT dst, weight FROM edges) GROUP BY 1),
pairs AS (SELECT e.*, a.community AS ca, b.community AS cb FROM edges e JOIN labels a ON e.src = a.node JOIN labels b ON e.dst = b.node)"""


@query("modularity", f"""WITH {GRAPH}, g AS (SELECT community, sum(degree) AS dc FROM deg JOIN labels USING (node) GROUP BY 1)
SELECT {R.format('(SELECT sum(CASE WHEN ca = cb THEN weight ELSE 0 END) / sum(weight) FROM pairs) - (SELECT sum(dc * dc) FROM g) / (4 * (SELECT sum(weight) FROM pairs) * (SELECT sum(weight) FROM pairs))')} AS modularity""")
def modularity(spark: SparkSession, d: str) -> DataFrame:
    edges, labels = graph(spark, d)
    return graphs.modularity(edges, labels).withColumn("modularity", settled(F.col("modularity")))


@query("conductance", f"""WITH {GRAPH}, c AS (SELECT community, sum(weight) AS cut FROM (SELECT ca AS community, weight FROM pairs WHERE ca <> cb UNION ALL SELECT cb, weight FROM pairs WHERE ca <> cb) GROUP BY 1),
v AS (SELECT community, sum(degree) AS vol FROM deg JOIN labels USING (node) GROUP BY 1), t AS (SELECT sum(vol) AS total FROM v)
SELECT v.community, {R.format('CASE WHEN least(vol, total - vol) > 0 THEN coalesce(cut, 0) / least(vol, total - vol) ELSE 0 END')} AS conductance FROM v LEFT JOIN c ON v.community = c.community, t""")
def conductance(spark: SparkSession, d: str) -> DataFrame:
    edges, labels = graph(spark, d)
    return graphs.conductance(edges, labels).withColumn("conductance", settled(F.col("conductance")))


@query("largest_community", f"""WITH {GRAPH}, s AS (SELECT community, count(*) AS n FROM labels GROUP BY 1) SELECT {R.format('max(n) / sum(n)::DOUBLE')} AS share FROM s""")
def largest_community(spark: SparkSession, d: str) -> DataFrame:
    return graphs.largest_share(graph(spark, d)[1]).withColumn("share", settled(F.col("share")))


@query("components")
def components(spark: SparkSession, d: str) -> DataFrame:
    """The components of the graph of all lines; recursive SQL takes too long on it, so a test compares with union-find."""
    line = table(spark, d, "lineitem")
    return graphs.components(line.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst")))


@query("louvain_communities")
def louvain_communities(spark: SparkSession, d: str) -> DataFrame:
    near = similarity.knn(table(spark, d, "embeddings"), "vec_id", "embedding", 10)
    return graphs.louvain(similarity.mutual_or(near))


@query("fold_in", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-12)) AS v FROM e),
p AS (SELECT a.vec_id AS i, b.vec_id AS j, b.label, round(list_dot_product(a.v, b.v), 12) AS sim FROM u a JOIN u b ON a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS n FROM p),
w AS (SELECT i, label, sum(greatest(sim, 0)) AS w FROM k WHERE n <= 15 GROUP BY 1, 2)
SELECT i AS row_id, label AS community FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, label) AS n FROM w) WHERE n = 1""")
def fold_in(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v"), F.col("label").alias("community"))
    old, new = rows.where("row_id % 10 <> 0"), rows.where("row_id % 10 = 0")
    return similarity.fold_in(new.select("row_id", "v"), old.select("row_id", "v"), old.select("row_id", "community"))


def part_presence(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    named = F.array(F.concat(F.lit("t_"), "p_type"), F.concat(F.lit("s_"), (F.col("p_size") % 7).cast("string")), F.concat(F.lit("b_"), "p_brand"))
    return part.select(F.col("p_partkey").alias("row_id"), F.explode(named).alias("feature"))


@query("tfidf_weights", f"""WITH c AS (SELECT p_partkey AS row_id, unnest(['t_' || p_type, 's_' || CAST(p_size % 7 AS VARCHAR), 'b_' || p_brand]) AS feature FROM part),
i AS (SELECT feature, ln((1 + (SELECT count(DISTINCT row_id) FROM c)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM c GROUP BY 1)
SELECT row_id, feature, {R.format('idf / sqrt(sum(idf * idf) OVER (PARTITION BY row_id))')} AS w FROM c JOIN i USING (feature)""")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return factors.tfidf(part_presence(spark, d)).withColumn("w", settled(F.col("w")))


@query("svd_embedding")
def svd_embedding(spark: SparkSession, d: str) -> DataFrame:
    weights = stored(factors.tfidf(part_presence(spark, d)), "presence")
    return factors.embed(weights, factors.fit_factors(weights, 8))


#: Components that the reports of factors go by, and loadings of each.
REPORTED, LOADINGS = 8, 5


@query("factor_report")
def factor_report(spark: SparkSession, d: str) -> DataFrame:
    """(component, share, cumulated, place, feature, loading): the scree of the presence weights and the largest loadings."""
    fit = factors.fit_factors(stored(factors.tfidf(part_presence(spark, d)), "presence"), REPORTED)
    cumulated = factors.scree(fit, tuple(range(1, REPORTED + 1)))
    rows, place = [], {}
    for c, feature, loading in factors.top_loadings(fit, REPORTED, LOADINGS):
        place[c] = place.get(c, 0) + 1
        rows.append((c + 1, float(fit.explained[c]), cumulated[c + 1], place[c], feature, loading))
    return spark.createDataFrame(rows, "component int, share double, cumulated double, place int, feature string, loading double")


@query("factor_reconstruction")
def factor_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    """(rank, relative_frobenius, rmse): what factors of rising number leave of the presence weights."""
    weights = stored(factors.tfidf(part_presence(spark, d)), "presence")
    whole, out = factors.fit_factors(weights, 16), None
    for rank in (2, 4, 8, 16):
        some = factors.Factors(whole.features, whole.right[:, :rank], whole.values[:rank], whole.explained[:rank])
        row = factors.reconstruction_error(weights, some).select(F.lit(rank).alias("rank"), "relative_frobenius", "rmse")
        out = row if out is None else out.unionByName(row)
    return out


#: The columns of order lines that are correlated, and when each is missing.
CORRELATED = {"l_quantity": "l_linenumber % 4 <> 0", "l_extendedprice": "true", "l_discount": "l_orderkey % 3 <> 0", "l_tax": "l_orderkey % 5 <> 0"}


@query("feature_correlations", "WITH c AS (SELECT " + ", ".join(f"CASE WHEN {w} THEN {c} END AS {c}" for c, w in CORRELATED.items()) + " FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {R.format(f'corr({a}, {b})')} AS r FROM c WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a in CORRELATED for b in CORRELATED if a < b))
def feature_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of order-line columns over the rows that have both of a pair."""
    cells = [F.when(F.expr(w), F.col(c)).cast("double").alias(c) for c, w in CORRELATED.items()]
    found = metrics.correlated(table(spark, d, "lineitem").select(*cells), list(CORRELATED))
    return found.withColumn("r", settled(F.col("r")))


@query("feature_clusters")
def feature_clusters(spark: SparkSession, d: str) -> DataFrame:
    """(feature, cluster, community): numbers of the standard features grouped by average linkage, and by Louvain."""
    cells = stored(standardise.standardised(*part_cells(spark, d)).features.where("number is not null").select("row_id", "feature", F.col("number").alias("w")), "numbers")
    features, _, r = factors.correlations(cells)
    communities = factors.feature_communities(spark, features, r)
    rows = [(f, c, communities[f]) for f, c in zip(features, factors.linked_features(r), strict=True)]
    return spark.createDataFrame(rows, "feature string, cluster int, community string")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("imputed_shares")
def imputed_shares(spark: SparkSession, d: str) -> DataFrame:
    """(customer, priority, share, known): each customer's share of filled orders by priority, missing ones from two factors."""
    done = (F.col("o_orderstatus") == "F").cast("double")
    shares = [F.avg(F.when(F.col("o_orderpriority") == p, done)) for p in PRIORITIES]
    rows = stored(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("row_id")).agg(F.array(*shares).alias("x")), "order-shares")
    full = factors.imputed_rows(rows, 2).withColumnRenamed("x", "y").join(rows, "row_id")
    names = F.array(*[F.lit(p) for p in PRIORITIES])
    each = full.select("row_id", "x", F.posexplode("y").alias("at", "share"))
    return each.select(F.col("row_id").alias("customer"), F.get(names, F.col("at")).alias("priority"), "share", F.get("x", F.col("at")).isNotNull().alias("known"))


@query("kernel_price", f"""WITH p AS (SELECT a.p_partkey, a.p_retailprice, sum(b.p_retailprice * exp(-0.05 * (a.p_size - b.p_size) * (a.p_size - b.p_size))) / nullif(sum(exp(-0.05 * (a.p_size - b.p_size) * (a.p_size - b.p_size))), 0) AS guess
  FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey GROUP BY 1, 2) SELECT p_partkey, {R.format('guess')} AS guess FROM p""")
def kernel_price(spark: SparkSession, d: str) -> DataFrame:
    return kernel_guesses(spark, d).select("p_partkey", settled(F.col("guess")).alias("guess"))


def kernel_guesses(spark: SparkSession, d: str) -> DataFrame:
    """Each part's price from the others of its group, weighed by a Gaussian of the size difference."""
    part = table(spark, d, "part").select("p_brand", "p_type", "p_partkey", "p_size", "p_retailprice")
    group = ["p_brand", "p_type"]
    sizes = part.groupBy(*group, F.col("p_size").alias("z")).agg(F.count("*").alias("n"), F.sum("p_retailprice").alias("x"))
    # sizes of a group meet sizes, of which there are few, not parts parts; each part then leaves itself out
    met = sizes.select(*group, F.col("z").alias("p_size")).join(sizes, group)
    weight = gaussian((F.col("p_size") - F.col("z")).cast("double"), 0.05)
    far = lambda x: F.sum(F.when(F.col("z") != F.col("p_size"), F.col(x) * weight).otherwise(0.0))
    near = lambda x: F.max(F.when(F.col("z") == F.col("p_size"), F.col(x)))
    sums = met.groupBy(*group, "p_size").agg(far("x").alias("far_x"), far("n").alias("far_n"), near("x").alias("own_x"), near("n").alias("own_n"))
    joined = part.join(sums, [*group, "p_size"])
    same = F.when(F.col("own_n") > 1, F.col("own_x") - F.col("p_retailprice")).otherwise(0.0)
    below = F.col("far_n") + (F.col("own_n") - 1)
    return joined.where(below > 0).select("p_partkey", "p_retailprice", ((F.col("far_x") + same) / below).alias("guess"))


METRICS = """g AS (SELECT a.p_partkey, a.p_retailprice AS y, sum(b.p_retailprice * exp(-0.05 * (a.p_size - b.p_size) * (a.p_size - b.p_size))) / nullif(sum(exp(-0.05 * (a.p_size - b.p_size) * (a.p_size - b.p_size))), 0) AS p
  FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey GROUP BY 1, 2)"""


@query("metrics_table", f"""WITH {METRICS}, m AS (SELECT avg(y) AS mean FROM g) SELECT {R.format('1 - sum((p - y) * (p - y)) / sum((y - mean) * (y - mean))')} AS r2, {R.format('avg(abs(p - y))')} AS mae, {R.format('sqrt(avg((p - y) * (p - y)))')} AS rmse,
  {R.format('median(abs(p - y))')} AS medae, {R.format('avg(abs(p - y) / abs(y)) * 100')} AS mape, {R.format('avg(2 * abs(p - y) / (abs(y) + abs(p))) * 100')} AS smape, {R.format('sum(p - y) / sum(y) * 100')} AS bias_pct,
  {R.format('avg((abs(p - y) <= 0.2 * abs(y))::INT) * 100')} AS hit20 FROM g, m""")
def metrics_table(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.regression(kernel_guesses(spark, d), "p_retailprice", "guess")
    return rows.select(*[settled(F.col(c)).alias(c) for c in rows.columns])


@query("spearman", f"""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)
SELECT {R.format('corr(a, b)')} AS spearman FROM r""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return metrics.spearman(table(spark, d, "part"), "p_size", "p_retailprice").select(settled(F.col("spearman")).alias("spearman"))


def scored_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("quality", (F.col("n_chars") % 1000).alias("score"))


LABELS = "s AS (SELECT quality, n_chars % 1000 AS score FROM labels JOIN documents USING (doc_id))"


@query("roc_auc", f"""WITH {LABELS}, n AS (SELECT quality, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s)
SELECT {R.format('(sum(CASE WHEN quality = 1 THEN r END) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2.0) / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0))')} AS auc FROM n""")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(scored_labels(spark, d), F.col("quality") == 1, "score").select(settled(F.col("auc")).alias("auc"))


@query("average_precision", f"""WITH {LABELS}, g AS (SELECT score, sum((quality = 1)::INT) AS p, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC)::DOUBLE AS prec FROM g) SELECT {R.format('sum(p * prec) / sum(p)')} AS average_precision FROM c""")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(scored_labels(spark, d), F.col("quality") == 1, "score").select(settled(F.col("average_precision")).alias("average_precision"))


@query("confusion", "SELECT o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 'F' ELSE 'O' END AS guess, count(*) AS n FROM orders GROUP BY 1, 2")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("guess", F.when(F.col("o_totalprice") > 200000, "F").otherwise("O"))
    return metrics.confusion(rows, "o_orderstatus", "guess")


@query("class_report", f"""WITH c AS (SELECT o_orderstatus AS y, CASE WHEN o_totalprice > 200000 THEN 'F' ELSE 'O' END AS g FROM orders), k AS (SELECT DISTINCT y AS class FROM c),
t AS (SELECT class, (SELECT count(*) FROM c WHERE y = class) AS support, (SELECT count(*) FROM c WHERE g = class) AS said, (SELECT count(*) FROM c WHERE y = class AND g = class) AS hit FROM k)
SELECT class, {R.format('coalesce(hit / nullif(said, 0)::DOUBLE, 0)')} AS "precision", {R.format('hit / support::DOUBLE')} AS recall, {R.format('coalesce(2.0 * hit / nullif(said + support, 0), 0)')} AS f1, support FROM t""")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("guess", F.when(F.col("o_totalprice") > 200000, "F").otherwise("O"))
    out = metrics.classification_report(rows, "o_orderstatus", "guess")
    return out.select("class", *[settled(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("baselines", f"""WITH t AS (SELECT *, l_orderkey % 10 < 6 AS train FROM lineitem), m AS (SELECT l_suppkey, avg(l_discount) AS m FROM t WHERE train GROUP BY 1), w AS (SELECT avg(l_discount) AS c FROM t WHERE train),
e AS (SELECT l_discount AS y, coalesce(m.m, w.c) AS k, w.c FROM t LEFT JOIN m ON t.l_suppkey = m.l_suppkey, w WHERE NOT train)
SELECT {R.format('avg(abs(y - k))')} AS mae_by_key, {R.format('avg(abs(y - c))')} AS mae_constant, count(*) AS n FROM e""")
def baselines(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    train, test = line.where("l_orderkey % 10 < 6"), line.where("l_orderkey % 10 >= 6")
    rows = metrics.baselines(train.select("l_suppkey", "l_discount"), test.select("l_suppkey", "l_discount"), "l_suppkey", "l_discount")
    mae = lambda c: settled(F.avg(F.abs(F.col("l_discount") - F.col(c))))
    return rows.agg(mae("by_key").alias("mae_by_key"), mae("constant").alias("mae_constant"), F.count("*").alias("n"))


@query("bucketed_error", f"""WITH {SPINE}, e AS (SELECT cvr, 0.3::DOUBLE AS guess FROM priced), b AS (SELECT CASE WHEN cvr > -0.01 AND cvr <= 0.2 THEN 0 WHEN cvr > 0.2 AND cvr <= 0.8 THEN 1 WHEN cvr > 0.8 AND cvr <= 1.01 THEN 2 END AS bucket, * FROM e)
SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n, {R.format('avg(abs(guess - cvr))')} AS mae, {R.format('avg(guess - cvr)')} AS bias FROM b WHERE bucket IS NOT NULL GROUP BY 1""")
def bucketed_error(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.bucketed_error(spine(spark, d).withColumn("guess", F.lit(0.3)), "cvr", "guess")
    return rows.select("bucket", "n", settled(F.col("mae")).alias("mae"), settled(F.col("bias")).alias("bias"))


@query("rule_prob", f"""WITH {SPINE}, o AS (SELECT region, week, min(implied_price) AS rival FROM priced GROUP BY 1, 2), r AS (SELECT avg(implied_price) AS ref FROM priced),
z AS (SELECT brand, region, week, -1.45 - 12.0 * coalesce((implied_price - rival) / nullif(rival, 0), 0) - 4.0 * coalesce((implied_price - ref) / nullif(ref, 0), 0) + 0.5 + 0.5 + 0.45 AS z FROM priced JOIN o USING (region, week), r)
SELECT brand, region, week, {R.format('1 / (1 + exp(-greatest(-30, least(30, z))))')} AS p FROM z""")
def rule_prob(spark: SparkSession, d: str) -> DataFrame:
    """The stated rule for the featured-offer share over the whole panel."""
    rows = spine(spark, d).select("brand", "region", "week", F.col("implied_price").alias("price"))
    low = rows.groupBy("region", "week").agg(F.min("price").alias("rival"))
    ref = rows.agg(F.avg("price").alias("ref"))
    rows = rows.join(low, ["region", "week"]).crossJoin(F.broadcast(ref))  # one row
    one = F.lit(1.0)
    p = market.rule_share(market.price_gap(F.col("price"), F.col("rival")), market.price_gap(F.col("price"), F.col("ref")), one, one, F.lit(4.5))
    return rows.select("brand", "region", "week", settled(p).alias("p"))


FEATURES = ["implied_price", "discount", "week_of_year", "month"]


def model_panel(spark: SparkSession, d: str) -> DataFrame:
    side = sales(spark, d).groupBy("brand", F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.avg("l_discount").alias("discount"))
    rows = spine(spark, d).join(side, ["brand", "week"])
    return rows.select("brand", "region", "week", "cvr", "buybox_pct", "implied_price", "discount",
                       F.weekofyear("week").cast("double").alias("week_of_year"), F.month("week").cast("double").alias("month"))


@query("hurdle_cvr")
def hurdle_cvr(spark: SparkSession, d: str) -> DataFrame:
    """Two-stage conversion for each region: the chance of any sale times its size, price never raising either."""
    test = F.crc32(F.concat_ws("|", "brand", F.col("week").cast("string")).cast("binary")) % 10 < 3
    rows = stored(model_panel(spark, d).where("cvr is not null").withColumn("test", test), "hurdle-panel")
    sold, size = F.col("cvr") > 0, F.col("cvr").cast("double")
    stage = F.explode(F.filter(F.array(
        F.struct(F.lit("any").alias("stage"), sold.cast("double").alias("y")), F.when(sold, F.struct(F.lit("size").alias("stage"), size.alias("y")))
    ), lambda s: s.isNotNull()))
    both = rows.where("not test").withColumn("s", stage)
    both = both.select(F.concat_ws("|", "region", "s.stage").alias("model"), *FEATURES, "s.y", F.lit(1.0).alias("n"))
    regions = [str(r[0]) for r in rows.select("region").distinct().collect()]
    models = treefit.grow(both, FEATURES, 30, logistic=[f"{r}|any" for r in regions], monotone={"implied_price": -1})
    guess = rows.where("test").select("region", "cvr", *FEATURES)
    for s in ("any", "size"):
        named = guess.withColumns({"model": F.concat_ws("|", "region", F.lit(s)), **{f"k_{f}": F.col(f) for f in FEATURES}})
        guess = treefit.predicted(named, models, s, FEATURES).drop("model").withColumnsRenamed({f"k_{f}": f for f in FEATURES})
    p = F.least(F.greatest(F.col("any") * F.col("size"), F.lit(0.0)), F.lit(1.0))
    guess = guess.where("any is not null and size is not null").withColumn("guess", p)
    return guess.groupBy("region").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("guess") - F.col("cvr"))).alias("mae"), F.avg("guess").alias("mean_guess"), F.avg("cvr").alias("mean_true")
    )


@query("price_attribution")
def price_attribution(spark: SparkSession, d: str) -> DataFrame:
    """A boosted price model of all parts and the mean absolute share of each feature in its predictions for all of them.

    Parts of equal features are summed before the fit, which loses nothing: there are at most sizes times types of them.
    """
    part = table(spark, d, "part").groupBy("p_size", "p_type")
    exact = F.sum(F.col("p_retailprice").cast("decimal(28,6)")).cast("double")  # the same however rows are dealt out
    part = part.agg(F.count("*").alias("all"), F.count("p_retailprice").alias("known"), exact.alias("price"))
    types = sorted(r[0] for r in part.select("p_type").where("p_type is not null").distinct().collect())
    labels = ["p_size", *[f"p_type_{t}" for t in types[1:]]]
    names = {f"x{k}": label for k, label in enumerate(labels)}
    wide = ty.one_hot(part, "p_type", types)
    rows = wide.select(
        F.lit("all").alias("model"), *[F.col(f"`{c}`").cast("double").alias(k) for k, c in names.items()],
        F.try_divide("price", "known").alias("y"), F.col("known").cast("double").alias("n"), F.col("all").cast("double").alias("all"),
    )
    rows = stored(rows, "price-groups")
    models = treefit.grow(rows.where("n > 0"), list(names), 20, depth=3, counted=True)
    named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return treefit.attributed(rows, models, "all").select(named[F.col("feature")].alias("feature"), "importance")


@query("outcome_rules")
def outcome_rules(spark: SparkSession, d: str) -> DataFrame:
    """The shallow rule tree of each region's outcome classes, a line for each leaf."""
    label = F.when(F.col("buybox_pct") >= 100, "WON").when(F.col("buybox_pct") <= 0, "LOST").otherwise("MIXED")
    rows = stored(model_panel(spark, d).select(F.col("region").cast("string").alias("model"), *FEATURES, label.alias("label")), "outcome-panel")
    trees = treefit.grow_classes(rows, FEATURES, 5, min_leaf=200)
    lines = [(int(m), line) for m, tree in trees.items() for line in boosting.rule_lines(tree)]  # 32 for each region at most
    return spark.createDataFrame(lines, "region int, rule string")


def demo_market(spark: SparkSession, d: str) -> market.Market:
    price = table(spark, d, "part").agg(F.median("p_retailprice")).first()[0]
    return market.Market(float(price), (price * 0.95, float(price), price * 1.08), market_size=1000.0)


@query("mc_bands")
def mc_bands(spark: SparkSession, d: str) -> DataFrame:
    """Weekly profit bands of 200 runs of a policy that holds its price against a promotion cycle."""
    m = demo_market(spark, d)
    runs = agents.monte_carlo(spark, m, agents.Hold(m), "promo_cycler", 200)
    return metrics.bands(runs, "t", "profit")


@query("agent_training")
def agent_training(spark: SparkSession, d: str) -> DataFrame:
    """Short training of each kind of agent for two seeds, in parallel."""
    return agents.train_many(spark, {"demo": demo_market(spark, d)}, ["table", "deep", "proximal"], [0, 1], 15)
