"""Parsing, typing, scaling and style queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions import parse, style, table_functions
from pricewright.functions.columns import settled
from pricewright.operators import catalogue
from pricewright.operators import typing as ty
from pricewright.plans.registry import query
from pricewright.sources.tables import table


def cells(spark: SparkSession, d: str, *forms) -> DataFrame:
    """Parts with a text cell whose form goes by the key."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    cell = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        cell = F.when(key % len(forms) == i, form(size)).otherwise(cell)
    return table(spark, d, "part").select("p_partkey", "p_size", cell.alias("cell"))


@query("to_number", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size + 2 WHEN 2 THEN p_size
  WHEN 3 THEN 1000 + p_size END::DOUBLE AS x FROM part""")
def to_number(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(
        spark, d, lambda s: F.concat(s, F.lit(" hrs")), lambda s: F.concat(s, F.lit("-"), (F.col("p_size") + 4).cast("string"), F.lit(" h")),
        lambda s: F.concat(F.lit("IPX"), s), lambda s: F.concat(F.lit("$1,"), F.lpad(s, 3, "0"), F.lit(".00")), lambda s: F.lit("n/a"),
    )
    return rows.select("p_partkey", parse.number(F.col("cell")).alias("x"))


@query("eu_number", """SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size + 0.5 WHEN 2 THEN 1000 + p_size + 0.5
  ELSE p_size + 0.2 END::DOUBLE + 1e-9, 6) AS x FROM part""")
def eu_number(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(
        spark, d, lambda s: F.concat(s, F.lit(".000")), lambda s: F.concat(s, F.lit(",5")),
        lambda s: F.concat(F.lit("1."), F.lpad(s, 3, "0"), F.lit(",5")), lambda s: F.concat(s, F.lit(".2")),
    )
    return rows.select("p_partkey", settled(parse.european_number(F.col("cell"))).alias("x"))


@query("unit_parse", """SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN p_size * 453.592 END::DOUBLE + 1e-9, 6) AS grams,
  CASE WHEN p_partkey % 3 = 2 THEN round(p_size / 60.0 + 1e-9, 6) END AS hours FROM part""")
def unit_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(
        spark, d, lambda s: F.concat(s, F.lit(" kg")), lambda s: F.concat(F.lit("ca. "), s, F.lit(" pounds")), lambda s: F.concat(s, F.lit(" Minuten"))
    )
    first = lambda dim: settled(F.get(parse.converted(F.col("cell"), dim), F.lit(0)))
    return rows.select("p_partkey", first("mass_g").alias("grams"), first("time_h").alias("hours"))


@query("triple_mm", "SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN p_size ELSE p_size * 10 END::DOUBLE AS depth, CASE p_partkey % 2 WHEN 0 THEN p_size + 1 ELSE 20 END::DOUBLE AS width FROM part")
def triple(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(
        spark, d, lambda s: F.concat(s, F.lit(" x "), (F.col("p_size") + 1).cast("string"), F.lit(" x 7 mm")), lambda s: F.concat(s, F.lit("x2x3"))
    )
    sides = parse.triple_mm(F.col("cell"))
    return rows.select("p_partkey", sides[0].alias("depth"), sides[1].alias("width"))


@query("canonicalize", "SELECT p_partkey, lower(p_type) AS kind FROM part")
def canonicalize(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.concat(F.lit("  - "), F.upper("p_type"), F.lit(" ;  "))
    return table(spark, d, "part").select("p_partkey", parse.canonical(noisy).alias("kind"))


@query("colour_and_flag", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'black' WHEN 1 THEN 'blue' WHEN 2 THEN 'green' END AS colour,
  CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM part""")
def colour_and_flag(spark: SparkSession, d: str) -> DataFrame:
    hue = F.element_at(F.array(*[F.lit(x) for x in ("Schwarz matt", "BLEU nuit", "vert pomme", "uni")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    said = F.element_at(F.array(*[F.lit(x) for x in ("IPX7", "Nein", "maybe")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", parse.colour(hue).alias("colour"), parse.flag(said).alias("flag"))


@query("json_props", """SELECT event_id, k AS "key", props ->> k AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects as a long table, one row for each key."""
    entries = F.explode(F.map_entries(F.from_json("props", "map<string,string>"))).alias("e")
    return table(spark, d, "events").select("event_id", entries).select("event_id", "e.key", "e.value")


@query("kv_flatten", """SELECT event_id, 'ttf_k' AS name, CAST(CAST(props ->> 'k' AS BIGINT) + 1 AS VARCHAR) AS value FROM events""")
def kv_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Lists of key-value objects as long rows; of a repeated key the last one counts."""
    k = F.get_json_object("props", "$.k").cast("long")
    sheet = F.format_string('[{"key":"k","value":"%s"},{"key":"k","value":"%s"}]', k.cast("string"), (k + 1).cast("string"))
    rows = catalogue.sheet_long(table(spark, d, "events").select("event_id", sheet.alias("sheet")), "event_id", "sheet", "ttf_")
    return rows.select(F.col("row_id").alias("event_id"), F.col("feature").alias("name"), "value")


@query("paragraph_segment", """SELECT doc_id, CAST(i AS INTEGER) AS place, p AS paragraph FROM (SELECT doc_id, unnest(s) AS p, generate_subscripts(s, 1) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE trim(p) <> ''""")
def paragraph_segment(spark: SparkSession, d: str) -> DataFrame:
    """Texts as long rows of paragraphs; a blank one keeps its place and goes."""
    rows = catalogue.paragraphs(table(spark, d, "documents"), "doc_id", "text")
    place = F.substring_index("section", "_", -1).cast("int")
    return rows.select(F.col("row_id").alias("doc_id"), place.alias("place"), F.col("value").alias("paragraph"))


@query("kv_lateral", """SELECT event_id, 'ttf_k' AS name, CAST(CAST(props ->> 'k' AS BIGINT) + 1 AS VARCHAR) AS value FROM events""")
def kv_lateral(spark: SparkSession, d: str) -> DataFrame:
    """The sheets of ``kv_flatten`` unfolded by a table function in SQL."""
    table_functions.register(spark)
    k = F.get_json_object("props", "$.k").cast("long")
    sheet = F.format_string('[{"key":"k","value":"%s"},{"key":"k","value":"%s"}]', k.cast("string"), (k + 1).cast("string"))
    sheets = table(spark, d, "events").select("event_id", sheet.alias("sheet"))
    return spark.sql("SELECT event_id, feature AS name, value FROM {sheets}, LATERAL kv(sheet, 'ttf_')", sheets=sheets)


@query("paragraph_lateral", """SELECT doc_id, CAST(i AS INTEGER) AS place, p AS paragraph FROM (SELECT doc_id, unnest(s) AS p, generate_subscripts(s, 1) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE trim(p) <> ''""")
def paragraph_lateral(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs of ``paragraph_segment`` by a table function in SQL."""
    table_functions.register(spark)
    docs = table(spark, d, "documents").select("doc_id", "text")
    return spark.sql("SELECT doc_id, place, value AS paragraph FROM {docs}, LATERAL paragraphs(text)", docs=docs)


@query("about_items", """SELECT event_id, 'paragraph_' || CAST(place AS VARCHAR) AS section, CASE place WHEN 1 THEN event_type WHEN 3 THEN 'last' END AS value
  FROM events, (VALUES (1), (2), (3)) v(place)""")
def about_items(spark: SparkSession, d: str) -> DataFrame:
    """Lists of items as long rows: one without the field keeps its place, anything but an object takes none."""
    listed = F.format_string('[{"about_item":"%s"},{"other":1},"stray",{"about_item":"last"}]', F.col("event_type"))
    rows = catalogue.about_items(table(spark, d, "events").select("event_id", listed.alias("items")), "event_id", "items")
    return rows.select(F.col("row_id").alias("event_id"), "section", "value")


@query("style_vector", r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS w FROM documents),
a AS (SELECT *, list_filter(w, lambda x: regexp_full_match(x, '\p{L}+')) AS alpha, len(regexp_extract_all(text, '[^\p{L}\p{N}_\s]')) AS marks FROM t)
SELECT doc_id, round(len(list_distinct(w)) / greatest(len(w), 1)::DOUBLE + 1e-9, 6) AS type_token_ratio,
  round(CASE WHEN len(alpha) > 0 THEN list_sum(list_transform(alpha, lambda x: length(x))) / len(alpha)::DOUBLE ELSE 0 END + 1e-9, 6) AS avg_word_length,
  round(len(list_filter(alpha, lambda x: length(x) > 6)) / greatest(len(w), 1)::DOUBLE + 1e-9, 6) AS long_word_ratio,
  round(marks / greatest(length(text), 1)::DOUBLE + 1e-9, 6) AS punctuation_ratio,
  round(len(list_filter(w, lambda x: regexp_matches(x, '\p{Nd}'))) / greatest(len(w), 1)::DOUBLE + 1e-9, 6) AS digit_token_ratio FROM a""")
def style_vector(spark: SparkSession, d: str) -> DataFrame:
    found = style.features(F.col("text"))
    names = ("type_token_ratio", "avg_word_length", "long_word_ratio", "punctuation_ratio", "digit_token_ratio")
    return table(spark, d, "documents").select("doc_id", *[settled(found[n]).alias(n) for n in names])


def _style_sql() -> str:
    """The statement for every style column, with the word lists of the features."""
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    ended = lambda w, rule, n: f" OR regexp_matches({w}, '.{{{n},}}({'|'.join(rule[1])})$')" if rule[1] else ""
    matched = lambda w, rule, n=2: f"({w} IN ({listed(rule[0])}){ended(w, rule, n)})"
    hits = lambda words: f"len(list_filter(low, lambda x: x IN ({listed(words)})))"
    per = lambda count, of: f"{count} / greatest(len({of}), 1)::DOUBLE"
    tag = "CASE WHEN NOT regexp_matches(x, '[\\p{L}\\p{Nd}]') THEN 'mark' "
    more = lambda name: f" OR regexp_matches(x, '{style.DIGIT}')" if name == "numeral" else ""
    tag += " ".join(f"WHEN {matched('lower(x)', rule)}{more(name)} THEN '{name}'" for name, rule in style.CLASSES.items()) + " ELSE 'noun' END"
    degree = f"{matched('x', style.DEGREES, 3)} AND x NOT IN ({listed(style.NO_DEGREES)})"
    before = listed([*style.CLASSES["conjunction"][0], ","])
    asks = f"len(list_filter(p, lambda x, i: x IN ({listed(style.REQUESTS)}) AND (i = 1 OR p[i - 1] IN ({before}))))"
    most = f"greatest({', '.join(f'n_{c}' for c in style.STOP_WORDS)})"
    language = f"CASE WHEN {most} = 0 THEN 'en' " + " ".join(f"WHEN n_{c} = {most} THEN '{c}'" for c in style.STOP_WORDS) + " END"
    mean = "coalesce(list_sum(lens), 0) / greatest(len(lens), 1)"
    columns = {
        "avg_sentence_length": mean,
        "std_sentence_length": f"sqrt(greatest(coalesce(list_sum(list_transform(lens, lambda x: x * x)), 0) / greatest(len(lens), 1) - ({mean}) * ({mean}), 0))",
        "max_sentence_length": "coalesce(list_max(lens), 0)",
        "type_token_ratio": per("len(list_distinct(w))", "w"),
        "hapax_ratio": "coalesce(once, 0) / greatest(len(list_distinct(w)), 1)::DOUBLE",
        "stopword_ratio": per(hits(style.STOP_WORDS["en"]), "w"),
        "avg_word_length": "CASE WHEN len(alpha) > 0 THEN list_sum(list_transform(alpha, lambda x: length(x))) / len(alpha)::DOUBLE ELSE 0 END",
        "long_word_ratio": per("len(list_filter(alpha, lambda x: length(x) > 6))", "w"),
        "uppercase_ratio": per("len(list_filter(alpha, lambda x: length(x) > 1 AND regexp_full_match(x, '\\p{Lu}+')))", "w"),
        "capitalized_ratio": per("len(list_filter(alpha, lambda x: regexp_full_match(x, '\\p{Lu}\\p{Ll}*')))", "w"),
        "digit_token_ratio": per("len(list_filter(w, lambda x: regexp_matches(x, '\\p{Nd}')))", "w"),
        "punctuation_entropy": "coalesce(entropy, 0)",
        "punctuation_ratio": "len(marks) / greatest(length(text), 1)::DOUBLE",
        "exclamation_ratio": per("(length(text) - length(replace(text, '!', '')))", "lens"),
        "question_ratio": per("(length(text) - length(replace(text, '?', '')))", "lens"),
        "comma_ratio": per("(length(text) - length(replace(text, ',', '')))", "lens"),
    }
    columns |= {f"{name}_ratio": per(f"len(list_filter(tags, lambda x: x = '{name}'))", "w") for name in (*style.CLASSES, "noun")}
    columns["comparative_superlative_ratio"] = per(f"len(list_filter(low, lambda x: {degree}))", "w")
    columns["imperative_ratio"] = per(f"coalesce(list_sum(list_transform(parts, lambda p: {asks})), 0)", "parts")
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]') AS w, regexp_extract_all(text, '[^\p{{L}}\p{{N}}_\s]') AS marks,
  list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS said FROM d),
t AS (SELECT *, list_transform(w, lambda x: lower(x)) AS low, list_filter(w, lambda x: regexp_full_match(x, '\p{{L}}+')) AS alpha, list_transform(w, lambda x: {tag}) AS tags,
  list_transform(said, lambda x: list_transform(regexp_extract_all(x, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'), lambda y: lower(y))) AS parts FROM s),
l AS (SELECT *, list_transform(parts, lambda x: len(x)::DOUBLE) AS lens, {', '.join(f'{hits(words)} AS n_{c}' for c, words in style.STOP_WORDS.items())} FROM t),
o AS (SELECT doc_id, count(*) FILTER (WHERE n = 1) AS once FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM s) GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT doc_id, -sum(p * log2(p)) AS entropy FROM (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id)::DOUBLE AS p FROM
  (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(marks) AS x FROM s) GROUP BY 1, 2)) GROUP BY 1)
SELECT l.doc_id, {language} AS language, {', '.join(f'round({sql} + 1e-9, 6) AS {name}' for name, sql in columns.items())}
FROM l LEFT JOIN o ON l.doc_id = o.doc_id LEFT JOIN e ON l.doc_id = e.doc_id"""


@query("style_full", _style_sql())
def style_full(spark: SparkSession, d: str) -> DataFrame:
    """All style features, the language vote, the shares of word classes and the rate of requests."""
    rows = style.measured(table(spark, d, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", "language", *[settled(F.col(n)).alias(n) for n in style.NAMES])


@query("punct_entropy", r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\p{L}\p{N}_\s]')) AS c FROM documents),
n AS (SELECT doc_id, c, count(*) AS n FROM m GROUP BY 1, 2), p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id)::DOUBLE AS p FROM n),
e AS (SELECT doc_id, -sum(p * log2(p)) AS e FROM p GROUP BY 1)
SELECT d.doc_id, round(coalesce(e.e, 0) + 1e-9, 6) AS entropy FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id""")
def punct_entropy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", settled(style.punctuation_entropy(F.col("text"))).alias("entropy"))


@query("robust_scale", """WITH a AS (SELECT p_brand, median(p_retailprice) AS c, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) AS iqr,
  stddev_pop(p_retailprice) AS sd FROM part GROUP BY 1), m AS (SELECT p_brand, median(abs(p_retailprice - c)) AS mad FROM part JOIN a USING (p_brand) GROUP BY 1)
SELECT p_partkey, round((p_retailprice - c) / CASE WHEN iqr > 0 THEN iqr WHEN mad > 0 THEN 1.4826 * mad WHEN sd > 0 THEN sd ELSE 1 END + 1e-9, 6) AS scaled
FROM part JOIN a USING (p_brand) JOIN m USING (p_brand)""")
def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = ty.robust_scaled(table(spark, d, "part"), "p_retailprice", ["p_brand"])
    return rows.select("p_partkey", settled(F.col("p_retailprice_scaled")).alias("scaled"))


@query("quantile_codes", """WITH e AS (SELECT list_distinct(quantile_cont(p_size, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM part),
s AS (SELECT list_sort(e)[2:len(e) - 1] AS inner_edges FROM e)
SELECT p_partkey, CAST(len(list_filter(inner_edges, lambda x: x < p_size)) AS INTEGER) AS code FROM part, s""")
def quantile_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = ty.quantile_codes(table(spark, d, "part"), "p_size")
    return rows.select("p_partkey", F.col("p_size_code").alias("code"))


@query("soft_codes", """WITH f AS (SELECT p_type, min(p_partkey) AS first FROM part GROUP BY 1), c AS (SELECT p_type, row_number() OVER (ORDER BY first) - 1 AS code FROM f)
SELECT p_partkey, round(code / max(code) OVER ()::DOUBLE + 1e-9, 6) AS kind, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE + 1e-9, 6) AS size
FROM part JOIN c USING (p_type)""")
def soft_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = ty.soft_codes(ty.soft_codes(table(spark, d, "part"), "p_type", False, "p_partkey"), "p_size", True, "p_partkey")
    return rows.select("p_partkey", settled(F.col("p_type_soft")).alias("kind"), settled(F.col("p_size_soft")).alias("size"))


def long_parts(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")])
    return part.select(F.col("p_partkey").alias("row_id"), F.lit("clean").alias("section"), F.explode(pairs).alias("x")).select("row_id", "section", "x.feature", "x.value")


@query("column_types", """WITH l AS (SELECT 'p_size' AS feature, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT 'p_retailprice', CAST(p_retailprice AS VARCHAR) FROM part
  UNION ALL SELECT 'p_type', p_type FROM part), s AS (SELECT feature, count(*) AS n, count(DISTINCT value) AS u, avg((try_cast(value AS DOUBLE) IS NOT NULL)::INT) AS num,
  avg((try_cast(value AS DOUBLE) % 1 <> 0)::INT) AS frac FROM l GROUP BY 1)
SELECT feature, n, u AS n_unique, CASE WHEN num >= 0.98 AND coalesce(frac, 0) > 0.02 THEN 'numeric' WHEN u / n >= 0.98 THEN 'identifier' WHEN num < 0.98 THEN 'categorical'
  WHEN u <= 10 THEN 'categorical' WHEN u >= 50 THEN 'numeric' ELSE 'ambiguous' END AS type FROM s""")
def column_types(spark: SparkSession, d: str) -> DataFrame:
    rows = long_parts(spark, d).where("feature in ('p_size', 'p_retailprice', 'p_type')")
    return ty.column_types(rows).select("feature", "n", "n_unique", "type")


@query("concept_coalesce", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_type END, p_brand) AS brand FROM part")
def concept_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Headers of one concept as one column: the better filled first."""
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("ttf_Marque"), F.when(F.col("p_partkey") % 2 == 1, F.col("p_brand")).alias("btf_brand")
    )
    return ty.coalesced(rows.select("p_partkey", "ttf_Marque", "btf_brand"), ["ttf_Marque", "btf_brand"])


@query("null_extreme", """WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 500 = 7 THEN p_retailprice * 1000 ELSE p_retailprice END AS x FROM part),
q AS (SELECT quantile_cont(x, 0.01) / 10 AS lo, quantile_cont(x, 0.99) * 10 AS hi FROM v) SELECT p_partkey, CASE WHEN x BETWEEN lo AND hi THEN x END AS x FROM v, q""")
def null_extreme(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("p_partkey") % 500 == 7, F.col("p_retailprice") * 1000).otherwise(F.col("p_retailprice"))
    return ty.without_extremes(table(spark, d, "part").select("p_partkey", x.alias("x")), "x")


@query("rare_levels", """SELECT c_custkey, CASE WHEN n >= 60 THEN c_nationkey::VARCHAR ELSE 'infrequent' END AS level FROM (SELECT c_custkey, c_nationkey,
  count(*) FILTER (WHERE c_custkey % 10 < 9) OVER (PARTITION BY c_nationkey) AS n FROM customer)""")
def rare_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    return ty.levels_with_rare(rows, "nation", F.col("c_custkey") % 10 < 9, 60).select("c_custkey", F.col("nation_level").alias("level"))


@query("one_hot", """SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS seg_BUILDING, (c_mktsegment = 'MACHINERY')::INT AS seg_MACHINERY FROM customer""")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    return ty.one_hot(rows, "seg", ["AUTOMOBILE", "BUILDING", "MACHINERY"]).select("c_custkey", "seg_BUILDING", "seg_MACHINERY")
