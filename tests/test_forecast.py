"""Forecasts on small panels: constraints, ranking, bundles, scores, typed columns."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricewright.operators import forecast, metrics, similarity, standardise
from pricewright.sources import tables


def panel(n: int = 900) -> tuple[pd.DataFrame, np.ndarray]:
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({
        "price": rng.uniform(5, 20, n), "lowest_price": rng.uniform(5, 20, n), "noise": rng.random(n), "brand": rng.choice(list("abcd"), n),
        "sparse": np.where(rng.random(n) < 0.005, 1.0, np.nan), "empty": np.nan,
    })
    shift = rows["brand"].map({"a": 0.0, "b": 0.3, "c": 0.1, "d": 0.2}).to_numpy()
    y = np.clip(0.6 - 0.04 * (rows["price"] - rows["lowest_price"]).to_numpy() + shift + rng.normal(0, 0.03, n), 0, 1)
    return rows, y


def test_ranked_refit_keeps_what_matters_and_its_directions():
    rows, y = panel()
    columns = list(rows.columns)
    ranking = forecast.ranked(rows, y, columns, ("brand",), rounds=30)
    assert set(ranking.index[:2]) == {"price", "lowest_price"} and "sparse" not in ranking and "empty" not in ranking
    assert forecast.best_columns(ranking, ("brand",), 4)[:2] == list(ranking.index[:2])
    model = forecast.refitted(rows[:600], y[:600], columns, ("brand",), top=5, rounds=60)
    assert model.levels["brand"] == ["a", "c", "d", "b"]
    guess = model.predict(rows[600:])
    found = forecast.scores(y[600:], guess)
    assert found["r2"] > 0.25 and found["mae"] < 0.35 and found["auc"] > 0.9
    sweep = rows[600:601].loc[np.repeat(600, 40)].assign(price=np.linspace(5, 20, 40))
    assert (np.diff(model.predict(sweep)) <= 1e-9).all()
    unseen = rows[600:603].assign(brand="new")
    assert np.isfinite(model.predict(unseen)).all() and np.isnan(model.matrix(unseen)[:, model.columns.index("brand")]).all()


def test_bundles_are_read_or_fitted_again(spark, tmp_path):
    rows, y = panel(300)
    calls = []

    def fit():
        calls.append(1)
        return forecast.fitted(rows, y, ["price", "brand"], ("brand",), forecast.SIGNS, rounds=5)

    path = str(tmp_path / "bundle.json")
    first = forecast.kept_or_fitted(spark, path, fit)
    again = forecast.kept_or_fitted(spark, path, fit)
    assert len(calls) == 1 and np.allclose(first.predict(rows), again.predict(rows))
    (tmp_path / "bundle.json").write_text("not a model")
    (tmp_path / ".bundle.json.crc").unlink(missing_ok=True)
    assert np.allclose(forecast.kept_or_fitted(spark, path, fit).predict(rows), first.predict(rows)) and len(calls) == 2


def test_models_of_a_table_rank_refit_and_score(spark):
    rows, y = panel(1200)
    frame = rows.assign(y=y, model=np.where(np.arange(1200) % 2, "a", "b"), test=np.arange(1200) % 5 == 0, price=rows["price"].round(1))
    table = spark.createDataFrame(frame)
    columns = [c for c in rows.columns]
    train = table.where("not test")
    ranking = forecast.ranked_models(train, columns, ("brand",), rounds=15)
    assert set(ranking) == {"a", "b"} and all(set(r.index[:2]) == {"price", "lowest_price"} and "sparse" not in r and "empty" not in r for r in ranking.values())
    models = forecast.refitted_models(train, columns, ("brand",), top=4, rounds=25, rate=0.2)
    for m, model in models.items():
        own = frame[(frame["model"] == m) & ~frame["test"]]
        means = own.groupby("brand")["y"].mean().sort_values()
        assert model.columns[:2] == list(forecast.best_columns(ranking[m], ("brand",), 2)) and model.levels.get("brand", list(means.index)) == list(means.index)
        sweep = frame.iloc[np.repeat(7, 40)].assign(price=np.linspace(5, 20, 40))
        assert (np.diff(model.predict(sweep)) <= 1e-9).all()
    guesses = forecast.guessed(table.where("test"), models, "brand").cache()
    found = {r.model: r for r in forecast.evaluated(guesses).collect()}
    for m, part in guesses.toPandas().groupby("model"):
        expected = forecast.scores(part["y"].to_numpy(), part["guess"].to_numpy())
        assert {k: found[m][k] for k in expected} == pytest.approx(expected) and found[m].n == len(part)
        assert found[m].r2 > 0.25 and found[m].mae < 0.35
        assert np.allclose(part["guess"].sort_values(), np.sort(models[m].predict(frame[(frame["model"] == m) & frame["test"]])))


def test_categories_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(forecast, "LEVELS", 3)
    rows = spark.createDataFrame([("a", float(i), f"b{i}") for i in range(5)], "model string, y double, brand string")
    with pytest.raises(ValueError):
        forecast.fitted_models(rows, {"a": ["brand"]}, ("brand",))


def test_scores_match_their_definitions():
    y, p = np.array([0.0, 0.2, 0.7, 1.0]), np.array([0.1, 0.6, 0.5, 0.9])
    pairs = [(a > b) + 0.5 * (a == b) for a, b in itertools.product(p[y >= 0.5], p[y < 0.5])]
    got = forecast.scores(y, p)
    assert got["auc"] == pytest.approx(np.mean(pairs)) and got["mae"] == pytest.approx(0.2)
    assert got["r2"] == pytest.approx(1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert np.isnan(forecast.scores(y * 0, p)["auc"])


def test_database_options(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("PRICES_URL", raising=False)
    (tmp_path / "settings").write_text('OTHER=1\nPRICES_URL = "postgresql://host/prices"\n')
    assert tables.database_options(spark, "PRICES_URL", str(tmp_path / "settings"))["url"] == "jdbc:postgresql://host/prices"
    monkeypatch.setenv("PRICES_URL", "jdbc:h2:mem")
    assert tables.database_options(spark, "PRICES_URL", str(tmp_path / "none"))["url"] == "jdbc:h2:mem"
    with pytest.raises(KeyError):
        tables.database_options(spark, "NO_SUCH_NAME", str(tmp_path / "settings"))


def test_typed_columns_of_nothing_and_of_extremes(spark):
    schema = "row_id long, concept string, value string"
    assert standardise.standardised(spark.createDataFrame([], schema), 0).features.count() == 0
    rows = [(i, "power", f"{20 + i % 5} W" if i else "9999 kW") for i in range(200)] + [(i, "blank", None) for i in range(200)]
    done = standardise.standardised(spark.createDataFrame(rows, schema), 200)
    found = {r.row_id: r.number for r in done.features.collect()}
    assert 0 not in found and found[7] == 22.0 and len(found) == 199
    assert [(r.concept, r.kind, r.dimension) for r in done.report.collect()] == [("power", "measure", "power_w")]


def test_values_are_parsed_once_however_many_cells_have_them(spark, monkeypatch):
    parsed = {}

    def counted(df, name, made=standardise.stored):
        table = made(df, name)
        parsed[name] = table.count()
        return table

    monkeypatch.setattr(standardise, "stored", counted)
    rows = [(i, "power", f"{20 + i % 5} W") for i in range(200)] + [(i, "size", f"{i % 3 + 1} x 2 x 3 cm") for i in range(200)] + [(i, "wet", "ja") for i in range(100)]
    rows += [(0, "power", "30 W"), (0, "power", "1 kW")]  # a row with three cells of a measure
    done = standardise.standardised(spark.createDataFrame(rows, "row_id long, concept string, value string"), 200)
    assert parsed["cells"] == 502 and parsed["values"] == 11 and parsed["read-measures"] == 7 and parsed["read-values"] == 10
    found = {(r.row_id, r.feature): (r.number, r.flag) for r in done.features.collect()}
    assert len(found) == 200 + 600 + 100 and found[7, "power__power_w"] == (22.0, None) and found[7, "size__depth_mm"] == (20.0, None) and found[99, "wet__bool"] == (None, True)
    assert found[0, "power__power_w"][0] in (20.0, 30.0, 1000.0)
    assert {(r.concept, r.kind, r.coverage) for r in done.report.collect()} == {("power", "measure", 1.01), ("size", "sides", 1.0), ("wet", "bool", 0.5)}


def test_typed_columns_are_compiled(spark, folder):
    from pricewright.plans import registry

    spark.conf.set("spark.sql.codegen.fallback", "false")  # else code that is too large is interpreted without an error
    try:
        registry.queries()["standard_features"](spark, folder).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_votes_of_blocks_are_those_of_the_whole(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 2), int(i), f, str(rng.integers(3))) for i in range(60) for f in ("a", "b", "c") if rng.random() < 0.7]
    codes = spark.createDataFrame(rows, "cluster int, row_id long, feature string, code string")
    votes = lambda block: {(r.i, r.j): r.score for r in similarity.copresent_votes(codes, block).collect()}
    have = {}
    for c, i, f, v in rows:
        have.setdefault((c, i), {})[f] = v
    expected = {}
    for (c, i), (e, j) in itertools.combinations(sorted(have), 2):
        both = set(have[c, i]) & set(have[e, j])
        if c == e and both:
            expected[i, j] = sum(have[c, i][f] == have[e, j][f] for f in both) / len(both)
    assert votes(2048) == votes(7) == pytest.approx(expected)


def test_useful_columns(spark):
    rows = spark.createDataFrame([(i, "x" if i % 3 else None, "0", "long " * 20, str(i)) for i in range(100)], "id long, a string, zero string, text string, key string")
    assert similarity.useful_columns(rows, ["id", "a", "zero", "text", "key"], most=50) == ["a"]
    assert similarity.useful_columns(rows.where(F.lit(False)), ["a"]) == []


def test_ranks_and_areas_by_ranges(spark):
    rng = np.random.default_rng(9)
    rows = pd.DataFrame({"g": rng.integers(0, 2, 400), "x": np.round(rng.exponential(1, 400), 1), "y": rng.integers(0, 9, 400).astype(float), "l": rng.integers(0, 2, 400)})
    frame = spark.createDataFrame(rows)
    for by in ([], ["g"]):
        for _, part in rows.groupby(by) if by else [(None, rows)]:
            keep = F.col("g") == int(part["g"].iloc[0]) if by else F.lit(True)
            pick = lambda table, name, keep=keep: table.where(keep).first()[name]
            assert pick(metrics.spearman(frame, "x", "y", by), "spearman") == pytest.approx(part["x"].rank().corr(part["y"].rank()))
            auc = np.mean([(a > b) + 0.5 * (a == b) for a in part["x"][part["l"] == 1] for b in part["x"][part["l"] == 0]])
            assert pick(metrics.roc_auc(frame, F.col("l") == 1, "x", by), "auc") == pytest.approx(auc)
            hit = [part["l"][part["x"] >= v].mean() for v in part["x"][part["l"] == 1]]
            assert pick(metrics.average_precision(frame, F.col("l") == 1, "x", by), "average_precision") == pytest.approx(np.mean(hit))
    odd = spark.createDataFrame([(None,), (3.0,), (3.0,), (1.0,)], "x double")
    assert sorted((r.x or -1, r.k) for r in metrics.average_ranks(odd, "x", "k").collect()) == [(-1, 1.0), (1.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


def test_rows_of_few_files_are_dealt_out_for_models(spark):
    from pricewright.plans import models

    rows = spark.range(0, 1000, 1, 1).withColumn("x", F.col("id") % 7)
    dealt = models._dealt(rows, "id", 100)
    sizes = [len(p) for p in dealt.rdd.glom().collect()]
    assert len(sizes) == 10 and sum(sizes) == 1000 and max(sizes) < 200
    again = [[r.id for r in p] for p in models._dealt(rows.repartition(3), "id", 100).rdd.glom().collect()]
    assert again == [[r.id for r in p] for p in dealt.rdd.glom().collect()]  # a forest draws by place, so runs agree
    assert models._dealt(rows.where("false"), "id", 100).count() == 0
