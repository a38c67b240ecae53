"""Operators on small frames: ties, gaps, monotone trees, attributions, agents, streams, sinks."""

from __future__ import annotations

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricewright.operators import agents, asof, boosting, graphs, market, metrics, panel, similarity, typing
from pricewright.plans import registry
from pricewright.plans.learning import codes
from pricewright.sources import sinks, tables


def test_asof_matches_pandas_and_its_ties(spark):
    rng = np.random.default_rng(3)
    day = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(days=int(n))
    left = pd.DataFrame({"k": rng.integers(0, 6, 80), "ts": [day(n) for n in rng.integers(0, 40, 80)], "id": range(80)})
    right = pd.DataFrame({"k": rng.integers(0, 5, 60), "ts": [day(n) for n in rng.integers(0, 40, 60)], "v": rng.random(60), "seq": range(60)})
    got = asof.asof_nearest(spark.createDataFrame(left), spark.createDataFrame(right), "ts", ["k"], ["v"], "seq").toPandas().set_index("id")
    for row in left.itertuples():
        same = right[right.k == row.k]
        if same.empty:
            assert pd.isna(got.v[row.id])
            continue
        back, ahead = same[same.ts <= row.ts], same[same.ts >= row.ts]
        picks = []
        if len(back):
            best = back[back.ts == back.ts.max()]
            picks.append((row.ts - best.ts.iloc[0], 0, best.sort_values("seq").v.iloc[-1]))
        if len(ahead):
            best = ahead[ahead.ts == ahead.ts.min()]
            picks.append((best.ts.iloc[0] - row.ts, 1, best.sort_values("seq").v.iloc[0]))
        assert got.v[row.id] == min(picks)[2]


def test_filling_goes_both_ways_and_is_idempotent(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("b", 1, None)], "k string, w int, x double")
    once = panel.filled(rows, ["k"], "w", ["x"])
    assert [r.x for r in once.orderBy("k", "w").collect()] == [5.0, 5.0, 5.0, None]
    assert once.exceptAll(panel.filled(once, ["k"], "w", ["x"])).count() == 0


def test_null_keys_match_nothing(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 9), ("a", 8)], "k string, y int")
    assert sorted((r.x, r.y) for r in panel.attach(left, right, ["k"]).collect()) == [(1, None), (2, 8)]


def test_column_hygiene(spark):
    rows = spark.createDataFrame([(i, float(i % 7), None, 0.0 if i % 2 else None) for i in range(100)], "id int, x double, empty double, z double")
    assert panel.covered_columns(rows) == ["id", "x", "z"]
    assert "z" not in panel.useful_columns(rows)
    assert panel.informative_columns(rows, ["x", "z"], []) == ["x"]
    assert panel.conform(rows, [("x", "double"), ("new", "string")]).columns == ["x", "new"]


def test_normaliser_round_trip_and_constant_columns(spark):
    long = spark.createDataFrame([(i, "p", "w", f"{i} kg") for i in range(20)] + [(i, "p", "c", "7") for i in range(20)] + [(1, "t", "n", "A b ")], "row_id int, section string, feature string, value string")
    fitted = typing.Normaliser().fit(long)
    again = typing.Normaliser.from_json(fitted.to_json())
    assert again.parameters == fitted.parameters and fitted.parameters["c"].scale == 1.0
    out = {(r.row_id, r.feature): (r.scaled, r.label) for r in again.transform(long).collect()}
    assert out[(1, "n")] == (None, "a b") and out[(3, "c")][0] == 0.0


def test_monotone_trees_and_attributions():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 3))
    x[rng.random(1500) < 0.1, 1] = np.nan
    y = -2 * x[:, 0] + np.nan_to_num(x[:, 1]) + rng.normal(0, 0.3, 1500)
    model = boosting.grow(x, y, ["price", "b", "c"], 40, monotone={"price": -1})
    sweep = np.repeat(x[:20], 50, axis=0)
    sweep[:, 0] = np.tile(np.linspace(0, 1, 50), 20)
    assert (np.diff(model.predict(sweep).reshape(20, 50), axis=1) <= 1e-9).all()
    shares = model.attributions(x[:30])
    assert np.allclose(shares.sum(1), model.raw(x[:30]))
    assert np.abs(shares[:, 0]).mean() > 5 * np.abs(shares[:, 2]).mean()
    assert np.allclose(boosting.Trees.from_json(model.to_json()).predict(x), model.predict(x))


def test_attributions_are_shapley_values():
    rng = np.random.default_rng(1)
    x = rng.random((300, 3))
    model = boosting.grow(x, x[:, 0] * x[:, 1] + (x[:, 2] > 0.5), ["a", "b", "c"], 3, depth=3, min_leaf=10)

    def value(node, row, known):
        if node.left is None:
            return node.value
        if node.feature in known:
            return value(node.left if boosting._goes_left(node, row[node.feature]) else node.right, row, known)
        return sum(c.cover * value(c, row, known) for c in (node.left, node.right)) / node.cover

    row = model.binned(x[:1])[0]
    for tree in model.trees:
        expected = np.zeros(3)
        for order in itertools.permutations(range(3)):
            known: set[int] = set()
            for f in order:
                before = value(tree, row, known)
                known = known | {f}
                expected[f] += (value(tree, row, known) - before) / 6
        assert np.allclose(boosting._shapley(tree, row[None], 3)[0], expected)


def test_counted_rows_grow_the_model_of_all_rows():
    rng = np.random.default_rng(6)
    x = np.c_[rng.integers(0, 90, 3000), rng.integers(0, 2, 3000)].astype(float)
    x[::50, 0] = np.nan
    y = np.nan_to_num(x[:, 0]) % 7 + x[:, 1] + rng.random(3000)
    groups = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}).groupby(["a", "b"], dropna=False).y.agg(["mean", "size"]).reset_index()
    whole = boosting.grow(x, y, ["a", "b"], 10)
    counted = boosting.grow(groups[["a", "b"]].to_numpy(), groups["mean"].to_numpy(), ["a", "b"], 10, count=groups["size"].to_numpy())
    assert whole.edges[0] == np.unique(np.quantile(x[~np.isnan(x[:, 0]), 0], np.linspace(0, 1, boosting.BINS)[1:-1])).tolist()
    assert np.allclose(counted.predict(x), whole.predict(x))


def test_price_attribution_covers_all_parts(spark, tmp_path):
    rng = np.random.default_rng(8)
    n = 7000
    part = pd.DataFrame({"p_partkey": range(n), "p_size": rng.integers(1, 51, n).astype("int32"), "p_type": rng.choice(["X", "Y", "Z"], n)})
    part["p_retailprice"] = np.round(np.where(part.p_size % 5 == 0, 100.0, 5.0 * part.p_size) + 40.0 * (part.p_type == "Z") + rng.random(n), 2)
    spark.createDataFrame(part).write.parquet(f"{tmp_path}/part.parquet")
    names = ["p_size", "p_type_Y", "p_type_Z"]
    x = np.c_[part.p_size, part.p_type == "Y", part.p_type == "Z"].astype(float)
    model = boosting.grow(x, part.p_retailprice, names, 20, depth=3)
    expected = dict(zip(names, np.abs(model.attributions(x)[:, :-1]).mean(0), strict=True))
    got = {r.feature: r.importance for r in registry.queries()["price_attribution"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(expected)


def test_rule_gives_parity_and_falls_with_price(spark):
    m = market.Market(100.0, (100.0,))
    assert m.share(100.0, 100.0) == pytest.approx(0.5)
    shares = [m.share(p, 100.0) for p in (70, 85, 100, 115, 130)]
    assert shares == sorted(shares, reverse=True)
    assert 0 <= m.conversion(500.0, 100.0) <= m.conversion(100.0, 100.0) <= 1


@pytest.mark.parametrize("strategy", sorted(market.STRATEGIES))
def test_episodes_repeat(strategy):
    m = market.Market(100.0, (95.0, 110.0), horizon=20)
    one, two = (agents.play(market.Episode(m, strategy, 4, stochastic=True), agents.Hold(m)) for _ in range(2))
    assert one == two and len(one) == 20 and all(r["profit"] >= 0 for r in one)


@pytest.mark.parametrize("kind", ["table", "deep", "proximal"])
def test_agents_learn_to_beat_a_bad_price(kind):
    m = market.Market(100.0, (100.0,), market_size=500, horizon=26)
    agent = agents.make(kind, len(m.actions), 0, **({"rollout": 256, "rate": 3e-3} if kind == "proximal" else {"decay": 0.97}))
    agents.train(m, agent, 60, seed=1)
    mine = sum(r["profit"] for r in agents.play(market.Episode(m), agent))
    worst = sum(r["profit"] for r in agents.play(market.Episode(m), type("Up", (agents.Agent,), {"choose": lambda s, x, explore=True: 8})()))
    assert mine > worst


def test_curriculum_and_match():
    m = market.Market(100.0, (100.0,), horizon=8)
    ours, theirs = agents.train_curriculum(m, "table", 3, 1, 2)
    assert len(agents.head_to_head(m, ours, theirs)) == 8
    assert set(agents.assess(m, ours, runs=2)) == {"profit", "hold", "lift"}


def test_advantages_stop_at_episode_ends():
    got = agents.advantages([1, 1, 1], [0, 0, 0], [False, True, False], 5.0, 0.5, 1.0)
    assert got.tolist() == [1.5, 1.0, 3.5]


def test_louvain_finds_two_cliques(spark):
    pairs = [(a, b, 1.0) for g in (range(5), range(10, 15)) for a, b in itertools.combinations(g, 2)] + [(4, 10, 0.1)]
    edges = spark.createDataFrame(pairs, "src long, dst long, weight double")
    labels = {r.node: r.community for r in graphs.louvain(edges).collect()}
    assert {labels[n] for n in range(5)} == {0} and {labels[n] for n in range(10, 15)} == {10}
    rows = spark.createDataFrame(list(labels.items()), "node long, community long")
    assert graphs.modularity(edges, rows).first()[0] > 0.45
    assert graphs.largest_share(rows).first()[0] == 0.5


def blocks_graph(rng, sizes, inside, outside):
    group = np.repeat(np.arange(len(sizes)), sizes)
    n = len(group)
    a, b = np.triu_indices(n, 1)
    keep = rng.random(len(a)) < np.where(group[a] == group[b], inside, outside)
    return a[keep], b[keep], np.round(rng.random(keep.sum()) + 0.5, 3)


def quality(labels, a, b, w):
    total, inside, mass = w.sum(), 0.0, {}
    for x, y, v in zip(a, b, w, strict=True):
        inside += v * (labels[x] == labels[y])
        mass[labels[x]] = mass.get(labels[x], 0) + v
        mass[labels[y]] = mass.get(labels[y], 0) + v
    return inside / total - sum(m * m for m in mass.values()) / (4 * total * total)


@pytest.mark.parametrize(("kind", "few"), [("blocks", 50_000), ("ring", 0), ("star", 50_000)])
def test_louvain_over_partitions_is_as_good_as_one_by_one(spark, monkeypatch, kind, few):
    monkeypatch.setattr(graphs, "FEW_EDGES", few)
    rng = np.random.default_rng(21)
    if kind == "blocks":
        a, b, w = blocks_graph(rng, [30, 25, 20, 15], 0.4, 0.02)
    elif kind == "ring":  # twelve cliques of five in a ring
        pairs = [(5 * g + x, 5 * g + y) for g in range(12) for x, y in itertools.combinations(range(5), 2)] + [(5 * g, (5 * g + 6) % 60) for g in range(12)]
        a, b = (np.array(c) for c in zip(*pairs, strict=True))
        w = np.ones(len(a))
    else:  # a hub that all know, and pairs among the rest
        pairs = [(0, i) for i in range(1, 61)] + [(i, i + 1) for i in range(1, 60, 2)]
        a, b = (np.array(c) for c in zip(*pairs, strict=True))
        w = np.where(a == 0, 1.0, 5.0)
    edges = spark.createDataFrame([(int(x), int(y), float(v)) for x, y, v in zip(a, b, w, strict=True)], "src long, dst long, weight double")
    labels = {r.node: r.community for r in graphs.louvain(edges).collect()}
    assert set(labels) == set(a.tolist()) | set(b.tolist())
    for c in set(labels.values()):
        assert c == min(n for n in labels if labels[n] == c)
    n = max(labels) + 1
    one_by_one = dict(enumerate(graphs.communities(n, a, b, w)))
    assert quality(labels, a, b, w) >= quality(one_by_one, a, b, w) - 1e-9
    rows = spark.createDataFrame(list(labels.items()), "node long, community long")
    assert graphs.modularity(edges, rows).first()[0] == pytest.approx(quality(labels, a, b, w))


def test_louvain_moves_many_neighbours_in_a_phase(spark, monkeypatch):
    """Phases don't grow with the degree: of neighbours that want to, only those wait that would take from each other."""
    pairs = [(a, b, 1.0) for g in (range(24), range(30, 54)) for a, b in itertools.combinations(g, 2)] + [(0, 30, 1.0)]
    phases, phase = [], graphs._phase
    monkeypatch.setattr(graphs, "_phase", lambda *given: phases.append(1) or phase(*given))
    labels = {r.node: r.community for r in graphs.louvain(spark.createDataFrame(pairs, "src long, dst long, weight double")).collect()}
    assert {labels[n] for n in range(24)} == {0} and {labels[n] for n in range(30, 54)} == {30}
    assert len(phases) <= 12


def edge_table(spark, a, b, w):
    return spark.createDataFrame([(int(x), int(y), float(v)) for x, y, v in zip(a, b, w, strict=True)], "src long, dst long, weight double")


def test_louvain_of_few_edges_takes_no_phase(spark, monkeypatch):
    """A graph that fits a bounded piece of memory is finished there, repeated and turned edges summed, communities named by smallest nodes."""
    a, b, w = blocks_graph(np.random.default_rng(5), [30, 25, 20, 15], 0.4, 0.02)
    ids = np.arange(90) * 7 + 3
    monkeypatch.setattr(graphs, "_phase", None)
    edges = edge_table(spark, ids[a], ids[b], w / 2).union(edge_table(spark, ids[b], ids[a], w / 2))
    labels = {r.node: r.community for r in graphs.louvain(edges).collect()}
    first: dict[int, int] = {}
    assert labels == {ids[n]: first.setdefault(c, ids[n]) for n, c in enumerate(graphs.communities(90, a, b, w))}


@pytest.mark.parametrize("kind", ["blocks", "star"])
def test_louvain_of_more_edges_moves_in_phases_first(spark, monkeypatch, kind):
    if kind == "blocks":
        a, b, w = blocks_graph(np.random.default_rng(21), [30, 25, 20, 15], 0.4, 0.02)
    else:
        pairs = [(0, i) for i in range(1, 61)] + [(i, i + 1) for i in range(1, 60, 2)]
        a, b = (np.array(c) for c in zip(*pairs, strict=True))
        w = np.where(a == 0, 1.0, 5.0)
    phases, phase = [], graphs._phase
    monkeypatch.setattr(graphs, "FEW_EDGES", len(a) - 1)
    monkeypatch.setattr(graphs, "_phase", lambda *given: phases.append(1) or phase(*given))
    labels = {r.node: r.community for r in graphs.louvain(edge_table(spark, a, b, w)).collect()}
    assert phases and set(labels) == set(a.tolist()) | set(b.tolist())
    assert quality(labels, a, b, w) >= quality(dict(enumerate(graphs.communities(max(labels) + 1, a, b, w))), a, b, w) - 1e-9


def test_louvain_of_no_and_of_loose_edges(spark):
    schema = "src long, dst long, weight double"
    assert graphs.louvain(spark.createDataFrame([], schema)).count() == 0
    loose = graphs.louvain(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (7, 7, 2.0)], schema)).collect()
    assert {(r.node, r.community) for r in loose} == {(1, 1), (2, 1), (7, 7)}


def test_whole_components_match_union_find(spark, tmp_path):
    rng = np.random.default_rng(12)
    lines = [(int(s), int(s // 5 * 10 + rng.integers(0, 8)), float(q)) for s, q in zip(rng.integers(0, 40, 120), rng.integers(1, 51, 120), strict=True)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(s, s % 3) for s in range(40)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(n, n) for n in range(3)], "n_nationkey long, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    over: dict[int, int] = {}

    def top(n):
        while over.setdefault(n, n) != n:
            n = over[n]
        return n

    for s, p, _ in lines:
        low, high = sorted((top(s), top(p + 1_000_000)))
        over[high] = low
    got = {r.node: r.component for r in registry.queries()["components"](spark, str(tmp_path)).collect()}
    assert got == {n: top(n) for n in over} and len(set(got.values())) > 3


def test_k_modes_and_votes(spark):
    rows = spark.createDataFrame([(i, "a" if i < 6 else "b", "x" if i < 6 else "y") for i in range(12)], "id long, f string, g string")
    placed, modes = similarity.k_modes(rows, "id", ["f", "g"], 2)
    assert {tuple(m.values()) for m in modes} == {("a", "x"), ("b", "y")}
    assert placed.agg(F.sum("cost")).first()[0] == 0


def test_kept_votes_are_all_pairs_over_the_threshold(spark, tmp_path):
    # 40 parts of each of two types: 2 * 780 equal pairs in one brand
    part = [(i, "B", f"T{i % 2}", i % 2 + 1, 100.0 + 900 * (i % 2)) for i in range(80)]
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    votes = similarity.cosine_votes(codes(spark, str(tmp_path))).toPandas()
    cut = similarity.otsu(spark.createDataFrame(votes), "score", ["cluster"]).first().threshold
    got = registry.queries()["kept_votes"](spark, str(tmp_path)).toPandas()
    assert set(zip(got.i, got.j)) == set(zip(*votes[votes.score >= cut][["i", "j"]].to_numpy().T)) and len(got) > 500


def test_a_budget_keeps_the_best_pairs_and_ties(spark):
    scores = [0.1] * 5 + [0.8, 0.8, 0.9, 1.0]
    votes = spark.createDataFrame([("c", 0, i, s) for i, s in enumerate(scores)], "cluster string, i long, j long, score double")
    kept = lambda *budget: sorted(r.j for r in similarity.kept_votes(votes, *budget).collect())
    assert kept() == [5, 6, 7, 8] and kept(1) == [8] and kept(2) == [7, 8] and kept(3) == [5, 6, 7, 8]


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    rows = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert metrics.roc_auc(rows, F.col("y") == 1, "s").first()[0] == pytest.approx(auc)


def test_quantile_codes_match_pandas(spark):
    x = pd.Series([1.0] * 30 + list(range(50)) + [None] * 3, dtype=float)
    got = typing.quantile_codes(spark.createDataFrame([(i, None if v != v else v) for i, v in enumerate(x)], "i int, x double"), "x")
    expected = pd.qcut(x, 10, labels=False, duplicates="drop").fillna(-1).astype(int).tolist()
    assert [r.x_code for r in got.orderBy("i").collect()] == expected


def test_stream_of_weeks(spark, tmp_path):
    from pricewright.streaming.weekly import weekly_stream

    rows = [(dt.datetime(2025, 1, 6 + i), "a", 1.0) for i in range(15)] + [(dt.datetime(2025, 3, 3), "a", 1.0)]
    spark.createDataFrame(rows, "ts timestamp_ntz, k string, x double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, k string, x double").parquet(str(tmp_path / "in"))
    out = weekly_stream(stream, "ts", ["k"], total=F.sum("x"))
    run = out.writeStream.format("memory").queryName("weeks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert {str(r.week): r.total for r in spark.table("weeks").collect()} == {"2025-01-06": 7.0, "2025-01-13": 7.0, "2025-01-20": 1.0}


def test_two_row_csv_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([("1", "red"), ("2", None)], "clean__id string, title__colour string")
    sinks.write_two_row_csv(wide, str(tmp_path / "w"))
    back = tables.two_row_csv(spark, str(tmp_path / "w"))
    assert back.columns == wide.columns and sorted(r[0] for r in back.collect()) == ["1", "2"]


def test_json_and_lookup(spark, tmp_path):
    sinks.write_json({"a": {"type": "numeric"}}, spark, str(tmp_path / "types_x.json"))
    assert tables.json_sidecar(spark, str(tmp_path / "types_x.json")) == {"a": {"type": "numeric"}}
    assert tables.json_sidecar(spark, str(tmp_path / "none.json"), {"b": 1}) == {"b": 1}
    assert tables.find_dataset(spark, str(tmp_path), "types").endswith("types_x.json")
    assert tables.find_dataset(spark, str(tmp_path), "zzz") is None
    with pytest.raises(ValueError, match="not one of"):
        tables.matching(spark.range(1), "id; drop", "x")


def test_headers_group_and_merge(spark):
    from pricewright.operators import catalogue

    groups = catalogue.header_clusters(["ttf_Color", "btf_Color", "ttf_Couleur", "ttf_Item Weight", "btf_Battery life"])
    assert [g.names for g in groups] == [["ttf_Color", "btf_Color", "ttf_Couleur"], ["ttf_Item Weight"], ["btf_Battery life"]]
    long = spark.createDataFrame([(1, "clean", "btf_Color", "red"), (1, "clean", "ttf_Color", None), (2, "clean", "ttf_Couleur", "blue")], "row_id long, section string, feature string, value string")
    got = sorted((r.row_id, r.feature, r.value) for r in catalogue.merged_headers(long, groups).collect())
    assert got == [(1, "ttf_Color", "red"), (2, "ttf_Color", "blue")]


def test_items_keep_their_places(spark):
    from pricewright.operators import catalogue

    rows = spark.createDataFrame([(1, '[{"about_item":"a"},{"other":1},"plain",{"about_item":"c"}]'), (2, "[]"), (3, "x")], "id long, data string")
    got = [(r.row_id, r.section, r.value) for r in catalogue.about_items(rows, "id", "data").orderBy("section").collect()]
    assert got == [(1, "paragraph_1", "a"), (1, "paragraph_2", None), (1, "paragraph_3", "c")]


def test_failures_of_one_term_stop_no_other(spark):
    from pricewright.operators import catalogue

    frame = spark.createDataFrame([(i, "clean", "w", f"{i} kg") for i in range(5)], "row_id long, section string, feature string, value string")

    def load(term):
        if term == "bad":
            raise ValueError("no such term")
        return frame

    done, failed = catalogue.build_all(["good", "bad"], load)
    assert set(done) == {"good"} and failed == {"bad": "no such term"}
    assert done["good"].table.where("scaled is not null").count() == 5


def test_sample_sizes_and_imputation(spark):
    from pricewright.operators import backtest, factors

    rows = spark.createDataFrame([(0.5,), (1 / 3,), (0.5,), (None,)], "s double")
    assert {round(r.s, 3): (r.n, r.denominator) for r in backtest.inferred_sizes(rows, "s").collect()} == {0.5: (2, 2), 0.333: (1, 3)}
    x = np.outer(np.linspace(0.1, 0.9, 12), np.linspace(0.2, 1, 6))
    y = x.copy()
    y[3, 2] = np.nan
    assert abs(factors.imputed(y, 1, 30)[3, 2] - x[3, 2]) < 0.02
    assert factors.linked_features(np.array([[1, 0.95, 0], [0.95, 1, 0], [0, 0, 1]])) == [0, 0, 1]


def test_sample_sizes_of_shares_between_two_samples(spark):
    from pricewright.operators import backtest

    rows = spark.createDataFrame([(59 / 60,), (57 / 116,), (1.0,), (0.0,), (7 / 30,)], "s double")
    assert {round(r.s, 6): r.denominator for r in backtest.inferred_sizes(rows, "s").collect()} == {0.983333: 1, 0.491379: 2, 1.0: 1, 0.0: 1, 0.233333: 30}


def test_no_running_window_ends_unbounded(spark):
    """Such a frame is gone through again for each row, which is quadratic in the rows of a key."""
    rows = spark.range(40).selectExpr("id % 3 AS k", "id AS at", "IF(id % 4 = 0, id, NULL) AS v")
    both = asof.asof_nearest(rows.select("k", "at"), rows, "at", ["k"], ["v"], "at")
    for made in (both, panel.filled(rows, ["k"], "at", ["v"])):
        plan = made._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "windowspecdefinition" in plan and "unboundedfollowing" not in plan
    filled = {r.at: r.v for r in panel.filled(rows, ["k"], "at", ["v"]).collect()}
    assert [filled[i] for i in (1, 2, 5, 11)] == [4, 8, 8, 8]


def _read_counter(spark, rows):
    """The rows, and how many of them have been read so far."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    return rows.mapInPandas(run, rows.schema), read


def test_components_read_the_edges_once(spark):
    rng = np.random.default_rng(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (3, 900), (900, 2)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1300, (200, 2))]
    edges, read = _read_counter(spark, spark.createDataFrame(pairs, "src long, dst long"))
    got = {r.node: r.component for r in graphs.components(edges).collect()}
    assert read.value == len(pairs)
    root = {n: n for p in pairs for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    assert got == {n: find(n) for n in root}


def test_market_panel_joins_the_lines_once_and_counts_distinct_values_apart(spark, folder):
    from pricewright.plans.market_panels import market_panel

    plan = market_panel(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and "o_orderdate" not in plan  # columns that only the joined tables have
    assert "count(distinct" not in plan.lower()


def test_correlations_of_a_wide_table_move_no_rows(spark, folder):
    rows = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.5, 1.0), (4.0, 7.0, 0.0), (None, 1.0, 3.0), (8.0, None, 5.0)], "x double, y double, z double")
    got = {(r.a, r.b): (r.n, r.r) for r in metrics.correlated(rows, ["z", "x", "y"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {("x", "y"): 3, ("x", "z"): 3, ("y", "z"): 3}
    assert got[("x", "y")][1] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4.5, 7])[0, 1])
    plan = registry.queries()["feature_correlations"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "row_id" not in plan and "LocalRelation" not in plan


def test_one_style_feature_costs_no_other(spark):
    from pricewright.operators import catalogue

    rows = spark.createDataFrame([(1, "p", "a, b.")], "row_id long, section string, value string")
    only = catalogue.style_long(rows, ["punctuation_ratio"])
    assert [tuple(r) for r in only.collect()] == [tuple(r) for r in catalogue.style_long(rows).where("feature = 'punctuation_ratio'").collect()]


def test_a_panel_counts_only_the_distinct_values_asked_for(spark, folder):
    from pricewright.plans.market_panels import COUNTED, market_panel

    whole, light = market_panel(spark, folder), market_panel(spark, folder, ("n_sellers",))
    assert set(whole.columns) - set(light.columns) == set(COUNTED) - {"n_sellers"}
    plan = light._jdf.queryExecution().optimizedPlan().toString()
    assert "o_custkey" not in plan and "p_partkey" not in plan and "l_suppkey" in plan
    settle = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows.select(*sorted(light.columns)).collect())
    assert settle(light) == settle(whole)
