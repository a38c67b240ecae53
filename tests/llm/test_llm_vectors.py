"""Whitening, hard negatives and outliers against plain versions."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewright.llm import negatives, outliers, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component int"


def frame_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], lab, "clash", 3) for i, v, lab in rows], SCHEMA)


ODD = [(901, None, 1), (902, [1.0, None] * 4, 1), (903, [float("nan")] * 8, 2), (904, [float("inf")] + [0.0] * 7, 2), (905, [], 0), (906, [0.5] * 3, 1)]


# ---- whitening ----


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33])
def test_rounds_meet_every_pair_once(n):
    met = [(int(p), int(q)) for ps, qs in whitening.rounds(n) for p, q in zip(ps, qs, strict=True)]
    assert sorted(met) == [(p, q) for p in range(n) for q in range(p + 1, n)]
    for ps, qs in whitening.rounds(n):
        assert len(set(ps) | set(qs)) == 2 * len(ps)


def test_rotations_give_accurate_small_eigenvalues():
    rng = np.random.default_rng(0)
    b = rng.normal(size=(40, 12))
    scale = 10.0 ** -np.arange(12)  # graded: eigenvalues from 1 down to 1e-22
    a = (b.T @ b) * scale[:, None] * scale[None, :]
    values, vectors = whitening.jacobi(a)
    assert (np.diff(values) <= 0).all() and np.allclose(vectors.T @ vectors, np.eye(12), atol=1e-14)
    from decimal import Decimal, getcontext

    getcontext().prec = 80
    m = [[Decimal(float(c)) for c in row] for row in a]
    determinant = Decimal(1)
    for i in range(12):
        determinant *= m[i][i]
        for j in range(i + 1, 12):
            f = m[j][i] / m[i][i]
            m[j] = [x - f * y for x, y in zip(m[j], m[i], strict=True)]
    product = Decimal(1)
    for v in values:
        product *= Decimal(float(v))
    assert abs(product / determinant - 1) < Decimal("1e-12")
    assert np.array_equal(whitening.jacobi(np.zeros((3, 3)))[0], np.zeros(3))


def test_whitening_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(400, 8)) @ rng.normal(size=(8, 8)) * 0.2).astype(np.float32)
    x[50:80] = x[50]
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(None, x[7], 1), (7, x[7], 1), *ODD]
    got = whitening.components_of(frame_of(spark, rows)).collect()
    whole = np.floor(64 * x.astype(float)).astype(int) + 1_000_000
    points = np.unique(whole, axis=0)
    n, sums = len(points), points.sum(axis=0)
    centred = points - sums / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 402 * 8 and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-10
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert set(by) == {None, *range(400)} and all(len(c) == 2 for c in by[7].values())
    signs = [np.sign(by[0][k + 1][0].whitened * (((whole[0] - sums / n) @ vectors[:, k]))) for k in range(8)]
    for i in range(400):
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(whole[i], sums, strict=True))
        for k in range(8):
            r = by[i][k + 1][0]
            expected = signs[k] * ((whole[i] - sums / n) @ vectors[:, k]) / np.sqrt(values[k])
            assert r.deviation == deviation and abs(r.whitened - expected) < 1e-8
            assert abs(r.explained / (values[k] / values.sum()) - 1) < 1e-9


def test_whitening_of_nothing_one_and_flat_tables(spark):
    assert whitening.components_of(frame_of(spark, [])).count() == 0
    assert whitening.components_of(frame_of(spark, ODD[:5])).count() == 0
    assert whitening.components_of(frame_of(spark, [(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)])).count() == 0
    flat = whitening.components_of(frame_of(spark, [(i, [i / 64, 2 * i / 64, 0.0], 0) for i in range(5)])).collect()
    assert {r.component for r in flat} == {1} and all(abs(r.explained - 1) < 1e-12 for r in flat)
    many = whitening.components_of(frame_of(spark, [(i, np.random.default_rng(i).normal(size=20), 0) for i in range(60)]))
    assert many.count() == 60 * whitening.KEPT


def test_deviations_stay_exact_beyond_doubles():
    model = whitening.Whitener(3_000_000, np.array([10, 20]), np.array([1, 2_999_999]), np.ones(0), np.zeros((2, 0)), 1.0)
    x = np.array([[10 + 700, 20 - 11], [1 << 40, 0]])
    exact = [sum((3_000_000 * (a - w) - r) ** 2 for a, w, r in zip(row, (10, 20), (1, 2_999_999), strict=True)) for row in x.tolist()]
    assert model.deviations(x) == [exact[0], None] and model.deviations(x[:1]) == exact[:1]


# ---- hard negatives ----


def test_planes_add_up():
    x = np.array([[-256, 255, 0], [1, -1, 100]])
    assert np.array_equal(sum(w * p.astype(int) for w, _, p in negatives.planes_of(x)), x)
    assert len(negatives.planes_of(x)) == 9 and len(negatives.planes_of(np.array([[0, 0]]))) == 1
    assert all(rest == sum(w for w, _, _ in negatives.planes_of(x)[i + 1 :]) for i, (_, rest, _) in enumerate(negatives.planes_of(x)))


def brute_negatives(rows):
    """Every anchor against every other row, as stated."""
    use = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, lab in rows]
    out = []
    for k, (i, lab, x) in enumerate(use):
        if i % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), j, m) for h, (j, m, y) in enumerate(use) if h != k]
        for s, j, _ in sorted(t for t in scored if t[2] == lab)[:5]:
            near = [t for t in sorted(scored) if t[2] != lab and 50 * -s <= 100 * -t[0] <= 95 * -s]
            out += [(i, j, r, t[1], -s, -t[0]) for r, t in enumerate(near[:3], 1)]
    return Counter(out)


@pytest.mark.parametrize(("cells", "pairs"), [(1 << 21, 1 << 20), (256, 64)])
def test_negatives_match_brute_force(spark, monkeypatch, cells, pairs):
    monkeypatch.setattr(negatives, "CELLS", cells)
    monkeypatch.setattr(negatives, "PAIRS", pairs)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(320, 8)).astype(np.float32) * 0.4
    x[100:140] = x[100]  # ties
    x[140:150] = 0
    labels = np.where(rng.random(320) < 0.4, 1, rng.integers(0, 10, 320))
    rows = [(int(i), x[i], int(labels[i])) for i in range(320)]
    rows += [rows[50], rows[50], rows[30], (50, x[51], int(labels[50]))]  # repeated rows, and an id with two vectors
    odd = [(950, None, 1), (1000, [None] + [1.0] * 7, 1), (1050, [float("nan")] * 8, 2), (1100, [1.0] * 8, None), (None, x[3], 1), (1150, [1.0] * 3, 1), (1200, [1e30] * 8, 1)]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(frame_of(spark, rows + odd), F.col("vec_id") % 50 == 0, label).collect()
    assert Counter(tuple(r) for r in got) == brute_negatives(rows)
    assert len(got) > 60


def test_wide_components_stay_exact():
    rng = np.random.default_rng(4)
    a, x = rng.integers(-(1 << 23), 1 << 23, (5, 64)), rng.integers(-(1 << 23), 1 << 23, (300, 64))
    owner, row, score = negatives.qualifying(a, negatives.planes_of(x), np.zeros((5, 300), bool), 3)
    exact = a @ x.T
    assert np.array_equal(score, exact[owner, row])
    for i in range(5):
        best = np.argsort(-exact[i], kind="stable")[:3]
        assert set(best) <= set(row[owner == i]) and (owner == i).sum() < 20


def test_windows_round_to_the_inside():
    score = np.array([-10, 0, 1, 2, 7, 100])
    for (low, high), s in zip(negatives.window_of(score, 50, 95).tolist(), score.tolist(), strict=True):
        assert [n for n in range(-300, 300) if low <= n <= high] == [n for n in range(-300, 300) if 50 * s <= 100 * n <= 95 * s]


def test_negatives_of_nothing_and_one_label(spark):
    frame = frame_of(spark, [(i, [0.5, 0.1 * i], 1) for i in range(0, 200, 10)])
    assert negatives.mine(frame, F.col("vec_id") % 50 == 0, F.col("label")).count() == 0
    assert negatives.mine(frame.where("false"), F.col("vec_id") % 50 == 0, F.col("label")).count() == 0
    assert negatives.mine(frame_of(spark, ODD), F.col("vec_id") % 50 == 0, F.col("label")).count() == 0


# ---- quality rules ----


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_counts_match_brute_force():
    rng = np.random.default_rng(5)
    texts = ["", " \n\t", "one", "a\u00a0b c\u2003d\x1ce", "x y\n\nx y\n \n \nx y ", "# * $%&| <>", "w " * 40, "A BC d.\r\nA BC d.\r\n"]
    for n in (7, 8, 9, 15, 16, 17, 60, 400):
        texts += [" ".join(rng.choice(list("abc"), n)) for _ in range(20)] + ["\n".join(rng.choice(["a b c d e", "f g h i", ""], n)) for _ in range(5)]
    for text in texts:
        assert outliers.counts_of(text)[:5] == brute_counts(text), text


def test_chi_square_law():
    assert abs(outliers.chi_square(2.0, 2) - (1 - np.exp(-1))) < 1e-14
    assert abs(outliers.quantile(0.975, 8) - 17.5345461394) < 1e-8
    assert abs(outliers.chi_square(outliers.quantile(1 - 1e-9, 8), 8) - (1 - 1e-9)) < 1e-12
    normal = np.random.default_rng(6).normal(size=(200_000, 3))
    inner = normal[(normal**2).sum(axis=1) <= outliers.quantile(0.75, 3)]
    assert np.allclose(np.cov(inner.T) * outliers.correction(0.75, 3), np.eye(3), atol=0.03)


def plain_mcd(z, floor, core):
    """The same estimate with arrays: three starts, concentration steps to the smallest determinant, and reweighting."""
    p = z.shape[1]
    middle = np.median(z, axis=0)
    spread = np.maximum(1.4826 * np.median(np.abs(z - middle), axis=0), floor)
    u = (z - middle) / spread
    shapes = [np.eye(p)]
    for v in (np.tanh(u), u / np.linalg.norm(u, axis=1, keepdims=True)):
        c = np.cov(v.T, bias=True) + 1e-3 * np.eye(p)
        shapes.append(c / np.sqrt(np.outer(np.diag(c), np.diag(c))))
    away = lambda m, c: np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m)
    best = []
    for shape in shapes:
        m, c, last = middle, shape * np.outer(spread, spread), np.inf
        for _ in range(100):
            core_rows = z[np.argsort(away(m, c), kind="stable")[: int(np.ceil(core * len(z)))]]
            new = core_rows.mean(axis=0), np.cov(core_rows.T, bias=True) + np.diag(np.square(floor))
            if np.linalg.slogdet(new[1])[1] >= last - 1e-9:
                break
            (m, c), last = new, np.linalg.slogdet(new[1])[1]
        best.append((last, m, c))
    _, m, c = min(best, key=lambda b: b[0])
    inner = z[away(m, c) / outliers.correction(core, p) <= outliers.quantile(0.975, p)]
    return inner.mean(axis=0), np.cov(inner.T, bias=True) * outliers.correction(0.975, p) + np.diag(np.square(floor))


def test_estimates_match_arrays_and_resist_outliers(spark):
    rng = np.random.default_rng(7)
    groups = {}
    for g in range(3):
        a = rng.normal(size=(3, 3))
        z = rng.normal(size=(600, 3)) @ a + g
        z[:120] = rng.normal(size=(120, 3)) * 0.2 + 30 * (g + 1)  # a fifth lies far off, together
        groups[f"g{g}"] = (z, a)
    floor = (0.05, 0.05, 0.05)
    frame = spark.createDataFrame([(k, *map(float, r)) for k, (z, _) in groups.items() for r in z], "key string, a double, b double, c double")
    got = {r.key: r for r in outliers.minimum_determinant(frame, floor).collect()}
    i, j = np.triu_indices(3)
    for k, (z, a) in groups.items():
        mean, cover = plain_mcd(z, floor, outliers.CORE)
        inverse = np.zeros((3, 3))
        inverse[i, j] = inverse[j, i] = got[k].inverse
        ours = np.linalg.inv(inverse)
        assert np.allclose(got[k].mean, mean, atol=0.02 * np.sqrt(np.diag(cover)).max())
        assert np.allclose(ours, cover, atol=0.05 * np.diag(cover).max())
        assert np.allclose(ours, a.T @ a, atol=0.25 * np.diag(a.T @ a).max())
        away = np.einsum("ij,jk,ik->i", z - got[k].mean, inverse, z - got[k].mean)
        assert (away[:120] > outliers.quantile(1 - 1e-9, 3)).all() and (away[120:] > outliers.quantile(1 - 1e-9, 3)).sum() == 0


def prose(rng, n):
    syllables = "the ing and ver st ou er le an re to mar con ly".split()
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) + ("." if rng.random() < 0.12 else "") for _ in range(n))


def test_junk_is_rejected_by_language_and_source(spark):
    rng = np.random.default_rng(8)
    rows = [(i, prose(rng, int(rng.integers(30, 300))), ("en", "de", None)[i % 3], f"s{i % 2}", "clash") for i in range(750)]
    junk = [(1000 + i, " ".join(w + "***" for w in prose(rng, 80).split()), "en", "s0", "clash") for i in range(20)]
    junk += [(1100 + i, prose(rng, 80).upper(), "de", "s1", "clash") for i in range(20)]
    junk += [(1200, prose(rng, 19), "en", "s0", "clash"), (1201, None, "en", "s0", "clash"), (1202, "one two " * 30, None, "s1", "clash"), (1203, "", None, None, "clash")]
    rare = [(1300 + i, prose(rng, 100), "fr", None, "clash") for i in range(5)] + [(1400, prose(rng, 100).replace(" ", "%% "), "fr", "s9", "clash")]
    copies = [(2000 + i, *rows[0][1:]) for i in range(400)]  # most of a group are copies of one text
    frame = spark.createDataFrame(rows + junk + rare + copies, "doc_id long, text string, lang string, source string, level string")
    got = {r.doc_id: r for r in outliers.judged(outliers.counted(frame)).collect()}
    assert len(got) == len(rows + junk + rare + copies)
    assert [i for i in got if i < 1000 and not got[i].kept] == []
    assert all(not got[r[0]].kept for r in junk) and not got[1400].kept
    assert all(got[r[0]].kept for r in rare[:5] + copies)
    assert {got[i].level for i in (0, 1, 2, 1000, 1100)} == {"lang source"} and got[1300].level == got[1400].level == "all"
    assert got[1201].level == "lang source" and got[1201].distance is None
    for r in rows[:5]:
        assert tuple(got[r[0]])[3:8] == brute_counts(r[1])
    few = outliers.judged(outliers.counted(frame.where("doc_id < 30"))).collect()
    assert all(r.kept and r.level is None for r in few) and len(few) == 30
    assert outliers.judged(outliers.counted(frame.where("false"))).count() == 0


# ---- cases of earlier operators ----


def test_neighbours_of_often_repeated_ids_and_clashing_columns(spark):
    from pricewright.llm import neighbours

    rng = np.random.default_rng(9)
    centre = rng.normal(size=(45, 6))
    rows = [(int(i), [float(c) for c in centre[i] + 0.01 * rng.normal(size=6)], "x", 1, 2.0, 3) for i in range(45) for _ in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string, shard int, score double, rank int")
    best: dict[tuple[int, int], float] = {}
    x = np.array([r[1] for r in rows])
    ids = np.array([r[0] for r in rows])
    for q in (0, 20, 40):
        scores = x[ids == q] @ x.T
        for j in range(45):
            if j != q:
                best[q, j] = scores[:, ids == j].max()
    found: dict[int, set] = {}
    for r in neighbours.search(frame, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score <= best[r.query_id, r.vec_id] + 1e-9
    assert set(found) == {0, 20, 40} and all(len(f) == 20 and q not in f for q, f in found.items())
    hits = [len(f & set(sorted(set(range(45)) - {q}, key=lambda j: -best[q, j])[:20])) for q, f in found.items()]
    assert sum(hits) >= 0.9 * 60


def test_conversations_with_clashing_columns(spark):
    from pricewright.llm import chat

    rows = [(1, 0, "user", "hi", "r", "f", 1), (1, 1, "assistant", "yo", "r", "f", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string, formatted string, turns int")
    got = chat.read_back(chat.formatted(chat.canonical(chat.records_from_rows(frame)))).collect()
    assert [[tuple(t) for t in r.read_turns] for r in got] == [[("user", "hi"), ("assistant", "yo")]] and got[0].loss_text == "yo"


def test_vector_operators_ignore_clashing_columns(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], i % 2, "a", "b", 1, 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, place string, x string, block int, n int")
    plain = frame.select("vec_id", "embedding", "label")
    named = lambda found: sorted(map(str, found.collect()))
    mined = [named(negatives.mine(f, F.col("vec_id") % 50 == 0, F.col("label"))) for f in (frame, plain)]
    assert mined[0] == mined[1] and mined[0]
    assert whitening.components_of(frame).count() == whitening.components_of(plain).count() > 0
