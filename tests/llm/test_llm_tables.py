"""Neighbours, SQL comparisons and the pipeline against a plain version of its decisions."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricewright.llm import entries, neighbours, pii, simhash

SQL = entries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, same_as_sql):
    same_as_sql(entries.queries()[name], SQL[name])


def truth(ids, x, i, k):
    scores = (x * x[i]).sum(1)
    order = np.lexsort((ids, -scores))
    return [int(ids[j]) for j in order if ids[j] != ids[i]][:k]


def test_neighbours_recall_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(30, 16))
    x = centers[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.4
    x[500:900] = x[500]
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    odd = [(9000, None, 0), (9020, [0.0] * 16, 0), (9040, [float("nan")] * 16, 0), (9060, [1.0, None] * 8, 0), (None, rows[0][1], 0), (9080, [1.0], 0), (9100, [float("inf")] * 16, 0)]
    frame = spark.createDataFrame(rows + odd + [rows[40]], "vec_id long, embedding array<double>, rank int")
    got = neighbours.search(frame, F.col("vec_id") % 20 == 0).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(by_query) == set(range(0, 3000, 20))
    ids, hits = np.arange(3000), 0
    for q, found in by_query.items():
        assert sorted(found) == list(range(1, 21))
        near = [found[k][0] for k in range(1, 21)]
        scores = [found[k][1] for k in range(1, 21)]
        assert len(set(near)) == 20 and q not in near and scores == sorted(scores, reverse=True)
        assert np.allclose(scores, [(x[v] * x[q]).sum() for v in near])
        hits += len(set(near) & set(truth(ids, x, q, 20)))
    assert hits / (20 * len(by_query)) >= 0.9
    for found in by_query.values():
        ranked = [found[k] for k in range(1, 21)]
        assert ranked == sorted(ranked, key=lambda f: (-f[1], f[0]))


def test_neighbours_of_few_and_none(spark):
    frame = spark.createDataFrame([(20, [1.0, 2.0]), (3, [2.0, 1.0]), (7, [3.0, 0.5])], "vec_id long, embedding array<float>")
    rows = neighbours.search(frame, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(3, 4.0), (7, 4.0)]
    assert neighbours.search(frame.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_inner_products_of_uneven_norms(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 8)) * rng.exponential(1, (1500, 1))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = Counter((r.query_id, r.vec_id) for r in neighbours.search(frame, F.col("vec_id") % 20 == 0).collect())
    ids = np.arange(1500)
    expected = [(q, v) for q in range(0, 1500, 20) for v in truth(ids, x, q, 20)]
    assert sum(e in got for e in expected) / len(expected) >= 0.9


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, frames = [], [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frames[-1], folder).cache()
        assert out.columns == docs.columns
        names.append(name)
        frames.append(out)
    assert names == ["quality", "near_duplicates", "personal_data", "mixing"]
    kept = {r.doc_id: r.text for r in frames[1].collect()}
    fps = {d: simhash.fingerprint_text((t or "").encode()) for d, t in kept.items()}
    first = {}
    for d in sorted(fps):
        first.setdefault(next((f for f in first if (f ^ fps[d]).bit_count() <= 3), fps[d]), d)
    unique = {r.doc_id for r in frames[2].collect()}
    assert set(first.values()) >= unique and len(unique) >= len(kept) - len(fps) + len(set(fps.values())) - 5
    for r in frames[3].collect():
        assert not pii.base_spans(r.text or "") or re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r.text)
        assert r.n_chars == len(r.text or "")
    words = lambda frame: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in frame.collect())
    assert abs(words(frames[4]) / words(frames[3]) - 1.5) < 0.15
    copies = Counter(r.doc_id for r in frames[4].collect())
    assert max(copies.values()) <= 2
    last = corpus_pipeline.STAGES[-1][1](spark, frames[4], folder)
    assert last.where("not round_trip").count() == 0
    assert last.select("doc_id").distinct().count() == len(copies)
    assert corpus_pipeline.ORACLE_SQL is None


def test_the_whole_pipeline_runs(spark, folder, tmp_path):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, folder)
    rows = got.collect()
    assert rows and all(r.round_trip for r in rows) and {r["sample"] for r in rows} == {0, 1}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").where("false").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
