"""Every query with SQL gives the same rows as DuckDB."""

import os
from dataclasses import replace

import duckdb
import numpy as np
import pytest

from corvane.operators import grid
from corvane.plans import catalog, workloads


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return value


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, con, data, name):
    df = catalog.Q[name](spark, data)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    cur = con.execute(catalog.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in sorted(cols)]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, float) for x in a) else [x if not isinstance(x, float) else pytest.approx(x, abs=2e-5) for x in b] == list(a)


@pytest.mark.parametrize("name", sorted(n for n in set(catalog.Q) - set(catalog.SQL) if not n.startswith("workload_")))
def test_runs(spark, data, name, short):
    assert catalog.Q[name](spark, data).limit(3).count() > 0


@pytest.fixture
def short(monkeypatch):
    """Learned fits of a few steps, so that all workloads can be run; everything else is as registered."""
    train = grid._train
    few = {"epochs": 1, "steps": 3, "batch": 32}
    monkeypatch.setattr(grid, "_train", lambda samples, near, jobs: train(samples, near, [replace(j, over=tuple((dict(j.over) | few).items())) for j in jobs]))


#: Rows of each workload: methods by dimensions, seeds, metrics, sets.
ROWS = {
    "sts_testonly": 13, "sts_baselines": 6, "abtt_table": 16, "quora_main": 9, "cqadupstack": 3 * 8 + 6, "sts_suite": 6 * 8 + 6, "prompt_sources": 5 * 4 + 4, "pooling_variants": 12,
    "echo_whitening": 7, "cross_dataset": 10, "positive_search": 5, "mined_precision_spaces": 6, "neighbor_scores_spaces": 3, "regularizer_audit": 42, "anisotropy_table": 3, "component_ablation": 12,
}


@pytest.mark.parametrize("name", sorted(workloads.WORKLOADS))
def test_workload(spark, data, con, name, short):
    rows = [r.asDict() for r in workloads.WORKLOADS[name](spark, data).collect()]
    assert len(rows) == ROWS[name] if name in ROWS else len(rows) in (15, 18)
    for r in rows:
        assert all(np.isfinite(v) and abs(v) <= 100.1 for k, v in r.items() if k in ("metric_value", "mean", "transfer", "precision", "recall"))
    base = [r for r in rows if r.get("method") == "base" and "metric_value" in r]
    one = lambda q: con.execute(catalog.SQL[q]).fetchall()
    if name in ("sts_testonly", "sts_baselines", "abtt_table"):
        assert [r["metric_value"] for r in base if r["metric_name"] == "spearman"] == [pytest.approx(one("spearman_pairs")[0][0], abs=2e-3)]
    if name in ("abtt_table", "quora_main"):
        assert [r["metric_value"] for r in base if r["metric_name"] == "ndcg10"] == [pytest.approx(one("ndcg10")[0][0], abs=2e-3)]
    key = {"prompt_sources": ("prompt_source_scores", lambda r: r["embedding_type"]), "pooling_variants": ("pooling_scores", lambda r: r["pooling"]), "layer_selection": ("layer_scores", lambda r: f"{r['layer_name']}/{r['pooling']}")}.get(name)
    if key:
        got = {key[1](r): r["metric_value"] for r in base if r.get("metric_name") in (None, "spearman")}
        assert got == {k: pytest.approx(v, abs=2e-3) for k, v in one(key[0])} and len(set(got.values())) > 1
    if name == "layer_selection":
        best = [r for r in rows if r["method"] == "best"]
        assert [r["metric_value"] for r in best] == [max(r["metric_value"] for r in base)]
    if name in ("cqadupstack", "sts_suite"):
        for r in rows:
            if r["dataset"] == "average":
                same = [x["metric_value"] for x in rows if x["dataset"] != "average" and (x["method"], x["r"]) == (r["method"], r["r"])]
                assert r["metric_value"] == pytest.approx(sum(same) / len(same), abs=1e-4)
    if name == "component_ablation":
        assert {"r"} < {"r", *rows[0]} and set(rows[0]) == {"method", "8", "16"}
    if name == "anisotropy_table":
        raw = next(r for r in rows if r["method"] == "base")
        assert (raw["anisotropy_mean"], raw["self_sim"]) == (pytest.approx(one("anisotropy_mean")[0][0], abs=2e-6), pytest.approx(one("self_similarity_seeded")[0][0], abs=2e-6))
    if name == "mined_precision_spaces":
        raw = next(r for r in rows if r["space"] == "raw" and r["dataset"] == "search")
        cols = [c[0] for c in con.execute(catalog.SQL["prec_recall_hit"]).description]
        want = dict(zip(cols, one("prec_recall_hit")[0], strict=True))
        assert all(raw[c] == pytest.approx(want[c], abs=1e-4) for c in ("precision", "recall", "hit_rate", "n"))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
