"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from regionlytics.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p).split('.')[0]} as select * from '{p}'")
    return c


def rounded(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(rounded, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", [n for n in NAMES if n in registry.oracle_sql()])
def test_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(rounded(r[c]) for c in cols) for r in df.collect()), key=repr)
    got = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert ours == sorted((tuple(rounded(r[i]) for i in at) for r in got.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["quantile_features", "power_features", "train_test_split", "simulate_corpus", "poisson_irls"])
def test_runs_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_interval_joins_are_equi_joins(spark):
    for name in ("snv_window_histogram", "interval_overlap_join", "interval_anti_join", "interval_coverage_count"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_model_queries_run_until_settled_with_the_operators_defaults(spark, monkeypatch):
    from regionlytics.model import trainer
    from regionlytics.plans import model_queries as mq

    seen = []
    monkeypatch.setattr(trainer, "train", lambda c, transform, o: seen.append(o))
    monkeypatch.setattr(trainer, "signatures", lambda *a: None)
    monkeypatch.setattr(mq.posterior, "assign", lambda *a, **k: seen.append((len(a), k)))
    for name in ("em_train", "em_train_gbt", "gibbs_posterior"):
        registry.queries()[name](spark, SF)
    assert seen == [trainer.Options(k=3, **mq.SETTLED), trainer.Options(k=3, model_type="gbt", **mq.SETTLED), trainer.Options(k=3, **mq.SETTLED), (2, {})]
