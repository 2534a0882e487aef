"""The registered walk-forward refits on its own schedule, and fits write no training rows that outlive them."""

import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from alphaframe.operators import models as MO
from alphaframe.plans import materialize
from alphaframe.plans import walk_forward as W
from alphaframe.plans.catalog import QUERIES, meta

FEATS = ["momentum_12_1_rank", "f1"]


@pytest.fixture(scope="module")
def panel(spark):
    """Six names, 300 sessions; the target follows the first feature."""
    rows = []
    for d in range(300):
        for i in range(6):
            x, z = (d * 7 + i * 31) % 101 / 101, (d * 13 + i * 17) % 89 / 89
            rows.append((date(2020, 1, 1) + timedelta(d), f"s{i}", x, z, 0.1 * (x - 0.5) + 0.01 * (z - 0.5), True, "NEUTRAL"))
    return spark.createDataFrame(rows, "date date, symbol string, momentum_12_1_rank double, f1 double, future_relative_20d double, solid_eligible boolean, regime string").cache()


def folders(spark):
    return {x for x in os.listdir(materialize.shared_folder(spark).removeprefix("file:")) if x.startswith("stage-")}


def test_registered_query_refits_every_20_sessions(spark, panel, monkeypatch):
    seen = []
    monkeypatch.setattr(meta.I, "panel", lambda *a: panel.drop("regime"))
    monkeypatch.setattr(meta.I, "widest_session", lambda *a: 6)
    monkeypatch.setattr(meta, "context", lambda *a: panel.select("date", "regime").distinct())
    monkeypatch.setattr(meta, "walk_forward_oos", lambda p, cfg: (seen.append(cfg), (p, None))[1])
    QUERIES["walk_forward_oos"](spark, "")
    assert seen == [W.WalkForward(min_names=3, universe=6)] and seen[0].refresh == 20 and len(seen[0].models) == 4


def test_fits_leave_only_their_scores(spark, panel, monkeypatch):
    before, written = folders(spark), []
    real = materialize.cut
    monkeypatch.setattr(W, "cut", lambda df: (written.append(df.columns), real(df))[1])
    cfg = W.WalkForward(min_names=3, refresh=40, features=FEATS, boosting=dict(rounds=2, depth=2, min_leaf=5))
    scored, refreshes = W.walk_forward_oos(panel, cfg)
    n = refreshes.count()
    assert n == 2 and scored.count() == 71 * 6 and scored.where("raw_score is null").count() == 0
    ensemble = [c for c in written if "_w" in c]  # rows between members, four for each of two ensembles a refresh
    assert len(ensemble) == 8 * n
    assert len(folders(spark) - before) == len(written) - len(ensemble)
    train_only = [c for c in written if "_w" not in c and set(c) == {"date", "symbol", "future_relative_20d", *FEATS}]
    assert not train_only


def test_large_fits_go_one_after_another(monkeypatch):
    import threading

    def most(rows):
        lock, now, top = threading.Lock(), [0], [0]
        gate = threading.Event()

        def fit(k):
            with lock:
                now[0] += 1
                top[0] = max(top[0], now[0])
            gate.wait(0.05)
            with lock:
                now[0] -= 1
            return k

        assert MO.at_once(fit, range(8), rows) == list(range(8))
        return top[0]

    assert most(MO.ROWS_AT_ONCE) == 1 and most(10 * MO.ROWS_AT_ONCE) == 1
    assert 1 < most(100) <= MO.FITS_AT_ONCE and most(None) <= MO.FITS_AT_ONCE


def test_rows_of_a_fit_set_its_tasks(spark, panel):
    a, _ = MO.gbt_fit_predict(panel, panel, FEATS, "future_relative_20d", "p", rounds=3, depth=2, min_leaf=5)
    b, _ = MO.gbt_fit_predict(panel.repartition(5, "date"), panel, FEATS, "future_relative_20d", "p", rounds=3, depth=2, min_leaf=5, rows=panel.count())
    x, y = ({(r["date"], r["symbol"]): r["p"] for r in df.select("date", "symbol", "p").collect()} for df in (a, b))
    assert x.keys() == y.keys() and max(abs(x[k] - y[k]) for k in x) < 1e-9


def test_together(spark):
    parts = [materialize.cut(spark.range(k).withColumn("k", F.lit(k))) for k in (0, 3, 4)]
    assert sorted(map(tuple, materialize.together(parts).collect())) == sorted((i, k) for k in (3, 4) for i in range(k))
