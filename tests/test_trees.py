"""Boosted trees: prefix property, cutting, early stopping, and one fold end to end."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from marketflow.operators import trees


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(i=np.arange(400), y=x[:, 0] * 2 + x[:, 1] ** 2 + rng.normal(size=400) * 0.3)
    df = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(spark.createDataFrame(pdf))
    return df.withColumn("_y", F.col("y")).cache()


def test_shorter_fit_is_a_prefix_and_cut_equals_it(rows):
    cfg = trees.TreeConfig("t", max_depth=3, subsampling_rate=0.8, feature_subset="0.8")
    short, long = trees._gbt(cfg, 4).fit(rows), trees._gbt(cfg, 9).fit(rows)
    assert [t.toDebugString.split("\n", 1)[1] for t in short.trees] == [t.toDebugString.split("\n", 1)[1] for t in long.trees[:4]]
    cut = trees.first_trees(long, 4)
    a, b = ([r["_p"] for r in m.transform(rows).orderBy("i").collect()] for m in (short, cut))
    assert a == b and cut.getNumTrees == 4


def test_patience():
    assert trees.stop_at([3.0, 2.0, 1.0, 1.5, 1.2], 2) == (2, 4)
    assert trees.stop_at([3.0, 2.0, 1.0], 5) == (2, 2)


def test_grow_stops_at_the_patience(rows, monkeypatch):
    monkeypatch.setattr(trees, "FIRST_STEP", 4)
    cfg = trees.TreeConfig("t", max_depth=4, step_size=1.0)
    train, valid = rows.where("i % 2 = 0"), rows.where("i % 2 = 1")
    model, losses, best, last = trees.grow(train, valid, cfg, max_rounds=64, patience=3)
    assert last - best == 3 and len(losses) > last and best == int(np.argmin(losses[:last + 1]))
    assert trees.grow(train, valid, cfg, max_rounds=2, patience=3)[3] == 1


def test_fold_scores_and_history(spark, rows):
    data = rows.drop("features", "_y").withColumn("fold", F.when(F.col("i") < 300, 0).otherwise(1))
    cfgs = (trees.TreeConfig("best", max_depth=3, step_size=0.5), trees.TreeConfig("all", max_depth=3, step_size=0.5, predict_at_best=False))
    scores, hist = trees.fit_ensemble(data, data.where("i < 10"), list("abcd"), "y", "i", n_folds=1, learners=cfgs, max_rounds=12, patience=4)
    got = {(r["model"], r["split"]): r["count"] for r in scores.groupBy("model", "split").count().collect()}
    assert got == {(m, s): n for m in ("best", "all") for s, n in (("valid", 100), ("test", 10))}
    err = scores.where("split = 'valid'").join(data, "i").groupBy("model").agg(F.sqrt(F.avg((F.col("pred") - F.col("y")) ** 2)).alias("e"))
    last = {(r["model"], r["iteration"]): r["rmse"] for r in hist.where("split = 'valid'").collect()}
    for r in err.collect():
        mine = [v for (m, _), v in sorted(last.items()) if m == r["model"]]
        assert abs(r["e"] - (min(mine) if r["model"] == "best" else mine[-1])) < 1e-9
