"""Batch ensemble flow: profile -> group features -> median fill -> expanding
split -> three boosted-tree learners per fold -> weighted blend -> fold
metrics -> test predictions -> score file.

Scores stay in long form (id, model, fold, split, pred) from the fits to the
score file, so the blend, the fold average and the metrics are groupBys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.functions.rowwise import EXCLUDE_COLUMNS, add_group_features, feature_groups
from marketflow.operators import evaluate, series, trees
from marketflow.operators.impute import median_fill
from marketflow.plans.materialize import materialize

# Target, split count.
TARGET = "forward_returns"
N_SPLITS = 5


def create_features(df: DataFrame) -> DataFrame:
    """ROW1-ROW6 on unfilled data, then IMP2 with the table's own medians."""
    return median_fill(add_group_features(df, feature_groups(df.columns)))


@dataclass
class EnsembleResult:
    scores: DataFrame        # long: id, model, fold, split, pred
    history: DataFrame       # SRC7
    fold_metrics: DataFrame  # AGG13
    summary: DataFrame       # AGG10
    predictions: DataFrame   # MOD10/MOD11 test scores (id, target)


def run(train: DataFrame, test: DataFrame, id_col: str = "date_id", spark=None,
        max_rounds: int = trees.MAX_ROUNDS, patience: int = trees.PATIENCE) -> EnsembleResult:
    spark = spark or train.sparkSession
    tr = create_features(train)
    te = create_features(test)  # each table uses its own medians, as the reference does
    feats = [c for c in tr.columns if c not in EXCLUDE_COLUMNS and c in te.columns]
    tr = series.add_folds(series.add_position(tr, id_col), "expanding", N_SPLITS)
    tr, te = materialize(tr), materialize(te)
    scores, hist = trees.fit_ensemble(tr, te, feats, TARGET, id_col, "fold", N_SPLITS,
                                      max_rounds=max_rounds, patience=patience)
    scores = materialize(scores)
    w = evaluate.weights_frame(spark)
    blended = evaluate.blend(scores.withColumnRenamed("pred", "p"), w, [id_col, "fold", "split"], pred="p")
    val = blended.where(F.col("split") == "valid").join(tr.select(id_col, TARGET), id_col)
    fm = evaluate.fold_metrics(val, TARGET, "blend")
    summary = evaluate.mean_metrics(fm)
    preds = evaluate.fold_average(blended.where(F.col("split") == "test"), [id_col], "blend", TARGET)
    return EnsembleResult(scores, hist, fm, summary, preds)
