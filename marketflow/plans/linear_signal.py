"""Linear-signal flow: typed load -> derived columns -> EWM fill -> drop nulls ->
z-score -> elastic net with contiguous 10-fold CV -> clipped position signal.

Every step is a DataFrame function; the fitted state is a ``ScalerParams``
and a ``LinearModel`` (small, frozen). Batch scoring (MOD12) reuses the very
same feature function as the fit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.functions.scalar import SignalParams, ret_to_signal, u1, u2
from marketflow.operators import joins, schema, series
from marketflow.operators.linear import PenaltyGrid, LinearModel, fit_linear
from marketflow.operators.scale import ScalerParams, apply_scaler, fit_scaler
from marketflow.plans.materialize import materialize

# Model inputs in model order, EWM centre of mass, CV folds.
MODEL_VARS = ["S2", "E2", "E3", "P9", "S1", "S5", "I2", "P8", "P10", "P12", "P13", "U1", "U2"]
EWM_COM = 0.5
CV_FOLDS = 10


@dataclass(frozen=True)
class FeatureSet:
    """Model inputs as data: the plan below is built from this, for the fit and for scoring alike."""

    id_col: str
    target: str
    inputs: tuple[str, ...]
    derived: dict = field(default_factory=dict)   # name -> function that gives a Column
    sources: tuple[str, ...] = ()                 # raw columns that derived inputs need
    fill_com: float | None = None                 # EWM fill (carry) of the inputs; None leaves nulls

    @property
    def raw(self) -> list[str]:
        """Columns a table must bring."""
        return [self.id_col, self.target, *[c for c in self.inputs if c not in self.derived], *self.sources]

    def rows(self, df: DataFrame, series_col: str | None = None) -> DataFrame:
        """Complete model rows (ids, target, inputs). ``series_col`` fills each of its series by itself."""
        have = [c for c in (series_col, self.id_col, self.target) if c]
        shaped = df.withColumns({name: make() for name, make in self.derived.items()}).select(*dict.fromkeys(have), *self.inputs)
        if self.fill_com is not None:
            shaped = series.ewm(shaped, list(self.inputs), self.id_col, series_col, com=self.fill_com, null_mode="carry", fill=True)
        return schema.drop_nulls(shaped, [self.id_col, self.target, *self.inputs])


# U1 and U2 are derived from I1, I7, I9, M11 (PRJ5, PRJ6).
FEATURES = FeatureSet("date_id", "target", tuple(MODEL_VARS), {"U1": u1, "U2": u2}, ("I1", "I7", "I9", "M11"), EWM_COM)


@dataclass(frozen=True)
class FittedLinear:
    scaler: ScalerParams
    model: LinearModel
    features: tuple[str, ...]


def fit(train_ids: DataFrame, data: DataFrame, params: PenaltyGrid | None = None) -> tuple:
    """JOIN1 re-split by id, MOD1 scaler on train, WIN5 folds, MOD2+MOD3."""
    train = materialize(joins.semi_join(data, train_ids.select("date_id"), "date_id"))
    scaler = fit_scaler(train, MODEL_VARS)
    xt = apply_scaler(train, scaler)
    xt = series.add_position(xt, "date_id")
    xt = materialize(series.add_folds(xt, "contiguous", CV_FOLDS))
    model = fit_linear(xt, MODEL_VARS, "target", "fold", params)
    return FittedLinear(scaler, model, tuple(MODEL_VARS)), xt


def score(df: DataFrame, fitted: FittedLinear, signal: SignalParams = SignalParams()) -> DataFrame:
    """MOD1 apply, MOD4 linear score, MOD5 signal."""
    x = apply_scaler(df, fitted.scaler)
    pred = fitted.model.predict()
    return x.select("date_id", pred.alias("raw_pred"), ret_to_signal(pred, signal).alias("signal"))


def predict_batches(test: DataFrame, fitted: FittedLinear, history: DataFrame | None = None,
                    signal: SignalParams = SignalParams()) -> DataFrame:
    """MOD12 / FLT8: one prediction per batch (``date_id``).

    Without ``history`` every batch is featurised on its own, as the reference
    does (a null with no history drops the row and the batch gets NULL).
    With ``history`` (earlier rows, same columns) the EWM fill sees the past.
    """
    t = test.withColumn("_batch", F.col("date_id")).withColumn("_hist", F.lit(False))
    if history is None:
        feats = FEATURES.rows(t, "_batch")
    else:
        past = joins.anti_join(history.select(*FEATURES.raw), test.select("date_id"), "date_id")
        feats = FEATURES.rows(test.select(*FEATURES.raw).unionByName(past))
        feats = joins.semi_join(feats, test.select("date_id"), "date_id").withColumn("_batch", F.col("date_id"))
    scored = score(feats, fitted, signal).withColumn("_batch", F.col("date_id"))
    # first row of the batch gives both outputs in one grouping; a batch with no surviving row -> NULL
    first = scored.groupBy("_batch").agg(F.min_by(F.struct("raw_pred", F.col("signal").alias("prediction")), "date_id").alias("f"))
    ids = test.select(F.col("date_id").alias("_batch")).distinct()
    return ids.join(first, "_batch", "left").select(F.col("_batch").alias("date_id"), "f.raw_pred", "f.prediction")
