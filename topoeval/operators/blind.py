"""Blind sequential evaluation: predict with what is known, reveal, extend what is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoeval.functions.scalars import table_fingerprint
from topoeval.operators.evaluate import binary_metrics
from topoeval.operators.models import ensemble_predict
from topoeval.operators.summaries import append_knowledge, assert_disjoint_keys, checked_join

ID = "graph_id"


def minimal_knowledge(df: DataFrame, metrics: Sequence[str], gain: str, id_col: str = ID) -> DataFrame:
    """id, metrics, gain_pp, success (strictly more than 0.5 points)."""
    return df.select(id_col, *metrics, (100 * F.col(gain)).alias("gain_pp"), (100 * F.col(gain) > 0.5).cast("int").alias("success"))


def blind_predict(knowledge: DataFrame, wave: DataFrame, metrics: Sequence[str], id_col: str = ID, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Predictions for a wave whose outcomes are not known (id, p, predicted, n_known, predicted_at) and their fingerprint.

    The wave may hold no outcome column and no id that is known.
    """
    if bad := {"success", "gain_pp"} & set(wave.columns):
        raise ValueError(f"the wave holds outcomes: {sorted(bad)}")
    assert_disjoint_keys(wave, knowledge, [id_col])
    p, _ = ensemble_predict(knowledge, wave, metrics, "success", [id_col], seed)
    n = knowledge.count()
    out = p.select(
        id_col, F.round("p", 9).alias("p"), (F.col("p") >= 0.5).cast("int").alias("predicted"), F.lit(n).alias("n_known"), F.current_timestamp().alias("predicted_at")
    )
    return out, table_fingerprint(out, id_col, "p", "predicted")


def blind_reveal(predictions: DataFrame, truth: DataFrame, knowledge: DataFrame, id_col: str = ID) -> tuple[DataFrame, DataFrame]:
    """Predictions with outcomes (each id once on both sides, all must match), and the extended knowledge."""
    if not predictions.join(truth, id_col, "left_anti").isEmpty():
        raise ValueError("some predictions have no outcome")
    revealed = checked_join(predictions, truth.select(id_col, "success", "gain_pp"), [id_col])
    return revealed, append_knowledge(knowledge, truth.select(knowledge.columns), [id_col])


def blind_summary(revealed: DataFrame, wave: str = "wave") -> DataFrame:
    """Metrics with Brier score for each wave and for all (wave NULL)."""
    each = binary_metrics(revealed, "success", "p", 0.5, [wave], brier=True)
    return each.unionByName(binary_metrics(revealed, "success", "p", 0.5, [], brier=True), allowMissingColumns=True)
