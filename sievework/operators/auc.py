"""Area under the ROC curve, one class against the rest, averaged over classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import running


def roc_auc_ovr(
    df: DataFrame,
    label: str,
    scores: Mapping[Any, str],
    direct_rows: int = running.DIRECT_ROWS,
    by: Sequence[str] = (),
) -> DataFrame:
    """``roc_auc`` of all rows, or of every run named by the ``by`` columns in the same jobs. ``scores`` names the
    score column of each class.

    Per class it is the share of (positive, negative) pairs ranked rightly, equal scores counting
    half. Two classes: only the second one's score is used. NULL when a class has no positive or
    no negative rows, a label has no score column, or any score is missing (NULL or NaN).
    """
    classes = sorted(scores)
    asked = classes if len(classes) != 2 else classes[1:]
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("c"),
                F.col(scores[c]).cast("double").alias("score"),
                (F.col(label) == F.lit(c)).cast("long").alias("pos"),
            )
            for i, c in enumerate(asked)
        ]
    )
    known = F.col(label).isin(classes)
    usable = reduce(and_, [~F.isnan(x := F.col(scores[c]).cast("double")) & x.isNotNull() for c in asked])
    bad = F.count_if(~known | F.col(label).isNull() | ~usable).alias("unknown")
    n_rows = df.count()
    # Equal scores are merged first, map-side: a score shared by many rows is one row after this.
    steps = (
        df.select(*by, F.inline(cells))
        .groupBy(*by, "c", "score")
        .agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
    )
    ranked = running.total_before(
        steps, [*by, "c"], "score", "neg", "below", n_rows * len(asked), direct_rows
    )
    won = F.sum(F.col("pos").cast("double") * (F.col("below") + F.col("neg") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    per_class = ranked.groupBy(*by, "c").agg(F.try_divide(won, pairs).alias("auc"))
    # One row per run: a run with a bad row has no area.
    facts = df.groupBy(*by).agg(bad)
    found = per_class.groupBy(*by).agg(F.count("auc").alias("n"), F.avg("auc").alias("mean"))
    joined = found.join(facts, list(by)) if by else found.withColumn("unknown", F.lit(facts.first()["unknown"]))
    whole = (F.col("n") == F.lit(len(asked))) & (F.col("unknown") == 0)
    return joined.select(*by, F.when(whole, F.col("mean")).alias("roc_auc"))
