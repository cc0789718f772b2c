"""Agreement between predictions and labels, and the gates built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.operators.ranks import compare_groups


def with_index(df: DataFrame, index: str, position: str) -> DataFrame:
    """Explicit index where given, else the list position."""
    return df.withColumn("_i", F.coalesce(F.col(index), F.col(position)))


def confusion(df: DataFrame, pred: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(pred).alias("pred"), F.col(label).alias("label")).agg(
        F.count("*").alias("n")
    )


def kappa(
    df: DataFrame, pred: str, label: str, keys: Sequence[str] = (), *, degenerate: float | None = 1.0
) -> DataFrame:
    """Accuracy and Cohen's kappa from confusion counts.

    ``degenerate`` is the kappa reported when the expected agreement is 1 (1.0 or NULL).
    """
    keys = list(keys)
    conf = confusion(df, pred, label, keys)
    sides = conf.select(*keys, F.col("pred").alias("cls"), F.col("n").alias("r"), F.lit(0).alias("c")).unionByName(
        conf.select(*keys, F.col("label").alias("cls"), F.lit(0).alias("r"), F.col("n").alias("c"))
    )
    marg = sides.groupBy(*keys, "cls").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    pe = marg.groupBy(*keys).agg(
        F.sum("r").alias("n"),
        F.sum(F.col("r").cast("double") * F.col("c").cast("double")).alias("_rc"),
    )
    po = conf.groupBy(*keys).agg(F.sum(F.when(F.col("pred") == F.col("label"), F.col("n")).otherwise(0)).alias("_hit"))
    s = pe.join(po, keys) if keys else pe.join(F.broadcast(po), F.lit(True))
    n = F.col("n").cast("double")
    e = F.col("_rc") / (n * n)
    acc = F.col("_hit") / n
    return s.select(
        *keys, "n", acc.alias("accuracy"),
        F.when(e < 1.0, (acc - e) / (1.0 - e)).otherwise(F.lit(degenerate)).cast("double").alias("kappa"),
    )


def numeric_agreement(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Exact and within-one shares; a missing count is 0."""
    x, y = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.count_if(x == y) / F.count("*")).alias("exact"),
        (F.count_if(F.abs(x - y) <= 1) / F.count("*")).alias("within1"),
    )


def class_scores(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Precision and recall per class of the closed vocabulary."""
    conf = confusion(df, pred, label)
    sides = conf.select(
        F.explode(
            F.array(
                F.struct(F.col("pred").alias("cls"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("h"),
                         F.when(F.col("pred") == F.col("label"), F.col("n")).otherwise(0).alias("tp")),
                F.struct(F.col("label").alias("cls"), F.lit(0).cast("bigint").alias("p"), F.col("n").alias("h"),
                         F.lit(0).cast("bigint").alias("tp")),
            )
        ).alias("x")
    ).select("x.*")
    s = sides.groupBy("cls").agg(
        F.sum("p").alias("n_pred"), F.sum("h").alias("n_human"), F.sum("tp").alias("tp")
    )
    return s.select(
        "cls", "n_pred", "n_human",
        F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).alias("precision"),
        F.when(F.col("n_human") > 0, F.col("tp") / F.col("n_human")).alias("recall"),
    )


# Label gate and grade limits.
GATE = {"min_agreement": 0.75, "min_kappa": 0.60}


def label_gate(df: DataFrame, pred: str, label: str) -> DataFrame:
    """One row: agreement, kappa and whether both limits are met."""
    s = kappa(df, pred, label, degenerate=None)
    return s.withColumn(
        "passed",
        (F.col("accuracy") >= GATE["min_agreement"])
        & (F.coalesce("kappa", F.lit(0.0)) >= GATE["min_kappa"]),
    )


def grade(kappa_col: str = "kappa"):
    k = F.col(kappa_col)
    return F.when(k >= 0.6, "good").when(k >= 0.4, "fair").otherwise("weak")


def grade_rho(rho_col: str = "rho"):
    r = F.col(rho_col)
    return F.when(r >= 0.7, "good").when(r >= 0.5, "fair").otherwise("weak")


CLASSES = ("static", "camera_motion", "subject_motion")


def ordered_classes(rows: DataFrame, label: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Does the static class lie below both moving classes?

    ``value`` per label is compared pairwise (U, delta, p); an unknown label is an error. With
    ``keys`` (frame rate, threshold …) every parameter cell is judged on its own.
    """
    checked = F.when(F.col(label).isin(*CLASSES), F.col(label)).otherwise(
        F.raise_error(F.concat(F.lit("unknown motion label: "), F.coalesce(F.col(label), F.lit("null"))))
    )
    long = rows.select(*keys, checked.alias("group"), F.lit("value").alias("feature"), F.col(value).cast("double").alias("value"))
    pairs = [(CLASSES[0], CLASSES[1]), (CLASSES[0], CLASSES[2]), (CLASSES[1], CLASSES[2])]
    out = None
    for a, b in pairs:
        s = compare_groups(long, first=a, second=b, keys=keys, min_n=1).select(
            *keys, F.lit(a).alias("first"), F.lit(b).alias("second"), "n_top", "n_bot",
            "med_top", "med_bot", "u", "delta", "p",
        )
        out = s if out is None else out.unionByName(s)
    return out


def ordering_verdict(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    static = F.when((F.col("first") == CLASSES[0]), F.col("med_top") < F.col("med_bot"))
    return pairs.groupBy(*keys).agg(F.coalesce(F.bool_and(static), F.lit(False)).alias("ordering_ok"))
