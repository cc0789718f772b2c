"""Principal axes of a reference corpus.

Medians, means and deviations are one aggregate row; the Gram matrix is summed from one d × d
partial per Arrow batch; only d² numbers reach the driver. Scores are ordinary column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.operators.ordered import quantiles
from cuesheet.operators.ranks import melt


@dataclass
class Axes:
    features: list[str]
    medians: list[float]
    means: list[float]
    stds: list[float]
    loadings: np.ndarray
    explained_pct: list[float]
    scale: list[float] = field(default_factory=list)

    def z(self) -> list[Column]:
        return [
            (F.coalesce(F.col(f).cast("double"), F.lit(m)) - F.lit(mu)) / F.lit(s)
            for f, m, mu, s in zip(self.features, self.medians, self.means, self.stds)
        ]

    def scores(self) -> list[Column]:
        z = self.z()
        return [
            sum((c * F.lit(float(w)) for c, w in zip(z, row)), F.lit(0.0)) for row in self.loadings
        ]

    def coverage(self) -> Column:
        n = sum((F.col(f).isNotNull().cast("int") for f in self.features), F.lit(0))
        return n / F.lit(float(len(self.features)))


def gram(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """(i, j, value) of ZᵀZ, summed from per-batch partial products."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            x = b.to_numpy(dtype=float)
            g = x.T @ x
            total = g if total is None else total + g
        if total is not None:
            d = total.shape[0]
            yield pd.DataFrame({
                "i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d), "value": total.ravel()
            })

    z = df.select(*[c.alias(f"z{i}") for i, c in enumerate(columns)])
    return z.mapInPandas(partial, "i bigint, j bigint, value double").groupBy("i", "j").agg(
        F.sum("value").alias("value")
    )


def preprocess(
    df: DataFrame, features: Sequence[str], *, min_n: int = 3, constant: str = "drop", eps: float = 0.0
) -> Axes:
    """Median imputation and population z: the numbers only. ``constant`` = drop or keep (std 1)."""
    q = quantiles(melt(df, [], features), ["feature"], "value", {"median": 0.5})
    med = {r["feature"]: r["median"] for r in q.collect()}  # one row per column
    counts = df.agg(*[F.count(f).alias(f) for f in features]).first()
    usable = [f for f in features if f in med and counts[f] >= min_n]
    filled = df.select(*[F.coalesce(F.col(f).cast("double"), F.lit(med[f])).alias(f) for f in usable])
    row = filled.agg(
        *[F.avg(f).alias(f"m_{f}") for f in usable], *[F.stddev_pop(f).alias(f"s_{f}") for f in usable]
    ).first()
    std = {f: row[f"s_{f}"] + eps for f in usable}
    if constant == "drop":
        usable = [f for f in usable if std[f] > 0]
    else:
        std = {f: s if s > 0 else 1.0 for f, s in std.items()}
    return Axes(usable, [med[f] for f in usable], [row[f"m_{f}"] for f in usable], [std[f] for f in usable],
                np.zeros((0, len(usable))), [])


def fit(
    df: DataFrame,
    features: Sequence[str],
    *,
    components: int = 3,
    min_n: int = 3,
    constant: str = "drop",
    anchor: str | None = None,
) -> Axes:
    """Fit axes on the reference only.

    Sign rule: the largest absolute loading is positive (or the loading of ``anchor``). Scores are
    scaled by the largest absolute score of the reference.
    """
    axes = preprocess(df, features, min_n=min_n, constant=constant)
    d = len(axes.features)
    if d < 3:
        raise ValueError("at least three usable, non-constant features are needed")
    g = np.zeros((d, d))
    for r in gram(df, axes.z()).collect():  # d² numbers
        g[r["i"], r["j"]] = r["value"]
    values, vectors = np.linalg.eigh((g + g.T) / 2.0)
    order = np.argsort(values)[::-1][:components]
    loadings = vectors[:, order].T.copy()
    for row in loadings:
        pivot = axes.features.index(anchor) if anchor in axes.features else int(np.argmax(np.abs(row)))
        if row[pivot] < 0:
            row *= -1
    axes.loadings = loadings
    total = values.clip(min=0).sum()
    axes.explained_pct = [round(float(values[i] / total) * 100, 2) for i in order]
    top = df.agg(*[F.max(F.abs(s)).alias(f"s{i}") for i, s in enumerate(axes.scores())]).first()
    axes.scale = [v if v else 1.0 for v in top]
    return axes


def project(df: DataFrame, axes: Axes, keep: Sequence[str], min_coverage: float = 0.6) -> DataFrame:
    """Display coordinates of any rows on the fitted axes; withheld under the coverage rule."""
    ok = axes.coverage() >= min_coverage
    return df.select(
        *keep,
        axes.coverage().alias("coverage"),
        *[F.when(ok, s).alias(f"score{i + 1}") for i, s in enumerate(axes.scores())],
        *[F.when(ok, s / F.lit(m)).alias(f"pc{i + 1}") for i, (s, m) in enumerate(zip(axes.scores(), axes.scale))],
    )


def top_loadings(axes: Axes, k: int = 5) -> list[dict]:
    out = []
    for c, row in enumerate(axes.loadings):
        ranked = sorted(zip(axes.features, row), key=lambda p: (-abs(float(p[1])), p[0]))[:k]
        out += [{"component": f"PC{c + 1}", "feature": f, "loading": round(float(w), 5)} for f, w in ranked]
    return out


def congruence(a: Axes, b: Axes) -> float:
    """Tucker congruence of the first axes over their common features."""
    common = [f for f in a.features if f in b.features]
    x = np.array([a.loadings[0][a.features.index(f)] for f in common])
    y = np.array([b.loadings[0][b.features.index(f)] for f in common])
    return float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))
