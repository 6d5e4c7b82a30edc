"""Analysis of variance for any factors and covariates, from merged cross products.

Rows are added up per combination of factor levels: their number, and the sums and cross
products of covariates and response about their overall means.  A design's columns are constant
or a covariate inside such a combination, so the whole Gram matrix of a model follows
from these few rows, whatever the number of rows behind them; tables of separate parts merge by adding.
Sums of squares come from sweeping the Gram matrix column by column: a column that the
ones before it explain is left out and takes no degree of freedom, so unbalanced designs and
empty combinations need no special case.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import f_upper_tail
from ..session import attach

Term = tuple[str, ...]
ALIASED = 1e-10  # share of a column's square that the columns before it leave unexplained


def moments(df: DataFrame, y: str, factors: list[str], covariates: dict[str, Column]) -> DataFrame:
    """One row per combination of factor levels: ``n``, and sums and products of covariates and response.

    Rows with a missing value are left out.  Values are taken about their overall means, which
    are read first, so that squares do not cancel.
    """
    names = [*covariates, y]
    rows = df.select(*factors, *[c.cast("double").alias(k) for k, c in covariates.items()], F.col(y).cast("double").alias(y)).dropna()
    means = rows.agg(*[F.avg(k).alias(f"__m_{k}") for k in names])
    centred = attach(rows, means, []).select(*factors, *[(F.col(k) - F.col(f"__m_{k}")).alias(k) for k in names])
    sums = [F.sum(k).alias(f"s_{k}") for k in names]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in combinations_with_replacement(names, 2)]
    return centred.groupBy(*factors).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def merge_moments(*tables: DataFrame, factors: list[str]) -> DataFrame:
    """Moments of all rows of several tables that were taken about the same means."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    return both.groupBy(*factors).agg(*[F.sum(c).alias(c) for c in both.columns if c not in factors])


def _codes(values: pd.Series, adjusted: bool) -> np.ndarray:
    """Columns of a factor's levels but one: differences from the first, or from the mean if ``adjusted``."""
    levels = sorted(values.dropna().unique())
    kept = levels[:-1] if adjusted else levels[1:]
    columns = np.array([values == v for v in kept], float).reshape(len(kept), len(values)).T
    return columns - np.array(values == levels[-1], float)[:, None] if adjusted else columns


def gram(cells: pd.DataFrame, y: str, factors: list[str], covariates: list[str], terms: list[Term], adjusted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix of intercept, terms and response, and the term number of each column (0: intercept)."""
    values = ["", *covariates, y]

    def cross(a: str, b: str) -> np.ndarray:
        if not a or not b:
            return cells["n" if not a and not b else f"s_{a or b}"].to_numpy(float)
        a, b = sorted((a, b), key=values.index)
        return cells[f"p_{a}_{b}"].to_numpy(float)

    codes = {f: _codes(cells[f], adjusted) for f in factors}
    columns, owner = [(np.ones(len(cells)), "")], [0]  # weights of the combinations and the value they weigh
    for number, term in enumerate(terms, 1):
        inside = [v for v in term if v in covariates]
        if len(inside) > 1:
            raise ValueError("a term holds one covariate at most")
        product = np.ones((len(cells), 1))
        for f in term:
            if f in codes:
                product = (product[:, :, None] * codes[f][:, None, :]).reshape(len(cells), -1)
        columns += [(c, inside[0] if inside else "") for c in product.T]
        owner += [number] * product.shape[1]
    columns.append((np.ones(len(cells)), y))
    out = np.array([[(c * d * cross(a, b)).sum() for d, b in columns] for c, a in columns])
    return out, np.array(owner)


def swept(g: np.ndarray, order: list[int]) -> tuple[float, list[bool]]:
    """What the columns of ``order`` leave of the response's square, and which of them were not aliased."""
    g, size, used = g.copy(), np.diag(g).copy(), []
    for k in order:
        free = g[k, k] > ALIASED * max(size[k], 1e-300)
        used.append(bool(free))
        if free:
            row = g[k] / g[k, k]
            g -= np.outer(g[:, k], row)
            g[k, :] = g[:, k] = 0.0
    return float(g[-1, -1]), used


def anova(
    df: DataFrame, y: str, terms: list[Term], factors: list[str], covariates: dict[str, Column] | None = None, adjusted: bool = False
) -> DataFrame:
    """``term, df, sum_sq, f_value, p_value`` of a linear model, the residual last.

    ``terms`` are tuples of names of ``factors`` and ``covariates``: one name is a main effect, more are an
    interaction.  Sums of squares are sequential, each term after those before it, or, with ``adjusted``, each after
    all others.  Combinations of levels and design columns are few by nature: their table goes to one task.
    """
    covariates = covariates or {}
    names, extra = [":".join(t) for t in terms], list(covariates)

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        g, owner = gram(cells, y, factors, extra, terms, adjusted)
        every = list(range(len(owner)))
        rest, used = swept(g, every)
        n, rank = cells["n"].sum(), sum(used)
        rows, before = [], swept(g, [0])[0]
        for number in range(1, len(terms) + 1):
            own = [k for k in every if owner[k] == number]
            if adjusted:
                without, left = swept(g, [k for k in every if owner[k] != number])
                rows.append((rank - sum(left), without - rest))
            else:
                after = swept(g, [k for k in every if owner[k] <= number])[0]
                rows.append((sum(used[k] for k in own), before - after))
                before = after
        rows.append((int(n - rank), rest))
        return pd.DataFrame(
            {"term": [*names, "residual"], "df": [int(d) for d, _ in rows], "sum_sq": [s for _, s in rows], "__dfr": int(n - rank), "__rest": rest}
        )

    table = moments(df, y, factors, covariates)
    solved = table.groupBy().applyInPandas(solve, "term string, df long, sum_sq double, __dfr long, __rest double")
    f = F.try_divide(F.try_divide(F.col("sum_sq"), F.col("df")), F.try_divide(F.col("__rest"), F.col("__dfr")))
    shown = (F.col("term") != "residual") & (F.col("df") > 0)
    out = solved.withColumn("f_value", F.when(shown, f))
    return out.select("term", "df", "sum_sq", "f_value", f_upper_tail(F.col("f_value"), F.col("df"), F.col("__dfr")).alias("p_value"))
