"""Grouped linear fits, analysis of variance, rank-sum test, normal QQ tables.

Sums of squares are built-in aggregates; probabilities are added to the result
rows, one per fit or test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import f_upper_tail, normal_quantile, rank_sum_p, t_quantile
from .selection import quantiles, running_count


def _pairs(y: str, x: str | Column):
    """Sums of squares and products over rows where both are present."""
    xc = F.col(x) if isinstance(x, str) else x
    yc = F.col(y)
    both = xc.isNotNull() & yc.isNotNull()
    return [
        F.count(F.when(both, 1)).alias("n"),
        F.regr_sxx(yc, xc).alias("sxx"),
        F.regr_sxy(yc, xc).alias("sxy"),
        F.regr_syy(yc, xc).alias("syy"),
    ]


def linear_fits(
    df: DataFrame, keys: list[str], y: str = "mean_norm_psmad2", x: str = "bin_id", level: float = 0.95
) -> DataFrame:
    """Intercept, slope and its confidence interval per group."""
    yc, xc = F.col(y), F.col(x)
    fit = df.groupBy(*keys).agg(
        F.regr_intercept(yc, xc).alias("intercept"), F.regr_slope(yc, xc).alias("slope"), *_pairs(y, x)
    )
    dof = F.when((F.col("n") > 2) & (F.col("sxx") > 0), F.col("n") - 2)
    rss = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    half = t_quantile(0.5 + level / 2, dof) * F.sqrt(rss / dof / F.col("sxx"))
    return fit.withColumn("__half", half).select(
        *keys,
        "n",
        "intercept",
        "slope",
        (F.col("slope") - F.col("__half")).alias("slope_low"),
        (F.col("slope") + F.col("__half")).alias("slope_high"),
    )


def one_covariate_anova(df: DataFrame, keys: list[str], y: str, x: Column) -> DataFrame:
    """F test of a single numeric covariate, per group (``keys=[]`` pools all rows)."""
    s = df.withColumn("__x", x).groupBy(*keys).agg(*_pairs(y, "__x"))
    ss = F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    s = s.withColumn("ss_model", ss).withColumn("ss_residual", F.col("syy") - F.col("ss_model"))
    s = s.withColumn("df_model", F.lit(1)).withColumn(
        "df_residual", F.when(F.col("sxx") > 0, F.col("n") - 2)
    )
    f = F.try_divide(F.col("ss_model"), F.try_divide(F.col("ss_residual"), F.col("df_residual")))
    return s.withColumn("f_value", f).select(
        *keys,
        "df_model",
        "df_residual",
        "ss_model",
        "ss_residual",
        "f_value",
        f_upper_tail(F.col("f_value"), F.col("df_model"), F.col("df_residual")).alias("p_value"),
    )


def _with_f(row: DataFrame, terms: list[tuple[str, str, str]]) -> DataFrame:
    """One output row per term: degrees of freedom, sum of squares, F and p against the residual."""
    parts = F.array(
        *[
            F.struct(
                F.lit(label).alias("term"),
                F.col(dof).cast("bigint").alias("df"),
                F.col(ss).alias("sum_sq"),
            )
            for label, dof, ss in terms
        ]
    )
    mean_residual = F.try_divide(F.col("ss_residual"), F.col("df_residual"))
    rows = row.withColumn("__ms", mean_residual).select(
        "__ms", F.col("df_residual").alias("__dfr"), F.inline(parts)
    )
    is_term = F.col("term") != "residual"
    f = F.when(is_term, F.try_divide(F.try_divide(F.col("sum_sq"), F.col("df")), F.col("__ms")))
    return rows.withColumn("f_value", f).select(
        "term",
        "df",
        "sum_sq",
        "f_value",
        f_upper_tail(F.col("f_value"), F.col("df"), F.col("__dfr")).alias("p_value"),
    )


def two_way_anova(
    df: DataFrame, y: str = "eucl_diff", factor: str = "experiment", two_level: Column | None = None
) -> DataFrame:
    """Sequential sums of squares of factor, a two-level factor, and their interaction.

    ``two_level`` is the indicator of the second level.  From the per-factor sums
    of squares alone, so the rows are read once.
    """
    z = (F.col("group_id") == "2").cast("int") if two_level is None else two_level
    rows = df.withColumn("__z", z.cast("double"))
    each = rows.groupBy(factor).agg(*_pairs(y, "__z"), F.avg(y).alias("mean_y"))
    part = F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    s = each.agg(
        F.count(F.lit(1)).alias("k"),
        F.count(F.when(F.col("sxx") > 0, 1)).alias("k_both"),
        F.sum("n").alias("n"),
        F.sum("syy").alias("within"),
        (F.sum(F.col("n") * F.col("mean_y") * F.col("mean_y"))
         - F.try_divide(
             F.sum(F.col("n") * F.col("mean_y")) * F.sum(F.col("n") * F.col("mean_y")), F.sum("n")
         )).alias("ss_factor"),
        F.try_divide(F.sum("sxy") * F.sum("sxy"), F.sum("sxx")).alias("ss_group"),
        F.sum(part).alias("ss_each"),
    )
    s = s.select(
        (F.col("k") - 1).alias("df_factor"),
        F.lit(1).alias("df_group"),
        (F.col("k_both") - 1).alias("df_inter"),
        (F.col("n") - F.col("k") - F.col("k_both")).alias("df_residual"),
        "ss_factor",
        "ss_group",
        (F.col("ss_each") - F.col("ss_group")).alias("ss_inter"),
        (F.col("within") - F.col("ss_each")).alias("ss_residual"),
    )
    return _with_f(
        s,
        [
            (factor, "df_factor", "ss_factor"),
            ("group_id", "df_group", "ss_group"),
            (f"{factor}:group_id", "df_inter", "ss_inter"),
            ("residual", "df_residual", "ss_residual"),
        ],
    )


def ancova(df: DataFrame, y: str = "range", factor: str = "experiment", x: Column | None = None) -> DataFrame:
    """Factor plus continuous covariate without interaction, adjusted (type III) sums of squares."""
    cov = F.log10("ligand_conc") if x is None else x
    rows = df.withColumn("__x", cov).where(F.col("__x").isNotNull() & F.col(y).isNotNull())
    each = rows.groupBy(factor).agg(*_pairs(y, "__x"), F.avg("__x").alias("mx"), F.avg(y).alias("my"))
    n = F.sum("n")

    def between(p: str, q: str) -> Column:
        return F.sum(F.col("n") * F.col(p) * F.col(q)) - F.sum(F.col("n") * F.col(p)) * F.sum(
            F.col("n") * F.col(q)
        ) / n

    s = each.agg(
        F.count(F.lit(1)).alias("k"),
        n.alias("n"),
        F.sum("sxx").alias("sxx"),
        F.sum("sxy").alias("sxy"),
        F.sum("syy").alias("syy"),
        (F.sum("sxx") + between("mx", "mx")).alias("txx"),
        (F.sum("sxy") + between("mx", "my")).alias("txy"),
        (F.sum("syy") + between("my", "my")).alias("tyy"),
    )
    s = s.withColumn("ss_x", F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")))
    s = s.withColumn("ss_residual", F.col("syy") - F.col("ss_x"))
    s = s.withColumn(
        "ss_factor",
        F.col("tyy") - F.try_divide(F.col("txy") * F.col("txy"), F.col("txx")) - F.col("ss_residual"),
    )
    s = s.select(
        (F.col("k") - 1).alias("df_factor"),
        F.lit(1).alias("df_x"),
        (F.col("n") - F.col("k") - 1).alias("df_residual"),
        "ss_factor",
        "ss_x",
        "ss_residual",
    )
    return _with_f(
        s,
        [
            (factor, "df_factor", "ss_factor"),
            ("covariate", "df_x", "ss_x"),
            ("residual", "df_residual", "ss_residual"),
        ],
    )


def rank_sum_test(
    df: DataFrame, keys: list[str], y: str = "eucl_diff", group: str = "group_id", first: str = "1", second: str = "2"
) -> DataFrame:
    """Rank-sum statistic of ``first`` against ``second`` and its two-sided p, per key group.

    Works on value runs: a running count gives every tied run its mean rank.
    """
    runs = (
        df.where(F.col(group).isin(first, second) & F.col(y).isNotNull())
        .groupBy(*keys, F.col(y).alias("__y"))
        .agg(
            F.count(F.when(F.col(group) == first, 1)).alias("c1"),
            F.count(F.lit(1)).alias("c"),
        )
    )
    runs = running_count(runs, keys, "__y", "c", "__upto")
    rank = F.col("__upto") - (F.col("c") - 1) / 2.0
    t = F.col("c").cast("double")
    sums = runs.withColumn("__rank", rank).groupBy(*keys).agg(
        F.sum(F.col("c1") * F.col("__rank")).alias("ranks"),
        F.sum("c1").alias("n1"),
        F.sum(F.col("c") - F.col("c1")).alias("n2"),
        F.sum(t * t * t - t).alias("ties"),
    )
    w_stat = F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2.0
    return sums.withColumn("w", w_stat).select(
        *keys,
        "n1",
        "n2",
        "w",
        rank_sum_p(F.col("w"), F.col("n1"), F.col("n2"), F.col("ties")).alias("p_value"),
    )


def qq_points(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Sample values against normal quantiles at the usual plotting positions.

    For summary rows (a few per group): each group is numbered in one task.
    """
    rows = df.where(F.col(column).isNotNull() & ~F.isnan(column))
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    i = F.row_number().over(w.orderBy(column))
    a = F.when(F.col("__n") <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    p = (F.col("__i") - a) / (F.col("__n") + 1 - 2 * a)
    return (
        rows.withColumn("__n", n)
        .withColumn("__i", i)
        .select(*keys, F.col("__i").alias("point"), F.col(column).alias("sample"), p.alias("position"))
        .withColumn("theoretical", normal_quantile(F.col("position")))
    )


def qq_line(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Line through the sample and normal quartiles."""
    q = quantiles(df, keys, {"q1": (column, 0.25), "q3": (column, 0.75)})
    z = normal_quantile(F.lit(0.75))
    slope = (F.col("q3") - F.col("q1")) / (2 * z)
    return q.select(
        *keys, slope.alias("slope"), ((F.col("q3") + F.col("q1")) / 2).alias("intercept")
    )

