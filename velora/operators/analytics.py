"""Statistics over the feature table.

Every operator is one scan and one hash aggregate (with map-side partial
combine); multi-dimension breakdowns unpivot the dimensions first so one
pass serves all of them. p-values are computed on the one-row-per-test
result by Arrow-batched pandas UDFs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velora.functions.calendar import ntz_lit

from velora.functions.calendar import season
from velora.functions.distributions import chi2_pvalue, t_pvalue

TARGET = "hourly_count"
CORR_COLUMNS = ["hourly_count", "is_night", "is_holiday", "is_rush_hour", "is_rainy", "is_snowy", "is_windy", "apparent_temperature"]


def mean_by_hour(df: DataFrame) -> DataFrame:
    """Mean count per clock hour."""
    return df.groupBy(F.hour("ts").alias("hour")).agg(F.avg(TARGET).alias("mean_count"), F.count(F.lit(1)).alias("n"))


def mean_by_dimensions(df: DataFrame, dims: dict[str, F.Column]) -> DataFrame:
    """Mean count per value of several dimensions in one pass (long form).

    ``dims`` maps a dimension name to a column expression; the frame is
    unpivoted to (dimension, value) and aggregated once.
    """
    cols = [F.struct(F.lit(name).alias("dimension"), expr.cast("string").alias("value")) for name, expr in dims.items()]
    long = df.select(F.col(TARGET), F.explode(F.array(*cols)).alias("__d"))
    return long.groupBy(F.col("__d.dimension").alias("dimension"), F.col("__d.value").alias("value")).agg(
        F.avg(TARGET).alias("mean_count"), F.count(F.lit(1)).alias("n")
    )


def mean_by_weather(df: DataFrame) -> DataFrame:
    """Mean count by rain, snow and wind flag."""
    return mean_by_dimensions(df, {"is_rainy": F.col("is_rainy"), "is_snowy": F.col("is_snowy"), "is_windy": F.col("is_windy")})


def mean_by_calendar(df: DataFrame) -> DataFrame:
    """A10: mean count by season, month, holiday and rush hour."""
    return mean_by_dimensions(
        df,
        {
            "season": season("ts"),
            "month": F.month("ts"),
            "is_holiday": F.col("is_holiday"),
            "is_rush_hour": F.col("is_rush_hour"),
        },
    )


def temperature_bins(df: DataFrame, width: float = 1.0) -> DataFrame:
    """Temperature vs count as a binned density (bin floor, rows, mean count)."""
    b = (F.floor(F.col("apparent_temperature") / F.lit(width)) * F.lit(width)).cast("double")
    return (
        df.filter(F.col("apparent_temperature").isNotNull())
        .groupBy(b.alias("temp_bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(TARGET).alias("mean_count"))
    )


def safe_corr(x: F.Column, y: F.Column) -> F.Column:
    """Pearson r that is NULL (not an ANSI division error) when either side is constant."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def _numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols])


def correlation_matrix(df: DataFrame, cols: Sequence[str] = tuple(CORR_COLUMNS), start=None, end=None) -> DataFrame:
    """Pearson matrix in long form (col_a, col_b, r) over a time window.

    Booleans are cast to 0/1, rows with a NULL target or temperature dropped.
    One aggregate gives every pair's r over the rows where both sides are
    present, and which columns vary (P11); constant columns are left out. A NaN
    coefficient becomes 0. Fewer than two varying columns give no row.
    """
    if start is not None:
        df = df.filter(F.col("ts") >= ntz_lit(start))
    if end is not None:
        df = df.filter(F.col("ts") <= ntz_lit(end))
    cols = list(cols)
    num = _numeric(df, cols).dropna(subset=["hourly_count", "apparent_temperature"])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]

    def pair_r(a: str, b: str) -> F.Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return safe_corr(F.when(both, F.col(a)), F.when(both, F.col(b)))

    row = num.agg(
        *[pair_r(a, b).alias(f"{a}|{b}") for a, b in pairs],
        *[F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(f"varies|{c}") for c in cols],
    )

    def entry(a: str, b: str, r: F.Column) -> F.Column:
        keep = F.col(f"`varies|{a}`") & F.col(f"`varies|{b}`")
        return F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r.alias("r"), keep.alias("keep"))

    entries = [entry(*ends, F.col(f"`{a}|{b}`")) for a, b in pairs for ends in ((a, b), (b, a))]
    entries += [entry(a, a, F.lit(1.0)) for a in cols]
    many = sum(F.col(f"`varies|{c}`").cast("int") for c in cols) >= 2
    long = row.filter(many).select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter("keep").drop("keep")
    return long.withColumn("r", F.when(F.isnan("r") | F.col("r").isNull(), F.lit(0.0)).otherwise(F.col("r")))


def pearson_tests(df: DataFrame, variables: Sequence[str] = ("is_rainy", "is_snowy", "apparent_temperature", "is_windy")) -> DataFrame:
    """R, n and t = r*sqrt((n-2)/(1-r^2)) of count vs each variable (needs n > 1)."""
    entries = []
    aggs = []
    for v in variables:
        y, x = F.col(TARGET).cast("double"), F.col(v).cast("double")
        both = y.isNotNull() & x.isNotNull()
        aggs += [safe_corr(F.when(both, y), F.when(both, x)).alias(f"r_{v}"), F.count(F.when(both, F.lit(1))).alias(f"n_{v}")]
        entries.append(F.struct(F.lit(v).alias("variable"), F.col(f"r_{v}").alias("r"), F.col(f"n_{v}").alias("n")))
    long = df.agg(*aggs).select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter(F.col("n") > 1)
    r = F.col("r")
    t = F.when(F.abs(r) < 1, r * F.sqrt((F.col("n") - 2) / (F.lit(1.0) - r * r)))
    return long.withColumn("t", t)


def with_t_pvalue(df: DataFrame, t: str = "t", dof: str = "df", out: str = "p_value") -> DataFrame:
    """Attach two-sided p-values (pandas UDF on the per-test rows)."""
    return df.withColumn(out, t_pvalue(F.col(t).cast("double"), F.col(dof).cast("double")))


def pearson_with_p(df: DataFrame, **kw) -> DataFrame:
    """A13 with p-values; |r| = 1 gives p = 0."""
    out = pearson_tests(df, **kw).withColumn("df", F.col("n") - 2)
    return with_t_pvalue(out).withColumn("p_value", F.when(F.abs("r") >= 1, F.lit(0.0)).otherwise(F.col("p_value")))


def two_sample_tests(df: DataFrame, flags: Sequence[str] = ("is_night", "is_holiday", "is_rush_hour")) -> DataFrame:
    """Pooled two-sample t statistic of the count, group false vs group true, per flag.

    t = (mean0 - mean1) / sqrt(sp2 * (1/n0 + 1/n1)), df = n0 + n1 - 2; a flag
    with only one group present gives no row.
    """
    aggs = []
    entries = []
    for f in flags:
        y = F.col(TARGET).cast("double")
        ok = y.isNotNull() & F.col(f).isNotNull()
        for g, cond in ((0, ~F.col(f)), (1, F.col(f))):
            sel = F.when(ok & cond, y)
            aggs += [F.count(sel).alias(f"{f}_n{g}"), F.avg(sel).alias(f"{f}_m{g}"), F.var_samp(sel).alias(f"{f}_v{g}")]
        entries.append(
            F.struct(
                F.lit(f).alias("flag"),
                *[F.col(f"{f}_{k}{g}").alias(f"{k}{g}") for g in (0, 1) for k in ("n", "m", "v")],
            )
        )
    long = df.agg(*aggs).select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    long = long.filter((F.col("n0") > 0) & (F.col("n1") > 0))
    dof = F.col("n0") + F.col("n1") - 2
    sp2 = ((F.col("n0") - 1) * F.coalesce("v0", F.lit(0.0)) + (F.col("n1") - 1) * F.coalesce("v1", F.lit(0.0))) / dof
    se = F.sqrt(sp2 * (F.lit(1.0) / F.col("n0") + F.lit(1.0) / F.col("n1")))
    return long.select(
        "flag",
        F.col("n0"),
        F.col("n1"),
        F.col("m0").alias("mean0"),
        F.col("m1").alias("mean1"),
        F.when(se > 0, (F.col("m0") - F.col("m1")) / se).alias("t"),
        dof.alias("df"),
    )


def two_sample_with_p(df: DataFrame, **kw) -> DataFrame:
    return with_t_pvalue(two_sample_tests(df, **kw))


def chi_square_tests(df: DataFrame, pairs: Sequence[tuple[str, str]] = (("is_night", "is_holiday"), ("is_night", "is_rush_hour"))) -> DataFrame:
    """2x2 contingency counts and the chi-square statistic with Yates' correction.

    chi2 = sum over cells of max(|o - e| - 0.5, 0)^2 / e, e from the margins.
    A table with a single level on either side gives no row.
    """
    aggs, entries = [], []
    for a, b in pairs:
        ok = F.col(a).isNotNull() & F.col(b).isNotNull()
        cells = {}
        for va in (0, 1):
            for vb in (0, 1):
                ca = F.col(a) if va else ~F.col(a)
                cb = F.col(b) if vb else ~F.col(b)
                name = f"{a}_{b}_{va}{vb}"
                aggs.append(F.count(F.when(ok & ca & cb, F.lit(1))).alias(name))
                cells[(va, vb)] = name
        entries.append(
            F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), *[F.col(cells[k]).alias(f"o{k[0]}{k[1]}") for k in sorted(cells)])
        )
    long = df.agg(*aggs).select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    o = {k: F.col(f"o{k[0]}{k[1]}").cast("double") for k in ((0, 0), (0, 1), (1, 0), (1, 1))}
    row = {0: o[(0, 0)] + o[(0, 1)], 1: o[(1, 0)] + o[(1, 1)]}
    col = {0: o[(0, 0)] + o[(1, 0)], 1: o[(0, 1)] + o[(1, 1)]}
    n = row[0] + row[1]
    chi2 = F.lit(0.0)
    for (i, j), obs in o.items():
        e = row[i] * col[j] / n
        chi2 = chi2 + F.pow(F.greatest(F.abs(obs - e) - F.lit(0.5), F.lit(0.0)), 2) / e
    levels_ok = (row[0] > 0) & (row[1] > 0) & (col[0] > 0) & (col[1] > 0)
    return long.filter(levels_ok).withColumn("chi2", chi2).withColumn("df", F.lit(1))


def chi_square_with_p(df: DataFrame, **kw) -> DataFrame:
    return chi_square_tests(df, **kw).withColumn("p_value", chi2_pvalue(F.col("chi2")))
