"""Paired comparisons of experiment results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmine.functions.ranktests import bootstrap_median, signed_rank_p
from weftmine.operators.prefix import average_ranks, prefix_sums, running_maxima


def paired(results: DataFrame, a: str, b: str, metric: str, keys: tuple[str, ...] = ("K", "seed")) -> DataFrame:
    """keys, x, y, delta of two variants' values where both have one."""
    one = lambda v, name: results.filter(F.col("variant") == v).select(*keys, F.col(metric).alias(name))
    return one(a, "x").join(one(b, "y"), list(keys)).dropna(subset=["x", "y"]).withColumn("delta", F.col("x") - F.col("y"))


def outcomes(pairs: DataFrame) -> DataFrame:
    """n, wins, losses, ties, mean_delta, median_delta."""
    return pairs.agg(F.count("*").alias("n"), F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses"), F.count_if(F.col("delta") == 0).alias("ties"), F.avg("delta").alias("mean_delta"), F.median("delta").alias("median_delta"))


def signed_ranks(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Differences other than 0 with the average rank of their size, by groups of any size."""
    return average_ranks(pairs.filter("delta <> 0").withColumn("size", F.abs("delta")), by or [], "size", "rank")


def rank_biserial(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """effect: (sum of positive ranks - sum of negative ones) / sum of all, 0 without any."""
    rows = signed_ranks(pairs, by)
    effect = F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("rank")).otherwise(-F.col("rank"))) / F.sum("rank"), F.lit(0.0))
    return (rows.groupBy(*by) if by else rows).agg(effect.alias("effect"))


def holm(tests: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """tests with ``holm``: step-down adjusted p-values, 1 at most, by families of any size. Equal p-values stand in the order of the other columns."""
    columns, by = tests.columns, by or []
    rows = tests.withColumn("__all", F.lit(0)).withColumn("__one", F.lit(1))
    sizes = rows.groupBy("__all", *by).agg(F.count("*").alias("__n"))
    order = [p, *(c for c in columns if c not in (p, *by))]
    rows = prefix_sums(rows, ["__all", *by], order, "__one", "__before").join(sizes, ["__all", *by])
    rows = rows.withColumn("__step", F.least(F.lit(1.0), F.col(p) * (F.col("__n") - F.col("__before"))))
    return running_maxima(rows, ["__all", *by], ["__before"], "__step", "holm").select(*columns, "holm")


def verdict(p: Column, delta: Column, practical: float, alpha: float = 0.05) -> Column:
    """What a difference means: whether it is significant, and whether it is large enough to matter."""
    return F.when((p >= alpha) & (F.abs(delta) < practical), "not significant, negligible").when(p >= alpha, "not significant").when(F.abs(delta) < practical, "significant, negligible").when(delta > 0, "better").otherwise("worse")


def wilcoxon(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, w, p, low, high of each comparison: the signed-rank test and the bootstrap interval of the median, where its few pairs are."""
    import pandas as pd

    def test(frame: pd.DataFrame) -> pd.DataFrame:
        w, p = signed_rank_p(frame["delta"])
        low, high = bootstrap_median(frame["delta"].sort_values())
        return pd.DataFrame([[*frame[by].iloc[0], len(frame), w, p, low, high]], columns=[*by, "n", "w", "p", "low", "high"])

    kinds = dict(pairs.dtypes)
    return pairs.groupBy(*by).applyInPandas(test, ", ".join(f"{c} {kinds[c]}" for c in by) + ", n long, w double, p double, low double, high double")


def renamed(results: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """results with values of a column replaced by those that a table of names gives them; others stay."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return results.withColumn(column, F.coalesce(F.element_at(F.create_map(*pairs), F.col(column)), F.col(column)) if names else F.col(column))


def families(**results: DataFrame) -> DataFrame:
    """Results of several families in one table, with the family's name; what a family doesn't have is null."""
    if not results:
        raise ValueError("no family is given")
    out = None
    for name, rows in results.items():
        named = rows.withColumn("family", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


#: What compares two variants: the family that p-values are corrected in, the variants, the metric, whether more of it is better, and from which difference on it matters.
COMPARISON = "family string, a string, b string, metric string, higher_is_better boolean, practical double"


def against(base: str, others: list[str], metrics: dict[str, tuple[bool, float]], family: str = "all") -> list[tuple]:
    """Comparisons of ``base`` with each other variant. metrics: whether more is better, and from which difference on it matters."""
    return [(family, base, other, metric, better, practical) for other in others for metric, (better, practical) in metrics.items()]


def measurements(results: DataFrame, metrics: list[str], variant: str, run: list[str]) -> DataFrame:
    """variant, run, metric, value of all finite numbers in a table with a column for each metric."""
    long = results.select(F.col(variant).alias("variant"), *run, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(["variant", *run], metrics, "metric", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def compared(long: DataFrame, comparisons: DataFrame, run: list[str]) -> DataFrame:
    """The comparisons' columns, run, and delta of each run that both variants have: above 0 where a does better than b."""
    side = lambda c, v: long.select(F.col("variant").alias(c), "metric", *run, F.col("value").alias(v))
    both = comparisons.join(side("a", "__x"), ["a", "metric"]).join(side("b", "__y"), ["b", "metric", *run])
    return both.withColumn("delta", F.when(F.col("higher_is_better"), F.col("__x") - F.col("__y")).otherwise(F.col("__y") - F.col("__x"))).drop("__x", "__y")


def family_tests(results: DataFrame, comparisons: DataFrame, *, variant: str = "variant", run: list[str] = ("seed",), alpha: float = 0.05) -> DataFrame:
    """Each comparison (COMPARISON) with n, nonzero, wins, mean, median, effect, w, p, low, high, holm, verdict, run by run.

    A delta is above 0 where a does better, whichever way the metric points, so that "better" always speaks for a. Runs that only one of the two has, and blank or
    non-finite values, are left out; a comparison without a common run has no row, and one with under two differences p = 1. Holm's correction goes over all comparisons of a
    family, of whatever metrics. Any number of comparisons is tested at once: medians, effects and tests are a table's groups.
    """
    run = list(run)
    metrics = [r.metric for r in comparisons.select("metric").distinct().orderBy("metric").collect()]
    pairs = compared(measurements(results, metrics, variant, run), comparisons, run)
    by = ["family", "a", "b", "metric"]
    count = lambda c: F.count_if(c)
    found = pairs.groupBy(*by).agg(count(F.col("delta") != 0).alias("nonzero"), count(F.col("delta") > 0).alias("wins"), F.avg("delta").alias("mean"), F.median("delta").alias("median"), F.first("practical").alias("practical"))
    found = found.join(wilcoxon(pairs, by), by).join(rank_biserial(pairs, by), by, "left").withColumn("effect", F.coalesce("effect", F.lit(0.0)))
    found = holm(found, "p", ["family"]).withColumn("verdict", verdict(F.col("holm"), F.col("median"), F.col("practical"), alpha))
    return found.select(*by, "n", "nonzero", "wins", "mean", "median", "effect", "w", "p", "low", "high", "holm", "verdict")


def change(summary: DataFrame, value: str, metric: str, default) -> DataFrame:
    """value, metric, percent: each setting's metric, and by how many hundredths it is above that of the default setting."""
    own = summary.filter(F.col(value) == F.lit(default)).agg(F.max(metric)).first()[0]
    return summary.select(value, metric, (F.try_divide(F.col(metric) - F.lit(own), F.abs(F.lit(own))) * 100).alias("percent"))


def correlation(rows: DataFrame, x: str, y: str, keep: Column | None = None) -> DataFrame:
    """pearson, spearman, slope, intercept of the rows that have both numbers and that ``keep`` (such as a bound for outliers) holds for. Ranks are those of tables of any size."""
    both = (rows if keep is None else rows.filter(keep)).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    both = average_ranks(average_ranks(both, [], "x", "rx"), [], "y", "ry")
    return both.agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def sweep_summary(results: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """n, and mean and population deviation of each metric's finite values."""
    finite = lambda m: F.when(~F.isnan(m) & (F.abs(m) < float("inf")), F.col(m))
    return results.groupBy(*by).agg(F.count("*").alias("n"), *(c for m in metrics for c in (F.avg(finite(m)).alias(f"{m}_mean"), F.stddev_pop(finite(m)).alias(f"{m}_std"))))


def best_setting(summary: DataFrame, value: str, metric: str) -> DataFrame:
    """The value with the highest metric; of equal ones the smallest."""
    return summary.orderBy(F.desc(metric), value).limit(1).select(value, metric)
