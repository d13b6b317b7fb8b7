"""Rank tests over tables of scores: statistics by aggregation, and their p-values as expressions over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as P
from .corpus import average_ranks


def signed_rank(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Wilcoxon's W of (by, diff) with its two-sided p: differences of zero are left out of the ranks but counted in n for the
    effect size.

    p is exact for up to 50 differences without zeros and ties, else from the normal distribution with the variance that ties
    leave. Without a difference other than zero there is no row.
    """
    n = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("diff"), 6).alias("mean_diff"))
    sizes = pairs.where("diff <> 0").withColumn("size", F.abs("diff"))
    ties = sizes.groupBy(*by, "size").agg(F.count("*").alias("t")).groupBy(*by).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    r = average_ranks(sizes, by, "size")
    w = r.groupBy(*by).agg(F.count("*").alias("m"), F.sum(F.when(F.col("diff") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("diff") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"))
    w = n.join(w, by).join(ties, by).withColumn("w", F.least("w_plus", "w_minus"))
    m = F.col("m")
    z = (F.col("w") - m * (m + 1) / 4) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    p = F.when((m <= P.MOST_EXACT) & (m == F.col("n")) & (F.col("ties") == 0), P.signed_rank_exact(F.col("w"), m)).otherwise(P.normal_both(z))
    w = w.withColumn("effect", F.round(1 - 2 * F.col("w") / (F.col("n") * (F.col("n") + 1) / 2), 6)).withColumn("p", F.round(p, 9))
    return w.select(*by, "w_plus", "w_minus", "w", "n", "mean_diff", "effect", "p")


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """H with tie correction and its chi-squared p, and (H - 1) / (n - 1), the effect size that the reports use."""
    ranks = average_ranks(df.select(group, value).withColumn("_all", F.lit(1)), ["_all"], value)
    ties = df.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    sums = ranks.groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("c"))
    h = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("c")).alias("s"), F.sum("c").alias("n"), F.count("*").alias("k")).crossJoin(ties)
    h = h.withColumn("h", (12 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1)) / (1 - F.col("ties") / (F.col("n") ** 3 - F.col("n"))))
    h = h.withColumn("p", F.round(P.chi2_tail(F.col("h"), F.col("k") - 1), 9))
    return h.select("k", "n", F.round("h", 6).alias("h"), F.round((F.col("h") - 1) / (F.col("n") - 1), 6).alias("eta2"), "p")


def friedman(df: DataFrame, block: str, group: str, value: str) -> DataFrame:
    """Friedman's statistic with tie correction over complete blocks, and its chi-squared p."""
    k = df.agg(F.count_distinct(group).alias("k"))
    full = df.groupBy(block).agg(F.count("*").alias("c")).crossJoin(k).where("c = k").select(block, "k")
    d = df.join(full, block)
    ranks = average_ranks(d, [block], value)
    n = full.agg(F.count("*").alias("n"), F.first("k").alias("kk"))
    ties = d.groupBy(block, value).agg(F.count("*").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    s = ranks.groupBy(group).agg(F.sum("rank").alias("r")).agg(F.sum(F.col("r") * F.col("r")).alias("s")).crossJoin(n).crossJoin(ties)
    q = (12 / (F.col("n") * F.col("kk") * (F.col("kk") + 1)) * F.col("s") - 3 * F.col("n") * (F.col("kk") + 1)) / (1 - F.col("ties") / (F.col("n") * (F.col("kk") ** 3 - F.col("kk"))))
    return s.select("n", F.col("kk").alias("k"), F.round(q, 6).alias("chi2"), F.round(P.chi2_tail(q, F.col("kk") - 1), 9).alias("p"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks and its two-sided p by Student's t; null if either column is constant, p also below three rows."""
    a = average_ranks(df.withColumn("_all", F.lit(1)), ["_all"], x).withColumnRenamed("rank", "_x")
    rho = F.try_divide(F.covar_pop("_x", "rank"), F.stddev_pop("_x") * F.stddev_pop("rank"))
    c = average_ranks(a, ["_all"], y).agg(rho.alias("rho"), F.count("*").alias("n"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    p = F.when(F.col("n") > 2, F.when(F.abs("rho") >= 1 - 1e-12, 0.0).when(F.col("rho").isNotNull(), P.t_both(t, F.col("n") - 2)))
    # p first: inside its lambdas a name of the same select list would stand for the rounded column.
    return c.withColumn("p", F.round(p, 9)).select(F.round("rho", 6).alias("rho"), "n", "p")


def sign_test(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, k, p): of n differences other than zero, k are positive; p is the chance of as many in fair tosses."""
    s = pairs.where("diff <> 0").groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("diff") > 0).alias("k"))
    # In logarithms: 0.5^n alone is 0 from n = 1,075 on.
    start = F.struct((F.col("n") * F.log(F.lit(0.5))).alias("c"), F.lit(0.0).alias("s"))
    more = lambda i: F.when(i < F.col("n"), F.log((F.col("n") - i) / (i + 1))).otherwise(0.0)
    step = lambda a, i: F.struct((a["c"] + more(i)).alias("c"), (a["s"] + F.when(i >= F.col("k"), F.exp(a["c"])).otherwise(0.0)).alias("s"))
    return s.withColumn("p", F.round(F.aggregate(F.sequence(F.lit(0), F.col("n").cast("int")), start, step, lambda a: a["s"]), 9))


def cohen_d(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, d, size) of paired differences: their mean over their sample deviation, and its usual name."""
    d = F.abs(F.col("d"))
    out = pairs.groupBy(*by).agg(F.round(F.try_divide(F.avg("diff"), F.stddev_samp("diff")), 6).alias("d"))
    return out.withColumn("size", F.when(d < 0.2, "negligible").when(d < 0.5, "small").when(d < 0.8, "medium").when(d.isNotNull(), "large"))


def post_hoc(df: DataFrame, block: str, group: str, value: str, least: int = 3, alpha: float = 0.05) -> DataFrame:
    """Signed ranks of all pairs of groups with at least ``least`` shared blocks, alpha divided by the number of pairs (Bonferroni),
    and whether p is below it."""
    x = df.select(block, F.col(group).alias("a"), F.col(value).alias("x"))
    y = df.select(block, F.col(group).alias("b"), F.col(value).alias("y"))
    pairs = x.join(y, block).where("a < b").select("a", "b", F.round(F.col("x") - F.col("y"), 3).alias("diff"))
    w = signed_rank(pairs, ["a", "b"]).where(F.col("n") >= least)
    return w.crossJoin(F.broadcast(w.agg(F.round(alpha / F.count("*"), 6).alias("alpha")))).withColumn("significant", F.coalesce(F.col("p") < F.col("alpha"), F.lit(False)))
