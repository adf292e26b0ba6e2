"""Paired tests between detectors; rows are reduced in Spark, p-values come from the few numbers left."""

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from palisade.operators.ordering import running_totals


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / (c if abs(c) > tiny else tiny)
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def t_two_sided(t: float, freedom: float) -> float:
    """Two-sided tail of Student's t."""
    if math.isinf(t):
        return 0.0
    x = freedom / (freedom + t * t)
    a, b = freedom / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) \
        if 0.0 < x < 1.0 else 0.0
    if x >= 1.0:
        return 1.0
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution: a series up to three, a continued fraction beyond."""
    x = F.abs(z) / math.sqrt(2.0)
    square = x * x
    start = F.struct(x.alias("term"), x.alias("total"))

    def more(acc, k):
        term = acc["term"] * 2.0 * square / (2.0 * k + 1.0)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, more, lambda acc: acc["total"])
    near = 1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-square) * series
    fraction = F.aggregate(F.sequence(F.lit(90), F.lit(1), F.lit(-1)), F.lit(1.0), lambda f, k: 1.0 + k / (2.0 * square) / f)
    far = F.exp(-square) / (x * math.sqrt(math.pi) * fraction)
    return F.when(x < 3.0, F.greatest(near, F.lit(0.0))).otherwise(far)


def signed_rank_exact(statistic: float, ranks) -> float:
    """Exact two-sided tail of the smaller rank sum: (rank, how many) pairs, average ranks of ties included.

    Each sign pattern has the same chance. The number of patterns per rank sum is the product of (1 + x^rank) over the
    ranks, multiplied out one rank after the other; doubled ranks are whole numbers.
    """
    ways = [1]
    for rank, times in ranks:
        step = round(2 * rank)
        for _ in range(int(times)):
            longer = ways + [0] * step
            for total, count in enumerate(ways):
                longer[total + step] += count
            ways = longer
    return min(1.0, 2.0 * (sum(ways[: int(round(2 * statistic)) + 1]) / sum(ways)))


AUTO, EXACT, NORMAL = "auto", "exact", "normal"
FEW = 50  # of the automatic choice: so many untied differences that are not zero have an exact tail


def _exact_p(statistic, n, ranks):
    return 1.0 if statistic is None or not n else signed_rank_exact(statistic, [(r["rank"], r["n"]) for r in ranks])


# one call per pair of detectors
_t_tail = F.udf(lambda t, n: 1.0 if t is None or n < 2 else t_two_sided(t, n - 1.0), T.DoubleType())
_exact_tail = F.udf(_exact_p, T.DoubleType())


def _differences(df: DataFrame, pairs) -> DataFrame:
    """Long form (pair, d) for the given pairs of score columns; rows with a missing score drop out."""
    entries = F.array(*[
        F.struct(F.lit(f"{a} vs {b}").alias("pair"), (F.col(a).cast("double") - F.col(b).cast("double")).alias("d"))
        for a, b in pairs
    ])
    return df.select(F.inline(entries)).where(F.col("d").isNotNull())


def paired_t_tests(df: DataFrame, pairs) -> DataFrame:
    """(pair, n, t_statistic, p_value, significant); equal scores everywhere give 0 and 1."""
    moments = _differences(df, pairs).groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"),
        F.max(F.abs("d")).alias("largest"),
    )
    spread = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    t = F.when((F.col("largest") > 0) & (spread > 0), F.col("mean") / spread)
    return moments.select("pair", "n", t.alias("_t")).select(
        "pair", "n", F.coalesce("_t", F.lit(0.0)).alias("t_statistic"), _t_tail("_t", "n").alias("p_value")
    ).withColumn("significant", F.col("p_value") < 0.05)


def signed_rank_sums(df: DataFrame, pairs, keep_ranks: int = 0) -> DataFrame:
    """(pair, n, zeros, w_plus, w_minus, ties, ranks): average ranks of the absolute differences.

    Differences are first counted per distinct size, then ranked through running totals in sorted slices. ``ranks``
    lists (rank, n) of the pairs with at most ``keep_ranks`` differences, and is empty for the others.
    """
    long = _differences(df, pairs)
    sizes = long.groupBy("pair", F.abs("d").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("up"),
    )
    zeros = sizes.where("size = 0").select("pair", F.col("n").alias("zeros"))
    placed = running_totals(sizes.where("size > 0"), ["size"], unique=True, by=["pair"], before=F.col("n"))
    d = lambda c: c.cast("double")
    rank = d(F.col("before")) + (d(F.col("n")) + 1.0) / 2.0
    early = F.when(F.col("before") < keep_ranks, F.struct(rank.alias("rank"), F.col("n").alias("n")))  # the first few
    sums = placed.groupBy("pair").agg(
        F.sum("n").alias("n"), F.sum(rank * F.col("up")).alias("w_plus"),
        F.sum(rank * (F.col("n") - F.col("up"))).alias("w_minus"),
        F.sum(d(F.col("n")) * d(F.col("n")) * d(F.col("n")) - d(F.col("n"))).alias("ties"),
        F.sort_array(F.collect_list(early)).alias("ranks"),
    ).withColumn("ranks", F.when(F.col("n") <= keep_ranks, F.col("ranks")).otherwise(F.array().cast("array<struct<rank: double, n: bigint>>")))
    every = sizes.select("pair").distinct()
    return every.join(sums, "pair", "left").join(zeros, "pair", "left").fillna(0, ["n", "zeros", "w_plus", "w_minus", "ties"])


def wilcoxon_tests(df: DataFrame, pairs, method: str = AUTO, few: int = FEW) -> DataFrame:
    """(pair, n, statistic, p_value, significant): two-sided signed-rank test, zero differences dropped.

    ``method``: "normal" takes the normal tail with the correction for ties; "exact" multiplies out all sign patterns,
    ties included, and refuses pairs with more than ``few`` differences (the work grows with their cube); "auto" is the
    usual choice of statistics packages, exact for at most ``few`` differences without ties and zeros, normal for others.
    """
    if method not in (AUTO, EXACT, NORMAL):
        raise ValueError(f"unknown method {method}")
    sums = signed_rank_sums(df, pairs, 0 if method == NORMAL else few)
    statistic, n = F.least("w_plus", "w_minus"), F.col("n").cast("double")
    spread = F.sqrt((n * (n + 1.0) * (2.0 * n + 1.0) - 0.5 * F.col("ties")) / 24.0)
    normal = F.when((n > 0) & (spread > 0), normal_tail((statistic - n * (n + 1.0) / 4.0) / spread)).otherwise(1.0)
    exact = _exact_tail(statistic, "n", "ranks")
    if method == AUTO:
        p = F.when((F.col("n") <= few) & (F.col("ties") == 0) & (F.col("zeros") == 0), exact).otherwise(normal)
    elif method == EXACT:
        many = F.raise_error(F.lit(f"an exact test takes at most {few} differences")).cast("double")
        p = F.when(F.col("n") > few, many).otherwise(exact)
    else:
        p = normal
    return sums.select("pair", "n", statistic.alias("statistic"), p.alias("p_value")).withColumn("significant", F.col("p_value") < 0.05)


def compare_detectors(df: DataFrame, scores, test=wilcoxon_tests) -> DataFrame:
    """The test for every pair of score columns, all pairs in one pass."""
    return test(df, list(combinations(scores, 2)))


def paired_scores(first: DataFrame, second: DataFrame, row_id: str) -> DataFrame:
    """Scores of two detectors side by side, matched by row id."""
    return first.select(row_id, F.col("score").alias("score_a")).join(
        second.select(row_id, F.col("score").alias("score_b")), row_id
    )
