"""Classification and retrieval metrics, and statistics, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..scratch import Scratch
from .ranges import places, ranged, running


def roc_auc(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(by, auc): area under the ROC curve by average ranks; groups of one class are left out.

    Scores are counted by value first, so ties meet in one row and only distinct scores are ordered.
    """
    pos = F.col(label).cast("long")
    values = df.groupBy(*by, score).agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("q"))
    below = running(ranged(values, by, [score]), by, [score], F.sum, {"below": "q"}, inclusive=False)
    won = below.withColumn("won", F.col("p") * (F.coalesce("below", F.lit(0)) + F.col("q") / 2))
    out = won.groupBy(*by).agg(F.sum("won").alias("w"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return out.where("np > 0 and nq > 0").select(*by, (F.col("w") / (F.col("np") * F.col("nq"))).alias("auc"))


def _best(df: DataFrame, by: list[str], k: int, tie: str, score: str) -> DataFrame:
    """The k best rows of each group with their place; the limit cuts every partition before rows move."""
    placed = df.withColumn("_pos", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), tie)))
    return placed.where(F.col("_pos") <= k)


def _with_totals(best: DataFrame, df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Groups with positives, their number `n` and what `best` has for them."""
    totals = df.groupBy(*by).agg(F.sum(label).alias("n")).where("n > 0")
    return totals.join(best, by, "left") if by else totals.crossJoin(F.broadcast(best))  # one row each


def recall_at(df: DataFrame, by: list[str], k: int, tie: str, score: str = "score", label: str = "label") -> DataFrame:
    """(by, recall): share of the positives among the k best; groups without positives are left out."""
    found = _best(df, by, k, tie, score).groupBy(*by).agg(F.sum(label).alias("f"))
    return _with_totals(found, df, by, label).select(*by, (F.coalesce("f", F.lit(0)) / F.col("n")).alias("recall"))


def ndcg_at(df: DataFrame, by: list[str], k: int, tie: str, score: str = "score", label: str = "label") -> DataFrame:
    """(by, ndcg): binary gains; the ideal list ends at k too (M9)."""
    gained = _best(df, by, k, tie, score).groupBy(*by).agg(F.sum(F.col(label) / F.log2(F.col("_pos") + 1)).alias("dcg"))
    steps = F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))
    ideal = F.aggregate(steps, F.lit(0.0), lambda a, p: a + 1 / F.log2(p + 1))
    return _with_totals(gained, df, by, label).select(*by, (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def enrichment(df: DataFrame, share: float, tie: str, score: str = "score", label: str = "label") -> DataFrame:
    """(ef): rate of positives among the top share (one row at least) over the rate of all.

    Rows are placed in ranges, so the top share, which grows with the table, meets in no task.
    """
    placed = places(df.select(score, tie, label), [], [F.desc(score), tie], "_pos")
    n = df.agg(F.count("*").alias("n"), F.sum(label).alias("p"), F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(share))).alias("top"))
    met = placed.crossJoin(F.broadcast(n))  # one row
    best = met.groupBy("n", "p", "top").agg(F.sum(F.when(F.col("_pos") <= F.col("top"), F.col(label)).otherwise(0)).alias("f"))
    return best.select(F.when(F.col("p") > 0, (F.col("f") / F.col("top")) / (F.col("p") / F.col("n"))).otherwise(0.0).alias("ef"))


def pr_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(ap, best_f1): average precision and the best F1 over all distinct thresholds."""
    pos = F.col(label).cast("long")
    values = df.groupBy(score).agg(F.sum(pos).alias("p"), F.count("*").alias("n"))
    total = values.agg(F.sum("p").alias("total"))  # one row
    c = running(ranged(values, [], [F.desc(score)]), [], [F.desc(score)], F.sum, {"tp": "p", "seen": "n"}).crossJoin(F.broadcast(total))
    precision, recall = F.col("tp") / F.col("seen"), F.col("tp") / F.col("total")
    f1 = F.when(F.col("tp") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return c.agg(F.sum(precision * F.col("p") / F.col("total")).alias("ap"), F.max(f1).alias("best_f1"))


def confusion_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(accuracy, macro_f1, mcc) of a multi-class prediction, from its confusion table."""
    table = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    row = table.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("rows"))
    col = table.groupBy(F.col("g").alias("c")).agg(F.sum("n").alias("cols"))
    hit = table.where("t = g").select(F.col("t").alias("c"), F.col("n").alias("hits"))
    k = row.join(col, "c", "full").join(hit, "c", "left").fillna(0)
    f1 = F.when(F.col("rows") + F.col("cols") > 0, 2 * F.col("hits") / (F.col("rows") + F.col("cols"))).otherwise(0.0)
    sums = k.agg(F.sum("hits").alias("h"), F.sum("rows").alias("n"), F.sum(F.col("rows") * F.col("cols")).alias("rc"), F.sum(F.col("rows") ** 2).alias("r2"), F.sum(F.col("cols") ** 2).alias("c2"), F.avg(f1).alias("macro_f1"))
    n2 = F.col("n").cast("double") ** 2
    low = F.sqrt((n2 - F.col("r2")) * (n2 - F.col("c2")))
    mcc = F.when(low > 0, (F.col("h") * F.col("n") - F.col("rc")) / low).otherwise(0.0)
    return sums.select((F.col("h") / F.col("n")).alias("accuracy"), "macro_f1", mcc.alias("mcc"))


def binary_metrics(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """(sensitivity, specificity, f1) at a threshold."""
    yes, real = F.col(score) >= threshold, F.col(label) == 1
    c = df.agg(F.count_if(yes & real).alias("tp"), F.count_if(yes & ~real).alias("fp"), F.count_if(~yes & real).alias("fn"), F.count_if(~yes & ~real).alias("tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(share(tp, tp + fn).alias("sensitivity"), share(tn, tn + fp).alias("specificity"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def multilabel_f1(df: DataFrame, label: str, truth: str, guess: str) -> DataFrame:
    """(macro_f1, micro_f1) over labels of 0/1 truth and guess."""
    c = df.groupBy(label).agg(F.sum(F.col(truth) * F.col(guess)).alias("tp"), F.sum(truth).alias("t"), F.sum(guess).alias("g"))
    f1 = F.when(F.col("t") + F.col("g") > 0, 2 * F.col("tp") / (F.col("t") + F.col("g"))).otherwise(0.0)
    return c.agg(F.avg(f1).alias("macro_f1"), (2 * F.sum("tp") / (F.sum("t") + F.sum("g"))).alias("micro_f1"))


def rank_correlation(df: DataFrame, a: str, b: str, tie: str) -> DataFrame:
    """(rho): 1 - 6 sum d^2 / (n (n^2 - 1)) of ordinal ranks; 0 below two rows."""
    placed = places(places(df.select(a, b, tie), [], [a, tie], "_a"), [], [b, tie], "_b")
    d = placed.select(((F.col("_a") - F.col("_b")) ** 2).alias("d2"))
    n = F.count("*").cast("double")
    return d.agg(F.when(n >= 2, 1 - 6 * F.sum("d2") / (n * (n * n - 1))).otherwise(0.0).alias("rho"))


def hierarchical_consistency(df: DataFrame, key: str, level: str, correct: str) -> DataFrame:
    """(consistency): share of children right where their parent, one level up, is; 1 without any."""
    up = F.lag(correct).over(W.partitionBy(key).orderBy(level))
    pairs = df.withColumn("_up", up).where("_up = 1")
    return pairs.agg(F.coalesce(F.avg(F.col(correct).cast("double")), F.lit(1.0)).alias("consistency"))


# statistics


def adjusted(df: DataFrame, by: list[str], p: str, names: tuple[str | None, str | None] = ("holm", "bh")) -> DataFrame:
    """df with p-values adjusted by Holm's step-down rule and for the false discovery rate (Q2, Q5), of one pass.

    Equal p-values have the first one's result whatever their order, so only distinct ones are
    ordered, once, in ranges; a null p-value gets null. A name None leaves that result out.
    """
    scratch = Scratch(df.sparkSession, "adjusted")
    values = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_n"))
    placed = ranged(values, by, [p])
    total = placed.groupBy(*by).agg(F.sum("_n").alias("_all"))
    summed = running(placed, by, [p], F.sum, {"_upto": "_n"})
    summed = scratch.save(summed.join(total, by) if by else summed.crossJoin(F.broadcast(total)), "values")  # one row
    out = summed
    if names[0]:
        stepped = out.withColumn("_s", F.col(p) * (F.col("_all") - F.col("_upto") + F.col("_n")))
        out = running(stepped, by, [p], F.max, {names[0]: "_s"}).drop("_s")
    if names[1]:
        stepped = out.withColumn("_s", F.col(p) * F.col("_all") / F.col("_upto"))
        out = running(stepped, by, [p], F.min, {names[1]: "_s"}, reverse=True).drop("_s")
    own = out.select(*by, p, *(F.least(F.col(n), F.lit(1.0)).alias(n) for n in names if n))
    return df.join(own, [*by, p], "left")


def holm(df: DataFrame, by: list[str], p: str, tie: str) -> DataFrame:
    """df with `holm` of adjusted() (Q2)."""
    return adjusted(df, by, p, ("holm", None))


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, tie: str) -> DataFrame:
    """df with `bh` of adjusted() (Q5)."""
    return adjusted(df, by, p, (None, "bh"))


def cohens_d(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """(by, d): difference of the means of group 1 and 0 over the pooled deviation; 0 where that is 0,
    null where a group has fewer than two values (Q3)."""
    one = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    c = df.groupBy(*by).agg(*(one(f, g).alias(f"{n}{g}") for g in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    d = F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled).otherwise(0.0)
    return c.select(*by, F.when((F.col("n0") >= 2) & (F.col("n1") >= 2), d).alias("d"))


def _poisson_cuts() -> list[float]:
    """The distribution of Poisson weights with mean 1, to the last of 40 bits."""
    import math

    cuts, term = [], math.exp(-1)
    for k in range(1, 16):
        cuts.append((cuts[-1] if cuts else 0.0) + term)
        term /= k
    return cuts


def poisson_weights(hashes, resamples: int):
    """Weights (row, resample) of rows by their 64-bit hashes, as numpy: the same for a row wherever it is."""
    import numpy as np

    x = hashes.astype(np.uint64)[:, None] + np.arange(1, resamples + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(24)).astype(np.float64) / float(1 << 40)
    return np.searchsorted(np.array(_poisson_cuts()), u, side="right").astype(np.float64)


def bootstrap_ci(df: DataFrame, value: str, key: str, resamples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(mean, low, high): percentile interval of the mean by Poisson resampling (Q4).

    Each row draws its weight in every resample from a hash of its key. A task sums weights and
    weighted values of all resamples over its rows, so no row is copied or moved and a task gives
    one row a resample; equal seeds give equal intervals. Null values do not count.
    """
    cuts_of, rows_at_once = poisson_weights, max(1, 4_000_000 // resamples)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w, wx = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            h, x = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, len(h), rows_at_once):
                weights = cuts_of(h[at : at + rows_at_once], resamples)
                w += weights.sum(0)
                wx += x[at : at + rows_at_once] @ weights
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(w), pa.array(wx)], names=["b", "w", "wx"])

    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(F.lit(seed), F.col(key)).alias("h"), F.col(value).cast("double").alias("x"))
    means = rows.mapInArrow(run, "b long, w double, wx double").groupBy("b").agg((F.sum("wx") / F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    interval = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    return df.agg(F.avg(value).alias("mean")).crossJoin(F.broadcast(interval))  # one row by one row


def paired_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, t, p): paired t-test by Student's integral; equal pairs give p = 1 (Q1).

    Sums are taken in Spark; only they reach the driver.
    """
    import math

    d = F.col(a) - F.col(b)
    n, mean, var = df.agg(F.count(d), F.avg(d), F.var_samp(d)).first()
    if not n or n < 2 or not var:
        rows = [(int(n or 0), 0.0, 1.0)]
    else:
        t, v = mean / math.sqrt(var / n), n - 1
        steps, top = 20000, math.atan2(abs(t), math.sqrt(v))
        h = top / steps  # P(|T| < t) is an integral of cos^(v-1)
        area = sum(math.cos((k + 0.5) * h) ** (v - 1) for k in range(steps)) * h
        norm = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi)
        rows = [(int(n), t, max(0.0, 1 - 2 * norm * area))]
    return df.sparkSession.createDataFrame(rows, "n long, t double, p double")


def signed_rank(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, w, z): Wilcoxon's signed ranks of pairs that differ, average ranks for ties, with the normal score (Q1)."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0")
    values = d.groupBy(F.abs("d").alias("m")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    before = running(ranged(values, [], ["m"]), [], ["m"], F.sum, {"before": "c"}, inclusive=False)
    ranked = before.withColumn("r", F.coalesce("before", F.lit(0)) + (F.col("c") + 1) / 2)
    out = ranked.agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.col("r") * F.col("up")), F.lit(0.0)).alias("w"), F.sum(F.col("c") ** 3 - F.col("c")).alias("ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return out.select(F.coalesce("n", F.lit(0)).alias("n"), "w", F.when(spread > 0, (F.col("w") - n * (n + 1) / 4) / spread).otherwise(0.0).alias("z"))


def _normality(n: int, spread: float, whole: float, dot: float, m: tuple[float, float], first: tuple[float, float], last: tuple[float, float]) -> tuple[float, float]:
    """W and its p-value by Royston's approximation (AS R94) from sums over the ordered values.

    whole and dot: sums of squared normal scores and of scores times values. m: the highest two
    scores; first and last: the two values at either end, outermost first.
    """
    import math
    from statistics import NormalDist

    if not spread:
        return 1.0, 1.0
    poly = lambda at, *c: sum(k * at**i for i, k in enumerate(c))
    u, wide, inner = 1 / math.sqrt(n), last[0] - first[0], last[1] - first[1]
    if n == 3:
        b = math.sqrt(0.5) * wide
    else:
        top = poly(u, m[0] / math.sqrt(whole), 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
        if n > 5:
            second = poly(u, m[1] / math.sqrt(whole), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
            phi = (whole - 2 * m[0] ** 2 - 2 * m[1] ** 2) / (1 - 2 * top**2 - 2 * second**2)
            b = top * wide + second * inner + (dot - m[0] * wide - m[1] * inner) / math.sqrt(phi)
        else:
            phi = (whole - 2 * m[0] ** 2) / (1 - 2 * top**2)
            b = top * wide + (dot - m[0] * wide) / math.sqrt(phi)
    w = min(1.0, b * b / spread)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return w, 1.0
    if n <= 11:
        low = poly(n, -2.273, 0.459) - math.log(1 - w)
        if low <= 0:
            return w, 0.0
        at, mu, sigma = -math.log(low), poly(n, 0.5440, -0.39978, 0.025054, -0.0006714), math.exp(poly(n, 1.3822, -0.77857, 0.062767, -0.0020322))
    else:
        at, k = math.log(1 - w), math.log(n)
        mu, sigma = poly(k, -1.5861, -0.31082, -0.083751, 0.0038915), math.exp(poly(k, -0.4803, -0.082676, 0.0030302))
    return w, 1 - NormalDist().cdf((at - mu) / sigma)


def shapiro_wilk(df: DataFrame, value: str) -> tuple[int, float, float]:
    """(n, W, p) of a column's values that are not null (Q1); p is 0 below three values.

    Values are placed in ranges, and only sums and the two values at either end reach the driver.
    Beyond 5,000 values p is extrapolated, as the approximation's authors note.
    """
    x = df.select(F.col(value).cast("double").alias("x")).where("x is not null")
    n, spread = x.agg(F.count("*"), F.coalesce(F.var_pop("x") * F.count("*"), F.lit(0.0))).first()
    if n < 3:
        return n, 1.0, 0.0
    placed = places(x, [], ["x"], "place")

    def scores(batches):
        from statistics import NormalDist

        import pyarrow as pa

        inverse = NormalDist().inv_cdf
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([inverse((i - 0.375) / (n + 0.25)) for i in batch.column(1).to_pylist()], pa.float64())], names=["x", "place", "m"])

    scored = placed.select("x", F.col("place").cast("long").alias("place")).mapInArrow(scores, "x double, place long, m double")
    at = lambda k, c="x": F.max(F.when(F.col("place") == k, F.col(c)))
    s = scored.agg(F.sum(F.col("m") ** 2), F.sum(F.col("m") * F.col("x")), at(n, "m"), at(n - 1, "m"), at(1), at(2), at(n), at(n - 1)).first()
    return n, *_normality(n, spread, s[0], s[1], (s[2], s[3]), (s[4], s[5]), (s[6], s[7]))


def chosen_test(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """(test, statistic, p, normality): paired t-test if the differences look normal, else signed ranks (Q1).

    Fewer than three pairs take signed ranks; equal pairs give p = 1. Signed ranks are exact up to
    50 differing pairs without ties, else by the normal score. Only sums reach the driver.
    """
    from statistics import NormalDist

    d = df.select((F.col(a) - F.col(b)).cast("double").alias("d")).where("d is not null")
    n_all, moved, sizes = d.agg(F.count("*"), F.count_if(F.col("d") != 0), F.countDistinct(F.abs("d"))).first()
    normality = shapiro_wilk(d, "d")[2] if n_all >= 3 else 0.0
    if not moved:
        row = ("signed ranks", 0.0, 1.0, normality)
    elif normality >= alpha:
        _, t, p = paired_test(df, a, b).first()
        row = ("paired t", t, p, normality)
    else:
        n, w, z = signed_rank(df, a, b).first()
        least = min(w, n * (n + 1) / 2 - w)
        if n <= 50 and n == n_all == sizes:
            ways = [1]  # how many subsets of the ranks have each sum
            for r in range(1, n + 1):
                ways = [(ways[k] if k < len(ways) else 0) + (ways[k - r] if k >= r else 0) for k in range(len(ways) + r)]
            p = min(1.0, 2 * sum(ways[: int(least) + 1]) / 2**n)
        else:
            p = 2 * NormalDist().cdf(-abs(z))
        row = ("signed ranks", float(least), p, normality)
    return df.sparkSession.createDataFrame([row], "test string, statistic double, p double, normality double")


def delong(df: DataFrame, a: str, b: str, label: str, key: str) -> DataFrame:
    """(auc_a, auc_b, z): DeLong's test of two AUCs on the same rows, by placement values (Q6)."""

    def placed(score):
        values = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
        summed = running(ranged(values, [], ["s"]), [], ["s"], F.sum, {"pb": "p", "qb": "q"}, inclusive=False)
        under = lambda c: F.coalesce(f"{c}b", F.lit(0)) + F.col(c) / 2
        t = summed.select("s", under("p").alias("lp"), under("q").alias("lq"))
        total = F.sum(F.col(label).cast("long")), F.sum(1 - F.col(label).cast("long"))
        m, n = df.agg(*total).first()
        v = F.when(F.col(label) == 1, F.col("lq") / n).otherwise(1 - F.col("lp") / m)
        return df.join(t, F.col(score) == F.col("s")).select(key, label, v.alias(f"v_{score}"))

    both = placed(a).join(placed(b).drop(label), key)
    x, y = f"v_{a}", f"v_{b}"
    of = lambda f, g, *c: f(*(F.when(F.col(label) == g, F.col(k)) for k in c))
    s = both.agg(
        of(F.avg, 1, x).alias("auc_a"), of(F.avg, 1, y).alias("auc_b"),
        *((of(F.var_samp, g, x) + of(F.var_samp, g, y) - 2 * of(F.covar_samp, g, x, y)).alias(f"s{g}") for g in (0, 1)),
        *(F.count_if(F.col(label) == g).alias(f"n{g}") for g in (0, 1)),
    )
    var = F.col("s0") / F.col("n0") + F.col("s1") / F.col("n1")
    return s.select("auc_a", "auc_b", F.when(var > 0, (F.col("auc_a") - F.col("auc_b")) / F.sqrt(var)).otherwise(0.0).alias("z"))
