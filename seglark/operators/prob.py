"""Probability estimators: from a frequency table to ``(sample, cnt, prob)``.

Every estimator takes ``bins``, the number of possible samples, and ``by``, the
condition columns; ``unseen`` of a result is what one sample without a count
gets.  c is a count, n the total, b the number of seen samples.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import freq

#: Logarithm of a probability of zero (fixed value).
NO_PROB = -1e300


def _ratio(a, b) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return a / F.nullif(b, F.lit(0))


def _bins(bins: int | None) -> Column:
    return F.col("b") if bins is None else F.lit(bins)


def _checked(bins: int | None, value: Column) -> Column:
    """Fails where there are more samples than bins."""
    if bins is None:
        return value
    return F.when(F.col("b") <= bins, value).otherwise(F.raise_error(F.lit(f"more samples than the {bins} bins")))


def uniform(samples: DataFrame) -> DataFrame:
    own = samples.select("sample").distinct()
    return own.crossJoin(F.broadcast(own.agg(F.count("*").alias("b")))).select("sample", _ratio(F.lit(1.0), F.col("b")).alias("prob"), F.lit(0.0).alias("unseen"))


def dictionary(probs: DataFrame, log: bool = False, normalise: bool = False) -> DataFrame:
    """Given ``(sample, prob)``, base-2 logarithms with ``log``; a sum of 0 normalises to uniform."""
    if not normalise:
        return probs.select("sample", (F.pow(F.lit(2.0), "prob") if log else F.col("prob")).alias("prob"))
    if log:
        top = probs.agg(F.max("prob").alias("m"))
        total = probs.crossJoin(F.broadcast(top)).agg((F.max("m") + F.log2(F.sum(F.pow(F.lit(2.0), F.col("prob") - F.col("m"))))).alias("t"))
        return probs.crossJoin(F.broadcast(total)).select("sample", F.pow(F.lit(2.0), F.col("prob") - F.col("t")).alias("prob"))
    total = probs.agg(F.sum("prob").alias("t"), F.count("*").alias("b"))
    share = F.when(F.col("t") == 0, 1.0 / F.col("b")).otherwise(_ratio(F.col("prob"), F.col("t")))
    return probs.crossJoin(F.broadcast(total)).select("sample", share.alias("prob"))


def mle(dist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return freq.relative(dist, by).select(*by, "sample", "cnt", F.col("freq").alias("prob"), F.lit(0.0).alias("unseen"))


def lidstone(dist: DataFrame, gamma: float, bins: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(c + gamma) / (n + bins * gamma); also ``discount``, the mass that unseen samples take."""
    k, g = _bins(bins).cast("double"), F.lit(float(gamma))
    divisor = F.col("n") + k * g
    g, divisor = F.when(divisor == 0, 0.0).otherwise(g), F.when(divisor == 0, 1.0).otherwise(divisor)
    out = freq.with_total(dist, by)
    return out.select(*by, "sample", "cnt", _checked(bins, (F.col("cnt") + g) / divisor).alias("prob"), (g / divisor).alias("unseen"), (g * k / divisor).alias("discount"))


def laplace(dist: DataFrame, bins: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    return lidstone(dist, 1.0, bins, by)


def ele(dist: DataFrame, bins: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    return lidstone(dist, 0.5, bins, by)


def held_out(base: DataFrame, held: DataFrame, bins: int | None = None) -> DataFrame:
    """T_r / (N_r * n of the held-out counts), where T_r sums the held-out counts of samples with base count r."""
    both = held.select("sample", F.col("cnt").alias("h")).join(base.select("sample", "cnt"), "sample", "left").na.fill(0, ["cnt"])
    mass = both.groupBy(F.col("cnt").alias("r")).agg(F.sum("h").alias("t"))
    size = F.broadcast(held.agg(F.sum("cnt").alias("n")))
    per_r = freq.count_of_counts(base, bins).join(mass, "r", "left").na.fill(0, ["t"]).crossJoin(size)
    per_r = per_r.select(F.col("r").alias("cnt"), _ratio(F.col("t").cast("double"), F.col("nr") * F.col("n")).alias("prob"))
    zero = per_r.filter("cnt = 0").agg(F.max("prob").alias("unseen"))
    return base.select("sample", "cnt").join(per_r, "cnt").crossJoin(F.broadcast(zero)).select("sample", "cnt", "prob", F.coalesce("unseen", F.lit(0.0)).alias("unseen"))


def cross_validated(folds: DataFrame, bins: int) -> DataFrame:
    """Mean of :func:`held_out` over all ordered pairs of folds; ``folds`` is ``(fold, sample, cnt)``.

    All pairs are computed in the same aggregations.  There are few folds, so
    their pairs are few too.
    """
    sums = folds.groupBy("fold").agg(F.sum("cnt").alias("n"), F.count("*").alias("b"))
    names = sums.select("fold")
    pairs = F.broadcast(names.select(F.col("fold").alias("i")).crossJoin(F.broadcast(names.select(F.col("fold").alias("j")))).filter("i <> j"))
    samples = folds.select("sample").distinct()
    base = folds.select(F.col("fold").alias("i"), "sample", F.col("cnt").alias("r"))
    held = folds.select(F.col("fold").alias("j"), "sample", F.col("cnt").alias("h"))
    every = samples.crossJoin(pairs)
    every = every.join(base, ["i", "sample"], "left").join(held, ["j", "sample"], "left").na.fill(0, ["r", "h"])
    mass = every.groupBy("i", "j", "r").agg(F.sum("h").alias("t"), F.count("*").alias("k"))
    size = F.broadcast(sums.select(F.col("fold").alias("j"), "n"))
    seen = F.broadcast(sums.select(F.col("fold").alias("i"), "b"))
    mass = mass.join(size, "j").join(seen, "i")
    nr = F.when(F.col("r") == 0, F.lit(bins) - F.col("b")).otherwise(F.col("k"))
    mass = mass.select("i", "j", "r", F.coalesce(_ratio(F.col("t").cast("double"), nr * F.col("n")), F.lit(0.0)).alias("p"))
    return every.join(mass, ["i", "j", "r"]).groupBy("sample").agg(F.avg("p").alias("prob"))


def witten_bell(dist: DataFrame, bins: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """c / (n + b) for seen samples, b / (z (n + b)) for each of the z unseen ones."""
    z = _bins(bins) - F.col("b")
    unseen = F.when(F.col("n") == 0, _ratio(F.lit(1.0), z)).otherwise(_ratio(F.col("b").cast("double"), z * (F.col("n") + F.col("b"))))
    return freq.with_total(dist, by).select(*by, "sample", "cnt", _checked(bins, _ratio(F.col("cnt").cast("double"), F.col("n") + F.col("b"))).alias("prob"), F.coalesce(unseen, F.lit(0.0)).alias("unseen"))


def good_turing(dist: DataFrame, bins: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(c + 1) N_{c+1} / (N_c n); N_1 / n is shared by the unseen samples."""
    nr = freq.count_of_counts(dist, by=by)
    more = nr.select(*by, (F.col("r") - 1).alias("cnt"), F.col("nr").alias("up"))
    same = nr.select(*by, F.col("r").alias("cnt"), "nr")
    ones = nr.filter("r = 1").select(*by, F.col("nr").alias("n1"))
    out = freq.with_total(dist, by).join(same, [*by, "cnt"]).join(more, [*by, "cnt"], "left")
    out = out.join(ones, list(by), "left") if by else out.crossJoin(F.broadcast(ones.agg(F.sum("n1").alias("n1"))))
    out = out.na.fill(0, ["up", "n1"])
    prob = _ratio((F.col("cnt") + 1.0) * F.col("up"), F.col("nr") * F.col("n"))
    unseen = F.coalesce(_ratio(_ratio(F.col("n1").cast("double"), F.col("n")), _bins(bins) - F.col("b")), F.lit(0.0))
    return out.select(*by, "sample", "cnt", _checked(bins, prob).alias("prob"), unseen.alias("unseen"))


def simple_good_turing(dist: DataFrame, bins: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Good-Turing with a log-log line through averaged counts of counts.

    Raw counts of counts are used below the switch, fitted ones from it on; the
    switch is the first r before a gap or where both agree within 1.96 standard
    deviations.  Seen probabilities are scaled to leave N_1 / n.
    """
    keys = list(by)
    w = Window.partitionBy(*keys).orderBy("r")  # over counts of counts, of which there are few
    nr = freq.count_of_counts(dist, by=by)
    nr = nr.withColumn("low", F.coalesce(F.lag("r").over(w), F.lit(0))).withColumn("next_r", F.lead("r").over(w)).withColumn("next_nr", F.lead("nr").over(w))
    high = F.coalesce("next_r", 2 * F.col("r") - F.col("low"))
    nr = nr.withColumn("lr", F.log(F.col("r").cast("double"))).withColumn("lz", F.log(2.0 * F.col("nr") / (high - F.col("low"))))
    line = nr.groupBy(*keys).agg(
        F.coalesce(F.regr_slope("lz", "lr"), F.lit(0.0)).alias("slope"),
        (F.avg("lz") - F.coalesce(F.regr_slope("lz", "lr"), F.lit(0.0)) * F.avg("lr")).alias("icept"),
        F.sum(F.when(F.col("r") == 1, F.col("nr")).otherwise(0)).alias("n1"),
    )
    sums = freq.totals(dist, by).join(line, keys) if keys else freq.totals(dist).crossJoin(F.broadcast(line))
    nr = nr.join(sums, keys) if keys else nr.crossJoin(F.broadcast(sums))

    def fitted(r: Column) -> Column:
        return F.exp(F.col("icept") + F.col("slope") * F.log(r.cast("double")))

    r = F.col("r")
    smooth = (r + 1) * fitted(r + 1) / fitted(r)
    raw = (r + 1) * F.col("next_nr") / F.col("nr")
    spread = F.sqrt(F.pow(r + 1.0, 2) * (F.col("next_nr") / F.pow(F.col("nr").cast("double"), 2)) * (1 + F.col("next_nr") / F.col("nr")))
    gap = F.col("next_r").isNull() | (F.col("next_r") != r + 1)
    nr = nr.withColumn("at", F.min(F.when(gap | (F.abs(raw - smooth) <= 1.96 * spread), r)).over(Window.partitionBy(*keys)))
    nr = nr.withColumn("measure", F.when(r < F.col("at"), raw).otherwise(smooth) / F.col("n"))
    scale = (1 - F.col("n1") / F.col("n")) / F.sum(F.col("nr") * F.col("measure")).over(Window.partitionBy(*keys))
    per_r = nr.select(*keys, r.alias("cnt"), (F.col("measure") * scale).alias("prob"), "n", "b", "n1")
    unseen = F.coalesce(_ratio(F.col("n1") / F.col("n"), _bins(bins) - F.col("b")), F.lit(0.0))
    return dist.join(per_r, [*keys, "cnt"]).select(*keys, "sample", "cnt", _checked(bins, F.col("prob")).alias("prob"), unseen.alias("unseen"))


def kneser_ney(bigrams: DataFrame, discount: float = 0.75) -> DataFrame:
    """Interpolated Kneser-Ney over ``(cond, sample, cnt)``, with the distinct contexts of a sample as its lower order."""
    per_cond = bigrams.groupBy("cond").agg(F.sum("cnt").alias("n"), F.count("*").alias("b"))
    lower = bigrams.groupBy("sample").agg(F.count("*").alias("k"))
    total = F.broadcast(bigrams.agg(F.count("*").alias("all")))
    out = bigrams.join(per_cond, "cond").join(lower, "sample").crossJoin(total)
    prob = (F.greatest(F.col("cnt") - discount, F.lit(0.0)) + discount * F.col("b") * F.col("k") / F.col("all")) / F.col("n")
    return out.select("cond", "sample", "cnt", prob.alias("prob"))


def override(probs: DataFrame, changes: DataFrame, log: bool = False) -> DataFrame:
    """A distribution with some samples' probabilities replaced by those of ``changes (sample, prob)``."""
    new = changes.select("sample", (F.pow(F.lit(2.0), "prob") if log else F.col("prob")).alias("new"))
    return probs.join(new, "sample", "left").select("sample", F.coalesce("new", "prob").alias("prob"))


def log_prob(p: Column) -> Column:
    """Base-2 logarithm; zero gives ``NO_PROB``."""
    return F.when(p > 0, F.log2(p)).otherwise(F.lit(NO_PROB))


def entropy(probs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return probs.groupBy(*by).agg((-F.sum(F.when(F.col("prob") > 0, F.col("prob") * F.log2("prob")))).alias("entropy"))


def log_likelihood(test: DataFrame, actual: DataFrame) -> DataFrame:
    """Sum over the actual distribution's samples of its probability times the test's log probability."""
    both = actual.select("sample", F.col("prob").alias("p")).join(test.select("sample", "prob"), "sample", "left").na.fill(0.0, ["prob"])
    return both.agg(F.sum(F.col("p") * log_prob(F.col("prob"))).alias("log_likelihood"))


def add_logs(a: Column, b: Column) -> Column:
    """log2(2^a + 2^b) without leaving log space."""
    top, low = F.greatest(a, b), F.least(a, b)
    return F.when(top - low > -F.log2(F.lit(1e-30)), top).otherwise(top + F.log2(1 + F.pow(F.lit(2.0), low - top)))


def sum_logs(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """log2 of the sum of 2^x over rows; ``NO_PROB`` without rows."""
    top = df.groupBy(*by).agg(F.max(col).alias("_top"))
    rows = df.join(top, list(by)) if by else df.crossJoin(F.broadcast(top))
    out = rows.groupBy(*by).agg((F.max("_top") + F.log2(F.sum(F.pow(F.lit(2.0), F.col(col) - F.col("_top"))))).alias("sum_logs"))
    return out.select(*by, F.coalesce("sum_logs", F.lit(NO_PROB)).alias("sum_logs"))


def generate(probs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``(draw, sample)``: n samples by the inverse of the cumulative distribution in order of samples.

    Running sums are taken in stretches of the order; draws find their interval
    by a join on a grid cell that both fall in, not with all rows.
    """
    spark = probs.sparkSession
    table = freq.running(probs.select("sample", "prob", F.lit(0).alias("g")).filter("prob > 0"), F.col("prob"), ["g"], "sample")
    table = table.select("sample", F.col("before").cast("double").alias("lo"), (F.col("before") + F.col("prob")).alias("hi"))
    cells = 1024
    last = F.least(F.floor(F.col("hi") * cells), F.lit(cells))
    table = table.select("sample", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), last)).alias("cell"))
    draws = spark.range(n).select(F.col("id").alias("draw"), F.rand(seed).alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    return draws.join(table, "cell").filter("u >= lo and u < hi").select("draw", "sample")


def conditional(dist: DataFrame, factory: Callable[..., DataFrame], cond: str = "cond", **options) -> DataFrame:
    """An estimator applied to every condition in one pass."""
    return factory(dist.withColumnRenamed(cond, "cond") if cond != "cond" else dist, by=["cond"], **options)


def conditional_lookup(probs: DataFrame, asked: DataFrame, unseen_condition: float = 0.0) -> DataFrame:
    """Probabilities of ``asked (cond, sample)``: seen, unseen in a known condition, or in an unknown one."""
    known = probs.groupBy("cond").agg(F.max("unseen").alias("rest"))
    out = asked.join(probs.select("cond", "sample", "prob"), ["cond", "sample"], "left").join(known, "cond", "left")
    return out.select("cond", "sample", F.coalesce("prob", "rest", F.lit(unseen_condition)).alias("prob"))
