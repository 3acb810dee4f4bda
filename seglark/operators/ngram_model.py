"""Katz back-off n-gram models over token sequences.

A model is one table per order: ``(context, token, cnt, prob)`` with contexts as
arrays, and what a context leaves to shorter ones.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import prob


@dataclass
class NgramModel:
    """``grams[k]`` and ``contexts[k]`` for order k from 1 to n."""

    n: int
    grams: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    pad: str


def _lidstone(gamma: float, bins: int) -> Callable[..., DataFrame]:
    return lambda dist, by: prob.lidstone(dist, gamma, bins, by)


def train(seqs: DataFrame, n: int, estimator: Callable[..., DataFrame] | None = None, pad: str = "", weight: str | None = None, gamma: float = 0.2) -> NgramModel:
    """Train orders n to 1 on ``seqs (tokens array<string>)``; ``weight`` names a column of partial counts.

    ``estimator(dist, by=["cond"])`` returns ``cond, sample, cnt, prob,
    discount``; without one it is Lidstone with ``gamma`` over the seen tokens
    and the pad.
    """
    counts = {k: gram_counts(seqs, k, pad, weight) for k in range(1, n + 1)}
    if estimator is None:
        estimator = _lidstone(gamma, counts[1].select("sample").distinct().count() + 1)
    grams, contexts = {}, {}
    for k, dist in counts.items():
        table = estimator(dist, by=["cond"])
        grams[k] = table.select("cond", "sample", "cnt", "prob")
        # the mass that stays for tokens not seen in the context
        contexts[k] = table.groupBy("cond").agg(F.max("discount").alias("beta"))
    return NgramModel(n, grams, contexts, pad)


def gram_counts(seqs: DataFrame, n: int, pad: str = "", weight: str | None = None) -> DataFrame:
    """``(cond, sample, cnt)``: contexts of n - 1 tokens and what follows, with n - 1 pads on either side."""
    grams = F.explode(X.padded_ngrams(F.col("tokens"), n, pad)).alias("g")
    own = seqs.select(grams, F.lit(1).alias("w") if weight is None else F.col(weight).alias("w"))
    own = own.select(F.slice("g", 1, n - 1).alias("cond") if n > 1 else F.array().cast("array<string>").alias("cond"), F.element_at("g", -1).alias("sample"), "w")
    return own.groupBy("cond", "sample").agg(F.sum("w").alias("cnt"))


def update(counts: DataFrame, seqs: DataFrame, n: int, pad: str = "", amount: float = 1.0) -> DataFrame:
    """Counts after adding sequences with a weight each."""
    more = gram_counts(seqs.withColumn("_w", F.lit(amount)), n, pad, "_w")
    return counts.unionByName(more).groupBy("cond", "sample").agg(F.sum("cnt").alias("cnt"))


def score(model: NgramModel, asked: DataFrame, backoff: bool = True) -> DataFrame:
    """``asked (context array, token, ...)`` with ``prob``.

    Seen n-grams have their probability; others alpha times that of the shorter
    context, where alpha is the ratio of what both contexts leave (1 for
    contexts never seen).  One left join per order.
    """
    out, n = asked, model.n
    for k in range(n, 0, -1):
        ctx = F.slice("context", F.greatest(F.size("context") - (k - 2), F.lit(1)), k - 1) if k > 1 else F.array().cast("array<string>")
        out = out.withColumn(f"_c{k}", ctx)
        grams = model.grams[k].select(F.col("cond").alias(f"_c{k}"), F.col("sample").alias("token"), F.col("prob").alias(f"_p{k}"))
        out = out.join(grams, [f"_c{k}", "token"], "left")
        betas = model.contexts[k].select(F.col("cond").alias(f"_c{k}"), F.col("beta").alias(f"_b{k}"))
        out = out.join(betas, [f"_c{k}"], "left")
    value: Column = F.coalesce(F.col("_p1"), F.col("_b1") * 0)
    for k in range(2, n + 1):
        alpha = F.coalesce(F.col(f"_b{k}"), F.lit(1.0)) / F.coalesce(F.nullif(F.coalesce(F.col(f"_b{k - 1}"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
        value = F.coalesce(F.col(f"_p{k}"), alpha * value if backoff else F.lit(0.0))
    return out.select(*asked.columns, value.alias("prob"))


def asked_of(seqs: DataFrame, n: int, pad: str = "") -> DataFrame:
    """Every token, and the pads after the last, with the n - 1 tokens before it."""
    grams = seqs.select("*", F.explode(X.padded_ngrams(F.col("tokens"), n, pad)).alias("_g")).drop("tokens")
    return grams.withColumn("context", F.slice("_g", 1, n - 1) if n > 1 else F.array().cast("array<string>")).withColumn("token", F.element_at("_g", -1)).drop("_g")


def entropy(model: NgramModel, seqs: DataFrame) -> DataFrame:
    """Cross-entropy in bits per predicted token, and perplexity."""
    p = score(model, asked_of(seqs, model.n, model.pad))
    return p.agg((-F.avg(prob.log_prob(F.col("prob")))).alias("entropy")).withColumn("perplexity", F.pow(F.lit(2.0), "entropy"))


def known(model: NgramModel, asked: DataFrame) -> DataFrame:
    """Those of ``asked (context, token)`` that were seen in training."""
    top = model.grams[model.n].select(F.col("cond").alias("context"), F.col("sample").alias("token"))
    return asked.join(top, ["context", "token"], "left_semi")


def generate(model: NgramModel, length: int, context: tuple[str, ...] = (), seed: int = 0) -> list[str]:
    """A random text: each token is drawn in the longest context that was seen; "." where none was.

    Reads only the rows of the contexts it meets.
    """
    rng, out = random.Random(seed), list(context)
    for _ in range(length):
        token = "."
        for k in range(model.n, 0, -1):
            own = tuple(out[len(out) - (k - 1) :]) if k > 1 else ()
            if len(own) < k - 1:
                continue
            cond = F.array(*[F.lit(t) for t in own]) if own else F.array().cast("array<string>")
            rows = model.grams[k].filter(F.col("cond") == cond).orderBy(F.desc("cnt"), "sample").select("sample", "cnt").collect()
            if rows:
                at = rng.random() * sum(r["cnt"] for r in rows)
                for r in rows:
                    at -= r["cnt"]
                    if at < 0:
                        break
                token = r["sample"]
                break
        out.append(token)
    return out[len(context) :]
