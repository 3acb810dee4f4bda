"""K-fold cross-validation of the segmenter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import learner
from ..plans.config import SegmenterConfig
from . import evaluate


def folds(corpus: DataFrame, k: int = 10) -> DataFrame:
    """``corpus`` with ``fold``: k parts of equally many consecutive utterances.

    Utterances beyond k times the fold size belong to no fold (null): they are
    neither trained nor tested on.  ``utt_id`` counts from 1 without gaps.
    """
    n = F.broadcast(corpus.agg(F.floor(F.count("*") / k).alias("size")))
    fold = F.floor((F.col("utt_id") - 1) / F.nullif("size", F.lit(0)))
    return corpus.crossJoin(n).withColumn("fold", F.when(fold < k, fold)).drop("size")


def plans(corpus: DataFrame, k: int = 10, test: int = 1, unsupervised: int = 0, shuffle_seed: int | None = None) -> DataFrame:
    """One run per fold: ``(run, utt_id, text, part, source)``, training folds first, then those to be tested.

    Run i trains on the k - test folds from i on, in a circle, of which the
    last ``unsupervised`` aren't supervised.  With ``shuffle_seed`` test folds
    come in random order.
    """
    own = folds(corpus, k).filter("fold is not null")
    runs = own.sparkSession.range(k).select(F.col("id").alias("i"))
    x = own.crossJoin(F.broadcast(runs)).withColumn("turn", F.pmod(F.col("fold") - F.col("i"), F.lit(k)))  # each row once per run: that is what k-fold means
    training = k - test
    part = F.when(F.col("turn") < training - unsupervised, "supervised").when(F.col("turn") < training, "unsupervised").otherwise("test")
    late = F.col("turn") if shuffle_seed is None else F.when(F.col("turn") < training, F.col("turn")).otherwise(training + F.pmod(F.xxhash64("i", "fold", F.lit(shuffle_seed)), F.lit(1 << 20)))
    place = late * (1 << 40) + F.col("utt_id")
    return x.select(F.concat(F.lit("fold"), F.col("i").cast("string")).alias("run"), place.alias("utt_id"), "text", part.alias("part"), F.col("utt_id").alias("source"))


def cross_validate(corpus: DataFrame, config: SegmenterConfig, k: int = 10, test: int = 1, unsupervised: int = 0, per_fold: bool = False, shuffle_seed: int | None = None) -> DataFrame:
    """The short report over all test folds, or one row per run with ``per_fold``.

    All runs are learnt side by side, one group each.
    """
    rows = plans(corpus, k, test, unsupervised, shuffle_seed).persist()
    size = folds(corpus, k).filter("fold = 0").count()
    runs = {f"fold{i}": config.but(supervised_for=size * (k - test - unsupervised)) for i in range(k)}
    found = learner.run(rows.select("run", "utt_id", "text"), runs).filter("weight = 1")
    tested = rows.filter("part = 'test'").join(found, ["run", "utt_id"])
    # an utterance of one run is an utterance of its own
    tested = tested.withColumn("utt_id", F.xxhash64("run", "source"))
    gold = evaluate.word_table(tested.select("utt_id", "text"))
    seen = evaluate.word_table(tested.select("utt_id", X.join_words(F.col("words")).alias("text")))
    if not per_fold:
        return evaluate.summary(gold, seen)
    run = tested.select("utt_id", "run")
    return evaluate.summary(gold.join(run, "utt_id"), seen.join(run, "utt_id"), by=["run"])
