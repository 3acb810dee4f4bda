"""Combination of cue scores, as Columns over a table of scored candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.config import SegmenterConfig
from . import cues
from .cues import NO_SCORE, FrozenModel, both


def backed_off(config: SegmenterConfig, vowel: Column | None = None) -> Column:
    """Familiar score if known, else syllable score if there is one, else phoneme and piecewise scores.

    Reads the columns ``known, familiar, phoneme`` and, where the options ask
    for them, ``piecewise`` and ``syllable``.
    """
    rest = F.col("phoneme") if config.phoneme_window else F.lit(NO_SCORE)
    if config.score_piecewise:
        rest = both(rest, F.col("piecewise")) if config.phoneme_window else F.col("piecewise")
    if config.syllable_window:
        rest = F.when(F.col("syllable") > NO_SCORE, F.col("syllable")).otherwise(rest)
    if config.require_syllabic:
        has = vowel if vowel is not None else X.has_vowel(F.col("word"), config.vowels)
        rest = F.when(has, rest).otherwise(F.lit(NO_SCORE))
    if config.witten_bell:
        rest = both(rest, F.col("familiar"))
    return rest if config.no_lexicon else F.when(F.col("known"), F.col("familiar")).otherwise(rest)


def weighted(config: SegmenterConfig, names: Sequence[str] = ("familiar", "phoneme", "piecewise", "syllable", "feature")) -> Column:
    """Logarithm of the weighted sum of the scores; disabled cues count as the bad score."""
    on = {"familiar": not config.no_lexicon, "phoneme": config.phoneme_window > 0, "piecewise": config.score_piecewise, "syllable": config.syllable_window > 0, "feature": False}
    total = F.lit(0.0)
    for name, w in zip(names, config.weights):
        value = F.when(F.col(name) > NO_SCORE, F.exp(name)).otherwise(0.0) if on.get(name, True) else F.lit(float(config.bad_score))
        total = total + F.lit(float(w)) * value
    out = cues.ln(total)
    return F.when(X.has_vowel(F.col("word"), config.vowels), out).otherwise(F.lit(NO_SCORE)) if config.require_syllabic else out


def multiplied(names: Sequence[str]) -> Column:
    out = F.lit(0.0)
    for name in names:
        out = both(out, F.col(name))
    return out


def first_usable(cues_: Sequence[tuple[Column, Column]], bad: float = NO_SCORE) -> Column:
    """The score of the first cue whose condition holds: (condition, score) pairs."""
    out = F.lit(bad)
    for use, value in reversed(cues_):
        out = F.when(use, value).otherwise(out)
    return out


def score_words(words: DataFrame, corpus: DataFrame, model: FrozenModel, subseqs: DataFrame | None = None) -> DataFrame:
    """``(word, known, familiar, phoneme[, piecewise], score)`` of distinct words; every component stays for inspection."""
    config = model.config
    out = cues.familiar(words, model, subseqs)
    if config.phoneme_window:
        out = out.join(cues.phoneme(words, model, subseqs), "word")
    if config.score_piecewise:
        out = out.join(cues.piecewise(words, corpus, config), "word")
    if config.syllable_window:
        raise ValueError("syllable scores of a frozen model: use plans.learner.Segmenter with search.segment_with")
    return out.withColumn("score", weighted(config) if config.weighted_sum else backed_off(config))
