"""Scores of candidate words under a frozen model, as joins.

Candidates are distinct words; scores are natural logarithms (``NO_SCORE`` for
zero).  The tables of a model, ``lexicon (word, cnt)`` and ``ngrams (n, gram,
cnt)``, stay tables: a score is a left join with counts and a sum per word.
Constants that depend on totals come from one-row aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.config import SegmenterConfig
from ..session import ship
from ..sources import corpus as C

NO_SCORE = -1e300


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(NO_SCORE))


def summed(x: Column) -> Column:
    """Sum of logarithms of which one may be ``NO_SCORE``."""
    return F.when(F.min(x) <= NO_SCORE, F.lit(NO_SCORE)).otherwise(F.sum(x))


def both(a: Column, b: Column) -> Column:
    return F.when((a <= NO_SCORE) | (b <= NO_SCORE), F.lit(NO_SCORE)).otherwise(a + b)


@dataclass
class FrozenModel:
    config: SegmenterConfig
    lexicon: DataFrame
    ngrams: DataFrame
    #: word tokens; word types with the utterance delimiter; symbols with the delimiter
    n_words: int
    n_types: int
    n_symbols: int
    #: per order: total of counts, and the count of an n-gram not seen
    totals: dict[int, float]
    initial: dict[int, float]


def padding(config: SegmenterConfig, window: int) -> str:
    return config.word_delimiter * max(1, window - 1)


def word_grams(config: SegmenterConfig, word: Column, n: int, window: int) -> Column:
    """n-grams of a word: padded on the right for single symbols, on both sides for longer ones."""
    pad = "" if config.ignore_word_boundary else padding(config, window)
    return X.char_ngrams(word, n, "" if n == 1 else pad, pad)


def uniform_start(config: SegmenterConfig, types: int, window: int) -> tuple[dict[int, float], dict[int, float]]:
    """Total and initial count per order of a uniform start over ``types`` units."""
    amount = float(config.initial_count)
    initial = {n: amount * types ** (window - n) * (window - n + 1) for n in range(1, window + 1)}
    return {n: X.falling_factorial(types, n) * c for n, c in initial.items()}, initial


def ngram_counts(words: DataFrame, config: SegmenterConfig, window: int) -> DataFrame:
    """``(n, gram, cnt)`` of ``words (word, w)``, orders 1 to ``window`` in one pass."""
    per_n = [X.tagged(word_grams(config, F.col("word"), n, window), n, "gram") for n in range(1, window + 1)]
    return words.select("w", F.explode(F.concat(*per_n)).alias("x")).groupBy("x.n", "x.gram").agg(F.sum("w").alias("cnt"))


def train(corpus: DataFrame, config: SegmenterConfig = SegmenterConfig(), keep: bool = False) -> FrozenModel:
    """Counts of a segmented corpus: n-grams over word types, or tokens with ``token_phonotactics``.

    With ``keep`` the lexicon is counted once and persisted, until the caller
    takes it back by ``lexicon.unpersist()``.
    """
    tokens = C.word_tokens(corpus, config.word_delimiter)
    lexicon = tokens.groupBy("word").agg(F.count("*").alias("cnt"))
    lexicon = lexicon.persist() if keep else lexicon
    window = max(1, config.phoneme_window)
    words = lexicon.select("word", (F.col("cnt") if config.token_phonotactics else F.lit(1)).alias("w"))
    n_symbols = C.inventory(lexicon.select(F.col("word").alias("text")), config.word_delimiter).count()  # symbols of words are all there are
    n_words, n_types = lexicon.agg(F.coalesce(F.sum("cnt"), F.lit(0)), F.count("*")).first()
    totals, initial = uniform_start(config, n_symbols, window)
    ngrams = ngram_counts(words, config, window)
    first = F.lit(0.0)
    for n, c in initial.items():
        first = F.when(F.col("n") == n, F.lit(c)).otherwise(first)
    for r in ngrams.groupBy("n").agg(F.sum("cnt").alias("t")).collect():  # one row per order
        totals[r["n"]] += float(r["t"])
    ngrams = ngrams.select("n", "gram", (F.col("cnt") + first).alias("cnt"))
    return FrozenModel(config, lexicon, ngrams, int(n_words), int(n_types) + 1, n_symbols, totals, initial)


#: Substrings up to this length are counted by themselves; longer ones beside those with the same beginning.
HEAD = 4


def subsequence_counts(corpus: DataFrame, max_len: int | None = None, delim: str = " ") -> DataFrame:
    """``(gram, subs)``: how often each string occurs in stripped utterances.

    Each string is the beginning of a suffix.  Suffixes (cut to ``max_len``)
    are dealt out by their first symbols and sorted; then strings that occur
    together lie side by side, and each is written once with its number of
    occurrences.  What moves is a row a symbol, not a row a substring.
    """
    spark = corpus.sparkSession
    ship(spark)
    texts = corpus.select(X.strip_delimiters(F.col("text"), delim).alias("t")).filter(F.length("t") > 0).groupBy("t").agg(F.count("*").alias("k"))
    head = HEAD if max_len is None else min(HEAD, max_len)
    starts = texts.select("t", "k", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("i"))
    heads = starts.groupBy(F.substring("t", F.col("i"), F.lit(head)).alias("head")).agg(F.sum("k").alias("k"))
    short = heads.select("head", "k", F.explode(F.sequence(F.lit(1), F.length("head"))).alias("n"))
    short = short.groupBy(F.substring("head", F.lit(1), F.col("n")).alias("gram")).agg(F.sum("k").alias("subs"))
    if head == max_len:
        return short
    rest = F.col("t").substr(F.col("i"), F.length("t") if max_len is None else F.lit(max_len))
    longer = texts.filter(F.length("t") > head).select("t", "k", F.explode(F.sequence(F.lit(1), F.length("t") - head)).alias("i"))
    longer = longer.select(F.substring("t", F.col("i"), F.lit(head)).alias("head"), rest.alias("suffix"), "k")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    longer = longer.repartition(n, "head").sortWithinPartitions("suffix").select("suffix", "k")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows ``(text, low, high, subs)``: the beginnings of ``text`` from low to high symbols occur ``subs`` times."""
        last, total, open_ = "", 0, []  # open_: (length from which, occurrences before) of beginnings of ``last``
        out: list[tuple] = []

        def close(keep: int) -> None:
            """Beginnings of ``last`` of more than ``keep`` symbols don't come again."""
            end = len(last)
            while open_ and end > keep:
                low, before = open_[-1]
                out.append((last[:end], max(low, keep + 1), end, total - before))
                end = max(low, keep + 1) - 1
                if low > keep:
                    open_.pop()

        for batch in batches:
            for s, k in zip(batch["suffix"], batch["k"]):
                if s == last:
                    total += k
                    continue
                same, top = 0, min(len(s), len(last))
                if s[:top] == last[:top]:
                    same = top
                else:
                    while same < top:  # halves of what is left
                        half = (same + top + 1) // 2
                        if s[same:half] == last[same:half]:
                            same = half
                        else:
                            top = half - 1
                same = max(same, head) if last[:head] == s[:head] else head
                close(same)
                if last[:head] != s[:head]:
                    open_.clear()
                if len(s) > same:
                    open_.append((same + 1, total))
                last, total = s, total + k
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["text", "low", "high", "subs"])
                out.clear()
        close(head)
        yield pd.DataFrame(out, columns=["text", "low", "high", "subs"])

    found = longer.mapInPandas(spread, "text string, low int, high int, subs long")
    found = found.select("text", "subs", F.explode(F.sequence("low", "high")).alias("n")).select(F.substring("text", F.lit(1), F.col("n")).alias("gram"), "subs")
    return short.unionByName(found)


def familiar(words: DataFrame, model: FrozenModel, subseqs: DataFrame | None = None) -> DataFrame:
    """``(word, known, familiar)``: the score of words in the lexicon, ``NO_SCORE`` for others."""
    config, c = model.config, F.col("cnt").cast("double")
    out = words.join(model.lexicon, "word", "left")
    if config.mbdp and not config.witten_bell:
        value = (c + 1) / (model.n_words + 1) * F.pow(c / (c + 1), 2)
    elif config.subseq_denominator and not config.witten_bell:
        if subseqs is None:
            raise ValueError("subsequence counts are needed")
        out = out.join(subseqs.select(F.col("gram").alias("word"), "subs"), "word", "left")
        value = c / F.col("subs")
    elif config.witten_bell:
        value = c / (model.n_words + model.n_types)
    else:
        value = c / (model.n_words + (model.n_types - 1 if config.type_denominator else 0))
    known = F.col("cnt").isNotNull()
    # with Witten-Bell, what all unknown words share
    other = ln(F.lit((model.n_types - 1) / max(1, model.n_words + model.n_types - 1))) if config.witten_bell else F.lit(NO_SCORE)
    return out.select("word", known.alias("known"), F.when(known, ln(value)).otherwise(other).alias("familiar"))


def phoneme(words: DataFrame, model: FrozenModel, subseqs: DataFrame | None = None) -> DataFrame:
    """``(word, phoneme)``: the n-gram score of every word."""
    config, w = model.config, max(1, model.config.phoneme_window)
    delim = config.word_delimiter
    each = word_grams(config, F.col("word"), w, w)
    grams = words.select("word", F.explode_outer(each).alias("gram"))
    if config.hypothetical_phonotactics:
        # a row for each distinct n-gram of a word, counted within the word
        counted = F.transform(F.array_distinct("each"), lambda g: F.struct(g.alias("gram"), F.size(F.filter("each", lambda x: x == g)).alias("mine")))
        grams = words.select("word", each.alias("each")).select("word", F.size("each").alias("size"), F.explode_outer(counted).alias("x")).select("word", "size", "x.gram", F.coalesce("x.mine", F.lit(1)).alias("mine"))
    grams = grams.withColumn("prefix", F.substring("gram", 1, w - 1))
    top = model.ngrams.filter(F.col("n") == w).select("gram", "cnt")
    lower = model.ngrams.filter(F.col("n") == w - 1).select(F.col("gram").alias("prefix"), F.col("cnt").alias("under"))
    grams = grams.join(F.broadcast(top) if w == 1 else top, "gram", "left")  # at most the alphabet
    grams = grams.join(lower, "prefix", "left") if w > 1 else grams.withColumn("under", F.lit(None).cast("double"))
    own = F.coalesce("cnt", F.lit(model.initial[w]))
    under = F.coalesce("under", F.lit(model.initial.get(w - 1, 0.0)))
    total, unit_total = F.lit(model.totals[w]), F.lit(model.totals[1])
    delims = model.ngrams.filter((F.col("n") == 1) & (F.col("gram") == delim)).agg(F.max("cnt")).first()[0] or model.initial[1]
    delim_count = F.lit(float(delims))
    if config.hypothetical_phonotactics:
        # what the counts would be with this word: its own n-grams come on top
        own, total = own + F.col("mine"), total + F.col("size")
        if w > 1:
            below = words.select("word", F.explode(word_grams(config, F.col("word"), w - 1, w)).alias("prefix")).groupBy("word", "prefix").agg(F.count("*").alias("mine_under"))
            grams = grams.join(below, ["word", "prefix"], "left")
            under = under + F.coalesce("mine_under", F.lit(0))
        else:
            unit_total = total
            delim_count = delim_count + (0 if config.ignore_word_boundary else 1)
    if config.subseq_denominator:
        if subseqs is None:
            raise ValueError("subsequence counts are needed")
        value = _by_subsequence(grams, model, subseqs, own, under, w)
        grams, p = value
    elif config.joint_probability:
        p = own / total
    else:
        p = own / (F.nullif(under, F.lit(0.0)) if w > 1 else total)
    times = F.col("mine") if config.hypothetical_phonotactics else F.lit(1)
    grams = grams.select("word", (ln(F.coalesce(p, F.lit(0.0))) * times).alias("x"), F.col("gram").isNull().alias("short"), (delim_count / unit_total).alias("ends"))
    out = grams.groupBy("word").agg(summed(F.col("x")).alias("x"), F.bool_or("short").alias("short"), F.max("ends").alias("ends"))
    base = F.lit(0.0) if config.mbdp or config.no_lexicon else ln(F.lit(model.n_types / (model.n_types + model.n_words)))
    if w == 1:
        base = base - F.ln(1 - F.col("ends"))
    if config.mbdp:
        import math

        types = model.n_types
        base = base + ln(F.lit(6 / math.pi**2 * types / (model.n_words + 1) * ((types - 1) / types) ** 2))
    return out.select("word", F.when(F.col("short"), F.lit(NO_SCORE)).otherwise(both(F.col("x"), base)).alias("phoneme"))


def _by_subsequence(grams: DataFrame, model: FrozenModel, subseqs: DataFrame, own: Column, under: Column, w: int) -> tuple[DataFrame, Column]:
    config, delim = model.config, model.config.word_delimiter

    def share(df: DataFrame, gram: str, n: int, count: Column, name: str) -> DataFrame:
        inner = F.regexp_replace(gram, f"^[{delim}]+|[{delim}]+$", "")
        seen = subseqs.select(F.col("gram").alias("_inner"), F.col("subs").alias("_subs"))
        df = df.withColumn("_inner", inner).join(seen, "_inner", "left")
        first = F.lit(0.0)
        for k, c in model.initial.items():
            first = F.when(F.least(F.length("_inner"), F.lit(w)) == k, F.lit(c)).otherwise(first)
        value = F.when((F.lit(n) == 1) | (F.length("_inner") == 0), 1.0).when(F.col("_subs").isNull(), float(config.unseen_subseq)).otherwise(count / (F.col("_subs") + first))
        return df.withColumn(name, value).drop("_inner", "_subs")

    grams = share(grams, "gram", w, own, "_joint")
    if config.joint_probability or w == 1:
        return grams, F.col("_joint")
    grams = share(grams, "prefix", w - 1, under, "_prefix")
    return grams, F.col("_joint") / F.nullif("_prefix", F.lit(0.0))


def pair_counts(words: DataFrame, config: SegmenterConfig) -> tuple[DataFrame, DataFrame]:
    """``(pair, cnt)`` and ``(first, cnt)`` of precedence pairs in words with their boundaries."""
    d = F.lit("" if config.ignore_word_boundary else config.word_delimiter)
    pairs = words.select("w", F.explode(X.precedence_pairs(F.concat(d, "word", d), config.word_delimiter)).alias("pair"))
    pairs = pairs.groupBy("pair").agg(F.sum("w").alias("cnt"))
    return pairs, pairs.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("cnt").alias("cnt"))


#: Up to so many symbols, all pair probabilities are sent along as one value (its square in doubles).
MAX_INVENTORY = 300


def pair_probabilities(corpus: DataFrame, config: SegmenterConfig, symbols: DataFrame) -> DataFrame:
    """``(first, symbol, x)``: log probability of a symbol after another, for all pairs of ``symbols``."""
    amount, n = float(config.initial_count), symbols.count()
    types = C.word_types(corpus, config.word_delimiter).select("word", F.lit(1).alias("w"))
    pairs, firsts = pair_counts(types, config)
    every = symbols.select(F.col("symbol").alias("first")).crossJoin(F.broadcast(symbols))  # an alphabet with itself
    every = every.withColumn("pair", F.concat("first", "symbol")).join(pairs.select("pair", F.col("cnt").alias("c")), "pair", "left")
    every = every.join(firsts.select("first", F.col("cnt").alias("f")), "first", "left")
    p = (F.coalesce("c", F.lit(0)) + amount) / F.nullif(F.coalesce("f", F.lit(0)) + amount * n * 2, F.lit(0.0))
    return every.select("first", "symbol", ln(F.coalesce(p, F.lit(0.0))).alias("x"))


def piecewise(words: DataFrame, corpus: DataFrame, config: SegmenterConfig) -> DataFrame:
    """``(word, piecewise)``: each symbol's probability after the set of those before it, over all symbols' in its place.

    With an ordinary alphabet every word is scored in its row, from one small
    matrix of pair probabilities; beyond ``MAX_INVENTORY`` symbols the distinct
    questions (set, symbol) are answered by joins.  Symbols of words that the
    corpus doesn't have are part of the alphabet.
    """
    d = F.lit("" if config.ignore_word_boundary else config.word_delimiter)
    own = words.select(F.col("word").alias("text"))
    symbols = C.inventory(corpus.select("text").unionByName(own), config.word_delimiter)
    table = pair_probabilities(corpus, config, symbols)
    sets = X.preceding_sets(F.concat(d, "word", d))
    if symbols.count() > MAX_INVENTORY:
        return _piecewise_joined(words.select("word", F.posexplode(sets).alias("at", "x")), table, symbols)
    cells = {(r["first"], r["symbol"]): r["x"] for r in table.collect()}  # at most MAX_INVENTORY squared
    names = sorted({a for a, _ in cells})
    at = {c: i for i, c in enumerate(names)}
    given = np.array([[cells[a, b] for b in names] for a in names]).reshape(len(names), len(names))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(word: str) -> float:
            own, seen, total = [at[c] for c in word], set(), 0.0
            added = np.zeros(len(names))
            for k, i in enumerate(own):
                if k:
                    top = added.max()
                    if added[i] <= NO_SCORE:
                        return NO_SCORE
                    total += added[i] - top - np.log(np.exp(added - top).sum())
                if i not in seen:
                    seen.add(i)
                    added = np.maximum(added + given[i], NO_SCORE)
            return total

        for s in parts:
            yield s.map(one)

    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = words.repartition(parts, "word")  # few bytes, but much to compute for each
    return words.select("word", score(F.concat(d, "word", d)).alias("piecewise"))


def _piecewise_joined(steps: DataFrame, table: DataFrame, symbols: DataFrame) -> DataFrame:
    steps = steps.select("word", "at", "x.symbol", F.array_join("x.before", "\0").alias("before"))
    asked = steps.select("before").distinct().select("before", F.explode(F.split("before", "\0")).alias("first"))
    each = asked.join(table, "first").groupBy("before", "symbol").agg(summed(F.col("x")).alias("x"))
    total = each.groupBy("before").agg(F.max("x").alias("top"), F.sum(F.exp("x")).alias("t"))
    value = F.when((F.col("x") > NO_SCORE) & (F.col("t") > 0), F.col("x") - F.ln("t")).otherwise(F.lit(NO_SCORE))
    answered = each.join(total, "before").select("before", "symbol", value.alias("x"))
    return steps.join(answered, ["before", "symbol"]).groupBy("word").agg(summed(F.col("x")).alias("piecewise"))


def stability(counts: DataFrame, threshold: float = 0.99) -> DataFrame:
    """``(step, stable)`` from ``(step, symbol, cnt)``: whether no count grew by more than the threshold since the step before, latched."""
    from pyspark.sql import Window

    before = F.lag("cnt").over(Window.partitionBy("symbol").orderBy("step"))
    rows = counts.withColumn("ok", F.coalesce(before / F.nullif("cnt", F.lit(0)) > threshold, F.lit(False)))
    per = rows.groupBy("step").agg(F.bool_and("ok").alias("ok"))
    return per.select("step", F.bool_or("ok").over(Window.orderBy("step")).alias("stable"))
