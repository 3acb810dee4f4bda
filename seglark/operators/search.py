"""Search for the best segmentation of stripped utterances."""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.frozen import FrozenSearch
from ..plans.learner import Segmenter
from ..session import ship
from .cues import FrozenModel

#: A model of more than this many bytes is not sent to tasks; score by joins instead.
MAX_MODEL = 256 << 20


def candidates(utts: DataFrame, max_word_len: int | None = None, delim: str = " ") -> DataFrame:
    """``(utt_id, s, e, word)``: all substrings of the stripped utterances."""
    text = X.strip_delimiters(F.col("text"), delim)
    return X.each_substring(utts.select("utt_id", text.alias("t")), "t", max_word_len)


def candidate_totals(utts: DataFrame, max_word_len: int | None = None, delim: str = " ") -> DataFrame:
    """``(utt_id, n, symbols)``: how many :func:`candidates` an utterance has and how long they are together.

    A text of L symbols has L - k + 1 substrings of length k, so both sums
    follow from L; utterances without symbols have no candidates and no row.
    """
    size = F.length(X.strip_delimiters(F.col("text"), delim)).cast("long")
    most = F.col("size") if max_word_len is None else F.least("size", F.lit(max_word_len).cast("long"))
    sums = utts.select("utt_id", size.alias("size")).filter("size > 0").select("utt_id", "size", most.alias("m"))
    # sums over k = 1..m of L - k + 1, and of k (L - k + 1)
    n = F.expr("m * (size + 1) - m * (m + 1) div 2")
    symbols = F.expr("m * (m + 1) div 2 * (size + 1) - m * (m + 1) * (2 * m + 1) div 6")
    return sums.groupBy("utt_id").agg(F.sum(n).alias("n"), F.sum(symbols).alias("symbols"))


def viterbi(scored: DataFrame) -> DataFrame:
    """``(utt_id, offsets, score)`` from ``(utt_id, s, e, score)`` with logarithms.

    best[e] is the greatest best[s] + score(s, e); of equals the smallest s,
    that is the longest last word.  Candidates are grouped per utterance, an
    array per end, and one fold over the ends carries best scores and back
    pointers.
    """
    ends = scored.groupBy("utt_id", "e").agg(F.sort_array(F.collect_list(F.struct("s", "score"))).alias("c"))
    whole = ends.groupBy("utt_id").agg(F.sort_array(F.collect_list(F.struct("e", "c"))).alias("ends"))
    start = F.struct(F.array(F.lit(0.0)).alias("best"), F.array(F.lit(0)).alias("back"))

    def step(a, x):
        tried = F.transform(x["c"], lambda c: F.greatest(F.get(a["best"], c["s"]) + c["score"], F.lit(-1e300)))
        picked = F.transform(F.array(tried), lambda t: F.struct(F.array_max(t).alias("v"), F.get(x["c"], (F.array_position(t, F.array_max(t)) - 1).cast("int"))["s"].alias("s")))[0]
        return F.transform(F.array(picked), lambda p: F.struct(F.concat(a["best"], F.array(p["v"])).alias("best"), F.concat(a["back"], F.array(p["s"])).alias("back")))[0]

    found = whole.select("utt_id", F.aggregate("ends", start, step).alias("f"))
    found = found.select("utt_id", F.element_at("f.best", -1).alias("score"), F.col("f.back").alias("back"))
    # from the last offset back to 0: at most one step per symbol
    trace = F.aggregate(
        F.sequence(F.lit(1), F.size("back")),
        F.array(F.size("back") - 1),
        lambda path, _: F.when(F.element_at(path, 1) > 0, F.concat(F.array(F.get("back", F.element_at(path, 1))), path)).otherwise(path),
    )
    return found.select("utt_id", trace.alias("offsets"), "score")


def segment_with(utts: DataFrame, model: Segmenter | FrozenSearch, n_best: int = 1) -> DataFrame:
    """``(utt_id, rank, weight, words)`` under a frozen model held in memory.

    Utterances are searched where they are, without a shuffle, in batches if
    :class:`FrozenSearch` can, else one by one.  ``weight`` is the product over
    that of the best path.  The model is broadcast and may have ``MAX_MODEL``
    bytes; larger ones are scored by joins (:func:`viterbi` over
    ``combine.score_words``).
    """
    spark = utts.sparkSession
    ship(spark)
    utts = utts.select(F.col("utt_id").cast("long").alias("utt_id"), "text")
    schema = "utt_id long, rank int, weight double, words array<string>"
    batch = model if isinstance(model, FrozenSearch) else FrozenSearch.of(model) if n_best == 1 else None
    if batch is not None:
        if n_best > 1:
            raise ValueError("batches are searched for the best path only")
        if batch.nbytes > MAX_MODEL:
            raise ValueError("the model is too large to send to tasks: score candidates by joins")
        shared = spark.sparkContext.broadcast(batch)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                words, at = shared.value.segment(rows["text"])
                n = len(at)
                yield pa.RecordBatch.from_arrays([rows["utt_id"].take(pa.array(at)), pa.array(np.ones(n, np.int32)), pa.array(np.ones(n)), words], ["utt_id", "rank", "weight", "words"])

        return utts.mapInArrow(search, schema)
    raw = pickle.dumps(model)
    if len(raw) > MAX_MODEL:
        raise ValueError("the model is too large to send to tasks: score candidates by joins")
    shared = spark.sparkContext.broadcast(raw)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Segmenter = pickle.loads(shared.value)
        for rows in batches:
            out = []
            for i, line in zip(rows["utt_id"], rows["text"]):
                text = (line or "").replace(own.delim, "")
                paths = own.n_best(text, n_best) if n_best > 1 else ([(own.number(1), own.search(text))] if text else [])
                top = paths[0][0] if paths else 0
                for rank, (p, path) in enumerate(paths, 1):
                    weight = float(p / top) if top else float(rank == 1)
                    out.append((i, rank, weight, [text[a:b] for a, b in zip(path, path[1:])]))
                if len(own._cache) > 500_000:
                    own._cache.clear()
                own.pending.clear()
            yield pd.DataFrame(out, columns=["utt_id", "rank", "weight", "words"])

    return utts.mapInPandas(run, schema)


def n_best(scored: DataFrame, k: int) -> DataFrame:
    """``(utt_id, paths)``: the k best as (score, offsets), from ``(utt_id, s, e, score)`` with logarithms."""
    ends = scored.groupBy("utt_id", "e").agg(F.sort_array(F.collect_list(F.struct("s", "score"))).alias("c"))
    whole = ends.groupBy("utt_id").agg(F.sort_array(F.collect_list(F.struct("e", "c"))).alias("ends"))
    start = F.array(F.array(F.struct(F.lit(0.0).alias("loss"), F.array(F.lit(0)).alias("path"))))

    def step(table, x):
        grown = F.flatten(F.transform(x["c"], lambda c: F.transform(F.get(table, c["s"]), lambda p: F.struct((p["loss"] - c["score"]).alias("loss"), F.concat(p["path"], F.array(x["e"])).alias("path")))))
        return F.concat(table, F.array(F.slice(F.sort_array(grown), 1, k)))

    best = F.element_at(F.aggregate("ends", start, step), -1)
    return whole.select("utt_id", F.transform(best, lambda p: F.struct((-p["loss"]).alias("score"), p["path"].alias("offsets"))).alias("paths"))


def load(model: FrozenModel, max_rows: int = 5_000_000) -> Segmenter:
    """A frozen model's tables in memory; refused beyond ``max_rows`` words or n-grams."""
    for table in (model.lexicon, model.ngrams):
        if table.limit(max_rows + 1).count() > max_rows:
            raise ValueError("the model is too large to hold: score candidates by joins")
    own = _without_words(model, model.ngrams.toLocalIterator())
    own.lexicon.update((r["word"], own.number(r["cnt"])) for r in model.lexicon.toLocalIterator())
    return own


def _without_words(model: FrozenModel, ngrams: Iterable[Row]) -> Segmenter:
    own = Segmenter(model.config)
    own.total = own.number(model.n_words)
    cue = own.phoneme
    for n in range(1, cue.window + 1):
        cue.totals[n - 1], cue.initial[n - 1] = own.number(model.totals[n]), own.number(model.initial[n])
    for r in ngrams:
        if r["n"] <= cue.window:
            cue.counts[r["n"] - 1][r["gram"]] = own.number(r["cnt"])
    return own


def load_batch(model: FrozenModel) -> FrozenSearch | Segmenter:
    """A frozen model in memory for the search of whole batches, where its options have one; else :func:`load`.

    The words come as one table of columns and go into a trie, of any number
    of them; :func:`segment_with` says what it can send.
    """
    own = Segmenter(model.config)
    if model.config.exact or model.config.max_word_len is not None or model.config.n_best > 1 or not own._by_symbols():
        return load(model)
    own = _without_words(model, model.ngrams.collect())  # single symbols: an alphabet
    table = model.lexicon.select(F.col("word"), F.col("cnt").cast("double").alias("cnt")).toArrow()
    words = pa.concat_arrays([x.cast(pa.large_string()) for x in table["word"].chunks]) if table.num_rows else pa.array([], pa.large_string())
    counts = table["cnt"].to_numpy()
    mark = model.config.utterance_delimiter
    if not pc.any(pc.equal(words, mark)).as_py():  # it is in every lexicon
        words, counts = pa.concat_arrays([words, pa.array([mark], pa.large_string())]), np.append(counts, 0.0)
    costs = own.symbol_costs(len(words))
    return FrozenSearch(own.delim, words, counts, costs) if FrozenSearch.finite(costs) else load(model)


def description_length(words) -> int:
    """Words of a text, and the length of its lexicon written with blanks between."""
    return len(words) + len(" ".join(set(words)))


def objective(words):
    """:func:`description_length` as a Column over an array of words."""
    kinds = F.array_distinct(words)
    return F.size(words) + F.length(F.array_join(kinds, " "))


def cut_at(text: str, bits: str) -> list[str]:
    ends = [i + 1 for i, b in enumerate(bits) if b == "1"] + [len(text)]
    return [text[a:b] for a, b in zip([0, *ends], ends) if b > a]


def boundary_cost(text: str, ends: np.ndarray) -> int:
    """:func:`description_length` of ``text`` cut after the places where ``ends`` holds; its last place always ends a word."""
    stops = np.append(np.flatnonzero(ends[: len(text) - 1]) + 1, len(text))
    kinds = {text[a:b] for a, b in zip(np.append(0, stops[:-1]), stops)} - {""}
    words = len(stops) if text else 0
    return words + sum(map(len, kinds)) + max(len(kinds) - 1, 0)


def temperatures(first: float, cooling: float) -> list[float]:
    """From ``first`` down, each a ``cooling``-th of the one before, all above one half."""
    steps = math.ceil(math.log(2 * first, cooling)) if first > 0.5 else 0
    return [t for t in (first / cooling**k for k in range(steps + 1)) if t > 0.5]


def anneal(texts: DataFrame, iterations: int = 100, cooling: float = 1.2, seed: int = 0) -> DataFrame:
    """``(utt_id, bits, words, cost)`` by simulated annealing of ``(utt_id, text, bits)``.

    The temperatures go from the number of places down to one half.  At each,
    ``iterations`` guesses are made from the best segmentation so far, by as
    many inversions at random places as the temperature says (a place that is
    drawn twice stays), and the cheapest of them is taken if it costs less.
    Each text has its own random numbers from ``seed`` and its id.
    """
    ship(texts.sparkSession)

    def settle(key: str, text: str, bits: str) -> tuple[str, int]:
        rng = np.random.default_rng([seed & 0xFFFFFFFF, zlib.crc32(key.encode())])
        best = np.array(list(bits), int)
        cost = boundary_cost(text, best)
        for heat in temperatures(float(len(bits)), cooling):
            places = rng.integers(0, len(best), (iterations, round(heat)))
            turns = np.zeros((iterations, len(best)), int)
            np.add.at(turns, (np.arange(iterations)[:, None], places), 1)
            guesses = (best + turns) % 2
            costs = np.array([boundary_cost(text, g) for g in guesses])
            if costs.min(initial=cost) < cost:
                best, cost = guesses[costs.argmin()], int(costs.min())
        return "".join(map(str, best)), cost

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            settled = [settle(str(i), text, bits) for i, text, bits in zip(rows["utt_id"], rows["text"], rows["bits"])]
            found = rows[["utt_id"]].assign(bits=[b for b, _ in settled])
            found["words"] = [cut_at(text, b) for text, b in zip(rows["text"], found["bits"])]
            yield found.assign(cost=[c for _, c in settled])

    return texts.select("utt_id", "text", "bits").mapInPandas(run, "utt_id long, bits string, words array<string>, cost long")
