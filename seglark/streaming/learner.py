"""The online learner over a stream of utterances."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import SegmenterConfig
from ..plans.learner import Segmenter
from ..session import ship

STATE = "model binary"
OUTPUT = "corpus_id string, utt_id long, weight double, words array<string>"


def segment_stream(stream: DataFrame, config: SegmenterConfig, symbols: str) -> DataFrame:
    """Segment ``(corpus_id, utt_id, text)`` as it arrives; counts are kept per corpus.

    Utterances of a micro-batch are taken in order of ``utt_id``; later ones
    with a lower id are taken when they come.  Nothing expires: a corpus's
    counts are its model.  ``symbols`` is the inventory, which a stream cannot
    be asked for in advance.  The state of a corpus is written to the state
    store once a batch and survives lost executors.
    """
    ship(stream.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        model = pickle.loads(state.get[0]) if state.exists else Segmenter(config, list(symbols))
        rows = pd.concat(list(batches)).sort_values("utt_id", kind="stable")
        out = []
        for i, text in zip(rows["utt_id"], rows["text"]):
            out += [(key[0], i, float(w), words) for w, words in model.segment(text or "")]
        model._cache.clear()
        state.update((pickle.dumps(model),))
        yield pd.DataFrame(out, columns=["corpus_id", "utt_id", "weight", "words"])

    return stream.groupBy("corpus_id").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")


def running_counts(stream: DataFrame, delim: str = " ") -> DataFrame:
    """Word counts over a stream of ``text``, updated as it goes (complete or update mode)."""
    return stream.select(F.explode(F.filter(F.split("text", delim), lambda w: w != "")).alias("sample")).groupBy("sample").agg(F.count("*").alias("cnt"))


def windowed_counts(stream: DataFrame, time: str, length: str, late: str, by: str) -> DataFrame:
    """Counts per tumbling window; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), by).agg(F.count("*").alias("cnt"))
