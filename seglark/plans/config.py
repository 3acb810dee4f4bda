"""Options of the segmenter."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from ..functions.text import DIPHTHONGS, VOWELS


@dataclass(frozen=True)
class SegmenterConfig:
    """All options, with the usual defaults.

    ``initial_count`` and ``bad_score`` are decimals as text, taken exactly.
    """

    # delimiters and symbols
    word_delimiter: str = " "
    utterance_delimiter: str = "$"
    vowels: str = VOWELS
    diphthongs: tuple[str, ...] = DIPHTHONGS
    # cues
    no_lexicon: bool = False
    phoneme_window: int = 1
    syllable_window: int = 0
    feature_window: int = 0
    score_piecewise: bool = False
    mbdp: bool = False
    joint_probability: bool = False
    subseq_denominator: bool = False
    type_denominator: bool = False
    token_phonotactics: bool = False
    hypothetical_phonotactics: bool = False
    ignore_word_boundary: bool = False
    initial_count: str = "0.0001"
    initialize_syllables: bool = False
    bad_score: str = "0.0"
    unseen_subseq: str = "0.5"
    require_syllabic: bool = False
    katz_backoff: bool = False
    witten_bell: bool = False
    # combination
    weighted_sum: bool = False
    weights: tuple[float, ...] = (0.2, 0.2, 0.2, 0.2, 0.2)
    # search
    n_best: int = 1
    max_word_len: int | None = None
    # processing
    supervised_for: int = 0
    semisupervised: bool = False
    wait_until: int = 0
    wait_for_stable: bool = False
    stability_threshold: str = "0.99"
    utterance_limit: int = 0
    uniform_phonotactics: bool = False
    gold_phonotactics: bool = False
    # output
    line_numbers: bool = False
    print_utterance_delimiter: bool = False
    # arithmetic: exact rationals, or doubles
    exact: bool = True

    def __post_init__(self):
        if self.mbdp and float(self.initial_count):
            object.__setattr__(self, "initial_count", "0")
        if len(self.word_delimiter) != 1 or len(self.utterance_delimiter) != 1:
            raise ValueError("delimiters are single symbols")
        if min(self.phoneme_window, self.syllable_window, self.feature_window, self.supervised_for, self.wait_until, self.utterance_limit) < 0 or self.n_best < 1:
            raise ValueError("windows and limits can't be negative, n_best starts at 1")

    @classmethod
    def from_flags(cls, **flags) -> SegmenterConfig:
        """From option names in camel case, such as ``phonemeWindow=2`` or ``MBDP=True``."""
        known = {f.name.replace("_", "").lower(): f.name for f in fields(cls)}
        known |= {"semisupervisedupdating": "semisupervised", "waituntilutterance": "wait_until", "waitforstablephonemedist": "wait_for_stable", "printutterancedelimiter": "print_utterance_delimiter", "nbest": "n_best"}
        out = {}
        for name, value in flags.items():
            key = name.replace("_", "").lower()
            if key not in known:
                raise ValueError(f"unknown option: {name}")
            out[known[key]] = value
        return cls(**out)

    def but(self, **changes) -> SegmenterConfig:
        return replace(self, **changes)
