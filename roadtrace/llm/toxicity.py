"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of toxic documents that recur in them and are far more frequent
there than in ordinary ones, one on all other windows of ordinary documents.  A window is a word, repeated so that even a short one forms a compressible
block.  Each window is compressed twice: with the ordinary dictionary, and with the toxic dictionary laid behind
it.  Words that mark toxic text get shorter the second time.  What a pair of lengths says is calibrated on
labelled documents that had no part in the dictionaries: every pair of lengths gets a log likelihood ratio, and
a logistic regression on its sums over a document gives the score.

Scoring is a function of the text alone, so it runs wherever the row is: no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.common import Cached, group_sums, labelled_sample, lengths_to_bounds, logistic_fit

WORD = re.compile(r"[^\W\d_]+")
REPEATS = 4
LEVEL = 9
# Lengths are at most this; longer windows count as this long.
LONGEST = 63
# From so many times the share of ordinary documents on, a word of toxic ones marks them.
LIFT = 8
# Windows whose lengths a Python worker remembers, and characters of texts that are taken together.
REMEMBERED = 150_000
PASS = 1_000_000


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    ratios: np.ndarray
    weights: np.ndarray

    @property
    def key(self) -> str:
        parts = self.ordinary + b"|" + self.toxic + self.ratios.tobytes() + self.weights.tobytes()
        return hashlib.sha256(parts).hexdigest()


def _words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _window(word: str) -> bytes:
    return f" {' '.join([word] * REPEATS)} ".encode()


def _compressor(content: bytes):
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters.from_level(
        LEVEL,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    held.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress


def _lengths(ordinary: bytes, toxic: bytes):
    """A function from word to one number that holds both compressed lengths."""
    plain, both = _compressor(ordinary), _compressor(ordinary + toxic)

    def of(word: str) -> int:
        window = _window(word)
        return min(LONGEST, len(plain(window))) * (LONGEST + 1) + min(LONGEST, len(both(window)))

    return of


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples; the samples themselves, recurring ones last, if they are too few."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        ranked = sorted(Counter(samples).items(), key=lambda item: (item[1], item[0]))
        return b"".join(sample for sample, _ in ranked)[-size:]


def _features(texts, lengths, ratios: np.ndarray) -> np.ndarray:
    """Per text: sum of the ratios of its windows, the same per root of its length, and the largest one."""
    each = [_words(t) for t in texts]
    bounds = lengths_to_bounds(map(len, each))
    value = ratios[np.fromiter((lengths[w] for words in each for w in words), dtype=np.int64, count=bounds[-1])]
    total, size = group_sums(value, bounds), np.diff(bounds)
    top = np.zeros(len(each))
    full = size > 0
    if full.any():
        top[full] = np.maximum.reduceat(value, bounds[:-1][full])
    return np.column_stack([total / np.sqrt(size + 20.0), np.sign(total) * np.log1p(np.abs(total)), top])


def _marking(plain: list[list[str]], marked: list[list[str]], min_docs: int) -> set[str]:
    """Words of at least ``min_docs`` toxic documents that no ordinary one has, or ``LIFT`` times as small a share of them.

    Shares are smoothed by half a document, so that a word that a few ordinary documents quote, or that a wrong label
    brings among them, still marks.
    """
    usual, toxic = (Counter(w for words in docs for w in set(words)) for docs in (plain, marked))

    def lift(w: str) -> float:
        return (toxic[w] + 0.5) / (len(marked) + 1) * (len(plain) + 1) / (usual[w] + 0.5)

    return {w for w, n in toxic.items() if n >= min_docs and (not usual[w] or lift(w) >= LIFT)}


def train(
    sample: pd.DataFrame,
    ordinary_size: int = 65_536,
    toxic_size: int = 4_096,
    min_docs: int = 2,
    sample_words: int = 400_000,
) -> ToxicityModel | None:
    """Fit on a bounded sample with columns ``text`` and ``y`` (see ``labelled_sample``).

    Seven tenths of it build the dictionaries, the rest calibrates.  Without documents of both classes in both
    parts there is no model (None).
    """
    sample = sample.assign(turn=[hashlib.md5(t.encode("utf-8", "replace")).hexdigest() for t in sample["text"]])
    sample = sample.sort_values(["turn", "y"], kind="stable").reset_index(drop=True)
    # Equal texts are neighbours, so that copies do not stand on both sides of the cut more than once.
    cut = sample.groupby("y").cumcount() < 0.7 * sample.groupby("y")["y"].transform("size")
    build, rest = sample[cut], sample[~cut]
    if build["y"].nunique() < 2 or rest["y"].nunique() < 2:
        return None
    plain, marked = ([_words(t) for t in build.loc[build["y"] == y, "text"]] for y in (0, 1))
    marking = _marking(plain, marked, min_docs)
    # Without the marking words, which would be as short with either dictionary.
    usual = [w for words in plain for w in words if w not in marking]
    # The windows are shuffled by their place so that any prefix of the sample is as good as another.
    order = np.random.default_rng(7).permutation(len(usual))[:sample_words]
    ordinary = _trained([f" {usual[i]} ".encode() for i in order], ordinary_size)
    novel = [f" {w} ".encode() for words in marked for w in words if w in marking]
    order = np.random.default_rng(7).permutation(len(novel))[:sample_words]
    toxic = _trained([novel[i] for i in order], toxic_size)
    lengths = Cached(_lengths(ordinary, toxic), REMEMBERED)
    counts = np.zeros((2, (LONGEST + 1) ** 2))
    for y in (0, 1):
        seen = Counter(lengths[w] for t in rest.loc[rest["y"] == y, "text"] for w in _words(t))
        counts[y, list(seen)] = list(seen.values())
    # Against the expected count if the class said nothing, so that a pair never seen says nothing.
    expected = counts.sum(axis=1, keepdims=True) * counts.sum(axis=0) / max(1.0, counts.sum())
    surplus = np.log((counts + 0.5) / (expected + 0.5))
    ratios = surplus[1] - surplus[0]
    weights = logistic_fit(_features(rest["text"], lengths, ratios), rest["y"].to_numpy(float), ridge=0.05)
    return ToxicityModel(ordinary, toxic, ratios, weights)


_ready: dict[str, Cached] = {}


def scores(texts: list[str | None], model: ToxicityModel) -> np.ndarray:
    """Scores of whole texts, 0 to 1."""
    lengths = _ready.get(model.key)
    if lengths is None:
        _ready.clear()
        lengths = _ready[model.key] = Cached(_lengths(model.ordinary, model.toxic), REMEMBERED)
    z, start = np.full(len(texts), model.weights[-1]), 0
    while start < len(texts):
        end, held = start, 0
        while end < len(texts) and (end == start or held + len(texts[end] or "") <= PASS):
            held += len(texts[end] or "")
            end += 1
        z[start:end] += _features(texts[start:end], lengths, model.ratios) @ model.weights[:-1]
        start = end
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def toxicity_model(
    docs: DataFrame, labels: DataFrame, keep: str = "true", per_class: int = 3_000
) -> ToxicityModel | float:
    """A model, or a constant score where the labels hold no two classes to tell apart.

    It is fitted on ``per_class`` labelled documents of each class at most (those for which ``keep`` holds).
    The constant is the share of label 1, and 0 without any label.
    """
    sample = labelled_sample(docs, labels, "toxic", keep, per_class).toPandas()
    model = train(sample)
    return model if model is not None else float(sample["y"].mean() if len(sample) else 0.0)


def toxicity_score(text: Column, model: ToxicityModel | float) -> Column:
    """Score of each text, 0 to 1.  Null and wordless texts get the score of a text without windows."""
    if isinstance(model, float):
        return F.lit(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scores(list(texts), model))

    return score(text)
