"""Language identification with n-gram filters of language bitmasks.

Every slot of a Bloom filter holds a mask with one bit per language, so that one look at ``HASHES`` slots returns
all languages whose filter holds an n-gram.  N-grams are runs of ``SIZE`` characters inside ``" word "`` of letters,
lower-cased.  A language's filter takes the n-grams that are at least ``share_of_top`` as frequent in it as in the
language where they are most frequent, and occur in at least ``min_share`` of its documents.

The score of a language is the number of a text's n-grams found in its filter, less the number expected by false
positives (the share of its bits that are set, to the power of the hashes), over what can be found at most.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
SIZE = 3
HASHES = 3
SLOT_BITS = 20
# Characters of texts that are taken together.
PASS = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in alphabetical order and ``words`` arrays of slots, 64 languages each."""

    languages: list[str]
    slots: np.ndarray

    def false_rates(self) -> np.ndarray:
        bits = np.uint64(1) << (np.arange(len(self.languages), dtype=np.uint64) % np.uint64(64))
        fill = [np.count_nonzero(self.slots[i // 64] & bit) / self.slots.shape[1] for i, bit in enumerate(bits)]
        return np.array(fill) ** HASHES


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, and the index of each one's text."""
    each = [" ".join(["", *LETTERS.findall(t.lower()), ""]) if t else "" for t in texts]
    joined = "".join(each)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(each), dtype=np.int32), [len(e) for e in each])
    count = len(chars) - SIZE + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    # A space may stand at an end only.
    fits = owner[:count] == owner[SIZE - 1 :]
    for inside in range(1, SIZE - 1):
        fits &= chars[inside : inside + count] != 32
    starts = np.flatnonzero(fits)
    with np.errstate(over="ignore"):
        code = chars[starts]
        for next_one in range(1, SIZE):
            code = code * np.uint64(0x110000) + chars[starts + next_one]
        code *= _MIX
        code ^= code >> np.uint64(32)
        code *= _MIX
    return code, owner[starts]


def _slots_of(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """``HASHES`` slots of each n-gram, from different bits of its hash."""
    mask = np.uint64((1 << SLOT_BITS) - 1)
    for k in range(HASHES):
        yield ((hashes >> np.uint64(k * SLOT_BITS)) & mask).astype(np.int64)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per language and n-gram: the documents of a batch that have it."""
    for batch in batches:
        for lang, part in batch.groupby("lang", sort=False):
            hashes, owners = ngrams(list(part["text"]))
            pairs = pd.DataFrame({"h": hashes.view(np.int64), "o": owners}).drop_duplicates()
            found = Counter(pairs["h"].tolist())
            yield pd.DataFrame({"lang": lang, "h": list(found), "n": list(found.values())})


def language_model(
    docs: DataFrame,
    keep: str = "true",
    per_language: int = 1_500,
    min_share: float = 0.01,
    share_of_top: float = 0.25,
) -> LanguageModel:
    """Filters of all values of ``lang``, from documents for which ``keep`` holds.

    About ``per_language`` documents of each language are used: a hash of the id picks the share of them that
    gives that many.  Languages are the groups of a count over all documents; the filters hold ``2 ** SLOT_BITS``
    masks whatever the input.
    """
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & F.expr(keep)
    )
    # One row per language.
    sizes = usable.groupBy("lang").agg(F.count("*").alias("total"))
    languages = sorted(row["lang"] for row in sizes.collect())
    words = (len(languages) + 63) // 64
    slots = np.zeros((max(1, words), 1 << SLOT_BITS), np.uint64)
    if not languages:
        return LanguageModel([], slots)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = usable.join(F.broadcast(sizes), "lang").where(place * F.col("total") < per_language)
    picked = picked.select("lang", "text")
    of_language = picked.groupBy("lang").agg(F.count("*").alias("docs"))
    counts = (
        picked.mapInPandas(_counted, "lang string, h long, n long")
        .groupBy("lang", "h")
        .agg(F.sum("n").alias("n"))
        .join(F.broadcast(of_language), "lang")
        .select("lang", "h", (F.col("n") / F.col("docs")).alias("rate"))
        .where(F.col("rate") >= min_share)
    )
    top = counts.groupBy("h").agg(
        F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("in_languages")
    )
    taken = top.select("h", F.explode("in_languages").alias("l"), "top").where(
        F.col("l.rate") >= F.col("top") * share_of_top
    )
    index = {lang: i for i, lang in enumerate(languages)}
    # Bounded: a document has so many n-grams, and each one here is in min_share of a language's documents.
    chosen = taken.select("h", F.col("l.lang").alias("lang")).toPandas()
    for lang, part in chosen.groupby("lang"):
        bit = np.uint64(1 << (index[lang] % 64))
        for slot in _slots_of(part["h"].to_numpy().view(np.uint64)):
            slots[index[lang] // 64, slot] |= bit
    return LanguageModel(languages, slots)


def _found(texts: list[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Per text: n-grams in all, and those in each language's filter."""
    size, n = len(texts), len(model.languages)
    hashes, owners = ngrams(texts)
    total = np.bincount(owners, minlength=size)
    found = np.zeros((size, n))
    looks = list(_slots_of(hashes))
    for word in range(len(model.slots)):
        mask = model.slots[word][looks[0]]
        for slot in looks[1:]:
            mask &= model.slots[word][slot]
        for i in range(word * 64, min(n, word * 64 + 64)):
            hit = (mask >> np.uint64(i % 64)) & np.uint64(1) != 0
            found[:, i] = np.bincount(owners[hit], minlength=size)
    return total, found


def predict(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and score of whole texts.

    ``und`` with score 0 for null texts, texts without a letter, and all texts if no language was learnt.  Equal
    counts go to the first language in the alphabet.
    """
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return names, scores
    wrong = model.false_rates()
    start = 0
    while start < len(texts):
        end, held = start, 0
        while end < len(texts) and (end == start or held + len(texts[end] or "") <= PASS):
            held += len(texts[end] or "")
            end += 1
        total, found = _found(texts[start:end], model)
        right = np.clip((found - total[:, None] * wrong) / np.maximum(1e-9, 1 - wrong), 0, None)
        best = right.argmax(axis=1)
        share = right[np.arange(len(best)), best] / np.maximum(1e-9, right.sum(axis=1))
        for i in np.flatnonzero(total > 0):
            # Superscripts and the like are word characters but no letters.
            if any(map(str.isalpha, texts[start + i])):
                names[start + i] = model.languages[best[i]]
                scores[start + i] = min(1.0, share[i])
        start = end
    return names, scores


def predicted_language(text: Column, model: LanguageModel, docs: DataFrame) -> Column:
    """Struct of ``lang`` and ``score`` of each text of ``docs``."""
    # 8 MB for every 64 languages.
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def language(texts: pd.Series) -> pd.DataFrame:
        names, scores = predict(list(texts), held.value)
        return pd.DataFrame({"lang": names, "score": scores})

    return language(text)
