"""Language identification by rank order: a text's most frequent character n-grams against each language's profile.

N-grams of one to three characters within words (runs of letters, lower-cased, a space at either end) are packed
into integers, so ties go by code point. A profile lists a language's `PROFILE` most frequent n-grams; a text's distance to
it is the sum of how far each of its own most frequent n-grams is out of place, `PROFILE` for one that isn't there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import documents, extended, fold

PROFILE = 400
#: Labelled texts of a language that profiles are counted from, at most: the first by a hash of doc_id.
SAMPLE = 4000
#: Words that a task keeps the n-grams of; beyond it, it starts anew.
KEPT = 200_000


class Grams(dict):
    """word -> its n-grams as packed code points, each as often as it occurs."""

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= KEPT:
            self.clear()
        c = np.frombuffer(f" {word} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self[word] = got = np.concatenate([c[1:-1], c[:-1] << 21 | c[1:], (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]])
        return got




def _other_numbers() -> str:
    """A character class's inside: what the pattern library takes for word characters though they are neither letters
    (category L) nor decimal digits, such as fractions, superscripts and letter numbers."""
    odd = [c for c in range(0x110000) if (x := chr(c)).isalnum() and not x.isalpha() and not x.isdecimal()]
    cut = [0, *(k for k in range(1, len(odd)) if odd[k] != odd[k - 1] + 1), len(odd)]
    return "".join(f"{chr(odd[a])}-{chr(odd[b - 1])}" for a, b in pairwise(cut))


#: Everything but letters parts words: digits and other numbers, marks, symbols and white space.
LETTERS = re.compile(rf"[^\W\d_{_other_numbers()}]+")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def ranked(text: str, grams: Grams, most: int = PROFILE) -> np.ndarray:
    """The text's n-grams, most frequent first, `most` of them; ties by code point."""
    count = Counter(words_of(text))
    if not count:
        return np.zeros(0, np.int64)
    parts = [grams[w] for w in count]
    every = np.concatenate(parts)
    times = np.repeat(np.fromiter(count.values(), np.int64, len(count)), [len(p) for p in parts])
    kinds, at = np.unique(every, return_inverse=True)
    n = np.bincount(at, weights=times).astype(np.int64)
    return kinds[np.lexsort((kinds, -n))[:most]]


def fit(docs: DataFrame, sample: int = SAMPLE, profile: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language from rows of doc_id, text and non-null lang; `sample` texts a language at most.

    Texts are counted whole, by task, and the counts added up before they come to the driver: `profile` n-grams a language.
    Ties go by code point. Rows with a null text or lang are left out, repeated rows count each; a language whose texts have
    no letter has an empty profile, and an empty table gives none.
    """
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    total = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not total:
        return {}
    # A share by hash comes near `sample` texts of each language, without sorting them.
    share = F.lit(0.0)
    for lang, n in sorted(total.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in it:
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
        grams = Grams()
        for lang, count in sorted(words.items()):
            parts = [grams[w] for w in count]
            if parts:
                times = np.repeat(np.fromiter(count.values(), np.int64, len(count)), [len(p) for p in parts])
                kinds, at = np.unique(np.concatenate(parts), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds)), pa.array(kinds), pa.array(np.bincount(at, weights=times).astype(np.int64))], ["lang", "gram", "n"])

    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    out: dict[str, list[int]] = {lang: [] for lang in sorted(total)}
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    for r in counts.withColumn("p", place).where(F.col("p") <= profile).orderBy("lang", "p").collect():
        out[r["lang"]].append(r["gram"])
    return out


def predict(df: DataFrame, profiles: dict[str, list[int]], profile: int = PROFILE) -> DataFrame:
    """df with lang_pred and score. Texts that are null or have no letter, and all without profiles, are `und`, score 0.

    score: how much nearer the best profile is than the next, 0 (as near) to 1; with one profile, the share in place. Equal
    distances go to the first language by name. Columns of df with the new names are replaced; an empty table stays empty.
    """
    df = df.drop("lang_pred", "score")
    langs = sorted(k for k, v in profiles.items() if v)
    every = np.unique(np.concatenate([np.array(profiles[k], np.int64) for k in langs])) if langs else np.zeros(0, np.int64)
    place = np.full((len(langs), len(every) + 1), -1, np.int64)  # languages * PROFILE numbers
    for i, k in enumerate(langs):
        place[i, np.searchsorted(every, np.array(profiles[k], np.int64))] = np.arange(len(profiles[k]))
    at = df.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in it:
            pred, score = [], []
            for x in batch.column(at):
                top = ranked(x.as_py() or "", grams, profile)
                if not len(top) or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                col = np.searchsorted(every, top)
                col[(col == len(every)) | (every[np.minimum(col, len(every) - 1)] != top)] = len(every)
                p = place[:, col]
                d = np.where(p < 0, profile, np.abs(p - np.arange(len(top)))).sum(1)
                k = int(np.argmin(d))
                rest = np.delete(d, k)
                pred.append(langs[k])
                worst = profile * len(top)
                score.append(float(1 - d[k] / max(1, rest.min())) if len(rest) else float(1 - d[k] / worst))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, extended(df.schema, lang_pred="string", score="double"))


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for op8: learned from rows whose crc32(doc_id as text) mod 3 is not 1."""
    docs = documents(spark, sf_dir)
    profiles = fit(docs.where(fold("doc_id", 3) != 1))
    out = predict(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
