"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon (words and word beginnings that toxic documents have and clean ones lack, by likelihood ratio), the trees and
the calibration each learn from their own share of a bounded sample of labelled rows. Features are densities of lexicon
hits, their nearness to second-person words, capitals, punctuation and obfuscation rates, counted over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import LOWER, WHITE, batches, documents, extended, fold, fresh, mix, per_document, sampled, span_hashes, word_spans

#: Labelled rows that the model learns from, about, where there are more: a share by a hash of doc_id.
SAMPLE = 40_000
#: Entries of the lexicon, at most: those of most weight.
ENTRIES = 4000
#: Lengths of word beginnings in bytes; 0 is the whole word.
HEADS = (0, 4, 5, 6)
#: Second-person words of the four languages.
SECOND_PERSON = "you your yours yourself du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro"
#: What stands for a letter in disguised words.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_IN = _ALNUM.copy()
_IN[[ord(c) for c in "@$*'"]] = True
_PLAIN = LOWER.copy()
for _a, _b in DISGUISE.items():
    _PLAIN[ord(_a)] = ord(_b)
_ODD = np.zeros(256, bool)
_ODD[[ord(c) for c in "013457@$*"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
FEATURES = ("hits", "density", "weight", "strongest", "distinct", "near_second", "second_density", "upper_share", "shouted", "exclaim", "question", "marks", "disguised", "disguised_hits", "log_words")


def _hash_words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = word_spans(data, np.array([0, len(data)]))
    return np.sort(span_hashes(data, s, e))


_SECOND = _hash_words(SECOND_PERSON)


def terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """A hash for each word and HEADS entry; 0 where the word isn't longer than the beginning."""
    out = []
    for k in HEADS:
        if k:
            h = span_hashes(data, starts, np.minimum(ends, starts + k))
            h = np.where(ends - starts > k, mix(h + np.uint64(k)), np.uint64(0))
        else:
            h = span_hashes(data, starts, ends)
        out.append(h)
    return out


def member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index in the sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


@dataclass
class Model:
    """lexicon: sorted hashes and their weights; trees: (feature, cut, left, right, value) arrays; calibration: scores."""

    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    base: float = 0.0
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1), np.zeros(1)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                if (f < 0).all():
                    break
                go = np.where(f < 0, at, np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], left[at], right[at]))
                at = go
            out += value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a fiftieth of the uncalibrated chance keeps rows of one step in order."""
        raw = self.raw(x)
        return np.clip(0.98 * np.interp(raw, *self.steps) + 0.02 / (1 + np.exp(-np.clip(raw, -40, 40))), 0.0, 1.0)


def features(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends, doc = word_spans(low, offsets, _ALNUM[data])
    words = np.bincount(doc, minlength=n)
    best = np.full(len(starts), -1)
    weight = np.zeros(len(starts))
    for h in terms(low, starts, ends):
        at = member(h, model.entries)
        w = np.where(at >= 0, model.weights[np.maximum(at, 0)] if len(model.weights) else 0.0, 0.0)
        best = np.where(w > weight, at, best)
        weight = np.maximum(w, weight)
    hit = np.flatnonzero(weight > 0)
    hits = np.bincount(doc[hit], minlength=n)
    total = np.bincount(doc[hit], weights=weight[hit], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, doc[hit], weight[hit])
    distinct = np.bincount(np.unique(np.stack([doc[hit], best[hit]]), axis=1)[0], minlength=n) if len(hit) else np.zeros(n)
    second = np.flatnonzero(member(span_hashes(low, starts, ends), _SECOND) >= 0)
    near = np.zeros(n)
    if len(second) and len(hit):
        i = np.searchsorted(second, hit)
        a, b = second[np.maximum(i - 1, 0)], second[np.minimum(i, len(second) - 1)]
        close = ((np.abs(hit - a) <= 5) & (doc[a] == doc[hit])) | ((np.abs(hit - b) <= 5) & (doc[b] == doc[hit]))
        near = np.bincount(doc[hit], weights=close, minlength=n)
    # Disguised words: a letter on either side of a stand-in for a letter.
    s2, e2, d2 = word_spans(data, offsets, _IN[data])
    odd = np.append(0, np.cumsum(_ODD[data]))
    let = np.append(0, np.cumsum(_LETTER[data]))
    dis = (odd[np.maximum(e2 - 1, s2)] > odd[np.minimum(s2 + 1, e2)]) & (let[e2] > let[s2]) & _LETTER[data[s2]] if len(s2) else np.zeros(0, bool)
    disguised = np.bincount(d2[dis], minlength=n) if len(s2) else np.zeros(n)
    found = np.zeros(n)
    if dis.any():
        plain = _PLAIN[data]
        got = np.zeros(int(dis.sum()), bool)
        for h in terms(plain, s2[dis], e2[dis]):
            got |= member(h, model.entries) >= 0
        found = np.bincount(d2[dis], weights=got, minlength=n)
    up, letters = per_document(_UPPER[data], offsets), per_document(_LETTER[data], offsets)
    u = np.append(0, np.cumsum(_UPPER[data]))
    shouted = np.bincount(doc[(u[ends] - u[starts] == ends - starts) & (ends - starts > 1)], minlength=n)
    size, one = np.maximum(np.diff(offsets), 1), np.maximum(words, 1)
    mark = per_document(~_ALNUM[data] & ~WHITE[data], offsets)
    cols = [np.log1p(hits), hits / one, total / one, top, np.log1p(distinct), near / np.maximum(hits, 1), np.bincount(doc[second], minlength=n) / one, up / np.maximum(letters, 1), shouted / one, per_document(data == 33, offsets) / size, per_document(data == 63, offsets) / size, mark / size, disguised / one, np.log1p(found), np.log1p(words)]
    return np.stack([np.asarray(c, np.float64) for c in cols], axis=1)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 5) -> tuple[float, list[tuple[np.ndarray, ...]]]:
    """Newton-boosted trees for the log-odds of y, over quantile bins."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    extra = [np.unique(np.concatenate([c, (np.unique(v)[:-1] + np.unique(v)[1:])[:8] / 2])) if len(np.unique(v)) > 1 else c for c, v in zip(cuts, x.T, strict=True)]
    b = np.stack([np.searchsorted(c, v, "left") for c, v in zip(extra, x.T, strict=True)], axis=1)
    raw, out = np.full(len(y), base), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = y - q, np.maximum(q * (1 - q), 1e-6)
        feature, cut, left, right, value = [-1], [0.0], [0], [0], [0.0]
        todo = [(0, np.arange(len(y)), 0)]
        while todo:
            node, rows, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = rate * float(np.clip(gs / (hs + 1.0), -4, 4))
            if level == depth or len(rows) < 2 * least:
                continue
            best = (1e-6, -1, 0)
            for f, c in enumerate(extra):
                if not len(c):
                    continue
                gl, hl, nl = (np.cumsum(np.bincount(b[rows, f], weights=w, minlength=len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] < 0:
                continue
            _, f, k = best
            go = b[rows, f] <= k
            feature[node], cut[node] = f, float(extra[f][k])
            for side, at in ((left, rows[go]), (right, rows[~go])):
                side[node] = len(feature)
                for a, d in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, 0.0)):
                    a.append(d)
                todo.append((side[node], at, level + 1))
        tree = tuple(np.array(a) for a in (feature, cut, left, right, value))
        raw += Model(trees=[tree]).raw(x)
        out.append(tree)
    return base, out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: points of a rising line from raw score to chance. Each pool leans half a row each way."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for r, t in zip(raw[order], y[order], strict=True):
        pools.append([float(t), 1.0, float(r), float(r)])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            a = pools.pop()
            pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2], a[3]]
    xs, ys = [], []
    for s, n, lo, hi in pools:
        for v in {lo, hi}:
            xs.append(v)
            ys.append((s + 0.25) / (n + 0.5))
    at = np.argsort(xs, kind="stable")
    return np.array(xs)[at], np.maximum.accumulate(np.array(ys)[at])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Null labels and labels of other documents are left out; of several labels of a document the highest holds. With
    fewer than 8 toxic or 8 clean rows for the trees, every score is the share of toxic rows (0 without rows)."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    one = sampled(one, "doc_id", sample).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10)))
    rows = docs.select("doc_id", "text").join(F.broadcast(one), "doc_id").select("text", "toxic", "part")  # about `sample` rows

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batches(it):
            low = LOWER[data]
            starts, ends, doc = word_spans(low, offsets, _ALNUM[data])
            y = batch.column(1).to_numpy().astype(np.int64)
            pair = [(d, t) for h in terms(low, starts, ends) for d, t in ((doc[h != 0], h[h != 0]),)]
            d, t = (np.concatenate(x) for x in zip(*pair, strict=True))
            order = np.lexsort((t, d))
            d, t = d[order], t[order]
            new = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]))[: len(d)]
            kinds, at = np.unique(t[new], return_inverse=True)
            toxic = np.bincount(at, weights=y[d[new]], minlength=len(kinds)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(kinds)).astype(np.int64) - toxic)], ["term", "a", "b"])

    first = rows.where("part < 6")
    sizes = first.groupBy().agg(F.sum((F.col("toxic") == 1).cast("long")).alias("a"), F.sum((F.col("toxic") != 1).cast("long")).alias("b")).first()
    na, nb = sizes["a"] or 0, sizes["b"] or 0
    model = Model()
    if na and nb:
        a, b = F.col("a"), F.col("b")
        share = F.lit(na / (na + nb))
        ll = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
        odds = F.log(((a + 0.5) / (na + 1)) / ((b + 0.5) / (nb + 1)))
        table = first.select("text", (F.col("toxic") == 1).cast("long").alias("toxic")).mapInArrow(counted, "term long, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        got = table.where("a >= 3").withColumn("ll", ll).withColumn("odds", odds).where("ll >= 24 and odds >= 2.5").orderBy(F.desc("ll"), "term").limit(ENTRIES).toArrow().to_pandas()
        h = got["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        model.entries, model.weights = h[order], got["odds"].to_numpy(np.float64)[order]
    rest = _featured(rows.where("part >= 6"), model).toArrow().to_pandas().sort_values([*FEATURES, "toxic"], kind="stable")
    x, y, part = rest[list(FEATURES)].to_numpy(np.float64), (rest["toxic"] == 1).to_numpy(np.float64), rest["part"].to_numpy()
    trees, held = part < 9, part >= 9
    if not len(y) or min(y[trees].sum(), trees.sum() - y[trees].sum()) < 8:
        share = (na + y.sum()) / max(1, na + nb + len(y))
        model.steps = (np.zeros(1), np.array([share]))
        model.base = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return model
    model.base, model.trees = boost(x[trees], y[trees])
    cal = held if held.sum() >= 50 and 0 < y[held].sum() < held.sum() else np.ones(len(y), bool)
    model.steps = isotonic(model.raw(x[cal]), y[cal])
    return model


def _featured(df: DataFrame, model: Model) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batches(it):
            x = features(data, offsets, model)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c.copy()) for c in x.T)], [*batch.schema.names[1:], *FEATURES])

    names = [c for c in df.columns if c != "text"]
    return df.select("text", *names).mapInArrow(run, extended(df.select(*names).schema, **dict.fromkeys(FEATURES, "double")))


def scored(df: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """df with score double and predicted int (1 if score >= 0.5). A null text is empty; columns of df with these names are
    replaced; an empty table stays empty."""
    df = df.drop(score, predicted)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batches(it):
            s = model.score(features(data, offsets, model))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, score, predicted])

    return df.mapInArrow(run, extended(df.schema, **{score: "double", predicted: "int"}))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, as they are, without those that a model learned from their labelled ones calls toxic.

    A null text is empty, and kept unless toxic rows are the rule; rows that are alike share a verdict; columns of any name
    stay as they are; an empty table stays empty; without usable labels every document stays."""
    score, predicted = fresh(docs, "score", "predicted")
    out = scored(docs, fit(docs, labels), score, predicted)
    return out.where(F.col(predicted) == 0).drop(score, predicted)


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for op5: learned from labels of rows whose crc32(doc_id as text) mod 5 is not 0."""
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
