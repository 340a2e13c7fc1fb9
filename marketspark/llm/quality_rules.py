"""Quality rules: a learned decision list over text statistics.

Statistics of every whole text are counted where it lies. From a bounded sample of labelled rows, sequential covering grows
threshold conjunctions one condition at a time by information gain, prunes each on rows it was not grown on, and keeps it
if it is precise there; rows that it covers leave the sample before the next rule grows. The list becomes one ordered Spark
conditional expression, so applying it needs no Python and can be read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import batches, documents, extended, mix, per_document, sampled, span_hashes, word_spans

#: Labelled rows that the list is learned from, about, where there are more: a share by a hash of doc_id.
SAMPLE = 20_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER, _LETTER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:0xE0] = True
_DIGIT[48:58] = True
_MARK[list(b"!?.,;:")] = True

#: Counts that the base rules name, and shares that rules may test.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("symbol_share", "repeat_share", "dup_line_share", "upper_share", "digit_share", "mark_share", "word_length", "line_words", "distinct_share", "wordless_share", "symbol_words")


def count(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """COUNTS (int64) and SHARES (float64) of each document."""
    n = len(offsets) - 1
    starts, ends, doc = word_spans(data, offsets)
    words = np.bincount(doc, minlength=n)
    solid = np.zeros(len(data) + 1, np.int64)
    np.add.at(solid, starts, 1)
    np.add.at(solid, ends, -1)
    inside = np.cumsum(solid[:-1]) > 0
    lead = (data & 0xC0) != 0x80
    chars = per_document(inside & lead, offsets)
    every = per_document(lead, offsets)
    symbols = per_document(SYMBOLS[data], offsets)
    # Lines: \n and a document's end close one.
    brk = np.flatnonzero(data == 10)
    line_end = np.sort(np.concatenate([brk, offsets[1:]]))
    line_doc = np.searchsorted(offsets[1:], line_end, "left")
    closing = np.zeros(len(line_end), bool)
    closing[np.searchsorted(line_end, offsets[1:], "right") - 1] = True
    line_doc = np.repeat(np.arange(n), per_document(data == 10, offsets) + 1)
    line_start = np.empty(len(line_end), np.int64)
    line_start[1:] = line_end[:-1] + 1
    first = np.append(True, line_doc[1:] != line_doc[:-1]) if n else np.zeros(0, bool)
    line_start[first] = offsets[:-1]
    has = np.append(0, np.cumsum(inside))
    worded = has[np.minimum(line_end, len(data))] > has[line_start] if n else np.zeros(0, bool)
    h = span_hashes(data, line_start[worded], line_end[worded]) ^ mix(line_doc[worded].astype(np.uint64))
    _, at = np.unique(h, return_index=True)
    lines = np.bincount(line_doc[worded], minlength=n)
    dup = lines - np.bincount(line_doc[worded][at], minlength=n)
    # Words in windows that the text has twice.
    w = span_hashes(data, starts, ends)
    repeat = np.zeros(n, np.int64)
    if len(w) >= window:
        key = np.zeros(len(w) - window + 1, np.uint64)
        for k in range(window):
            key = mix(key + w[k : k + len(key)])
        whole = np.flatnonzero(doc[: len(key)] == doc[window - 1 :])
        key = key[whole] ^ mix(doc[whole].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        twin = key[order][1:] == key[order][:-1]
        often = np.zeros(len(key), bool)
        often[order[1:][twin]] = True
        often[order[:-1][twin]] = True
        edge = np.zeros(len(w) + 1, np.int64)
        np.add.at(edge, whole[often], 1)
        np.add.at(edge, whole[often] + window, -1)
        repeat = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n)
    # A word with a symbol in it.
    sym = np.append(0, np.cumsum(SYMBOLS[data]))
    symbolic = np.bincount(doc[sym[ends] > sym[starts]], minlength=n)
    _, at = np.unique(w ^ mix(doc.astype(np.uint64)), return_index=True)
    distinct = np.bincount(doc[at], minlength=n)
    letters, upper = per_document(_LETTER[data], offsets), per_document(_UPPER[data], offsets)
    one, some = np.maximum(words, 1), np.maximum(every, 1)
    total_lines = np.bincount(line_doc, minlength=n)
    return {
        "n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat,
        "symbol_share": symbols / some, "repeat_share": repeat / one, "dup_line_share": dup / np.maximum(lines, 1), "upper_share": upper / np.maximum(letters, 1),
        "digit_share": per_document(_DIGIT[data], offsets) / some, "mark_share": per_document(_MARK[data], offsets) / some, "word_length": chars / one,
        "line_words": words / np.maximum(lines, 1), "distinct_share": distinct / one, "wordless_share": (total_lines - lines) / np.maximum(total_lines, 1), "symbol_words": symbolic / one,
    }


def statistics(df: DataFrame) -> DataFrame:
    """df with COUNTS and SHARES of `text` (null: as of an empty text). Columns of df with their names are replaced; rows that
    are alike have equal counts; an empty table stays empty. A text is counted whole by one task, in some dozen times its
    bytes of memory."""
    df = df.drop(*COUNTS, *SHARES)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batches(it):
            got = count(data, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[k].astype(np.int64)) for k in COUNTS), *(pa.array(got[k].astype(np.float64)) for k in SHARES)], [*batch.schema.names, *COUNTS, *SHARES])

    return df.mapInArrow(run, extended(df.schema, **dict.fromkeys(COUNTS, "long"), **dict.fromkeys(SHARES, "double")))


@dataclass(frozen=True)
class Rule:
    """All of the conditions (statistic, '>=' or '<=', threshold) hold."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, sign, t in self.tests:
            out &= x[name] >= t if sign == ">=" else x[name] <= t
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, t in self.tests:
            out = out & (F.col(name) >= F.lit(t) if sign == ">=" else F.col(name) <= F.lit(t))
        return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most: int, least: int) -> list[tuple[str, str, float]]:
    """One conjunction for y: the condition of most gain each time, until it is pure or nothing gains."""
    rows, tests = np.arange(len(y)), []
    while len(tests) < most:
        p, n = int(y[rows].sum()), len(rows)
        if p == 0 or p == n:
            break
        base, best = np.log2(p / n), (1e-9, None)
        for name, v in x.items():
            u = v[rows]
            order = np.argsort(u, kind="stable")
            s, hit = u[order], np.cumsum(y[rows][order])
            cut = np.flatnonzero(s[1:] > s[:-1]) + 1
            if not len(cut):
                continue
            mid = (s[cut] + s[cut - 1]) / 2
            for sign, pos, size in (("<=", hit[cut - 1], cut), (">=", p - hit[cut - 1], n - cut)):
                ok = (size >= least) & (pos > 0)
                if ok.any():
                    gain = np.where(ok, pos * (np.log2(np.maximum(pos, 1) / np.maximum(size, 1)) - base), -1)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (name, sign, float(mid[k])))
        if best[1] is None:
            break
        tests.append(best[1])
        name, sign, t = best[1]
        rows = rows[x[name][rows] >= t] if sign == ">=" else rows[x[name][rows] <= t]
    return tests


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, precision: float = 0.9, conditions: int = 4, rules: int = 12, seed: int = 3) -> list[Rule]:
    """Decision list for `bad` rows: what no rule covers is good. Without bad or without good rows, no rule.

    A third of the rows left is held back to prune the last conditions of each rule; a rule stays if at least `precision` of
    the held-back rows and of all rows it covers are bad, and it covers three at least.
    """
    left, out, rng = np.arange(len(bad)), [], np.random.default_rng(seed)
    while len(out) < rules and bad[left].any() and not bad[left].all():
        part = rng.random(len(left)) < 1 / 3
        grow, prune = left[~part], left[part]
        tests = _grow({k: v[grow] for k, v in x.items()}, bad[grow].astype(np.int64), conditions, max(3, len(grow) // 2000))
        best: Rule | None = None
        for k in range(len(tests), 0, -1):
            rule = Rule(tuple(tests[:k]), 0.0, 0)
            c, own = rule.covers({n: v[prune] for n, v in x.items()}), rule.covers({n: v[left] for n, v in x.items()})
            if own.sum() < 3:
                continue
            sure = min((bad[prune][c].sum() + 1) / (c.sum() + 1), bad[left][own].mean())
            value = bad[prune][c].sum() - 3 * (~bad[prune][c]).sum()
            if sure >= precision and (best is None or value >= best.covered):
                best = Rule(tuple(tests[:k]), float(sure), int(value))
        if best is None:
            break
        own = best.covers({n: v[left] for n, v in x.items()})
        out.append(Rule(best.tests, float(bad[left][own].mean()), int(own.sum())))
        left = left[~own]
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the rule that rejects, from 1; 0 where none does."""
    out = F
    for k, rule in enumerate(rules, 1):
        out = out.when(rule.column(), F.lit(k))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def base_failed() -> Column:
    """Fewer than 10 words, or more than a fifth of them in windows that occur twice."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **more) -> list[Rule]:
    """Rules for documents labelled quality 0. Null labels and labels of other documents are left out; of several labels of
    a document the lowest holds. `sample` bounds the labelled rows that come to the driver as numbers."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    one = sampled(one, "doc_id", sample)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(one), "doc_id")).drop("text")  # about `sample` rows
    rows = rows.where(~base_failed()).toArrow().to_pandas().sort_values(["doc_id", *COUNTS], kind="stable")
    if rows.empty:
        return []
    x = {k: rows[k].to_numpy(np.float64) for k in SHARES}
    return learn(x, rows["quality"].to_numpy() == 0, **more)


def apply(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with COUNTS, SHARES, base_failed, rule (int, 0: none) and kept. Columns of df with their names are replaced."""
    out = statistics(df.drop("base_failed", "rule", "kept")).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for op3."""
    docs = documents(spark, sf_dir)
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply(docs.select("doc_id", "text"), rules).select("doc_id", *COUNTS, "base_failed", "kept", "rule")
