"""The training-data operators against brute force, exact round trips and held-out accuracy, with the edge cases of each:
nulls in any column, empty and long texts, repeated rows, clashing extra columns, empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("marketspark.llm")
from marketspark.llm import common, language_id, media, mixing, ngram_join, packing, ppm, quality_rules, sharding, suffix_dedup, toxicity  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, size string, __node string, shard string, score string"


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvwäéñ") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 160))) for _ in range(40)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [texts[0], texts[0], texts[1] + " tail", passage + " " + texts[2], texts[3] + "\n" + passage, passage, "", " \n\t ", "a", "a b", "Z z " * 400, "ab" * 300]
    long = [rng.choice(words) for _ in range(20000)]
    texts.append(" ".join(long))
    for k in range(6):
        w = texts[5].split()
        if w:
            w[k % len(w)] = f"edit{k}"
        texts.append(" ".join(w))
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["b", "a", None, "é"]), len(t), "n", "s", "x", "7", "y") for i, t in enumerate(texts)]
    out += [(100, None, None, None, None, None, None, None, None, None), (None, "no id at all", "en", "a", 3, None, None, None, None, None), out[3], out[3], (101, None, "en", "a", 0, "n", "s", "x", "7", "y")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_dicts(df):
    return [r.asDict() for r in df.collect()]


# --- suffix-array dedup


def removed(data, width=100):
    seen, out = set(), {}
    order = sorted({(d is not None, d or 0, t) for d, t in data}, key=lambda x: (x[0], x[1]))
    for has, d, b in order:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(w)
        n = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[(d if has else None), b] = (len(b), sum(gone), n, hashlib.sha256(bytes(x for x, r in zip(b, gone, strict=True) if not r)).hexdigest())
    return out


def test_suffix_dedup(docs, empty):
    got = suffix_dedup.digest(docs).collect()
    data = [(r[0], (r[1] or "").encode()) for r in rows()]
    # Rows of doc_id 3 are alike: one document.
    want = removed(data)
    assert len(got) == len(data)
    by = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert by == collections.Counter((d, *want[d, b]) for d, b in data)
    assert suffix_dedup.digest(empty).collect() == []


def test_suffix_dedup_groups(spark):
    """Copies, near copies and shared passages in small and large groups: the same answer as brute force, whether pieces go
    through the transform or by their hash."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(80)) for _ in range(12)]
    passage = " ".join(word() for _ in range(40))
    data = [(i, t) for i, t in enumerate(texts + texts[:4] + texts[:2] + [t + " " + passage for t in texts[4:8]] + [texts[9].replace("a", "z", 3)])]
    data += [(100 + i, texts[10]) for i in range(14)] + [(200 + i, f"{word()} {passage} {word()}") for i in range(20)]
    few = spark.createDataFrame(data[:23], "doc_id long, text string").coalesce(1)
    every = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    for d, rows_ in ((few, data[:23]), (every, data)):
        want = removed([(i, t.encode()) for i, t in rows_])
        assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(d).collect()} == {(i, *v) for (i, _), v in want.items()}


def test_suffix_transform_is_needed():
    """Strings of pieces that differ are found by the transform alone."""
    t = b"x" + bytes(range(97, 117)) * 8
    data, o = np.frombuffer(t + t[:150] + b"end", np.uint8), np.array([0, len(t), len(t) + 153])
    args = (data, o, np.zeros(2, np.int64), np.arange(2), np.zeros(2, np.int64))
    assert len(suffix_dedup.repeated(*args)[0])
    made = suffix_dedup.columnwise
    try:
        suffix_dedup.columnwise = lambda *a: (np.zeros(0, np.int64),) * 3
        assert not len(suffix_dedup.repeated(*args)[0])
    finally:
        suffix_dedup.columnwise = made


def test_suffix_dedup_same_id_other_text(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdefgh") for _ in range(300))
    got = suffix_dedup.digest(spark.createDataFrame([(1, t), (1, t + "x"), (2, t)], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in got if r.doc_id == 1) == [0, 300] and [r.n_removed for r in got if r.doc_id == 2] == [300]


def test_columnwise_construction(tmp_path):
    rng = random.Random(2)
    for trial in range(40):
        texts = ["".join(rng.choice("ab" if trial % 2 else "abc") for _ in range(rng.randint(0, 25))).encode() for _ in range(rng.randint(1, 7))]
        o = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        who, size, lcp = suffix_dedup.columnwise(np.frombuffer(b"".join(texts), np.uint8), o, str(tmp_path))
        want = sorted(([c + 2 for c in t[len(t) - k :]] + [0, i], i, k) for i, t in enumerate(texts) for k in range(len(t) + 1))
        assert [(i, k) for _, i, k in want] == list(zip(who.tolist(), size.tolist(), strict=True))
        for (a, _, _), (b, _, _), n in zip(want, want[1:], lcp[1:], strict=False):
            same = 0
            for x, y in zip(a[:-2], b[:-2], strict=False):
                if x != y:
                    break
                same += 1
            assert same == n


def test_suffix_cleaned_keeps_columns(docs):
    out = suffix_dedup.cleaned(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} >= {0, 1, 2, 3, 100, None}


# --- quality rules


def base(x):
    w = WORD.findall(x)
    g = list(zip(*[w[i:] for i in range(5)], strict=False))
    c, cover, seen, dup = collections.Counter(g), [0] * len(w), set(), 0
    for i, k in enumerate(g):
        if c[k] > 1:
            cover[i : i + 5] = [1] * 5
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in x), dup, sum(cover)


def test_quality_counts(spark, docs, empty):
    got = as_dicts(quality_rules.apply(docs, []))
    want = collections.Counter((r[0], *base(r[1] or "")) for r in rows())
    assert collections.Counter((r["doc_id"], *(r[k] for k in quality_rules.COUNTS)) for r in got) == want
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality_rules.apply(empty, []).count() == 0
    odd = spark.createDataFrame([(1, "a\n\na\n \n \na b #x\n\n"), (2, "\n\n\n"), (3, "é|é & <b>\né|é & <b>")], "doc_id long, text string")
    assert {r["doc_id"]: tuple(r[k] for k in quality_rules.COUNTS) for r in as_dicts(quality_rules.statistics(odd))} == {1: base("a\n\na\n \n \na b #x\n\n"), 2: base("\n\n\n"), 3: base("é|é & <b>\né|é & <b>")}


def test_quality_rules_learn(spark):
    rng = random.Random(1)
    rows_, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        rows_.append((i, " ".join("".join(rng.choice("abcdefg") for _ in range(5)) + ("%%%" if bad else "") for _ in range(40))))
        labels.append((i, 0 if bad else 1))
    labels += [(None, 0), (5, None), (999, 0)]
    d, y = spark.createDataFrame(rows_, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    rules = quality_rules.fit(d, y)
    assert rules and all(k.precision >= 0.9 for k in rules)
    got = quality_rules.apply(d, rules).collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in got)
    assert quality_rules.fit(d, y.where("quality = 1")) == []


# --- n-gram join


def shingle_set(text, n):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_join(docs, empty, n, percent):
    data = [(r[0], shingle_set(r[1], n)) for r in rows()]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(data):
        for j, (_, b) in enumerate(data[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(data):
        if d is not None:
            ids[find(i)].append(d)
    want = collections.Counter((d, len(s), min(ids[find(i)], default=None)) for i, (d, s) in enumerate(data))
    got = ngram_join.classified(docs, n, percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert ngram_join.classified(empty, n, percent).count() == 0
    kept = ngram_join.representatives(docs, n, percent)
    assert kept.columns == docs.columns
    groups = {find(i) for i, (_, s) in enumerate(data) if s}
    assert kept.count() == len(groups) + sum(not s for _, s in data)


def test_ngram_keys_lose_no_link():
    rng = np.random.default_rng(0)
    for trial in range(200):
        size = int(rng.integers(9, 300))
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        k = int(rng.integers(0, max(2, len(a) // 12)))
        b = np.unique(np.concatenate([a[k:], rng.integers(0, 1 << 62, int(rng.integers(0, max(2, len(a) // 20)))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        for percent in (90, 80):
            if 100 * both >= percent * len(np.union1d(a, b)) and both < max(len(a), len(b)):
                key, who = ngram_join.keys_of([a, b], percent)
                assert set(key[who == 0]) & set(key[who == 1]), (trial, percent)


# --- toxicity


def test_toxicity_learns(spark, empty):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(400)]
    rows_, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(60)]
        if i % 6 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["grumbol", "grumbox", "zorkit"])
        rows_.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    d, y = spark.createDataFrame(rows_, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (2, None), (10**6, 1)], "doc_id long, toxic int")
    model = toxicity.fit(d, y.where(common.fold("doc_id", 5) != 0))
    got = {r.doc_id: r for r in toxicity.scored(d, model).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == (i % 6 == 0) for i in held]) > 0.95
    assert toxicity.scored(empty, model).count() == 0
    blank = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5)], "doc_id long, text string, score double")
    assert [r.predicted for r in toxicity.scored(blank, model).collect()] == [0, 0]
    assert toxicity.fit(d, y.where("toxic = 0")).score(np.zeros((1, len(toxicity.FEATURES))))[0] < 0.5


# --- mixing


def test_mixing(docs, empty):
    got = as_dicts(mixing.digest(docs))
    want = collections.Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows())
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == want
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    total = sum(r["size"] for r in got)
    targets = {(r["source_size"], r["target"]) for r in got}
    assert abs(sum(t for _, t in targets) - 1.5 * total) < 1e-6 and all(t <= 2 * s + 1e-9 for s, t in targets)
    assert sorted(map(str, as_dicts(mixing.digest(docs)))) == sorted(map(str, got))
    assert mixing.digest(empty).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["taken"] // r["size"] for r in got if r["size"])


def test_fill_is_near():
    rng = np.random.default_rng(1)
    for _ in range(50):
        length = np.unique(rng.integers(1, 400, 60))
        count = rng.integers(1, 9, len(length))
        budget = int(rng.integers(0, (length * count).sum()))
        took = mixing.fill(length, count, budget, 500)
        assert (took >= 0).all() and (took <= count).all() and 0 <= budget - (took * length).sum() <= length.max()
    assert mixing.water_fill([10, 100, 1000], [3, 1, 2], 1665, 2) == [20, 200, 1445]


# --- sharding


def test_sharding(docs, empty):
    got = as_dicts(sharding.digest(docs))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows())
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    n = [len(slots.get(k, [])) for k in range(40)]
    assert max(n) - min(n) <= 1
    assert sharding.digest(empty).count() == 0


def test_communication_matrix():
    m = sharding.communication_matrix([10, 0, 7, 30], [12, 12, 12, 11], 5)
    assert [sum(r) for r in m] == [10, 0, 7, 30] and [sum(c) for c in zip(*m, strict=True)] == [12, 12, 12, 11]
    rng = random.Random(0)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.1 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3


# --- language


def test_language_id(spark, empty):
    rng = random.Random(5)
    letters = {"xx": "aeioulmnr", "yy": "bcdfghjk"}
    rows_ = [(i, " ".join("".join(rng.choice(letters[k]) for _ in range(6)) for _ in range(30)), k) for i in range(90) for k in [rng.choice(["xx", "yy"])]]
    d = spark.createDataFrame(rows_ + [(1000, None, "xx"), (1001, "12 34 !", "xx"), (1002, "", None), (1003, "aeiou", None)], "doc_id long, text string, lang string")
    profiles = language_id.fit(d.where(common.fold("doc_id", 3) != 1))
    got = {r.doc_id: r for r in language_id.predict(d, profiles).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows_) and {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.predict(empty, profiles).count() == 0 and {r.lang_pred for r in language_id.predict(d, {}).collect()} == {"und"}


def test_rank_order_distance():
    text = "banana bandana"
    top = language_id.ranked(text, language_id.Grams(), 5)
    count = collections.Counter()
    for w in language_id.words_of(text):
        p = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(p) - n + 1):
                g = p[i : i + n]
                if n > 1 or g != " ":
                    code = 0
                    for c in g:
                        code = code << 21 | ord(c)
                    count[code] += 1
    assert top.tolist() == [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:5]]


# --- PPM


def ppm_brute(train, texts, order):
    seen = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in train:
        s = [256] * order + list((t or "").encode()) + [256]
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[k][tuple(s[i - k : i])][s[i]] += 1
    out = []
    for t in texts:
        s, lp = [256] * order + list((t or "").encode()) + [256], 0.0
        for j in range(order, len(s)):
            skip, done = set(), False
            for k in range(order, -1, -1):
                new = {a: n for a, n in seen[k].get(tuple(s[j - k : j]), {}).items() if a not in skip}
                if not new:
                    continue
                left = sum(new.values())
                if s[j] in new:
                    lp += math.log10((new[s[j]] - 0.5) / left)
                    done = True
                    break
                lp += math.log10(0.5 * len(new) / left)
                skip |= set(new)
            if not done:
                lp -= math.log10(257 - len(skip))
        out.append(lp)
    return out


@pytest.mark.parametrize("trie,head", [(1 << 20, 1 << 19), (900, 40)])
def test_ppm(docs, empty, trie, head):
    data = [(r[0], r[1]) for r in rows() if len(r[1] or "") < 5000]
    small = docs.where("text is null or length(text) < 5000")
    train = [t for d, t in data if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1]
    c = collections.Counter()
    for t in train:
        c.update(WORD.findall(lower(t or "")))
        c[None] += 1
    n, v = sum(c.values()), len(c)
    want = []
    for (d, t), lp in zip(data, ppm_brute(train, [t for _, t in data], ppm.ORDER), strict=True):
        tokens = [*WORD.findall(lower(t or "")), None]
        want.append((d is None, d or 0, len(tokens), sum(c[w] > 0 for w in tokens), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), 6), round(lp, 6)))
    got = ppm.score(small, small.where(common.fold("doc_id", 5) != 1), trie=trie, head=head).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)
    assert ppm.score(empty, empty).count() == 0
    assert ppm.score(small, empty).count() == len(data)


def test_ppm_is_a_distribution():
    g, _ = ppm.strings(np.frombuffer(b"abracadabra", np.uint8), np.array([0, 11]))
    t = ppm.Trie(*np.unique(g, return_counts=True))
    for ctx in (g[4] >> 9, g[7] >> 9, 0x1FF):
        every = (int(ctx) << 9) | np.arange(257)
        assert abs((10 ** t.score(every)).sum() - 1) < 1e-9
    assert ppm.adaptive(b"abababababab") > ppm.adaptive(b"axkqpzmwlfyt")


# --- packing


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary() + ".json")
    got = packing.pack(docs, capacity=64).collect()
    want = collections.Counter()
    for d, t, *_ in rows():
        ids, lo, k = np.append(tok.encode(t or "", add_special_tokens=False).ids, 0).astype("<u4"), 0, 0
        while lo < len(ids):
            hi = lo + ((len(ids) % 64 or 64) if not lo else 64)
            want[d, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())] += 1
            lo, k = hi, k + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) <= 1.03 * sum(r.length for r in got) / 64 + 1
    assert packing.pack(empty).count() == 0


def test_encoder_agrees():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(packing.vocabulary() + ".json"), packing.encoder(packing.vocabulary())
    for x in ("", "Hello  world\n\n ok", "naïve ñandú ß", "<|endoftext|> a", "日本 x y\x85z", "it's 12,5 %%% |", "\x1ca\x1f b", "😀 ok"):
        assert enc(x).tolist() == tok.encode(x, add_special_tokens=False).ids


def test_local_search_saves_a_bin():
    lengths = [6, 6, 4, 4, 5, 5]
    out = packing.improve([[0, 2], [1], [3, 4], [5]], lengths, 10)
    assert len(out) == 3 and sorted(i for b in out for i in b) == list(range(6)) and all(sum(lengths[i] for i in b) <= 10 for b in out)


@pytest.mark.parametrize("start,lengths,end", [([[0], [1, 2]], [5, 3, 2], [[], [1, 2, 0]]), ([[0], [1, 2]], [4, 6, 3], [[2], [1, 0]]), ([[0, 1], [2, 3]], [3, 3, 5, 4], [[2], [3, 0, 1]])])
def test_each_kind_of_step(start, lengths, end):
    """A move, a one-for-one and a two-for-one exchange."""
    s = packing.Search(start, lengths, 10)
    s._leave(0)
    assert s.step(0) and s.bins == end


def test_local_search_alone_packs():
    """From rows in the order of arrival the search comes within a hundredth of the floor, and every step it took raised the
    sum of squared fills."""
    rng = np.random.default_rng(3)
    lengths = np.minimum(2048, np.maximum(1, rng.lognormal(5.5, 1.2, 3000).astype(int))).tolist()
    start: list[list[int]] = [[]]
    for i, x in enumerate(lengths):  # each into the last bin or a new one
        if sum(lengths[k] for k in start[-1]) + x > 2048:
            start.append([])
        start[-1].append(i)
    s = packing.Search(start, lengths, 2048)
    squares = lambda: int(((2048 - s.room[[k for k, b in enumerate(s.bins) if b]]) ** 2).sum())
    steps, last, shift = [], squares(), s.shift

    def watched(*a):
        nonlocal last
        shift(*a)
        steps.append(squares() - last)
        last += steps[-1]

    s.shift = watched
    out = s.run()
    assert sorted(i for b in out for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 2048 for b in out)
    floor = -(-sum(lengths) // 2048)
    assert len(start) > 1.15 * floor and len(out) <= 1.01 * floor and min(steps) > 0
    arrived = packing.best_fit(lengths, 2048)
    assert floor <= len(packing.improve(arrived, lengths, 2048)) < len(arrived)


def test_local_search_against_exhaustive():
    """Small sets: never better than the least number of bins that any assignment needs, and seldom worse."""
    rng, worse = random.Random(8), 0

    def fits(items, rooms):
        if not items:
            return True
        return any(fits(items[1:], rooms[:k] + [r - items[0]] + rooms[k + 1 :]) for k, r in enumerate(rooms) if r >= items[0] and r not in rooms[:k])

    for _ in range(60):
        lengths = [rng.randint(1, 10) for _ in range(rng.randint(3, 9))]
        least = next(k for k in range(1, 10) if fits(sorted(lengths, reverse=True), [10] * k))
        got = len(packing.improve([[i] for i in range(len(lengths))], lengths, 10))
        assert got >= least
        worse += got > least
    assert worse <= 6


# --- media


def picture(seed, side=120):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 1, (side, side))
    for _ in range(2):
        a = media.smooth(a.astype(np.float32))
    return np.clip(128 + 160 * a, 0, 255)


def png(a):
    import struct

    h, w = a.shape
    raw = b"".join(b"\0" + r.tobytes() for r in np.clip(np.round(a), 0, 255).astype(np.uint8))
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_media_copies(spark):
    a, b = picture(1), picture(2)
    edit = a.copy()
    edit[30:60, 30:60] = 90
    items = [(1, a), (2, a[10:100, 15:110]), (3, edit), (4, 0.8 * a + 15), (5, b), (6, np.rot90(b)), (7, picture(3))]
    data = [(i, media.encode(x), "z") for i, x in items] + [(8, png(a), "z"), (9, None, None), (10, b"junk", None), (11, b"", None), (12, media.encode(np.full((50, 50), 9.0)), None), (5, media.encode(b), "again"), (None, media.encode(picture(9)), None)]
    d = spark.createDataFrame(data, "id long, image binary, node string")
    got = collections.Counter((r.id, r.class_id) for r in media.classes(d).collect())
    want = {1: 1, 2: 1, 3: 1, 4: 1, 8: 1, 5: 5, 6: 5, 7: 7, 9: 9, 10: 10, 11: 11, 12: 12, None: None}
    assert got == collections.Counter([(k, v) for k, v in want.items()] + [(5, 5)])
    assert media.classes(d.limit(0)).count() == 0


def test_stages_keep_clashing_columns(docs):
    extra = docs.selectExpr("*", "'k' as kept", "'t' as target", "'c' as Copies", "'n' as n_shingles", "'p' as predicted")
    for stage in (suffix_dedup.cleaned, mixing.mixed, ngram_join.representatives):
        out = stage(extra)
        assert out.columns == extra.columns and out.count()
        assert {tuple(r) for r in out.select("kept", "target", "Copies", "n_shingles").distinct().collect()} == {("k", "t", "c", "n")}


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    before = d
    for k, (_, stage) in enumerate(pipeline.STAGES):
        d = common.stored(stage(spark, d, sf))
        if k < len(pipeline.STAGES) - 1:
            assert d.columns == before.columns
    texts = before.count()
    assert 0 < d.select("doc_id").distinct().count() <= texts


def test_media_pairs_of_a_key_are_not_lost():
    """Images 3 and 4 share keys 7 and 8; smaller images that aren't copies hold one of them each."""
    k, v = np.array([7, 7, 7, 8, 8, 8, 8]), np.array([1, 3, 4, 2, 3, 4, 4])
    assert dict(zip(zip(*(x.tolist() for x in media.met_by(k, v)[:2])), media.met_by(k, v)[2].tolist())) == {(1, 3): 1, (1, 4): 1, (2, 3): 1, (2, 4): 1, (3, 4): 2}
    n = media.CELL + 1
    u, w, votes = media.met_by(np.zeros(n, np.int64), np.arange(n))
    assert set(zip(u.tolist(), w.tolist())) == {(0, i) for i in range(1, n)} and (votes >= media.VOTES).all()


def warped(a, degrees, zoom):
    h, w = a.shape
    y, x = np.mgrid[: int(h * zoom), : int(w * zoom)]
    u, v, t = x / zoom - w / 2, y / zoom - h / 2, np.deg2rad(degrees)
    px, py = np.clip(np.cos(t) * u - np.sin(t) * v + w / 2, 0, w - 1.01), np.clip(np.sin(t) * u + np.cos(t) * v + h / 2, 0, h - 1.01)
    i, j, fx, fy = px.astype(int), py.astype(int), px % 1, py % 1
    return (a[j, i] * (1 - fx) + a[j, i + 1] * fx) * (1 - fy) + (a[j + 1, i] * (1 - fx) + a[j + 1, i + 1] * fx) * fy


def all_pairs(seen):
    """The classes of copies() over all pairs (as smallest index), and the pairs."""
    root, pairs = list(range(len(seen))), []
    for i in range(len(seen)):
        for j in range(i):
            if media.copies(seen[i], seen[j]):
                pairs.append((j, i))
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root, pairs


def keys_in_common(a, b, width, orders):
    return sum(len(np.intersect1d(media.table_keys(a[1], width, r), media.table_keys(b[1], width, r))) for r in range(orders))


def test_media_recall_against_all_pairs(spark):
    """Rescaled, turned and noisy copies: the classes are those of copies() over all pairs, by either set of tables."""
    rng = np.random.default_rng(5)
    items = []
    for s in range(24):
        p = picture(100 + s, 160)
        for _ in range(3):
            p = media.smooth(p.astype(np.float32))
        p = np.clip(128 + (p - p.mean()) * 45 / p.std(), 0, 255)
        items += [p, warped(p, 0, 0.9), warped(p, 0, 1.15), warped(p, 12, 1), warped(p, -8, 1.1), p + rng.normal(0, 25, p.shape)]
    blobs = [media.encode(x) for x in items]
    seen = [media.describe(media.decode(x)) for x in blobs]
    root, pairs = all_pairs(seen)
    got = dict(media.classes(spark.createDataFrame(list(enumerate(blobs)), "id long, image binary")).select("id", "class_id").collect())
    assert len(pairs) > 40 and got == dict(enumerate(root))
    for n in (1 << 20, 1 << 30):
        width, orders = media.tables(n)
        recall = np.mean([keys_in_common(seen[i], seen[j], width, orders) >= media.VOTES for i, j in pairs])
        print(f"{len(pairs)} accepted pairs of {len(seen)} images: {recall:.3f} share two keys of {width} bits")
        assert recall >= 0.95


def test_media_recall_on_pages(spark):
    """All pages of the small tables, and edited copies of some: no class of copies() over all pairs is lost."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()
    data = [(r.page_id, r.html) for r in pages]
    for k, (i, html) in enumerate(data[:40]):
        w = html.split(" ")
        for e in range(1 + k % 3):
            w[(7 * e + k) % len(w)] = f"edit{k}"
        data.append((10_000 + i, " ".join(w)))
    df = media.pictures(spark.createDataFrame(data, "page_id long, html string"))
    order = sorted(df.collect(), key=lambda r: r.page_id)
    seen = [media.describe(media.decode(bytes(r.image))) for r in order]
    root, pairs = all_pairs(seen)
    got = dict(media.classes(df, "image", "page_id").select("page_id", "class_id").collect())
    assert len(pairs) > 15 and got == {r.page_id: order[root[k]].page_id for k, r in enumerate(order)}


def test_media_does_not_depend_on_batches(spark):
    """A large group of near copies, over several tiles, among others: one class, however rows are dealt."""
    rng = np.random.default_rng(6)
    base = picture(40, 60)
    data = [(i, media.encode(base + rng.normal(0, 2, base.shape))) for i in range(1200)] + [(2000 + i, media.encode(picture(500 + i, 60))) for i in range(30)]
    d = spark.createDataFrame(data, "id long, image binary")
    a, b = (sorted(map(tuple, media.classes(d.repartition(n)).select("id", "class_id").collect())) for n in (2, 7))
    assert a == b and {c for i, c in a if i < 1200} == {0} and all(c == i for i, c in a if i >= 2000)


def test_media_states(spark):
    data = [(1, None), (2, b""), (3, b"\xff\xd8\xff junk"), (4, media.encode(np.full((50, 50), 9.0))), (5, media.encode(picture(3)))]
    got = dict(media.classes(spark.createDataFrame(data, "id long, image binary")).select("id", "state").collect())
    assert got == {1: "null", 2: "empty", 3: "unknown", 4: "plain", 5: "ok"}


def test_media_places_of_large_images(spark):
    """Beyond 65504 pixels a half-precision place is infinite."""
    strip, a = np.full((120, 66000), 100.0), picture(21)
    wide = np.concatenate([strip, a], 1)
    d = spark.createDataFrame([(1, media.encode(wide)), (2, media.encode(0.9 * a))], "id long, image binary")
    assert {tuple(r) for r in media.classes(d).select("id", "class_id").collect()} == {(1, 1), (2, 1)}


def test_media_pictures_are_80_pixels_wide():
    assert media.decode(media.draw(b"some words")).shape == (80, 80)


# --- what the driver's SQL cannot say, against plain versions


def test_hypergeometric_is_exact():
    """Against the probabilities as ratios of integers: chi-square over every outcome."""
    rng = random.Random(1)
    for good, bad, n in ((30, 70, 20), (5, 3, 4), (400, 600, 500), (2, 10_000, 5000)):
        draws = collections.Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(4000))
        p = {k: math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)}
        assert set(draws) <= set(p)
        common_ = [k for k in p if 4000 * p[k] >= 5]
        rare = 4000 * (1 - sum(p[k] for k in common_))
        chi = sum((draws[k] - 4000 * p[k]) ** 2 / (4000 * p[k]) for k in common_)
        assert chi < len(common_) + 5 * math.sqrt(2 * len(common_)) + 5 and sum(v for k, v in draws.items() if k not in common_) < rare + 5 * math.sqrt(rare + 1) + 5
    for n in (255, 256, 1000, 10**6):
        assert abs(float(sharding.ln_factorial(n)) - math.lgamma(n + 1)) < 1e-9 * math.lgamma(n + 1)
    assert abs(sharding.ln_factorial(300) - sharding._EXACT.ln(sharding.Decimal(math.factorial(300)))) < sharding.Decimal("1e-38")
    big = sharding.hypergeometric(rng, 10**11, 10**12, 10**10)
    assert abs(big - 10**10 / 11) < 8 * math.sqrt(10**10 * (1 / 11) * (10 / 11))


def test_shards_are_uniform(spark):
    """Over seeds, each row falls into each shard, and each shard's first place, about equally often."""
    d = spark.range(30).selectExpr("id as doc_id")
    where, first = collections.Counter(), collections.Counter()
    for seed in range(40):
        for r in sharding.uniform_shards(d, ["doc_id"], 3, seed=seed, blocks=4).collect():
            where[r.doc_id % 5, r.shard] += 1
            first[r.doc_id % 5] += r.slot == 0
    assert len(where) == 15 and sum((n - 80) ** 2 / 80 for n in where.values()) < 36
    assert sum((first[k] - 24) ** 2 / 24 for k in range(5)) < 24


def test_words_are_letters(spark):
    for text in ("½ ²", "①", "Ⅳ ⅷ", "〇", "٣ 12"):
        assert language_id.words_of(text) == [] or text == "〇"
    assert language_id.words_of("naïve x² ½b Straße_ñ ªº日本") == ["naïve", "x", "b", "straße", "ñ", "ªº日本"]
    d = spark.createDataFrame([(1, "½ ²"), (2, "① Ⅳ"), (3, "aa ½ aa")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(d, {"xx": [97], "yy": [98]}).collect()}
    assert got == {1: "und", 2: "und", 3: "xx"}


def test_language_against_plain_distances(spark):
    """Verdicts and scores from out-of-place sums counted one n-gram at a time."""
    rng = random.Random(9)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(40))
    rows_ = [(i, make("abcdefg" if i % 2 else "efghijk"), "xx" if i % 2 else "yy") for i in range(30)]
    d = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    most = 50
    profiles = language_id.fit(d, profile=most)

    def grams(text):
        count = collections.Counter()
        for w in re.findall("[a-z]+", text):
            p = f" {w} "
            for n in (1, 2, 3):
                for i in range(len(p) - n + 1):
                    if p[i : i + n] != " ":
                        code = 0
                        for c in p[i : i + n]:
                            code = code << 21 | ord(c)
                        count[code] += 1
        return count

    top = lambda count: [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:most]]
    plain = {k: top(sum((grams(t) for _, t, x in rows_ if x == k), collections.Counter())) for k in ("xx", "yy")}
    assert profiles == plain
    for r in language_id.predict(d, profiles, most).collect():
        own = top(grams(r.text))
        dist = {k: sum(abs(i - p.index(g)) if g in p else most for i, g in enumerate(own)) for k, p in plain.items()}
        best = min(sorted(dist), key=dist.get)
        assert r.lang_pred == best and abs(r.score - (1 - dist[best] / max(1, max(dist.values())))) < 1e-9


def test_fill_against_exhaustive_sums():
    """Few documents, small shares first: the sum is the nearest below the budget of all subsets."""
    rng = np.random.default_rng(2)
    for _ in range(80):
        length = np.unique(rng.integers(2, 40, 5))
        count = rng.integers(1, 4, len(length))
        budget = int(rng.integers(1, (length * count).sum() + 1))
        sums = {0}
        for x, c in zip(length.tolist(), count.tolist(), strict=True):
            sums = {s + k * x for s in sums for k in range(c + 1)}
        took = mixing.fill(length, count, budget, 1 << 16)
        # What the share of each length takes is given; the programme closes the rest as well as any subset of the others can.
        share = np.array([int(c) * budget // int((length * count).sum()) for c in count])
        rest = {0}
        for x, c in zip(length.tolist(), (count - share).tolist(), strict=True):
            rest = {s + k * x for s in rest for k in range(c + 1)}
        base = int((share * length).sum())
        assert (took >= 0).all() and (took <= count).all() and int((took * length).sum()) == base + max(s for s in rest if base + s <= budget) and int((took * length).sum()) in sums


def test_decision_list_against_plain_rules():
    """What the ordered expression says is what its conditions say, one row at a time; each condition is the one of most gain
    among all thresholds."""
    rng = np.random.default_rng(4)
    x = {"a": rng.random(400), "b": rng.random(400), "c": np.round(rng.random(400), 1)}
    bad = (x["a"] > 0.7) & (x["b"] < 0.6) | (x["c"] >= 0.9)
    tests = quality_rules._grow(x, bad.astype(np.int64), 3, 3)
    rows_ = np.arange(400)
    for name, sign, t in tests:
        p, n = bad[rows_].sum(), len(rows_)
        best = -1
        for k, v in x.items():
            u = np.unique(v[rows_])
            for cut in (u[1:] + u[:-1]) / 2:
                for side in (v[rows_] <= cut, v[rows_] >= cut):
                    hit = bad[rows_][side].sum()
                    if hit and side.sum() >= 3:
                        best = max(best, hit * (math.log2(hit / side.sum()) - math.log2(p / n)))
        own = x[name][rows_] >= t if sign == ">=" else x[name][rows_] <= t
        hit = bad[rows_][own].sum()
        assert abs(hit * (math.log2(hit / own.sum()) - math.log2(p / n)) - best) < 1e-9
        rows_ = rows_[own]
    rules = quality_rules.learn(x, bad)
    caught = np.zeros(400, bool)
    for r in rules:
        for i in range(400):
            caught[i] |= all(x[n][i] >= t if s == ">=" else x[n][i] <= t for n, s, t in r.tests)
    assert (caught == bad).mean() > 0.97 and (caught & ~bad).sum() <= 4


def test_verdict_expression(spark):
    rules = [quality_rules.Rule((("a", ">=", 0.5), ("b", "<=", 0.25)), 1.0, 1), quality_rules.Rule((("c", ">=", 2.0),), 1.0, 1)]
    d = spark.createDataFrame([(0.5, 0.25, 9.0), (0.4, 0.1, 2.0), (0.4, 0.1, 1.9)], "a double, b double, c double")
    assert [r[0] for r in d.select(quality_rules.verdict(rules)).collect()] == [1, 2, 0]


def test_isotonic_against_exhaustive():
    """Pools are the least-squares rising fit: every level is the mean of its rows and no cut of a pool would rise."""
    rng = np.random.default_rng(0)
    for _ in range(20):
        raw, y = rng.permutation(30).astype(float), (rng.random(30) < 0.4).astype(float)
        order = np.argsort(raw)
        t = y[order]
        # Min-max formula of isotonic regression.
        want = [max(min(t[i : j + 1].mean() for j in range(k, 30)) for i in range(k + 1)) for k in range(30)]
        xs, ys = toxicity.isotonic(raw, y)
        got = np.interp(np.sort(raw), xs, ys)
        assert (np.diff(got) >= -1e-12).all()
        # The half row each way shrinks levels towards the middle, without changing their order.
        for level in np.unique(np.round(want, 12)):
            rows_ = np.flatnonzero(np.abs(np.array(want) - level) < 1e-9)
            assert np.ptp(got[rows_]) < 1e-9 or len(np.unique(np.round(want, 9))) > 1


def test_features_against_plain_counts():
    model = toxicity.Model()
    words = ["grumbol", "zorkit"]
    h = np.array([toxicity._hash_words(w)[0] for w in words])
    model.entries, model.weights = np.sort(h), np.array([2.0, 3.0])[np.argsort(h)]
    texts = ["You GRUMBOL, you!! fine words", "", "nothing here", "gr0mb zorkit ZORKIT? a1b"]
    data = "".join(texts).encode()
    o = np.append(0, np.cumsum([len(t.encode()) for t in texts])).astype(np.int64)
    got = dict(zip(toxicity.FEATURES, toxicity.features(np.frombuffer(data, np.uint8), o, model).T, strict=True))
    for i, t in enumerate(texts):
        w = re.findall("[A-Za-z0-9]+", t)
        hits = [x for x in w if x.lower() in words]
        one, size, letters = max(1, len(w)), max(1, len(t)), re.findall("[A-Za-z]", t)
        assert abs(got["hits"][i] - math.log1p(len(hits))) < 1e-12 and abs(got["density"][i] - len(hits) / one) < 1e-12
        assert abs(got["exclaim"][i] - t.count("!") / size) < 1e-12 and abs(got["question"][i] - t.count("?") / size) < 1e-12
        assert abs(got["upper_share"][i] - sum(c.isupper() for c in letters) / max(1, len(letters))) < 1e-12
        assert abs(got["shouted"][i] - sum(x.isupper() and len(x) > 1 for x in w) / one) < 1e-12
        assert abs(got["second_density"][i] - sum(x.lower() == "you" for x in w) / one) < 1e-12


def test_operators_keep_clashing_columns(spark, docs, empty):
    """Extra columns named as working or new columns, in every operator that gives its input's columns back."""
    extra = docs.selectExpr("*", "'k' as kept", "'t' as target", "'c' as Copies", "'n' as n_shingles", "'p' as predicted", "'r' as rule", "'l' as lang_pred", "'s' as slot", "'q' as __block")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, toxic int, quality int")
    assert toxicity.accepted(extra, labels).columns == extra.columns
    assert {r[0] for r in toxicity.accepted(extra, labels).select("predicted").collect()} <= {"p"}
    for out, own in ((quality_rules.apply(extra, []), "rule"), (language_id.predict(extra, {"xx": [97]}), "lang_pred"), (sharding.uniform_shards(extra, ["doc_id"], 3), "slot")):
        rest = [c for c in extra.columns if c.lower() not in {"rule", "kept", "lang_pred", "slot", "score", "shard"}]
        assert set(rest) <= set(out.columns) and out.count() == docs.count()
        assert out.select(own).first()[0] != {"rule": "r", "lang_pred": "l", "slot": "s"}[own]
        assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert packing.pack(extra, capacity=64).count() == packing.pack(docs, capacity=64).count()
    assert ppm.score(extra.where("doc_id < 10"), extra.where("doc_id < 5")).count() == docs.where("doc_id < 10").count()
    for op in (lambda d: toxicity.accepted(d, labels), lambda d: quality_rules.apply(d, []), lambda d: sharding.uniform_shards(d, ["doc_id"], 3)):
        assert op(empty).count() == 0


def test_ppm_does_not_depend_on_partitions(docs):
    """Several slices on shuffled input: the same scores by any dealing of rows."""
    few = docs.where("doc_id < 60 and length(text) < 3000")
    a, b = (sorted((r.doc_id, round(r.base_score, 6), round(r.score, 6)) for r in ppm.score(few.repartition(n), few, trie=900, head=40).collect()) for n in (2, 5))
    assert a == b


def test_checkpoint_folder_unset(tmp_path):
    """Without spark.checkpoint.dir a local session stores its tables all the same."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "from pyspark.sql import SparkSession\ns = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\nassert not s.conf.get('spark.checkpoint.dir', None)\nfrom marketspark.llm.common import discard, stored\nt = stored(s.range(3))\nassert t.count() == 3\nfolder = t.inputFiles()[0].rsplit('/', 1)[0].removeprefix('file:').replace('//', '')\nimport os\nassert os.path.isdir(folder)\ndiscard(t)\nassert not os.path.isdir(folder)\n"
    r = subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr[-2000:]


def test_media_tables_do_not_follow_the_size():
    """Before, inputs of more than 16 M descriptors were keyed by other tables, so that other pairs met."""
    assert len({media.tables(n) for n in (0, 1 << 20, 1 << 24, (1 << 24) + 1, 1 << 30)}) == 1
