import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tourweave.llm import suffix_tree_lm as m


def test_base_scores_by_brute_force(spark):
    out = {r["doc_id"]: r for r in m.op9_suffix_tree_lm(spark, "/root/testdata/sf0.001").collect()}
    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b""] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(w for i, ws in docs.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in docs.items():
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)


def brute_force(train: list[list[bytes]], texts: list[list[bytes]], depth: int, min_count: int) -> list[float]:
    """The definition, with dictionaries and one token at a time."""
    uni = Counter(w for t in train for w in t)
    n, v = sum(uni.values()), len(uni)
    size, follow = Counter(), Counter()
    for t in train:
        for i, x in enumerate(t):
            for k in range(1, min(depth, i) + 1):
                s = tuple(t[i - k : i])
                size[s] += 1
                follow[s, x] += 1
    parent = lambda s: s[1:]
    candidates = {()}
    for s in sorted(size, key=len):
        if parent(s) in candidates and size[s] >= min_count:
            candidates.add(s)
    kept = {s: {} for s in candidates}
    for (s, x), k in follow.items():
        if s in candidates and k >= 2:
            kept[s][x] = k
    rest = {s: (size[s] - sum(kept[s].values()) + m.PRIOR) / (size[s] + m.PRIOR) for s in candidates if s}

    def p(s, x):
        if not s:
            return (uni[x] + 1) / (n + v + 1)
        return kept[s].get(x, 0) / (size[s] + m.PRIOR) + rest[s] * p(parent(s), x)

    gain = Counter()
    for (s, x), k in follow.items():
        if s in candidates:
            gain[s] += k * math.log(p(s, x) / p(parent(s), x))
    tree = {s for s in candidates if s and gain[s] / size[s] >= m.MIN_GAIN}
    out = []
    for t in texts:
        total = 0.0
        for i, x in enumerate(t):
            s = ()
            for k in range(1, min(depth, i) + 1):
                if (longer := tuple(t[i - k : i])) not in candidates:
                    break
                s = longer if longer in tree else s
            total += math.log10(p(s, x))
        out.append(total)
    return out


def chained(texts: int, words: list[str], length: int, seed: int) -> list[str]:
    """Texts in which each word is mostly followed by the next one."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(texts):
        t, at = [], 0
        for _ in range(rng.integers(0, length)):
            at = (at + 1) % len(words) if rng.random() < 0.7 else rng.integers(0, len(words))
            t.append(words[at] if rng.random() < 0.95 else f"rare{rng.integers(0, 50)}")
        out.append(" ".join(t))
    return out


def scored(spark, texts: list[str], **options) -> list[float]:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [r["score"] for r in m.score(docs, F.col("doc_id") % 3 != 0, **options).orderBy("doc_id").collect()]


# (frequent from a share, or a number of tokens, on; tokens a part; parts at a time): no trunk, shallow and deep ones, no branches
LINES = [(0.02, 0, 200, 4096), (0.01, 0, 60, 3), (0.5, 0, 10**6, 4096), (1e-5, 0, 100, 4096), (0.1, 0, 300, 1), (1e-6, 40, 150, 2), (1e-6, 1 << 18, 100, 4096)]


@pytest.mark.parametrize(("depth", "min_count"), [(4, 3), (2, 2), (1, 6)])
def test_scores_by_brute_force_wherever_the_trunk_ends(spark, depth, min_count):
    texts = chained(60, list("abcdEf"), 40, 3)
    split = [m.tokens(t.encode()) for t in texts]
    expected = brute_force([t for i, t in enumerate(split) if i % 3], split, depth, min_count)
    for min_share, hot_tokens, part_tokens, fan in LINES:
        found = scored(spark, texts, depth=depth, min_count=min_count, min_share=min_share, part_tokens=part_tokens, fan=fan, hot_tokens=hot_tokens)
        assert found == pytest.approx(expected, rel=1e-9), (min_share, hot_tokens)


@pytest.mark.parametrize("head_words", [1, 4])
def test_words_that_are_not_broadcast_are_contexts_and_continuations(spark, monkeypatch, head_words):
    monkeypatch.setattr(m, "HEAD_WORDS", head_words)
    texts = chained(60, list("abcdEf"), 40, 8) + ["", "once", "twice twice e\u0301 \u6f22 \u6f22"]
    split = [m.tokens(t.encode()) for t in texts]
    train = [t for i, t in enumerate(split) if i % 3]
    expected, uni = brute_force(train, split, 3, 3), Counter(w for t in train for w in t)
    for min_share, hot_tokens, part_tokens, fan in [(0.1, 0, 60, 3), (1e-6, 60, 150, 4096), (1e-6, 1 << 18, 100, 4096)]:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        rows = m.score(docs, F.col("doc_id") % 3 != 0, depth=3, min_count=3, min_share=min_share, part_tokens=part_tokens, fan=fan, hot_tokens=hot_tokens).orderBy("doc_id").collect()
        assert [r["score"] for r in rows] == pytest.approx(expected, rel=1e-9), (min_share, hot_tokens)
        assert [r["n_known"] for r in rows] == [sum(uni[w] > 0 for w in t) for t in split]
        n, v = sum(uni.values()), len(uni)
        assert [r["base_score"] for r in rows] == pytest.approx([sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t) for t in split], rel=1e-9)


def test_word_counts_travel_in_few_rows(spark, monkeypatch):
    monkeypatch.setattr(m, "_FLUSH", 50)
    texts = chained(40, [f"w{i}" for i in range(200)], 80, 6) + ["", "\u6f22 e\u0301"]
    rows = [(t.encode(), i % 3 != 0) for i, t in enumerate(texts)]
    found = m._word_counts(spark.createDataFrame(rows, "text binary, learn boolean").repartition(2))
    every, learned = (Counter(w for t, learn in rows if learn or not some for w in m.tokens(t)) for some in (False, True))
    assert {bytes(r["word"]): (r["all"], r["n"]) for r in found.collect()} == {w: (every[w], n) for w, n in learned.items()}


def test_texts_are_split_by_columns():
    odd = [bytes([i]) for i in range(256)] + [b"A" + bytes([i]) + b"b" for i in range(256)]
    texts = [b"", b" ", b" \t\n\x0b\x0c\r ", b" a  B\x0b\x0cc ", "\u0130\u212a \u00a0x \u2028".encode(), b"one", *odd]
    batch = pa.array([b"skipped", *texts], pa.binary()).slice(1)
    words, sizes = m._split(batch)
    assert words.view(pa.binary()).to_pylist() == [w for t in texts for w in m.tokens(t)]
    assert sizes.tolist() == [len(m.tokens(t)) for t in texts]
    distinct, at = m._distinct([words, words.slice(0, 0), words.slice(5)])
    every = words.view(pa.binary()).to_pylist()
    assert len(distinct) == len(set(every)) and distinct.take(pa.array(at)).view(pa.binary()).to_pylist() == every + every[5:]
    found = {int(i): w for _, own, joined in m._by_buckets(distinct, 7) for i, w in zip(own, m._joined(joined).view(pa.binary()).to_pylist(), strict=True)}
    assert [found[i] for i in range(len(distinct))] == distinct.view(pa.binary()).to_pylist()


def test_each_column_travels_by_its_own_width():
    columns = [np.array([0, 1, 255]), np.array([256, 0, 7]), np.array([1 << 40, 3, (1 << 62) + 5]), np.zeros(3, np.int64)]
    packed = m._pack(*columns)
    assert list(packed[:4]) == [1, 2, 8, 1]
    assert all(np.array_equal(a, b) for a, b in zip(m._unpack(packed, 4), columns, strict=True))
    assert [len(c) for c in m._unpack(m._pack(np.empty(0, np.int64), np.empty(0, np.int64)), 2)] == [0, 0]


def test_chunks_of_a_partition_ask_for_their_own_words(spark, monkeypatch):
    monkeypatch.setattr(m, "HEAD_WORDS", 2)
    monkeypatch.setattr(m, "_CHUNK", 100)
    texts = chained(600, list("abcdEf"), 12, 9)
    split = [m.tokens(t.encode()) for t in texts]
    expected = brute_force([t for i, t in enumerate(split) if i % 3], split, 3, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    rows = m.score(docs, F.col("doc_id") % 3 != 0, depth=3, min_count=3, min_share=1e-6, part_tokens=500, hot_tokens=300).orderBy("doc_id").collect()
    assert [r["score"] for r in rows] == pytest.approx(expected, rel=1e-9)


def test_a_hot_context_and_words_of_held_out_texts_only(spark):
    """One word precedes a third of all tokens, with many different ones behind it; others are frequent in held-out texts only."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"hot w{rng.integers(0, 40)}" if rng.random() < 0.5 else f"w{rng.integers(0, 40)}" for _ in range(30)) for _ in range(45)]
    texts = [t if i % 3 else "unseen hot hot unseen words " * 20 for i, t in enumerate(texts)]
    split = [m.tokens(t.encode()) for t in texts]
    expected = brute_force([t for i, t in enumerate(split) if i % 3], split, 3, 2)
    for hot_tokens in (30, 150, 10**6):
        assert scored(spark, texts, depth=3, min_count=2, min_share=1e-6, part_tokens=100, hot_tokens=hot_tokens) == pytest.approx(expected, rel=1e-9)


def test_no_group_is_hot():
    """Tails and branches of a context that a third of all tokens follow are dealt to parts that are bounded by what is frequent."""
    rng = np.random.default_rng(2)
    ids = np.where(np.arange(30_000) % 3 == 0, 0, rng.integers(1, 500, 30_000))
    sizes, least = np.full(300, 100), 400
    context = m.before(ids, sizes, 2, 500)
    counts = np.bincount(ids)
    pairs, n = np.unique((context[0] << 20 | ids)[context[0] == 0], return_counts=True)
    few = n < least
    keys = np.flatnonzero(counts >= least)
    trunk = m.Trunk(np.log(counts / 30_000), 8, [m.Level(keys[:, None], keys, counts[keys], pairs[~few], n[~few])])
    parts = 4096
    tails = m._mixed_parts(trunk.tails(context, ids), parts)
    branches = m._part_of(context, trunk.reached(context), parts)
    for part in (tails, branches):
        assert np.bincount(part[part >= 0]).max() < 2 * least
    assert (tails >= 0).sum() == n[few].sum()


@pytest.mark.parametrize("least", [10**9, 600, 100])
def test_a_context_is_a_distribution(least):
    """Over known words and the rest, each context of the trunk and of the branches sums to one."""
    rng = np.random.default_rng(1)
    ids, sizes = rng.integers(0, 5, 3000), np.full(300, 10)
    context, learn = m.before(ids, sizes, 3, 5), np.ones(3000, bool)
    counts = np.bincount(ids)
    root = (counts + 1) / (len(ids) + 6)
    keys = np.flatnonzero(counts >= least)
    trunk = m.Trunk(np.log(np.append(root, 1.0)), 4)
    if len(keys):
        next_keys, n = np.unique((np.searchsorted(keys, context[0]) << 20 | ids)[np.isin(context[0], keys)], return_counts=True)
        common = n >= least
        trunk.levels.append(m.Level(keys[:, None], keys, counts[keys], next_keys[common], n[common]))
    for history in ([0, 1, 1], [2, 3, 0], [1, 0, 2], [4, 4, 4]):
        probe = np.repeat(np.array(history)[:, None], 6, axis=1)
        x = np.array([0, 1, 2, 3, 4, -1])
        words, all_x, taught = np.concatenate([context, probe], axis=1), np.concatenate([ids, x]), np.append(learn, np.zeros(6, bool))
        seen = trunk.count_tails(words, all_x, taught)
        t = m.Tokens(words, all_x, taught, np.zeros(3006, np.int64), seen)
        tails = [(np.bincount(s, kept, len(keys)), np.bincount(s, minlength=len(keys))) for s, (kept, _) in m._kept_tails(trunk, t)]
        trunk.weigh([kept for kept, _ in tails])
        gains = [np.bincount(s, more, len(keys)) for s, (more,) in m._gained_tails(trunk, t)]
        trunk.prune([held for _, held in tails], gains, [level.next_n for level in trunk.levels])
        log = trunk.walk(words, all_x, seen)[1][3000:]
        p = np.exp(log + m.branches(trunk, words, all_x, taught, seen, 4)[3000:])
        assert p[:5].sum() + p[5] * (1 - root.sum()) == pytest.approx(1)


def test_held_out_texts_gain(spark):
    out = m.op9_suffix_tree_lm(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert out["score"].sum() > out["base_score"].sum()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = m.score(odd_docs, F.lit(True)).collect()
    assert len(rows) == 11 and all(r["n_known"] == r["n_tokens"] for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    unlearned = m.score(odd_docs, F.lit(False)).collect()
    assert all(r["score"] == r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in unlearned)
    assert m.score(no_docs, F.lit(True)).count() == 0
