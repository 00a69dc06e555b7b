import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from tourweave.llm import budget_mixing as m
from tourweave.llm.common import cut


def targets(words, weights, share, most):
    """Targets by repeated sharing among those that are not full, with floats; ``words`` in the sources' order."""
    w = [weights[i % len(weights)] for i in range(len(words))]
    full = set()
    while True:
        rest = share * sum(words) - sum(most * words[i] for i in full)
        open_ = sum(w[i] for i in range(len(words)) if i not in full)
        now = {i for i in range(len(words)) if i not in full and open_ and most * words[i] < rest * w[i] / open_}
        if not now:
            return [most * words[i] if i in full or not open_ else rest * w[i] / open_ for i in range(len(words))]
        full |= now


def test_nearest_sum_by_exhaustion():
    rng = random.Random(1)
    for _ in range(300):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(0, 4))]
        counts = [rng.randint(0, 4) for _ in lengths]
        budget = rng.randint(0, 120)
        taken = m.nearest_sum(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        sums = {sum(a * b for a, b in zip(t, lengths)) for t in product(*(range(c + 1) for c in counts))}
        assert sum(a * b for a, b in zip(taken, lengths)) == min(sums, key=lambda s: (abs(s - budget), s))


def test_fit_is_near_and_seeded():
    rng = random.Random(2)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 5000), rng.randint(1, 300)))
        counts = [rng.choice((1, 2, 50, 3000)) for _ in lengths]
        words = sum(a * b for a, b in zip(lengths, counts))
        budget = rng.randint(0, words)
        taken = m.fit_lengths(lengths, counts, budget, 7)
        assert taken == m.fit_lengths(lengths, counts, budget, 7) and all(0 <= t <= c for t, c in zip(taken, counts))
        off = abs(sum(t * n for t, n in zip(taken, lengths)) - budget)
        assert off <= max(lengths) / 2 + 1 and (len(lengths) < 20 or off <= 2)
    lengths = list(range(1, 400))
    assert m.fit_lengths(lengths, [1] * 399, 20_000, 1) != m.fit_lengths(lengths, [1] * 399, 20_000, 2)


def test_the_draw_keeps_the_lengths_in_proportion():
    """Half of the words of a large source: but for what fills the last words, every length gives half of its documents."""
    lengths, counts = list(range(1, 1001)), [400] * 1000
    taken = m.fit_lengths(lengths, counts, sum(lengths) * 200, 3)
    assert sum(abs(t - 200) * n for t, n in zip(taken, lengths)) < 3 * m.WINDOW and sum(t * n for t, n in zip(taken, lengths)) == sum(lengths) * 200


def test_documents_longer_than_the_window():
    assert m.fit_lengths([100_000], [10], 449_999, 1) == [4] and m.fit_lengths([100_000], [10], 450_001, 1) == [5]
    assert m.fit_lengths([10], [1], 4, 1) == [0] and m.fit_lengths([10], [1], 6, 1) == [1] and m.fit_lengths([0, 3], [5, 1], 9, 1) == [0, 1]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "B", "ä", None, "z"]) if i % 3 else "hot"
        n = 20 if i % 3 == 0 else rng.randint(0, 60)
        rows.append((i if i % 50 else 7, " ".join(["w"] * n) if i % 11 else None, source))
    rows += [(1000 + i, "the same text of a few words", "copies") for i in range(400)] + [(None, "no id", "ids")] * 300 + [(1, "", "empty"), (2, None, "empty")]
    return rows, cut(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7))


def test_whole_operator(spark, corpus):
    rows, frame = corpus
    out = [r.asDict() for r in m.mix(frame, carry=("source",)).collect()]
    assert len(out) == len(rows) and sorted(str(r[0]) for r in rows) == sorted(str(r["doc_id"]) for r in out)
    words = {}
    for _, text, source in rows:
        words[source] = words.get(source, 0) + len((text or "").split())
    order = sorted((s for s in words if s is not None), key=lambda s: s.encode()) + [None]
    expected = dict(zip(order, targets([words[s] for s in order], m.WEIGHTS, 1.5, 2)))
    taken = dict.fromkeys(order, 0)
    for r in out:
        s = r["source"]
        assert r["source_size"] == words[s] and abs(r["target"] - expected[s]) < 1e-6 * max(1, expected[s])
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2
        taken[s] += r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 10 for s in order)  # lengths of 20 and of 6 words can't always meet it
    assert abs(sum(expected.values()) - 1.5 * sum(words.values())) < 1e-6


def test_reruns_agree_whatever_the_partitions(spark, corpus):
    _, frame = corpus
    runs = [sorted(map(str, m.mix(f, carry=("source",)).collect())) for f in (frame, cut(frame.orderBy(F.rand(3)).repartition(2)))]
    assert runs[0] == runs[1]


def test_hot_lengths_in_ranges_and_pieces(spark, corpus, monkeypatch):
    """The same documents are taken when ranges are small and lengths are joined in pieces."""
    _, frame = corpus
    one = sorted(map(str, m.mix(frame, carry=("source",)).collect()))
    monkeypatch.setattr(m, "RANGE_ROWS", 8)
    monkeypatch.setattr(m, "BROADCAST_LENGTHS", 0)
    assert sorted(map(str, m.mix(frame, carry=("source",)).collect())) == one


def test_sharing_again_until_none_is_above(spark):
    for words in ([10, 100, 1000, 5], [7], [0, 0], [3, 3, 3, 3], [1, 1, 1, 100_000]):
        sources = spark.createDataFrame([(str(i), n, i) for i, n in enumerate(words)], "source string, source_size long, place long")
        found = [r["target"] for r in m.with_targets(sources, m.WEIGHTS, 1.5, 2).orderBy("place").collect()]
        assert found == pytest.approx(targets(words, m.WEIGHTS, 1.5, 2))


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for name, docs, n in (("odd", odd_docs, 11), ("none", no_docs, 0)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = m.op11_budget_mixing(spark, str(tmp_path / name))
        assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
        rows = out.collect()
        assert len(rows) == n and all(r["size"] == 0 and r["taken"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert m.mix(odd_docs, carry=("n_chars", "blob", "n", "root")).columns[:5] == ["doc_id", "n_chars", "blob", "n", "root"]
