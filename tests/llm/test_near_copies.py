import random

from tourweave.llm import near_copies as m


def brute_force(rows):
    """The ids that stay: the least of each component by Jaccard over all pairs."""
    sets = [m.shingle_set((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_near_copies_by_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for n in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 40, 120, 400]))]
        texts.append(words)
        for _ in range(rng.choice([0, 1, 2, 8])):
            words = edited(rng, words if rng.random() < 0.5 else texts[-1], rng.randrange(0, max(2, len(words) // 30)))
            texts.append(words)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(900, ""), (901, None)]
    rng.shuffle(rows)
    kept = m.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == brute_force(rows)


def test_members_that_no_leader_is_near_are_found(spark):
    # a chain: each text is near the one before only
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        for k in range(3):
            words[(7 * i + 61 * k) % 200] = f"v{i}.{k}"
    kept = m.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == brute_force(rows) == {0}


def test_a_group_whose_members_are_near_its_first_text_only(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 7)
    monkeypatch.setattr(m, "AGAINST", 50)
    rng = random.Random(9)
    first = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rng, first, rng.randrange(9)))) for i in range(160)]
    kept = m.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == brute_force(rows)


def test_the_stage_drops_what_simhash_at_two_bits_keeps(spark):
    import corpus_pipeline
    from tourweave.llm import simhash_dedup

    rng = random.Random(3)
    words = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = [(1, " ".join(words)), (2, " ".join(edited(rng, words, 2)))]
    assert brute_force(rows) == {1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash_dedup.drop_near_duplicates(docs).count() == 2
    assert [r["doc_id"] for r in corpus_pipeline.near_dups(spark, docs, "").collect()] == [1]


def test_the_stage_links_by_simhash_and_by_near_copies_together(spark):
    """1 and 2 are linked by their fingerprints only, as passages that repeat decide them; 3 and 4 are near copies only."""
    import corpus_pipeline
    from tourweave.llm import simhash_dedup

    rng = random.Random(4)
    line = " ".join(f"l{i}" for i in range(51))  # an odd number of shingles, so each bit has a majority
    texts = {n: f"{line} " * 60 + " ".join(f"x{n}.{i}" for i in range(10)) for n in (1, 2)}
    words = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts |= {3: " ".join(words), 4: " ".join(edited(rng, words, 2)), 5: "a text of its own, and nothing is like it at all"}
    rows = sorted(texts.items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert brute_force(rows) == {1, 2, 3, 5}
    assert {r["doc_id"] for r in simhash_dedup.drop_near_duplicates(docs).collect()} == {1, 3, 4, 5}
    assert {r["doc_id"] for r in corpus_pipeline.near_dups(spark, docs, "").collect()} == {1, 3, 5}


def test_odd_rows(spark, odd_docs, no_docs):
    kept = m.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 6
    assert m.drop_near_copies(no_docs).count() == 0
