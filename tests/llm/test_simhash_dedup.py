import random

import numpy as np

from tourweave.llm import simhash_dedup as m


def brute_force(fps: list[int], radius: int) -> list[int]:
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near_groups(rng: random.Random, n: int) -> list[int]:
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        out.append(x)
        for _ in range(rng.choice([0, 0, 1, 6, 40])):  # chains that drift away from x
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return sorted(set(out))


def test_fingerprint_by_definition():
    import xxhash

    text = "The cat SAT on\nthe  mat Ä"
    words = [w.encode() for w in "the cat sat on the mat Ä".split()]
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(5)]
    expected = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 5)
    assert m.fingerprint(text.encode()) == expected
    assert m.fingerprint(b"Two words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert m.fingerprint(b" \n") == m.fingerprint(None) == 0


def test_shard_finds_exactly_the_linked_components(monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 512)  # so that the shard splits itself
    fps = near_groups(random.Random(3), 1500)
    found = m.shard_components(np.array(fps, np.uint64), np.ones(len(fps), bool), 2)
    assert found.tolist() == brute_force(fps, 2)


def test_every_pair_meets_in_a_shard():
    fps = near_groups(random.Random(4), 1200)
    arr = np.array(fps, np.uint64)
    tree = m.VantagePointTree(arr[::3], 24, 2)
    homes, seen = np.zeros(len(fps), int), set()
    for _, home, visit in tree.route(arr):
        homes[home] += 1
        everyone = np.concatenate([home, visit])
        for i in home:
            for j in everyone[m.hamming(arr[everyone], arr[i]) <= 2]:
                seen.add((min(i, j), max(i, j)))
    pairs = {(i, j) for i in range(len(fps)) for j in range(i, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2}
    assert (homes == 1).all() and seen == pairs and tree.leaves > 8


def test_components_over_many_shards(spark):
    fps = near_groups(random.Random(5), 900)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    from tourweave.llm.components import connected_components

    roots = {r["node"]: r["root"] for r in connected_components(m.links(df, 2, shard_target=64)).collect()}
    expected = brute_force(fps, 2)
    groups: dict[int, set] = {}
    for x, r in zip(fps, expected):
        groups.setdefault(r, set()).add(int(np.uint64(x).view(np.int64)))
    for group in groups.values():
        assert len(group) == 1 and not group & roots.keys() or {roots[x] for x in group} == {min(group)}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = m.simhash_components(odd_docs).collect()
    assert len(rows) == 11
    by_id = [(r["doc_id"], r["component_id"]) for r in rows]
    assert by_id.count((2, 1)) == 2 and (1, 1) in by_id  # equal but for case
    assert {c for i, c in by_id if i in (3, 4, 5)} == {3}  # empty texts link
    assert sorted((c is None, c) for i, c in by_id if i is None) == [(False, 3), (True, None)]
    kept = m.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8]
    assert m.simhash_components(no_docs).count() == 0 and m.drop_near_duplicates(no_docs).count() == 0


def test_of_repeated_rows_one_stays(spark):
    docs = spark.createDataFrame([(5, "same text here and there", "x")] * 4 + [(9, "same text here and there", "y")], "doc_id long, text string, k string")
    assert [tuple(r) for r in m.drop_near_duplicates(docs).collect()] == [(5, "same text here and there", "x")]


def test_a_very_large_group_yields_stars_not_pairs(spark):
    centre = random.Random(6).getrandbits(64)
    fps = sorted({centre} | {centre ^ 1 << a for a in range(64)} | {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)})
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    assert m.links(df, 2, shard_target=256).count() <= 40 * len(fps)
