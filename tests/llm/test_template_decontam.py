import random
import re

from pyspark.sql import functions as F

from tourweave.llm import template_decontam as m

ITEM = "A train leaves Boston station at 9:30 with 120 passengers and after travelling 45 km the driver Maria counts how many passengers left the train at each stop."


def found(spark, docs, items=((1, ITEM),)):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in m.contaminated(d, b).collect()}


def test_kinds(spark):
    other = ITEM.replace("9:30", "11:15").replace("120", "80").replace("45 km", "60 miles").replace("Boston", "Denver").replace("Maria", "Peter")
    clash = "Add 5 apples and then 5 pears to the basket and say how many pieces of fruit are in it"
    docs = [
        (1, "Some words before. " + ITEM + " And after."),
        (2, "Other words, then: " + other),
        (3, "Nothing of that kind is in this text, which only mentions a train and a driver."),
        (4, clash.replace("5", "7")),
        (5, clash.replace("5 apples", "7 apples").replace("5 pears", "8 pears")),
        (6, "  ".join(ITEM.upper().lower().split()[5:21])),
    ]
    # document 5 has 14 words of its item in a row, document 6 a run of 16 in lower case
    assert found(spark, docs, [(1, ITEM), (2, clash)]) == {(1, 1): "exact", (2, 1): "template", (4, 2): "template", (5, 2): "exact", (6, 1): "exact"}


def test_stretches_of_13_words_count_and_of_12_do_not(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    docs = [(n, "before this " + " ".join(words[2 : 2 + n]) + " behind that") for n in (8, 12, 13, 16)]
    assert found(spark, docs, [(1, " ".join(words))]).keys() == {(13, 1), (16, 1)}


def test_short_items_match_whole(spark):
    docs = [(1, "so then: what is the capital of france, i asked"), (2, "what is the capital of spain")]
    assert found(spark, docs, [(5, "What is the capital of france?"), (6, "")]).keys() == {(1, 5)}


def brute_force(docs, items):
    out = set()
    pattern = re.compile(r"[^\W_]+")
    for i, t in docs:
        w = ["".join(pattern.findall(x)).lower() for x in t.split()]
        for k, s in items:
            v = ["".join(pattern.findall(x)).lower() for x in s.split()]
            if any(w[a : a + len(v)] == v for a in range(len(w) - len(v) + 1)):
                out.add((i, k))
    return out


def test_whole_items_by_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    b = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    expected = brute_force([tuple(r) for r in d], [tuple(r) for r in b])
    got = {(r["doc_id"], r["item_id"]) for r in m.op10_template_decontamination(spark, "/root/testdata/sf0.01").collect()}
    assert expected <= got and len(expected) > 10
    # what is found besides shares a run of 13 words
    for i, k in got - expected:
        w = " ".join(next(r["text"] for r in d if r["doc_id"] == i).lower().split())
        v = next(r["text"] for r in b if r["item_id"] == k).lower().split()
        assert any(" ".join(v[a + 1 : a + 12]) in w for a in range(len(v) - 12))


def test_random_slots(spark):
    rng = random.Random(4)
    docs, kinds = [], {}
    for i in range(30):
        a, b = rng.randint(1, 9), rng.randint(1, 9)
        docs.append((i, f"the farmer has {a} red hens and {b} brown hens in the yard near the old barn by the river"))
        kinds[i] = "exact" if (a, b) == (3, 4) else "template" if a != b else None
    got = found(spark, docs, [(1, docs[0][1].replace(f"has {docs[0][1].split()[3]}", "has 3").replace(f"and {docs[0][1].split()[7]}", "and 4"))])
    assert {i: got.get((i, 1)) for i in kinds} == kinds


def test_plan_is_native(spark):
    plan = m.op10_template_decontamination(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_shuffled_join_finds_the_same(spark, monkeypatch):
    docs = [(1, ITEM), (2, "nothing here")]
    monkeypatch.setattr(m, "BROADCAST_ROWS", 0)
    assert found(spark, docs) == {(1, 1): "exact"}


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", 1), (1, "one two three four five six seven eight nine ten", 1), (None, None, 2), (3, "", 2)], "item_id long, text string, pos int")
    assert {(r["doc_id"], r["item_id"]) for r in m.contaminated(odd_docs, items).collect()} == {(1, 1), (2, 1)}
    kept = m.drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == 8
    assert m.contaminated(no_docs, items).count() == 0 and m.contaminated(odd_docs, items.where("false")).count() == 0
    assert m.drop_contaminated(odd_docs, items.where(F.lit(False))).count() == 11


def test_verbatim_copies_count_whatever_their_slots(spark):
    numbers = "Find the sum of the numbers: 12 45 78 90 11 22 33 44 55 66 77"
    shop = "A small shop by the river sells fresh bread, red apples and green pears every morning, sells 5 cakes and 5 buns to each guest"
    docs = [(1, numbers), (2, f"so: {numbers} and more"), (3, shop.replace("5 buns", "6 buns")), (4, "Find the sum of the numbers: 12 45 and nothing else of it at all here")]
    assert found(spark, docs, [(1, numbers), (2, shop)]) == {(1, 1): "exact", (2, 1): "exact", (3, 2): "exact"}


def test_numbers_changed_in_an_item_of_numbers(spark):
    numbers = "Find the sum of the numbers: 12 45 78 90 11 22 33 44 55 66 77"
    docs = [(1, "Find the sum of the numbers: 1 2 3 4 5 6 7 8 9 10 11"), (2, "Find the sum of the numbers: 1 2 3 4 5 6 7 8 9 1 1")]
    assert found(spark, docs, [(1, numbers)]) == {(1, 1): "template"}


def test_names_that_begin_sentences(spark):
    alice = "Alice has 5 apples and 3 pears. Bob has 7 plums. Alice gives Bob 2 apples. How many apples does Alice have now?"
    carol = alice.replace("Alice", "Carol").replace("Bob", "David").replace("has 5", "has 6").replace("and 3", "and 4").replace("has 7", "has 9")
    short = "Emma buys 4 green pens at the market."
    docs = [
        (1, carol), (2, "A question. " + carol + " And more."), (3, carol.replace("David 2", "Emil 2")),
        (4, "Then: " + short.replace("Emma", "Jonas").replace("4", "6")), (5, "We saw that Jonas buys 6 green pens at the market."),
        (6, short.lower()), (7, "Nobody there buys 6 red pens at the market."),
    ]
    got = found(spark, docs, [(1, alice), (2, short)])
    assert got == {(1, 1): "template", (2, 1): "template", (4, 2): "template", (5, 2): "template", (6, 2): "exact"}


def test_verbatim_copies_at_any_place_in_any_case(spark):
    """Recall on copies of whole items and of runs of 13 words is 1.00; texts without a copy stay."""
    rng = random.Random(8)
    words = "the of river train counts apples yellow market garden window buys sells under bridge seven morning teacher paper 12 9:30 3.5 45 km Maria Boston Peter Elena 1,250 (see) end. which, does".split()
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([5, 9, 12, 14, 20, 40]))).capitalize() + rng.choice(["?", ".", ""])) for k in range(25)]
    cases = (str, str.lower, str.upper, str.title)
    docs, expected = [], set()
    for i in range(300):
        k, text = items[i % 25]
        part = text.split()
        if len(part) > 13 and rng.random() < 0.5:
            at = rng.randrange(len(part) - 12)
            part = part[at : at + 13]
        around = [" ".join(f"filler{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 9]))) for _ in range(2)]
        docs.append((i, f"{around[0]} {cases[i // 25 % 4](' '.join(part))} {around[1]}"))
        expected.add((i, k))
    docs += [(1000 + i, " ".join(f"other{rng.randrange(10**6)}" for _ in range(40))) for i in range(20)]
    got = found(spark, docs, items)
    assert expected <= got.keys() and not any(i >= 1000 for i, _ in got)


def test_long_runs_of_one_kind_do_not_recurse(spark):
    n = 1_000_000
    texts = [",".join(["7"] * n), "9 " * (n // 2), "A" + "b" * n, "Ab" * (n // 2), "-" * n, "é" * n, "5 km " * (n // 5), "a.b," * (n // 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, ITEM), (2, ",".join(["7"] * 5000)), (3, "8"), (4, "9 9 9 8"), (5, "Ab")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in m.contaminated(docs, items).collect()} == set()


def test_changed_numbers_in_lower_case(spark):
    assert found(spark, [(1, ITEM.lower().replace("120", "80"))]) == {(1, 1): "template"}


def test_least_tokens_and_units(spark):
    d = spark.createDataFrame([(1, "so Paris it is"), (2, "wir fahren 7 stunden mit dem zug nach wien und dann 3 stunden weiter nach graz")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "Paris"), (2, "wir fahren 5 stunden mit dem zug nach wien und dann 2 tage weiter nach graz")], "item_id long, text string")
    pairs = lambda **o: {(r["doc_id"], r["item_id"]) for r in m.contaminated(d, b, **o).collect()}
    assert pairs() == {(1, 1)} and pairs(least_tokens=3) == set() and pairs(units=("stunden", "tage"), least_tokens=3) == set()
    assert pairs(units=("stunden",), least_tokens=3) == set()
