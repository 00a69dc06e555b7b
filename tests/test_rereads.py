"""Page geometry, evidence, and what is read again."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_pages import CUSTOMERS, WORDS, page
from tourweave.functions import rounds as R
from tourweave.operators import geometry as G, layout as Y, pages, rereads

PAGE = "page_id long, width double"
PAIRED = {("label", 0, 0): R.Reading("xx", 10.0), ("label", 1, 0): R.Reading("Kollektion (B)", 60.0), ("number", 0, 0): R.Reading("41", 50.0), ("number", 1, 0): R.Reading(), ("number", 3, 0): R.Reading("38/ 37", 40.0), ("number", 4, 0): R.Reading("38/37", 30.0)}


def played(evidence, table):
    """The result, and what was asked in each round."""
    known, asked = {}, []
    while not isinstance(found := R.resume(R.decide(evidence), known), R.Result):
        asked.append(found)
        known |= {k: table.get(k, R.Reading()) for k in found}
    return found, asked


def test_only_what_is_needed_is_asked():
    assert played(R.PageReading("Lieferpaket"), {}) == (R.Result("Lieferpaket", "", "Lieferpaket"), [])
    found, asked = played(R.PageReading(), PAIRED)
    assert (found.delivery_type, found.delivery_review) == ("Kollektion 38 B", "") and found.delivery_source == "Kollektion (B) | 38/ 37"
    assert asked == [[("label", 0, 0)], [("label", 1, 0)], [("number", 0, 0), ("number", 1, 0)], [("number", 3, 0)], [("number", 4, 0)]]
    sure = {("label", 0, 0): R.Reading("Kollektion (B)", 90.0), ("number", 0, 0): R.Reading("38/ 37", 90.0), ("number", 1, 0): R.Reading("38/ 37", 90.0)}
    assert [len(a) for a in played(R.PageReading("Kollektion (B)", confidence=90), sure)[1]] == [1, 2]
    assert [len(a) for a in played(R.PageReading("", confidence=0), {("label", 0, 0): R.Reading("Wunsch-Kollektion", 90.0)})[1]] == [1]


def test_the_line_above_a_companion():
    up = {("label", 0, 0): R.Reading("Behältemappe COL", 90.0), ("label", 0, -1): R.Reading("Kollektion (C)", 80.0), ("number", 0, -1): R.Reading("38/ -", 90.0), ("number", 1, -1): R.Reading("38/ -", 90.0)}
    found, asked = played(R.PageReading("Behältemappe", "41", "41", 90.0), up)
    assert found.delivery_type == "Kollektion 38 C" and asked[-1] == [("number", 0, -1), ("number", 1, -1)]


def test_uncertain_pairs_need_a_second_look():
    base = {("label", 0, 0): R.Reading("Kollektion (B)", 90.0), ("number", 2, 0): R.Reading("41\n38/ 37", 42.0)}
    page_ = R.PageReading("Kollektion (B)", confidence=90)
    for again, sure in (("38/37", True), ("3837", True), ("38 37", True), ("39/37", False), ("", False), ("383", True), ("38371", False)):
        found, asked = played(page_, base | {("number", 4, 0): R.Reading(again, 20.0)})
        assert (found.delivery_type, found.delivery_review == "") == ("Kollektion 38 B", sure), again
        assert [k for a in asked for k in a] == [("label", 0, 0), ("number", 0, 0), ("number", 1, 0), ("number", 3, 0), ("number", 2, 0), ("number", 4, 0)]
    two = base | {("number", 2, 0): R.Reading("41/40\n38/ 37", 42.0)}  # two lines with pairs: none is chosen
    assert played(page_, two)[0].delivery_type == "Kollektion"
    lone = {("label", 0, 0): R.Reading("Kollektion (B)", 90.0), ("number", 2, 0): R.Reading("38", 90.0, True)}
    assert played(page_, lone)[0].delivery_type == "Kollektion 38 B" and played(page_, lone | {("number", 2, 0): R.Reading("38", 90.0, False)})[0].delivery_type == "Kollektion"


def test_an_earlier_reading_counts_as_a_vote():
    def of(number, earlier):
        return played(R.PageReading("Kollektion (B)", number, f"{number}/1", 40.0, (), earlier), {("label", 0, 0): R.Reading("Kollektion (B)", 90.0)})[0]

    assert "unsicher" in of("38", None).delivery_review
    assert of("38", R.PageReading("Kollektion (B)", "38", "38/1", 40.0)).delivery_review == ""
    assert "38 oder 39" in of("38", R.PageReading("Kollektion (B)", "39", "39/1", 90.0)).delivery_review
    assert "unsicher" in of("38", R.PageReading("Punktemappe", "39", "39/1", 90.0)).delivery_review
    assert "Behaltemappe zeigt 41" in of("38", R.PageReading("Kollektion (B)", "38", "38/1", 40.0, ("41",))).delivery_review


READS = "stop_id string, kind string, variant int, y_shift int, text string, confidence double"
EVIDENCE = "struct<label:string,number:string,number_text:string,confidence:double,companion_numbers:array<string>,other_rows:int>"
CELLS = "struct<yd:double,h:double,slope:double,gap:double,label_x0:double,label_x1:double,number_x0:double,number_x1:double>"


def test_rounds_come_to_what_all_readings_give(spark):
    """Random stops: asking in rounds gives what ``refine`` gives with every variant at hand, and never asks what is not needed."""
    rng = random.Random(4)
    labels = ["Kollektion (B)", "Kollektion", "Sommer Kollektion (C)", "Lieferpaket", "Behaltemappe COL", "Punktemappe", "Wunsch-Kollektion", "xx", ""]
    numbers = ["38/ 37", "38", "41", "38/37\n41", "41/40\n38/37", "3837", "", "39/ -"]
    stops, reads = [], []
    for i in range(150):
        number = rng.choice([None, "38", "39"])
        evidence = (rng.choice(labels), number, f"{number}/1" if number and rng.random() < 0.5 else number or "", rng.choice([30.0, 80.0, 95.0]), rng.choice([[], ["41"], ["38"]]), rng.choice([0, 1]))
        stops.append((str(i), evidence, (100.0, 12.0, 0.01, 18.0, 318.0, 545.0, 600.0, 675.0) if i % 10 else None, "before", "note", "source"))
        for kind, variants, texts in (("label", (0, 1), labels), ("number", range(5), numbers)):
            reads += [(str(i), kind, v, s, rng.choice(texts), rng.choice([None, 20.0, 60.0, 90.0])) for v in variants for s in (0, -1) if rng.random() < 0.85]
    frame = spark.createDataFrame(stops, f"stop_id string, evidence {EVIDENCE}, cells {CELLS}, delivery_type string, delivery_review string, delivery_source string").cache()
    table = spark.createDataFrame(reads, READS).cache()
    asked_of = []

    def answer(requests):
        asked_of.append(requests)
        return requests.join(table, ["stop_id", "kind", "variant", "y_shift"]).select(*table.columns, F.lit(None).cast("array<struct<text:string,x0:double,x1:double>>").alias("words"), F.lit(False).alias("failed"))

    got, log = rereads.refine_in_rounds(frame, answer)
    whole = rereads.refine(frame.where("cells is not null").select("stop_id", "evidence.*"), table)
    found = {r["stop_id"]: (r["delivery_type"], r["delivery_review"]) for r in got.collect()}
    assert {k: v for k, v in found.items() if int(k) % 10} == {r[0]: (r[1], r[2]) for r in whole.collect()}
    assert all(v == ("before", "note") for k, v in found.items() if int(k) % 10 == 0)
    asked = [tuple(r) for r in log.collect()]
    assert len(asked) == len({a[1:] for a in asked}) and len(asked_of) == max(a[0] for a in asked) <= 7
    assert len(asked) < 0.6 * 14 * 135


def test_failed_and_unanswered_readings(spark):
    page_ = ("Kollektion (B)", "38", "38/1", 90.0, [], 0)
    frame = spark.createDataFrame([(s, page_, (100.0, 12.0, 0.0, 18.0, 318.0, 545.0, 600.0, 675.0), "type", "note", "source") for s in ("fails", "silent")], f"stop_id string, evidence {EVIDENCE}, cells {CELLS}, delivery_type string, delivery_review string, delivery_source string")
    answer = lambda q: q.where("stop_id = 'fails'").select("stop_id", "kind", "variant", "y_shift", F.lit("").alias("text"), F.lit(0.0).alias("confidence"), F.lit(None).cast("array<struct<text:string,x0:double,x1:double>>").alias("words"), F.lit(True).alias("failed"))
    got, log = rereads.refine_in_rounds(frame, answer)
    assert {r["stop_id"]: tuple(r)[1:] for r in got.collect()} == {"fails": ("type", "note", "source"), "silent": ("Kollektion 38 B", "", "Kollektion (B) | 38/1")}
    assert log.where("stop_id = 'fails'").count() == 1


def test_where_a_lone_number_stands(spark):
    """In a tall strip a number without a pair counts only in the left part of its cell."""
    frame = spark.createDataFrame([(s, ("Kollektion (B)", None, "", 90.0, [], n), (100.0, 12.0, 0.0, 18.0, 318.0, 545.0, 600.0, 675.0), "", "", "") for s, n in (("left", 0), ("right", 0), ("second", 1))], f"stop_id string, evidence {EVIDENCE}, cells {CELLS}, delivery_type string, delivery_review string, delivery_source string")

    def answer(q):
        here = F.when(F.col("stop_id") == "right", F.col("keep_x0") + F.col("pad") + 0.8 * (F.col("keep_x1") - F.col("keep_x0"))).otherwise(F.col("keep_x0") + F.col("pad") + 5)
        tall = (F.col("kind") == "number") & (F.col("variant") == 2)
        return q.select("stop_id", "kind", "variant", "y_shift", F.when(tall, "38").when(F.col("kind") == "label", "Kollektion (B)").otherwise("").alias("text"), F.lit(90.0).alias("confidence"), F.when(tall, F.array(F.struct(F.lit("38").alias("text"), here.alias("x0"), (here + 4).alias("x1")))).alias("words"), F.lit(False).alias("failed"))

    got = {r["stop_id"]: r["delivery_type"] for r in rereads.refine_in_rounds(frame, answer)[0].collect()}
    assert got == {"left": "Kollektion 38 B", "right": "Kollektion", "second": "Kollektion"}


def with_evidence(spark, words, baselines=None):
    a = pages.analyse(spark.createDataFrame(words, WORDS), spark.createDataFrame([(1, 1000.0)], PAGE), baselines)
    return pages.stops_with_evidence(a).orderBy("pos").collect()


def test_evidence_of_a_page(spark):
    words = page(CUSTOMERS)
    # a companion's row below the first stop's delivery, with a number of its own
    words += [(1, 900, "Behaltemappe", 400.0, 480.0, 96.0, 108.0, 99.0), (1, 901, "COL", 490.0, 520.0, 96.0, 108.0, 99.0), (1, 902, "41/40", 682.0, 710.0, 96.0, 108.0, 99.0)]
    got = with_evidence(spark, words)
    first = got[0]
    assert (first["delivery_type"], first["delivery_source"]) == ("Kollektion 38 B", "Kollektion (B) | 38/37")
    assert first["evidence"].asDict() == {"label": "Kollektion (B)", "number": "38", "number_text": "38/37", "confidence": 99.0, "companion_numbers": ["41"], "other_rows": 1}
    assert got[3]["delivery_review"] == "Liefermenge unsicher erkannt. Bitte am PDF prüfen." and got[3]["evidence"]["confidence"] == 42.0
    cells = first["cells"]
    assert cells["yd"] == pytest.approx(84) and cells["gap"] == pytest.approx(18) and cells["label_x0"] == pytest.approx(388) and cells["number_x0"] == pytest.approx(673)


def test_only_the_companion_was_read(spark):
    """The row above it is what the cells look at, and nothing is decided from the page."""
    customers = [(1, "Firma Eins", "Lindenweg 3", "2020 Hollabrunn", "Behaltemappe COL", "41/40", 99)]
    (r,) = with_evidence(spark, page(customers))
    assert (r["delivery_type"], r["evidence"]["label"], r["evidence"]["companion_numbers"], r["evidence"]["other_rows"]) == ("", "", ["41"], 1)
    assert r["cells"]["yd"] == pytest.approx(84 - 18)


def bent(words, slope_of):
    """Every word moved down by its row's slope times its middle."""
    return [(p, i, t, x0, x1, y0 + slope_of(y0) * (x0 + x1) / 2, y1 + slope_of(y0) * (x0 + x1) / 2, c) for p, i, t, x0, x1, y0, y1, c in words]


def test_pages_with_a_slope_of_their_own(spark):
    for slope in (0.04, -0.03):
        got = with_evidence(spark, bent(page(CUSTOMERS), lambda y: slope))
        assert [r["delivery_type"] for r in got] == ["Kollektion 38 B", "Lieferpaket", "Kollektion", "Kollektion 35 D"] and [r["address"] for r in got] == [c[2] for c in CUSTOMERS]
        assert got[0]["cells"]["slope"] == pytest.approx(slope, abs=1e-6)


def test_bent_pages_by_their_baselines(spark):
    """The slope changes down the page; baselines near a line say which it is."""
    slope_of = lambda y: 0.0 if y < 150 else 0.03 if y < 300 else 0.05
    lines = [(1, 0.0, 300.0, float(y), y + slope_of(y) * 300) for y in range(0, 480, 15)]
    baselines = spark.createDataFrame(lines, "page_id long, x0 double, x1 double, y0 double, y1 double")
    customers = [(i, f"Firma {n}", f"Lindenweg {i}", "2070 Retz", "Kollektion (B)", f"3{i}/1", 99) for i, n in enumerate(("Eins", "Zwei", "Drei", "Vier"), 1)]
    words = bent(page(customers), slope_of)
    got = with_evidence(spark, words, baselines)
    assert [r["address"] for r in got] == [c[2] for c in customers] and got[3]["delivery_type"] == "Kollektion 34 B"


def test_columns_that_lean_by_different_amounts(spark):
    words = []
    for p, i, t, x0, x1, y0, y1, c in page([(i, "Firma Eins", f"Weg {i}", "2070 Retz", "Lieferpaket", "", 99) for i in range(1, 9)]) + [(1, 800 + i, "neu", 622.0, 640.0, 78.0 + 90 * i, 90.0 + 90 * i, 99.0) for i in range(8)]:
        d = (0.01 + 0.0001 * x0) * ((y0 + y1) / 2 - 26)
        words.append((p, i, t, x0 + d, x1 + d, y0, y1, c))
    g = G.measure(spark.createDataFrame(words, WORDS), spark.createDataFrame([(1, 1000.0)], PAGE)).first()
    lean = lambda x: g["drift_m"] + g["drift_b"] * (x - g["drift_x0"])
    assert lean(400) == pytest.approx(0.05, abs=0.004) and lean(622) == pytest.approx(0.0722, abs=0.004) and g["drift_b"] > 0
    assert [r["delivery_type"] for r in with_evidence(spark, words)] == ["Lieferpaket"] * 8


def test_a_lost_block_is_asked_for_and_read(spark):
    words = page(CUSTOMERS)
    lost = [w for w in words if 150 <= w[5] < 235]
    assert len({w[5] for w in lost}) == 4
    frame, pages_ = spark.createDataFrame([w for w in words if w not in lost], WORDS), spark.createDataFrame([(1, 1000.0)], PAGE)
    missing = spark.createDataFrame(lost, WORDS)
    calls = []

    def answer(requests):
        calls.append(requests.count())
        r = requests.select("page_id", "region_id", "yd", "half", "pad", F.col("x0").alias("rx"))
        w = missing.join(r, "page_id").where(F.abs((F.col("y0") + F.col("y1")) / 2 - F.col("yd")) <= F.col("half"))
        down = lambda c: F.col(c) + F.col("half") - F.col("yd") + F.col("pad")
        return w.select("page_id", "region_id", (F.col("word_id") + 1000).alias("word_id"), "text", (F.col("x0") + F.col("pad")).alias("x0"), (F.col("x1") + F.col("pad")).alias("x1"), down("y0").alias("y0"), down("y1").alias("y1"), "confidence")

    assert [r["address"] for r in pages.read_pages(frame, pages_).orderBy("pos").collect()] == ["Lindenweg 3", "Hauptgasse 7", "Rosenweg 9"]
    stops, log = rereads.read_with_regions(frame, pages_, answer)
    got = stops.orderBy("pos").collect()
    assert [(r["address"], r["delivery_type"]) for r in got] == [(c[2], t) for c, t in zip(CUSTOMERS, ("Kollektion 38 B", "Lieferpaket", "Kollektion", "Kollektion 35 D"))]
    assert calls == [1] and [tuple(r) for r in log.collect()] == [(1, 1, 1, len(lost))]
    assert [r["earlier"] is not None for r in got] == [True, False, True, True] and got[3]["earlier"]["number"] == "35"
    silent, log = rereads.read_with_regions(frame, pages_, lambda q: answer(q).where("false"))
    assert silent.count() == 3 and [tuple(r)[1:] for r in log.collect()] == [(1, 1, 0)]


def test_refined_stops(spark):
    pages_ = spark.createDataFrame([("a", "Kollektion (B)", None, "", 90.0, []), ("b", "Lieferpaket", None, "", 90.0, None)], "stop_id string, label string, number string, number_text string, confidence double, companion_numbers array<string>")
    reads = spark.createDataFrame([("a", "label", 0, 0, "Kollektion (B)", 90.0), ("a", "number", 0, 0, "38/ 37", 90.0), ("b", "label", 0, 0, "Kollektion (C)", 99.0)], READS)
    assert sorted(map(tuple, rereads.refine(pages_, reads).collect())) == [("a", "Kollektion 38 B", ""), ("b", "Lieferpaket", "")]


def test_no_pages(spark):
    none = spark.createDataFrame([], WORDS), spark.createDataFrame([], PAGE)
    assert rereads.read_with_regions(*none, lambda q: q)[0].count() == 0 and Y.find_header(*none).count() == 0


def _stored(df, path):
    """As from files, whose size Spark knows."""
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lean_is_measured_without_broadcasts(spark, tmp_path):
    """Files say little about what a side of a join takes in memory, so pages are never broadcast; families of all sizes give together what each gives alone."""
    rng = random.Random(5)
    points = [(p, str(f), i, 200.0 * f + 0.01 * (p - 5) * y + (40 if rng.random() < 0.1 else rng.random()), y) for p in range(12) for f in range(1, 4) for i, y in enumerate(rng.uniform(0, 900) for _ in range(rng.randrange(1, 14)))]
    points.append((3, "1", 99, float("nan"), 100.0))
    anchors = _stored(spark.createDataFrame(points, "page_id long, family string, pos long, x double, y double"), tmp_path / "anchors")
    found = Y.column_drift(anchors, _stored(spark.createDataFrame([(p, 1000.0) for p in range(12)], PAGE), tmp_path / "pages"))
    assert "Broadcast" not in _plan(found)

    middle = lambda v: sorted(v)[len(v) // 2]
    slopes = lambda ps: [(b[0] - a[0]) / (b[1] - a[1]) for i, a in enumerate(ps) for b in ps[i + 1 :] if abs(b[1] - a[1]) > 120]
    expected = {}
    for page_ in range(12):
        fits = []
        for family in "123":
            own = [(x, y) for p, f, _, x, y in points if (p, f) == (page_, family) and x == x]
            if len(own) < 3 or max(y for _, y in own) - min(y for _, y in own) < 300 or not slopes(own) or abs(middle(slopes(own))) > 0.12:
                continue
            rest = [x - middle(slopes(own)) * y for x, y in own]
            kept = [p for p, r in zip(own, rest) if abs(r - middle(rest)) < 20]
            if len(kept) >= 3 and slopes(kept):
                fits.append((len(kept), middle([x for x, _ in kept]), middle(slopes(kept))))
        if fits:
            w = sum(f[0] for f in fits)
            mx, md = sum(f[0] * f[1] for f in fits) / w, sum(f[0] * f[2] for f in fits) / w
            bent = len(fits) >= 2 and max(f[1] for f in fits) - min(f[1] for f in fits) > 200
            expected[page_] = [md, sum(f[0] * (f[1] - mx) * (f[2] - md) for f in fits) / sum(f[0] * (f[1] - mx) ** 2 for f in fits) if bent else 0.0, mx]
    got = {r["page_id"]: [r["drift_m"], r["drift_b"], r["drift_x0"]] for r in found.collect()}
    assert got.keys() == expected.keys() and len(got) >= 8
    assert all(v == pytest.approx(expected[p], abs=1e-9) for p, v in got.items())


def test_geometry_is_measured_without_broadcasts(spark, tmp_path):
    boxes = [(1, 1, "Klasse", 620.0, 660.0, 20.0, 32.0), (1, 2, "neu", 621.0, 650.0, 100.0, 112.0), (2, 3, "x", 1.0, 9.0, 5.0, 9.0), (2, 4, "Klasse", 1.0, float("nan"), 5.0, 9.0), (2, 5, None, 1.0, 9.0, 5.0, 9.0)]
    words = _stored(spark.createDataFrame(boxes, "page_id long, word_id long, text string, x0 double, x1 double, y0 double, y1 double"), tmp_path / "words")
    found = G.measure(words, _stored(spark.createDataFrame([(1, 1000.0), (2, 1000.0)], PAGE), tmp_path / "pages"))
    assert "Broadcast" not in _plan(found)
    assert [(r["page_id"], r["found"], r["class"]) for r in found.orderBy("page_id").collect()] == [(1, True, 614.0), (2, False, 545.0)]


def test_a_round_of_readings_is_one_join_and_decides_alike_stops_once(spark):
    """The first round works on what a stop has, without broadcasts; stops that say the same are decided once."""
    evidence = ("Kollektion (B)", None, "", 90.0, [], 0)
    cells = (100.0, 12.0, 0.0, 18.0, 318.0, 545.0, 600.0, 675.0)
    stops = spark.createDataFrame([(f"s{i}", evidence, cells, "", "", "") for i in range(40)] + [("odd", (None, None, None, None, None, None), cells, "a", "b", "c"), ("none", evidence, None, "a", "b", "c")], "stop_id string, evidence struct<label:string,number:string,number_text:string,confidence:double,companion_numbers:array<string>,other_rows:int>, cells struct<yd:double,h:double,slope:double,gap:double,label_x0:double,label_x1:double,number_x0:double,number_x1:double>, delivery_type string, delivery_review string, delivery_source string")
    asked = []

    def answer(q):
        asked.append(q)
        said = F.when(F.col("kind") == "label", "Kollektion (B)").otherwise("38/ 37")
        return q.select("stop_id", "kind", "variant", "y_shift", said.alias("text"), F.lit(float("nan")).alias("confidence"), F.lit(None).cast("array<struct<text:string,x0:double,x1:double>>").alias("words"), (F.col("stop_id") == "odd").alias("failed"))

    got, log = rereads.refine_in_rounds(stops, answer)
    assert {r["stop_id"]: r["delivery_type"] for r in got.collect()} == {f"s{i}": "Kollektion 38 B" for i in range(40)} | {"odd": "a", "none": "a"}
    assert sorted((r["round"], r["n"]) for r in log.groupBy("round").agg(F.count("*").alias("n")).collect()) == [(1, 41), (2, 80)]
    # the boxes of a round come from the stops' own rows
    assert "Join" not in _plan(asked[0]) and "Join" not in _plan(asked[1])
    rereads._decided.cache_clear()
    one = '{"evidence":{"label":"Lieferpaket","confidence":90.0}}'
    assert rereads._decided(one, False) is rereads._decided(one, False)


def test_lines_and_slopes_are_read_once_and_alike(spark):
    """What begins a customer and what holds a postal line, by scalars as by columns; slopes by columns as by scalars, without Python."""
    from tourweave.functions import lines as L

    texts = ["1 KNR: 12345", "Weg 3 A-2020 Retz", "A-2020 Retz", "2020 Tel: 1", "Weg 3 A-2020 Retz Tel: 5", "x KN. 12345 y", "12 Firma 123456", "Firma", "", "===PAGE_3===", "| 2070  Retz P"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    column = (L.is_header(F.col("t")) | F.col("t").rlike(pages.CUSTOMER)).alias("a"), F.exists(L.split_lines(F.col("t")), lambda x: L.postal_line(x).isNotNull()).alias("p")
    assert [tuple(r) for r in df.select(*column).collect()] == [tuple(r) for r in df.select(pages.line_kinds(F.col("t")).alias("k")).select("k.*").collect()]

    knots = [([100.0, 150.0, 160.0, 700.0], [0.01, 0.03, 0.02, 0.05]), ([100.0, 500.0, 900.0], [0.01, 0.09, 0.095]), ([1.0, 2.0], [0.05, 0.05]), (None, None)]
    rows = [(y, ky, ks, fallback, 1000.0) for y in (0.0, 120.0, 640.0, 2000.0) for ky, ks in knots for fallback in (0.004, -0.2)]
    df = spark.createDataFrame(rows, "y double, knot_y array<double>, knot_slope array<double>, fallback double, width double").select("*", G.slope_at(F.col("y")).alias("slope"))
    assert "Python" not in _plan(df)
    import numpy as np

    array = lambda v: None if v is None else np.array(v)
    assert [r["slope"] for r in df.collect()] == [G._slope(y, array(ky), array(ks), f, w) for y, ky, ks, f, w in rows]
