"""Whole pages, streams, stores and pixels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tourweave.operators import layout as Y
from tourweave.operators import pages, raster
from tourweave.sources import store
from tourweave.streaming import tours as live

WORDS = "page_id long, word_id long, text string, x0 double, x1 double, y0 double, y1 double, confidence double"


def page(customers, skip_header=False):
    """Word boxes of a list: a header line, then four lines a customer; deliveries stand on the second."""
    out = [] if skip_header else [("Kunde", 120, 20), ("Lieferung", 400, 20), ("Klasse", 620, 20), ("lief.", 682, 20), ("Preis", 803, 20), ("Kasse", 940, 20)]
    y = 60
    for number, name, street, postal, label, count, confidence in customers:
        for i, line in enumerate((f"{number} KNR: {10000 + number}", name, street, postal)):
            x = 20
            for w in line.split():
                out.append((w, x, y + 18 * i))
                x += 10 + 8 * len(w)
        x = 400
        for w in label.split():
            out.append((w, x, y + 18, confidence))
            x += 10 + 8 * len(w)
        if count:
            # without a header the number column is taken to be at its usual share of the width
            out.append((count, 640 if skip_header else 682, y + 18, confidence))
        y += 90
    return [(1, i, w[0], float(w[1]), float(w[1] + max(10, 5 * len(w[0]))), float(w[2]), float(w[2] + 12), float(w[3]) if len(w) > 3 else 99.0) for i, w in enumerate(out)]


CUSTOMERS = [(1, "Firma Eins", "Lindenweg 3", "2020 Hollabrunn", "Kollektion (B)", "38/37", 99), (2, "Firma Zwei", "Gratzl 5", "2070 Retz", "Lieferpaket", "", 99), (3, "Firma Drei", "Hauptgasse 7", "2070 Retz", "Kollektion (C)", "", 99), (4, "Firma Vier", "Rosenweg 9", "2070 Retz", "Kollektion (D)", "35/-", 42)]


@pytest.mark.parametrize("headless", [False, True])
def test_a_page(spark, headless):
    words = spark.createDataFrame(page(CUSTOMERS, headless), WORDS)
    got = pages.read_pages(words, spark.createDataFrame([(1, 1000.0)], "page_id long, width double")).orderBy("pos").collect()
    assert [(r["name"], r["address"], r["postal"]) for r in got] == [(c[1], c[2], c[3]) for c in CUSTOMERS]
    assert [r["delivery_type"] for r in got] == ["Kollektion 38 B", "Lieferpaket", "Kollektion", "Kollektion 35 D"]
    assert [bool(r["delivery_review"]) for r in got] == [False, False, True, True]


def test_rows_fold_with_a_running_mean(spark):
    ys = [10.0, 15.0, 19.0, 40.0, 41.0]
    df = spark.createDataFrame([(1, i, y, float(i), 12.0) for i, y in enumerate(ys)], "page_id long, word_id long, yd double, x double, h double")
    assert [r["row_id"] for r in Y.group_rows(df).orderBy("word_id").collect()] == [0, 0, 0, 1, 1]


def test_columns_that_lean(spark):
    anchors = [(1, f, i, x + 0.05 * y, float(y)) for f, x in (("a", 100.0), ("b", 500.0)) for i, y in enumerate(range(0, 1000, 100))]
    df = spark.createDataFrame(anchors + [(1, "a", 99, 400.0, 50.0)], "page_id long, family string, pos int, x double, y double")
    r = Y.column_drift(df, spark.createDataFrame([(1, 1000.0)], "page_id long, width double")).first()
    assert r["drift_m"] == pytest.approx(0.05) and r["drift_b"] == pytest.approx(0, abs=1e-9)


def test_local_slopes(spark):
    lines = [(1, 0.0, 200.0, 100.0 + 10 * i, 100.0 + 10 * i + 200 * 0.02) for i in range(5)] + [(1, 0.0, 50.0, 0.0, 30.0), (1, 0.0, 200.0, 0.0, 90.0)]
    df = spark.createDataFrame(lines, "page_id long, x0 double, x1 double, y0 double, y1 double")
    got = Y.local_slopes(df, spark.createDataFrame([(1, 1000.0)], "page_id long, width double")).collect()
    assert len(got) == 5 and all(r["slope"] == pytest.approx(0.02) for r in got)


def test_rereads_find_their_evidence_once(spark):
    stops = spark.createDataFrame([(1, 0, "a", 10.0, 12.0), (1, 1, "", 50.0, 12.0), (1, 2, "", 52.0, 12.0)], "page_id long, pos long, address string, yd double, h double")
    rows = spark.createDataFrame([(1, 7, "a", 300.0, 12.0), (1, 8, "x", 51.0, 12.0)], "page_id long, evidence_id long, address string, yd double, h double")
    assert sorted(map(tuple, Y.match_rereads(stops, rows).collect())) == [(1, 0, 7), (1, 1, 8)]


def test_stream_and_replay_agree(spark, tmp_path):
    rows = [(t, e, f"2024-01-01 00:{e:02d}:00", a) for t in (1, 2) for e, a in enumerate(["done", "later", "click", "not_delivered", "done", "done"])]
    events = spark.createDataFrame(rows, "tour_id long, event_id long, ts string, action string").withColumn("ts", F.to_timestamp("ts"))
    stops = spark.createDataFrame([(t, p, 10 * t + p, "done" if p == 1 else "pending") for t in (1, 2, 3) for p in range(5)], "tour_id long, pos long, stop_id long, status string")
    for i, part in enumerate((events.where("event_id < 3"), events.where("event_id >= 3"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    start = stops.groupBy("tour_id").agg(F.sort_array(F.collect_list(F.struct("pos", "stop_id", "status"))).alias("s")).select("tour_id", F.transform("s", lambda s: s["stop_id"]).alias("stop_ids"), F.transform("s", lambda s: s["status"]).alias("statuses"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = live.stream(source, start).writeStream.format("memory").queryName("tour_states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("tour_states").groupBy("tour_id").agg(F.max_by(F.struct("stop_ids", "statuses", "current_index", "n_events", "n_navigations"), "n_events").alias("s")).select("tour_id", "s.*")
    batch = live.replay(stops, events)
    assert sorted(map(str, last.collect())) == sorted(map(str, batch.where("tour_id < 3").collect()))
    assert batch.count() == 3


def test_store_backup_and_lists(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    s.put("tours", a, "id")
    s.put("tours", spark.createDataFrame([(2, "B"), (3, "c")], a.schema), "id")
    s.remove("tours", spark.createDataFrame([(1,)], "id long"), "id")
    assert sorted(map(tuple, s.read("tours").collect())) == [(2, "B"), (3, "c")]
    assert s.get("tours", F.col("id") == 3).first()["v"] == "c" and s.read("none") is None
    with pytest.raises(ValueError, match="unsupported"):
        store.read_lists(spark, "x.docx")
    with pytest.raises(ValueError, match="words"):
        store.read_lists(spark, "x.pdf")
    (tmp_path / "l.txt").write_text("a\nb")
    assert store.read_lists(spark, str(tmp_path / "l.txt")).first()["text"] == "a\nb"
    stops = spark.createDataFrame([(1, 0, 'say "x"', "", None, "", "done", "n")], "tour_id long, pos long, name string, address string, postal string, delivery_type string, status string, note string")
    assert store.csv_files(stops).first()["content"] == '﻿"Nr";"Kunde";"Adresse";"PLZ Ort";"Lieferart";"Status";"Notiz"\n"1";"say ""x""";"";"";"Nicht angegeben";"done";"n"'


def test_older_generations(spark):
    none = spark.createDataFrame([], "tour_id long")
    v4, v3 = spark.createDataFrame([], "pos long, name string, address string, postal string"), spark.createDataFrame([(0, "Weg 1")], "pos long, address string")
    assert [tuple(r) for r in store.migrate(none, [v4, v3]).collect()] == [(0, "", "Weg 1", "")]
    assert store.migrate(spark.createDataFrame([(1,)], "tour_id long"), [v4, v3]).count() == 0


def test_paced_calls(spark):
    def call(body):
        if body == "bad":
            raise ValueError("no")
        return body.upper()

    got = store.paced(spark.createDataFrame([("1", "a"), ("2", "bad")], "request_id string, body string"), call, interval=0.01).collect()
    assert sorted((r["request_id"], r["response"], r["error"]) for r in got) == [("1", "A", None), ("2", None, "ValueError: no")]


def test_candidates_from_answers(spark):
    body = '{"features":[{"geometry":{"coordinates":[16.4,48.2]},"properties":{"street":"Weg","housenumber":"1","postcode":"1220","town":"Wien","country":"AT"}},{"geometry":null,"properties":{}}]}'
    rows = store.candidates_from_json(spark.createDataFrame([(1, body)], "request_id long, response string")).orderBy("cand_pos").collect()
    assert (rows[0]["lat"], rows[0]["lon"], rows[0]["label"]) == (48.2, 16.4, "Weg 1, 1220 Wien, AT") and rows[1]["lat"] is None


def flood(mask):
    """Eight-connected labels, pixel by pixel."""
    seen, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if seen[start]:
            continue
        n += 1
        stack = [start]
        while stack:
            y, x = stack.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not seen[y, x]:
                seen[y, x] = n
                stack += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return seen, n


def test_components_by_flood():
    rng = np.random.default_rng(1)
    for p in (0.2, 0.4, 0.6):
        mask = rng.random((30, 40)) < p
        a, n = raster.components(mask)
        b, k = flood(mask)
        assert n == k and len({(x, y) for x, y in zip(a[mask], b[mask])}) == n and not a[~mask].any()


def test_rules_go_and_letters_stay():
    g = np.full((60, 120), 255.0)
    g[20:40, 30:40] = 0  # a letter
    g[2:58, 15] = 0  # a rule
    g[30, 80] = 0  # a dot
    g[0:20, 100:110] = 0  # cut by the edge
    g[22:38, 60:70] = 160  # grey: ink at 165 only
    out = raster.clear_rules(g, 20)
    assert set(np.unique(out)) == {0, 255} and (out[20:40, 30:40] == 0).all() and (out[22:38, 60:70] == 0).all()
    assert (out == 0).sum() == 200 + 160
    assert (raster.clear_rules(g, 20, threshold=135) == 0).sum() == 200


def test_what_a_cell_keeps():
    g = np.full((60, 120), 255.0)
    g[10:30, 30:40] = 0  # half of it within 20 to 50
    g[22:40, 60:70] = 0
    g[25:40, 100:110] = 0  # right of the cell
    g[41, 62] = 0  # a speck below a letter
    keep = (20, 21, 90, 50)
    assert (raster.clear_rules(g, 20, keep=keep) == 0).sum() == 180
    assert (raster.clear_rules(g, 20, keep=keep, keep_specks=True) == 0).sum() == 180 + 1 + 200
    assert (raster.clear_rules(g, 20, keep=(20, 22, 90, 50), keep_specks=True) == 0).sum() == 181


def slanted(slope, height=200, width=300):
    g = np.full((height, width), 255.0)
    for y in range(20, height - 20, 20):
        for x in range(width):
            at = int(round(y + slope * (x - width)))
            if 0 <= at and at + 3 < height:
                g[at : at + 3, x] = 0
    return g


def test_shear_is_found_and_undone():
    g = slanted(0.04)
    measured = raster.column_shear(g, char_height=10)
    assert [y for y, _ in measured] == [35, 70, 105, 140, 170] and all(s is not None for _, s in measured)
    knots = raster.smoothed(measured)
    assert all(abs(s - 0.04) < 0.005 for _, s in knots)
    flat = raster.straighten(g, knots)
    assert ((flat < 128).sum(axis=1) > 250).sum() >= 10 > ((g < 128).sum(axis=1) > 250).sum()
    column, taken = raster.straight_column(np.concatenate([g, np.zeros((200, 50))], axis=1), 300.0)
    assert column.shape == (200, 300) and all(abs(s - 0.04) < 0.005 for _, s in taken)


def test_slopes_that_are_not_known():
    assert raster.smoothed([(0, None), (10, 0.01), (50, None), (60, 0.03), (70, 0.02)]) == [(0, 0.01), (10, 0.01), (50, 0.03), (60, 0.03), (70, 0.03)]
    assert raster.smoothed([(5, None)]) == [(0.0, 0.0)]


def test_words_of_a_straightened_column():
    words = pd.DataFrame({"text": ["a", " "], "x0": [100.0, 0.0], "x1": [200.0, 1.0], "y0": [40.0, 0.0], "y1": [60.0, 1.0]})
    (r,) = raster.straightened_words(words, [(0, 0.1)], 300.0, left=5.0, top=7.0).to_dict("records")
    assert (r["x0"], r["x1"], r["y0"], r["y1"], r["line_x"], r["line_y"]) == (105.0, 205.0, 27.0, 57.0, 305.0, 57.0)


def test_a_line_is_followed():
    g = np.full((60, 240), 255.0)
    for x in range(240):
        at = 22 + int(6 * x / 240)
        g[at : at + 10, x] = 0
    path, strip = raster.line_path(g, 12)
    assert strip == 4 and len(path) == 60 and (np.abs(np.diff(path)) <= 2).all() and path[-1] - path[0] in (4, 5, 6)
    out = raster.follow_line(g, 12)
    rows = [np.flatnonzero(out[:, x] < 128).mean() for x in range(240)]
    assert max(rows) - min(rows) <= 2 and raster.follow_line(g[:4], 12) is not None


def test_images_in_arrow(spark):
    g = np.full((4, 5), 255.0)
    df = spark.createDataFrame([("a", 5, 4, raster.to_rgba(g)), ("b", 0, 0, None)], "image_id string, width int, height int, rgba binary")
    got = {r["image_id"]: r for r in raster.map_images(df, lambda x: raster.crop(x, 1, 1, 3, 4)).collect()}
    assert (got["a"]["width"], got["a"]["height"], len(got["a"]["rgba"])) == (2, 3, 24) and got["b"]["rgba"] is None
