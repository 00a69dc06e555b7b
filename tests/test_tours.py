"""Plans, records and matches on small fixtures."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tourweave.operators import match, records, stats
from tourweave.plans import routes
from tourweave.streaming.tours import Tour


def stops(spark, *statuses, tour=1):
    return spark.createDataFrame([(tour, i, s.split(":")[0], "n", "a", "p", "", "", s.split(":")[1]) for i, s in enumerate(statuses)], "tour_id long, pos long, stop_id string, name string, address string, postal string, delivery_type string, note string, status string")


def ids(df):
    return [r["stop_id"] for r in df.orderBy("pos").collect()]


def test_only_selected_slots_are_refilled(spark):
    s = stops(spark, "d:done", "a:pending", "l:later", "b:pending", "f:not_delivered", "c:pending")
    out, errors = routes.reorder(s, spark.createDataFrame([(1, ["c", "a", "b"])], "tour_id long, ids array<string>"))
    assert ids(out) == ["d", "c", "l", "a", "f", "b"] and errors.count() == 0


@pytest.mark.parametrize("order, error", [(["a", "x"], "tour_changed"), (["a", "a"], "tour_changed"), (["a", "d"], "status_changed")])
def test_refused_orders_leave_the_tour_alone(spark, order, error):
    s = stops(spark, "d:done", "a:pending", "b:pending")
    orders = spark.createDataFrame([(1, order)], "tour_id long, ids array<string>")
    out, errors = routes.reorder(s, orders)
    assert ids(out) == ["d", "a", "b"] and [tuple(r) for r in errors.collect()] == [(1, error)]
    with pytest.raises(Exception, match=error):
        routes.reorder(s, orders, strict=True)[1].collect()


def test_repeated_stop_ids_are_refused(spark):
    s = stops(spark, "a:pending", "a:pending", "b:pending")
    assert routes.reorder(s, spark.createDataFrame([(1, ["b"])], "tour_id long, ids array<string>"))[1].first()["error"] == "tour_changed"


ROUTE = "struct<duration:double,distance:double,n_legs:int>"
ANSWER = f"plan_id long, n int, trip struct<code:string,trips:array<{ROUTE}>,waypoints:array<struct<waypoint_index:int,trips_index:int,distance:double>>>, baseline struct<code:string,routes:array<{ROUTE}>,waypoints:array<struct<distance:double>>>"


def answer(ranks=(0, 2, 1), trip=100.0, base=200.0, code="Ok", snap=3.0, legs=2, index=0):
    return (1, 3, (code, [(trip, 10.0, legs)], [(r, index, snap) for r in ranks]), ("Ok", [(base, 12.0, 2)], [(3.0,)] * 3))


def plan(spark, **kw):
    return routes.select_plans(spark.createDataFrame([answer(**kw)], ANSWER)).first()


def test_plans(spark):
    r = plan(spark)
    assert (r["order"], r["saved_seconds"], r["error"]) == ([0, 2, 1], 100.0, None)
    for base in (100.0, 99.0):
        r = plan(spark, base=base)
        assert (r["order"], r["saved_seconds"]) == ([0, 1, 2], 0.0)


@pytest.mark.parametrize("kw, error", [
    ({"code": "NoTrips"}, "no_common_route"), ({"ranks": (0, 1)}, "incomplete_order"), ({"ranks": (0, 1, 1)}, "incomplete_order"), ({"ranks": (1, 0, 2)}, "incomplete_order"),
    ({"index": 1}, "incomplete_order"), ({"snap": 2000.0}, "too_far_from_road"), ({"trip": None}, "incomplete_route"), ({"trip": float("nan")}, "incomplete_route"), ({"legs": 1}, "incomplete_route"), ({"trip": -1.0}, "incomplete_route"),
])
def test_bad_answers(spark, kw, error):
    r = plan(spark, **kw)
    assert r["error"] == error and r["order"] is None


def test_visit_numbers(spark):
    shots = spark.createDataFrame([(1, [0, 2, 1], ["a", "b", "c"]), (2, [0, 2, 1], [None, "b", "c"])], "snapshot_id long, order array<int>, ids array<string>")
    for mode, expected in (("after", {1: "132", 2: "S21"}), ("before", {1: "123", 2: "S12"})):
        rows = routes.visits(shots, mode).collect()
        for shot, labels in expected.items():
            got = {r["point"]: r["label"] for r in rows if r["snapshot_id"] == shot}
            assert "".join(got[i] for i in range(3)) == labels


def test_geometry_is_never_made_up(spark):
    from tourweave.functions.geo import line_or_null

    cases = [([(15.0, 48.0), (15.1, 48.1)], True), ([(15.0, 48.0)], False), ([(15.0, 95.0), (15.1, 48.1)], False), ([(None, 48.0), (15.1, 48.1)], False), (None, False), ([(float("nan"), 48.0), (15.1, 48.1)], False)]
    df = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(cases)], "i int, g array<struct<lon:double,lat:double>>")
    assert [r[0] is not None for r in df.orderBy("i").select(line_or_null(F.col("g"))).collect()] == [ok for _, ok in cases]


CAND = "request_id long, cand_pos int, lat double, lon double, street string, house string, postal string, country string, kind string, name string, label string"


def found(spark, address, candidates, postal="1220 Wien", country="AT"):
    rows = [(1, i, *(c | {}).values()) for i, c in enumerate(candidates)]
    got = match.automatic_matches(spark.createDataFrame([(1, address, postal, country)], "request_id long, address string, postal string, country string"), spark.createDataFrame(rows, CAND)).collect()
    return got[0]["cand_pos"] if got else None


def c(street="Rennbahnweg", house="25", postal="1220", country="AT", lat=48.2, lon=16.4, kind="house", name=""):
    return {"lat": lat, "lon": lon, "street": street, "house": house, "postal": postal, "country": country, "kind": kind, "name": name, "label": "x"}


def test_matches(spark):
    assert found(spark, "Rennbahnweg 25", [c()]) == 0
    for bad in ({"house": "27"}, {"street": "Anderer Weg"}, {"postal": "1210"}, {"country": "DE"}, {"house": ""}):
        assert found(spark, "Rennbahnweg 25", [c(**bad)]) is None
    assert found(spark, "Rennbahnweg 25", [c(), c(lat=48.21)]) is None  # far apart
    near = [c("Lindenweg", "4c", kind="shop", name="Laden"), c("Lindenweg", "4c", lat=48.2005), c("Lindenweg", "4c", kind="entrance")]
    assert found(spark, "Lindenweg 4c", near) == 1
    assert found(spark, "Lindenweg 4c", [near[0], c("Lindenweg", "4c", kind="shop", name="B")]) == 0
    assert found(spark, "Paui Meyer Strasse 7", [c("Paul-Meyer-Straße", "7")]) == 0
    assert found(spark, "Paul Meyer Strasse 7", [c("Paui-Meyer-Straße", "7"), c("Paul-Meyer-Straße", "7", lat=48.3)]) == 1
    assert found(spark, "Muehlstr. 7", [c("Mühlstraße", "7")]) == 0
    assert found(spark, "Neuenweg 7", [c("Neunweg", "7")]) is None
    assert found(spark, "Rennbahnweg 1/2", [c(house="12")]) is None and found(spark, "Rennbahnweg 1/2", [c(house="1/2")]) == 0
    assert found(spark, "Birkenweg 7a", [c("Birkenweg", "7a/2/6"), c("Birkenweg", "7a"), c("Birkenweg", "7b")]) == 1


def test_first_of_equal_points(spark):
    rows = [(1, 1, *c().values()), (1, 0, *c().values()), (1, 2, *c(lat=95.0).values())]
    assert [r["cand_pos"] for r in match.distinct_candidates(spark.createDataFrame(rows, CAND)).collect()] == [0]


def test_unresolved_requests_are_reported(spark):
    requests = spark.createDataFrame([(1, "Weg 1", "1000", "AT"), (2, "Weg 2", "1000", "AT"), (3, "Weg 3", "1000", "AT")], "request_id long, address string, postal string, country string")
    cache = spark.createDataFrame([('["AT","weg 1","1000"]', 48.0, 15.0)], "address_key string, lat double, lon double")
    overrides = spark.createDataFrame([(2, 48.1, 15.1)], "request_id long, lat double, lon double")
    located, fresh, unresolved = match.locate(requests, cache, spark.createDataFrame([], CAND), overrides)
    assert sorted((r["request_id"], r["origin"]) for r in located.collect()) == [(1, "cache"), (2, "manual")]
    assert [r["request_id"] for r in fresh.collect()] == [2] and [r["request_id"] for r in unresolved.collect()] == [3]


def test_statistics_count_unknown_status_as_open(spark):
    r = stats.tour_stats(stops(spark, "a:done", "b:odd", "c:not_delivered", "d:later")).first()
    assert (r["total"], r["open"], r["selectable"], r["completed"], r["percent"]) == (4, 2, 1, False, 50.0)


def test_defaults_on_read(spark):
    df = spark.createDataFrame([(1, 0, None, None, "junk")], "tour_id long, pos long, stop_id string, status string, internal string")
    r = records.normalize_stops(df).first()
    assert r["status"] == "pending" and r["name"] == "" and len(r["stop_id"]) == 36 and "internal" not in r
    t = records.normalize_tours(spark.createDataFrame([(None, "")], "tour_id string, name string")).first()
    assert (t["name"], t["source"], t["current_index"]) == ("Unbenannte Tour", "manual", 0)


def test_neighbours_change_places(spark):
    s = stops(spark, "a:pending", "b:pending", "c:pending")
    assert ids(records.move(s, ["b"], 1)) == ["a", "c", "b"]
    assert ids(records.move(s, ["b"], -1)) == ["b", "a", "c"]
    assert ids(records.move(s, ["a"], -1)) == ids(records.move(s, ["c"], 1)) == ["a", "b", "c"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["pending", "later", "done", "not_delivered"]), max_size=8), st.lists(st.sampled_from(["done", "not_delivered", "later", "reset", "click"]), max_size=12))
def test_the_fold_keeps_all_stops(statuses, actions):
    tour = Tour(list(range(len(statuses))), statuses)
    for a in actions:
        tour.apply(a)
        assert sorted(tour.ids) == list(range(len(statuses))) and len(tour.statuses) == len(statuses)
        assert not statuses or 0 <= tour.index < len(statuses)


def test_apply_and_undo(spark):
    s = stops(spark, "a:done", "b:pending", "c:pending")
    tours = spark.createDataFrame([(1, 1, None)], "tour_id long, current_index int, undo struct<before:array<string>,after:array<string>,current:string>")
    orders = spark.createDataFrame([(1, ["c", "b"])], "tour_id long, ids array<string>")
    t, moved, _ = routes.apply_plans(tours, s, orders)
    r = t.first()
    assert (ids(moved), r["current_index"], list(r["undo"])) == (["a", "c", "b"], 1, [["a", "b", "c"], ["a", "c", "b"], "b"])
    same, _, _ = routes.apply_plans(tours, s, spark.createDataFrame([(1, ["b", "c"])], "tour_id long, ids array<string>"))
    assert (same.first()["current_index"], same.first()["undo"]) == (1, None)
    back_t, back = routes.undo_plans(t, moved)
    assert ids(back) == ["a", "b", "c"] and tuple(back_t.first()) == (1, 1, None)
    closed_t, _ = routes.undo_plans(t, moved.withColumn("status", F.when(F.col("stop_id") == "b", "done").otherwise(F.col("status"))))
    assert closed_t.first()["current_index"] == 2
    stale = t.withColumn("map_key", F.lit("old"))
    r = routes.saved(stale, s, "2024-01-01 00:00:00").first()
    assert r["undo"] is None and r["map_key"] is None
    assert routes.saved(stale, moved, "2024-01-01 00:00:00").first()["undo"] is not None


def test_snapshots_are_valid(spark):
    plans = routes.select_plans(spark.createDataFrame([answer()], ANSWER))
    points = spark.createDataFrame([(1, i, 48.0, 15.0 + i, x, "n", "a") for i, x in enumerate((None, "b", "c"))], "plan_id long, pos int, lat double, lon double, id string, name string, address string")
    shot = routes.snapshots(plans, points)
    assert shot.select(routes.valid_snapshot(*(F.col(c) for c in ("version", "order", "points", "before", "after")))).first()[0]


def test_a_crash_at_any_step_leaves_the_old_table(spark, tmp_path, monkeypatch):
    from tourweave.sources import store

    s = store.Store(spark, str(tmp_path / "s"))
    rows = lambda *values: spark.createDataFrame(list(values), "k long, v string")
    s.write("t", rows((1, "old"), (2, "old")))
    fs, path = s._fs()
    for step in ("create", "rename"):

        class Failing:
            def __getattr__(self, name, step=step):
                if name == step:
                    raise OSError("crash")
                return getattr(fs, name)

        monkeypatch.setattr(s, "_fs", lambda: (Failing(), path))
        with pytest.raises(OSError):
            s.put("t", rows((1, "new")), "k")
        monkeypatch.undo()
        assert sorted(map(tuple, s.read("t").collect())) == [(1, "old"), (2, "old")]
    (tmp_path / "s" / "t" / "pointer-000000000900").write_text("")  # a pointer that was never finished
    assert s.read("t").count() == 2
    s.put("t", rows((1, "new")), "k")
    assert sorted(map(tuple, s.read("t").collect())) == [(1, "new"), (2, "old")]
    s.remove("t", rows((2, "")), "k")
    assert [tuple(r) for r in s.read("t").collect()] == [(1, "new")] and s.read("nothing") is None
