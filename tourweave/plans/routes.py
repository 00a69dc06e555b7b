"""Route plans: validation of router answers, reordering, undo, snapshots and visit numbers.

A batch must not fail over one tour: validation gives an ``error`` column (null if all is
well) and leaves such tours as they are.  ``strict`` raises instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.stats import is_open

MAX_STOPS = 80
MAX_SNAP_METRES = 1500
#: What of a stop must not change between the calculation of a plan and its use.
FINGERPRINT = ("stop_id", "name", "address", "postal", "status", "note", "completed_at", "delivery_type", "delivery_review", "delivery_source")


def _finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def permutation(order: Column, n: Column) -> Column:
    """Whether an array holds each of 0 .. n-1 once."""
    return (F.size(order) == n) & (F.array_sort(order) == F.sequence(F.lit(0), n - 1).cast("array<int>"))


def route_error(route: Column, n: Column) -> Column:
    fine = _finite(route["duration"]) & (route["duration"] >= 0) & _finite(route["distance"]) & (route["distance"] >= 0) & (route["n_legs"] == n - 1)
    return F.when(~F.coalesce(fine, F.lit(False)), "incomplete_route")


def select_plans(answers: DataFrame) -> DataFrame:
    """The better of the router's proposal and the given order.

    ``answers(plan_id, n, trip, baseline)``: ``trip`` has code, trips and waypoints,
    ``baseline`` code, routes and waypoints.  Gives ``(plan_id, error, order, improved,
    saved_seconds, before, after)``; the proposal must be strictly faster.
    """
    n, trip, base = F.col("n"), F.col("trip"), F.col("baseline")
    ranks = F.transform(trip["waypoints"], lambda w: w["waypoint_index"])
    snaps = F.concat(F.transform(trip["waypoints"], lambda w: w["distance"]), F.coalesce(F.transform(base["waypoints"], lambda w: w["distance"]), F.array().cast("array<double>")))
    proposed, original = F.try_element_at(trip["trips"], F.lit(1)), F.try_element_at(base["routes"], F.lit(1))
    sure = lambda c: F.coalesce(c, F.lit(False))
    error = (
        F.when(~n.between(2, MAX_STOPS + 1), "bad_size")
        .when(~sure((trip["code"] == "Ok") & (base["code"] == "Ok") & (F.size(trip["trips"]) == 1)), "no_common_route")
        .when(~sure(permutation(ranks, n) & (ranks[0] == 0) & F.forall(trip["waypoints"], lambda w: w["trips_index"] == 0)), "incomplete_order")
        .when(~sure(F.forall(snaps, lambda d: _finite(d) & (d <= MAX_SNAP_METRES))), "too_far_from_road")
        .otherwise(F.coalesce(route_error(proposed, n), route_error(original, n)))
    )
    checked = answers.select("plan_id", n.alias("n"), error.alias("error"), ranks.alias("ranks"), proposed.alias("proposed"), original.alias("original"))
    faster = F.col("error").isNull() & (F.col("proposed.duration") < F.col("original.duration"))
    by_rank = F.transform(F.array_sort(F.transform("ranks", lambda r, i: F.struct(r.alias("rank"), i.alias("input")))), lambda x: x["input"])
    given = F.sequence(F.lit(0), F.col("n") - 1).cast("array<int>")
    fine = F.col("error").isNull()
    return checked.select(
        "plan_id", "error", F.when(faster, by_rank).when(fine, given).alias("order"), faster.alias("improved"),
        F.when(faster, F.col("original.duration") - F.col("proposed.duration")).when(fine, F.lit(0.0)).alias("saved_seconds"),
        F.when(fine, F.col("original")).alias("before"), F.when(faster, F.col("proposed")).when(fine, F.col("original")).alias("after"),
    )


def reorder(stops: DataFrame, orders: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(stops, errors)``: put ``orders(tour_id, ids)`` into the slots of the selected stops.

    All other stops keep their positions.  A tour with repeated ids, unknown ids or ids of
    stops that are no longer open stays as it is and is reported.
    """
    ranked = orders.select("tour_id", F.posexplode("ids").alias("__rank", "stop_id"))
    checks = ranked.groupBy("tour_id").agg(F.count("*").alias("asked"), F.count_distinct("stop_id").alias("distinct"))
    once = ranked.groupBy("tour_id", "stop_id").agg(F.min("__rank").alias("__rank"))
    here = stops.join(once, ["tour_id", "stop_id"], "left")
    seen = here.groupBy("tour_id").agg(F.count("*").alias("n"), F.count_distinct("stop_id").alias("n_ids"), F.count("__rank").alias("found"), F.count_if(F.col("__rank").isNotNull() & ~is_open(F.col("status"))).alias("closed"))
    state = checks.join(seen, "tour_id", "left")
    code = F.when((F.col("asked") != F.col("distinct")) | (F.col("n") != F.col("n_ids")) | (F.coalesce("found", F.lit(0)) != F.col("asked")), "tour_changed").when(F.col("closed") > 0, "status_changed")
    errors = state.select("tour_id", code.alias("error")).where("error IS NOT NULL")
    if strict:
        errors = errors.withColumn("error", F.raise_error(F.concat(F.lit("reorder: "), F.col("error"))).cast("string"))
    planned = here.join(errors.select("tour_id", F.lit(True).alias("__bad")), "tour_id", "left").withColumn("__rank", F.when(F.col("__bad").isNull(), F.col("__rank")))
    picked = planned.where("__rank IS NOT NULL")
    slots = picked.select("tour_id", F.col("pos").alias("__slot"), (F.row_number().over(Window.partitionBy("tour_id").orderBy("pos")) - 1).alias("__rank"))
    moved = picked.join(slots, ["tour_id", "__rank"]).withColumn("pos", F.col("__slot"))
    still = planned.where("__rank IS NULL")
    return still.select(*stops.columns).unionByName(moved.select(*stops.columns)), errors


def undo_available(current: Column, before: Column, after: Column) -> Column:
    """The tour is as the plan left it, and what was before is an order of the same stops."""
    same = (after == current) & (F.array_sort(before) == F.array_sort(current)) & (F.size(F.array_distinct(before)) == F.size(current))
    return F.coalesce(same, F.lit(False))


def visits(snapshots: DataFrame, mode: str = "after") -> DataFrame:
    """The number each point of a snapshot is drawn with.

    ``snapshots(snapshot_id, order, ids)``: the point without id, only ever the first, is the
    start and gets ``S``; others count from 1 in the given order (``before``) or the planned one.
    """
    n = F.size("ids")
    order = F.sequence(F.lit(0), n - 1).cast("array<int>") if mode == "before" else F.col("order")
    ranked = snapshots.select("snapshot_id", n.alias("n"), F.col("ids")[0].isNull().alias("from_start"), "ids", F.posexplode(order).alias("rank", "point"))
    number = F.when(F.col("from_start") & (F.col("rank") == 0), "S").otherwise((F.col("rank") + F.when(F.col("from_start"), 0).otherwise(1)).cast("string"))
    return ranked.select("snapshot_id", "point", F.col("ids")[F.col("point")].alias("stop_id"), number.alias("label"), (F.col("rank") == 0).alias("is_start"), (F.col("rank") == F.col("n") - 1).alias("is_end"))


def valid_snapshot(version: Column, order: Column, points: Column, before: Column, after: Column) -> Column:
    """Version 1, 2 to 81 valid points, ids unique and null for the first at most, the order a
    permutation from the first point, and metrics that are finite and not negative."""
    ids = F.transform(points, lambda p: p["id"])
    rest = F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))
    named = F.filter(ids, lambda i: i.isNotNull())
    metric = lambda r: _finite(r["duration"]) & (r["duration"] >= 0) & _finite(r["distance"]) & (r["distance"] >= 0)
    fine = (version == 1) & F.size(points).between(2, MAX_STOPS + 1) & F.forall(points, lambda p: geo.valid_point(p["lat"], p["lon"])) & F.forall(rest, lambda i: i.isNotNull())
    fine = fine & (F.size(F.array_distinct(named)) == F.size(named)) & permutation(order, F.size(points)) & (order[0] == 0) & metric(before) & metric(after)
    return F.coalesce(fine, F.lit(False))


def tour_keys(stops: DataFrame) -> DataFrame:
    """``(tour_id, tour_key, fingerprint)``: what a map belongs to, and what a plan was made from.

    The fingerprint is over the tour's id and ten fields of each stop in order; a missing column
    counts as empty texts, a missing ``completed_at`` as not completed (null).
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in stops.columns else F.lit("")
    completed = F.col("completed_at").cast("string") if "completed_at" in stops.columns else F.lit(None).cast("string")
    short = F.struct("pos", F.array(text("stop_id"), text("name"), text("address"), text("postal")).alias("k"))
    fields = [completed if c == "completed_at" else text(c) for c in FINGERPRINT]
    grouped = stops.groupBy("tour_id").agg(F.sort_array(F.collect_list(short)).alias("a"), F.sort_array(F.collect_list(F.struct("pos", F.array(*fields).alias("k")))).alias("b"))
    keys = lambda c: F.transform(c, lambda x: x["k"])
    whole = F.to_json(F.struct(F.col("tour_id").cast("string").alias("id"), keys("b").alias("stops")), {"ignoreNullFields": "false"})
    return grouped.select("tour_id", F.to_json(keys("a")).alias("tour_key"), F.sha2(whole, 256).alias("fingerprint"))


def commit_orders(stops: DataFrame, orders: DataFrame, fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply orders only to tours that are still what they were calculated from.

    ``fingerprints(tour_id, fingerprint)`` as of the calculation; the others are conflicts.
    One writer is assumed between reading and publishing the result.
    """
    now = tour_keys(stops).select("tour_id", F.col("fingerprint").alias("__now"))
    checked = fingerprints.join(now, "tour_id", "left")
    stale = checked.where(~F.col("fingerprint").eqNullSafe(F.col("__now"))).select("tour_id", F.lit("conflict").alias("error"))
    done, errors = reorder(stops, orders.join(stale, "tour_id", "left_anti"))
    return done, errors.unionByName(stale.join(orders.select("tour_id").distinct(), "tour_id", "left_semi"))


def undo(stops: DataFrame, undos: DataFrame) -> DataFrame:
    """Restore the order before the plan, where it is available: ``undos(tour_id, before, after)``."""
    current = stops.groupBy("tour_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "stop_id"))), lambda s: s["stop_id"]).alias("current"))
    able = undos.join(current, "tour_id").where(undo_available(F.col("current"), F.col("before"), F.col("after")))
    back = able.select("tour_id", F.posexplode("before").alias("__pos", "stop_id"))
    joined = stops.join(back, ["tour_id", "stop_id"], "left")
    return joined.withColumn("pos", F.coalesce(F.col("__pos").cast("long"), F.col("pos"))).select(*stops.columns)


def _order(stops: DataFrame, name: str) -> DataFrame:
    return stops.groupBy("tour_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "stop_id"))), lambda s: s["stop_id"]).alias(name))


def apply_plans(tours: DataFrame, stops: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(tours, stops, errors)`` after ``orders(tour_id, ids)``.

    ``tours(tour_id, current_index, undo)``, ``undo`` of (before, after, current).  A tour whose
    order changes starts at its first planned stop and can be undone; one whose order stays
    keeps its index and what could be undone before.
    """
    moved, errors = reorder(stops, orders)
    both = _order(stops, "__before").join(_order(moved, "__after"), "tour_id").join(orders.select("tour_id", F.col("ids")[0].alias("__first")), "tour_id", "left")
    joined = tours.join(both, "tour_id", "left")
    changed = F.coalesce(F.col("__before") != F.col("__after"), F.lit(False))
    current = F.try_element_at("__before", F.col("current_index") + 1)
    undo_ = F.struct(F.col("__before").alias("before"), F.col("__after").alias("after"), current.alias("current"))
    index = F.greatest(F.array_position("__after", F.col("__first")) - 1, F.lit(0)).cast("int")
    after = joined.select("tour_id", F.when(changed, index).otherwise(F.col("current_index")).alias("current_index"), F.when(changed, undo_).otherwise(F.col("undo")).alias("undo"))
    return after, moved, errors


def undo_plans(tours: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tours, stops)`` with the orders before the plans where they are available.

    The index goes back to the stop that was current then if it is still open, else to the
    first open one, else to 0; the record is used up.
    """
    able = tours.where("undo IS NOT NULL").join(_order(stops, "__now"), "tour_id").where(undo_available(F.col("__now"), F.col("undo.before"), F.col("undo.after")))
    back = undo(stops, able.select("tour_id", "undo.before", "undo.after"))
    open_ = back.where(is_open(F.col("status"))).groupBy("tour_id").agg(F.min("pos").alias("__first"))
    was = back.where(is_open(F.col("status"))).select("tour_id", F.col("stop_id").alias("__current"), F.col("pos").alias("__pos"))
    marked = able.select("tour_id", F.col("undo.current").alias("__current")).join(was, ["tour_id", "__current"], "left").join(open_, "tour_id", "left")
    index = F.coalesce("__pos", "__first", F.lit(0)).cast("int")
    done = tours.join(marked.select("tour_id", index.alias("__index")), "tour_id", "left")
    gone = F.when(F.col("__index").isNull(), F.col("undo"))
    return done.select("tour_id", F.coalesce("__index", "current_index").alias("current_index"), gone.alias("undo")), back


def saved(tours: DataFrame, stops: DataFrame, now) -> DataFrame:
    """Tours as they are stored: undo records and maps that no longer fit are dropped, the time is set.

    ``tours(tour_id, current_index, undo, map_key)``; ``map_key`` is the key of the stops a map was made for.
    """
    fits = tours.join(_order(stops, "__now"), "tour_id", "left").join(tour_keys(stops).select("tour_id", F.col("tour_key").alias("__key")), "tour_id", "left")
    keep = undo_available(F.col("__now"), F.col("undo.before"), F.col("undo.after"))
    return fits.select("tour_id", "current_index", F.when(keep, F.col("undo")).alias("undo"), F.when(F.col("map_key") == F.col("__key"), F.col("map_key")).alias("map_key"), F.lit(now).cast("timestamp").alias("updated_at"))


def snapshots(plans: DataFrame, points: DataFrame) -> DataFrame:
    """``(plan_id, version, order, points, before, after)``: what a map of a plan is drawn from.

    ``plans`` as from ``select_plans``; ``points(plan_id, pos, lat, lon, id, name, address)``, a
    null id for a start of its own.  Notes and legs are left out.
    """
    held = points.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lat", "lon", "id", "name", "address"))).alias("p"))
    short = lambda r: F.struct(r["duration"].alias("duration"), r["distance"].alias("distance"))
    bare = F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"), x["id"].alias("id"), x["name"].alias("name"), x["address"].alias("address")))
    return plans.where("error IS NULL").join(held, "plan_id").select("plan_id", F.lit(1).alias("version"), "order", bare.alias("points"), short(F.col("before")).alias("before"), short(F.col("after")).alias("after"))
