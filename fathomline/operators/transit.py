"""Scheduled service around places: services as bitmaps of days, routes as sets, several days and radii in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.dates import service_seconds
from fathomline.operators.spatial import radius_join

WEEK = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def service_days(calendar: DataFrame, exceptions: DataFrame, days: dict[str, str]) -> DataFrame:
    """(service_id, days): bit i is set where the service runs on the i-th of the named dates.

    The weekly pattern inside its dates, plus exceptions of type 1, minus those of type 2; removal wins.
    """
    runs, added, removed = F.lit(0), F.lit(0), F.lit(0)
    for bit, day in enumerate(days.values()):
        date, one = F.lit(day).cast("date"), F.lit(1 << bit)
        weekly = F.get(F.array(*[F.col(c) for c in WEEK]), F.weekday(date)) == 1
        runs = runs + F.when((F.col("start_date") <= date) & (F.col("end_date") >= date) & weekly, one).otherwise(0)
        added = added + F.when((F.col("date") == date) & (F.col("exception_type") == 1), one).otherwise(0)
        removed = removed + F.when((F.col("date") == date) & (F.col("exception_type") == 2), one).otherwise(0)
    base = calendar.select("service_id", runs.alias("r"), F.lit(0).alias("a"), F.lit(0).alias("d"))
    changed = exceptions.select("service_id", F.lit(0).alias("r"), added.alias("a"), removed.alias("d"))
    masks = base.unionByName(changed).groupBy("service_id").agg(*[F.bit_or(c).alias(c) for c in ("r", "a", "d")])
    return masks.select("service_id", F.col("r").bitwiseOR(F.col("a")).bitwiseAND(F.bitwise_not("d")).alias("days"))


def trip_weights(frequencies: DataFrame) -> DataFrame:
    """(trip_id, weight): departures by headway, at least one for each row; rows without a headway or times are none."""
    span = service_seconds(F.col("end_time")) - service_seconds(F.col("start_time"))
    runs = F.greatest(F.try_divide(span.cast("double"), F.col("headway_secs").cast("double")), F.lit(1.0))
    known = frequencies.where(F.try_divide(span.cast("double"), F.col("headway_secs").cast("double")).isNotNull())
    return known.groupBy("trip_id").agg(F.sum(runs).alias("weight"))


def stop_service(trips: DataFrame, stop_times: DataFrame, frequencies: DataFrame, services: DataFrame, days: dict[str, str]) -> DataFrame:
    """(stop_id, route_id, days, w0, w1, ...): on which days a route serves a stop, and its departures on each."""
    active = trips.join(services.where("days <> 0"), "service_id").join(trip_weights(frequencies), "trip_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    events = stop_times.select("trip_id", "stop_id").join(active.select("trip_id", "route_id", "days", "weight"), "trip_id")
    on = lambda bit: F.sum(F.when(F.col("days").bitwiseAND(F.lit(1 << bit)) != 0, F.col("weight")).otherwise(0.0)).alias(f"w{bit}")
    return events.groupBy("stop_id", "route_id").agg(F.bit_or("days").alias("days"), *[on(bit) for bit in range(len(days))])


def service_context(targets: DataFrame, stops: DataFrame, served: DataFrame, key: str, days: dict[str, str], radii: tuple[float, ...] = (250.0, 500.0), x: str = "x", y: str = "y", sx: str = "sx", sy: str = "sy") -> DataFrame:
    """Per target, day and radius: stops, departures weighted by headway, and distinct routes.

    ``served`` comes from ``stop_service``. Targets meet stops once, within the largest radius; routes are reduced per
    (target, route) to the days and radii they are there, and counted from that, so no set of routes is held.
    """
    near = radius_join(targets.select(key, x, y), stops.select("stop_id", sx, sy), max(radii), x, y, sx, sy).select(key, "stop_id", "distance")
    cases = [(label, bit, r) for bit, label in enumerate(days) for r in radii]
    counted = near.groupBy(key).agg(*[F.count_if(F.col("distance") <= r).alias(f"_stops_{i}") for i, r in enumerate(radii)])
    met = near.join(served, "stop_id")
    within = lambda r: F.col("distance") <= r
    per_route = met.groupBy(key, "route_id").agg(
        *[F.sum(F.when(within(r), F.col(f"w{bit}")).otherwise(0.0)).alias(f"_w_{i}") for i, (_, bit, r) in enumerate(cases)],
        *[F.max((within(r) & (F.col("days").bitwiseAND(F.lit(1 << bit)) != 0)).cast("int")).alias(f"_r_{i}") for i, (_, bit, r) in enumerate(cases)],
    )
    summed = per_route.groupBy(key).agg(*[F.sum(f"_w_{i}").alias(f"_w_{i}") for i in range(len(cases))], *[F.sum(f"_r_{i}").alias(f"_r_{i}") for i in range(len(cases))])
    out = targets.select(key).join(counted, key, "left").join(summed, key, "left")
    name = lambda label, what, r: f"{label}_{what}_{r:g}m"
    columns = []
    for i, (label, _, r) in enumerate(cases):
        columns += [
            F.coalesce(F.col(f"_stops_{radii.index(r)}"), F.lit(0)).alias(name(label, "stop_count", r)),
            F.coalesce(F.col(f"_w_{i}"), F.lit(0.0)).alias(name(label, "weighted_service", r)),
            F.coalesce(F.col(f"_r_{i}"), F.lit(0)).alias(name(label, "route_count", r)),
        ]
    return out.select(key, *columns)


def context_audit(context: DataFrame, services: DataFrame, trips: DataFrame, stop_times: DataFrame, days: dict[str, str], radius: float = 500.0) -> DataFrame:
    """(day_type, service_date, active_services, active_trips, active_stop_events, median_stops, share_with_service) of each day."""
    rows = None
    for bit, (label, day) in enumerate(days.items()):
        runs = services.where(F.col("days").bitwiseAND(F.lit(1 << bit)) != 0).select("service_id")
        active = trips.join(runs, "service_id", "left_semi")
        one = (
            runs.agg(F.count(F.lit(1)).alias("active_services"))
            .join(active.agg(F.count(F.lit(1)).alias("active_trips")))
            .join(stop_times.join(active.select("trip_id"), "trip_id").agg(F.count(F.lit(1)).alias("active_stop_events")))
            .join(context.agg(F.median(f"{label}_stop_count_{radius:g}m").alias("median_stops"), F.avg((F.col(f"{label}_weighted_service_{radius:g}m") > 0).cast("double")).alias("share_with_service")))
            .select(F.lit(label).alias("day_type"), F.lit(day).alias("service_date"), "*")
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows
