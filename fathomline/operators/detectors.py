"""Sparse sensor snapshots to balanced yearly summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import class_slug
from fathomline.params import DetectorParams


def lane_snapshot(nested: DataFrame) -> DataFrame:
    """period > detectors > lanes to one row per detector: valid lanes' volume sum, speed weighted by max(volume, 1), mean occupancy, averaged over periods."""
    lanes = (
        nested.withColumn("p", F.explode("period"))
        .withColumn("d", F.explode("p.detectors"))
        .withColumn("l", F.explode("d.lanes"))
        .where(F.upper("l.valid") == "Y")
    )
    weight = F.greatest(F.col("l.volume"), F.lit(1.0))
    keys = [c for c in nested.columns if c != "period"]
    per = lanes.groupBy(*keys, F.col("p.period_from").alias("period_from"), F.col("d.detector_id").alias("detector_id")).agg(
        F.sum("l.volume").alias("volume"), (F.sum(F.col("l.speed") * weight) / F.sum(weight)).alias("speed"), F.avg("l.occupancy").alias("occupancy"), F.count(F.lit(1)).alias("lanes")
    )
    return per.groupBy(*keys, "detector_id").agg(F.avg("volume").alias("sampled_minute_volume"), F.avg("speed").alias("sampled_speed"), F.avg("occupancy").alias("sampled_occupancy"), F.avg("lanes").alias("valid_lane_count"))


def vehicle_classes(samples: DataFrame, sample: str, classes: list[str]) -> DataFrame:
    """Per detector: the mean share of each class over full days, the number of its rows and their share of all samples.

    samples has one row per sample: its name, and period as array<struct<period_from, period_to, detectors:
    array<struct<detector_id, valid, vehicle_class: array<struct<class_name, proportion>>>>>>. Of a sample the first period
    from 00:00:00 to 24:00:00 counts; one without it is an error. Detectors count where valid is Y, and shares that
    are no numbers are left out of means. ``classes`` are slugs; the last of equal class names counts.
    """
    full = F.get(F.filter("period", lambda p: (p["period_from"] == "00:00:00") & (p["period_to"] == "24:00:00")), 0)
    lacking = F.raise_error(F.concat(F.lit("no full-day period: "), F.coalesce(F.col(sample).cast("string"), F.lit("null"))))
    days = samples.select(F.when(full.isNull(), lacking.cast("string")).alias("_lacking"), full.alias("_day"))
    detectors = days.where("_lacking IS NULL").select(F.explode("_day.detectors").alias("d")).where("d.valid = 'Y'")

    def share(name: str) -> Column:
        own = F.filter("d.vehicle_class", lambda c: class_slug(F.trim(c["class_name"])) == name)
        return F.avg(F.get(own, F.size(own) - 1)["proportion"].try_cast("double")).alias(f"class_{name}_pct")

    found = detectors.groupBy(F.trim(F.coalesce("d.detector_id", F.lit(""))).alias("sensor_id")).agg(*[share(c) for c in classes], F.count(F.lit(1)).alias("class_sample_count"))
    total = samples.agg(F.count(F.lit(1)).alias("_total"))  # one row
    return found.crossJoin(F.broadcast(total)).withColumn("class_sample_coverage", F.col("class_sample_count") / F.col("_total")).drop("_total")


def annualise(snapshots: DataFrame, params: DetectorParams = DetectorParams()) -> DataFrame:
    """Per detector and year: mean of stratum means (day_type x time_block), coverage, modal lanes, qualification."""
    keys = ["detector_id", "year"]
    strata = snapshots.groupBy(*keys, "day_type", "time_block").agg(F.avg("volume").alias("stratum_mean"))
    balanced = strata.groupBy(*keys).agg(F.avg("stratum_mean").alias("balanced_proxy"), F.count(F.lit(1)).alias("stratum_count"))
    whole = snapshots.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("snapshot_count"), F.count_distinct("month").alias("distinct_months"), F.expr("mode() WITHIN GROUP (ORDER BY lanes)").alias("modal_lanes")
    )
    share = F.col("snapshot_count") / params.expected_snapshots
    qualified = (share >= params.detector_share) & (F.col("distinct_months") >= params.min_months) & (F.col("stratum_count") == params.strata)
    return whole.join(balanced, keys).withColumn("sample_share", share).withColumn("qualified", qualified)


def day_time_breakdown(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    mean = lambda condition: F.avg(F.when(condition, F.col("volume")))
    return snapshots.groupBy(*keys).agg(
        *[mean(F.col("day_type") == d).alias(f"mean_{d}") for d in ("weekday", "weekend")], *[mean(F.col("time_block") == b).alias(f"mean_{b}") for b in ("am", "midday", "pm")]
    )


def archive_gate(samples: DataFrame, params: DetectorParams = DetectorParams()) -> DataFrame:
    """Per year: share of expected snapshots found, and whether all months, day types and blocks are there."""
    found = F.col("status") == "ok"
    return samples.groupBy("year").agg(
        F.count_if(found).alias("n_found"),
        F.count_distinct(F.when(found, F.col("month"))).alias("months"),
        F.count_distinct(F.when(found, F.struct("day_type", "time_block"))).alias("strata"),
        ((F.count_if(found) >= params.year_share * params.expected_snapshots) & (F.count_distinct(F.when(found, F.struct("day_type", "time_block"))) == params.strata)).alias("pass"),
    )


def service_context(stops_near: DataFrame, stop_times: DataFrame, trips: DataFrame, frequencies: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Per place: stops, service weighted by frequency runs (at least 1 a trip), distinct routes."""
    from fathomline.functions.dates import service_seconds

    runs = frequencies.withColumn("runs", F.greatest(F.floor((service_seconds(F.col("end_time")) - service_seconds(F.col("start_time"))) / F.col("headway_secs")), F.lit(1))).groupBy("trip_id").agg(F.sum("runs").alias("runs"))
    weighted = trips.join(active, "service_id", "left_semi").join(runs, "trip_id", "left").withColumn("runs", F.coalesce("runs", F.lit(1)))
    per_stop = stop_times.join(weighted, "trip_id").select("stop_id", "route_id", "runs")
    met = stops_near.join(per_stop, "stop_id", "left")
    return met.groupBy(key).agg(F.count_distinct("stop_id").alias("stops"), F.coalesce(F.sum("runs"), F.lit(0)).alias("weighted_service"), F.count_distinct("route_id").alias("routes"))
