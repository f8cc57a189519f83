"""External transfer requests and the admissions they led to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardcast.config import ForecastConfig, SiteCodes
from wardcast.functions.dates import utc_to_local
from wardcast.functions.keys import KeySet, Split
from wardcast.plans.staging import Lazy
from wardcast.sources.tables import SourceTables


def transfer_requests(tables: SourceTables, cfg: ForecastConfig, stage=Lazy()) -> DataFrame:
    """Completed requests with type labels and the direct-admission flag.

    One row per request and intake encounter; equal intake rows are counted in
    ``copies`` before they meet the request. If ``stage`` stores results, the requests reduce the intake
    rows before these are shuffled, and a request with very many intake encounters is split.
    """
    codes = cfg.codes
    completed = (
        tables["request_detail"]
        .where(F.col("status_c") == codes.request_completed)
        .where(F.col("region_id") == codes.transfer_region)
    )
    taken_in = tables["attachment"].where(F.col("attachment_c") == codes.intake_attachment).select("comm_id", "csn")
    direct = F.when(F.col("topic_c") == codes.direct_admit_topic, 1).otherwise(0)
    requests = tables["request"].where(F.col("origin_c") == codes.transfer_origin).join(completed, "comm_id")
    if stage.stores:
        requests = stage("completed_requests", requests.select("comm_id", "entry_ts", "topic_c", "status_c", "transfer_type_c"))
        taken_in = KeySet.of(requests, "comm_id", stored=True).reduce(taken_in, "comm_id")
    intake = taken_in.groupBy("comm_id", F.col("csn").alias("intake_csn")).agg(F.count("*").alias("copies"))
    intake = stage("intake", intake)
    return (
        Split.of(intake, "comm_id", stage, "heavy_requests")
        .left_join_many(requests, intake)
        .join(tables["request_status"], "status_c", "left")
        .join(tables["topic"], "topic_c", "left")
        .join(tables["transfer_type"], "transfer_type_c", "left")
        .select(
            F.col("comm_id").alias("request_id"),
            F.col("entry_ts").alias("request_ts"),
            "request_type",
            "transfer_type",
            F.col("status_name").alias("request_status"),
            "intake_csn",
            direct.alias("direct_admit"),
            F.coalesce("copies", F.lit(1)).alias("copies"),
        )
    )


def latest_status(history: DataFrame) -> DataFrame:
    """Last line of a status history, and the status one line number before it.

    Only the two highest lines of a key take part, and Spark drops the others on
    the map side. Without a line numbered one below the last, the earlier status
    is NULL.
    """
    newest = W.partitionBy("comm_id").orderBy(F.col("line").desc_nulls_last())
    last = F.first("line").over(newest.rowsBetween(W.unboundedPreceding, W.currentRow))
    is_last = F.col("_rank") == 1
    is_previous = F.col("line") == F.col("_last") - 1
    return (
        history.withColumn("_rank", F.dense_rank().over(newest))
        .withColumn("_last", last)
        .where(F.col("_rank") <= 2)
        .groupBy("comm_id")
        .agg(
            F.max("_last").alias("line"),
            F.max(F.when(is_last, F.col("status_c"))).alias("status_c"),
            F.max(F.when(is_last, F.col("update_utc_ts"))).alias("update_utc_ts"),
            F.max(F.when(is_previous, F.col("status_c"))).alias("previous_status_c"),
        )
    )


def _progress(codes: SiteCodes) -> Column:
    """Admitted or discharged before every other patient state."""
    state = F.col("patient_stat_c")
    return F.when(state.isin(*codes.admitted_or_discharged), 0).otherwise(state)


def destination_admissions(attached: DataFrame, encounter: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Best encounter attached to each destination; equal rows are counted.

    ``attached`` has (destination_id, destination_csn, copies). Whether a destination qualifies for a
    request does not depend on the encounter, so the choice among a destination's encounters
    can be made once for all requests, before the requests are joined.
    """
    admissions = encounter.select(F.col("csn").alias("destination_csn"), "admit_conf_c", "patient_stat_c")
    best = W.partitionBy("destination_id").orderBy(
        F.col("admit_conf_c").asc_nulls_first(),
        _progress(cfg.codes).asc_nulls_first(),
        F.col("destination_csn").desc_nulls_last(),
    )
    return (
        attached.join(admissions, "destination_csn", "left")
        .withColumn("_rank", F.rank().over(best))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def transfer_destinations(tables: SourceTables, cfg: ForecastConfig, stage=Lazy()) -> DataFrame:
    """Best destination of each request among those accepted or left undecided.

    Order: admission confirmation, admitted or discharged before other states,
    newest status update, highest encounter id; missing values first when
    ascending and last when descending. Ties are all kept, equal rows counted in
    ``copies``.

    Which ids are destinations is settled first. They reduce the status histories and the
    attachments and, where results are stored, what is attached reduces the encounters, before
    any of those is ranked or shuffled. An id that very many targets share is split over the
    whole chain of joins.
    """
    codes = cfg.codes
    own = tables["request"].where(F.col("origin_c") == codes.transfer_origin).select("comm_id")
    details = tables["request_detail"].select("comm_id", F.col("status_c").alias("request_status_c"), "region_id")
    named = (
        tables["attachment"]
        .where(F.col("attachment_c") == codes.target_attachment)
        .select("comm_id", F.col("target_comm_id").alias("destination_id"), "reason_c")
    )
    if stage.stores:
        own = stage("own_requests", own)
        asked = KeySet.of(own, "comm_id", True, lambda blocks: stage("own_filter", blocks))
        details, named = asked.reduce(details, "comm_id"), asked.reduce(named, "comm_id")
    details = details.join(own, "comm_id", "left_semi")
    targets = stage("targets", named.join(details, "comm_id"))
    # In one unstored plan the ids come from the scan alone, so nothing before it runs twice.
    wanted = KeySet.of(
        targets if stage.stores else named, "destination_id", stage.stores, lambda blocks: stage("wanted_filter", blocks)
    )
    destination_details = tables["request_detail"].select(
        F.col("comm_id").alias("destination_id"), F.col("status_c").alias("destination_status_c")
    )
    history = latest_status(wanted.reduce(tables["status_history"], "comm_id")).select(
        F.col("comm_id").alias("destination_id"), "line", "update_utc_ts", "previous_status_c"
    )
    attached = stage(
        "attached",
        wanted.reduce(tables["attachment"].select(F.col("comm_id").alias("destination_id"), "csn"), "destination_id")
        .groupBy("destination_id", F.col("csn").alias("destination_csn"))
        .agg(F.count("*").alias("copies")),
    )
    encounter = tables["encounter"].select("csn", "admit_conf_c", "patient_stat_c")
    if stage.stores:
        destination_details = wanted.reduce(destination_details, "destination_id")
        encounter = KeySet.of(attached, "destination_csn", stored=True).reduce(encounter, "csn")
    split = Split.of(targets, "destination_id", stage, "heavy_destinations")
    met = split.many(targets)
    for known in (destination_details, history, destination_admissions(attached, encounter, cfg)):
        met = met.join(split.one(known), split.on, "left")

    cancelled = F.col("request_status_c") == codes.request_cancelled
    accepted = F.col("destination_status_c").isin(*codes.destination_accepted)
    was_accepted = F.col("previous_status_c").isin(*codes.destination_accepted)
    undecided = F.col("previous_status_c").isNull() & F.col("region_id").isNotNull()
    best = W.partitionBy("comm_id").orderBy(
        F.col("admit_conf_c").asc_nulls_first(),
        _progress(codes).asc_nulls_first(),
        F.col("update_utc_ts").desc_nulls_last(),
        F.col("destination_csn").desc_nulls_last(),
    )
    return (
        met.where((~cancelled & accepted) | (cancelled & was_accepted) | undecided)
        .withColumn("_rank", F.rank().over(best))
        .where(F.col("_rank") == 1)
        .join(tables["conf_status"], "admit_conf_c", "left")
        .join(tables["patient_status"], "patient_stat_c", "left")
        .select(
            F.col("comm_id").alias("request_id"),
            "destination_id",
            "line",
            utc_to_local(F.col("update_utc_ts"), cfg.time_zone).alias("status_update_ts"),
            F.coalesce("destination_csn", F.lit(-1)).alias("destination_csn"),
            "request_status_c",
            "destination_status_c",
            "previous_status_c",
            "reason_c",
            "admit_conf_c",
            "patient_stat_c",
            "admit_conf",
            "patient_stat",
            F.coalesce("copies", F.lit(1)).alias("copies"),
        )
    )


def transfer_admissions(requests: DataFrame, destinations: DataFrame) -> DataFrame:
    """Encounters reached by a request, by request type; equal rows are counted."""
    reached = destinations.groupBy("request_id", F.col("destination_csn").alias("csn")).agg(
        F.sum("copies").alias("destinations")
    )
    asked = requests.groupBy("request_id", "request_type", "transfer_type", "direct_admit").agg(
        F.sum("copies").alias("requests")
    )
    return (
        asked.join(reached, "request_id")
        .groupBy("csn", "request_type", "transfer_type", "direct_admit")
        .agg(F.sum(F.col("requests") * F.col("destinations")).alias("copies"))
    )
