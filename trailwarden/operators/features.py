"""Event features: calendar, keys, flags, ranks, deltas and prior-activity counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..rules import FLAG_RULES
from . import ordering as o

CANONICAL_ORDER = ["event_time", "source_file_name", "record_index_in_file", "event_id"]
INDEX = "raw_event_row_index"

PRIOR_KEYS: dict[str, tuple[str, str]] = {
    "actor_events": ("actor_key", "UNKNOWN_ACTOR"),
    "ip_events": ("source_ip_address", "UNKNOWN_IP"),
    "same_event_name": ("event_name", "UNKNOWN_EVENT"),
    "same_event_source": ("event_source", "UNKNOWN_SOURCE"),
}
PRIOR_WINDOWS: dict[str, int] = {"5m": 300, "1h": 3600}

NAME_FLAGS = {
    "is_console_login": "console_login_event_names",
    "is_auth_related": "auth_related_event_names",
    "is_recon_like_api": "recon_event_names",
    "is_privilege_change_api": "privilege_change_event_names",
    "is_resource_creation_api": "resource_creation_event_names",
}
SOURCE_FLAGS = {
    "is_s3_related": "s3_event_sources",
    "is_iam_related": "iam_event_sources",
    "is_ec2_related": "ec2_event_sources",
}


def canonical_order() -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in CANONICAL_ORDER]


def with_calendar_parts(events: DataFrame) -> DataFrame:
    time = F.col("event_time")
    return events.withColumns({
        "event_date": F.date_format(time, "yyyy-MM-dd"),
        "event_hour_utc": F.hour(time).cast("long"),
        "event_day_of_week_utc": F.date_format(time, "EEEE"),
        "event_month_utc": F.month(time).cast("long"),
        "is_weekend_utc": F.coalesce(F.weekday(time).isin(5, 6), F.lit(False)),
    })


def with_event_keys(events: DataFrame) -> DataFrame:
    return events.withColumns({
        "actor_key": keys.actor_key(),
        "session_key": keys.session_key(F.date_format("event_time", "yyyy-MM-dd")),
        "global_sort_key": keys.global_sort_key(),
    })


def with_identity_flags(events: DataFrame) -> DataFrame:
    kind = F.lower(F.coalesce(F.col("user_type"), F.lit("")))
    arn = F.lower(F.coalesce(F.col("user_arn"), F.lit("")))
    return events.withColumns({
        "is_root_user": (kind == "root") | arn.endswith(":root"),
        "is_assumed_role": (kind == "assumedrole") | arn.contains(":assumed-role/"),
        "is_iam_user": (kind == "iamuser") | arn.contains(":user/"),
        "is_aws_service_call": F.col("invoked_by").isNotNull()
        | kind.isin("awsservice", "assumedrolebyservice", "service"),
    })


def with_behaviour_flags(events: DataFrame, rules: Mapping[str, Sequence[str]] = FLAG_RULES) -> DataFrame:
    flags = {flag: keys.one_of(F.col("event_name"), rules.get(rule, [])) for flag, rule in NAME_FLAGS.items()}
    flags |= {flag: keys.one_of(F.col("event_source"), rules.get(rule, [])) for flag, rule in SOURCE_FLAGS.items()}
    flags |= {"is_failed_api_call": F.col("is_error"), "is_successful_api_call": F.col("success")}
    return events.withColumns(flags)


def with_row_features(events: DataFrame, rules: Mapping[str, Sequence[str]] = FLAG_RULES) -> DataFrame:
    """Everything that needs one row only: no shuffle, one code-generated stage."""
    events = with_event_keys(with_calendar_parts(events))
    return with_behaviour_flags(with_identity_flags(events), rules)


def with_row_index(events: DataFrame) -> DataFrame:
    """Canonical order as a dense zero-based index."""
    return o.global_index(events, canonical_order(), INDEX, "events-indexed")


def sequence_features(indexed: DataFrame) -> DataFrame:
    """Ranks per actor, session and IP, and the step from the previous session event.

    One sort over (grouping, key, index): a busy key spans as many parts as its
    share of the rows needs, and only its start position is carried over.
    """
    step = F.struct(F.unix_micros("event_time").alias("t"), "event_source", "event_name")
    no_step = F.lit(None).cast("struct<t:bigint,event_source:string,event_name:string>")
    long = indexed.select(INDEX, F.inline(F.array(
        _keyed("actor", F.col("actor_key"), no_step),
        _keyed("ip", F.coalesce(F.col("source_ip_address"), F.lit("UNKNOWN_IP")), no_step),
        _keyed("session", F.col("session_key"), step),
    )))
    placed = o.positions(long, [F.col("grouping"), F.col("key"), F.col(INDEX)], "key-ranks", small=True)
    ends = placed.groupBy(o.PART).agg(
        F.count("*").alias("_n"), F.max_by(F.struct("grouping", "key", "step"), o.ROW).alias("_last"))
    # where each part's last key begins in that part
    last_keys = ends.select(o.PART, F.col("_last.grouping").alias("grouping"), F.col("_last.key").alias("key"))
    begins = placed.join(F.broadcast(last_keys), [o.PART, "grouping", "key"]).groupBy(o.PART).agg(
        F.min(o.ROW).alias("_first"))
    parts = ends.join(begins, o.PART).select(
        o.PART, "_last", "_first", o.earlier_sum("_n").alias("_before"), o.from_previous_part("_last").alias("_carried"))
    continues = (F.col("_first") == 0) & _same_key("_last", "_carried")
    parts = parts.withColumn("_start", F.when(~continues, F.col("_before") + F.col("_first")))
    parts = parts.select(o.PART, "_before", "_carried", o.earlier_max("_start").alias("_open_start"))

    scan = o.with_part_state(placed, parts).withColumn("_here", F.struct("grouping", "key", "step"))
    scan = scan.withColumn("_prev", F.coalesce(F.lag("_here").over(o.in_part()), F.col("_carried")))
    scan = scan.withColumns({"_same": _same_key("_here", "_prev"), "_at": F.col("_before") + F.col(o.ROW)})
    started = F.max(F.when(~F.col("_same"), F.col("_at"))).over(o.running())
    ranked = scan.select(
        INDEX, "grouping", "step", F.when(F.col("_same"), F.col("_prev.step")).alias("prev"),
        (F.col("_at") - F.coalesce(started, F.col("_open_start")) + 1).alias("rank"),
    )
    session = F.col("grouping") == "session"
    seconds = F.bround((F.col("step.t") - F.col("prev.t")) / 1000.0, 0) / 1000.0
    per_event = {f"{g}_event_rank": F.max(F.when(F.col("grouping") == g, F.col("rank")))
                 for g in ("actor", "session", "ip")}
    per_event["seconds_since_prev_session_event"] = F.max(F.when(session, seconds))
    for field in ("event_source", "event_name"):
        same = F.coalesce(F.col(f"step.{field}") == F.col(f"prev.{field}"), F.lit(False))
        per_event[f"same_{field}_as_prev_session_event"] = F.coalesce(F.bool_or(F.when(session, same)), F.lit(False))
    return ranked.groupBy(INDEX).agg(*[c.alias(n) for n, c in per_event.items()])


def _same_key(left: str, right: str) -> Column:
    same = (F.col(f"{left}.grouping") == F.col(f"{right}.grouping")) & (F.col(f"{left}.key") == F.col(f"{right}.key"))
    return F.coalesce(same, F.lit(False))


def _keyed(grouping: str, key: Column, step: Column) -> Column:
    return F.struct(F.lit(grouping).alias("grouping"), key.alias("key"), step.alias("step"))


def prior_activity(
    indexed: DataFrame,
    prior_keys: Mapping[str, tuple[str, str]] = PRIOR_KEYS,
    windows: Mapping[str, int] = PRIOR_WINDOWS,
) -> DataFrame:
    """Events of the same key before this one, not older than each window.

    Every event is placed once per key in the (key, time) order and counts its
    predecessors within its sort part by range frames.  Only events of a key that goes
    on from an earlier part and that lie nearer than a window to the start of their
    part look further back: their left edges find the part they fall into and are
    ranked there, so the difference of two ranks is their count.  No key, hour or
    timestamp has to fit into one task; if all times are equal, all events take the
    second way, which is linear, too.
    """
    micros = F.unix_micros("event_time")
    spans = [seconds * 1_000_000 for seconds in windows.values()]
    keys = [F.struct(F.lit(name).alias("grouping"), F.coalesce(F.col(column), F.lit(missing)).alias("key"))
            for name, (column, missing) in prior_keys.items()]
    long = indexed.where(F.col("event_time").isNotNull()).select(INDEX, micros.alias("at"), F.inline(F.array(*keys)))
    placed = o.positions(long, [F.col("grouping"), F.col("key"), F.col("at"), F.col(INDEX)], "prior-events", small=True)
    ends = placed.groupBy(o.PART).agg(
        F.count("*").alias("_n"), F.min_by(F.struct("grouping", "key", "at"), o.ROW).alias("_first"),
        F.max_by(F.struct("grouping", "key"), o.ROW).alias("_last"))
    goes_on = F.coalesce(o.from_previous_part("_last") == F.struct("_first.grouping", "_first.key"), F.lit(False))
    parts = ends.select(o.PART, "_first", o.earlier_sum("_n").alias("_before"), goes_on.alias("_goes_on"))

    def reaches_back(span: int) -> Column:
        same = (F.col("grouping") == F.col("_first.grouping")) & (F.col("key") == F.col("_first.key"))
        return F.col("_goes_on") & same & (F.col("at") - span <= F.col("_first.at"))

    state = o.with_part_state(placed, parts)
    by_time = Window.partitionBy(o.PART, "grouping", "key").orderBy("at")
    first = F.min(o.ROW).over(by_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inside = state.select(INDEX, "grouping", *[
        F.when(~reaches_back(span), F.col(o.ROW) - first - F.count("*").over(
            by_time.rangeBetween(Window.unboundedPreceding, -span - 1))).alias(f"c{i}")
        for i, span in enumerate(spans)])
    edges = _edge_counts(placed, parts, state, [(reaches_back(span), span) for span in spans])
    both = inside.unionByName(edges.select(INDEX, "grouping", *[
        F.when(F.col("mark") == i, F.col("n")).alias(f"c{i}") for i in range(len(spans))]))
    return both.groupBy(INDEX).agg(*[
        F.max(F.when(F.col("grouping") == name, F.col(f"c{i}"))).alias(f"{name}_prev_{suffix}")
        for name in prior_keys for i, suffix in enumerate(windows)])


def _edge_counts(placed: DataFrame, parts: DataFrame, state: DataFrame, windows: list[tuple[Column, int]]) -> DataFrame:
    """``index, grouping, mark, n`` for the events whose windows begin in an earlier part."""
    marks = F.filter(F.array(*[F.struct(
        back.alias("back"), F.lit(i).alias("mark"), (F.col("at") - span).alias("edge")) for i, (back, span) in enumerate(windows)]),
        lambda m: m["back"])
    edges = state.select(INDEX, "grouping", "key", (F.col("_before") + F.col(o.ROW)).alias("rank"), F.inline(marks))
    edges = edges.select(INDEX, "grouping", "key", F.col("edge").alias("at"), F.lit(0).alias("kind"), "mark", "rank",
                         F.lit(None).cast("long").alias("target"))
    # the part an edge falls into is the last one whose first event lies before it
    bounds = parts.select(F.lit(None).cast("long").alias(INDEX), "_first.grouping", "_first.key", "_first.at", F.lit(1).alias("kind"),
                          F.lit(None).cast("int").alias("mark"), F.lit(None).cast("long").alias("rank"), F.col(o.PART).alias("target"))
    located = o.positions(edges.unionByName(bounds), [F.col(c) for c in ("grouping", "key", "at", "kind", INDEX, "mark")], "prior-edges", small=True)
    carried = located.groupBy(o.PART).agg(F.max("target").alias("_t")).select(o.PART, o.earlier_max("_t").alias("_carried"))
    target = F.greatest(F.max("target").over(o.running()), F.col("_carried"))
    found = o.with_part_state(located, carried).withColumn("target", target).where(F.col("kind") == 0)
    found = found.select(INDEX, "grouping", "key", "at", "kind", "mark", "rank", "target")
    met = placed.join(found.select(F.col("target").alias(o.PART)).distinct(), o.PART, "left_semi").select(
        INDEX, "grouping", "key", "at", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("mark"),
        F.lit(None).cast("long").alias("rank"), F.col(o.PART).alias("target"))
    in_target = Window.partitionBy("target").orderBy("grouping", "key", "at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    ranked = found.unionByName(met).withColumn("seen", F.coalesce(F.sum("kind").over(in_target), F.lit(0))).where(F.col("kind") == 0)
    earlier = parts.select(F.col(o.PART).alias("target"), "_before")
    return ranked.join(F.broadcast(earlier), "target", "left").select(
        INDEX, "grouping", "mark", (F.col("rank") - F.coalesce("_before", F.lit(0)) - F.col("seen")).alias("n"))


def derive_event_features(events: DataFrame, rules: Mapping[str, Sequence[str]] = FLAG_RULES) -> DataFrame:
    """The full event table: every input column plus all derived features.

    The global sort and the joins run on the input columns; row features are cheap
    enough to be computed where they are read instead of travelling through either.
    """
    placed = with_row_index(events)
    indexed = with_row_features(placed, rules)
    counts = [f"{name}_prev_{suffix}" for name in PRIOR_KEYS for suffix in PRIOR_WINDOWS]
    sequences, prior = sequence_features(indexed), prior_activity(indexed)
    joined = placed.join(sequences, INDEX, "left").join(prior, INDEX, "left")
    added = [c for c in [*sequences.columns, *prior.columns] if c != INDEX]
    own = [c for c in indexed.columns if c != INDEX]
    return with_row_features(joined, rules).select(INDEX, *own, *added).fillna(0, subset=counts)
