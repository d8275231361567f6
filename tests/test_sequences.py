"""Order-dependent operators against plain Python on adversarial small data.

The random events use few timestamps (many ties), null times, null keys and one
actor that holds most rows, and the session uses many sort parts, so state is
carried over part edges inside one key and inside one incident.
"""

import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trailwarden.operators import features, incidents, ordering

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
SCHEMA = """event_id string, event_time timestamp, event_time_epoch_ms long, user_arn string, principal_id string,
  access_key_id string, source_ip_address string, user_type string, invoked_by string, event_name string,
  event_source string, aws_region string, user_agent string, source_file_name string, record_index_in_file long,
  resource_types_concat string, success boolean, is_error boolean"""


def _events(n, seed, spread):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        time = None if rng.random() < 0.05 else T0 + dt.timedelta(seconds=rng.randrange(spread))
        bad = rng.random() < 0.3
        rows.append((
            f"e{rng.randrange(n)}" if rng.random() < 0.9 else None, time,
            None if time is None else int(time.timestamp() * 1000),
            rng.choice(["arn:hot"] * 6 + ["arn:b", "arn:root:root", None]), rng.choice(["P1", None]), rng.choice(["AK1", None, None]),
            rng.choice(["1.1.1.1"] * 5 + ["2.2.2.2", None]), None, None,
            rng.choice(["ConsoleLogin", "ListBuckets", "RunInstances", None]),
            rng.choice(["iam.amazonaws.com", "s3.amazonaws.com", None]), rng.choice(["r1", "r2", None]),
            rng.choice(["ua1", "ua2", "ua3", None]), f"f{i % 3}.json", i // 3, rng.choice(["B|A", "C", None]), not bad, bad))
    return rows


@pytest.fixture(scope="module", params=[(400, 1, 900), (300, 2, 20), (300, 3, 200_000)], ids=["dense", "ties", "sparse"])
def table(spark, request):
    n, seed, spread = request.param
    raw = spark.createDataFrame(_events(n, seed, spread), SCHEMA)
    flat = features.derive_event_features(raw).cache()
    rows = sorted((r.asDict() for r in flat.collect()), key=lambda r: r["raw_event_row_index"])
    return flat, rows


def test_parts_are_many(spark):
    df = spark.range(1000)
    parts = ordering.positions(df, [F.col("id")], "probe").select(ordering.PART).distinct().count()
    assert parts > 1


def test_canonical_order_is_dense_and_sorted(table):
    _, rows = table
    assert [r["raw_event_row_index"] for r in rows] == list(range(len(rows)))
    far = T0 + dt.timedelta(days=9999)
    keys = [((r["event_time"] or far.replace(tzinfo=None)), r["source_file_name"], r["record_index_in_file"]) for r in rows]
    assert keys == sorted(keys)


def test_ranks_and_session_steps(table):
    _, rows = table
    seen, last = Counter(), {}
    for r in rows:
        for name, key in (("actor", r["actor_key"]), ("session", r["session_key"]), ("ip", r["source_ip_address"] or "UNKNOWN_IP")):
            seen[name, key] += 1
            assert r[f"{name}_event_rank"] == seen[name, key]
        prev = last.get(r["session_key"])
        step = None
        if prev and prev["event_time"] and r["event_time"]:
            step = (r["event_time"] - prev["event_time"]).total_seconds()
        assert r["seconds_since_prev_session_event"] == step
        for field in ("event_name", "event_source"):
            same = bool(prev and r[field] is not None and prev[field] == r[field])
            assert r[f"same_{field}_as_prev_session_event"] is same
        last[r["session_key"]] = r


def test_prior_counts_match_brute_force(table):
    _, rows = table
    for i, r in enumerate(rows):
        for name, (column, missing) in features.PRIOR_KEYS.items():
            for suffix, seconds in features.PRIOR_WINDOWS.items():
                want = 0
                if r["event_time"]:
                    edge = r["event_time"] - dt.timedelta(seconds=seconds)
                    want = sum(1 for p in rows[:i] if p["event_time"] and (p[column] or missing) == (r[column] or missing)
                               and p["event_time"] >= edge)
                assert r[f"{name}_prev_{suffix}"] == want


def _reference_islands(rows, gap, mode):
    far = dt.datetime(9999, 1, 1)
    who = lambda r: (r["actor_key"], r["source_ip_address"] is None, r["source_ip_address"] or "")
    time = lambda r: (r["event_time"] or far)
    order = (lambda r: (time(r), *who(r), r["global_sort_key"])) if mode == "split" else (
        lambda r: (*who(r), time(r), r["global_sort_key"]))
    groups, prev = [], None
    for r in sorted(rows, key=order):
        key = (r["actor_key"], r["source_ip_address"])
        if not (prev and (prev["actor_key"], prev["source_ip_address"]) == key and prev["event_time"] and r["event_time"]
                and (r["event_time"] - prev["event_time"]).total_seconds() <= gap * 60):
            groups.append([])
        groups[-1].append(r)
        prev = r
    return groups


@pytest.mark.parametrize("mode", [incidents.SPLIT, incidents.INDEPENDENT])
def test_incidents_match_brute_force(table, mode):
    flat, rows = table
    limit = 7
    built = {r["incident_id"]: r.asDict() for r in incidents.build_incidents(flat, 5, limit, mode).collect()}
    groups = _reference_islands(rows, 5, mode)
    assert len(built) == len(groups)
    joined = lambda vs: "|".join(vs) or None
    for number, group in enumerate(groups, 1):
        got = built[f"incident_{number:09d}"]
        names = [r["event_name"] for r in group if r["event_name"]]
        times = [r["event_time"] for r in group if r["event_time"]]
        counts = Counter(names)
        assert got["event_count"] == len(group)
        assert got["distinct_event_names"] == len(counts)
        assert got["error_event_count"] == sum(r["is_error"] for r in group)
        assert (got["first_event_name"], got["last_event_name"]) == ((names[0], names[-1]) if names else (None, None))
        assert got["top_event_name"] == (min(counts, key=lambda k: (-counts[k], k)) if names else None)
        assert got["ordered_event_name_sequence"] == joined(names[:limit])
        assert got["ordered_event_source_sequence"] == joined([r["event_source"] for r in group if r["event_source"]][:limit])
        assert json.loads(got["event_ids_in_order"]) == [r["event_id"] for r in group if r["event_id"]][:limit]
        assert got["raw_event_row_indices"] == json.dumps([r["raw_event_row_index"] for r in group][:limit])
        assert got["user_agents_seen"] == joined(sorted({r["user_agent"] for r in group if r["user_agent"]})[:limit])
        assert got["resource_types_seen"] == joined(sorted({p for r in group for p in (r["resource_types_concat"] or "").split("|") if p}))
        assert got["incident_duration_seconds"] == ((max(times) - min(times)).total_seconds() if times else 0.0)
        assert got["contains_console_login"] is any(r["is_console_login"] for r in group)


def _three(spark, minutes, names=("ConsoleLogin", "CreateAccessKey", "ListUsers"), actors=("a", "a", "a")):
    rows = [(f"e{i}", T0 + dt.timedelta(minutes=m), int(T0.timestamp() * 1000) + m * 60_000, f"arn:{a}", None, None, "1.1.1.1",
             None, None, n, "iam.amazonaws.com", "r", "ua", "f.json", i, None, True, False)
            for i, (m, n, a) in enumerate(zip(minutes, names, actors))]
    return features.derive_event_features(spark.createDataFrame(rows, SCHEMA))


def test_gap_closes_an_incident_only_when_longer(spark):
    built = incidents.build_incidents(_three(spark, [0, 1, 30]), 15).orderBy("incident_id").collect()
    assert [(r.event_count, r.ordered_event_name_sequence, r.raw_event_row_indices, r.top_event_name) for r in built] == [
        (2, "ConsoleLogin|CreateAccessKey", "[0, 1]", "ConsoleLogin"), (1, "ListUsers", "[2]", "ListUsers")]
    assert incidents.build_incidents(_three(spark, [0, 15, 30]), 15).count() == 1


def test_interleaved_actors(spark):
    flat = _three(spark, [0, 1, 2], actors=("a", "b", "a"))
    assert incidents.build_incidents(flat, 15, mode="split").count() == 3
    assert incidents.build_incidents(flat, 15, mode="independent").count() == 2


def test_empty_input(spark):
    assert incidents.build_incidents(features.derive_event_features(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("step", [0, 1, 40, 400])
def test_prior_counts_of_one_key_over_many_parts(spark, step):
    """Equal times, dense times and sparse times of a key that fills most parts; few events look into earlier parts."""
    rows = [(i, 1_700_000_000 + (i * step if i % 9 else None or 0), "hot" if i % 5 else f"k{i % 3}") for i in range(600)]
    rows = sorted(rows, key=lambda r: r[1])
    frame = spark.createDataFrame([(n, t, k) for n, (_, t, k) in enumerate(rows)], f"{features.INDEX} long, t long, k string")
    frame = frame.select(features.INDEX, F.timestamp_seconds("t").alias("event_time"), "k").repartition(6)
    got = features.prior_activity(frame, {"key": ("k", "NONE")}, {"5m": 300, "1h": 3600}).collect()
    counts = {r[features.INDEX]: (r["key_prev_5m"], r["key_prev_1h"]) for r in got}
    assert len(counts) == 600
    for n, (_, t, k) in enumerate(rows):
        before = [u for _, u, other in rows[:n] if other == k]
        assert counts[n] == (sum(u >= t - 300 for u in before), sum(u >= t - 3600 for u in before)), n


def test_prior_counts_move_one_row_per_key(spark):
    from trailwarden.operators import ordering
    written = []
    frame = spark.range(3000).select(F.col("id").alias(features.INDEX), F.timestamp_seconds(F.col("id") * 60).alias("event_time"), F.lit("k").alias("k"))
    kept = ordering.materialize
    try:
        ordering.materialize = lambda df, label: (written.append((label, out := kept(df, label))), out)[1]
        features.prior_activity(frame, {"key": ("k", "NONE")}, {"5m": 300, "1h": 3600}).count()
    finally:
        ordering.materialize = kept
    sizes = {label: out.count() for label, out in written}
    assert sizes["prior-events"] == 3000 and sizes["prior-edges"] < 1500  # three marks an event before


def test_long_tables_are_staged_in_small_parts(spark):
    from trailwarden import session

    seen = []
    with session.small_parts(spark):
        seen += [spark.conf.get(key) for key in session.STAGED_PARTS]
    assert seen == list(session.STAGED_PARTS.values())
    assert all(spark.conf.get(key, None) != value for key, value in session.STAGED_PARTS.items())  # put back
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    assert session.materialize(rows.groupBy("k").count(), "small", small=True).agg(F.sum("count")).first()[0] == 1000
