import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.fixtures import rows
from wardcast.operators.survival import by_day, conditional_occupancy, curve_arrays, from_days, survival_curve


def brute_curve(stays, horizon):
    groups = defaultdict(list)
    for *key, los in stays:
        groups[tuple(key)].append(los)
    out = []
    for key, lengths in groups.items():
        for day in range(horizon + 1):
            alive = sum(1 for n in lengths if n is not None and n > day)
            out.append((*key, day, len(lengths), alive, alive / len(lengths)))
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


def random_stays(seed, n):
    rng = random.Random(seed)
    lengths = [None, -3, 0, 1, 2, 5, 29, 30, 31, 32, 400]
    return [(rng.choice(["x", "y", None]), rng.choice(["u", None]), rng.choice(lengths)) for _ in range(n)]


@pytest.mark.parametrize("horizon", [0, 1, 30, 365])
def test_curve_equals_every_stay_times_every_day(spark, horizon):
    stays = random_stays(horizon, 300)
    df = spark.createDataFrame(stays, "a string, b string, los int")
    assert rows(survival_curve(df, ["a", "b"], horizon)) == brute_curve(stays, horizon)


@pytest.mark.parametrize("lengths", [[None], [0], [-1], [1], [31], [30], [500], [None, 0, 1], [2, 2, 9]])
def test_curve_without_keys(spark, lengths):
    df = spark.createDataFrame([(n,) for n in lengths], "los int")
    assert rows(survival_curve(df, [], 30)) == brute_curve([(n,) for n in lengths], 30)


def test_weighted_curve_equals_repeated_rows(spark):
    stays = random_stays(7, 200)
    counts = defaultdict(int)
    for s in stays:
        counts[s] += 1
    df = spark.createDataFrame([(*k, n) for k, n in counts.items()], "a string, b string, los int, copies long")
    assert rows(survival_curve(df, ["a", "b"], 30, weight="copies")) == brute_curve(stays, 30)


def test_horizon_per_key(spark):
    df = spark.createDataFrame([("x", 3, 2), ("x", 3, 9), ("y", 5, 2)], "a string, h int, los int")
    got = rows(survival_curve(df, ["a"], "h"), "a", "day_num", "numerator")
    assert got == [("x", 0, 2), ("x", 1, 2), ("x", 2, 1), ("x", 3, 1)] + [
        ("y", 0, 1), ("y", 1, 1), ("y", 2, 0), ("y", 3, 0), ("y", 4, 0), ("y", 5, 0),
    ]


def test_curve_never_rises(spark):
    df = spark.createDataFrame(random_stays(11, 500), "a string, b string, los int")
    by_key = defaultdict(list)
    for a, b, _, _, _, p in rows(survival_curve(df, ["a", "b"], 60)):
        by_key[a, b].append(p)
    for values in by_key.values():
        assert len(values) == 61 and values == sorted(values, reverse=True)
        assert all(0 <= p <= 1 for p in values)


def conditional(spark, patients, stays, horizon=3, curve_days=10):
    curve = curve_arrays(spark.createDataFrame(stays, "grp string, svc string, los int"), ["grp", "svc"], curve_days)
    current = spark.createDataFrame(patients, "csn int, svc string, days_into_admission int")
    df = conditional_occupancy(current, curve, "svc", horizon, curve_days)
    return rows(df, "csn", "days_out", "probability")


def test_conditional_ratio_and_first_day_certain(spark):
    stays = [("g", "a", n) for n in (1, 2, 3, 4)]
    assert conditional(spark, [(1, "a", 1)], stays) == [(1, 0, 1.0), (1, 1, 2 / 3), (1, 2, 1 / 3), (1, 3, 0.0)]


def test_conditional_without_survivors_assumes_stay(spark):
    assert conditional(spark, [(1, "a", 5)], [("g", "a", 2)]) == [(1, n, 1.0) for n in range(4)]


def test_conditional_ends_with_the_curve_and_goes_on_beyond_it(spark):
    stays = [("g", "a", 400)]
    assert conditional(spark, [(1, "a", 9)], stays) == [(1, 0, 1.0), (1, 1, 1.0)]
    assert conditional(spark, [(1, "a", 10)], stays) == [(1, 0, 1.0)]
    # Beyond the curve neither the type nor its curve matters.
    assert conditional(spark, [(1, None, 11)], stays) == [(1, n, 1.0) for n in range(4)]


def test_conditional_drops_unknown_types(spark):
    assert conditional(spark, [(1, None, 0), (2, "b", 0)], [("g", "a", 5)]) == []


def test_conditional_pairs_groups_sharing_a_name(spark):
    stays = [("g", "a", 2), ("h", "a", 2), ("h", "a", 4)]
    got = conditional(spark, [(1, "a", 1)], stays, horizon=1)
    # Reached 1.0 or 1.0; the day after 0.0 or 0.5; all four pairings on each day.
    assert got == [(1, 0, 1.0)] * 4 + [(1, 1, 0.0)] * 2 + [(1, 1, 0.5)] * 2


def test_conditional_matches_brute_force(spark):
    rng = random.Random(3)
    stays = [("g", rng.choice("ab"), rng.choice([0, 1, 2, 4, 9, 12, None])) for _ in range(60)]
    patients = [(i, rng.choice(["a", "b", "z"]), rng.randrange(0, 14)) for i in range(40)]
    prob = {(s, d): p for _, s, d, _, _, p in brute_curve(stays, 10)}
    want = []
    for csn, svc, m in patients:
        for k in range(4):
            if m > 10:
                want.append((csn, k, 1.0))
            elif (svc, m + k) in prob:
                want.append((csn, k, prob[svc, m + k] / prob[svc, m] if prob[svc, m] > 0 else 1.0))
    assert conditional(spark, patients, stays) == sorted(want)


def test_curve_shuffles_counts_not_stays(spark):
    df = spark.range(1000).select(F.lit("x").alias("a"), (F.col("id") % 50).cast("int").alias("los"))
    plan = survival_curve(df, ["a"], 30)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_arrays_are_the_curves_by_day(spark):
    stays = spark.createDataFrame(random_stays(5, 200), "a string, b string, los int")
    arrays = curve_arrays(stays, ["a", "b"], 20)
    assert {len(r["numerators"]) for r in arrays.collect()} == {21}
    again = from_days(by_day(arrays), ["a", "b"])
    assert rows(again) == rows(arrays, "a", "b", "probabilities")
    assert rows(curve_arrays(stays.limit(0), [], 20)) == rows(curve_arrays(stays.limit(0), ["a"], 20)) == []


def test_lengths_of_any_integer_type(spark):
    lengths = [0, 3, 3, 90, None]
    df = spark.createDataFrame([(n,) for n in lengths], "los bigint")
    assert rows(survival_curve(df, [], 30)) == brute_curve([(n,) for n in lengths], 30)


def test_patients_meet_curves_in_one_join(spark):
    stays = spark.createDataFrame([("g", "a", 3)], "grp string, svc string, los int")
    current = spark.createDataFrame([(1, "a", 1)], "csn int, svc string, days_into_admission int")
    df = conditional_occupancy(current, curve_arrays(stays, ["grp", "svc"], 10), "svc", 3, 10)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Window" not in plan
