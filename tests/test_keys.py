"""Reducing by key sets and splitting heavy keys, against plain joins."""

import random

import pytest
from pyspark.sql import functions as F

from tests.fixtures import CFG, encounter, rows, ts
from tests.test_cohorts import forecast, transfer_tables
from wardcast.functions import keys
from wardcast.functions.keys import KeySet, Split
from wardcast.operators import census, obstetrics, profile, transfers
from wardcast.plans.staging import Lazy, Tables


@pytest.fixture(autouse=True)
def large(monkeypatch):
    """Takes every table to be large."""
    monkeypatch.setattr(keys, "_SMALL_BYTES", 0)


@pytest.fixture
def stage(spark, tmp_path):
    with Tables(spark, str(tmp_path)) as stage:
        yield stage


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_filter_holds_its_keys_and_few_others(spark, kind):
    inside = spark.range(0, 40_000, 2).select(F.col("id").cast(kind).alias("k"))
    known = keys.key_filter(inside, "k", 20_000)
    sizes = [(r["block"], len(r["words"])) for r in known.collect()]
    assert sorted(b for b, _ in sizes) == list(range(3)) and {n for _, n in sizes} == {1024}
    tried = spark.range(40_000).select(F.col("id").cast(kind).alias("key"), "id").unionByName(
        spark.createDataFrame([(None, 1)], f"key {kind}, id bigint")
    )
    left = keys.passing(tried, "key", known, 20_000)
    assert left.columns == ["key", "id"]
    ids = [r["id"] for r in left.collect()]
    assert set(range(0, 40_000, 2)) <= set(ids)
    assert len(ids) - 20_000 < 0.06 * 20_000
    assert "LeftSemi" not in left._jdf.queryExecution().executedPlan().toString()


def test_filter_of_no_keys(spark):
    none = keys.key_filter(spark.createDataFrame([], "k bigint"), "k", 0)
    assert keys.passing(spark.range(10).withColumnRenamed("id", "k"), "k", none, 0).count() == 0


@pytest.mark.parametrize("way", ["uncounted", "broadcast", "filter", "shuffled"])
def test_every_way_keeps_what_the_join_needs(spark, stage, monkeypatch, way):
    few = {"uncounted": 10**6, "broadcast": 10**6, "filter": 5, "shuffled": 5}[way]
    monkeypatch.setattr(keys, "MOST_KEYS", few)
    monkeypatch.setattr(keys, "MOST_FILTERED", 5 if way == "shuffled" else 10**6)
    facts = spark.createDataFrame([(i % 50, i) for i in range(0, 400, 3)] + [(None, 7)], "k int, n int")
    wide = spark.createDataFrame([(i % 300, i) for i in range(900)] + [(None, 1)], "key int, m int")
    known = KeySet.of(facts, "k", way != "uncounted")
    assert (known.number is None) == (way == "uncounted")
    reduced = known.reduce(wide, "key")
    join = lambda right: rows(facts.join(right, F.col("k") == F.col("key")))
    assert join(reduced) == join(wide)
    assert reduced.columns == ["key", "m"] and reduced.count() < 250


def skewed(spark):
    """A third of the rows of one key, and a key that only one side has."""
    r = random.Random(1)
    many = [(0, i) for i in range(300)] + [(r.randrange(1, 90), i) for i in range(600)] + [(None, 5), (500, 1)]
    one = [(k, f"v{k}") for k in range(100)] + [(None, "none")]
    return spark.createDataFrame(many, "k int, n int"), spark.createDataFrame(one, "k int, v string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_is_the_join(spark, stage, monkeypatch, how):
    monkeypatch.setattr(keys, "MOST_ROWS", 40)
    many, one = skewed(spark)
    split = Split.of(many, "k", stage, "heavy")
    assert rows(split.heavy) == [(0, 8)]
    got = split.many(many).join(split.one(one), split.on, how).drop("_part")
    assert rows(got, *many.join(one, "k", how).columns) == rows(many.join(one, "k", how))


def test_no_part_of_a_heavy_key_is_large(spark, stage, monkeypatch):
    monkeypatch.setattr(keys, "MOST_ROWS", 40)
    many, one = skewed(spark)
    split = Split.of(many, "k", stage, "heavy")
    parts = {(r["k"], r["_part"]): r["count"] for r in split.many(many).groupBy("k", "_part").count().collect()}
    assert max(n for (k, _), n in parts.items() if k == 0) < 80 and sum(n for (k, _), n in parts.items() if k == 0) == 300
    assert {p for k, p in parts if k != 0} == {0}
    # The chain of joins that follows stays dealt: the exchanges are by key and part.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chain = split.many(many).join(split.one(one), split.on).join(split.one(one.withColumnRenamed("v", "w")), split.on)
        text = chain._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert lines and all("_part" in line for line in lines)


def test_left_join_with_many_rows_of_a_key(spark, stage, monkeypatch):
    many, one = skewed(spark)
    want = rows(one.join(many, "k", "left"), "k", "v", "n")
    for most in (10**6, 40, 1):
        monkeypatch.setattr(keys, "MOST_ROWS", most)
        split = Split.of(many, "k", stage, f"heavy{most}")
        assert (split.heavy is None) == (most == 10**6)
        assert rows(split.left_join_many(one, many), "k", "v", "n") == want


@pytest.mark.parametrize("hashes", [1, 4096])
def test_keys_are_counted_only_by_hashes_of_many_rows(spark, stage, monkeypatch, hashes):
    class Recorded:
        stores = True

        def __init__(self):
            self.plans = {}

        def __call__(self, name, df):
            self.plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
            return stage(name, df)

    monkeypatch.setattr(keys, "_HASHES", hashes)
    monkeypatch.setattr(keys, "MOST_ROWS", 100)
    even = spark.range(9_000).select((F.col("id") % 3_000).alias("k"))
    seen = Recorded()
    assert Split.of(even, "k", seen, f"even{hashes}").heavy is None
    # None of 4,096 hashes has so many rows of so few a key; the only hash has.
    assert list(seen.plans) == ([f"even{hashes}_hashes"] if hashes > 1 else ["even1_hashes", "even1"])
    assert "Aggregate [_hash" in seen.plans[f"even{hashes}_hashes"]
    many = even.unionByName(spark.range(200).selectExpr("7L AS k")).unionByName(spark.range(300).selectExpr("CAST(NULL AS BIGINT) AS k"))
    assert rows(Split.of(many, "k", stage, f"many{hashes}").heavy) == [(7, 3)]


def test_small_tables_are_not_counted(spark, stage, monkeypatch):
    monkeypatch.setattr(keys, "MOST_ROWS", 1)
    many = stage("many", skewed(spark)[0])
    assert Split.of(many, "k", stage, "heavy").heavy is not None
    monkeypatch.setattr(keys, "_SMALL_BYTES", 64 << 20)
    assert Split.of(many, "k", stage, "heavy again").heavy is None


def test_nothing_is_counted_for_a_lazy_plan(spark):
    many, one = skewed(spark)
    split = Split.of(many, "k", Lazy(), "heavy")
    assert split.on == ["k"] and split.many(many) is many and split.one(one) is one


@pytest.mark.parametrize("few", [0, 10**6])
def test_transfers_with_a_destination_that_many_requests_share(spark, stage, monkeypatch, few):
    monkeypatch.setattr(keys, "MOST_ROWS", 10)
    monkeypatch.setattr(keys, "MOST_KEYS", few)
    tables = transfer_tables([("d1", [1, 2], 2, [(1, 2, "2020-07-01 12:00")]), ("d2", [], 2, []), ("d3", [1], 4, [])])
    asked = [r for r in tables["attachment"] if r.get("target_comm_id") == "d1"]
    for i in range(60):
        tables["request"] = [*tables["request"], {**tables["request"][0], "comm_id": f"r{i}"}]
        tables["request_detail"] = [*tables["request_detail"], {**tables["request_detail"][0], "comm_id": f"r{i}"}]
        tables["attachment"] = [*tables["attachment"], {**asked[0], "comm_id": f"r{i}"}]
        tables["attachment"].append({"comm_id": "r0", "attachment_c": 22, "csn": 1000 + i})
    f = forecast(spark, encounter=[], **tables)
    for build in (transfers.transfer_destinations, transfers.transfer_requests):
        assert rows(build(f.tables, CFG, stage)) == rows(build(f.tables, CFG))
    assert transfers.transfer_destinations(f.tables, CFG).count() > 60
    assert transfers.transfer_requests(f.tables, CFG).count() > 100


def test_contacts_with_an_episode_that_many_share(spark, stage, monkeypatch):
    monkeypatch.setattr(keys, "MOST_ROWS", 10)
    links = [{"csn": i, "episode_id": 1 if i % 3 == 0 else i} for i in range(90)]
    f = forecast(
        spark,
        contact=[
            {"csn": i, "pat_id": f"p{i}", "contact_ts": ts("2021-01-01"), "appt_status_c": 2, "department_id": 1, "provider_id": "p1"}
            for i in range(90)
        ],
        episode_link=links,
        episode=[{"episode_id": i} for i in range(80)],
        due_date=[{"episode_id": i, "is_working": "Y", "due_user_ts": ts("2021-06-01")} for i in range(60)],
    )
    got = rows(obstetrics.prior_contacts(f.tables, CFG, stage), "csn", "due_ts")
    assert got == rows(obstetrics.prior_contacts(f.tables, CFG), "csn", "due_ts") and len(got) > 50


def test_census_of_an_encounter_with_very_many_movements(spark, stage, monkeypatch):
    monkeypatch.setattr(keys, "MOST_ROWS", 10)
    move = lambda csn, minute: {
        "csn": csn, "effective_ts": ts(f"2021-04-29 23:{minute:02d}"), "department_id": 1, "event_type_c": 6, "event_subtype_c": 1,
    }
    f = forecast(
        spark,
        encounter=[encounter(i, f"p{i}", "2021-04-28 10:00") for i in range(20)],
        movement=[move(1, n % 60) for n in range(90)] + [move(i, i) for i in range(30)],
    )
    tags = profile.tag_source(f.profile, direct_only=False)
    got = rows(census.midnight_census(f.tables, f.days, tags, CFG, stage))
    assert got == rows(census.midnight_census(f.tables, f.days, tags, CFG)) and len(got) == 110
