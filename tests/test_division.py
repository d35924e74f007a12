"""The division against a plain evaluation in Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from driftline import model
from driftline.operators import division
from driftline.operators.signature import ReleaseIndex, signatures


def random_case(spark, seed, n_releases, n_apis, n_measures):
    rng = random.Random(seed)
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(n_releases)]
    rows = [(f"B{i % 3}", str(i), "Windows", "10", day) for i, day in enumerate(days)]
    keys = [f"{b}_{v}_{o}_{ov}" for b, v, o, ov, _ in rows]
    ships = {f"i#a{i}": {k for k in keys if rng.random() < rng.choice((0.2, 0.9))} for i in range(n_apis)}
    measures = []
    for number in range(n_measures):
        pick = lambda most: rng.sample(keys, rng.randint(0, most))
        measures.append((number, pick(3), pick(3), pick(4) if rng.random() < 0.5 else None))
    frames = (
        spark.createDataFrame(rows, model.RELEASES),
        spark.createDataFrame([(k,) for k in ships], "interface_key string"),
        spark.createDataFrame([(r, k) for k, shipped in ships.items() for r in shipped], model.JUNCTION),
        spark.createDataFrame(measures, "id int, all_of array<string>, none_of array<string>, any_of array<string>"),
    )
    expected = {
        (number, api) for number, all_of, none_of, any_of in measures for api, shipped in ships.items()
        if set(all_of) <= shipped and not set(none_of) & shipped and (any_of is None or set(any_of) & shipped)
    }
    return frames, expected


@pytest.mark.parametrize("seed,n_releases", [(1, 9), (2, 64), (3, 150)])
def test_division_agrees_with_plain_python(spark, seed, n_releases):
    (releases, apis, junction, measures), expected = random_case(spark, seed, n_releases, 40, 12)
    found = division.matches(measures, ["id"], releases, apis, junction)
    assert sorted(tuple(r) for r in found.select("id", "interface_key").collect()) == sorted(expected)
    counts = division.with_counts(
        measures, ["id"], division.counts(measures, ["id"], releases, apis, junction))
    assert {r.id: r.value for r in counts.collect()} == {
        number: sum(1 for m, _ in expected if m == number) for number in range(12)}


def test_facts_of_unlisted_apis_and_releases_are_ignored_or_refused(spark):
    (releases, apis, junction, _), _ = random_case(spark, 4, 5, 6, 1)
    index = ReleaseIndex.build(releases)
    stray_api = junction.unionByName(junction.limit(1).withColumn("interface_key", F.lit("no#api")))
    stray_release = junction.unionByName(junction.limit(1).withColumn("release_key", F.lit("X_1_Y_2")))
    plain = sorted(map(str, signatures(apis, junction, index).collect()))
    for stray, message in ((stray_api, "unknown API"), (stray_release, "unknown release")):
        assert sorted(map(str, signatures(apis, stray, index).collect())) == plain
        with pytest.raises(Exception, match=message):
            signatures(apis, stray, index, strict=True).collect()


def test_ten_thousand_releases(spark):
    (releases, apis, junction, measures), expected = random_case(spark, 5, 10_000, 3, 4)
    found = division.matches(measures, ["id"], releases, apis, junction)
    assert sorted(tuple(r) for r in found.select("id", "interface_key").collect()) == sorted(expected)


def test_releases_listed_twice_change_nothing(spark):
    from driftline.operators import drilldown, metrics

    (releases, apis, junction, _), _ = random_case(spark, 6, 9, 30, 1)
    later = releases.withColumn("release_date", F.date_add("release_date", 400))
    for more in (releases, releases.unionByName(releases), releases.unionByName(later)):
        rows, counts = metrics.run_all_metrics(more, apis, junction)
        found = sorted(map(str, rows.collect())), sorted(map(str, counts.collect()))
        alone = sorted(map(str, metrics.browser_metrics(more, apis, junction).collect()))
        if more is releases:
            usual = found
            lists = sorted(map(str, drilldown.metric_apis(model.LONE_OMISSION, more, apis, junction).collect()))
        assert found == usual and alone == usual[0]
    one = rows.where(F.col("type") == model.LONE_OMISSION).limit(1)
    asked = drilldown.metric_apis(model.LONE_OMISSION, releases, apis, junction, one)
    assert asked.count() == one.first().value and set(map(str, asked.collect())) <= set(lists)


def test_one_release_that_all_measures_name(spark):
    """Every measure asks for one release; most APIs share a signature, so they are few classes."""
    rng = random.Random(7)
    rows = [("B", str(i), "Windows", "10", dt.date(2000, 1, 1) + dt.timedelta(days=i)) for i in range(12)]
    keys = [f"{b}_{v}_{o}_{ov}" for b, v, o, ov, _ in rows]
    kinds = [{keys[0], *rng.sample(keys, rng.randint(0, 6))} for _ in range(30)]
    ships = {f"i#a{i}": kinds[0] if i < 2000 else rng.choice(kinds) for i in range(3000)}
    ships["i#never"] = set()
    measures = [(i, [keys[0]], rng.sample(keys[1:], 2), None) for i in range(200)] + [(200, [], keys[1:3], None)]
    frames = (
        spark.createDataFrame(rows, model.RELEASES), spark.createDataFrame([(k,) for k in ships], "interface_key string"),
        spark.createDataFrame([(r, k) for k, shipped in ships.items() for r in shipped], model.JUNCTION),
    )
    asked = spark.createDataFrame(measures, "id int, all_of array<string>, none_of array<string>, any_of array<string>")
    known = division.signature_classes(*frames)
    assert known.classes.count() == len({frozenset(s) for s in ships.values()})
    counted = {r.id: r.value for r in division.counts(asked, ["id"], *frames).collect()}
    expected = {
        i: sum(1 for shipped in ships.values() if set(all_of) <= shipped and not set(none_of) & shipped)
        for i, all_of, none_of, _ in measures
    }
    assert counted == {i: n for i, n in expected.items() if n}
    # A measure meets the blocks of classes, not APIs.
    hits = division.hits(division.headers(asked, ["id"]), division.long_roles(asked, ["id"]), ["id"], known)
    blocks = known.classes.select(F.shiftright("class_id", 6)).distinct().count()
    assert hits.count() <= len(measures) * blocks < len(measures) * 40


def test_five_thousand_releases_of_one_browser(spark):
    from driftline.operators import metrics

    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(5000)]
    rows = [("A", str(i), "Windows", "10", day) for i, day in enumerate(days)] + [("B", "1", "Windows", "10", days[0])]
    releases = spark.createDataFrame(rows, model.RELEASES)
    apis = spark.createDataFrame([("x#always",), ("x#late",)], "interface_key string")
    always = [(f"A_{i}_Windows_10", "x#always") for i in range(5000)]
    late = [(f"A_{i}_Windows_10", "x#late") for i in range(4000, 5000)]
    junction = spark.createDataFrame(always + late, model.JUNCTION)
    rows = metrics.browser_metrics(releases, apis, junction, [model.BROWSER_SPECIFIC]).where("browser_name = 'A'")
    found = {r.date: (r.value, len(r.prev_releases)) for r in rows.collect()}
    assert len(found) == 5000
    assert found[days[300]] == (1, 300) and found[days[4100]] == (1, 365) and found[days[4366]] == (2, 365)
