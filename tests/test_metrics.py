"""Metric values on hand-made histories."""

import datetime as dt
from functools import reduce

import pytest
from compat_data import facts, key, releases
from pyspark.sql import DataFrame

from driftline import model
from driftline.operators import metrics, timeline
from driftline.operators.signature import with_release_key

SEVEN = {"o#a": "A", "o#b": "B", "o#c1": "C", "o#ab": "AB", "o#ac": "AC", "o#bc": "BC", "o#abc": "ABC"}
ONE_EACH = {"A1": "2015-01-01", "B1": "2015-01-01", "C1": "2015-01-01"}
REMOVAL = {"A1": "2015-01-01", "A2": "2016-01-02", "A3": "2017-01-03", "B1": "2017-01-04", "C1": "2017-01-05"}
OLD = {"A0": "2014-01-01", "A1": "2015-01-02", "A2": "2016-01-03", "A3": "2017-01-04", "B1": "2017-01-05",
       "C1": "2017-01-06"}
ACCUMULATED = {"A0": "2014-01-01", "A1": "2015-01-02", "A2": "2016-01-03", "A3": "2017-01-06",
               "B1": "2016-01-04", "C1": "2016-01-05"}
TWO_YEARS = {"A1": "2015-01-01", "B1": "2015-01-01", "A2": "2017-04-01", "B2": "2017-04-01"}
IN_GRACE = {f"{b}{v}": d for b in "AB" for v, d in
            (("2", "2016-02-01"), ("2.1", "2016-03-01"), ("3", "2017-04-01"))}
REMOVALS = {"r#1": ["A0", "B1", "C1"], "r#2": ["A0", "A1", "B1", "C1"]}


def first_releases(names):
    return [f"{name}1" for name in names]


def values(spark, kind, history, support):
    apis, junction = facts(spark, support)
    rows = metrics.browser_metrics(releases(spark, history), apis, junction, [kind]).collect()
    return {(r.browser_name[0], str(r.date)): r for r in rows}


CASES = [
    (model.BROWSER_SPECIFIC, ONE_EACH, {**{k: first_releases(v) for k, v in SEVEN.items()}, "o#c2": ["C1"]},
     {("A", "2015-01-01"): 1, ("B", "2015-01-01"): 1, ("C", "2015-01-01"): 2}),
    (model.BROWSER_SPECIFIC, TWO_YEARS, {"x#y": ["A1", "A2", "B1"]},
     {("A", "2015-01-01"): 0, ("B", "2015-01-01"): 0, ("A", "2017-04-01"): 1, ("B", "2017-04-01"): 0}),
    (model.BROWSER_SPECIFIC, IN_GRACE, {"x#y": ["A2.1", "A3"]},
     {("A", "2016-03-01"): 0, ("A", "2017-04-01"): 1}),
    (model.LONE_OMISSION, ONE_EACH, {k: first_releases(v) for k, v in SEVEN.items()},
     {("A", "2015-01-01"): 1, ("B", "2015-01-01"): 1, ("C", "2015-01-01"): 1}),
    (model.LONE_OMISSION, TWO_YEARS, {"x#y": ["A1", "A2", "B1"]},
     {(b, d): 0 for b in "AB" for d in ("2015-01-01", "2017-04-01")}),
    (model.LONE_OMISSION,
     {f"{b}{v}": d for b in "ABC" for v, d in (("2", "2016-02-01"), ("2.1", "2016-03-01"))},
     {"x#y": ["B2", "B2.1", "C2.1"]}, {("A", "2016-03-01"): 0}),
    # One other browser released nothing within the year: every API never shipped counts.
    (model.LONE_OMISSION, {"A1": "2015-01-01", "B1": "2013-01-01"}, {"x#y": ["B1"], "x#z": [], "x#a": ["A1"]},
     {("A", "2015-01-01"): 2, ("B", "2015-01-01"): 1}),
    (model.LONE_REMOVAL, REMOVAL, {"x#y": ["A1", "B1", "C1"]}, {("A", "2017-01-05"): 1}),
    (model.LONE_REMOVAL, REMOVAL, {"x#y": ["A1", "A3", "B1", "C1"]}, {("A", "2017-01-05"): 0}),
    (model.LONE_REMOVAL, {**REMOVAL, "A0": "2014-01-01", "A2": "2016-01-06"}, {"x#y": ["A0", "A1", "B1", "C1"]},
     {("A", "2017-01-05"): 0}),
    (model.LONE_REMOVAL, OLD, REMOVALS, {("A", "2017-01-06"): 2}),
    (model.LONE_REMOVAL, ACCUMULATED, REMOVALS, {("A", "2016-01-05"): 1, ("A", "2017-01-06"): 2}),
    # Exactly one other browser gives no removals at all.
    (model.LONE_REMOVAL, {k: v for k, v in REMOVAL.items() if k != "C1"}, {"x#y": ["A1", "B1"]}, {}),
]


@pytest.mark.parametrize("kind,history,support,expected", CASES)
def test_values(spark, kind, history, support, expected):
    found = {point: row.value for point, row in values(spark, kind, history, support).items()}
    if kind == model.LONE_REMOVAL:
        assert found == expected
    else:
        assert {point: found[point] for point in expected} == expected


def test_removal_is_tied_to_the_release_that_dropped_it(spark):
    row = values(spark, model.LONE_REMOVAL, REMOVAL, {"x#y": ["A1", "B1", "C1"]})[("A", "2017-01-05")]
    assert (row.release, row.prev_releases, row.compared_releases) == (key("A2"), [key("A1")], [key("B1"), key("C1")])


def test_api_counts(spark):
    history = {"A1": "2015-01-01", "A2": "2016-01-01", "B1": "2015-01-01"}
    apis, junction = facts(spark, {"a#1": ["A1"], "a#2": ["A1", "A2"], "a#3": ["A2", "B1"]})
    rows = metrics.api_counts(releases(spark, history), apis, junction).collect()
    assert sorted((r.curr_release, r.prev_release or "", r.total_apis, r.new_apis, r.removed_apis) for r in rows) == [
        (key("A1"), "", 2, 0, 0), (key("A2"), key("A1"), 2, 1, 1), (key("B1"), "", 1, 0, 0)]


def test_latest_release_prefers_one_system(spark):
    history = {"A1": "2015-01-01", "A2": ("2015-03-01", "OSX"), "B1": ("2015-02-01", "OSX"), "B2": "2015-04-01"}
    rows = timeline.latest_release_asof(with_release_key(releases(spark, history))).collect()
    found = {(str(r.date), r.browser_name[0]): r.release_key.split("_")[1] for r in rows}
    assert found == {
        ("2015-01-01", "A"): "1", ("2015-02-01", "A"): "1", ("2015-03-01", "A"): "1", ("2015-04-01", "A"): "1",
        ("2015-02-01", "B"): "1", ("2015-03-01", "B"): "1", ("2015-04-01", "B"): "2"}


def test_counts_follow_the_preferred_system_and_keep_one_row_a_day(spark):
    history = {"A1": ("2015-01-01", "OSX"), "A2": "2015-02-01", "A3": "2015-02-01", "B1": ("2015-01-05", "OSX")}
    rows = timeline.consecutive_pairs(with_release_key(releases(spark, history))).collect()
    assert sorted((r.curr_release, r.prev_release) for r in rows if r.browser_name == "Alpha") == [
        (key("A3"), key("A2"))]
    assert [r.curr_release for r in rows if r.browser_name == "Beta"] == [key("B1", "OSX")]


def test_leap_day_grace(spark):
    history = {"A1": "2016-02-29", "B1": "2015-03-01", "B2": "2015-02-28"}
    points = timeline.metric_points(with_release_key(releases(spark, history))).collect()
    point = next(p for p in points if str(p.date) == "2016-02-29" and p.browser_name == "Alpha")
    assert point.grace_compared == [key("B1")]


def test_all_types_share_a_pass(spark):
    apis, junction = facts(spark, {"x#y": ["A1", "B1", "C1"], "x#z": ["B1", "C1"]})
    known = releases(spark, REMOVAL)
    every, counts = metrics.run_all_metrics(known, apis, junction)
    single = reduce(DataFrame.unionByName, [
        metrics.browser_metrics(known, apis, junction, [kind]) for kind in model.METRIC_TYPES])
    assert sorted(map(str, every.collect())) == sorted(map(str, single.collect()))
    assert counts.count() == 5
    only, none = metrics.run_all_metrics(known, apis, junction, [model.LONE_OMISSION])
    assert none is None and only.count() == 3


def test_other_browsers_release_on_mobile_is_ignored(spark):
    known = timeline.desktop_only(releases(spark, {"A1": "2015-01-01", "A2": ("2015-02-01", "Android")}))
    assert [r.release_date for r in known.collect()] == [dt.date(2015, 1, 1)]
