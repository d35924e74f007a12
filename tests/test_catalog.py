"""Names, the wide table, the grid and search."""

import datetime as dt

import pytest
from compat_data import facts, key, releases
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline import functions as fn
from driftline import model
from driftline.operators import compat, search
from driftline.operators.signature import ReleaseIndex, signatures
from driftline.sources import sinks

DAY = dt.date(2015, 1, 1)


def rows_of(spark, *parts):
    return spark.createDataFrame([(*p, DAY) for p in parts], model.RELEASES)


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(col.alias("v")).first().v


def test_names(spark):
    release = rows_of(spark, ("Safari", "5.1.5", "OSX", "10.7.5"))
    row = release.select(fn.release_key().alias("k"), fn.column_name().alias("c"), fn.column_label().alias("l")).first()
    assert tuple(row) == ("Safari_5.1.5_OSX_10.7.5", "safari5_1_5oSX10_7_5", "Safari 5.1.5 OSX 10.7.5")
    assert one(spark, fn.terse_release_id("k"), k="Beta_54.1.443252_OldOS_15.0") == "bet54.1old15.0"
    with pytest.raises(Exception, match="unexpected release key"):
        one(spark, fn.terse_release_id("k"), k="Beta_54")
    with pytest.raises(Exception, match="malformed interface key"):
        one(spark, fn.split_interface_key("k"), k="a#b#c")


@pytest.mark.parametrize("browser,version,friendly", [
    ("Safari", "534.57.2", "5.1"), ("Safari", "537.43.58", "6.1"), ("Safari", "537.99", "537.99"),
    ("Safari", "601.7.8", "9.1"), ("Chrome", "534.57", "534.57")])
def test_friendly_version(spark, browser, version, friendly):
    assert one(spark, fn.friendly_browser_version("b", "v"), b=browser, v=version) == friendly


def test_truth_and_leap_days(spark):
    assert one(spark, fn.truthy(F.lit(0.0), T.DoubleType())) is False
    assert one(spark, fn.truthy(F.lit(float("nan")), T.DoubleType())) is False
    assert one(spark, fn.truthy(F.lit(""), T.StringType())) is False
    assert one(spark, fn.truthy(F.lit(None).cast("boolean"), T.BooleanType())) is False
    assert one(spark, fn.truthy(F.lit("0"), T.StringType())) is True
    assert one(spark, fn.one_year_before(F.lit("2016-02-29").cast("date"))) == dt.date(2015, 3, 1)
    assert one(spark, fn.epoch_ms(F.lit("1970-01-02").cast("date"))) == 86_400_000


def test_wide_table_and_grid(spark):
    known = releases(spark, {"A1": "2015-01-01", "B1": "2015-01-02", "C1": "2015-01-03"})
    apis, junction = facts(spark, {"I#alpha": ["A1"], "I#beta": ["B1", "C1"], "I#never": []})
    index = ReleaseIndex.build(known)
    rows = signatures(apis, junction, index, strict=True)
    wide = compat.pivot_compat(rows, index)
    assert wide.columns == ["id", "interface_name", "api_name", "alpha1windows10", "beta1windows10", "charlie1windows10"]
    assert sorted(tuple(r)[2:] for r in wide.collect()) == [
        ("alpha", True, False, False), ("beta", False, True, True), ("never", False, False, False)]
    assert compat.column_for_release(wide, key("B1")) == "beta1windows10"
    with pytest.raises(KeyError):
        compat.column_for_release(wide, key("D1"))
    assert compat.select_releases(wide, [key("C1"), key("A1")]).columns[3:] == ["alpha1windows10", "charlie1windows10"]
    grid = compat.build_grid(rows, index)
    assert {r.id: r.data for r in grid.collect()}["I#beta"] == [False, True, True]
    flipped = compat.project_cols(grid, index.keys, [key("C1"), "unknown", key("A1")])
    assert {r.id: r.data for r in flipped.collect()}["I#beta"] == [True, False]
    assert compat.integrity_violations(index.frame, apis, junction).isEmpty()
    exported = sinks.export_rows(rows, index, [key("B1")]).collect()
    assert sorted(tuple(r) for r in exported) == [("I#alpha", "FALSE"), ("I#beta", "TRUE"), ("I#never", "FALSE")]


def test_equal_column_names_share_a_column(spark):
    known = rows_of(spark, ("Alpha", "1.2", "Zulu", "9"), ("Alpha", "1_2", "Zulu", "9"))
    apis = spark.createDataFrame([("i#a",), ("i#b",)], "interface_key string")
    junction = spark.createDataFrame([("Alpha_1_2_Zulu_9", "i#a")], model.JUNCTION)
    index = ReleaseIndex.build(known)
    wide = compat.pivot_compat(signatures(apis, junction, index), index)
    assert wide.columns[3:] == ["alpha1_2zulu9"] and compat.compat_columns(index).count() == 1
    assert {r.id: r[3] for r in wide.collect()} == {"i#a": True, "i#b": False}


def test_search(spark):
    known = rows_of(spark, ("Alpha", "1", "Yankee", "1"), ("Alpha", "2", "Yankee", "1"),
                    ("Alpha", "2", "Yankee", "2"), ("Alpha", "2", "Zulu", "1"), ("Beta", "1", "Yankee", "1"))
    index = ReleaseIndex.build(known)
    alpha = [k for k in index.keys if k.startswith("Alpha")]
    view = ["Alpha_2_Zulu_1", "Beta_1_Yankee_1"]
    ships = {"Win#all": index.keys, "Win#alpha": alpha, "Doc#beta": ["Beta_1_Yankee_1"], "Doc#none": []}
    apis = spark.createDataFrame([(k,) for k in ships], "interface_key string")
    junction = spark.createDataFrame([(r, k) for k, rs in ships.items() for r in rs], model.JUNCTION)
    rows = signatures(apis, junction, index)

    in_view = spark.createDataFrame([(k,) for k in view], "release_key string")

    def found(*spec):
        one = sorted(r.interface_key for r in search.search(rows, index, spec, view).collect())
        many = search.search_many({"x": spec, "other": ("keyword", "beta")}, known, apis, junction, in_view).collect()
        assert sorted(r.interface_key for r in many if r.search == "x") == one
        assert [r.interface_key for r in many if r.search == "other"] == ["Doc#beta"]
        return one

    assert len(search.matching_keys(index, ["a", "1", "y", "1"])) == 1
    assert len(search.matching_keys(index, ["ALPHA"])) == 4
    assert search.match_releases(index.frame, "a", "2").count() == 3
    assert found("in", "alpha") == ["Win#all", "Win#alpha"]
    assert found("notin", "a") == ["Doc#beta", "Doc#none"]
    assert found("count", 1) == ["Doc#beta", "Win#alpha"] and found("count", 0) == ["Doc#none"]
    assert found("keyword", "win#") == ["Win#all", "Win#alpha"]
    assert found() == sorted(ships) == found("and")
    assert found("or", ("keyword", "none"), ("and", ("in", "b"), ("notin", "a"))) == ["Doc#beta", "Doc#none"]
    with pytest.raises(search.NoReleasesMatch):
        search.compile_spec(("in", "gamma"), index)
    assert found("and", ("or", ("in", "beta"), ("count", 1)), ("or", ("keyword", "doc"), ("count", 2))) == ["Doc#beta", "Win#all"]
    assert found("or") == []
    with pytest.raises(Exception, match="no releases match gamma"):
        search.search_many({"x": ("in", "gamma")}, known, apis, junction).collect()


def test_grid_of_any_number_of_releases(spark):
    known = rows_of(spark, *[("B", str(i), "OS", "1") for i in range(150)])
    keys = [r.release_key for r in ReleaseIndex.build(known).rows]
    ships = {"x#a": keys[::3], "x#b": keys[::3], "x#c": keys[100:], "x#d": []}
    apis = spark.createDataFrame([(k,) for k in ships], "interface_key string")
    junction = spark.createDataFrame([(r, k) for k, rs in ships.items() for r in rs], model.JUNCTION)
    grid, columns = compat.grid_of(known, apis, junction)
    assert [r.release_key for r in columns.orderBy("pos").collect()] == keys
    assert {r.id: r.data for r in grid.collect()} == {k: [r in rs for r in keys] for k, rs in ships.items()}
    empty, none = compat.grid_of(known.limit(0), apis, junction)
    assert none.count() == 0 and {tuple(r.data) for r in empty.collect()} == {()}


def test_pages_come_from_few_ranges(spark):
    from driftline.operators.ranks import ranked

    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 5000).alias("key"), F.lit(1).alias("place"))
    index = ranked(rows, F.desc("key"))
    assert index.before[-1] == 5000 and len(index.before) > 3
    found = index.page(3000, 25, "pos").collect()
    assert [(r.key, r.pos) for r in found] == [(4999 - p, p) for p in range(3000, 3025)]
    assert index.page(4990, 40).count() == 10 and index.page(5000, 5).count() == 0
    numbered = index.numbered().collect()
    assert sorted((r.pos, r.key) for r in numbered) == [(p, 4999 - p) for p in range(5000)]
    assert index.numbered().columns == ["id", "key", "place", "pos"]
    assert ranked(rows.limit(0), "key").page(0, 10).count() == 0
