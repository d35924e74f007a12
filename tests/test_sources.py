import datetime as dt
import json

import pytest

from driftline import model
from driftline.sources import entities
from driftline.sources.catalog import import_catalogs, with_release_date
from driftline.sources.object_graph import read_object_graphs, release_info

HISTORY = {"QQ": {"7.5": "2017-05-08", "7.5.1": "2017-05-18"},
           "Chrome": {"56": "2017-01-25", "5": "2009-01-01", "4.0": "2008-01-01"}}


@pytest.fixture
def history(spark, tmp_path):
    path = tmp_path / "history.json"
    path.write_text(json.dumps(HISTORY, indent=1))
    return entities.read_version_history(spark, str(path))


def dated(spark, history, *pairs, on_unknown="error"):
    versions = spark.createDataFrame(list(pairs), "browser_name string, browser_version string")
    rows = with_release_date(versions, history, on_unknown).collect()
    return {r.browser_version: r.release_date and str(r.release_date) for r in rows}


def test_lookup_order_of_prefixes(history):
    order = [r.version_prefix for r in history.where("browser_name = 'Chrome'").orderBy("rank").collect()]
    assert order == ["5", "56", "4.0"]


def test_release_dates(spark, history):
    found = dated(spark, history, ("QQ", "7.5.1"), ("Chrome", "56.0.2924.87"), ("Chrome", "4.0.1"))
    assert found == {"7.5.1": "2017-05-08", "56.0.2924.87": "2009-01-01", "4.0.1": "2008-01-01"}
    assert dated(spark, history, ("Chrome", "99"), ("None", "1"), on_unknown="null") == {"99": None, "1": None}
    with pytest.raises(Exception, match="no release date"):
        dated(spark, history, ("Chrome", "99"))


def test_import(spark, history):
    rows = [("Chrome", "56.1", "OSX", "10", i, a) for i, a in
            (("W", "F"), ("W", "p"), ("F", "args"), ("F", "caller"), ("F", "caller"))]
    catalogs = spark.createDataFrame(
        rows, "browser_name string, browser_version string, os_name string, os_version string, "
              "interface_name string, api_name string")
    releases, apis, junction = import_catalogs(catalogs, history)
    assert (releases.count(), apis.count(), junction.count()) == (1, 4, 4)
    assert releases.schema.names == model.RELEASES.names
    assert junction.first().release_key == "Chrome_56.1_OSX_10"


def test_entity_files(spark, tmp_path):
    path = tmp_path / "Release.json"
    path.write_text(json.dumps([
        {"browserName": "A", "browserVersion": "1", "osName": "X", "osVersion": "2", "releaseDate": 1483228800000},
        {"browserName": "B", "releaseDate": "2017-01-01T00:00:00.000Z"}, {"browserName": "C"}]))
    rows = entities.source_by_mode(spark, entities.LOCAL, str(tmp_path), "Release", model.RELEASES).collect()
    assert {r.browser_name: r.release_date for r in rows} == {
        "A": dt.date(2017, 1, 1), "B": dt.date(2017, 1, 1), "C": dt.date(1970, 1, 1)}
    path.write_text("[]")
    assert entities.read_entity_json(spark, str(path), model.RELEASES).isEmpty()
    path.write_text('{"browserName": "A"}')
    with pytest.raises(Exception, match="expected a JSON array"):
        entities.read_entity_json(spark, str(path), model.RELEASES).collect()
    path.write_text('[{"browserName": "A"')
    with pytest.raises(Exception):
        entities.read_entity_json(spark, str(path), model.RELEASES).collect()


def test_large_arrays_are_split(spark, tmp_path):
    rows = [(f"r{i}", f'x}},{{"#"}},{{{i % 7}' if i % 3 else f'y\\"}},{{"class":"{i}') for i in range(60_000)]
    records = [{"class": "a.Junction", "releaseKey": r, "interfaceKey": i} for r, i in rows]
    path = tmp_path / "Junction.json"
    path.write_text(json.dumps(records, separators=(",", ":")))
    (tmp_path / "Spaced.json").write_text(json.dumps(records[:50], indent=1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        table = entities.read_entity_json(spark, str(path), model.JUNCTION)
        assert sorted(map(tuple, table.collect())) == sorted(rows)
        assert table.rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spaced = entities.read_entity_json(spark, str(tmp_path / "Spaced.json"), model.JUNCTION)
    assert sorted(map(tuple, spaced.collect())) == sorted(rows[:50])


def test_allow_list():
    allowed = entities.AllowList(hosts=("bucket",), path_prefixes=("/cache/",))
    assert allowed.check("s3a://bucket/cache/x.json")
    for uri in ("https://bucket/cache/x.json", "s3a://other/cache/x.json", "s3a://bucket/x.json",
                "s3a://bucket/cache/../x.json", "ftp://bucket/cache/x.json"):
        with pytest.raises(ValueError):
            allowed.check(uri)
    with pytest.raises(ValueError):
        entities.AllowList().check("hdfs://localhost/elsewhere/x.json")
    with pytest.raises(ValueError):  # web servers can't be listed, whoever allows them
        entities.AllowList(schemes=("https",), path_prefixes=("/",)).check("https://localhost/x.json")


def test_entity_files_on_shared_storage(spark, tmp_path):
    (tmp_path / "Release.json").write_text(json.dumps([{"browserName": "A", "browserVersion": "1"}]))
    allowed = entities.AllowList(schemes=("file",), hosts=("",), path_prefixes=(f"{tmp_path}/",))
    rows = entities.source_by_mode(
        spark, entities.REMOTE, f"file://{tmp_path}", "Release", model.RELEASES, allowed).collect()
    assert [r.browser_name for r in rows] == ["A"]
    with pytest.raises(ValueError):
        entities.source_by_mode(spark, entities.REMOTE, f"file://{tmp_path}", "Release", model.RELEASES)


def test_release_info(spark, tmp_path):
    whole = {"browser": {"name": "Test", "version": "63.0"}, "platform": {"name": "OS", "version": "1"}}
    partial = {"browser": {"name": "Test", "version": ""}, "platform": {"name": "OS", "version": "1"}}
    for name, environment in (("window_Any_Thing.json", whole), ("window_Firefox_53.0_OSX_10.11.json", partial),
                              ("other.json", None), ("my_window_1_2_3.json", None)):
        (tmp_path / name).write_text(json.dumps({"data": {}, "root": 1, "environment": environment}))
    documents = read_object_graphs(spark, str(tmp_path))
    found = {r.graph_id: tuple(r)[1:] for r in release_info(documents).collect()}
    assert found == {
        "window_Any_Thing.json": ("Test", "63.0", "OS", "1"),
        "window_Firefox_53.0_OSX_10.11.json": ("Firefox", "53.0", "OSX", "10.11"),
        "my_window_1_2_3.json": ("window", "1", "2", "3")}
    (tmp_path / "window_malformed.json").write_text("{}")
    documents = read_object_graphs(spark, str(tmp_path))
    assert release_info(documents, "null").where("browser_name IS NULL").count() == 1
    with pytest.raises(Exception, match="malformed graph file name"):
        release_info(documents).collect()


class Session:
    """A session that only knows its settings."""

    def __init__(self, setting, master, known=None):
        self.conf = {} if setting is None else {"spark.checkpoint.dir": setting}
        self.sparkContext = self
        self.master, self.known = master, known

    def getCheckpointDir(self):
        return self.known

    def setCheckpointDir(self, folder):
        self.known = folder


def test_intermediate_tables_go_to_the_configured_folder(spark):
    from driftline.session import cut_and_count, shared_folder

    assert shared_folder(Session("hdfs:///shared", "yarn")) == "hdfs:///shared"
    assert shared_folder(Session(None, "yarn", "hdfs:///other")) == "hdfs:///other"
    assert "driftline-" in shared_folder(Session(None, "local[2]"))
    with pytest.raises(RuntimeError):
        shared_folder(Session(None, "yarn"))
    table, rows = cut_and_count(spark.range(5), "probe")
    assert rows == 5 and table.count() == 5
    folder = shared_folder(spark).removeprefix("file:")
    assert f"{folder}/driftline/{spark.sparkContext.applicationId}/probe-" in table.inputFiles()[0]


def test_import_with_known_releases(spark, history):
    columns = "browser_name string, browser_version string, os_name string, os_version string"
    catalogs = spark.createDataFrame(
        [("Chrome", "56.1", "OSX", "10", "W", "F")], f"{columns}, interface_name string, api_name string")
    known = spark.createDataFrame([("Chrome", "56.1", "OSX", "10")] * 2, columns)
    releases, _, junction = import_catalogs(catalogs, history, releases=known)
    assert [r.browser_version for r in releases.collect()] == ["56.1"] and junction.count() == 1
    assert "W" not in {value for row in releases.collect() for value in row}
