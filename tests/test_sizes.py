"""Tables whose files are far smaller than their rows, and what the graphs are derived from."""

import json
import os

import pytest
from pyspark.sql import functions as F

from driftline import session
from driftline.operators import extract
from driftline.operators import graph as og
from driftline.operators.rounds import Rounds
from driftline.plans import file_queries, graph_binding, graph_queries
from driftline.sources.object_graph import GraphFiles, read_object_graphs

GRAPH = "part-00000-0123456789abcdef-0123456789abcdef-c000.json"


def broadcasts(df):
    """Whether the planner would send a side of a join, by the sizes it knows beforehand."""
    return "BroadcastHashJoin" in df._jdf.queryExecution().sparkPlan().toString()


def other_of(spark):
    return spark.createDataFrame([(GRAPH, 1)], "graph_id string, child bigint")


def repeated(spark, n):
    return spark.range(n).select(F.lit(GRAPH).alias("graph_id"), F.col("id").bitwiseAND(7).alias("node"))


def test_tables_that_files_make_small_are_not_sent(spark):
    large, other = repeated(spark, 300_000), other_of(spark)
    assert broadcasts(other.join(session.cut_lineage(large, "plain"), "graph_id"))
    table, rows = session.cut_sized_and_count(large, "sized")
    assert rows == table.count() == 300_000
    assert not broadcasts(other.join(table.where("node = 1"), "graph_id"))
    assert broadcasts(other.join(session.cut_sized(repeated(spark, 9), "sized"), "graph_id"))


def test_rounds_know_their_sizes(spark):
    rounds = Rounds(spark, "sized")
    assert rounds.add(repeated(spark, 300_000), 0) == 300_000 and rounds.add(repeated(spark, 2), 1) == 2
    other = other_of(spark)
    assert not broadcasts(other.join(rounds.table(), "graph_id"))
    assert not broadcasts(other.join(rounds.due(0), "graph_id")) and broadcasts(other.join(rounds.due(1), "graph_id"))


def test_parts_of_graph_files_know_their_sizes(spark, tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"window_B_{i}_OS_1.json").write_text(json.dumps(
            {"data": {"1": {"a": 6}}, "types": {"null": 6}, "root": 1}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 20)
    try:
        files = GraphFiles(read_object_graphs(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    # Tasks that read have no files of their own: 4 partitions, and a few tags.
    assert len(files.part("types").inputFiles()) <= 4 * 4
    assert files.part("types").count() == 40 and files.bytes["types"] > 40 * 32
    join = lambda: files.part("data").join(files.part("types").select("graph_id"), "graph_id")
    assert broadcasts(join())
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1000)
    assert not broadcasts(join()) and join().count() == 40


@pytest.fixture
def shop(spark, tmp_path):
    """Three parts of one name, of other types; lines of all sorts of quantities."""
    def put(name, rows, columns):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")

    put("part", [(1, "big bolt", "Brand#1", "T", 1), (2, "big bolt", "Brand#1", "U", 2), (3, "big bolt", "Brand#2", "T", 1)],
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int")
    put("supplier", [(1, 3), (2, 3)], "s_suppkey bigint, s_nationkey int")
    put("customer", [(1, 5, "A")], "c_custkey bigint, c_nationkey int, c_mktsegment string")
    put("orders", [(1, 1), (2, None)], "o_orderkey bigint, o_custkey bigint")
    lines = [(1, 1, 7.0, 0.0), (1, 2, 2.0, 0.0), (1, 1, 50.0, 0.1), (1, 2, 50.0, 0.1), (1, 1, 55.0, 0.1), (1, 1, 2.5, 0.1),
             (1, 1, None, None), (2, 1, 1.0, 0.0), (1, 9, 1.0, 0.0)]
    put("lineitem", [(o, p, 1, i, q, d, "R") for i, (o, p, q, d) in enumerate(lines)],
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, "
        "l_returnflag string")
    return str(tmp_path)


def test_bought_members_keep_types_of_whole_quantities_only(spark, shop):
    rows = graph_binding.bought_members(spark, shop).select("nation", "member", "p_type", "p_size", "turn").collect()
    one = (5, "big_bolt_Brand1")
    assert sorted(map(tuple, rows), key=str) == sorted(
        [(*one, None, None, 2.0), (*one, "T", 1, 50.0), (*one, "U", 2, 50.0), (*one, None, None, 0.0), (*one, None, None, 2.5),
         (*one, None, None, None)], key=str)


def test_captures_hold_brands_and_parts(spark, shop):
    rows = {r.s_suppkey: r for r in file_queries.captures(spark, shop).collect()}
    data = rows[1].data
    assert data["2001"] == {"+constructor+": 1001, "big_bolt": 6} and data["1001"] == {"prototype": 2001}
    assert data["111"] == {"+constructor+": 110, "big-bolt": 6} and data["100"]["Brand1"] == 1001
    assert rows[1].functions["1001"] == "Brand1" and "2001" not in rows[2].data


def test_members_that_repeat_count_once_for_each_link(spark):
    members = spark.createDataFrame(
        [("g", 1, "a"), ("g", 1, "a"), ("g", 1, "b"), ("g", 2, "a"), ("g", 2, "a"), ("g", 3, "a"), ("g", 3, "a")],
        "graph_id string, node bigint, name string")
    protos = spark.createDataFrame(
        [("g", 1, 9), ("g", 2, 9), ("g", 2, 8), ("g", 2, 8)], "graph_id string, node bigint, proto bigint")
    shown = spark.createDataFrame([("g", 9, "a")], "graph_id string, proto bigint, name string")
    graphs = og.ObjectGraphs(None, None, protos, None, None, None, None)
    found = og.without_inherited(members, graphs, shown).collect()
    assert sorted(map(tuple, found)) == [("g", 1, "b"), ("g", 2, "a"), ("g", 2, "a"), ("g", 3, "a")]


def test_members_of_instances_are_not_dealt_out_for_classes(spark, shop):
    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").write.parquet(f"{shop}/region.parquet")
    spark.createDataFrame(
        [(3, "N3", 0), (5, "N5", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{shop}/nation.parquet")
    graphs = graph_binding.object_graphs(spark, shop)
    done = extract.run(graphs)
    nodes = {row.node for row in done.class_members.select("node").distinct().collect()}
    every = {row.node for row in og.class_apis(graphs, graph_queries.RULES).select("node").distinct().collect()}
    assert max(every) > graph_binding.SUPPLIER > max(nodes)
    plan = graph_queries.apis_from_ctor_or_lib(spark, shop)._jdf.queryExecution().sparkPlan().toString()
    assert "class-like" in plan


def test_documents_are_numbered_in_graph_tables(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"window_B_{i}_OS_1.json").write_text(json.dumps({
            "data": {"1": {"a": 6, "b": 2}, "2": {}}, "types": {"null": 6}, "root": 1,
            "environment": {"browser": {"name": "B", "version": f"v{i}"}, "platform": {"name": "OS", "version": "1"}}}))
    files = GraphFiles(read_object_graphs(spark, str(tmp_path)), numbered=True)
    assert {files.part(tag).schema["graph_id"].dataType.typeName() for tag in ("data", "types", "file")} == {"long"}
    info = {row.graph_id: row.browser_version for row in files.release_info().collect()}
    assert sorted(info.values()) == ["v0", "v1", "v2"]
    members = files.part("data").where("key IS NOT NULL").collect()
    assert sorted((info[m.graph_id], m.id, m.key, m.value) for m in members) == [
        (f"v{i}", "1", key, value) for i in range(3) for key, value in (("a", "6"), ("b", "2"))]
    assert {row.id for row in files.part("file").collect()} == {f"window_B_{i}_OS_1.json" for i in range(3)}


def test_lines_of_captures_are_dealt_once(spark, shop):
    plan = file_queries.captures(spark, shop)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2  # lines, suppliers
    assert plan.count("FileScan parquet [l_partkey") == 1


def test_each_capture_is_a_file_and_none_has_another_beside_it(spark, shop):
    folder = os.path.dirname(file_queries.captured_files(spark, shop).inputFiles()[0].removeprefix("file:"))
    names = os.listdir(folder)
    assert len([n for n in names if n.endswith(".json")]) == 2 and not [n for n in names if n.endswith(".json.crc")]


def test_catalogs_meet_names_before_members(spark, shop):
    """As by owner: each owner's members, under all its names."""
    done = extract.run(GraphFiles(file_queries.captured_files(spark, shop), numbered=True).graphs().settled())
    by_owner = done.members.select("graph_id", "owner", "api").distinct().join(
        done.owners.names, ["graph_id", "owner"]).select("graph_id", "name", "api").distinct()
    found = done.catalog()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, by_owner.collect())) and found.count() > 10
