"""Catalog extraction, stage by stage, on the derived object graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import extract, postprocess
from driftline.operators import graph as og
from driftline.operators.graph import G, NameRules, ObjectGraphs
from driftline.plans.graph_binding import GRAPH, bought_members, nations, object_graphs
from driftline.plans.registry import query

RULES = NameRules()


def _names(graphs: ObjectGraphs) -> og.Names:
    return og.Names(graphs, og.reachable_from_root(graphs), RULES)


def _extraction(spark: SparkSession, folder: str) -> extract.Extraction:
    return extract.run(object_graphs(spark, folder))


@query(GRAPH + "SELECT graph_id, node, name, builtin, child FROM named_edges")
def object_graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return object_graphs(spark, folder).edges.select(G, "node", "name", "builtin", "child")


@query(GRAPH + "SELECT graph_id, node, proto FROM ctor_like")
def ctor_like(spark: SparkSession, folder: str) -> DataFrame:
    return og.ctor_like(object_graphs(spark, folder)).select(G, "node", "proto")


@query(GRAPH + "SELECT graph_id, node FROM function_like")
def function_like(spark: SparkSession, folder: str) -> DataFrame:
    return og.function_like(object_graphs(spark, folder))


@query(GRAPH + "SELECT graph_id, node FROM reachable")
def reachable_from_root(spark: SparkSession, folder: str) -> DataFrame:
    return og.reachable_from_root(object_graphs(spark, folder))


@query(GRAPH + "SELECT graph_id, node, name FROM function_names")
def function_names(spark: SparkSession, folder: str) -> DataFrame:
    return _names(object_graphs(spark, folder)).function_names()


@query(GRAPH + "SELECT graph_id, node, name FROM guessed_names")
def names_from_proto(spark: SparkSession, folder: str) -> DataFrame:
    return _names(object_graphs(spark, folder)).names_from_proto()


@query(GRAPH + "SELECT graph_id, node, name FROM class_names")
def class_names(spark: SparkSession, folder: str) -> DataFrame:
    names = _names(object_graphs(spark, folder))
    return names.class_names(names.function_names())


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'click'
  WHEN 'error' THEN '' ELSE event_type END AS name FROM events""")
def name_from_tostring(spark: SparkSession, folder: str) -> DataFrame:
    """Event types dressed up as object descriptions, some of them malformed."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", "[object viewPrototype]")
        .when(kind == "click", "[object clickConstructor]")
        .when(kind == "error", "function error() {}")
        .otherwise(F.concat(F.lit("[object "), kind, F.lit("]")))
    )
    return events.select("event_id", og.name_from_tostring(text).alias("name"))


@query(GRAPH + "SELECT graph_id, node, name FROM libraries")
def libraries(spark: SparkSession, folder: str) -> DataFrame:
    graphs = object_graphs(spark, folder)
    names = _names(graphs)
    return og.libraries(graphs, names.class_names(names.function_names()))


@query(GRAPH + "SELECT graph_id, proto, owner FROM first_claims")
def proto_owners(spark: SparkSession, folder: str) -> DataFrame:
    graphs = object_graphs(spark, folder)
    return extract.first_claims(extract.owners(graphs, RULES))


@query(GRAPH + "SELECT graph_id, proto, owner FROM claims")
def hidden_proto_owners(spark: SparkSession, folder: str) -> DataFrame:
    graphs = object_graphs(spark, folder)
    return extract.proto_claims(extract.owners(graphs, RULES), og.proto_forest(graphs))


@query(GRAPH + "SELECT graph_id, node, name FROM class_apis")
def class_apis(spark: SparkSession, folder: str) -> DataFrame:
    return og.class_apis(object_graphs(spark, folder), RULES)


@query(GRAPH + "SELECT graph_id, node, name FROM constants")
def is_constant(spark: SparkSession, folder: str) -> DataFrame:
    return og.constants(object_graphs(spark, folder), RULES)


@query(GRAPH + "SELECT graph_id, node, name FROM instance_apis")
def instance_apis(spark: SparkSession, folder: str) -> DataFrame:
    return og.instance_apis(object_graphs(spark, folder))


@query(GRAPH + "SELECT graph_id, node, ancestor, CAST(depth AS INTEGER) AS depth FROM chains")
def proto_chain(spark: SparkSession, folder: str) -> DataFrame:
    graphs = object_graphs(spark, folder)
    return og.proto_forest(graphs).chains(graphs.nodes)


@query(GRAPH + """SELECT i.graph_id, i.node, i.name FROM inherited i JOIN chains c
  ON c.graph_id = i.graph_id AND c.node = i.node AND c.depth = 1""")
def inherited_apis(spark: SparkSession, folder: str) -> DataFrame:
    """What each object's prototypes show on its behalf."""
    graphs = object_graphs(spark, folder)
    shown = og.shown_by_prototypes(graphs, og.class_apis(graphs, RULES, og.prototypes(graphs)))
    return og.inherited(graphs.nodes, graphs, shown)


@query(GRAPH + "SELECT graph_id, owner, api, source FROM from_ctors")
def apis_from_ctor_or_lib(spark: SparkSession, folder: str) -> DataFrame:
    graphs = object_graphs(spark, folder)
    found = extract.owners(graphs, RULES)
    return extract.apis_from_ctors(found, og.class_apis(graphs, RULES, og.class_like(graphs)))


@query(GRAPH + "SELECT graph_id, owner, api, source FROM from_protos")
def apis_from_proto(spark: SparkSession, folder: str) -> DataFrame:
    done = _extraction(spark, folder)
    return extract.apis_from_protos(done.claims, done.class_members, done.graphs, done.shown)


@query(GRAPH + "SELECT graph_id, owner, api, source FROM from_instances")
def apis_from_instances(spark: SparkSession, folder: str) -> DataFrame:
    done = _extraction(spark, folder)
    return done.members.where("stage = 2").select(G, "owner", "api", "source")


@query(GRAPH + "SELECT graph_id, interface_name, api_name FROM catalog")
def assemble_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return _extraction(spark, folder).catalog()


@query(GRAPH + """SELECT graph_id, owner, api, source FROM members QUALIFY row_number() OVER (
  PARTITION BY graph_id, owner, api ORDER BY stage DESC, start DESC, depth, source) = 1""")
def api_provenance(spark: SparkSession, folder: str) -> DataFrame:
    return _extraction(spark, folder).provenance()


@query(GRAPH + """SELECT graph_id, interface_name, api_name FROM catalog WHERE interface_name <> 'window'""")
def extract_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The whole extraction with the default corrections."""
    return extract.extract_catalog(object_graphs(spark, folder))


# Corrections, on a catalog of what each nation bought


CORRECT = GRAPH + """,
bought_catalog AS (
  SELECT DISTINCT graph_id, n_name AS interface_name, member AS api_name FROM bought
  UNION SELECT DISTINCT graph_id, 'window', n_name FROM nations)
"""


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    nation = nations(spark, folder).select(G, "nation", "n_name")
    bought = bought_members(spark, folder).join(nation, "nation")
    own = bought.select(G, F.col("n_name").alias("interface_name"), F.col("member").alias("api_name")).distinct()
    return own.unionByName(
        nation.select(G, F.lit("window").alias("interface_name"), F.col("n_name").alias("api_name")))


def _corrected(spark: SparkSession, folder: str, *processors: postprocess.PostProcessor) -> DataFrame:
    graphs = object_graphs(spark, folder)
    catalog = _catalog(spark, folder)
    for processor in processors:
        catalog = processor(catalog, graphs)
    return catalog


@query(CORRECT + """SELECT * FROM bought_catalog UNION SELECT graph_id, 'Object', api_name
  FROM bought_catalog WHERE interface_name = 'NATION_0'""")
def copy_to_prototype(spark: SparkSession, folder: str) -> DataFrame:
    graphs = object_graphs(spark, folder)
    return postprocess.copy_to_prototype("NATION_0")(_catalog(spark, folder), graphs)


@query(CORRECT + """SELECT * FROM bought_catalog UNION SELECT graph_id, 'NATION_7', api_name
  FROM bought_catalog WHERE interface_name = 'NATION_2'""")
def copy_to_interface(spark: SparkSession, folder: str) -> DataFrame:
    return _corrected(spark, folder, postprocess.copy_to_interface("NATION_2", "NATION_7"))


@query(CORRECT + "SELECT * FROM bought_catalog WHERE interface_name NOT IN ('NATION_1', 'NATION_9', 'window')")
def remove_interfaces(spark: SparkSession, folder: str) -> DataFrame:
    return _corrected(spark, folder, postprocess.remove_interfaces(["NATION_1", "NATION_9", "window"]))


@query(CORRECT + """SELECT * FROM bought_catalog
  WHERE NOT (interface_name IN ('NATION_3', 'NATION_4') AND regexp_matches(api_name, '^(red|small)_'))""")
def remove_apis(spark: SparkSession, folder: str) -> DataFrame:
    return _corrected(spark, folder, postprocess.remove_apis(["NATION_3", "NATION_4"], "^(red|small)_"))


@query(CORRECT + """SELECT * FROM bought_catalog UNION ALL
  SELECT graph_id, 'Added', api FROM regions, (VALUES ('one'), ('two')) t(api)""")
def add_apis(spark: SparkSession, folder: str) -> DataFrame:
    return _corrected(spark, folder, postprocess.add_apis("Added", ["one", "two"]))


@query(CORRECT + "SELECT * FROM bought_catalog WHERE interface_name <> 'window'")
def remove_root_aliases(spark: SparkSession, folder: str) -> DataFrame:
    return _corrected(spark, folder, postprocess.remove_root_aliases())
