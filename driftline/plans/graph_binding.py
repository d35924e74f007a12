"""Object graphs derived from the driver tables: one graph per region.

Nations are constructors, market segments are libraries and suppliers are instances;
parts bought or supplied give them their members. Within a region, two nations at a time
share a nameless prototype that derives from the region's first nation.
"""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache, partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.operators.graph import G, ObjectGraphs
from driftline.plans.bindings import table
from driftline.session import cut_sized, together

ROOT, OBJECT, OBJECT_PROTO, FUNCTION, FUNCTION_PROTO = 100, 101, 102, 103, 104
CTOR, PROTO, HIDDEN, MIDDLE, LIB, LIB_PROTO, SUPPLIER = 1000, 2000, 3000, 4000, 5000, 6000, 1000000
NUMBER, STRING, NULL = 3, 4, 6
TYPES = {"undefined": 1, "boolean": 2, "number": 3, "string": 4, "symbol": 5, "null": 6, "exception": 7}


def nations(spark: SparkSession, folder: str) -> DataFrame:
    """``graph_id, nation, n_name, hidden, partner, first``; few rows, one per nation.

    ``hidden`` is the smaller nation of the pair (null for the first nation), ``partner``
    the name of the larger one in odd pairs.
    """
    named = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by_key = Window.partitionBy("r_name").orderBy("n_nationkey")
    ranked = named.select(
        F.col("r_name").alias(G), F.col("n_nationkey").alias("nation"), "n_name",
        (F.row_number().over(by_key) - 1).alias("rank"), F.min("n_nationkey").over(
            Window.partitionBy("r_name")).alias("first"),
    )
    pair = F.floor((F.col("rank") + 1) / 2)
    members = Window.partitionBy(G, "pair")
    return ranked.withColumn("pair", pair).select(
        G, "nation", "n_name", "first", "pair",
        F.when(F.col("rank") > 0, F.min("nation").over(members)).alias("hidden"),
        F.when(F.pmod("pair", F.lit(2)) == 1, F.max_by("n_name", "nation").over(members)).alias("partner"),
    )


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """``c_mktsegment, segment``: segments numbered by name."""
    names = table(spark, folder, "customer").select("c_mktsegment").distinct()
    number = F.row_number().over(Window.orderBy("c_mktsegment")) - 1
    return names.withColumn("segment", number)


def _member() -> Column:
    return F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.regexp_replace("p_brand", "#", ""))


def bought_members(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct members of bought parts, by nation, segment and turn.

    A turn is a quantity of 50, which alone tells of the part's type and size, or a quantity modulo 5.
    Orders find their buyers before the lines come in, so that these are dealt in few columns.
    """
    quantity = F.col("l_quantity")
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", F.when(quantity == 50, quantity).otherwise(quantity % 5).alias("turn"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    buyers = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("nation"), "c_mktsegment")
    parts = table(spark, folder, "part").select("p_partkey", _member().alias("member"), "p_type", "p_size")
    bought = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "nation", "c_mktsegment")
    whole = F.col("turn") == 50
    return (
        lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("nation", "c_mktsegment", "l_partkey", "turn")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("nation", "c_mktsegment", "member", F.when(whole, F.col("p_type")).alias("p_type"),
                F.when(whole, F.col("p_size")).alias("p_size"), "turn").distinct()
    )


def supplied_members(spark: SparkSession, folder: str) -> DataFrame:
    """Members of shipped parts: offered at a discount by a supplier, or on its nation's middle prototype.

    They repeat; members and suppliers repeat in the graphs' edges as well, and go there once.
    """
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_partkey", (F.col("l_discount") > 0.045).alias("offered"))
    parts = table(spark, folder, "part").select("p_partkey", _member().alias("member"))
    suppliers = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("s_suppkey", "nation", "member", "offered")
    )


def _rows(source: DataFrame, *entries: tuple[str, str, str, str]) -> DataFrame:
    """``graph_id, node, key, child`` for every entry (condition, node, key, child) that holds."""
    made = ", ".join(
        f"IF({condition}, named_struct('node', CAST({node} AS BIGINT), 'key', {key}, "
        f"'child', CAST({child} AS BIGINT)), NULL)"
        for condition, node, key, child in entries
    )
    return source.selectExpr(G, f"inline(filter(array({made}), e -> e IS NOT NULL))")


def _together(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _state(spark: SparkSession, folder: str) -> int:
    """A digest of the source files' paths, sizes and times."""
    files = reduce(DataFrame.unionByName, [
        spark.read.parquet(f"{folder}/{name}.parquet").select(
            "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        for name in SOURCES
    ]).distinct()
    return files.agg(F.sum(F.xxhash64(*files.columns) % (1 << 40)).alias("state")).first().state or 0


def object_graphs(spark: SparkSession, folder: str) -> ObjectGraphs:
    """The derived graph tables, written once per application and state of the source files, as
    captured graphs would be.

    Every shipment counts: its quantity, modulo 5, says which object gets the part as a member.
    """
    return _object_graphs(spark, spark.sparkContext.applicationId, folder, _state(spark, folder))


@lru_cache(maxsize=4)
def _object_graphs(spark: SparkSession, application: str, folder: str, state: int) -> ObjectGraphs:
    sources = {
        "nations": nations(spark, folder),
        "segments": segments(spark, folder),
        "bought": bought_members(spark, folder),
    }
    nation, segment, bought = together(*[
        partial(cut_sized, rows, name) for name, rows in sources.items()])
    regions = table(spark, folder, "region").select(F.col("r_name").alias(G))
    bought = bought.join(nation, "nation").join(segment, "c_mktsegment")
    supplied = supplied_members(spark, folder).join(nation.select(G, "nation"), "nation")
    supplier = table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("nation"))
    supplier = supplier.withColumn(
        "segment", F.pmod("s_suppkey", segment.agg(F.count("*").alias("n")).scalar()))
    # One row per region and segment: a segment number repeats in every region.
    names = regions.agg(F.collect_list(G).alias("names")).scalar()
    lib = segment.select("*", F.explode(names).alias(G))
    ctor, proto, middle = (f"{start} + nation" for start in (CTOR, PROTO, MIDDLE))
    hidden = f"{HIDDEN} + hidden"
    seg, base, one = f"{LIB} + segment", f"{LIB_PROTO} + segment", f"{SUPPLIER} + s_suppkey"
    layered, poor, shared = "(segment % 2 = 0)", "s_acctbal < 1000", "(hidden IS NOT NULL)"
    fixed = [
        (ROOT, "window", ROOT), (ROOT, "Object", OBJECT), (ROOT, "Function", FUNCTION),
        (OBJECT, "prototype", OBJECT_PROTO), (OBJECT, "length", NUMBER), (OBJECT, "name", STRING),
        (OBJECT_PROTO, "+constructor+", OBJECT), (OBJECT_PROTO, "+toString+", NULL),
        (OBJECT_PROTO, "+valueOf+", NULL), (FUNCTION, "prototype", FUNCTION_PROTO),
        (FUNCTION, "length", NUMBER), (FUNCTION_PROTO, "apply", NULL), (FUNCTION_PROTO, "call", NULL),
        (FUNCTION_PROTO, "length", NUMBER), (FUNCTION_PROTO, "name", STRING),
    ]
    edges = _together(
        _rows(regions, *[("true", str(n), f"'{key}'", str(child)) for n, key, child in fixed]),
        _rows(
            nation,
            ("true", f"{ROOT}", "n_name", ctor), ("true", ctor, "'prototype'", proto),
            ("true", ctor, "'length'", f"{NUMBER}"), ("true", ctor, "'name'", f"{STRING}"),
            ("true", proto, "'+constructor+'", ctor),
        ),
        _rows(
            bought,
            ("turn = 50", ctor, "concat(lower(p_type), '_kind')", f"{NULL}"),
            ("turn = 50", proto, "p_type", f"{NUMBER}"),
            ("turn = 50", proto, "CAST(p_size AS STRING)", f"{NUMBER}"),
            (f"turn % 5 IN (0, 4) OR turn % 5 = 1 AND NOT {shared}", proto, "member", f"{NULL}"),
            (f"turn % 5 = 1 AND {shared}", hidden, "member", f"{NULL}"),
            (f"turn % 5 = 2 OR turn % 5 = 3 AND NOT {layered}", seg, "member", f"{NULL}"),
            (f"turn % 5 = 3 AND {layered}", base, "member", f"{NULL}"),
        ),
        _rows(supplied, ("offered", one, "member", f"{NULL}"), ("NOT offered", middle, "member", f"{NULL}")),
        _rows(lib, ("true", f"{ROOT}", "c_mktsegment", seg)),
        _rows(supplier, ("true", seg, "concat('sup_', s_suppkey)", one)),
    ).distinct()
    protos = _together(
        _rows(regions, ("true", f"{OBJECT}", "''", f"{FUNCTION_PROTO}"),
              ("true", f"{FUNCTION}", "''", f"{FUNCTION_PROTO}"),
              ("true", f"{FUNCTION_PROTO}", "''", f"{OBJECT_PROTO}")),
        _rows(nation, ("true", ctor, "''", f"{FUNCTION_PROTO}"),
              ("true", proto, "''", f"coalesce({hidden}, {OBJECT_PROTO})"),
              ("true", middle, "''", proto), ("hidden = nation", hidden, "''", f"{PROTO} + first")),
        _rows(lib, ("true", seg, "''", f"IF({layered}, {base}, {OBJECT_PROTO})"),
              (layered, base, "''", f"{OBJECT_PROTO}")),
        _rows(supplier, ("true", one, "''", f"IF({poor}, {middle}, {proto})")),
    ).withColumnRenamed("child", "proto")
    text = "IF(partner IS NULL, '[object Hidden]', concat('[object ', partner, 'Prototype]'))"
    strings = _together(
        _rows(regions, ("true", f"{ROOT}", "'[object Window]'", "0")),
        _rows(nation, ("hidden = nation", hidden, text, "0")),
        _rows(supplier, ("true", one, "'[object Object]'", "0")),
    )
    functions = _together(
        _rows(regions, ("true", f"{OBJECT}", "'Object'", "0"), ("true", f"{FUNCTION}", "'Function'", "0")),
        _rows(nation, ("true", ctor, "concat('fn_', n_name)", "0")),
    )
    meta = _rows(bought, ("turn = 50", proto, "p_type", "1"))
    graphs = ObjectGraphs.build(
        nodes=None, edges=edges, protos=protos, meta=meta.withColumnRenamed("child", "is_value"),
        functions=functions.withColumnRenamed("key", "name"),
        strings=strings.withColumnRenamed("key", "text"),
        types=_rows(regions, *[("true", str(number), f"'{name}'", "0") for name, number in TYPES.items()])
        .withColumnRenamed("key", "type_name"),
        roots=regions.select(G, F.lit(ROOT).cast("long").alias("root")),
    ).settled()
    # From the written edges, which are not derived again for it.
    nodes = graphs.edges.select(G, "node").unionByName(protos.select(G, "node")).distinct()
    return replace(graphs, nodes=cut_sized(nodes, "graph-nodes"))


GRAPH = f"""
WITH RECURSIVE named_nations AS (
  SELECT r_name AS graph_id, n_nationkey AS nation, n_name,
    row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS rank,
    min(n_nationkey) OVER (PARTITION BY r_name) AS first
  FROM nation JOIN region ON n_regionkey = r_regionkey),
nations AS (
  SELECT *, CASE WHEN rank > 0 THEN min(nation) OVER (PARTITION BY graph_id, (rank + 1) // 2) END AS hidden,
    CASE WHEN ((rank + 1) // 2) % 2 = 1
      THEN max_by(n_name, nation) OVER (PARTITION BY graph_id, (rank + 1) // 2) END AS partner
  FROM named_nations),
regions AS (SELECT r_name AS graph_id FROM region),
segments AS (
  SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS segment
  FROM (SELECT DISTINCT c_mktsegment FROM customer)),
libs AS (SELECT graph_id, c_mktsegment, segment FROM regions, segments),
parts AS (
  SELECT p_partkey, p_type, p_size, replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '') AS member
  FROM part),
bought AS (
  SELECT n.*, c_mktsegment, segment, member, p_type, p_size, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nations n ON n.nation = c_nationkey JOIN parts ON l_partkey = p_partkey
  JOIN segments USING (c_mktsegment)),
suppliers AS (
  SELECT n.*, s_suppkey, s_acctbal FROM supplier JOIN nations n ON n.nation = s_nationkey),
supplied AS (
  SELECT s.*, member, l_discount FROM lineitem JOIN suppliers s ON l_suppkey = s_suppkey
  JOIN parts ON l_partkey = p_partkey),
edges AS (
  SELECT graph_id, {ROOT} AS node, 'window' AS key, {ROOT} AS child FROM regions
  UNION SELECT graph_id, {ROOT}, 'Object', {OBJECT} FROM regions
  UNION SELECT graph_id, {ROOT}, 'Function', {FUNCTION} FROM regions
  UNION SELECT graph_id, {OBJECT}, 'prototype', {OBJECT_PROTO} FROM regions
  UNION SELECT graph_id, {OBJECT}, 'length', 3 FROM regions
  UNION SELECT graph_id, {OBJECT}, 'name', 4 FROM regions
  UNION SELECT graph_id, {OBJECT_PROTO}, '+constructor+', {OBJECT} FROM regions
  UNION SELECT graph_id, {OBJECT_PROTO}, '+toString+', 6 FROM regions
  UNION SELECT graph_id, {OBJECT_PROTO}, '+valueOf+', 6 FROM regions
  UNION SELECT graph_id, {FUNCTION}, 'prototype', {FUNCTION_PROTO} FROM regions
  UNION SELECT graph_id, {FUNCTION}, 'length', 3 FROM regions
  UNION SELECT graph_id, {FUNCTION_PROTO}, 'apply', 6 FROM regions
  UNION SELECT graph_id, {FUNCTION_PROTO}, 'call', 6 FROM regions
  UNION SELECT graph_id, {FUNCTION_PROTO}, 'length', 3 FROM regions
  UNION SELECT graph_id, {FUNCTION_PROTO}, 'name', 4 FROM regions
  UNION SELECT graph_id, {ROOT}, n_name, {CTOR} + nation FROM nations
  UNION SELECT graph_id, {CTOR} + nation, 'prototype', {PROTO} + nation FROM nations
  UNION SELECT graph_id, {CTOR} + nation, 'length', 3 FROM nations
  UNION SELECT graph_id, {CTOR} + nation, 'name', 4 FROM nations
  UNION SELECT graph_id, {PROTO} + nation, '+constructor+', {CTOR} + nation FROM nations
  UNION SELECT graph_id, {CTOR} + nation, lower(p_type) || '_kind', 6 FROM bought WHERE l_quantity = 50
  UNION SELECT graph_id, {PROTO} + nation, p_type, 3 FROM bought WHERE l_quantity = 50
  UNION SELECT graph_id, {PROTO} + nation, CAST(p_size AS VARCHAR), 3 FROM bought WHERE l_quantity = 50
  UNION SELECT graph_id, {PROTO} + nation, member, 6 FROM bought
    WHERE l_quantity % 5 IN (0, 4) OR l_quantity % 5 = 1 AND hidden IS NULL
  UNION SELECT graph_id, {HIDDEN} + hidden, member, 6 FROM bought WHERE l_quantity % 5 = 1 AND hidden IS NOT NULL
  UNION SELECT graph_id, {ROOT}, c_mktsegment, {LIB} + segment FROM libs
  UNION SELECT graph_id, {LIB} + segment, member, 6 FROM bought
    WHERE l_quantity % 5 = 2 OR l_quantity % 5 = 3 AND segment % 2 <> 0
  UNION SELECT graph_id, {LIB_PROTO} + segment, member, 6 FROM bought WHERE l_quantity % 5 = 3 AND segment % 2 = 0
  UNION SELECT graph_id, {LIB} + s_suppkey % (SELECT count(*) FROM segments), 'sup_' || s_suppkey,
    {SUPPLIER} + s_suppkey FROM suppliers
  UNION SELECT graph_id, {SUPPLIER} + s_suppkey, member, 6 FROM supplied WHERE l_discount > 0.045
  UNION SELECT graph_id, {MIDDLE} + nation, member, 6 FROM supplied WHERE l_discount <= 0.045),
protos AS (
  SELECT graph_id, {OBJECT} AS node, {FUNCTION_PROTO} AS proto FROM regions
  UNION SELECT graph_id, {FUNCTION}, {FUNCTION_PROTO} FROM regions
  UNION SELECT graph_id, {FUNCTION_PROTO}, {OBJECT_PROTO} FROM regions
  UNION SELECT graph_id, {CTOR} + nation, {FUNCTION_PROTO} FROM nations
  UNION SELECT graph_id, {PROTO} + nation, coalesce({HIDDEN} + hidden, {OBJECT_PROTO}) FROM nations
  UNION SELECT graph_id, {HIDDEN} + hidden, {PROTO} + first FROM nations WHERE hidden IS NOT NULL
  UNION SELECT graph_id, {MIDDLE} + nation, {PROTO} + nation FROM nations
  UNION SELECT graph_id, {LIB} + segment, CASE WHEN segment % 2 = 0 THEN {LIB_PROTO} + segment
    ELSE {OBJECT_PROTO} END FROM libs
  UNION SELECT graph_id, {LIB_PROTO} + segment, {OBJECT_PROTO} FROM libs WHERE segment % 2 = 0
  UNION SELECT graph_id, {SUPPLIER} + s_suppkey,
    CASE WHEN s_acctbal < 1000 THEN {MIDDLE} + nation ELSE {PROTO} + nation END FROM suppliers),
functions AS (
  SELECT graph_id, {OBJECT} AS node, 'Object' AS name FROM regions
  UNION SELECT graph_id, {FUNCTION}, 'Function' FROM regions
  UNION SELECT graph_id, {CTOR} + nation, 'fn_' || n_name FROM nations),
strings AS (
  SELECT graph_id, {ROOT} AS node, '[object Window]' AS text FROM regions
  UNION SELECT graph_id, {HIDDEN} + hidden, CASE WHEN partner IS NULL THEN '[object Hidden]'
    ELSE '[object ' || partner || 'Prototype]' END FROM nations WHERE hidden = nation
  UNION SELECT graph_id, {SUPPLIER} + s_suppkey, '[object Object]' FROM suppliers),
meta AS (SELECT DISTINCT graph_id, {PROTO} + nation AS node, p_type AS name FROM bought WHERE l_quantity = 50),
named_edges AS (
  SELECT graph_id, node, regexp_replace(key, '^\\+(.+)\\+$', '\\1') AS name,
    regexp_matches(key, '^\\+.+\\+$') AS builtin, child FROM edges),
in_links AS (
  SELECT l.* FROM (
    SELECT * FROM named_edges WHERE child > 7
    UNION ALL SELECT graph_id, node, '__proto__', false, proto FROM protos) l),
reachable AS (
  SELECT graph_id, {ROOT} AS node FROM regions
  UNION SELECT l.graph_id, l.child FROM reachable r JOIN in_links l
    ON l.graph_id = r.graph_id AND l.node = r.node),
links AS (
  SELECT l.* FROM in_links l JOIN reachable r USING (graph_id, node) WHERE l.node <> l.child),
ctor_like AS (SELECT graph_id, node, child AS proto FROM named_edges WHERE name = 'prototype'),
function_like AS (
  SELECT graph_id, node FROM ctor_like
  UNION SELECT graph_id, node FROM named_edges WHERE name IN ('arguments', 'length')
    GROUP BY ALL HAVING count(DISTINCT name) = 2),
before_prototype AS (
  SELECT p.graph_id, p.child AS node, x.name, x.child AS via, x.node AS start
  FROM links x JOIN links p ON p.graph_id = x.graph_id AND p.node = x.child AND p.name = 'prototype'
  WHERE x.node <> p.child),
function_names AS (
  SELECT graph_id, child AS node, name FROM links
    WHERE NOT builtin AND name NOT IN ('prototype', '__proto__')
  UNION SELECT b.graph_id, c.child, b.name FROM before_prototype b JOIN links c
    ON c.graph_id = b.graph_id AND c.node = b.node AND c.name = 'constructor'
    WHERE b.name <> '__proto__' AND c.child <> b.via AND c.child <> b.start
  UNION SELECT graph_id, node, name FROM functions),
guessed_names AS (
  SELECT graph_id, node, name FROM before_prototype
  UNION SELECT graph_id, node, name FROM (
    SELECT graph_id, node, regexp_replace(regexp_extract(text,
      '\\[object ([A-Za-z_$][0-9A-Za-z_$]*)\\]', 1), '(Prototype|Constructor)$', '') AS name
    FROM strings) WHERE name NOT IN ('', 'Object')),
class_names AS (
  SELECT e.graph_id, e.node, f.name FROM named_edges e JOIN function_names f
    ON f.graph_id = e.graph_id AND f.node = e.child WHERE e.name = 'constructor'
  UNION SELECT g.* FROM guessed_names g WHERE NOT EXISTS (
    SELECT 1 FROM named_edges e WHERE e.graph_id = g.graph_id AND e.node = g.node
      AND e.name = 'constructor')),
lib_ids AS (
  SELECT graph_id, child AS node, name FROM named_edges e WHERE node = {ROOT} AND child > 7
    AND NOT EXISTS (SELECT 1 FROM function_like f WHERE f.graph_id = e.graph_id AND f.node = e.child)),
libraries AS (
  SELECT * FROM lib_ids UNION SELECT c.* FROM class_names c JOIN lib_ids l USING (graph_id, node)),
first_claims AS (
  SELECT graph_id, proto, node AS owner FROM ctor_like
  UNION SELECT graph_id, node, node FROM lib_ids),
claims AS (
  SELECT * FROM first_claims
  UNION SELECT graph_id, {HIDDEN} + hidden, {CTOR} + nation FROM nations
    WHERE hidden IS NOT NULL AND (hidden = nation OR partner = n_name)
  UNION SELECT graph_id, {LIB_PROTO} + segment, {LIB} + segment FROM libs WHERE segment % 2 = 0),
owner_names AS (
  SELECT graph_id, node AS owner, name FROM function_names JOIN ctor_like USING (graph_id, node)
  UNION SELECT graph_id, node, name FROM libraries),
constants AS (
  SELECT e.graph_id, e.node, e.name FROM named_edges e JOIN meta m USING (graph_id, node, name)
  WHERE child IN (2, 3, 4) AND regexp_matches(e.name, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$')),
class_apis AS (
  SELECT DISTINCT graph_id, node, name FROM named_edges e
  WHERE CASE WHEN node = {OBJECT_PROTO} THEN name <> 'prototype'
      WHEN node IN ({FUNCTION}, {FUNCTION_PROTO}) THEN NOT builtin
      ELSE NOT builtin AND name <> 'prototype' AND NOT regexp_matches(name, '^[0-9]+$') END
    AND (node IN ({FUNCTION}, {FUNCTION_PROTO}) OR NOT EXISTS (SELECT 1 FROM constants c
      WHERE c.graph_id = e.graph_id AND c.node = e.node AND c.name = e.name))),
instance_apis AS (
  SELECT DISTINCT graph_id, node, name FROM named_edges
  WHERE NOT builtin AND NOT regexp_matches(name, '^[0-9]+$')),
chains AS (
  SELECT graph_id, node, proto AS ancestor, 1 AS depth FROM protos
  UNION ALL SELECT c.graph_id, c.node, p.proto, c.depth + 1 FROM chains c JOIN protos p
    ON p.graph_id = c.graph_id AND p.node = c.ancestor),
inherited AS (
  SELECT DISTINCT c.graph_id, c.node, a.name FROM chains c JOIN class_apis a
    ON a.graph_id = c.graph_id AND a.node = c.ancestor),
from_ctors AS (
  SELECT DISTINCT a.graph_id, c.owner, a.name AS api, c.owner AS source
  FROM class_apis a JOIN first_claims c ON c.graph_id = a.graph_id AND c.owner = a.node
  WHERE a.name NOT IN ('arguments', 'name', 'length', 'caller')),
from_protos AS (
  SELECT c.graph_id, c.owner, a.name AS api, c.proto AS source
  FROM claims c JOIN class_apis a ON a.graph_id = c.graph_id AND a.node = c.proto
  WHERE NOT EXISTS (SELECT 1 FROM inherited i WHERE i.graph_id = a.graph_id AND i.node = a.node
    AND i.name = a.name)),
levels AS (
  SELECT graph_id, {SUPPLIER} + s_suppkey AS node, {PROTO} + nation AS proto,
    {SUPPLIER} + s_suppkey AS start, 0 AS depth FROM suppliers
  UNION ALL SELECT n.graph_id, {MIDDLE} + n.nation, {PROTO} + n.nation,
    coalesce((SELECT max({SUPPLIER} + s_suppkey) FROM suppliers s WHERE s.nation = n.nation
      AND s_acctbal < 1000), {MIDDLE} + n.nation),
    CASE WHEN EXISTS (SELECT 1 FROM suppliers s WHERE s.nation = n.nation AND s_acctbal < 1000)
      THEN 1 ELSE 0 END FROM nations n),
from_instances AS (
  SELECT l.graph_id, c.owner, a.name AS api, l.node AS source, l.start, l.depth
  FROM levels l JOIN instance_apis a ON a.graph_id = l.graph_id AND a.node = l.node
  JOIN claims c ON c.graph_id = l.graph_id AND c.proto = l.proto
  WHERE NOT EXISTS (SELECT 1 FROM inherited i WHERE i.graph_id = a.graph_id AND i.node = a.node
    AND i.name = a.name)),
members AS (
  SELECT graph_id, owner, api, source, 0 AS stage, CAST(NULL AS BIGINT) AS start, CAST(NULL AS BIGINT) AS depth FROM from_protos
  UNION ALL SELECT graph_id, owner, api, source, 1, NULL, NULL FROM from_ctors
  UNION ALL SELECT graph_id, owner, api, source, 2, start, depth FROM from_instances),
catalog AS (
  SELECT DISTINCT m.graph_id, o.name AS interface_name, m.api AS api_name
  FROM members m JOIN owner_names o USING (graph_id, owner))
"""
