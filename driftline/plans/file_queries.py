"""Captured graph files and entity files, derived from the driver tables, read and imported.

Every supplier is a capture: its release is named by nation and key, its graph has a constructor for
each brand it ships, with the parts as members. Parts also land on a style prototype and on one that
derives from it, some with dashes in their names, so that every default correction has work to do.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import model
from driftline.functions import interface_key, release_key
from driftline.operators import postprocess
from driftline.operators.extract import ExtractorConfig, extract_catalog
from driftline.operators.graph import G, NameRules
from driftline.plans import bindings
from driftline.plans.bindings import table
from driftline.plans.graph_binding import TYPES
from driftline.plans.registry import BOUND, query
from driftline.session import fresh_path
from driftline.sources import entities
from driftline.sources.object_graph import GraphFiles, import_graph_files, read_object_graphs, release_info

ROOT, STYLE2, STYLE2_PROTO, STYLE, STYLE_PROTO, BRAND, BRAND_PROTO = 100, 110, 111, 120, 121, 1000, 2000
HOOK = "__REACT_DEVTOOLS_GLOBAL_HOOK__"
#: Members that every capture has: node, key, child.
FIXED = [
    (ROOT, "window", ROOT), (ROOT, "Object", 101), (ROOT, "Function", 103), (ROOT, "CSS2Properties", STYLE2),
    (ROOT, "CSSStyleDeclaration", STYLE), (ROOT, HOOK, 6),
    (101, "prototype", 102), (101, "length", 3), (101, "name", 4), (102, "+constructor+", 101), (102, "+toString+", 6),
    (103, "prototype", 104), (103, "length", 3), (103, "name", 4),
    (104, "apply", 6), (104, "call", 6), (104, "length", 3), (104, "name", 4),
    (STYLE2, "prototype", STYLE2_PROTO), (STYLE2, "length", 3), (STYLE2_PROTO, "+constructor+", STYLE2),
    (STYLE, "prototype", STYLE_PROTO), (STYLE, "length", 3), (STYLE_PROTO, "+constructor+", STYLE),
]
PROTOS = [(101, 104), (103, 104), (104, 102), (STYLE2, 104), (STYLE, 104), (STYLE2_PROTO, STYLE_PROTO), (STYLE_PROTO, 102)]
FUNCTIONS = [(101, "Object"), (103, "Function"), (STYLE2, "CSS2Properties"), (STYLE, "CSSStyleDeclaration")]


def _shipped(spark: SparkSession, folder: str) -> DataFrame:
    """``s_suppkey, brand, p_name, flag, first``: a row for each line of a part that is known."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("s_suppkey"), "l_partkey", F.col("l_returnflag").alias("flag"),
        (F.col("l_linenumber") == 1).alias("first"))
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.regexp_replace("p_brand", "^Brand#", "").cast("long").alias("brand"),
        "p_name")
    return lines.join(parts, "l_partkey").drop("l_partkey")


def _entries(*entries: tuple[Column | str | int, ...]) -> Column:
    """An array of ``node, key, child``, without the ones whose key is null."""
    def value(v: Column | str | int, kind: str) -> Column:
        return (v if isinstance(v, Column) else F.lit(v)).cast(kind)

    made = [F.struct(value(n, "bigint").alias("node"), value(k, "string").alias("key"), value(c, "bigint").alias("child"))
            for n, k, c in entries]
    return F.filter(F.array(*made), lambda e: e["key"].isNotNull())


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """One row per capture, in the form of the files.

    What is shipped is dealt by supplier once, and put together where it is. Brands go the same way, in
    rows of their own (``key`` is null).
    """
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    name, proto, ctor = F.concat(F.lit("Brand"), "brand"), F.col("brand") + BRAND_PROTO, F.col("brand") + BRAND

    def of_part(part: Column) -> Column:
        flag, plain, dashed = (
            part["flag"], F.replace(part["p_name"], F.lit(" "), F.lit("_")), F.replace(part["p_name"], F.lit(" "), F.lit("-")))
        return _entries(
            (proto, plain, 6), (STYLE2_PROTO, F.when(flag == "R", dashed).when(flag == "A", plain), 6),
            (STYLE_PROTO, F.when((flag == "N") & part["first"], plain), 6))

    by_brand = _shipped(spark, folder).repartition("s_suppkey").groupBy("s_suppkey", "brand").agg(
        F.collect_set(F.struct("p_name", "flag", "first")).alias("parts"))
    brand = F.array(F.struct(
        F.col("brand").alias("node"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("bigint").alias("child")))
    own = _entries((ROOT, name, ctor), (ctor, "prototype", proto), (proto, "+constructor+", ctor))
    entries = by_brand.select(
        "s_suppkey", F.explode(F.concat(brand, own, F.flatten(F.transform("parts", of_part)))).alias("e"))
    fixed_members = supplier.repartition("s_suppkey").select("s_suppkey", F.explode(_entries(*FIXED)).alias("e"))
    edge = F.col("key").isNotNull()
    nodes = entries.unionByName(fixed_members).select("s_suppkey", "e.*").groupBy("s_suppkey", edge.alias("edge"), "node").agg(
        F.map_from_entries(F.collect_set(F.when(edge, F.struct("key", "child")))).alias("members"))
    whole = nodes.groupBy("s_suppkey").agg(
        F.map_from_entries(F.collect_list(F.when(
            F.col("edge"), F.struct(F.col("node").cast("string"), "members")))).alias("data"),
        F.collect_list(F.when(~F.col("edge"), F.col("node"))).alias("brands"))

    def fixed(pairs: list[tuple[int, object]], kind: str) -> Column:
        return F.array(*[F.struct(F.lit(str(n)).alias("id"), F.lit(v).cast(kind).alias("v")) for n, v in pairs])

    def of_brands(value: Column | Callable[[Column], Column], base: int) -> Column:
        return F.transform("brands", lambda b: F.struct(
            (b + base).cast("string").alias("id"), (value(b) if callable(value) else value).alias("v")))

    protos = [of_brands(F.lit(to).cast("bigint"), base) for to, base in ((104, BRAND), (102, BRAND_PROTO))]
    product = lambda n, v: F.struct(n.cast("string").alias("name"), v.cast("string").alias("version"))
    return supplier.join(whole, "s_suppkey").select(
        "s_suppkey", "data",
        F.map_from_entries(F.concat(fixed(PROTOS, "bigint"), *protos)).alias("protos"),
        F.map_from_entries(F.concat(
            fixed(FUNCTIONS, "string"), of_brands(lambda b: F.concat(F.lit("Brand"), b), BRAND))).alias("functions"),
        F.create_map(F.lit(str(ROOT)), F.lit("[object Window]")).alias("toStrings"),
        F.create_map(*[F.lit(x) for name, n in TYPES.items() for x in (name, n)]).alias("types"),
        F.lit(ROOT).alias("root"),
        F.struct(
            product(F.concat(F.lit("B"), "s_nationkey"), F.col("s_suppkey")).alias("browser"),
            product(F.lit("Windows"), F.lit("10")).alias("platform"),
        ).alias("environment"),
    )


def captured_files(spark: SparkSession, folder: str) -> DataFrame:
    """The captures as files, one each, read back; writers name files as they like."""
    path = fresh_path(spark, "captures")
    # Files as many as suppliers are moved to their place by the tasks, not one by one by the driver. On local
    # disks they have no file of checksums beside them: each file costs a process that sets its mode.
    captures(spark, folder).drop("s_suppkey").write.options(**{
        "maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2,
        "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}).json(path)
    return read_object_graphs(spark, path, names="*.json")


CAPTURED = f"""
WITH parts AS (
  SELECT DISTINCT l_suppkey AS s, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS brand,
    replace(p_name, ' ', '_') AS plain, replace(p_name, ' ', '-') AS dashed, l_returnflag AS flag, l_linenumber = 1 AS first
  FROM lineitem JOIN part ON p_partkey = l_partkey),
graphs AS (
  SELECT s_suppkey AS s, 'B' || s_nationkey AS browser_name, CAST(s_suppkey AS VARCHAR) AS browser_version,
    'Windows' AS os_name, '10' AS os_version, 'B' || s_nationkey || '_' || s_suppkey || '_Windows_10' AS release_key
  FROM supplier),
fixed(node, key, child) AS (VALUES {", ".join(f"({n}, '{k}', {c})" for n, k, c in FIXED)}),
edges AS (
  SELECT s, node, key, child FROM graphs, fixed
  UNION SELECT s, {ROOT}, 'Brand' || brand, brand + {BRAND} FROM parts
  UNION SELECT s, brand + {BRAND}, 'prototype', brand + {BRAND_PROTO} FROM parts
  UNION SELECT s, brand + {BRAND_PROTO}, '+constructor+', brand + {BRAND} FROM parts
  UNION SELECT s, brand + {BRAND_PROTO}, plain, 6 FROM parts
  UNION SELECT s, {STYLE2_PROTO}, CASE flag WHEN 'R' THEN dashed ELSE plain END, 6 FROM parts WHERE flag IN ('R', 'A')
  UNION SELECT s, {STYLE_PROTO}, plain, 6 FROM parts WHERE flag = 'N' AND first),
names AS (
  SELECT s, node, regexp_replace(key, '^\\+(.+)\\+$', '\\1') AS name, key LIKE '+%+' AS builtin FROM edges),
language AS (
  SELECT s, interface_name, api_name FROM graphs, (VALUES ('Object', 'constructor'), ('Object', 'toString'),
    ('Function', 'prototype'), ('Function', 'apply'), ('Function', 'call'), ('Function', 'length'), ('Function', 'name')
  ) t(interface_name, api_name)),
branded AS (
  SELECT s, 'Brand' || (node - {BRAND_PROTO}) AS interface_name, name AS api_name FROM names
  WHERE node >= {BRAND_PROTO} AND NOT builtin),
style AS (SELECT DISTINCT s, name FROM names WHERE node = {STYLE_PROTO} AND NOT builtin),
style2 AS (
  SELECT DISTINCT s, name FROM names WHERE node = {STYLE2_PROTO} AND NOT builtin EXCEPT SELECT s, name FROM style),
corrected AS (
  SELECT * FROM language UNION SELECT * FROM branded
  UNION SELECT s, 'CSSStyleDeclaration', name FROM (SELECT * FROM style UNION SELECT * FROM style2) WHERE name NOT LIKE '%-%'
  UNION SELECT s, 'Window', name FROM names WHERE node = {ROOT} AND name <> '{HOOK}')
"""


def _named(rows: DataFrame, info: DataFrame) -> DataFrame:
    return rows.join(info.select(G, release_key().alias("release_key")), G).drop(G)


@query(CAPTURED + "SELECT release_key, node, key, child FROM edges JOIN graphs USING (s)")
def read_object_graph_files(spark: SparkSession, folder: str) -> DataFrame:
    """All members in all captured files, by the release that the file names."""
    files = GraphFiles(captured_files(spark, folder), numbered=True)
    members = files.part("data").where("key IS NOT NULL").select(
        G, F.col("id").cast("long").alias("node"), "key", F.col("value").cast("long").alias("child"))
    return _named(members, files.release_info())


@query(CAPTURED + "SELECT browser_name, browser_version, os_name, os_version FROM graphs")
def graph_file_releases(spark: SparkSession, folder: str) -> DataFrame:
    return release_info(captured_files(spark, folder)).drop(G)


@query(CAPTURED + """SELECT release_key, make_date(1990 + CAST(substr(browser_version, 1, 1) AS BIGINT), 1, 1) AS release_date,
  interface_name || '#' || api_name AS interface_key FROM corrected JOIN graphs USING (s)""")
def graph_files_to_junction(spark: SparkSession, folder: str) -> DataFrame:
    """From captured files to dated releases and support facts, with all default corrections."""
    digit = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("digit")
    history = table(spark, folder, "nation").select(F.concat(F.lit("B"), "n_nationkey").alias("browser_name"), digit).select(
        "browser_name", F.col("digit").cast("string").alias("version_prefix"),
        F.make_date(F.col("digit") + 1990, F.lit(1), F.lit(1)).alias("release_date"), F.col("digit").cast("long").alias("rank"))
    releases, _, facts = import_graph_files(captured_files(spark, folder), history)
    dated = releases.select(release_key().alias("release_key"), "release_date")
    return facts.join(dated, "release_key").select("release_key", "release_date", "interface_key")


@query(CAPTURED + f"""SELECT release_key, interface_name, api_name FROM graphs JOIN (
  SELECT * FROM language WHERE interface_name <> 'Object' UNION SELECT * FROM branded
  UNION SELECT s, 'CSSStyleDeclaration', name FROM style UNION SELECT s, 'CSS2Properties', name FROM style2
  UNION SELECT s, 'window', name FROM names WHERE node = {ROOT} AND name NOT LIKE 'Brand%'
  UNION SELECT s, 'Added', 'one' FROM graphs) USING (s)""")
def extractor_configuration(spark: SparkSession, folder: str) -> DataFrame:
    """Names from constructors and metadata alone, and corrections of one's own."""
    config = ExtractorConfig(
        NameRules(function_names_from_paths=False, class_names_from_tostring=False, constant_types=()),
        (postprocess.remove_interfaces(["Object"]), postprocess.remove_apis(["window"], "^Brand"),
         postprocess.add_apis("Added", ["one"])),
    )
    files = GraphFiles(captured_files(spark, folder), numbered=True)
    return _named(extract_catalog(files.graphs().settled(), config), files.release_info())


# Entity files


@query(BOUND + "SELECT release_key, interface_key FROM junction")
def read_entity_files(spark: SparkSession, folder: str) -> DataFrame:
    """Support facts as JSON arrays of classed records, read by as many tasks as they have blocks."""
    record = F.struct(
        F.lit("Junction").alias("class"), F.col("release_key").alias("releaseKey"), F.col("interface_key").alias("interfaceKey"))
    shard = F.pmod(F.xxhash64("interface_key"), F.lit(200))
    path = fresh_path(spark, "junction-json")
    arrays = bindings.junction(spark, folder).groupBy(shard.alias("shard")).agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return entities.read_entity_json(spark, path, model.JUNCTION)


@query(BOUND + "SELECT interface_name, api_name, interface_name || '#' || api_name AS interface_key FROM apis")
def read_entity_remote(spark: SparkSession, folder: str) -> DataFrame:
    """An entity file on shared storage, found by its mode, once its address has passed the allow list."""
    path = fresh_path(spark, "remote")
    record = F.struct(F.lit("Api").alias("class"), F.col("interface_name").alias("interfaceName"), F.col("api_name").alias("apiName"))
    shard = F.pmod(F.xxhash64("interface_key"), F.lit(8))
    arrays = bindings.apis(spark, folder).groupBy(shard.alias("shard")).agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/Api.json")
    uri = path if urlparse(path).scheme else f"file://{path}"
    parts = urlparse(uri)
    allowed = entities.AllowList(
        schemes=(parts.scheme,), hosts=(parts.hostname or "",), path_prefixes=(parts.path,))
    rows = entities.source_by_mode(spark, entities.REMOTE, uri, "Api", model.APIS, allowed)
    return rows.withColumn("interface_key", interface_key())
