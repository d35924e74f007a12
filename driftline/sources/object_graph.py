"""Object graph files: one JSON document per captured release.

A document is parsed once, into a variant, and fans out to rows that say which part of it they are
from. They are written partitioned by that tag, so that all graph tables come from one scan of the
files, and no table holds a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from driftline.operators.extract import ExtractorConfig, extract_catalog
from driftline.operators.graph import G, ObjectGraphs
from driftline.session import bytes_of, cut_sized, fresh_path, too_big_to_send
from driftline.sources.catalog import import_catalogs

#: Parts of a document that are maps by node, and those whose values are maps again.
MAPS = ("data", "functions", "metadata", "protos", "toStrings", "types")
NESTED = ("data", "metadata")
RELEASE = {"browser_name": "browser.name", "browser_version": "browser.version",
           "os_name": "platform.name", "os_version": "platform.version"}


def read_object_graphs(spark: SparkSession, folder: str, names: str = "*window_*.json") -> DataFrame:
    """``graph_id, file_name, document``: one row per file, no recursion, the document as a variant.

    Files are those whose name matches ``names``. A file that is not valid JSON fails the job.
    """
    files = spark.read.option("pathGlobFilter", names).text(folder, wholetext=True)
    name = F.col("_metadata.file_name")
    return files.select(name.alias(G), name.alias("file_name"), F.parse_json("value").alias("document"))


def release_info(documents: DataFrame, on_malformed: str = "error") -> DataFrame:
    """``graph_id`` and the four release parts.

    The environment decides if it is complete, else a file name of five parts. On a
    malformed name the job fails, or the parts are null with ``on_malformed="null"``.
    """
    parts = {name: F.try_variant_get("document", f"$.environment.{path}", "string") for name, path in RELEASE.items()}
    return _release_of(documents.select(G, "file_name", *[part.alias(name) for name, part in parts.items()]), on_malformed)


def _release_of(rows: DataFrame, on_malformed: str) -> DataFrame:
    """Release parts from those that the environment gives and the file name."""
    complete = F.lit(True)
    for name in RELEASE:
        complete &= F.coalesce(F.col(name), F.lit("")) != ""
    pieces = F.split(F.regexp_replace("file_name", r"\.json$", ""), "_")
    well_formed = F.col("file_name").endswith(".json") & (F.size(pieces) == 5)
    found = F.when(complete, F.struct(*RELEASE)).when(
        well_formed, F.struct(*[pieces[i + 1].alias(name) for i, name in enumerate(RELEASE)]))
    if on_malformed == "error":
        found = found.otherwise(F.raise_error(F.concat(F.lit("malformed graph file name: "), "file_name")))
    return rows.select(G, found.alias("info")).select(G, "info.*")


def _exploded(rows: DataFrame, variant: Column, key: str, value: str) -> DataFrame:
    """Rows with a key and a value for each entry of an object; others and empty ones stay, with nulls."""
    entries = rows.sparkSession.tvf.variant_explode_outer(variant.outer())
    return rows.lateralJoin(entries.select(F.col("key").alias(key), F.col("value").alias(value)))


def tagged_rows(documents: DataFrame) -> DataFrame:
    """``graph_id, tag, id, key, value``: every entry of every part of the documents.

    ``value`` is text. Each document has a row tagged ``file`` with its file name as ``id`` and the
    environment as ``value``, so that none is lost.
    """
    whole = F.array(
        F.struct(F.lit(True).alias("file"), F.try_variant_get("document", "$.environment", "variant").alias("part")),
        F.struct(F.lit(False).alias("file"), F.col("document").alias("part")),
    )
    # What is taken apart is not needed any more behind that, so that no entry drags the whole it is from.
    twice = documents.select(G, "file_name", F.explode(whole).alias("one")).select(
        G, "file_name", "one.file", F.when(F.col("one.file"), F.col("one.part")).alias("environment"),
        F.when(~F.col("one.file"), F.col("one.part")).alias("part"))
    parts = _exploded(twice, F.col("part"), "name", "content")
    tag = F.when(F.col("file"), F.lit("file")).otherwise(F.col("name"))
    tagged = parts.select(
        G, tag.alias("tag"), F.when(F.col("file"), F.col("file_name")).alias("file_name"),
        F.when(F.col("file"), F.col("environment")).otherwise(F.col("content")).alias("content"),
    ).where(F.col("tag").isin("file", "root", *MAPS))
    single, nested = F.col("tag").isin("file", "root"), F.col("tag").isin(*NESTED)
    entries = _exploded(tagged.select(
        G, "tag", "file_name", F.when(single, F.col("content")).alias("single"), F.when(~single, F.col("content")).alias("map"),
    ), F.col("map"), "id", "entry").select(
        G, "tag", F.coalesce("id", "file_name").alias("id"), F.coalesce("entry", "single").alias("entry"))
    members = _exploded(entries.select(
        G, "tag", "id", F.when(~nested, F.col("entry").cast("string")).alias("text"), F.when(nested, F.col("entry")).alias("map"),
    ), F.col("map"), "key", "member")
    return members.select(
        G, "tag", "id", "key", F.when(nested, F.col("member").cast("string")).otherwise(F.col("text")).alias("value"))


class GraphFiles:
    """The tagged rows of a set of documents, written once.

    With ``numbered``, documents have a number as ``graph_id``, as every row that is dealt out or sorted
    has one. The names of the files are the ids of the part ``file``.
    """

    def __init__(self, documents: DataFrame, numbered: bool = False):
        spark = documents.sparkSession
        path = fresh_path(spark, "graph-files")
        rows = tagged_rows(documents.withColumn(G, F.monotonically_increasing_id()) if numbered else documents)
        tags = ("file", "root", *MAPS)
        seen, size = Observation(), bytes_of(rows)
        counted = rows.observe(seen, *[F.sum(F.when(F.col("tag") == tag, size)).alias(tag) for tag in tags])
        # By graph: else each of the many tasks that read small files has a file for every tag.
        counted.repartition(G).write.partitionBy("tag").parquet(path)
        self.table, self.bytes = spark.read.schema(rows.schema).parquet(path), seen.get

    def part(self, tag: str) -> DataFrame:
        rows = self.table.where(F.col("tag") == tag).select(G, "id", "key", "value")
        return rows if tag == "data" else too_big_to_send(rows, self.bytes[tag])

    def release_info(self, on_malformed: str = "error") -> DataFrame:
        parts = {name: F.get_json_object("value", f"$.{path}") for name, path in RELEASE.items()}
        return _release_of(
            self.part("file").select(G, F.col("id").alias("file_name"), *[p.alias(n) for n, p in parts.items()]),
            on_malformed)

    def graphs(self) -> ObjectGraphs:
        """The documents' maps as tables keyed by graph and node."""
        node = F.col("id").cast("long").alias("node")

        def per_node(tag: str, value: Column) -> DataFrame:
            return self.part(tag).where("id IS NOT NULL").select(G, node, value)

        number, text = F.col("value").cast("long"), F.col("value")
        members, notes = self.part("data"), self.part("metadata").where("key IS NOT NULL")
        return ObjectGraphs.build(
            nodes=members.where("id IS NOT NULL").select(G, node).distinct(),
            edges=members.where("key IS NOT NULL").select(G, node, "key", number.alias("child")),
            protos=per_node("protos", number.alias("proto")),
            meta=notes.select(G, node, "key", F.coalesce(
                F.get_json_object("value", "$.value").cast("int"), F.lit(0)).alias("is_value")),
            functions=per_node("functions", text.alias("name")),
            strings=per_node("toStrings", text.alias("text")),
            types=self.part("types").where("id IS NOT NULL").select(
                G, F.col("id").alias("type_name"), number.alias("node")),
            roots=self.part("root").select(G, number.alias("root")),
        )


def graph_tables(documents: DataFrame) -> ObjectGraphs:
    return GraphFiles(documents).graphs()


def import_graph_files(
    documents: DataFrame, history: DataFrame, config: ExtractorConfig = ExtractorConfig(), on_malformed: str = "error"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Releases, APIs and support facts of captured graphs, from one scan of their files.

    The corrected catalog is written, as all three tables come from it. Releases are those of its graphs.
    """
    files = GraphFiles(documents, numbered=True)
    catalog = cut_sized(extract_catalog(files.graphs().settled(), config), "corrected")
    info = files.release_info(on_malformed)
    releases = info.join(catalog.select(G).distinct(), G, "left_semi").drop(G)
    return import_catalogs(catalog.join(info, G).drop(G), history, releases=releases)
