"""Corrections applied to an extracted catalog, in order: ``(catalog, graphs) -> catalog``.

A catalog has ``graph_id, interface_name, api_name``. Any callable of that form will do;
``Documented`` attaches the reasons a correction exists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import graph as og
from driftline.operators.graph import G, NameRules, ObjectGraphs

PostProcessor = Callable[[DataFrame, ObjectGraphs], DataFrame]
# Interfaces that never belong in a catalog.
BLOCKED_INTERFACES = (
    "CSS2Properties", "window", "a", "__REACT_DEVTOOLS_GLOBAL_HOOK__", "nativeMap", "nativeSet",
    "nativeWeakMap",
)


@dataclass(frozen=True)
class Documented:
    """A correction with links to the reasons for it."""

    process: PostProcessor
    issue_url: str = ""
    bug_url: str = ""
    spec_url: str = ""
    other_urls: tuple[str, ...] = ()

    def __call__(self, catalog: DataFrame, graphs: ObjectGraphs) -> DataFrame:
        return self.process(catalog, graphs)


def _with_new(catalog: DataFrame, rows: DataFrame, known: DataFrame) -> DataFrame:
    """The catalog and those rows it does not have yet; ``known`` are its rows of their interfaces."""
    columns = [G, "interface_name", "api_name"]
    fresh = rows.select(*columns).distinct().join(known.select(*columns), columns, "left_anti")
    return catalog.unionByName(fresh)


def remove_interfaces(names: Iterable[str]) -> PostProcessor:
    names = list(names)
    return lambda catalog, graphs: catalog.where(~F.col("interface_name").isin(*names))


def remove_apis(interfaces: Iterable[str], pattern: str) -> PostProcessor:
    listed = F.col("interface_name").isin(*interfaces)
    return lambda catalog, graphs: catalog.where(~(listed & F.col("api_name").rlike(pattern)))


def add_apis(interface: str, names: Iterable[str]) -> PostProcessor:
    """Append names to an interface of every graph, duplicates included."""
    added = F.explode(F.array(*[F.lit(name) for name in names]))

    def process(catalog: DataFrame, graphs: ObjectGraphs) -> DataFrame:
        rows = graphs.roots.select(G).distinct().select(
            G, F.lit(interface).alias("interface_name"), added.alias("api_name"))
        return catalog.unionByName(rows)

    return process


def copy_to_interface(source: str, target: str) -> PostProcessor:
    """Give ``target`` the APIs of ``source`` it does not have."""

    def process(catalog: DataFrame, graphs: ObjectGraphs) -> DataFrame:
        copied = catalog.where(F.col("interface_name") == source)
        return _with_new(
            catalog, copied.withColumn("interface_name", F.lit(target)), catalog.where(F.col("interface_name") == target))

    return process


def copy_to_prototype(source: str, rules: NameRules = NameRules()) -> PostProcessor:
    """Give an interface's APIs to the classes its prototype derives from.

    Graphs without the interface are left alone. If the prototype's prototype is nobody's
    ``X.prototype``, the job fails.
    """

    def process(catalog: DataFrame, graphs: ObjectGraphs) -> DataFrame:
        graphs = graphs.explored()
        named = graphs.functions.select(G, "node", F.lit(True).alias("named"))
        start = og.root_properties(graphs).where(F.col("name") == source).select(G, "node")
        proto = (
            start.join(named, [G, "node"], "left").join(og.ctor_like(graphs), [G, "node"], "left")
            .select(G, F.when(F.col("named"), F.col("proto")).otherwise(F.col("node")).alias("node"))
        )
        target = proto.join(graphs.protos, [G, "node"]).select(G, F.col("proto").alias("node"))
        names = og.Names(graphs, graphs.reachable, rules).prototype_path_names()
        missing = F.raise_error(F.lit(f"no class found for the prototype of {source}"))
        targets = target.join(names, [G, "node"], "left").select(
            G, F.coalesce("name", missing.cast("string")).alias("target"))
        copied = (
            catalog.where(F.col("interface_name") == source).join(targets.distinct(), G)
            .select(G, F.col("target").alias("interface_name"), "api_name")
        )
        return _with_new(catalog, copied, catalog)

    return process


def remove_root_aliases() -> PostProcessor:
    """Drop interfaces named like root properties that point back at the root."""

    def process(catalog: DataFrame, graphs: ObjectGraphs) -> DataFrame:
        aliases = (
            og.root_properties(graphs).withColumnRenamed("node", "root")
            .join(graphs.roots, [G, "root"]).select(G, F.col("name").alias("interface_name"))
        )
        return catalog.join(aliases, [G, "interface_name"], "left_anti")

    return process


def default_processors(rules: NameRules = NameRules()) -> tuple[PostProcessor, ...]:
    """Copies first, so that nothing is removed before it was copied."""
    return (
        Documented(
            copy_to_prototype("CSS2Properties", rules),
            bug_url="https://bugzilla.mozilla.org/show_bug.cgi?id=1290786",
        ),
        Documented(copy_to_interface("window", "Window")),
        Documented(remove_interfaces(BLOCKED_INTERFACES)),
        Documented(remove_apis(["Window"], "^__REACT_DEVTOOLS_GLOBAL_HOOK__$")),
        Documented(
            remove_apis(["CSSStyleDeclaration"], "[-]"),
            spec_url="https://drafts.csswg.org/cssom/#dom-cssstyledeclaration-dashed-attribute",
            other_urls=("https://github.com/w3c/csswg-drafts/issues/1089",),
        ),
        Documented(remove_root_aliases()),
    )
