"""Object graphs as tables: reachability, prototype chains and names.

All tables carry ``graph_id``, so one job covers every captured release at once.
``edges``: node, name, builtin, child, child_type · ``protos``: node, proto ·
``marks``: node, name · ``functions``: node, name · ``strings``: node, text ·
``roots``: root · ``nodes``: node.

Keys stored as ``+name+`` belong to the language itself (``builtin``). ``child_type`` names
the primitive type of a member's value and is null for objects; prototypes that are
primitives are left out of ``protos``. ``marks`` are the members with a plain value.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property, partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.rounds import closure
from driftline.session import cut_sized, cut_sized_and_count, together

G = "graph_id"
PROTO_LABEL = "__proto__"


def plain_name(key: Column | str) -> Column:
    return F.regexp_replace(key, r"^\+(.+)\+$", "$1")


@dataclass(frozen=True)
class ObjectGraphs:
    nodes: DataFrame | None
    edges: DataFrame
    protos: DataFrame
    marks: DataFrame
    functions: DataFrame
    strings: DataFrame
    roots: DataFrame
    reachable: DataFrame | None = None
    landmarks: DataFrame | None = None

    @classmethod
    def build(
        cls, nodes: DataFrame | None, edges: DataFrame, protos: DataFrame, meta: DataFrame,
        functions: DataFrame, strings: DataFrame, types: DataFrame, roots: DataFrame,
    ) -> ObjectGraphs:
        """From raw tables: edges with ``key``, meta with ``key`` and ``is_value``.

        Nodes may be added later, if they are to come from the written edges.
        """
        typed = types.select(G, F.col("node").alias("child"), F.col("type_name").alias("child_type"))
        primitive = types.select(G, F.col("node").alias("proto"))
        return cls(
            nodes=None if nodes is None else nodes.select(G, "node"),
            edges=edges.join(typed, [G, "child"], "left").select(
                G, "node", plain_name("key").alias("name"),
                F.col("key").rlike(r"^\+.+\+$").alias("builtin"), "child", "child_type"),
            protos=protos.select(G, "node", "proto").join(primitive, [G, "proto"], "left_anti"),
            marks=meta.where("is_value = 1").select(G, "node", plain_name("key").alias("name")).distinct(),
            functions=functions.where("name <> ''").select(G, "node", "name"),
            strings=strings.select(G, "node", "text"),
            roots=roots.select(G, "root"),
        )

    def settled(self) -> ObjectGraphs:
        """The same tables, written once, for the many passes of an extraction."""
        names = [name for name in self.__dataclass_fields__ if getattr(self, name) is not None]
        written = together(*[
            partial(cut_sized, getattr(self, name), f"graph-{name}") for name in names])
        return replace(self, **dict(zip(names, written)))

    def explored(self) -> ObjectGraphs:
        """With reachability and landmarks worked out, so that nobody does it again."""
        if self.reachable is not None:
            return self
        reachable, marks = together(
            lambda: reachable_from_root(self), lambda: cut_sized(landmarks(self), "landmarks"))
        return replace(self, reachable=reachable, landmarks=marks)


@dataclass(frozen=True)
class NameRules:
    """Which hints count as names of functions and classes."""

    function_names_from_paths: bool = True
    class_names_from_constructor: bool = True
    class_names_from_paths: bool = True
    class_names_from_tostring: bool = True
    constant_types: tuple[str, ...] = ("boolean", "number", "string")


def links(graphs: ObjectGraphs) -> DataFrame:
    """Members and prototype links as labelled edges between objects."""
    own = graphs.edges.where("child_type IS NULL").select(G, "node", "name", "builtin", "child")
    up = graphs.protos.select(
        G, "node", F.lit(PROTO_LABEL).alias("name"), F.lit(False).alias("builtin"),
        F.col("proto").alias("child"),
    )
    return own.unionByName(up)


def reachable_from_root(graphs: ObjectGraphs) -> DataFrame:
    """``graph_id, node`` for every object on a path from its graph's root, hop by hop."""
    if graphs.reachable is not None:
        return graphs.reachable
    steps = cut_sized(links(graphs).select(G, "node", "child").distinct(), "links")
    return closure(
        graphs.roots.select(G, F.col("root").alias("node")),
        lambda frontier: steps.join(frontier, [G, "node"], "left_semi").select(G, F.col("child").alias("node")),
        [G, "node"], "reached",
    )


@dataclass(frozen=True)
class ProtoForest:
    """Prototype links, and all chains between objects that are prototypes themselves.

    Prototypes are few next to the objects that use them, so any object's chain is its
    one link joined to these. A prototype that is a primitive, or missing, ends a chain.
    """

    up: DataFrame
    closure: DataFrame

    def chains(self, starts: DataFrame) -> DataFrame:
        """``graph_id, node, ancestor, depth``: strict prototypes of each start, nearest = 1."""
        first = starts.select(G, "node").distinct().join(self.up, [G, "node"]).select(
            G, "node", F.col("proto").alias("ancestor"), F.lit(1).alias("depth"))
        further = self.closure.select(
            G, F.col("node").alias("via"), "ancestor", (F.col("depth") + 1).alias("depth"))
        rest = first.select(G, "node", F.col("ancestor").alias("via")).join(further, [G, "via"])
        return first.unionByName(rest.select(G, "node", "ancestor", "depth"))


def proto_forest(graphs: ObjectGraphs) -> ProtoForest:
    """Chains by doubling: as many rounds as the longest chain's length has bits."""
    up = graphs.protos
    parents = up.select(G, F.col("proto").alias("node")).distinct()
    closure = cut_sized(
        parents.join(up, [G, "node"]).select(
            G, "node", F.col("proto").alias("ancestor"), F.lit(1).alias("depth")),
        "chains",
    )
    reach = 1
    while True:
        far = closure.where(F.col("depth") == reach).select(G, "node", F.col("ancestor").alias("via"))
        beyond = closure.select(
            G, F.col("node").alias("via"), "ancestor", (F.col("depth") + reach).alias("depth"))
        grown, added = cut_sized_and_count(
            far.join(beyond, [G, "via"]).select(G, "node", "ancestor", "depth"), "chains")
        if not added:
            return ProtoForest(up, closure)
        closure = closure.unionByName(grown)
        reach *= 2


def ctor_like(graphs: ObjectGraphs) -> DataFrame:
    """``graph_id, node, proto, proto_type``: objects with an own ``prototype``, and its value."""
    return graphs.edges.where("name = 'prototype'").select(
        G, "node", F.col("child").alias("proto"), F.col("child_type").alias("proto_type"))


def function_like(graphs: ObjectGraphs) -> DataFrame:
    """Constructors, and objects with both own ``arguments`` and ``length``."""
    hints = graphs.edges.where(F.col("name").isin("prototype", "arguments", "length"))
    found = hints.groupBy(G, "node").agg(F.collect_set("name").alias("own"))
    both = F.array_contains("own", "arguments") & F.array_contains("own", "length")
    return found.where(F.array_contains("own", "prototype") | both).select(G, "node")


def name_from_tostring(text: Column | str) -> Column:
    """``X`` of ``[object X]`` without a ``Prototype`` or ``Constructor`` suffix."""
    found = F.regexp_extract(text, r"\[object ([A-Za-z_$][0-9A-Za-z_$]*)\]", 1)
    return F.regexp_replace(found, "(Prototype|Constructor)$", "")


def _dots_as_links(links: DataFrame) -> DataFrame:
    """Links with a dot in their label as several, through objects that only paths know.

    In a path ``a.b`` looks the same whether one label holds the dot or two labels meet there. The
    objects in between get numbers below zero, which no graph uses.
    """
    dotted = F.contains("name", F.lit("."))
    parts = links.where(dotted).withColumn("parts", F.split("name", r"\.")).select(
        "*", F.posexplode("parts").alias("at", "part"))

    def between(at: Column) -> Column:
        return -F.abs(F.xxhash64("node", "name", at) % F.lit(1 << 62)) - 1

    last = F.col("at") == F.size("parts") - 1
    split = parts.select(
        G, F.when(F.col("at") == 0, F.col("node")).otherwise(between(F.col("at"))).alias("node"),
        F.col("part").alias("name"), (F.col("builtin") & last).alias("builtin"),
        F.when(last, F.col("child")).otherwise(between(F.col("at") + 1)).alias("child"),
    )
    return links.where(~dotted).select(G, "node", "name", "builtin", "child").unionByName(split)


@dataclass
class Names:
    """Function and class names of all objects, from paths below the root.

    A path's last labels decide, so one to three hops back from an object are enough.
    Nodes on those hops must be distinct.
    """

    graphs: ObjectGraphs
    reachable: DataFrame
    rules: NameRules = field(default_factory=NameRules)

    @cached_property
    def in_links(self) -> DataFrame:
        """Labelled links out of reachable objects, self links left out."""
        known = links(self.graphs).join(self.reachable, [G, "node"], "left_semi")
        apart = known.where(F.col("node") != F.col("child"))
        return cut_sized(_dots_as_links(apart), "in-links")

    def _before_prototype(self) -> DataFrame:
        """``graph_id, node, name, via, start``: ``start -name-> via -prototype-> node``."""
        first = self.in_links.select(G, F.col("node").alias("start"), "name", F.col("child").alias("via"))
        second = self.in_links.where("name = 'prototype'").select(
            G, F.col("node").alias("via"), F.col("child").alias("node"))
        return first.join(second, [G, "via"]).where(F.col("start") != F.col("node"))

    def function_names(self) -> DataFrame:
        """``graph_id, node, name`` without duplicates."""
        given = self.graphs.functions
        if not self.rules.function_names_from_paths:
            return given.distinct()
        last = self.in_links.where(
            ~F.col("builtin") & ~F.col("name").isin("prototype", PROTO_LABEL)
        ).select(G, F.col("child").alias("node"), "name")
        back = self.in_links.where("name = 'constructor'").select(
            G, F.col("node").alias("proto"), F.col("child").alias("ctor"))
        through = (
            self._before_prototype().withColumnRenamed("node", "proto")
            .join(back, [G, "proto"])
            .where((F.col("ctor") != F.col("start")) & (F.col("ctor") != F.col("via")))
            .where(F.col("name") != PROTO_LABEL)
            .select(G, F.col("ctor").alias("node"), "name")
        )
        return last.unionByName(through).unionByName(given).distinct()

    def prototype_path_names(self) -> DataFrame:
        """``X`` for objects found at ``….X.prototype``."""
        return self._before_prototype().select(G, "node", "name").distinct()

    def names_from_proto(self) -> DataFrame:
        parts = []
        if self.rules.class_names_from_paths:
            parts.append(self.prototype_path_names())
        if self.rules.class_names_from_tostring:
            text = self.graphs.strings.select(G, "node", name_from_tostring("text").alias("name"))
            parts.append(text.where(~F.col("name").isin("", "Object")))
        if not parts:
            return self.graphs.functions.select(G, "node", "name").limit(0)
        return reduce(DataFrame.unionByName, parts).distinct()

    def class_names(self, function_names: DataFrame) -> DataFrame:
        """Names of the own constructor if there is one, else names hinting at a prototype."""
        guessed = self.names_from_proto()
        if not self.rules.class_names_from_constructor:
            return guessed
        own = self.graphs.edges.where("name = 'constructor'").select(
            G, F.col("node").alias("owner"), F.col("child").alias("node"))
        by_ctor = own.join(function_names, [G, "node"]).select(
            G, F.col("owner").alias("node"), "name")
        without = guessed.join(own.select(G, F.col("owner").alias("node")), [G, "node"], "left_anti")
        return by_ctor.unionByName(without).distinct()


def root_properties(graphs: ObjectGraphs) -> DataFrame:
    """``graph_id, name, node, child_type``: what the root's members point at."""
    own = graphs.edges.withColumnRenamed("node", "root").join(graphs.roots, [G, "root"])
    return own.select(G, "name", F.col("child").alias("node"), "child_type")


def libraries(graphs: ObjectGraphs, class_names: DataFrame) -> DataFrame:
    """``graph_id, node, name``: root objects that are no functions, with all their names."""
    globals_ = root_properties(graphs).where("child_type IS NULL")
    libs = globals_.join(function_like(graphs), [G, "node"], "left_anti").select(G, "node", "name")
    named = class_names.join(libs, [G, "node"], "left_semi").select(G, "node", "name")
    return libs.unionByName(named).distinct()


def landmarks(graphs: ObjectGraphs) -> DataFrame:
    """``graph_id, node, kind`` of ``Function``, ``Function.prototype``, ``Object.prototype``."""
    if graphs.landmarks is not None:
        return graphs.landmarks
    globals_ = root_properties(graphs).where(F.col("name").isin("Function", "Object"))
    found = globals_.join(ctor_like(graphs), [G, "node"], "left")
    itself = F.when(F.col("name") == "Function", F.struct("node", F.lit("function").alias("kind")))
    proto = F.when(F.col("proto").isNotNull(), F.struct(
        F.col("proto").alias("node"),
        F.when(F.col("name") == "Object", "object_prototype").otherwise("function_prototype").alias("kind")))
    kept = F.filter(F.array(itself, proto), lambda mark: mark.isNotNull())
    return found.select(G, F.explode(kept).alias("mark")).select(G, "mark.*").distinct()


ALL_DIGITS = "^[0-9]+$"
CONST_CASE = "^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"


def constants(graphs: ObjectGraphs, rules: NameRules) -> DataFrame:
    """``graph_id, node, name`` of members that are constants in CONST_CASE.

    The value is of a constant type and is marked as a plain value, or is a boolean.
    """
    typed = graphs.edges.where(
        F.col("name").rlike(CONST_CASE) & F.col("child_type").isin(*rules.constant_types))
    marked = graphs.marks.withColumn("marked", F.lit(True))
    return (
        typed.join(marked, [G, "node", "name"], "left")
        .where(F.col("marked").isNotNull() | (F.col("child_type") == "boolean"))
        .select(G, "node", "name").distinct()
    )


def prototypes(graphs: ObjectGraphs) -> DataFrame:
    """``graph_id, node`` of all objects that are somebody's prototype."""
    return cut_sized(graphs.protos.select(G, F.col("proto").alias("node")).distinct(), "prototypes")


def class_like(graphs: ObjectGraphs) -> DataFrame:
    """``graph_id, node`` of all objects that show members as classes: prototypes, constructors with the
    objects they give out, and the root's members. Instances are left out, unless they are one of these."""
    ctors = ctor_like(graphs)
    kinds = [
        graphs.protos.select(G, F.col("proto").alias("node")), ctors.select(G, "node"),
        ctors.select(G, F.col("proto").alias("node")), root_properties(graphs).select(G, "node"),
    ]
    return cut_sized(reduce(DataFrame.unionByName, kinds).distinct(), "class-like")


def class_apis(graphs: ObjectGraphs, rules: NameRules, among: DataFrame | None = None) -> DataFrame:
    """``graph_id, node, name``: the members an object shows as a class or prototype.

    With ``among``, of these objects only; theirs are picked before anything is dealt out.
    """
    if among is not None:
        picked = among.select(G, "node")
        graphs = replace(
            graphs, edges=graphs.edges.join(picked, [G, "node"], "left_semi"), landmarks=landmarks(graphs))
    kinds = landmarks(graphs).groupBy(G, "node").agg(
        F.max(F.col("kind") == "object_prototype").alias("is_object_prototype"))
    own = graphs.edges.join(kinds, [G, "node"], "left").select(
        G, "node", "name", "builtin", "is_object_prototype", F.lit(None).cast("boolean").alias("constant"))
    if rules.constant_types:
        # Only names in capitals are looked up.
        capital = F.col("name").rlike(CONST_CASE)
        fixed = constants(graphs, rules).withColumn("constant", F.lit(True))
        looked_up = own.where(capital).drop("constant").join(fixed, [G, "node", "name"], "left")
        own = own.where(F.coalesce(~capital, F.lit(True))).unionByName(looked_up)
    variable = F.col("constant").isNull()
    ordinary = ~F.col("builtin") & ~F.col("name").rlike(ALL_DIGITS) & (F.col("name") != "prototype")
    kept = (
        F.when(F.col("is_object_prototype"), (F.col("name") != "prototype") & variable)
        .when(~F.col("is_object_prototype"), ~F.col("builtin"))
        .otherwise(ordinary & variable)
    )
    return own.where(kept).select(G, "node", "name").distinct()


def instance_members(graphs: ObjectGraphs) -> DataFrame:
    """``graph_id, node, name``: like ``instance_apis``, once for each edge."""
    own = graphs.edges.where(~F.col("builtin") & ~F.col("name").rlike(ALL_DIGITS))
    return own.select(G, "node", "name")


def instance_apis(graphs: ObjectGraphs) -> DataFrame:
    """``graph_id, node, name``: the members an object shows as an instance."""
    return instance_members(graphs).distinct()


def shown_by_prototypes(graphs: ObjectGraphs, class_members: DataFrame) -> DataFrame:
    """``graph_id, proto, name``: what each prototype shows, its own or from further down.

    Names are handed on level by level along the links between prototypes, so that what all objects of
    one prototype inherit is kept once.
    """
    parents = graphs.protos.select(G, F.col("proto").alias("node")).distinct()
    links = cut_sized(graphs.protos.join(parents, [G, "node"], "left_semi"), "prototype-links")
    own = class_members.join(parents, [G, "node"], "left_semi")
    return closure(
        own.select(G, F.col("node").alias("proto"), "name"),
        lambda found: found.join(links, [G, "proto"]).select(G, F.col("node").alias("proto"), "name"),
        [G, "proto", "name"], "shown",
    )


def inherited(nodes: DataFrame, graphs: ObjectGraphs, shown: DataFrame) -> DataFrame:
    """``graph_id, node, name``: what each object's prototype shows on its behalf."""
    return nodes.select(G, "node").distinct().join(graphs.protos, [G, "node"]).join(shown, [G, "proto"]).select(
        G, "node", "name")


def without_inherited(members: DataFrame, graphs: ObjectGraphs, shown: DataFrame) -> DataFrame:
    """Members that no prototype further down the chain shows already.

    Members may repeat and count once, or once for each link of their object to a prototype. They are made
    distinct where the prototypes' members meet them, so that they are dealt out for both at once.
    """
    ups = graphs.protos.groupBy(G, "node", "proto").agg(F.count(F.lit(1)).cast("int").alias("ups"))
    linked = members.join(ups, [G, "node"], "left")
    fresh = linked.join(shown, [G, "proto", "name"], "left_anti").distinct()
    each = F.array_repeat(F.lit(True), F.coalesce("ups", F.lit(1)))
    return fresh.withColumn("each", F.explode(each)).select(*members.columns)
