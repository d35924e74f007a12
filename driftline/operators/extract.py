"""Catalog extraction: from object graphs to (interface, api) rows, for all graphs at once."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import graph as og
from driftline.operators.graph import G, NameRules, ObjectGraphs, ProtoForest
from driftline.operators.postprocess import PostProcessor, default_processors
from driftline.operators.rounds import DUE, Rounds
from driftline.session import cut_sized, cut_sized_and_count, together

# Members every function has, not worth an API of a constructor.
FUNCTION_MEMBERS = ("arguments", "name", "length", "caller")


@dataclass(frozen=True)
class ExtractorConfig:
    rules: NameRules = field(default_factory=NameRules)
    post_processors: tuple[PostProcessor, ...] | None = None


@dataclass(frozen=True)
class Owners:
    """Constructors and libraries: ``owner, proto, kind`` (0 and 1) and their names."""

    frame: DataFrame
    names: DataFrame
    class_names: DataFrame


def owners(graphs: ObjectGraphs, rules: NameRules) -> Owners:
    names = og.Names(graphs, og.reachable_from_root(graphs), rules)
    function_names = cut_sized(names.function_names(), "function-names")
    class_names = cut_sized(names.class_names(function_names), "class-names")
    libs = cut_sized(og.libraries(graphs, class_names), "libraries")
    ctors = og.ctor_like(graphs)
    own = libs.select(
        G, F.col("node").alias("owner"), F.col("node").alias("proto"),
        F.lit(None).cast("string").alias("proto_type"), F.lit(1).alias("kind"),
    ).distinct()
    frame = ctors.withColumnRenamed("node", "owner").withColumn("kind", F.lit(0)).unionByName(own)
    named = function_names.join(ctors, [G, "node"], "left_semi").unionByName(libs)
    return Owners(frame, named.withColumnRenamed("node", "owner").distinct(), class_names)


def first_claims(found: Owners) -> DataFrame:
    """``graph_id, proto, owner``: each constructor's prototype, each library itself."""
    return found.frame.where("proto_type IS NULL").select(G, "proto", "owner").distinct()


def proto_claims(found: Owners, forest: ProtoForest) -> DataFrame:
    """``graph_id, proto, owner``, with the nameless prototypes further down the chains.

    Every owner walks down from its prototype. An object nobody has claimed goes to the
    first owner to arrive, constructors before libraries and by id; anyone else passes
    only if it shares a name with the object. Walks meet in a forest, so objects are
    settled level by level: at level n every arrival comes from a lower level.
    """
    first = cut_sized(first_claims(found), "first-claims")
    below = forest.chains(first.select(G, F.col("proto").alias("node")))
    levels = below.groupBy(G, F.col("ancestor").alias("next")).agg(F.max("depth").alias("next_level"))
    onward = forest.up.select(G, "node", F.col("proto").alias("next")).join(levels, [G, "next"])
    # Owners and the objects down their chains with which they share a name.
    akin = (
        first.join(
            below.select(G, F.col("node").alias("proto"), F.col("ancestor").alias("node")), [G, "proto"])
        .join(found.names, [G, "owner"]).join(found.class_names, [G, "node", "name"], "left_semi")
        .select(G, "node", "owner").distinct()
    )
    (onward, n_onward), akin = together(
        lambda: cut_sized_and_count(onward, "levels"), lambda: cut_sized(akin, "akin"))
    taken = first.select(G, F.col("proto").alias("node")).distinct()
    entry = found.frame.select(G, F.col("proto").alias("node"), "owner", "kind")
    # Rows are owners that passed ``node`` and arrive at ``next`` on the level they are due in.
    walks = Rounds(first.sparkSession, "walks")
    arriving = [G, "node", "owner", "kind", "next", F.coalesce("next_level", F.lit(-1)).cast("int").alias(DUE)]
    walks.add(entry.join(onward, [G, "node"]).select(*arriving, F.lit(True).alias("begins")))
    last = onward.agg(F.max("next_level")).first()[0] if n_onward else 0
    for level in range(1, last + 1):
        here = walks.due(level).select(G, F.col("next").alias("node"), "owner", "kind")
        sharing = here.join(akin, [G, "node", "owner"], "left_semi")
        free = here.join(taken, [G, "node"], "left_anti").groupBy(G, "node").agg(
            F.min(F.struct("kind", "owner")).alias("r"))
        passed = sharing.select(G, "node", "owner", "kind").unionByName(free.select(G, "node", "r.owner", "r.kind")).distinct()
        walks.add(passed.join(onward, [G, "node"], "left").select(*arriving, F.lit(False).alias("begins")))
    later = walks.table().where("NOT begins").select(G, F.col("node").alias("proto"), "owner")
    return first.select(G, "proto", "owner").unionByName(later).distinct()


def instance_levels(
    graphs: ObjectGraphs, found: Owners, claims: DataFrame, forest: ProtoForest
) -> DataFrame:
    """``graph_id, node, proto, start, depth``: objects whose members go to a claimed prototype.

    Instances are neither primitive, constructor nor claimed. Each walks down to its first
    claimed prototype; all objects on the way count, unless the walk meets a landmark or
    the end of the chain first. One row per object with its greatest start.
    """
    special = og.landmarks(graphs).where("kind <> 'function'").select(G, "node").distinct()
    claimed = claims.select(G, F.col("proto").alias("node")).distinct()
    # Where a walk stops: at landmarks for nothing, at other claimed prototypes for good.
    stops = special.withColumn("good", F.lit(False)).unionByName(
        claimed.join(special, [G, "node"], "left_anti").withColumn("good", F.lit(True)))
    parents = forest.up.select(G, F.col("proto").alias("node")).distinct()
    onward = parents.select(G, "node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    onward = onward.unionByName(forest.closure)
    first_stop = (
        onward.join(stops.withColumnRenamed("node", "ancestor"), [G, "ancestor"])
        .groupBy(G, "node").agg(F.min(F.struct("depth", "ancestor", "good")).alias("stop"))
        .where("stop.good")
        .select(G, "node", F.col("stop.ancestor").alias("proto"), F.col("stop.depth").alias("stop"))
    )
    between = (
        onward.join(first_stop, [G, "node"]).where("depth < stop")
        .select(G, F.col("node").alias("via"), F.col("ancestor").alias("passing"),
                (F.col("depth") + 1).alias("depth"))
    )
    starts = (
        graphs.nodes.join(special.unionByName(claimed), [G, "node"], "left_anti")
        .join(found.frame.where("kind = 0").select(G, F.col("owner").alias("node")), [G, "node"], "left_anti")
    )
    walks = (
        starts.join(forest.up.withColumnRenamed("proto", "via"), [G, "node"])
        .join(first_stop.select(G, F.col("node").alias("via"), "proto"), [G, "via"])
        .select(G, F.col("node").alias("start"), "via", "proto")
    )
    own = walks.select(G, F.col("start").alias("node"), "proto", "start", F.lit(0).alias("depth"))
    passing = walks.join(between, [G, "via"]).select(
        G, F.col("passing").alias("node"), "proto", "start", "depth")
    last = F.max(F.struct("start", (-F.col("depth")).alias("nearest"))).alias("last")
    return own.unionByName(passing).groupBy(G, "node", "proto").agg(last).select(
        G, "node", "proto", F.col("last.start").alias("start"), (-F.col("last.nearest")).alias("depth"))


def members_of_ctors(class_members: DataFrame) -> DataFrame:
    """``graph_id, node, name`` that constructors and libraries show themselves, if they are such."""
    return class_members.where(~F.col("name").isin(*FUNCTION_MEMBERS))


def members_of_protos(
    claims: DataFrame, class_members: DataFrame, graphs: ObjectGraphs, shown: DataFrame
) -> DataFrame:
    """``graph_id, node, name`` of claimed prototypes that are not inherited from further down."""
    holders = claims.select(G, F.col("proto").alias("node")).distinct()
    return og.without_inherited(class_members.join(holders, [G, "node"], "left_semi"), graphs, shown)


def members_of_instances(levels: DataFrame, graphs: ObjectGraphs, shown: DataFrame) -> DataFrame:
    """``graph_id, node, name`` that instances add to what their prototypes show."""
    holders = levels.select(G, "node").distinct()
    return og.without_inherited(og.instance_members(graphs).join(holders, [G, "node"], "left_semi"), graphs, shown)


def apis_from_ctors(found: Owners, class_members: DataFrame) -> DataFrame:
    """Members of constructors and libraries themselves."""
    own = members_of_ctors(class_members)
    holders = found.frame.select(G, "owner").distinct()
    return own.withColumnRenamed("node", "owner").join(holders, [G, "owner"], "left_semi").select(
        G, "owner", F.col("name").alias("api"), F.col("owner").alias("source"))


def apis_from_protos(
    claims: DataFrame, class_members: DataFrame, graphs: ObjectGraphs, shown: DataFrame
) -> DataFrame:
    """Members of claimed prototypes that are not inherited from further down."""
    fresh = members_of_protos(claims, class_members, graphs, shown)
    return fresh.withColumnRenamed("node", "proto").join(claims, [G, "proto"]).select(
        G, "owner", F.col("name").alias("api"), F.col("proto").alias("source"))


def apis_from_instances(
    levels: DataFrame, claims: DataFrame, graphs: ObjectGraphs, shown: DataFrame
) -> DataFrame:
    """Members that instances add to what their prototypes show."""
    fresh = members_of_instances(levels, graphs, shown)
    return fresh.join(levels, [G, "node"]).join(claims, [G, "proto"]).select(
        G, "owner", F.col("name").alias("api"), F.col("node").alias("source"), "start", "depth")


@dataclass(frozen=True)
class Extraction:
    """Every stage of one extraction run; ``members`` holds one row per stage and source.

    ``class_members`` are those of ``class_like`` objects, as no other object shows any.
    """

    graphs: ObjectGraphs
    owners: Owners
    claims: DataFrame
    class_members: DataFrame
    shown: DataFrame
    levels: DataFrame
    members: DataFrame

    def provenance(self) -> DataFrame:
        """``graph_id, owner, api, source``: the object an API was last taken from.

        Instances override the rest, the greatest id last and its nearest object first;
        an owner's own members come before those of its prototypes, by ascending id.
        """
        order = F.struct("stage", "start", -F.col("depth"), -F.col("source"))
        return self.members.groupBy(G, "owner", "api").agg(F.max_by("source", order).alias("source"))

    def catalog(self) -> DataFrame:
        """``graph_id, interface_name, api_name`` before post-processing.

        Objects are given the names of their owners before they meet their members, so that these are
        not dealt out by owner and by name once more.
        """
        names = self.owners.names.withColumnRenamed("name", "interface_name")
        claimed = self.claims.join(names, [G, "owner"]).select(G, "proto", "interface_name").distinct()
        holders = self.owners.frame.select(G, "owner").distinct().join(names, [G, "owner"])
        of_protos = members_of_protos(self.claims, self.class_members, self.graphs, self.shown)
        of_ctors = members_of_ctors(self.class_members)
        of_instances = members_of_instances(self.levels, self.graphs, self.shown).join(
            self.levels.select(G, "node", "proto"), [G, "node"]).select(G, "proto", "name").distinct()
        found = [
            of_protos.withColumnRenamed("node", "proto").join(claimed, [G, "proto"]),
            of_ctors.withColumnRenamed("node", "owner").join(holders, [G, "owner"]),
            of_instances.join(claimed, [G, "proto"]),
        ]
        return reduce(DataFrame.unionByName, [
            rows.select(G, "interface_name", F.col("name").alias("api_name")) for rows in found]).distinct()


def run(graphs: ObjectGraphs, rules: NameRules = NameRules()) -> Extraction:
    def owned() -> tuple[ObjectGraphs, Owners]:
        explored = graphs.explored()
        return explored, owners(explored, rules)

    def members_and_shown() -> tuple[DataFrame, DataFrame]:
        members = cut_sized(og.class_apis(graphs, rules, og.class_like(graphs)), "class-members")
        return members, og.shown_by_prototypes(graphs, members)

    (explored, found), forest, (class_members, shown) = together(
        owned, lambda: og.proto_forest(graphs), members_and_shown)
    graphs = explored
    claims = cut_sized(proto_claims(found, forest), "claims")
    levels = cut_sized(instance_levels(graphs, found, claims, forest), "levels")
    nothing = [F.lit(None).cast("long").alias("start"), F.lit(None).cast("int").alias("depth")]
    members = (
        apis_from_protos(claims, class_members, graphs, shown)
        .select("*", *nothing, F.lit(0).alias("stage"))
        .unionByName(apis_from_ctors(found, class_members)
                     .select("*", *nothing, F.lit(1).alias("stage")))
        .unionByName(apis_from_instances(levels, claims, graphs, shown)
                     .select("*", F.lit(2).alias("stage")))
    )
    return Extraction(graphs, found, claims, class_members, shown, levels, members)


def extract_catalog(
    graphs: ObjectGraphs, config: ExtractorConfig = ExtractorConfig()
) -> DataFrame:
    """``graph_id, interface_name, api_name`` of every graph, after post-processing."""
    processors = config.post_processors
    if processors is None:
        processors = default_processors(config.rules)
    done = run(graphs, config.rules)
    catalog = cut_sized(done.catalog(), "catalog")
    for processor in processors:
        catalog = processor(catalog, done.graphs)
    return catalog
