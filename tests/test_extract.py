import pytest
from graphs import Graph

from driftline.operators import graph as og
from driftline.operators import postprocess as post
from driftline.operators.extract import ExtractorConfig, extract_catalog, run
from driftline.operators.graph import NameRules
from driftline.sources.object_graph import graph_tables, read_object_graphs

BASE = {
    "Object": ["constructor", "toString", "valueOf"],
    "Function": ["apply", "call", "length", "name", "prototype"],
}


def tables(spark, folder):
    return graph_tables(read_object_graphs(spark, folder)).settled()


def catalog(spark, graph, tmp_path, config=ExtractorConfig()):
    found = {}
    for row in extract_catalog(tables(spark, graph.write(tmp_path)), config).collect():
        found.setdefault(row.interface_name, []).append(row.api_name)
    return {name: sorted(apis) for name, apis in found.items()}


def test_members_of_prototypes_constructors_and_root(spark, tmp_path):
    g = Graph()
    alpha = g.fn("Alpha", g.obj(proto=g.object_proto, beta=6, charlie=6))
    lookalike = g.obj(prototype=g.obj(proto=g.object_proto, delta=6))
    g.put(alpha, "shared", 6).put(g.root, "Alpha", alpha).put(g.root, "Echo", alpha)
    g.put(g.root, "Like", lookalike).put(g.root, "window", g.root).put(g.root, "self", g.root)
    assert catalog(spark, g, tmp_path) == {
        **BASE,
        "Alpha": ["beta", "charlie", "shared"],
        "Echo": ["beta", "charlie", "shared"],
        "Like": ["delta"],
        "Window": ["Alpha", "Echo", "Function", "Like", "Object", "self", "window"],
    }


def test_constants_digits_and_builtins_are_dropped(spark, tmp_path):
    g = Graph()
    proto = g.obj(proto=g.object_proto, kept=3, toString=6)
    g.put(proto, "MAX_SIZE", 3, value=1).put(proto, "_MAX", 3, value=1).put(proto, "0", 6)
    g.put(proto, "FLAG", 2, value=0).put(proto, "A__B", 3, value=1).put(proto, "OBJ", 7, value=1)
    g.put(proto, "LIVE", 3, value=0)
    g.put(g.root, "Alpha", g.fn("Alpha", proto))
    assert catalog(spark, g, tmp_path)["Alpha"] == ["A__B", "LIVE", "OBJ", "_MAX", "kept"]


def test_constants_stay_when_no_type_is_constant(spark, tmp_path):
    g = Graph()
    proto = g.obj(proto=g.object_proto)
    g.put(proto, "MAX", 3, value=1).put(proto, "FLAG", 2, value=0)
    g.put(g.root, "Alpha", g.fn("Alpha", proto))
    config = ExtractorConfig(NameRules(constant_types=()))
    assert catalog(spark, g, tmp_path, config)["Alpha"] == ["FLAG", "MAX"]


def test_instances_add_to_their_class_and_libraries_keep_their_own(spark, tmp_path):
    g = Graph()
    proto = g.obj(proto=g.object_proto, beta=6)
    instance = g.obj(proto=proto, charlie=6)
    above = g.obj(proto=instance, delta=6, beta=6)
    plain = g.obj(proto=g.object_proto, lost=6)
    g.put(g.root, "Alpha", g.fn("Alpha", proto))
    g.put(g.root, "lib", g.obj(proto=g.object_proto, one=instance, two=above, three=plain))
    assert catalog(spark, g, tmp_path) == {
        **BASE, "Alpha": ["beta", "charlie", "delta"], "lib": ["one", "three", "two"]}


def test_nameless_prototypes_go_to_the_first_owner(spark, tmp_path):
    g = Graph()
    a_proto = g.obj(proto=g.obj(proto=g.object_proto, alpha=6))
    b_proto = g.obj(proto=g.obj(proto=a_proto, charlie=6), beta=6)
    g.put(g.root, "Alpha", g.fn("Alpha", a_proto, False))
    g.put(g.root, "Beta", g.fn("Beta", b_proto))
    assert catalog(spark, g, tmp_path) == {**BASE, "Alpha": ["alpha"], "Beta": ["beta", "charlie"]}


def test_later_owners_pass_by_a_shared_name_only(spark, tmp_path):
    g = Graph()
    hidden = g.obj(proto=g.object_proto, text="[object GammaPrototype]", common=6)
    for name in ("Alpha", "Beta", "Gamma"):
        own = g.obj(proto=hidden)
        g.put(own, "of" + name, 6)
        g.put(g.root, name, g.fn(name, own))
    assert catalog(spark, g, tmp_path) == {
        **BASE, "Alpha": ["common", "ofAlpha"], "Beta": ["ofBeta"], "Gamma": ["common", "ofGamma"]}


def test_library_prototype_is_combined(spark, tmp_path):
    g = Graph()
    g.put(g.root, "lib", g.obj(proto=g.obj(proto=g.object_proto, one=6), two=6))
    assert catalog(spark, g, tmp_path) == {**BASE, "lib": ["one", "two"]}


def test_names_come_from_paths_unless_switched_off(spark, tmp_path):
    g = Graph()
    nameless = g.fn("", g.obj(proto=g.object_proto), False)
    g.put(nameless, "alpha", 6)
    g.put(g.root, "lib", g.obj(proto=g.object_proto, holder=g.obj(proto=g.object_proto, Alpha=nameless)))
    folder = tmp_path / "one"
    folder.mkdir()
    assert catalog(spark, g, folder) == {**BASE, "lib": ["holder"], "Alpha": ["alpha"]}
    config = ExtractorConfig(NameRules(function_names_from_paths=False))
    other = tmp_path / "two"
    other.mkdir()
    assert catalog(spark, g, other, config) == {**BASE, "lib": ["holder"]}


def test_dots_in_labels_part_paths(spark, tmp_path):
    g = Graph()
    nameless = g.fn("", g.obj(proto=g.object_proto), False)
    g.put(nameless, "alpha", 6)
    g.put(g.root, "space.within.Beta", nameless)
    g.put(g.root, "Gamma.prototype", g.obj(proto=g.object_proto))
    graphs = tables(spark, g.write(tmp_path))
    names = og.Names(graphs, og.reachable_from_root(graphs))
    assert {r.name for r in names.function_names().where(f"node = {nameless}").collect()} == {"Beta"}
    assert "Gamma" in {r.name for r in names.prototype_path_names().collect()}


def test_hidden_constructor_found_through_prototype_link(spark, tmp_path):
    g = Graph()
    hidden_proto = g.obj(proto=g.object_proto)
    g.fn("Hidden", hidden_proto)
    g.put(g.root, "lib", g.obj(proto=g.object_proto, item=g.obj(proto=hidden_proto, secret=6)))
    assert catalog(spark, g, tmp_path) == {**BASE, "lib": ["item"], "Hidden": ["secret"]}


def test_same_named_interfaces_merge_and_graphs_stay_apart(spark, tmp_path):
    for number, member in enumerate(("one", "two")):
        g = Graph()
        g.put(g.root, "Alpha", g.fn("Alpha", g.obj(proto=g.object_proto, **{member: 6})))
        other = g.fn("Alpha", g.obj(proto=g.object_proto, both=6))
        g.put(g.root, "lib", g.obj(proto=g.object_proto, Alpha=other))
        g.write(tmp_path, f"window_B_{number}.0_OS_1.json")
    rows = extract_catalog(tables(spark, str(tmp_path))).where("interface_name = 'Alpha'").collect()
    assert sorted((r.graph_id, r.api_name) for r in rows) == [
        ("window_B_0.0_OS_1.json", "both"), ("window_B_0.0_OS_1.json", "one"),
        ("window_B_1.0_OS_1.json", "both"), ("window_B_1.0_OS_1.json", "two")]


def test_provenance_names_the_last_source(spark, tmp_path):
    g = Graph()
    proto = g.obj(proto=g.object_proto, shown=6)
    ctor = g.fn("Alpha", proto)
    g.put(ctor, "fixed", 6).put(ctor, "shown", 6)
    low = g.obj(proto=proto, extra=6)
    high = g.obj(proto=low, extra=6, fixed=6)
    g.put(g.root, "Alpha", ctor).put(g.root, "lib", g.obj(proto=g.object_proto, x=high))
    found = run(tables(spark, g.write(tmp_path))).provenance().where(f"owner = {ctor}").collect()
    assert {r.api: r.source for r in found} == {"shown": ctor, "fixed": high, "extra": low}


def test_copy_to_prototype(spark, tmp_path):
    g = Graph()
    base_proto = g.obj(proto=g.object_proto, color=6)
    g.put(g.root, "Base", g.fn("Base", base_proto))
    g.put(g.root, "Derived", g.fn("Derived", g.obj(proto=base_proto, margin=6)))
    config = ExtractorConfig(post_processors=(
        post.copy_to_prototype("Derived"), post.copy_to_prototype("Unknown"),
        post.remove_interfaces(["Derived"]), post.add_apis("Base", ["added"]),
        post.remove_apis(["Object"], "^to"),
    ))
    assert catalog(spark, g, tmp_path, config) == {
        "Function": BASE["Function"], "Object": ["constructor", "valueOf"],
        "Base": ["added", "color", "margin"]}


def test_copy_to_prototype_fails_without_a_class(spark, tmp_path):
    g = Graph()
    nobody = g.obj(proto=g.object_proto)
    g.put(g.root, "Derived", g.fn("Derived", g.obj(proto=nobody, margin=6)))
    config = ExtractorConfig(post_processors=(post.copy_to_prototype("Derived"),))
    with pytest.raises(Exception, match="no class found"):
        catalog(spark, g, tmp_path, config)


def test_reachability_follows_properties_and_prototypes(spark, tmp_path):
    g = Graph(with_base=False)
    below = g.obj()
    far = g.obj(proto=below)
    g.put(g.root, "far", far)
    lonely = g.obj(loop=6)
    found = og.reachable_from_root(tables(spark, g.write(tmp_path))).collect()
    assert sorted(r.node for r in found) == [g.root, below, far] and lonely not in found
