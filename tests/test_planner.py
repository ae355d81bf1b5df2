import pytest

from tessera.config import ConfigError
from tessera.graph import document_classes, load_order, reference_components, strong_components
from tessera.plans.nodes import All, AnyOf, In, KeysOf, WithAncestors, reads
from tessera.plans.resolver import Request, Resolver, check_request, scope_mode

from .fixtures import SCOPED, SHOP, TREE, d, schema, t


def plan(objects, request, name):
    return Resolver(schema(objects), request).plan(name)


def test_modes():
    assert not scope_mode(schema(SHOP), Request.of("shops", [1]))
    assert scope_mode(schema(SCOPED), Request.of(ids=[1]))
    assert scope_mode(schema(SCOPED), Request.of("loans", [1]))
    assert not scope_mode(schema(SCOPED), Request.of("loans", [1], mode="primary_key"))
    bad = [Request.of(ids=[1]), Request.of("shops", {"org": [1]}), Request.of(mode="primary_key"), Request.of("nope", [1]), Request.of("shops", [1], mode="other")]
    for request in bad:
        with pytest.raises(ConfigError):
            check_request(schema(SHOP), request)


def test_referenced_by_one_but_not_by_two():
    one = [t("a", ["id"]), t("b", ["id", "a_id", "h_id"], [("a_id", "a"), ("h_id", "hub")]), t("hub", ["id"])]
    found = plan(one, Request.of("a", [1]), "hub")
    assert found.rule == "referenced" and found.node.keys.column == "h_id"
    two = [*one, t("c", ["id", "a_id", "h_id"], [("a_id", "a"), ("h_id", "hub")])]
    found = plan(two, Request.of("a", [1]), "hub")
    assert found.node == All("hub") and "reverse_scope" in found.notes[0]
    two[2] = two[2] | {"reverse_scope": {"via": [{"table": "b", "column": "h_id"}, {"table": "c", "column": "h_id"}, {"table": "gone", "column": "x"}]}}
    found = plan(two, Request.of("a", [1]), "hub")
    assert found.rule == "reverse_scope" and isinstance(found.node.keys, AnyOf) and len(found.node.keys.keys) == 2 and "gone" in found.notes[0]


def test_cascade_and_its_ambiguity():
    hub = [t("a", ["id"]), t("b", ["id", "a_id", "h_id"], [("a_id", "a"), ("h_id", "hub")]), t("hub", ["id"]), t("sat", ["id", "hub_id"], [("hub_id", "hub")]), t("deep", ["id", "sat_id"], [("sat_id", "sat")])]
    # sat's own reference makes it a second referencer of nothing: the hub is still narrowed by b alone
    assert plan(hub, Request.of("a", [1]), "sat").rule == "cascade"
    deep = plan(hub, Request.of("a", [1]), "deep")
    assert deep.rule == "cascade" and {"deep", "sat", "hub", "b"} <= reads(deep.node)
    crowd = [*hub, t("hub2", ["id"], reverse_scope={"via": [{"table": "b", "column": "id"}]}), t("both", ["id", "x", "y"], [("x", "hub"), ("y", "hub2")])]
    found = plan(crowd, Request.of("a", [1]), "both")
    assert found.rule == "full" and "several narrowed tables" in found.notes[0]


def test_unscopable_is_an_error_and_cycles_end():
    objects = [*SCOPED, t("lost", ["id", "x"], [("x", "lost2")]), t("lost2", ["id", "y"], [("y", "lost")])]
    with pytest.raises(ConfigError, match="lost, lost2"):
        Resolver(schema(objects), Request.of(ids=[1])).plans()


def test_arm_scoped_through_the_table_itself_is_dropped():
    objects = [
        t("accounts", ["id", "tenant_id"], scope_column="tenant_id"),
        t("attachments", ["id", "kind", "owner_id", "blob_id"], [("owner_id", "accounts", "kind", "Account"), ("owner_id", "blobs", "kind", "Blob"), ("blob_id", "blobs")]),
        t("blobs", ["id"], reverse_scope={"via": [{"table": "attachments", "column": "blob_id"}]}),
    ]
    r = Resolver(schema(objects), Request.of(ids=[1]))
    assert "blobs" not in reads(r.plan("attachments").node)
    assert r.plan("blobs").rule == "reverse_scope"


def test_arms_need_an_owner_in_target_mode():
    """An arm whose target is kept only because something points at it doesn't pull rows in."""
    objects = [
        t("products", ["id", "shop_id"], [("shop_id", "shops")]), t("shops", ["id"]),
        t("reviews", ["id", "kind", "of_id"], [("of_id", "products", "kind", "Product"), ("of_id", "shops", "kind", "Shop")]),
    ]
    r = Resolver(schema(objects), Request.of("products", [1]))
    assert r.plan("shops").rule == "referenced" and "shops" not in reads(r.plan("reviews").node)


def test_tree_routes_take_the_parents_extraction():
    r = Resolver(schema(TREE), Request.of(ids=["t1"]))
    notes = r.plan("notes").node
    assert isinstance(notes, In) and isinstance(notes.keys, KeysOf) and isinstance(notes.keys.source, WithAncestors)
    objects = [t("nodes", ["id", "up"], [("up", "nodes")]), t("leaves", ["id", "n"], [("n", "nodes")])]
    r = Resolver(schema(objects), Request.of("nodes", [1]))
    assert r.plan("leaves").rule == "tree" and isinstance(r.plan("leaves").node.keys.source, WithAncestors)


def test_filters():
    objects = [t("a", ["id"], filter="a.id > 0"), t("b", ["id", "a_id"], [("a_id", "a")], filter="b.id > 0"), t("c", ["id", "b_id"], [("b_id", "b")], filter="c.id > 0")]
    text = lambda name, **o: Resolver(schema(objects), Request.of("a", [1]), **o).plan(name).explain()
    assert "where" not in text("a") and "where b.id" in text("b")
    assert "where b.id" in text("c") and "where c.id" not in text("c") and "has no effect" in text("c")
    assert "where c.id" in text("c", apply_filters="always")


def test_batch_shapes():
    lines = lambda **b: [o | {"batch_scope": b} if o["name"] == "loan_books" else o for o in SCOPED]
    check_request(schema(lines(table="loans")), Request.of(ids=[1]))
    for objects, request in ((lines(table="members"), Request.of(ids=[1])), (lines(table="nope"), Request.of(ids=[1]))):
        with pytest.raises(ConfigError):
            check_request(schema(objects), request)
    objects = [o | {"batch_scope": {"table": "loans"}} if o["name"] in ("fines", "members", "genres") else o for o in SCOPED]
    for name in ("fines", "members", "genres"):
        with pytest.raises(ConfigError):
            check_request(schema([o if o["name"] == name else {k: v for k, v in o.items() if k != "batch_scope"} for o in objects]), Request.of(ids=[1]))


def test_order_and_cycles():
    order, cut = load_order(schema(SHOP))
    assert order[:2] == ["shops", "system_announcements"] and order.index("orders") < order.index("order_items") and not cut
    loop = [t("a", ["id", "b_id"], [("b_id", "b")]), t("b", ["id", "a_id"], [("a_id", "a")]), t("c", ["id", "a_id"], [("a_id", "a")]), t("self", ["id", "p"], [("p", "self")])]
    order, cut = load_order(schema(loop))
    assert order == ["self", "a", "b", "c"] and cut == ["a -> b"]
    assert sorted(map(sorted, strong_components({"a": {"b"}, "b": {"a"}, "c": {"a"}}))) == [["a", "b"], ["c"]]


def test_classes_of_collections():
    objects = [d("shops", ["_id"]), d("brands", ["_id"]), d("products", ["_id", "shop_id", "brand_id"], [("shop_id", "shops"), ("brand_id", "brands")]), d("settings", ["_id"]), d("region_settings", ["_id", "s"], [("s", "settings")]), d("locales", ["_id", "r"], [("r", "region_settings")])]
    assert document_classes(schema(objects), "shops") == {"shops": "genuine", "brands": "leaf", "products": "genuine", "settings": "leaf", "region_settings": "reference", "locales": "reference"}
    assert reference_components(schema(objects), "shops") == [["region_settings", "locales"]]


def test_arms_come_before_their_hub():
    from .fixtures import DOCUMENTS

    order, _ = load_order(schema(DOCUMENTS), arms_first=True)
    assert order.index("matches") < order.index("people") < order.index("licences") and order.index("trainings") < order.index("people")
    loop = [d("a", ["_id"], reverse_scope={"via": [{"table": "b", "column": "_id"}]}), d("b", ["_id"], reverse_scope={"via": [{"table": "a", "column": "_id"}]})]
    with pytest.raises(ConfigError, match="a, b"):
        load_order(schema(loop), arms_first=True)
