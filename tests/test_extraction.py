import pytest

from tessera.config import ConfigError
from tessera import config as C
from tessera.engine import Extraction, dangling
from tessera.operators import lower
from tessera.plans.resolver import Request

from . import fixtures as X


def kept(spark, objects, source, request, **options):
    e = Extraction(X.schema(objects), request, source(spark), **options)
    return e, {n: X.ids(e.rows(n), X.schema(objects)[n].primary_key) for n in e.plans}


def test_target(spark):
    e, got = kept(spark, X.SHOP, X.shop, Request.of("shops", [1]))
    assert got == {
        "shops": [1], "users": [1, 2], "products": [1, 2, 3], "orders": [3, 4, 5, 6], "order_items": [3, 4, 5, 6],
        "transactions": [3, 4, 5, 6], "reviews": [1, 2, 3], "system_announcements": [1, 2, 3],
    }
    assert e.plans["order_items"].rule == "path" and e.plans["system_announcements"].rule == "full"
    masked = {r.id: (r.name, r.email) for r in e.masked("users").collect()}
    assert masked == {1: ("USER 1", "masked1@example.com"), 2: ("USER 2", None)}
    assert not dangling(e, "order_items", e.schema["order_items"].edge("orders")).collect()


def test_alternate_key_and_no_recursion(spark):
    _, got = kept(spark, X.SHOP, X.shop, Request.of("shops", ["shop 2"], ids_field="name"))
    assert got["users"] == [3, 4] and got["products"] == [4, 5, 6]
    _, got = kept(spark, X.SHOP, X.shop, Request.of("users", ["1"], recursive=False))
    assert got == {"users": [1]}
    with pytest.raises(ConfigError, match="x1"):
        kept(spark, X.SHOP, X.shop, Request.of("shops", ["x1"]))


@pytest.mark.parametrize("target", [None, "loans"])
def test_scope(spark, target):
    _, got = kept(spark, X.SCOPED, X.scoped, Request.of(target, [1]))
    assert got == {"members": [1, 3], "loans": [1, 2, 4], "loan_books": [1, 2, 4, 5], "genres": [1, 2], "stamps": [1, 2, 5, 7], "fines": [1, 2, 5]}


def test_batches_equal_the_unbatched_run(spark):
    objects = [o | {"batch_scope": {"table": "loans", "size": 2}} if o["name"] == "loan_books" else o for o in X.SCOPED]
    e, _ = kept(spark, objects, X.scoped, Request.of(ids=[1]))
    rows = sorted((r.id, r.batch) for r in e.batched("loan_books").collect())
    assert rows == [(1, 0), (2, 0), (4, 1), (5, 1)]
    assert "batches of 2 keys of loans" in e.explain()


def test_spaces(spark):
    _, got = kept(spark, X.SPACES, X.spaces, Request.of(ids={"default": [1], "org": ["G1"]}))
    assert got == {"tenants": [1], "projects": [1, 2], "guilds": ["G1"], "artisans": [1, 3]}
    for ids in ({"default": [1]}, {"default": [1], "org": ["G1"], "other": [2]}):
        with pytest.raises(ConfigError, match="ID space"):
            kept(spark, X.SPACES, X.spaces, Request.of(ids=ids))


@pytest.mark.parametrize("most", [100_000, 2])
def test_tree(spark, monkeypatch, most):
    monkeypatch.setattr(lower, "MOST_DRIVER_LINKS", most)
    e, got = kept(spark, X.TREE, X.tree, Request.of(ids=["t1"]))
    assert got["categories"] == [1, 2, 3, 4, 5, 6, 7] and got["notes"] == list(range(101, 108))
    assert e.plans["categories"].rule == "reverse_scope+ancestors"


def test_two_links_and_a_referenced_column(spark):
    link = {"foreign_key": "other_code", "table_name": "nodes", "references": "code"}
    objects = [X.t("nodes", ["id", "parent_id", "code", "other_code"], [("parent_id", "nodes")])]
    objects[0]["belongs_tos"].append(link)
    rows = [(1, None, "a", None), (2, 1, "b", None), (3, 2, "c", "d"), (4, None, "d", "e"), (5, None, "e", None), (6, None, "f", None)]
    source = lambda s: X.frames(s, {"nodes": ("id long, parent_id long, code string, other_code string", rows)})
    for most in (100_000, 0):
        lower.MOST_DRIVER_LINKS, old = most, lower.MOST_DRIVER_LINKS
        try:
            _, got = kept(spark, objects, source, Request.of("nodes", [3]))
        finally:
            lower.MOST_DRIVER_LINKS = old
        assert got == {"nodes": [1, 2, 3, 4, 5]}


def test_documents(spark):
    e, got = kept(spark, X.DOCUMENTS, X.documents, Request.of("clubs", ["north"]))
    assert got == {"clubs": ["north"], "matches": ["m1", "m2", "m3"], "trainings": ["t1", "t2"], "people": ["ann", "bob", "cy"], "licences": ["l-ann", "l-bob", "l-cy"]}
    assert {r["_id"]: r["name"] for r in e.masked("people").collect()} == {"ann": "masked-ann", "bob": "masked-bob", "cy": None}


def test_document_anchor_is_the_smallest_and_others_allow_null(spark):
    objects = [X.d("roots", ["_id"]), X.d("small", ["_id", "root"], [("root", "roots")]), X.d("large", ["_id", "root"], [("root", "roots")]), X.d("leaves", ["_id", "s", "l"], [("l", "large"), ("s", "small")])]
    data = {
        "roots": ("_id string", [("r",)]), "small": ("_id string, root string", [("s1", "r")]), "large": ("_id string, root string", [("l1", "r"), ("l2", "r")]),
        "leaves": ("_id string, s string, l string", [("1", "s1", "l1"), ("2", "s1", None), ("3", None, "l1"), ("4", "s1", "zz"), ("5", "zz", "l1")]),
    }
    e, got = kept(spark, objects, lambda s: X.frames(s, data), Request.of("roots", ["r"]))
    assert got["leaves"] == ["1", "2"] and e.plans["leaves"].rule == "genuine"
    _, got = kept(spark, objects, lambda s: X.frames(s, data), Request.of("roots", ["none"]))
    assert got["leaves"] == [] and got["small"] == []


def test_values_of_many_ids_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lower, "MOST_LITERALS", 2)
    _, got = kept(spark, X.SHOP, X.shop, Request.of("shops", ["1", "2", "3"]))
    assert got["shops"] == [1, 2, 3] and got["products"] == list(range(1, 10))
    df = lower.among(X.shop(spark)("shops"), "id", [])
    assert df.collect() == []


def test_parallel_writes(spark, tmp_path):
    e, got = kept(spark, X.SHOP, X.shop, Request.of("shops", [1]))
    n = e.write_parallel(str(tmp_path))
    assert n == {k: len(v) for k, v in got.items()}
    assert X.ids(spark.read.parquet(str(tmp_path / "orders.parquet"))) == [3, 4, 5, 6]


def test_plan_pushes_filters_into_the_scan(spark):
    from tessera.queries import QUERIES

    plan = QUERIES["flagship"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(c_nationkey, [3,4])" in plan and "o_orderdate" not in plan.split("== Physical Plan ==")[1]


def test_keys_of_array_fields(spark):
    objects = [X.d("roots", ["_id"]), X.d("lists", ["_id", "root", "members"], [("root", "roots")]), X.d("people", ["_id"], reverse_scope={"via": [{"table": "lists", "column": "members"}]})]
    data = {"roots": ("_id string", [("r",)]), "lists": ("_id string, root string, members array<string>", [("1", "r", ["a", "b", None]), ("2", "x", ["c"]), ("3", "r", None)]), "people": ("_id string", [("a",), ("b",), ("c",)])}
    _, got = kept(spark, objects, lambda s: X.frames(s, data), Request.of("roots", ["r"]))
    assert got["people"] == ["a", "b"]


def test_reference_documents_are_narrowed_by_all_parents(spark):
    """By every parent with kept keys, in full or not; without any by nothing at all."""
    objects = [X.d("roots", ["_id"]), X.d("tags", ["_id"]), X.d("none", ["_id"]), X.d("labels", ["_id", "tag", "other"], [("tag", "tags"), ("other", "none")]), X.d("loose", ["_id", "other"], [("other", "none")])]
    data = {
        "roots": ("_id string", [("r",)]), "tags": ("_id long", [(1,), (2,)]), "none": ("_id long", []),
        "labels": ("_id long, tag long, other long", [(1, 1, None), (2, None, 1), (3, 99, 1)]), "loose": ("_id long, other long", [(1, None), (2, 1)]),
    }
    e, got = kept(spark, objects, lambda s: X.frames(s, data), Request.of("roots", ["r"]))
    assert got["labels"] == [1] and got["loose"] == [] and got["tags"] == [1, 2]
    assert e.plans["loose"].rule == "nothing"


def test_document_ids_of_another_type_are_errors(spark):
    source = X.frames(spark, {"roots": ("_id long", [(1,), (2,)])})
    with pytest.raises(C.ConfigError, match="abc"):
        Extraction(X.schema([X.d("roots", ["_id"])]), Request.of("roots", ["abc", 1]), source)


def test_explaining_documents_counts_nothing(spark):
    source = X.documents(spark)
    read = []

    def watched(name):
        read.append(name)
        return source(name)

    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    e = Extraction(X.schema(X.DOCUMENTS), Request.of("clubs", ["north"]), watched, measure=False)
    assert "matches: genuine" in e.explain() and spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
