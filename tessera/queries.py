"""Queries of the engine on the driver's tables, one or more for each operator, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog as K
from . import config as C
from .engine import Extraction, union_tagged
from .functions import masks, pools
from .graph import load_order
from .operators.lower import Lowering, among, semi, with_ancestors
from .patch import mask_update
from .plans.nodes import All, In, KeysOf, Nothing
from .plans.resolver import Request
from .sinks.escape import copy_line, json_line, tuple_text
from .shared import shared_dir
from .sinks.writer import chunk_rows
from .sources import open_source

Query = Callable[[SparkSession, str], DataFrame]
COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id"}
RELATIONS = {
    "nation": [("n_regionkey", "region")],
    "customer": [("c_nationkey", "nation")],
    "supplier": [("s_nationkey", "nation")],
    "orders": [("o_custkey", "customer")],
    "lineitem": [("l_orderkey", "orders"), ("l_partkey", "part"), ("l_suppkey", "supplier")],
    "events": [("user_id", "customer")],
}
SCOPE = [3, 4]


def table(name: str, relations: list | None = None, columns: list | None = None, **rest) -> dict:
    """A table's JSON object; relations are (column, parent) or objects, columns names or objects."""
    relations = RELATIONS.get(name, []) if relations is None else relations
    return {
        "name": name,
        "primary_key": rest.pop("primary_key", KEYS.get(name)),
        "belongs_tos": [r if isinstance(r, dict) else {"foreign_key": r[0], "table_name": r[1]} for r in relations],
        "columns": [c if isinstance(c, dict) else {"name": c} for c in (columns or COLUMNS[name])],
    } | rest


def source(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """The driver's tables, and shapes derived from them: a tree of parts and polymorphic events."""

    def read(name: str) -> DataFrame:
        if name == "part_tree":
            parent = F.when(F.col("p_partkey") == 0, None).otherwise(F.floor(F.col("p_partkey") / 2)).cast("long")
            return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", parent.alias("parent_id"), "p_brand", "p_size")
        if name == "events_poly":
            kind = F.element_at(F.array(F.lit("Customer"), F.lit("Supplier"), F.lit("Part")), (F.col("event_id") % 3 + 1).cast("int"))
            rid = F.col("event_id") % 100
            own = [F.when(kind == k, rid).alias(c) for k, c in (("Customer", "customer_id"), ("Supplier", "supplier_id"), ("Part", "part_id"))]
            return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", kind.alias("rtype"), rid.alias("rid"), *own)
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    return read


EVENTS_SQL = """SELECT event_id, rtype, rid, CASE WHEN rtype = 'Customer' THEN rid END AS customer_id, CASE WHEN rtype = 'Supplier' THEN rid END AS supplier_id, CASE WHEN rtype = 'Part' THEN rid END AS part_id
    FROM (SELECT event_id, ['Customer', 'Supplier', 'Part'][CAST(event_id % 3 + 1 AS INT)] AS rtype, event_id % 100 AS rid FROM events)"""
TREE_SQL = "SELECT p_partkey, CASE WHEN p_partkey = 0 THEN NULL ELSE p_partkey // 2 END AS parent_id, p_brand, p_size FROM part"


def extraction(spark: SparkSession, sf_dir: str, tables: list[dict], request: Request, **options) -> Extraction:
    return Extraction(C.build_schema(tables), request, source(spark, sf_dir), **options)


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def _kept(name: str, sql: str, kept: str, tables: Callable[[], list[dict]], request: Request, **options) -> None:
    """A query that returns a table's kept rows."""
    query(name, sql)(lambda spark, d: extraction(spark, d, tables(), request, **options).rows(kept))


THREE = Request.of("customer", [1, 2, 3])
BASE = lambda *more: [table("region"), table("nation"), table("customer", []), table("orders"), table("lineitem", [("l_orderkey", "orders")]), *more]
SCOPED = lambda **rest: [table("customer", [], scope_column="c_nationkey"), table("orders", **rest), table("lineitem", [("l_orderkey", "orders")])]
IN_SCOPE = "(SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 4))"

_kept("e01_target_pk", "SELECT * FROM customer WHERE c_custkey IN (1, 2, 3)", "customer", BASE, THREE)
_kept("b09_ids_field", "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "orders", BASE, Request.of("customer", ["BUILDING"], ids_field="c_mktsegment"))
_kept("e02_target_fk", "SELECT * FROM orders WHERE o_custkey IN (1, 2, 3)", "orders", BASE, THREE)
_kept("e03_path_two_hops", "SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3))", "lineitem", BASE, THREE)
_kept(
    "b06_filter_inherited", "SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3) AND o_totalprice > 100000)", "lineitem",
    lambda: [table("customer", []), table("orders", filter="orders.o_totalprice > 100000"), table("lineitem", [("l_orderkey", "orders")])], THREE,
)
_kept("b05_own_filter", "SELECT * FROM orders WHERE o_custkey IN (1, 2, 3) AND o_totalprice > 100000", "orders", lambda: [table("customer", []), table("orders", filter="orders.o_totalprice > 100000")], THREE)
_kept("b07_filter_always", "SELECT * FROM customer WHERE c_custkey IN (1, 2, 3) AND c_acctbal > 0", "customer", lambda: [table("customer", [], filter="customer.c_acctbal > 0")], THREE, apply_filters="always")
_kept("e04_scope_direct", "SELECT * FROM customer WHERE c_nationkey IN (3, 4)", "customer", SCOPED, Request.of(ids=SCOPE))
_kept("e05_scope_path", f"SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN {IN_SCOPE})", "lineitem", SCOPED, Request.of(ids=SCOPE))


def poly(separate: bool) -> list[dict]:
    arms = [("Customer", "customer", "customer_id"), ("Supplier", "supplier", "supplier_id"), ("Part", "part", "part_id")]
    relations = [{"table_name": t, "foreign_key": c if separate else "rid", "foreign_type": "rtype", "type_value": k} for k, t, c in arms]
    events = table("events_poly", relations, ["event_id", "rtype", "rid", "customer_id", "supplier_id", "part_id"], primary_key="event_id")
    return [table("customer", [], scope_column="c_nationkey"), table("supplier", [], scope_column="s_nationkey"), table("part", [], scope_exempt=True), events]


ARMS_SQL = f"""SELECT * FROM ({EVENTS_SQL}) WHERE rtype = 'Customer' AND rid IN {IN_SCOPE}
    OR rtype = 'Supplier' AND rid IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (3, 4))"""
_kept("e06_poly_arms", ARMS_SQL, "events_poly", lambda: poly(False), Request.of(ids=SCOPE))
_kept("e06_poly_separate_fk", ARMS_SQL, "events_poly", lambda: poly(True), Request.of(ids=SCOPE))
_kept(
    "b08_type_predicate", f"SELECT * FROM ({EVENTS_SQL}) WHERE rtype = 'Customer' AND rid IN (1, 2, 3)", "events_poly",
    lambda: [table("customer", []), table("events_poly", [{"table_name": "customer", "foreign_key": "rid", "foreign_type": "rtype", "type_value": "Customer"}], ["event_id", "rtype", "rid"], primary_key="event_id")], THREE,
)


def reverse_nation(column: str | None = None) -> dict:
    return table("nation", [], reverse_scope={"via": [{"table": "customer", "column": "c_nationkey"}, {"table": "supplier", "column": "s_nationkey"}]} | ({"column": column} if column else {}))


_kept(
    "e07_arm_target_query",
    f"""SELECT * FROM ({EVENTS_SQL}) WHERE rtype = 'Customer' AND rid IN {IN_SCOPE}
        OR rtype = 'Part' AND rid IN (SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN {IN_SCOPE})))""",
    "events_poly",
    lambda: [
        table("customer", [], scope_column="c_nationkey"), table("orders"), table("lineitem", [("l_orderkey", "orders")]),
        table("part", [], reverse_scope={"via": [{"table": "lineitem", "column": "l_partkey"}]}),
        table("events_poly", [{"table_name": t, "foreign_key": "rid", "foreign_type": "rtype", "type_value": k} for k, t in (("Customer", "customer"), ("Part", "part"))], ["event_id", "rtype", "rid"], primary_key="event_id"),
    ],
    Request.of(ids=SCOPE),
)
_kept(
    "e09_referenced_by", "SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3)))", "part",
    lambda: [*BASE()[2:4], table("lineitem", [("l_orderkey", "orders"), ("l_partkey", "part")]), table("part", [])], THREE,
)
_kept(
    "e10_ambiguous_full", "SELECT * FROM nation", "nation",
    lambda: [table("nation", []), table("supplier"), table("customer", [("c_nationkey", "nation")]), table("orders"), table("lineitem", [("l_orderkey", "orders"), ("l_suppkey", "supplier")])],
    Request.of("orders", [1, 2, 3, 4, 5]),
)
_kept(
    "e11_reverse_union", "SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (1, 2, 3) UNION SELECT s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3))))", "nation",
    lambda: [reverse_nation(), table("customer", []), table("orders"), table("supplier", [], reverse_scope={"via": [{"table": "lineitem", "column": "l_suppkey"}]}), table("lineitem", [("l_orderkey", "orders")])], THREE,
)
_kept(
    "e11_reverse_column", "SELECT * FROM region WHERE r_name IN (SELECT n_name FROM nation WHERE n_nationkey IN (3, 4)) OR r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (3, 4))", "region",
    lambda: [table("region", [], reverse_scope={"column": "r_regionkey", "via": [{"table": "nation", "column": "n_regionkey"}]}), table("nation", [])], Request.of("nation", SCOPE),
)
_kept(
    "e12_cascade", "SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (1, 2, 3)))", "supplier",
    lambda: [table("nation", [], reverse_scope={"via": [{"table": "customer", "column": "c_nationkey"}]}), table("customer", []), table("supplier")], THREE,
)

TREE = lambda **rest: table("part_tree", [("parent_id", "part_tree")], ["p_partkey", "parent_id", "p_brand", "p_size"], primary_key="p_partkey", **rest)
CLOSURE_SQL = f"WITH RECURSIVE tree AS ({TREE_SQL}), up AS (SELECT p_partkey, parent_id FROM tree WHERE p_partkey IN (170, 999, 42) UNION SELECT t.p_partkey, t.parent_id FROM tree AS t JOIN up ON t.p_partkey = up.parent_id)"
_kept("e14_closure", f"{CLOSURE_SQL} SELECT * FROM tree WHERE p_partkey IN (SELECT p_partkey FROM up)", "part_tree", lambda: [TREE()], Request.of("part_tree", [170, 999, 42]))
_kept("e15_tree_child", f"{CLOSURE_SQL} SELECT * FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM up)", "lineitem", lambda: [TREE(), table("lineitem", [("l_partkey", "part_tree")])], Request.of("part_tree", [170, 999, 42]))
_kept("e16_exempt", "SELECT * FROM region", "region", lambda: [*SCOPED(), table("region", [], scope_exempt=True)], Request.of(ids=SCOPE))
_kept("e17_full_dump", "SELECT * FROM benchmark", "benchmark", lambda: [table("customer", []), table("benchmark", [], ["item_id", "text"], primary_key="item_id")], THREE)
_kept("a05_managed_scan", "SELECT * FROM region", "region", lambda: [table("customer", []), {"name": "region", "type": "rails_managed_schema_migrations"}], THREE)
_kept("e22_no_recursive", "SELECT * FROM customer WHERE c_custkey IN (1, 2, 3)", "customer", BASE, Request.of("customer", [1, 2, 3], recursive=False))


@query("d05_closure_distributed", f"{CLOSURE_SQL} SELECT * FROM tree WHERE p_partkey IN (SELECT p_partkey FROM up)")
def d05(spark: SparkSession, d: str) -> DataFrame:
    from .operators import lower

    tree = source(spark, d)("part_tree")
    found = lower._walk(tree, among(tree, "p_partkey", [170, 999, 42]), "p_partkey", (("parent_id", "p_partkey"),))
    base = among(tree, "p_partkey", [170, 999, 42]).select(F.col("p_partkey").alias("__key"))
    return semi(tree, "p_partkey", base.union(found).distinct())


@query("c03_semi_join_not_null", "SELECT * FROM customer WHERE nullif(c_custkey % 7, 0) IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def c03(spark: SparkSession, d: str) -> DataFrame:
    read = source(spark, d)
    keys = read("nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("__key"))
    rows = read("customer").withColumn("k", F.expr("nullif(c_custkey % 7, 0)"))
    return semi(rows, "k", keys).drop("k")


@query("c05_type_coerced_join", "SELECT * FROM orders WHERE CAST(o_custkey AS VARCHAR) IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 3)")
def c05(spark: SparkSession, d: str) -> DataFrame:
    read = source(spark, d)
    return semi(read("orders"), "o_custkey", read("customer").where("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("__key")))


@query("e21_id_spaces", "SELECT 'customer' AS table_name, c_custkey AS id FROM customer WHERE c_nationkey IN (3, 4) UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_nationkey IN (7, 8, 9)")
def e21(spark: SparkSession, d: str) -> DataFrame:
    tables = [table("customer", [], scope_column="c_nationkey"), table("supplier", [], scope_column="s_nationkey", id_space="sup")]
    x = extraction(spark, d, tables, Request.of(ids={"default": SCOPE, "sup": [7, 8, 9]}))
    return union_tagged({"customer": x.rows("customer").select(F.col("c_custkey").alias("id")), "supplier": x.rows("supplier").select(F.col("s_suppkey").alias("id"))})


@query("e23_classify", "SELECT * FROM (VALUES ('customer', 'direct'), ('orders', 'via_path'), ('lineitem', 'via_path'), ('part', 'referenced_by'), ('region', 'exempt'), ('nation', 'referenced_by'), ('supplier', 'via_scoped_parent')) AS t(table_name, category)")
def e23(spark: SparkSession, d: str) -> DataFrame:
    tables = [
        table("customer", [("c_nationkey", "nation")], scope_column="c_nationkey"), table("orders"), table("lineitem", [("l_orderkey", "orders"), ("l_partkey", "part")]),
        table("part", []), table("region", [], scope_exempt=True), table("nation", [], reverse_scope={"via": [{"table": "customer", "column": "c_nationkey"}]}), table("supplier"),
    ]
    return extraction(spark, d, tables, Request.of(ids=SCOPE)).classify(spark)


@query("a06_counts", f"SELECT 'customer' AS table_name, count(*) AS n FROM customer WHERE c_nationkey IN (3, 4) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN {IN_SCOPE} UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN {IN_SCOPE})")
def a06(spark: SparkSession, d: str) -> DataFrame:
    return extraction(spark, d, SCOPED(), Request.of(ids=SCOPE)).counts()


@query("a04_json_documents", "SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user'")
def a04(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines, and read as a source of collections by their schema."""
    rows = spark.read.parquet(f"{d}/conversations.parquet").where("role = 'user'").select("conv_id", "turn", "role", "text")
    at = f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"
    rows.select(json_line(rows.schema).alias("value")).write.text(f"{at}/conversations.jsonl")
    return open_source(spark, "mongodb", at, schemas={"conversations": rows.schema})("conversations")


@query("g04_batched", f"SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN {IN_SCOPE})")
def g04(spark: SparkSession, d: str) -> DataFrame:
    tables = [*SCOPED()[:2], table("lineitem", [("l_orderkey", "orders")], batch_scope={"table": "customer", "size": 10})]
    return extraction(spark, d, tables, Request.of(ids=SCOPE)).batched("lineitem").drop("batch")


@query("g04_batch_numbers", "SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 10 AS batch FROM customer WHERE c_nationkey IN (3, 4)")
def g04_numbers(spark: SparkSession, d: str) -> DataFrame:
    tables = [table("customer", [], scope_column="c_nationkey", batch_scope={"table": "customer", "size": 10})]
    return extraction(spark, d, tables, Request.of(ids=SCOPE)).batched("customer").select("c_custkey", "batch")


@query("g07_chunks", "SELECT chunk, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders) GROUP BY 1")
def g07(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each statement of at most the table's chunk."""
    from .operators.lower import batches

    t = C.parse_table(table("orders", bulk_insert_chunk_size=1000))
    return batches(source(spark, d)("orders"), "o_orderkey", chunk_rows(t)).groupBy(F.col("batch").alias("chunk")).agg(F.count("*").alias("n"))


# Masks


def _masked(spark: SparkSession, d: str, columns: list, name: str = "customer", dialect: str = "null") -> DataFrame:
    t = C.parse_table(table(name, [], columns))
    return masks.apply_masks(source(spark, d)(name), t, dialect)


def _mask_query(name: str, sql: str, columns: list, of: str = "customer") -> None:
    query(name, sql)(lambda spark, d: _masked(spark, d, columns, of))


_mask_query("b01_project", "SELECT c_custkey, c_name FROM customer", ["c_custkey", "c_name", {"name": "c_acctbal", "ignore": True}])
_mask_query("h01_template", "SELECT c_custkey, 'user' || c_custkey || '@example.com' AS c_name FROM customer", ["c_custkey", {"name": "c_name", "replace_with": "user{c_custkey}@example.com"}])
_mask_query("h01_cross_column", "SELECT c_custkey, c_mktsegment || '-' || c_nationkey || '{}' AS c_name, c_nationkey, c_mktsegment FROM customer", ["c_custkey", {"name": "c_name", "replace_with": "{c_mktsegment}-{c_nationkey}{}"}, "c_nationkey", "c_mktsegment"])
_mask_query("h03_scalar", "SELECT c_custkey, CAST(0 AS DOUBLE) AS c_acctbal, CAST(7 AS INT) AS c_nationkey FROM customer", ["c_custkey", {"name": "c_acctbal", "replace_with": 0}, {"name": "c_nationkey", "replace_with": 7}])
_mask_query("h04_raw_sql", "SELECT c_custkey, upper(c_name) || '!' AS c_name FROM customer", ["c_custkey", {"name": "c_name", "raw_sql": "upper(customer.c_name) || '!'"}])
_mask_query("h15_unset", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name FROM customer", ["c_custkey", {"name": "c_name", "unset": True}])
_mask_query("h16_two_phase", "SELECT c_custkey, c_mktsegment AS c_name, c_name AS c_mktsegment FROM customer", ["c_custkey", {"name": "c_name", "replace_with": "{c_mktsegment}"}, {"name": "c_mktsegment", "replace_with": "{c_name}"}])


@query("h02_null_reference", "SELECT c_custkey, 'k' || CAST(nullif(c_custkey % 7, 0) AS VARCHAR) AS a, 'k' || coalesce(CAST(nullif(c_custkey % 7, 0) AS VARCHAR), '') AS b FROM customer")
def h02(spark: SparkSession, d: str) -> DataFrame:
    rows = source(spark, d)("customer").withColumn("k", F.expr("nullif(c_custkey % 7, 0)"))
    return rows.select("c_custkey", masks.template("k{k}").alias("a"), masks.template("k{k}", "empty").alias("b"))


def _upper_three(row: dict) -> str:
    return row["c_name"].upper()[:3]


@query("h05_map", "SELECT c_custkey, upper(substr(c_name, 1, 3)) AS c_name FROM customer")
def h05(spark: SparkSession, d: str) -> DataFrame:
    masks.register_map("upper_three", _upper_three)
    return _masked(spark, d, ["c_custkey", {"name": "c_name", "map": "upper_three"}])


@query("h06_fake_index", "SELECT c_custkey, CAST(CAST('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16) AS UBIGINT) % 10000 AS INT) AS idx, substr(sha256(CAST(c_custkey AS VARCHAR)), 17, 16) AS token FROM customer")
def h06(spark: SparkSession, d: str) -> DataFrame:
    return source(spark, d)("customer").select("c_custkey", pools.index(F.col("c_custkey"), 10_000).alias("idx"), pools.token(F.col("c_custkey")).alias("token"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_PERSON = f"CAST(CAST('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16) AS UBIGINT) % {pools.PERSONS} AS INT)"
_FIRST, _LAST = f"{_sql_list(pools.lists('en')['first'])}[p % {pools.NAMES} + 1]", f"{_sql_list(pools.lists('en')['last'])}[(p // {pools.NAMES} + p) % {pools.NAMES} + 1]"
_FAKE = lambda kind, locale="en": {"name": "c_name", "replace_with_fake_data": {"seed": "customer.c_custkey", "type": kind, "locale": locale}}
_mask_query("h08_person", f"SELECT c_custkey, {_FIRST} || ' ' || {_LAST} AS c_name FROM (SELECT c_custkey, {_PERSON} AS p FROM customer)", ["c_custkey", _FAKE("human_name")])
_JA = pools.lists("ja")
_mask_query("h09_person_kana", f"SELECT c_custkey, {_sql_list(_JA['last_kana'])}[(p // {pools.NAMES} + p) % {pools.NAMES} + 1] || ' ' || {_sql_list(_JA['first_kana'])}[p % {pools.NAMES} + 1] AS c_name FROM (SELECT c_custkey, {_PERSON} AS p FROM customer)", ["c_custkey", _FAKE("human_name_kana", "ja")])
_mask_query("h11_email", f"SELECT c_custkey, lower({_FIRST} || '.' || {_LAST}) || '.' || substr(sha256(CAST(c_custkey AS VARCHAR)), 17, 16) || '@example.com' AS c_name FROM (SELECT c_custkey, {_PERSON} AS p FROM customer)", ["c_custkey", _FAKE("email")])


@query("h10_other_pools", "SELECT count(*) AS n, count(*) AS phones, count(*) AS addresses, count(*) AS companies FROM customer")
def h10(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    made = source(spark, d)("customer").select(pools.value("phone_number", k).alias("p"), pools.value("address", k).alias("a"), pools.value("company_name", k).alias("c"))
    return made.agg(F.count("*").alias("n"), F.count_if(F.col("p").rlike(r"^\(555\) \d{3}-\d{4}$")).alias("phones"), F.count_if(F.col("a").rlike(r"^\d+ \w+ \w+, \w+$")).alias("addresses"), F.count_if(F.col("c").rlike(r"^\w+-\w+ \w+")).alias("companies"))


@query("h14_random", "SELECT 64 AS length, count(*) AS n, count(*) AS distinct_values FROM customer")
def h14(spark: SparkSession, d: str) -> DataFrame:
    made = _masked(spark, d, ["c_custkey", {"name": "c_name", "replace_with_random": "hex:32"}])
    return made.groupBy(F.length("c_name").alias("length")).agg(F.count("*").alias("n"), F.count_distinct("c_name").alias("distinct_values"))


@query("h18_embedded", "SELECT conv_id, turn, 'masked-' || turn AS text FROM conversations")
def h18(spark: SparkSession, d: str) -> DataFrame:
    turns = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "text")).alias("turns"))
    t = C.parse_table({"name": "conversations", "primary_key": "conv_id", "fields": [{"name": "conv_id"}]})
    inner = C.parse_table({"name": "turns", "primary_key": "turn", "embedded_in": {"collection_name": "conversations", "path": "turns"}, "fields": [{"name": "turn"}, {"name": "text", "replace_with": "masked-{turn}"}]})
    return masks.mask_document(turns, t, [inner]).select("conv_id", F.explode("turns").alias("x")).select("conv_id", "x.turn", "x.text")


_QUOTED = "'''' || replace({0}, '''', '''''') || ''''"


@query("h20_sql_literal", "SELECT c_custkey, '(' || c_custkey || ', ' || " + _QUOTED.format("c_name || '''s'") + " || ', NULL, ' || c_nationkey || ')' AS line FROM customer")
def h20(spark: SparkSession, d: str) -> DataFrame:
    rows = source(spark, d)("customer").select("c_custkey", F.concat("c_name", F.lit("'s")).alias("c_name"), F.lit(None).cast("string").alias("x"), "c_nationkey")
    return rows.select("c_custkey", tuple_text([(f.name, f.dataType) for f in rows.schema.fields], "postgresql").alias("line"))


@query("h20_mysql_literal", "SELECT c_custkey, '(''a\\\\b\\nc' || c_name || ''')' AS line FROM customer")
def h20_mysql(spark: SparkSession, d: str) -> DataFrame:
    rows = source(spark, d)("customer").select("c_custkey", F.concat(F.lit("a\\b\nc"), "c_name").alias("x"))
    return rows.select("c_custkey", tuple_text([("x", rows.schema["x"].dataType)], "mysql").alias("line"))


@query("h21_copy_line", "SELECT c_custkey, c_custkey || chr(9) || 'a\\tb\\\\' || c_name || chr(9) || '\\N' AS line FROM customer")
def h21(spark: SparkSession, d: str) -> DataFrame:
    rows = source(spark, d)("customer").select("c_custkey", F.concat(F.lit("a\tb\\"), "c_name").alias("x"), F.lit(None).cast("string").alias("y"))
    return rows.select("c_custkey", copy_line([(f.name, f.dataType) for f in rows.schema.fields]).alias("line"))


@query("h22_stringify", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at FROM orders")
def h22(spark: SparkSession, d: str) -> DataFrame:
    from .sinks.escape import text

    rows = source(spark, d)("orders")
    return rows.select("o_orderkey", text(F.col("o_orderdate"), rows.schema["o_orderdate"].dataType).alias("at"))


@query("h23_ext_json", "SELECT c_custkey, '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\",\"x\":null}' AS line FROM customer")
def h23(spark: SparkSession, d: str) -> DataFrame:
    rows = source(spark, d)("customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("x"))
    return rows.select("c_custkey", json_line(rows.schema).alias("line"))


# Documents, patches, config


@query("b11_null_aware", "SELECT * FROM (SELECT o_orderkey, o_custkey, nullif(o_orderkey % 5, 0) AS k FROM orders) WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND (k IN (1, 2) OR k IS NULL)")
def b11(spark: SparkSession, d: str) -> DataFrame:
    read = source(spark, d)
    frames = {
        "orders": read("orders").select("o_orderkey", "o_custkey", F.expr("nullif(o_orderkey % 5, 0)").alias("k")),
        "customer": read("customer").where("c_nationkey = 3"),
        "nation": among(read("nation"), "n_nationkey", [1, 2]),
    }
    node = In(In(All("orders"), "o_custkey", KeysOf(All("customer"), "c_custkey")), "k", KeysOf(All("nation"), "n_nationkey"), or_null=True)
    return Lowering(frames.__getitem__).rows(node)


@query("b12_match_nothing", "SELECT * FROM customer WHERE false")
def b12(spark: SparkSession, d: str) -> DataFrame:
    return Lowering(source(spark, d)).rows(Nothing("customer"))


@query("e30_document_anchor", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 4))")
def e30(spark: SparkSession, d: str) -> DataFrame:
    """Document narrowing over two hops from nations."""
    docs = lambda name, relations, fields: {"name": name, "primary_key": KEYS[name], "belongs_tos": [{"foreign_key": c, "table_name": p} for c, p in relations], "fields": [{"name": f} for f in fields]}
    objects = [docs("nation", [], COLUMNS["nation"]), docs("customer", [("c_nationkey", "nation")], COLUMNS["customer"]), docs("orders", [("o_custkey", "customer")], ["o_orderkey", "o_custkey"])]
    return Extraction(C.build_schema(objects), Request.of("nation", ["3", "4"]), source(spark, d)).masked("orders")


PATCHED = [table("customer", [], ["c_custkey", {"name": "c_name", "replace_with": "m{c_custkey}"}, {"name": "c_acctbal", "replace_with": 0}, "c_mktsegment", "c_nationkey"])]


@query("i06_mask_update", "SELECT c_custkey, 'm' || c_custkey AS c_name, CAST(0 AS DOUBLE) AS c_acctbal FROM customer WHERE c_custkey IN (1, 2, 3)")
def i06(spark: SparkSession, d: str) -> DataFrame:
    return mask_update(C.build_schema(PATCHED), source(spark, d), "customer", [1, 2, 3, 10**12]).frame


@query("i06_merged", "SELECT c_custkey, CASE WHEN c_custkey IN (1, 2, 3) THEN 'm' || c_custkey ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey IN (1, 2, 3) THEN 0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def i06_merged(spark: SparkSession, d: str) -> DataFrame:
    read = source(spark, d)
    return mask_update(C.build_schema(PATCHED), read, "customer", [1, 2, 3]).merged(read("customer"))


@query("i06_update_text", "SELECT 'UPDATE customer SET c_name = ''m' || c_custkey || ''', c_acctbal = 0.0 WHERE c_custkey = ' || c_custkey || ';' AS value FROM customer WHERE c_custkey IN (1, 2, 3)")
def i06_text(spark: SparkSession, d: str) -> DataFrame:
    return mask_update(C.build_schema(PATCHED), source(spark, d), "customer", [1, 2, 3]).statements("sqlite")


@query("i09_missing_keys", "SELECT CAST(1000000000000 AS BIGINT) AS c_custkey")
def i09(spark: SparkSession, d: str) -> DataFrame:
    return mask_update(C.build_schema(PATCHED), source(spark, d), "customer", [1, 2, 3, 10**12]).missing()


@query("k08_drift", "SELECT * FROM (VALUES ('added_columns', 'nation.n_regionkey'), ('removed_columns', 'nation.n_gone'), ('changed_tables', 'nation'), ('stale_columns', 'nation.n_gone'), ('added_tables', 'region')) AS t(kind, name)")
def k08(spark: SparkSession, d: str) -> DataFrame:
    read = source(spark, d)
    found = K.introspect({n: read(n) for n in ("nation", "region")}, {"nation": "n_nationkey", "region": "r_regionkey"})
    old = {"nation": table("nation", [], ["n_nationkey", "n_name", "n_gone"])}
    return K.report_frame(spark, K.drift(found, old))


@query("k09_static", "SELECT * FROM (VALUES ('unmasked_sensitive', 'users.email [base]: looks sensitive and isn''t masked'), ('guessable_credentials', 'users.api_token [base]: a credential masked to a value that can be guessed'), ('integrity', 'users.id [base]: the primary key is masked')) AS t(kind, name)")
def k09(spark: SparkSession, d: str) -> DataFrame:
    users = {"name": "users", "primary_key": "id", "columns": [{"name": "id", "replace_with": 1}, {"name": "email"}, {"name": "api_token", "replace_with": "x"}, {"name": "email_updated_at"}]}
    return K.report_frame(spark, K.static_checks({"users": users}, config=K.CheckConfig.of({"guessable_credentials": True, "unmasked_sensitive": True})))


@query("k02_generate", "SELECT * FROM (VALUES ('n_nationkey', NULL, false), ('n_name', 'masked-{n_nationkey}', true), ('n_regionkey', NULL, false)) AS t(name, replace_with, undecided)")
def k02(spark: SparkSession, d: str) -> DataFrame:
    read = source(spark, d)
    found = K.introspect({"nation": read("nation")}, {"nation": "n_nationkey"}, {"nation": [("n_regionkey", "region")]})
    made = K.generate(found)["nation"]["columns"]
    return spark.createDataFrame([(c["name"], c.get("replace_with"), c.get("needs_mask_decision", False)) for c in made], "name string, replace_with string, undecided boolean")


@query("j10_order", "SELECT * FROM (VALUES (1, 'region'), (2, 'part'), (3, 'nation'), (4, 'customer'), (5, 'supplier'), (6, 'orders'), (7, 'lineitem')) AS t(position, table_name)")
def j10(spark: SparkSession, d: str) -> DataFrame:
    names = ["lineitem", "orders", "customer", "supplier", "region", "nation", "part"]
    order, _ = load_order(C.build_schema([table(n) for n in names]))
    return spark.createDataFrame(list(enumerate(order, 1)), "position int, table_name string")


@query("flagship", f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'order-' || o_orderkey AS o_orderpriority FROM orders WHERE o_custkey IN {IN_SCOPE}")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The masked orders of a tenant's customers."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", {"name": "o_orderpriority", "replace_with": "order-{o_orderkey}"}]
    tables = [table("customer", [], scope_column="c_nationkey"), table("orders", columns=columns)]
    return extraction(spark, d, tables, Request.of(ids=SCOPE)).masked("orders")


def lineitem_copy(spark: SparkSession, d: str, fake: bool) -> DataFrame:
    """A masked full copy of lineitem; with one fake column or none."""
    extra = {"l_linestatus": {"name": "l_linestatus", "replace_with_fake_data": {"seed": "l_orderkey", "type": "email"}}} if fake else {}
    return masks.apply_masks(source(spark, d)("lineitem"), C.parse_table(table("lineitem", [], [extra.get(c, c) for c in COLUMNS["lineitem"]])))


__all__ = ["ORACLES", "QUERIES", "with_ancestors"]
