"""Small schemas with known results, each for a few narrowing rules."""

from decimal import Decimal

from pyspark.sql import SparkSession

from tessera import config as C


def t(name, columns, relations=(), **rest):
    """A table object; relations: (foreign_key, parent) or (foreign_key, parent, type column, type value)."""
    links = [{"foreign_key": r[0], "table_name": r[1]} | ({"foreign_type": r[2], "type_value": r[3]} if len(r) > 2 else {}) for r in relations]
    return {"name": name, "primary_key": "id", "belongs_tos": links, "columns": [c if isinstance(c, dict) else {"name": c} for c in columns]} | rest


def frames(spark: SparkSession, data: dict[str, tuple[str, list]]):
    made = {n: spark.createDataFrame(rows, schema) for n, (schema, rows) in data.items()}
    return made.__getitem__


def ids(df, key="id"):
    return sorted(r[0] for r in df.select(key).collect())


# A shop: a target, a filter on a parent, a polymorphic relation, a table that nothing relates
SHOP = [
    t("shops", ["id", "name"]),
    t("users", ["id", {"name": "name", "raw_sql": "upper(users.name)"}, {"name": "email", "replace_with": "masked{id}@example.com"}, "shop_id"], [("shop_id", "shops")]),
    t("products", ["id", "name", "shop_id"], [("shop_id", "shops")]),
    t("orders", ["id", "shop_id", "user_id"], [("shop_id", "shops"), ("user_id", "users")], filter="orders.id > 2"),
    t("order_items", ["id", "order_id", "product_id"], [("order_id", "orders"), ("product_id", "products")]),
    t("transactions", ["id", "order_id", "amount"], [("order_id", "orders")]),
    t("reviews", ["id", "reviewable_type", "reviewable_id", "user_id"], [("reviewable_id", "products", "reviewable_type", "Product"), ("user_id", "users")]),
    t("system_announcements", ["id", "title"]),
]


def shop(spark):
    orders = [(i, (i - 1) // 6 + 1, (i - 1) // 3 + 1) for i in range(1, 31)]
    return frames(spark, {
        "shops": ("id long, name string", [(i, f"shop {i}") for i in range(1, 6)]),
        "users": ("id long, name string, email string, shop_id long", [(i, f"user {i}", None if i == 2 else f"u{i}@x", (i + 1) // 2) for i in range(1, 11)]),
        "products": ("id long, name string, shop_id long", [(i, f"it's {i}", (i + 2) // 3) for i in range(1, 16)]),
        "orders": ("id long, shop_id long, user_id long", orders),
        "order_items": ("id long, order_id long, product_id long", [(i, i, (i - 1) % 15 + 1) for i in range(1, 31)]),
        "transactions": ("id long, order_id long, amount decimal(10,2)", [(i, i, Decimal(i)) for i in range(1, 31)]),
        "reviews": ("id long, reviewable_type string, reviewable_id long, user_id long", [(1, "Product", 1, 1), (2, "Product", 2, 2), (3, "Product", 3, 1), (4, "Product", 4, 3), (5, "Shop", 1, 5)]),
        "system_announcements": ("id long, title string", [(i, "t") for i in (1, 2, 3)]),
    })


# Scope columns, shared and separate polymorphic keys, a batch: a library with branches
SCOPED = [
    t("members", ["id", "branch_id", "name"], scope_column="branch_id"),
    t("loans", ["id", "branch_id", "days"], scope_column="branch_id"),
    t("loan_books", ["id", "loan_id", "copies"], [("loan_id", "loans")]),
    t("genres", ["id", "code"], scope_exempt=True),
    t("stamps", ["id", "of_type", "of_id", "label"], [("of_id", "members", "of_type", "Member"), ("of_id", "loans", "of_type", "Loan")]),
    t("fines", ["id", "for_type", "member_id", "loan_id"], [("member_id", "members", "for_type", "Member"), ("loan_id", "loans", "for_type", "Loan")]),
]


def scoped(spark):
    return frames(spark, {
        "members": ("id long, branch_id long, name string", [(1, 1, "a"), (2, 2, "b"), (3, 1, "c")]),
        "loans": ("id long, branch_id long, days int", [(1, 1, 7), (2, 1, 14), (3, 2, 21), (4, 1, 28)]),
        "loan_books": ("id long, loan_id long, copies int", [(1, 1, 1), (2, 2, 1), (3, 3, 2), (4, 4, 1), (5, 4, 3)]),
        "genres": ("id long, code string", [(1, "SF"), (2, "PO")]),
        "stamps": ("id long, of_type string, of_id long, label string", [(1, "Member", 1, "m1"), (2, "Loan", 1, "l1"), (3, "Member", 2, "m2"), (4, "Loan", 3, "l3"), (5, "Loan", 2, "l2"), (6, "Member", 9, "m9"), (7, "Member", 3, "m3")]),
        "fines": ("id long, for_type string, member_id long, loan_id long", [(1, "Member", 1, None), (2, "Loan", None, 1), (3, "Member", 2, None), (4, "Loan", None, 3), (5, "Loan", None, 4)]),
    })


# Two ID spaces
SPACES = [
    t("tenants", ["id", "name"], scope_column="id"),
    t("projects", ["id", "tenant_id"], [("tenant_id", "tenants")]),
    t("guilds", ["id", "name"], scope_column="id", id_space="org"),
    t("artisans", ["id", "guild_id", {"name": "email", "replace_with": "m{id}@example.com"}], [("guild_id", "guilds")]),
]


def spaces(spark):
    return frames(spark, {
        "tenants": ("id long, name string", [(1, "a"), (2, "b")]),
        "projects": ("id long, tenant_id long", [(1, 1), (2, 1), (3, 2)]),
        "guilds": ("id string, name string", [("G1", "x"), ("G2", "y")]),
        "artisans": ("id long, guild_id string, email string", [(1, "G1", "e"), (2, "G2", "f"), (3, "G1", None)]),
    })


# A tree with a chain, a cycle, a missing parent and a lone root
TREE = [
    t("categories", ["id", "parent_id", "name"], [("parent_id", "categories")], reverse_scope={"via": [{"table": "products", "column": "category_id"}]}),
    t("products", ["id", "tenant_id", "category_id"], scope_column="tenant_id"),
    t("notes", ["id", "category_id"], [("category_id", "categories")]),
]


def tree(spark):
    return frames(spark, {
        "categories": ("id long, parent_id long, name string", [(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 5, "d"), (5, 4, "e"), (6, None, "f"), (7, 99, "g"), (8, None, "h")]),
        "products": ("id long, tenant_id string, category_id long", [(1, "t1", 3), (2, "t1", 2), (3, "t1", 4), (4, "t1", 6), (5, "t1", 7), (6, "t2", 8)]),
        "notes": ("id long, category_id long", [(100 + c, c) for c in range(1, 9)]),
    })


# Documents: a hub that two collections point at
def d(name, fields, relations=(), **rest):
    links = [{"foreign_key": r[0], "table_name": r[1]} | ({"references": r[2]} if len(r) > 2 else {}) for r in relations]
    return {"name": name, "primary_key": "_id", "belongs_tos": links, "fields": [f if isinstance(f, dict) else {"name": f} for f in fields]} | rest


DOCUMENTS = [
    d("clubs", ["_id"]),
    d("matches", ["_id", "club", "referee"], [("club", "clubs")]),
    d("trainings", ["_id", "club", "coach"], [("club", "clubs")]),
    d("people", ["_id", {"name": "name", "replace_with": "masked-{_id}"}], reverse_scope={"via": [{"table": "matches", "column": "referee"}, {"table": "trainings", "column": "coach"}]}),
    d("licences", ["_id", "person", "grade"], [("person", "people")]),
]


def documents(spark):
    return frames(spark, {
        "clubs": ("_id string", [("north",), ("south",)]),
        "matches": ("_id string, club string, referee string", [("m1", "north", "ann"), ("m2", "north", "bob"), ("m3", "north", None), ("m4", "south", "dan")]),
        "trainings": ("_id string, club string, coach string", [("t1", "north", "bob"), ("t2", "north", "cy"), ("t3", "south", "eve")]),
        "people": ("_id string, name string", [(p, None if p == "cy" else p.upper()) for p in ("ann", "bob", "cy", "dan", "eve")]),
        "licences": ("_id string, person string, grade string", [(f"l-{p}", p, "a") for p in ("ann", "bob", "cy", "dan", "eve")]),
    })


def schema(objects):
    return C.build_schema(objects)
