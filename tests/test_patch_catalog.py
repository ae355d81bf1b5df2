import json

import pytest
from pyspark.sql import types as P

from tessera import catalog as K
from tessera import config as C
from tessera import patch, sources
from tessera.cli import main
from tessera.plans.resolver import Request
from tessera.streaming import masked_stream, patch_batches, scoped_stream

from . import fixtures as X

ACCOUNTS = [X.t("accounts", ["id", {"name": "name", "replace_with": "m{id}"}, {"name": "tier", "replace_with": 0}, "city", {"name": "note", "ignore": True}], filter="accounts.id < 2")]


def accounts(spark):
    return X.frames(spark, {"accounts": ("id int, name string, tier int, city string, note string", [(1, "A", 3, "T", "n"), (2, None, None, "O", "n"), (3, "C'", 1, None, "n"), (4, "D", 1, "x", "n")])})


def test_mask_update(spark):
    schema, source = X.schema(ACCOUNTS), accounts(spark)
    p = patch.mask_update(schema, source, "accounts", ["1", 2, 3, 999], extra={"city": "moved", "name": "no"})
    assert sorted(map(tuple, p.frame.collect())) == [(1, "m1", 0, "moved"), (2, None, None, "moved"), (3, "m3", 0, "moved")]
    assert p.summary() == {"table": "accounts", "rows": 3, "columns": ["name", "tier", "city"], "missing": [999]}
    assert "UPDATE accounts SET name = NULL, tier = NULL, city = 'moved' WHERE id = 2;" in {r.value for r in p.statements("sqlite").collect()}
    (pg,) = [r.value for r in p.statements("postgresql").coalesce(1).collect() if "(1, " in r.value]
    assert pg.startswith("UPDATE accounts SET name = v.name, tier = v.tier, city = v.city FROM (VALUES ((SELECT id FROM accounts WHERE false)")
    assert any("UNION ALL" in r.value or "SELECT 1 AS id" in r.value for r in p.statements("mysql").collect())
    merged = {r.id: (r.name, r.tier, r.city, r.note) for r in p.merged(source("accounts")).collect()}
    assert merged == {1: ("m1", 0, "moved", "n"), 2: (None, None, "moved", "n"), 3: ("m3", 0, "moved", "n"), 4: ("D", 1, "x", "n")}


def test_refusals(spark):
    source = accounts(spark)
    bad = [
        ([X.t("accounts", ["id", "name"])], "no column is masked"), ([X.t("accounts", [{"name": "id", "replace_with": 1}])], "primary key"),
        ([X.t("accounts", ["name"])], "primary key"), ([{"name": "accounts", "type": "rails_managed_x"}], "can't be masked"),
    ]
    for objects, words in bad:
        with pytest.raises(C.ConfigError, match=words):
            patch.mask_update(X.schema(objects), source, "accounts", [1])
    with pytest.raises(C.ConfigError, match="1x"):
        patch.mask_update(X.schema(ACCOUNTS), source, "accounts", ["1x"])
    for condition in (None, "", "true"):
        with pytest.raises(C.ConfigError, match="narrows"):
            patch.mask_where(X.schema(ACCOUNTS), source, "accounts", condition)
    assert patch.mask_where(X.schema(ACCOUNTS), source, "accounts", "accounts.city = 'O'").frame.count() == 1
    for request in (Request.of("a", [1], mode="scope_column"), Request.of("a", [1], ids_field="x"), Request.of("a", {"org": [1]})):
        with pytest.raises(C.ConfigError):
            patch.check_request(request)
    a, b = {"table": "t", "rows": 1, "columns": ["x"], "missing": [1]}, {"table": "t", "rows": 2, "columns": ["x"], "missing": [2]}
    assert patch.merge_summaries([a, b]) == {"table": "t", "rows": 3, "columns": ["x"], "missing": [1, 2]}


def test_document_updates(spark, tmp_path):
    schema = X.schema([X.d("users", ["_id", {"name": "a", "replace_with": "m{_id}"}, {"name": "gone", "unset": True}])])
    source = X.frames(spark, {"users": ("_id string, a string, gone string", [("1", "x", "y"), ("2", None, None)])})
    lines = patch.document_updates(schema, source, "users", ["1"])
    assert json.loads(lines.first().value) == {"updateOne": {"filter": {"_id": "1"}, "update": {"$set": {"a": "m1"}, "$unset": {"gone": ""}}}}
    assert patch.write_all([lines], str(tmp_path / "u")) == 1


def found(spark):
    schema = P.StructType().add("id", "long").add("email", "string").add("org_id", "long").add("born", "date").add("code", "string")
    return [K.Found("users", schema, "id", (("org_id", "orgs"),), frozenset({"code"}), {"code": 10}), K.Found("orgs", P.StructType().add("id", "long"), "id"), K.Found("pairs", P.StructType().add("a", "long"), ("a", "b")), K.Found("bare", P.StructType().add("a", "long"))]


def test_generate_merge_tidy_and_drift(spark):
    made = K.generate(found(spark))
    users = {c["name"]: c for c in made["users"]["columns"]}
    assert users["email"] == {"name": "email", "replace_with": "masked-{id}@example.com", "needs_mask_decision": True}
    assert users["id"] == {"name": "id"} and users["org_id"] == {"name": "org_id"} and users["born"]["replace_with"] == "2000-01-01" and "replace_with" not in users["code"]
    assert made["pairs"]["type"] == C.COMPOSITE_KEY and made["bare"]["ignore"] and made["users"]["belongs_tos"] == [{"table_name": "orgs", "foreign_key": "org_id"}]
    old = {"users": {"name": "users", "primary_key": "id", "filter": "x", "columns": [{"name": "email", "unset": True}, {"name": "old"}], "belongs_tos": [{"table_name": "gone", "foreign_key": "g"}]}, "gone": {"name": "gone", "primary_key": "id", "columns": []}}
    merged = K.generate(found(spark), old)
    assert merged["users"]["filter"] == "x" and {"name": "email", "unset": True} in merged["users"]["columns"] and "gone" in merged
    tidied = K.tidy(found(spark), merged)
    assert "gone" not in tidied and [r["table_name"] for r in tidied["users"]["belongs_tos"]] == ["orgs"] and all(c["name"] != "old" for c in tidied["users"]["columns"])
    report = K.drift(found(spark), old, {("dev", "users"): {"name": "users", "columns": [{"name": "old"}]}})
    assert report["removed_tables"] == ["gone"] and report["stale_columns"] == ["users.old"] and "users.org_id" in report["added_columns"] and report["overlay_stale"] == ["dev:users.columns.old"]
    assert K.drift(found(spark), tidied)["changed_tables"] == []
    assert K.report_frame(spark, report).count() == sum(map(len, report.values()))
    plain = K.generate(found(spark), safe=False)
    assert all(set(c) == {"name"} for c in plain["users"]["columns"])


def test_static_checks():
    objects = {"users": X.t("users", ["id", {"name": "api_token", "replace_with": "x"}, {"name": "password", "replace_with_random": "hex:16"}, "email", {"name": "phone", "allow_unmasked": True}, {"name": "nick", "allow_unmasked": True}, "secret_at"])}
    overlays = {("dev", "users"): {"name": "users", "columns": [{"name": "email", "replace_with": "m"}]}}
    config = K.CheckConfig.of({"guessable_credentials": True, "unmasked_sensitive": {"patterns": ["^nick$"]}})
    report = K.static_checks(objects, overlays, ("dev",), config)
    assert report["integrity"] == [] and report["guessable_credentials"] == ["users.api_token [base, dev]: a credential masked to a value that can be guessed"]
    assert report["unmasked_sensitive"] == ["users.email [base]: looks sensitive and isn't masked"]
    for bad in ({"nope": True}, {"integrity": {"x": 1}}, {"unmasked_sensitive": {"patterns": ["("]}}):
        with pytest.raises(C.ConfigError):
            K.CheckConfig.of(bad)


def test_inference_and_documents(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, name string, parent long")
    assert K.infer_key(df) == "id" and K.included(df, "parent", df, "id") and not K.included(df, "id", df, "parent")
    kind = P.StructType().add("_id", "string").add("mail", "string").add("posts", P.ArrayType(P.StructType().add("_id", "string").add("title", "string")))
    made = K.generate_documents({"users": kind})
    assert made["users_posts"]["embedded_in"] == {"collection_name": "users", "path": "posts"} and [f["name"] for f in made["users"]["fields"]] == ["_id", "mail"]
    assert C.build_schema(made)["users_posts"].embedded_in.path == "posts"


def test_command_line(spark, tmp_path, capsys):
    schema, data = tmp_path / "schema", tmp_path / "data"
    schema.mkdir()
    for o in X.SHOP:
        (schema / f"{o['name']}.json").write_text(json.dumps(o))
    source = X.shop(spark)
    for o in X.SHOP:
        source(o["name"]).write.parquet(str(data / f"{o['name']}.parquet"))
    base = ["--schema-dir", str(schema), "--source", str(data)]
    assert main(["export", *base, "--target-table", "shops", "--ids", "1", "--output-dir", str(tmp_path / "out"), "--dialect", "sqlite"], spark) == 0
    assert json.loads(capsys.readouterr().out)["orders"] == 4
    assert main(["explain", *base, "--target-table", "shops", "--ids", "1"], spark) == 0 and "orders: direct" in capsys.readouterr().out
    assert main(["mask-update", *base, "--target-table", "users", "--ids", "1,2", "--dialect", "sqlite"], spark) == 0 and "UPDATE users" in capsys.readouterr().out
    assert main(["schema", "show", *base, "--table", "orders"], spark) == 0 and '"filter"' in capsys.readouterr().out
    assert main(["schema", "check", *base], spark) == 1 and "users.email" not in json.loads(capsys.readouterr().out)["removed_columns"]
    assert main(["schema", "generate", *base, "--plain"], spark) == 0 and main(["schema", "tidy", *base], spark) == 0
    capsys.readouterr()
    assert main(["schema", "check", *base], spark) == 0
    assert main(["export", *base, "--ids", "1", "--output-dir", str(tmp_path / "out")], spark) == 2
    assert main(["export", "--bad"], spark) == 2


def test_tables_are_discovered_and_nothing_is_tidied_by_accident(spark, tmp_path, capsys):
    schema, data = tmp_path / "schema", tmp_path / "data"
    source = X.shop(spark)
    for name in ("shops", "users"):
        source(name).write.parquet(str(data / f"{name}.parquet"))
    base = ["--schema-dir", str(schema), "--source", str(data)]
    assert main(["schema", "generate", *base, "--keys", '{"shops": "id", "users": "id"}', "--relations", '{"users": [["shop_id", "shops"]]}'], spark) == 0
    users = json.loads((schema / "users.json").read_text())
    assert users["primary_key"] == "id" and users["belongs_tos"] == [{"table_name": "shops", "foreign_key": "shop_id"}]
    source("products").write.parquet(str(data / "products.parquet"))
    assert main(["schema", "check", *base], spark) == 1 and json.loads(capsys.readouterr().out)["added_tables"] == ["products"]
    # a folder that can't be read, or is empty, or a table that can't be read: an error, and all configs stay
    (tmp_path / "empty").mkdir()
    for bad in (str(tmp_path / "gone"), str(tmp_path / "empty")):
        assert main(["schema", "tidy", "--schema-dir", str(schema), "--source", bad], spark) == 2
    (data / "broken.parquet").write_text("not parquet")
    assert main(["schema", "tidy", *base], spark) == 2 and (schema / "users.json").exists()
    (data / "broken.parquet").unlink()
    assert main(["mask-update", *base, "--ids", "1"], spark) == 2 and "--target-table" in capsys.readouterr().err
    assert sources.discover(spark, "parquet", str(data)) == ["products", "shops", "users"] and sources.discover(spark, "mysql", "jdbc:x") is None


def test_embedded_fields_are_tidied():
    inner = P.StructType().add("_id", "string").add("title", "string")
    old = K.generate_documents({"users": P.StructType().add("_id", "string").add("mail", "string").add("posts", P.ArrayType(inner.add("gone", "string")))})
    found = K.introspect_documents({"users": P.StructType().add("_id", "string").add("posts", P.ArrayType(P.StructType().add("_id", "string").add("title", "string")))})
    made = K.tidy(found, old)
    assert [f["name"] for f in made["users"]["fields"]] == ["_id"] and [f["name"] for f in made["users_posts"]["fields"]] == ["_id", "title"]
    assert "users_posts" not in K.tidy(K.introspect_documents({"users": P.StructType().add("_id", "string")}), old)


def test_sources(spark, tmp_path):
    assert sources.adapter_name("sqlite3") == "sqlite" and sources.adapter_name("trilogy") == "mysql"
    with pytest.raises(C.ConfigError):
        sources.adapter_name("oracle9")
    table = C.parse_table(X.t("a*/b", ["id"]) | {"name": "ab"})
    o = sources.jdbc_options("postgres", "jdbc:x", table, "u", "p", timeout_ms=1500, bounds=("id", 0, 9, 3), ssl="require")
    assert o["queryTimeout"] == "2" and o["numPartitions"] == "3" and o["sslmode"] == "require" and o["sessionInitStatement"].startswith("/* extract table=ab */")
    assert sources.tag(spark, "x*/y") == "/* extract table=xy */"
    (tmp_path / "c.jsonl").write_text('{"_id": "1", "n": null}\n')
    assert sources.open_source(spark, "mongodb", str(tmp_path), schemas={"c": "_id string, n int"})("c").first().asDict() == {"_id": "1", "n": None}
    with pytest.raises(C.ConfigError):
        sources.given({})("a")


def test_streams(spark, tmp_path):
    accounts(spark)("accounts").write.parquet(str(tmp_path / "in"))
    table = X.schema(ACCOUNTS)["accounts"]
    stream = spark.readStream.schema("id int, name string, tier int, city string, note string").parquet(str(tmp_path / "in"))
    seen = []
    patch_batches(scoped_stream(stream, "id", [1, 3]), table, lambda rows, n: seen.extend(map(tuple, rows.collect())), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [(1, "m1", 0, "T"), (3, "m3", 0, None)]
    assert masked_stream(stream, table).isStreaming


def test_database_rows(spark):
    columns = [("users", "id", "bigint", "bigint", None, None), ("users", "mail", "character varying", "character varying", 255, None), ("users", "ok", "boolean", "boolean", None, "true"), ("users", "n", "integer", "integer", None, "5"), ("users", "at", "date", "date", None, "now()"), ("users", "kind", "USER-DEFINED", "mood", None, None), ("users", "org_id", "bigint", "bigint", None, None), ("pairs", "a", "bigint", "bigint", None, None), ("pairs", "b", "bigint", "bigint", None, None)]
    found = K.found_of_rows("postgresql", columns, [("users", "id"), ("pairs", "a"), ("pairs", "b")], [("f1", "users", "org_id", "orgs"), ("f2", "pairs", "a", "x"), ("f2", "pairs", "b", "x")], [("users", "mail")])
    users = {c["name"]: c.get("replace_with") for c in K.generate(found)["users"]["columns"]}
    assert users == {"id": None, "mail": "masked-{id}@example.com", "ok": True, "n": 5, "at": "2000-01-01", "kind": None, "org_id": None}
    assert found[1].primary_key == ("a", "b") and found[1].foreign_keys == () and found[0].foreign_keys == (("org_id", "orgs"),)
    mysql = K.found_of_rows("mysql", [("t", "f", "tinyint", "tinyint(1)", None, "1")], [], [], [])
    assert isinstance(mysql[0].schema["f"].dataType, P.BooleanType) and mysql[0].defaults == {"f": True}
    assert "table_schema = 'a''b'" in K.introspection_queries("mysql", "a'b")["keys"]
    with pytest.raises(C.ConfigError):
        K.introspection_queries("sqlite", "x")
