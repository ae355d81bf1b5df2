import json

import pytest

from tessera import config as C

from .fixtures import t


@pytest.mark.parametrize(
    ("change", "words"),
    [
        ({"reverse_scop": {}}, "unknown key reverse_scop"),
        ({"primary_key": None}, "primary_key is required"),
        ({"columns": [{"name": "id"}, {"name": "id"}]}, "repeated entry in columns"),
        ({"columns": [{"name": "id"}, {"name": "a", "unset": False}]}, "accepts only true"),
        ({"columns": [{"name": "id"}, {"name": "a", "unset": True, "replace_with": "x"}]}, "exclude one another"),
        ({"columns": [{"name": "id"}, {"name": "a", "replace_with_random": "hex:8"}]}, "hex:"),
        ({"columns": [{"name": "id"}, {"name": "a", "replace_with_fake_data": {"seed": "gone", "type": "email"}}]}, "seed gone"),
        ({"belongs_tos": [{"table_name": "x", "foreign_key": "a", "foreign_type": "k"}]}, "go together"),
        ({"id_space": "org"}, "id_space needs"),
        ({"batch_scope": {"table": "x", "size": 0}}, "1 or more"),
        ({"reverse_scope": {"via": []}}, "needs via"),
        ({"reverse_scope": {"column": "zz", "via": [{"table": "x", "column": "y"}]}}, "isn't a column"),
        ({"type": "rails_managed_schema_migrations"}, "managed"),
        ({"columns": [{"name": "id", "ignore": True}]}, "every column is ignored"),
    ],
)
def test_bad_tables(change, words):
    with pytest.raises(C.ConfigError, match=words):
        C.parse_table(t("users", ["id", "a"]) | change)


def test_tolerated_and_ignored():
    table = C.parse_table(t("users", ["id", {"name": "a", "raw_sql": "1", "replace_with": "x"}, {"name": "secret", "ignore": True}], [("a", "x")]) | {"comment": "note"})
    assert table.column_names == ["id", "a"] and table.edge("x").foreign_key == "a"
    with pytest.raises(C.ConfigError, match="which is ignored"):
        C.build_schema([t("a", ["id", "b_id"], [("b_id", "b")]), {"name": "b", "ignore": True}])


def test_overlays():
    base = t("users", ["id", {"name": "email", "raw_sql": "1"}, {"name": "nick", "unset": True}], [("org_id", "orgs")], filter="x")
    merged = C.merge_overlay(base, {"name": "users", "filter": None, "columns": [{"name": "email", "replace_with": "e{id}"}, {"name": "nick", "unset": None}], "belongs_tos": [{"table_name": "orgs", "foreign_key": "org_id", "ignore": True}]})
    assert "filter" not in merged and merged["columns"][1] == {"name": "email", "replace_with": "e{id}"} and merged["columns"][2] == {"name": "nick"}
    assert merged["belongs_tos"][0]["ignore"] is True and base["columns"][1]["raw_sql"] == "1"
    for bad in ({"name": "other"}, {"name": "users", "columns": None}, {"name": "users", "columns": [{"name": "new"}]}, {"name": "users", "columns": [{"name": "id"}, {"name": "id"}]}, {"name": "users", "columns": [{"name": "nick", "unset": False}]}):
        with pytest.raises(C.ConfigError):
            C.merge_overlay(base, bad)
    pruned, gone = C.prune_overlay({"name": "users", "columns": [{"name": "old"}, {"name": "email"}]}, base)
    assert pruned["columns"] == [{"name": "email"}] and gone == ["users.columns.old"]


def test_directories_and_profiles(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(t("a", ["id", "x"])))
    (tmp_path / "a.dev.json").write_text(json.dumps({"name": "a", "columns": [{"name": "x", "replace_with": "m"}]}))
    assert C.load_schema(tmp_path, "dev", ("dev",))["a"].columns[1].replace_with == "m"
    assert C.load_schema(tmp_path, None, ("dev",))["a"].columns[1].replace_with is None
    assert C.cached_schema(tmp_path, None, ("dev",)) is C.cached_schema(tmp_path, None, ("dev",))
    with pytest.raises(C.ConfigError, match="isn't declared"):
        C.load_schema(tmp_path, "prod", ("dev",))
    (tmp_path / "b.json").write_text(json.dumps(t("a", ["id"])))
    with pytest.raises(C.ConfigError, match="two files"):
        C.load_schema(tmp_path, None, ("dev",))
    with pytest.raises(C.ConfigError):
        C.load_schema(tmp_path)


def test_run_config_and_ids(tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"schema_dir": "schema", "profiles": ["dev"], "ids": {"default": [1]}}))
    assert C.load_run_config(tmp_path / "run.json")["schema_dir"] == str(tmp_path / "schema")
    (tmp_path / "bad.json").write_text(json.dumps({"schemadir": "x"}))
    with pytest.raises(C.ConfigError, match="schemadir"):
        C.load_run_config(tmp_path / "bad.json")
    (tmp_path / "base.json").write_text(json.dumps({"profiles": ["base"]}))
    with pytest.raises(C.ConfigError, match="base"):
        C.load_run_config(tmp_path / "base.json")
    assert C.parse_ids(["1,2", "org=a,b", "default=x=y"]) == {"default": ["1", "2", "x=y"], "org": ["a", "b"]}
