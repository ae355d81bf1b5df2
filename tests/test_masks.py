import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as P

from tessera import config as C
from tessera.functions import masks as M
from tessera.functions import pools

from .fixtures import d, t


def test_all_kinds(spark):
    M.register_map("shout", lambda r: None if r["name"] is None else r["name"] + "!" + r["mail"])
    table = C.parse_table(t("users", [
        "id", {"name": "name", "raw_sql": "concat(users.name, '-', users.id)"}, {"name": "mail", "replace_with": "u{id}@x{}"}, {"name": "called", "map": "shout"},
        {"name": "age", "replace_with": 7}, {"name": "ok", "replace_with": False}, {"name": "token", "replace_with_random": "hex:16"}, {"name": "gone", "unset": True},
        {"name": "fake", "replace_with_fake_data": {"seed": "users.id", "type": "email"}},
    ]))
    schema = "id long, name string, mail string, called string, age int, ok boolean, token string, gone string, fake string, hidden string"
    rows = [(1, "A", "a", "x", 5, True, "t", "g", "f", "h"), (2, None, None, None, None, None, None, None, None, None), (3, "", "", "", 0, False, "", "", "", "")]
    out = {r.id: r for r in M.apply_masks(spark.createDataFrame(rows, schema), table).collect()}
    one, two, three = out[1], out[2], out[3]
    assert "hidden" not in one.asDict()
    assert (one.name, one.mail, one.called, one.age, one.ok, one.gone) == ("A-1", "u1@x{}", "A-1!u1@x{}", 7, False, None)
    assert re.fullmatch("[0-9a-f]{32}", one.token) and one.token != three.token
    assert (two.mail, two.age, two.ok, two.token, two.fake, two.called) == (None,) * 6
    assert (three.mail, three.age) == ("u3@x{}", 7)
    assert one.fake.endswith(".6b86b273ff34fce1@example.com".replace("6b86b273ff34fce1", "9d6b804eff5a3f57"))
    assert M.apply_masks(spark.createDataFrame([], schema), table).collect() == []


def test_templates(spark):
    row = spark.createDataFrame([("a", None)], "x string, y string").select(M.template("{x}-{y}").alias("n"), M.template("{x}-{y}", "empty").alias("e"), M.template("{}").alias("b"), M.template("").alias("z")).first()
    assert tuple(row) == (None, "a-", "{}", "")


def test_unknown_map(spark):
    table = C.parse_table(t("u", ["id", {"name": "a", "map": "never_registered"}]))
    with pytest.raises(C.ConfigError, match="never_registered"):
        M.apply_masks(spark.createDataFrame([(1, "x")], "id long, a string"), table)


def test_pools(spark):
    k = F.col("id")
    rows = spark.range(3000).select("id", pools.value("human_name", k).alias("h"), pools.value("first_name", k).alias("f"), pools.value("last_name", k).alias("l"), pools.value("human_name", k, "ja").alias("jh"), pools.value("last_name", k, "ja").alias("jl"), pools.value("human_name_kana", k, "ja").alias("jk"), pools.value("username", k).alias("u")).collect()
    for r in rows[:50]:
        assert r.h == f"{r.f} {r.l}" and r.jh.startswith(r.jl + " ") and " " in r.jk
    assert len({r.h for r in rows}) > 2500 and len({r.u for r in rows}) == 3000
    persons = {(p % pools.NAMES, (p // pools.NAMES + p) % pools.NAMES) for p in range(pools.PERSONS)}
    assert len(persons) == pools.PERSONS
    for kind, locale in (("human_name_kana", "en"), ("nope", "en"), ("email", "xx")):
        with pytest.raises(ValueError, match="no fake data"):
            pools.value(kind, k, locale)
    a, b = spark.range(1).select(pools.index(F.lit(None), 100).alias("a"), pools.index(F.lit(""), 100).alias("b")).first()
    assert a == b


def test_documents(spark):
    table = C.parse_table(d("users", ["_id", {"name": "a", "replace_with": "m{_id}"}, {"name": "b", "replace_with": "{a}!"}, {"name": "c", "unset": True}]))
    posts = C.parse_table(d("posts", ["_id", {"name": "title", "replace_with": "t{_id}"}]) | {"embedded_in": {"collection_name": "users", "path": "posts"}})
    deep = C.parse_table(d("zips", [{"name": "zip", "replace_with": "0"}]) | {"embedded_in": {"collection_name": "users", "path": "profile.address"}, "primary_key": "zip"})
    schema = "_id string, a string, b string, c string, other string, posts array<struct<_id:string,title:string,x:string>>, profile struct<name:string,address:struct<zip:string,city:string>>"
    rows = [("1", "x", "y", "z", "o", [("p", "q", "r"), ("s", None, "r")], ("n", ("9", "c"))), ("2", None, None, None, None, None, None)]
    one, two = sorted(M.mask_document(spark.createDataFrame(rows, schema), table, [posts, deep]).collect())
    assert (one.a, one.b) == ("m1", "m1!") and "c" not in one.asDict() and "other" not in one.asDict()
    assert [tuple(p) for p in one.posts] == [("p", "tp"), ("s", None)]
    assert one.profile.name == "n" and tuple(one.profile.address) == ("0",)
    assert (two.a, two.posts, two.profile) == (None, None, None)


def test_default_masks():
    s = P.StringType()
    assert M.default_mask("email", s, "id") == "masked-{id}@example.com" and M.default_mask("note", s, "id") == "masked-{id}"
    assert M.default_mask("note", s, None) is None and M.default_mask("note", s, "id", 19) is None and M.default_mask("email", s, "id", 39) is None
    assert M.default_mask("n", P.LongType(), "id") == 0 and M.default_mask("n", P.LongType(), "id", unique=True) is None and M.default_mask("n", P.LongType(), "id", default=5) == 5
    assert M.default_mask("b", P.BooleanType(), "id") is False and M.default_mask("d", P.DateType(), "id") == "2000-01-01" and M.default_mask("x", P.ArrayType(s), "id") is None
