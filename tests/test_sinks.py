import datetime
import json
import os
import stat

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as P

from tessera import config as C
from tessera import queries_lifecycle  # noqa: F401  adds its queries
from tessera.engine import Extraction
from tessera.plans.resolver import Request
from tessera.queries import ORACLES, QUERIES, source, table
from tessera.sinks import ddl
from tessera.sinks import escape as E
from tessera.sinks.writer import CHUNK_ROWS, WriteFailed, insert_statements, write

from . import fixtures as X


def extraction(spark):
    return Extraction(X.schema(X.SHOP), Request.of("shops", [1]), X.shop(spark))


def test_insert_files(spark, tmp_path):
    def hook(context):
        context.insert_sql(f"-- {context.ids_for('orders')}\n")

    script = tmp_path / "hook.sh"
    script.write_text('#!/bin/sh\necho "$TARGET_TABLE $IDS" > "$OUTPUT_DIR/insert-$NEXT_NUMBER-script.sql"\n')
    os.chmod(script, stat.S_IRWXU)
    done = write(extraction(spark), str(tmp_path / "out"), "insert", "sqlite", [hook, script])
    out = tmp_path / "out"
    assert done.rows["orders"] == 4 and done.files["orders"] == f"insert-{done.order.index('orders') + 1:03d}-orders.sql"
    assert (out / done.files["products"]).read_text() == "INSERT INTO products (id, name, shop_id) VALUES\n(1, 'it''s 1', 1),\n(2, 'it''s 2', 1),\n(3, 'it''s 3', 1);\n"
    assert (out / "insert-009-hook.sql").read_text() == "-- [3, 4, 5, 6]\n" and (out / "insert-010-script.sql").read_text() == "shops 1\n"
    assert "CREATE TABLE IF NOT EXISTS shops" in (out / "insert-000-schema.sql").read_text()
    assert json.loads((out / "manifest.json").read_text())["rows"] == done.rows
    again = write(extraction(spark), str(out), "jsonl", confirm=lambda old: True)
    assert not list(out.glob("insert-*-products.sql")) and json.loads((out / again.files["products"]).read_text().splitlines()[0])["name"] == "it's 1"
    with pytest.raises(C.ConfigError):
        write(extraction(spark), str(out), "jsonl", confirm=lambda old: False)


def test_copy_parquet_and_dialects(spark, tmp_path):
    done = write(extraction(spark), str(tmp_path / "c"), "copy", "postgresql")
    text = (tmp_path / "c" / done.files["users"]).read_text()
    assert "COPY users (id, name, email, shop_id) FROM stdin;\n1\tUSER 1\tmasked1@example.com\t1\n2\tUSER 2\t\\N\t1\n\\.\n" in text and "session_replication_role" in text and "setval" in text
    done = write(extraction(spark), str(tmp_path / "p"), "parquet")
    assert X.ids(spark.read.parquet(str(tmp_path / "p" / done.files["orders"]))) == [3, 4, 5, 6]
    done = write(extraction(spark), str(tmp_path / "m"), "insert", "mysql")
    text = (tmp_path / "m" / done.files["shops"]).read_text()
    assert text == "SET FOREIGN_KEY_CHECKS = 0;\nINSERT INTO `shops` (`id`, `name`) VALUES\n(1, 'shop 1');\nSET FOREIGN_KEY_CHECKS = 1;\n"
    with pytest.raises(C.ConfigError):
        write(extraction(spark), str(tmp_path / "x"), "copy", "mysql")


def test_parts_written_by_executors(spark, tmp_path):
    one = write(extraction(spark), str(tmp_path / "one"), "insert", "postgresql")
    many = write(extraction(spark), str(tmp_path / "many"), "insert", "postgresql", parallelism=3)
    assert one.rows == many.rows and one.files == many.files
    for name, file in many.files.items():
        parts = [p.read_text() for p in sorted((tmp_path / "many" / file).glob("part-*")) if p.stat().st_size]
        tuples = lambda text: sorted(x.rstrip(",;") for x in text.split("\n") if x.startswith("("))
        assert tuples("\n".join(parts)) == tuples((tmp_path / "one" / file).read_text()), name
        assert all("session_replication_role" in p and "setval" in p and p.count("INSERT INTO") == 1 for p in parts)


def test_chunks_and_empty_tables(spark, tmp_path):
    objects = [o | {"bulk_insert_chunk_size": 2} if o["name"] == "orders" else o for o in X.SHOP]
    e = Extraction(X.schema(objects), Request.of("shops", [1]), X.shop(spark))
    done = write(e, str(tmp_path), "insert", "sqlite")
    text = (tmp_path / done.files["orders"]).read_text()
    assert text.count("INSERT INTO") == 2 and text.endswith(";\n") and text.count(";") == 2
    assert "reviews" in done.files
    none = Extraction(X.schema(X.SHOP), Request.of("shops", [99]), X.shop(spark))
    done = write(none, str(tmp_path), "insert", "sqlite")
    assert done.rows["orders"] == 0 and "orders" not in done.files and not list(tmp_path.glob("*-orders.sql"))
    rows = insert_statements(e.masked("orders").coalesce(1), e.schema["orders"], "sqlite").collect()
    assert sum(r.value.count("\n(") + r.value.count(",\n(") for r in rows) >= 4 and all(r.value.endswith(";") for r in rows)


def test_insert_file_query_beyond_the_default_chunk(spark, tmp_path):
    kept = 2 * CHUNK_ROWS + 1
    rows = spark.range(kept + 500).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", f"CAST(IF(id < {kept}, 3 + id % 2, 5) AS INT) AS c_nationkey")
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    spark.read.parquet(str(tmp_path / "customer.parquet")).createOrReplaceTempView("customer")
    wanted = sorted(r.value for r in spark.sql(ORACLES["j03_insert_file"]).collect())
    spark.catalog.dropTempView("customer")
    assert len(wanted) == kept + 1 and sorted(r.value for r in QUERIES["j03_insert_file"](spark, str(tmp_path)).collect()) == wanted
    scoped = table("customer", [], ["c_custkey", "c_name", "c_nationkey"], scope_column="c_nationkey")
    done = write(Extraction(C.build_schema([scoped]), Request.of(ids=[3, 4]), source(spark, str(tmp_path))), str(tmp_path / "out"), "insert", "sqlite")
    text = (tmp_path / "out" / done.files["customer"]).read_text()
    assert text.count("INSERT INTO") == text.count(";") == 3 and text.count("\n(") == kept


def test_failures_name_the_table(spark, tmp_path):
    objects = [t if t["name"] != "users" else X.t("users", ["id", {"name": "name", "raw_sql": "raise_error('boom')"}], [("shop_id", "shops")]) for t in X.SHOP]
    with pytest.raises(WriteFailed, match="users"):
        write(Extraction(X.schema(objects), Request.of("shops", [1]), X.shop(spark)), str(tmp_path), "insert", "sqlite")


def test_literals(spark):
    row = spark.sql("select 'a\\\\b\\'c\\n\\r' x, true t, cast(1.5 as decimal(4,2)) d, date'2020-01-02' day, timestamp_ntz'2020-01-02 03:04:05' at, timestamp_ntz'2020-01-02 03:04:05.25' us, cast(null as int) n, array(1,2) arr")
    lit = lambda name, dialect: row.select(E.literal(F.col(name), row.schema[name].dataType, dialect)).first()[0]
    assert lit("x", "mysql") == "'a\\\\b''c\\n\\r'" and lit("x", "sqlite") == "'a\\b''c\n\r'"
    assert (lit("t", "sqlite"), lit("t", "postgresql"), lit("d", "mysql"), lit("n", "mysql")) == ("1", "TRUE", "1.50", "NULL")
    assert lit("day", "mysql") == "'2020-01-02'" and lit("at", "mysql") == "'2020-01-02 03:04:05'" and lit("us", "mysql") == "'2020-01-02 03:04:05.250000'" and lit("arr", "mysql") == "'[1,2]'"
    with pytest.raises(Exception, match="finite"):
        spark.sql("select double('NaN') x").select(E.literal(F.col("x"), P.DoubleType(), "mysql")).collect()
    copied = spark.sql("select 'a\\\\b\\tc\\nd' x").select(E.copy_field(F.col("x"), P.StringType())).first()[0]
    assert copied == "a\\\\b\\tc\\nd"


def test_names():
    assert E.quote_name("order", "mysql") == "`order`" and E.quote_name("public.users", "postgresql") == "public.users"
    assert E.quote_name('we"ird', "sqlite") == '"we""ird"' and E.quote_name("Group", "postgresql") == '"Group"'


def test_extended_json(spark):
    df = spark.createDataFrame([({"$oid": "a" * 24}, datetime.datetime(2020, 1, 2, 3, 4, 5), [(1, None)], None)], "_id struct<`$oid`:string>, at timestamp, xs array<struct<a:int,b:string>>, n string")
    assert json.loads(df.select(E.json_line(df.schema)).first()[0]) == {"_id": {"$oid": "a" * 24}, "at": {"$date": "2020-01-02T03:04:05.000Z"}, "xs": [{"a": 1, "b": None}], "n": None}


def test_repeatable_statements():
    sql = """-- dump
CREATE TABLE a (x text DEFAULT ';');
CREATE TYPE mood AS ENUM ('a;b');
ALTER TABLE ONLY a ADD CONSTRAINT a_pk PRIMARY KEY (x);
CREATE INDEX i ON a (x);
CREATE EXTENSION IF NOT EXISTS google_vacuum_mgmt;
CREATE FUNCTION f() AS $$ begin; end $$;
"""
    out = ddl.repeatable(sql, "postgresql")
    assert "CREATE TABLE IF NOT EXISTS a (x text DEFAULT ';');" in out and "CREATE INDEX IF NOT EXISTS i" in out
    assert out.count("DO $guard$") == 2 and "google_vacuum" not in out and "$$ begin; end $$;" in out
    assert ddl.repeatable(out, "postgresql").count("IF NOT EXISTS IF NOT EXISTS") == 0
    assert "DEFINER" not in ddl.repeatable("CREATE /*!50017 DEFINER=`root`@`%` */ TRIGGER t;", "mysql")
    made = ddl.create_table(C.parse_table(X.t("order", ["id", "a"])), P.StructType().add("id", "string", False).add("a", "decimal(5,1)", False), "mysql")
    assert "`order`" in made and "id varchar(255) PRIMARY KEY" in made and "a decimal(5,1) NOT NULL" in made
