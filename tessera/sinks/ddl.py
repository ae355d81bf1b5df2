"""Schema statements: tables from Spark types, and rewrites that make dumped statements repeatable."""

from __future__ import annotations

import re

from pyspark.sql import types as P

from ..config import Table
from .escape import quote_name

_TYPES = {
    "postgresql": {P.BooleanType: "boolean", P.ByteType: "smallint", P.ShortType: "smallint", P.IntegerType: "integer", P.LongType: "bigint", P.FloatType: "real", P.DoubleType: "double precision", P.DateType: "date", P.TimestampType: "timestamp with time zone", P.TimestampNTZType: "timestamp", P.BinaryType: "bytea", P.StringType: "text"},
    "mysql": {P.BooleanType: "tinyint(1)", P.ByteType: "tinyint", P.ShortType: "smallint", P.IntegerType: "int", P.LongType: "bigint", P.FloatType: "float", P.DoubleType: "double", P.DateType: "date", P.TimestampType: "datetime(6)", P.TimestampNTZType: "datetime(6)", P.BinaryType: "longblob", P.StringType: "longtext"},
    "sqlite": {P.BooleanType: "boolean", P.ByteType: "integer", P.ShortType: "integer", P.IntegerType: "integer", P.LongType: "integer", P.FloatType: "real", P.DoubleType: "real", P.DateType: "date", P.TimestampType: "datetime", P.TimestampNTZType: "datetime", P.BinaryType: "blob", P.StringType: "text"},
}


def column_type(kind: P.DataType, dialect: str) -> str:
    if isinstance(kind, P.DecimalType):
        return f"decimal({kind.precision},{kind.scale})"
    if isinstance(kind, (P.StructType, P.ArrayType, P.MapType, P.VariantType)):
        return {"postgresql": "jsonb", "mysql": "json", "sqlite": "text"}[dialect]
    return _TYPES[dialect].get(type(kind), "text")


def create_table(table: Table, schema: P.StructType, dialect: str) -> str:
    """CREATE TABLE with all columns of the source, whatever is exported."""
    lines = []
    for f in schema.fields:
        key = f.name == table.primary_key
        kind = "varchar(255)" if key and dialect == "mysql" and isinstance(f.dataType, P.StringType) else column_type(f.dataType, dialect)
        lines.append(f"  {quote_name(f.name, dialect)} {kind}{' PRIMARY KEY' if key else ''}{'' if f.nullable or key else ' NOT NULL'}")
    return f"CREATE TABLE IF NOT EXISTS {quote_name(table.name, dialect)} (\n" + ",\n".join(lines) + "\n);\n"


def create_collection(name: str, primary_key: str = "_id", indexes: list[str] = ()) -> str:
    """Shell statements for a collection and its indexes."""
    out = f"db.createCollection({name!r});\n".replace("'", '"')
    return out + "".join(f'db.getCollection("{name}").createIndex({{"{i}": 1}});\n' for i in indexes if i != primary_key)


def _guard(statement: str, conditions: tuple[str, ...]) -> str:
    """A PostgreSQL statement that is skipped if what it makes exists."""
    tag = "$guard$"
    while tag in statement:
        tag = tag[:-1] + "x$"
    handlers = "".join(f"\n  WHEN {c} THEN NULL;" for c in conditions)
    return f"DO {tag} BEGIN\n  {statement.strip().rstrip(';')};\nEXCEPTION{handlers}\nEND {tag};"


def statements(sql: str) -> list[str]:
    """Splits at semicolons outside quotes, dollar quotes and comments."""
    out, start, at = [], 0, 0
    token = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|(\$\w*\$).*?\1|;", re.S)
    while found := token.search(sql, at):
        at = found.end()
        if found[0] == ";":
            out.append(sql[start:at])
            start = at
    if sql[start:].strip():
        out.append(sql[start:])
    return out


_PLATFORM = ("google_vacuum_mgmt", "rds_tools", "aws_commons", "azure")


def repeatable(sql: str, dialect: str, skip_extensions: tuple[str, ...] = _PLATFORM) -> str:
    """Dumped schema statements, changed so that they can run on a database that has some of the objects."""
    out = []
    for s in statements(sql):
        lead = re.match(r"(?:\s|--[^\n]*\n|/\*(?!!).*?\*/)*", s, re.S)[0]
        body = s[len(lead) :]
        for kind in ("TABLE", "SEQUENCE", "SCHEMA", "UNLOGGED TABLE", *(("INDEX", "UNIQUE INDEX") if dialect != "mysql" else ())):
            body = re.sub(rf"\ACREATE {kind} (?!IF NOT EXISTS)", f"CREATE {kind} IF NOT EXISTS ", body, flags=re.I)
        body = re.sub(r"/\*!\d+ DEFINER=\S+\s*\*/|\bDEFINER\s*=\s*\S+", "", body)
        if dialect == "postgresql":
            extension = re.match(r"(?:CREATE|COMMENT ON) EXTENSION (?:IF NOT EXISTS )?\"?(\w+)", body, re.I)
            if extension and extension[1].lower() in skip_extensions:
                continue
            if re.match(r"CREATE TYPE \S+ AS ENUM", body, re.I):
                body = _guard(body, ("duplicate_object",))
            elif re.match(r"ALTER TABLE (?:ONLY )?\S+\s+ADD CONSTRAINT", body, re.I):
                body = _guard(body, ("duplicate_object", "duplicate_table", "invalid_table_definition"))
            elif re.match(r"CREATE (?:CONSTRAINT )?TRIGGER", body, re.I):
                body = _guard(body, ("duplicate_object",))
            elif re.match(r"CREATE EXTENSION|COMMENT ON EXTENSION", body, re.I):
                body = _guard(body, ("OTHERS",))
        out.append(lead + body)
    return "".join(out)
