"""Values as text, by dialect, in Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as P

DIALECTS = ("sqlite", "mysql", "postgresql")
# Words that each dialect doesn't accept as a bare name, of those that tables and columns are often called.
RESERVED = {
    "sqlite": {"all", "and", "as", "between", "case", "check", "collate", "column", "create", "default", "delete", "distinct", "drop", "else", "exists", "foreign", "from", "group", "having", "in", "index", "insert", "into", "is", "join", "limit", "not", "null", "on", "or", "order", "primary", "references", "select", "set", "table", "then", "to", "transaction", "union", "unique", "update", "using", "values", "when", "where"},
    "mysql": {"add", "all", "and", "as", "by", "case", "change", "check", "column", "condition", "create", "database", "default", "delete", "desc", "describe", "distinct", "drop", "else", "exists", "explain", "false", "for", "foreign", "from", "grant", "group", "groups", "having", "if", "in", "index", "insert", "interval", "into", "is", "join", "key", "keys", "like", "limit", "match", "not", "null", "of", "on", "option", "or", "order", "primary", "range", "rank", "read", "references", "rename", "repeat", "replace", "row", "rows", "select", "set", "show", "system", "table", "then", "to", "trigger", "true", "union", "unique", "update", "usage", "use", "user", "using", "values", "when", "where", "window", "with", "write"},
    "postgresql": {"all", "analyse", "analyze", "and", "any", "array", "as", "asc", "authorization", "between", "case", "cast", "check", "collate", "column", "constraint", "create", "default", "desc", "distinct", "do", "else", "end", "except", "false", "fetch", "for", "foreign", "from", "grant", "group", "having", "in", "initially", "into", "is", "join", "leading", "like", "limit", "natural", "not", "null", "offset", "on", "only", "or", "order", "placing", "primary", "references", "select", "session_user", "some", "table", "then", "to", "trailing", "true", "union", "unique", "user", "using", "variadic", "verbose", "when", "where", "window", "with"},
}


def quote_name(name: str, dialect: str, always: bool = False) -> str:
    """A table's or column's name, quoted part by part where a bare one isn't safe."""
    mark = "`" if dialect == "mysql" else '"'
    safe = re.compile(r"[a-z_][a-z0-9_]*\Z")
    return ".".join(p if not always and safe.match(p) and p not in RESERVED[dialect] else mark + p.replace(mark, mark * 2) + mark for p in name.split("."))


def text(c: Column, kind: P.DataType, dialect: str = "postgresql") -> Column:
    """A value as a database client shows it: dates and times in ISO form, six digits of seconds only where some aren't zero."""
    if isinstance(kind, P.BooleanType):
        return F.when(c, "1").when(~c, "0") if dialect != "postgresql" else F.when(c, "t").when(~c, "f")
    if isinstance(kind, (P.TimestampType, P.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    if isinstance(kind, P.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, P.BinaryType):
        return F.decode(c, "UTF-8")
    if isinstance(kind, (P.StructType, P.ArrayType, P.MapType)):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return c.cast("string")


def quoted(c: Column, dialect: str) -> Column:
    """A text in single quotes."""
    for old, new in ((("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"), ("\x1a", "\\Z")) if dialect == "mysql" else ()):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def literal(c: Column, kind: P.DataType, dialect: str) -> Column:
    """A value as an SQL literal. A number that isn't finite is an error."""
    if isinstance(kind, P.BooleanType):
        made = F.when(c, "TRUE").otherwise("FALSE") if dialect != "sqlite" else F.when(c, "1").otherwise("0")
    elif isinstance(kind, (P.FloatType, P.DoubleType)):
        finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
        made = F.when(finite, c.cast("string")).otherwise(F.raise_error(F.lit("a number that isn't finite has no SQL literal")))
    elif isinstance(kind, P.NumericType):
        made = c.cast("string")
    else:
        made = quoted(text(c, kind, dialect), dialect)
    return F.when(c.isNull(), F.lit("NULL")).otherwise(made)


def copy_field(c: Column, kind: P.DataType) -> Column:
    """A value in a COPY block."""
    c = text(c, kind)
    for old, new in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.coalesce(c, F.lit("\\N"))


def tuple_text(columns: list[tuple[str, P.DataType]], dialect: str) -> Column:
    """A row as `(literal, ...)`."""
    return F.concat(F.lit("("), F.concat_ws(", ", *(literal(F.col(f"`{n}`"), t, dialect) for n, t in columns)), F.lit(")"))


def copy_line(columns: list[tuple[str, P.DataType]]) -> Column:
    return F.concat_ws("\t", *(copy_field(F.col(f"`{n}`"), t) for n, t in columns))


def extended_json(c: Column, kind: P.DataType) -> Column:
    """A value in relaxed extended JSON: dates as `$date`; structs field by field, nulls kept."""
    if isinstance(kind, (P.TimestampType, P.TimestampNTZType)):
        return F.when(c.isNotNull(), F.struct(F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")).alias("$date")))
    if isinstance(kind, P.StructType):
        return F.when(c.isNotNull(), F.struct(*(extended_json(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, P.ArrayType):
        return F.transform(c, lambda x: extended_json(x, kind.elementType))
    return c


def json_line(schema: P.StructType) -> Column:
    """A document as one line of extended JSON."""
    made = F.struct(*(extended_json(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema.fields))
    return F.to_json(made, {"ignoreNullFields": "false"})
