"""Configs from a catalog, and checks of configs: generate, tidy, drift, and static rules on names."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as P

from . import config as C
from .functions.masks import default_mask
from .operators.lower import semi


@dataclass(frozen=True)
class Found:
    """What a catalog says of a table. unique: columns under a unique index, or None if unknown (then all count as unique)."""

    name: str
    schema: P.StructType
    primary_key: str | tuple[str, ...] | None = None
    foreign_keys: tuple[tuple[str, str], ...] = ()
    unique: frozenset[str] | None = frozenset()
    limits: dict[str, int] = field(default_factory=dict)
    defaults: dict[str, C.Scalar] = field(default_factory=dict)
    #: Of a document: whether it is one, and the collection and path that it is embedded at.
    document: bool = False
    embedded: tuple[str, str] | None = None


def introspect(frames: dict[str, DataFrame], keys: dict[str, str | tuple[str, ...]] | None = None, relations: dict[str, list[tuple[str, str]]] | None = None) -> list[Found]:
    """Tables of a source. Keys and relations (column, parent) are hints, as files don't hold any; keys may be inferred first."""
    return [Found(n, df.schema, (keys or {}).get(n), tuple((relations or {}).get(n, ()))) for n, df in sorted(frames.items())]


def introspect_catalog(spark: SparkSession, database: str | None = None, **hints) -> list[Found]:
    """Tables, not views, of the session's catalog."""
    names = [t.name for t in spark.catalog.listTables(database) if t.tableType not in ("VIEW", "TEMPORARY")]
    return introspect({n: spark.table(f"{database}.{n}" if database else n) for n in names}, **hints)


# Databases. Type names of information_schema, and the Spark types that masks fit; others stay unmasked.
_DATABASE_TYPES = {
    "postgresql": {"character": "string", "character varying": "string", "text": "string", "smallint": "smallint", "integer": "int", "bigint": "bigint", "numeric": "decimal(38,18)", "real": "float", "double precision": "double", "boolean": "boolean", "date": "date", "timestamp without time zone": "timestamp_ntz", "timestamp with time zone": "timestamp", "json": "variant", "jsonb": "variant"},
    "mysql": {"char": "string", "varchar": "string", "tinytext": "string", "text": "string", "mediumtext": "string", "longtext": "string", "tinyint": "tinyint", "smallint": "smallint", "mediumint": "int", "int": "int", "bigint": "bigint", "decimal": "decimal(38,18)", "float": "float", "double": "double", "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp", "json": "variant"},
}


def introspection_queries(adapter: str, schema: str) -> dict[str, str]:
    """Queries for a database's columns, primary keys, single-column foreign keys and unique columns; views are left out."""
    if adapter not in _DATABASE_TYPES:
        raise C.ConfigError(f"no introspection for {adapter!r}")
    own = "'" + schema.replace("'", "''") + "'"
    kind = "c.column_type" if adapter == "mysql" else "c.data_type"
    usage = "information_schema.key_column_usage k JOIN information_schema.table_constraints t ON t.constraint_name = k.constraint_name AND t.table_schema = k.table_schema AND t.table_name = k.table_name"
    parent = "k.referenced_table_name" if adapter == "mysql" else "u.table_name"
    joined = "" if adapter == "mysql" else " JOIN information_schema.constraint_column_usage u ON u.constraint_name = k.constraint_name AND u.table_schema = k.table_schema"
    return {
        "columns": f"SELECT c.table_name, c.column_name, c.data_type, {kind} AS full_type, c.character_maximum_length AS length, c.column_default FROM information_schema.columns c JOIN information_schema.tables t ON t.table_schema = c.table_schema AND t.table_name = c.table_name WHERE c.table_schema = {own} AND t.table_type = 'BASE TABLE' ORDER BY c.table_name, c.ordinal_position",
        "keys": f"SELECT k.table_name, k.column_name FROM {usage} WHERE t.constraint_type = 'PRIMARY KEY' AND k.table_schema = {own} ORDER BY k.table_name, k.ordinal_position",
        "relations": f"SELECT k.constraint_name, k.table_name, k.column_name, {parent} AS parent FROM {usage}{joined} WHERE t.constraint_type = 'FOREIGN KEY' AND k.table_schema = {own} ORDER BY k.table_name, k.ordinal_position",
        "unique": f"SELECT k.table_name, k.column_name FROM {usage} WHERE t.constraint_type = 'UNIQUE' AND k.table_schema = {own}",
    }


def _default(text: str | None, kind: P.DataType) -> C.Scalar | None:
    """A column's default, if it is a constant; an expression such as now() is none."""
    if text is None:
        return None
    text = re.sub(r"::[\w ]+(\(\d+\))?$", "", str(text)).strip().strip("'")
    if isinstance(kind, P.BooleanType):
        return {"true": True, "1": True, "false": False, "0": False}.get(text.lower())
    if isinstance(kind, P.NumericType):
        return (float(text) if "." in text else int(text)) if re.fullmatch(r"-?\d+(\.\d+)?", text) else None
    if isinstance(kind, P.DateType):
        return text if re.fullmatch(r"\d{4}-\d\d-\d\d", text) else None
    return None


def found_of_rows(adapter: str, columns: list[tuple], keys: list[tuple], relations: list[tuple], unique: list[tuple]) -> list[Found]:
    """Tables from the rows of introspection_queries(). Types that no mask fits become binary; composite foreign keys are left out."""
    kinds = _DATABASE_TYPES[adapter]
    by: dict[str, dict] = {}
    for name, column, kind, full, length, default in columns:
        t = by.setdefault(name, {"schema": P.StructType(), "limits": {}, "defaults": {}})
        spark = "boolean" if adapter == "mysql" and full == "tinyint(1)" else kinds.get(kind, "binary")
        t["schema"].add(column, P.DataType.fromDDL(spark))
        if length is not None:
            t["limits"][column] = int(length)
        if (value := _default(default, t["schema"][column].dataType)) is not None:
            t["defaults"][column] = value
    own: dict[str, list[str]] = {}
    for name, column in keys:
        own.setdefault(name, []).append(column)
    links: dict[str, list[tuple]] = {}
    for constraint, name, column, parent in relations:
        links.setdefault((constraint, name), []).append((column, parent))
    out = []
    for name, t in by.items():
        key = own.get(name, [])
        single = tuple(v[0] for (_, n), v in links.items() if n == name and len({c for c, _ in v}) == 1)
        out.append(Found(name, t["schema"], key[0] if len(key) == 1 else tuple(key) or None, single, frozenset(c for n, c in unique if n == name), t["limits"], t["defaults"]))
    return out


def introspect_database(spark: SparkSession, adapter: str, url: str, schema: str, **options) -> list[Found]:
    """Tables of a database, read over JDBC."""
    from .sources import jdbc_options

    rows = {}
    for what, sql in introspection_queries(adapter, schema).items():
        o = jdbc_options(adapter, url, what, **options)
        o["dbtable"] = f"({sql.split(' ORDER BY ')[0]}) AS q"
        rows[what] = [tuple(r) for r in spark.read.format("jdbc").options(**o).load().collect()]
    return found_of_rows(adapter, rows["columns"], rows["keys"], rows["relations"], rows["unique"])


def infer_key(df: DataFrame) -> str | None:
    """The first column whose values are all there and all distinct: exact, in one aggregate for all columns."""
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, (P.ArrayType, P.MapType, P.StructType, P.FloatType, P.DoubleType))]
    if not names:
        return None
    row = df.agg(F.count("*").alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)), *(F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(names))).first()
    return next((c for i, c in enumerate(names) if row["n"] and row[f"c{i}"] == row[f"d{i}"] == row["n"]), None)


def included(child: DataFrame, column: str, parent: DataFrame, key: str) -> bool:
    """Whether every value of a column is a key of the parent."""
    keys = parent.select(F.col(f"`{key}`").alias("__key"))
    return semi(child.where(F.col(f"`{column}`").isNotNull()), column, keys, "left_anti").isEmpty()


def _object(found: Found, old: dict | None, safe: bool) -> dict:
    """A table's JSON object: the catalog's structure, and what an old one says by hand."""
    out: dict = {"name": found.name}
    key = found.primary_key
    if isinstance(key, tuple):
        out |= {"ignore": True, "type": C.COMPOSITE_KEY, "comment": f"composite primary key ({', '.join(key)})"}
        key = None
    elif key:
        out["primary_key"] = key
    else:
        out |= {"ignore": True, "comment": "no primary key"}
    if found.embedded:
        out["embedded_in"] = {"collection_name": found.embedded[0], "path": found.embedded[1]}
    entries = "fields" if found.document else "columns"
    if old:
        if old.get("primary_key") and "primary_key" not in out:
            out = {"name": found.name, "primary_key": old["primary_key"]}
        out |= {k: v for k, v in old.items() if k not in ("name", "columns", "fields", "belongs_tos") and (k not in ("ignore", "comment", "type") or k in old)}
    relations = list((old or {}).get("belongs_tos") or [])
    known = {(r["table_name"], r["foreign_key"]) for r in relations}
    relations += [{"table_name": p, "foreign_key": c} for c, p in found.foreign_keys if (p, c) not in known]
    if relations or found.document and not found.embedded:
        out["belongs_tos"] = relations
    structural = {out.get("primary_key")} | {r["foreign_key"] for r in relations} | {r.get("foreign_type") for r in relations}
    by_name = {c["name"]: c for c in (old or {}).get(entries) or []}
    columns = []
    for f in found.schema.fields:
        if f.name in by_name:
            columns.append(by_name[f.name])
            continue
        column: dict = {"name": f.name}
        if safe and f.name not in structural:
            unique = found.unique is None or f.name in found.unique
            mask = default_mask(f.name, f.dataType, out.get("primary_key"), found.limits.get(f.name), found.defaults.get(f.name), unique)
            if mask is not None:
                column["replace_with"] = mask
            column["needs_mask_decision"] = True
        columns.append(column)
    columns += [c for n, c in by_name.items() if n not in found.schema.fieldNames()]
    out[entries] = columns
    return out


def generate(found: list[Found], old: dict[str, dict] | None = None, safe: bool = True) -> dict[str, dict]:
    """JSON objects by table: new tables and columns are added, the rest stays; nothing is removed."""
    old = old or {}
    made = {t.name: _object(t, old.get(t.name), safe) for t in found}
    return made | {n: o for n, o in old.items() if n not in made}


def tidy(found: list[Found], objects: dict[str, dict]) -> dict[str, dict]:
    """The objects without tables and columns that are gone, and without live relations to tables that are gone."""
    by = {t.name: t for t in found}
    out = {}
    for name, o in objects.items():
        if name not in by:
            continue
        o = dict(o)
        have = set(by[name].schema.fieldNames())
        for entries in ("columns", "fields"):
            if entries in o:
                o[entries] = [c for c in o[entries] if c["name"] in have]
        if "belongs_tos" in o:
            o["belongs_tos"] = [r for r in o["belongs_tos"] if r.get("ignore") or r["table_name"] in by]
        out[name] = o
    return out


def write_objects(objects: dict[str, dict], directory: str | Path) -> None:
    path = Path(directory)
    path.mkdir(parents=True, exist_ok=True)
    for name, o in objects.items():
        (path / f"{name}.json").write_text(json.dumps(o, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def drift(found: list[Found], objects: dict[str, dict], overlays: dict[tuple[str, str], dict] | None = None) -> dict[str, list[str]]:
    """How the objects differ from what generating and tidying would make of them."""
    fresh = tidy(found, generate(found, objects))
    names = lambda os: {f"{n}.{c['name']}" for n, o in os.items() for c in _entries(o)}
    both = objects.keys() & fresh.keys()
    live = {n for n, o in objects.items() if not o.get("ignore")}
    removed = names({n: objects[n] for n in both}) - names({n: fresh[n] for n in both})
    report = {
        "added_tables": sorted(fresh.keys() - objects.keys()),
        "added_columns": sorted(names({n: fresh[n] for n in both}) - names({n: objects[n] for n in both})),
        "removed_tables": sorted(objects.keys() - fresh.keys()),
        "removed_columns": sorted(removed),
        "changed_tables": sorted(n for n in both if objects[n] != fresh[n]),
        "needs_mask_decision": sorted(f"{n}.{c['name']}" for n, o in objects.items() for c in _entries(o) if c.get("needs_mask_decision")),
        "stale_tables": sorted((objects.keys() - fresh.keys()) & live),
        "stale_columns": sorted(r for r in removed if r.split(".")[0] in live and not _ignored(objects, r)),
    }
    if overlays:
        report["overlay_stale"] = sorted(f"{p}:{g}" for (p, n), o in overlays.items() for g in (C.prune_overlay(o, fresh[n])[1] if n in fresh else [n]))
    return report


def _ignored(objects: dict[str, dict], path: str) -> bool:
    table, column = path.split(".", 1)
    return any(c["name"] == column and c.get("ignore") for c in _entries(objects[table]))


def _entries(o: dict) -> list[dict]:
    """The columns of a table's object, or the fields of a collection's."""
    return [*(o.get("columns") or []), *(o.get("fields") or [])]


def report_frame(spark: SparkSession, report: dict[str, list[str]]) -> DataFrame:
    """(kind, name) rows of a report."""
    return spark.createDataFrame([(k, v) for k, vs in report.items() for v in vs], "kind string, name string")


# Static checks. A name is split into words; single words, and words that follow each other, say what a column holds.
#: Words and phrases for something that lets its holder in.
CREDENTIALS = ("password", "passwd", "pwd", "passphrase", "pin", "secret", "token", "jwt", "cookie", "credential", "api key", "signing key", "private key", "session id", "recovery code")
#: Words and phrases for data on a person: how to reach them, who they are, what they pay with, where they are.
PERSONAL = (
    "email", "mail", "phone", "telephone", "cell", "fax", "address", "street", "postcode", "postal code", "zip",
    "surname", "nickname", "first name", "last name", "legal name", "maiden name", "birthday", "birth date", "date of birth", "dob", "gender",
    "passport", "ssn", "national id", "tax id", "driver license",
    "iban", "card number", "cvv", "account number", "salary",
    "latitude", "longitude", "ip", "hash",
)
#: A last word that makes a name one of a time, a number or a mark about such data, not the data.
ABOUT = frozenset({"at", "on", "count", "verified", "enabled", "length"})
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_words(name: str) -> list[str]:
    """The lower-case words of a name in snake or camel case, without a plural's ending."""
    words = (w.lower() for w in _WORD.findall(name))
    return [w[:-2] if w.endswith(("sses", "xes", "ches", "shes")) else w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in words]


def names_one_of(name: str, phrases: tuple[str, ...]) -> bool:
    """Whether a name has one of the phrases, its words apart or written as one, and isn't merely about it."""
    words = name_words(name)
    if not words or words[-1] in ABOUT:
        return False
    for phrase in phrases:
        parts = name_words(phrase.replace(" ", "_"))
        if "".join(parts) in words or any(words[i : i + len(parts)] == parts for i in range(len(words))):
            return True
    return False


CHECKS = ("integrity", "guessable_credentials", "unmasked_sensitive")


@dataclass(frozen=True)
class CheckConfig:
    """Which checks run: by name, their extra patterns and the profiles to judge (None: base and all)."""

    patterns: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"integrity": ()})
    profiles: dict[str, tuple[str, ...] | None] = field(default_factory=dict)

    @staticmethod
    def of(raw: dict | None) -> CheckConfig:
        patterns, profiles = {"integrity": ()}, {}
        for name, options in (raw or {}).items():
            if name not in CHECKS:
                raise C.ConfigError(f"unknown check {name!r}")
            if options is False:
                patterns.pop(name, None)
                continue
            options = {} if options is True else options
            if not isinstance(options, dict) or set(options) - {"patterns", "profiles"}:
                raise C.ConfigError(f"check {name}: unknown options")
            for p in options.get("patterns") or ():
                try:
                    re.compile(p)
                except re.error as e:
                    raise C.ConfigError(f"check {name}: {p!r} isn't a pattern: {e}") from e
            patterns[name] = tuple(options.get("patterns") or ())
            if options.get("profiles") is not None:
                profiles[name] = tuple(options["profiles"])
        return CheckConfig(patterns, profiles)


def _matches(name: str, phrases: tuple[str, ...], patterns: tuple[str, ...]) -> bool:
    return names_one_of(name, phrases) or any(re.search(p, name, re.I) for p in patterns)


def _judge(schema: C.Schema, check: str, config: CheckConfig) -> list[str]:
    out = []
    credentials = CREDENTIALS, config.patterns.get("guessable_credentials", ())
    sensitive = (*CREDENTIALS, *PERSONAL), (*credentials[1], *config.patterns.get("unmasked_sensitive", ()))
    for t in schema.live:
        if t.managed:
            continue
        where = f"{t.embedded_in.collection_name}.{t.embedded_in.path}" if t.embedded_in else t.name
        if check == "integrity":
            key = next((c for c in t.columns if c.name == t.primary_key), None)
            if t.columns and (key is None or key.masked):
                out.append(f"{where}.{t.primary_key}: the primary key is {'masked' if key else 'not selected'}")
            continue
        exempt = {t.primary_key} | {b.foreign_key for b in t.belongs_tos}
        for c in t.columns:
            path = f"{where}.{c.name}"
            if check == "guessable_credentials":
                guessable = _matches(c.name, *credentials) and c.masked and not c.unset and c.replace_with_random is None
                if guessable and not c.allow_guessable_credential:
                    out.append(f"{path}: a credential masked to a value that can be guessed")
                if c.allow_guessable_credential and not guessable:
                    out.append(f"{path}: allow_guessable_credential guards nothing")
            else:
                open_ = _matches(c.name, *sensitive) and not c.masked and c.name not in exempt
                if open_ and not c.allow_unmasked:
                    out.append(f"{path}: looks sensitive and isn't masked")
                if c.allow_unmasked and not open_:
                    out.append(f"{path}: allow_unmasked guards nothing")
    return out


def static_checks(objects: dict[str, dict], overlays: dict[tuple[str, str], dict] | None = None, profiles: tuple[str, ...] = (), config: CheckConfig | None = None) -> dict[str, list[str]]:
    """Findings by check, each with the profiles in which it occurs."""
    config = config or CheckConfig()
    report = {}
    for check in config.patterns:
        seen: dict[str, list[str]] = {}
        for profile in config.profiles.get(check) or ("base", *profiles):
            try:
                schema = C.build_schema(objects, overlays, None if profile == "base" else profile)
                found = _judge(schema, check, config)
            except C.ConfigError as e:
                found = [str(e)] if check == "integrity" else []
            for f in found:
                seen.setdefault(f, []).append(profile)
        report[check] = sorted(f"{f.split(': ', 1)[0]} [{', '.join(p)}]: {f.split(': ', 1)[-1]}" for f, p in seen.items())
    return report


def introspect_documents(frames: dict[str, DataFrame] | dict[str, P.StructType], relations: dict[str, list[tuple[str, str]]] | None = None) -> list[Found]:
    """Collections of a source, and the collections embedded in them: structs, and arrays of structs, by their path.

    The fields are those of any document. A struct of one type at several places is a collection at each of them.
    """
    out: list[Found] = []

    def add(name: str, kind: P.StructType, embedded: tuple[str, str] | None) -> None:
        own = P.StructType()
        inner: list[tuple[str, P.StructType]] = []
        for f in kind.fields:
            element = f.dataType.elementType if isinstance(f.dataType, P.ArrayType) else f.dataType
            if isinstance(element, P.StructType) and set(element.fieldNames()) != {"$oid"}:
                inner.append((f.name, element))
            else:
                own.add(f)
        key = next((k for k in ("_id", "id") if k in own.fieldNames()), next(iter(own.fieldNames()), "_id"))
        out.append(Found(name, own, key, () if embedded else tuple((relations or {}).get(name, ())), embedded=embedded, document=True))
        for field_name, element in inner:
            root, path = (embedded[0], f"{embedded[1]}.{field_name}") if embedded else (name, field_name)
            add(f"{name}_{field_name}", element, (root, path))

    for name, kind in sorted(frames.items()):
        add(name, kind if isinstance(kind, P.StructType) else kind.schema, None)
    return out


def generate_documents(frames: dict[str, P.StructType], old: dict[str, dict] | None = None, relations: dict[str, list[tuple[str, str]]] | None = None, safe: bool = True) -> dict[str, dict]:
    """JSON objects of collections from nested types; structs and arrays of structs become embedded collections of their own."""
    return generate(introspect_documents(frames, relations), old, safe)
