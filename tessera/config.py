"""Schema config: one JSON object for each table or document collection, loaded strictly into frozen dataclasses."""

from __future__ import annotations

import functools
import json
import re
import time
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

Scalar = str | int | float | bool
MASKS = ("replace_with", "raw_sql", "map", "replace_with_fake_data", "replace_with_random", "unset")
#: Keys of an overlay's column that exclude one another.
MASK_GROUP = (*MASKS, "allow_unmasked")
DEFAULT_SPACE = "default"
_SPACE_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*\Z")
_PROFILE_NAME = re.compile(r"[a-z0-9_-]+\Z")
MANAGED_PREFIX = "rails_managed_"
COMPOSITE_KEY = "unsupported_composite_primary_key"


class ConfigError(ValueError):
    """A config that can't be used; the message names the table and the key."""


@dataclass(frozen=True)
class FakeData:
    seed: str
    type: str
    locale: str = "en"


@dataclass(frozen=True)
class Column:
    name: str
    replace_with: Scalar | None = None
    raw_sql: str | None = None
    map: str | None = None
    replace_with_fake_data: FakeData | None = None
    replace_with_random: str | None = None
    unset: bool = False
    comment: str | None = None
    ignore: bool = False
    allow_guessable_credential: bool = False
    allow_unmasked: bool = False
    needs_mask_decision: bool = False
    mongoid_field_name: str | None = None

    @property
    def masked(self) -> bool:
        return self.unset or any(getattr(self, k) is not None for k in MASKS if k != "unset")


@dataclass(frozen=True)
class BelongsTo:
    table_name: str
    foreign_key: str
    foreign_type: str | None = None
    type_value: str | None = None
    references: str | None = None
    ignore: bool = False
    ignore_type: str | None = None
    comment: str | None = None

    @property
    def polymorphic(self) -> bool:
        return self.foreign_type is not None

    @property
    def identity(self) -> tuple:
        return (self.table_name, self.foreign_key, self.foreign_type, self.type_value)


@dataclass(frozen=True)
class Arm:
    table: str
    column: str


@dataclass(frozen=True)
class ReverseScope:
    via: tuple[Arm, ...]
    column: str | None = None


@dataclass(frozen=True)
class BatchScope:
    table: str
    size: int = 1000


@dataclass(frozen=True)
class EmbeddedIn:
    collection_name: str
    path: str


@dataclass(frozen=True)
class Table:
    name: str
    primary_key: str | None = None
    columns: tuple[Column, ...] = ()
    belongs_tos: tuple[BelongsTo, ...] = ()
    type: str | None = None
    comment: str | None = None
    filter: str | None = None
    bulk_insert_chunk_size: int | None = None
    ignore: bool = False
    ignore_type: str | None = None
    scope_exempt: bool = False
    scope_column: str | None = None
    id_space: str | None = None
    reverse_scope: ReverseScope | None = None
    batch_scope: BatchScope | None = None
    query_timeout_ms: int | None = None
    embedded_in: EmbeddedIn | None = None
    document: bool = False

    @property
    def managed(self) -> bool:
        return bool(self.type and self.type.startswith(MANAGED_PREFIX))

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def self_links(self) -> list[BelongsTo]:
        """Plain relations to the table itself."""
        return [b for b in self.belongs_tos if b.table_name == self.name and not b.polymorphic]

    def edge(self, parent: str) -> BelongsTo | None:
        """The relation that leads to `parent`: the first declared, if there are several."""
        return next((b for b in self.belongs_tos if b.table_name == parent), None)


@dataclass(frozen=True)
class Schema:
    """All configs, in the order of their files."""

    tables: tuple[Table, ...]
    profile: str | None = None
    by_name: dict[str, Table] = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        self.by_name.update({t.name: t for t in self.tables})

    def __getitem__(self, name: str) -> Table:
        if name not in self.by_name:
            raise ConfigError(f"no config for table {name!r}")
        return self.by_name[name]

    def __contains__(self, name: str) -> bool:
        return name in self.by_name

    @property
    def live(self) -> list[Table]:
        return [t for t in self.tables if not t.ignore]


_COLUMN_KEYS = {"name", "replace_with", "raw_sql", "map", "replace_with_fake_data", "replace_with_random", "unset", "comment", "ignore", "allow_guessable_credential", "allow_unmasked", "needs_mask_decision"}
_FIELD_KEYS = _COLUMN_KEYS - {"raw_sql", "map"} | {"mongoid_field_name"}
_RELATION_KEYS = {"table_name", "foreign_key", "foreign_type", "type_value", "references", "ignore", "ignore_type", "comment"}
_TABLE_KEYS = {"name", "primary_key", "type", "comment", "filter", "belongs_tos", "columns", "bulk_insert_chunk_size", "ignore", "ignore_type", "scope_exempt", "scope_column", "id_space", "reverse_scope", "batch_scope"}
_COLLECTION_KEYS = {"name", "primary_key", "type", "comment", "filter", "belongs_tos", "fields", "bulk_insert_chunk_size", "ignore", "ignore_type", "reverse_scope", "query_timeout_ms", "embedded_in"}
_FLAGS = {"unset", "allow_unmasked", "allow_guessable_credential", "needs_mask_decision"}


def _strict(raw: Any, allowed: set[str], where: str) -> dict:
    if not isinstance(raw, dict):
        raise ConfigError(f"{where}: expected an object, not {type(raw).__name__}")
    if unknown := sorted(raw.keys() - allowed):
        raise ConfigError(f"{where}: unknown key {', '.join(unknown)}")
    for key in _FLAGS & raw.keys():
        if raw[key] is not True:
            raise ConfigError(f"{where}: {key} accepts only true")
    return raw


def _column(raw: Any, where: str, document: bool) -> Column:
    raw = dict(_strict(raw, _FIELD_KEYS if document else _COLUMN_KEYS, where))
    if not raw.get("name"):
        raise ConfigError(f"{where}: a column needs a name")
    where = f"{where}.{raw['name']}"
    if (fake := raw.get("replace_with_fake_data")) is not None:
        fake = _strict(fake, {"seed", "type", "locale"}, where)
        if not fake.get("seed") or not fake.get("type"):
            raise ConfigError(f"{where}: replace_with_fake_data needs seed and type")
        raw["replace_with_fake_data"] = FakeData(**fake)
    column = Column(**raw)
    own = [m for m in MASKS if (column.unset if m == "unset" else getattr(column, m) is not None)]
    if len(own) > 1 and set(own) != {"raw_sql", "replace_with"}:
        raise ConfigError(f"{where}: {' and '.join(own)} exclude one another")
    if column.replace_with_random is not None:
        found = re.fullmatch(r"hex:(\d+)", column.replace_with_random)
        if not found or not 16 <= int(found[1]) <= 1024:
            raise ConfigError(f"{where}: replace_with_random must be hex:<16 to 1024>")
    return column


def parse_table(raw: dict, where: str = "") -> Table:
    """A table from its JSON object, checked; ignored columns and relations are left out."""
    where = where or str(raw.get("name"))
    document = "fields" in raw or "embedded_in" in raw
    raw = dict(_strict(raw, _COLLECTION_KEYS if document else _TABLE_KEYS, where))
    if not raw.get("name"):
        raise ConfigError(f"{where}: a table needs a name")
    columns = tuple(_column(c, where, document) for c in raw.pop("fields" if document else "columns", None) or [])
    relations = []
    for r in raw.pop("belongs_tos", None) or []:
        r = _strict(r, _RELATION_KEYS, f"{where}.belongs_tos")
        if not r.get("table_name") or not r.get("foreign_key"):
            raise ConfigError(f"{where}: a belongs_to needs table_name and foreign_key")
        if ("foreign_type" in r) != ("type_value" in r):
            raise ConfigError(f"{where}: foreign_type and type_value go together")
        relations.append(BelongsTo(**r))
    for name, list_, key in (("columns", columns, lambda c: c.name), ("belongs_tos", relations, lambda b: b.identity)):
        keys = [key(x) for x in list_]
        if len(set(keys)) < len(keys):
            raise ConfigError(f"{where}: repeated entry in {name}")
    if (reverse := raw.get("reverse_scope")) is not None:
        reverse = _strict(reverse, {"via", "column"}, f"{where}.reverse_scope")
        via = [_strict(a, {"table", "column"}, f"{where}.reverse_scope.via") for a in reverse.get("via") or []]
        if not via or any(not a.get("table") or not a.get("column") for a in via):
            raise ConfigError(f"{where}: reverse_scope needs via with table and column")
        raw["reverse_scope"] = ReverseScope(tuple(Arm(**a) for a in via), reverse.get("column"))
    if (batch := raw.get("batch_scope")) is not None:
        raw["batch_scope"] = BatchScope(**_strict(batch, {"table", "size"}, f"{where}.batch_scope"))
        if not isinstance(raw["batch_scope"].size, int) or raw["batch_scope"].size < 1:
            raise ConfigError(f"{where}: batch_scope.size must be 1 or more")
    if (embedded := raw.get("embedded_in")) is not None:
        raw["embedded_in"] = EmbeddedIn(**_strict(embedded, {"collection_name", "path"}, f"{where}.embedded_in"))
    table = Table(**raw, columns=columns, belongs_tos=tuple(relations), document=document)
    _check(table, where)
    return replace(table, columns=tuple(c for c in columns if not c.ignore), belongs_tos=tuple(b for b in relations if not b.ignore))


def _check(t: Table, where: str) -> None:
    live = {c.name for c in t.columns if not c.ignore}
    if t.managed:
        if t.primary_key or t.columns or t.belongs_tos or t.reverse_scope or t.batch_scope:
            raise ConfigError(f"{where}: a managed table has no primary key, columns, relations, reverse_scope or batch_scope")
        return
    if t.ignore:
        return
    if not t.primary_key:
        raise ConfigError(f"{where}: primary_key is required unless the table is ignored")
    if t.columns and not live:
        raise ConfigError(f"{where}: every column is ignored")
    if t.reverse_scope and t.reverse_scope.column and t.reverse_scope.column not in live:
        raise ConfigError(f"{where}: reverse_scope.column {t.reverse_scope.column} isn't a column")
    if t.id_space is not None and (not _SPACE_NAME.match(t.id_space) or not t.scope_column):
        raise ConfigError(f"{where}: id_space needs a plain name and a scope_column")
    for c in t.columns:
        if c.replace_with_fake_data and not c.ignore and seed_column(t.name, c.replace_with_fake_data.seed) not in live:
            raise ConfigError(f"{where}.{c.name}: seed {c.replace_with_fake_data.seed} isn't a column of the table")
    if t.document:
        if t.filter:
            raise ConfigError(f"{where}: filter isn't supported for documents")
        if t.embedded_in and (t.belongs_tos or t.reverse_scope):
            raise ConfigError(f"{where}: an embedded collection has no relations or reverse_scope")
        if any(c.name == t.primary_key and c.ignore for c in t.columns):
            raise ConfigError(f"{where}: the primary key can't be ignored")


def seed_column(table: str, seed: str) -> str:
    """A fake-data seed without its table's name."""
    return seed.removeprefix(f"{table}.")


# Profile overlays


def merge_overlay(base: dict, overlay: dict) -> dict:
    """The base object with an overlay's keys: scalars replace, lists merge by their entries' identity, null removes."""
    where = str(base.get("name"))
    if overlay.get("name") != base.get("name"):
        raise ConfigError(f"{where}: an overlay must have the name of its base")
    out = dict(base)
    required = {"name", "columns", "fields", "belongs_tos"}
    identities = {"columns": ("name",), "fields": ("name",), "belongs_tos": ("table_name", "foreign_key", "foreign_type", "type_value")}
    for key, value in overlay.items():
        if key == "name":
            continue
        if value is None:
            if key in required:
                raise ConfigError(f"{where}: {key} can't be removed by an overlay")
            out.pop(key, None)
        elif key in identities:
            out[key] = _merge_list(where, key, list(base.get(key) or []), value, identities[key])
        else:
            out[key] = value
    return out


def _merge_list(where: str, key: str, entries: list[dict], changes: list[dict], identity: tuple[str, ...]) -> list[dict]:
    name = lambda e: tuple(e.get(k) for k in identity)
    seen = set()
    for change in changes:
        if name(change) in seen:
            raise ConfigError(f"{where}: repeated entry in the overlay's {key}: {name(change)}")
        seen.add(name(change))
        at = next((i for i, e in enumerate(entries) if name(e) == name(change)), None)
        if at is None:
            raise ConfigError(f"{where}: an overlay can't add to {key}: {name(change)}")
        merged = dict(entries[at])
        for flag in _FLAGS & change.keys():
            if change[flag] not in (True, None):
                raise ConfigError(f"{where}: {flag} accepts only true")
        if any(change.get(m) is not None for m in MASK_GROUP):
            merged = {k: v for k, v in merged.items() if k not in MASK_GROUP}
        for k, v in change.items():
            if v is None and k not in identity:
                merged.pop(k, None)
            elif v is not None:
                merged[k] = v
        entries[at] = merged
    return entries


def prune_overlay(overlay: dict, base: dict) -> tuple[dict, list[str]]:
    """The overlay without entries that the base no longer has, and their names."""
    out, gone = dict(overlay), []
    for key, identity in (("columns", ("name",)), ("fields", ("name",)), ("belongs_tos", ("table_name", "foreign_key", "foreign_type", "type_value"))):
        if key in out:
            have = {tuple(e.get(k) for k in identity) for e in base.get(key) or []}
            keep = [e for e in out[key] if tuple(e.get(k) for k in identity) in have]
            gone += [f"{base['name']}.{key}.{e.get(identity[0])}" for e in out[key] if e not in keep]
            out[key] = keep
    return out, gone


# Directories and run configs


def read_objects(directory: str | Path, profiles: tuple[str, ...] = ()) -> tuple[dict[str, dict], dict[tuple[str, str], dict]]:
    """Base objects by table, and overlays by (profile, table), of a directory's JSON files in the order of their paths."""
    base: dict[str, dict] = {}
    overlays: dict[tuple[str, str], dict] = {}
    for path in sorted(Path(directory).glob("*.json")):
        try:
            raw = json.loads(path.read_text(encoding="utf-8"))
        except ValueError as e:
            raise ConfigError(f"{path}: {e}") from e
        profile = path.name.split(".")[-2] if path.name.count(".") > 1 else None
        if profile in profiles:
            overlays[(profile, raw.get("name"))] = raw
        elif raw.get("name") in base:
            raise ConfigError(f"{path}: table {raw['name']} has two files")
        else:
            base[raw.get("name")] = raw
    for profile, name in overlays:
        if name not in base:
            raise ConfigError(f"{name}.{profile}: an overlay without a base")
    return base, overlays


def build_schema(objects: list[dict] | dict[str, dict], overlays: dict[tuple[str, str], dict] | None = None, profile: str | None = None) -> Schema:
    """A checked schema from JSON objects, with a profile's overlays merged."""
    objects = list(objects.values()) if isinstance(objects, dict) else objects
    merged = [merge_overlay(o, overlays[(profile, o["name"])]) if overlays and (profile, o["name"]) in overlays else o for o in objects]
    schema = Schema(tuple(parse_table(o) for o in merged), profile)
    if len(schema.by_name) < len(schema.tables):
        raise ConfigError("a table has two configs")
    for t in schema.live:
        for b in t.belongs_tos:
            if b.table_name in schema and schema[b.table_name].ignore:
                raise ConfigError(f"{t.name}: belongs to {b.table_name}, which is ignored")
    return schema


def load_schema(directory: str | Path, profile: str | None = None, profiles: tuple[str, ...] = ()) -> Schema:
    if profile is not None and profile not in profiles:
        raise ConfigError(f"profile {profile!r} isn't declared")
    base, overlays = read_objects(directory, profiles)
    return build_schema(base, overlays, profile)


@functools.lru_cache(16)
def _cached(directory: str, profile: str | None, profiles: tuple[str, ...], minute: int) -> Schema:
    return load_schema(directory, profile, profiles)


def cached_schema(directory: str, profile: str | None = None, profiles: tuple[str, ...] = (), ttl: int = 60) -> Schema:
    """A schema that is read again after `ttl` seconds at the latest."""
    return _cached(str(directory), profile, profiles, int(time.time() // ttl))


RUN_KEYS = {"schema_dir", "output_dir", "target_table", "ids", "ids_field", "mode", "recursive", "profile", "profiles", "check", "output_format", "source_dir", "dialect", "log_level", "scope_column", "parallelism"}
_PATHS = ("schema_dir", "output_dir", "source_dir")


def load_run_config(path: str | Path) -> dict:
    """A run config (YAML where a YAML library is installed, else JSON); relative paths are from the file's folder."""
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    try:
        import yaml

        raw = yaml.safe_load(text) or {}
    except ImportError:
        raw = json.loads(text)
    raw = _strict(raw, RUN_KEYS, str(path))
    for p in raw.get("profiles") or []:
        if not _PROFILE_NAME.match(str(p)) or p == "base":
            raise ConfigError(f"{path}: {p!r} can't be a profile's name")
    return raw | {k: str((path.parent / raw[k]).resolve()) for k in _PATHS if raw.get(k)}


def parse_ids(values: list[str] | dict[str, list] | list) -> dict[str, list]:
    """ID spaces from a mapping, from plain values, or from texts such as `1,2` and `org=a,b`."""
    if isinstance(values, dict):
        return {str(k): list(v) for k, v in values.items()}
    out: dict[str, list] = {}
    for value in values:
        if not isinstance(value, str):
            out.setdefault(DEFAULT_SPACE, []).append(value)
            continue
        space, _, rest = value.partition("=") if re.match(r"[A-Za-z_][A-Za-z0-9_-]*=", value) else (DEFAULT_SPACE, "", value)
        out.setdefault(space, []).extend(x.strip() for x in rest.split(",") if x.strip())
    return out
