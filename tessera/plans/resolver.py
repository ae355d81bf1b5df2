"""Narrowing: from a schema and a request to a plan for each table.

Two modes. With a target, rows related to the target's ids are kept: its own rows, those on a path
to it, what a narrowed table points at, what belongs to narrowed rows, and else everything. With
scope columns, tables that carry the scope are filtered on it and the others follow, and a table
that nothing narrows is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..config import DEFAULT_SPACE, BelongsTo, ConfigError, Schema, Table, parse_ids
from ..graph import Path, shortest_path
from .nodes import All, Among, AnyOf, In, Keys, KeysOf, Matching, Node, Typed, WithAncestors, constrained, describe, reads, spaces

#: How deep declared reverse scopes may nest before a warning.
DEEP_CHAIN = 3


@dataclass(frozen=True)
class Request:
    """What to extract: ids of a target table, or values of scope columns by ID space."""

    ids: dict[str, list] = field(default_factory=dict)
    target: str | None = None
    ids_field: str | None = None
    scope_column: str | None = None
    mode: str | None = None
    recursive: bool = True

    @staticmethod
    def of(target: str | None = None, ids: list | dict | None = None, **rest) -> Request:
        return Request(parse_ids(ids or []), target, **rest)


@dataclass(frozen=True)
class Context:
    """What a nested build may use: detection of referencers, declared reverse scopes, and the tables on the way."""

    automatic: bool = True
    declared: bool = True
    forward: tuple[str, ...] = ()
    reverse: tuple[str, ...] = ()
    ancestors: bool = True
    batch: tuple | None = None

    @property
    def top(self) -> bool:
        return not self.forward and not self.reverse


@dataclass(frozen=True)
class Plan:
    """The rows of a table to keep, the rule that chose them, and what to tell about it."""

    node: Node
    rule: str
    notes: tuple[str, ...] = ()
    automatic_reverse: bool = False

    @property
    def narrowed(self) -> bool:
        return constrained(self.node)

    def explain(self) -> str:
        return f"{self.node.table}: {self.rule}\n{describe(self.node, 1)}" + "".join(f"\n  note: {n}" for n in self.notes)


class Resolver:
    """Plans of a schema's tables for one request. Plans are kept by table and context, so chains don't grow exponentially."""

    def __init__(self, schema: Schema, request: Request, apply_filters: str = "related"):
        """apply_filters: "related" adds a table's own filter where its direct relation, scope or arms narrow it; "always" everywhere."""
        self.schema, self.request, self.always = schema, request, apply_filters == "always"
        self.scoped = scope_mode(schema, request)
        self._known: dict[tuple, Plan] = {}
        self._paths: dict[tuple, Path | None] = {}

    def plan(self, name: str, context: Context | None = None) -> Plan:
        context = context or Context()
        key = (name, context)
        if key not in self._known:
            table = self.schema[name]
            made = self._scoped(table, context) if self.scoped else self._targeted(table, context)
            if self.always and table.filter and made.narrowed and table.filter not in describe(made.node).split("all " + name)[0]:
                made = replace(made, node=Matching(made.node, table.filter))
            self._known[key] = self._with_ancestors(table, made, context)
        return self._known[key]

    def plans(self) -> dict[str, Plan]:
        """Plans of all live tables; only the target's without recursion."""
        check_request(self.schema, self.request)
        names = [t.name for t in self.schema.live if not t.embedded_in]
        if not self.request.recursive:
            names = [self.request.target]
        if self.scoped:
            lost = [n for n in names if self.category(n) == "unscopable"]
            if lost:
                raise ConfigError(f"nothing narrows {', '.join(lost)}: declare scope_column, add a belongs_to, or set ignore or scope_exempt")
        check_spaces(self)
        return {n: self.plan(n) for n in names}

    # Shared pieces

    def _ids(self, space: str = DEFAULT_SPACE) -> tuple:
        return tuple(self.request.ids.get(space, ()))

    def _with_ancestors(self, table: Table, plan: Plan, context: Context) -> Plan:
        links = tuple((b.foreign_key, b.references or table.primary_key) for b in table.self_links)
        if not links or not context.ancestors or context.batch or not plan.narrowed or table.batch_scope or table.document:
            return plan
        return replace(plan, node=WithAncestors(plan.node, table.primary_key, links), rule=plan.rule + "+ancestors")

    def _own_filter(self, table: Table, node: Node) -> Node:
        return Matching(node, table.filter) if table.filter else node

    def _parent_key(self, b: BelongsTo) -> str:
        return b.references or self.schema[b.table_name].primary_key

    def _hop(self, node: Node, b: BelongsTo, keys: Keys) -> Node:
        node = Typed(node, b.foreign_type, b.type_value) if b.polymorphic else node
        return In(node, b.foreign_key, keys)

    def _along(self, path: Path, end: Node | None) -> Node:
        """The first table's rows over a path. `end`: rows of the last parent, or None for the target, which is not read."""
        (name, b), rest = path[0], path[1:]
        if not rest:
            if end is None:
                return self._target_link(All(name), b)
            return self._hop(All(name), b, KeysOf(end, self._parent_key(b)))
        inner = self._along(rest, end)
        return self._hop(All(name), b, KeysOf(self._own_filter(self.schema[inner.table], inner), self._parent_key(b)))

    def _target_link(self, node: Node, b: BelongsTo) -> Node:
        """Rows that point at the target's ids."""
        node = Typed(node, b.foreign_type, b.type_value) if b.polymorphic else node
        target = self.schema[self.request.target]
        key = self._parent_key(b)
        if self.request.ids_field in (None, key) and key == target.primary_key or self.request.ids_field == key:
            return Among(node, b.foreign_key, self._ids())
        return In(node, b.foreign_key, KeysOf(Among(All(target.name), self.request.ids_field or target.primary_key, self._ids()), key))

    def _siblings(self, table: Table, b: BelongsTo) -> list[BelongsTo]:
        return [x for x in table.belongs_tos if x.foreign_type == b.foreign_type]

    def _through_tree(self, table: Table, names: list[str]) -> bool:
        return not table.batch_scope and any(self.schema[n].self_links for n in names if n in self.schema)

    def _nested(self, context: Context, table: Table, **changes) -> Context:
        return replace(context, forward=(*context.forward, table.name), batch=None, ancestors=True, **changes)

    def _parent_plan(self, table: Table, b: BelongsTo, context: Context) -> Plan | None:
        """The parent's own extraction, unless it would lead back here or narrows nothing."""
        if b.table_name not in self.schema or b.table_name == table.name or b.table_name in context.forward or not self.schema[b.table_name].primary_key:
            return None
        found = self.plan(b.table_name, self._nested(context, table, automatic=True, declared=True))
        return found if found.narrowed and table.name not in reads(found.node) else None

    def _arm_of_parent(self, table: Table, b: BelongsTo, context: Context, automatic: bool) -> Node | None:
        found = self._parent_plan(table, b, context)
        if found is None or found.automatic_reverse and not automatic:
            return None
        return self._hop(All(table.name), b, KeysOf(found.node, self._parent_key(b)))

    def _union(self, table: Table, arms: list[Node]) -> Node:
        keys = tuple(KeysOf(a, table.primary_key) for a in arms)
        return In(All(table.name), table.primary_key, AnyOf(keys))

    # A target and its ids

    def _path(self, name: str) -> Path | None:
        key = ("target", name)
        if key not in self._paths:
            direct = self.schema[name].edge(self.request.target)
            self._paths[key] = [(name, direct)] if direct else shortest_path(self.schema, name, lambda t: t.name == self.request.target)
        return self._paths[key]

    def _targeted(self, table: Table, context: Context) -> Plan:
        target = self.request.target
        if table.name == target:
            return Plan(Among(All(target), self.request.ids_field or table.primary_key, self._ids()), "target")
        if table.managed:
            return Plan(All(table.name), "managed")
        path = self._path(table.name)
        notes: list[str] = []
        if path:
            b = path[0][1]
            if b.polymorphic:
                arms = [a for x in self._siblings(table, b) if (a := self._target_arm(table, x, context)) is not None]
                if len(arms) > 1:
                    return Plan(self._own_filter(table, self._union(table, arms)), "arms")
            route = [x.table_name for _, x in path]
            if self._through_tree(table, route) and (found := self._parent_plan(table, b, context)):
                return Plan(self._own_filter(table, self._hop(All(table.name), b, KeysOf(found.node, self._parent_key(b)))), "tree")
            node = self._along(path, None)
            direct = len(path) == 1
            if table.filter and not direct and not self.always:
                notes.append(f"the filter of {table.name} has no effect: it is narrowed over a path")
            return Plan(self._own_filter(table, node) if direct else node, "direct" if direct else "path", tuple(notes))
        ambiguous: list[str] = []
        if (context.automatic or context.declared and table.reverse_scope) and (found := self._reverse(table, context, ambiguous, notes)):
            return replace(found, notes=tuple(notes))
        if table.name not in context.forward:
            node, crowd = self._cascade(table, context)
            if node is not None:
                return Plan(node, "cascade", tuple(notes))
            if crowd and context.automatic and context.top and not table.scope_exempt:
                notes.append(f"{table.name} belongs to several narrowed tables ({', '.join(crowd)}), so it is copied in full")
        if ambiguous and context.top and not table.scope_exempt:
            notes.append(f"{table.name} is referenced by several narrowed tables ({', '.join(ambiguous)}); declare reverse_scope. It is copied in full")
        return Plan(All(table.name), "exempt" if table.scope_exempt else "full", tuple(notes))

    def _target_arm(self, table: Table, b: BelongsTo, context: Context) -> Node | None:
        if b.table_name not in self.schema:
            return None
        on_target = b.table_name == self.request.target
        path = [(table.name, b)] if on_target else None
        if not on_target and (rest := self._path(b.table_name)) and table.name not in [n for n, _ in rest]:
            path = [(table.name, b), *rest]
        if path:
            if self._through_tree(table, [x.table_name for _, x in path]) and (found := self._parent_plan(table, b, context)):
                return self._hop(All(table.name), b, KeysOf(found.node, self._parent_key(b)))
            return self._along(path, None)
        return self._arm_of_parent(table, b, context, automatic=False)

    # Reverse: what narrowed tables point at

    def _reverse(self, table: Table, context: Context, ambiguous: list[str], notes: list[str]) -> Plan | None:
        if table.reverse_scope:
            return self._declared_reverse(table, context, notes)
        if not context.automatic or not table.primary_key:
            return None
        found = []
        for other in self.schema.live:
            b = other.edge(table.name) if other.name != table.name else None
            if b is None or b.polymorphic:
                continue
            plan = self.plan(other.name, self._nested(context, table, automatic=False, declared=False, reverse=(*context.reverse, table.name)))
            if plan.narrowed:
                found.append((other, b, plan))
        if len(found) > 1:
            ambiguous += sorted(o.name for o, _, _ in found)
        if len(found) != 1:
            return None
        _, b, plan = found[0]
        return Plan(In(All(table.name), b.references or table.primary_key, KeysOf(plan.node, b.foreign_key)), "referenced", automatic_reverse=True)

    def _declared_reverse(self, table: Table, context: Context, notes: list[str]) -> Plan | None:
        if table.name in context.reverse:
            return None
        if len(context.reverse) >= DEEP_CHAIN:
            notes.append(f"reverse_scope of {table.name} is nested {len(context.reverse) + 1} deep")
        arms = []
        for arm in table.reverse_scope.via:
            if arm.table not in self.schema:
                notes.append(f"reverse_scope of {table.name} names unknown table {arm.table}; skipped")
                continue
            plan = self.plan(arm.table, self._nested(context, table, automatic=False, declared=True, reverse=(*context.reverse, table.name)))
            if plan.narrowed:
                arms.append(KeysOf(plan.node, arm.column))
            else:
                notes.append(f"reverse_scope of {table.name}: {arm.table}.{arm.column} isn't narrowed; skipped")
        if not arms:
            return None
        return Plan(In(All(table.name), table.reverse_scope.column or table.primary_key, AnyOf(tuple(arms))), "reverse_scope")

    # Cascade: what belongs to narrowed rows

    def _cascade(self, table: Table, context: Context) -> tuple[Node | None, list[str]]:
        nested = self._nested(context, table, automatic=True, declared=True)
        plain = []
        for b in table.belongs_tos:
            if b.polymorphic or b.table_name not in self.schema or b.table_name in nested.forward:
                continue
            found = self.plan(b.table_name, nested)
            if found.narrowed:
                plain.append((b, found))
        if len(plain) == 1:
            b, found = plain[0]
            return self._hop(All(table.name), b, KeysOf(found.node, self._parent_key(b))), []
        if plain:
            return None, [b.table_name for b, _ in plain]
        groups: dict[str, list[Node]] = {}
        for b in table.belongs_tos if table.primary_key else ():
            if b.polymorphic and (arm := self._arm_of_parent(table, b, context, automatic=self.scoped)) is not None:
                groups.setdefault(b.foreign_type, []).append(arm)
        if len(groups) == 1:
            return self._union(table, next(iter(groups.values()))), []
        return None, list(groups)

    # Scope columns

    def direct(self, table: Table) -> bool:
        """Whether a table carries the scope column it is filtered on."""
        return (table.scope_column or self.request.scope_column) in table.column_names

    def _scope_filter(self, table: Table, context: Context) -> Node:
        if context.batch and context.batch[0] == table.name:
            return Among(All(table.name), table.primary_key, context.batch[1], table.id_space or DEFAULT_SPACE)
        space = table.id_space or DEFAULT_SPACE
        return Among(All(table.name), table.scope_column or self.request.scope_column, self._ids(space), space)

    def _scope_path(self, table: Table, first: BelongsTo | None, stop: str | None = None) -> Path | None:
        goal = (lambda t: t.name == stop) if stop else self.direct
        if first is None:
            return shortest_path(self.schema, table.name, goal)
        if first.table_name not in self.schema:
            return None
        if goal(self.schema[first.table_name]):
            return [(table.name, first)]
        without = Schema(tuple(t if t.name != table.name else replace(t, belongs_tos=()) for t in self.schema.tables))
        rest = shortest_path(without, first.table_name, goal)
        return [(table.name, first), *rest] if rest else None

    def _along_scope(self, path: Path, context: Context) -> Node:
        end = self.schema[path[-1][1].table_name]
        if context.batch and context.batch[0] in [n for n, _ in path[1:]]:  # the batch's keys stand for the rest of the path
            at = [n for n, _ in path].index(context.batch[0])
            path, end = path[:at], self.schema[context.batch[0]]
            return self._along(path, self._own_filter(end, Among(All(end.name), end.primary_key, context.batch[1])))
        return self._along(path, self._own_filter(end, self._scope_filter(end, context)))

    def _scope_arm(self, table: Table, b: BelongsTo, path: Path | None, context: Context) -> Node | None:
        if path is None:
            return self._arm_of_parent(table, b, context, automatic=True)
        if self._through_tree(table, [x.table_name for _, x in path]) and (found := self._parent_plan(table, b, context)):
            return self._hop(All(table.name), b, KeysOf(found.node, self._parent_key(b)))
        return self._along_scope(path, context)

    def _scoped(self, table: Table, context: Context) -> Plan:
        if table.scope_exempt or table.managed:
            return Plan(All(table.name), "exempt")
        if self.direct(table):
            return Plan(self._own_filter(table, self._scope_filter(table, context)), "direct")
        path = self._scope_path(table, None)
        notes: list[str] = []
        if path:
            b = path[0][1]
            relations = self._siblings(table, b) if b.polymorphic else [b]
            arms = [a for x in relations if (a := self._scope_arm(table, x, path if x is b else self._scope_path(table, x), context)) is not None]
            if arms:
                node = arms[0] if len(arms) == 1 else self._union(table, arms)
                return Plan(self._own_filter(table, node), "path" if len(arms) == 1 else "arms")
        if (context.automatic or context.declared and table.reverse_scope) and (found := self._reverse(table, context, [], notes)):
            return replace(found, notes=tuple(notes))
        if table.name not in context.forward:
            node, _ = self._cascade(table, context)
            if node is not None:
                return Plan(node, "cascade", tuple(notes))
        return Plan(All(table.name), "unscopable", tuple(notes))

    def category(self, name: str) -> str:
        """How a table is narrowed, in one word."""
        rule = self.plan(name).rule.removesuffix("+ancestors")
        if not self.scoped:
            return rule
        names = {"path": "via_path", "arms": "via_path", "referenced": "referenced_by", "reverse_scope": "referenced_by", "cascade": "via_scoped_parent"}
        return names.get(rule, rule)


# Modes and checks


def scope_mode(schema: Schema, request: Request) -> bool:
    if request.mode:
        return request.mode == "scope_column"
    if request.scope_column:
        return True
    declared = [t for t in schema.live if t.scope_column]
    if request.target is None:
        return bool(request.ids) and (bool(declared) or all(t.scope_exempt or t.managed for t in schema.live))
    return request.target in schema and bool(schema[request.target].scope_column)


def check_request(schema: Schema, request: Request) -> None:
    if request.mode not in (None, "primary_key", "scope_column"):
        raise ConfigError(f"unknown mode {request.mode!r}")
    scoped = scope_mode(schema, request)
    if request.target is not None:
        target = schema[request.target]
        if target.ignore or target.managed or target.embedded_in:
            raise ConfigError(f"{request.target} can't be the target: it is ignored, managed or embedded")
    if request.mode == "primary_key" and (request.target is None or request.scope_column):
        raise ConfigError("mode primary_key needs a target, and no scope column")
    if not request.recursive and (scoped or request.target is None):
        raise ConfigError("without recursion a target is needed, and no scope column")
    if request.ids and request.target is None and not scoped:
        raise ConfigError("ids need a target, or a table with a scope_column")
    if scoped and not any(Resolver(schema, request).direct(t) for t in schema.live) and not all(t.scope_exempt or t.managed for t in schema.live):
        raise ConfigError("no table declares a scope_column")
    if not scoped and set(request.ids) - {DEFAULT_SPACE}:
        raise ConfigError("named ID spaces need scope columns")
    if scoped and any(t.document for t in schema.live):
        raise ConfigError("scope columns aren't supported for documents")
    for t in schema.live:
        if t.batch_scope:
            check_batch(Resolver(schema, request), t)


def check_spaces(resolver: Resolver) -> None:
    """Every ID space that a table needs has values, every one with values is used, and no table mixes several."""
    if not resolver.scoped:
        return
    used: set[str] = set()
    for t in resolver.schema.live:
        own = spaces(resolver.plan(t.name).node)
        if resolver.direct(t):
            own |= {t.id_space or DEFAULT_SPACE}
        if len(own) > 1:
            raise ConfigError(f"{t.name} is narrowed through several ID spaces: {', '.join(sorted(own))}")
        used |= own
    if missing := sorted(s for s in used if not resolver.request.ids.get(s)):
        raise ConfigError(f"no ids for ID space {', '.join(missing)}")
    if used and (extra := sorted(set(resolver.request.ids) - used)):
        raise ConfigError(f"no table uses ID space {', '.join(extra)}")


def check_batch(resolver: Resolver, table: Table) -> None:
    """A batched table is narrowed by one join path, on which the batch table lies, or by itself."""
    batch = table.batch_scope
    if not resolver.scoped:
        raise ConfigError(f"{table.name}: batch_scope needs scope columns")
    if table.scope_exempt or batch.table not in resolver.schema:
        raise ConfigError(f"{table.name}: batch_scope.table {batch.table} isn't a table that narrows it")
    if resolver.direct(table):
        if batch.table != table.name:
            raise ConfigError(f"{table.name}: a table with a scope column can only be batched by itself")
        return
    path = resolver._scope_path(table, None)
    on_path = [b.table_name for _, b in path or ()]
    if batch.table not in on_path or path[0][1].polymorphic:
        raise ConfigError(f"{table.name}: batch_scope.table {batch.table} isn't on its path to the scope")
    if not resolver.schema[batch.table].primary_key:
        raise ConfigError(f"{table.name}: batch_scope.table {batch.table} needs a primary key")
