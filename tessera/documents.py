"""The document flavour of narrowing: parents' kept keys, one strict anchor, and null-aware others."""

from __future__ import annotations

from .config import ConfigError, Schema, Table
from .graph import genuine
from .operators.lower import Lowering, typed_values
from .plans.nodes import All, Among, AnyOf, In, KeysOf, Nothing
from .plans.resolver import Plan, Request


class DocumentResolver:
    """Plans for document collections.

    A collection that reaches the target is narrowed by all its parents that do: strictly by the one with the fewest kept keys
    (the first on ties), and by the others where the field isn't null. One that reaches only reference collections is narrowed
    strictly by all of them that have kept keys; one without relations is copied. Where relations lead to no kept keys, nothing
    is kept. Ancestors of trees aren't added.

    measure: whether kept keys are counted, by a job for each parent, to tell the fewest; without, as to explain plans, every
    parent counts as having one.
    """

    def __init__(self, schema: Schema, request: Request, lowering: Lowering, measure: bool = True):
        if request.target is None or request.target not in schema:
            raise ConfigError("documents need a target")
        if schema[request.target].embedded_in:
            raise ConfigError(f"{request.target} is embedded and can't be the target")
        self.schema, self.request, self.lowering = schema, request, lowering
        self.genuine = genuine(schema, request.target)
        self.measure = measure
        self._known: dict[str, Plan] = {}
        self._sizes: dict[KeysOf, int] = {}
        self._building: list[str] = []
        self.scoped = False

    def plans(self) -> dict[str, Plan]:
        names = [t.name for t in self.schema.live if not t.embedded_in]
        names = names if self.request.recursive else [self.request.target]
        return {n: self.plan(n) for n in names}

    def category(self, name: str) -> str:
        return self.plan(name).rule

    def plan(self, name: str) -> Plan:
        if name not in self._known:
            self._building.append(name)
            self._known[name] = self._plan(self.schema[name])
            self._building.pop()
        return self._known[name]

    def _size(self, keys: KeysOf) -> int:
        if not self.measure:
            return 1
        if keys not in self._sizes:
            self._sizes[keys] = self.lowering.keys(keys).distinct().count()
        return self._sizes[keys]

    def _parents(self, table: Table) -> list:
        return [b for b in table.belongs_tos if b.table_name in self.schema and b.table_name not in self._building and not b.polymorphic and not self.schema[b.table_name].embedded_in]

    def _keys(self, b) -> KeysOf:
        parent = self.schema[b.table_name]
        return KeysOf(self.plan(parent.name).node, b.references or parent.primary_key)

    def _plan(self, table: Table) -> Plan:
        request = self.request
        if table.name == request.target:
            column = request.ids_field or table.primary_key
            return Plan(Among(All(table.name), column, tuple(self.coerced(table.name, column))), "target")
        notes = ["ancestors of its rows aren't added for documents"] if table.self_links else []
        parents = self._parents(table)
        if table.name in self.genuine:
            if table.reverse_scope:
                notes.append(f"reverse_scope of {table.name} has no effect: it reaches the target")
            own = [b for b in parents if b.table_name in self.genuine]
            sized = [(self._size(self._keys(b)), i, b) for i, b in enumerate(own)]
            if not sized or not any(n for n, _, _ in sized):
                return Plan(Nothing(table.name), "nothing", tuple(notes))
            anchor = min(x for x in sized if x[0])[2]
            node = In(All(table.name), anchor.foreign_key, self._keys(anchor))
            for n, _, b in sized:
                if b is not anchor and n:
                    node = In(node, b.foreign_key, self._keys(b), or_null=True)
            return Plan(node, "genuine", tuple(notes))
        if table.reverse_scope:
            arms = []
            for arm in table.reverse_scope.via:
                if arm.table in self.schema and arm.table not in self._building and not self.schema[arm.table].embedded_in and self.plan(arm.table).narrowed:
                    arms.append(KeysOf(self.plan(arm.table).node, arm.column))
                else:
                    notes.append(f"reverse_scope of {table.name}: {arm.table} isn't narrowed; skipped")
            if arms:
                return Plan(In(All(table.name), table.reverse_scope.column or table.primary_key, AnyOf(tuple(arms))), "reverse_scope", tuple(notes))
        if not table.belongs_tos:
            return Plan(All(table.name), "leaf", tuple(notes))
        kept = [b for b in parents if self._size(self._keys(b))]
        if not kept:
            return Plan(Nothing(table.name), "nothing", (*notes, f"{table.name} has relations, but no parent with kept keys"))
        node = All(table.name)
        for b in kept:
            node = In(node, b.foreign_key, self._keys(b))
        return Plan(node, "reference", tuple(notes))

    def coerced(self, name: str, column: str) -> list:
        """Ids as the column's type, in which object ids are texts; one that can't be of that type is an error."""
        kind = self.lowering.table(name).schema[column].dataType
        return typed_values([v for ids in self.request.ids.values() for v in ids], kind, column)
