"""Plan nodes. A node stands for rows of one table; keys stand for values taken from rows."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class All:
    """Every row of a table."""

    table: str


@dataclass(frozen=True)
class Among:
    """Rows whose column has one of the given values."""

    source: Node
    column: str
    values: tuple
    space: str | None = None

    @property
    def table(self) -> str:
        return self.source.table


@dataclass(frozen=True)
class Matching:
    """Rows that satisfy an SQL condition on the table's own name."""

    source: Node
    condition: str

    @property
    def table(self) -> str:
        return self.source.table


@dataclass(frozen=True)
class Typed:
    """Rows whose type column names one kind of parent."""

    source: Node
    column: str
    value: str

    @property
    def table(self) -> str:
        return self.source.table


@dataclass(frozen=True)
class In:
    """Rows whose column is among keys; a null never is, unless `or_null`."""

    source: Node
    column: str
    keys: Keys
    or_null: bool = False

    @property
    def table(self) -> str:
        return self.source.table


@dataclass(frozen=True)
class WithAncestors:
    """Rows and all that can be reached from them over the table's links to itself: (own column, referenced column)."""

    source: Node
    primary_key: str
    links: tuple[tuple[str, str], ...]

    @property
    def table(self) -> str:
        return self.source.table


@dataclass(frozen=True)
class Nothing:
    """No rows."""

    table: str


Node = All | Among | Matching | Typed | In | WithAncestors | Nothing


@dataclass(frozen=True)
class KeysOf:
    """A column's values in rows, never masked."""

    source: Node
    column: str


@dataclass(frozen=True)
class AnyOf:
    """The distinct values of several keys together."""

    keys: tuple[Keys, ...]


Keys = KeysOf | AnyOf


def reads(node: Node | Keys) -> frozenset[str]:
    """The tables that have to be read."""
    match node:
        case All(table) | Nothing(table):
            return frozenset({table})
        case KeysOf(source, _):
            return reads(source)
        case AnyOf(keys):
            return frozenset().union(*map(reads, keys))
        case In(source, _, keys, _):
            return reads(source) | reads(keys)
        case _:
            return reads(node.source)


def spaces(node: Node | Keys) -> frozenset[str]:
    """The ID spaces whose values narrow the rows."""
    match node:
        case All() | Nothing():
            return frozenset()
        case Among(source, _, _, space):
            return spaces(source) | (frozenset({space}) if space else frozenset())
        case AnyOf(keys):
            return frozenset().union(*map(spaces, keys))
        case In(source, _, keys, _):
            return spaces(source) | spaces(keys)
        case _:
            return spaces(node.source)


def constrained(node: Node) -> bool:
    return not isinstance(node, All)


def describe(node: Node | Keys, depth: int = 0) -> str:
    """An indented outline of a plan."""
    pad = "  " * depth
    match node:
        case All(table):
            return f"{pad}all {table}"
        case Nothing(table):
            return f"{pad}nothing of {table}"
        case Among(source, column, values, space):
            shown = ", ".join(map(str, values[:5])) + (f", ... {len(values)} values" if len(values) > 5 else "")
            return f"{pad}{column} in ({shown})" + (f" [{space}]" if space else "") + "\n" + describe(source, depth + 1)
        case Matching(source, condition):
            return f"{pad}where {condition}\n" + describe(source, depth + 1)
        case Typed(source, column, value):
            return f"{pad}{column} = {value!r}\n" + describe(source, depth + 1)
        case In(source, column, keys, or_null):
            return f"{pad}{column} in keys{' or null' if or_null else ''}\n" + describe(keys, depth + 2) + "\n" + describe(source, depth + 1)
        case WithAncestors(source, pk, links):
            return f"{pad}and ancestors by {', '.join(f'{a} -> {b}' for a, b in links)}\n" + describe(source, depth + 1)
        case KeysOf(source, column):
            return f"{pad}{node.source.table}.{column} of\n" + describe(source, depth + 1)
        case AnyOf(keys):
            return f"{pad}any of\n" + "\n".join(describe(k, depth + 1) for k in keys)
    raise TypeError(type(node))
