"""Small helpers for long higher-order expressions written as SQL text.

One ``F.expr`` of SQL text is parsed in the JVM at once; the same tree built operator by operator
from Python would take thousands of round trips.
"""

from __future__ import annotations


def literal(value: str) -> str:
    """Regex or text as a raw SQL literal."""
    return "r'" + value.replace("'", r"\x27") + "'"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in fields.items()) + ")"


def changed(base: str, kinds: dict[str, str], **new: str) -> str:
    """Struct ``base`` with some fields replaced; the new values must have the right type as they are."""
    return struct({n: new.get(n, f"{base}.{n}") for n in kinds})


def empty(kind: str) -> str:
    return f"CAST(array() AS {kind})"


def array_of(kinds: dict[str, str]) -> str:
    return "array<struct<" + ",".join(f"{n}:{k}" for n, k in kinds.items()) + ">>"


def empty_state(kinds: dict[str, str], **values: str) -> str:
    zero = {"int": "0", "string": "''", "boolean": "false"}
    return struct({n: values.get(n) or zero.get(k) or empty(k) for n, k in kinds.items()})
