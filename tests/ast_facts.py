"""The facts of Python source by the standard library's parser, as a yardstick."""

from __future__ import annotations

import ast

BLOCKS = (ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.TryStar, ast.If)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def depth(statements: list[ast.stmt], at: int, lines: list[str]) -> int:
    """Deepest nesting below ``at``; a clause counts on top of its statement."""
    deepest = at
    for s in statements:
        parts: list[tuple[list, int]] = []
        if isinstance(s, ast.If):
            deepest = max(deepest, at + 1)
            parts.append((s.body, at + 1))
            rest = s.orelse
            while len(rest) == 1 and isinstance(rest[0], ast.If) and is_elif(rest[0], lines):
                parts.append((rest[0].body, at + 2))
                rest = rest[0].orelse
            if rest:
                parts.append((rest, at + 2))
        elif isinstance(s, (ast.Try, ast.TryStar)):
            clause = 1 if isinstance(s, ast.TryStar) else 2
            parts += [(s.body, at + 1), (s.finalbody, at + 1)]
            parts += [(h.body, at + clause) for h in s.handlers]
            parts += [(s.orelse, at + 2)] if s.orelse else []
        elif isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
            parts += [(s.body, at + 1)] + ([(s.orelse, at + 2)] if s.orelse else [])
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            parts.append((s.body, at + 1))
        elif isinstance(s, ast.Match):
            parts += [(c.body, at) for c in s.cases]
        elif isinstance(s, (*FUNCTIONS, ast.ClassDef)):
            parts.append((s.body, at))
        for body, level in parts:
            deepest = max(deepest, depth(body, level, lines)) if body else deepest
    return deepest


def is_elif(node: ast.If, lines: list[str]) -> bool:
    return lines[node.lineno - 1].encode()[node.col_offset :].startswith(b"elif")


def params(a: ast.arguments) -> list[str]:
    found = []
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    for arg, default in [*zip(plain, defaults), *zip(a.kwonlyargs, a.kw_defaults)]:
        if default is None or arg.annotation is None:
            found.append(arg.arg)
    return found


def facts(code: str) -> tuple[list[tuple], list[tuple], list[str]]:
    """Functions (name, line, end, params, nesting, method, decorated), classes, imports."""
    lines = code.split("\n")
    functions, classes, imports = [], [], []

    def walk(node: ast.AST, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, FUNCTIONS):
                functions.append(
                    (
                        child.name, child.lineno, child.end_lineno, params(child.args),
                        depth(child.body, 0, lines), in_class, bool(child.decorator_list),
                    )
                )
            elif isinstance(child, ast.ClassDef):
                methods = [m.name for m in child.body if isinstance(m, FUNCTIONS) and not m.decorator_list]
                classes.append((child.name, child.lineno, methods))
            elif isinstance(child, ast.Import):
                imports.extend((child.lineno, a.name) for a in child.names if a.asname is None)
            elif isinstance(child, ast.ImportFrom) and child.module != "__future__":
                imports.append((child.lineno, "from " + "." * child.level + (child.module or "")))
            walk(child, in_class or isinstance(child, ast.ClassDef))

    walk(ast.parse(code), False)
    return sorted(functions, key=lambda f: f[1]), sorted(classes, key=lambda c: c[1]), [n for _, n in sorted(imports, key=lambda i: i[0])]
