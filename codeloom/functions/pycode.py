"""Structure of Python source as a JVM-side fold over the lines of each file.

A file is one row, so everything here is a narrow expression: no shuffle, no Python worker.
Strings are blanked first (turned into bracket groups, so that the inside of a multi-line string
reads as a continuation) and comments emptied; line numbers and columns do not move. One pass
over the lines then assembles logical lines by bracket balance and keeps a stack of open headers
ordered by indent. Work is linear in the lines of a file times the nesting in it.

The expressions are SQL text over column or variable names.
"""

from __future__ import annotations

from collections.abc import Sequence

from codeloom.functions.sqltext import array_of, changed, empty, empty_state, let, literal, struct

# One token per match: triple-quoted and plain strings, comments, runs of other text.
_TOKENS = (
    r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""'
    r"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''"
    r'|"(?:[^"\\\n]++|\\[\s\S])*+"'
    r"|'(?:[^'\\\n]++|\\[\s\S])*+'"
    r"|#[^\n]*+"
    r"""|[^"'#]++"""
    r"|[\s\S]"
)
_HEADER = (
    r"^(?:async\s+)?(def|class|if|for|while|try|with|finally|elif|else|except)\b(?!\s*[=.,)])"
)
_NAME = r"(?U)^(?:async\s+)?(?:def|class)\s+(\w+)"
_IMPORT = r"(?U)(?:^|[;:])\s*(from\s+\.*\s*[\w.]*\s+import\b|import\s+[^;#]+)"
_BRACKET = r"[()\[\]{}]"
# A parenthesised list without further brackets, which needs no fold.
_FLAT_LIST = r"^[^()\[\]{}]*\(([^()\[\]{}]*)\)"
_LIST_PIECES = r"[(\[{]|[)\]}]|,|[^()\[\]{},]+"
# The parameters of a lambda, whose commas separate nothing outside it.
_LAMBDA = r"\blambda\b(?:[^:()\[\]{}]|\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\})*:"
# A line that starts a definition: it ends a statement whose bracket was left open.
_DEFINITION = r"(?U)^(?:(?:async\s+)?def\s+\w+\s*[(\[]|class\s+\w+\s*[(:\[]|@\w)"
# A plain, annotated or untyped-default parameter; the name is the group.
_PARAMETER = r"(?U)^(\w+)(?:\s*=.*|\s*:[^=]*)?$"

# What a block header adds to the nesting depth. A clause sits inside the
# statement it belongs to, so its body is two levels deep.
ONE_LEVEL = "('if', 'for', 'while', 'try', 'with', 'finally')"
TWO_LEVELS = "('elif', 'else', 'except')"

# What kind of header a line is.
BLOCK, DEF, CLASS = 0, 1, 2

# An open header holds numbers only: stack entries are copied whenever a nesting depth changes.
_OPEN = {
    "kind": "int",
    "ln": "int",
    "ind": "int",
    "depth": "int",  # nesting weight down to and including this header
    "deepest": "int",  # largest depth met inside
    "in_class": "boolean",
}
# What is known of a function or class when its header is complete, in source order; numbers only.
_FOUND = (
    "line",
    "kind",
    "method",  # 1 below a class
    "owner",  # line of the class that has it as a direct, undecorated function
    "deco_from",
    "deco_to",
    "header_to",
)
# What is known when it ends.
_CLOSED = ("line", "end_line", "nesting")
# The logical line that is being read.
_READING = {
    "start": "int",  # first line, 0 between logical lines
    "ind": "int",
    "keyword": "string",
    "balance": "int",
}
# What each kind of fact needs besides. Results so far are kept as text, numbers with commas in groups
# with semicolons: the state is copied at every line, and a string is copied in one go while a list is
# copied item by item.
_NEEDS = {
    "defs": {
        "text": "string",
        "last": "int",  # last line that holds code
        "read": "int",  # last line of the logical line that holds code
        "notes": "array<struct<ln:int,ind:int>>",  # last comment line since then for each least indent
        "deco_from": "int",  # decorator directly above, 0 if a comment lies in between
        "deco_to": "int",
        "stack": array_of(_OPEN),
        "found": "string",
        "closed": "string",
    },
    "imports": {"text": "string", "imports": "string"},  # separated by newlines
    "counts": {"functions": "int", "classes": "int"},
}
NO_STRINGS = empty("array<string>")


def mask_python(code: str) -> str:
    """Code with strings and comments emptied; line breaks and indents are unchanged."""
    # tokens by their first character: 35 is the hash, 34 and 39 are the quotes
    emptied = r"""CASE
        WHEN ascii(t) = 35 THEN '#'
        WHEN ascii(t) IN (34, 39) AND char_length(t) > 1 THEN concat('(', regexp_replace(t, r'[^\n]+', ''), ')')
        ELSE t END"""
    return f"array_join(transform(regexp_extract_all({code}, {literal(_TOKENS)}, 0), t -> {emptied}), '')"


def _without(text: str, chars: str) -> str:
    for c in chars:
        text = f"replace({text}, '{c}', '')"
    return f"octet_length({text})"


def line_facts(masked: str) -> str:
    """Per line: number, indent (a tab is eight columns), code without comment, bracket balance."""
    split = struct(
        {
            "lead": r"substring(x, 1, char_length(x) - char_length(trim(LEADING ' \t\u000C' FROM x)))",
            "body": r"btrim(substring_index(x, '#', 1), ' \t\u000C')",
            "note": "contains(x, '#')",
        }
    )
    facts = struct(
        {
            "ln": "i + 1",
            "ind": r"char_length(IF(ltrim(q.lead) = '', q.lead,"
            r" replace(replace(q.lead, '\u000C', ''), '\t', '        ')))",
            "body": "q.body",
            "delta": f"IF(rlike(q.body, {literal(_BRACKET)}),"
            f" {_without('q.body', ')]}')} - {_without('q.body', '([{')}, 0)",
            "joined": r"endswith(q.body, r'\')",
            "note": "q.note AND q.body = ''",
            "keyword": f"regexp_extract(q.body, {literal(_HEADER)}, 1)",
        }
    )
    return rf"transform(transform(split({masked}, r'\n'), x -> {split}), (q, i) -> {facts})"


def _close(state: str, leaving: str) -> str:
    """Definitions among the headers that end before the current line.

    A trailing comment belongs to a block while every comment since the last code line is
    indented deeper than the header.
    """
    inside = f"try_element_at(filter({state}.notes, n -> n.ind > h.ind), -1).ln"
    row = f"concat_ws(',', h.ln, coalesce({inside}, {state}.last), h.deepest - h.depth)"
    ended = f"transform(filter({leaving}, h -> h.kind != {BLOCK}), h -> concat({row}, ';'))"
    return f"concat({state}.closed, array_join({ended}, ''))"


def _unjoined(text: str) -> str:
    return rf"trim(TRAILING r'\' FROM {text})"


def _imports_in(text: str) -> str:
    module = r"regexp_replace(regexp_extract(m, r'^from\s+(.*?)\s+import$', 1), r'\s', '')"
    plain = (
        r"filter(transform(split(regexp_replace(m, r'^import\s+', ''), ','), v -> btrim(v, ' \t')),"
        r" v -> rlike(v, r'(?U)^[\w.]+$'))"
    )
    names = f"""CASE
        WHEN NOT startswith(m, 'from') THEN {plain}
        WHEN {module} = '__future__' THEN {NO_STRINGS}
        ELSE array(concat('from ', {module})) END"""
    found = f"flatten(transform(regexp_extract_all({text}, {literal(_IMPORT)}, 1), m -> {names}))"
    return rf"array_join(transform({found}, v -> concat(v, '\n')), '')"


def _state(facts: Sequence[str]) -> dict[str, str]:
    return _READING | {name: kind for fact in facts for name, kind in _NEEDS[fact].items()}


def _step(facts: Sequence[str]) -> str:
    """State ``s`` after the line ``l``, with what the facts asked for need.

    Written without inner bindings: a higher-order function copies what its lambda returns, and
    the state holds all that was found so far. Only a line that starts a definition no deeper than
    the statement that is being read takes two steps: an open bracket is given up there, as it
    would swallow the rest of the file.
    """
    kinds = _state(facts)
    going = "s.start > 0"
    start, ind = f"IF({going}, s.start, l.ln)", f"IF({going}, s.ind, l.ind)"
    # inside brackets only the first line matters; the header of a function is read off its lines
    text = f"CASE WHEN NOT {going} THEN l.body WHEN s.balance > 0 THEN s.text ELSE concat(s.text, ' ', l.body) END"
    keyword = f"IF({going}, s.keyword, l.keyword)"
    balance = "greatest(s.balance + l.delta, 0)"

    same = f"coalesce(try_element_at(s.stack, -1).ind < {ind}, true)"
    stack = f"IF({same}, s.stack, filter(s.stack, h -> h.ind < {ind}))"
    top = f"try_element_at({stack}, -1)"
    weight = rf"""CASE
        WHEN {keyword} IN {ONE_LEVEL} THEN 1
        WHEN {keyword} = 'except' AND rlike({text}, r'^except\s*\*') THEN 1
        WHEN {keyword} IN {TWO_LEVELS} THEN 2
        ELSE 0 END"""
    depth = f"coalesce({top}.depth, 0) + {weight}"
    in_class = f"coalesce({top}.in_class, false)"
    kind = f"CASE {keyword} WHEN 'def' THEN {DEF} WHEN 'class' THEN {CLASS} ELSE {BLOCK} END"
    new = struct(
        {
            "kind": kind,
            "ln": start,
            "ind": ind,
            "depth": "m",
            "deepest": "m",
            "in_class": f"{in_class} OR {keyword} = 'class'",
        }
    )
    direct = f"{keyword} = 'def' AND s.deco_to = 0 AND coalesce({top}.kind = {CLASS}, false)"
    found = (
        f"concat_ws(',', {start}, {kind}, IF({in_class}, 1, 0), IF({direct}, {top}.ln, 0),"
        " s.deco_from, s.deco_to, l.ln)"
    )
    named = f"{keyword} IN ('def', 'class')"
    deeper = f"transform({stack}, h -> {changed('h', _OPEN, deepest='greatest(h.deepest, m)')})"
    grown = f"concat(IF({named}, {stack}, {deeper}), array({new}))"
    pushed = let(depth, "m", grown)
    deco = f"startswith({text}, '@')"
    at_end = {
        "defs": {
            "last": "l.ln",
            "notes": empty(_NEEDS["defs"]["notes"]),
            "deco_from": f"IF({deco}, {start}, 0)",
            "deco_to": f"IF({deco}, l.ln, 0)",
            "stack": f"IF({keyword} = '', {stack}, {pushed})",
            "found": f"IF({named}, concat(s.found, {found}, ';'), s.found)",
            "closed": f"IF({same}, s.closed, {_close('s', f'filter(s.stack, h -> h.ind >= {ind})')})",
        },
        "imports": {
            "imports": f"IF(contains({text}, 'import'), concat(s.imports, {_imports_in(text)}), s.imports)"
        },
        "counts": {
            "functions": f"s.functions + IF({keyword} = 'def', 1, 0)",
            "classes": f"s.classes + IF({keyword} = 'class', 1, 0)",
        },
    }
    added = {name: value for fact in facts for name, value in at_end[fact].items()}
    complete = changed("s", kinds, start="0", text="''", keyword="''", balance="0", **added)
    partial = changed(
        "s",
        kinds,
        start=start,
        ind=ind,
        text=_unjoined(text),
        keyword=keyword,
        balance=balance,
        read="IF(l.body = '', s.read, l.ln)",
    )
    least = "least(coalesce(try_element_at(s.notes, -1).ind, l.ind), l.ind)"
    earlier = f"filter(s.notes, n -> n.ind > {least})"
    note = changed(
        "s", kinds, notes=f"concat({earlier}, array(named_struct('ln', l.ln, 'ind', {least})))", deco_from="0"
    )
    noted = f"WHEN s.start = 0 AND l.note THEN {note}" if "defs" in facts else ""
    usual = f"""CASE
        {noted}
        WHEN s.start = 0 AND l.body = '' THEN s
        WHEN s.balance + l.delta > 0 OR l.joined THEN {partial}
        ELSE {complete} END"""
    given_up = complete
    for field, nothing in {"l.ln": "s.read", "l.body": "''", "l.delta": "0"}.items():
        given_up = given_up.replace(field, nothing)
    open_bracket = f"s.start > 0 AND s.balance > 0 AND l.ind <= s.ind AND rlike(l.body, {literal(_DEFINITION)})"
    return f"CASE WHEN {open_bracket} THEN {let(given_up, 's', usual)} ELSE {usual} END"


def _folded(facts: Sequence[str], finish: str) -> str:
    return f"aggregate(ls, {empty_state(_state(facts))}, (s, l) -> {_step(facts)}, s -> {finish})"


def count_python(code: str) -> str:
    """Struct of the numbers of ``functions`` and ``classes``: the state is six plain values."""
    counted = _folded(["counts"], struct({"functions": "s.functions", "classes": "s.classes"}))
    return let(line_facts(mask_python(code)), "ls", counted)


def fold_python(code: str, facts: Sequence[str] = ("defs", "imports")) -> str:
    """Struct of ``defs`` (functions and classes, by line) and ``imports`` (in source order), as asked for."""
    ends = {"found": "s.found", "closed": _close("s", "s.stack")} if "defs" in facts else {}
    ends |= {"imports": "s.imports"} if "imports" in facts else {}
    folded = _folded(facts, struct(ends))

    def rows(text: str, names: tuple[str, ...]) -> str:
        row = struct({n: f"CAST(x[{i}] AS INT)" for i, n in enumerate(names)})
        return f"transform(filter(split({text}, ';'), x -> x != ''), y -> {let(split_row, 'x', row)})"

    split_row = "split(y, ',')"
    joined = f"array_join(transform(sequence(f.line, f.header_to), n -> {_unjoined('ls[n - 1].body')}), ' ')"
    header = f"IF(f.line = f.header_to, ls[f.line - 1].body, {joined})"
    both = struct(
        {
            "line": "f.line",
            "end_line": "e.end_line",
            "kind": "f.kind",
            "nesting": "e.nesting",
            "method": "f.method = 1",
            "owner": "f.owner",
            "deco_from": "f.deco_from",
            "deco_to": "f.deco_to",
            "header": header,
        }
    )
    # headers are found in the order of their lines, so the two lists pair up
    defs = f"zip_with({rows('r.found', _FOUND)}, sort_array({rows('r.closed', _CLOSED)}), (f, e) -> {both})"
    imports = r"filter(split(r.imports, r'\n'), v -> v != '')"
    made = {"defs": defs, "imports": imports}
    result = let(folded, "r", struct({fact: made[fact] for fact in facts}))
    return let(line_facts(mask_python(code)), "ls", result)


def _name(header: str) -> str:
    return f"regexp_extract({header}, {literal(_NAME)}, 1)"


def top_level_parts(header: str) -> str:
    """Comma-separated parts of the first parenthesised list; bracketed text inside is left out."""
    kinds = {
        "depth": "int",
        "phase": "int",  # 0 before the list, 1 in it, 2 after it
        "part": "string",
        "parts": "array<string>",
    }
    opens, closes = "t IN ('(', '[', '{')", "t IN (')', ']', '}')"
    inside = "a.phase = 1 AND a.depth = 1"
    ends = f"{inside} AND ({closes} OR t = ',')"
    step = changed(
        "a",
        kinds,
        depth=f"a.depth + CASE WHEN {opens} THEN 1 WHEN {closes} THEN -1 ELSE 0 END",
        phase=f"""CASE
            WHEN a.phase = 0 AND a.depth = 0 AND t = '(' THEN 1
            WHEN {inside} AND {closes} THEN 2
            ELSE a.phase END""",
        part=f"CASE WHEN {ends} THEN '' WHEN {inside} AND NOT {opens} THEN concat(a.part, t) ELSE a.part END",
        parts=f"IF({ends}, concat(a.parts, array(a.part)), a.parts)",
    )
    header = f"regexp_replace({header}, {literal(_LAMBDA)}, 'lambda:')"
    pieces = f"regexp_extract_all({header}, {literal(_LIST_PIECES)}, 0)"
    folded = f"aggregate({pieces}, {empty_state(kinds)}, (a, t) -> {step}, a -> a.parts)"
    flat = f"split(regexp_extract({header}, {literal(_FLAT_LIST)}, 1), ',')"
    parts = f"IF(rlike({header}, {literal(_FLAT_LIST)}), {flat}, {folded})"
    return rf"transform({parts}, v -> btrim(v, ' \t\n'))"


def python_functions(code: str, defs: str) -> str:
    """Function facts in source order.

    Annotated defaults, starred parameters and bare markers are no parameters here; a decorator
    is the one directly above, as written.
    """
    names = f"transform({top_level_parts('d.header')}, v -> regexp_extract(v, {literal(_PARAMETER)}, 1))"
    above = rf"array_join(slice(c.raw, d.deco_from, d.deco_to - d.deco_from + 1), '\n')"
    row = struct(
        {
            "name": _name("d.header"),
            "line": "d.line",
            "end_line": "d.end_line",
            "params": f"filter({names}, v -> v != '')",
            "length": "d.end_line - d.line + 1",
            "nesting_depth": "d.nesting",
            "is_method": "d.method",
            "decorators": rf"IF(d.deco_from > 0, array(regexp_replace({above}, r'\A[ \t\f]+|\s+\z', '')), {NO_STRINGS})",
        }
    )
    rows = f"transform(filter({defs}, d -> d.kind = {DEF}), d -> {row})"
    return let(rf"named_struct('raw', split({code}, r'\n'))", "c", rows)


def python_classes(defs: str) -> str:
    """Class facts in source order; methods are the direct, undecorated functions."""
    own = f"transform(filter(o, m -> m.owner = d.line), m -> {_name('m.header')})"
    named = struct({"name": _name("d.header"), "line": "d.line", "methods": own})
    row = struct({**{n: f"x.{n}" for n in ("name", "line", "methods")}, "num_methods": "size(x.methods)"})
    rows = f"transform(transform(filter({defs}, d -> d.kind = {CLASS}), d -> {named}), x -> {row})"
    return let(f"filter({defs}, m -> m.owner > 0)", "o", rows)
