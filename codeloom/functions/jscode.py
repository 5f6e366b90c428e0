"""Structure of JavaScript source as a JVM-side fold over its significant tokens.

Best effort by design: strings, comments and the usual regular-expression literals are blanked by
pattern, then one pass follows braces, parentheses and statement keywords. As for Python, a file
is one row and nothing is shuffled. The expressions are SQL text.
"""

from __future__ import annotations

from collections.abc import Sequence

from codeloom.functions.pycode import NO_STRINGS, top_level_parts
from codeloom.functions.sqltext import array_of, changed, empty_state, let, literal, struct

# Text after which a slash starts a regular expression: an operator, an opening bracket, a line start, some
# keywords, or the header of a statement (parentheses up to four deep, without quotes or slashes inside).
_NESTED = r"[^()\"'`/]*+"
for _ in range(3):
    _NESTED = rf"(?:[^()\"'`/]++|\({_NESTED}\))*+"
_BEFORE = (
    r"(?:=>|[=(,:;!&|?\[{}\n]"
    r"|(?<![\w$.])(?:return|typeof|case|throw|void|delete|else|do|in|of)(?![\w$])"
    rf"|(?<![\w$.])(?:if|while|for|with)\s*+\({_NESTED}\))"
)
# A regular expression with the text before it as one token, whatever blanks and comments lie between.
_REGEX = (
    rf"{_BEFORE}(?:[ \t\r]++|/\*[\s\S]*?\*/)*+"
    r"/(?![*/])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+"
)
_TOKENS = (
    r"`(?:[^`\\]++|\\[\s\S])*+`"
    r'|"(?:[^"\\\n]++|\\[\s\S])*+"'
    r"|'(?:[^'\\\n]++|\\[\s\S])*+'"
    r"|//[^\n]*+"
    r"|/\*[\s\S]*?\*/"
    rf"|{_REGEX}"
    rf"""|(?:(?!{_REGEX})[^"'`/])++"""
    r"|[\s\S]"
)
_QUOTED = r"""^(?:"[\s\S]*"|'[\s\S]*'|`[\s\S]*`)$"""
_KEYWORDS = "if|for|while|try|with|else|do|catch|finally"
_KEYWORD = rf"(?<![\w$.])(?:{_KEYWORDS})(?![\w$])(?!\s*+:)"
# A declaration starts a statement; after other text ``function`` is an expression. Runs of blanks
# are one blank here, so that looking back is bounded whatever the indent.
_DECLARATION = (
    r"(?<![\w$.])function(?=[ \t]+[\w$])"
    r"(?<=(?:^|[;{})\n]|(?<![\w$.])(?:else|do))[ \t]?(?:export[ \t](?:default[ \t])?)?(?:async[ \t])?function)"
    r"[ \t]+[\w$]+"
)
# Any other ``function`` is a token of its own, so that no expression looks like a declaration.
_EXPRESSION = r"(?<![\w$.])function(?![\w$])"
_PIECES = rf"\n|[(){{}};]|{_DECLARATION}|{_EXPRESSION}|{_KEYWORD}|(?:(?!{_KEYWORD}|{_EXPRESSION})[^\n(){{}};])++"
# Text between the name of a declaration and its body.
_LISTED = "IF(s.name = '', '', concat(s.params, t))"

_OPEN = {
    "kind": "string",  # function, do or brace
    "name": "string",
    "line": "int",
    "depth": "int",
    "deepest": "int",
    "paren": "int",
    "pending": "int",
    "params": "string",
}
_CLOSED = {"line": "int", "end_line": "int", "nesting": "int", "name": "string", "params": "string"}
# Control characters between the fields and after each declaration in the collected text.
_FIELD, _RECORD = r"'\u0001'", r"'\u0002'"
_STATE = {
    "line": "int",
    "paren": "int",  # open parentheses since the innermost brace
    "depth": "int",  # nesting weight of all open braces
    "pending": "int",  # weight of statement headers whose body has not come yet
    "before": "int",  # weight of the statement that just ended, for else, catch and finally
    "body": "boolean",  # the braceless body of the pending header has begun
    "counted": "int",  # parenthesis level at which a ';' makes the pending 'for' a counted one
    "doing": "boolean",
    "done": "boolean",  # a do-block just ended, so its 'while' adds nothing
    "name": "string",  # declaration whose body has not come yet
    "since": "int",
    "level": "int",
    "params": "string",
    "stack": array_of(_OPEN),
    "closed": "string",  # as text, for the state is copied at every token
}


def mask_javascript(code: str) -> str:
    """Code with strings, comments and regular expressions blanked; line breaks stay."""
    before = f"regexp_extract(t, {literal('^' + _BEFORE)}, 0)"
    kept = r"concat(p, regexp_replace(substring(t, char_length(p) + 1, char_length(t) - char_length(p) - 1), r'[^\n]', ' '), '_')"
    blanked = rf"""CASE
        WHEN rlike(t, r'^/[/*]') THEN regexp_replace(t, r'[^\n]', ' ')
        WHEN rlike(t, {literal(_QUOTED)}) THEN concat(
            '_', regexp_replace(substring(t, 2, char_length(t)), r'[^\n]', ' '))
        WHEN char_length(t) > 1 AND contains(t, '/') THEN {let(before, 'p', kept)}
        ELSE t END"""
    return f"array_join(transform(regexp_extract_all({code}, {literal(_TOKENS)}, 0), t -> {blanked}), '')"


def _deepen(depth: str) -> str:
    return f"transform(s.stack, h -> {changed('h', _OPEN, deepest=f'greatest(h.deepest, {depth})')})"


def _push() -> str:
    """An opening brace: a function body, a block, or an object."""
    body = "s.name != '' AND size(s.stack) = s.level AND s.paren = 0"
    new = struct(
        {
            "kind": f"CASE WHEN {body} THEN 'function' WHEN s.doing THEN 'do' ELSE 'brace' END",
            "name": f"IF({body}, s.name, '')",
            "line": f"IF({body}, s.since, s.line)",
            "depth": "s.depth + s.pending",
            "deepest": "s.depth + s.pending",
            "paren": "s.paren",
            "pending": "s.pending",
            "params": f"IF({body}, s.params, '')",
        }
    )
    return changed(
        "s",
        _STATE,
        stack=f"concat(s.stack, array({new}))",
        depth="s.depth + s.pending",
        paren="0",
        pending="0",
        body="false",
        doing="false",
        counted="0",
        name=f"IF({body}, '', s.name)",
        params=f"IF({body}, '', {_LISTED})",
    )


def _pop() -> str:
    """A closing brace; inside a statement header the header goes on, else the statement ends."""
    h = "try_element_at(s.stack, -1)"
    row = f"concat_ws({_FIELD}, {h}.line, s.line, {h}.deepest - {h}.depth, {h}.name, {h}.params)"
    after = changed(
        "s",
        _STATE,
        stack="slice(s.stack, 1, size(s.stack) - 1)",
        closed=f"IF({h}.kind = 'function', concat(s.closed, {row}, {_RECORD}), s.closed)",
        depth=f"{h}.depth - {h}.pending",
        paren=f"{h}.paren",
        pending=f"IF({h}.paren > 0, {h}.pending, 0)",
        before=f"IF({h}.paren > 0, s.before, {h}.pending)",
        body="false",
        done=f"{h}.kind = 'do'",
        params=_LISTED,
    )
    return f"IF(size(s.stack) = 0, s, {after})"


def _step() -> str:
    """State ``s`` after the token ``t``."""
    words = ", ".join(f"'{w}'" for w in _KEYWORDS.split("|"))
    # an else lies in the statement that just ended; catch and finally add nothing to their try
    weight = """CASE
        WHEN t = 'else' THEN s.before + 1
        WHEN t IN ('catch', 'finally') THEN s.before
        WHEN t IN ('do', 'for') OR (t = 'while' AND s.done) THEN s.pending
        ELSE s.pending + 1 END"""
    keyword = changed(
        "s",
        _STATE,
        pending=weight,
        stack=_deepen(f"s.depth + {weight}"),
        body="false",
        doing="t = 'do'",
        done="false",
        counted="IF(t = 'for', s.paren + 1, s.counted)",
    )
    ended = {"before": "IF(s.pending > 0, s.pending, s.before)", "pending": "0", "body": "false"}
    line = {"line": "s.line + 1"}
    declared = changed(
        "s",
        _STATE,
        name=r"regexp_extract(t, r'([\w$]+)$', 1)",
        since="s.line",
        level="size(s.stack)",
        params="''",
    )
    counted = changed(
        "s", _STATE, pending="s.pending + 1", counted="0", stack=_deepen("s.depth + s.pending + 1")
    )
    return rf"""CASE
        WHEN t = '\n' THEN IF(s.paren = 0 AND s.pending > 0 AND s.body,
            {changed('s', _STATE, **ended, **line)}, {changed('s', _STATE, **line)})
        WHEN t = '(' THEN {changed('s', _STATE, paren='s.paren + 1', params=_LISTED)}
        WHEN t = ')' THEN {changed('s', _STATE, paren='greatest(s.paren - 1, 0)', params=_LISTED)}
        WHEN t = '{{' THEN {_push()}
        WHEN t = '}}' THEN {_pop()}
        WHEN t = ';' THEN CASE
            WHEN s.counted > 0 AND s.paren = s.counted THEN {counted}
            WHEN s.paren = 0 THEN {changed('s', _STATE, done='false', **ended)}
            ELSE s END
        WHEN rlike(t, r'^function[ \t]') THEN {declared}
        WHEN t IN ({words}) THEN {keyword}
        WHEN btrim(t) = '' THEN s
        ELSE {changed('s', _STATE, params=_LISTED, body='s.body OR s.paren = 0', done='false')}
        END"""


def _imports(code: str, masked: str) -> str:
    """First line of each import statement, as written."""
    statement = r"regexp_extract(z.clean, r'^\s*(import\b(?!\s*[.(])[^;]*;?)', 1)"
    lead = r"char_length(regexp_extract(z.clean, r'^\s*', 0))"
    length = (
        "IF(contains(v, '{') AND NOT contains(v, '}'), char_length(z.raw), char_length(rtrim(v)))"
    )
    quoted = f"IF(v = '', '', rtrim(substring(z.raw, {lead} + 1, greatest({length}, char_length(v)))))"
    lines = rf"zip_with(split({code}, r'\n'), split({masked}, r'\n'), (a, b) -> named_struct('raw', a, 'clean', b))"
    return f"filter(transform({lines}, z -> {let(statement, 'v', quoted)}), v -> v != '')"


def fold_javascript(code: str, facts: Sequence[str] = ("defs", "imports")) -> str:
    """Struct of ``defs`` (function declarations by line) and ``imports``, as asked for."""
    pieces = rf"regexp_extract_all(regexp_replace(k, r'[ \t]+', ' '), {literal(_PIECES)}, 0)"
    start = empty_state(_STATE, line="1")
    folded = f"aggregate({pieces}, {start}, (s, t) -> {_step()}, s -> s.closed)"
    row = struct({n: f"CAST(x[{i}] AS {kind.upper()})" for i, (n, kind) in enumerate(_CLOSED.items())})
    records = f"filter(split({folded}, {_RECORD}), y -> y != '')"
    split_row = f"split(y, {_FIELD})"
    defs = f"sort_array(transform({records}, y -> {let(split_row, 'x', row)}))"
    made = {"defs": defs, "imports": _imports(code, "k")}
    return let(mask_javascript(code), "k", struct({fact: made[fact] for fact in facts}))


def javascript_functions(defs: str) -> str:
    """Function facts in source order, of the same shape as for Python; bare parameters only."""
    row = struct(
        {
            "name": "d.name",
            "line": "d.line",
            "end_line": "d.end_line",
            "params": rf"filter({top_level_parts('d.params')}, v -> rlike(v, r'^[A-Za-z_$][\w$]*$'))",
            "length": "d.end_line - d.line + 1",
            "nesting_depth": "d.nesting",
            "is_method": "false",
            "decorators": NO_STRINGS,
        }
    )
    return f"transform({defs}, d -> {row})"
