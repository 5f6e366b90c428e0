"""Source code derived from the prose of ``documents``.

Each line of a document picks a template by its place, and a word of the line fills it. Every
template line states what it is, so the oracle works from a table of stated facts while the Spark
side has to find the same facts in the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Line:
    text: str
    kind: str = "plain"  # def, class, block, plain, note (blank or comment), cont (continuation)
    indent: int = 0
    name: str = ""
    weight: int = 0
    params: str = ""
    decorator: str = ""
    imports: str = ""  # separated by |


PYTHON = [
    [Line("import {w}, os  # import no", imports="{w}|os")],
    [Line("from .{w} import x; import re", imports="from .{w}|re")],
    [
        Line("class C{w}(object):", "class", 0, "C{w}"),
        Line('    base = "def no():"', indent=4),
    ],
    [
        Line(
            "    def m_{w}(self, a, b: int, c=(1, 2), d: int = 2, *rest, **more):",
            "def", 4, "m_{w}", params="self,a,b,c",
        ),
        Line("        if a:", "block", 8, weight=1),
        Line("            return '}'", indent=12),
        Line("        else:", "block", 8, weight=2),
        Line("            for q in b:", "block", 12, weight=1),
        Line("                pass", indent=16),
    ],
    [
        Line("    @staticmethod", indent=4),
        Line("    def s_{w}(v):", "def", 4, "s_{w}", params="v", decorator="@staticmethod"),
        Line("        return [", indent=8),
        Line("v]", "cont"),
    ],
    [
        Line("def f_{w}(a,", "def", 0, "f_{w}", params="a,b"),
        Line("    b='x, y'):", "cont"),
        Line("    try:", "block", 4, weight=1),
        Line("        def inner_{w}(): return 1", "def", 8, "inner_{w}"),
        Line("", "note"),
        Line("    finally:", "block", 4, weight=1),
        Line("        pass", indent=8),
    ],
    [Line("# def c_{w}(): pass", "note")],
    [
        Line("@first", indent=0),
        Line("@deco('{w}')", indent=0),
        Line("async def g_{w}():", "def", 0, "g_{w}", decorator="@deco('{w}')"),
        Line("    while True:", "block", 4, weight=1),
        Line("        with a as b:", "block", 8, weight=1),
        Line("            pass", indent=12),
    ],
    [
        Line('"""{w}'),
        Line("def hidden():", "cont"),
        Line('"""', "cont"),
    ],
    [Line('    x_{w} = {"k": [1, 2]}', indent=4)],
    [
        Line("    def o_{w}(x, *, y: str): return x", "def", 4, "o_{w}", params="x,y"),
        Line("    async def p_{w}(self):", "def", 4, "p_{w}", params="self"),
        Line("        try: import {w}.sub as z, json", "block", 8, weight=1, imports="json"),
        Line("        except E:", "block", 8, weight=2),
        Line("            x = 1 + \\", indent=12),
        Line("2", "cont"),
    ],
]

JAVASCRIPT = [
    [Line('import {w} from "m;n"; // import no', imports='import {w} from "m;n";')],
    [
        Line("function f_{w}(a, b = 1, ...rest) {", "def", 0, "f_{w}", params="a"),
        Line("  if (a) {", "block", 2, weight=1),
        Line("    return;", indent=4),
        Line("  } else if (b) {", "block", 2, weight=3),
        Line('    for (let i = 0; i < 3; i++) { x("}"); }', "block", 4, weight=1),
        Line("  }", "end", 2),
        Line("}", "end"),
    ],
    [Line("const g = function h_{w}(z) { return `{${z}`; };")],
    [Line("// function no_{w}() {}", "note")],
    [
        Line("export async function e_{w}(p, {q}) {", "def", 0, "e_{w}", params="p"),
        Line("  while (p) q(/[{\"]/);", "block", 2, weight=1),
        Line("}", "end"),
    ],
    [
        Line("items.map(function (it) {"),
        Line("  if (it) { go(); }", "block", 2, weight=1),
        Line("});"),
    ],
    [
        Line("function outer_{w}(u) {", "def", 0, "outer_{w}", params="u"),
        Line("  function inner_{w}(v) {", "def", 2, "inner_{w}", params="v"),
        Line("    try { v(); } catch (e) { if (e) { u(); } }", "block", 4, weight=2),
        Line("  }", "end", 2),
        Line("  for (const k of u) { inner_{w}(k); }", indent=2),
        Line("}", "end"),
    ],
    [Line("import {", imports="import {"), Line("  {w}"), Line('} from "q"')],
]


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def code_files(documents: DataFrame, templates: list[list[Line]], suffix: str) -> DataFrame:
    """``doc_id``, ``file`` and ``text``: one derived file for each document."""
    texts = ["\n".join(line.text for line in t) for t in templates]
    filled = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.replace(
            F.element_at(
                F.array(*map(F.lit, texts)), ((F.col("doc_id") + i) % len(texts)).cast("int") + 1
            ),
            F.lit("{w}"),
            F.coalesce(F.nullif(F.regexp_extract(x, "[A-Za-z]+", 0), F.lit("")), F.lit("x")),
        ),
    )
    return documents.select(
        "doc_id",
        F.concat("source", F.lit("/f"), "doc_id", F.lit(suffix)).alias("file"),
        F.array_join(filled, "\n").alias("text"),
    )


def lines_sql(templates: list[list[Line]], suffix: str) -> str:
    """Common table expressions up to ``lines``: the stated facts of every line of every file."""
    rows = ",\n".join(
        f"({t}, {s}, {_quote(x.kind)}, {x.indent}, {_quote(x.name)}, {x.weight}, "
        f"{_quote(x.params)}, {_quote(x.decorator)}, {_quote(x.imports)})"
        for t, template in enumerate(templates)
        for s, x in enumerate(template)
    )
    return f"""
    template(t, s, kind, indent, name, weight, params, decorator, imports) AS (VALUES {rows}),
    places AS (
      SELECT doc_id, source || '/f' || doc_id || '{suffix}' AS file,
             unnest(string_split(text, chr(10))) AS prose,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
      FROM documents),
    words AS (
      SELECT doc_id, file, i, (doc_id + i) % {len(templates)} AS t,
             coalesce(nullif(regexp_extract(prose, '[A-Za-z]+'), ''), 'x') AS w
      FROM places),
    lines AS (
      SELECT doc_id, file, row_number() OVER (PARTITION BY doc_id ORDER BY i, s) AS ln, i, s,
             kind, indent, replace(name, '{{w}}', w) AS name, weight, params,
             replace(decorator, '{{w}}', w) AS decorator, replace(imports, '{{w}}', w) AS imports
      FROM words JOIN template USING (t))"""


# From lines to headers with their extents, for code that is structured by indent.
EXTENTS_SQL = """,
    next_out AS (
      SELECT h.doc_id, h.ln, min(x.ln) AS stop
      FROM lines h LEFT JOIN lines x ON x.doc_id = h.doc_id AND x.ln > h.ln
           AND x.kind NOT IN ('note', 'cont') AND x.indent <= h.indent
      WHERE h.kind IN ('def', 'class', 'block') GROUP BY 1, 2),
    extent AS (
      SELECT n.doc_id, n.ln, max(x.ln) AS end_ln
      FROM next_out n JOIN lines x ON x.doc_id = n.doc_id AND x.ln >= n.ln
           AND x.kind <> 'note' AND (n.stop IS NULL OR x.ln < n.stop)
      GROUP BY 1, 2),
    header AS (SELECT l.*, e.end_ln FROM lines l JOIN extent e USING (doc_id, ln)),
    reach AS (
      SELECT f.doc_id, f.ln, b.ln AS at_ln, sum(e.weight) AS depth
      FROM header f
      JOIN header b ON b.doc_id = f.doc_id AND b.kind = 'block' AND b.ln > f.ln AND b.ln <= f.end_ln
      JOIN header e ON e.doc_id = f.doc_id AND e.kind = 'block' AND e.ln > f.ln
           AND e.ln <= b.ln AND e.end_ln >= b.ln
      WHERE f.kind = 'def' GROUP BY 1, 2, 3),
    nest AS (SELECT doc_id, ln, max(depth) AS depth FROM reach GROUP BY 1, 2),
    owner AS (
      SELECT f.doc_id, f.ln, arg_max(o.kind, o.ln) AS kind, max(o.ln) AS owner_ln,
             bool_or(o.kind = 'class') AS in_class
      FROM header f JOIN header o ON o.doc_id = f.doc_id AND o.ln < f.ln AND o.end_ln >= f.ln
      WHERE f.kind = 'def' GROUP BY 1, 2),
    functions AS (
      SELECT f.doc_id, f.file, f.name, CAST(f.ln AS INTEGER) AS line, CAST(f.end_ln AS INTEGER) AS end_line,
             f.params, CAST(f.end_ln - f.ln + 1 AS INTEGER) AS length,
             CAST(coalesce(n.depth, 0) AS INTEGER) AS nesting_depth,
             coalesce(o.in_class, false) AS is_method, f.decorator AS decorators,
             o.kind = 'class' AND f.decorator = '' AS direct, o.owner_ln
      FROM header f LEFT JOIN nest n USING (doc_id, ln) LEFT JOIN owner o USING (doc_id, ln)
      WHERE f.kind = 'def'),
    classes AS (
      SELECT c.doc_id, c.file, c.name, CAST(c.ln AS INTEGER) AS line,
             coalesce(string_agg(m.name, ',' ORDER BY m.line), '') AS methods,
             CAST(count(m.name) AS INTEGER) AS num_methods
      FROM header c LEFT JOIN functions m ON m.doc_id = c.doc_id AND m.direct AND m.owner_ln = c.ln
      WHERE c.kind = 'class' GROUP BY ALL),
    imports AS (
      SELECT doc_id, file, unnest(string_split(imports, '|')) AS import, ln,
             generate_subscripts(string_split(imports, '|'), 1) AS n
      FROM lines WHERE imports <> '')"""
