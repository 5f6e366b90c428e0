"""Structure of source: worked-out snippets, and whole library modules against the standard parser."""

from __future__ import annotations

import glob
import os
import warnings

import pytest
from ast_facts import facts
from pyspark.sql import functions as F

from codeloom.operators.structure import (
    FIELDS,
    class_table,
    corpus_totals,
    count_totals,
    file_counts,
    file_reports,
    function_table,
    import_table,
    unsupported,
    with_structure,
)


def report(spark, code, file="a.py"):
    return file_reports(spark.createDataFrame([(file, code)], "file string, text string")).first()


def functions(spark, code, file="a.py"):
    return {f.name: f for f in report(spark, code, file).functions}


def test_parameters(spark):
    code = "def f(a, b: int, c=1, d: int = 2, *args, **kw): pass\ndef g(a, /, b, *, c, d: D[x, 'y'], e=(1, 2)): pass\n"
    found = functions(spark, code)
    assert found["f"].params == ["a", "b", "c"]
    assert found["g"].params == ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize(
    "body, depth",
    [
        ("return 1", 0),
        ("if a:\n  return 1", 1),
        ("if a:\n  b\nelse:\n  c", 2),
        ("if a:\n  b\nelif c:\n  d\nelif e:\n  f", 2),
        ("try:\n  a\nfinally:\n  b", 1),
        ("try:\n  a\nexcept E:\n  b", 2),
        ("try:\n  a\nexcept* E:\n  b", 1),
        ("for a in b:\n  if c:\n    d\n  elif e:\n    while f:\n      g", 4),
        ("def inner():\n  if a:\n    for b in c:\n      d", 2),
        ("match a:\n  case 1:\n    b", 0),
        ("x = [i for i in y if i]\nz = 1 if x else 2", 0),
        ("async with a:\n  pass", 1),
        ("for a in b:\n  pass\nelse:\n  c", 2),
    ],
)
def test_nesting(spark, body, depth):
    code = "def f():\n" + "\n".join("    " + line for line in body.split("\n")) + "\n"
    assert functions(spark, code)["f"].nesting_depth == depth


def test_methods_and_decorators(spark):
    code = (
        "class A:\n    def m(self):\n        def helper(): pass\n\n    @one\n    @two(\n        1)\n    def p(self): pass\n"
        "    @one\n    # note\n    def q(self): pass\n    if x:\n        def r(self): pass\n"
    )
    r = report(spark, code)
    f = {x.name: x for x in r.functions}
    assert [f[n].is_method for n in ("m", "helper", "p", "q", "r")] == [True] * 5
    assert f["p"].decorators == ["@two(\n        1)"] and f["q"].decorators == [] and f["m"].decorators == []
    assert [(c.name, c.methods, c.num_methods) for c in r.classes] == [("A", ["m"], 1)]
    assert (f["p"].line, f["p"].end_line) == (8, 8)


def test_imports(spark):
    code = (
        "import a, b\nimport c as d\nfrom e import f\nfrom . import g\nfrom ..h.i import (j,\n  k)\n"
        "from __future__ import annotations\ntry: import l\nexcept E: import m; import n as o\n"
        "def x():\n    import a\ns = '''\nimport no\n'''\nfrom p \\\n  import q\n"
    )
    assert report(spark, code).imports == ["a", "b", "from e", "from .", "from ..h.i", "l", "m", "a", "from p"]


def test_strings_and_extents(spark):
    code = (
        'def f():\n    """doc\ndef no():\n    """\n    x = "def no2(): # {"\n    return {\n\'a\': 1,\n}\n'
        "    # inside\n# outside\n\n\ndef g():\n\tif x:\n\t\tpass\n        # as deep as the body\n    # shallower\n"
    )
    found = functions(spark, code)
    assert {n: (f.line, f.end_line, f.length) for n, f in found.items()} == {"f": (1, 9, 9), "g": (13, 17, 5)}


def test_an_open_bracket_ends_at_the_next_definition(spark):
    code = 'def f(d):\n    return f"{d["("]}"\n\n\n@deco\ndef g():\n    x = (1,\n\nclass C:\n    def m(self):\n        y = [\n    def n(self, a,\n          b):\n        pass\n'
    got = report(spark, code)
    assert [(f.name, f.line, f.end_line, f.params) for f in got.functions] == [
        ("f", 1, 2, ["d"]), ("g", 6, 7, []), ("m", 10, 11, ["self"]), ("n", 12, 14, ["self", "a", "b"]),
    ]
    assert [c.methods for c in got.classes] == [["m", "n"]] and got.functions[1].decorators == ["@deco"]


def test_lambda_defaults(spark):
    code = "def f(a=lambda x, y: 1, b=lambda: 2, c=lambda x=(1, 2), *z: (x, z), lambda_d=3): pass\n"
    assert report(spark, code).functions[0].params == ["a", "b", "c", "lambda_d"]


def test_empty_and_unknown_files(spark):
    r = report(spark, "")
    assert (r.total_lines, r.avg_function_length, r.max_nesting, r.functions) == (1, 0.0, 0, [])
    files = spark.createDataFrame([("a.py", "x"), ("b.rb", "x"), ("c.MJS", "x")], "file string, text string")
    assert {r.language for r in file_reports(files).collect()} == {"python", "javascript"}
    assert [r.file for r in unsupported(files).collect()] == ["b.rb"]


def test_javascript(spark):
    code = """import a, {b} from "x;y"; // c
import {
  z } from 'q'
const d = import("x");
// function no() {}
function quick(arr, k = {a: 1}, ...rest) {
  if (arr) { return; } else if (k) {
    for (let i = 0; i < 3; i++) { x("}"); }
  } else {
    while (1) y();
  }
  for (const q of arr) { if (q) z() }
  do { a() } while (b);
  try { b() } catch (e) { if (e) { c() } }
}
export default async function foo({p, q}, [r], s) {
  const g = function inner(z) { return /[{"]/.test(z); };
  (function again(y) { })();
  items.forEach(function (it) {
    if (it)
      bar()
    baz({ if: 1 })
  });
  function nested(u,
     v) { with (u) { } }
}
function* gen(x) { }
class A { m(x) { if (x) { } } }
"""
    r = report(spark, code, "lib/a.jsx")
    assert [(f.name, f.line, f.end_line, f.params, f.nesting_depth) for f in r.functions] == [
        ("quick", 6, 15, ["arr"], 5),
        ("foo", 16, 26, ["s"], 1),
        ("nested", 24, 25, ["u", "v"], 1),
    ]
    assert not any(f.is_method or f.decorators for f in r.functions)
    assert r.classes == [] and r.imports == ['import a, {b} from "x;y";', "import {"]


def test_javascript_declarations_after_blanks(spark):
    code = f"{' ' * 500}function a(x) {{}}\nexport{' ' * 40}async{' ' * 40}function b(y) {{}}\nif (q) r(); else function c(z) {{}}\nv = else_ + function d(w) {{}};\n"
    got = functions(spark, code, "a.js")
    assert {n: f.params for n, f in got.items()} == {"a": ["x"], "b": ["y"], "c": ["z"]}


@pytest.mark.parametrize(
    "line",
    [
        "x =" + " " * 12 + "/[\"{]/.test(a);",
        "if (a) /[\"{]/.test(a);",
        "if (b(c(a), (1))) /* why { */ /[\"{]/.test(a);",
        "x = /* { */\n   /[`{]/g.exec(a), /'/.test(a);",
        "return" + " " * 20 + "/}/.test(a);",
        "v = [1].map(y => /[{(]/.test(y));",
        "x = (a) / 2 + '/{'; y = a[0] / 3 + \"{/\";",
        "x = \"a\" / 2 / a; // {",
    ],
)
def test_javascript_regular_expressions(spark, line):
    code = f"function f(a) {{\n  {line}\n}}\nfunction g(b) {{ }}\n"
    got = functions(spark, code, "a.js")
    assert {n: (r.params, r.line) for n, r in got.items()} == {"f": (["a"], 1), "g": (["b"], code.count("\n"))}
    assert got["f"].end_line == code.count("\n") - 1


def test_code_without_a_file_name(spark):
    df = spark.createDataFrame([("x", "javascript", "function f(a) {}"), ("y", "python", "def g(b): pass")], "id string, lang string, code string")
    got = file_reports(df, "id", "code", language="lang").orderBy("file").collect()
    assert [(r.language, r.functions[0].name, r.functions[0].params) for r in got] == [
        ("javascript", "f", ["a"]), ("python", "g", ["b"])
    ]


@pytest.mark.parametrize(
    "file, code, functions, line",
    [
        ("a.py", 'def f():\n    """' + "ab c\n" * 50_000 + '"""\n', 1, 1),
        ("a.py", 'x = "' + 'a\\"b' * 50_000 + '"\ndef f(): pass\n', 1, 2),
        ("a.py", "#" + "x" * 200_000 + "\ndef f(): pass\n", 1, 2),
        ("a.py", "x = [\n" + "  (1, 2),\n" * 30_000 + "]\ndef f(a): pass\n", 1, 30_003),
        ("a.py", "def f(a, b=1):\n  if a:\n    return b\n" * 2_000, 2_000, 1),
        ("a.js", "var a = " + "x + " * 100_000 + "1;\nfunction f(a) {}\n", 1, 2),
        ("a.js", "var a = `" + "x + " * 100_000 + "`;\nfunction f(a) {}\n", 1, 2),
        ("a.js", "/*" + "x\n" * 50_000 + "*/\nfunction f(a) {}\n", 1, 50_002),
    ],
    ids=["docstring", "string", "comment", "list", "functions", "js-line", "js-template", "js-comment"],
)
def test_large_files(spark, file, code, functions, line):
    r = report(spark, code, file)
    assert len(r.functions) == functions and r.functions[0].line == line


@pytest.fixture(scope="module")
def library():
    found = {}
    base = os.path.dirname(os.__file__)
    paths = sorted(glob.glob(f"{base}/*.py") + glob.glob(f"{base}/[a-h]*/*.py"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for path in paths:
            try:
                with open(path, encoding="utf-8") as f:
                    code = f.read()
                found[path] = (code, facts(code))
            except (UnicodeDecodeError, SyntaxError):
                continue
    return found


def test_against_the_standard_parser(spark, library):
    rows = [(path, code) for path, (code, _) in library.items()]
    files = spark.createDataFrame(rows, "file string, text string").repartition(16)
    got = {r.file: r for r in file_reports(files).collect()}
    assert len(got) == len(library) > 150
    for path, (code, (functions, classes, imports)) in library.items():
        r, lines = got[path], code.split("\n")
        assert [(f.name, f.line, f.params, f.nesting_depth, f.is_method) for f in r.functions] == [
            (f[0], f[1], f[3], f[4], f[5]) for f in functions
        ], path
        for f, known in zip(r.functions, functions):
            # the parser leaves out comments that end a body
            trailing = lines[known[2] : f.end_line]
            assert f.end_line >= known[2] and all(not x.strip() or x.strip()[0] == "#" for x in trailing), (path, f)
        assert [(c.name, c.line, c.methods) for c in r.classes] == classes, path
        assert r.imports == imports, path


def test_totals_agree_with_tables(spark, library):
    rows = [(path, code) for path, (code, _) in list(library.items())[:40]]
    reports = file_reports(spark.createDataFrame(rows, "file string, text string")).persist()
    totals = corpus_totals(reports).first()
    assert totals.files == 40
    assert totals.functions == function_table(reports).count()
    assert totals.classes == class_table(reports).count()
    assert import_table(reports).count() == reports.select(F.sum(F.size("imports"))).first()[0]
    assert count_totals(file_counts(spark.createDataFrame(rows, "file string, text string"))).first() == totals
    kept = with_structure(reports)
    assert kept.count() == reports.where((F.size("functions") > 0) | (F.size("classes") > 0)).count()
    means = function_table(reports).groupBy("file").agg(F.avg("length").alias("m"), F.max("nesting_depth").alias("d"))
    for r in reports.join(means, "file").collect():
        assert abs(r.m - r.avg_function_length) < 1e-9 and r.d == r.max_nesting
    reports.unpersist()


def test_analysis_runs_once_under_a_filter(spark):
    files = spark.createDataFrame([("a.py", "x")], "file string, text string")
    for df in (with_structure(file_reports(files)), function_table(file_reports(files))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count('|[^"\'#]++|') <= 1


CODE = {
    "a.py": 'import os\n@d\nclass A(\n  B):\n  def m(self, x=(1,\n   2)):\n    if x: return """\ndef no():\n"""\n# def no\n',
    "b.py": "def f(a, [\n  b\ndef g(): pass\ndef = 3\nasync def h(): pass\ndef open(",
    "c.js": "import x from 'y';\nfunction f(a, b) { if (a) { return function (c) { return '}'; }; } }\nfunction g() {}\n",
    "d.py": "",
    "e.md": "def f(): pass",
}


@pytest.fixture(scope="module")
def snippets(spark, library):
    rows = list(CODE.items()) + [("n.py", None), *((path, code) for path, (code, _) in list(library.items())[:60])]
    return spark.createDataFrame(rows, "file string, text string").repartition(8)


def test_counts_are_those_of_the_reports(snippets):
    want = file_reports(snippets).select("file", "language", F.size("functions"), F.size("classes")).collect()
    got = file_counts(snippets).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 64
    assert {r.file: (r.functions, r.classes) for r in got if r.file == "a.py"} == {"a.py": (1, 1)}


@pytest.mark.parametrize("fields", [*([f] for f in FIELDS), ["total_lines", "classes"], []])
def test_fields_asked_for_are_those_of_whole_reports(snippets, fields):
    got = file_reports(snippets, fields=fields)
    assert got.columns == ["file", "language", *(f for f in FIELDS if f in fields)]
    want = file_reports(snippets).select(got.columns)
    assert sorted(got.collect(), key=lambda r: r.file) == sorted(want.collect(), key=lambda r: r.file)


def test_unknown_fields(snippets):
    with pytest.raises(ValueError, match="nesting"):
        file_reports(snippets, fields=["nesting"])
