"""Text functions against Python's own string methods and worked-out boundary rows."""

from __future__ import annotations

import re
import tempfile
import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.tokens import TOKEN_PATTERN, first_tokens
from codeloom.operators.filters import junk_path, language_is, long_enough, short_enough


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


ODD = [
    "", " ", "\n", "a", "a\n", "\n\n", "x\ndef g():", "def g():\n  pass", "def a\n def b\ndef c", "a\nclass b\ndef c",
    "a\ndefine\nclassy\ndef\tx\ndef x", "a\n\nb", "\n\nb", " \n\t\nb\n\nc", "a\n \xa0\x1c\u3000\nb", "a\nb", "a\n ", "\r\na\r\n\r\nb",
    "é\n😀\n\n", "a\n\x0b\x0c\nq",
]
LINES = st.lists(st.sampled_from(["", " ", "\t", "\u2003", "def f", "class C", " def g", "x", "def", "é"]), max_size=8)


def by_lines(text, stop, inclusive):
    out = []
    for i, line in enumerate(text.split("\n")):
        if stop(i, line) and not inclusive:
            break
        out.append(line)
        if stop(i, line):
            break
    return "\n".join(out)


def expected_next_def(text):
    return by_lines(text, lambda i, x: i > 0 and x.startswith(("def ", "class ")), False)


def expected_display(text):
    return by_lines(text, lambda i, x: i > 0 and x.strip() == "", True)


@pytest.mark.parametrize(
    "fn, expected",
    [
        (T.truncate_next_def, expected_next_def),
        (T.display_cut, expected_display),
        (T.py_strip, str.strip),
        (T.stripped_length, lambda t: len(t.strip())),
        (T.total_lines, lambda t: t.count("\n") + 1),
        (T.token_estimate, lambda t: len(t) // 4),
    ],
)
def test_like_python(spark, fn, expected):
    assert column(spark, ODD, fn) == [expected(t) for t in ODD]


@settings(max_examples=8, deadline=None)
@given(st.lists(LINES, min_size=20, max_size=40))
def test_cuts_on_random_lines(spark, many):
    texts = ["\n".join(lines) for lines in many]
    assert column(spark, texts, T.truncate_next_def) == [expected_next_def(t) for t in texts]
    assert column(spark, texts, T.display_cut) == [expected_display(t) for t in texts]


def test_long_text_does_not_overflow(spark):
    long = "x = 1\n" * 60_000
    assert column(spark, [long], T.truncate_next_def) == [long]
    assert column(spark, [long], T.display_cut) == [expected_display(long)]


def test_strip_prompt_goes_by_length_only(spark):
    df = spark.createDataFrame([("abc", "abcdef"), ("😀b", "xyz"), ("long", "s")], "p string, g string")
    assert [r[0] for r in df.select(T.strip_prompt(F.col("g"), F.col("p"))).collect()] == ["def", "z", ""]


def test_function_name(spark):
    prompts = ["def  solve (x):", "no header", "class A:\n  def m(self)", "def é1(x)", "def x", "xdef\tf("]
    want = [(m.group(1) if (m := re.search(r"def\s+(\w+)\s*\(", p)) else "candidate") for p in prompts]
    assert column(spark, prompts, T.function_name) == want


def test_truncation_boundaries(spark):
    lengths = [0, 3, 2047, 2048, 2049, 2051, 2052, 2053, 9000]
    cut = column(spark, ["é" * n for n in lengths], lambda v: F.char_length(T.truncate_tokens(v, 512)))
    assert cut == [n if n // 4 <= 512 else 2048 for n in lengths]
    assert cut[3:7] == [2048, 2049, 2051, 2048]


def test_length_filters(spark):
    texts = ["  " + "a" * 49 + "\u3000", "  " + "a" * 50 + "\xa0", None, "b" * 50_000, "b" * 50_001]
    assert column(spark, texts, long_enough) == [False, True, False, True, True]
    assert column(spark, texts, short_enough) == [True, True, None, True, False]
    assert column(spark, texts[:2], lambda v: long_enough(v, 100)) == [False, False]


def test_language_filter_lowers_the_row_only(spark):
    langs = ["Python", "PYTHON", "python", "", None]
    assert column(spark, langs, lambda v: language_is(v, "python")) == [True, True, True, False, False]
    assert column(spark, langs, lambda v: language_is(v, "Python")) == [False] * 5


def test_paths(spark):
    paths = ["a/b.py", "repo/.github/a.py", "preventvenv/x.js", "x/.PY", "a.tar.GZ", "d.e/f", "x.JSX", "m.mjs", "a.", "..py"]
    assert column(spark, paths, T.file_suffix) == [".py", "", "", "", ".GZ", "", ".JSX", ".mjs", "", ".py"][:1] + [
        ".py", ".js", "", ".GZ", "", ".JSX", ".mjs", "", ".py"
    ]
    assert column(spark, paths, junk_path) == [False, True, True] + [False] * 7
    assert column(spark, paths, T.language_of) == [
        "python", "python", "javascript", None, None, None, "javascript", "javascript", None, "python"
    ]
    assert column(spark, [".ts", ".PY", ".cpp"], T.extension_language) == ["typescript", None, "cpp"]


def test_decode(spark):
    raw = [b"a\r\nb\rc\n", "é".encode(), b"\x80", b"", None]
    assert column(spark, raw, T.decode_source, "binary") == ["a\nb\nc\n", "é", None, "", None]


def test_program(spark):
    df = spark.createDataFrame([("  return 1", "assert f()", "def f():\n", "f")], "c string, t string, p string, e string")
    c, t, p, e = (F.col(n) for n in "ctpe")
    row = df.select(T.assemble_program(c, t), T.assemble_program(c, t, p), T.assemble_program(c, t, p, e)).first()
    assert list(row) == [
        "  return 1\n\nassert f()",
        "def f():\n  return 1\n\nassert f()",
        "def f():\n  return 1\n\nassert f()\n\ncheck(f)\n",
    ]


@pytest.mark.parametrize("n", [1, 64, 256, 257, 600, 5000])
def test_first_tokens_are_those_of_the_whole_text(spark, n):
    texts = ["", None, "  \t\n", "a_1,b", "é à x" * 400, "ab, c " * 2500, "x" * 100_000, "- " * 9000 + "end", " lead"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", first_tokens(F.col("text"), n).alias("t")).collect()
    for r in rows:
        assert r.t == (None if r.text is None else re.findall(TOKEN_PATTERN, r.text, re.ASCII)[:n])


def test_tokens_beyond_the_bound_cost_nothing(spark):
    """The time for 64 tokens of a 10 MB text is a small part of that for all of its tokens."""
    folder = tempfile.mkdtemp(prefix="long-text-")
    spark.createDataFrame([("ab, c " * 1_700_000,)], "text string").write.mode("overwrite").parquet(folder)
    long = spark.read.parquet(folder)

    def seconds(tokens):
        best = []
        for _ in range(2):
            start = time.perf_counter()
            assert long.select(F.size(tokens)).first()[0] >= 64
            best.append(time.perf_counter() - start)
        return min(best)

    assert seconds(first_tokens(F.col("text"), 64)) < 0.5 * seconds(F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), F.lit(0)))
