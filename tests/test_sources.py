"""Tables, splits, record files, source trees and writers."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from codeloom.operators.columns import (
    code_summary_pairs,
    rename_target,
    resolve_code_summary,
    resolve_text,
    with_defaults,
)
from codeloom.operators.structure import file_reports
from codeloom.plans.analysis import analyze_files, analyze_tree
from codeloom.plans.corpus import local_rejects, format_for_training, prepare_corpus, prepare_local
from codeloom.sources.sinks import write_dataset, write_records, write_reports, write_scores
from codeloom.sources.tables import choose_splits, read_records, read_table
from codeloom.sources import tree as tree_module
from codeloom.sources.tree import files_by_extension, list_tree, read_files, walk_sources


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    body = "def f(a):\n    return a\n" + "# filler\n" * 12
    files = {
        "pkg/__init__.py": body, "pkg/_private/a.py": body, "pkg/short.py": "x = 1\n", ".github/g.py": body,
        "node_modules/n.js": body, "preventvenv/v.py": body, "deep/" + "d/" * 12 + "z.jsx": body, "A.PY": body,
        "m.mjs": body, "b.js": "function g(x) {\n}\n" + "// filler\n" * 12, "notes.txt": body, ".venv/w.py": body,
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "crlf.py").write_bytes(body.replace("\n", "\r\n").encode())
    (root / "latin.py").write_bytes(b"# \xe9\n" * 60)
    os.symlink(root / "gone.py", root / "dangling.py")
    for i in range(40):
        (root / "many").mkdir(exist_ok=True)
        (root / "many" / f"f{i}.py").write_text(f"def f{i}(): pass\n" + body)
    return str(root)


def relative(tree, df, column="path"):
    return sorted(os.path.relpath(r[0], tree) for r in df.select(column).collect())


MANY = [f"many/f{i}.py" for i in range(40)]
DEEP = "deep/" + "d/" * 12 + "z.jsx"


@pytest.mark.parametrize("folders", [1, 3, 256])
def test_listing(spark, tree, folders):
    got = relative(tree, list_tree(spark, tree, [".py", ".js"], folders=folders))
    assert got == sorted(
        [".github/g.py", ".venv/w.py", "b.js", "crlf.py", "dangling.py", "latin.py", "node_modules/n.js",
         "pkg/__init__.py", "pkg/_private/a.py", "pkg/short.py", "preventvenv/v.py", *MANY]
    )


def test_walk_prunes_names_and_matches_suffixes_exactly(spark, tree):
    found = walk_sources(spark, tree)
    assert relative(tree, found) == sorted(
        [".github/g.py", "b.js", "crlf.py", "dangling.py", DEEP, "latin.py", "pkg/__init__.py",
         "pkg/_private/a.py", "pkg/short.py", "preventvenv/v.py", *MANY]
    )
    bad = found.where(F.col("error").isNotNull()).collect()
    assert [os.path.basename(r.path) for r in bad] == ["dangling.py"] and bad[0].content is None


def test_reading_is_spread(spark, tree):
    used = files_by_extension(spark, tree).where(F.contains("path", F.lit("/many/"))).select(F.spark_partition_id())
    assert len({r[0] for r in used.collect()}) > 3


def test_uri_of_a_tree(spark, tree):
    plain = {(os.path.relpath(r.path, tree), bytes(r.content) if r.content is not None else None) for r in files_by_extension(spark, tree).collect()}
    uri = f"file://{tree}"
    assert {(r.path.removeprefix(uri + "/"), bytes(r.content) if r.content is not None else None) for r in files_by_extension(spark, uri).collect()} == plain


def test_stores_list_and_read_like_folders(tree, monkeypatch):
    """The way of other stores, on the file system of this machine."""
    from pyarrow import fs

    monkeypatch.setattr(tree_module, "store_of", lambda uri: (fs.LocalFileSystem(), uri.removeprefix("other://")))
    want = sorted((f"other://{p}", kind) for p, kind in tree_module.entries(tree) if not p.endswith("dangling.py"))
    assert sorted(e for e in tree_module.entries(f"other://{tree}") if not e[0].endswith("dangling.py")) == want
    assert tree_module.read_bytes(f"other://{tree}/b.js", 10**6) == tree_module.read_bytes(f"{tree}/b.js", 10**6)
    with pytest.raises(OSError, match="more than 3"):
        tree_module.read_bytes(f"other://{tree}/b.js", 3)


def test_thousands_of_folders_take_rounds(spark, tmp_path):
    for i in range(1500):
        (tmp_path / "wide" / f"d{i:04d}" / "deeper").mkdir(parents=True)
        (tmp_path / "wide" / f"d{i:04d}" / "deeper" / "x.py").write_text("x")
    got = list_tree(spark, str(tmp_path), [".py"], folders=4)
    assert got.count() == 1500 and got.where("error IS NOT NULL").count() == 0


def test_rejects_have_a_reason(spark, tmp_path):
    (tmp_path / "big.py").write_text("x" * 200)
    (tmp_path / "good.py").write_text("y = 1\n")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    gone = str(tmp_path / "gone")
    assert [tuple(r) for r in list_tree(spark, gone, [".py"]).collect()] == [(gone, "FileNotFoundError: No such file or directory")]
    # A folder that cannot be listed, beside files of all kinds.
    listed = list_tree(spark, str(tmp_path), [".py"]).unionByName(list_tree(spark, gone, [".py"]))
    files = read_files(listed, max_bytes=100)
    assert {os.path.basename(r.path): r.error for r in local_rejects(files).collect()} == {
        "big.py": "OSError: 200 bytes, more than 100", "bad.py": "not valid UTF-8", "gone": "FileNotFoundError: No such file or directory",
    }
    assert [os.path.basename(r.path) for r in files.where("error IS NULL AND is_valid_utf8(content)").collect()] == ["good.py"]
    assert {r.path for r in walk_sources(spark, gone).collect()} == {gone}


def test_local_preparation(spark, tree):
    got = prepare_local(spark, tree)
    assert relative(tree, got, "file") == sorted(["b.js", "crlf.py", "pkg/__init__.py", "pkg/_private/a.py", *MANY])
    texts = {os.path.relpath(r.file, tree): r for r in got.collect()}
    assert texts["crlf.py"].text == texts["pkg/__init__.py"].text
    assert texts["b.js"].language == ".js"


def test_analysis_of_a_tree(spark, tree):
    reports, rejects = analyze_files(walk_sources(spark, tree))
    assert {os.path.basename(r.path): r.error for r in rejects.collect()} == {
        "dangling.py": "FileNotFoundError: No such file or directory",
        "latin.py": "not valid UTF-8",
    }
    assert reports.count() == analyze_tree(spark, tree).count() == 48


def test_splits(spark):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "validation")], "id int, split string")

    def ids(part):
        return None if part is None else [r.id for r in part.collect()]

    assert [ids(p) for p in choose_splits(df)] == [[1], [3]]
    assert [ids(p) for p in choose_splits(df.where("split != 'validation'"))] == [[1], [2]]
    assert [ids(p) for p in choose_splits(df.where("split = 'train'"))] == [[1], None]


def test_columns(spark):
    df = spark.createDataFrame([("a", "b", 1)], "func_code string, code string, target int")
    assert resolve_text(df).columns == ["func_code", "text", "target"]
    assert resolve_text(df, "func_code").columns == ["text", "code", "target"]
    assert rename_target(df).columns == ["func_code", "code", "labels"]
    assert rename_target(df.drop("target")).columns == ["func_code", "code"]
    assert with_defaults(df, ["code", "path"]).select("code", "path").first() == ("b", "")
    with pytest.raises(ValueError, match="no text column"):
        resolve_text(df.select("target"))
    with pytest.raises(ValueError, match="code/summary"):
        resolve_code_summary(df)
    pair = spark.createDataFrame(
        [("x", ["a", "b"], "s", ["c", "d"])],
        "code string, code_tokens array<string>, summary string, docstring_tokens array<string>",
    )
    assert resolve_code_summary(pair) == ("code_tokens", "docstring_tokens")
    assert code_summary_pairs(pair).first() == ("a b", "c d")


def test_preparation_with_missing_columns_and_duplicates(spark):
    long = "x" * 60
    raw = spark.createDataFrame(
        [(3, "Python", long, "r3"), (1, "python", long, None), (2, "PYTHON", "y" * 50, "r2"), (4, "python", "z" * 49, "r"),
         (5, "java", "w" * 60, "r"), (6, None, "q" * 60, "r"), (7, "python", None, "r"), (8, "python", "v" * 50_001, "r")],
        "id bigint, language string, content string, repo_name string",
    )
    got = prepare_corpus(raw, "python", "id", keep=["id"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [
        (1, long, "python", None, "", 60), (2, "y" * 50, "python", "r2", "", 50),
    ]
    assert [r.id for r in prepare_corpus(raw, "python", "id", max_files=1, keep=["id"]).collect()] == [1]


def test_preparation_needs_an_order(spark):
    with pytest.raises(ValueError, match="order_by"):
        prepare_corpus(spark.createDataFrame([("x", "y")], "language string, content string"), "python")


def test_record_files(spark, tmp_path):
    path = str(tmp_path / "records")
    rows = [("é\n\"x\"", "python", "r", "p", 5), ("b", "python", None, "q", 1)]
    df = spark.createDataFrame(rows, "code string, language string, repo string, path string, size int")
    write_records(df, path)
    write_records(df.limit(1), path)
    assert sorted(map(tuple, read_records(spark, path).collect()), key=str) == sorted([*rows, rows[0]], key=str)
    (tmp_path / "other.jsonl").write_text('{"language": "x"}\n{"code": "abc"}\n')
    read = read_records(spark, str(tmp_path / "other.jsonl"))
    assert [r.code for r in read.collect()] == ["", "abc"]
    write_dataset(format_for_training(read), str(tmp_path / "set"))
    assert sorted(r.text for r in read_table(spark, str(tmp_path / "set")).collect()) == ["", "abc"]


def test_json_results(spark, tmp_path):
    reports = file_reports(spark.createDataFrame([("a.py", "import os\ndef f(a): pass\n")], "file string, text string"))
    write_reports(reports, str(tmp_path / "reports"))
    lines = [json.loads(x) for p in (tmp_path / "reports").glob("part*") for x in p.read_text().splitlines()]
    assert lines[0]["functions"] == [
        {"name": "f", "line": 2, "end_line": 2, "params": ["a"], "length": 1, "nesting_depth": 0,
         "is_method": False, "decorators": []}
    ]
    assert lines[0]["imports"] == ["os"] and lines[0]["total_lines"] == 3
    write_scores(spark.createDataFrame([(10, 0.5), (1, 0.25)], "k bigint, score double"), str(tmp_path / "scores"))
    text = "".join(p.read_text() for p in (tmp_path / "scores").glob("part*"))
    assert json.loads(text) == {"pass@1": 0.25, "pass@10": 0.5}
