"""Exact dedup, line dedup and mixing: small rows, brute force, and SQL on the given tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from codeloom.llm import catalog
from codeloom.llm.exact_dedup import exact_dedup
from codeloom.llm.line_dedup import dedup_lines
from codeloom.llm.mixing import mix_sources, mixed_rows

DOCS = "doc_id long, text string, source string, keep_id string, hash int, place int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], DOCS)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op5_exact_dedup", "op8_judge_urls"])
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, small)
    result = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(columns).collect()))) == sorted(map(str, result.fetchall()))


def weak(text):
    """A digest with four values, so that collisions are sure."""
    return F.unhex(F.substring(F.hex(F.crc32(text) % 4 + 16), -2, 2))


@pytest.mark.parametrize("digest", [None, weak])
def test_exact_dedup_cases(spark, digest):
    texts = ["a  b", "a b", "a\tb", "", None, " ", "  ", "Ä", "x" * 300_000, "x" * 300_000, "x" * 299_999 + "y", "a b ", "a b"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (None, "only null"), (3, ""), (3, "")]
    options = {"digest": digest} if digest else {}
    got = exact_dedup(docs_of(spark, rows), **options).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(got) == len(rows)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == sha]
        named = [i for i in ids if i is not None]
        assert sorted(map(str, (r.doc_id for r in mine))) == sorted(map(str, ids))
        assert {r.group_size for r in mine} == {len(ids)} and sum(r.kept for r in mine) == 1
        assert {r.keep_id for r in mine} == {min(named) if named else None}
        assert [r.doc_id for r in mine if r.kept] == [min(named) if named else None]


def test_exact_dedup_empty(spark):
    assert exact_dedup(docs_of(spark, [])).count() == 0


def words(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


def brute_lines(rows, least):
    """Lines that lie in a run of ``least`` words that stands earlier, blank lines inside it too."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, gone = {}, defaultdict(set)
    runs = []
    for rank, k in enumerate(order):
        lines = [(p, " ".join(x.split())) for p, x in enumerate((rows[k][1] or "").split("\n"))]
        lines = [(p, x) for p, x in lines if x]
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                part = lines[i : j + 1]
                content = tuple(x for _, x in part)
                if sum(len(x.split()) for x in content) >= least:
                    runs.append((rank, i, k, content, range(part[0][0], part[-1][0] + 1)))
    for rank, i, k, content, at in sorted(runs, key=lambda r: r[:2] + (len(r[3]),)):
        if content in seen:
            gone[k].update(at)
        else:
            seen[content] = (rank, i)
    return ["\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[k]) if t is not None else None for k, (_, t) in enumerate(rows)]


def test_line_dedup_against_all_runs(spark):
    a, b, c = words(8, "a"), words(7, "b"), words(20, "c")
    rows = [
        (5, f"{c}\nnew five"), (1, f"{a}\n{b}\nown one"), (2, f"own two\n{a}\n\n  {b} \n{words(3, 'd')}"),
        (3, f"{a}\nbetween\n{b}"), (4, f"{c}\n{c}\n{a}"), (6, None), (7, ""), (8, "\n \n"), (9, c), (None, f"z\n{c}"),
        (10, "x\n" * 40), (10, "x\n" * 40), (11, f"{b}\n{a}"), (12, "y " * 5000 + "\nend"), (13, "y " * 5000 + "\nend2"),
    ]
    docs = spark.createDataFrame([(i, t, "keep", 7) for i, t in rows], "doc_id long, text string, place string, n_lines int")
    got = dedup_lines(docs, min_words=10)
    assert got.columns == ["doc_id", "text", "place", "n_lines", "n_deleted"]
    want = brute_lines(rows, 10)
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, ((i, t) for (i, _), t in zip(rows, want))))
    assert {r.place for r in got.collect()} == {"keep"}


def test_passages_inside_lines_stay(spark):
    """Out of reach: a repeated passage that does not begin and end with lines. With lines of its own it goes."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"before {passage} after"), (2, f"other {passage} end"), (3, f"top\n{passage}\nend"), (4, f"head\n{passage}\ntail")]
    got = {r.doc_id: (r.text, r.n_deleted) for r in dedup_lines(docs_of(spark, rows)).collect()}
    assert got == {**{i: (t, 0) for i, t in rows[:3]}, 4: ("head\ntail", 1)}


def test_line_dedup_empty(spark):
    assert dedup_lines(docs_of(spark, [])).count() == 0


def fill(sizes, weights, share, most):
    """Targets by raising the level in small closed steps: cap sources until none is above."""
    capped, budget = {}, share * sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in capped and weights.get(s, 0) > 0 and sizes[s] > 0]
        left = budget - sum(capped.values())
        level = left / sum(weights[s] for s in free) if free else 0
        over = [s for s in free if level * weights[s] > most * sizes[s]]
        if not over:
            return {s: capped.get(s, level * weights[s] if s in free else 0.0) for s in sizes}
        capped |= {s: most * sizes[s] for s in over}


def test_mix_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("source", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'hot' WHEN doc_id % 31 = 0 THEN NULL ELSE source END"))
    got = mix_sources(docs).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = fill(sizes, weights, 1.5, 2.0)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in want)
    again = mix_sources(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    rows = mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r.copies for r in got)


def test_mix_cases(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (2, None, "s"), (None, "c", None), (3, "", "empty"), (4, "w " * 100_000, "big"), (5, " \t", "empty")]
    got = {(r.doc_id, r.source, r["size"]): r for r in mix_sources(docs_of(spark, rows)).collect()}
    assert len(got) == 6 and got[4, "big", 100_000].source_size == 100_000
    assert got[3, "empty", 0].target == 0 and got[3, "empty", 0].taken == 0
    assert mix_sources(docs_of(spark, [])).count() == 0
    weights = spark.createDataFrame([("s", 1.0), ("s", 1.0), ("other", 3.0)], "source string, weight double")
    named = {r.source: r.target for r in mix_sources(docs_of(spark, rows), weights).collect()}
    assert named == {"s": 8.0, None: 0.0, "empty": 0.0, "big": 0.0}


def test_nested_budgets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    less = {r.doc_id: r.copies for r in mix_sources(docs, share=0.4).collect()}
    more = {r.doc_id: r.copies for r in mix_sources(docs, share=0.9).collect()}
    assert all(less[k] <= more[k] for k in less) and sum(less.values()) < sum(more.values())


def test_line_counts_replace_names_in_any_case(spark):
    docs = spark.createDataFrame([(1, "a\nb", "x", "y")], "doc_id long, text string, N_LINES string, N_deleted string")
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "n_deleted"] and got.collect() == [(1, "a\nb", 2, 0)]
