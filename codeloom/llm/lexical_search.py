"""Ranked lexical search: exact top k of a query set over all documents, by a trie of restricted term vectors."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from codeloom.llm.common import spool

# A maximal run of characters that are ASCII letters, digits or beyond ASCII, as UTF-8 bytes in lower case (A to Z only).
TERM = re.compile(rb"[0-9a-z\x80-\xFF]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
TOP = 10
# A trie is built over so many documents of a task, or so many of their terms; a node with LEAF documents or fewer is not split.
TRIE_DOCS = 16_384
TRIE_TERMS = 1 << 19
LEAF = 64
# Items searched in one pass have about so many terms in all, or one item has more.
PASS_TERMS = 1 << 18


def term_counts(text: str | None) -> Counter[bytes]:
    """How often each term of a text comes; null has none."""
    return Counter(TERM.findall((text or "").encode().translate(LOWER)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term with weight 1 adds to a document's score; grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item, size, terms, times``: the different terms of each item."""
    schema = StructType([StructField("item", items.schema[item_col].dataType), StructField("term", items.schema[text_col].dataType), StructField("times", LongType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t.decode(), n) for i, text in enumerate(batch.column("text").to_pylist()) for t, n in term_counts(text).items()]
            at = pa.array([i for i, _, _ in found], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(at), pa.array([t for _, t, _ in found], pa.string()), pa.array([n for _, _, n in found], pa.int64())],
                ["item", "term", "times"],
            )

    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).mapInArrow(split, schema)
    merged = rows.groupBy("item", "term").agg(F.sum("times").alias("times"))
    listed = F.sort_array(F.collect_list(F.struct("term", "times"))).alias("v")
    by_item = merged.groupBy("item").agg(listed)
    return by_item.select("item", F.size("v").alias("size"), F.col("v.term").alias("terms"), F.col("v.times").alias("times"))


@dataclass(frozen=True)
class Vectors:
    """Documents over a pass's terms (``place, id, m, codes, tfs``), and the code and weight of each term that is in one."""

    rows: DataFrame
    weights: dict[str, tuple[int, int]]


def restricted(docs: DataFrame, vocabulary: list[str]) -> Vectors:
    """``docs`` (id, text) as vectors over ``vocabulary``; ``codes`` number the terms by descending document frequency.

    The vocabulary is that of one pass, so the tasks may hold it. Whole texts are read once; all else
    works on the restricted vectors. Documents without one of the terms count in N and L only.
    """
    spark = docs.sparkSession
    place_of = spark.sparkContext.broadcast({t.encode(): i for i, t in enumerate(vocabulary)})
    numbers = StructField("place", LongType()), docs.schema["id"], StructField("n", LongType())
    lists = [StructField(c, ArrayType(IntegerType())) for c in ("terms", "tfs")]

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = place_of.value
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                counts = term_counts(text)
                sizes.append(counts.total())
                own = [(places[t], n) for t, n in counts.items() if t in places]
                terms.append([t for t, _ in own])
                tfs.append([n for _, n in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                ["place", "id", "n", "terms", "tfs"],
            )

    placed = docs.select(F.monotonically_increasing_id().alias("place"), "id", "text")
    found = spool(placed.mapInArrow(restrict, StructType([*numbers, *lists])), "search-terms")
    all_docs = found.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    # Bounded by the vocabulary of a pass.
    df = {r["term"]: r["df"] for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    order = sorted(df, key=lambda t: (-df[t], vocabulary[t]))
    weights = {
        vocabulary[t]: (code, math.floor(1000 * math.log((2 * all_docs["N"] + 2) / (2 * df[t] + 1)))) for code, t in enumerate(order)
    }
    ranks = np.zeros(len(vocabulary), np.int32)
    ranks[order] = np.arange(len(order), dtype=np.int32)
    code_of = spark.sparkContext.broadcast(ranks)

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, tfs = batch.column("terms"), batch.column("tfs")
            starts = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())]).astype(np.int32)
            codes = code_of.value[terms.flatten().to_numpy()]
            by_doc = np.lexsort([codes, np.repeat(np.arange(batch.num_rows), np.diff(starts))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("place"), batch.column("id"), batch.column("m"),
                    pa.ListArray.from_arrays(starts, codes[by_doc]), pa.ListArray.from_arrays(starts, tfs.flatten().to_numpy()[by_doc]),
                ],
                ["place", "id", "m", "codes", "tfs"],
            )

    m = F.lit(25) + F.expr(f"(75 * n * {all_docs['N']}L) div {max(1, all_docs['L'])}L")
    some = found.where(F.size("terms") > 0).select("place", "id", m.alias("m"), "terms", "tfs")
    coded = [StructField("m", LongType()), *(StructField(c, ArrayType(IntegerType())) for c in ("codes", "tfs"))]
    rows = spool(some.mapInArrow(recode, StructType([*numbers[:2], *coded])), "search-vectors")
    # Ties of the range go by place, so that equal vectors do not meet in one task.
    tie = F.xxhash64("place")
    return Vectors(spool(rows.repartitionByRange("codes", tie, "place").sortWithinPartitions("codes", tie, "place"), "search-ordered"), weights)


class Trie:
    """Documents in the order of their vectors; a node is a stretch of them that shares a path of terms.

    ``first`` and ``last`` are a node's documents, ``after`` the number of the next node that is not below it
    (nodes are in depth-first order). ``bound`` holds for each term, and each node with the term below it, the
    impact of the largest tf with the smallest m there: no document below has more. Runs of small
    sub-trees under one parent are one node, and a node of ``LEAF`` documents or fewer has none below it.
    """

    def __init__(self, starts: np.ndarray, codes: np.ndarray, tf: np.ndarray, m: np.ndarray):
        self.starts = starts
        self.known, self.at = np.unique(codes, return_inverse=True)
        sizes = np.diff(starts)
        self.impacts = impact(tf, np.repeat(m, sizes))
        self.first: list[int] = []
        self.last: list[int] = []
        self.after: list[int] = []
        self._split(codes, sizes)
        own, there, values = [], [], []
        for node, (a, b) in enumerate(zip(self.first, self.last)):
            here = slice(starts[a], starts[b])
            most = np.zeros(len(self.known), np.int64)
            np.maximum.at(most, self.at[here], tf[here])
            own.append(np.flatnonzero(most))
            there.append(np.full(len(own[-1]), node))
            values.append(impact(most[own[-1]], m[a:b].min()))
        terms = np.concatenate(own)
        by_term = np.argsort(terms, kind="stable")
        self.nodes, self.bound = np.concatenate(there)[by_term], np.concatenate(values)[by_term]
        self.term_starts = np.searchsorted(terms[by_term], np.arange(len(self.known) + 1))

    def _split(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        def node(first: int, last: int) -> int:
            self.first.append(first)
            self.last.append(last)
            self.after.append(len(self.first))
            return len(self.first) - 1

        # Nodes to open, the next in order on top; with -1 a node whose sub-tree is complete.
        todo: list[tuple[int, int, int]] = [(0, len(sizes), 0)]
        while todo:
            first, last, depth = todo.pop()
            if depth < 0:
                self.after[first] = len(self.first)
                continue
            here = node(first, last)
            if last - first <= LEAF:
                continue
            while True:
                # Vectors that end here come first, as in any lexicographic order.
                long = sizes[first:last] > depth
                if not long.any():
                    break
                term = np.where(long, codes[np.minimum(self.starts[first:last] + depth, len(codes) - 1)], -1)
                cuts = np.flatnonzero(np.diff(term)) + 1
                if len(cuts):
                    break
                depth += 1
            if not long.any():
                # Equal vectors: no term tells them apart, so they are cut by number.
                cuts = np.arange(LEAF, last - first, LEAF)
            edges = [first, *(first + cuts).tolist(), last]
            runs: list[tuple[int, int, bool]] = []
            for a, b in zip(edges, edges[1:]):
                if runs and runs[-1][1] - runs[-1][0] + b - a <= LEAF:
                    runs[-1] = (runs[-1][0], b, False)
                else:
                    runs.append((a, b, True))
            todo.append((here, 0, -1))
            todo.extend((a, b, depth + 1 if one else depth) for a, b, one in reversed(runs))

    def search(self, codes: np.ndarray, weights: np.ndarray, ids: np.ndarray, top: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
        """``top`` (score, place in ``ids`` order) with the documents of this trie; depth first, the better children first."""
        here = np.searchsorted(self.known, codes)
        there = here < len(self.known)
        there[there] = self.known[here[there]] == codes[there]
        if not there.any():
            return top
        bounds = np.zeros(len(self.first), np.int64)
        for term, weight in zip(here[there].tolist(), weights[there].tolist()):
            part = slice(self.term_starts[term], self.term_starts[term + 1])
            bounds[self.nodes[part]] += weight * self.bound[part]
        own = np.zeros(len(self.known), np.int64)
        own[here[there]] = weights[there]
        stack = [0]
        while stack:
            node = stack.pop()
            low = top[-1][0] if len(top) == most else 1
            if bounds[node] < low:
                continue
            if self.after[node] == node + 1:
                a, b = self.first[node], self.last[node]
                part = slice(self.starts[a], self.starts[b])
                scores = np.add.reduceat(own[self.at[part]] * self.impacts[part], self.starts[a:b] - self.starts[a])
                better = np.flatnonzero(scores >= low)
                if len(better):
                    new = [(int(scores[i]), ids[a + i]) for i in better]
                    top = sorted([*top, *new], key=lambda t: (-t[0], t[1]))[:most]
                continue
            child, children = node + 1, []
            while child < self.after[node]:
                children.append(child)
                child = self.after[child]
            stack.extend(sorted(children, key=lambda c: (bounds[c], -c)))
        return top


def best_of_tasks(vectors: DataFrame, by_item: list[tuple[np.ndarray, np.ndarray]], top: int) -> DataFrame:
    """``item_at, score, place, id``: the ``top`` best documents of each task for each item (codes, weights)."""
    id_kind = vectors.schema["id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: list[list] = [[] for _ in by_item]
        kind = None

        def chunk(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts).combine_chunks()
            codes, tfs = (table.column(c).combine_chunks() for c in ("codes", "tfs"))
            sizes = codes.value_lengths().to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            # Equal scores go by id, no id last, then by place.
            names = [(i is None, i if i is not None else 0, p) for i, p in zip(table.column("id").to_pylist(), table.column("place").to_pylist())]
            trie = Trie(starts, codes.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64), table.column("m").to_numpy())
            for item, (own, weights) in enumerate(by_item):
                tops[item] = trie.search(own, weights, names, tops[item], top)

        held, docs, size = [], 0, 0
        for batch in batches:
            kind = batch.schema.field("id").type
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                docs, size = docs + part.num_rows, size + len(part.column("codes").flatten())
                if docs >= TRIE_DOCS or size >= TRIE_TERMS:
                    chunk(held)
                    held, docs, size = [], 0, 0
        if held:
            chunk(held)
        rows = [(item, score, place, None if none else key) for item, found in enumerate(tops) for score, (none, key, place) in found]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], kind)],
                ["item_at", "score", "place", "id"],
            )

    return vectors.mapInArrow(search, f"item_at int, score long, place long, id {id_kind}")


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each item, exact.

    Terms, weights and scores are integers as defined in ``restricted`` and ``impact``: an item's score of a
    document is the sum over its terms, repeats included, of weight times impact. Only scores above 0 count.

    Documents are reduced to the terms of the items, range-partitioned in the order of their vectors, and put
    into tries of a bounded size, where documents with the same frequent terms share their path. Each node's
    largest tf and smallest m bound the scores below it; every item is searched depth first, better children
    first, and sub-trees that cannot reach its ``top`` best so far (over all tries of the task) are left out. A
    task returns ``top`` rows an item. Equal vectors, such as copies, are spread by their place.

    Items are taken in passes of about 262,144 terms, of which the driver and the tasks hold one at a time;
    each pass reads the texts once. Defined
    cases: null texts, and texts without terms, are never found and are not counted; equal scores go to the
    smaller id, no id last, and then by scan order; repeated rows of documents count and are listed each;
    rows of one item id (null too) are one item; items without a hit have no rows; empty tables give an empty result; other
    columns are not read. A document's whole text is one row of one task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = spool(item_terms(items, item_col, item_text), "search-items")
    kinds = [items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()]
    found = spark.createDataFrame([], f"item {kinds[0]}, rank int, id {kinds[1]}, score long")
    passes = -(-int(asked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) // PASS_TERMS)
    for number in range(passes):
        # The driver holds the items of one pass at a time.
        now = asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).collect()
        if not now:
            continue
        vectors = restricted(rows, sorted({t for r in now for t in r["terms"]}))
        by_item = []
        for r in now:
            own = sorted((*vectors.weights[t], n) for t, n in zip(r["terms"], r["times"]) if t in vectors.weights)
            by_item.append((np.array([c for c, _, _ in own], np.int64), np.array([w * n for _, w, n in own], np.int64)))
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(now)], f"item_at int, item {kinds[0]}")
        place = F.row_number().over(Window.partitionBy("item_at").orderBy(F.desc("score"), F.col("id").isNull(), "id", "place"))
        best = best_of_tasks(vectors.rows, by_item, top).withColumn("rank", place).where(F.col("rank") <= top)
        found = found.unionByName(spool(best.join(F.broadcast(names), "item_at").select("item", "rank", "id", "score"), "search-found"))
    return found.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
