"""Set similarity join on word shingles by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.common import giving_back, join_few, key_bitmap, maybe_in, sorted_groups, spool
from codeloom.llm.shingles import COORDINATES, WORDS, minhashes, mix, set_key, shingle_set, sketch

SIMILARITY = 0.8
RECALL = 0.999
LEVELS = 4
# Buckets up to this size are compared at once; larger ones are split, or at the last level cut into
# tiles of this size that are compared two by two.
BUCKET = 256

_C = [np.uint64(c) for c in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def least_agreement(similarity: float) -> int:
    """Minhash coordinates in which the sketches of a candidate pair agree at least: four standard errors below the threshold."""
    return math.floor(COORDINATES * (similarity - 4 * math.sqrt(similarity * (1 - similarity) / COORDINATES)))


def chance_to_meet(agreement: float, similarity: float, levels: int = LEVELS) -> float:
    """Chance that two sets that agree in this share of the coordinates end in one bucket of a run.

    At each split a set goes down one sampled coordinate, and a second one with the probability that
    makes 1/similarity on average; a pair survives if it agrees on one of them.
    """
    second = 1 / similarity - 1
    p = 1.0
    for _ in range(levels):
        q = agreement * p
        p = (1 - second) * q + second * (1 - (1 - q) ** 2)
    return p


def expected_recall(runs: int, similarity: float, levels: int = LEVELS) -> float:
    """Chance that a pair of just this similarity is found in so many runs.

    All runs look at the same coordinates, so it is averaged over the number of coordinates in which a
    pair agrees; pairs that the comparison of sketches refuses count as lost.
    """
    found = 0.0
    for k in range(max(0, least_agreement(similarity)), COORDINATES + 1):
        weight = math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k)
        found += weight * (1 - (1 - chance_to_meet(k / COORDINATES, similarity, levels)) ** runs)
    return found


def runs_for(recall: float, similarity: float, levels: int = LEVELS) -> int:
    """The fewest runs with which a pair of just that similarity is found with probability ``recall``."""
    runs = 1
    while expected_recall(runs, similarity, levels) < recall:
        runs += 1
        if runs > 200:
            raise ValueError(f"a recall of {recall} is out of reach at a similarity of {similarity}")
    return runs


def sampled(parents: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates that the sets of each node go down: (row numbers of the nodes, coordinates)."""
    first = mix(parents ^ _C[0]) % np.uint64(COORDINATES)
    other = (first + np.uint64(1) + mix(parents ^ _C[1]) % np.uint64(COORDINATES - 1)) % np.uint64(COORDINATES)
    twice = (mix(parents ^ _C[2]) >> np.uint64(32)) < np.uint64(int((1 / similarity - 1) * 2**32))
    rows = np.concatenate([np.arange(len(parents)), np.flatnonzero(twice)])
    return rows, np.concatenate([first, other[twice]]).astype(np.int64)


def child(parents: np.ndarray, chosen: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Names of the nodes that sets with these minhashes in the chosen coordinates go to."""
    return mix(mix(parents * _C[3] + chosen.astype(np.uint64)) + values)


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, COORDINATES)


def shingled(docs: DataFrame, words: int, similarity: float = SIMILARITY, runs: int = 0) -> DataFrame:
    """``docs(place, id, text)`` as place, id, ``tokens`` (size of the set), ``key``, ``sketch`` and the first ``nodes`` of all runs.

    Without runs: place and ``members``, the set itself.
    """
    id_type = docs.schema["id"].dataType.simpleString()
    roots = mix(np.arange(1, runs + 1, dtype=np.uint64))
    at_root, chosen = sampled(roots, similarity)

    def described(s: np.ndarray) -> tuple:
        if not len(s):
            return 0, None, None, None
        lows = minhashes(s)
        nodes = child(roots[at_root], chosen, lows[chosen]).view(np.int64)
        return len(s), set_key(s), sketch(lows).astype("<u2").tobytes(), nodes

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, 512):
                found = [shingle_set(t.as_py(), words) for t in texts[at : at + 512]]
                places = batch.column("place")[at : at + 512]
                if not runs:
                    yield pa.RecordBatch.from_arrays([places, pa.array([s.tobytes() for s in found], pa.binary())], ["place", "members"])
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        places, batch.column("id")[at : at + 512],
                        *(pa.array(c, k) for c, k in zip(zip(*map(described, found)), (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())))),
                    ],
                    ["place", "id", "tokens", "key", "sketch", "nodes"],
                )

    kinds = f"place long, id {id_type}, tokens long, key binary, sketch binary, nodes array<long>" if runs else "place long, members binary"
    return docs.mapInArrow(giving_back(sets), kinds)


def bucket_members(reps: DataFrame, similarity: float, levels: int, bucket: int) -> DataFrame:
    """``leaf, r, n``: the buckets of two sets or more in which the chosen paths of all runs end."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parents = batch.column("node").to_numpy().view(np.uint64)
                rows, chosen = sampled(parents, similarity)
                values = _sketches(batch.column("sketch"))[rows, chosen].astype(np.uint64)
                nodes = child(parents[rows], chosen, values)
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), batch.column("r").take(pa.array(rows))], ["node", "r"])

    nodes = reps.select("r", F.explode("nodes").alias("node"))
    found = None
    for level in range(1, levels + 1):
        sizes = spool(nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "near-sizes")
        members = nodes.join(sizes, "node")
        ended = members if level == levels else members.where(F.col("n") <= bucket)
        ended = ended.select(F.col("node").alias("leaf"), "r", "n")
        found = ended if found is None else found.unionByName(ended)
        if level == levels or sizes.where(F.col("n") > bucket).isEmpty():
            break
        large = members.where(F.col("n") > bucket).join(reps.select("r", "sketch"), "r")
        nodes = spool(large.select("node", "r", "sketch").mapInArrow(giving_back(split), "node long, r long"), "near-nodes")
    return found


def merged_buckets(leaves: DataFrame, bucket: int, rounds: int = 3) -> DataFrame:
    """``leaves`` with large buckets of nearly the same sets put together, where that means fewer pairs to compare.

    Near copies of one text meet in almost every run, and each of these buckets would be cut into tiles of its own.
    Buckets that share their first set, in an order by hash that is another each round, become one if the square of its
    size is no more than the sum of theirs. Two sets that shared a bucket still do, so no pair is lost.
    """
    large = leaves.where(F.col("n") > bucket)
    if large.isEmpty():
        return leaves
    for number in range(rounds):
        heads = large.groupBy("leaf").agg(F.min_by("r", F.xxhash64("r", F.lit(number))).alias("head"), F.first("n").alias("n"))
        heads = spool(heads, "near-heads")
        alike = heads.groupBy("head").agg(F.min("leaf").alias("into"), F.sum(F.col("n") * F.col("n")).alias("pairs"), F.count("*").alias("of")).where("of > 1")
        named = spool(heads.join(alike, "head").select("leaf", "into", "pairs"), "near-alike")
        if named.isEmpty():
            continue
        union = spool(large.join(named, "leaf").select(F.col("into").alias("leaf"), "r", "pairs").distinct(), "near-union")
        sizes = union.groupBy("leaf").agg(F.count("*").alias("n"), F.first("pairs").alias("pairs")).where(F.col("n") * F.col("n") <= F.col("pairs"))
        sizes = spool(sizes.select("leaf", "n"), "near-sizes")
        gone = named.join(sizes.select(F.col("leaf").alias("into")), "into", "left_semi").select("leaf")
        large = spool(large.join(gone, "leaf", "left_anti").unionByName(union.select("leaf", "r").join(sizes, "leaf")), "near-leaves")
    return leaves.where(F.col("n") <= bucket).unionByName(large)


def compared(groups: Iterator[tuple[np.ndarray, dict[str, np.ndarray]]], similarity: float):
    """For each bucket tile: its rows and the matrix of candidate pairs that belong to this bucket.

    A pair is a candidate if sizes and sketches allow the similarity (four standard errors below
    it), and belongs to the smallest bucket in which both sets are, so each pair counts once.
    """
    least = least_agreement(similarity)
    for leaf, g in groups:
        n = len(g["r"])
        agree = np.zeros((n, n), np.uint8)
        for c in range(COORDINATES):
            column = g["sketch"][:, c]
            agree += column[:, None] == column[None, :]
        tokens = g["tokens"].astype(float)
        near = np.minimum.outer(tokens, tokens) >= similarity * np.maximum.outer(tokens, tokens) - 1e-9
        pairs = near & (agree >= least) & (g["r"][:, None] < g["r"][None, :])
        if g["across"]:
            pairs &= g["tile"][:, None] != g["tile"][None, :]
        left, right = np.nonzero(pairs)
        for at in range(0, len(left), 1 << 14):
            a, b = left[at : at + (1 << 14)], right[at : at + (1 << 14)]
            la, lb = g["leaves"][a], g["leaves"][b]
            common = (la[:, :, None] == lb[:, None, :]).any(axis=2) & (la < leaf)
            gone = common.any(axis=1)
            pairs[a[gone], b[gone]] = False
        yield g, pairs


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
    """Rows sorted by (leaf, a, b) as the arrays of one tile at a time."""
    top = np.iinfo(np.int64).max
    for table in sorted_groups(batches, ["leaf", "a", "b"]):
        lists = table.column("leaves").to_pylist()
        width = max(map(len, lists))
        yield table.column("leaf")[0].as_py(), {
            "table": table,
            "r": table.column("r").to_numpy(),
            "tile": table.column("tile").to_numpy(),
            "across": table.column("a")[0].as_py() != table.column("b")[0].as_py(),
            "tokens": table.column("tokens").to_numpy(),
            "sketch": _sketches(table.column("sketch")),
            "leaves": np.array([[*v, *[top] * (width - len(v))] for v in lists], np.int64),
        }


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: a product of membership tables, a stretch of shingles at a time."""
    flat = np.concatenate(sets)
    names, code = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    for low in range(0, len(names), 8192):
        i, j = np.searchsorted(code, [low, low + 8192])
        table = np.zeros((len(sets), min(8192, len(names) - low)), np.float32)
        table[row[i:j], code[i:j] - low] = 1
        out += (table @ table.T).astype(np.int64)
    return out


def similar_sets(reps: DataFrame, texts: DataFrame, similarity: float, words: int, levels: int, bucket: int) -> DataFrame:
    """``r, root, links``: for each set and bucket tile with a verified pair, the smallest set it hangs together with there and its number of pairs."""
    leaves = merged_buckets(spool(bucket_members(reps, similarity, levels, bucket), "near-leaves"), bucket)
    per_set = leaves.groupBy("r").agg(F.collect_list(F.struct("leaf", "n")).alias("at"))
    tiles = F.ceil(F.col("at_one.n") / bucket).cast("int")
    placed = (
        per_set.join(reps.select("r", "tokens", "sketch"), "r")
        .select("r", "tokens", "sketch", F.transform("at", lambda x: x["leaf"]).alias("leaves"), F.explode("at").alias("at_one"))
        .select("*", F.pmod(F.xxhash64("r"), tiles).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
        .select(
            F.col("at_one.leaf").alias("leaf"), F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"),
            "tile", "r", "tokens", "sketch", "leaves",
        )
    )
    grouped = placed.repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b", "r")

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, pairs in compared(_tiles(batches), similarity):
            use = pairs.any(axis=0) | pairs.any(axis=1)
            if use.any():
                yield from g["table"].filter(pa.array(use)).combine_chunks().to_batches()

    needed = spool(grouped.mapInArrow(giving_back(promising), grouped.schema), "near-needed")
    wanted = spool(needed.select("r").distinct(), "near-wanted").withColumnRenamed("r", "place")
    sets = shingled(
        maybe_in(texts, "place", key_bitmap(wanted, "place")).join(wanted, "place", "left_semi").select("place", "id", "text"), words
    ).withColumnRenamed("place", "r")
    loaded = needed.join(sets, "r").repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b", "r")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, pairs in compared(_tiles(batches), similarity):
            n = g["tokens"]
            common = intersections([np.frombuffer(m, np.uint64) for m in g["table"].column("members").to_pylist()])
            links = pairs & (common >= similarity * (n[:, None] + n[None, :] - common) - 1e-9)
            links |= links.T
            use = np.flatnonzero(links.any(axis=1))
            if not len(use):
                continue
            root = g["r"].copy()
            while True:
                lower = np.minimum(root, np.where(links, root[None, :], np.iinfo(np.int64).max).min(axis=1))
                if (lower == root).all():
                    break
                root = lower
            yield pa.RecordBatch.from_arrays(
                [pa.array(g["r"][use]), pa.array(root[use]), pa.array(links[use].sum(axis=1).astype(np.int64))], ["r", "root", "links"]
            )

    return spool(loaded.mapInArrow(giving_back(verified), "r long, root long, links long"), "near-links")


def components(edges: DataFrame) -> DataFrame:
    """``u, c``: smallest node that each node of ``edges(u, v)`` is connected with, by minimum and pointer jumping."""
    both = spool(edges.where("u <> v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "near-edges")
    labels = spool(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")), "near-labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
        seen = both.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("c"))
        lower = spool(labels.unionByName(seen).groupBy("u").agg(F.min("c").alias("c")), "near-labels")
        jump = lower.select(F.col("u").alias("c"), F.col("c").alias("cc"))
        labels = spool(lower.join(jump, "c", "left").select("u", F.coalesce("cc", "c").alias("c")), "near-labels")


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    words: int = WORDS,
    recall: float = RECALL,
    levels: int = LEVELS,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per input row: id, ``class_id``, ``kept``, ``copies``, ``links``, ``place``.

    Texts are sets of shingles of ``words`` lower-cased words. ``copies`` is the number of rows with
    the same set (with this one); ``links`` the number of *other* sets with a Jaccard similarity of
    ``similarity`` or more; classes are the connected components of these links; ``class_id`` is the
    smallest id of a class and ``kept`` marks its row. ``place`` is the row's number in scan order.

    Chosen-path join: sets start in one bucket a run, and buckets above ``bucket`` sets are split
    on sampled minhash coordinates (shared tokens) that all sets of a bucket agree to look at.
    Small buckets are compared by brute force: sketches first, then the whole sets. Runs are
    repeated until a pair at the threshold has met with probability ``recall``; closer pairs meet
    more surely. Every pair found is verified on whole shingle sets and counted in one bucket only.

    Rows with equal sets are one set from the start. A bucket that cannot be split (near copies of
    one text) is cut into tiles, and each pair of tiles is one unit of work, so no task holds more
    than two tiles; tasks return sums and a root for each set, never pairs. Only sketches of sets in
    shared buckets and texts with a promising partner are shuffled.

    Defined cases: null and wordless texts form classes of their own with 0 links; texts of fewer
    than ``words`` words are one shingle; null ids come last; repeated rows are copies, the first
    in scan order is kept; an empty table gives an empty result; only id and text are read.
    ``docs`` must be deterministic (a table or files), as its texts are read twice.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("place"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = spool(shingled(texts, words, similarity, runs_for(recall, similarity, levels)), "near-sets")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "place")
    reps = spool(
        rows.where("key IS NOT NULL").groupBy("key")
        .agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes"))
        .select("key", F.col("first.place").alias("r"), F.col("first.id").alias("id"), "copies", "tokens", "sketch", "nodes"),
        "near-reps",
    )
    found = similar_sets(reps, texts, similarity, words, levels, bucket)
    counts = found.groupBy("r").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("r").alias("u"), F.col("root").alias("v")))
    classes = (
        reps.select("key", "r", "id", "copies").join(counts, "r", "left").join(labels.withColumnRenamed("u", "r"), "r", "left")
        .select("key", "r", "id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("c", "r").alias("c"))
    )
    classes = spool(classes, "near-classes")
    heads = spool(
        classes.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "r")).alias("h")).select("c", F.col("h.id").alias("class_id"), F.col("h.r").alias("class_place")),
        "near-heads",
    )
    named = spool(classes.join(heads, "c").select("key", "copies", "links", "class_id", "class_place"), "near-named")
    joined = rows.select("place", "id", F.col("key").alias("k")).join(named, F.col("k") == F.col("key"), "left")
    alone = F.col("key").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        (alone | (F.col("place") == F.col("class_place"))).alias("kept"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        "place",
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of ``jaccard_classes``, all columns passed through.

    Cases are those of ``jaccard_classes``: null and wordless texts are classes of their own, of rows with
    equal ids or null ids one of a class stays, an empty table gives no rows. ``docs`` is read twice and must be
    deterministic.
    """
    dropped = spool(jaccard_classes(docs, id_col, text_col, **options).where(~F.col("kept")).select("place"), "near-dropped")
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place"))
    return join_few(rows, dropped, "place", "left_anti").select("row.*")
