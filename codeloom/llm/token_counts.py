"""Token counts by pre-tokens: pieces are counted once per distinct pre-token and joined to documents."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from codeloom.llm.common import spool
from codeloom.llm.tokens import byte_letters, tokenizer_path

# Pre-tokens that the tasks know by heart: at most so many of at most LONG characters, the most frequent.
HOT = 1 << 17
# A longer pre-token hardly comes twice; it is counted where it stands and never shuffled.
LONG = 64
# Distinct pre-tokens that a task counts before it passes them on.
HELD = 500_000
OVER = 512
# The split of a byte-level BPE, with the classes of Python's ``re``; characters on which the two differ are told apart below.
BYTE_LEVEL = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

_SPLITTERS: dict[str, "Splitter"] = {}


class Splitter:
    """Pre-tokens of a text and the number of pieces of a pre-token, as one tokenizer file has them.

    ``.json`` files are read by ``tokenizers``: added tokens are cut out first (one piece each), then the
    file's own normaliser and pre-tokenizer work on what lies between. Where an added token is not plain
    (it takes blanks with it, wants whole words, or is looked for in normalised text), and for
    ``.model`` files, which ``sentencepiece`` reads, the whole text is one pre-token.
    """

    def __init__(self, path: str):
        self.added: dict[str, None] = {}
        self.whole = path.endswith(".model")
        if self.whole:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda text: len(model.encode(text))
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        added = tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or (t.normalized and tokenizer.normalizer) for t in added):
            self.whole = True
            self.count = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
            return
        self.added = {t.content: None for t in sorted(added, key=lambda t: -len(t.content))}
        self.cut = re.compile("|".join(map(re.escape, self.added)) or r"(?!)")
        self.normalizer, self.split, self.model = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.model
        import json

        with open(path, encoding="utf-8") as file:
            spec = json.load(file).get("pre_tokenizer") or {}
        self.byte_level = (
            spec.get("type") == "ByteLevel" and not spec.get("add_prefix_space") and spec.get("use_regex", True) and not self.normalizer
        )
        self.letters = byte_letters()
        self.same: set[str] = set()
        self.other: set[str] = set()

    def pieces(self, pretoken: str) -> int:
        if self.whole:
            return self.count(pretoken)
        if self.byte_level:
            pretoken = pretoken.encode().decode("latin-1").translate(self.letters)
        return len(self.model.tokenize(pretoken))

    def _slices(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.split.pre_tokenize_str(text)]

    def _plain(self, text: str) -> bool:
        """Whether the pattern cuts each character of the text as the tokenizer does; asked once a character."""
        characters = set(text)
        if not characters <= self.same:
            for c in characters - self.same - self.other:
                probe = f"a{c}1{c}!{c}{c}'{c} {c}s"
                (self.same if BYTE_LEVEL.findall(probe) == self._slices(probe) else self.other).add(c)
        return characters.isdisjoint(self.other)

    def pretokens(self, text: str) -> Iterator[list[str]]:
        """Lists of pre-tokens, without added tokens."""
        for part in self.cut.split(text) if self.added else [text]:
            if not part:
                continue
            if self.byte_level:
                yield BYTE_LEVEL.findall(part) if self._plain(part) else self._slices(part)
                continue
            if self.normalizer:
                part = self.normalizer.normalize_str(part)
            yield [p for p, _ in self.split.pre_tokenize_str(part)] if self.split else [part]

    def frequencies(self, text: str) -> tuple[int, Counter[str]]:
        """Pieces of added tokens and of long pre-tokens, and how often each other pre-token comes."""
        if self.whole or not text:
            return (self.count(text) if text else 0), Counter()
        known, found = 0, Counter()
        if self.added:
            known = sum(1 for _ in self.cut.finditer(text))
        for part in self.pretokens(text):
            found.update(part)
        for pretoken in [p for p in found if len(p) > LONG]:
            known += self.pieces(pretoken) * found.pop(pretoken)
        return known, found


def splitter(path: str) -> Splitter:
    """The worker's splitter for a tokenizer file."""
    if path not in _SPLITTERS:
        _SPLITTERS[path] = Splitter(path)
    return _SPLITTERS[path]


def piece_table(texts: DataFrame, path: str) -> DataFrame:
    """``pretoken, docs, pieces``: every distinct pre-token of the column ``text`` of up to LONG characters, tokenised once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = splitter(path)
        docs: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(docs.keys(), pa.string()), pa.array(docs.values(), pa.int64())], ["pretoken", "docs"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                docs.update(own.frequencies(text or "")[1].keys())
                if len(docs) >= HELD:
                    yield flush()
                    docs.clear()
        if docs:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = splitter(path)
        for batch in batches:
            pieces = [own.pieces(p) for p in batch.column("pretoken").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], [*batch.schema.names, "pieces"])

    distinct = texts.select("text").mapInArrow(gather, "pretoken string, docs long").groupBy("pretoken").agg(F.sum("docs").alias("docs"))
    return spool(distinct.mapInArrow(count, "pretoken string, docs long, pieces long"), "token-pieces")


def frequent(pieces: DataFrame, most: int = HOT) -> dict[str, int]:
    """Pieces of the pre-tokens that most documents have: at most ``most`` entries of at most LONG characters."""
    step = F.floor(F.log2("docs") * 8).cast("int")
    # Bounded: some 500 steps for counts up to 2**63.
    counts = sorted(((r["step"], r["count"]) for r in pieces.groupBy(step.alias("step")).count().collect()), reverse=True)
    low, total = None, 0
    for at, n in counts:
        if total + n > most:
            break
        low, total = at, total + n
    if low is None:
        return {}
    hot = pieces.where(step >= low).select("pretoken", "pieces").toArrow()
    return dict(zip(hot.column(0).to_pylist(), hot.column(1).to_pylist()))


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    over: int = OVER,
    hot: int = HOT,
) -> DataFrame:
    """One row a document: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``over`` tokens).

    A first pass gathers the distinct pre-tokens of all whole texts, each of which is tokenised once. A
    second pass counts each document's pre-tokens: those of the ``hot`` most widespread ones, which the
    tasks hold, are summed on the spot; the rest is joined with the table of pieces on the pre-token and
    summed by document. No pre-token outside the held ones is in more than a small share of the documents
    (one in ``hot`` of all occurrences), so the join has no hot key, and token ids never exist.

    Special strings in a text count as one token each, as the library has it by default; there is no
    begin, end, truncation or padding. Defined cases: null text is empty (0 bytes, 0 tokens); null and
    repeated ids and repeated rows give a row each; a very long text is held by one task; an empty table
    gives an empty result; only id and text are read.
    """
    path = tokenizer or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = piece_table(rows, path)
    held = docs.sparkSession.sparkContext.broadcast(frequent(pieces, hot))
    numbers = [StructField(n, LongType()) for n in ("place", "n_bytes", "known")]
    lists = [StructField("pretokens", ArrayType(StringType())), StructField("times", ArrayType(IntegerType()))]
    counted = StructType([numbers[0], rows.schema["id"], *numbers[1:], *lists])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pieces_of = splitter(path), held.value
        for batch in batches:
            known, cold, times = [], [], []
            for text in batch.column("text").to_pylist():
                total, found = own.frequencies(text)
                rest = [(p, n) for p, n in found.items() if p not in pieces_of]
                for pretoken, _ in rest:
                    del found[pretoken]
                known.append(total + sum(n * pieces_of[p] for p, n in found.items()))
                cold.append([p for p, _ in rest])
                times.append([n for _, n in rest])
            size = pc.binary_length(batch.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("place"), batch.column("id"), size, pa.array(known, pa.int64()),
                    pa.array(cold, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32())),
                ],
                counted.names,
            )

    placed = rows.select(F.monotonically_increasing_id().alias("place"), "id", "text")
    found = spool(placed.mapInArrow(count, counted), "token-frequencies")
    pairs = found.select("place", F.explode(F.arrays_zip("pretokens", "times")).alias("p")).select(
        "place", F.col("p.pretokens").alias("pretoken"), F.col("p.times").alias("times")
    )
    rest = pairs.join(pieces.select("pretoken", "pieces"), "pretoken").groupBy("place").agg(F.sum(F.col("times") * F.col("pieces")).alias("rest"))
    n_tokens = F.col("known") + F.coalesce("rest", F.lit(0))
    return found.join(rest, "place", "left").select(
        F.col("id").alias(id_col), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > over).alias("over_limit")
    )
