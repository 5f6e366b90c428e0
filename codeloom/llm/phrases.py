"""Phrase collocations by Toivonen's method: a sample proposes, full passes count, until the border is closed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codeloom.llm.common import spool

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
# The sample holds this share of the documents; a phrase is proposed by this share of its expected count there.
SAMPLE = 8
LOWERED = 0.5
# A task counts so many bytes of text at a time.
CHUNK = 1 << 19
# Phrases that may be extended are kept as a bitmap of 2**27 bits: 4,096 pages of 4 KB, 16 MB whatever the input.
PAGES = 4096
PAGE_BITS = 32768
BITS = PAGES * PAGE_BITS
# Where the place in a bitmap begins in a 64-bit hash: it is the highest bits.
SHIFT = 64 - 27
# A sieve counts the upper 32 bits of hashes, in pages by the highest ten. A hash in its page stands above so many bits of count.
LOW_BITS = 22
COUNT_BITS = 64 - LOW_BITS
# Hashes that a task of a sieve holds before it sums them.
HELD = 1 << 23
# Lanes in which a language's report is ranked first.
LANES = 16
# A pass counts extensions of any length if border failures set at most this share of the bits that were set before.
FEW = 1 / 64

# Bytes of a text: 0 in words, 1 between words, 2 between pieces; upper case as lower case.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CUT = re.compile(rb"[.,;:!?\x0A-\x0D\x20\x09]")
_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes:
    """Two 64-bit hashes of any stretch of a byte string, from sums of its prefixes."""

    powers: list[np.ndarray] = []

    @classmethod
    def _upto(cls, n: int) -> list[np.ndarray]:
        if not cls.powers or len(cls.powers[0]) < n:
            n = 1 << n.bit_length()

            def powers(base: int) -> np.ndarray:
                out = np.full(n, base, np.uint64)
                out[0] = 1
                return np.multiply.accumulate(out)

            cls.powers = [powers(b) for base in _BASES.tolist() for b in (base, pow(base, -1, 1 << 64))]
        return cls.powers

    def __init__(self, data: np.ndarray, seed: int):
        ups = self._upto(max(1, len(data)))
        self.seed = np.uint64(seed)
        self.down = ups[1::2]
        values = data.astype(np.uint64) + np.uint64(1)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(data)], dtype=np.uint64)]) for up in ups[::2]]

    def of(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        total = self.sums[which]
        return _mix((total[ends] - total[starts]) * self.down[which][starts] + (ends - starts).astype(np.uint64) + self.seed)


def _seed(lang: str) -> int:
    data = np.frombuffer(lang.encode(), np.uint8)
    return int(_Hashes(data, 0).of(np.array([0]), np.array([len(data)]))[0])


def _in(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(SHIFT)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def segments(data: bytes, most: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """A long text in parts of about ``most`` bytes, each with the number of words at its start that are the last of the part before."""
    at = carried = end = 0
    while True:
        found = _CUT.search(data, max(at + most, end + 1)) if at + most < len(data) else None
        end = found.start() if found else len(data)
        yield data[at:end], carried
        if end == len(data):
            return
        # The words a phrase can reach back to; where a piece ends in between, the cut there still parts them.
        back, carried = end, 0
        while carried < LONGEST - 1 and back > at:
            while back > at and _CLASS[data[back - 1]]:
                back -= 1
            if back == at:
                break
            while back > at and not _CLASS[data[back - 1]]:
                back -= 1
            carried += 1
        at = back if carried else end


class _Words:
    """The words of a lower-cased text with one space between them: ``number`` of them, the hashes and places of any stretch."""

    def __init__(self, data: bytes, lang: str):
        raw = np.frombuffer(data, np.uint8)
        kind = _CLASS[raw]
        edges = np.flatnonzero(np.diff((kind == 0).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        first, last = edges[::2], edges[1::2]
        self.number = len(first)
        if not self.number:
            return
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[first]
        size = last - first
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        joined = np.full(int(self.ends[-1]), 0x20, np.uint8)
        inside = np.zeros(int(self.ends[-1]) + 1, np.int8)
        inside[self.starts], inside[self.ends] = 1, -1
        joined[np.cumsum(inside[:-1], dtype=np.int8) == 1] = raw[kind == 0]
        self.hashes = _Hashes(joined, _seed(lang))
        self.text = joined.tobytes()

    def of(self, at: np.ndarray, k: int, which: int = 0) -> np.ndarray:
        """Hashes of the ``k`` words from each place on."""
        return self.hashes.of(self.starts[at], self.ends[at + k - 1], which)


def _reached(
    words: _Words, carried: int, now: np.ndarray | None, before: np.ndarray | None, longest: int, onwards: bool, passed: np.ndarray | None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of words the places and hashes of the phrases to count, see ``count_phrases``."""
    if not words.number:
        return

    def fresh(at: np.ndarray, keys: np.ndarray, k: int) -> tuple[int, np.ndarray, np.ndarray]:
        new = at + k > carried
        return k, at[new], keys[new]

    at, reached = np.arange(words.number), np.ones(words.number, bool)
    keys = words.of(at, 1)
    if before is None:
        few = slice(None) if passed is None else _in(passed, keys)
        yield fresh(at[few], keys[few], 1)
    counted = np.zeros(0, np.int64)
    for k in range(2, longest + 1):
        # Which phrases of k - 1 words, by their first word, may be extended.
        grown, old = np.zeros(words.number + 1, bool), np.zeros(words.number + 1, bool)
        if now is None:
            grown[at] = True
        else:
            grown[at] = _in(now, keys)
            if before is not None:
                old[at] = reached & _in(before, keys)
            grown[counted] = True
        at = np.flatnonzero(grown[:-1] & grown[1:])
        at = at[at + k <= words.number]
        at = at[words.piece[at] == words.piece[at + k - 1]]
        keys = words.of(at, k)
        # What the pass with ``before`` reached and counted.
        reached = old[at] & old[at + 1]
        few = ~reached if passed is None else ~reached & _in(passed, keys)
        yield fresh(at[few], keys[few], k)
        if onwards:
            counted = at[few]


def count_phrases(
    data: bytes, lang: str, carried: int, now: np.ndarray | None, before: np.ndarray | None, longest: int = LONGEST, onwards: bool = False,
    passed: np.ndarray | None = None,
) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Phrases of a lower-cased text (space-joined), their number of words, and how often each comes.

    A phrase of two words or more counts if both phrases that lack one end word are in the bitmap ``now``
    and not both in ``before``, which an earlier pass had as its ``now``; ``onwards`` takes phrases counted
    here like those in ``now``, so their extensions count too. Without ``now`` all phrases
    up to ``longest`` words count; with ``before``, words do not. With ``passed``, only what is in that bitmap
    counts. Phrases that end in the first
    ``carried`` words are left out. The empty phrase stands for the number of all words.
    """
    words = _Words(data, lang)
    phrases, lengths, counts = [b""], [np.zeros(1, np.int32)], [np.array([max(0, words.number - carried)])]
    for k, at, keys in _reached(words, carried, now, before, longest, onwards, passed):
        if not len(at):
            continue
        checks = words.of(at, k, 1)
        order = np.argsort(keys, kind="stable")
        keys, checks, at = keys[order], checks[order], at[order]
        cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])]))
        phrases.extend([words.text[a:b] for a, b in zip(words.starts[at[cut]].tolist(), words.ends[at[cut] + k - 1].tolist())])
        lengths.append(np.full(len(cut), k, np.int32))
        counts.append(np.diff(np.concatenate([cut, [len(at)]])))
    return phrases, np.concatenate(lengths), np.concatenate(counts)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, str, int]]:
    """Lower-cased texts of one language, about ``CHUNK`` bytes at a time, and how many words at their start are known."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            data = text.as_py().encode().translate(_LOWER)
            if len(data) > CHUNK:
                for part, carried in segments(data):
                    yield part, lang, carried
                continue
            held.setdefault(lang, []).append(data)
            size += len(data)
            if size >= CHUNK:
                for own, texts in held.items():
                    yield b"\n".join(texts), own, 0
                held, size = {}, 0
    for own, texts in held.items():
        yield b"\n".join(texts), own, 0


def phrase_counts(docs: DataFrame, now=None, before=None, longest: int = LONGEST, onwards: bool = False, passed=None) -> DataFrame:
    """``lang, phrase, words, n`` of ``docs`` (lang, text); ``now``, ``before`` and ``passed`` are broadcast bitmaps, see ``count_phrases``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = now and now.value, before and before.value, longest, onwards, passed and passed.value
        for data, lang, carried in _chunks(batches):
            phrases, words, times = count_phrases(data, lang, carried, *bitmaps)
            for at in range(0, len(phrases), 100_000):
                part = pa.array(phrases[at : at + 100_000], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), part, pa.array(words[at : at + len(part)]), pa.array(times[at : at + len(part)], pa.int64())],
                    ["lang", "phrase", "words", "n"],
                )

    found = docs.select("lang", "text").mapInArrow(count, "lang string, phrase string, words int, n long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def _packed(hashes: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Pages of 32-bit hashes and, for each, the steps between its different hashes and their counts, byte by byte of the numbers."""
    hashes = np.sort(hashes)
    cut = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    hashes, counts = hashes[cut], np.diff(np.concatenate([cut, [len(hashes)]]))
    page, low = hashes >> np.uint32(LOW_BITS), hashes & np.uint32((1 << LOW_BITS) - 1)
    heads = np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]]))
    steps = np.diff(low, prepend=np.uint32(0))
    steps[heads] = low[heads]
    both = np.stack([steps, counts]).astype("<u4").view(np.uint8).reshape(2, len(low), 4).transpose(0, 2, 1)
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(low)]):
        yield int(page[a]), both[:, :, a:b].tobytes()


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Numbers of a page, each its hash above ``COUNT_BITS`` bits of count, with one a hash."""
    numbers = np.sort(np.concatenate(parts))
    keys = numbers >> np.uint64(COUNT_BITS)
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[cut] << np.uint64(COUNT_BITS)) + np.add.reduceat(numbers & np.uint64((1 << COUNT_BITS) - 1), cut)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(2, 4, -1)
    steps, counts = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[:, :, 0]
    return (np.cumsum(steps, dtype=np.uint64) << np.uint64(COUNT_BITS)) + counts.astype(np.uint64)


def sieve(docs: DataFrame, least: int, now=None, before=None, longest: int = LONGEST, onwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of all words, and of all longer phrases, that ``phrase_counts`` with these arguments finds ``least`` times or more.

    Occurrences are counted by 32 bits of their hash, so no phrase is lost; others pass that share their
    bits with a frequent one. A task sends each of its hashes once, as the step from the one before and a count:
    some three bytes instead of the phrase. Counts are summed by pages of 2**22 hashes, which bounds what a task holds.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = now and now.value, before and before.value, longest, onwards, None
        held: tuple[list, list] = [], []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(own * (1 << 32 - LOW_BITS) + page, data) for own in (0, 1) if held[own] for page, data in _packed(np.concatenate(held[own]))]
            for own in held:
                own.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["page", "data"])

        for data, lang, carried in _chunks(batches):
            for k, at, keys in _reached(_Words(data, lang), carried, *bitmaps):
                if len(at):
                    held[k > 1].append((keys >> np.uint64(32)).astype(np.uint32))
                    size += len(at)
            if size >= HELD:
                yield flush()
                size = 0
        if size:
            yield flush()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held, size = None, [], 0

        def bits() -> pa.RecordBatch:
            numbers = _summed(held)
            often = numbers[(numbers & np.uint64((1 << COUNT_BITS) - 1)) >= least] >> np.uint64(COUNT_BITS)
            marks = np.zeros(BITS >> 32 - LOW_BITS, bool)
            marks[(often >> np.uint64(SHIFT - 32)).astype(np.int64)] = True
            found = [(page, np.packbits(marks, bitorder="little").tobytes())] if len(often) else []
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], ["page", "bits"])

        for batch in batches:
            for number, data in zip(batch.column("page").to_pylist(), batch.column("data")):
                if held and number != page:
                    yield bits()
                    held, size = [], 0
                page = number
                held.append(_unpacked(data.as_py()))
                size += len(held[-1])
                if size >= HELD:
                    held = [_summed(held)]
                    size = 0
        if held:
            yield bits()

    counted = docs.select("lang", "text").mapInArrow(hashed, "page int, data binary").repartition("page").sortWithinPartitions("page")
    bitmaps = np.zeros((2 << 32 - LOW_BITS, (BITS >> 32 - LOW_BITS) // 8), np.uint8)
    # Bounded: at most two bitmaps of 16 MB.
    for batch in counted.mapInArrow(kept, "page int, bits binary").toArrow().to_batches():
        for page, bits in zip(batch.column("page").to_pylist(), batch.column("bits")):
            bitmaps[page] = np.frombuffer(bits.as_buffer(), np.uint8)
    words, longer = bitmaps.reshape(2, -1)
    return words, longer


def extendable(phrases: DataFrame) -> np.ndarray:
    """Bitmap of the hashes of ``phrases`` (lang, phrase, words) that are short enough to be extended: 16 MB."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            data = [p.encode() for p in batch.column("phrase").to_pylist()]
            for lang in set(langs.tolist()):
                own = [data[i] for i in np.flatnonzero(langs == lang)]
                ends = np.cumsum([len(p) for p in own])
                starts = np.concatenate([[0], ends[:-1]])
                keys = _Hashes(np.frombuffer(b"".join(own), np.uint8), _seed(lang)).of(starts, ends)
                yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(SHIFT)).astype(np.int64))], ["place"])

    places = phrases.where(F.col("words") < LONGEST).mapInArrow(hashed, "place long").withColumn("place", F.col("place") + 1)
    pages = places.groupBy(F.bitmap_bucket_number("place").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bitmap = np.zeros((PAGES, PAGE_BITS // 8), np.uint8)
    # Bounded: at most PAGES rows of 4 KB.
    for row in pages.toArrow().to_pylist():
        bitmap[row["page"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return bitmap.ravel()


@dataclass(frozen=True)
class Mined:
    """Every phrase of up to ``LONGEST`` words with its exact count of ``min_count`` or more, all words per language, and the passes made."""

    phrases: DataFrame
    totals: DataFrame
    passes: int


def mine(docs: DataFrame, min_count: int = MIN_COUNT, sample: int = SAMPLE, lowered: float = LOWERED) -> Mined:
    """Frequent phrases of ``docs`` (lang, text) by Toivonen's method.

    The phrases of a sample (every ``sample``-th document by hash) are counted, words and pairs first, then
    longer ones made of pairs with enough; those with at least
    ``lowered`` times the count expected there are proposed. A full pass takes the proposed phrases and
    their negative border: every phrase that is proposed or whose two parts that lack one
    end word are, and all words. They are read twice: counted by hash first (see ``sieve``), then what
    can be frequent by that is counted exactly, so rare phrases, which are most of them, are never shuffled. Of those that are frequent, some were not proposed: border failures. They
    are added, and another full pass counts what can be extended since then, until a pass finds no failure.
    Then all frequent phrases are known, since the parts of a frequent phrase are frequent. If the failures are
    few, that pass counts extensions of extensions too, whatever their own counts: it reaches every frequent
    phrase that was not counted before, as its parts were counted or are reached as well, and is the last.

    Proposals are bits of a bitmap of a fixed 16 MB. Others that pass by chance are counted too, which
    changes no result; a full bitmap means more counting, not other counts.
    """
    spark: SparkSession = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    chosen = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(sample)) == 0
    least = max(1, round(lowered * min_count / sample))
    drawn = docs.where(chosen)
    words, pairs = sieve(drawn, least, longest=2)
    held = broadcast(words | pairs), broadcast(words)
    _, longer = sieve(drawn, least, *held, LONGEST - 1, True)
    for bitmap in held:
        bitmap.destroy()
    now, before, onwards = broadcast(words | pairs | longer), None, False
    frequent, totals, passes = None, None, 0
    while True:
        # Few phrases are counted as they are.
        passed = None if onwards else broadcast(np.bitwise_or(*sieve(docs, min_count, now, before)))
        counted = phrase_counts(docs, now, before, onwards=onwards, passed=passed)
        if totals is None:
            found = spool(counted.where((F.col("words") == 0) | (F.col("n") >= min_count)), "phrase-counts")
            totals = found.where("words = 0").select("lang", F.col("n").alias("total"))
        else:
            found = spool(counted.where(F.col("n") >= min_count), "phrase-counts")
        if passed:
            passed.destroy()
        found = found.where("words > 0")
        frequent = found if frequent is None else frequent.unionByName(found)
        passes += 1
        if onwards:
            return Mined(frequent, totals, passes)
        grown = np.bitwise_or(now.value, extendable(found))
        if np.array_equal(grown, now.value):
            return Mined(frequent, totals, passes)
        set_bits = int(np.bitwise_count(now.value).sum())
        onwards = int(np.bitwise_count(grown).sum()) - set_bits <= FEW * set_bits
        before, now = now, broadcast(grown)


def _exact(*factors: Column) -> Column:
    product = factors[0].cast("decimal(18,0)")
    for f in factors[1:]:
        product = product * f.cast("decimal(18,0)")
    return product


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE, lowered: float = LOWERED
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to 5 words that are no part of an equally frequent longer one.

    A text is lower-cased (A to Z), cut into pieces at ``.,;:!?`` and line ends, and these into words at
    blanks and tabs. ``a`` counts the phrase, ``l`` and ``r`` its two parts at the cut with the lowest score
    ``floor(1000 * a * n / (l * r))``, ``n`` all words of the language. All counts are exact over whole texts
    (see ``mine``); products are decimals of 38 digits.

    A phrase goes if one with a word more at either end comes as often: if a still longer one does, so does
    that one. Ranks are first limited in lanes of a language, so a task sorts a bounded number of rows.

    Defined cases: null text is empty, null language is ``und`` and one with rows of that name; very long texts are counted
    in parts of half a megabyte that share four words; repeated ids and rows count each; equal scores go to the higher ``a``, then by the bytes of the phrase;
    an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    mined = mine(rows, min_count, sample, lowered)
    known = mined.phrases.select("lang", "phrase", "words", "n")
    long = known.where("words > 1").withColumn("w", F.split("phrase", " "))

    def part(first: Column, number: Column) -> Column:
        return F.array_join(F.slice("w", first, number), " ")

    # Both phrases that lack one end word, where they come as often.
    inner = long.where("words > 2").select("lang", "n", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"))
    left = long.join(inner.distinct(), ["lang", "phrase", "n"], "left_anti")
    cuts = left.select("lang", "phrase", F.col("n").alias("a"), "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    parts = known.where(F.col("words") < LONGEST)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    cuts = cuts.join(mined.totals.withColumnRenamed("total", "n"), "lang")
    quotient = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * _exact(F.col("a"), F.col("n")), _exact(F.col("l"), F.col("r")))
    scored = cuts.select("lang", "phrase", "a", "n", F.struct(quotient.cast("long").alias("score"), "k", "l", "r").alias("cut"))
    best = spool(scored.groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut")), "phrase-scores")
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    def ranked(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")
        return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)

    lane = F.pmod(F.xxhash64("phrase"), F.lit(LANES))
    first = ranked(best.withColumn("lane", lane), "lang", "lane").drop("lane", "rank")
    return ranked(first, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
