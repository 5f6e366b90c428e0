"""Token counts, lexical search and phrase mining: the tokenizers, brute force, and SQL on the given tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import catalog, phrases, token_counts as counts_module
from codeloom.llm.lexical_search import LEAF, Trie, impact, lexical_search
from codeloom.llm.phrases import CHUNK, collocations, count_phrases, mine, segments
from codeloom.llm.token_counts import Splitter, token_counts
from codeloom.llm.tokens import tokenizer_path


@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_collocations"])
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, small)
    result = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(map(tuple, df.select(columns).collect()))
    assert got and got == sorted(result.fetchall())


# --- token counts -------------------------------------------------------------------------------

ODD = [
    "", None, " ", "  \n\t x", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> ", "<|endoftext", "don't we'll I'M o'clock's",
    "x_y __ 12³ ½ Ⅻ ٣ 一二三", "\x1c\x1d a\x85b c d 　e", "é é ñandú ÀB", "🙂🙃 a🙂b", "𐐷 𝟘𝟙 ͸ \U0001e4d0", "ab" * 5000, "-" * 300, " " * 70 + "x",
]


def ids_of(path):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_splitter_counts_as_the_tokenizer(name):
    path = tokenizer_path(name)
    own, ids = Splitter(path), ids_of(path)
    rng = random.Random(5)
    letters = "ab Z9'_-.\n\t éñß²Ⅷ一ا́\x1c  🙂<|>"
    texts = [t for t in ODD if t] + ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(400)]
    texts += [t.replace("<", "<|endoftext|>") for t in texts[-100:]]
    for text in texts:
        known, found = own.frequencies(text)
        assert known + sum(n * own.pieces(p) for p, n in found.items()) == len(ids(text)), text


@pytest.mark.parametrize("hot", [0, 50, counts_module.HOT])
def test_token_counts_cases(spark, small, hot):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, "no id"), (10_000, "again")], docs.schema)
    rows = docs.unionByName(odd).withColumn("pretokens", F.lit("x")).withColumn("N_TOKENS", F.lit(1)).repartition(5)
    ids = ids_of(tokenizer_path())
    want = sorted(((r.doc_id or -1), len((r.text or "").encode()), n := len(ids(r.text or "")), n > 512) for r in rows.collect())
    got = token_counts(rows, hot=hot).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_token_counts_of_nothing(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- lexical search -----------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked_by_hand(docs, items, top):
    counted = [(key, n, Counter(terms(text))) for n, (key, text) in enumerate(docs)]
    counted = [c for c in counted if c[2]]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, _, c in counted)
    df = Counter(t for _, _, c in counted for t in c)
    asked = defaultdict(Counter)
    for key, text in items:
        asked[key].update(terms(text))
    out = []
    for item, own in asked.items():
        scores = []
        for key, place, c in counted:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t, times in own.items() if t in c
            )
            if score > 0:
                scores.append((-score, key is None, key or 0))
        out += [(item, rank + 1, None if none else key, -score) for rank, (score, none, key) in enumerate(sorted(scores)[:top])]
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("top", [1, 10])
def test_search_against_brute_force(spark, monkeypatch, top):
    from codeloom.llm import lexical_search as module

    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "ñu", "Straße", "日本", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 40)))) for i in range(900)]
    # A third are copies of one text, whose terms a query has; ids may be missing or come twice.
    docs += [(1000 + i, "w0 w1 w2, w3! É") for i in range(450)] + [(None, "w0 w1 É"), (None, "w0 w1 É"), (5, "w59 w58"), (2000, None), (2001, " .,;"), (2002, "W0 " * 50_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30))) + " unseen") for i in range(25)]
    items += [(100, "w0 w1 w2 w3 É"), (101, None), (102, "..."), (103, "neverseen"), (None, "w58 w58 w59"), (3, "w40 w40"), (104, "w2 " * 3000)]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, place int, score int").repartition(5)
    q = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, N int")
    want = ranked_by_hand(docs, items, top)
    assert in_order(lexical_search(d, q, top).collect()) == in_order(want)
    # Several passes over the items, and several tries a task.
    monkeypatch.setattr(module, "PASS_TERMS", 60)
    monkeypatch.setattr(module, "TRIE_DOCS", 128)
    assert in_order(lexical_search(d, q, top).collect()) == in_order(want)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, q in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id > 1"), items.limit(0))):
        df = lexical_search(d, q)
        assert df.collect() == [] and df.columns == ["item_id", "rank", "doc_id", "score"]


def test_trie_bounds_and_visits_few_documents():
    rng = np.random.default_rng(4)
    vectors = sorted(sorted(set(rng.zipf(1.3, rng.integers(1, 30)).clip(max=200).tolist())) for _ in range(5000))
    sizes = np.array([len(v) for v in vectors])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.concatenate(vectors).astype(np.int64)
    tf, m = rng.integers(1, 6, len(codes)), rng.integers(30, 200, len(vectors))
    trie = Trie(starts, codes, tf, m)
    assert all(b - a <= LEAF for a, b, n, after in zip(trie.first, trie.last, range(10**6), trie.after) if after == n + 1)
    asked, weights = np.array([3, 17, 55]), np.array([100, 900, 2500])
    weight_of = dict(zip(asked.tolist(), weights.tolist()))
    per_term = np.array([weight_of.get(c, 0) for c in codes.tolist()]) * impact(tf, np.repeat(m, sizes))
    scores = np.add.reduceat(per_term, starts[:-1])
    bounds = np.zeros(len(trie.first), np.int64)
    for t, w in weight_of.items():
        at = int(np.searchsorted(trie.known, t))
        part = slice(trie.term_starts[at], trie.term_starts[at + 1])
        bounds[trie.nodes[part]] += w * trie.bound[part]
    assert all(scores[a:b].max() <= bounds[n] for n, (a, b) in enumerate(zip(trie.first, trie.last)))
    names = [(False, i, i) for i in range(len(vectors))]
    want = sorted(((int(s), names[i]) for i, s in enumerate(scores) if s > 0), key=lambda t: (-t[0], t[1]))[:10]
    assert trie.search(asked, weights, names, [], 10) == want


# --- phrases ------------------------------------------------------------------------------------


def grams_by_hand(rows):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, total


def collocations_by_hand(rows, least, top):
    counts, total = grams_by_hand(rows)
    out = []
    for lang, f in counts.items():
        known = {p: a for p, a in f.items() if a >= least}
        found = []
        for phrase, a in known.items():
            words = phrase.split(" ")
            if len(words) < 2 or any(len(q.split(" ")) > len(words) and b >= a and f" {phrase} " in f" {q} " for q, b in known.items()):
                continue
            cuts = []
            for k in range(1, len(words)):
                left, right = known[" ".join(words[:k])], known[" ".join(words[k:])]
                cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found.append((-score, -a, phrase.encode(), left, right))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(found[:top])]
    return sorted(out)


def phrase_rows():
    rng = random.Random(9)
    words = [f"v{i}" for i in range(30)] + ["ÉA", "日本", "a'b", " x"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(500):
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " ? "]) for w in rng.choices(words, weights, k=rng.randrange(0, 60)))
        rows.append((rng.choice(["en", "en", "en", "de", "und", None]), text))
    # Copies, one text that repeats a phrase on its own (a sample hardly has it), and texts without words.
    rows += [("en", "the Very same text of many copies, which holds v1 v2 V1")] * 300
    return rows + [("de", "rare words go here; " * 80), ("fr", None), (None, None), ("fr", " .,\n"), ("xx", "only one")]


@pytest.mark.parametrize("sample, lowered", [(8, 0.25), (400, 0.9), (1, 1.0)])
def test_phrases_against_brute_force(spark, sample, lowered):
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, n int, PHRASE int").repartition(6)
    got = collocations(docs, min_count=20, top=40, sample=sample, lowered=lowered).collect()
    assert sorted(map(tuple, got)) == collocations_by_hand(rows, 20, 40)


def test_border_failures_are_found_by_further_passes(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    # A sample that proposes nothing: every length takes a pass of its own.
    mined = mine(docs, 20, sample=1, lowered=1e9)
    counts, total = grams_by_hand(rows)
    assert {(r.lang, r.phrase): r.n for r in mined.phrases.collect()} == {(lang, p): a for lang, f in counts.items() for p, a in f.items() if a >= 20}
    assert {r.lang: r.total for r in mined.totals.collect() if r.total} == {lang: n for lang, n in total.items() if n}
    assert mined.passes >= 5
    assert mine(docs, 20, sample=1, lowered=1.0).passes == 1


def test_few_border_failures_take_one_more_pass(spark):
    """The sample lacks a passage that is frequent: its phrases of all lengths are found by the second pass."""
    rng = random.Random(11)
    rows = [("en", " ".join(f"v{rng.randrange(70)}" for _ in range(400))) for _ in range(400)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(8))
    drawn = [r.drawn for r in docs.select((place == 0).alias("drawn")).collect()]
    at = drawn.index(False)
    rows[at] = ("en", "one passage of six new words . " * 30)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    mined = mine(docs, 20)
    counts, total = grams_by_hand(rows)
    assert {r.phrase: r.n for r in mined.phrases.collect()} == {p: a for p, a in counts["en"].items() if a >= 20}
    assert mined.passes == 2


def test_a_sieve_keeps_rare_phrases_from_the_shuffle(spark):
    """Nearly all phrases of the border are rare: the counting pass gets the frequent ones only, each with its whole count."""
    rows = phrase_rows() + [("en", " ".join(f"r{i}x{j}" for j in range(40))) for i in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts, total = grams_by_hand(rows)
    every = {(lang, p): a for lang, f in counts.items() for p, a in f.items()}
    often = {p for p, a in every.items() if a >= 20}
    words, longer = phrases.sieve(docs, 20)
    passed = spark.sparkContext.broadcast(words | longer)
    got = {(r.lang, r.phrase): r.n for r in phrases.phrase_counts(docs, passed=passed).where("words > 0").collect()}
    assert all(every[p] == n for p, n in got.items()) and often <= got.keys()
    assert len(got) < len(often) + len(every) / 100 and len(every) > 30 * len(often)
    assert {lang for lang, p in got if p.startswith("r0x")} == set()


def test_hashes_of_a_sieve_are_summed_over_parts():
    rng = np.random.default_rng(7)
    parts = [rng.choice(np.concatenate([np.arange(300), rng.integers(0, 1 << 32, 500), [(1 << 32) - 1]]), 4000).astype(np.uint32) for _ in range(3)]
    pages = {}
    for part in parts:
        for page, data in phrases._packed(part):
            pages.setdefault(page, []).append(phrases._unpacked(data))
    got = {}
    for page, held in pages.items():
        for number in phrases._summed([phrases._summed(held[:2]), *held[2:]]).tolist():
            got[(page << phrases.LOW_BITS) + (number >> phrases.COUNT_BITS)] = number & ((1 << phrases.COUNT_BITS) - 1)
    assert got == Counter(np.concatenate(parts).tolist())


def test_full_bitmaps_change_no_count(spark, monkeypatch):
    monkeypatch.setattr(phrases, "extendable", lambda found: np.full(phrases.BITS // 8, 255, np.uint8))
    rows = phrase_rows()[:200]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = collocations(docs, min_count=10, top=100).collect()
    assert sorted(map(tuple, got)) == collocations_by_hand(rows, 10, 100)


@pytest.mark.parametrize("most", [1, 7, 40, 1000])
def test_long_texts_are_counted_in_parts(most):
    rng = random.Random(most)
    text = "".join(rng.choice(["a", "bb", "ccc", "d" * 30]) + rng.choice([" ", "  ", "\t", ".", "\n "]) for _ in range(300)).encode()
    every = np.full(phrases.BITS // 8, 255, np.uint8)
    got = Counter()
    parts = 0
    for part, carried in segments(text, most):
        found, _, times = count_phrases(part, "en", carried, every, None)
        got.update(dict(zip(found, times.tolist())))
        parts += 1
    counts, total = grams_by_hand([("en", text.decode())])
    assert got.pop(b"") == total["en"] and {p.decode(): n for p, n in got.items()} == dict(counts["en"])
    assert parts > 1 or most == 1000 or len(text) <= most
    assert CHUNK > most


def test_phrases_of_nothing(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
