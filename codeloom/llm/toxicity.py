"""Toxicity by a classifier chain of linear models trained with out-of-fold predictions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.common import give_back, giving_back, replaced, spool

# The models are fitted on at most this many labelled rows, chosen by a hash of their id.
MAX_TRAIN = 12_000
FOLDS = 5
# Candidate features that reach the driver, and features of one model.
CANDIDATES = 4096
FEATURES = 192
# A word stands for itself and for its beginnings of these lengths, which catch inflected forms.
PREFIXES = (3, 4, 5, 6, 7)
WORD = re.compile(r"[^\W_]+")
DENSE = 3
# Rows that are turned to double precision at a time.
BLOCK = 2048


def lexical(text: str) -> dict[str, int]:
    """Features of a text: each different word counts once for itself and for its beginnings."""
    found: dict[str, int] = {}
    for word in set(WORD.findall(text.lower())):
        for feature in word_features(word):
            found[feature] = found.get(feature, 0) + 1
    return found


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def shape(text: str) -> list[float]:
    """Size, share of signs, share of capitals."""
    n = len(text)
    if not n:
        return [0.0, 0.0, 0.0]
    letters = sum(map(len, WORD.findall(text)))
    return [np.log1p(n) / 10, 1 - letters / n, sum(map(str.isupper, text)) / n]


@dataclass(frozen=True)
class Link:
    """One model of the chain: weights of the bias, the shape, earlier probabilities and features."""

    category: str
    bias: float
    dense: tuple[float, ...]
    earlier: tuple[float, ...]
    weights: dict[str, float]


@dataclass(frozen=True)
class Chain:
    links: tuple[Link, ...]
    accuracy: dict[str, float]

    def probabilities(self, text: str | None) -> list[float]:
        text = text or ""
        dense = shape(text)
        words = set(WORD.findall(text.lower()))
        counts: dict[str, int] = {}
        known = self.vocabulary
        for word in words:
            if word in known:
                counts[word] = counts.get(word, 0) + 1
            if word[:3] in self.stems:
                for n in PREFIXES:
                    if len(word) >= n and (stem := f"{word[:n]}*") in known:
                        counts[stem] = counts.get(stem, 0) + 1
        done: list[float] = []
        for link in self.links:
            z = link.bias + sum(w * x for w, x in zip(link.dense, dense)) + sum(w * p for w, p in zip(link.earlier, done))
            z += sum(link.weights.get(f, 0.0) * np.log1p(k) for f, k in counts.items())
            done.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return done

    @property
    def vocabulary(self) -> set[str]:
        if "_known" not in self.__dict__:
            object.__setattr__(self, "_known", {f for link in self.links for f in link.weights})
            object.__setattr__(self, "_stems", {f[:3] for f in self._known if f.endswith("*")})
        return self._known

    @property
    def stems(self) -> set[str]:
        return self._stems if self.vocabulary is not None else set()


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 12) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton's method; the first column of ``x`` is a free bias of ones."""
    w = np.zeros(x.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[0] = np.log(share / (1 - share))
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = predict(x, w)
        curve, slope = np.diag(penalty), -penalty * w
        for at in range(0, len(x), BLOCK):
            part, q = x[at : at + BLOCK].astype(float), p[at : at + BLOCK]
            curve += (part * (q * (1 - q))[:, None]).T @ part
            slope += (y[at : at + BLOCK] - q) @ part
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = [np.zeros(0), *(x[at : at + BLOCK] @ w for at in range(0, len(x), BLOCK))]
    return 1 / (1 + np.exp(-np.clip(np.concatenate(z), -30, 30)))


def association(n: np.ndarray, t: np.ndarray, base: float) -> np.ndarray:
    """How far the share of positives among n occurrences is from the base rate, in standard errors."""
    return np.abs(t - n * base) / np.sqrt(np.maximum(n * base * (1 - base), 1e-9) + 1)


@dataclass(frozen=True)
class Training:
    """Labelled rows: fold, labels, shape, and features as (row, column, value) entries; ``chosen`` has the columns of each category's models, one without each fold, then the one on all rows."""

    folds: np.ndarray
    labels: list[np.ndarray]
    dense: np.ndarray
    entries: tuple[np.ndarray, np.ndarray, np.ndarray]
    width: int
    chosen: list[list[np.ndarray]]

    def design(self, columns: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Ones, shape, earlier probabilities and the chosen features, in single precision."""
        place = np.full(self.width + 1, -1, np.int32)
        place[columns] = np.arange(len(columns))
        row, column, value = self.entries
        at = place[column]
        use = np.flatnonzero(at >= 0)
        first = 1 + DENSE + earlier.shape[1]
        x = np.zeros((len(self.folds), first + len(columns)), np.float32)
        x[:, 0], x[:, 1 : 1 + DENSE], x[:, 1 + DENSE : first] = 1, self.dense, earlier
        for some in np.array_split(use, len(use) // 200_000 + 1):
            x[row[some], first + at[some]] = value[some]
        return x


def fit_links(data: Training, categories: Sequence[str], names: Sequence[str]) -> Chain:
    """The chain's models in order; each sees the out-of-fold probabilities of those before it."""
    earlier = np.zeros((len(data.folds), 0))
    links, accuracy = [], {}
    for category, target, chosen in zip(categories, data.labels, data.chosen):

        def model(rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x = data.design(columns, earlier)
            return x, fit_logistic(x[rows], target[rows])

        held_out = np.full(len(target), target.mean())
        for k in range(FOLDS):
            rows, out = data.folds != k, data.folds == k
            if rows.any() and out.any() and target[rows].min() < target[rows].max():
                x, w = model(rows, chosen[k])
                held_out[out] = predict(x[out], w)
        accuracy[category] = float(((held_out >= 0.5) == (target == 1)).mean())
        _, w = model(np.ones(len(target), bool), chosen[FOLDS])
        cuts = np.split(w, np.cumsum([1, DENSE, earlier.shape[1]]))
        weights = {names[c]: float(v) for c, v in zip(chosen[FOLDS], cuts[3])}
        links.append(Link(category, float(w[0]), tuple(cuts[1].tolist()), tuple(cuts[2].tolist()), weights))
        earlier = np.hstack([earlier, held_out[:, None]])
    return Chain(tuple(links), accuracy)


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_train: int = MAX_TRAIN,
) -> Chain:
    """Fit one linear model for each 0/1 column of ``labels``, in the given order.

    The model of a category sees words, beginnings of words, the shape of the text, and the
    probabilities of all earlier categories. For training those are out-of-fold: each comes from a
    model that has not seen the row, so that later models meet the kind of error they will meet.

    At most ``max_train`` labelled ids are used, those with the smallest hash, with one row each; the driver
    holds the counts of the 4,096 candidate features and the weights, and chooses from the counts the features of
    each model; the one task that fits the models holds these rows' values of the features that some model takes.
    Word counts of the sample are aggregated by Spark.
    Labels that are null count as 0; a repeated id takes its largest label; of documents with one id the
    text with the smallest hash is used; ids without a document are left out. With no labelled document all
    probabilities are 0.
    """
    spark = docs.sparkSession
    labels_at = [f"y{i}" for i in range(len(categories))]
    truth = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(
        *(F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)).alias(y) for y, c in zip(labels_at, categories))
    )
    # Bounded: at most max_train rows of one id and a few labels.
    sample = spool(truth.orderBy(F.xxhash64(F.lit(11), "key"), "key").limit(max_train), "toxicity-labels")
    fold = F.pmod(F.xxhash64(F.lit(12), "key"), F.lit(FOLDS)).cast("int")
    named = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "key")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    rows = spool(named.groupBy("key", *labels_at).agg(one.alias("one")).select(fold.alias("fold"), *labels_at, F.col("one.text").alias("text")), "toxicity-sample")
    # Bounded: FOLDS rows.
    sizes = rows.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in labels_at)).collect()
    if not sizes:
        return Chain((), {})
    held = {name: np.array([next((float(r[name]) for r in sizes if r["fold"] == k), 0.0) for k in range(FOLDS)]) for name in ("n", *labels_at)}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    counted = rows.select("fold", *labels_at, F.explode(words).alias("word")).groupBy("word", "fold", *labels_at).agg(F.count("*").alias("n"))
    stems = [F.when(F.length("word") >= n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in PREFIXES]
    per_fold = [
        F.sum(F.when(F.col("fold") == k, F.col("n") * (F.col(y) if y else 1)).otherwise(0)).alias(f"{y or 'n'}_{k}")
        for k in range(FOLDS) for y in [None, *labels_at]
    ]
    totals = counted.select(F.explode(F.array_compact(F.array("word", *stems))).alias("feature"), "fold", "n", *labels_at).groupBy("feature").agg(*per_fold)
    n_all = sum((F.col(f"n_{k}") for k in range(1, FOLDS)), F.col("n_0"))

    def strength(y: str):
        t = sum((F.col(f"{y}_{k}") for k in range(1, FOLDS)), F.col(f"{y}_0"))
        b = float(held[y].sum() / held["n"].sum())
        return F.abs(t - n_all * b) / F.sqrt(n_all * b * (1 - b) + 1)

    best = F.greatest(*(strength(y) for y in labels_at), F.lit(0.0))
    # Bounded: CANDIDATES rows.
    table = totals.where(n_all >= 4).withColumn("z", best).orderBy(F.desc("z"), "feature").limit(CANDIDATES).toArrow()
    def by_fold(y: str) -> np.ndarray:
        return np.stack([table.column(f"{y}_{k}").to_numpy().astype(float) for k in range(FOLDS)], axis=1)

    seen = by_fold("n")

    def strongest(y: str, positive: np.ndarray, folds: Sequence[int]) -> np.ndarray:
        base = held[y][folds].sum() / max(held["n"][folds].sum(), 1)
        return np.argsort(-association(seen[:, folds].sum(1), positive[:, folds].sum(1), base), kind="stable")[:FEATURES]

    without = [[f for f in range(FOLDS) if f != k] for k in range(FOLDS + 1)]
    chosen = [[strongest(y, positive, folds) for folds in without] for y, positive in ((y, by_fold(y)) for y in labels_at)]
    # What no model takes stays out of the rows.
    used = np.unique(np.concatenate([c for one in chosen for c in one]))
    names = table.column("feature").take(pa.array(used)).to_pylist()
    place = {f: i for i, f in enumerate(names)}
    chosen = [[np.searchsorted(used, c) for c in one] for one in chosen]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            at, times, dense = [], [], []
            for text in batch.column("text").to_pylist():
                found = [(place[f], k) for f, k in lexical(text).items() if f in place]
                at.append([f for f, _ in found])
                times.append([k for _, k in found])
                dense.append(shape(text))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32())), pa.array(dense, pa.list_(pa.float64()))],
                [*batch.schema.names[:-1], "at", "times", "dense"],
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        data = pa.Table.from_batches(found)
        found.clear()
        at, times, dense = (data.column(c).combine_chunks() for c in ("at", "times", "dense"))
        entries = np.repeat(np.arange(data.num_rows, dtype=np.int32), at.value_lengths().to_numpy()), at.flatten().to_numpy(), np.log1p(times.flatten().to_numpy()).astype(np.float32)
        labelled = [data.column(y).to_numpy().astype(float) for y in labels_at]
        training = Training(data.column("fold").to_numpy(), labelled, dense.flatten().to_numpy().reshape(-1, DENSE), entries, len(names), chosen)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(asdict(fit_links(training, categories, names)))])], ["chain"])

    kinds = ", ".join(["fold int", *(f"{y} int" for y in labels_at), "at array<int>", "times array<int>", "dense array<double>"])
    # One task for all rows: max_train at most.
    features = spool(rows.mapInArrow(giving_back(project), kinds), "toxicity-features")
    found = json.loads(features.coalesce(1).mapInArrow(giving_back(fit), "chain string").first()["chain"])
    links = (Link(k["category"], k["bias"], tuple(k["dense"]), tuple(k["earlier"]), k["weights"]) for k in found["links"])
    return Chain(tuple(links), found["accuracy"])


def score_chain(docs: DataFrame, chain: Chain, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``p_<category>`` for each category; whole texts, row by row, no shuffle.

    Null text is scored as empty. An existing ``p_<category>`` in any case is replaced; all else is passed through.
    """
    names = [link.category for link in chain.links]

    # Texts become Python strings one by one, so a task holds an Arrow batch and no copies of it.
    @F.arrow_udf("array<double>")
    def probabilities(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array((chain.probabilities(t.as_py()) for t in texts), pa.list_(pa.float64()), size=len(texts))
        give_back()

    packed = docs.select(F.struct("*").alias("row"), probabilities(F.col(text_col)).alias("p"))
    new = {f"p_{c}": F.get("p", F.lit(names.index(c))) if c in names else F.lit(0.0) for c in categories}
    return packed.select(*replaced("row", docs.columns, new))


# What the labels table has, in chain order: poor quality first, toxicity given it.
CATEGORIES = ("low_quality", "toxic")


def label_columns(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The two categories of the labels table as 0/1 columns."""
    return labels.select(
        id_col, (F.col("quality") == 0).cast("int").alias("low_quality"), (F.col("toxic") == 1).cast("int").alias("toxic")
    )


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """``docs`` plus ``p_low_quality``, ``p_toxic`` and ``is_toxic`` (probability of ``threshold`` or more); existing ones, in any case, are replaced.

    Chain fitted on ``labels`` (id, quality, toxic); see ``fit_chain`` and ``score_chain`` for the cases.
    """
    chain = fit_chain(docs, label_columns(labels, id_col), CATEGORIES, id_col, text_col, max_train)
    return score_chain(docs, chain, CATEGORIES, id_col, text_col).withColumn("is_toxic", F.col("p_toxic") >= threshold)
