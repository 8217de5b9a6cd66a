"""Operator 6: toxicity by a classifier chain of linear models.

Labels are predicted one after another; each model sees the words of a text and the probabilities that
the models before it gave. For training these are out of fold: a document's earlier probabilities come
from models that have not seen it, as they will for new documents.

Words are runs of letters, digits and non-ASCII characters, lower-cased; their beginnings of some
lengths stand for inflected forms. A model's features are the words and beginnings whose presence tells
most about its label (likelihood ratio), and the earlier probabilities as log odds. Training rows are a
bounded sample of the labelled documents (TRAINING_ROWS, the smallest hashes of doc_id), each distinct
text once; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .texts import PUNCTUATION, Chunk, chunks, constants, spans_hash

#: Labelled documents that models are trained on, at most.
TRAINING_ROWS = 20_000
#: Words a model looks at, at most.
FEATURES = 1024
#: Documents that must hold a word, and the likelihood ratio it must reach.
LEAST_DOCUMENTS = 3
LEAST_RATIO = 30.0
FOLDS = 5
#: Weight of the squared coefficients.
PENALTY = 0.3
STEPS = 60
#: A document is rejected from this probability of the last label on.
THRESHOLD = 0.5

#: Bytes of the beginnings of longer words.
BEGINNINGS = (4, 5, 6)

_EDGE = 1e-6
_LONGER = constants(95, len(BEGINNINGS))


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word and beginning of a word in some texts."""
    rows, hashes = [chunk.row_of_word()], [chunk.hashes()]
    for size, salt in zip(BEGINNINGS, _LONGER, strict=True):
        long = chunk.ends - chunk.starts > size
        starts = chunk.starts[long]
        rows.append(rows[0][long])
        hashes.append(spans_hash(chunk.data, starts, starts + size) ^ salt)
    return np.concatenate(rows), np.concatenate(hashes)


@dataclass
class Rows:
    """Sparse rows of features that are present: row k holds place[bounds[k]:bounds[k+1]]."""

    place: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owners(), weights[self.place], len(self))

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.bounds)[rows]
        at = np.repeat(self.bounds[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return Rows(self.place[at], np.concatenate([[0], np.cumsum(sizes)]))


@dataclass
class Linear:
    """Log odds = base + weights of the words present + weights of earlier log odds."""

    words: np.ndarray
    base: float
    weights: np.ndarray
    earlier: np.ndarray

    def log_odds(self, rows: Rows, before: np.ndarray) -> np.ndarray:
        return self.base + rows.times(self.weights) + before @ self.earlier


@dataclass
class Chain:
    labels: list[str]
    models: list[Linear] = field(default_factory=list)

    def vocabulary(self) -> np.ndarray:
        words = [m.words for m in self.models]
        return np.unique(np.concatenate(words)) if words else np.empty(0, np.uint64)

    def probabilities(self, known: np.ndarray, rows: Rows) -> np.ndarray:
        """A column for each label; rows hold places in `known`."""
        before = np.empty((len(rows), 0))
        for model in self.models:
            weights = np.zeros(len(known))
            weights[np.searchsorted(known, model.words)] = model.weights
            own = Linear(known, model.base, weights, model.earlier)
            before = np.column_stack([before, own.log_odds(rows, before)])
        return _probability(before)


def _probability(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -40, 40)))


def fit(rows: Rows, before: np.ndarray, label: np.ndarray, features: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Base, word weights and weights of earlier log odds: penalised logistic regression by Newton steps
    with conjugate gradients. Without rows, or with one class only, the base alone is used."""
    width = features + before.shape[1]
    share = (label.sum() + 0.5) / (len(label) + 1)
    theta = np.zeros(width + 1)
    theta[0] = np.log(share / (1 - share))
    if not len(label):
        theta[0] = -20.0
    if len(label) and 0 < label.sum() < len(label):
        owners = rows.owners()

        def times(v: np.ndarray) -> np.ndarray:
            return v[0] + np.bincount(owners, v[1 : features + 1][rows.place], len(rows)) + before @ v[features + 1 :]

        def back(r: np.ndarray) -> np.ndarray:
            words = np.bincount(rows.place, r[owners], features)
            return np.concatenate([[r.sum()], words, before.T @ r])

        ridge = np.full(width + 1, PENALTY)
        ridge[0] = 1e-3

        def loss(v: np.ndarray) -> float:
            z = times(v)
            return float((np.logaddexp(0, z) - label * z).sum() + 0.5 * (ridge * v * v).sum())

        value = loss(theta)
        for _ in range(STEPS):
            p = _probability(times(theta))
            gradient = back(p - label) + ridge * theta
            curve = p * (1 - p) + 1e-9
            step, rest = np.zeros_like(theta), -gradient
            line, size = rest.copy(), rest @ rest
            for _ in range(50):
                bent = back(curve * times(line)) + ridge * line
                rate = size / (line @ bent)
                step += rate * line
                rest -= rate * bent
                new = rest @ rest
                if new < 1e-2 * (gradient @ gradient):  # exact steps would not need fewer of them
                    break
                line, size = rest + new / size * line, new
            scale = 1.0
            while scale > 1e-4 and loss(theta + scale * step) > value:
                scale /= 2
            theta = theta + scale * step
            now = loss(theta)
            if value - now < 1e-9 * max(1.0, value):
                break
            value = now
    return float(theta[0]), theta[1 : features + 1], theta[features + 1 :]


def _likelihood_ratio(with_yes, with_no, yes, no):
    """How much better two shares of a label explain the counts than one, for words' documents."""

    def part(k, n):
        return np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(n, _EDGE)), 0.0)

    a, b, c, d = with_yes, with_no, yes - with_yes, no - with_no
    total = yes + no
    return 2 * (
        part(a, (a + b) * yes / total) + part(b, (a + b) * no / total)
        + part(c, (c + d) * yes / total) + part(d, (c + d) * no / total)
    )


def training_rows(documents: DataFrame, labels: DataFrame, names: Sequence[str], most: int) -> DataFrame:
    """fold, text and labels of the sample: one row for each distinct text, the one of the smallest doc_id.

    Rows without a doc_id or with a label other than 0 and 1 are left out; a doc_id labelled more than
    once has its largest labels.
    """
    usable = F.col("doc_id").isNotNull()
    for name in names:
        usable = usable & F.col(name).isin(0, 1)
    chosen = (
        labels.where(usable)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(*(F.max(name).cast("int").alias(name) for name in names))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    joined = texts.join(F.broadcast(chosen), "doc_id")  # `most` rows at most
    first = joined.withColumn("key", F.xxhash64("text")).groupBy("key")
    one = first.agg(F.min_by(F.struct("text", *names), "doc_id").alias("one"))
    return one.select((F.pmod("key", F.lit(FOLDS))).cast("int").alias("fold"), "one.*")


def _words(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Each distinct word of a text, as a hash, with the text's labels."""
    for batch in batches:
        for chunk in chunks(batch.column(0), between=PUNCTUATION):
            row, word = features(chunk)
            order = np.lexsort((word, row))
            row, word = row[order], word[order]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
            columns = [batch.column(1 + k).to_numpy()[row[new] + chunk.first] for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[new].view(np.int64)), *map(pa.array, columns)], ["word", *names]
            )


def present(column: pa.Array, known: np.ndarray) -> Rows:
    """The places among known words (sorted hashes) of the distinct words of each text."""
    places, sizes = [], []
    for chunk in chunks(column, between=PUNCTUATION):
        row, hashes = features(chunk)
        at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
        there = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
        pairs = np.unique(row[there] * (len(known) + 1) + at[there])
        rows, place = np.divmod(pairs, len(known) + 1)
        places.append(place)
        sizes.append(np.bincount(rows, minlength=chunk.rows))
    sizes = np.concatenate(sizes) if sizes else np.empty(0, int)
    return Rows(np.concatenate(places) if places else np.empty(0, int), np.concatenate([[0], np.cumsum(sizes)]).astype(int))


def telling_words(sample: DataFrame, names: Sequence[str]) -> list[np.ndarray]:
    """For each label the words that tell most about it, as sorted hashes."""
    totals = sample.agg(F.count(F.lit(1)), *(F.sum(n) for n in names)).first()
    rows = totals[0]
    if not rows:
        return [np.empty(0, np.uint64) for _ in names]
    fields = "word long, " + ", ".join(f"`{n}` int" for n in names)
    counted = (
        sample.select(F.lower("text").alias("text"), *names)
        .mapInArrow(lambda batches: _words(batches, names), fields)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("documents"), *(F.sum(n).alias(n) for n in names))
        .where(F.col("documents") >= LEAST_DOCUMENTS)
    )
    result = []
    for k, name in enumerate(names):
        yes = totals[1 + k]

        def ratio(batches: Iterator[pa.RecordBatch], yes=yes, name=name) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held, of_yes = (batch.column(c).to_numpy().astype(float) for c in ("documents", name))
                found = _likelihood_ratio(of_yes, held - of_yes, yes, rows - yes)
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(found)], ["word", "ratio"])

        top = counted.mapInArrow(ratio, "word long, ratio double").where(F.col("ratio") >= LEAST_RATIO)
        top = top.orderBy(F.desc("ratio"), "word").limit(FEATURES).toArrow()  # FEATURES rows at most
        result.append(np.sort(top["word"].to_numpy().view(np.uint64)))
    return result


def train(documents: DataFrame, labels: DataFrame, names: Sequence[str], most: int = TRAINING_ROWS) -> Chain:
    """The chain over the labels `names`, in that order."""
    sample = written(training_rows(documents, labels, names, most), "training")
    words = telling_words(sample, names)
    chain = Chain(list(names))
    known = np.unique(np.concatenate(words)) if words else np.empty(0, np.uint64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = present(batch.column(0), known)
            own = [x.tobytes() for x in np.split(rows.place.astype(np.int32), rows.bounds[1:-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(own, pa.binary())], [*fields])

    fields = ["fold", *names, "places"]
    schema = "fold int, " + ", ".join(f"`{n}` int" for n in names) + ", places binary"
    # `most` rows of at most `FEATURES` numbers for each label.
    table = sample.select(F.lower("text").alias("text"), "fold", *names).mapInArrow(scan, schema).toArrow()
    table = table.sort_by([(c, "ascending") for c in fields])
    content = table["places"].to_pylist()
    bounds = np.concatenate([[0], np.cumsum([len(c) // 4 for c in content])]).astype(int)
    rows = Rows(np.frombuffer(b"".join(content), np.int32), bounds)
    fold = table["fold"].to_numpy()
    before = np.empty((len(rows), 0))
    for k, name in enumerate(names):
        label = table[name].to_numpy().astype(float)
        own = _only(rows, known, words[k])
        out = np.zeros(len(rows))
        for f in range(FOLDS) if k + 1 < len(names) else ():
            seen, unseen = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            base, weights, earlier = fit(own.take(seen), before[seen], label[seen], len(words[k]))
            out[unseen] = Linear(words[k], base, weights, earlier).log_odds(own.take(unseen), before[unseen])
        chain.models.append(Linear(words[k], *fit(own, before, label, len(words[k]))))
        before = np.column_stack([before, out])
    return chain


def _only(rows: Rows, known: np.ndarray, words: np.ndarray) -> Rows:
    """The rows with the places of some words only, numbered among them."""
    number = np.full(len(known) + 1, -1)
    number[np.searchsorted(known, words)] = np.arange(len(words))
    places = number[rows.place]
    keep = places >= 0
    upto = np.concatenate([[0], np.cumsum(keep)])
    return Rows(places[keep], upto[rows.bounds])


def predict(documents: DataFrame, chain: Chain, text: str = "text", prefix: str = "p_") -> DataFrame:
    """The rows without their text, with a probability for each label of the chain."""
    shared = documents.sparkSession.sparkContext.broadcast((chain, chain.vocabulary()))
    others = [c for c in documents.columns if c != text]
    added = [prefix + name for name in chain.labels]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, known = shared.value
        for batch in batches:
            found = chain.probabilities(known, present(batch.column(len(others)), known))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(found[:, k]) for k in range(len(added)))], [*others, *added]
            )

    schema = documents.select(*others).schema
    for name in added:
        schema = schema.add(name, "double")
    return documents.select(*others, F.lower(text).alias("text")).mapInArrow(scan, schema)


def classify(documents: DataFrame, labels: DataFrame, names: Sequence[str] = ("quality", "toxic")) -> DataFrame:
    """doc_id, a probability for each label, and rejected: the last label's reaches THRESHOLD.

    A null or empty text has the probabilities of a text without telling words. Repeated rows stay.
    Without labelled documents nothing is rejected.
    """
    chain = train(documents, labels, names)
    rows = predict(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), chain)
    return rows.withColumn("rejected", F.col(f"p_{names[-1]}") >= THRESHOLD)


def clean_documents(documents: DataFrame, labels: DataFrame, names: Sequence[str] = ("quality", "toxic")) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    chain = train(documents, labels, names)
    rows = documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("document"), "text")
    scored = predict(rows, chain)
    return scored.where(F.col(f"p_{names[-1]}") < THRESHOLD).select("document.*")
