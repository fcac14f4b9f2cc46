"""Subject areas of documents: complement naive Bayes, expectation-maximization, calibrated posteriors."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.session import Rounds, ship_package
from sedimenta.sources.tables import bounded

LETTERS = re.compile(r"[^\W\d_]+")
HUMPS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^A-Za-z]+")


@dataclass(frozen=True)
class Settings:
    """``most_labels``: labelled documents the first model is fitted on, about; chosen by hash of their id, all else covers every document.

    ``share`` and ``least_docs``: documents a word must occur in, as a share
    and as a number, to be a feature. ``smooth``: documents added to each
    count. ``rounds``: of expectation-maximization. ``least``: evidence from
    which a subject is considered; a document about it has ten times as much.
    ``own_labels``: labels from which a subject is calibrated by itself,
    ``ridge``: how strongly that is held to the calibration of all subjects.
    """

    most_labels: int = 200_000
    share: float = 0.0008
    least_docs: int = 3
    smooth: float = 0.5
    rounds: int = 2
    least: float = 1.0
    own_labels: int = 50
    ridge: float = 10.0
    subjects_a_document: int = 2
    threshold: float = 0.5


class Words:
    """Distinct words of texts: identifiers cut at humps and underscores, lower case, of two letters or more."""

    def __init__(self, most: int = 200_000) -> None:
        self.known: dict[str, tuple[str, ...]] = {}
        self.most = most

    def of(self, text: str | None) -> list[str]:
        if not text:
            return []
        if len(self.known) > self.most:
            self.known.clear()
        found: set[str] = set()
        for run in set(LETTERS.findall(text)):
            cut = self.known.get(run)
            if cut is None:
                parts = (run,) if run.islower() else HUMPS.findall(run)
                cut = self.known[run] = tuple(w.lower() for w in parts if len(w) > 1)
            found.update(cut)
        return sorted(found)


class Features:
    """Numbers of the known words in a document; unknown words are cut into known ones where they consist of these."""

    def __init__(self, vocabulary: Sequence[str], most: int = 200_000, longest: int = 64) -> None:
        self.number = {w: i for i, w in enumerate(vocabulary)}
        self.longest = min(longest, max(map(len, vocabulary), default=0))
        self.cut: dict[str, tuple[int, ...]] = {}
        self.most = most

    def of(self, words: Sequence[str]) -> list[int]:
        if len(self.cut) > self.most:
            self.cut.clear()
        out: set[int] = set()
        for w in words:
            i = self.number.get(w)
            if i is not None:
                out.add(i)
                continue
            parts = self.cut.get(w)
            if parts is None:
                parts = self.cut[w] = self._parts(w)
            out.update(parts)
        return sorted(out)

    def _parts(self, word: str) -> tuple[int, ...]:
        """Fewest known words that make up the whole word, of any length from five letters.

        A part has three letters or more, the last one two, and ``longest`` at
        most; so time is in proportion to the word.
        """
        n, find = len(word), self.number.get
        if n < 5:
            return ()
        least: list[int | None] = [0, *[None] * n]
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        for end in range(2, n + 1):
            for start in range(max(0, end - self.longest), end - (1 if end == n else 2)):
                before = least[start]
                if before is None or (least[end] is not None and before + 1 >= least[end]):
                    continue
                i = find(word[start:end])
                if i is not None:
                    least[end], back[end] = before + 1, (start, i)
        out, end = [], n
        while end and least[n] is not None:
            end, i = back[end]
            out.append(i)
        return tuple(out)


def complement_weights(inside: np.ndarray, n_inside: np.ndarray, everywhere: np.ndarray, n: float, smooth: float = 0.5) -> np.ndarray:
    """Weights of complement naive Bayes (Rennie et al. 2003), words x subjects, against the word's rate in all documents.

    ``inside``: documents of the subject with the word, ``everywhere``:
    documents with the word, ``n_inside`` and ``n``: documents; all may be
    expected numbers. A subject's complement is all other documents; the weight
    is how much rarer the word is there than everywhere, as a logarithm of
    smoothed rates, so a word without bearing on a subject says nothing and one
    that only occurs elsewhere next to nothing. Each subject's weights are then
    normalised: brought to the mean sum of absolute weights, by a factor of two
    at most.
    """
    outside = np.maximum(everywhere[:, None] - inside, 0)
    rate = (everywhere + smooth) / (n + 2 * smooth)
    elsewhere = (outside + smooth) / (np.maximum(n - n_inside, 0) + 2 * smooth)[None, :]
    raw = np.log(rate)[:, None] - np.log(elsewhere)
    size = np.abs(raw).sum(axis=0)
    usual = size[size > 0].mean() if (size > 0).any() else 1.0
    return (raw * np.clip(usual / np.maximum(size, 1e-12), 0.5, 2.0)[None, :]).astype(np.float32)


def evidence(flat: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the words' weights per document (documents x subjects); ``ends`` begins with 0."""
    sums = np.zeros((len(ends) - 1, table.shape[1]), dtype=np.float32)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        sums[full] = np.add.reduceat(table[flat], ends[:-1][full], axis=0)
    return sums


def terms(sums: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """What the calibration looks at: evidence and part of the document's evidence, both as logarithms, to the second degree."""
    positive = np.maximum(sums, 0)
    part = positive[rows, columns] / np.maximum(positive.sum(axis=1)[rows], 1e-6)
    p = np.clip(part, 0.01, 0.99).astype(float)
    s, q = np.log(np.maximum(sums[rows, columns], 1e-6).astype(float)), np.log(p / (1 - p))
    return np.stack([np.ones_like(s), s, s * s, q, q * q, s * q], axis=1)


@dataclass(frozen=True)
class Model:
    """``table``: weights of words; ``calibration``: logistic coefficients (subjects x terms); ``priors``: expected share of documents about each subject."""

    table: np.ndarray
    calibration: np.ndarray
    priors: np.ndarray

    def posteriors(self, sums: np.ndarray, least: float) -> np.ndarray:
        """Of each subject on its own; 0 below the least evidence."""
        out = np.zeros(sums.shape)
        r, s = np.nonzero(sums >= least)
        out[r, s] = 1 / (1 + np.exp(-np.clip((terms(sums, r, s) * self.calibration[s]).sum(axis=1), -30, 30)))
        return out


def cut_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The distinct words of every text: ``doc_id`` and ``words``.

    Beside these rows, those with ``counts`` have how many documents of a task
    have each of ``words``; counted in the workers, so no word is shuffled once
    for each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = Words(), {}
        for batch in batches:
            lists = [cutter.of(value.as_py()) for value in batch.column(1)]
            for words in lists:
                for w in words:
                    seen[w] = seen.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string())), pa.nulls(len(lists), pa.list_(pa.int64()))], names=[doc_id, "words", "counts"])
            if len(seen) > 300_000:
                yield _counted(seen, batch.column(0).type)
                seen = {}
        if seen:
            yield _counted(seen, batch.column(0).type)

    def _counted(seen: dict[str, int], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([list(seen)], pa.list_(pa.string())), pa.array([list(seen.values())], pa.list_(pa.int64()))], names=[doc_id, "words", "counts"])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, words array<string>, counts array<long>")


def word_counts(cut: DataFrame) -> DataFrame:
    """``word`` and ``n``, the documents that have it."""
    pairs = cut.where(F.col("counts").isNotNull()).select(F.explode(F.arrays_zip("words", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.words").alias("word")).agg(F.sum("p.counts").alias("n"))


def featurise(cut: DataFrame, doc_id: str, vocabulary: Sequence[str]) -> DataFrame:
    """``doc_id`` and ``ids``, the numbers of the known words of each document."""
    shared = cut.sparkSession.sparkContext.broadcast(list(vocabulary))  # bounded by the share a word must reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value)
        for batch in batches:
            lists = pa.array([features.of(words) for words in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[doc_id, "ids"])

    return cut.where(F.col("counts").isNull()).select(doc_id, "words").mapInArrow(run, f"`{doc_id}` {cut.schema[doc_id].dataType.simpleString()}, ids array<int>")


def with_labels(features: DataFrame, doc_id: str, labels: DataFrame, subjects: Sequence[str], settings: Settings) -> DataFrame:
    """Features with ``y``, the numbers of the subjects a document is labelled with, and ``fit``, whether the first model may look at it."""
    place = F.array_position(F.array(*[F.lit(s) for s in subjects]), F.col("subject")).cast("int") - 1
    each = labels.groupBy(doc_id).agg(F.array_sort(F.collect_set(place)).alias("y"))
    n = each.count()
    chosen = F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, settings.most_labels / max(1, n))))
    return features.join(bounded(each.withColumn("fit", chosen), 200_000), doc_id, "left").select(doc_id, "ids", F.coalesce("y", F.array().cast("array<int>")).alias("y"), F.coalesce("fit", F.lit(False)).alias("fit"))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    ends = column.offsets.to_numpy()
    return column.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def _marks(column: pa.ListArray, k: int) -> np.ndarray:
    """Documents x subjects: 1 where a document has the label."""
    flat, ends = _lists(column)
    out = np.zeros((len(ends) - 1, k))
    out[np.repeat(np.arange(len(out)), np.diff(ends)), flat] = 1
    return out


def _sums(features: DataFrame, n_words: int, k: int, members) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:  # noqa: ANN001
    """Documents per word and subject, per subject and per word, and all; ``members(batch)`` gives each document's memberships, NaN for documents to leave out.

    Workers add up before the shuffle. What is collected has as many rows as
    the vocabulary has words.
    """
    names = [f"s{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, of_all, everywhere, n = np.zeros((n_words, k)), np.zeros(k), np.zeros(n_words), 0
        for batch in batches:
            flat, ends = _lists(batch.column("ids"))
            p = members(batch)
            row = np.repeat(np.arange(len(p)), np.diff(ends))
            there = ~np.isnan(p).any(axis=1) if k else np.zeros(len(p), dtype=bool)
            flat, row = flat[there[row]], row[there[row]]
            for s in range(k):
                some = np.flatnonzero(p[row, s])
                inside[:, s] += np.bincount(flat[some], weights=p[row[some], s], minlength=n_words)
            everywhere += np.bincount(flat, minlength=n_words)
            of_all += p[there].sum(axis=0)
            n += int(there.sum())
        some = np.flatnonzero(everywhere)
        table = np.vstack([of_all[None, :], inside[some]])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some], pa.int64()), pa.array(np.r_[n, everywhere[some]], pa.float64()), *(pa.array(table[:, s]) for s in range(k))], names=["word", "n", *names])

    schema = "word long, n double, " + ", ".join(f"{c} double" for c in names)
    rows = features.mapInArrow(run, schema).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect()
    inside, of_all, everywhere, n = np.zeros((n_words, k)), np.zeros(k), np.zeros(n_words), 0.0
    for word, total, *values in rows:
        if word < 0:
            of_all, n = np.array(values), total
        else:
            inside[word], everywhere[word] = values, total
    return inside, of_all, everywhere, n


def _bins(features: DataFrame, table: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean terms, documents and labelled ones of bins of each subject, and the subject; some thousand bins a subject at most, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = evidence(*_lists(batch.column("ids")), table)
            r, s = np.nonzero(sums >= settings.least)
            x = terms(sums, r, s)
            grid = (s * 1000 + np.round(x[:, 1] * 8).astype(np.int64) + 200) * 1000 + np.round(x[:, 3] * 4).astype(np.int64) + 500
            cells, at = np.unique(grid, return_inverse=True)
            y = _marks(batch.column("y"), table.shape[1])[r, s]
            columns = [np.bincount(at, weights=c, minlength=len(cells)) for c in (np.ones(len(r)), y, *x.T)]
            yield pa.RecordBatch.from_arrays([pa.array(cells), *map(pa.array, columns)], names=["cell", *names])

    names = ["n", "y", *(f"t{i}" for i in range(6))]
    rows = features.select("ids", "y").mapInArrow(run, "cell long, " + ", ".join(f"{c} double" for c in names)).groupBy("cell").agg(*[F.sum(c).alias(c) for c in names]).orderBy("cell").collect()
    data = np.array([r[1:] for r in rows], dtype=float).reshape(-1, 8)
    return data[:, 2:] / data[:, :1], data[:, 0], data[:, 1], np.array([r[0] // 1_000_000 for r in rows], dtype=int)


def fit_calibration(x: np.ndarray, n: np.ndarray, labelled: np.ndarray, rounds: int = 300, ridge: float = 0.05, share: float | None = None, towards: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic coefficients, and the share of true cases that are labelled.

    Only some documents were read for labels, at random, so an unlabelled case
    may be true. Its chance of being so is guessed from the model, the model
    fitted to the guesses, and so on (Elkan and Noto 2008). With ``share`` that
    is given and stays; with ``towards`` the fit starts there, and ``ridge``
    holds it there.
    """
    fixed, centre = share is not None, np.zeros(x.shape[1]) if towards is None else towards
    b, share = centre.copy(), 0.15 if share is None else share
    if towards is None:
        b[:4] = -9.0, 3.0, 0.0, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        true = labelled + (n - labelled) * p * (1 - share) / (1 - p * share)
        h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        move = np.clip(np.linalg.solve(h, x.T @ (true - n * p) - (ridge * (b - centre) if towards is not None else 0)), -2, 2)
        b = b + move
        if not fixed:
            share = float(np.clip(labelled.sum() / max(true.sum(), 1e-9), 1e-3, 0.999))
        elif np.abs(move).max() < 1e-9:
            break
    return b, share


def calibrate(features: DataFrame, table: np.ndarray, settings: Settings) -> np.ndarray | None:
    """Coefficients of each subject: its own where it has ``own_labels``, held to those of all subjects together; else these. None if nothing has evidence."""
    x, n, y, subject = _bins(features, table, settings)
    if not len(x):
        return None
    every, share = fit_calibration(x, n, y)
    out = np.tile(every, (table.shape[1], 1))
    for s in range(table.shape[1]):
        own = subject == s
        if y[own].sum() >= settings.own_labels:
            out[s], _ = fit_calibration(x[own], n[own], y[own], ridge=settings.ridge, share=share, towards=every)
    return out


def train(features: DataFrame, k: int, n_words: int, settings: Settings) -> Model | None:
    """Fitted on labelled documents, then refined over all documents by expectation-maximization.

    In each round every document gets its posteriors from the weights and their
    calibration (E); the expected documents of each subject, their words and
    with them the priors are counted anew, the labelled documents' own counts
    added, and the weights made from these (M).
    """

    def given(batch: pa.RecordBatch) -> np.ndarray:
        y = _marks(batch.column("y"), k)
        y[~batch.column("fit").to_numpy(zero_copy_only=False)] = np.nan
        return y

    base = _sums(features.select("ids", "y", "fit").where("fit"), n_words, k, given)
    table = complement_weights(*base, settings.smooth)
    model = None
    for left in range(settings.rounds, -1, -1):
        calibration = calibrate(features, table, settings)
        if calibration is None:
            return model
        model = Model(table, calibration, base[1] / max(base[3], 1.0) if model is None else priors)
        if left:

            def guessed(batch: pa.RecordBatch, model: Model = model) -> np.ndarray:
                return model.posteriors(evidence(*_lists(batch.column("ids")), model.table), settings.least)

            expected = _sums(features.select("ids"), n_words, k, guessed)
            priors = expected[1] / max(expected[3], 1.0)
            table = complement_weights(*(a + b for a, b in zip(base, expected)), settings.smooth)
    return model


def score(features: DataFrame, doc_id: str, subjects: Sequence[str], model: Model, settings: Settings) -> DataFrame:
    """``doc_id``, ``subject``, its place among the document's subjects by evidence, and its posterior."""
    shared = features.sparkSession.sparkContext.broadcast(model)
    names = np.array(list(subjects), dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = evidence(*_lists(batch.column(1)), shared.value.table)
            place = np.argsort(np.argsort(-sums, axis=1, kind="stable"), axis=1, kind="stable")
            posterior = shared.value.posteriors(sums, settings.least)
            r, s = np.nonzero(posterior)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array(names[s], pa.string()), pa.array(place[r, s], pa.int32()), pa.array(posterior[r, s])], names=[doc_id, "subject", "place", "posterior"])

    kind = features.schema[doc_id].dataType.simpleString()
    return features.select(doc_id, "ids").mapInArrow(run, f"`{doc_id}` {kind}, subject string, place int, posterior double")


def subject_posteriors(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, subjects: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``subject``, ``place`` and ``posterior`` of each subject that a document has some evidence for.

    Evidence is the sum over the distinct words of the whole text, so one word
    however often repeated weighs little. Each subject's posterior is on its
    own: calibrated on its evidence and its part of the document's evidence,
    binned over all documents, with the labels as far as there are. NULL and
    empty texts have no row; without any label there is no row at all. Labels
    of unknown documents or subjects and repeated ones change nothing. Texts
    are cut into words once; the words stay in the shared folder until each
    document's features are there.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    known = labels.where(F.col("subject").isin(list(subjects)) & F.col(doc_id).isNotNull()).select(doc_id, "subject").distinct()
    nothing = spark.createDataFrame([], f"`{doc_id}` {kind}, subject string, place int, posterior double")
    if not subjects or known.isEmpty():
        return nothing
    tables = Rounds(spark)
    cut = tables.write("words", cut_texts(docs, doc_id, text))
    least = max(settings.least_docs, settings.share * cut.where(F.col("counts").isNull()).count())
    vocabulary = sorted(r[0] for r in word_counts(cut).where(F.col("n") >= least).select("word").collect())
    features = tables.write("features", with_labels(featurise(cut, doc_id, vocabulary), doc_id, known, subjects, settings))
    tables.drop("words")
    model = train(features, len(subjects), len(vocabulary), settings)
    return score(features, doc_id, subjects, model, settings) if model else nothing


def subjects_of(posterior: DataFrame, doc_id: str, settings: Settings = Settings()) -> DataFrame:
    """The subjects a document is about, two at most: the most evident ones with a posterior of ``threshold`` or more."""
    return posterior.where((F.col("posterior") >= settings.threshold) & (F.col("place") < settings.subjects_a_document)).select(doc_id, "subject")
