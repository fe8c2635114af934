"""Toxicity: a counterfactual-regularised classifier.

Features of a text are its distinct words, and their beginnings of 4 to 7 letters for inflected forms, folded to
lower case. A bounded sample of the labelled rows is learnt from. Counts over it choose the features: those that
stand out most among toxic or clean texts. A logistic model is then fitted. Each training text that names a group
is paired with the same text in which identity terms are swapped for those of other groups, and the squared change
of its score is penalised, so a neutral mention of a group moves no score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, steps

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7)

#: Identity terms by kind; a swap puts another term of the same kind in a term's place.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "buddhist", "hindu", "sikh", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "buddhists", "hindus", "sikhs", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indian", "mexican", "chinese"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer", "transgender"),
    ("man", "woman", "boy", "girl", "male", "female"),
    ("men", "women", "boys", "girls", "males", "females"),
    ("old", "young", "elderly", "teenage"),
    ("blind", "deaf", "disabled", "paralyzed"),
    ("homme", "femme", "garçon", "fille"),
    ("mann", "frau", "junge", "mädchen"),
    ("hombre", "mujer", "chico", "chica"),
)


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(words: set[str]) -> set[str]:
    """Words, and their beginnings marked by a hyphen."""
    return words | {f"{w[:n]}-" for w in words for n in BEGINNINGS if len(w) > n}


#: The kind of each identity term and its place in it.
PLACES = {term: (kind, i) for kind in IDENTITY_TERMS for i, term in enumerate(kind)}
SENTENCE_END = re.compile(r"[.!?\n]+")


def swapped(words: set[str], shift: int) -> set[str]:
    """The words with each identity term replaced by the ``shift``-th next one of its kind."""
    return {PLACES[w][0][(PLACES[w][1] + shift) % len(PLACES[w][0])] if w in PLACES else w for w in words}


def counterfactuals(text: str | None) -> tuple[list[tuple[set[str], set[str]]], set[str], set[str]]:
    """(pairs of sentences, as words, with one group and another in its place; words that the text gains and loses by them).

    One pair for each sentence that names a group. Where none does, one for the longest sentence with a term put in;
    which kind and terms, the text's checksum says. An empty text is one empty sentence.
    """
    text = text or ""
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    shift = 1 + seed % 3
    named = [own for own in map(words_of, SENTENCE_END.split(text)) if not own.isdisjoint(PLACES)] if not words_of(text).isdisjoint(PLACES) else []
    if named:
        words = words_of(text)
        return [(own, swapped(own, shift)) for own in named], swapped(words, shift) - words, words - swapped(words, shift)
    kind = IDENTITY_TERMS[seed // 3 % len(IDENTITY_TERMS)]
    at = seed // 1024 % len(kind)
    own = words_of(max(SENTENCE_END.split(text), key=len))
    return [(own | {kind[at]}, own | {kind[(at + shift) % len(kind)]})], {kind[at]}, set()


@dataclass
class ToxicityModel:
    """Weights by feature, and a bias; on how many counterfactual pairs it was fitted."""

    weights: dict[str, float]
    bias: float
    pairs: int = 0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        get = self.weights.get
        z = np.array([self.bias + sum(get(f, 0.0) for f in features_of(words_of(t))) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, n, n_toxic) over rows (text, toxic): in how many texts, and in how many toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            n: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for f in features_of(words_of(text)):
                    held = n.setdefault(f, [0, 0])
                    held[0] += 1
                    held[1] += toxic
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([x[0] for x in n.values()], pa.int64()), pa.array([x[1] for x in n.values()], pa.int64())], ["feature", "n", "n_toxic"])

    each = rows.mapInArrow(run, "feature string, n long, n_toxic long")
    return each.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def choose_features(rows: DataFrame, limit: int, least: int) -> list[str]:
    """The ``limit`` features whose share of toxic texts is furthest from the usual, in standard errors."""
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    if not total.n or not total.t or total.t == total.n:
        return []
    base = total.t / total.n
    far = F.abs(F.col("n_toxic") - base * F.col("n")) / F.sqrt(F.col("n") * base * (1 - base))
    best = feature_counts(rows).where(F.col("n") >= least).select("feature", far.alias("far")).orderBy(F.desc("far"), "feature").limit(limit)
    return [r.feature for r in best.collect()]


def fit_toxicity(rows: DataFrame, n_features: int = 4_000, least: int = 5, l2: float = 1.0, fairness: float = 1.0, rounds: int = 300) -> ToxicityModel:
    """A model from labelled rows (text, toxic 0 or 1), of which there must be a bounded number.

    Texts stay on the executors; the chosen features of each reach the driver. n_features: so many features at most,
    each in ``least`` texts, besides the identity terms. fairness: the weight of the squared score change under swapped identity terms. Rows
    whose label is null are left out. Without both labels the model is the smoothed share of toxic rows.
    """
    scratch = Scratch(rows.sparkSession)
    rows = scratch.keep(rows.where("toxic IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")), "toxicity-rows")
    names = choose_features(rows, n_features, least)
    if not names:
        n, t = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        scratch.clear()
        return ToxicityModel({}, float(np.log((t + 1) / (n - t + 1))))
    names += sorted(features_of(set(PLACES)) - set(names))
    place = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda features: sorted(place[f] for f in features if f in place)
        for batch in steps(batches, "text"):
            own, gained, lost, more, less = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                features = features_of(words)
                pairs, plus, minus = counterfactuals(text)
                changed = features_of(words - minus | plus)
                own.append(numbers(features))
                gained.append(numbers(changed - features))
                lost.append(numbers(features - changed))
                sides = [(features_of(a), features_of(b)) for a, b in pairs]
                more.append([numbers(b - a) for a, b in sides])
                less.append([numbers(a - b) for a, b in sides])
            flat = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(x, flat) for x in (own, gained, lost)), *(pa.array(x, pa.list_(flat)) for x in (more, less))], ["toxic", "own", "gained", "lost", "more", "less"])

    data = rows.mapInArrow(run, "toxic int, own array<int>, gained array<int>, lost array<int>, more array<array<int>>, less array<array<int>>").toArrow()
    scratch.clear()
    y = data.column("toxic").to_numpy().astype(float)
    own, gained, lost, more, less = (data.column(c).to_pylist() for c in ("own", "gained", "lost", "more", "less"))
    pairs = [pair for a, b in zip(more, less, strict=True) for pair in zip(a, b, strict=True)]
    w, b = fit_weights(own, list(zip(gained, lost, strict=True)), pairs, y, len(names), l2, fairness, rounds)
    return ToxicityModel({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-4}, float(b), len(pairs))


Change = tuple[list[int], list[int]]  # features gained and lost


def _signed(changes: list[Change]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the change, feature, 1 or -1) of all."""
    rows = np.repeat(np.arange(len(changes)), [len(a) + len(b) for a, b in changes]).astype(np.int64)
    features = np.fromiter((i for a, b in changes for i in (*a, *b)), np.int64)
    signs = np.fromiter((s for a, b in changes for s in (*[1.0] * len(a), *[-1.0] * len(b))), float)
    return rows, features, signs


def objective(own: list[list[int]], variants: list[Change], pairs: list[Change], y: np.ndarray, n_features: int, l2: float, fairness: float):
    """A function of (weights, bias) that gives the loss and its gradients, with steps that suit each weight.

    The loss: the mean log loss of texts and of their variants, + l2 |w|^2 / 2n + fairness * mean squared change of
    the linear score over pairs.
    """
    n = len(y)
    col = np.fromiter((i for x in own for i in x), np.int64)
    row = np.repeat(np.arange(n), [len(x) for x in own])
    (vrow, vcol, vsign), (prow, pcol, psign) = _signed(variants), _signed(pairs)
    share = fairness / max(1, len(pairs))
    width = max(1.0, np.bincount(row, minlength=n).max(initial=1) ** 0.5)  # a guess of how features go together
    curve = (np.bincount(col, minlength=n_features) / (4 * n) + np.bincount(vcol, minlength=n_features) / (8 * n) + 2 * share * np.bincount(pcol, minlength=n_features)) * width + l2 / n

    def at(v: np.ndarray, c: float) -> tuple[float, np.ndarray, float]:
        z = np.bincount(row, v[col], n) + c
        variant = z + np.bincount(vrow, vsign * v[vcol], n)
        change = np.bincount(prow, psign * v[pcol], len(pairs))
        loss = float((np.logaddexp(0, z) + np.logaddexp(0, variant) - y * (z + variant)).sum() / (2 * n) + l2 * (v @ v) / (2 * n) + share * (change**2).sum())
        wrong, off = (((1 / (1 + np.exp(-np.clip(s, -500, 500)))) - y) / (2 * n) for s in (z, variant))
        slope = np.bincount(col, (wrong + off)[row], n_features) + np.bincount(vcol, vsign * off[vrow], n_features) + l2 * v / n + 2 * share * np.bincount(pcol, psign * change[prow], n_features)
        return loss, slope, float((wrong + off).sum())

    return at, curve, 0.25 * width


def fit_weights(own: list[list[int]], variants: list[Change], pairs: list[Change], y: np.ndarray, n_features: int, l2: float, fairness: float, rounds: int) -> tuple[np.ndarray, float]:
    """Minimises ``objective`` by accelerated gradient steps, scaled by each weight's curvature; steps that raise the loss are taken back."""
    n = len(y)
    at, curve, curve_b = objective(own, variants, pairs, y, n_features, l2, fairness)
    w, b = np.zeros(n_features), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    last, lastb, step, scale, reached = w, b, 0, 1.0, at(w, b)[0]
    for _ in range(rounds):
        pull = step / (step + 3)
        v, c = w + pull * (w - last), b + pull * (b - lastb)
        _, slope, slope_b = at(v, c)
        nextw, nextb = v - slope / (curve * scale), c - slope_b / (curve_b * scale)
        now = at(nextw, nextb)[0]
        if now > reached:  # begin again from here, without momentum; and if it had none, with shorter steps
            last, lastb, scale, step = w, b, scale * (1 if step else 2), 0
            continue
        last, lastb, w, b, reached, step = w, b, nextw, nextb, now, step + 1
    return w, b


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with score (0 to 1, higher: toxic likelier) and predicted (1 if score >= 0.5, else 0).

    Scores depend on the text alone. Defined cases: a null or empty text has no features and scores as the bias
    says; score and predicted columns of the input are replaced, others and repeated rows are passed on.
    """
    docs = docs.drop("score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most n_features weights
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            s = held.value.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, f"{schema}, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text has remainder 0 by 5; null for a null doc_id."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit_on_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, **parameters) -> ToxicityModel:
    """A model from the labels of documents that are not held out.

    sample_rows: it is fitted on at most so many labelled documents, those with the least hashes of their doc_id.
    They are chosen from the labels alone, so only their texts are moved. Labels without doc_id or toxic are left
    out; where a doc_id has several, the highest counts; of rows that repeat a doc_id one is taken.
    """
    own = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return fit_toxicity(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), **parameters)
