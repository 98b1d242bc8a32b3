"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

A document is a bag of sentences. A sentence's score is the logistic of a bias and the
weights of its distinct words and their first letters; the document's score is ``1 - product(1 - sentence
score)``. Only documents have labels: the gradient of the document's log loss reaches each
sentence through the noisy-or, so the weights learn which sentences offend.

Every sentence has some score, so the product over thousands of neutral ones would make any
long text toxic. Therefore, when a text is scored, the product takes only sentences from a score of `HEARD` on,
one that repeats once, and where there is none the strongest sentence alone is the text's score. So
that depends on what a text says and not on how long it is. Given back with their offsets are the sentences whose
own calibrated score reaches `LOCATE`, and where a text reaches it by several weaker ones
together, all that count: each text at or above `LOCATE` has at least one.

The model is fitted with numpy on a bounded sample of labelled rows (at most `SAMPLE` rows and
`SAMPLE_BYTES` of text of the labels 0 and 1, the lowest by a hash of the id, whole texts of any length
that the rest of the bound still holds). It is a list of the features that `LEAST_DOCS` documents of the
sample share, with a weight each; every row is then scored over its whole text, in pieces of 1 MB that end
with a sentence (a sentence over 1 MB is cut at a word).

Defined cases: ids with equal hashes come into the sample by id, and several labels of one id count as the lowest; columns of
any name are carried along; a null or empty text has no sentence and the score of no evidence (the prior
of the bias); rows that repeat a text have its score; without labels of both kinds there are
no weights; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, labelled_sample, text_bytes
from .features import Words, chunks, code_points, pieces

#: Besides a word itself, its first letters are features, in bytes.
PREFIXES = (4, 5, 6)
SAMPLE = (4000, 2500)
SAMPLE_BYTES = (8 << 20, 5 << 20)
STEPS = 120
RATE = 0.15
SPARSE = 1e-4
#: Least documents of the sample that hold a word.
LEAST_DOCS = 4
LOCATE = 0.5
#: Least score of a sentence that counts.
HEARD = 0.3
BIAS = -7.0
_SLOTS = 1 << 18


@dataclass
class Model:
    #: Hashes of the features in order, and their weights.
    features: np.ndarray
    weights: np.ndarray
    bias: float
    #: Calibration of the document's logit.
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        # Most features of a text are none of the model's; a table of bits tells nearly all of them at once.
        self.used = np.zeros(_SLOTS, bool)
        self.used[_slot(self.features)] = True


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (_SLOTS - 1)


def _features(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, number of the word) of the words and of each length of first letters."""
    return [(w.hash, np.arange(len(w.hash))), *(w.prefix(n) for n in PREFIXES)]


def _known(w: Words, features: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, number of the feature) of each distinct one of `features`."""
    pairs = [np.zeros(0, np.int64)]
    for h, word in _features(w):
        maybe = np.nonzero(used[_slot(h)])[0]
        at = np.minimum(np.searchsorted(features, h[maybe]), max(len(features) - 1, 0))
        hit = features[at] == h[maybe] if len(features) else np.zeros(0, bool)
        pairs.append(w.sentence[word[maybe[hit]]] * len(features) + at[hit])
    pair = np.unique(np.concatenate(pairs))
    return pair // max(len(features), 1), pair % max(len(features), 1)


def _sentences(w: Words) -> np.ndarray:
    """The first word of each sentence."""
    return np.nonzero(np.concatenate(([True], w.sentence[1:] != w.sentence[:-1])))[0] if len(w.sentence) else np.zeros(0, np.int64)


def _cut(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All texts in pieces; the text and the offset of each."""
    found = [(k, at, part) for k, t in enumerate(texts) for at, part in pieces(t)]
    return [p for _, _, p in found], np.array([k for k, _, _ in found], np.int64), np.array([at for _, at, _ in found], np.int64)


def vocabulary(texts: list[bytes], least: int = LEAST_DOCS) -> np.ndarray:
    """Hashes, in order, of the features that `least` or more of the texts hold."""
    parts, owner, _ = _cut(texts)
    hashes, docs, before = [], [], 0
    for part in chunks(parts):
        w = Words(part)
        for h, word in _features(w):
            doc = owner[before + w.doc[word]]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
            hashes.append(h[new])
            docs.append(doc[new].astype(np.int32))
        before += len(part)
    if not hashes:
        return np.zeros(0, np.uint64)
    # A text in several pieces holds a feature once.
    h, doc = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
    found, n = np.unique(h[new], return_counts=True)
    return found[n >= least]


def bags(texts: list[bytes], features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence of each distinct feature, the feature's number, document of each sentence)."""
    parts, owner, _ = _cut(texts)
    used = Model(features, features, 0.0).used
    found, sentences, before = [(np.zeros(0, np.int32),) * 3], 0, 0
    for part in chunks(parts):
        w = Words(part)
        s, at = _known(w, features, used)
        doc = owner[before + w.doc[_sentences(w)]]
        found.append(((s + sentences).astype(np.int32), at.astype(np.int32), doc.astype(np.int32)))
        sentences += len(doc)
        before += len(part)
    return tuple(np.concatenate(x) for x in zip(*found))


def logit(quiet: np.ndarray) -> np.ndarray:
    """Logit of a document's score from -log of its chance of no offending sentence."""
    return np.where(quiet > 30, quiet, np.log(np.expm1(np.clip(quiet, 1e-30, 30))))


def calibrated(quiet: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * logit(quiet) + model.shift, -300, 300)))


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS) -> Model:
    """Weights from four fifths of the sample; slope and shift of the document's logit from the rest."""
    part = np.arange(len(labels)) % 5 == 4
    model = _weights([t for t, held in zip(texts, part) if not held], labels[~part], steps)
    y = labels[part].astype(float)
    if len(y) and 0 < y.mean() < 1:
        x = logit(silence([t for t, held in zip(texts, part) if held], model)[0])
        beta = _logistic(np.stack((x, np.ones(len(x))), axis=1), y, np.array([1.0, 0.0]))
        model.slope, model.shift = float(np.clip(beta[0], 0.1, 3)), float(beta[1])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Newton's method, with halved steps where one overshoots, on the log loss and a quadratic pull to `prior`."""
    loss = lambda beta: (np.logaddexp(0, x @ beta) - y * (x @ beta)).sum() + ((beta - prior) ** 2).sum() / 2
    beta = prior
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -300, 300)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(2), x.T @ (q - y) + beta - prior)
        while np.abs(step).max() > 1e-9 and loss(beta - step) > loss(beta):
            step = step / 2
        beta = beta - step
    return beta


def _weights(texts: list[bytes], labels: np.ndarray, steps: int) -> Model:
    """Full-batch Adam on the log loss of the noisy-or, with an absolute penalty that keeps rare words out."""
    y = labels.astype(float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), BIAS)
    features = vocabulary(texts)
    sentence, at, doc = bags(texts, features)
    n = len(y)
    w, m, v = np.zeros(len(features) + 1), np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    w[-1] = BIAS
    for step in range(1, steps + 1):
        z = np.bincount(sentence, w[at], len(doc)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        quiet = np.bincount(doc, np.logaddexp(0, z), n)
        none = np.exp(-quiet)
        # d(-log P)/d(logit) of a sentence: p for a clean document, -p (1-P)/P for a toxic one.
        pull = np.where(y == 1, -none / np.maximum(1 - none, 0.02), 1.0) / n
        g = pull[doc] * p
        gradient = np.concatenate((np.bincount(at, g[sentence], len(features)), [g.sum()]))
        gradient[:-1] += SPARSE * np.sign(w[:-1])
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(features, w[:-1], float(w[-1]))


def silence(texts: list[bytes], model: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """-log of each text's chance of no offending sentence, the noisy-or's complement; (start, end, score) in bytes of its offending sentences."""
    parts, owner, offset = _cut(texts)
    quiet, top, heard, before = np.zeros(len(texts)), np.full(len(texts), -np.inf), [[] for _ in texts], 0
    known: list[set[bytes]] = [set() for _ in texts]
    for part in chunks(parts):
        w = Words(part)
        first = _sentences(w)
        s, at = _known(w, model.features, model.used)
        z = np.bincount(s, model.weights[at], len(first)) + model.bias
        np.maximum.at(top, owner[before + w.doc[first]], z)
        counts = np.nonzero(z >= np.log(HEARD / (1 - HEARD)))[0]
        doc = owner[before + w.doc[first[counts]]]
        last = np.concatenate((first[1:] - 1, [len(w.sentence) - 1]))
        for k, d in zip(counts.tolist(), doc.tolist()):
            piece = w.doc[first[k]]
            said = w.folded[w.start[first[k]] : w.end[last[k]]].tobytes()
            if said not in known[d]:
                known[d].add(said)
                quiet[d] += np.logaddexp(0, z[k])
            shift = offset[before + piece] - w.starts[piece]
            heard[d].append((int(w.start[first[k]] + shift), int(w.end[last[k]] + shift), float(z[k])))
        before += len(part)
    quiet = np.where(quiet > 0, quiet, np.logaddexp(0, np.where(np.isinf(top), model.bias, top)))
    reached = calibrated(quiet, model) >= LOCATE
    located = []
    for spots, is_reached in zip(heard, reached):
        alone = [x for x in spots if calibrated(np.logaddexp(0, x[2]), model) >= LOCATE]
        chosen = alone or (spots if is_reached else [])
        located.append([(a, b, float(1 / (1 + np.exp(-z)))) for a, b, z in chosen])
    return quiet, located


def toxicity(text, model: Model):
    """Column (score, sentences): sentences as (start, end, score) in code points, those that offend."""
    bounded_batches()
    sentence = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    @F.arrow_udf("struct<score:double,sentences:array<struct<start:int,end:int,score:double>>>")
    def scored(column: pa.Array) -> pa.Array:
        texts = text_bytes(column)
        quiet, located = silence(texts, model)
        found = calibrated(quiet, model)
        shown = []
        for t, spots in zip(texts, located):
            at = code_points(t, [o for s in spots for o in s[:2]]) if spots else []
            shown.append([{"start": at[2 * k], "end": at[2 * k + 1], "score": s[2]} for k, s in enumerate(spots)])
        return pa.StructArray.from_arrays([pa.array(found, pa.float64()), pa.array(shown, sentence)], names=["score", "sentences"])

    return scored(text)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", per_label: tuple[int, int] = SAMPLE, most_bytes: tuple[int, int] = SAMPLE_BYTES) -> Model:
    return fit(*labelled_sample(docs, labels, label_col, per_label, most_bytes, id_col, text_col))


def held_out(id_col, folds: int, fold: int):
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score under `threshold`."""
    return docs.where(toxicity(F.col(text_col), model)["score"] < threshold)
