"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Every passage is encoded: its features
(shares of character classes, lengths, repetition inside the passage and against the text before it, a
hashed profile of byte pairs) pass a learned tanh layer. Gated attention, the product of
a tanh and a logistic projection of the encoding, weighs the passages; the document's score is
the logistic of a learned projection of their weighted mean. All layers are learned together
from document labels.

The model is fitted with numpy on a bounded sample of labelled rows (`SAMPLE` rows and `SAMPLE_BYTES`
of text of either label, the lowest by a hash of the id, whole texts of any length that the rest of the bound still holds) and has a few thousand numbers; every
row is scored over its whole text.

Defined cases: very long texts are read in pieces of 1 MB; ids with equal hashes come into the sample by id, and several labels
of one id count as the lowest; columns of any name are carried along; a null or empty text is one passage without words; rows that repeat a text
have its score; with one label only, or none, every score is 0.5; an empty table gives an
empty result; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, labelled_sample, text_bytes
from .features import CHUNK_BYTES, Words, chunks

PASSAGE = 64
SAMPLE = (3000, 3000)
SAMPLE_BYTES = (8 << 20, 8 << 20)
HIDDEN, GATE = 24, 12
STEPS = 300
RATE = 0.02
DECAY = 1e-4
PAIR_BUCKETS = 32
SEED = 7


def _lookup(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


#: Character classes whose shares are features; punctuation marks by name, as junk repeats few of them.
CLASSES = [
    _lookup(lambda b: 65 <= b <= 90), _lookup(lambda b: 97 <= b <= 122), _lookup(lambda b: 48 <= b <= 57), _lookup(lambda b: b >= 0xC0),
    _lookup(lambda b: b in b" \t"), _lookup(lambda b: b in b"\r\n"), _lookup(lambda b: b in b".,;:'\"-?"), _lookup(lambda b: b < 0x80 and not chr(b).isalnum() and b not in b" \t\r\n.,;:'\"-?"),
    *(_lookup(lambda b, c=c: b == c) for c in b".,!|#$%&*/<>{}[]()=_@"),
]
N_FEATURES = len(CLASSES) + 6 + PAIR_BUCKETS


def _first_seen(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each value is the first of its kind in its group."""
    key = group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ value
    new = np.zeros(len(key), bool)
    new[np.unique(key, return_index=True)[1]] = True
    return new


class _Seen:
    """What a text has had before the piece at hand: hashes of its words and of its runs of three."""

    def __init__(self):
        self.words, self.threes = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def fresh(self, words: np.ndarray, threes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is new; they are not new from now on."""
        found = ~np.isin(words, self.words), ~np.isin(threes, self.threes)
        self.words, self.threes = np.union1d(self.words, words), np.union1d(self.threes, threes)
        return found


def _long(text: bytes) -> Iterator[Words]:
    """Pieces of whole passages of a long text, in order."""
    at, limit = 0, CHUNK_BYTES
    while at < len(text):
        part = text[at : at + limit]
        if at + limit >= len(text):
            yield Words([part])
            return
        # The last word may go on, so it stays for the next piece.
        starts = Words([part], b"").start[:-1]
        whole = (len(starts) - 1) // PASSAGE * PASSAGE
        if whole <= 0:
            limit *= 2
            continue
        end = int(starts[whole])
        yield Words([part[:end]], b"")
        at, limit = at + end, CHUNK_BYTES


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, its document); texts over 1 MB are read in pieces of whole passages."""
    rows, docs, before = [], [], 0
    for part in chunks(texts):
        if len(part) == 1 and len(part[0]) > CHUNK_BYTES:
            seen = _Seen()
            found = [_passages(w, seen) for w in _long(part[0])]
        else:
            found = [_passages(Words(part))]
        for x, doc in found:
            rows.append(x)
            docs.append(doc + before)
        before += len(part)
    return (np.concatenate(rows), np.concatenate(docs)) if rows else (np.zeros((0, N_FEATURES)), np.zeros(0, np.int64))


def _passages(w: Words, seen: _Seen | None = None) -> tuple[np.ndarray, np.ndarray]:
    n = w.n_docs()
    words = np.bincount(w.doc, minlength=n)
    of_doc = np.maximum(1, -(-words // PASSAGE))
    first_of_doc = np.cumsum(of_doc) - of_doc
    total = int(of_doc.sum())
    doc = np.repeat(np.arange(n), of_doc)
    rank = np.arange(len(w.doc)) - np.repeat(np.cumsum(words) - words, words)
    at = first_of_doc[w.doc] + rank // PASSAGE
    # A passage's bytes run from its first word to the next passage's, or from and to the text's ends.
    edge = np.empty(total + 1, np.int64)
    edge[-1] = len(w.bytes)
    edge[:-1] = w.starts[doc]
    opens = (rank % PASSAGE == 0) & (rank > 0)
    edge[at[opens]] = w.start[opens]
    size = np.maximum(np.diff(edge), 1)
    count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[edge])
    x = np.zeros((total, N_FEATURES))
    for k, member in enumerate(CLASSES):
        x[:, k] = count(member[w.bytes]) / size
    held = np.maximum(np.bincount(at, minlength=total), 1)
    k = len(CLASSES)
    length = w.end - w.start
    x[:, k] = np.log1p(np.bincount(at, length, total) / held)
    x[:, k + 1] = np.bincount(at, _first_seen(at, w.hash), total) / held
    three = w.hash.copy()
    three[2:] = w.hash[2:] * np.uint64(3) + w.hash[1:-1] * np.uint64(5) + w.hash[:-2] * np.uint64(7)
    new, new_three = _first_seen(w.doc, w.hash), _first_seen(w.doc, three)
    if seen is not None:
        fresh, fresh_three = seen.fresh(w.hash, three)
        new, new_three = new & fresh, new_three & fresh_three
    x[:, k + 2] = np.bincount(at, new, total) / held
    x[:, k + 3] = np.bincount(at, new_three, total) / held
    x[:, k + 4] = np.log1p(np.bincount(at, length > 14, total) / held)
    x[:, k + 5] = np.log1p(np.bincount(at, minlength=total))
    pair = (w.bytes[:-1].astype(np.int64) * 31 + w.bytes[1:]) % PAIR_BUCKETS
    own = np.ones(len(w.bytes), bool)
    own[w.starts[1:] - 1] = False  # no pair reaches into the next text
    at_pair = np.nonzero(own[: len(pair)])[0]
    of = np.repeat(np.arange(total), np.diff(edge))[at_pair]
    x[:, k + 6 :] = np.bincount(of * PAIR_BUCKETS + pair[at_pair], minlength=total * PAIR_BUCKETS).reshape(total, PAIR_BUCKETS) / size[:, None]
    return x, doc


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    layers: dict[str, np.ndarray] | None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x: np.ndarray, doc: np.ndarray, n: int, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    h = np.tanh(x @ p["encode"] + p["encode0"])
    t, g = np.tanh(h @ p["tanh"]), _sigmoid(h @ p["gate"])
    e = (t * g) @ p["weigh"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, doc, e)
    a = np.exp(e - top[doc])
    a /= np.bincount(doc, a, n)[doc]
    z = np.zeros((n, h.shape[1]))
    starts = np.concatenate(([0], np.nonzero(np.diff(doc))[0] + 1))
    z[doc[starts]] = np.add.reduceat(h * a[:, None], starts, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["out"] + p["out0"])}


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Model:
    """Full-batch Adam on the balanced log loss."""
    y = labels.astype(float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), None)
    raw, doc = passages(texts)
    mean, spread = raw.mean(axis=0), raw.std(axis=0) + 1e-3
    x, n = np.clip((raw - mean) / spread, -8, 8), len(y)
    rng = np.random.default_rng(seed)
    p = {"encode": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)), "encode0": np.zeros(HIDDEN), "tanh": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "gate": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "weigh": rng.normal(0, GATE**-0.5, GATE), "out": rng.normal(0, HIDDEN**-0.5, HIDDEN), "out0": np.zeros(1)}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / n
    for step in range(1, steps + 1):
        f = _forward(x, doc, n, p)
        d = (f["score"] - y) * weight
        dz = d[:, None] * p["out"]
        de = f["a"] * ((dz[doc] * f["h"]).sum(axis=1) - (dz * f["z"]).sum(axis=1)[doc])
        dtg = de[:, None] * p["weigh"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (dz[doc] * f["a"][:, None] + dt @ p["tanh"].T + dg @ p["gate"].T) * (1 - f["h"] ** 2)
        gradient = {"encode": x.T @ dh, "encode0": dh.sum(axis=0), "tanh": f["h"].T @ dt, "gate": f["h"].T @ dg, "weigh": (f["t"] * f["g"]).T @ de, "out": f["z"].T @ d, "out0": np.array([d.sum()])}
        for k in p:
            gk = gradient[k] + DECAY * p[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * gk, 0.99 * v[k] + 0.01 * gk**2
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Model(mean, spread, p)


def scores(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score of each text, number of its passages, largest attention weight)."""
    x, doc = passages(texts)
    n = len(texts)
    count = np.bincount(doc, minlength=n)
    if model.layers is None or not n:
        return np.full(n, 0.5), count, 1 / np.maximum(count, 1)
    f = _forward(np.clip((x - model.mean) / model.spread, -8, 8), doc, n, model.layers)
    most = np.zeros(n)
    np.maximum.at(most, doc, f["a"])
    return f["score"], count, most


def quality(text, model: Model):
    """Column (score, n_passages, top_weight) of the column `text`."""
    bounded_batches()

    @F.arrow_udf("struct<score:double,n_passages:bigint,top_weight:double>")
    def scored(column: pa.Array) -> pa.Array:
        found = [scores(part, model) for part in chunks(text_bytes(column))]
        score, count, most = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0),) * 3
        return pa.StructArray.from_arrays([pa.array(np.round(score, 9), pa.float64()), pa.array(count.astype(np.int64)), pa.array(most, pa.float64())], names=["score", "n_passages", "top_weight"])

    return scored(text)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", per_label: tuple[int, int] = SAMPLE, most_bytes: tuple[int, int] = SAMPLE_BYTES) -> Model:
    return fit(*labelled_sample(docs, labels, label_col, per_label, most_bytes, id_col, text_col))
