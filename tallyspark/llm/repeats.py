"""Substring dedup: fixed-block anchors, probed by every rolling window, extended to maximal exact repeats.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A run of `WINDOW` words that stands twice holds, wherever it
starts, one whole block of its first text's non-overlapping blocks of `BLOCK` words, as two blocks less one word
are shorter than a window. So the blocks of all texts are the index; every rolling run of `BLOCK` words of every
text is a probe; and a block that a probe meets elsewhere is an *anchor*. Around each occurrence of an anchor
the text is extended to both sides as far as a window reaches; of the windows found there
the first occurrence over all documents stays and the words of the others go. Neighbouring windows make up the maximal repeats.

Texts are packed once into *packs* of some `PACK` words (a vocabulary and codes, compressed), the only form that is read
again. Index and probes are dealt by hash to buckets, each pack's hashes once; an anchor goes back to the packs that hold it,
never to pairs of documents, so a passage that a third of all documents share costs a row for each pack. The windows around anchors
are dealt the same way, with the place of their first occurrence in the pack. Anchors are told by 40 bits or more
(a false one costs time, no words); windows by 74 bits or more of two independent hashes, one more with each doubling of the corpus.

Defined cases: null and empty texts have no words, nothing is removed and the kept text is empty. Ids are integers; rows with a null id
come after all others; rows that share an id are documents of their own, ordered as they were read. Ties are thus none.
A text over `PIECE_BYTES` is cut into pieces that overlap by a window, so that memory doesn't grow with it (its kept
text is put together in one row). An empty table gives an empty result; columns beside id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded_batches, text_bytes
from .features import mixed

WINDOW, BLOCK = 20, 10
#: Words of a pack, and bytes beyond which a text has packs of its own.
PACK, PIECE_BYTES = 1 << 18, 2 << 20
#: There are two to this many buckets, or more where a bucket would have over BUCKET_WORDS words of the corpus.
BUCKET_BITS, BUCKET_WORDS = 10, 1 << 22
#: Bits of an anchor's hash beside its bucket's.
REST = 30
LAST = np.iinfo(np.int64).max
#: Odd factors of the two hashes of a run of words.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_GAP = re.compile(rb"[\x20\x09-\x0D]")

PACKED = "piece boolean, n long, ids array<long>, rows array<long>, firsts array<long>, leads array<int>, owns array<int>, sizes array<int>, vocabulary binary, codes binary"


def _cuts(text: bytes, least: int, size: int) -> Iterator[list[bytes]]:
    """The words of a text in lists of some `size` bytes and at least `least` words, but for the last."""
    at, held = 0, []
    while at < len(text):
        gap = _GAP.search(text, min(at + size, len(text)))
        end = gap.end() if gap else len(text)
        held += text[at:end].split()
        at = end
        if len(held) >= least or at == len(text):
            yield held
            held = []


def pieces(text: bytes, reach: int, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(number of the first word, words before the piece's own, its own words, words): each piece has up to `reach` words of either neighbour."""
    start, before, own = 0, [], None
    for words in chain(_cuts(text, reach, size), [None]):
        if own is not None:
            yield start - len(before), len(before), len(own), before + own + (words or [])[:reach]
            start, before = start + len(own), own[-reach:]
        own = words


def _packed(piece: bool, held: list[tuple]) -> pa.RecordBatch:
    ids, rows, firsts, leads, owns, words = zip(*held)
    flat = np.empty(sum(map(len, words)), object)
    flat[:] = list(chain.from_iterable(words))
    codes, vocabulary = pd.factorize(flat)
    squeeze = zstandard.ZstdCompressor(1).compress
    codes = codes.astype(np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32)
    values = [piece, sum(owns), ids, rows, firsts, leads, owns, list(map(len, words)), squeeze(b" ".join(vocabulary)), squeeze(codes.tobytes())]
    kinds = [pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 3, *[pa.list_(pa.int32())] * 3, pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in PACKED.split(", ")])


def _pack_batches(batches: Iterator[pa.RecordBatch], window: int, pack: int, size: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        for key, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2))):
            key = LAST if key is None else key
            if len(text) > size:
                for first, lead, own, words in pieces(text, window - 1, size):
                    yield _packed(True, [(key, row, first, lead, own, words)])
                continue
            words = text.split()
            held.append((key, row, 0, 0, len(words), words))
            n += len(words)
            if n >= pack or len(held) >= pack:
                yield _packed(False, held)
                held, n = [], 0
    if held:
        yield _packed(False, held)


@lru_cache(4)
def _powers(n: int, factor: int) -> tuple[np.ndarray, np.ndarray]:
    def up(x):
        return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))))

    return up(factor), up(pow(factor, -1, 1 << 64))


def run_hashes(words: np.ndarray, k: int, factor: int) -> np.ndarray:
    """A hash of each run of `k` words, given the words' hashes; from running sums, so in the same time for any `k`."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << n.bit_length(), factor)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:n])))
    return mixed((sums[k:] - sums[:-k]) * down[: n - k + 1])


class Pack:
    """A pack, read: codes and hashes of its words; for each word its entry (a text or piece), and the words of the entry from it on."""

    def __init__(self, row: dict):
        expand = zstandard.ZstdDecompressor().decompress
        self.piece = row["piece"]
        self.ids, self.rows, self.firsts, self.leads, self.owns, sizes = (np.array(row[c], np.int64) for c in ("ids", "rows", "firsts", "leads", "owns", "sizes"))
        self.vocabulary = expand(row["vocabulary"]).split(b" ")
        codes, n = expand(row["codes"]), int(sizes.sum())
        self.codes = np.frombuffer(codes, np.uint16 if len(codes) == 2 * n else np.uint32)
        each = np.fromiter(map(xxhash.xxh64_intdigest, self.vocabulary), np.uint64, len(self.vocabulary))
        self.words = each[self.codes] if n else np.zeros(0, np.uint64)
        self.starts = np.cumsum(sizes) - sizes
        self.ends = self.starts + sizes
        self.entry = np.repeat(np.arange(len(sizes)), sizes)
        self.left = self.ends[self.entry] - np.arange(n)

    def blocks(self, block: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, key) of each rolling run of `block` words; a key is its bucket and the rest, in one number."""
        runs = run_hashes(self.words, block, FACTORS[0])
        at = np.nonzero(self.left[: len(runs)] >= block)[0]
        return at, runs[at] >> np.uint64(64 - bits - REST)

    def repeats(self, anchors: np.ndarray, window: int, block: int, bits: int) -> Windows:
        """The windows around the occurrences of these anchors."""
        at, keys = self.blocks(block, bits)
        met = np.zeros(len(self.words) + 1, np.int64)
        if len(anchors):
            spot = np.minimum(np.searchsorted(anchors, keys), len(anchors) - 1)
            met[at[anchors[spot] == keys] + 1] = 1
        met = np.cumsum(met)
        starts = np.nonzero(self.left >= window)[0]
        return Windows(self, starts[met[starts + window - block + 1] > met[starts]], window, bits)


class Windows:
    """Windows of a pack. `first`: those that stand for all windows of the same words in the pack, sorted by
    bucket and place; `again`: the starts of the others."""

    def __init__(self, pack: Pack, starts: np.ndarray, window: int, bits: int):
        rank = np.empty(len(pack.ids), np.int64)
        rank[np.lexsort((pack.firsts, pack.rows, pack.ids))] = np.arange(len(pack.ids))
        a, b = (run_hashes(pack.words, window, f)[starts] for f in FACTORS)
        place = rank[pack.entry[starts]]
        order = np.lexsort((starts, place, b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        self.again = starts[order[~new]]
        first = order[new]
        bucket = (a >> np.uint64(64 - bits)).astype(np.int64)
        first = first[np.lexsort((starts[first], place[first], bucket[first]))]
        self.starts, self.bucket, self.hash = starts[first], bucket[first], b[first]
        entry = pack.entry[self.starts]
        # A text that isn't cut lies in one pack, where its first place is known, so the start needn't be told.
        inside = pack.firsts[entry] + self.starts - pack.starts[entry]
        self.keys = (pack.ids[entry], pack.rows[entry], inside if pack.piece else np.zeros_like(inside))


def _sliced(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values that are neighbouring slices of an array."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a sorted array, and how often each stands there."""
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    return bucket[edges], np.diff(np.append(edges, len(bucket)))


PROBES = "bucket int, pack long, data binary"


def _probe_batches(batches: Iterator[pa.RecordBatch], block: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Each distinct block hash of a pack, its two low bits telling whether it is one of the index and whether the pack has it twice."""
    for b in batches:
        for row in b.to_pylist():
            pack = Pack(row)
            at, keys = pack.blocks(block, bits)
            entry = pack.entry[at]
            indexed = (pack.firsts[entry] + at - pack.starts[entry]) % block == 0
            order = np.argsort(keys, kind="stable")
            keys, indexed = keys[order], indexed[order]
            _, counts = _by_bucket(keys)
            if not len(counts):
                continue
            edges = np.cumsum(counts) - counts
            flags = np.logical_or.reduceat(indexed, edges).astype(np.uint32) | ((counts > 1).astype(np.uint32) << np.uint32(1))
            keys = keys[edges]
            buckets, lengths = _by_bucket((keys >> np.uint64(REST)).astype(np.int32))
            data = ((keys & np.uint64((1 << REST) - 1)).astype(np.uint32) << np.uint32(2)) | flags
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.full(len(buckets), row["pack"], np.int64)), _sliced(data, lengths)], names=["bucket", "pack", "data"])


def _gathered(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def _answers(table: pa.Table, mask: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> pa.Table:
    """For each row of the table that has any of the masked values, these."""
    owner = np.repeat(np.arange(len(lengths)), lengths)[mask]
    rows, counts = _by_bucket(owner)
    kept = table.select(["bucket", "pack"]).take(pa.array(rows))
    return kept.append_column("data", _sliced(values[mask], counts))


def _anchors_of_bucket(table: pa.Table) -> pa.Table:
    values, lengths = _gathered(table["data"], np.uint32)
    order = np.argsort(values, kind="stable")
    rest = values[order] >> np.uint32(2)
    edges = np.flatnonzero(np.concatenate(([True], rest[1:] != rest[:-1])))
    counts = np.diff(np.append(edges, len(rest)))
    flags = np.bitwise_or.reduceat(values[order] & np.uint32(3), edges)
    anchor = ((flags & 1) > 0) & ((counts > 1) | (flags > 1))
    mask = np.zeros(len(values), bool)
    mask[order] = np.repeat(anchor, counts)
    return _answers(table, mask, values >> np.uint32(2), lengths)


def _keys_of(row: dict) -> np.ndarray:
    """Sorted keys of the anchors that came back to a pack."""
    found = [(np.uint64(a["bucket"]) << np.uint64(REST)) | np.frombuffer(a["data"], np.uint32).astype(np.uint64) for a in row["anchors"] or ()]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _window_batches(batches: Iterator[pa.RecordBatch], window: int, block: int, bits: int) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(1).compress
    for b in batches:
        for row in b.to_pylist():
            found = Pack(row).repeats(_keys_of(row), window, block, bits)
            buckets, lengths = _by_bucket(found.bucket)
            if not len(buckets):
                continue
            places, ends = [], np.cumsum(lengths)
            for low, high in zip((ends - lengths).tolist(), ends.tolist()):
                places.append(squeeze(np.diff(np.stack([k[low:high] for k in found.keys]), prepend=0).tobytes()))
            columns = [pa.array(buckets.astype(np.int32)), pa.array(np.full(len(buckets), row["pack"], np.int64)), _sliced(found.hash, lengths), pa.array(places, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "pack", "data", "places"])


def _later_in_bucket(table: pa.Table) -> pa.Table:
    """For each pack a bit for each of its windows in this bucket: 1 where the same words stand earlier in another."""
    expand = zstandard.ZstdDecompressor().decompress
    values, lengths = _gathered(table["data"], np.uint64)
    places = np.concatenate([np.cumsum(np.frombuffer(expand(x), np.int64).reshape(3, -1), axis=1) for x in table["places"].to_pylist()], axis=1)
    order = np.lexsort((*places[::-1], values))
    edges = np.flatnonzero(np.concatenate(([True], values[order][1:] != values[order][:-1])))
    least = np.repeat(order[edges], np.diff(np.append(edges, len(order))))
    later = np.zeros(len(values), bool)
    later[order] = (places[:, order] != places[:, least]).any(axis=0)
    ends = np.cumsum(lengths)
    bits = [np.packbits(later[low:high]).tobytes() for low, high in zip((ends - lengths).tolist(), ends.tolist())]
    told = table.select(["bucket", "pack"]).append_column("data", pa.array(bits, pa.binary()))
    return told.filter(pa.array([any(x) for x in bits]))


FOUND = "id long, row long, first long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"


def _kept_batches(batches: Iterator[pa.RecordBatch], window: int, block: int, bits: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            pack = Pack(row)
            gone = np.zeros(len(pack.words) + 1, np.int64)
            if row["anchors"]:
                found = pack.repeats(_keys_of(row), window, block, bits)
                later = np.zeros(len(found.starts), bool)
                for x in row["later"] or ():
                    low, high = np.searchsorted(found.bucket, (x["bucket"], x["bucket"] + 1))
                    later[low:high] = np.unpackbits(np.frombuffer(x["data"], np.uint8), count=high - low).astype(bool)
                starts = np.concatenate((found.again, found.starts[later]))
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            out = []
            for k in range(len(pack.ids)):
                low = int(pack.starts[k] + pack.leads[k])
                high = low + int(pack.owns[k])
                mask, codes, first = gone[low:high], pack.codes[low:high], int(pack.firsts[k] + pack.leads[k])
                edges = np.flatnonzero(np.diff(mask, prepend=False, append=False)).reshape(-1, 2) + first
                text = b" ".join(map(pack.vocabulary.__getitem__, codes[~mask].tolist())).decode()
                key = int(pack.ids[k])
                out.append({"id": None if key == LAST else key, "row": int(pack.rows[k]), "first": first, "n_words": high - low, "n_removed": int(mask.sum()), "removed": [{"start": s, "end": e} for s, e in edges.tolist()], "kept": text})
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_SCHEMA = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("first", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(_SPAN)), ("kept", pa.string())])


def _joined_pieces(found: DataFrame) -> DataFrame:
    """One row for each text of those that were cut; a run over an edge is one."""
    part = F.struct("first", "removed", "kept")
    grown = found.groupBy("row").agg(F.first("id").alias("id"), F.sum("n_words").alias("n_words"), F.sum("n_removed").alias("n_removed"), F.sort_array(F.collect_list(part)).alias("parts"))
    spans = F.flatten(F.transform("parts", lambda p: p["removed"]))
    none = F.array().cast("array<struct<start:long,end:long>>")
    merged = F.aggregate(spans, none, lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] == s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), s["end"].alias("end"))))).otherwise(F.concat(done, F.array(s))))
    kept = F.array_join(F.filter(F.transform("parts", lambda p: p["kept"]), lambda t: t != ""), " ")
    return grown.select("id", "n_words", "n_removed", merged.alias("removed"), kept.alias("kept"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, pack: int = PACK, piece_bytes: int = PIECE_BYTES, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(id, n_words, n_removed, removed, kept) of each row: `kept` has the words that stay, joined by a space; `removed` the runs of words that go, as word numbers, the end exclusive.

    A word goes where a run of `window` words over it stands earlier too: in a row with a smaller id, or before in the same text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("ids are integers, as their order says which occurrence is the first")
    block = (window + 1) // 2
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    bounded_batches()
    packs = rows.mapInArrow(partial(_pack_batches, window=window, pack=pack, size=piece_bytes), PACKED)
    packs = Written(packs.withColumn("pack", F.monotonically_increasing_id()), "repeats-packs").df
    words = packs.agg(F.sum("n")).first()[0] or 0
    bits = max(BUCKET_BITS, (words // bucket_words).bit_length())
    told = {"block": block, "bits": bits}
    by_pack = lambda df, name: df.groupBy("pack").agg(F.collect_list(F.struct("bucket", "data")).alias(name))
    probes = packs.mapInArrow(partial(_probe_batches, **told), PROBES)
    anchors = Written(probes.groupBy("bucket").applyInArrow(_anchors_of_bucket, PROBES), "repeats-anchors").df
    held = packs.join(by_pack(anchors, "anchors"), "pack", "left")
    near = held.where("anchors is not null").mapInArrow(partial(_window_batches, window=window, **told), f"{PROBES}, places binary")
    later = Written(near.groupBy("bucket").applyInArrow(_later_in_bucket, PROBES), "repeats-later").df
    held = held.join(by_pack(later, "later"), "pack", "left")
    whole, cut = (held.where(c).mapInArrow(partial(_kept_batches, window=window, **told), FOUND) for c in (~F.col("piece"), F.col("piece")))
    found = whole.select("id", "n_words", "n_removed", "removed", "kept").unionByName(_joined_pieces(cut))
    return found.withColumn("id", F.col("id").cast(kind))
