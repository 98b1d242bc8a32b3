"""Media columns as progressive JPEG: a payload of bytes is stored losslessly as coefficients.

The format's unit is the block of 64 quantised coefficients (all quantiser steps are 1). 64
payload bytes are one block, in zigzag order: the first is the DC coefficient (byte - 128),
each other an AC coefficient of magnitude 128 + low seven bits whose sign is the top bit. The
blocks fill a YCbCr 4:2:0 image: luma first, then Cb, then Cr; spare blocks hold zero bytes,
and an APP11 segment says how many blocks are payload.

Scans, as spectral selection and successive approximation have them: DC of all components
(less one bit), AC 1-5 and 6-63 of each component (less one bit), the AC refinement of each
component, the DC refinement. The decoder accumulates any such scans into coefficient arrays
(baseline Huffman tables of any shape, no restart intervals), reads the payload back from them, and
for pixels inverse-transforms in numpy, repeats chroma to full resolution and converts to
an RGB tensor of height x width x 3 bytes. Runs of equal codes and runs of blocks
without new coefficients are decoded as arrays; all else symbol by symbol.

Defined cases: a text of any length is one image, held whole with its coefficients (there are no ties); a null or empty text is 64 zero bytes; equal texts give equal files; a file that
is cut or is no such JPEG raises ValueError; rows that repeat are coded each; an empty
table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OUT_BYTES, bounded_batches, text_bytes

UNIT = 64
#: MCUs (six blocks) in a row of the image, unless it would have over `MOST_ROWS` rows (100 MB), which the format's 16 bits of height bound.
ROW_MCUS = 64
MOST_ROWS = 4095
MARK = b"UNITS"
DC_LOW, AC_LOW = 1, 1
BANDS = ((1, 5), (6, 63))
COMPONENTS = ((1, 2), (2, 1), (3, 1))  # (id, sampling factor either way)


def _zigzag() -> np.ndarray:
    """Natural position of each zigzag position."""
    order = sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
    return np.array(order)


ZIGZAG = _zigzag()
#: Code lengths of the symbols, in the order of their codes. DC: sizes 0 to 11, four bits each. AC: one
#: bit for a coefficient of seven bits, five for the runs of ended blocks.
DC_TABLE = [(4, s) for s in range(12)]
AC_TABLE = [(1, 0x07), *((5, n << 4) for n in range(15))]


def canonical(table: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """(code, length) of each symbol."""
    found, code, last = {}, 0, 0
    for length, symbol in table:
        code <<= length - last
        found[symbol] = (code, length)
        code, last = code + 1, length
    return found


@lru_cache(8)
def _codes(table: tuple[tuple[int, int], ...]) -> dict[int, tuple[int, int]]:
    return canonical(list(table))


@lru_cache(8)
def _peeked(table: tuple[tuple[int, int], ...]) -> tuple[list[int], list[int]]:
    """Symbol and code length for each 16 bits that lie ahead; length 0: no code."""
    symbols, lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for symbol, (code, length) in _codes(table).items():
        at = slice(code << (16 - length), (code + 1) << (16 - length))
        symbols[at], lengths[at] = symbol, length
    return symbols.tolist(), lengths.tolist()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, table: list[tuple[int, int]]) -> bytes:
    counts = np.bincount([n for n, _ in table], minlength=17)[1:]
    return _segment(0xC4, bytes([kind << 4]) + bytes(counts.tolist()) + bytes(s for _, s in table))


def _scan(components, first: int, last: int, high: int, low: int, packed: bytes) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, head) + packed.replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    spare = -len(bits) % 8
    return np.packbits(np.concatenate((bits, np.ones(spare, np.uint8)))).tobytes()


@lru_cache(256)
def _layout(mcus: int) -> tuple[int, int, np.ndarray]:
    """MCUs across and down; the number of each block, luma then Cb then Cr, in interleaved order."""
    across = max(min(mcus, ROW_MCUS), -(-mcus // MOST_ROWS))
    down = -(-mcus // across)
    y = np.arange(4 * across * down).reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    cb = y.size + np.arange(across * down)[:, None]
    return across, down, np.concatenate((y, cb, cb + len(cb)), axis=1).ravel()


_HEAD = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64)
_TABLES = _dht(0, DC_TABLE) + _dht(1, AC_TABLE)


def _run_bits(blocks: int) -> list[np.ndarray]:
    """The codes of runs of ended blocks that make up `blocks`, each with the number of its blocks."""
    codes, found = canonical(AC_TABLE), []
    while blocks:
        n = min(blocks, 32767)
        size = n.bit_length() - 1
        code, length = codes[size << 4]
        text = f"{code:0{length}b}" + (f"{n - (1 << size):0{size}b}" if size else "")
        found.append((np.frombuffer(text.encode(), np.uint8) - 48, n))
        blocks -= n
    return found


def encode(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as a progressive JPEG."""
    n = len(payload) // UNIT
    if not n or len(payload) % UNIT:
        raise ValueError("the payload is no positive multiple of 64 bytes")
    across, down, order = _layout(-(-n // 6))
    total = 6 * across * down
    raw = np.zeros((total, 64), np.uint8)
    raw[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    out = [_HEAD, _segment(0xEB, MARK + struct.pack(">Q", n))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + b"".join(bytes([c, s << 4 | s, 0]) for c, s in COMPONENTS)))
    out.append(_TABLES)

    dc = (raw[:, 0].astype(np.int64) - 128)[order]
    high = dc >> DC_LOW
    of = np.tile([0, 0, 0, 0, 1, 2], across * down)
    step = np.empty(total, np.int64)
    for c in range(3):
        own = of == c
        step[own] = np.diff(high[own], prepend=0)
    size = np.ceil(np.log2(np.abs(step) + 1)).astype(np.int64)
    value = np.where(step < 0, step + (1 << size) - 1, step)
    word, length = size << size | value, size + 4
    end = np.cumsum(length)
    place = np.arange(int(end[-1])) - np.repeat(end - length, length)
    bits = np.repeat(word, length) >> (np.repeat(length, length) - 1 - place) & 1
    every = [c for c, _ in COMPONENTS]
    out.append(_scan(every, 0, 0, 0, DC_LOW, _packed(bits.astype(np.uint8))))

    edges = [0, 4 * across * down, 5 * across * down, total]
    low = raw & 127
    tops = (128 + low) >> AC_LOW
    tops = np.where(raw >> 7, 127 - tops, tops).astype(np.uint8)
    # The code 0 and seven bits are one byte of the scan.
    coded = np.unpackbits(tops[:, :, None], axis=2)
    for c, (s, e) in zip(every, zip(edges, edges[1:])):
        for first, last in BANDS:
            out.append(_scan([c], first, last, 0, AC_LOW, _packed(coded[s:e, first : last + 1].ravel())))
    for bit in range(AC_LOW - 1, -1, -1):
        plane = low[:, 1:] >> bit & 1
        for c, (s, e) in zip(every, zip(edges, edges[1:])):
            parts = []
            for head, count in _run_bits(e - s):
                parts += [head, plane[s : s + count].ravel()]
                s += count
            out.append(_scan([c], 1, 63, bit + 1, bit, _packed(np.concatenate(parts))))
    for bit in range(DC_LOW - 1, -1, -1):
        out.append(_scan(every, 0, 0, bit + 1, bit, _packed((dc >> bit & 1).astype(np.uint8))))
    return b"".join([*out, b"\xff\xd9"])


class _Bits:
    """The bits of a scan, as an array (made when it is first needed) and, for symbol by symbol reading, from its bytes."""

    def __init__(self, data: bytes):
        self.octets = np.frombuffer(data, np.uint8)
        self.end = 8 * len(data)
        self.data = data + b"\xff" * 4
        self.at = 0

    @cached_property
    def bits(self) -> np.ndarray:
        return np.unpackbits(self.octets)

    def take(self, n: int) -> np.ndarray:
        found = self.bits[self.at : self.at + n]
        if len(found) < n:
            raise ValueError("the scan is cut")
        self.at += n
        return found

    def number(self, n: int) -> int:
        """The next n bits, 16 at most."""
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise ValueError("the scan is cut")
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 3]) >> (24 - (at & 7) - n) & (1 << n) - 1

    def symbol(self, peeked: tuple[list[int], list[int]]) -> int:
        at = self.at
        w = int.from_bytes(self.data[at >> 3 : (at >> 3) + 3]) >> (8 - (at & 7)) & 0xFFFF
        length = peeked[1][w]
        if not length or at + length > self.end:
            raise ValueError("the scan is cut or holds no code")
        self.at = at + length
        return peeked[0][w]


def _extend(value: int, size: int) -> int:
    return value - (1 << size) + 1 if size and value < 1 << (size - 1) else value


def _dc_first(bits: _Bits, held: list[np.ndarray], order: list[tuple[int, int]], tables: list[tuple], low: int) -> None:
    peeked = [_peeked(t) for t in tables]
    last = [0] * len(held)
    values = [[] for _ in held]
    places = [[] for _ in held]
    for c, block in order:
        size = bits.symbol(peeked[c])
        last[c] += _extend(bits.number(size), size)
        values[c].append(last[c])
        places[c].append(block)
    for coefficients, v, at in zip(held, values, places):
        coefficients[at, 0] = np.array(v, np.int32) << low


def _ac_first(bits: _Bits, c: np.ndarray, blocks: np.ndarray, table: tuple, first: int, last: int, low: int) -> None:
    codes, peeked = _codes(table), _peeked(table)
    band = last - first + 1
    flat = np.zeros(len(blocks) * band, np.int32)
    at, end = 0, len(flat)
    while at < end:
        before = bits.at
        symbol = bits.symbol(peeked)
        run, size = symbol >> 4, symbol & 15
        if symbol and not run:
            # As many coefficients as follow with the same code.
            code, length = codes[symbol]
            stride = length + size
            n = min(end - at, (bits.end - before) // stride)
            if stride == 8 and not before & 7:
                octets = bits.octets[before >> 3 : (before >> 3) + n].astype(np.int32)
                same, value = octets >> size == code, octets & (1 << size) - 1
            else:
                groups = bits.bits[before : before + n * stride].reshape(n, stride)
                same = np.ones(n, bool)
                for i, bit in enumerate(f"{code:0{length}b}"):
                    same &= groups[:, i] == int(bit)
                packed = np.packbits(groups[:, length:], axis=1).astype(np.int32)
                value = packed[:, 0] >> (8 - size) if size <= 8 else (packed[:, 0] << 8 | packed[:, 1]) >> (16 - size)
            n = n if same.all() else int(np.argmin(same))
            if not n:
                raise ValueError("the scan is cut")
            value = value[:n]
            flat[at : at + n] = np.where(value < 1 << (size - 1), value - (1 << size) + 1, value)
            at, bits.at = at + n, before + n * stride
        elif size:
            at += run
            if at >= end:
                raise ValueError("a run leaves the scan")
            flat[at] = _extend(bits.number(size), size)
            at += 1
        elif run == 15:
            at += 16
        else:
            at = (at // band + (1 << run) + bits.number(run)) * band
    c[blocks, first : last + 1] = flat.reshape(-1, band) << low


def _ac_refine(bits: _Bits, c: np.ndarray, blocks: np.ndarray, table: tuple, first: int, last: int, low: int) -> None:
    one, peeked = 1 << low, _peeked(table)
    part = c[blocks, first : last + 1]
    band, k, block = last - first + 1, 0, 0

    def correct(values: np.ndarray) -> None:
        known = values != 0
        if known.all():
            values += np.sign(values) * (bits.take(len(values)).astype(np.int32) << low)
        else:
            values[known] += np.sign(values[known]) * (bits.take(int(known.sum())).astype(np.int32) << low)

    while block < len(part):
        row = part[block]
        symbol = bits.symbol(peeked)
        run, size = symbol >> 4, symbol & 15
        if size == 0 and run < 15:
            count = (1 << run) + bits.number(run)
            correct(part[block : block + count].reshape(-1)[k:])
            block, k = block + count, 0
            continue
        fresh = (one if bits.number(1) else -one) if size else 0
        while k < band:
            if row[k]:
                if bits.number(1):
                    row[k] += one if row[k] > 0 else -one
            elif run == 0:
                row[k] = fresh
                k += 1
                break
            else:
                run -= 1
            k += 1
        if k >= band:
            block, k = block + 1, 0
    c[blocks, first : last + 1] = part


@lru_cache(256)
def _own_blocks(across: int, down: int, wide: int) -> np.ndarray:
    """Blocks of a component that a scan of it alone holds, in order."""
    return (np.arange(down)[:, None] * wide + np.arange(across)).ravel()


@lru_cache(256)
def _interleaved(across: int, down: int, parts: tuple[tuple[int, int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Block and component of each step of an interleaved scan."""
    mcu = np.arange(across * down)
    at, which = [], []
    for i, (h, v, wide) in enumerate(parts):
        for y in range(v):
            for x in range(h):
                at.append((mcu // across * v + y) * wide + mcu % across * h + x)
                which.append(np.full(len(mcu), i))
    return np.stack(at, axis=1).ravel(), np.stack(which, axis=1).ravel()


@lru_cache(1)
def _basis() -> np.ndarray:
    """Cosines of the inverse transform."""
    k = np.arange(8)
    return (np.sqrt(np.where(k == 0, 1, 2) / 8)[:, None] * np.cos((2 * k + 1) * k[:, None] * np.pi / 16)).astype(np.float32)


class Image:
    """Coefficient arrays (blocks x 64, zigzag order, rows of blocks padded to whole MCUs) of each component."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        self.units, self.quantisers, tables, at = None, {}, {}, 2
        self.components: list[dict] = []
        while True:
            if data[at : at + 1] != b"\xff" or at + 2 > len(data):
                raise ValueError("the file is cut")
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4])
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xEB and body.startswith(MARK):
                self.units = int.from_bytes(body[len(MARK) :])
            elif marker == 0xDB:
                while body:
                    if body[0] >> 4:
                        raise ValueError("16-bit quantisers")
                    self.quantisers[body[0] & 15], body = np.frombuffer(body[1:65], np.uint8).astype(np.int32), body[65:]
            elif marker == 0xC4:
                while body:
                    counts, n = body[1:17], sum(body[1:17])
                    lengths = [i + 1 for i, m in enumerate(counts) for _ in range(m)]
                    tables[body[0]], body = tuple(zip(lengths, body[17 : 17 + n])), body[17 + n :]
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xDA:
                end = at
                while (end := data.find(b"\xff", end)) >= 0 and data[end + 1 : end + 2] == b"\0":
                    end += 2
                if end < 0:
                    raise ValueError("the file is cut")
                self._scan(body, data[at:end].replace(b"\xff\0", b"\xff"), tables)
                at = end
            elif marker in (0xC0, 0xC1, 0xDD):
                raise ValueError("not progressive, or with restart intervals")

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        self.h, self.v = max(p[1] for p in parts), max(p[2] for p in parts)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for i, h, v, q in parts:
            wide, high = self.across * h, self.down * v
            own = (-(-(-(-self.width * h // self.h)) // 8), -(-(-(-self.height * v // self.v)) // 8))
            self.components.append({"id": i, "h": h, "v": v, "q": q, "wide": wide, "high": high, "own": own, "c": np.zeros((wide * high, 64), np.int32)})

    def _scan(self, body: bytes, data: bytes, tables: dict) -> None:
        n = body[0]
        parts = [next(k for k in self.components if k["id"] == body[1 + 2 * i]) for i in range(n)]
        ids = [body[2 + 2 * i] for i in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        bits = _Bits(data)
        if first == 0:
            if n == 1:
                at = _own_blocks(*parts[0]["own"], parts[0]["wide"])
                which = np.zeros(len(at), np.int64)
            else:
                at, which = _interleaved(self.across, self.down, tuple((k["h"], k["v"], k["wide"]) for k in parts))
            if high:
                found = bits.take(len(at)).astype(np.int32) << low
                for i, k in enumerate(parts):
                    k["c"][at[which == i], 0] |= found[which == i]
            else:
                _dc_first(bits, [k["c"] for k in parts], list(zip(which.tolist(), at.tolist())), [tables[t >> 4] for t in ids], low)
        else:
            (_ac_refine if high else _ac_first)(bits, parts[0]["c"], _own_blocks(*parts[0]["own"], parts[0]["wide"]), tables[0x10 | ids[0] & 15], first, last, low)

    def payload(self) -> bytes:
        """The bytes that `encode` stored."""
        if self.units is None:
            raise ValueError("the file holds no payload")
        c = np.concatenate([k["c"] for k in self.components])[: self.units]
        raw = (np.abs(c) - 128 | (c < 0) << 7).astype(np.uint8)
        raw[:, 0] = c[:, 0] + 128
        return raw.tobytes()

    def planes(self) -> list[np.ndarray]:
        """Samples 0 to 255 of each component, as float, at its own resolution."""
        basis, found = _basis(), []
        for part in self.components:
            natural = np.empty(part["c"].shape, np.float32)
            natural[:, ZIGZAG] = part["c"] * self.quantisers[part["q"]]
            rows = (natural.reshape(-1, 8) @ basis).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ basis
            pixels = rows.reshape(part["high"], part["wide"], 8, 8).transpose(0, 3, 1, 2).reshape(part["high"] * 8, part["wide"] * 8)
            found.append(np.clip(pixels + 128, 0, 255))
        return found

    def rgb(self) -> np.ndarray:
        """height x width x 3 bytes; chroma repeated to full resolution."""
        planes = self.planes()
        full = [np.repeat(np.repeat(p, self.v // k["v"], axis=0), self.h // k["h"], axis=1)[: self.height, : self.width] for p, k in zip(planes, self.components)]
        if len(full) == 1:
            return np.repeat(np.rint(full[0])[:, :, None], 3, axis=2).astype(np.uint8)
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        out = np.empty((*y.shape, 3), np.uint8)
        for k, plane in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
            out[:, :, k] = np.rint(np.clip(plane, 0, 255))
        return out


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def feature(rgb: np.ndarray) -> str:
    """Height, width, and mean and deviation of each channel."""
    planes = np.ascontiguousarray(rgb.reshape(-1, 3).T)
    n = planes.shape[1]
    mean = planes.sum(axis=1, dtype=np.int64) / n
    squares = np.array([np.dot(c, c) for c in (p.astype(np.float64) for p in planes)])
    spread = np.sqrt(np.maximum(squares / n - mean**2, 0))
    return f"{rgb.shape[0]}x{rgb.shape[1]}:" + ",".join(f"{m:.4f}/{s:.4f}" for m, s in zip(mean, spread))


def _flushed(rows: Iterator[tuple[int, int, tuple]], batch: pa.RecordBatch, types: list[pa.DataType], names: list[str], drop: int) -> Iterator[pa.RecordBatch]:
    """Batches of about OUT_BYTES of the rows' new values beside the old columns but number `drop`."""
    held, size, start = [], 0, 0
    for n, (k, more, values) in enumerate(rows):
        held.append(values)
        size += more
        if size >= OUT_BYTES or k == batch.num_rows - 1:
            old = [c.slice(start, len(held)) for i, c in enumerate(batch.columns) if i != drop]
            yield pa.RecordBatch.from_arrays([*old, *(pa.array(c, t) for c, t in zip(zip(*held), types))], names=names)
            held, size, start = [], 0, k + 1


def _encode_batches(batches: Iterator[pa.RecordBatch], drop: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = text_bytes(b.column(drop))
        rows = ((k, len(t) * 2 + 800, (len(t), encode(padded(t)))) for k, t in enumerate(texts))
        yield from _flushed(rows, b, [pa.int64(), pa.binary()], names, drop)


def _decode_batches(batches: Iterator[pa.RecordBatch], drop: int, names: list[str], tensors: bool) -> Iterator[pa.RecordBatch]:
    def read(data: bytes) -> tuple:
        image = Image(data)
        rgb = image.rgb()
        return image.payload(), image.height, image.width, rgb.tobytes() if tensors else None, feature(rgb)

    for b in batches:
        rows = ((k, len(m) * (4 if tensors else 2), read(m)) for k, m in enumerate(b.column(drop).to_pylist()))
        yield from _flushed(rows, b, [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string()], names, drop)


def _mapped(df: DataFrame, without: str, more: str, stage) -> DataFrame:
    """What `stage` makes of `df`: the columns `more` in place of `without` and of those of their own names."""
    bounded_batches()
    fresh = [x.split()[0] for x in more.split(", ")]
    kept = [f for f in df.schema if f.name != without and f.name not in fresh]
    # Numbered on the way, as names with dots can't be given to a mapped function.
    rows = df.select(*(F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(kept)), F.col(f"`{without}`").alias("old"))
    schema = ", ".join([*(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(kept)), more])
    names = [f"c{k}" for k in range(len(kept))] + fresh
    return rows.mapInArrow(partial(stage, drop=len(kept), names=names), schema).toDF(*(f.name for f in kept), *fresh)


def encode_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `n_bytes` and `media`, its texts as progressive JPEG, in place of the text column; columns of those names are replaced."""
    return _mapped(docs, text_col, "n_bytes long, media binary", _encode_batches)


def decode_media(media: DataFrame, media_col: str = "media", tensors: bool = True) -> DataFrame:
    """`media` with `payload`, `height`, `width`, `rgb` (the tensor's bytes; null without `tensors`) and `feature` in place of the media column; columns of those names are replaced."""
    return _mapped(media, media_col, "payload binary, height int, width int, rgb binary, feature string", partial(_decode_batches, tensors=tensors))


def media_digest(media: DataFrame) -> DataFrame:
    """The stored forms beside their own size and hash."""
    return media.withColumn("media_bytes", F.length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
