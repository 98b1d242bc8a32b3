import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import media
from tallyspark.llm.queries import op4_progressive_jpeg

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [64, 128, 384, 448, 64 * 65 * 6, 64 * 4001])
def test_round_trip(n):
    for payload in (bytes(n), b"\xff" * n, np.random.default_rng(n).bytes(n)):
        image = media.Image(media.encode(payload))
        assert image.payload() == payload


def slow_samples(c):
    """The inverse transform by its definition."""
    out = np.zeros((8, 8))
    natural = np.zeros(64)
    natural[media.ZIGZAG] = c
    f = natural.reshape(8, 8)
    scale = [np.sqrt(0.5)] + [1] * 7
    for y in range(8):
        for x in range(8):
            out[y, x] = sum(scale[u] * scale[v] * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4
    return np.clip(out + 128, 0, 255)


def test_pixels_and_chroma():
    image = media.Image(media.encode(np.random.default_rng(3).bytes(64 * 12)))
    planes = image.planes()
    assert np.allclose(planes[0][:8, 8:16], slow_samples(image.components[0]["c"][1]), atol=0.05)
    rgb = image.rgb()
    assert rgb.shape == (image.height, image.width, 3) == (16, 32, 3)
    y, cb, cr = planes[0][5, 20], planes[1][2, 10] - 128, planes[2][2, 10] - 128
    assert np.abs(rgb[5, 20] - np.clip([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 0, 255)).max() <= 0.51


def bits(text):
    text = text.replace(" ", "")
    return int((text + "1" * (-len(text) % 8)), 2).to_bytes((len(text) + 7) // 8)


def test_runs_of_zeros_and_new_coefficients_in_refinements():
    """A grey image of one block, coded by hand: runs, a run of 16, ended blocks, coefficients that appear late."""
    table = [(2, 0x00), (3, 0x11), (3, 0xF0), (3, 0x01), (4, 0x21)]  # codes 00 010 011 100 1010
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + b"\1" * 64) + media._segment(0xC2, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])) + media._dht(0, media.DC_TABLE) + media._dht(1, table)
    scans = media._scan([1], 0, 0, 0, 0, bits("0011 101"))  # DC +5
    scans += media._scan([1], 1, 63, 0, 1, bits("010 1  011 1010 0  00"))  # at 2: +1; 16 zeros, 2 zeros, then -1 at 21; end
    # one zero skipped before the first new coefficient (1: zero, 2: known, corrected +1), new +1 at 3; then the rest ends and 21 is corrected
    scans += media._scan([1], 1, 63, 1, 0, bits("010 1 1  00 1"))
    image = media.Image(head + scans + b"\xff\xd9")
    c = image.components[0]["c"][0]
    assert {k: int(v) for k, v in enumerate(c) if v} == {0: 5, 2: 3, 3: 1, 21: -3}
    assert image.rgb().shape == (8, 8, 3)


def test_bad_files_raise():
    good = media.encode(bytes(64))
    for bad in (b"", b"nothing", good[:40], good[:-2], good[: len(good) // 2]):
        with pytest.raises(ValueError):
            media.Image(bad)
    with pytest.raises(ValueError):
        media.encode(b"abc")


def test_query_reads_back_the_payload(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op4_progressive_jpeg(spark, SF).collect():
        p = media.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "é" * 70000, None), (3, "x", 7), (4, "x", 7)], "doc_id long, text string, rgb int")
    stored = media.encode_texts(docs)
    assert stored.columns == ["doc_id", "rgb", "n_bytes", "media"]
    got = media.decode_media(stored.drop("rgb")).collect()
    by = {(r.doc_id, r.n_bytes): r for r in got}
    assert by[1, 0].payload == bytes(64) == by[2, 0].payload and by[3, 1].payload == by[4, 1].payload and by[3, 1].rgb == by[4, 1].rgb
    assert bytes(by[3, 140000].payload).rstrip(b"\0") == ("é" * 70000).encode() and len(by[3, 140000].rgb) == by[3, 140000].height * by[3, 140000].width * 3
    assert media.decode_media(media.encode_texts(docs.limit(0)).drop("rgb")).count() == 0


def test_very_long_texts_stay_within_the_format():
    for mcus in (1, 63, 64, 65, 64 * 4095, 64 * 4095 + 1, 5_000_000):
        across, down = max(min(mcus, media.ROW_MCUS), -(-mcus // media.MOST_ROWS)), 0
        down = -(-mcus // across)
        assert 16 * down <= 65_535 and 16 * across <= 65_535 and across * down >= mcus
    across, down, order = media._layout(64 * 4095 + 1)
    assert (across, down) == (65, 4033) and len(order) == 6 * across * down and (np.sort(order) == np.arange(len(order))).all()


def test_clashing_columns(spark):
    docs = spark.createDataFrame([("abc", "m", 5, "x")], "text string, media string, n_bytes int, `a.b` string")
    stored = media.encode_texts(docs)
    assert stored.columns == ["a.b", "n_bytes", "media"] and stored.first().n_bytes == 3
    read = media.decode_media(stored.withColumn("rgb", F.lit("x")).withColumn("payload", F.lit(1)))
    row = read.first()
    assert row.payload == b"abc" + bytes(61) and len(row.rgb) == row.height * row.width * 3
