import hashlib
import random
import zlib

import numpy as np
import pytest

from quarrylens.llm import jpeg, queries

from .cases import awkward, table, with_clashes


def payloads():
    rng = np.random.default_rng(1)
    return [
        b"",
        b"a",
        bytes(range(256)) * 3,
        rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(),
        b"\x80" * 500 + b"\x7f\x81" + b"\x80" * 100 + b"x" * 10 + b"\x80" * 60 + b"\x81",
        rng.choice([127, 128, 129, 130, 97], 4000).astype(np.uint8).tobytes(),
        rng.choice([128] * 20 + [129, 127, 97], 4000).astype(np.uint8).tobytes(),
        "é€😀".encode() * 300,
    ]


def test_round_trip():
    files = jpeg.encode_batch([jpeg.payload_image(x) for x in payloads()])
    for data, (parsed, c) in zip(payloads(), jpeg.decode_batch(files), strict=True):
        size, payload = jpeg.payload_of(parsed, c)
        assert size == len(data) and payload == data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def test_wide_layout_round_trip(monkeypatch):
    at = jpeg.Layout(16 * 3, 16 * 2)
    c = np.random.default_rng(2).integers(-128, 128, (at.blocks, 64)).astype(np.int16)
    (file,) = jpeg.encode_batch([(at, c, 48, 32, np.ones(64, np.int64), b"")])
    ((_, again),) = jpeg.decode_batch([file])
    assert np.array_equal(c, again)


def smooth(height, width):
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([x * 255 // width, y * 255 // height, (x + y) * 255 // (width + height)], axis=-1).astype(np.uint8)


@pytest.mark.parametrize("size", [(32, 48), (45, 70), (1, 1), (17, 16)])
def test_images_match_another_decoder(spark, size):
    pixels = smooth(*size)
    file = jpeg.image_file(pixels, np.full(64, 2))
    ((parsed, c),) = jpeg.decode_batch([file])
    ours = jpeg.rgb(parsed, c).astype(int)
    assert ours.shape == pixels.shape and np.abs(ours - pixels).mean() < 4
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(file))
    theirs = np.array([[[(v := image.getRGB(x, y)) >> 16 & 255, v >> 8 & 255, v & 255] for x in range(size[1])] for y in range(size[0])])
    assert np.abs(ours - theirs).max() <= 14 and np.abs(ours - theirs).mean() < 3  # decoders smooth chroma differently


def test_awkward_rows(spark):
    media = jpeg.to_media(with_clashes(table(spark)))
    rows = jpeg.from_media(media, tensors=True).collect()
    expected = []
    for d, t, *_ in awkward():
        data = (t or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        expected.append((repr(d), len(data), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((repr(r.doc_id), r.n_bytes, hashlib.sha256(r.payload).hexdigest(), r.tail_crc32) for r in rows) == sorted(expected)
    assert all(len(r.rgb) == 3 * r.width * r.height for r in rows)
    same = {}
    for r in rows:
        assert same.setdefault(bytes(r.payload), (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def reference_tensor(data):
    """The padded bytes as coefficients, transformed block by block from the definition, without any file."""
    padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
    blocks = np.frombuffer(padded, np.uint8).reshape(-1, 64).astype(float) - 128
    mcus = -(-len(blocks) // 6)
    wide = -(-mcus // 4095)
    high = -(-mcus // wide)
    blocks = np.vstack([blocks, np.zeros((6 * wide * high - len(blocks), 64))])
    zigzag = sorted(range(64), key=lambda k: (s := k // 8 + k % 8, k // 8 if s % 2 else k % 8))
    basis = np.array([[(0.5**1.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    out = np.zeros((16 * high, 16 * wide, 3))
    for m in range(wide * high):
        planes = []
        for block in blocks[6 * m : 6 * m + 6]:
            square = np.zeros(64)
            square[zigzag] = block
            planes.append(np.clip(np.floor(basis.T @ square.reshape(8, 8) @ basis + 128.5), 0, 255))
        y = np.block([[planes[0], planes[1]], [planes[2], planes[3]]])
        cb, cr = (np.kron(p, np.ones((2, 2))) - 128 for p in planes[4:])
        own = np.clip(np.round(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)), 0, 255)
        row, column = divmod(m, wide)
        out[16 * row : 16 * row + 16, 16 * column : 16 * column + 16] = own
    return out.astype(int)


def test_stored_tensors_like_the_definition(spark, tmp_path):
    rows = [(k, "".join(random.Random(k).choice("abcdé ,.TZ") for _ in range(n)), "", "", 0) for k, n in enumerate([0, 10, 64, 700, 5000])]
    found = {r.doc_id: r for r in jpeg.store_tensors(jpeg.to_media(table(spark, rows)), f"file://{tmp_path}/t").collect()}
    digests = {r.doc_id: r for r in jpeg.from_media(jpeg.to_media(table(spark, rows))).collect()}
    for k, t, *_ in rows:
        r = found[k]
        ours = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3).astype(int)
        assert ours.shape == (theirs := reference_tensor(t.encode())).shape and np.abs(ours - theirs).max() <= 2
        assert digests[k].rgb_sha256 == hashlib.sha256(r.rgb).hexdigest() and digests[k].feature == ":".join(map(str, (f"{r.width}x{r.height}", *ours.sum(axis=(0, 1)).tolist())))


def test_query_like_plain_python(spark, data):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op5_media(spark, data).collect():
        text = docs.pop(r.doc_id)
        padded = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
        (file,) = jpeg.encode_batch([jpeg.payload_image(text)])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    assert not docs


def test_features_do_not_depend_on_the_batch(spark):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 900))), "", "", 0) for k in range(60)]
    one = {r.doc_id: r.feature for r in jpeg.from_media(jpeg.to_media(table(spark, rows).coalesce(1))).collect()}
    two = {r.doc_id: r.feature for r in jpeg.from_media(jpeg.to_media(table(spark, rows).repartition(7))).collect()}
    assert one == two


def test_empty_table_and_damage(spark):
    assert jpeg.from_media(jpeg.to_media(table(spark, []))).collect() == []
    with pytest.raises(ValueError):
        jpeg.decode_batch([b"no image at all"])
