import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cohortlake.llm import media

from .cases import documents, rows_of, saved

TEXTS = [None, "", "a", "é" * 700, "x" * 576, "x" * 577, "ÿ\x00\xff" * 900, "long text " * 20000, "a"]


def test_round_trip(spark, tmp_path):
    got = rows_of(media.op5_media(spark, saved(spark, tmp_path, TEXTS)))
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert got[i].n_bytes == len(raw) and got[i].payload_bytes == len(payload)
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got[i].tail_crc32 == zlib.crc32(payload[-32:])
    assert got[2][1:] == got[8][1:]
    assert documents(spark, TEXTS).limit(0).transform(media.with_media).transform(media.digests).count() == 0


def test_scans_of_any_coefficients_add_up():
    rng = np.random.default_rng(3)
    for share in (0.02, 0.3, 0.9):
        wide, high = 3, 2
        n = wide * high
        z = [np.where(rng.random((k, 64)) < share, rng.integers(-300, 300, (k, 64)), 0) for k in (4 * n, n, n)]
        z[0][:, 0] = rng.integers(-500, 500, 4 * n)
        z[1][0] = 0
        width, height, planes = media.coefficients(media.encode(*z, wide, high))
        assert (width, height) == (48, 32)
        for p, want in zip(planes, z):
            assert (p["z"] == want).all()


def picture(seed, wide=5, high=3, share=0.3):
    rng, n = np.random.default_rng(seed), wide * high
    z = [np.where(rng.random((k, 64)) < share, rng.integers(-300, 300, (k, 64)), 0) for k in (4 * n, n, n)]
    for x in z:
        x[:, 0] = rng.integers(-500, 500, len(x))
    z[0][7:9, 1:] = 0
    return z, wide, high


def test_own_tables_and_restart_intervals():
    for seed, share in enumerate((0.02, 0.3, 0.9)):
        z, wide, high = picture(seed, share=share)
        for apart in (False, True):
            for restart in (0, 1, 4, 15, 100):
                data = media.encode(z[0], z[1], z[2], wide, high, apart=apart, restart=restart)
                width, height, planes = media.coefficients(data)
                assert (width, height) == (80, 48)
                for p, want in zip(planes, z):
                    assert (p["z"] == want).all(), (seed, apart, restart)
    assert b"\xff\xd0" in data or restart == 100
    # Luma and chroma have a DC table each, and the file of one interval has no marker inside.
    assert media.encode(*z, wide, high, apart=True) != media.encode(*z, wide, high)


def brute_pixels(z, wide, high):
    """RGB by the formulas, a pixel at a time."""
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))

    def samples(block):
        f = np.zeros((8, 8))
        for (r, c), v in zip(order, block):
            f[r, c] = v
        return np.clip(basis.T @ f @ basis + 128, 0, 255)

    y, cb, cr = ([samples(b) for b in x] for x in z)
    out = np.zeros((16 * high, 16 * wide, 3))
    for r in range(16 * high):
        for c in range(16 * wide):
            l = y[r // 8 * 2 * wide + c // 8][r % 8, c % 8]
            u, v = (x[r // 16 * wide + c // 16][r % 16 // 2, c % 16 // 2] - 128 for x in (cb, cr))
            out[r, c] = l + 1.402 * v, l - 0.344136 * u - 0.714136 * v, l + 1.772 * u
    return np.clip(out, 0, 255)


def test_tensors_of_files(spark):
    z, wide, high = picture(5, 3, 2)
    z = [x // 4 for x in z]
    good = media.encode(*z, wide, high, apart=True, restart=2)
    rng = random.Random(2)
    broken = []
    for _ in range(40):
        b = bytearray(good)
        for _ in range(3):
            b[rng.randrange(len(b))] = rng.randrange(256)
        broken.append(bytes(b))
    files = [good, None, b"", b"no picture", good[: len(good) // 2], good[:-2], good.replace(b"\xff\xc2", b"\xff\xc0"), good, *broken]
    df = spark.createDataFrame([(i, f, "kept", 1) for i, f in enumerate(files)], "doc_id int, media binary, rgb string, made int")
    out = media.tensors(df)
    assert out.columns == ["doc_id", "media", "made", "rgb"]
    got = {r.doc_id: r.rgb for r in out.collect()}
    assert len(got) == len(files) and all(got[i] is None for i in range(1, 7)) and got[0] == got[7]
    rgb = np.frombuffer(got[0].data, np.uint8).reshape(got[0].height, got[0].width, 3)
    want = brute_pixels(z, wide, high)
    assert rgb.shape == want.shape and len(np.unique(rgb)) > 100 and np.abs(rgb - want).max() <= 0.51
    assert all(r.rgb is None for r in media.tensors(df, most=48 * 32 - 1).collect())
    assert media.tensors(df.limit(0)).count() == 0


def test_feature_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "text", 5, "x", "y", "z", 7), (2, None, 5, "x", "y", "z", 7)], "doc_id int, text string, n_bytes int, Media string, payload_sha256 string, feature string, made int")
    got = media.digests(media.with_media(docs))
    assert got.columns == ["doc_id", "text", "made", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for r in got.collect():
        payload = (r.text or "").encode().ljust(576, b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.made) == (len(r.text or ""), 576, 7) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        z = np.zeros((12, 64), int)
        z[:9] = np.frombuffer(payload, np.uint8).reshape(9, 64)
        z[:, 1:] += 256
        flat = np.zeros((4, 64), int)
        # Nine blocks of luma fill a square of two by two units; the feature is that of its pixels.
        luma = np.zeros((16, 64), int)
        luma[:12] = z
        luma[12:, 1:] = 256
        size, mean, dark = r.feature.split(";")
        want = brute_pixels([luma, flat, flat], 2, 2).round().reshape(-1, 3)
        assert size == "32x32"
        assert np.allclose([float(x) for x in mean[5:].split(",")], want.mean(0), atol=0.05)
        assert np.allclose([float(x) for x in dark[5:].split(",")], (want < 64).mean(0), atol=0.005)
    spoilt = media.with_media(docs).withColumn("media", F.when(F.col("doc_id") == 1, F.col("media")))
    got = {r.doc_id: r for r in media.digests(spoilt).collect()}
    assert got[1].payload_sha256 and (got[2].payload_sha256, got[2].tail_crc32, got[2].feature, got[2].media_bytes) == (None,) * 4


def test_pixels():
    z = [np.zeros((4, 64), int), np.zeros((1, 64), int), np.zeros((1, 64), int)]
    z[0][:, 0], z[2][:, 0] = 400, 240
    rgb = media.pixels(*media.coefficients(media.encode(*z, 1, 1)))
    assert rgb.shape == (16, 16, 3) and (rgb[0, 0] == [220, 157, 178]).all()
    natural = np.zeros(64)
    natural[1] = 80  # one horizontal wave
    wave = (natural[media.ZIGZAG] @ media.INVERSE).reshape(8, 8)
    want = 80 / 4 / np.sqrt(2) * np.cos((2 * np.arange(8) + 1) * np.pi / 16)
    assert np.allclose(wave, want[None, :].repeat(8, 0), atol=1e-3)
