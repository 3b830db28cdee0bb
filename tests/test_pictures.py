"""Pixel hashes against hashes of the pixels that pictures were made of."""

import hashlib

import numpy as np
import pytest

from factmill.sources.pictures import CHANNELS, as_png, pixel_hash, with_pixel_hash


def expected(pixels, colour, palette):
    h, step = len(pixels), CHANNELS[colour]
    each = pixels.reshape(h, -1, step)
    rgb = {0: lambda: each.repeat(3, 2), 2: lambda: each, 3: lambda: palette[each[..., 0]], 4: lambda: each[..., :1].repeat(3, 2), 6: lambda: each[..., :3]}[colour]()
    return hashlib.sha256(f"{each.shape[1]}x{h}:".encode() + np.ascontiguousarray(rgb).tobytes()).hexdigest()


@pytest.mark.parametrize("colour", sorted(CHANNELS))
@pytest.mark.parametrize("how", range(5))
def test_any_form(colour, how):
    random = np.random.default_rng(colour * 5 + how)
    palette = random.integers(0, 256, (256, 3), dtype=np.uint8)
    for width, height in ((1, 1), (7, 5), (300, 41)):
        pixels = random.integers(0, 256, (height, width * CHANNELS[colour]), dtype=np.uint8)
        made = as_png(pixels, colour, how, palette.tobytes() if colour == 3 else b"")
        assert pixel_hash(made) == (expected(pixels, colour, palette), width, height, None)


def test_what_cannot_be_read(spark):
    good = as_png(np.arange(12, dtype=np.uint8).reshape(2, 6), 2)
    large = as_png(np.zeros((3000, 900), np.uint8), 2)
    bad = [None, b"", b"GIF89a", good[:8], good[:60], good[:50] + b"zz" + good[52:], good.replace(b"\x08\x02\x00\x00\x00", b"\x10\x02\x00\x00\x00")]
    rows = spark.createDataFrame([(i, x, "kept") for i, x in enumerate([good, good, large, *bad])], "id int, content binary, image string")
    found = {r.id: r for r in with_pixel_hash(rows).collect()}
    assert found[0].image_sha256 == found[1].image_sha256 and found[0].image_error is None and found[0].image == "kept"
    assert (found[2].image_width, found[2].image_height, found[2].image_error) == (300, 3000, None)
    assert all(found[i].image_sha256 is None and found[i].image_error for i in range(3, 10))
    assert with_pixel_hash(rows.limit(0)).count() == 0
