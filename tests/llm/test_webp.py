"""Round trips through every part of the image format."""

import cProfile
import pstats
import tracemalloc

import numpy as np
import pytest

from lakewarden.llm import webp

RNG = np.random.default_rng(5)


def noise(height, width, colors=None):
    if colors:
        table = RNG.integers(0, 1 << 32, colors, dtype=np.uint32)
        return table[RNG.integers(0, colors, (height, width))]
    return RNG.integers(0, 1 << 32, (height, width), dtype=np.uint32)


def smooth(height, width):
    y, x = np.mgrid[:height, :width].astype(np.uint32)
    return np.uint32(0xFF000000) | (x * 3 & 255) << 16 | (y * 5 + x & 255) << 8 | (x + y & 255)


SHAPES = [(1, 1), (1, 7), (5, 1), (9, 13), (33, 40)]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("options", [{}, {"subtract_green": True}, {"cache_bits": 4}, {"meta_bits": 2}, {"meta_bits": 2, "cache_bits": 7}])
def test_plain_images(shape, options):
    for image in (noise(*shape), smooth(*shape), noise(*shape, colors=40), np.full(shape, 0x12345678, np.uint32)):
        assert (webp.decode(webp.encode(image, palette=False, **options)) == image).all()


@pytest.mark.parametrize("colors", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes_of_every_bundle_size(colors):
    image = noise(11, 19, colors)
    assert (webp.decode(webp.encode(image, palette=True)) == image).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    image = noise(10, 9)
    modes = np.full((3, 3), mode)
    assert (webp.decode(webp.encode(image, predictor=modes, block_bits=2)) == image).all()


def test_cross_colour_with_predictor_and_green():
    image = noise(17, 20)
    cross = noise(5, 5)
    modes = RNG.integers(0, 14, (5, 5))
    file = webp.encode(image, predictor=modes, cross=cross, subtract_green=True, block_bits=2, cache_bits=5)
    assert (webp.decode(file) == image).all()


def test_known_predictions():
    left, top, corner, right = [10] * 4, [20] * 4, [16] * 4, [31] * 4
    expected = {0: [255, 0, 0, 0], 5: [20] * 4, 6: [13] * 4, 10: [19] * 4, 12: [14] * 4, 13: [15] * 4}
    for mode, value in expected.items():
        assert webp._predict(mode, left, top, corner, right) == value


def test_distance_map_has_the_formats_ends():
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert webp.NEAR[-4:] == [(7, 7), (-7, 7), (8, 6), (8, 7)]


@pytest.mark.parametrize("text", [None, "", "a", "é" * 288, "x" * 576, "be " * 4000, "Über 😀 " * 999, "".join(chr(33 + i % 90) for i in range(5000))])
def test_payload_round_trip(text):
    size, payload = webp.pad_payload(text)
    assert len(payload) % 576 == 0 and payload
    media = webp.store_payload(payload)
    assert b"".join(webp.image_bytes(i) for i in webp.load_images(media)) == payload
    assert payload[:size].decode() == (text or "")


@pytest.mark.parametrize("mode", [1, 2])
def test_even_predictors_are_the_general_ones(mode):
    for shape in SHAPES:
        image = noise(*shape)
        modes = np.full((3, 11), mode << 8, np.uint32)
        modes[-1, -1] = 1 << 11  # never reached, but no longer the same for all
        general = webp._run_predictor(image, modes, 4, True)
        assert (webp._run_predictor(image, np.full((3, 11), mode << 8), 4, True) == general).all()
        assert (webp._run_predictor(general, np.full((3, 11), mode << 8), 4, False) == image).all()


def test_payloads_are_stored_with_the_transforms_that_suit_them(monkeypatch):
    used = []
    for name in ("_run_predictor", "_run_green"):
        monkeypatch.setattr(webp, name, lambda *a, f=getattr(webp, name), n=name: used.append((n, a[-1])) or f(*a))
    ramps = [bytes(RNG.integers(0, 9, 5760, dtype=np.uint8).cumsum(dtype=np.uint8)), bytes(np.repeat(RNG.integers(0, 128, 1920, dtype=np.uint8), 3))]
    rows = np.cumsum(RNG.integers(0, 3, (10, 576), dtype=np.uint8), axis=0, dtype=np.uint8) + RNG.integers(0, 256, (1, 576), dtype=np.uint8)
    for payload in (*ramps, rows.tobytes()):
        media = webp.store_payload(payload)
        plain = webp.encode(webp.load_images(media)[0])
        assert b"".join(map(webp.image_bytes, webp.load_images(media))) == payload
        assert len(media) < len(plain)
    assert {("_run_predictor", True), ("_run_predictor", False), ("_run_green", True), ("_run_green", False)} <= set(used)


def test_long_payloads_take_several_images():
    payload = bytes(RNG.integers(0, 3, webp.ROW * (webp.MAX_ROWS + 2), dtype=np.uint8))
    images = webp.load_images(webp.store_payload(payload))
    assert [len(i) for i in images] == [webp.MAX_ROWS, 2]
    assert b"".join(map(webp.image_bytes, images)) == payload


def words(size, seed):
    chosen = np.random.default_rng(seed).integers(0, 9000, size // 4)
    return " ".join("".join(chr(97 + int(c) * k % 26) for k in (1, 3, 7, 11)[: 2 + c % 3]) for c in chosen)[:size]


def test_calls_for_a_text_are_few():
    """Counted, not timed: what storing and reading 20 texts of 2,400 characters costs in function calls."""
    payloads = [webp.pad_payload(words(2400, seed))[1] for seed in range(20)]
    assert len({len(p) for p in payloads}) == 1
    profile = cProfile.Profile()
    profile.enable()
    read = [b"".join(webp.image_bytes(i) for i in webp.load_images(webp.store_payload(p))) for p in payloads]
    profile.disable()
    assert read == payloads
    assert pstats.Stats(profile).total_calls < 20 * 2000


def test_reading_takes_memory_by_pixels_not_by_bits():
    payload = RNG.integers(0, 200, webp.ROW * 2000, dtype=np.uint8).tobytes()
    media = webp.store_payload(payload)
    tracemalloc.start()
    try:
        images = webp.load_images(media)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert b"".join(map(webp.image_bytes, images)) == payload
    assert peak < 12 * len(payload)


@pytest.mark.parametrize("window", [16, 61, 300])
def test_images_are_read_over_the_ends_of_windows(monkeypatch, window):
    monkeypatch.setattr(webp, "WINDOW", window)
    monkeypatch.setattr(webp, "LEAST_COPY", 3)
    for image in (noise(33, 40), smooth(33, 40), np.repeat(noise(30, 8), 5, axis=1), noise(33, 40, colors=3)):
        file = webp.encode(image, palette=False, distances=(1, 2, 40))
        assert (webp.decode(file) == image).all()
        with pytest.raises(ValueError):
            cut = file[: len(file) * 2 // 3]
            webp.decode(cut[:16] + (len(cut) - 20).to_bytes(4, "little") + cut[20:])


def test_code_lengths_are_those_of_a_heap():
    import heapq

    for size in (2, 3, 19, 90, 256):
        for counts in (RNG.integers(0, 4, size), RNG.geometric(0.01, size), np.arange(1, size + 1)):
            used = np.flatnonzero(counts)
            if len(used) < 2:
                continue
            heap = [(int(counts[s]), i, [s]) for i, s in enumerate(used)]
            heapq.heapify(heap)
            expected, fresh = np.zeros(size, np.int64), len(used)
            while len(heap) > 1:
                one, other = heapq.heappop(heap), heapq.heappop(heap)
                expected[one[2] + other[2]] += 1
                heapq.heappush(heap, (one[0] + other[0], fresh, one[2] + other[2]))
                fresh += 1
            if expected.max() <= webp.MAX_CODE:
                assert (webp.huffman_lengths(counts) == expected).all()


def test_damaged_files_are_refused():
    file = webp.encode(noise(8, 8))
    for bad in (b"", file[:30], b"RIFX" + file[4:], file[:20] + b"\0" + file[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)
