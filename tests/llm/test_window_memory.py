"""Windows are compared in slices, whose memory their number does not raise."""

import tracemalloc

import numpy as np

from velotrace.llm import op6_repeats


def test_comparing_many_windows_takes_little_memory():
    rng = np.random.default_rng(3)
    buf = np.tile(rng.integers(97, 123, 5000).astype(np.uint8), 2)
    n = rng.integers(80, 160, 120_000)
    a = rng.integers(0, 4800, len(n))
    b = a + 5000
    b[::3] += 1
    tracemalloc.start()
    got = op6_repeats._equal(buf, a, b, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    text = buf.tobytes()
    some = rng.integers(0, len(n), 2000).tolist() + [0, len(n) - 1]
    assert [bool(got[k]) for k in some] == [text[a[k] : a[k] + n[k]] == text[b[k] : b[k] + n[k]] for k in some]


def test_windows_longer_than_a_slice_are_compared_whole():
    buf = np.frombuffer(b"abcdefgh" * 2 + b"abcdefgx", np.uint8)
    a, b, n = np.array([0, 0, 3, 0]), np.array([8, 16, 11, 8]), np.array([8, 8, 1, 1])
    for most in (1, 3, 9, 1 << 20):
        assert op6_repeats._equal(buf, a, b, n, most).tolist() == [True, False, True, True]
