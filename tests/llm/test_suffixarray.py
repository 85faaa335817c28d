import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomq.llm.suffixarray import repeated_windows, suffix_array


def brute(s):
    return sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 1), max_size=60), st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(-5, 300), max_size=60)))
def test_equals_sorted_suffixes(s):
    assert suffix_array(s) == brute(s)


def test_structured():
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    for s in ([0] * 300, [1, 0] * 150, list(range(200)), list(range(200))[::-1], b, (b + [3]) * 5, [2, 1, 0] * 70 + [2]):
        assert suffix_array(s) == brute(s)


def test_repeated_windows():
    rng = random.Random(3)
    for _ in range(60):
        n, w = rng.randint(1, 200), rng.randint(1, 9)
        s = [rng.randint(0, 2) for _ in range(n)]
        starts = np.array([i for i in range(n - w + 1) if rng.random() < 0.8], np.int64)
        got = repeated_windows(np.array(s), starts, w)
        at = [tuple(s[i : i + w]) for i in starts]
        assert got.tolist() == [at.count(x) > 1 for x in at]
