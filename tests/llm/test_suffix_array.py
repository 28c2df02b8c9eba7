import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tideglass.llm.suffix_array import adjacent_common_prefixes, repeated_starts, smaller_than_successor, suffix_array


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(min_size=1, max_size=300), st.text("ab", min_size=1, max_size=300).map(str.encode), st.tuples(st.text("abc", min_size=1, max_size=20), st.integers(1, 40)).map(lambda x: (x[0] * x[1]).encode())))
def test_suffix_array(b):
    text = np.frombuffer(b, np.uint8)
    order = suffix_array(text, len(b) + 1)
    assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    assert smaller_than_successor(text).tolist() == [b[i:] < b[i + 1 :] for i in range(len(b))]
    lcp = adjacent_common_prefixes(text, order, 1000)
    for i in range(1, len(order)):
        x, y = b[order[i - 1] :], b[order[i] :]
        assert lcp[i] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


@pytest.mark.parametrize("width", [3, 8, 20, 50])
def test_repeated_starts(width):
    rng = np.random.default_rng(width)
    base = rng.integers(97, 100, 600).astype(np.uint8)
    text = np.concatenate((base, rng.integers(97, 123, 50).astype(np.uint8), base[100:400], np.full(120, 97, np.uint8)))
    valid = np.arange(len(text)) + width <= len(text)
    b = text.tobytes()
    words = [b[i : i + width] for i in range(len(b) - width + 1)]
    many = {w for w in set(words) if words.count(w) > 1}
    assert sorted(repeated_starts(text, valid, width).tolist()) == [i for i, w in enumerate(words) if w in many]
