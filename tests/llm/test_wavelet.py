import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrystat.llm.wavelet import WaveletMatrix, encode


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60), st.integers(1, 60_000), st.integers(1, 40))
def test_wavelet(tokens, scale, copies):
    x = np.array([t * scale for t in tokens] * copies, dtype=np.uint32) % 1_000_000
    w = WaveletMatrix(encode(x, [None, 5], [0, len(x)]))
    assert np.array_equal(w.tokens(), x) and w.doc_ids == [None, 5]
    for i in range(0, len(x), 97):
        assert w.access(i) == x[i]
    for t in set(x[:5].tolist()) | {999_999_999}:
        at = np.flatnonzero(x == t)
        assert w.rank(t, len(x)) == len(at) and w.rank(t, len(x) // 2) == (at < len(x) // 2).sum()
        for k in range(0, len(at), 13):
            assert w.select(t, k) == at[k]
        with pytest.raises(ValueError):
            w.select(t, len(at))
