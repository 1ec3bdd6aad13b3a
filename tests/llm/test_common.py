"""Slices of texts and their results put together."""

import numpy as np
import pyarrow as pa

from timbrewell.llm.common import joined, slices


def test_slices_cover_all_texts_in_order():
    texts = pa.array(["a" * 5, None, "", "b" * 30, "c", "d" * 9, "", None])
    for size in (1, 4, 10, 1000):
        parts = list(slices(texts, size))
        assert [x for p in parts for x in p.to_pylist()] == texts.to_pylist()
        assert all(len(p) for p in parts)
    assert list(slices(pa.array([], pa.string()))) == []
    assert len(list(slices(texts, 1000))) == 1 and len(list(slices(texts, 10))) > 2


def test_joined():
    a = (np.array([1, 2, 3]), np.array([0, 1, 3]))
    b = (np.array([4]), np.array([0, 0, 1]))
    values, bounds = joined([a, b], np.int64)
    assert values.tolist() == [1, 2, 3, 4] and bounds.tolist() == [0, 1, 3, 3, 4]
    values, bounds = joined([], np.uint16)
    assert len(values) == 0 and bounds.tolist() == [0]
