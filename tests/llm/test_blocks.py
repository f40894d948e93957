"""Results do not depend on where long texts are cut."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from forgeboard.llm import quality

LONG = " ".join(f"w{i % 5000} w{i % 7} the the" for i in range(60_000)) + "\n" + "x" * 700_000 + " End  end"


@pytest.mark.parametrize("size", [1 << 10, 1 << 14, 1 << 20])
def test_shapes_are_those_of_whole_texts(monkeypatch, size):
    texts = [LONG, "", "same same same", LONG[:3000], None]
    monkeypatch.setattr(quality, "BLOCK_BYTES", 1 << 40)
    want = quality.shape(pa.array(texts))
    monkeypatch.setattr(quality, "BLOCK_BYTES", size)
    got = np.concatenate([quality.shape(pa.array([t])) for t in texts])
    assert np.allclose(got, want)
    words = re.findall("[^\x20\x09-\x0d]+", LONG)
    assert got[0][0] == pytest.approx(np.log1p(len(words)))
    assert got[0][5] == pytest.approx(np.log1p(len(set(words))) - 0.75 * np.log1p(len(words)))
    assert got[0][4] == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / len(words))
