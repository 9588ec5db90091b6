"""Chains over pieces, and patterns of the second hop."""

import numpy as np
import pyarrow as pa
import pytest

from llm_cases import prose
from rollcall.llm import crf, langid, pii, quality


@pytest.mark.parametrize("k", [2, 4])
def test_pieces_are_one_chain(k):
    rng = np.random.default_rng(k)
    length = np.array([500, 1, 0, 64, 65, 128, 130, 7])
    total = int(length.sum())
    items, trans = rng.normal(scale=2, size=(total, k)), rng.normal(size=(k, k))
    out = []
    for width in (64, 1000):
        row, col, size = crf.lay_out(length, width)
        score = np.zeros((int(size.max()), len(size), k))
        score[col, row] = items
        out.append(crf.marginals(score, size, trans, -(-length // width))[col, row])
    assert np.allclose(out[0], out[1], atol=1e-9)
    cut_row, cut_col, cut = crf.lay_out(length, 64)
    score = np.zeros((64, len(cut), k))
    score[cut_col, cut_row] = items
    assert not np.allclose(crf.forward_backward(score, cut, trans)[cut_col, cut_row], out[0], atol=1e-3)


def test_documents_of_many_lines_and_words(monkeypatch):
    good, bad = "The line reads well, it does.", "buy!! NOW!! ### $$$ *** %%%"
    w, t, curve, share = quality.fit(pa.chunked_array([pa.array([good] * 30 + [bad] * 30)]), [1] * 30 + [0] * 30)
    t = np.array([[2.0, -2.0], [-2.0, 2.0]])
    text = pa.array(["\n".join([good, bad][i % 3 == 1] + f" {i}" for i in range(500))])
    (*_, one), = quality.line_marginals(text, w, t)
    a = quality.score(text, w, t, curve, share)
    langs = ["zorn zirt zalp " * 200 + "mula melo mira " * 50]
    lw, lt = langid.fit(pa.chunked_array([pa.array(["zorn zirt zalp"] * 40 + ["mula melo mira"] * 40)]), ["a"] * 40 + ["b"] * 40, ["a", "b"])
    names, best = langid.predict(pa.array(langs), lw, lt, ["a", "b"])
    for module in (quality, langid):
        monkeypatch.setattr(module, "WIDTH", 5000)
    (*_, other), = quality.line_marginals(text, w, t)
    assert np.allclose(one, other, atol=1e-6) and np.allclose(a, quality.score(text, w, t, curve, share), atol=1e-6)
    again = langid.predict(pa.array(langs), lw, lt, ["a", "b"])
    assert names == again[0] == ["a"] and np.allclose(best, again[1], atol=1e-5)


def test_the_second_hop_finds_new_identifiers(spark):
    """Base seeds teach "reach him"; what follows that teaches "badge number"."""
    rows = [f"{prose(i, 5)} reach him +1 (234) 567-{8000 + i} {prose(900 + i, 4)}" for i in range(60)]
    rows += [f"{prose(100 + i, 5)} reach him X{i:02d}-7731-{i:03d} now" for i in range(20)]
    rows += [f"{prose(200 + i, 5)} badge number X{i % 20:02d}-7731-{i % 20:03d} here" for i in range(40)]
    rows += [f"{prose(300 + i, 5)} badge number Q{i:02d}-5512-{i:03d} there" for i in range(20)]
    rows += [f"{prose(400 + i, 5)} order of Z{i:02d}-9999-{i:03d} items" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.id: [rows[r.id][s.start:s.end] for s in r.added] for r in pii.find_personal_data(df).collect()}
    assert all(got[60 + i] == [f"X{i:02d}-7731-{i:03d}"] for i in range(20))       # first hop
    assert all(got[80 + i] == [f"X{i % 20:02d}-7731-{i % 20:03d}"] for i in range(40))  # the same after the second context
    assert all(got[120 + i] == [f"Q{i:02d}-5512-{i:03d}"] for i in range(20))      # new ones
    assert all(not got[140 + i] for i in range(20))
