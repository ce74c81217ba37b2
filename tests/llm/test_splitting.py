import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrystone.llm.splitting import SPACES, cut_batch, oversized_ids, split_texts

WORD = re.compile(f"[^{re.escape(SPACES)}]+")


def _pieces(texts, size, overlap):
    out = {}
    for o, s, e in zip(*cut_batch(texts, size, overlap), strict=True):
        out.setdefault(int(o), []).append((int(s), int(e)))
    return out


def _check(texts, size, overlap):
    cut = _pieces(texts, size, overlap)
    for k, t in enumerate(texts):
        pieces = cut.get(k, [])
        if not t:
            assert not pieces
            continue
        assert pieces[0][0] == 0 and pieces[-1][1] == len(t)
        assert all(0 < e - s <= size for s, e in pieces)
        assert (len(pieces) > 1) == (len(t) > size)
        for (_, e), (s2, e2) in zip(pieces, pieces[1:], strict=False):
            assert s2 <= e < e2
            shared = WORD.findall(t[s2:e])
            assert len(shared) <= overlap
            if len(shared) < min(overlap, len(WORD.findall(t[:e]))):
                assert e - s2 <= size // 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n字。!", max_size=300), max_size=5), st.integers(8, 60), st.integers(0, 5))
def test_any_text(texts, size, overlap):
    _check(texts, size, overlap)


def _greedy(text, size, overlap):
    """The same cuts one after the other."""
    start = end = 0
    out = []
    while end < len(text):
        limit = min(start + size, len(text))
        ends = [i for i in range(end + 1, limit + 1)]
        strong = [i for i in ends if i == len(text) or text[i - 1] == "\n" or (text[i - 1] in ".!?" and text[i : i + 1].isspace())]
        word = [i for i in ends if text[i - 1].isspace() or text[i : i + 1].isspace()]
        end = max(strong or word or ends)
        out.append((start, end))
        starts = [m.start() for m in WORD.finditer(text) if m.end() <= end][-overlap:] if overlap else []
        starts = [s for s in starts if end - s <= size // 2]
        start = starts[0] if starts else end
    return out


def test_against_one_cut_after_the_other():
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("abcdef    .\n") for _ in range(rng.randint(200, 1500)))
        assert _pieces([text], 120, 4)[0] == _greedy(text, 120, 4)


def test_table(spark):
    long = "A sentence of some words. " * 100
    rows = [(1, "h", long, 9), (1, "h", long, 9), (2, None, "x" * 5000, 9), (3, "h", None, 9), (4, "h", "", 9), (5, "h", "short", 9), (6, "h", " " * 1300, 9)]
    df = spark.createDataFrame(rows, "row_id bigint, section_heading string, text string, chunk_index int")
    pieces = split_texts(df).collect()
    assert {p.row_id for p in pieces} == {1, 2, 6}
    assert all(len(p.text) <= 1200 for p in pieces)
    assert all(p.text.endswith((".", ". ")) for p in pieces if p.row_id == 1)
    assert "".join(p.text for p in sorted(pieces, key=lambda p: p.chunk_index) if p.row_id == 2) == "x" * 5000
    assert all(p.section_heading is None for p in pieces if p.row_id == 2)
    assert sorted(r.row_id for r in oversized_ids(df).collect()) == [1, 1, 2, 6]
    assert split_texts(df.limit(0)).count() == 0
