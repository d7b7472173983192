import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm.split import pieces, rechunk, split_oversized

TEXT = st.text(st.sampled_from("ab ,.\n。，é́"), max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(20, 60), st.integers(0, 9))
def test_pieces_cover_in_order(text, limit, overlap):
    got = pieces(text, limit, overlap)
    assert bool(got) == bool(text)
    done = 0
    for k, (a, b) in enumerate(got):
        assert 0 < b - a <= limit and b > done and (a == 0 if k == 0 else 0 <= done - a <= overlap)
        done = b
    assert done == len(text)


def test_natural_boundaries():
    text = "One sentence here. " * 10
    assert all(text[:b].endswith(". ") for _, b in pieces(text, 50, 5))
    assert [b - a for a, b in pieces("x" * 100, 40, 10)] == [40, 40, 40]
    assert pieces("x" * 40, 40, 10) == [(0, 40)]
    with pytest.raises(ValueError):
        pieces("x", 20, 10)


def test_split_and_rechunk(spark):
    long = "Word after word. " * 20
    rows = [(1, 5, 0, long, "x"), (1, 5, 0, long, "x"), (2, 5, 1, "short", "x"), (3, 5, 1, "short", "x"), (4, 5, 2, None, "x"), (5, 6, 0, "", "x"), (6, None, 0, "lone", "x"), (7, None, None, long, None)]
    df = spark.createDataFrame(rows, "id long, document_id long, chunk_index int, content string, piece string")
    cut = split_oversized(df, 100, 20).collect()
    assert {r.id for r in cut} == {1, 7} and all(len(r.content) <= 100 for r in cut)
    n = sum(r.id == 1 for r in cut)
    got = sorted(rechunk(df, 100, 20, block=1).collect(), key=lambda r: (r.document_id or 0, r.chunk_index))
    five = [r for r in got if r.document_id == 5]
    assert [r.chunk_index for r in five] == list(range(n + 2)) and {r.total_chunks for r in five} == {n + 2}
    assert [r.content for r in five[n:]] == ["short", ""] and five[n].id == 2
    assert [r.chunk_index for r in got if r.document_id is None] == list(range(n + 1))
    assert split_oversized(df.limit(0)).count() == 0 and rechunk(df.limit(0)).count() == 0


def test_overlap_without_a_boundary():
    text = "word " * 20 + "x" * 200 + "\n" + "next words " * 20
    got = pieces(text, 301, 50)
    assert got[0] == (0, 301) and got[1][0] == 251
    assert pieces("x" * 39 + "\n" + "y" * 60, 40, 0)[1][0] == 40


def test_rechunk_keeps_rows_with_nulls(spark):
    long = "Word after word. " * 20
    rows = [(1, 5, None, "a"), (2, 5, None, "b"), (2, 5, None, "b"), (3, None, 0, "c"), (4, None, 0, "d"), (None, 5, 0, long), (None, 5, 1, "e"), (None, 5, 2, None), (9, 6, 0, "f"), (9, 7, 0, long), (None, None, None, "g"), (None, None, None, "h")]
    df = spark.createDataFrame(rows, "id long, document_id long, chunk_index int, content string")
    got = rechunk(df, 100, 20, block=1).collect()
    n = len(pieces(long, 100, 20))
    of = lambda d: sorted((r.chunk_index, r.id, r.content) for r in got if r.document_id == d)
    five = sorted((r.chunk_index, r.content) for r in got if r.document_id == 5)
    assert [c for c, _ in five] == list(range(n + 4)) and [t for _, t in five[:2]] == ["a", "b"] and [t for _, t in five[n + 2 :]] == ["e", ""]
    assert of(6) == [(0, 9, "f")] and [(c, i) for c, i, _ in of(7)] == [(k, 9) for k in range(n)]
    lone = sorted((r.chunk_index, r.content) for r in got if r.document_id is None)
    assert [c for c, _ in lone] == [0, 1, 2, 3] and sorted(t for _, t in lone) == ["c", "d", "g", "h"]
    assert {r.total_chunks for r in got if r.document_id is None} == {4} and {r.total_chunks for r in got if r.document_id == 5} == {n + 4}
