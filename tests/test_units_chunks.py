from dataclasses import asdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.operators import chunk, segment

WORDS = st.lists(st.sampled_from(["one", "two,", "three.", "Four", "“five”", "six;", "seven--", "eight!"]), min_size=1, max_size=120).map(" ".join)


@given(WORDS, st.integers(20, 90))
@settings(max_examples=150, deadline=None)
def test_sentence_parts_lose_nothing(text, most):
    parts = chunk.sentence_parts(text, most)
    assert " ".join(parts) == text
    assert all(len(p) <= most or " " not in p for p in parts)


@given(st.lists(WORDS, min_size=1, max_size=8), st.integers(60, 200))
@settings(max_examples=100, deadline=None)
def test_chunks_stay_under_the_maximum(paragraphs, most):
    rows = chunk.narration_chunks("\n\n".join(paragraphs), 20, 50, most, 30)
    assert all(len(r["text"]) <= most or " " not in r["text"] for r in rows)
    assert rows[0]["previous_context"] == "" and rows[-1]["following_context"] == ""


def test_scene_and_section():
    rows = chunk.narration_chunks("# Head\n\nFirst words.\n\n***\n\nSecond words.\n\n## Next\n\nThird.", 5, 10, 60, 20)
    assert [(r["text"], r["boundary_after"]) for r in rows] == [("Head\n\nFirst words.", "scene"), ("Second words.", "section"), ("Next\n\nThird.", "section")]


def test_speech_stays_together():
    said = "\n\n".join(["“" + "a" * 30 + "”"] * 4)
    assert len(chunk.narration_chunks(said, 10, 40, 200, 0)) == 1
    assert len(chunk.narration_chunks(said.replace("“", "x"), 10, 40, 200, 0)) == 2


def test_short_last_chunk_joins_the_one_before():
    rows = chunk.narration_chunks("a" * 60 + "\n\n" + "b" * 5, 10, 50, 100, 0)
    assert len(rows) == 1


def test_bad_sizes():
    with pytest.raises(ValueError):
        chunk.narration_chunks("x", 5, 4, 10)
    with pytest.raises(ValueError):
        segment.segment_text("x", 10, 5)


def test_units(spark):
    text = "# One\n\nFirst prose sentence here.\n\nSecond prose. It goes on.\n\n***\n\nThird prose."
    df = spark.createDataFrame([("b", 0, text), ("b", 1, ""), ("b", 2, None)], "book_id string, chapter_index int, normalized_text string")
    rows = segment.units(df, target=20, most=40, context=12).orderBy("position").collect()
    assert [(r["kind"], r["text"]) for r in rows] == [("heading", "# One"), ("prose", "First prose sentence here."), ("prose", "Second prose. It goes on."), ("scene_marker", "***"), ("prose", "Third prose.")]
    assert [r["previous_context"] for r in rows] == ["", "", "here.", "", "It goes on."]
    assert [r["following_context"] for r in rows] == ["", "Second", "Third prose.", "", ""]


def test_limited_keeps_structure(spark):
    kinds = ["heading", "prose", "scene_marker", "heading", "prose"]
    df = spark.createDataFrame([("b", 0, n, k) for n, k in enumerate(kinds)], "book_id string, chapter_index int, position int, kind string")
    assert [r["kind"] for r in segment.limited(df, 1).orderBy("position").collect()] == kinds[:4]
    assert [r["kind"] for r in segment.limited(df, 0).orderBy("position").collect()] == kinds[:1]


def test_oversized_paragraph_is_cut_at_sentences():
    text = "Alpha beta gamma. Delta epsilon. Zeta eta theta iota."
    assert [t for _, t in segment.segment_text(text, 20, 35)] == ["Alpha beta gamma. Delta epsilon.", "Zeta eta theta iota."]


def test_piece_is_plain():
    assert asdict(chunk.Piece("a", "paragraph")) == {"text": "a", "boundary_after": "paragraph", "dialogue": False}
