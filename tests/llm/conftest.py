"""Hard cases every text operator must stand: nulls, blanks, ties, repeats, odd white space, clashing columns."""

import pytest

TEXTS = [
    None, "", "   ", "a", "\n\n a", " a  b\n\n\nc's  ", "it's 'll don''t", "x y", "x  z", "   x  z\t\t",
    "a\x1cb \x1c c", "é  é", "end  ", "'s", "tab\tx \ty", "<|endoftext|> <|startoftext|>x", "İstanbul ﬁ Σς", "\x00 \x00a",
    "日本語 テスト　全角", " " * 50 + "x", "12345 6 7a8b", "word, word. (word) word###", "long " * 9000, "same text twice", "same text twice",
]


@pytest.fixture(scope="session")
def hard_texts():
    return TEXTS


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Documents with the hard texts, a repeated row, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "src0", len(t or ""), 0, "h") for i, t in enumerate(TEXTS)] + [(0, None, "en", "src0", 0, 0, "h")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part int, h string").cache()


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
