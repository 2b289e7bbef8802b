import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def vocab():
    from furrow.llm.queries import vocabulary
    return vocabulary()


@pytest.fixture(scope="session")
def sp():
    import public_tokenizers
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows and ids, and
    extra columns with the names of results."""
    para = "one two three four five six seven eight nine ten"
    rows = [
        (1, para, "en", "a", 7, "x", 1.0),
        (1, para, "en", "a", 7, "x", 1.0),
        (2, None, None, None, None, None, None),
        (None, "alpha beta gamma delta epsilon zeta", None, None, None, None, None),
        (3, "", "en", "a", 0, "x", 0.0),
        (4, " \t\n ", "en", "b", 4, "x", 0.0),
        (5, para, "en", "b", 7, "x", 2.0),
        (6, "word " * 40_000 + "\n" + "z" * 100_000, "en", "b", 1, "x", 2.0),
        (7, "ÀÉ 日本語 🙂 \x00 ▁\n\n" + para, "fr", "c", 1, "x", 2.0),
        (7, "another text of the same id with some words", "fr", "c", 1, "x", 2.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, Score double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
