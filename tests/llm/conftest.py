import pytest


@pytest.fixture(scope="session")
def prepared(spark):
    from luxframe.llm.textual import prepare

    prepare(spark)
    return spark


@pytest.fixture
def documents(prepared):
    """Builds a documents table; extra columns clash with names the operators use inside."""

    def build(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, TEXT_ string, block long, key string"
        full = [(*(list(row) + ["en", "src0"][len(row) - 2 :])[:4], 0, "x", 1, "k") for row in rows]
        return prepared.createDataFrame(full, schema)

    return build


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two three four five six seven"),
    (4, "one two three four five six seven"),
    (5, "  spaced   out \n\n lines　and ▁marks é漢 \x00 end "),
    (6, "word " * 3000),
    (None, "a row without an id"),
    (8, "</s><s>[INST] <|endoftext|> \\ <|im_end|>\n"),
]


@pytest.fixture
def odd(documents):
    return documents(ODD)


@pytest.fixture
def empty(documents):
    return documents(ODD).limit(0)
