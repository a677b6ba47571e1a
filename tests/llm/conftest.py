import pytest

# Names that the operators use themselves; a table may have them too.
EXTRA = {
    "lang": "string",
    "source": "string",
    "n_chars": "long",
    "row": "long",
    "digest": "string",
    "kept": "boolean",
    "node": "long",
    "length": "int",
    "repeats": "string",
    "label": "int",
    "score": "string",
}
TEXT_OF = "abcdefgh"


@pytest.fixture
def make_docs(spark):
    """A documents table from (doc_id, text) pairs, with extra columns of clashing names."""

    def make(pairs, extra=True):
        fields = "doc_id long, text string"
        if not extra:
            return spark.createDataFrame(list(pairs), fields)
        fields += "".join(f", {name} {kind}" for name, kind in EXTRA.items())
        rest = (None, "src0", 7, 1, "x", True, 3, 4, "y", 1, None)
        return spark.createDataFrame([(*p, *rest) for p in pairs], fields)

    return make


@pytest.fixture
def long_text():
    """A text of some 400,000 characters."""
    words = [f"{a}{b}{c}" for a in TEXT_OF for b in TEXT_OF for c in TEXT_OF]
    return " ".join(words[(i * i + 7 * i) % len(words)] for i in range(100_000))


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
