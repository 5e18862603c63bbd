import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from texts, or from (doc_id, text) or (doc_id, text, source)."""

    def make(rows, **extra):
        full = []
        for k, r in enumerate(rows):
            i, text, *rest = r if isinstance(r, tuple) else (k, r)
            full.append((i, text, "en", rest[0] if rest else "s", None if text is None else len(text)))
        df = spark.createDataFrame(full, SCHEMA)
        for name, value in extra.items():
            df = df.withColumn(name, value)
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """Invented prose of n words with a vocabulary of its own."""
    import numpy as np

    def make(seed: int, n: int) -> str:
        rng = np.random.default_rng(seed)
        words = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 9))) for _ in range(max(20, n))]
        return " ".join(words[i] for i in rng.integers(0, len(words), n))

    return make
