import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, spans string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns that clash with outputs."""
    prose = " ".join(f"word{i % 97} and{i % 13} then{i}" for i in range(700))
    rows = [
        (1, "the mit license holds under the mit license here", "en", "b"),
        (1, "the mit license holds under the mit license here", "en", "b"),
        (2, None, "en", None),
        (3, "", None, "a"),
        (4, " \t\n ", "fr", "a"),
        (5, prose, "en", "c"),
        (6, prose + " last", "en", "c"),
        (7, prose.upper(), "de", None),
        (8, "le chat est sur la table " * 4000, "fr", "b"),
        (9, "a1" * 60_000, None, None),
        (None, "call +1 (743) 555-3824 or mail x.y@example.com", "en", "a"),
        (11, "é 𝒳 ß", "de", "𐍈"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "s", "t", "u") for r in rows], SCHEMA)
