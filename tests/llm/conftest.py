import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, score string, h string"

PROSE = {
    "en": "The river runs through the old town and the people walk along the water every evening when the work is done and the shops are closed",
    "de": "Der Fluss läuft durch die alte Stadt und die Leute gehen jeden Abend am Wasser entlang wenn die Arbeit getan ist und die Läden zu sind",
    "fr": "La rivière traverse la vieille ville et les gens marchent le long de l'eau chaque soir quand le travail est fini et que tout est fermé",
}


def make(spark, rows):
    """Documents of (doc_id, text, lang) with extra columns whose names clash with those of results and internals."""
    return spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None, "r", "k", "x", "y") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a very long text, texts without letters, extra columns."""
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    rows = [(1, PROSE["en"], "en"), (1, PROSE["en"], "en"), (2, None, None), (3, "", "en"), (4, " \n\t ", None), (None, PROSE["de"], "de"), (5, PROSE["fr"], "fr"), (6, "123 %% 456", "en"), (7, long, None), (8, PROSE["en"], None), (None, None, None)]
    return make(spark, rows)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
