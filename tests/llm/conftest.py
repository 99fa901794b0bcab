import pytest

#: Columns that operators do not read, with names that clash with ones they use inside.
CLASHING = "id long, mark long, block int, fp long, part int, n int, window long, own_mark long, replaced long, kept long, moved long, rep long, component long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents with extra columns whose names clash."""

    def make(rows, columns="doc_id long, text string"):
        schema = f"{columns}, {CLASHING}"
        return spark.createDataFrame([(*row, *[7] * CLASHING.count(" l"), *[7] * CLASHING.count(" i")) for row in rows], schema)

    return make
