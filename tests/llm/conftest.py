import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """A documents table from texts, ``(id, text)`` pairs or whole rows, with extra columns of clashing names."""

    def build(rows, extra=False):
        out = []
        for i, row in enumerate(rows):
            row = (i, row) if row is None or isinstance(row, str) else row
            row = (*row, "en", f"s{i % 3}", None if row[1] is None else len(row[1])) if len(row) == 2 else row
            out.append(row)
        df = spark.createDataFrame(out, DOC)
        if extra:
            for name in ("row", "size", "n", "key", "component", "sequence_id", "removed", "copies", "p", "words", "_id", "_copies", "_own2", "look", "cls", "bin", "held_out"):
                df = df.withColumn(name, df["doc_id"])
        return df

    return build


def text(rng, n, vocabulary=4000):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % vocabulary)
