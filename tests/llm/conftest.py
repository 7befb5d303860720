import pytest
from pyspark.sql import Row

SENTENCE = "the quick brown fox jumps over the lazy dog while seven quiet owls watch from an old oak near the river bank and wait for dusk to come so that they may hunt for mice again tonight "


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


#: Names that the operators use inside, as columns of the input.
CLASHES = "n_tokens n_bytes score predicted held_out fingerprint bits component_id key same anchor path first n size taken target draw slice place at extra media pairs start length offset sequence_id _text _words _runs _least".split()

ODD = [
    (None, "no id " + SENTENCE),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, (SENTENCE + "\n") * 400),
    (5, SENTENCE),
    (5, SENTENCE),
    (6, SENTENCE),
    (7, "x" * 5000),
    (8, "Überraschung für alle: naïve façade, 日本語 текст <|endoftext|> don't   stop\x1f\u0085 İ"),
    (9, "one"),
    (10, "one"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, very long, tied and repeated rows, and columns with names that clash."""
    rows = [Row(doc_id=i, text=t, lang="en", source=None if i in (2, 9) else f"s{(i or 0) % 3}", n_chars=len(t or ""), **{c: 1 for c in CLASHES}) for i, t in ODD]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
