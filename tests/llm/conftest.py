import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    import brute

    rows = brute.awkward_documents()
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Repeated rows, null ids and texts, and extra columns with the names operators use inside."""
    long_ = " ".join(f"w{i}" for i in range(120))
    rows = [(1, "same words here once more again"), (1, "same words here once more again"), (None, None), (None, "same words here once more again"),
            (2, ""), (3, None), (4, long_), (5, long_), (6, long_ + " tail")]
    names = ("key", "component", "rep", "probability", "kept", "tokens", "length", "__x", "id", "start", "name", "band", "weight")
    frame = spark.createDataFrame(
        [(d, t, "en", "s", 0, *[str(k) for k in range(len(names))]) for d, t in rows], SCHEMA + "".join(f", `{n}` string" for n in names))
    return rows, frame
