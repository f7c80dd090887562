import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))

from lociframe.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def sf():
    return SF


ROWS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names clash with inner ones."""
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, "one", "en", None, 3), (None, "no key here at all", "en", "b", 18),
        (4, "same text twice over here now", "en", "b", 29), (4, "same text twice over here now", "en", "b", 29),
        (5, long, "en", "b", len(long)), (6, "é \U0001f600 a@b.co 1.2.3.4 4111 1111 1111 1111 +1 (743) 555-3824", "en", "b", 60),
        (7, " \t\n\x0b\x0c\r ", "en", "c", 7), (8, "x\n" * 50, "en", "c", 100),
    ]
    frame = spark.createDataFrame(rows, ROWS)
    for name in ("key", "host", "line", "h", "s", "p", "w", "size", "shard", "kept", "piece", "length", "copies"):
        frame = frame.selectExpr("*", f"'clash' as {name}")
    return frame


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ROWS)
