from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import SparkSession

from credlake.config import Settings


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("credlake-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_settings():
    """Loose parameters for a corpus of a few dozen rows."""
    return Settings(test_size=0.2, validation_size=0.2, min_df=1, max_df=1.0, cv_folds=2)


@pytest.fixture(scope="session")
def tiny_news(spark):
    """Eighty invented rows: loud FAKE items and plain REAL ones."""
    topics = [f"{a} {b}" for a in ("harbour", "museum", "tram", "orchard", "library") for b in ("plan", "fund", "route", "vote")]
    rows = []
    for n, topic in enumerate(topics):
        rows.append((4 * n, "", f"UNBELIEVABLE!!! The secret {topic} they hide from you!!! Share now", 1))
        rows.append((4 * n + 1, "", f"EXPOSED: anonymous insider reveals the hidden {topic} scandal!!!", 1))
        rows.append((4 * n + 2, "", f"The council published its yearly report on the {topic} on Monday.", 0))
        rows.append((4 * n + 3, "", f"Officials opened a public consultation about the {topic} this week.", 0))
    return spark.createDataFrame(rows, "doc_id long, title string, text string, label int")


def values(df, *names):
    """Rows as tuples of the named columns."""
    return [tuple(r[n] for n in names) for r in df.select(*names).collect()]
