import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dripline.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    yield session
    session.stop()


@pytest.fixture
def slots_of(spark):
    """Slot sums from (person, day of January 2024, slot, amount) tuples; pattern A."""

    def make(rows, pattern="A"):
        data = [(pattern, p, f"2024-01-{d:02d}", s, str(a)) for p, d, s, a in rows]
        df = spark.createDataFrame(data, "pattern string, person_id long, date string, slot int, amount string")
        return df.withColumn("date", df["date"].cast("date")).withColumn("amount", df["amount"].cast("decimal(18,2)"))

    return make
