import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from stockloom.session import build_session

    session = build_session("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sales(spark):
    """Series of 1 to 60 rows, one of them much longer than the others."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    rows = []
    for group in range(24):
        length = 400 if group == 5 else int(rng.integers(1, 60))
        for day in range(length):
            rows.append((
                pd.Timestamp("2022-01-01") + pd.Timedelta(days=day), f"S{group // 6:03d}", f"P{group % 6:04d}",
                float(rng.integers(0, 300)), float(rng.integers(0, 500)), round(float(rng.uniform(5, 100)), 2),
            ))
    pdf = pd.DataFrame(rows, columns=["sale_date", "store_id", "product_id", "units_sold", "inventory_level", "price"])
    df = spark.createDataFrame(pdf.sample(frac=1.0, random_state=1)).selectExpr("cast(sale_date as date) sale_date", *pdf.columns[1:])
    return df.cache()
