import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from equityspark.session import build_session

    s = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("ckpt")),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars from {ticker: [closes]} on consecutive days; open=close, high/low +-1 %."""
    import datetime

    def build(series, volume=1000.0):
        day0 = datetime.date(2020, 1, 1)
        rows = [
            (t, day0 + datetime.timedelta(days=i), float(p), float(p) * 1.01, float(p) * 0.99, float(p), float(volume))
            for t, ps in series.items() for i, p in enumerate(ps)
        ]
        return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")

    return build
