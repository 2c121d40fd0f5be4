import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from barloom.session import local_session

    session = local_session(8, shuffle_partitions=4, memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel():
    """An irregular panel: gaps, flat prices, zero volume, lone dates, short and single-row tickers."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    days = pd.date_range("2020-01-01", periods=160, freq="D")
    rows = []
    for ticker, keep in {"A": 0.9, "B": 0.7, "C": 0.8, "FLAT": 0.9, "SHORT": 0.1, "LONE": 0.6}.items():
        price = 100.0
        for i, day in enumerate(days):
            if rng.random() > keep or (ticker != "LONE" and 60 <= i < 64):
                continue
            price = price if ticker == "FLAT" else round(price * (1 + rng.normal(0, 0.02)), 2)
            high, low = round(price * 1.01, 2), round(price * 0.98, 2)
            volume = 0 if ticker == "C" and 40 <= i < 75 else int(rng.integers(1, 1000))
            rows.append((ticker, day.date(), price, high, low, price, volume))
    rows.append(("ONE", days[5].date(), 9.0, 9.0, 9.0, 9.0, 10))
    return pd.DataFrame(rows, columns=["ticker", "date", "open", "high", "low", "close", "volume"])


@pytest.fixture(scope="session")
def bars(spark, panel):
    schema = "ticker string, date date, open double, high double, low double, close double, volume bigint"
    return spark.createDataFrame(panel, schema)
