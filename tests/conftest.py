import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from oracle_check import make_spark

    return make_spark("4")


@pytest.fixture(scope="session")
def panel(spark):
    """24 units of three parents of unlike size, days missing here and there, two leads, a bias of each unit's own."""
    import datetime as dt
    import math

    rows = []
    for g in range(24):
        parent = 11 if g < 2 else 12 if g < 7 else 13
        for k in range(215):
            if (k + 3 * g) % 17 == 0:
                continue
            valid, lead = dt.date(2024, 5, 15) + dt.timedelta(days=k), 1 + (k + g) % 2
            fc = 4 + 9 * abs(math.sin(k * 0.37 + parent)) + 5 * abs(math.cos(k * 1.93 + g))
            wobble = 0.9 * math.sin(12.9898 * k + 78.233 * g)
            rows.append((str(g), parent, 44 + 0.03 * (g % 5), 11 + 0.02 * g, valid - dt.timedelta(days=lead), valid, lead, fc, max(0.0, fc + 1.3 * ((7 * g) % 5 - 2) + wobble), int(valid.month in (6, 7, 8, 9)), float(g % 4)))
    return spark.createDataFrame(rows, "gp_code string, block_lgd int, latitude double, longitude double, issue_date date, valid_date date, lead_day int, "
                                       "fc_rain double, rain_obs double, is_monsoon int, elev_diff double").cache()
