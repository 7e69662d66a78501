import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tastegrid.session import build_session  # noqa: E402

BUSINESSES = [
    ("b01", "Napoli Oven", "Pizza, Italian, Restaurants", "napoli oven pizza italian restaurants wood fired"),
    ("b02", "Tokyo Table", "Sushi, Japanese, Restaurants", "tokyo table sushi japanese restaurants omakase"),
    ("b03", "Grill Shack", "Burgers, American, Restaurants", "grill shack burgers american restaurants fries"),
    ("b04", "Casa Maya", "Mexican, Tacos, Restaurants", "casa maya mexican tacos restaurants salsa"),
    ("b05", "Trattoria Uno", "Italian, Pasta, Restaurants", "trattoria uno italian pasta restaurants fresh"),
    ("b06", "Noodle Bar", "Japanese, Ramen, Restaurants", "noodle bar japanese ramen restaurants broth"),
    ("b07", "Prime Cut", "Steakhouse, American, Restaurants", "prime cut steakhouse american restaurants aged"),
    ("b08", "Jade Garden", "Chinese, Dumplings, Restaurants", "jade garden chinese dumplings restaurants tea"),
    ("b09", "Spice Route", "Indian, Curry, Restaurants", "spice route indian curry restaurants tandoor"),
    ("b10", "Harbor Fish", "Seafood, Fish, Restaurants", "harbor fish seafood fish restaurants chowder"),
]

D = dt.datetime
INTERACTIONS = [
    # u1 likes Italian
    ("u1", "b01", 5.0, D(2024, 1, 2)), ("u1", "b05", 5.0, D(2024, 2, 2)),
    ("u1", "b03", 3.0, D(2024, 3, 2)), ("u1", "b07", 2.0, D(2024, 4, 2)),
    # u2 likes Japanese
    ("u2", "b02", 5.0, D(2024, 1, 9)), ("u2", "b06", 5.0, D(2024, 2, 9)),
    ("u2", "b08", 4.0, D(2024, 3, 9)), ("u2", "b04", 3.0, D(2024, 4, 9)),
    # u3 eats everything
    ("u3", "b03", 4.0, D(2024, 1, 20)), ("u3", "b09", 5.0, D(2024, 2, 20)),
    ("u3", "b10", 4.0, D(2024, 3, 20)), ("u3", "b01", 4.0, D(2024, 4, 20)),
    # u4 is almost new
    ("u4", "b04", 4.0, D(2024, 3, 1)), ("u4", "b09", 5.0, D(2024, 4, 1)),
]


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, app_name="tastegrid-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def businesses(spark):
    return spark.createDataFrame(BUSINESSES, "business_id string, name string, categories string, soup string")


@pytest.fixture(scope="session")
def interactions(spark):
    return spark.createDataFrame(INTERACTIONS, "user_id string, business_id string, stars double, date timestamp_ntz")
