import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DEAL_COLUMNS = (
    "seq int, id string, title string, brand string, sport string, category string, "
    "youth_flag boolean, size_type string, sizes array<string>, age_range string, "
    "msrp decimal(12,2), price decimal(12,2), currency string, coupon_code string, "
    "retailer string, sku string, mpn string, gtin string, image_url string, "
    "canonical_url string, in_stock boolean, stock_level string, shipping_notes string, "
    "last_seen timestamp_ntz, first_seen timestamp_ntz, ends_at timestamp_ntz, "
    "promotion_type string, score double"
)
_NAMES = [part.strip().split(" ")[0] for part in DEAL_COLUMNS.replace("decimal(12,2)", "d").split(",")]


def deal(seq, **given):
    row = dict.fromkeys(_NAMES)
    row.update(
        seq=seq, id=f"d{seq}", title="Plain Thing", youth_flag=False, size_type="unknown",
        price=Decimal("30.00"), currency="USD", retailer="Store A",
        canonical_url=f"https://a.example/{seq}",
    )
    row.update(given)
    for money in ("price", "msrp"):
        if row[money] is not None:
            row[money] = Decimal(str(row[money])).quantize(Decimal("0.01"))
    return tuple(row[n] for n in _NAMES)


@pytest.fixture(scope="session")
def make_deals(spark):
    return lambda *rows: spark.createDataFrame(list(rows), DEAL_COLUMNS)
