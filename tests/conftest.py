import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from spendkit.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TX_SCHEMA = (
    "id string, client_id long, transaction_dt timestamp_ntz, amount_usd decimal(18,2), merchant_id string, "
    "merchant_city string, merchant_state string, mcc_code string, mcc_description string"
)

CODES = {
    "Dining": ("5812", "Eating Places and Restaurants"),
    "Groceries": ("5411", "Grocery Stores, Supermarkets"),
    "Entertainment": ("7832", "Motion Picture Theaters"),
    "Shopping": ("5311", "Department Stores"),
    "Subscriptions": ("5968", "Subscription Services"),
}


@pytest.fixture(scope="session")
def make_tx(spark):
    """Rows of (client, 'YYYY-MM-DD HH:MM', amount, merchant, category) to enriched transactions."""
    from spendkit.operators.labeling import with_rule_category

    def make(*rows):
        data = []
        for i, (client, at, amount, merchant, category) in enumerate(rows):
            moment = datetime.fromisoformat(at)
            amount = None if amount is None else Decimal(str(amount))
            data.append((f"t{i:04d}", client, moment, amount, merchant, "Town", "ST", *CODES[category]))
        return with_rule_category(spark.createDataFrame(data, TX_SCHEMA))

    return make


@pytest.fixture(scope="session")
def make_limits(spark):
    def make(**limits):
        rows = [(int(k[1:]), None if v is None else Decimal(str(v))) for k, v in limits.items()]
        return spark.createDataFrame(rows, "client_id long, monthly_discretionary_limit_usd decimal(18,2)")

    return make
