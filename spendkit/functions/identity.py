"""Stable ids and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..constants import PROFILE_FIELDS


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts joined by `|`; null counts as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 16)


def _pick(columns: Sequence[str], *names: str) -> Column:
    """First of `names` that is neither empty nor zero; the last one is taken as it is."""
    found = []
    for name in names:
        if name in columns:
            value = F.col(name).cast("string")
            if name != names[-1]:
                value = F.when((value != "") & ~value.rlike(r"^-?0+(\.0+)?$"), value)
            found.append(value)
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _digest(fields: dict[str, Column]) -> Column:
    body = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def merchant_fingerprint(columns: Sequence[str], version: str = "v1") -> Column:
    """Digest of the merchant side of a transaction; `columns` are those of the frame."""
    return _digest(
        {
            "v": F.lit(version),
            "merchant_id": _pick(columns, "merchant_id"),
            "merchant_city": _pick(columns, "merchant_city"),
            "merchant_state": _pick(columns, "merchant_state"),
            "mcc_code": _pick(columns, "mcc_code", "mcc"),
            "mcc_description": _pick(columns, "mcc_description"),
            "use_chip": _pick(columns, "use_chip"),
            "errors": _pick(columns, "errors"),
        }
    )


def transaction_fingerprint(columns: Sequence[str], version: str = "v1") -> Column:
    """Digest of a whole transaction, without card secrets."""
    return _digest(
        {
            "v": F.lit(version),
            "id": _pick(columns, "id"),
            "client_id": _pick(columns, "client_id"),
            "card_id": _pick(columns, "card_id"),
            "transaction_dt": _pick(columns, "transaction_dt", "date"),
            "amount_usd": _pick(columns, "amount_usd", "amount"),
            "mcc_code": _pick(columns, "mcc_code", "mcc"),
            "mcc_description": _pick(columns, "mcc_description"),
            "merchant_id": _pick(columns, "merchant_id"),
            "merchant_city": _pick(columns, "merchant_city"),
            "merchant_state": _pick(columns, "merchant_state"),
            "use_chip": _pick(columns, "use_chip"),
            "errors": _pick(columns, "errors"),
        }
    )


def profile_key() -> Column:
    """The identity fields joined by `|`; null is empty, the flag reads `True` or `False`."""
    parts = [
        F.initcap(F.col(f).cast("string")) if f == "is_online" else F.col(f).cast("string")
        for f in PROFILE_FIELDS
    ]
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def profile_id(key: Column) -> Column:
    return F.concat(F.lit("p"), F.substring(F.sha2(key, 256), 1, 16))
