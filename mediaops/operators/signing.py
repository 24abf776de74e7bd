"""Signed requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.functions import keys as K


def sign_requests(requests: DataFrame, key: str) -> DataFrame:
    """Adds ``token``, the signature of path and params."""
    return requests.withColumn("token", K.hmac_sha256(K.canonical_query(F.col("path"), F.col("params")), key))


def verify_tokens(requests: DataFrame, key: str | None) -> DataFrame:
    """Adds ``auth``: ok, token_missing, token_malformed or token_invalid; all are ok without a key."""
    return requests.withColumn("auth", K.verify_token(F.col("path"), F.col("params"), key))
