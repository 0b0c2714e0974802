"""Which presented tokens stand for a usable session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolved(tokens: DataFrame, sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """token, user_id of the tokens that name a stored session neither revoked nor expired whose user is active.

    ``sessions`` has token_hash, user_id, expires_at and revoked_at; only hashes of tokens are stored.  A session that expires
    this moment is over; an empty or NULL token names nothing.
    """
    live = sessions.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > now)).select("token_hash", "user_id")
    asked = tokens.filter("token <> ''").select("token", F.sha2("token", 256).alias("token_hash"))
    return asked.join(live, "token_hash").join(users.filter("is_active").select("user_id"), "user_id", "left_semi").select("token", "user_id")
