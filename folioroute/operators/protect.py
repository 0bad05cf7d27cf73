"""Encrypted storage of documents whose rule sets a password."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioroute.operators.matching import attach_rule
from folioroute.sources.rules import RuleSet


def _key(password: Column) -> Column:
    return F.unhex(F.sha2(password, 256))


def protect_content(matched: DataFrame, rules: RuleSet, content: str = "content") -> DataFrame:
    """Encrypt ``content`` of rows whose ``rule_id`` encrypts (AES-256, GCM).

    The user password opens ``content``; ``owner_key`` holds the user key
    sealed with the owner password, so that one opens it too; it is null for a
    rule without an owner password. Rows of other rules keep their bytes. Passwords do not leave the plan.
    """
    rows = attach_rule(matched, rules, "user_pass", "owner_pass", "encrypt")
    user_key = _key(F.col("user_pass"))
    data = F.col(content).cast("binary")
    sealed = F.coalesce("encrypt", F.lit(False))
    return rows.withColumns(
        {
            content: F.when(sealed, F.aes_encrypt(data, user_key, F.lit("GCM"))).otherwise(data),
            "owner_key": F.when(
                sealed & (F.col("owner_pass") != ""),
                F.aes_encrypt(user_key, _key(F.col("owner_pass")), F.lit("GCM")),
            ),
            "protected": sealed,
        }
    ).drop("user_pass", "owner_pass", "encrypt")


def open_content(
    rows: DataFrame, password: str, owner: bool = False, content: str = "content", into: str = "content"
) -> DataFrame:
    """Decrypt protected rows with the user or the owner password; null where
    the password is not theirs."""
    key = _key(F.lit(password))
    if owner:
        key = F.try_aes_decrypt("owner_key", key, F.lit("GCM"))
    opened = F.try_aes_decrypt(F.col(content), key, F.lit("GCM"))
    return rows.withColumn(into, F.when(F.col("protected"), opened).otherwise(F.col(content)))
