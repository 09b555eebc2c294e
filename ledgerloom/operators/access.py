"""Who may read which document. None means no restriction; an empty frame means no access."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FULL = "full"


def granted(permission: str, now: datetime | Column) -> Column:
    """Whether a row of permissions (permissions, is_owner, expires_at) grants the permission at this time."""
    at = now if isinstance(now, Column) else F.lit(now)
    held = F.array_contains("permissions", permission) | F.array_contains("permissions", FULL)
    return (F.col("expires_at").isNull() | (F.col("expires_at") > at)) & (F.col("is_owner") | F.coalesce(held, F.lit(False)))


def accessible(permissions: DataFrame, user_id: int | str, permission: str, now: datetime | Column) -> DataFrame:
    """(document_id) of the documents that the user may use so."""
    return permissions.where((F.col("user_id") == user_id) & granted(permission, now)).select("document_id").distinct()


def expired(permissions: DataFrame, now: datetime | Column) -> DataFrame:
    """Rows that a clean-up takes out: past their time, and not an owner's."""
    at = now if isinstance(now, Column) else F.lit(now)
    return permissions.where((F.col("expires_at") < at) & ~F.col("is_owner"))


def restricted(rows: DataFrame, acl: DataFrame | None, key: str = "document_id") -> DataFrame:
    """The rows whose document is in acl; all of them if acl is None. Spark pushes the semi-join to the scan of rows."""
    return rows if acl is None else rows.join(acl.select(F.col(acl.columns[0]).alias(key)), key, "left_semi")


def covered(sources: Column, allowed: Column) -> Column:
    """Whether every source document of an answer is an allowed one."""
    return F.size(F.array_except(sources, allowed)) == 0
