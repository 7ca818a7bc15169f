"""The set of domain tables an analysis runs on, read lazily and only when used."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import SCHEMAS


class Tables:
    """Domain tables plus the instant ``as_of`` that stands for "now" in every analysis.

    ``loader(name)`` returns one table.  Attribute access (``tables.snapshots``) loads a table once.
    """

    def __init__(self, spark: SparkSession, loader, as_of: dt.datetime):
        self.spark = spark
        self.as_of = as_of
        self._loader = loader
        self._loaded: dict[str, DataFrame] = {}

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, as_of: dt.datetime, org_id: int | None = None) -> Tables:
        """Tables stored as ``root/<name>`` in Parquet with the declared schemas."""

        def load(name: str) -> DataFrame:
            df = spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}") if name in SCHEMAS else spark.read.parquet(f"{root}/{name}")
            return scan(df, org_id) if org_id is not None and "org_id" in df.columns else df

        return cls(spark, load, as_of)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._loaded:
            self._loaded[name] = self._loader(name)
        return self._loaded[name]

    def replace(self, **frames: DataFrame) -> Tables:
        """Same catalogue with some tables exchanged."""
        other = Tables(self.spark, self._loader, self.as_of)
        other._loaded = {**self._loaded, **frames}
        return other

    @property
    def now(self) -> Column:
        return F.lit(self.as_of)

    def ago(self, **delta) -> Column:
        return F.lit(self.as_of - dt.timedelta(**delta))


def scan(df: DataFrame, org_id) -> DataFrame:
    """One tenant's rows; prunes partitions when the table is laid out by ``org_id``."""
    return df.where(F.col("org_id") == org_id)


def visible(df: DataFrame, memberships: DataFrame, user, roles: list[str] | None = None) -> DataFrame:
    """Rows of the organisations a user belongs to, optionally in certain roles."""
    mine = memberships.where(F.col("user_id") == user)
    if roles:
        mine = mine.where(F.col("role").isin(roles))
    return df.join(mine.select("org_id").distinct(), "org_id", "left_semi")


def visible_by_user(df: DataFrame, memberships: DataFrame, users: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """How many rows each of many users may see: one count per organisation, then a join on it."""
    m = memberships.join(users, "user_id", "left_semi")
    if roles:
        m = m.where(F.col("role").isin(roles))
    per_org = df.groupBy("org_id").agg(F.count(F.lit(1)).alias("rows_in_org"))
    return (
        m.select("user_id", "org_id").distinct().join(per_org, "org_id")
        .groupBy("user_id").agg(F.sum("rows_in_org").alias("visible_rows"))
    )


def visible_profiles(profiles: DataFrame, memberships: DataFrame, user) -> DataFrame:
    """Own profile and those of everybody sharing an organisation."""
    my_orgs = memberships.where(F.col("user_id") == user).select("org_id").distinct()
    peers = memberships.join(my_orgs, "org_id", "left_semi").select("user_id")
    allowed = peers.unionByName(profiles.where(F.col("user_id") == user).select("user_id"))
    return profiles.join(allowed, "user_id", "left_semi")


def stamp_updated(df: DataFrame, as_of: Column) -> DataFrame:
    """Column the write path sets on every changed row."""
    return df.withColumn("updated_at", as_of)


def profiles_from_users(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profile rows for users that have none yet."""
    fresh = users.select(
        "user_id", F.coalesce("email", F.lit("")).alias("email"), F.coalesce("full_name", F.lit("")).alias("full_name")
    )
    return fresh.join(profiles.select("user_id"), "user_id", "left_anti")
