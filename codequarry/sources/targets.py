"""Change targets from JSON, and configuration from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from codequarry.functions import paths

TARGETS = "array<struct<path:string,start_line:bigint,end_line:bigint,description:string>>"
MOST_TARGETS = 25


def read_targets(spark: SparkSession, text: str) -> DataFrame:
    """Rows of a JSON array; ValueError for what is no valid target list."""
    df = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", TARGETS).alias("t"))
    rows = df.select(F.posexplode("t").alias("ordinal", "x")).select("ordinal", "x.*").withColumn("path", paths.normalize(F.trim("path")))
    problems = rows.select(
        F.when(F.col("path").isNull(), "path must be relative and inside the repository")
        .when((F.col("start_line") < 1) | (F.col("end_line") < 1), "line ranges are 1-based")
        .when(F.col("end_line") < F.col("start_line"), "end_line before start_line")
        .when(F.coalesce(F.trim("description"), F.lit("")) == "", "description must not be empty").alias("p")
    ).where("p is not null").limit(1).collect()
    if problems:
        raise ValueError(problems[0]["p"])
    if df.where("t is null").count() or rows.count() > MOST_TARGETS:
        raise ValueError(f"a JSON array of at most {MOST_TARGETS} targets is needed")
    return rows


@dataclass(frozen=True)
class EmbedConfig:
    """Models and budgets; older byte limits become tokens (4 bytes each)."""

    fast_model: str = "hashed-64"
    quality_model: str | None = None
    fast_batch: int = 16
    quality_batch: int = 16
    quality_workers: int = 1
    fast_tokens: int = 2048
    quality_tokens: int = 512

    @classmethod
    def from_values(cls, values: dict[str, str]) -> EmbedConfig:
        def number(name: str, default: int) -> int:
            try:
                return max(1, int(values[name]))
            except (KeyError, ValueError):
                return default

        def tokens(layer: str, default: int) -> int:
            if f"{layer}_MAX_TOKENS" in values:
                return number(f"{layer}_MAX_TOKENS", default)
            limit = number(f"{layer}_MAX_BYTES", default)
            return default if limit == default else max(1, limit // 4)

        d = cls()
        return cls(
            values.get("FAST_MODEL") or d.fast_model, values.get("QUALITY_MODEL") or None, number("FAST_BATCH", 16), number("QUALITY_BATCH", 16),
            number("QUALITY_WORKERS", 1), tokens("FAST", 2048), tokens("QUALITY", 512),
        )

    @classmethod
    def from_environment(cls, prefix: str = "CODEQUARRY_") -> EmbedConfig:
        return cls.from_values({k.removeprefix(prefix): v for k, v in os.environ.items() if k.startswith(prefix)})
