"""Message, object and run logs kept as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Run outcomes and the model states they lead to.
SUCCESS = ("success",)
FAILURE = ("error", "fail")


def upsert(
    existing: DataFrame,
    updates: DataFrame,
    key: Sequence[str],
    created: str = "created_at",
    updated: str = "updated_at",
) -> DataFrame:
    """Insert or replace by natural key; the creation time of a row survives.

    Of several updates to one key the newest wins.
    """
    rest = [c for c in existing.columns if c not in (*key, created, updated)]
    newest = F.max_by(F.struct(*rest, created, updated), F.struct(updated, *rest)).alias("_new")
    incoming = updates.groupBy(*key).agg(newest)
    stored = existing.select(*key, F.struct(*rest, created, updated).alias("_old"))
    joined = stored.join(incoming, list(key), "full_outer")
    replaced = F.col("_new").isNotNull()
    return joined.select(
        *key,
        *[F.when(replaced, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in rest],
        F.when(F.col("_old").isNull(), F.col(f"_new.{created}")).otherwise(F.col(f"_old.{created}")).alias(created),
        F.when(replaced, F.col(f"_new.{updated}")).otherwise(F.col(f"_old.{updated}")).alias(updated),
    )


def recent_per_key(df: DataFrame, key: str, order: Sequence[Column], n: int | None = None) -> DataFrame:
    """The first ``n`` rows of every key in the given (total) order, or all of them.

    The rank filter is applied before the shuffle as well, so a hot key sends
    ``n`` rows per task, not all of them.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return (ranked if n is None else ranked.where(F.col("_rank") <= n)).withColumnRenamed("_rank", "position")


def latest_status(run_log: DataFrame, models: DataFrame, key: str, status: str, order: Sequence[str]) -> DataFrame:
    """(key, state) of every known or logged model: deployed or failed after its
    last decisive run, pending when it was never decided."""
    decisive = run_log.where(F.col(status).isin(*SUCCESS, *FAILURE))
    last = decisive.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("_last"))
    return (
        models.select(key)
        .distinct()
        .join(last, key, "full_outer")
        .select(
            key,
            F.when(F.col("_last").isin(*SUCCESS), "deployed")
            .when(F.col("_last").isin(*FAILURE), "failed")
            .otherwise("pending")
            .alias("state"),
        )
    )
