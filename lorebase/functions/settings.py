"""Settings: defaults and what values are taken for (SCA-41), a key-value table (DML-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Each setting's default and allowed values.
SETTINGS = {
    "active_project_root_path": (None, None),
    "llm_provider": ("anthropic", ("anthropic", "openai")),
    "default_model_tier": ("balanced", ("fast", "balanced", "best")),
    "privacy_mode": ("local_first", ("local_first", "restricted_cloud", "local_only")),
    "obsidian_vault_path": ("", None),
}


def normalise(key: str, value: object) -> object:
    """The value that a setting takes: an allowed one or the default; text trimmed."""
    default, allowed = SETTINGS[key]
    if allowed:
        return value if value in allowed else default
    return (value.strip() if isinstance(value, str) else "") or default


def updated(current: dict, values: dict) -> dict:
    """Known keys of ``values`` over ``current`` over the defaults; others are ignored."""
    merged = {k: d for k, (d, _) in SETTINGS.items()} | current | {k: v for k, v in values.items() if k in SETTINGS}
    return {k: normalise(k, v) for k, v in merged.items()}


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """DML-01: ``rows`` in place of those of ``table`` with the same key."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows)


def cascade(child: DataFrame, column: str, deleted: DataFrame, set_null: bool = False) -> DataFrame:
    """DML-07: rows that refer to deleted ids go, or lose the reference."""
    gone = deleted.select(F.col("id").alias("_gone")).distinct()
    if not set_null:
        return child.join(gone, F.col(column) == F.col("_gone"), "left_anti")
    return child.join(gone, F.col(column) == F.col("_gone"), "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")


def transition(table: DataFrame, column: str, ids: list | DataFrame, value: str, allowed_from: list[str] | None = None) -> DataFrame:
    """DML-03: the status of the named rows, where it may change. ``ids`` are a few in
    a list, or any number in a DataFrame (id)."""
    if isinstance(ids, list):
        out, ok = table, F.col("id").isin(ids)
    else:
        named = ids.select(F.col("id").alias("_named")).distinct()
        out, ok = table.join(named, F.col("id") == F.col("_named"), "left"), F.col("_named").isNotNull()
    if allowed_from:
        ok = ok & F.col(column).isin(allowed_from)
    return out.withColumn(column, F.when(ok, F.lit(value)).otherwise(F.col(column))).select(table.columns)
