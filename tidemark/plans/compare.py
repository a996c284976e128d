"""Compare a query with its SQL on the same parquet files (used by the tests)."""

from __future__ import annotations

from pathlib import Path

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def oracle_frame(sql: str, folder: str) -> pd.DataFrame:
    import duckdb

    with duckdb.connect() as db:
        for name in TABLES.split():
            path = Path(folder) / f"{name}.parquet"
            if path.exists():
                db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
        return db.execute(sql).df()


def _shown(value) -> str:
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return "NULL"
    if isinstance(value, float):
        return repr(int(value)) if value.is_integer() else repr(value)
    if hasattr(value, "year"):
        return pd.Timestamp(value).isoformat()
    return str(value)


def differences(actual: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """None when both hold the same rows in any order."""
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} <> {sorted(expected.columns)}"
    if len(actual) != len(expected):
        return f"{len(actual)} rows <> {len(expected)}"
    names = sorted(actual.columns)

    def rows(frame: pd.DataFrame) -> list[str]:
        shown = frame[names].astype(object).map(_shown)
        return sorted("|".join(r) for r in shown.itertuples(index=False, name=None))

    left, right = rows(actual), rows(expected)
    if left != right:
        pairs = [(a, b) for a, b in zip(left, right) if a != b][:2]
        return f"values {names}: {pairs}"
    return None
