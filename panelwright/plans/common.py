"""Small helpers shared by the registered queries."""

from pyspark.sql import DataFrame

from panelwright.functions.scalar import day_text, rounded
from panelwright.plans.sql import day, r

KS = f"{day()} AS date, code"


def keyed(df: DataFrame, digits: int = 8, keep=(), **cols) -> DataFrame:
    """Result rows: the panel key as text, kept columns and rounded values."""
    return df.select(day_text().alias("date"), "code", *keep,
                     *[rounded(v, digits).alias(k) for k, v in cols.items()])


def keyed_sql(source: str, digits: int = 8, keep=(), **cols) -> str:
    parts = [KS, *keep, *[f"{r(v, digits)} AS {k}" for k, v in cols.items()]]
    return f"SELECT {', '.join(parts)} FROM {source}"
