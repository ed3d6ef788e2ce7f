"""Settings in the names of archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(files: DataFrame, column: str = "name") -> DataFrame:
    """Adds n and accuracy, null where the name has none."""
    n = F.regexp_extract(column, r"(?:^|_)N(\d+)(?=_|\.|$)", 1)
    acc = F.regexp_extract(column, r"(?:^|_)Acc(\d+(?:\.\d+)?)", 1)
    return files.withColumns({"n": F.nullif(n, F.lit("")).cast("int"), "accuracy": F.nullif(acc, F.lit("")).cast("double")})
