"""Lower case and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"


def tokens(text: Column | str) -> Column:
    """Runs of a-z and 0-9 of the text in lower case; all else, accented letters too, separates. Null has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))
