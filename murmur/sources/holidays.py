"""Market holidays, landed as a table with one column per year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EM_DASH = "—"


def holidays_long(wide: DataFrame, name: str = "holiday") -> DataFrame:
    """Holiday names and dates, from cells such as ``Friday, January 1``.

    A cell with an em dash means no holiday that year.
    """
    years = [column for column in wide.columns if column != name]
    by_year = F.array(*[F.struct(F.lit(year).alias("year"), F.col(year).alias("cell")) for year in years])
    cells = wide.select(name, F.inline(by_year)).where(~F.contains("cell", F.lit(EM_DASH)))
    parts = F.split(F.regexp_replace("cell", " +", " "), " ")
    month = F.get(parts, F.lit(1))
    day = F.regexp_replace(F.get(parts, F.lit(2)), "[^0-9]", "")
    date = F.to_date(F.concat_ws("-", "year", month, day), "yyyy-MMMM-d")
    return cells.select(name, date.alias("date"))
