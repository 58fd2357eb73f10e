"""Tolerant reading of text columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean "missing" in delivered CSV files.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The timestamp layouts that are known, the usual one first. Each has a pattern and the
# order of its groups in the usual layout.
LAYOUTS = {
    "yyyy-MM-dd HH:mm:ss": (r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})$", "$1"),
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]": (r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)$", "$1"),
    "yyyy-MM-ddTHH:mm:ss": (r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})$", "$1 $2"),
    "yyyy/MM/dd HH:mm:ss": (r"^(\d{4})/(\d{2})/(\d{2}) (\d{2}:\d{2}:\d{2})$", "$1-$2-$3 $4"),
    "dd/MM/yyyy HH:mm:ss": (r"^(\d{2})/(\d{2})/(\d{4}) (\d{2}:\d{2}:\d{2})$", "$3-$2-$1 $4"),
    "MM/dd/yyyy HH:mm:ss": (r"^(\d{2})/(\d{2})/(\d{4}) (\d{2}:\d{2}:\d{2})$", "$3-$1-$2 $4"),
    "dd.MM.yyyy HH:mm:ss": (r"^(\d{2})\.(\d{2})\.(\d{4}) (\d{2}:\d{2}:\d{2})$", "$3-$2-$1 $4"),
    "dd/MM/yyyy HH:mm": (r"^(\d{2})/(\d{2})/(\d{4}) (\d{2}:\d{2})$", "$3-$2-$1 $4:00"),
    "yyyy-MM-dd HH:mm": (r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2})$", "$1:00"),
    "yyyy-MM-dd": (r"^(\d{4}-\d{2}-\d{2})$", "$1 00:00:00"),
}
USUAL_LAYOUT = next(iter(LAYOUTS))


def missing_to_null(df: DataFrame) -> DataFrame:
    """Turn every missing-value text of every string column into NULL."""
    return df.select(
        *(
            F.when(~F.col(f.name).isin(*MISSING_TEXTS), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        )
    )


def may_have_layout(text: Column, layout: str) -> Column:
    """Whether a text has the length of a layout and some of its separators: cheap, and true for all that match its pattern."""
    least = len(layout.partition("[")[0])
    most = len(layout.replace("[", "").replace("]", "")) + 2  # a pattern allows a line end after the text
    places = [i for i in (2, 4, 10) if i < least and not layout[i].isalpha() or layout[i : i + 1] == "T"]
    found = F.length(text).between(least, most)
    for i in places:
        found = found & (F.substring(text, i + 1, 1) == layout[i])
    return found


def parse_timestamp(text: Column, layout: str = USUAL_LAYOUT) -> Column:
    """Zone-free timestamp of a text; any other layout or an impossible date gives NULL."""
    pattern, usual = LAYOUTS[layout]
    written = text if layout == USUAL_LAYOUT else F.regexp_replace(text, pattern, usual)
    return F.when(may_have_layout(text, layout) & text.rlike(pattern), written.try_cast(T.TimestampNTZType()))


def parse_timestamps(df: DataFrame, names: Iterable[str], layouts: Mapping[str, str] | None = None) -> DataFrame:
    """Parse the named columns that are still text; typed ones stay as they are.

    ``layouts`` names the layout of a column, if it is not the usual one.
    """
    layouts = layouts or {}
    parsed = {
        name: parse_timestamp(F.col(name), layouts.get(name, USUAL_LAYOUT))
        for name in names
        if name in df.columns and isinstance(df.schema[name].dataType, T.StringType)
    }
    return df.withColumns(parsed) if parsed else df


def cast_known(df: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    """Cast the columns present in both; a text that is no such value becomes NULL."""
    casts = {
        name: F.col(name).try_cast(dtype)
        for name, dtype in types.items()
        if name in df.columns and df.schema[name].dataType != dtype
    }
    return df.withColumns(casts) if casts else df


def lost(value: Column, source: T.DataType, target: T.DataType, layout: str = USUAL_LAYOUT) -> Column:
    """Whether a value that is present does not survive as ``target``: unreadable, out of range or rounded."""
    if isinstance(target, T.TimestampNTZType):
        typed = parse_timestamp(value, layout) if isinstance(source, T.StringType) else value.try_cast(target)
        return value.isNotNull() & typed.isNull()
    exact = T.DecimalType(38, 10)
    kept = value.try_cast(target)
    return value.isNotNull() & (kept.isNull() | ~kept.cast(exact).eqNullSafe(value.try_cast(exact)))
