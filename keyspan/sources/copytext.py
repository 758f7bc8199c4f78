"""The text form in which databases copy tables: a line a row, tabs between fields, backslash escapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that stand for others after a backslash; any other stands for itself.
_ESCAPES = (("b", "\b"), ("f", "\f"), ("n", "\n"), ("r", "\r"), ("t", "\t"), ("v", "\v"))
#: Stands for an escaped backslash while the others are read; it is in no valid text.
_HOLD = "\x00"


def unescape(field: Column) -> Column:
    r"""A field's value; the field \N is null. Null is decided before any escape is read."""
    out = F.replace(field, F.lit("\\\\"), F.lit(_HOLD))
    for letter, char in _ESCAPES:
        out = F.replace(out, F.lit("\\" + letter), F.lit(char))
    out = F.regexp_replace(out, r"\\(.)", "$1")
    return F.when(field != "\\N", F.replace(out, F.lit(_HOLD), F.lit("\\")))


def escape(value: Column) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for letter, char in _ESCAPES:
        out = F.replace(out, F.lit(char), F.lit("\\" + letter))
    return F.coalesce(out, F.lit("\\N"))


def parse_lines(lines: DataFrame, columns: Sequence[str], line: str = "value") -> DataFrame:
    """Rows of text columns from lines; a line with another number of fields is an error."""
    fields = F.split(F.col(line), "\t", -1)
    checked = F.when(F.size(fields) == len(columns), fields).otherwise(F.raise_error(F.concat(F.lit(f"a line has not {len(columns)} fields but "), F.size(fields).cast("string"))))
    return lines.select(checked.alias("f")).select(*[unescape(F.col("f")[i]).alias(c) for i, c in enumerate(columns)])


def read(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Files of copied rows. Lines end at a line feed only, for values hold escaped ones."""
    return parse_lines(spark.read.option("lineSep", "\n").text(path), columns)


def write(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", *[escape(text_of(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema]).alias("value")).write.option("lineSep", "\n").text(path)


def text_of(value: Column, kind: T.DataType) -> Column:
    """A value as the database writes it: hex for bytes, t and f for booleans, ISO dates and times."""
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(value)))
    if isinstance(kind, T.BooleanType):
        return F.when(value, "t").when(~value, "f")
    return value.cast("string")


def typed(text: Column, kind: T.DataType) -> Column:
    """The value of a field of a type; text that is none is an error, as the database would have it."""
    if isinstance(kind, T.BinaryType):
        return F.unhex(F.substring(text, 3, 1 << 30))
    if isinstance(kind, T.BooleanType):
        return F.when(text == "t", True).when(text == "f", False).otherwise(text.cast("boolean"))
    return text.cast(kind)


def counted_tag(tag):
    """Column expression: a command tag without its row count; null for a tag that has none."""
    return F.when(tag.rlike(r"\A.* [0-9]+\z"), F.regexp_replace(tag, r" [0-9]+\z", ""))


def returning_tag(verb):
    """Column expression: the tag, before its count, of a write that returns rows; null for other statements."""
    return F.when(verb == "Insert", "INSERT 0").when(verb == "Update", "UPDATE").when(verb == "Delete", "DELETE")
