"""Dates in texts, titles and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_TEXT = r"^\d{1,2}-\d{1,2}-\d{4}$"


def text_to_day(text: Column) -> Column:
    """``dd-mm-yyyy`` to a date; null for anything else."""
    return F.when(text.rlike(_DAY_TEXT), F.try_to_date(text, "d-M-yyyy"))


def day_to_text(day: Column) -> Column:
    return F.date_format(day, "dd-MM-yyyy")


def required(day: Column, source: Column) -> Column:
    """Strict variant: a text that holds no day is an error naming that text."""
    message = F.concat(F.lit("no dd-mm-yyyy day in: "), F.coalesce(source, F.lit("null")))
    return F.coalesce(day, F.raise_error(message).cast("date"))


def last_token(text: Column) -> Column:
    return F.element_at(F.split(text, " "), -1)


def decoded_path(path: Column) -> Column:
    """A percent-encoded file path as text; a literal ``+`` is not a space."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix only: ``a.xml.gz`` gives ``a.xml``."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def title_text(name: Column) -> Column:
    """The part of a title or file name before its first dot."""
    return F.element_at(F.split(name, r"\."), 1)


def day_from_path(path: Column) -> Column:
    """Day in the last token of the stem (so null for ``… 01-02-2020.xml.gz``)."""
    return text_to_day(last_token(file_stem(path)))


def day_from_title(title: Column) -> Column:
    """Day in the last token before the first dot."""
    return text_to_day(last_token(title_text(title)))


def within(day: Column, start: Column, end: Column | None = None) -> Column:
    """Closed interval; without ``end`` it is open to the right."""
    inside = day >= start
    return inside if end is None else inside & (end.isNull() | (day <= end))
