"""Typing rules for untyped text columns: value and ok-flag Column pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date grammar: tokens by role, the orders in which they make a date, and a time
# behind it that the date type drops. A text of more than 60 characters is no date.
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_TOKEN = {
    "Y": r"(\d{4}|3[2-9]|[4-9]\d)",  # a year that can't be a day
    "y": r"(\d{4}|\d{2})",
    "m": r"(0?[1-9]|1[0-2])",
    "n": "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)",
    "d": r"(0?[1-9]|[12]\d|3[01])(?:st|nd|rd|th)?",
    "F": r"(\d{4})",
}
_GAP = r"[-/., ]+(?:of +)?"
_COMPACT = r"(\d{4})(\d{2})(\d{2})"
_TIME = (
    r"(?:[ t,]+(?:[01]?\d|2[0-3]):[0-5]?\d(?::[0-5]?\d(?:[.,]\d{1,9})?)?(?: ?[ap]\.?m\.?)?|t(?:[01]\d|2[0-3])[0-5]\d(?:[0-5]\d)?)"
    r"(?: ?(?:z|utc|gmt|[+-]\d{2}:?\d{2}))?"
)


def _date_grammar(day_first: bool, partial: str) -> tuple[str, str]:
    """The pattern of a date and its replacement ``=year-month-day``. Orders are tried one after another, so
    of two readings the first one counts, and the second where the first makes no sense."""
    orders = ["Ymd", "Ynd", "dny", "ndy", *(("dmy", "mdy") if day_first else ("mdy", "dmy"))]
    orders += ["F", "Fm", "Fn", "nF"] if partial == "first" else []
    roles = "".join(orders) + "ymd"
    tried = "|".join([*(_GAP.join(_TOKEN[c] for c in order) for order in orders), _COMPACT])
    taken = ("".join(f"${i + 1}" for i, c in enumerate(roles) if c in of) for of in ("YyF", "mn", "d"))
    weekday = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[., ]+)?"
    return rf"^(?=.{{1,60}}$){weekday}(?:{tried})(?:{_TIME})?$", "=" + "-".join(taken)


_INT_TEXT = r"^\s*[+-]?[0-9]+\s*$"


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def nullable_int(c: Column) -> tuple[Column, Column]:
    """Null or blank -> null; else an integer text in int range, or the row is bad.
    ``' 5 '`` is 5; ``'5.0'`` and ``'zz'`` are bad."""
    parsed = F.when(c.rlike(_INT_TEXT), F.trim(c).try_cast("int"))
    value = F.when(_blank(c), F.lit(None).cast("int")).otherwise(parsed)
    ok = _blank(c) | parsed.isNotNull()
    return value, ok


def cut_date(c: Column, day_first: bool = False, partial: str = "reject") -> Column:
    """A text in the date grammar as ``=year-month-day``, another (in lower case) as it is."""
    return F.regexp_replace(F.lower(F.trim(c)), *_date_grammar(day_first, partial))


def read_date(c: Column, day_first: bool = False, partial: str = "reject", cut: Column | None = None) -> Column:
    """A text in the date grammar as a date, else null. One pass cuts it into tokens; their order follows
    from what they are:

    * a month's name is the month. If the first token has four digits or is above 31, it is the year; else the last is;
    * numbers only: if the first is such a year, month and day follow; else the last is the year and the month comes first
      (``day_first``: the day), but a month above 12 changes places with the day, as ``31/12/1999`` has one reading only;
    * years have four digits, or two: 00-68 are 2000-2068, 69-99 are 1969-1999;
    * a text without a day (``2016``, ``May 2016``) is null with ``partial='reject'``; with ``'first'`` what is missing
      is the first (day, month). Nothing is filled in from today's date;
    * no such day, two years, a month in words that is none, anything else around the tokens, more than 60
      characters: null.

    ``cut``: a column that holds ``cut_date`` already, so that the pattern runs once per row.
    """
    if partial not in ("reject", "first"):
        raise ValueError(f"partial is 'reject' or 'first', not {partial!r}")
    t = F.lower(F.trim(c))
    cut = cut_date(c, day_first, partial) if cut is None else cut
    year, month, day = (F.split_part(F.substr(cut, F.lit(2)), F.lit("-"), F.lit(i)) for i in (1, 2, 3))
    numbers = [x for i, name in enumerate(_MONTHS) for k in dict.fromkeys((name, f"{i + 1}", f"{i + 1:02}")) for x in (F.lit(k), F.lit(f"{i + 1:02}"))]
    if partial == "first":
        numbers, day = [*numbers, F.lit(""), F.lit("01")], F.when(day == "", "1").otherwise(day)
    # a constant map, so that the token stands in the expression once
    month = F.element_at(F.create_map(*numbers), F.substr(month, F.lit(1), F.lit(3)))
    century = F.when(F.length(year) == 4, "").when(year <= "68", "20").otherwise("19")
    return F.when(cut != t, F.concat(century, year, F.lit("-"), month, F.lit("-"), day).try_cast("date"))


def nullable_date(c: Column, formats=None, day_first: bool = False, partial: str = "reject", read: Column | None = None) -> tuple[Column, Column]:
    """Null or blank -> null; else a date by ``read_date``, or the row is bad. With
    ``formats`` (patterns) the text must have one of these instead. ``read``: a column that
    holds ``read_date`` already."""
    t = F.trim(c)
    if formats is None:
        parsed = read_date(c, day_first, partial) if read is None else read
    else:
        parsed = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats]).cast("date")
    value = F.when(_blank(c), F.lit(None).cast("date")).otherwise(parsed)
    ok = _blank(c) | parsed.isNotNull()
    return value, ok


def as_string(c: Column) -> tuple[Column, Column]:
    return c, F.lit(True)


@dataclass(frozen=True)
class Rule:
    """One output column: source column, output name, type, required."""

    source: str
    name: str
    kind: str = "string"  # "int" | "date" | "string"
    required: bool = False

    def apply(self, date_formats=None, read: Column | None = None) -> tuple[Column, Column]:
        c = F.col(self.source)
        if self.kind == "int":
            value, ok = nullable_int(c)
        elif self.kind == "date":
            value, ok = nullable_date(c, date_formats, read=read)
        else:
            value, ok = as_string(c)
        if self.required:
            ok = ok & value.isNotNull()
        return value, ok


def rules_lower(columns: dict[str, str], required=()) -> list[Rule]:
    """Rules that rename each source column to lower case."""
    return [Rule(src, src.lower(), kind, src in required) for src, kind in columns.items()]


# Fixed values that must equal the reference's for equal results:
# the item and subject dump columns and their types.
ITEM_COLUMNS = {
    "ItemID": "int",
    "TitleID": "int",
    "ThumbnailPageID": "int",
    "BarCode": "string",
    "MARCItemID": "string",
    "CallNumber": "string",
    "VolumeInfo": "string",
    "ItemURL": "string",
    "LocalID": "string",
    "Year": "string",
    "InstitutionName": "string",
    "ZQuery": "string",
    "CreationDate": "date",
}
SUBJECT_COLUMNS = {"TitleID": "int", "Subject": "string", "CreationDate": "date"}
SUBJECT_REQUIRED = ("TitleID", "CreationDate")

ITEM_RULES = rules_lower(ITEM_COLUMNS)
SUBJECT_RULES = rules_lower(SUBJECT_COLUMNS, SUBJECT_REQUIRED)
