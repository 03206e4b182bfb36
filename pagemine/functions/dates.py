"""Dates in running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The digits that a day, hour, minute or second may have when no blank separates them.
_DAY = r"(3[01]|[12]\d|0[1-9]|[1-9])"
_CLOCK = r"(2[0-3]|[01]\d|\d):([0-5]\d)"
_DATE = r"(\d{4})-(\d{1,2})-"

# Date forms, tried in this order: the first that occurs decides, also when it names no
# existing day. Each has the groups year, month, day and, if any, hour, minute, second.
DATE_FORMS = [
    (r"\d{4}-\d{1,2}-\d{1,2} \d{2}:\d{2}:\d{2}", _DATE + r"(\d{1,2}) (\d{2}):(\d{2}):(\d{2})", 6),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{2}:\d{2}", _DATE + r"(\d{1,2}) (\d{2}):(\d{2})", 5),
    (r"\d{4}-\d{1,2}-\d{1,2}\d{2}:\d{2}:\d{2}", _DATE + _DAY + _CLOCK + r":([0-5]\d)", 6),
    (r"\d{4}-\d{1,2}-\d{1,2}\d{2}:\d{2}", _DATE + _DAY + _CLOCK, 5),
    (r"\d{4}-\d{1,2}-\d{1,2}", _DATE + r"(\d{1,2})", 3),
    (r"\d{8}", r"(\d{4})(\d{2})(\d{2})", 3),
]


def normalize_date(text: Column) -> Column:
    """Date text → 'yyyy-MM-dd HH:mm:ss', null when no form matches or the date does not exist."""
    plain = F.translate(text, "年月/\\日", "----")

    def parsed(form: str, pattern: str, groups: int) -> Column:
        found = F.regexp_extract(plain, form, 0)
        part = [F.regexp_extract(found, pattern, group) for group in range(1, groups + 1)]
        part += [F.lit("0")] * (6 - groups)
        stamp = F.concat(F.concat_ws("-", *part[:3]), F.lit(" "), F.concat_ws(":", *part[3:]))
        return F.date_format(F.try_to_timestamp(stamp, F.lit("yyyy-M-d H:m:s")), "yyyy-MM-dd HH:mm:ss")

    value = F
    for form, pattern, groups in DATE_FORMS:
        value = value.when(plain.rlike(form), parsed(form, pattern, groups))
    return value
