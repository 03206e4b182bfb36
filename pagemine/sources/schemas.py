"""Schemas of records and rule tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The record fields, in the order in which they are listed.
FIELDS = [
    "title", "channel", "leadtitle", "subtitle", "publish_date", "source",
    "author", "editor", "video_url", "htmlcontent", "content", "origin_image_list",
]


def _field(value: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("xpath", T.StringType()),
            T.StructField("value", value),
            T.StructField("regex", T.StringType()),
        ]
    )


CHANNEL = T.StructType(
    [
        T.StructField("channel_href", T.StringType()),
        T.StructField("channel_name", T.StringType()),
        T.StructField("channel_nav", T.StringType()),
    ]
)
FIELD_TYPES = {name: _field(T.StringType()) for name in FIELDS}
FIELD_TYPES["channel"] = _field(T.ArrayType(CHANNEL))
FIELD_TYPES["origin_image_list"] = _field(T.ArrayType(T.StringType()))

RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("site", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
    + [T.StructField(name, FIELD_TYPES[name]) for name in FIELDS]
)

FIELD_RULES = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("expr", T.StringType()),
    ]
)
