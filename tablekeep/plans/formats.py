"""File formats and codecs of a dump."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_FORMATS = ("csv", "json", "text")
COLUMNAR_FORMATS = ("parquet", "orc")

# Method names users may give, and the codec each stands for.
TEXT_CODECS = {
    "none": "none",
    "gzip": "gzip",
    "pigz": "gzip",
    "gzip-rsyncable": "gzip",
    "bzip2": "bzip2",
    "pbzip2": "bzip2",
    "deflate": "deflate",
    "lz4": "lz4",
    "snappy": "snappy",
}
PARQUET_CODECS = {
    "none": "none",
    "gzip": "gzip",
    "pigz": "gzip",
    "gzip-rsyncable": "gzip",
    "zstd": "zstd",
    "lz4": "lz4_raw",
    "snappy": "snappy",
}
ORC_CODECS = {
    "none": "none",
    "gzip": "zlib",
    "pigz": "zlib",
    "gzip-rsyncable": "zlib",
    "zstd": "zstd",
    "lz4": "lz4",
    "snappy": "snappy",
}
GZIP_LEVELS = {
    1: "BEST_SPEED",
    2: "TWO",
    3: "THREE",
    4: "FOUR",
    5: "FIVE",
    6: "SIX",
    7: "SEVEN",
    8: "EIGHT",
    9: "BEST_COMPRESSION",
}

# Text formats drop microseconds unless told the pattern.
_TIME_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
# In CSV an absent value is told from an empty text by this mark.
CSV_NULL = "\\N"
FORMAT_OPTIONS = {
    "csv": {
        **_TIME_OPTIONS,
        "header": "true",
        "escape": '"',
        "multiLine": "true",
        "lineSep": "\n",
        "nullValue": CSV_NULL,
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    },
    "json": _TIME_OPTIONS,
}


DEFAULT_CODECS = {"parquet": "zstd", "orc": "zstd"}
DEFAULT_TEXT_CODEC = "gzip"


def codec_for(method: str | None, fmt: str, level: int | None = None) -> str:
    """The codec name Spark takes for ``method`` in this format.

    Without a method it is zstd, or gzip for text formats. Level 0 means no compression.
    """
    if fmt not in TEXT_FORMATS + COLUMNAR_FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    codecs = {"parquet": PARQUET_CODECS, "orc": ORC_CODECS}.get(fmt, TEXT_CODECS)
    if level == 0:
        return codecs["none"]
    if method is None:
        method = DEFAULT_CODECS.get(fmt, DEFAULT_TEXT_CODEC)
    if method not in codecs:
        raise ValueError(f"{fmt} cannot be written with {method!r}; choose from {', '.join(codecs)}")
    return codecs[method]


def _checked_texts(df: DataFrame) -> DataFrame:
    """Refuse a text that would be read back as an absent value."""
    refused = F.raise_error(F.lit(f"CSV cannot hold the text {CSV_NULL}")).cast("string")
    return df.select(
        *(
            F.when(F.col(f"`{f.name}`") == CSV_NULL, refused).otherwise(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        )
    )


def writer_for(df: DataFrame, fmt: str, method: str | None, level: int | None) -> DataFrameWriter:
    codec = codec_for(method, fmt, level)
    if fmt == "csv":
        df = _checked_texts(df)
    writer = df.write.format(fmt).options(**FORMAT_OPTIONS.get(fmt, {})).option("compression", codec)
    if not level:
        return writer
    if codec in ("gzip", "deflate"):
        if level not in GZIP_LEVELS:
            raise ValueError(f"a {codec} level lies between 0 and 9")
        return writer.option("zlib.compress.level", GZIP_LEVELS[level])
    if codec == "zstd" and fmt == "parquet":
        return writer.option("parquet.compression.codec.zstd.level", str(level))
    raise ValueError(f"Spark takes no level for {codec} in {fmt}")


def with_format(reader: DataFrameReader, fmt: str) -> DataFrameReader:
    return reader.format(fmt).options(**FORMAT_OPTIONS.get(fmt, {}))
