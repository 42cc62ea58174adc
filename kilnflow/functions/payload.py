"""Image payloads: text encoding and the PNG header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# The PNG signature and the offsets of width and height in the header.
PNG_SIGNATURE = "89504E470D0A1A0A"
WIDTH_AT, HEIGHT_AT = 17, 21


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bare(payload: Column) -> Column:
    second = F.get(F.split(payload, ","), F.lit(1))
    return F.when(payload.startswith("data:image"), second).otherwise(payload)


def decode_payload(payload: ColumnOrName) -> Column:
    """Bytes of a payload, plain or as a data URL; null when it cannot be decoded."""
    return F.try_to_binary(_bare(_col(payload)), F.lit("base64"))


def encode_payload(content: ColumnOrName) -> Column:
    """Base64 in one line (Spark may break it into lines of 76)."""
    return F.translate(F.base64(_col(content)), "\r\n", "")


def image_size(content: ColumnOrName) -> Column:
    """Width and height from a PNG header; null for anything else."""
    content = _col(content)

    def number(at: int) -> Column:
        return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")

    is_png = (F.hex(F.substring(content, 1, 8)) == PNG_SIGNATURE) & (F.length(content) >= 24)
    return F.struct(
        F.when(is_png, number(WIDTH_AT)).alias("width"),
        F.when(is_png, number(HEIGHT_AT)).alias("height"),
    )
