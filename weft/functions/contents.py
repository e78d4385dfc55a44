"""Column functions over file contents (binary)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Magic numbers: offset, bytes in hex, class, name.  Fixed values.
SIGNATURES = (
    (0, "89504E470D0A1A0A", "image", "PNG"),
    (0, "FFD8FF", "image", "JPEG"),
    (0, "47494638", "image", "GIF"),
    (0, "424D", "image", "BMP"),
    (0, "49492A00", "image", "TIFF"),
    (0, "4D4D002A", "image", "TIFF"),
    (0, "00000100", "image", "ICO"),
    (0, "00000200", "image", "CUR"),
    (0, "494433", "audio", "MP3"),
    (0, "FFFB", "audio", "MP3"),
    (0, "FFF3", "audio", "MP3"),
    (0, "FFF2", "audio", "MP3"),
    (0, "664C6143", "audio", "FLAC"),
    (0, "4F676753", "audio", "OGG"),
    (0, "25504446", "document", "PDF"),
    (0, "504B0304", "archive", "ZIP"),
    (0, "1F8B", "archive", "GZIP"),
    (0, "377ABCAF271C", "archive", "7z"),
    (0, "FD377A585A00", "archive", "XZ"),
    (0, "425A68", "archive", "BZ2"),
    (0, "526172211A07", "archive", "RAR"),
    (0, "4F54544F", "font", "OTF"),
    (0, "00010000", "font", "TTF"),
    (0, "774F4646", "font", "WOFF"),
    (0, "774F4632", "font", "WOFF2"),
    (4, "66747970", "video", "MP4"),
)
#: Types inside a RIFF container: bytes 8 to 11, class, name.  Fixed values.
RIFF = (("57454250", "image", "WebP"), ("41564920", "video", "AVI"), ("57415645", "audio", "WAV"))


def content_class(content: Column) -> Column:
    """struct(class, format) by the first magic number that fits; unknown otherwise, null content included."""
    head = F.hex(F.substring(content, 1, 12))
    kind = lambda group, name: F.struct(F.lit(group).alias("class"), F.lit(name).alias("format"))
    inside = F.when(F.startswith(head, F.lit("52494646")), F.substring(head, 17, 8))
    chain = F.when(F.lit(False), kind("", ""))
    for code, group, name in RIFF:
        chain = chain.when(inside == code, kind(group, name))
    for offset, code, group, name in SIGNATURES:
        chain = chain.when(F.substring(head, 2 * offset + 1, len(code)) == code, kind(group, name))
    return chain.otherwise(kind("unknown", "Unknown"))


def looks_binary(content: Column, sniff: int = 4096) -> Column:
    """Whether the first ``sniff`` bytes hold a zero byte (the test itself is defined on them); null for null."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, sniff)) > 0
