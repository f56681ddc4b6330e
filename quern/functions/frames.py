"""Frames: four bytes of length, most significant first, and that many bytes of UTF-8 JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greatest length of a payload in bytes (fixed value).
MOST = 65_536


def encode(payload: Column) -> Column:
    """A string as a frame; a payload over the limit fails when the plan runs."""
    body = F.encode(payload, "UTF-8")
    size = F.octet_length(body)
    return F.when(size > MOST, F.raise_error(F.lit("payload over 65536 bytes")).cast("binary")).otherwise(F.concat(F.unhex(F.lpad(F.hex(size), 8, "0")), body))


def declared_length(frame: Column) -> Column:
    """The length that a frame's first four bytes give."""
    return F.conv(F.hex(F.substring(frame, 1, 4)), 16, 10).cast("bigint")


class Decoder:
    """Bytes in any portions in, whole payloads out; what is left waits for more."""

    def __init__(self, rest: bytes = b""):
        self.rest = rest

    def feed(self, data: bytes) -> list[str]:
        held, at, out = self.rest + data, 0, []
        while len(held) - at >= 4:
            size = int.from_bytes(held[at : at + 4], "big")
            if size > MOST:
                raise ValueError("a frame declares more than 65536 bytes")
            if len(held) - at - 4 < size:
                break
            out.append(held[at + 4 : at + 4 + size].decode("utf-8"))
            at += 4 + size
        self.rest = held[at:]
        return out
