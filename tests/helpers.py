"""Small inputs for tests."""

import datetime as dt
import lzma
import os
import struct

from quotemill.schemas import TICKS

UTC = dt.timezone.utc


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


def ticks(spark, *rows, volume=100.0):
    """Ticks from (time, ask, bid) or (instrument, time, ask, bid), numbered in the order given."""
    full = []
    for i, row in enumerate(rows):
        name, when, ask, bid = row if len(row) == 4 else ("eurusd", *row)
        full.append((name, at(when), i, ask, bid, volume, volume))
    return spark.createDataFrame(full, TICKS)


def record(ms, ask, bid, ask_volume=1.0, bid_volume=2.0) -> bytes:
    return struct.pack(">IIIff", ms, ask, bid, ask_volume, bid_volume)


def write_hour(root, path: str, payload: bytes | None, compress: bool = True) -> None:
    target = os.path.join(root, path)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "wb") as f:
        f.write(lzma.compress(payload, format=lzma.FORMAT_ALONE) if compress else payload)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
