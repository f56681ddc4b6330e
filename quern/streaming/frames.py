"""Decoding frames from captured bytes, as a batch and as a stream with the undecoded rest as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.frames import Decoder

MESSAGES = "conn_id string, msg_no bigint, payload string, buffered int"


def decode_batch(pieces: DataFrame) -> DataFrame:
    """(conn_id, msg_no, payload, buffered) of pieces (conn_id, seq, bytes): messages numbered from 1 in each connection.

    buffered is the number of bytes left after the piece that ended the message. Pieces stream through in order, so a
    connection of any length needs the memory of one batch. Null bytes are skipped.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conn, decoder, number = None, Decoder(), 0
        for frame in frames:
            out = []
            for name, data in frame[["conn_id", "bytes"]].itertuples(index=False, name=None):
                if name != conn:
                    conn, decoder, number = name, Decoder(), 0
                for payload in decoder.feed(bytes(data)):
                    number += 1
                    out.append((name, number, payload, len(decoder.rest)))
            yield pd.DataFrame(out, columns=["conn_id", "msg_no", "payload", "buffered"])

    ordered = pieces.filter(F.col("bytes").isNotNull()).repartition("conn_id").sortWithinPartitions("conn_id", "seq")
    return ordered.select("conn_id", "bytes").mapInPandas(run, MESSAGES)


def decode_stream(pieces: DataFrame) -> DataFrame:
    """The same for a stream; within a micro-batch pieces are taken in the order of seq."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rest, number = state.get if state.exists else (b"", 0)
        decoder = Decoder(bytes(rest))
        held = pd.concat(list(frames)).sort_values("seq")
        out = []
        for data in held["bytes"]:
            for payload in decoder.feed(bytes(data)) if data is not None else []:
                number += 1
                out.append((key[0], number, payload, len(decoder.rest)))
        state.update((decoder.rest, number))
        yield pd.DataFrame(out, columns=["conn_id", "msg_no", "payload", "buffered"])

    return pieces.groupBy("conn_id").applyInPandasWithState(step, MESSAGES, "rest binary, number bigint", "append", "NoTimeout")
