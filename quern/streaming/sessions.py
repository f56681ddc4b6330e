"""Sessions as sequences of typed messages: each checked against the types that its state allows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types of messages (fixed values): records, a confirmation, the end, the identities a side holds, one record, a confirmation with counts.
SYNC, ACK, BYE, IDS, RECORDS, ACK_STATS = "SYNC", "ACK", "BYE", "SYNC_IDS", "SYNC_RECORDS", "SYNC_ACK"
TYPES = (SYNC, ACK, BYE, IDS, RECORDS, ACK_STATS)
#: The state after a message that its state doesn't allow; everything later is refused.
BROKEN = "broken"

#: What a client and a server send in turn: identities both ways, then records and a confirmation each way. The end of a batch is
#: a record message marked done.
EXCHANGE = {
    ("start", IDS): "ids", ("ids", IDS): "sending", ("sending", RECORDS): "sending", ("sending", f"{RECORDS} done"): "sent", ("sent", ACK_STATS): "receiving",
    ("receiving", RECORDS): "receiving", ("receiving", f"{RECORDS} done"): "received", ("received", ACK_STATS): "end", ("end", BYE): "end",
}


def message_type(payload):
    """The type of a JSON message (with ' done' for the end of a batch), null if there is none."""
    head = F.from_json(payload, "type string, done boolean")
    return F.when(head["done"], F.concat(head["type"], F.lit(" done"))).otherwise(head["type"])


def session_states(messages: DataFrame, steps: dict[tuple[str, str], str], start: str = "start") -> DataFrame:
    """(conn_id, msg_no, type, before, after, allowed) of messages (conn_id, msg_no, type).

    steps maps (state, type) to the next state. A type that a state doesn't allow, or null, breaks the session: it and all later
    messages are refused. Messages stream through in order, so a session of any length needs the memory of one batch; repeated rows are
    taken as repeated messages.
    """
    names = {f.name: f.dataType.simpleString() for f in messages.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conn, state = None, start
        for frame in frames:
            before, after = [], []
            for name, kind in frame[["conn_id", "type"]].itertuples(index=False, name=None):
                if name != conn:
                    conn, state = name, start
                before.append(state)
                state = steps.get((state, kind), BROKEN)
                after.append(state)
            yield frame.assign(before=before, after=after, allowed=[a != BROKEN for a in after])

    ordered = messages.select("conn_id", "msg_no", "type").repartition("conn_id").sortWithinPartitions("conn_id", "msg_no", "type")
    return ordered.mapInPandas(run, f"conn_id {names['conn_id']}, msg_no {names['msg_no']}, type string, before string, after string, allowed boolean")
