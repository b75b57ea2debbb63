"""Deliveries that wait for their owner's acknowledgement, as a join of two streams.

A delivery (id, owner, sent) is acknowledged by an ack (id, owner, at) of its own owner within `timeout`. Acks of others
are refused and leave it waiting. One that gets none in time is to be sent again; a resent delivery is a row of the
deliveries like any other, with the later time. Acks that come later, or twice, change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes(deliveries: DataFrame, acks: DataFrame, timeout: str) -> DataFrame:
    """id, owner, sent, outcome (acked, resend, refused), at. Both inputs are streams with watermarks on `sent` and `at`.

    acked and refused are reported as acks come, several for several; resend once the watermark has passed the timeout.
    """
    d = deliveries.select("id", "owner", "sent")
    a = acks.select(F.col("id").alias("ack_id"), F.col("owner").alias("by"), "at")
    in_time = (F.col("id") == F.col("ack_id")) & (F.col("at") >= F.col("sent")) & (F.col("at") <= F.col("sent") + F.expr(f"INTERVAL {timeout}"))
    own = d.join(a, in_time & (F.col("owner") == F.col("by")), "left_outer")
    own = own.select("id", "owner", "sent", F.when(F.col("at").isNull(), "resend").otherwise("acked").alias("outcome"), F.coalesce("at", F.col("sent") + F.expr(f"INTERVAL {timeout}")).alias("at"))
    others = d.join(a, in_time & (F.col("owner") != F.col("by")))
    return own.unionByName(others.select("id", "owner", "sent", F.lit("refused").alias("outcome"), "at"))


def batch_outcomes(deliveries: DataFrame, acks: DataFrame, timeout: str, now) -> DataFrame:
    """The same from tables: all that a stream reports whose watermark has come to `now` (a timestamp column)."""
    every = outcomes(deliveries, acks, timeout)
    return every.filter((F.col("outcome") != "resend") | (F.col("at") < now))


def delivery_states(deliveries: DataFrame, found: DataFrame) -> DataFrame:
    """id, sent, state (acked, resend, pending), acked_at, refusals of each delivery, from the outcomes so far."""
    one = found.groupBy("id", "sent").agg(
        F.min(F.when(F.col("outcome") == "acked", F.col("at"))).alias("acked_at"), F.count_if(F.col("outcome") == "resend").alias("resends"), F.count_if(F.col("outcome") == "refused").alias("refusals")
    )
    state = F.when(F.col("acked_at").isNotNull(), "acked").when(F.col("resends") > 0, "resend").otherwise("pending")
    return deliveries.select("id", "sent").join(one, ["id", "sent"], "left").select("id", "sent", state.alias("state"), "acked_at", F.coalesce("refusals", F.lit(0)).alias("refusals"))

