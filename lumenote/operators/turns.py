"""Windows of a conversation's turns: bounded in characters, and not ending in a question if that can be helped."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import folded


def cut_turn(label: str, text: str, most: int) -> list[str]:
    """A turn as blocks of at most `most` characters, each with its label, cut at the last line end or space."""
    room, blocks = max(most - len(label), 1), []
    while len(text) > room:
        at = max(text.rfind("\n", 0, room), text.rfind(" ", 0, room))
        at = at if at > 0 else room
        blocks.append(label + text[:at].rstrip())
        text = text[at:].lstrip()
    return [*blocks, label + text] if text else blocks


def turn_windows(turns: DataFrame, key: str, order: str, role: str, text: str, asks: str, most: int) -> DataFrame:
    """key, place of the window's last turn, window: the turns in order, joined by blank lines.

    A window is closed before the block that would exceed `most`. Questions (turns of role `asks`) at its end go on to
    the next one, unless it has nothing else or they would not fit there. Turns stream through; only the open window is
    held, which `most` bounds. Every key's last row closes its last window.
    """
    last = turns.groupBy(key).agg(F.max(order).alias("_last")).hint("shuffle_hash")
    rows = turns.join(last, key).select(F.col(key).cast("long"), F.col(order).cast("long"), F.col(role), F.coalesce(text, F.lit("")), F.col("_last").cast("long"))

    def step(state, row):
        who, nth, kind, said, end = row
        held, done = list(state or ()), []
        for block in cut_turn(f"**{kind}:** ", said, most):
            if held and sum(len(b) for _, b in held) + len(block) > most:
                keep = len(held)
                while keep and held[keep - 1][0]:
                    keep -= 1
                closed, held = (held, []) if not keep else (held[:keep], held[keep:])
                done.append(closed)
                if held and sum(len(b) for _, b in held) + len(block) > most:
                    done.append(held)
                    held = []
            held.append((kind == asks, block))
        if nth == end and held:
            done.append(held)
            held = []
        windows = ["\n\n".join(b for _, b in w) for w in done]
        return tuple(held), (who, nth, windows) if windows else None

    schema = pa.schema([(key, pa.int64()), (order, pa.int64()), ("windows", pa.list_(pa.string()))])
    found = folded(rows, key, [order], None, step, f"{key} long, {order} long, windows array<string>", schema)
    return found.select(key, order, F.posexplode("windows").alias("part", "window"))
