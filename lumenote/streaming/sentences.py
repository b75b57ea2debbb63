"""Sentences of replies that arrive in pieces, handed on as soon as they are complete.

The state is what has come of a reply and isn't handed on yet. What is cut, and where, depends on the text alone and not
on how it was cut into pieces: characters are looked at as if they came one by one. So a sentence ends at its sign only
once white space follows, and is looked for in the first `most` characters: by the time that many are there, the piece is
cut at its last blank anyhow. Pieces are numbered; one that comes before its turn waits in the state.

Replies are dealt to buckets, as keys are in `quiet`: a bucket's state is read and written once a micro-batch, and not
for each reply. Their number should follow that of the replies; it is fixed for the life of a checkpoint.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .quiet import BUCKETS, PACKED, dealt, names_of, pack, unpack

# Abbreviations whose stop ends no sentence.
ABBREVIATIONS = frozenset("sr sra srs dr dra prof profa etc ex p.ex i.e e.g vs núm no nº art fig sec min seg obs ref pg pág cap".split())
END = re.compile(r"[.!?…]+(?=\s)")
PAUSE = re.compile(r"[,;:](?=\s)")
WORD = re.compile(r"\S")
ENDED = 1 << 62


@dataclass(frozen=True)
class Cutting:
    """least: characters of a sentence at least; most: at most; first: at most of a reply's first one, which a comma
    may end too (0: it is cut like the others)."""

    least: int = 20
    most: int = 250
    first: int = 80

    def take(self, text: str, at: int, opening: bool) -> tuple[str, int] | None:
        """The next sentence of the text from `at`, where no white space stands, and where the one behind it begins; None
        if more must come."""
        opening = opening and self.first > 0
        most = min(self.first, self.most) if opening else self.most
        window = text[at : at + most]
        cut = next((m.end() for m in END.finditer(window) if m.end() >= self.least and self._ends(window, m)), 0)
        if opening:
            pause = next((m.end() for m in PAUSE.finditer(window) if m.end() >= self.least), 0)
            cut = min(cut, pause) if cut and pause else cut or pause
        if not cut and len(text) - at >= most:
            cut = max(window.rfind(", "), window.rfind(" "), window.rfind("\n"))
            cut = cut if cut > 0 else most
        return (window[:cut].rstrip(), self._begins(text, at + cut)) if cut else None

    @staticmethod
    def _ends(window: str, sign: re.Match) -> bool:
        if sign.group()[0] != ".":
            return True
        before = window[: sign.start()]
        word = "" if not before or before[-1].isspace() else before.rsplit(None, 1)[-1]
        return word.lower().strip("([{\"'") not in ABBREVIATIONS

    @staticmethod
    def _begins(text: str, at: int) -> int:
        found = WORD.search(text, at)
        return found.start() if found else len(text)

    def go_on(self, rest: str, piece: str, opening: bool, last: bool) -> tuple[list[str], str, bool]:
        """The sentences that a piece completes, what is left, and whether the first one is still to come."""
        out, text = [], rest + piece
        at = self._begins(text, 0)
        while (found := self.take(text, at, opening)) is not None:
            out.append(found[0])
            at, opening = found[1], False
        rest = text[at:]
        if last:
            out += [rest.rstrip()] if rest.strip() else []
            rest = ""
        return out, rest, opening


class Speaking(StatefulProcessor):
    """Goes on with the replies of a bucket. Of each: what is left, whether the first sentence is still to come, the number
    of the next piece, the sentences so far, the pieces before their turn."""

    def __init__(self, key: str, cutting: Cutting):
        self.key, self.cutting = key, cutting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", PACKED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        replies = unpack(self.open.get()) if self.open.exists() else {}
        came: dict[tuple, dict[int, tuple[str, bool]]] = {}
        for frame in rows:
            for name, s, p, e in zip(names_of(frame, [self.key], key[0]), frame["seq"].tolist(), frame["piece"].tolist(), frame["last"].tolist(), strict=True):
                came.setdefault(name, {})[s] = (p or "", bool(e))
        whose, nth, out = [], [], []
        for name, pieces in came.items():
            rest, opening, due, said, early = replies.get(name, ("", True, 0, 0, {}))
            early |= {s: p for s, p in pieces.items() if s >= due}
            turn, ended = [], False
            while not ended and due in early:
                piece, ended = early.pop(due)
                turn.append(piece)
                due += 1
            found, rest, opening = self.cutting.go_on(rest, "".join(turn), opening, ended)
            whose += [name[0]] * len(found)
            nth += range(said, said + len(found))
            out += found
            # nothing may follow an end
            replies[name] = ("", False, ENDED, 0, {}) if ended else (rest, opening, due, said + len(found), early)
        if came:
            self.open.update(pack(replies))
        if out:
            yield pd.DataFrame({"key": whose, "nth": nth, "sentence": out})

    def close(self) -> None:
        pass


def spoken(pieces: DataFrame, key: str, cutting: Cutting | None = None, buckets: int = BUCKETS) -> DataFrame:
    """key, nth, sentence from a stream of pieces (key, seq from 0, piece, last). Null pieces are empty; a piece that
    comes twice counts once. Needs the state store of quiet.state_session."""
    schema = StructType([StructField("key", pieces.schema[key].dataType), StructField("nth", LongType()), StructField("sentence", StringType())])
    rows = pieces.select(*dealt(pieces, [key], buckets), F.col("seq").cast("long").alias("seq"), "piece", "last")
    found = rows.groupBy("bucket").transformWithStateInPandas(Speaking(key, cutting or Cutting()), outputStructType=schema, outputMode="Append", timeMode="None")
    return found.withColumnRenamed("key", key)


def sentences(text: Column, cutting: Cutting | None = None) -> Column:
    """The sentences of whole texts, the same that a stream of their pieces gives. Null: none."""
    rule = cutting or Cutting()

    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: rule.go_on("", t or "", True, True)[0])

    return cut(F.coalesce(text, F.lit("")))


def pieces_of(texts: DataFrame, key: str, text: str, size: Column) -> DataFrame:
    """key, seq, piece, last: each text in pieces of `size` characters; an empty one in one piece."""
    whole = F.coalesce(F.col(text), F.lit(""))
    last = F.greatest(F.ceil(F.length(whole) / size).cast("int") - 1, F.lit(0))
    # a text is cut in one pass and not carried along with its pieces
    cut = F.when(F.length(whole) == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all(whole, F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), F.lit(0)))
    rows = texts.select(key, last.alias("_last"), F.posexplode(cut).alias("seq", "piece"))
    return rows.select(key, "seq", "piece", (F.col("seq") == F.col("_last")).alias("last"))
