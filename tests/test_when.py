"""Times in plain Portuguese: stated cases, and all conversations against a plain version."""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lumenote.functions import when
from lumenote.plans.linking_queries import WAYS
from lumenote.plans.registry import QUERIES

NOW = datetime(2026, 7, 17, 14, 30)  # a Friday
CASES = {
    "me lembra daqui a 10 minutos": ("17 14:40:00", None), "em 1 hora e 30 minutos": ("17 16:00:00", None), "daqui 1h30": ("17 16:00:00", None), "em 30 segundos": ("17 14:30:30", None),
    "daqui a vinte e cinco minutos": ("17 14:55:00", None), "em meia hora": ("17 15:00:00", None), "daqui a 20 e cinco minutos": ("17 14:35:00", None), "dentro de dois dias": ("19 14:30:00", None),
    "amanhã às 8h": ("18 08:00:00", None), "amanhã 18h30": ("18 18:30:00", None), "hoje às 18h": ("17 18:00:00", None), "às 9h": ("18 09:00:00", None), "às 14:30": ("18 14:30:00", None), "às 15": ("17 15:00:00", None),
    "me acorda ao meio-dia": ("18 12:00:00", None), "meia noite": ("18 00:00:00", None),
    "todo dia às 7h": ("18 07:00:00", "diario"), "toda manhã": ("18 08:00:00", "diario"), "toda segunda às 9h": ("20 09:00:00", "semanal:0"), "toda sexta às 14h": ("24 14:00:00", "semanal:4"),
    "toda sexta às 15h": ("17 15:00:00", "semanal:4"), "todos os sábados": ("18 08:00:00", "semanal:5"), "toda terça-feira": ("21 08:00:00", "semanal:1"), "toda semana": ("18 08:00:00", "intervalo:604800"),
    "a cada 30 minutos": ("17 15:00:00", "intervalo:1800"), "de 2 em 2 horas": ("17 16:30:00", "intervalo:7200"), "a cada hora": ("17 15:30:00", "intervalo:3600"), "a cada três dias": ("20 14:30:00", "intervalo:259200"),
    "depois": None, "": None, "   ": None, "25h": None, "em breve": None, "às 99": None, "a cada 0 minutos": None, "compre 3 pães": None, "todo mundo": None,
}


def test_cases(spark):
    rows = spark.createDataFrame([(t,) for t in [*CASES, None]], "t string").select("t", when.due(F.col("t"), F.lit(NOW)).alias("due")).collect()
    got = {r.t: r.due and (r.due.at.strftime("%d %H:%M:%S"), r.due.recurrence) for r in rows}
    assert got.pop(None) is None
    assert got == CASES


def plain(text, now):
    t = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower().strip()
    t = re.sub(r"\bmeia[\s-]+hora\b", "30 minutos", t)
    tens, small = "|".join(when.TENS), "|".join(w for w, n in when.NUMBERS.items() if n < 10)
    t = re.sub(rf"\b({tens})\s+e\s+({small})\b", lambda m: str(when.NUMBERS[m[1]] + when.NUMBERS[m[2]]), t)
    t = re.sub(r"\w+", lambda m: str(when.NUMBERS.get(m[0], m[0])), t)
    midnight = now.replace(hour=0, minute=0, second=0)
    clock = None
    if m := re.search(r"\b(\d{1,2})\s*[h:]\s*(\d{2})?\b", t):
        if int(m[1]) < 24 and int(m[2] or 0) < 60:
            clock = 60 * int(m[1]) + int(m[2] or 0)
    if clock is None and (m := re.search(r"\bas?\s+(\d{1,2})\b", t)) and int(m[1]) < 24:
        clock = 60 * int(m[1])
    clock = 720 if re.search("meio[- ]dia", t) else 0 if re.search("meia[- ]noite", t) else clock

    def day(minutes, ahead):
        return midnight + timedelta(days=ahead, minutes=minutes)

    m = re.search(r"a cada\s+(\d+)\s*([a-z]+)", t) or re.search(r"de\s+(\d+)\s+em\s+\d+\s*([a-z]+)", t)
    if m and m[2] in when.SECONDS:
        s = int(m[1]) * when.SECONDS[m[2]]
    else:
        s = when.SECONDS.get(m[1], 0) if (m := re.search(r"a cada\s+([a-z]+)", t)) else 0
    if s:
        return now + timedelta(seconds=s), f"intervalo:{s}"
    at = 480 if clock is None else clock
    today = day(at, 0) if day(at, 0) > now else day(at, 1)
    if re.search(r"\btod[oa]s?\b", t):
        for k, name in enumerate(when.WEEKDAYS):
            if re.search(rf"\b{name}s?\b", t):
                ahead = (k - now.weekday()) % 7
                return day(at, ahead if ahead or day(at, 0) > now else 7), f"semanal:{k}"
        if "semana" in t:
            return today, "intervalo:604800"
        if "dia" in t or "manha" in t or at != 480:
            return today, "diario"
    if re.search(r"\b(daqui|em|apos|depois de|dentro de)\b", t):
        s, rest = 0, t
        if m := re.search(r"\b(\d{1,2})h(\d{2})\b", t):
            s, rest = int(m[1]) * 3600 + int(m[2]) * 60, t[: m.start()] + " " + t[m.end() :]
        s += sum(int(n) * when.SECONDS.get(u, 0) for n, u in re.findall(r"(\d+)\s*([a-z]+)", rest))
        if s:
            return now + timedelta(seconds=s), None
    if clock is not None:
        return (day(clock, 1) if "amanha" in t else today), None
    return None


@pytest.mark.parametrize("size", ["sf0.001"])
def test_all_conversations(spark, size):
    got = {(r.conv_id, r.turn): (r.at, r.recurrence) for r in QUERIES["g15_due_times"](spark, f"/root/testdata/{size}").collect()}
    rows = spark.read.parquet(f"/root/testdata/{size}/conversations.parquet").collect()
    for r in rows:
        now = datetime.fromtimestamp(1_784_300_000 + r.conv_id * 7919 + r.turn * 601, timezone.utc).replace(tzinfo=None)
        want = plain(f"me lembra {WAYS[(r.conv_id * 7 + r.turn) % len(WAYS)]}: {r.text or ''}", now)
        assert got[r.conv_id, r.turn] == ((want[0].strftime("%Y-%m-%d %H:%M:%S"), want[1]) if want else (None, None)), r
    assert len(got) == len({(r.conv_id, r.turn) for r in rows})
