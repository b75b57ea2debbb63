"""When a reminder is due, from plain Portuguese and a given now, as column expressions.

What recurs goes before what is relative, and that before a time of day: `a cada 30 minutos` recurs though it looks
relative, `toda segunda às 9h` though it names a time. What none of the rules knows is null, never a guess.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, normalised

# Number words, units in seconds, and days of the week, of text without accents.
TENS = {"vinte": 20, "trinta": 30, "quarenta": 40, "cinquenta": 50}
NUMBERS = {
    "um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10, "onze": 11, "doze": 12, "treze": 13,
    "quatorze": 14, "catorze": 14, "quinze": 15, "dezesseis": 16, "dezessete": 17, "dezoito": 18, "dezenove": 19, **TENS, "sessenta": 60,
}
SECONDS = {
    **dict.fromkeys(("segundo", "segundos", "seg", "segs", "s"), 1), **dict.fromkeys(("minuto", "minutos", "min", "mins", "m"), 60),
    **dict.fromkeys(("hora", "horas", "h", "hr", "hrs"), 3600), **dict.fromkeys(("dia", "dias"), 86400),
}
WEEKDAYS = ("segunda", "terca", "quarta", "quinta", "sexta", "sabado", "domingo")
DEFAULT_HOUR, WEEK = 8, 604_800
MARK = "\u0001"


def _table(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("long")


def with_digits(norm: Column) -> Column:
    """Number words as digits, `vinte e cinco` as 25, `meia hora` as 30 minutos."""
    norm = F.regexp_replace(norm, r"(?U)\bmeia[\s-]+hora\b", "30 minutos")
    words = F.regexp_extract_all(norm, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    known = _table({w: f"{MARK}{n}" for w, n in NUMBERS.items()})
    said = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)), "")
    return F.replace(F.regexp_replace(said, rf"{MARK}([2-5])0\s+e\s+{MARK}([1-9])\b", "$1$2"), F.lit(MARK), F.lit(""))


def time_of_day(norm: Column) -> Column:
    """Minutes after midnight of the time that is named, else null. A bare number is a time after `as` only."""
    named = r"(?U)\b(\d{1,2})\s*(?:h|:)\s*(\d{2})?\b"
    hour, minute = _number(norm, named, 1), F.coalesce(_number(norm, named, 2), F.lit(0))
    bare = _number(norm, r"(?U)\bas?\s+(\d{1,2})\b", 1)
    return (
        F.when(norm.rlike("meio[- ]dia"), F.lit(720))
        .when(norm.rlike("meia[- ]noite"), F.lit(0))
        .when((hour <= 23) & (minute <= 59), hour * 60 + minute)
        .when(bare <= 23, bare * 60)
        .cast("int")
    )


def seconds_from_now(norm: Column) -> Column:
    """All durations of a relative phrase, in seconds; null without one."""
    glued = r"(?U)\b(\d{1,2})h(\d{2})\b"
    rest = F.regexp_replace(norm, r"(?Us)^(.*?)\b\d{1,2}h\d{2}\b", "$1 ")
    first = F.coalesce(_number(norm, glued, 1) * 3600 + _number(norm, glued, 2) * 60, F.lit(0))
    amounts, units = (F.regexp_extract_all(rest, F.lit(r"(\d+)\s*([a-z]+)"), F.lit(g)) for g in (1, 2))
    known = _table(SECONDS)
    each = F.zip_with(amounts, units, lambda n, u: n.try_cast("long") * F.coalesce(F.try_element_at(known, u), F.lit(0)))
    total = F.aggregate(each, first.cast("long"), lambda a, x: a + x)
    return F.when(norm.rlike(r"(?U)\b(daqui|em|apos|depois de|dentro de)\b") & (total > 0), total)


def interval(norm: Column) -> Column:
    """Seconds between the times of `a cada 30 minutos`, `de 2 em 2 horas`, `a cada hora`; null if there are none."""
    known = _table(SECONDS)
    each, by, bare = r"a cada\s+(\d+)\s*([a-z]+)", r"de\s+(\d+)\s+em\s+\d+\s*([a-z]+)", r"a cada\s+([a-z]+)"

    def of(pattern):
        return _number(norm, pattern, 1) * F.try_element_at(known, F.regexp_extract(norm, pattern, 2))

    counted = F.when(norm.rlike(each), of(each)).otherwise(of(by))
    return F.when(counted.isNotNull(), F.when(counted > 0, counted)).otherwise(F.try_element_at(known, F.regexp_extract(norm, bare, 1)))


def due(text: Column, now: Column) -> Column:
    """at (a timestamp without zone, as now is taken) and recurrence of what the text asks for; null if nothing is known.

    recurrence: `diario`, `semanal:` and the day (0 is Monday), `intervalo:` and seconds, or null for once.
    """
    now = now.cast("timestamp_ntz")

    def on(minutes: Column, days: Column) -> Column:
        start = F.make_timestamp_ntz(F.year(now), F.month(now), F.dayofmonth(now), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
        return start + F.make_dt_interval(days.cast("int"), F.lit(0), minutes.cast("int"), F.lit(0).cast("decimal(18,6)"))

    def after(seconds: Column) -> Column:
        return now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))

    def result(at: Column, recurrence: Column) -> Column:
        return F.struct(at.alias("at"), recurrence.cast("string").alias("recurrence"))

    def rules(norm: Column) -> Column:
        every, clock, wait = interval(norm), time_of_day(norm), seconds_from_now(norm)
        at = F.coalesce(clock, F.lit(DEFAULT_HOUR * 60))
        today = F.when(on(at, F.lit(0)) <= now, on(at, F.lit(1))).otherwise(on(at, F.lit(0)))
        weekday = F.coalesce(*(F.when(norm.rlike(rf"(?U)\b{day}s?\b"), F.lit(k)) for k, day in enumerate(WEEKDAYS)))
        ahead = F.pmod(weekday - F.weekday(now), F.lit(7))
        that_day = F.when((ahead == 0) & (on(at, F.lit(0)) <= now), on(at, F.lit(7))).otherwise(on(at, ahead))
        always = norm.rlike(r"(?U)\btod[oa]s?\b")
        daily = F.contains(norm, F.lit("dia")) | F.contains(norm, F.lit("manha")) | (at != DEFAULT_HOUR * 60)
        return (
            F.when(every.isNotNull(), result(after(every), F.concat(F.lit("intervalo:"), every.cast("string"))))
            .when(always & weekday.isNotNull(), result(that_day, F.concat(F.lit("semanal:"), weekday.cast("string"))))
            .when(always & F.contains(norm, F.lit("semana")), result(today, F.lit(f"intervalo:{WEEK}")))
            .when(always & daily, result(today, F.lit("diario")))
            .when(wait.isNotNull(), result(after(wait), F.lit(None)))
            .when(clock.isNotNull() & F.contains(norm, F.lit("amanha")), result(on(clock, F.lit(1)), F.lit(None)))
            .when(clock.isNotNull(), result(today, F.lit(None)))
        )

    return let(with_digits(normalised(text)), rules)
