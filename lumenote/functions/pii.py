"""Masking of personal data: e-mail, CNPJ, CPF, card numbers that pass the Luhn check, Brazilian phone numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns in the order in which they are applied; (?U) makes \w and \b know all letters.
EMAIL = r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
CNPJ = r"(?U)\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b"
CPF = r"(?U)\b\d{3}\.\d{3}\.\d{3}-\d{2}\b"
CARD = r"(?U)\b(?:\d[ -]?){13,19}\b"
PHONE = r"(?<!\d)(?:\+55[\s-]?\(?\d{2}\)?|\(\d{2}\))[\s-]?9?\d{4}[\s-]?\d{4}(?!\d)"


def _cards(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(CARD), F.lit(0))
    return F.filter(F.array_distinct(found), lambda c: F.call_function("luhn_check", F.regexp_replace(c, "[ -]", "")))


def masked(text: Column) -> tuple[Column, Column]:
    """The masked text and the sorted kinds found. Cards come before phones, which would else take their digits."""
    one = F.regexp_replace(text, EMAIL, "[email]")
    two = F.regexp_replace(one, CNPJ, "[cnpj]")
    three = F.regexp_replace(two, CPF, "[cpf]")
    # the longest first, so that no card is a part of one still to come
    cards = F.array_sort(_cards(three), lambda a, b: F.length(b) - F.length(a))
    four = F.aggregate(cards, three, lambda t, c: F.replace(t, c, F.lit("[cartao]")))
    five = F.regexp_replace(four, PHONE, "[telefone]")
    kinds = F.array(
        F.when(F.size(cards) > 0, "cartao"), F.when(two.rlike(CPF), "cpf"), F.when(one.rlike(CNPJ), "cnpj"),
        F.when(text.rlike(EMAIL), "email"), F.when(four.rlike(PHONE), "telefone"),
    )
    return five, F.array_sort(F.array_compact(kinds))
