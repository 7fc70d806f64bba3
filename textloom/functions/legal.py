"""Dates, delays, amounts and references in French legal text as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names. Fixed values.
MONTHS = {"janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12}
#: Patterns that decide what counts as a date, an amount and a delay. Fixed values.
_dated = r"(?i)(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s+(\d{4})"
_numeric = r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})"
_amount = r"(?i)(\d{1,3}(?:[\s.]\d{3})*(?:,\d{1,2})?|\d+(?:,\d{1,2})?)\s*(?:€|EUR|euros?)"
_delay = r"(?i)(?:dans un d[ée]lai de\s+|sous\s+)(\d+)\s+(jours?|mois|ans?)"
#: Limitation periods in years. Fixed values.
PERIODS = {
    "contractuel": 5, "quasi_contrat": 5, "delictuel": 5, "responsabilite_decennale": 10, "biennale_consommation": 2, "garantie_vices": 2, "action_prud_homale": 2, "prescription_penale_crime": 20,
}


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def french_date(text: Column) -> Column:
    """The first `day month-name year`, else the first d/m/y with slashes, dots or dashes; an impossible one is null."""
    months = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    named = F.regexp_extract(text, _dated, 0) != ""
    spoken = _date(F.regexp_extract(text, _dated, 3), months[F.lower(F.regexp_extract(text, _dated, 2))], F.regexp_extract(text, _dated, 1))
    return F.when(named, spoken).when(F.regexp_extract(text, _numeric, 0) != "", _date(F.regexp_extract(text, _numeric, 3), F.regexp_extract(text, _numeric, 2), F.regexp_extract(text, _numeric, 1)))


def delay_deadline(text: Column, anchor: Column) -> Column:
    """anchor and the delay "sous N jours/mois/ans": months count 30 days, years 365."""
    n, unit = F.regexp_extract(text, _delay, 1), F.lower(F.substring(F.regexp_extract(text, _delay, 2), 1, 1))
    days = n.try_cast("int") * F.when(unit == "j", 1).when(unit == "m", 30).when(unit == "a", 365)
    return F.when(n != "", F.date_add(anchor, days))


def amount_cents(text: Column) -> Column:
    """The first amount in euros, in cents: blanks and dots part thousands, a comma the cents."""
    found = F.regexp_extract(text, _amount, 1)
    plain = F.translate(F.regexp_replace(found, r"[\s.]", ""), ",", ".")
    return F.when(found != "", F.round(plain.try_cast("double") * 100).cast("bigint"))


def siren(text: Column) -> Column:
    """The first nine digits, blanks after each three allowed."""
    found = F.regexp_extract(text, r"\b(\d{3})\s?(\d{3})\s?(\d{3})\b", 0)
    return F.when(found != "", F.regexp_replace(found, r"\s", ""))


def article_refs(text: Column, codes: dict[str, str]) -> Column:
    """code:number of every `art. N du CODE` whose code is known; blanks in the number go. codes: name in lower case to id."""
    table = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    pattern = r"(?i)art(?:icle|\.)?s?\s+([LRDA]?\.?\s?\d+(?:[-.]\d+)*)\s+(?:du|de la|de l')\s*(" + "|".join(sorted(codes, key=len, reverse=True)) + ")"
    numbers, names = F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2)
    return F.filter(F.zip_with(numbers, names, lambda n, c: F.concat(table[F.lower(c)], F.lit(":"), F.regexp_replace(n, r"[\s]", ""))), lambda x: x.isNotNull())


def resolve_court(text: Column, courts: list[tuple[str, str]]) -> Column:
    """Id of the first court, in table order, one of whose aliases occurs; courts: (alias in lower case, id)."""
    low = F.lower(text)
    return F.coalesce(*(F.when(low.contains(alias), name) for alias, name in courts))


def limitation(category: Column, event: Column, interruptions: Column, reference: Column, periods: dict[str, int] = PERIODS) -> Column:
    """Deadline, start and whether it is past: years of the category after the latest interruption, or the event; unknown category: null."""
    years = F.create_map(*(F.lit(x) for pair in periods.items() for x in pair))[category]
    start = F.coalesce(F.greatest(event, F.array_max(interruptions)), event)
    due = F.add_months(start, years * 12)
    return F.when(years.isNotNull(), F.struct(start.alias("start"), due.alias("due"), (due <= reference).alias("expired")))


def add_years(day: Column, n: Column | int) -> Column:
    """n years later; the 29th of February becomes the 28th."""
    return F.add_months(day, n * 12)
