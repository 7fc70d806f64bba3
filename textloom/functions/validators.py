"""Check digits of national and account numbers as JVM expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _signs(value: Column) -> Column:
    """The characters as an array; none for an empty string."""
    return F.when(F.length(value) > 0, F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(value, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _digit(value: Column, k: int) -> Column:
    """The k-th character from the left, counted from 1, as a number."""
    return F.substring(value, k, 1).cast("int")


def _weighted(value: Column, weights: list[int]) -> Column:
    return reduce(lambda a, b: a + b, (_digit(value, k) * w for k, w in enumerate(weights, 1)))


def _and(shape: Column, test: Column) -> Column:
    """The test where the shape holds; else false; null stays null."""
    return F.when(shape, F.coalesce(test, F.lit(False))).otherwise(F.when(shape.isNull(), F.lit(None)).otherwise(False)).cast("boolean")


def luhn(value: Column) -> Column:
    """Digits only, not empty, and every second one from the right doubled sums to a multiple of ten."""
    digits = F.transform(_signs(F.reverse(value)), lambda c: c.try_cast("int"))
    weighed = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2)))
    return _and(value.rlike("^[0-9]+$"), F.aggregate(F.when(value.rlike("^[0-9]+$"), weighed), F.lit(0), lambda a, d: a + d) % 10 == 0)


def let(value: Column, function: Callable[[Column], Column]) -> Column:
    """function of a value that is worked out once, however often the function names it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _modulo_97(digits: Column, most: int) -> Column:
    """The rest of a number of at most `most` digits, sixteen at a time."""
    rest = F.lit("")
    for at in range(1, most + 1, 16):
        rest = (F.concat(rest, F.substring(digits, at, 16)).cast("bigint") % 97).cast("string")
    return rest.cast("int")


def iban(value: Column) -> Column:
    """15 to 34 letters and digits; the first four moved to the end, letters as 10 to 35, leave 1 modulo 97."""

    def check(plain: Column) -> Column:
        digits = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
        for k in range(26):
            digits = F.replace(digits, F.lit(chr(65 + k)), F.lit(str(10 + k)))
        return _and(plain.rlike("^[A-Z0-9]{15,34}$"), F.when(plain.rlike("^[A-Z0-9]{15,34}$"), let(digits, lambda d: _modulo_97(d, 68))) == 1)

    return let(F.upper(F.regexp_replace(value, r"\s", "")), check)


def nir(value: Column) -> Column:
    """French social security number: 13 signs (departments 2A and 2B count as 19 and 18) and the key 97 - n mod 97."""

    def check(plain: Column) -> Column:
        where = F.substring(plain, 6, 2)
        where = F.when(where == "2A", "19").when(where == "2B", "18").otherwise(where)
        body = F.concat(F.substring(plain, 1, 5), where, F.substring(plain, 8, 6)).try_cast("bigint")
        return _and(plain.rlike("^[0-9]{5}([0-9]{2}|2[AB])[0-9]{8}$"), F.substring(plain, 14, 2).try_cast("int") == 97 - body % 97)

    return let(F.upper(F.regexp_replace(value, r"\s", "")), check)


def pesel(value: Column) -> Column:
    """Polish identity number: weights 1 3 7 9, the check digit fills up to ten."""
    return _and(value.rlike("^[0-9]{11}$"), (10 - _weighted(value, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]) % 10) % 10 == _digit(value, 11))


def bsn(value: Column) -> Column:
    """Dutch citizen number: weights 9 to 2 and -1 give a multiple of eleven."""
    return _and(value.rlike("^[0-9]{9}$"), _weighted(value, [9, 8, 7, 6, 5, 4, 3, 2, -1]) % 11 == 0)


def belgian_register(value: Column) -> Column:
    """Belgian national number: 97 less the first nine digits modulo 97, those born since 2000 with 2 before them."""
    n, key = F.substring(value, 1, 9).try_cast("bigint"), F.substring(value, 10, 2).try_cast("int")
    return _and(value.rlike("^[0-9]{11}$"), (97 - n % 97 == key) | (97 - (n + 2_000_000_000) % 97 == key))


#: Street words and state codes of addresses. Fixed values.
STREETS = "St Street Ave Avenue Rd Road Blvd Dr Lane Ln Way Drive Court Ct Place Pl Circle Cir".split()
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()


def looks_like_address(text: Column) -> Column:
    """A digit and a street word, or a five-digit code and a state code; case counts."""
    return (text.rlike("[0-9]") & text.rlike("|".join(STREETS))) | (text.rlike(r"\b[0-9]{5}(?:-[0-9]{4})?\b") & text.rlike("|".join(STATES)))


def looks_like_id(text: Column) -> Column:
    """A social security, card or account shape anywhere, or 6 to 10 letters and digits of which half are digits."""
    short = (F.octet_length(text).between(6, 10)) & text.rlike(r"^[\p{L}\p{N}]+$") & (F.regexp_count(text, F.lit("[0-9]")) * 2 >= F.octet_length(text))
    return text.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}") | text.rlike(r"[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}") | text.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}") | short


def validate(kind: Column, value: Column, confidence: Column) -> Column:
    """Outcome of the check that belongs to a label: accept, or reject with its reason; labels without a check are accepted."""
    checks = {"CARD": luhn, "IBAN": iban, "NIR": nir, "PESEL": pesel, "BSN": bsn, "BE_REGISTER": belgian_register}
    good = F.lit(True)
    for name, check in checks.items():
        good = F.when(kind == name, check(value)).otherwise(good)
    return F.struct(F.when(good, "accept").otherwise("reject").alias("outcome"), F.when(~good, F.concat(F.lower(kind), F.lit("_check"))).alias("reason"), confidence.alias("confidence"))
