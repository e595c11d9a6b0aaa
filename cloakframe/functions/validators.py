"""Checks of identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_luhn(number: Column) -> Column:
    """13 to 19 digits, blanks and hyphens aside, that satisfy the Luhn checksum."""
    digits = F.translate(number, " -", "")
    return F.coalesce(digits.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", digits), F.lit(False))


def _check_digit(digits: Column, n: int) -> Column:
    """The mod-11 digit over the first n digits, weighted n+1 down to 2."""
    total = sum((F.substring(digits, k + 1, 1).try_cast("int") * (n + 1 - k) for k in range(n)), F.lit(0))
    rest = F.pmod(total, F.lit(11))
    return F.when(rest < 2, 0).otherwise(11 - rest)


def is_cpf(number: Column) -> Column:
    """Eleven digits, points and hyphens aside, not all equal, with two right mod-11 digits."""
    digits = F.translate(number, ".-", "")
    right = (F.substring(digits, 10, 1).try_cast("int") == _check_digit(digits, 9)) & (F.substring(digits, 11, 1).try_cast("int") == _check_digit(digits, 10))
    return F.coalesce(digits.rlike("^[0-9]{11}$") & ~digits.rlike(r"^(\d)\1{10}$") & right, F.lit(False))


def is_ip(address: Column) -> Column:
    """Four numbers up to 255, at least one above 9: four single digits look like a version number."""
    parts = F.transform(F.split(address, r"\.", -1), lambda p: F.when(p.rlike("^[0-9]{1,9}$"), p.cast("int")))
    return F.coalesce((F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull() & (p <= 255)) & F.exists(parts, lambda p: p > 9), F.lit(False))


def is_email(address: Column) -> Column:
    """Something on either side of the first @, and a domain with a point and a last label of two or more."""
    local = F.substring_index(address, "@", 1)
    domain = F.regexp_extract(address, r"(?s)^[^@]*@(.*)$", 1)
    return F.coalesce(address.contains("@") & (local != "") & domain.contains(".") & (F.length(F.substring_index(domain, ".", -1)) >= 2), F.lit(False))
