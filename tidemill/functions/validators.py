"""Checks of identifiers as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Networks by a card's first digits (how many, from, to) and the lengths that their cards have; the first that fits.
NETWORKS = [
    (1, 4, 4, (13, 16, 19)),
    (2, 51, 55, (16,)),
    (4, 2221, 2720, (16,)),
    (2, 34, 34, (15,)),
    (2, 37, 37, (15,)),
    (4, 6011, 6011, (16, 17, 18, 19)),
    (2, 65, 65, (16, 17, 18, 19)),
    (3, 644, 649, (16, 17, 18, 19)),
    (6, 622126, 622925, (16, 17, 18, 19)),
    (4, 3528, 3589, (16, 17, 18, 19)),
    (3, 300, 305, (14, 15, 16, 17, 18, 19)),
    (2, 36, 36, (14, 15, 16, 17, 18, 19)),
    (2, 38, 39, (14, 15, 16, 17, 18, 19)),
    (2, 62, 62, (16, 17, 18, 19)),
    *[(4, p, p, (13, 14, 15, 16, 17, 18, 19)) for p in (5018, 5020, 5038, 5893, 6304, 6759, 6761, 6762, 6763)],
]
#: Digits in fours with a shorter last group, or 4-6-5 and 4-6-4, with one kind of separator.
CARD_GROUPS = r"^(?:\d{4}([ -])(?:\d{4}\1)*\d{1,4}|\d{4}([ -])\d{6}\2\d{4,5})$"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    return F.call_function("luhn_check", digits(c)) & (F.length(digits(c)) > 0)


def card_number(c: Column) -> Column:
    """Length by network, Luhn, not one digit only, grouped as cards are."""
    d = digits(c)
    n, head = F.length(d), lambda k: F.substring(d, 1, k).try_cast("int")
    fits = F.lit(False)
    for width, low, high, lengths in reversed(NETWORKS):
        fits = F.when(head(width).between(low, high), n.isin(*lengths)).otherwise(fits)
    grouped = c.rlike(r"^\d+$") | c.rlike(CARD_GROUPS)
    return F.coalesce(fits & F.call_function("luhn_check", d) & ~d.rlike(r"^(\d)\1*$") & grouped, F.lit(False))


def iban(c: Column) -> Column:
    """Letters are 10 to 35, the first four characters go last; the rest by 97 is 1."""
    s = F.upper(F.regexp_replace(c, "[ -]", ""))
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
    value = lambda ch: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ch) - 1
    rest = F.aggregate(F.split(turned, ""), F.lit(0).cast("long"), lambda a, ch: F.when(value(ch) > 9, (a * 100 + value(ch)) % 97).otherwise((a * 10 + value(ch)) % 97))
    return s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1)


def aba_routing(c: Column) -> Column:
    d = lambda i: F.substring(c, i, 1).try_cast("int")
    total = 3 * (d(1) + d(4) + d(7)) + 7 * (d(2) + d(5) + d(8)) + d(3) + d(6) + d(9)
    return F.coalesce(c.rlike(r"^(0\d|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)\d{7}$") & (total % 10 == 0), F.lit(False))


def ssn(c: Column) -> Column:
    d = digits(c)
    return (F.length(d) == 9) & ~d.rlike("^(000|666|9)") & ~d.rlike("^...00") & ~d.rlike("0000$")


#: What letters count in a vehicle's number; digits count themselves.
VIN_VALUES = {
    "A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7, "H": 8, "J": 1, "K": 2, "L": 3, "M": 4, "N": 5, "P": 7, "R": 9,
    "S": 2, "T": 3, "U": 4, "V": 5, "W": 6, "X": 7, "Y": 8, "Z": 9,
}


def vin(c: Column) -> Column:
    """Weighted sum by 11; X is 10."""
    s = F.upper(c)
    pairs = [F.lit(x) for letter, number in VIN_VALUES.items() for x in (letter, number)]
    weights = F.array(*[F.lit(w) for w in (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)])
    value = lambda ch: F.coalesce(F.element_at(F.create_map(*pairs), ch), ch.try_cast("int"), F.lit(0))
    total = F.aggregate(F.zip_with(F.split(s, ""), weights, lambda ch, w: value(ch) * w), F.lit(0), lambda a, v: a + v)
    check = F.when(total % 11 == 10, "X").otherwise((total % 11).cast("string"))
    return F.coalesce(s.rlike("^[A-HJ-NPR-Z0-9]{17}$") & (F.substring(s, 9, 1) == check), F.lit(False))


def ipv4(c: Column) -> Column:
    return c.rlike(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(?!$)|$)){4}$")


def imei(c: Column) -> Column:
    return (F.length(digits(c)) == 15) & F.call_function("luhn_check", digits(c))


def npi(c: Column) -> Column:
    d = digits(c)
    return d.rlike(r"^[12]\d{9}$") & F.call_function("luhn_check", F.concat(F.lit("80840"), d))


def masked(c: Column) -> Column:
    """The last four letters or digits of eight or more, else nothing."""
    bare = F.regexp_replace(c, "[^\\p{L}\\p{N}]", "")
    return F.when(F.length(bare) >= 8, F.right(bare, F.lit(4))).otherwise("")


def generalised(kind: Column, c: Column) -> Column:
    """Birth dates to years, ages to decades, postal codes to their area."""
    age = F.regexp_extract(c, r"(\d{1,3})", 1).try_cast("int")
    decade = F.when(age >= 90, "90+").otherwise(F.concat((F.floor(age / 10) * 10).cast("string"), F.lit("s")))
    area = F.when(c.rlike(r"^\d{5}(-\d{4})?$"), F.concat(F.substring(c, 1, 3), F.lit("XX"))).otherwise(F.regexp_extract(F.upper(c), r"^([A-Z]{1,2}\d[A-Z\d]?)\s", 1))
    return F.when(kind == "DATE_OF_BIRTH", F.regexp_extract(c, r"((?:19|20)\d\d)", 1)).when(kind == "AGE", decade).when(kind == "POSTAL_CODE", area).otherwise("")


def local_endpoint(url: Column) -> Column:
    """Loopback hosts."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    return host.isin("localhost", "[::1]") | host.rlike(r"^127\.\d+\.\d+\.\d+$") | host.endswith(".localhost")
