"""Values that look like personal or business data, as Column expressions over small word lists of our own."""

from __future__ import annotations

import string
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.spec import SpecError

if TYPE_CHECKING:
    from .generators import Context

FIRST = "Ada Ben Cleo Dario Edda Femi Gwen Hugo Iris Jonas Kira Luca Mona Nils Olga Pavel Quinn Rosa Sven Tara Umar Vera Wim Xenia Yara Zeno".split()
LAST = "Alder Birch Cedar Dale Elm Frost Grove Heath Ives Juniper Kestrel Lake Marsh North Oakes Pike Quarry Reed Stone Thorne Underhill Vale West Yarrow".split()
STREET = "Garden Harbor Hill King Lake Maple Market Mill Oak Park River School Spring Station Summer Valley".split()
CITY = "Ashford Brookfield Clearwater Dunmore Eastport Fairview Glenwood Harborview Kingsley Lakeside Milton Northgate Riverton Southam Westbury".split()
COUNTRY = "Argentina Australia Brazil Canada Denmark Egypt France Germany India Italy Japan Kenya Mexico Norway Peru Spain Sweden Turkey".split()
WORD = "amber basin cloud delta ember field grain hollow island jewel kernel lantern meadow needle orbit pebble quiet ridge signal timber".split()
VERB = "align build extend improve measure open plan scale share shape".split()
COMPANY = "Group Holdings Industries Labs Partners Systems Works".split()


def as_text(v: Any) -> str:
    return ("true" if v else "false") if isinstance(v, bool) else str(v)


def one(ctx: Context, words: list[str], draw: str) -> Column:
    return F.get(F.array(*map(F.lit, words)), F.floor(ctx.u(draw) * len(words)).cast("int"))


def number(ctx: Context, lo: int, hi: int, draw: str) -> Column:
    return (F.lit(lo) + F.floor(ctx.u(draw) * (hi - lo + 1))).cast("long")


def digits(ctx: Context, n: int, draw: str) -> Column:
    return F.concat(*[F.floor(ctx.u(f"{draw}{i}") * 10).cast("int").cast("string") for i in range(n)])


def chars(ctx: Context, alphabet: str, n: int, draw: str) -> Column:
    return F.concat(*[F.substring(F.lit(alphabet), (F.floor(ctx.u(f"{draw}{i}") * len(alphabet)) + 1).cast("int"), F.lit(1)) for i in range(n)])


def luhn(ctx: Context) -> Column:
    """Fifteen digits and the check digit that makes their Luhn sum a multiple of 10."""
    ds = [F.lit(4)] + [F.floor(ctx.u(f"c{i}") * 10).cast("int") for i in range(14)]
    total = F.lit(0)
    for i, d in enumerate(ds):
        total = total + (d if i % 2 else d * 2 - F.when(d > 4, 9).otherwise(0))
    return F.concat(*[d.cast("string") for d in ds], ((10 - total % 10) % 10).cast("string"))


def aba(ctx: Context) -> Column:
    ds = [F.floor(ctx.u(f"a{i}") * (2 if i == 0 else 10)).cast("int") for i in range(8)]
    total = F.lit(0)
    for d, w in zip(ds, (3, 7, 1, 3, 7, 1, 3, 7)):
        total = total + d * w
    return F.concat(*[d.cast("string") for d in ds], ((10 - total % 10) % 10).cast("string"))


def iban(ctx: Context) -> Column:
    """GB, two check digits by the rest modulo 97, four letters, fourteen digits."""
    letters = [F.floor(ctx.u(f"l{i}") * 26).cast("int") for i in range(4)]
    account = digits(ctx, 14, "n")
    codes = F.concat(*[(c + 10).cast("string") for c in letters], account, F.lit("161100"))
    check = F.lpad((98 - codes.cast("decimal(28,0)") % 97).cast("int").cast("string"), 2, "0")
    return F.concat(F.lit("GB"), check, *[F.substring(F.lit(string.ascii_uppercase), c + 1, F.lit(1)) for c in letters], account)


def provide(name: str, ctx: Context) -> Column:
    if name not in PROVIDERS:
        raise SpecError(f"unknown provider {name}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](ctx)


def _name(c: Context) -> Column:
    return F.concat_ws(" ", one(c, FIRST, "f"), one(c, LAST, "l"))


def _street(c: Context) -> Column:
    return F.concat_ws(" ", number(c, 1, 999, "h").cast("string"), one(c, STREET, "s"), F.lit("Street"))


PROVIDERS = {
    "name": _name,
    "first_name": lambda c: one(c, FIRST, "f"),
    "last_name": lambda c: one(c, LAST, "l"),
    "user_name": lambda c: F.lower(F.concat(one(c, FIRST, "f"), F.lit("_"), one(c, LAST, "l"), number(c, 1, 9999, "n").cast("string"))),
    "email": lambda c: F.lower(F.concat(one(c, FIRST, "f"), F.lit("."), one(c, LAST, "l"), number(c, 1, 99999999, "n").cast("string"), F.lit("@example.com"))),
    "phone_number": lambda c: F.concat(F.lit("555-"), digits(c, 3, "a"), F.lit("-"), digits(c, 4, "b")),
    "street_address": _street,
    "address": lambda c: F.concat(_street(c), F.lit(", "), one(c, CITY, "c"), F.lit(" "), digits(c, 5, "z")),
    "city": lambda c: one(c, CITY, "c"),
    "country": lambda c: one(c, COUNTRY, "c"),
    "company": lambda c: F.concat_ws(" ", one(c, LAST, "l"), one(c, COMPANY, "k")),
    "ssn": lambda c: F.concat(F.lit("9"), digits(c, 2, "a"), F.lit("-"), digits(c, 2, "b"), F.lit("-"), digits(c, 4, "c")),
    "zipcode": lambda c: digits(c, 5, "z"),
    "postcode": lambda c: digits(c, 5, "z"),
    "date_of_birth": lambda c: F.date_add(F.lit("1940-01-01").cast("date"), F.floor(c.u("d") * 23000).cast("int")).cast("string") if c.dtype == "str" else F.date_add(F.lit("1940-01-01").cast("date"), F.floor(c.u("d") * 23000).cast("int")),
    "ipv4": lambda c: F.concat_ws(".", *[number(c, 1, 254, f"i{i}").cast("string") for i in range(4)]),
    "ipv6": lambda c: F.concat_ws(":", *[chars(c, "0123456789abcdef", 4, f"g{i}") for i in range(8)]),
    "mac_address": lambda c: F.concat_ws(":", *[chars(c, "0123456789abcdef", 2, f"m{i}") for i in range(6)]),
    "bban": lambda c: F.concat(chars(c, string.ascii_uppercase, 4, "l"), digits(c, 14, "n")),
    "iban": iban,
    "aba": aba,
    "credit_card_number": luhn,
    "passport_number": lambda c: digits(c, 9, "p"),
    "license_plate": lambda c: F.concat(chars(c, string.ascii_uppercase, 3, "l"), F.lit("-"), digits(c, 4, "n")),
    "vin": lambda c: chars(c, "ABCDEFGHJKLMNPRSTUVWXYZ0123456789", 17, "v"),
    "latitude": lambda c: F.bround(c.u("y") * 180 - 90, 6),
    "longitude": lambda c: F.bround(c.u("x") * 360 - 180, 6),
    "bothify": lambda c: F.concat(chars(c, string.ascii_letters, 2, "l"), F.lit(" "), digits(c, 2, "n")),
    "word": lambda c: one(c, WORD, "w"),
    "bs": lambda c: F.concat_ws(" ", one(c, VERB, "v"), one(c, WORD, "w"), one(c, WORD, "x")),
    "random_number": lambda c: number(c, 0, 999999999, "n"),
    "random_int": lambda c: number(c, 0, 9999, "n"),
}
#: Provider for a personal column by a part of its name, first match first.
HINTS = [("email", "email"), ("phone", "phone_number"), ("ssn", "ssn"), ("first_name", "first_name"), ("last_name", "last_name"), ("user", "user_name"), ("street", "street_address"), ("address", "address"), ("city", "city"), ("zip", "zipcode"), ("postcode", "postcode"), ("birth", "date_of_birth"), ("dob", "date_of_birth"), ("ip", "ipv4"), ("iban", "iban"), ("card", "credit_card_number"), ("passport", "passport_number"), ("name", "name")]


def hint(name: str) -> str | None:
    return next((p for k, p in HINTS if k in name.lower()), None)
