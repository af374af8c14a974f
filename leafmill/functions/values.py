"""Typed values out of text: e-mail addresses, percentages, dates, amounts, phones, numbers.

Parses need parts of others again and again; `let` gives such a part a name, so that it is
worked out once and the expression's size stays that of its text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency signs, the codes they stand for, and all codes.
CURRENCIES = {"US$": "USD", "C$": "CAD", "A$": "AUD", "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₩": "KRW"}
CODES = ("USD", "EUR", "GBP", "JPY", "INR", "CAD", "AUD", "CHF", "KRW")
# The first letters of the months' names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_ONE_SIGN = "$€£¥₹₩"
_SPACE = "(?U:\\s)"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def is_email(text: Column) -> Column:
    """Something before the first @, behind it a dot that neither opens nor ends the rest; no space."""
    return strip(text).rlike("(?U)^[^@\\s]+@\\S+\\.[^.\\s]+$")


def is_percent(text: Column) -> Column:
    return percent(text).isNotNull()


def phone_digits(text: Column) -> Column:
    """7 to 15 digits, with a leading plus sign; null if there are letters."""
    def parsed(t: Column) -> Column:
        return let(F.regexp_replace(t, "[^0-9]", ""), lambda d: F.when(F.length(d).between(7, 15) & ~t.rlike("[A-Za-z]"), F.concat(F.when(t.startswith("+"), "+").otherwise(""), d)))

    return let(strip(text), parsed)


def is_phone(text: Column) -> Column:
    """A phone number with what only phones have: a leading plus, a bracket, two dashes, or a dash and
    a space."""
    return phone_digits(text).isNotNull() & strip(text).rlike("^\\+|[()]|-.*-|-.* | .*-")


def decimal(text: Column) -> Column:
    """A number with US or European separators: of two kinds the last is the decimal sign, a
    separator that repeats groups digits, a single comma or dot is the decimal sign. Other
    characters are left out, and a minus sign or brackets make it negative."""

    def parsed(t: Column) -> Column:
        def form(core: Column) -> Column:
            dots, commas = F.replace(core, F.lit("."), F.lit("")), F.replace(core, F.lit(","), F.lit(""))
            plain = (
                F.when(core.rlike("\\..*,[^.]*$"), F.translate(dots, ",", ".")).when(core.rlike(",.*\\.[^,]*$"), commas)
                .when(core.rlike("\\..*\\."), dots).when(core.rlike(",.*,"), commas).otherwise(F.translate(core, ",", "."))
            )
            return F.when(core.rlike("[0-9]"), plain.try_cast("double"))

        sign = F.when(t.rlike("^-|^\\(.*\\)$"), -1.0).otherwise(1.0)
        return sign * let(F.regexp_replace(t, "[^0-9.,]", ""), form)

    return let(F.regexp_replace(text, f"{_SPACE}+", ""), parsed)


def percent(text: Column) -> Column:
    return let(strip(text), lambda t: F.when(t.endswith("%"), decimal(F.substring(t, F.lit(1), F.length(t) - 1))))


def number(text: Column) -> Column:
    """A number without any letter around it."""
    return F.when(~text.rlike("[A-Za-z]"), decimal(text))


def money(text: Column) -> Column:
    """(value, currency) of an amount: a sign or code before or behind the number; a minus sign or
    brackets outside make it negative. The value is null if there is none."""
    signs = F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair])
    codes = "|".join(CODES)
    leading = "|".join(x.replace("$", "\\$") for x in CURRENCIES)
    place = lambda c: F.array_position(F.array(*map(F.lit, CODES)), c)

    def parsed(t: Column) -> Column:
        bare = strip(F.regexp_replace(t, "^-*\\(*|\\)+$", ""))

        def told(b: Column) -> Column:
            sign = F.regexp_extract(b, f"^({leading})", 1)
            before, behind = F.upper(F.regexp_extract(b, f"^(?i:({codes}))", 1)), F.upper(F.regexp_extract(b, f"(?i:({codes}))$", 1))
            use_before = (before != "") & ((behind == "") | (place(before) <= place(behind)))
            last = F.regexp_extract(b, f"([{_ONE_SIGN}])$", 1)
            code = F.when(sign != "", signs[sign]).when(use_before, before).when(behind != "", behind).when(last != "", signs[last])
            rest = (
                F.when(sign != "", F.regexp_replace(b, f"^(?:{leading}){_SPACE}*", "")).when(use_before, F.regexp_replace(b, f"^(?i:{codes}){_SPACE}*", ""))
                .when(behind != "", F.regexp_replace(b, f"{_SPACE}*(?i:{codes})$", "")).otherwise(b)
            )
            value = decimal(F.regexp_replace(rest, f"{_SPACE}*[{_ONE_SIGN}]$", ""))
            return let(value, lambda v: F.struct(F.when(t.rlike("^-|^\\(.*\\)$"), -F.abs(v)).otherwise(v).alias("value"), F.when(v.isNotNull(), code).alias("currency")))

        return let(bare, told)

    return let(strip(text), parsed)


def amount(text: Column) -> Column:
    return money(text).getField("value")


def amount_currency(text: Column) -> Column:
    return money(text).getField("currency")


def is_money_shape(text: Column) -> Column:
    """Two digits behind the last separator."""
    tail = F.regexp_extract(text, "[.,]([^.,]*)$", 1)
    return text.rlike("[.,]") & (F.length(F.regexp_replace(tail, "[^0-9]", "")) == 2)


def is_amount(text: Column) -> Column:
    """An amount with a currency, or in the shape of two decimals."""
    return let(money(text), lambda m: m["value"].isNotNull() & (m["currency"].isNotNull() | is_money_shape(text)))


def _valid(y: Column, m: Column, d: Column) -> Column:
    """The ISO form of a day of the calendar; years below 100 are of this century."""

    def of(year: Column) -> Column:
        iso = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
        return F.when(year.between(1, 9999) & m.between(1, 12) & d.between(1, 31) & iso.try_cast("date").isNotNull(), iso)

    return let(F.when(y < 100, y + 2000).otherwise(y), of)


def date_iso(text: Column) -> Column:
    """ISO form of a date. Three numbers: the first is the year if it has four digits or is above 31, else
    the last has to be; day and month go by their sizes, month first if both fit. Words: the last
    month's name, the first number up to 31 and the last one from 1900 to 2200."""
    number = f"{_SPACE}*([+]?[0-9]+){_SPACE}*"
    numeric = f"^{number}[-/.]{number}[-/.]{number}$"

    def by_numbers(t: Column) -> Column:
        def of(p: Column) -> Column:
            def ymd(n: Column) -> Column:
                a, b, c = n[0], n[1], n[2]
                first, last = (F.length(p[0]) == 4) | (a > 31), (F.length(p[2]) == 4) | (c > 31)
                return F.when(first, _valid(a, b, c)).when(last & (a > 12) & (b <= 12), _valid(c, b, a)).when(last, _valid(c, a, b))

            return let(F.transform(p, lambda x: x.try_cast("long")), ymd)

        return let(F.array(*(F.regexp_extract(t, numeric, i) for i in (1, 2, 3))), of)

    def by_words(t: Column) -> Column:
        months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])

        def of(words: Column) -> Column:
            named = F.filter(F.transform(words, lambda w: months[F.lower(F.substring(w, 1, 3))]), lambda m: m.isNotNull())
            numbers = F.filter(F.transform(words, lambda w: F.regexp_extract(w, "^([+]?[0-9]+)[^0-9]*$", 1).try_cast("long")), lambda n: n.isNotNull())
            day, year = F.filter(numbers, lambda n: n.between(1, 31)), F.filter(numbers, lambda n: n.between(1900, 2200))
            return F.when(F.size(words) >= 3, _valid(F.try_element_at(year, F.lit(-1)), F.try_element_at(named, F.lit(-1)), F.try_element_at(day, F.lit(1))))

        return let(F.filter(F.split(t, f"(?:{_SPACE}|,)+"), lambda w: w != ""), of)

    return let(strip(text), lambda t: F.coalesce(F.when(t.rlike(numeric), by_numbers(t)), by_words(t)))


#: Types that may be expected, and the fields of `typed` that tell whether a text is of them.
HINTS = {"date": "iso", "amount": "money.value", "percent": "percent", "number": "number", "email": "email", "phone": "phone"}


def typed(text: Column, hint: str | Column | None = None) -> Column:
    """struct(kind, iso, number, currency, text) of a text: the hinted type if the text can be of it (a column may
    name another one in each row),
    else email > percent > date > amount > phone > number > text. Empty and null are text."""

    def choose(p: Column, s: Column) -> Column:
        strict = p["money"]["value"].isNotNull() & (p["money"]["currency"].isNotNull() | is_money_shape(s))
        kind = (
            F.when(p["email"], "email").when(p["percent"].isNotNull(), "percent").when(p["iso"].isNotNull(), "date").when(strict, "amount")
            .when(p["phone"].isNotNull() & s.rlike("^\\+|[()]|-.*-|-.* | .*-"), "phone").when(p["number"].isNotNull(), "number").otherwise("text")
        )
        if hint is not None:
            wanted = F.lit(hint) if isinstance(hint, str) else hint
            can = {h: p["money"]["value"].isNotNull() if h == "amount" else p["email"] if h == "email" else p[f].isNotNull() for h, f in HINTS.items() if not isinstance(hint, str) or h == hint}
            fits = functools.reduce(lambda a, b: a | b, ((wanted == h) & test for h, test in can.items()))
            kind = F.when(fits, wanted).otherwise(kind)
        value = lambda k: F.struct(
            k.alias("kind"), F.when(k == "date", p["iso"]).alias("iso"), F.when(k == "amount", p["money"]["value"]).when(k == "percent", p["percent"]).when(k == "number", p["number"]).alias("number"),
            F.when(k == "amount", p["money"]["currency"]).alias("currency"), F.when(k == "phone", p["phone"]).when(k.isin("email", "text"), s).alias("text"),
        )
        return let(kind, value)

    def parse(s: Column) -> Column:
        parts = F.struct(is_email(s).alias("email"), percent(s).alias("percent"), date_iso(s).alias("iso"), money(s).alias("money"), phone_digits(s).alias("phone"), number(s).alias("number"))
        return let(parts, lambda p: choose(p, s))

    return let(strip(F.coalesce(text, F.lit(""))), parse)


def value_type(text: Column) -> Column:
    return typed(text).getField("kind")


def rendered(value: Column) -> Column:
    """The text of a typed value."""
    plain = lambda n: F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.try_cast("long").cast("string")).otherwise(n.cast("string"))
    return (
        F.when(value["kind"] == "date", value["iso"]).when(value["kind"] == "amount", F.concat(F.format_string("%.2f", value["number"]), F.coalesce(F.concat(F.lit(" "), value["currency"]), F.lit(""))))
        .when(value["kind"] == "percent", F.concat(plain(value["number"]), F.lit("%"))).when(value["kind"] == "number", plain(value["number"])).otherwise(value["text"])
    )


def pdf_date(text: Column) -> Column:
    """D:YYYYMMDDHHmmSS with offset as text; anything else as it is."""
    p = "^D:([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})"
    g = [F.regexp_extract(text, p, i) for i in range(1, 7)]
    zone = F.regexp_extract(text, p + "([-+][0-9]{2})'([0-9]{2})'?$", 7)
    minutes = F.regexp_extract(text, p + "([-+][0-9]{2})'([0-9]{2})'?$", 8)
    out = F.concat(g[0], F.lit("-"), g[1], F.lit("-"), g[2], F.lit(" "), g[3], F.lit(":"), g[4], F.lit(":"), g[5], F.when(zone != "", F.concat(F.lit(" "), zone, F.lit(":"), minutes)).otherwise(""))
    return F.when(g[0] != "", out).otherwise(text)
