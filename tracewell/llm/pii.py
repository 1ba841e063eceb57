"""Format-preserving pseudonyms for validated numbers and dates.

A Feistel network with a keyed round function permutes each value within its
own format: payment card numbers (Luhn), telephone numbers, IPv4 addresses and
calendar dates.  The permutation depends on key, kind and length alone, so equal
values get equal pseudonyms in every document, in each of the layouts below, and
whoever has the key can turn them back (``restore``).  Values that fail
validation are left as they are.  A date by slashes is month first where that is
a date, else day first; a day-first one is permuted until it can only be read so,
so it is linked with its like, and with other layouts only where one step did it.  Only built-in functions are used; a
document is rewritten in place, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import plain_text

ROUNDS = 8
#: Dates from 1900-01-01 on, this many days squared: 72900 days, a product of two equal halves.
FIRST_DAY, HALF_DAYS = "1900-01-01", 270
#: How values are written.
DATE_ISO, DATE_DOTS, DATE_SLASHES = r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}", r"[0-9]{2}/[0-9]{2}/[0-9]{4}"
DATE_YEAR_SLASHES = r"[0-9]{4}/[0-9]{2}/[0-9]{2}"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
PHONE = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
#: Other ways of writing ten national digits, with +1, 1 or neither before them, where no digits stand beside them.
NATIONAL = r"(?<![0-9][ .-])(?:\+1[0-9]{10}|(?:\+?1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![ .-]?[0-9])"
_END = r"(?![0-9A-Za-z])"
#: Values that start with a digit and are no card: a group of digits that starts one belongs to it.
_OTHER = rf"(?:{'|'.join((DATE_ISO, DATE_DOTS, DATE_SLASHES, DATE_YEAR_SLASHES, IPV4))}){_END}"
#: Card groups by one kind of separator, besides four groups of four.
_GROUPED = "|".join(
    rf"[0-9]{{4}}{s}[0-9]{{6}}{s}[0-9]{{4,5}}|[0-9]{{4}}{s}[0-9]{{5}}{s}[0-9]{{6}}|[0-9]{{4}}{s}[0-9]{{4}}{s}(?:[0-9]{{5}}|[0-9]{{4}}{s}(?!{_OTHER})[0-9]{{1,3}})|[0-9]{{4}}(?:{s}[0-9]{{3}}){{3}}"
    for s in " -"
)
FOUR = "|".join(rf"[0-9]{{4}}(?:{s}(?!{_OTHER})[0-9]{{4}}){{3}}" for s in " -")
#: As many groups of four as there are, and a shorter last one: one card, several, or cards beside other numbers.
FOURS = "|".join(
    rf"[0-9]{{4}}(?:{s}(?!{_OTHER})[0-9]{{4}}){{3}}{_END}(?:{s}(?!(?:{_OTHER}|(?:{_GROUPED}){_END}))[0-9]{{4}}{_END})*(?:{s}(?!{_OTHER})[0-9]{{1,3}}{_END})?" for s in " -"
)
BARE = "[0-9]{13,19}"
#: Eight to fifteen digits after a plus, of another country than 1; the first two stay.
ABROAD = rf"\+[2-9](?:(?:[ .-](?!{_OTHER}|(?:{FOUR}|{_GROUPED}|{BARE}){_END}))?[0-9]){{7,14}}"
#: Any other grouping, where it stands alone and holds nothing that is a value by itself.
LOOSE = rf"(?<![0-9][ -])(?!(?:[0-9]+[ -])*(?:{_OTHER}|{BARE}))(?!(?:[0-9]+[ -])+(?:{FOUR}|{_GROUPED}){_END})[0-9](?:[ -]?[0-9]){{12,18}}(?![ -]?[0-9])(?![./][0-9])"


def _any(fours: str) -> str:
    """Any value, not inside a longer number or word; the first test spares most characters all others."""
    shapes = (PHONE, NATIONAL, ABROAD, DATE_ISO, DATE_DOTS, DATE_SLASHES, DATE_YEAR_SLASHES, IPV4, fours, _GROUPED, BARE, LOOSE)
    return rf"(?=[0-9+(])(?<![0-9A-Za-z+])(?:{'|'.join(shapes)}){_END}"


#: How one value is written, and what is taken from a text: the same, but groups of four are not cut before their check digits are known.
VALUE, SPAN = _any(FOUR), _any(FOURS)
_MANY = r"^[0-9]{4}(?:[ -][0-9]{4}){3}[ -]"
#: Steps of a walk; each one ends it with a chance of six in ten or more.
WALK = 64
_DATES = ((DATE_ISO, "yyyy-MM-dd"), (DATE_DOTS, "dd.MM.yyyy"), (DATE_SLASHES, "MM/dd/yyyy"), (DATE_YEAR_SLASHES, "yyyy/MM/dd"))


def _round(key: str, kind: Column, i: Column, half: Column) -> Column:
    """Sixty keyed bits of one half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: Column, restore: bool = False) -> Column:
    """Struct (a, b): the pair permuted within ``left_size`` x ``right_size``, or with ``restore`` put back."""
    size = lambda i: F.when(i % 2 == 0, left_size).otherwise(right_size)

    def forward(s: Column, i: Column) -> Column:
        return F.struct(s["b"].alias("a"), ((s["a"] + _round(key, kind, i, s["b"])) % size(i)).alias("b"))

    def backward(s: Column, i: Column) -> Column:
        return F.struct(F.pmod(s["b"] - _round(key, kind, i, s["a"]), size(i)).alias("a"), s["a"].alias("b"))

    order = range(ROUNDS - 1, -1, -1) if restore else range(ROUNDS)
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    return F.aggregate(F.array(*map(F.lit, order)), start, backward if restore else forward)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string; valid numbers give a multiple of ten."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _permuted_digits(digits: Column, key: str, kind: Column, restore: bool) -> Column:
    """Digit string of the same length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    moved = feistel(
        F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, n - u), _power(u), _power(n - u), key, kind, restore
    )
    return F.concat(F.lpad(moved["a"].cast("string"), u, F.lit("0")), F.lpad(moved["b"].cast("string"), n - u, F.lit("0")))


def _laid_out(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(value)),
            lambda i: F.when(
                F.substring(value, i, F.lit(1)).between("0", "9"), F.substring(digits, F.length(_digits(F.substring(value, F.lit(1), i))), F.lit(1))
            ).otherwise(F.substring(value, i, F.lit(1))),
        ),
        "",
    )


def _card_digits(digits: Column, key: str, restore: bool) -> Column:
    """Another valid card number of the same length."""
    body = _permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, F.concat(F.lit("card"), F.length(digits).cast("string")), restore)
    return F.concat(body, F.pmod(F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))


def _is_card(digits: Column) -> Column:
    return luhn_sum(digits) % 10 == 0


def _card(value: Column, key: str, restore: bool) -> Column:
    digits = _digits(value)
    return F.when(_is_card(digits), _laid_out(value, _card_digits(digits, key, restore))).otherwise(value)


def _walked(value: Column, before: Column, tail: Column, key: str, restore: bool) -> Column:
    """``value`` permuted until no card starts earlier in the digits ``before`` it, as none did: the way back finds it at the same place."""
    last = F.floor(F.length(before) / 4).cast("int") - F.when(tail, 0).otherwise(1)

    def clashes(v: Column) -> Column:
        starts = F.when(last < 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), last))
        return F.exists(starts, lambda j: _is_card(F.substring(F.concat(before, v), j * 4 + 1, F.lit(16))))

    def step(s: Column, _: Column) -> Column:
        once = F.transform(F.array(_card_digits(s["v"], key, restore)), lambda v: F.struct(v.alias("v"), clashes(v).alias("on")))
        return F.when(s["on"], once[0]).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(value.alias("v"), F.lit(True).alias("on")), step, lambda s: s["v"])


def _card_run(value: Column, key: str, restore: bool) -> Column:
    """Struct (text, cards): five or more groups as ``FOURS`` finds them, with the cards in it from left to right replaced.

    A card is four groups, or four and a shorter last group where those four are none.
    """

    def step(s: Column, g: Column) -> Column:
        tail = F.length(g) < 4
        need = F.when(tail, 16).otherwise(12)
        held, rest = s["held"], F.length(s["held"]) - need
        number = F.concat(F.substring(held, rest + 1, need), g)
        front = F.substring(held, F.lit(1), rest)
        before = F.substring(front, F.greatest(F.lit(1), rest - 11), F.lit(12))
        both = F.concat(held, g)
        over = F.greatest(F.lit(0), F.length(both) - 28)
        found = F.struct(
            F.concat(s["done"], front, _walked(number, before, tail, key, restore)).alias("done"), F.lit("").alias("held"), (s["cards"] + 1).alias("cards")
        )
        none = F.struct(
            F.concat(s["done"], F.substring(both, F.lit(1), over)).alias("done"), F.substring(both, over + 1, F.length(both)).alias("held"), s["cards"].alias("cards")
        )
        return F.when((rest >= 0) & _is_card(number), found).otherwise(none)

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("held"), F.lit(0).alias("cards"))

    def end(s: Column) -> Column:
        groups = F.regexp_extract_all(F.concat(s["done"], s["held"]), F.lit("[0-9]{1,4}"), F.lit(0))
        return F.struct(F.when(F.substring(value, 5, 1) == " ", F.array_join(groups, " ")).otherwise(F.array_join(groups, "-")).alias("text"), s["cards"].alias("cards"))

    return F.aggregate(F.split(value, "[ -]"), start, step, end)


def _phone(value: Column, key: str, restore: bool) -> Column:
    """The last ten digits; a 1 before them stays."""
    digits = _digits(value)
    code = F.length(digits) - 10
    national = F.substring(digits, code + 1, F.lit(10))
    return _laid_out(value, F.concat(F.substring(digits, F.lit(1), code), _permuted_digits(national, key, F.lit("phone"), restore)))


def _abroad(value: Column, key: str, restore: bool) -> Column:
    digits = _digits(value)
    code, rest = F.substring(digits, 1, 2), F.substring(digits, F.lit(3), F.length(digits) - 2)
    return _laid_out(value, F.concat(code, _permuted_digits(rest, key, F.concat(F.lit("phone"), code), restore)))


def _address(value: Column, key: str, restore: bool) -> Column:
    part = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    p = [F.element_at(part, i) for i in range(1, 5)]
    half = F.lit(65536).cast("long")
    moved = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], half, half, key, F.lit("ipv4"), restore)
    out = F.concat_ws(".", *[x.cast("string") for h in ("a", "b") for x in (F.floor(moved[h] / 256), moved[h] % 256)])
    return F.when((F.array_max(part) <= 255) & ~value.rlike(r"(?:^|\.)0[0-9]"), out).otherwise(value)


def _moved_day(days: Column, key: str, restore: bool) -> Column:
    """Days since the first day, permuted."""
    half = F.lit(HALF_DAYS).cast("long")
    moved = feistel(F.floor(days / HALF_DAYS), days % HALF_DAYS, half, half, key, F.lit("date"), restore)
    return (moved["a"] * HALF_DAYS + moved["b"]).cast("int")


def _date(value: Column, pattern: str, key: str, restore: bool) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    days = F.datediff(F.try_to_date(value, pattern), first)
    day = F.date_add(first, _moved_day(days, key, restore))
    return F.when(days.between(0, HALF_DAYS * HALF_DAYS - 1), F.date_format(day, pattern)).otherwise(value)


def _day_first(value: Column, key: str, restore: bool) -> Column:
    """A date by slashes that can't be read month first, as another such date."""
    first = F.lit(FIRST_DAY).cast("date")
    days = F.datediff(F.try_to_date(value, "dd/MM/yyyy"), first)

    def step(s: Column, _: Column) -> Column:
        once = F.transform(F.array(_moved_day(s["v"], key, restore)), lambda v: F.struct(v.alias("v"), (F.dayofmonth(F.date_add(first, v)) <= 12).alias("on")))
        return F.when(s["on"], once[0]).otherwise(s)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(days.alias("v"), F.lit(True).alias("on")), step, lambda s: s["v"])
    return F.when(days.between(0, HALF_DAYS * HALF_DAYS - 1), F.date_format(F.date_add(first, walked), "dd/MM/yyyy")).otherwise(value)


def pseudonym(value: Column, key: str, restore: bool = False) -> Column:
    """The pseudonym of one value as ``VALUE`` finds it (no row of groups longer than a card), or the value itself where it is not valid."""
    out = F.when(value.rlike(f"^{PHONE}$"), _phone(value, key, restore)).when(value.rlike(f"^{IPV4}$"), _address(value, key, restore))
    out = out.when(value.rlike(f"^(?:{NATIONAL})$"), _phone(value, key, restore)).when(value.startswith("+"), _abroad(value, key, restore))
    out = out.when(value.rlike(f"^{DATE_SLASHES}$") & F.try_to_date(value, "MM/dd/yyyy").isNull(), _day_first(value, key, restore))
    for shape, pattern in _DATES:
        out = out.when(value.rlike(f"^{shape}$"), _date(value, pattern, key, restore))
    return out.otherwise(_card(value, key, restore))


def pseudonymised(docs: DataFrame, key: str, restore: bool = False) -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, n_found, n_changed.

    Needs ``doc_id`` and ``text``.  ``n_found`` counts values written like one
    of the formats, ``n_changed`` those that got another value.  In a row of
    groups of four digits the check digits tell which groups are a card: the
    leftmost valid ones, and numbers beside them stay.  A null text
    stays null with counts of 0; rows that repeat a document are rewritten
    alike.  No row in, no row out.
    """
    source = docs.select("doc_id", "text", F.regexp_extract_all(plain_text(), F.lit(SPAN), F.lit(0)).alias("found"))

    def one(v: Column) -> Column:
        alone = F.transform(F.array(pseudonym(v, key, restore)), lambda p: F.struct(p.alias("text"), F.lit(1).alias("found"), (p != v).cast("int").alias("changed")))
        run = F.transform(
            F.array(_card_run(v, key, restore)),
            lambda r: F.struct(
                r["text"].alias("text"), F.greatest(r["cards"], F.floor(F.size(F.split(v, "[ -]")) / 4).cast("int")).alias("found"),
                r["cards"].alias("changed"),
            ),
        )
        return F.when(v.rlike(_MANY), run[0]).otherwise(alone[0])

    moved = source.withColumn("moved", F.transform("found", one))
    pieces = F.zip_with(
        F.split("text", SPAN, -1), "moved", lambda gap, value: F.concat(gap, F.coalesce(value["text"], F.lit("")))
    )
    total = lambda part: F.aggregate(F.transform("moved", lambda m: m[part].cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return moved.select(
        "doc_id", F.when(F.size("found") == 0, F.col("text")).otherwise(F.array_join(pieces, "")).alias("text"),
        total("found").alias("n_found"), total("changed").alias("n_changed"),
    )
