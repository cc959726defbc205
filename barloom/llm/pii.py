r"""Personal data replaced by format-preserving pseudonyms, with Spark expressions only.

Every value is first validated (Luhn for cards, octets for addresses, the calendar for dates, the
reserved areas for social security numbers) and then permuted within its format by a keyed Feistel
network, so a card stays a valid card, a date a date, and equal values stay equal across documents,
however they are punctuated. Numbers with a dense domain are written as a pair of Z_a x Z_b and the
halves are shifted in turn by a keyed digest of the other; strings are split in two halves whose
characters are shifted within their class (digit, small or capital letter, small or capital hexadecimal digit).
Values that fail validation are not personal data of that kind and stay. A card is looked for at each
group of a run of digit groups, so expiry dates, check values and list numbers beside it do not hide it;
no group of a card or phone number begins an address, a date or a social security number. A date with
slashes that fits both readings is day/month; one that fits only month/day is permuted in that format.

The text is split at the matches of one linear pattern; matches start only where a token starts, so
long runs of letters or digits take linear time.

Edge cases: a null text stays null and has no finds; ids are carried along; repeated rows are treated
alike; a table without rows gives none; `without_pii` keeps all other columns, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import column, documents, free_name

KEY = "set a secret key of your own"
ROUNDS = 10
DAYS_A, DAYS_B = 17, 4297  # 17 * 4297 days are 1900-01-01 to 2099-12-31
HEX = "0123456789abcdef"

# Inner forms, without what must stand around them.
# A host name has at most 127 labels; the last may be given back, where a full stop ends a sentence.
EMAIL = r"[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+"
ADDRESS = r"(?:\d{1,3}\.){3}\d{1,3}"
# Digit groups with single blanks or hyphens between them; a card is looked for at each group (`_run`).
RUN = r"\d+(?:[ -]\d+)*"
# Groupings of cards, first the ones to prefer where several pass.
CARDS = [r"\d{13,19}", *("[ -]".join(rf"\d{{{n}}}" for n in sizes) for sizes in (
    (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 3, 3, 3), (6, 10), (6, 13),
))]
SOCIAL = r"\d{3}-\d{2}-\d{4}"
DATE_ISO = r"(?:19|20)\d\d-\d\d-\d\d"
DATE_DAY = r"\d{1,2}([./])\d{1,2}\1(?:19|20)\d\d"
DAY = r"\d{1,2}(?:\.\d{1,2}\.|/\d{1,2}/)(?:19|20)\d\d(?!\d|[./]\d)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d{1,2})"
# What a group of a card or phone number must not begin: a value of another kind.
OTHER = rf"{_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)|{DATE_ISO}(?!\d|-\d)|{DAY}|{SOCIAL}(?!\d|-\d)"
LOCAL = r"\(?[2-9]\d{2}\)?[ .-][2-9]\d{2}[ .-]\d{4}"
_GAP = rf"[ .-](?!{OTHER}|(?:{'|'.join(CARDS[:3])})(?!\d))"
# 8 to 15 digits, written out: Java bounds no repeated group in a look-behind.
_DIGITS = r"[ .()-]{0,2}\d" * 8 + r"(?:[ .()-]{0,2}\d" * 7 + ")?" * 7
# The form of country 1 first; any other ends at the last group with which it has 8 to 15 digits.
PHONE = (
    r"(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    rf"|\+\d{{1,3}}[ .-]?(?:\(\d{{2,4}}\)[ .-]?)?\d{{2,4}}(?:(?:{_GAP})?\d{{2,4}}){{1,3}}(?!\d)(?<=\+{_DIGITS})"
    rf"|{LOCAL}(?!\d))"
)
CLOUD_KEY = r"AKIA[A-Z0-9]{16}"
SECRET = r"(?i:password|passwd|secret|token|api_key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{8,}"
PATTERN = "|".join(
    [
        rf"(?<![A-Za-z0-9._%+-]){EMAIL}",
        rf"(?<![\d.])(?:{ADDRESS})(?!\d|\.\d)",
        rf"(?<![\d.-]){DATE_ISO}(?!\d|-\d)",
        rf"(?<![\d./]){DAY}",
        rf"(?<![\d-]){SOCIAL}(?!\d|-\d)",
        rf"(?<![\d+]){PHONE}",
        rf"(?<![\d+])(?=\d(?:[ -]?\d){{12}})\d++(?:[ -](?!{OTHER}|{LOCAL}(?!\d))\d++)*+",
        rf"(?<![A-Za-z0-9]){CLOUD_KEY}(?![A-Za-z0-9])",
        rf"(?<![A-Za-z0-9_]){SECRET}",
    ]
)
KINDS = ("email", "address", "card", "social", "date", "phone", "secret")


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once: a lambda would compute it anew at each step."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _whole(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def _draw(key: str, kind: str, *parts) -> Column:
    """A number below 2^48 that depends on the key and all parts."""
    told = F.concat_ws("|", F.lit(f"{len(key)}:{key}:{kind}"), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(told, 256), 1, 12), 16, 10).cast("long")


def _pair(a: Column, b: Column, over_a, over_b, key: str, kind: str) -> Column:
    """The permuted pair of Z_over_a x Z_over_b, as a struct of a and b."""
    over_a, over_b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (over_a, over_b))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")),
        lambda acc, i: F.struct(
            F.when(i % 2 == 0, F.pmod(acc["a"] + _draw(key, kind, i, over_a, over_b, acc["b"]), over_a)).otherwise(acc["a"]).alias("a"),
            F.when(i % 2 == 1, F.pmod(acc["b"] + _draw(key, kind, i, over_a, over_b, acc["a"]), over_b)).otherwise(acc["b"]).alias("b"),
        ),
    )


def _shifted(text: Column, alphabet: Column, draw) -> Column:
    """Each character shifted within its class, or in `alphabet` if that is not null, by draw(position)."""

    def one(j):
        c, k = F.substring(text, j, 1), draw(j)
        base = lambda first, n: F.char(F.pmod(F.ascii(c) - first + k, F.lit(n)) + first)
        return (
            F.when(alphabet.isNotNull(), F.substring(alphabet, F.pmod(F.instr(alphabet, c) - 1 + k, F.lit(16)).cast("int") + 1, F.lit(1)))
            .when(c.between("0", "9"), base(48, 10)).when(c.between("a", "z"), base(97, 26))
            .when(c.between("A", "Z"), base(65, 26)).otherwise(c)
        )

    return F.when(F.length(text) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), ""))


def _string(text: Column, key: str, kind: str) -> Column:
    """A permutation of the strings of the same length and classes of characters."""
    half = F.floor(F.length(text) / 2).cast("int")
    hexadecimal = F.when(
        text.rlike("[0-9]"), F.when(text.rlike("^[0-9]*[a-f][0-9a-f]*$"), HEX).when(text.rlike("^[0-9]*[A-F][0-9A-F]*$"), HEX.upper())
    )
    # A hexadecimal string must stay one with a letter and a digit, or it could not be told in the
    # next round; the class is therefore fixed before the first.
    start = F.struct(
        F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"),
        hexadecimal.alias("hex"),
    )
    rounds = F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start,
        lambda acc, i: F.struct(
            F.when(i % 2 == 0, _shifted(acc["l"], acc["hex"], lambda j: _draw(key, kind, i, j, acc["r"]))).otherwise(acc["l"]).alias("l"),
            F.when(i % 2 == 1, _shifted(acc["r"], acc["hex"], lambda j: _draw(key, kind, i, j, acc["l"]))).otherwise(acc["r"]).alias("r"),
            acc["hex"].alias("hex"),
        ),
    )
    return _let(rounds, lambda x: F.concat(x["l"], x["r"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _refilled(form: Column, digits: Column) -> Column:
    """`form` with its digits replaced in order."""
    return _let(
        digits,
        lambda new: F.aggregate(
            F.split(form, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda acc, c: F.when(
                c.between("0", "9"),
                F.struct(F.concat(acc["out"], F.substring(new, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at")),
            ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
            lambda acc: acc["out"],
        ),
    )


def _luhn(digits: Column) -> Column:
    """The weighted sum of the digits; a card's is a multiple of ten."""

    def weighed(acc, i, d):
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return _let(
        digits,
        lambda s: F.aggregate(
            F.sequence(F.lit(1), F.length(s)), F.lit(0),
            lambda acc, i: weighed(acc, i, F.substring(s, F.length(s) - i + 1, F.lit(1)).cast("int")),
        ),
    )


def _padded(value: Column, width: Column) -> Column:
    return F.lpad(value.cast("string"), width, F.lit("0"))


def _card(value: Column, key: str) -> Column:
    power = lambda w: F.pow(F.lit(10.0), w).cast("long")

    def checked(body):
        return F.concat(body, F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))

    def permuted(d):
        # The first digit and the check digit follow rules of their own.
        n = F.length(d) - 2
        left = F.floor(n / 2).cast("int")
        right = (n - left).cast("int")
        new = _pair(F.substring(d, F.lit(2), left), F.substring(d, left + 2, right), power(left), power(right), key, "card")
        body = _let(new, lambda x: F.concat(F.substring(d, 1, 1), _padded(x["a"], left), _padded(x["b"], right)))
        return _let(body, checked)

    return _refilled(value, _let(_digits(value), permuted))


def _address(value: Column, key: str) -> Column:
    def written(new):
        out = []
        for half in ("a", "b"):
            out += [F.shiftright(new[half], 8), new[half].bitwiseAND(F.lit(255).cast("long"))]
        return F.concat_ws(".", *[x.cast("string") for x in out])

    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    return _let(
        octets, lambda o: _let(_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 1 << 16, 1 << 16, key, "address"), written)
    )


def _social(value: Column, key: str) -> Column:
    d = _digits(value)
    area = F.substring(d, 1, 3).cast("long")
    rest = (F.substring(d, 4, 2).cast("long") - 1) * 9999 + F.substring(d, 6, 4).cast("long") - 1
    new = _pair(area - 1 - F.when(area > 666, 1).otherwise(0), rest, 898, 99 * 9999, key, "social")

    def written(x):
        back = x["a"] + 1 + F.when(x["a"] >= 665, 1).otherwise(0)
        parts = [(back, 3), (F.floor(x["b"] / 9999) + 1, 2), (x["b"] % 9999 + 1, 4)]
        return F.concat_ws("-", *[_padded(p.cast("long"), F.lit(w)) for p, w in parts])

    return _let(new, written)


def _days(value: Column) -> Column:
    """The date that a value names and whether the month comes first; no date where the calendar has none."""
    iso = _whole(value, DATE_ISO)
    part = lambda i: F.split(value, "[./-]")[i].cast("int")
    year, month, day = F.when(iso, part(0)).otherwise(part(2)), part(1), F.when(iso, part(2)).otherwise(part(0))

    def named(m, d):
        return F.try_to_date(F.concat_ws("-", _padded(year, F.lit(4)), _padded(m, F.lit(2)), _padded(d, F.lit(2))), "yyyy-MM-dd")

    by_month = F.when(value.contains("/"), named(day, month))
    return _let(
        named(month, day),
        lambda d: F.struct(F.coalesce(d, by_month).alias("day"), (d.isNull() & by_month.isNotNull()).alias("month_first")),
    )


def _date(value: Column, key: str) -> Column:
    read = _days(value)
    at = F.datediff(read["day"], F.lit("1900-01-01").cast("date")).cast("long")
    new = _pair(F.floor(at / DAYS_B), at % DAYS_B, DAYS_A, DAYS_B, key, "date")
    day = _let(new, lambda x: F.date_add(F.lit("1900-01-01").cast("date"), (x["a"] * DAYS_B + x["b"]).cast("int")))
    mark = F.regexp_extract(value, "[./]", 0)

    def written(d):
        by_day = F.concat(F.date_format(d, "dd"), mark, F.date_format(d, "MM"), mark, F.date_format(d, "yyyy"))
        return (
            F.when(_whole(value, DATE_ISO), F.date_format(d, "yyyy-MM-dd"))
            .when(read["month_first"], F.date_format(d, "MM/dd/yyyy")).otherwise(by_day)
        )

    return _let(day, written)


def _phone(value: Column, key: str) -> Column:
    country = F.regexp_extract(value, r"^\+\d{1,3}", 0)
    rest = F.substring(value, F.length(country) + 1, F.length(value))
    return F.concat(country, _refilled(rest, _let(_digits(rest), lambda d: _string(d, key, "phone"))))


def _email(value: Column, key: str) -> Column:
    top = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    name, place = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    place = F.substring(place, F.lit(1), F.length(place) - F.length(top))
    return F.concat(
        _let(name, lambda x: _string(x, key, "name")), F.lit("@"), _let(place, lambda x: _string(x, key, "place")), top
    )


def _secret(value: Column, key: str) -> Column:
    head = F.when(value.startswith("AKIA"), "AKIA").otherwise(F.regexp_extract(value, r"^[A-Za-z_]+\s{0,3}[=:]\s{0,3}[\"']?", 0))
    body = F.substring(value, F.length(head) + 1, F.length(value))
    return F.concat(head, _let(body, lambda x: _string(x, key, "secret")))


def _kind(value: Column) -> Column:
    """The kind of a match that passes validation, else null."""
    octets = F.forall(F.split(value, r"\."), lambda o: o.cast("int") <= 255)
    social = ~value.rlike(r"^(000|666|9)|-00-|-0000$")
    return (
        F.when(_whole(value, EMAIL), "email")
        .when(_whole(value, ADDRESS), F.when(octets, "address"))
        .when(_whole(value, f"{DATE_ISO}|{DATE_DAY}"), F.when(_days(value)["day"].isNotNull(), "date"))
        .when(_whole(value, SOCIAL), F.when(social, "social"))
        .when(_whole(value, PHONE), "phone")
        .when(_whole(value, f"{CLOUD_KEY}|{SECRET}"), "secret")
    )


def _part(value, kind: str | None) -> Column:
    return F.struct(value.alias("value"), F.lit(kind).cast("string").alias("kind"))


def _run(value: Column) -> Column:
    """The parts of a run of digit groups: its cards from left to right, and what is between them.

    At each group the first of CARDS with a right check digit counts. A run in which none has is a
    card as a whole if its digits pass."""
    passes = lambda c: F.when(F.length(c) > 0, _luhn(_digits(c)) % 10 == 0).otherwise(False)
    # For each form an entry for each group, empty where the form does not fit.
    fits = F.arrays_zip(*[
        F.regexp_extract_all(value, F.lit(rf"(?<!\d)(?=\d)(?=({form})(?!\d)|)"), F.lit(1)).alias(f"f{k}") for k, form in enumerate(CARDS)
    ])
    first = F.transform(
        fits, lambda z, i: F.struct(i.alias("at"), F.get(F.filter(F.array(*[z[f"f{k}"] for k in range(len(CARDS))]), passes), F.lit(0)).alias("value"))
    )
    valid = F.transform(
        F.filter(first, lambda c: c["value"].isNotNull()),
        lambda c: F.struct(c["at"].alias("at"), c["value"].alias("value"), (c["at"] + F.size(F.split(c["value"], "[ -]"))).alias("end")),
    )
    apart = F.aggregate(
        valid, F.expr("cast(array() as array<struct<at: int, value: string, end: int>>)"),
        lambda acc, c: F.when(F.coalesce(F.get(acc, F.size(acc) - 1)["end"] <= c["at"], F.lit(True)), F.concat(acc, F.array(c))).otherwise(acc),
    )
    groups = F.regexp_extract_all(value, F.lit(r"[ -]?\d+"), F.lit(0))

    def between(g, start, end):
        return F.array_join(F.slice(g, start + 1, end - start), "")

    def parts(g, cards):
        end = lambda k: F.coalesce(F.get(cards, k - 1)["end"], F.lit(0))
        told = F.transform(
            cards,
            lambda c, k: F.array(
                _part(F.concat(between(g, end(k), c["at"]), F.regexp_extract(F.get(g, c["at"]), "^[ -]?", 0)), None), _part(c["value"], "card")
            ),
        )
        return F.concat(F.flatten(told), F.array(_part(between(g, end(F.size(cards)), F.size(g)), None)))

    digits = _digits(value)
    whole = F.length(digits).between(13, 19) & passes(digits)
    return _let(
        apart,
        lambda cards: F.when(F.size(cards) > 0, _let(groups, lambda g: parts(g, cards)))
        .when(whole, F.array(_part(value, "card"))).otherwise(F.array(_part(value, None))),
    )


def _parts(value: Column) -> Column:
    """A match as an array of parts with their kinds, null for what is no personal data."""
    return _let(
        _kind(value),
        lambda kind: F.when(kind.isNull() & (F.length(value) >= 13) & _whole(value, RUN), _run(value))
        .otherwise(F.array(F.struct(value.alias("value"), kind.alias("kind")))),
    )


def _replaced(found: Column, key: str) -> Column:
    value, kind = found["value"], found["kind"]
    made = {"email": _email, "address": _address, "card": _card, "social": _social, "date": _date, "phone": _phone, "secret": _secret}
    first, *rest = KINDS
    return reduce(lambda c, k: c.when(kind == k, made[k](value, key)), rest, F.when(kind == first, made[first](value, key))).otherwise(value)


def replaced(docs: DataFrame, text_col: str = "text", key: str = KEY) -> tuple[DataFrame, str, str]:
    """`docs` with two more columns, whose names are returned: the new text and the array of kinds found."""
    text = column(docs, text_col)
    finds, new, kinds = (free_name(docs, n) for n in ("pii_finds", "pii_text", "pii_kinds"))
    # The parts of each match, before them the text up to it. Every kind holds a digit, an at sign or
    # a mark of assignment.
    matches = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), _parts)
    parts = F.flatten(F.zip_with(
        F.split(text, PATTERN, -1), matches,
        lambda p, m: F.concat(F.array(_part(p, None)), F.coalesce(m, F.expr("cast(array() as array<struct<value: string, kind: string>>)"))),
    ))
    held = docs.withColumn(finds, F.when(text.rlike("[0-9@=:]"), parts))
    joined = F.array_join(F.transform(column(held, finds), lambda f: _replaced(f, key)), "")
    of = F.filter(F.transform(column(held, finds), lambda f: f["kind"]), lambda k: k.isNotNull())
    held = held.withColumn(kinds, F.coalesce(of, F.expr("cast(array() as array<string>)")))
    some = F.size(column(held, kinds)) > 0
    held = held.withColumn(new, F.when(some, joined).otherwise(column(held, text_col)))
    return held.drop(finds), new, kinds


def without_pii(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """The rows of `docs` with pseudonyms in the text; every other column as it was."""
    held, new, _ = replaced(docs, text_col, key)
    return held.select([column(held, new).alias(c) if c == text_col else column(held, c) for c in docs.columns])


def op7_pii(spark, sf_dir):
    held, new, kinds = replaced(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter(kinds, lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return held.select("doc_id", F.col(new).alias("text"), *[count(k) for k in KINDS])


ORACLE: dict[str, str] = {}
