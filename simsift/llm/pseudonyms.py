"""Keyed pseudonyms for personal data that keep the value's format.

One pass over each text finds numbers, dates and other personal values; what passes
its check (Luhn, mod 97, calendar, octet range, area rules) is replaced by a keyed
permutation of its own kind. The same value gives the same pseudonym in every
document, two values never share one, and the pseudonym passes the same check:

====== ===================================================================
kind   permuted
====== ===================================================================
card   all digits but the last, which becomes the Luhn digit of the rest
iban   letters and digits after the check digits, which are computed anew
ssn    number of the (area, group, serial) among all valid ones
date   day number within the 400-year cycle 1800-01-01 .. 2199-12-31
ip     the 32-bit number
phone  digits after the country code
email  letters and digits before the at sign
secret letters and digits of a quoted or named key, token or password
====== ===================================================================

Strings go through a Feistel network over their two halves that shifts every
character within its class (digit, lower case, upper case) by a keyed hash of the other
half; separators stay. Numbers go through the network over two exact factors of
their range, so no value has to be walked into the range.

Null texts stay null, texts without such values stay as they are. Equal rows give
equal rows. The key is a secret of the caller; whoever has it can undo the pseudonyms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .feistel import feistel

ROUNDS = 6
#: Day 0 of the cycle and its length 400 * 365.2425 = 189 * 773.
FIRST_DAY, DAY_FACTORS = "1800-01-01", (189, 773)
#: Valid social security numbers: areas 001..899 without 666, groups 01..99, serials 0001..9999.
AREAS, GROUPS, SERIALS = 898, 99, 9999

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?i:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/-]{8,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)",
    "date": r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?!\w|[.-]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)",
    "card": r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(PATTERNS.values())


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _shifted(text: Column, by: Column, sign: int = 1) -> Column:
    """Every letter and digit of text moved within its class by the bytes of a hex string."""

    def moved(c: Column, i: Column) -> Column:
        at = (i % 64) * 2 + 1
        k = F.conv(F.substr(by, at, F.lit(2)), 16, 10).cast("int") * sign
        a = F.ascii(c)

        def turn(first: int, size: int) -> Column:
            return F.char(F.pmod(a - first + k, F.lit(size)) + first)

        return (
            F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26))
            .when(c.between("A", "Z"), turn(65, 26)).otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), moved), "")


def permute_string(text: Column, key: str) -> Column:
    """Permutation of all strings with the same pattern of digits, letters and other characters."""

    def rounds(s: Column) -> Column:
        half = F.floor(F.length(s) / 2).cast("int")
        # the class pattern is the tweak: it names the permutation and is the same for image and preimage
        tweak = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
        start = F.struct(
            F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1).alias("r"),
            F.md5(tweak).alias("t"),
        )

        def stream(i: Column, other: Column, t: Column) -> Column:
            return F.sha2(F.concat_ws(":", F.lit(key), t, i, other), 512)

        def step(h: Column, i: Column) -> Column:
            odd = i % 2 == 1
            return F.struct(
                F.when(odd, _shifted(h["l"], stream(i, h["r"], h["t"]))).otherwise(h["l"]).alias("l"),
                F.when(odd, h["r"]).otherwise(_shifted(h["r"], stream(i, h["l"], h["t"]))).alias("r"),
                h["t"].alias("t"),
            )

        return F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda h: F.concat(h["l"], h["r"])
        )

    return _let(text, rounds)


def _fill(form: Column, digits: Column, what: str = "[0-9]") -> Column:
    """form with its digits (or letters and digits) replaced in order by those of ``digits``."""
    parts = F.filter(F.split(form, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(
        parts, start,
        lambda acc, c: F.when(
            c.rlike(what),
            F.struct(F.concat(acc["out"], F.substr(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at")),
        ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
        lambda acc: acc["out"],
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; digits at odd (1) or even (0) places from the right are doubled, the last place being 0."""
    places = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == doubled, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda acc, v: acc + v)


def is_card(text: Column) -> Column:
    """13 to 19 digits that pass the Luhn check and are not all zeros."""
    return _let(_digits(text), lambda d: (_luhn_sum(d, 1) % 10 == 0) & d.rlike("[1-9]"))


def card(text: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        def checked(payload: Column) -> Column:
            return F.concat(payload, ((F.lit(10) - _luhn_sum(payload, 0) % 10) % 10).cast("string"))

        return _let(permute_string(F.substr(d, F.lit(1), F.length(d) - 1), key + ":card"), checked)

    # the one payload of zeros has no valid card: its image takes the place of its preimage
    def real(d: Column) -> Column:
        return _let(new(d), lambda image: F.when(image.rlike("[1-9]"), image).otherwise(new(image)))

    return _fill(text, _let(_digits(text), real))


def _mod97(text: Column) -> Column:
    """Remainder by 97 of an account number: letters count 10 to 35."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def add(acc: Column, c: Column) -> Column:
        a = F.ascii(c)
        return F.when(a >= 65, (acc * 100 + a - 55) % 97).otherwise((acc * 10 + a - 48) % 97)

    return F.aggregate(chars, F.lit(0), add)


def is_iban(text: Column) -> Column:
    return _let(
        F.replace(text, F.lit(" "), F.lit("")),
        lambda s: F.length(s).between(15, 34)
        & (_mod97(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))) == 1),
    )


def iban(text: Column, key: str) -> Column:
    def new(s: Column) -> Column:
        country = F.substr(s, F.lit(1), F.lit(2))

        def checked(body: Column) -> Column:
            check = F.lit(98) - _mod97(F.concat(body, country, F.lit("00")))
            return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)

        return _let(permute_string(F.substr(s, F.lit(5)), key + ":iban"), checked)

    return _fill(text, _let(F.replace(text, F.lit(" "), F.lit("")), new), "[A-Z0-9]")


def is_ip(text: Column) -> Column:
    """Four octets without leading zeros."""
    return F.forall(F.split(text, r"\."), lambda o: (o.cast("int") <= 255) & ((o == "0") | ~o.startswith("0")))


def ip(text: Column, key: str) -> Column:
    number = F.aggregate(
        F.split(text, r"\."), F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o.cast("bigint")
    )
    return _let(
        feistel(number, 65536, 65536, key + ":ip"),
        lambda v: F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(F.lit(255).cast("bigint")) for s in (24, 16, 8, 0)]),
    )


def _ssn_number(d: Column) -> Column:
    area, group, serial = (F.substr(d, F.lit(a), F.lit(n)).cast("bigint") for a, n in ((1, 3), (4, 2), (6, 4)))
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    return (place * GROUPS + group - 1) * SERIALS + serial - 1


def is_ssn(text: Column) -> Column:
    return ~text.rlike("^(?:000|666|9)|-00-|0000$")


def ssn(text: Column, key: str) -> Column:
    def written(v: Column) -> Column:
        serial = v % SERIALS + 1
        rest = F.floor(v / SERIALS).cast("bigint")
        group = rest % GROUPS + 1
        place = F.floor(rest / GROUPS).cast("bigint") + 1
        area = place + F.when(place >= 666, 1).otherwise(0)
        return F.format_string("%03d-%02d-%04d", area, group, serial)

    return _let(feistel(_ssn_number(_digits(text)), AREAS * GROUPS, SERIALS, key + ":ssn"), written)


def _day(text: Column) -> Column:
    """The date of an ISO or day-month-year text, null if there is no such day."""
    form = F.when(text.rlike("^[0-9]{4}-"), text).otherwise(
        F.regexp_replace(text, r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$", "$3-$2-$1")
    )
    return form.try_cast("date")


def is_date(text: Column) -> Column:
    return F.coalesce(_day(text).between(F.lit(FIRST_DAY).cast("date"), F.lit("2199-12-31").cast("date")), F.lit(False))


def date(text: Column, key: str) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    day = F.date_diff(_day(text), first).cast("bigint")

    def written(v: Column) -> Column:
        new = F.date_add(first, v.cast("int"))
        mark = F.when(text.contains("/"), "/").otherwise(".")
        full = F.concat(F.lpad(F.dayofmonth(new).cast("string"), 2, "0"), mark,
                        F.lpad(F.month(new).cast("string"), 2, "0"), mark, F.year(new).cast("string"))
        return F.when(text.rlike("^[0-9]{4}-"), new.cast("string")).otherwise(full)

    return _let(feistel(day, *DAY_FACTORS, key + ":date"), written)


def phone(text: Column, key: str) -> Column:
    """Digits after the country code, which ends at the first separator or bracket."""
    head = F.regexp_extract(text, r"^\+\d{1,3}(?=\D)|^\+\d", 0)
    tail = F.substr(text, F.length(head) + 1)
    return F.concat(head, permute_string(tail, key + ":phone"))


def email(text: Column, key: str) -> Column:
    return F.concat(
        permute_string(F.substring_index(text, "@", 1), key + ":email"), F.lit("@"), F.substring_index(text, "@", -1)
    )


def secret(text: Column, key: str) -> Column:
    value = F.regexp_extract(text, "[A-Za-z0-9_+/-]{8,}$", 0)
    name = F.substr(text, F.lit(1), F.length(text) - F.length(value))
    return F.concat(name, permute_string(value, key + ":secret"))


def kind_of(match: Column) -> Column:
    """The first kind whose whole pattern and check hold; null if none does."""
    checks = {"iban": is_iban, "ip": is_ip, "date": is_date, "ssn": is_ssn, "card": is_card}
    out = None
    for kind, pattern in PATTERNS.items():
        holds = match.rlike(f"^(?:{pattern})$")
        if kind in checks:
            holds = holds & checks[kind](match)
        out = F.when(holds, F.lit(kind)) if out is None else out.when(holds, F.lit(kind))
    return out


def pseudonym(match: Column, kind: Column, key: str) -> Column:
    makers = {"email": email, "secret": secret, "iban": iban, "ip": ip, "date": date, "ssn": ssn,
              "phone": phone, "card": card}
    out = None
    for name, make in makers.items():
        out = F.when(kind == name, make(match, key)) if out is None else out.when(kind == name, make(match, key))
    return out.otherwise(match)


def _matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({ANY})"), 0)


def _held(match: Column) -> Column:
    """Length of the longest card or account number that a match of no kind begins with and that ends at a
    separator; null if there is none."""

    def valid(part: Column) -> Column:
        return (part.rlike(f"^(?:{PATTERNS['card']})$") & is_card(part)) | (
            part.rlike(f"^(?:{PATTERNS['iban']})$") & is_iban(part)
        )

    ends = F.filter(
        F.reverse(F.sequence(F.lit(1), F.length(match) - 1)),
        lambda i: F.substr(match, i + 1, F.lit(1)).isin(" ", "-") & _let(F.substr(match, F.lit(1), i), valid),
    )
    return F.when(match.rlike("^[A-Z0-9]+[ -][A-Z0-9 -]+$") & kind_of(match).isNull(), F.get(ends, F.lit(0)))


def _parts(text: Column) -> Column:
    """The text cut behind each number that only the beginning of a match holds; what follows is matched anew."""

    def cut(acc: Column) -> Column:
        rest = acc["rest"]

        def at(held: Column) -> Column:
            # place of the first such match: gaps and matches before it
            k = F.array_position(F.transform(held, lambda h: h.isNotNull()), True).cast("int")
            before = F.concat(
                F.transform(F.slice(F.split(rest, ANY, -1), F.lit(1), k), F.length),
                F.transform(F.slice(_matches(rest), F.lit(1), k - 1), F.length),
            )
            return F.when(k > 0, F.aggregate(before, F.get(held, k - 1), lambda n, x: n + x))

        def split(n: Column) -> Column:
            return F.when(
                n.isNull(), F.struct(F.concat(acc["done"], F.array(rest)).alias("done"), F.lit(None).cast("string").alias("rest"))
            ).otherwise(
                F.struct(
                    F.concat(acc["done"], F.array(F.substr(rest, F.lit(1), n))).alias("done"), F.substr(rest, n + 1).alias("rest")
                )
            )

        return F.when(rest.isNull(), acc).otherwise(_let(_let(F.transform(_matches(rest), _held), at), split))

    start = F.struct(F.array().cast("array<string>").alias("done"), text.alias("rest"))
    # a cut is behind 13 characters at least, and the last round ends the text
    rounds = F.sequence(F.lit(1), F.floor(F.length(text) / 13).cast("int") + 1)
    return F.aggregate(rounds, start, lambda acc, _: cut(acc), lambda acc: acc["done"])


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(row, found) per document: its columns with the text replaced, and what was replaced in
    the text's order, an array of (kind, value, pseudonym)."""
    t = F.col("t")

    def scanned(part: Column) -> Column:
        return F.transform(
            _matches(part),
            lambda m: _let(
                kind_of(m),
                lambda k: F.struct(k.alias("kind"), m.alias("value"), pseudonym(m, k, key).alias("pseudonym")),
            ),
        )

    cut = F.exists(_matches(t), lambda m: _held(m).isNotNull())
    some = docs.select(F.struct("*").alias("row"), F.col(text).alias("t")).withColumn(
        "parts", F.when(t.rlike("[0-9@=:]"), F.when(cut, _parts(t)).otherwise(F.array(t)))
    ).withColumn("scans", F.transform("parts", lambda p: F.struct(p.alias("part"), scanned(p).alias("found"))))

    def replaced(scan: Column) -> Column:
        gaps = F.split(scan["part"], ANY, -1)
        return F.concat(
            F.array_join(
                F.zip_with(
                    F.slice(gaps, F.lit(1), F.size(scan["found"])), scan["found"], lambda g, f: F.concat(g, f["pseudonym"])
                ), ""
            ),
            F.element_at(gaps, -1),
        )

    found = some.withColumn("found", F.flatten(F.transform("scans", lambda s: s["found"])))
    return found.select(
        F.col("row").withField(
            f"`{text}`", F.when(F.size("found") > 0, F.array_join(F.transform("scans", replaced), "")).otherwise(t)
        ).alias("row"),
        F.filter(F.coalesce("found", F.array()), lambda f: f["kind"].isNotNull()).alias("found"),
    )


def count_of(kind: str) -> Column:
    """How many values of a kind ``pseudonymise`` has found in a row."""
    return F.size(F.filter("found", lambda f: f["kind"] == kind))
