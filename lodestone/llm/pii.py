"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

What is found and valid is replaced by a keyed permutation within its own format, so equal values get equal pseudonyms
in every document and different ones stay different:

* digits and ASCII letters go through a Feistel network over their characters: the halves of the string shift each
  other's characters by keyed SHA-256 numbers, each within its own class (digit, small or capital letter);
* mail addresses are permuted without regard to case and keep theirs, so that spellings of one address stay linked;
* social security numbers are permuted until they are valid again, and IBANs get right check digits;
* card numbers keep separators and a right Luhn digit, addresses stay addresses (a Feistel network over two 16-bit
  halves), dates stay dates of the calendar (one over 189 x 773, the 146,097 days of 1700 to 2099). A date with slashes
  is read day first; one that is no date so but is month first stays so, as the permutation is walked on to a day over
  the 12th.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound

ROUNDS = 8
DAYS = (189, 773)
FIRST_DAY = "1700-01-01"
#: Fixed patterns, by kind, in the order in which they are tried at a place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/.-][0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
    "local_phone": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "access_key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?i:(?<![a-z])(?:password|passwd|secret|token|api_key)) ?[=:] ?\"?[A-Za-z0-9_+/-]{8,}+\"?",
}
#: Steps after which a day is sure to have come to the 13th of a month or later, which each does for three in five, and a
#: number to a valid one, which each does for nine in ten.
WALK = 64


def _number(*parts: Column) -> Column:
    """A keyed number of 32 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def _shifted(c: Column, by: Column) -> Column:
    code = F.ascii(c)
    within = lambda first, size: F.char((code - first + by) % size + first)
    return (
        F.when(c.between("0", "9"), within(48, 10))
        .when(c.between("a", "z") & (F.octet_length(c) == 1), within(97, 26))
        .when(c.between("A", "Z") & (F.octet_length(c) == 1), within(65, 26))
        .otherwise(c)
    )


def permuted(value: Column, key: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the strings that have the same characters' classes at the same places."""

    def network(s: Column) -> Column:
        half = F.ceil(F.length(s) / 2).cast("int")
        state = F.struct(F.substr(s, F.lit(1), half).alias("x"), F.substr(s, half + 1, F.length(s)).alias("y"))

        def turn(at: Column, r: Column) -> Column:
            new = F.transform(F.split(at["x"], ""), lambda c, i: _shifted(c, _number(F.lit(key), r.cast("string"), i.cast("string"), at["y"])))
            return F.struct(at["y"].alias("x"), F.array_join(new, "").alias("y"))

        rounds_ = F.array(*[F.lit(r) for r in range(rounds - rounds % 2)])  # an even number puts the halves back in order
        return F.aggregate(rounds_, state, turn, lambda at: F.concat(at["x"], at["y"]))

    return F.when(F.length(value) > 0, bound(value, network)).otherwise(value)


def _two(a: Column, b: Column, sizes: tuple[int, int], key: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of pairs (a, b) with a below sizes[0] and b below sizes[1], as a struct."""
    at = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(at: Column, r: Column) -> Column:
        a = (at["a"] + _number(F.lit(key), r.cast("string"), F.lit("a"), at["b"].cast("string"))) % sizes[0]
        return bound(a, lambda a: F.struct(a.alias("a"), ((at["b"] + _number(F.lit(key), r.cast("string"), F.lit("b"), a.cast("string"))) % sizes[1]).alias("b")))

    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), at, turn)


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """The Luhn sum of a digit string; `double_last` says whether its last digit counts twice."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == (0 if double_last else 1), c.cast("int") * 2).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _filled(form: Column, digits: Column) -> Column:
    """`form` with its digits replaced by `digits`, in order."""
    cells = F.transform(F.split(form, ""), lambda c, i: F.when(c.between("0", "9"), F.substr(digits, F.length(_digits(F.substr(form, F.lit(1), i + 1))), F.lit(1))).otherwise(c))
    return F.array_join(cells, "")


def _email(m: Column, key: str) -> Column:
    body = F.regexp_extract(m, r"^(.*)\.[A-Za-z]+$", 1)

    def cased(body: Column) -> Column:
        cells = lambda new: F.transform(F.split(body, ""), lambda c, i: F.when(c.between("A", "Z"), F.upper(F.substr(new, i + 1, F.lit(1)))).otherwise(F.substr(new, i + 1, F.lit(1))))
        return bound(permuted(F.lower(body), key), lambda new: F.array_join(cells(new), ""))

    return F.concat(bound(body, cased), F.substr(m, F.length(body) + 1, F.length(m)))


def _mod_97(value: Column) -> Column:
    """Of digits and capital letters read as a number, with A as 10 and so on."""
    digit = lambda c: F.when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(value, ""), F.lit(0), lambda n, c: bound(digit(c), lambda d: F.when(d > 9, n * 100 + d).otherwise(n * 10 + d) % 97))


def _iban(m: Column, key: str) -> Column:
    """Country and grouping stay; what follows the check digits is permuted, and these are made right again."""

    def checked(plain: Column) -> Column:
        country, rest = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.length(plain))
        valid = _mod_97(F.concat(rest, F.substr(plain, F.lit(1), F.lit(4)))) == 1
        made = bound(permuted(rest, key), lambda r: F.concat(country, F.lpad((98 - _mod_97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0"), r))
        return F.when(valid, made)

    def spaced(new: Column) -> Column:
        before = lambda i: F.length(F.replace(F.substr(m, F.lit(1), i + 1), F.lit(" "), F.lit("")))
        return F.when(new.isNotNull(), F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(new, before(i), F.lit(1)))), ""))

    return F.coalesce(bound(bound(F.replace(m, F.lit(" "), F.lit("")), checked), spaced), m)


def _card(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        payload = permuted(F.substr(d, F.lit(1), F.length(d) - 1), key)
        return bound(payload, lambda p: F.concat(p, ((10 - luhn_sum(p, True) % 10) % 10).cast("string")))

    return F.when(luhn_sum(_digits(m), False) % 10 == 0, _filled(m, bound(_digits(m), made))).otherwise(m)


def _plain(m: Column, key: str, lead: str) -> Column:
    """Permutes the digits after what `lead` matches."""
    first = F.regexp_extract(m, lead, 0)
    rest = F.substr(m, F.length(first) + 1, F.length(m))
    return F.concat(first, _filled(rest, permuted(_digits(rest), key)))


def _valid_ssn(m: Column) -> Column:
    return ~m.rlike("^(?:000|666|9[0-9]{2})") & ~F.substr(m, F.lit(5), F.lit(2)).eqNullSafe("00") & ~F.substr(m, F.lit(8), F.lit(4)).eqNullSafe("0000")


def _ssn(m: Column, key: str) -> Column:
    """Permuted, and again until the number is a valid one: so valid numbers are permuted among themselves."""
    moved = lambda s: _filled(s, permuted(_digits(s), key))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), moved(m), lambda s, _: F.when(_valid_ssn(s), s).otherwise(moved(s)))
    return F.when(_valid_ssn(m), walked).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    octet = lambda k: F.split_part(m, F.lit("."), F.lit(k)).cast("int")
    valid = (octet(1) < 256) & (octet(2) < 256) & (octet(3) < 256) & (octet(4) < 256)
    two = _two(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), (65536, 65536), key)
    cut = lambda x: [F.floor(x / 256).cast("string"), (x % 256).cast("string")]
    return F.when(valid, bound(two, lambda p: F.concat_ws(".", *cut(p["a"]), *cut(p["b"])))).otherwise(m)


def _date(m: Column, key: str) -> Column:
    iso, slash = m.contains("-"), m.contains("/")
    day_first = F.when(iso, F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))).when(slash, F.try_to_timestamp(m, F.lit("dd/MM/yyyy"))).otherwise(F.try_to_timestamp(m, F.lit("dd.MM.yyyy")))
    day = F.coalesce(day_first, F.when(slash, F.try_to_timestamp(m, F.lit("MM/dd/yyyy")))).cast("date")
    american = slash & day_first.isNull()
    first = F.lit(FIRST_DAY).cast("date")
    at = F.datediff(day, first).cast("long")
    moved = lambda at: bound(_two(F.floor(at / DAYS[1]), at % DAYS[1], DAYS, key), lambda p: p["a"] * DAYS[1] + p["b"])
    late = lambda at: F.dayofmonth(F.date_add(first, at.cast("int"))) > 12
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), moved(at), lambda s, _: F.when(late(s), s).otherwise(moved(s)))
    new = F.date_add(first, F.when(american, walked).otherwise(moved(at)).cast("int"))
    shown = lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(american, F.date_format(d, "MM/dd/yyyy")).when(slash, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy"))
    return F.when(day.isNotNull() & (at >= 0) & (at < DAYS[0] * DAYS[1]), bound(new, shown)).otherwise(m)


def _secret(m: Column, key: str) -> Column:
    lead = F.regexp_extract(m, r'^[A-Za-z_]+ ?[=:] ?"?', 0)
    value = F.regexp_extract(F.substr(m, F.length(lead) + 1, F.length(m)), '^[^"]*', 0)
    return F.concat(lead, permuted(value, key), F.substr(m, F.length(lead) + F.length(value) + 1, F.length(m)))


def kind(m: Column) -> Column:
    """The kind of a found string."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        out = F.when(m.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def pseudonym(m: Column, key: str) -> Column:
    """What stands for a found string; itself if it turns out not to be valid."""
    k = lambda name: f"{key}|{name}"

    def by_kind(named: Column) -> Column:
        return (
            F.when(named == "email", _email(m, k("email")))
            .when(named == "date", _date(m, k("date")))
            .when(named == "ip", _ip(m, k("ip")))
            .when(named == "phone", _plain(m, k("phone"), r"^(?:\+[0-9]{1,3})?"))
            .when(named == "local_phone", _plain(m, k("phone"), "^"))
            .when(named == "iban", _iban(m, k("iban")))
            .when(named == "ssn", _ssn(m, k("ssn")))
            .when(named == "card", _card(m, k("card")))
            .when(named == "access_key", F.concat(F.lit("AKIA"), permuted(F.substr(m, F.lit(5), F.lit(16)), k("access_key"))))
            .when(named == "secret", _secret(m, k("secret")))
            .otherwise(m)
        )

    return bound(kind(m), by_kind)


def pseudonymised(df: DataFrame, key: str) -> DataFrame:
    """Replaces the column text, and adds n_found int (replaced strings) and kinds array<string> (sorted, distinct).

    All other columns stay but those of the added names. A null text stays null and has none. Texts without digits and
    `@` can't hold any of the kinds but passwords of letters only, so only the others are searched closely. Numbers
    that fail their check (Luhn, octets, calendar, blocked areas) stay as they are. Rows are treated one by one; an
    empty frame gives an empty frame.
    """
    df = df.select(*[c for c in df.columns if c not in ("n_found", "kinds")])
    pattern = "|".join(KINDS.values())
    text = F.col("text")
    matches = F.when(text.rlike("[0-9@=:]"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("__found", matches)
    swapped = F.transform("__found", lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))
    df = df.withColumn("__new", F.when(F.size("__found") > 0, swapped))
    pieces = F.split(text, pattern)
    ends = F.concat(F.transform("__new", lambda m: m["new"]), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(pieces, ends, lambda p, e: F.concat(p, e)), "")
    real = F.filter("__new", lambda m: m["old"] != m["new"])
    out = df.withColumns(
        {
            "text": F.when(F.size("__found") > 0, whole).otherwise(text),
            "n_found": F.coalesce(F.when(F.col("__new").isNotNull(), F.size(real)), F.lit(0)),
            "kinds": F.coalesce(F.array_sort(F.array_distinct(F.transform(real, lambda m: kind(m["old"])))), F.array().cast("array<string>")),
        }
    )
    return out.drop("__found", "__new")
