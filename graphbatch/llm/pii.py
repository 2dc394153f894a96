"""PII: format-preserving Feistel pseudonyms, in Spark SQL expressions only.

One pattern cuts a text into what lies between findings and the findings. Each finding is validated by kind (card numbers by the Luhn
sum, addresses by octet range, dates by the calendar); what fails is left as it was. A valid value is permuted by a keyed Feistel
network over exactly the values of its format, so the pseudonym is valid too, equal values get equal pseudonyms in all documents,
and different values different ones. A network over a x b values keeps x in [0, a) and y in [0, b) and adds a keyed SHA-256 of the
one to the other, round by round, modulo a or b; a and b are chosen with a x b = the number of values.

    card    13-19 digits, single spaces or dashes between them, Luhn valid: first digit stays, the middle is permuted, the last digit is the
            new Luhn digit; of digits that fail, the longest valid 13-18 before a separator, so that an expiry date or code behind a card doesn't hide it
    phone   North American numbers: separators and country code stay, as do the first digits of area code and exchange; 8 digits are permuted
    ssn     ddd-dd-dddd with area not 000, 666 or 9xx, group not 00, serial not 0000: permuted over the valid values of the last six digits; the area stays
    ip      four octets up to 255: permuted over all addresses
    date    yyyy-mm-dd, dd.mm.yyyy or dd/mm/yyyy from 1900 to 2099: permuted over all days of that time
    email   keyed hash of the lower-cased address, in a reserved domain
    secret  hexadecimal strings of 32 digits or more, with a digit and a letter: keyed hash of the same length

Defined results: a null text stays null, with 0 findings; an empty text stays empty; repeated rows get the same pseudonyms. All other columns,
whatever their names, are kept. There is no limit on the length or number of findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# Runs without a bound are possessive and begin at their first character only, so long runs take linear time and no deep stack.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
SECRET = r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,}+(?![A-Za-z0-9])"
CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)"
PHONE = r"(?<![\w.+-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
SSN = r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-])"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w/-]|\.\d)"
#: Order matters where one finding could be read as two kinds.
KINDS = (("email", EMAIL), ("secret", SECRET), ("ip", IP), ("date", DATE), ("ssn", SSN), ("phone", PHONE), ("card", CARD))
ANY = "(?:" + "|".join(p for _, p in KINDS) + ")"

DAYS = 73_049  # from 1900-01-01 to 2099-12-31, = 17 x 4297


def keyed(key: str, kind: str, round_no: Column, value: Column) -> Column:
    """60 bits of a keyed SHA-256, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_no.cast("string"), value.cast("string"), F.lit(key)), 256), 1, 15), 16, 10).cast("long")


def _divided(value: Column, by: int) -> Column:
    """Whole-number division; doubles would round beyond 2^53."""
    return (value.cast("decimal(20,0)") / F.lit(by).cast("decimal(20,0)")).cast("long")


def feistel(key: str, kind: str, value: Column, a: int, b: int) -> Column:
    """Keyed permutation of [0, a b)."""
    low = F.pmod(value, F.lit(b))
    state = F.struct(_divided(value - low, b).alias("x"), low.alias("y"))

    def turn(s: Column, r: Column) -> Column:
        odd = r % 2 == 1
        x = F.when(odd, F.pmod(s["x"] + keyed(key, kind, r, s["y"]), F.lit(a))).otherwise(s["x"])
        y = F.when(odd, s["y"]).otherwise(F.pmod(s["y"] + keyed(key, kind, r, s["x"]), F.lit(b)))
        return F.struct(x.alias("x"), y.alias("y"))

    # The rounds are a fold over their numbers, so the expression stays small.
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, state, turn, lambda s: s["x"] * b + s["y"])


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit counting once."""
    places = F.transform(F.reverse(F.split(digits, "")), lambda d, k: F.when(k % 2 == 1, F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(places, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0)))


def put_digits(value: Column, digits: Column) -> Column:
    """The value with its digits replaced in order; everything else stays."""
    return F.aggregate(
        F.split(value, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], digits.substr(s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))),
        lambda s: s["out"],
    )


def _padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _new_card(key: str, v: Column) -> Column:
    d = only_digits(v)
    out = F.lit(None).cast("string")
    for n in range(13, 20):
        middle = d.substr(2, n - 2)
        half = (n - 2) // 2
        head = F.concat(d.substr(1, 1), _padded(feistel(key, f"card{n}", middle.cast("long"), 10 ** (n - 2 - half), 10**half), n - 2))
        check = F.pmod(10 - luhn_sum(F.concat(head, F.lit("0"))), F.lit(10))
        out = F.when(F.length(d) == n, F.concat(head, check.cast("string"))).otherwise(out)
    return put_digits(v, out)


def _card(key: str, v: Column) -> Column:
    shorter = (F.regexp_extract(v, rf"^\d(?:[ -]?\d){{{n - 1}}}(?=[ -])", 0) for n in range(18, 12, -1))
    valid = F.filter(F.array(v, *shorter), lambda c: (F.length(c) > 0) & (luhn_sum(only_digits(c)) % 10 == 0))
    return F.get(F.transform(F.slice(valid, 1, 1), lambda c: F.concat(_new_card(key, c), v.substr(F.length(c) + 1, F.length(v)))), F.lit(0))


def _phone(key: str, v: Column) -> Column:
    d = only_digits(v)
    lead, ten = d.substr(F.lit(1), F.length(d) - 10), F.right(d, F.lit(10))
    free = F.concat(ten.substr(2, 2), ten.substr(5, 6)).cast("long")
    new = _padded(feistel(key, "phone", free, 10_000, 10_000), 8)
    return put_digits(v, F.concat(lead, ten.substr(1, 1), new.substr(1, 2), ten.substr(4, 1), new.substr(3, 6)))


def _ssn(key: str, v: Column) -> Column:
    area, group, serial = v.substr(1, 3), v.substr(5, 2), v.substr(8, 4)
    valid = ~area.isin("000", "666") & (v.substr(1, 1) != "9") & (group != "00") & (serial != "0000")
    new = feistel(key, "ssn", (group.cast("long") - 1) * 9999 + serial.cast("long") - 1, 99, 9999)
    return F.when(valid, F.concat(area, F.lit("-"), _padded(F.floor(new / 9999) + 1, 2), F.lit("-"), _padded(new % 9999 + 1, 4)))


def _ip(key: str, v: Column) -> Column:
    o = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(o, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    new = feistel(key, "ip", number, 65_536, 65_536)
    parts = [F.shiftright(new, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)]
    return F.when(F.array_max(o) <= 255, F.concat_ws(".", *parts))


def _date(key: str, v: Column) -> Column:
    iso = v.rlike("^[0-9]{4}-")
    p = F.split(v, r"[-./]")
    y, m, d = F.when(iso, p[0]).otherwise(p[2]).cast("int"), p[1].cast("int"), F.when(iso, p[2]).otherwise(p[0]).cast("int")
    month = F.when((y >= 1900) & (y <= 2099) & (m >= 1) & (m <= 12), F.make_date(F.greatest(y, F.lit(1)), F.greatest(F.least(m, F.lit(12)), F.lit(1)), F.lit(1)))
    valid = month.isNotNull() & (d >= 1) & (d <= F.dayofmonth(F.last_day(month)))
    epoch = F.to_date(F.lit("1900-01-01"))
    new = F.date_add(epoch, feistel(key, "date", F.datediff(F.date_add(month, d - 1), epoch).cast("long"), 17, DAYS // 17).cast("int"))
    sep = F.regexp_extract(v, r"[./]", 0)
    return F.when(valid, F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(new, "dd"), sep, F.date_format(new, "MM"), sep, F.date_format(new, "yyyy"))))


def _email(key: str, v: Column) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(v)), 256), 1, 16), F.lit("@example.invalid"))


def _secret(key: str, v: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.lower(v)), 512)
    more = F.transform(F.sequence(F.lit(0), F.floor((F.length(v) - 1) / 128)), lambda k: F.when(k == 0, h).otherwise(F.sha2(F.concat_ws("|", F.lit(key), h, k.cast("string")), 512)))
    return F.when(v.rlike("[0-9]") & v.rlike("[a-fA-F]"), F.array_join(more, "").substr(F.lit(1), F.length(v)))


MAKERS = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(key: str, value: Column) -> Column:
    """The pseudonym of a finding, null where it is of no valid kind."""
    return F.coalesce(*(F.when(value.rlike("^" + p + "$"), MAKERS[kind](key, value)) for kind, p in KINDS))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The input with the texts' private values replaced; ``count_col`` names a new column for the number of replaced values.

    All columns are kept, whatever their names; a ``count_col`` that the input has already is refused. Who holds ``key`` can undo the pseudonyms, so it has no default. Only texts that can hold a finding go through the pattern: two digits with
    at most a separator between, an @ or 32 hexadecimal digits. Findings and the pieces between them are put together in order.
    """
    text = F.col(f"row.{text_col}")
    touched = text.rlike(r"[0-9][ .-]?[0-9]|@|[0-9a-fA-F]{32}")
    if count_col in docs.columns:
        raise ValueError(f"the input has a column named {count_col}")
    step = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # so that no helper column meets one of the input
    step = step.withColumn("found", F.when(touched, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    step = step.withColumn("found", F.when(F.size("found") > 0, F.col("found")))
    step = step.withColumn("new", F.transform("found", lambda v: pseudonym(key, v)))
    step = step.withColumn("between", F.when(F.col("found").isNotNull(), F.split(text, ANY, -1)))
    values = F.zip_with("new", "found", lambda new, old: F.coalesce(new, old))
    filled = F.array_join(F.transform(F.arrays_zip(F.col("between").alias("b"), values.alias("v")), lambda x: F.concat(x["b"], F.coalesce(x["v"], F.lit("")))), "")
    filled = F.when(F.col("found").isNotNull(), filled).otherwise(text)
    counted = F.coalesce(F.size(F.filter("new", lambda x: x.isNotNull())), F.lit(0)).cast("long")
    counted = F.when(F.col("new").isNotNull(), counted).otherwise(F.lit(0).cast("long"))
    return step.select(*((filled if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns), *([counted.alias(count_col)] if count_col else []))
