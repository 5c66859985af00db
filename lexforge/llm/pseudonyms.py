"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Found values are checked (card numbers by their check digit, bank accounts by their remainder of 97, addresses by their octets,
dates by the calendar, telephone and social security numbers by their digits, access keys by their prefix and length) and then
permuted by a keyed Feistel network within their format: a
card number stays a card number with a right check digit, a date a date in the same notation. The permutation depends on
the key and the kind alone, so equal values get equal pseudonyms in all documents, different values different ones, and
restore() with the key inverts it. Values that fail the check are left as they are.

Numbers beside a card, after a space, are told from it by check digits: one group of 13 to 19 digits comes first, then
groups that have 16 together, 15, and other lengths. Where a card of several groups that hasn't 16 digits stands beside a
number, a pseudonym may make a better place valid by chance, and restore() then takes that one.

Of a mail address the name and the domain's labels but the last are permuted; domains of public providers and of examples stay,
as they tell of nobody. Country codes and the prefixes of access keys stay. A telephone number without separators counts after
a plus sign or a word like tel.

Halves of a string are lists of characters. A round shifts each character of one half within its class (digit, lower case,
upper case, or the hexadecimal digits; in secrets with capitals, digits and letters A-F of each case) by SHA-256 over key, round, kind and the other half. Dates are numbers in
319 * 229 days from 1900-01-01 and addresses in 2 ** 32, with halves of the two factors.

Defined results: a null text stays null, an empty one empty; n_replaced is 0 for both; whole texts are read; rows are
independent, so repeated rows have equal results; null ids matter nowhere; an empty table has no rows; other columns are kept
as they are.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "lexforge"
ROUNDS = 8
HEX = "0123456789abcdef"
DAYS = (319, 229)
#: Domains whose name tells of nobody, country calling codes of one and two digits, prefixes of access keys.
PUBLIC = ("example.com", "example.net", "example.org", "gmail.com", "googlemail.com", "gmx.de", "gmx.net", "hotmail.com", "icloud.com", "outlook.com", "proton.me", "web.de", "yahoo.com")
CALLING = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
KEYS = {"AKIA": "[A-Z0-9]{16}", "ASIA": "[A-Z0-9]{16}", "gh[opsu]_": "[A-Za-z0-9]{36}", "sk_live_": "[A-Za-z0-9]{24,}+", "xox[abp]-": "[A-Za-z0-9-]{20,}+"}
#: Kinds in the order in which they are tried at a place; none contains a group.
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?=[0-9A-Fa-f]{32})(?<=[=:]\s{0,3}[\"'])[0-9A-Fa-f]{32,}+(?=[\"'])",
    "key": r"(?<![A-Za-z0-9_-])(?:" + "|".join(f"{a}{b}" for a, b in KEYS.items()) + r")(?![A-Za-z0-9_-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "address": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})(?![\d/-]|\.\d)|(?<![\w.-])[1-9]\d? (?:" + MONTHS + r") \d{4}(?![\w-])",
    "social": r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]?\d{3,4}(?![\w-])|(?<![\w+])\+\d{9,15}(?![\w-])|(?=\d{9})(?<=\b(?:[Tt]el|TEL|[Pp]hone|[Ff]ax|[Mm]obile|[Cc]all)[.:]? )\d{9,12}(?![\w-])",
}
#: The shape of a found value alone where its pattern looks at what stands before it.
WHOLE = {"secret": "[0-9A-Fa-f]{32,}", "phone": PATTERNS["phone"].rpartition(r"|(?=\d{9})")[0] + r"|\d{9,12}"}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def number(text: Column) -> Column:
    """A number below 2 ** 60 from 15 hexadecimal digits."""
    return F.conv(text, 16, 10).cast("long")


def stream(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), turn.cast("string"), half), 256)


def shifted(char: Column, by: Column, alphabet: str | None, letters: int = 26) -> Column:
    if alphabet:
        return F.substr(F.lit(alphabet), (F.pmod(F.position(char, F.lit(alphabet)) - 1 + by, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
    code = F.ascii(char)
    within = lambda first, n: F.char(F.pmod(code - first + by, F.lit(n)) + first)
    return F.when(char.between("0", "9"), within(48, 10)).when(char.between("a", "z"), within(97, letters)).when(char.between("A", "Z"), within(65, letters)).otherwise(char)


def permuted(text: Column, key: str, kind: str, inverse: bool, alphabet: str | None = None, letters: int = 26) -> Column:
    """A string within its format."""
    chars, half = F.split(text, ""), F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.slice(chars, F.lit(1), half).alias("a"), F.slice(chars, half + 1, F.length(text)).alias("b"))
    sign = -1 if inverse else 1

    def turn(s: Column, i: Column) -> Column:
        fixed, moved = (s["a"], s["b"]) if inverse else (s["b"], s["a"])
        new = bound(stream(key, kind, i, F.array_join(fixed, "")), lambda h: F.transform(moved, lambda c, j: shifted(c, sign * number(F.substr(h, 1 + (j * 4) % 60, F.lit(4))), alphabet, letters)))
        return F.struct(new.alias("a"), fixed.alias("b")) if inverse else F.struct(fixed.alias("a"), new.alias("b"))

    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(turns, start, turn, lambda s: F.concat(F.array_join(s["a"], ""), F.array_join(s["b"], "")))


def permuted_number(value: Column, left: int, right: int, key: str, kind: str, inverse: bool) -> Column:
    """A number below left * right; the halves' ranges change places in each round."""
    start = F.struct(F.floor(value / right).cast("long").alias("a"), F.pmod(value, F.lit(right)).cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, F.lit(left)).otherwise(F.lit(right))
        if inverse:
            return F.struct(F.pmod(s["b"] - number(F.substr(stream(key, kind, i, s["a"].cast("string")), F.lit(1), F.lit(15))), size).cast("long").alias("a"), s["a"].alias("b"))
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + number(F.substr(stream(key, kind, i, s["b"].cast("string")), F.lit(1), F.lit(15))), size).cast("long").alias("b"))

    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(turns, start, turn, lambda s: s["a"] * right + s["b"])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refilled(text: Column, new: Column) -> Column:
    """text with its digits replaced, in order, by those of new."""
    step = lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["out"], F.substr(s["rest"], F.lit(1), F.lit(1))).alias("out"), F.substr(s["rest"], F.lit(2)).alias("rest"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["rest"].alias("rest")))
    return F.aggregate(F.split(text, ""), F.struct(F.lit("").alias("out"), new.alias("rest")), step, lambda s: s["out"])


def check_sum(number_: Column, check: bool) -> Column:
    """Sum of a card number's digits, every second one doubled; from the right, the check digit left out unless check."""
    return F.aggregate(F.transform(F.reverse(F.split(number_, "")), lambda c, j: bound(c.cast("int") * F.when((j % 2 == 0) == F.lit(not check), 2).otherwise(1), lambda d: d - F.when(d > 9, 9).otherwise(0))), F.lit(0), lambda a, b: a + b)


def card(value: Column, key: str, inverse: bool) -> Column:
    def new(d: Column) -> Column:
        body = permuted(F.substr(d, F.lit(1), F.length(d) - 1), key, "card", inverse)
        return bound(body, lambda b: F.concat(b, F.pmod(-check_sum(b, False), F.lit(10)).cast("string")))

    def ranges(groups: Column) -> Column:
        """(order, first group, number of groups) of what may be a card."""
        every = F.flatten(F.transform(F.sequence(F.lit(1), F.size(groups)), lambda i: F.transform(F.sequence(F.lit(1), F.size(groups) - i + 1), lambda n: F.struct(digits(F.array_join(F.slice(groups, i, n), "")).alias("d"), i.alias("i"), n.alias("n")))))
        valid = F.filter(every, lambda r: F.length(r["d"]).between(13, 19) & (check_sum(r["d"], True) % 10 == 0))
        return F.transform(valid, lambda r: F.struct(F.when(r["n"] == 1, 0).when(F.length(r["d"]) == 16, 1).otherwise(20 - F.length(r["d"])).alias("order"), r["i"].alias("i"), r["n"].alias("n")))

    def put(groups: Column, at: Column) -> Column:
        own = F.array_join(F.slice(groups, at["i"], at["n"]), " ")
        return F.array_join(F.concat(F.slice(groups, F.lit(1), at["i"] - 1), F.array(refilled(own, new(digits(own)))), F.slice(groups, at["i"] + at["n"], F.size(groups))), " ")

    return bound(F.split(value, " "), lambda groups: bound(F.array_min(ranges(groups)), lambda at: F.when(at.isNotNull(), put(groups, at))))


def address(value: Column, key: str, inverse: bool) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    whole = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    dotted = lambda n: F.concat_ws(".", *(F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))
    plain = ~value.rlike(r"(?:^|\.)0\d")
    return F.when(F.forall(parts, lambda x: x < 256) & plain, bound(permuted_number(whole, 65536, 65536, key, "address", inverse), dotted))


def date(value: Column, key: str, inverse: bool) -> Column:
    first = F.lit("1900-01-01").cast("date")
    out = F.lit(None).cast("string")

    def written(pattern: str) -> Callable[[Column], Column]:
        return lambda n: F.when((n >= 0) & (n < DAYS[0] * DAYS[1]), F.date_format(F.date_add(first, permuted_number(n, *DAYS, key, "date", inverse).cast("int")), pattern))

    for pattern in ("MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy-MM-dd", "d MMM yyyy"):
        new = bound(F.datediff(F.try_to_timestamp(value, F.lit(pattern)).cast("date"), first), written(pattern))
        shape = {"M": r"^\d\d/", "d": r"^\d\d[/.]", "d ": r"^\d+ ", "y": r"^\d{4}-"}[pattern[:2] if pattern[1] == " " else pattern[0]]
        out = F.coalesce(F.when(value.rlike(shape), new), out)
    return out


def phone(value: Column, key: str, inverse: bool) -> Column:
    """The country code stays."""
    known = rf"^(?:\+\d{{1,3}}(?=[ .-])|{CALLING})"
    code, rest = F.regexp_extract(value, known, 0), F.regexp_replace(value, known, "")
    return F.when(F.length(digits(value)).between(9, 15), F.concat(code, refilled(rest, permuted(digits(rest), key, "phone", inverse))))


def social(value: Column, key: str, inverse: bool) -> Column:
    return refilled(value, permuted(digits(value), key, "social", inverse))


def email(value: Column, key: str, inverse: bool) -> Column:
    at, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    labels = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
    known = F.lower(domain).rlike(r"(?:^|\.)(?:" + "|".join(PUBLIC).replace(".", r"\.") + ")$")
    return F.concat(permuted(at, key, "email", inverse), F.lit("@"), F.when(known, domain).otherwise(F.concat(permuted(labels, key, "domain", inverse), F.lit("."), F.substring_index(domain, ".", -1))))


def access_key(value: Column, key: str, inverse: bool) -> Column:
    prefix = F.regexp_extract(value, f"^(?:{'|'.join(KEYS)})", 0)
    return F.concat(prefix, permuted(F.substr(value, F.length(prefix) + 1), key, "key", inverse))


def account(value: Column, key: str, inverse: bool) -> Column:
    """A bank account number: country stays, the check digits are made anew."""

    def remainder(text: Column) -> Column:
        return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))

    def made(plain: Column) -> Column:
        country = F.substring(plain, 1, 2)
        new = bound(permuted(F.substr(plain, F.lit(5)), key, "account", inverse), lambda own: F.concat(country, F.lpad((98 - remainder(F.concat(own, country, F.lit("00")))).cast("string"), 2, "0"), own))
        fill = lambda s, c: F.when(c == " ", F.struct(F.concat(s["out"], c).alias("out"), s["rest"].alias("rest"))).otherwise(F.struct(F.concat(s["out"], F.substr(s["rest"], F.lit(1), F.lit(1))).alias("out"), F.substr(s["rest"], F.lit(2)).alias("rest")))
        valid = F.length(plain).between(15, 34) & (remainder(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))) == 1)
        return F.when(valid, bound(new, lambda n: F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), n.alias("rest")), fill, lambda s: s["out"])))

    return bound(F.replace(value, F.lit(" "), F.lit("")), made)


def secret(value: Column, key: str, inverse: bool) -> Column:
    return F.when(value.rlike("[A-F]"), permuted(value, key, "secret", inverse, letters=6)).otherwise(permuted(value, key, "secret", inverse, HEX))


KINDS = {"email": email, "secret": secret, "key": access_key, "account": account, "address": address, "date": date, "social": social, "card": card, "phone": phone}


def replaced(value: Column, key: str, inverse: bool) -> Column:
    """The pseudonym of a found value, or null where it fails its check."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, make in KINDS.items():
        out = out.when(value.rlike(f"^(?:{WHOLE.get(kind, PATTERNS[kind])})$"), make(value, key, inverse))
    return out


def pseudonymise(docs: DataFrame, key: str = KEY, inverse: bool = False, column: str = "text") -> DataFrame:
    """docs with column's personal data under pseudonyms, and n_replaced (long)."""
    names = [c for c in docs.columns if c != "n_replaced"]
    found = docs.select(F.struct(*names).alias("row"), F.col(column).cast("string").alias("text")).withColumn("found", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    new = found.withColumn("new", F.when(F.size("found") > 0, F.transform("found", lambda v: replaced(v, key, inverse))))
    pieces = F.split("text", ANY, -1)
    text = F.concat(F.element_at(pieces, 1), F.array_join(F.zip_with(F.zip_with("found", "new", lambda v, n: F.coalesce(n, v)), F.slice(pieces, F.lit(2), F.size("found") + 1), lambda v, piece: F.concat(v, piece)), ""))
    out = new.select("row", F.when(F.size("found") > 0, text).otherwise(F.col("text")).alias("text"), F.coalesce(F.size(F.filter("new", lambda n: n.isNotNull())), F.lit(0)).cast("long").alias("n"))
    return out.select(*((F.col("text") if c == column else F.col("row")[c]).alias(c) for c in names), F.when(F.col("n") < 0, 0).otherwise(F.col("n")).alias("n_replaced"))


def restore(docs: DataFrame, key: str = KEY, column: str = "text") -> DataFrame:
    return pseudonymise(docs, key, True, column)


def op3_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
