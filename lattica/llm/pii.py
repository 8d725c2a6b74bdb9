"""Format-preserving pseudonyms for personal data, with DataFrame functions alone.

Candidates are found by one regular expression and validated: card numbers by
Luhn's digit, IBANs by their remainder, dates by the calendar, social security
and IPv4 numbers by their ranges.  Each is then permuted within its format by a
keyed Feistel network, so that the same value has the same pseudonym in every
document and valid values stay valid: check digits are made anew, dates stay
dates and octets octets.  Rounds are keyed SHA-256.

Strings of digits and letters are split into halves that shift each other
character by character, digits within digits and letters within their case, so
a string's permutation keeps its length and every separator.  Dates, social
security numbers and IPv4 numbers are pairs (a, b) from residues whose product
is the format's domain, so that no cycle has to be walked.

Where candidates overlap, the leftmost that validates is taken.

Defined cases: null text stays null, and has no values; what doesn't validate
stays as it is; repeated rows are treated each; a column of the documents with
the name of a result column gives way to it; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import let, local_table

# fixed values: the formats, by kind; none begins or ends inside a longer word or number
KINDS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7} [A-Z0-9]{1,4})",
    "date": r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}",
    "ip": r"(?:\d{1,3}\.){3}\d{1,3}(?!\.\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{8,15}|\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d{1,2}(?:[ .-]\d{2}){4}|0\d(?:(?: \d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4})(?![ .-]\d)",
    "card": r"\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5}",
}
#: What each kind may not follow besides a letter or digit, as that would continue it; the rest may follow any sign.
AFTER = {"email": r"[._%+-]", "date": r"\d[./-]", "ip": r"\d[.]", "ssn": r"\d[.-]", "phone": r"\d[.+-]", "card": r"\d[.]"}
#: What may not follow a kind; a time of day may follow a date.
BEFORE = {"date": r"[0-9A-SU-Za-su-z]|[Tt](?!\d)"}
PATTERN = r"(?<![0-9A-Za-z])(?:" + "|".join((f"(?<!{AFTER[k]})" if k in AFTER else "") + f"(?:{p})(?!{BEFORE.get(k, '[0-9A-Za-z]')})" for k, p in KINDS.items()) + ")"

#: Rounds of a network; even, so that the halves end where they were.
ROUNDS = 10
# fixed values: domains as products of residues
#: 400 Gregorian years of days from 1800-01-01 on: 189 * 773 = 146097
DATES = (189, 773)
#: areas 001-899 without 666 by groups 01-99, and serials 0001-9999
SSNS = (898 * 99, 9999)
IPS = (65536, 65536)


def _prf(key: str | Column, kind: str, turn: Column, *seen: Column) -> Column:
    """256 pseudorandom bits in hexadecimal."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), *seen), 256)


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def permuted_pair(a: Column, b: Column, domain: tuple[int, int], key: str, kind: str) -> tuple[Column, Column]:
    """A permutation of the pairs (a, b) with 0 <= a < domain[0] and 0 <= b < domain[1]."""
    state = lambda a, b, p, q: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), p.cast("long").alias("p"), q.cast("long").alias("q"))
    turn = lambda s, r: state(s["b"], F.pmod(s["a"] + _number(F.substring(_prf(key, kind, r, s["b"].cast("string")), 1, 12)), s["p"]), s["q"], s["p"])
    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(a, b, F.lit(domain[0]), F.lit(domain[1])), turn)
    return out["a"], out["b"]


def _char(c: Column, base: str, size: int, k: Column) -> Column:
    return F.char(F.lit(ord(base)) + F.pmod(F.ascii(c) - ord(base) + k, F.lit(size)))


def _shifted(s: Column, noise: Column) -> Column:
    """Each digit or ASCII letter moved within its kind by three hexadecimal digits of noise (60 of them, used in turn)."""

    def moved(i: Column, n: Column) -> Column:
        c, k = F.substr(s, i, F.lit(1)), _number(F.substr(n, F.pmod(i - 1, F.lit(20)) * 3 + 1, F.lit(3)))
        return F.when(c.between("0", "9"), _char(c, "0", 10, k)).when(c.between("a", "z"), _char(c, "a", 26, k)).when(c.between("A", "Z"), _char(c, "A", 26, k)).otherwise(c)

    return F.when(F.length(s) == 0, F.lit("")).otherwise(let(noise, lambda n: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: moved(i, n)), "")))


def permuted_text(s: Column, key: str, kind: str) -> Column:
    """A permutation of the strings of one pattern of digits, letters and other characters."""
    cut = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), cut).alias("l"), F.substr(s, cut + 1, F.length(s)).alias("r"))
    turn = lambda x, r: F.struct(x["r"].alias("l"), _shifted(x["l"], _prf(key, kind, r, x["r"])).alias("r"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return F.concat(out["l"], out["r"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refilled(s: Column, digits: Column) -> Column:
    """``s`` with its digits replaced by those of ``digits`` in order."""
    nth = lambda i: F.length(_digits(F.substr(s, F.lit(1), i)))
    one = lambda i, d: F.when(F.substr(s, i, F.lit(1)).between("0", "9"), F.substr(d, nth(i), F.lit(1))).otherwise(F.substr(s, i, F.lit(1)))
    return let(digits, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: one(i, d)), ""))


def luhn_sum(d: Column, first_doubled: int) -> Column:
    """Luhn's sum of a digit string from its right end; ``first_doubled`` is the first place, from 0, that counts double."""

    def add(total: Column, i: Column, x: Column) -> Column:
        v = F.substr(x, F.length(x) - i, F.lit(1)).cast("int")
        return total + F.when(F.pmod(i, F.lit(2)) == first_doubled, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return let(d, lambda x: F.aggregate(F.sequence(F.lit(0), F.length(x) - 1), F.lit(0), lambda total, i: add(total, i, x)))


def is_card(s: Column) -> Column:
    return luhn_sum(_digits(s), 1) % 10 == 0


def card(s: Column, key: str) -> Column:
    d = _digits(s)
    whole = lambda body: F.concat(body, F.pmod(F.lit(10) - luhn_sum(body, 0) % 10, F.lit(10)).cast("string"))
    return _refilled(s, let(permuted_text(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"), whole))


def iban_rest(s: Column) -> Column:
    """The remainder by 97 of the number that letters and digits spell."""

    def step(rest: Column, i: Column, x: Column) -> Column:
        c = F.substr(x, i, F.lit(1))
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return let(s, lambda x: F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), lambda rest, i: step(rest, i, x)))


def _unspaced(s: Column) -> Column:
    return F.regexp_replace(s, " ", "")


def _respaced(s: Column, letters: Column) -> Column:
    """``s`` with all but its spaces replaced by the characters of ``letters`` in order."""
    nth = lambda i: F.length(_unspaced(F.substr(s, F.lit(1), i)))
    one = lambda i, x: F.when(F.substr(s, i, F.lit(1)) == " ", " ").otherwise(F.substr(x, nth(i), F.lit(1)))
    return let(letters, lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: one(i, x)), ""))


def is_iban(s: Column) -> Column:
    return let(_unspaced(s), lambda x: F.length(x).between(15, 34) & (iban_rest(F.concat(F.substr(x, F.lit(5), F.length(x)), F.substr(x, F.lit(1), F.lit(4)))) == 1))


def iban_part(s: Column) -> Column:
    """The longest run of groups from the first on that is an IBAN, as words may follow in groups' form; else ``s``."""
    ends = lambda x: F.transform(F.sequence(F.size(x), F.least(F.lit(4), F.size(x)), F.lit(-1)), lambda n: F.array_join(F.slice(x, F.lit(1), n), " "))
    return F.when(s.rlike(r"^[A-Z]{2}\d{2} "), F.coalesce(F.get(F.filter(let(F.split(s, " "), ends), is_iban), 0), s)).otherwise(s)


def iban(s: Column, key: str) -> Column:
    """Grouped or not, a number has the same pseudonym, in its groups."""

    def made(x: Column) -> Column:
        land = F.substr(x, F.lit(1), F.lit(2))
        whole = lambda body: F.concat(land, F.lpad((F.lit(98) - iban_rest(F.concat(body, land, F.lit("00")))).cast("string"), 2, "0"), body)
        return let(permuted_text(F.substr(x, F.lit(5), F.length(x)), key, "iban"), whole)

    return F.when(s.contains(" "), _respaced(s, let(_unspaced(s), made))).otherwise(made(s))


def _day(s: Column) -> tuple[Column, Column]:
    """A date's day and the format that it was read by; nulls where it is none."""
    day, form = F.lit(None).cast("date"), F.lit(None).cast("string")
    for pattern in ("MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy-MM-dd"):
        shape = "^" + "".join(r"\d{%d}" % len(x) if x.isalpha() else "\\" + x for x in _parts(pattern)) + "$"
        fits = s.rlike(shape) & F.try_to_timestamp(s, F.lit(pattern)).isNotNull()
        day, form = F.when(fits, F.try_to_timestamp(s, F.lit(pattern)).cast("date")).otherwise(day), F.when(fits, F.lit(pattern)).otherwise(form)
    return day, form


def _parts(pattern: str) -> list[str]:
    out: list[str] = []
    for c in pattern:
        if out and c.isalpha() and out[-1][-1] == c:
            out[-1] += c
        else:
            out.append(c)
    return out


def is_date(s: Column) -> Column:
    day, _ = _day(s)
    return F.coalesce(F.datediff(day, F.lit("1800-01-01").cast("date")).between(0, DATES[0] * DATES[1] - 1), F.lit(False))


def date(s: Column, key: str) -> Column:
    day, form = _day(s)
    n = F.datediff(day, F.lit("1800-01-01").cast("date"))
    a, b = permuted_pair(F.floor(n / DATES[1]), F.pmod(n, F.lit(DATES[1])), DATES, key, "date")
    new = F.date_add(F.lit("1800-01-01").cast("date"), (a * DATES[1] + b).cast("int"))
    out = F.date_format(new, "yyyy-MM-dd")
    for pattern in ("dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy"):
        out = F.when(form == pattern, F.date_format(new, pattern)).otherwise(out)
    return out


def _part(s: Column, by: str, i: int) -> Column:
    return F.split(s, by)[i].cast("long")


def is_ip(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda x: x.cast("int") <= 255)


def ip(s: Column, key: str) -> Column:
    octet = lambda i: _part(s, r"\.", i)
    a, b = permuted_pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), IPS, key, "ip")
    return F.concat_ws(".", *[x.cast("string") for v in (a, b) for x in (F.floor(v / 256), F.pmod(v, F.lit(256)))])


def is_ssn(s: Column) -> Column:
    area = _part(s, "-", 0)
    return area.between(1, 899) & (area != 666) & (_part(s, "-", 1) > 0) & (_part(s, "-", 2) > 0)


def ssn(s: Column, key: str) -> Column:
    area = _part(s, "-", 0)
    nth = area - 1 - F.when(area > 666, 1).otherwise(0)
    a, b = permuted_pair(nth * 99 + _part(s, "-", 1) - 1, _part(s, "-", 2) - 1, SSNS, key, "ssn")
    new = F.floor(a / 99) + 1
    new = new + F.when(new >= 666, 1).otherwise(0)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat_ws("-", pad(new, 3), pad(F.pmod(a, F.lit(99)) + 1, 2), pad(b + 1, 4))


def phone(s: Column, key: str) -> Column:
    """All digits but those of a country code set apart by a separator or bracket, and the 0 before national pairs."""
    code = F.regexp_extract(s, r"^(?:\+\d{1,3}[ .(-]|0(?=\d(?:[ .-]\d{2}){4}$))", 0)
    rest = F.substr(s, F.length(code) + 1, F.length(s))
    return F.concat(code, _refilled(rest, permuted_text(_digits(rest), key, "phone")))


def email(s: Column, key: str) -> Column:
    """The part before the sign, under a key that the domain has a part in."""
    at = F.instr(s, "@")
    local, domain = F.substr(s, F.lit(1), at - 1), F.substr(s, at, F.length(s))
    cut = F.floor(F.length(local) / 2).cast("int")
    start = F.struct(F.substr(local, F.lit(1), cut).alias("l"), F.substr(local, cut + 1, F.length(local)).alias("r"))
    turn = lambda x, r: F.struct(x["r"].alias("l"), _shifted(x["l"], _prf(key, "email", r, F.lower(domain), x["r"])).alias("r"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return F.concat(out["l"], out["r"], domain)


def kind_of(s: Column) -> Column:
    """The kind of a candidate that validates, null for the rest."""
    checks = {"email": F.lit(True), "iban": is_iban(s), "date": is_date(s), "ip": is_ip(s), "ssn": is_ssn(s), "phone": F.lit(True), "card": is_card(s)}
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(s.rlike(f"^(?:{pattern})$"), F.when(checks[kind], F.lit(kind))).otherwise(out)
    return out


def pseudonym(s: Column, kind: Column, key: str) -> Column:
    out = s
    for name, make in {"email": email, "iban": iban, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "card": card}.items():
        out = F.when(kind == name, make(s, key)).otherwise(out)
    return out


def chosen(text: Column) -> Column:
    """A text as an array of (was, kind, rest): values that validate, leftmost first, and what follows each; the first has neither kind nor value.

    The text is cut wherever a candidate begins, so one that begins inside
    another is tried too, unless the other validates.
    """
    pieces = F.split(text, f"(?={PATTERN})", -1)
    heads = F.regexp_extract_all(text, F.lit(f"(?=({PATTERN}))"), F.lit(1))
    known = lambda s: F.struct(s.alias("was"), kind_of(s).alias("kind"))
    tried = F.transform(F.transform(heads, iban_part), known)
    empty = F.struct(F.lit("").alias("was"), F.lit(None).cast("string").alias("kind"))
    # a text that begins with a candidate has no piece before it
    parts = lambda p: F.arrays_zip(F.when(F.size(p) > F.size(heads), p).otherwise(F.concat(F.array(F.lit("")), p)).alias("piece"), F.concat(F.array(empty), tried).alias("head"))

    def step(state: Column, x: Column) -> Column:
        own = x["head"]["kind"].isNotNull() & (state["over"] == 0)
        over = F.when(own, F.length(x["head"]["was"])).otherwise(state["over"])
        rest = F.substr(x["piece"], over + 1, F.length(x["piece"]))
        out = F.struct(F.when(own, x["head"]["was"]).alias("was"), F.when(own, x["head"]["kind"]).alias("kind"), rest.alias("rest"))
        return F.struct(F.greatest(over - F.length(x["piece"]), F.lit(0)).alias("over"), F.concat(state["out"], F.array(out)).alias("out"))

    start = F.struct(F.lit(0).alias("over"), F.array().cast("array<struct<was:string,kind:string,rest:string>>").alias("out"))
    return F.when(F.size(heads) > 0, F.aggregate(let(pieces, parts), start, step, lambda s: s["out"]))


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every validated value in the text replaced by its pseudonym, and ``pii``: kind and pseudonym of each in order."""
    text = F.col(f"`{text_col}`")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("pii", text_col)]
    # one row beside each text: as a literal, the key would stand in the plan, and so in the event log
    secret = local_table(docs.sparkSession, [(key,)], "__key string")
    found = docs.select(*own, text.alias("__text"), chosen(text).alias("__found")).crossJoin(F.broadcast(secret))
    made = F.transform("__found", lambda x: F.struct(x["kind"].alias("kind"), F.when(x["kind"].isNotNull(), pseudonym(x["was"], x["kind"], F.col("__key"))).alias("value"), x["rest"].alias("rest")))
    found = found.select(*own, "__text", made.alias("__made"))
    whole = F.array_join(F.transform("__made", lambda m: F.concat(F.coalesce(m["value"], F.lit("")), m["rest"])), "")
    new_text = F.coalesce(whole, F.col("__text")).alias(text_col)
    kept = [new_text if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "pii"]
    values = F.transform(F.filter("__made", lambda m: m["kind"].isNotNull()), lambda m: F.struct(m["kind"].alias("kind"), m["value"].alias("value")))
    return found.select(*kept, F.coalesce(values, F.array().cast("array<struct<kind:string,value:string>>")).alias("pii"))


def report(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, its text with pseudonyms, and how many values of each kind it has."""
    found = pseudonymise(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), key)
    of = lambda kind: F.size(F.filter("pii", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias(id_col), "text", *map(of, KINDS))
