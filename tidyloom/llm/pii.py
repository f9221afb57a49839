"""Format-preserving pseudonyms of personal data, in column expressions only.

Values are found by pattern, validated, and permuted by a keyed Feistel network within their format: digits stay
digits, letters stay letters of their case, separators stay where they are, a date becomes a date, an address an
address, and a number with a valid check digit one with a valid check digit.  One value has one pseudonym in all
documents, however its digits are grouped, so documents stay linked.  Whoever has the key can undo it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Only shown here so that results can be repeated; pass a secret one.
KEY = "tidyloom"
#: Dates are permuted within eras of 73,000 days, 250 times 292; the middle one begins in 1900.
ERA, ERA_PART, FIRST_DAY = 73_000, 292, -25_567

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,24}"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"
#: How long the account numbers of each country are.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban_pattern() -> str:
    """Account numbers as long as their country has them; of other countries, and of other lengths, any."""
    known = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}"
                     + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![0-9A-Za-z])" for n, c in IBAN_LENGTHS.items())
    return rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![0-9A-Za-z]))"


IBAN = _iban_pattern()
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = (r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
         r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])")
#: Country codes in use, by their first digits.
COUNTRY = ("^(?:1|7|2(?:0|7|1[1-368]|[2-6][0-9]|9[0-1789])|3(?:[0-469]|5[0-9]|7[0-8]|8[0-35-79])|4(?:[013-9]|2[013])"
           "|5(?:[1-8]|0[0-9]|9[0-9])|6(?:[0-6]|7[0-9]|8[0-9]|9[0-2])|8(?:[1246]|0[08]|5[02356]|7[08]|8[0-368])"
           "|9(?:[0-58]|6[0-8]|7[0-79]|9[2-68]))")
#: A whole run of groups of digits, up to a value of another kind; `_cards` looks for numbers in it.
CARD = (r"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++"
        rf"(?:[ -](?!{EMAIL}|{SECRET}|{ADDRESS}|{DATE}|{SOCIAL}|{PHONE})[0-9]++)*+")
#: How card numbers begin.
ISSUER = "^(?:2[2-7]|[3-6])"
#: Tried at each place in this order.
PATTERN = "|".join((EMAIL, SECRET, IBAN, ADDRESS, DATE, SOCIAL, PHONE, CARD))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _hash(key: str, tweak: str, i: Column, value: Column, block: Column | int = 0) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), F.lit(block).cast("string")
                              if isinstance(block, int) else block.cast("string"), value.cast("string")), 256)


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def feistel_numbers(left: Column, right: Column, lefts: int, rights: int, key: str, tweak: str) -> Column:
    """A permutation of pairs below ``lefts`` and ``rights``: a struct ``l, r``."""
    def turn(pair: Column, i: Column) -> Column:
        even = i % 2 == 0
        add = _number(F.substring(_hash(key, tweak, i, F.when(even, pair.r).otherwise(pair.l)), 1, 13))
        return F.struct(F.when(even, F.pmod(pair.l + add, F.lit(lefts))).otherwise(pair.l).cast("long").alias("l"),
                        F.when(even, pair.r).otherwise(F.pmod(pair.r + add, F.lit(rights))).cast("long").alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _shift(text: Column, stream: Column, hexadecimal: bool) -> Column:
    """Each letter or digit moved within its kind by four hex digits of the stream."""
    def move(c: Column, i: Column) -> Column:
        by = _number(F.substring(stream, i * 4 + 1, F.lit(4)))
        code = F.ascii(c)

        def within(first: str, size: int) -> Column:
            return F.char(F.lit(ord(first)) + F.pmod(code - ord(first) + by, F.lit(size)))

        if hexadecimal:
            at = F.pmod(F.instr(F.lit("0123456789abcdef"), c) - 1 + by, F.lit(16)).cast("int") + 1
            return F.lit("0123456789abcdef").substr(at, F.lit(1))
        return (F.when(c.between("0", "9"), within("0", 10)).when(c.between("a", "z"), within("a", 26))
                .when(c.between("A", "Z"), within("A", 26)).otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), move), "")


def feistel_text(text: Column, key: str, tweak: str, hexadecimal: bool = False) -> Column:
    """A permutation of the texts that have the same kinds of characters in the same places."""
    def turn(pair: Column, i: Column) -> Column:
        even = i % 2 == 0
        moved, other = (F.when(even, a).otherwise(b) for a, b in ((pair.l, pair.r), (pair.r, pair.l)))
        blocks = F.sequence(F.lit(0), F.floor(F.length(moved) / 16).cast("int"))
        stream = F.array_join(F.transform(blocks, lambda b: _hash(key, tweak, i, F.lower(other), b)), "")
        return _let(F.struct(moved.alias("m"), other.alias("o"), stream.alias("s")), lambda x: _let(
            F.struct(_shift(x.m, x.s, hexadecimal).alias("m"), x.o.alias("o")), lambda y: F.struct(
                F.when(even, y.m).otherwise(y.o).alias("l"), F.when(even, y.o).otherwise(y.m).alias("r"))))

    half = F.ceil(F.length(text) / 2).cast("int")
    start = F.struct(text.substr(F.lit(1), half).alias("l"), text.substr(half + 1, F.length(text)).alias("r"))
    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn), lambda p: F.concat(p.l, p.r))


def _refill(form: Column, symbols: Column) -> Column:
    """``form`` with its letters and digits replaced by the symbols in turn."""
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))

    def put(state: Column, c: Column) -> Column:
        own = c.rlike("[0-9A-Za-z]")
        return F.struct((state.k + own.cast("int")).alias("k"), F.concat(state.out, F.when(
            own, symbols.substr(state.k + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(form, ""), start, put, lambda s: s.out)


def luhn_digit(payload: Column) -> Column:
    """The digit that completes a payload by the Luhn rule."""
    def weigh(total: Column, d: Column) -> Column:
        doubled = d.cast("int") * 2
        return F.struct((total.s + F.when(total.k % 2 == 0, doubled - F.when(doubled > 9, 9).otherwise(0)).otherwise(
            d.cast("int"))).alias("s"), (total.k + 1).alias("k"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("k"))
    return F.aggregate(F.split(F.reverse(payload), ""), start, weigh, lambda t: F.pmod(-t.s, F.lit(10)))


def _secret(value: Column, key: str) -> Column:
    """Hexadecimal digits; capitals if there is no small letter."""
    return _let(feistel_text(F.lower(value), key, "secret", hexadecimal=True),
                lambda new: F.when(value.rlike("[a-f]"), new).otherwise(F.upper(new)))


def _cards(value: Column, key: str) -> Column:
    """A run of groups of digits with its card numbers replaced, and how many these are: a struct ``text, n``.

    A card number is 13 to 19 digits of whole groups whose last one is the check digit; the longest counts.  It begins
    the run, follows another or is a single group; between other numbers it must also begin as cards do, or lists of
    numbers would hold too many by chance.
    """
    def digits(c: Column) -> Column:
        return F.regexp_replace(c, "[^0-9]", "")

    def valid(c: Column) -> Column:
        return _let(digits(c), lambda d: luhn_digit(d.substr(F.lit(1), F.length(d) - 1)).cast("string") == F.right(d, F.lit(1)))

    def permute(c: Column) -> Column:
        return _let(digits(c), lambda d: _let(feistel_text(d.substr(F.lit(1), F.length(d) - 1), key, "number"),
                                              lambda new: _refill(c, F.concat(new, luhn_digit(new).cast("string")))))

    def longest(rest: Column, first: Column) -> Column:
        found = F.array(*(F.regexp_extract(rest, rf"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])", 0) for n in range(19, 12, -1)))
        return F.get(F.filter(found, lambda c: (c != "") & (first | ~c.rlike("[ -]") | c.rlike(ISSUER)) & valid(c)), F.lit(0))

    def search(groups: Column) -> Column:
        def turn(state: Column, group: Column) -> Column:
            """``i`` is the number of this group, ``free`` that of the first one behind the last card number."""
            rest = F.array_join(F.slice(groups, state.i, 19), "")
            card = F.when(state.i >= state.free, longest(rest, state.i == state.free))
            return _let(card, lambda c: _let(state.i + F.size(F.split(c, "[ -]")), lambda free: F.struct(
                (state.i + 1).alias("i"), F.when(c.isNull(), state.free).otherwise(free).alias("free"),
                F.when(state.i < state.free, state.text).when(c.isNull(), F.concat(state.text, group)).otherwise(
                    F.concat(state.text, permute(c), F.regexp_replace(F.get(groups, free - 2), "[0-9]", ""))).alias("text"),
                (state.n + c.isNotNull().cast("int")).alias("n"))))

        start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("free"), F.lit("").alias("text"), F.lit(0).alias("n"))
        return F.aggregate(groups, start, turn, lambda s: F.struct(s.text.alias("text"), s.n.alias("n")))

    return _let(F.regexp_extract_all(value, F.lit("[0-9]+[ -]?"), F.lit(0)), search)


def iban_rest(letters: Column) -> Column:
    """An IBAN's remainder by 97, its first four characters moved to the end and letters read as numbers."""
    moved = F.concat(letters.substr(F.lit(5), F.length(letters)), letters.substr(1, 4))
    digits = F.array_join(F.transform(F.split(moved, ""), lambda c: F.when(c.between("0", "9"), c).otherwise(
        (F.ascii(c) - 55).cast("string"))), "")
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda rest, d: (rest * 10 + d.cast("int")) % 97)


def _iban(value: Column, key: str) -> Column:
    """A match may have taken words that follow: of its beginnings that end with a word, the longest valid one counts."""
    def permute(letters: Column) -> Column:
        account = feistel_text(letters.substr(F.lit(5), F.length(letters)), key, "iban")
        return _let(F.struct(letters.substr(1, 2).alias("c"), account.alias("a")), lambda x: F.concat(
            x.c, F.lpad((98 - iban_rest(F.concat(x.c, F.lit("00"), x.a))).cast("string"), 2, "0"), x.a))

    def search(words: Column) -> Column:
        starts = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, 1, n), " "))
        return F.get(F.filter(starts, lambda c: _let(
            F.regexp_replace(c, " ", ""), lambda letters: (F.length(letters) >= 12) & (iban_rest(letters) == 1))), F.lit(0))

    return _let(search(F.split(value, " ")), lambda found: F.when(found.isNull(), value).otherwise(F.concat(
        _refill(found, permute(F.regexp_replace(found, " ", ""))), value.substr(F.length(found) + 1, F.length(value)))))


def _phone(value: Column, key: str) -> Column:
    """The country code stays; all other digits are permuted.  An international number has 7 to 15 digits and begins with
    a country code that is given out; what has not, such as a measure or a score, is none."""
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    digits = F.regexp_replace(value, "[^0-9]", "")
    valid = ~value.startswith("+") | F.length(digits).between(7, 15) & digits.rlike(COUNTRY)
    new = _let(country, lambda c: _let(value.substr(F.length(c) + 1, F.length(value)), lambda rest: F.concat(
        c, _refill(rest, feistel_text(F.regexp_replace(rest, "[^0-9]", ""), key, "phone")))))
    return F.when(valid, new).otherwise(value)


def _address(value: Column, key: str) -> Column:
    def permute(parts: Column) -> Column:
        def part(i: int) -> Column:
            return parts[i].cast("int")

        new = feistel_numbers(part(0) * 256 + part(1), part(2) * 256 + part(3), 1 << 16, 1 << 16, key, "address")
        valid = F.forall(parts, lambda p: p.cast("int") <= 255)
        return F.when(valid, _let(new, lambda n: F.concat_ws(".", *(x.cast("string") for x in (
            F.floor(n.l / 256), n.l % 256, F.floor(n.r / 256), n.r % 256))))).otherwise(value)

    return _let(F.split(value, r"\."), permute)


def _date(value: Column, key: str) -> Column:
    """Of ``a/b/year`` the month is ``a`` unless only ``b`` can be; with dots the day comes first."""
    def permute(day: Column, form: str) -> Column:
        shifted = F.unix_date(day) - FIRST_DAY
        era = F.floor(shifted / ERA)
        at = F.pmod(shifted, F.lit(ERA))
        new = feistel_numbers(F.floor(at / ERA_PART), at % ERA_PART, ERA // ERA_PART, ERA_PART, key, "date")
        moved = _let(new, lambda n: F.date_format(F.date_from_unix_date(
            (era * ERA + n.l * ERA_PART + n.r + FIRST_DAY).cast("int")), form))
        return F.when(day.isNotNull() & era.between(-1, 1), moved).otherwise(value)

    def read(form: str) -> Column:
        return F.try_to_date(value, form) if hasattr(F, "try_to_date") else F.try_to_timestamp(
            value, F.lit(form)).cast("date")

    iso, dots = value.contains("-"), value.rlike(r"\..*\.")
    american = value.rlike("^(0[1-9]|1[0-2])/(0[1-9]|[12][0-9]|3[01])/")
    return (F.when(iso, permute(read("yyyy-MM-dd"), "yyyy-MM-dd")).when(dots, permute(read("dd.MM.yyyy"), "dd.MM.yyyy"))
            .when(american, permute(read("MM/dd/yyyy"), "MM/dd/yyyy"))
            .when(value.rlike("^../../"), permute(read("dd/MM/yyyy"), "dd/MM/yyyy")).otherwise(value))


def _social(value: Column, key: str) -> Column:
    """Areas 000, 666 and from 900 on are not given out; neither is group 00 or number 0000."""
    valid = value.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)")
    return F.when(valid, _refill(value, feistel_text(F.regexp_replace(value, "-", ""), key, "social"))).otherwise(value)


def pseudonym(value: Column, key: str = KEY) -> Column:
    """One found value with its pseudonym, and how many values in it changed: a struct ``text, n``; what fails its
    validation stays as it is."""
    local = F.substring_index(value, "@", 1)
    single = (F.when(value.contains("@"), F.concat(feistel_text(local, key, "email"),
                                                   value.substr(F.length(local) + 1, F.length(value))))
              .when(value.rlike(f"^(?:{SECRET})$"), _secret(value, key))
              .when(value.rlike("^[A-Z]"), _iban(value, key))
              .when(value.rlike(r"^[0-9]+(\.[0-9]{1,3}){3}$"), _address(value, key))
              .when(value.rlike(f"^(?:{DATE})$"), _date(value, key))
              .when(value.rlike(f"^(?:{SOCIAL})$"), _social(value, key))
              .when(value.rlike(f"^(?:{PHONE})$"), _phone(value, key)))
    return _let(single, lambda new: F.when(new.isNull(), _cards(value, key)).otherwise(
        F.struct(new.alias("text"), (new != value).cast("int").alias("n"))))


def pseudonymize(docs: DataFrame, key: str = KEY, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced, and ``n_found``, the number of values that changed.

    All other columns stay, of any name, but one called ``n_found`` is replaced.  Null texts stay null and have 0; ids, repeated rows
    and empty tables need no care, since each text is handled by itself, whole.
    """
    text = F.col(text_col)
    names = docs.columns
    kept = [F.col(f"`{c}`") for c in names if c not in (text_col, "n_found")]
    was, new = (f"{c}{'_' * max(map(len, names))}" for c in ("found", "new"))  # longer than any name there is
    found = docs.select(*kept, text.alias(text_col), F.coalesce(
        F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>")).alias(was))
    changed = found.withColumn(new, F.transform(was, lambda v: pseudonym(v, key)))
    pieces = F.zip_with(F.split(text, PATTERN, -1), new, lambda a, b: F.concat(a, F.coalesce(b["text"], F.lit(""))))
    out = changed.select(*kept, F.when(F.size(was) == 0, text).otherwise(F.array_join(pieces, "")).alias(text_col),
                         F.aggregate(new, F.lit(0).cast("long"), lambda total, v: total + v["n"]).alias("n_found"))
    return out.select(*(f"`{c}`" for c in names if c != "n_found"), "n_found")
