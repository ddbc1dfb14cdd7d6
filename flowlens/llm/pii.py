"""Personal data replaced by pseudonyms of the same format. DataFrame functions only.

Numbers are validated (check digits, ranges, calendar) and then run through a keyed Feistel network over their
own digits, so that a card number becomes a valid card number, a date a date. The network permutes each format:
equal values get equal pseudonyms in every document, different values different ones, and the key's holder can
turn them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# In this order of preference where several could start at one place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}+\.){1,20}[A-Za-z]{2,}(?![A-Za-z0-9-])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}(?=T\d)|(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![./-]?\w))",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?!-?\w)",
    "card": r"(?<![\w+-])\d(?:[ -]?\d){12,18}(?![-]?\w)",
    "phone": r"(?<![\w+(])(?:(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+[1-9](?:[ .-]?\(?\d\)?){7,13})(?!\w)",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
# Cards are searched in whole runs of digit groups, which end before a word that looks like a date or an SSN.
WORD = r"(?!(?:\d{4}-\d{2}-\d{2}|\d{3}-\d{2}-\d{4})(?!-?\w))\d++(?:-\d++)*+(?!-?\w)"
RUN = rf"(?<![\w+-])(?=\d(?:[ -]?\d){{12}}){WORD}(?: {WORD})*+"
FOUND = "|".join(f"(?:{RUN if k == 'card' else p})" for k, p in KINDS.items())
# Groups that may be one card, best first: a single group, the printed forms, any 13 to 19 digits.
CARD_FORMS = (r"\A\d{13,19}\z", r"\A(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})\z", r"\A\d(?:[ -]?\d){12,18}\z")
ROUNDS = 8
# Dates live in 2^17 days from here (until 2158), so that two halves of 8 and 9 bits hold all of them.
FIRST_DAY, DAY_BITS = "1800-01-01", (256, 512)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def longs(*values) -> Column:
    return F.array(*[F.lit(v).cast("bigint") if isinstance(v, int) else v.cast("bigint") for v in values])


def feistel(values: Column, radices: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """Permutes arrays with values[i] in 0..radices[i]-1, by adding to one half a hash of the other, in turns.

    The additions are modulo each radix, so any mix of radices is permuted exactly; ``back`` undoes it.
    """
    def cut(x: Column) -> Column:
        left = F.ceil(F.size(x) / 2).cast("int")
        return F.struct(F.slice(x, 1, left).alias("a"), F.slice(x, left + 1, F.size(x)).alias("b"))

    return let(F.struct(cut(values).alias("v"), cut(radices).alias("r"), tweak.alias("t")), lambda s: _turns(s, key, back))


def _turns(s: Column, key: str, back: bool) -> Column:
    ra, rb = s["r"]["a"], s["r"]["b"]

    def stirred(half: Column, radix: Column, other: Column, turn: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), s["t"], turn.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))

        def one(x: Column, i: Column, seed: Column) -> Column:
            h = F.conv(F.substring(F.sha2(F.concat_ws("#", seed, i.cast("string")), 256), 1, 12), 16, 10).cast("bigint")
            return F.pmod(x - h if back else x + h, F.get(radix, i))

        return let(seed, lambda seed: F.transform(half, lambda x, i: one(x, i, seed)))

    def turn(acc: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(stirred(acc["a"], ra, acc["b"], i).alias("a"), acc["b"].alias("b"))).otherwise(
            F.struct(acc["a"].alias("a"), stirred(acc["b"], rb, acc["a"], i).alias("b")))

    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(i) for i in order]), s["v"], turn, lambda acc: F.concat(acc["a"], acc["b"]))


def chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), 1)


def digits(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("([0-9])"), 1), lambda c: c.cast("bigint"))


def refill(token: Column, slot: str, symbols: Column) -> Column:
    """The token with its characters of class ``slot`` replaced in order; all others keep their place."""
    def place(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(token, F.lit(1), i), f"[^{slot}]", ""))
        return F.when(c.rlike(f"[{slot}]"), F.get(symbols, before)).otherwise(c)

    return F.array_join(F.transform(chars(token), place), "")


def texts(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("string"))


def luhn_sum(d: Column) -> Column:
    """Check sum of digits whose last one is the check digit."""
    def add(x: Column, i: Column) -> Column:
        twice = 2 * x - F.when(x > 4, 9).otherwise(0)
        return F.when((F.size(d) - i) % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.transform(d, add), F.lit(0).cast("bigint"), lambda s, x: s + x)


def card(token: Column, key: str, back: bool) -> Column:
    """Luhn-valid numbers; the first digit stays, the last is the new check digit."""
    def moved(d: Column) -> Column:
        inner = F.slice(d, 2, F.size(d) - 2)
        return F.concat(F.slice(d, 1, 1), feistel(inner, F.transform(inner, lambda _: F.lit(10).cast("bigint")), key,
                                                  F.concat(F.lit("card"), F.get(d, F.lit(0)).cast("string")), back))

    def sealed(body: Column) -> Column:
        return F.concat(body, F.array(F.pmod(10 - luhn_sum(F.concat(body, longs(0))), F.lit(10)).cast("bigint")))

    return let(digits(token), lambda d: F.when(luhn_sum(d) % 10 == 0, let(let(moved(d), sealed), lambda x: refill(token, "0-9", texts(x)))))


def ip(token: Column, key: str, back: bool) -> Column:
    """Four numbers up to 255 without leading zeros."""
    v = F.transform(F.split(token, r"\."), lambda c: c.cast("bigint"))
    fine = ~F.exists(v, lambda x: x > 255) & ~token.rlike(r"(^|\.)0\d")
    return F.when(fine, F.array_join(texts(feistel(v, F.transform(v, lambda _: F.lit(256).cast("bigint")), key, F.lit("ip"), back)), "."))


def ssn(token: Column, key: str, back: bool) -> Column:
    """Areas 001 to 899 without 666, groups and serials above zero."""
    area, group, serial = (F.get(F.split(token, "-"), F.lit(i)).cast("bigint") for i in range(3))
    v = longs(area - 1 - F.when(area > 666, 1).otherwise(0), group - 1, serial - 1)

    def shown(out: Column) -> Column:
        a, g, s = (F.get(out, F.lit(i)) + 1 for i in range(3))
        return F.concat_ws("-", F.lpad((a + F.when(a >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad(g.cast("string"), 2, "0"), F.lpad(s.cast("string"), 4, "0"))

    new = let(feistel(v, longs(898, 99, 9999), key, F.lit("ssn"), back), shown)
    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), new)


def date(token: Column, key: str, back: bool) -> Column:
    """Days of the calendar from 1800 to 2158, in any of three notations of one day."""
    form = {"-": "yyyy-MM-dd", "/": "MM/dd/yyyy", ".": "dd.MM.yyyy"}
    pattern = F.when(F.contains(token, F.lit("-")), form["-"]).when(F.contains(token, F.lit("/")), form["/"]).otherwise(form["."])
    day = F.datediff(F.try_to_timestamp(token, pattern).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("bigint")

    def moved(day: Column) -> Column:
        return feistel(longs(F.floor(day / DAY_BITS[1]), F.pmod(day, F.lit(DAY_BITS[1]))), longs(*DAY_BITS), key, F.lit("date"), back)

    def shown(v: Column) -> Column:
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.get(v, F.lit(0)) * DAY_BITS[1] + F.get(v, F.lit(1))).cast("int"))
        return F.when(F.contains(token, F.lit("-")), F.date_format(new, form["-"])).when(
            F.contains(token, F.lit("/")), F.date_format(new, form["/"])).otherwise(F.date_format(new, form["."]))

    return let(day, lambda d: F.when((d >= 0) & (d < DAY_BITS[0] * DAY_BITS[1]), let(moved(d), shown)))


def phone(token: Column, key: str, back: bool) -> Column:
    """Ten digits with or without +1, whose area and exchange start at 2; other numbers keep their first two digits."""
    def low(i: Column) -> Column:
        return F.when((i == 0) | (i == 3), 2).otherwise(0).cast("bigint")

    def near(d: Column, local: Column) -> Column:
        v, r = F.transform(local, lambda x, i: x - low(i)), F.transform(local, lambda x, i: 10 - low(i))
        moved = F.transform(feistel(v, r, key, F.lit("phone"), back), lambda x, i: x + low(i))
        return F.concat(F.slice(d, 1, F.size(d) - 10), moved)

    def far(d: Column) -> Column:
        head, rest = F.slice(d, 1, 2), F.slice(d, 3, F.size(d) - 2)
        return F.concat(head, feistel(rest, F.transform(rest, lambda _: F.lit(10).cast("bigint")), key,
                                      F.concat(F.lit("phone"), F.array_join(texts(head), "")), back))

    def made(d: Column) -> Column:
        n, plus = F.size(d), F.startswith(token, F.lit("+"))
        home = ((n == 10) & ~plus) | ((n == 11) & F.startswith(token, F.lit("+1")))
        ten = F.slice(d, -10, 10)
        fine = home & (F.get(ten, F.lit(0)) >= 2) & (F.get(ten, F.lit(3)) >= 2)
        return F.when(fine, let(ten, lambda t: near(d, t))).when(plus, far(d))

    return let(let(digits(token), made), lambda x: F.when(x.isNotNull(), refill(token, "0-9", texts(x))))


def email(token: Column, key: str, back: bool) -> Column:
    """Letters and digits of the name; the domain stays. Capitals stay capitals, and count as their small letters."""
    name, domain = F.substring_index(token, "@", 1), F.lower(F.substring_index(token, "@", -1))
    # Names of one shape are permuted among themselves.
    shape = F.regexp_replace(F.regexp_replace(F.lower(name), "[a-z]", "a"), "[0-9]", "0")

    def made(cs: Column) -> Column:
        v = F.transform(cs, lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(F.lower(c)) - 97).cast("bigint"))
        r = F.transform(cs, lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26).cast("bigint"))
        return F.transform(F.arrays_zip(cs.alias("c"), feistel(v, r, key, F.concat_ws("@", shape, domain), back).alias("x")), lambda p: F.when(
            p["c"].rlike("[0-9]"), p["x"].cast("string")).otherwise(F.char(p["x"] + F.when(p["c"].rlike("[A-Z]"), 65).otherwise(97))))

    new = let(F.regexp_extract_all(name, F.lit("([A-Za-z0-9])"), 1), lambda cs: F.when(F.size(cs) > 0, made(cs)))
    return let(new, lambda x: F.when(x.isNotNull(), F.concat(refill(name, "A-Za-z0-9", x), F.lit("@"), F.substring_index(token, "@", -1))))


MAKERS = {"email": email, "ip": ip, "date": date, "ssn": ssn, "card": card, "phone": phone}


def replaced(token: Column, key: str, back: bool = False) -> Column:
    """(text, n): what stands for a found token, itself where it is not valid, and the number of values replaced."""
    out = F
    for kind, maker in MAKERS.items():
        if kind != "card":
            out = out.when(token.rlike(rf"\A(?:{KINDS[kind]})\z"), counted(token, maker(token, key, back)))
    return out.otherwise(run(token, key, back))


def swapped(text: Column, pattern: str, new) -> Column:
    """(text, n): every match of ``pattern`` goes through ``new``, which gives its own (text, n)."""
    def joined(s: Column, made: Column) -> Column:
        parts = F.transform(s["between"], lambda p, i: F.concat(p, F.coalesce(F.get(made, i)["text"], F.lit(""))))
        return F.struct(F.array_join(parts, "").alias("text"), F.aggregate(made, F.lit(0).cast("bigint"), lambda n, m: n + m["n"]).alias("n"))

    both = F.struct(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1).alias("found"), F.split(text, pattern, -1).alias("between"))
    return let(both, lambda s: F.when(F.size(s["found"]) > 0, let(F.transform(s["found"], new), lambda made: joined(s, made)))
               .otherwise(F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("n"))))


def counted(token: Column, new: Column) -> Column:
    return let(new, lambda x: F.struct(F.coalesce(x, token).alias("text"), x.isNotNull().cast("bigint").alias("n")))


def cut_cards(groups: Column, form: str) -> Column:
    """Digit groups, each with the separator behind it, cut into stretches that are one card or hold none.

    From the left, the longest stretch of the form that passes the check digit.
    """
    def stretch(card: bool, part: Column) -> Column:
        return F.struct(F.lit(card).alias("card"), part.alias("groups"))

    def size(i: Column) -> Column:
        def fits(k: Column) -> Column:
            token = F.regexp_replace(F.array_join(F.slice(groups, i + 1, k), ""), "[ -]$", "")
            return let(token, lambda t: F.when(t.rlike(form), luhn_sum(digits(t)) % 10 == 0).otherwise(False))

        return F.get(F.filter(F.sequence(F.least(F.lit(19), F.size(groups) - i), F.lit(1), F.lit(-1)), fits), F.lit(0))

    def open_part(acc: Column, end: Column) -> Column:
        return F.filter(F.array(stretch(False, F.slice(groups, acc["free"] + 1, end - acc["free"]))), lambda x: F.size(x["groups"]) > 0)

    def step(acc: Column, i: Column) -> Column:
        def taken(k: Column) -> Column:
            return F.when(k.isNull(), acc).otherwise(F.struct(
                (i + k).alias("free"), F.concat(acc["out"], open_part(acc, i), F.array(stretch(True, F.slice(groups, i + 1, k)))).alias("out")))

        return F.when(i < acc["free"], acc).otherwise(let(size(i), taken))

    start = F.struct(F.lit(0).alias("free"), F.slice(F.array(stretch(False, groups)), 1, 0).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step, lambda acc: F.concat(acc["out"], open_part(acc, F.size(groups))))


def run(token: Column, key: str, back: bool) -> Column:
    """(text, n) of a run of digit groups: its cards, and the phones in what is left between them."""
    stretches = F.array(F.struct(F.lit(False).alias("card"), F.regexp_extract_all(token, F.lit("([0-9]+[ -]?)"), 1).alias("groups")))
    for form in CARD_FORMS:
        stretches = F.flatten(F.transform(stretches, lambda s: F.when(s["card"], F.array(s)).otherwise(cut_cards(s["groups"], form))))

    def new(s: Column) -> Column:
        def made(t: Column) -> Column:
            return F.when(s["card"], counted(t, card(t, key, back))).otherwise(
                swapped(t, KINDS["phone"], lambda p: counted(p, phone(p, key, back))))

        return let(F.array_join(s["groups"], ""), made)

    return let(F.transform(stretches, new), lambda out: F.struct(
        F.array_join(F.transform(out, lambda x: x["text"]), "").alias("text"), F.aggregate(out, F.lit(0).cast("bigint"), lambda n, x: n + x["n"]).alias("n")))


def pseudonymise(docs: DataFrame, key: str, back: bool = False, text_col: str = "text", count_col: str = "n_pii") -> DataFrame:
    """``docs`` with ``text_col`` rewritten and ``count_col``, the number of values replaced, added or overwritten.

    Null texts stay null with a count of 0; empty ones stay empty. Tokens that fail validation stay as they
    are. All other columns and rows pass through, repeated ones alike. Nothing is shuffled. ``back`` restores
    the values that the same key replaced.

    Among digit groups beside each other, a single group is preferred as a card to a printed form, and that to
    any other stretch of groups, so a card has one pseudonym beside whatever number. Stretches pass the check
    digit by chance one time in ten, and then count as cards. Where an invalid stretch overlaps a card of the
    same or a lower preference, the pseudonym may make it valid, and ``back`` takes it for the card.
    """
    text = F.col(f"`{text_col}`")
    hint = text.rlike("[0-9][ .)/-]?[0-9]|@")  # most texts hold nothing that could be found
    columns = [c for c in docs.columns if c not in (text_col, count_col)]

    new = F.when(hint, swapped(text, FOUND, lambda t: replaced(t, key, back)))
    done = docs.select(*[F.col(f"`{c}`") for c in columns], F.struct(text.alias("old"), new.alias("new")).alias(text_col))
    return done.select(*[
        F.coalesce(F.col(f"`{text_col}`.new.text"), F.col(f"`{text_col}`.old")).alias(c) if c == text_col
        else F.coalesce(F.col(f"`{text_col}`.new.n"), F.lit(0).cast("long")).alias(c) if c == count_col else F.col(f"`{c}`")
        for c in [*docs.columns, *[c for c in (count_col,) if c not in docs.columns]]])
