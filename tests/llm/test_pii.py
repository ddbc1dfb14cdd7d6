"""Pseudonyms against an independent writing of the network, and by their format."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from flowlens.llm import pii as P
from flowlens.llm.queries import PSEUDONYM_KEY, QUERIES

from .conftest import ODD

KEY = "secret"


def network(values, radices, key, tweak):
    left = (len(values) + 1) // 2
    halves, rs = [list(values[:left]), list(values[left:])], [radices[:left], radices[left:]]
    for turn in range(8):
        mine, other = turn % 2, 1 - turn % 2
        seed = "|".join([key, tweak, str(turn), ",".join(map(str, halves[other]))])
        halves[mine] = [(x + int(hashlib.sha256(f"{seed}#{i}".encode()).hexdigest()[:12], 16)) % rs[mine][i] for i, x in enumerate(halves[mine])]
    return halves[0] + halves[1]


def luhn(number):
    ds = [int(c) for c in number][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(ds)) % 10 == 0


def fill(token, symbols, slot):
    it = iter(symbols)
    return re.sub(f"[{slot}]", lambda _: str(next(it)), token)


def expected(kind, token, key):
    ds = [int(c) for c in re.findall(r"\d", token)]
    if kind == "card":
        if not luhn("".join(map(str, ds))):
            return None
        body = ds[:1] + network(ds[1:-1], [10] * (len(ds) - 2), key, f"card{ds[0]}")
        check = next(c for c in range(10) if luhn("".join(map(str, [*body, c]))))
        return fill(token, [*body, check], "0-9")
    if kind == "ip":
        v = token.split(".")
        if any(int(x) > 255 or (x[0] == "0" and len(x) > 1) for x in v):
            return None
        return ".".join(map(str, network([int(x) for x in v], [256] * 4, key, "ip")))
    if kind == "ssn":
        a, g, s = map(int, token.split("-"))
        areas = [x for x in range(1, 900) if x != 666]
        if a not in areas or not g or not s:
            return None
        a, g, s = network([areas.index(a), g - 1, s - 1], [898, 99, 9999], key, "ssn")
        return f"{areas[a]:03}-{g + 1:02}-{s + 1:04}"
    if kind == "date":
        form = {"-": "%Y-%m-%d", "/": "%m/%d/%Y", ".": "%d.%m.%Y"}[re.search(r"[-/.]", token).group()]
        try:
            day = (datetime.datetime.strptime(token, form).date() - datetime.date(1800, 1, 1)).days
        except ValueError:
            return None
        if not 0 <= day < 131_072:
            return None
        a, b = network([day // 512, day % 512], [256, 512], key, "date")
        d = datetime.date(1800, 1, 1) + datetime.timedelta(a * 512 + b)
        return {"-": f"{d.year:04}-{d.month:02}-{d.day:02}", "/": f"{d.month:02}/{d.day:02}/{d.year:04}", ".": f"{d.day:02}.{d.month:02}.{d.year:04}"}[re.search(r"[-/.]", token).group()]
    if kind == "phone":
        low = [2, 0, 0, 2] + [0] * 6
        ten = ds[-10:]
        home = len(ds) == 10 and token[0] != "+" or len(ds) == 11 and token.startswith("+1")
        if home and ten[0] >= 2 and ten[3] >= 2:
            out = network([x - y for x, y in zip(ten, low)], [10 - y for y in low], key, "phone")
            return fill(token, [*ds[:-10], *[x + y for x, y in zip(out, low)]], "0-9")
        if token[0] != "+":
            return None
        return fill(token, [*ds[:2], *network(ds[2:], [10] * (len(ds) - 2), key, f"phone{ds[0]}{ds[1]}")], "0-9")
    name, domain = token.split("@")
    cs = re.findall("[A-Za-z0-9]", name)
    if not cs:
        return None
    shape = re.sub("[0-9]", "0", re.sub("[a-z]", "a", name.lower()))
    out = network([int(c) if c.isdigit() else ord(c.lower()) - 97 for c in cs], [10 if c.isdigit() else 26 for c in cs], key, f"{shape}@{domain.lower()}")
    return fill(name, [str(x) if c.isdigit() else chr(x + (65 if c.isupper() else 97)) for c, x in zip(cs, out)], "A-Za-z0-9") + "@" + domain


def brute(text, key):
    n = 0

    def change(m):
        nonlocal n
        for kind, pattern in P.KINDS.items():
            if re.fullmatch(pattern, m.group()):
                new = expected(kind, m.group(), key)
                n += new is not None
                return m.group() if new is None else new
        return m.group()

    return re.sub(P.ANY, change, text, flags=re.ASCII) if text is not None else None, n


CASES = ["Mail bob.42@mail8.example.com or Bob.42@mail8.example.com, not bob@x or @x.com. a.b+c-d@x-y.co.uk _@x.org",
         "ip 42.144.35.254. and 300.1.1.1 and 1.2.3.4.5 v2.0.1 10.01.1.1 (0.0.0.0)", "card 4041894974608795, 4041-8949-7460-8795 4041 8949 7460 8795; bad 4041894974608796 379354508162306",
         "call +1 (988) 555-2485 or 988-555-2485 (988) 555-2485 +1.988.555.2485 188-555-2485 +49 30 1234567 +442071838750", "born 2020-02-29 02/29/2020 29.02.2020 not 2021-02-29 1799-12-31 31.12.2200 2020-13-01",
         "ssn 123-45-6789 666-12-1234 000-12-1234 899-99-9999 667-01-0001 900-12-1234", "é42.144.35.254ß x4041894974608795 4041894974608795é\n+1 (269) 555-3296 4524132264652876\t42.1.2.3@h.com",
         "4041894974608795" * 3, "1" * 5000 + " 12-34", "a@" * 3000, ".@" + "x." * 2000]


def test_same_as_definition(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id bigint, text string")
    out = {r["doc_id"]: (r["text"], r["n_pii"]) for r in P.pseudonymise(df, KEY).collect()}
    for i, text in enumerate(CASES):
        assert out[i] == brute(text, KEY), text
    back = P.pseudonymise(P.pseudonymise(df, KEY), KEY, back=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(CASES))
    assert out[0][1] >= 3 and out[2][1] == 4 and out[4][1] == 3 and out[5][1] == 3


def test_equal_values_stay_linked_and_keys_matter(spark):
    df = spark.createDataFrame([(1, "a 4041894974608795 b"), (2, "x 4041-8949-7460-8795."), (3, "+1 (988) 555-2485"), (4, "988-555-2485")], "doc_id int, text string")
    a, b, c, d = (re.sub(r"\D", "", r["text"]) for r in P.pseudonymise(df, KEY).orderBy("doc_id").collect())
    assert a == b and c == "1" + d and luhn(a) and a != "4041894974608795"
    assert P.pseudonymise(df, "other").first()["text"] != P.pseudonymise(df, KEY).first()["text"]


@pytest.mark.parametrize("radices", [[7], [3, 5], [2, 3, 4]])
def test_network_is_a_permutation(spark, radices):
    import itertools

    cells = list(itertools.product(*[range(r) for r in radices]))
    df = spark.createDataFrame([(list(c),) for c in cells], "v array<bigint>")
    out = df.select(P.feistel(F.col("v"), P.longs(*radices), KEY, F.lit("t")).alias("w"))
    assert sorted(tuple(r["w"]) for r in out.collect()) == cells
    same = df.select("v", P.feistel(P.feistel(F.col("v"), P.longs(*radices), KEY, F.lit("t")), P.longs(*radices), KEY, F.lit("t"), back=True).alias("w"))
    assert all(r["v"] == r["w"] for r in same.collect())


def test_query_equals_definition(spark, small, texts):
    rows = QUERIES["op3_pii_pseudonyms"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["text"], r["n_pii"]) == brute(texts[r["doc_id"]], PSEUDONYM_KEY)
    assert sum(r["n_pii"] for r in rows) > 50


def test_odd_rows_and_plan(odd, none):
    out = P.pseudonymise(odd, KEY)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, ODD))
    assert out.columns == [*odd.columns, "n_pii"] and P.pseudonymise(none, KEY).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan.replace("RoundRobinPartitioning", "").split("Project")[1]
    clash = odd.withColumnRenamed("node", "n_pii")
    assert P.pseudonymise(clash, KEY).columns == clash.columns


CARD, OTHER = "4111111111111111", "4041894974608795"


@pytest.mark.parametrize("text, cards", [
    ("card {} 123 ok", [CARD]), ("{} 12/26", ["4111 1111 1111 1111"]), ("pay 50 {} now", [CARD]), ("{} 123 {} 7", [CARD, "4041 8949 7460 8795"]),
    ("1 22 333 {} 4444 55", ["4111-1111-1111-1111"]), ("{} 12-34x", [CARD]), ("12 34 56 78 90 12 34 {} 9", ["4111 1111 1111 1111"]),
    ("50-{}-7", [CARD]), ("{}, 2 3 {}", [CARD, OTHER]), ("8 4111 111111111111 8", [])])
def test_cards_beside_numbers(spark, text, cards):
    # Patterns and order are written out here, apart from those of the module.
    old = text.format(*cards)
    row = P.pseudonymise(spark.createDataFrame([(old,)], "text string"), KEY).first()
    if not cards:  # no printed form, but the whole of it is found
        assert "4111 111111111111" not in row["text"] and row["n_pii"] == 1
        return
    shown = [expected("card", c, KEY) for c in cards]
    assert (row["text"], row["n_pii"]) == (text.format(*shown), len(cards))
    assert P.pseudonymise(spark.createDataFrame([(row["text"],)], "text string"), KEY, back=True).first()["text"] == old


def test_other_kinds_beside_numbers_and_iso_times(spark):
    cases = [("50 {} 4112", "ssn", "123-45-6789"), ("50 {} 41121", "date", "2020-02-29"), ("at {}T10:20:30Z", "date", "2020-02-29"),
             ("4111111111111112 {} 7", "phone", "988-555-2485"), ("12 {} 41111111", "phone", "988 555 2485")]
    df = spark.createDataFrame([(i, t.format(v)) for i, (t, _, v) in enumerate(cases)], "doc_id int, text string")
    for r in P.pseudonymise(df, KEY).collect():
        text, kind, value = cases[r["doc_id"]]
        assert (r["text"], r["n_pii"]) == (text.format(expected(kind, value, KEY)), 1)
