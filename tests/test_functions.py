"""The scalar functions against plain versions, on values printed in many ways and on strings of no sense."""

import random
import re
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from docledger.functions import dates, fuzzy, money, risk, text

RNG = random.Random(20)
WORDS = ("Bram", "Okto", "Vela", "Tuin", "Quarz", "Nimb")


def applied(spark, values, *columns):
    frame = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], "i int, a string" + (", b string" if isinstance(values[0], tuple) else ""))
    return [tuple(r)[1:] for r in frame.select("i", *columns).orderBy("i").collect()]


def plain_number(shown, places):
    """Reads a number character by character, as the rules say."""
    bare = "".join(w for w in re.findall(r"\w+|\W", shown) if w.lower() not in text.CODES)
    bare = "".join(c for c in bare if c not in text.MARKS and c != "'" and not c.isspace())
    if not any(c.isdigit() for c in bare):
        return None
    negative = (bare[0] == "(" and bare[-1] == ")") or "-" in (bare[0], bare[-1]) or bare.lower().endswith("cr")
    plain = "".join(c for c in bare if c.isdigit() or c in ".,")
    kinds = {c for c in plain if c in ".,"}
    last = max(plain.rfind("."), plain.rfind(","))
    whole = last < 0 or (len(kinds) == 1 and plain[0] in "123456789" and len(plain) - last == 4)
    digits = "".join(c for c in plain if c.isdigit()) if whole else "".join(c for c in plain[:last] if c.isdigit()) + "." + plain[last + 1 :]
    value = Decimal(f"0{digits}".rstrip(".")).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)
    if value.adjusted() >= 18 - places:
        return None
    return -value if negative and value else value


def grouped(whole, mark, indian):
    head, tail = str(whole)[:-3], str(whole)[-3:]
    size = 2 if indian else 3
    while head:
        tail, head = head[-size:] + mark + tail, head[:-size]
    return tail


def amounts():
    """Amounts as they may be printed, with their values."""
    for _ in range(300):
        cents = RNG.choice([RNG.randrange(100, 10_000), RNG.randrange(10**9), RNG.randrange(10**12)])
        mark, point = RNG.choice([(",", "."), (".", ","), ("'", "."), (" ", ","), ("\u00a0", ","), ("", "."), ("", ",")])
        shown = grouped(cents // 100, mark, mark == "," and RNG.random() < 0.3) + f"{point}{cents % 100:02}"
        form, sign = RNG.choice([("{}", 1), ("$ {}", 1), ("{} €", 1), ("{} chf", 1), ("GBP {}", 1), ("({})", -1), ("-{}", -1), ("{}-", -1), ("{} CR", -1), ("£-{}", -1), ("(¥{})", -1)])
        yield form.format(shown), sign * Decimal(cents) / 100


NOISE = ["".join(RNG.choice("0123456789012345,.-()' $€%crUSDx\u00a0") for _ in range(RNG.randrange(12))) for _ in range(600)]


def test_money(spark):
    shown, values = zip(*amounts(), strict=True)
    assert [x for (x,) in applied(spark, list(shown), money.parse_money(F.col("a")))] == list(values)
    assert [plain_number(x, 2) for x in shown] == list(values)
    for function, places in ((money.parse_money, 2), (money.parse_decimal, 4)):
        assert [x for (x,) in applied(spark, NOISE, function(F.col("a")))] == [plain_number(x, places) for x in NOISE]


def test_cents(spark):
    pairs = [(Decimal(RNG.randrange(-(10**6), 10**8)) / 10**4, Decimal(RNG.randrange(10**8)) / 10**4) for _ in range(200)]
    got = applied(spark, [(str(a), str(b)) for a, b in pairs], money.times(F.col("a").cast("decimal(18,4)"), F.col("b").cast("decimal(18,4)")))
    assert [x for (x,) in got] == [(a * b).quantize(Decimal("0.01"), ROUND_HALF_UP) for a, b in pairs]
    cents = [RNG.randrange(-(10**10), 10**10) for _ in range(50)]
    assert [x for (x,) in applied(spark, [str(Decimal(c) / 100) for c in cents], money.to_cents(F.col("a").cast("decimal(18,2)")))] == cents


def plain_swaps(shown):
    out = {shown[:i] + shown[i + 1] + shown[i] + shown[i + 2 :] for i in range(len(shown) - 1) if shown[i : i + 2].isdigit() and shown[i] != shown[i + 1]}
    return {x for x in out if not re.match(r"-?0\d", x)}


def test_swaps(spark):
    shown = ["", "8", "40.00", *(str(Decimal(RNG.randrange(-(10**6), 10**7)) / 100) for _ in range(150))]
    assert [set(x) for (x,) in applied(spark, shown, money.digit_swaps(F.col("a")))] == [plain_swaps(x) for x in shown]
    pairs = [(a, RNG.choice([*sorted(plain_swaps(a)), a, a + "1"])) for a in shown[3:]]
    assert [x for (x,) in applied(spark, pairs, money.is_digit_swap(F.col("a"), F.col("b")))] == [b in plain_swaps(a) for a, b in pairs]


def plain_date(shown, month_first=False):
    """Reads a date piece by piece, as the rules say."""
    words = re.sub(r"(\d)(st|nd|rd|th)\b", r"\1", shown, flags=re.IGNORECASE).replace(",", " ").split()
    pieces = re.split("[-/. ]", " ".join(words))
    kinds = "".join("Y" if re.fullmatch(r"\d{4}", p) else "n" if re.fullmatch(r"\d\d?", p) else "w" if re.fullmatch("[A-Za-z]+", p) else "?" for p in pieces)
    numbers = [int(p) if p.isdigit() and p.isascii() else dates.MONTHS.get(p.lower(), 0) for p in pieces]
    if kinds in ("wnY", "nwY") and len(words) == 3:
        year, month, day = numbers[2], numbers[kinds.index("w")], numbers[kinds.index("n")]
    elif kinds == "Ynn" and len(words) == 1:
        year, month, day = numbers
    elif kinds == "nnY" and len(words) == 1:
        one, two, year = numbers
        month, day = (one, two) if two > 12 or (month_first and one <= 12) else (two, one)
    else:
        return None
    try:
        return date(year, month, day) if 1900 <= year <= 2200 else None
    except ValueError:
        return None


def test_dates(spark):
    forms, want = [], []
    for _ in range(300):
        day = date(1900, 1, 1) + timedelta(days=RNG.randrange(109_000))
        name = RNG.choice([n for n, m in dates.MONTHS.items() if m == day.month])
        ending = RNG.choice(["", "", {1: "st", 2: "nd", 3: "rd"}.get(day.day % 10 if day.day not in (11, 12, 13) else 0, "th")])
        mark = RNG.choice("-/.")
        forms.append(RNG.choice([f"{name.title()} {day.day}{ending}, {day.year}", f"{day.day}{ending} {name.upper()} {day.year}", f" {name}  {day.day:02} {day.year}", f"{day.year}{mark}{day.month}{mark}{day.day:02}", f"{day.day:02}{mark}{day.month:02}{mark}{day.year}"]))
        want.append(day)
    assert [x for (x,) in applied(spark, forms, dates.parse_date(F.col("a")))] == want == [plain_date(x) for x in forms]
    parts = ["7", "07", "19", "31", "1904", "2031", "1899", "2201", "26", "june", "Mar", "Foo", "4th", "x", "²"]
    noise = ["".join(RNG.choice(["", *"-/. ,", ", ", "\t"]) + RNG.choice(parts) for _ in range(RNG.choice([1, 2, 3, 3, 3, 3, 4]))) + RNG.choice(["", "", " ", ",", "."]) for _ in range(1500)]
    noise += [RNG.choice([" ", "-", "/", "."]).join(RNG.sample(parts, 3)) for _ in range(1500)]
    got = applied(spark, noise, dates.parse_date(F.col("a")), dates.parse_date(F.col("a"), True))
    assert got == [(plain_date(x), plain_date(x, True)) for x in noise] and sum(a is not None for a, _ in got) > 20
    assert applied(spark, ["2031-04-31", "2032-02-29", "20320229"], dates.is_iso_date(F.col("a")), dates.draft_date(F.col("a"))) == [(False, None), (True, date(2032, 2, 29)), (False, None)]
    assert applied(spark, [("9 Mar 1904", "1904-03-09"), ("9 Mar 1904", "1904-09-03"), ("x", "x")], dates.date_equals(F.col("a"), F.col("b"))) == [(True,), (False,), (False,)]


def vendor_names():
    for _ in range(80):
        words = RNG.sample(WORDS, RNG.randint(1, 3))
        forms = RNG.sample(text.LEGAL_FORMS, RNG.randint(0, 2))
        gap = RNG.choice([" ", ", ", " - ", "  "])
        yield gap.join([*(RNG.choice([w, w.upper(), w.lower()]) for w in words), *(RNG.choice([f"{f.upper()}.", f.title(), f]) for f in forms)]), " ".join(words).lower()


@pytest.mark.parametrize(
    ("function", "vectors"),
    [
        (text.vendor_key, dict(vendor_names()) | {"GmbH": "gmbh", "O. Ltd": "o"}),
        (text.is_money_shaped, {"8,405.10": True, "3,071": True, "£62": True, "1987": False, "308": False, "7,5%": False, "Netto": False, "12.50 each": True, "a.bc": False}),
        (text.normalize_text, {"4.305,20": "4305.20", "2,06,315.00": "206315.00", "£62.9": "62.90", "308": "308", "7%": "7", "Vela.": "vela", "QT-88/b": "qt 88 b", "¥": "", "CHF": "chf", "Größe": "größe"}),
        (text.normalize_words, {"chf\t 8,405.10  Netto!": "chf 8405.10 netto", " € ": ""}),
        (text.fuzzy_key, {"GBP 8,405.10": "8,405.10", "Vela Tuin": "velatuin", "Eurocode €5": "eurocode5"}),
        (text.sanitize_filename, {"a/b\\..\\scan 7.PNG": "scan 7.PNG", "x/y/": "document", "no\u0007te\t.pdf": "note.pdf", "": "document"}),
        (text.trim_zeros, {"62.9000": "62.9", "4100": "4100", "8.0": "8", "0.0100": "0.01"}),
        (lambda c: text.list_words(F.split(c, ";")), {"u": "u", "u;v": "u and v", "u;v;w;x": "u, v, w and x"}),
        (risk.criticality, {"tax": 1.0, "lineItems.12.unitPrice": 1.0, "dueDate": 0.8, "lineItems.4.description": 0.5}),
        (lambda c: risk.backoff_seconds(c.cast("int")), {"1": 30, "2": 60, "4": 240, "0": 30}),
        (lambda c: F.round(text.contrast_ratio(c, F.lit("#000000")), 2), {"#000000": 1.0, "#ffffff": 21.0}),
    ],
)
def test_text(spark, function, vectors):
    assert [x for (x,) in applied(spark, list(vectors), function(F.col("a")))] == list(vectors.values())


def test_long_filename(spark):
    ((got,),) = applied(spark, ["x" * 300 + ".pdf"], text.sanitize_filename(F.col("a")))
    assert len(got) == 120 and got.endswith(".pdf")


def test_fuzzy(spark):
    pairs = [("".join(RNG.choice("uvwé\U0001f600") for _ in range(RNG.randrange(9))), "".join(RNG.choice("uvwé\U0001f600") for _ in range(RNG.randrange(9)))) for _ in range(2000)]
    pairs += [("vw" * 60, "wv" * 61), ("", ""), ("wu", "uvw")]
    want = [plain_osa(*p) for p in pairs]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").withColumn("batch", fuzzy.osa_distance("a", "b"))
    got = frame.select("i", "batch", fuzzy.osa_column(F.col("a"), F.col("b")).alias("fold")).orderBy("i").collect()
    assert [r.batch for r in got] == want == [r.fold for r in got]
    assert applied(spark, [("vwuv", "vwvu"), ("", ""), ("uv", "wx")], fuzzy.similarity(F.col("a"), F.col("b"))) == [(0.75,), (1.0,), (0.0,)]
    missing = spark.createDataFrame([("u", None), (None, None), ("u", "v")], "a string, b string").select(fuzzy.osa_distance("a", "b"))
    assert [x for (x,) in missing.collect()] == [None, None, 1]


def test_fuzzy_many():
    """A hundred thousand pairs, in batches as they come."""
    words = ["".join(RNG.choice("stuvw") for _ in range(RNG.randrange(14))) for _ in range(400)]
    pairs = [(RNG.choice(words), RNG.choice(words)) for _ in range(100_000)]
    known = {p: plain_osa(*p) for p in set(pairs[:20_000])}
    got = fuzzy.osa_batch([a for a, _ in pairs], [b for _, b in pairs])
    assert all(known[p] == d for p, d in zip(pairs, got.tolist(), strict=True) if p in known)
    assert fuzzy.osa_batch([b for _, b in pairs], [a for a, _ in pairs]).tolist() == got.tolist()  # it is symmetric


def plain_osa(a, b):
    table = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                table[i, j] = min(table[i, j], table[i - 2, j - 2] + 1)
    return table[len(a) - 1, len(b) - 1]


def test_risk(spark):
    cases = [(1.0, 0, 0, 0.95, 1.0), (0.0, 0, 0, 1.0, 1.0), (1.0, 1, 0, 1.0, 1.0), (1.0, 0, 5, 1.0, 1.0), (1.0, 0, 5, 1.0, 0.5)]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, g double, b int, w int, c double, k double")
    value = risk.risk(F.col("g"), F.col("b"), F.col("w"), F.col("c"), F.col("k"))
    assert [r[0] for r in frame.orderBy("i").select(risk.risk_band(value)).collect()] == ["low", "high", "high", "high", "medium"]
    cost = risk.cost_micros(F.col("m"), F.lit(1000), F.lit(500), F.lit(2000), F.lit(10000))
    assert [r[0] for r in spark.createDataFrame([("some-model",), ("mock",)], "m string").select(cost).collect()] == [14000, 0]


def test_with_money(spark):
    """Amounts read step by step are those that the function reads, and null where the condition does not hold."""
    texts = ["1,234.56", "1.234,56 €", "(12.50)", "USD 1,000-", "1.234", "0.123", "12.", ".5", "1,2,3", "-7 CR", "-7,5-", "", ".,", "€", "x", None, "9" * 17 + ".5", "1'234.50", "12 345,6", "1,234.567", "12,345", "01,234", "10.00\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("u", money.parse_money(F.col("t")))
    got = money.with_money(rows, "t", F.col("i") % 2 == 0, "even")
    got = money.with_money(got, "t", F.lit(True), "every").collect()
    assert got[0].asDict().keys() == {"i", "t", "u", "even", "every"}
    assert [r.every for r in got] == [r.u for r in got] and [r.even for r in got] == [r.u if r.i % 2 == 0 else None for r in got]
    assert sum(r.u is not None for r in got) > 12


def test_printed_makes_one_form(spark):
    """only the form that is asked for is made, and it is the one of its style."""
    from docledger.plans.function_queries import printed

    rows = spark.createDataFrame([(123456789, i) for i in range(7)], "cents long, style int").select("style", printed(F.col("cents"), F.col("style")).alias("shown"))
    assert "element_at" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [r.shown for r in rows.orderBy("style").collect()] == ["1,234,567.89", "1.234.567,89", "1 234 567,89", "$1,234,567.89", "1.234.567,89 €", "(1,234,567.89)", "USD 1,234,567.89-"]
