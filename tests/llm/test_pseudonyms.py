"""Pseudonyms against a second implementation in Python, and their properties."""

import datetime
import hashlib
import random
import re

import pytest

from taxalake.llm import pseudonyms

KEY = "testkey"


def number(*parts):
    return int(hashlib.sha256("|".join(map(str, (KEY, *parts))).encode()).hexdigest()[:12], 16)


def network(kind, a, b, mod_a, mod_b, size):
    for i in range(1, pseudonyms.ROUNDS + 1):
        if i % 2:
            a = (a + number(kind, size, i, b)) % mod_a
        else:
            b = (b + number(kind, size, i, a)) % mod_b
    return a, b


def digits(kind, d):
    u = len(d) // 2
    a, b = network(kind, int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u), len(d))
    return f"{a:0{u}}{b:0{len(d) - u}}"


def luhn(payload):
    total = sum((2 * x // 10 + 2 * x % 10) if i % 2 == 0 else x for i, x in enumerate(map(int, payload[::-1])))
    return str((10 - total % 10) % 10)


def fill(form, new):
    it = iter(new)
    return re.sub("[0-9]", lambda _: next(it), form)


def card(m):
    d = re.sub("[^0-9]", "", m)
    if luhn(d[:-1]) != d[-1]:
        return m
    p = digits("card", d[:-1])
    return fill(m, p + luhn(p))


def ip(m):
    o = list(map(int, m.split(".")))
    if max(o) > 255:
        return m
    a, b = network("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, 0)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def day(d):
    n = (d - datetime.date(1901, 1, 1)).days
    a, b = network("date", n // 673, n % 673, 108, 673, 0)
    return datetime.date(1901, 1, 1) + datetime.timedelta(a * 673 + b)


def run(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pseudonyms.apply(frame, KEY).collect()}


def test_cards_addresses_and_dates_match(spark):
    rng = random.Random(1)
    cards = []
    for _ in range(40):
        p = "".join(rng.choices("0123456789", k=rng.randint(12, 18)))
        cards.append(p + luhn(p) if rng.random() < 0.8 else p + str((int(luhn(p)) + 1) % 10))
    cards += ["4111 1111 1111 1111", "4111-1111-1111-1111"]
    ips = [".".join(str(rng.randint(0, 270)) for _ in range(4)) for _ in range(30)]
    days = [datetime.date(1901, 1, 1) + datetime.timedelta(rng.randrange(72684)) for _ in range(40)]
    got = run(spark, [f"No {c} here" for c in cards] + [f"at {x}, then" for x in ips] + [f"on {d:%Y-%m-%d} and {d:%d.%m.%Y}." for d in days])
    expected = [f"No {card(c)} here" for c in cards] + [f"at {ip(x)}, then" for x in ips]
    expected += [f"on {day(d):%Y-%m-%d} and {day(d):%d.%m.%Y}." for d in days]
    assert [got[i].text for i in range(len(expected))] == expected


@pytest.mark.parametrize(
    "text, form, kinds",
    [
        ("mail jane.doe34@mail7.example.com now", r"mail [a-z]{4}\.[a-z]{3}[0-9]{2}@mail7\.example\.com now", ["email"]),
        ("call +1 (017) 555-7713 or (415) 555-2671!", r"call \+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4} or \([0-9]{3}\) [0-9]{3}-[0-9]{4}!", ["phone", "phone"]),
        ("ssn 123-45-6789 x", r"ssn [0-9]{3}-[0-9]{2}-[0-9]{4} x", ["ssn"]),
        ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###', r'token = "[0-9a-f]{40}"###', ["secret"]),
        ("GB82WEST12345698765432", r"GB[0-9]{2}WEST[0-9]{14}", ["iban"]),
        ("5/13/2016 and 31/12/1999", r"[0-9]{1,2}/[0-9]{2}/[0-9]{4} and [0-9]{2}/[0-9]{2}/[0-9]{4}", ["date", "date"]),
        ("2016-02-30, 300.1.1.1, 1.2.3.4.5, GB83WEST12345698765432, 4111111111111112", None, []),
        ("v 1.2.3, 12:30, 3.5 %, year 1999, 12345", None, []),
    ],
)
def test_formats(spark, text, form, kinds):
    r = run(spark, [text])[0]
    assert list(r.kinds) == kinds and r.n_found == len(kinds)
    if form is None:
        assert r.text == text
    else:
        assert re.fullmatch(form, r.text) and r.text != text


def test_equal_values_stay_linked_and_different_ones_apart(spark):
    got = run(spark, ["4111 1111 1111 1111", "x 4111111111111111 y", "24be64439e3e49cf46b2d7c90f3602a3", "24BE64439E3E49CF46B2D7C90F3602A3"])
    assert re.sub("[^0-9]", "", got[0].text) == re.sub("[^0-9]", "", got[1].text)
    assert got[2].text.upper() == got[3].text
    texts = [f"{a}.{b}.7.9" for a in range(1, 30) for b in range(30)] + [f"u{i}@x.org" for i in range(900)] + [f"123-45-{i:04}" for i in range(900)]
    new = [r.text for r in run(spark, texts).values()]
    assert len(set(new)) == len(texts)


def test_iban_check_digits(spark):
    r = run(spark, ["DE89370400440532013000"])[0]
    moved = r.text[4:] + r.text[:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 and r.text != "DE89370400440532013000"


def test_edges(spark):
    rows = [(1, None, ["a"]), (2, "", None), (None, "call 415-555-2671", None), (3, "a1 " * 100_000 + "10.0.0.1", None), (3, "9" * 100_000, None), (4, "@" * 1000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kinds array<string>")
    got = pseudonyms.apply(frame, KEY).collect()
    assert got[0].text is None and got[0].n_found == 0 and got[1].text == "" and list(got[2].kinds) == ["phone"]
    assert got[3].text.startswith("a1 a1") and got[3].n_found == 1 and got[4].text == "9" * 100_000 and got[5].n_found == 0
    assert pseudonyms.apply(frame.limit(0), KEY).count() == 0
    plan = pseudonyms.apply(frame, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    with pytest.raises(ValueError):
        pseudonyms.apply(frame, "it's")
