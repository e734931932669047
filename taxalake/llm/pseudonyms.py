"""Personal data: format-preserving Feistel pseudonyms.

Validated numbers (payment cards by Luhn's check, IBANs by modulo 97, IPv4 addresses by
their octets, phone and social-security numbers by their shape), calendar dates, e-mail
local parts and hexadecimal secrets are found in the text and replaced by another value
of the same format: a keyed permutation of the values of that format, so that equal
values stay equal in all documents and different ones stay different.

Numbers go through an 8-round Feistel network of two halves, each round adding a
SHA-256 value of the key, the kind, the length, the round and the other half. Check
digits are computed anew. Dates are permuted among the days of 1901 to 2099, however
they are written. Letters and digits of e-mails and secrets are changed one at a
time as a function of all others, twice over (an unbalanced Feistel network).

Everything is SQL expressions inside the engine; texts without a digit are not searched.

Results by case
    null text: null, nothing found; empty text: empty; a candidate that fails its check
    (no valid card, octet over 255, 30 February) stays as it is;
    where kinds overlap, the match that begins first counts, then the order of KINDS;
    repeated rows: each is treated, alike; other columns have no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: kind and pattern, in the order in which they are tried at a place
KINDS = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "secret": r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,64}(?![A-Za-z0-9])",
    "year_first": r"(?<![0-9./-])[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?![0-9])",
    "year_last": r"(?<![0-9./-])[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])"
    r"|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
PATTERN = "|".join(KINDS.values())
ROUNDS = 8
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: 1901-01-01 to 2099-12-31 are 72,684 days = 108 * 673, so a day is one of 108 and one of 673
_DAYS = (108, 673)


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` in which ``name`` stands for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _hash(key: str, *parts: str) -> str:
    return f"CAST(conv(substr(sha2(concat_ws('|', {key}, {', '.join(f'CAST({p} AS STRING)' for p in parts)}), 256), 1, 12), 16, 10) AS BIGINT)"


def _network(key: str, kind: str, a: str, b: str, mod_a: str, mod_b: str, size: str, finish: str) -> str:
    """Feistel rounds over a pair (a below mod_a, b below mod_b); ``finish`` uses s.a and s.b."""
    left = f"named_struct('a', pmod(s.a + {_hash(key, f"'{kind}'", size, 'i', 's.b')}, {mod_a}), 'b', s.b)"
    right = f"named_struct('a', s.a, 'b', pmod(s.b + {_hash(key, f"'{kind}'", size, 'i', 's.a')}, {mod_b}))"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', {a}, 'b', {b}), "
        f"(s, i) -> IF(i % 2 = 1, {left}, {right}), s -> {finish})"
    )


def _permuted_digits(key: str, kind: str, digits: str) -> str:
    """Another string of as many digits (4 to 36)."""
    u, n = "CAST(length(d) div 2 AS INT)", "length(d)"
    power = lambda k: f"CAST(pow(10, {k}) AS BIGINT)"
    finish = f"concat(lpad(CAST(s.a AS STRING), {u}, '0'), lpad(CAST(s.b AS STRING), {n} - {u}, '0'))"
    body = _network(
        key, kind, f"CAST(substr(d, 1, {u}) AS BIGINT)", f"CAST(substr(d, {u} + 1) AS BIGINT)",
        power(u), power(f"({n} - {u})"), n, finish,
    )
    return _let("d", digits, body)


def _filled(form: str, digits: str) -> str:
    """``form`` with its digits replaced, in order, by ``digits``."""
    step = (
        "IF(substr(f, p, 1) BETWEEN '0' AND '9', named_struct('o', concat(t.o, substr(g, t.k, 1)), 'k', t.k + 1), "
        "named_struct('o', concat(t.o, substr(f, p, 1)), 'k', t.k))"
    )
    body = f"aggregate(sequence(1, length(f)), named_struct('o', CAST('' AS STRING), 'k', 1), (t, p) -> {step}, t -> t.o)"
    return _let("f", form, _let("g", digits, body))


def _only_digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn_digit(payload: str) -> str:
    """The digit that completes ``payload``."""
    x = "CAST(substr(w, length(w) - j, 1) AS INT)"
    add = f"IF(j % 2 = 0, (2 * {x}) div 10 + (2 * {x}) % 10, {x})"
    total = f"aggregate(sequence(0, length(w) - 1), 0, (z, j) -> CAST(z + {add} AS INT))"
    return _let("w", payload, f"CAST((10 - {total} % 10) % 10 AS STRING)")


def _card(m: str, key: str) -> str:
    payload = "substr(c, 1, length(c) - 1)"
    moved = _let("q", _permuted_digits(key, "card", payload), f"concat(q, {_luhn_digit('q')})")
    valid = f"{_luhn_digit(payload)} = right(c, 1)"
    return _let("c", _only_digits(m), f"IF({valid}, {_filled(m, moved)}, {m})")


def _iban_rest(text: str) -> str:
    """``text`` (letters as 10 to 35) modulo 97."""
    step = (
        "IF(v BETWEEN '0' AND '9', CAST((z * 10 + ascii(v) - 48) % 97 AS INT), CAST((z * 100 + ascii(v) - 55) % 97 AS INT))"
    )
    return f"aggregate(split({text}, ''), 0, (z, v) -> IF(v = '', z, {step}))"


def _iban(m: str, key: str) -> str:
    digits = f"regexp_replace(substr({m}, 5), '[^0-9]', '')"
    account = _filled(f"substr({m}, 5)", _permuted_digits(key, "iban", digits))
    check = f"lpad(CAST(98 - {_iban_rest(f"concat(h, substr({m}, 1, 2), '00')")} AS STRING), 2, '0')"
    moved = _let("h", account, f"concat(substr({m}, 1, 2), {check}, h)")
    valid = f"{_iban_rest(f'concat(substr({m}, 5), substr({m}, 1, 4))')} = 1 AND length({digits}) BETWEEN 4 AND 30"
    return f"IF({valid}, {moved}, {m})"


def _date(m: str, key: str, year_first: bool) -> str:
    """Months and days are told apart as day-month unless only month-day is a date, with
    a slash the other way round; the written order, separators and widths are kept."""
    part = lambda k: f"element_at(split({m}, '[-/.]'), {k})"
    day = lambda y, mo, d: f"try_cast(concat_ws('-', lpad({y}, 4, '0'), lpad({mo}, 2, '0'), lpad({d}, 2, '0')) AS DATE)"
    if year_first:
        order, value = "'ymd'", day(part(1), part(2), part(3))
        known = f"array(named_struct('o', {order}, 'd', {value}))"
    else:
        dm, md = day(part(3), part(2), part(1)), day(part(3), part(1), part(2))
        first = f"IF(locate('/', {m}) > 0, coalesce(named_struct('o', IF({md} IS NULL, NULL, 'mdy'), 'd', {md})), named_struct('o', IF({dm} IS NULL, NULL, 'dmy'), 'd', {dm}))"
        other = f"IF(locate('/', {m}) > 0, named_struct('o', 'dmy', 'd', {dm}), named_struct('o', 'mdy', 'd', {md}))"
        known = f"array(IF({first}.d IS NOT NULL, {first}, {other}))"
    a, b = _DAYS
    day_no = "datediff(e.d, DATE'1901-01-01')"
    moved_day = _network(
        key, "date", f"CAST({day_no} div {b} AS BIGINT)", f"CAST({day_no} % {b} AS BIGINT)", str(a), str(b), "0",
        f"date_add(DATE'1901-01-01', CAST(s.a * {b} + s.b AS INT))",
    )
    put = lambda unit, k: f"lpad(CAST({unit}(n) AS STRING), greatest(length({part(k)}), length(CAST({unit}(n) AS STRING))), '0')"
    mark = f"regexp_extract({m}, '[0-9]+([-/.])[0-9]+([-/.])', 1)", f"regexp_extract({m}, '[0-9]+([-/.])[0-9]+([-/.])', 2)"
    if year_first:
        written = f"concat({put('year', 1)}, {mark[0]}, {put('month', 2)}, {mark[1]}, {put('day', 3)})"
    else:
        written = (
            f"IF(e.o = 'dmy', concat({put('day', 1)}, {mark[0]}, {put('month', 2)}, {mark[1]}, {put('year', 3)}), "
            f"concat({put('month', 1)}, {mark[0]}, {put('day', 2)}, {mark[1]}, {put('year', 3)}))"
        )
    body = f"IF(e.d BETWEEN DATE'1901-01-01' AND DATE'2099-12-31', {_let('n', moved_day, written)}, {m})"
    return f"element_at(transform({known}, e -> {body}), 1)"


def _ip(m: str, key: str) -> str:
    octet = lambda k: f"CAST(element_at(split({m}, '[.]'), {k}) AS BIGINT)"
    finish = "concat_ws('.', s.a div 256, s.a % 256, s.b div 256, s.b % 256)"
    moved = _network(
        key, "ip", f"{octet(1)} * 256 + {octet(2)}", f"{octet(3)} * 256 + {octet(4)}", "65536", "65536", "0", finish
    )
    return f"IF(greatest({octet(1)}, {octet(2)}, {octet(3)}, {octet(4)}) <= 255, {moved}, {m})"


def _phone(m: str, key: str) -> str:
    country = f"regexp_extract({m}, '^([+][0-9]{{1,3}}(?=[ .(-]))?', 0)"
    return _let(
        "r", f"substr({m}, length({country}) + 1)",
        f"IF(length({_only_digits(m)}) BETWEEN 8 AND 15 AND length({_only_digits('r')}) >= 4, "
        f"concat({country}, {_filled('r', _permuted_digits(key, 'phone', _only_digits('r')))}), {m})",
    )


def _permuted_text(key: str, kind: str, text: str, alphabets: tuple[str, ...]) -> str:
    """Another text whose characters come from the same alphabets, place by place."""
    c, p = "substr(s, p, 1)", "CAST((i % length(y)) + 1 AS INT)"
    rest = "concat(substr(s, 1, p - 1), '*', substr(s, p + 1))"
    new = c
    for alphabet in alphabets:
        moved = f"substr('{alphabet}', CAST(1 + pmod(locate({c}, '{alphabet}') - 1 + {_hash(key, f"'{kind}'", 'i', rest)}, {len(alphabet)}) AS INT), 1)"
        new = f"IF(locate({c}, '{alphabet}') > 0, {moved}, {new})"
    step = _let("p", p, f"concat(substr(s, 1, p - 1), {new}, substr(s, p + 1))")
    return _let("y", text, f"aggregate(sequence(0, 3 * length(y) - 1), y, (s, i) -> {step})")


def _email(m: str, key: str) -> str:
    local = _permuted_text(key, "email", f"substring_index({m}, '@', 1)", (_DIGITS, _LOWER, _UPPER))
    return f"concat({local}, '@', substring_index({m}, '@', -1))"


def _secret(m: str, key: str) -> str:
    """The same value in capitals and small letters stays the same value."""
    moved = _permuted_text(key, "secret", f"lower({m})", ("0123456789abcdef",))
    mixed = _permuted_text(key, "secret", m, (_DIGITS, "abcdef", "ABCDEF"))
    return f"IF({m} = lower({m}), {moved}, IF({m} = upper({m}), upper({moved}), {mixed}))"


def _quoted(pattern: str) -> str:
    return "r'^(?:" + pattern.replace("'", "\\'") + ")$'"


def _replacement(m: str, key: str) -> str:
    """SQL for kind and pseudonym of the match ``m``."""
    digits = f"IF(length({_only_digits(m)}) >= 4, {{}}, {m})"
    made = {
        "iban": _iban(m, key), "email": _email(m, key), "secret": _secret(m, key), "year_first": _date(m, key, True),
        "year_last": _date(m, key, False), "ip": _ip(m, key),
        "ssn": digits.format(_filled(m, _permuted_digits(key, "ssn", _only_digits(m)))), "card": _card(m, key),
        "phone": _phone(m, key),
    }
    kind = " ".join(f"WHEN {m} RLIKE {_quoted(p)} THEN '{k}'" for k, p in KINDS.items())
    value = " ".join(f"WHEN k = '{k}' THEN {made[k]}" for k in KINDS)
    body = f"named_struct('kind', IF(k LIKE 'year%', 'date', k), 'value', CASE {value} ELSE {m} END)"
    return _let("k", f"CASE {kind} END", body)


def apply(docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, text (with pseudonyms), kinds (array, in order) and n_found for every row."""
    searched = F.when(F.col("text").rlike("[0-9@]"), F.col("text"))
    rows = docs.select(F.col(id_col), F.col(text).alias("text"))
    rows = rows.withColumn("matches", F.regexp_extract_all(searched, F.lit(PATTERN), F.lit(0)))
    rows = rows.withColumn("parts", F.when(F.size("matches") > 0, F.split("text", PATTERN, -1)))
    made = F.expr(f"transform(matches, m -> {_replacement('m', _literal(key))})")
    rows = rows.withColumn("made", F.when(F.size("matches") > 0, made))
    woven = F.expr("array_join(zip_with(parts, made, (p, r) -> concat(p, coalesce(r.value, ''))), '')")
    changed = F.expr("transform(filter(zip_with(made, matches, (r, m) -> named_struct('kind', r.kind, 'new', r.value <> m)), r -> r.new), r -> r.kind)")
    kinds = F.coalesce(changed, F.array().cast("array<string>"))
    return rows.select(
        F.col(id_col),
        F.when(F.size("matches") > 0, woven).otherwise(F.col("text")).alias("text"),
        kinds.alias("kinds"),
        F.size(kinds).alias("n_found"),
    )


def _literal(key: str) -> str:
    if not key.isalnum():
        raise ValueError("the key must consist of letters and digits")
    return f"'{key}'"
