"""Format-preserving pseudonyms of personal numbers, dates and addresses, with Spark's own functions only.

A candidate found by pattern is changed only if it is valid: Luhn for cards, octets of addresses, calendar dates, ranges of
social security numbers, digit counts of phones. A keyed Feistel network then permutes it within its own format, so equal values stay equal across
documents, different ones stay different, and the result is valid again:

* cards: the first digit stays, the others are permuted, the check digit is computed anew; spaces and hyphens stay where they are and do not count, so a
  number has one pseudonym however it is written;
* dates from 1900 to 2099: the day number, as a pair modulo 17 and 4297; IPv4: two 16-bit halves; social security numbers: area and rest;
* phones: digits after the country code, whatever stands between them; e-mail: letters and digits before the last dot, each within its kind.

The round function is SHA-256 over key, kind, round and the other half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ipv4": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])",
    "date": r"(?<![\w-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w-])|(?<![\w.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?!\w)|(?<![\w/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![\w/])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?!\w)|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?!\w)|(?<![\w-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w-])",
    "card": r"(?<!\w)[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?!\w)|(?<!\w)[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}(?!\w)|(?<!\w)[0-9]{13,19}(?!\w)",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
PHONE = "m RLIKE '^([+(]|[0-9]{3}-[0-9]{3}-[0-9]{4}$)'"
ROUNDS = 10


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(key: str, kind: str, i: str, other: str) -> str:
    return f"CAST(conv(substr(sha2(concat_ws('|', {key}, '{kind}', {i}, {other}), 256), 1, 12), 16, 10) AS BIGINT)"


def _pair(key: str, kind: str, left: str, right: str, m_left: int, m_right: int) -> str:
    """Struct (l, r) of the permuted pair, l below m_left and r below m_right."""
    return (f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', CAST({left} AS BIGINT), 'r', CAST({right} AS BIGINT)), (s, i) -> named_struct("
            f"'l', if(i % 2 = 0, (s.l + {_number(key, kind, 'i', 's.r')}) % {m_left}, s.l), "
            f"'r', if(i % 2 = 1, (s.r + {_number(key, kind, 'i', 's.l')}) % {m_right}, s.r)))")


def _shifted(key: str, kind: str, half: str, other: str) -> str:
    """``half`` with each digit and letter moved within its kind by a key stream from the other half."""
    move = (f"CAST(conv(substr(sha2(concat_ws('|', {key}, '{kind}', i, {other}, j DIV 15), 256), 1 + 4 * (j % 15), 4), 16, 10) AS INT)")
    c = f"ascii(substr({half}, j, 1))"
    kinds = " ".join(f"WHEN {c} BETWEEN {a} AND {a + n - 1} THEN char({a} + ({c} - {a} + {move}) % {n})" for a, n in ((48, 10), (97, 26), (65, 26)))
    return (f"if(length({half}) = 0, {half}, array_join(transform(sequence(1, greatest(length({half}), 1)), "
            f"j -> CASE {kinds} ELSE substr({half}, j, 1) END), ''))")


def _shape(key: str, kind: str, text: str) -> str:
    """The string permuted among those of the same shape (digit, small and capital letter at the same places)."""
    cut = f"length({text}) DIV 2"
    return (f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', substr({text}, 1, {cut}), 'r', substr({text}, {cut} + 1)), (s, i) -> named_struct("
            f"'l', if(i % 2 = 0, {_shifted(key, kind, 's.l', 's.r')}, s.l), 'r', if(i % 2 = 1, {_shifted(key, kind, 's.r', 's.l')}, s.r)), "
            "s -> concat(s.l, s.r))")


def _dressed(digits: str) -> str:
    """The match m with its digits replaced, in order, by those of the expression; everything else stays where it is."""
    nth = "length(regexp_replace(substr(m, 1, j), '[^0-9]', ''))"
    return (f"transform(array({digits}), v -> array_join(transform(sequence(1, length(m)), "
            f"j -> if(substr(m, j, 1) BETWEEN '0' AND '9', substr(v, {nth}, 1), substr(m, j, 1))), ''))[0]")


def _luhn(digits: str, skip: int) -> str:
    """Luhn sum of a digit string; ``skip`` 1 leaves the last place open for a check digit."""
    d = f"CAST(substr({digits}, length({digits}) - k, 1) AS INT)"
    return (f"aggregate(sequence(0, length({digits}) - 1), 0L, (a, k) -> a + if((k + {skip}) % 2 = 1, "
            f"(2 * {d}) DIV 10 + (2 * {d}) % 10, {d}))")


def _expressions(key: str) -> dict[str, tuple[str, str]]:
    """kind -> (SQL condition on the match m that makes it valid, SQL of its pseudonym)."""
    digits = r"regexp_replace(m, '[^0-9]', '')"
    octet = [f"CAST(split_part(m, '.', {i}) AS INT)" for i in (1, 2, 3, 4)]
    ip = _pair(key, "ipv4", f"{octet[0]} * 256 + {octet[1]}", f"{octet[2]} * 256 + {octet[3]}", 65536, 65536)
    ip = f"transform(array({ip}), p -> concat_ws('.', p.l DIV 256, p.l % 256, p.r DIV 256, p.r % 256))[0]"
    form = "CASE WHEN substr(m, 5, 1) = '-' THEN 'yyyy-MM-dd' WHEN substr(m, 3, 1) = '.' THEN 'dd.MM.yyyy' ELSE 'MM/dd/yyyy' END"
    y, mo, d = ("CAST(CASE WHEN substr(m, 5, 1) = '-' THEN substr(m, {}, {}) WHEN substr(m, 3, 1) = '.' THEN substr(m, {}, {}) ELSE substr(m, {}, {}) END AS INT)"
                .format(*p) for p in ((1, 4, 7, 4, 7, 4), (6, 2, 4, 2, 1, 2), (9, 2, 1, 2, 4, 2)))
    first = f"make_date({y}, {mo}, 1)"
    day = f"datediff({first}, DATE'1900-01-01') + {d} - 1"
    date = _pair(key, "date", f"({day}) DIV 4297", f"({day}) % 4297", 17, 4297)
    date = f"transform(array({date}), p -> date_format(date_add(DATE'1900-01-01', CAST(p.l * 4297 + p.r AS INT)), {form}))[0]"
    area, group, serial = ("CAST(substr(m, 1, 3) AS INT)", "CAST(substr(m, 5, 2) AS INT)", "CAST(substr(m, 8, 4) AS INT)")
    ssn = _pair(key, "ssn", f"if({area} < 666, {area} - 1, {area} - 2)", f"({group} - 1) * 9999 + {serial} - 1", 898, 99 * 9999)
    ssn = (f"transform(array({ssn}), p -> concat(lpad(CAST(if(p.l < 665, p.l + 1, p.l + 2) AS STRING), 3, '0'), '-', "
           "lpad(CAST(p.r DIV 9999 + 1 AS STRING), 2, '0'), '-', lpad(CAST(p.r % 9999 + 1 AS STRING), 4, '0')))[0]")
    code = r"regexp_extract(m, '^(\\+[0-9]{1,3}(?=[ .(-])|\\+[0-9]|)', 1)"
    national = rf"regexp_replace(substr(m, length({code}) + 1), '[^0-9]', '')"
    phone = _dressed(rf"concat(regexp_replace({code}, '[^0-9]', ''), {_shape(key, 'phone', national)})")
    body = f"substr({digits}, 2, length({digits}) - 2)"
    card = f"concat(substr({digits}, 1, 1), {_shape(key, 'card', body)})"
    card = _dressed(f"transform(array({card}), b -> concat(b, CAST((10 - ({_luhn('b', 1)}) % 10) % 10 AS STRING)))[0]")
    local = "substr(m, 1, length(m) - length(substring_index(m, '.', -1)) - 1)"
    return {
        "email": ("contains(m, '@')", f"concat({_shape(key, 'email', local)}, substr(m, length({local}) + 1))"),
        "ipv4": (r"m RLIKE '^([0-9]{1,3}\\.){3}[0-9]{1,3}$' AND greatest(" + ", ".join(octet) + ") < 256", ip),
        "date": (r"m RLIKE '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\\2[0-9]{4})$' AND " +
                 f"{y} BETWEEN 1900 AND 2099 AND {mo} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND day(last_day({first}))", date),
        "ssn": (f"m RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' AND {area} BETWEEN 1 AND 899 AND {area} != 666 AND {group} > 0 AND {serial} > 0", ssn),
        "phone": (rf"{PHONE} AND length({digits}) BETWEEN 8 AND 15", phone),
        "card": (f"m RLIKE '^[0-9][0-9 -]+[0-9]$' AND length({digits}) BETWEEN 13 AND 19 AND ({_luhn(digits, 0)}) % 10 = 0", card),
    }


def _shapes() -> dict[str, str]:
    """kind -> SQL condition on a match m that tells its kind, valid or not."""
    return {"email": "contains(m, '@')", "ipv4": r"m RLIKE '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$'",
            "date": r"m RLIKE '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$'",
            "ssn": "m RLIKE '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'", "phone": PHONE, "card": "true"}


def _unused(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised and a new last column pii_found: array of the kinds of the values changed, in order.

    ``key`` is a secret: who has it can turn pseudonyms back. Text without a valid value stays as it is, byte for byte; null stays null with an empty
    array; texts of any length are worked on whole. Repeated rows give equal results, an empty table none. A column named pii_found is replaced;
    others come back as they are, whatever their names. Lengths may change where addresses (IPv4) do.
    """
    secret, shapes = _quoted(key), _shapes()
    rules = _expressions(secret)
    kind = "CASE " + " ".join(f"WHEN {shapes[k]} THEN if({rules[k][0]}, '{k}', NULL)" for k in rules) + " END"
    name = "CASE p.kind " + " ".join(f"WHEN '{k}' THEN {rules[k][1].replace('p.', 'q.').replace('p ->', 'q ->')}" for k in rules) + " ELSE m END"
    name = f"transform(array(p.m), m -> {name})[0]"
    keep = [c for c in docs.columns if c != "pii_found"]
    matches, typed = _unused("__matches", keep), _unused("__typed", keep)
    found = docs.select(*[docs[c] for c in keep], F.coalesce(F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>")).alias(matches))
    found = found.withColumn(typed, F.expr(f"transform(`{matches}`, m -> named_struct('m', m, 'kind', {kind}))"))
    new = F.expr(f"transform(`{typed}`, p -> {name})")
    gaps = F.split(F.col(text_col), PATTERN, -1)
    text = F.array_join(F.zip_with(gaps, new, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    kinds = F.filter(F.col(typed)["kind"], lambda k: k.isNotNull())
    changed = found.withColumn("pii_found", kinds)
    return changed.withColumn(text_col, F.when(F.size("pii_found") > 0, text).otherwise(F.col(text_col))).select(*keep, "pii_found")


#: The setting that names the secret key in jobs, and the public key of trial runs without it.
KEY_SETTING, TRIAL_KEY = "spark.tillwatch.pseudonym.key", "trial run, not a secret"


def job_key(spark) -> str:
    """The key of this job: from KEY_SETTING; trial runs without one use a public key."""
    return spark.conf.get(KEY_SETTING, TRIAL_KEY)
