"""Format-preserving Feistel pseudonyms for personal data (DataFrame operations only).

Validated values are permuted by a key within their format: a card number becomes another number that passes Luhn's
check, a date another date of its century, an address another valid address. The permutation depends on the key, the
kind and the format alone, so equal values get equal pseudonyms in all documents, and ``restore`` undoes it.

A value is parsed into digits of mixed radix (a letter has radix 26, an IPv4 octet 256, a day two digits whose radixes
multiply to the days of its century). Even and odd digits take turns: in each round the one half is shifted by
SHA-256 of key, kind, round and the other half. Check digits are computed anew.

Kinds and validation: email; iban (ISO 7064 mod 97); date (ISO, or day first with ``/`` or ``.``; a real day of
1801-2100); ipv4 (octets to 255); card (13 to 19 digits, Luhn); ssn (valid areas, groups and serials); phone (8 to 15
digits, with + or in the form of ten digits); secret (AKIA keys, and values after password, token, secret, api_key).
Values that fail validation stay as they are.

Cases: a null text stays null, with no values. Empty texts and texts without values stay. Texts of any length are
searched whole. Repeated rows are treated alike. An empty table gives an empty result. The input's other columns,
whatever their names, come back unchanged.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import free_name

ROUNDS = 10

#: Patterns by kind, in order of preference.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\x22']?[A-Za-z0-9+/_.-]{6,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])",
    "ipv4": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d+(-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+(.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
}
CANDIDATE = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _let(name: str, value: str, body: str) -> str:
    """Bind a value once within a SQL expression."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _kind(m: str) -> str:
    tests = {
        "email": f"instr({m}, '@') > 0",
        "secret": f"{m} RLIKE r'^AKIA[0-9A-Z]{{16}}$' OR {m} RLIKE r'^(?i:password|passwd|pwd|secret|token|api_?key)\\s*[=:]'",
        "iban": f"{m} RLIKE r'^[A-Z]{{2}}[0-9]{{2}}'",
        "date": f"{m} RLIKE r'^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}[/.][0-9]{{2}}[/.][0-9]{{4}})$'",
        "ipv4": f"{m} RLIKE r'^([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$'",
        "ssn": f"{m} RLIKE r'^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$'",
        "card": f"{m} RLIKE r'^([0-9]{{13,19}}|[0-9]{{4}}[ -].*)$'",
    }
    return "CASE " + " ".join(f"WHEN {t} THEN '{k}'" for k, t in tests.items()) + " ELSE 'phone' END"


DIGITS = "regexp_replace(m, '[^0-9]', '')"
ISO = "CASE WHEN substring(m, 5, 1) = '-' THEN m ELSE concat_ws('-', substring(m, 7, 4), substring(m, 4, 2), substring(m, 1, 2)) END"
DAY = f"try_to_date({ISO}, 'yyyy-MM-dd')"
#: First day of the century (years 01 to 00) of the date d.
CENTURY = "make_date(CAST(floor((year(d) - 1) / 100) AS INT) * 100 + 1, 1, 1)"


def _luhn(digits: str, parity: str) -> str:
    """Luhn's sum; digits whose distance from the end has this parity (1: every second from the last but one) count twice."""
    d = f"CAST(substring({digits}, i, 1) AS INT)"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + IF((length({digits}) - i) % 2 = {parity}, IF({d} > 4, 2 * {d} - 9, 2 * {d}), {d}))"


def _mod97(text: str) -> str:
    c = f"substring({text}, i, 1)"
    return f"aggregate(sequence(1, length({text})), 0, (a, i) -> IF({c} BETWEEN '0' AND '9', (a * 10 + CAST({c} AS INT)) % 97, (a * 100 + ascii({c}) - 55) % 97))"


COMPACT = "replace(m, ' ', '')"
VALID = f"""CASE k
  WHEN 'email' THEN true
  WHEN 'secret' THEN true
  WHEN 'iban' THEN length({COMPACT}) BETWEEN 15 AND 34 AND {_mod97(f"concat(substring({COMPACT}, 5), substring({COMPACT}, 1, 4))")} = 1
  WHEN 'date' THEN coalesce({DAY} BETWEEN DATE'1801-01-01' AND DATE'2100-12-31', false)
  WHEN 'ipv4' THEN forall(split(m, '[.]'), o -> CAST(o AS INT) <= 255 AND (o = '0' OR substring(o, 1, 1) <> '0'))
  WHEN 'ssn' THEN substring(m, 1, 3) NOT IN ('000', '666') AND substring(m, 1, 3) < '900' AND substring(m, 5, 2) <> '00' AND substring(m, 8) <> '0000'
  WHEN 'card' THEN length({DIGITS}) BETWEEN 13 AND 19 AND {_luhn(DIGITS, '1')} % 10 = 0
  ELSE length({DIGITS}) BETWEEN 8 AND 15 END"""

#: Characters before this many stay: a country code, the name of a secret. Of a card the last digit, of an email the last label stays too.
SKIP = """CASE k WHEN 'phone' THEN length(regexp_extract(m, r'^[+]\\d{1,3}(?=[ (.-])', 0)) WHEN 'iban' THEN 4
  WHEN 'secret' THEN length(regexp_extract(m, r'^(AKIA|[A-Za-z_]+\\s*[=:]\\s*)', 0)) ELSE 0 END"""
STOP = """CASE k WHEN 'card' THEN length(m) - 1 WHEN 'email' THEN length(m) - length(substring_index(m, '.', -1)) - 1 ELSE length(m) END"""
RADIX = "CASE WHEN i <= skip OR i > stop THEN 1 WHEN c BETWEEN '0' AND '9' THEN 10 WHEN k = 'secret' AND hex AND c BETWEEN 'a' AND 'f' THEN 6 WHEN c BETWEEN 'a' AND 'z' OR c BETWEEN 'A' AND 'Z' THEN 26 ELSE 1 END"
VALUE = "CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 WHEN c BETWEEN 'a' AND 'z' THEN ascii(c) - 97 ELSE ascii(c) - 65 END"

#: The digits of a value: array of struct(at: 1-based character or part, x: digit, r: radix).
NUMBER = f"""CASE k
  WHEN 'ipv4' THEN transform(split(m, '[.]'), (o, i) -> named_struct('at', i + 1, 'x', CAST(o AS INT), 'r', 256))
  WHEN 'ssn' THEN array(
    named_struct('at', 1, 'x', CAST(substring(m, 1, 3) AS INT) - IF(substring(m, 1, 3) > '666', 2, 1), 'r', 898),
    named_struct('at', 2, 'x', CAST(substring(m, 5, 2) AS INT) - 1, 'r', 99), named_struct('at', 3, 'x', CAST(substring(m, 8) AS INT) - 1, 'r', 9999))
  WHEN 'date' THEN {_let('d', DAY, _let('n', f"datediff(d, {CENTURY})", _let('q', f"IF(datediff(add_months({CENTURY}, 1200), {CENTURY}) = 36525, 487, 397)",
    "array(named_struct('at', 1, 'x', CAST(n % q AS INT), 'r', q), named_struct('at', 2, 'x', CAST(floor(n / q) AS INT), 'r', IF(q = 487, 75, 92)))")))}
  ELSE {_let('skip', SKIP, _let('stop', STOP, _let('hex', f"substring(m, {SKIP} + 1) RLIKE r'^[\\x22\\x27]?[0-9a-f]+$'",
    f"filter(transform(sequence(1, length(m)), i -> {_let('c', 'substring(m, i, 1)', f"named_struct('at', i, 'x', {VALUE}, 'r', {RADIX})")}), s -> s.r > 1)")))}
  END"""


def _feistel(key: str, back: bool) -> str:
    """The digits ``ds`` after all rounds. Half of position i: i % 2."""
    half = "concat_ws(',', transform(filter(acc, (y, j) -> j % 2 <> g % 2), y -> CAST(y.x AS STRING)))"
    # of the format only the radixes count: separators do not part equal numbers
    form = "concat_ws(';', transform(ds, y -> CAST(y.r AS STRING)))"
    digest = f"sha2(concat_ws('|', '{key}', k, CAST(g AS STRING), {form}, {half}), 256)"
    shift = "CAST(pmod(CAST(conv(substring(sha2(concat(dig, '|', i), 256), 1, 12), 16, 10) AS BIGINT), CAST(y.r AS BIGINT)) AS INT)"
    step = f"transform(acc, (y, i) -> IF(i % 2 = g % 2, named_struct('at', y.at, 'x', pmod(y.x {'-' if back else '+'} {shift}, y.r), 'r', y.r), y))"
    order = f"sequence({ROUNDS - 1}, 0)" if back else f"sequence(0, {ROUNDS - 1})"
    return f"aggregate({order}, ds, (acc, g) -> {_let('dig', digest, step)})"


PUT = "CASE WHEN c BETWEEN '0' AND '9' THEN char(48 + w.x) WHEN c BETWEEN 'a' AND 'z' THEN char(97 + w.x) ELSE char(65 + w.x) END"
CHARS = f"array_join(transform(sequence(1, length(m)), i -> {_let('w', 'get(filter(ns, s -> s.at = i), 0)', _let('c', 'substring(m, i, 1)', f'IF(w IS NULL, c, {PUT})'))}), '')"
NEW_DAY = f"date_add({CENTURY}, ns[0].x + ns[0].r * ns[1].x)"
BBAN = "replace(s, ' ', '')"
#: The value with the digits ``ns`` in place of its own, and its check digits.
REBUILT = f"""CASE k
  WHEN 'ipv4' THEN array_join(transform(ns, y -> CAST(y.x AS STRING)), '.')
  WHEN 'ssn' THEN concat_ws('-', lpad(CAST(ns[0].x + IF(ns[0].x >= 665, 2, 1) AS STRING), 3, '0'), lpad(CAST(ns[1].x + 1 AS STRING), 2, '0'), lpad(CAST(ns[2].x + 1 AS STRING), 4, '0'))
  WHEN 'date' THEN {_let('d', DAY, f"date_format({NEW_DAY}, CASE substring(m, 3, 1) WHEN '/' THEN 'dd/MM/yyyy' WHEN '.' THEN 'dd.MM.yyyy' ELSE 'yyyy-MM-dd' END)")}
  WHEN 'card' THEN {_let('s', CHARS, f"concat(substring(s, 1, length(s) - 1), CAST((10 - {_luhn("regexp_replace(substring(s, 1, length(s) - 1), '[^0-9]', '')", '0')} % 10) % 10 AS STRING))")}
  WHEN 'iban' THEN {_let('s', CHARS, f"concat(substring(s, 1, 2), lpad(CAST(98 - {_mod97(f"concat(substring({BBAN}, 5), substring({BBAN}, 1, 2), '00')")} AS STRING), 2, '0'), substring(s, 5))")}
  ELSE {CHARS} END"""


def _pseudonym(key: str, back: bool) -> str:
    """struct(kind, value, pseudonym) of a candidate m; kind is null if the value is not valid."""
    # a digest: distinct keys stay distinct, whatever characters they have. It appears in plans and is enough to undo, as the key is
    derived = hashlib.sha256(key.encode("utf-8")).hexdigest()
    new = _let("ds", NUMBER, _let("ns", _feistel(derived, back), REBUILT))
    return _let("k", _kind("m"), f"IF({VALID}, named_struct('kind', k, 'value', m, 'pseudonym', {new}), named_struct('kind', CAST(NULL AS STRING), 'value', m, 'pseudonym', m))")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", back: bool = False) -> DataFrame:
    """The input's columns with pseudonyms in the text, then struct array ``_pii`` (``__pii`` if the input has that name, and so on): kind, value, pseudonym, in text order."""
    own = docs.columns
    text = F.col(f"d.`{text_col}`")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("d"))
    # most texts have neither digit nor @ nor =; they skip the search
    maybe = text.rlike("[0-9@=:]")
    found = packed.withColumn("ms", F.when(maybe, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))))
    found = found.withColumn("ps", F.when(F.size("ms") > 0, F.expr(f"transform(ms, m -> {_pseudonym(key, back)})")))
    rest = F.split(text, CANDIDATE, -1)
    woven = F.when(
        F.col("ps").isNotNull(),
        F.array_join(F.flatten(F.zip_with(rest, F.col("ps.pseudonym"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""),
    ).otherwise(text)
    hits = F.coalesce(F.filter("ps", lambda p: p["kind"].isNotNull()), F.expr("cast(array() as array<struct<kind:string,value:string,pseudonym:string>>)"))
    return found.select(*[(woven if c == text_col else F.col(f"d.`{c}`")).alias(c) for c in own], hits.alias(free_name(own, "_pii")))


def restore(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Undo ``pseudonymise`` under the same key."""
    return pseudonymise(docs, key, text_col, back=True)
