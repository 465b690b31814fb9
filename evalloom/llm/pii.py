"""Format-preserving pseudonyms: validated values are permuted within their format by a keyed Feistel network.

A value is found by a pattern, validated, and read as an integer below the size N of its format (15 free digits of a card number,
the digits of a telephone number, 32 bits of an IPv4 address, the day within 1900 to 2099, the free digits of an IBAN's account
part, the lower-cased letters and the digits of an address's local part, the digits of a hexadecimal secret). The network permutes 0..N-1, cycle
walking where N has no exact halves; check digits are computed anew. As the permutation depends on the key and the kind
of value alone, equal values stay equal in all documents and different ones stay different, without any table or join.

Telephone numbers have a country code (+ or 00) and a number of digits that fits it, or are written as national ones: in groups of 3, 3 and 4,
with a leading 0, or as nine digits in groups from 6, 7, 8 or 9 on. Ten digits without any separator are no telephone number. Dates have the day first,
or the month where there is no such day; one-digit days and months count.

A number that its check digit, its country's plan or the calendar does not validate stays as it is.

Nulls: a null text stays null, with all counts 0. Empty texts stay empty, an empty table gives no rows. Rows are treated one by one, so repeats give repeats.
Further columns are not returned.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import doc_columns, read, slices

ROUNDS = 8
#: The key of the registered query; callers pass their own.
QUERY_KEY = b"registered query, no secret"
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
KINDS = ("email", "card", "iban", "phone", "ip", "date", "secret")


def feistel(x: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """The image of x under a keyed permutation of 0..size-1 (back: its inverse)."""
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    width = (max(a, b).bit_length() + 7) // 8 + 1
    rounds = range(ROUNDS)[::-1] if back else range(ROUNDS)
    sign = -1 if back else 1
    while True:
        left, right = divmod(x, b)
        for i in rounds:
            half = right if i % 2 == 0 else left
            f = int.from_bytes(hashlib.blake2b(half.to_bytes(width, "big"), key=key[:64], person=kind.encode()[:16], salt=bytes([i])).digest(), "big")
            if i % 2 == 0:
                left = (left + sign * f) % a
            else:
                right = (right + sign * f) % b
        x = left * b + right
        if x < size:
            return x


def luhn_digit(digits: str) -> str:
    """The check digit that follows these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def refill(surface: str, digits: str) -> str:
    """The surface with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in surface)


def _card(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = str(feistel(int(digits[:-1]), 10 ** (len(digits) - 1), key, f"card{len(digits)}")).zfill(len(digits) - 1)
    return refill(m[0], body + luhn_digit(body))


def _nanp(digits: str, key: bytes) -> str:
    """Ten digits: numbers whose area and exchange codes may be in use (neither begins with 0 or 1) stay among those, and all others among the others."""
    used = lambda x: x[0] > "1" and x[3] > "1"
    if used(digits):
        x = ((int(digits[0]) - 2) * 100 + int(digits[1:3])) * 8 + int(digits[3]) - 2
        x = feistel(x * 10**6 + int(digits[4:]), 64 * 10**8, key, "nanp")
        area, rest = divmod(x, 10**6)
        area, exchange = divmod(area, 8)
        return f"{area // 100 + 2}{area % 100:02d}{exchange + 2}{rest:06d}"
    while True:
        digits = str(feistel(int(digits), 10**10, key, "phone")).zfill(10)
        if not used(digits):
            return digits


def _phone(m: re.Match, key: bytes) -> tuple[str, int] | None:
    """The longest run of whole digit groups whose number of digits fits the country code (without one: a form of a national number)."""
    code = m["cc"] or ("1" if m["nanp"] else "")
    kind = "rest" if m["cc"] else "nanp" if m["nanp"] else "national"
    least, most = PHONE_DIGITS.get(code, (5, 15 - len(code))) if code else (8, 11)
    start = m.start(kind)
    trunk = re.match(TRUNK[kind], m[kind]).end()  # digits before the number proper stay
    for group in reversed(list(re.finditer(r"\d+", m[kind][trunk:]))):
        body = m[kind][trunk:][: group.end()]
        digits = re.sub(r"\D", "", body)
        if least <= len(digits) <= most:
            if code == "1":
                new = _nanp(digits, key)
            else:  # the first digit names the kind of line and stays
                n = len(digits) - 1
                new = digits[0] + str(feistel(int(digits[1:]), 10**n, key, f"phone{len(digits)}{digits[0]}")).zfill(n)
            return m[0][: start - m.start() + trunk] + refill(body, new), start + trunk + group.end()
    return None


def _ip(m: re.Match, key: bytes) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    x = feistel(int.from_bytes(bytes(parts), "big"), 2**32, key, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _day(y: str, m: str, d: str) -> dt.date | None:
    try:
        day = dt.date(int(y), int(m), int(d))
    except ValueError:
        return None
    return day if FIRST_DAY <= day.toordinal() <= LAST_DAY else None


def _date(m: re.Match, key: bytes) -> str | None:
    """A date that is none with the day first is read with the month first, and stays among those."""
    if m["y"] is not None:
        day, late = _day(m["y"], m["m"], m["d"]), False
    else:
        day, late = _day(m["y2"], m["m2"], m["d2"]), False
        if day is None and m["s"] != ".":
            day, late = _day(m["y2"], m["d2"], m["m2"]), True
    if day is None:
        return None
    while True:
        day = dt.date.fromordinal(FIRST_DAY + feistel(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
        if not late or day.day > 12:
            break
    width = 1 if min(len(m["m"] or m["m2"]), len(m["d"] or m["d2"])) == 1 else 2
    year, month, number = f"{day.year:04d}", f"{day.month:0{width}d}", f"{day.day:0{width}d}"
    return f"{year}-{month}-{number}" if m["y"] is not None else m["s"].join((month, number, year) if late else (number, month, year))


def _mod97(country: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(m: re.Match, key: bytes) -> str | None:
    text = re.sub(" ", "", m[0])
    country, check, body = text[:2], text[2:4], text[4:]
    if 98 - _mod97(country, body) != int(check):
        return None
    digits = re.sub(r"\D", "", body)
    new = refill(body, str(feistel(int(digits or 0), 10 ** len(digits), key, f"iban{len(digits)}")).zfill(len(digits))) if digits else body
    rest = iter(f"{country}{98 - _mod97(country, new):02d}{new}")
    return "".join(c if c == " " else next(rest) for c in m[0])


def permute_classes(text: str, key: bytes, kind: str) -> str:
    """Permutes the ASCII letters and digits of a text, a letter staying a letter of its case and a digit a digit."""
    base = [(26, 97) if "a" <= c <= "z" else (26, 65) if "A" <= c <= "Z" else (10, 48) if "0" <= c <= "9" else None for c in text]
    x, size = 0, 1
    for c, b in zip(text, base, strict=True):
        if b:
            x, size = x * b[0] + ord(c) - b[1], size * b[0]
    x = feistel(x, size, key, kind)
    out = []
    for c, b in zip(reversed(text), reversed(base), strict=True):
        if b:
            x, d = divmod(x, b[0])
            c = chr(b[1] + d)
        out.append(c)
    return "".join(reversed(out))


def _email(m: re.Match, key: bytes) -> str | None:
    """The local part, whatever its case, is one value; its capitals stay where they are. The domain stays."""
    new = permute_classes(m["local"].lower(), key, "email")
    return "".join(x.upper() if c.isupper() else x for c, x in zip(m["local"], new, strict=True)) + m[0][len(m["local"]) :]


def _secret(m: re.Match, key: bytes) -> str | None:
    text = m[0]
    if text.isdigit() or text.isalpha() or text not in (text.lower(), text.upper()):
        return None
    new = format(feistel(int(text, 16), 16 ** len(text), key, f"secret{len(text)}"), "x").zfill(len(text))
    return new.upper() if text == text.upper() else new


#: Country codes; how many digits follow some of them (of the others, 5 to what makes 15 in all).
COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[035789]|9[679])\d)"
PHONE_DIGITS = {"1": (10, 10), "7": (10, 10), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "39": (6, 11), "41": (9, 9), "43": (6, 13), "44": (7, 10), "45": (8, 8), "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (6, 13), "52": (10, 10), "351": (9, 9)}
TRUNK = {"rest": r"(?:[ .-]?\(0\))?", "nanp": r"(?:1(?![\d][\d][ .-]))?", "national": r"\(?0?"}
#: One pattern; the name of the group that matched is the kind.
PATTERN = re.compile(
    r"(?P<email>(?P<local>[A-Za-z0-9._%+-]{1,64})@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>(?<![A-Za-z0-9])(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})(?![A-Za-z0-9]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))"
    r"|(?P<date>(?<!\d)(?<!\d[/.-])(?:(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})|(?P<d2>\d{1,2})(?P<s>[/.-])(?P<m2>\d{1,2})(?P=s)(?P<y2>\d{4}))(?!\d))"
    r"|(?P<phone>(?=[+(\d])(?<![\d+])(?<!\d[.,-])(?:(?:\+|00) ?(?P<cc>" + COUNTRY + r")(?P<rest>(?:[ .-]?\(0\))?[ .-]?\(?\d{1,14}(?:(?:\)[ .-]?|[ ./-])\d{2,14}){0,6})(?!\d)"
    r"|(?P<nanp>(?:1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4})(?!-?\d)"
    r"|(?P<national>0[1-9](?:[ .-]\d\d){4}(?!-?\d)|[6-9]\d\d(?:(?:[ .-]\d{3}){2}|(?:[ .-]\d\d){3})(?!-?\d)|(?:\(0[1-9]\d{0,4}\)[ ./-]?|0[1-9]\d{0,4}[ ./-])\d{2,9}(?:[ ./-]\d{2,9}){0,4}(?!\d))))"
    r"|(?P<card>(?<!\d)\d(?:[ -]?\d){12,18}(?!\d))"
)
#: What takes the place of a match, or nothing; with the place where it ends if that is before the match does.
RULES: dict[str, Callable[[re.Match, bytes], str | tuple[str, int] | None]] = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "phone": _phone, "card": _card}
MAY = re.compile(r"[0-9@]")


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    found = dict.fromkeys(KINDS, 0)
    if not MAY.search(text):
        return text, found

    out, at = [], 0
    while m := PATTERN.search(text, at):
        kind = next(k for k in KINDS if m[k] is not None)
        new, end = x if isinstance(x := RULES[kind](m, key), tuple) else (x, m.end())
        found[kind] += new is not None
        out += (text[at : m.start()], m[0] if new is None else new)
        at = end
    return "".join((*out, text[at:])), found


def pseudonymised(docs: DataFrame, key: bytes = QUERY_KEY) -> DataFrame:
    """doc_id, n_found, a count per kind, and the text with its values replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [(None, dict.fromkeys(KINDS, 0)) if x is None else pseudonymise(x, key) for x in part.column("text").to_pylist()]
            counts = [[f[k] for _, f in rows] for k in KINDS]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([sum(f.values()) for _, f in rows], pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array([t for t, _ in rows], pa.string())], names=["doc_id", "n_found", *(f"n_{k}" for k in KINDS), "text"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, n_found long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", text string")


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(read(spark, sf_dir, "documents"))


QUERIES = {"op6_pii_pseudonyms": op6_pii_pseudonyms}
SQL: dict[str, str] = {}
