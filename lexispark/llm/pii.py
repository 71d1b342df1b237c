"""Personal data replaced by format-preserving Feistel pseudonyms."""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left
from calendar import monthrange
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10


def feistel(n: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): an alternating Feistel network over
    two parts a * b >= size, walked in cycles until it lands in range."""
    if size < 2:
        return n
    a = 1 << ((size - 1).bit_length() + 1) // 2
    b = -(-size // a)
    while True:
        left, right = divmod(n, b)
        for r in range(ROUNDS):
            part, other = (left, right) if r % 2 else (right, left)
            f = int.from_bytes(hmac.new(key, f"{tweak}|{size}|{r}|{part}".encode(), hashlib.sha256).digest()[:16], "big")
            if r % 2:
                right = (other + f) % b
            else:
                left = (other + f) % a
        n = left * b + right
        if n < size:
            return n


def luhn_sum(digits: str) -> int:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def digits_of(s: str) -> str:
    return re.sub(r"\D", "", s)


def into(shape: str, digits: str) -> str:
    """``digits`` put where the digits of ``shape`` are."""
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), shape)


def permuted(digits: str, key: bytes, tweak: str) -> str:
    return f"{feistel(int(digits), 10 ** len(digits), key, tweak):0{len(digits)}d}" if digits else ""


def card(s: str, key: bytes) -> str | None:
    """13 to 19 digits with a valid check digit; the issuer's first digit stays, the check digit is made anew."""
    d = digits_of(s)
    if luhn_sum(d) or len(set(d)) == 1:
        return None
    body = d[0] + permuted(d[1:-1], key, "card" + d[0])
    check = next(c for c in "0123456789" if luhn_sum(body + c) == 0)
    return into(s, body + check)


def iban(s: str, key: bytes) -> str | None:
    """Country letters and check digits mod 97; letters and digits of the account keep their kinds."""
    flat = re.sub(r"\s", "", s)
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = letters_and_digits(flat[4:], key, "iban" + flat[:2])
    check = 98 - number(body + flat[:2] + "00") % 97
    it = iter(flat[:2] + f"{check:02d}" + body)
    return re.sub(r"\S", lambda _: next(it), s)


#: Letters and digits that are permuted as one number; a longer run is permuted piece by piece.
PIECE = 64


def letters_and_digits(s: str, key: bytes, tweak: str) -> str:
    """Digits, small and capital letters permuted together, each within its kind and place.

    Of more than ``PIECE`` signs each piece is permuted on its own, under its
    place and all that stands before it, so different runs of a form stay
    different and the work grows with the run's length.
    """
    out, before = [], hashlib.sha256()
    for at in range(0, len(s), PIECE):
        piece = s[at : at + PIECE]
        out.append(_piece(piece, key, f"{tweak}|{at}|{before.hexdigest()}|" if at else tweak))
        before.update(piece.encode())
    return "".join(out)


def _piece(s: str, key: bytes, tweak: str) -> str:
    size, n = 1, 0
    radix = [10 if c.isdigit() else 26 for c in s]
    for c, r in zip(s, radix, strict=True):
        n = n * r + (int(c) if r == 10 else ord(c.lower()) - 97)
        size *= r
    n, out = feistel(n, size, key, tweak + "".join("9" if r == 10 else "a" for r in radix)), []
    for c, r in zip(reversed(s), reversed(radix), strict=True):
        n, d = divmod(n, r)
        out.append(str(d) if r == 10 else chr((97 if c.islower() else 65) + d))
    return "".join(reversed(out))


def phone(s: str, key: bytes) -> str | None:
    """At least seven digits; the country code stays."""
    d = digits_of(s)
    if not 7 <= len(d) <= 15:
        return None
    m = re.match(r"\+(\d{1,3})(?=\D)", s) or (re.match(r"(1)(?=\D)", s) if len(d) == 11 else None)
    code = m[1] if m else d[:1] if s.startswith("+") else ""
    rest = d[len(code) :]
    return into(s, code + permuted(rest, key, "phone"))


#: The most digits after the code of countries whose numbers end at a known length.
NATIONAL = {
    "1": 10, "7": 10, "20": 10, "27": 9, "30": 10, "31": 9, "32": 9, "33": 9, "34": 9, "36": 9, "39": 11, "40": 9, "41": 9, "44": 10, "45": 8, "46": 10, "47": 8, "48": 9, "49": 11,
    "51": 9, "52": 10, "54": 11, "55": 11, "56": 9, "57": 10, "58": 10, "60": 10, "61": 9, "63": 10, "64": 10, "65": 8, "66": 9, "81": 10, "82": 10, "84": 10, "86": 11, "90": 10, "91": 10, "92": 10,
    "351": 9, "353": 9, "358": 10, "359": 9, "370": 8, "371": 8, "372": 8, "380": 9, "420": 9, "421": 9, "852": 8, "966": 9, "971": 9, "972": 9,
}


def too_long(s: str) -> bool:
    """Whether an international number has more digits than its country's numbers, a trunk (0) aside."""
    d = digits_of(s.replace("(0)", ""))
    code = next((d[:n] for n in (1, 2, 3) if d[:n] in NATIONAL), None)
    return s.startswith("+") and code is not None and len(d) - len(code) > NATIONAL[code]


def ssn(s: str, key: bytes) -> str | None:
    """Area not 000, 666 or 900-999, group not 00, serial not 0000; permuted among such numbers."""
    area, group, serial = map(int, s.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    n = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    n, serial = divmod(feistel(n, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(n, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def ipv4(s: str, key: bytes) -> str | None:
    """Four numbers up to 255 without leading zeros."""
    parts = [int(p) for p in s.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in s.split(".")):
        return None
    n = feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ipv4")
    return ".".join(map(str, n.to_bytes(4, "big")))


@lru_cache
def days_of(form: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """All dates of 1900 to 2099 as their three numbers in a form: numbers of so
    many digits, year first, or year last with day and month in either order."""
    year_first = form[0] == 4
    a, b = form[1:] if year_first else form[:2]
    one, two = (range(1, 10) if n == 1 else range(1, 32) for n in (a, b))
    lengths = lambda leap: (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    out = []
    for year in range(1900, 2100):
        long = lengths(monthrange(year, 2)[1] == 29)
        is_day = lambda m, d, long=long: m <= 12 and d <= long[m - 1]
        if year_first:
            out += [(year, x, y) for x in one for y in two if is_day(x, y)]
        else:
            out += [(x, y, year) for x in one for y in two if is_day(x, y) or is_day(y, x)]
    out.sort()
    return out


def day(s: str, key: bytes) -> str | None:
    """Year-month-day, or day and month in either order before the year;
    permuted among all dates of the same form, so widths stay and different
    texts of a form stay different."""
    a, sep1, b, sep2, c = re.match(r"(\d+)(\D)(\d+)(\D)(\d+)$", s).groups()
    if sep1 != sep2:
        return None
    form, value = (len(a), len(b), len(c)), (int(a), int(b), int(c))
    all_ = days_of(form)
    at = bisect_left(all_, value)
    if at == len(all_) or all_[at] != value:
        return None
    new = all_[feistel(at, len(all_), key, f"day{form}")]
    return sep1.join(f"{v:0{n}d}" for v, n in zip(new, form, strict=True))


def email(s: str, key: bytes) -> str:
    """Letters and digits of the local part keep their kinds; the host stays."""
    local, _, host = s.rpartition("@")
    new = re.sub(r"[0-9A-Za-z]+", lambda m: letters_and_digits(m[0], key, "local"), local)
    return new + "@" + host


KINDS = {"email": email, "iban": iban, "date": day, "ssn": ssn, "ipv4": ipv4, "card": card, "phone": phone}
#: All begin at a sign that is not inside a word or number, and end at one. Earlier kinds win.
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+%-])[^\W_][\w.+%-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}([./-])\d{1,2}\4\d{1,2}|\d{1,2}([./-])\d{1,2}\5\d{4})(?![\w/-]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ipv4>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))"
    r"|(?P<card>(?<![\w.+-])(?:\d{13,19}|\d{4}(?P<sep>[ -])\d{4}(?P=sep)\d{4}(?P=sep)\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]|\.\d))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w|\.\d)|(?<![\w.-])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
    r"|(?<![\w.+-])1(?P<cut>[ .-])\d{3}(?P=cut)\d{3}(?P=cut)\d{4}(?![\w-])|(?<![\w.+-])\d{3} \d{3} \d{4}(?![\w-]|\.\d))",
    re.ASCII,
)
WORTH = re.compile(r"[0-9@]")


class Pseudonymizer:
    def __init__(self, key: bytes) -> None:
        self.key = key
        self.kept = lru_cache(1 << 16)(self._one)

    def one(self, kind: str, value: str) -> str | None:
        return (self.kept if len(value) <= 256 else self._one)(kind, value)

    def _one(self, kind: str, value: str) -> str | None:
        return KINDS[kind](value, self.key)

    def text(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        """The text with pseudonyms, and how many of each kind."""
        found: dict[str, int] = {}
        if text is None or not WORTH.search(text):
            return text, found

        out, done, at = [], 0, 0
        while m := PATTERN.search(text, at):
            kind, end, new = self.reading(text, m)
            if new is None:
                at = m.start() + 1
                continue
            found[kind] = found.get(kind, 0) + 1
            out += (text[done : m.start()], new)
            done = at = end
        return "".join((*out, text[done:])), found

    def reading(self, text: str, m: re.Match) -> tuple[str, int, str | None]:
        """(kind, end, pseudonym) of the longest valid reading from the start of
        ``m`` that ends at a group of it; pseudonym null if there is none. A
        phone number longer than its country's comes after shorter ones."""
        spare = (m.lastgroup, m.end(), None)
        for end in range(m.end(), m.start(), -1):
            if end < m.end():
                if not text[end - 1].isalnum() or text[end].isalnum():
                    continue
                r = PATTERN.fullmatch(text, m.start(), end)
            else:
                r = m
            new = r and self.one(r.lastgroup, r[0])
            if new is not None and not (r.lastgroup == "phone" and too_long(r[0])):
                return r.lastgroup, end, new
            if new is not None and spare[2] is None:
                spare = (r.lastgroup, end, new)
        return spare


def pseudonymize(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with personal data replaced: doc_id, text, n_found, and n_<kind> for each kind.

    E-mail addresses, IBANs, dates, social security numbers, IPv4 addresses,
    card numbers and phone numbers are recognised by form and validated (check
    digits, ranges, calendar); where a candidate fails, shorter readings that end
    at its groups and then values inside it are tried. A keyed Feistel
    permutation of the values of the same format gives the pseudonym, so equal
    values stay equal in all documents, different ones stay different, and the
    result is valid again. A value may be of any length; its letters and digits
    beyond ``PIECE`` are permuted piece by piece, and only values of at most
    256 signs are kept for reuse. The key is a secret of the caller. Null texts stay
    null with no finds; repeated and null ids get a row each; other columns are
    ignored; an empty table gives no rows.
    """

    @F.pandas_udf("text string, kinds map<string,int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = Pseudonymizer(key)
        for b in batches:
            out = [p.text(t) for t in b]
            yield pd.DataFrame({"text": pd.Series([t for t, _ in out], dtype=object), "kinds": pd.Series([k for _, k in out], dtype=object)})

    rows = docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("r"))
    n = lambda k: F.coalesce(F.try_element_at("r.kinds", F.lit(k)), F.lit(0))
    total: Column = F.lit(0)
    for k in KINDS:
        total = total + n(k)
    return rows.select("doc_id", F.col("r.text").alias("text"), total.alias("n_found"), *(n(k).alias(f"n_{k}") for k in KINDS))
