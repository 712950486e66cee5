"""PII: validated numbers, dates, addresses and secrets are replaced by a keyed Feistel permutation within their format, so equal values stay linked across documents."""

from __future__ import annotations

import bisect
import datetime
import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import mapped, texts

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
KINDS = ("email", "card", "iban", "phone", "ssn", "ip", "date", "secret")
#: Characters that a pseudonym exchanges within their kind: digits, small, capital and accented Latin letters.
_RANGES = [(48, 10), (97, 26), (65, 26), (0xC0, 23), (0xD8, 31), (0xF8, 0x158)]
#: Country calling codes of one and two digits; all others have three.
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

# Numbers and dates are in runs that begin with a digit, plus or parenthesis and go on with digits and the marks used inside them.
_RUN = re.compile(r"[0-9+(][0-9+()./ -]{6,}")
# Where a date with its month in letters may end, and where an address of version 6 may be.
_YEAR = re.compile(r"(?<!\d)(?:19|20)\d{2}(?!\w)")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_HEX = re.compile(r"[0-9a-fA-F]{32,}")
# How well-known services begin their keys.
_KEYED = re.compile(
    r"(?<![\w-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)|AIza[\w-]{35}(?![\w-])|(?:(?:sk|pk|rk)[-_](?:[a-z]+[-_])*|gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|hf_|npm_)[A-Za-z0-9][\w-]{15,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})"
)
_PREFIX = re.compile(r"AKIA|ASIA|AIza|(?:sk|pk|rk)[-_](?:[a-z]+[-_])*|gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|hf_|npm_|eyJ")
# What is assigned to a name that says so.
_ASSIGNED = re.compile(r"(?i)(?:api[_-]?key|secret|token|passw(?:or)?d|pwd|access[_-]?key|credential)s?[\"']?[ \t]*[:=]{1,2}>?[ \t]*[\"']?([\w+/=.~!@#$%^&*-]{8,})")
# One of these is in each match of the two patterns above.
_KEY_STARTS = ["AKIA", "ASIA", "AIza", "sk-", "sk_", "pk-", "pk_", "rk-", "rk_", "gho_", "ghp_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "hf_", "npm_", "eyJ"]
_NAMES = ["key", "secret", "token", "passw", "pwd", "credential"]
# What a header of requests hands over; a key that is written out between its marks.
_BEARER = re.compile(r"\b[Bb]earer[ \t]+([\w.~+/=-]{16,})")
_BLOCK = re.compile(r"(-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----)(.+?)(-----END [A-Z0-9 ]*PRIVATE KEY-----)", re.DOTALL)
_EMAIL = re.compile(r"[\w%+-]+(?:\.{1,2}[\w%+-]+)*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_IBAN_HEAD = re.compile(r"[A-Za-z]{2}[0-9]{2}")
_IBAN = re.compile(r"[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?!\w)")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]{0,4})(?![\w:])")
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_MONTH = "(?:" + "|".join([*MONTHS, *[m[:3] for m in MONTHS if m != "May"], "Sept"]) + ")"
_WRITTEN = re.compile(rf"(?<![\w-])(?:(?P<day>\d{{1,2}})(?P<nth>st|nd|rd|th)?(?: of)? (?P<month>{_MONTH})\.?,? (?P<year>\d{{4}})|(?P<month2>{_MONTH})\.? (?P<day2>\d{{1,2}})(?P<nth2>st|nd|rd|th)?,? (?P<year2>\d{{4}}))(?!\w)", re.IGNORECASE)
#: The forms of numbers and dates, by how much a value that passes its check proves: where two overlap, the first kind here is what it is.
_FORMS = [
    ("card", r"\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}", r"(?!\d)"),
    ("date", r"\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}[/.]\d{1,2}[/.]\d{4}|\d{1,2}-\d{1,2}-\d{4}", r"(?![\d-])"),
    ("ip", r"\d{1,3}(?:\.\d{1,3}){3}", r"(?!\.?\d)"),
    ("ssn", r"\d{3}(?P<mark>[ -])\d{2}(?P=mark)\d{4}", r"(?![\d-])"),
    ("phone", r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}", r"(?!\d)"),
    ("phone", r"\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}(?P<dot>[ .-])\d{3}(?P=dot)\d{4}", r"(?!\d)"),
]
#: Each form wherever it can begin: matches may overlap, the check of each decides.
_STARTS = [(kind, re.compile(rf"(?<![\w])(?=({form}){end})")) for kind, form, end in _FORMS]
#: The one form that has several ends from one start.
_ABROAD = re.compile(_FORMS[4][1])
_GROUP_END = re.compile(r"\d(?!\d)")


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size): a balanced Feistel network on the least even number of bits, walked until it is in range again."""
    half = max(1, -(-max(1, (size - 1).bit_length()) // 2))
    mask, n_bytes = (1 << half) - 1, -(-half // 8)
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            digest = hashlib.shake_256(key + bytes([i]) + tweak + b"\0" + right.to_bytes(n_bytes, "big")).digest(n_bytes)
            left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def exchanged(text: str, key: bytes, tweak: bytes, ranges: list[tuple[int, int]] = _RANGES) -> str:
    """text with each character of the ranges exchanged within its range, all of them permuted as one mixed-radix number."""
    places, value, size = [], 0, 1
    for i, c in enumerate(text):
        for low, n in ranges:
            if low <= ord(c) < low + n:
                places.append((i, low, n))
                value, size = value * n + ord(c) - low, size * n
                break
    value, out = permute(value, size, key, tweak) if size > 1 else 0, list(text)
    for i, low, n in reversed(places):
        value, digit = divmod(value, n)
        out[i] = chr(low + digit)
    return "".join(out)


def luhn_sum(digits: str) -> int:
    return sum(int(d) if i % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for i, d in enumerate(reversed(digits)))


def refill(pattern: str, digits: str) -> str:
    """pattern with its digits replaced, in order, by digits."""
    it = iter(digits)
    return "".join([next(it) if "0" <= c <= "9" else c for c in pattern])


def only_digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def card(text: str, key: bytes) -> str | None:
    """Walked until it is no row of equal digits."""
    digits = only_digits(text)
    if luhn_sum(digits) % 10 or len(set(digits)) == 1:
        return None
    while True:
        body = exchanged(digits[:-1], key, b"card%d" % len(digits))
        digits = body + str(-luhn_sum(body + "0") % 10)
        if len(set(digits)) > 1:
            return refill(text, digits)


def iban(text: str, key: bytes) -> str | None:
    """Permuted as if in capitals, and written in small letters where all were."""
    if text != text.upper():
        new = iban(text.upper(), key) if text == text.lower() else None
        return None if new is None else new.lower()
    flat = text.replace(" ", "")
    number = lambda s: int("".join([str(int(c, 36)) for c in s]))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = exchanged(flat[4:], key, b"iban" + flat[:2].encode(), _RANGES[:1] + _RANGES[2:3])
    new = iter(f"{flat[:2]}{98 - number(body + flat[:2] + '00') % 97:02d}{body}")
    return "".join([c if c == " " else next(new) for c in text])


def phone(text: str, key: bytes) -> str | None:
    """The country's code stays and the other digits are permuted, by the digits alone, however they are written; a number without a code is of country 1."""
    digits = only_digits(text)
    if not 8 <= len(digits) <= 15:
        return None
    code = "1" if text[0] != "+" else next((c for c in (digits[:1], digits[:2]) if c in CALLING_CODES), digits[:3])
    shown = len(code) if text[0] == "+" else 0
    return refill(text, digits[:shown] + exchanged(digits[shown:], key, b"phone" + code.encode()))


def _ssn_issued(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def ssn(text: str, key: bytes) -> str | None:
    """Walked until the number is again one that can have been issued."""
    digits = only_digits(text)
    if not _ssn_issued(digits):
        return None
    while not _ssn_issued(digits := exchanged(digits, key, b"ssn")):
        pass
    return refill(text, digits)


def ip(text: str, key: bytes) -> str | None:
    """Four octets, or an address of version 6 by its value, however it is shortened."""
    if ":" in text:
        try:
            value = int(ipaddress.IPv6Address(text))
        except ValueError:
            return None
        # The unspecified address and that of the machine itself are no one's.
        return None if value < 2 else str(ipaddress.IPv6Address(permute(value, 1 << 128, key, b"ip6")))
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    new = permute(sum(int(p) << 8 * (3 - i) for i, p in enumerate(parts)), 1 << 32, key, b"ip")
    return ".".join([str(new >> 8 * (3 - i) & 255) for i in range(4)])


def date(text: str, key: bytes) -> str | None:
    """Year-month-day, or day and month in either order (day first where both are possible), from 1900 to 2099."""
    mark = next(c for c in text if not c.isdigit())
    parts = text.split(mark)
    first = len(parts[0]) == 4
    for order in ((0, 1, 2),) if first else ((2, 1, 0), (2, 0, 1)):
        try:
            day = datetime.date(*[int(parts[i]) for i in order]).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            new = datetime.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, b"date"))
            out = {order[0]: f"{new.year:04d}", order[1]: f"{new.month:02d}", order[2]: f"{new.day:02d}"}
            return mark.join([out[i] for i in range(3)])
    return None


def written_date(text: str, key: bytes) -> str | None:
    """A date with its month in letters, which is permuted as the same day in digits is; the month's form and case, and the marks, stay."""
    m = _WRITTEN.fullmatch(text)
    own = {k: m[k] or m[k + "2"] for k in ("day", "month", "year")}
    number = next(i for i, x in enumerate(MONTHS, start=1) if own["month"].lower().startswith(x[:3].lower()))
    new = date(f"{own['year']}-{number}-{own['day']}", key)
    if new is None:
        return None
    year, month, day = new.split("-")
    name = MONTHS[int(month) - 1]
    name = name if own["month"].lower() in [x.lower() for x in MONTHS] else name[:3]
    name = name.upper() if own["month"].isupper() else name.lower() if own["month"].islower() else name
    day = str(int(day))
    nth = "th" if 10 < int(day) < 14 else {"1": "st", "2": "nd", "3": "rd"}.get(day[-1], "th")
    out = text
    for group, value in sorted(((g, v) for g, v in {"day": day, "month": name, "year": year, "nth": nth, "day2": day, "month2": name, "year2": year, "nth2": nth}.items() if m[g]), key=lambda x: -m.start(x[0])):
        out = out[: m.start(group)] + value + out[m.end(group) :]
    return out


def key_block(text: str, key: bytes) -> str:
    """A written-out private key: the characters between its marks, line by line."""
    m = _BLOCK.fullmatch(text)
    return m[1] + "\n".join([exchanged(line, key, b"block") for line in m[2].split("\n")]) + m[3]


def handed(text: str, key: bytes) -> str:
    """What is assigned to a name that says that it is secret, or handed over as a bearer's: as a secret where it looks like one, else character by kind."""
    return secret(text, key) or exchanged(text, key, b"handed")


def secret(text: str, key: bytes) -> str | None:
    """Tokens with both digits and letters: long hexadecimal ones are permuted as numbers, in lower or upper case; others character by kind, behind the prefix of their service."""
    if not any("0" <= c <= "9" for c in text) or not any(c.isalpha() for c in text):
        return None
    if not _HEX.fullmatch(text):
        kept = m.end() if (m := _PREFIX.match(text)) else 0
        return text[:kept] + exchanged(text[kept:], key, b"secret" + text[:kept].encode())
    new = text.lower()
    while (new := f"{permute(int(new, 16), 16 ** len(new), key, b'hex%d' % len(new)):0{len(new)}x}").isdigit() or new.isalpha():
        pass
    return new.upper() if text == text.upper() else new


def email(text: str, key: bytes) -> str:
    """Name and host are permuted as if in small letters, and written in the given ones' case; the last part of the domain stays."""
    name, _, domain = text.partition("@")
    host, _, top = domain.rpartition(".")
    return f"{_in_case(exchanged(_small(name), key, b'name'), name)}@{_in_case(exchanged(_small(host), key, b'host'), host)}.{top}"


def _small(text: str) -> str:
    return "".join([chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text])


def _in_case(new: str, old: str) -> str:
    return "".join([chr(ord(c) - 32) if "A" <= o <= "Z" else c for c, o in zip(new, old, strict=True)])


HANDLERS = {"email": email, "card": card, "iban": iban, "phone": phone, "ssn": ssn, "ip": ip, "date": date, "secret": secret, "written": written_date, "block": key_block, "handed": handed}
#: What candidates of these kinds are counted as; and the order in which kinds take their places, the surest first.
COUNTED = {"written": "date", "block": "secret", "handed": "secret"}
ORDER = ["block", "email", "iban", "secret", "handed", "card", "written", "date", "ip", "ssn", "phone"]


def _in_name(c: str) -> bool:
    return c.isalnum() or c in "_%+-"


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of what may be personal data, not yet validated: all of it, also where one overlaps another."""
    if "@" in text:
        at, done = text.find("@"), 0
        while at >= 0:
            # Back over the name: its characters, and one or two dots between them, not those of an earlier address.
            low = at
            while low > done:
                if _in_name(text[low - 1]):
                    low -= 1
                    continue
                dots = 1 if text[low - 1] == "." else 0
                dots += dots and low - 1 > done and text[low - 2] == "."
                if not dots or low == at or low - dots <= done or not _in_name(text[low - dots - 1]):
                    break
                low -= dots
            if low < at and (m := _EMAIL.match(text, low)):
                yield m.start(), m.end(), "email"
                done = m.end()
            at = text.find("@", at + 1)
    for m in _HEX.finditer(text):
        if not (m.start() and text[m.start() - 1].isalnum()) and not text[m.end() : m.end() + 1].isalnum():
            yield m.start(), m.end(), "secret"
    # Plain searches first: few texts hold any of these.
    for m in _KEYED.finditer(text) if any(x in text for x in _KEY_STARTS) else ():
        yield m.start(), m.end(), "secret"
    low = text.lower()
    for m in _ASSIGNED.finditer(text) if any(x in low for x in _NAMES) else ():
        value = m[1].rstrip(".!")
        # After a colon words may stand that are no secret; after an equals sign there is a value.
        kind = "handed" if "=" in text[m.start() : m.start(1)] and len(value) >= 8 else "secret"
        yield m.start(1), m.start(1) + len(value), kind
    for m in _BEARER.finditer(text) if "earer" in text else ():
        yield m.start(1), m.start(1) + len(m[1].rstrip(".")), "handed"
    for m in _BLOCK.finditer(text) if "PRIVATE KEY-----" in text else ():
        yield m.start(), m.end(), "block"
    for head in _IBAN_HEAD.finditer(text):
        start = head.start()
        if not (start and text[start - 1].isalnum()) and (m := _IBAN.match(text, start)):
            # Other words may follow, so its beginnings that end at a blank are candidates too; the check decides.
            end = m.end()
            while end > 0:
                if _IBAN.fullmatch(text, start, end):
                    yield start, end, "iban"
                end = text.rfind(" ", start, end)
    for m in _IPV6.finditer(text) if _COLONS.search(text) else ():
        yield m.start(), m.end(), "ip"
    for year in _YEAR.finditer(text):
        # The longest day and month before a year have 24 characters.
        for m in _WRITTEN.finditer(text, max(0, year.start() - 24), year.end()):
            if m.end() == year.end():
                yield m.start(), m.end(), "written"
    for run in _RUN.finditer(text):
        for kind, starts in _STARTS:
            for m in starts.finditer(text, run.start(), run.end()):
                end = m.end(1)
                after = text[end : end + 1]
                # A time may follow a date without a blank.
                if not (after.isalnum() or after == "_") or (kind == "date" and after == "T" and text[end + 1 : end + 2].isdigit()):
                    yield m.start(1), end, kind
                if text[m.start(1)] == "+":
                    # Other numbers may follow, so its beginnings that end a group of digits are candidates too.
                    for g in _GROUP_END.finditer(text, m.start(1), end - 1):
                        if text[g.end()] != "_" and not text[g.end()].isalnum() and _ABROAD.fullmatch(text, m.start(1), g.end()):
                            yield m.start(1), g.end(), kind


def pseudonymised(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """text with every validated value replaced; how many of each kind.

    Of values that overlap the kind that comes first in ORDER is taken, of one kind the one that begins first, then the longest: a
    longer match that fails its check hides nothing.
    """
    found = sorted(set(candidates(text)), key=lambda x: (ORDER.index(x[2]), x[0], -x[1]))
    taken: list[tuple[int, int, str]] = []
    counts: dict[str, int] = {}
    for start, end, kind in found:
        at = bisect.bisect_right(taken, (start, len(text) + 1, ""))
        if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
            continue
        new = HANDLERS[kind](text[start:end], key)
        if new is not None:
            taken.insert(at, (start, end, new))
            kind = COUNTED.get(kind, kind)
            counts[kind] = counts.get(kind, 0) + 1
    parts, done = [], 0
    for start, end, new in taken:
        parts += [text[done:start], new]
        done = end
    return "".join([*parts, text[done:]]) if parts else text, counts


SCHEMA = "doc_id long, text string, n_replaced long, " + ", ".join(f"n_{k} long" for k in KINDS)


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_replaced, n_<kind>...) of every row of docs: whole texts with personal data replaced.

    The same value has the same pseudonym in every document, for the key alone decides it; values that fail their check (Luhn,
    IBAN, octets, calendar, numbers never issued) stay, unless a part of them is a value by itself, and every pseudonym passes the
    check of its kind. Spelling does not matter: blanks and marks in numbers, letter case of addresses, the order and form of a date's parts. A text of any length is taken whole. A null text is an empty one; rows without doc_id go; repeated rows each have a result; an
    empty table gives an empty one. Only doc_id and text are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                new, counts = pseudonymised(text, key)
                rows.append((doc_id, new, sum(counts.values()), *[counts.get(k, 0) for k in KINDS]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return mapped(texts(docs), run, SCHEMA)
