"""Format-preserving pseudonyms for personal data in texts.

Numbers and dates that pass their checks (Luhn digits, IBAN remainder, octets, number plans, calendar) and the names of mail
addresses and secrets are permuted inside the set of strings of their own format by a keyed Feistel network: a value
becomes another valid value of the same form, the same one in every document, and the key alone takes it back.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import hmac
import math
import re
import secrets
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstrata.llm.common import Memo, as_text

#: A stand-in for tests on one machine; the key of a cluster is that of the session (``SETTING``), or drawn for the application.
KEY = b"replace this key"
SETTING = "spark.gridstrata.pii.key"
ROUNDS = 10
SPANS = "array<struct<kind:string,start:int,end:int,pseudonym:string>>"


def permute(value: int, size: int, tweak: bytes, key: bytes = KEY, back: bool = False) -> int:
    """A keyed permutation of 0 … size − 1: Feistel rounds modulo a and b with a·b ≥ size, walked until inside."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)

    wide = (size.bit_length() + 7) // 8
    mark = b"%s|%d|" % (tweak, wide) + size.to_bytes(wide, "big")

    def turn(i: int, half: int, modulus: int) -> int:
        part, out = mark + bytes([i]) + half.to_bytes(wide, "big"), b""
        while 8 * len(out) < modulus.bit_length() + 64:  # far more bits than the modulus, so that no half is likelier
            out += hmac.new(key, part + bytes([len(out) // 32]), hashlib.sha256).digest()
        return int.from_bytes(out, "big") % modulus

    while True:
        left, right = value // b, value % b  # left below a, right below b
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * turn(i, left, b)) % b
            else:
                left = (left + sign * turn(i, right, a)) % a
        value = left * b + right
        if value < size:
            return value


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def refill(pattern: str, chars: str) -> str:
    """The characters in the places of ``pattern`` that hold letters or digits."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


#: Characters that are permuted together; longer texts are chained run by run, so that work grows with their length.
RUN = 64
_SETS = {c: own for own in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in own}
_HEX_SETS = _SETS | {c: own for own in ("abcdef", "ABCDEF") for c in own}


def classes(text: str, tweak: bytes, key: bytes, back: bool = False) -> str:
    """Letters and digits permuted as one number whose digits have the size of their class; all else stays.

    Every run but the first depends on all plain characters before it.
    """
    known, out = b"", []
    for at in range(0, len(text), RUN):
        run = text[at : at + RUN]
        new = _run_of_classes(run, tweak + known, key, back, _HEX_SETS if tweak == b"hex" else _SETS)
        known = hashlib.sha256(known + (new if back else run).encode("utf-8", "surrogatepass")).digest()
        out.append(new)
    return "".join(out)


def _run_of_classes(text: str, tweak: bytes, key: bytes, back: bool, sets: dict[str, str]) -> str:
    own = [sets.get(c, c) for c in text]
    size, value = 1, 0
    for c, chars in zip(text, own):
        size, value = size * len(chars), value * len(chars) + chars.index(c)
    value = permute(value, size, tweak + b"|" + "".join(chars[0] for chars in own).encode("utf-8", "surrogatepass"), key, back)
    out = []
    for chars in reversed(own):
        value, at = divmod(value, len(chars))
        out.append(chars[at])
    return "".join(reversed(out))


def card(text: str, key: bytes, back: bool = False) -> str | None:
    """13 to 19 digits with a right check digit: all but the last are permuted, the last is set anew."""
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    # numbers keep a first digit other than 0 if they have one
    low, high = (10 ** (n - 1), 10**n) if digits[0] != "0" else (0, 10 ** (n - 1))
    body = str(low + permute(int(digits[:-1]) - low, high - low, b"card", key, back)).zfill(n)
    return refill(text, body + next(d for d in "0123456789" if luhn(body + d)))


def phone(text: str, key: bytes, back: bool = False) -> str | None:
    """+1 numbers keep area and exchange below 200 or from 200 on; other numbers with + and 8 to 15 digits keep their first two."""
    digits = re.sub(r"\D", "", text)
    if text.startswith("+1") and len(digits) == 11 or not text.startswith("+") and len(digits) == 10:
        head, area, exchange, line = digits[:-10], int(digits[-10:-7]), int(digits[-7:-4]), int(digits[-4:])
        (low, n), (least, m) = ((200, 800) if x >= 200 else (0, 200) for x in (area, exchange))
        value = permute(((area - low) * m + exchange - least) * 10_000 + line, n * m * 10_000, b"phone", key, back)
        value, line = divmod(value, 10_000)
        return refill(text, f"{head}{value // m + low:03}{value % m + least:03}{line:04}")
    if text.startswith("+") and 8 <= len(digits) <= 15:
        return refill(text, digits[:2] + str(permute(int(digits[2:]), 10 ** (len(digits) - 2), b"phone", key, back)).zfill(len(digits) - 2))
    return None


def address(text: str, key: bytes, back: bool = False) -> str | None:
    """Dotted quads of 0 to 255 without leading zeros."""
    parts = text.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    value = 0
    for p in parts:
        value = value << 8 | int(p)
    value = permute(value, 1 << 32, b"address", key, back)
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def social(text: str, key: bytes, back: bool = False) -> str | None:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (int(p) for p in re.split("[- ]", text))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    value = permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, b"social", key, back)
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return refill(text, f"{area + 1 + (area >= 665):03}{group + 1:02}{serial + 1:04}")


def iban(text: str, key: bytes, back: bool = False) -> str | None:
    """Country, two check digits and 11 to 30 characters with remainder 1 modulo 97; the check digits are set anew."""
    flat = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) != 1:
        return None
    body = classes(flat[4:], b"iban", key, back)
    return refill(text, f"{flat[:2]}{98 - number(body + flat[:2] + '00'):02}{body}")


_FIRST, _DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


#: Days that are no month: written with slashes they can only stand first.
_LATE = [i for i in range(_DAYS) if dt.date.fromordinal(_FIRST + i).day > 12]


def date(text: str, key: bytes, back: bool = False) -> str | None:
    """Days from 1900 to 2099 as year-month-day, day.month.year or month/day/year, permuted among all days; what is no
    month/day/year is read as day/month/year and permuted among the days from the 13th on."""
    a, b, c = re.findall(r"\d+", text)
    late = "/" in text and int(a) > 12
    order = (a, b, c) if len(a) == 4 else (c, b, a) if "." in text or late else (c, a, b)
    try:
        day = dt.date(*map(int, order)).toordinal() - _FIRST
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    if late:
        day = _LATE[permute(bisect.bisect_left(_LATE, day), len(_LATE), b"late date", key, back)]
    else:
        day = permute(day, _DAYS, b"date", key, back)
    new = dt.date.fromordinal(_FIRST + day)
    y, m, d = f"{new.year:04}", f"{new.month:02}", f"{new.day:02}"
    return refill(text, y + m + d if len(a) == 4 else d + m + y if "." in text or late else m + d + y)


def mail(text: str, key: bytes, back: bool = False) -> str | None:
    """The name before @; the domain stays."""
    name, _, domain = text.partition("@")
    return classes(name, b"mail", key, back) + "@" + domain


_HEX = re.compile("[0-9A-Fa-f]+")


def secret(text: str, key: bytes, back: bool = False) -> str | None:
    """Long mixed tokens: each letter and digit within its class; a fixed prefix of cloud keys stays."""
    head = text[:4] if text.startswith("AKIA") else ""
    body = text[len(head) :]
    if not (any(c.isdigit() for c in body) and any(c.isalpha() for c in body)):
        return None
    is_hex = _HEX.fullmatch(body) is not None
    while True:  # what is not hexadecimal stays so, or it could not be undone
        body = classes(body, b"hex" if is_hex else b"secret", key, back)
        if is_hex or not _HEX.fullmatch(body):
            return head + body


KINDS: dict[str, tuple[str, Callable[..., str | None]]] = {
    "mail": (r"@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", mail),  # from the sign on; its name is sought backwards
    # before iban: no account number has 32 hexadecimal characters
    "secret": (r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<=password=)[A-Za-z0-9]{8,}|(?<![A-Za-z0-9])(?=[A-Fa-f]*\d)[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])", secret),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    "address": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", address),
    "date": (r"(?<![\d\-/.])(?:\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\d\-/]|\.\d)", date),
    "social": (r"(?<![\d\-])\d{3}-\d\d-\d{4}(?![\d\-])", social),
    "card": (r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d\-])", card),
    "phone": (r"(?<![\w+])\+\d{1,3}[ \-.]?(?:\(\d{1,4}\)[ \-.]?)?\d(?:[ \-.]?\d){5,11}(?!\d)|(?<![\w\-])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w\-])\d{3}[\-.]\d{3}[\-.]\d{4}(?![\d\-])", phone),
}
_ANY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, (pattern, _) in KINDS.items() if kind != "mail"))
_MAIL = re.compile(KINDS["mail"][0])
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NAME_START = re.compile("[A-Za-z0-9]")


class _Mails:
    """Mail addresses of a text from left to right, found from their signs outwards."""

    def __init__(self, text: str):
        self.text, self.found = text, _MAIL.finditer(text)
        self._step()

    def _step(self) -> None:
        self.sign = next(self.found, None)
        if self.sign:
            k = self.low = self.sign.start()
            while k and self.text[k - 1] in _NAME:
                k -= 1
            self.low = k

    def after(self, at: int) -> tuple[int, int] | None:
        """Span of the first address that starts at ``at`` or later; its name may be cut by what stood before."""
        while self.sign:
            start = _NAME_START.search(self.text, max(self.low, at), self.sign.start()) if at < self.sign.start() else None
            if start:
                self.low = max(self.low, start.start())
                return start.start(), self.sign.end()
            self._step()
        return None


def replace(text: str, pseudonym: Callable[[tuple[str, str]], str | None]) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and the places that were replaced in the text as it was."""
    out, spans, done, at = [], [], 0, 0
    mails, m, mail_at = _Mails(text), None, None
    while True:
        if mail_at is None or mail_at[0] < at:
            mail_at = mails.after(at) or (len(text) + 1, 0)
        if m is None or m is not False and m.start() < at:
            m = _ANY.search(text, at) or False
        if mail_at[1] and (not m or mail_at[0] <= m.start()):
            kind, (start, end) = "mail", mail_at
        elif m:
            kind, start, end = m.lastgroup, m.start(), m.end()
        else:
            break
        new = pseudonym((kind, text[start:end]))
        if new is None:  # a failed check hides no value inside it
            at = start + 1
            continue
        out += [text[done:start], new]
        spans.append({"kind": kind, "start": start, "end": end, "pseudonym": new})
        done = at = end
    return ("".join([*out, text[done:]]) if spans else text), spans


_KINDS_OF = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))
_HAS = re.compile(r"[@\d]")


def _run(key: bytes, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lambda kv: KINDS[kv[0]][1](kv[1], key, back)
        short = Memo(make, 100_000)
        made = lambda kv: short[kv] if len(kv[1]) <= 256 else make(kv)
        for batch in batches:
            texts = batch.column(1)
            new, spans = [], []
            for text in texts.to_pylist():
                one, own = replace(text, made) if text and _HAS.search(text) else (text, [])
                new.append(one)
                spans.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), pa.array(spans, _KINDS_OF)], ["rest", "text", "pii"])

    return run


#: Keys drawn for applications on a cluster, by application; nothing writes them down.
_DRAWN: dict[str, bytes] = {}


def session_key(spark: SparkSession, back: bool = False) -> bytes:
    """The key named by ``SETTING``; without it the public stand-in on one machine, on a cluster a random key of this application.

    Pseudonyms under a drawn key can be undone and repeated by the application alone that drew it; any other refuses to undo them.
    """
    named = spark.conf.get(SETTING, None)
    if named:
        return named.encode()
    if spark.sparkContext.master.startswith("local"):
        return KEY
    app = spark.sparkContext.applicationId
    if app not in _DRAWN:
        if back:
            raise RuntimeError(f"set {SETTING} to the key of the pseudonyms: this application has drawn none")
        warnings.warn(f"{SETTING} is not set: a random key is drawn, no later application can undo or repeat these pseudonyms", stacklevel=2)
        _DRAWN[app] = secrets.token_bytes(32)
    return _DRAWN[app]


def pseudonymise(docs: DataFrame, key: bytes | None = None, back: bool = False) -> DataFrame:
    """Rows (rest, text, pii): the other columns of ``docs`` as a struct, the text with pseudonyms, and what was replaced.

    Equal values get equal pseudonyms in every document; ``back`` undoes them. Null texts stay null, empty texts empty;
    numbers that fail their check stay. Time grows with the length of a text, whatever it holds. Repeated rows are treated alike; an empty table gives no rows.
    """
    key = key or session_key(docs.sparkSession, back)
    others = [c for c in docs.columns if c != "text"]
    base = docs.select(F.struct(*others).alias("rest"), F.col("text").cast("string").alias("text"))
    rest = base.schema["rest"].dataType.simpleString()
    return base.mapInArrow(_run(key, back), f"rest {rest}, text string, pii {SPANS}")


def masked(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """``docs`` with pseudonyms in its texts; n_chars, where it has it, is counted anew for texts that changed."""
    found, kinds = pseudonymise(docs, key), dict(docs.dtypes)
    cols = {c: F.col(f"rest.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.size("pii") > 0, F.length("text")).otherwise(cols["n_chars"])
    return found.select(*[cols[c].cast(kinds[c]).alias(c) for c in docs.columns])
