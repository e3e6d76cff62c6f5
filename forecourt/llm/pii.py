"""Format-preserving pseudonyms: validated numbers, dates and addresses are permuted within their format by a keyed Feistel network.

Equal values get equal pseudonyms in every document, so links stay, and none stays as it is; the key's holder can turn them
back. Days are the same in all forms of dates. Nothing is looked up or shuffled: each text is rewritten where it is.

Hosts of e-mail addresses stay: they name a provider, and links to it are of use; a host that is a person's own tells of it.
Days keep to their half of the month, to 12 or after, as only that tells 03/04 from 12/25 when it is turned back.
"""

from __future__ import annotations

import datetime
import math
import re
import secrets
import unicodedata
import warnings
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows

ROUNDS = 10
KINDS = ("email", "iban", "phone", "card", "ip", "ssn", "date")


#: The session setting that holds the key of pseudonyms.
KEY_SETTING = "spark.forecourt.pii.key"


def session_key(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING. Where none is set, a random one is made for the session, so that its pseudonyms can't be
    turned back by anybody who reads this code; set one to link them over sessions or to turn them back."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} isn't set: pseudonyms of this session use a random key", stacklevel=2)
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key.encode()


def permute(value: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """A keyed permutation of range(size) in which nothing stays in place, but for size 1: a step of one on the circle on which feistel() lays the values."""
    return feistel((feistel(value, size, key, kind) + (-1 if back else 1)) % size, size, key, kind, back=True)


def feistel(value: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """A keyed permutation of range(size): rounds on the two parts of value = left * b + right, walked on until inside."""
    a = math.isqrt(max(0, size - 1)) + 1
    b = -(-size // a)

    def add(r: int, half: int, m: int) -> int:
        said = f"{kind}:{size}:{r}:{half}".encode()
        return int.from_bytes(blake2b(said, key=key, digest_size=16 + a.bit_length() // 8).digest()) % m

    while True:
        left, right = divmod(value, b)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2:
                right = (right + sign * add(r, left, b)) % b
            else:
                left = (left + sign * add(r, right, a)) % a
        value = left * b + right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit of these digits."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c in "0123456789" else c for c in shape)


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def permute_digits(digits: str, kind: str, key: bytes, back: bool) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, f"{kind}{len(digits)}", back)).zfill(len(digits))


#: Signs of which the neighbours in Unicode are looked at for an alphabet.
NEAR = 64


@lru_cache(maxsize=10_000)
def alphabet(sign: str) -> tuple[str, str]:
    """(its name, its signs): the letters or digits of the same kind, case and script near a letter or digit; others: ''.

    A letter with a case keeps to those that have the other case as one letter, so that case can be told again."""
    kind = unicodedata.category(sign)
    if kind not in ("Ll", "Lu", "Lo", "Lm", "Nd", "Nl"):
        return "", ""
    first = ord(sign) // NEAR * NEAR

    def script(c: str) -> str:
        return unicodedata.name(c, "").split(" ")[0]

    near = map(chr, range(first, first + NEAR))
    return f"{first:x}{kind}{script(sign)}", "".join(c for c in near if unicodedata.category(c) == kind and script(c) == script(sign))


def permute_signs(text: str, kind: str, key: bytes, back: bool) -> str | None:
    """Letters and digits as one number in a mixed radix; other signs stay. None if there is nothing to choose from."""
    own = [alphabet(c) for c in text]
    value, size = 0, 1
    for c, (_, a) in zip(text, own):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    if size == 1:
        return None
    shape = "".join(f"[{name}]" if a else c for (name, a), c in zip(own, text))
    value = permute(value, size, key, f"{kind}:{shape}", back)
    new = []
    for c, (_, a) in zip(reversed(text), reversed(own)):
        if a:
            value, i = divmod(value, len(a))
            c = a[i]
        new.append(c)
    return "".join(reversed(new))


def email(text: str, key: bytes, back: bool) -> str | None:
    name, _, host = text.rpartition("@")
    new = permute_signs(name, "email", key, back)
    return None if new is None else f"{new}@{host}"


def iban(text: str, key: bytes, back: bool) -> str | None:
    def check(country: str, rest: str) -> int:
        return 98 - int("".join(str(int(c, 36)) for c in f"{rest}{country}00")) % 97

    plain = text.replace(" ", "")
    country, rest = plain[:2], plain[4:]
    if not 15 <= len(plain) <= 34 or int(plain[2:4]) != check(country, rest):
        head, _, word = text.rpartition(" ")  # a following word in capitals
        return f"{new} {word}" if head and (new := iban(head, key, back)) else None
    rest = permute_signs(rest, f"iban{country}", key, back)
    new = iter(f"{country}{check(country, rest):02d}{rest}")
    return "".join(c if c == " " else next(new) for c in text)


#: Country codes, with the most digits that follow them; other codes have three digits and up to MOST_DIGITS.
MOST_DIGITS = 10
COUNTRIES = {"1|7|44": 10, "3[123469]|41": 9, "39|49": 11, "2[07]|30|4[03578]|5[1-8]|6[0-6]|8[1246]|9[0-58]": MOST_DIGITS}
CODE = re.compile(rf"\+({'|'.join(COUNTRIES)}|[0-9]{{3}})")


def phone(text: str, key: bytes, back: bool) -> str | None:
    """All digits after the country code, or all of them."""
    at = m.end() if (m := CODE.match(text)) else 0
    return text[:at] + refill(text[at:], permute_digits(digits_of(text[at:]), "phone", key, back))


def is_card(digits: str) -> bool:
    return luhn(digits[:-1]) == int(digits[-1]) and len(set(digits)) > 1


#: How the cards that stand beside other numbers begin; these have at most GROUPS groups, all but the last of three digits or more.
ISSUER = re.compile("[3-6]|2[2-7]")
GROUPS = 5
#: How cards are grouped; of sequences that overlap, one grouped as an earlier of these is the card, then the longest. One group comes first.
GROUPED = [(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 5), (4, 4, 4, 4, 3)]


def other_card(digits: str, key: bytes, back: bool) -> str:
    """The card that stands for a card, wherever it stands: of the same length, with an issuer that ISSUER knows if it has one, else without."""
    known = bool(ISSUER.match(digits))
    while True:
        body = permute_digits(digits[:-1], "card", key, back)
        digits = f"{body}{luhn(body)}"
        if bool(ISSUER.match(digits)) == known and is_card(digits):
            return digits


class Run:
    """Groups of digits between single spaces or hyphens, and which of their sequences may be a card.

    These are all groups together, of any issuer, and any sequence grouped as cards are. Which they are, and which of two that overlap goes first, depends on the lengths of the groups alone, so it is the same for a text and its pseudonyms."""

    def __init__(self, text: str):
        self.text = text
        groups = [m.span() for m in re.finditer("[0-9]+", text)]
        sizes = [b - a for a, b in groups]
        spans: dict[tuple[int, int], bool] = {}  # True: of any issuer
        form: dict[tuple[int, int], int] = {}
        for i in range(len(groups)):
            n = 0
            for j in range(i, min(i + GROUPS, len(groups))):
                n += sizes[j]
                if 13 <= n <= 19:
                    span, own = (groups[i][0], groups[j][1]), tuple(sizes[i : j + 1])
                    spans[span] = False
                    form[span] = -1 if i == j else GROUPED.index(own) if own in GROUPED else len(GROUPED)
                if n > 19 or sizes[j] < 3:
                    break
        if 13 <= sum(sizes) <= 19:
            spans[groups[0][0], groups[-1][1]] = True
        self.length = {s: len(digits_of(text[slice(*s)])) for s in spans}
        self.spans = sorted(spans, key=lambda s: (form.get(s, len(GROUPED)), -self.length[s], s))
        self.any = spans
        self.valid = {s: self.check(s) for s in self.spans}

    def check(self, span: tuple[int, int]) -> bool:
        digits = digits_of(self.text[slice(*span)])
        return bool(self.any[span] or ISSUER.match(digits)) and is_card(digits)

    def put(self, span: tuple[int, int], digits: str) -> None:
        a, b = span
        self.text = self.text[:a] + refill(self.text[a:b], digits) + self.text[b:]
        for s in self.spans:
            if s[0] < b and a < s[1]:
                self.valid[s] = self.check(s)

    def cards(self) -> list[tuple[int, int]]:
        """The cards, of those that overlap the one of the commonest form, then the longest, then the first."""
        found: list[tuple[int, int]] = []
        for s in self.spans:
            if self.valid[s]:
                at = bisect_left(found, s)
                if (at == 0 or found[at - 1][1] <= s[0]) and (at == len(found) or s[1] <= found[at][0]):
                    found.insert(at, s)
        return found


def cards(text: str, key: bytes, back: bool) -> tuple[str, int]:
    """text, a run of groups of digits, with the pseudonyms of its cards, and how many there are.

    A card has the same pseudonym in every run. Only where the run would be read otherwise with it, as groups beside the card would
    make a card with a part of it, is it passed on to the next one, so that all turn back."""
    run = Run(text)
    found = run.cards()
    for span in reversed(found) if back else found:
        digits = digits_of(run.text[slice(*span)])
        while True:
            digits = other_card(digits, key, back)
            run.put(span, digits)
            if run.cards() == found:
                break
    return run.text, len(found)


def ip(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    value = permute(int.from_bytes(bytes(map(int, parts))), 1 << 32, key, "ip", back)
    return ".".join(map(str, value.to_bytes(4)))


def ssn(text: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(permute(value, 898 * 99 * 9999, key, "ssn", back), 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


FIRST, LAST = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


@lru_cache(maxsize=2)
def days(late: bool) -> list[int]:
    """Days after FIRST, in order, that lie in the first twelve of their month, or after these."""
    return [i for i in range((LAST - FIRST).days + 1) if ((FIRST + datetime.timedelta(i)).day > 12) == late]


def other_day(day: datetime.date, key: bytes, back: bool) -> datetime.date:
    own = days(day.day > 12)
    place = bisect_left(own, (day - FIRST).days)
    return FIRST + datetime.timedelta(own[permute(place, len(own), key, f"date{day.day > 12}", back)])


def date(text: str, key: bytes, back: bool) -> str | None:
    """yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd/mm/yyyy, dd-mm-yyyy from 1900 to 2099, and mm/dd/yyyy where only that is a date.

    A day has the same pseudonym in all of them."""
    a, b, c = re.split("[-/.]", text)
    separators = re.findall("[-/.]", text)
    if separators[0] != separators[1]:
        return None

    def day(y: str, m: str, d: str) -> datetime.date | None:
        try:
            found = datetime.date(int(y), int(m), int(d))
        except ValueError:
            return None
        return found if FIRST <= found <= LAST else None

    sep = separators[0]
    if len(a) == 4:
        found, form = day(a, b, c), f"%Y{sep}%m{sep}%d"
    else:
        found, form = day(c, b, a), f"%d{sep}%m{sep}%Y"
        if not found and sep == "/":
            found, form = day(c, a, b), "%m/%d/%Y"
    return other_day(found, key, back).strftime(form) if found else None


EMAIL = re.compile(r"(?<![\w.%+'-])[\w.%+'-]{1,64}@(?:[\w-]{1,63}\.){1,8}(?:[^\W\d_]{2,63}|xn--[A-Za-z0-9-]{1,59})")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
#: A time may follow the day of a timestamp.
DATE = r"(?:[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}(?=T[0-9]{2}:[0-9]{2})|(?:[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})(?![\w/-]|\.[0-9]))"
PLAIN_PHONE = r"[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w-])"
#: The country code, an area code or (0) in parentheses, and at least six digits.
ABROAD = "|".join(rf"(?:{code})(?:[ .-]?\([0-9]{{1,4}}\))?(?:[ .-]?[0-9]){{6,{most}}}(?![0-9])" for code, most in [*COUNTRIES.items(), ("[0-9]{3}", MOST_DIGITS)])
NUMBER = re.compile(
    r"(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    rf"|(?<![\w+])\+(?:{ABROAD})"
    r"|(?<!\w)\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    rf"|(?<![\w.+-]){PLAIN_PHONE})"
    rf"|(?P<ip>(?<![\w.]){IP})"
    rf"|(?P<ssn>(?<![\w-]){SSN})"
    rf"|(?P<date>(?<![\w./-]){DATE})"
    rf"|(?P<card>(?<![\w-])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9](?:[0-9]|-[0-9]| (?!{IP}|{SSN}|{DATE}|{PLAIN_PHONE})[0-9])+(?![\w-]))"
)
#: Without any of these a text has no value of any kind.
NEEDED = re.compile("[0-9@]")
RULES: dict[str, Callable[[str, bytes, bool], str | None]] = {"email": email, "iban": iban, "phone": phone, "ip": ip, "ssn": ssn, "date": date}


def rewrite(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """text with the pseudonyms, and how many values of each kind were replaced. What isn't valid stays as it is."""
    found: dict[str, int] = {}

    def put(m: re.Match, kind: str | None = None) -> str:
        kind = kind or m.lastgroup
        if kind == "card":
            new, n = cards(m[0], key, back)
            if n:
                found[kind] = found.get(kind, 0) + n
            return new
        new = RULES[kind](m[0], key, back)
        if new is None or new == m[0]:
            return m[0]
        found[kind] = found.get(kind, 0) + 1
        return new

    if not NEEDED.search(text):
        return text, found
    # What lies between addresses is searched for numbers; a pseudonym is never searched again.
    spans = [(m, "email") for m in EMAIL.finditer(text)] if "@" in text else []
    spans += [(m, "iban") for m in IBAN.finditer(text)]
    parts, at = [], 0
    for m, kind in sorted(spans, key=lambda x: x[0].start()):
        if m.start() >= at and (new := put(m, kind)) != m[0]:
            parts += [NUMBER.sub(put, text[at : m.start()]), new]
            at = m.end()
    return "".join([*parts, NUMBER.sub(put, text[at:])]), found


def pseudonymize(docs: DataFrame, key: bytes, counts: bool = False, back: bool = False) -> DataFrame:
    """docs with its text rewritten and all columns kept; with counts, also n_<kind> (int) for each kind.

    Kinds: e-mail addresses (the name before the @), IBANs with right check digits, phone numbers with a country code, an area
    code in parentheses or as 555-123-4567, card numbers of 13 to 19 digits with a right check digit, also beside other
    numbers, IPv4 addresses, US social security numbers, dates. Check digits are right again afterwards and separators stay. back: the reverse, with the same key. Null text stays null
    and counts 0; empty tables, repeated rows and null ids pass through. With counts, a column of the name of one of them raises
    a ValueError. Only values that have changed are counted."""
    columns = docs.columns
    added = [f"n_{k}" for k in KINDS] if counts else []
    if clash := set(added) & set(columns):
        raise ValueError(f"columns in use: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [rewrite(t, key, back) if (t := x.as_py()) is not None else (None, {}) for x in b.column("text")]
            texts = pa.array([t for t, _ in done], b.schema.field("text").type)
            names = b.schema.names
            arrays = [texts if c == "text" else b.column(c) for c in names]
            arrays += [pa.array([n.get(k, 0) for _, n in done], pa.int32()) for k in KINDS if counts]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *added])

    return map_rows(docs, run, ", ".join(f"{c} int" for c in added))
