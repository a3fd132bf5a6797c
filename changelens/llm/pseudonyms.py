"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

A value that is found and valid (a card number with its check digit, a real calendar date, an address of four octets ...) is a number in the
finite set of valid values of its format.  A Feistel network with a keyed hash as its round function permutes a set just large enough; walking on
until the result is valid again makes it a permutation of the valid values.  The value is written in the format it was found in.  So equal values get equal
pseudonyms in every document, different values different ones, and whoever has the key can go back.

Dates are those from 1900 to 2099 as yyyy-mm-dd, yyyy/mm/dd, and with slashes or full stops day first, or month first where day first is no
calendar date.  Phone numbers are international ones after a plus sign and ten digits in groups of 3, 3 and 4, joined by hyphens, full stops or
spaces, the first also in brackets.  Keys are 32 to 64 hexadecimal digits of either case after a word such as "token" and a sign; one of mixed
case is written in lower case.  Left out: dates with month names, years of two digits, dates run together with other digits, d-m-yyyy with
hyphens and yyyy.mm.dd; phone numbers of ten digits in one piece, other national ones without a plus sign, and extensions; IPv6 addresses; keys
that are not hexadecimal, of another length, or without such a word; names and postal addresses.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10


@dataclass
class Feistel:
    """Keyed permutations of range(n), one for each kind of value."""

    key: bytes

    def _round(self, kind: str, n: int, i: int, half: int) -> int:
        text = f"{kind}|{n}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=32).digest(), "big")

    def once(self, kind: str, n: int, x: int, back: bool = False) -> int:
        """One pass over range(a * b), the smallest near-square set that holds range(n); it may leave range(n)."""
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._round(kind, n, i, left)) % b
            else:
                left = (left + sign * self._round(kind, n, i, right)) % a
        return left * b + right

    def permute(self, kind: str, n: int, x: int, valid: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """Walks along the cycle of x to the next valid number below n."""
        while True:
            x = self.once(kind, n, x, back)
            if x < n and valid(x):
                return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _shaped(shape: str, digits: str) -> str:
    """The digits in the places of the digits of `shape`."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


FIRST_DAY, DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()
#: The order matters: where patterns begin at one place, the first wins.
PATTERNS = {
    # from the beginning of a run of such signs, so a local part of any length is found whole and each run is read once
    "email": r"(?<![A-Za-z0-9._%+-])(?P<email>[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})",
    "iban": r"(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?P<ip>(?:\d{1,3}\.){3}\d{1,3})(?![\d]|\.\d)",
    # where a number ends within the run of digits is for _next_card to say
    "card": r"(?<![\d-])(?P<card>\d(?:[ -]?\d){12,18})",
    "ssn": r"(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d]|-\d)",
    "date": r"(?<![\d])(?P<date>\d{4}-\d{2}-\d{2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\d])",
    "phone": r"(?<![\d+])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4})(?![\d]|-\d)",
    "secret": r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|key))[\"']?\s*[:=]\s*[\"']?(?P<secret>[0-9A-Fa-f]{32,64})(?![0-9A-Za-z])",
}
PATTERN = re.compile("|".join(PATTERNS.values()))
#: One by one: where the first that matches is not valid, those after it are tried at the same place.
KINDS = list(PATTERNS)
SINGLE = {kind: re.compile(p) for kind, p in PATTERNS.items()}
TOKEN = re.compile(r"[^\W_]+|.", re.DOTALL)
DIGITS = re.compile(r"\d+")
#: Length of an IBAN by its country (registry of SWIFT).
IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}
#: A text without any of these signs holds no value of any kind.
SIGNS = re.compile(r"[0-9@]")


@dataclass
class Pseudonyms:
    """Pseudonyms under one key; `of(kind, value)` is None where the value is not valid, and then stays as it is."""

    feistel: Feistel

    def of(self, kind: str, value: str) -> str | None:
        return getattr(self, f"_{kind}")(value)

    def _email(self, value: str) -> str:
        # the local part as a word over its own kinds of signs; the domain is shared by many and names nobody
        local, at, domain = value.partition("@")
        sets = ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else c for c in local]
        n = math.prod(map(len, sets))
        if n < 2:
            return value
        x = 0
        for c, s in zip(local, sets, strict=True):
            x = x * len(s) + s.index(c)
        shape = "".join(s[0] for s in sets)
        x = self.feistel.permute(f"email{shape}@{domain.lower()}", n, x)
        out = []
        for s in reversed(sets):
            x, i = divmod(x, len(s))
            out.append(s[i])
        return "".join(reversed(out)) + at + domain

    def _digits(self, kind: str, value: str, fixed: int, valid: Callable[[str], bool]) -> str | None:
        """Permutes the digits after the first `fixed` ones among those with which the whole is valid."""
        digits = "".join(c for c in value if c.isdigit())
        head, rest = digits[:fixed], digits[fixed:]
        if not valid(digits):
            return None
        x = self.feistel.permute(f"{kind}{len(digits)}|{head}", 10 ** len(rest), int(rest), lambda y: valid(f"{head}{y:0{len(rest)}d}"))
        return _shaped(value, f"{head}{x:0{len(rest)}d}")

    def _card(self, value: str) -> str | None:
        return self._digits("card", value, 0, lambda d: luhn(d) and len(set(d)) > 1)

    def _ssn(self, value: str) -> str | None:
        return self._digits("ssn", value, 0, lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000")

    def _phone(self, value: str) -> str | None:
        digits = sum(c.isdigit() for c in value)
        country = re.match(r"\+(\d{1,3}?)(?=[ .(-]|\d)", value)
        return self._digits("phone", value, len(country.group(1)) if country else 0, lambda d: 7 <= digits <= 15)

    def _ip(self, value: str) -> str | None:
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255:
            return None
        x = self.feistel.permute("ip", 1 << 32, int.from_bytes(bytes(octets), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _date(self, value: str) -> str | None:
        parts, marks = re.split(r"[-./]", value), re.findall(r"[-./]", value)
        # day first; month first where that is no calendar date.  Those have days above 12, so that neither order's dates become the other's
        orders = ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy")
        for order in orders:
            at = dict(zip(order, map(int, parts), strict=True))
            try:
                x = date(at["y"], at["m"], at["d"]).toordinal() - FIRST_DAY
                break
            except ValueError:
                continue
        else:
            return None
        if not 0 <= x < DAYS:
            return None
        valid = (lambda y: date.fromordinal(FIRST_DAY + y).day > 12) if order == "mdy" else (lambda _: True)
        got = date.fromordinal(FIRST_DAY + self.feistel.permute("date-mdy" if order == "mdy" else "date", DAYS, x, valid))
        new = {"y": got.year, "m": got.month, "d": got.day}
        # one digit or two as found, where the number allows it
        shown = [f"{new[o]:0{len(p)}d}" for o, p in zip(order, parts, strict=True)]
        return shown[0] + marks[0] + shown[1] + marks[1] + shown[2]

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
            return None
        body = plain[4:]
        sets = ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in body]
        x = 0
        for c, s in zip(body, sets, strict=True):
            x = x * len(s) + s.index(c)
        x = self.feistel.permute(f"iban{plain[:2]}{''.join(s[0] for s in sets)}", math.prod(map(len, sets)), x)
        out = []
        for s in reversed(sets):
            x, i = divmod(x, len(s))
            out.append(s[i])
        body = "".join(reversed(out))
        plain = f"{plain[:2]}{98 - _iban_rest(plain[:2] + '00' + body):02d}{body}"
        it = iter(plain)
        return "".join(c if c == " " else next(it) for c in value)

    def _secret(self, value: str) -> str:
        got = f"{self.feistel.permute(f'secret{len(value)}', 16 ** len(value), int(value, 16)):0{len(value)}x}"
        return got.upper() if value == value.upper() != value.lower() else got

    def _next_card(self, text: str, at: int) -> tuple[tuple[int, int] | None, int]:
        """(start, end) of the first valid card number in the run of digit groups from `at` on, or None, and the end of what was looked at.

        A number begins and ends at borders of groups.  Where several overlap, usual layouts win, then earlier starts, then longer numbers.
        """
        groups, found, i = [], [], 0
        while True:
            # no more groups than a number can have are looked at ahead
            while len(groups) < i + 19 and (m := DIGITS.match(text, at)):
                groups.append(m.span())
                at = m.end() + 1 if text[m.end() : m.end() + 1] in (" ", "-") else len(text)
            if i == len(groups) or found and groups[i][0] >= found[0][1]:
                break
            digits = ""
            for j, (a, b) in enumerate(groups[i : i + 19], 1):
                digits += text[a : min(b, a + 20)]
                if len(digits) > 19:
                    break
                if len(digits) >= 13 and self._card(digits) is not None:
                    sizes = [d - c for c, d in groups[i : i + j]]
                    value, before = text[groups[i][0] : b], text[max(0, groups[i][0] - 1) : groups[i][0]]
                    # one kind of sign between groups, and no group cut off from a hyphen before it
                    even = not (" " in value and "-" in value + before)
                    usual = even and digits[0] != "0" and (j == 1 or sizes in ([4, 6, 5], [4, 6, 4]) or set(sizes[:-1]) == {4} and sizes[-1] <= 4)
                    found.append((groups[i][0], b, not usual, -len(digits)))
            found.sort(key=lambda f: (f[0], f[3]))
            i += 1
        if not found:
            return None, groups[-1][1] if groups else 0
        best = min(found, key=lambda f: (f[2], f[0], f[3]))
        return best[:2], best[1]

    def _iban_end(self, value: str) -> int | None:
        """The end of the valid IBAN that `value` begins with: of its country's length, else the longest that ends at a border of groups."""
        size, seen, ends = IBAN_LENGTHS.get(value[:2]), 0, []
        for at, c in enumerate(value, 1):
            seen += c != " "
            if c != " " and (at == len(value) or value[at] == " "):
                ends.append((seen != size, -at))
        return next((-at for _, at in sorted(ends) if self._iban(value[:-at]) is not None), None)

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with every valid value replaced, and (kind, start, end) of each in the text given.

        Where a match is not valid, its shorter forms and the other kinds are tried at its start, and the search goes on one token later.
        """
        if not SIGNS.search(text):
            return text, []
        out, found, last, pos, card, looked = [], [], 0, 0, None, 0

        def put(kind: str, start: int, end: int, got: str) -> None:
            nonlocal last
            out.extend((text[last:start], got))
            found.append((kind, start, end))
            last = end

        while True:
            m = PATTERN.search(text, pos)
            if m and card is None and m.lastgroup == "card" and m.start() >= looked:
                card, looked = self._next_card(text, m.start())
            if card and (m is None or m.start() >= card[0]):
                start, pos = card
                put("card", start, pos, self._card(text[start:pos]))
                # a further number of the same run may follow after a hyphen
                card, looked = self._next_card(text, pos + 1) if text[pos : pos + 1] in (" ", "-") else (None, pos)
                continue
            if m is None:
                break
            for kind in KINDS[KINDS.index(m.lastgroup) :]:
                one = m if kind == m.lastgroup else SINGLE[kind].match(text, m.start())
                if one is None or kind == "card":
                    continue
                start, end = one.span(kind)
                if kind == "iban":
                    end = start + (self._iban_end(one.group(kind)) or 0)
                # the digits of a card number are not taken for the end of something else
                if card and end > card[0] or end == start:
                    continue
                if (got := self.of(kind, text[start:end])) is not None:
                    put(kind, start, end, got)
                    pos = end
                    break
            else:
                pos = TOKEN.match(text, m.start()).end()
        return ("".join([*out, text[last:]]), found) if found else (text, [])


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", found_col: str | None = "found") -> DataFrame:
    """`docs` with `text_col` replaced, and `found_col`: array<struct<kind, start, end>> in code points of the text before.

    One pass in place, no shuffle and no row dropped; whole texts however long, with work in proportion to their length.  A null text stays null with nothing found (an empty array), an empty one empty.  Other
    columns stay as they are, a column called like `found_col` is replaced.
    """
    kind = "struct<text:string,found:array<struct<kind:string,start:int,end:int>>>"
    arrow = pa.struct([("text", pa.string()), ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])

    def run(texts: pa.Array) -> pa.Array:
        names = Pseudonyms(Feistel(key))
        out = []
        for t in texts.to_pylist():
            text, found = (None, []) if t is None else names.replace(t)
            out.append({"text": text, "found": [dict(zip(("kind", "start", "end"), f, strict=True)) for f in found]})
        return pa.array(out, arrow)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # a generator between, so that the function runs once for both columns
    names = [c for c in docs.columns if c != found_col]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")  # all columns in one, so that none can clash with the new ones
    done = docs.select(row, F.explode(F.array(F.arrow_udf(run, kind)(F.col(f"`{text_col}`").cast("string")))).alias("done"))
    return done.select(*[F.col("done.text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in names], *([F.col("done.found").alias(found_col)] if found_col else []))
