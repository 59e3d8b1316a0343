"""Personal data: exact base patterns, plus wide candidate spans that boosted trees accept or reject by format and context."""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import BoostedTrees
from .common import giving_back, small_batches

KINDS = ["email", "ip", "card", "phone"]
#: Also those that only the method finds.
ALL_KINDS = [*KINDS, "secret"]

#: The base patterns. A digit run's head need not be tried inside the run, which fails just as at its start.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HAS_DIGITS = re.compile(r"[0-9][\x20-]?[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches around each @: the widest local part that the previous match leaves, then the domain. Linear in the text."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), "email"
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns, by start, then kind as listed. Offsets are code points, ends exclusive."""
    found = list(_emails(text)) if "@" in text else []
    if _HAS_DIGITS.search(text) or "." in text:
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 40:
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# --- candidates beyond the base patterns

_RUN = re.compile(r"[0-9]++(?:[ ().\-/·:]++[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_IP_LOOSE = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|,|·)\s?[0-9]{1,3}){3}(?![0-9.])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", re.I)
_EMAIL_LOOSE = re.compile(
    r"(?<![A-Za-z0-9._+-])[A-Za-z0-9][A-Za-z0-9._+-]*+\s?(?:\[at\]|\(at\)|\{at\}|<at>|\(@\)|\[@\]| @ ?|@ )\s?[A-Za-z0-9-]++(?:\s?(?:\.|\[dot\]|\(dot\)|\{dot\}|\[\.\])\s?[A-Za-z]{2,}+)+"
    r"|(?<![A-Za-z0-9._+-])[A-Za-z0-9][A-Za-z0-9._+-]*+ at [A-Za-z0-9-]++(?: dot [A-Za-z]{2,}+)+", re.I)
_BRACKET_AT = re.compile(r"[\[({<](?:at|@)[\])}>]|@ | @| dot ", re.I)
_IP_HINT = re.compile(r"[0-9](?:\[|\(|·|\s?,)|:[0-9A-Fa-f]{1,4}:", re.I)
_SEVEN = re.compile(r"[0-9][0-9 ().\-/·:]{5}")
_IN_RUN = "0123456789 ().-/·:"
_DIGITS = frozenset("0123456789")
_WORD = re.compile(r"[^\W\d_]+")
#: A run that may be a key or password: after a word that announces one, or long with letters and digits in it.
_NAMES = r"(?:passw(?:or[dt]|d)|pwd|secret|token|key|contraseña|clave|passe|bearer|credentials?)[\"']?"
_GIVEN = re.compile(_NAMES + r"\s*[:= ]\s*[\"']?([^\s\"',;]{6,}+)", re.I)
_ANNOUNCED = re.compile(_NAMES + r"\s{0,3}[:=]\s{0,3}[\"']?\Z", re.I)
_OPAQUE = re.compile(r"[A-Za-z0-9_+/=-]{16,}+")
#: Without any of these, lower-cased, the words above are not there.
_STEMS = ("pass", "pwd", "secret", "token", "key", "contrase", "clave", "bearer", "credential")
_DIGIT = re.compile("[0-9]")

#: Words that announce each kind in the four languages at hand.
CUES = {
    "email": {"mail", "email", "e", "contact", "write", "correo", "courriel", "schreiben"},
    "ip": {"ip", "host", "server", "address", "addr", "adresse", "dirección", "serveur"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta", "cc"},
    "phone": {"phone", "tel", "telephone", "mobile", "call", "fax", "cell", "telefon", "téléphone", "teléfono", "appelez", "anrufen", "llame"},
    "secret": {"password", "passwd", "pwd", "secret", "token", "key", "apikey", "passwort", "contraseña", "clave", "passe", "bearer", "credential", "credentials"},
    "hash": {"sha", "sha1", "sha256", "md", "md5", "commit", "hash", "checksum", "digest", "uuid", "guid", "etag", "file", "http", "https", "www", "path"},
    "not": {"isbn", "order", "invoice", "version", "page", "pages", "date", "no", "id", "ref", "article", "rev", "build", "year", "total"},
}


def _run_spans(text: str, start: int, end: int) -> Iterator[Span]:
    """All spans of whole digit groups of a run that have a phone's, card's or address's number of digits, so at most 19 for
    each group. A plus or an opening bracket before the first group belongs to the span."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    for i, (s, _) in enumerate(groups):
        if s and text[s - 1] in _LETTERS:
            continue
        at, n = s, 0
        if s and text[s - 1] in "([+" and not (s > 1 and (text[s - 2] in _LETTERS or text[s - 2] in "0123456789")):
            at = s - 1
        for j in range(i, len(groups)):
            a, b = groups[j]
            n += b - a
            if n > 19:
                break
            if b < len(text) and text[b] in _LETTERS:
                continue
            if 7 <= n <= 15:
                yield at, b, "phone"
            if 12 <= n <= 19:
                yield at, b, "card"
            if j == i + 3 and n <= 12:
                octets = text[s:b].split(".")
                if len(octets) == 4 and all(q.isdigit() and int(q) <= 255 for q in octets):
                    yield s, b, "ip"


def _secret_spans(text: str) -> Iterator[Span]:
    low = text.lower()
    for m in _GIVEN.finditer(text) if any(x in low for x in _STEMS) else ():
        yield m.start(1), m.end(1), "secret"
    for m in _OPAQUE.finditer(text) if _DIGIT.search(text) else ():
        digits = sum(c.isdigit() for c in m[0])
        if digits and digits < len(m[0]):
            at = m.start() + max(0, m[0].rstrip("=").rfind("=") + 1)  # a name and = may stand before it
            if m.end() - at >= 16:
                yield at, m.end(), "secret"


def candidates(text: str) -> list[Span]:
    """Wide proposals, which may overlap each other: (start, end, kind)."""
    out: list[Span] = []
    if _SEVEN.search(text):
        for m in _RUN.finditer(text):
            if m.end() - m.start() >= 7:
                out += _run_spans(text, m.start(), m.end())
    if _IP_HINT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP_LOOSE.finditer(text)]
    out += _secret_spans(text)
    if _BRACKET_AT.search(text):
        out += [(m.start(), m.end(), "email") for m in _EMAIL_LOOSE.finditer(text)]
    return out


def _beside(text: str, span: Span) -> tuple[int, int]:
    """Digit groups of the same run close before and after the span."""
    before, after = text[max(0, span[0] - 32) : span[0]], text[span[1] : span[1] + 32]
    left, right = before[len(before.rstrip(_IN_RUN)) :], after[: len(after) - len(after.lstrip(_IN_RUN))]
    return len(_GROUP.findall(left)), len(_GROUP.findall(right))


def _twins(text: str, span: Span) -> int:
    """Of the stretches of the same run right before and after a card's span, with digit groups as long as its own, those that pass Luhn too."""
    s, e, kind = span
    if kind != "card":
        return 0
    lens = [len(g) for g in _GROUP.findall(text, s, e)]
    k, reach, found = len(lens), 2 * (e - s), 0
    for lo, hi, pick in ((max(0, s - reach), s, slice(-k, None)), (e, e + reach, slice(0, k))):
        groups = list(_GROUP.finditer(text, lo, hi))[pick]
        if [len(m[0]) for m in groups] == lens and all(c in _IN_RUN for c in text[min(groups[0].start(), e) : max(groups[-1].end(), s)]):
            whole = text[groups[0].start() - 1 : groups[0].start()] not in _DIGITS and text[groups[-1].end() : groups[-1].end() + 1] not in _DIGITS
            found += whole and luhn("".join(m[0] for m in groups))
    return found


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    s, e, kind = span
    part = text[s:e]
    digits = "".join(c for c in part if c in "0123456789")
    groups = re.findall(r"[0-9]+", part)
    lens = [len(g) for g in groups]
    before, after = text[max(0, s - 32) : s], text[e : e + 12]
    words = {w.lower() for w in _WORD.findall(before)}
    seps = re.sub(r"[0-9A-Za-z]", "", part)
    octets = len(groups) == 4 and all(int(g) <= 255 for g in groups)
    return [
        ALL_KINDS.index(kind), len(digits), len(groups), max(lens, default=0), min(lens, default=0), lens[-1] if lens else 0, lens[0] if lens else 0,
        float(bool(digits) and luhn(digits)), float(octets), seps.count("-"), seps.count("."), seps.count(" "), seps.count("/"), seps.count(":"),
        float("(" in seps and ")" in seps), float(part[:2] == "00"), float(digits[:1] in "3456" and bool(digits)), float(len(set(digits))),
        float(bool(re.fullmatch(r"(?:19|20)\d\d[-/.]\d\d?[-/.]\d\d?.*|\d\d?[-/.]\d\d?[-/.](?:19|20)\d\d.*", part))),
        float(bool(re.search(r"[\[({<]\s?(?:at|@)\s?[\])}>]", part, re.I))), float(bool(re.search(r"[\[({<]?\s?dot\s?[\])}>]?", part, re.I))), float("@" in part),
        float(" at " in part), *(float(bool(words & CUES[k])) for k in ("email", "ip", "card", "phone", "secret", "hash", "not")), float(before[-2:-1] == ":" or before[-1:] == ":"),
        float(bool(before[-1:]) and before[-1:].isalnum()), float(bool(after[:1]) and after[:1] in "%€$£"), float(bool(before[-1:]) and before[-1:] in "€$£#/-."), float(len(part)),
        float(part[:1] == "+"), *map(float, _beside(text, span)), float(_twins(text, span)), float(bool(re.search(r"\+[0-9]{1,3}[ .-]?[(]?\Z", before))), *_texture(part, before),
    ]


def _texture(part: str, before: str) -> list[float]:
    """How a run of characters is made: shares of their classes, changes between them, entropy, and what stands right before."""
    n = len(part)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in part]
    share = Counter(kinds)
    spread = -sum(v / n * math.log2(v / n) for v in Counter(part).values())
    return [
        share["d"] / n, share["u"] / n, share["l"] / n, share["o"] / n, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, spread,
        float(max((len(x) for x in _WORD.findall(part)), default=0)), float(all(c in "0123456789abcdef" for c in part.lower())), float("=" in before[-3:]), float(before[-1:] in "\"'"),
        float(bool(_ANNOUNCED.search(before))),
    ]


def _made_example(r: random.Random) -> tuple[str, Span, int]:
    """One synthetic labelled example: (text, span, 1 for personal data)."""
    filler = lambda n: " ".join("".join(r.choice("aeinorstlhd") for _ in range(r.randint(2, 9))) for _ in range(n))
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))

    def card(n: int) -> str:
        x = r.choice("3456") + d(n - 2)
        return x + next(c for c in "0123456789" if luhn(x + c))

    def no_card(n: int) -> str:
        return next(x for x in iter(lambda: d(n), "") if not luhn(x))

    def spaced(x: str, sep: str) -> str:
        return sep.join(x[i : i + 4] for i in range(0, len(x), 4))

    kind, good = r.choice(ALL_KINDS), r.random() < 0.5
    joint = ""
    if kind == "secret":
        hexes, mixed, upper = (lambda n, a=a: "".join(r.choice(a) for _ in range(n)) for a in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
        form = r.randrange(4)
        if good and form < 2:  # announced by name
            joint = r.choice(["=", ": ", " = ", " = \"", "=\"", ": '"])
            span = r.choice([lambda: hexes(r.randint(8, 64)), lambda: mixed(r.randint(8, 48)), lambda: name() + d(r.randint(2, 6)), lambda: name().capitalize() + r.choice("!#$%&") + d(4)])()
        elif good:  # by its form alone
            span = r.choice([lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4)) + upper(r.choice([12, 16, 16, 20])), lambda: mixed(r.randint(28, 64)), lambda: f"{name()[:3]}_{mixed(r.randint(24, 40))}", lambda: f"{name()[:2]}-{mixed(r.randint(28, 48))}"])()
            if not any(c.isdigit() for c in span):
                span = span[:-1] + d(1)
        else:
            span = r.choice([
                lambda: r.choice("-_/").join([name()[: r.randint(2, 9)] for _ in range(r.randint(3, 6))] + [d(r.choice([1, 2, 4]))]), lambda: f"{name()}_{name()}_{d(4)}{d(4)}", lambda: f"{name()}/{name()}/{d(4)}/{name()}", lambda: f"20{d(2)}-{d(2)}-{d(2)}T{d(6)}Z", lambda: name() * 3 + d(1),
                lambda: f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", lambda: hexes(r.choice([32, 40, 64])), lambda: f"{name().upper()}-{d(4)}-{d(6)}-{d(2)}", lambda: f"{d(6)}-{d(6)}-{name()}"])()
            if not any(c.isdigit() for c in span):
                span += d(1)
            while len(span) < 16:
                span += "-" + name()
            if form == 0:  # a word after a cue in plain prose is no secret
                joint, span = " ", name() + name()[:3]
        if joint.strip() or (joint and not good):
            cue = r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "key", "Password", "access token", "Passwort", "clave", "mot de passe"])
        else:
            cue = r.choice(["", "", "file ", "commit ", "sha256 ", "uuid "]) if not good else ""
            joint = ""
        head = filler(r.randint(0, 6)) + r.choice([" ", ". ", ", "]) + cue + joint
        return head + span + ("\"" if joint.endswith("\"") else "") + r.choice([" ", "\n"]) + filler(r.randint(0, 4)), (len(head), len(head) + len(span), kind), int(good)
    if kind == "email":
        at, dot = r.choice([(" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("{at}", "."), ("[@]", "."), (" @ ", ".")])
        span = f"{name()}{r.choice(['', '.' + name(), d(2)])}{at}{name()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr'])}" if good else r.choice(
            [f"{name()} @ {d(1)}.{r.choice(['each', 'apiece'])}", f"{name()} at {name()} dot {name()}{name()}", f"{name()} @ {name()}.{name().capitalize()}ing"])
    elif kind == "ip":
        span = r.choice([f"{r.randint(1, 254)}[.]{r.randint(0, 255)}[.]{r.randint(0, 255)}[.]{r.randint(1, 254)}", ":".join(f"{r.randint(4096, 65535):x}" for _ in range(8))]) if good else r.choice(
            [f"{r.randint(1, 40)}, {r.randint(1, 999)}, {r.randint(256, 999)}, {r.randint(1, 99)}", f"{d(2)}:{d(2)}:{d(2)}:{d(2)}:{d(2)}", f"{d(1)},{d(3)},{d(3)},{d(3)}"])
    elif kind == "card":
        span = spaced(card(16), r.choice([".", "/", "  ", " - "])) if good else r.choice([no_card(16), spaced(no_card(16), r.choice([".", " ", "-"])), no_card(13), f"978-{d(1)}-{d(5)}-{d(3)}-{d(1)}", f"{d(4)}.{d(4)}.{d(6)}"])
    else:
        span = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"00{r.choice(['49', '33', '34', '44'])} {d(3)} {d(6)}", f"0{d(3)}/{d(7)}"]) if good else r.choice(
            [f"20{d(2)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{d(4)}.{d(2)}.{d(2)}.{d(2)}", d(8), d(10), d(12), f"{d(2)}:{d(2)}:{d(2)}.{d(3)}", f"{d(4)}-{d(4)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/20{d(2)} {d(2)}:{d(2)}", f"{d(1)} {d(3)} {d(3)} {d(3)}", d(16)])
    cue = ""
    if r.random() < (0.5 if good else 0.1):
        cue = r.choice(sorted(CUES[kind])) + r.choice([": ", " "])
    elif not good and r.random() < 0.4:
        cue = r.choice(sorted(CUES["not"])) + r.choice([": ", " "])
    head = filler(r.randint(0, 6)) + r.choice([" ", ". ", ", "]) + cue
    return head + span + r.choice([" ", ". ", ", ", "\n"]) + filler(r.randint(0, 4)), (len(head), len(head) + len(span), kind), int(good)


def _made_run(r: random.Random) -> list[tuple[str, Span, int]]:
    """Labelled candidates of one run of numbers side by side: those that are a whole phone, card or address are personal data,
    those that cut one or reach into the next, and all of a table's numbers, are not."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card(sep: str | None = None) -> str:
        x = d(15)
        x += next(c for c in "0123456789" if luhn(x + c))
        return (r.choice(["", " ", "-"]) if sep is None else sep).join(x[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        return r.choice([f"+{r.choice(['1', '33', '34', '44', '49'])} ({d(3)}) {d(3)}-{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}"])

    def address() -> str:
        return ".".join(str(r.randint(1, 254)) for _ in range(4))

    head, gap = r.choice(["see ", "so it is ", "and then: ", ""]), r.choice([" ", "  ", " / "])
    if r.random() < 0.25:
        width = r.choice([1, 2, 3, 4, 5, 6, 8])
        parts, kinds = [d(width) for _ in range(r.randint(4, 9))], []
    elif r.random() < 0.15:  # a list of cards, written alike
        parts = [card(" ") for _ in range(r.randint(2, 3))]
        kinds, gap = ["card"] * len(parts), " "
    else:
        made = [r.choice([(card, "card"), (phone, "phone"), (address, "ip")]) for _ in range(r.randint(2, 3))]
        parts, kinds = [f() for f, _ in made], [k for _, k in made]
        if r.random() < 0.4:
            parts, kinds = r.choice([([d(r.randint(1, 6)), *parts], ["", *kinds]), ([*parts, d(r.randint(1, 6))], [*kinds, ""])])
    text, whole = head, set()
    for i, x in enumerate(parts):
        text += gap if i else ""
        if kinds and kinds[i]:
            whole.add((len(text), len(text) + len(x), kinds[i]))
        text += x
    text += r.choice([" on", ".", ""])
    return [(text, c, int(c in whole)) for c in candidates(text)]


class Taken:
    """Stretches of a text that are spoken for, as disjoint intervals in order."""

    def __init__(self, spans: list[Span] = ()):  # noqa: B006
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e, _ in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, c: Span) -> bool:
        i = bisect_right(self.starts, c[0])
        return (not i or self.ends[i - 1] <= c[0]) and (i == len(self.starts) or c[1] <= self.starts[i])

    def add(self, c: Span) -> None:
        """A free span."""
        i = bisect_right(self.starts, c[0])
        self.starts.insert(i, c[0])
        self.ends.insert(i, c[1])


def _class(text: str, c: Span) -> int:
    """Which threshold: the kind's for spans that stand alone, its for spans with other numbers beside them, or that of cards beside their like."""
    if _twins(text, c):
        return 2 * len(ALL_KINDS)
    return ALL_KINDS.index(c[2]) + len(ALL_KINDS) * (c[2] in ("card", "phone") and any(_beside(text, c)))


def _rank(score: float, c: Span) -> tuple:
    """Of overlapping candidates the higher score stays, then the earlier, longer and first listed."""
    return -score, c[0], -c[1], ALL_KINDS.index(c[2])


@cache
def model(examples: int = 7500, seed: int = 7, precision: float = 0.995) -> tuple[BoostedTrees, tuple[float, ...]]:
    """(trees, a threshold for each kind, alone and beside other numbers, and for cards beside their like). Trained on synthetic labelled spans of a fixed seed, alone and in runs of numbers; on the held-out third, the
    least threshold of at least 0.5 whose accepted spans, after the overlap rule, are personal data with the wanted precision."""
    r = random.Random(seed)
    texts = [[_made_example(r)] for _ in range(examples)] + [_made_run(r) for _ in range(examples * 3 // 4)]
    texts = [[x for x in made if Taken(base_spans(x[0])).free(x[1])] for made in texts]  # what base spans decide is never proposed
    train, held = [x for i, made in enumerate(texts) if i % 3 for x in made], texts[::3]
    trees = BoostedTrees(depth=4).fit(np.array([features(t, s) for t, s, _ in train]), np.array([g for _, _, g in train], float))
    p, cuts = iter(trees.score(np.array([features(t, s) for made in held for t, s, _ in made]))), []
    kept: list[tuple[float, int, int]] = []
    for made in held:
        best = Taken()
        for score, (t, span, good) in sorted(((next(p), x) for x in made), key=lambda v: _rank(v[0], v[1][1])):
            if best.free(span):
                best.add(span)
                kept.append((score, _class(t, span), good))
    kept.sort(key=lambda v: -v[0])
    for k in range(2 * len(ALL_KINDS) + 1):
        score, good = (np.array([v[c] for v in kept if v[1] == k], float) for c in (0, 2))
        fine = np.cumsum(good) >= precision * np.arange(1, len(good) + 1)
        cuts.append(float(max(0.5, score[np.flatnonzero(fine)[-1]])) if fine.any() else 1.1)
    return trees, tuple(cuts)


def all_spans(texts: list[str], trees: BoostedTrees, cuts: tuple[float, ...]) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base spans, base and added spans) of each text. Added spans overlap neither base spans nor each other; of overlapping
    candidates the higher score stays, then the earlier, longer and first listed."""
    bases, proposed, taken = [], [], []
    for i, t in enumerate(texts):
        bases.append(base_spans(t))
        taken.append(Taken(bases[-1]))
        proposed += [(i, c) for c in candidates(t) if taken[-1].free(c)]
    p = trees.score(np.array([features(texts[i], c) for i, c in proposed])) if proposed else []
    added: dict[int, list[Span]] = {}
    for score, i, c in sorted(((q, i, c) for q, (i, c) in zip(p, proposed, strict=True)), key=lambda v: _rank(v[0], v[2])):
        if score >= cuts[_class(texts[i], c)] and taken[i].free(c):
            taken[i].add(c)
            added.setdefault(i, []).append(c)
    for i, base in enumerate(bases):
        yield base, sorted(base + added.get(i, []), key=lambda s: (s[0], ALL_KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Each span becomes its kind in brackets; overlapping spans become one, named by the first."""
    out, done = [], 0
    for s, e, k in spans:
        if s >= done:
            out += [text[done:s], f"[{k.upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def find_pii(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, redacted text, n_<kind> of base spans, base_sha256, spans (base and added), n_added, n_spans.

    Kinds are the base ones and `secret`, keys and passwords, which the method alone finds.
    A null text is empty and stays null when redacted; every row is judged by itself over its whole text, so repeated
    rows, null ids, extra columns and empty tables need nothing special.
    """
    shared = df.sparkSession.sparkContext.broadcast(model())
    src = small_batches(df).select(df[id_col], df[text_col])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, cuts = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            got = list(all_spans([t or "" for t in texts], trees, cuts))
            counts = [[sum(k == kind for _, _, k in base) for base, _ in got] for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([None if t is None else redact(t, spans) if spans else t for t, (_, spans) in zip(texts, got, strict=True)], pa.string()),
                    *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got]),
                    pa.array([joined(spans) for _, spans in got], pa.string()), pa.array([len(spans) - len(base) for base, spans in got], pa.int64()), pa.array([len(spans) for _, spans in got], pa.int64()),
                ],
                names=[id_col, "redacted", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"],
            )

    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(giving_back(find), f"`{id_col}` {kind}, redacted string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")
