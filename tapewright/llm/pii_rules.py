"""Personal data in one text: exact rules, generous candidates and the features that describe them."""

from __future__ import annotations

import re

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the model adds.
MORE_KINDS = ("iban", "person_id")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

CANDIDATES = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|[(\[]at[)\]]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[(\[]dot[)\]]|\x20dot\x20)\x20?[A-Za-z]{2,24})+", re.I)),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[.,\x20]{1,2}[0-9]{1,3}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20._/-]?[0-9]){8,15}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\+|00)?\(?[0-9]{2,4}\)?(?:[\x20./-]{0,2}[0-9]){5,12}(?![0-9])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")),
    ("person_id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
]
CONTEXT = [
    re.compile(p, re.I)
    for p in (r"phone|\btel|call|fax|mobile|whatsapp|\+$", r"e-?mail|contact|write|reply", r"card|visa|credit|debit|payment", r"\bip\b|host|server|address|login", r"iban|account|bank", r"ssn|social|passport|\bid\b", r"order|invoice|isbn|version|page|model|part|price|\$|€|#$")
]
FEATURES = 23 + len(CONTEXT)
PERSON_CONTEXT = CONTEXT[5]
BRACKET_AT, SPELLED_AT, SPELLED_DOT = (re.compile(p, re.I) for p in (r"[(\[]at[)\]]", r"\x20at\x20", r"\x20dot\x20"))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban(span: str) -> bool:
    """Length and the check number modulo 97."""
    s = span.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def person_id(span: str) -> bool:
    """Three groups of digits within the ranges that are given out."""
    area, group, serial = span.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def hidden_email(span: str) -> bool:
    """An address whose '@' is in words: in brackets, or with its dots in words too (prose says "at" before a plain host name)."""
    return "@" not in span and bool(BRACKET_AT.search(span) or SPELLED_AT.search(span) and SPELLED_DOT.search(span))


def weakly_right(text: str, start: int, rank: int, end: int, sure: list[tuple[int, int, int]]) -> bool:
    """The label of a candidate: an exact rule accepts nearly the same span, or its kind's own check does."""
    if any(rank == k and min(end, y) - max(start, x) >= 0.8 * (y - x) for x, k, y in sure):
        return True
    span = text[start:end]
    if rank == 0:
        return hidden_email(span)
    if rank == 2:
        digits = re.sub(r"[^0-9]", "", span)
        return 12 <= len(digits) <= 19 and luhn(digits)
    if rank == 4:
        return iban(span)
    return rank == 5 and person_id(span) and bool(PERSON_CONTEXT.search(text[max(0, start - 40) : start]))


def made_texts(each: int = 60, seed: int = 5) -> list[str]:
    """Invented texts with right and wrong spans of the kinds that corpora seldom hold, so that each kind has labels: hidden
    addresses and prose with host names, account numbers with right and wrong check digits, personal numbers and part numbers."""
    import random

    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghijklmnoprstuvw", k=rnd.randint(3, 9)))
    digits = lambda n: "".join(rnd.choices("0123456789", k=n))
    end = lambda: rnd.choice(["com", "org", "net", "de", "info"])

    def account(right: bool) -> str:
        country, rest = rnd.choice(["DE", "FR", "ES", "GB", "NL"]), digits(rnd.randint(14, 20))
        check = 98 - int(rest + "".join(str(int(c, 36)) for c in country) + "00") % 97
        check = check if right else (check + rnd.randint(1, 95)) % 97
        s = f"{country}{check:02d}{rest}"
        return s if rnd.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    personal = lambda: f"{rnd.randint(1, 665):03d}-{rnd.randint(1, 99):02d}-{rnd.randint(1, 9999):04d}"
    kinds = [
        lambda: f"{word()} {word()}at{word()} {word()}(at){word()}.{end()} {word()}", lambda: f"{word()}, {word()}.{word()} [at] {word()}.{end()} {word()}",
        lambda: f"write to {word()} at {word()} dot {end()} {word()}", lambda: f"{word()} {word()} at {word()} dot {word()} dot {end()}",
        lambda: f"{word()} {word()} at {word()}.{end()} {word()}", lambda: f"we met {word()} at {word()}.{end()}.",
        lambda: f"account {account(True)} {word()}", lambda: f"{word()} IBAN: {account(True)}", lambda: f"{word()} {account(True)}",
        lambda: f"account {account(False)} {word()}", lambda: f"{word()} IBAN: {account(False)}", lambda: f"{word()} {account(False)}",
        lambda: f"SSN {personal()} {word()}", lambda: f"{word()} social security number: {personal()}", lambda: f"passport or id {personal()}",
        lambda: f"part {personal()} {word()}", lambda: f"{word()} {word()} {personal()}", lambda: f"{word()} invoice {personal()}", lambda: f"SSN 9{digits(2)}-{digits(2)}-{digits(4)}", lambda: f"id 000-{digits(2)}-{digits(4)}",
    ]
    return [make() for make in kinds for _ in range(each)]


def emails(text: str):
    """As the pattern local@domain, leftmost and non-overlapping, in one go over the '@' signs."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of all spans that the exact rules accept, in order."""
    out = [(a, 0, z) for a, z in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, rank, end) of every proposal; spans of different generators may overlap."""
    return [(m.start(), r, m.end()) for r, (_, p) in enumerate(CANDIDATES) for m in p.finditer(text)]


#: Greatest values of the features that count: length, digits, groups, longest group, lengths of groups. The distinct share of the digits goes by tenths.
CAPS = (40, 24, 8, 16, 4)


def features(text: str, start: int, rank: int, end: int) -> bytes:
    """Format of the span and words around it, as small whole numbers, so that there are only so many forms of candidates."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = re.split(r"[^0-9]+", span.strip("+() "))
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    own = [
        *(rank == r for r in range(len(CANDIDATES))),
        *map(min, (len(span), len(digits), len(groups), max(map(len, groups)), len(set(map(len, groups)))), CAPS),
        span[:1] == "+", "(" in span, bool(digits) and luhn(digits), all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in groups),
        10 * len(set(digits)) // max(1, len(digits)), "@" in span, before[-1:].isalnum(), after[:1].isalnum(),
        rank == 4 and iban(span), rank == 5 and person_id(span), rank == 0 and bool(BRACKET_AT.search(span)), rank == 0 and bool(SPELLED_DOT.search(span)),
    ]
    return bytes(own) + bytes(bool(p.search(before)) for p in CONTEXT)
