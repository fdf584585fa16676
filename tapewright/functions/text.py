"""Title and HTML helpers for news."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, functions as F

# Aggregator prefixes (checked in this order) and patterns of multi-stock summary titles.
TITLE_PREFIXES = (
    "Express News |",
    "Express News|",
    "Breaking |",
    "Breaking|",
    "BREAKING:",
    "UPDATE:",
    "UPDATE ",
    "UPDATED:",
)
ROUNDUP_PATTERNS = (
    r"^\d+\s+\w+\s+stocks?\s+moving\s+in",
    r"^trending\s+stocks?\s+today",
    r"^(top|biggest)\s+(gainers?|losers?|movers?)",
    r"^stocks?\s+that\s+hit\s+\d+-week",
    r"^(mid-?day|pre-?market|after-?hours?)\s+(gainers?|losers?|movers?)",
)
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def normalize_title(title: str = "title") -> Column:
    """Drop one known prefix, lower-case, remove ASCII punctuation, collapse white space."""
    t = F.col(title)
    bare = t
    for p in reversed(TITLE_PREFIXES):
        bare = F.when(t.startswith(p), F.expr(f"substring({title}, {len(p) + 1})")).otherwise(bare)
    bare = F.regexp_replace(F.lower(bare), PUNCTUATION, "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def title_fingerprint(title: str = "title") -> Column:
    return F.substring(F.md5(normalize_title(title)), 1, 16)


def url_id(url: str = "url") -> Column:
    return F.substring(F.md5(F.col(url)), 1, 16)


def is_roundup(title: str = "title") -> Column:
    out = F.lit(False)
    for p in ROUNDUP_PATTERNS:
        out = out | F.col(title).rlike("(?i)" + p)
    return out


def strip_tags(text: str) -> Column:
    return F.regexp_replace(F.col(text), "<[^>]+>", "")


#: Published names that also work without a semicolon, the longest first.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
_REFERENCE = rf"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{'|'.join(_BARE)}))"


def decode_references(text: Column) -> Column:
    """Numeric and named character references, each decoded once, left to right; unknown ones stay.

    The text is cut at its references and joined again, so the work is in column expressions; the names
    come from the published table.
    """
    names = F.create_map(*[F.lit(x) for n, c in html5.items() for x in (n, c)])

    def decoded(ref: Column) -> Column:
        name = F.regexp_replace(ref, "^&", "")
        digits = F.regexp_replace(name, "[^0-9a-fA-F]", "")
        code = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        utf32 = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        prefix = F.regexp_extract(name, f"^(?:{'|'.join(_BARE)})", 0)
        rest = F.regexp_replace(name, f"^(?:{'|'.join(_BARE)})", "")
        return (
            F.when(name.startswith("#"), F.when(valid, utf32).otherwise(chr(0xFFFD)))
            .when(F.try_element_at(names, name).isNotNull(), F.try_element_at(names, name))
            .when(prefix != "", F.concat(F.try_element_at(names, prefix), rest))
            .otherwise(ref)
        )

    gaps, found = F.split(text, _REFERENCE, -1), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    return F.when(~text.contains("&"), text).otherwise(F.array_join(F.flatten(F.zip_with(gaps, F.transform(found, decoded), lambda g, r: F.array(g, F.coalesce(r, F.lit(""))))), ""))


def strip_html(text: str) -> Column:
    """Tags out, references decoded, white space collapsed; column expressions only."""
    return F.trim(F.regexp_replace(decode_references(strip_tags(text)), r"(?U)\s+", " "))
