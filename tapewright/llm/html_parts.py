"""One page as template tokens and text blocks: a small reader of tags, without a tree."""

from __future__ import annotations

import html
import re

#: Comments, declarations, elements whose content is no text, tags, text. Possessive, so every page is read in one go.
PART = re.compile(
    r"<!--(?:.*?-->|.*)|<(?P<raw>script|style|title|textarea|noscript|template|iframe|svg|select|button)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</(?P=raw)\s*>|.*)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.I | re.S,
)
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: An open one of these ends where another of the same line begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOILER_TAGS = frozenset("head nav header footer aside form menu dialog script style noscript template button select".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies footer gdpr header masthead menu modal nav navbar navigation newsletter notice popup promo promoted related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: A longer text is taken as tokens of so many words.
PHRASE = 8
MAIN_TAGS = frozenset(("article", "main"))


def _boiler(tag: str, attrs: str, in_main: bool) -> bool:
    """Whether an element is boilerplate by its name or class. Forms are judged with the page; the header of an article is its title."""
    if tag in BOILER_TAGS and tag != "form" and not (in_main and tag == "header"):
        return True
    if tag in ("body", "html") or not attrs:
        return False
    for groups in ATTR.findall(attrs):
        if BOILER_WORDS.intersection(re.split(r"[^a-z]+", "".join(groups).lower())):
            return True
    return False


def read(page: str) -> tuple[list, list]:
    """(segments, blocks) of a page.

    A segment is (path, words, is tag): the chain of open elements with the words, or phrases, of a text in it, or, for
    an opening tag, with the name of an inline element. A block is (text, boiler, main, first, end) with
    its range of segments. A form is boilerplate, but not around an article, and not where no other text is left: some pages
    lie in one form whole.
    """
    segments: list[tuple[int, list[str], bool]] = []
    blocks: list[tuple[str, bool, bool, int, int]] = []
    around: list[bool] = []  # of each block: in a form that is not inside an article
    # tag, path, depth of boilerplate (forms inside articles among it), depth of main, depth of forms around
    stack: list[tuple[str, int, int, int, int]] = [("", 0, 0, 0, 0)]
    paths: dict[tuple[int, str, str, bool], tuple[int, bool]] = {}
    parts: list[str] = []
    first = 0

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            blocks.append((text, at[2] > 0, at[3] > 0, first, len(segments)))
            around.append(at[4] > 0 and not at[3])
        parts.clear()

    at = stack[-1]
    for m in PART.finditer(page):
        kind = m.lastgroup
        if kind == "text":
            text = html.unescape(m["text"])
            parts.append(text)
            words = text.split()
            if len(words) > PHRASE:
                words = [" ".join(words[i : i + PHRASE]) for i in range(0, len(words), PHRASE)]
            if words:
                segments.append((at[1], words, False))
            continue
        if kind != "attrs":
            continue
        end, tag, attrs = m.group("end", "tag", "attrs")
        tag = tag.lower()
        block = tag in BLOCKS
        if block:
            flush()
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if not block and stack[k][0] in BLOCKS:
                    break  # an inline element ends with the block that it was opened in
        else:
            shut = CLOSES.get(tag) or ({"p"} if block else ())
            for k in range(len(stack) - 1, 0, -1) if shut else ():
                if stack[k][0] in shut:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS and stack[k][0] not in ("p", "li", "dt", "dd", "tr"):
                    break
            up = stack[-1]
            in_main = up[3] > 0
            known = paths.get((up[1], tag, attrs, in_main))
            if known is None:
                known = paths[up[1], tag, attrs, in_main] = (hash_path(up[1], tag, attrs) if block else up[1], _boiler(tag, attrs, in_main))
            segments.append((known[0], ["" if block else tag], True))
            if tag not in VOID and not attrs.endswith("/"):
                form = tag == "form"
                stack.append((tag, known[0], up[2] + (known[1] or form and in_main), up[3] + (tag in MAIN_TAGS), up[4] + (form and not in_main)))
        at = stack[-1]
        if block:
            first = len(segments)
    flush()
    if any(around) and any(not boiler and not form for (_, boiler, *_), form in zip(blocks, around, strict=True)):
        blocks = [(text, boiler or form, *rest) for (text, boiler, *rest), form in zip(blocks, around, strict=True)]
    return segments, blocks


def hash_path(up: int, tag: str, attrs: str) -> int:
    """A number for an element by its parents, name and class."""
    from xxhash import xxh3_64_intdigest

    names = " ".join("".join(g) for g in ATTR.findall(attrs)) if attrs else ""
    return xxh3_64_intdigest(f"{up}/{tag}.{names}")
