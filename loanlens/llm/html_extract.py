"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks on
their own: by where they stand (menus, footers, forms and the like are out), by
link density, by length and by stop-word density. Standing in an ``article`` or
``main`` counts for a block as half of the stop words that prose has; there, a
line of several links and hardly anything else is a menu, while a single linked
block, like a title or a cited work, is left open. So are blocks too short or
too unclear to decide; the second pass gives each the class of the nearest
decided neighbour. Inside a page's ``article`` or ``main`` only blocks of that
part count as neighbours, and open ones without any are kept; so are those of a
page without such a part, else open blocks outside it are dropped.

Rows are independent: one pass over the pages, no shuffle.

Defined results: a null or empty page, or one without main text, gives an empty
text; pages of any length are read whole; of two neighbours as near the one
before decides; a page cut off in mid-tag loses that tag only; repeated pages are
extracted each; null ids and further columns pass through, columns named like a
result are replaced.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loanlens.llm.common import fresh

LONG = 140
SHORT = 40
LINKED = 0.4
STOP_HIGH = 0.25
#: Links of a line in the main part that make it a menu, and their share of its text.
MENU_LINKS, MENU_LINKED = 3, 0.75

# Frequent words of the four languages.
STOP_WORDS = frozenset((
    "a an and are as at be but by for from had has have he her his i in is it its not of on or "
    "she that the their they this to was we were which will with you "
    "der die das den dem des ein eine einer eines und oder ist sind war von zu mit auf für im in "
    "nicht sich auch als an bei nach aus wie es er sie wir ich "
    "le la les un une des du de et ou est sont dans par pour pas que qui sur avec au aux en il elle "
    "nous vous ce cette plus "
    "el los las una unos del y o es son con para por que se no su al como más pero lo").split())

BLOCK_TAGS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th "
    "thead title tr ul").split())
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "noframes", "object")
OUT_TAGS = frozenset(
    "head nav footer aside form button select menu dialog title fieldset search".split())
OUT_NAMES = frozenset((
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice overlay "
    "pagination popup promo promoted related reply replies respond share sharing sidebar skip social sponsor "
    "sponsored subscribe toolbar widget").split())
OUT_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW_TAGS) + r")(?=[\s/>])[^>]*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_NAME = re.compile(r"""(?:^|\s)(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ROLE = re.compile(r"""(?:^|\s)role\s*=\s*["']?([\w-]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none""", re.I)
_PART = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")


def is_out(tag: str, rest: str, in_main: bool) -> bool:
    """Whether what an element holds is no main text, by its tag and names."""
    if tag in OUT_TAGS or tag == "header" and not in_main:
        return True
    if tag in ("html", "body", "article", "main") or "=" not in rest and "hidden" not in rest:
        return False
    names = " ".join(a or b or c for a, b, c in _NAME.findall(rest))
    role = _ROLE.search(rest)
    return (any(x.lower() in OUT_NAMES for x in _PART.split(names))
            or role is not None and role.group(1).lower() in OUT_ROLES or _HIDDEN.search(rest) is not None)


class Block:
    """Text between two block-level tags, and where it stands."""

    __slots__ = ("text", "linked", "links", "out", "main")

    def __init__(self, pieces, links: int, out: bool, main: int):
        self.links = links
        whole = "".join(p for p, _ in pieces)
        self.text = " ".join(html.unescape(whole).split())
        self.linked = sum(len(p) for p, a in pieces if a) / max(1, len(whole))
        self.out, self.main = out, main


def blocks(page: str) -> list[Block]:
    found, pieces = [], []
    stack: list[tuple[str, bool, int]] = []  # open elements: tag, out, number of its main part
    links, opened, mains, at = 0, 0, 0, 0
    p_out = False  # of the paragraph, up to the next block-level tag

    def state() -> tuple[bool, int]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    def end_block() -> None:
        nonlocal opened
        if pieces:
            out, main = state()
            b = Block(pieces, opened, out or p_out, main)
            if b.text:
                found.append(b)
            pieces.clear()
        opened = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            pieces.append((page[at:m.start()], links > 0))
        at = m.end()
        if not m["tag"]:
            continue
        tag, rest = m["tag"].lower(), m["rest"]
        if tag == "br":
            pieces.append((" ", links > 0))
        elif tag == "a":
            links = max(0, links + (-1 if m["close"] else 1))
            opened += not m["close"]
        if tag in BLOCK_TAGS:
            end_block()
            links = 0
            p_out = tag == "p" and not m["close"] and is_out(tag, rest, False)
        if tag in VOID_TAGS or tag == "p" or rest.endswith("/"):
            continue  # an unclosed paragraph must not hold what follows it
        if m["close"]:
            if any(t == tag for t, _, _ in stack):
                if tag not in BLOCK_TAGS and state()[0]:
                    end_block()
                while stack.pop()[0] != tag:
                    pass
        else:
            out, main = state()
            if tag in ("article", "main") and not main:
                mains += 1
                main = mains
            own_out = out or is_out(tag, rest, main > 0)
            if tag not in BLOCK_TAGS and own_out == out:
                continue  # inline elements matter only if they drop their text
            if tag not in BLOCK_TAGS:
                end_block()
            stack.append((tag, own_out, main))
    if at < len(page):
        pieces.append((page[at:], links > 0))
    end_block()
    return found


def stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(b: Block) -> bool | None:
    """True for main text, False for anything else, None where open."""
    if b.out:
        return False
    if b.main and b.links >= MENU_LINKS and b.linked >= MENU_LINKED:
        return False
    if b.linked > LINKED:
        return None if b.main else False
    if len(b.text) < SHORT:
        return None
    prose = stop_density(b.text)
    if b.main and len(b.text) >= LONG and prose >= STOP_HIGH / 2:
        return True
    return True if prose >= STOP_HIGH else None


def second_pass(found: list[Block], classes: list[bool | None]) -> list[bool]:
    """Open blocks take the class of the nearest decided one of their part (the
    one before, if both are as near); without any they stay, unless they stand
    outside the main part of a page that has one."""
    out = list(classes)
    has_main = any(b.main for b in found)
    parts: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        if not b.out:
            parts.setdefault(b.main, []).append(i)
    for main, members in parts.items():
        decided = [k for k, i in enumerate(members) if classes[i] is not None]
        nxt = 0
        for k, i in enumerate(members):
            if classes[i] is not None:
                continue
            while nxt < len(decided) and decided[nxt] < k:
                nxt += 1
            near = [decided[j] for j in (nxt - 1, nxt) if 0 <= j < len(decided)]
            out[i] = classes[members[min(near, key=lambda d: abs(d - k))]] if near else main > 0 or not has_main
    return [bool(x) for x in out]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    keep = second_pass(found, [first_pass(b) for b in found])
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` without the html column, with ``text`` and ``n_chars``."""
    kept = [f for f in pages.schema.fields if f.name not in (page, "text", "n_chars")]
    raw = fresh("html")
    source = pages.select(*[f.name for f in kept], F.col(page).alias(raw))
    schema = StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b[raw]]
            out = b.drop(columns=raw)
            out["text"], out["n_chars"] = texts, pd.Series(map(len, texts), out.index, dtype="int64")
            yield out

    return source.mapInPandas(run, schema)
