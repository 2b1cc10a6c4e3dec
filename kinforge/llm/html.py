"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass scores every block
by length, stop-word density and link density; where the block stands (inside a
navigation, form, advert or comment part, inside or outside the page's article)
only shifts the score, in that a part's own tag or a class made of nothing but
such words weighs more than a class that merely contains one. A high score is
main text and a low one is not. Blocks between the two, most of them short,
inherit in the second pass the label of the nearest decided block, of the same
article part where they stand in one. Both passes are linear in the page.

Defined results: a null or empty page, and one without main text, gives an empty
text; unclosed tags, comments and quotes end where the page ends; text without
any tag is one block of main text; equal pages have equal texts and repeated
rows each keep theirs; white space (also no-break spaces) inside a block becomes
one space, a line break too.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from kinforge.llm.common import map_batches, slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAMES = re.compile(r"[a-z]+|[0-9]+")

RAW = frozenset("script style template textarea title iframe noembed noframes xmp svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Tags that say that their text is not main text.
BARRED = frozenset("nav aside footer form button select dialog menu noscript object audio video canvas label search head datalist".split())
#: Words of class and id that say the same, and words beside them that say nothing.
BARRED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs footer footnav masthead topbar sidebar sidenav aside widget widgets related recommended recommendations "
    "share sharing social cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "search searchbox comment comments commentlist disqus reply replies respond discussion pager pagination copyright legal toolbar tooltip "
    "complementary contentinfo disclaimer announcement paywall outbrain taboola".split()
)
PLAIN_WORDS = frozenset(
    "site page top bottom left right upper lower box container wrapper wrap block section bar links link list area inner outer row col column columns "
    "item items holder group panel region module js main primary secondary global the is has"
    .split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: Words that mark a header as the article's own.
OWN_WORDS = frozenset("article entry post story content title headline".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip".split())

STOP_WORDS = frozenset(
    "the of and to in is it that for on with as was are be this by at from or an not have has he she they we you his her its but which "
    "le la les de des du et un une en que qui dans pour par sur est au aux ne pas plus avec ce il elle ou se sont "
    "der die das und zu den dem ein eine ist von mit auf für im nicht sich des als auch es an werden aus er hat dass sie nach "
    "el los las y que en un una por con para del se no su al lo como más o pero sus es son fue ha".split()
)
WORD = re.compile(r"[^\W\d_]+")

LINKS, SOME_LINKS = 0.5, 0.33
LONG, SHORT = 200, 60
STOPS = 0.12
SHARE = 0.25
#: What a block scores for length, stop words and links, and for where it stands.
IS_LONG, IS_FAIR, HAS_STOPS = 1.5, 1.0, 1.0
IS_LINKS, HAS_LINKS, IS_SIGN = -8.0, -2.0, -4.0
INSIDE, OUTSIDE = 1.25, -5.0
EVIDENCE = (0.0, -2.0, -8.0)
MAIN, OTHER = 2.0, -1.0


@dataclass
class Block:
    """One block: text, characters inside links, and where it stands."""

    text: str
    linked: int
    evidence: int  # 0 none, 1 a class that contains a word of other parts, 2 such a part
    scope: int  # number of the enclosing article part, 0 for none
    head: bool
    label: int = field(default=0)  # 1 main text, -1 other, 0 open


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)} if raw else {}


def _evidence(name: str, attrs: dict[str, str], in_scope: bool) -> int:
    """How strongly an element says that it holds no main text, as in ``Block``."""
    words = set(NAMES.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())) if attrs else set()
    if name in BARRED or attrs.get("role", "").lower() in ROLES:
        return 2
    if name == "header" and not in_scope and not words & OWN_WORDS:
        return 2
    if attrs and ("hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()):
        return 2
    if name in ("body", "html", "main"):
        return 0
    if words & COMMENT_WORDS:
        return 2
    if name == "article":
        return 2 if words & {"ad", "ads", "advert", "sponsored", "promo"} else 0
    found = words & BARRED_WORDS
    return (1 if words - BARRED_WORDS - PLAIN_WORDS else 2) if found else 0


class _Stack:
    """Open elements, with the places of each name, so that no tag walks the stack."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.evidence: list[int] = []
        self.by_class: list[int] = []  # elements whose class alone speaks against them
        self.count = [0, 0, 0]  # open elements by evidence
        self.scopes: list[tuple[int, int]] = []  # (place, number) of article parts

    def push(self, name: str, evidence: int, by_class: bool, scope: int) -> None:
        at = len(self.names)
        self.places.setdefault(name, []).append(at)
        self.names.append(name)
        self.evidence.append(evidence)
        self.count[evidence] += 1
        if scope:
            self.scopes.append((at, scope))
        if by_class:
            self.by_class.append(at)

    def clear_classes(self) -> None:
        """A wrapper that holds the article is no advert or sidebar."""
        for at in self.by_class:
            self.count[self.evidence[at]] -= 1
            self.evidence[at] = 0
            self.count[0] += 1
        self.by_class.clear()

    def pop_to(self, names: tuple[str, ...], stops: frozenset[str]) -> None:
        """Close the nearest of ``names``, unless one of ``stops`` is open inside it."""
        at = max((self.places[x][-1] for x in names if self.places.get(x)), default=-1)
        if at < 0 or any(self.places[x][-1] > at for x in stops if self.places.get(x)):
            return
        while len(self.names) > at:
            self.places[self.names.pop()].pop()
            self.count[self.evidence.pop()] -= 1
        while self.scopes and self.scopes[-1][0] >= at:
            self.scopes.pop()
        while self.by_class and self.by_class[-1] >= at:
            self.by_class.pop()

    def strongest(self) -> int:
        return 2 if self.count[2] else 1 if self.count[1] else 0

    def scope(self) -> int:
        return self.scopes[-1][1] if self.scopes else 0

    def in_link(self) -> bool:
        return bool(self.places.get("a"))


HOLDERS = frozenset("article aside body blockquote div dl fieldset figure footer form header html main nav ol section table td th tr ul".split())
NO_STOPS: frozenset[str] = frozenset()


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order."""
    out: list[Block] = []
    stack = _Stack()
    scopes = 0
    text: list[str] = []
    linked = 0
    head = False
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            body = " ".join("".join(text).split())
            if body:
                out.append(Block(body, min(linked, len(body)), stack.strongest(), stack.scope(), head))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if stack.in_link():
                linked += len(" ".join(piece.split()))

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        if m[1] or m[4]:  # closing tag
            if name in BLOCK:
                flush()
                if name[0] == "h" and name[1:].isdigit():
                    head = False
            stack.pop_to((name,), NO_STOPS if name in BLOCK else HOLDERS)
            continue
        raw = (m[3] if m[2] else m[6]).rstrip()
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in BLOCK:
            flush()
            if name in ("li", "dt", "dd", "option", "tr", "td", "th"):
                alike = next((x for x in (("dt", "dd"), ("td", "th")) if name in x), (name,))
                stack.pop_to(alike, HOLDERS - {"td", "th", "tr"} - {name})
            stack.pop_to(("p",), HOLDERS)
            head = len(name) == 2 and name[0] == "h" and name[1].isdigit()
        elif name == "br":
            text.append(" ")
        # A slash at the end of an unquoted value closes nothing.
        if name in VOID or name not in BLOCK and raw.endswith("/") and raw[-2:-1] in ("", " ", "\t", "\n", '"', "'"):
            continue
        attrs = _attributes(raw)
        evidence = _evidence(name, attrs, bool(stack.scopes))
        scope = 0
        if name in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or "articlebody" in attrs.get("itemprop", "").lower():
            if evidence < 2:
                scopes += 1
                scope = scopes
                stack.clear_classes()
        by_class = evidence > 0 and _evidence(name, {k: v for k, v in attrs.items() if k not in ("class", "id")}, True) == 0
        by_class = by_class and not COMMENT_WORDS & set(NAMES.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
        stack.push(name, evidence, by_class, scope)
    flush()
    return out


def score(b: Block, scoped: bool) -> float:
    """What length, stop words, links and place say; ``scoped`` if the page has an article part to go by."""
    n = len(b.text)
    density = b.linked / n
    out = EVIDENCE[b.evidence] + (INSIDE if b.scope else OUTSIDE if scoped else 0.0)
    if density > LINKS:
        out += IS_LINKS
    elif density > SOME_LINKS:
        out += HAS_LINKS
    if b.text.startswith("©") and n < LONG:
        out += IS_SIGN
    if n >= SHORT and out + IS_LONG + IS_FAIR + HAS_STOPS > OTHER:
        words = WORD.findall(b.text.lower())
        stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        out += IS_FAIR + (IS_LONG if n >= LONG else 0.0) + (HAS_STOPS if stops >= STOPS else 0.0)
    return out


def first_pass(blocks: list[Block]) -> None:
    """Label 1 or -1 for the blocks that their scores decide, 0 for the others."""
    size = sum(len(b.text) for b in blocks if b.evidence < 2)
    inside = sum(len(b.text) for b in blocks if b.evidence < 2 and b.scope)
    scoped = bool(size) and inside >= SHARE * size
    for b in blocks:
        got = score(b, scoped)
        b.label = 1 if got >= MAIN else -1 if got <= OTHER else 0


def second_pass(blocks: list[Block]) -> None:
    """Open blocks take the label of the nearest decided one.

    In an article part that is one of the part. On a tie a heading goes with what
    follows and another block with what precedes. With nothing decided that is
    not another part's, an open block is main text.
    """

    def sweep(order: range) -> list[int]:
        seen: dict[int, int] = {}  # last decided block by scope, and at -1 of any
        out = [-1] * len(blocks)
        for i in order:
            b = blocks[i]
            if not b.label:
                out[i] = seen.get(b.scope or -1, -1)
                continue
            seen[-1] = i
            if b.scope and b.evidence < 2:
                seen[b.scope] = i
        return out

    before, after = sweep(range(len(blocks))), sweep(range(len(blocks) - 1, -1, -1))
    free = any(b.label and b.evidence < 2 for b in blocks)
    labels = []
    for i, b in enumerate(blocks):
        if b.label:
            labels.append(b.label)
            continue
        near = [j for j in (before[i], after[i]) if j >= 0]
        if not near or not free and not b.scope:
            labels.append(1 if b.scope or not free else -1)
        else:
            labels.append(blocks[min(near, key=lambda j: (abs(j - i), (j < i) == b.head))].label)
    for b, found in zip(blocks, labels, strict=True):
        b.label = found


def label(blocks: list[Block]) -> None:
    """Both passes; afterwards every block's label is 1 or -1."""
    first_pass(blocks)
    second_pass(blocks)


def main_text(page: str | None) -> str:
    """Main text of a page; blocks in order, one line each."""
    if not page:
        return ""
    blocks = blocks_of(page)
    label(blocks)
    return "\n".join(b.text for b in blocks if b.label > 0)


def extract(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keep..., text, n_chars) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, page, 4 << 20):
            texts = [main_text(x) for x in batch.column(page).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(df.select(*dict.fromkeys((*keep, page))), run, head + ", text string, n_chars long")
