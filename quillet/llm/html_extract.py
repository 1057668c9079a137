"""HTML extraction: two-pass block rules.

The first pass cuts a page into blocks (the text between two block-level tags) and decides each by
rule: a block inside a menu, header, footer, sidebar, form, advert, notice or comment container is
bad, as is one with a high link density; a long block with a normal density of stop-words is good,
one with few is bad; the rest is short or near, undecided. Where no stop-word list fits the page's
long blocks, length and link density decide. In the second pass undecided blocks take the label of
their nearest decided neighbours: of both where they agree, else of the nearer in the same container.
Headings count with what follows them. Scripts, styles, the head, comments and all markup are no text
at all. A form, header or loosely named container that holds nearly all of a page's running text is
the page's frame, not a part beside it.

A page is read once, from left to right: time and memory follow its length, however deep or broken it is.

Defined results: a null or empty html has the empty text; null page_id and url keep their rows;
repeated rows give repeated rows; extra columns are ignored; nothing is capped, and broken markup
(unclosed or stray tags) is read as far as it makes sense.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from quillet.session import ship_package

from .text import map_batches

# Fixed values of the block rules.
MAX_LINK_DENSITY = 0.4
LENGTH_LOW, LENGTH_HIGH = 60, 200
STOPWORDS_LOW, STOPWORDS_HIGH = 0.10, 0.20

# Frequent function words of the languages.
STOPWORDS = frozenset(
    """the of and to a in is it that for on as with was be by are this at from or an not but have has had he she they we you his her its their which who will would can all one there been were if so no
    der die das und in zu den von mit ist des im für ein eine nicht auf dem als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis
    le la les de des du un une et à au aux en que qui dans pour pas par sur est se ce cette son sa ses avec il elle ne plus ou mais nous vous leur être sont
    el los las del y que en un una por con no para su se es al lo como más o pero sus le ha este sí porque esta son entre cuando muy sin sobre ser""".split()
)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td
    tfoot th thead title tr ul""".split()
)
#: Elements whose content is no text.
SILENT = frozenset("script style head noscript template iframe svg math object select textarea button canvas audio video".split())
#: Elements whose blocks are never main text.
OUTSIDE = frozenset("nav footer aside menu dialog".split())
#: Elements whose blocks are not main text, unless the page is inside them.
FRAMES = frozenset("form fieldset header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
#: Share of a page's running text from which on a frame counts as the page.
FRAME_SHARE = 0.9
# Names in class, id or role that mark a container as outside the main text: always, or unless the page is inside it.
_STRONG = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|adv|banner|sponsor\w*|promo\w*|breadcrumbs?|sidebar|footer|foot|topbar|toolbar|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|"
    r"sharing|social|follow|comments?|replies|reply|respond|disqus|related|recommend\w*|more-stories|pagination|pager|complementary|contentinfo|legal|copyright|navbar|navigation|nav|menu)(?:$|[_-])",
    re.IGNORECASE,
)
_WEAK = re.compile(r"(?:^|[_-])(?:nav\w*|menu\w*|side|login|share|tags?|widget|search)(?:$|[_-])", re.IGNORECASE)
_HEADS = re.compile(r"(?:^|[_-])(?:masthead|header|head)(?:$|[_-])", re.IGNORECASE)
#: Class names that say what a page has, lacks or does, not what an element is.
_STATES = re.compile(r"^(?:no|not|non|has|have|with|without|hide|is|js)[_-]|[_-](?:open|opened|closed|collapsed|expanded|active|inactive|visible|enabled|disabled|on|off)$", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_QUOTE = re.compile(r"""=\s*(["'])""")
_SPACE = re.compile(r"\s+")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Node:
    """An open element and what holds inside it."""

    __slots__ = ("name", "strong", "weak", "heading", "main", "depth")

    def __init__(self, name: str, above: "Node | None", strong: bool, weak: int):
        self.name, self.depth = name, above.depth + 1 if above else 1
        self.strong = strong or bool(above and above.strong)
        #: The weak frames around, as a linked list: (number, the others).
        self.weak = (weak, above.weak if above else None) if weak else above.weak if above else None
        self.heading = name in HEADINGS or bool(above and above.heading)
        self.main = name in MAIN or bool(above and above.main)


class Block:
    __slots__ = ("text", "linked", "outside", "weak", "heading", "main", "paragraph", "low", "label")

    def __init__(self, text: str, linked: int, node: Node | None, low: int):
        self.text, self.linked, self.low, self.label = text, linked, low, ""
        self.outside, self.weak = (node.strong, node.weak) if node else (False, None)
        self.heading, self.main, self.paragraph = (node.heading, node.main, node.name == "p") if node else (False, False, False)


def _marked(attributes: str, inside_main: bool) -> int:
    """2 where class, id or role names a container outside the main text or the element is hidden, 1 where it may, else 0."""
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id", "role"):
            for token in value.split():
                if _STATES.search(token):
                    continue
                if _STRONG.search(token):
                    return 2
                if _WEAK.search(token) or not inside_main and _HEADS.search(token):
                    found = 1
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return 2
    return found


def _tags(page: str):
    """(text before, name, closing, attributes) of each tag in turn, the last with the name None; comments are left out.

    A character that the rest of the page doesn't hold is looked for once.
    """
    at, n, text_from = 0, len(page), 0
    missing: set[str] = set()

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        found = page.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    pieces: list[str] = []
    while True:
        low = find("<", at)
        if low < 0:
            pieces.append(page[text_from:])
            yield "".join(pieces), None, False, "", n
            return
        if page.startswith("<!", low) or page.startswith("<?", low):
            pieces.append(page[text_from:low])
            if page.startswith("<!--", low):
                end, size = find("-->", low + 4), 3
            elif page.startswith("<![CDATA[", low):
                end, size = find("]]>", low + 9), 3
                pieces.append(page[low + 9 : end if end >= 0 else n])
            else:
                end, size = find(">", low), 1
            at = text_from = end + size if end >= 0 else n
            continue
        m = _NAME.match(page, low + 1)
        if not m:
            at = low + 1
            continue
        pos, end = m.end(), -1
        while True:
            end = find(">", pos)
            quote = _QUOTE.search(page, pos, end) if end >= 0 else None
            close = find(quote[1], quote.end()) if quote else -1
            if close < 0:
                break
            pos = close + 1
        if end < 0:
            at = low + 1
            continue
        pieces.append(page[text_from:low])
        name = m[0].lower()
        at = text_from = end + 1
        at = yield "".join(pieces), name.lstrip("/"), name.startswith("/"), page[m.end() : end], at
        pieces, text_from = [], at


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with their containers' marks."""
    out: list[Block] = []
    stack: list[Node] = []
    opened: Counter[str] = Counter()
    parts: list[tuple[str, bool]] = []
    links = number = low = 0
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal low
        if parts:
            text = _SPACE.sub(" ", references.unescape("".join(p for p, _ in parts))).strip()
            if text:
                linked = len(_SPACE.sub(" ", references.unescape("".join(p for p, in_link in parts if in_link))).strip())
                out.append(Block(text, linked, stack[-1] if stack else None, low))
                low = len(stack)
            parts.clear()

    def pop() -> str:
        nonlocal low
        name = stack.pop().name
        opened[name] -= 1
        low = min(low, len(stack))
        return name

    def push(name: str, mark: int) -> None:
        nonlocal number
        number += 1
        stack.append(Node(name, stack[-1] if stack else None, mark == 2, number if mark == 1 else 0))
        opened[name] += 1

    tags = _tags(page)
    found = next(tags)
    while True:
        text, name, closing, attributes, at = found
        if text:
            parts.append((text, links > 0))
        if name is None:
            break
        if not closing and name in SILENT:
            if not attributes.rstrip().endswith("/") and name not in unclosed:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
                if end:
                    at = end.end()
                else:
                    unclosed.add(name)
                    if name == "head":  # an unclosed head ends at the body
                        body = re.compile(r"<body\b", re.IGNORECASE).search(page, at)
                        at = body.start() if body else at
                    elif name in ("script", "style"):
                        at = len(page)
        elif name == "br":
            parts.append((" ", links > 0))
        elif name == "a":
            links = max(0, links - 1) if closing else 1
        elif name not in BLOCK:
            # a marked inline container, say a span
            if not closing and name not in VOID and (mark := _marked(attributes, bool(stack) and stack[-1].main)):
                push(name, mark)
            elif closing and opened[name]:
                flush()
                while pop() != name:
                    pass
        else:
            flush()
            if name in VOID:
                pass
            elif closing:
                if opened[name]:
                    while pop() != name:
                        pass
                    links = 0
            else:
                while stack and (stack[-1].name in _CLOSES.get(name, ()) or stack[-1].name == "p" or stack[-1].name in HEADINGS and name in HEADINGS):
                    pop()
                links = 0
                inside_main = bool(stack) and stack[-1].main
                if name in OUTSIDE:
                    mark = 2
                elif name in FRAMES:
                    mark = max(0 if name == "header" and inside_main else 1, _marked(attributes, inside_main))
                else:
                    mark = 0 if name in MAIN or name in ("body", "html", *HEADINGS) else _marked(attributes, inside_main)
                push(name, mark)
        found = tags.send(at)
    flush()
    return out


def _density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()*#$%&") in STOPWORDS for w in words) / len(words)


def unframe(found: list[Block]) -> None:
    """Decide which weak frames stand: one that holds nearly all running text is the page itself."""
    held: Counter[int] = Counter()
    total = 0
    for b in found:
        if not b.outside and len(b.text) >= LENGTH_LOW and b.linked / len(b.text) <= MAX_LINK_DENSITY:
            total += len(b.text)
            frame = b.weak
            while frame:
                held[frame[0]] += len(b.text)
                frame = frame[1]
    pages = {k for k, size in held.items() if total >= LENGTH_HIGH and size >= FRAME_SHARE * total}
    stands: dict[int, bool] = {}  # by frame, whether it or one around it stands
    for b in found:
        frame, way = b.weak, []
        while frame and frame[0] not in stands:
            way.append(frame[0])
            frame = frame[1]
        up = stands[frame[0]] if frame else False
        for k in reversed(way):
            up = stands[k] = up or k not in pages
        b.outside = b.outside or bool(b.weak) and stands[b.weak[0]]


def first_pass(block: Block, listed: bool) -> str:
    """good, bad, near (moderate) or short. listed: whether a stop-word list fits the page."""
    text = block.text
    if block.outside:
        return "bad"
    if block.linked / len(text) > MAX_LINK_DENSITY:
        return "near" if block.main and block.paragraph else "bad"
    if "©" in text[:3] and len(text) < LENGTH_HIGH and not block.main:
        return "bad"
    if len(text) < LENGTH_LOW:
        return "short"
    if not listed:
        return "good" if len(text) > LENGTH_HIGH else "near"
    density = _density(text)
    if density >= STOPWORDS_HIGH:
        return "good" if len(text) > LENGTH_HIGH else "near"
    if density >= STOPWORDS_LOW:
        return "near"
    return "near" if block.main else "bad"


def classify(found: list[Block]) -> None:
    """Second pass: undecided blocks inherit from their nearest decided neighbours."""
    unframe(found)
    long = [b for b in found if not b.outside and len(b.text) >= LENGTH_LOW and b.linked / len(b.text) <= MAX_LINK_DENSITY]
    listed = not long or any(_density(b.text) >= STOPWORDS_LOW for b in long)
    first = [first_pass(b, listed) for b in found]
    # a near block inside the article element is decided by its container
    decided = ["good" if x == "near" and b.main else x for x, b in zip(first, found)]
    n = len(found)
    # the nearest decided block on each side, and how many containers it shares (the least depth in between)
    before, after, shared_before, shared_after = [-1] * n, [-1] * n, [0] * n, [0] * n
    last, low = -1, 0
    for k in range(n):
        low = min(low, found[k].low)
        before[k], shared_before[k] = last, low
        if decided[k] in ("good", "bad"):
            last, low = k, 1 << 60
    last, low = -1, 0
    for k in range(n - 1, -1, -1):
        after[k], shared_after[k] = last, low
        if decided[k] in ("good", "bad"):
            last, low = k, 1 << 60
        low = min(low, found[k].low)
    any_good = "good" in decided

    for k, block in enumerate(found):
        if decided[k] in ("good", "bad"):
            block.label = decided[k]
            continue
        sides = [(shared, j) for shared, j in ((shared_before[k], before[k]), (shared_after[k], after[k])) if j >= 0]
        labels = {decided[j] for _, j in sides}
        if block.main and not any_good:
            block.label = "good"  # an article of short blocks only
        elif not sides:
            block.label = "good" if first[k] == "near" else "bad"
        elif len(labels) == 1:
            block.label = labels.pop() if not (first[k] == "near" and not any_good) else "good"
        else:
            # the closer relative in the tree decides; of two as close, what follows a heading, else the nearer, else good
            near = max(shared for shared, _ in sides)
            closest = [j for shared, j in sides if shared == near]
            if len(closest) == 1:
                block.label = decided[closest[0]]
            elif block.heading:
                block.label = decided[after[k]]
            else:
                gap = min(abs(j - k) for j in closest)
                block.label = "good" if any(decided[j] == "good" for j in closest if abs(j - k) == gap) else "bad"


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    classify(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars (code points)."""
    ship_package(pages.sparkSession)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return step

    chosen = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return map_batches(chosen, make, "page_id long, url string, text string, n_chars long")
