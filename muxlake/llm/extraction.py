"""Main text of web pages: a minimum cut labels the blocks of a page as content or boilerplate.

A page becomes blocks of text in page order, each below a path of elements. A classifier
gives each block the log odds of being content, from the elements and names above it, the
share of its text in links and its words and sentences; its weights are fixed values, not
learned. The log odds are the capacity from the source (content) or to the sink (boilerplate).

Edges of smoothness tie blocks that follow each other, more where few elements lie between
them (DOM proximity), and each block to the element it stands in, which is a node without
costs of its own, so that siblings go together. The minimum cut is the labelling of least
cost: what stays with the source is the main text. Nodes whose own cost is at least that
of all their edges are labelled first, as no cut does better; a maximum flow by shortest
augmenting levels labels the rest, component by component.

A page is one row and is worked on alone: nothing is shuffled, memory is that of a page.

Cases: null, empty and blank html, and pages without a block of content, have an empty
text. Ill-formed UTF-8 is read with replacement characters. Elements that are never closed
end with their parent, a tag or comment that never ends goes. Repeated rows are rows of
their own. Other columns pass through; the result is a column of a name that is free.
"""

from __future__ import annotations

import math
import re
from collections import deque
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muxlake.llm.common import bound_batches, free_name, released

# Elements of HTML. Those without an end tag, those that hold no text of the page, those that begin a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template title head svg math iframe object canvas audio video select option datalist textarea button label dialog".split())
BLOCK = set("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption header footer nav aside menu address details summary hr center hgroup search form fieldset".split())
#: Elements that end when one of the named begins inside the same block.
ENDS = {"p": BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Elements past which no start or end tag closes others.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
ENDED_BY = {start: [inner for inner, starts in ENDS.items() if start in starts] for start in set().union(*ENDS.values())}
#: Log odds of content by the elements above a block.
BAD_TAGS = set("nav footer aside menu search".split())
GOOD_TAGS = {"article": 5.0, "main": 3.0}
# Names (of class, id, role, aria-label, itemprop) that tell of boilerplate, or of content.
BAD_NAMES = set("""ad ads adv advert adverts advertisement adsense adslot adbox banner sponsor sponsored promo promotion promoted dfp outbrain taboola sidebar sidebars side aside rail menu menus nav navbar navigation
breadcrumb breadcrumbs footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert disclaimer newsletter subscribe subscription subscriptions signup signin login
register paywall share sharing social follow related recommend recommended recommendations popular trending comment comments commentlist respond response responses reply replies disqus discussion popup modal
overlay widget widgets pagination pager search searchbox copyright legal contentinfo complementary skip tags tagcloud hidden""".split())
BAD_ARTICLES = set("comment comments reply replies related recommended recommendations sponsored promo promoted advert advertisement sidebar widget".split())
GOOD_NAMES = set("article articlebody content post entry story main maincontent text body prose".split())
#: Weights: of bad elements and names, of good names; of the logarithm of words, sentence ends, links; bias.
BAD, GOOD, WORDS, SENTENCE, LINKS, BIAS = -9.0, 1.5, 0.6, 0.5, -5.0, -1.6
#: Capacity between neighbours of one parent, less with each element between; and between a block and its element.
BESIDE, INSIDE = 1.2, 0.3


def named(attributes: list[tuple[str, str | None]], tag: str) -> tuple[bool, bool, bool]:
    """Whether the names of an element tell of boilerplate, of content, and whether it is hidden. Articles often carry the names of their topics, so few names count there."""
    bad = good = hidden = False
    for k, v in attributes:
        v = (v or "").lower()
        if k in ("class", "id", "role", "aria-label", "itemprop"):
            tokens = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", v)))
            found = tokens & (BAD_ARTICLES if tag in GOOD_TAGS else BAD_NAMES)
            titled = found <= {"header", "masthead"} and bool(tokens & GOOD_NAMES)  # the heading of an entry
            bad |= bool(found) and not titled
            good |= bool(tokens & GOOD_NAMES)
        elif k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v)):
            hidden = True
    return bad, good, hidden


class Blocks(HTMLParser):
    """Blocks of a page: (text, characters in links, path of elements)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, tuple[int, ...]]] = []
        self.odds: list[float] = [0.0]  # of each element: log odds of content that it gives to what is inside
        self.seen: set[str] = set()
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, number, whether nothing inside counts
        self.parts: list[str] = []
        self.linked = self.links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.linked, tuple(i for tag, i, _ in self.open if tag in BLOCK or self.odds[i] or not i)))
        self.parts, self.linked = [], 0

    def close_to(self, depth: int) -> None:
        closed = [tag for tag, _, _ in self.open[depth:]]
        if any(tag in BLOCK or tag in HIDDEN for tag in closed):
            self.flush()
        self.links -= closed.count("a")
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for inner in ENDED_BY.get(tag, ()):
            past = SCOPE.get(inner, BLOCK)
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth][0] == inner:
                    self.close_to(depth)
                    break
                if self.open[depth][0] in past:
                    break
        if tag in BLOCK or tag in HIDDEN:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        bad, good, hidden = named(attrs, tag) if attrs and tag not in ("html", "body") else (False, False, False)
        hidden |= tag in HIDDEN or self.open[-1][2]
        if tag in GOOD_TAGS and not bad and tag not in self.seen:  # a form or a named wrapper that holds the article isn't boilerplate
            self.seen.add(tag)
            for t, i, _ in self.open:
                if t not in BAD_TAGS:
                    self.odds[i] = max(0.0, self.odds[i])
        bad |= tag in BAD_TAGS or tag == "form" or (tag == "header" and not any(t in GOOD_TAGS for t, _, _ in self.open))
        self.odds.append(BAD if bad else GOOD_TAGS.get(tag, 0.0) + GOOD * good)
        self.open.append((tag, len(self.odds) - 1, hidden))
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:  # HTML reads <p/> as <p>, but what has no inside in XML ends here
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                self.close_to(depth)
                return
            if self.open[depth][0] in SCOPE.get(tag, ()):
                return

    def handle_data(self, data: str) -> None:
        if not self.open[-1][2]:
            self.parts.append(data)
            if self.links:
                self.linked += len("".join(data.split()))


def log_odds(text: str, linked: int, above: list[float]) -> float:
    """Of a block being content. Bad elements above outweigh good ones, wherever they stand."""
    words = text.count(" ") + 1
    share = min(1.0, linked / max(1, len(text) - words + 1))
    own = BIAS + WORDS * math.log1p(words) + SENTENCE * min(3, len(re.findall(r"[.!?;:…。！？](?=\s|$)", text))) + LINKS * share
    bad = min(above, default=0.0)
    return own + (bad if bad < 0 else min(6.5, sum(above)))


def proximity(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    """Elements between two blocks: those above one of them but not the other, beside their own two."""
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    return max(0, len(a) + len(b) - 2 * same - 2)


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Of each node, whether it stays with the source in a minimum cut.

    costs: capacity from the source if positive, to the sink if negative; edges: (a, b, capacity both ways).
    Of several minimum cuts that with the fewest nodes at the source.
    """
    n, costs = len(costs), list(costs)
    beside: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            beside[a][b] = beside[a].get(b, 0.0) + c
            beside[b][a] = beside[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # nodes that outweigh their edges; what they pull on goes to their neighbours' costs
        a = queue.popleft()
        if label[a] is not None:
            continue
        whole = sum(beside[a].values())
        if costs[a] > whole or costs[a] <= -whole:
            label[a] = costs[a] > whole
            for b, c in beside[a].items():
                costs[b] += c if label[a] else -c
                del beside[b][a]
                queue.append(b)
            beside[a] = {}
    for root in range(n):
        if label[root] is None:
            part, seen = [root], {root}
            for a in part:
                for b in beside[a]:
                    if b not in seen:
                        seen.add(b)
                        part.append(b)
            for a, at_source in zip(part, _flow(part, costs, beside), strict=True):
                label[a] = at_source
    return [bool(x) for x in label]


def _flow(part: list[int], costs: list[float], beside: list[dict[int, float]]) -> list[bool]:
    """Maximum flow over a component: levels from the source, then paths along them until no level reaches the sink."""
    number = {a: i for i, a in enumerate(part)}
    s, t = len(part), len(part) + 1
    to: list[list[int]] = [[] for _ in range(t + 1)]
    head, left = [], []

    def edge(a: int, b: int, forth: float, back: float) -> None:
        to[a].append(len(head))
        to[b].append(len(head) + 1)
        head.extend((b, a))
        left.extend((forth, back))

    for a in part:
        if costs[a] > 0:
            edge(s, number[a], costs[a], 0.0)
        elif costs[a] < 0:
            edge(number[a], t, -costs[a], 0.0)
        for b, c in beside[a].items():
            if a < b:
                edge(number[a], number[b], c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (t + 1)
        level[s] = 0
        order = [s]
        for a in order:
            for e in to[a]:
                if left[e] > tiny and level[head[e]] < 0:
                    level[head[e]] = level[a] + 1
                    order.append(head[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(len(part))]
        at = [0] * (t + 1)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(left[e] for e in path)
                for e in path:
                    left[e] -= least
                    left[e ^ 1] += least
                k = next(i for i, e in enumerate(path) if left[e] <= tiny)
                a = head[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(to[a]):
                e = to[a][at[a]]
                if left[e] > tiny and level[head[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(to[a]):
                path.append(to[a][at[a]])
                a = head[path[-1]]
            elif path:
                a = head[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def labelled_blocks(html: str) -> list[tuple[str, bool]]:
    """Blocks of a page in order, and whether each is main text."""
    last = html.rfind("<")
    if last >= 0 and html.find(">", last) < 0 and re.match("[a-zA-Z/!?]", html[last + 1 : last + 2]):
        html = html[:last]  # a tag that never ends
    page = Blocks()
    page.feed(html)
    page.close()
    page.flush()
    blocks = page.blocks
    costs = [log_odds(text, linked, [page.odds[i] for i in path]) for text, linked, path in blocks]
    edges = [(i, i + 1, BESIDE / (1 + proximity(blocks[i][2], blocks[i + 1][2]))) for i in range(len(blocks) - 1)]
    nodes: dict[int, int] = {}
    for i, (_, _, path) in enumerate(blocks):
        # The element around the block's own: <article> of <article><p>.
        above = path[-2] if len(path) > 1 and path[-1] else path[-1]
        edges.append((i, len(blocks) + nodes.setdefault(above, len(nodes)), INSIDE))
    at_source = min_cut(costs + [0.0] * len(nodes), edges)
    return [(text, keep) for (text, _, _), keep in zip(blocks, at_source)]


def main_text(html: str) -> str:
    return "\n".join(text for text, keep in labelled_blocks(html) if keep)


def _extract(column: str):
    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(column)
            texts = [main_text((x or b"").decode("utf-8", "replace")) for x in b[column].to_pylist()]
            yield b.set_column(at, column, pa.array(texts, pa.string()))

    return run


def extract_text(pages: DataFrame, html: str = "html", result: str = "text") -> DataFrame:
    """pages with a column of their main text: the kept blocks, white space within each made one blank, joined by newlines."""
    bound_batches(pages.sparkSession)
    name = free_name(pages, result)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in pages.schema) + f", `{name}` string"
    return pages.withColumn(name, F.col(html).cast("binary")).mapInArrow(released(_extract(name)), schema)
