"""Main text of web pages by tree scoring.

The page is read into a tree. Every paragraph (a run of inline text in its block element) passes points for its length
and commas to its ancestors: all to the nearest container, half to the next, a quarter to the one above, and so on. A
node's score is its points, discounted by the share of its text that lies in links, raised for elements that announce an
article and lowered to a hundredth by every class word on the way to it that announces boilerplate. The node of the best
score is the container; it is kept together with those siblings that score well beside it or go on in the same way.
Inside, what is marked as boilerplate or is mostly links is left out. Only elements that hold no article text by the
meaning of their tag (scripts, forms, menus, footers, ...) are cut whatever their score.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
#: Elements that are never part of an article's text.
CUT = frozenset("head script style textarea title xmp iframe noembed noframes noscript template nav footer aside form menu object embed applet svg math canvas audio video button select option datalist dialog input label fieldset".split())
#: Words of class, id or role that mark boilerplate.
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted nav navbar navigation menu menus submenu sidebar aside footer masthead banner topbar breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus toolbar search searchbox tagcloud widget widgets complementary contentinfo dialog".split()
)
#: As before such a word, a layout is described, not the element's part in it.
LAYOUT_WORDS = frozenset("has no with without is".split())
KEPT_TAGS = frozenset("html body article main h1".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text: their points go to the element around them, and beside the container they are its text.
TEXT_TAGS = frozenset("p li blockquote pre td dd dt".split()) | HEADINGS
BESIDE = frozenset("p blockquote pre ul ol dl table figure".split()) | HEADINGS
#: Elements that are left out if they are mostly links.
MENU_TAGS = frozenset("ul ol dl div section table".split())
#: A start tag closes an open element of these names, up to the tags that bound the search.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "optgroup": ("select",)}
SCOPE = frozenset("html table td th caption button object template body".split())
#: Shorter runs of text earn points for their length alone.
LEAST_CHARS = 25
#: Factors of a score: an element that announces an article, one that is marked as boilerplate.
ARTICLE_FACTOR, MARK_FACTOR = 3.0, 0.01
#: Siblings are kept from this share of the container's points on.
SIBLING_SHARE = 0.2
#: Two links or more and this share of the text in them make a menu.
MENU_SHARE = 0.7


class Page:
    """Nodes in page order as parallel lists; blocks are (owner, text, characters in links, links). Reading is linear."""

    def __init__(self, source: str):
        self.tags, self.parents, self.marked, self.classes = ["#root"], [-1], [False], [""]
        self.blocks: list[tuple[int, str, int, int]] = []
        self.read(source)

    def read(self, source: str) -> None:
        stack, at, text, in_link = [0], 0, [], 0
        linked = links = 0
        # Where in the stack the open elements of a tag lie, those of SCOPE, and those that aren't inline.
        places: dict[str, list[int]] = {}
        scopes, solid = [0], [0]

        def last(*names: str) -> int:
            return max((places[t][-1] for t in names if places.get(t)), default=0)

        def flush() -> None:
            nonlocal linked, links
            joined = " ".join("".join(text).split())
            if joined:
                self.blocks.append((stack[solid[-1]], joined, min(linked, len(joined)), links))
            text.clear()
            linked = links = 0

        def close(down_to: int) -> None:
            nonlocal in_link
            while len(stack) > down_to:
                tag = self.tags[stack.pop()]
                places[tag].pop()
                if scopes[-1] == len(stack):
                    scopes.pop()
                if solid[-1] == len(stack):
                    solid.pop()
                in_link -= tag == "a"

        def put(piece: str) -> None:
            nonlocal linked
            if "&" in piece:
                piece = references.unescape(piece)
            text.append(piece)
            if in_link:
                linked += len(" ".join(piece.split()))

        n, find = len(source), TOKEN.search
        while at < n:
            m = find(source, at)
            if m is None:
                put(source[at:])
                break
            if m.start() > at:
                put(source[at : m.start()])
            at = m.end()
            name = m[2]
            if not name:
                if m[0].startswith("<![CDATA["):
                    put(m[0][9:-3])
                continue
            tag = name.lower()
            inline = tag in INLINE
            if m[1]:
                if not inline:
                    flush()
                k = last(tag)
                if k and not (scopes[-1] > k and (inline or tag in ("p", "li"))):
                    close(k)
                continue
            if tag == "br":
                text.append(" ")
                continue
            if not inline:
                flush()
                k = last("p")
                if k > scopes[-1]:
                    close(k)
                while tag in CLOSES and (k := last(*CLOSES[tag])) > last(*BOUNDS[tag]):
                    done = tag != "tr" or self.tags[stack[k]] == "tr"
                    close(k)
                    if done:
                        break
            elif tag == "a" and in_link:
                close(last("a"))
            node = len(self.tags)
            self.tags.append(tag)
            self.parents.append(stack[-1])
            marked, own_class = self.attributes(m[3]) if m[3].strip() else (False, "")
            self.marked.append(marked)
            self.classes.append(own_class)
            if tag in RAW and not m[3].endswith("/"):
                stop = RAW_ENDS[tag].search(source, at)
                at = stop.start() if stop else n
                continue
            if tag in VOID or (m[3].endswith("/") and not inline):
                continue
            places.setdefault(tag, []).append(len(stack))
            if tag in SCOPE:
                scopes.append(len(stack))
            if not inline:
                solid.append(len(stack))
            stack.append(node)
            if tag == "a":
                in_link, links = in_link + 1, links + 1
        flush()

    @staticmethod
    def attributes(source: str) -> tuple[bool, str]:
        """Whether the element is hidden or marked as boilerplate, and its class."""
        marked, own_class = False, ""
        for m in ATTRIBUTE.finditer(source):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                marked = True
            if name == "style" and "display:none" in value.replace(" ", "").lower():
                marked = True
            if name == "class":
                own_class = " ".join(value.split())
            if name in ("class", "id", "role"):
                for part in value.split():
                    words = WORDS.findall(CAMEL.sub(" ", part).lower())
                    if any(w in CUT_WORDS and not (i and words[i - 1] in LAYOUT_WORDS) for i, w in enumerate(words)):
                        marked = True
        return marked, own_class

    def main_blocks(self) -> list[str]:
        """The texts of the container of the best score and of the siblings that are kept with it, in page order."""
        tags, parents = self.tags, self.parents
        n = len(tags)
        holds = [False] * n
        for i in range(n - 1, 0, -1):
            if holds[i] or (tags[i] in KEPT_TAGS and not self.marked[i]):
                holds[parents[i]] = True
        # marks: boilerplate marks on the way from the root; one around an article, main or h1 element doesn't count.
        cut, in_article, marks = [False] * n, [False] * n, [0] * n
        for i in range(1, n):
            p = parents[i]
            in_article[i] = in_article[p] or tags[i] in ("article", "main")
            cut[i] = cut[p] or tags[i] in CUT or (tags[i] == "header" and not in_article[p])
            own = self.marked[i] and tags[i] not in ("html", "body", "main", "h1") and not holds[i]
            marks[i] = marks[p] + own
        blocks = [b for b in self.blocks if not cut[b[0]]]
        points, chars, linked, links = [0.0] * n, [0.0] * n, [0.0] * n, [0] * n
        for owner, text, in_links, n_links in blocks:
            # A paragraph's own element is no container, unless text lies in it directly.
            home = parents[owner] if tags[owner] in TEXT_TAGS else owner
            points[home] += min(len(text) / 100, 3) + (1 + text.count(",") if len(text) >= LEAST_CHARS else 0)
            chars[owner] += len(text)
            linked[owner] += in_links
            links[owner] += n_links

        def density(i: int) -> float:
            return linked[i] / chars[i] if chars[i] else 0.0

        mostly_links = [False] * n
        for i in range(n - 1, 0, -1):  # from below, so what a node passes on is complete
            p = parents[i]
            mostly_links[i] = tags[i] in MENU_TAGS and links[i] >= 2 and density(i) > MENU_SHARE
            share = MARK_FACTOR if marks[i] > marks[p] or mostly_links[i] else 1.0
            points[p] += points[i] * share / 2
            chars[p] += chars[i] * share
            linked[p] += linked[i] * share
            links[p] += links[i]

        def plain(i: int) -> float:
            """Discounted points, without the factors of the tags and marks on the way to the node."""
            return points[i] * (1 - density(i))

        def score(i: int) -> float:
            announced = ARTICLE_FACTOR if tags[i] in ("article", "main") else 1.0
            return plain(i) * announced * MARK_FACTOR ** min(marks[i], 99)

        best = max(range(n), key=lambda i: (score(i), -i))
        if score(best) <= 0:
            best = next((i for t in ("article", "main", "body") for i in range(n) if tags[i] == t and chars[i] and not cut[i]), 0)
        kept, least = {best}, SIBLING_SHARE * plain(best)
        for i in range(parents[best] + 1, n):
            if i == best or parents[i] != parents[best] or cut[i] or not chars[i] or marks[i] > marks[best]:
                continue
            beside = tags[i] in BESIDE
            same = tags[i] == tags[best] and self.classes[i] == self.classes[best] and tags[i] not in ("article", "main")
            if (plain(i) >= least > 0) or ((beside or same) and density(i) < 0.25):
                kept.add(i)
        inside, menu = [-1] * n, [False] * n
        for i in range(n):
            p = parents[i]
            inside[i] = i if i in kept else inside[p] if p >= 0 else -1
            menu[i] = i != best and inside[i] >= 0 and (mostly_links[i] or menu[p])
        return [text for owner, text, _, _ in blocks if inside[owner] >= 0 and not menu[owner] and marks[owner] <= marks[inside[owner]]]


def main_text(source: str | None) -> str:
    """The article's blocks, one a line; empty if there is none."""
    return "\n".join(Page(source).main_blocks()) if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    Null html and pages without text give an empty text; repeated rows are extracted each; an empty table gives no row;
    other columns are ignored. Whole pages are read, whatever their length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": [main_text(h if isinstance(h, str) else None) for h in part["html"]]})

    rows = require(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInPandas(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
