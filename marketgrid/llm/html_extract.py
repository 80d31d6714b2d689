"""Main text of web pages by tree scoring.

A page is read into a tree.  What can never be the article is left out while
reading: scripts, styles, forms, menus, page headers and footers, sidebars and
whatever is hidden or has such a role.  What a whole class or id names as an
advert, a notice or reader comments is marked, and judged when the page is read:
it stays if it also carries a good name, or if no other article or main element
has text and it holds one with more points than all that is not marked, or nearly
all points of the page's paragraphs; inside an article, names that
can stand for prose (tags, notice, related, ...) go only if mostly links.  Every
paragraph then passes points (one, one per comma, up to three for length) to
its parent, half to the grandparent and less further up; a container's points
are discounted by its share of text in links.  The best container is kept with
those siblings that look like it.  An article in sections has containers of
comparable points in several branches of one ancestor: the choice is lifted to
the highest ancestor that has such branches, and keeps them whole, with what
stands between them and is not mostly links.  If the best container stands in an
article or main element, that whole element is the article.  A header element is
left out unless an article, a main element or a container named as one post
holds it.

One page is one row of work; pages are read with loops, so deep trees need no
stack, and nothing is shuffled.

Defined cases: null or empty html and pages without text give an empty text;
an unclosed tag or comment ends with the page; unknown character references
stay as written; a null page_id is kept; repeated rows give a row each; other
columns play no part.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready

# Element kinds of HTML, and words in names that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title select svg math object".split())
DROP = frozenset("nav footer aside form button head dialog menu canvas audio video".split()) | RAW - {"svg", "math"}
BLOCK = frozenset("""address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table tbody thead tfoot body div article main section td blockquote".split())
BAD_NAMES = frozenset("""ad ads adv advert adverts advertisement adsense banner banners breadcrumb breadcrumbs comment comments
commentlist consent cookie cookies disqus disclaimer footer form gdpr login masthead menu menus modal nav navbar navigation
buttons newsletter notice notices overlay pagination pager paywall popup promo promos promotion related replies respond search share
sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar topbar widget
widgets""".split())
PAGE_NAMES = frozenset("header top".split())
OTHERS_NAMES = frozenset("""ad ads adv advert adverts advertisement adsense comment comments commentlist consent cookie cookies
disqus gdpr replies respond sponsor sponsored sponsors""".split())  # prose, but not the article's
SOFT_NAMES = frozenset("disclaimer form notice notices promotion related search share sharing skip social tags".split())
BAD_ROLES = frozenset("""alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search
status toolbar""".split())
GOOD_NAMES = frozenset("article body content entry main post story text".split())
POST_NAMES = frozenset("article entry post story".split())  # one piece of writing, with its own header
# words that go with a name in a class or id and leave its meaning as it is
WITH_NAMES = frozenset("""area bar block bottom box center col column container group holder icons inner item items left link
links list module outer page panel primary right row secondary section site slot unit wrap wrapper""".split()) | GOOD_NAMES | PAGE_NAMES
WITH_POSTS = WITH_NAMES | frozenset("blog full news single".split())
BETWEEN = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl table figure div section".split())
MOST = 0.8  # share of a page's paragraph points that no marked element but the article's has
TAG_POINTS = {"article": 8, "main": 8, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?
|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|([^<]+|<)""", re.S | re.X)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PARTS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@lru_cache(4096)
def name_mark(name: str, in_article: bool) -> int:
    """What a whole class or id stands for: 0 nothing known, 1 a soft name, 2 not the article, 3 prose of others."""
    parts = set(NAME_PARTS.findall(name))
    bad = parts & BAD_NAMES
    if parts - BAD_NAMES - WITH_NAMES:
        return 0
    if not bad:
        return 2 if parts & PAGE_NAMES and not in_article else 0
    return 3 if bad & OTHERS_NAMES else 1 if bad <= SOFT_NAMES else 2


class Page:
    """Elements (in page order; parents come first) and blocks of text."""

    def __init__(self):
        self.tag, self.parent, self.points = ["#page"], [-1], [0.0]
        self.mark: dict[int, int] = {}  # element, what its class or id stands for
        self.good: set[int] = set()  # elements with a good name
        self.post: set[int] = set()  # elements named as one post
        self.kind = [""]  # tag and class of each element, nothing for a plain one
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links

    def read(self, html: str) -> None:
        open_, text, links, in_link, skip = [0], [], 0, 0, -1
        at, end, owner = 0, len(html), 0
        low = None

        def flush():
            nonlocal text, links, owner
            if text:
                body = SPACE.sub(" ", unescape("".join(text))).strip()
                if body:
                    self.blocks.append((owner, body, min(links, len(body))))
                text, links = [], 0

        while at < end:
            m = TOKEN.match(html, at)
            at = m.end()
            if m[7] is not None:  # text
                if skip < 0:
                    text.append(m[7])
                    if in_link:
                        links += len(m[7])
                continue
            close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if tag is None:
                continue
            tag = tag.lower()
            if close:
                k = len(open_) - 1
                while k > 0 and self.tag[open_[k]] != tag:
                    if k == skip and self.tag[open_[k]] != tag and tag not in ("body", "html"):
                        k = 0  # nothing inside a left-out element closes what is around it
                        break
                    k -= 1
                if k > 0:
                    if tag in BLOCK and skip < 0:
                        flush()
                    in_link -= sum(self.tag[e] == "a" for e in open_[k:])
                    del open_[k:]
                    owner = self._block_owner(open_)
                    if k <= skip:
                        skip = -1
                elif tag == "p" and skip < 0:
                    flush()
                continue
            if tag in VOID:
                if skip < 0:
                    flush() if tag == "hr" else text.append(" ")
                continue
            attributes = dict((k.lower(), (v or "").strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)) if attributes.strip() else {}
            if tag in RAW and tag not in ("select", "svg", "math", "object"):
                low = html.lower() if low is None else low
                if len(low) != end:
                    low = re.sub(r"[A-Z]", lambda x: x[0].lower(), html)
                z = low.find(f"</{tag}", at)
                at = end if z < 0 else (low.find(">", z) + 1 or end)
                continue
            if tag in BLOCK:
                if skip < 0:
                    flush()
                ends = CLOSES.get(tag)
                for k in range(len(open_) - 1, max(skip, 0), -1):
                    name = self.tag[open_[k]]
                    if name == "p" or ends and name in ends:
                        in_link -= sum(self.tag[e] == "a" for e in open_[k:])
                        del open_[k:]
                        break
                    if name in HOLDS and not (ends and name in ends):
                        break
            self.tag.append(tag)
            self.parent.append(open_[-1])
            self.points.append(TAG_POINTS.get(tag, 0) + self._name_points(attributes))
            self.kind.append(f"{tag} {attributes['class']}" if attributes.get("class") else tag if tag == "section" else "")
            open_.append(len(self.tag) - 1)
            if skip < 0 and self._left_out(tag, attributes, open_):
                flush()
                skip = len(open_) - 1
            if tag == "a":
                in_link += 1
            elif tag == "text" and skip < 0:  # labels of a drawing
                text.append(" ")
            owner = self._block_owner(open_)
        if skip < 0:
            flush()

    def _block_owner(self, open_: list[int]) -> int:
        for e in reversed(open_):
            if self.tag[e] in BLOCK:
                return e
        return 0

    @staticmethod
    def _names(attributes: dict) -> set[str]:
        return set(NAME_PARTS.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))

    def _name_points(self, attributes: dict) -> float:
        return 25.0 if attributes and self._names(attributes) & GOOD_NAMES else 0.0

    def _left_out(self, tag: str, attributes: dict, open_: list[int]) -> bool:
        if tag in DROP:
            return True
        around = {self.tag[e] for e in open_[:-1]}
        in_article = "article" in around or "main" in around or not self.post.isdisjoint(open_[:-1])
        if tag == "header" and not in_article:
            return True
        if not attributes or tag in ("html", "body", "article", "main"):
            return False
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or HIDDEN.search(attributes.get("style", "")):
            return True
        if attributes.get("role", "").lower() in BAD_ROLES:
            return True
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
        if any(not POST_NAMES.isdisjoint(p) and p <= WITH_POSTS for p in (set(NAME_PARTS.findall(x)) for x in names)):
            self.post.add(open_[-1])
        if not GOOD_NAMES.isdisjoint(names):
            self.good.add(open_[-1])
        elif mark := max((name_mark(x, in_article) for x in names), default=0):
            self.mark[open_[-1]] = mark
        return False

    def _worth(self, e: int, body: str, linked: int) -> float:
        """Points of a paragraph."""
        if len(body) < 25 or self.tag[e] in ("li", "h1", "h2", "h3", "h4", "h5", "h6", "th"):
            return 0.0
        return (1 + body.count(",") + min(len(body) // 100, 3)) * (1 - linked / len(body))

    def _drop_marked(self) -> None:
        """Take out the blocks of marked elements that are not the article."""
        n = len(self.tag)
        main = [t in ("article", "main") for t in self.tag]
        marked, near = [False] * n, [False] * n  # in a marked element, in an article
        for k in range(1, n):
            up = self.parent[k]
            marked[k] = marked[up] or k in self.mark
            near[k] = near[up] or main[up] or up in self.good
        total, plain, chars, links, own = [0.0] * n, [0.0] * n, [0] * n, [0] * n, [0] * n
        for e, body, linked in self.blocks:
            worth = self._worth(e, body, linked)
            total[e] += worth
            plain[e] += 0.0 if marked[e] else worth
            own[e] += 0 if marked[e] else len(body)
            chars[e] += len(body)
            links[e] += linked
        best = [0.0] * n  # points of the best article inside
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            for x in (total, plain, chars, links, own):
                x[up] += x[k]
            best[up] = max(best[up], best[k], total[k] if main[k] else 0.0)
        above, n_main = [0] * n, sum(m and c > 0 for m, c in zip(main, own))  # articles with text of their own around, and in all
        gone = [False] * n
        for k in range(1, n):
            up = self.parent[k]
            gone[k] = gone[up]
            above[k] = above[up] + (main[up] and own[up] > 0)
            if k not in self.mark or gone[k]:
                continue
            mark = self.mark[k]
            if mark == 3:
                stays = best[k] > plain[0] == 0
            else:
                stays = best[k] > plain[0] or total[k] > 0 and total[k] >= MOST * total[0]
            soft = mark == 1 and near[k] and 2 * links[k] <= chars[k]
            gone[k] = not (stays and above[k] == n_main or soft)
        self.blocks = [x for x in self.blocks if not gone[x[0]]]

    def main_text(self) -> str:
        """Blocks of the article, joined by two line ends."""
        if self.mark:
            self._drop_marked()
        n = len(self.tag)
        chars, links, points = [0] * n, [0] * n, [0.0] * n
        for e, body, linked in self.blocks:
            chars[e] += len(body)
            links[e] += linked
            worth = self._worth(e, body, linked)
            if worth > 0:
                up, level = (self.parent[e] if self.tag[e] in ("p", "pre", "td", "dd") else e), 0
                while up > 0 and level < 6:
                    points[up] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
                    up, level = self.parent[up], level + 1
        scored = [k for k in range(n) if points[k] > 0]
        for k in range(n - 1, 0, -1):
            chars[self.parent[k]] += chars[k]
            links[self.parent[k]] += links[k]
        density = [links[k] / chars[k] if chars[k] else 0.0 for k in range(n)]
        value = {k: (points[k] + self.points[k]) * (1 - density[k]) for k in scored}
        if value:
            best = max(value, key=lambda k: (value[k], -k))
            keep = self._article(best)
            if keep == {best} and best > 0 and not (keep := self._sections(best, value, points, chars, density)):
                keep = {best}
                least = max(10.0, 0.2 * value[best])
                keep |= {k for k in range(1, n) if self.parent[k] == self.parent[best] and k != best and chars[k] and
                         (value.get(k, 0.0) >= least or self.tag[k] in ("p", "h1", "h2", "pre", "blockquote") and density[k] < 0.25)}
        else:
            keep = {max(range(n), key=lambda k: (self.tag[k] in ("article", "main") and chars[k] > 0, -k))}
        inside = [False] * n
        for k in range(n):
            inside[k] = k in keep or self.parent[k] >= 0 and inside[self.parent[k]]
        return "\n\n".join(body for e, body, _ in self.blocks if inside[e])

    def _sections(self, best: int, value: dict, points: list, chars: list, density: list) -> set[int]:
        """The branches of the highest ancestor of ``best`` with containers like it in several branches; none if no ancestor has.

        A branch counts if its best container has a fifth of the points of ``best``,
        or if the branch or that container has the class of the one of ``best``.
        """
        n = len(self.tag)
        peak, top = [0.0] * n, [0] * n  # value and place of the best container inside
        for k, v in value.items():
            if points[k] * (1 - density[k]) > 0:
                peak[k], top[k] = v, k
        beside: dict[int, list[int]] = {}
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            if top[k] and (not top[up] or peak[k] > peak[up]):
                peak[up], top[up] = peak[k], top[k]
            beside.setdefault(up, []).append(k)
        least = max(10.0, 0.2 * value[best])
        c, up, keep = best, self.parent[best], set()
        while up >= 0:
            if c != best:
                like = [k for k in beside[up] if k != c and density[k] < 0.25 and self.tag[k] in HOLDS and
                        top[k] and (peak[k] >= least or self.kind[c] and self.kind[k] == self.kind[c] or
                                    self.kind[best] and self.kind[top[k]] == self.kind[best])]
                if like:
                    first, last = min(*like, c), max(*like, c)
                    keep = {c, *like} | {k for k in beside[up] if chars[k] and density[k] < 0.25 and
                                         (first < k < last and self.tag[k] in BETWEEN or self.tag[k] in ("p", "h1", "h2", "pre", "blockquote"))}
            c, up = up, self.parent[up]
        return keep

    def _article(self, k: int) -> set[int]:
        found = {k}
        while k > 0:
            if self.tag[k] in ("article", "main"):
                return {k}
            k = self.parent[k]
        return found


def extract(html: str | None) -> str:
    """Main text of a page."""
    if not html:
        return ""
    page = Page()
    page.read(html)
    return page.main_text()


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points)."""
    python_ready(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(html).cast("string").alias("html")) \
        .mapInArrow(run, "page_id long, url string, text string, n_chars long")
