"""HTML main text by tree scoring: paragraphs pass points for length and commas to their ancestors, discounted by link density; the best
container is kept, with the siblings (its own, and its ancestors') whose points are near its own. Tags and everyday names that tell of the
article or of furniture only change points. Elements that can only be furniture go before scoring; so do those of its names, unless they are
prose of a named article or most of the page."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import rows_of, small_batches, table

# Element names of HTML.
#: Dropped with all they hold.
DROPPED = frozenset("script style noscript template head title nav footer aside form iframe object embed svg canvas math button select option textarea input label fieldset datalist dialog menu audio video map applet noframes frameset frame".split())
#: Their content is raw text up to the end tag.
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Inline elements: they never part a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br area nobr output meter progress".split())
#: Those that a paragraph ends at; end tags that may be left out.
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("html body table ul ol dl article section main div td th nav aside footer header form".split())
#: Names (parts of class and id) that only page furniture bears: elements of these names go, paragraphs and headings with the first set alone. Fixed values.
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adslot adbox sponsored cookie cookies gdpr newsletter outbrain taboola hidden noprint".split())
FURNITURE = ADVERTS | frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager masthead topbar toolbar sidebar widget banner promo comments commentlist disqus replies share sharing addthis popup modal overlay subscribe signup login paywall".split())
#: Of these, those that may also name a part of a story: in a named article such an element stays if it reads as prose. Fixed values.
SOFT = frozenset("nav navigation menu widget banner promo share sharing replies toolbar pager popup modal overlay subscribe signup login paywall".split())
#: What stands beside such a word in a name of several parts; any other word there (market-share) makes it another name. Fixed values.
GENERIC = frozenset("area bar block body bottom box btn button buttons container content desktop div fixed float footer global google group header inner item items layer left link links list main mobile module outer page panel post posts primary region right row secondary section site slot social sticky sub text title top unit user wrap wrapper".split())
#: Whole class names of the same kind. Fixed values.
NAMED_OFF = frozenset("sr-only visually-hidden screen-reader-text skip-link site-header site-footer page-header page-footer comment-list comment-form related-posts related-articles tag-list social-links".split())
#: Everyday words that often name furniture take points from a container, and those that often name the article add some; neither removes text. Fixed values.
WEAK = frozenset("header footer foot side aside rail related recommended trending popular comment respond discussion notice alert notification social follow form search register copyright legal disclaimer tags print toc teaser meta byline".split())
STRONG = frozenset("article main content post entry story body text page".split())
#: How a block of reader comments (with their number: in a named article too) or a notice of cookies opens, whatever its name. Fixed values.
NUMBERED = re.compile(r"\d|\(")
OPENS_OFF = re.compile(r"(?:\d+\s+)?(?:(?:reader |user )?comments?|responses?|replies|leave a (?:comment|reply)|add a comment|kommentare?|commentaires?|comentarios?)(?:\s*\(\d+\)|\s*:|\s+\d+)?$", re.I)
COOKIES = re.compile(r"\b(?:we|this (?:web)?site|our (?:web)?site|wir|nous|este sitio|diese (?:web)?seite)\b.{0,40}\bcookies\b", re.I)
ROLES_OFF = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[-_\s]+")
CONCEALED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Blocks that hold text and no containers; how a sentence ends.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption summary legend address center".split())
WHOLE = frozenset("#root html body".split())
ENDS = (".", "!", "?", "…", "。", "”", '"')
WANTED = ("class", "id", "role", "hidden", "aria-hidden", "style")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "score", "chars", "linked", "links", "net", "first", "titled")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.score = self.net = 0.0
        self.chars = self.linked = self.links = 0
        self.first, self.titled = "", False


def parse(page: str) -> Node:
    """A tree with the end tags that HTML lets authors leave out. Text stays raw; raw elements lose their content."""
    root = now = Node("#root", {}, None)
    at, end = 0, len(page)
    for m in iter(lambda: TOKEN.search(page, at), None):
        if m.start() > at:
            now.children.append(page[at : m.start()])
        at = max(m.end(), at + 1)
        if m[0].startswith("<![CDATA["):
            now.children.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "p" and not _open(now, "p"):
                continue
            n = now
            while n.parent and n.tag != name:
                if n.tag in SCOPES and name in INLINE:
                    n = root
                    break
                n = n.parent
            if n.parent:
                now = n.parent
            continue
        if name in ENDS_P and (p := _open(now, "p")):
            now = p.parent
        for other in CLOSED_BY.get(name, ()):
            n = now
            while n.parent and n.tag != other and n.tag not in ("table", "ul", "ol", "dl", "select"):
                n = n.parent
            if n.tag == other:
                now = n.parent
        text = m[3] or ""
        attrs = {k: v for k, v in ((a[1].lower(), a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(text)) if k in WANTED} if text and not text.isspace() else {}
        node = Node(name, attrs, now)
        now.children.append(node)
        if name in RAW and not text.endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
            at = close.end() if close else end
        elif name not in VOID and not (text.endswith("/") and name in ("svg", "path")):
            now = node
    if at < end:
        now.children.append(page[at:])
    return root


def _open(n: Node, tag: str) -> Node | None:
    """The open element of that name, up to the nearest container."""
    while n.parent:
        if n.tag == tag:
            return n
        if n.tag in SCOPES:
            return None
        n = n.parent
    return None


def names(n: Node) -> set[str]:
    """The parts of an element's class and id, in lower case."""
    return set(PARTS.split(f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower())) if n.attrs else set()


def off(n: Node, in_article: bool, forms: bool) -> bool:
    """Whether an element is page furniture by its element name, its role, or a name that only furniture bears."""
    if (n.tag in DROPPED and (forms or n.tag != "form")) or (n.tag == "header" and not in_article):
        return True
    a = n.attrs
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES_OFF or CONCEALED.search(a.get("style", "")):
        return True
    if n.tag in ("body", "html", "article", "main", "#root"):
        return False
    return not NAMED_OFF.isdisjoint(f"{a.get('class', '')} {a.get('id', '')}".lower().split())


def furniture(n: Node) -> set[str]:
    """The words of FURNITURE that an element's class or id is named by: alone in a name, or beside generic words and numbers only."""
    out = set()
    for name in f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower().split() if n.attrs else ():
        parts = [x for x in PARTS.split(name) if x]
        if all(x in FURNITURE or x in GENERIC or x.isdigit() for x in parts):
            out.update(x for x in parts if x in FURNITURE)
    return out


def trim(n: Node, forms: bool = True) -> None:
    """Take furniture out of the tree (without recursion: pages may nest deeply). forms: forms are furniture too."""
    todo = [(n, False)]
    while todo:
        x, inside = todo.pop()
        inside = inside or x.tag in ("article", "main")
        if x.children:
            x.children = [c for c in x.children if isinstance(c, str) or not off(c, inside, forms)]
            todo += [(c, inside) for c in x.children if not isinstance(c, str)]


def in_order(root: Node) -> list[Node]:
    """All nodes, children after parents."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in reversed(n.children) if not isinstance(c, str)]
    return order


def text_weight(n: Node) -> int:
    """Characters outside links."""
    return n.chars - n.linked


def measure(root: Node) -> list[Node]:
    """Fill chars, linked, first and titled; all nodes, children after parents."""
    order = in_order(root)
    for n in reversed(order):
        below = [c for c in n.children if not isinstance(c, str)]
        n.chars = sum(len(SPACE.sub(" ", c).strip()) for c in n.children if isinstance(c, str)) + sum(c.chars for c in below)
        n.linked = n.chars if n.tag == "a" else sum(c.linked for c in below)
        n.titled = (n.tag in ("h1", "article", "main")) + sum(c.titled for c in below)
        for c in n.children:
            n.first = SPACE.sub(" ", html.unescape(c)).strip() if isinstance(c, str) else c.first
            if n.first:
                break
    return order


def prose(n: Node) -> bool:
    """Whether an element reads as part of a story: few links, and a paragraph of two points or more that ends as sentences do."""
    if density(n) >= 0.33:
        return False
    text = SPACE.sub(" ", " ".join(blocks([n])))
    return text.endswith(ENDS) and any(len(b) >= 50 and points(len(b), _commas_in(b), 0) >= 1.5 for b in blocks([n]))


def drop_told(root: Node) -> None:
    """Take out what its name or its opening tells to be furniture; outside a named article, not what holds most of the page's own
    text and all its titles and named articles.

    In one, a name of SOFT removes no prose, and an opening removes only comments that tell their number.
    """
    measure(root)
    most = text_weight(root) / 2
    todo = [(root, root.tag in ("article", "main"))]
    while todo:
        n, inside = todo.pop()
        kept = []
        for c in n.children:
            if isinstance(c, str):
                kept.append(c)
                continue
            within = inside or c.tag in ("article", "main") or c.attrs.get("role", "").lower() in ("article", "main")
            if c.tag not in WHOLE and not (c.tag in ("article", "main")):
                named = furniture(c)
                if c.tag in PARAGRAPHS or c.tag in INLINE:
                    named &= ADVERTS
                elif told(c, inside, most if c.titled == root.titled else root.chars):
                    continue
                if named and (inside or text_weight(c) <= most or c.titled < root.titled) and not (inside and named <= SOFT and prose(c)):
                    continue
            kept.append(c)
            todo.append((c, within))
        n.children = kept


def told(n: Node, inside: bool, most: float) -> bool:
    if n.titled:
        return False
    if OPENS_OFF.match(n.first):
        return not inside or NUMBERED.search(n.first) is not None
    return not inside and text_weight(n) <= most and COOKIES.search(n.first) is not None


def points(chars: int, commas: int, linked: int) -> float:
    """Of a paragraph: one, one for each comma, one for each hundred characters up to three, less its share of link text."""
    return (1 + commas + min(chars / 100, 3)) * (1 - linked / chars) if chars else 0.0


def score(root: Node) -> list[Node]:
    """Fill chars, linked, links, score and net (the points that count) bottom up; return all nodes, children after parents.

    A paragraph is a block's own run of text: its strings, and those of inline elements in it. Its points go to its parent in full, then
    to the ancestors by a half, a third, a quarter and a fifth. A container with bare text is its own parent, in full.
    """
    order = in_order(root)
    for n in reversed(order):
        own = [s for c in n.children if isinstance(c, str) and (s := SPACE.sub(" ", c).strip())]
        chars = sum(map(len, own))
        below = [c for c in n.children if not isinstance(c, str)]
        n.chars = chars + sum(c.chars for c in below)
        n.linked = n.chars if n.tag == "a" else sum(c.linked for c in below)
        n.links = (n.tag == "a") + sum(c.links for c in below)
        inline = [c for c in below if c.tag in INLINE]
        run = chars + sum(c.chars for c in inline)
        if run and n.tag not in INLINE:
            commas = sum(map(_commas_in, own)) + sum(_commas(c) for c in inline)
            gain, up = points(run, commas, sum(c.linked for c in inline)), n.parent if n.tag in PARAGRAPHS and n.parent else n
            for depth in range(1, 6):
                up.score += gain / depth
                up = up.parent
                if up is None:
                    break
    for n in order:
        said = names(n)
        n.net = n.score * (1 - density(n)) * (1 if said.isdisjoint(WEAK) else 0.5) * (1 if said.isdisjoint(STRONG) else 1.25)
        if n.tag not in PARAGRAPHS and n.tag not in INLINE and 0 < n.chars < 400 and n.first.startswith("©"):
            n.net *= 0.5
        if n.tag in WHOLE and not any(c.strip() if isinstance(c, str) else c.tag in PARAGRAPHS or c.tag in INLINE for c in n.children):
            # The page as a whole holds no paragraph itself: some container in it is better.
            n.net = 0.0
    return order


def _commas_in(s: str) -> int:
    return s.count(",") + s.count("、") + s.count("，")


def _commas(n: Node) -> int:
    total, todo = 0, [n]
    while todo:
        x = todo.pop()
        for c in x.children:
            if isinstance(c, str):
                total += _commas_in(c)
            else:
                todo.append(c)
    return total


def density(n: Node) -> float:
    return n.linked / n.chars if n.chars else 0.0


def keeps(c: Node | str, top: Node, beside: bool, before: bool) -> bool:
    """Whether a sibling of the best container (beside), or of an ancestor of it, belongs to the article.

    A container must have a fifth of the best points, and ten or half of the best; another <article>, or one of the same element and class as the best, is given that fifth. A
    paragraph beside it stays if it reads as text: long with few links, or a sentence without any. So does a title before it.
    """
    if isinstance(c, str) or c.tag in INLINE:
        text = c.strip() if isinstance(c, str) else ""
        chars, share = (len(text), 0.0) if isinstance(c, str) else (c.chars, density(c))
        return beside and chars > 0 and share < 0.25 and (chars >= 80 or top.tag in PARAGRAPHS)
    if not c.chars:
        return False
    if c.tag in ("h1", "h2"):
        return before and density(c) < 0.5
    if c.tag in PARAGRAPHS:
        return beside and (density(c) < 0.25 if c.chars >= 80 else not c.linked and text_of(c).endswith(ENDS))
    same = c.tag == top.tag and c.attrs.get("class") == top.attrs.get("class") and (c.tag == "article" or "class" in c.attrs)
    same = same or (c.tag == top.tag == "article" and prose(c))
    return c.net + (0.2 * top.net if same else 0.0) >= max(0.0 if same else min(10.0, 0.5 * top.net), 0.2 * top.net)


def text_of(n: Node) -> str:
    return " ".join(blocks([n]))


def clean(parts: list[Node | str], top: Node) -> list[Node | str]:
    """parts without what scoring tells to be furniture inside them: blocks of links, and bare blocks of few points beside the paragraphs of
    a page whose best container is its body."""
    out = []
    whole = top.tag in WHOLE
    for x in parts:
        if isinstance(x, str):
            out.append(x)
            continue
        todo = [x]
        while todo:
            n = todo.pop()
            kept = []
            for c in n.children:
                if isinstance(c, str) or c.tag in INLINE or c.tag in PARAGRAPHS:
                    kept.append(c)
                elif (c.links >= 3 and density(c) >= 0.8) or (whole and n is top and top.net >= 10 and c.tag != "table" and c.net < 0.05 * top.net and not any(isinstance(d, Node) and d.tag in PARAGRAPHS for d in c.children)):
                    continue
                else:
                    kept.append(c)
                    todo.append(c)
            n.children = kept
        out.append(x)
    return out


def main_nodes(root: Node) -> list[Node | str]:
    """The kept parts of the tree in page order."""
    order = score(root)
    named = [n for n in order if n.chars and (n.tag in ("article", "main") or n.attrs.get("role", "").lower() in ("main", "article"))]
    tops = [n for n in named if n.tag == "article" or n.attrs.get("role") == "article"] or named
    if tops:
        # A tag that names the article adds to its points: it has the best of any container in it, and one more for a hundred characters.
        wanted, high = {id(n) for n in tops}, {}
        for n in reversed(order):
            most = max([n.net, *(high[id(c)] for c in n.children if not isinstance(c, str))])
            if id(n) in wanted:
                most = n.net = most + n.chars * (1 - density(n)) / 100
            high[id(n)] = most
    top = max(order, key=lambda n: n.net, default=root)
    if not top.net:
        return tops[:1] or [root]
    kept: list[Node | str] = [top]
    n = top
    while n.parent:
        at = next(i for i, c in enumerate(n.parent.children) if c is n)
        sides, beside = n.parent.children, n is top
        kept = [c for c in sides[:at] if keeps(c, top, beside, True)] + kept + [c for c in sides[at + 1 :] if keeps(c, top, beside, False)]
        n = n.parent
    return clean(kept, top)


def blocks(parts: list[Node | str]) -> list[str]:
    """Texts of the blocks under parts: references decoded, white space as one blank, trimmed, empty ones left out."""
    out, run = [], []

    def close() -> None:
        text = SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list = list(reversed(parts))
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif x.tag in INLINE:
            todo += reversed(x.children)
        else:
            close()
            todo.append(None)
            todo += reversed(x.children)
    close()
    return out


def extract(page: str | None) -> str:
    """The main text: its blocks joined by one newline."""
    root = parse(page or "")
    trim(root, forms=not in_form(page))
    drop_told(root)
    return "\n".join(blocks(main_nodes(root)))


def in_form(page: str | None) -> bool:
    """Whether most of a page's own text lies in forms: then they are its container, not furniture."""
    if not page or "<form" not in page.lower():
        return False
    root = parse(page)
    trim(root, forms=False)
    order = measure(root)
    inner = {id(c) for n in order if n.tag == "form" for c in in_order(n)[1:]}
    held = sum(text_weight(n) for n in order if n.tag == "form" and id(n) not in inner)
    return 2 * held > text_weight(root)


SCHEMA = "page_id long, url string, text string, n_chars long"


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each page.

    pages: page_id, url, html (others ignored). Null and empty pages have an empty text. Pages are read one by one, so repeated rows
    repeat; of equally scored containers, named articles too, the first in page order is the best and the others stay as its siblings. Very
    long pages are read whole, by tokens, without recursion. An empty table gives no rows.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = iter(batch.column("url").to_pylist())
            for ids, texts in rows_of(iter([batch.select(["page_id", "html"])])):
                out = [extract(t).encode("utf-8", "replace").decode() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([next(urls) for _ in ids], pa.string()), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


ORACLE: dict[str, str] = {}
