"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf tag path (tags with class names). For each path the text
length and the punctuation per node are taken, smoothed over the nodes in page order, fused by their product
and held against a share of the page's spread; paths above it are content. Inside their common container blocks of content paths
stay, and those of elements that are short by nature (headings, list items, paragraphs, cells); text of other elements below the threshold and lists
of links go, but for lists under a heading that announces sources. Elements beside the container that are of its kind and hold sentences belong to it. Elements whose tag never holds article text (menus, headers, footers, asides, forms, scripts) are left out first, and those whose
class, id or role says so (notices, adverts), unless they hold most of the page's text or the name goes on with a topic; reader comments go in any case, whether a name or a
heading tells. Whole short blocks that call for a click go too.
Null and empty pages give an empty text, and so do pages without one. Whole pages are read, in time that grows with their length; markup
may be broken anywhere. Repeated rows get the same text each; an empty table gives an empty one; other columns pass through, but
main_text is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_of

TOKEN = re.compile(r"[^<]+|<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "annotation", "annotation-xml", "object", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"} | {"math", "semantics", "mi", "mn", "mo", "ms", "mtext", "mrow", "msub", "msup", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mfenced", "mstyle"}
NEVER = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "head", "canvas", "audio", "video", "fieldset", "datalist"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"ul", "ol", "dl", "table", "select", "article", "section", "main", "body", "div"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Class, id and role names of what is not article text.
NOT_ARTICLE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "complementary", "contentinfo", "cookie", "cookies", "consent", "disqus", "dialog", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget"}
#: Of these a name with words of another kind is a topic (related-work, social-history); a companion says no more than what is there (related-posts).
TOPICS = {"banner", "form", "header", "login", "menu", "notice", "notification", "promotion", "recommended", "related", "respond", "search", "share", "sharing", "skip", "social", "subscription"}
COMPANIONS = {"area", "articles", "aside", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "cards", "col", "column", "container", "content", "entries", "fixed", "global", "grid", "group", "icon", "icons", "inner", "item", "items", "js", "left", "link", "links", "list", "main", "media", "message", "mobile", "news", "outer", "page", "panel", "pages", "post", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "small", "sticky", "stories", "story", "text", "this", "tools", "top", "topics", "wrap", "wrapper"}
#: An aside with such a name is a part of the article.
QUOTES = {"pullquote", "quote", "blockquote"}
#: Headings, in lower case: of lists of links that belong to the article, and of what readers wrote.
SOURCES = re.compile(r"(?:[\d.]+\s*)?(?:(?:further|notes and|list of)\s+)?(?:references?|bibliography|sources?|footnotes?|notes|works cited|literature|reading|literatur|quellen|einzelnachweise|références|bibliographie|notes et références|referencias|bibliografía|fuentes)\W*")
RESPONSES = re.compile(r"(?:\d+\s+)?(?:(?:reader|readers'?|user|your|latest)\s+)?(?:comments?|responses?|replies|kommentare?|leserkommentare|commentaires?|réactions|comentarios)(?:\s*\(?\d+\)?)?\W*")
#: What a whole short block says that calls for a click.
CALLS = re.compile(r"(?:please\s+)?(?:(?:accept|reject|allow|manage)\s+(?:all\s+)?cookies(?:\s+settings)?|cookie (?:settings|policy)|subscribe(?:\s+(?:now|today|here))?|sign (?:up|in)(?:\s+(?:now|today|here))?|log ?in|share(?:\s+this(?:\s+(?:article|page|post))?)?|advertisement|sponsored|alle cookies akzeptieren|accepter (?:tous )?les cookies|aceptar (?:todas las )?cookies)\W*")
#: Such a name says what an element has or goes with, not what it is.
ABOUT = {"has", "with", "no", "without", "not", "is"}
#: Names of what never is the article, however much of the page it holds.
READERS = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}
#: Elements whose text is kept inside the container whatever their path's score: parts of an article are often short.
TEXTUAL = HEADINGS | {"", "address", "article", "blockquote", "body", "caption", "dd", "dt", "figcaption", "html", "li", "main", "p", "pre", "section", "summary", "td", "th"}
#: Share of the standard deviation of fused ratios above which a path is content, and nodes smoothed over on each side.
SPREAD, AROUND = 0.75, 1
#: Characters of a text node, with punctuation, that is taken for sentences.
SENTENCE = 60
#: An element with a name of NOT_ARTICLE that holds this share of the page's text is no side matter.
MOST = 0.5


def _name_words(names: str) -> set[str]:
    """The words of NOT_ARTICLE by which names tell that an element is no article."""
    found: set[str] = set()
    for name in names.split():
        words = [x.lower() for x in WORD.findall(name)]
        if words and words[0] not in ABOUT:
            marks = {x for x in words if x in NOT_ARTICLE}
            if marks <= TOPICS and any(len(x) > 2 and not x.isdigit() and x not in NOT_ARTICLE and x not in COMPANIONS for x in words):
                continue
            found.update(marks)
    return found


class Page:
    """The elements of a page in page order, each with its parent and the id of its tag path, and its text nodes.

    Element 0 is the page. Elements know their parents only, and paths are interned by (path of the parent, label): time and memory grow
    with the page, not with its nesting.
    """

    def __init__(self) -> None:
        self.parent, self.tag, self.path, self.depth = [-1], [""], [0], [0]
        self.out, self.named, self.link, self.inside, self.block_tag = [False], [set()], [False], [0], [""]
        self.nodes: list[tuple[int, int, str]] = []  # element, block number, text
        self.paths: dict[tuple[int, str], int] = {}

    def open(self, tag: str, names: str, parent: int, out: bool, named: set[str]) -> int:
        e = len(self.tag)
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault((self.path[parent], f"{tag}.{names}" if names else tag), len(self.paths) + 1))
        self.depth.append(self.depth[parent] + 1)
        self.out.append(out or self.out[parent])
        self.named.append(named)
        self.link.append(tag == "a" or self.link[parent])
        self.inside.append(self.inside[parent] or (e if tag in ("article", "main") else 0))  # the outermost one
        self.block_tag.append(self.block_tag[parent] if tag in INLINE else tag)
        return e

    def sums(self, values: list[int]) -> list[int]:
        """values summed over each element's subtree."""
        out = list(values)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def inherited(self, marks: list[bool]) -> list[bool]:
        for e in range(1, len(marks)):
            marks[e] = marks[e] or marks[self.parent[e]]
        return marks

    def last(self) -> list[int]:
        """The last element of each subtree."""
        out = list(range(len(self.tag)))
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] = max(out[self.parent[e]], out[e])
        return out


def parse(page: str) -> Page:
    found, stack, at, block = Page(), [0], 0, 0
    opened: dict[str, int] = defaultdict(int)
    endless: set[str] = set()  # raw tags that don't end any more: looked for once

    def close(n: int) -> None:
        nonlocal block
        while len(stack) > n:
            tag = found.tag[stack.pop()]
            opened[tag] -= 1
            if tag not in INLINE:
                block += 1

    while (m := TOKEN.match(page, at)) is not None:
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0][:2] not in ("<!", "<?"):
                found.nodes.append((stack[-1], block, m[0]))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for n in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if found.tag[stack[n]] == tag:
                    close(n)
                    break
                if found.tag[stack[n]] in ("article", "main", "body") and tag in INLINE | {"p", "li"}:
                    break
            if tag == "p":
                block += 1
            continue
        attributes = m[3] if m[3] is not None else m[6] or ""
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if end is None:
                endless.add(tag)
            at = end.end() if end else (len(page) if tag in ("script", "style", "textarea", "title") else at)
            continue
        if tag in CLOSES_P and opened["p"]:
            for n in range(len(stack) - 1, 0, -1):
                if found.tag[stack[n]] == "p":
                    close(n)
                    break
                if found.tag[stack[n]] not in INLINE:
                    break
        if tag in CLOSED_BY_SAME:
            for n in range(len(stack) - 1, 0, -1):
                if found.tag[stack[n]] in CLOSED_BY_SAME[tag]:
                    close(n)
                    break
                if found.tag[stack[n]] in SCOPES:
                    break
        if tag not in INLINE:
            block += 1
        if tag in VOID or attributes.endswith("/") and tag in INLINE:
            if tag == "br":
                found.nodes.append((stack[-1], block, " "))
            continue
        names = " ".join(filter(None, (x for g in NAMES.findall(attributes) for x in g))) if attributes else ""
        parent, frame = stack[-1], tag in ("html", "body")
        quote = tag == "aside" and any(x.lower() in QUOTES for x in WORD.findall(names))
        out = not frame and (tag in NEVER and not quote or tag == "header" and not found.inside[parent] or bool(attributes and HIDDEN.search(attributes)))
        named = _name_words(names) if names and not frame and tag not in ("article", "main") else set()
        stack.append(found.open(tag, names, parent, out, named))
        opened[tag] += 1
    return found


def _content(paths: list[int], texts: list[str], links: list[bool]) -> set[int]:
    """The content paths of a page."""
    size, points, nodes, linked = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text, link in zip(paths, texts, links, strict=True):
        n = len(text)
        size[path] += n
        points[path] += len(PUNCTUATION.findall(text))
        nodes[path] += 1
        linked[path] += n * link
    ratio = {p: size[p] / nodes[p] for p in size}
    marks = {p: (1 + points[p]) / nodes[p] for p in size}
    fused: dict[int, list[float]] = defaultdict(list)
    for i, path in enumerate(paths):
        near = paths[max(0, i - AROUND) : i + AROUND + 1]
        weights = [2.0 if p == path else 1.0 for p in near]
        whole = sum(weights)
        length = sum(w * ratio[p] for w, p in zip(weights, near, strict=True)) / whole
        dots = sum(w * marks[p] for w, p in zip(weights, near, strict=True)) / whole
        fused[path].append(length * dots)
    score = {p: sum(v) / len(v) * (1 - linked[p] / max(1, size[p])) for p, v in fused.items()}
    mean = sum(score.values()) / len(score)
    spread = (sum((x - mean) ** 2 for x in score.values()) / len(score)) ** 0.5
    return {p for p, x in score.items() if x > 0 and x >= SPREAD * spread}


def _headings(tree: Page, nodes: list[tuple[int, int, str]]) -> dict[int, str]:
    """The text of each heading element, in lower case."""
    found: dict[int, list[str]] = defaultdict(list)
    for e, _, text in nodes:
        while e and tree.tag[e] in INLINE:
            e = tree.parent[e]
        if tree.tag[e] in HEADINGS:
            found[e].append(text)
    return {e: " ".join("".join(x).split()).lower() for e, x in found.items()}


def _titles(tree: Page, nodes: list[tuple[int, int, str]]) -> dict[int, str]:
    """The heading that a section or div begins with."""
    found, begun = {}, set()
    headings = _headings(tree, nodes)
    for e, _, text in nodes:
        if text.isspace():
            continue
        heading = e
        while heading and tree.tag[heading] in INLINE:
            heading = tree.parent[heading]
        up = tree.parent[heading] if heading in headings else heading
        if heading in headings and up not in begun and tree.tag[up] in ("section", "div"):
            found[up] = headings[heading]
        while up and up not in begun:
            begun.add(up)
            up = tree.parent[up]
    return found


def _sources(tree: Page, nodes: list[tuple[int, int, str]]) -> set[int]:
    """The lists that follow a heading of SOURCES, in its parent or alone in an element there."""
    under = {tree.parent[e] for e, text in _headings(tree, nodes).items() if SOURCES.fullmatch(text)}
    found, last = set(), {}
    headings = _headings(tree, nodes)
    for e, tag in enumerate(tree.tag):
        if e in headings:
            last[tree.parent[e]] = headings[e]
        elif tag in ("ul", "ol"):
            near = [tree.parent[e], tree.parent[tree.parent[e]]] if tree.parent[e] > 0 else [tree.parent[e]]
            if any(p in under and SOURCES.fullmatch(last.get(p, "")) for p in near):
                found.add(e)
    return found


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by two line feeds."""
    if not page:
        return ""
    tree = parse(page)
    everything = [(e, b, entities.unescape(t)) for e, b, t in tree.nodes if not tree.out[e]]
    titles = _titles(tree, everything)
    readers, size = tree.inherited([bool(w & READERS) or bool(RESPONSES.fullmatch(titles.get(e, ""))) for e, w in enumerate(tree.named)]), [0] * len(tree.tag)
    for e, _, text in everything:
        size[e] += len(text.strip()) * (not readers[e])
    size = tree.sums(size)
    readers = tree.inherited([bool(w & READERS) or (bool(RESPONSES.fullmatch(titles.get(e, ""))) and size[e] == 0 < size[0]) for e, w in enumerate(tree.named)])
    side = tree.inherited([readers[e] or bool(w) and size[e] < MOST * size[0] for e, w in enumerate(tree.named)])
    nodes = [x for x in everything if not side[x[0]]]
    if not any(t.strip() for _, _, t in nodes):  # names may mislead where they leave nothing
        nodes = everything
    solid = [x for x in nodes if not x[2].isspace()]
    if not solid:
        return ""
    inside = [x for x in solid if tree.inside[x[0]]]
    solid = inside or solid
    chosen = _content([tree.path[e] for e, _, _ in solid], [t for _, _, t in solid], [tree.link[e] for e, _, _ in solid])
    # The container: the deepest element that holds most of the text of content paths.
    held = [0] * len(tree.tag)
    for e, _, text in solid:
        if tree.path[e] in chosen:
            held[e] += len(text)
    held = tree.sums(held)
    last = tree.last()
    container = max((e for e in range(1, len(held)) if held[e] and held[e] >= 0.8 * held[0]), key=tree.depth.__getitem__, default=0)
    within = lambda e: container <= e <= last[container]
    if inside:  # an article or main element around the container is the container
        # Without a content path (all text is in links) there is no container: all blocks but lists of links are kept.
        top = next((tree.inside[e] for e, _, _ in solid if tree.path[e] in chosen and within(e)), 0)
        container = top if top and (not container or tree.depth[container] >= tree.depth[top]) else container
    else:
        while container and tree.tag[container] in INLINE | {"p", "li", "td"} and tree.parent[container] > 0:
            container = tree.parent[container]
    # What stands beside the container in elements of its kind is part of it, if it reads like it: sentences in paragraphs or on content paths, few links.
    beside: set[int] = set()
    if container and not tree.inside[container]:
        prose, linked_text = [0] * len(tree.tag), [0] * len(tree.tag)
        for e, _, text in solid:
            sentences = (tree.path[e] in chosen or tree.block_tag[e] in ("p", "blockquote")) and len(text) >= SENTENCE and PUNCTUATION.search(text) is not None
            prose[e] += len(text) * (sentences and not tree.link[e])
            linked_text[e] += len(text) * (not sentences)
        prose, linked_text = tree.sums(prose), tree.sums(linked_text)
        alike = [tree.parent[e] == tree.parent[container] and tree.tag[e] == tree.tag[container] and e != container and prose[e] > 2 * linked_text[e] for e in range(len(tree.tag))]
        beside = {e for e, x in enumerate(tree.inherited(alike)) if x}
    # Inside, a block stays if its path is content, or as a part of an article that is short by nature; lists of links don't.
    kept = {b for e, b, _ in solid if (within(e) or e in beside) and (tree.path[e] in chosen or not chosen or tree.block_tag[e] in TEXTUAL)}
    text_in, linked = [0] * len(tree.tag), [0] * len(tree.tag)
    for e, _, text in solid:
        text_in[e] += len(text.strip())
        linked[e] += len(text.strip()) * tree.link[e]
    text_in, linked = tree.sums(text_in), tree.sums(linked)
    sources = _sources(tree, everything)
    menu = tree.inherited([e not in sources and t in ("ul", "ol") and n > 0 and k > 0.9 * n for e, (t, n, k) in enumerate(zip(tree.tag, text_in, linked, strict=True))])
    kept -= {b for e, b, _ in solid if menu[e]}
    blocks: dict[int, list[str]] = {}
    for _, b, text in nodes:
        if b in kept:
            blocks.setdefault(b, []).append(text)
    joined = (" ".join("".join(x).split()) for _, x in sorted(blocks.items()))
    return "\n\n".join(x for x in joined if x and not (len(x) < 60 and CALLS.fullmatch(x.lower())))


@F.pandas_udf(T.StringType())
def main_texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with main_text (replaced if there is one) in place of the html column."""
    return pages.withColumn("main_text", main_texts(text_of(html))).drop(html)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


QUERIES = {"op4_html_extraction": op4_html_extraction}
ORACLES: dict[str, str] = {}
