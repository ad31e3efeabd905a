"""HTML extraction by equivalence classes of tokens over the pages of one host.

Pages of a host are dealt by hash into groups of about GROUP pages (GROUP_BYTES at most on average), so that a hot host is
many groups. In a group every page is read into tokens: elements, told apart by their path of tags and class names, and
whole text nodes, told apart by path and text. Copies of a page count once in what follows.

1. Tokens with the same vector of occurrences per page, on half of the pages or more, form an equivalence class. A class is valid if its tokens come in one
   order, over and over, on every page (of a class that no page has twice, tokens that break the order are left out), and if its occurrences lie within one
   slot of each class taken before (nesting). The valid classes, largest support first, are the template.
2. Text between the template's tokens fills its slots. Text of the template itself, on SUPPORT of the pages and on two at least, is none of a page's own.
3. The main element is the template's element with the most slot text that is no link, over the group, from the outermost down as long as one element,
   found once on nearly all pages, has most of all the text and leaves no title behind. On a page, its bounds are those of the marked element that
   it is, lies in or holds: an article, else a main element, else, of those that hold most of it, one whose class name says so; siblings of the same tag and class
   names come along. A page without that element goes by its marks alone, as does a page that has no other of its host beside it and no text outside them.
4. The main text is the main element's text in page order, without menus, headers, footers, sidebars, notices, adverts, forms and comments, told by
   tag, role and class name inside it. Within a marked element nothing else goes; within any other, the template's text does.

An excluded element that holds the page's only article or main element is no menu or form but a wrapper, and counts for nothing; so do one that holds
the only h1 and most of the text, and a form outside which there is no text.

Text: references decoded, white space inside a block to one space, blocks joined by a blank line.

Defined results: null html is empty; no main text gives an empty string; pages with null or hostless URLs are one host; a very long page is read to its end;
repeated pages are pages each; where more than OTHER of all text would be the template's the pages are copies of one another, and no text is; html that never
ends its elements, quotes or comments is read to the end; an empty table gives no rows; columns but page_id, url and html are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .url_rules import host_of

GROUP, GROUP_BYTES, SUPPORT, OTHER = 64, 4 << 20, 0.8, 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>"']+|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup, up to their end tag.
_RAW = set("script style textarea title noscript iframe noembed noframes xmp template".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
#: An open element that a start tag ends, within its list or table.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "menu", "select"}
_OUT_TAGS = set("nav footer aside script style noscript template iframe button select input textarea label head svg canvas object dialog menu".split())
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|side-?bar|aside|widget|footer|masthead|topbar|site-?header|page-?header|"
    r"cookies?\w*|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscri\w+|sign-?up|login|comments?|commentlist|disqus|respond|reply|replies|"
    r"share|sharing|social|related|recommend\w*|pagination|pager|tags|toolbar|skip-?link|print-?only|copyright)(?:$|[\s_-])"
)
_HEAD_NAMES = re.compile(r"(?:^|[\s_-])(?:header|head|top|logo)(?:$|[\s_-])")
_MAIN_NAMES = re.compile(r"(?:^|\s)(?:(?:article|post|entry|story|main|page|blog|news)[_-]?(?:body|content|text|main)?|content(?:[_-]?(?:body|main|area|inner))?|(?:body|main)[_-]?(?:copy|text|content))(?:$|\s)")


class _Paths:
    """Paths of tags and class names as numbers, for the pages of a group; a path's parent has a smaller number."""

    def __init__(self):
        self.known: dict[tuple[int, str], int] = {}
        self.parent, self.tag, self.depth, self.titled = [-1], [""], [0], [False]

    def below(self, path: int, tag: str, name: str) -> int:
        key = (path, f"{tag}.{name}" if name else tag)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.parent)
            self.parent.append(path)
            self.tag.append(tag)
            self.depth.append(self.depth[path] + 1)
            self.titled.append(self.titled[path] or tag == "h1")
        return found


class _Page:
    """Tokens (path, text or None) of a page in order; its text nodes (token, block, text, container, in a link); and its containers: blocks and
    excluded elements, of which number 0 is the page. A container's parent comes before it."""

    def __init__(self, html: str, paths: _Paths):
        self.paths = paths
        self.tokens: list[tuple[int, str | None]] = []
        self.texts: list[tuple] = []
        self.path, self.parent, self.kind, self.like, self.shut, self.title = [0], [-1], [""], [("", "")], [""], [False]
        self._read(html)
        self._lift()
        self.clear = [not self.shut[0]]  # nothing around excludes it
        for c in range(1, len(self.path)):
            self.clear.append(not self.shut[c] and self.clear[self.parent[c]])

    def _read(self, html: str) -> None:
        stack: list[tuple] = []  # tag, path, container, link, inside a marked element
        opened: Counter = Counter()
        block, at = 0, 0

        def cut(i: int) -> None:
            opened.subtract(e[0] for e in stack[i:])
            del stack[i:]

        def text(raw: str) -> None:
            plain = unescape(raw)
            if not plain:
                return
            _, path, container, link, _ = stack[-1] if stack else ("", 0, 0, False, False)
            token = None
            if not plain.isspace():
                token = len(self.tokens)
                self.tokens.append((path, " ".join(plain.split())))
                self.title[container] |= self.paths.titled[path]
            self.texts.append((token, block, plain, container, link))

        while at < len(html):
            m = _TOKEN.search(html, at)
            if not m:
                text(html[at:])
                break
            if m.start() > at:
                text(html[at : m.start()])
            at = max(m.end(), at + 1)
            tag = m["tag"]
            if not tag:
                if m[0].startswith("<![CDATA["):
                    text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            tag = tag.lower()
            if tag in _BLOCK:
                block += 1
            if m["end"]:
                if tag == "p" and not opened["p"]:
                    block += 1
                for i in range(len(stack) - 1, -1, -1) if opened[tag] > 0 else ():
                    if stack[i][0] == tag:
                        cut(i)
                        break
                    if stack[i][0] in ("table", "body") and tag not in ("html", "table"):
                        break
                continue
            if tag in _BLOCK and opened["p"] > 0:
                for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                    if stack[i][0] == "p":
                        cut(i)
                        break
                    if stack[i][0] in _BLOCK:
                        break
            if tag in _ENDS and any(opened[t] > 0 for t in _ENDS[tag]):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _SCOPE:
                        break
                    if stack[i][0] in _ENDS[tag]:
                        cut(i)
                        break
            attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m["attrs"] or "")}
            _, path, container, link, inside = stack[-1] if stack else ("", 0, 0, False, False)
            name = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip().lower()
            path = self.paths.below(path, tag, name)
            self.tokens.append((path, None))
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = end.start() if end else len(html)
                if end:  # its content is not read; the end tag is
                    opened[tag] += 1
                    stack.append((tag, path, container, link, inside))
                continue
            if tag in _VOID or (m["attrs"] or "").rstrip().endswith("/") and tag not in _BLOCK:
                if tag == "br":
                    self.texts.append((None, block, " ", container, link))
                continue
            if tag in ("td", "th"):
                self.texts.append((None, block, " ", container, link))
            kind, shut = self._judge(tag, attrs, name, inside)
            if tag in _BLOCK or tag == "td" or shut:
                self.path.append(path)
                self.parent.append(container)
                self.kind.append(kind)
                self.shut.append(shut)
                self.like.append((tag, attrs.get("class", "").lower()))
                self.title.append(False)
                container = len(self.path) - 1
            opened[tag] += 1
            stack.append((tag, path, container, link or tag == "a", inside or bool(kind)))

    @staticmethod
    def _judge(tag: str, attrs: dict[str, str], name: str, inside: bool) -> tuple[str, str]:
        """What marks an element as the main one, and what excludes it: its tag, role or style, its name, or being a form."""
        role = attrs.get("role", "").lower()
        if tag in _OUT_TAGS or role in _OUT_ROLES or tag == "header" and not inside or "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower():
            return "", "tag"
        if tag == "article" or "articlebody" in attrs.get("itemprop", "").lower():
            return "article", ""
        if tag == "main" or role == "main":
            return "main", ""
        if tag == "form":
            return "", "form"
        if name and tag not in ("html", "body") and (_OUT_NAMES.search(name) or not inside and tag != "h1" and _HEAD_NAMES.search(name)):
            return "", "name"
        return "named" if name and tag in ("div", "section", "td") and _MAIN_NAMES.search(name) else "", ""

    def _lift(self) -> None:
        """Wrappers are not excluded."""
        some = [c for c, x in enumerate(self.shut) if x in ("name", "form")]
        if not some:
            return
        above, strict = [0] * len(self.path), [False] * len(self.path)  # the nearest excluded ancestor or self; is one excluded by its tag
        for c in range(1, len(self.path)):
            above[c] = c if self.shut[c] else above[self.parent[c]]
            strict[c] = self.shut[c] == "tag" or strict[self.parent[c]]

        def open_up(c: int) -> None:
            while c := above[c]:
                self.shut[c] = ""
                c = self.parent[c]

        marks = [c for c, k in enumerate(self.kind) if k in ("article", "main")]
        if marks:
            if all(above[c] for c in marks):
                for c in marks:
                    if not strict[c] and not _OUT_NAMES.search(self.like[c][1]):  # a comment can be an article, too
                        open_up(c)
            return
        size = [0] * len(self.path)
        for token, _, plain, container, _ in self.texts:
            size[container] += len(plain) if token is not None and not strict[container] else 0
        free = sum(n for c, n in enumerate(size) if not above[c])
        everything = sum(size)
        for c in range(len(size) - 1, 0, -1):
            size[self.parent[c]] += size[c]
        titles = [c for c, t in enumerate(self.title) if t]
        if titles and all(above[c] for c in titles):
            for c in titles:
                if not strict[c] and 2 * size[above[c]] >= everything:
                    open_up(c)
        elif not free:
            for c in some:
                if self.shut[c] == "form":
                    self.shut[c] = ""

    def sizes(self, fixed: set[tuple]) -> list[int]:
        """Characters of text by container, links against them; without what is excluded inside or part of the template."""
        size = [0] * len(self.path)
        for token, _, plain, container, link in self.texts:
            if token is not None and self.tokens[token] not in fixed:
                size[container] += len(plain) * (-1 if link else 1)
        for c in range(len(size) - 1, 0, -1):
            if not self.shut[c]:
                size[self.parent[c]] += size[c]
        return size


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing run of values, which need not be neighbours."""
    ends, at, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(ends, v)
        before.append(at[k - 1] if k else -1)
        ends[k : k + 1], at[k : k + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _classes(pages: list[_Page]) -> tuple[list[list[tuple]], dict[tuple, dict[int, list[int]]]]:
    """The valid classes, largest support first, and every token's occurrences per page."""
    where: dict[tuple, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for i, page in enumerate(pages):
        for at, token in enumerate(page.tokens):
            where[token][i].append(at)
    groups: dict[tuple, list[tuple]] = defaultdict(list)
    for token, at in where.items():
        if len(at) * 2 >= len(pages):  # large support
            groups[tuple(len(at.get(i, ())) for i in range(len(pages)))].append(token)
    taken: list[list[tuple]] = []
    held = [bytearray(len(page.tokens)) for page in pages]  # 1 at the places of all taken classes' tokens
    for vector, tokens in sorted(groups.items(), key=lambda x: (-sum(map(bool, x[0])), sum(x[0]), -len(x[1]))):
        first = next(i for i, n in enumerate(vector) if n)
        order = sorted(tokens, key=lambda t: where[t][first][0])
        if max(vector) == 1:
            for i in [i for i, n in enumerate(vector) if n]:
                order = [order[k] for k in _increasing([where[t][i][0] for t in order])]
        places = [sorted((at, k) for k, t in enumerate(order) for at in where[t].get(i, ())) for i in range(len(pages))]
        if any([k for _, k in p] != list(range(len(order))) * n for p, n in zip(places, vector, strict=True)):
            continue  # not in one order
        spans = ((i, p[r * len(order)][0], p[(r + 1) * len(order) - 1][0]) for i, (p, n) in enumerate(zip(places, vector, strict=True)) for r in range(n))
        if all(held[i].find(1, a + 1, b) < 0 for i, a, b in spans):
            taken.append(order)
            for i, p in enumerate(places):
                for at, _ in p:
                    held[i][at] = 1
    return taken, where


def _template(pages: list[_Page]) -> tuple[set[int], set[tuple]]:
    """Paths of the template's elements and the template's text tokens, from the pages that differ."""
    apart = list({tuple(p.tokens): p for p in pages}.values())
    taken, where = _classes(apart)
    elements = {t[0] for order in taken for t in order if t[1] is None}
    if len(apart) < 2:
        return elements, set()
    fixed = {t for order in taken for t in order if t[1] and len(where[t]) >= max(2, SUPPORT * len(apart))}
    count = Counter(t in fixed for p in apart for t in {t for t in p.tokens if t[1]})
    return elements, set() if count[True] > OTHER * count.total() else fixed


_LEAVES = set("p li h1 h2 h3 h4 h5 h6 td tr pre blockquote dd dt".split())


def _favourite(pages: list[_Page], elements: set[int], fixed: set[tuple]) -> int | None:
    """Path of the template's element that holds most of the slots' text."""
    paths = pages[0].paths
    total, once, titles = Counter(), Counter(), Counter()
    for page in pages:
        size = page.sizes(fixed)
        once.update(path for path, n in Counter(page.path).items() if n == 1 and paths.tag[path] not in _LEAVES)
        for c, n in enumerate(size):
            if page.clear[c] and n:
                total[page.path[c]] += n
        titles.update({page.tokens[t][0] for t, _, _, c, _ in page.texts if t is not None and page.clear[c] and paths.titled[page.tokens[t][0]] and page.tokens[t] not in fixed})
    some = {p for p in total if (p in elements or not p) and once[p] >= SUPPORT * len(pages) and total[p] > 0}
    if not some:
        return None
    below = [titles[p] for p in range(len(paths.parent))]  # titles under a path
    for p in range(len(below) - 1, 0, -1):
        below[paths.parent[p]] += below[p]
    at = max(some, key=lambda p: (total[p], -paths.depth[p]))
    least, under = 0.6 * total[at], [-1] * len(below)
    for p in range(at + 1, len(below)):  # parents come first
        if paths.parent[p] == at or under[paths.parent[p]] == at:
            under[p] = at
            if p in some and total[p] >= least and 2 * below[p] >= below[at]:
                at = p
    return at


def _main(page: _Page, path: int | None, fixed: set[tuple]) -> tuple[list[int], bool]:
    """Containers that hold the page's main text, and whether they are marked."""
    size = page.sizes(fixed)
    some = [c for c, p in enumerate(page.path) if p == path and page.clear[c]]
    own = max(some, key=lambda c: (size[c], -c), default=None)
    if own is not None and size[own] <= 0:
        own = None
    around, inside = set(), [False] * len(size)
    if own is not None:
        c = own
        while c >= 0:
            around.add(c)
            c = page.parent[c]
        for c in range(own, len(size)):
            inside[c] = c == own or inside[page.parent[c]]
    for kind in ("article", "main", "named"):
        marked = [c for c, k in enumerate(page.kind) if k == kind and page.clear[c]]
        if own is None:
            pick = max(marked, key=lambda c: (size[c], -c), default=None)
        else:
            pick = max((c for c in marked if c in around), default=None)  # the nearest
            if pick is None:
                pick = max((c for c in marked if inside[c]), key=lambda c: (size[c], -c), default=None)
                if pick is not None and kind == "named" and 2 * size[pick] < size[own]:
                    pick = None
        if pick is not None:
            same = [c for c in marked if page.parent[c] == page.parent[pick] and page.like[c] == page.like[pick]]
            return same, True
    return [0 if own is None else own], False


def _text(page: _Page, main: list[int], fixed: set[tuple]) -> str:
    """What the containers of main hold, in page order, without what is excluded in them and text of fixed."""
    inside, chosen = [False] * len(page.path), set(main)
    for c in range(len(inside)):
        inside[c] = c in chosen or c > 0 and inside[page.parent[c]] and not page.shut[c]
    blocks: dict[int, list[str]] = defaultdict(list)
    for token, block, plain, container, _ in page.texts:
        if inside[container] and not (token is not None and page.tokens[token] in fixed):
            blocks[block].append(plain)
    joined = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n\n".join(x for x in joined if x)


def extract_group(htmls: list[str], classes: bool = True) -> list[str]:
    """The main texts of pages of one host. Without classes there is no template: each page goes by itself."""
    paths = _Paths()
    pages = [_Page(h, paths) for h in htmls]
    if not classes:
        found = [([p], _favourite([p], set(p.path), set()), set()) for p in pages]
    else:
        elements, fixed = _template(pages) if pages else (set(), set())
        path = _favourite(pages, elements, fixed) if pages else None
        found = [([p], path, fixed) for p in pages]
    out = []
    for (page,), path, fixed in found:
        main, whole = _main(page, path, fixed)
        out.append(_text(page, main, set() if whole else fixed))
    return out


def _group(table: pa.Table) -> pa.Table:
    order = sorted(range(table.num_rows), key=lambda i: (table.column("__h")[i].as_py(), table.column("html")[i].as_py()))
    table = table.take(order)
    texts = extract_group(table.column("html").to_pylist())
    return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"),
        host_of(F.col("url")).alias("__host"), F.xxhash64("page_id", "url").alias("__h"),
    )
    groups = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum(F.octet_length("html")) / GROUP_BYTES), F.lit(1))
    # written, so that its size decides how it is joined
    sizes = materialize(rows.groupBy("__host").agg(groups.cast("long").alias("__groups")), "hosts")
    dealt = rows.join(sizes, "__host").withColumn("__group", F.pmod("__h", F.col("__groups"))).drop("__groups")
    return dealt.groupBy("__host", "__group").applyInArrow(_group, "page_id long, url string, text string, n_chars long")
