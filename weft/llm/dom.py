"""A small, forgiving HTML tree, and the main text of its parts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Collection
from html import unescape

import xxhash

# Fixed values of the HTML standard: elements by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe noembed noframes xmp".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - set("html body td th tr tbody thead tfoot".split())
#: An open element that a new one of the same group ends, up to the nearest boundary.
SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
SKIPPED = set("nav aside footer form script style noscript template iframe svg math object canvas audio video button select input textarea label dialog head title menu noembed noframes xmp".split())
# end of fixed values

#: Words in class, id or role that mark what is not the article.
STRONG = set(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion promoted nav navbar navigation menu menubar topbar toolbar breadcrumb breadcrumbs "
    "sidebar footer masthead pageheader siteheader cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login share sharing comment comments commentlist disqus "
    "pagination pager skip hidden searchbox contentinfo complementary outbrain taboola paywall".split()
)
#: Words that may mark it: within an article the pages of the host decide.
WEAK = set("banner side aside rail widget widgets foot header notice notices alert alerts overlay social related recommended recommendations reply replies respond search tags taglist copyright legal teaser".split())
#: How a node is marked by words: a part of a class is a weak word, a whole class is, the same for strong words.
WEAK_PART, WEAK_WHOLE, STRONG_PART, STRONG_WHOLE = 1, 2, 3, 4
#: First words of a class that says how a page is laid out around something.
MODIFIERS = set("has no with without".split())
#: Share of a marked part's text that is links from which on it is not the article.
LINKED = 0.5
#: Tags with unbalanced quotes after which a page is read without regard to quotes, so that time stays linear.
UNBALANCED = 64
_OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
_PLAIN = r"<(/?)([a-zA-Z][^\s/>]*)([^<>]*)(?:>|\Z)"
_TOKEN = re.compile(rf"{_OTHER}|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|{_PLAIN}", re.S)
_UNQUOTED = re.compile(rf"{_OTHER}|(?!)()()()|{_PLAIN}", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>"']|\Z)""", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
#: What an opening tag may end, as SAME says, and the groups in which a tag is an end or a boundary.
ENDS = {"p": ({"p"}, set("td th button table body article section div li blockquote".split()))} | SAME
_GROUPS: dict[str, list[tuple[str, bool]]] = {}
for _group, (_tags, _fence) in ENDS.items():
    for _t in _tags | _fence:
        _GROUPS.setdefault(_t, []).append((_group, _t in _tags))


def _marked(tokens: list[list[str]]) -> int:
    """The strongest mark of classes, ids and roles, each a list of words."""
    mark = 0
    for words in tokens:
        strong, weak = (sum(w in kind for w in words) for kind in (STRONG, WEAK))
        if strong:
            mark = max(mark, STRONG_WHOLE if strong + weak == len(words) else STRONG_PART)
        elif weak:
            mark = max(mark, WEAK_WHOLE if weak == len(words) else WEAK_PART)
    return mark


class Node:
    """``path``, a hash of the tags and first classes without numbers from the root on, takes a step from the parent's, so
    deep pages cost no more than flat ones.  ``inside``: within an article or main element."""

    __slots__ = ("tag", "parent", "children", "path", "chrome", "marked", "inside", "ends")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
        names = found.get("class", "").split() if found else ()
        kind = _DIGITS.sub("#", unescape(names[0])) if names else ""
        self.path = xxhash.xxh3_64_intdigest(f"{parent.path if parent else 0}/{tag}.{kind}") - 2**63
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.chrome = tag in SKIPPED or tag == "header" and not self.inside
        #: Less than 0 for elements that are never chrome by words.
        self.marked = 0
        if found and not self.chrome:
            self.chrome = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            tokens = [[w.lower() for w in _SPLIT.split(v) if w] for v in (*names, *found.get("id", "").split(), *found.get("role", "").split())]
            # the header of an article holds its title; that of the page doesn't
            tokens = [t for t in tokens if t and t[0] not in MODIFIERS and not (self.inside and t == ["header"])]
            if not self.chrome:
                self.marked = _marked(tokens) * (-1 if tag in ("html", "body", "article", "main") else 1)
        #: Where on the stack the nearest element is that an opening tag of a group would end; shared with the parent
        #: unless this tag changes it.
        self.ends: dict[str, int] = parent.ends if parent else {}


def parse(html: str, dropped: Collection[int] = (), kept: Collection[int] = ()) -> Node:
    """The tree.  End tags that match nothing are dropped, open elements end with their parent; nothing is refused.

    ``dropped`` and ``kept`` are the paths of weakly marked parts of articles of which the host's pages say so.
    """
    root = Node("#", "", None)
    stack, at, look = [root], 0, 0
    open_: Counter[str] = Counter()
    unbalanced = 0

    def cut(k: int) -> None:
        for x in stack[k:]:
            open_[x.tag] -= 1
        del stack[k:]

    while (look := html.find("<", look)) >= 0:
        m = (_TOKEN if unbalanced < UNBALANCED else _UNQUOTED).match(html, look)
        if m is None:  # a character like any other
            look += 1
            unbalanced += html[look : look + 1].isalpha()
            continue
        if look > at:
            stack[-1].children.append(html[at:look])
        at = look = m.end()
        unbalanced += m[5] is not None
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if open_[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        cut(k)
                        break
                    if tag not in BLOCK and stack[k].tag in BLOCK:
                        break  # an inline end tag doesn't end a block
            continue
        for group in ("p" if tag in CLOSES_P else "", tag if tag in SAME else ""):
            if group and (k := stack[-1].ends.get(group, 0)):
                cut(k)
        node = Node(tag, m[3] or m[6] or "", stack[-1])
        stack[-1].children.append(node)
        if node.marked > 0:
            voted = node.inside and node.marked <= WEAK_WHOLE
            node.chrome = node.path in dropped or node.path not in kept and node.marked == WEAK_WHOLE if voted else True
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = look = end.end() if end else len(html)
        elif tag not in VOID and not (m[3] or m[6] or "").rstrip().endswith("/"):
            if tag in _GROUPS:
                node.ends = node.ends | {g: len(stack) if own else 0 for g, own in _GROUPS[tag]}
            stack.append(node)
            open_[tag] += 1
        elif tag == "br":
            stack[-1].children.append(" ")
    if at < len(html):
        stack[-1].children.append(html[at:])
    _relieve(root, dropped, kept)
    return root


def _lengths(order: list[Node], through: Callable[[Node], bool]) -> tuple[dict[Node, int], dict[Node, int]]:
    """Characters of text, and of those in links, of each node with all that is within and that ``through`` lets pass."""
    text: dict[Node, int] = {}
    links: dict[Node, int] = {}
    for x in reversed(order):
        n = linked = 0
        for c in x.children:
            if type(c) is str:
                n += len(c.strip())
            elif through(c):
                n += text[c]
                linked += links[c]
        text[x], links[x] = n, n if x.tag == "a" else linked
    return text, links


def _relieve(root: Node, dropped: Collection[int], kept: Collection[int]) -> None:
    """Marked wrappers are no chrome if they hold main or the page's first unmarked article, or, unless a whole class is a
    strong word, most of the page's text outside links.  Where nothing is known of its host, a part of an article that a
    weak word marks in part is chrome if it is mostly links."""
    order = nodes(root)
    if not any(x.marked for x in order):
        return
    article = next((x for x in order if x.tag == "article"), None)
    holds: set[int] = set()
    for x in reversed(order):
        if id(x) in holds:
            x.chrome = x.chrome and x.marked <= 0
        if x.parent is not None and (id(x) in holds or x.tag == "main" or x is article and not x.marked):
            holds.add(id(x.parent))
    if not any(0 < x.marked < STRONG_WHOLE for x in order):
        return
    text, links = _lengths(order, lambda c: not c.chrome or c.marked > 0)
    prose = text[root] - links[root]
    for x in order:
        if x.chrome and 0 < x.marked < STRONG_WHOLE and not x.inside and 2 * (text[x] - links[x]) > prose:
            x.chrome = False
        elif x.inside and x.marked == WEAK_PART and x.path not in dropped and x.path not in kept and links[x] > LINKED * text[x]:
            x.chrome = True


def blocks(node: Node) -> list[str]:
    """The blocks of text under a node in page order, without what is not the article."""
    out, parts = [], []

    def end() -> None:
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            parts.append(x)
        elif x is node or not x.chrome:
            block = x.tag in BLOCK
            if block:
                end()
                todo.append(None)
            todo += reversed(x.children)
        elif x.tag in BLOCK:
            end()
    end()
    return out


def nodes(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [c for c in reversed(x.children) if type(c) is not str]
    return out


CONTAINERS = {"div": 1.0, "section": 1.0, "article": 2.0, "main": 1.5, "body": 1.0, "td": 1.0, "html": 1.0, "#": 1.0}
#: Share of an inner container's value that its parent has: less than the whole, so that a mere wrapper stays behind, but
#: enough for an article that is cut into several sections.
INHERITED = 0.6


def scores(root: Node) -> list[tuple[Node, float]]:
    """How much each container looks like the article: the text that is its own or in its paragraphs, a share of that in
    containers within, less the more of it is links.  In page order."""
    order = nodes(root)
    total, links = _lengths(order, lambda c: not c.chrome)
    value: dict[Node, float] = {}
    for x in reversed(order):
        n = 0.0
        for c in x.children:
            if type(c) is str:
                n += len(c.strip())
            elif not c.chrome:
                n += value[c] * INHERITED if c.tag in CONTAINERS else value[c]
        value[x] = n
    found, gone = [], set()
    for x in order:
        if x.chrome or x.parent is not None and id(x.parent) in gone:
            gone.add(id(x))
        elif x.tag in CONTAINERS and total[x]:
            density = 1 - links[x] / total[x]
            found.append((x, value[x] * density**2 * CONTAINERS[x.tag]))
    return found


def suspects(root: Node) -> dict[int, tuple[int, int, int]]:
    """path: (hash of the text, its length, that of links) of a page's weakly marked parts of articles."""
    order = nodes(root)
    if not any(x.inside and 0 < x.marked <= WEAK_WHOLE for x in order):
        return {}
    text, links = _lengths(order, lambda c: not c.chrome or c.marked > 0)
    out: dict[int, tuple[int, int, int]] = {}
    for x in order:
        if x.inside and 0 < x.marked <= WEAK_WHOLE:
            h, n, m = out.get(x.path, (0, 0, 0))
            out[x.path] = (xxhash.xxh3_64_intdigest(f"{h} " + " ".join(blocks(x))) - 2**63, n + text[x], m + links[x])
    return out


def outermost(root: Node, wanted: Collection[int]) -> list[Node]:
    """The nodes of a set of ids that are in no other of them, in page order."""
    out, within = [], set()
    for x in nodes(root):
        if x.parent is not None and id(x.parent) in within:
            within.add(id(x))
        elif id(x) in wanted:
            out.append(x)
            within.add(id(x))
    return out
