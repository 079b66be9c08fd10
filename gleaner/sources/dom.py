"""A small HTML tree: parsing, cleaning, finding the main content, blocks.

Parsing follows what browsers do where pages depend on it: void elements, raw
text, implied ends of p, li, dd, table parts and options, stray end tags, and
misnested inline elements that must not swallow later blocks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape
from html.entities import html5

# Elements, class and id patterns, texts, selectors and limits.
DROPPED = [
    "script", "style", "link", "img", "iframe", "video", "audio", "object", "embed", "param", "applet", "noscript", "svg", "canvas", "map", "area",
    "button", "input", "select", "textarea", "form", "label", "fieldset", "legend", "datalist", "output", "progress", "meter",
]
FRAME_TAGS = {"nav", "footer", "aside", "header"}
FRAME_PATTERNS = [
    "nav(igation)?", "footer", "header", "sidebar", "menu", "breadcrumb", "cookie", "consent", "banner", "advert(isement)?", "ads?[-_]?", "social",
    "share", "comment", "related", "recommend", "popup", "modal", "newsletter", "subscribe", "signup", "login", "signin", "search", "widget",
    "toolbar", "promo",
]
CONTROL_PATTERNS = [
    "copy[-_]?(button|link|code|markdown)?", "share[-_]?(button|link|menu)?", "action[-_]?(bar|menu|buttons?)", "btn[-_]?(copy|share|action)",
    "clipboard", "open[-_]?in", "chat[-_]?(gpt|button)", "ai[-_]?(chat|assistant)", "feedback", "edit[-_]?(page|this|on[-_]?github)",
    "page[-_]?actions?", "toc|table[-_]?of[-_]?contents", "on[-_]?this[-_]?page", "sticky[-_]?(nav|sidebar|toc)", "floating[-_]?(menu|button|action)",
]
CONTROL_TEXTS = [
    r"^copy\s*(as\s*)?(markdown|code|text)?\Z", r"^open\s+in\s+\w+", r"^(share|copy)\s*(this|link|page)?\Z", r"^edit\s*(this\s*)?(page|on\s*github)?\Z",
    r"^(give\s*)?feedback\Z", r"^(scroll\s*to\s*)?top\Z", r"^on\s+this\s+page\Z", r"^table\s+of\s+contents\Z",
]
CONTENT_SELECTORS = ["[role='main']", "#content", "#main-content", ".content", ".main-content", ".post-content", ".article-content", ".entry-content"]
CONTROL_TEXT_MOST, NAV_LINKS, NAV_SHARE, NAV_TEXT_MOST = 50, 3, 0.8, 200
BLOCK_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre"}

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "noscript"}
DECODED = {"textarea", "title"}
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul dd dt".split()
)
INLINE = set("a abbr b bdi bdo big cite code em font i kbd mark q s samp small span strike strong sub sup tt u var".split())
SCOPES = {"table", "td", "th", "caption", "button", "object", "html", "template"}
#: end tags that reach beyond a scope
OPEN_SCOPES = SCOPES | {"tr", "tbody", "thead", "tfoot"}
#: opening tag -> (elements it ends, where looking for them stops)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
JS_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_SPACES = re.compile(f"[{JS_SPACE}]+")
SQL_BLANKS = "".join(map(chr, [0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))


def collapse(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


@dataclass(eq=False)
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    parent: Element | None = None
    children: list[Element | str] = field(default_factory=list)

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def descendants(self) -> Iterator[Element]:
        stack = self.elements()[::-1]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(e.elements()[::-1])

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                out.append(e)
            else:
                stack.extend(reversed(e.children))
        return "".join(out)

    def names(self) -> str:
        return f"{self.attributes.get('id', '')} {self.attributes.get('class', '')}"

    def has_class(self, name: str) -> bool:
        return name in self.attributes.get("class", "").split()


_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<!--.*?(?:-->|\Z)|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


_CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def unescape_closed(text: str) -> str:
    """Only character references that end in a semicolon; browsers also take "&amp" without."""
    return _CLOSED.sub(lambda m: unescape(m[0]) if m[1][0] == "#" or m[1] + ";" in html5 else m[0], text)


def unescape_sql(text: str) -> str:
    """The two references that the SQL of the registered queries resolves."""
    return text.replace("&quot;", '"').replace("&amp;", "&")


def collapse_sql(text: str) -> str:
    """White space runs as SQL has them, and none of what its trim takes at the ends."""
    return re.sub(r"[\t\n\f\r ]+", " ", text).strip(SQL_BLANKS)


def parse(source: str, decode: Callable[[str], str] = unescape) -> Element:
    """The tree below <html>; head and body exist if the page has content for them.
    ``decode`` resolves the character references of texts."""
    root = Element("html")
    body = Element("body", parent=root)
    head = Element("head", parent=root)
    root.children = [head, body]
    at, open_ = 0, [root, body]
    in_head = False
    # where elements of a tag, and those that are not inline, stand among the open ones: no tag scans them all
    places: defaultdict[str, list[int]] = defaultdict(list)
    solid: list[int] = []

    def enter(e: Element) -> None:
        places[e.tag].append(len(open_))
        if e.tag not in INLINE:
            solid.append(len(open_))
        open_.append(e)

    def leave(i: int) -> None:
        """Ends the open elements from the i-th on."""
        for e in reversed(open_[i:]):
            places[e.tag].pop()
            if e.tag not in INLINE:
                solid.pop()
        del open_[i:]

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def add(node: Element | str) -> None:
        to = head if in_head else open_[-1]
        to.children.append(node)
        if isinstance(node, Element):
            node.parent = to

    def words(s: str) -> None:
        nonlocal in_head
        if s:
            if in_head and s.strip():
                in_head = False
            if not in_head:
                add(decode(s))

    def close(names: set[str], stop: set[str]) -> None:
        i = last(names)
        if i and i > last(stop):
            leave(i)

    def close_paragraph() -> None:
        """Inline elements left open inside the paragraph end with it: what a
        browser reopens after it would only wrap later text, not move it."""
        close({"p"}, SCOPES)

    def end(name: str) -> None:
        i = last(_HEADINGS if name in _HEADINGS else (name,))
        if name in INLINE and solid and solid[-1] > i:
            return  # a stray end of an inline element does not end blocks
        if i and (name in OPEN_SCOPES or i >= last(SCOPES)):
            leave(i)

    while at < len(source):
        m = _TAG.search(source, at)
        if m is None:
            words(source[at:])
            break
        words(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in ("html", "body", "head"):
                in_head = in_head and name != "head"
            elif name == "p" and not places["p"]:
                add(Element("p"))
            else:
                end(name)
            continue
        attributes = {k.lower(): unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(m[3].rstrip("/") if name in VOID else m[3])}
        if name == "html":
            root.attributes = attributes | root.attributes
            continue
        if name == "head":
            in_head = True
            continue
        if name == "body":
            in_head = False
            body.attributes = attributes | body.attributes
            continue
        if in_head and name not in {"title", "meta", "link", "script", "style", "base", "noscript", "template"}:
            in_head = False
        if name in CLOSES_P:
            close_paragraph()
        if name in _HEADINGS and open_[-1].tag in _HEADINGS:
            leave(len(open_) - 1)
        if name in IMPLIED:
            close(*IMPLIED[name])
        element = Element(name, attributes)
        add(element)
        if name in VOID:
            continue
        if name in RAW:
            close_tag = re.compile(f"</{name}[\\s/>]", re.I).search(source, at)
            stop = close_tag.start() if close_tag else len(source)
            inner = source[at:stop]
            if inner:
                element.children.append(decode(inner) if name in DECODED else inner)
            at = source.find(">", stop) + 1 if close_tag else len(source)
            at = at or len(source)
            continue
        if name == "svg" and m[3].rstrip().endswith("/"):
            continue
        if not in_head:
            enter(element)
            if name == "pre" and source[at : at + 1] == "\n":
                at += 1
    return root


_HEADINGS = {f"h{i}" for i in range(1, 7)}


def _any(patterns: list[str]) -> Callable[[str], object]:
    return re.compile("|".join(f"(?:{p})" for p in patterns), re.I | re.A).search


_frame_name, _control_name, _control_text = _any(FRAME_PATTERNS), _any(CONTROL_PATTERNS), _any(CONTROL_TEXTS)


def _is_frame(e: Element) -> bool:
    return bool(_frame_name(e.names()))


def _prune(root: Element, goes: Callable[[Element], bool]) -> None:
    """Removes what goes, judged on the tree as it was."""
    gone = [e for e in root.descendants() if goes(e)]
    ids, parents = {id(e) for e in gone}, {id(e.parent): e.parent for e in gone}
    for parent in parents.values():
        parent.children = [c for c in parent.children if id(c) not in ids]


def _short_texts(root: Element, most: int, squeezed: bool = False) -> dict[int, str | None]:
    """The text of each descendant, None from ``most`` characters on (``squeezed``: runs
    of white space are one blank, and blanks do not count); from the leaves up."""
    found: dict[int, str | None] = {}
    for e in reversed(list(root.descendants())):
        parts, size = [], 0
        for c in e.children:
            part = c if isinstance(c, str) else found[id(c)]
            if part is not None and squeezed and isinstance(c, str):
                part = _SPACES.sub(" ", part)
            size = most if part is None else size + len(part) - (part.count(" ") if squeezed else 0)
            if size >= most:
                break
            parts.append(part)
        text = None if size >= most else "".join(parts)
        found[id(e)] = _SPACES.sub(" ", text) if text and squeezed else text
    return found


def _selected(root: Element, selector: str) -> list[Element]:
    """#id, .class and [role='main'] below ``root``."""
    kind, name = selector[0], selector[1:]
    test = {"#": lambda e: e.attributes.get("id") == name, ".": lambda e: e.has_class(name), "[": lambda e: e.attributes.get("role") == "main"}[kind]
    return [e for e in root.descendants() if test(e)]


def strip_frame(root: Element) -> None:
    """Removes what never is content, then frames and boilerplate outside of
    main, article and role=main, unless they contain such an element."""
    _prune(root, lambda e: e.tag in _DROPPED)
    kept: set[int] = set()
    holders: set[int] = set()
    for e in [root, *root.descendants()]:
        if e.tag in ("main", "article") or e.attributes.get("role") == "main":
            if id(e) not in kept:  # else its descendants are in, too
                kept.add(id(e))
                kept.update(map(id, e.descendants()))
            up = e.parent
            while up is not None and id(up) not in holders:
                holders.add(id(up))
                up = up.parent
    for test in (lambda e: e.tag in FRAME_TAGS, _is_frame):
        _prune(root, lambda e: id(e) not in kept and id(e) not in holders and test(e))
    if id(root) not in kept | holders and _is_frame(root):
        root.children = []


_DROPPED = set(DROPPED)


def _link_penalty(elements: list[Element]) -> int:
    text = len(collapse("".join(e.text() for e in elements)))
    links = [a for e in elements for a in e.descendants() if a.tag == "a"]
    return text - 2 * sum(len(collapse(a.text())) for a in links)


def _collation(selector: str) -> tuple:
    """Ties go by letters, as a locale orders them: marks before digits before letters, case last."""
    return [(0 if not c.isalnum() else 1 if c.isdigit() else 2, c.lower()) for c in selector], selector.swapcase()


def main_content(root: Element) -> tuple[str, list[Element]] | None:
    """Selector and elements: all main, else all article, else the child of body
    or content selector with most text beside links."""
    for tag in ("main", "article"):
        found = [e for e in root.descendants() if e.tag == tag]
        if found:
            return tag, found
    candidates = []
    for body in (e for e in root.elements() if e.tag == "body"):
        for e in body.elements():
            if e.tag not in FRAME_TAGS and not _is_frame(e):
                name = e.tag + (f"#{e.attributes['id']}" if e.attributes.get("id") else "") + ("." + ".".join(e.attributes["class"].split(" ")) if e.attributes.get("class") else "")
                candidates.append((name, [e]))
    candidates += [(s, found) for s in CONTENT_SELECTORS if (found := _selected(root, s))]
    scored = [(-_link_penalty(found), _collation(name), i) for i, (name, found) in enumerate(candidates)]
    return candidates[min(scored)[2]] if scored else None


def _is_control(e: Element) -> bool:
    a, c = e.attributes, e.attributes.get("class", "")
    return (
        "data-copy" in a or "data-clipboard" in a
        or any(x in a.get("aria-label", "") for x in ("copy", "share"))
        or any(x in a.get("title", "") for x in ("Copy", "Share"))
        or any(e.has_class(x) for x in ("copy-button", "share-button", "tabs", "tab-list"))
        or any(x in c for x in ("ActionMenu", "PageActions", "TabList", "Tabs", "anchor-link", "heading-link", "sticky"))
        or a.get("role") in ("tablist", "tab")
        or e.tag == "a" and a.get("href", "").startswith("#") and not e.children
    )


def _links(root: Element) -> dict[int, tuple[int, int]]:
    """Of each descendant, how many links it holds and the length of their texts; from
    the leaves up."""
    sizes: dict[int, int] = {}
    found: dict[int, tuple[int, int]] = {}
    for e in reversed(list(root.descendants())):
        sizes[id(e)] = sum(len(c) if isinstance(c, str) else sizes[id(c)] for c in e.children)
        many = length = 0
        for c in e.elements():
            inner = found[id(c)]
            many, length = many + inner[0] + (c.tag == "a"), length + inner[1] + (sizes[id(c)] if c.tag == "a" else 0)
        found[id(e)] = many, length
    return found


def strip_controls(elements: list[Element]) -> None:
    for top in elements:
        _prune(top, lambda e: bool(_control_name(e.names())))
        texts = _short_texts(top, CONTROL_TEXT_MOST)
        _prune(top, lambda e: e.tag in ("button", "a", "span", "div") and (t := texts[id(e)]) is not None and bool(_control_text(t.strip(JS_SPACE))))
        _prune(top, _is_control)
        links, texts = _links(top), _short_texts(top, NAV_TEXT_MOST, squeezed=True)

        def is_link_list(e: Element) -> bool:
            many, length = links[id(e)]
            if e.tag not in ("p", "div", "span") or many < NAV_LINKS or texts[id(e)] is None:
                return False
            text = len(collapse(texts[id(e)]))
            return length > text * NAV_SHARE and text < NAV_TEXT_MOST

        _prune(top, is_link_list)


def code_text(pre: Element) -> str:
    """Lines of a code block: line elements, else br, else as it is."""
    lines = [e for e in pre.descendants() if e.has_class("line") or e.has_class("code-line") or "line" in e.attributes.get("class", "")]
    if lines:
        return "\n".join(t for e in lines if (t := e.text().strip(JS_SPACE))).strip(JS_SPACE)

    out, stack = [], [*reversed(pre.children)]
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append("\n")
        else:
            stack.extend(reversed(c.children))
    return "".join(out).strip(JS_SPACE)


@dataclass
class Block:
    type: str
    text: str
    index: int
    heading_path: list[str]


def blocks(elements: list[Element], skip_nav: bool = True, squeeze: Callable[[str], str] = collapse) -> list[Block]:
    """Headings, paragraphs, items and code in document order, each with the
    headings above it. A heading shortens the path only if it is longer."""
    out: list[Block] = []
    path: list[str] = []
    single = len(elements) == 1
    stack: list[Element] = list(elements[::-1]) if single else [c for e in elements[::-1] for c in e.elements()[::-1]]
    while stack:
        e = stack.pop()
        if skip_nav and e.tag == "nav":
            continue
        if e.tag not in BLOCK_TAGS:
            stack.extend(e.elements()[::-1])
            continue
        text = code_text(e) if e.tag == "pre" else squeeze(e.text())
        if text:
            if e.tag in _HEADINGS:
                del path[int(e.tag[1]) - 1 :]
            out.append(Block(e.tag, text, len(out), path.copy()))
            if e.tag in _HEADINGS:
                path.append(text)
    return out


def page_blocks(html: str | None, decode: Callable[[str], str] = unescape, squeeze: Callable[[str], str] = collapse) -> tuple[str | None, list[Block]]:
    """The main content's selector (null: none found) and blocks."""
    root = parse(html or "", decode)
    strip_frame(root)
    found = main_content(root)
    if found is None:
        return None, []
    strip_controls(found[1])
    return found[0], blocks(found[1], squeeze=squeeze)
