"""Markup to plain text, with a proof that no token is lost. SCA-10 to SCA-13.

A scanner cuts a text into events, a tree is built from them, and the tree is laid out: rows of cells, numbered lists, addresses behind
their words. What the layout would lose decides the tier: the tree's text, else the events without their tags, else the text itself.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The elements of HTML, current and obsolete, by what they do to the text around them.
_ROLES = {
    # their text stands in lines of its own
    "block": "address article aside blockquote body canvas caption colgroup dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend main nav noscript output p pre section summary table tbody tfoot thead tr video",
    # their text is part of the word it stands in
    "inline": "abbr b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong time tt u var wbr",
    # their text is not shown
    "unshown": "head script style title",
    # they hold no text, or set it apart
    "apart": "a acronym applet area audio base basefont bgsound blink br button center col datalist dialog dir embed frame frameset iframe image img input isindex keygen"
    " label li link listing map marquee math menu menuitem meta meter multicol nextid noembed noframes object ol optgroup option param picture plaintext progress rb rtc"
    " search select slot source spacer sub sup svg td template textarea th track ul xmp",
}
ROLE = {name: role for role, names in _ROLES.items() for name in names.split()}
_EMPTY = frozenset("area base basefont br col embed frame hr image img input keygen link meta param source track wbr".split())
#: What an element ends that was left open: these names, unless one of the others stands between.
_ENDS = {
    "li": (("li",), ("ol", "ul", "dir", "menu")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("td", "th", "tr"), ("table",)),
}
DEPTH = 150

_MARK = re.compile(r"<!--.*?-->|<[!?][^<>]*>|<(?P<slash>/?)(?P<name>[A-Za-z][\w.:-]*)(?P<attributes>\s[^<>]*)?/?>", re.S)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_VALUE = re.compile(r"""(?<![\w-])(href|src|alt)\s*=\s*("[^"]*|'[^']*|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[^\W_]+")
_LINES = re.compile(r"[^\S\n]+\n")
_GAPS = re.compile(r"\n\n\n+")
_CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed_escape(m: re.Match) -> str:
    return html.unescape(m[0]) if m[1][0] == "#" or f"{m[1]};" in html5 else m[0]


def unescape(text: str, most: int = 3, closed: bool = False) -> str:
    """HTML escapes undone until nothing changes, at most so often; closed: only those that a semicolon ends, so an escape that was cut off stays text."""
    for _ in range(most):
        before, text = text, _CLOSED.sub(_closed_escape, text) if closed else html.unescape(text)
        if text == before:
            break
    return text


@dataclass(slots=True)
class Event:
    """Text, or an opening or closing tag (name, attributes as written), or a cut: something that is no text, such as a comment."""

    kind: str
    text: str
    attributes: str = ""


def scan(text: str) -> list[Event]:
    """The events of a text; what looks like a tag but names no element is text. Whole scripts and styles are cuts."""
    out, at, search = [], 0, 0
    while m := _MARK.search(text, search):
        search = m.end()
        name = (m["name"] or "").lower()
        if name and name not in ROLE and ":" not in name[1:-1]:
            continue
        if m.start() > at:
            out.append(Event("text", text[at : m.start()]))
        at = search
        if not name:
            out.append(Event("cut", ""))
        elif name in _RAW_END and not m["slash"] and (end := _RAW_END[name].search(text, at)):
            out.append(Event("cut", ""))
            at = search = end.end()
        else:
            out.append(Event("close" if m["slash"] else "open", name, m["attributes"] or ""))
    if at < len(text):
        out.append(Event("text", text[at:]))
    return out


def attributes(written: str) -> dict[str, str]:
    """The addresses and the replacement text of a tag; the first of each name counts."""
    out: dict[str, str] = {}
    for name, value in _VALUE.findall(written):
        out.setdefault(name.lower(), value.lstrip("\"'").strip())
    return out


@dataclass(slots=True)
class Element:
    name: str
    attributes: str = ""
    parts: list["str | Element"] = field(default_factory=list)


def tree(events: list[Event]) -> Element:
    """Elements in one another. Elements left open end with the one they stand in; below DEPTH, children become siblings."""
    root = Element("")
    path = [root]
    for e in events:
        if e.kind == "text":
            path[-1].parts.append(e.text)
        elif e.kind == "cut":
            path[-1].parts.append(Element("cut"))
        elif e.kind == "open":
            ended, kept_by = _ENDS.get(e.text, ((), ()))
            open_at = len(path)
            for i in range(len(path) - 1, 0, -1):
                if path[i].name in kept_by:
                    break
                if path[i].name in ended:
                    open_at = i
            del path[open_at:]
            new = Element(e.text, e.attributes)
            path[-1].parts.append(new)
            if e.text not in _EMPTY and len(path) < DEPTH:
                path.append(new)
        else:
            for i in range(len(path) - 1, 0, -1):
                if path[i].name == e.text:
                    del path[i:]
                    break
            else:
                path[-1].parts.append(Element(e.text))
    return root


#: Stands between pieces whose words must not run together.
_BREAK = None


def _written(pieces: list[str | None]) -> str:
    out, apart, last = [], False, ""
    for p in pieces:
        if p is _BREAK:
            apart = True
        elif p:
            if apart and last[-1:].isalnum() and p[0].isalnum():
                out.append(" ")
            apart, last = False, p
            out.append(p)
    return "".join(out)


def _is_cell(x) -> bool:
    return isinstance(x, Element) and x.name in ("td", "th")


def _row(parts: list) -> list[str]:
    """The cells of a row; text beside them is a cell of its own."""
    out = []
    for x in parts:
        cell = " ".join(_written(_laid_out(x)).split())
        if cell or _is_cell(x):
            out.append(cell)
    return out


def _inside(parts: list, item: int | None = None) -> Iterator[str | None]:
    """What the parts of an element write; item numbers the list items among them."""
    i = 0
    while i < len(parts):
        x = parts[i]
        if _is_cell(x):
            end = i
            while end < len(parts) and (_is_cell(parts[end]) or isinstance(parts[end], str) and not parts[end].strip()):
                end += 1
            yield from ("\n", " | ".join(_row(parts[i:end])).strip(" |"), "\n")
            i = end
            continue
        if isinstance(x, Element) and x.name == "li":
            yield f"\n{item}. " if item else "\n- "
            yield from _inside(x.parts)
            yield _BREAK
            item = item + 1 if item else item
        else:
            yield from _laid_out(x)
        i += 1


def _laid_out(x: "str | Element") -> list[str | None]:
    if isinstance(x, str):
        return [x]
    name, role = x.name, ROLE.get(x.name, "")
    if role == "unshown":
        return []
    if name == "br":
        return ["\n"]
    if name == "tr":
        return ["\n", " | ".join(_row(x.parts)).strip(" |"), "\n"]
    if name in ("ol", "ul"):
        return ["\n", *_inside(x.parts, 1 if name == "ol" else None), "\n"]
    if name == "img":
        a = attributes(x.attributes)
        what = a.get("src") or a.get("alt")
        return [_BREAK, f"[image: {what}]" if what else "[image]", _BREAK]
    inner = list(_inside(x.parts))
    if name == "a":
        href = attributes(x.attributes).get("href", "")
        told = not href or _written(inner).strip() == href
        return [_BREAK, *inner, *([] if told else [f" [{href}]"]), _BREAK]
    if name in ("sub", "sup"):
        return ["_" if name == "sub" else "^", *inner, _BREAK] if inner else []
    if role == "block":
        return ["\n", *inner, "\n"]
    return inner if role == "inline" else [_BREAK, *inner, _BREAK]


def neat(text: str) -> str:
    """No white space at line ends, one empty line at most between lines, none around the text."""
    if "\xa0" in text:
        text = text.replace("\xa0", " ")
    return _GAPS.sub("\n\n", _LINES.sub("\n", text)).strip() if "\n" in text else text.strip()


def render(decoded: str) -> str:
    """Markup as plain text: lists, links, images, sub- and superscripts and table rows keep their sense."""
    return neat(_written(list(_inside(tree(scan(decoded)).parts))))


def without_tags(events: list[Event]) -> str:
    """The plain fallback: tags out, addresses in brackets; inline tags join what stands around them."""
    out = []
    for e in events:
        if e.kind == "text":
            out.append(e.text)
            continue
        a = attributes(e.attributes) if "=" in e.attributes else {}
        if address := a.get("href") or a.get("src"):
            out.append(f" [{address}] ")
        elif ROLE.get(e.text) != "inline":
            out.append(" ")
    return neat("".join(out))


def evidence(events: list[Event]) -> tuple[Counter, set[str]]:
    """(tokens that a faithful text holds, words in elements that are not shown), found without the layout.

    Tokens are the words of all text and of every address, but that of a link whose text is the address.
    """
    shown, addresses, links = [], [], []
    hidden, depth = [], 0
    for e in events:
        if e.kind == "text":
            shown.append(e.text)
            if depth:
                hidden.append(e.text)
            continue
        if ROLE.get(e.text) != "inline":
            shown.append(" ")
        if ROLE.get(e.text) == "unshown":
            depth = depth + 1 if e.kind == "open" else max(0, depth - 1)
        if e.kind == "open" and "=" in e.attributes:
            a = attributes(e.attributes)
            addresses += [a["src"]] if a.get("src") else []
            if a.get("href"):
                if e.text == "a":
                    links.append((a["href"], len(shown)))
                else:
                    addresses.append(a["href"])
        elif e.kind == "close" and e.text == "a" and links:
            href, start = links.pop()
            if "".join(shown[start:]).strip() != href:
                addresses.append(href)
    addresses += [href for href, _ in links]
    return Counter(_WORD.findall(" ".join(["".join(shown), *addresses]))), set(_WORD.findall(" ".join(hidden)))


def missing_tokens(raw: str | None, cleaned: str | None) -> Counter:
    """What a cleaned text lost, as a bag of tokens."""
    return evidence(scan(unescape(raw or "")))[0] - Counter(_WORD.findall(cleaned or ""))


@dataclass(frozen=True)
class Cleaned:
    """text; tier parsed, conservative or source; whether there was markup."""

    text: str
    tier: str
    markup: bool


def clean(raw: str | None, closed: bool = False) -> Cleaned:
    """The first rendering that loses no token; failing all, the unescaped text itself. Null counts as empty. closed: as in unescape."""
    raw = raw or ""
    if "<" not in raw and "&" not in raw:
        return Cleaned(neat(raw), "parsed", False)
    decoded = unescape(raw, closed=closed)
    events = scan(decoded)
    markup = decoded != raw or any(e.kind != "text" for e in events)
    want, hidden = evidence(events)
    # the layout adds no words but numbers and "image", so any other word of a hidden element would be missing
    if all(w == "image" or w.isdigit() for w in hidden):
        text = neat(_written(list(_inside(tree(events).parts))))
        if want <= Counter(_WORD.findall(text)):
            return Cleaned(text, "parsed", markup)
    text = without_tags(events)
    if want <= Counter(_WORD.findall(text)):
        return Cleaned(text, "conservative", markup)
    return Cleaned(decoded.strip(), "source", markup)


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("tier", T.StringType()), T.StructField("markup", T.BooleanType()), T.StructField("lost", T.IntegerType())])


def _marked(closed: bool):
    @F.pandas_udf(_RESULT)
    def run(s: pd.Series) -> pd.DataFrame:
        done = [clean(raw, closed) for raw in s]
        return pd.DataFrame({"text": [c.text for c in done], "tier": [c.tier for c in done], "markup": [c.markup for c in done], "lost": 0})

    return run


_clean_marked, _clean_closed = _marked(False), _marked(True)


#: White space, as a set of characters to trim.
_WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def clean_udf(c: Column | str, closed: bool = False) -> Column:
    """text, tier, markup and lost (tokens missing from the chosen tier: none, by its proof). closed: as in unescape.

    Texts without an angle bracket or an ampersand stay in the JVM; only the others go to Python.
    """
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    marked = c.contains("<") | c.contains("&")
    white, text = F.lit(_WHITE), F.translate(c, "\u00a0", " ")
    lines = F.array_join(F.transform(F.split(text, "\n"), lambda line: F.rtrim(line, white)), "\n")
    plain = F.btrim(F.when(text.contains("\n"), F.regexp_replace(lines, r"\n{3,}", "\n\n")).otherwise(text), white)
    fast = F.struct(plain.alias("text"), F.lit("parsed").alias("tier"), F.lit(False).alias("markup"), F.lit(0).alias("lost"))
    return F.when(marked, (_clean_closed if closed else _clean_marked)(F.when(marked, c))).otherwise(fast)
