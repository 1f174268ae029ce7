"""Main text of web pages by tag-path ratios.

Every text node has a path of tags (with classes) from the root.  Per path, the
mean text length and the mean punctuation of its nodes are computed, smoothed
over neighbouring nodes in page order and fused; paths above a threshold
relative to the spread of the page are content.  Nodes beside content in the
same container belong to it as well, and so does the rest of an article that
holds most of the passing text.  Paths whose classes hint at what is beside
the article have their score lowered, unless such elements hold most of the
text.  Elements that are never content (menus, scripts, forms that hold less
than most of the text ...) are left out before.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
NEVER = RAW | frozenset(
    "head nav header footer aside form button select option datalist menu dialog svg math canvas object audio video map".split()
)
ROOTS = frozenset("article main".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
#: A block that starts inside a paragraph ends it.
ENDS_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SCOPES = frozenset("html body table td th caption button object ul ol div section article main aside nav".split())
#: Leaves of prose: their container is the parent.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th tr tbody dt dd blockquote pre figcaption".split())
#: Words of class, id or role that mark what is beside the article.
BESIDE = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist
    complementary consent contentinfo cookie cookies disqus discussion footer gdpr header login masthead menu menubar
    modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion recommended
    related replies reply respond responses rail search share sharing sidebar signup skip social sponsor sponsored
    sponsors subscribe subscription toolbar widget widgets""".split()
)

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)[^<>]*(?:>|\Z)|[^<]+|<""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
UNSHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：¿¡«»„“”\"]")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Share of the page's spread that a path must reach.
LAMBDA = 0.5
#: Weights of a node and its neighbours when smoothing.
KERNEL = (0.25, 0.5, 0.25)
#: Elements alike in place and hints that hold this share of the text are not beside the article.
DOMINANT = 0.7
#: Others have their paths' scores lowered to this, times the root of their share.
LOWERED = 0.15


def _attributes(text: str) -> dict[str, str]:
    """Values by name; of repeated names the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


class _Element:
    __slots__ = ("tag", "parent", "path", "beside", "never", "forms", "root")

    def __init__(self, tag: str, attributes: str, parent: _Element | None):
        self.tag, self.parent = tag, parent
        own = _attributes(attributes) if attributes else {}
        names = " ".join(filter(None, (own.get(k) for k in ("class", "id", "role"))))
        label = f"{tag}.{re.sub(r'[0-9]+', '', names)}" if names else tag
        self.path = f"{parent.path}/{label}" if parent else label
        hidden = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or UNSHOWN.search(own.get("style", ""))
        self.never = (tag in NEVER and tag != "form") or (parent is not None and parent.never) or bool(hidden)
        self.forms = ((self,) if tag == "form" else ()) + (parent.forms if parent else ())
        words = frozenset()
        if names and tag not in ("html", "body", *ROOTS):
            words = frozenset(w.lower() for w in WORDS.findall(names)) & BESIDE
        # Elements with the same hints in the same place are judged together.
        self.beside = (((parent.path if parent else "", words),) if words else ()) + (parent.beside if parent else ())
        self.root = self if tag in ROOTS else parent.root if parent else None


def text_nodes(html: str) -> list[tuple[_Element, str, int]]:
    """(element, decoded text, block number) in page order, without elements that never hold content."""
    out, block = [], 0
    here = top = _Element("", "", None)
    at, end = 0, len(html)
    while at < end:
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            first = m[0]
            if first[0] == "<" and len(first) > 1:
                continue
            if not here.never:
                out.append((here, unescape(first) if "&" in first else first, block))
            continue
        tag = tag.lower()
        if tag not in INLINE:
            block += 1
        if m[1] or m[4]:
            place = here
            while place is not top and place.tag != tag:
                place = place.parent
            if place is not top:
                here = place.parent
            continue
        attributes = m[3] or ""
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(html, at)
            at = close.end() if close else end
            continue
        if tag in ENDS_P:
            here = _close(here, top, frozenset(["p"]))
        if tag in CLOSES:
            here = _close(here, top, CLOSES[tag])
        if not attributes.endswith("/"):
            here = _Element(tag, attributes, here)
    return out


def _close(here: _Element, top: _Element, tags: frozenset) -> _Element:
    """Leave the nearest open element of ``tags``, unless another scope lies between."""
    place = here
    while place is not top:
        if place.tag in tags:
            return place.parent
        if place.tag in SCOPES:
            return here
        place = place.parent
    return here


def _ratios(nodes: list[tuple[_Element, str, int]]) -> dict[str, float]:
    """Fused, smoothed ratio of each path."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for element, text, _ in nodes:
        length[element.path] += len(text)
        marks[element.path] += len(PUNCTUATION.findall(text))
        count[element.path] += 1
    raw = {p: (length[p] / count[p]) * (1 + marks[p] / count[p]) ** 0.5 for p in count}
    line = [raw[element.path] for element, _, _ in nodes]
    before, after = line[:1] + line[:-1], line[1:] + line[-1:]
    total = defaultdict(float)
    for (element, _, _), a, b, c in zip(nodes, before, line, after, strict=True):
        total[element.path] += KERNEL[0] * a + KERNEL[1] * b + KERNEL[2] * c
    return {p: total[p] / count[p] for p in count}


def _container(element: _Element) -> _Element:
    while element.parent is not None and (element.tag in INLINE or element.tag in LEAVES):
        element = element.parent
    return element


def _outside_forms(nodes: list[tuple[_Element, str, int]]) -> list[tuple[_Element, str, int]]:
    """The nodes but those of forms; a form around most of the text is no form but the page."""
    if not any(e.forms for e, _, _ in nodes):
        return nodes
    held: dict[int, int] = defaultdict(int)
    for element, text, _ in nodes:
        for form in element.forms:
            held[id(form)] += len(text.strip())
    everything = sum(len(text.strip()) for _, text, _ in nodes)
    return [n for n in nodes if all(2 * held[id(form)] > everything for form in n[0].forms)]


def _roots(element: _Element) -> Iterator[_Element]:
    """The articles around an element, innermost first."""
    root = element.root
    while root is not None:
        yield root
        root = root.parent.root


def main_text(html: str | None) -> str:
    """The main text, white space turned into single spaces; empty if there is none."""
    nodes = _outside_forms(text_nodes(html or ""))
    full = [n for n in nodes if n[1].strip()]
    if not full:
        return ""
    held: dict[tuple, int] = defaultdict(int)
    everything = 0
    for element, text, _ in full:
        everything += len(text)
        for hint in dict.fromkeys(element.beside):
            held[hint] += len(text)
    factor: dict[str, float] = {}
    for element, _, _ in full:
        share = min((held[hint] / everything for hint in element.beside), default=1.0)
        factor[element.path] = 1.0 if share >= DOMINANT else LOWERED * share**0.5
    # What is beside does not change the scores of the rest.
    ratio = _ratios(full) | _ratios([n for n in full if factor[n[0].path] == 1.0])
    ratio = {path: value * factor[path] for path, value in ratio.items()}
    values = [ratio[e.path] for e, _, _ in full]
    mean = sum(values) / len(values)
    spread = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
    content = [(e, len(t)) for e, t, _ in full if ratio[e.path] >= LAMBDA * spread]
    passing = sum(n for _, n in content)
    within = defaultdict(int)
    for e, n in content:
        for root in _roots(e):
            within[id(root)] += n
    chosen = {e.path for e, _ in content}
    places = {id(_container(e)) for e, _ in content if factor[e.path] == 1.0}

    def kept(e: _Element) -> bool:
        if e.path in chosen:
            return True
        if factor.get(e.path, 1.0) < 1.0:
            return False
        return (e.root is not None and 2 * within[id(e.root)] > passing) or id(_container(e)) in places

    blocks: dict[int, list[str]] = {}
    for element, text, block in nodes:
        if kept(element):
            blocks.setdefault(block, []).append(text)
    return " ".join(" ".join(t) for b in blocks.values() if (t := "".join(b).split()))


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text``: the main text of each page.

    Rows and the columns ``keep`` (all but ``text`` by default) stay.  A null
    or empty page has an empty text.  Pages are never cut.
    """
    own = [c for c in (keep if keep is not None else pages.columns) if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(html).cast(pa.binary()).to_pylist()
            texts = [main_text(None if h is None else h.decode("utf-8", "replace")) for h in raw]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), pa.array(texts, pa.string())], names=[*own, "text"]
            )

    schema = pages.select(*own).schema.add("text", "string")
    return pages.select(*dict.fromkeys([*own, html])).mapInArrow(run, schema)
