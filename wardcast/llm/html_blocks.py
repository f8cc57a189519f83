"""One page's HTML as blocks of text, each with the part of the page it stands in.

A tokenizer for tags as browsers read them, closing what pages leave open; no document tree.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

# Elements of HTML by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset(
    "script style textarea title iframe noembed noframes xmp head noscript template svg math object canvas audio video select datalist button".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
CHROME = frozenset("nav header footer aside menu form dialog search".split())
#: What an opening tag closes that is still open, and what bounds the look for it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
SCOPE = frozenset("article aside body div section main nav header footer td th table ul ol li form html object button".split())
#: Words in a class or an id that tell of what is not the article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe signup share sharing social comment comments disqus respond related recommended recommendations "
    "widget login search pagination pager toolbar copyright disclaimer".split()
)
#: ... unless the element itself is told to be of the article; and a header then stays.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OWN = frozenset("article post entry story".split())
NO_HINTS = frozenset("html body article main".split())

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

#: Where a block stands: in the article, in none of the known parts, in what frames the article.
ARTICLE, PLAIN, FRAME = 0, 1, 2
_UNSEEN = 3


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _hinted(name: str, of: dict[str, str], inside: int) -> bool:
    if of.get("role", "").lower() in ROLES:
        return True
    for part in f"{of.get('class', '')} {of.get('id', '')}".split():
        words = [w.lower() for w in _PART.findall(part)]
        if not words or words[0] in ("has", "no", "with", "without", "not"):
            continue
        found = HINTS.intersection(words)
        if found and (found != {"header"} or (inside != ARTICLE and not OWN.intersection(words))):
            return True
    return False


def _place(name: str, attributes: str, inside: int, form: bool) -> int:
    """Where the content of an element stands that begins ``inside`` a part; ``form``: only a
    form makes that part a frame."""
    if name in HIDDEN or inside == _UNSEEN:
        return _UNSEEN
    of = _attributes(attributes) if "=" in attributes or "hidden" in attributes else {}
    if "hidden" in of or of.get("aria-hidden", "").lower() == "true" or _NOT_SHOWN.search(of.get("style", "")):
        return _UNSEEN
    own = name in ("article", "main") or of.get("role", "").lower() in ("article", "main") or of.get("itemprop") == "articleBody"
    if own:
        if inside == ARTICLE and name == "article" and "itemprop" not in of:
            return FRAME if _hinted("", of, ARTICLE) else ARTICLE
        return ARTICLE if inside != FRAME or form else FRAME
    if name in CHROME and not (name == "header" and inside == ARTICLE):
        return FRAME
    if name not in NO_HINTS and ("class" in of or "id" in of or "role" in of) and _hinted(name, of, inside):
        return FRAME
    return inside


class _Open:
    """The elements that are open, with the part each puts its content in."""

    def __init__(self):
        self.names: list[str] = []
        self.places: list[int] = []
        self.forms: list[bool] = []
        self.count: Counter[str] = Counter()
        self.place, self.form = PLAIN, False

    def push(self, name: str, place: int) -> None:
        if place != self.place:
            self.form = name == "form"
        self.place = place
        self.names.append(name)
        self.places.append(place)
        self.forms.append(self.form)
        self.count[name] += 1

    def pop(self, to: int) -> None:
        """Closes all from the element numbered ``to`` on."""
        for name in self.names[to:]:
            self.count[name] -= 1
        del self.names[to:], self.places[to:], self.forms[to:]
        self.place, self.form = (self.places[-1], self.forms[-1]) if self.places else (PLAIN, False)

    def close(self, names: set[str] | frozenset[str], until: set[str] | frozenset[str] = frozenset()) -> None:
        """Closes the innermost of the elements called so, unless one of ``until`` is inside of it."""
        if not any(self.count[n] for n in names):
            return
        for i in range(len(self.names) - 1, -1, -1):
            if self.names[i] in names:
                return self.pop(i)
            if self.names[i] in until:
                return None


def blocks(html: str) -> list[tuple[int, str]]:
    """(part, text) of each block that has text, in page order.

    Character references are decoded and white space within a block is one space. Blocks end
    where a block-level element begins or ends; an inline element of another part than the
    text around it makes a block of its own and leaves that text in one.
    """
    out: list[tuple[int, str]] = []
    held: dict[int, list[str]] = {}

    def end_block() -> None:
        for place, parts in held.items():
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((place, text))
        held.clear()

    stack = _Open()
    for text, closing, name, attributes in _tokens(html):
        if text and stack.place != _UNSEEN:
            held.setdefault(stack.place, []).append(text)
        if not name:
            continue
        if name in BLOCK:
            end_block()
        elif name == "br" and stack.place != _UNSEEN:
            held.setdefault(stack.place, []).append(" ")
        if closing:
            if name == "p" or name == "li":
                stack.close({name}, SCOPE - {name})
            else:
                stack.close({name})
            continue
        if name in BLOCK:
            stack.close({"p"}, SCOPE)
        if name in CLOSES:
            stack.close(*CLOSES[name])
            if name in ("tr", "dt", "dd"):
                stack.close(*CLOSES[name])
        if name == "body":
            stack.close({"head"})
        if name not in VOID:
            stack.push(name, _place(name, attributes, stack.place, stack.form))
    end_block()
    return out


def _tokens(html: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before, is an end, name, attributes) of each tag; without a name where none ends the text."""
    at, last = 0, html.rfind(">") + 1  # up to there every tag has an end, so none is looked for in vain
    while m := _TAG.search(html, at, last):
        name = (m[1] or "").lower()
        closing = html.startswith("</", m.start())
        yield html[at : m.start()], closing, name, m[2] or ""
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
            at = len(html)
        if name in RAW and not closing:
            end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
            at = end.start() if end else len(html)
    yield html[at:], False, "", ""
