"""HTML main text by line-block distribution.

Markup is stripped into lines, one for each block; lines of menus, headers,
footers, sidebars, notices, adverts, forms, scripts and comments weigh nothing
and hold no text. Line lengths are summed over a sliding window of three lines,
within runs of lines that are alike inside or outside an article element. Where
the sums surge to the least weight that counts and where they dive below it
bounds a stretch; the text between, short lines and all, is kept.

Tags only weigh lines: outside links a line counts with its length, inside an
article or main element it reaches the least weight on its own. The least weight
of a page with such an element is four times its densest window, so what stands
outside stays only where it is far denser (as where an article element holds but
a teaser); on other pages any text outside links counts.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import free_name

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?>"[^"]*"|'[^']*'|[^'">])*+)>|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)>""",
    re.DOTALL,
)
#: What there is to find after the last ``>``: what a page's end closes.
_UNCLOSED = re.compile(r"<!--.*\Z|<[!?].*\Z", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s"']+)""")
_SPACE = re.compile(r"\s+")
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROPPED = frozenset("script style noscript template svg math canvas iframe object audio video map head title nav footer aside form button select textarea input datalist menu dialog header".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login share sharing social comment comments responses disqus reply replies alertbox related recommended widget widgets toolbar pagination pager".split()
)
#: Of these, what holds no article of its own.
_CERTAIN = _WORDS - frozenset("sidebar sidebars menu menus nav navbar navigation header masthead topbar banner modal popup share sharing social widget widgets toolbar".split())
#: These are subjects of articles too: they say so only alone or beside words of page layout (``share-price`` does not, ``share-box`` does).
_SUBJECTS = frozenset("ad ads banner comment comments consent header login menu menus navigation notice notices promotion related recommended reply replies responses share sharing social sponsor sponsors".split())
_LAYOUT = frozenset(
    "area bar block body bottom box btn button buttons card cards col column container content count desktop entry entries fixed form global grid group holder icon icons inline inner item items label large left link links list main mobile module native outer page panel post posts primary reader readers right row secondary section site slot small sticky stories story tab text thread tile title toggle tools top unit user users video wrap wrapper wrapping articles google leaderboard".split()
)
#: Outside articles these name parts around them, inside they are parts of their own.
_OUTSIDE = frozenset("discussion disclaimer legal privacy terms".split())
_UNLESS = frozenset("has with no not without".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCES = frozenset("article main section div table ul ol dl body td th li aside nav".split())
#: Elements of running text: these are dropped for a class or id only if all its words say so.
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt li".split())
#: Inside an article, these words name parts of it.
_OWN = frozenset("header masthead banner topbar".split())
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.IGNORECASE)
_UNSEEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
WINDOW = 3
#: How many times denser than the densest window of the articles what stands outside must be.
DENSER = 4


def _hinted(name: str, attributes: str, inside: bool = False) -> int:
    """Whether role, class, id or style say that an element is no main text: 2 if certainly, 1 unless an article is inside, else 0."""
    if not attributes.strip():
        return 0
    if _HIDDEN.search(_QUOTED.sub('""', attributes)):
        return 2
    found = 0
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "style" and _UNSEEN.search(value):
            return 2
        if key == "role" and value in _ROLES:
            found = max(found, 1)
        if key in ("class", "id"):
            for word in value.split():
                bits = {word} if name in ("article", "main") else set(re.split(r"[^a-z0-9]+", word)) - {""}
                if name in _PLAIN and not bits <= _WORDS or inside and bits & _OWN and not bits & (_WORDS - _OWN):
                    continue
                said = bits & (_WORDS if inside or name in ("article", "main") else _WORDS | _OUTSIDE)
                if not said or bits & _UNLESS:
                    continue
                if said <= _SUBJECTS | _OUTSIDE and any(not b.isdigit() for b in bits - _WORDS - _OUTSIDE - _LAYOUT):
                    continue
                found = max(found, 2 if said & _CERTAIN else 1)
    return found


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """Blocks of a page in order: text, its length outside links, whether it is inside an article; blocks that are no main text are empty."""
    out: list[tuple[str, int, bool]] = []
    stack: list[str] = []
    opened: Counter[str] = Counter()  # how often each name is on the stack
    text: list[str] = []
    plain = 0
    dropped = -1  # depth of the element that is left out
    soft = False  # it is left out for its name in class or id only
    inside = links = 0

    def flush() -> None:
        nonlocal plain
        block = _SPACE.sub(" ", "".join(text)).strip()
        out.append((block, plain, inside > 0))
        text.clear()
        plain = 0

    def pop(depth: int) -> None:
        nonlocal dropped, inside, links
        for name in stack[depth:]:
            opened[name] -= 1
            inside -= name in ("article", "main")
            links -= name == "a"
        if dropped >= depth:
            dropped = -1
        del stack[depth:]

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        found = (_TOKEN if at <= last else _UNCLOSED).search(page, at)
        chunk = page[at : found.start() if found else end]
        if chunk and dropped < 0:
            chunk = html.unescape(chunk) if "&" in chunk else chunk
            text.append(chunk)
            if not links:
                plain += len(chunk.strip())
        if not found:
            break
        at = found.end()
        name = (found.groupdict().get("name") or found.groupdict().get("name2") or "").lower()
        if not name:
            continue
        rest = found["rest"] if found["name"] else found["rest2"]
        if found["end"] or found["end2"]:
            if name not in _INLINE:
                flush()
            for depth in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[depth] == name:
                    pop(depth)
                    break
                if name in _INLINE and stack[depth] in _FENCES:
                    break
            continue
        if name not in _INLINE:
            flush()
        if name in _RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        if any(opened[x] for x in _CLOSES.get(name, ())):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth] in _CLOSES[name]:
                    pop(depth)
                    break
                if stack[depth] in _FENCES - _CLOSES[name]:
                    break
        if name in _VOID or rest.endswith("/") and name not in ("a", "p", "div"):
            continue
        if name == "body" and dropped >= 0:
            pop(dropped)
        if dropped >= 0 and soft and name in ("article", "main") and not inside and not _hinted(name, rest):
            dropped = -1
        if dropped < 0:
            hard = name in _DROPPED and not (name == "header" and inside)
            hint = 2 if hard else 0 if name in ("html", "body") else _hinted(name, rest, inside > 0)
            if hint:
                dropped, soft = len(stack), hint == 1
        stack.append(name)
        opened[name] += 1
        inside += name in ("article", "main")
        links += name == "a"
    flush()
    return out


def window_sums(weights: list[int]) -> list[int]:
    """Sums over WINDOW lines that begin WINDOW - 1 lines before the first; beyond the ends lines weigh nothing."""
    total, out = 0, []
    for k, weight in enumerate([*weights, *[0] * (WINDOW - 1)]):
        total += weight - (weights[k - WINDOW] if k >= WINDOW else 0)
        out.append(total)
    return out


def stretches(weights: list[int], least: int) -> list[tuple[int, int]]:
    """Surge and dive points of a run of lines: what no quiet window covers, where some window reaches ``least``.

    A window is quiet if its lines weigh nothing.
    """
    sums = window_sums(weights)
    quiet = {k for end in range(WINDOW - 1, len(weights)) if not sums[end] for k in range(end - WINDOW + 1, end + 1)}
    out: list[tuple[int, int]] = []
    first = None
    for k in range(len(weights) + 1):
        loud = k < len(weights) and k not in quiet
        if loud and first is None:
            first = k
        elif not loud and first is not None:
            if max(window_sums(weights[first:k])) >= least:
                out.append((first, k))
            first = None
    return out


def main_text(page: str | None) -> str:
    """Main text of a page: its blocks joined by one space; empty for a null page."""
    lines = [line for line in lines_of(page or "") if line[0]]
    runs: list[list[tuple[str, int, bool]]] = []
    for line in lines:
        if runs and runs[-1][-1][2] == line[2]:
            runs[-1].append(line)
        else:
            runs.append([line])
    densest = lambda wanted: max((max(window_sums([plain for _, plain, _ in run])) for run in runs if run[0][2] == wanted), default=0)
    framed = any(within for _, _, within in lines)
    least = max(1, DENSER * densest(True)) if framed else 1
    kept: list[str] = []
    for run in runs:
        weights = [least if within else plain for _, plain, within in run]
        for surge, dive in stretches(weights, least):
            kept += [text for text, _, _ in run[surge:dive]]
    return " ".join(kept)


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with text_col, the main text of html_col, and n_chars, its code points; they replace columns of these names.

    Null and empty pages and pages of markup only have an empty text. Repeated
    rows get equal texts; an empty table gives no rows; a very long page is read
    whole, in time that grows with its length. Other columns stay, whatever
    their names.
    """

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(x) for x in batch.to_pylist()], pa.string())

    got = F.arrow_udf(apply, "string")(F.col(html_col).cast("string"))
    name = free_name(pages, "_text")
    return pages.withColumn(name, got).drop(*{text_col, "n_chars"} - {html_col}).withColumnRenamed(name, text_col).withColumn("n_chars", F.length(text_col).cast("long"))
