"""Main text of web pages from flat text blocks and a small decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. A block is described by its words and link
density, those of the blocks before and after it, and weak signs of its place: inside an element that is never article text, the share of
class and id words around it that name page furniture, the share of the page's article text in its own ``article``, inside
``main``, heading, list item, after a line that opens reader comments, ending like a sentence. A decision tree, grown here
from the labelled layouts below, keeps or drops it.

Defined results: null or blank html gives an empty text and no characters; unclosed and crossed tags are closed
where HTML closes them; a link around blocks links them all; an element that nothing closes and a self-closed ``svg`` hide nothing after them
(but an unclosed script or style reaches to the end, as in HTML); a slash that ends an unquoted value does not close its element;
what a page hides (``hidden``, ``aria-hidden``, ``display:none``) and controls of forms are never text; character references are decoded once; whole
pages of any length; repeated rows each get the same row; null keys pass through; an empty table gives an empty
table; only the columns named in ``keep`` are carried.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's block-level, void and never-shown elements, and which open element a start tag closes within which others.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
UNSEEN = RAW | frozenset("noscript template svg math iframe object canvas select audio video button datalist".split())
FOREIGN = frozenset("svg math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {
    **dict.fromkeys(("li",), (("li",), ("ul", "ol", "menu", "dir"))),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))),
    **dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))),
    **dict.fromkeys(("tr", "tbody", "thead", "tfoot"), (("tr",), ("table",))),
}
# Elements and roles that are never article text; words of class or id that name page furniture, those that do so on any
# block and those that do so on containers only; words of which a short line consists that opens reader comments.
FURNITURE = frozenset("nav aside footer form menu dialog dir".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CONTAINERS = frozenset("aside details div dl fieldset figure footer form header menu nav ol section table tbody td tr ul".split())
ANYWHERE = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs consent cookie cookies nav navbar navigation newsletter promo share sharing social sponsor sponsored subscribe".split())
ON_CONTAINERS = frozenset(
    "banner comment comments copyright disclaimer disqus footer gdpr header login masthead menu modal notice notices notification pager pagination popup "
    "promotion recommended related replies reply respond responses search sidebar signup skip subscription toc toolbar topbar widget".split()
)
COMMENTS = frozenset("comment comments responses replies discussion kommentare kommentar commentaire commentaires comentario comentarios reactions".split())

NAMES = "words density prev_words prev_density next_words next_density furniture named article main region heading item comments sentence".split()

# The labelled table: blocks of small pages in several layouts. The sign before a block's text is its label (+ keep, - drop), ~n stands for n words of prose.
LAYOUTS = (
    # news page with sectioning elements
    """<body><header><a href=/>-The Paper</a><nav><ul><li><a href=1>-World</a><li><a href=2>-Local news</a><li><a href=3>-Sport</a></ul></nav></header>
    <div class=ad>-~12</div><main><article><header><h1>+~9</h1></header><p>+~25<p>+~60<figure><img><figcaption>+~8</figcaption></figure><h2>+~4</h2><p>+Yes.<p>+~33
    <ul><li>+~6<li>+~2<li><a href=4>+~5</a></ul><blockquote><p>+~18</p></blockquote><p>+~70 <a href=5>~20</a><div class=share-bar><a href=6>-Share</a> <a href=7>Mail</a></div>
    <div class=ad-slot>-~14</div><p>+~12<p><a href=8>+~7</a><p>+~48</article><aside><h3>-More</h3><p>-~30</aside></main><section id=comments><h2>-~2</h2><div><b>-Ann</b><p>-~40</p></div>
    <div><b>-Bo</b><p>-~12<p>-~25</div></section><footer><p>-~20<a href=9>-Imprint</a></footer>""",
    # the same without main; other article elements are teasers
    """<nav><a href=1>-Home</a> <a href=2>Blog</a></nav><div class=cookie-banner><p>-~28 <button>OK</button></div><article><h1>+~6</h1><p>+~4<p>+~41<table><tr><td>+~2<td>+~3<tr><td>+~1<td>+~9</table>
    <p>+~90<pre>+~15</pre><p class=notice>+~16<h3 id=comments-on-law>+~5</h3><p>+~52<section><h2>+~3</h2><p>+~22</section></article><h2>-Read next</h2><article><a href=3><h3>-~7</h3><p>-~18</p></a></article>
    <article><a href=4><h3>-~5</h3><p>-~22</p></a></article><article><h3><a href=5>-~6</a></h3><p>-~15</article><form><label>-~3</label><p>-~9</form><footer>-~14</footer>""",
    # blog of named containers
    """<div id=header><h1><a href=/>-My blog</a></h1><p>-~6</div><div class=menu><ul><li><a href=1>-Home</a><li><a href=2>-About me</a></ul></div><div class=wrap><div class=post><h2>+~7</h2><p>+~35<p>+~80
    <p>+~6<ul><li>+~12<li>+~9</ul><p>+~44 <a href=3>~6</a></div><div class=comment-list><h3>-~2</h3><p>-~30<p>-~14<p>-~50</div><div class=sidebar><h3>-About</h3><p>-~25<ul><li><a href=4>-~3</a>
    <li><a href=5>-~4</a></ul></div></div><div id=footer><p>-~11</div>""",
    # layout of tables, no names at all
    """<table><tr><td><a href=1>-Home</a><br><a href=2>News</a><br><a href=3>Links</a></td><td><font><b>+~5</b></font><p>+~45<p>+~70<p>+~20<p>+~55<p>+~8<p>+~62</td></tr><tr><td><a href=4>-Top</a><td><font>-~6</font></table>""",
    # containers with names that say nothing; teasers as links around blocks; comments after their heading
    """<div class=a1><div class=b2><a href=1>-~1</a></div><div class=b2><a href=2>-~2</a></div><div class=b2><a href=3>-~1</a></div></div><div class=c3><h1>+~8</h1><p>+~38<p>+~52<p>+~9<h2>+~3</h2><p>+~66<p>+~30</div>
    <div class=d4><a href=4><h3>-~8</h3><p>-~20</p></a><a href=5><h3>-~6</h3><p>-~24</p></a><a href=6><h3>-~9</h3><p>-~17</p></a></div>
    <div class=e5><h3>-Comments (3)</h3><div><span>-~2</span><p>-~26</p><a href=7>-Reply</a></div><div><span>-~2</span><p>-~40</p><a href=8>-Reply</a></div><div><span>-~1</span><p>-~11</p><a href=9>-Reply</a></div></div>
    <div class=f6>-~4</div><div class=f6><a href=10>-Terms</a> <a href=11>Privacy</a></div>""",
    # documentation: main without article
    """<header><a href=1>-Docs</a></header><div class=sidebar-nav><ul><li><a href=2>-~2</a><li><a href=3>-~3</a></ul></div><main><div class=breadcrumbs><a href=4>-Docs</a> / <a href=5>API</a></div><h1>+~3</h1><p>+~30<pre>+~20</pre><h2>+~2</h2>
    <p>+~4<ol><li>+~10<li>+~7<li>+~16</ol><dl><dt>+~1<dd>+~9<dt>+~1<dd>+~12</dl><p>+~28 <a href=6>~4</a><p><a href=7>+~4</a><div class=pagination><a href=8>-Next</a></div></main><footer><p>-~9</footer>""",
    # short and linked blocks of articles
    """<main><article><h1>+~3</h1><p><a href=1>+~6</a><p>+~5<p>+~8<h2>+~2</h2><ul><li><a href=2>+~4</a><li><a href=3>+~3</a></ul><p>+~6<h2>+~2</h2><p><a href=4>+~1</a><p>+~2<p>+~12<p><a href=5>+~9</a><h3>+Comments on ~2</h3><p>+~14</article></main>""",
    """<nav><a href=1>-Home</a></nav><article><p><a href=2>+~5</a><p>+~20<p>+~6<h2>+~2</h2><ol><li><a href=3>+~7</a><li><a href=4>+~2</a></ol><p>+~3<dl><dt><a href=5>+~1</a><dd>+~4<dt><a href=6>+~2</a><dd>+~11</dl><p>+~10</article><p>-~9<p><a href=7>-~3</a>""",
    # body only
    """<h1>+~5</h1><p>+~12<p>+~50<p>+~3<p>+~27<h2>+~4</h2><p>+~75<p>+~18<p>+~40""",
    """<body><p>+~30<p>+~42<hr><p>+~25</body>""",
    """<div>+~35</div>""",
    """<h2>+~4</h2><ul><li>+~9<li>+~14<li>+~11</ul><p>+~32""",
    # encyclopedia: names on wide containers, table of contents, boxes of links
    """<div id=top><a href=1>-Main page</a> <a href=2>Random</a></div><div id=content class=body-text><h1>+~2</h1><p>+~40 <a href=3>~3</a> <a href=4>~2</a> ~30<div id=toc><h2>-Contents</h2><ul><li><a href=5>-~2</a><li><a href=6>-~3</a></ul></div>
    <h2>+~2</h2><p>+~85 <a href=7>~12</a><p>+~15 <a href=8>~9</a><h2>+~1</h2><p>+~58<table><tr><td>+~3<td>+~8</table><p>+~33</div><div class=links><ul><li><a href=9>-~2</a><li><a href=10>-~3</a><li><a href=11>-~2</a></ul></div><div class=x>-~8</div>""",
    # landing page: only links and stumps
    """<ul><li><a href=1>-~2</a><li><a href=2>-~1</a><li><a href=3>-~3</a></ul><div><a href=4>-~4</a></div><div>-~3</div><div><a href=5>-~2</a> -~1</div>""",
    # shop: notices and forms by name, text in one container
    """<div class=topbar>-~9</div><div class=notice-box><p>-~22</div><div class=product-text><h1>+~6</h1><p>+~42<p>+~65<ul><li>+~4<li>+~6</ul><p>+~20</div><div class=newsletter-signup><p>-~17</div><div class=related-items><p>-~15<p><a href=1>-~5</a></div><div class=copyright>-~7</div>""",
)


def grow(table: np.ndarray, depth: int = 8) -> tuple | float:
    """A binary decision tree by Gini impurity: (feature, threshold, at most, above) or the share of kept rows."""
    x, y = table[:, :-1], table[:, -1]
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        levels = np.unique(x[:, f])
        for cut in (levels[:-1] + levels[1:]) / 2:
            left = x[:, f] <= cut
            impurity = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (left, ~left))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut))
    if best is None:
        return float(y.mean())
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(table[left], depth - 1), grow(table[~left], depth - 1)


def kept(tree: tuple | float, row: tuple) -> bool:
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree >= 0.5


_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNQUOTED_END = re.compile(r"=\s*[^\s\"'>][^\s>]*$")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_SPACE = re.compile(r"\s+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_LETTERS = re.compile(r"[^\W\d_]+")


@cache
def _close(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I)


def _signs(name: str, attributes: str, in_article: bool) -> tuple[bool, float, bool]:
    """(never article text, share of its class or id words that name furniture, hidden) of a start tag."""
    furniture = name in FURNITURE or (name == "header" and not in_article)
    named, hidden = 0.0, False
    if attributes.strip():
        listed = ANYWHERE | ON_CONTAINERS if name in CONTAINERS else ANYWHERE if name not in HEADINGS else frozenset()
        if in_article:
            listed -= {"header"}
        for m in _ATTRIBUTE.finditer(attributes):
            key = m.group(1).lower()
            value = m.group(2) or m.group(3) or m.group(4) or ""
            if key in ("class", "id") and name not in ("html", "body", "article", "main"):
                for word in value.split():
                    parts = [p.lower() for p in _PART.findall(word)]
                    if parts:
                        named = max(named, sum(p in listed for p in parts) / len(parts))
            elif key == "role":
                furniture = furniture or value.strip().lower() in ROLES
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDES.search(value.lower())):
                hidden = True
    return furniture, named, hidden


# What an open element hands to its content: furniture, named, number of its article, inside main, hidden.
Place = tuple[bool, float, int, bool, bool]
NOWHERE: Place = (False, 0.0, 0, False, False)


def blocks(page: str) -> list[tuple[str, int, float, Place, bool, bool, bool]]:
    """(text, words, link density, place, heading, item, among comments) of every block with text, in page order."""
    out = []
    stack: list[tuple[str, Place, bool]] = []  # name, what it hands on, whether it links
    depth: Counter[str] = Counter()  # of open elements by name
    text: list[str] = []
    words = linked = links = articles = 0
    heading = item = False
    comments = 0  # size of the stack that holds the comments, if any
    place = NOWHERE  # of the block being gathered
    never: set[str] = set()  # names that no end tag closes any more

    def here() -> Place:
        return stack[-1][1] if stack else NOWHERE

    def flush() -> None:
        nonlocal words, linked, comments
        if text:
            line = _SPACE.sub(" ", references.unescape("".join(text))).strip()
            if line and not place[4]:
                share = min(linked / words, 1.0) if words else 0.0
                n = line.count(" ") + 1
                if n <= 4 and share < 1 and not comments and (said := _LETTERS.findall(line.lower())) and COMMENTS.issuperset(said):
                    comments = max(len(stack) - heading, 1)
                out.append((line, n, share, place, heading, item, bool(comments)))
            text.clear()
        words = linked = 0

    def pop() -> str:
        nonlocal links, comments
        name, _, links_too = stack.pop()
        depth[name] -= 1
        links -= links_too
        if len(stack) < comments:
            comments = 0
        return name

    at, end = 0, len(page)
    last = max(page.rfind(">"), page.rfind("<!--"))  # beyond it is only text
    while at < end:
        m = _TOKEN.match(page, at) if at <= last else None
        piece = m.group() if m else page[at:]
        at += len(piece)
        name = m.group(2) if m else None
        if name is None:
            if m and piece[0] == "<" and len(piece) > 1:
                continue
            n = len(piece.split())
            if n and not words:
                place = here()
            if n or text:
                text.append(piece)
            words += n
            linked += n if links else 0
            continue
        name, attributes = name.lower(), m.group(3)
        closed = attributes.endswith("/") and not _UNQUOTED_END.search(attributes)
        if not m.group(1):
            if name in UNSEEN:
                if closed and name in FOREIGN:
                    continue
                close = _close(name).search(page, at) if name not in never else None
                if close is None:
                    never.add(name)  # nor after any later place
                if close:
                    at = close.end()
                elif name in ("title", "textarea"):
                    at = max(page.find("<", at), at)
                elif name in RAW:
                    at = end
                text.append(" ")
                continue
            if name in BLOCKS:
                flush()
                top = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCKS), -1)
                if top >= 0 and stack[top][0] == "p":  # a paragraph ends where a block begins
                    while len(stack) > top:
                        pop()
                if name in CLOSES:
                    gone, within = CLOSES[name]
                    if any(depth[g] for g in gone):
                        k = len(stack) - 1
                        while k >= 0 and stack[k][0] not in gone and stack[k][0] not in within:
                            k -= 1
                        if k >= 0 and stack[k][0] in gone:
                            while len(stack) > k:
                                pop()
                heading, item = name in HEADINGS, name == "li" or (item and name == "p" and bool(depth["li"]))
            elif name == "br":
                text.append(" ")
            elif name == "a" and depth["a"]:  # links do not nest
                while pop() != "a":
                    pass
            if name in VOID or closed:
                continue
            furniture, named, article, main, hidden = here()
            if name == "article":
                articles += 1
                article = articles
            f, n, h = _signs(name, attributes, bool(article) or main)
            stack.append((name, (furniture or f, max(named, n), article, main or name == "main", hidden or h), name == "a" and "href" in attributes.lower()))
            depth[name] += 1
            links += stack[-1][2]
        else:
            if name in BLOCKS:
                flush()
                heading = False
            if depth[name]:
                while pop() != name:
                    pass
            item = item and bool(depth["li"])
    flush()
    return out


_SENTENCE = re.compile(r"[.!?…:;。！？][\"'»”’)\]]*$")


def described(found: list[tuple[str, int, float, Place, bool, bool, bool]]) -> list[tuple]:
    """The numbers of NAMES for each block."""
    of: Counter[int] = Counter()
    for _, words, density, place, *_ in found:
        if place[2]:
            of[place[2]] += words * (1 - density) * (not place[0])
    most = sum(of.values())
    region = any(place[2] or place[3] for _, _, _, place, *_ in found)
    rows = []
    for i, (line, words, density, (furniture, named, article, main, _), heading, item, comments) in enumerate(found):
        before = found[i - 1][1:3] if i else (0, 0.0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        share = of[article] / most if article and most else float(bool(article))
        rows.append((words, density, *before, *after, furniture, named, share, main, region, heading, item, comments, bool(_SENTENCE.search(line))))
    return rows


def labelled(layouts: tuple[str, ...] = LAYOUTS) -> np.ndarray:
    """The labelled table: the numbers of NAMES of every block of the layouts, then 1 to keep or 0 to drop."""
    rows = []
    for page in layouts:
        found = blocks(re.sub(r"~(\d+)", lambda m: " ".join(["word"] * (int(m.group(1)) - 1) + ["word." if int(m.group(1)) > 7 else "word"]), page))
        rows += [(*row, block[0][0] == "+") for block, row in zip(found, described(found), strict=True)]
    return np.array(rows, float)


def extract(page: str, tree: tuple | float) -> str:
    """The kept blocks of a page, one per line."""
    found = blocks(page)
    return "\n".join([block[0] for block, row in zip(found, described(found), strict=True) if kept(tree, row)])


def main_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), table: np.ndarray | None = None) -> DataFrame:
    """(*keep, text, n_chars) for every row of ``df``."""
    tree = grow(labelled() if table is None else table)
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page or "", tree) for page in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return df.select(*keep, F.col(html_col).cast("string").alias("__html")).mapInArrow(run, f"{schema}text string, n_chars long")
