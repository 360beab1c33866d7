"""Operator 7, main text of HTML pages by tag-path ratios.

A page is read into text nodes, each with its path of open block tags from the root (inline tags belong to their
block); a tag counts with what its class, id and role say about it.  Per path:

* text ratio: characters of text, less those inside links, per node of the path;
* punctuation ratio: sentence punctuation per node of the path.

Ratios are smoothed over the paths in page order with weights that fall with the distance
between paths (how many tags differ) and fused as text ratio x (1 + punctuation ratio).  Paths
whose fused ratio reaches ``share`` of the page's mean over paths (weighted by text) are content.  What an element
says it is enters the fused ratio as a factor: 0 below a tag or role that names a menu, header, footer, sidebar, advert, form,
script or style, or below hidden elements; ``beside`` below a class or id that names such a thing or reader
comments (1 on a page that has next to no text elsewhere); ``landmark`` below an element that says it is the article (where what paragraphs, headings, lists and
tables are called, and sections' ids, say nothing); 1 elsewhere.  The mean is over what is not said to be beside the article, if
a page has such text.  Ratios choose on every page: a link list inside
the landmark falls, rich text outside it stays, and a telling class alone never empties a page.

Headings, lists and short paragraphs stay with content in the same element: on a page that says what its article
is with all content therein, else with the longest content.  A heading in the article
stays with the content that it heads.

Character references are decoded; white space inside a block becomes one space and is trimmed;
blocks are joined in page order by one newline.  Inline tags and line breaks do not end a block.
Unclosed and wrongly nested tags are closed where a browser would, by the nearest open tag.  A tag ends at the
next tag if its own end is missing, and a quote that isn't closed before its tag ends counts as missing.  Elements nested
deeper than ``DEEPEST`` are read as neighbours, as browsers do, so the time is linear in the page.

A null or empty page has the text ''.  Rows may repeat.  Pages of any length are read whole.  An
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels of open elements.
DEEPEST = 512
_TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/><]*)")
_TAG_STOP = re.compile(r"[<>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MARKS = re.compile(r"[.,;:!?…。，！？]")
# Tags by their role in HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSED_BY = {
    "p": set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
    "head": {"body"},
}
ASIDE = set("nav header footer aside form script style noscript template button select option svg canvas iframe dialog menu head title object audio video textarea noembed noframes xmp".split())
LANDMARK = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tr td th caption figure figcaption".split())
# Words that name what is beside an article, and words for places and boxes that may follow them.
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot banner banners sponsor sponsors sponsored promo promos promotion promotions nav navs"
    " navbar navbars navigation navigations navmenu navlink navlinks navlist navbox navitem navitems menu menus breadcrumb breadcrumbs masthead sidebar sidebars widget"
    " widgets footer foot header cookie cookies consent notice notices notification notifications gdpr popup popups modal modals newsletter subscribe signup login search share"
    " sharing social related recommend recommended recommendation recommendations comment comments reply replies disqus respond pagination pager toolbar skip".split()
)
REMARK_WORDS = set("comment comments reply replies disqus respond".split())
PLACE_WORDS = set(
    "a area article articles b bar block body bottom box button buttons card cards col column container content form global group head holder icon icons inner item items js"
    " label left link links list main mobile outer overlay page panel pane post posts primary row secondary section sep site slot stories sub text title top right tray unit"
    " wrap wrapper zone".split()
)
_ARTICLE_WORDS = re.compile(r"(?:^|[^a-z])(?:article|article-?body|post-?body|post-?content|entry-?content|story-?body|main-?content)(?:[^a-z]|$)", re.I)
_ROLES = {"navigation": "-", "banner": "-", "contentinfo": "-", "complementary": "-", "search": "-", "form": "-", "dialog": "-", "alert": "-", "main": "+", "article": "+"}


def _says_aside(names: str) -> bool:
    """Whether a class or id names what is beside an article: such a word, perhaps in a place ("site-footer", "ad-slot-top",
    "related-posts"), but not as a word about something ("related-work", "share-story", "social-history")."""
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and (words[-1] in ASIDE_WORDS or words[0] in ASIDE_WORDS and all(w in PLACE_WORDS or w in ASIDE_WORDS for w in words[1:])):
            return True
        # Readers' remarks are named so after any word ("user-comments-list").
        if any(w in REMARK_WORDS and all(x in PLACE_WORDS for x in words[i + 1 :]) for i, w in enumerate(words)):
            return True
    return False


def _stance(tag: str, attributes: str, inside: bool) -> str:
    """'-' for what is no article, '~' for what is said to be beside it, '+' for the article, '' for none of these."""
    if tag in ASIDE:
        # An article's own header holds its headline.
        return "" if tag == "header" and inside else "-"
    if not attributes.strip():
        return "+" if tag in LANDMARK else ""
    said = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    role = _ROLES.get(said.get("role", "").lower().strip(), "")
    names = f"{said.get('class', '')} {said.get('id', '')}".strip()
    if role == "-" or "hidden" in said or said.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", said.get("style", "")):
        return "-"
    if tag in LANDMARK:
        return "~" if names and _says_aside(names) and not _ARTICLE_WORDS.search(names) else "+"
    if role == "+":
        return "+"
    if names and tag not in ("html", "body"):
        if _ARTICLE_WORDS.search(names):
            return "+"
        if inside and tag in TEXTUAL:
            return ""
        # In an article, a section's id is the anchor of its heading.
        if _says_aside(said.get("class", "") if inside and tag == "section" else names):
            return "~"
    return ""


def _tag_end(page: str, at: int, closed: dict[str, bool]) -> tuple[int, int]:
    """Where the attributes of a tag end and where the text after it begins.

    ``closed`` remembers quotes that don't occur any more, so nothing is searched twice.
    """
    first = at
    while True:
        m = _TAG_STOP.search(page, at)
        if m is None:
            return len(page), len(page)
        k = m.start()
        if m[0] == ">":
            return k, k + 1
        if m[0] == "<":
            return k, k
        at = k + 1
        if not page[first:k].rstrip().endswith("=") if k - first < 200 else page[k - 1] != "=":
            continue
        end = page.find(m[0], at) if closed.get(m[0], True) else -1
        if end < 0:
            closed[m[0]] = False
        # A value that runs over a tag's end, and is followed by more than a space or the end, lacks its own quote.
        elif not (page.find(">", at, end) >= 0 and page[end + 1 : end + 2] not in ("", ">", "/", " ", "\n", "\t", "\r")):
            at = end + 1


def text_nodes(page: str) -> Iterator[tuple[tuple[str, ...], str, str, int, bool]]:
    """(path, stance, text, block number, inside a link) of every text node, in page order."""
    stack: list[tuple[str, str, tuple[str, ...]]] = []  # tag, stance and path of blocks down to it
    blocks: list[int] = []  # where in the stack elements that aren't inline are
    opened: dict[str, int] = {}
    closed: dict[str, bool] = {}
    block, at, links = 0, 0, 0

    def pop(n: int) -> None:
        nonlocal block, links
        for tag, _, _ in stack[n:]:
            links -= tag == "a"
            opened[tag] -= 1
            if tag not in INLINE:
                block += 1
        del stack[n:]
        while blocks and blocks[-1] >= n:
            blocks.pop()

    def node(raw: str):
        _, stance, path = stack[-1] if stack else ("", "", ())
        return path, stance, html.unescape(raw), block, links > 0

    scan = 0
    while scan < len(page):
        k = page.find("<", scan)
        if k < 0:
            break
        if page.startswith("<!--", k):
            end = page.find("-->", k + 4)
            tag, close, after = "", False, end + 3 if end >= 0 else len(page)
        elif page[k + 1 : k + 2] in ("!", "?"):
            end = page.find(">", k)
            tag, close, after = "", False, end + 1 if end >= 0 else len(page)
        elif m := _TAG_NAME.match(page, k + 1):
            tag, close = m[2].lower(), bool(m[1])
            end, after = _tag_end(page, m.end(), closed)
            attributes = page[m.end() : end]
        else:
            scan = k + 1
            continue
        if k > at:
            yield node(page[at:k])
        scan = at = after
        if not tag:
            continue
        if close:
            if not opened.get(tag):
                block += tag not in INLINE
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
            continue
        if tag in VOID:
            if tag == "br":
                yield node(" ")  # words on two lines are two words
            block += tag not in INLINE
            continue
        if blocks and tag in CLOSED_BY.get(stack[blocks[-1]][0], ()):
            pop(blocks[-1])
        above, path = stack[-1][1:] if stack else ("", ())
        own = _stance(tag, attributes, above == "+")
        stance = next((x for x in "-~" if x in (above, own)), own or above)
        if tag not in INLINE:
            said = {x[1].lower(): x[2] or x[3] or x[4] or "" for x in _ATTRIBUTE.finditer(attributes)} if "class" in attributes else {}
            path = (*path, f"{tag}.{said['class'].split()[0]}" if said.get("class", "").split() else tag)
            block += 1
        if attributes.endswith("/") and tag in ("svg", "path"):
            continue
        if len(stack) < DEEPEST:
            if tag not in INLINE:
                blocks.append(len(stack))
            stack.append((tag, stance, path))
            opened[tag] = opened.get(tag, 0) + 1
            links += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            scan = end.start() if end else len(page)
            at = scan
    if at < len(page):
        yield node(page[at:])


def path_distance(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return len(a) + len(b) - 2 * same


def _holder(path: tuple[str, ...]) -> int:
    """Depth of the element that holds the path's paragraphs, lists and headings."""
    depth = len(path)
    while depth and path[depth - 1].split(".")[0] in TEXTUAL | INLINE:
        depth -= 1
    return depth


def content_paths(nodes: list[tuple], *, share: float = 0.5, reach: int = 2, landmark: float = 2.0, beside: float = 0.02) -> set[tuple]:
    """The (path, stance) pairs whose fused, smoothed ratio reaches the threshold, and what stays with them."""
    stats: dict[tuple, list[float]] = {}
    for path, stance, text, _, linked in nodes:
        chars = len(_SPACE.sub(" ", text).strip())
        if not chars:
            continue
        s = stats.setdefault((path, stance), [0.0, 0.0, 0.0, 0.0])
        s[0] += 0 if linked else chars
        s[3] += chars
        s[1] += len(_MARKS.findall(text))
        s[2] += 1
    length = {kind: sum(x[0] for k, x in stats.items() if k[1] == kind) for kind in ("", "~", "+")}
    if not length["+"] and 20 * length[""] < length["~"]:
        beside = 1.0  # what such a page says of itself can't be right
    keys = list(stats)
    ratio = [(stats[k][0] / stats[k][2], stats[k][1] / stats[k][2]) for k in keys]
    fused = {}
    for i, key in enumerate(keys):
        total, text, marks = 0.0, 0.0, 0.0
        for j in range(max(0, i - reach), min(len(keys), i + reach + 1)):
            w = 2.0 ** -path_distance(key[0], keys[j][0])
            total += w
            text += w * ratio[j][0]
            marks += w * ratio[j][1]
        fused[key] = {"-": 0.0, "~": beside, "": 1.0, "+": landmark}[key[1]] * text / total * (1 + marks / total)
    said = {k for k in keys if k[1] in ("", "+") and stats[k][0]} or {k for k in keys if k[1] == "~"}
    size = sum(stats[k][0] for k in said)
    mean = sum(fused[k] * stats[k][0] for k in said) / size if size else 0.0
    chosen = {k for k in keys if k[1] != "-" and fused[k] >= share * mean and fused[k] > 0}
    if chosen:
        # Headings, lists and short paragraphs beside the longest content, and beside all content of the article, belong to it.
        place = {k: i for i, k in enumerate(keys)}
        longest = max(chosen, key=lambda k: (stats[k][0], -place[k]))
        holders = {(k[1], k[0][: _holder(k[0])]) for k in chosen if k[1] == "+" or k == longest}
        for k in keys:
            # In an article also what stands deeper, in an element of its own.
            near = k[1] != "-" and any((k[1], k[0][:depth]) in holders for depth in range(1 if k[1] == "+" else _holder(k[0]), len(k[0]) + 1))
            if near and 2 * stats[k][0] >= stats[k][3]:
                chosen.add(k)
    return chosen


def _headings(nodes: list[tuple], content: set[tuple]) -> set[int]:
    """Numbers of the nodes of the article's headings with content before the next heading of their level or above."""
    out, seen, last = set(), [False] * 7, None
    for i in range(len(nodes) - 1, -1, -1):
        path, stance, text, block, _ = nodes[i]
        if stance == "-" or not text.strip():
            continue
        level = next((int(x[1]) for x in path if x.split(".")[0] in HEADINGS), 0)
        if not level:
            seen = [True] * 7 if (path, stance) in content else seen
            continue
        if block != last:
            last, kept = block, stance == "+" and seen[level]
            seen[level:] = [False] * (7 - level)
        if kept:
            out.add(i)
    return out


def main_text(page: str | None) -> str:
    nodes = list(text_nodes(page or ""))
    content = content_paths(nodes)
    heads = _headings(nodes, content)
    out, now, parts = [], None, []
    for i, (path, stance, text, block, _) in enumerate(nodes):
        if block != now:
            out.append("".join(parts))
            now, parts = block, []
        if (path, stance) in content or i in heads:
            parts.append(text)
        elif stance != "-":
            parts.append(" ")
    out.append("".join(parts))
    return "\n".join(x for x in (_SPACE.sub(" ", p).strip() for p in out) if x)


def extracted(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    schema=schema,
                )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
