"""Main text of web pages, with site templates removed.

Every element subtree that holds text gets a hash of its tag, attributes and content. Spark
counts, per host, the pages whose text differs in what is beside the subtree; a subtree that
recurs on many such pages is the host's template, and a second pass deletes it. Pages that are copies
of each other do not differ and so count once: a mirror is no template. Inside an ``article`` or
``main`` element, what is beside the subtree is the rest of that element; paragraphs, items and
headings there are the article's own even if they recur, and so is what holds most of its text.
Elsewhere only paragraphs of 25 words or more are.

What is boilerplate by its own mark-up goes too: menus, headers, footers, sidebars, notices,
adverts, scripts, styles and reader comments, by tag, role or class. Inside an article only
classes of adverts, menus, comments and the like decide, and never about a paragraph. A form goes unless it
holds an article or most of the page. If ``article`` and ``main`` elements hold a third of the text that is
left, the page's text is theirs, else all of it. A page that is template alone has no text.

Both passes read the html where it lies; only (host, hash, hash of the rest) are shuffled.

Defined results: null, empty and text-free html give an empty text; null or unparsable urls
have no host and no template; broken mark-up is read as browsers do: a tag whose quote is never
closed swallows the rest of the page and is no text; repeated rows give equal rows and count as
one page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A subtree is a template if it is on so many different pages of its host at least, and on this share of them or, on larger hosts, on the square root of their number.
MIN_PAGES, MIN_SHARE = 3, 0.2
#: Words from which a paragraph outside articles is nobody's template; share of the text that articles need to be the page's text.
OWN_WORDS, MAIN_SHARE = 25, 1 / 3
WRAP = 1 << 64
#: Hashes of templates that are broadcast at most (8 MB).
MAX_HASHES = 1_000_000

#: How HTML elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option caption head title".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "head script style noscript template nav header footer aside button select option textarea input iframe object embed svg"
    " canvas audio video map menu dialog title noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Tokens of class and id attributes that mark what is not the article: a whole token, or one of these words before or after a hyphen or
#: underscore of a token that names a kind of box with the other part (``cookie-notice``, ``ad_box``).
MARKS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead"
    " footer sidebar aside widget related recommended share sharing social comment comments disqus respond reply replies cookie cookies consent"
    " notice notification alert popup modal newsletter subscribe signup login search pagination pager toolbar copyright legal gdpr".split()
)
KINDS = MARKS | frozenset(
    "area bar block body box button buttons container content form group holder inner item items left link links list main outer page panel post posts right row"
    " section site slot strip thread top bottom text title unit wrap wrapper global primary secondary footer".split()
)
#: Of these, the ones that decide inside an article, about any element but those in OWN.
INNER_MARKS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs related recommended"
    " comment comments disqus respond reply replies cookie cookies consent popup modal newsletter subscribe signup login pagination pager toolbar".split()
)
TEASERS = frozenset("teaser teasers related recommended promo sponsored ad ads advert advertisement".split())
OWN = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr tbody thead tfoot blockquote pre figcaption caption hgroup".split())
CONTAINERS = frozenset(("html", "body", "main"))
#: Elements that an opening tag closes, if they are the nearest open block.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: A tag ends at the first ``>`` outside quotes; a quote opens only after ``=``. Without such an end it runs to the end of the page.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>=]|=)*?)(?:>|$)", re.S)
TOKEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
PART = re.compile(r"[-_:]+")


class _Open:
    """An open element: what it adds to blocks and hashes. ``scope`` and ``form`` are the numbers of the outermost article and form around it, or 0."""

    __slots__ = ("attributes", "content", "dropped", "first_block", "form", "scope", "tag")

    def __init__(self, tag: str, attributes: str, parent: _Open | None, first_block: int, number: int):
        self.tag, self.attributes, self.first_block = tag, attributes, first_block
        self.content: list[str] = []
        self.scope = parent.scope if parent and parent.scope else number if tag in ("article", "main") else 0
        self.form = parent.form if parent and parent.form else number if tag == "form" else 0
        self.dropped = (parent is not None and parent.dropped) or is_boilerplate(tag, attributes, bool(parent and parent.scope))


def is_boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    if tag in DROPPED and not (inside and tag == "header"):
        return True
    if tag in CONTAINERS or (inside and tag in OWN) or "=" not in attributes:
        return False
    marks = TEASERS if tag == "article" else INNER_MARKS if inside else MARKS
    for name, value in ATTRIBUTE.findall(attributes):
        tokens = value.strip("\"'").lower().split()
        if name.lower() == "role":
            if tag != "form" and not ROLES.isdisjoint(tokens):
                return True
        elif tag != "form" and any(_marks(t, marks) for t in tokens):
            return True
    return False


def _marks(token: str, marks: frozenset[str]) -> bool:
    """Whether a class token names a kind of boilerplate: each of its parts is a mark or a kind of box, and one is a mark."""
    parts = [p.rstrip("0123456789") for p in PART.split(token) if p]
    return not marks.isdisjoint(parts) and all(p in KINDS or p in marks or not p for p in parts)


def _signed(code: int) -> int:
    code %= WRAP
    return code - WRAP if code >= WRAP >> 1 else code


def parse(page: str | None, template: frozenset[int] = frozenset()) -> tuple[list[str], list[tuple[int, int]]]:
    """Blocks of the main text, and (hash, hash of the text beside it) of the subtrees that could be a template; the last one is that of the page's whole text, without a hash of its own."""
    blocks: list[tuple[str, int, int]] = []  # text, scope, form
    sums, sizes = [0], [0]  # running sums of the blocks' hashes and lengths
    found: list[tuple[int, int, int, int]] = []  # hash, scope, first block, end
    stack = [_Open("", "", None, 0, 0)]
    scopes: dict[int, list[int]] = {}  # blocks of an article: first, end
    n_open: Counter[str] = Counter()
    pending: list[str] = []
    opened = 0

    def flush() -> None:
        if pending:
            text = " ".join(entities.unescape("".join(pending)).split())
            pending.clear()
            if text:
                blocks.append((text, stack[-1].scope, stack[-1].form))
                sums.append(sums[-1] + xxhash.xxh64_intdigest(text))
                sizes.append(sizes[-1] + len(text))

    def say(text: str) -> None:
        if text:
            stack[-1].content.append(text)
            if not stack[-1].dropped:
                pending.append(text)

    def close() -> None:
        block = stack[-1].tag in BLOCKS
        if block:
            flush()
        node = stack.pop()
        n_open[node.tag] -= 1
        code = _signed(xxhash.xxh64_intdigest(f"{node.tag}\x00{node.attributes}\x00" + "\x01".join(node.content)))
        stack[-1].content.append(str(code))
        first, end = node.first_block, len(blocks)
        if node.scope and node.scope != stack[-1].scope:
            scopes[node.scope] = [first, end]
        elif block and first < end and node.tag not in ("html", "body"):
            own = node.tag in OWN if node.scope else node.tag == "p" and sum(b[0].count(" ") + 1 for b in blocks[first:end]) >= OWN_WORDS
            if not own:
                found.append((code, node.scope, first, end))

    if not page:
        return [], [(None, 0)]
    at = 0
    while True:
        begin = TOKEN.search(page, at)
        say(page[at : begin.start()] if begin else page[at:])
        if not begin:
            break
        if begin[0][1] in "!?":
            closing = "-->" if begin[0] == "<!--" else ">"
            end = page.find(closing, begin.end())
            at = len(page) if end < 0 else end + len(closing)
            continue
        m = TAG.match(page, begin.start())
        at, tag = m.end(), m[2].lower()
        if tag in BLOCKS:
            flush()
        if m[1]:
            if n_open[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in VOID:
            if tag == "br":
                say(" ")
            continue
        if tag in BLOCKS:
            for old in CLOSES.get(tag, ()) + ("p",):
                if any(x.tag == old for x in _near(stack, tag)):
                    while stack[-1].tag != old:
                        close()
                    close()
        opened += 1
        stack.append(_Open(tag, m[3].strip(), stack[-1], len(blocks), opened))
        n_open[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.start() if end else len(page)
    while len(stack) > 1:
        close()
    flush()
    whole = [0, len(blocks)]
    gone = [False] * len(blocks)
    beside = []
    for code, scope, first, end in found:
        low, high = scopes.get(scope, whole)
        if scope and 2 * (sizes[end] - sizes[first]) > sizes[high] - sizes[low]:
            continue  # most of the article
        beside.append((code, _signed(sums[high] - sums[low] - sums[end] + sums[first])))
        if code in template:
            gone[first:end] = [True] * (end - first)
    left = [(text, scope, form) for (text, scope, form), out in zip(blocks, gone, strict=True) if not out]
    return _main(left), [*beside, (None, _signed(sums[-1]))]


def _main(blocks: list[tuple[str, int, int]]) -> list[str]:
    """Texts of the blocks that are neither of a form (unless it holds an article or most of the text) nor beside the articles."""
    sizes: Counter[int] = Counter()
    articles = set()
    for text, scope, form in blocks:
        sizes[form] += len(text)
        if form and scope > form:
            articles.add(form)
    total = sum(sizes.values())
    kept = [(text, scope) for text, scope, form in blocks if not form or form in articles or 2 * sizes[form] > total]
    inside = sum(len(text) for text, scope in kept if scope)
    main = inside > 0 and inside >= MAIN_SHARE * sum(len(text) for text, _ in kept)
    return [text for text, scope in kept if scope or not main]


def _near(stack: list[_Open], tag: str) -> list[_Open]:
    """Open elements that an opening ``tag`` may close: up to the nearest element that holds its own blocks."""
    near = []
    for node in reversed(stack):
        if node.tag in ("", "html", "body", "article", "main", "div", "section", "table", "ul", "ol", "dl", "nav", "header", "footer", "aside", "form", "blockquote"):
            break
        if node.tag in ("td", "th", "li", "dd", "dt") and tag not in CLOSES:
            break
        near.append(node)
    return near


def with_host(pages: DataFrame) -> DataFrame:
    """``host`` of the url, lower case, without user and port; null if there is none."""
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return pages.withColumn("host", F.nullif(host, F.lit("")))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, template: the hashes of its recurring subtrees (at most those of a page, times the square root of the pages or 1 / min_share); kept."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(host, code, rest) for host, page in zip(batch["host"], batch["html"], strict=True) for code, rest in set(parse(page)[1])]
            yield pd.DataFrame({"host": [r[0] for r in rows], "hash": pd.array([r[1] for r in rows], dtype="Int64"), "rest": pd.array([r[2] for r in rows], dtype="int64")})

    seen = with_host(pages).where("host IS NOT NULL AND html IS NOT NULL").select("host", "html").transform(common.in_batches, task, "host string, hash long, rest long")
    # pages that are alike beside a subtree count once; the number of different pages travels as that of a hash that no subtree has
    counted = common.cut(seen.distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages))
    sites = counted.where("hash IS NULL").select("host", F.col("n").alias("n_pages"))
    frequent = counted.where("hash IS NOT NULL").join(sites, "host").where(F.col("n") >= F.least(min_share * F.col("n_pages"), F.sqrt("n_pages")))
    return common.cut(frequent.groupBy("host").agg(F.collect_list("hash").alias("template")))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    found = templates(pages, min_pages, min_share)
    found = common.broadcast_if(found, found.agg(F.sum(F.size("template") + 4)).first()[0] or 0, MAX_HASHES)
    rows = with_host(pages).select("page_id", "url", "html", "host").join(found, "host", "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "template")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[bytes, frozenset[int]] = {}
            texts = []
            for h, t in zip(batch["html"], batch["template"], strict=True):
                key = b"" if t is None else t.tobytes()
                if key not in known:
                    known[key] = frozenset(() if t is None else t.tolist())
                texts.append("\n".join(parse(h, known[key])[0]))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    texts = rows.transform(common.in_batches, task, "page_id string, url string, text string, n_chars long")
    return texts.withColumn("page_id", F.col("page_id").cast("long"))
