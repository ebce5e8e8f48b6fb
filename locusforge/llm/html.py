"""Main text of web pages by consensus of their hosts.

Each page's containers are scored and its best one votes with its generalised
tag and class path; votes are counted per host, and every page is extracted
again at its host's winning path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.llm.frames import mapped, settle
from locusforge.operators import scale

DROPPED = frozenset(
    "head title script style noscript template iframe svg math object canvas nav header footer aside button select "
    "option textarea input label dialog menu audio video".split()
)
#: Elements that an article has.
HEADS = frozenset("article main h1".split())
#: Part of a page's unlinked text beyond which an element named like noise, or a form, is none if it holds a head of
#: an article, and the part beyond which it is none even without.
MOST, NEARLY_ALL = 0.5, 0.95
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("article main section div td body".split())
CLOSE_P = frozenset(
    "address article aside blockquote body div dl dd dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main "
    "nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Class and id words of what is no article.
NOISE = re.compile(
    r"^(ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|alert|menu\w*|nav\w*|sidebar\w*|"
    r"aside|foot(er)?|masthead|breadcrumbs?|comments?|commentlist|disqus|replies|respond|share|sharing|social|"
    r"related|recommend\w*|newsletter|subscri\w*|signup|login|popup|modal|overlay|widget\w*|pagination|pager|toolbar|"
    r"copyright|disclaimer|skip)$"
)
#: Words of a page's header; that of an entry or a section holds a title.
PAGE_HEADER = re.compile(r"^(?:(?:site|page|main|top|global)[-_])?head(er)?$")
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b([^>]*)>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _named(tag: str, attributes: str) -> tuple[str, int]:
    """Tag with its first class, digits made one sign, and whether it is an article's (0), named like noise (1) or surely none (2)."""
    label, noise = tag, 2 * (tag in DROPPED) or int(tag == "form")
    if attributes and "=" in attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            words = "".join(values).lower().split()
            if name.lower() == "class" and words and label == tag:
                label = f"{tag}.{re.sub(r'[0-9]+', '#', words[0])}"
            named = any(PAGE_HEADER.match(w) or any(NOISE.match(part) for part in (w, *re.split(r"[-_]+", w))) for w in words)
            noise = max(noise, int(named))
    return label, 0 if tag in ("html", "body", "article", "main") else noise


Block = tuple[tuple[str, ...], str, int]


def blocks(page: str) -> list[Block]:
    """Text of each block outside of noise, with its path of labels from the root and its characters inside links.

    An element that is only named like noise is none if it holds most of the
    page's unlinked text and a head of an article, or nearly all of that text.
    """
    out, doubts, heads = _parsed(page)
    size = [max(len(words) - linked, 0) for _, words, linked in out]
    held: dict[int, int] = {}
    for n, around in zip(size, doubts):
        for element in around:
            held[element] = held.get(element, 0) + n
    total = max(sum(size), 1)
    # an article without any doubt leaves no room for another
    framed = any(not around and not {"article", "main"}.isdisjoint(label.split(".")[0] for label in block[0]) for block, around in zip(out, doubts))
    kept = {e for e, n in held.items() if n > (MOST if e in heads else NEARLY_ALL) * total and (e in heads or not framed)}
    return [block for block, around in zip(out, doubts) if kept.issuperset(around)]


def _parsed(page: str) -> tuple[list[Block], list[tuple[int, ...]], set[int]]:
    """All blocks outside of what is surely noise, the doubtful elements around each, and those with a head of an article."""
    out: list[Block] = []
    doubts: list[tuple[int, ...]] = []
    heads: set[int] = set()
    stack: list[tuple[str, str, int]] = []
    around: list[int] = []
    text: list[str] = []
    linked = at = depth = links = n_doubts = 0

    def flush() -> None:
        nonlocal linked
        words = " ".join("".join(text).split())
        if words:
            out.append((tuple(label for tag, label, _ in stack if tag not in INLINE), words, linked))
            doubts.append(tuple(around))
        text.clear()
        linked = 0

    def pop() -> None:
        nonlocal depth, links
        tag, _, noise = stack.pop()
        depth -= noise == 2
        links -= tag == "a"
        if noise == 1:
            if tag in INLINE:
                flush()
            around.pop()

    for match in TAG.finditer(page):
        if match.start() > at and not depth:
            piece = unescape(page[at : match.start()])
            text.append(piece)
            linked += len(piece.strip()) if links else 0
        at = match.end()
        tag = (match[4] or "").lower()
        if not tag:
            continue
        if match[3]:
            if any(t == tag for t, _, _ in stack):
                if tag not in INLINE:
                    flush()
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag == "p":
                flush()
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if tag in CLOSE_P:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == "p" or stack[n][0] in SAME_ENDS.get(tag, ()):
                    while len(stack) > n:
                        pop()
                    break
                if stack[n][0] not in INLINE:
                    break
        if match[5].rstrip().endswith("/") and tag not in CONTAINERS:
            continue
        label, noise = _named(tag, match[5])
        if noise == 1:
            if tag in INLINE:
                flush()
            n_doubts += 1
            around.append(n_doubts)
        elif tag in HEADS and not depth:
            heads.update(around)
        stack.append((tag, label, noise))
        depth += noise == 2
        links += tag == "a"
    if not depth:
        piece = unescape(re.sub(r"<[/!?a-zA-Z][^>]*\Z", "", page[at:]))  # a tag cut off by the end
        text.append(piece)
    flush()
    return out, doubts, heads


def best_container(found: list[Block]) -> tuple[tuple[str, ...], float]:
    """Path and score of the best container, or of what it is a part of.

    A container in an article stands for the article. Another one stands for
    its parent while the rest of that is headings and paragraphs of its own,
    without containers beside it, and mostly unlinked.
    """
    scores = container_scores(found)
    if not scores:
        return (), 0.0
    key = max(sorted(scores), key=scores.__getitem__)
    path, score = tuple(key.split("/")), scores[key]
    tags = [label.split(".")[0] for label in path]
    if "article" in tags:
        return path[: tags.index("article") + 1], score
    while True:
        above = [n for n in range(1, len(path)) if tags[n - 1] in CONTAINERS]
        if not above or tags[above[-1] - 1] == "body":
            return path, score
        parent = path[: above[-1]]
        beside = [b for b in found if b[0][: len(parent)] == parent and b[0][: len(path)] != path]
        inside = any(label.split(".")[0] in CONTAINERS for b in beside for label in b[0][len(parent) :])
        if not beside or inside or 2 * sum(b[2] for b in beside) > sum(len(b[1]) for b in beside):
            return path, score
        path = parent


def container_scores(found: list[tuple[tuple[str, ...], str, int]]) -> dict[str, float]:
    """Score of each container path: text outside links of its own blocks, half of that of blocks one container deeper."""
    scores: dict[str, float] = {}
    for path, words, linked in found:
        value = len(words) - 2.0 * linked
        share = 1.0
        for n in range(len(path), 0, -1):
            if path[n - 1].split(".")[0] in CONTAINERS:
                key = "/".join(path[:n])
                scores[key] = scores.get(key, 0.0) + share * value
                share /= 2
    return scores


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str | None, str], list[float]] = {}
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            path, score = best_container(blocks(page or ""))
            if score > 0:
                vote = votes.setdefault((host, "/".join(path)), [0, 0.0])
                vote[0] += 1
                vote[1] += score
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([h for h, _ in votes], pa.string()),
                pa.array([p for _, p in votes], pa.string()),
                pa.array([v[0] for v in votes.values()], pa.int64()),
                pa.array([round(v[1]) for v in votes.values()], pa.int64()),
            ],
            names=["host", "path", "votes", "score"],
        )


def page_text(page: str, winner: str | None) -> str:
    """Text at the winning path and below; at the page's own best container if it has no text there."""
    found = blocks(page)
    start = tuple(winner.split("/")) if winner else None
    chosen = [words for path, words, _ in found if start and path[: len(start)] == start]
    if not chosen and found:
        best, _ = best_container(found)
        chosen = [words for path, words, _ in found if path[: len(best)] == best]
    return " ".join(chosen)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, winners = batch.column("html").to_pylist(), batch.column("path").to_pylist()
        texts = [page_text(page or "", winner) for page, winner in zip(pages, winners)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page, from its whole html.

    A null html is an empty page. Pages without a host, and those of a null
    url, vote together as one host. A page whose host's winning path holds no
    text is extracted at its own best container; a page without text outside of
    noise gives the empty text. Votes are counted over all pages of a host, in
    each task first; a tie goes to the larger score, then to the path that
    sorts first. Rows of one key are pages of their own; other columns are not
    read.
    """
    host = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.coalesce(host, F.lit("")).alias("host")
    )
    votes = mapped(rows.select("host", "html"), _votes, "host string, path string, votes long, score long")
    counted = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    order = [F.col("votes").desc(), F.col("score").desc(), F.col("path")]
    winners = settle(scale.first_by(counted, ["host"], order).select("host", "path"), "winners")
    chosen = rows.join(winners, "host", "left").select("page_id", "url", "html", "path")
    kind = dict(pages.dtypes)[key]
    out = mapped(chosen, _extract, f"page_id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("page_id", key).withColumnRenamed("url", url)
