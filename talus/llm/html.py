"""Main text of web pages with a suffix array of each host's token streams.

Pages are parsed to blocks, and the token streams of all blocks, whatever element holds them, are concatenated by host. Their
suffix array is sparse: of each stream it holds the suffixes at its start and at content-defined anchors, which equal substrings
of LONG tokens share wherever they stand. A suffix is named by the hash of its tokens as far as the end of the next anchor, so
equal suffixes are substrings that repeat: they are counted, not sorted. Suffixes of enough distinct pages are boilerplate; the runs of
tokens that they cover go and unique runs stay. Elements that are frame by their role go too, and a page's article needs more pages to
lose a run than other blocks do, since articles share passages that are text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix64, retire, ship, small_enough, spread, word_hashes
from .minmax import near_duplicates

#: Substrings of LONG tokens have an anchor in common: the least hash of ANCHOR tokens among neighbours is one.
LONG, ANCHOR = 24, 12
#: What a repeat leaves of a block at its ends, up to ANCHOR tokens, goes with it from this covered share of the block on.
COVERED = 0.5
#: A suffix is boilerplate on so many distinct pages of a host; a whole stream of fewer than LONG tokens on so many, and one of
#: fewer than TINY tokens needs LONG_PAGES like others.
LONG_PAGES, SHORT_PAGES, TINY = 3, 2, 4
#: Within an article: on so many pages and on such a share of the host's pages.
ARTICLE_PAGES, ARTICLE_SHARE = 10, 0.9
#: Pages whose sets of five words are NEAR percent alike, and chains of such pages, are versions of one page and count once.
NEAR = 90
#: Characters of pages that are looked at together.
SLICE = 4 << 20

#: Elements by their role in HTML.
_HIDDEN = {"script", "style", "template", "noscript", "iframe", "object", "svg", "canvas", "head", "title", "button", "select", "option", "textarea", "input", "datalist", "audio", "video", "map"}
_FRAME = {"nav", "footer", "aside", "form", "menu", "dialog"}
_BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "section", "article", "main", "header", "blockquote", "pre", "figure", "figcaption", "address", "hr", "details", "summary", "fieldset", "legend", "body", "html", "center"} | _FRAME
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BOX = {"article", "main", "section", "div", "header", "ul", "ol", "dl", "table", "figure", "details", "fieldset", "blockquote", "span", "body"} | _FRAME | (_HIDDEN - _VOID - {"script", "style"})
#: Elements whose blocks form one stream.
_LIST = {"ul", "ol", "dl", "table", "header"} | _FRAME
#: A class or id hints at frame if one of its words is in _NAMES and all of them are in _NAMES or _PLAIN; within an article, a name
#: of one word must be in _INNER. It never decides for an element that holds the page's article.
_INNER = {"ad", "ads", "adv", "advert", "advertisement", "adsense", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "newsletter", "subscribe", "signup", "share", "sharing", "sidebar", "nav", "navbar", "breadcrumb", "breadcrumbs", "pagination", "pager", "comments", "disqus"}
_NAMES = _INNER | {"sponsor", "promotion", "banner", "notice", "notices", "alert", "popup", "modal", "overlay", "login", "social", "related", "recommended", "side", "aside", "menu", "navigation", "footer", "masthead", "comment", "respond", "reply", "replies", "widget", "toolbar", "search", "skip", "hidden", "teaser"}
_PLAIN = {"", "a", "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "global", "group", "head", "header", "icons", "inner", "item", "items", "js", "left", "link", "links", "list", "main", "media", "message", "outer", "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "sticky", "text", "thread", "to", "top", "unit", "wrap", "wrapper"}
_PAGE_HEAD = {"header", "head", "top"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "status"}
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def _named(value: str, inside: bool) -> bool:
    """Whether a class or id among value's hints at frame; within an article a single word must be in _INNER."""
    for token in value.split():
        words = {w.lower() for w in _SPLIT.split(token)}
        if words & (_INNER if inside and len(words) == 1 else _NAMES) and words <= _NAMES | _PLAIN:
            return True
    return False


def _heads(value: str) -> bool:
    """Whether a class or id among value's is that of a page's head."""
    return any((words := {w.lower() for w in _SPLIT.split(token)}) & _PAGE_HEAD and words <= _PAGE_HEAD | _PLAIN for token in value.split())


class Blocks(HTMLParser):
    """blocks: (frame, region, stream, text) in page order. frame numbers the innermost element around the block that may be frame,
    region the article or main around it; frames lists, for each such element, the one around it and whether it is frame for sure (by its
    element or role) or only by a hint, regions those around each article and main. Blocks of one list, table or frame have the same stream."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, bool, bool, int]] = []  # tag, frame, region, in an article, hidden, stream
        self.blocks: list[tuple[int, int, int, str]] = []
        self.frames: list[tuple[int, bool]] = [(0, False)]
        self.regions: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, frame, the region around it
        self.parts: list[str] = []
        self.place = (0, 0, 0)
        self.streams = 0
        self.raw = ""

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            frame, region, stream = self.place
            if not stream:
                self.streams += 1
                stream = self.streams
            self.blocks.append((frame, region, stream, text))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.raw = tag
            return
        if tag in _BLOCK:
            self._flush()
        elif tag in _VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag not in _BOX:
            return
        a = {k: v or "" for k, v in attrs} if attrs else {}
        names = f"{a.get('class', '')} {a.get('id', '')}" if attrs else " "
        _, frame, region, inside, hidden, stream = self.stack[-1] if self.stack else ("", 0, 0, False, False, 0)
        hidden = hidden or tag in _HIDDEN or "hidden" in a or a.get("aria-hidden") == "true"
        role = a.get("role", "").lower()
        sure = tag in _FRAME - {"form"} or role in _ROLES - {"form", "search"}
        hint = tag == "form" or role in _ROLES or tag not in ("body", "html", "main") and len(names) > 1 and _named(names, inside)
        hint = hint or not inside and (tag == "header" or len(names) > 1 and tag not in ("body", "article", "main") and _heads(names))
        if sure or hint:
            self.frames.append((frame, sure))
            frame = len(self.frames) - 1
        if tag == "main" and not region or tag == "article" and not inside:
            self.regions.append((tag, frame, region))
            region = len(self.regions) - 1
            inside = inside or tag == "article"
        if not stream and (tag in _LIST or sure or hint):
            self.streams += 1
            stream = self.streams
        if sure or hint or hidden or tag in _BLOCK:
            self._flush()
        self.stack.append((tag, frame, region, inside, hidden, stream))

    def handle_startendtag(self, tag, attrs):
        if tag not in _VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.raw = ""
            return
        if tag in _BLOCK:
            self._flush()
        if tag in _BOX and any(x[0] == tag for x in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.raw:
            return
        _, frame, region, _, hidden, stream = self.stack[-1] if self.stack else ("", 0, 0, False, False, 0)
        if hidden:
            return
        place = (frame, region, stream)
        if place != self.place:
            self._flush()
            self.place = place
        self.parts.append(data)

    def around(self, frame: int) -> list[int]:
        out = []
        while frame:
            out.append(frame)
            frame = self.frames[frame][0]
        return out


def blocks_of(html: str | None) -> list[tuple[int, int, str]]:
    """All blocks as (zone, stream, text): zone 2 in the page's articles or main, 1 where nothing marks them as frame, 0 elsewhere.

    The articles are those with the fewest hints of frame around them: what holds them isn't frame, whatever its class, and a form isn't
    either. An article inside frame for sure is none. Articles under hints count only if they hold more text than what is under no hint. If
    all blocks are frame, those that only hints mark are the main text."""
    if not html:
        return []
    p = Blocks()
    p.feed(html)
    p.close()
    p._flush()
    chains = {frame: p.around(frame) for frame in range(len(p.frames))}
    open_: set[int] = set()
    chosen: set[int] = set()
    for tag in ("article", "main"):
        found = {r: [f for f in chains[frame] if f not in open_] for r, (kind, frame, _) in enumerate(p.regions) if kind == tag and not any(p.frames[f][1] for f in chains[frame])}
        if not found or tag == "main" and chosen and min(map(len, found.values())):
            continue
        least = min(map(len, found.values()))
        best = {r for r, hints in found.items() if len(hints) == least}
        freed = open_.union(*(found[r] for r in best))
        if least:
            inner = sum(len(t) for f, r, _, t in p.blocks if r in best and freed.issuperset(chains[f]))
            if inner <= sum(len(t) for f, _, _, t in p.blocks if not chains[f]):
                continue
        open_, chosen = freed, chosen | best
    chosen |= {r for r, (_, _, above) in enumerate(p.regions) if above in chosen and r}

    def zone(frame: int, region: int) -> int:
        return 0 if not open_.issuperset(chains[frame]) else 2 if region in chosen else 1

    out = [(zone(frame, region), stream, text) for frame, region, stream, text in p.blocks]
    if out and not any(z for z, _, _ in out):
        out = [(0 if any(p.frames[f][1] for f in chains[frame]) else 1, stream, text) for frame, _, stream, text in p.blocks]
    return out


def main_zone(blocks: list[tuple[int, int, str]]) -> int:
    return 2 if any(zone == 2 for zone, _, _ in blocks) else 1


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return (m[1] if m else "").lower()


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def suffixes(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, stream and hash of the suffixes of streams of token hashes; stream i ends before ends[i].

    A suffix starts at its stream's start or at an anchor, and is cut at the end of the next anchor or of the stream."""
    n = len(tokens)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    stream = np.repeat(np.arange(len(ends)), ends - begins)
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE))])
    inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE_INVERSE))])
    upto = np.concatenate([[np.uint64(0)], np.cumsum((tokens + np.uint64(1)) * powers[:n], dtype=np.uint64)])

    def hashed(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix64((upto[e] - upto[s]) * inverse[s] + (e - s).astype(np.uint64))

    anchors = np.zeros(0, dtype=np.int64)
    if n >= LONG:
        width = LONG - ANCHOR + 1
        gram = hashed(np.arange(n - ANCHOR + 1), np.arange(ANCHOR, n + 1)) | np.uint64(1)
        least = np.lib.stride_tricks.sliding_window_view(gram, width).min(axis=1)
        least[stream[: len(least)] != stream[LONG - 1 :]] = 0  # windows over the end of a stream have no anchor
        padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        anchors = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(padded, width).max(axis=1) == gram)
    starts = np.unique(np.concatenate([begins, anchors]))
    starts = starts[starts < n]
    own = stream[starts]
    is_anchor = np.zeros(n + 1, dtype=bool)
    is_anchor[anchors] = True
    following = np.append(starts[1:], n)
    same = np.append(own[1:] == own[:-1], False)
    stops = np.where(same, np.minimum(following + ANCHOR, ends[own]), ends[own])
    return starts, stops, own, hashed(starts, stops)


def page_suffixes(pages: list[tuple[str, list[tuple[int, int, str]]]]):
    """For pages (host, blocks): per page a slice of the suffix keys, with starts, stops and the token offsets of blocks.

    Keys hold the host; their last bit tells a whole short stream, the bit before one of fewer than TINY tokens."""
    words, ends, stream_page, block_ends = [], [], [], []
    hosts = word_hashes([h.encode("utf-8", "replace") for h, _ in pages])
    n = 0
    for page, (_, blocks) in enumerate(pages):
        last = None
        for _, stream, text in blocks:
            if last is not None and stream != last:
                ends.append(n)
                stream_page.append(page)
            w = text.encode("utf-8", "replace").split(b" ")
            words += w
            n += len(w)
            block_ends.append(n)
            last = stream
        if blocks:
            ends.append(n)
            stream_page.append(page)
    known: dict[bytes, int] = dict.fromkeys(words, 0)
    hashes = word_hashes(list(known))
    for i, w in enumerate(known):
        known[w] = i
    tokens = hashes[np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=n)]
    starts, stops, own, key = suffixes(tokens, np.array(ends, dtype=np.int64))
    page_of = np.array(stream_page, dtype=np.int64)[own] if len(own) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([[0], ends]))[own] if len(own) else np.zeros(0, np.int64)
    key = mix64(key ^ hosts[page_of]) & ~np.uint64(3)
    key |= np.where(length < LONG, np.where(length < TINY, 3, 1), 0).astype(np.uint64)
    cut = np.searchsorted(page_of, np.arange(len(pages) + 1))
    return key.view(np.int64), starts, stops, cut, np.array(block_ends, dtype=np.int64), (mix64(hosts) & ~np.uint64(3) | np.uint64(2)).view(np.int64)


def _slices(htmls: list) -> list[tuple[int, int]]:
    """Runs of pages that are looked at together: no more than 128, and, but for one page alone, than SLICE characters."""
    out, first, held = [], 0, 0
    for i, h in enumerate(htmls):
        n = len(h or "")
        if i > first and (i - first == 128 or held + n > SLICE):
            out.append((first, i))
            first, held = i, 0
        held += n
    return [*out, (first, len(htmls))] if htmls else []


def _streams(batches):
    """(url, html, row) to (row, content, marked, text, keys): the main text's hash, the text of a page without an article, and
    the host's key with those of the page's distinct suffixes."""
    import pyarrow as pa
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        rows = batch.column(2)
        urls, htmls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, to in _slices(htmls):
            pages = [(host_of(u), blocks_of(h)) for u, h in zip(urls[at:to], htmls[at:to], strict=True)]
            key, _, _, cut, _, host = page_suffixes(pages)
            content, marked, texts, keys = [], [], [], []
            for i, (name, blocks) in enumerate(pages):
                zone = main_zone(blocks)
                text = "\n".join(t for z, _, t in blocks if z == zone)
                content.append(np.uint64(xxh3_64_intdigest(f"{name}\n{text}".encode("utf-8", "replace"))).astype(np.int64))
                marked.append(zone == 2)
                texts.append(None if zone == 2 else text)
                keys.append(np.append(host[i], np.unique(key[cut[i] : cut[i + 1]])) if blocks else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([rows.slice(at, to - at), pa.array(content, pa.int64()), pa.array(marked, pa.bool_()), pa.array(texts, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=["row", "content", "marked", "text", "keys"])


def _kept(shared):
    """(page_id, url, html, repeated keys and their pages, or null where all of them are shared) to the text that stays."""

    def run(batches):
        import pyarrow as pa

        every = None if shared is None else shared.value
        for batch in batches:
            urls, htmls, own = (batch.column(i).to_pylist() for i in (1, 2, 3))
            out = []
            for at, to in _slices(htmls):
                pages = [(host_of(u), blocks_of(h)) for u, h in zip(urls[at:to], htmls[at:to], strict=True)]
                key, starts, stops, cut, block_ends, host = page_suffixes(pages)
                first = 0
                for i, (_, blocks) in enumerate(pages):
                    known, counts = every if every is not None else _sorted(own[at + i])
                    mine = key[cut[i] : cut[i + 1]]
                    ends = block_ends[first : first + len(blocks)]
                    out.append("\n\n".join(_unique(blocks, ends, mine, starts[cut[i] : cut[i + 1]], stops[cut[i] : cut[i + 1]], _look(mine, known, counts), int(_look(host[i : i + 1], known, counts)[0]))))
                    first += len(blocks)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def _sorted(pairs) -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted((p["key"], p["n"]) for p in pairs or ())
    return np.array([k for k, _ in pairs], dtype=np.int64), np.array([n for _, n in pairs], dtype=np.int64)


def _look(keys: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """On how many pages each key is, 1 where it isn't a repeated one."""
    if not len(known):
        return np.ones(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[at], 1)


def boilerplate(keys: np.ndarray, pages: np.ndarray, host_pages: int) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes on so many pages, which are boilerplate, and which are even within an article."""
    enough = pages >= np.where(keys & 3 == 1, SHORT_PAGES, LONG_PAGES)
    return enough, (pages >= ARTICLE_PAGES) & (pages >= ARTICLE_SHARE * host_pages)


def _unique(blocks, ends, keys, starts, stops, pages, host_pages) -> list[str]:
    zone = main_zone(blocks)
    every, strict = boilerplate(keys, pages, host_pages)
    gone = strict if zone == 2 else every
    if not gone.any():
        return [text for z, _, text in blocks if z == zone]
    begins = np.concatenate([[ends[0] - len(blocks[0][2].split(" "))], ends[:-1]])
    mark = np.zeros(int(ends[-1] - begins[0]) + 1, dtype=np.int64)
    np.add.at(mark, starts[gone] - begins[0], 1)
    np.add.at(mark, stops[gone] - begins[0], -1)
    covered = np.cumsum(mark)[:-1] > 0
    out = []
    for (z, _, text), first, last in zip(blocks, (begins - begins[0]).tolist(), (ends - begins[0]).tolist(), strict=True):
        if z != zone:
            continue
        own = covered[first:last]
        if not own.any():
            out.append(text)
            continue
        words = text.split(" ")
        edges = np.flatnonzero(np.diff(np.concatenate([[True], own, [True]])))
        runs = [(a, b) for a, b in edges.reshape(-1, 2).tolist() if own.mean() < COVERED or b - a > ANCHOR]
        if runs:
            out.append(" ".join(w for a, b in runs for w in words[a:b]))
    return out


def host_repeats(pages: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """pages: url, html, row. The pages' suffixes (row, keys and more), and of those on two or more distinct pages of
    a host (key, n); with the scratch tables to discard."""
    spark = pages.sparkSession
    streams, streams_path = materialize(pages.select("url", "html", "row").mapInArrow(_streams, "row long, content long, marked boolean, text string, keys array<long>").withColumn("page", F.monotonically_increasing_id()), "html-streams")
    paths = [streams_path]
    version = streams.where("marked").select("page", F.col("content").alias("version"))
    unmarked = streams.where("text <> ''")
    if not unmarked.isEmpty():
        alike = near_duplicates(unmarked.select(F.col("page").alias("doc_id"), "text"), percent=NEAR)
        alike, at = materialize(alike.select(F.col("doc_id").alias("page"), F.col("component_id").alias("version")), "html-versions")
        paths.append(at)
        version = version.union(alike)
    # Pages with equal main text, and versions of one page, count once: all but one of them are left out.
    low = version.groupBy("version").agg(F.min("page").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    extra, at = materialize(version.join(low, "version").where("page <> low").select("page"), "html-extra")
    paths.append(at)
    side = F.broadcast(extra) if small_enough(extra.count(), 16) else extra
    keys = streams.join(side, "page", "left_anti").select(F.explode("keys").alias("key"))
    # Of the sorted suffixes only on how many pages equal ones are matters; partial counts settle that without bringing the
    # suffixes of a hot host, or a suffix of many pages, together.
    repeated, at = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "html-repeats")
    paths.append(at)
    return streams, repeated, paths


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null and empty html give an empty text. Pages without a host form one host. Mirrors and edited versions of a
    page count once when repeats are looked for, so they don't erase one another. Repeated rows and null ids are rows like others;
    other columns are ignored; an empty table gives an empty result."""
    spark = pages.sparkSession
    ship(spark)
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    base = spread(base)
    rowed = base.withColumn("row", F.xxhash64(F.col("page_id").cast("string"), "url", "html"))
    streams, repeated, paths = host_repeats(rowed)
    schema = base.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    n = repeated.count()
    # Pages are parsed again for the result: their blocks are as large as the input, too large to be kept in between.
    if small_enough(n, 16):
        got = repeated.orderBy("key").toPandas()
        shared = spark.sparkContext.broadcast((got["key"].to_numpy(np.int64), got["n"].to_numpy(np.int64)))
        discard(spark, *paths)
        return base.withColumn("own", F.lit(None).cast("array<struct<key:bigint,n:bigint>>")).mapInArrow(_kept(shared), schema)
    own = streams.select("row", F.explode("keys").alias("key")).join(repeated, "key").groupBy("row").agg(F.collect_set(F.struct("key", "n")).alias("own"))
    out, at = materialize(rowed.join(own, "row", "left").select("page_id", "url", "html", "own").mapInArrow(_kept(None), schema), "html-out")
    retire(spark, at)
    discard(spark, *paths)
    return out
