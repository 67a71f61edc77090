"""Main text of web pages: markup first, then the repeats among the pages of a host.

Each page is cut into blocks (what stands between tags that begin or end a line). Blocks inside menus,
headers, footers, sidebars, notices, adverts, forms, comments and the like are dropped: by the element's name, its
role, or a whole name in its class or id, such as ``sidebar`` or ``comment-list``, but not ``no-sidebar`` or
``has-comments``. An element that only its class or id speaks against stays if it holds all articles of the page or more
than half of its text; the latter does not save comments, teasers and adverts. If the page names its article (``article`` or ``main``), the blocks inside it are kept and the
others dropped; an ``article`` that is marked as a comment or a teaser is dropped. Without one, all other blocks are
candidates.

The token streams of the remaining blocks of all pages of a host are then searched for long repeats with a
sparse suffix array: suffixes are kept where a minimiser stands, the smallest ``GRAM``-token hash of some window
of ``WINDOW`` tokens, and sorted by host and minimiser. Only minimisers whose neighbours show enough streams go back
to the text, where the suffixes at them are extended to both sides window by window; equal windows always have the
same minimiser, so every run of ``WINDOW`` tokens or more that
stands in different streams is found, and counted exactly. Equal streams (copies of a page) count once. Runs that at least
``FEW_PAGES`` streams of the host repeat are boilerplate, whatever the size of the host; in a named article only
those that ``MANY_PAGES`` repeat. Their tokens are removed, whatever blocks they lie in; all other tokens are
unique to the page and stay, in their blocks.

Defined cases: null and empty html give an empty text; broken markup is read as far as it goes, an
unfinished tag or comment at the end is dropped; a page without url belongs to the host of no name; rows
without page_id and repeated rows are handled one by one; further columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import html as html_entities
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import mixed, shuffles_cleared, slices, stored, word_hashes, words
from seqlake.llm.neighbours import with_equal_neighbour
from seqlake.llm.passages import find_runs, gram_hashes, list_column, span_hashes

WINDOW, GRAM = 16, 5
# Elements within each other that are dropped by name; those further in are dropped with the others.
_NESTED = 64
FEW_PAGES, MANY_PAGES = 3, 10

_SPANS = "array<struct<offset:int,windows:int,often:boolean>>"

# Names of HTML elements.
_BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody"
    " tfoot thead tr ul caption option optgroup".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template iframe textarea title svg math select object canvas audio video".split())
_SPACED = set("br td th img wbr input button".split())
_DROPPED = set("nav footer aside form menu dialog head button label fieldset".split())
_DROPPED_ROLES = set("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form".split())
# Words in class and id names of what is no main text.
_DROPPED_NAMES = set(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation"
    " menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice popup modal overlay newsletter"
    " subscribe signup login share sharing social related recommended comment comments disqus reply replies widget"
    " pagination pager toolbar masthead skip".split()
)
# Words that turn the others round, as in ``no-sidebar``, and what marks an article that is not the page's own.
_TURNING = set("no not non has have with without is hide hides hidden show shows enabled disabled enable disable on off open".split())
_OTHER_ARTICLES = set(
    "comment comments disqus reply replies related recommended teaser promo promotion sponsor sponsored ad ads advert advertisement".split()
)
# Inside a tag a quoted value may hold anything but what begins another tag; the slow form lets it hold that, too.
_TAG = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attributes>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>")
_SLOW_TAG = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attributes>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
# As a last resort a tag ends where its quotes are left out of account.
_LOOSE_TAG = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attributes>[^<>]*+)>")
_DECLARATION = re.compile(r"<[!?/][^>]*+(?:>|\Z)")
_UNFINISHED = re.compile(r"<[a-zA-Z/!?][^<>]*+\Z")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
# How an element is dropped: not at all, by what its class or id says, as comment, teaser or advert, or in any case.
_KEPT, _BY_NAME, _AS_OTHER, _ALWAYS = range(4)


def _named_by(attribute: str, names: set[str]) -> bool:
    """Whether a whole name of the class or id is one of ``names``, or made with one and nothing that turns it round."""
    return any(
        names & set(parts) and not _TURNING & set(parts)
        for parts in (_NAME_PARTS.findall(token) for token in attribute.lower().split())
    )


def _dropped(name: str, attributes: str, in_article: bool) -> int:
    if name in _DROPPED or name == "header" and not in_article:
        return _ALWAYS
    if not attributes.strip():
        return _KEPT
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return _ALWAYS
    if found.get("role", "").lower() in _DROPPED_ROLES:
        return _ALWAYS
    if name in ("html", "body", "main"):
        return _KEPT
    by = lambda names: any(_named_by(found.get(key, ""), names) for key in ("class", "id"))
    if by(_OTHER_ARTICLES):
        return _AS_OTHER
    return _BY_NAME if name != "article" and by(_DROPPED_NAMES) else _KEPT


def _tag(html: str, at: int, slow_left: int) -> tuple[re.Match | None, int]:
    """The tag that begins at ``at``, and how many characters may still be looked at in vain for slow ones."""
    found = _TAG.match(html, at)
    if found is None and slow_left > 0 and html[at + 1 : at + 2].isalpha():
        found = _SLOW_TAG.match(html, at)
        # A match moves on; only what was looked at in vain is looked at again.
        slow_left -= 0 if found else len(html) - at
        found = found or _LOOSE_TAG.match(html, at)
    return found or _LOOSE_TAG.match(html, at), slow_left


def page_blocks(html: str | None) -> tuple[list[str], bool]:
    """The blocks left by the markup, in order, and whether they are those of a named article.

    What a class or id names as no main text is dropped, unless it holds all articles of the page or, but for comments,
    teasers and adverts, more than half of its text. One pass: every character is looked at a bounded number of times, however broken the markup is.
    """
    html = html or ""
    # Text, whether it lies in an article, and the elements around it that are dropped by name.
    blocks: list[tuple[str, bool, tuple[int, ...]]] = []
    held: list[str] = []
    # Open elements: name, whether all inside is dropped, whether it is inside an article, those dropped by name.
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = [("", False, False, ())]
    open_names: Counter[str] = Counter()
    # Of each element dropped by name: articles inside, whether it is itself inside one, and whether as a comment.
    articles_in: list[int] = []
    inside_one: list[bool] = []
    as_other: list[bool] = []
    articles = at = 0
    slow_left = 4 * len(html)

    def end_block():
        text = " ".join(html_entities.unescape("".join(held)).split())
        held.clear()
        if text:
            blocks.append((text, stack[-1][2], stack[-1][3]))

    while at < len(html):
        place = html.find("<", at)
        text = html[at:] if place < 0 else html[at:place]
        if text and not stack[-1][1]:
            held.append(text)
        if place < 0:
            break
        if not (html[place + 1 : place + 2].isalpha() or html[place + 1 : place + 2] in "/!?"):
            # No markup begins here.
            if not stack[-1][1]:
                held.append("<")
            at = place + 1
            continue
        if html.startswith("<!--", place):
            end = html.find("-->", place + 4)
            at = len(html) if end < 0 else end + 3
            continue
        token, slow_left = _tag(html, place, slow_left)
        if token is None:
            other = _DECLARATION.match(html, place) or _UNFINISHED.match(html, place)
            if other is None and not stack[-1][1]:
                held.append("<")
            at = other.end() if other else place + 1
            continue
        at = token.end()
        name = token["name"].lower()
        if name in _BLOCKS:
            end_block()
        elif name in _SPACED:
            held.append(" ")
        if token["close"]:
            # Only open names are looked for, so each element is taken off once.
            while open_names[name]:
                last = stack.pop()[0]
                open_names[last] -= 1
                if last == name:
                    break
            continue
        if name in _RAW:
            # What follows is no markup until the element is closed.
            closing = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(html, at)
            at = closing.end() if closing else len(html)
            continue
        if name in _VOID or token["attributes"].endswith("/"):
            continue
        if name in _BLOCKS and stack[-1][0] == "p":
            stack.pop()
            open_names["p"] -= 1
        _, gone, inside, by_name = stack[-1]
        how = _dropped(name, token["attributes"], inside)
        gone = gone or how == _ALWAYS
        if how in (_BY_NAME, _AS_OTHER) and not gone and len(by_name) < _NESTED:
            by_name = (*by_name, len(articles_in))
            articles_in.append(0)
            inside_one.append(inside)
            as_other.append(how == _AS_OTHER)
        if name in ("article", "main") and not gone and how == _KEPT:
            if not inside:
                articles += 1
                for number in by_name:
                    articles_in[number] += 1
            inside = True
        stack.append((name, gone, inside, by_name))
        open_names[name] += 1
    end_block()
    size = sum(len(text) for text, *_ in blocks)
    sizes = Counter()
    for text, _, by_name in blocks:
        sizes.update(dict.fromkeys(by_name, len(text)))
    spared = {
        number for number, count in enumerate(articles_in)
        if count == articles and count and not inside_one[number] or 2 * sizes[number] > size and not as_other[number]
    }
    left = [(text, inside) for text, inside, by_name in blocks if spared.issuperset(by_name)]
    named = any(inside for _, inside in left)
    return [text for text, inside in left if inside or not named], named


def _parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, stream (a hash of host and blocks), named and blocks of each page."""
    schema = "page_id bigint, url string, host bigint, stream bigint, named boolean, blocks binary"

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "html"):
                streams, named, blocks = [], [], []
                for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                    found, own = page_blocks(html)
                    # A block holds no line break; packed, they are moved and kept in half the room.
                    blocks.append(zlib.compress("\n".join(found).encode()))
                    named.append(own)
                    streams.append(_signed("\n\n".join([str(host), *found])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), batch.column("host"),
                     pa.array(streams, pa.int64()), pa.array(named), pa.array(blocks, pa.binary())],
                    names=["page_id", "url", "host", "stream", "named", "blocks"],
                )

    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.xxhash64(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z]+://([^/?#]*)", 1))).alias("host"),
        F.col("html").cast("string").alias("html"),
    )
    return rows.mapInArrow(work, schema)


def _signed(text: str) -> int:
    value = xxhash.xxh64_intdigest(text)
    return value - (1 << 64) if value >> 63 else value


def _streams(batch: pa.RecordBatch):
    """Word hashes of all streams laid end to end, words of each, and the runs that share a minimiser."""
    flat, counts = words(pa.array([zlib.decompress(b).decode() for b in batch.column("blocks").to_pylist()]))
    values = word_hashes(flat)
    row, first, windows, anchor = find_runs(values, counts, WINDOW, GRAM)
    host = batch.column("host").to_numpy().view(np.uint64)
    return values, counts, host, row, first, windows, mixed(anchor ^ host[row])


def _suffixes(parsed: DataFrame) -> DataFrame:
    """The suffixes kept of each stream: anchor (a hash with the host), stream and ``named``, each once.

    Of copies in one task only the first is looked at, so that copies of a page do not multiply its suffixes.
    """

    def work(batches):
        seen: set[int] = set()
        for whole in batches:
            new = []
            for stream in whole.column("stream").to_pylist():
                new.append(stream not in seen)
                seen.add(stream)
            for batch in slices(whole.filter(pa.array(new, pa.bool_())), "blocks", 1 << 19):
                _, _, _, row, _, _, anchor = _streams(batch)
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                different = np.ones(len(row), bool)
                different[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                at = pa.array(row[different])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[different].view(np.int64)), batch.column("stream").take(at), batch.column("named").take(at)],
                    names=["anchor", "stream", "named"],
                )

    return parsed.select("host", "stream", "named", "blocks").mapInArrow(work, "anchor bigint, stream bigint, named boolean")


_RUNS = "anchor bigint, content bigint, stream bigint, start int, windows int, named boolean, hashes array<bigint>"


def _runs(batches):
    """The runs of each stream at the wanted anchors: place, number of windows, ``content`` (a hash of all tokens).

    The hashes of a run's windows go with the first run of that content in a task.
    """
    seen: set[tuple[int, int]] = set()
    for whole in batches:
        for batch in slices(whole, "blocks", 1 << 19):
            values, counts, host, row, first, windows, anchor = _streams(batch)
            bounds, wanted = list_column(batch, "anchors")
            wanted = wanted.to_numpy().view(np.uint64)
            at = np.zeros(len(row), bool)
            cuts = np.searchsorted(row, np.arange(len(counts) + 1))
            for number in range(len(counts)):
                own = slice(cuts[number], cuts[number + 1])
                at[own] = np.isin(anchor[own], wanted[bounds[number] : bounds[number + 1]])
            row, first, windows, anchor = row[at], first[at], windows[at], anchor[at]
            content = mixed(span_hashes(values, first, windows + WINDOW - 1) ^ host[row])
            grams = gram_hashes(values, WINDOW)
            hashes: list[np.ndarray | None] = []
            for pair, begin, size, number in zip(zip(anchor.tolist(), content.tolist()), first.tolist(), windows.tolist(), row.tolist()):
                hashes.append(None if pair in seen else mixed(grams[begin : begin + size] ^ host[number]).view(np.int64))
                seen.add(pair)
            begins = np.cumsum(counts) - counts
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), batch.column("stream").take(taken),
                 pa.array((first - begins[row]).astype(np.int32)), pa.array(windows.astype(np.int32)),
                 batch.column("named").take(taken), pa.array(hashes, pa.list_(pa.int64()))],
                names=["anchor", "content", "stream", "start", "windows", "named", "hashes"],
            )


def host_repeats(parsed: DataFrame) -> DataFrame:
    """(stream, spans): windows of a stream that several streams of its host repeat, and whether many do.

    Of named articles only those that many repeat, as no other window takes anything out of them.
    """
    members = stored(with_equal_neighbour(_suffixes(parsed), ["anchor"], ["stream"]), "members")
    # Copies of a page are one stream. No window has more streams than its anchor.
    once = members.groupBy("anchor", "stream").agg(F.min("named").alias("named"))
    counts = once.groupBy("anchor").agg(F.count("*").alias("most"), F.min("named").alias("named"))
    asked = counts.filter((F.col("most") >= MANY_PAGES) | ~F.col("named") & (F.col("most") >= FEW_PAGES)).select("anchor")
    wanted = once.join(asked, "anchor").groupBy("stream").agg(F.collect_list("anchor").alias("anchors"))
    # Joined alike at every size: the blocks are shuffled, however little is wanted of them.
    texts = parsed.dropDuplicates(["stream"]).join(stored(wanted, "wanted").hint("merge"), "stream")
    runs = stored(texts.select("host", "stream", "named", "blocks", "anchors").mapInArrow(_runs, _RUNS), "runs")
    # More streams than MANY_PAGES say nothing new: the first ones of each class hold the first ones of every window.
    streams = runs.groupBy("anchor", "content", "stream").agg(F.max("windows").alias("windows"))
    few = Window.partitionBy("anchor", "content").orderBy("stream")
    kept = streams.withColumn("number", F.row_number().over(few)).filter(F.col("number") <= MANY_PAGES)
    classes = kept.groupBy("anchor", "content").agg(F.collect_list("stream").alias("streams"), F.max("windows").alias("windows"))
    sizes = classes.groupBy("anchor").agg(F.count("*").alias("contents"))
    classes = stored(classes.join(sizes, "anchor"), "classes")
    often = F.col("n") >= MANY_PAGES
    span = lambda offset, windows: F.struct(offset.alias("offset"), windows.alias("windows"), "often")
    # All surroundings equal: all windows repeat.
    alone = classes.filter("contents = 1").withColumn("n", F.size("streams")).filter(F.col("n") >= FEW_PAGES)
    alone = alone.withColumn("often", often).select(
        "anchor", "content", F.array(span(F.lit(0), F.col("windows"))).cast(_SPANS).alias("spans")
    )
    several = classes.filter("contents > 1").select("anchor", "content", "streams")
    hashed = runs.filter("hashes IS NOT NULL").dropDuplicates(["anchor", "content"]).select("anchor", "content", "hashes")
    windows = stored(
        hashed.join(several, ["anchor", "content"])
        .select("anchor", "content", "streams", F.posexplode("hashes").alias("offset", "hash")),
        "windows",
    )
    repeated = windows.select("hash", F.explode("streams").alias("stream")).distinct().groupBy("hash").agg(F.count("*").alias("n"))
    repeated = repeated.filter(F.col("n") >= FEW_PAGES).select("hash", often.alias("often"))
    extended = windows.join(stored(repeated, "repeated"), "hash").groupBy("anchor", "content").agg(
        F.collect_list(span(F.col("offset"), F.lit(1))).cast(_SPANS).alias("spans")
    )
    found = stored(alone.unionByName(extended), "found")
    told = runs.join(found, ["anchor", "content"]).select(
        "stream", "named", F.expr("transform(spans, s -> struct(start + s.offset AS start, s.windows, s.often))").alias("spans")
    )
    told = told.withColumn("spans", F.filter("spans", lambda s: s["often"] | ~F.col("named"))).filter(F.size("spans") > 0)
    return told.groupBy("stream").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    with shuffles_cleared(pages.sparkSession):
        parsed = stored(_parsed(pages), "blocks")
        found = stored(host_repeats(parsed), "spans")
    rows = parsed.join(found.hint("merge"), "stream", "left").select("page_id", "url", "named", "blocks", "spans")

    def work(batches):
        for batch in batches:
            bounds, spans = list_column(batch, "spans")
            start, windows, often = (spans.field(i).to_pylist() for i in range(3))
            texts = []
            for row, (named, raw) in enumerate(zip(batch.column("named").to_pylist(), batch.column("blocks").to_pylist())):
                blocks = [block for block in zlib.decompress(raw).decode().split("\n") if block]
                part = range(int(bounds[row]), int(bounds[row + 1]))
                runs = [(start[i], start[i] + windows[i] + WINDOW - 1) for i in part if often[i] or not named]
                texts.append("\n\n".join(_uncovered(blocks, runs)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(text) for text in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(work, "page_id bigint, url string, text string, n_chars bigint")


def _uncovered(blocks: list[str], runs: list[tuple[int, int]]) -> list[str]:
    """The tokens outside all runs, block by block; a block of which nothing is left is left out."""
    if not runs:
        return blocks
    sizes = words(pa.array(blocks, pa.string()))[1]
    covered = np.zeros(int(sizes.sum()), bool)
    for start, end in runs:
        covered[start:end] = True
    out = []
    for block, own in zip(blocks, np.split(covered, np.cumsum(sizes)[:-1])):
        if own.any():
            # Blocks hold single spaces only.
            block = " ".join(token for token, gone in zip(block.split(" "), own.tolist()) if not gone)
        if block:
            out.append(block)
    return out
