"""HTML extraction: wrappers for the pages of a host, inferred by aligning their token streams.

A page becomes a stream of text slots, each named by the block elements around it. Adjacent repetitions in a stream
fold into repeated groups. The streams of a host are aligned one after the other; what only some have becomes
optional, what one repeats becomes repeated. The wrapper so found is a regular expression without alternatives that
accepts every page of the host; it says which slots are the main text and which are template or page furniture.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm._text import apply_texts, stored

#: Streams or partial wrappers that one task aligns at a time; a host with more has partial wrappers, aligned in turn.
FAN = 64
#: A text outside of article and main that stands in the same slot of so many pages, and of half of the host's such
#: pages, is template.
TEMPLATE_PAGES = 3

#: Fixed values of HTML: elements by how they bear on text.
SKIP = frozenset("script style noscript template svg math iframe object canvas title select button textarea".split())
RAW = frozenset("script style title textarea noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROOTS = ("article", "main")
FURNITURE = frozenset("nav footer aside form menu dialog".split())
#: Words in class, id or role that name page furniture.
FURNITURE_WORDS = re.compile(
    r"(?<![^\s_-])(ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|"
    r"share|sharing|social|related|recommend\w*|comments?|comment-list|respond|replies|reader-comments|pagination|pager|widget|toolbar|login|search|complementary|contentinfo)(?![^\s_-])",
    re.I,
)
#: Of these words, those that inside an article name a part of it, and those that say nothing of an element there that is a block of text.
PART_WORDS = re.compile("header|masthead", re.I)
TEXT_WORDS = re.compile(r"header|masthead|banner|menu|related|recommend\w*|replies|social|search|login|toolbar|pager|navigation", re.I)
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())
#: Starting one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Starting a key ends an open sibling of its values (up to the container that follows).
ENDS_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _is_furniture(name: str, marks: str, inside: bool) -> bool:
    """Whether an element is page furniture. Inside an article or main, a header or a classed text block is part of it."""
    if name in FURNITURE or (name == "header" and not inside):
        return True
    harmless = None if not inside else TEXT_WORDS if name in TEXT_BLOCKS else PART_WORDS
    return any(not (harmless and harmless.fullmatch(m[1])) for m in FURNITURE_WORDS.finditer(marks))


def text_slots(page: str) -> list[tuple[str, str]]:
    """(name, text) of each text block in page order: the name is the path of block elements, furniture marked with ``!``,
    and outside of article and main a block of nothing but link text ends in ``@``.

    References are decoded and white space is one space; scripts, styles, comments and empty blocks are left out. A
    head is no block: what it may hold is left out anyhow, and what ends it without an end tag is body.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # element, its name in the path
    pieces: list[str] = []
    unlinked: list[str] = []  # of pieces, those outside of links
    skipped = links = 0

    def add(text):
        pieces.append(text)
        if not links:
            unlinked.append(text)

    def flush():
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                path = [n for _, n in stack]
                if not "".join(unlinked).strip() and not any(n in ROOTS for n in path):
                    path.append("@")
                out.append(("/".join(path), text))
            pieces.clear()
            unlinked.clear()

    def close(names, until):
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                flush()
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            if not skipped:
                add(page[at:])
            break
        if m.start() > at and not skipped:
            add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in SKIP:
                skipped = max(0, skipped - 1)
            elif name == "a":
                links = 0
            elif name not in INLINE and not skipped:
                flush()
                close({name}, {"table", "article", "main"} - {name} if name in ("p", "li", "td", "tr", "th") else ())
            continue
        if name in SKIP:
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif not m[3].rstrip().endswith("/"):
                skipped += 1
            continue
        if skipped:
            continue
        if name in ("br", "wbr"):
            add(" " if name == "br" else "")
            continue
        if name in INLINE:
            links = 1 if name == "a" else links
            continue
        flush()
        if name == "head":
            continue
        links = 0
        if name in ENDS_P:
            close({"p"}, {"table", "button", "td", "th"})
        if name in ENDS_SAME:
            close(*ENDS_SAME[name])
        if name in VOID:
            continue
        marks = " ".join(a or b or c for _, a, b, c in _ATTR.findall(m[3]))
        bad = _is_furniture(name, marks, any(n in ROOTS for n, _ in stack))
        stack.append((name, ("!" if bad else "") + name))
    flush()
    return out


# A wrapper is a list of items (flag, body): the body is a slot's name or a tuple of items, a group; the flag is "1" for
# once, "?" for optional, "+" for repeated and "*" for both.


def _key(item):
    """What an item stands for, whatever its flags."""
    return item[1] if isinstance(item[1], str) else tuple(map(_key, item[1]))


def _joined(a, b, repeated=False, optional=None):
    """One item for two of the same key: repeated if one is, optional if one is (or as told)."""
    plus = repeated or a[0] in "+*" or b[0] in "+*"
    maybe = (a[0] in "?*" or b[0] in "?*") if optional is None else optional
    body = a[1] if isinstance(a[1], str) else tuple(_joined(x, y) for x, y in zip(a[1], b[1]))
    return ("1?+*"[maybe + 2 * plus], body)


def fold(items: list, longest: int = 8) -> list:
    """Adjacent repetitions of up to ``longest`` items as one repeated group each; of several, that which covers most."""
    keys = [_key(x) for x in items]
    out, i = [], 0
    while i < len(items):
        best, most = 0, 0
        for size in range(1, min(longest, (len(items) - i) // 2) + 1):
            times = 1
            while keys[i + times * size : i + (times + 1) * size] == keys[i : i + size]:
                times += 1
            if times > 1 and times * size > most:
                best, most = size, times * size
        if not best:
            out.append(items[i])
            i += 1
            continue
        runs = [items[k : k + best] for k in range(i, i + most, best)]
        if best == 1:
            all_optional = all(r[0][0] in "?*" for r in runs)
            item = runs[0][0]
            for r in runs[1:]:
                item = _joined(item, r[0], repeated=True, optional=all_optional)
            out.append(item)
        else:
            group = runs[0]
            for r in runs[1:]:
                group = [_joined(x, y) for x, y in zip(group, r)]
            out.append(("+", tuple(group)))
        i += most
    return out


def folded(names: list[str]) -> list:
    """The stream of a page's slots as a wrapper of this page alone: runs first, then groups of them."""
    return fold(fold([("1", n) for n in names]))


def align(wrapper: list, stream: list) -> list:
    """A wrapper that accepts what either accepts: mismatches become optional items, in order, and repetitions repeated groups."""
    out = []
    for op, a, b, c, d in SequenceMatcher(None, list(map(_key, wrapper)), list(map(_key, stream)), autojunk=False).get_opcodes():
        if op == "equal":
            out += [_joined(x, y) for x, y in zip(wrapper[a:b], stream[c:d])]
        else:
            out += [("*" if f in "+*" else "?", body) for f, body in (*wrapper[a:b], *stream[c:d])]
    return fold(out, 1)


def wrapper_of(streams: list[list]) -> list:
    """One wrapper for the streams or partial wrappers of a host."""
    out = streams[0] if streams else []
    for s in streams[1:]:
        out = align(out, s)
    return out


def _leaves(items, repeated=False):
    for flag, body in items:
        if isinstance(body, str):
            yield body, repeated or flag in "+*"
        else:
            yield from _leaves(body, repeated or flag in "+*")


def content_names(wrapper: list) -> set[str]:
    """Names of the wrapper's slots that hold main text: those of article or main where there is one, no furniture.

    Without either, a repeated slot of nothing but links is a menu, unless there is nothing else.
    """
    clean = [(n, many) for n, many in _leaves(wrapper) if "!" not in n]
    for root in ROOTS:
        inside = {n for n, _ in clean if root in n.split("/")}
        if inside:
            return inside
    menus = {n for n, many in clean if many and n.split("/")[-1] == "@"}
    return {n for n, _ in clean} - menus or menus


def _packed(wrapper: list) -> str:
    return json.dumps(wrapper, separators=(",", ":"))


def _unpacked(text: str) -> list:
    item = lambda x: (x[0], x[1] if isinstance(x[1], str) else tuple(map(item, x[1])))
    return list(map(item, json.loads(text)))


def _mark(name: str, text: str) -> int:
    """A 64-bit digest of a slot's text."""
    return int.from_bytes(hashlib.blake2b(f"{name}\n{text}".encode(), digest_size=8).digest(), "big", signed=True)


def _streams(texts):
    out = {"stream": [], "outside": []}
    for t in texts:
        slots = text_slots(t.decode()) if t else []
        out["stream"].append(_packed(folded([n for n, _ in slots])))
        free = any(set(n.split("/")).intersection(ROOTS) for n, _ in slots)
        out["outside"].append([] if free else sorted({_mark(n, x) for n, x in slots if "!" not in n}))
    return out


def host_of(url):
    """Host of a URL column in lower case, empty for null."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]*)", 1), F.lit("")))


def _merge(batches):
    for pdf in batches:
        merged = [_packed(wrapper_of([_unpacked(r["stream"]) for r in rows])) for rows in pdf["parts"]]
        yield pd.DataFrame({"host": pdf["host"], "stream": merged, "n": pdf["n"]})


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, template): the wrapper of each host, and the digests of its template texts.

    Streams are counted before they meet, so a large host is no large group, and every distinct one is aligned: those
    of a host are dealt out to groups of about FAN, each becomes a partial wrapper, and these are dealt out in turn.
    """
    keyed = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    read = stored(apply_texts(keyed, "html", _streams, "stream string, outside array<long>", ["host"]).select("row.host", "out.*"), "streams")
    parts = stored(read.groupBy("host", "stream").agg(F.count("*").alias("n")), "stream-counts")
    while True:
        sizes = parts.groupBy("host").agg(F.count("*").alias("streams"))
        most = sizes.agg(F.max("streams")).first()[0] or 0
        if most <= 1:
            break
        dealt = parts.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("stream"), F.ceil(F.col("streams") / FAN)))
        groups = dealt.groupBy("host", "part").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "stream"))).alias("parts"))
        parts = stored(groups.mapInPandas(_merge, "host string, stream string, n long"), "partial-wrappers")
    bare = read.filter(F.size("outside") > 0)
    times = bare.select("host", F.explode("outside").alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("k")).filter(F.col("k") >= TEMPLATE_PAGES)
    common = times.join(bare.groupBy("host").agg(F.count("*").alias("pages")), "host").filter("2 * k >= pages").groupBy("host").agg(F.sort_array(F.collect_set("mark")).alias("template"))
    return parts.join(common, "host", "left").select("host", F.col("stream").alias("wrapper"), "template")


def _slots_of(batches):
    for pdf in batches:
        yield pd.DataFrame({"host": pdf["host"], "slots": [sorted(content_names(_unpacked(w))) for w in pdf["wrapper"]], "template": pdf["template"]})


def _extract(texts):
    slots = [text_slots(t.decode()) if t else [] for t in texts]
    return {"blocks": [[{"slot": n, "text": t, "mark": _mark(n, t)} for n, t in s] for s in slots], "own": [sorted(content_names(folded([n for n, _ in s]))) for s in slots]}


def report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: url, text (main text, blocks joined by a line feed), n_chars (code points), and host.

    A slot is main text if its host's wrapper keeps it; in pages without article or main, a text that the host's pages
    repeat in one slot is template. A page of which that leaves nothing is a wrapper of its own. Null html is empty;
    null urls share one host; empty pages have empty text; an empty table gives no rows; repeated rows, null and
    repeated ids included, each get a row; other columns are not read.
    """
    found = wrappers(pages, url_col, html_col).mapInPandas(_slots_of, "host string, slots array<string>, template array<long>")
    known = stored(found, "wrappers")  # its size is known before the join: pages move only where it is large
    keyed = pages.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host")).alias("key"), F.col(html_col).alias("html"))
    parsed = apply_texts(keyed, "html", _extract, "blocks array<struct<slot:string,text:string,mark:long>>, own array<string>", ["key"])
    joined = parsed.select(F.col("row.key.host").alias("host"), "row.key", "out.*").join(known, "host", "left")
    kept = lambda slots: F.filter("blocks", lambda b: F.array_contains(slots, b["slot"]))
    unlike = lambda blocks: F.filter(blocks, lambda b: F.col("template").isNull() | ~F.array_contains("template", b["mark"]))
    some = lambda blocks: F.when(F.size(blocks) > 0, blocks)
    main = F.coalesce(some(unlike(kept(F.col("slots")))), some(unlike(kept(F.col("own")))), kept(F.col("own")))
    text = F.array_join(F.transform(main, lambda b: b["text"]), "\n")
    done = joined.select("key", text.alias("text"))
    return done.select(F.col("key.id").alias(id_col), F.col("key.url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), F.col("key.host").alias("host"))
