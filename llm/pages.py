"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: opening tags and text pieces, each told apart by the containers around it. A token's
occurrence vector lists how often each page of the host has it; here a sum of hashes of (page, count), which adds
up in any order, stands for the vector. Tokens of one host with the same vector form an equivalence class. A class
is valid if it is frequent (in most pages of the host) and large, and its tokens nest: what contains each one is
frequent too. Valid classes are the host's template; the gaps between template tokens are slots.

The slots tell where the main text is, not what of it is kept: the main region is the container that holds the slots
with text outside furniture and link lists, widened to the article or main elements where the page has any. All of
the region is kept, text that the host repeats too (a heading, a standing paragraph, a shared list), but for what tags
and names say is furniture. So an article reads the same on a page alone on its host and among others. A page without
slots (alone on its host, or a copy of others) and without such elements keeps all that isn't furniture.

Counting per host is pre-aggregated in each task, so a host with a third of all pages is a few rows per task.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import mix, per_batch, stored, texts_of, word_hashes

# A class must be in this share of a host's pages and have so many tokens.
SHARE, LEAST_TOKENS = 0.9, 3
# A container whose text is links to this share over the host's pages is a menu.
LINK_SHARE = 0.6
# Templates that are broadcast, by their counted size; slices of a host where they are not.
BROADCAST_BYTES, SLICES = 32 << 20, 64

# HTML's own element lists, and words that name page furniture in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
# What is no text up to the end tag; without one, scripts and styles run to the end of the page, of others only the tag goes.
RAW = "script|style"
SKIPPED = frozenset("noscript template textarea svg iframe object select button canvas audio video title".split())
FURNITURE = frozenset("nav footer aside form menu dialog header".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner nav navbar navigation "
                  "menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice notices alert popup modal "
                  "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget "
                  "pagination pager comment comments commentlist respond reply replies disqus search form toolbar contentinfo complementary".split())
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus".split())
# Elements that hold a piece of text rather than a part of the page.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote figure figcaption table thead tbody tfoot tr td th caption address hr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S | re.I)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
ROOT = "/"
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# Ends of compounds that say nothing of the content (sidebar-left), and beginnings that tell of a layout (has-sidebar).
ENDS = frozenset("area bar block box buttons container inner items left links list right section top bottom widgets wrap wrapper".split())
LAYOUT = frozenset("has with without no not is show hide".split())
# How a block lies in furniture: named so outside its article, or in any other way.
AROUND, WITHIN = 1, 2


def named(attributes: str) -> set[str]:
    """Names of furniture (or ``main``) that class, id and role give as a whole or at the end of a compound."""
    found = set()
    for name in " ".join("".join(v) for v in NAMED.findall(attributes)).split():
        parts = [w.lower() for w in PARTS.findall(name)]
        found.add("".join(parts))
        if parts and parts[0] not in LAYOUT:
            while len(parts) > 1 and (parts[-1] in ENDS or parts[-1].isdigit()):
                parts.pop()
            found.add(parts[-1])
            if parts[0] == "main":
                found.add("main")
    return found


class Block:
    """A piece of text: its words, where it lies, whether in page furniture or an article, its characters in links."""
    __slots__ = ("text", "path", "furniture", "article", "links")

    def __init__(self, text: str, path: str, furniture: int, article: int, links: int):
        self.text, self.path, self.furniture, self.article, self.links = text, path, furniture, article, links


def parse(source: str) -> tuple[list[Block], list[str]]:
    """Blocks in page order, and the tag tokens (containers above and the tag with its names)."""
    blocks: list[Block] = []
    tags: list[str] = []
    # Of each open element: tag, container path, in furniture, in an article (3), a main element (2) or a part named main (1), in a link.
    stack: list[tuple[str, str, int, int, bool]] = [("", ROOT, 0, 0, False)]
    pieces: list[str] = []
    links = 0

    def flush():
        nonlocal links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                _, path, furniture, article, _ = next(e for e in reversed(stack) if e[0] not in INLINE)
                blocks.append(Block(text, path, furniture, article, min(links, len(text))))
            pieces.clear()
            links = 0

    def add(text: str):
        nonlocal links
        if text:
            pieces.append(text)
            if stack[-1][4]:
                links += len(text.strip())

    at = 0
    endless: set[str] = set()
    while m := TOKEN.search(source, at):
        add(source[at:m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                flush()
            continue
        tag = tag.lower()
        if tag in SKIPPED:
            if tag not in ("svg", "button", "select"):
                flush()
            # Only svg can close itself; an end that is missing is looked for once.
            if not m[2] and tag not in endless and not (tag == "svg" and m[4].endswith("/")):
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                if end:
                    at = end.end()
                else:
                    endless.add(tag)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag in CLOSES_P or tag == "li":
            ends = "p" if tag in CLOSES_P else "li"
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == ends:
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE and stack[i][0] != "p":
                    break
        attributes = m[4]
        _, path, furniture, article, link = stack[-1]
        names = sorted({w.lower() for v in NAMED.findall(attributes) for w in PARTS.findall("".join(v))}) if attributes else []
        token = f"{path}<{tag}" + "".join(f".{w}" for w in names)
        if tag not in INLINE:
            tags.append(token)
        says = named(attributes) if attributes else set()
        if tag in ("article", "main") or "main" in says and tag not in INLINE:
            article = max(article, {"article": 3, "main": 2}.get(tag, 1))
        if tag not in ("html", "body", "main"):
            told = NAMES & says
            if tag == "article":
                told &= COMMENTS
            elif article:
                told -= {"header"}
            if (tag in FURNITURE and tag != "form" and not (tag == "header" and article)) or attributes and HIDDEN.search(attributes) or told & COMMENTS:
                furniture = WITHIN
            elif told or tag == "form":
                furniture = max(furniture, WITHIN if article else AROUND)
        if tag not in VOID and not attributes.endswith("/"):
            stack.append((tag, token if tag not in INLINE else path, furniture, article, link or tag == "a"))
    add(source[at:])
    flush()
    return blocks, tags


def host_of(url):
    """Lower-cased host of a URL; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def numbers(tokens: list[str]) -> np.ndarray:
    return word_hashes([t.encode() for t in tokens]).view(np.int64)


COUNTS = "host string, token long, container long, pages long, vector long, chars long, links long"


def occurrences(pages: DataFrame) -> DataFrame:
    """Per host and token, summed over pages: pages that have it, sum of hashed (page, count), text and link characters.

    A token is a tag with its containers or a text piece with its containers; ``container`` is the token around it."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, ids = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        found: dict[tuple[str, str], list] = {}
        for k, source in enumerate(texts_of(batch, "html")):
            blocks, tags = parse(source.decode("utf-8", "replace"))
            counts: dict[str, list] = {}
            for t in ["*", *tags]:
                counts.setdefault(t, [0, t.rpartition("<")[0] or ROOT, 0, 0])[0] += 1
            for b in blocks:
                counts.setdefault(f"{b.path}#{b.text}", [0, b.path, 0, 0])[0] += 1
                if b.path in counts:
                    counts[b.path][2] += len(b.text)
                    counts[b.path][3] += b.links
            vectors = mix(np.fromiter([c[0] for c in counts.values()], np.uint64, len(counts)) + ids[k])
            for (t, c), v in zip(counts.items(), vectors.tolist()):
                row = found.setdefault((hosts[k], t), [c[1], 0, 0, 0, 0])
                row[1] += 1
                row[2] = (row[2] + v) & 0xFFFFFFFF
                row[3] += c[2]
                row[4] += c[3]
        keys, rows = list(found), list(found.values())
        return pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in keys]), pa.array(numbers([t for _, t in keys])), pa.array(numbers([r[0] for r in rows])),
             *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3, 4)]], COUNTS.replace(" long", "").replace(" string", "").split(", "))
    counted = pages.select("host", "row", "html").mapInArrow(per_batch(run, "html", 1 << 22), COUNTS)
    return counted.groupBy("host", "token").agg(F.first("container").alias("container"), *[F.sum(c).alias(c) for c in ("pages", "vector", "chars", "links")])


def templates(counted: DataFrame) -> DataFrame:
    """Per host: ``template`` (tokens of valid classes) and ``menus`` (containers whose text is mostly links)."""
    whole = int(numbers(["*"])[0])
    total = counted.where(F.col("token") == whole).select(F.col("host").alias("_host"), F.col("pages").alias("_pages"))
    frequent = counted.join(total, F.col("host") == F.col("_host")).where(F.col("pages") >= SHARE * F.col("_pages"))
    # Only tokens of nearly every page are left: a few per host, however many pages it has.
    classes = frequent.groupBy("host", "vector").agg(F.collect_list(F.struct("token", "container")).alias("members"), F.collect_list(
        F.when((F.col("chars") > 0) & (F.col("links") >= LINK_SHARE * F.col("chars")), F.col("token"))).alias("menus"))
    large = F.size("members") >= LEAST_TOKENS
    valid = classes.groupBy(F.col("host").alias("_host")).agg(
        F.flatten(F.collect_list(F.when(large, F.col("members")))).alias("members"), F.flatten(F.collect_list(F.when(large, F.col("menus")))).alias("menus"),
        F.flatten(F.collect_list("members")).alias("all"))
    around = F.concat(F.transform("all", lambda m: m["token"]), F.array(F.lit(int(numbers([ROOT])[0]))))
    nested = F.filter("members", lambda m: F.array_contains(around, m["container"]))
    return valid.select("_host", F.transform(nested, lambda m: m["token"]).alias("template"), "menus")


def extract(source: str, template: set[int], menus: set[int]) -> str:
    """Text of the main region, one block a line."""
    blocks, _ = parse(source)
    body = marked(blocks)
    if template and body and body[0].article < 2:
        body = region(blocks, body, template, menus)
    return "\n".join(b.text for b in body)


def container(block: Block) -> list[str]:
    """The parts of the page that a block lies in, from the outside."""
    parts = block.path.split("<")[1:]
    while parts and parts[-1].split(".")[0] in LEAVES:
        parts.pop()
    return parts


def region(blocks: list[Block], body: list[Block], template: set[int], menus: set[int]) -> list[Block]:
    """Of ``body`` (blocks outside furniture) what lies in the container of the slots.

    The container is the innermost one that holds all slots, and wider ones as long as they bring no furniture. Where
    slots have nothing in common but the page's body, parts of it without a slot are left out."""
    texts, paths = numbers([f"{b.path}#{b.text}" for b in blocks]).tolist(), numbers([b.path for b in blocks]).tolist()
    links = {id(b) for b, p in zip(blocks, paths) if p in menus}
    slots = [b for b, t in zip(blocks, texts) if t not in template and id(b) not in links]
    inside = {id(b) for b in body}
    places = [container(b) for b in slots if id(b) in inside]
    if not places:
        return body
    body = [b for b in body if id(b) not in links]
    common = places[0]
    for place in places:
        common = common[:next((i for i, (x, y) in enumerate(zip(common, place)) if x != y), min(len(common), len(place)))]
    outer = lambda place: not place or place[-1].split(".")[0] in ("html", "body")
    where = {id(b): container(b) for b in blocks}
    while not outer(common) and not outer(common[:-1]):
        wider = common[:-1]
        if any((b.furniture or id(b) in links) and where[id(b)][:len(wider)] == wider for b in blocks):
            break
        common = wider
    n = len(common)
    held = [b for b in body if where[id(b)][:n] == common]
    if outer(common):
        filled = {tuple(p[:n + 1]) for p in places}
        held = [b for b in held if len(where[id(b)]) == n or tuple(where[id(b)][:n + 1]) in filled]
    return held


def marked(blocks: list[Block]) -> list[Block]:
    """Blocks outside page furniture, of the articles and main elements (or else a part named main) where there are any.

    Names around an article, or a form, don't count where no other article or main element is left."""
    body = [b for b in blocks if not b.furniture]
    if all(b.article < 2 for b in body):
        body = [b for b in blocks if b.article >= 2 and b.furniture < WITHIN] or body
    deepest = max((b.article for b in body), default=0)
    return [b for b in body if b.article >= min(deepest, 2)]


def with_template(pages: DataFrame, known: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Add each page's ``template`` and ``menus``.

    Templates are a few numbers a host. While their counted size is at most ``most`` bytes they are broadcast and
    pages stay where they are; beyond it pages meet them by host and slice, so a large host is many groups."""
    size = known.agg(F.coalesce(F.sum(8 * (F.size("template") + F.size("menus")) + F.octet_length("_host") + 64), F.lit(0))).first()[0]
    if size <= most:
        return pages.join(F.broadcast(known), F.col("host") == F.col("_host"), "left")
    sliced = known.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return pages.join(sliced, (F.col("host") == F.col("_host")) & (F.pmod(F.xxhash64("row"), F.lit(SLICES)) == F.col("_slice")), "left").drop("_slice")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``url``, ``text``, ``n_chars``.

    Null html is empty and gives an empty text; html of any length is read whole. Page furniture (menus, headers,
    footers, sidebars, notices, adverts, forms, comments by their tags or names) goes. A page with articles or main
    elements keeps all the rest of them; any other page keeps the rest of the region where the host's pages differ, or,
    where they don't differ or the page is alone, all the rest. Repeated rows are each answered, null ids too; an empty
    table gives an empty result; other columns are not looked at, whatever their names.
    """
    base = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("row"),
                        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    known = with_template(base, stored(templates(occurrences(base)), "pages-templates")).select("page_id", "url", "html", "template", "menus", "host")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets: dict[str, tuple[set, set]] = {}
        out = []
        for source, host, template, menus in zip(texts_of(batch, "html"), batch.column(5).to_pylist(), batch.column(3), batch.column(4)):
            if host not in sets:
                sets[host] = (set(template.as_py() or ()), set(menus.as_py() or ()))
            out.append(extract(source.decode("utf-8", "replace"), *sets[host]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                                          ["page_id", "url", "text", "n_chars"])
    return known.mapInArrow(per_batch(run, "html"), "page_id long, url string, text string, n_chars long")
