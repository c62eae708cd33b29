"""Main text of web pages by equivalence classes of tokens.

A token is a tag under its path of tags, or a text under its path. Its occurrence vector over a
host's pages is kept as sums of a hash of (page, count), so vectors are compared without
gathering a host's pages anywhere: tokens of one host with equal sums form a class, if they are two
at least. Tokens of a class are in the order of the sums of their first places, which is their order
on the pages if they have one. A frequent class (on more than half of a host's pages, and on three at
least) is valid on a page where its tokens come in that order, again and again, and where each round
of them lies in one slot of every valid class that is on more pages or comes less often; so classes nest into the
host's template. What lies between their tokens are slots. The texts of valid classes around
slots that hold a text of the page's own are template and are dropped; a text that is frequent by itself is not.
What is left is labelled by its elements: slots under an article or main element are the page's text, or all slots
on a page without one. Elements that are menus, headers, footers, sidebars, notices, adverts,
forms or comments are no part of a slot: by their tag, or as a hint by their class, id or role, if all its parts say so.

Rows: null html is empty text; a null url is the empty host; pages of any length are read whole; pages of a
host with the same html count once in its template, and each has its text; of classes with equal vectors those whose tokens
come first lead; an empty table gives no rows; other columns don't pass through, so their names are no matter.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

FLUSH = 200_000
HOSTS = 1000  # templates that a task holds ready
TEMPLATE_TOKENS = 1 << 20  # tokens of all templates up to which they are broadcast
# A tag, by the states of HTML's tokenizer: a quote opens a value only right after the equals sign.
_TAG = r"</?[a-zA-Z][^\s/>]*+(?>\s++|/(?!>)|[^\s/>=]++(?>\s*+=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?|=)*+/?>"
# Elements of plain text end at their end tag alone.
_RAW = r"<(script|style|textarea|title|iframe|noframes|xmp)\b[^>]*>.*?(?:</\1\b[^>]*>|$)"
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|" + _RAW + "|" + _TAG + "|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Tags that break a block, that hold boilerplate, and that have no end.
BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section article main header footer nav aside blockquote pre hr form figure figcaption address details summary fieldset body html".split())
BOILER = frozenset("nav aside form footer button dialog menu head select datalist noscript template svg object".split())
CONTROLS = frozenset("select datalist button".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
WORDS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside ad ads adv advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe share sharing social related comment comments reply replies disqus respond footer search login contentinfo complementary".split())
PLAIN = frozenset("list box bar block section wrapper wrap container content item items link links post posts panel widget area inner outer top bottom left right site page main primary secondary global user reader form signup button buttons group row column col toggle".split())
HEADERS = frozenset("header site-header page-header masthead topbar top-bar".split())


def _boiler(name: str, tag: str, in_article: bool) -> bool:
    if name in BOILER or name == "header" and not in_article:
        return True
    for m in _MARK.finditer(tag):
        for word in (m[1] or m[2] or m[3] or "").lower().split():
            if word in HEADERS and not in_article:
                return True
            if name not in ("article", "main", "body", "html") or word.startswith("comment"):
                said = [x in WORDS for x in re.split(r"[-_]+", word) if x not in PLAIN]
                if said and all(said):
                    return True
    return False


def parse(html: str) -> tuple[list, list]:
    """Tokens (path, what) of a page, and its slots: (block, in an article, boilerplate, number of the text's token or -1, text)."""
    tokens, slots, path = [], [], []
    block, article, skip = 0, 0, 0  # skip: the path's length down to the outermost boilerplate, or 0

    def close(depth: int) -> None:
        nonlocal article, skip
        while len(path) > depth:
            if path.pop() in ("article", "main") and (not skip or len(path) + 1 < skip):
                article -= 1
            if len(path) < skip:
                skip = 0

    for m in _TOKEN.finditer(html):
        t = m[0]
        if t[0] != "<" or t == "<":
            if t.strip():
                slots.append((block, article > 0, skip > 0, len(tokens), t))
                tokens.append(("/".join(path), t.strip()))
            elif slots:
                slots.append((block, article > 0, skip > 0, -1, t))
            continue
        if t[1] in "!?" or m[1]:
            continue
        name = _NAME.match(t)[1].lower()
        if name in BLOCK:
            block += 1
        elif name == "br":
            slots.append((block, article > 0, skip > 0, -1, " "))
        if t[1] == "/":
            tokens.append(("/".join(path), t[:2] + name))
            if name in path:
                close(len(path) - 1 - path[::-1].index(name))
            continue
        if name in BLOCK and path and (open_at := next((k for k, x in enumerate(path) if x in CONTROLS), None)) is not None:
            close(open_at)  # a control that was never closed holds no blocks
        tokens.append(("/".join(path), name))
        if name in VOID or t.endswith("/>"):
            continue
        if name == "p":
            depth = len(path)
            while depth and path[depth - 1] in ("p", "b", "i", "em", "strong", "a", "span"):
                depth -= 1
            close(depth)
        path.append(name)
        if skip:
            continue
        if _boiler(name, t, article > 0):
            skip = len(path)
        elif name in ("article", "main"):
            article += 1
    return tokens, slots


def _key(path: str, what: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\0{what}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1


def places(template: list) -> dict:
    """Of a template's classes, in their order: token to (class, place in it, tokens of it)."""
    return {t: (k, i, len(own)) for k, own in enumerate(template) for i, t in enumerate(own)}


def fixed(tokens: list, slots: list, known: dict) -> set:
    """Numbers of the page's texts that are template: of valid classes around slots with a text of the page's own."""
    if not known:
        return set()
    found = [known.get(_key(*t)) for t in tokens]
    texts = [s[3] for s in slots if s[3] >= 0]
    own = [k for k in texts if found[k] is None]
    rounds: dict[int, list] = {}
    for k, x in enumerate(found):
        if x:
            rounds.setdefault(x[0], []).append(k)
    valid: list[list] = []
    out: set = set()
    for c in sorted(rounds):
        at = rounds[c]
        size = found[at[0]][2]
        if len(at) % size or any(found[k][1] != i % size for i, k in enumerate(at)):
            continue
        ends = [(at[i], at[i + size - 1]) for i in range(0, len(at), size)]
        if any(bisect(v, a) != bisect(v, b) for v in valid for a, b in ends):
            continue
        valid.append(at)
        if any(bisect(own, a) != bisect(own, b) for a, b in ends):
            out.update(at)
    return out.intersection(texts)


def main_text(html: str, template) -> str:
    """Blocks of the page's content slots, in order; template as of ``places``."""
    tokens, slots = parse(html)
    gone = fixed(tokens, slots, template)
    inside = any(s[1] and not s[2] and s[4].strip() for s in slots)
    blocks: dict[int, list] = {}
    for block, article, skip, at, text in slots:
        if skip or inside and not article or at in gone:
            continue
        blocks.setdefault(block, []).append(text)
    lines = (" ".join(unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def _host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


SUMS = ("pages", "total", "m1", "m2", "at")


def vectors(pages: DataFrame) -> DataFrame:
    """(host, token, pages, total, m1, m2, at): a token's occurrence vector and first places as sums; token 0 counts a host's pages. Copies of a page count once."""

    def run(batches):
        held: dict = {}

        def flush():
            rows = [(h, t, c, *map(int, v)) for (h, t, c), v in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), *[pa.int64()] * 7), strict=True)], ["host", "token", "copy", *SUMS])

        for batch in batches:
            for host, page, html, copied in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                copy = page if copied else 0
                if copied and (host, 0, copy) in held:
                    continue
                count = {0: [1, 0]}
                for at, (path, what) in enumerate(parse(html or "")[0]):
                    count.setdefault(_key(path, what), [0, at])[0] += 1
                for k, (n, at) in count.items():
                    mark = ((page + n * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
                    mark = ((mark ^ (mark >> 31)) * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
                    v = held.setdefault((host, k, copy), [0, 0, 0, 0, 0])
                    for i, x in enumerate((1, n, mark >> 34, mark & 0x3FFFFFFF, at)):
                        v[i] += x
                if len(held) > FLUSH:
                    yield flush()
                    held = {}
        if held:
            yield flush()

    df = pages.select(_host(F.col("url")).alias("host"), F.xxhash64(F.coalesce("html", F.lit(""))).alias("page"), "html")
    # Only copied pages are told apart in the sums' key; both sums take one exchange.
    copied, _ = saved(df.groupBy("host", "page").agg(F.count("*").alias("n")).filter("n > 1").select("host", "page", F.lit(True).alias("copied")), "copied")
    df = df.join(copied, ["host", "page"], "left").select("host", "page", "html", "copied")
    got = df.mapInArrow(run, "host string, token long, copy long, " + ", ".join(f"{c} long" for c in SUMS))
    once = got.repartition("host", "token").groupBy("host", "token", "copy").agg(*(F.when(F.col("copy") == 0, F.sum(c)).otherwise(F.max(c)).alias(c) for c in SUMS))
    return once.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in SUMS))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the host's frequent classes, those on most pages and rarest there first, each with its tokens in order."""
    v = vectors(pages)
    size = v.filter("token = 0").select("host", F.col("pages").alias("all"))
    frequent = v.filter("token != 0 and pages >= 3").join(size, "host").filter("2 * pages > all")
    classes = frequent.groupBy("host", "pages", "total", "m1", "m2").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).getField("token").alias("tokens")).filter("size(tokens) > 1")
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("pages")).alias("rank"), "total", "m1", "m2", "tokens")))
    return classes.groupBy("host").agg(ranked.getField("tokens").alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    kinds = dict(pages.dtypes)
    found, _ = saved(templates(pages), "templates")
    size = found.agg(F.sum(F.expr("aggregate(template, 0L, (n, c) -> n + size(c))"))).first()[0] or 0
    if size <= TEMPLATE_TOKENS:
        found = F.broadcast(found)  # else a join by host, whose crowded hosts adaptive execution splits
    df = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host")).join(found, "host", "left").select("page_id", "url", "html", "template", "host")

    def run(batches):
        seen: dict[str, dict] = {}
        for batch in batches:
            html, template, host = batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist()
            texts = []
            for k, page in enumerate(html):
                if host[k] not in seen:
                    if len(seen) >= HOSTS:
                        seen.clear()
                    seen[host[k]] = places(template[k].as_py() or [])
                texts.append(main_text(page or "", seen[host[k]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
