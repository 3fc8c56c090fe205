"""HTML extraction with a host suffix array.

A page is read into blocks of text (block tags end a block, character references are
decoded, white space inside a block becomes one space). Blocks inside an ``article`` or
``main`` element are the page's main text (see :func:`main_blocks`); menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are left out by tag, role, class and
id wherever they stand. All other blocks of all pages are judged by their host: boilerplate is what
the host's pages repeat. Open are, on a page without an article or main element, all blocks that are left; on a
page whose main text has several parts (articles, cards, main's own prose), all parts but the
longest: a part that repeated runs cover whole is a teaser or notice and goes (see :func:`kept_parts`).

For that the token streams of all blocks are concatenated per host,
a suffix array (prefix doubling up to ``depth`` tokens) groups equal token runs, and runs
of at least ``depth`` tokens (or a whole shorter block) found on ``min_pages`` or more
distinct pages mark the tokens they cover. A token lies in a longer repeated run exactly where it lies in
one of ``depth`` tokens, so the array is sorted no deeper. Covered tokens go, unique runs stay. Pages of a
host with equal block texts, main text included, count as one page whatever their ids and
urls are, so copies of a page do not make its own text boilerplate. A host's
stream is dealt out in chunks of about ``chunk_tokens`` by page content; each chunk's array yields
its runs with their page counts, and the counts are added up per host before the
threshold is taken, so a hot host is no single task and its result does not depend on
the chunking. A run on more than half of a host's pages is on more than half of some chunk's: such runs alone
are counted on all of the host's pages, for the blocks of main text.

The longest part of main text (all of it on most pages) is in the same arrays, but structure speaks for it: a block
of it goes only if it is covered whole by runs that stand on ``MAIN_PAGES`` or more distinct pages and on more than half of the host's, and
only if it has ``depth`` tokens and such blocks hold less than half of the text (see :func:`kept_main`). Lines that some articles have in common are theirs, and pages
that show the same article keep it. Runs of these blocks do not count against the open ones.

Defined results: null or empty html gives an empty text; a page cut off in the middle of
a tag loses that tag; rows that repeat (same id, url and html) count as one page and get
equal results; pages without a host share the host ''; an empty table gives no row; html of any length is read
whole; further columns travel along under any name, ``text`` is replaced.
"""

from __future__ import annotations

import html as html_lib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statframe.session import shared_folder

from .common import free_name, table
from .op1_url_reputation import host_of

DEPTH = 8
MIN_PAGES = 3
#: Distinct pages on which a run must stand to take a block out of a page's longest part of main text.
MAIN_PAGES = 10
CHUNK_TOKENS = 400_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|math|object|canvas|textarea|select|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S | re.I)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that never hold main text, whatever they are called.
_LEFT_OUT = frozenset("nav header footer aside form head menu button dialog label fieldset option".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of a class or id that mark a part beside the article.
_BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promos promotion banner cookie cookies consent gdpr "
    "notice notices notification popup modal overlay sidebar aside menu menus nav navbar navigation topnav subnav breadcrumb breadcrumbs "
    "header masthead footer colophon share sharing social related recommended recommendations newsletter subscribe subscription signup login "
    "search searchbox widget widgets toolbar pagination pager skip toc tags disclaimer copyright".split())
_COMMENTS = frozenset("comment comments commentlist commentary disqus reply replies respond responses discussion reviews teaser teasers".split())
#: An open ``p`` or ``li`` ends where the next one begins.
_SELF_END = {"p": _BLOCK, "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
             "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
_KEEP, _BESIDE_ZONE, _HARD = 0, 1, 2


def _zone(tag: str, attrs: str, zone: int) -> int:
    """Zone of an element inside ``zone``: kept, beside the article, or out for good."""
    if zone == _HARD:
        return zone
    if tag in _LEFT_OUT:
        return _HARD
    main = tag == "main"
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return _KEEP if main else zone
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role":
            if value.strip() in _ROLES:
                return _HARD
            main = main or value.strip() == "main"
        elif name in ("class", "id", "itemprop"):
            names = set(re.split(r"[^a-z0-9]+", value))
            if names & _COMMENTS:
                return _HARD
            if names & _BESIDE and tag not in ("html", "body", "main", "article"):
                zone = _BESIDE_ZONE
        elif name == "hidden" and tag != "body" or name == "aria-hidden" and value == "true":
            return _HARD
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return _HARD
    return _KEEP if main else zone


def read_blocks(page: str) -> list[tuple[str, str, int]]:
    """(kind, text, part) per block in page order; kind: article (in one inside main: ``main article``), main,
    beside (an article inside a part beside the text), open (none of these) or out; part: which of the page's
    outermost articles holds it, from 1 (0: none)."""
    blocks: list[tuple[str, str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int, str, int]] = []  # tag, zone, container, part
    zone, inside, part, parts, pos = _KEEP, "", 0, 0, 0

    def flush():
        if text:
            t = " ".join(html_lib.unescape("".join(text)).split())
            if t:
                blocks.append(("beside" if zone == _BESIDE_ZONE and inside == "beside" else "out" if zone else inside or "open", t, part))
            text.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > pos:
            text.append(page[pos:m.start()])
        pos = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m["raw"] is not None:
                text.append(" ")
            continue
        tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            text.append(" ")
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            continue
        if m["end"] or m["end2"]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if at < 0:
                continue
            new_zone, new_in, new_part = stack[at - 1][1:] if at else (_KEEP, "", 0)
            if (new_zone, new_in, new_part) != (zone, inside, part):
                flush()
            del stack[at:]
            zone, inside, part = new_zone, new_in, new_part
            continue
        for at in range(len(stack) - 1, -1, -1):
            if tag in _SELF_END.get(stack[at][0], ()):
                del stack[at:]
                zone, inside, part = stack[-1][1:] if stack else (_KEEP, "", 0)
                break
            if stack[at][0] in _BLOCK:
                break
        new_zone = _zone(tag, attrs, zone)
        new_in, new_part = inside, part
        if tag == "article" and new_zone != _HARD and inside in ("", "main"):
            parts += 1
            new_part = parts
            new_in = "beside" if new_zone else "main article" if inside else "article"
        elif not inside and not new_zone and (tag == "main" or re.search(r"\brole\s*=\s*[\"']?main\b", attrs, re.I)):
            new_in = "main"
        if (new_zone, new_in, new_part) != (zone, inside, part):
            flush()
        stack.append((tag, new_zone, new_in, new_part))
        zone, inside, part = new_zone, new_in, new_part
    if pos < len(page):
        text.append(page[pos:])
    flush()
    return blocks


def main_blocks(blocks: list[tuple[str, str, int]]) -> list[tuple[str, int]]:
    """(text, part) of the blocks of the article (else of main); none if the page has neither. Articles inside
    main that hold less than main's own prose are parts of it (cards, boxes): then all of main counts. Articles
    inside a part beside the text (related, teasers) count only on a page without other main text."""
    own, inner, outer, beside = ([(t, p) for k, t, p in blocks if k == kind] for kind in ("main", "main article", "article", "beside"))
    if inner and sum(len(t) for t, _ in own) > sum(len(t) for t, _ in inner):
        return [(t, p) for k, t, p in blocks if k in ("main", "main article")]
    return inner or outer or own or beside


def main_text(blocks: list[tuple[str, str, int]]) -> str | None:
    """The texts of :func:`main_blocks` as one; None if there are none."""
    return "\n\n".join(t for t, _ in main_blocks(blocks)) or None


def open_parts(main: list[tuple[str, int]]) -> list[int]:
    """0 for the blocks of the longest part of main text (the first of equal ones), which structure alone keeps, and
    1, 2, ... for those of the other parts, which the host's runs judge. Empty if main text is one part."""
    size: dict[int, int] = {}
    for t, p in main:
        size[p] = size.get(p, 0) + t.count(" ") + 1
    if len(size) < 2:
        return []
    number = {p: i for i, p in enumerate(sorted(size, key=lambda p: -size[p]))}
    return [number[p] for _, p in main]


def longest(main: str | None, parts: list[int]) -> list[str]:
    """The blocks of the longest part of main text."""
    texts = main.split("\n\n") if main else []
    return [t for t, p in zip(texts, parts) if not p] if parts else texts


# ------------------------------------------------------------ suffix array
def token_hashes(text: str) -> np.ndarray:
    x = xxhash.xxh64_intdigest
    return np.fromiter((x(w) for w in text.split()), np.uint64)


def run_keys(h: np.ndarray, depth: int) -> np.ndarray:
    """Key of the run of ``depth`` tokens at each position (one key of all tokens if there are fewer)."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    n = min(depth, len(h))
    out = np.full(max(len(h) - n + 1, 0), n, np.uint64)
    for j in range(n):
        v = (out ^ h[j:j + len(out)]) * mix
        out = v ^ (v >> np.uint64(31))
    return out.view(np.int64)


def suffix_groups(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a token stream sorted to ``depth`` tokens, and each suffix's rank (equal
    rank: the first ``depth`` tokens are equal). Prefix doubling; a partial last step reaches
    depths that are no power of two."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    done = 1
    while done < depth:
        step = min(done, depth - done)
        ahead = np.full(len(rank), -1, np.int64)
        ahead[:len(rank) - step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        done += step
    return np.argsort(rank, kind="stable"), rank


def distinct_pages(run: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of a member, distinct pages) of each run."""
    if not len(run):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((page, run))
    r, p = run[order], page[order]
    new_run = np.r_[True, r[1:] != r[:-1]]
    new_page = new_run | np.r_[True, p[1:] != p[:-1]]
    at = np.flatnonzero(new_run)
    return order[at], np.add.reduceat(new_page.astype(np.int64), at)


def chunk_runs(streams: list[tuple[list[str], list[str]]], depth: int) -> tuple[tuple, tuple]:
    """(run key, distinct pages) of a chunk's pages, given as (blocks beside, blocks of the longest part), from the suffix array of
    their concatenated blocks; runs do not reach over the end of a block. First of the blocks beside, then of
    all blocks with ``depth`` tokens or more, there with the runs that stand in a longest part marked."""
    words = [b.split() for beside, longest in streams for b in (*beside, *longest)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    page = np.repeat(np.arange(len(streams)), [len(x) + len(y) for x, y in streams])
    main = np.repeat(np.tile([False, True], len(streams)), [len(x) for pair in streams for x in pair])
    x = xxhash.xxh64_intdigest
    tok = np.fromiter((x(w) for ws in words for w in ws), np.uint64, int(size.sum()))
    start = np.cumsum(size) - size
    long_ = size >= depth
    # the streams of the blocks that hold a whole run
    inside = np.repeat(long_, size)
    stream, n = tok[inside], size[long_]
    left = np.repeat(np.cumsum(n), n) - np.arange(len(stream))
    order, rank = suffix_groups(stream, depth) if len(stream) else (np.zeros(0, np.int64),) * 2
    order = order[left[order] >= depth]
    key = [run_keys(stream, depth)[order]] if len(order) else []
    run, of_page, of_main = [rank[order]], [np.repeat(page[long_], n)[order]], [np.repeat(main[long_], n)[order]]
    most = int(rank.max()) + 1 if len(rank) else 0
    for k in range(1, depth):  # whole shorter blocks
        at = np.flatnonzero(size == k)
        if len(at):
            keys = run_keys(tok[(start[at] + np.arange(k)[:, None])], k)[0]
            names, number = np.unique(keys, return_inverse=True)
            key.append(keys)
            run.append(number + most)
            of_page.append(page[at])
            of_main.append(main[at])
            most += len(names)
    key = np.concatenate(key) if key else np.zeros(0, np.int64)
    run, of_page, of_main = np.concatenate(run), np.concatenate(of_page), np.concatenate(of_main)
    at, pages = distinct_pages(run[:len(order)], of_page[:len(order)])
    beside, of_beside = distinct_pages(run[~of_main], of_page[~of_main])
    return (key[~of_main][beside], of_beside), (key[at], pages, np.isin(run[at], run[of_main]))


def kept_parts(texts: list[str], parts: list[int], runs: set, depth: int) -> list[str]:
    """Main text without its covered parts: an open part of which repeated runs cover every token goes whole, one
    with a token of its own stays whole. If the covered parts hold half of the text or more, they are its
    text (a list of articles, an article in several pieces) and stay."""
    bare = {p for p in parts if p} - {p for t, p in zip(texts, parts) if p and uncovered(t, runs, depth)}
    size = [t.count(" ") + 1 for t in texts]
    gone = sum(n for n, p in zip(size, parts) if p in bare)
    return [t for t, p in zip(texts, parts) if p not in bare or 2 * gone >= sum(size)]


def kept_main(texts: list[str], parts: list[int], common: set, depth: int) -> list[bool]:
    """Which blocks of main text stay by the runs ``common`` to most of the host's pages: blocks of the longest part that they
    cover whole go, unless these hold half of the text or more. Blocks of fewer than ``depth`` tokens (headings) stay."""
    size = [t.count(" ") + 1 for t in texts]
    gone = [not p and n >= depth and not uncovered(t, common, depth) for t, p, n in zip(texts, parts or [0] * len(texts), size)]
    return [not g for g in gone] if 2 * sum(n for n, g in zip(size, gone) if g) < sum(size) else [True] * len(texts)


def uncovered(block: str, runs: set, depth: int) -> str:
    """The block without the tokens that repeated runs cover."""
    words = block.split()
    keys = run_keys(token_hashes(block), depth)
    gone = np.zeros(len(words), bool)
    for i in np.flatnonzero(np.fromiter((k in runs for k in keys.tolist()), bool, len(keys))):
        gone[i:i + depth] = True
    return " ".join(w for w, g in zip(words, gone) if not g)


# ------------------------------------------------------------------ plans
PARSED = "struct<main:string, parts:array<int>, rest:array<string>, open:array<boolean>, n:bigint, content:bigint>"


def parsed_column():
    """Arrow function: html -> main text (null for a page without an article or main element), the open parts of its
    blocks, the blocks outside it and those of the open parts, which of them may be text, the tokens of all, and a hash
    of all block texts."""

    @F.arrow_udf(PARSED)
    def parsed(pages: pa.Array) -> pa.Array:
        main, parts, rest, open_, n, content = [], [], [], [], [], []
        for page in pages:
            blocks = read_blocks(page.as_py() or "")
            chosen = main_blocks(blocks)
            main.append("\n\n".join(t for t, _ in chosen) or None)
            parts.append(open_parts(chosen))
            texts = "\n".join(x if k in ("open", "out") else "\n" + x for k, x, _ in blocks)
            if parts[-1]:  # equal texts in other parts are another page
                texts += f"\n\n{parts[-1]}"
            content.append(xxhash.xxh64_intdigest(texts.encode("utf-8", "surrogatepass")) - 2**63)
            judged = [(k == "open", x) for k, x, _ in blocks if k in ("open", "out")] + [(True, t) for (t, _), p in zip(chosen, parts[-1]) if p]
            rest.append([x for _, x in judged])
            open_.append([o for o, _ in judged])
            n.append(sum(x.count(" ") + 1 for x in [*rest[-1], *longest(main[-1], parts[-1])]))
        return pa.StructArray.from_arrays([pa.array(main, pa.string()), pa.array(parts, pa.list_(pa.int32())), pa.array(rest, pa.list_(pa.string())),
                                           pa.array(open_, pa.list_(pa.bool_())), pa.array(n, pa.int64()), pa.array(content, pa.int64())],
                                          names=["main", "parts", "rest", "open", "n", "content"])

    return parsed


def packed(streams: DataFrame) -> DataFrame:
    """(host, chunk, more, size, pages): the blocks of each task's distinct pages, compressed together by host and chunk for
    their way to the arrays. Blocks hold no line end."""

    def pack(batches):
        seen = set()
        for batch in batches:
            lots: dict[tuple, list[str]] = {}
            for host, chunk, more, content, main, parts, rest, alone in zip(*(c.to_pylist() for c in batch.columns)):
                if (host, content) in seen:
                    continue
                seen.add((host, content))
                kept = longest(main, parts)
                lots.setdefault((host, chunk, more), []).extend([f"{content} {len(rest)} {len(kept)} {int(alone)}", *rest, *kept])
            raw = ["\n".join(x).encode() for x in lots.values()]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in lots], pa.string()), pa.array([k[1] for k in lots], pa.int32()), pa.array([k[2] for k in lots], pa.int32()),
                                              pa.array([len(x) for x in raw], pa.int64()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary())],
                                             names=["host", "chunk", "more", "size", "pages"])

    return streams.mapInArrow(pack, "host string, chunk int, more int, size long, pages binary")


def unpacked(t: pa.Table) -> dict[int, tuple[list[str], list[str], bool]]:
    """content -> (blocks beside, blocks of the longest part, alone) of the distinct pages of packed rows."""
    got = {}
    for size, pages in zip(t["size"].to_pylist(), t["pages"].to_pylist()):
        lines = pa.decompress(pages, size, "zstd", asbytes=True).decode().split("\n")
        at = 0
        while at < len(lines):
            content, beside, kept, alone = map(int, lines[at].split(" "))
            at += 1
            got[content] = lines[at:at + beside], lines[at + beside:at + beside + kept], bool(alone)
            at += beside + kept
    return got


def host_runs(streams: DataFrame, depth: int = DEPTH, min_pages: int = MIN_PAGES, chunk_tokens: int = CHUNK_TOKENS,
              main_pages: int = MAIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """From ``streams`` (host, content, main, parts, rest, alone, n), a row per page: (host, key) of the runs that ``min_pages`` or
    more distinct pages of a host share outside the longest parts, for the hosts with blocks left open; and (host, common), the list of
    the runs of longest parts that ``main_pages`` or more and over half of the host's distinct pages share."""
    # of the hosts with one chunk the chunk itself knows all; the others are no more than the tokens / chunk_tokens
    large = (streams.groupBy("host").agg(F.ceil(F.sum("n") / F.lit(chunk_tokens)).cast("int").alias("chunks"), F.max("alone").cast("int").alias("any"))
             .where("chunks > 1"))
    dealt = (streams.join(F.broadcast(large), "host", "left")
             .select("host", F.coalesce(F.pmod(F.xxhash64("content"), F.col("chunks")), F.lit(0)).cast("int").alias("chunk"),
                     F.coalesce("any", F.lit(-1)).alias("more"), "content", "main", "parts", "rest", "alone"))

    def runs(key, t):
        host, more = key[0].as_py(), t["more"][0].as_py()  # more: -1 if this is the host's only chunk, else whether the host has open blocks
        pages = unpacked(t)
        ordered = [pages[c] for c in sorted(pages)]
        (k, n), (k2, n2, in_main) = chunk_runs([x[:2] for x in ordered], depth)
        if not (any(x[2] for x in ordered) if more < 0 else more):
            k, n = k[:0], n[:0]
        if more < 0:
            k, n = k[n >= min_pages], n[n >= min_pages]
        likely = 2 * n2 > len(ordered)
        if more < 0:
            likely &= in_main & (n2 >= main_pages)
        k2, n2 = k2[likely], n2[likely]
        kind = np.repeat([0, 1, 2], [len(k), len(k2), 1])  # runs beside, runs of most pages, pages of the chunk
        return pa.table({"host": pa.array([host] * len(kind), pa.string()), "more": pa.array(np.full(len(kind), more), pa.int32()), "kind": pa.array(kind, pa.int32()),
                         "key": np.r_[k, k2, 0].astype(np.int64), "pages": np.r_[n, n2, len(ordered)].astype(np.int64)})

    found = _written(packed(dealt).groupBy("host", "chunk").applyInArrow(runs, "host string, more int, kind int, key long, pages long"), "op3-runs")
    beside = found.where("kind = 0").groupBy("host", "key").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= min_pages).select("host", "key")
    common = found.where("kind = 1 and more < 0").select("host", "key")
    likely = found.where("kind = 1 and more >= 0").select("host", "key").distinct()
    if not likely.isEmpty():
        lists = _written(likely.groupBy("host").agg(F.collect_set("key").alias("likely")), "op3-likely")

        def of_pages(batches):
            for batch in batches:
                h, c, k, m = [], [], [], []
                for host, content, main, parts, rest, keys in zip(*(x.to_pylist() for x in batch.columns)):
                    for in_main, blocks in enumerate((rest, longest(main, parts))):
                        own = [run_keys(token_hashes(b), depth) for b in blocks if b.count(" ") + 1 >= depth]
                        own = np.intersect1d(np.concatenate(own), keys).tolist() if own else []
                        h += [host] * len(own)
                        c += [content] * len(own)
                        k += own
                        m += [in_main] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(c, pa.int64()), pa.array(k, pa.int64()), pa.array(m, pa.int32())],
                                                 names=["host", "content", "key", "main"])

        counted = (streams.select("host", "content", "main", "parts", "rest").join(lists, "host").mapInArrow(of_pages, "host string, content long, key long, main int")
                   .groupBy("host", "key", "content").agg(F.max("main").alias("main"))
                   .groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.max("main").alias("main")))
        all_pages = found.where("kind = 2 and more >= 0").groupBy("host").agg(F.sum("pages").alias("all"))
        common = common.unionByName(counted.join(all_pages, "host").where((F.col("main") == 1) & (F.col("n") >= main_pages) & (2 * F.col("n") > F.col("all"))).select("host", "key"))
    return beside, _written(common.groupBy("host").agg(F.collect_set("key").alias("common")), "op3-common")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def unique_text(streams: DataFrame, runs: DataFrame, common: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(rid, text) of the pages of ``streams`` with open blocks, by the runs of :func:`host_runs`: without main text, the open blocks
    without the runs that the host repeats; with one of several parts, see :func:`kept_parts` and :func:`kept_main`."""
    alone = streams.where("alone").select("rid", "host", "main", "parts", "rest", "open").dropDuplicates(["rid"])

    def page_keys(batches):
        for batch in batches:
            r, h, k = [], [], []
            for rid, host, blocks, open_ in zip(*(batch.column(c).to_pylist() for c in ("rid", "host", "rest", "open"))):
                mine = [run_keys(token_hashes(x), depth) for x, o in zip(blocks, open_) if o]
                mine = np.unique(np.concatenate(mine)).tolist() if mine else []
                r += [rid] * len(mine)
                h += [host] * len(mine)
                k += mine
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(h, pa.string()), pa.array(k, pa.int64())], names=["rid", "host", "key"])

    covered = (alone.mapInArrow(page_keys, "rid long, host string, key long").join(runs, ["host", "key"], "left_semi")
               .groupBy("rid").agg(F.collect_set("key").alias("keys")))

    def strip(batches):
        for batch in batches:
            out = []
            for main, parts, blocks, open_, keys, often in zip(*(c.to_pylist() for c in batch.columns[1:])):
                known = set(keys or ())
                if main is not None:
                    out.append(main_of(main, parts, known, set(often or ()), depth))
                    continue
                left = [uncovered(x, known, depth) if known else x for x, o in zip(blocks, open_) if o]
                out.append("\n\n".join(x for x in left if x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["rid", "text"])

    return (alone.join(common, "host", "left").join(covered, "rid", "left").select("rid", "main", "parts", "rest", "open", "keys", "common")
            .mapInArrow(strip, "rid long, text string"))


def main_of(main: str, parts: list[int], known: set, common: set, depth: int) -> str:
    """Main text by the host's runs."""
    texts = main.split("\n\n")
    if common:
        stay = kept_main(texts, parts, common, depth)
        texts, parts = [t for t, k in zip(texts, stay) if k], [p for p, k in zip(parts, stay) if k]
    return "\n\n".join(kept_parts(texts, parts, known, depth) if known and parts else texts)


def extract(pages: DataFrame, depth: int = DEPTH, min_pages: int = MIN_PAGES, chunk_tokens: int = CHUNK_TOKENS, main_pages: int = MAIN_PAGES) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``, in its place."""
    rid, new, of_host = free_name(pages, "_rid"), free_name(pages, "_parsed"), free_name(pages, "_host")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    # every page is read into blocks once; all that follows starts from the written table
    read = _written(pages.withColumn(rid, F.xxhash64("page_id", "url", "html")).withColumn(new, parsed_column()(html))
                    .drop("html", *([] if "text" not in pages.columns else ["text"])), "op3-pages").withColumn(of_host, host_of(F.col("url")))
    main = F.col(f"{new}.main")
    alone = main.isNull() | (F.size(f"{new}.parts") > 0)  # with blocks that structure leaves open
    streams = read.select(F.col(rid).alias("rid"), F.col(of_host).alias("host"), main.alias("main"), F.col(f"{new}.parts").alias("parts"),
                          F.col(f"{new}.rest").alias("rest"), F.col(f"{new}.open").alias("open"), F.col(f"{new}.n").alias("n"), alone.alias("alone"), F.col(f"{new}.content").alias("content")).where("n > 0")
    runs, common = host_runs(streams, depth, min_pages, chunk_tokens, main_pages)
    judged = unique_text(streams, runs, common, depth).select(F.col("rid").alias(rid), "text")
    without = read.where(alone).join(judged, rid, "left").withColumn("text", F.coalesce("text", F.lit("")))

    @F.arrow_udf("string")
    def by_host(mains: pa.Array, often: pa.Array) -> pa.Array:
        return pa.array([main_of(m, [], set(), set(k), depth) for m, k in zip(mains.to_pylist(), often.to_pylist())], pa.string())

    one_part = read.where(~alone).withColumn("text", main)
    often = common.withColumnsRenamed({"host": of_host, "common": new})
    with_runs = one_part.drop(new).join(often, of_host).withColumn("text", by_host(F.col("text"), F.col(new)))
    cols = [c for c in pages.columns if c not in ("html", "text")] + ["text"]
    return one_part.join(often, of_host, "left_anti").select(cols).unionByName(with_runs.select(cols)).unionByName(without.select(cols))


def op3_html_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
