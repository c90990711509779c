"""HTML extraction by wrapper induction: what aligned pages of a host have in common is template, the rest content."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelane import session
from framelane.llm.common import bounded_batches
from framelane.llm.html_tree import Node, Page, Shapes, align, parse

#: A node is template if its text, and a slot if its place, is the same on this share of a layout's titles, and on this many of them.
TEMPLATE_SHARE = 0.6
TEMPLATE_TITLES = 4
#: Beside the article's region, a slot with at most this share of the main slot's text is short.
SHORT_SHARE = 0.25
#: Without an article or main element, lists of links stay inside the deepest block that holds this share of the varying text.
MAIN_SHARE = 0.6
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A table of wrappers up to this size is sent to every executor; a larger one is joined by layout and salt.
BROADCAST_BYTES = 32 << 20
SALTS = 16


@lru_cache(maxsize=256)
def _reference(source: str) -> tuple[Page, Shapes, list[int]]:
    page, shapes = parse(source), Shapes()
    return page, shapes, shapes.of(page)


def aligned(page: Page, reference: str) -> tuple[Page, list[tuple[int, int]]]:
    """Reference page, and pairs (its node, node of the page)."""
    ref, shapes, ref_shapes = _reference(reference)
    if len(shapes.label) > 50_000:
        _reference.cache_clear()
        ref, shapes, ref_shapes = _reference(reference)
    return ref, align(ref, page, shapes, ref_shapes, shapes.of(page))


def title_of(page: Page) -> str:
    """What tells pages apart: the first heading, else the title, else all text."""
    for tag in ("h1", "title"):
        for node in page.nodes:
            if node.tag == tag and node.text:
                return " ".join(node.text)
    return " ".join(t for _, t, _ in page.segments)


def left_out(page: Page, template: set[int], slots: set[int]) -> tuple[list[bool], list[bool]]:
    """Per node, whether it is left out everywhere, and outside the article.

    Names, forms and fieldsets leave nothing out that holds most of the unlinked varying
    text, or the only article or main element. An article or main element is judged by its
    own name as well, and one inside a wrapper that is left out, beside others, goes with it.
    """
    nodes = page.nodes
    bad, outer = [x.bad for x in nodes], [x.outer for x in nodes]
    for k in range(1, len(nodes)):
        bad[k] = bad[k] or bad[nodes[k].parent] or k in slots
    weight, mains = [0] * len(nodes), [0] * len(nodes)
    for k, text, linked in page.segments:
        if not bad[k] and k not in template:
            weight[k] += max(0, len(text) - linked)
    for k in range(len(nodes) - 1, 0, -1):
        mains[k] += nodes[k].tag in ("article", "main") and not bad[k] and not nodes[k].named
        weight[nodes[k].parent] += weight[k]
        mains[nodes[k].parent] += mains[k]
    for k in range(1, len(nodes)):
        x = nodes[k]
        kept = 2 * weight[k] > weight[0] or mains[k] and mains[k] == mains[0]
        if not kept:
            bad[k], outer[k] = bad[k] or x.named, outer[k] or x.outer_named
        bad[k], outer[k] = bad[k] or bad[x.parent], outer[k] or outer[x.parent]
    return bad, outer


def content(page: Page, template: set[int], slots: set[int] = frozenset()) -> list[str]:
    """Blocks of the main text in page order.

    Text of ``template`` nodes and all inside ``slots`` (see :func:`wrapper`) is out. Beyond that menus, footers, forms, adverts and the like are known by element, role and name. Content is what
    the articles hold if that is most of the unlinked text that is left, else what the
    main element holds, on the same terms, else every block that varies; outside the
    deepest one with MAIN_SHARE of that text those that are mostly links, headings
    aside, are dropped.
    """
    nodes = page.nodes
    bad, outer = left_out(page, template, slots)
    keep = [s for s in page.segments if not bad[s[0]] and s[0] not in template]
    weight = [0] * len(nodes)
    for k, text, linked in keep:
        weight[k] += 0 if outer[k] else max(0, len(text) - linked)
    for k in range(len(nodes) - 1, 0, -1):
        weight[nodes[k].parent] += weight[k]
    for tag in ("article", "main"):
        inside = [False] * len(nodes)
        for k in range(1, len(nodes)):
            inside[k] = inside[nodes[k].parent] or nodes[k].tag == tag and not bad[k]
        held = sum(weight[k] for k in range(1, len(nodes)) if inside[k] and not inside[nodes[k].parent])
        if any(inside) and 2 * held >= weight[0]:
            return [t for k, t, _ in keep if inside[k]]
    keep = [s for s in keep if not outer[s[0]]]
    root = 0
    while weight[0]:
        deeper = [c for c in nodes[root].children if weight[c] >= MAIN_SHARE * weight[0] and nodes[c].children]
        if not deeper:
            break
        root = deeper[0]
    inside = [False] * len(nodes)
    inside[root] = True
    for k in range(1, len(nodes)):
        inside[k] = inside[k] or inside[nodes[k].parent]
    return [t for k, t, linked in keep if inside[k] or 2 * linked <= len(t) or nodes[k].tag in HEADINGS]


def observe(page: Page, ref: Page, pairs: list[tuple[int, int]]) -> list[tuple[int, int, bool, int, int, bool]]:
    """(reference node, node, same text, characters, linked characters, holds the title) of every aligned node.

    Text of nodes that nothing is aligned with counts for the nearest ancestor that is.
    """
    at = {k: r for r, k in pairs}
    for k in range(1, len(page.nodes)):
        at.setdefault(k, at[page.nodes[k].parent])
    title = title_of(page)
    chars, linked, titled = {}, {}, set()
    for k, text, links in page.segments:
        r = at[k]
        chars[r] = chars.get(r, 0) + len(text)
        linked[r] = linked.get(r, 0) + links
        if text == title and page.nodes[k].tag != "title":
            titled.add(r)
    return [
        (r, k, bool(ref.nodes[r].text) and ref.nodes[r].text == page.nodes[k].text, chars.get(r, 0), linked.get(r, 0), r in titled) for r, k in pairs
    ]


def wrapper(ref: Page, found: dict[int, tuple[int, int, int, int, int]], titles: int) -> tuple[list[int], list[int]]:
    """Template of one layout: nodes whose text is constant, and slots that are template whatever their text.

    ``found`` has per reference node the number of titles with it, with the same text, its characters,
    linked ones, and titles it held. The main slot is the deepest block, no deeper than an article or main
    element, with MAIN_SHARE of the unlinked text of all pages; together with the slot of the titles it
    spans the article's region. A slot beside that region is template if it is on TEMPLATE_SHARE of the
    titles and mostly links, or short against the main slot: menus, adverts, notices and
    footers change their words from page to page but keep their place and size. Inside the
    region only slots of links are.
    """
    nodes, n = ref.nodes, len(ref.nodes)
    blank = (0, 0, 0, 0, 0)
    often = [found.get(r, blank)[0] >= max(TEMPLATE_TITLES, TEMPLATE_SHARE * titles) for r in range(n)]
    constant = [r for r in range(n) if found.get(r, blank)[1] >= max(TEMPLATE_TITLES, TEMPLATE_SHARE * titles)]
    chars, linked, titled = ([found.get(r, blank)[i] for r in range(n)] for i in (2, 3, 4))
    bad = [x.bad for x in nodes]
    weight = [0] * n
    for r in range(n):
        bad[r] = bad[r] or r > 0 and bad[nodes[r].parent]
        weight[r] = 0 if bad[r] else chars[r] - linked[r]
    for r in range(n - 1, 0, -1):
        up = nodes[r].parent
        weight[up], chars[up], linked[up], titled[up] = weight[up] + weight[r], chars[up] + chars[r], linked[up] + linked[r], titled[up] + titled[r]
    if not weight[0]:
        return constant, []
    path = [0]
    while nodes[path[-1]].tag not in ("article", "main"):
        deeper = [c for c in nodes[path[-1]].children if weight[c] >= MAIN_SHARE * weight[0] and nodes[c].children]
        if not deeper:
            break
        path.append(deeper[0])
    usual = weight[path[-1]] / titles
    region = len(path) - 1
    if titled[0]:  # up to the deepest ancestor that holds the title on most pages that show it
        while region and 2 * titled[path[region]] <= titled[0]:
            region -= 1
    slots = []
    for depth, r in enumerate(path[:-1]):
        for c in nodes[r].children:
            if c == path[depth + 1] or not often[c] or nodes[c].tag in HEADINGS or 2 * titled[c] > titles:
                continue
            links = 2 * linked[c] > chars[c]
            short = depth < region and chars[c] / found[c][0] <= SHORT_SHARE * usual
            if links or short:
                slots.append(c)
    return constant, slots


#: What a page keeps for its second reading: elements that content asks for by name, and the judgements of a node as bits.
_ASKED = ("article", "main", "html", "body", *sorted(HEADINGS))
_SEEN = (("node", pa.int32()), ("k", pa.int32()), ("same", pa.bool_()), ("chars", pa.int64()), ("linked", pa.int64()), ("titled", pa.bool_()))
_READ = (
    "title string, parents array<int>, marks array<int>, at array<int>, texts array<string>, links array<int>, "
    "seen array<struct<node:int,k:int,same:boolean,chars:bigint,linked:bigint,titled:boolean>>"
)


def packed(page: Page) -> tuple[list[int], list[int], list[int], list[str], list[int]]:
    """Parents and marks of the nodes; node, text and linked characters of the segments."""
    number = {t: i + 1 for i, t in enumerate(_ASKED)}
    marks = [number.get(x.tag, 0) << 4 | x.bad | x.named << 1 | x.outer << 2 | x.outer_named << 3 for x in page.nodes]
    at, texts, links = zip(*page.segments) if page.segments else ((), (), ())
    return [x.parent for x in page.nodes], marks, list(at), list(texts), list(links)


def unpacked(parents: list[int], marks: list[int], at: list[int], texts: list[str], links: list[int]) -> Page:
    tags = ("", *_ASKED)
    nodes = [Node(tags[m >> 4], "", p, bool(m & 1), bool(m & 2), bool(m & 4), bool(m & 8)) for p, m in zip(parents, marks)]
    for k in range(1, len(nodes)):
        nodes[parents[k]].children.append(k)
    return Page(nodes, list(zip(at, texts, links)))


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page parsed and aligned once: what its nodes show of the reference, and what its text is chosen from."""
    ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())
    for b in batches:
        rows, seen, ends = [], [], [0]
        for source, reference in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
            page = parse(source)
            rows.append((title_of(page), *packed(page)))
            if reference is not None:
                ref, pairs = aligned(page, reference)
                seen += observe(page, ref, pairs)
            ends.append(len(seen))
        columns = list(zip(*rows)) if rows else [[]] * 6
        shown = zip(*seen) if seen else [()] * len(_SEEN)
        structs = pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(shown, _SEEN)], [f for f, _ in _SEEN])
        yield pa.RecordBatch.from_arrays(
            [*[b.column(k) for k in range(4)], *[pa.array(c, k) for c, k in zip(columns, (pa.string(), ints, ints, ints, strings, ints))],
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)],
            names=["id", "url", "layout", "votes", "title", "parents", "marks", "at", "texts", "links", "seen"],
        )


def _wrapper_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for layout, reference, titles, found in zip(*[c.to_pylist() for c in b.columns]):
            constant, slots = wrapper(parse(reference), {x["node"]: (x["titles"], x["same"], x["chars"], x["linked"], x["titled"]) for x in found}, titles)
            if constant or slots:
                rows.append((layout, constant, slots))
        kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        columns = zip(*rows) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["layout", "constant", "slots"])


def _content_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen = b.column(7)
        flat, sizes = seen.flatten(), seen.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        node, own, same = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("node", "k", "same"))
        ends = np.cumsum(sizes)
        texts = []
        for i, (parents, marks, at, parts, links, constant, slots) in enumerate(zip(*[b.column(k).to_pylist() for k in (2, 3, 4, 5, 6, 8, 9)])):
            template, closed = set(), set()
            if constant is not None:
                mine = slice(ends[i] - sizes[i], ends[i])
                template = set(own[mine][same[mine] & np.isin(node[mine], constant)].tolist())
                closed = set(own[mine][np.isin(node[mine], slots)].tolist())
            texts.append("\n\n".join(content(unpacked(parents, marks, at, parts, links), template, closed)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def _with_layout(pages: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """Pages next to the row of their layout: by broadcast if its size is known to be small, else by layout and salt."""
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(table), "layout", "left")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["layout", "salt"], "left").drop("salt")


def _size(table: DataFrame, numbers: Column) -> int:
    return table.agg(F.coalesce(F.sum(numbers + F.octet_length("layout") + F.lit(64)), F.lit(0))).first()[0]


def layout_of(host: Column, source: Column) -> Column:
    """Host, and which sectioning elements the page uses: pages of one layout are aligned with one reference."""
    sections = F.regexp_extract_all(F.lower(source), F.lit(r"<(main|article|section|aside|nav|header|footer)[\s>]"), F.lit(1))
    return F.when(host != "", F.concat_ws(" ", host, F.array_join(F.array_sort(F.array_distinct(sections)), " ")))


def references(pages: DataFrame) -> DataFrame:
    """``pages(id, host, layout, source)`` to (layout, owner, votes, reference): whose reference page a layout is read with.

    The reference of a layout is its page with the smallest id; layouts with fewer than
    TEMPLATE_TITLES pages are read with that of their host's largest one, without a vote.
    """
    refs = pages.where("layout is not null").groupBy("host", "layout").agg(F.min_by("source", "id").alias("reference"), F.count("*").alias("n"))
    refs = session.cut(refs)
    large = refs.where(f"n >= {TEMPLATE_TITLES} and reference is not null")
    best = large.groupBy("host").agg(F.max_by(F.struct("layout", "reference"), F.struct("n", "layout")).alias("best"))
    lent = refs.where(f"n < {TEMPLATE_TITLES}").join(best, "host").select("layout", F.col("best.layout").alias("owner"), F.lit(False).alias("votes"), F.col("best.reference").alias("reference"))
    return session.cut(large.select("layout", F.col("layout").alias("owner"), F.lit(True).alias("votes"), "reference").unionByName(lent))


def induce(read: DataFrame, table: DataFrame) -> DataFrame:
    """Pages read with their references to (layout, constant, slots) of every owner of a reference.

    What nodes show is added up over titles (copies of one page share their title, so they
    do not make an article a template); :func:`wrapper` decides from the sums.
    """
    rows = read.where("votes").select("layout", F.unhex(F.md5("title")).alias("title"), "seen")
    titles = rows.select("layout", "title").distinct().groupBy("layout").agg(F.count("*").alias("titles"))
    once = rows.select("layout", "title", F.inline("seen")).groupBy("layout", "title", "node").agg(
        F.max("same").alias("same"), F.max("chars").alias("chars"), F.max("linked").alias("linked"), F.max("titled").alias("titled")
    )
    nodes = once.groupBy("layout", "node").agg(
        F.count("*").alias("titles"), F.count_if("same").alias("same"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.count_if("titled").alias("titled")
    )
    found = nodes.groupBy("layout").agg(F.collect_list(F.struct("node", "titles", "same", "chars", "linked", "titled")).alias("found"))
    known = table.where("votes").join(titles.where(f"titles >= {TEMPLATE_TITLES}"), "layout").join(found, "layout").select("layout", "reference", "titles", "found")
    return session.cut(known.mapInArrow(_wrapper_batches, "layout string, constant array<int>, slots array<int>"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """key, url, text for every row: blocks of the main text in page order, joined by an empty line.

    Every page is parsed and aligned with its layout's reference once, and kept as blocks; when
    the wrappers are induced from what all pages show, the text is chosen from these.
    Null or empty html, and pages of template only, give the empty text. Pages without a
    host (null or odd url), and hosts with fewer than TEMPLATE_TITLES titles, are judged by
    their own markup alone. Repeated rows repeat their answer; a null key never names a
    reference while others exist. Empty tables give empty tables; other columns are not read.
    """
    bounded_batches(pages.sparkSession, rows=256)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(source), F.lit("")).alias("source"), host.alias("host"))
    rows = rows.withColumn("layout", layout_of(F.col("host"), F.col("source")))
    table = references(rows.select("id", "host", "layout", "source"))
    own = pages.schema[key].dataType.simpleString()
    read = _with_layout(rows.select("id", "url", "layout", "source"), table, _size(table, F.octet_length("reference")))
    read = read.select("id", "url", F.col("owner").alias("layout"), "votes", "source", "reference")
    read = session.cut(read.mapInArrow(_read_batches, f"id {own}, url string, layout string, votes boolean, {_READ}"), "zstd")
    wrappers = induce(read, table)
    out = _with_layout(read, wrappers, _size(wrappers, 4 * F.size("constant") + 4 * F.size("slots")))
    out = out.select("id", "url", "parents", "marks", "at", "texts", "links", "seen", "constant", "slots").mapInArrow(_content_batches, f"id {own}, url string, text string")
    return out.withColumnRenamed("id", key)


def digest(found: DataFrame) -> DataFrame:
    return found.withColumn("n_chars", F.length("text").cast("long"))
