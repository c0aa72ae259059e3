"""Main text of web pages by wrappers inferred per host.

A page is a stream of block tags and text slots.  Repeats that follow each other fold into a
repeated group.  The streams of one host are aligned one after the other into a union-free
expression: what both have stays, a group that one lacks becomes optional, a group that one
repeats becomes repeated, and texts become slots.  A slot whose text never changes is part of
the template.  The wrapper's main region is the innermost element that holds nearly all other
text outside menus, headers, footers, adverts, forms and comments, or the article around it; its
slots and all others that change, in page order, are the page's text.

Pages of a host are many, their different streams few: streams are folded and counted before
they are aligned, and aligned in salted parts before the parts are.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import free_name, record_batch

SALTS = 16
REGION_SHARE = 0.8
# a slot is template text if this many texts or more are all the same
CONSTANT_TEXTS = 3
# rules of all hosts go to every task only up to this many bytes; a larger table is joined
BROADCAST_BYTES = 8 << 20
# fixed values: element kinds
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|svg|textarea|iframe|select|button"
DROPPED = frozenset("head nav header footer aside form menu dialog fieldset".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# never boilerplate by their names
FRAME = frozenset("html body main article".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer header login masthead menu modal nav navbar navigation newsletter notice popup promo related search share sidebar skip social sponsor sponsored subscribe toolbar widget complementary contentinfo".split()
)
MARKUP = re.compile(
    rf"(?is)<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>]*/>|.*?(?:</\1\s*>|\Z))|</?([a-z][a-z0-9:-]*)((?:\"[^\"<>]*\"|'[^'<>]*'|[^'\"<>])*)(?:>|\Z)|</?([a-z][a-z0-9:-]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</?\Z"
)
ATTRIBUTE = re.compile(r"""(?is)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
STATS = "host string, path string, n bigint, chars bigint, low bigint, high bigint"
SHAPES = "host string, shape string"


def blocks(page: str) -> tuple[list[str], list[tuple[str, str]]]:
    """The stream of block tags and slots (``#``), and ``(path, text)`` of every slot in page order.

    Elements that are open at the end, or closed by a later tag, are closed in the stream.  A path
    lists the open block elements; one that is boilerplate by its kind or names has a ``!``.  Names
    alone do not mark the elements of a page's frame, see ``_unmarked``.
    """
    stream: list[str] = []
    found: list[tuple[list[tuple[str, bool, int]], str]] = []
    stack: list[tuple[str, bool, int]] = []  # kind, boilerplate by kind, number if by names only (else 0)
    held: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            stream.append("#")
            found.append((stack[:], text))

    def close(upto: int) -> None:
        while len(stack) > upto:
            stream.append(f"</{stack.pop()[0]}>")

    at = named = 0
    for tag in MARKUP.finditer(page):
        held.append(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[4] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == "br":
                held.append(" ")
            continue
        flush()
        names = [n for n, _, _ in stack]
        if tag[0].startswith("</"):
            if name in names:
                close(len(names) - 1 - names[::-1].index(name))
            continue
        if name in VOID:
            continue
        if name in CLOSES_P and names and names[-1] == "p":
            close(len(stack) - 1)
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and names and names[-1] in (name, "p"):
            close(len(stack) - 1)
        words = {w for m in ATTRIBUTE.finditer(tag[3] or tag[5] or "") for w in re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower())}
        inside = any(n in ("article", "main") for n in names)
        bad = name in DROPPED and not (name == "header" and inside)
        named += (by_name := not bad and name not in FRAME and bool(words & BOILERPLATE_WORDS))
        stack.append((name, bad, named if by_name else 0))
        stream.append(f"<{name}>")
    held.append(page[at:])
    flush()
    close(0)
    free = _unmarked(found) if named else set()
    return stream, [("/".join(f"{n}!" if bad or (no and no not in free) else n for n, bad, no in path), text) for path, text in found]


def _unmarked(found: list[tuple[list[tuple[str, bool, int]], str]]) -> set[int]:
    """Numbers of elements that names mark wrongly: outermost first, those that hold more than half of the text
    while no article or main is left outside marked ones; all, if else no text is left.
    """
    slots = [({no for _, _, no in path if no}, any(n in ("article", "main") for n, _, _ in path), len(text)) for path, text in found if not any(bad for _, bad, _ in path)]
    held: dict[int, int] = {}
    for marks, _, size in slots:
        for no in marks:
            held[no] = held.get(no, 0) + size
    total, free = sum(size for _, _, size in slots), set()
    for no in sorted(n for n, size in held.items() if 2 * size > total):
        if any(main and marks <= free for marks, main, _ in slots):
            break
        free.add(no)
    return free if any(marks <= free for marks, _, _ in slots) else set(held)


# --- union-free expressions: items are tags, "#", ["+", items] or ["?", items] ----------------------------------


def fold(items: list) -> list:
    """Replace groups that follow each other by one repeated group, small groups first."""
    size = 1
    while size <= len(items) // 2:
        out, at = [], 0
        while at < len(items):
            group = items[at : at + size]
            times = 1
            while len(group) == size and items[at + times * size : at + (times + 1) * size] == group:
                times += 1
            after = items[at + times * size : at + times * size + 1]
            if times > 1 and _balanced(group):
                out.append(group[0] if size == 1 and isinstance(group[0], list) and group[0][0] == "+" else ["+", group])
                at += times * size
            elif size == 1 and isinstance(items[at], list) and after == [items[at]]:
                at += 1
            else:
                out.append(items[at])
                at += 1
        size = size + 1 if len(out) == len(items) else 1
        items = out
        if size > 64:
            break
    return items


def _balanced(group: list) -> bool:
    depth = 0
    for item in group:
        if isinstance(item, str) and item != "#":
            depth += -1 if item.startswith("</") else 1
            if depth < 0:
                return False
    return depth == 0


def _core(item) -> list:
    """The items that a repeated or optional group stands for."""
    return _core(item[1][0]) if isinstance(item, list) and len(item[1]) == 1 and isinstance(item[1][0], list) else item[1] if isinstance(item, list) else [item]


def _elements(items: list) -> list:
    """Cut a stream into whole elements, slots and groups."""
    out, held, depth = [], [], 0
    for item in items:
        if isinstance(item, str) and item != "#":
            held.append(item)
            depth += -1 if item.startswith("</") else 1
            if depth == 0:
                out.append(held)
                held = []
        elif depth:
            held.append(item)
        else:
            out.append([item])
    return out + ([held] if held else [])


def align(a: list, b: list) -> list:
    """One expression for two: common elements are aligned inside, others become optional or repeated."""
    if a == b:
        return a
    left, right = _elements(a), _elements(b)
    n, m = len(left), len(right)
    score = np.zeros((n + 1, m + 1), dtype=np.int64)
    keys_l, keys_r = [_key(x) for x in left], [_key(y) for y in right]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            same = score[i + 1, j + 1] + 1 if keys_l[i] == keys_r[j] else -1
            score[i, j] = max(same, score[i + 1, j], score[i, j + 1])
    out: list = []
    i = j = 0
    while i < n and j < m:
        if keys_l[i] == keys_r[j] and score[i, j] == score[i + 1, j + 1] + 1:
            out += _merge(left[i], right[j])
            i, j = i + 1, j + 1
        elif score[i + 1, j] >= score[i, j + 1]:
            out.append(_optional(left[i]))
            i += 1
        else:
            out.append(_optional(right[j]))
            j += 1
    out += [_optional(x) for x in left[i:] + right[j:]]
    return _absorb(out)


def _key(element: list) -> str:
    first = element[0]
    return _key(_core(first)) if isinstance(first, list) else first


def _optional(element: list) -> list:
    return element[0] if len(element) == 1 and isinstance(element[0], list) and element[0][0] == "?" else ["?", element]


def _merge(x: list, y: list) -> list:
    kinds = {i[0] for i in (x[0], y[0]) if isinstance(i, list)}
    inner_x, inner_y = (_core(i[0]) if isinstance(i[0], list) else i for i in (x, y))
    if inner_x == inner_y:
        body = inner_x
    elif isinstance(inner_x[0], str) and inner_x[0].startswith("<") and inner_x[0] == inner_y[0] and len(inner_x) > 1 and len(inner_y) > 1 and inner_x[-1] == inner_y[-1] and len(_elements(inner_x)) == len(_elements(inner_y)) == 1:
        body = [inner_x[0], *align(inner_x[1:-1], inner_y[1:-1]), inner_x[-1]]
    else:
        body = align(inner_x, inner_y) if kinds else inner_x
    if "+" in kinds:
        body = [["+", body]]
    if "?" in kinds:
        body = [["?", body]]
    return body


def _absorb(items: list) -> list:
    """Neighbours of one kind, one of them a group, are one repeated group."""
    out: list = []
    for element in _elements(items):
        if out and _key(out[-1]) == _key(element) != "#" and (isinstance(element[0], list) or isinstance(out[-1][0], list)):
            inner = [_core(e[0]) if isinstance(e[0], list) else e for e in (out[-1], element)]
            body = _merge(inner[0], inner[1])
            needed = any(not isinstance(e[0], list) or e[0][0] == "+" for e in (out[-1], element))
            out[-1] = [["+", body]] if needed else [["?", [["+", body]]]]
        else:
            out.append(element)
    return [item for element in out for item in element]


def expression(items: list) -> str:
    """The wrapper as text: ``#`` slots, ``( )+`` repeated and ``( )?`` optional groups."""
    return " ".join(i if isinstance(i, str) else f"( {expression(i[1])} ){i[0]}" for i in items)


def region(stats: list[tuple[str, int, int, bool]], wrapper: list) -> tuple[str, list[str]]:
    """Main region of a host (a path) and the paths whose text is template.

    ``stats`` has path, texts, characters and whether the text never changed.
    """
    constant = sorted(path for path, _, _, same in stats if same)
    weight: dict[str, int] = {}
    some = any(not same and "!" not in path for path, _, _, same in stats)
    for path, _, chars, same in stats:
        if (same and some) or "!" in path:  # a host of copies of one page has nothing but constant slots
            continue
        parts = path.split("/")
        for k in range(len(parts) + 1):
            prefix = "/".join(parts[:k])
            weight[prefix] = weight.get(prefix, 0) + chars
    if not weight:
        return "", constant
    total, containers = weight[""], _containers(wrapper)
    whole = [p for p, w in weight.items() if w >= REGION_SHARE * total and (p == "" or p in containers)]
    deepest = max(whole, key=lambda p: (p.count("/") + bool(p), p)).split("/")
    # all of an article belongs to it, also a title beside the element that holds its body
    outer = next((k for k, name in enumerate(deepest, 1) if name in ("article", "main")), len(deepest))
    return "/".join(deepest[:outer]), constant


def _containers(wrapper: list) -> set[str]:
    """Paths of elements that hold several blocks or a repeated group: a single block is no region."""
    found: set[str] = set()

    def walk(items: list, stack: list[str]) -> int:
        held = 0
        depth: list[int] = []
        for item in items:
            if isinstance(item, list):
                n = walk(item[1], stack) * (2 if item[0] == "+" else 1)
                held += n
            elif item == "#":
                held += 1
            elif item.startswith("</"):
                if depth:
                    before = depth.pop()
                    if held > 1 or "article" in stack[-1:] or "main" in stack[-1:]:
                        found.add("/".join(stack))
                    stack.pop()
                    held += before
            else:
                depth.append(held)
                held = 0
                stack.append(item[1:-1])
        return held

    walk(wrapper, [])
    return found


def main_text(page: str, rule: tuple[str, list[str]] | None) -> str:
    """Blocks of the host's main region, and all other text that is neither boilerplate nor template."""
    _, found = blocks(page)
    good = [(path, text) for path, text in found if "!" not in path]
    if rule:
        where, constant = rule
        good = [(p, t) for p, t in good if not where or p == where or p.startswith(f"{where}/") or p not in constant]
    else:
        for mark in ("article", "main"):
            here = [(p, t) for p, t in good if mark in p.split("/")]
            if here:
                good = here
                break
    return "\n".join(text for _, text in good)


# --- Spark ---------------------------------------------------------------------------------------------------


def host_of(url):
    """Host of a URL, without ``www.``; empty if there is none."""
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/:?#]*)", 1)
    return F.regexp_replace(found, r"^www\.", "")


def _texts(pages: DataFrame) -> DataFrame:
    return pages.select(host_of(F.col("url").cast("string")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def infer(pages: DataFrame, salts: int = SALTS) -> DataFrame:
    """``host, wrapper``: the aligned expression of every host (JSON)."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(h, json.dumps(fold(blocks(t)[0]))) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
            yield record_batch(SHAPES, [list(c) for c in zip(*sorted(found))] if found else [[], []])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, held = None, None  # rows come sorted by host, so one wrapper is held at a time
        for batch in batches:
            done: list[tuple[str, str]] = []
            for h, shape in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h != host:
                    if host is not None:
                        done.append((host, json.dumps(held)))
                    host, held = h, json.loads(shape)
                else:
                    held = fold(align(held, json.loads(shape)))
            if done:
                yield record_batch(SHAPES, [list(c) for c in zip(*done)])
        if host is not None:
            yield record_batch(SHAPES, [[host], [json.dumps(held)]])

    salt = F.pmod(F.xxhash64("shape"), F.lit(salts))
    distinct = _texts(pages).mapInArrow(shapes, SHAPES).distinct().withColumn("salt", salt)
    parts = distinct.repartition("host", "salt").sortWithinPartitions("host", "salt", "shape").select("host", "shape").mapInArrow(merge, SHAPES)
    whole = parts.repartition("host").sortWithinPartitions("host", "shape").mapInArrow(merge, SHAPES)
    return whole.withColumnRenamed("shape", "wrapper")


def slots(pages: DataFrame) -> DataFrame:
    """``host, path, n, chars, constant``: what each slot of a host holds, over all its pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple[str, str], list[int]] = {}
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for path, text in blocks(t)[1]:
                    key = xxhash.xxh3_64_intdigest(text) >> 1
                    row = held.setdefault((h, path), [0, 0, key, key])
                    row[0] += 1
                    row[1] += len(text)
                    row[2], row[3] = min(row[2], key), max(row[3], key)
            yield record_batch(STATS, [[k[0] for k in held], [k[1] for k in held], *([v[i] for v in held.values()] for i in range(4))])

    total = _texts(pages).mapInArrow(count, STATS).groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.min("low").alias("low"), F.max("high").alias("high"))
    return total.select("host", "path", "n", "chars", ((F.col("low") == F.col("high")) & (F.col("n") >= CONSTANT_TEXTS)).alias("constant"))


def rules(pages: DataFrame) -> DataFrame:
    """``host, wrapper, region, template``: one row per host."""
    # a host has one row per different path, so these lists are as long as its wrapper
    by_host = slots(pages).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("path", "n", "chars", "constant"))).alias("stats"))

    @F.arrow_udf("struct<region: string, template: array<string>>")
    def choose(stats: pa.Array, wrapper: pa.Array) -> pa.Array:
        out = []
        for rows, w in zip(stats.to_pylist(), wrapper.to_pylist()):
            where, constant = region([(r["path"], r["n"], r["chars"], r["constant"]) for r in rows], json.loads(w))
            out.append({"region": where, "template": constant})
        return pa.array(out, pa.struct([("region", pa.string()), ("template", pa.list_(pa.string()))]))

    chosen = infer(pages).join(by_host, "host").withColumn("r", choose("stats", "wrapper"))
    return cut_lineage(chosen.select("host", "wrapper", "r.region", "r.template"))


def extract(pages: DataFrame, into: str = "text") -> DataFrame:
    """``pages(url, html)`` with ``into``, the main text; one row in, one row out.

    Null and empty pages, and pages without text outside boilerplate, have the empty text.
    """
    own, host, rule_ = (free_name(pages, c) for c in ("_page_host", "_host", "_rule"))
    found = rules(pages).select(F.col("host").alias(host), F.struct("region", "template").alias(rule_))
    size = found.agg(F.sum(F.length(host) + F.length(F.col(rule_)["region"]) + F.length(F.array_join(F.col(rule_)["template"], " ")) + 64)).first()[0] or 0
    joined = pages.withColumn(own, host_of(F.col("url").cast("string")))
    other = F.broadcast(found) if size <= BROADCAST_BYTES else found
    joined = joined.join(other, F.col(own) == F.col(host), "left")

    @F.arrow_udf("string")
    def text(page: pa.Array, rule: pa.Array) -> pa.Array:
        return pa.array([main_text(p or "", (r["region"], r["template"]) if r else None) for p, r in zip(page.to_pylist(), rule.to_pylist())], pa.string())

    return joined.select(*[c for c in pages.columns if c != into], text(F.col("html").cast("string"), F.col(rule_)).alias(into))
