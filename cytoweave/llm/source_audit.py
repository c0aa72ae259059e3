"""How far the sources of a language use its frequent terms differently.

First pass: in how many documents of its language every term occurs, counted exactly; terms below the
limit go.  What stays is cut into shards by hash, a minimal perfect hash is built per shard, and
the shards are dealt to blocks of bounded size.  Second pass, once per block: the block is broadcast, the words of
a batch find their slots (a stored key tells a kept term from any other word), and counts are added to
dense arrays, one per (language, source).  Shares are compared per shard, source tile against source tile.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .common import rewritten, slices
from .perfect_hash import KEYS_PER_SHARD, Hashes, build, hashes, shard_of

# ASCII letters and all bytes from 0x80 on belong to terms
_TO_SPACE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
HELD_TERMS = 500_000  # distinct terms that a task of the first pass counts before it lets go of them
HELD_SLOTS = 8 << 20  # counters that a task of the second pass holds
BLOCK_BYTES = 32 << 20  # keys and displacements that are broadcast at once
SOURCES_PER_TILE = 64
SCALE = 1_000_000_000


def prepared(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a text column in order, and the row each one is in."""
    column = rewritten(column, _TO_SPACE)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[: len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    inside = data != 0x20
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[bounds] = inside[bounds]
    ends[:-1] &= ~inside[1:]
    ends[bounds - 1] = inside[bounds - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    flat = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(flat), pa.py_buffer(data[inside])])
    return found, np.searchsorted(offsets, starts, side="right") - 1


def coded(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values and the code of every row."""
    encoded = column.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``(lang, term, n_docs)``: exact, for every term of every text."""

    def flush(held: dict[str, Counter]):
        for lang, counter in held.items():
            terms = pa.array(list(counter), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), terms, pa.array(list(counter.values()), pa.int64())], ["lang", "term", "n"])

    def count(batches):
        held: dict[str, Counter] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                found, row = words(part.column("text"))
                terms, code = coded(found)
                names, lang = coded(part.column("lang"))
                if not len(terms):
                    continue
                once = np.unique(row * len(terms) + code)
                key, n = np.unique(lang[once // len(terms)].astype(np.int64) * len(terms) + once % len(terms), return_counts=True)
                terms, names = terms.to_pylist(), names.to_pylist()
                for k, m in zip(key.tolist(), n.tolist()):
                    name = names[k // len(terms)]
                    if name not in held:
                        held[name] = Counter()
                    held[name][terms[k % len(terms)]] += m
                if sum(map(len, held.values())) > HELD_TERMS:
                    yield from flush(held)
                    held.clear()
        yield from flush(held)

    partial = docs.select("lang", "text").mapInArrow(count, "lang string, term string, n bigint")
    return partial.groupBy("lang", "term").agg(F.sum("n").alias("n_docs"))


def shards(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(lang, shard, shards, size, displacements, lengths, keys)``: the perfect hash of every shard of ``kept(lang, term)``.

    ``sizes(lang, v)``.  Shards are dealt by a keyed hash, so they hold about ``KEYS_PER_SHARD`` keys each.
    """

    def number(batches):
        for batch in batches:
            h = hashes(batch.column("term").cast(pa.binary()).to_pylist())
            n = batch.column("n").to_numpy(zero_copy_only=False)
            at = np.zeros(len(h), dtype=np.int32)
            for value in np.unique(n):
                at[n == value] = shard_of(h[n == value], int(value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], ["lang", "term", "n", "shard"])

    n = F.greatest(F.ceil(F.col("v") / KEYS_PER_SHARD), F.lit(1)).cast("int")
    placed = kept.join(sizes.select("lang", n.alias("n")), "lang").select("lang", "term", "n").mapInArrow(number, "lang string, term string, n int, shard int")

    def hashed(table: pa.Table) -> pa.Table:
        keys = sorted(table.column("term").cast(pa.binary()).to_pylist())
        displacement, slot = build(keys)
        ordered = [b""] * len(keys)
        for k, s in zip(keys, slot.tolist()):
            ordered[s] = k
        lengths = np.array([len(k) for k in ordered], dtype=np.int32)
        one = {"lang": [table.column("lang")[0].as_py()], "shard": [table.column("shard")[0].as_py()], "shards": [table.column("n")[0].as_py()], "size": [len(keys)]}
        one |= {"displacements": [displacement.tobytes()], "lengths": [lengths.tobytes()], "keys": [b"".join(ordered)]}
        return pa.table(one, schema=pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("shards", pa.int32()), ("size", pa.int32()), ("displacements", pa.binary()), ("lengths", pa.binary()), ("keys", pa.binary())]))

    return placed.groupBy("lang", "shard").applyInArrow(hashed, "lang string, shard int, shards int, size int, displacements binary, lengths binary, keys binary")


def loaded(rows) -> dict[str, Hashes]:
    """The broadcast form of some shards: one :class:`Hashes` per language."""
    found = {}
    for lang in sorted({r["lang"] for r in rows}):
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: r["shard"])
        lengths = np.concatenate([np.frombuffer(r["lengths"], dtype=np.int32) for r in own]).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        keys = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(bytes(r["keys"]) for r in own))])
        number = np.array([r["shard"] for r in own], dtype=np.int64)
        size = np.array([r["size"] for r in own], dtype=np.int64)
        found[lang] = Hashes(own[0]["shards"], number, size, [np.frombuffer(r["displacements"], dtype=np.int32) for r in own], keys)
    return found


def recount(docs: DataFrame, block) -> DataFrame:
    """``(lang, source, shard, slot, n)`` of the kept terms of one broadcast block; partial counts of the tasks, to be summed."""
    schema = "lang string, source string, shard int, slots array<int>, counts array<bigint>"

    def flush(held, tables):
        for (lang, source), dense in held.items():
            at = np.flatnonzero(dense)
            if not len(at):
                continue
            shard, slot = tables[lang].address(at)
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            offsets = pa.array(np.append(first, len(at)).astype(np.int32))
            m = len(first)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(slot.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(dense[at]))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array([source] * m), pa.array(shard[first].astype(np.int32)), *lists], ["lang", "source", "shard", "slots", "counts"])

    def count(batches):
        tables: dict[str, Hashes] = block.value
        held: dict[tuple[str, str], np.ndarray] = {}
        taken = 0
        for batch in batches:
            for part in slices(batch, "text"):
                found, row = words(part.column("text"))
                terms, code = coded(found)
                if not len(terms):
                    continue
                h = hashes(terms.to_pylist())
                langs, lang = coded(part.column("lang"))
                sources, source = coded(part.column("source"))
                langs, sources = langs.to_pylist(), sources.to_pylist()
                lang_of = lang[row]
                for i, name in enumerate(langs):
                    if name not in tables:
                        continue
                    slot = tables[name].find(terms, h)[code]
                    mine = np.flatnonzero((lang_of == i) & (slot >= 0))
                    width = len(tables[name])
                    key, n = np.unique(source[row[mine]].astype(np.int64) * width + slot[mine], return_counts=True)
                    which = key // width
                    cut = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(key) else []
                    for a, b in zip(cut, [*cut[1:], len(key)]):
                        group = (name, sources[which[a]])
                        if group not in held:
                            if taken + width > HELD_SLOTS and held:
                                yield from flush(held, tables)
                                held.clear()
                                taken = 0
                            held[group] = np.zeros(width, dtype=np.int64)
                            taken += width
                        held[group][key[a:b] - which[a] * width] += n[a:b]
        yield from flush(held, tables)

    partial = docs.mapInArrow(count, schema)
    return partial.select("lang", "source", "shard", F.explode(F.arrays_zip("slots", "counts")).alias("e")).select("lang", "source", "shard", F.col("e.slots").alias("slot"), F.col("e.counts").alias("n"))


def counted(docs: DataFrame, hashed: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(lang, source, shard, slot, n)``: how often every kept term occurs in every source, where it does.

    ``hashed`` is a written table.  Its shards are dealt to as many blocks as keep a block near ``block_bytes``; each block is read,
    broadcast, counted against all texts and released before the next.  A block beyond four times the bound is an error.
    """
    spark = docs.sparkSession
    weight = F.length("keys") + F.length("lengths") + F.length("displacements")
    total = hashed.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_bytes))
    dealt = hashed.withColumn("_block", F.pmod(F.xxhash64("lang", "shard"), F.lit(blocks)))
    path = scratch_path(spark, "recount")
    for b in range(blocks):
        own = dealt.where(F.col("_block") == b)
        if own.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0] > 4 * block_bytes:
            raise ValueError("a block of perfect hashes is far larger than its bound")
        block = spark.sparkContext.broadcast(loaded(own.collect()))
        summed = recount(docs, block).groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))
        summed.write.parquet(f"{path}/block-{b}")
        block.destroy()
    return spark.read.schema("lang string, source string, shard int, slot int, n bigint").parquet(*[f"{path}/block-{b}" for b in range(blocks)])


def share(count, total, v, smoothing: int):
    """``1 + floor(SCALE * (count + smoothing) / (total + smoothing * v))`` in exact decimals."""
    whole = lambda c: c.cast("decimal(19,0)")
    fixed = lambda x: F.lit(x).cast("decimal(10,0)")
    below = whole(total) + fixed(smoothing) * whole(v)  # zero only where nothing is kept, and then no share is used
    return F.call_function("div", fixed(SCALE) * (whole(count) + fixed(smoothing)), F.greatest(below, fixed(1))) + 1


def _tile_kernel(schema_names):
    def kernel(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row]
                size = get("size").as_py()
                left, right = get("rows").values, get("other").values
                same = get("tile").as_py() == get("to").as_py()
                a_names, a = _dense(left, size)
                b_names, b = (a_names, a) if same else _dense(right, size)
                one, two, value = [], [], []
                for i in range(len(a)):
                    j = np.arange(i + 1, len(b)) if same else np.arange(len(b))
                    one += [a_names[i]] * len(j)
                    two += [b_names[x] for x in j]
                    value.append(np.abs(b[j] - a[i]).sum(1))
                if one:
                    values = np.concatenate(value)
                    lang = [get("lang").as_py()] * (2 * len(one))
                    yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(one + two), pa.array(two + one), pa.array(np.concatenate([values, values]))], names=schema_names)

    return kernel


def _dense(rows: pa.StructArray, size: int) -> tuple[list[str], np.ndarray]:
    """Shares of every source of a tile in all slots of a shard; a slot without a count has the source's base share."""
    base = np.asarray(rows.field("base"))
    dense = np.repeat(base[:, None], size, axis=1)
    slots, shares = rows.field("slots"), rows.field("shares")
    counts = np.diff(np.asarray(slots.offsets))
    dense[np.repeat(np.arange(len(base)), counts), np.asarray(slots.flatten())] = np.asarray(shares.flatten())
    return rows.field("source").to_pylist(), dense


def pair_divergence(counts: DataFrame, groups: DataFrame, layout: DataFrame, smoothing: int) -> DataFrame:
    """``(lang, source, item, value)`` of all ordered pairs of sources of a language.

    ``groups(lang, source, n_group, v)``, ``layout(lang, shard, size)`` with at least one (perhaps empty) shard per language.
    The unit of work is (language, shard, tile of sources, tile of sources): its dense blocks are bounded whatever
    the vocabulary or the number of sources, and only sums leave it.
    """
    with_share = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("n_group"), F.col("v"), smoothing))
    held = with_share.groupBy("lang", "source", "shard").agg(F.collect_list(F.struct("slot", "p")).alias("held"))
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES_PER_TILE).cast("int").alias("tiles"))
    base = share(F.lit(0), F.col("n_group"), F.col("v"), smoothing)
    units = groups.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles").cast("bigint")).cast("int")).withColumn("base", base)
    full = units.join(layout, "lang").join(held, ["lang", "source", "shard"], "left")
    none = F.array().cast("array<struct<slot:int,p:bigint>>")
    full = full.withColumn("held", F.coalesce("held", none))
    body = F.struct("source", "base", F.col("held.slot").alias("slots"), F.col("held.p").alias("shares"))
    packed = full.groupBy("lang", "shard", "tile").agg(F.first("size").alias("size"), F.first("tiles").alias("tiles"), F.collect_list(body).alias("rows"))
    left = packed.withColumn("to", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)))
    right = packed.select("lang", "shard", F.col("tile").alias("to"), F.col("rows").alias("other"))
    pairs = left.join(right, ["lang", "shard", "to"]).select("lang", "size", "tile", "to", "rows", "other")
    names = ["lang", "source", "item", "value"]
    found = pairs.mapInArrow(_tile_kernel(names), "lang string, source string, item string, value bigint")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_divergence(counts: DataFrame, groups: DataFrame, terms: DataFrame, smoothing: int) -> DataFrame:
    """``(lang, source, item, value)`` of the kept terms that a source has and uses more than its language does."""
    per_lang = counts.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("n_lang"))
    totals = groups.groupBy("lang").agg(F.sum("n_group").alias("lang_total"), F.first("v").alias("_v"))
    q = per_lang.join(totals, "lang").join(terms, ["lang", "shard", "slot"])
    q = q.select("lang", "shard", "slot", "term", share(F.col("n_lang"), F.col("lang_total"), F.col("_v"), smoothing).alias("q"))
    p = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("n_group"), F.col("v"), smoothing))
    return p.join(q, ["lang", "shard", "slot"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def slot_terms(hashed: DataFrame) -> DataFrame:
    """``(lang, shard, slot, term)`` out of the stored keys."""

    def unpack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = np.frombuffer(batch.column("lengths")[i].as_py(), dtype=np.int32).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                keys = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(batch.column("keys")[i].as_py())])
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("lang")[i].as_py()] * n), pa.array(np.full(n, batch.column("shard")[i].as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int32)), keys.cast(pa.large_string()).cast(pa.string())],
                    names=["lang", "shard", "slot", "term"],
                )

    return hashed.select("lang", "shard", "lengths", "keys").mapInArrow(unpack, "lang string, shard int, slot int, term string")


def audit(
    docs: DataFrame, least: int = 30, smoothing: int = 5, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far the sources of each language lie apart.

    ``docs`` needs the three named columns; null counts as the empty text, other columns are not read, repeated rows count as
    often as they are there.  A language keeps the terms that occur in at least ``least`` of its documents.  Part ``pair`` has a
    row for every other source of the language (value 0 if nothing is kept), part ``term`` the ``top`` terms that the source
    uses more than the language does.  Ranks go by value, then by the item's UTF-8 bytes.  An empty table gives no rows.
    """
    docs = prepared(docs, text_col, lang_col, source_col)
    kept = cut_lineage(document_frequencies(docs).where(F.col("n_docs") >= least).select("lang", "term"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"))
    hashed = cut_lineage(shards(kept, langs))
    counts = counted(docs, hashed, block_bytes)
    seen = docs.select("lang", "source").distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = seen.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n_group", F.lit(0)).alias("n_group"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = cut_lineage(groups)
    layout = groups.select("lang").distinct().join(hashed.select("lang", "shard", "size"), "lang", "left").select("lang", F.coalesce("shard", F.lit(0)).alias("shard"), F.coalesce("size", F.lit(0)).alias("size"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pair_divergence(counts, groups, layout, smoothing).withColumn("rank", F.row_number().over(order))
    terms = term_divergence(counts, groups, slot_terms(hashed), smoothing).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
