"""Fill-in-middle texts, assembled by a secondary sort over pieces of bounded size.

A document is cut into prefix, middle and suffix at keyed places and written in another order, with
a sentinel before every part.  No task holds an output text as a whole unless it is asked for: every part
leaves as pieces of at most ``chunk`` code points with the key (row, place in the output), one
``repartitionAndSortWithinPartitions`` brings them to their place, and they stream into a digest.

Restoring works on that output stream alone: sentinels are searched in its bytes (also across
pieces), what lies between them gets the key (row, part, number), and a second
``repartitionAndSortWithinPartitions`` under the same partitioner (so without a second shuffle) sorts the
pieces back into the order of the text, which streams into the second digest.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from itertools import groupby

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 1 << 16  # code points of a piece
SORTED_BYTES = 64 << 20  # text that one task sorts
HEAD, TAIL = -1, 1 << 62  # places before and after all pieces of a row
RESULT = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output_sha256", T.StringType()),
        T.StructField("restored_sha256", T.StringType()),
        T.StructField("output", T.StringType()),
    ]
)


def plan(doc_id, text: str, plain_share: int = 10, spm_share: int = 20) -> tuple[str, int, int]:
    """``(form, end of the prefix, end of the middle)`` of one text; the places are 0 for ``plain``.

    Draws are the first four 8-digit groups of the sha256 of ``1:`` and the decimal id (nothing for a null id).
    A text that is empty or holds a sentinel stays plain, as does a share of ``plain_share`` percent; of the others
    ``spm_share`` percent take the order suffix, prefix, middle.
    """
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= 100 - plain_share:
        return "plain", 0, 0
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return ("spm" if h4 % 100 < spm_share else "psm"), a, b


def parts(text: str, form: str, a: int, b: int) -> list[tuple[str, str]]:
    """``[(sentinel, content)]`` in the order of the output."""
    if form == "plain":
        return [("", text)]
    prefix, middle, suffix = (PREFIX, text[:a]), (MIDDLE, text[a:b]), (SUFFIX, text[b:])
    return [suffix, prefix, middle] if form == "spm" else [prefix, suffix, middle]


def emit(rows, n_ids: int, chunk: int, plain_share: int, spm_share: int) -> Iterator[tuple[tuple, tuple]]:
    """``((bucket, row key, place), piece)`` of every row: a head with the row's other values, then its output in pieces.

    The row key is a digest of the whole row and the number of its input partition, so equal rows of one partition
    share a key (their pieces are read once and counted), and copies all over the table do not meet in one task.
    """
    task = TaskContext.get()
    here = (task.partitionId() if task else 0).to_bytes(4, "big")
    for row in rows:
        values = tuple(row)
        packed = pickle.dumps(values, protocol=5)
        key = hashlib.blake2b(packed, digest_size=16).digest() + here
        bucket = int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "big") >> 1
        text = values[n_ids] or ""
        form, a, b = plan(values[n_ids + 1], text, plain_share, spm_share)
        yield (bucket, key, HEAD), (values[:n_ids] + values[n_ids + 2 :], len(text), form, a, b)
        at = 0
        for sentinel, content in parts(text, form, a, b):
            for i in range(0, max(1, len(content)), chunk):
                piece = content[i : i + chunk] if i else sentinel + content[:chunk]
                if piece:
                    yield (bucket, key, at), piece.encode("utf-8", "surrogatepass")
                    at += len(piece)


class Parser:
    """Takes the bytes of an output text piece by piece and gives back ``(part, number)`` pieces of the text.

    Sentinels come in a fixed order for a form, so only the next one is looked for; its first bytes may end
    one piece and its last ones begin the next, hence two bytes are held back.
    """

    ORDER = {"psm": [(b"<P>", 0), (b"<S>", 2), (b"<M>", 1)], "spm": [(b"<S>", 2), (b"<P>", 0), (b"<M>", 1)], "plain": []}

    def __init__(self, form: str):
        self.coming = list(self.ORDER[form])
        self.part, self.number, self.held = 0, 0, b""

    def _out(self, data: bytes):
        if data:
            self.number += 1
            yield (self.part, self.number), data

    def feed(self, data: bytes):
        data = self.held + data
        self.held = b""
        while self.coming:
            sentinel, part = self.coming[0]
            at = data.find(sentinel)
            if at < 0:
                self.held = data[-2:]
                yield from self._out(data[:-2])
                return
            yield from self._out(data[:at])
            data = data[at + len(sentinel) :]
            self.part, self.number = part, 0
            self.coming.pop(0)
        yield from self._out(data)

    def close(self):
        yield from self._out(self.held)
        if self.coming:
            raise ValueError(f"output ends before {self.coming[0][0]!r}")


def _rows(stream):
    """Sorted ``((bucket, key, place), piece)`` grouped by row, one row after the other."""
    return groupby(stream, key=lambda item: item[0][:2])


def digest_output(stream, keep: bool):
    """Reads the sorted output pieces, digests them, and sends what it parsed on under (part, number) of the text."""
    for (bucket, key), items in _rows(stream):
        copies, last, sha, parser, held = 0, None, hashlib.sha256(), None, []
        head = None
        for (_, _, at), piece in items:
            if at == HEAD:
                copies += 1
                if head is None:
                    head, parser = piece, Parser(piece[2])
                continue
            if at == last:  # the same piece of an equal row
                continue
            last = at
            sha.update(piece)
            if keep:
                held.append(piece)
            for (part, number), data in parser.feed(piece):
                yield (bucket, key, (part, number)), data
        for (part, number), data in parser.close():
            yield (bucket, key, (part, number)), data
        output = b"".join(held).decode("utf-8", "surrogatepass") if keep else None
        yield (bucket, key, (TAIL, 0)), (copies, *head, sha.hexdigest(), output)


def digest_restored(stream):
    """Reads the pieces in the order of the text and returns one result per row of the input."""
    for _, items in _rows(stream):
        sha = hashlib.sha256()
        for (_, _, (part, _)), piece in items:
            if part != TAIL:
                sha.update(piece)
                continue
            copies, others, n, form, a, b, output_sha, output = piece
            plain = form == "plain"
            result = (n, form, None if plain else a, None if plain else b - a, output_sha, sha.hexdigest(), output)
            for _ in range(copies):
                yield (*others, result)


def transform(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    plain_share: int = 10,
    spm_share: int = 20,
    chunk: int = CHUNK,
    keep_output: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """``docs`` without ``text_col``, with ``fim`` = struct(n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, output).

    Every input row gives one row; a column of the input called ``fim`` gives way to the result.  Null text counts as
    empty; empty texts are ``plain`` with an empty output.  A null id draws from the empty id.  Rows that share an id share
    its draws, each with its own text; equal rows come back as often as they came in.  ``keep_output=False`` leaves ``output`` null,
    and then no output text is ever whole in a task.  ``partitions`` (default: what the session shuffles to, or
    as many as keep a sort near ``SORTED_BYTES``) does not change the result; the sort spills, so a partition may be larger than memory.
    """
    ship_package(docs.sparkSession)
    others = [f for f in docs.schema.fields if f.name not in (text_col, "fim")]
    source = docs.select(*[F.col(f"`{f.name}`") for f in others], F.col(text_col), F.col(id_col).cast("string")).rdd
    if partitions is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / SORTED_BYTES))
    n_ids = len(others)
    bucket = lambda key: key[0]
    pieces = source.mapPartitions(lambda rows: emit(rows, n_ids, chunk, plain_share, spm_share))
    placed = pieces.repartitionAndSortWithinPartitions(partitions, bucket)
    parsed = placed.mapPartitions(lambda stream: digest_output(stream, keep_output), preservesPartitioning=True)
    restored = parsed.repartitionAndSortWithinPartitions(partitions, bucket)
    schema = T.StructType([*others, T.StructField("fim", RESULT)])
    return docs.sparkSession.createDataFrame(restored.mapPartitions(digest_restored), schema, verifySchema=False)
