"""Token counts by finite-state transduction with chunk maps under a parallel prefix scan.

A text is cut into chunks, anywhere.  A chunk is summarised by the map from the state before it to (state after it,
tokens emitted).  A *cut* is a place where a word begins or ends whatever came before: white space, a digit, or the end of
a run of letters.  It leads to the start from every state, so a map has three parts: *head*, the characters before the
chunk's first cut, which go on in whatever state it is entered; *count*, emitted between its first and last cut; *tail*,
the characters after that, which tell the state it is left in.  Maps compose associatively.  Each chunk is a row; the rows
of a text meet by its number and are composed by a scan in a logarithmic number of rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, sliced, table
from .lexicon import default_path
from .transducer import Transducer, transducer

#: Characters of a chunk.
CHUNK = 1 << 16
LIMIT = 2048


class ChunkMap(NamedTuple):
    head: str
    count: int
    tail: str | None  # None: no cut in the chunk, all of it is head


def chunk_map(chunk: str, t: Transducer) -> ChunkMap:
    first = next((i for i, c in enumerate(chunk) if t.cuts(c, chunk[i - 1] if i else "")), None)
    if first is None:
        return ChunkMap(chunk, 0, None)
    last = next(i for i in range(len(chunk) - 1, first - 1, -1) if t.cuts(chunk[i], chunk[i - 1] if i else ""))
    return ChunkMap(chunk[:first], t.read(chunk[first:last]), chunk[last:])


def compose(a: ChunkMap, b: ChunkMap, t: Transducer) -> ChunkMap:
    """The map of ``a`` followed by ``b``."""
    if not a.head and not a.count and a.tail is None:
        return b
    cut = b.head and t.cuts(b.head[0], (a.head if a.tail is None else a.tail)[-1:])  # seen only now that both sides are
    if a.tail is None:
        if cut:
            own = ChunkMap("", 0, b.head) if b.tail is None else ChunkMap("", t.read(b.head) + b.count, b.tail)
            return ChunkMap(a.head, own.count, own.tail)
        return ChunkMap(a.head + b.head, b.count, b.tail)
    if b.tail is None:
        return ChunkMap(a.head, a.count + t.read(a.tail), b.head) if cut else ChunkMap(a.head, a.count, a.tail + b.head)
    return ChunkMap(a.head, a.count + t.read(a.tail + b.head) + b.count, b.tail)


def scan(maps: list[ChunkMap], t: Transducer) -> list[ChunkMap]:
    """All prefixes' compositions: neighbours are composed, their scan taken, and the places between filled in."""
    if len(maps) < 2:
        return list(maps)
    half = scan([compose(a, b, t) for a, b in zip(maps[::2], maps[1::2], strict=False)], t)
    return [maps[0], *(half[i // 2] if i % 2 else compose(half[i // 2 - 1], maps[i], t) for i in range(1, len(maps)))]


def total(m: ChunkMap, t: Transducer) -> int:
    """Tokens of a text whose chunks come to ``m``, entered at the start and left at its end."""
    return t.read(m.head) + m.count + t.read(m.tail or "")


def text_maps(text: str, t: Transducer, chunk: int = CHUNK) -> tuple[list[ChunkMap], int]:
    """(a map for each chunk, one at least; the number of special strings, which are tokens of their own)."""
    text, found = t.prepared(text)
    return [chunk_map(text[i : i + chunk], t) for i in range(0, max(1, len(text)), chunk)], found


def count_tokens(text: str, t: Transducer, chunk: int = CHUNK) -> int:
    maps, found = text_maps(text, t, chunk)
    return total(scan(maps, t)[-1], t) + found


_ROW = "row long, doc_id long, n_bytes long"
_MAPS = f"{_ROW}, at int, found long, head string, count long, tail string"


def chunk_maps(rows: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of the texts of ``rows`` (row, doc_id, n_bytes, text): its place ``at``, the text's special strings (with the first chunk), the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for b in sliced(batch, 3):
                out = []
                for row, doc, size, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    maps, found = text_maps(text, t, chunk)
                    out += [(row, doc, size, i, 0 if i else found, *m) for i, m in enumerate(maps)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _MAPS.split(", ")])

    return rows.select("row", "doc_id", "n_bytes", "text").mapInArrow(lean(run), _MAPS)


def composed(maps: DataFrame, path: str) -> DataFrame:
    """(row, doc_id, n_bytes, n_tokens) of the chunk maps of each row, wherever they were made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            n = [total(scan([ChunkMap(m["head"], m["count"], m["tail"]) for m in ms], t)[-1], t) for ms in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.compute.add(pa.array(n, pa.int64()), b.column(3))], ["row", "doc_id", "n_bytes", "n_tokens"])

    by_row = maps.groupBy("row", "doc_id", "n_bytes").agg(F.sum("found").alias("found"), F.array_sort(F.collect_list(F.struct("at", "head", "count", "tail"))).alias("maps"))
    return by_row.mapInArrow(lean(run), f"{_ROW}, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Null texts count as empty: no bytes, no tokens.  Special strings inside texts are read as the tokenizer reads
    them by default; nothing is added, cut or padded.  Other columns are ignored; repeated rows come repeated.
    ``tokenizer`` is a file of the kind that :class:`Transducer` compiles; others are an error.
    """
    path = tokenizer or default_path()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return composed(chunk_maps(rows, path, chunk), path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


__all__ = ["chunk_map", "compose", "count_tokens", "op6_token_counts", "scan", "token_counts"]
