"""Cutting oversized texts at natural boundaries, with an exact overlap.

Boundaries form a hierarchy: section, paragraph, sentence (or line), word, character. A stretch that does not fit is cut
by the next level; the resulting units are packed greedily. Every piece but the first begins with the last ``overlap``
characters of the piece before it, so that dropping them gives the text back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurolith.functions.distributed import running_total

#: Ends of units by level; a cut falls at the end of the match.
LEVELS = (
    re.compile(r"\n(?=#{1,6}[ \t])"),
    re.compile(r"\n[ \t\r]*\n+"),
    re.compile(r"\n|[.!?…][\"'”’»)\]]*[ \t ]+(?=[^a-zа-я])|[。！？；][”’」』）]*"),
    re.compile(r"[ \t  - 　]+|[，、：]"),
)


#: Marks on one letter that a hard cut is moved back over; longer stacks are cut.
MOST_MARKS = 16


def _characters(text: str, a: int, b: int, room: int) -> list[int]:
    """Hard cuts, moved back over at most ``MOST_MARKS`` combining marks, joiners and the line feed of a CR LF."""
    out = []
    while b - a > room:
        cut = a + room
        for _ in range(MOST_MARKS):
            c = text[cut]
            if cut > a + 1 and (unicodedata.combining(c) or c in "‍️" or text[cut - 1] == "‍" or (c == "\n" and text[cut - 1] == "\r")):
                cut -= 1
            else:
                break
        out.append(cut)
        a = cut
    return out + [b]


def units(text: str, a: int, b: int, room: int, level: int = 0) -> list[int]:
    """Ends of units of text[a:b], each at most ``room`` long, cut by the coarsest level that does."""
    if b - a <= room:
        return [b]
    if level == len(LEVELS):
        return _characters(text, a, b, room)
    ends = [m.end() for m in LEVELS[level].finditer(text, a, b) if a < m.end() < b] + [b]
    out, at = [], a
    for end in ends:
        out += [end] if end - at <= room else units(text, at, end, room, level + 1)
        at = end
    return out


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces. limit below 1: taken as 1; overlap is lowered to limit - 1 where it is larger."""
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    n = len(text)
    if n <= limit:
        return [(0, n)]
    out, start, end = [], 0, 0
    for u in units(text, 0, n, limit - overlap):
        if u - start > limit:
            out.append((start, end))
            start = max(0, end - overlap)
        end = u
    return [*out, (start, end)]


SCHEMA = "document_id string, ord int, n_pieces int, piece_idx int, piece string, n_chars int"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, ord_, text, limit, overlap in zip(b["document_id"], b["ord"], b["content"], b["max_chars"], b["overlap_chars"], strict=True):
            at = cut_points(text, int(limit), int(overlap))
            rows += [(doc, ord_, len(at), i, text[s:e], e - s) for i, (s, e) in enumerate(at)]
        yield pd.DataFrame(rows, columns=["document_id", "ord", "n_pieces", "piece_idx", "piece", "n_chars"])


def stored_chunks(chunks: DataFrame, documents: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per (document_id, ord) with the limits of the document's shelf. Null contents are left out; of a chunk
    delivered again the latest delivery counts. Chunks of unknown documents or shelves have null limits."""
    c = chunks.filter("document_id is not null and ord is not null and content is not null")
    c = c.groupBy("document_id", "ord").agg(F.max_by("content", F.struct("indexed_at", "content")).alias("content"))
    shelf = documents.filter("document_id is not null").groupBy("document_id").agg(F.min("shelf").alias("shelf"))
    sizes = limits.filter("shelf is not null").groupBy("shelf").agg(F.max(F.struct("max_chars", "overlap_chars")).alias("l"))
    return c.join(shelf, "document_id", "left").join(sizes, "shelf", "left").select("document_id", "ord", "content", F.col("l.max_chars").alias("max_chars"), F.coalesce("l.overlap_chars", F.lit(0)).alias("overlap_chars"))


def oversized_pieces(stored: DataFrame) -> DataFrame:
    """Pieces of the chunks that are over their limit. The rest never reaches Python."""
    over = stored.filter(F.char_length("content") > F.col("max_chars"))
    return over.mapInPandas(_cut, SCHEMA)


def all_pieces(chunks: DataFrame, documents: DataFrame, limits: DataFrame) -> DataFrame:
    """(document_id, new_ord, ord, piece_idx, piece, n_chars): every chunk within its limit, numbered on through a document.

    new_ord counts from 0 in the order of ord, gaps closed; a chunk that fits stays as it is. Blank contents stay one piece.
    """
    stored = stored_chunks(chunks, documents, limits)
    fits = stored.filter(F.coalesce(F.char_length("content") <= F.col("max_chars"), F.lit(True)))
    kept = fits.select("document_id", "ord", F.lit(1).alias("n_pieces"), F.lit(0).alias("piece_idx"), F.col("content").alias("piece"), F.char_length("content").alias("n_chars"))
    pieces = kept.unionByName(oversized_pieces(stored))
    firsts = running_total(pieces.filter("piece_idx = 0").select("document_id", "ord", F.col("n_pieces").cast("bigint").alias("n")), ["document_id"], "ord", "n", "base")
    joined = pieces.join(firsts.select("document_id", "ord", "base"), ["document_id", "ord"])
    return joined.select("document_id", (F.col("base") + F.col("piece_idx")).alias("new_ord"), "ord", "piece_idx", "piece", "n_chars")


def recomputed_sizes(chunks: DataFrame, documents: DataFrame, limits: DataFrame) -> DataFrame:
    """(document_id, size_chars, chunk_count): characters of a document's chunks without the overlaps, and pieces."""
    stored = stored_chunks(chunks, documents, limits)
    over = oversized_pieces(stored).filter("piece_idx = 0").select("document_id", "ord", "n_pieces")
    size = stored.groupBy("document_id").agg(F.sum(F.char_length("content")).alias("size_chars"), F.count(F.lit(1)).alias("stored"))
    more = over.groupBy("document_id").agg(F.sum(F.col("n_pieces") - 1).alias("more"))
    return size.join(more, "document_id", "left").select("document_id", "size_chars", (F.col("stored") + F.coalesce("more", F.lit(0))).alias("chunk_count"))
