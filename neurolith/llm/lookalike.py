"""One form for texts that look the same but are made of different characters.

Every character is mapped to the representative of its look-alikes (a rule over Unicode's decompositions and one short
table of letters of the same shape), the mapped texts are grouped under Spark's accent-sensitive UNICODE collation, a
canonical member is chosen per group by a deterministic order, and its form is joined back.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from neurolith.functions.distributed import broadcast_if_small, cut_lineage

# Letters of other alphabets and the Latin letters of the same shape.
CYRILLIC = dict(zip("аеосрухіјѕһԁԛԝӏѵүАВЕКМНОРСТУХІЈЅӀԚԜҮ", "aeocpyxijshdqwlvyABEKMHOPCTYXIJSIQWY", strict=True))
GREEK = dict(zip("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oABEZHIKMNOPTYX", strict=True))
OTHER = dict(zip("օսհոɡⅼΜ", "ouhnglM", strict=True))
SIGNS = {"‐": "-", "‑": "-", "µ": "μ"}
SHAPES = {**CYRILLIC, **GREEK, **OTHER}

#: Kinds of decomposition that change nothing in a text's look. Raised, lowered, circled and fraction forms do.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<square>", "<isolated>", "<initial>", "<medial>", "<final>")
BLANK_LINES = {0x85: "\n", 0x2028: "\n", 0x2029: "\n", 0x0D: ""}
FILLERS = {0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F}


class Mapping(dict):
    """Code points to text for str.translate; those without an entry get themselves, so that none is looked up twice."""

    def __missing__(self, cp: int) -> int:
        self[cp] = cp
        return cp


@lru_cache(maxsize=1)
def first_map() -> dict[int, str]:
    """Width, joined letters and signs, blanks and invisible characters, by rule over all of Unicode."""
    out: dict[int, str] = {}
    for cp in [*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]:
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cf" or cp in FILLERS or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or (kind == "Cc" and cp != 0x85):
            out[cp] = ""
        elif kind == "Zs":
            out[cp] = " "
        elif unicodedata.decomposition(ch).startswith(SAME_LOOK):
            full = unicodedata.normalize("NFKC", ch)
            if not full.startswith(" "):  # spacing accents keep their own shape
                out[cp] = full
    for cp in range(0x20):
        if cp not in (0x09, 0x0A):
            out[cp] = ""
    return Mapping(out | BLANK_LINES | {0x09: " "})


@lru_cache(maxsize=1)
def whole_map() -> dict[int, str]:
    """first_map and the letters of the same shape, alone and with accents."""
    shapes = {ord(k): v for k, v in (SHAPES | SIGNS).items()}
    out = {cp: "".join(shapes.get(ord(c), c) for c in full) if isinstance(full, str) else full for cp, full in first_map().items()}
    for cp in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(cp))
        if cp not in out and any(ord(c) in shapes for c in parts):
            out[cp] = unicodedata.normalize("NFC", parts.translate(shapes))
    return Mapping(out)


def composed(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def skeleton(text: str) -> str:
    """The text in representatives of look-alikes. Equal skeletons: equal look."""
    return composed(composed(text).translate(whole_map()))


WORD = re.compile(r"[^\W\d_]+")
LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
BACK = {v: k for k, v in CYRILLIC.items() if k not in "ӏӀѵүҮԚԜԛԝԁһ"}


def written_form(text: str) -> str:
    """The text with one kind of blank, width and composition, and without letters of a foreign alphabet in a word.

    A word that mixes alphabets goes to Cyrillic if it has a Cyrillic letter of no Latin shape, else to Latin; a word
    wholly of shared shapes follows the majority of the text's unmistakable letters.
    """
    plain = composed(text.translate(first_map()))
    if not any(c in SHAPES for c in set(plain)):
        return plain.replace("‐", "-").replace("‑", "-").replace("µ", "μ")
    sure_cyr = sum(0x400 <= ord(c) < 0x530 and c not in CYRILLIC for c in plain)
    sure_lat = sum(bool(LATIN.match(c)) and c not in BACK for c in plain)

    def word(m: re.Match) -> str:
        w = m.group()
        letters = set(w)
        if not any(c in SHAPES for c in letters):
            return w
        if any(0x400 <= ord(c) < 0x530 and c not in CYRILLIC for c in letters):
            return "".join(BACK.get(c, c) for c in w)
        mixed = any(LATIN.match(c) for c in letters)
        if any(c in CYRILLIC for c in letters) and not mixed and sure_cyr > sure_lat:
            return w
        if any(c in GREEK for c in letters) and not mixed and len(w) == 1:
            return w
        return "".join(SHAPES.get(c, c) for c in w)

    return WORD.sub(word, plain).replace("‐", "-").replace("‑", "-").replace("µ", "μ")


def changed(text: str) -> int:
    """How many characters of the whole text its written form changes."""
    if text.isascii() and text.isprintable():
        return 0
    first = first_map()
    shown = text.translate(first)
    n = sum(k for c, k in Counter(text).items() if first[ord(c)] not in (ord(c), c))
    plain = composed(shown)
    if plain != shown:  # the marks that composition takes in or reorders
        n += sum((Counter(shown) - Counter(plain)).values()) or sum(a != b for a, b in zip(shown, plain, strict=True))
    form = written_form(text)  # from here on letter for letter
    return n + sum(a != b for a, b in zip(plain, form, strict=True))


@F.pandas_udf(LongType())
def changed_count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([None if t is None else changed(t) for t in s], dtype="Int64")


def _series(fn):
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(fn, na_action="ignore")

    return run


def _mapped(text: Column, fn) -> Column:
    """Plain ASCII (and line feeds) is its own form and does not travel to Python."""
    odd = F.when(~text.rlike(r"^[\x20-\x7e\n]*$"), text)
    return F.coalesce(_series(fn)(odd), text)


def skeleton_of(text: Column) -> Column:
    return _mapped(text, skeleton)


def form_of(text: Column) -> Column:
    return _mapped(text, written_form)


def collated(column: str) -> Column:
    return F.collate(F.col(column), "UNICODE")


SIGNS_AND_MARKS = re.compile(r"[\W_]+")
ASCII_SIGNS = {c: None for c in range(128) if not chr(c).isalnum()}


def look_number(text: str) -> int | None:
    """64-bit digest of the letters and digits of a text's skeleton; null for a blank text.

    Texts that are equal under the collation share it, whatever that ignores.
    """
    if text.isascii():
        blank, letters = not text.strip(), text.translate(ASCII_SIGNS)
    else:
        shape = skeleton(text)
        blank, letters = not shape.strip(), SIGNS_AND_MARKS.sub("", shape)
    if blank:
        return None
    return int.from_bytes(hashlib.blake2b(letters.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@F.pandas_udf(LongType())
def look_hash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([None if t is None else look_number(t) for t in s], dtype="Int64")


def with_look(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, own, look_hash) of the rows with an id and a text: digests of the text and of its look. Computed once, as narrow rows."""
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).filter(F.col("_id").isNotNull() & F.col("t").isNotNull())
    return cut_lineage(d.select(F.col("_id").alias(id_col), F.sha2("t", 256).alias("own"), look_hash("t").alias("look_hash")).filter("look_hash is not null").distinct())


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, own, look) of the rows whose look occurs with unlike texts.

    Rows whose hash has one text only, however many rows share it, are dropped before any text is joined (the ids left are
    broadcast if they are few enough); what is left is mapped, grouped under the collation itself, and each row gets its
    group's smallest text digest as look.
    """
    looks = with_look(docs, id_col, text_col)
    several = looks.groupBy("look_hash").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo <> hi").select("look_hash")
    wanted = broadcast_if_small(cut_lineage(looks.join(several, "look_hash", "left_semi")))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).join(wanted, (F.col("_id") == F.col(id_col)) & (F.sha2("t", 256) == F.col("own")))
    d = cut_lineage(texts.select(id_col, "own", "look_hash", skeleton_of(F.col("t")).alias("skeleton")).withColumn("form", collated("skeleton")).drop("skeleton"))
    groups = d.groupBy("look_hash", "form").agg(F.min("own").alias("look"), F.max("own").alias("hi")).filter("look <> hi").drop("hi")
    return d.join(groups, ["look_hash", "form"]).select(id_col, "own", "look")


def alike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a < b) of rows whose texts look the same but are not equal.

    Null and blank texts are left out; equal texts are no pair; an empty table gives no rows.
    """
    d = classes(docs, id_col, text_col)
    a, b = d.select("look", F.col(id_col).alias(f"{id_col}_a"), F.col("own").alias("oa")), d.select("look", F.col(id_col).alias(f"{id_col}_b"), F.col("own").alias("ob"))
    return a.join(b, "look").filter(F.col(f"{id_col}_a") < F.col(f"{id_col}_b")).filter("oa <> ob").select(f"{id_col}_a", f"{id_col}_b")


def unify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, canonical_id, form): every text in one form; of texts that look the same, the canonical member's.

    The canonical member has the fewest characters that its written form changes, then the smallest text digest, then the
    smallest id. A text of a look of its own has itself as canonical member. Null and blank texts keep a null
    canonical_id and their own text.
    """
    base = docs.select(F.col(id_col), F.col(text_col).alias("_t"))
    shared = cut_lineage(classes(docs, id_col, text_col).select(F.col(id_col).alias("_id"), "look").distinct())
    shared = broadcast_if_small(shared)
    rank = F.struct(changed_count("_t").alias("odd"), F.sha2("_t", 256).alias("h"), F.col("_id").alias("i"))
    ranked = base.join(shared, F.col(id_col) == F.col("_id")).select("_id", "look", form_of(F.col("_t")).alias("_f"), rank.alias("rank"))
    best = cut_lineage(ranked.groupBy("look").agg(F.min_by(F.struct(F.col("_id").alias("id"), F.col("_f").alias("f")), "rank").alias("m")))
    out = base.withColumn("_f", form_of(F.col("_t"))).join(shared, F.col(id_col) == F.col("_id"), "left").drop("_id").join(best, "look", "left")
    blank = F.coalesce(F.regexp_replace("_f", r"\s+", ""), F.lit("")) == ""
    canonical = F.when(blank, F.lit(None)).otherwise(F.coalesce("m.id", F.col(id_col)))
    return out.select(F.col(id_col), canonical.alias("canonical_id"), F.when(blank, F.col("_t")).otherwise(F.coalesce("m.f", "_f")).alias("form"))


__all__ = ["alike_pairs", "classes", "form_of", "skeleton", "skeleton_of", "unify", "with_look", "written_form"]
