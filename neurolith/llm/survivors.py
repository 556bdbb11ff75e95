"""Records of one work, and the one record that survives of each group.

Records are cleaned, identical ones are collapsed, and those that share a selective key (DOI, two of three title segments,
first author and a title segment, an abstract's words) are compared. Links become groups by label propagation. Within a
group the records are ranked by completeness, trust and recency; every field of the survivor is chosen by that order.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurolith.functions.distributed import broadcast_if_small, cut_lineage, stored
from neurolith.llm.splits import propagate

# What stands where a value is missing, and headings that many works share.
NO_VALUE = {"", "-", "?", "n/a", "na", "none", "null", "nan", "unknown", "tbd", "no title", "untitled"}
NO_ABSTRACT = re.compile(r"^(no abstract|abstract unavailable|abstract not available|see full text|not available|tba?d?\b)", re.I)
NOTICE = re.compile(r"^(corrigendum|comment|erratum|reply|response|addendum|retraction|correction|author correction|publisher correction|commentary)\s+(?:to|on|for|of)\b\s*")
PART = re.compile(r"\bpart ([ivx]+|\d+)\b")
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
TAG = re.compile(r"</?[a-zA-Z][^<>]{0,40}>")
DOI = re.compile(r"10\.\d{4,9}/\S+")
NO_DOI = re.compile(r"^10\.0+/0*$")
OTHERS = re.compile(r"^(et al|and others)\b", re.I)
HEADED = re.compile(r"^\W*(<[^>]+>\s*)?(abstract|summary)\s*[:.\-–—]\s*", re.I)
CUT_OFF = re.compile(r"\W*\b(truncated|continued|read more|more)\W*$", re.I)
YEAR = re.compile(r"\b(1[89]\d\d|20\d\d)\b")
#: Of UTF-8: ASCII letters in lower case, other ASCII than letters and digits as blanks.
PLAIN = bytes(ord(chr(c).lower()) if c > 127 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def plain(text: str) -> str:
    """Lower-case words without markup, accents and punctuation."""
    t = html.unescape(text) if "&" in text else text
    t = TAG.sub(" ", t) if "<" in t else t
    if not t.isascii():
        t = " ".join([w if w.isascii() else _folded(w) for w in t.split()])
    return b" ".join(t.encode("utf-8", "surrogatepass").translate(PLAIN).split()).decode("utf-8", "surrogatepass")


@lru_cache(50_000)
def _folded(word: str) -> str:
    t = unicodedata.normalize("NFKD", word.replace("ß", "ss"))
    t = "".join(c for c in t if not unicodedata.combining(c)).lower()
    return re.sub(r"[\W_]+", " ", t)


def clean_title(title: str | None) -> tuple[str | None, str, int, bool]:
    """(core words, kind of notice, part, cut off). Part 0: none; -1: cannot be seen. Null and stand-ins: no core."""
    if title is None or title.strip().lower() in NO_VALUE:
        return None, "", -1, False
    cut = title.rstrip(" ]").endswith(("…", "..."))
    core = plain(title)
    kind = ""
    if m := NOTICE.match(core):
        kind, core = m.group(1), core[m.end() :]
    part = 0
    if m := PART.search(core):
        part = ROMAN.get(m.group(1)) or (int(m.group(1)) if m.group(1).isdigit() else 0)
        core = " ".join((core[: m.start()] + core[m.end() :]).split())
    elif cut:
        part = -1
    return core or None, kind, part, cut


def clean_doi(doi: str | None) -> tuple[str | None, bool]:
    """(DOI, is a preprint's). Versions of a preprint are one; stand-ins are none."""
    if doi is None:
        return None, False
    m = DOI.search(doi.strip().lower().replace("%2f", "/"))
    if not m:
        return None, False
    d = m.group().rstrip(".,;)")
    if NO_DOI.match(d):
        return None, False
    bare = re.sub(r"\.v\d+$", "", d)
    return bare, bare != d or "/pre." in bare


def clean_names(authors) -> tuple[list[str], bool]:
    """(family names in order, list is cut off)."""
    names, cut = [], False
    for a in authors if authors is not None else ():
        if a is None or a.strip().lower() in NO_VALUE:
            continue
        if OTHERS.match(a.strip()):
            cut = True
            continue
        if "," in a:
            name = a.split(",")[0]
        else:
            words = [w for w in a.split() if len(w.strip(".")) > 1]
            name = words[-1] if words else a
            if a.split() and len(a.split()[-1].strip(".")) == 1 and words:
                name = words[0]
        if p := plain(name):
            names.append(p)
    return names, cut


def clean_abstract(abstract: str | None) -> str | None:
    if abstract is None or abstract.strip().lower() in NO_VALUE or NO_ABSTRACT.match(abstract.strip()):
        return None
    text = HEADED.sub("", abstract.strip())
    low = text.lower()
    if "more" in low or "truncated" in low or "continued" in low:
        text = CUT_OFF.sub("", text)  # says that the rest was cut
    words = plain(text).split()
    return " ".join(words) if len(words) >= 5 else None


def clean_year(year: str | None) -> int | None:
    m = YEAR.search(year or "")
    return int(m.group()) if m else None


def keys_of(core, kind, part, names, doi, abstract) -> list[str]:
    """Keys of which two records of one work share one. General headings only count with a name or an abstract."""
    out = []
    if doi:
        out.append("d|" + doi)
    first = names[0] if names else ""
    words = core.split() if core else []
    if len(words) >= 5:
        a, b, c = " ".join(words[:4]), " ".join(words[4:8]), " ".join(words[8:12])
        if b:
            out.append(f"t|{kind}|1|{a}|{b}")
        if c:
            out += [f"t|{kind}|2|{b}|{c}", f"t|{kind}|3|{a}|{c}"]
        if first:
            out += [f"n|{kind}|{first}|{a}"] + ([f"n|{kind}|{first}|{b}"] if b else [])
    elif words and first:
        out += [f"g|{first}|{' '.join(words)[:3]}"]
    if abstract:
        w = abstract.split()
        out += ["a|" + " ".join(w[:24])] if len(w) >= 24 else []
        out += ["b|" + " ".join(w[8:30])] if len(w) >= 30 else []
        out += [f"s|{first}|" + " ".join(w[:12])] if first and len(w) >= 12 else []
        out += ["z|" + " ".join(w[:12])] if len(w) >= 12 else []  # only for records without a title
    return out


TEXTS = ["core", "kind", "part", "cut", "names", "names_cut", "year", "doi", "preprint", "abstract"]
SIGNS = {"core": (48, 72), "abstract": (13, 14, 15, 16, 20, 28, 40)}  # prefixes of titles (characters) and abstracts (words)
FEATURES = (
    "candidate_id bigint, core string, kind string, part int, cut boolean, names array<string>, names_cut boolean, year int, doi string, preprint boolean, abstract string, d1 bigint, d2 bigint, doi_key bigint, keys array<bigint>, opening bigint, "
    "core_len int, core_sign bigint, " + ", ".join(f"core_{k} int" for k in SIGNS["core"]) + ", named boolean, words int, loose boolean, " + ", ".join(f"words_{k} int" for k in SIGNS["abstract"])
)


def title_signs(cores: list[str | None]) -> list[np.ndarray]:
    """Of each title 64 bits, each the parity of the pairs of letters that fall on it; of its prefixes in ``SIGNS`` 32 bits.

    One slip changes at most four bits. Prefixes longer than the title have the title's own.
    """
    text = [c or "" for c in cores]
    size = np.array([len(c) for c in text])
    end = np.cumsum(size)
    start = end - size
    x = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) if len(x) else x
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(58)
    total = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.uint64(1) << h)]) if len(x) else np.zeros(1, np.uint64)
    last = len(total) - 1
    at = lambda stop: total[np.clip(np.maximum(stop - 1, start), 0, last)] ^ total[np.clip(start, 0, last)]
    half = lambda sign: (sign ^ (sign >> np.uint64(32))).astype(np.uint32).view(np.int32)
    return [at(end).view(np.int64), *[half(at(np.minimum(end, start + k))) for k in SIGNS["core"]]]


class _Bits(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        bit = self[word] = 1 << (zlib.crc32(word.encode("utf-8", "surrogatepass")) & 31)
        return bit


BITS = _Bits()


def word_signs(words: list[str]) -> list[int]:
    """Of the words from the thirteenth on, up to the numbers of ``SIGNS``: 32 bits, each the parity of the words that fall on it."""
    out, sign, i = [], 0, 12
    for k in SIGNS["abstract"]:
        for w in words[i:k]:
            sign ^= BITS[w]
        out.append(sign - (1 << 32) if sign >> 31 else sign)
        i = k
    return out


def is_loose(words: list[str]) -> bool:
    """Whether a text that has the first twelve words in common with this one can agree with it when shifted."""
    left = (len(words) - 1) // 20
    if 11 - len(set(words[:11])) < 5 - left:  # too few words come again
        return False
    return any(sum(u != v for u, v in zip(words[k:11], words[: 11 - k], strict=True)) <= left for k in range(1, 7))  # the twelfth may be cut


NO_SIGNS = [0] * len(SIGNS["abstract"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = FEATURE_SCHEMA
    for b in batches:
        rows, keys, many = [], [], []
        for i, title, authors, year, abstract, doi in zip(*(b.column(c).to_pylist() for c in ("candidate_id", "title", "authors", "year", "abstract", "doi")), strict=True):
            core, kind, part, cut = clean_title(title)
            names, names_cut = clean_names(authors)
            d, pre = clean_doi(doi)
            abst = clean_abstract(abstract)
            record = (core, kind, part, cut, names, names_cut, clean_year(year), d, pre, abst)
            own = keys_of(core, kind, part, names, d, abst)
            digest = hashlib.blake2b((repr(record) if own else f"own/{i}").encode("utf-8", "surrogatepass"), digest_size=16).digest()
            w = abst.split() if abst else []
            opens = len(w) >= 12
            keys += own
            many.append((len(own), d is not None, opens))
            rows.append((i, *record, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), None if core is None else len(core), bool(names), len(w), opens and is_loose(w), *(word_signs(w) if opens else NO_SIGNS)))
        if not rows:
            continue
        hashed = pd.util.hash_array(np.array(keys, dtype=object), categorize=False).view(np.int64).tolist() if keys else []
        own_keys, opening, doi_key, k = [], [], [], 0
        for n, has_doi, opens in many:  # the DOI's key is the first, that of the opening words the last
            mine = hashed[k : k + n]
            k += n
            opening.append(mine.pop() if opens else None)
            doi_key.append(mine.pop(0) if has_doi else None)
            own_keys.append(list(dict.fromkeys(mine)))
        named = dict(zip(ROW, zip(*rows, strict=True), strict=True)) | {"keys": own_keys, "opening": opening, "doi_key": doi_key}
        named |= dict(zip(("core_sign", *[f"core_{k}" for k in SIGNS["core"]]), title_signs(named["core"]), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(named[f.name], f.type) for f in schema], schema=schema)


ROW = ["candidate_id", *TEXTS, "d1", "d2", "core_len", "named", "words", "loose", *[f"words_{k}" for k in SIGNS["abstract"]]]
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
FEATURE_SCHEMA = pa.schema([(name, ARROW[kind]) for name, kind in (f.split() for f in FEATURES.split(", "))])


def near(a: str, b: str, most: int) -> bool:
    """Edit distance (insertion, deletion, substitution) of at most ``most``, in a band."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if max(len(a), len(b)) <= most:
        return True
    row = list(range(len(b) + 1))
    for x in range(1, len(a) + 1):
        new = [x] + [most + 1] * len(b)
        for y in range(max(1, x - most), min(len(b), x + most) + 1):
            new[y] = min(new[y - 1] + 1, row[y] + 1, row[y - 1] + (a[x - 1] != b[y - 1]))
        row = new
        if min(row) > most:
            return False
    return row[-1] <= most


def titles_agree(a: str, b: str, a_cut: bool, b_cut: bool, more: int = 0) -> int:
    """2: the same words but for slips; 1: one is the beginning of the other; 0: neither. more: slips beyond the usual."""
    slips = (2 if min(len(a), len(b)) < 60 else 3) + more
    if near(a, b, slips if min(len(a), len(b)) >= 20 else 2 if min(len(a), len(b)) >= 7 else 0):
        return 2
    short, long, cut = (a, b, a_cut) if len(a) <= len(b) else (b, a, b_cut)
    if len(short.split()) < 5 or len(short) < 25:
        return 0
    head = long[: len(short)]
    if near(short, head, 2) and (cut or long[len(short) - 1 : len(short) + 2].find(" ") >= 0):
        return 1
    return 0


def titles_differ(a: str, b: str) -> bool:
    """Whether two titles under one DOI are of unlike works: not alike as far as the shorter one goes, however dirty."""
    n = min(len(a), len(b))
    return not near(a[:n], b[:n], max(n // 10, min(6, n // 3)))


def names_agree(a: list[str], b: list[str], a_cut: bool, b_cut: bool) -> bool | None:
    """None where one list is empty."""
    if not a or not b:
        return None
    if a_cut or b_cut or len(a) == len(b):
        n = min(len(a), len(b))
        return sum(near(x, y, 1) for x, y in zip(a[:n], b[:n], strict=True)) * 2 > n
    return len(set(a) & set(b)) * 2 >= min(len(a), len(b))


def words_agree(a: list[str], b: list[str], n: int) -> bool:
    """Whether of the first n words at most one in twenty differs, and none that has a digit."""
    left = n // 20
    for u, v in zip(a[:n], b[:n], strict=True):
        if u != v:
            left -= 1
            if left < 0 or any(c.isdigit() for c in u + v):
                return False
    return True


def abstracts_agree(a: str | None, b: str | None) -> int | None:
    """How many words agree, as far as the shorter one goes; 0 if they don't agree, None where one is missing.

    A few words may stand before either. At most one word in twenty may differ, and none that has a digit.
    """
    if a is None or b is None:
        return None
    x, y = a.split(), b.split()
    best = 0
    for skip in range(7):
        for p, q in ((x, y[skip:]), (x[skip:], y)):
            n = min(len(p), len(q)) - 1  # the last word may be cut
            if n >= 5 and n > best and words_agree(p, q, n):
                best = n
    return best


#: Words that abstracts must share to stand for a title; stock phrases are shorter.
OWN_WORDS = 18


def same_work(a, b) -> bool:
    """Whether two cleaned records describe one work.

    Never: notices and their subjects, unlike parts, unlike published DOIs, years more than two apart, unlike names. A
    shared DOI needs agreeing titles (or abstracts). General headings need agreeing names.
    """
    both = a.core is not None and b.core is not None
    if both and a.kind != b.kind:
        return False
    if a.part >= 0 and b.part >= 0 and a.part != b.part:
        return False
    doi = a.doi is not None and a.doi == b.doi
    if a.doi and b.doi and not doi and a.preprint == b.preprint and not (a.shared or b.shared):
        return False
    if a.year and b.year and abs(a.year - b.year) > 2:
        return False
    names = names_agree(a.names, b.names, a.names_cut, b.names_cut)
    if names is False:
        return False
    abstract = abstracts_agree(a.abstract, b.abstract)
    if not both:
        if abstract == 0:
            return False
        return (abstract or 0) >= OWN_WORDS or bool(abstract and names) or (doi and not a.shared)
    title = titles_agree(a.core, b.core, a.cut, b.cut, 3 if doi and not a.shared else 0)
    if not title:
        return False
    if len(a.core.split()) < 5 or len(b.core.split()) < 5:  # a general heading
        return abstract != 0 and bool(names or (abstract or 0) >= OWN_WORDS or (doi and not a.shared))
    if doi or abstract:
        return True
    if a.part != b.part:  # one cannot be seen
        return False
    if abstract == 0 and names is None:
        return False
    return bool(names) or title == 2 or bool(a.year and b.year and abs(a.year - b.year) <= 1)


class _Row:
    __slots__ = ("abstract", "core", "cut", "doi", "kind", "names", "names_cut", "part", "preprint", "shared", "year")


def _rows(b: pa.RecordBatch, side: str) -> list[_Row]:
    rows = []
    for values in zip(*(b.column(f"{side}_{c}").to_pylist() for c in (*TEXTS, "shared")), strict=True):
        r = _Row()
        r.core, r.kind, r.part, r.cut, r.names, r.names_cut, r.year, r.doi, r.preprint, r.abstract, r.shared = values
        rows.append(r)
    return rows


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = pa.array([same_work(x, y) for x, y in zip(_rows(b, "x"), _rows(b, "y"), strict=True)], pa.bool_())
        yield b.select(["i", "j"]).filter(keep)


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = b.column("core").to_pylist(), b.column("usual").to_pylist()
        yield b.select(["doi"]).filter(pa.array([titles_differ(t, u) for t, u in zip(x, y, strict=True)], pa.bool_()))


def volumes(titled: DataFrame) -> DataFrame:
    """The DOIs (doi) of unlike works. titled: (doi, core), both not null.

    Every title of a DOI is compared with its most frequent one, so that a work of many dirty copies stays one work. DOIs whose
    titles all begin with the same four words, or all go on with the same four, are left out beforehand.
    """
    words = F.split("core", " ")
    head, next_ = F.concat_ws(" ", F.slice(words, 1, 4)), F.concat_ws(" ", F.slice(words, 5, 4))
    titles = cut_lineage(titled.groupBy("doi", "core").agg(F.count(F.lit(1)).alias("n")))
    usual = titles.groupBy("doi").agg((F.min(head) != F.max(head)).alias("x1"), (F.min(next_) != F.max(next_)).alias("x2"), F.max_by("core", F.struct("n", F.length("core"), "core")).alias("usual"))
    unlike = titles.join(usual.filter("x1 and x2").select("doi", "usual"), "doi").filter("core <> usual")
    return unlike.select("doi", "core", "usual").mapInArrow(_differing, "doi string").distinct()


def candidate_pairs(keyed: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct pairs (i < j) of records that share a key. keyed: (rep, bare, key).

    Every key is paired as a whole, however many records share it. Opening words alone ("z|") pair records without a title
    with all others, not those with each other. With ``most`` (then keyed also has fine, an array of traits), a key of more
    unlike records is joined only together with an equal trait, which loses the pairs that share none.
    """
    keyed = cut_lineage(keyed)
    k = keyed.select("rep", "bare", "key")
    if most is not None:
        big = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("key")
        fine = keyed.join(big, "key").select("rep", "bare", "key", F.explode("fine").alias("f")).select("rep", "bare", F.concat_ws("|", "key", "f").alias("key"))
        k = k.join(big, "key", "left_anti").unionByName(fine)
    opening = F.col("key").startswith("z|")
    left, right = k.filter(~opening).select(F.col("rep").alias("i"), "key"), k.filter(~opening).select(F.col("rep").alias("j"), "key")
    pairs = left.join(right, "key").filter("i < j").select("i", "j")
    bare, any_ = k.filter(opening & F.col("bare")).select(F.col("rep").alias("a"), "key"), k.filter(opening).select(F.col("rep").alias("b"), "key")
    more = bare.join(any_, "key").filter("a <> b").select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    return pairs.unionByName(more).distinct()


TRAITS = ["part", "year", "core_len", "core_sign", *[f"core_{k}" for k in SIGNS["core"]]]
OPENING_TRAITS = ["part", "year", "core_len", "named", "words", "loose", *[f"words_{k}" for k in SIGNS["abstract"]]]


def _side(df: DataFrame, s: str, key: str, traits: list[str]) -> DataFrame:
    return df.select(F.col("rep").alias(f"{s}_rep"), F.col(key).alias("key"), *[F.col(t).alias(f"{s}_{t}") for t in traits])


def _apart(sign: str) -> Column:
    """Bits in which the signs of both sides differ."""
    return F.bit_count(F.col(f"x_{sign}").bitwiseXOR(F.col(f"y_{sign}")).cast("bigint").bitwiseAND(F.lit(-1 if sign == "core_sign" else 0xFFFFFFFF).cast("bigint")))


def _beginnings_apart(least: Column, name: str, kind: str) -> Column:
    """Bits in which the longest prefixes that both sides have differ; 0 if there is none."""
    out = F.lit(0)
    for k in SIGNS[kind]:
        out = F.when(least >= k, _apart(f"{name}_{k}")).otherwise(out)
    return out


def _may_agree() -> Column:
    """False only where ``same_work`` rejects by parts or years."""
    parts = (F.col("x_part") < 0) | (F.col("y_part") < 0) | (F.col("x_part") == F.col("y_part"))
    return parts & F.coalesce(F.abs(F.col("x_year") - F.col("y_year")) <= 2, F.lit(True))


def _titles_may_agree() -> Column:
    """False only where ``titles_agree`` is 0 without slips beyond the usual.

    Up to three slips change at most 12 bits of a sign; two slips and what they push over the end at most 10 of a prefix's.
    """
    least = F.least("x_core_len", "y_core_len")
    alike = (F.abs(F.col("x_core_len") - F.col("y_core_len")) <= 3) & (_apart("core_sign") <= 12)
    begins = (least >= 25) & (_beginnings_apart(least, "core", "core") <= 10)
    return F.col("x_core_len").isNull() | F.col("y_core_len").isNull() | alike | begins


def _abstracts_may_agree() -> Column:
    """False only where records with twelve opening words in common, one of them without a title, are rejected by abstracts.

    Of the shorter abstract's words (less the last) one in twenty may differ, which changes two bits each; a shift of up to
    six words, which only ``loose`` texts allow, changes twelve. Fewer than ``OWN_WORDS`` words need names.
    """
    least = F.least("x_words", "y_words") - 1
    bits = 2 * F.floor(least / 20) + F.when(F.col("x_loose"), 12).otherwise(0)
    return ((least >= OWN_WORDS) | (F.col("x_named") & F.col("y_named"))) & (_beginnings_apart(least, "words", "abstract") <= bits)


def likely_pairs(reps: DataFrame) -> DataFrame:
    """(i, j), i < j: all pairs that share a key (``candidate_pairs``), less those that ``same_work`` is sure to reject.

    reps: (rep, doi_key, keys, opening) and the traits. Every key is paired as a whole. What rejects a pair are numbers beside its
    key, so that neither texts nor rejected pairs are moved; pairs of one DOI, whose titles may differ more, are all kept.
    """
    keyed = reps.select("rep", *TRAITS, F.explode("keys").alias("key"))
    alike = _side(keyed, "x", "key", TRAITS).join(_side(keyed, "y", "key", TRAITS), "key").filter("x_rep < y_rep").filter(_may_agree() & _titles_may_agree())
    doi = reps.filter("doi_key is not null")
    named = _side(doi, "x", "doi_key", ["part", "year"]).join(_side(doi, "y", "doi_key", ["part", "year"]), "key").filter("x_rep < y_rep").filter(_may_agree())
    opens = reps.filter("opening is not null")
    x, y = _side(opens.filter("core_len is null"), "x", "opening", OPENING_TRAITS), _side(opens, "y", "opening", OPENING_TRAITS)
    bare = x.join(y, "key").filter("x_rep < y_rep or x_rep > y_rep and y_core_len is not null").filter(_may_agree() & _abstracts_may_agree())
    pairs = [p.select(F.least("x_rep", "y_rep").alias("i"), F.greatest("x_rep", "y_rep").alias("j")) for p in (alike, named, bare)]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct()


def work_groups(candidates: DataFrame) -> DataFrame:
    """(candidate_id, work_id): the smallest candidate_id of the records of the same work. Null ids are left out.

    Records without any usable field are works of their own. Repeated rows with one id count once.
    """
    c = candidates.filter("candidate_id is not null").select("candidate_id", "title", "authors", "year", "abstract", "doi")
    f = stored(c.mapInArrow(_features, FEATURES))
    digest = ["d1", "d2"]
    members = cut_lineage(f.groupBy("candidate_id").agg(F.min(F.struct(*digest)).alias("d")).select("candidate_id", "d.*"))
    if members.count() < f.count():  # rows with one id: one of them
        f = stored(f.join(members, ["candidate_id", *digest], "leftsemi").dropDuplicates(["candidate_id"]))
    own = cut_lineage(members.join(members.groupBy(*digest).agg(F.min("candidate_id").alias("rep")), digest).select("candidate_id", "rep"))
    volume = broadcast_if_small(volumes(f.filter("doi is not null and core is not null").select("doi", "core")).select("doi", F.lit(True).alias("volume")))
    again = broadcast_if_small(own.filter("candidate_id <> rep").select("candidate_id"))
    reps = f.join(again, "candidate_id", "leftanti").withColumnRenamed("candidate_id", "rep")
    pairs = cut_lineage(likely_pairs(reps.select("rep", "doi_key", "keys", "opening", *dict.fromkeys([*TRAITS, *OPENING_TRAITS]))))
    texts = f.select("candidate_id", *TEXTS).join(volume, "doi", "left").withColumn("shared", F.coalesce("volume", F.col("doi").contains("/proc."), F.lit(False)))
    side = lambda s, k: texts.select(F.col("candidate_id").alias(k), *[F.col(t).alias(f"{s}_{t}") for t in (*TEXTS, "shared")])
    links = pairs.join(side("x", "i"), "i").join(side("y", "j"), "j").mapInArrow(_verify, "i bigint, j bigint")
    # of each record the links to later ones are one entity
    edges = cut_lineage(links).select(F.col("i").alias("entity"), F.explode(F.array("i", "j")).alias("record")).distinct()
    labels = propagate(edges).select(F.col("record").alias("rep"), F.col("label").alias("work_id"))
    return own.join(labels, "rep", "left").select("candidate_id", F.coalesce("work_id", "rep").alias("work_id"))


def same_work_pairs(candidates: DataFrame) -> DataFrame:
    """(candidate_id_a, candidate_id_b), a < b: all pairs of records of one work."""
    g = cut_lineage(work_groups(candidates))
    a, b = g.select("work_id", F.col("candidate_id").alias("candidate_id_a")), g.select("work_id", F.col("candidate_id").alias("candidate_id_b"))
    return a.join(b, "work_id").filter("candidate_id_a < candidate_id_b").select("candidate_id_a", "candidate_id_b")


def survivors(candidates: DataFrame, trust: DataFrame) -> DataFrame:
    """One row per work: (work_id, records, candidate_id, title, doi, source, abstract).

    candidate_id is the record that ranks first by completeness, trust, recency and id. title, doi, source and abstract are
    each the first usable value in an order of their own: whole before in capitals only before cut off and more words, published before
    preprint DOI, longer abstract; then trust, recency and id. Values that stand for a missing one are null.
    """
    g = work_groups(candidates)
    c = candidates.filter("candidate_id is not null").dropDuplicates(["candidate_id"])
    src = F.regexp_replace(F.trim(F.lower("source")), r"[\s\-]+", "_")
    t = trust.filter("source is not null").groupBy(F.regexp_replace(F.trim(F.lower("source")), r"[\s\-]+", "_").alias("src")).agg(F.min("trust_rank").alias("trust"))
    usable = lambda col: F.when(~F.lower(F.trim(F.col(col))).isin(sorted(NO_VALUE)), F.trim(F.regexp_replace(F.regexp_replace(F.col(col), r"</?[a-zA-Z][^<>]{0,40}>", ""), r"\s+", " ")))
    title = F.regexp_replace(usable("title"), r"^\[(.*)\]$", "$1")
    abstract = F.when(~F.lower(F.trim("abstract")).rlike(r"^(no abstract|abstract unavailable|abstract not available|see full text|not available)"), F.regexp_replace(usable("abstract"), r"(?i)^abstract\s*[:.]\s*", ""))
    doi = F.regexp_extract(F.regexp_replace(F.lower(F.trim("doi")), "%2f", "/"), r"(10\.[0-9]{4,9}/[^\s]*[^\s.,;)])", 1)
    doi = F.when((doi != "") & ~doi.rlike(r"^10\.0+/0*$"), doi)
    x = c.select("candidate_id", title.alias("t"), abstract.alias("a"), doi.alias("d"), src.alias("src"), "fetched_at").join(g, "candidate_id").join(t, "src", "left")
    last = F.lit(1 << 30)
    full = sum(F.col(k).isNotNull().cast("int") for k in ("t", "a", "d", "src"))
    x = x.withColumn("full", full).withColumn("trust", F.coalesce("trust", last))
    x = x.withColumn("age", -F.unix_micros(F.coalesce(F.col("fetched_at").cast("timestamp"), F.to_timestamp(F.lit("1970-01-01 00:00:00")))))
    whole = F.when(F.col("t").rlike("(…|\\.\\.\\.)$"), 2).when((F.upper("t") == F.col("t")) | (F.lower("t") == F.col("t")), 1).otherwise(0)
    order = lambda *first: F.struct(*[e.alias(f"k{i}") for i, e in enumerate(first)], "trust", "age", "candidate_id")
    best = lambda v, *first: F.min_by(v, F.when(F.col(v).isNotNull(), order(*first))).alias(v)
    fields = x.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("records"),
        best("t", whole, -F.regexp_count("t", F.lit(r"[\p{L}\p{N}]+"))),
        best("d", F.col("d").contains("/pre.").cast("int")),
        best("src", F.lit(0)),
        best("a", -F.length("a")),
    )
    w = Window.partitionBy("work_id").orderBy(F.desc("full"), "trust", "age", "candidate_id")
    top = x.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("work_id", "candidate_id")
    return top.join(fields, "work_id").select("work_id", "records", "candidate_id", F.col("t").alias("title"), F.col("d").alias("doi"), F.col("src").alias("source"), F.col("a").alias("abstract"))
