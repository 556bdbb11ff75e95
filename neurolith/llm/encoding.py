"""Finding and restoring text that was decoded with the wrong character encoding.

Two kinds of swaps are undone: pairs of listed encodings, multi-byte ones among them, and mappings of single characters that
are learned for a source from what the listed pairs leave unexplained (``ciphers``).

A swap of code pages is a substitution cipher: every byte of the true encoding is shown as another encoding's character.
Which swap took place is unknown and differs by source. The swaps' weights per source and the language's bigrams are
learned together by expectation-maximization: given the bigrams, the runs of non-ASCII characters of a record speak for or
against each swap (expectation); given those, weights and bigrams are counted anew, now of the restored runs
(maximization). Restoring translates the runs of a record by the swap that wins there.

What travels to the driver is bounded by the alphabet (bigrams of folded symbols) and by sources x swaps.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurolith.functions.distributed import broadcast_if_small, cut_lineage
from neurolith.llm import ciphers

# Encodings that texts are written in or taken for.
SINGLE = ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "koi8_r", "iso8859_5")
DOUBLE = ("gb18030", "big5")
HAN_CLASS = r"　-〿぀-ヿ㄀-ㄯ㈀-㋿㐀-䶿一-鿿가-힣豈-﫿︰-﹏！-￮-"
HAN = re.compile(f"[{HAN_CLASS}]")
CLASS_RUN = re.compile(rf"[{HAN_CLASS}]+|[^\x00-\x7f\ufffd{HAN_CLASS}]+")
UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
LOST = "�"
#: Characters of no sound text: lost, private or control ones (the NULs of UTF-16 among them).
BROKEN = re.compile(r"[�\x00-\x08\x0e-\x1a\x1c-\x1f\x7f-\x84\x86-\x9f\ue000-\uf8ff]")
NOT_SOUND = re.compile(r"[�\x00-\x08\x0e-\x1a\x1c-\x1f\ue000-\uf8ff]")
SOUND_ASCII = r"^[\t\n\f\r\x20-\x7e]*$"
#: Taken off every count, so that a run seen once doesn't speak for itself.
DISCOUNT = 0.9
#: Most that a step can add to a log probability.
MOST_STEP = 0.7


@lru_cache(maxsize=None)
def to_bytes(codec: str) -> dict[int, int]:
    """Character to byte of a single-byte encoding; bytes it leaves undefined stand for the C1 controls.

    cp1252 also takes the controls that Latin-1 shows."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            table[b] = b
    if codec == "cp1252":
        for b in range(0x80, 0xA0):
            table.setdefault(b, b)
    return table


@lru_cache(maxsize=None)
def to_chars(codec: str) -> dict[int, int]:
    """Byte to character; undefined bytes are missing."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = ord(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            continue
    return out


@lru_cache(maxsize=None)
def cipher(read: str, true: str) -> dict[int, int]:
    """Shown character to written character, for two single-byte encodings."""
    back = to_chars(true)
    return {c: back[b] for c, b in to_bytes(read).items() if b in back}


SWAPS = tuple(
    [(r, "utf_8") for r in (*SINGLE, "gb18030", "big5")]
    + [(r, t) for r in SINGLE for t in SINGLE if r != t]
    + [(r, t) for r in ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "koi8_r", "cp850", "big5") for t in ("gb18030",)]
    + [(r, "big5") for r in ("cp1252", "gb18030", "mac_roman")]
)


#: Number of a source's learned mapping among the swaps, and the odds that it took place in a record.
LEARNED, LEARNED_ODDS = len(SWAPS), 0.05
#: Sources that have weights and mappings of their own; more are pooled by hash, so that what the driver holds is bounded.
MOST_SOURCES = 4096


def name_of(k: int) -> str:
    return "learned" if k == LEARNED else "/".join(SWAPS[k])


def _shown_bytes(run: str, read: str) -> bytes | None:
    if read in DOUBLE:
        try:
            return run.encode("gbk" if read == "gb18030" else read)
        except UnicodeEncodeError:
            return None
    table = to_bytes(read)
    try:
        return bytes(table[ord(c)] for c in run)
    except KeyError:
        return None


def undo(run: str, swap: tuple[str, str]) -> str | None:
    """The run as it was written if ``swap`` took place; None if it cannot have.

    Of a run read by a single-byte encoding, stretches that are valid UTF-8 are restored and the rest is kept.
    """
    read, true = swap
    if read in SINGLE and true in SINGLE:
        table = cipher(read, true)
        return run.translate(table) if all(ord(c) in table for c in run) else None
    raw = _shown_bytes(run, read)
    if raw is None:
        return None
    if true == "utf_8":
        if not UTF8.search(raw):
            return None
        if read in SINGLE:
            out, at = [], 0
            for m in UTF8.finditer(raw):
                try:
                    good = m.group().decode("utf-8")
                except UnicodeDecodeError:
                    return None
                out += [run[at : m.start()], good]
                at = m.end()
            return "".join([*out, run[at:]])
        # the longest middle part that is valid; a cut lead or trail byte at the ends is lost
        m = max(UTF8.finditer(raw), key=lambda m: m.end() - m.start())
        if m.end() - m.start() < 0.6 * len(raw):
            return None
        try:
            head, tail = raw[: m.start()].decode("gbk" if read == "gb18030" else read, "replace"), raw[m.end() :].decode("gbk" if read == "gb18030" else read, "replace")
            return head + m.group().decode("utf-8") + tail
        except UnicodeDecodeError:
            return None
    try:
        return raw.decode(true)
    except UnicodeDecodeError:
        if len(raw) > 3:  # one byte of a pair was lost at an end
            for cut in (raw[1:], raw[:-1]):
                try:
                    return cut.decode(true)
                except UnicodeDecodeError:
                    continue
        return None


def undo_all(run: str, swap: tuple[str, str], times: int = 3) -> str | None:
    """Like undo, again while the same swap still applies to what was shown (text encoded several times)."""
    out = undo(run, swap)
    while out is not None and swap[1] == "utf_8" and swap[0] in SINGLE and times > 1:
        again = "".join(undo(m.group(), swap) or m.group() for m in re.finditer(r"[^\x00-\x7f]+", out))
        if again == out:
            break
        out, times = again, times - 1
    return out


def fold(cp: int) -> int:
    """Symbol of a character in the bigrams: ASCII letters without case, one digit, one symbol for Han, for Hangul and
    for private characters; all others themselves."""
    if cp < 128:
        return cp + 32 if 65 <= cp <= 90 else 48 if 48 <= cp <= 57 else cp
    if 0x3400 <= cp <= 0x4DBF or 0x4E00 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF or cp >= 0x20000:
        return 0x4E00
    if 0xAC00 <= cp <= 0xD7A3:
        return 0xAC00
    if 0xE000 <= cp <= 0xF8FF:
        return 0xE000
    return cp


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    return np.array([fold(c) for c in range(0x20000)] + [0x4E00], np.int64)


class Language:
    """Bigrams of folded symbols, and how often each Han character occurs."""

    def __init__(self, single: dict[int, float], pair: dict[tuple[int, int], float], han: dict[int, float]):
        self.single, self.pair, self.han = single, pair, han
        self.all_han = sum(han.values()) + 1.0
        self.after: Counter = Counter()  # distinct symbols after a symbol, and before one
        self.ahead: Counter = Counter()
        for (x, y), n in pair.items():
            if n > 0.5:
                self.after[x] += 1
                self.ahead[y] += 1
        self.kinds = sum(self.ahead.values()) + 1.0
        self.known: dict[tuple[int, int], float] = {}

    def step(self, a: int, b: int) -> float:
        """Log probability of character b after character a: discounted counts, and what the discount took from all pairs
        of a spread by how many symbols b follows."""
        if (a, b) in self.known:
            return self.known[a, b]
        x, y = fold(a), fold(b)
        n = self.pair.get((x, y), 0.0)
        rest = (DISCOUNT * self.after[x] + 0.5) * (self.ahead[y] + 0.01) / self.kinds
        p = (max(n - DISCOUNT, 0.0) + rest) / (max(self.single.get(x, 0.0), n, 0.0) + 1.0)
        if y == 0x4E00:
            p *= (max(self.han.get(b, 0.0) - DISCOUNT, 0.0) + 0.02) / self.all_han
        elif y in (0xAC00, 0xE000):
            p *= 1e-3
        out = min(math.log(max(p, 1e-18)), MOST_STEP)
        if len(self.known) < 500_000:
            self.known[a, b] = out
        return out

    def score(self, before: str, run: str, after: str, least: float = -math.inf) -> float:
        """Log probability of a run between two characters; anything below ``least`` once it cannot reach that any more (a step
        adds at most ``MOST_STEP``)."""
        known, last, total = self.known, ord(before), 0.0
        slack = least - MOST_STEP * (len(run) + 1)
        for c in (*map(ord, run), ord(after)):
            p = known.get((last, c))
            total += self.step(last, c) if p is None else p
            slack += MOST_STEP
            if total < slack:
                break
            last = c
        return total


@lru_cache(maxsize=1)
def by_reading() -> dict[bool, list[tuple[str, list[int]]]]:
    """Numbers of the swaps by the encoding that was read, those of Han and the like (True) apart."""
    out: dict[bool, dict[str, list[int]]] = {True: {}, False: {}}
    for k, (read, _) in enumerate(SWAPS):
        out[read in DOUBLE].setdefault(read, []).append(k)
    return {han: list(v.items()) for han, v in out.items()}


def gains(language: Language, weights: dict[int, float], before: str, run: str, after: str) -> dict[int, tuple[float, str]]:
    """Of each swap that improves the run: log odds against the run as it is (without the swap's weight), and the text."""
    out = {}
    own = None
    points = set(map(ord, run))
    for read, numbers in by_reading()[bool(HAN.match(run))]:
        if read in SINGLE and not to_bytes(read).keys() >= points:
            continue
        for k in numbers:
            if k not in weights:
                continue
            true = SWAPS[k][1]
            if read in SINGLE and true in SINGLE:
                table = cipher(read, true)
                text = run.translate(table) if table.keys() >= points else None
            elif read in SINGLE and len(run) == 1:  # one byte above ASCII is no character of a multi-byte encoding
                continue
            else:
                text = undo_all(run, SWAPS[k])
            if text is None or text == run:
                continue
            own = language.score(before, run, after) if own is None else own
            gain = language.score(before, text, after, own) - own
            if gain > 0:
                out[k] = (gain, text)
    return out


def runs_of(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs: non-ASCII characters, Han and the like apart from all others."""
    for m in CLASS_RUN.finditer(text):
        yield m.span()


QUOTE_AROUND = re.compile(r"[\s\"'“”„«»‘’()\[\]]")


def apart(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] stands between blanks, brackets or quotation marks."""
    return (a == 0 or bool(QUOTE_AROUND.match(text[a - 1]))) and (b == len(text) or bool(QUOTE_AROUND.match(text[b])))


COUNTS = "kind string, source string, a bigint, b bigint, n double"
COLUMNS = ["kind", "source", "a", "b", "n"]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Symbols, bigrams with a non-ASCII symbol (by source), and Han characters, each text by its share.

    Texts with characters of no sound text are left out, and so are signs that stand apart (often quoted garble)."""
    table = fold_table()
    for b in batches:
        single: Counter = Counter()
        pairs: dict[str, Counter] = defaultdict(Counter)
        han: Counter = Counter()

        def add(to: Counter, v: np.ndarray, n: np.ndarray, share: float) -> None:
            to.update(dict(zip(v.tolist(), (n if share == 1.0 else n * share).tolist(), strict=True)))

        for source, text, share in zip(b["source"], b["text"], b["share"], strict=True):
            if BROKEN.search(text):  # surely garbled: nothing to learn the language from
                continue
            pair = pairs[source]
            cp = np.frombuffer(("\n" + text + "\n").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
            sym = table[np.minimum(cp, 0x20000)]
            add(single, *np.unique(sym, return_counts=True), share)
            at = np.flatnonzero((cp[:-1] > 127) | (cp[1:] > 127))
            if not at.size:
                continue
            add(pair, *np.unique(sym[at] << 21 | sym[at + 1], return_counts=True), share)
            add(han, *np.unique(cp[sym == 0x4E00], return_counts=True), share)
            for s, e in runs_of(text):
                if e - s > 1 and not text[s:e].isalpha() and not HAN.match(text[s]) and apart(text, s, e):
                    shown = [fold(ord(c)) for c in text[s - 1 : e + 1]] if s and e < len(text) else []
                    for x, y in zip(shown[:-1], shown[1:], strict=True):
                        pair[x << 21 | y] -= share
                    for x in shown[1:-1]:
                        single[x] -= share
        rows = [("single", None, k, 0, n) for k, n in single.items()]
        rows += [("pair", s, k >> 21, k & 0x1FFFFF, n) for s, pair in pairs.items() for k, n in pair.items()]
        rows += [("han", None, k, 0, n) for k, n in han.items()]
        yield pd.DataFrame(rows, columns=COLUMNS).astype({"n": float})


class Model:
    """Language, the weights of swaps per source (other: of all sources), the swaps shown by more than two characters, and the
    learned mappings of sources."""

    def __init__(self, language: Language, weights: dict[str, dict[int, float]], other: dict[int, float], shown: set[int] = frozenset(), tables: dict[str, dict[int, int]] | None = None):
        self.language, self.weights, self.other, self.shown, self.tables = language, weights, other, shown, tables or {}
        self.seen: dict[tuple[str, str, str], dict[int, tuple[float, str]]] = {}
        self.stamp = uuid.uuid4().hex

    def __getstate__(self):
        return self.stamp, (self.language.single, self.language.pair, self.language.han), self.weights, self.other, self.shown, self.tables

    def __setstate__(self, state):
        stamp, counts, *rest = state
        if stamp not in LAST_MODEL:  # the tasks of a worker share what they found out
            self.__init__(Language(*counts), *rest)
            self.stamp = stamp
            LAST_MODEL.clear()
            LAST_MODEL[stamp] = self
        self.__dict__ = LAST_MODEL[stamp].__dict__


LAST_MODEL: dict[str, Model] = {}
OPENING, CLOSING = "“„«\"‘'‚", "”“»\"’'"


def quoted(text: str, s: int, e: int, restored: str) -> bool:
    """Whether a run only quotes a garbled sequence: it fills quotation marks, or it stands alone and what it stands for is
    written soundly nearby."""
    run = text[s:e]
    if len(run) > 2 and run[0] in OPENING and run[-1] in CLOSING:
        s, e, run = s + 1, e - 1, run[1:-1]
        restored = restored[1:-1]
        marked = True
    else:
        marked = s > 0 and e < len(text) and text[s - 1] in OPENING and text[e] in CLOSING
    if len(run) > 6 or HAN.match(run):
        return False
    return marked or (apart(text, s, e) and restored != "" and restored in text[max(0, s - 60) : s] + "\n" + text[e : e + 60])


def wide(text: str) -> str:
    """Text of two-byte units that was read byte by byte: stretches around NULs are read again as units, in the byte order
    that gives the more common characters."""

    def again(m: re.Match) -> str:
        shown = m.group()
        best = shown.replace("\0", "")
        for codec in ("utf-16-le", "utf-16-be"):
            for lead in (0, 1):
                raw = shown[lead:].encode("latin-1")
                try:
                    out = shown[:lead] + raw[: len(raw) // 2 * 2].decode(codec) + shown[lead + len(raw) // 2 * 2 :]
                except UnicodeDecodeError:
                    continue
                if sum(c.isalnum() or c in " \n.,:;%-–’" for c in out) > sum(c.isalnum() or c in " \n.,:;%-–’" for c in best):
                    best = out
        return best

    return re.sub(r"[\x00-\xff]*\0[\x00-\xff]*", again, text).replace("ÿþ", "").replace("\ufeff", "")


def readings(run: str) -> list[str]:
    """What a short run may stand for if it was UTF-8."""
    return [r for r in (undo(run, (c, "utf_8")) for c in SINGLE) if r] if 2 <= len(run) <= 6 else []


#: What a run that a swap doesn't improve speaks against a stretch that holds it.
AGAINST = 4.0
Found = list[tuple[tuple[int, int], dict[int, tuple[float, str]]]]


def odds(found: Found, w: dict[int, float]) -> dict[int, float]:
    """Per swap the log odds that it took place: its best stretch of runs, against the swap's weight."""
    now: dict[int, float] = {}
    most: dict[int, float] = {}
    for _, g in found:
        for k in [k for k in now if k not in g]:
            now[k] -= AGAINST
            if now[k] <= 0:
                del now[k]
        for k, (gain, _) in g.items():
            v = now.get(k, 0.0) + gain - 1.0
            if v > 0:
                now[k] = v
                most[k] = max(most.get(k, 0.0), v)
            else:
                now.pop(k, None)
    return {k: v + math.log(w.get(k, LEARNED_ODDS)) for k, v in most.items()}


def beside_lost(text: str, s: int, e: int) -> bool:
    """Whether text[s:e] stands next to a lost or control character."""
    return bool(NOT_SOUND.match(text[s - 1 : s]) or NOT_SOUND.match(text[e : e + 1]))


def weigh(model: Model, source: str | None, text: str) -> tuple[Found, dict[int, float]]:
    """Per run what each swap gains, and per swap the log odds that it took place in this record.

    A swap happens to a stretch: the gains of neighbouring runs are added up, each less 1, runs that it doesn't improve
    speak against it, and the best stretch counts, against the swap's weight. Runs that only quote, and runs next to a lost or
    control character, where nothing is sure, are passed over.
    """
    found: Found = []
    table = model.tables.get(source)
    lost = bool(NOT_SOUND.search(text))
    framed = f"\n{text}\n"
    seen = model.seen
    some = False
    for m in CLASS_RUN.finditer(text):
        s, e = m.span()
        if lost and beside_lost(text, s, e):
            continue
        key = (framed[s], m.group(), framed[e + 1])
        g = seen.get(key)
        if g is None:
            g = gains(model.language, model.other, *key)
            if len(seen) < 300_000 and e - s < 40:
                seen[key] = g
        if table and not HAN.match(key[1]) and (read := key[1].translate(table)) != key[1]:
            gain = model.language.score(key[0], read, key[2]) - model.language.score(*key)
            g = {**g, LEARNED: (gain, read)} if gain > 0 else g
        if g:
            if any(quoted(text, s, e, restored) for restored in [r for _, r in g.values()] + readings(key[1])):
                continue
            some = True
        found.append(((s, e), g))
    return found, odds(found, model.weights.get(source, model.other)) if some else {}


def stretches(found: Found, k: int, least: float = 3.0) -> list[int]:
    """Indexes of the runs to restore: those that swap k improves, in stretches that gain at least ``least``."""
    out: list[int] = []
    start, v, peak, end = 0, 0.0, 0.0, 0
    for i in range(len(found) + 1):
        gain = -math.inf if i == len(found) else found[i][1][k][0] - 1.0 if k in found[i][1] else -AGAINST
        if v <= 0 < gain:
            start, v, peak = i, 0.0, 0.0
        v += gain
        if v > peak:
            peak, end = v, i
        if v <= 0:
            if peak >= least:
                out += [j for j in range(start, end + 1) if k in found[j][1]]
            v = peak = 0.0
    return out


def lone(found: Found, k: int) -> bool:
    """Whether two restored characters, however often (such as a pair of quotation marks), are all that speaks for a swap."""
    return sum(map(len, {found[i][1][k][1] for i in stretches(found, k)})) <= 2


def judge(model: Model, source: str | None, text: str, least: float = 1.0) -> tuple[bool, str, str | None]:
    """(garbled, restored text, swaps) of one text; swaps in the order of their evidence, joined by "+".

    Garbled if the swaps' odds together exceed e^``least``. A replacement,
    private or control character is evidence enough, though what it stood for is lost. The best swap is applied to its
    stretches, then the best of what is left, as long as its own odds exceed e^``least``. Runs next to a lost character are
    restored as far as possible by the swaps found elsewhere in the record.
    """
    lost = bool(NOT_SOUND.search(text))
    units = "\0" in text
    if units:
        text = wide(text)
    names = ["cp1252/utf_16"] if units else []
    found, total = ([], {}) if text.isascii() else weigh(model, source, text)
    best = max(total, key=total.get, default=None)
    if best is None or total[best] + math.log(sum(math.exp(t - total[best]) for t in total.values())) < least:
        return lost, text, names[0] if names else None
    w = model.weights.get(source, model.other)
    instead: dict[tuple[int, int], str] = {}
    used = [best]
    while improved := set(stretches(found, best)):
        instead |= {found[i][0]: found[i][1][best][1] for i in improved}
        found = [f for i, f in enumerate(found) if i not in improved]
        total = odds(found, w)
        best = max(total, key=total.get, default=None)
        if best is None or total[best] < least:
            break
        used += [best] if best not in used else []
    for s, e in runs_of(text) if instead else ():
        if not beside_lost(text, s, e):
            continue
        known = {k: w[k] for k in used if k != LEARNED}
        part = gains(model.language, known, text[s - 1] if s else "\n", text[s:e], text[e] if e < len(text) else "\n")
        if part:
            instead[s, e] = max(part.values())[1]
    out, at = [], 0
    for (s, e), good in sorted(instead.items()):
        out += [text[at:s], good]
        at = e
    return True, "".join([*out, text[at:]]), "+".join([*names, *map(name_of, used)])


def _expect(model: Model):
    """Expectation over records: uses of each swap by source, and the change of the bigrams by the restored runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            uses: Counter = Counter()
            pair: Counter = Counter()
            single: Counter = Counter()
            han: Counter = Counter()
            source: str | None = None

            def add(before: str, text: str, after: str, n: float) -> None:
                s = [ord(before), *map(ord, text), ord(after)]
                f = [fold(c) for c in s]
                for x, y in zip(f[:-1], f[1:], strict=True):
                    pair[source, x, y] += n
                for c, x in zip(s[1:-1], f[1:-1], strict=True):
                    single[x] += n
                    if x == 0x4E00:
                        han[c] += n

            for source, text, share in zip(b["source"], b["text"], b["share"], strict=True):
                found, total = weigh(model, source, text)
                whole = sum(math.exp(min(60.0, t)) for t in total.values())
                best = max(total, key=total.get, default=None)
                if best is None:
                    continue
                # below even odds: records of which each has but one garbled run would else back each other. UTF-8 proves
                # itself by its form; another swap must have been shown by more than two characters somewhere
                alone = lone(found, best)
                if math.log(whole) < (-4.0 if SWAPS[best][1] == "utf_8" else -1.5 if best in model.shown else 4.0 * alone):
                    continue
                uses["lone" if alone else "use", source, best] += share
                if BROKEN.search(text):  # these are not among the counts that are changed here
                    continue
                for i in stretches(found, best):
                    (s, e), g = found[i]
                    before, after = text[s - 1] if s else "\n", text[e] if e < len(text) else "\n"
                    add(before, text[s:e], after, -share)
                    add(before, g[best][1], after, share)
            rows = [(kind, s, k, 0, n) for (kind, s, k), n in uses.items()]
            rows += [("pair", s, x, y, n) for (s, x, y), n in pair.items()]
            rows += [("single", None, x, 0, n) for x, n in single.items()]
            rows += [("han", None, x, 0, n) for x, n in han.items()]
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"n": float})

    return run


def _summed(*parts: DataFrame) -> dict[str, dict]:
    """Counts of all sources together: at most an alphabet's symbols and pairs of them."""
    out: dict[str, dict] = {"single": {}, "pair": {}, "han": {}}
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    for r in whole.filter("kind in ('single', 'pair', 'han')").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["kind"]][(r["a"], r["b"]) if r["kind"] == "pair" else r["a"]] = r["n"]
    return out


def learned_tables(left: DataFrame, now: dict[str, dict]) -> dict[str, dict[int, int]]:
    """The learned mapping of each source that has one, from the pairs that the listed swaps leave (source, a, b, n); changes the
    bigrams in ``now`` accordingly."""
    single, pair, whole = now["single"], now["pair"], sum(now["pair"].values())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table, changes = ciphers.learn_table(pdf, single, pair, whole)
        rows = [("map", pdf["source"].iloc[0], a, b, 0.0) for a, b in table.items()] + [("pair", pdf["source"].iloc[0], a, b, n) for a, b, n in changes.itertuples(index=False)]
        return pd.DataFrame(rows, columns=COLUMNS).astype({"a": "int64", "b": "int64", "n": float})

    tables: dict[str, dict[int, int]] = defaultdict(dict)
    for r in left.groupBy("source").applyInPandas(run, COUNTS).toLocalIterator():
        a, b, n = r["a"], r["b"], r["n"]
        if r["kind"] == "map":
            tables[r["source"]][a] = b
        else:
            pair[a, b] = pair.get((a, b), 0.0) + n
            single[a] = single.get(a, 0.0) + (n if a > 127 else 0.0)
    return dict(tables)


def learn(texts: DataFrame, rounds: int = 4, prior: float = 0.02) -> Model:
    """Fits the model to all texts (source, text[, share: how much a text counts, 1 by default]), none null.

    Every round is one pass over the texts that are not plain ASCII. A swap's weight is the share of a source's records that
    it explains, drawn towards its share of all records. Swaps that explain no record are dropped after the second round,
    when the bigrams have settled. Ends early if a round changes nothing. At last, mappings are learned from what is left.
    """
    texts = texts if "share" in texts.columns else texts.withColumn("share", F.lit(1.0))
    texts = texts.select("source", "text", "share")
    plain = F.col("text").rlike(SOUND_ASCII)
    counts = cut_lineage(texts.mapInPandas(_count, COUNTS).groupBy("kind", "source", "a", "b").agg(F.sum("n").alias("n")))
    base = _summed(counts)
    sizes = {r["source"]: r["n"] for r in texts.groupBy("source").agg(F.sum("share").alias("n")).toLocalIterator()}
    whole = sum(sizes.values()) or 1
    checked = [k for k, (_, true) in enumerate(SWAPS) if true == "utf_8"]  # bytes that are valid UTF-8 hardly arise by chance
    other = {k: prior / 2 / len(checked) if k in checked else prior / 2 / (len(SWAPS) - len(checked)) for k in range(len(SWAPS))}
    model = Model(Language(base["single"], base["pair"], base["han"]), {}, other)
    last: dict[str, dict[int, float]] = {}
    now, got = base, counts
    for i in range(rounds):
        got = cut_lineage(texts.filter(~plain).mapInPandas(_expect(model), COUNTS).groupBy("kind", "source", "a", "b").agg(F.sum("n").alias("n")))
        now = _summed(counts, got)
        uses: dict[str, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        shown = set()
        for r in got.filter("kind in ('use', 'lone')").toLocalIterator():
            uses[r["source"]][r["a"]] += r["n"]
            shown |= {r["a"]} if r["kind"] == "use" else set()
        used = {k: sum(u.get(k, 0.0) for u in uses.values()) if k in shown else 0.0 for k in other}
        if i >= 1:
            used = {k: n for k, n in used.items() if n > 0.5}
        other = {k: (n + 0.05) / (whole + 1.0) for k, n in used.items()}
        weights = {s: {k: (uses[s].get(k, 0.0) * (k in shown) + 50.0 * w) / (n + 50.0) for k, w in other.items()} for s, n in sizes.items()}
        model = Model(Language(now["single"], now["pair"], now["han"]), weights, other, shown)
        if i >= 2 and uses == last:  # nothing moves any more
            break
        last = uses
    left = counts.unionByName(got).filter("kind = 'pair'").groupBy("source", "a", "b").agg(F.sum("n").alias("n"))
    tables = learned_tables(left, now)
    return Model(Language(now["single"], now["pair"], now["han"]), model.weights, model.other, model.shown, tables) if tables else model


RESULT = "table_name string, record_id string, garbled boolean, restored string, swap string"


def _apply(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, i, source, text in zip(b["table_name"], b["record_id"], b["source"], b["text"], strict=True):
                garbled, restored, swap = judge(model, source, text)
                if garbled:
                    rows.append((t, i, True, restored, swap))
            yield pd.DataFrame(rows, columns=["table_name", "record_id", "garbled", "restored", "swap"])

    return run


def texts_of(chunks: DataFrame, materials: DataFrame) -> DataFrame:
    """(table_name, record_id, source, text). The source is the table and the first part of a chunk's path."""
    c = chunks.select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("record_id"), F.concat(F.lit("chunks/"), F.coalesce(F.substring_index("source", "/", 1), F.lit(""))).alias("source"), F.col("content").alias("text"))
    m = materials.select(F.lit("paper_materials").alias("table_name"), F.col("material_id").alias("record_id"), F.lit("paper_materials").alias("source"), F.col("paper_text").alias("text"))
    return c.unionByName(m).filter("text is not null and text <> '' and record_id is not null")


def garbled(texts: DataFrame) -> DataFrame:
    """(table_name, record_id, garbled, restored, swap) of the garbled records; swap null: only lost characters.

    A text delivered again with the same id counts once in all while learning (each delivery by its part), is judged each time and
    listed once per content. Null and empty texts are sound. The model is fitted to all texts; plain ASCII texts take part in the
    bigrams and are sound.
    """
    sources = texts.select("source").distinct().limit(MOST_SOURCES + 1).count()
    if sources > MOST_SOURCES:
        texts = texts.withColumn("source", F.concat(F.lit("pool/"), F.pmod(F.xxhash64("source"), F.lit(MOST_SOURCES)).cast("string")))
    # texts delivered again are told by narrow rows, so that no text is shuffled
    key = F.xxhash64("table_name", "record_id", "text")
    again = cut_lineage(texts.select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"))
    shared = texts.withColumn("key", key).join(broadcast_if_small(again), "key", "left").withColumn("share", 1.0 / F.coalesce("times", F.lit(1)))
    model = learn(shared.select("source", "text", "share"))
    return texts.filter(~F.col("text").rlike(SOUND_ASCII)).mapInPandas(_apply(model), RESULT).dropDuplicates(["table_name", "record_id", "restored"])
