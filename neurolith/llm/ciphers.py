"""Learning the mapping of an unknown code-page swap: which letter each character that a source shows stands for.

A single-byte swap is a substitution cipher. Its mapping is fitted per source by expectation-maximization on counts of neighbouring
characters against the bigrams of all other sources: a letter follows another as the language has it, and every letter is shown by
characters of some distribution. Given these, each counted pair is shared out among the pairs of letters that may have been
shown (expectation), and the shares give the distributions anew (maximization). Known code pages are some of the starting points, the
rest are random; any mapping can come out. One is kept only if what it makes of the source reads about as well as the language
does, and what is shown does not.
"""

from __future__ import annotations

import codecs
from functools import lru_cache

import numpy as np
import pandas as pd

#: Least occurrences of a shown character in its source, and of a letter elsewhere.
LEAST_SHOWN, LEAST_LETTER = 5, 20
#: How many times as often a shown character must be in its source as in all others together.
OWN = 20.0
#: Letters and shown characters that a table may have, by how often they occur; single-byte pages have 128 of them.
MOST = 256
ROUNDS, STARTS, RANDOM_STARTS = 200, 8, 16
#: A kept character's letter has at least this share; at least so many characters, and this part of all occurrences, are kept.
SURE, FEWEST, COVERED = 0.7, 5, 0.8
#: Log probability per pair by which a mapping may read worse than the language, and must read better than what is shown.
WORSE, BETTER = 1.0, 2.0
#: What symbols stand for many characters (Han, Hangul, private ones) in the bigrams, and are no part of a table.
GROUPED = (0x4E00, 0xAC00, 0xE000)


@lru_cache(maxsize=1)
def pages() -> dict[str, dict[int, int]]:
    """Single-byte code pages that the interpreter has: byte to character, of the upper half."""
    names = [f"cp{n}" for n in range(37, 1300)] + [f"iso8859_{n}" for n in range(1, 17)]
    names += [f"mac_{x}" for x in ("roman", "cyrillic", "greek", "latin2", "iceland", "turkish", "croatian", "romanian")] + [f"koi8_{x}" for x in "rut"]
    out = {}
    for name in names:
        try:
            if codecs.lookup(name) and bytes(range(0x20, 0x7F)).decode(name) != bytes(range(0x20, 0x7F)).decode("ascii"):
                continue
            shown = bytes(range(0x80, 0x100)).decode(name, "replace")
        except (LookupError, UnicodeDecodeError):
            continue
        if len(shown) == 128:
            out[name] = {0x80 + i: ord(c) for i, c in enumerate(shown) if c != "�"}
    return out


def starts(shown: np.ndarray, letters: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Mappings (index of a letter per shown character, -1 for none) of pairs of known pages that explain the most occurrences."""
    at = {int(c): i for i, c in enumerate(letters)}
    found: dict[tuple, float] = {}
    for read in pages().values():
        back = {c: b for b, c in read.items()}
        own = [back.get(int(c)) for c in shown]
        if sum(b is not None for b in own) < 0.5 * len(own):
            continue
        for true in pages().values():
            m = tuple(at.get(true.get(b, -1), -1) if b is not None else -1 for b in own)
            found[m] = float(weight[np.array(m) >= 0].sum())
    best = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:STARTS]
    return [np.array(m) for m, covered in best if covered > 0]


def fitted(counts: np.ndarray, hidden: np.ndarray, shows: np.ndarray, bigram: np.ndarray, first: np.ndarray) -> tuple[float, np.ndarray]:
    """Expectation-maximization. counts: pairs of shown characters; shows: chance (column by column) that a letter is shown by a
    character, of which the ``hidden`` rows are learned; bigram: of the letters; first: how common each is.

    Returns the log likelihood and the chance of each letter (row by row) behind a character."""
    least = 0.1 * first + 1e-9
    now = -np.inf
    for _ in range(ROUNDS):
        joint = first[:, None] * bigram
        chance = np.maximum(shows @ joint @ shows.T, 1e-300)
        now = float((counts * np.log(chance)).sum())
        share = counts / chance
        leading = shows * (share @ shows @ joint.T)
        want = leading + shows * (share.T @ shows @ joint)
        learned = np.where(hidden[:, None], want + 1e-6, 0.0) * (shows[hidden].sum(axis=0) > 0)
        shows = np.where(hidden[:, None], learned / np.maximum(learned.sum(axis=0), 1e-300), shows)
        first = leading.sum(axis=0) + least
        first = first / first.sum()
    behind = shows * first[None, :]
    return now, behind / np.maximum(behind.sum(axis=1, keepdims=True), 1e-300)


def learn_table(pairs: pd.DataFrame, single: dict[int, float], pair: dict[tuple[int, int], float], whole: float) -> tuple[dict[int, int], pd.DataFrame]:
    """(shown to letter, changes of the bigrams) of one source. pairs: (a, b, n) of its neighbouring symbols with a non-ASCII one;
    single, pair: of all sources, this one included; whole: all pairs. Empty where nothing can be learned surely."""
    none = {}, pd.DataFrame({"a": [], "b": [], "n": []})
    p = pairs[pairs["n"] > 0]
    own = p.groupby("a")["n"].sum()
    size = float(p["n"].sum())
    elsewhere = lambda c: max(single.get(int(c), 0.0) - own.get(c, 0.0), 0.0)
    foreign = [c for c in own.index if c > 127 and c not in GROUPED and own[c] >= LEAST_SHOWN and own[c] / size >= OWN * elsewhere(c) / max(whole - size, 1.0)]
    shown = np.array(sorted(sorted(foreign, key=lambda c: -own[c])[:MOST]), np.int64)
    if shown.size < FEWEST:
        return none
    letters = [c for c, n in single.items() if c > 127 and c not in GROUPED and elsewhere(c) >= LEAST_LETTER]
    letters = np.array(sorted(sorted(letters, key=lambda c: -elsewhere(c))[:MOST]), np.int64)
    if not letters.size:
        return none
    marked = set(shown.tolist())
    p = p[p["a"].isin(marked) | p["b"].isin(marked)]
    p = p[((p["a"] < 128) | p["a"].isin(marked)) & ((p["b"] < 128) | p["b"].isin(marked))]
    ascii_ = np.array(sorted({c for c in [*p["a"], *p["b"]] if c < 128}), np.int64)
    rows, cols = np.concatenate([ascii_, shown]), np.concatenate([ascii_, letters])
    row, col = {int(c): i for i, c in enumerate(rows)}, {int(c): i for i, c in enumerate(cols)}
    counts = np.zeros((rows.size, rows.size))
    counts[[row[a] for a in p["a"]], [row[b] for b in p["b"]]] = p["n"]
    # bigrams of the other sources
    mine = {(a, b): n for a, b, n in pairs[["a", "b", "n"]].itertuples(index=False)}
    usual = np.array([elsewhere(c) for c in cols]) + 0.5
    seen = np.zeros((cols.size, cols.size))
    for (a, b), n in pair.items():
        if a in col and b in col:
            seen[col[a], col[b]] = max(n - mine.get((a, b), 0.0), 0.0)
    prior = usual / usual.sum()
    bigram = (seen + 0.5 * prior[None, :]) / (np.maximum(usual, seen.sum(axis=1)) + 0.5)[:, None]
    hidden = np.arange(rows.size) >= ascii_.size
    weight = np.array([own[c] for c in shown])
    rng = np.random.default_rng(len(shown))
    fixed = np.eye(rows.size, cols.size) * (np.arange(cols.size) < ascii_.size)
    begin = []
    for m in starts(shown, letters, weight):
        t = np.full((shown.size, letters.size), 0.1 / shown.size)
        t[np.flatnonzero(m >= 0), m[m >= 0]] += 0.9
        begin.append(t / t.sum(axis=0))
    begin += [rng.dirichlet(np.full(shown.size, 3.0), letters.size).T for _ in range(RANDOM_STARTS)]
    fits = []
    for t in begin:
        shows = fixed.copy()
        shows[ascii_.size :, ascii_.size :] = t
        fits.append(fitted(counts, hidden, shows, bigram, 0.5 * prior + 0.5 / prior.size))
    _, table = max(fits, key=lambda x: x[0])
    best, share = table[hidden].argmax(axis=1), table[hidden].max(axis=1)
    sure = {int(c): int(cols[j]) for c, j, q in zip(shown, best, share, strict=True) if q >= SURE and cols[j] > 127 and cols[j] != c}
    kept = sum(own[c] for c in sure)
    if kept > sum(map(elsewhere, set(sure.values()))):  # what most texts show is the language, what few show the cipher
        return none
    if len(sure) < FEWEST or kept < COVERED * weight.sum() or len(set(sure.values())) < 0.8 * len(sure):
        return none
    # how the source reads by the mapping, as it is shown, and how the language reads
    q = p[(p["a"].isin(sure)) | (p["b"].isin(sure))]
    to = lambda c: col.get(sure.get(int(c), int(c)), -1)
    ab = np.array([(to(a), to(b)) for a, b in zip(q["a"], q["b"], strict=True)])
    good = (ab >= 0).all(axis=1)
    n = q["n"].to_numpy()
    floor = np.log(bigram.min())
    reads = np.where(good, np.log(bigram[ab[:, 0], ab[:, 1]]), floor)
    mapped = float((n * reads).sum() / n.sum())
    shown_as = float(sum(k * (np.log(bigram[col[a], col[b]]) if a in col and b in col else floor) for a, b, k in q[["a", "b", "n"]].itertuples(index=False)) / n.sum())
    foreign_pairs = seen * ((cols > 127)[:, None] | (cols > 127)[None, :])
    language = float((foreign_pairs * np.log(bigram)).sum() / max(foreign_pairs.sum(), 1.0))
    if mapped < language - WORSE or mapped < shown_as + BETTER:
        return none
    out = [(a, b, -k) for a, b, k in q[["a", "b", "n"]].itertuples(index=False)] + [(sure.get(a, a), sure.get(b, b), k) for a, b, k in q[["a", "b", "n"]].itertuples(index=False)]
    return sure, pd.DataFrame(out, columns=["a", "b", "n"]).groupby(["a", "b"], as_index=False)["n"].sum()
