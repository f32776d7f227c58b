"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares two words by their common subsequences of three letters, each occurrence
weighted down for every character it skips, and divides by the words' own weights. An insult with
an inserted, doubled or starred-out letter therefore keeps most of its likeness. Letters are folded
to lower case, digits that stand for letters are read as those letters, other signs within a word
are skipped, and letters spelled one by one are joined. The kernel runs over words and over windows
across spaces: the end of each word joined with the start of the next, so that an insult split by a
space is read as one word, and a phrase by the places where its words meet. A sentence is as toxic
as its most toxic window, a document as its most toxic sentence.

Training. A bounded sample of labelled documents, near copies counted once, gives the fragments
that stand in toxic sentences and hardly in clean ones (three letters if they are a whole word, four
or more of any word); a greedy cover of the toxic documents chooses the landmarks among them, and
another one, of the toxic documents without such a word, chooses fragments across a space; common
clean words are landmarks as well. Two machines, one for words and one for windows across spaces,
are fitted in the landmarks' Nyström features, with the hardest clean words or windows added in each
round. The first one's output is turned into a probability on the sample's documents; a window
counts as toxic if it scores above the middle between the clean documents' highest window and the
median insult. Since the kernel is a sum over subsequences, the sum over
landmarks is one table of weights, by which whole texts are scored in numpy batches.

Defined results: a null text is empty; texts without three letters in a window have the lowest score;
very long texts and words are cut into windows, none is left out; an empty table gives an empty one;
equal texts have equal scores; repeated labels of a document count once, as toxic if one is; null
labels and labels without a document are ignored; without labels of both kinds, or without a
fragment that tells them apart, every score is the share of toxic documents. Extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlight.llm.common import hash_sample
from hearthlight.llm.shingles import distinct, joined, runs, shingle_hashes, words_of
from hearthlight.session import cut_lineage

#: About so many labelled documents train the model, of at most so many characters each.
SAMPLE, SAMPLE_CHARS = 6000, 20_000
THRESHOLD = 0.3
#: Weight of a subsequence for each character it skips, and the most it may skip.
DECAY, GAPS = 0.5, 3
_OFFSETS = [(a, s - a) for s in range(2, 3 + GAPS) for a in range(1, s)]
_WINDOW, _STEP = 24, 12
#: Bytes of each word in a window across a space.
_HALF = 12
#: Words and windows with an insult's fragment that are fitted at most: a random draw of this many.
POSITIVES = 10_000
#: Words whose kernel with all landmarks is worked out at a time.
_ROWS = 4000
#: Letters that are scored at a time.
_BLOCK = 1 << 14
#: Landmarks at most: fragments of insults, and clean words.
_TOXIC_MARKS, _CLEAN_MARKS = 64, 48
#: How often the toxic documents are covered by fragments.
_COVERS = 6


def _symbols() -> np.ndarray:
    """Symbol of a byte: 1-26 letters, 27-31 other letters by their last byte, 0 skipped."""
    out = np.zeros(256, np.uint8)
    for i in range(26):
        out[ord("a") + i] = out[ord("A") + i] = i + 1
    for digit, letter in (("0", "o"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t")):
        out[ord(digit)] = ord(letter) - ord("a") + 1
    out[0x80:0xC0] = 27 + np.arange(64) % 5
    return out


_SYMBOL = _symbols()


@dataclass
class Tokens:
    """Folded words: their symbols one after another, and where each starts."""

    symbols: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> int:
        return len(self.first) - 1

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = ends - starts
    first = np.append(0, n.cumsum())
    at = np.repeat(starts - first[:-1], n) + np.arange(first[-1])
    return data[at], np.repeat(np.arange(len(n)), n)


def fold(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Tokens:
    raw, owner = _gather(data, starts, ends)
    symbols = _SYMBOL[raw]
    keep = symbols > 0
    return Tokens(symbols[keep], np.searchsorted(owner[keep], np.arange(len(starts) + 1)))


def fold_words(words: list[bytes]) -> Tokens:
    sizes = np.array([len(w) for w in words], np.int64)
    ends = sizes.cumsum()
    return fold(np.frombuffer(b"".join(words), np.uint8), ends - sizes, ends)


def windows(tokens: Tokens) -> tuple[Tokens, np.ndarray]:
    """Words of at most a window's length, and the word that each comes from: longer words become
    overlapping windows."""
    size = np.diff(tokens.first)
    extra = np.maximum(0, -(-(size - _WINDOW) // _STEP))
    if not extra.any():
        return tokens, np.arange(tokens.n)
    source = np.repeat(np.arange(tokens.n), 1 + extra)
    place = np.arange(len(source)) - np.repeat(np.append(0, (1 + extra).cumsum()[:-1]), 1 + extra)
    starts = tokens.first[:-1][source] + place * _STEP
    ends = np.minimum(starts + _WINDOW, tokens.first[1:][source])
    symbols, owner = _gather(tokens.symbols, starts, ends)
    return Tokens(symbols, np.searchsorted(owner, np.arange(len(source) + 1))), source


def subsequences(tokens: Tokens) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Owner and code of all three-letter subsequences with the same gaps, and their weight."""
    c, owner = tokens.symbols.astype(np.int32), tokens.owner
    for a, b in _OFFSETS:
        m = len(c) - a - b
        if m > 0:
            inside = np.flatnonzero(owner[:m] == owner[a + b:])
            yield owner[inside], (c[inside] << 10) | (c[inside + a] << 5) | c[inside + a + b], DECAY ** (a + b - 2)


def table_scores(tokens: Tokens, table: np.ndarray) -> np.ndarray:
    """Kernel expansion of each word with the weights in ``table``."""
    size, n, reach = np.diff(tokens.first), len(tokens.symbols), _OFFSETS[-1][0] + _OFFSETS[-1][1]
    # Letters to the end of the word, where that is less than the longest subsequence.
    room = np.minimum(np.repeat(tokens.first[1:], size) - np.arange(n), reach + 1).astype(np.int8)
    padded = np.append(tokens.symbols, np.zeros(reach, np.uint8)).astype(np.int32)
    weights = {s: table * DECAY ** (s - 2) for s in range(2, reach + 1)}
    sums = np.zeros(n)  # over the subsequences that begin at each letter
    for at in range(0, n, _BLOCK):  # a block stays in the processor's cache
        m = min(_BLOCK, n - at)
        c, left, block = padded[at:at + m + reach], room[at:at + m], sums[at:at + m]
        one, two = c[:m] << 10, c << 5
        inside = {s: left > s for s in weights}
        for a, b in _OFFSETS:
            block += weights[a + b].take(one | two[a:a + m] | c[a + b:a + b + m]) * inside[a + b]
    # A word's own weight depends on its length alone.
    own = sum(np.maximum(size - a - b, 0) * DECAY ** (2 * (a + b - 2)) for a, b in _OFFSETS)
    return np.bincount(tokens.owner, sums, tokens.n) / np.sqrt(np.maximum(own, 1e-9))


def feature_rows(tokens: Tokens) -> np.ndarray:
    """Normalised subsequence weights, one dense row a word (for landmarks)."""
    out, own = np.zeros((tokens.n, 1 << 15)), np.zeros(tokens.n)
    for owner, code, weight in subsequences(tokens):
        np.add.at(out, (owner, code), weight)
        own += np.bincount(owner, minlength=tokens.n) * weight**2
    return out / np.sqrt(np.maximum(own, 1e-9))[:, None]


def kernel(tokens: Tokens, marks: np.ndarray) -> np.ndarray:
    """Kernel of each word with each landmark."""
    first = tokens.first
    parts = [
        _kernel(Tokens(tokens.symbols[first[a]:first[min(a + _ROWS, tokens.n)]], first[a:a + _ROWS + 1] - first[a]), marks)
        for a in range(0, tokens.n, _ROWS)
    ]
    return np.concatenate(parts) if parts else np.zeros((0, len(marks)))


def _kernel(tokens: Tokens, marks: np.ndarray) -> np.ndarray:
    out, own, by_code = np.zeros((tokens.n, len(marks))), np.zeros(tokens.n), marks.T.copy()
    for owner, code, weight in subsequences(tokens):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else []
        if len(first):
            out[owner[first]] += np.add.reduceat(by_code[code], first) * weight
        own += np.bincount(owner, minlength=tokens.n) * weight**2
    return out / np.sqrt(np.maximum(own, 1e-9))[:, None]


@dataclass
class Model:
    table: np.ndarray  # weight of each subsequence
    bias: float
    slope: float  # probability = 1 / (1 + exp(-(slope * margin + offset)))
    offset: float
    across: np.ndarray | None = None  # the same of windows across spaces
    level: float = 0.0  # score of a window that stands for a margin of 0

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))

    def word_margins(self, tokens: Tokens) -> np.ndarray:
        """Margin of each word, not below that of a word unlike every landmark."""
        parts, source = windows(tokens)
        score = np.maximum(table_scores(parts, self.table), 0) + self.bias
        if parts is tokens:
            return score
        out = np.full(tokens.n, self.bias)
        np.maximum.at(out, source, score)
        return out

    def text_margins(self, column: pa.Array) -> np.ndarray:
        """The greatest margin of a word, of a short run of texts."""
        words = words_of(column)
        out = np.full(len(column), self.bias)
        if len(words.hashes):
            _, pick, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
            score = self.word_margins(fold(words.data, words.starts[pick], words.ends[pick]))[inverse]
            some = np.flatnonzero(words.counts)
            out[some] = np.maximum.reduceat(score, words.first[:-1][some])
        if self.across is not None:
            np.maximum(out, window_scores(words, self.across) - self.level, out=out)
        spelled, owner = spelled_out(words)
        if spelled.n:
            np.maximum.at(out, owner, self.word_margins(spelled))
        return out


def joints(words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows across spaces: where each different one starts and ends, and of every two neighbouring
    words the text and the window."""
    owner = words.owner
    left = np.flatnonzero(owner[:-1] == owner[1:])
    _, pick, inverse = np.unique(joined(words.hashes[left], words.hashes[left + 1]), return_index=True, return_inverse=True)
    some = left[pick]
    starts = np.maximum(words.starts[some], words.ends[some] - _HALF)
    ends = np.minimum(words.ends[some + 1], words.starts[some + 1] + _HALF)
    return starts, ends, owner[left], inverse


def window_scores(words, table: np.ndarray) -> np.ndarray:
    """Each text's greatest score of a window across spaces."""
    starts, ends, owner, pick = joints(words)
    out = np.full(len(words.first) - 1, -np.inf)
    if len(starts):
        np.maximum.at(out, owner, table_scores(fold(words.data, starts, ends), table)[pick])
    return out


def spelled_out(words) -> tuple[Tokens, np.ndarray]:
    """Words spelled with a space after each letter (three letters at least), and their texts."""
    letters = fold(words.data, words.starts, words.ends)
    size, owner = np.diff(letters.first), words.owner
    at = np.flatnonzero(size > 0)  # signs between the letters do not end a word
    single = size[at] == 1
    where = owner[at]
    begins = single.copy()
    begins[1:] &= ~(single[:-1] & (where[1:] == where[:-1]))
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return Tokens(np.zeros(0, np.uint8), np.zeros(1, np.int64)), np.zeros(0, np.int64)
    run = np.where(single, np.cumsum(begins) - 1, -1)
    lengths = np.bincount(run[run >= 0], minlength=len(starts))
    good = np.flatnonzero(lengths >= 3)
    symbols, at_run = _gather(letters.symbols[letters.first[:-1][at]], starts[good], starts[good] + lengths[good])
    return Tokens(symbols, np.searchsorted(at_run, np.arange(len(good) + 1))), where[starts[good]]


def support_vectors(features: np.ndarray, sign: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Linear machine with squared hinge loss, the last weight being the bias (Newton steps)."""
    x = np.hstack([features, np.ones((len(features), 1))])
    penalty = np.full(x.shape[1], 1.0)
    penalty[-1] = 1e-3
    u = np.zeros(x.shape[1])
    for _ in range(rounds):
        inside = sign * (x @ u) < 1
        z, w = x[inside], weight[inside]
        new = np.linalg.solve(np.diag(penalty) + z.T @ (z * w[:, None]), z.T @ (w * sign[inside]))
        if np.allclose(new, u, atol=1e-8):
            break
        u = new
    return u


def sigmoid_fit(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability, with smoothed targets."""
    good, bad = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x, u = np.column_stack([margin, np.ones(len(margin))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ u, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * u)
        u += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(u[0], 0.1)), float(u[1])


def _without_near_copies(column: pa.Array) -> np.ndarray:
    """Rows of which no earlier one shares one of six coordinates over word shingles."""
    seeds = np.random.default_rng(3).integers(1, 1 << 63, 6, dtype=np.uint64) | np.uint64(1)
    keep, rows, parts = np.ones(len(column), bool), [], []
    for a, b in runs(column):
        owner, hashes = distinct(*shingle_hashes(words_of(column.slice(a, b - a), lower=True), 3))
        first = np.searchsorted(owner, np.arange(b - a + 1))
        full = np.flatnonzero(np.diff(first))
        if len(full):
            rows.append(full + a)
            parts.append(np.column_stack([np.minimum.reduceat(hashes * s, first[full]) for s in seeds]))
    if not rows:
        return np.arange(len(column))
    full, values = np.concatenate(rows), np.concatenate(parts)
    seen: set[tuple[int, int]] = set()
    for row, own in zip(full.tolist(), values.tolist(), strict=True):
        pairs = set(enumerate(own))
        keep[row] = not (pairs & seen)
        seen |= pairs
    return np.flatnonzero(keep)


def _fragments(words: list[bytes]) -> set[bytes]:
    """Runs of letters in the words, of three letters only whole words."""
    found = {w[i:i + n] for w in words for n in (4, 5, 6, 8) for i in range(len(w) - n + 1)}
    return found | {w for w in words if len(w) == 3}


def _crossing(windows: list[tuple[bytes, int]]) -> set[bytes]:
    """Runs of letters that begin before a space and end behind it."""
    return {
        w[i:i + n] for w, cut in windows for n in (5, 6, 8, 10)
        for i in range(max(0, cut - n + 1), min(cut, len(w) - n + 1))
    }


def _holds(word: bytes, fragments: list[bytes]) -> bool:
    return any(f in word if len(f) > 3 else f == word for f in fragments)


def _folded(text: str, known: dict[bytes, bytes]) -> list[bytes]:
    """Words of a text as symbol strings of three or more; equal ones are one object."""
    words = words_of(pa.array([text]))
    folded = fold(words.data, words.starts, words.ends)
    raw, first = folded.symbols.tobytes(), folded.first.tolist()
    return [known.setdefault(w, w) for w in {raw[a:b] for a, b in zip(first, first[1:]) if b - a >= 3}]  # noqa: B905


def _windows_across(text: str) -> list[tuple[bytes, int]]:
    """The different windows across spaces of a text, and where in each the space stood."""
    words = words_of(pa.array([text]))
    starts, ends, _, _ = joints(words)
    after = words.starts[np.searchsorted(words.starts, starts, "right")]  # where the second word begins
    a, b = fold(words.data, starts, after), fold(words.data, after, ends)
    one, two, p, q = a.symbols.tobytes(), b.symbols.tobytes(), a.first.tolist(), b.first.tolist()
    return list({(one[p[i]:p[i + 1]] + two[q[i]:q[i + 1]], p[i + 1] - p[i]) for i in range(len(starts))})


def _cover(sets: dict[bytes, set[int]], clean: dict[bytes, int], least: int, most: int) -> list[bytes]:
    """Fragments that cover the toxic texts, best first; fragments also in clean texts count less."""
    left = {f: s for f, s in sets.items() if clean.get(f, 0) * 9 <= len(s)}
    chosen: list[bytes] = []
    covered: set[int] = set()
    while left and len(chosen) < most:
        best = max(left, key=lambda f: (len(left[f]) - clean.get(f, 0), len(f), f))
        if len(left[best]) < least:
            break
        chosen.append(best)
        covered = left[best]
        left = {f: rest for f, s in left.items() if len(rest := s - covered) >= least}
    return chosen


def _chosen_fragments(
    toxic: dict[int, list], clean: Callable[[], Iterable[list]], share: float, fragments: Callable[[list], set[bytes]],
    holds: Callable[[object, list[bytes]], bool], covers: int = _COVERS,
) -> list[bytes]:
    """Covers of the toxic texts, one after another, each by words that the earlier ones leave."""
    left, chosen, counted = toxic, [], {}
    for _ in range(covers):
        # Counted by hash first: most fragments stand in one text and need not be kept.
        hashes = [np.fromiter(map(hash, fragments(words)), np.int64) for words in left.values()]
        values, counts = np.unique(np.concatenate(hashes), return_counts=True)
        # So many texts that no fragment is expected to stand in that many toxic ones by chance.
        least = max(3, int(np.ceil(np.log(len(values) + 1) / -np.log(max(share, 0.02)))))
        often = set(values[counts >= least].tolist())
        where: dict[bytes, set[int]] = {}
        for i, words in left.items():
            for f in fragments(words):
                if hash(f) in often:
                    where.setdefault(f, set()).add(i)
        where = {f: s for f, s in where.items() if len(s) >= least}
        unseen = where.keys() - counted.keys()
        counted.update(dict.fromkeys(unseen, 0))
        for words in clean() if unseen else ():
            for f in fragments(words) & unseen:
                counted[f] += 1
        found = _cover(where, counted, least, _TOXIC_MARKS - len(chosen))
        if not found:
            break
        chosen += found
        left = {i: [w for w in words if not holds(w, found)] for i, words in left.items()}
    return chosen


def _altered(words: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """The words with one letter inserted or doubled."""
    out = []
    for w in words:
        for _ in range(2):
            at = int(rng.integers(1, len(w)))
            out += [w[:at] + bytes([int(rng.integers(1, 27))]) + w[at:], w[:at] + w[at - 1:at] + w[at:]]
    return out


def _tokens(words: list[bytes]) -> Tokens:
    sizes = np.array([len(w) for w in words], np.int64)
    return Tokens(np.frombuffer(b"".join(words), np.uint8), np.append(0, sizes.cumsum()))


def _hard_windows(clean: pa.Array, table: np.ndarray, insults: set[bytes], most: int = 1500) -> list[bytes]:
    """The windows across spaces of clean texts that score highest."""
    best: dict[bytes, float] = {}
    for a, b in runs(clean):
        words = words_of(clean.slice(a, b - a))
        starts, ends, _, _ = joints(words)
        tokens = fold(words.data, starts, ends)
        score = table_scores(tokens, table)
        raw, first = tokens.symbols.tobytes(), tokens.first
        for i in np.argsort(-score, kind="stable")[:most].tolist():
            best[raw[first[i]:first[i + 1]]] = float(score[i])
        best = dict(sorted(best.items(), key=lambda e: (-e[1], e[0]))[:most])
    return [w for w in best if len(w) >= 3 and w not in insults]


def _machine(
    landmarks: list[bytes], positives: list[bytes], negatives: list[bytes], hard: Callable[[np.ndarray], list[bytes]],
) -> tuple[np.ndarray, float]:
    """Weights of the subsequences, and the bias, of a machine in the landmarks' Nyström features."""
    marks = feature_rows(_tokens(list(dict.fromkeys(landmarks))))
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # inverse square root of the landmarks' kernel
    for _ in range(3):
        words = positives + negatives
        sign = np.append(np.ones(len(positives)), -np.ones(len(negatives)))
        weight = np.append(np.full(len(positives), 20 * len(negatives) / len(positives) / 4), np.full(len(negatives), 20.0))
        u = support_vectors(kernel(_tokens(words), marks) @ root, sign, weight)
        table, bias = (root @ u[:-1]) @ marks, float(u[-1])
        negatives = list(dict.fromkeys(negatives + hard(table)))
    return table, bias


def train(texts: list[str], labels: list[int]) -> Model | float:
    """A model, or the share of toxic texts if nothing tells them apart."""
    column, rng = pa.array(texts, pa.large_string()), np.random.default_rng(13)
    rows = _without_near_copies(column)
    y = np.array(labels)[rows]
    share = float(np.mean(labels)) if labels else 0.0
    if not 0 < y.sum() < len(y):
        return share
    known: dict[bytes, bytes] = {}
    bags = [_folded(texts[i], known) for i in rows]
    good_rows = np.flatnonzero(y == 0).tolist()
    toxic = {i: bags[i] for i in np.flatnonzero(y).tolist()}
    toxic_words = Counter(w for words in toxic.values() for w in words)
    clean_words = Counter(w for i in good_rows for w in bags[i])
    chosen = _chosen_fragments(toxic, lambda: (bags[i] for i in good_rows), share, _fragments, _holds)
    # Toxic texts without such a word: what they share may lie across spaces.
    rest = {i: _windows_across(texts[rows[i]]) for i, words in toxic.items() if not any(_holds(w, chosen) for w in words)}
    phrases = _chosen_fragments(
        rest, lambda: (_windows_across(texts[rows[i]]) for i in good_rows), share, _crossing,
        lambda window, found: _holds(window[0], found), 1,  # neighbouring windows share a word: one cover
    ) if rest else []
    if not chosen + phrases:
        return share
    # As with fragments, a word may stand in a few clean texts.
    insults = {w for w, n in toxic_words.items() if clean_words[w] * 9 <= n and _holds(w, chosen)}
    insults |= {w for windows_ in rest.values() for w, _ in windows_ if _holds(w, phrases)}
    drawn = sorted(insults)
    drawn = [drawn[i] for i in rng.permutation(len(drawn))[:POSITIVES].tolist()]
    common = sorted(clean_words.keys() - insults, key=lambda w: (-clean_words[w], w))
    negatives = common[:1500] + [common[i] for i in rng.permutation(len(common))[:3000].tolist()]
    every, frequent = _tokens(common), common[:_CLEAN_MARKS]
    positives = drawn + _altered([w for w in drawn if len(w) >= 4], rng)

    def hard_words(table: np.ndarray) -> list[bytes]:
        return [common[i] for i in np.argsort(-table_scores(every, table), kind="stable")[:1500].tolist()]

    model = Model(np.zeros(1 << 15, np.float32), -1.0, 1.0, 0.0)
    if chosen:
        table, model.bias = _machine(chosen + frequent, positives, negatives, hard_words)
        model.table = table.astype(np.float32)
    margin = np.concatenate([model.text_margins(column.slice(a, b - a)) for a, b in runs(column)])
    # Words with inserted letters stand for as many further toxic texts as there are.
    altered = model.word_margins(_tokens(positives[len(drawn):] or positives))
    altered = altered[rng.permutation(len(altered))[:int(np.sum(labels))]]
    model.slope, model.offset = sigmoid_fit(
        np.append(margin, altered), np.append(np.array(labels), np.ones(len(altered)))
    )
    split = [w for w in positives if len(w) >= 5]
    long = [f for f in chosen + phrases if len(f) >= 5]
    if split and long:
        clean = column.take(pa.array(rows[good_rows]))
        table, _ = _machine(long + frequent, split, negatives, lambda table: _hard_windows(clean, table, insults))
        model.across = table.astype(np.float32)
        highest = max(float(window_scores(words_of(clean.slice(a, b - a)), model.across).max()) for a, b in runs(clean))
        usual = float(np.median(table_scores(_tokens(split), model.across)))
        # A window at the level has the probability of the threshold.
        at_threshold = (np.log(THRESHOLD / (1 - THRESHOLD)) - model.offset) / model.slope
        model.level = max(highest, (max(highest, 0.0) + usual) / 2) + 1e-6 - at_threshold
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[int]]:
    """Texts and labels of the sample: never of documents that are held out."""
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = cut_lineage(hash_sample(cut_lineage(known), sample, "doc_id"))
    rows = (
        docs.select("doc_id", "text").join(chosen, "doc_id").where(F.char_length("text") <= SAMPLE_CHARS)
        .select("doc_id", "text", "toxic").collect()
    )
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in rows], [int(r.toxic > 0) for r in rows]


def score_texts(docs: DataFrame, model: Model | float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``score``, in place of a column of that name."""
    docs = docs.drop("score")
    kept = docs.schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            for a, b in runs(column):
                if isinstance(model, float):
                    score = np.full(b - a, model)
                else:
                    score = model.probability(model.text_margins(column.slice(a, b - a)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score, pa.float64())], [*part.schema.names, "score"]
                )

    return docs.mapInArrow(work, out)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(*training_rows(docs, labels, sample))
    scored = score_texts(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
