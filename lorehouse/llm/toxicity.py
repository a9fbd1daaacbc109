"""Toxicity: a support vector machine over gap-weighted subsequences of words, with Nystroem landmarks.

Two words are compared by their common subsequences of ``ORDER`` letters, each
weighted by ``DECAY`` to the length it spans in either word, so an insult with
letters put in, left out or added at its end stays near the insult. Landmarks are
words of the labelled sample; a word is its kernel values against them, times the
inverse root of the landmarks' own kernel matrix. Texts are split at white space;
runs of tokens of one or two letters inside a sentence are joined to one more
word, as an insult may be gapped by blanks. A document has the mean of its two
worst words and the share of its words beyond the margin, which a logistic map turns
into a probability. Labels are known per document only: in turns, each toxic document
lends its worst words to a linear machine, against the words of clean documents.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorehouse.llm.blocks import bounded_batches

#: Labelled rows per class that the machine is fitted on (those with the least hash of their id).
SAMPLE = 1000
#: Characters of a sampled text that may come to the driver; longer labelled texts are not sampled.
SAMPLE_CHARS = 100_000
ORDER, DECAY = 3, 0.6
LANDMARKS, CLEAN = 80, 24
BEGIN = "^"
#: A kernel value counts if the word has this share of the landmark's letters, each once.
LETTERS = 0.6
LONGEST = 24  # letters of a word compared at once; longer words are compared in overlapping parts
#: Likelihood ratio (chi-square, one degree) from which a word of the toxic sample tells something.
TELLING = 20.0
#: What a word of a toxic document must reach to be lent: first as kernel value to a telling landmark, then as margin.
ALIKE, PLAUSIBLE = 0.5, 0.3
#: Lent words that are also learned with a letter too many.
VARIED = 300
#: Words that a toxic document lends in a turn; clean words per turn, hard ones and others each.
WITNESSES, NEGATIVES = 2, 15_000
THRESHOLD, HELD = 0.3, (4.0, 1.0)
KEPT_WORDS = 1_000_000
#: Rows of the linear machine that are multiplied at once.
ROWS_AT_ONCE = 4096
_ENDS, _CLOSING = tuple(".!?…。！？"), "\"'’”»)]}*_"


def letters_of(token: str) -> str:
    """The letters of a token, lower case; marks and digits between them are passed over."""
    return token if token.isalpha() else "".join(c for c in token if c.isalpha())


def joined(tokens: list[str]) -> list[str]:
    """Words gapped by blanks: the letters of each run of tokens of one or two letters, and of the single letters in a row inside it.

    Tokens without letters do not break a run. A sentence ends with a token that ends with a sentence mark, closing
    marks aside, unless it has a single letter (``i. d. i. o. t.``). Runs that are too short to compare are left out.
    """
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if len(run) > 1:
            whole = "".join(run)
            singles = "".join(x if len(x) == 1 else " " for x in run).split()
            out.extend(w for w in dict.fromkeys((whole, *singles)) if len(w) >= ORDER)
        run.clear()

    for token in tokens:
        letters = letters_of(token)
        if len(letters) >= ORDER:
            close()
            continue
        if letters:
            run.append(letters)
        if len(letters) != 1 and token.rstrip(_CLOSING).endswith(_ENDS):
            close()
    close()
    return out


def parts_of(word: str) -> list[str]:
    """A word with a mark at its beginning, or overlapping parts of a longer one; none if it is too short."""
    if len(word) < ORDER:
        return []
    word = BEGIN + word
    if len(word) <= LONGEST:
        return [word]
    half = LONGEST // 2
    return [word[k : k + LONGEST] for k in range(0, len(word) - half, half)]


def as_codes(words: list[str], pad: int) -> np.ndarray:
    """Letters as numbers, filled up with ``pad``."""
    out = np.full((len(words), max(map(len, words), default=0)), pad, np.int32)
    for k, word in enumerate(words):
        out[k, : len(word)] = list(map(ord, word))
    return out


def subsequence_kernel(left: np.ndarray, right: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Row by row the gap-weighted kernel of two code arrays (padded with different numbers)."""
    n, a, b = len(left), left.shape[1], right.shape[1]
    before = [np.ones((b + 1, n), np.float32), *(np.zeros((b + 1, n), np.float32) for _ in range(order - 1))]
    total = np.zeros(n, np.float32)
    square = np.float32(decay * decay)
    for i in range(a):
        same = (right == left[:, i : i + 1]).T
        if not same.any():
            for p in range(1, order):
                before[p] *= np.float32(decay)
            continue
        hit = same * square
        total += (hit * before[order - 1][:-1]).sum(0)
        for p in range(order - 1, 0, -1):
            step = hit * before[p - 1][:-1]
            for j in range(1, b):
                step[j] += np.float32(decay) * step[j - 1]
            before[p] *= np.float32(decay)
            before[p][1:] += step
    return total


def _own(words: list[str]) -> np.ndarray:
    """The kernel of each word with itself."""
    out = np.zeros(len(words), np.float32)
    sizes = np.fromiter(map(len, words), int, len(words))
    for low in range(0, LONGEST, 6):
        some = np.flatnonzero((sizes > low) & (sizes <= low + 6))
        for at in range(0, len(some), 20_000):
            chosen = [words[k] for k in some[at : at + 20_000]]
            out[some[at : at + 20_000]] = subsequence_kernel(as_codes(chosen, 0), as_codes(chosen, -1))
    return out


def _mask(word: str) -> int:
    bits = 0
    for c in word.removeprefix(BEGIN):
        bits |= 1 << (ord(c) * 0x9E3779B1 >> 7) % 64
    return bits


def kernel_values(words: list[str], landmarks: list[str], norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, landmark, normalised kernel) of the pairs with enough common letters."""
    masks = np.array([_mask(w) for w in words], np.uint64)
    sizes = np.fromiter(map(len, words), np.int32, len(words))
    which, against = [], []
    for k, mark in enumerate(landmarks):
        bits = _mask(mark)
        enough = math.ceil(LETTERS * bits.bit_count())
        hit = np.flatnonzero((np.bitwise_count(masks & np.uint64(bits)) >= enough) & (sizes >= ORDER))
        which.append(hit.astype(np.int32))
        against.append(np.full(len(hit), k, np.int32))
    word, mark = np.concatenate(which), np.concatenate(against)
    del which, against
    value = np.zeros(len(word), np.float32)
    if not len(word):
        return word, mark, value
    used = np.unique(word)
    own = np.zeros(len(words), np.float32)
    own[used] = _own([words[k] for k in used])
    codes, right = as_codes([words[k] for k in used], 0), as_codes(landmarks, -1)
    place = np.zeros(len(words), np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    row, lengths, widths = place[word], sizes[word], np.fromiter(map(len, landmarks), np.int32, len(landmarks))[mark]
    for low in range(0, LONGEST, 6):
        for narrow in (0, 8):
            some = np.flatnonzero((lengths > low) & (lengths <= low + 6) & ((widths <= 8) if not narrow else (widths > 8)))
            for at in range(0, len(some), 20_000):
                p = some[at : at + 20_000]
                value[p] = subsequence_kernel(codes[row[p], : low + 6], right[mark[p], : 8 if not narrow else None])
    return word, mark, value / np.sqrt(np.maximum(own[word] * norms[mark], 1e-20))


@dataclass
class Model:
    """What scoring needs: landmarks, their norms and weights, and the map from a document's facts to probability."""

    landmarks: list[str]
    norms: np.ndarray
    weights: np.ndarray
    bias: float
    shape: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        """The margin of each word less the bias, of its worst part; minus infinity for words too short to compare."""
        parts, owner = [], []
        for k, word in enumerate(words):
            for part in parts_of(word):
                parts.append(part)
                owner.append(k)
        row, mark, value = kernel_values(parts, self.landmarks, self.norms)
        of_part = np.bincount(row, self.weights[mark] * value, len(parts))
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, np.array(owner, int), of_part)
        return out

    def probability(self, facts: np.ndarray) -> np.ndarray:
        """From 0 to 1."""
        return 1.0 / (1.0 + np.exp(-np.clip(facts @ self.shape[:-1] + self.shape[-1], -40, 40)))


def _telling(a: int, n: int, b: int, m: int) -> float:
    """Twice the log likelihood ratio for different rates a / n and b / m."""
    rate = (a + b) / (n + m)

    def part(k: int, total: int) -> float:
        return sum(x * math.log(x / (total * q)) for x, q in ((k, rate), (total - k, 1 - rate)) if x)

    return 2 * (part(a, n) + part(b, m))


def variants_of(word: str) -> set[str]:
    """A word with one letter doubled or put in."""
    return {word[:k] + c + word[k:] for k in range(2, len(word)) for c in (word[k], "x") if len(word) < LONGEST}


def _words_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct word parts of texts in order, the number of each part as it stands, and the text it stands in.

    The texts are taken one by one, so that each part is held once.
    """
    first: dict[str, int] = {}
    at, sizes = array("i"), array("i")
    for text in texts:
        tokens, before = text.lower().split(), len(at)
        for word in chain(map(letters_of, tokens), joined(tokens)):
            at.extend(first.setdefault(part, len(first)) for part in parts_of(word))
        sizes.append(len(at) - before)
    words = sorted(first)
    place = np.empty(len(words), np.int32)
    place[np.fromiter(map(first.__getitem__, words), np.int32, len(words))] = np.arange(len(words), dtype=np.int32)
    return words, place[np.frombuffer(at, np.int32)], np.repeat(np.arange(len(texts), dtype=np.int32), sizes)


def _choose(one: dict[str, int], other: dict[str, int], toxic: int, clean: int) -> list[str]:
    """Landmarks: words that tell the classes apart, thinned by their kernel.

    ``one`` and ``other`` count the toxic and the clean documents that have a word.
    """
    n, m = max(1, toxic), max(1, clean)
    gain = {w: _telling(c, n, other.get(w, 0), m) for w, c in one.items() if ORDER <= len(w) <= LONGEST and c * m > other.get(w, 0) * n}
    telling = [w for w, g in sorted(gain.items(), key=lambda x: (-x[1], x[0])) if g > TELLING][: 6 * LANDMARKS]
    if not telling:
        return [w for w, _ in sorted(other.items(), key=lambda x: (-x[1], x[0]))][:1] or [BEGIN + "aaa"]
    # pivoted Cholesky: the next landmark is the telling word that those before explain least
    codes, pads = as_codes(telling, 0), as_codes(telling, -1)
    own = subsequence_kernel(codes, pads)
    rest, made, chosen = np.ones(len(telling)), np.zeros((0, len(telling))), []
    weight = np.sqrt(np.array([gain[w] for w in telling]))
    while len(chosen) < min(LANDMARKS, len(telling)):
        k = int(np.argmax(np.where(rest > 1e-3, rest * weight, -1)))
        if rest[k] <= 1e-3:
            break
        row = subsequence_kernel(codes, np.repeat(pads[k : k + 1], len(telling), 0)) / np.sqrt(own * own[k])
        row = (row - made[:, k] @ made) / math.sqrt(rest[k])
        made = np.vstack((made, row))
        rest = np.maximum(rest - row**2, 0)
        rest[k] = 0
        chosen.append(telling[k])
    return chosen


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on the rows inside the margin; the last column of ``x`` is the constant.

    Rows are summed up ``ROWS_AT_ONCE`` at a time, so a step holds no second copy of them.
    """
    w = np.zeros(x.shape[1])
    penal = np.full(x.shape[1], ridge * len(x))
    penal[-1] = 1e-6 * len(x)
    inside = None
    for _ in range(steps):
        now = y * (x @ w) < 1
        if inside is not None and (now == inside).all():
            break
        inside = now
        curve, aim = np.diag(penal), np.zeros(len(w))
        for at in range(0, len(x), ROWS_AT_ONCE):
            some = np.flatnonzero(inside[at : at + ROWS_AT_ONCE]) + at
            rows = x[some]
            held = (rows * cost[some, None]).T
            curve += held @ rows
            aim += held @ y[some]
        w = np.linalg.solve(curve, aim)
    return w[:-1], float(w[-1])


def fit(texts: list[str], labels: list[int], share: float | None = None, rounds: int = 4) -> Model:
    """Fit a model on labelled texts; ``share`` is that of toxic rows where the texts were drawn from."""
    words, word, owner = _words_of(texts)
    y = np.array(labels, bool)
    clean_words = np.unique(word[~y[owner]])
    pairs = np.unique(owner.astype(np.int64) * len(words) + word)
    counts = [np.bincount((pairs % len(words))[y[pairs // len(words)] == toxic], minlength=len(words)) for toxic in (True, False)] if words else []
    one, other = ({words[k]: int(c[k]) for k in np.flatnonzero(c).tolist()} for c in counts or [np.zeros(0, int)] * 2)
    landmarks = _choose(one, other, int(y.sum()), int((~y).sum()))
    del pairs, counts, one, other
    telling = len(landmarks)
    row, mark, value = kernel_values(words, landmarks, _own(landmarks))
    # clean words that come nearest to each landmark are landmarks as well
    clean = np.isin(row, clean_words) & (value < 0.999)
    order = np.lexsort((-value[clean], mark[clean]))
    nth = np.arange(len(order)) - np.searchsorted(mark[clean][order], mark[clean][order])
    near = np.lexsort((-value[clean][order], nth))
    landmarks = landmarks + [words[k] for k in dict.fromkeys(row[clean][order][near].tolist())][:CLEAN]
    norms = _own(landmarks)
    parts = [(row, mark, value)]
    if len(landmarks) > telling:
        more = kernel_values(words, landmarks[telling:], norms[telling:])
        parts.append((more[0], more[1] + telling, more[2]))
    row, mark, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    left, right, own = kernel_values(landmarks, landmarks, norms)
    square = np.eye(len(landmarks))
    square[left, right] = own
    vals, vecs = np.linalg.eigh((square + square.T) / 2)
    root = vecs @ np.diag(1 / np.sqrt(np.maximum(vals, 0.05))) @ vecs.T

    order = np.argsort(row, kind="stable").astype(np.int32)
    row, mark, value = row[order], mark[order], value[order]
    del order, parts, clean, nth, near
    edges = np.searchsorted(row, np.arange(len(words) + 1))

    def vectors(some: np.ndarray, out: np.ndarray) -> None:
        """Write the vectors of words into the rows of ``out``."""
        for at in range(0, len(some), ROWS_AT_ONCE):
            part = some[at : at + ROWS_AT_ONCE]
            rows = np.zeros((len(part), len(landmarks)))
            for k, w in enumerate(part.tolist()):
                a, b = edges[w], edges[w + 1]
                rows[k, mark[a:b]] = value[a:b]
            out[at : at + len(part)] = rows @ root

    score = np.full(len(words), -1.0)
    near = mark < telling
    np.maximum.at(score, row[near], value[near])
    least = ALIKE
    w, bias = np.zeros(len(landmarks)), -1.0
    for _ in range(rounds if y.any() and not y.all() and len(word) else 0):
        worst = np.flatnonzero((score[word] > least) & y[owner])
        worst = worst[np.lexsort((-score[word[worst]], owner[worst]))]
        place = np.arange(len(worst)) - np.searchsorted(owner[worst], owner[worst])
        lent = np.unique(word[worst[place < WITNESSES]])
        # a word that clean documents have as well is no witness
        positive = np.setdiff1d(lent, clean_words, assume_unique=True)
        hard = clean_words[np.argsort(-score[clean_words], kind="stable")[:NEGATIVES]]
        spread = clean_words[:: max(1, len(clean_words) // NEGATIVES)]
        negative = np.unique(np.concatenate((hard, spread)))
        if not len(positive):
            break
        common = np.bincount(word[y[owner]], minlength=len(words))[positive]
        varied = set().union(*(variants_of(words[k]) for k in positive[np.argsort(-common, kind="stable")[:VARIED]]))
        varied = sorted(varied.difference(words))
        at, to, much = kernel_values(varied, landmarks, norms)
        more = np.zeros((len(varied), len(landmarks)))
        more[at, to] = much
        x = np.ones((len(positive) + len(varied) + len(negative), len(landmarks) + 1))
        vectors(positive, x[: len(positive), :-1])
        x[len(positive) : len(x) - len(negative), :-1] = more @ root
        vectors(negative, x[len(x) - len(negative) :, :-1])
        target = np.ones(len(x))
        target[len(x) - len(negative) :] = -1.0
        cost = np.where(target > 0, len(x) / (2 * (len(x) - len(negative))), len(x) / (2 * max(1, len(negative))))
        w, bias = _machine(x, target, cost)
        weights = root @ w
        score = np.bincount(row, weights[mark] * value, len(words)) + bias
        least = PLAUSIBLE
    facts = _facts(owner, score[word], len(texts), bias) if w.any() else np.zeros((len(texts), len(HELD)))  # nothing learned
    return Model(landmarks, norms, root @ w, bias, _calibrated(facts, y, float(y.mean()) if share is None and len(y) else share or 0.0))


def _facts(owner: np.ndarray, score: np.ndarray, n: int, empty: float) -> np.ndarray:
    """Per document the mean of its two highest margins, and the logarithm of its share of words over the margin.

    A document without words, or with one only, is filled up with ``empty``.
    """
    top = np.full((n, 2), empty)
    np.maximum.at(top[:, 0], owner, score)
    if len(owner):
        best = np.flatnonzero(score >= top[owner, 0])
        _, first = np.unique(owner[best], return_index=True)
        rest = np.ones(len(owner), bool)
        rest[best[first]] = False
        np.maximum.at(top[:, 1], owner[rest], score[rest])
    over = np.bincount(owner, score > 0, n)
    share = np.log((over + 0.02) / (np.bincount(owner, minlength=n) + 2.0))
    return np.stack((top.mean(1), share), 1)


def _calibrated(facts: np.ndarray, y: np.ndarray, share: float, steps: int = 100) -> np.ndarray:
    """Logistic weights of the facts and a constant, with toxic rows at their share of all.

    The weights are held near ``HELD``, so that classes without overlap do not drive them up.
    """
    n = max(1, len(y))
    weight = n * np.where(y, share / max(1, y.sum()), (1 - share) / max(1, (~y).sum()))
    x = np.hstack((facts, np.ones((len(facts), 1))))
    aim, hold = np.array([*HELD, 0.0]), np.array([0.002 * n, 0.002 * n, 1e-7 * n])

    def loss(w: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, -np.where(y, 1, -1) * (x @ w))).sum() + (hold * (w - aim) ** 2).sum())

    if not facts.any(0).any() or not y.any() or y.all():
        return np.array([0.0, 0.0, _logit(share)])
    w = aim.copy()
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slopes = x.T @ (weight * (p - y)) + 2 * hold * (w - aim)
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(2 * hold)
        step, size = np.linalg.solve(curve, slopes), 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        last, now = now, loss(w)
        if last - now < 1e-9:
            break
    if (w[:-1] < 0).any():  # more evidence never speaks for the clean class
        kept = facts * (w[:-1] > 0)
        return _calibrated(kept, y, share, steps) * [*(w[:-1] > 0), 1.0]
    return w


def _logit(share: float) -> float:
    share = min(max(share, 1e-3), 0.999)
    return math.log(share / (1 - share))


class Scorer:
    """Scores batches of texts; remembers what words add."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, float] = {}  # by token
        self.runs: dict[str, float] = {}  # by joined run

    def _joined(self, tokens: list[str], codes: np.ndarray, owner: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents and margins of the words gapped by blanks; ``codes`` number the tokens."""
        at = np.flatnonzero(short[codes])
        breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(owner[at]) != 0)) + 1
        edges = np.concatenate(([0], breaks, [len(at)]))
        many = np.flatnonzero(np.diff(edges) > 1)
        firsts, lasts = at[edges[many]], at[edges[many + 1] - 1] + 1
        made: dict[bytes, list[str]] = {}
        of, words = [], []
        for k, (a, b) in enumerate(zip(firsts.tolist(), lasts.tolist(), strict=True)):
            key = codes[a:b].tobytes()
            if key not in made:
                made[key] = joined([tokens[c] for c in codes[a:b].tolist()])
            for word in made[key]:
                of.append(k)
                words.append(word)
        new = [w for w in dict.fromkeys(words) if w not in self.runs]
        if new:
            self.runs.update(zip(new, self.model.words(new).tolist(), strict=True))
        return owner[firsts[np.array(of, int)]], np.fromiter(map(self.runs.__getitem__, words), np.float64, len(words)) + self.model.bias

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        if len(self.runs) > KEPT_WORDS:
            self.runs = {}
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())))
        numbered = lists.flatten().dictionary_encode()
        tokens = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [t for t in tokens if t not in self.known]
        if new:
            self.known.update(zip(new, self.model.words([letters_of(t) for t in new]).tolist(), strict=True))
        value = np.fromiter(map(self.known.__getitem__, tokens), np.float64, len(tokens)) + self.model.bias
        wordy = np.isfinite(value)  # short tokens are words only when joined
        codes = numbered.indices.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        known = wordy[codes]
        of_runs, more = self._joined(tokens, codes, owner, ~wordy)
        facts = _facts(np.concatenate((owner[known], of_runs)), np.concatenate((value[codes[known]], more)), len(texts), self.model.bias)
        return self.model.probability(facts)


_SCORERS: dict[str, Scorer] = {}


def labelled_sample(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[list[str], list[int], float]:
    """At most ``per_class`` texts of either class whose crc32(doc_id) mod 4 is not 2.

    Texts are read for the sampled ids only; a document with two labels counts as toxic if one says so. The
    last value is the share of toxic rows among all rows that may be learned from.
    """
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    short = documents.where(F.col("text").isNotNull() & (F.char_length("text") <= SAMPLE_CHARS)).select("doc_id")
    marks = marks.join(short, "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.where("toxic = 1").orderBy(*order).limit(per_class).union(marks.where("toxic = 0").orderBy(*order).limit(per_class))
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.char_length("text") <= SAMPLE_CHARS)
    found = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    share = marks.agg(F.avg("toxic")).first()[0] or 0.0
    return [r["text"] for r in found], [r["toxic"] for r in found], share


def held_out(name: str = "doc_id") -> F.Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on) to every document.

    The score depends on the text alone. Null, empty and wordless texts have the
    score of a sentence without words; very long words are compared in parts;
    repeated rows are scored each; an empty table has no rows. Other columns pass
    through, ones named like the results are replaced. One pass, no shuffle.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    documents = documents.drop("score", "predicted")
    held, key = spark.sparkContext.broadcast(vars(model)), uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(Model(**held.value))
        for batch in batches:
            yield batch.append_column("score", pa.array(_SCORERS[key](batch.column("text"))))

    schema = T.StructType([*documents.schema.fields, T.StructField("score", T.DoubleType())])
    return documents.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def fitted(documents: DataFrame, labels: DataFrame) -> Model:
    """A model of the labelled sample."""
    return fit(*labelled_sample(documents, labels))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    own = documents.columns
    return score_toxicity(documents, fitted(documents, labels)).where("predicted = 0").select(*own)


def toxicity_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document with its score."""
    scored = score_toxicity(documents.select("doc_id", "text"), fitted(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
