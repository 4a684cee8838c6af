"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words counts the 4-letter subsequences they share, each weighted by ``DECAY`` per
skipped letter and spanning ``SPAN`` letters at most; a mark for the beginning of the word takes part
like a letter. Insults with letters inserted, left out or appended stay close to each other. Letters
are compared after dropping everything else inside a token, and letters standing apart are joined.

Labels belong to documents, so training picks the guilty words of each toxic document (its worst one
so far, and those above what clean documents reach) and fits again, a few times; a word counts as
often as documents have it, and clean words once found near the margin stay among the samples. Kernel values against landmark words, whitened by
the landmarks' own kernel (Nyström), make the features of a linear machine. Since those features are
linear in the subsequence weights, the fitted machine is one weight per subsequence: scoring a word is a
short sum, remembered per distinct token. A text is judged by its WORST worst words together, through
a fitted sigmoid.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.llm.common import fresh_name, grouped, text_slices

DECAY, SPAN = 0.5, 7
FULL = 4  # letters from which a word's length is its own
LANDMARKS = 256
ROUNDS = 3
WORST = 3  # words that a text is judged by
GUILTY = 0.98  # a word is guilty above the worst words of so many clean documents
# The bounded sample of labelled documents that the machine is fitted on, unless the caller says otherwise.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 3000
COMMON = 4000  # random words of clean documents in each fit
_CHUNK = 10_000
BATCH_CHARS = 1 << 20
MAX_TOKENS = 1 << 18  # distinct tokens remembered per worker before the memory is renewed
_SPACED = re.compile(r"(?<!\S)\w(?:[ .\-_*]\w){3,}(?!\S)")
_STEPS = [(a, b, c, DECAY ** (c - 3)) for a, b, c in combinations(range(1, SPAN), 3)]


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens, and the words that letters standing apart would make."""
    low = text.lower()
    out = set(low.split())
    for m in _SPACED.finditer(low):
        out.add(re.sub(r"[\W_]", "", m[0]))
    return out


def _letter_codes() -> np.ndarray:
    """Letters as 1..31 (a-z apart, all others in five classes), the separator as the mark 0, else -1."""
    table = np.full(0x110000, -1, np.int8)
    for k in range(128, len(table)):
        if chr(k).isalpha():
            table[k] = 27 + k % 5
    table[97:123] = np.arange(1, 27)
    table[10] = 0
    return table


_TABLE: list[np.ndarray] = []


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words in a row, each word behind its mark, and the word of each code."""
    if not _TABLE:
        _TABLE.append(_letter_codes())
    text = "".join("\n" + w for w in words)
    codes = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    codes = codes[codes >= 0]
    return codes, np.cumsum(codes == 0) - 1


def _norms(owner: np.ndarray, words: int) -> np.ndarray:
    """Root of the summed squared weights of a word's subsequences: a matter of its length. A word of
    fewer than ``FULL`` letters is measured like one of so many, so that the one subsequence of a
    short word does not weigh as much as all those of an insult."""
    n = np.maximum(np.bincount(owner, minlength=words), FULL + 1)[:, None]
    ends = np.array([c for _, _, c, _ in _STEPS])
    return np.sqrt((np.maximum(0, n - ends) * np.array([w for *_, w in _STEPS]) ** 2).sum(axis=1))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) triples; the squared weights of a word of FULL letters or more sum to 1."""
    flat, owner = _letters(words)
    parts: list[tuple] = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
    for a, b, c, weight in _STEPS:
        at = np.flatnonzero(owner[:-c] == owner[c:])
        subsequence = ((flat[at] * 32 + flat[at + a]) * 32 + flat[at + b]) * 32 + flat[at + c]
        parts.append((owner[at], subsequence, np.full(len(at), weight)))
    word, subsequence, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    return word, subsequence, weight / _norms(owner, len(words))[word]


@dataclass
class Machine:
    """One weight per subsequence, an intercept, and the sigmoid of a text's WORST worst words."""

    weights: np.ndarray
    intercept: float
    slopes: np.ndarray
    shift: float

    def words(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word, summed without spelling the triples out."""
        flat, owner = _letters(words)
        sums = np.zeros(len(flat))
        places = [flat << 15, flat << 10, flat << 5, flat]
        for a, b, c, weight in _STEPS:
            n = max(0, len(flat) - c)
            value = self.weights[places[0][:n] + places[1][a : a + n] + places[2][b : b + n] + places[3][c : c + n]]
            sums[:n] += weight * value * (owner[:n] == owner[c : c + n])
        norms = _norms(owner, len(words))
        return np.bincount(owner, sums, minlength=len(words)) / np.maximum(norms, 1e-9) + self.intercept

    def probability(self, worst: np.ndarray) -> np.ndarray:
        """Of texts, each a row of its worst words' values."""
        return 1 / (1 + np.exp(-np.clip(worst @ self.slopes + self.shift, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, times: np.ndarray, penalty: float = 1e-5, steps: int = 60) -> tuple[np.ndarray, float]:
    """A linear support vector machine with balanced classes and squared hinge, to convergence;
    ``times`` says how often a sample counts in its class.

    Newton steps on the primal: given which samples violate the margin the problem is a ridge
    regression; it is solved when that set no longer changes.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    share = times * np.where(y > 0, 0.5 / times[y > 0].sum(), 0.5 / times[y < 0].sum())
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9  # the intercept is free

    def loss(w: np.ndarray) -> float:
        return float(w @ ridge @ w + (share * np.maximum(0, 1 - y * (x @ w)) ** 2).sum())

    w, inside = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(steps):
        part, weight = x[inside], share[inside]
        step = np.linalg.solve(ridge + (part * weight[:, None]).T @ part, part.T @ (weight * y[inside])) - w
        rate = 1.0
        while rate > 1e-6 and loss(w + rate * step) > loss(w) + 1e-15:
            rate /= 2
        w = w + rate * step
        now = y * (x @ w) < 1
        if rate == 1.0 and np.array_equal(now, inside):
            break
        inside = now
    return w[:-1], float(w[-1])


def _sigmoid(worst: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Platt's fit of P(toxic) to the worst words' values, by Newton steps with smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.hstack([worst, np.ones((len(worst), 1))])
    w = np.append(np.full(worst.shape[1], 1.0 / worst.shape[1]), np.log((pos + 1) / (neg + 1)))
    ridge = np.append(np.full(worst.shape[1], 1e-2), 1e-3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = p * (1 - p) + 1e-9
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(ridge), x.T @ (goal - p) - ridge * np.append(w[:-1], 0.0))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _chunks(vocabulary: list[str]) -> Iterator[tuple[int, list[str]]]:
    for s in range(0, len(vocabulary), _CHUNK):
        yield s, vocabulary[s : s + _CHUNK]


def _first_scores(vocabulary: list[str], seen: np.ndarray, odds: float) -> np.ndarray:
    """How much more often than in clean documents a word's subsequences occur in toxic ones, in
    deviations; a word frequent in clean documents is never the guilty one."""
    counts = np.zeros((2, 1 << 20))
    for s, words in _chunks(vocabulary):
        word, subsequence, _ = features(words)
        for k in (0, 1):
            counts[k] += np.bincount(subsequence, seen[k][s + word], minlength=1 << 20)
    expected = (counts[0] + 0.5) * counts[1].sum() / max(1.0, counts[0].sum())
    excess = (counts[1] - expected) / np.sqrt(expected + 3.0)
    score = np.zeros(len(vocabulary))
    for s, words in _chunks(vocabulary):
        word, subsequence, weight = features(words)
        score[s : s + len(words)] = np.bincount(word, weight**2 * excess[subsequence], minlength=len(words))
    # the same for whole words
    expected = (seen[0] + 0.5) / odds
    score += (seen[1] - expected) / np.sqrt(expected + 3.0)
    return score - 100.0 * (seen[0] > 2 + 3 * seen[1] * odds)


def _machine(marks: list[str], words: list[str], target: np.ndarray, times: np.ndarray) -> Machine:
    """The support vector machine of ``words`` on Nyström features of the landmarks ``marks``."""
    word, subsequence, weight = features(marks)
    used, place = np.unique(subsequence, return_inverse=True)
    land = np.zeros((len(marks), len(used)))
    np.add.at(land, (word, place), weight)
    value, vector = np.linalg.eigh(land @ land.T + 1e-6 * np.eye(len(marks)))
    root = (vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    word, subsequence, weight = features(words)
    place = np.minimum(np.searchsorted(used, subsequence), len(used) - 1)
    hit = used[place] == subsequence
    kernel = np.zeros((len(words), len(marks)))
    ends = np.cumsum(np.bincount(word[hit], minlength=len(words)))
    order = np.argsort(word[hit], kind="stable")
    place, weight = place[hit][order], weight[hit][order]
    for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        kernel[i] = land[:, place[a:b]] @ weight[a:b]
    w, b = _svm(kernel @ root, target, times)
    weights = np.zeros(1 << 20, np.float32)
    weights[used] = land.T @ (root @ w)
    return Machine(weights, b, np.zeros(WORST), 0.0)


def _best(words: np.ndarray, score: np.ndarray, nothing: float) -> np.ndarray:
    """The values of a document's worst words, ``nothing`` in the place of missing ones."""
    out = np.full(WORST, nothing)
    values = np.sort(score[words])[::-1][:WORST]
    out[: len(values)] = values
    return out


def fit(vocabulary: list[str], owned: list[np.ndarray], toxic: list[bool]) -> Machine:
    """Fit on labelled documents, each given by the places of its words in the sorted ``vocabulary``.
    Without both labels every text scores the base rate."""
    y = np.where(np.array(toxic, bool), 1.0, -1.0)
    n_bad, n_good = int((y > 0).sum()), int((y < 0).sum())
    blank = Machine(np.zeros(1 << 20, np.float32), 0.0, np.zeros(WORST), float(np.log((n_bad + 1) / (n_good + 1))))
    if not vocabulary or not n_bad or not n_good:
        return blank
    seen = np.zeros((2, len(vocabulary)))
    for words, t in zip(owned, y > 0, strict=True):
        seen[int(t), words] += 1
    rng, machine = np.random.default_rng(0), blank
    clean = np.flatnonzero(seen[0] > 0)
    hard = clean[rng.permutation(len(clean))[:COMMON]]
    score = _first_scores(vocabulary, seen, n_good / n_bad)
    for turn in range(ROUNDS):
        worst = np.array([w[np.argmax(score[w])] if len(w) else -1 for w in owned])
        innocent = worst[(y < 0) & (worst >= 0)]
        least, sure = np.quantile(score[innocent], (0.9, GUILTY)) if len(innocent) else (0.0, 0.0)
        # the worst word of a toxic document, and every one above what clean documents reach; one in
        # which every word looks clean teaches nothing
        guilty = [w[score[w] > sure] for w, t in zip(owned, y, strict=True) if t > 0] + [worst[(y > 0) & (worst >= 0)]]
        guilty = np.concatenate(guilty)
        guilty = guilty[score[guilty] > least]
        # a word counts as often as it is among the worst of a document
        times = np.ones(len(vocabulary))
        np.add.at(times, guilty, 1.0)
        np.add.at(times, innocent, 1.0)
        positive = np.unique(guilty)
        # clean words once found inside the margin stay
        near = clean[score[clean] > -1.0] if turn else np.zeros(0, np.int64)
        near = near[np.argsort(-score[near], kind="stable")][:COMMON]
        hard = np.unique(np.concatenate([hard, innocent, near]))
        negative = np.setdiff1d(hard, positive)
        if not len(positive) or not len(negative):
            return blank
        # landmarks: the words that explain most toxic documents, and the clean ones closest to them
        first = lambda x, by: x[np.argsort(-by[x], kind="stable")][: LANDMARKS // 2]
        named = lambda x: [vocabulary[i] for i in x.tolist()]
        marks = np.concatenate([first(positive, times), first(negative, score)])
        target = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        machine = _machine(named(marks), named(positive) + named(negative), target, times[np.concatenate([positive, negative])])
        for s, words in _chunks(vocabulary):
            score[s : s + len(words)] = machine.words(words)
    slopes, shift = _sigmoid(np.array([_best(w, score, machine.intercept) for w in owned]), y)
    return Machine(machine.weights, machine.intercept, slopes, shift)


def fit_texts(texts: list[str], toxic: list[bool]) -> Machine:
    found = [tokens(t) for t in texts]
    vocabulary = sorted(set().union(*found)) if found else []
    index = {w: i for i, w in enumerate(vocabulary)}
    return fit(vocabulary, [np.array(sorted(index[w] for w in f), np.int64) for f in found], toxic)


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept for evaluation: crc32 of the id's text leaves 1 when divided by 3."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN,
) -> Machine:
    """Fit on the labelled rows that are not held out, whole texts of at most ``sample_toxic`` and
    ``sample_clean`` documents, those with the smallest hash of their id. Of rows that repeat an id
    the words of all count."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & ~held_out(F.col("id"))
    ).groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for label, most in ((1, sample_toxic), (0, sample_clean)):
        some = known.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = some if chosen is None else chosen.union(some)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            words = [sorted(tokens(t)) for t in rows["text"]]
            yield pd.DataFrame({"id": rows["id"], "toxic": rows["toxic"], "words": words})

    sample = texts.join(F.broadcast(chosen), "id").mapInPandas(cut, "id long, toxic int, words array<string>")
    # words become numbers as they arrive, so the driver holds each distinct word once
    index: dict[str, int] = {}
    found: dict = {}
    for r in sample.toLocalIterator():
        words = np.array([index.setdefault(w, len(index)) for w in r["words"]], np.int32)
        before = found.get(r["id"])
        found[r["id"]] = r["toxic"], np.union1d(before[1], words) if before else words
    vocabulary = sorted(index)
    place = np.zeros(len(index), np.int64)
    place[[index[w] for w in vocabulary]] = np.arange(len(vocabulary))
    rows = [found[i] for i in sorted(found)]
    return fit(vocabulary, [np.sort(place[words]) for _, words in rows], [bool(t) for t, _ in rows])


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` and the name of an added column: the probability that a whole text is toxic.

    A null or empty text scores as one whose words share nothing with an insult.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # 4 MB whatever the data
    out = fresh_name(docs, "toxicity")
    known: dict[str, float] = {}

    @F.arrow_udf("double")
    def worst(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        rest = [m.intercept] * WORST
        for texts in batches:
            tops = [np.zeros((0, WORST))]
            for part in (g for some in text_slices(texts) for g in grouped(some, BATCH_CHARS)):
                found = [tokens(t) for t in part]
                if len(known) > MAX_TOKENS:
                    known.clear()
                new = sorted(set().union(*found).difference(known))
                for s in range(0, len(new), _CHUNK):
                    some = new[s : s + _CHUNK]
                    known.update(zip(some, m.words(some).tolist(), strict=True))
                tops.append(np.array([(nlargest(WORST, map(known.__getitem__, f)) + rest)[:WORST] for f in found]))
            yield pa.array(m.probability(np.concatenate(tops)), pa.float64())

    return docs.withColumn(out, worst(F.coalesce(F.col(text_col), F.lit("")))), out
