"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words sums, over all four-letter subsequences that both have, the products of their
weights; a subsequence may have gaps, up to SPAN letters in all, and every letter spanned costs DECAY.
So an insult still matches with inserted or lost letters.  Symbols inside a word are dropped, and single
letters in a row are read as one word.  A sentence is as toxic as its worst word.

Training runs in one task over a bounded sample (at most MOST_TOXIC and MOST_CLEAN labelled rows in the order
of a hash, and MOST_BYTES of whole texts; a text that would pass that bound is left out).  Five-letter runs that tell toxic from clean documents name the
landmark words; some frequent words join them.  The SVM on the Nystroem features is first fitted to words with such
runs that hardly any clean sentence has, against all words of clean ones.  Then the labelled sentences are its examples,
each with its document's label: a sentence's margin is its highest word's, so a clean sentence asks all its
words to stay below, and a toxic one asks the word that speaks for it to rise (as in SVMs for instances in labelled
bags; sentences of toxic documents that the machine does not hold for toxic do not ask, for they may be clean).
A logistic function of a document's highest sentence margins and of how many words are sure hits, fitted on rows the SVM
did not see and weighted to the labels' own proportion, gives the score; the same rows choose how telling a run must be.

Scoring: the SVM's decision is linear in a word's subsequence weights, so landmarks and machine fold
into one table of fixed size.  A word costs a few look-ups for each letter, once for each distinct word
of a batch of texts.

Defined cases: a null or empty text has no sentence and gets the score of a text without margins; a
null doc_id is neither held out nor used in training; labels that are null are not used; with one class
alone (or no labels) the score is that class's share (or 0); rows that repeat are scored each; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm import common, encoding, word_hash

#: The bound of the training sample: rows of each class, and bytes of their whole texts.
MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 700, 800, 4_000_000
LANDMARKS, FREQUENT, PER_RUN, RUN = 128, 32, 2, 5
#: A telling run is in so many toxic documents, and so many times as often in them as in clean ones.
LEAST_TOXIC, LEAST_ODDS = 3, 4.0
#: Levels of a telling run's excess; the one with the least loss on the rows that calibrate is taken.
EXCESSES = (3.0, 4.0, 6.0)
SPAN, DECAY = 6, 0.7
# Places of a subsequence's other letters after its first, and weights relative to one without gaps.
_GAPS = [(i, j, k) for k in range(3, SPAN) for j in range(2, k) for i in range(1, j)]
_WEIGHT = {k: DECAY ** (k - 3) for k in range(3, SPAN)}
#: Subsequences are hashed to so many bits.
BITS = 20
FEATURES = 6
#: Least width by which a feature is scaled: what hardly varies in training must not decide.
NARROW = np.array([0.2, 0.2, 0.2, 0.3, 0.2, 0.005])
#: Margin beyond which a word counts as a hit; rounds in which sentences choose their witness anew.
HIT, ROUNDS = 0.7, 1
CHUNK_BYTES = 3_000_000
THRESHOLD = 0.3

# Letters as six bits: a-z, the low bits of bytes beyond ASCII (in which case folds), digits, the word's ends.
_CODE = np.zeros(256, dtype=np.uint8)
_CODE[65:91] = _CODE[97:123] = np.arange(1, 27)
_CODE[128:256] = 27 + (np.arange(128, 256) & 31)
_CODE[48:58] = 59
_FIRST, _LAST = 61, 62


@dataclass
class Words:
    """The distinct words of some texts as letters, and where they stand."""

    codes: np.ndarray  # letters of all distinct words, ends included
    owner: np.ndarray  # the word of each letter
    lengths: np.ndarray
    of: np.ndarray  # per occurrence, its distinct word
    text: np.ndarray  # per occurrence, its text
    starts: np.ndarray  # occurrences that begin a sentence


def read_words(offsets: np.ndarray, data: np.ndarray) -> Words:
    start, end, text = word_hash.word_places(offsets, data)
    none = np.zeros(0, dtype=np.int64)
    if not len(start):
        return Words(none, none, none, none, none, none)
    feeds = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(data == 10, out=feeds[1:])
    last = data[end - 1]
    stop = (last == 46) | (last == 33) | (last == 63)
    single = end - start == 1
    glued = np.concatenate([[False], single[1:] & single[:-1] & (start[1:] - end[:-1] == 1) & (text[1:] == text[:-1]) & (_CODE[data[start[1:]]] > 0)])
    fresh = np.concatenate([[True], stop[:-1] | (feeds[start[1:]] > feeds[end[:-1]]) | (text[1:] != text[:-1])])
    head = np.flatnonzero(~glued)
    group = np.cumsum(~glued) - 1
    # All letters with their word; symbols go.
    solid = np.concatenate([[0], np.cumsum(end - start)])
    place = np.arange(solid[-1], dtype=np.int32) - np.repeat((solid[:-1] - start).astype(np.int32), end - start)
    codes = _CODE[data[place]]
    del place
    keep = codes > 0
    owner = np.repeat(group.astype(np.int32), end - start)[keep]
    codes = codes[keep]
    n = len(head)
    lengths = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(lengths)])
    # A hash of each word's letters finds the distinct ones.
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.multiply(codes + np.uint64(1), word_hash.powers(0x9E3779B97F4A7C15, len(codes)), out=sums[1:])
    np.cumsum(sums, out=sums)
    back = word_hash.powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), len(codes) + 1)
    hashed = word_hash.mix((sums[first[1:]] - sums[first[:-1]]) * back[first[:-1]] + lengths.astype(np.uint64))
    del sums, back
    _, index, of = np.unique(hashed, return_index=True, return_inverse=True)
    size = lengths[index]
    total = np.concatenate([[0], np.cumsum(size + 2)])
    letters = np.empty(total[-1], dtype=np.int64)
    letters[total[:-1]], letters[total[1:] - 1] = _FIRST, _LAST
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    letters[np.repeat(total[:-1] + 1, size) + at] = codes[np.repeat(first[index], size) + at]
    return Words(letters, np.repeat(np.arange(len(index)), size + 2), size, of, text[head], np.flatnonzero(fresh[head]))


def _subsequences(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(distinct word, subsequence number, weight) for each gap pattern."""
    for i, j, k in _GAPS:
        n = len(w.codes) - k
        if n <= 0:
            continue
        at = np.flatnonzero(w.owner[:n] == w.owner[k:])
        number = (w.codes[at] << 18) | (w.codes[at + i] << 12) | (w.codes[at + j] << 6) | w.codes[at + k]
        yield w.owner[at], (number * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - BITS), _WEIGHT[k]


def _scale(lengths: np.ndarray) -> np.ndarray:
    """What brings a word of this length to unit size (repeated subsequences aside)."""
    size = np.zeros(len(lengths))
    for *_, k in _GAPS:
        size += np.maximum(lengths + 2 - k, 0) * _WEIGHT[k] ** 2
    return 1 / np.sqrt(np.maximum(size, 1e-9))


def word_values(w: Words, table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(w.lengths))
    for word, number, weight in _subsequences(w):
        out += weight * np.bincount(word, weights=table[number], minlength=len(out))
    return out * _scale(w.lengths)


def _margins(w: Words, values: np.ndarray, bias: float, n_texts: int) -> np.ndarray:
    """Per text: its three highest sentence margins (missing ones as no word would have), logs of 1 + sentences and
    of 1 + words beyond the margin, and the share of such words."""
    out = np.full((n_texts, FEATURES), bias)
    out[:, 3:] = 0.0
    if len(w.starts):
        f = np.maximum.reduceat(values[w.of], w.starts) + bias
        text = w.text[w.starts]
        order = np.lexsort((-f, text))
        f, text = f[order], text[order]
        rank = np.arange(len(text)) - np.searchsorted(text, text, side="left")
        for r in range(3):
            out[text[rank == r], r] = f[rank == r]
        hits = np.bincount(w.text, weights=values[w.of] + bias > HIT, minlength=n_texts)
        out[:, 3] = np.log1p(np.bincount(text, minlength=n_texts))
        out[:, 4] = np.log1p(hits)
        out[:, 5] = np.minimum(0.1, hits / np.maximum(1, np.bincount(w.text, minlength=n_texts)))
    return out


@dataclass
class Model:
    table: np.ndarray
    bias: float
    center: np.ndarray
    width: np.ndarray
    weights: np.ndarray
    constant: float

    def scores(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        w = read_words(offsets, data)
        x = _margins(w, word_values(w, self.table) if len(w.of) else np.zeros(0), self.bias, len(offsets) - 1)
        z = ((x - self.center) / self.width) @ self.weights + self.constant
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _hinge(x: np.ndarray, rows: np.ndarray, y: np.ndarray, mass: np.ndarray, cost: float = 3000.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss over rows of x, weighted by mass and classes alike, by Newton steps on its margin rows."""
    weight = np.where(y > 0, 0.5 * mass / max(1, mass[y > 0].sum()), 0.5 * mass / max(1, mass[y < 0].sum())) * cost
    v = np.zeros(x.shape[1] + 1)
    ridge = np.ones(len(v))
    ridge[-1] = 1e-6
    active = None
    for _ in range(steps):
        now = np.flatnonzero(y * ((x @ v[:-1].astype(np.float32))[rows] + v[-1]) < 1)
        if active is not None and np.array_equal(now, active):
            break
        active, gram, right = now, np.diag(ridge), np.zeros(len(v))
        for lo in range(0, len(now), 8_000):
            at = now[lo : lo + 8_000]
            some = np.concatenate([x[rows[at]].astype(np.float64), np.ones((len(at), 1))], axis=1)
            scaled = some * weight[at, None]
            gram += 2 * scaled.T @ some
            right += 2 * scaled.T @ y[at]
        v = np.linalg.solve(gram, right)
    return v[:-1], float(v[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    full = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(full.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve(full.T @ (full * (weight * p * (1 - p))[:, None]) + penalty, full.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _excess(toxic: np.ndarray, every: np.ndarray, n_toxic: int, n_docs: int) -> np.ndarray:
    """How many standard deviations toxic documents have above their share."""
    share = n_toxic / n_docs
    return (toxic - share * every) / np.sqrt(np.maximum(share * (1 - share) * every * (1 - every / n_docs), 1e-9) + 0.5)


def _odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    return (toxic + 0.5) / max(1, all_toxic) / ((clean + 0.5) / max(1, all_clean))


def _runs(w: Words, seen: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct word, run number) of all five-letter runs, and each run's excess (-10 where clean texts use it as well).

    seen: (word, text) pairs.
    """
    n = len(w.codes) - RUN + 1
    at = np.flatnonzero(w.owner[:n] == w.owner[RUN - 1 :])
    grams = np.zeros(len(at), dtype=np.int64)
    for i in range(RUN):
        grams = grams << 6 | w.codes[at + i]
    names, number = np.unique(grams, return_inverse=True)
    word, m = w.owner[at], len(names)
    ends = np.searchsorted(word, np.arange(len(w.lengths) + 1))
    once, twice, used = np.zeros((3, 2, m))  # documents with one word that has the run, with two such words, and words; clean and toxic
    for lo in range(0, len(seen), 200_000):  # pairs are ordered by text: a text's pairs may meet a cut once
        some = seen[lo : lo + 200_000]
        n_runs = ends[some[:, 0] + 1] - ends[some[:, 0]]
        place = np.arange(n_runs.sum()) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs) + np.repeat(ends[some[:, 0]], n_runs)
        both, times = np.unique(np.repeat(some[:, 1], n_runs) * m + number[place], return_counts=True)
        label, run = y[both // m], both % m
        for which in (0, 1):
            mine = label == which
            once[which] += np.bincount(run[mine], minlength=m)
            twice[which] += np.bincount(run[mine & (times > 1)], minlength=m)
            used[which] += np.bincount(run[mine], weights=times[mine], minlength=m)
    texts = np.unique(seen[:, 1])
    n_toxic = int(y[texts].sum())
    odds = _odds(used[1], used[0], (y[seen[:, 1]] == 1).sum(), (y[seen[:, 1]] == 0).sum())
    excess = np.maximum(*(_excess(docs[1], docs.sum(axis=0), n_toxic, len(texts)) for docs in (once, twice)))
    return word, number, np.where((once[1] >= LEAST_TOXIC) & (odds >= LEAST_ODDS), excess, -10.0)


def _landmarks(w: Words, runs: tuple, with_toxic: np.ndarray, with_any: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The landmark words, and for every word the excess of its second most telling run (one may be a coincidence)."""
    n_words = len(w.lengths)
    word, number, excess = runs
    ranked = np.lexsort((-excess[number], word))
    second = np.searchsorted(word[ranked], np.arange(n_words)) + 1
    has = np.bincount(word, minlength=n_words) > 1
    told = np.full(n_words, -10.0)
    told[has] = excess[number[ranked[second[has]]]]
    # Of each telling run, the words that most toxic documents have.
    order = np.lexsort((-with_toxic[word], number))
    ends = np.searchsorted(number[order], np.arange(len(excess) + 1))
    marks: dict[int, None] = {}
    for run in np.argsort(-excess, kind="stable").tolist():
        if excess[run] <= least or len(marks) >= LANDMARKS:
            break
        having = word[order[ends[run] : ends[run + 1]]]
        for i in having[told[having] > least][:PER_RUN].tolist():
            marks[i] = None
    for i in np.argsort(-with_any, kind="stable")[:FREQUENT].tolist():
        marks[i] = None
    return np.array(list(marks), dtype=np.int64), told


def _features(w: Words, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nystroem features of all distinct words; subsequence numbers, their landmark weights, and the root."""
    scale, m = _scale(w.lengths), len(marks)
    slot_of = np.full(len(w.lengths), -1)
    slot_of[marks] = np.arange(m)
    column = np.full(1 << BITS, -1)
    rows, columns, weights = [], [], []
    for word, number, weight in _subsequences(w):
        mine = slot_of[word] >= 0
        rows.append(slot_of[word[mine]])
        columns.append(number[mine])
        weights.append(np.full(mine.sum(), weight))
    rows, columns, weights = np.concatenate(rows), np.concatenate(columns), np.concatenate(weights)
    numbers = np.unique(columns)
    column[numbers] = np.arange(len(numbers))
    marked = np.zeros((len(numbers), m), dtype=np.float32)
    np.add.at(marked, (column[columns], rows), weights)
    marked *= scale[marks].astype(np.float32)
    kernel = np.zeros((len(w.lengths), m), dtype=np.float32)
    for word, number, weight in _subsequences(w):
        known = np.flatnonzero(column[number] >= 0)
        for lo in range(0, len(known), 50_000):
            some = known[lo : lo + 50_000]
            at = np.flatnonzero(np.concatenate([[True], word[some][1:] != word[some][:-1]]))
            kernel[word[some][at]] += weight * np.add.reduceat(marked[column[number[some]]], at, axis=0)
    kernel *= scale[:, None].astype(np.float32)
    values, vectors = np.linalg.eigh(kernel[marks].astype(np.float64))
    good = values > 1e-4 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    return kernel @ root.astype(np.float32), numbers, marked, root


def _machines(w: Words, y: np.ndarray, fit: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """SVMs fitted to some of the texts, one for each level of EXCESSES: a table of subsequence weights, and the bias."""
    seen = np.unique(w.text.astype(np.int64) * len(w.lengths) + w.of)
    seen = np.stack([seen % len(w.lengths), seen // len(w.lengths)], axis=1)
    seen = seen[fit[seen[:, 1]]]
    runs = _runs(w, seen, y)
    n_toxic, n_clean = (np.bincount(seen[y[seen[:, 1]] == label, 0], minlength=len(w.lengths)) for label in (1, 0))
    odds = _odds(n_toxic, n_clean, (y[seen[:, 1]] == 1).sum(), (y[seen[:, 1]] == 0).sum())
    for least in EXCESSES:
        marks, told = _landmarks(w, runs, n_toxic, n_toxic + n_clean, least)
        # The witnesses: words of sentences in two toxic documents or more that tell much and that clean documents hardly have.
        guilty = np.flatnonzero((told > least) & (n_toxic >= 2) & (odds >= LEAST_ODDS))
        innocent = np.setdiff1d(np.flatnonzero(n_clean), guilty)
        if not len(guilty) or not len(innocent):
            continue
        features, numbers, marked, root = _features(w, marks)
        # The first machine tells the guilty words from all words of clean sentences; after it, sentences are the examples.
        u, bias = _hinge_of(features, guilty, np.ones(len(guilty)), innocent)
        for _ in range(ROUNDS):
            witness, times = _witnesses(w, features @ u.astype(np.float32) + bias, y, fit)
            u, bias = _hinge_of(features, witness, times, np.setdiff1d(np.flatnonzero(n_clean), witness))
        del features
        table = np.zeros(1 << BITS, dtype=np.float32)
        table[numbers] = marked @ (root @ u).astype(np.float32)
        yield table, bias


def _hinge_of(features: np.ndarray, for_it: np.ndarray, times: np.ndarray, against: np.ndarray) -> tuple[np.ndarray, float]:
    rows = np.concatenate([for_it, against])
    label = np.where(np.arange(len(rows)) < len(for_it), 1.0, -1.0)
    return _hinge(features, rows, label, np.concatenate([times, np.ones(len(against))]))


def _witnesses(w: Words, margin: np.ndarray, y: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that toxic sentences are judged by, and for how many sentences each speaks.

    A sentence's margin is its highest word's, so a sentence of a clean document asks every one of its words to stay
    below, and one of a toxic document asks its highest word to rise, if the machine holds that sentence for toxic
    already: a toxic document's other sentences may be clean, and so may a wrongly labelled document be.
    """
    value = margin[w.of]
    best = np.maximum.reduceat(value, w.starts)
    text = w.text[w.starts]
    sentence = np.repeat(np.arange(len(w.starts)), np.diff(np.append(w.starts, len(w.of))))
    asks = (y[text] == 1) & fit[text] & (best > 0)
    speaks = np.flatnonzero(asks[sentence] & (value == best[sentence]))
    once = np.unique(sentence[speaks], return_index=True)[1]
    return np.unique(w.of[speaks[once]], return_counts=True)


def _flat(share: float) -> Model:
    none = np.zeros(FEATURES)
    return Model(np.zeros(1 << BITS, dtype=np.float32), 0.0, none, none + 1, none, float(np.log(max(share, 1e-13) / max(1 - share, 1e-13))))


def train(texts: list[str], toxic: list[int], share: float | None = None) -> Model:
    """Fits the model to some labelled texts, in the order given; share: of toxic rows among all labelled ones.

    Three quarters fit the machines; the rest calibrates their scores and picks one of them.
    """
    y = np.array(toxic, dtype=np.int64)
    share = share if share is not None else float(y.mean()) if len(y) else 0.0
    w = read_words(*common.utf8_buffers(pa.array(texts, pa.string())))
    if len(set(toxic)) < 2 or not len(w.of):
        return _flat(share)
    fit = np.arange(len(y)) % 4 != 3
    held = ~fit
    if len(set(y[fit].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        fit = held = np.ones(len(y), dtype=bool)
    prior = float(y[held].mean())
    weight = np.where(y[held] > 0, share / prior, (1 - share) / (1 - prior))
    best, least = _flat(share), np.inf
    for table, bias in _machines(w, y, fit):
        x = _margins(w, word_values(w, table), bias, len(y))
        center, width = x[held].mean(axis=0), np.maximum(x[held].std(axis=0), NARROW)
        z = (x[held] - center) / width
        weights, constant = _logistic(z, y[held], weight)
        p = np.clip(1 / (1 + np.exp(-np.clip(z @ weights + constant, -30, 30))), 1e-6, 1 - 1e-6)
        loss = -(weight * np.where(y[held] > 0, np.log(p), np.log(1 - p))).mean()
        if loss < least:
            best, least = Model(table, bias, center, width, weights, constant), loss
    return best


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _fit(batches: Iterator[pa.RecordBatch], share: float | None) -> Iterator[pa.RecordBatch]:
    encoding.release()
    texts, toxic, size = [], [], 0
    for rows in batches:
        for text, label in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            if size + len(text) <= MOST_BYTES:  # a text that does not fit any more is passed over
                size += len(text)
                texts.append(text)
                toxic.append(label)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, toxic, share))], pa.binary())], names=["model"])


def fit_model(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains in one task over the bounded sample of rows that are not held out; the driver gets the fitted tables."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    order = [F.xxhash64("doc_id", F.lit(17)), "doc_id"]
    drawn = known.where("toxic = 1").orderBy(*order).limit(MOST_TOXIC).unionByName(known.where("toxic = 0").orderBy(*order).limit(MOST_CLEAN))
    rows = docs.select("doc_id", common.text_or_empty().alias("text")).join(F.broadcast(drawn), "doc_id")  # MOST_TOXIC + MOST_CLEAN rows
    sample = rows.select("text", "toxic", order[0].alias("place"), "doc_id").repartition(1).sortWithinPartitions("place", "doc_id", "text")
    share = counts["t"] / counts["n"] if counts["n"] else None
    fitted = sample.select("text", "toxic").mapInArrow(lambda it: _fit(it, share), "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else train([], [])


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    encoding.release()
    for rows in batches:
        offsets, data = common.utf8_buffers(rows.column(rows.num_columns - 1))
        parts = [model.value.scores(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]) for lo, hi in common.chunks_by_bytes(offsets, CHUNK_BYTES)]
        score = np.concatenate(parts) if parts else np.zeros(0)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    common.prepare(spark)
    model = spark.sparkContext.broadcast(fit_model(docs, labels))
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _score(it, model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _clean(batches: Iterator[pa.RecordBatch], model, text: int) -> Iterator[pa.RecordBatch]:
    """The rows, all their columns, whose score stays below the threshold."""
    encoding.release()
    for rows in batches:
        offsets, data = common.utf8_buffers(rows.column(text))
        for lo, hi in common.chunks_by_bytes(offsets, CHUNK_BYTES):
            score = model.value.scores(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])
            yield rows.slice(lo, hi - lo).filter(pa.array(score < THRESHOLD))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, each judged by its own text."""
    spark = docs.sparkSession
    common.prepare(spark)
    model = spark.sparkContext.broadcast(fit_model(docs, labels))
    text = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _clean(it, model, text), docs.schema)
