"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

Instances are windows of one to ``WORDS`` adjacent words of labelled sentences. The
kernel compares two windows by all their common three-symbol subsequences; one that
spans s symbols weighs DECAY ** s, and spans over ``SPAN`` symbols count nothing.
Symbols are letters and the blanks between, before and after words, which are symbols
like others, so letters, blanks or dots put into an insult (``idxiot``, ``idi ot``,
``stu.pid``) only cost some weight, and an insult may have several words. Digits that
stand for letters are read as those, marks inside a word are passed over, and letters
spelled out one by one are joined again. Kernel values are divided by the norm that
windows of that length have when no subsequence repeats.

Positive instances are the windows that toxic documents use beyond chance. Landmarks
are the strongest of them, and the most frequent clean words. Nyström features of an
instance are its kernel values with the landmarks times the inverse root of the
landmarks' kernel matrix; a linear support vector machine on them is trained in
rounds, each adding the clean windows that the last round scored highest (the clean
sentences are scanned with the same distributed pass as the corpus). A document is as
toxic as its worst window; a logistic curve turns that margin into a score.

As the machine is linear in the landmarks' feature vectors, their weighted sum is one
table over symbol triples. Sums over windows are differences of running sums of table
entries, so the exact margin of every window of a text costs little.

Only the rows of at most ``max_labelled`` labelled documents are learned from;
windows are counted in Spark, by hash, and at most ``CANDIDATES`` of a kind reach the
driver. The broadcast model is one table of 64 ** 3 floats.

Defined cases: a null text counts as empty; a text without words gets the score of an
empty window; without toxic or clean labelled rows every score is 0; where no window
occurs beyond chance (few labels), each toxic document teaches the window whose letters
differ most from those of clean documents; null labels teach nothing, an id labelled
twice teaches the smaller label; a null doc_id is held out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, stored
from .knn_quality import labelled_rows
from .words import _RADIX, mix, row_slices, strings

SYMBOLS, SPAN, DECAY = 64, 5, 0.7
CANDIDATES = 2000
LANDMARKS = 256
#: of the strongest insults, so many also teach gapped spellings
GAPPED = 64
ROUNDS = 3
#: least log-likelihood ratio of an insult: such an excess comes by chance for one word in about a million
EVIDENCE = 13.0
#: words of a window
WORDS = 3
#: windows of toxic documents that are counted in clean ones, most frequent first
MOST_WINDOWS = 500_000
SLICE_BYTES = 2 << 20

_SKIP = 255
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:192] = 27 + np.arange(64) % 36
_SYMBOL[192:] = _SKIP
for _mark in b"*-_'+^~#$%&`2689":
    _SYMBOL[_mark] = _SKIP
for _mark, _letter in zip(b"013457@", b"oieasta"):
    _SYMBOL[_mark] = _SYMBOL[_letter]


def spell(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words of some rows, each word between boundary marks (0); the word of every symbol; the row
    of every word."""
    base = int(offsets[0])
    s = _SYMBOL[data[base:int(offsets[-1])]]
    kept = np.flatnonzero(s != _SKIP)
    c = s[kept]
    row = np.searchsorted(offsets - base, kept, side="right") - 1 if len(offsets) < 3 else np.repeat(
        np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[kept]
    letter = c > 0
    start = letter.copy()
    start[1:] &= (c[:-1] == 0) | (row[1:] != row[:-1])
    first = np.flatnonzero(start[letter])
    c, row = c[letter], row[letter]
    if not len(first):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(c)))
    word_row = row[first]
    # letters spelled out one by one are one word
    joined = np.zeros(len(first), bool)
    joined[1:] = (length[1:] == 1) & (length[:-1] == 1) & (word_row[1:] == word_row[:-1])
    first, word_row = first[~joined], word_row[~joined]
    length = np.diff(np.append(first, len(c)))
    word = np.repeat(np.arange(len(first)), length)
    out = np.zeros(len(c) + 2 * len(first), np.uint8)
    out[np.arange(len(c)) + 2 * word + 1] = c
    return out, np.repeat(np.arange(len(first)), length + 2), word_row


def triples(c: np.ndarray, word: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """For every gap pattern: its weight, where it fits, and the triples (as table indexes) there."""
    c = c.astype(np.int32)
    for d in range(2, SPAN + 1):
        if len(c) <= d:
            break
        at = np.flatnonzero(word[d:] == word[:-d])
        outer = (c[at] << 12) | c[at + d]
        for a in range(1, d):
            yield DECAY ** (d + 1), at, outer | (c[at + a] << 6)


def length_norm(length: np.ndarray) -> np.ndarray:
    """Kernel norm of windows of so many symbols without repeated subsequences."""
    square = np.zeros(np.shape(length))
    for d in range(2, SPAN + 1):
        square += np.maximum(np.asarray(length) - d, 0) * (d - 1) * DECAY ** (2 * d + 2)
    return np.sqrt(np.maximum(square, DECAY ** 6))


def features(c: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Explicit kernel features of n windows, (window, triple, value), divided by the norm of their length."""
    keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
    for weight, at, index in triples(c, word):
        keys.append(word[at] * (SYMBOLS ** 3) + index)
        values.append(np.full(len(at), weight))
    keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    values = np.bincount(inverse, np.concatenate(values), minlength=len(keys)) if len(keys) else np.zeros(0)
    owner = keys // SYMBOLS ** 3
    return owner, keys % SYMBOLS ** 3, values / length_norm(np.bincount(word, minlength=n))[owner]


def stream(c: np.ndarray, word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols with one blank between the words of a row, and the blanks before and after each word."""
    n = len(row)
    first = np.searchsorted(word, np.arange(n))
    follows = np.zeros(n, bool)
    follows[1:] = row[1:] == row[:-1]
    keep = np.ones(len(c), bool)
    keep[first[follows]] = False
    place = np.cumsum(keep) - 1
    last = np.append(first[1:], len(c)) - 1
    return c[keep], place[first], place[last]


def window_margins(table: np.ndarray, bias: float, c: np.ndarray, word: np.ndarray,
                   row: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(first words, number of words, margins) of all windows of one word, of two, and so on."""
    c, begin, end = stream(c, word, row)
    wide, sums = c.astype(np.int32), []
    for d in range(2, SPAN + 1):
        total = np.zeros(len(c) + 1)
        if len(c) > d:
            outer = (wide[:-d] << 12) | wide[d:]
            part = np.zeros(len(outer))
            for a in range(1, d):
                part += table[outer | (wide[a:len(c) - d + a] << 6)]
            total[1:len(outer) + 1] = np.cumsum(part) * DECAY ** (d + 1)
            total[len(outer) + 1:] = total[len(outer)]
        sums.append(total)
    for k in range(1, WORDS + 1):
        n = len(row) - k + 1
        if n <= 0:
            break
        at = np.flatnonzero(row[:n] == row[k - 1:])
        b, e = begin[at], end[at + k - 1]
        total = np.zeros(len(at))
        for d, upto in zip(range(2, SPAN + 1), sums):
            total += upto[np.maximum(e - d + 1, b)] - upto[b]
        yield at, k, total / length_norm(e - b + 1) + bias


def document_margins(table: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Margin of each row's worst window; that of an empty window (the bias) for rows without words."""
    out = np.full(len(offsets) - 1, -np.inf)
    c, word, row = spell(data, offsets)
    if len(row):
        for at, _, margin in window_margins(table, bias, c, word, row):
            np.maximum.at(out, row[at], margin)
    return np.where(np.isinf(out), bias, out)


def _text_of(c: np.ndarray) -> str:
    """A window's symbols as text, for keys and counting (blanks between its words)."""
    return "".join(chr(96 + s) if 0 < s < 27 else chr(0x100 + int(s)) if s else " " for s in c).strip(" ")


def _symbols_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    code = lambda x: 0 if x == " " else ord(x) - 96 if ord(x) < 0x100 else ord(x) - 0x100
    parts = [[0, *map(code, w), 0] for w in words]
    return (np.array([s for p in parts for s in p], np.uint8),
            np.repeat(np.arange(len(parts)), [len(p) for p in parts]))


def _window_hashes(c: np.ndarray, word: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(first words, number of words, hashes, hashes of the words on both sides) of all windows."""
    n = len(row)
    first = np.searchsorted(word, np.arange(n))
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(c), _RADIX, np.uint64)))
    place = np.arange(len(c)) - first[word]
    # a polynomial over a word's symbols; boundary marks are 0 and add nothing
    single = np.zeros(n, np.uint64)
    np.add.at(single, word, (c.astype(np.uint64) + np.uint64(1)) * power[place])
    single = mix(single)
    before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    before[1:] = np.where(row[1:] == row[:-1], single[:-1], np.uint64(0))
    after[:-1] = np.where(row[1:] == row[:-1], single[1:], np.uint64(0))
    for k in range(1, WORDS + 1):
        m = n - k + 1
        if m <= 0:
            break
        at = np.flatnonzero(row[:m] == row[k - 1:])
        h = single[at]
        for j in range(1, k):
            h = mix(h * np.uint64(_RADIX) + single[at + j])
        yield at, k, h.view(np.int64), mix(before[at] * np.uint64(_RADIX) + after[at + k - 1]).view(np.int64)


def _window_uses(of: int, wanted: np.ndarray | None = None):
    """(window, words on both sides) in documents with label ``of``; only the ``wanted`` windows, if given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            mine = np.array(batch.column(0).to_pylist()) == of
            for a, b in row_slices(offsets, SLICE_BYTES):
                c, word, row = spell(data, offsets[a:b + 1])
                if not len(row):
                    continue
                for at, _, h, sides in _window_hashes(c, word, row):
                    keep = mine[a + row[at]]
                    if wanted is not None:
                        keep &= np.isin(h, wanted)
                    both = np.unique(np.column_stack([h[keep], sides[keep]]), axis=0)
                    yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["window", "sides"])

    return run


def _window_texts(wanted: np.ndarray):
    """(window, text) of the wanted windows."""
    def run(batches):
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for a, b in row_slices(offsets, SLICE_BYTES):
                c, word, row = spell(data, offsets[a:b + 1])
                if not len(row):
                    continue
                texts = {}
                for at, k, h, _ in _window_hashes(c, word, row):
                    hit = np.flatnonzero(np.isin(h, wanted))
                    _, pick = np.unique(h[hit], return_index=True)
                    for j in hit[pick]:
                        texts[int(h[j])] = _window_text(c, word, int(at[j]), k)
                yield pa.record_batch([pa.array(list(texts), pa.int64()), pa.array(list(texts.values()), pa.string())],
                                      names=["window", "text"])

    return run


def _window_text(c: np.ndarray, word: np.ndarray, first: int, k: int) -> str:
    a, b = np.searchsorted(word, [first, first + k])
    return " ".join(_text_of(c[a:b][word[a:b] == w]) for w in range(first, first + k))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic) once per document."""
    for batch in batches:
        data, offsets = strings(batch.column(1))
        toxic = batch.column(0).to_pylist()
        for a, b in row_slices(offsets, SLICE_BYTES):
            c, word, row = spell(data, offsets[a:b + 1])
            if not len(row):
                continue
            ends = np.append(np.flatnonzero(np.diff(word)) + 1, len(c))
            seen = set()
            begin = 0
            for w, end in enumerate(ends.tolist()):
                seen.add((int(row[w]), c[begin + 1:end - 1].tobytes()))
                begin = end
            yield pa.record_batch([pa.array([_text_of(np.frombuffer(w, np.uint8)) for _, w in seen], pa.string()),
                                   pa.array([toxic[a + r] for r, _ in seen], pa.int32())], names=["word", "toxic"])


def _hard_windows(table: np.ndarray, bias: float):
    """The windows with the highest margins, best ``CANDIDATES`` of each slice and number of words."""
    def run(batches):
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for a, b in row_slices(offsets, SLICE_BYTES):
                c, word, row = spell(data, offsets[a:b + 1])
                texts, worth = [], []
                if len(row):
                    for at, k, margin in window_margins(table, bias, c, word, row):
                        best = np.argsort(-margin, kind="stable")[:CANDIDATES]
                        best = best[margin[best] > bias]
                        texts += [_window_text(c, word, int(at[j]), k) for j in best]
                        worth.append(margin[best])
                yield pa.record_batch([pa.array(texts, pa.string()), pa.array(np.concatenate([np.zeros(0), *worth]))],
                                      names=["word", "margin"])

    return run


def _triple_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per label, in how many documents each contiguous triple occurs: (toxic, counts as int32 bytes)."""
    total = np.zeros((2, SYMBOLS ** 3), np.int32)
    for batch in batches:
        data, offsets = strings(batch.column(1))
        toxic = np.array(batch.column(0).to_pylist())
        for a, b in row_slices(offsets, SLICE_BYTES):
            c, word, row = spell(data, offsets[a:b + 1])
            if len(row):
                _, at, index = next(triples(c, word))
                seen = np.unique(row[word[at]].astype(np.int64) * SYMBOLS ** 3 + index)
                np.add.at(total, (toxic[a + seen // SYMBOLS ** 3], seen % SYMBOLS ** 3), 1)
    yield pa.record_batch([pa.array([0, 1], pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["toxic", "counts"])


def _oddest_windows(table: np.ndarray):
    """The window of each toxic document with the highest sum of table entries."""
    def run(batches):
        for batch in batches:
            data, offsets = strings(batch.column(1))
            toxic = np.array(batch.column(0).to_pylist())
            texts = []
            for a, b in row_slices(offsets, SLICE_BYTES):
                c, word, row = spell(data, offsets[a:b + 1])
                for r in np.flatnonzero(toxic[a:b] == 1) if len(row) else ():
                    w0, w1 = np.searchsorted(row, [r, r + 1])
                    if w1 > w0:
                        i, j = np.searchsorted(word, [w0, w1])
                        at, _, margin = next(window_margins(table, 0.0, c[i:j], word[i:j] - w0, row[w0:w1]))
                        texts.append(_window_text(c, word, int(w0 + at[np.argmax(margin)]), 1))
            yield pa.record_batch([pa.array(texts, pa.string())], names=["word"])

    return run


def oddest(rows: DataFrame, n1: int, n0: int) -> list[str]:
    """For small label sets: from every toxic document the word whose letters differ most from those of clean ones."""
    counts = {0: np.zeros(SYMBOLS ** 3), 1: np.zeros(SYMBOLS ** 3)}
    for r in rows.mapInArrow(_triple_counts, "toxic int, counts binary").toLocalIterator():
        counts[r["toxic"]] += np.frombuffer(r["counts"], np.int32)
    odds = np.log((counts[1] + 0.5) / (n1 + 1)) - np.log((counts[0] + 0.5) / (n0 + 1))
    found = rows.mapInArrow(_oddest_windows(np.where(counts[1] > 0, odds, 0.0)), "word string")
    return [r["word"] for r in found.groupBy("word").count().orderBy(F.desc("count"), "word").limit(CANDIDATES).collect()]


def _margins(table: np.ndarray, bias: float):
    def run(batches):
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for a, b in row_slices(offsets, SLICE_BYTES):
                yield pa.record_batch([batch.column(0).slice(a, b - a),
                                       pa.array(document_margins(table, bias, data, offsets[a:b + 1]))],
                                      names=["toxic", "margin"])

    return run


def hinge_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 3.0,
                  passes: int = 60) -> tuple[np.ndarray, float]:
    """Linear support vector machine by dual coordinate ascent (the bias is one more constant feature)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    q, cap = (x ** 2).sum(1), strength * weight
    order = np.random.default_rng(0)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(x)):
            step = alpha[i] + (1 - y[i] * (x[i] @ w)) / q[i]
            new = min(max(step, 0.0), cap[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w[:-1], float(w[-1])


def inserted(word: str) -> list[str]:
    """Spellings of a word with one more symbol: doubled, a foreign letter, and a blank, at a third and two thirds."""
    if len(word) < 4:
        return []
    out = []
    for at in (len(word) // 3, 2 * len(word) // 3):
        out += [word[:at] + word[at - 1] + word[at:], word[:at] + "x" + word[at:]]
        if word[at - 1] != " " != word[at]:
            out.append(word[:at] + " " + word[at:])
    return out


def train(positive: list[str], negative: list[str], hard: list[str] = ()) -> tuple[np.ndarray, float]:
    """Triple table and bias of the machine; the lists are ordered by importance."""
    marks = positive[:LANDMARKS] + negative[:LANDMARKS // 2] + list(hard[:LANDMARKS // 2])
    negative = negative + list(hard)
    z, used = _dense(marks)
    values, vectors = np.linalg.eigh(z @ z.T)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep]) @ vectors[:, keep].T
    spelt = [(v, k) for k, w in enumerate(positive[:GAPPED]) for v in inserted(w)]
    gapped = [v for v, _ in spelt]
    everything = positive + gapped + negative
    x = np.vstack([_dense(everything[k:k + 500], used)[0] @ z.T for k in range(0, len(everything), 500)]) @ root
    y = np.array([1.0] * (len(positive) + len(gapped)) + [-1.0] * len(negative))
    weight = np.ones(len(y))
    weight[:len(positive)] = np.sqrt(len(positive) / (1 + np.arange(len(positive))))  # the surest insults weigh most
    weight[len(positive):len(positive) + len(gapped)] = [0.5 * weight[k] for _, k in spelt]
    w, bias = hinge_machine(x, y, weight)
    table = np.zeros(SYMBOLS ** 3, np.float32)
    table[used] = (root @ w) @ z
    return table, bias


def _dense(words: list[str], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit feature vectors over the triples ``used`` (default: those that occur)."""
    owner, index, value = features(*_symbols_of(words), len(words))
    if used is None:
        used = np.unique(index)
    out = np.zeros((len(words), len(used)))
    at = np.minimum(np.searchsorted(used, index), max(len(used) - 1, 0))
    known = used[at] == index
    out[owner[known], at[known]] = value[known]
    return out, used


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities (Newton steps with a small ridge)."""
    x = np.column_stack([margin, np.ones(len(margin))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 0.05 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _beyond_chance(rows: DataFrame, share: float) -> list[str]:
    """Windows that toxic documents use beyond chance, strongest first. A use counts once for the same words on both
    sides, so copies and shared passages count once. A window that holds a stronger one is left out."""
    uses = lambda of, wanted=None: (rows.mapInArrow(_window_uses(of, wanted), "window long, sides long")
                                    .distinct().groupBy("window").agg(F.count(F.lit(1)).alias(f"n{of}")))
    often = stored(uses(1)
                   # fewer cannot reach the evidence, even if no clean document has the window
                   .where(F.col("n1") * -float(np.log(share)) >= EVIDENCE), "windows")
    top = often.orderBy(F.desc("n1"), "window").limit(MOST_WINDOWS).collect()
    wanted = np.sort(np.array([r["window"] for r in top], np.int64))
    found = (often.join(uses(0, wanted), "window", "left").fillna(0, ["n0"]).where("n1 >= n0")
             .withColumn("ratio", _ratio(share)).where(F.col("ratio") >= EVIDENCE)
             .orderBy(F.desc("ratio"), "window").limit(CANDIDATES).collect())
    picked = np.sort(np.array([r["window"] for r in found], np.int64))
    texts = {r["window"]: r["text"] for r in rows.where("toxic = 1").mapInArrow(_window_texts(picked), "window long, text string")
             .groupBy("window").agg(F.min("text").alias("text")).collect()}
    kept: list[str] = []
    for r in sorted(found, key=lambda r: (-r["ratio"], len(texts[r["window"]]), texts[r["window"]])):
        parts = texts[r["window"]].split(" ")
        pieces = {" ".join(parts[a:b]) for a in range(len(parts)) for b in range(a + 1, len(parts) + 1)}
        if len(texts[r["window"]]) > 2 and pieces.isdisjoint(kept):
            kept.append(texts[r["window"]])
    return kept


def _ratio(share: float):
    """How far beyond chance toxic documents use a window: log-likelihood ratio against their share."""
    n = F.col("n0") + F.col("n1")
    part = lambda k, p: F.when(k > 0, k * F.log(k / n / p)).otherwise(0.0)
    return part(F.col("n1"), share) + part(F.col("n0"), 1 - share)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text",
        max_labelled: int = 20_000) -> dict | None:
    chosen = labelled_rows(docs, labels, label_col, max_labelled)
    rows = stored(docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["__id"])
                  .select(chosen["__label"].alias("toxic"), docs[text_col].alias("t")), "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return None
    counts = stored(rows.mapInArrow(_count_words, "word string, toxic int").groupBy("word").agg(
        F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")).where(F.length("word") > 2), "words")
    texts = {r["toxic"]: r["n"] for r in rows.select("toxic", F.xxhash64("t").alias("x")).distinct().groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    share = texts[1] / (texts[0] + texts[1])
    positive = _beyond_chance(rows, share) or oddest(rows, sizes[1], sizes[0])
    if not positive:
        return None
    common = counts.where("n0 > 0").orderBy(F.desc("n0"), "word").limit(CANDIDATES).collect()
    spare = counts.where("n0 > 0").orderBy(F.xxhash64("word"), "word").limit(CANDIDATES).collect()
    known = set(positive)
    negative = list(dict.fromkeys(r["word"] for r in [*common, *spare] if r["word"] not in known))
    known.update(negative)
    hard: list[str] = []
    clean = rows.where("toxic = 0")
    for turn in range(ROUNDS):
        table, bias = train(positive, negative, hard)
        if turn < ROUNDS - 1:
            worst = (clean.mapInArrow(_hard_windows(table, bias), "word string, margin double")
                     .groupBy("word").agg(F.max("margin").alias("m")).orderBy(F.desc("m"), "word")
                     .limit(CANDIDATES // 2).collect())
            fresh = [r["word"] for r in worst if r["word"] not in known]
            known.update(fresh)
            hard = fresh + hard
    got = (rows.mapInArrow(_margins(table, bias), "toxic int, margin double")
           .groupBy(F.round("margin", 2).alias("m"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect())
    margin = np.repeat([r["m"] for r in got], [r["n"] for r in got])
    slope, offset = logistic_curve(margin, np.repeat([float(r["toxic"]) for r in got], [r["n"] for r in got]))
    return {"table": table, "bias": bias, "slope": max(slope, 0.0), "offset": offset}


def scores(model: dict | None, column: pa.Array) -> np.ndarray:
    """Score of every text of a column."""
    out = np.zeros(len(column))
    if model:
        data, offsets = strings(column)
        for a, b in row_slices(offsets, SLICE_BYTES):
            # running sums differ in their last digits with the rows before
            margin = np.round(document_margins(model["table"], model["bias"], data, offsets[a:b + 1]), 9)
            out[a:b] = 1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["offset"], -30, 30)))
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
                   text_col: str = "text", threshold: float = 0.3, **fitting) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label_col, text_col, **fitting))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scores(model.value, batch.column(2))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score),
                                   pa.array((score >= threshold).astype(np.int32))],
                                  names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text",
               threshold: float = 0.3, **fitting) -> DataFrame:
    """The documents that are not predicted to be toxic, filtered where they are read."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label_col, text_col, **fitting))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(model.value, batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
