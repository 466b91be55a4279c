"""Toxicity: a linear-chain CRF tags toxic words; its marginals give document scores and offending offsets.

Labels are per document, so the CRF learns from them as a whole: a document is clean if all its
words are, and the forward algorithm gives the chance of that, P0. The likelihood of the labels is
that of P0 for clean documents and of 1 - P0 for toxic ones; its gradient spreads over the words by
the same marginals that tag them. Every word has features of its own and of both neighbours, so a
word that clean texts hold too is told by its context, and words never seen by their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import plain_text, written

#: Most labelled documents of each class that the tagger is fitted on, whole and with all their words.
FIT_TOXIC, FIT_CLEAN = 3_000, 6_000
FOLDS = 5
WORD = re.compile(r"\w+")
#: Numbers of hashed features: the word, its first letters, its last letters, the word before, the word after. Weights are
#: 32-bit floats, so that with the code they stay below the megabyte up to which a task carries them itself.
WIDTHS = (1 << 16, 1 << 14, 1 << 14, 1 << 15, 1 << 15)
AT = tuple(sum(WIDTHS[:k]) for k in range(len(WIDTHS) + 1))  # where each kind begins, and the end
HEAD, TAIL = 4, 3
#: After the features: every word's constant, a text's first word, moves clean-toxic, toxic-clean and toxic-toxic.
EXTRA = 5
SIZE = AT[-1] + EXTRA
#: Words of a piece of a chain; the pieces' products make the result that of the whole text.
PIECE = 256
#: Share of labels taken to be wrong, which bounds what one document can pull.
NOISE = 0.05
STEPS, RATE, RIDGE = 40, 0.3, 0.2
#: Times the ridge for features of neighbours, so that a word is told by itself where that will do.
NEIGHBOURS = 8
#: Toxic documents that a feature must be found in to speak for toxicity, and those for the letters that words share.
SUPPORT, LETTERS = 3, 8
#: Partitions of the bounded sample.
PARTS = 8


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; such rows teach nothing. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def word_features(word: str) -> tuple[int, int, int]:
    """Hashed features of a word in any case: itself, its first and its last letters."""
    low = word.lower()
    return tuple(AT[k] + xxhash.xxh32_intdigest(part.encode("utf-8", "surrogatepass"), k) % WIDTHS[k] for k, part in enumerate((low, low[:HEAD], low[-TAIL:])))


@dataclass(frozen=True)
class Tagger:
    """CRF weights (features, then EXTRA) and the document-level logistic weights; ``known`` is False without labels of both classes."""

    theta: np.ndarray
    logistic: np.ndarray
    known: bool = True


class _Words(dict):
    """Word -> place in ``own``, ``before`` and ``after``: what a word gives itself and its neighbours."""

    def __init__(self, theta: np.ndarray, most: int = 1 << 19):
        super().__init__()
        self.theta = theta.astype(np.float64)
        self.own, self.before, self.after = (np.zeros(most) for _ in range(3))

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n >= len(self.own):
            raise OverflowError("more words than places; clear before a text")
        features = word_features(word)
        self.own[n] = self.theta[list(features)].sum()
        self.before[n] = self.theta[AT[3] + features[0] % WIDTHS[3]]  # as the word before another
        self.after[n] = self.theta[AT[4] + features[0] % WIDTHS[4]]
        self[word] = n
        return n


def _placed(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(order, alive, begins, at)`` of pieces laid end to end, so that all take a step at once: places are sorted by word number, longest pieces first."""
    total, order = int(lengths.sum()), np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), dtype=np.int64)
    rank[order] = np.arange(len(lengths))
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(int(lengths.max())), side="right")
    begins = np.concatenate(([0], np.cumsum(alive)))
    starts = np.cumsum(lengths) - lengths
    return order, alive, begins, begins[np.arange(total) - np.repeat(starts, lengths)] + np.repeat(rank, lengths)


def _between(e: np.ndarray, opens: np.ndarray, alive: np.ndarray, begins: np.ndarray, weights: tuple) -> np.ndarray:
    """What each piece makes of a clean or toxic word before it (rows; columns: its own last word), up to a factor, by piece in the places' order.

    A chain's first piece, in ``opens``, has its own start in both rows.
    """
    first, ct, tc, tt = weights
    rows = np.zeros((2, 2, alive[0]))
    rows[0, 0], rows[1, 1] = 1.0, 1.0
    for t in range(len(alive)):
        n, own = alive[t], e[begins[t] : begins[t + 1]]
        clean, toxic = rows[:, 0, :n], rows[:, 1, :n]
        made = np.stack((clean + toxic * tc, (clean * ct + toxic * tt) * own), axis=1)
        if t == 0:
            made = np.where(opens[None, None, :n], np.stack((np.ones_like(own), first * own))[None], made)
        rows[:, :, :n] = made / made.sum(axis=(0, 1))
    return rows


def chains(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(p, log_p0, at, forward)`` of chains laid end to end, none empty, by the forward-backward algorithm.

    Scores are those of toxic over clean: ``emit`` of each word, ``moves`` of the first word,
    clean-toxic, toxic-clean and toxic-toxic; clean words and moves between them have none. ``p``
    are the marginals and ``log_p0`` the logarithms of each chain's chance that all its words are
    clean. Long chains are cut in pieces of PIECE words that take their steps at once; what
    crosses a cut comes from the pieces' products, so the result is that of the whole chain.
    """
    weights = first, ct, tc, tt = np.exp(np.clip(moves, -30, 30))
    counts = -(-lengths // PIECE)
    cut = np.full(int(counts.sum()), PIECE, dtype=np.int64)
    lasts = np.cumsum(counts) - 1
    cut[lasts] = lengths - (counts - 1) * PIECE
    number = np.arange(len(cut)) - np.repeat(lasts + 1 - counts, counts)  # of a piece in its chain
    order, alive, begins, at = _placed(cut)
    rank = np.argsort(order)
    e = np.empty(len(at))
    e[at] = np.exp(np.clip(emit, -30, 30))
    enter, leave = np.full((len(cut), 2), 0.5), np.full((len(cut), 2), 0.5)  # shares of clean and toxic before a piece, after it
    if counts.max() > 1:
        across = _between(e, number[order] == 0, alive, begins, weights)[:, :, rank].transpose(2, 0, 1)
        for j in range(1, int(counts.max())):
            here = np.flatnonzero(number == j)
            v = np.einsum("ps,psn->pn", enter[here - 1], across[here - 1])
            enter[here] = v / v.sum(axis=1, keepdims=True)
        for j in range(int(counts.max()) - 1, 0, -1):
            here = np.flatnonzero(number == j)
            u = np.einsum("psn,pn->ps", across[here], leave[here])
            leave[here - 1] = u / u.sum(axis=1, keepdims=True)
    opens, a, b = number[order] == 0, enter[order, 1], leave[order, 1].copy()
    forward, norms, back = np.empty(len(at)), np.empty(len(at)), np.empty(len(at))
    for t in range(len(alive)):
        place = slice(begins[t], begins[t + 1])
        a = a[: alive[t]]
        norm = 1 - a + a * tc
        toxic = ((1 - a) * ct + a * tt) * e[place]
        if t == 0:
            norm, toxic = np.where(opens, 1.0, norm), np.where(opens, first * e[place], toxic)
        norm = norm + toxic
        a = toxic / norm
        forward[place], norms[place] = a, norm
    back[begins[-2] :] = b[: alive[-1]]  # share of the toxic state in what follows
    for t in range(len(alive) - 2, -1, -1):
        n = alive[t + 1]
        toxic = b[:n] * e[begins[t + 1] : begins[t + 2]]
        clean = 1 - b[:n]
        now, other = tc * clean + tt * toxic, clean + ct * toxic
        b[:n] = now / (now + other)
        back[begins[t] : begins[t + 1]] = b[: alive[t]]
    p = forward * back / (forward * back + (1 - forward) * (1 - back))
    return p[at], -np.add.reduceat(np.log(norms)[at], np.cumsum(lengths) - lengths), at, np.stack((forward, back, e))


def crf_marginals(emit: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(toxic) of each word of one text."""
    return chains(np.asarray(emit, dtype=np.float64), np.array([len(emit)]), np.asarray(moves, dtype=np.float64))[0] if len(emit) else np.zeros(0)


def _shifted(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each word has as its neighbour before and after; -1 at a text's ends."""
    before, after = np.roll(values, 1), np.roll(values, -1)
    ends = np.cumsum(lengths)
    before[ends - lengths], after[ends - 1] = -1, -1
    return before, after


def label_gradient(word: np.ndarray, head: np.ndarray, tail: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Log likelihood of the documents' labels and its gradient; no document is empty."""
    before, after = _shifted(word, lengths)
    has_before, has_after = before >= 0, after >= 0
    before, after = AT[3] + before % WIDTHS[3], AT[4] + after % WIDTHS[4]
    extra = theta[AT[-1] :]
    emit = theta[word] + theta[head] + theta[tail] + extra[0]
    emit[has_before] += theta[before[has_before]]
    emit[has_after] += theta[after[has_after]]
    p, log_p0, at, (forward, back, e) = chains(emit, lengths, extra[1:])
    p0 = np.exp(log_p0)
    right = np.where(toxic == 1, NOISE + (1 - 2 * NOISE) * (1 - p0), NOISE + (1 - 2 * NOISE) * p0)
    pull = np.where(toxic == 1, 1.0, -1.0) * (1 - 2 * NOISE) * p0 / right
    each = np.repeat(pull, lengths)
    g = p * each
    out = np.zeros(SIZE)
    for f, w in ((word, g), (head, g), (tail, g), (before[has_before], g[has_before]), (after[has_after], g[has_after])):
        out += np.bincount(f, weights=w, minlength=SIZE)
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(len(g), dtype=bool)
    inner[starts] = False
    later = np.flatnonzero(inner)
    a, toxic_next = forward[at[later - 1]], e[at[later]] * back[at[later]]
    clean_next = 1 - back[at[later]]
    _, ct, tc, tt = np.exp(np.clip(extra[1:], -30, 30))
    parts = np.stack(((1 - a) * clean_next, (1 - a) * ct * toxic_next, a * tc * clean_next, a * tt * toxic_next))
    out[AT[-1] :] = [g.sum(), g[starts].sum(), *((parts[1:] / parts.sum(axis=0)) @ each[later])]
    return float(np.log(right).sum()), out


def document_features(p: np.ndarray) -> list[float]:
    """Constant, largest marginal and the logarithm of one plus their sum."""
    return [1.0, float(p.max(initial=0.0)), float(np.log1p(p.sum()))]


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-1) -> np.ndarray:
    """Newton steps on the ridge logistic likelihood; the constant isn't held."""
    theta, held = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    held[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + held, x.T @ (y - p) - held @ theta)
        theta = theta + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return theta


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, seed: int) -> DataFrame:
    """``_id, _text, _toxic``: at most FIT_TOXIC toxic and FIT_CLEAN clean labelled documents that aren't held out, distinct texts."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    order = [F.xxhash64(F.lit(seed), "_id"), "_id"]
    picked = known.where("_toxic = 1").orderBy(*order).limit(FIT_TOXIC).union(known.where("_toxic = 0").orderBy(*order).limit(FIT_CLEAN))
    texts = docs.select(F.col(id_col).alias("_id"), plain_text(text_col).alias("_text")).join(F.broadcast(picked), "_id")  # at most FIT_TOXIC + FIT_CLEAN ids
    return texts.groupBy("_text").agg(F.min("_id").alias("_id"), F.max("_toxic").alias("_toxic"))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed features of every word of the sampled documents that have any."""
    known: dict[str, tuple[int, int, int]] = {}
    for b in batches:
        toxic, columns = [], ([], [], [])
        for text, label in zip(b.column("_text").to_pylist(), b.column("_toxic").to_pylist(), strict=True):
            words = WORD.findall(text)
            if len(known) > 500_000:
                known.clear()
            found = [known.get(w) or known.setdefault(w, word_features(w)) for w in words]
            if found:
                toxic.append(label)
                for column, values in zip(columns, np.array(found, dtype=np.int32).T, strict=True):
                    column.append(values)
        yield pa.RecordBatch.from_arrays([pa.array(toxic, type=pa.int32()), *(pa.array(c, type=pa.list_(pa.int32())) for c in columns)], names=["toxic", "word", "head", "tail"])


def _lists(b: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A batch's words, first and last letters laid end to end, the documents' lengths and labels."""
    lists = [b.column(name) for name in ("word", "head", "tail")]
    return [x.flatten().to_numpy().astype(np.int64) for x in lists], np.diff(lists[0].offsets.to_numpy()).astype(np.int64), b.column("toxic").to_numpy()


def toxic_support(featured: DataFrame) -> np.ndarray:
    """How many toxic documents each feature is found in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(SIZE, dtype=np.float32)
        for b in batches:
            if b.num_rows:
                (word, head, tail), lengths, toxic = _lists(b)
                of, (before, after) = np.repeat(np.arange(len(lengths)), lengths), _shifted(word, lengths)
                bad = toxic[of] == 1
                for f, on in ((word, bad), (head, bad), (tail, bad), (AT[3] + before % WIDTHS[3], bad & (before >= 0)), (AT[4] + after % WIDTHS[4], bad & (after >= 0))):
                    out += np.bincount(np.unique(of[on] * SIZE + f[on]) % SIZE, minlength=SIZE).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["support"])

    return np.sum([np.frombuffer(x["support"], dtype=np.float32) for x in featured.mapInArrow(run, "support binary").collect()], axis=0)


def fit_crf(featured: DataFrame, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> np.ndarray:
    """Weights that maximise the labels' likelihood less a ridge (Adam); each step is one job over the written features.

    Executors add up their documents' gradients, so what reaches the driver is one vector a
    partition, whatever the texts' lengths. A feature of few toxic documents may speak against
    toxicity but not for it, so words that one document alone holds are not learned by heart.
    """
    theta, first, second = np.zeros(SIZE), np.zeros(SIZE), np.zeros(SIZE)
    theta[AT[-1]] = -6.0
    held = np.full(SIZE, ridge)
    held[AT[3] : AT[-1]] *= NEIGHBOURS
    held[AT[-1] :] = 0.0
    asked = np.full(SIZE, SUPPORT)
    asked[AT[1] : AT[3]] = LETTERS
    most = np.where(toxic_support(featured) >= asked, np.inf, 0.0)
    most[AT[-1] :] = np.inf
    for r in range(1, steps + 1):

        def step(batches: Iterator[pa.RecordBatch], sent: np.ndarray = theta.astype(np.float32)) -> Iterator[pa.RecordBatch]:
            out, theta = np.zeros(SIZE), sent.astype(np.float64)
            for b in batches:
                if b.num_rows:
                    features, lengths, toxic = _lists(b)
                    out += label_gradient(*features, lengths, toxic, theta)[1]
            yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float32).tobytes()])], names=["gradient"])

        parts = featured.mapInArrow(step, "gradient binary").collect()
        gradient = np.sum([np.frombuffer(x["gradient"], dtype=np.float32) for x in parts], axis=0, dtype=np.float64) - held * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta = np.minimum(theta + rate * (1 - (r - 1) / steps) * (first / (1 - 0.9**r)) / (np.sqrt(second / (1 - 0.999**r)) + 1e-6), most)
    return theta.astype(np.float32)


def fit_tagger(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 42) -> Tagger:
    """Learns the tagger from labelled rows that aren't held out.

    The CRF is fitted on all words of at most FIT_TOXIC toxic and FIT_CLEAN clean documents, then
    the logistic weights on their marginals. Texts, features and gradients stay on executors.
    Without labels of both classes the tagger scores every text alike.
    """
    sample = written(training_sample(docs, labels, id_col, text_col, label_col, seed).repartition(PARTS, F.xxhash64("_text")), "sample")
    totals = {r["_toxic"]: r["n"] for r in sample.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Tagger(np.zeros(SIZE, dtype=np.float32), np.array([np.log((toxic + 0.5) / (clean + 0.5)) if toxic + clean else -1.0, 0.0, 0.0]), known=False)
    featured = written(sample.select("_text", "_toxic").mapInArrow(_featured, "toxic int, word array<int>, head array<int>, tail array<int>"), "featured")
    tagger = Tagger(fit_crf(featured), np.zeros(3))
    measured = sample.select("_toxic", _measured(tagger, F.col("_text"))["features"].alias("x")).collect()  # FIT_TOXIC + FIT_CLEAN rows at most
    order = sorted((tuple(r["x"]), r["_toxic"]) for r in measured)
    x, y = (np.array(c, dtype=np.float64) for c in zip(*order, strict=True))
    return Tagger(tagger.theta, fit_logistic(x, y))


#: Words of texts that are tagged together.
_TOGETHER = 1_000_000
_SPANS = "array<struct<start:int,end:int,probability:double>>"


def tagged(texts: list[str], tagger: Tagger, words: _Words) -> Iterator[tuple[list[float], list[tuple[int, int, float]]]]:
    """Document features and the spans of words with a marginal of 0.5 or more, for each text."""
    held: list[tuple[str, np.ndarray]] = []

    def flush() -> Iterator[tuple[list[float], list[tuple[int, int, float]]]]:
        full = [(t, n) for t, n in held if len(n)]
        marginals: list[np.ndarray] = []
        if full:
            numbers, lengths = np.concatenate([n for _, n in full]), np.array([len(n) for _, n in full])
            before, after = _shifted(numbers, lengths)
            extra = words.theta[AT[-1] :]
            emit = words.own[numbers] + np.where(before >= 0, words.before[before], 0.0) + np.where(after >= 0, words.after[after], 0.0) + extra[0]
            marginals = np.split(chains(emit, lengths, extra[1:])[0], np.cumsum(lengths)[:-1])
        each = iter(marginals)
        for text, n in held:
            p = next(each) if len(n) else np.zeros(0)
            hits = set(np.flatnonzero(p >= 0.5).tolist())
            yield document_features(p), [(m.start(), m.end(), float(p[i])) for i, m in enumerate(WORD.finditer(text)) if i in hits] if hits else []
        held.clear()

    size = 0
    for text in texts:
        found = WORD.findall(text)
        if len(words) + len(found) > len(words.own):
            yield from flush()
            size = 0
            words.clear()
            if len(found) > len(words.own):
                words.own, words.before, words.after = (np.zeros(len(found)) for _ in range(3))
        held.append((text, np.fromiter(map(words.__getitem__, found), dtype=np.int64, count=len(found))))
        size += len(found)
        if size >= _TOGETHER:
            yield from flush()
            size = 0
    yield from flush()


def _measured(tagger: Tagger, text: Column) -> Column:
    """``features, spans`` of each text as a struct column; only the text goes to Python."""

    @F.pandas_udf(f"features array<double>, spans {_SPANS}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = _Words(tagger.theta)
        for texts in batches:
            yield pd.DataFrame(list(tagged(texts.tolist(), tagger, words)), columns=["features", "spans"])

    return run(text)


def toxicity_of(tagger: Tagger, text: Column) -> Column:
    """``score, spans`` of each text as a struct column."""
    weights = [float(w) for w in tagger.logistic]
    if not tagger.known:
        return F.struct(F.lit(float(1 / (1 + np.exp(-weights[0])))).alias("score"), F.array().cast(_SPANS).alias("spans"))

    @F.pandas_udf(f"score double, spans {_SPANS}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = _Words(tagger.theta)
        for texts in batches:
            rows = list(tagged(texts.tolist(), tagger, words))
            z = np.clip(np.array([r[0] for r in rows]).reshape(-1, 3) @ np.array(weights), -30, 30)
            yield pd.DataFrame({"score": 1 / (1 + np.exp(-z)), "spans": [r[1] for r in rows]})

    return run(text)


def score_toxicity(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, held_out, score, predicted, spans``.

    ``score`` (0 to 1) comes from the marginals of the whole text and ``predicted`` is 1 from
    0.5 on; ``spans`` are ``start, end, probability`` in characters of the words whose marginal
    is 0.5 or more. A null text is empty; empty texts get the
    score of no evidence. Repeated rows are scored each; an empty table gives no rows. Only
    text enters a score. Nothing is shuffled.
    """
    scored = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), toxicity_of(tagger, plain_text(text_col)).alias("_found"))
    return scored.select(id_col, "held_out", "_found.score", (F.col("_found.score") >= 0.5).cast("int").alias("predicted"), "_found.spans")


def drop_toxic(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, whose score is below 0.5; the cases are those of :func:`score_toxicity`."""
    return docs.where(toxicity_of(tagger, plain_text(text_col))["score"] < 0.5)
