"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are fixed lexicons and patterns, and lexicons mined from labelled rows: stems and words (as
hashed slots) whose share among toxic rows is certainly above that among others, dealt to a
fixed number of voters. The votes on all documents are counted by pattern of votes (2^16 at
most); the label model, a two-class mixture, takes from these counts the accuracy of each voter and,
from what pairs of voters do together beyond that, their correlations, by which correlated voters
share their weight. Its posteriors on a bounded sample of labelled rows (whose labels say which class is
the toxic one, how frequent it is, and are one more vote, as right as the others find them) are the
labels of a logistic classifier over the mined slots and the voters, which scores every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.shared import Memo, slices, utf8, written

SLOTS, CHUNKS = 1 << 22, 64
SAMPLE = 30_000  # labelled rows that are learnt from, at most
LIFT = 20  # how many times as frequent among toxic rows a slot is at least
MINED = 4000  # slots that are kept, at most
MINED_VOTERS = 9

#: Lexicon voters: words that insult in any text.
LEXICONS = (
    "idiot idiots moron morons stupid dumb imbecile fool dimwit",
    "loser losers scum trash worthless pathetic garbage vermin",
    "disgusting clown filth filthy pig creep freak",
    "fuck fucking shit bitch bastard asshole cunt dick",
)
#: Pattern voters, over texts in lower case: an insulting address, a phrase, shouting.
ADDRESS = re.compile(rb"\byou(?:'re| are| r)\s+(?:a|an|such|so|just)\b")
PHRASES = (b"shut up", b"go to hell", b"drop dead", b"kill yourself", b"hate you")
SHOUTS = (b"!!!!", b"????", b"?!?!", b"!?!?")
PATTERNS = (lambda t: b"you" in t and bool(ADDRESS.search(t)), lambda t: any(p in t for p in PHRASES), lambda t: any(p in t for p in SHOUTS))
VOTERS = len(LEXICONS) + len(PATTERNS) + MINED_VOTERS

_LEXICON = {w.encode(): i for i, words in enumerate(LEXICONS) for w in words.split()}
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")  # letters, and bytes above ASCII


def names(word: bytes) -> list[str]:
    """The features of a word: its stems of four, five and six characters, and itself after an equals sign."""
    text = word.decode("utf-8", "replace")
    return [text[:n] for n in (4, 5, 6) if len(text) >= n] + ["=" + text]


def slot(name: str) -> int:
    """The slot that a feature is counted in."""
    return xxhash.xxh3_64_intdigest(name.encode()) & (SLOTS - 1)


def words(text: bytes | None) -> set[bytes]:
    """The distinct words of a text in lower case."""
    return set(_WORD.findall((text or b"").lower()))


def in_training(doc_id) -> object:
    """Whether labels of a row may be learnt from: crc32 of doc_id as text isn't divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


_slots = Memo(lambda w: tuple({slot(n) for n in names(w)}), 200_000)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows = np.zeros((2, SLOTS), np.uint16), [0, 0]
    for batch in slices(batches, 1000):
        for toxic, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            found = {s for w in words(text) for s in _slots[w]}
            at = np.fromiter(found, np.int64, len(found))
            counts[toxic][at] += counts[toxic][at] < 65535
            rows[toxic] += 1
    if sum(rows):
        parts = counts.reshape(2, CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([zlib.compress(parts[:, i].tobytes(), 1) for i in range(CHUNKS)], pa.binary()), pa.array([rows[0]] * CHUNKS, pa.int64()), pa.array([rows[1]] * CHUNKS, pa.int64())], names=["chunk", "counts", "n0", "n1"])


def _certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of a chunk whose log-odds are above log LIFT, and above a quarter of it by two standard errors."""
    total: dict[int, np.ndarray] = {}
    n: dict[int, list[int]] = {}
    for batch in batches:
        for chunk, part, n0, n1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total.setdefault(chunk, np.zeros((2, SLOTS // CHUNKS), np.int64))[:] += np.frombuffer(zlib.decompress(part), np.uint16).reshape(2, -1)
            have = n.setdefault(chunk, [0, 0])
            have[0], have[1] = have[0] + n0, have[1] + n1
    for chunk, (neg, pos) in total.items():
        n0, n1 = n[chunk]
        odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
        low = odds - 2 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
        best = np.flatnonzero((pos >= 3) & (low > math.log(LIFT / 4)) & (odds > math.log(LIFT)))
        best = best[np.argsort(-(low * pos)[best], kind="stable")][:MINED]
        yield pa.RecordBatch.from_arrays([pa.array(best + chunk * (SLOTS // CHUNKS), pa.int64()), pa.array((low * pos)[best]), pa.array(pos[best]), pa.array([n1] * len(best), pa.int64()), pa.array([n0] * len(best), pa.int64())], names=["slot", "gain", "pos", "n1", "n0"])


def _named(batches: Iterator[pa.RecordBatch], number: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """The features whose slots are mined."""
    found: set[str] = set()
    for batch in batches:
        for text in utf8(batch.column(0)):
            found.update(n for w in words(text) for n in names(w) if slot(n) in number)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found))], names=["name"])


@dataclass
class Votes:
    """What a text is voted on by: each mined feature has the number of its slot, and that is dealt to a voter."""

    number: dict[str, int]
    n: int

    def __post_init__(self) -> None:
        self.of_token = Memo(self._of_token, 300_000)

    def __reduce__(self):
        return Votes, (self.number, self.n)

    def _of_token(self, token: bytes) -> tuple[tuple[int, ...], int]:
        found, votes = set(), 0
        for word in _WORD.findall(token):
            if word in _LEXICON:
                votes |= 1 << _LEXICON[word]
            text = word.decode("utf-8", "replace")
            for name in (text[:4], text[:5], text[:6], "=" + text):
                if name in self.number:
                    found.add(self.number[name])
        for f in found:
            votes |= 1 << (len(LEXICONS) + len(PATTERNS) + f % MINED_VOTERS)
        return tuple(found), votes

    def __call__(self, text: bytes | None) -> tuple[set[int], int]:
        """The numbers of the mined slots in a text, and the bits of the voters that vote toxic."""
        found, votes, text = set(), 0, (text or b"").lower()
        for numbers, voted in set(map(self.of_token.__getitem__, text.split())):
            if voted:
                votes |= voted
                found.update(numbers)
        for i, pattern in enumerate(PATTERNS):
            if pattern(text):
                votes |= 1 << (len(LEXICONS) + i)
        return found, votes


@dataclass
class LabelModel:
    """Shares of the voters' votes in the two classes, their weights, and the frequency of the toxic class."""

    rates: np.ndarray
    weights: np.ndarray
    prior: float

    def posterior(self, patterns: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """The probability of toxic for rows of votes (0 or 1), and of labels where they are given: a label is one more vote, right as often as votes agree with it."""
        if labels is not None and len(labels):
            p = self.posterior(patterns)
            right = np.array([np.clip((w @ labels + 1) / (w.sum() + 2), 0.01, 0.99) for w in (1 - p, p)])
            told = np.where(labels > 0, np.log(right[1]) - np.log(right[0]), np.log1p(-right[1]) - np.log1p(-right[0]))
            z = np.log(np.clip(p, 1e-12, 1)) - np.log(np.clip(1 - p, 1e-12, 1)) + told
            return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        r = self.rates
        on, off = np.log(r[1]) - np.log(r[0]), np.log1p(-r[1]) - np.log1p(-r[0])
        z = math.log(self.prior / (1 - self.prior)) + (patterns * on + (1 - patterns) * off) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def bits(patterns: np.ndarray) -> np.ndarray:
    """Votes as rows of 0 and 1."""
    return (patterns[:, None] >> np.arange(VOTERS)) & 1


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, labelled: tuple[np.ndarray, np.ndarray], rounds: int = 40) -> LabelModel:
    """Expectation and maximisation over counted patterns of votes.

    ``labelled`` has the votes and labels of the sample: they start the model, and keep taking part as rows
    of a known class, so that the classes keep their meaning.
    """
    known, y = bits(labelled[0]), labelled[1]
    prior = float(np.clip(y.mean() if len(y) else 0.1, 0.01, 0.5))
    rate = lambda x, w: np.clip((w @ x + 0.1) / (w.sum() + 1.0), 1e-4, 0.995)
    model = LabelModel(np.stack([rate(known, 1.0 - y), rate(known, 1.0 * y)]), np.ones(VOTERS), prior)
    x = bits(patterns)
    for _ in range(rounds):
        p = model.posterior(x)
        toxic, other = counts * p, counts * (1 - p)
        rates = np.stack([(other @ x + (1.0 - y) @ known + 0.1) / (other.sum() + (1.0 - y).sum() + 1), (toxic @ x + (1.0 * y) @ known + 0.1) / (toxic.sum() + y.sum() + 1)])
        rates = np.clip(rates, 1e-4, 0.995)
        # what voters do together within a class, beyond their rates: the mean correlation over both classes
        correlation = np.zeros((VOTERS, VOTERS))
        for c, w in ((0, other), (1, toxic)):
            d = (x - rates[c]) / np.sqrt(rates[c] * (1 - rates[c]))
            correlation += 0.5 * (d * w[:, None]).T @ d / max(w.sum(), 1)
        np.fill_diagonal(correlation, 0)
        weights = 1 / (1 + np.clip(correlation, 0, 1).sum(0))
        moved = float(np.abs(rates - model.rates).max())
        model = LabelModel(rates, weights, prior)
        if moved < 1e-6:
            break
    return model


def fit_linear(found: list[list[int]], target: np.ndarray, n: int, rounds: int = 300, rate: float = 0.5, l2: float = 1e-4) -> np.ndarray:
    """Weights of a logistic classifier over sets of feature numbers (the last weight is the bias), for soft labels."""
    lengths = np.array([len(f) for f in found], np.int64)
    row, col = np.repeat(np.arange(len(found)), lengths), np.fromiter((c for f in found for c in f), np.int64, int(lengths.sum()))
    w, seen = np.zeros(n + 1), np.full(n + 1, 1e-8)
    w[n] = math.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    for _ in range(rounds):
        z = np.bincount(row, w[col], len(found)) + w[n]
        g = (target - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) / max(1, len(found))
        grad = np.append(np.bincount(col, g[row], n), g.sum()) - l2 / 10 * np.append(w[:n], 0)
        seen += grad * grad
        w += rate * grad / np.sqrt(seen)
    return w


@dataclass
class Classifier:
    """A fitted classifier: its votes, and weights of mined slots, then voters, then the bias."""

    votes: Votes
    weights: np.ndarray

    def score(self, text: bytes | None) -> float:
        """Between 0 and 1, higher for toxic; empty texts get the score of a text without any feature."""
        found, voted = self.votes(text)
        n = self.votes.n
        z = self.weights[-1] + sum(self.weights[f] for f in found) + sum(self.weights[n + v] for v in range(VOTERS) if voted >> v & 1)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _patterns(batches: Iterator[pa.RecordBatch], votes: Votes) -> Iterator[pa.RecordBatch]:
    total: dict[int, int] = {}
    for batch in slices(batches, 1000):
        for text in utf8(batch.column(0)):
            p = votes(text)[1]
            total[p] = total.get(p, 0) + 1
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["pattern", "n"])


def _sample_votes(batches: Iterator[pa.RecordBatch], votes: Votes) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1000):
        rows = [votes(t) for t in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for _, p in rows], pa.int64()), pa.array([sorted(f) for f, _ in rows], pa.list_(pa.int32()))], names=["toxic", "pattern", "found"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """A classifier that is learnt from at most ``sample`` labelled rows of the training folds, and the votes on all documents.

    Rows with a null doc_id or label are not learnt from; labels other than 0 and 1 count as 1.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    chosen = labels.select(F.col("doc_id").cast("long"), (F.col("toxic") != 0).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(in_training(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = written(texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "labelled")  # at most ``sample`` ids are broadcast
    mined = rows.mapInArrow(_counts, "chunk int, counts binary, n0 long, n1 long").repartition(CHUNKS, "chunk").mapInArrow(_certain, "slot long, gain double, pos long, n1 long, n0 long")
    best = [r["slot"] for r in mined.orderBy(F.desc("gain"), "slot").limit(MINED).collect()]
    number = {s: i for i, s in enumerate(best)}
    named = rows.where("toxic = 1").select("text").mapInArrow(lambda it: _named(it, number), "name string").distinct().collect()  # features of the sample's toxic rows
    votes = spark.sparkContext.broadcast(Votes({r["name"]: number[slot(r["name"])] for r in named}, len(best)))
    counted = texts.select("text").mapInArrow(lambda it: _patterns(it, votes.value), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # at most 2^16 rows
    known = rows.mapInArrow(lambda it: _sample_votes(it, votes.value), "toxic int, pattern long, found array<int>").collect()
    y, patterns = np.array([r["toxic"] for r in known], float), np.array([r["pattern"] for r in known], np.int64)
    model = fit_label_model(np.array([r["pattern"] for r in counted], np.int64), np.array([r["n"] for r in counted], float), (patterns, y))
    if not len(known):
        return Classifier(votes.value, np.append(np.zeros(len(best) + VOTERS), math.log(0.1 / 0.9)))
    on = bits(patterns)
    found = [[*r["found"], *(len(best) + np.flatnonzero(on[i])).tolist()] for i, r in enumerate(known)]
    return Classifier(votes.value, fit_linear(found, model.posterior(on, y), len(best) + VOTERS))


def _score(batches: Iterator[pa.RecordBatch], classifier: Classifier, at: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1000):
        scores = np.fromiter((classifier.score(t) for t in utf8(batch.column(at))), float, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*(f.name for f in batch.schema), "score"])


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 where the score is 0.5 or more).

    Null and empty texts are scored like texts without a toxic feature; repeated rows are scored each; a null
    doc_id stays null and is not held out; an empty table gives an empty result, and without labels the lexicons and
    patterns alone have no weight. Other columns than doc_id and text are not read.
    """
    classifier = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: (b.select(["doc_id", "score"]) for b in _score(it, classifier.value, 1)), "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents, with all their columns, that score below 0.5."""
    classifier, columns = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample)), docs.columns
    at = columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _score(batches, classifier.value, at):
            kept = batch.filter(pa.array(batch.column(batch.num_columns - 1).to_numpy() < 0.5))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=columns)

    return docs.mapInArrow(keep, docs.schema)
