"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nystrom landmarks.

The kernel compares two short character strings by their common subsequences of
three and four characters that span at most SPAN places; each occurrence weighs DECAY to
the power of its span (Lodhi et al. 2002, with a bounded span). Letters that are
put into an insult, or left out of it, thus change its features only in part.
Nystrom features (kernel values against landmark strings, whitened by the
landmarks' own kernel matrix) make the machine linear; as the landmarks' own
subsequences are known, landmarks and weights then fold into one table with a
weight for each subsequence, so scoring a string costs a few look-ups for each
character, however many landmarks there are.

Training is by sentences of labelled documents, string by string: all strings of a
sentence from a document that isn't toxic are negative; in a toxic document at
least one string of one sentence is positive, and which one is settled in turns
with the machine. A string is a word (or letters set apart, joined again), so an
insult of several words, each of which clean documents hold too, isn't learned.
A document's score is the largest decision value over the strings of its whole
text, by a logistic fit whose even odds are moved further into the gap between
toxic and clean documents where there is one; it ranks as a probability does,
but is no calibrated one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fill, mix64, raw_bytes, segment_hashes, stream64

#: Characters fall into this many classes: a-z one each, the word's edge, and other letters by code point.
CLASSES = 64
SPAN, DECAY = 5, 0.7
#: The places of a subsequence's later characters after its first, and its weight.
PATTERNS = [(p, DECAY ** (p[-1] + 1)) for n in (2, 3) for p in combinations(range(1, SPAN), n)]
#: Subsequences of three characters are numbered; those of four share so many numbers by a hash.
THREES, FOURS = CLASSES**3, 1 << 20
#: Longer strings are scored in windows of so many characters, moved on by STEP.
WIDEST, STEP = 14, 4
#: Rows of the labelled table used for training, at most, of each label.
TRAIN_TOXIC, TRAIN_CLEAN = 2500, 5000
LANDMARKS = 1000
TURNS = 3
RIDGE = 5e-5
#: The part of the positive side's weight that strings with letters put in have.
PUT_IN = 0.5
#: Strings that train a machine, at most: insults, those of them that get letters put in, and strings of clean documents.
MOST_INSULTS, MOST_VARIED, HARD = 1000, 80, 4000
#: A string that only toxic documents hold is an insult where chance would do that less often than this.
CHANCE = 1e-6

#: Digits and signs that stand for letters inside a word (fixed values).
LOOKALIKES = str.maketrans("013457@$", "oieastas")
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE_ENDS = re.compile(r"[.!?\n]+(?:\s+|$)")
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][\W_]{1,2}){3,}[^\W\d_](?![^\W\d_])")


def normal(token: str) -> str:
    """The letters of a lower-cased token, with lookalikes read as letters where letters are around."""
    if token.isalpha():
        return token
    found = "".join(LETTERS.findall(token))
    if len(found) >= 3 and len(found) < len(token):
        core = token.strip("!?.,;:\"'()[]{}*#%&+-=/\\|<>~_`^")
        found = "".join(LETTERS.findall(core.translate(LOOKALIKES)))
    return found


def strings(text: str) -> set[str]:
    """The distinct strings of a text that are scored: its words, and letters set apart joined again."""
    lower = text.lower()
    tokens = set(lower.split())
    if SPACED.search(lower):
        tokens.update("".join(LETTERS.findall(m[0])) for m in SPACED.finditer(lower))
    return tokens


def windows(word: str) -> list[str]:
    """The word with its edges marked, or its windows where it is long."""
    whole = f"\x01{word}\x01"
    if len(whole) <= WIDEST:
        return [whole]
    starts = [*range(0, len(whole) - WIDEST, STEP), len(whole) - WIDEST]
    return [whole[i : i + WIDEST] for i in starts]


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((code >= 97) & (code <= 122), code - 96, np.where(code == 1, 63, np.where(code == 0, 0, 27 + code % 36)))


def occurrences(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all subsequences in all strings: the string's index, the subsequence's number and its weight.

    Weights are scaled by the string's length, so that a string of distinct
    subsequences has a kernel value of 1 with itself.
    """
    lengths = np.array([len(p) for p in parts], np.int64)
    pad = "\0" * SPAN
    code = classes(pad.join(parts) + pad)
    owner = np.repeat(np.arange(len(parts)), lengths + SPAN)
    room = np.zeros(len(parts))
    for places, w in PATTERNS:
        room += np.maximum(0, lengths - places[-1]) * w * w
    scale = 1 / np.sqrt(np.maximum(room, 1e-9))
    who, what, weight = [], [], []
    n = len(code) - SPAN
    for places, w in PATTERNS:
        number, real = code[:n], code[:n] > 0
        for p in places:
            later = code[p : p + n]
            number, real = number * CLASSES + later, real & (later > 0)
        at = np.flatnonzero(real)
        number = number[at]
        if len(places) == 3:
            number = THREES + ((number * 0x9E3779B1) >> 12) % FOURS
        who.append(owner[at])
        what.append(number)
        weight.append(w * scale[owner[at]])
    return np.concatenate(who), np.concatenate(what), np.concatenate(weight)


@dataclass
class Model:
    """weights: one for each subsequence; slope and offset make a decision value a log-odds."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def decide(self, words: list[str]) -> np.ndarray:
        """The decision value of each word; -1 is that of a word without subsequences."""
        out = np.full(len(words), -1.0)
        for start in range(0, len(words), 20_000):
            block = words[start : start + 20_000]
            cut = [windows(w) for w in block]
            parts = [p for c in cut for p in c]
            if not parts:
                continue
            who, what, weight = occurrences(parts)
            value = np.bincount(who, self.weights[what] * weight, len(parts)) + self.bias
            first = np.cumsum([0, *(len(c) for c in cut[:-1])])
            out[start : start + len(block)] = np.maximum.reduceat(value, first)
        return out

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.offset, -40, 40)))


def _kernel(parts: list[str], landmark_table: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Kernel values of strings against landmarks; landmark_table: (subsequence of any landmark, landmark)."""
    out = np.zeros((len(parts), landmark_table.shape[1]))
    for start in range(0, len(parts), 200):
        block = parts[start : start + 200]
        who, what, weight = occurrences(block)
        known = column[what] >= 0
        who, at, weight = who[known], column[what[known]], weight[known]
        order = np.argsort(who, kind="stable")
        rows, first = np.unique(who[order], return_index=True)
        if len(rows):
            out[start + rows] = np.add.reduceat(landmark_table[at[order]] * weight[order, None], first)
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton's method on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    eye = np.eye(x.shape[1]) * ridge * weight.sum()
    eye[-1, -1] *= 1e-3
    inside = np.ones(len(x), bool)
    for _ in range(30):
        a = x[inside] * weight[inside, None]
        w = np.linalg.solve(a.T @ x[inside] + eye, a.T @ y[inside])
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], w[-1]


def _fit_machine(plain: list[str], put_in: list[str], negative: list[str], landmarks: list[str]) -> tuple[np.ndarray, float]:
    """The weight of each subsequence, and the bias."""
    who, what, weight = occurrences(landmarks)
    used, inverse = np.unique(what, return_inverse=True)
    column = np.full(THREES + FOURS, -1)
    column[used] = np.arange(len(used))
    table = np.zeros((len(used), len(landmarks)))
    np.add.at(table, (inverse, who), weight)
    # with K + jitter = L L', features k L'^-1 have the inner products of Nystrom's approximation
    lower = np.linalg.cholesky(table.T @ table + 1e-4 * np.eye(len(landmarks)))
    whiten = np.linalg.inv(lower).T
    x = _kernel([*plain, *put_in, *negative], table, column) @ whiten
    sides = [(plain, 1.0, 0.5 * (1 - PUT_IN if put_in else 1)), (put_in, 1.0, 0.5 * PUT_IN), (negative, -1.0, 0.5)]
    y = np.concatenate([np.full(len(side), label) for side, label, _ in sides])
    balance = np.concatenate([np.full(len(side), part / max(1, len(side))) for side, _, part in sides]) * len(y)
    w, bias = _svm(x, y, balance)
    out = np.zeros(THREES + FOURS, np.float32)
    out[used] = table @ (whiten @ w)
    return out, float(bias)


def _logistic(decision: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Platt's fit of log-odds = slope * decision + offset, with his targets, which never reach 0 or 1."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    goal = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(toxic, 0.5 / n1, 0.5 / n0)
    x = np.stack([decision, np.ones_like(decision)], 1)
    w = np.array([4.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (weight * (p - goal)) + np.array([1e-5 * w[0], 0])
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag([1e-5, 1e-9])
        move = np.linalg.solve(hess, grad)
        w = w - move * min(1.0, 2 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def train(documents: list[tuple[str, bool]]) -> Model | None:
    """A model from (text, toxic) documents; None where either label is missing."""
    return fit([({w for s in _sentences(text) for w in s}, toxic) for text, toxic in documents])


def _sentences(text: str) -> list[set[str]]:
    """The normal strings of each sentence. Letters that are set apart by stops are joined over the whole text."""
    cut = [{normal(t) for t in strings(s)} for s in SENTENCE_ENDS.split(text)]
    return [*cut, {normal(m[0].lower()) for m in SPACED.finditer(text)}]


def _coded(documents: Iterable[tuple[Iterable[str], bool]]) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """The strings of all documents in their order, and each toxic and clean document as places in it.

    Strings of one letter are left out, documents without any too.
    """
    places: dict[str, int] = {}
    sides: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for words, toxic in documents:
        own = np.array(sorted({places.setdefault(w, len(places)) for w in words if len(w) > 1}), np.int32)
        if len(own):
            sides[0 if toxic else 1].append(own)
    words = sorted(places)
    moved = np.empty(len(words), np.int32)
    moved[np.array([places[w] for w in words], np.int64)] = np.arange(len(words))
    del places
    # documents come in any order
    one, two = (sorted((np.sort(moved[d]) for d in side), key=lambda d: (len(d), d.tobytes())) for side in sides)
    return words, one, two


def _without_copies(documents: list[np.ndarray], words: list[str]) -> list[np.ndarray]:
    """The documents that don't share half of eight MinHash values with an earlier one."""
    salts = stream64(8, 3)
    data, offsets = raw_bytes(pa.array(words, pa.string()))
    hashes = segment_hashes(data, offsets[:-1], offsets[1:])
    seen: dict[tuple[int, int], list[int]] = {}
    kept = []
    for own in documents:
        low = mix64(hashes[own][:, None] ^ salts).min(axis=0).tolist()
        met = Counter(k for i, h in enumerate(low) for k in seen.get((i, h), ()))
        if met and max(met.values()) >= 4:
            continue
        for i, h in enumerate(low):
            seen.setdefault((i, h), []).append(len(kept))
        kept.append(own)
    return kept


def _variants(word: str, rng: np.random.Generator) -> list[str]:
    """A word with a letter put in, or doubled, at each inner place."""
    extra = [chr(97 + c) for c in rng.integers(0, 26, len(word))]
    return [word[:i] + c + word[i:] for i in range(1, len(word)) for c in (extra[i], word[i])]


def fit(documents: Iterable[tuple[Iterable[str], bool]]) -> Model | None:
    """A model from the strings of documents and whether each is toxic; None where either kind is missing."""
    words, toxic, clean = _coded(documents)
    if not toxic or not clean:
        return None
    toxic, clean = _without_copies(toxic, words), _without_copies(clean, words)
    seen, bad = (np.bincount(np.concatenate(side), minlength=len(words)) for side in (clean, toxic))
    # strings that chance wouldn't keep out of the clean documents are insults; where a toxic document
    # has none, the string that tells it most from clean ones is taken as one
    share = len(toxic) / (len(toxic) + len(clean))
    is_sure = (bad > 0) & (seen == 0) & (share**bad < CHANCE)
    sure = [words[i] for i in sorted(np.flatnonzero(is_sure).tolist(), key=lambda i: (-bad[i], i))]
    odds = (bad / len(toxic)) / ((seen + 0.5) / len(clean))
    unsure = [d for d in toxic if not is_sure[d].any()]
    chosen = [int(d[odds[d].argmax()]) for d in unsure]
    everything = [words[i] for i in np.flatnonzero(seen).tolist()]
    known = set(everything)
    rng = np.random.default_rng(0)
    hard = [everything[i] for i in rng.permutation(len(everything))[: HARD // 2]]
    model = None
    for turn in range(TURNS):
        found = [i for i, _ in Counter(chosen).most_common()]
        found = [i for i in found if not seen[i]] or found
        insults = [*sure, *(words[i] for i in found if not is_sure[i])][:MOST_INSULTS]
        plain = list(dict.fromkeys(p for w in insults for p in windows(w)))
        if model is not None:  # windows of long words that don't hold the insult aren't positive
            cut = [windows(w) for w in insults]
            value = iter(_scores(model, [p for c in cut for p in c]).tolist())
            plain = list(dict.fromkeys(max([(next(value), p) for p in c])[1] for c in cut))
        short = [w for w in insults[:MOST_VARIED] if len(w) + 3 <= WIDEST]
        put_in = [p for w in short for v in _variants(w, rng) if v not in known for p in windows(v)]
        put_in = [p for p in dict.fromkeys(put_in) if p not in set(plain)]
        taken = {*plain, *put_in}
        negative = [p for p in dict.fromkeys(p for w in hard for p in windows(w)) if p not in taken]
        extra = put_in[:: max(1, len(put_in) * 5 // LANDMARKS)]
        landmarks = [*plain[: 2 * LANDMARKS // 5], *extra[: LANDMARKS // 5], *negative[: 2 * LANDMARKS // 5]]
        weights, bias = _fit_machine(plain, put_in, negative, landmarks)
        model = Model(weights, bias, 1.0, 0.0)
        value = model.decide(everything)
        worst = [everything[i] for i in np.argsort(-value, kind="stable")[: HARD // 2]]
        hard = list(dict.fromkeys([*worst, *hard]))[:HARD]
        if turn + 1 < TURNS and unsure:
            decided = np.minimum(model.decide(words), 1.0)
            decided[seen > 0] = -2
            chosen = [int(d[np.lexsort((-odds[d], -decided[d]))[0]]) for d in unsure]
    table = model.decide(words)
    top = np.array([table[d].max() for d in [*toxic, *clean]])
    model.slope, model.offset = _logistic(top, np.arange(len(top)) < len(toxic))
    # where the documents part cleanly, even odds are put further into the gap than the fit does
    low, high = np.quantile(top[: len(toxic)], 0.01), np.quantile(top[len(toxic) :], 0.999)
    if high < low:
        model.offset = -model.slope * max(-model.offset / model.slope, 0.6 * high + 0.4 * low)
    return model


def _scores(model: Model, parts: list[str]) -> np.ndarray:
    who, what, weight = occurrences(parts)
    return np.bincount(who, model.weights[what] * weight, len(parts)) + model.bias


#: Strings whose decision values a task keeps from one slice of documents to the next, at most.
REMEMBERED = 400_000


def decide_texts(model: Model, texts: list[str], known: dict[str, float] | None = None) -> np.ndarray:
    """The largest decision value over the strings of each text; each distinct string is scored once.

    known holds the values of strings seen before, and gets those of the others.
    """
    known = {} if known is None else known
    if len(known) > REMEMBERED:
        known.clear()
    raw = [strings(t) for t in texts]
    fresh = [w for w in set().union(*raw) if w not in known] if raw else []
    if fresh:
        known.update(zip(fresh, model.decide([normal(w) for w in fresh]).tolist(), strict=True))
    return np.array([max(map(known.__getitem__, d), default=-1.0) for d in raw])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = TRAIN_TOXIC, most_clean: int = TRAIN_CLEAN) -> Model | None:
    """A model from docs with a label of 0 or 1 in labels, by id.

    Of each label at most most_toxic and most_clean rows train the model, chosen
    by a hash of the id; null labels and ids without a document are passed over;
    an id with both labels is toxic. Of what these rows hold, at most MOST_INSULTS
    strings are positive, MOST_VARIED of them with letters put in, and HARD negative in a turn.
    Where a label has no row, there is no model.
    """
    named = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null")
    pick = [
        named.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(most)
        for value, most in ((1, most_toxic), (0, most_clean))
    ]
    # an id that is labelled both ways is toxic
    chosen = pick[0].unionByName(pick[1]).groupBy("_id").agg(F.max("_label").alias("_label"))
    # at most most_toxic + most_clean rows of two numbers are broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({w for s in _sentences(t) for w in s}) for t in fill(batch.column(0)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["label", "words"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(start, 100) for batch in batches for start in range(0, len(batch), 100))
        documents = ((words, label == 1) for p in parts for label, words in zip(*(p.column(i).to_pylist() for i in range(2)), strict=True))
        model = fit(documents)
        if model is not None:
            numbers = [pa.array([x], pa.float64()) for x in (model.bias, model.slope, model.offset)]
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), *numbers], names=["weights", "bias", "slope", "offset"])

    words = rows.select("_text", "_label").mapInArrow(gather, "label int, words array<string>")
    # one task learns from the bounded sample; the driver only gets the weights
    found = words.repartition(1).mapInArrow(learn, "weights binary, bias double, slope double, offset double").first()
    return found and Model(np.frombuffer(found.weights, np.float32), found.bias, found.slope, found.offset)


def score_toxicity(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row of docs: the probability that its label would be 1.

    Whole texts are scored, of any length. Null and empty texts get the score of
    a text without any string; without a model every score is 0. Repeated rows
    each get theirs; other columns are ignored.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                if model is None:
                    out = np.zeros(len(part))
                else:
                    out = model.probability(decide_texts(model, fill(part.column(1)).to_pylist(), known))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out)], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model | None, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, with their own columns."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                score = model.probability(decide_texts(model, fill(part.column(at)).to_pylist(), known))
                yield part.filter(pa.array(score < threshold))

    return docs if model is None else docs.mapInArrow(keep, schema)


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))

