"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters. Affixes, character n-grams and a lexicon learnt from the sample give
each word a potential per language, learnt transitions tie neighbours together, and the
forward-backward recursion labels every word, so a text may switch between languages. A document
gets the language with the highest mean probability over its words.

The fit learns every language that a document with a letter is labelled with, from a bounded
sample: at most ``SAMPLE_ROWS`` documents per language, of longer ones pieces of ``SAMPLE_TEXT``
characters in all (less where many languages would exceed ``SAMPLE_CHARS``), in chains that join
fragments of different documents. Every whole text is labelled, in chains of ``CHAIN`` words.
"""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.llm.batches import quoted, release_memory, slices

SAMPLE_ROWS = 400
SAMPLE_TEXT = 20_000
#: Characters of the whole sample, and the least left to a document of it.
SAMPLE_CHARS = 1 << 27
LEAST_TEXT = 2_000
FRAGMENT = 32
FRAGMENTS_PER_DOC = 4
CHAIN = 128
FEATURE_BITS = 17
#: Lengths of the character n-grams, and an odd number that scatters their hashes.
GRAMS = (2, 3, 4)
MIX = np.uint64(0x9E3779B97F4A7C15)
EPOCHS = 4
SLICE_BYTES = 2 << 20
KNOWN_WORDS = 300_000
#: Numbers in a block of work and, times eight, in the kept word potentials, for many languages.
BLOCK_NUMBERS = 1 << 22
#: One sampled document in so many is held out to set the least score, and the share of these that
#: reach the score it is taken from.
HELD_OUT = 5
REACHED = 0.995
UNDETERMINED = "und"
LETTERS = r"\p{L}+"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # (features, languages)
    transitions: np.ndarray  # (languages, languages), log potentials
    lexicon: dict[str, int]
    least: float = 0.0  # the score a text needs to count as one of the languages


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words in a row, and how many each word has.

    They are hashes of the n-grams of the word between boundary marks (those with a mark are its
    affixes), of the whole word, and of what the lexicon knows of it.
    """
    marked = "".join(f"^{w}$" for w in words)
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))
    owners, hashes = [], []
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolled = rolled[: len(points) - n + 1] * MIX + points[n - 1 :]
        if n in GRAMS:
            inside = left[: len(rolled)] >= n
            owners.append(owner[: len(rolled)][inside])
            hashes.append(rolled[inside] + np.uint64(n))
    starts = np.cumsum(sizes) - sizes
    spread = points * (np.arange(len(points)) - starts[owner] + 1).astype(np.uint64) * MIX
    spread ^= spread >> np.uint64(29)
    owners.append(np.arange(len(words)))
    hashes.append(np.add.reduceat(spread * MIX, starts))
    known = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    owners.append(np.flatnonzero(known >= 0))
    hashes.append(known[known >= 0].astype(np.uint64) * MIX + np.uint64(7))
    hashed = np.concatenate(hashes) * MIX
    hashed ^= hashed >> np.uint64(32)
    numbers = (hashed * MIX >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    who = np.concatenate(owners)
    return numbers[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(words))


def emissions(words: list[str], model: Model) -> np.ndarray:
    """Log potentials (words, languages)."""
    if not words:
        return np.empty((0, len(model.languages)), np.float32)
    flat, sizes = features(words, model.lexicon)
    ends = np.cumsum(sizes)
    starts, k = ends - sizes, max(1, len(model.languages))
    out = np.empty((len(words), k), np.float32)
    first = 0
    while first < len(words):
        # Words whose features fill a block.
        last = int(np.searchsorted(ends, starts[first] + BLOCK_NUMBERS // k, "right"))
        last = max(first + 1, last)
        rows = model.weights[flat[starts[first] : ends[last - 1]]]
        out[first:last] = np.add.reduceat(rows, starts[first:last] - starts[first])
        first = last
    return out / sizes[:, None]


def forward_backward(
    potentials: np.ndarray, lengths: np.ndarray, transitions: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the labels (chains, words, labels), and of neighbouring pairs summed over
    all chains. Places beyond a chain's length hold no meaning."""
    n, longest, k = potentials.shape
    e = np.exp(potentials - potentials.max(axis=2, keepdims=True))
    t = np.exp(transitions - transitions.max())
    ahead, back = np.empty_like(e), np.ones_like(e)
    ahead[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for i in range(1, longest):
        a = (ahead[:, i - 1] @ t) * e[:, i]
        ahead[:, i] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(longest - 2, -1, -1):
        inside = (i + 1 < lengths)[:, None]
        right = e[:, i + 1] * back[:, i + 1]
        b = right @ t.T
        back[:, i] = np.where(inside, b / b.sum(1, keepdims=True), 1.0)
        weight = ((ahead[:, i] @ t) * right).sum(1, keepdims=True)
        pairs += t * ((ahead[:, i] / weight)[inside[:, 0]].T @ right[inside[:, 0]])
    p = ahead * back
    return p / p.sum(2, keepdims=True), pairs


def _chains(sample: list[tuple[str, list[str]]], languages: list[str], rng) -> tuple[list, list]:
    """Training chains: two fragments of different documents one after the other."""
    number = {x: i for i, x in enumerate(languages)}
    fragments = []
    for lang, words in sample:
        starts = np.arange(0, len(words), FRAGMENT)
        for s in rng.permutation(starts)[:FRAGMENTS_PER_DOC]:
            part = words[s : s + FRAGMENT]
            fragments.append((part, [number[lang]] * len(part)))
    order = rng.permutation(len(fragments))
    words, labels = [], []
    for a, b in zip(order[::2], [*order[1::2], *order[:1]], strict=False):
        words.append(fragments[a][0] + fragments[b][0])
        labels.append(fragments[a][1] + fragments[b][1])
    return words, labels


def learn_lexicon(sample: list[tuple[str, list[str]]], languages: list[str]) -> dict[str, int]:
    """Words seen at least three times, nine times of ten in one language."""
    per_language: dict[str, Counter] = {lang: Counter() for lang in languages}
    total: Counter[str] = Counter()
    for lang, words in sample:
        per_language[lang].update(words)
        total.update(words)
    return {
        w: number
        for number, lang in enumerate(languages)
        for w, n in per_language[lang].items()
        if n >= 3 and n >= 0.9 * total[w]
    }


def train(sample: list[tuple[str, str]], seed: int = 0) -> Model:
    """Fit on (language, text) rows by adaptive gradient steps on the conditional likelihood."""
    import regex

    rng = np.random.default_rng(seed)
    find = regex.compile(LETTERS).findall
    parsed = [(lang, words) for lang, text in sample if (words := find(text.lower()))]
    languages = sorted({lang for lang, _ in parsed})
    k = len(languages)
    model = Model(
        languages,
        np.zeros((1 << FEATURE_BITS, k), np.float32),
        np.zeros((k, k)),
        learn_lexicon(parsed, languages),
    )
    if not parsed:
        return model
    chains, labels = _chains(parsed, languages, rng)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for c in chains for w in c))}
    flat, sizes = features(list(vocabulary), model.lexicon)
    starts = np.cumsum(sizes) - sizes
    squares, t_squares = np.full_like(model.weights, 1e-6), np.full((k, k), 1e-6)
    together = min(128, max(16, 128 * 64 // k))
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // together)):
            lengths = np.array([len(chains[i]) for i in batch])
            ids = np.zeros((len(batch), lengths.max()), np.int64)
            gold = np.zeros_like(ids)
            for row, i in enumerate(batch):
                ids[row, : lengths[row]] = [vocabulary[w] for w in chains[i]]
                gold[row, : lengths[row]] = labels[i]
            real = np.arange(ids.shape[1]) < lengths[:, None]
            used, place = np.unique(ids, return_inverse=True)
            place = place.reshape(ids.shape)
            at = np.repeat(starts[used] - (np.cumsum(sizes[used]) - sizes[used]), sizes[used])
            own = flat[at + np.arange(len(at))]
            bounds = np.cumsum(sizes[used]) - sizes[used]
            scores = np.add.reduceat(model.weights[own], bounds) / sizes[used][:, None]
            p, pairs = forward_backward(
                scores[place].astype(np.float64), lengths, model.transitions
            )
            error = np.eye(k)[gold] - p
            error[~real] = 0
            per_word = np.zeros((len(used), k))
            np.add.at(per_word, place.ravel(), error.reshape(-1, k))
            gradient = np.repeat(per_word / sizes[used][:, None], sizes[used], axis=0)
            touched, where = np.unique(own, return_inverse=True)
            summed = np.zeros((len(touched), k))
            np.add.at(summed, where, gradient)
            squares[touched] += summed**2
            model.weights[touched] += 0.5 * summed / np.sqrt(squares[touched])
            inner = real[:, 1:]
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[:, :-1][inner], gold[:, 1:][inner]), 1)
            t_squares += (seen - pairs) ** 2
            model.transitions[:] += 0.1 * (seen - pairs) / np.sqrt(t_squares)
    return model


def least_score(model: Model, held: list[str]) -> float:
    """Halfway between chance and the score that all but a few held-out documents reach, by a model
    that has not seen them; 0 where there is no choice between languages."""
    if len(model.languages) < 2 or not held:
        return 0.0
    reached = np.quantile(Labeller(model)(held).max(1), 1 - REACHED)
    return float(1 / len(model.languages) + reached) / 2


def fit(
    docs: DataFrame, usable: Column, rows: int = SAMPLE_ROWS, calibrate: bool = True
) -> Model:
    """Learn from text and non-null lang of at most ``rows`` usable documents per language; every
    language with a letter in one of them is learnt. ``calibrate`` sets the model's least score, by a
    fifth of the sample that is then not learnt from, but for languages that have no other document.

    docs: doc_id (only to draw the sample), text and lang. Without any, the model knows no language.
    """
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 30))
    known = known.select(place.alias("place"), "lang", "text")
    # Equal rows count once; the first document of a language is always drawn.
    counts = known.groupBy("lang").agg(
        F.approx_count_distinct("place").alias("of"), F.min("place").alias("first")
    )
    shares = counts.select(
        "lang",
        F.greatest("first", F.lit(1.2 * rows * (1 << 30)) / F.col("of")).cast("long").alias("up_to"),
    ).toArrow()
    size = SAMPLE_CHARS // max(1, rows * shares.num_rows)
    size = max(LEAST_TEXT, min(SAMPLE_TEXT, size))
    drawn = F.broadcast(docs.sparkSession.createDataFrame(shares))
    sample = known.join(drawn, "lang").where(F.col("place") <= F.col("up_to"))
    sample = sample.select("place", "lang", _pieces(F.col("text"), size).alias("text")).distinct()

    def learn(batches):
        model = learnt([r for batch in batches for r in batch.to_pylist()], rows, calibrate)
        fields = (model.languages, model.weights, model.transitions, model.lexicon, model.least)
        yield pa.record_batch({"model": pa.array([pickle.dumps(fields)], pa.binary())})
        release_memory()

    # In a task: the sample and the fit take more memory than the driver needs for anything else.
    found = sample.repartition(1).mapInArrow(learn, "model binary").toArrow().column("model")
    return Model(*pickle.loads(found[0].as_py())) if len(found) else train([])


def learnt(table: list[dict], rows: int, calibrate: bool) -> Model:
    """The model of the sampled rows (place, lang, text), in whatever order they come."""
    table.sort(key=lambda r: (r["place"], r["lang"], r["text"]))
    taken: Counter[str] = Counter()
    chosen = []
    for r in table:
        taken[r["lang"]] += 1
        if taken[r["lang"]] <= rows:
            chosen.append((r["lang"], r["text"]))
    table.clear()
    taught = {lang for i, (lang, _) in enumerate(chosen) if i % HELD_OUT}
    held = [calibrate and not i % HELD_OUT and lang in taught for i, (lang, _) in enumerate(chosen)]
    model = train([r for r, out in zip(chosen, held, strict=True) if not out])
    if calibrate:
        model = replace(model, least=least_score(model, [t for (_, t), out in zip(chosen, held, strict=True) if out]))
    return model


def _pieces(text: Column, size: int) -> Column:
    """The text, or of the letters of one longer than ``size`` pieces from all over it."""
    part = size // FRAGMENTS_PER_DOC
    letters = F.trim(F.regexp_replace(text, r"\P{L}+", " "))

    def cut(x):
        left = F.greatest(F.length(x) - part, F.lit(0))
        return F.concat_ws(
            " ",
            *(
                F.substr(x, (F.floor(left * i / (FRAGMENTS_PER_DOC - 1)) + 1).cast("int"), F.lit(part))
                for i in range(FRAGMENTS_PER_DOC)
            ),
        )

    short = F.when(F.length(letters) <= size, letters).otherwise(cut(letters))
    return F.when(F.length(text) <= size, text).otherwise(short)


class Labeller:
    """Mean label probabilities of texts; word potentials are kept up to a number of words."""

    def __init__(self, model: Model, chain: int = CHAIN):
        import regex

        self.model, self.chain = model, chain
        self.find = regex.compile(LETTERS).findall
        self._forget()

    def _forget(self):
        self.place: dict[str, int] = {}
        self.scores = np.empty((0, len(self.model.languages)), np.float32)

    def _words(self, words: list[str]) -> np.ndarray:
        if len(self.place) > min(KNOWN_WORDS, 8 * BLOCK_NUMBERS // len(self.model.languages)):
            self._forget()
        new = list(dict.fromkeys(w for w in words if w not in self.place))
        if new:
            at = len(self.place)
            self.place.update(zip(new, range(at, at + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, emissions(new, self.model)])
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: list[str]) -> np.ndarray:
        """(texts, languages); a row of zeros where there is no letter."""
        k = len(self.model.languages)
        found = [self.find(t.lower()) for t in texts]
        n_words = np.fromiter(map(len, found), np.int64, len(found))
        total = np.zeros((len(texts), k))
        if not k or not n_words.sum():
            return total
        ids = self._words([w for words in found for w in words])
        n_chains = -(-n_words // self.chain)
        owner = np.repeat(np.arange(len(texts)), n_chains)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(n_chains) - n_chains, n_chains)
        first = (np.cumsum(n_words) - n_words)[owner] + turn * self.chain
        lengths = np.minimum(n_words[owner] - turn * self.chain, self.chain)
        # Chains of like length share a block, so that little of it is padding.
        together = min(2000, max(1, BLOCK_NUMBERS // (self.chain * k)))
        for block in np.array_split(np.argsort(lengths), max(1, len(lengths) // together)):
            span = np.arange(lengths[block].max())
            real = span < lengths[block][:, None]
            at = np.where(real, first[block][:, None] + span, first[block][:, None])
            p, _ = forward_backward(
                self.scores[ids[at]].astype(np.float64), lengths[block], self.model.transitions
            )
            p[~real] = 0
            np.add.at(total, owner[block], p.sum(1))
        return total / np.maximum(n_words, 1)[:, None]


def _labelled(docs: DataFrame, model: Model, carried: Column) -> DataFrame:
    """(carried, lang_pred, score)"""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.weights, model.transitions, model.lexicon)
    )

    def label(batches):
        labeller = Labeller(Model(*shared.value))
        names = [*labeller.model.languages, UNDETERMINED]
        for batch in slices(batches, "text", SLICE_BYTES):
            p = labeller([t or "" for t in batch.column("text").to_pylist()])
            if p.shape[1]:
                score, best = p.max(1), np.where(p.max(1) > 0, p.argmax(1), len(names) - 1)
            else:
                score, best = np.zeros(len(p)), np.zeros(len(p), np.int64)
            yield pa.record_batch(
                {
                    "carried": batch.column("carried"),
                    "lang_pred": pa.array([names[i] for i in best], pa.string()),
                    "score": pa.array(np.minimum(score, 1.0), pa.float64()),
                }
            )

    rows = docs.select(carried.alias("carried"), "text")
    told = T.StructType([rows.schema["carried"]]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(label, told)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score): the language of highest mean probability, ties to the first by
    name; ``und`` and 0 for texts that are null or have no letter, or if no language is known.

    docs: doc_id and text; other columns are ignored. Null and repeated ids are rows like any other.
    """
    return _labelled(docs, model, F.col("doc_id")).withColumnRenamed("carried", "doc_id")


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` in a language of the model: those whose score is at least the model's
    least. A model without a language cannot tell and passes every text with a letter."""
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = _labelled(docs, model, F.struct(*quoted(docs.columns)))
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= model.least))
    return kept.select(*(F.col(f"carried.`{c}`").alias(c) for c in docs.columns))
