"""Language ID by a linear-chain conditional random field over words.

Words are runs of letters. A word's score for each language is the sum of learned weights of
its byte trigrams (n-grams, with the word's ends), its first and last four bytes (affixes) and, if
it was seen often enough, the word itself (lexicon). Learned transitions tie neighbouring words.
Forward-backward gives every word its probabilities in the context of the whole text, so that words of a second
language inside a text are labelled on their own; the text's language is the one with the
largest expected number of words, its score that share.

Training takes every text that it may learn from. The texts are dealt by a hash to groups of about ``shard_bytes``, at least
``shards`` of them; copies of a text are dealt round, so that no group is larger for them. Texts without copies, told by
counts of hashes, cross the network once. Each group fits its
own weights by gradient steps over chunks of ``chunk_bytes``, and the weights are averaged. Stretches of ``stretch`` words of different
texts follow one another, so that transitions see languages change. A group's first chunk is gone through ``epochs`` times in
``batches`` steps, the later ones once, in a step each.

Whether a text is in a known language at all is judged apart from the labels, whose probabilities always sum to one. A
word is familiar if its byte trigrams are as frequent, in the training texts of its language, as those of nearly all words of
texts that were not counted: at most ``spread`` times as far below the median as the lower quartile. All words of all training texts
count, each ``shards``-th part of the texts measured by the others. Frequencies are shares of all
trigrams, so that junk among the training texts hardly makes junk familiar.

Defined results: a null text, a text without letters, and any text where nothing could be learned is
``und`` with score 0. A tie goes to the first language in sorted order. Repeated rows are labelled each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.llm.tables import free_name
from shoebox.llm.words import mixed, pieces, raw_text, run_hashes, runs


@dataclass(frozen=True)
class Training:
    shards: int = 4
    shard_bytes: int = 1 << 25
    chunk_bytes: int = 1 << 20
    epochs: int = 6
    batches: int = 4
    rate: float = 0.3
    decay: float = 1e-5
    stretch: int = 40
    chain: int = 128
    seen: int = 3
    spread: float = 4.0


UNKNOWN = "und"
TRIGRAMS, AFFIXES, LEXICON = 1 << 18, 1 << 16, 1 << 18
_SIZE = TRIGRAMS + 2 * AFFIXES + LEXICON
BLOCK = 64
FIXED = float(1 << 32)  # weights are summed in whole parts of this
FINE = 1024  # steps to a unit of familiarity
CELLS = 1 << 26  # for hashes of texts with copies

# Letters a-z are symbols 1 to 26, bytes of other letters share 27 to 63, everything else is 0.
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128) * 29 % 37


@dataclass
class Features:
    """Feature numbers of the words of some texts."""

    trigrams: np.ndarray  # one a byte
    firsts: np.ndarray  # where each word's trigrams begin
    fixed: np.ndarray  # words x 2: affixes
    hashes: np.ndarray  # a word's whole hash
    bounds: np.ndarray  # where each text's words begin

    def lexicon(self) -> np.ndarray:
        return TRIGRAMS + 2 * AFFIXES + (self.hashes >> np.uint64(46)).astype(np.int64)


def features(raw: np.ndarray, bounds: np.ndarray) -> Features:
    texts = len(bounds) - 1
    # One empty symbol before each text, and three at the end, so that n-grams stay within words.
    symbols = np.zeros(len(raw) + texts + 4, np.int64)
    at = np.arange(len(raw)) + np.repeat(np.arange(texts), np.diff(bounds)) + 1
    symbol = _SYMBOL[raw]
    # Second bytes of Latin-1 capitals (after 0xC3) count as their small letters.
    capital = (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
    capital[1:] &= raw[:-1] == 0xC3
    capital[:1] = False
    symbol[capital] = _SYMBOL[raw[capital] + 32]
    symbols[at] = symbol
    starts, ends = runs(symbols > 0, np.array([0, len(symbols)]))
    inside = np.flatnonzero(symbols)
    trigrams = (symbols[inside - 1] << 12) | (symbols[inside] << 6) | symbols[inside + 1]
    lengths = ends - starts
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)

    def affix(positions: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(starts), np.uint64)
        for p in positions:
            h = h * np.uint64(64) + symbols[p].astype(np.uint64)
        return (mixed(h + np.uint64(1)) >> np.uint64(48)).astype(np.int64)

    head = affix([np.minimum(starts + j, ends) for j in range(4)])
    tail = affix([np.maximum(ends - 1 - j, starts - 1) for j in range(4)])
    fixed = np.stack([TRIGRAMS + head, TRIGRAMS + AFFIXES + tail], axis=1)
    hashes = run_hashes(mixed(symbols.astype(np.uint64)), starts, ends)
    return Features(trigrams, firsts, fixed, hashes, np.searchsorted(starts, bounds + np.arange(texts + 1)))


def emissions(weights: np.ndarray, f: Features) -> np.ndarray:
    """Score of each word for each language."""
    if not len(f.firsts):
        return np.zeros((0, weights.shape[1]), np.float32)
    score = np.add.reduceat(weights[f.trigrams], f.firsts, axis=0)
    return score + weights[f.fixed[:, 0]] + weights[f.fixed[:, 1]] + weights[f.lexicon()]


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Logarithm of each trigram's share of all trigrams of each language; a trigram not met counts as half a one."""
    return np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5)).astype(np.float32)


def familiarity(shares: np.ndarray, f: Features) -> np.ndarray:
    """Mean logarithm of the shares of each word's trigrams, for each language."""
    if not len(f.firsts):
        return np.zeros((0, shares.shape[1]), np.float32)
    return np.add.reduceat(shares[f.trigrams], f.firsts, axis=0) / np.diff(np.append(f.firsts, len(f.trigrams)))[:, None]


def posteriors(score: np.ndarray, bounds: np.ndarray, transition: np.ndarray, moves: np.ndarray | None = None) -> np.ndarray:
    """Probability of each label for each word: forward-backward over every text.

    To ``moves`` (labels x labels), if given, the expected number of moves from label to label is added.

    Texts are cut into blocks of words. Products of the transfer matrices of a block carry the forward and
    backward vectors from block to block, then all blocks are walked side by side.
    """
    labels = score.shape[1]
    counts = np.diff(bounds)
    per_text = -(-counts // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(per_text)])
    blocks = int(first_block[-1])
    if not blocks:
        return np.zeros_like(score, dtype=np.float64)
    text_of = np.repeat(np.arange(len(counts)), per_text)
    begin = bounds[:-1][text_of] + (np.arange(blocks) - first_block[text_of]) * BLOCK
    width = np.minimum(BLOCK, bounds[1:][text_of] - begin)
    at = begin[:, None] + np.minimum(np.arange(BLOCK)[None, :], width[:, None] - 1)
    live = np.arange(BLOCK)[None, :] < width[:, None]
    local = np.exp(score - score.max(axis=1, keepdims=True))[at]
    step = np.exp(transition - transition.max())

    def scaled(v: np.ndarray) -> np.ndarray:
        return v / v.max(axis=tuple(range(1, v.ndim)), keepdims=True)

    product = np.broadcast_to(np.eye(labels), (blocks, labels, labels)).copy()
    # No move leads to a text's first word.
    opening = np.zeros((blocks, BLOCK), bool)
    opening[first_block[:-1][per_text > 0], 0] = True
    for t in range(BLOCK):
        on = live[:, t]
        moved = np.where(opening[on, t, None, None], product[on], product[on] @ step)
        product[on] = scaled(moved * local[on, t, None, :])
    before = np.ones((blocks, labels))
    after = np.ones((blocks, labels))
    for k in range(1, int(per_text.max())):
        here = first_block[:-1][per_text > k] + k
        before[here] = scaled(np.einsum("bi,bij->bj", before[here - 1], product[here - 1]))
        here = first_block[1:][per_text > k] - 1 - k
        after[here] = scaled(np.einsum("bij,bj->bi", product[here + 1], after[here + 1]))
    forward = np.empty((blocks, BLOCK, labels))
    v = before
    for t in range(BLOCK):
        v = scaled(np.where(opening[:, t, None], v, v @ step) * local[:, t])
        forward[:, t] = v
    # Columns past a block's last word repeat it; the backward walk starts at the last word.
    result = np.empty((blocks, BLOCK, labels))
    v = after
    for t in range(BLOCK - 1, -1, -1):
        result[:, t] = forward[:, t] * v
        if moves is not None:
            # The word before stands in this block or ends the block before.
            on = np.flatnonzero(live[:, t] & ~opening[:, t])
            earlier = forward[on, t - 1] if t else forward[on - 1, BLOCK - 1]
            joint = earlier[:, :, None] * step[None] * (v * local[:, t])[on, None, :]
            moves += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        moved = scaled((v * local[:, t]) @ step.T)
        v = np.where(live[:, t, None], moved, v)
    result /= result.sum(axis=2, keepdims=True)
    out = np.empty((len(score), labels))
    out[at[live]] = result[live]
    return out


class _Shard:
    """Weights and transitions that make the labels of one shard likely, learned chunk after chunk."""

    def __init__(self, labels: int, spec: Training):
        self.labels, self.spec, self.first = labels, spec, True
        self.weights = np.zeros((_SIZE, labels), np.float32)
        self.transition = np.zeros((labels, labels))
        self.square_w = np.full((_SIZE, labels), 1e-2, np.float32)
        self.square_t = np.full((labels, labels), 1e-2)
        self.met = np.zeros(LEXICON, np.int64)  # words so far, by their number in the lexicon
        self.rng = np.random.default_rng(7)

    def learn(self, raw: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> None:
        f, spec, labels, rng = features(raw, bounds), self.spec, self.labels, self.rng
        weights, transition = self.weights, self.transition
        words = len(f.firsts)
        if not words:
            return
        truth = np.repeat(label, np.diff(f.bounds))
        number = f.lexicon() - (_SIZE - LEXICON)
        self.met += np.bincount(number, minlength=LEXICON)
        known = self.met[number] >= spec.seen
        lengths = np.diff(np.append(f.firsts, len(f.trigrams)))
        # Stretches of all texts in random order, end to end, then cut into chains.
        part = np.arange(words) - np.repeat(f.bounds[:-1], np.diff(f.bounds))
        number = np.cumsum(part % spec.stretch == 0) - 1
        rank = rng.permutation(int(number[-1]) + 1)
        order = np.argsort(rank[number], kind="stable")
        chains = np.array_split(order, max(1, words // spec.chain))
        for _ in range(spec.epochs if self.first else 1):
            for group in np.array_split(rng.permutation(len(chains)), spec.batches if self.first else 1):
                if not len(group):
                    continue
                take = np.concatenate([chains[g] for g in group])
                spans = np.concatenate([[0], np.cumsum([len(chains[g]) for g in group])])
                word = np.repeat(np.arange(len(take)), lengths[take])
                inner = np.arange(len(word)) - np.repeat(np.cumsum(lengths[take]) - lengths[take], lengths[take])
                trigrams = f.trigrams[np.repeat(f.firsts[take], lengths[take]) + inner]
                lexicon = f.lexicon()[take]
                lexicon_on = known[take]
                score = np.add.reduceat(weights[trigrams], np.cumsum(lengths[take]) - lengths[take], axis=0)
                score = score + weights[f.fixed[take, 0]] + weights[f.fixed[take, 1]] + weights[lexicon] * lexicon_on[:, None]
                expected = np.zeros((labels, labels))
                error = posteriors(score, spans, transition, expected)
                error[np.arange(len(take)), truth[take]] -= 1
                error /= len(take)
                index = np.concatenate([trigrams, f.fixed[take, 0], f.fixed[take, 1], lexicon[lexicon_on]])
                grad = np.stack(
                    [np.bincount(index, np.concatenate([error[word, j], error[:, j], error[:, j], error[lexicon_on, j]]), _SIZE) for j in range(labels)],
                    axis=1,
                ).astype(np.float32)
                grad += spec.decay * weights / len(chains)
                self.square_w += (grad * len(chains)) ** 2
                weights -= spec.rate * grad * len(chains) / np.sqrt(self.square_w)
                # Expected less observed moves: the gradient of the negative log likelihood.
                inner_pairs = np.setdiff1d(np.arange(len(take) - 1), spans[1:-1] - 1)
                seen = np.zeros((labels, labels))
                np.add.at(seen, (truth[take][inner_pairs], truth[take][inner_pairs + 1]), 1)
                move = (expected - seen) / max(1, len(inner_pairs)) + spec.decay * transition
                self.square_t += move**2
                transition -= spec.rate * move / np.sqrt(self.square_t)
        self.first = False


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """The rows ``text, label, copies`` of a task, each as often as it has copies, in tables of about ``limit`` bytes of text."""
    held, size, last = [], 0, 0
    for batch in batches:
        times = batch.column("copies").to_numpy()
        for part in pieces(batch.take(pa.array(np.repeat(np.arange(len(times)), times))), "text", limit):
            # Chunks follow from the bytes before, whatever batches the rows come in.
            ends = size + np.cumsum(np.asarray(pc.binary_length(part.column("text")), np.int64))
            number = ends // limit
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), len(ends)]
            for start, stop in zip(cuts, cuts[1:]):
                if held and number[start] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(part.slice(start, stop - start))
                last = number[start]
            size = int(ends[-1])
    if held:
        yield pa.Table.from_batches(held)


def _count(raw: np.ndarray, bounds: np.ndarray, label: np.ndarray, labels: int) -> np.ndarray:
    """How often each trigram stands in the texts of each label."""
    f = features(raw, bounds)
    truth = np.repeat(np.repeat(label, np.diff(f.bounds)), np.diff(np.append(f.firsts, len(f.trigrams))))
    return np.stack([np.bincount(f.trigrams[truth == j], minlength=TRIGRAMS) for j in range(labels)], axis=1)


def _steps(raw: np.ndarray, bounds: np.ndarray, label: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """How familiar each word is in its own language, in steps of 1 / FINE below 0; and the word's label."""
    f = features(raw, bounds)
    truth = np.repeat(label, np.diff(f.bounds))
    if not len(truth):
        return np.zeros((0, 2), np.int64)
    lengths = np.diff(np.append(f.firsts, len(f.trigrams)))
    near = np.add.reduceat(shares[f.trigrams, np.repeat(truth, lengths)].astype(np.float64), f.firsts) / lengths
    return np.stack([truth, np.floor(-near * FINE).astype(np.int64)], axis=1)


def _floor(steps: np.ndarray, counts: np.ndarray, spread: float) -> float:
    """Least familiarity of a word, from how many words have each number of steps."""
    order = np.argsort(-steps)
    passed = np.cumsum(counts[order])
    quarter, middle = (-(steps[order][np.searchsorted(passed, share * passed[-1])] + 0.5) / FINE for share in (0.25, 0.5))
    return float(middle - spread * (middle - quarter))


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    weights: np.ndarray
    transition: np.ndarray
    shares: np.ndarray | None = None  # trigrams x labels
    floors: np.ndarray | None = None  # least familiarity of a word of each label


def _summed(rows: DataFrame, keys: list[str], labels: int) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Whole numbers ``v0`` to ``v<labels - 1>`` of each feature summed over all tasks; by the other ``keys``."""
    values = [f"v{j}" for j in range(labels)]
    table = rows.groupBy(*keys, "feature").agg(*(F.sum(v).alias(v) for v in values)).toArrow()
    by = np.stack([table.column(k).to_numpy() for k in keys], axis=1)
    feature = table.column("feature").to_numpy()
    matrix = np.stack([table.column(v).to_numpy() for v in values], axis=1)
    return {tuple(k): (feature[here], matrix[here]) for k in np.unique(by, axis=0).tolist() for here in [(by == k).all(axis=1)]}


def _emit(keys: dict[str, int], feature: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
    columns = {k: np.full(len(feature), v, np.int32) for k, v in keys.items()}
    columns |= {"feature": feature.astype(np.int32)} | {f"v{j}": matrix[:, j].astype(np.int64) for j in range(matrix.shape[1])}
    return pa.RecordBatch.from_pydict(columns)


def _home(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(shards))


def _marked(rows: DataFrame) -> DataFrame:
    """The rows ``text, label`` with ``repeated``, which is false only where no other row is the same.

    Rows are counted by a hash. The hashes met more than once fall into ``CELLS`` cells, a bit each, of which a row holds 64; so
    what is handed to all tasks is bounded, and where it is full, more single rows are marked too.
    """
    hashed = rows.withColumn("hash", F.xxhash64("text", "label"))
    word, bit = F.expr(f"pmod(hash, {CELLS}L) div 64"), F.expr(f"shiftleft(1L, cast(pmod(hash, {CELLS}L) % 64 as int))")
    often = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    cells = often.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    found = hashed.withColumn("word", word).join(F.broadcast(cells), "word", "left")
    return found.select("text", "label", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False)).alias("repeated"))


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    """``shard, text, label, copies``: copies of a text are dealt to as many shards as there are, each getting an equal part of them.

    Only rows that may have copies are brought together for it; all others go to their shard from where they are read.
    """
    marked = _marked(rows)
    single = marked.filter(~F.col("repeated")).select(_home(shards).cast("int").alias("shard"), "text", "label", F.lit(1).cast("long").alias("copies"))
    copies = marked.filter("repeated").groupBy("text", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.least("n", F.lit(shards)))
    parts = copies.select("text", "label", "n", "parts", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"))
    return single.unionByName(
        parts.select(
            F.pmod(_home(shards) + F.col("part"), F.lit(shards)).cast("int").alias("shard"),
            "text",
            "label",
            (F.floor(F.col("n") / F.col("parts")) + F.when(F.col("part") < F.col("n") % F.col("parts"), 1).otherwise(0)).alias("copies"),
        )
    )


def train(docs: DataFrame, use: Column, spec: Training = Training(), text_col: str = "text", label_col: str = "lang", calibrate: bool = False) -> Model:
    """Fit on all rows where ``use`` holds and text and label are given; ``calibrate`` also finds how familiar words must be."""
    rows = docs.filter(use & F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    sizes = {r["label"]: r["bytes"] for r in rows.groupBy("label").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()}
    names = tuple(sorted(sizes))
    if not names:
        return Model((), np.zeros((_SIZE, 0), np.float32), np.zeros((0, 0)))
    labels, number = len(names), {k: i for i, k in enumerate(names)}
    shards = max(spec.shards, -(-sum(sizes.values()) // spec.shard_bytes))
    values = ", ".join(f"v{j} long" for j in range(labels))

    def texts_of(table):
        text = table.column("text")
        raw, bounds = raw_text(text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text)
        return raw, bounds, np.array([number[k] for k in table.column("label").to_pylist()])

    def fit(batches):
        shard = _Shard(labels, spec)
        for chunk in _chunks(batches, spec.chunk_bytes):
            shard.learn(*texts_of(chunk))
        if not shard.first:
            # As whole numbers, so that the sums do not depend on their order.
            used = np.flatnonzero(np.abs(shard.weights).sum(axis=1))
            yield _emit({"kind": 0}, used, np.rint(shard.weights[used].astype(np.float64) * FIXED))
            yield _emit({"kind": 1}, np.arange(labels), np.rint(shard.transition * FIXED))
            yield _emit({"kind": 2}, np.zeros(1), np.ones((1, labels)))

    dealt = _dealt(rows, shards).repartitionById(shards, "shard").sortWithinPartitions(F.xxhash64("text"), "text", "label")
    fitted = _summed(dealt.mapInArrow(fit, f"kind int, feature int, {values}"), ["kind"], labels)
    weights, transition = np.zeros((_SIZE, labels), np.float32), np.zeros((labels, labels))
    if fitted:
        scale = FIXED * float(fitted[2,][1][0, 0])
        transition[fitted[1,][0]] = fitted[1,][1] / scale
        if (0,) in fitted:
            weights[fitted[0,][0]] = fitted[0,][1] / scale
    if not calibrate:
        return Model(names, weights, transition)

    folded = rows.withColumn("fold", (_home(shards) % spec.shards).cast("int"))

    def by_fold(batches):
        for batch in (p for b in batches for p in pieces(b, "text", 1 << 19)):
            folds = batch.column("fold").to_numpy()
            for fold in np.unique(folds).tolist():
                yield fold, texts_of(batch.filter(pa.array(folds == fold)))

    def counted(batches):
        total = {}
        for fold, texts in by_fold(batches):
            total[fold] = total.get(fold, 0) + _count(*texts, labels)
        for fold, n in total.items():
            met = np.flatnonzero(n.sum(axis=1))
            yield _emit({"fold": fold}, met, n[met])

    own = _summed(folded.mapInArrow(counted, f"fold int, feature int, {values}"), ["fold"], labels)
    counts = np.zeros((TRIGRAMS, labels), np.int64)
    for met, n in own.values():
        counts[met] += n

    # The words of each part of the texts are measured by the counts of the others, as new texts will be by all.
    def others(fold):
        rest = counts.copy()
        met, n = own[fold,]
        rest[met] -= n
        return rest

    shares = {fold: frequencies(others(fold)) for fold, in own}

    def measured(batches):
        total = {}
        for fold, texts in by_fold(batches):
            if fold in shares:
                found, n = np.unique(_steps(*texts, shares[fold]), axis=0, return_counts=True)
                for (j, step), k in zip(found.tolist(), n.tolist()):
                    total[fold, j, step] = total.get((fold, j, step), 0) + k
        if total:
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in zip(*total)), pa.array(list(total.values()))], names=["fold", "label", "step", "n"])

    steps = folded.mapInArrow(measured, "fold long, label long, step long, n long").groupBy("fold", "label", "step").agg(F.sum("n").alias("n"))
    found = {}
    for r in steps.collect():
        found.setdefault((r["fold"], r["label"]), []).append((r["step"], r["n"]))
    floors = np.full(labels, -np.inf)
    for j in range(labels):
        if shares and all((fold, j) in found and others(fold)[:, j].any() for fold in shares):
            floors[j] = min(_floor(*np.array(found[fold, j]).T, spec.spread) for fold in shares)
    return Model(names, weights, transition, frequencies(counts), floors)


def word_labels(texts: list[str], model: Model) -> list[list[tuple[str, float]]]:
    """Label and probability of each word of each text."""
    f = features(*raw_text(pa.array(texts, pa.string())))
    chance = posteriors(emissions(model.weights, f), f.bounds, model.transition)
    best = chance.argmax(axis=1)
    named = [(model.labels[b], float(p[b])) for b, p in zip(best, chance)]
    return [named[s:e] for s, e in zip(f.bounds, f.bounds[1:])]


def _has_letters(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _predict(batches: Iterator[pa.RecordBatch], model: Model, evidence: bool = False) -> Iterator[pa.RecordBatch]:
    labels = len(model.labels)
    for batch in (p for b in batches for p in pieces(b, "_text", 1 << 19)):
        raw, bounds = raw_text(batch.column("_text"))
        f = features(raw, bounds)
        counts = np.diff(f.bounds)
        share = np.zeros((len(counts), labels + 1))
        familiar = np.zeros(len(counts))
        if labels and len(f.firsts):
            chance = posteriors(emissions(model.weights, f), f.bounds, model.transition)
            total = np.concatenate([np.zeros((1, labels)), np.cumsum(chance, axis=0)])
            share[:, :labels] = (total[f.bounds[1:]] - total[f.bounds[:-1]]) / np.maximum(counts, 1)[:, None]
            if evidence:
                of, word = chance.argmax(axis=1), np.arange(len(f.firsts))
                # Letters count, not words, as digits cut ids and keys into many runs of a letter or two.
                size = np.diff(np.append(f.firsts, len(f.trigrams)))
                at_home = familiarity(model.shares, f)[word, of] >= model.floors[of]
                passed, whole = (np.concatenate([[0], np.cumsum(x)])[f.bounds] for x in (size * at_home, size))
                familiar = np.diff(passed) / np.maximum(np.diff(whole), 1)
        ascii_letter = np.concatenate([[0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122))])
        unclear = np.flatnonzero(ascii_letter[bounds[1:]] == ascii_letter[bounds[:-1]])
        known = (counts > 0) & (labels > 0)
        for i in unclear[known[unclear]]:
            known[i] = _has_letters(batch.column("_text")[int(i)].as_py())
        best = share[:, :labels].argmax(axis=1) if labels else np.zeros(len(counts), int)
        names = [model.labels[b] if k else UNKNOWN for b, k in zip(best, known)]
        score = np.where(known, np.clip(share[np.arange(len(counts)), best], 0, 1), 0.0)
        rest = [batch.column(c) for c in batch.schema.names if c != "_text"]
        if evidence:
            score = familiar
        yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(score)], names=[*(c for c in batch.schema.names if c != "_text"), "_lang", "_score"])


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score"), evidence: bool = False) -> DataFrame:
    """Columns ``keep`` with the predicted language and its score, or with ``evidence`` the share of letters in familiar words in place of the score."""
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType())])
    found = rows.mapInArrow(lambda b: _predict(b, model, evidence), schema)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), F.col("_lang").alias(names[0]), F.col("_score").alias(names[1]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training leaves out: a third, by the CRC-32 of the id as text. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def label_documents(docs: DataFrame, spec: Training = Training()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    model = train(docs, ~held_out(), spec)
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(marked, model, ["doc_id", "held_out"])


def known_only(docs: DataFrame, spec: Training = Training(), least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with letters, of which ``least`` are in words familiar in their own language."""
    model = train(docs, ~held_out(), spec, calibrate=True)
    lang, familiar = free_name(docs, "lang"), free_name(docs, "familiar")
    found = predict(docs, model, docs.columns, names=(lang, familiar), evidence=True)
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(familiar) >= least)).drop(lang, familiar)
