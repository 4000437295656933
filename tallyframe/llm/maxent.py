"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

The most frequent words are dealt into classes by frequency; all other words are one class more. The
chance of a token is that of its class, by a softmax over hashed n-gram and skip features of the three
words before it, times that of the word in its class, by a second softmax over hashed features. The
class of all others is a tree as deep as the head of the vocabulary asks for: each step down to a head
word is one more such softmax, and one leaf at its root holds the words beyond the head, which share its
chance by their counts plus one. All softmaxes start from the counts of all training tokens, so
untrained weights give the add-one unigram model.

Training is distributed: in each round, every task descends on its own part of that round's documents
from the same weights, and the weighted mean of the tasks' steps moves the weights. Scoring works on
batches of numpy arrays; only the counts of words beyond the head of the vocabulary are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.spans import BLANKS, Texts, hash_spans, mix, sums_by_row, texts_of
from tallyframe.session import materialize

#: The token at the end of each text, the word before its first, and a word outside the head.
END, START, OTHER = (np.uint64(x) for x in (0xE0D0E0D0E0D0E0D0, 0x57A7557A7557A755, 0x07E407E407E407E4))


@dataclass(frozen=True)
class Settings:
    #: A word is in the head if it is one of ``head`` tokens or more often; so the head has at most ``head`` words.
    head: int = 1 << 16
    classes: int = 32
    #: Words of a class, and branches of a node of the tree; at least 2.
    per_class: int = 32
    #: Buckets of the features for classes, and for words of a class; steps in the tree have as many of their own.
    class_buckets: int = 1 << 14
    word_buckets: int = 1 << 13
    rounds: int = 3
    rate: float = 1.0
    minibatch: int = 1 << 13
    #: Uses that every bucket counts as having before the first; it slows the first steps.
    calm: float = 400.0
    #: Training leaves out documents whose checksum has this remainder.
    modulus: int = 7
    held_out: int = 2
    seed: int = 11


class Tables:
    """What tasks know of the vocabulary: hashes of the head, counts, and the classes of frequent words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, settings: Settings):
        order = np.lexsort((hashes, -counts))
        frequent = order[: settings.classes * settings.per_class]
        self.settings, self.total, self.distinct = settings, total, distinct
        place = np.full(len(hashes), -1)
        place[frequent] = np.arange(len(frequent))
        by_hash = np.argsort(hashes)
        self.hashes, self.counts, self.place = hashes[by_hash], counts[by_hash], place[by_hash]
        grid = np.zeros(settings.classes * settings.per_class)
        grid[: len(frequent)] = counts[frequent]
        grid = grid.reshape(settings.classes, settings.per_class)
        self.rare_total = total - int(grid.sum())
        self.rare_distinct = distinct - len(frequent)
        # With one more for each word and for an unseen one, untrained weights give the base's chances.
        smoothed = np.where(grid > 0, grid + 1, 0)
        mass = np.append(smoothed.sum(axis=1), self.rare_total + self.rare_distinct + 1)
        others = order[len(frequent) :]
        self.open_total = self.rare_total - int(counts[others].sum())
        self.open_distinct = self.rare_distinct - len(others)
        nodes = self._paths(others, by_hash, counts, smoothed)
        self._lookups(len(nodes))
        with np.errstate(divide="ignore"):  # empty classes and places have no chance
            self.class_bias = np.maximum(np.log(mass / mass.max()), -1e30).astype(np.float32)
            self.word_bias = np.maximum(np.log(nodes), -1e30).astype(np.float32)

    def _paths(self, others: np.ndarray, by_hash: np.ndarray, counts: np.ndarray, smoothed: np.ndarray) -> np.ndarray:
        """Set the nodes and branches on the way to each head word; returns the mass of every node's branches.

        The first nodes are the classes, the next is the root of the tree over ``others``, whose branch 0 is
        the words beyond the head. The last row of the paths is theirs, so that place -1 finds it.
        """
        s, n = self.settings, len(others)
        levels = 1
        while (s.per_class - 1) * s.per_class ** (levels - 1) < n:
            levels += 1
        at = np.arange(n)
        node, branch = np.zeros((2, len(by_hash) + 1, levels), dtype=np.int64)
        depth = np.ones(len(by_hash) + 1, dtype=np.int64)
        node[:-1, 0], branch[:-1, 0] = np.divmod(np.where(self.place >= 0, self.place, 0), s.per_class)
        rows = np.empty(len(by_hash), dtype=np.int64)
        rows[by_hash] = np.arange(len(by_hash))
        rows = rows[others]
        depth[rows] = levels
        node[-1, 0] = s.classes
        if not n:
            depth[-1] = 0
        made = [smoothed]
        first = s.classes
        for level in range(levels):
            below = s.per_class ** (levels - 1 - level)
            spread = at // below + (s.per_class if level else 1)  # the root's branch 0 is taken
            parents = spread // s.per_class - (1 if level else 0)
            node[rows, level], branch[rows, level] = first + parents, spread % s.per_class
            grid = np.zeros((parents.max() + 1 if n else 1, s.per_class))
            np.add.at(grid, (parents, spread % s.per_class), counts[others] + 1)
            if not level:
                grid[0, 0] = self.open_total + self.open_distinct + 1
            made.append(grid)
            first += len(grid)
        self.node, self.branch, self.depth = node, branch, depth
        return np.concatenate(made)

    def _lookups(self, nodes: int) -> None:
        """Set what examples read by place in the head, so that it is hashed once; behind the head are OTHER and START.

        ``names`` tells all head words apart, ``common`` those of the classes.
        """
        s = self.settings
        salt = np.arange(1, 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.names = np.append(self.hashes, (OTHER, START))
        self.common = np.append(np.where(self.place >= 0, self.hashes, OTHER), (OTHER, START))
        self.target = np.append(np.where(self.place >= 0, self.place // s.per_class, s.classes), s.classes)
        self.single = [_buckets(self.names + salt[i], s.class_buckets) for i in (0, 2, 3)]
        self.mixed = [mix(self.common + salt[i]) for i in (1, 4)]
        self.group = mix(np.arange(nodes, dtype=np.uint64) + salt[5])
        self.second = self.names + salt[6]

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Place of each token in the head, or -1."""
        if not len(self.hashes):
            return np.full(len(tokens), -1)
        at = np.searchsorted(self.hashes, tokens)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == tokens, at, -1)


class Weights:
    def __init__(self, settings: Settings):
        self.classes = np.zeros((settings.class_buckets, settings.classes + 1), dtype=np.float32)
        self.words = np.zeros((2 * settings.word_buckets, settings.per_class), dtype=np.float32)


def _tokens(chunk: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's tokens with an end behind each row, and by row the index of its first."""
    starts, ends, offsets = chunk.spans(BLANKS)
    hashes = hash_spans(chunk.buffer, starts, ends, fold=True)
    with_ends = offsets + np.arange(len(offsets))
    tokens = np.full(with_ends[-1], END)
    inside = np.ones(len(tokens), dtype=bool)
    inside[with_ends[1:] - 1] = False
    tokens[inside] = hashes
    return tokens, with_ends


class Examples:
    """Features and targets of a chunk's tokens, and of the steps to each word behind its class."""

    def __init__(self, tables: Tables, tokens: np.ndarray, offsets: np.ndarray):
        s, other = tables.settings, len(tables.hashes)
        self.head = tables.find(tokens)
        at = np.where(self.head >= 0, self.head, other)
        self.target = tables.target[at]
        firsts, ends = offsets[:-1], offsets[1:]

        def before(steps: int) -> np.ndarray:
            out = np.full(len(at), other + 1)
            out[steps:] = at[:-steps]
            for step in range(steps):
                start = firsts + step
                out[start[start < ends]] = other + 1
            return out

        one, two, three = (before(i) for i in (1, 2, 3))
        self.class_features = np.stack(
            [
                tables.single[0][one],  # the word before
                _buckets(tables.mixed[0][one] + tables.common[two], s.class_buckets),  # the two words before
                tables.single[1][two],  # skip one
                tables.single[2][three],  # skip two
                _buckets(tables.mixed[1][one] + tables.common[three], s.class_buckets),  # the word before and the third before
            ],
            axis=1,
        )
        depth = tables.depth[at]
        self.first_step = np.concatenate(([0], np.cumsum(depth)))
        self.token = np.repeat(np.arange(len(tokens)), depth)
        step = at[self.token] * tables.node.shape[1] + np.arange(len(self.token)) - self.first_step[self.token]
        self.node, self.branch = tables.node.ravel()[step], tables.branch.ravel()[step]
        group = tables.group[self.node]
        self.word_features = np.stack(
            [_buckets(key[self.token] + group, s.word_buckets) for key in (tables.common[one], tables.second[two])], axis=1
        )
        self.word_features[self.node >= s.classes] += np.uint16(s.word_buckets)

    def steps(self, part: slice) -> slice:
        """The steps of a part of the tokens."""
        ends = self.first_step[[part.start, min(part.stop, len(self.target))]]
        return slice(*ends)


def _buckets(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key; ``buckets`` is a power of two of at most 2**15, as 16 bits sort fast."""
    return (mix(key) & np.uint64(buckets - 1)).astype(np.uint16)


#: Rows whose outcomes are worked on at once, so that they stay in a core's cache; the results do not depend on it.
ROWS = 1 << 11
#: Buckets with so many uses in a minibatch are summed one by one, the others together, use by use; at most 255.
MANY = 32


def _scores(weights: np.ndarray, features: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The summed weights of each row's features plus the bias, less the row's largest."""
    first, *others = np.ascontiguousarray(features.T, dtype=np.intp)
    scores = weights.take(first, axis=0)
    scores += bias
    for feature in others:
        scores += weights.take(feature, axis=0)
    scores -= np.ascontiguousarray(scores.T).max(axis=0)[:, None]
    return scores


def _totals(values: np.ndarray) -> np.ndarray:
    """The sum of each row, as a column."""
    return np.einsum("ij->i", values)[:, None]


def _slopes(
    weights: np.ndarray, features: np.ndarray, bias: np.ndarray, target: np.ndarray, nodes: np.ndarray | None = None
) -> np.ndarray:
    """The chance of every outcome, less one for the one that came; with ``nodes``, the bias is that row of ``bias``."""
    slopes = np.empty((len(target), weights.shape[1]), dtype=np.float32)
    for a in range(0, len(target), ROWS):
        part = slice(a, a + ROWS)
        chance = _scores(weights, features[part], bias if nodes is None else bias.take(nodes[part], axis=0))
        np.exp(chance, out=chance)
        np.divide(chance, _totals(chance), out=slopes[part])
    slopes[np.arange(len(target)), target] -= 1
    return slopes


def _log_softmax(scores: np.ndarray) -> np.ndarray:
    scores -= np.log(_totals(np.exp(scores)))
    return scores


def _class_scores(tables: Tables, weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    return _log_softmax(_scores(weights, features, tables.class_bias))


def _word_scores(tables: Tables, weights: np.ndarray, features: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    return _log_softmax(_scores(weights, features, tables.word_bias.take(nodes, axis=0)))


def _run_sums(slopes: np.ndarray, rows: np.ndarray, firsts: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of runs by falling length, and in it the sum of each run ``slopes[rows[first : first + uses]]``.

    Whole rows are added at a time; numpy's own sums of runs go through every column apart.
    """
    order = np.argsort(np.maximum(MANY - uses, 0).astype(np.uint8), kind="stable")
    at, n = firsts[order], uses[order]
    long = int(np.count_nonzero(n >= MANY))
    sums = np.empty((len(n), slopes.shape[1]), dtype=np.float32)
    for i in range(long):
        left, parts = int(n[i]), slopes.take(rows[at[i] : at[i] + n[i]], axis=0)
        while left > 1:  # in halves, so that sums of many stay exact
            half = left // 2
            parts[:half] += parts[left - half : left]
            left -= half
        sums[i] = parts[0]
    at, rest = at[long:], sums[long:]
    rest[:] = slopes.take(rows[at], axis=0)
    has = len(at) - np.cumsum(np.bincount(n[long:], minlength=MANY))  # runs longer than each length
    for use in range(1, MANY - 1):
        if not has[use]:
            break
        rest[: has[use]] += slopes.take(rows[at[: has[use]] + use], axis=0)
    return order, sums


def _step(weights: np.ndarray, seen: np.ndarray, features: np.ndarray, slopes: np.ndarray, rate: float) -> None:
    """Move the weights of each bucket against its summed slope; a bucket's rate falls with the root of its uses."""
    flat = features.ravel()
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    firsts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    uses = np.diff(np.append(firsts, len(flat)))
    by_uses, sums = _run_sums(slopes, order // features.shape[1], firsts, uses)
    buckets = ordered[firsts[by_uses]].astype(np.intp)
    seen[buckets] += uses[by_uses]
    sums *= (rate / features.shape[1] / np.sqrt(seen[buckets]))[:, None]
    weights[buckets] -= sums


def _learn(tables: Tables, weights: Weights, seen: tuple[np.ndarray, np.ndarray], tokens, offsets) -> None:
    s = tables.settings
    examples = Examples(tables, tokens, offsets)
    for a in range(0, len(tokens), s.minibatch):
        part = slice(a, a + s.minibatch)
        features, target = examples.class_features[part], examples.target[part]
        slopes = _slopes(weights.classes, features, tables.class_bias, target)
        _step(weights.classes, seen[0], features, slopes, s.rate)
        steps = examples.steps(part)
        if steps.stop > steps.start:
            features, branch = examples.word_features[steps], examples.branch[steps]
            slopes = _slopes(weights.words, features, tables.word_bias, branch, examples.node[steps])
            _step(weights.words, seen[1], features, slopes, s.rate)


def _flagged(docs: DataFrame, settings: Settings, text: str) -> DataFrame:
    left = F.crc32(F.col("doc_id").cast("string").cast("binary")) % settings.modulus
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(left == settings.held_out, F.lit(False)).alias("held_out"),
        F.col(text).alias("text"),
    )


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n) over the given texts; counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.unique(_tokens(chunk)[0], return_counts=True) for chunk in texts_of(batch.column(0))]
            if parts:
                tokens, same = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(same, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], names=["token", "n"])

    return texts.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, settings: Settings) -> Tables:
    """Totals, and the head: at most ``settings.head`` words, those with that share of all tokens."""
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    total = totals["total"] or 0
    head = counts.where(F.col("n") * settings.head >= total).collect()
    hashes = np.array([r["token"] for r in head], dtype=np.int64).view(np.uint64)
    return Tables(hashes, np.array([r["n"] for r in head], dtype=np.int64), total, totals["distinct"], settings)


#: Pieces of the weights that are added apart, and tasks' pieces that are added at once: sums of sums follow
#: until three levels serve FAN ** 3 tasks, so no task reads more than FAN pieces of a few hundred KB.
BLOCKS, FAN = 16, 64
MOVED = "block int, of int, n long, moved binary"


def _add(read: type):
    """Adds the pieces of one block and group; the sum belongs to the group's own group."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, dtype=read).astype(np.float64) for v in sorted(table["moved"].to_pylist()))
        of = pa.array([table["of"][0].as_py() // FAN], pa.int32())
        return pa.table({"block": table["block"][:1], "of": of, "n": [sum(table["n"].to_pylist())], "moved": [total.tobytes()]})

    return run


def train(texts: DataFrame, tables: Tables) -> Weights:
    """Weights after one pass over the training texts, cut into rounds by a hash of the row's id."""
    s, spark = tables.settings, texts.sparkSession
    weights = Weights(s)
    if not tables.total:
        return weights
    slice_of = F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(s.rounds))
    shipped_tables = spark.sparkContext.broadcast(tables)
    for round_ in range(s.rounds):
        shipped = spark.sparkContext.broadcast(weights)

        def descend(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            tables, old = shipped_tables.value, shipped.value
            mine = Weights(tables.settings)
            mine.classes[:], mine.words[:] = old.classes, old.words
            seen = tuple(np.full(len(w), tables.settings.calm, dtype=np.float32) for w in (mine.classes, mine.words))
            n = 0
            for batch in batches:
                for chunk in texts_of(batch.column(0)):
                    tokens, offsets = _tokens(chunk)
                    n += len(tokens)
                    _learn(tables, mine, seen, tokens, offsets)
            if n:
                moved = [(a - b).ravel() for a, b in ((mine.classes, old.classes), (mine.words, old.words))]
                parts = np.array_split(np.concatenate(moved) * n, BLOCKS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(np.full(BLOCKS, n)), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())],
                    names=["block", "n", "moved"],
                )

        part = texts.where(F.coalesce(slice_of, F.lit(0)) == round_).select("text")
        made = part.mapInArrow(descend, "block int, n long, moved binary")
        sums = made.withColumn("of", F.floor(F.spark_partition_id() / FAN).cast("int")).select("block", "of", "n", "moved")
        for read in (np.float32, np.float64, np.float64):
            sums = sums.groupBy("block", "of").applyInArrow(_add(read), MOVED)
        sums = sums.collect()  # one row per block and FAN ** 3 tasks
        shipped.unpersist()
        if not sums:
            continue
        moved, n = [np.float64(0)] * BLOCKS, sum(r["n"] for r in sums if not r["block"])
        for r in sorted(sums, key=lambda r: (r["block"], r["of"])):
            moved[r["block"]] = moved[r["block"]] + np.frombuffer(r["moved"])
        step = np.concatenate(moved) / n
        cut, after = weights.classes.size, Weights(s)
        after.classes[:] = weights.classes + step[:cut].reshape(weights.classes.shape)
        after.words[:] = weights.words + step[cut:].reshape(weights.words.shape)
        weights = after
    return weights


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, base_head double, score_head double, rest array<long>"


def _chances(tables: Tables, weights: Weights, examples: Examples) -> np.ndarray:
    """The log10 chance of each token; for words beyond the head that of the leaf they share."""
    chance = np.empty(len(examples.target))
    for a in range(0, len(chance), ROWS):
        part = slice(a, a + ROWS)
        target, steps = examples.target[part], examples.steps(part)
        here = _class_scores(tables, weights.classes, examples.class_features[part])[np.arange(len(target)), target].astype(np.float64)
        if steps.stop > steps.start:
            scores = _word_scores(tables, weights.words, examples.word_features[steps], examples.node[steps])
            taken = scores[np.arange(len(scores)), examples.branch[steps]]
            here += np.bincount(examples.token[steps] - a, weights=taken, minlength=len(here))
        chance[part] = here / np.log(10)
    return chance


def _score(tables: Tables, weights: Weights, chunk: Texts) -> dict:
    tokens, offsets = _tokens(chunk)
    examples = Examples(tables, tokens, offsets)
    chance = _chances(tables, weights, examples)
    head = examples.head >= 0
    ones = np.log10((tables.counts[examples.head] if len(tables.counts) else np.zeros(len(tokens))) + 1.0)
    base = np.where(head, ones, 0.0) - np.log10(tables.total + tables.distinct + 1)
    chance -= np.where(head, 0.0, np.log10(tables.open_total + tables.open_distinct + 1))
    rest = ~head
    return {
        "n_tokens": np.diff(offsets), "n_head": sums_by_row(head, offsets), "base_head": np.add.reduceat(base, offsets[:-1]),
        "score_head": np.add.reduceat(chance, offsets[:-1]),
        "rest": (tokens[rest].view(np.int64), np.concatenate(([0], np.cumsum(sums_by_row(rest, offsets))))),
    }


def score(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words, with A-Z lower-cased, and one end. A row whose id's checksum has the held-out
    remainder is not learned from; a null id is. A null text is an empty one: its only token is the end.
    Repeated rows count each time and are scored alike. Without training tokens every chance is 1 by the
    base, which then has one unseen word, and by the model. An empty table gives an empty result; other
    columns are not read. Texts of any length are scored whole, in chunks between documents.

    The base of a token seen c times among N tokens of V kinds is log10((c + 1) / (N + V + 1)).
    """
    texts = _flagged(docs, settings, text)
    learned = texts.where(~F.col("held_out"))
    counts = materialize(token_counts(learned), "token-counts")
    tables = vocabulary(counts, settings)
    weights = train(learned, tables)
    shipped = docs.sparkSession.sparkContext.broadcast((tables, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, weights = shipped.value
        for batch in batches:
            for chunk in texts_of(batch.column(3)):
                made = _score(tables, weights, chunk)
                flat, ends = made.pop("rest")
                kept = [batch.column(i).slice(chunk.first_row, chunk.rows) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *map(pa.array, made.values()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))],
                    names=[part.split()[0] for part in SCORED.split(", ")],
                )

    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    scored = materialize(numbered.mapInArrow(run, SCORED), "scored")
    rest = (
        scored.select("row", F.explode("rest").alias("token"))
        .join(counts.where(F.col("n") * settings.head < tables.total), "token")
        .groupBy("row")
        .agg(F.count("*").alias("known"), F.sum(F.log10(F.col("n") + 1.0)).alias("ones"))
    )
    ones = F.coalesce("ones", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_head") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tables.total).cast("long").alias("train_tokens"),
        (F.col("base_head") + ones).alias("base_score"),
        (F.col("score_head") + ones).alias("score"),
    )
