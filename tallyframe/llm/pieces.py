"""Sampled segmentations of texts into vocabulary pieces, and their lossless decoding.

All segmentations of a text into pieces form a lattice. A forward pass gives each position the total
weight of all ways to reach it; a backward pass then draws pieces from the end, each with its share of
that weight. Draws depend on the seed, the row's key and the position in the text only, so a row
has the same segmentation in every run and on every machine.

No piece crosses from a word into the blank behind it, so the lattice falls into one part per blank run
with its word; equal parts of a chunk share one forward pass. Characters without a piece of their own
are spelled in byte pieces. The blank mark of the vocabulary stands for a blank only: where a text holds
that character itself it is spelled in bytes, which is what keeps decoding lossless.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.spans import Texts, hash_spans, mix, texts_of

MARK = "▁"
SEGMENT_BYTES = 1 << 20
BLANK = 0x20


class Vocabulary:
    """Pieces as byte strings with log weights, and a trie over them."""

    def __init__(self, model: bytes, power: float):
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = library.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = np.full(256, -1, dtype=np.int32)
        ranks = np.zeros(n)
        plain = []
        for i in range(n):
            piece = library.id_to_piece(i)
            if library.is_control(i) or library.is_unknown(i):
                continue
            if library.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of[i] = bytes([value])
                continue
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} crosses words")
            self.bytes_of[i] = piece.replace(MARK, " ").encode()
            ranks[i] = -library.get_score(i)
            plain.append(i)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces; decoding could lose characters")
        # A merge vocabulary has ranks, not chances; weights fall with a power of the rank.
        weights = -power * np.log(2.0 + ranks)
        self.log_weight = weights - np.log(np.exp(weights[plain]).sum())
        self.log_weight[self.byte_ids] = self.log_weight[plain].min()
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for i in plain:
            node = 0
            for byte in self.bytes_of[i]:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][byte]
            ends[node] = i
        # Node 0 is the root and, as a child, none.
        self.next = np.zeros((len(children), 256), dtype=np.uint16 if len(children) < 1 << 16 else np.int32)
        for node, found in enumerate(children):
            for byte, child in found.items():
                self.next[node, byte] = child
        self.end = np.array(ends, dtype=np.int32)
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)


@lru_cache(maxsize=2)
def vocabulary(model: bytes, power: float) -> Vocabulary:
    return Vocabulary(model, power)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start .. start + count - 1 of each range, one after the other."""
    shift = np.cumsum(counts) - counts
    return np.repeat(starts - shift, counts) + np.arange(counts.sum())


def _char_lengths(data: np.ndarray) -> np.ndarray:
    """By byte the length of the character that it leads; 0 inside a character."""
    return np.select([data < 0x80, data < 0xC0, data < 0xE0, data < 0xF0], [1, 0, 2, 3], 4)


class Lattice:
    """The lattices of some words laid end to end: edges by the position behind them, with their chances."""

    def __init__(self, words: Vocabulary, data: np.ndarray, starts: np.ndarray):
        n = len(data)
        place = np.arange(n)
        word_start = np.repeat(starts, np.diff(np.append(starts, n)))
        word_end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        lengths = _char_lengths(data)
        spelled = np.ones(n, dtype=bool)  # characters without a piece, by their leading byte
        sources, ends, ids = [], [], []
        alive, node = place[lengths > 0], np.zeros((lengths > 0).sum(), dtype=np.int64)
        length = 0
        while len(alive):
            node = words.next[node, data[alive + length]].astype(np.int64)
            length += 1
            found = node > 0
            alive, node = alive[found], node[found]
            piece = words.end[node]
            whole = piece >= 0
            sources.append(alive[whole])
            ends.append(alive[whole] + length)
            ids.append(piece[whole])
            spelled[alive[whole][lengths[alive[whole]] == length]] = False
            inside = alive + length < word_end[alive]
            alive, node = alive[inside], node[inside]
        leading = np.maximum.accumulate(np.where(lengths > 0, place, 0))
        loose = np.flatnonzero(spelled[leading])
        sources.append(loose)
        ends.append(loose + 1)
        ids.append(words.byte_ids[data[loose]])
        source, end, piece = (np.concatenate(x) for x in (sources, ends, ids))
        order = np.argsort(end, kind="stable")
        self.source, self.piece = source[order], piece[order]
        self.count = np.bincount(end, minlength=n + 1)
        self.first = np.cumsum(self.count) - self.count
        # Positions are numbered by the byte before them; words share no position that way.
        total = np.zeros(n + 1)  # log weight of all ways to the position behind byte i - 1
        weight = words.log_weight[self.piece]
        self.below = np.empty(len(weight))
        offset = place - word_start
        behind = np.argsort(offset, kind="stable") if offset.max(initial=0) > 65535 else np.argsort(offset.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(offset[behind], np.arange(offset.max(initial=-1) + 2))
        for a, b in zip(cuts, cuts[1:]):
            at = behind[a:b] + 1
            counts = self.count[at]
            at, counts = at[counts > 0], counts[counts > 0]
            if not len(at):
                continue
            edges = _ranges(self.first[at], counts)
            from_start = self.source[edges] == word_start[np.repeat(at, counts) - 1]
            ways = np.where(from_start, 0.0, total[self.source[edges]]) + weight[edges]
            firsts = np.cumsum(counts) - counts
            top = np.maximum.reduceat(ways, firsts)
            shares = np.exp(ways - np.repeat(top, counts))
            sums = np.add.reduceat(shares, firsts)
            total[at] = top + np.log(sums)
            run = np.cumsum(shares)
            before = np.repeat(run[firsts] - shares[firsts], counts)
            self.below[edges] = (run - before) / np.repeat(sums, counts)

    def draw(self, position: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """For each position one of the edges that end there, by its share."""
        edge = self.first[position]
        last = edge + self.count[position] - 1
        open_ = np.flatnonzero((self.below[edge] < chance) & (edge < last))
        while len(open_):
            edge[open_] += 1
            open_ = open_[(self.below[edge[open_]] < chance[open_]) & (edge[open_] < last[open_])]
        return edge


def _segment(words: Vocabulary, data: np.ndarray, starts: np.ndarray, row_seed: np.ndarray, row_place: np.ndarray):
    """Pieces of the units that begin at ``starts`` in ``data``, and their number by unit."""
    ends = np.append(starts[1:], len(data))
    _, chosen, same = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    lengths = (ends - starts)[chosen]
    lattice_starts = np.cumsum(lengths) - lengths
    lattice = Lattice(words, data[_ranges(starts[chosen], lengths)], lattice_starts)
    origin = lattice_starts[same]
    at = origin + (ends - starts)
    unit = np.arange(len(starts))
    drawn_units, drawn_pieces = [], []
    while len(unit):
        place = row_place[unit] + (at - origin[unit])
        bits = mix(row_seed[unit] + mix(place.astype(np.uint64)))
        edge = lattice.draw(at, (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        drawn_units.append(unit)
        drawn_pieces.append(lattice.piece[edge])
        at = lattice.source[edge]
        going = at > origin[unit]
        unit, at = unit[going], at[going]
    who = np.concatenate(drawn_units)
    counts = np.bincount(who, minlength=len(starts))
    # The step at which a piece was drawn counts from the unit's end.
    step = np.concatenate([np.full(len(u), i) for i, u in enumerate(drawn_units)])
    out = np.empty(len(who), dtype=np.int32)
    out[(np.cumsum(counts) - 1)[who] - step] = np.concatenate(drawn_pieces)
    return out, counts


def _encode(words: Vocabulary, chunk: Texts, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of a chunk's rows, and by row the index of its first piece."""
    sizes = np.diff(chunk.offsets)
    full = sizes > 0
    # Each text gets a blank in front, as the vocabulary asks for.
    offsets = np.concatenate(([0], np.cumsum(sizes + full)))
    data = np.full(offsets[-1], BLANK, dtype=np.uint8)
    data[_ranges(offsets[:-1] + full, sizes)] = chunk.buffer
    blank = data == BLANK
    begins = np.zeros(len(data), dtype=bool)
    begins[1:] = blank[1:] & ~blank[:-1]
    begins[offsets[:-1][full]] = True
    starts = np.flatnonzero(begins)
    row = np.searchsorted(offsets, starts, "right") - 1
    seeds = mix(keys.view(np.uint64) + mix(np.array([seed], dtype=np.uint64)))[row]
    pieces, counts, first = [], [], 0
    while first < len(starts):
        base = starts[first]
        last = max(int(np.searchsorted(starts, base + SEGMENT_BYTES)), first + 1)
        stop = starts[last] if last < len(starts) else len(data)
        part = slice(first, last)
        ids, n = _segment(words, data[base:stop], starts[part] - base, seeds[part], starts[part] - offsets[row[part]])
        pieces.append(ids)
        counts.append(n)
        first = last
    if not pieces:
        return np.zeros(0, dtype=np.int32), np.zeros(chunk.rows + 1, dtype=np.int64)
    per_row = np.bincount(row, weights=np.concatenate(counts), minlength=chunk.rows).astype(np.int64)
    return np.concatenate(pieces), np.concatenate(([0], np.cumsum(per_row)))


def _decode(words: Vocabulary, ids: np.ndarray) -> np.ndarray:
    return words.flat[_ranges(words.starts[ids], words.lengths[ids])]


def encode(
    docs: DataFrame, model_path: str, seed: int = 1, power: float = 1.0, key: str = "doc_id", text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The kept columns with ``pieces`` (ids), ``n_pieces`` and ``lossless`` (decoding gave the text back).

    A null text has null pieces, 0 of them, and is lossless; an empty one has an empty list. A null key
    counts as 0. Equal rows have equal segmentations; an empty table gives an empty result; other columns
    are not read. Long texts are segmented whole, in parts of bounded size; memory grows only with the
    longest run of bytes without a blank. ``power`` sharpens the weights of frequent pieces. A kept column
    that has the name of a result comes back with ``input_`` in front; other names are safe.
    """
    made = ("pieces", "n_pieces", "lossless")
    names: list[str] = []
    for name in keep:
        while name in made or name in names:
            name = f"input_{name}"
        names.append(name)
    plain = [f"_c{i}" for i in range(len(keep))]
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model.value, power)
        for batch in batches:
            keys = batch.column(len(keep)).fill_null(0).to_numpy()
            column = batch.column(len(keep) + 1)
            missing = column.is_null()
            for chunk in texts_of(column, SEGMENT_BYTES):
                rows = slice(chunk.first_row, chunk.first_row + chunk.rows)
                ids, offsets = _encode(words, chunk, keys[rows], seed)
                lossless = _lossless(words, chunk, ids, offsets)
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32)), pa.array(ids), mask=missing.slice(chunk.first_row, chunk.rows)
                )
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(chunk.first_row, chunk.rows) for c in batch.columns[: len(keep)]], lists,
                     pa.array(np.diff(offsets)), pa.array(lossless)],
                    names=[*plain, *made],
                )

    kept = [F.col(f"`{c}`").alias(p) for c, p in zip(keep, plain)]
    read = docs.select(*kept, F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    types = dict(read.dtypes)
    schema = "".join(f"{c} {types[c]}, " for c in plain) + "pieces array<int>, n_pieces long, lossless boolean"
    return read.mapInArrow(run, schema).toDF(*names, *made)


def _lossless(words: Vocabulary, chunk: Texts, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    decoded = _decode(words, ids)
    ends = np.concatenate(([0], np.cumsum(words.lengths[ids])))[offsets]
    sizes = np.diff(chunk.offsets)
    right = np.diff(ends) == sizes + (sizes > 0)
    if not right.all():  # compare row by row only where lengths agree
        return np.array([
            ok and bytes(decoded[a:b][1:]) == bytes(chunk.buffer[c:d])
            for ok, a, b, c, d in zip(right, ends, ends[1:], chunk.offsets, chunk.offsets[1:])
        ], dtype=bool)
    full = sizes > 0
    body = decoded[_ranges(ends[:-1] + full, sizes)]
    wrong = np.concatenate(([0], np.cumsum(body != chunk.buffer)))
    return np.diff(wrong[chunk.offsets]) == 0


def decode(encoded: DataFrame, model_path: str, out: str = "text") -> DataFrame:
    """``encoded`` with its ``pieces`` replaced by the text that they spell; null for null pieces.

    An empty list spells the empty text. All other columns come back, but for one that has the name of
    the result; equal rows stay rows of their own; an empty table gives an empty result.
    """
    with open(model_path, "rb") as file:
        model = encoded.sparkSession.sparkContext.broadcast(file.read())
    others = [c for c in encoded.columns if c not in ("pieces", out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model.value, 1.0)
        for batch in batches:
            texts = [
                None if not v.is_valid else _decode(words, v.values.to_numpy()).tobytes()[1:].decode()
                for v in batch.column(len(others))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*others, out])

    read = encoded.select(*others, "pieces")
    types = dict(read.dtypes)
    return read.mapInArrow(run, "".join(f"`{c}` {types[c]}, " for c in others) + f"`{out}` string")
