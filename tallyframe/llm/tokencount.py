"""Token counts with a whole-token shortcut.

A merge never joins what stands left and right of a blank that begins a new word, because no piece of
the vocabulary holds the blank mark behind another character. So a text is the sum of its pre-tokens:
a run of blanks with the word behind it. Which vocabulary strings the library encodes alone as one
token is proved once, on the driver, by asking it; those pre-tokens count 1 without merging, and only
the rest is merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Pre-tokens whose counts a worker remembers; beyond it forgets all and starts anew.
REMEMBERED = 400_000
#: Longer pre-tokens are counted but not remembered.
LONGEST_REMEMBERED = 64

_RUNS = re.compile(" *[^ ]+| +")


def whole_tokens(model: bytes) -> dict[str, int]:
    """Words that the library gives as exactly one token when they stand alone.

    Raises if the vocabulary lets a piece cross from one pre-token into the next.
    """
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    proved = {}
    candidates = []
    for i in range(library.get_piece_size()):
        piece = library.id_to_piece(i)
        if library.is_control(i) or library.is_unknown(i) or library.is_byte(i):
            continue
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {piece!r} crosses pre-tokens; the shortcut does not hold")
        if piece.startswith(MARK) and len(piece) > 1:
            candidates.append(piece[1:].replace(MARK, " "))
    for word, ids in zip(candidates, library.encode(candidates, num_threads=1)):
        if len(ids) == 1:
            proved[word] = 1
    return proved


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first blank.

    The library puts a blank before every text, and before each pre-token when it is counted alone;
    so the first one loses none and the others lose one.
    """
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] for run in _RUNS.findall(" " + text)]


class Counter:
    """Counts tokens of texts; lives in one Python worker."""

    def __init__(self, model: bytes, proved: dict[str, int]):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.proved = proved
        self.known = dict(proved)

    def _merge(self, words: list[str]) -> list[int]:
        # A lone blank is the library's own: it gives no token for an empty text, one for a blank run.
        return [
            len(ids) if word else 1
            for word, ids in zip(words, self.library.encode(words, num_threads=1))
        ]

    def count(self, text: str) -> int:
        words = pre_tokens(text)
        get = self.known.get
        found = list(map(get, words))
        if None not in found:
            return sum(found)
        missing = [word for word, n in zip(words, found) if n is None]
        counts = dict(zip(asked := list(set(missing)), self._merge(asked)))
        total = sum(n for n in found if n is not None) + sum(map(counts.__getitem__, missing))
        if len(self.known) > REMEMBERED:
            self.known = dict(self.proved)
        self.known.update((w, n) for w, n in counts.items() if len(w) <= LONGEST_REMEMBERED)
        return total


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: its ``doc_id`` with n_bytes, n_tokens and over_limit.

    A null or empty text has 0 bytes and 0 tokens. Rows with equal or null ids each get their own row;
    other columns, whatever their names, are not read. An empty table gives an empty result. A very
    long text is counted whole, pre-token by pre-token.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    shipped = docs.sparkSession.sparkContext.broadcast((model, whole_tokens(model)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shipped.value)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            tokens = [counter.count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    counted = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
