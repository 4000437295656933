"""Quality rules by distribution divergence.

Each document gives two histograms: character classes, and common words of a few languages. The
references of the languages are summed over all documents that pass the base rules. A document is
judged by the Jensen-Shannon distance of both histograms to the nearest language. Short documents
have noisy histograms, so each histogram has a least length below which it isn't judged.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.spans import BLANKS, NEWLINE, hash_spans, hash_word, mix, row_of, runs, sums_by_row, texts_of
from tallyframe.session import materialize

#: Frequent function words of each language.
COMMON_WORDS: Mapping[str, tuple[str, ...]] = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "be", "with", "as", "by", "this", "are", "from", "at"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "au", "il"),
}

SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "blank", "newline", "sentence", "symbol", "letter", "other")


def _class_table() -> np.ndarray:
    """Class of each byte; a character beyond ASCII counts by its first byte, the rest of it not at all."""
    table = np.full(256, CLASSES.index("other"))
    table[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    table[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    table[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    table[list(b" \t\v\f\r")] = CLASSES.index("blank")
    table[ord("\n")] = CLASSES.index("newline")
    table[list(b".,;:!?'\"()-")] = CLASSES.index("sentence")
    table[list(SYMBOLS)] = CLASSES.index("symbol")
    table[0xC0:] = CLASSES.index("letter")
    table[0x80:0xC0] = -1
    return table


CLASS_OF = _class_table()
_IN_WORD = ~BLANKS & (CLASS_OF >= 0)
_TO_CLASS = (CLASS_OF[:, None] == np.arange(len(CLASSES))).astype(np.int64)


@dataclass(frozen=True)
class Rules:
    """Thresholds of the verdict; distances are square roots of divergences in bits, 0 to 1."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: Least characters and words for a histogram to be judged.
    min_chars_judged: int = 200
    min_words_judged: int = 80
    #: Limits of the verdict. A histogram of n draws strays by about one over the root of n, so the
    #: limit is the first number plus the second over that root (n: characters, words).
    class_limit: tuple[float, float] = (0.10, 2.5)
    word_limit: tuple[float, float] = (0.20, 2.0)
    #: Documents nearer than this to the references of all passing documents make the final ones.
    trim_class_distance: float = 0.30
    trim_word_distance: float = 0.40
    #: Characters and words that the fixed prior counts as in every language's reference.
    prior_chars: float = 2_000.0
    prior_words: float = 400.0
    common_words: Mapping[str, Sequence[str]] = field(default_factory=lambda: COMMON_WORDS)

    @property
    def words(self) -> list[str]:
        return sorted({w for words in self.common_words.values() for w in words})


def _repeat_words(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """By row, the words inside three-word windows that occur twice or more in the row."""
    if len(hashes) < 3:
        return np.zeros(len(offsets) - 1, dtype=np.int64)
    rows = row_of(offsets)
    windows = np.flatnonzero(rows[2:] == rows[:-2])
    keys = mix(hashes[windows] + mix(hashes[windows + 1] + mix(hashes[windows + 2] + rows[windows].astype(np.uint64))))
    order, first = runs(keys)
    alone = first & np.append(first[1:], True)
    again = windows[order[~alone]]
    covered = np.zeros(len(hashes), dtype=bool)
    for step in range(3):
        covered[again + step] = True
    return sums_by_row(covered, offsets)


def _repeat_lines(chunk, word_starts: np.ndarray) -> np.ndarray:
    """By row, the lines with a word that equal an earlier line of the row."""
    starts, ends, offsets = chunk.spans(NEWLINE)
    worded = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    rows = row_of(offsets)[worded]
    hashes = hash_spans(chunk.buffer, starts, ends)[worded]
    order, first = runs(mix(hashes + mix(rows.astype(np.uint64))))
    return np.bincount(rows[order[~first]], minlength=chunk.rows)


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<int>"


def _features(column: pa.Array, places: Mapping[int, int], n_common: int) -> Iterator[dict]:
    """Counts of each chunk of rows; the last of ``common`` counts all other words."""
    known = np.array(sorted(places), dtype=np.uint64)
    place = np.array([places[int(h)] for h in known])
    for chunk in texts_of(column):
        starts, ends, offsets = chunk.spans(BLANKS)
        folded = hash_spans(chunk.buffer, starts, ends, fold=True)
        found = np.searchsorted(known, folded)
        found[found == len(known)] = 0
        at = np.where(known[found] == folded, place[found], n_common)
        common = np.bincount(row_of(offsets) * (n_common + 1) + at, minlength=chunk.rows * (n_common + 1))
        by_byte = np.stack([np.bincount(chunk.buffer[a:b], minlength=256) for a, b in zip(chunk.offsets, chunk.offsets[1:])])
        yield {
            "n_words": np.diff(offsets),
            "word_chars": by_byte[:, _IN_WORD].sum(axis=1),
            "n_symbols": by_byte[:, list(SYMBOLS)].sum(axis=1),
            "n_dup_lines": _repeat_lines(chunk, starts),
            "n_repeat_words": _repeat_words(hash_spans(chunk.buffer, starts, ends), offsets),
            "classes": by_byte @ _TO_CLASS,
            "common": common.reshape(chunk.rows, n_common + 1),
        }


def features(docs: DataFrame, rules: Rules = Rules(), keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns with the counts of each text; one pass, one row per row."""
    words = rules.words
    places = {hash_word(w, fold=True): i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for made in _features(batch.column(len(keep)), places, len(words)):
                n = len(made["n_words"])
                arrays = [batch.column(i).slice(row, n) for i in range(len(keep))]
                for name, values in made.items():
                    if values.ndim == 2:
                        ends = np.arange(n + 1, dtype=np.int32) * values.shape[1]
                        flat = pa.array(values.ravel(), pa.int64() if name == "classes" else pa.int32())
                        arrays.append(pa.ListArray.from_arrays(pa.array(ends), flat))
                    else:
                        arrays.append(pa.array(values, pa.int64()))
                row += n
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *made])

    kept = docs.select(*keep, F.col("text").alias("_text"))
    types = dict(kept.dtypes)
    return kept.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", " + FEATURES)


References = dict[str, tuple[np.ndarray, np.ndarray]]


#: Prior share of each character class in running text, and of the listed words of a language together.
PRIOR_CLASSES = (0.76, 0.02, 0.005, 0.16, 0.005, 0.03, 0.001, 0.015, 0.004)
PRIOR_COMMON = 0.35


def priors(rules: Rules) -> References:
    """What is taken for each configured language before a document is seen: fixed shares of the character
    classes, and equal shares of its listed words."""
    classes, out = np.array(PRIOR_CLASSES), {}
    for lang, listed in rules.common_words.items():
        common = np.zeros(len(rules.words) + 1)
        common[[rules.words.index(w) for w in listed]] = PRIOR_COMMON / max(1, len(listed))
        common[-1] = 1 - common.sum()
        out[lang] = (classes / classes.sum(), common)
    return out


def references(counted: DataFrame, rules: Rules = Rules()) -> References:
    """Class and word shares of each language of ``rules``: those of all given documents that pass the base rules,
    smoothed by the prior, which counts as a fixed number of characters and words at every size.

    At most one row per configured language reaches the driver.
    """
    wide, common = len(CLASSES), len(rules.words) + 1
    rows = (
        counted.where(~F.col("base_failed") & F.col("lang").isin(*rules.common_words))
        .groupBy("lang")
        .agg(
            F.array(*[F.sum(F.col("classes")[i]) for i in range(wide)]).alias("classes"),
            F.array(*[F.sum(F.col("common")[i]) for i in range(common)]).alias("common"),
        )
        .collect()
    )
    seen = {r["lang"]: (np.array(r["classes"], dtype=float), np.array(r["common"], dtype=float)) for r in rows}
    known = {}
    for lang, before in sorted(priors(rules).items()):
        smoothed = [w * p + c for w, p, c in zip((rules.prior_chars, rules.prior_words), before, seen.get(lang, (0, 0)))]
        known[lang] = tuple(s / s.sum() for s in smoothed)
    return known


def _distance(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to the nearest row of shares; 1 for empty counts."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    nearest = np.ones(len(p))
    for q in shares:
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
            right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
        nearest = np.minimum(nearest, np.sqrt(np.clip((left + right) / 2, 0, 1)))
    return nearest


def distances(counted: DataFrame, known: References, rules: Rules = Rules(), lang: str = "lang") -> DataFrame:
    """``counted`` with ``class_distance`` and ``word_distance``, null where too short or without references.

    A language that has no reference isn't judged by those of others; an unknown one is, by the nearest.
    """
    classes = np.array([c for c, _ in known.values()])
    common = np.array([w for _, w in known.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            named = dict(zip(batch.schema.names, batch.columns))
            foreign = np.array([x is not None and x not in known for x in named[lang].to_pylist()])
            for name, of, shares, least in (
                ("class_distance", "classes", classes, rules.min_chars_judged),
                ("word_distance", "common", common, rules.min_words_judged),
            ):
                counts = np.asarray(named[of].flatten()).reshape(batch.num_rows, -1)
                unjudged = (counts.sum(axis=1) < least) | foreign | (not known)
                named[name] = pa.array(_distance(counts, shares), pa.float64(), mask=unjudged)
            yield pa.RecordBatch.from_pydict(named)

    schema = ", ".join(f"`{c}` {t}" for c, t in counted.dtypes)
    return counted.mapInArrow(run, f"{schema}, class_distance double, word_distance double")


def _near(class_limit: Column | float, word_limit: Column | float) -> Column:
    return (F.coalesce("class_distance", F.lit(0.0)) <= class_limit) & (
        F.coalesce("word_distance", F.lit(0.0)) <= word_limit
    )


def counted(docs: DataFrame, rules: Rules, keep: Sequence[str]) -> DataFrame:
    """The kept columns, the counts of each text and ``base_failed``."""
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    return features(docs, rules, keep).withColumn("base_failed", failed)


def learn(counts: DataFrame, rules: Rules = Rules()) -> References:
    """References of the languages from all counted documents; ``counts`` is read twice and has ``lang``."""
    first = distances(counts, references(counts, rules), rules)
    # Junk widens a reference, so the second references come from documents near the first ones.
    trimmed = first.where(_near(rules.trim_class_distance, rules.trim_word_distance))
    return references(trimmed.drop("class_distance", "word_distance"), rules)


def verdicts(counts: DataFrame, known: References, rules: Rules = Rules(), lang: str = "lang") -> DataFrame:
    """``counts`` with both distances and ``kept`` in place of the histograms."""
    measured = distances(counts, known, rules, lang)
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    limit = lambda pair, n: pair[0] + pair[1] / F.sqrt(F.greatest(n, F.lit(1)))
    kept = ~F.col("base_failed") & _near(limit(rules.class_limit, chars), limit(rules.word_limit, F.col("n_words")))
    return measured.withColumn("kept", kept).drop("classes", "common")


def judge(docs: DataFrame, rules: Rules = Rules(), keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, the counts, ``base_failed``, ``class_distance``, ``word_distance`` and ``kept``.

    A document fails the base with fewer than 50 words, or with more than half its words in repeated
    three-word windows. It is kept if it passes and neither judged distance is beyond its limit.
    Distances are null where the text is too short to judge or its language has no reference; then the
    base alone decides. A null text has no words and fails. A null ``lang`` is judged by the nearest
    language, and adds to no reference. Each row, repeated or not, gets its own
    verdict; an empty table gives an empty result; columns other than those named are not read.
    """
    keep = list(keep)
    with_lang = keep if "lang" in keep else [*keep, "lang"]
    counts = materialize(counted(docs, rules, with_lang), "quality")
    judged = verdicts(counts, learn(counts, rules), rules)
    return judged if "lang" in keep else judged.drop("lang")


def good_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns and no others.

    Texts are counted twice, once for the references and once for the verdict, instead of being copied
    or shuffled. A column of ``docs`` that has the name of a count is safe.
    """
    known = learn(materialize(counted(docs, rules, ["lang"]), "quality"), rules)
    names = docs.columns
    plain = [f"_c{i}" for i in range(len(names))]
    renamed = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(names, plain)], F.col("text"))
    kept = verdicts(counted(renamed, rules, plain), known, rules, plain[names.index("lang")]).where("kept")
    return kept.select(*[F.col(p).alias(c) for c, p in zip(names, plain)])
