"""Operator 7: toxicity by class-conditional Kneser-Ney bigram models.

Two models, toxic and ordinary, give each word its probability after the word before it.
The top level is an interpolated bigram level over *different texts*: a bigram counts once for
each different text of a class that holds it, so exact copies add nothing. What its
discounts leave goes to continuation counts (the number of different words a word follows
in the class), these back off to the word's stem (its first ``STEM`` characters), and
stems to continuation counts that both classes share. An expression that is rare in one
class is so smoothed by the same shared mass in both. Discounts of each level and class
are estimated from its counts of counts, ``n1 / (n1 + 2 n2)``; bigrams of fewer than
``CUTOFF`` texts leave all their mass to the backoff.

A document's features are length-normalised log-likelihood differences: the mean over the
whole text, and the largest mean over any stretch of ``STRETCHES`` words, under the bigram
model and under its lower order alone. A logistic calibration turns them into a score.

A word is named by 64 bits, half of them its stem's, and a bigram by both words' names.

Counting: tasks list the bigrams of all different labelled training texts, a shuffle sums
them over the corpus, and sums by word, by history and by stem come from that table.
Only differences between the two classes are used to score, and only those are kept which
matter: an entry whose difference from what its backoff would give, times its count, is
under ``PRUNE`` is left to the backoff (weighted-difference pruning). The model grows with the
labelled corpus; it is broadcast in blocks of at most ``BLOCK_ENTRIES`` entries by the
word's hash, one pass over the texts each, so no task or driver holds more than a block.

Training rows are split by ``crc32(doc_id as text) mod 5``: 0 is held out, 1 to 3 are
counted and 4 calibrates (at most about ``CALIBRATION_ROWS`` rows, chosen by hash).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField

from lakewarden.llm.shared import absent, appended, one_row_each, row_key, written
from lakewarden.llm.words import Words, chunks

STEM = 4
CALIBRATION_ROWS = 20_000
#: Labelled ids up to which they are broadcast to the documents; more are joined by a shuffle.
BROADCAST_LABELS = 500_000
#: Bigrams of fewer different texts, both classes together, are left to the lower order.
CUTOFF = 3
#: Least count times difference for which an entry of the model is kept.
PRUNE = 15.0
#: Lengths in words of the stretches whose largest mean difference is a feature.
STRETCHES = (1, 2, 3, 8)
#: Entries of 12 bytes that are broadcast at once.
BLOCK_ENTRIES = 8_000_000
CLASSES = ("bad", "good")
FEATURES = 2 * (1 + len(STRETCHES)) + 1

_U = np.uint64
_WORDLIKE = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
#: Words whose bigrams a task holds before it hands them on.
_BUFFER = 250_000


def word_ids(words: Words) -> np.ndarray:
    """64-bit names of words: the upper half is a hash of the stem, the lower half one of the whole word."""
    stem = words.hash_of(words.start, words.prefix_end(STEM))
    return (stem >> _U(32) << _U(32)) | (words.hash >> _U(32))


def _before(words: Words, own: np.ndarray) -> np.ndarray:
    """The hash of the word before each word; a text's first word follows 0."""
    before = np.zeros_like(own)
    before[1:] = own[:-1]
    before[words.first[:-1][np.diff(words.first) > 0]] = 0
    return before


def _pair_keys(own: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One key for a word and the one before it; ``_pair_key`` is its SQL form."""
    own, before = own.view(_U), before.view(_U)
    return (before ^ (own << _U(1)) ^ (own >> _U(63))).view(np.int64)


def _pair_key(own: str, before: str) -> Column:
    turned = F.shiftleft(F.col(own), 1).bitwiseXOR(F.shiftrightunsigned(F.col(own), 63))
    return F.col(before).bitwiseXOR(turned)


def _count_bigrams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bigrams ``own, before`` with the number of texts of each class that hold them (``bad, good``)."""

    def counted(parts):
        own, before, text, toxic = (np.concatenate(p) for p in zip(*parts, strict=True))
        key = _pair_keys(own, before)
        order = np.lexsort((text, key))
        key, text = key[order], text[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        once = new | np.concatenate(([True], text[1:] != text[:-1]))  # one of each text
        place = np.cumsum(new) - 1
        bad = np.bincount(place, weights=once & toxic[order], minlength=place[-1] + 1)
        good = np.bincount(place, weights=once & ~toxic[order], minlength=place[-1] + 1)
        first = order[new]
        ids = {"own": own[first].view(np.int64), "before": before[first].view(np.int64)}
        return pd.DataFrame(ids | {"bad": bad.astype(np.int64), "good": good.astype(np.int64)})

    parts, size, seen = [], 0, 0
    for frame in frames:
        labels = frame["toxic"].to_numpy()
        for first, texts in chunks(frame["text"]):
            words = Words(texts, wordlike=_WORDLIKE)
            own, lengths = word_ids(words), np.diff(words.first)
            toxic = np.repeat(labels[first : first + len(texts)] > 0, lengths)
            number = np.repeat(np.arange(seen, seen + len(texts), dtype=np.int32), lengths)
            parts.append((own, _before(words, own), number, toxic))
            seen += len(texts)
            size += len(own)
            if size > _BUFFER:
                yield counted(parts)
                parts, size = [], 0
    if size:
        yield counted(parts)


def discount_of(ones: float, twos: float) -> float:
    """The estimate from counts of counts, kept off 0 and 1 where either is missing."""
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


def _discounts(table: DataFrame, columns: list[str]) -> list[float]:
    """One discount for each count column."""
    row = table.agg(*[F.count(F.when(F.col(c) == k, 1)).alias(f"{c}_{k}") for c in columns for k in (1, 2)]).first()
    return [discount_of(row[f"{c}_1"], row[f"{c}_2"]) for c in columns]


def _over(count: Column, discount: float) -> Column:
    return F.greatest(count - F.lit(discount), F.lit(0.0))


def word_probabilities(table: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """The lower order of both classes from continuation counts ``own, bad, good``.

    Returns words (``own, p_bad, p_good, count, d_stem``), stems (``stem, diff, count``) and
    the difference of a word whose stem neither class has. ``d_stem`` is the difference
    that the word has by its stem alone.
    """
    table = table.withColumn("stem", F.shiftrightunsigned("own", 32))
    sums = [F.sum(c).alias(f"s_{c}") for c in CLASSES]
    d_word = _discounts(table, list(CLASSES))
    left = [F.sum(F.least(F.col(c).cast("double"), F.lit(d_word[k]))).alias(f"l_{c}") for k, c in enumerate(CLASSES)]
    stems = written(table.groupBy("stem").agg(*sums, *left), "toxicity-stems")
    d_stem = _discounts(stems, [f"s_{c}" for c in CLASSES])
    ends = [F.sum(f"s_{c}").alias(f"t_{c}") for c in CLASSES]
    ends += [F.sum(F.least(F.col(f"s_{c}").cast("double"), F.lit(d_stem[k]))).alias(f"r_{c}") for k, c in enumerate(CLASSES)]
    t = stems.agg(F.count(F.lit(1)).alias("n"), *ends).first().asDict()
    total, rest = [float(t[f"t_{c}"] or 0) for c in CLASSES], [float(t[f"r_{c}"] or 0) for c in CLASSES]
    every = F.col("s_bad") + F.col("s_good")
    shared = (every + 0.5) / (sum(total) + 0.5 * (t["n"] + 1))
    share = [(_over(F.col(f"s_{c}"), d_stem[k]) + rest[k] * shared) / total[k] if total[k] else shared for k, c in enumerate(CLASSES)]
    # What a stem leaves to the words that the class has not seen with it.
    spare = [F.when(F.col(f"s_{c}") > 0, F.col(f"l_{c}") / F.col(f"s_{c}")).otherwise(1.0) for c in CLASSES]
    by_stem = F.log(share[0] * spare[0]) - F.log(share[1] * spare[1])
    choice = (F.col("bad") + F.col("good") + 0.5) / (every + 1)
    inside = [_over(F.col(c), d_word[k]) / F.greatest(F.col(f"s_{c}"), F.lit(1)) + spare[k] * choice for k, c in enumerate(CLASSES)]
    words = table.join(stems, "stem").select(
        "own",
        (share[0] * inside[0]).alias("p_bad"),
        (share[1] * inside[1]).alias("p_good"),
        (F.col("bad") + F.col("good")).alias("count"),
        by_stem.alias("d_stem"),
    )
    other = [np.log(rest[k] / total[k]) if total[k] else 0.0 for k in range(2)]
    return words, stems.select("stem", by_stem.alias("diff"), every.alias("count")), float(other[0] - other[1])


def bigram_differences(pairs: DataFrame, words: DataFrame, discounts: list[float]) -> tuple[DataFrame, DataFrame]:
    """``own, before, diff, lower, count`` of frequent bigrams, and ``before, weight`` of their histories.

    ``diff`` is log P(own | before, toxic) - log P(own | before, ordinary), ``lower`` what the
    backoff would give; a history's ``weight`` is the difference of its two backoff shares.
    """
    histories = pairs.groupBy("before").agg(*[F.sum(c).alias(f"h_{c}") for c in CLASSES])
    often = written(pairs.where(F.col("bad") + F.col("good") >= CUTOFF), "toxicity-bigrams")
    used = often.groupBy("before").agg(*[F.sum(_over(F.col(c), discounts[k])).alias(f"u_{c}") for k, c in enumerate(CLASSES)])
    share = [F.when(F.col(f"h_{c}") > 0, 1 - F.col(f"u_{c}") / F.col(f"h_{c}")).otherwise(1.0).alias(f"b_{c}") for c in CLASSES]
    histories = written(used.join(histories, "before").select("before", *[f"h_{c}" for c in CLASSES], *share), "toxicity-histories")
    p = [
        _over(F.col(c), discounts[k]) / F.greatest(F.col(f"h_{c}"), F.lit(1)) + F.col(f"b_{c}") * F.col(f"p_{c}") for k, c in enumerate(CLASSES)
    ]
    weight = F.log("b_bad") - F.log("b_good")
    joined = often.join(words.select("own", "p_bad", "p_good"), "own").join(histories, "before")
    bigrams = joined.select(
        "own",
        "before",
        (F.log(p[0]) - F.log(p[1])).alias("diff"),
        (weight + F.log("p_bad") - F.log("p_good")).alias("lower"),
        (F.col("bad") + F.col("good")).alias("count"),
    )
    return bigrams, histories.select("before", weight.alias("weight"), (F.col("h_bad") + F.col("h_good")).alias("count"))


WORD, PAIR, HISTORY, STEM_KIND = range(4)


class Block:
    """The entries of some words, sorted by key for look-ups: keys and differences of each kind."""

    def __init__(self, table, number: int, blocks: int, other: float):
        """``table``: Arrow table of ``kind, key, diff``; ``other``: the difference of words without an entry."""
        self.number, self.blocks, self.other = number, blocks, other
        kind, key, diff = (table[c].to_numpy() for c in ("kind", "key", "diff"))
        self.tables = []
        for k in range(4):
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(key[own])]
            self.tables.append((key[own], diff[own]))

    def look_up(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """The keys' differences, NaN for those that the table does not hold."""
        known, diff = self.tables[kind]
        if not len(known):
            return np.full(len(keys), np.nan, np.float32)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, diff[at], np.float32(np.nan))

    def evidence(self, words: Words, held: np.ndarray | None = None) -> np.ndarray:
        """Of every word its difference alone, that of its bigram and its weight as a history; NaN where there
        is no entry. Only the words of this block are filled in."""
        own = word_ids(words)
        out = np.full((3, len(own)), np.nan, np.float32) if held is None else held
        mine = np.flatnonzero((own >> _U(1)) % _U(self.blocks) == self.number)
        keys = own[mine].view(np.int64)
        word = self.look_up(WORD, keys)
        rare = np.flatnonzero(np.isnan(word))
        word[rare] = self.look_up(STEM_KIND, (own[mine[rare]] >> _U(32)).view(np.int64))
        out[0, mine] = word
        out[1, mine] = self.look_up(PAIR, _pair_keys(own, _before(words, own))[mine])
        out[2, mine] = self.look_up(HISTORY, keys)
        return out


class Model:
    """A written table ``kind, key, diff, word`` of all entries that are kept, and the calibration."""

    def __init__(self, entries: DataFrame, blocks: int, other: float):
        self.entries, self.blocks, self.other = entries, blocks, other
        self.weights = np.zeros(1 + FEATURES)

    def block(self, number: int) -> Block:
        own = F.shiftrightunsigned(F.col("word"), 1) % F.lit(self.blocks) == number
        rows = self.entries.where(own | (F.col("kind") == STEM_KIND)).select("kind", "key", "diff")
        return Block(rows.toArrow(), number, self.blocks, self.other)


def model_differences(other: float, words: Words, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word log P(word | toxic) - log P(word | ordinary): after the word before it, and alone."""
    word = np.where(np.isnan(evidence[0]), np.float32(other), evidence[0]).astype(np.float64)
    weight = np.zeros(len(word))
    weight[1:] = np.nan_to_num(evidence[2, :-1])
    weight[words.first[:-1][np.diff(words.first) > 0]] = 0
    return np.where(np.isnan(evidence[1]), word + weight, evidence[1]), word


def features(differences: tuple[np.ndarray, np.ndarray], words: Words) -> np.ndarray:
    """Per text, under both models: mean difference and best stretch means; and the log length. Zeros without words."""
    out = np.zeros((len(words.first) - 1, FEATURES))
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if a == b:
            continue
        row = []
        for diff in differences:
            own = diff[a:b]
            sums = np.concatenate(([0.0], np.cumsum(own)))
            row.append(sums[-1] / len(own))
            for size in STRETCHES:
                k = min(size, len(own))
                row.append(((sums[k:] - sums[:-k]) / k).max())
        out[i] = *row, np.log(b - a)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (intercept, slopes on standardised columns folded back) by damped Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack((np.ones(len(x)), (x - mean) / scale))
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[1:] / scale
    return np.concatenate(([w[0] - slopes @ mean], slopes))


def probability(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))


def fold(id_column: str, folds: int):
    return F.crc32(F.encode(F.coalesce(F.col(id_column).cast("string"), F.lit("")), "UTF-8")) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, text, <label>`` of documents with a label; ids with clashing labels take the larger."""
    own = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
    if labels.count() <= BROADCAST_LABELS:
        own = F.broadcast(own)
    return docs.select("doc_id", "text").join(own, "doc_id")


def different_texts(known: DataFrame, docs: DataFrame) -> DataFrame:
    """``text, toxic``: every different text of ``known`` once, read from ``docs``, toxic if any of its rows is."""
    row = F.xxhash64("doc_id", "text").alias("row")
    rows = known.select(row, F.md5("text").alias("own"), "toxic").groupBy("own", "row").agg(F.count(F.lit(1)).alias("n"), F.max("toxic").alias("toxic"))
    rows = rows.groupBy("own").agg(F.min(F.struct("row", "n")).alias("r"), F.max("toxic").alias("toxic"))
    rows = written(rows.select("r.row", "r.n", "toxic"), "toxicity-texts")
    if rows.count() <= BROADCAST_LABELS:
        rows = F.broadcast(rows)
    return one_row_each(docs.select(row, "text"), "row", rows).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit both models and the calibration; without training labels every score is the prior 0.1."""
    counted, calibrating = fold("doc_id", 5).isin(1, 2, 3), fold("doc_id", 5) == 4
    known = labelled(docs.where(counted), labels.where(counted), "toxic").where("text is not null")
    texts = different_texts(known, docs.where(counted))
    pairs = texts.mapInPandas(_count_bigrams, "own long, before long, bad long, good long")
    pairs = written(pairs.groupBy("own", "before").agg(*[F.sum(c).alias(c) for c in CLASSES]), "toxicity-pairs")
    table = pairs.groupBy("own").agg(*[F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in CLASSES])

    words, stems, other = word_probabilities(written(table, "toxicity-words"))
    words = written(words, "toxicity-lower")
    bigrams, histories = bigram_differences(pairs, words, _discounts(pairs, list(CLASSES)))
    alone = F.log("p_bad") - F.log("p_good")

    def entries(kind: int, rows: DataFrame, word: str, key: Column, diff: Column, backoff: Column) -> DataFrame:
        kept = rows.where(F.abs(diff - backoff) * F.col("count") >= PRUNE)
        return kept.select(F.lit(kind).cast("byte").alias("kind"), key.alias("key"), diff.cast("float").alias("diff"), F.col(word).alias("word"))

    kept = entries(WORD, words, "own", F.col("own"), alone, F.col("d_stem"))
    kept = kept.unionByName(entries(PAIR, bigrams, "own", _pair_key("own", "before"), F.col("diff"), F.col("lower")))
    kept = kept.unionByName(entries(HISTORY, histories, "before", F.col("before"), F.col("weight"), F.lit(0.0)))
    kept = written(kept.unionByName(entries(STEM_KIND, stems, "stem", F.col("stem"), F.col("diff"), F.lit(other))), "toxicity-model")
    model = Model(kept, max(1, -(-kept.count() // BLOCK_ENTRIES)), other)

    labels = labels.where(calibrating)
    share = min(1.0, CALIBRATION_ROWS / max(1, labels.count()))
    chosen = calibrating & ((F.abs(F.xxhash64("doc_id")) % 1_000_000) < F.lit(round(share * 1_000_000)))
    calibrate = labelled(docs.where(chosen), labels.where(chosen), "toxic")
    names = [f"x{i}" for i in range(FEATURES)]
    sample = _measured(calibrate.select("text", "toxic"), "text", model, [StructField(n, DoubleType()) for n in names], lambda x: list(x.T))
    sample = sample.select("toxic", *names).toPandas()
    x, y = sample[names].to_numpy(float), sample["toxic"].to_numpy(float)
    if len(y) and 0 < y.mean() < 1:
        model.weights = fit_logistic(x, y)
    else:
        model.weights = np.concatenate(([np.log(0.1 / 0.9)], np.zeros(FEATURES)))
    return model


def _measured(docs: DataFrame, text_column: str, model: Model, new: list[StructField], finish) -> DataFrame:
    """``docs`` with columns that ``finish`` makes of the texts' features; one pass for each block of the model."""
    context, held = docs.sparkSession.sparkContext, None
    for number in range(model.blocks):
        shared = context.broadcast(model.block(number))
        last, before = number == model.blocks - 1, held

        def make(shared=shared, last=last):
            block = shared.value

            def compute(texts, known=None):
                found = []
                for first, part in chunks(texts):
                    words = Words(part, wordlike=_WORDLIKE)
                    old = None
                    if known is not None:
                        old = np.concatenate([np.frombuffer(k, np.float32).reshape(3, -1) for k in known[first : first + len(part)]], axis=1)
                    evidence = block.evidence(words, old)
                    if last:
                        found.append(features(model_differences(block.other, words, evidence), words))
                    else:
                        found.extend(evidence[:, a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True))
                if not last:
                    return [found]
                return finish(np.concatenate(found) if found else np.zeros((0, FEATURES)))

            return compute

        read = [text_column] if before is None else [text_column, before]
        if last:
            docs = appended(docs, read, new, make)
        else:
            held = absent(docs, "__evidence")
            docs = written(appended(docs, read, [StructField(held, BinaryType())], make), "toxicity-pass")
        if before is not None:
            docs = docs.drop(before)
    return docs


def score_toxicity(docs: DataFrame, model: Model, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with a score in (0, 1) added, all rows and other columns kept as they are.

    Null and empty texts have the score of a text without evidence. Only the text
    is read for a score, so equal texts have equal scores, whatever the other columns
    hold. A column that is already called ``score_column`` is replaced. An empty table
    has an empty result.
    """
    weights = model.weights
    docs = docs.drop(score_column)
    return _measured(docs, text_column, model, [StructField(score_column, DoubleType())], lambda x: [probability(weights, x)])


def crc_fold(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
