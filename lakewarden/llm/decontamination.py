"""Operator 5: benchmark decontamination by an FM-index per training shard.

A shard is a run of rows of one partition with about ``shard_bytes`` of text. Its
words become symbols, and a full suffix array, the BWT, a wavelet matrix with rank
counts and every 16th suffix position make its FM-index. All benchmark windows are
searched backwards at once; occurrences are located by walking to the next sampled
position; overlapping occurrences merge to removal spans. Words that no benchmark
item holds become separators (no window spans them), and equal texts of a shard
are indexed once.

Nothing is shuffled. The benchmark reaches the tasks as broadcast blocks of at most
``block_bytes`` of text; a larger one takes more passes, each with its own block and
written before the next.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lakewarden.llm.shared import absent, appended, quoted, written

WINDOW = 10
SAMPLE = 16
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20

#: Lower-cases A-Z and turns every byte outside ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` to a blank.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | bytes | None) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return data.translate(_FOLD).split()


class Phrases:
    """The different windows of benchmark items over a vocabulary of their words (symbols from 2 on).

    Item texts are held once, as symbols one after the other; a window is a start and a
    length in them. Equal windows are searched once: ``owners`` lists the items of each.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids: list[str] = []
        self.vocab: dict[bytes, int] = {}
        codes = array("i")
        start, size, owner = array("q"), array("i"), array("i")
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            first, n = len(codes), min(window, len(words))
            codes.extend(self.vocab.setdefault(w, len(self.vocab) + 2) for w in words)
            count = len(words) - n + 1
            start.extend(range(first, first + count))
            size.extend([n] * count)
            owner.extend([len(self.ids)] * count)
            self.ids.append("" if item is None else str(item))
        self.codes = np.array(codes, np.int32)
        starts, sizes, owners = np.array(start, np.int64), np.array(size, np.int32), np.array(owner, np.int32)
        # By length: starts of the different windows, and their items as runs of ``owners``.
        self.windows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            first, place = self._different(starts[own], n)
            pairs = np.unique(place.astype(np.int64) * max(1, len(self.ids)) + owners[own])
            held = pairs // max(1, len(self.ids))
            bounds = np.searchsorted(held, np.arange(len(first) + 1))
            self.windows.append((n, starts[own][first], bounds, (pairs % max(1, len(self.ids))).astype(np.int32)))

    def _different(self, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first of each different window, and each window's number among them (exact, by doubling ranks)."""
        rank = self.codes[starts].astype(np.int64)
        for k in range(1, size):
            pair = rank * (len(self.vocab) + 2) + self.codes[starts + k]
            rank = np.unique(pair, return_inverse=True)[1]
        _, first, place = np.unique(rank, return_index=True, return_inverse=True)
        return first, place

    def symbols(self, starts: np.ndarray, offset: int) -> np.ndarray:
        """The windows' symbols at ``offset``."""
        return self.codes[starts + offset]


def suffix_array(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling over unresolved groups only."""
    n = len(symbols)
    packed = max(1, 62 // bits)
    padded = np.concatenate((symbols, np.zeros(packed, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(packed):
        key = (key << bits) | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    slot = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, slot, 0))
    step = packed
    while True:
        last = np.concatenate((head[1:], [True]))
        open_slots = np.flatnonzero(~(head & last))
        if not len(open_slots):
            return order
        at = order[open_slots]
        after = at + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        both = rank[at] * (n + 1) + second
        perm = np.argsort(both, kind="stable")
        both, at = both[perm], at[perm]
        order[open_slots] = at
        fresh = np.concatenate(([True], both[1:] != both[:-1]))
        head[open_slots] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, open_slots, 0))
        step *= 2


class FMIndex:
    """Backward search and location over one shard's symbols (the last must be 0, the only one)."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        n = len(symbols)
        order = suffix_array(symbols, self.bits)
        self.bwt = symbols[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=alphabet))))
        marked = order % SAMPLE == 0
        self.marked = marked
        self.mark_rank = np.cumsum(marked) - 1
        self.sampled = order[marked]
        # Wavelet matrix, most significant bit first: running counts of zeros at each level.
        self.zeros, level = [], self.bwt.astype(np.int32)
        for bit in range(self.bits - 1, -1, -1):
            ones = (level >> bit) & 1 == 1
            count = np.zeros(n + 1, np.int32)
            np.cumsum(~ones, out=count[1:])
            self.zeros.append(count)
            level = np.concatenate((level[~ones], level[ones]))
        self.base = self._descend(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for depth, zeros in enumerate(self.zeros):
            ones = (symbol >> (self.bits - 1 - depth)) & 1 == 1
            kept = zeros[at]
            at = np.where(ones, zeros[-1] + at - kept, kept)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows before ``at`` whose suffix follows ``symbol``, as rows of the longer suffix."""
        return self.before[symbol] + self._descend(symbol, at) - self.base[symbol]

    def search(self, phrases: Phrases, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(window, low, high)`` of the windows that occur; their rows are low..high-1."""
        own = np.arange(len(starts))
        low = np.zeros(len(starts), np.int64)
        high = np.full(len(starts), len(self.bwt), np.int64)
        for offset in range(size - 1, -1, -1):
            symbol = phrases.symbols(starts[own], offset)
            low, high = self.step(symbol, low), self.step(symbol, high)
            live = low < high
            own, low, high = own[live], low[live], high[live]
        return own, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        place = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows, 0
        while len(todo):
            done = self.marked[at]
            place[todo[done]] = self.sampled[self.mark_rank[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            at = self.step(self.bwt[at], at)
            steps += 1
        return place


def _ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``low[i], ..., low[i] + size[i] - 1`` one after the other."""
    return np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def find_in_shard(texts: list[str | bytes | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """Of every text: its words, merged spans of hit words, and the items (by number) that hit."""
    split: dict[str | bytes | None, int] = {}
    codes, counts = [], []
    get = phrases.vocab.get
    for text in texts:
        if text not in split:
            split[text] = len(counts)
            words = words_of(text)
            counts.append(len(words))
            codes.append(np.array([get(w, 1) for w in words], np.int64))
            codes.append(np.ones(1, np.int64))  # parts the texts
    first = np.concatenate(([0], np.cumsum(np.array(counts, np.int64) + 1)))
    symbols = np.concatenate([*codes, np.zeros(1, np.int64)])
    known = symbols > 1
    keep = known | np.concatenate(([True], known[:-1]))
    keep[-1] = True
    origin = np.flatnonzero(keep)
    spans: list[list[tuple[int, int]]] = [[] for _ in counts]
    items: list[list[int]] = [[] for _ in counts]
    if known.any():
        index = FMIndex(symbols[origin], len(phrases.vocab) + 2)
        cover = np.zeros(len(symbols) + 1, np.int64)
        pairs = []
        for length, starts, bounds, owners in phrases.windows:
            own, low, high = index.search(phrases, starts, length)
            if not len(own):
                continue
            size = high - low
            start = origin[index.locate(_ranges(low, size))]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + length, -1)
            # Which windows a text holds, once each, and only then whose they are.
            text = np.searchsorted(first, start, side="right") - 1
            held = np.unique(text * len(starts) + np.repeat(own, size))
            text, window = held // len(starts), held % len(starts)
            many = bounds[window + 1] - bounds[window]
            pairs.append(np.unique(np.repeat(text, many) * len(phrases.ids) + owners[_ranges(bounds[window], many)]))
        if pairs:
            hit = np.concatenate(([False], np.cumsum(cover) > 0, [False]))
            edges = np.flatnonzero(hit[1:] != hit[:-1])
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                i = int(np.searchsorted(first, a, side="right")) - 1
                spans[i].append((a - int(first[i]), b - int(first[i])))
            for pair in np.unique(np.concatenate(pairs)).tolist():
                items[pair // len(phrases.ids)].append(pair % len(phrases.ids))
    found = list(zip(counts, spans, items, strict=True))
    return [found[split[text]] for text in texts]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def _shards(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Runs ``(first, last)`` of texts with at most about ``limit`` bytes, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        own = len(text or b"")
        if i > start and size + own > limit:
            yield start, i
            start, size = i, 0
        size += own
    if start < len(texts):
        yield start, len(texts)


def _blocks(benchmark: DataFrame, item_column: str, text_column: str, block_bytes: int) -> Iterator[list]:
    """The benchmark in blocks, streamed by partition: the driver holds one block at a time."""
    held, size = [], 0
    for item, text in benchmark.select(F.col(item_column).cast("string"), F.col(text_column)).toLocalIterator():
        held.append((item, text))
        size += len(text or "")
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


_SPANS = ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType())]))


def mark_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
    names: tuple[str, str, str] = ("words", "spans", "items"),
) -> DataFrame:
    """``docs`` with three columns added: word count, merged hit spans, and the ids of the items that hit.

    A text that is null has no words; an item without words occurs nowhere. Equal
    item ids count once. Rows and other columns stay as they are; a column that is already
    called as one of ``names`` is replaced. An empty benchmark marks nothing, an empty table
    has an empty result. A benchmark of several blocks takes a written pass for each.
    """
    spark = docs.sparkSession
    docs = docs.drop(*names)
    fields = [StructField(n, t) for n, t in zip(names, (LongType(), _SPANS, ArrayType(StringType())), strict=True)]
    shared = None
    for block in _blocks(benchmark, item_column, item_text_column, block_bytes):
        if shared is not None:
            docs = written(_one_pass(docs, shared, text_column, fields, shard_bytes), "decontamination-pass")
        shared = spark.sparkContext.broadcast(Phrases(block, window))
    return _one_pass(docs, shared or spark.sparkContext.broadcast(Phrases([], window)), text_column, fields, shard_bytes)


def _one_pass(docs: DataFrame, shared, text_column: str, fields: list[StructField], shard_bytes: int) -> DataFrame:
    """Adds ``fields`` by one block of phrases, to what an earlier pass has found."""
    names = [f.name for f in fields]
    before = names[0] in docs.columns
    if before:
        old = [absent(docs, f"__old_{i}") for i in range(2)]
        docs = docs.select(
            *[F.col(quoted(c)) for c in docs.columns if c not in names],
            F.to_json(names[1]).alias(old[0]),
            F.to_json(names[2]).alias(old[1]),
        )

    def make():
        phrases = shared.value

        def compute(texts, *earlier):
            found = [row for a, b in _shards(texts, shard_bytes) for row in find_in_shard(texts[a:b], phrases)]
            spans = [list(own) for _, own, _ in found]
            items = [{phrases.ids[i] for i in own} for _, _, own in found]
            if earlier:
                for i, (old_spans, old_items) in enumerate(zip(*earlier, strict=True)):
                    spans[i] += [(s["a"], s["b"]) for s in json.loads(old_spans)]
                    items[i].update(json.loads(old_items))
            return [n for n, _, _ in found], [[{"a": a, "b": b} for a, b in merge_spans(s)] for s in spans], [sorted(i) for i in items]

        return compute

    marked = appended(docs, [text_column, *(old if before else [])], fields, make)
    return marked.drop(*old) if before else marked


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns as they were."""
    names = tuple(absent(docs, n) for n in ("__words", "__spans", "__items"))
    marked = mark_contaminated(docs, benchmark, names=names, **options)
    return marked.where(F.size(names[1]) == 0).drop(*names)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = mark_contaminated(docs, benchmark)
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["b"] - s["a"])
    return marked.select(
        "doc_id",
        F.col("words").alias("n_words"),
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )
