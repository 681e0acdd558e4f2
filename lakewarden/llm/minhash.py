r"""Operator 3: MinHash near-duplicates with tensored banding.

A document's set holds the 64-bit hashes of its word shingles. Table keys are made by
tensoring: ``LEFT`` sketches of ``LEFT_HASHES`` minhashes and ``RIGHT`` sketches of
``RIGHT_HASHES`` minhashes give one table for each pair of sketches, 80 tables of five
minhashes from 46 minhash computations instead of 400. Two texts meet in some table
exactly when they agree in one left and in one right sketch.

Every table bucket has a hub: its member with the most bucket mates. Only links from
members to hubs are formed (linear in the bucket), and all are confirmed on full sets.
Where a bucket's members then still lie in several components, pairs that could link
are compared block by block inside tasks, which return only links that join something:

* members in the hub's component need no comparison with one another;
* others meet those of them that link with the hub itself only if the hub's distance
  allows it (Jaccard distance is a metric), and those that chains lead to in any case;
* no block, and so no task, holds more than about ``BLOCK`` members.

Documents with equal sets are one node throughout (a 64-bit name of the set; a second name
finds the few sets that share one by chance, which then get new names), so copies cost a
small row each. Components come from repeated contraction, each round a
table in the shared folder; the driver sees only counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from lakewarden.llm.shared import absent, appended, drop_written, quoted, row_key, written
from lakewarden.llm.words import Words, chunks, mix64, shingles

LEFT, LEFT_HASHES = 8, 2
RIGHT, RIGHT_HASHES = 10, 3
BLOCK = 512

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_MULTIPLIERS = mix64(np.arange(1, LEFT * LEFT_HASHES + RIGHT * RIGHT_HASHES + 1, dtype=_U) * _GOLD) | _U(1)


def minhashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of minhashes for each non-empty set ``values[bounds[i]:bounds[i + 1]]``."""
    out = np.empty((len(bounds) - 1, len(_MULTIPLIERS)), _U)
    for k, multiplier in enumerate(_MULTIPLIERS):
        scaled = values * multiplier
        scaled ^= scaled >> _U(29)
        out[:, k] = np.minimum.reduceat(scaled, bounds[:-1])
    return out


def _combined(hashes: np.ndarray, sketches: int, each: int) -> np.ndarray:
    parts = hashes.reshape(len(hashes), sketches, each)
    key = np.zeros(parts.shape[:2], _U)
    for k in range(each):
        key = mix64(key * _GOLD + parts[:, :, k])
    return key.view(np.int64)


def fingerprints(values: np.ndarray, bounds: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit name for each set: a scrambled sum over scrambled members and the size."""
    salt = mix64(np.full(1, seed, _U) + _GOLD)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(mix64(values ^ salt), dtype=_U)))
    size = np.diff(bounds).astype(_U)
    return mix64(sums[bounds[1:]] - sums[bounds[:-1]] + size * _GOLD).view(np.int64)


_LONGS = ArrayType(LongType())
_SKETCH = [StructField(c, LongType()) for c in ("n_shingles", "node", "other")] + [StructField(c, _LONGS) for c in "ab"]


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with ``n_shingles, node, other, a, b`` in the place of ``__text``.

    ``node`` and ``other`` are two independent names of the set; a document without words has none.
    """

    def make():
        def compute(texts):
            sizes, nodes, others, left, right = [], [], [], [], []
            for _, part in chunks(texts):
                values, bounds = shingles(Words(part), words)
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                own = [np.full(len(part), None, object) for _ in range(4)]
                if len(full):
                    starts = np.concatenate((bounds[full], bounds[-1:]))
                    hashes, cut = minhashes(values, starts), LEFT * LEFT_HASHES
                    own[0][full], own[1][full] = fingerprints(values, starts), fingerprints(values, starts, 1)
                    tables = (_combined(hashes[:, :cut], LEFT, LEFT_HASHES), _combined(hashes[:, cut:], RIGHT, RIGHT_HASHES))
                    for column, table in zip(own[2:], tables, strict=True):
                        for i, row in zip(full.tolist(), table, strict=True):
                            column[i] = row
                sizes.extend(size.tolist())
                for column, more in zip((nodes, others, left, right), own, strict=True):
                    column.extend(more)
            return sizes, nodes, others, left, right

        return compute

    return appended(docs, ["__text"], _SKETCH, make, give_back=False)


def told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with new names for the nodes that two different sets share by chance (of n sets n * n / 2**65)."""
    names = rows.where("node is not null").groupBy("node").agg(F.min("other").alias("least"), F.max("other").alias("most"))
    shared = names.where("least <> most").select(F.col("node").alias("shared"))
    if shared.isEmpty():
        return rows
    joined = rows.join(shared, F.col("node") == F.col("shared"), "left")
    return joined.withColumn("node", F.when(F.col("shared").isNull(), F.col("node")).otherwise(F.xxhash64("node", "other"))).drop("shared")


def _table_keys(nodes: DataFrame) -> DataFrame:
    left = nodes.select("node", F.posexplode("a").alias("i", "x"), "b")
    both = left.select("node", "i", "x", F.posexplode("b").alias("j", "y"))
    return both.select(F.xxhash64("i", "j", "x", "y").alias("key"), "node")


def hub_edges(nodes: DataFrame) -> DataFrame:
    """``node, hub`` for every member of every bucket of two or more."""
    keys = _table_keys(nodes)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(keys.join(shared, "key"), "minhash-buckets")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = members.join(degree, "node").select("key", "node", "degree")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("top"))
    hubs = hubs.select("key", F.col("top.node").alias("hub"))
    edges = members.select("key", "node").join(hubs, "key").where("node <> hub").select("node", "hub").distinct()
    edges = written(edges, "minhash-edges")
    drop_written(members)
    return edges


def _sets(texts, words: int) -> list[np.ndarray]:
    out = []
    for _, part in chunks(texts):
        values, bounds = shingles(Words(part), words)
        out.extend(values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    return out


def confirm(edges: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``node, hub, both, n_node, n_hub``: exact intersection and set sizes of each edge.

    A hub's members are dealt to blocks of about ``BLOCK``, so a large group is no one task's;
    the hub's text goes once to each block, ahead of the members' in the block's order.
    """
    sizes = edges.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    dealt = edges.join(sizes, "hub").select("node", "hub", _block_of("node", F.col("n")).alias("block"))
    members = dealt.join(texts, "node").select("hub", "block", F.lit(1).alias("place"), "node", "text")
    heads = sizes.join(texts.withColumnRenamed("node", "hub"), "hub").select(
        "hub", F.explode(F.sequence(F.lit(0), _blocks(F.col("n")) - 1)).alias("block"), F.lit(0).alias("place"), F.col("hub").alias("node"), "text"
    )
    rows = members.unionByName(heads).repartition("hub", "block").sortWithinPartitions("hub", "block", "place")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.zeros(0, _U)
        for frame in frames:
            found = []
            for own, name, hub, place in zip(
                _sets(frame["text"], words), frame["node"].tolist(), frame["hub"].tolist(), frame["place"].tolist(), strict=True
            ):
                if place == 0:
                    known = own
                    continue
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                found.append((name, hub, int((known[at] == own).sum()), len(own), len(known)))
            yield pd.DataFrame(found, columns=["node", "hub", "both", "n_node", "n_hub"], dtype="int64")

    return rows.mapInPandas(run, "node long, hub long, both long, n_node long, n_hub long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``), one root a component.

    Each round every node points to the neighbour (or itself) that comes first in an
    order made by hashing, edges are redrawn between the pointed-to nodes, and inner
    ones vanish. A constant share of the nodes goes each round in expectation.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    root = None
    rounds = 0
    while not edges.isEmpty():
        rounds += 1

        def place(c, turn=rounds):
            return F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))

        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(place("b")).alias("m"))
        nearest = nearest.select(F.col("a").alias("node"), F.least(place("a"), F.col("m")).getField("v").alias("to"))
        nearest = written(nearest, "cc-links")
        ends = [nearest.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab"]
        moved = edges.join(ends[0], "a").join(ends[1], "b").where("to_a <> to_b")
        moved = moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        if root is None:
            root = nearest.select("node", F.col("to").alias("root"))
        else:
            step = nearest.select(F.col("node").alias("root"), "to")
            root = written(root.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "cc-roots")
        edges = written(moved, "cc-edges")
    if root is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return root


def _blocks(count, size: int = BLOCK):
    return F.greatest(F.ceil(count / F.lit(size)), F.lit(1)).cast("int")


def _block_of(node: str, count):
    return F.pmod(F.xxhash64(F.lit("block"), F.col(node)), _blocks(count)).cast("int")


def leftover_links(measured: DataFrame, roots: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b``: links (by root) among bucket mates whose components still differ."""
    near = (percent + percent - 100) / 100 - 1e-9  # a hub similarity below it rules out all mates that link with the hub itself
    known = roots.select(F.col("node"), "root")
    members = (
        measured.select("hub", "node", (F.col("both") / (F.col("n_node") + F.col("n_hub") - F.col("both"))).alias("like"))
        .join(known, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .join(known.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left")
        .withColumn("hub_root", F.coalesce("hub_root", "hub"))
    )
    inner = F.col("root") == F.col("hub_root")
    close = ~inner & (F.col("like") >= near)
    # The hub's distance says nothing of members that only a chain of links joins to it.
    direct = inner & (F.col("like") >= percent / 100 - 1e-9)
    chained = inner & ~direct
    sizes = members.groupBy("hub").agg(
        F.count(F.when(direct, 1)).alias("n_direct"),
        F.count(F.when(chained, 1)).alias("n_chained"),
        F.count(F.when(~inner, 1)).alias("n_outer"),
        F.count(F.when(close, 1)).alias("n_close"),
    )
    # An outer member alone has only the hub's component to meet: chained members, and direct ones if close.
    sizes = sizes.where("n_outer > 1 or (n_close > 0 and n_direct > 0) or (n_outer > 0 and n_chained > 0)")
    members = written(members.join(sizes, "hub"), "minhash-open")
    if members.isEmpty():
        return members.select(F.col("root").alias("a"), F.col("root").alias("b"))

    own = _block_of("node", F.col("n_outer"))
    every = F.sequence(F.lit(0), _blocks(F.col("n_outer")) - 1)
    outer = members.where(~inner & (F.col("n_outer") > 1)).select(
        "hub", "node", "root", own.alias("own"), F.explode(every).alias("other"), F.lit("outer").alias("kind"), F.lit(True).alias("asks")
    )
    outer = outer.select("hub", "node", "root", "kind", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "asks")

    def met(kind: str, who, n_who: str, mates, n_mates: str) -> list[DataFrame]:
        """Every one of ``who`` beside every one of ``mates``, block by block."""
        sides = [(who, n_who, n_mates, True), (mates, n_mates, n_who, False)]
        out = []
        for side, n_own, n_other, asks in sides:
            at, over = ("x", "y") if asks else ("y", "x")
            out.append(
                members.where(side & (F.col(n_other) > 0)).select(
                    "hub",
                    "node",
                    "root",
                    F.lit(kind).alias("kind"),
                    _block_of("node", F.col(n_own)).alias(at),
                    F.explode(F.sequence(F.lit(0), _blocks(F.col(n_other)) - 1)).alias(over),
                    F.lit(asks).alias("asks"),
                )
            )
        return out

    asked = [*met("direct", close, "n_close", direct, "n_direct"), *met("chained", ~inner, "n_outer", chained, "n_chained")]

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["asks", "node"], ascending=[False, True], ignore_index=True)
        sets = _sets(frame["text"], words)
        size = np.array([len(s) for s in sets])
        bounds = np.concatenate(([0], np.cumsum(size)))
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        mark = np.zeros(codes.max() + 1, np.int32)
        roots, asks = frame["root"].to_numpy(), frame["asks"].to_numpy()
        label = np.unique(roots, return_inverse=True)[1]  # merged as links appear
        found = []
        for i in np.flatnonzero(asks).tolist():
            if (label == label[i]).all():
                continue
            mark[codes[bounds[i] : bounds[i + 1]]] = 1
            both = np.add.reduceat(mark[codes], bounds[:-1])
            mark[codes[bounds[i] : bounds[i + 1]]] = 0
            union = size + size[i] - both
            for k in np.flatnonzero((100 * both >= percent * union) & (label != label[i])).tolist():
                if label[k] != label[i]:
                    found.append((roots[i], roots[k]))
                    label[label == label[k]] = label[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    columns = ["hub", "node", "root", "kind", "x", "y", "asks"]
    tasks = outer.select(columns)
    for more in asked:
        tasks = tasks.unionByName(more.select(columns))
    return tasks.join(texts, "node").groupBy("hub", "kind", "x", "y").applyInPandas(compare, "a long, b long")


def _placed(docs: DataFrame, words: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, row, n_shingles, root`` per input row, written: rows of one root are one group; without words it is null.

    ``row`` is a key of the row's id and text.
    """
    key = row_key(F.col(quoted(id_column)), F.col(quoted(text_column)))
    own = docs.select(F.col(quoted(id_column)).alias("doc_id"), key.alias("row"), F.col(quoted(text_column)).alias("__text"))
    rows = told_apart(written(sketch(own, words), "minhash-sketches"))
    nodes = rows.where("node is not null").dropDuplicates(["node"]).select("node", "a", "b")
    edges = hub_edges(nodes)
    wanted = edges.select("node").union(edges.select(F.col("hub").alias("node"))).distinct()
    first = rows.groupBy("node").agg(F.min("row").alias("row")).join(wanted, "node")
    texts = own.join(first, "row").select("node", F.col("__text").alias("text"))
    texts = written(texts.dropDuplicates(["node"]), "minhash-texts")

    measured = written(confirm(edges, texts, words), "minhash-measured")
    linked = 100 * F.col("both") >= percent * (F.col("n_node") + F.col("n_hub") - F.col("both"))
    roots = components(measured.where(linked).select(F.col("node").alias("a"), F.col("hub").alias("b")))
    more = written(leftover_links(measured, roots, texts, words, percent), "minhash-more")
    drop_written(texts)
    above = components(more)
    step = above.select(F.col("node").alias("root"), F.col("root").alias("top"))
    # A node without links of its own may still be named by a leftover link.
    named = roots.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = above.join(roots, "node", "left_anti").select("node", "root")
    final = named.unionByName(alone).dropDuplicates(["node"])
    placed = rows.select("doc_id", "row", "n_shingles", "node").join(final, "node", "left")
    return written(placed.withColumn("root", F.coalesce("root", "node")).drop("node"), "minhash-placed")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per input row.

    Words are maximal runs without ASCII white space, A-Z lower-cased; a document with
    fewer than ``words`` words has its whole sequence as one shingle, and one without
    words (or null) links with nothing. Documents link where the shingle sets' Jaccard
    similarity is at least ``percent`` in a hundred; ``component_id`` is the smallest id
    reachable by links, null only where all ids of the component are. ``kept`` says that the
    id is the component's, so rows that repeat that id (or lack one alike) are all kept here;
    ``one_of_each_group`` keeps one row. Rows with equal sets are in one component. An
    empty table has an empty result; other columns are not read.
    """
    placed = _placed(docs, words, percent, id_column, text_column).drop("row")
    smallest = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.lit(True).alias("grouped"))
    out = placed.join(smallest, "root", "left")
    out = out.withColumn("component_id", F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each_group(
    docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all its columns as they were.

    It is the row of the smallest id (null ids last; ties by a key of the text); of rows
    equal in id and text any one. Rows without words are in no group and all stay.
    """
    placed = _placed(docs, words, percent, id_column, text_column).where("root is not null")
    keys = written(placed.groupBy("root", "row").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")), "minhash-rows")
    first = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    chosen = keys.join(first, "root").withColumn("kept", F.col("first.row") == F.col("row"))
    chosen = written(chosen.select("row", "n", "kept"), "minhash-chosen")
    key = absent(docs, "__row")
    keyed = docs.withColumn(key, row_key(F.col(quoted(id_column)), F.col(quoted(text_column))))
    renamed = chosen.withColumnRenamed("row", key)
    # Whatever is not removed stays, so the smaller table is joined.
    again = renamed.where("kept and n > 1").select(key)
    out = keyed.join(renamed.where("not kept or n > 1").select(key), key, "left_anti")
    if not again.isEmpty():
        out = out.unionByName(keyed.join(again, key, "left_semi").dropDuplicates([key]))
    return out.select([quoted(c) for c in docs.columns])


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, words=3, percent=85)
