"""Operator 9: token counts by a linear longest-match automaton.

The vocabulary forms a byte trie. Every node has a failure link, to the node that is
reached after greedy longest-match has given up the pieces which the node's string
already holds, and the number of those popped pieces. One pass over a word's bytes
then adds up popped counts: no piece is built, no byte is read twice.

Words are parted by ASCII white space and matched with one leading blank, which is how
byte-level vocabularies mark the start of a word. The counts of words seen before are
kept in a bounded table per task.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words whose counts a task remembers; the table starts anew when full.
REMEMBERED = 400_000


def _byte_letters() -> dict[str, int]:
    """The public byte-level convention: printable bytes stand for themselves, others for 256 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a byte-level tokenizer file (special tokens left out)."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    special = {t["content"] for t in data.get("added_tokens", [])}
    letters = _byte_letters()
    return [bytes(letters[c] for c in token) for token in data["model"]["vocab"] if token not in special]


class Automaton:
    """Trie edges, failure links and popped-piece counts of a vocabulary."""

    def __init__(self, pieces: Iterable[bytes]):
        edges: dict[int, int] = {}
        final = {0: False}
        for piece in pieces:
            node = 0
            for byte in piece:
                node = edges.setdefault(node << 8 | byte, len(edges) + 1)
            if piece:
                final[node] = True
        count = len(edges) + 1
        self.edges = edges
        self.link = [-1] * count
        self.popped = [0] * count
        # Children were numbered after their parents, but links need order by depth.
        depth = [0] * count
        parent = {}
        for key, node in edges.items():
            parent[node] = key
            depth[node] = depth[key >> 8] + 1
        for node in sorted(parent, key=depth.__getitem__):
            above, byte = parent[node] >> 8, parent[node] & 255
            if final.get(node):
                self.link[node], self.popped[node] = 0, 1
                continue
            at, popped = self.link[above], self.popped[above]
            while at >= 0 and (at << 8 | byte) not in edges:
                popped += self.popped[at]
                at = self.link[at]
            if at >= 0:
                self.link[node], self.popped[node] = edges[at << 8 | byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of greedy longest-match over ``word``; 1 (unknown) where it cannot be covered."""
        get, link, popped = self.edges.get, self.link, self.popped
        node = total = 0
        for byte in word:
            after = get(node << 8 | byte)
            while after is None:
                if link[node] < 0:
                    return 1
                total += popped[node]
                node = link[node]
                after = get(node << 8 | byte)
            node = after
        while node:
            if link[node] < 0:
                return 1
            total += popped[node]
            node = link[node]
        return total


class _Remembered(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        found = self.automaton.count(b" " + word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_tokens`` per row; null and empty texts have none of either.

    The vocabulary file is read on the driver; the automaton, whose size its entries
    bound, is broadcast. Only the named columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(read_vocabulary(vocabulary)))
    id_type = docs.schema[id_column].dataType.simpleString()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Remembered(shared.value)
        for frame in frames:
            words, tokens = [], []
            for text in frame["__text"]:
                own = [] if text is None else text.encode("utf-8", "surrogatepass").split()
                words.append(len(own))
                tokens.append(sum(map(known.__getitem__, own)))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_words": words, "n_tokens": tokens})

    named = docs.selectExpr(f"`{id_column}` as doc_id", f"`{text_column}` as __text")
    return named.mapInPandas(count, f"doc_id {id_type}, n_words long, n_tokens long")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
