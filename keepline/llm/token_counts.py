"""Word-piece lengths of texts by a linear longest-match automaton.

The vocabulary is a trie. Where a word leaves the trie, a failure link leads to the node of what is
left after the pieces that greedy matching takes; how many pieces that pops is stored with the
link. Each byte of a word is read once, and no piece is ever built.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepline.llm.common import field, type_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_NODES = 5_000_000
REMEMBERED = 1 << 18
LONG = 64


class Automaton:
    """Greedy longest-match counting; `inner` marks pieces that go on a word, as "##" does.

    Without a mark every piece may stand anywhere. A word that can't be cut into pieces counts 1.
    """

    def __init__(self, pieces: Iterable[bytes], inner: bytes = b"", most_nodes: int = MOST_NODES) -> None:
        step: dict[int, int] = {}
        parent, label = [-1], [0]

        def path(key: bytes) -> int:
            at = 0
            for c in key:
                to = step.get(at << 8 | c)
                if to is None:
                    to = step[at << 8 | c] = len(parent)
                    parent.append(at)
                    label.append(c)
                at = to
            if len(parent) > most_nodes:
                raise ValueError(f"the vocabulary's trie has over {most_nodes} nodes")
            return at

        self.inner = path(inner)
        whole = {path(p) for p in pieces if p and p != inner}
        below: dict[int, list[int]] = {}
        for v in range(1, len(parent)):
            below.setdefault(parent[v], []).append(v)
        fail, pops = [-1] * len(parent), [0] * len(parent)
        marked, at = {0, self.inner}, self.inner
        while at > 0:  # nodes of the mark alone are no part of a word
            marked.add(at)
            at = parent[at]
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for v in below.get(u, []):
                todo.append(v)
                if v in marked:
                    continue
                if v in whole:
                    fail[v], pops[v] = self.inner, 1
                    continue
                z, popped = fail[u], 0
                while z >= 0 and (z << 8 | label[v]) not in step:
                    popped += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = step[z << 8 | label[v]], pops[u] + popped
        self.step, self.fail, self.pops = step, fail, pops

    @classmethod
    def of(cls, state: dict) -> Automaton:
        """An automaton from what vars() gave of another."""
        made = cls.__new__(cls)
        vars(made).update(state)
        return made

    def count(self, word: bytes) -> int:
        """Pieces of one word."""
        step, fail, pops = self.step, self.fail, self.pops
        at, n = 0, 0
        for c in word:
            to = step.get(at << 8 | c)
            while to is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 1
                to = step.get(at << 8 | c)
            at = to
        while at > 0 and at != self.inner:
            n += pops[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


class Remembered(dict):
    """Counts of the words seen; starts anew when full, so memory stays bounded."""

    def __init__(self, automaton: Automaton, before: bytes, after: bytes) -> None:
        self.automaton, self.before, self.after = automaton, before, after

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.before + word + self.after)
        if len(word) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a file with one base64 piece and its rank per line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def token_counts(
    docs: DataFrame,
    pieces: list[bytes],
    id_col: str = "doc_id",
    text_col: str = "text",
    inner: bytes = b"",
    before: bytes = b" ",
    after: bytes = b"",
) -> DataFrame:
    """(id, n_words, n_tokens), one row per row of docs.

    Words are cut at ASCII white space; each, with `before` and `after` added, is matched greedily
    against the pieces. Null and empty texts have neither words nor tokens; repeated rows and null
    ids are counted like others. The vocabulary, of bounded size, is read on the driver and broadcast.
    No rows give no rows; only the two columns are looked at; a text of any length is counted whole. Of
    pieces that match at one place the longest is taken, so ties don't arise.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(Automaton(pieces, inner)))
    schema = T.StructType(
        [field(id_col, type_of(docs, id_col)), field("n_words", T.LongType()), field("n_tokens", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(Automaton.of(shared.value), before, after)
        for batch in batches:
            n_words, n_tokens = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for i, text in enumerate(batch.column(1)):
                words = (text.as_py() or b"").split()
                n_words[i] = len(words)
                n_tokens[i] = sum(map(known.__getitem__, words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_tokens)], schema.names
            )

    return docs.select(docs[id_col], F.col(text_col).cast("binary")).mapInArrow(run, schema)
