"""Token counts that follow edits.

A document's parts (see ``tokens``) are the leaves of a segment tree whose nodes
hold the characters and the tokens below them. An edit finds its parts by
descending the character sums, re-encodes only these and one part of context on
either side, since the characters next to a space decide whether it parts a
text, and sets the leaves anew, updating the sums above them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.arrow import batch_of, pieces
from murmur.llm.tokens import Encoder, encoder_of

#: Parts that one leaf starts with.
LEAF = 16
#: Parts in one leaf from which on the tree is built anew.
MOST_IN_LEAF = 64 * LEAF


class SegmentTree:
    """Sums of (characters, tokens) over leaves that hold runs of a text."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.first = 1 << max(0, int(len(chars) - 1).bit_length())
        levels = [np.zeros((2, self.first), np.int64)]
        levels[0][0, : len(chars)], levels[0][1, : len(tokens)] = chars, tokens
        while levels[-1].shape[1] > 1:
            levels.append(levels[-1][:, ::2] + levels[-1][:, 1::2])
        flat = np.concatenate([np.zeros((2, 1), np.int64), *reversed(levels)], axis=1)
        self.chars, self.tokens = flat[0].tolist(), flat[1].tolist()

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and the character's place in it; past the end, the last leaf with text."""
        node, at = 1, min(at, max(0, self.chars[1] - 1))
        while node < self.first:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= self.chars[node]
                node += 1
        return node - self.first, at

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.first
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2


class CountedText:
    """A text with its token count, kept up to date through edits."""

    def __init__(self, every: list[str], counts: np.ndarray, encoder: Encoder) -> None:
        self.encoder = encoder
        self.encoded = 0  # characters encoded again by edits
        self._load(every, counts)

    def _load(self, every: list[str], counts: np.ndarray) -> None:
        at = range(0, len(every), LEAF)
        self.leaves = [every[k : k + LEAF] for k in at] or [[]]
        self.counts = [counts[k : k + LEAF] for k in at] or [counts[:0]]  # tokens of each part of a leaf
        chars = np.array([sum(map(len, leaf)) for leaf in self.leaves])
        self.tree = SegmentTree(chars, np.add.reduceat(counts, list(at)) if every else np.zeros(1, np.int64))

    @property
    def tokens(self) -> int:
        return self.tree.tokens[1]

    @property
    def chars(self) -> int:
        return self.tree.chars[1]

    @property
    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def edit(self, start: int, delete: int, insert: str) -> None:
        """Put ``insert`` in the place of ``delete`` characters from ``start`` on; both stop at the text's ends.

        Whether a space parts the text depends on the characters on its two
        sides. So the leaves from two characters before the edit to the one
        behind it are encoded anew; the places where they begin and end still
        part the text.
        """
        start = min(max(start, 0), self.chars)
        delete = min(max(delete, 0), self.chars - start)
        low, at = self.tree.find(max(0, start - 2))
        high, _ = self.tree.find(start + delete)
        old = "".join(p for leaf in self.leaves[low : high + 1] for p in leaf)
        at += min(start, 2)  # where the edit begins in ``old``
        new = old[:at] + insert + old[at + delete :]
        fresh = self.encoder.parts(new)
        counts = self.encoder.counts(fresh)
        self.encoded += len(new)
        self.leaves[low], self.counts[low] = fresh, counts
        self.tree.set(low, len(new), int(counts.sum()))
        for leaf in range(low + 1, high + 1):
            if self.leaves[leaf]:
                self.leaves[leaf], self.counts[leaf] = [], counts[:0]
                self.tree.set(leaf, 0, 0)
        if len(fresh) > MOST_IN_LEAF:
            # a new tree over the counts that are there; nothing is encoded
            self._load([p for leaf in self.leaves for p in leaf], np.concatenate(self.counts))


def token_counts(docs: DataFrame, path: str, edits: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text before and after its edits.

    ``edits`` is an array of (start, n_delete, insert) for each row, applied in
    order, each to the text that the one before left; characters are code
    points. Added tokens of the file count as the tokenizer counts them. A null or negative number counts as 0, a null insert as empty, a null
    array as no edit; places beyond the end mean the end. A null text is empty.
    Returns (doc_id, n_tokens, n_edits, n_chars_edited, n_tokens_edited,
    n_chars_encoded) for every row: the last is what the edits encoded anew.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_tokens", "n_edits", "n_chars_edited", "n_tokens_edited", "n_chars_encoded"))]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for piece in pieces(batches, "text"):
            rows = []
            split = [encoder.parts(t or "") for t in piece.column("text").to_pylist()]
            counts = np.split(encoder.counts([p for every in split for p in every]), np.cumsum([len(e) for e in split])[:-1])
            for doc, every, n, todo in zip(piece.column("doc_id").to_pylist(), split, counts, piece.column("edits").to_pylist()):
                text = CountedText(every, n, encoder)
                before = text.tokens
                for e in todo or ():
                    if e is not None:
                        text.edit(e["start"] or 0, e["n_delete"] or 0, e["insert"] or "")
                rows.append((doc, before, len(todo or ()), text.chars, text.tokens, text.encoded))
            yield batch_of(schema, list(zip(*rows)))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), edits.alias("edits"))
    types = "doc_id long, n_tokens long, n_edits long, n_chars_edited long, n_tokens_edited long, n_chars_encoded long"
    return rows.mapInArrow(count, types)


def sample_edits(text: Column, source: Column) -> Column:
    """Three edits that follow from the row: a cut, a new word, and a passage in capitals."""
    n = F.length(text)
    edit = lambda start, delete, insert: F.struct(
        start.cast("long").alias("start"), delete.cast("long").alias("n_delete"), insert.alias("insert")
    )
    third = F.floor(n / 3)
    return F.array(
        edit(third, F.lit(10), F.lit("")),
        edit(F.floor(n / 2), F.lit(0), F.concat(F.lit(" "), F.coalesce(source, F.lit("")), F.lit(" "))),
        edit(F.floor(n * 3 / 4), F.lit(16), F.upper(F.coalesce(F.substring(text, 1, 16), F.lit("")))),
    )
