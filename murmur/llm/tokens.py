"""Token ids of whole texts, with a public tokenizer file named by its path.

The file is one of the ``tokenizers`` library. Texts of the usual characters are
encoded by ``tiktoken`` with the ranks that the file holds, which gives the same
ids in a fraction of the time; others go to ``tokenizers`` itself, as the two
libraries may know different letters of rare scripts.

A text is split into parts before each single space between two other
characters. Byte-level BPE never joins across such a place, so the ids of a text
are those of its parts, and the count of a part can be kept and reused.

The file's added tokens, such as an end mark, are found in texts as the library
finds them: a text that holds one goes to ``tokenizers``. They stand within a
part, unless the file has one that holds white space or takes some beside it;
then texts are not split.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

# A space that stands between two characters that no rule takes for white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"^\s|\s\s|\s$|[^\S ]")
# Characters beyond Latin, Greek, Cyrillic and general punctuation.
_RARE = re.compile(r"[^\u0000-\u052f\u2000-\u2064]")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts whose counts a Python worker keeps; the store starts anew beyond it.
MOST_PARTS = 500_000


def parts(text: str) -> list[str]:
    """The text in parts; all but the first begin with the space before them."""
    split = _CUT.split(text) if _ODD.search(text) else text.split(" ")
    return [split[0], *[" " + p for p in split[1:]]] if text else []


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """The encoder of a Python worker, kept from task to task."""
    return Encoder(path)


class Encoder:
    """Ids of texts, and counts of parts, by the tokenizer in a file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.fast = _same_ranks(path)
        with open(path, encoding="utf-8") as file:
            added = json.load(file).get("added_tokens") or []
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)")
        #: Whether an added token may reach over the places between parts.
        self.unsplit = any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        self.known: dict[str, int] = {}

    def one(self, text: str) -> np.ndarray:
        if self.fast is None or self.unsplit or self.added.search(text) or not text.isascii() and _RARE.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    def parts(self, text: str) -> list[str]:
        """The text in parts whose ids, one after the other, are the text's."""
        return [text] * bool(text) if self.unsplit else parts(text)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [self.one(t) for t in texts]

    def counts(self, every: list[str]) -> np.ndarray:
        """The number of ids of each part."""
        known = self.known
        new = {p for p in every if p not in known}
        if new:
            if len(known) + len(new) > MOST_PARTS:
                known.clear()
                new = set(every)
            known.update((p, len(self.one(p))) for p in new)
        return np.fromiter(map(known.__getitem__, every), np.int64, len(every))


def _same_ranks(path: str):
    """The file's byte-level BPE for ``tiktoken``, if its ids follow the order of its merges; else None."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    model, split = held["model"], held["pre_tokenizer"] or {}
    plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    if not plain or held["normalizer"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    # byte-level vocabularies write bytes that are not printable as characters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    vocabulary, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}
    return tiktoken.Encoding("held", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
