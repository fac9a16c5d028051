"""Byte-level BPE over columns of texts, with reuse of repeated space-delimited pieces.

The vocabulary's splitting pattern never lets a token reach over a place where a non-space
character is followed by a space, and what stands on one side of such a place doesn't change the
tokens on the other. A column is cut there, each distinct piece is encoded once, and the ids of the
texts are gathered from the pieces' ids. They are the ids of the whole texts encoded at once.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space of Unicode as a class for Arrow's patterns; a space after one of these is no safe place.
_SPACES = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNCLEAN = _SPACES + r" | \z"
_SAFE = re.compile(r"[^\s᠎](?= )")


def first_cut(text: str) -> int | None:
    """The first safe place with text on its left, or None."""
    found = _SAFE.search(text)
    return found.end() if found else None


def last_cut(text: str) -> int | None:
    at = text.rfind(" ")
    while at > 0:
        if not (text[at - 1].isspace() or text[at - 1] == "᠎"):
            return at
        at = text.rfind(" ", 0, at)
    return None


def _byte_alphabet() -> dict[str, int]:
    """Printable Latin-1 stands for itself, other bytes for the code points from 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Subwords:
    """The encoder of one tokenizer file.

    Where the file's merges stand in the order of their ids, as in byte-level vocabularies, ranks
    are the ids and the faster rank encoder gives the same ids; other files go through their own
    library.
    """

    def __init__(self, path: str, keep: int = 300_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self.special = {x["content"]: x["id"] for x in described["added_tokens"]}
        alphabet = _byte_alphabet()
        vocabulary = described["model"]["vocab"]
        self.table = [b""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for token, number in vocabulary.items():
            self.table[number] = bytes(alphabet[c] for c in token)
        for token, number in self.special.items():
            self.table[number] = token.encode()
        self._ranks = self._rank_encoder(described["model"]["merges"], vocabulary)
        self._opens = np.array([x[:1] == b" " for x in self.table])
        self._keep, self._longest = keep, longest
        self._known: dict[str, bytes] = {}

    def _rank_encoder(self, merges, vocabulary):
        pairs = (x.split(" ") if isinstance(x, str) else x for x in merges)
        made = [vocabulary[a + b] for a, b in pairs]
        if any(x >= y for x, y in zip(made, made[1:])) or min(made) <= 255:
            return None
        import public_tokenizers
        import tiktoken

        ranks = {self.table[n]: n for n in vocabulary.values()}
        return tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special
        )

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text."""
        if self._ranks is None:
            ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self._ranks.encode(text, allowed_special="all")
        return np.asarray(ids, np.uint32)

    def _after_space(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a space before it; words are not empty and hold no space."""
        if self._ranks is None:
            found = self._tokenizer.encode_batch_fast([" " + w for w in words], add_special_tokens=False)
            return [np.asarray(x.ids, "<u4").tobytes() for x in found]
        ids = self.encode(" " + " ".join(words)).astype("<u4")
        bounds = [*(4 * np.flatnonzero(self._opens[ids])).tolist(), 4 * len(ids)]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _codes(self, words: list[str]) -> list[bytes]:
        codes = list(map(self._known.get, words))
        new = [k for k, code in enumerate(codes) if code is None]
        if len(self._known) > self._keep:
            self._known = {}
        for at in range(0, len(new), 100_000):
            part = new[at : at + 100_000]
            for k, code in zip(part, self._after_space([words[k] for k in part])):
                codes[k] = code
                if len(words[k]) <= self._longest:
                    self._known[words[k]] = code
        return codes

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column without nulls."""
        result: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        at = 0
        while at < len(texts):  # some megabytes at a time
            upto = at + 1
            size = len(texts[at].as_py())
            while upto < len(texts) and upto - at < 4096 and size < 6_000_000:
                size += pc.binary_length(texts[upto]).as_py()
                upto += 1
            result[at:upto] = self._encode_block(texts.slice(at, upto - at))
            at = upto
        return result

    def _encode_block(self, texts: pa.Array) -> list[np.ndarray]:
        clean = pc.invert(pc.match_substring_regex(texts, _UNCLEAN))
        rows = np.flatnonzero(clean.to_numpy(zero_copy_only=False))
        result = [np.zeros(0, np.uint32)] * len(texts)
        for row in np.flatnonzero(pc.invert(clean).to_numpy(zero_copy_only=False)):
            result[row] = self.encode(texts[int(row)].as_py())
        if not len(rows):
            return result
        split = pc.split_pattern(texts.filter(clean), " ")
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        distinct = split.flatten().dictionary_encode()
        entry = distinct.indices.to_numpy().astype(np.int64)
        opening = np.zeros(len(entry), bool)
        opening[bounds[:-1]] = True
        used = np.unique(entry[~opening])
        codes = self._codes(distinct.dictionary.take(pa.array(used)).to_pylist())
        words = np.zeros(len(distinct.dictionary), np.int64)
        words[used] = np.arange(len(used))
        entry = words[entry]
        # The first word of a text has no space before it.
        firsts = distinct.dictionary.take(distinct.indices.take(pa.array(bounds[:-1]))).to_pylist()
        entry[bounds[:-1]] = len(used) + np.arange(len(firsts))
        codes += [self.encode(x).astype("<u4").tobytes() for x in firsts]
        lengths = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        table = np.frombuffer(b"".join(codes), "<u4")
        begins = np.cumsum(lengths) - lengths
        counts = lengths[entry]
        ends = np.cumsum(counts)
        ids = table[np.repeat(begins[entry] - (ends - counts), counts) + np.arange(ends[-1])]
        stops = ends[bounds[1:] - 1]
        starts = np.concatenate([[0], stops[:-1]])
        for row, a, b in zip(rows.tolist(), starts.tolist(), stops.tolist()):
            result[row] = ids[a:b]
        return result


@lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    """One encoder per worker process."""
    return Subwords(path)
