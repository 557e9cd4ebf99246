"""Token ids of whole texts by a public byte-level BPE file, through the tokenizers library.

A byte-level BPE never merges across its pre-tokens, and white space after anything else always
starts a new pre-token. A text may therefore be cut before such spaces and the ids of its words
joined. Arrow finds the distinct words of a batch, the worker remembers those it has met, and the
library sees new words only. Texts in which that cut is not exact (a space between two other white
space characters) are handed to the library whole.
"""

from __future__ import annotations

import functools
import os
import string
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_WORDS = 300_000
WORDS_PER_CALL = 5_000
BATCH_BYTES = 20 << 20
#: Marks that form a pre-token of their own after letters (an apostrophe may not).
MARKS = string.punctuation.replace("'", "")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


PACKERS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def pack(ids: list[int]) -> bytes:
    n = len(ids)
    return PACKERS[n](*ids) if n < len(PACKERS) else struct.pack(f"<{n}I", *ids)


class Recent(dict):
    """A memory of bounded size that forgets what it was not asked for lately.

    Entries live in two halves. What is found in the older half moves to the newer one; once that
    is full, it becomes the older half and the rest is forgotten.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        self.older: dict = {}

    def __missing__(self, key):
        value = self[key] = self.older[key]
        return value

    def turn(self) -> None:
        if len(self) > self.most // 2:
            self.older = dict(self)
            self.clear()

    def missing(self, keys: list) -> list:
        """Those of ``keys`` that neither half holds; the others are in the newer half then."""
        older, absent = self.older, []
        for key in [k for k in keys if k not in self]:
            if key in older:
                self[key] = older[key]
            else:
                absent.append(key)
        return absent


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it prints."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Ids of texts (little-endian unsigned 32-bit); special strings are ordinary text."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.size = self.tokenizer.get_vocab_size()
        self.opens = np.zeros(self.size, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.known = Recent(max_words)
        self.stems = Recent(max_words)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _letters(self, lead: str, word: str) -> bytes | None:
        """Ids of a word of Latin letters with marks after it; None for any other word."""
        stem = word.rstrip(MARKS)
        if not stem.isalpha():
            return None
        stems, older = self.stems, self.stems.older
        key = lead + stem
        ids = stems.get(key) or older.get(key)
        if ids is None:
            if stem.isascii():
                text = key
            elif max(stem) < "ɐ":
                text = lead + stem.encode().decode("latin-1").translate(self.letters)
            else:
                return None
            ids = stems[key] = pack([t.id for t in self.tokenize(text)])
        if len(stem) == len(word):
            return ids
        marks = word[len(stem):]
        after = stems.get(marks)
        if after is None:
            after = stems[marks] = self.whole([marks])[0]
        return ids + after

    def _learn(self, words: list[str]) -> None:
        """Ids of words that follow a space; None where the word can't be told apart."""
        rest = []
        for w in words:
            if "\n" in w:
                parts = w.split("\n")
                found = [self._letters("Ġ" if i == 0 else "", p) for i, p in enumerate(parts)]
                ids = None if None in found else self.newline.join(found)
            else:
                ids = self._letters("Ġ", w)
            if ids is not None:
                self.known[w] = ids
            elif not w or w[0].isspace():
                self.known[w] = None
            else:
                rest.append(w)
        for i in range(0, len(rest), WORDS_PER_CALL):
            part = rest[i:i + WORDS_PER_CALL]
            ids = np.array(self.tokenizer.encode_batch_fast(
                [" " + " ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.append(np.flatnonzero(self.opens[ids])[1:], len(ids)) * 4
            flat, start = ids.tobytes(), 0
            for w, end in zip(part, ends.tolist(), strict=True):
                self.known[w] = flat[start:end]
                start = end

    @functools.cached_property
    def newline(self) -> bytes:
        return self.whole(["\n"])[0]

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        self.known.turn()
        self.stems.turn()
        split = pc.split_pattern(texts, " ")
        starts = np.asarray(split.offsets)
        starts = starts - starts[0]
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn(self.known.missing(words))
        ids = list(map(self.known.__getitem__, words))
        which = np.array(coded.indices)
        heads = pc.take(coded.dictionary, pa.array(which[starts[:-1]])).dictionary_encode()
        which[starts[:-1]] = len(ids) + np.asarray(heads.indices)
        ids += self.whole(heads.dictionary.to_pylist())
        unclear = np.array([x is None for x in ids]) if None in ids else None
        if unclear is not None:
            ids = [x or b"" for x in ids]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        first = np.cumsum(sizes) - sizes
        per_word = sizes[which]
        ends = np.cumsum(per_word)
        at = np.repeat(first[which] - (ends - per_word), per_word)
        at += np.arange(len(at))
        tokens = flat[at]
        bounds = np.concatenate([[0], ends])[starts]
        out = [tokens[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        if unclear is not None:
            hit = np.concatenate([[0], np.cumsum(unclear[which])])[starts]
            odd = np.flatnonzero(np.diff(hit))
            whole = self.whole(texts.take(pa.array(odd)).to_pylist())
            for i, found in zip(odd.tolist(), whole, strict=True):
                out[i] = np.frombuffer(found, dtype="<u4")
        return out

    def forget(self) -> None:
        """Give back the memory of the words met so far."""
        for memo in (self.known, self.stems):
            memo.clear()
            memo.older.clear()
        pa.default_memory_pool().release_unused()

    def encode(self, texts: pa.Array | list[str | None],
               batch_bytes: int = BATCH_BYTES) -> Iterator[np.ndarray]:
        """The ids of each text, in order; a missing text counts as empty. About ``batch_bytes`` of
        whole texts are worked on at a time."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + batch_bytes, side="right")))
            yield from self._encode(texts.slice(start, stop - start))
            start = stop


@functools.lru_cache(maxsize=2)
def encoder(path: str, max_words: int = MAX_WORDS) -> WordEncoder:
    """One encoder per worker process and file."""
    return WordEncoder(path, max_words)
