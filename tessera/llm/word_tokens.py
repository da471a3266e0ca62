"""Token ids of whole texts by the ``tokenizers`` library, with a memo of words.

The word vocabulary drops white space and never merges across it, so a text's ids
are the joined ids of its words.  Arrow splits a batch of texts and finds its distinct
words; each worker asks the library once for a word and remembers the packed ids, within
a bound; the ids of all texts are then gathered at once.  The memo has two halves: when the
newer one is full, the older one goes, and a word that is met again moves to the newer one,
so words that come again and again stay, however many come once.  Ids are unsigned 32-bit integers.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np

#: Bytes that a worker's memo of words may take, by an estimate of an entry's overhead.
MEMO_BYTES = 160 << 20
_ENTRY_BYTES = 180
#: Words joined to one text for the library.
JOINED = 64
#: Bytes of text looked at together.
CHUNK_BYTES = 8_000_000

#: Marks of ASCII without the apostrophe; a run of them after letters is a piece of its own.
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
#: Words of lower-case letters whose lower case and composed form are themselves, and a run of marks, or none.
_PLAIN = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+[!-&(-/:-@\\[-`{-~]*$"
_ONLY_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100))]


def _byte_letters() -> dict[int, str]:
    """What byte-level vocabularies write for each letter outside ASCII: a character a byte of its UTF-8."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in shown]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {ord(c): "".join(names[b] for b in c.encode()) for c in _LETTERS if not c.isascii()}


_BYTE_LETTERS = _byte_letters()


def _strings(words) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


class WordTokens:
    """Encoding of texts whose words are encoded on their own by the tokenizer file at *path*."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model = self._tokenizer.model
        vocabulary = self._tokenizer.get_vocab()
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._memo: dict[str, bytes] = {}
        self._former: dict[str, bytes] = {}
        self._held = 0
        #: Bytes that the memo may take, if not ``MEMO_BYTES``.
        self.memo_bytes: int | None = None
        # words of letters go to the model itself if that gives the same: each letter, pairs, and a long word
        probes = [w for c in _LETTERS for w in (c, f"{c}a", f"a{c}", f"th{c}")] + ["".join(_LETTERS) * 4, "the", "information"]
        self._direct = False
        want = self._encode(probes)
        self._direct = True
        self._direct = self._encode(probes) == want

    def _encode(self, texts: list[str]) -> list[list[int]]:
        if self._direct and _ONLY_LETTERS.fullmatch("".join(texts)):
            # such a word needs no normaliser and is one piece
            tokenize = self._model.tokenize
            return [[t.id for t in tokenize(w if w.isascii() else w.translate(_BYTE_LETTERS))] for w in texts]
        return [x.ids for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, words: list[str]) -> list[bytes | None]:
        """Remembered ids of words; those of the former half are kept on."""
        memo, former = self._memo, self._former
        found = list(map(memo.get, words))
        if former:
            missing = [i for i, x in enumerate(found) if x is None]
            kept = list(map(former.get, map(words.__getitem__, missing)))
            for i, x in zip(missing, kept, strict=True):
                if x is not None:
                    memo[words[i]] = found[i] = x
        return found

    def _new(self, words: list[str]) -> list[str]:
        return [w for w, x in zip(words, self._known(words), strict=True) if x is None]

    def _letters(self, words: list[str]) -> None:
        """Remembers words of lower-case letters alone: without the model each ends at its only token that ends a word."""
        if self._direct:
            self._memo.update((w, array("I", x).tobytes()) for w, x in zip(words, self._encode(words), strict=True))
            return
        found = self._encode([" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)])
        flat = np.fromiter(chain.from_iterable(found), np.uint32)
        ends = (np.flatnonzero(self._ends_word[flat]) + 1) * 4
        if len(ends) != len(words):
            self._memo.update((w, array("I", x).tobytes()) for w, x in zip(words, self._encode(words), strict=True))
            return
        packed, ends = flat.astype("<u4").tobytes(), ends.tolist()
        self._memo.update(zip(words, [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def _remember(self, words) -> list[bytes]:
        """The ids of an Arrow array of new words, which are remembered."""
        import pyarrow.compute as pc

        memo = self._memo
        plain = pc.match_substring_regex(words, _PLAIN)
        others = _strings(words.filter(pc.invert(plain)))
        plain = words.filter(plain)
        core = pc.utf8_rtrim(plain, _MARKS)
        marked = pc.not_equal(core, plain)
        ends = [(w, c, w[len(c) :]) for w, c in zip(_strings(plain.filter(marked)), _strings(core.filter(marked)), strict=True)]
        alone = self._new([*{*others, *(m for _, _, m in ends)}])
        memo.update((w, array("I", x).tobytes()) for w, x in zip(alone, self._encode(alone), strict=True))
        if cores := self._new(_strings(core.dictionary_encode().dictionary)):
            self._letters(cores)
        for w, c, m in ends:
            memo[w] = memo[c] + memo[m]
        return [memo[w] for w in _strings(words)]

    def encode_array(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of texts, joined, and the place in them at which each text begins, with the end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self._held > (self.memo_bytes or MEMO_BYTES) // 2:
            self._former, self._memo, self._held = self._memo, {}, 0
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        # a special token's text in capitals is not that token
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(lower)
        coded = split.flatten().dictionary_encode()
        words = _strings(coded.dictionary)
        on = gc.isenabled()
        gc.disable()  # the lists here have no cycles, and collections would walk them again and again
        try:
            known = len(self._memo)
            found = self._known(words)
            if missing := [i for i, x in enumerate(found) if x is None]:
                new = self._remember(coded.dictionary.take(pa.array(missing)))
                for i, x in zip(missing, new, strict=True):
                    found[i] = x
                # the new words with their ids
                self._held += 4 * sum(map(len, map(words.__getitem__, missing))) + sum(map(len, new))
            # also words that are kept on, and words without marks that came with others
            self._held += (len(self._memo) - known) * _ENTRY_BYTES
        finally:
            if on:
                gc.enable()
        lengths = np.fromiter(map(len, found), np.int32, len(found)) // 4
        table = np.frombuffer(b"".join(found), "<u4")
        which = coded.indices.to_numpy(zero_copy_only=False)
        sizes = lengths[which]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        place = np.int32 if max(total, len(table)) < 1 << 31 else np.int64  # half the memory, where it holds all places
        firsts = np.cumsum(lengths, dtype=place) - lengths
        ids = table[np.repeat(firsts[which] - (ends.astype(place) - sizes), sizes) + np.arange(total, dtype=place)]
        bounds = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        return ids, np.concatenate(([0], ends))[bounds - bounds[0]]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        import pyarrow as pa

        ids, at = self.encode_array(pa.array(texts, pa.string()))
        packed, at = ids.astype("<u4").tobytes(), (at * 4).tolist()
        return [packed[a:b] for a, b in zip(at, at[1:], strict=False)]


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Joined ids with *end_id* after each text, and the new places."""
    return np.insert(ids, at[1:], end_id), at + np.arange(len(at))


def slices(texts, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """First and last row of parts of an Arrow array of texts, each of about *most* bytes."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < len(sizes):
        base = sizes[start - 1] if start else 0
        end = min(len(sizes), int(np.searchsorted(sizes, base + most)) + 1)
        yield start, end
        start = end


_LOADED: dict[str, WordTokens] = {}


def load(path: str, memo_bytes: int | None = None) -> WordTokens:
    """The tokenizer at *path*, once a worker; its memo takes up to *memo_bytes* from now on, or ``MEMO_BYTES``."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = WordTokens(path)
    _LOADED[path].memo_bytes = memo_bytes
    return _LOADED[path]
