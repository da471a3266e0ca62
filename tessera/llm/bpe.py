"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

A text is cut into pre-tokens; the distinct pre-tokens of a batch of documents
form a trie.  Walking the trie depth first, every node gets its *last-token
state*: the last token of the encoding of the path from the root to it.  A state
needs only states of shorter prefixes, so the encodings of shared prefixes are
computed once, and a word's ids are read off by stepping back through the
states of its own path.

The state of a prefix is the one vocabulary token ``t`` that ends it for which
``(state before t, t)`` is a stable pair: encoding the two tokens' joined bytes
gives the same two tokens.  A pair is unstable exactly if, while the two sides
merge on their own, some merge across the seam is due before both of its
operands are used up inside their sides.

Spark partitions the work: :func:`encode_documents` is one ``mapInArrow`` without
a shuffle.  Null texts count as empty; an empty text has no ids; other columns,
whatever their names, are not looked at except the id column, which is passed on.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, tidy

#: White space by the Unicode property, written out so that engines agree.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the public byte-level pre-token pattern.
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Bytes that a worker's memos of runs and words may take, by an estimate of an entry's overhead.
MEMO_BYTES = 160 << 20
_ENTRY_BYTES = 180
#: Characters of text looked at together.
CHUNK_CHARS = 8_000_000

_NEVER = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """The public one-character-per-byte alphabet of byte-level vocabularies, by its rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBPE:
    """A byte-level BPE vocabulary with encoding over a trie of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        raw = {t: bytes(alphabet[c] for c in t) for t in model["vocab"] if all(c in alphabet for c in t)}
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for t, i in model["vocab"].items():
            self.bytes_of[i] = raw.get(t, t.encode())
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        ids = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        made_of: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            pair, new = (ids[left], ids[right]), ids[left + right]
            self.rank[pair] = r
            if new not in made_of:
                made_of[new], self.made_at[new] = pair, r
        self._right: dict[int, tuple[tuple[int, int], ...]] = {}
        self._left: dict[int, tuple[tuple[int, int], ...]] = {}
        self._made_of = made_of
        self.token: dict[bytes, int] = {}
        for t, i in sorted(ids.items(), key=lambda x: self.made_at.get(x[1], -1)):
            if t in raw and t not in self.special and self._whole(i):
                self.token[raw[t]] = i
        #: Lengths of the tokens that end in four given bytes, and those of any token of up to three.
        ends: dict[bytes, set[int]] = {}
        for b in self.token:
            if len(b) > 3:
                ends.setdefault(b[-4:], set()).add(len(b))
        self._lengths = {b: (*sorted(n, reverse=True), 3, 2, 1) for b, n in ends.items()}
        #: Whether two tokens stay apart, by both numbers side by side in as many bits as the vocabulary needs.
        self._stable: dict[int, bool] = {}
        self._bits = max(ids.values(), default=0).bit_length()
        cut = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self._specials = re.compile(f"({cut})") if cut else None
        self._pieces = regex.compile(PRETOKEN).findall
        #: Memos: runs at the start of a text, runs after a space, pre-tokens.
        self._first: dict[str, bytes] = {}
        self._after: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._held = 0

    # -- the vocabulary ----------------------------------------------------

    def _seam(self, token: int, side: int) -> tuple[tuple[int, int], ...]:
        """The pieces that touch the seam on one side of it while *token* forms, each with the rank that uses it up."""
        known = self._right if side else self._left
        if token not in known:
            out, x, until = [(token, _NEVER)], token, _NEVER
            while x in self._made_of:
                until = self.made_at[x]
                x = self._made_of[x][side]
                out.append((x, until))
            known[token] = tuple(out)
        return known[token]

    def _crossing(self, a: int, b: int, own: int = -1) -> bool:
        """Whether a merge across the seam of *a* and *b* comes first; *own* is a rank that does not count."""
        for x, x_until in self._seam(a, 1):
            for y, y_until in self._seam(b, 0):
                r = self.rank.get((x, y))
                if r is not None and r != own and r < x_until and r <= y_until:
                    return True
        return False

    def _whole(self, token: int) -> bool:
        """Whether encoding the token's own bytes gives the token."""
        pair = self._made_of.get(token)
        if pair is None:
            return len(self.bytes_of[token]) == 1
        return all(self.token.get(self.bytes_of[x]) == x for x in pair) and not self._crossing(*pair, own=self.made_at[token])

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens *a* and *b* stay as they are when written side by side."""
        key = a << self._bits | b
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) > 1_000_000:
                self._stable.clear()
            known = self._stable[key] = not self._crossing(a, b)
        return known

    # -- encoding ----------------------------------------------------------

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of each word.  Sorted distinct words are the trie's paths in depth-first order."""
        token, stable, seen, lengths = self.token.get, self.stable, self._stable.get, self._lengths.get
        out: dict[bytes, list[int]] = {}
        path, states, short, bits = b"", [-1], (3, 2, 1), self._bits
        for word in sorted(set(words)):
            n, shared, most = len(word), 0, min(len(word), len(path))
            while shared < most and word[shared] == path[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, n + 1):
                for size in lengths(word[end - 4 : end], short) if end > 3 else range(end, 0, -1):
                    start = end - size
                    if start >= 0 and (t := token(word[start:end])) is not None:
                        if not start:
                            break
                        ok = seen(states[start] << bits | t)
                        if ok or ok is None and stable(states[start], t):
                            break
                states.append(t)
            path, ids, at = word, [], n
            while at:
                ids.append(states[at])
                at -= len(self.bytes_of[states[at]])
            ids.reverse()
            out[word] = ids
        return out

    def _remember(self, runs: set[str], lead: str, memo: dict[str, bytes]) -> None:
        """Adds the encodings of runs, each after the text *lead* and cut into pre-tokens, to the memo."""
        cut = self._pieces
        cuts = {r: [lead + r[:-1], r[-1]] if r[-1:] in _MARKS and r[:-1].isalpha() else cut(lead + r) for r in runs}
        known = self._words
        words = {w: w.encode() for c in cuts.values() for w in c if w not in known}
        ids = self.encode_words(words.values())
        for w, b in words.items():
            known[w] = array("I", ids[b]).tobytes()
            self._held += _ENTRY_BYTES + 4 * len(w) + len(known[w])
        for r, pieces in cuts.items():
            memo[r] = known[pieces[0]] if len(pieces) == 1 else b"".join([known[w] for w in pieces])
            self._held += _ENTRY_BYTES + 4 * len(r) + (0 if len(pieces) == 1 else len(memo[r]))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        first, after = self._first, self._after
        if self._held > MEMO_BYTES:
            after.clear(), first.clear(), self._words.clear()
            self._held = 0
        cut: list[list[str]] = [self._specials.split(t) if self._specials and "<" in t else [t] for t in texts]
        runs = [[_single_space(part) if part and not k % 2 else [] for k, part in enumerate(parts)] for parts in cut]
        self._remember({r[0] for x in runs for r in x if r} - first.keys(), "", first)
        self._remember(set().union(*(r[1:] for x in runs for r in x)) - after.keys(), " ", after)
        out = []
        for parts, x in zip(cut, runs, strict=True):
            packed = []
            for k, r in enumerate(x):
                if k % 2:
                    packed.append(array("I", [self.special[parts[k]]]).tobytes())
                elif r:
                    packed.append(first[r[0]])
                    packed += [after[w] for w in r[1:]]
            out.append(b"".join(packed))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of packed ids."""
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", errors="replace")


#: After letters alone, one of these is a pre-token of its own.
_MARKS = (".", ",", ";", ":", "!", "?")
#: A space with white space or an edge beside it does not start a run that encodes on its own.
_ODD = re.compile(r"\s\s|^\s|\s$")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def _single_space(text: str) -> list[str]:
    return (_BETWEEN.split if _ODD.search(text) else lambda t: t.split(" "))(text)


_LOADED: dict[str, TrieBPE] = {}


def load(path: str) -> TrieBPE:
    """The vocabulary at *path*, once a worker."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = TrieBPE(path)
    return _LOADED[path]


def in_chunks(rows: Iterable[tuple], at: int = 1, most: int = CHUNK_CHARS) -> Iterator[list[tuple]]:
    """Lists of rows whose texts, in place *at*, have together about *most* characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[at]) + 100
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """One row a document: its id, ``ids`` (packed), ``n_tokens``, ``decoded`` and the digests of both.

    *ids* and *decoded* say whether those two large columns are returned; the
    digests always are.  Repeated rows give repeated results; a null id stays null.
    """
    import pyarrow as pa

    kind = docs.schema[id_column].dataType.simpleString()
    frame = docs.select(F.col(id_column).alias("_id"), text_of(docs, text_column).alias("_text"))
    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids + ", decoded string" * decoded

    def run(batches):
        bpe = load(tokenizer_path)
        for batch in batches:
            keys = batch.column(0)
            done = 0
            for rows in in_chunks(zip(range(len(keys)), batch.column(1).to_pylist(), strict=True)):
                packed = bpe.encode_batch([t for _, t in rows])
                back = [bpe.decode(p) for p in packed]
                columns = [keys.slice(done, len(rows)), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back])]
                columns += [pa.array(packed, pa.binary())] * ids + [pa.array(back, pa.string())] * decoded
                names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids, *["decoded"] * decoded]
                done += len(rows)
                yield pa.RecordBatch.from_arrays(columns, names)

    return frame.mapInArrow(tidy(run), schema)
