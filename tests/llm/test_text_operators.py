"""Per-document operators against the tokenizers library and brute force."""

import hashlib
import re
import tracemalloc
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, huffman, licenses, packing, secrets, word_tokens
from tessera.llm.queries import tokenizer

from .cases import by_id, documents, empty, rows, texts

Tokenizer = pytest.importorskip("tokenizers").Tokenizer
BYTES, WORDS = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(BYTES)
    found = by_id(bpe.encode_documents(documents(spark), BYTES))
    assert sum(map(len, found.values())) == len(rows())
    for r in rows():
        want = library.encode(r[1] or "", add_special_tokens=False).ids
        got = found[r[0]][0]
        assert list(array("I", got.ids)) == want and got.n_tokens == len(want)
        assert got.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(empty(spark), BYTES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcdeth ing.\n'sS1é日  \x1c😀<|>of", max_size=40), max_size=5))
def test_bpe_any_text(found):
    library = Tokenizer.from_file(BYTES) if not hasattr(test_bpe_any_text, "library") else test_bpe_any_text.library
    test_bpe_any_text.library = library
    packed = bpe.load(BYTES).encode_batch(found)
    assert [list(array("I", p)) for p in packed] == [x.ids for x in library.encode_batch(found, add_special_tokens=False)]
    assert [bpe.load(BYTES).decode(p) for p in packed] == found


def library_ids(text):
    return np.array([*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


def test_packing_places_every_id_once(spark):
    found = packing.pack_documents(documents(spark), WORDS, capacity=256, ids=True).collect()
    whole = {r[0]: library_ids(r[1]) for r in rows()}
    by = {}
    for r in found:
        assert whole[r.doc_id][4 * r.start : 4 * (r.start + r.length)] == r.ids and zlib.crc32(r.ids) == r.ids_crc32
        assert r.doc_tokens == len(whole[r.doc_id]) // 4
        by.setdefault(r.doc_id, []).append((r.start, r.length))
    for key, pieces in by.items():
        times = sum(x[0] == key for x in rows())
        assert sum(n for _, n in pieces) == times * len(whole[key]) // 4
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack_documents(empty(spark), WORDS).count() == 0


def test_packing_holds_little_beside_its_batch():
    pa = pytest.importorskip("pyarrow")
    letters = "abcdefghijklmnopqrst"
    words = [f"{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in "aeiou"]
    docs = [" ".join(words[(37 * i + 11 * j) % len(words)] for j in range(400)) for i in range(4000)]
    word_tokens._LOADED.clear()
    pool, made = pa.default_memory_pool(), 0
    tracemalloc.start()
    try:
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs)], ["_id", "_text"])
        before, held = tracemalloc.get_traced_memory()[0], pool.bytes_allocated()
        for out in packing.packed_batches(iter([batch]), "doc_id", WORDS, 2048, 1, False, 0):
            made += sum(out.column(2).to_pylist())
        most = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert made == len(docs) + sum(map(len, word_tokens.load(WORDS).encode_batch(docs))) // 4
    assert most < 40e6 and pool.bytes_allocated() <= held + 1e6


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=8), st.integers(1, 30))
def test_fill_is_closest(counts, capacity):
    reach = {0}
    for n, k in counts.items():
        reach = {a + n * i for a in reach for i in range(k + 1) if a + n * i <= capacity}
    got = packing.fill(counts, capacity)
    assert all(k <= counts[n] for n, k in got.items()) and sum(n * k for n, k in got.items()) == max(reach)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_bins_hold_all_pieces(lengths):
    bins, offsets, used = packing.pack_pieces(lengths, 64)
    filled = Counter()
    for b, n in zip(bins, lengths, strict=True):
        filled[b] += n
    assert all(v <= 64 for v in filled.values()) and set(bins) == set(range(used))
    assert used <= 2 * -(-sum(lengths) // 64) or used <= 1


def test_huffman_files_round_trip(spark, tmp_path):
    docs = documents(spark)
    huffman.write_files(docs, WORDS, f"{tmp_path}/ids")
    found = huffman.read_files(spark, f"{tmp_path}/ids", ids=True).collect()
    want = sorted(((r[0] is not None, r[0] or 0, library_ids(r[1])) for r in rows()), key=lambda x: x[:2])
    got = sorted(found, key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [x[:2] for x in want]
    at = 0
    for r, (_, _, ids) in zip(got, want, strict=True):
        assert (r.start, r.ids, r.n_tokens, r.ids_crc32) == (at, ids, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    huffman.write_files(empty(spark), WORDS, f"{tmp_path}/none")
    assert huffman.read_files(spark, f"{tmp_path}/none").count() == 0


def test_ids_beyond_sixteen_bits(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    huffman.write_files(docs, WORDS, f"{tmp_path}/wide", end_id=70_000)
    found = sorted(huffman.read_files(spark, f"{tmp_path}/wide", ids=True).collect(), key=lambda r: r.start)
    last = (70_000).to_bytes(4, "little")
    assert [r.ids for r in found] == [library_ids("one two")[:-4] + last, last]
    assert sorted(p.name for p in tmp_path.joinpath("wide").iterdir()) == ["blocks", "codes"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=60), st.integers(6, 12))
def test_code_lengths_are_a_limited_optimal_code(counts, limit):
    lengths = huffman.code_lengths(np.array(counts), limit)
    used = [(c, n) for c, n in zip(counts, lengths.tolist(), strict=True) if c]
    assert all((n > 0) == (c > 0) for c, n in zip(counts, lengths.tolist(), strict=True)) and lengths.max(initial=0) <= limit
    if len(used) > 1:
        assert sum(2.0**-n for _, n in used) == 1
    import heapq

    heap, cost = sorted(c for c, _ in used), 0
    deep = False
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    total = sum(c * n for c, n in used)
    deep = max((n for _, n in used), default=0) == limit
    assert len(used) < 2 or total == cost or deep and total >= cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=40), min_size=1, max_size=6))
def test_blocks_decode_from_checkpoints(docs):
    flat, sizes = np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs])
    lengths = huffman.code_lengths(np.bincount(flat, minlength=400))
    payload, firsts, inside = huffman.encode(flat, sizes, huffman.canonical_codes(lengths), lengths)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    starts = np.concatenate([inside[a:b:7] + 8 * f for a, b, f in zip(begins, begins[1:], firsts, strict=False)])
    lanes = np.array([min(7, n - k) for n in sizes.tolist() for k in range(0, n, 7)])
    assert huffman.decode(payload, starts, lanes, huffman.decoding_table(lengths)).tolist() == flat.tolist()


def brute_secrets(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_secret_scan(spark):
    model = secrets.train(spark)
    found = by_id(secrets.scan(documents(spark), model))
    for r in rows():
        base, got = brute_secrets(r[1] or ""), found[r[0]][0]
        assert got.base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert set(secrets.joined(base).split(",")) <= set(got.spans.split(","))
    text = next(t for t in texts() if t and "password = " in t)
    assert f"markov:{text.index('x9Kd7')}:{text.index('x9Kd7') + 21}" in found[[r for r in rows() if r[1] == text][0][0]][0].spans
    assert secrets.scan(empty(spark), model).count() == 0


def test_markov_models_tell_held_out_samples_apart(spark):
    model = secrets.train(spark)
    held = secrets.labelled_samples(400, seed=99)
    right = sum((model.score(t) >= secrets.THRESHOLD) == bool(y) for t, y in held)
    assert right / len(held) > 0.97


def test_hostile_assignments():
    for text in ("password: token: abcdefghijklmnop", "token=secret=abcdefghijklmnop", "ſecret=abcdefghijklmnop", "AKIAAKIA AKIAABCDEFGHIJKLMN", "0" * 15 + "g" + "f" * 16):
        assert secrets.base_spans(text) == brute_secrets(text)


def brute_licenses(text):
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels = {label for _, label in places}
    for label, template in licenses.TEMPLATES:
        listed = [w.decode() for w in licenses.words_of(template.encode())]
        own, span = set(listed), -(-5 * len(listed) // 4)
        must = {w for w in own if w.encode() in licenses.TELLING}
        blocks = [own & set(words[i : i + span]) for i in range(len(words))]
        labels |= {label for block in blocks if len(block) >= licenses.CONTAINMENT * len(own) - 1e-9 and must <= block}
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels))


def test_license_scan(spark):
    found = by_id(licenses.scan(documents(spark)))
    for r in rows():
        got = found[r[0]][0]
        assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels, got.labels) == brute_licenses(r[1] or "")
        assert 0 <= got.score <= 1 and (got.score > 0) == bool(got.labels)
    assert licenses.scan(empty(spark)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("licensed under the apache license version 2 0 mit released gnu general public this work is terms of".split()), max_size=25), st.dictionaries(st.sampled_from([b"the", b"license", b"under", b"of"]), st.integers(0, 50)))
def test_filters_lose_no_template(block, frequency):
    index = licenses.TemplateIndex(frequency)
    words = [w.encode() for w in block]
    want = set()
    for label, t in licenses.TEMPLATES:
        listed = licenses.words_of(t.encode())
        own, span = set(listed), -(-5 * len(listed) // 4)
        if any(len(own & set(words[i : i + span])) >= licenses.CONTAINMENT * len(own) - 1e-9 for i in range(len(words))):
            want.add(label)
    assert set(index.find_windows(words)) == want


def test_frequent_words_stay_in_a_full_memo(monkeypatch):
    frequent = [f"often{'abcdefghij'[i]}" for i in range(10)]
    chunks = [[" ".join([*frequent, *(f"once{'abcdefghij'[k]}{'abcdefghij'[i]}{'abcdefghij'[j]}" for i in range(10) for j in range(10))])] for k in range(10)]
    monkeypatch.setattr(word_tokens, "MEMO_BYTES", 150 * word_tokens._ENTRY_BYTES)
    library, tokens, asked = Tokenizer.from_file(WORDS), word_tokens.WordTokens(WORDS), []
    encode = tokens._encode
    monkeypatch.setattr(tokens, "_encode", lambda texts: [asked.extend(t.split()) for t in texts] and encode(texts))
    for chunk in chunks:
        assert tokens.encode_batch(chunk) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in chunk]
    assert max(asked.count(w) for w in frequent) == 1
    assert sum(len(x) for x in vars(tokens).values() if isinstance(x, dict)) < 600


def test_letters_and_runs_of_marks_are_not_asked_word_by_word(monkeypatch):
    cores = [f"{a}{b}{c}" for a in ("stra\u00dfe", "\u00e9t\u00e9", "now", "\u00ff") for b in "abcxyz\u00f8\u00f6" for c in ("", "s", "\u00e7")]
    runs = ["", "$$$", ".%%%", "&&&", "!!", "_-", "``", '"', "[]", "<|", "^~", "."]
    text = " ".join([c + r for c in cores for r in runs] + ["don't", "x'", "a'$", "it's!!", "\u00d7$$", "a\u00f7.", "A$$<|endoftext|>b", "caf\u00e9$$$", "e\u0301$$", "1$$", "a1$$"])
    library, tokens, asked = Tokenizer.from_file(WORDS), word_tokens.WordTokens(WORDS), []
    assert tokens._direct
    encode = tokens._encode
    monkeypatch.setattr(tokens, "_encode", lambda texts: [asked.extend(t.split()) for t in texts] and encode(texts))
    for t in (text, text.replace("<|", "")):
        assert tokens.encode_batch([t]) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
    assert len(asked) < 2 * len(cores)
