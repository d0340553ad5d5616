"""BPE, token files and fingerprints against the library and brute force."""

import hashlib
import random
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from motilis.llm import bpe, fingerprints, token_files
from motilis.llm.common import scratch
from motilis.llm.shingles import mix, word_hashes

from .conftest import odd_rows, rows_of

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "a", "it's WE'LL 123abc!!! ", "日本語 ééé́ 👩‍👩‍👧 �", "\x00\x1f\x85 　x", "a" * 3000, "<|endoftext|>x<|endoftext|>", "  \n\n\t x"]


def test_bpe_matches_the_library():
    mine, library = bpe.tables(BYTE), Tokenizer.from_file(BYTE)
    for t in TEXTS + [r[1] or "" for r in odd_rows()]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(t), np.uint32).tolist() == ids
        assert mine.decode(mine.encode(t)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_skips_stale_entries():
    ranks = {(1, 1): (0, 2), (2, 1): (1, 3), (2, 2): (2, 4), (4, 2): (3, 5)}
    assert bpe.merge_word([1, 1, 1], ranks) == [3]
    assert bpe.merge_word([1] * 6, ranks) == [5]
    assert bpe.merge_word([], ranks) == [] and bpe.merge_word([9], ranks) == [9]


def test_bpe_forgets_and_still_encodes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    mine, library = bpe.ByteBpe(BYTE), Tokenizer.from_file(BYTE)
    t = " ".join(f"word{i}" for i in range(40))
    assert np.frombuffer(mine.encode(t), np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids and len(mine.known) <= 3


def test_bpe_over_odd_rows(odd, odd_wide, none):
    out = bpe.round_trip(odd, BYTE)
    assert rows_of(out) == rows_of(bpe.round_trip(odd_wide, BYTE)) and out.count() == len(odd_rows())
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.filter("doc_id = 6").collect()] == [(0, empty, empty)]
    assert bpe.round_trip(none, BYTE).count() == 0
    ids = bpe.encode(odd, BYTE).filter("doc_id = 9").first().ids
    assert bpe.tables(BYTE).decode(bytes(ids)) == "one two three"


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 23, 32])
def test_bits_round_trip(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = token_files.pack(x, bits)
    assert len(packed) == -(-1001 * bits // 8) and (token_files.unpack(packed, bits, 1001) == x).all()


def test_shard_gives_random_access(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in (0, 1, 5000, 12_000, 3)]
    path = tmp_path / "a.ids"
    path.write_bytes(b"".join(token_files.shard_chunks([5, 6, 7, 8, 9], [d.tobytes() for d in docs], 17, 512)))
    s = token_files.Shard(str(path))
    assert s.doc_ids.tolist() == [5, 6, 7, 8, 9] and all((s.document(k) == d).all() for k, d in enumerate(docs))
    flat = np.concatenate(docs)
    for a, b in ((0, 1), (511, 513), (4000, 4000), (700, 17_004)):
        assert (s.ids(a, b) == flat[a:b]).all()


def test_words_encode_as_whole_texts():
    library, mine = Tokenizer.from_file(WORD), token_files.WordEncoder(WORD)
    texts = TEXTS + ["Abc, xYz. É! a1. don't, ;; ", "İstanbul ΣΑΣ ſß ŉ", "a\x1cb c\x85d", "<|STARTOFTEXT|> x<|startoftext|>!! É"] + [r[1] or "" for r in odd_rows()]
    for t, ids in zip(texts * 2, mine.encode(texts) + mine.encode(texts)):
        assert np.frombuffer(ids, np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids


def test_words_of_every_letter_with_marks_behind():
    """Letters may be taken apart in lower case or normal form, and end in a mark that belongs to those behind."""
    library, mine = Tokenizer.from_file(WORD), token_files.WordEncoder(WORD)
    every = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LMN"]
    for form in ("{}.", "ab{},;", "{}\u0301!"):
        words = [form.format(c) for c in every if not 0x3400 <= ord(c) < 0xD7A4 and ord(c) < 0x17000 or ord(c) % 97 == 0]
        for w, ids, want in zip(words, mine.encode(words), library.encode_batch(words, add_special_tokens=False)):
            assert np.frombuffer(ids, np.uint32).tolist() == want.ids, [hex(ord(x)) for x in w]
    texts = ["SEVGİ.", "ALİ, İSTANBUL İ.", "क़. ख़, ड़; য়! ਸ਼।"]
    assert [np.frombuffer(x, np.uint32).tolist() for x in mine.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_keep_ids_at_the_edge(spark):
    rows = [(-(1 << 63), "least"), (None, "none"), ((1 << 63) - 1, "most"), (0, "zero"), (None, "none"), (0, "zero")]
    out = token_files.digests(token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), WORD, scratch(spark, "ids"))).collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == [None, None, -(1 << 63), 0, 0, (1 << 63) - 1]


@pytest.mark.parametrize("shard_ids", [50, 1 << 20])
def test_token_files_follow_doc_ids(spark, odd, shard_ids):
    signed = lambda t: (xxhash.xxh64_intdigest(t, seed=42) + (1 << 63)) % (1 << 64)
    manifest = token_files.write(odd, WORD, scratch(spark, "ids"), shard_ids=shard_ids)
    out = token_files.digests(manifest).collect()
    library, at = Tokenizer.from_file(WORD), 0
    for r, (i, t, *_) in zip(sorted(out, key=lambda r: r.start), sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1] or "")))):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(out) == len(odd_rows())


def test_token_files_of_nothing(spark, none, odd_wide):
    assert token_files.digests(token_files.write(none, WORD, scratch(spark, "ids"))).count() == 0
    out = token_files.read(token_files.write(odd_wide, WORD, scratch(spark, "ids")))
    assert out.count() == len(odd_rows()) and all(len(r.ids) == 4 * r.n_tokens for r in out.collect())


def next_order(rows):
    """Rows of (doc_id, text, ...) as one follows the other: descending doc_id, null last, equal ones by descending hash of the text."""
    signed = lambda t: (xxhash.xxh64_intdigest(t, seed=42) + (1 << 63)) % (1 << 64)
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -signed(r[1] or "")))


def brute_terms(text):
    """Distinct words in lower case (A-Z), each hashed on its own."""
    words = sorted({w.lower() for w in (text or "").encode().split()})
    return {int(word_hashes(pa.array([w.decode()]))[0][0]) for w in words}


def brute_parts(terms, lexicon):
    """Of each subset, the text's terms that it holds."""
    own, out = sorted(terms & lexicon), []
    for k, share in enumerate(fingerprints.SHARES):
        out.append(tuple(t for t in own if share == 1 or int(mix(np.array([t], np.uint64) + fingerprints._SALTS[k])[0]) < int(share * 2**64)))
    return out if own else [tuple(sorted(terms))]


@pytest.mark.parametrize("band", [(0.0, 1.0), (0.12, 0.6)])
def test_fingerprints_of_edited_texts(odd, odd_wide, none, band):
    out = fingerprints.edited_fingerprints(odd, band=band).collect()
    rows = next_order(odd_rows())
    texts = [r[1] or "" for r in rows]
    edited = [t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2] for k, t in enumerate(texts)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((repr(r.doc_id), r.n_chars, r.edited_sha256) for r in out) == sorted((repr(r[0]), len(t), sha(e)) for r, t, e in zip(rows, texts, edited))
    # two parts of fingerprints are equal where the subsets' terms are, worked out from sets of words
    terms, count = [brute_terms(t) for t in texts], Counter()
    for t in terms:
        count.update(t)
    lexicon = {t for t, n in count.items() if band[0] * len(texts) <= n <= band[1] * len(texts)}
    own, other = [brute_parts(t, lexicon) for t in terms], [brute_parts(brute_terms(e), lexicon) for e in edited]

    def like(a, b):
        if len(a) == 1 or len(b) == 1:
            return float(a == b)
        return sum(p == q and p != () for p, q in zip(a, b)) / sum(p != () or q != () for p, q in zip(a, b))

    want = sorted((repr(r[0]), sha(e), round(like(a, b), 9), round(like(a, c), 9)) for r, e, a, b, c in zip(rows, edited, own, other, own[1:] + own[:1]))
    assert sorted((repr(r.doc_id), r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out) == want
    prints = {}
    for r in out:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[4] == prints[5] and len(prints[5]) == 1 and prints[6] == prints[7] == prints[8]
    assert rows_of(fingerprints.edited_fingerprints(odd_wide, band=band)) == rows_of(fingerprints.edited_fingerprints(odd, band=band))
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_next_document_where_one_id_is_hot(spark):
    rows = [(5 if i % 3 else i, f"text {i % 40} " + "w " * (i % 7)) for i in range(900)] + [(None, f"n{i % 9}") for i in range(200)]
    out = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    rows = next_order(rows)
    cut = lambda t, u: hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()
    assert sorted((repr(r.doc_id), r.edited_sha256) for r in out) == sorted((repr(i), cut(t, u)) for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]))
    sizes = fingerprints.with_next(fingerprints.id_text(spark.createDataFrame(rows, "doc_id long, text string"))).groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) < 0.25 * len(rows)


def test_a_lexicon_too_large_to_send_meets_the_terms_in_a_join(spark, odd, none):
    for band in ((0.0, 1.0), (0.12, 0.6)):
        assert rows_of(fingerprints.edited_fingerprints(odd, band=band, lexicon_bytes=0)) == rows_of(fingerprints.edited_fingerprints(odd, band=band))
        assert rows_of(fingerprints.fingerprints(odd, band=band, lexicon_bytes=0)) == rows_of(fingerprints.fingerprints(odd, band=band))
    assert fingerprints.edited_fingerprints(none, lexicon_bytes=-1).count() == 0


@pytest.mark.parametrize("marks", [1, 3, 4096])
def test_next_document_over_very_many_ranges(spark, marks):
    """50,000 ranges and more, most of them empty; ids far apart, negative, hot and null."""
    rng = random.Random(9)
    rows = [(rng.choice((7, -(1 << 62), (1 << 62) + rng.randrange(3), rng.randrange(2000), rng.randrange(1 << 40))), f"text {i} " + "w" * rng.randrange(60)) for i in range(1500)] + [(None, f"n{i}") for i in range(40)]
    df = fingerprints.id_text(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    began = time.time()
    got = list(fingerprints._edited([fingerprints.with_next(df, 1, marks).coalesce(1).toArrow().combine_chunks().to_batches()[0]]))
    assert time.time() - began < 60
    pairs = [(t[0], x[0], x[2]) for told, texts in got for t, x in zip(told, texts)]
    order = next_order(rows)
    assert sorted(map(repr, pairs)) == sorted(repr((i, t, u)) for (i, t), (_, u) in zip(order, order[1:] + order[:1]))


def test_lexicon_is_the_band_whatever_the_parts(spark):
    rng = random.Random(3)
    texts = [" ".join({f"t{int(rng.paretovariate(0.4))}" for _ in range(60)}) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    count = Counter(t for text in texts for t in brute_terms(text))
    want = sorted(t for t, n in count.items() if 0.02 * 400 <= n <= 0.3 * 400)
    assert fingerprints.build_lexicon(df, (0.02, 0.3)).tolist() == want
    assert {r.term % (1 << 64): r.df for r in fingerprints.document_frequencies(df, every=100).collect()} == count


def test_fingerprints_outlast_edits(spark, sf):
    """Half of a text replaced leaves it nearer to itself than to the next document, for nine in ten."""
    out = fingerprints.op10_imatch(spark, sf.replace("0.001", "0.01")).collect()
    assert np.mean([r.near_edited > r.near_next for r in out]) >= 0.9
