"""Encoding, counts, packing and id files against the tokenizer library, and the awkward inputs."""

import hashlib
import unicodedata
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from urbangrid.llm import bpe, codec, idfiles, packing  # noqa: E402

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [
    "", "   ", "\t\n\x0b", "a", "<|endoftext|>", "x<|endoftext|>y <|startoftext|> <|endof", "it's we'LL 'S 're", "İstanbul ΑΣ ß ² ½ x_y__", "東京 123 é z\x1c\x85q",
    "🎉 ok 👨‍👩‍👧 ﬁ Ⅷ ٣", "a" * 3000, "ab" * 900 + " " + "é" * 500, "€–“x”… 3.14 --- ???!!", "Word word WORD\r\n\r\n  end  ", "  thin", "aaaa aaa aa a aaaaa",
]


def rows_of(spark, texts=ODD):
    rows = [(i, t, "n", 0) for i, t in enumerate(texts)] + [(900, None, None, 1), (3, "a", "repeated", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")  # clashing names


def ids_of(path, text):
    return tokenizers.Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def le(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("speculate", [True, False])
def test_ids_equal_the_library(path, speculate):
    enc = bpe.BpeEncoder(path, 1000, speculate)
    words = [" ".join(np.random.default_rng(k).choice(["th", "er", "ou", "ing", "eau", "ß", "x9", "!"], 6)).replace(" ", "") for k in range(300)]
    for text in [*ODD, " ".join(words)]:
        assert enc.encode(text).tolist() == ids_of(path, text)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_batch([*ODD, None])] == [ids_of(path, t) for t in [*ODD, None]]
    if speculate:
        assert 0 < enc.merged_words < enc.verified_words


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_combining_marks_in_any_order(path):
    """Every combining mark of the running Unicode tables, in rows of two and more, among letters that compose and letters that do not."""
    lib, enc = tokenizers.Tokenizer.from_file(path), bpe.BpeEncoder(path, 5000, False)
    marks = [chr(c) for c in range(0x300, 0x20000) if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me")]
    letters = [*"aeiosnAEC 3-.", "\u00e9", "\u1e0b", "\u0915", "\u0d15", "\uac00", "\u1100", "\u1161", "\u0627", "\u212b", "\U00011131"]
    rng = np.random.default_rng(31)
    texts = ["\u0366\u0d3b", "s\u0f35\u0cbce\u08d1\u08ffs\U00010d24\u0bcd", *("".join(("a", *pair)) for pair in zip(marks, marks[1:]))]
    for _ in range(4000):
        texts.append("".join(rng.choice(letters if rng.random() < 0.4 else marks) for _ in range(rng.integers(2, 12))))
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_batch(texts)] == want


def test_exact_merging_agrees_with_the_plain_procedure():
    enc = bpe.BpeEncoder(BYTE, 1000)
    words = ["aaaaa", "therewhth", "ouououer", "lowest", " unbelievable", "x" * 40]
    for w, packed in zip(words, bpe.BpeEncoder(BYTE, 1000, False).encode_words(words)):
        assert np.frombuffer(packed, "<u4").tolist() == enc.merge_exactly(w)


def test_cache_is_bounded():
    enc = bpe.BpeEncoder(BYTE, 50)
    for k in range(20):
        enc.encode_batch([f"word{k}a{i}" for i in range(30)])
        assert len(enc.cache) <= 120


def test_digests(spark):
    lib = tokenizers.Tokenizer.from_file(BYTE)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in codec.digests(rows_of(spark), BYTE).collect())
    want = []
    for doc, text in [*enumerate(ODD), (900, None), (3, "a")]:
        ids = ids_of(BYTE, text)
        want.append((doc, len(ids), hashlib.sha256(le(ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    full = {r.doc_id: r for r in codec.encode_decode(rows_of(spark), BYTE).collect()}
    assert full[6].ids == ids_of(BYTE, ODD[6]) and full[6].decoded == ODD[6]


def test_counts(spark):
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in codec.count_tokens(rows_of(spark), WORD, limit=100, sample_docs=3).collect())
    want = sorted((d, len((t or "").encode()), len(ids_of(WORD, t)), len(ids_of(WORD, t)) > 100) for d, t in [*enumerate(ODD), (900, None), (3, "a")])
    assert got == want


def test_table_is_bounded(spark):
    table = codec.frequent_lengths(rows_of(spark, [*ODD, *["one two three four five six"] * 5]), WORD, 100, 65_536, max_bytes=120)
    assert len(table.lengths) and table.nbytes() <= 120
    # a word that does not fit is passed over, not the end of the table
    texts = ["q" * 200 + " cat cat"] * 9
    table = codec.frequent_lengths(rows_of(spark, texts), WORD, 100, max_bytes=100)
    assert table.find(["cat", "q" * 200]).tolist() == [1, -1]


def test_table_keeps_every_word():
    lengths = {"the": 1, "\0": 1, "unbelievable": 3, "\0\0": 2, "é𝄞": 4, "x": 70_000, **{f"w{i}": i for i in range(5000)}}
    table = codec.LengthTable(lengths)
    assert dict(zip(lengths, table.find([*lengths]).tolist())) == lengths and len(table.slots) <= 4 * len(lengths)
    assert table.find(["", "\0the", "w5000", "é"]).tolist() == [-1] * 4
    assert codec.LengthTable({}).find(["a"]).tolist() == [-1] and table.find([]).tolist() == []


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(codec.xxhash, "xxh3_64_intdigest", lambda w: len(w) % 3)
    lengths = {f"w{i}": i for i in range(200)}
    table = codec.LengthTable(lengths)
    assert dict(zip(lengths, table.find([*lengths]).tolist())) == lengths and table.find(["w200", "nope"]).tolist() == [-1, -1]


def test_counts_of_any_characters_and_lengths(spark):
    controls = "".join(map(chr, range(32))) + " ".join(map(chr, range(32))) + "\x7f\x80\x9f\u2028\ufeff"
    texts = ["the \0 unbelievable cat \0 xylophone \0\0 the cat", "\0", "q\0z " * 50, controls, "qz" * 150_000] * 2
    lib = tokenizers.Tokenizer.from_file(WORD)
    n = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert n[4] > 200_000
    for sample in (4000, 1):
        got = sorted((r.doc_id, r.n_tokens) for r in codec.count_tokens(rows_of(spark, texts), WORD, sample_docs=sample).collect())
        assert got == sorted([*enumerate(n), (900, 0), (3, len(ids_of(WORD, "a")))])


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_long_words_equal_the_library(path):
    lib, enc = tokenizers.Tokenizer.from_file(path), bpe.BpeEncoder(path, 1000, False)
    texts = ["qz" * 100_000, "ab\0" * 30_000, "-" * 100_000, "é" * 50_000, "\0" * 10_000]
    for text in texts:
        assert enc.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert enc.cache.used <= max(1000, bpe.weight([texts[-1]]) + 1)


def test_empty_tables(spark):
    none = rows_of(spark).limit(0)
    assert codec.digests(none, BYTE).collect() == [] and codec.count_tokens(none, WORD).collect() == [] and packing.pack(none, WORD).collect() == []


def test_differencing_and_windows():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (5, 3), (40, 7), (3, 5)):
        sizes = rng.integers(1, 200, n).tolist()
        dealt = packing.difference(sizes, k)
        assert sorted(i for w in dealt for i in w) == [*range(n)] and len(dealt) == k
    sizes = rng.integers(1, 257, 600).tolist()
    sums = [sum(sizes[i] for i in w) for w in packing.windows(sizes, 2048)]
    assert max(sums) <= 2048 and max(sums) - min(sums) <= 16
    # the number of windows rises where the least possible does not fit
    assert len(packing.windows([1500, 1500, 1096], 2048)) == 3


def test_pieces_cover_every_id_once(spark):
    texts = [*ODD, "the quick brown fox " * 1500]
    rows = packing.pack(rows_of(spark, texts).filter("doc_id <> 3"), WORD).collect()
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in [*((i, t) for i, t in enumerate(texts) if i != 3), (900, None)]:
        ids, at = [*ids_of(WORD, text), 1], 0
        for r in sorted(by[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(le(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = idfiles.pack_bits(ids, bits)
    assert len(packed) == -(-1001 * bits // 8) and idfiles.unpack_bits(packed, 1001, bits).tolist() == ids.tolist()
    file = idfiles.IdFile(idfiles.to_file(np.array([5, 9]), np.array([400, 601]), ids, bits, 64))
    assert file.document(1).tolist() == ids[400:].tolist() and file.read(63, 3).tolist() == ids[63:66].tolist() and file.read(5, 0).tolist() == []


def test_width():
    assert [idfiles.width(n) for n in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_vocabulary_size_is_the_files():
    assert bpe.vocabulary_size(BYTE) == tokenizers.Tokenizer.from_file(BYTE).get_vocab_size() == 50_257


def test_id_files(spark, tmp_path):
    folder = f"file://{tmp_path}/ids"
    idfiles.write_ids(rows_of(spark), BYTE, folder, file_ids=2000, block_ids=100)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in idfiles.read_ids(spark, folder, digest=True).orderBy("start").collect()]
    docs = sorted([*enumerate(ODD), (900, None), (3, "a")], key=lambda x: x[0])
    want, at = [], 0
    for doc, text in docs:
        ids = [*ids_of(BYTE, text), 0]
        want.append((doc, at, len(ids), zlib.crc32(le(ids))))
        at += len(ids)
    assert got == want
    assert {tuple(r.ids) for r in idfiles.read_ids(spark, folder).filter("doc_id = 6").collect()} == {(*ids_of(BYTE, ODD[6]), 0)}
    idfiles.write_ids(rows_of(spark).limit(0), BYTE, folder + "-none")
    assert idfiles.read_ids(spark, folder + "-none").collect() == []
