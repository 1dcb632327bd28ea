"""Binary records and sentence pieces: exact round trips, and equality with the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from annalake.llm import sentence_pieces, shingles, token_records

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "the", "ing", " ", "  ", "   ", "\n", " \n", "\t", "é", "中", "文", "ß", "12", "'s", " don't", "!!", " ", "　", "\u0085", "▁", "😀", "<|endoftext|>", "<0x0A>", "th", "er", "\x00"]


def texts(seed, n, most=30):
    rng = random.Random(seed)
    return ["", " ", "  a ", *["".join(rng.choice(PARTS) for _ in range(rng.randrange(most))) for _ in range(n)]]


def split(ids, bounds):
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_pieces_between_blanks_encode_on_their_own():
    own, library = token_records.PieceEncoder(BPE), Tokenizer.from_file(BPE)
    given = texts(1, 1500)
    for i in range(0, len(given), 100):
        part = given[i : i + 100]
        assert split(*own.encode(pa.array(part))) == [library.encode(t, add_special_tokens=False).ids for t in part]


def test_search_equals_the_library_and_decodes_to_the_text():
    own, library = sentence_pieces.SentenceEncoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    given = [*texts(2, 1500), "".join(random.Random(3).choices("abcdefghijklmnop中文 ", k=4000))]
    for i in range(0, len(given), 50):
        part = given[i : i + 50]
        ids, bounds = own.encode(pa.array(part))
        assert split(ids, bounds) == library.encode(part)
        data, edges = own.decode(ids, bounds)
        assert [data[a:b].tobytes().decode() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [t.replace("▁", " ") for t in part]


def test_texts_that_defeat_a_polynomial_hash():
    """The word of Thue and Morse and its complement have one hash modulo 2^64 whatever the base."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    own, library = token_records.PieceEncoder(BPE), Tokenizer.from_file(BPE)
    assert split(*own.encode(pa.array([word, other, word]))) == [library.encode(t, add_special_tokens=False).ids for t in (word, other, word)]
    pieces, model = sentence_pieces.SentenceEncoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for texts in ([word], [other], [word, other]):
        assert split(*pieces.encode(pa.array(texts))) == model.encode(texts)
    a, b = shingles.sets(pa.array([word, other]))
    assert len(a) == len(b) == 1 and a[0] != b[0]


def test_search_keeps_a_bounded_window():
    model = sentence_pieces.PieceModel(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(9)
    text = "".join(rng.choice("theringandsofo") for _ in range(5000))
    one, ids, widest = sentence_pieces.Search(model), [], 0
    for c in sentence_pieces.BLANK + text:
        for found in one.feed(c):
            ids += found
        widest = max(widest, len(one.text))
    assert ids + one.finish() == library.encode(text)
    assert widest <= 8 * model.longest


def test_frames_detect_damage():
    data = b"".join(token_records.frame(token_records.pack(i, np.arange(i, dtype=np.uint16))) + b"\n" for i in range(5))
    found = [token_records.unpack(p) for _, p in token_records.frames(data)]
    assert [(i, ids.tolist()) for i, ids in found] == [(i, list(range(i))) for i in range(5)]
    assert token_records.unpack(memoryview(token_records.pack(None, np.zeros(1, np.uint32))))[0] is None
    for at in (0, 9, 14, len(data) - 3, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(token_records.frames(bytes(broken)))
    with pytest.raises(ValueError):
        list(token_records.frames(data[:-4]))


def test_records_of_odd_documents(spark, odd, no_docs, tmp_path):
    folder = f"file://{tmp_path}/out"
    found = token_records.token_records(odd, BPE, 2, folder).collect()
    library = Tokenizer.from_file(BPE)
    wanted = sorted(((-1 if r.doc_id is None else r.doc_id) for r in odd.collect()))
    found.sort(key=lambda r: r.start)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in found] == wanted
    ids = sorted((r.doc_id or 0, zlib.crc32(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in odd.collect())
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in found) == ids
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found[:-1]]]).tolist()
    index = spark.read.parquet(f"{folder}/index")
    again = token_records.read_shuffled(spark, f"{folder}/records", index, seed=3).collect()
    assert sorted((r.doc_id or 0, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in again) == ids
    assert token_records.token_records(no_docs, BPE, 2).count() == 0


def test_sentence_pieces_of_odd_documents(odd, no_docs):
    rows = sentence_pieces.round_trip(odd, PIECES).collect()
    assert len(rows) == odd.count()
    assert all(r.same for r in rows if r.doc_id != 9)  # its text has U+2581 itself
    encoded = sentence_pieces.encode(odd, PIECES)
    decoded = sorted(((r.doc_id or 0), r.text) for r in sentence_pieces.decode(encoded, PIECES).collect())
    assert decoded == sorted(((r.doc_id or 0), (r.text or "").replace("▁", " ")) for r in odd.collect())
    assert sentence_pieces.round_trip(no_docs, PIECES).count() == 0
