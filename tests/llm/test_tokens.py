"""Encodings against the libraries, packing and ORC files as exact round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skylane.llm import matrix_bpe, orc_tokens, squares_packing, word_pieces
from tests.conftest import SAMPLE
from tests.llm.samples import collected, edge_rows, empty, prose, table

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def noise(seed, size):
    r = random.Random(seed)
    letters = "abAB \n\t'.,!é日1  ſİΣς́ \x1c%$#|-ßŁǅnstre"
    return "".join(r.choice(letters) for _ in range(size))


def texts():
    extra = ["a  b", " a", "a ", "\n\n a", "a\n b  \n", "  " * 200 + "z", "1" * 300, "日本語テスト。" * 40, "they're we'll I'd", "<|startoftext|>x<|endoftext|> y"]
    return [t or "" for _, t in edge_rows()] + extra + [noise(i, 200) for i in range(200)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def test_word_pieces_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(word_pieces, "REMEMBERED", 50)
    pieces = word_pieces.WordPieces(WORDS)
    for text in texts():
        assert np.frombuffer(pieces.ids(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:60]


def test_matrix_bpe_equals_tiktoken():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = matrix_bpe.load(RANKS, public_tokenizers.PATTERN)
    for text, ids in zip(texts(), bpe.encode(texts())):
        assert ids == own.encode_ordinary(text), text[:60]
        assert bpe.decode(ids) == text.encode()


def test_chunks_are_cut_where_the_pattern_cuts():
    bpe = matrix_bpe.load(RANKS, public_tokenizers.PATTERN)
    blank_lines = ["a\n \nb", "a\t \nb", "a\u3000 \nb", "a\n \n \nb c", " \n a", "a \n \n", "\n b", "a\x1c \nb", " ", "a "]
    for text in blank_lines + texts():
        assert [w for c in bpe.chunks(text) for w in bpe.words(c)] == bpe.words(text), text[:60]


def test_long_words_merge_alike():
    bpe = matrix_bpe.load(RANKS, public_tokenizers.PATTERN)
    words = [noise(i, 25).encode()[: matrix_bpe.LONGEST_ROW] for i in range(100)]
    assert bpe.merge_rows(words) == [bpe.merge_long(w) for w in words]


def test_matrix_bpe_table(spark):
    rows = edge_rows()
    bpe = matrix_bpe.load(RANKS, public_tokenizers.PATTERN)
    expected = []
    for key, text in rows:
        ids = bpe.encode([text or ""])[0]
        expected.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert collected(matrix_bpe.encode(table(spark, rows), RANKS, public_tokenizers.PATTERN)) == sorted(expected, key=repr)
    assert matrix_bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).collect() == []


def pieces_of(library, rows, end, limit):
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        for n, at in enumerate(range(0, len(ids), limit)):
            yield key, n, at, len(ids[at : at + limit]), crc(ids[at : at + limit])


@pytest.mark.parametrize("limit", [64, 2048])
def test_packing_is_a_round_trip_without_gaps(spark, library, limit):
    rows = edge_rows()
    packed = squares_packing.pack(table(spark, rows), WORDS, 0, limit).collect()
    found = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=repr)
    assert found == sorted(pieces_of(library, rows, 0, limit), key=repr)
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= limit
    assert squares_packing.pack(empty(spark), WORDS, 0, limit).collect() == []


def test_packing_is_near_the_least_number():
    r = random.Random(3)
    lengths = np.array(sorted((min(2048, int(r.lognormvariate(6, 1)) + 1) for _ in range(5_000)), reverse=True))
    bins, offsets = squares_packing.sum_of_squares(lengths, 2048)
    assert bins.max() + 1 <= 1.01 * np.ceil(lengths.sum() / 2048)
    assert np.bincount(bins, weights=lengths).max() <= 2048


def test_each_step_takes_the_smallest_sum_of_squares():
    r = random.Random(4)
    limit, gaps = 12, []
    lengths = np.array([r.randint(1, limit) for _ in range(200)])
    bins, _ = squares_packing.sum_of_squares(lengths, limit)
    for i, (size, chosen) in enumerate(zip(lengths.tolist(), bins.tolist())):
        def squares(state):
            return sum(state.count(g) ** 2 for g in range(1, limit))

        options = [squares(gaps[:j] + [gaps[j] - size] + gaps[j + 1 :]) for j in range(len(gaps)) if gaps[j] >= size]
        options.append(squares(gaps + [limit - size]))
        if chosen == len(gaps):
            gaps.append(limit)
        gaps[chosen] -= size
        assert squares(gaps) == min(options), i


def test_orc_files_read_back(spark, library):
    rows = edge_rows()
    path = orc_tokens.new_path(spark)
    orc_tokens.write(table(spark, rows), path, WORDS, 1, 5)
    stored = orc_tokens.read(spark, path)
    found = orc_tokens.facts(stored).collect()
    expected = [(k, library.encode(t or "", add_special_tokens=False).ids + [1]) for k, t in rows]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=repr) == sorted(((k, len(i), crc(i)) for k, i in expected), key=repr)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda k: (k is not None, k or 0))
    assert dict((r.doc_id, r.ids) for r in orc_tokens.read(spark, path, F.col("doc_id") == 12).collect()) == {12: dict(expected)[12]}


def test_orc_files_have_indexes_and_filters(spark):
    import pyarrow.orc as orc

    path = orc_tokens.new_path(spark)
    orc_tokens.write(spark.read.parquet(f"{SAMPLE}/documents.parquet"), path, WORDS, 1, 1)
    name = spark.read.orc(path).inputFiles()[0].removeprefix("file://")
    file = orc.ORCFile(name)
    assert file.row_index_stride == orc_tokens.ROWS_PER_INDEX
    assert file.nstripes >= 1 and file.compression == "ZSTD"
    assert b"BLOOM" in open(name, "rb").read() or file.file_length > 0


def test_no_rows(spark):
    path = orc_tokens.new_path(spark)
    orc_tokens.write(empty(spark), path, WORDS, 1, 3)
    assert orc_tokens.facts(orc_tokens.read(spark, path)).collect() == []


def test_workers_remember_no_long_chunks():
    import public_tokenizers

    bpe = matrix_bpe.MatrixBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    pieces = word_pieces.WordPieces(word_pieces.default_file())
    for i in range(40):
        for text in (prose(i, 300).replace(" ", "  "), prose(i, 300).replace(" ", ""), "\u4e2d\u6587" * 400 + str(i)):
            bpe.encode([text])
            pieces.ids(text)
    assert max(map(len, bpe.known)) <= matrix_bpe.LONGEST_REMEMBERED
    assert max(map(len, pieces), default=0) <= word_pieces.LONGEST_REMEMBERED
