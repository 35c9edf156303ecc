import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leakguard.llm import packing, token_files
from leakguard.llm.shared import new_path
from leakguard.llm.tokens import PieceEncoder, tokenizer_path

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")
PIECES = st.lists(st.sampled_from(["a", "The", "é", "ß", "Σ", " ", "  ", "\n", "\t", "'s", ".", "1", "\x1c", "́", "<|endoftext|>", "\U0001f600", "İ", "_", "ing"]))


def direct(name):
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: list(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", NAMES)
def test_pieces_equal_whole_texts(name, docs):
    encoder, whole = PieceEncoder(tokenizer_path(name), memory=100_000), direct(name)

    @settings(max_examples=150, deadline=None)
    @given(st.one_of(PIECES.map("".join), st.text(max_size=40)))
    def same(text):
        encoder.age()
        assert array("I", encoder.encode(text)).tolist() == whole(text)

    same()
    for r in docs.limit(40).collect():
        encoder.age()
        assert array("I", encoder.encode(r.text)).tolist() == whole(r.text)


@pytest.mark.parametrize("table", ["docs", "odd_docs"])
def test_files_give_the_ids_back(spark, request, table):
    docs, folder, whole = request.getfixturevalue(table), new_path(spark, "test-tokens"), direct(NAMES[0])
    token_files.write_tokens(docs, folder, tokenizer_path(NAMES[0]), end_id=2, length=64)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(spark, folder).collect())
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    start = 0
    for at, _, n, _ in got:
        assert at == start
        start += n
    assert [d for _, d, _, _ in got] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d))
    sums = lambda text: (len(ids := [*whole(text or ""), 2]), zlib.crc32(np.array(ids, "<u4").tobytes()))
    key = lambda x: (x[0] is not None, *x)
    assert sorted(((d, n, c) for _, d, n, c in got), key=key) == sorted(((r.doc_id, *sums(r.text)) for r in rows), key=key)


def test_sequences_are_views_of_equal_length(spark, docs):
    folder, whole = new_path(spark, "test-tokens"), direct(NAMES[0])
    index = token_files.write_tokens(docs.coalesce(1), folder, tokenizer_path(NAMES[0]), end_id=2, length=32)
    first = index.orderBy("shard", "begin").first()
    reader = token_files.TokenFile(first.file)
    ids = [*whole(docs.filter(docs.doc_id == first.doc_id).first().text), 2]
    sequence, mask = reader.sequence(1)
    assert len(sequence) == len(mask) == 32 and mask.all() and not sequence.flags.owndata
    assert sequence.tolist()[: len(ids) - 32] == ids[32:64][: len(sequence)]


def test_no_documents(spark, no_docs):
    folder = new_path(spark, "test-tokens")
    token_files.write_tokens(no_docs, folder, tokenizer_path(NAMES[0]), end_id=2)
    assert token_files.read_tokens(spark, folder).count() == 0
    assert packing.pack(no_docs, tokenizer_path(NAMES[1]), 2).count() == 0


@pytest.mark.parametrize("table", ["docs", "odd_docs"])
@pytest.mark.parametrize("group", [50, packing.GROUP_PIECES])
def test_packing_is_whole_and_gapless(request, table, group):
    docs, whole, size = request.getfixturevalue(table), direct(NAMES[1]), 128
    got = packing.pack(docs, tokenizer_path(NAMES[1]), 2, size, group).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*whole(r.text or ""), 2]
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((r.doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    key = lambda x: (x[0] is not None, *x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    if table == "docs":
        assert len(bins) <= 1.03 * -(-sum(w[3] for w in want) // size) + 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_local_search_keeps_pieces_and_never_adds_bins(sizes):
    bins = packing.best_fit(sizes, 100)
    count = len(bins)
    better = packing.improve(bins, sizes, 100)
    assert sorted(i for b in better for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in better) and len(better) <= count
