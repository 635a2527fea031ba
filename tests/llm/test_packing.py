from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from specflow.llm.common import WordPieces, vocabulary
from specflow.llm.packing import cut, first_fit, pack

PATH = vocabulary("word_bpe_49k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def test_word_pieces_are_the_tokenizers_ids(corpus):
    texts = [t or "" for _, t, *_ in corpus] + ["日本語 №5 ½ ǅ İ ſ", "don't we'll 's", "a\u0000b \ufeff x", "퟿ é e\u0301 \u0301x"]
    pieces = WordPieces(PATH, most=50)
    for text in texts:
        got = np.frombuffer(pieces.encode([text.encode()])[0], "<u4").tolist()
        assert got == ids_of(text)[:-1], text[:40]


def test_cut_covers_a_document_with_little_waste():
    for length in [*range(1, 5_000, 7), 2047, 2048, 2049, 4096]:
        pieces = cut(length)
        assert sum(pieces) == length and max(pieces) <= 2048
        waste = sum(2048 / (2048 // p) - p for p in pieces)
        assert waste <= 2048 / 32 + 4


def test_first_fit():
    assert first_fit([6, 5, 4, 3, 2], 10) == [(0, 0), (1, 0), (0, 1), (1, 1), (1, 2)]


def test_pieces_fill_sequences(documents):
    got = [r.asDict() for r in pack(documents, with_ids=True).collect()]
    want = defaultdict(list)
    for r in documents.collect():
        want[r["doc_id"]].append(ids_of(r["text"]))
    pieces = defaultdict(list)
    for r in got:
        assert crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        pieces[r["doc_id"]].append(r)
    assert {k: sum(map(len, v)) for k, v in want.items()} == {k: sum(r["length"] for r in v) for k, v in pieces.items()}
    for key, rows in pieces.items():
        if len(want[key]) == 1:
            rows.sort(key=lambda r: r["start"])
            assert np.frombuffer(b"".join(r["ids"] for r in rows), "<u4").tolist() == want[key][0]
            assert {r["doc_tokens"] for r in rows} == {len(want[key][0])}
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in got)
    assert len(sequences) <= total / 2048 / 0.95 + 2


@pytest.mark.parametrize("parts", [1, 7])
def test_harmonic_bins_hold_a_fixed_number(spark, parts):
    df = spark.createDataFrame([(i, "a " * 681) for i in range(20)], "doc_id bigint, text string").repartition(parts)
    got = pack(df).groupBy("sequence_id").count().collect()
    assert sorted(r["count"] for r in got) == [2] + [3] * 6


def test_empty_table(nothing):
    assert pack(nothing).count() == 0
