import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablelens.llm.packing import encoder, pack, plan
from tablelens.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(tokenizer_path())
ENCODE = encoder(tokenizer_path())


@pytest.fixture(scope="module")
def tokenizer():
    return TOKENIZER


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=40))
@settings(max_examples=60, deadline=None)
def test_plan_uses_every_piece_once_and_overfills_nothing(histogram):
    used = Counter()
    for combo, times in plan(histogram, 64):
        assert times > 0 and sum(n * k for n, k in combo.items()) <= 64
        for n, k in combo.items():
            used[n] += k * times
    assert used == Counter(histogram)


def test_plan_finds_exact_complements():
    assert sum(t for _, t in plan({60: 3, 40: 2, 20: 2, 30: 2, 10: 4}, 100)) == 4  # 380 tokens
    assert sum(t for _, t in plan({1: 250}, 100)) == 3


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é\n\t  .,'s12|<>語")) | st.characters(codec="utf-8")), max_size=4))
@settings(max_examples=200, deadline=None)
def test_word_by_word_ids_are_the_whole_texts_ids(texts):
    texts = [*texts, "x <|endoftext|> y", "a  b", "a \n b c", "it's 12 3"]
    assert [np.frombuffer(ENCODE(x), "<u4").tolist() for x in texts] == \
        [TOKENIZER.encode(x, add_special_tokens=False).ids for x in texts]


def check(rows, docs, tokenizer, capacity):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == {d for d, _ in docs}
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert sum(r.length for r in own) == len(ids) and all(r.length == capacity for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in own)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_documents_round_trip(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op8_best_fit_packing"](spark, SF).collect()
    n = check(rows, docs, tokenizer, 1024)
    assert n <= -(-sum(r.length for r in rows) // 1024) + 2


def test_odd_rows(spark, tokenizer):
    docs = [(1, None), (2, ""), (3, "word " * 3000), (4, "a  b"), (5, "same"), (6, "same")]
    df = spark.createDataFrame([(*d, 0, 9) for d in docs], "doc_id long, text string, length int, rank int")
    check(pack(df, tokenizer_path(), 64).collect(), docs, tokenizer, 64)
    twice = pack(df.union(df), tokenizer_path(), 64)
    assert twice.count() == 2 * pack(df, tokenizer_path(), 64).count()
    assert pack(df.limit(0), tokenizer_path()).count() == 0
    assert pack(spark.createDataFrame([(None, "x")], "doc_id long, text string"), tokenizer_path()).first().doc_id is None
