import json
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemill.llm.packing import Encoder, all_cuts, cuts, op5_packing, pack, pack_lengths, sum_of_squares, tokenizer_file


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_file())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aAé '’st\n\t  .,!1²½ñ_\x1c\x85 ̀日🙂"), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_ids_are_the_tokenizers(texts):
    encode = Encoder(tokenizer_file())
    for _ in range(2):  # the second time from memory
        got = [np.frombuffer(b, "<u4").tolist() for b in encode(texts)]
        assert got == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_strings(tokenizer):
    texts = ["<|endoftext|> a", "it's we'll I'd  'S", "\n\n a\n b", "a\r\nb  c", " \n", "", "x" * 5000]
    assert [np.frombuffer(b, "<u4").tolist() for b in Encoder(tokenizer_file())(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("'stmdrevlSL  \n\"1é-"), max_size=14), max_size=6))
def test_contractions_and_spaces(texts):
    encode = Encoder(tokenizer_file())
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_what_is_remembered_is_bounded(docs):
    encode = Encoder(tokenizer_file(), most=500)
    for r in docs.collect()[:60]:
        assert np.frombuffer(encode([r.text or ""])[0], "<u4").tolist() == encode.tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert len(encode.known) <= 500 + len((r.text or "").encode())


def test_a_tokenizer_that_splits_otherwise_gets_whole_texts(tmp_path):
    with open(tokenizer_file(), encoding="utf-8") as f:
        told = json.load(f)
    told["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(told))
    encode = Encoder(str(tmp_path / "other.json"))
    texts = ["Words and 'more", "", " x"]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts] and not encode.known


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=20), st.integers(1, 20))
def test_cuts_of_many(sizes, length):
    per, start, n = all_cuts(np.array(sizes), length)
    assert list(zip(start.tolist(), n.tolist())) == [c for s in sizes for c in cuts(s, length)] and per.sum() == len(start)


def test_cuts():
    assert cuts(5, 10) == [(0, 5)] and cuts(10, 10) == [(0, 10)] and cuts(20, 10) == [(0, 10), (10, 10)] and cuts(23, 10) == [(0, 3), (3, 10), (13, 10)]


def brute_sum_of_squares(lengths, capacity):
    gaps, out = [], []
    for s in lengths:
        best = None
        for i, g in enumerate(gaps):
            if g >= s:
                trial = [*gaps[:i], g - s, *gaps[i + 1 :]]
                cost = sum(trial.count(x) ** 2 for x in set(trial) if x)
                if best is None or (cost, g) < best[0]:
                    best = ((cost, g), i)
        if best is None:
            gaps.append(capacity - s)
            out.append(capacity)
        else:
            out.append(best[0][1])
            gaps[best[1]] -= s
    return out, len(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=30))
def test_the_rule(lengths):
    at, offset = sum_of_squares(np.array(lengths, np.int64), 12)
    want, n = brute_sum_of_squares(lengths, 12)
    assert (12 - offset).tolist() == want and (at.max() + 1 if len(at) else 0) == n


def test_few_sequences():
    rng = np.random.default_rng(5)
    lengths = np.minimum(1024, rng.lognormal(6, 1, 6000).astype(np.int64) + 1)
    at, _ = pack_lengths(lengths)
    assert at.max() + 1 <= 1.01 * max(-(-lengths.sum() // 1024), (lengths > 512).sum())


def check(rows, texts, tokenizer, length=1024):
    sequences = defaultdict(list)
    docs = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for spans in sequences.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at and n > 0
            at += n
        assert at <= length
    for doc, text in texts:
        ids = ids_of(tokenizer, text)
        want = [(i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for i, (s, n) in enumerate(cuts(len(ids), length))]
        have = [(r.piece, r.start, r.length, r.ids_crc32) for r in docs[doc]]
        assert all(have.count(w) >= want.count(w) for w in want)
    assert sum(len(cuts(len(ids_of(tokenizer, t)), length)) for _, t in texts) == len(rows)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_documents(request, tokenizer, which):
    df = request.getfixturevalue(which)
    texts = [(r.doc_id, r.text) for r in df.collect()]
    rows = op5_packing(df).collect()
    check(rows, texts, tokenizer)
    total = sum(len(ids_of(tokenizer, t)) for _, t in texts)
    assert len({r.sequence_id for r in rows}) <= 1.02 * total / 1024 + 2


def test_many_blocks_and_empty(odd, empty, tokenizer):
    check(pack(odd, length=16, block_pieces=50).collect(), [(r.doc_id, r.text) for r in odd.collect()], tokenizer, 16)
    assert op5_packing(empty).count() == 0
