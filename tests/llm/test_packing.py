import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.packing import STEP_TOKENS, encode, pack, plan, sequences

from .common import docs, rows, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_tokenizers(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["<|endoftext|> a", " \n\t x  y\r\n", "日本語 é́ 🙂🙂", "it's we'll I'D 12345 #$%", "x" * 3000, "   .", "a" + " " * 500]
    for text, e in zip(texts, reference().encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(PATH, text, 0).tolist() == e.ids + [0]


def test_long_runs_end_soon():
    assert len(encode(PATH, "x" * 1_000_000, 0)) > 1000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([1, 4, 32, 64]))
def test_plan_is_exact_and_full(lengths, window):
    seen = defaultdict(list)
    for size, pieces in plan(lengths, window):
        assert size & (size - 1) == 0 and size <= window and sum(n for *_, n in pieces) == size
        for doc, start, n in pieces:
            assert n > 0
            seen[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[doc]):
            assert start == at
            at += k
        assert at == n


def test_round_trip(spark):
    data = rows(5)
    out = pack(docs(spark, data).repartition(3), PATH, block_bytes=40_000).collect()
    want = defaultdict(list)
    for i, t in data:
        want[i].append(np.array([*reference().encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length, r.window))
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in want[r.doc_id])
    for pieces in sequences.values():
        at = 0
        for offset, n, window in sorted(pieces):
            assert offset == at
            at += n
        assert at == window
    assert sum(r.length for r in out) == sum(len(x) for v in want.values() for x in v)
    assert pack(docs(spark, []), PATH).collect() == []


def test_few_pieces():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 3000) for _ in range(2000)]
    made = plan(lengths, 1024)
    least = sum(-(-n // 1024) for n in lengths)
    assert sum(len(p) for _, p in made) < 1.5 * least
    assert sum(n for n, _ in made if n == 1024) > 0.5 * sum(lengths)


def test_documents_can_be_read_from_the_ids(spark):
    data = [(i, t) for i, (_, t) in enumerate(rows(5))]
    out = sequences(docs(spark, data).repartition(3), PATH, block_bytes=40_000).collect()
    pieces = defaultdict(list)
    for r in out:
        assert len(r.ids) == r.length
        pieces[r.doc_id].append((r.start, r.ids))
    t = reference()
    for i, text in data:
        ids = [x for _, own in sorted(pieces[i]) for x in own]
        assert ids[-1] == 0 and t.decode(ids[:-1]) == (text or "")
    assert "ids" in corpus_pipeline.pack(spark, docs(spark, data), "").columns


def test_added_tokens_are_those_of_tokenizers(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n y", "<|endoftext| >", "日本<|endoftext|>語 <|endoftext|>  "]
    t = Tokenizer.from_file(PATH)
    want = [t.encode(x, add_special_tokens=False).ids + [0] for x in texts]
    assert 50256 in want[0] and [encode(PATH, x, 0, added=True).tolist() for x in texts] == want
    out = sequences(docs(spark, list(enumerate(texts))), PATH).orderBy("doc_id", "start").collect()
    assert [[x for r in out if r.doc_id == i for x in r.ids] for i in range(len(texts))] == want


def test_step_groups_are_equal_over_blocks(spark):
    rng = random.Random(3)
    data = [(i, words(rng, rng.randrange(1, 400))) for i in range(400)]
    tokens, order = defaultdict(int), defaultdict(list)
    for r in pack(docs(spark, data).coalesce(1), PATH, window=64, block_bytes=10_000).orderBy("sequence_id").collect():
        if r.step_group not in tokens:
            order[r.window].append(r.step_group)
        tokens[r.step_group] += r.length
    assert len(order[64]) > 3
    for groups in order.values():
        assert all(tokens[g] == STEP_TOKENS for g in groups[:-1]) and tokens[groups[-1]] <= STEP_TOKENS
