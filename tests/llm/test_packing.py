import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from cloakframe.llm import packing as op


def check(df):
    t = Tokenizer.from_file(public_tokenizers.path(op.TOKENIZER))
    want = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        want[r.doc_id].append(t.encode(r.text or "", add_special_tokens=False).ids + [op.EOS_ID])
    pieces, windows = defaultdict(list), defaultdict(list)
    rows = op.pack(df).collect()
    for r in rows:
        ids = array("I", bytes(r.ids)).tolist()
        assert len(ids) == r.length > 0
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length, r.tier, r.step_group))
    for i, docs in want.items():
        assert sorted(x for _, ids, _ in pieces[i] for x in ids) == sorted(x for d in docs for x in d)
        if len(docs) == 1:
            joined = []
            for start, ids, n in sorted(pieces[i]):
                assert start == len(joined) and n == len(docs[0])
                joined += ids
            assert joined == docs[0]
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, length, tier, _ in sorted(parts):
            assert offset == at
            at += length
            assert tier == sum(p[1] for p in parts) <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    return windows


def test_edge_rows(edge):
    check(edge)


def test_real_rows(sample):
    windows = check(sample)
    steps = defaultdict(int)
    for parts in windows.values():
        steps[parts[0][3]] += sum(p[1] for p in parts)
    assert max(steps.values()) <= op.STEP_WINDOWS * 2048


def test_words_split_like_the_tokenizer():
    plain = Tokenizer.from_file(public_tokenizers.path(op.TOKENIZER))
    rng = random.Random(5)
    odd = ["a  b\n\n c\t\td  ", "it's  we'LL 're", "", " ", "x\x1cy", "é1²", "日本 ¿qué? «x»", "<|endoftext|> x", "a b", " lead", "trail ", "\n a", "a\n b", "a \nb"]
    odd += ["".join(rng.choice("ab1'.! \n\té") for _ in range(rng.randrange(30))) for _ in range(2000)]
    odd += ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b <|endoftext| >", "w" * 500]
    for t in odd:
        assert array("I", op.coder(op.TOKENIZER).encode(t)).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
    plain.encode_special_tokens = True
    for t in odd:
        assert array("I", op.coder(op.TOKENIZER, plain=True).encode(t)).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_digest_column(spark):
    row = op.query(spark, "/root/testdata/sf0.001").first()
    assert "ids" not in row and row.ids_crc32 >= 0
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    from pyspark.sql import functions as F

    got = op.pack(df).select("ids", F.crc32("ids").alias("c")).first()
    assert got.c == zlib.crc32(bytes(got.ids))


def test_empty(nothing):
    assert op.pack(nothing).count() == 0
