import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parcel.llm import bpe
from tests.llm.util import frame, prose, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def want(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_digests_equal_the_tokenizer(spark, tok):
    pairs = rows([(20, "x" * 3000), (21, "don't I'LL we've 12½² ___ ΑΣ İ ǅ É́ a\x1cb"),
                  (22, "<|startoftext|>hi<|endoftext|>")])
    got = bpe.encode_documents(frame(spark, pairs), PATH).collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(
        want(tok, t) for _, t in pairs)


def test_tokens_and_empty_table(spark, tok):
    df = frame(spark, rows())
    assert bpe.encode_documents(df.where("false"), PATH).count() == 0
    row = bpe.encode_documents(df.where("doc_id = 6"), PATH, "tokens").first()
    assert tok.decode(row.ids, skip_special_tokens=False) == row.decoded
    with pytest.raises(ValueError):
        bpe.encode_documents(df, PATH, "other")


def test_chunks_are_content_defined_and_reused():
    shared = prose(1, 900)
    enc = bpe.ChunkEncoder(PATH)
    enc.encode([prose(2, 300) + " " + shared])
    before = enc.encoded_chunks
    enc.encode(["something else " + shared])
    assert enc.reused_chunks > 0 and enc.encoded_chunks - before < before
    raw = np.frombuffer(shared.encode(), np.uint8)
    ends = bpe.cut_points(raw)
    assert ends[-1] == len(raw) and (np.diff(ends) > 0).all()
    assert all(shared.encode()[a:b].decode() for a, b in bpe._spans(ends))
