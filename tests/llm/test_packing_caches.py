"""What the tokenizer's caches hold of a worker's memory."""

import time

import public_tokenizers
import pyarrow as pa

from curvelab.llm import packing


def test_caches_go_with_their_task(spark, make):
    texts = [(i, f"some words, and number {i} " * 20) for i in range(30)]
    assert packing.pieces(make(texts)).count() == 30

    def held(batches):
        for b in batches:
            time.sleep(0.1)  # so that every worker gets some
            known = [c for tok in packing._loaded.values() for c in (tok.parts, tok.parts.old, tok.tokens, tok.tokens.old)]
            yield pa.record_batch([pa.array([len(packing._loaded)] * b.num_rows), pa.array([sum(map(len, known))] * b.num_rows)], names=["loaded", "kept"])

    rows = spark.range(32, numPartitions=32).mapInArrow(held, "loaded long, kept long").collect()
    assert any(r.loaded for r in rows) and not any(r.kept for r in rows)


def test_a_part_that_is_one_token_is_kept_once():
    texts = [(i, f"some words, and number {i} " * 20) for i in range(30)]
    tok = packing.WordTokenizer(public_tokenizers.path(packing.TOKENIZER))
    ids = [tok.ids(t) for _, t in texts]
    assert tok.parts and not set(tok.parts) & set(tok.tokens)  # a part that is one token is kept once
    assert ids == [tok._encode(t) for _, t in texts]
    tok.forget()
    assert not any((tok.parts, tok.parts.old, tok.tokens, tok.tokens.old)) and ids[0] == tok.ids(texts[0][1])
