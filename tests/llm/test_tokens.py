"""Token ids against the tokenizers library text by text, and files that a later session reads by their folder alone."""

import random
import zlib

import numpy as np
import pytest

from stacksift.llm import tokens
from stacksift.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
PARTS = ("a", "Zw", "é", " ", "  ", "\n", "\n\n", "\t", ".", "!?", "'s", "'", "-", "1", "23", "日本", "😀", "\r\n", "\x1c", "\xa0", "ß", "<|endoftext|>", "ﬁ", "the ", " of", "...", " \n", "\n ", "İ", "ª")


def plain(texts, special_as_text=True):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = special_as_text
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("special_as_text", [True, False])
def test_units_give_what_whole_texts_give(special_as_text):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(6_000)] + [None]
    got = tokens.Encoder(PATH, 2_000, special_as_text)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        assert [np.frombuffer(x, "<u2").tolist() for x in got(part)] == plain(part, special_as_text)


def test_given_texts(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert [np.frombuffer(x, "<u2").tolist() for x in tokens.Encoder(PATH)(texts, 0)] == [x + [0] for x in plain(texts)]


def test_folder(spark, tmp_path):
    """Blocks and dictionary are read back by their folder; single documents by their ids."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    folder = f"file://{tmp_path}/tokens"
    tokens.write_blocks(docs, PATH, tokens.train_dictionary(docs, PATH), block_bytes=4_000, folder=folder)
    blocks, dictionary = tokens.open_blocks(spark, folder)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want, start = [], 0
    for k, ids in zip((k for k, _ in rows), plain(t for _, t in rows), strict=True):
        ids = [*ids, 0]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert blocks.count() > 20 and dictionary and sorted(map(tuple, tokens.read_blocks(blocks, dictionary).collect())) == want
    some = {r["doc_id"]: r["ids"] for r in tokens.lookup(blocks, dictionary, [rows[3][0], rows[70][0], -5]).collect()}
    assert some == {rows[k][0]: [*plain([rows[k][1]])[0], 0] for k in (3, 70)}
    assert tokens.lookup(blocks, dictionary, []).count() == 0
    with pytest.raises(ValueError):
        tokens.Block(blocks.first()["data"], b"another")
