"""Texts that spell the vocabulary's added token."""

from __future__ import annotations

import zlib

from pyspark.sql import SparkSession

from lodestar.llm import packing, queries
from tests.llm.test_operators import docs_of


def test_added_token_as_by_tokenizers(spark: SparkSession) -> None:
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|>", "a\n<|endoftext|>\n\nb", "x<|endoftext|><|endoftext|>y", "  <|endoftext|>  ", "<|endoftext", "<|ENDOFTEXT|> <|im_start|>", "é<|endoftext|>é\r\n"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack_documents(docs_of(spark, texts), *queries.tokenizer()).collect()}
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert got[i] == (len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))), text
