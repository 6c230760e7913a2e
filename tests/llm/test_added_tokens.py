"""The packing query's ids are those of the tokenizer file with its library's defaults."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from corvid.llm import packing

TEXTS = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "x<|<|endoftext|>|>  y\n<|endoftext|>\n", "plain", "", "é<|endoftext|>é"]


def test_added_tokens_get_their_ids(spark, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for found in (packing.op7_packing(spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, str(tmp_path))):
        pieces = {}
        for r in found.collect():
            pieces.setdefault(r.doc_id, []).append(r)
        for i, text in enumerate(TEXTS):
            ids = [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID]
            own = sorted(pieces[i], key=lambda r: r.start)
            assert own[0].doc_tokens == len(ids) and sum(r.length for r in own) == len(ids)
            assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
