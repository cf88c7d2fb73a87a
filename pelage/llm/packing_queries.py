"""Query of the packing over all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from pelage.llm import packing
from pelage.llm.registry import query, table

c = F.col
END_ID, SIZE = 2, 1024


def pack(docs):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    pieces = packing.tokenized(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), END_ID, SIZE, ranks)
    placed = packing.packed(pieces.drop("ids"), packing.Capacity(tokens=SIZE, docs=SIZE, cost=SIZE * SIZE))
    return placed.withColumnRenamed("id", "doc_id").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op10_packing")
def op10(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
