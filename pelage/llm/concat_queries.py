"""Query of the concatenating packing over all documents."""

from __future__ import annotations

import public_tokenizers

from pelage.llm import concat_cut
from pelage.llm.registry import query, table

END_ID, SIZE = 2, 4096


@query("op11_concat_cut")
def op11(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = concat_cut.tokenized(table(spark, sf_dir, "documents"), "doc_id", "text", path, END_ID)
    return concat_cut.pieces(rows, SIZE, tail="powers").withColumnRenamed("id", "doc_id").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
