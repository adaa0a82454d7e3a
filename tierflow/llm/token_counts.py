"""Token counts: batches balanced by bytes are encoded in Arrow functions that return lengths only."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tierflow.llm.common import doc_rows
from tierflow.llm.tokens import balanced, encoder, safe_pieces

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
BATCH_BYTES = 1 << 20


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit), one row per row of ``docs``, without a shuffle.

    ``tokenizer`` is a file path (default: the public byte-level one, looked up on the executor). Texts are counted whole; a long one is
    encoded in pieces cut where no token can cross. No begin, end or other added tokens; special strings inside a
    text are treated as the library does by default. A null text is empty (0 tokens); a null doc_id stays null;
    repeated rows are counted each; an empty table gives no rows; other columns are ignored.
    """
    def count(batches):
        own = encoder(tokenizer or public_tokenizers.path(TOKENIZER))
        for batch in batches:
            sizes = pc.binary_length(batch["text"]).to_pylist()
            for a, b in balanced(sizes, batch_bytes):
                part = batch.slice(a, b - a)
                # a long text goes piece by piece, so that no batch is much larger than batch_bytes
                total = []
                texts = part["text"].to_pylist()
                if sum(sizes[a:b]) > 4 * batch_bytes:
                    total = [sum(own.lengths([p])[0] for p in safe_pieces(t)) for t in texts]
                else:
                    total = own.lengths(texts)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(sizes[a:b], pa.int64()), pa.array(total, pa.int64()),
                     pa.array([n > limit for n in total], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return doc_rows(docs).mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
