"""Token counts of the word-end BPE tokenizer, without token ids of whole texts.

Texts are cut into blocks.  A text is normalised and split into pre-tokens as
the tokenizer's file says (composed form, lower case, letters, single digits
and runs of other characters; white space falls away) and becomes a list of
(pre-token, frequency).  The tokenizer counts the pieces of each distinct
pre-token of the block once; the counts are joined to the frequencies by the
pre-token's number, multiplied and summed for each text.  The tokenizer's
special strings are cut out of the raw text first and count as one token
each, as its library does by default.

A block's dictionary stays in its task: nothing is shuffled, and memory is
bounded by a block and one text, however many different words the corpus has.

Defined cases: null and empty texts have no bytes and no tokens; repeated
rows are all returned; texts of any length are counted whole; an empty table
gives no rows; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import blocks, bound_batches, col, table

BLOCK_BYTES = 16 << 20
LIMIT = 2048

_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+").findall


def normalised(text: str) -> str:
    """Composed form in lower case, each character on its own (a final sigma is not special)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


def _count_blocks(tokenizer_json: str):
    def run(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        special = [t["content"] for t in json.loads(tokenizer_json)["added_tokens"]]
        cut = regex.compile("|".join(map(regex.escape, special)))
        hints = [s[:2] for s in special]
        schema = None

        def seen(batches):
            nonlocal schema
            for batch in batches:
                schema = batch.schema
                yield batch

        for ids, texts in blocks(seen(batches), 1, BLOCK_BYTES):
            number: dict[str, int] = {}
            frequencies, specials, n_bytes = [], [], []
            for text in texts:
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                parts, found = [text], 0
                if any(h in text for h in hints):
                    parts = cut.split(text)
                    found = len(parts) - 1
                specials.append(found)
                each = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
                        for words in (_SPLIT(normalised(part)) for part in parts)]
                frequencies.append(np.unique(np.concatenate(each), return_counts=True))
            words = list(number)
            pieces = np.empty(len(words), np.int64)
            for at in range(0, len(words), 4096):
                encoded = tokenizer.encode_batch_fast(words[at:at + 4096], add_special_tokens=False)
                pieces[at:at + len(encoded)] = [len(e) for e in encoded]
            n_tokens = [int(pieces[which] @ times) + s for (which, times), s in zip(frequencies, specials)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, schema.field(0).type), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                 pa.array([n > LIMIT for n in n_tokens])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    with open(path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    bound_batches(docs.sparkSession)
    texts = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_count_blocks(tokenizer_json),
                            f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
