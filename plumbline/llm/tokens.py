"""Token counts: batch encoding in an Arrow function that returns lengths only.

Texts are cut where no token can span the cut, gathered into calls of about equal bytes and encoded by the library.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import by_size, texts_of

CALL_BYTES = 1 << 20
PART_CHARS = 2048
SPACE = "▁"  # how the pieces write a space


@lru_cache(maxsize=4)
def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = model.encode("a  b ", out_type=str)
    # cutting is safe if no piece goes on after an inner space, and all spaces are kept and one is put first
    safe = not any(SPACE in p.lstrip(SPACE) for p in names) and "".join(plain) == f"{SPACE}a{SPACE * 2}b{SPACE}"
    return model, safe


@lru_cache(maxsize=4)
def _words(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cut(text: str, limit: int = PART_CHARS) -> list[str]:
    """Parts of ``text`` whose pieces, encoded part by part, are those of the whole.

    A cut replaces one space that follows another character than a space: pieces hold spaces only at their start, so
    none spans the cut, and the space that the encoder puts before each part stands for the one taken out. Text without
    such a space stays whole.
    """
    parts, start, n = [], 0, len(text)
    while n - start > limit:
        at = text.find(" ", start + limit)
        while at != -1 and (text[at - 1] in (" ", SPACE) or at + 1 == n):
            at = text.find(" ", at + 1)
        if at == -1:
            break
        parts.append(text[start:at])
        start = at + 1
    parts.append(text[start:])
    return parts


def count(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text, by the library that the file at ``path`` belongs to (``.model`` or ``.json``)."""
    if path.endswith(".model"):
        model, safe = _pieces(path)
        parts, owner = [], []
        for i, text in enumerate(texts):
            own = cut(text) if safe else [text]
            parts += own
            owner += [i] * len(own)
        encode = lambda some: [len(ids) for ids in model.encode(some, num_threads=1)]
    else:
        tokenizer, parts, owner = _words(path), texts, range(len(texts))
        encode = lambda some: [len(e.ids) for e in tokenizer.encode_batch(some, add_special_tokens=False)]
    lengths = np.zeros(len(parts), np.int64)
    for a, b in by_size([len(p) for p in parts], CALL_BYTES):
        lengths[a:b] = encode(parts[a:b])
    return np.bincount(np.fromiter(owner, np.int64, len(parts)), lengths, len(texts)).astype(np.int64)


def token_count(text: Column | str, path: str) -> Column:
    """Struct of ``n_bytes`` and ``n_tokens`` of a text column."""

    @F.arrow_udf("n_bytes long, n_tokens long")
    def lengths(column: pa.Array) -> pa.Array:
        n_bytes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
        return pa.StructArray.from_arrays([n_bytes, pa.array(count(texts_of(column), path))], ["n_bytes", "n_tokens"])

    return lengths(text)


def count_tokens(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    Null text counts as empty: 0 bytes, 0 tokens. A null id stays null, repeated rows are counted one by one, other
    columns are not read. An empty table gives no rows.
    """
    counted = df.select(F.col(id_col), token_count(F.col(text_col), path).alias("_t"))
    return counted.select(id_col, "_t.n_bytes", "_t.n_tokens", (F.col("_t.n_tokens") > limit).alias("over_limit"))
