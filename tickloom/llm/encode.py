"""Encoding of a corpus with a public byte-level BPE, by tables of distinct words."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT_WORDS = 200_000  # entries of a worker's table before it starts anew; memory only, no effect on results
SLICE_CHARS = 1_000_000


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    if folder is None:
        folder = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
    return os.path.join(folder, f"{name}.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _encoder(path: str):
    import regex
    import tiktoken
    from public_tokenizers import PATTERN

    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    return regex.compile(PATTERN), encoding


class WordTable(dict):
    """Distinct word to ids; a word is encoded when it is first met."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.split, self.encoding = _encoder(path)

    def __missing__(self, word: str) -> list[int]:
        ids = self[word] = self.encoding.encode_ordinary(word)
        return ids

    def ids(self, text: str | None) -> list[int]:
        """Ids of a text; words are joined back by position. None and empty texts give []."""
        if not text:
            return []
        if len(self) > KEPT_WORDS:
            self.clear()
        return list(chain.from_iterable(map(self.__getitem__, self.split.findall(text))))


def encode_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, ids): every text's ids, without special tokens; NULL and empty texts give an empty list.

    Each task keeps a table of the distinct words it has met: texts are split into words, a word is encoded once
    per task, and the ids are put back by position. Nothing is shuffled: sending every word occurrence through
    a join with one global table would move many times the corpus. Texts are encoded whole.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = WordTable(path)
        for batch in batches:
            at, texts = 0, batch.column(1)
            while at < len(texts):  # bounded output batches, however long the texts
                size, stop = 0, at
                lists = []
                while stop < len(texts) and (stop == at or size < SLICE_CHARS):
                    t = texts[stop].as_py()
                    size += len(t or "")
                    lists.append(table.ids(t))
                    stop += 1
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])
                at = stop

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def piece_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, piece): the vocabulary's pieces as hexadecimal bytes; 50,256 rows."""
    return spark.createDataFrame([(i, piece.hex()) for piece, i in read_ranks(path or vocabulary_path()).items()], "id int, piece string")


def decode_documents(spark: SparkSession, encoded: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, text): ids joined with their pieces and put together by position; an empty list gives ''.

    Ids are looked up in the piece table, gathered once as an array in order of id (its size is the vocabulary's, not
    the data's), so that no occurrence is shuffled. Unknown ids give NULL.
    """
    pieces = piece_table(spark, path).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "piece"))), lambda x: x["piece"]).alias("p")).scalar()
    met = encoded.withColumn("pieces", pieces)
    known = ~F.exists("ids", lambda i: (i < 0) | (i >= F.size("pieces")))
    text = F.decode(F.unhex(F.array_join(F.transform("ids", lambda i: F.get("pieces", i)), "")), "UTF-8")
    return met.select(key, F.when(known, text).alias("text"))
