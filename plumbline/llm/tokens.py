"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies of public tokenizers are; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose token counts a worker remembers.
REMEMBERED = 400_000

# A single blank between other characters always starts a piece of PATTERN, and PATTERN
# looks ahead for blanks only, so what stands between such blanks can be counted alone.
_JOINT = re.compile(r" (?<=\S )(?=\S)")


class Counter:
    """Counts tokens; the counts of words that come again are remembered."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("plumbline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = self.encoding.encode_ordinary

        class Memory(dict):
            def __missing__(self, word: str) -> int:
                if len(self) >= REMEMBERED:
                    self.clear()
                self[word] = n = len(encode(" " + word))
                return n

        self.memory = Memory()

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = _JOINT.split(text)
        return len(self.encoding.encode_ordinary(first)) + sum(map(self.memory.__getitem__, rest))


_counters: dict[str, Counter] = {}


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, keep: list[str] = ()) -> DataFrame:
    """(key, keep..., tokens) of every row; a null text has 0 tokens. The vocabulary file has
    to be readable on every executor."""
    names = [key, *keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(vocabulary)
        count = _counters[vocabulary]
        for batch in batches:
            n = [count(t) if t else 0 for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(n, pa.int64())], names=[*names, "tokens"])

    return df.select(*names, F.col(text).alias("__text")).mapInArrow(run, schema + ", tokens long")
