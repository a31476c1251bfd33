"""Token counters: the default, equal in Spark, Python and SQL, and byte-pair encodings of a vocabulary file."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the pattern that splits texts for the common byte-pair vocabularies of ranks.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[tuple[str, str], object] = {}


class BpeCounter:
    """Counts tokens of a vocabulary of ranks (a line a token: base64, rank). The file must be readable on every executor. Null and
    empty texts count 0; strings of special tokens are plain text."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.path, self.pattern = path, pattern

    def encoding(self):
        key = (self.path, self.pattern)
        if key not in _LOADED:
            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            _LOADED[key] = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return _LOADED[key]

    def of(self, text: str | None) -> int:
        return len(self.encoding().encode_ordinary(text)) if text else 0

    def __call__(self, text: str | Column) -> Column:
        @F.arrow_udf("int")
        def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield pa.array([self.of(t) for t in texts.to_pylist()], pa.int32())

        return count(F.col(text) if isinstance(text, str) else text)

    def each(self, texts: Column) -> Column:
        """Counts of an array's texts."""

        @F.arrow_udf("array<int>")
        def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for lists in batches:
                yield pa.array([None if x is None else [self.of(t) for t in x] for x in lists.to_pylist()], pa.list_(pa.int32()))

        return count(texts)

    def cut(self, text: str | Column, most: int) -> Column:
        """The text up to the end of its first ``most`` tokens; a character that the cut would divide is left out."""

        @F.arrow_udf("string")
        def shorten(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                out = []
                for t in texts.to_pylist():
                    ids = self.encoding().encode_ordinary(t) if t else []
                    out.append(t if len(ids) <= most else self.encoding().decode_bytes(ids[:most]).decode("utf-8", "ignore"))
                yield pa.array(out, pa.string())

        return shorten(F.col(text) if isinstance(text, str) else text)
