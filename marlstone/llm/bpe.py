"""Whole-corpus encoding with a public byte-level BPE vocabulary by a tokenization automaton.

The merge list is compiled, merge by merge, into a deterministic automaton over tokens. It starts as one state with
an arc to itself for every byte. The gadget of a merge ``(a, b) -> c`` redirects every ``a``-arc to a copy of its
target without the ``b``-arc, and adds a ``c``-arc that ends where ``b`` ended. As all arcs with one label always
share their target, a state is named by the label that enters it, and a copy shares the arcs of its original: it is
kept as a link to the state it was copied from and the time of the copy. What the finished automaton accepts is,
for every byte string, exactly one sequence of arc labels, which is its BPE encoding; decoding is emitting the bytes
of the labels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies lie; callers may pass another path.
TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the published pre-splitting pattern of this vocabulary.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and arcs remembered by a worker before its tables are emptied.
WORD_MEMORY, ARC_MEMORY = 400_000, 2_000_000
START = -1


def printable_bytes() -> dict[str, int]:
    """The one-character names that vocabulary files give to the 256 bytes: printable Latin-1 characters stand for
    themselves and the others, in order, for the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """The compiled automaton; states and arc labels are vocabulary ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        names = printable_bytes()
        self.vocab_size = size = max(vocab.values()) + 1
        self.label: dict[int, bytes] = {}
        self.head, self.tail, self.born = [-1] * size, [-1] * size, [-1] * size
        self.rule: dict[int, int] = {}
        for name, byte in names.items():
            if name in vocab:
                self.label[vocab[name]] = bytes([byte])
        for step, (left, right) in enumerate(merges):
            self._gadget(step, vocab[left], vocab[right], vocab[left + right])
        self._arcs: dict[int, bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._trie = self._build_trie()

    @classmethod
    def from_bytes(cls, raw: bytes) -> MergeAutomaton:
        model = json.loads(raw)["model"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges)

    def _gadget(self, step: int, a: int, b: int, c: int) -> None:
        self.rule.setdefault(a * self.vocab_size + b, step)
        if self.born[c] < 0 and c not in self.label:
            self.head[c], self.tail[c], self.born[c] = a, b, step
            self.label[c] = self.label[a] + self.label[b]

    def _build_trie(self) -> list[dict[int, int]]:
        """Byte transitions; a node's own token is kept under the key -1."""
        nodes: list[dict[int, int]] = [{}]
        for token, text in self.label.items():
            at = 0
            for byte in text:
                nxt = nodes[at].get(byte)
                if nxt is None:
                    nxt = len(nodes)
                    nodes.append({})
                    nodes[at][byte] = nxt
                at = nxt
            nodes[at][-1] = token
        return nodes

    def _removed(self, state: int, token: int, before: int) -> bool:
        """Whether the state has lost its arc for the token by the gadgets up to the merge number ``before``."""
        size, born, head, tail = self.vocab_size, self.born, self.head, self.tail
        while True:
            step = self.rule.get(state * size + token)
            if step is not None and step < before:
                return True
            if born[state] > born[token]:
                before, state = born[state], tail[state]
            elif born[token] >= 0:
                if state == head[token] == tail[token]:
                    return True
                before, token = born[token], head[token]
            else:
                return False

    def has_arc(self, state: int, token: int) -> bool:
        if state == START:
            return True
        key = state * self.vocab_size + token
        known = self._arcs.get(key)
        if known is None:
            if len(self._arcs) >= ARC_MEMORY:
                self._arcs.clear()
            known = self._arcs[key] = not self._removed(state, token, 1 << 40)
        return known

    def run(self, text: bytes) -> tuple[int, ...]:
        """The labels of the one accepted path. ``state[i]`` is the state reached after i bytes; every prefix has
        one, so the table is filled from left to right by byte transitions of the trie."""
        size = len(text)
        state = [START] * (size + 1)
        origin = [-1] * (size + 1)
        trie, has_arc = self._trie, self.has_arc
        for i in range(size):
            if i and origin[i] < 0:
                continue
            here, node = state[i], 0
            for j in range(i, size):
                step = trie[node].get(text[j])
                if step is None:
                    break
                node = step
                token = trie[node].get(-1)
                if token is not None and origin[j + 1] < 0 and has_arc(here, token):
                    state[j + 1], origin[j + 1] = token, i
        out, i = [], size
        while i > 0:
            out.append(state[i])
            i = origin[i]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        words = self._words
        for match in _SPLIT.finditer(text):
            word = match.group()
            known = words.get(word)
            if known is None:
                known = self.run(word.encode("utf-8", "surrogatepass"))
                if len(word) <= 64:
                    if len(words) >= WORD_MEMORY:
                        words.clear()
                    words[word] = known
            ids.extend(known)
        return ids

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.label[i] for i in ids).decode("utf-8", "surrogatepass")


_SPLIT = regex.compile(PRE_SPLIT)
_LOADED: dict[int, MergeAutomaton] = {}


def _automaton(raw: bytes) -> MergeAutomaton:
    """Compiled once in a worker."""
    key = hash(raw)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = MergeAutomaton.from_bytes(raw)
    return _LOADED[key]


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, sent once to every executor; its size is that of the published file (1.6 MB)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(spark: SparkSession, path: str = TOKENIZER_PATH):
    """A column function: text -> array<int>. Null and empty texts give an empty list."""
    raw = _vocabulary(spark, path)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = _automaton(raw.value)
        for texts in batches:
            offsets, values = [0], []
            for text in texts.to_pylist():
                if text:
                    values.extend(machine.encode(text))
                offsets.append(len(values))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    return encode


def counter(spark: SparkSession, path: str = TOKENIZER_PATH):
    """A column function: text -> number of tokens (int). Null and empty texts count 0."""
    raw = _vocabulary(spark, path)

    @F.arrow_udf("int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = _automaton(raw.value)
        for texts in batches:
            yield pa.array([machine.count(t) if t else 0 for t in texts.to_pylist()], pa.int32())

    return count


def decoder(spark: SparkSession, path: str = TOKENIZER_PATH):
    """A column function: array<int> -> text; null stays null, an empty list gives an empty text."""
    raw = _vocabulary(spark, path)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = _automaton(raw.value)
        for lists in batches:
            yield pa.array([None if ids is None else machine.decode(ids) for ids in lists.to_pylist()], pa.string())

    return decode


def encode_corpus(docs: DataFrame, text: str | Column = "text", path: str = TOKENIZER_PATH, out: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids.

    The text is encoded unchanged and whole; strings of special tokens are plain text. Null and empty texts give an
    empty list. Rows are independent, so there is no shuffle, and repeated rows come out repeated. A column named
    like ``out`` is replaced.
    """
    column = F.col(text) if isinstance(text, str) else text
    return docs.withColumn(out, encoder(docs.sparkSession, path)(column))
