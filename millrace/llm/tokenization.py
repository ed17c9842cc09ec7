"""Problem 7: encoding of the whole corpus with a public byte-level BPE tokenizer.

The merges are compiled, one after the other, into a deterministic automaton over
tokens. It begins with one state and an arc for each byte. The gadget of a merge
(u, v) -> w of rank r takes the arc v away from the state that u leads to, adds an arc w
wherever an arc u is followed by that arc v, and lets w lead to a copy of v's state. In
the end every token has a state of its own, and a sequence of tokens is a path exactly if
it is what BPE makes of its bytes.

A copied state differs from its origin only by the arcs taken away later, so the rows of
the table aren't stored but follow from the gadgets: whether state x has an arc y, seen
just before rank T, is

    arc(x, y, T) = no gadget (x, y) of rank < T, and
                   arc(b, y, rank x) if x = (a, b) was made after y,
                   arc(x, c, rank y + 1) if y = (c, d) was made after x (of "aaa" only the first pair merges).

Rows are filled in as words ask for them. A word is encoded in one sweep over its bytes:
as each prefix has one tokenization, each position is reached by one state, and from it
lead those tokens of the vocabulary's trie that the state has an arc for. The labels of
the arcs, followed back from the end, are the ids; their bytes in turn are the text.

Words are encoded where they lie, in Arrow batches: nothing is shuffled. Each Python
worker keeps the ids of words seen, a cache that is emptied when it is full.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Pre-splitting of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "byte_bpe_50k"
_CACHE = 400_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The vocabulary file of a public tokenizer: in the folder of MILLRACE_TOKENIZERS, or where the package of public tokenizers has it."""
    folder = os.environ.get("MILLRACE_TOKENIZERS")
    if folder:
        return os.path.join(folder, f"{name}.json")
    try:
        import public_tokenizers

        return public_tokenizers.path(f"{name}.json")
    except ImportError:
        return f"/opt/tokenizers/{name}.json"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the rest from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Automaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _byte_letters(), model["vocab"]
        self.bytes_of: dict[int, bytes] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> (u, v, rank)
        self.gadget: dict[int, int] = {}  # u << 20 | v -> rank
        self._arc: dict[int, bool] = {}
        self._next: dict[int, int] = {}  # trie: node << 8 | byte -> node
        self._token = [-1]
        for letter, b in letters.items():
            self._word(bytes([b]), vocab[letter])
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            self._add_gadget(u, v, w, rank)
        self._words: dict[str, tuple[int, ...]] = {}
        self._split = regex.compile(PATTERN).findall

    def _word(self, spelled: bytes, token: int) -> None:
        self.bytes_of[token] = spelled
        node = 0
        for b in spelled:
            key = node << 8 | b
            if key not in self._next:
                self._token.append(-1)
                self._next[key] = len(self._token) - 1
            node = self._next[key]
        self._token[node] = token

    def _add_gadget(self, u: int, v: int, w: int, rank: int) -> None:
        self.gadget[u << 20 | v] = rank
        if w not in self.made:
            self.made[w] = (u, v, rank)
            self._word(self.bytes_of[u] + self.bytes_of[v], w)

    def _has_arc(self, x: int, y: int) -> bool:
        """Whether the finished automaton has an arc y in the state of x; found by undoing the copies, latest first."""
        key = x << 20 | y
        known = self._arc.get(key)
        if known is not None:
            return known
        before, made, gadget = 1 << 60, self.made, self.gadget
        while True:
            rank = gadget.get(x << 20 | y)
            if rank is not None and rank < before:
                result = False
                break
            left, right = made.get(x), made.get(y)
            if left is None and right is None:
                result = True
                break
            if right is None or left is not None and left[2] > right[2]:
                x, before = left[1], min(before, left[2])
            else:
                y, before = right[0], min(before, right[2] + 1)
        self._arc[key] = result
        if len(self._arc) > 2_000_000:
            self._arc.clear()
        return result

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        n = len(word)
        state = [-1] * (n + 1)  # the token that leads to each position
        nxt, token, has_arc = self._next, self._token, self._has_arc
        for i in range(n):
            last = state[i]
            if last < 0 and i:
                continue
            node, j = 0, i
            while j < n:
                node = nxt.get(node << 8 | word[j])
                if node is None:
                    break
                j += 1
                t = token[node]
                if t >= 0 and state[j] < 0 and self._made_so(t) and (i == 0 or has_arc(last, t)):
                    state[j] = t
        out, at = [], n
        while at:
            out.append(state[at])
            at -= len(self.bytes_of[state[at]])
        out.reverse()
        return tuple(out)

    def _made_so(self, t: int) -> bool:
        """Whether the token's own gadget found the arcs it joins, so that its bytes by themselves become it."""
        made = self.made.get(t)
        if made is None:
            return True
        key = -1 - t
        known = self._arc.get(key)
        if known is None:
            u, v, rank = made
            known = self._made_so(u) and self._made_so(v) and self._arc_before(u, v, rank)
            self._arc[key] = known
        return known

    def _arc_before(self, x: int, y: int, before: int) -> bool:
        while True:
            rank = self.gadget.get(x << 20 | y)
            if rank is not None and rank < before:
                return False
            left, right = self.made.get(x), self.made.get(y)
            if left is None and right is None:
                return True
            if right is None or left is not None and left[2] > right[2]:
                x, before = left[1], min(before, left[2])
            else:
                y, before = right[0], min(before, right[2] + 1)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, an empty list for null and empty ones. Strings of special tokens are ordinary text; a lone surrogate counts as U+FFFD."""
        out: list[int] = []
        if not text:
            return out
        words = self._words
        for w in self._split(text):
            ids = words.get(w)
            if ids is None:
                ids = self.encode_word(w.encode("utf-8", "replace") if w.isascii() else w.encode("utf-8", "surrogatepass").decode("utf-8", "replace").encode())
                if len(words) >= _CACHE:
                    words.clear()
                if len(w) <= 64:
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


_loaded: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The automaton of a vocabulary file, compiled once per Python process."""
    if path not in _loaded:
        _loaded[path] = Automaton(path)
    return _loaded[path]


#: The greatest vocabulary file sent to the executors, in bytes.
VOCABULARY_BYTES = 64 << 20


def _sent(spark: SparkSession, path: str) -> str:
    """Sends a vocabulary file to all executors, once per application, and tells its name there; only the driver need have it."""
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    sc = spark.sparkContext
    sent = getattr(sc, "_millrace_vocabularies", None)
    if sent is None:
        sent = sc._millrace_vocabularies = set()
    if path not in sent:
        sc.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` of each row: an empty list for null and empty texts; repeated rows stay, other columns play no part."""
    name = _sent(documents.sparkSession, path or tokenizer_path())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(SparkFiles.get(name))
        for batch in batches:
            flat, ends = [], [0]
            for text in batch.column(1).to_pylist():
                flat += a.encode(text)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, ids array<int>")


def counted(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of each row, 0 for null and empty texts."""
    name = _sent(documents.sparkSession, path or tokenizer_path())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(SparkFiles.get(name))
        for batch in batches:
            sizes = pa.array([len(a.encode(t)) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(count, "doc_id bigint, n_tokens bigint")
