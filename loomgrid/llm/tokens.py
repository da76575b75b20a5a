"""Token ids and token counts of texts, exactly as the tokenizers library gives them, at the speed of a lookup.

Both tokenizers split a text before they merge bytes, and never merge across a split. So a text is cut at
places where both are sure to split, and each chunk is looked up:

* first in a compact table of frequent chunks, which is built from summaries over all documents and broadcast
  (a summary has a fixed number of chunks for each task, so no pre-token is ever shuffled),
* then in the worker's own cache, which is bounded and survives from task to task.

A chunk that neither knows is split into pre-tokens of letters, digits and signs, which have a cache of their
own, and only an unknown pre-token reaches the library. Texts with strings of added tokens, and chunks with
characters outside ASCII and Latin-1 letters, go to the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import kept

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Chunks that a task's summary holds, and that the broadcast table holds.
SUMMARY = 2_048
FREQUENT = 65_536
#: Chunks and pre-tokens that a worker's caches hold in each of two generations, and the characters of the longest that
#: they hold: text without spaces, such as base64, makes chunks of any length, which go to the library each time.
CACHED_CHUNKS, CACHED_PIECES = 160_000, 100_000
LONGEST = 64
#: Distinct chunks that a task counts before it halves its counts.
COUNTED = 400_000

# Unicode White_Space, as the tokenizers' \s has it; Python's \s has four more characters.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BYTE_CHUNKS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_LATIN = "a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PLAIN = re.compile(f"[ !-~{_LATIN}]+")
# The two tokenizers' own patterns, over ASCII and Latin-1 letters.
_BYTE_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^ 0-9{_LATIN}]+| +(?! )| +")
_WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^ 0-9{_LATIN}]+")
# A sign between a word and a space, which is a pre-token of its own.
_ENDED = re.compile("([a-z])([.,]) ")


def tokenizer_path(name: str) -> str:
    """The place of a vocabulary file; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> str:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(shifted)) for b in range(256))


class _Cache(dict):
    """A bounded cache of two generations: ``young`` is this dict; what falls out of ``old`` is made anew, and so is what is long."""

    def __init__(self, make: Callable[[str], object], size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONGEST:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Lookup:
    """What ``digest`` makes of the ids of each chunk of a text: their number, or their bytes; ``joined`` adds up several."""

    def __init__(self, name: str, digest: Callable[[list[int]], object], joined: Callable[[Iterable], object]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        with open(path) as file:
            config = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.digest, self.joined = self.tokenizer.model, digest, joined
        self.special = [x["content"] for x in config["added_tokens"]]
        pre = config["pre_tokenizer"]
        words = config["model"].get("end_of_word_suffix") == "</w>"
        self.exact = (words and pre["type"] == "Sequence") or (pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and config["normalizer"] is None)
        self.words = words
        self.letters = _byte_letters()
        self.pieces = _Cache(self._piece, CACHED_PIECES)
        self.chunks = _Cache(self._chunk, CACHED_CHUNKS)
        self.frequent: dict = {}

    def _piece(self, piece: str) -> object:
        if not piece.isascii() or " " in piece:
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return self.digest([t.id for t in self.model.tokenize(piece)])

    def _chunk(self, chunk: str) -> object:
        if self.words and chunk.isascii() and chunk.isalpha():  # most are a word in lower case, which needs no pattern and no second cache
            return self.digest([t.id for t in self.model.tokenize(chunk)])
        if not _PLAIN.fullmatch(chunk):
            return self.digest(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        found = _WORD_PIECES.findall(chunk.lower()) if self.words else _BYTE_PIECES.findall(chunk)
        return self.pieces[found[0]] if len(found) == 1 else self.joined(map(self.pieces.__getitem__, found))

    def cut(self, text: str) -> list[str] | None:
        """The chunks of ``text``, or None if it must go to the library as a whole."""
        if not self.exact or any(s in text for s in self.special):
            return None
        if not self.words:
            return _BYTE_CHUNKS.findall(text)
        # words come to the model in lower case anyway; of letters outside ASCII the library makes what it makes of them
        low = text.lower() if text.isascii() else text.encode().lower().decode()
        if any(s in low for s in self.special):
            return None
        return _ENDED.sub(r"\1 \2 ", low.replace("\n", " ")).split(" ")

    def each(self, text: str) -> Iterable[object]:
        chunks = self.cut(text)
        if chunks is None:
            return [self.digest(self.tokenizer.encode(text, add_special_tokens=False).ids)]
        if not self.frequent:
            return map(self.chunks.__getitem__, chunks)
        first, rest = self.frequent.get, self.chunks
        return (rest[c] if (x := first(c)) is None else x for c in chunks)


def lookup(name: str, kind: str) -> Lookup:
    """The worker's own lookup, which lives until the worker runs another operator. kind: count or bytes."""
    own = kept("tokens")
    if (name, kind) not in own:
        own[name, kind] = Lookup(name, len, sum) if kind == "count" else Lookup(name, lambda ids: struct.pack(f"<{len(ids)}I", *ids), b"".join)
    return own[name, kind]


def frequent_chunks(docs: DataFrame, text_col: str, tokenizer: str, size: int = FREQUENT, summary: int = SUMMARY) -> list[tuple[str, int]]:
    """(chunk, tokens) of the most frequent chunks of all texts, ``size`` at most, by their counts in the tasks' summaries."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        cut = lookup(tokenizer, "count").cut
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(cut(text or "") or ())
                if len(counts) > COUNTED:
                    counts = Counter({k: n // 2 for k, n in counts.items() if n > 1})
        top = [x for x in counts.most_common(summary) if x[1] > 1]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([c for c, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    found = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(summarize, "chunk string, n bigint")
    best = found.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(size)
    own = lookup(tokenizer, "count")
    return [(r.chunk, own.chunks[r.chunk]) for r in best.select("chunk").toLocalIterator()]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE, limit: int = 1024, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs``; over_limit: more than ``limit`` tokens.

    Null texts count as empty: no bytes, no tokens. Texts of any length are counted whole. Repeated rows and
    null ids give a row each. An empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(dict(frequent_chunks(docs, text_col, tokenizer, frequent)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lookup(tokenizer, "count")
        own.frequent = table.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [sum(own.each(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
