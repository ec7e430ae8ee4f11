"""Token ids of whole texts and the pieces of a bounded length that they are cut into.

The tokenizer drops white space and never merges across the parts that its pattern finds, so a part is coded once for some
megabytes of text, and a worker remembers the parts that it has met (REMEMBERED of them, then it starts anew; only time
depends on that). Texts of ASCII and Latin-1's letters are parted by that pattern in Arrow and their parts are coded by the
library's model; of any other text the library codes the words between white space, and a text that spells out an added
token as a whole. Pieces can't lose a text: there is one at least, as every document has its end id.

Defined cases: a null or empty text is the end id alone; repeated rows give repeated results; a very long text is held in
memory once with its ids; columns that aren't carried are not looked at.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

CAPACITY, END = 2048, 0
#: Bytes of text coded at once; parts that a worker remembers.
SLICE_BYTES, REMEMBERED = 8 << 20, 1 << 19
#: Characters of which no two compose and each has one lower-case form; letters among them, in lower case.
PLAIN, LETTERS = r"^[\x09-\x0d\x20-\x7eÀ-ÖØ-öø-ÿ]*$", "a-zß-öø-ÿ"
#: The parts other than runs of letters, by the tokenizer's own pattern (fixed value), and what is one part.
OTHERS = rf"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^{LETTERS}0-9\x09-\x0d\x20]+)"
ONE_PART = rf"^('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[{LETTERS}]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+)$"


def byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes each character of Latin-1's letters: visible bytes as themselves, others from 256 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or b >= 0xA1 and b != 0xAD]
    hidden = [b for b in range(256) if b not in visible]
    letter = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


BYTE_LETTERS = byte_letters()


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """A tokenizer that drops white space, with the ids of the parts met so far."""

    def __init__(self, file: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.library, self.remembered = Tokenizer.from_file(file), remembered
        self.added = "|".join(re.escape(t.content.lower()) for t in self.library.get_added_tokens_decoder().values())
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # word to place in begin
        self.begin, self.ids = array("q", [0]), array("I")

    def library_ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, part: str, ids: list[int]) -> None:
        self.ids.extend(ids)
        self.known[part] = len(self.begin) - 1
        self.begin.append(len(self.ids))

    def _places(self, parts: pa.Array, single: bool) -> np.ndarray:
        found = parts.to_pylist()
        new = [x for x in found if x not in self.known]
        collects = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and very many small objects live on
        try:
            if single:
                tokenize = self.library.model.tokenize
                for x in new:
                    self._add(x, [t.id for t in tokenize(x if x.isascii() else x.translate(BYTE_LETTERS))])
            else:
                for x, ids in zip(new, self.library_ids(new)):
                    self._add(x, ids)
        finally:
            if collects:
                gc.enable()
        return np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text begins (one entry more than texts)."""
        if len(self.known) > self.remembered:
            self.forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, self.added, ignore_case=True).to_numpy(zero_copy_only=False).astype(bool) & bool(self.added)
        texts_left = pc.if_else(pa.array(whole), "", texts)
        parted = pc.replace_substring_regex(pc.utf8_lower(texts_left), OTHERS, r" \1 ")
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts_left, PLAIN), parted, texts_left))
        lengths = pc.list_value_length(words).to_numpy().astype(np.int64)
        flat = words.flatten().dictionary_encode()
        distinct, which = flat.dictionary, flat.indices.to_numpy()
        single = pc.match_substring_regex(distinct, ONE_PART).to_numpy(zero_copy_only=False).astype(bool)
        place = np.empty(len(distinct), np.int64)
        for kind in (True, False):
            place[single == kind] = self._places(distinct.filter(pa.array(single == kind)), kind)
        begin, ids = np.frombuffer(self.begin, np.int64), np.frombuffer(self.ids, np.uint32)
        at = place[which]
        size = begin[at + 1] - begin[at]
        out_begin = np.append(0, np.cumsum(size))
        out = ids[np.arange(out_begin[-1]) - np.repeat(out_begin[:-1] - begin[at], size)]
        per_text = out_begin[np.append(0, np.cumsum(lengths))]
        if not whole.any():
            return out, per_text
        apart = dict(zip(np.flatnonzero(whole).tolist(), self.library_ids(texts.filter(pa.array(whole)).to_pylist())))
        runs = [np.array(apart[i], np.uint32) if i in apart else out[per_text[i]:per_text[i + 1]] for i in range(len(texts))]
        return np.concatenate(runs), np.append(0, np.cumsum([len(r) for r in runs]))


_WORDS: dict[str, Words] = {}


def words(file: str) -> Words:
    """One a worker and vocabulary."""
    if file not in _WORDS:
        _WORDS[file] = Words(file)
    return _WORDS[file]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with about SLICE_BYTES of text; a row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield at, end
        at = end


def pieces(docs: DataFrame, file: str, *, carry: list[str] = ("doc_id",), capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """The carried columns, and of each piece: key, piece, start, length, ids_crc32, ids (little-endian, 32 bits each).

    key is a number of its own for each piece once the result is written: it holds the task's number and the row's.
    The carried columns must not have those names.
    """
    carry = list(carry)
    sent = docs.select(*carry, F.col("text").cast("string").alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, key = words(file), TaskContext.get().partitionId() << 40
        for part in parts:
            for a, b in _slices(part.column(len(carry))):
                ids, begin = coder.encode(part.column(len(carry)).slice(a, b - a))
                n = np.diff(begin) + 1  # with the end id
                ids = np.insert(ids, begin[1:], end).astype("<u4")
                first = np.append(0, np.cumsum(n))[:-1]
                count = -(-n // capacity)
                row = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                raw, at = memoryview(ids).cast("B"), 4 * (first[row] + start)
                views = [raw[i:j] for i, j in zip(at.tolist(), (at + 4 * length).tolist())]
                columns = [*part.slice(a, b - a).take(pa.array(row)).columns[:-1], pa.array(np.arange(key, key + len(row))), pa.array(piece), pa.array(start), pa.array(length), pa.array([zlib.crc32(v) for v in views], pa.int64())]
                key += len(row)
                yield pa.RecordBatch.from_arrays(columns + [pa.array([v.tobytes() for v in views], pa.binary())] * with_ids, names)
        pa.default_memory_pool().release_unused()

    fields = [StructField(c, LongType()) for c in ("key", "piece", "start", "length", "ids_crc32")] + [StructField("ids", BinaryType())] * with_ids
    names = [*carry, *(f.name for f in fields)]
    return sent.mapInArrow(batches, StructType([*sent.schema.fields[:-1], *fields]))
