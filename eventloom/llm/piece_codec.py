"""Encoding and decoding with a merge-type sentence-piece vocabulary.

A text is cut where no piece of the vocabulary can reach across (before each run of spaces, which pieces hold only at
their start). In each cut, an agenda of adjacent symbol pairs, ordered by score and then by place, is merged until no pair
is a piece; symbols that are no piece become their UTF-8 bytes' pieces. The agendas of all distinct cuts
are rows of one array, from each of which the best pair is taken at a time; a very long cut has a heap of its own. Cuts
repeat, so each is coded once for a few megabytes of text; nothing is kept from one to the next. Every text is encoded and decoded by the sentencepiece
library as well, in Arrow batches, and a difference stops the job.

Defined cases: a null text counts as empty and gives the end id alone; repeated rows give repeated results; a very long
text without spaces is one cut, whose agenda is a heap, so time grows as n log n; extra columns are not looked at.
"""

from __future__ import annotations

import heapq
import itertools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from eventloom.llm.common import table

#: The mark that stands for a space in pieces.
SPACE = "▁"
#: Bytes of text that are coded at once and sent back.
SLICE_BYTES = 2 << 20
#: Cuts of up to so many symbols share one array of agendas, in classes of like lengths; so many cuts at a time.
TOGETHER, AT_ONCE, NO_PIECE = (6, 10, 16, 32, 64), 1 << 14, float("-inf")


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Merges:
    """Which two symbols make a piece: a table of pairs, with what they make and its score, found by hash."""

    def __init__(self, pieces: dict[str, float]):
        self.symbols = {x: i for i, x in enumerate(sorted({*pieces, *(c for p in pieces for c in p)}), 1)}  # 0: in no piece
        self.of_character = np.zeros(1 + sys.maxunicode, np.int32)
        for x, i in self.symbols.items():
            if len(x) == 1:
                self.of_character[ord(x)] = i
        found = [(self.symbols[p[:k]], self.symbols[p[k:]], self.symbols[p], score) for p, score in pieces.items()
                 for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols]
        left, right, made, score = zip(*found) if found else ((), (), (), ())
        self.keys = np.append(self._key(np.array(left, np.int64), np.array(right, np.int64)), -1)
        self.made, self.score = np.append(np.array(made, np.int32), np.int32(0)), np.append(np.array(score, np.float32), np.float32(NO_PIECE))
        self.bits = max(10, int(np.ceil(np.log2(len(self.keys)))) + 2)
        at = self._slot(self.keys[:-1])
        self.slots = np.full(1 << self.bits, len(found), np.int32)
        self.slots[at] = np.arange(len(found))
        rest = np.flatnonzero(self.slots[at] != np.arange(len(found)))  # pairs whose slot another one has
        self.rest = rest[np.argsort(self.keys[rest])]
        self.crowded = np.zeros(1 << self.bits, bool)
        self.crowded[at[rest]] = True

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table; the last place, of no piece, for pairs that make none."""
        keys = self._key(left, right)
        slot = self._slot(keys)
        at = self.slots[slot]
        miss = self.keys[at] != keys
        second = np.flatnonzero(miss & self.crowded[slot])
        at = np.where(miss, len(self.keys) - 1, at)
        if len(second):
            known = self.keys[self.rest]
            i = np.minimum(np.searchsorted(known, keys[second]), len(known) - 1)
            at[second] = np.where(known[i] == keys[second], self.rest[i], at[second])
        return at

    def merged(self, characters: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """[cut, place]: the symbol that starts at each character once nothing merges; -1 where none starts. 0 is a character in no piece."""
        n = len(size)
        inside = np.arange(width) < size[:, None]
        symbol = np.full((n, width + 1), -1, np.int32)
        symbol[:, :width][inside] = self.of_character[characters]
        after = np.where(np.arange(1, width + 1) < size[:, None], np.arange(1, width + 1), width).astype(np.int32)
        before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))  # of the place past the end: never looked at
        agenda = np.full((n, width), len(self.keys) - 1, np.int32)
        pair = inside & (after < width)
        r, i = np.nonzero(pair)
        agenda[r, i] = self.pairs(symbol[r, i], symbol[r, i + 1])
        score = self.score[agenda]
        live = np.arange(n)
        while len(live):
            i = score[live].argmax(axis=1)  # of equal scores the leftmost
            some = score[live, i] != NO_PIECE
            live, i = live[some], i[some]
            if not len(live):
                break
            j = after[live, i]
            symbol[live, i] = self.made[agenda[live, i]]
            symbol[live, j], score[live, j] = -1, NO_PIECE
            after[live, i] = k = after[live, j]
            before[live, k] = i
            # the pairs on both sides have changed
            for at in (before[live, i], i):
                ok = at >= 0
                row, at = live[ok], at[ok]
                to = after[row, at]
                found = self.pairs(symbol[row, at], np.where(to < width, symbol[row, to], 0))
                found = np.where(to < width, found, len(self.keys) - 1)
                agenda[row, at], score[row, at] = found, self.score[found]
        return symbol[:, :width]


class Codec:
    """The vocabulary as tables, and the two directions."""

    def __init__(self, model_file: str):
        self.library = m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]
        self.ids = {self.pieces[i]: i for i in usable}
        self.scores = {self.pieces[i]: m.get_score(i) for i in usable}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        bytes_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.plain = [bytes_of.get(i) or (p.replace(SPACE, " ").encode() if p in self.ids else b"") for i, p in enumerate(self.pieces)]
        self.end, self.unknown = m.eos_id(), m.unk_id()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after another character: cuts at spaces would not be exact")
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.cuts = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.merges = Merges(self.scores)
        # by symbol: the ids as text, their number and bytes
        told = [("", 0, b""), *(self.tell(self.ids_of(x)) for x in self.merges.symbols)]
        self.told = pa.array([x[0] for x in told]), np.array([x[1] for x in told], np.int64), pa.array([x[2] for x in told], pa.binary())

    def ids_of(self, symbol: str) -> list[int]:
        i = self.ids.get(symbol)
        return [i] if i is not None else [self.byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass")]

    def tell(self, ids: list[int]) -> tuple[str, int, bytes]:
        return " ".join(map(str, ids)), len(ids), self.decode_bytes(ids)

    def merge(self, cut: str) -> list[str]:
        """The symbols of a cut once no adjacent pair is a piece: best score first, then leftmost."""
        scores, symbols = self.scores, list(cut)
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        agenda = []
        for i in range(len(symbols) - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                agenda.append((-scores[pair], i, i + 1, len(pair)))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or after[i] != j or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two has merged since
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0:
                    pair = symbols[left] + symbols[right]
                    if pair in scores:
                        heapq.heappush(agenda, (-scores[pair], left, right, len(pair)))
        return [s for s in symbols if s]

    def told_of(self, cuts: list[str]) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """Of each cut its ids joined by spaces, their number, and the bytes that they decode to."""
        size = np.fromiter(map(len, cuts), np.int64, len(cuts))
        order, parts, begin = np.argsort(size, kind="stable"), [], 0
        for width in TOGETHER:
            end = int(np.searchsorted(size[order], width, side="right"))
            parts += [self._told_together([cuts[i] for i in order[a:min(end, a + AT_ONCE)]], width) for a in range(begin, end, AT_ONCE)]
            begin = end
        long = [self.tell(self.encode_cut(cuts[i])) for i in order[begin:]]
        parts.append((pa.array([x[0] for x in long], pa.string()), np.array([x[1] for x in long], np.int64), pa.array([x[2] for x in long], pa.binary())))
        back = np.empty(len(cuts), np.int64)
        back[order] = np.arange(len(cuts))
        ids, sizes, raws = zip(*parts)
        return pa.concat_arrays(ids).take(pa.array(back)), np.concatenate(sizes)[back], pa.concat_arrays(raws).take(pa.array(back))

    def _told_together(self, cuts: list[str], width: int) -> tuple[pa.Array, np.ndarray, pa.Array]:
        characters = np.frombuffer("".join(cuts).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, cuts), np.int64, len(cuts))
        table = self.merges.merged(characters, size, width)
        row, place = np.nonzero(table >= 0)
        symbol, (ids, count, raw) = table[row, place].astype(np.int64), self.told
        lone = np.flatnonzero(symbol == 0)
        if len(lone):  # characters in no piece are told by their bytes
            which, kind = np.unique(characters[(np.cumsum(size) - size)[row[lone]] + place[lone]], return_inverse=True)
            more = [self.tell(self.ids_of(chr(c))) for c in which.tolist()]
            symbol[lone] = len(count) + kind
            ids, raw = pa.concat_arrays([ids, pa.array([x[0] for x in more])]), pa.concat_arrays([raw, pa.array([x[2] for x in more], pa.binary())])
            count = np.append(count, [x[1] for x in more])
        first = np.searchsorted(row, np.arange(len(cuts) + 1))
        return _joined(ids, symbol, first, " "), np.add.reduceat(count[symbol], first[:-1]), _joined(raw, symbol, first, b"")

    def encode_cut(self, cut: str) -> list[int]:
        return [i for s in self.merge(cut) for i in self.ids_of(s)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for; control ids stand for nothing."""
        return b"".join([self.plain[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without the end id."""
        return [int(x) for x in self.encoded([text])[0][0].as_py().split()]

    def encoded(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """Of each text the ids joined by spaces, their number, and the text that they decode to."""
        column = pa.array(texts, pa.string())
        # single spaces between words are cut by Arrow, all other texts by the pattern
        odd = pc.match_substring_regex(column, f"^$|^ |  |{SPACE}").to_numpy(zero_copy_only=False).astype(bool)
        words = pc.split_pattern(column.filter(pa.array(~odd)), " ")
        cuts = [self.cuts.findall(SPACE + text.replace(" ", SPACE)) if text else [] for text in itertools.compress(texts, odd)]
        parts = [
            self._encoded_cuts(words.flatten().dictionary_encode(), SPACE, pc.list_value_length(words).to_numpy()),
            self._encoded_cuts(pa.array(itertools.chain.from_iterable(cuts), pa.string(), size=sum(map(len, cuts))).dictionary_encode(), "", np.array([len(c) for c in cuts], np.int64)),
        ]
        back = np.empty(len(texts), np.int64)
        back[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(texts))
        ids, sizes, decoded = zip(*parts)
        return pa.concat_arrays(ids).take(pa.array(back)), np.concatenate(sizes)[back], pa.concat_arrays(decoded).take(pa.array(back))

    def _encoded_cuts(self, flat: pa.DictionaryArray, lead: str, length: np.ndarray) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """The same from the cuts of all texts, each after ``lead``, and how many each text has."""
        begin = np.append(0, np.cumsum(length, dtype=np.int64))
        ids, count, raw = self.told_of([lead + x for x in flat.dictionary.to_pylist()])
        which = flat.indices.to_numpy()
        total = np.append(0, np.cumsum(count[which]))
        plain = _joined(raw, which, begin, b"")
        try:
            decoded = plain.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8 become the replacement character
            decoded = pa.array([x.decode("utf-8", "replace") for x in plain.to_pylist()], pa.string())
        decoded = pc.utf8_slice_codeunits(decoded, 1)  # the space put before the text goes again
        return _joined(ids, which, begin, " "), total[begin[1:]] - total[begin[:-1]], decoded

    def check(self, texts: list[str], ids: pa.Array, decoded: pa.Array) -> None:
        """Holds what was found against the library."""
        wanted = self.library.encode(texts, num_threads=1)
        back = self.library.decode([[*x, self.end] for x in wanted], num_threads=1)
        for text, x, y, one, own in zip(texts, wanted, back, ids.to_pylist(), decoded.to_pylist()):
            if one != " ".join(map(str, x)) or own != y:
                raise ValueError(f"not what the library gives, for a text that starts with {text[:80]!r}")


def _joined(told: pa.Array, which: np.ndarray, begin: np.ndarray, separator) -> pa.Array:
    """told[which], joined from each begin to the next."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), told.take(pa.array(which))), separator)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SLICE_BYTES of text; a row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


_CODECS: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """One codec a worker and vocabulary."""
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def encode_documents(docs: DataFrame, model_file: str, *, carry: list[str] = ()) -> DataFrame:
    """doc_id (or the carried columns), ids (space-joined, with the end id), n_tokens, decoded.

    The carried columns must not have the names of the three others.
    """
    carry = list(carry or ["doc_id"])
    sent = docs.select(*carry, F.col("text").cast("string").alias("decoded"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for some in (x for part in parts for x in _slices(part, len(carry))):
            texts = [text or "" for text in some.column(len(carry)).to_pylist()]
            ids, sizes, decoded = c.encoded(texts)
            c.check(texts, ids, decoded)
            end = str(c.end)
            ids = pc.if_else(pc.equal(ids, ""), end, pc.binary_join_element_wise(ids, end, " "))
            new = [ids, pa.array(sizes + 1), decoded]
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], *new], names=[*carry, "ids", "n_tokens", "decoded"])
        pa.default_memory_pool().release_unused()  # the worker stays, what this task took need not

    schema = StructType([*sent.schema.fields[:-1], StructField("ids", StringType()), StructField("n_tokens", LongType()), StructField("decoded", StringType())])
    return sent.mapInArrow(batches, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of what the operator returns."""
    return digests(table(spark, sf_dir, "documents"), vocabulary_path())


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    coded = encode_documents(docs, model_file)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of documents, with token_ids and n_tokens; a column of such a name gives way."""
    own = [c for c in docs.columns if c not in ("ids", "n_tokens", "decoded", "token_ids")]
    coded = encode_documents(docs, vocabulary_path(), carry=own)
    return coded.select(*own, F.split("ids", " ").cast("array<int>").alias("token_ids"), "n_tokens")
