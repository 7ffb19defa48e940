"""Packing token pieces into training sequences by vector bin packing.

Every task packs the documents it reads, so no row is shuffled. A document is tokenised whole. Runs of
``max_tokens`` ids that satisfy the limits alone become sequences of their own; what is left of a
document waits in a bounded pool. From the pool sequences are filled by the dot-product heuristic: of
the pieces that fit under all limits (tokens, segments, loss-bearing tokens) the one whose demand
vector has the largest dot product with what is left of the sequence. A gap no piece fits is closed by
cutting the pieces that can give most to it. A sequence that stays short, for want of pieces or because
another limit binds first, is cut into sequences whose lengths are powers of two, which are not padded.
"""

from __future__ import annotations

import re
import zlib
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, frugal

#: Id appended to every document.
END_ID = 2
#: Pieces that wait in a task before a round of packing.
POOL = 1024
#: Distinct parts of chunks a Python worker remembers the ids of.
WORD_CACHE = 600_000
#: New parts that are encoded by one call.
ENCODE_AT_ONCE = 4096


class WordTokens:
    """Ids of white-space separated chunks as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space before it forms words and nothing in it looks across white space, so
    the ids of a text are those of its chunks in order. A chunk is lowered and cut behind its leading letters, which to
    the tokenizer is a border of words; for chunks of ASCII and Latin-1 letters Arrow and numpy do so with all at once. New parts are
    encoded many at a time and told apart by the offsets of their tokens; chunks that normalisation might change in length
    go alone, and so do those with a capital sigma, whose lower case depends on its place in Python but not in the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._encode, self._split = tokenizer.encode, tokenizer.model.tokenize
        self._forget()

    def _forget(self) -> None:
        #: Part to a number; its ids are ``pool[ends[number] : ends[number + 1]]``.
        self.number: dict[str, int] = {"": 0}
        self.pool, self.ends = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64)

    def _store(self, parts: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Numbers the parts, whose ids are those of ``ids`` up to each one's end."""
        n = len(self.number)
        used, need = int(self.ends[n]), n + len(parts) + 1
        if need > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros(max(need - len(self.ends), len(self.ends) // 2), np.int64)))
        if used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(len(ids), len(self.pool) // 2), "<u4")))
        self.pool[used : used + len(ids)], self.ends[n + 1 : need] = ids, used + ends
        self.number.update(zip(parts, range(n, need - 1)))

    def _learn(self, parts: list[str], spell: bool = False) -> None:
        """Encodes parts that are not known, none of which normalisation changes. Those of letters only are single words,
        which the model takes as they are (``spell``)."""
        together = [p for p in dict.fromkeys(parts) if p not in self.number]
        if spell:
            words, ids, ends = [p for p in together if p.isalpha()], [], []
            for word in words:
                ids += [t.id for t in self._split(word if word.isascii() else word.encode().decode("latin-1").translate(_SPELLING))]
                ends.append(len(ids))
            self._store(words, np.array(ids, "<u4"), np.array(ends, np.int64))
            together = [p for p in together if not p.isalpha()]
        for at in range(0, len(together), ENCODE_AT_ONCE):
            part = together[at : at + ENCODE_AT_ONCE]
            got = self._encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([len(c) + 1 for c in part])
            token_at = np.array(got.offsets, np.int64).reshape(-1, 2)[:, 0]
            self._store(part, np.array(got.ids, "<u4"), np.searchsorted(token_at, starts))

    def _plain(self, chunks: pa.Array) -> np.ndarray:
        """The numbers of leading letters and rest of chunks of ASCII and Latin-1 letters."""
        low = pc.utf8_lower(chunks)
        ends = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1]
        data = low.buffers()[2] or pa.py_buffer(b"")
        others = np.flatnonzero(_NO_LETTER[np.frombuffer(data, np.uint8)[: ends[-1]]])
        others = np.append(others, ends[-1])
        cut = np.minimum(others[np.searchsorted(others, ends[:-1])], ends[1:])
        edges = np.append(np.stack((ends[:-1], cut), axis=1).ravel(), ends[-1]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), 2 * len(low), [None, pa.py_buffer(edges), data]).dictionary_encode()
        parts = coded.dictionary.to_pylist()
        self._learn(parts, spell=True)
        return np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))[coded.indices.to_numpy()].reshape(-1, 2)

    def _other(self, chunks: list[str]) -> np.ndarray:
        """The numbers of leading letters and rest of any chunks, those that go alone with an empty rest."""
        cut = []
        for chunk in chunks:
            if len(chunk) <= 64 and "<|" not in chunk and "Σ" not in chunk and (chunk.isascii() or is_normalized("NFC", chunk) and len(chunk.lower()) == len(chunk)):
                # Letters and what follows them are different words to the tokenizer.
                core, rest = _CORE.match(chunk).groups() if "'" not in chunk else (chunk, "")
                cut.append((core.lower(), rest.lower()))
            else:
                cut.append((chunk, ""))
                if chunk not in self.number:
                    ids = np.array(self._encode(chunk, add_special_tokens=False).ids, "<u4")
                    self._store([chunk], ids, np.array([len(ids)]))
        self._learn([part for pair in cut for part in pair])
        return np.array([[self.number[core], self.number[rest]] for core, rest in cut], np.int64).reshape(-1, 2)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, as bytes."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary
        if len(self.number) > WORD_CACHE:
            self._forget()
        plain = pc.and_(pc.less_equal(pc.utf8_length(chunks), 64), pc.invert(pc.match_substring_regex(chunks, _UNUSUAL)))
        pair, at = np.zeros((len(chunks), 2), np.int64), plain.to_numpy(zero_copy_only=False)
        if at.any():
            pair[at] = self._plain(chunks.filter(plain))
        if not at.all():
            pair[~at] = self._other(chunks.filter(pc.invert(plain)).to_pylist())
        first, size = self.ends[pair], self.ends[pair + 1] - self.ends[pair]
        ids = _ranges(self.pool, first.ravel(), size.ravel())
        # The chunks' ids, then the words'.
        sizes = size.sum(axis=1)
        code = coded.indices.to_numpy()
        ids = _ranges(ids, (np.cumsum(sizes) - sizes)[code], sizes[code])
        cut = np.concatenate(([0], np.cumsum(sizes[code])))[np.asarray(split.offsets) - split.offsets[0].as_py()]
        return [ids[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _ranges(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces of ``data`` that begin at ``first``, one after the other."""
    ends = np.cumsum(size)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)]


#: Leading letters of a chunk, and the rest.
_CORE = re.compile(r"([^\W\d_]*)(.*)", re.S)
#: What a chunk of ASCII and Latin-1 letters has not, or what may join letters and others to one word.
_UNUSUAL = r"[^\x00-\x26\x28-\x7F\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]|<\|"
#: Bytes of lowered chunks of that kind that belong to no letter.
_NO_LETTER = np.array([i < 128 and not chr(i).isalpha() for i in range(256)])
#: The characters that stand for bytes in the model's words: printable ones for themselves, the others from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELLING = {byte: 256 + i for i, byte in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: One per Python worker and tokenizer, so that tasks of a worker share what is known.
_TOKENS: dict[str, WordTokens] = {}


def worker_tokens(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


class SequencePacker:
    """Packs pieces of one task. A piece is (key, start, length, prompt): its first ``prompt`` tokens bear no loss."""

    def __init__(self, first_id: int, max_tokens: int, max_segments: int, max_loss: int):
        self.next_id = first_id
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.max_tokens, self.max_segments, self.max_loss = max_tokens, max_segments, max_loss
        self.pool: list[tuple] = []
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for key, start, length, _ in pieces:
            self.out.append((key, start, length, self.next_id, at))
            at += length
        self.next_id += 1

    def add(self, key, length: int, prompt: int = 0) -> None:
        """A document of ``length`` tokens of which the first ``prompt`` bear no loss."""
        start = 0
        while start < length:
            take = min(length - start, self.max_tokens)
            free = min(max(0, prompt - start), take)
            if take - free > self.max_loss:  # could never fit for its loss-bearing tokens
                take = free + self.max_loss
            if take == self.max_tokens:
                self._emit([(key, start, take, free)])
            else:
                self.pool.append((key, start, take, free))
            start += take
        if len(self.pool) >= POOL:
            self.pack(keep=POOL // 2)

    def pack(self, keep: int = 0) -> None:
        pool, self.pool = self.pool, []
        demand = np.array([(length, 1, length - prompt) for _, _, length, prompt in pool], float).reshape(-1, 3)
        scaled = demand / self.limits
        alive = np.ones(len(pool), bool)
        left = len(pool)
        while left > keep:
            room, chosen = self.limits.copy(), []
            while left:
                fits = alive & (demand <= room).all(axis=1)
                if not fits.any():
                    break
                best = int(np.argmax(np.where(fits, scaled @ (room / self.limits), -1.0)))
                chosen.append(pool[best])
                room -= demand[best]
                alive[best] = False
                left -= 1
            # No piece fits: those that can give most are cut until the sequence is full or has no room of another kind.
            while room[0] and left and room[1] >= 1:
                prompts = demand[:, 0] - demand[:, 2]
                gives = np.where(alive, np.minimum(np.minimum(demand[:, 0] - 1, room[0]), prompts + room[2]), 0)
                i = int(np.argmax(gives))
                take = int(gives[i])
                if take <= 0:
                    break
                key, start, length, prompt = pool[i]
                free = min(prompt, take)
                chosen.append((key, start, take, free))
                room -= (take, 1, take - free)
                pool[i] = (key, start + take, length - take, prompt - free)
                demand[i] = (length - take, 1, length - take - prompt + free)
                scaled[i] = demand[i] / self.limits
            if room[0]:
                self._tail(chosen)
            else:
                self._emit(chosen)
        self.pool = [p for p, on in zip(pool, alive) if on]

    def _tail(self, pieces: list[tuple]) -> None:
        """An unfilled sequence, cut into sequences whose lengths are powers of two."""
        total = sum(p[2] for p in pieces)
        while total:
            size = 1 << (total.bit_length() - 1)
            row, have = [], 0
            while have < size:
                key, start, length, prompt = pieces.pop(0)
                take = min(length, size - have)
                row.append((key, start, take, min(prompt, take)))
                if take < length:
                    pieces.insert(0, (key, start + take, length - take, max(0, prompt - take)))
                have += take
            self._emit(row)
            total -= size

    def drain(self):
        out, self.out = self.out, []
        return out


def first_line(text: Column) -> Column:
    """A text up to and with its first line break: the prompt of instruction data. Null where there is no second line."""
    return F.when(F.instr(text, "\n") > 0, F.concat(F.substring_index(text, "\n", 1), F.lit("\n")))


SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    max_tokens: int = 4096,
    max_segments: int = 64,
    max_loss: int = 4096,
) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    No sequence has more than ``max_tokens`` tokens, ``max_segments`` pieces or ``max_loss`` loss-bearing tokens.
    ``prompt_col`` holds the leading part of a document's text that bears no loss: its ids are counted, at most all of the
    document's; without it, or where it is null, all ids bear loss, the end id among them. Null and empty texts are the end id alone, null ids are kept as they are,
    repeated rows are packed once each, very long texts are cut, an empty table gives an empty one; extra columns
    are ignored, whatever their names.
    """

    @frugal
    def run(batches):
        words = worker_tokens(tokenizer_path)
        task = TaskContext.get()
        packer = SequencePacker((task.partitionId() if task else 0) << 33, max_tokens, max_segments, max_loss)
        held: dict[int, list] = {}  # documents with pieces that are not placed yet: [id, bytes, tokens left]
        number = 0

        def rows():
            done = packer.drain()
            cols = [[] for _ in range(7)]
            for key, start, length, sequence, at in done:
                doc = held[key]
                crc = zlib.crc32(memoryview(doc[1])[4 * start : 4 * (start + length)])
                for col, value in zip(cols, (doc[0], start, length, crc, len(doc[1]) // 4, sequence, at)):
                    col.append(value)
                doc[2] -= length
                if not doc[2]:
                    del held[key]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])]
            return pa.RecordBatch.from_arrays(arrays, names)

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                for key, ids, prompt in zip(part.column(0).to_pylist(), words.encode(part.column(1)), words.encode(part.column(2))):
                    ids += END_ID.to_bytes(4, "little")
                    length = len(ids) // 4
                    held[number] = [key, ids, length]
                    packer.add(number, length, min(length, len(prompt) // 4))
                    number += 1
                if len(packer.out) >= 5000:
                    yield rows()
        packer.pack()
        if packer.out:
            yield rows()

    prompt = F.lit(None).cast("string") if prompt_col is None else col(prompt_col)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), prompt.alias("prompt"))
    return source.mapInArrow(run, f"id {kind}, {SCHEMA}")
