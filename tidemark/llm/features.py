"""Hashed word features and bounded labelled samples for the text classifiers."""

from __future__ import annotations

import zlib
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, frugal, holdout_bucket

#: Byte -> space for everything that is not a letter, digit or part of a multi-byte character.
_SPLIT = bytes(i if chr(i).isalnum() and i < 128 or i >= 128 else 32 for i in range(256))
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_TABLE = bytes(_LOWER[_SPLIT[i]] for i in range(256))
#: Words a task remembers the hashed slot of.
CACHE = 200_000


#: Bytes of the word beginnings that are features beside the word itself.
PREFIXES = (4, 5, 7)
N_FORMS = 1 + len(PREFIXES)


class Slots(dict):
    """Word to a number; ``slots[number]`` are the hashed slots of the word and of its beginnings."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size
        self.slots = np.zeros((1024, N_FORMS), np.int64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def numbers(self, words: list[list[bytes]]) -> np.ndarray:
        """The numbers of all words in order. New words are hashed together."""
        known = len(self)
        out = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        new = list(islice(self, known, None))
        if len(self) > len(self.slots):
            self.slots = np.concatenate((self.slots, np.zeros((max(len(self.slots), len(new)), N_FORMS), np.int64)))
        hashed = self.slots[known : len(self)]
        hashed[:, 0] = np.fromiter(map(zlib.crc32, new), np.int64, len(new))
        for i, n in enumerate(PREFIXES, 1):
            hashed[:, i] = np.fromiter(map(zlib.crc32, [w[:n] for w in new], repeat(n)), np.int64, len(new))
        hashed %= self.size
        return out


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def shape_features(text: bytes, n_words: int) -> list[float]:
    """Six dense measures of form: lengths, upper case, symbols, digits, line repetition."""
    n = max(1, len(text))
    upper = n - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if text else 0
    symbols = n - len(text.translate(None, b"#$%&*|!<>{}[]=@~^\\")) if text else 0
    digits = n - len(text.translate(None, b"0123456789")) if text else 0
    lines = text.split(b"\n")
    return [
        np.log1p(n_words) / 8,
        min(1.0, 5 * upper / n),
        min(1.0, 10 * symbols / n),
        min(1.0, 10 * digits / n),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, n / max(1, n_words) / 20),
    ]


N_SHAPE = 6


def features(texts: list[bytes | None], slots: Slots) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of whole texts: the row and slot of each distinct feature, log(1 + its count), and the shapes."""
    words = [words_of(t) if t else [] for t in texts]
    if len(slots) > CACHE:
        slots.clear()
    sizes = [len(w) for w in words]
    numbers = slots.numbers(words)
    row = np.repeat(np.arange(len(texts)), sizes)
    key, count = np.unique(((row * slots.size)[:, None] + slots.slots[numbers]).ravel(), return_counts=True)
    shape = np.array([shape_features(t or b"", n) for t, n in zip(texts, sizes)], float).reshape(-1, N_SHAPE)
    return key // slots.size, key % slots.size, np.log1p(count), shape


def bounded_rows(df: DataFrame, key: str, at_most: int) -> DataFrame:
    """About ``at_most`` rows, chosen by a hash of ``key``; all of them where there are fewer.

    The bound is what a caller documents; it only limits what a classifier is fitted on.
    """
    total = df.count()
    if total <= at_most:
        return df
    cut = int((2**32) * at_most / total)
    return df.where(F.xxhash64(key).bitwiseAND(F.lit(2**32 - 1)) < cut)


class Sample:
    """A bounded labelled sample: sparse rows, shapes and the kept columns."""

    def __init__(self, slots: list, values: list, shape: np.ndarray, kept):
        self.slots, self.values, self.shape, self.kept = slots, values, shape, kept

    def __len__(self) -> int:
        return len(self.slots)

    def batch(self, rows):
        """(row, slot, value, shape) of some rows."""
        sizes = [len(self.slots[i]) for i in rows]
        if not sum(sizes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), self.shape[rows]
        return (
            np.repeat(np.arange(len(rows)), sizes),
            np.concatenate([self.slots[i] for i in rows]),
            np.concatenate([self.values[i] for i in rows]),
            self.shape[rows],
        )

    def presence(self, size: int) -> np.ndarray:
        """How many rows have each slot."""
        return np.bincount(np.concatenate([*self.slots, np.zeros(0, np.int32)]), minlength=size)

    def keep_only(self, mask: np.ndarray) -> None:
        for i, s in enumerate(self.slots):
            keep = mask[s]
            self.slots[i], self.values[i] = s[keep], self.values[i][keep]


def collect_features(df: DataFrame, text_col: str, keep: list[str], size: int) -> Sample:
    """The features of a bounded sample, computed on the executors."""

    @frugal
    def run(batches):
        slots = Slots(size)
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                row, slot, value, shape = features(part.column(0).to_pylist(), slots)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(slot.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(value.astype(np.float32))),
                        pa.array(shape.tolist(), pa.list_(pa.float64())),
                        *part.columns[1:],
                    ],
                    ["slots", "values", "shape", *keep],
                )

    schema = "slots array<int>, values array<float>, shape array<double>, "
    schema += ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep)
    rows = df.select(col(text_col).cast("binary").alias("text"), *keep).mapInArrow(run, schema).toPandas()
    rows = rows.sort_values(keep, kind="stable", ignore_index=True)
    shape = np.array(rows["shape"].tolist(), float).reshape(-1, N_SHAPE)
    return Sample([np.asarray(s, np.int32) for s in rows["slots"]], [np.asarray(v, np.float32) for v in rows["values"]], shape, rows[keep])


def score_rows(docs: DataFrame, id_col: str, text_col: str, size: int, link, fields: str, bucket_mod: int) -> DataFrame:
    """(id, bucket, *fields): ``link(row, slot, value, shape) -> arrays`` applied to every whole text."""
    names = [f.split()[0] for f in fields.split(", ")]

    @frugal
    def run(batches):
        slots = Slots(size)
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                got = link(*features(part.column(2).to_pylist(), slots))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, got)], ["id", "bucket", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(
        col(id_col).alias("id"), holdout_bucket(id_col, bucket_mod).cast("int").alias("bucket"), col(text_col).cast("binary").alias("text")
    )
    return source.mapInArrow(run, f"id {kind}, bucket int, {fields}")
