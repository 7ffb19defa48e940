"""Which items does a document contain, by the share of their words or character 5-grams that it has.

Items are turned into postings (feature to items) that every task holds; a document's features are looked up in them and counted per item
on arrays. Items are taken in blocks of bounded size, so that there may be any number of them; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.functions import text as tx

#: Characters of items whose postings one pass holds, and counts (documents times items) that are made at once.
BLOCK_CHARS, COUNTS = 8 << 20, 1 << 22
GRAM = 5


class Grams:
    """Distinct character 5-grams as numbers of five digits over the items' alphabet; a shorter text is a gram of its own."""

    def __init__(self, items: list[str]):
        letters = sorted({c for t in items for c in t})
        if (len(letters) + 2) ** GRAM >= 1 << 63:
            raise ValueError("an alphabet of more than 6,000 letters needs smaller blocks of items")
        self._digit = np.zeros(0x110000, np.int64)
        self._digit[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self._base = len(letters) + 1
        self._short = {t: -1 - i for i, t in enumerate(sorted({t for t in items if len(t) < GRAM}))}

    def of(self, t: str) -> np.ndarray:
        if len(t) < GRAM:
            return np.array([self._short[t]] if t in self._short else [], np.int64)
        digits = self._digit[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)]
        n = len(digits) - GRAM + 1
        number, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(GRAM):
            number = number * self._base + digits[k : k + n]
            known &= digits[k : k + n] > 0
        return np.unique(number[known])


class Words:
    """Distinct words of two letters or more, by their number among the items' words."""

    def __init__(self, items: list[str]):
        self._number = {w: i for i, w in enumerate(sorted({w for t in items for w in t.split(" ") if len(w) > 1}))}

    def of(self, t: str) -> np.ndarray:
        return np.array(sorted({self._number[w] for w in t.split(" ") if w in self._number}), np.int64)


class Postings:
    def __init__(self, kind, texts: list[str]):
        self.kind = kind(texts)
        per_item = [self.kind.of(t) for t in texts]
        self.sizes = np.array([len(f) for f in per_item], np.int64)
        features = np.concatenate(per_item) if per_item else np.array([], np.int64)
        order = np.argsort(features, kind="stable")
        self._items = np.repeat(np.arange(len(texts)), self.sizes)[order]
        self._features, self._start, counts = np.unique(features[order], return_index=True, return_counts=True)
        self._counts = counts

    def shared(self, texts: list[str]) -> np.ndarray:
        """How many features each text shares with each item."""
        out = np.zeros((len(texts), len(self.sizes)), np.int64)
        for row, t in zip(out, texts):
            own = self.kind.of(t)
            at = np.searchsorted(self._features, own)
            at = at[(at < len(self._features)) & (self._features[np.minimum(at, len(self._features) - 1)] == own)] if len(self._features) else at[:0]
            n = self._counts[at]
            # All postings of the features that are there, one after the other.
            places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self._start[at], n)
            row += np.bincount(self._items[places], minlength=len(row))
        return out


def contained(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, kind: str, share: float, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc, item, shared, size) of every pair in which the document has ``share`` (above 0) or more of the item's features.

    ``kind``: ``char5`` (of the text without spaces), ``words``, or ``tokens`` (what stands between the spaces of texts taken as they are). Other texts are normalised to lower-cased letters and digits. Items and documents
    without a feature, and null texts, contain nothing and are contained nowhere. Ids of any type; repeated rows give repeated pairs.
    """
    plain = {"tokens": F.col(text), "words": tx.normalise(F.col(text)), "char5": F.replace(tx.normalise(F.col(text)), F.lit(" "), F.lit(""))}[kind]
    rows = docs.select(F.col(doc_id).alias("doc"), F.coalesce(plain, F.lit("")).alias("text"))
    own = items.select(F.col(item_id).alias("item"), F.coalesce(plain, F.lit("")).alias("text")).where("text <> ''")
    chars = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    schema = StructType([rows.schema["doc"], own.schema["item"], StructField("shared", LongType()), StructField("size", LongType())])
    out = None
    for block in range(blocks):
        # Each block of items is of bounded size, whatever the table's.
        held = own.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        part = rows.mapInArrow(_counter([r["text"] for r in held], [r["item"] for r in held], Grams if kind == "char5" else Words, share, schema), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _counter(texts: list[str], ids: list, kind, share: float, schema: StructType):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        postings = Postings(kind, texts)
        least = np.maximum(np.ceil(postings.sizes * share - 1e-9), 1)
        names = pa.array(ids, arrow.field("item").type)
        step = max(1, COUNTS // max(len(texts), 1))
        for batch in batches:
            for at in range(0, batch.num_rows if texts else 0, step):
                some = batch.slice(at, step)
                shared = postings.shared(some.column("text").to_pylist())
                d, i = np.nonzero(shared >= least)
                yield pa.RecordBatch.from_arrays([some.column("doc").take(pa.array(d)), names.take(pa.array(i)), pa.array(shared[d, i]), pa.array(postings.sizes[i])], schema=arrow)

    return count
