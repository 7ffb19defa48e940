"""Benchmark decontamination with a distributed positional inverted index.

DataFrame operations only. The index holds postings (term, document, position) of the training text.
Every benchmark window of ``window`` words is looked up through its ``ANCHORS`` rarest terms, as counted
over the whole corpus: only their lists are stored, and their positions, less the term's offset in the
item, are intersected to find where the item's windows can lie. Windows that share an anchor share its
postings. What is left is compared word by word.
Documents are known by id and a hash of the text, so repeated rows are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checked_broadcast, col, materialise

ANCHORS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased, as an array; null has none."""
    return _trimmed(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAPS))


def _trimmed(parts: Column) -> Column:
    """Without the empty strings before a leading and after a trailing gap."""
    lead = (parts[0] == "").cast("int")
    tail = (F.element_at(parts, -1) == "").cast("int")
    return F.slice(parts, lead + 1, F.greatest(F.size(parts) - lead - tail, F.lit(0)))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sequences_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sid, w, items): the distinct word sequences of the items, with the sorted ids of those that have it."""
    words = items.select(col(id_col).cast("string").alias("item"), words_of(col(text_col)).alias("w")).where("size(w) > 0")
    return words.groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("sid", F.xxhash64(F.to_json("w")))


def tokens(docs: DataFrame) -> DataFrame:
    """(key columns, pos, term) of every word, A-Z lower-cased like the words compared in the end."""
    parts = F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), _GAPS)
    cut = docs.select("doc_id", text_key(F.col("text")).alias("th"), parts.alias("parts"))
    cut = cut.select("doc_id", "th", (F.col("parts")[0] == "").cast("int").alias("lead"), F.posexplode("parts").alias("at", "term"))
    return cut.where("term <> ''").select("doc_id", "th", (F.col("at") - F.col("lead")).alias("pos"), "term")


class PositionalIndex:
    """Postings of a corpus for the windows of a benchmark: ``window`` words each, a shorter item being one window.

    ``docs``: doc_id and text. ``sequences`` holds, for each distinct item text, its windows: where they begin and
    which of their words are their rarest terms. ``anchors`` holds these words once, however many windows share them.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = 10):
        self.docs, self.window = docs, window
        plain = materialise(sequences_of(items, item_id, item_text), "sequences")
        terms = plain.select("sid", F.posexplode("w").alias("ipos", "term"))
        vocabulary = checked_broadcast(terms.select("term").distinct())
        counted = tokens(docs).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("n"))
        ranked = terms.join(checked_broadcast(materialise(counted, "terms")), "term", "left").fillna({"n": 0})
        by_place = ranked.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("ipos", "n"))).alias("r"))
        rarest = f"slice(array_sort(transform(slice(r, s + 1, {window}), x -> named_struct('n', x.n, 'ipos', x.ipos))), 1, {ANCHORS})"
        windows = f"transform(sequence(0, greatest(size(w) - {window}, 0)), s -> named_struct('s', s, 'need', transform({rarest}, x -> x.ipos)))"
        self.sequences = materialise(plain.join(by_place, "sid").select("sid", "w", "items", F.expr(windows).alias("windows")), "windows")
        # No window can lie where fewer of an item's anchors meet than any of its windows has.
        least = F.expr("array_min(transform(windows, x -> size(x.need)))").alias("least")
        places = self.sequences.select("sid", "w", least, F.explode(F.array_distinct(F.flatten("windows.need"))).alias("ipos"))
        self.anchors = materialise(places.select("sid", "ipos", "least", F.expr("w[ipos]").alias("term")), "anchors")
        lists = checked_broadcast(self.anchors.select("term").distinct())
        self.postings = materialise(tokens(docs).join(lists, "term"), "postings")

    def candidates(self) -> DataFrame:
        """(doc_id, th, w, items, shift, starts): windows of an item (``starts``) whose anchors' offset-adjusted lists
        meet in a document, the item's first word being at ``shift``."""
        met = self.postings.join(checked_broadcast(self.anchors), "term")
        met = met.groupBy("doc_id", "th", "sid", "least", (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.collect_set("ipos").alias("seen"))
        whole = "filter(windows, x -> shift + x.s >= 0 AND size(array_except(x.need, seen)) = 0)"
        wide = met.where("size(seen) >= least").join(checked_broadcast(self.sequences), "sid")
        return wide.select("doc_id", "th", "w", "items", "shift", F.expr(f"transform({whole}, x -> x.s)").alias("starts")).where("size(starts) > 0")

    def phrase_matches(self) -> DataFrame:
        """(doc_id, th, matches): of documents with a candidate, the windows that occur word by word: start, size, items."""
        grouped = self.candidates().groupBy("doc_id", "th").agg(F.collect_list(F.struct("shift", "w", "items", "starts")).alias("c"))
        found = materialise(grouped, "candidates")
        texts = self.docs.select("doc_id", text_key(F.col("text")).alias("th"), "text")
        texts = texts.join(checked_broadcast(found.select("th").distinct()), "th", "left_semi")
        both = texts.alias("d").join(found.alias("f"), F.expr("d.th = f.th AND d.doc_id <=> f.doc_id")).select("d.doc_id", "d.th", "d.text", "c")

        def exact(words):
            def of_item(x):
                size = F.least(F.size(x["w"]), F.lit(self.window))
                same = F.filter(x["starts"], lambda s: F.slice(words, x["shift"] + s + 1, size) == F.slice(x["w"], s + 1, size))
                return F.transform(same, lambda s: F.struct((x["shift"] + s).alias("start"), size.alias("size"), x["items"].alias("items")))

            return F.flatten(F.transform("c", of_item))

        # Bound as a variable the words are cut once a document; a plain column would be put into the inner function.
        matches = F.transform(F.array(words_of(F.col("text"))), exact)[0]
        kept = both.select("doc_id", "th", matches.alias("matches"))
        return kept.where("size(matches) > 0").dropDuplicates(["doc_id", "th"])

    def proximity_matches(self, slop: int = 20) -> DataFrame:
        """(doc_id, th, sid, s, at): windows all of whose anchors are within ``slop`` words of their rarest one's posting
        at ``at``, in any order."""
        need = self.sequences.select("sid", "w", F.explode("windows").alias("x")).select("sid", "w", "x.s", F.size("x.need").alias("n_anchors"), F.posexplode("x.need").alias("rank", "ipos"))
        anchors = checked_broadcast(need.select("sid", "s", "n_anchors", "rank", F.expr("w[ipos]").alias("term")))
        near = self.postings.join(anchors, "term").withColumn("cell", F.floor(F.col("pos") / slop))
        key = ["doc_id", "th", "sid", "s", "cell"]
        first = near.where("rank = 0").select(*key[:4], "n_anchors", F.col("pos").alias("at"), F.explode(F.expr("array(cell - 1, cell, cell + 1)")).alias("cell"))
        meets = first.join(near.select(*key, "pos", "rank"), key)
        meets = meets.where(F.abs(F.col("pos") - F.col("at")) <= slop)
        seen = meets.groupBy("doc_id", "th", "sid", "s", "at", "n_anchors").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("seen"))
        return seen.where("seen = shiftleft(1, n_anchors) - 1").select("doc_id", "th", "sid", "s", "at")


def clean_rows(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows in which no benchmark window occurs, all columns as they were.

    Null and empty texts, and all rows where the benchmark is empty, stay; repeated rows stay or go together; null
    ids are compared like others; columns may have any name; texts of any length are read whole.
    """
    own = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    hit = checked_broadcast(materialise(PositionalIndex(own, items, window=window).phrase_matches().select("doc_id", "th"), "contaminated"))
    # The user's columns travel as one, so that no name of theirs meets one of ours.
    packed = docs.select(F.struct(*map(col, docs.columns)).alias("row"), col(id_col).alias("doc_id"), text_key(col(text_col)).alias("th"))
    kept = packed.alias("d").join(hit.alias("h"), F.expr("d.th = h.th AND d.doc_id <=> h.doc_id"), "left_anti")
    return kept.select(*[kept["row"][c].alias(c) for c in docs.columns])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words. Repeated rows get equal results. An empty benchmark hits
    nothing. Texts and items are used whole; further columns are ignored, whatever their names.
    """
    own = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    index = PositionalIndex(own, items, window=window)
    hits = index.phrase_matches().select(
        "doc_id",
        "th",
        F.expr("size(array_distinct(flatten(transform(matches, m -> sequence(m.start, m.start + m.size - 1)))))").cast("bigint").alias("n_hit"),
        F.expr("array_sort(array_distinct(flatten(transform(matches, m -> m.items))))").alias("items"),
    )
    parts = F.split(F.coalesce("text", F.lit("")), _GAPS)
    n_words = F.size(parts) - (parts[0] == "").cast("int") - (F.element_at(parts, -1) == "").cast("int")
    base = own.select("doc_id", text_key(F.col("text")).alias("th"), F.greatest(n_words, F.lit(0)).cast("bigint").alias("n_words"))
    joined = base.alias("b").join(hits.alias("h"), F.expr("b.th = h.th AND b.doc_id <=> h.doc_id"), "left")
    items_found = F.coalesce("h.items", F.expr("array()").cast("array<string>"))
    return joined.select(
        F.col("b.doc_id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(items_found).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items_found), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
