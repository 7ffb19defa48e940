"""Periodic runs, the content-addressed archive and the filter audit against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import filter_audit, html_extract, periodic, queries, warc


def plain_runs(words, min_length=24, min_periods=3):
    """Runs by trying every period and every stretch of equal words that far apart."""
    found = {}
    for q in range(1, len(words) // min_periods + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_periods * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 40)), max_size=5), min_size=1, max_size=4), st.sampled_from([(24, 3), (4, 2), (1, 2), (9, 4)]))
def test_runs_equal_brute_force(made, limits):
    docs = []
    for parts in made:
        words = []
        for base, times, back in parts:
            words += base * times + words[len(words) // 2 : len(words) // 2 + back]
        docs.append(words)
    assert periodic.runs_of([np.array(d, np.int64) for d in docs], *limits) == [plain_runs(d, *limits) for d in docs]


@pytest.mark.parametrize("words", [[0] * 3000, [0] * 3000 + [1], [1] + [0] * 3000, ([0] * 9 + [1]) * 300, list(range(40)) * 60, [0, 1] * 700 + [2] + [0, 1] * 700])
def test_long_chains_of_suffixes(words):
    """Suffix arrays that ascend or descend throughout, where pointer jumping alone would take as many rounds as words."""
    assert periodic.runs_of([np.array(words, np.int64)]) == [plain_runs(words)]


def test_nearest_smaller():
    rng = np.random.default_rng(3)
    for values in (rng.permutation(300), np.arange(300), np.arange(300)[::-1], np.append(np.arange(1, 300), 0), np.array([], np.int64)):
        want = [next((j for j in range(i - 1, -1, -1) if values[j] < v), -1) for i, v in enumerate(values)]
        assert periodic.nearest_smaller(values.astype(np.int64)).tolist() == want


def test_op11_equals_brute_force(spark, docs, tmp_path):
    rng = random.Random(2)
    texts = [r["text"] for r in docs.collect()] + ["a b " * 20, "x " + "to be or " * 9 + "to be", "   " * 30, "a\tb\nc\r\x0b\x0c" * 30, "b " * 5000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = [(i, t, "z") for i, t in enumerate(texts)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows) > 5
    spark.createDataFrame(rows, "doc_id bigint, text string, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(tuple(r) for r in got.collect()) == [plain_digest(i, t) for i, t, _ in rows]


def test_op11_given_tables(spark, sf_dir):
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert all(got[r["doc_id"]] == plain_digest(r["doc_id"], r["text"]) for r in rows) and len(got) == len(rows)


def test_runs_of_odd_rows(spark):
    rows = [(None, "a " * 30, 1), ("x", None, 2), ("x", "a b c " * 10, 3), ("x", "a b c " * 10, 3), ("y", "", 4)]
    got = periodic.periodic_runs(spark.createDataFrame(rows, "`my id` string, data string, id int"), "my id", "data").collect()
    runs = sorted((str(r["id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got)
    assert runs == [("None", 30, [(0, 30, 1)], "a"), ("x", 0, [], ""), ("x", 30, [(0, 30, 3)], "a b c"), ("x", 30, [(0, 30, 3)], "a b c"), ("y", 0, [], "")]
    empty = periodic.periodic_runs(spark.createDataFrame([], "doc_id bigint, text string"))
    assert empty.count() == 0 and periodic.run_digest(empty).columns[:2] == ["id", "n_runs"]


def test_strongest_run_ties(spark):
    """Of 30 / 3 = 40 / 4 the one that starts first."""
    text = " ".join(["a b c"] * 10 + ["x"] + ["p q r s"] * 10)
    row = periodic.run_digest(periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (2, 0, 30, 3, 10000)


BODY = "<html>" + "body of a page " * 20 + "</html>"
PAGES = [(1, "http://a/1", BODY, 0, "h"), (2, "http://a/2", "short", 0, "h"), (3, None, None, 0, "h"), (4, "http://a/4\r\nX: 1", BODY, 0, "h"), (5, "http://a/5", "short", 0, "h"),
         (6, "http://a/6", "é" * 50, 0, "h"), (7, "http://a/7", "é" * 50, 0, "h"), (8, "http://a/8", "e" * 99, 0, "h"), (9, "http://a/9", "e" * 99, 0, "h"), (10, None, "", 0, "h")] + [(100 + i, "u", BODY, 0, "h") for i in range(50)]
SCHEMA = "page_id bigint, url string, html string, no int, header string"


def archive(spark, pages, tmp_path, **kw):
    warc.write_archive(pages, f"file://{tmp_path}/arc", **kw)
    return warc.read_archive(spark, f"file://{tmp_path}/arc")


def parsed(record):
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1"
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    assert block[n:] == b"\r\n\r\n"
    http, _, payload = block[:n].partition(b"\r\n\r\n")
    assert http.startswith(b"HTTP/1.1 200 OK\r\n")
    return fields, payload


@pytest.mark.parametrize("copies", [7, 1000])
def test_archive_round_trip(spark, tmp_path, monkeypatch, copies):
    monkeypatch.setattr(warc, "COPIES_A_TASK", copies)
    read = archive(spark, spark.createDataFrame(PAGES, SCHEMA).repartition(3), tmp_path)
    payloads = spark.read.parquet(f"{tmp_path}/arc/payloads").collect()
    assert sorted(r["payload"].decode() for r in payloads) == sorted({p[2] or "" for p in PAGES})
    assert {r["salts"] for r in payloads if r["payload"].decode() == BODY} == {-(-52 // copies)}
    whole = {r["id"]: bytes(r["payload"]) for r in read.collect()}
    assert whole == {p[0]: (p[2] or "").encode() for p in PAGES}
    records = {r["no"]: parsed(bytes(r["record"])) for r in warc.warc_records(read).collect()}
    first = {}
    for page_id, url, html, _, _ in PAGES:
        body = (html or "").encode()
        at = first.setdefault(body, page_id)
        revisit = at != page_id and len(body) >= 100
        fields, payload = records[page_id]
        assert fields["WARC-Type"] == ("revisit" if revisit else "response")
        assert payload == (b"" if revisit else body)
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
        assert fields.get("WARC-Target-URI") == (url.replace("\r", "%0D").replace("\n", "%0A") if url else None)
        assert fields.get("WARC-Refers-To") == (records[at][0]["WARC-Record-ID"] if revisit else None)
    assert len({f["WARC-Record-ID"] for f, _ in records.values()}) == len(PAGES)


def test_op12_rows(spark, tmp_path):
    spark.createDataFrame(PAGES, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in queries.QUERIES["op12_warc_archive"](spark, str(tmp_path)).collect()}
    assert got[6] == (100, hashlib.sha256(("é" * 50).encode()).hexdigest(), "response", None) and got[7][2:] == ("revisit", 6)
    assert got[9][2:] == ("response", None) and got[5][2:] == ("response", None) and got[10][0] == 0
    assert all(got[100 + i][2:] == ("revisit", 1) for i in range(50)) and len(got) == len(PAGES)


def test_archive_of_null_and_repeated_ids(spark, tmp_path):
    rows = [("b", "u", BODY), ("a", "u", BODY), ("a", "u", BODY), (None, "u", BODY)]
    got = archive(spark, spark.createDataFrame(rows, "page_id string, url string, html string"), tmp_path).orderBy("no").collect()
    assert [(r["id"], r["record_type"], r["refers_to"]) for r in got] == [(None, "response", None), ("a", "revisit", None), ("a", "revisit", None), ("b", "revisit", None)]
    rows[3] = ("c", "u", BODY)
    got = archive(spark, spark.createDataFrame(rows, "page_id string, url string, html string"), tmp_path / "2").orderBy("no").collect()
    assert [(r["id"], r["record_type"], r["refers_to"]) for r in got] == [("a", "response", None), ("a", "revisit", "a"), ("b", "revisit", "a"), ("c", "revisit", "a")]
    assert archive(spark, spark.createDataFrame([], SCHEMA), tmp_path / "3").count() == 0


def test_damaged_archive_raises(spark, tmp_path):
    archive(spark, spark.createDataFrame(PAGES, SCHEMA), tmp_path)
    good = spark.read.parquet(f"{tmp_path}/arc/payloads")
    from pyspark.sql import functions as F

    for name, bad, said in (("a", good.withColumn("payload", F.concat("payload", F.lit(b"!"))), "damaged payload"), ("b", good.where("octet_length(payload) < 100"), "no payload")):
        bad.write.parquet(f"{tmp_path}/{name}/payloads")
        spark.read.parquet(f"{tmp_path}/arc/headers").write.parquet(f"{tmp_path}/{name}/headers")
        with pytest.raises(Exception, match=said):
            warc.read_archive(spark, f"{tmp_path}/{name}").select("payload_digest").collect()


def plain_audit(docs, labels):
    rows = []
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs) else set()
        own = [x for x in labels if doc_id is not None and x[0] == doc_id]
        rows.append((source or "", fails, any(q == 1 for _, q, _ in own), any(t == 1 for _, _, t in own)))
    out, orders = {}, ["".join(o) for o in itertools.permutations("ABCDE")]
    for part in {r[0] for r in rows}:
        total = dict.fromkeys("ABCDE", 0)
        for order in orders:
            left = [r for r in rows if r[0] == part]
            every = left
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                failing = [r for r in every if f in r[1]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in every), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for order in orders:
            for step, f in enumerate(order, 1):
                out[part, order, step].append(total[f])
    return out


def test_audit_equals_brute_force(spark, texts):
    rng = random.Random(9)
    more = ["Ab " * 250, "A$ b", "x", "x", "", None, " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), "A" + "b" * 49, "A" + "b" * 48, "a b a b"]
    docs = [(i, t, rng.choice(["s", "t", None, ""])) for i, t in enumerate(texts + more + texts[:20])]
    docs += [(None, "x", "s"), (None, "x", "t"), (3, "one", "s"), docs[7]]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _, _ in docs if i is not None and i % 3] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, True, "m") for d in docs], "doc_id bigint, text string, source string, n int, A boolean, part string").repartition(3)
    got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got.collect()} == plain_audit(docs, labels)


def test_audit_of_nothing_and_of_other_filters(spark):
    none = filter_audit.audit(spark.createDataFrame([], "doc_id bigint, text string, source string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert none.count() == 0
    flags = spark.createDataFrame([("p", True, False), ("p", True, True), ("p", False, False)], "part string, X boolean, Y boolean")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in filter_audit.interactions(flags, ["X", "Y"], {}).collect()}
    assert got == {("XY", 1): (1, 2, 0, 1, 3), ("XY", 2): (1, 0, 1, 0, 1), ("YX", 1): (2, 1, 0, 0, 1), ("YX", 2): (1, 1, 1, 1, 3)}
    with pytest.raises(ValueError, match="between one and six"):
        filter_audit.interactions(flags, [], {})


STORY = "".join(f"<p>{'Plain words of a story that goes on for a while here. ' * 4}</p>" for _ in range(5))


@pytest.mark.parametrize("theme", ["has-sidebar", "no-sidebar", "comments-open", "social-policy", "post has-post-thumbnail hentry", "sidebar-layout", "withAds", "page-id-2 widgets-on", "single-ad-free", "noticeable"])
def test_theme_classes_are_no_marks(theme):
    for page in (f'<div class="{theme}"><article>{STORY}</article></div>', f'<article class="{theme}">{STORY}</article>', f'<article>{STORY}<p class="{theme}">One more paragraph of this story, which stays.</p></article>'):
        assert html_extract.main_text(f"<body>{page}<footer>foot</footer></body>").count("Plain words") == 20


def test_marked_parts_still_go():
    for name in ("comments", "comment-list", "post-comments", "ad", "adBox", "google-ads", "ad slot", "newsletter-signup", "cookie-banner", "related-posts", "site-footer", "social-share-buttons", "sidebar widget", "share"):
        page = f'<body><article>{STORY}<p class="share-price">The share price rose by a lot over the day.</p></article><div class="{name}"><p>Leave this text out of it, please, all of it.</p></div></body>'
        got = html_extract.main_text(page)
        assert "Leave this" not in got and "share price rose" in got and got.count("Plain words") == 20, name
    comments = f'<section class="comments">{"".join(f"<article class=comment><p>{STORY}</p></article>" for _ in range(3))}</section>'
    assert html_extract.main_text(f"<body><article><h1>Head</h1>{STORY}</article>{comments}</body>").count("Plain words") == 20


def test_a_marked_frame_of_the_whole_page_is_kept():
    assert html_extract.main_text(f'<body><div id="content" class="widget"><main>{STORY}</main></div><div class="widget"><p>side text</p></div></body>').count("Plain words") == 20
