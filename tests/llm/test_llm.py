"""Every operator against a plain version on a fixture that holds the awkward cases."""

import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html_extract, imatch, language_id, packing, quality, queries, repeats, simhash, toxicity, url_filter

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("word_bpe_49k.json")


def test_imatch_against_plain_counts_and_hashes(docs, texts):
    """Lexicon flags and subset hashes from their definition, term by term."""
    words = [sorted(set(re.sub(rb"[^a-z0-9\x80-\xff]", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())).split())) for t in texts]
    df = {}
    for own in words:
        for bucket in {xxhash.xxh64_intdigest(w) % imatch.BUCKETS for w in own}:
            df[bucket] = df.get(bucket, 0) + 1
    band = (0.05, 0.4)
    flags = imatch.lexicon(docs, band=band)
    low, high = max(1, band[0] * len(texts)), max(1, band[1] * len(texts))
    assert set(np.flatnonzero(flags).tolist()) == {b for b, n in df.items() if low <= n <= high}
    mask = 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & mask
        return x ^ (x >> 29)

    for own in words:
        hashes = sorted(xxhash.xxh64_intdigest(w) for w in own)
        kept = [h for h in hashes if flags[h % imatch.BUCKETS]] or hashes
        got = imatch.imatch(np.array(hashes, np.uint64), flags)
        for i, rate in enumerate(imatch.RATES):
            for k in range(imatch.REPEATS):
                seed = mix(((k + 1) * 0x9E3779B97F4A7C15) & mask)
                subset = [h for h in kept if mix(h ^ seed) < 1 << (64 - rate)]
                total = sum(mix((h + r * 0x9E3779B97F4A7C15) & mask) for r, h in enumerate(subset)) & mask
                assert got[i, k] == (mix(total) >> 48 if subset else -1)


def test_imatch(docs, texts):
    flags = imatch.lexicon(docs)
    rows = {r["id"]: r for r in imatch.fingerprints_with_next(docs, flags).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, n = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + n[:half]
        assert rows[3 * i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert rows[3 * i]["fingerprint"] == imatch.as_text(imatch.imatch(imatch.term_hashes(t), flags))
        assert 0 <= rows[3 * i]["near_edited"] <= 1
    assert rows[21]["fingerprint"] == rows[24]["fingerprint"]
    assert imatch.fingerprints_with_next(docs.limit(0), imatch.lexicon(docs.limit(0))).count() == 0


def _plain_gru(model, text):
    """Position distributions of one text, straight from the equations."""
    gate = lambda v: np.clip(0.25 * v + 0.5, 0, 1)
    n = model.hidden

    def states(data, d):
        h, out = np.zeros(n), []
        for byte in data:
            a, g = model.p["E" + d][byte].astype(float), h @ model.p["U" + d].astype(float)
            z, r = gate(a[:n] + g[:n]), gate(a[n : 2 * n] + g[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(a[2 * n :] + r * g[2 * n :])
            out.append(h)
        return np.array(out).reshape(-1, n)

    both = np.concatenate((states(text, "f"), states(text[::-1], "b")[::-1]), axis=1)
    logits = both @ model.p["W"] + model.p["c"]
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def test_language_network_against_the_equations():
    """Every gradient against differences of the loss; batched labels of whole texts against one text at a time."""
    model = language_id.ByteGRU(["a", "b", "c"], hidden=4)
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    x, y = np.frombuffer(b"ab cabbcaba ccb", np.uint8).reshape(3, 5).T, np.array([0, 2, 1])
    loss = lambda: -np.mean([np.log(_plain_gru(model, x[:, i].tobytes())[:, y[i]]) for i in range(3)])
    grads = model.gradients(x, y)
    for name, grad in grads.items():
        for at in [np.unravel_index(i, grad.shape) for i in np.argsort(-np.abs(grad), axis=None)[:4]]:
            old = model.p[name][at]
            model.p[name][at] = old + 1e-5
            up = loss()
            model.p[name][at] = old - 1e-5
            down = loss()
            model.p[name][at] = old
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-4
    model = language_id.ByteGRU(["a", "b", "c"], hidden=6, seed=9)
    rng = np.random.default_rng(2)
    texts = ["", "x", "Un été à l'école", None, "w " * 700, "".join(chr(int(c)) for c in rng.integers(32, 400, 5000))]
    got = model.document_probabilities(pa.array(texts))
    for t, p in zip(texts, got):
        data = (t or "").encode()
        want = _plain_gru(model, data).mean(axis=0) if data else np.zeros(3)
        assert np.abs(p - want).max() < (1e-4 if len(data) <= language_id.WINDOW else 5e-3)


def test_language_prediction(spark):
    rows = [(i, "der und die nicht ein", "de") if i % 2 else (i, "the and of with from", "en") for i in range(80)] + [(90, None, "de"), (91, "12 %", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["id"]: r for r in language_id.predict(docs, language_id.train(docs)).collect()}
    assert all(got[i]["lang_pred"] == ("de" if i % 2 else "en") for i in range(80))
    assert got[90]["lang_pred"] == got[91]["lang_pred"] == "und"
    assert got[5]["held_out"] == (zlib.crc32(b"5") % 4 == 2)
    assert language_id.predict(docs.limit(0), language_id.train(docs.limit(0))).count() == 0


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(docs, PATH).collect()
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted((r for r in rows if r["id"] == 3 * i), key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def _packed(limits, lengths, prompts):
    p = packing.SequencePacker(0, *limits)
    for i, (n, free) in enumerate(zip(lengths, prompts)):
        p.add(i, n, free)
    p.pack()
    by, seen = {}, {}
    for key, start, length, sequence, at in p.drain():
        loss = max(0, start + length - max(start, prompts[key]))
        by.setdefault(sequence, []).append((length, loss))
        seen.setdefault(key, []).append((start, length))
    assert all(sorted(v)[0][0] == 0 and sum(n for _, n in v) == lengths[k] for k, v in seen.items()) and len(seen) == len(lengths)
    sums = [(sum(n for n, _ in rows), len(rows), sum(b for _, b in rows)) for rows in by.values()]
    assert all(a <= m for row in sums for a, m in zip(row, limits))
    assert all(n == limits[0] or n & (n - 1) == 0 for n, _, _ in sums)
    return np.array(sums)


def test_packer_keeps_all_limits_where_each_binds():
    rng = np.random.default_rng(1)
    long = rng.integers(1, 150, 600).tolist()
    tokens = _packed((64, 40, 64), long, [0] * 600)
    assert (tokens[:, 0] == 64).mean() > 0.9
    segments = _packed((64, 3, 64), rng.integers(1, 5, 600).tolist(), [0] * 600)
    assert segments[:, 1].max() == 3 and segments[:, 0].max() < 64  # the pieces of a full sequence are cut at powers of two
    loss = _packed((64, 40, 20), long, [int(n * 0.5) for n in long])
    assert loss[:, 2].max() == 20 and (loss[:, 2] >= 16).mean() > 0.3


def test_packing_counts_the_ids_of_the_first_line(spark):
    """Loss-bearing ids of every sequence, counted from the tokenizer's ids of the first lines, stay within the limit."""
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(PATH).encode
    count = lambda t: len(encode(t, add_special_tokens=False).ids)
    rng = np.random.default_rng(5)
    words = ["internationalisation", "a", "of", "Zürich", "x1y2z3", "don't", "...", "straightforwardly"]
    say = lambda n: " ".join(rng.choice(words, n))
    texts = [say(rng.integers(1, 60)) + "\n" + say(rng.integers(1, 90)) for _ in range(60)]
    texts += [None, "", "\n", "\n" + say(20), say(30), say(300) + "\n", "one\r\n" + say(9), say(700) + "\nb"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, prompt string")
    asked = docs.select("doc_id", "text", packing.first_line(F.col("text")).alias("p"), "prompt")
    rows = packing.pack_documents(asked.coalesce(1), PATH, prompt_col="p", max_tokens=256, max_segments=8, max_loss=128).collect()
    prompt = [count(t.split("\n")[0]) if t and "\n" in t else 0 for t in texts]
    loss, tokens = {}, {}
    for r in rows:
        bears = max(0, r["start"] + r["length"] - max(r["start"], prompt[r["id"]]))
        loss[r["sequence_id"]] = loss.get(r["sequence_id"], 0) + bears
        tokens[r["id"]] = tokens.get(r["id"], 0) + r["length"]
    assert max(loss.values()) == 128
    assert [tokens[i] for i in range(len(texts))] == [count(t or "") + 1 for t in texts]


def test_url_rules_and_trees(spark):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/")]
    urls = ["http://A.example.COM/en/1", "http://a.example.com/en/77?x=1", "https://b.net/de/#q", "http://xcom/en/", None, "no scheme", "http://c.org/fr/1"] * 3
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, rules, trees=2).collect()}
    assert [got[i]["rule"] for i in range(7)] == ["com/en/", "example.com/en/7", "net/de/", None, None, None, None]
    assert (got[0]["host"], got[0]["path"], got[4]["host"], got[5]["path"]) == ("a.example.com", "/en/1", "", "")
    assert [got[i]["verdict"] for i in range(3)] == ["block", "allow", "block"]
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_url_query_gives_the_verdicts_of_its_contract(spark, tmp_path):
    urls = {"https://a.example.com/en/1": "block", "https://example.com/en/71?q": "allow", "https://b.net/de/1": "allow", "https://x.Example.NET/de/8#a": "block", "https://example.net/de/7": "allow", "ftp://c.org/es/": "block"}
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.op4_url_trees(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [r["rule"] for r in rows] == ["com/en/", "example.com/en/7", "net/de/", "example.net/de/8", "net/de/", "org/es/"]
    assert [r["verdict"] for r in rows] == list(urls.values())


def test_url_trees_separate_planted_urls_and_leave_the_share_out(spark):
    """Nine of ten labelled URLs are blocked; undecided ones still go by what they look like."""
    rows = [f"http://a{i}.spam.test/buy/{i * 7919 % 100003}/?id={i}&x=1&y=2" for i in range(180)] + [f"http://www.good.test/about/us-{'abc'[i % 3]}" for i in range(20)]
    ask = [f"http://b{i}.other.test/sell/{i * 7907 % 100003}/?id={i}&x=3&y=4" for i in range(20)] + [f"http://www.fine.test/pages/we-{'abc'[i % 3]}" for i in range(20)]
    pages = spark.createDataFrame(list(enumerate(rows + ask)), "page_id int, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, [("block", "spam.test/"), ("allow", "good.test/")]).collect()}
    assert [got[i]["rule"] for i in (0, 180, 200)] == ["spam.test/", "good.test/", None]
    assert {got[200 + i]["verdict"] for i in range(20)} == {"block"} and {got[220 + i]["verdict"] for i in range(20)} == {"allow"}
    again = url_filter.lexical(url_filter.match_rules(pages.withColumn("host", url_filter.host_of(pages["url"])).withColumn("path", url_filter.path_of(pages["url"])), [])).where("page_id = 0").first()
    url = rows[0]
    share = [url.count(c) / len(url) for c in set(url)]
    assert again["entropy"] == round(-sum(p * np.log(p) for p in share), 1) and again["n_params"] == sum(c in "=&" for c in url)
    assert again["digit_share"] == round(sum(c.isdigit() for c in url) / len(url), 2) and again["n_depth"] == 3


def test_ordinal_gradient_steps_lower_the_loss(spark):
    """The fitted model against a grid of other thresholds and scales: none has a better likelihood."""
    rng = np.random.default_rng(4)
    grade = rng.integers(0, 3, 300)
    slots = [np.array([int(g) * 3 + int(k), 20 + int(rng.integers(5))], np.int32) for g, k in zip(grade, rng.integers(0, 3, 300))]
    sample = quality.Sample(slots, [np.ones(2, np.float32)] * 300, np.zeros((300, quality.N_SHAPE)), None)
    model = quality.OrdinalModel(3, 64).fit(sample, grade, epochs=4000, l2=1e-3)

    def loss(m):
        f = m.decision(*sample.batch(np.arange(300)))
        edges = np.concatenate(([-np.inf], m.cuts, [np.inf]))
        p = 1 / (1 + np.exp(-(edges[grade + 1] - f))) - 1 / (1 + np.exp(-(edges[grade] - f)))
        return -np.log(np.maximum(p, 1e-12)).mean() + 5e-4 * (m.weights @ m.weights)

    best = loss(model)
    assert model.cuts[0] < model.cuts[1] and best < 0.7
    for shift in (-0.3, 0.3):
        for k in range(2):
            other = quality.OrdinalModel(3, 64)
            other.weights, other.cuts = model.weights, model.cuts + shift * (np.arange(2) == k)
            assert loss(other) > best
    for scale in (0.8, 1.25):
        other = quality.OrdinalModel(3, 64)
        other.weights, other.cuts = model.weights * scale, model.cuts
        assert loss(other) > best


def test_ordinal_quality_orders_grades(spark):
    rows = [(i, ["bad junk word", "plain fair word", "fine great word"][i % 3] + f" w{i}", i % 3) for i in range(150)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "")], "doc_id bigint, text string")
    ratings = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, grade int")
    got = {r["id"]: r for r in quality.score(docs, quality.train(docs, ratings, 3)).collect()}
    mean = [np.mean([got[i]["expected_grade"] for i in range(k, 150, 3)]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2] and all(r["tail_1"] >= r["tail_2"] for r in got.values())
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), ratings, 3)).count() == 0


def _simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes(docs, texts):
    got = {r["id"]: r for r in simhash.near_duplicate_classes(docs).collect()}
    marks = [_simhash(t) for t in texts]
    up = list(range(len(marks)))
    for _ in marks:
        for i, a in enumerate(marks):
            for j, b in enumerate(marks):
                if (a ^ b).bit_count() <= 4:
                    up[i] = up[j] = min(up[i], up[j])
    for i, m in enumerate(marks):
        assert got[3 * i]["fp"] & (2**64 - 1) == m and got[3 * i]["component_id"] == 3 * up[i]
    assert simhash.near_duplicate_classes(docs.limit(0)).count() == 0


def test_simhash_grid_loses_no_link():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([fp] + [fp ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, False))) for k in (1, 2, 3, 4, 5) for _ in range(4)]))
    for d, groups in ((4, 6), (6, 8)):
        forest = simhash._Forest()
        un = simhash._unary_np(fp)
        for mask in simhash.grid_masks(d, groups):
            cell = (un & np.uint64(mask & (2**64 - 1))).view(np.int64)
            order = np.argsort(cell, kind="stable")
            simhash._link_cells(cell[order], fp[order, None], d, forest)
        for i in range(len(fp)):
            near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= d)
            assert len({forest.find(int(fp[j])) for j in near}) == 1


def test_wide_sketch_finds_near_copies_and_leaves_others(spark):
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(4000)]
    base = [list(rng.choice(vocab, int(n))) for n in rng.integers(60, 400, 60)]
    rows = [(10 * i, " ".join(words)) for i, words in enumerate(base)]
    want = {}
    for i, words in enumerate(base):
        copy = list(words)
        for at in rng.choice(len(words), max(1, len(words) // 60), False):
            copy[at] = "changed"
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, copy))
        if len(a & b) / len(a | b) >= 0.82:
            rows.append((10 * i + 1, " ".join(copy)))
            want[10 * i + 1] = 10 * i
    df = spark.createDataFrame(rows + [(9001, None), (9002, ""), (9003, " ")], "doc_id bigint, text string").selectExpr("*", "'clash' AS id")
    kept = {r["doc_id"] for r in simhash.representatives(df).collect()}
    assert len(want) > 30
    assert {10 * i for i in range(60)} <= kept
    assert len(kept & set(want)) <= 0.1 * len(want)
    assert kept & {9001, 9002, 9003} == {9001}
    assert simhash.representatives(df.limit(0)).columns == df.columns


def _sets_of(text, n=5):
    words = text.lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def test_representatives_are_exact_at_jaccard_four_fifths(spark):
    """Pairs just above and below 0.8, chains and different texts of equal 64-bit fingerprint, against brute force."""
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(3000)]
    passage = list(rng.choice(vocab, 60))
    texts = []
    for n in rng.integers(8, 400, 60):
        words = list(rng.choice(vocab, int(n)))
        if n % 3 == 0:
            words += passage
        texts.append(words)
        for k in range(4):
            copy = list(texts[-1] if k == 3 else words)
            for at in rng.choice(len(copy), max(1, round(len(copy) * (0.012, 0.022, 0.026, 0.02)[k])), False):
                copy[at] = f"x{rng.integers(10**9)}"
            texts.append(copy)
    big = list(rng.choice(vocab, 3000))
    texts += [big, *([*big[:at], "edited", *big[at + 1 :]] for at in (40, 900, 2000))]
    texts = [" ".join(t) for t in texts]
    sets = [_sets_of(t) for t in texts]
    root, near = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                near += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert near > 60 and len(set(root)) > 100
    assert {r["doc_id"] for r in simhash.representatives(df).collect()} == set(root)


def test_texts_of_one_fingerprint_keep_their_own_sets(spark):
    from tidemark.llm import jaccard

    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words)] + [" ".join([*words[:at], "edited", *words[at + 1 :]]) for at in range(0, 3000, 100)]
    by_fp = {}
    for t in texts:
        by_fp.setdefault(simhash.fingerprint(t.encode(), 5), []).append(t)
    same = max(by_fp.values(), key=len)
    df = spark.createDataFrame(list(enumerate(same)), "doc_id bigint, text string")
    names = jaccard.marks(df, "doc_id", "text", 5).select("fp", "name").collect()
    assert len(same) > 1 and len({r["name"] for r in names}) == len(same) and len({r["fp"] for r in names}) == 1


def _repeats(texts, size=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for s in range(len(b) - size + 1):
            if b[s : s + size] in seen:
                cover[s : s + size] = True
            seen.add(b[s : s + size])
        out.append((len(b), int(cover.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeats(docs, texts, hot, monkeypatch):
    monkeypatch.setattr(repeats, "REFINE_FROM", hot)
    monkeypatch.setattr(repeats, "STEP_BYTES", 5000)
    rows = {r["id"]: r for r in repeats.removal_digest(repeats.remove_repeats(docs)).collect()}
    for i, want in enumerate(_repeats(texts)):
        r = rows[3 * i]
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == want
    assert repeats.removal_digest(repeats.remove_repeats(docs.limit(0))).count() == 0


def test_repeats_with_equal_and_null_ids(spark):
    body = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, body), (1, body), (None, body), (2, body + "x")], "doc_id bigint, text string")
    got = sorted(r["n_removed"] for r in repeats.removal_digest(repeats.remove_repeats(docs)).collect())
    assert got == [0, len(body), len(body), len(body)]


CLASHES = ["doc", "data", "k", "cover", "row", "id", "th", "_id", "_th", "fp", "name", "n", "key", "part", "h", "w", "shift", "prompt", "share", "positive", "bucket", "host"]


def test_columns_of_any_name_pass_every_stage(spark, texts):
    import corpus_pipeline

    rows = [(i, t, *[f"{c}-{i}" for c in CLASHES]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    items = spark.createDataFrame([(1, "alpha1 beta2 gamma3")], "item_id int, text string")
    lenient = toxicity.PUModel()
    lenient.bias = -1.0
    for kept in (simhash.representatives(docs), corpus_pipeline.cut_repeats(spark, docs, None), decontaminate.clean_rows(docs, items), toxicity.clean_rows(docs, lenient)):
        assert kept.columns == docs.columns
        found = kept.collect()
        assert found and all(r[c] == f"{c}-{r['doc_id']}" for r in found for c in CLASHES)
    assert packing.pack_documents(docs, PATH).select("id").distinct().count() == len(texts)
    assert imatch.fingerprints_with_next(docs, imatch.lexicon(docs)).count() == len(texts)


def test_repeats_with_text_ids(spark):
    body = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([("b", body), ("a", body), ("c", "x" + body)], "doc_id string, text string")
    got = {r["id"]: r["n_removed"] for r in repeats.removal_digest(repeats.remove_repeats(docs)).collect()}
    assert got == {"a": 0, "b": len(body), "c": len(body)}


def test_passages_join_parts_of_long_repeats(spark):
    rng = np.random.default_rng(6)
    say = lambda n: " ".join(f"w{int(x)}" for x in rng.integers(0, 10**6, n))
    passage, short = say(300), say(25)
    texts = [say(40) + passage + say(20), say(15) + short + say(9), passage + say(30) + short, say(5) + passage[200:1500] + say(4)]
    docs = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "doc bigint, data binary")
    rows = repeats.RepeatFinder(docs).passages().collect()
    data = [t.encode() for t in texts]
    for r in rows:
        assert data[r["doc"]][r["pos"] : r["pos"] + r["length"]] == data[r["first_doc"]][r["first_pos"] : r["first_pos"] + r["length"]]
    found = {(r["doc"], r["first_doc"]): r["length"] for r in rows if r["length"] > 120}
    assert abs(found[2, 0] - len(passage)) <= 3 and abs(found[2, 1] - len(short)) <= 3 and abs(found[3, 0] - 1300) <= 3


def test_decontamination(spark, docs, texts):
    passage = texts[11].split()[5:30]
    items = spark.createDataFrame([(1, " ".join(passage).upper()), (2, "one"), (3, None), (4, "never seen words at all in any of these many texts")], "item_id int, text string")
    rows = {r["doc_id"]: r for r in decontaminate.contamination(docs, items).collect()}
    rx = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: rx.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for k, t in ((1, " ".join(passage).upper()), (2, "one"), (4, "never seen words at all in any of these many texts")):
        w = low(t)
        for s in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(str(k))
    for i, t in enumerate(texts):
        w, hit, found = low(t), set(), set()
        for s in range(len(w)):
            for n in (1, 10):
                if s + n <= len(w) and (x := windows.get(tuple(w[s : s + n]))):
                    hit.update(range(s, s + n))
                    found |= x
        r = rows[3 * i]
        want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == want
    assert sum(r["contaminated"] for r in rows.values()) >= 3
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    index = decontaminate.PositionalIndex(docs.select("doc_id", "text"), items)
    assert index.proximity_matches().count() >= index.phrase_matches().count()


def test_toxicity_risk_and_gradient_against_their_definition():
    rng = np.random.default_rng(8)
    n, k = 40, 6
    dense = rng.integers(0, 2, (n, k)) * rng.random((n, k)).astype(np.float32)
    shape, positive = rng.random((n, toxicity.N_SHAPE)), (rng.random(n) < 0.3).astype(np.uint8)
    ptr = np.concatenate(([0], np.cumsum((dense > 0).sum(axis=1))))
    slot, value = np.nonzero(dense)[1], dense[dense > 0]
    for prior, scale in ((0.2, 0.5), (0.9, 3.0)):
        theta = rng.normal(size=k + toxicity.N_SHAPE + 1) * scale

        def risk(t):
            f = dense @ t[:k] + shape @ t[k:-1] + t[-1]
            soft = lambda x: np.logaddexp(0, x)
            on = positive == 1
            return prior * soft(-f[on]).mean() + max(0.0, soft(f).mean() - prior * soft(f[on]).mean())

        parts = toxicity.risk_parts(theta, ptr, slot, value, shape, positive)
        halves = [toxicity.risk_parts(theta, p - p[0], slot[p[0] : p[-1]], value[p[0] : p[-1]], shape[r], positive[r]) for r, p in ((slice(0, 15), ptr[:16]), (slice(15, n), ptr[15:]))]
        assert np.allclose(halves[0] + halves[1], parts)
        grad = toxicity.descent_gradient(parts, prior)
        for i in range(len(theta)):
            step = np.eye(len(theta))[i] * 1e-5
            assert abs((risk(theta + step) - risk(theta - step)) / 2e-5 - grad[i]) < 1e-6


def test_toxicity_learns_from_positives(spark):
    rows = [(i, ("vile awful scum " if i % 5 == 0 else "") + f"some text number{i % 7} here", int(i % 5 == 0 and i % 2 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    got = {r["id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert np.mean([got[i] for i in range(0, 400, 5)]) > np.mean([got[i] for i in range(1, 400, 5)]) + 0.2
    assert 0 <= got[900] <= 1
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.clean_rows(docs, none).count() == 401


def test_html_extraction(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div>
    <article><h1>Head &amp; line</h1><p>First   long paragraph of the article, with many words in it.<br>More.<p>Second one &eacute;.
    <div class="comments"><p>Nice post!</p></div></article><aside>Side</aside><form>Sign <button>up</button></form><footer>&copy; x</footer></body></html>"""
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>only text</p>"), (5, "u", "<nav>menu</nav>")], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got[1] == "Head & line\n\nFirst long paragraph of the article, with many words in it. More.\n\nSecond one é."
    assert (got[2], got[3], got[4], got[5]) == ("", "", "only text", "")
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_ratio_decides_and_long_pages_are_linear(monkeypatch):
    menu = "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(8))
    story = "".join(f"<p>{'Plain words of a story that goes on for a while here. ' * 4}</p><p>Short.</p>" for _ in range(6))
    page = f"<html><body><div><ul>{menu}</ul></div><div>{story}</div><div><ul>{menu}</ul></div></body></html>"
    got = html_extract.main_text(page)
    assert "Section" not in got and got.count("Short.") == 6
    # A ratio by hand: text that is no link over tags, spread by a Gaussian of 1.5 lines.
    lines = html_extract.PageLines()
    lines.feed(page)
    lines.close()
    plain = [(len(t) - linked) / max(1, tags) for t, linked, tags, _, _ in lines.lines]
    level, own, _ = html_extract.text_to_tag(lines.lines)
    for i in range(len(plain)):
        near = [(np.exp(-0.5 * ((i - j) / 1.5) ** 2), plain[j]) for j in range(max(0, i - 5), min(len(plain), i + 6))]
        assert np.isclose(level[i], np.log1p(sum(w * x for w, x in near) / sum(w for w, _ in near))) and np.isclose(own[i], np.log1p(plain[i]))
    monkeypatch.setattr(html_extract, "text_to_tag", lambda lines: (np.ones(len(lines)), np.ones(len(lines)), 0.5))
    assert "Section" in html_extract.main_text(page)
    monkeypatch.undo()
    began = time.time()
    assert html_extract.main_text("<div>" * 200_000) == ""
    short = time.time() - began
    html_extract.main_text("<div>" * 400_000)
    assert time.time() - began - short < 6 * short + 1
    assert html_extract.main_text("<p>One line of text.</p><select><option>a<p>Another line of text.</p>").endswith("Another line of text.")
    inner = "<article><p>" + "Words of the text. " * 20 + '</p><div class="search"><p>A paragraph on search that stays.</p></div></article>'
    assert "that stays" in html_extract.main_text(inner)


def test_word_tokens_equal_whole_encoding():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    odd = ["", None, "don't won't x're 'S", "İstanbul x", "a\x1cb c\x0bd", "<|endoftext|> hi", "x" * 500, "한글,한!! 12a34", "á ́x", "ẞß ǅ"]
    for text, ids in zip(odd, packing.WordTokens(PATH).encode(pa.array(odd))):
        assert ids == np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_capital_sigma_in_tokens_and_anchors(spark):
    from tokenizers import Tokenizer

    greek = ["ΟΔΟΣ", "ΟΔΟΣ και ΣΑΣ, ΟΔΟΣ.ΑΒΓ x'Σ"]
    for text, ids in zip(greek, packing.WordTokens(PATH).encode(pa.array(greek))):
        assert ids == np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    passage = "ΟΔΟΣ.ΑΒΓ one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"start {passage.replace('.', ' ')} end"), (2, f"start {passage} end")], "doc_id int, text string")
    items = spark.createDataFrame([("a", passage)], "item_id string, text string")
    assert {r["doc_id"]: r["contaminated"] for r in decontaminate.contamination(docs, items).collect()} == {1: True, 2: True}


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.columns == docs.columns and set(before.values()) >= set(rows.values()) and len(set(rows.values())) == len(rows)
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, sf_dir).collect()}
    want = {i: w for i, w in zip(sorted(before), _repeats([before[i] for i in sorted(before)]))}
    assert all(len(cut[i].encode()) <= want[i][0] - want[i][1] and len(cut[i].encode()) >= want[i][0] - want[i][1] - 6 * 8 for i in before)
    clean = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    hit = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    assert clean.count() + hit.count() == len(before)
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_word_tokens_are_learnt_by_parts_and_equal_the_tokenizers():
    """Chunks of odd characters, and words that are encoded once whatever their case and what follows them."""
    rng = np.random.default_rng(8)
    kinds = ["abcXYZ'<|>ÀéßñİΣσς×÷µª12 \t\n.,#_-́ 日é", "".join(map(chr, range(32, 0x250))), "ab 1!\x85\xa0\x1c ǅﬁК"]
    texts = ["".join(rng.choice(list(kinds[i % 3]), 40)) for i in range(600)] + [None, "", "x" * 70 + "É" * 65, "<|startoftext|>a <|ENDOFTEXT|>"]
    words, encode = packing.WordTokens(PATH), packing.WordTokens(PATH)._encode
    got = words.encode(pa.array(texts, pa.string()))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [encode(t or "", add_special_tokens=False).ids for t in texts]
    words = packing.WordTokens(PATH)
    words.encode(pa.array(["Word word, WORD! wörd. WÖRD,", "word!!"]))
    assert set(words.number) == {"", "word", "wörd", ",", "!", ".", "!!"}


def test_new_words_are_hashed_together_like_one_by_one():
    from tidemark.llm import features

    slots, size = features.Slots(1 << 18), 1 << 18
    for words in ([[b"toxic", b"a"], [], [b"toxic", "grüßen".encode()]], [[b"a", b"longer-word", b"toxic"]], [[]], [[b"w%d" % i for i in range(3000)]]):
        numbers = slots.numbers(words)
        got = slots.slots[numbers].tolist()
        assert got == [[zlib.crc32(w) % size, *(zlib.crc32(w[:n], n) % size for n in features.PREFIXES)] for part in words for w in part]


def test_pipeline_packs_in_small_batches_and_leaves_the_session_as_it_was(spark, docs, monkeypatch):
    import corpus_pipeline

    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    packed = corpus_pipeline.packed
    monkeypatch.setattr(corpus_pipeline, "packed", lambda d: (seen.append(spark.conf.get(name)), packed(d))[1])
    rows = corpus_pipeline.pack(spark, docs, "")
    assert seen == [str(corpus_pipeline.BATCH_ROWS)] and spark.conf.get(name) == before
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, rows.collect())) == sorted(map(key, packed(docs).collect()))


def test_spans_that_stay_come_in_the_order_of_the_texts():
    data = np.frombuffer(np.random.default_rng(2).bytes(4000), np.uint8)
    at = np.arange(0, 3800, 20)
    rows = pa.Table.from_batches(list(repeats._settled(data, at, at // 1000, at % 1000, np.full(len(at), 120), (at * 7919) % 1013)))
    place = [d * 1000 + p for d, p in zip(rows["doc"].to_pylist(), rows["pos"].to_pylist())]
    assert place == at.tolist() and [bytes(data[a : a + 120]) for a in at] == rows["body"].to_pylist()
