"""The text operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from busline.llm import bpe, components, decontaminate, html_text, line_templates, ngram_join, order_minhash, quality, secret_scan, token_store, warc
from busline.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, a string, b int, id long, `h` string, words string"


def prose(rng, n=60):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))


def rows_of(texts, start=0):
    return [(start + i, t, "en", "s", len(t) if t is not None else None, "x", 1, 7, None, "w") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    body = [prose(rng) + ".\n" + prose(rng, 30) for _ in range(30)]
    near = body[0].split(" ")
    near[10] = "changed"
    bench = prose(rng, 25)
    hit = bench.split(" ")
    hit[7], hit[15] = "other", "words"
    return {
        "body": body,
        "all": [*body, body[0], " ".join(near), body[1] + "\n" + " ".join(hit), None, "", " \t\n ", "one", "One", "two words", "w " * 3000, body[2], body[2]],
        "bench": bench,
    }


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([*rows_of(texts["all"]), (None, texts["body"][3], None, None, None, None, None, None, None, None), *rows_of(texts["all"][:1])], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")


def test_bpe_rows(spark, docs, empty):
    out = bpe.bpe_columns(docs, vocabulary("word_bpe_49k.json")).collect()
    assert len(out) == docs.count() and bpe.bpe_columns(empty, vocabulary("word_bpe_49k.json"), with_ids=True).count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    assert sum(r["ids_sha256"] == nothing and r["n_tokens"] == 0 and r["decoded_sha256"] == nothing for r in out) == 3


def test_token_store_round_trip(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    store = token_store.write_store(docs, path)
    keys = spark.read.parquet(f"{store.folder}/written").select("key", "copy")
    extra = keys.sparkSession.createDataFrame([(10_000 + i, 0) for i in range(500)], "key long, copy long")
    got = token_store.read_documents(store, token_store.look_up(store, keys.unionByName(extra)), "crc long", token_store.crc_of_ids(2)).collect()
    want = defaultdict(list)
    for r in docs.collect():
        want[r["doc_id"]].append(lib.encode(r["text"] or "", add_special_tokens=False).ids + [0])
    assert len(got) == docs.count()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for k, ids in want.items():
        assert sorted(r["crc"] for r in got if r["key"] == k) == sorted(map(crc, ids))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["key"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    none = token_store.write_store(empty, path)
    assert token_store.look_up(none, keys).count() == 0 and none.shards.count() == 0


def test_quality_scores(spark, docs, empty, texts):
    rng = random.Random(2)
    many = [prose(rng) if i % 2 else " | ".join(prose(rng).split()) for i in range(120)]
    table = spark.createDataFrame([*rows_of(many), *rows_of([None, ""], 500)], DOCS)
    labels = spark.createDataFrame([*[(i, i % 2, 0) for i in range(120)], (3, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.classify(table, labels).collect()}
    assert len(out) == 122
    for i in range(120):
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and out[i]["predicted"] == i % 2 == int(out[i]["score"] >= 0.5)
    assert out[500]["score"] == out[501]["score"]
    assert {r["score"] for r in quality.classify(table, labels.filter("quality = 1")).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a b</p>"), (1, "u", "<p>a b</p>"), (None, None, None), (2, "u", "")], "page_id long, url string, html string")
    out = html_text.main_text(pages).collect()
    assert sorted((r["text"], r["n_chars"]) for r in out) == [("", 0), ("", 0), ("a b", 3), ("a b", 3)]
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_warc_round_trip(spark):
    rng = random.Random(4)
    long, long2 = prose(rng, 400), prose(rng, 300)
    data = [(i, "u", long) for i in range(40)] + [(100 + i, None, "short") for i in range(3)] + [(200, "u", long2), (200, "u", long2), (None, "u", long), (None, "u", None), (300, "u", "é" * 700)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    files = warc.write_archives(warc.with_revisits(pages))
    for size in (300, 1 << 20):
        out = warc.read_archives(spark, files, size).collect()
        want = []
        for i, _, h in data:
            raw = (h or "").encode()
            keep = max((p for p, _, x in data if x == h and p is not None), default=None)
            again = len(raw) >= 1000 and keep is not None and i != keep
            want.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", str(keep if again else None)))
        assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in out) == sorted(want)
    assert warc.read_archives(spark, warc.write_archives(warc.with_revisits(pages.limit(0)))).count() == 0


def test_secret_rows(spark, docs, empty):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(30)]
    table = docs.unionByName(spark.createDataFrame(rows_of([f'some text token = "{h}" and more words' for h in hexes], 1000), DOCS))
    model = secret_scan.train(table)
    out = {r["doc_id"]: r for r in secret_scan.span_digest(secret_scan.scan(table, model)).collect()}
    for i in range(30):
        a, b = 10, 10 + len('token = "') + 40
        base = f"assign:{a}:{b},hex:{b - 40}:{b}"
        assert (out[1000 + i]["n_assign"], out[1000 + i]["n_access"], out[1000 + i]["n_hex"]) == (1, 0, 1)
        assert out[1000 + i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and out[1000 + i]["spans"] == base
    assert out[33]["spans"] == "" and out[33]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secret_scan.train(empty) is None and secret_scan.scan(empty, None).count() == 0


def _likeness(a, b):
    d = order_minhash.DIGITS
    pairs = [(a[i : i + d], b[i : i + d]) for i in range(0, len(a), d)]
    used = [p for p in pairs if p != (order_minhash.EMPTY,) * 2]
    return sum(p[0] == p[1] for p in used) / len(used)


def test_order_minhash_rows(spark, docs, empty):
    out = order_minhash.edited_fingerprints(docs).collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(out) == len(rows)
    prints = {}
    got = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in out)
    want = []
    for i, (k, t) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        want.append((str(k), len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert got == sorted(want)
    for r in out:
        assert prints.setdefault((r["doc_id"], r["n_chars"]), r["fingerprint"]) == r["fingerprint"]
        assert r["near_edited"] == pytest.approx(_likeness(r["fingerprint"], r["edited_fingerprint"]))
    one = [r for r in out if r["doc_id"] == 0]
    assert len(one) == 2 and {r["near_next"] for r in one} >= {1.0}
    assert order_minhash.edited_fingerprints(empty).count() == 0
    single = order_minhash.edited_fingerprints(docs.filter("doc_id = 5")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0


def test_order_minhash_follows_order(spark):
    rng = random.Random(5)
    words = prose(rng, 400).split()
    block = [words[i : i + 40] for i in range(0, 400, 40)]
    mixed = [w for b in reversed(block) for w in b]
    edited = [w if i % 40 else "zzz" for i, w in enumerate(words)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words, mixed, edited))], "k long, text string")
    p = {r["k"]: r["fingerprint"] for r in order_minhash.fingerprints(table, ["k"]).collect()}
    assert _likeness(p[0], p[2]) > _likeness(p[0], p[1]) + 0.1


def plain_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    own = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = own[i], own[j]
                own = [min(a, b) if o in (a, b) else o for o in own]
    return [len(s) for s in sets], own


def test_ngram_join_equals_brute_force(spark, docs, empty):
    rng = random.Random(6)
    base = [prose(rng, 120).split() for _ in range(6)]
    texts = []
    for i in range(150):
        w = list(base[i % 6])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(["alpha", "beta", "gamma"])
        texts.append(" ".join(w[: rng.choice((120, 120, 118))]))
    texts += [None, "", "one", "ONE", "two words", "two  words", prose(rng, 3)]
    table = spark.createDataFrame(rows_of(texts), DOCS)
    sizes, own = plain_components(texts)
    for block in (ngram_join.BLOCK, 5):
        before, ngram_join.BLOCK = ngram_join.BLOCK, block
        out = {r["doc_id"]: r for r in ngram_join.linked(table).collect()}
        ngram_join.BLOCK = before
        assert [out[i]["n_shingles"] for i in range(len(texts))] == sizes
        assert [out[i]["component_id"] for i in range(len(texts))] == own
    assert len(set(own)) < 100
    again = ngram_join.linked(docs).collect()
    assert len(again) == docs.count() and {r["component_id"] for r in again if r["doc_id"] is None} == {3}
    assert ngram_join.linked(empty).count() == 0


def test_texts_of_records_without_candidates_are_not_shuffled(spark):
    texts = spark.range(4000).selectExpr("id as a", "id * 7 as b", "'text' as __text")
    wanted = texts.filter("a % 100 = 3").select("a", "b")
    sent = {r["a"] for r in ngram_join.likely(texts, wanted).collect()}
    assert {r["a"] for r in wanted.collect()} <= sent and len(sent) < 50
    assert ngram_join.likely(texts, wanted.filter("a < 0")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_line_templates(spark, docs, empty):
    rng = random.Random(7)
    # a notice whose number and name vary, in unrelated documents; a long passage; copies of one document
    passage = prose(rng, 55)
    texts = [f"{prose(rng, 150)}\nPage {i} of {i * 3} was printed for mister {prose(rng, 1)} by the office\n{passage}\n{prose(rng, 150)}" for i in range(20)]
    copy = "\n".join(prose(rng, 12) for _ in range(6))
    copies = [copy.replace(copy.split()[k], "edited", 1) for k in range(20)] + [copy] * 5
    table = spark.createDataFrame(rows_of([*texts, *copies, None, "", "a b\na b"]), DOCS)
    out = {r["doc_id"]: r for r in line_templates.drop_recurring(table).collect()}
    assert table.columns + ["n_lines", "n_dropped"] == line_templates.drop_recurring(table).columns
    for i, t in enumerate(texts):
        assert out[i]["text"].split("\n") == [t.split("\n")[0], t.split("\n")[3]] and out[i]["n_dropped"] == 2
    for i, t in enumerate(copies):
        assert out[20 + i]["text"] == t
    assert out[45]["text"] is None and out[46]["text"] == "" and out[47]["text"] == "a b\na b"
    assert line_templates.drop_recurring(docs).count() == docs.count()
    assert line_templates.drop_recurring(empty).count() == 0


def spark_hash(*values):
    """``xxhash64`` of strings, ints and, as (long,), longs."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(8, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(4, "little")
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_line_dedup(texts):
    """The rule of line dedup in plain Python: distinct clusters of texts for each template."""
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    first, found = {}, defaultdict(set)
    for t in root:
        w = re.split(r"[ \t\r\n\f\x0B]+", t.strip(" "))
        sketch = sorted(spark_hash(*w[i : i + 3]) for i in range(len(w) - 2))[:32]
        for j in range(6) if sketch else ():
            band = (j, *(min(spark_hash((x,), k) for x in sketch) for k in (2 * j, 2 * j + 1)))
            root[find(t)] = find(first.setdefault(band, t))

    def templates(line):
        one = re.sub(r"[ \t\r\f\x0B]+", " ", line).strip(" ")
        tokens = re.sub(r"[^ ]*(?:[0-9@]|://)[^ ]*", "<*>", one).split(" ")
        n = len(tokens)
        out = [(n, *tokens)] if n >= 3 else []
        for j in range(3) if n >= 8 else ():
            a, b = ((n - 2) * k // 3 + 2 for k in (j, j + 1))
            out.append((n, j, *tokens[:a], *tokens[b:]))
        return out

    for t in root:
        for line in t.split("\n"):
            for x in templates(line):
                found[x].add(find(t))
    bad = {x for x, kin in found.items() if len(kin) >= 8}
    return {t: "\n".join(x for x in t.split("\n") if bad.isdisjoint(templates(x))) for t in root}


def test_line_dedup_equals_plain_rule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r["text"] for r in docs.select("text").collect()]
    rng = random.Random(4)
    own = [f"{prose(rng, 40)}\nread the terms of {prose(rng, 1)} and of the others at page {i}\nall  rights\tare kept {i}" for i in range(12)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(own)], "doc_id long, text string"))
    want = plain_line_dedup([t for t in texts if t is not None] + own)
    got = line_templates.drop_recurring(table).collect()
    assert len(got) == len(texts) + len(own) and sum(r["n_dropped"] > 0 for r in got) > 12
    before = {r["doc_id"]: r["text"] for r in table.collect()}
    assert all(r["text"] == want.get(before[r["doc_id"]]) for r in got)


@pytest.mark.parametrize("n", [1_000, 10_000, 100_000])
def test_line_in_every_document(spark, n):
    # texts of 40 words out of 300, so that unrelated ones share any single word; a third of them are near copies of one
    word = lambda i, k: F.substring(F.translate(F.md5(F.pmod(F.xxhash64(k, i), F.lit(300)).cast("string")), "0123456789", "ghijklmnop"), 1, 8)
    base = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    own = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.when((F.col("id") % 3 == 0) & (i == F.pmod(F.xxhash64("id"), F.lit(40))), word(i, F.col("id"))).otherwise(word(i, base)))
    texts = F.concat(F.array_join(own, " "), F.lit("\nall rights are reserved by us"), F.when(F.col("id") % 3 == 0, "\nthis line is in the copies").otherwise(""))
    out = line_templates.drop_recurring(spark.range(n).select(F.col("id").alias("doc_id"), texts.alias("text")))
    assert [tuple(r) for r in out.groupBy(F.col("doc_id") % 3 == 0, "n_lines", "n_dropped").count().sort("n_lines").collect()] == [(False, 2, 1, n - -(-n // 3)), (True, 3, 1, -(-n // 3))]


def test_decontamination(spark, docs, empty, texts):
    bench = spark.createDataFrame([(1, texts["bench"]), (1, texts["bench"]), (2, None), (3, "tiny item"), (4, ""), (5, "w w w w w w")], "item_id long, text string")
    out = decontaminate.leaks(docs, bench).select("doc_id", "item_id", "matched", "item_words").collect()
    assert sorted(map(tuple, out)) == [(32, 1, 23, 25), (39, 5, 6, 6)]
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    words = [prose(rng, 1) + str(i) for i in range(400)]
    items = [[rng.choice(words) for _ in range(n)] for n in (*range(1, 20), 25, 40)]
    texts = []
    for item in items:
        for wrong in ([], [rng.randrange(len(item))], rng.sample(range(len(item)), min(2, len(item)))):
            own = ["x" if i in wrong else w for i, w in enumerate(item)]
            texts.append([rng.choice(words) for _ in range(rng.randint(0, 90))] + own + [rng.choice(words) for _ in range(rng.randint(0, 90))])
    want = set()
    for d, text in enumerate(texts):
        for k, item in enumerate(items):
            n, best = len(item), 0
            for shift in range(1 - n, len(text)):
                same = [0 <= i + shift < len(text) and text[i + shift] == w for i, w in enumerate(item)]
                if n <= 16:
                    best = max(best, sum(same))
                else:  # longest gain of a stretch, 1 for a match and -2 for another word
                    value, total, matches, run = 0, 0, 0, 0
                    for ok in same:
                        total, run = (total + 1, run + 1) if ok else (total - 2, run)
                        if total < 0:
                            total, run = 0, 0
                        if total > value:
                            value, matches = total, run
                    best = max(best, matches)
            if n >= 3 and best >= (n if n <= 5 else min(13, max(5, 0.8 * n))):
                want.add((d, k, best))
    assert len(want) > 40
    docs = spark.createDataFrame(rows_of([" ".join(t) for t in texts]), DOCS)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["matched"]) for r in decontaminate.leaks(docs, bench).collect()} == want


def test_near_duplicates_with_repeated_and_null_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    alone, near = [prose(rng) for _ in range(6)], prose(rng).split()
    copies = [" ".join([*near[:k], "changed", *near[k + 1 :]]) for k in (0, 59)] + [" ".join(near)] * 2
    data = [(7, t, *r[2:]) for t, r in zip(alone[:5], rows_of(alone))] + [(None, t, *r[2:]) for t, r in zip([alone[5], *copies], rows_of(copies * 2))]
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(data, DOCS), str(tmp_path)).collect()]
    assert sorted(t for k, t in kept if k == 7) == sorted(alone[:5])
    rest = [t for k, t in kept if k is None]
    assert len(rest) == 2 and alone[5] in rest


def test_quality_learns_from_all_labels(spark, monkeypatch):
    """Small buckets and a sample of two do not limit the fit: it nears that on all pairs, and cuts at the bad share of all rows."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0.7, 1, (300, 3)), rng.normal(-0.7, 1, (100, 3))])
    order = rng.permutation(400).tolist()
    data = [(k, int(rng.integers(1 << 40)), x[k].tolist(), k) for k in order]
    table = spark.createDataFrame(data, "doc_id long, __hash long, __x array<double>, k int")
    labels = spark.createDataFrame([(k, int(k < 300)) for k in range(400)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "SAMPLE", 2)
    monkeypatch.setattr(quality, "held_out", lambda key="doc_id": F.lit(False))
    m = quality.train_all(table, labels)
    whole = quality.fit_pairs(x[:300], x[300:], 0.25, pairs=200_000)
    assert np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.scale, x.std(axis=0))
    assert np.corrcoef(m.scores(x), whole.scores(x))[0, 1] > 0.99
    assert (m.scores(x) < 0.5).sum() == 100
    monkeypatch.setattr(quality, "train", lambda *a, **k: pytest.fail("the bounded fit is used"))
    docs = spark.createDataFrame(rows_of([prose(random.Random(i), 30) for i in range(6)]), DOCS)
    assert quality.classify(docs, labels).count() == 6


def test_training_samples_take_copies_once(spark, monkeypatch):
    rng = random.Random(9)
    texts = [prose(rng, 40 + i) for i in range(20)] * 30
    table = spark.createDataFrame(rows_of(texts), DOCS)
    labels = spark.createDataFrame([(i, i % 20 % 2, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "SAMPLE", 6)
    monkeypatch.setattr(quality, "fit_pairs", lambda good, bad, bad_share: (good, bad))
    for x in quality.train(quality.with_features(table, keep=["doc_id"]), labels):
        assert len(x) == len({tuple(r) for r in x.tolist()}) == 6
    secrets = spark.createDataFrame(rows_of([f'token = "{hashlib.sha1(str(i % 20).encode()).hexdigest()}"\n{texts[i]}' for i in range(600)]), DOCS)
    monkeypatch.setattr(secret_scan, "SAMPLE_LINES", 6)
    monkeypatch.setattr(secret_scan, "fit", lambda rows: rows)
    assert len({tuple(r["words"]) for r in secret_scan.train(secrets) if r["hit"]}) == 6


def test_pipeline_stages(spark, docs, texts, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, texts["bench"])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # without labels nothing is rejected; no line recurs in eight unrelated documents
    sizes, own = plain_components([r["text"] for r in sorted(docs.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).collect(), key=lambda r: r["doc_id"])])
    want = [i for i in range(len(own)) if own[i] == i and i != 32 or not sizes[i]]
    assert sorted(r["doc_id"] for r in out) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in out)
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
