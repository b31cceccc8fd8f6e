"""Parts of the text operators that need no Spark session, against brute force."""

from __future__ import annotations

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from busline.llm import decontaminate, html_text, ngram_join, quality, secret_scan, token_store, warc
from busline.llm.bpe import PairTable, WordBpe
from busline.llm.hashing import BLANKS, sequences, word_hashes
from busline.llm.queries import vocabulary

ODD = [
    "", "   ", "a<|endoftext|>B <|startoftext|> c", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "été İstanbul", "x\x1cy\x1dz\x85w\xa0v　u", "don't I'LL we'Re it's", "𝒜𝔅 日本語 한국어 12½ ²",
    "a" * 3000, "\x00\x01a", "<|endoftext|", "aaaa'sss 'tt ''' !!!???", "́ͅ ̀x é", "Ab\ncd\r\n\tEF ",
]


def merge_loop(symbols, rank):
    """The plain definition of BPE."""
    s = list(symbols)
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(s, s[1:])) if p in rank), default=None)
        if best is None:
            return s
        s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]


def test_pair_table_equals_merge_loop():
    rng = random.Random(3)
    for _ in range(30):
        names, merges = ["a", "b", "c"], []
        while len(merges) < 25:
            a, b = rng.choice(names), rng.choice(names)
            if a + b not in names and len(a + b) < 9:
                names.append(a + b)
                merges.append((a, b))
        table, rank = PairTable(["a", "b", "c"], merges), {m: i for i, m in enumerate(merges)}
        made = [merge_loop(n, rank) == [n] for n in table.names]
        assert table.reachable() == made
        usable = [n for n, ok in zip(table.names, made) if ok]
        for x, y in itertools.product(usable, usable):
            assert table.fits(table.names.index(x), table.names.index(y)) == (merge_loop(x + y, rank) == [x, y])


def test_bpe_equals_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary("word_bpe_49k.json")
    own, lib = WordBpe(path, cache=50), tokenizers.Tokenizer.from_file(path)
    for text in ODD:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert own.encode(None) == []


def test_word_ids_are_kept_across_punctuation_and_turnover():
    """A word in ever new mixtures of case and punctuation is encoded once, also after more other words than one generation holds."""
    own = WordBpe(vocabulary("word_bpe_49k.json"), cache=40)
    asked, real = [], own.encode_symbols
    own.encode_symbols = lambda s: (asked.append(s), real(s))[1]
    for i in range(100):
        own.encode(f"erheiten{'!' * (i % 30)} Erheiten{'?' * (i % 30)} {'xyzq'[i % 4] * (2 + i // 4)}")
    assert sum(s.startswith("erheite") for s in asked) == 1


def test_unit_encoder_equals_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary("byte_bpe_50k.json")
    own, lib = token_store.UnitEncoder(path, 2, cache=20), tokenizers.Tokenizer.from_file(path)
    texts = [*ODD, "  two  blanks \n\n and lines\n x", " leading", "trailing "]
    for _ in range(2):
        assert own.encode(texts) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


def test_unit_encoder_splits_signs_and_keeps_white_space():
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary("byte_bpe_50k.json")
    own, lib = token_store.UnitEncoder(path, 2), tokenizers.Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    ask = own._units
    asked = []
    own._units = lambda units: asked.extend(units) or ask(units)
    rng = random.Random(12)
    pieces = ["word", "word,", "w\u00f6rd!&&", "don't.", "it's", "x'", "\u4e2d\u6587.", "\u0250.", "a1,", "12.", "_", "...", "(a)", "a" * 50 + ".", "'", "\u00e9\u0301;", "\u02b0.", "\u00aa!", "\u00b5?"]
    gaps = [" ", " ", " ", "\n", "\n\n", "  ", "\n ", " \n", "\n\n\n", "\t", "\u00a0", "\r\n", "\u2003", ""]
    texts = ["".join(rng.choice(pieces) + rng.choice(gaps[: rng.choice((3, 5, 14))]) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    texts += ["", " ", "\n", "\n\n", "\n\n\n", " a", "\na", "a ", "a\n", "a\n\n", " \n", "\n ", "  ", "a\n\nb", "\n\na", "a  "]
    texts += [w + t for t in texts[:300] for w in (" ", "\n")]
    for at in range(0, len(texts), 100):
        got = own.encode(texts[at : at + 100])
        assert [np.frombuffer(b, "<u2").tolist() for b in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts[at : at + 100]]
    assert "word" in asked and "word," not in asked and "w\u00f6rd!&&" not in asked and not any(len(u) > 40 for u in own.known)


def test_unit_encoder_asks_in_rows():
    """Words without a blank before them go to the library in rows too, and no other text of the row gets into their ids."""
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary("byte_bpe_50k.json")
    own, lib = token_store.UnitEncoder(path, 2), tokenizers.Tokenizer.from_file(path)
    asked = []

    class Counted:
        def encode_batch_fast(self, texts, **k):
            asked.extend(texts)
            return lib.encode_batch_fast(texts, **k)

    own.lib = Counted()
    texts = ["\n".join(f"w{i}'s, {i} \u00e9{i}" for i in range(k, k + 50)) for k in range(0, 500, 50)]
    assert own.encode(texts) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert len(asked) < 20  # 1,500 units, 500 of them without a blank


def test_minimal_perfect_hash():
    for n in (0, 1, 2, 500, 5000):
        h = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        sizes, bits, slot = token_store.build_mph(h)
        assert sorted(slot.tolist()) == list(range(len(h)))
        ranks = np.cumsum(bits) - bits
        assert np.array_equal(token_store.find_slots(h, sizes, bits, ranks), slot)


def test_warc_ranges_own_each_record_once():
    records = [warc.record_bytes(i, f"http://x/{i}", b"\x1f\x8b\x08<p>%d" % i * (i % 50), 0, "d", None if i % 4 else 3) for i in range(200)]
    raw = b"".join(records)

    class Source:
        def read_at(self, n, at):
            return raw[at : at + n]

    for step in (37, 500, 4096, len(raw)):
        cuts = [(a, min(a + step, len(raw))) for a in range(0, len(raw), step)]
        got = [warc.record_row(r)["page_id"] for a, b in cuts for r in warc.scan_range(Source(), a, b, len(raw))]
        assert got == list(range(200))
    broken = raw[: len(records[0])] + b"\x1f\x8b\x08junk" + raw[len(records[0]) :]
    raw = broken
    assert len(list(warc.scan_range(Source(), 0, len(raw), len(raw)))) == 200


def test_warc_header_values():
    row = warc.record_row(zlib.decompress(warc.record_bytes(None, "a\r\nb", b"", 0, "x", None), 31))
    assert row["page_id"] is None and row["payload_bytes"] == 0 and row["url"] == "a b"
    row = warc.record_row(zlib.decompress(warc.record_bytes(5, None, None, 77, "abc", 9), 31))
    assert (row["record_type"], row["payload_bytes"], row["payload_digest"], row["refers_to"]) == ("revisit", 77, "abc", 9)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><div class="nav-menu"><ul><li><a href=/a>Home</a></li></ul></div>
<div id="cookie-notice">We use cookies, ok?</div><div class="post"><h1>A title</h1><p>First text, with   commas; and more &amp; more.
<p>Second <b>bold</b> text<br>goes on, here.</p><ul><li>One thing</ul><div class="ad">Buy!</div></div>
<div class="comments"><p>I like this, really.</p></div><form><p>Name, please</p></form><footer>&copy; all rights.</footer><script>var x="</p>";</script>"""


def test_html_main_text():
    assert html_text.extract(PAGE) == "A title\nFirst text, with commas; and more & more.\nSecond bold text goes on, here.\nOne thing"
    article = PAGE.replace('<div class="post">', "<article>").replace('<div class="ad">Buy!</div></div>', "</article>")
    assert html_text.extract(article) == html_text.extract(PAGE)


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<script>x", ""), ("<div><p>a &#233; b", "a é b"), ("<", "<"), ("<!-- x", "")])
def test_html_broken_pages(page, text):
    assert html_text.extract(page) == text


PROSE = "<p>Running text, which is long enough; it tells of things. And more of it, too.</p>" * 3
LINE = "Running text, which is long enough; it tells of things. And more of it, too."


@pytest.mark.parametrize(
    ("body", "more"),
    [
        ("<div class='layout has-sidebar'>%s</div>", []),
        ("<div class='content with-sidebar'>%s</div>", []),
        ("<div class='single-post nav-open'>%s</div>", []),
        ("<article>%s<p class='side-effects'>Pain, and more; it passes.</p></article>", ["Pain, and more; it passes."]),
        ("<article>%s<section id='related-work'><p>Others did so, too; see them.</p></section></article>", ["Others did so, too; see them."]),
        ("<div class='page-header-wrap'><main>%s</main></div><div class='comments'><p>Nice, I see.</p></div>", []),
        ("<div>%s<div class='related'><a href=/a>Another, and more.</a></div><div class='cookie-notice'><p>We set cookies, fine?</p></div></div>", []),
    ],
)
def test_html_names_do_not_empty_pages(body, more):
    page = f"<body><nav><a href=/>Home</a></nav>{body % PROSE}<footer>f</footer></body>"
    assert html_text.extract(page).split("\n") == [LINE] * 3 + more


def test_content_paths_equal_plain_ratios():
    rng = random.Random(5)
    for _ in range(50):
        paths = [rng.randint(1, 5) for _ in range(rng.randint(1, 30))]
        texts = ["".join(rng.choice("abc ,.") for _ in range(rng.randint(1, 60))) for _ in paths]
        of = lambda p: [t for q, t in zip(paths, texts) if q == p]  # noqa: B023, E731
        size = [sum(map(len, of(p))) / len(of(p)) for p in paths]
        mark = [sum(len(re.findall(r"[.,]", t)) for t in of(p)) / len(of(p)) for p in paths]
        near = lambda v, i: v[max(i - 1, 0)] / 4 + v[i] / 2 + v[min(i + 1, len(v) - 1)] / 4
        fused = {p: sum(near(size, i) * (0.5 + near(mark, i)) for i, q in enumerate(paths) if q == p) / paths.count(p) for p in set(paths)}
        limit = 0.1 * max(fused.values())
        assert {p for p, v in fused.items() if v >= limit * (1 + 1e-9)} <= html_text.content_paths(paths, texts) <= {p for p, v in fused.items() if v >= limit * (1 - 1e-9)}


def test_html_deep_and_long():
    assert html_text.extract("<div>" * 50_000 + "deep text, here." + "</div>" * 50_000) == "deep text, here."


def test_word_hashes_follow_definition():
    texts = ["The  cat\tSAT on\nthe mat", "", " ", "É é x", "long " * 400_000, "the cat sat on the mat"]
    got = word_hashes(texts, BLANKS)
    names = {}
    for t, h in zip(texts, got):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) if w]
        assert len(words) == len(h)
        for w, v in zip(words, h.tolist()):
            assert names.setdefault(w, v) == v
    assert len(set(names.values())) == len(names)
    assert np.array_equal(got[0], got[5])
    assert len(sequences(got[0], 3)) == 4 and len(sequences(got[0][:2], 3)) == 1 and len(sequences(got[1], 3)) == 0


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(5)
    for _ in range(40):
        query = np.unique(rng.integers(0, 60, 40, dtype=np.uint64))
        sets = [np.unique(rng.integers(0, 70, rng.integers(1, 60), dtype=np.uint64)) for _ in range(30)]
        need = [int(n) for n in rng.integers(1, 30, 30)]
        assert ngram_join.divide_skip(query, sets, need) == [len(np.intersect1d(query, s)) >= n for s, n in zip(sets, need)]


def test_block_tests_lose_no_pair():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64) * np.uint64(2)
    sets = []
    for _ in range(60):
        s = base[: rng.integers(90, 120)].copy()
        s[rng.integers(0, len(s), 5)] = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
        sets.append(np.unique(s))
    parity = [ngram_join.parity_bits(s).tobytes() for s in sets]
    args = np.arange(60), np.array([len(s) for s in sets], np.int32), parity
    found = {(int(a), int(b)) for x, y, _ in ngram_join._run_pairs(*args, np.zeros(60, bool), np.arange(60)) for a, b in zip(x, y)}
    for i, j in itertools.combinations(range(60), 2):
        common = len(np.intersect1d(sets[i], sets[j]))
        link = 100 * common >= 90 * (len(sets[i]) + len(sets[j]) - common)
        assert link == (common >= ngram_join.least_overlap(len(sets[i]), len(sets[j])))
        assert not link or (i, j) in found


def test_rows_without_a_partner_are_left_out_and_no_link_is_lost():
    rng = np.random.default_rng(11)
    base = np.unique(rng.integers(0, 1 << 63, 150, dtype=np.uint64))
    sets = []
    for _ in range(80):  # near copies, other texts that share a few tokens, and sizes that fit none
        s = base[: rng.integers(100, 150)].copy() if rng.random() < 0.5 else np.append(base[rng.integers(0, 150, 3)], rng.integers(0, 1 << 63, rng.integers(3, 400), dtype=np.uint64))
        s[rng.integers(0, len(s), 5)] = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
        sets.append(np.unique(s))
    rows = sorted((int(t), len(s), pos, i) for i, s in enumerate(sets) for pos, t in enumerate(s[: len(s) - -(-9 * len(s) // 10) + 1]))
    token, n, pos, owner = np.array(rows, dtype=object).T
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    heads = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
    kept = ngram_join._partners(heads, n, pos)
    meet = set()
    for a, b in zip(heads[:-1], heads[1:]):
        for i, j in itertools.combinations(range(a, b), 2):
            if kept[i] and kept[j] and ngram_join.may_link(n[i], pos[i], n[j], pos[j]):
                meet.add(frozenset((owner[i], owner[j])))
    for i, j in itertools.combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[i], sets[j]))
        if 100 * common >= 90 * (len(sets[i]) + len(sets[j]) - common):
            assert frozenset((i, j)) in meet
    several = np.repeat(np.diff(heads) > 1, np.diff(heads))
    assert not kept[~several].any() and 0 < kept.sum() < 0.9 * several.sum()
    far = ngram_join._partners(np.array([0, 3, 5]), np.array([10, 100, 105, 95, 95]), np.array([0, 0, 9, 3, 7]))
    assert far.tolist() == [False, False, False, False, False]


def test_parities_bound_the_difference():
    rng = np.random.default_rng(10)
    for n in (0, 5, 1024, 1025, 40_000):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        t = np.unique(np.concatenate([s[: n - n // 20], rng.integers(0, 1 << 63, n // 25, dtype=np.uint64)]))
        a, b = ngram_join.parity_bits(s), ngram_join.parity_bits(t)
        small = min(len(a), len(b))
        apart = np.bitwise_count(ngram_join.fold(a, small) ^ ngram_join.fold(b, small)).sum()
        assert apart <= len(np.setxor1d(s, t)) and len(a) * 8 >= len(s) / 4


def test_best_stretch_equals_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(200):
        words, item = rng.integers(0, 3, 30, dtype=np.uint64), rng.integers(0, 3, 12, dtype=np.uint64)
        shift = int(rng.integers(-8, 28))
        n, first, end = decontaminate.best_stretch(words, item, shift)
        value = lambda a, b: sum(1 if words[k + shift] == item[k] else -2 for k in range(a, b))  # noqa: B023, E731
        lo, hi = max(0, -shift), min(12, 30 - shift)
        assert value(first, end) == max((value(a, b) for a in range(lo, hi) for b in range(a, hi + 1)), default=0)
        assert n == sum(words[k + shift] == item[k] for k in range(first, end))


def test_short_items_keep_a_seed():
    for n in range(5, decontaminate.SHORT + 1):
        least = decontaminate.least_matches(n)
        shapes = [decontaminate.ALL_MASKS[m] for m in decontaminate.masks_for(n)]
        windows = [{i + j for j, c in enumerate(s) if c == "1"} for s in shapes for i in range(n - len(s) + 1)]
        for wrong in range(n + 1):
            if n - wrong >= least:
                for places in itertools.combinations(range(n), wrong):
                    assert any(w.isdisjoint(places) for w in windows), (n, places)


def test_base_spans_follow_patterns():
    text = 'API_KEY = "abcDEF12" token:short token: x password=aaaaaa AKIA' + "Z" * 16 + " AKIAX " + "0a" * 12 + " ſecret=longenough Kelvin apiKey=longenough"
    got = [(secret_scan.KINDS[k], text[a:b]) for a, b, k in secret_scan.base_spans(text)]
    assert got == [("assign", 'API_KEY = "abcDEF12'), ("assign", "password=aaaaaa"), ("access", "AKIA" + "Z" * 16), ("hex", "0a" * 12)]


def test_crf_finds_values_without_keys_and_leaves_prose():
    rng = random.Random(1)
    value = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    word = lambda: "".join(rng.choice("abcdeorst") for _ in range(rng.randint(2, 9)))
    prose = lambda: " ".join(word() for _ in range(12))
    lines = [x for _ in range(60) for x in secret_scan.training_lines(f'{prose()} token = "{value()}" {prose()}\n{prose()}', 1)]
    model = secret_scan.fit(lines)
    tagger = secret_scan.Tagger(model)
    texts = [f'{prose()} "{value().upper()}"!! {prose()}', prose(), ""]
    tags = tagger.tags([t.split() for t in texts], [secret_scan.file_features(t) for t in texts])
    spans = [secret_scan.crf_spans(t, [t], [y], []) for t, y in zip(texts, tags)]
    assert len(spans[0]) == 1 and len(texts[0][spans[0][0][0] : spans[0][0][1]]) == 40 and spans[1] == spans[2] == []
    assert secret_scan.fit([x for x in lines if not x["hit"]]) is None


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(8)
    model = secret_scan.Model(np.zeros((secret_scan.BINS + 1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    tagger, lengths = secret_scan.Tagger(model), np.array([3, 0, 5, 1])
    e = rng.normal(size=(3, 9))
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for tags, at, n in zip(tagger._viterbi(e.copy(), starts, lengths), starts, lengths):
        paths = itertools.product(range(3), repeat=int(n))
        value = lambda p: sum(e[t, at + k] for k, t in enumerate(p)) + (model.first[p[0]] if p else 0) + sum(model.steps[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert tuple(tags.tolist()) == max(paths, key=value)


def test_pairwise_ranking_orders_and_cuts():
    rng = np.random.default_rng(9)
    good, bad = rng.normal(1.5, 1, (400, 3)), rng.normal(-1.5, 1, (100, 3))
    m = quality.fit_pairs(good, bad, 0.2, pairs=5000)
    s = m.scores(np.concatenate([good, bad]))
    assert abs((s < 0.5).mean() - 0.2) < 0.01
    assert (s[:400][:, None] > s[400:]).mean() > 0.98
    assert len(quality.features(None)) == len(quality.features("a b c\nd"))


def test_equal_hashes_of_keys_raise():
    with pytest.raises(ValueError, match="same 64-bit hash"):
        token_store.build_mph(np.array([7, 7, 9], np.uint64))
