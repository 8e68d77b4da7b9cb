"""The corpus operations against brute force, round trips and held-out accuracy, and on awkward rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from emberline.llm import decontam, fingerprints, html_text, langid, mixing, passages, quality, simhash, suffix_dedup, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, block int"
SYLLABLES = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""), "x", "y", 7)


@pytest.fixture(scope="module")
def rows():
    a, b = prose(1, 120), prose(2, 300)
    passage = prose(3, 70)
    return [
        doc(5, a), doc(9, a), doc(9, a), doc(12, None, None, None), doc(13, ""), doc(14, "   \n\t"), doc(15, "One"), doc(None, b),
        doc(20, b + " " + passage + " end"), doc(21, prose(4, 100) + " " + passage + " " + prose(5, 50)), doc(22, a.replace("ba", "Ba", 1) + " more"),
        doc(30, "ab" * 400), doc(31, "Ünïcödé ñandú " * 30), doc(32, " ".join(["same"] * 200)), doc(33, " ".join(["same"] * 200)), doc(40, prose(6, 5000)),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_repeats(rows, span=50):
    seen, out = set(), {}
    for i, text in sorted({(-(1 << 63) if r[0] is None else r[0], r[1] or "") for r in rows}):
        data = text.encode()
        own = [data[k : k + span] for k in range(len(data) - span + 1)]
        gone = bytearray(len(data))
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + span] = b"\1" * span
        seen.update(own)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot,block_bytes", [(4096, 8 << 20), (1, 2000)])
def test_suffix_dedup(docs, rows, hot, block_bytes):
    got = suffix_dedup.without_repeats(docs, hot=hot, block_bytes=block_bytes).collect()
    want = brute_repeats(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[-(1 << 63) if r.id is None else r.id]
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_longest_previous():
    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 60):
        doc_of, lcp, order = rng.integers(0, 6, n), rng.integers(0, 5, n), rng.permutation(n)
        got = suffix_dedup.longest_previous(order, lcp, doc_of)
        for i in range(n):
            best = 0
            for j in range(n):
                if doc_of[order[j]] < doc_of[order[i]]:
                    lo, hi = min(i, j), max(i, j)
                    best = max(best, int(lcp[lo + 1 : hi + 1].min()))
            assert got[order[i]] == best


def test_passages(docs, rows):
    got = passages.repeated_passages(docs, block_bytes=3000).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert any(r.n_words >= 70 and r.earlier_id == 20 for r in by[21])
    assert max(r.n_words for r in by[9]) == 120 and {r.earlier_id for r in by[9]} == {5}
    assert 5 not in by and 40 not in by and 12 not in by and None not in by
    assert max(r.n_words for r in by[33]) == 200
    cut = passages.without_passages(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    texts = {r.doc_id: r for r in cut.collect()}
    assert texts[9].text == "" and texts[12].text is None and texts[5].text == rows[0][1]
    assert texts[21].n_chars == len(texts[21].text) and prose(3, 70) not in texts[21].text and texts[21].text.startswith(prose(4, 100))


def test_fuzzy_passage_and_chains(spark):
    base = prose(10, 90).split()
    changed = list(base)
    for i in (20, 45, 70):
        changed[i] = "zzz"
    changed.insert(60, "yyy")
    rows = [doc(1, prose(11, 60) + " " + " ".join(base)), doc(2, prose(12, 60) + " " + " ".join(changed) + " " + prose(13, 30))]
    got = passages.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 1 and got[0].id == 2 and got[0].start == 60 and got[0].n_words == 91 and got[0].edits == 4
    # the best chain steps over matches that are out of order
    best = max(passages.chains(np.array([0, 5, 10, 15, 20]), np.array([0, 5, 300, 15, 20])), key=len)
    assert best.tolist() == [0, 1, 3, 4]
    assert passages.edits(list("kitten"), list("sitting")) == 3


def test_url_trie(spark):
    from emberline.llm.queries import URL_RULES

    urls = [None, "", "no scheme", "http://example.org", "HTTPS://WWW.Example.ORG/es/1?q", "http://a.example.org/en/196#x", "http://b.com/de/", "http://b.com/fr/a/b", "http://notorg/", "http://x.org?/es/", "http://fr.com/DE/", "ftp://.org/x"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id int, url string, rule string")

    def slow(u):
        host, path = url_filter.split_url(u)
        fits = [(h.count(".") + 1, len(p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (max(fits)[2], max(fits)[3]) if fits else (None, "allow")

    for per_trie in (50_000, 2):
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_verdicts(pages, URL_RULES, per_trie=per_trie).collect()}
        assert got == {i: slow(u) for i, u in enumerate(urls)}
    assert url_filter.url_verdicts(pages.limit(0), URL_RULES).count() == 0


PAGE = """<html><head><title>t</title><script>var a="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav>Menu</nav>
<article><header><h1>Head &amp; tail</h1><p>by me</p></header><p>One <b>two</b>
 three<br>four<p>five&nbsp;six<div class="share">Share</div><ul><li>x<li>y</ul></article><section id="comments"><article class="comment"><p>me too</p></article></section><footer>f</footer>"""


def test_html(spark):
    shell = "<html><body><div><p>Welcome to the site</p></div><div><p>{}</p></div><div><p>All rights {}</p></div></body></html>"
    rows = [(1, "http://a.org/1", PAGE), (2, None, None), (3, "http://a.org/2", ""), (4, "x", "plain &lt;text&gt; <unclosed")]
    rows += [(10 + i, "http://t.org/%d" % i, shell.format("Story number %d is here" % i, "reserved")) for i in range(8)]
    rows += [(30 + i, "http://c.org/%d" % i, shell.format("Same story", "reserved")) for i in range(8)]
    got = {r.id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[1].text == "Head & tail\nOne two three four\nfive six\nx\ny"
    assert got[2].text == got[3].text == "" and got[4].text == "plain <text>"
    assert got[12].text == "Story number 2 is here" and got[12].n_chars == len(got[12].text)
    assert "Same story" in got[33].text  # copies of one page are no template


def test_quality_learns_grades(spark):
    rng = random.Random(1)
    rows, grades = [], []
    for i in range(900):
        grade = i % 3
        text = prose(i, rng.randint(5, 150)).split()
        if grade < 2:
            text.insert(rng.randrange(len(text)), rng.choice(["nasty", "vile", "awful"]))
        if grade < 1:
            text = [w + "!!" for w in text]
        rows.append(doc(i, " ".join(text)))
        grades.append((i, grade))
    frame, rated = spark.createDataFrame(rows, DOCS), spark.createDataFrame(grades, "id long, grade int")
    model = quality.train(frame, rated.where("id % 10 <> 7"), 3)
    assert model.thresholds[0] < model.thresholds[1]
    got = {r.id: r for r in quality.rate(frame, model).collect()}
    held = [i for i in range(900) if i % 10 == 7]
    assert np.mean([got[i].keep == (i % 3 == 2) for i in held]) > 0.95
    means = [np.mean([got[i].expected_grade for i in held if i % 3 == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    assert quality.keep_good(frame, model).columns == frame.columns


def test_quality_awkward(docs, none, spark, rows):
    empty = quality.train(none, spark.createDataFrame([], "id long, grade int"), 3)
    got = quality.rate(docs, empty).collect()
    assert len(got) == len(rows) and all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    assert not any(r.keep for r in got if r.id in (12, 13, 14)) and all(r.keep for r in got if r.id in (5, 40))
    assert quality.rate(none, empty).count() == 0


def test_simhash_groups(docs, rows, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and simhash.near_duplicates(none).count() == 0
    fps = [(r.id, r.fp & (1 << 64) - 1) for r in got]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 2:
                parent[root(i)] = root(j)
    for i, r in enumerate(got):
        assert r.component_id == min((fps[j][0] for j in range(len(fps)) if root(j) == root(i) and fps[j][0] is not None), default=None)
    zero = {r.id for r in got if r.fp == 0}
    assert {12, 13, 14} <= zero


def test_bit_slices():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    f = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for b in base]))
    p = simhash.planes(f)
    for radius in (0, 1, 2, 3, 7, 18):
        for q in f[:20]:
            lanes = np.unpackbits(simhash.within(p, int(q), radius).view(np.uint8), bitorder="little")[: len(f)].astype(bool)
            assert (lanes == (np.bitwise_count(f ^ q) <= radius)).all()


def test_similar_pairs(spark):
    rows, want = [], set()
    for g in range(12):
        base = prose(100 + g, 200).split()
        rows.append(doc(10 * g, " ".join(base)))
        near = list(base)
        near[60] = "zz"
        rows.append(doc(10 * g + 1, " ".join(near)))  # similarity 0.95
        want.add(10 * g + 1)
        far = list(base)
        for i in range(0, 200, 12):
            far[i] = "qq"
        rows.append(doc(10 * g + 2, " ".join(far)))  # far below 0.8
    rows += [doc(1000, None), doc(1001, ""), doc(None, "a b")]
    frame = spark.createDataFrame(rows, DOCS)
    pairs = simhash.similar_pairs(frame, block_bytes=4000).collect()
    assert {r.id for r in pairs} == want | {1001} and all(r.earlier < r.id for r in pairs)
    assert simhash.first_of_similar(frame).count() == len(rows) - len(want) - 1


def test_fingerprints(docs, rows, none, spark):
    got = fingerprints.edited_versions(docs.where("doc_id <> 9")).collect()
    order = sorted([(r[0], r[1] or "") for r in rows if r[0] not in (None, 9)], reverse=True)
    by = {r.id: r for r in got}
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert by[i].n_chars == len(text) and by[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (set(_keys(t)) for t in (text, edited, after))
        assert by[i].near_edited == pytest.approx(1 - len(a ^ b) / max(len(a) + len(b), 1))
        assert by[i].near_next == pytest.approx(1 - len(a ^ c) / max(len(a) + len(c), 1))
    assert by[32].fingerprint == by[33].fingerprint != by[40].fingerprint
    assert fingerprints.edited_versions(none).count() == 0
    one = fingerprints.edited_versions(docs.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.edited_versions(docs).count() == len(rows)


def _keys(text):
    return fingerprints.digests(pa.array([text.encode()], pa.large_binary()))[0].tolist()


def test_decontamination(docs, spark, rows, none):
    whole = [(1, " ".join(rows[0][1].split()[10:40]).upper()), (2, prose(77, 30)), (3, None), (4, ""), (5, "one"), (6, " ".join(rows[8][1].split()[5:30]) + " x y z")]
    items = spark.createDataFrame(whole, "item_id long, text string")

    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {("short", *w)} if w else set()

    want = sorted((str(r[0]), i) for r in rows for i, t in whole if shingles(t) and len(shingles(t) & shingles(r[1])) >= 0.8 * len(shingles(t)))
    for block in (1_000_000, 20):
        got = decontam.contained_items(docs, items, block_values=block)
        assert sorted((str(r.id), r.item_id) for r in got.collect()) == want
    clean = decontam.without_contaminated(docs, items)
    dirty = {i for i, _ in want}
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in rows if str(r[0]) not in dirty)
    assert decontam.contained_items(none, items).count() == 0 and decontam.contained_items(docs, items.limit(0)).count() == 0


def test_mixing(docs, rows, none):
    got = mixing.plan_mix(docs).collect()
    assert len(got) == len(rows) and mixing.plan_mix(none).count() == 0
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and sum(c.words for c in r.copies) == r.taken
        assert all(0 <= c.position <= 1 for c in r.copies)
    assert sum(r.taken for r in got) == pytest.approx(sum({r.source_size: r.target for r in got}.values()), abs=2)
    order = mixing.training_order(docs.where("doc_id <> 9"), mixing.plan_mix(docs.where("doc_id <> 9"))).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)


def test_schedule_inverse(spark):
    from pyspark.sql import functions as F

    for knots in [*mixing.RAMPS, ((0.0, 0.0), (0.4, 2.0), (1.0, 0.0))]:
        times = np.linspace(0, 1, 2001)
        w = np.interp(times, [t for t, _ in knots], [v for _, v in knots])
        due = np.append(0, np.cumsum((w[1:] + w[:-1]) / 2))
        due /= due[-1]
        got = spark.range(21).select((F.col("id") / 20).alias("u")).select("u", mixing.position(F.col("u"), F.lit(0), [knots]).alias("t")).collect()
        for r in got:
            assert np.interp(r.t, times, due) == pytest.approx(r.u, abs=1e-3)


def test_language(spark, docs, none, rows):
    letters = {"aa": "abcdef", "bb": "mnopqr", "cc": "àéñü"}
    rng = random.Random(2)
    data = [doc(i, " ".join("".join(rng.choices(letters[lang], k=rng.randint(2, 6))) for _ in range(rng.randint(20, 400))), lang) for i, lang in enumerate(list(letters) * 60)]
    frame = spark.createDataFrame(data, DOCS)
    net = langid.train(frame.where("doc_id % 5 <> 0"))
    got = {r.id: r for r in langid.predict(frame, net).collect()}
    assert np.mean([got[r[0]].lang_pred == r[2] for r in data if r[0] % 5 == 0]) > 0.95
    odd = {r.id: r for r in langid.predict(spark.createDataFrame([doc(1, None), doc(2, "12 !?"), doc(3, ""), doc(4, "ab")], DOCS), net).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and odd[4].lang_pred == "aa" and 0 <= odd[4].score <= 1
    assert langid.train(none) is None and {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(none, net).count() == 0


def test_windows_cover_texts():
    lengths = np.array([0, 1, 191, 192, 193, 1000])
    offsets = np.append(0, np.cumsum(lengths))
    starts, owner = langid.windows(lengths, offsets)
    for i, n in enumerate(lengths):
        seen = np.zeros(n, bool)
        for s in starts[owner == i] - offsets[i]:
            seen[s : s + langid.WINDOW] = True
        assert seen.all() and (owner == i).sum() == max(1, -(-n // langid.WINDOW))


def left_words(docs, **params):
    return {r.doc_id: r.text.split() for r in passages.without_passages(docs, **params).collect()}


def test_passage_that_occurs_many_times(spark):
    passage, lead = prose(21, 55), " ".join(prose(21, 55).split()[10:18])
    rows = [doc(1, prose(22, 50) + " " + passage + " " + prose(23, 40)), doc(2, prose(24, 30) + " " + " ".join([passage] * 13)), doc(3, prose(25, 20) + " " + lead + " " + prose(26, 60) + " " + passage + " " + prose(27, 30))]
    for block_bytes in (8 << 20, 500):
        got = left_words(spark.createDataFrame(rows, DOCS), block_bytes=block_bytes)
        assert got[1] == rows[0][1].split() and got[2] == prose(24, 30).split()
        assert len(got[3]) == len(rows[2][1].split()) - 55
    # periods: as many words as the longer of two repetitive texts has in common with the other
    rows = [doc(1, "x y z " + "a b c d e f g " * 30), doc(2, "a b c d e f g " * 50 + "u v w")]
    got = left_words(spark.createDataFrame(rows, DOCS))
    assert len(got[2]) <= 3 + 7


def edited(text, share, rng):
    """The text with ``share`` of its words replaced, not the first and the last."""
    out = text.split()
    for i in rng.sample(range(1, len(out) - 1), int(share * len(out))):
        out[i] = "q%d" % rng.randrange(10**6)
    return " ".join(out)


def test_recall_at_share(spark):
    rng, rows, n = random.Random(5), [], 0
    for size in (40, 50, 60, 100):
        for share in (0.1, 0.15, 0.2):
            for _ in range(20):
                passage = prose(1000 + n, size)
                rows.append(doc(2 * n, prose(50_000 + n, 60) + " " + passage + " " + prose(60_000 + n, 60)))
                rows.append(doc(2 * n + 1, prose(70_000 + n, 60) + " " + edited(passage, share, rng) + " " + prose(80_000 + n, 60)))
                n += 1
    got = {(r.id, r.earlier_id) for r in passages.repeated_passages(spark.createDataFrame(rows, DOCS), block_bytes=100_000).collect()}
    assert len(got & {(2 * i + 1, 2 * i) for i in range(n)}) >= 0.99 * n
    assert not {d for d, _ in got if d % 2 == 0}


def brute_left(rows, span=40):
    seen, out = set(), {}
    for r in sorted(rows, key=lambda r: r[0]):
        own = r[1].lower().split()
        runs = [tuple(own[i : i + span]) for i in range(len(own) - span + 1)]
        gone = {j for i, run in enumerate(runs) if run in seen for j in range(i, i + span)}
        seen.update(runs)
        out[r[0]] = [w for j, w in enumerate(own) if j not in gone]
    return out


def test_passages_across_seams(spark):
    rng = random.Random(8)
    passage = prose(31, 60).split()
    around = lambda i, middle: prose(40 + i, 50).split() + middle + prose(140 + i, 50).split()
    rows = [doc(i, " ".join(around(i, m))) for i, m in ((1, passage[:30]), (2, passage[30:]), (3, passage), (4, passage), (6, passage[5:47]), (7, passage[10:60]))]
    rows.append(doc(5, " ".join(around(5, edited(" ".join(passage), 0.1, rng).split()))))
    # a text of many pieces that all occur earlier, at random and in order
    pieces = [prose(300 + i, rng.randint(3, 25)).split() for i in range(60)]
    rows += [doc(100 + i, " ".join(w for _ in range(30) for w in rng.choice(pieces))) for i in range(12)]
    rows += [doc(120 + i, " ".join(w for p in pieces[rng.randrange(20) : 40 + rng.randrange(20)] for w in p)) for i in range(6)]
    for block_bytes in (8 << 20, 2000):
        docs = spark.createDataFrame(rows, DOCS)
        got = left_words(docs, block_bytes=block_bytes)
        for i, left in brute_left(rows).items():
            if i < 5 or 5 < i < 10:
                assert got[i] == left, i
            else:  # with edits, more may go, never less
                it = iter(left)
                assert all(w in it for w in got[i]), i
        assert len(got[4]) == 100 and len(got[5]) == 100
        found = {(r.id, r.start, r.n_words, r.earlier_id) for r in passages.repeated_passages(docs, block_bytes=block_bytes).collect()}
        assert (4, 50, 60, 3) in found


def test_repeats_inside_a_text_leave_it_similar(spark):
    texts = [prose(400 + i, 150) for i in range(12)]
    rows = [doc(i, t) for i, t in enumerate(texts)]
    rows += [doc(100 + i, t + " " + t) for i, t in enumerate(texts)]
    rows += [doc(200 + i, t + " " + " ".join([" ".join(t.split()[:60])] * 6)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    sets = {r[0]: {tuple(w[i : i + 5]) for w in [r[1].split()] for i in range(len(w) - 4)} for r in rows}
    for i in range(12):
        assert all(len(sets[i] & sets[k + i]) >= 0.8 * len(sets[i] | sets[k + i]) for k in (100, 200))
    assert sorted(r.doc_id for r in simhash.first_of_similar(docs).select("doc_id").collect()) == list(range(12))


def test_columns_that_clash_with_helpers(spark):
    names = ["match", "match_", "gone", "key", "copied", "doc", "id"]
    rows = [(1, "https://a.org/x", prose(1, 80), "s", *range(7)), (2, None, prose(1, 80), "s", *range(7)), (3, "x://example.org/es/1", prose(2, 9), None, *range(7))]
    df = spark.createDataFrame(rows, "doc_id long, url string, text string, source string, " + ", ".join(f"{n} int" for n in names))
    found = url_filter.url_verdicts(df, [("block", "example.org", "/es/")])
    assert found.columns == [*df.columns, "host", "path", "rule", "verdict"] and [r.verdict for r in found.orderBy("doc_id").collect()] == ["allow", "allow", "block"]
    left = simhash.first_of_similar(df)
    assert left.schema == df.schema and sorted(r.doc_id for r in left.collect()) == [1, 3]
    ordered = mixing.training_order(df, mixing.plan_mix(df))
    assert set(df.columns) <= set(ordered.columns) and {r.match for r in ordered.collect()} == {0}


def test_positions_of_copies(spark):
    df = spark.createDataFrame([(i, prose(i, 20 + i % 7), "abc"[i % 3]) for i in range(60)] + [(99, None, "a"), (98, " ", None)], "doc_id long, text string, source string")
    for r in mixing.plan_mix(df).collect():
        assert sum(c.words for c in r.copies) == r.taken
        at = [c.position for c in r.copies]
        assert at == sorted(at) and all(0 <= p <= 1 for p in at)


def test_held_out_is_never_null(spark):
    from emberline.llm.queries import held_out_of

    rows = spark.createDataFrame([(None,), (1,), (2,), (3,), (4,)], "doc_id long").select(held_out_of("doc_id").alias("h")).collect()
    assert {r.h for r in rows} == {True, False} and rows[0].h is False
