"""Row-wise operators against brute force, and the cases every operator must take."""

import collections
import math
import pathlib
import re
import zlib
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import awkward
from tramlines.llm import decontam, html_density, licenses, maxent, packing, quality, textops, token_store, toxicity
from tramlines.llm.tokens import encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = textops.tokenizer_path()


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


# quality


def base_figures(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = collections.Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_base_figures(make, prose):
    rows = awkward(prose) + [(20, "a b c\na b c\nx | y | z | q\n" * 9), (21, "## $1 %% && <b>"), (22, "é ñ\n" * 40)]
    out = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.clean_lines(make(rows)).collect())
    want = []
    for i, t in rows:
        f = base_figures(t)
        want.append((i, *f, f[0] < 50 or 100 * f[4] > 50 * f[0]))
    assert out == sorted(want)


def test_quality_verdict(make, prose):
    good = "\n".join(prose(s, 60) + "." for s in range(3))
    menu = "\n".join(" | ".join(f"item{i}{j}" for j in range(12)) for i in range(8))
    rows = {r.doc_id: r for r in quality.clean_lines(make([(1, good), (2, menu), (3, good + "\nhome | about | contact | login\nAll rights reserved.")])).collect()}
    assert rows[1].kept and rows[1].clean_text == good and not rows[2].kept
    assert rows[3].kept and rows[3].clean_text == good and rows[3].n_lines_removed == 2


def test_quality_empty(make):
    assert quality.clean_lines(make([])).count() == 0


# language model


def test_maxent_counts_and_gain(spark, make, prose):
    rows = awkward(prose) + [(100 + i, prose(i % 7, 300, 50)) for i in range(60)]
    docs = make(rows)
    learn = docs.where(toxicity.remainder(7) != 2)
    counts = maxent.token_counts(learn)
    model = maxent.train(learn, counts, maxent.Shape(head=64))
    out = sorted(maxent.score(docs, model, counts).collect())
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    seen = collections.Counter()
    for i, t in rows:
        if not held(i):
            seen.update([*WORD.findall(lower(t or "")), None])
    n, v = sum(seen.values()), len(seen)
    want = []
    for i, t in rows:
        tokens = [*WORD.findall(lower(t or "")), None]
        want.append((i, len(tokens), sum(x in seen for x in tokens), sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in tokens)))
    want.sort()
    assert [(r.doc_id, r.n_tokens, r.n_known) for r in out] == [w[:3] for w in want] and all(r.train_tokens == n for r in out)
    assert all(math.isclose(r.base_score, w[3], rel_tol=1e-9) for r, w in zip(out, want, strict=True))
    mine = [r for r in out if r.doc_id >= 100 and held(r.doc_id)]
    assert mine and sum(r.score for r in mine) > sum(r.base_score for r in mine)


def test_maxent_nothing_to_learn(make):
    docs = make([(1, "a b"), (2, None)])
    counts = maxent.token_counts(docs.where("false"))
    out = sorted(maxent.score(docs, maxent.train(docs.where("false"), counts), counts).collect())
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]


# toxicity


def test_toxicity_learns_and_takes_anything(spark, make, prose):
    rows = [(i, prose(i, 60) + (" you vile blockhead" if i % 4 == 0 else "")) for i in range(100, 500)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 0) for i, _ in rows] + [(None, 1, 0), (100, None, 0)], "doc_id long, toxic int, quality int")
    learn = toxicity.remainder(3) != 1
    machine = toxicity.train(make(rows), labels, learn)
    out = {r.doc_id: r.score for r in toxicity.scores(make(rows + awkward(prose)), machine).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((out[i] >= 0.7) == (i % 4 == 0) for i in held)
    assert all(0 <= s <= 1 for s in out.values()) and out[1] == out[2] and out[6] < 0.7


def test_toxicity_pairs_beyond_weights():
    """Two terms that are harmless apart and toxic together: additive weights cannot tell, the machine does."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, 2000), rng.integers(0, 2, 2000)
    label = ((a == b) & (rng.random(2000) < 0.98)).astype(int)
    doc = np.repeat(np.arange(2000), 2)
    term = np.stack([10 + a, 20 + b], 1).ravel()
    m = toxicity.fit(doc, term, label, toxicity.Fit(least_chi=-1, epochs=80, l2=0, terms=4))
    z, _ = toxicity._forward(m, m.slot[term], doc, 2000)
    assert ((z > 0) == (label == 1)).mean() > 0.95


def test_toxicity_pairs_with_production_settings():
    """As above with the settings of the registered query: terms of little association of their own are learned too."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, 2000), rng.integers(0, 2, 2000)
    label = ((a == b) & (rng.random(2000) < 0.98)).astype(int)
    doc, term = np.repeat(np.arange(2000), 2), np.stack([10 + a, 20 + b], 1).ravel()
    m = toxicity.fit(doc, term, label, toxicity.Fit())
    z, _ = toxicity._forward(m, m.slot[term], doc, 2000)
    assert (m.slot >= 0).sum() == 4 and ((z > 0) == (label == 1)).mean() > 0.95


def test_toxicity_cap_keeps_the_share(spark, make):
    """A text without evidence scores the share of toxic labels, whether or not the sample binds."""
    rows = [(i, f"same words {'here' if i % 2 else 'there'}") for i in range(2000)]
    labels = spark.createDataFrame([(i, int(i % 10 < 2)) for i, _ in rows], "doc_id long, toxic int")
    learn = toxicity.remainder(3) != 1
    got = []
    for cap in (6000, 100):
        machine = toxicity.train(make(rows), labels, learn, toxicity.Fit(per_class=cap))
        got.append(np.mean([r.score for r in toxicity.scores(make(rows), machine).collect()]))
    assert abs(got[0] - 0.2) < 0.05 and abs(got[1] - 0.2) < 0.08


def test_toxicity_without_labels(spark, make):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    machine = toxicity.train(make([(1, "a")]), labels, toxicity.remainder(3) != 1)
    assert [r.score for r in toxicity.scores(make([(1, "a"), (2, None)]), machine).collect()] == [0.5, 0.5]


# tokens


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sABz09.,é中ñ\xa0 \x1c²ªßĳ😀")), st.characters(codec="utf-8")), max_size=40))
def test_encoder_equals_library(text):
    e = encoder(PATH)
    assert np.frombuffer(e.encode(text), "<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_store_round_trip(spark, make, prose, encoding, tmp_path):
    rows = awkward(prose)
    path = f"file://{tmp_path}/ids"
    token_store.write(make(rows), path, encoding=encoding)
    got = sorted(token_store.read(spark, path).collect(), key=lambda r: r.start)
    at, tokenizer = 0, encoder(PATH).whole
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for r in got:
        ids = [*tokenizer.encode(texts[r.doc_id].pop(), add_special_tokens=False).ids, 0]
        assert (r.ids, r.start, r.n_tokens) == (ids, at, len(ids))
        at += len(ids)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in token_store.checksums(spark, path).collect()}
    assert crc == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    index = token_store.read_index(spark, path)
    assert "ids" not in index.columns and index.count() == len(got)


def test_token_store_empty(spark, make, tmp_path):
    token_store.write(make([]), f"file://{tmp_path}/none")
    assert token_store.checksums(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name, license_id", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_complete_licences_of_this_system(make, name, license_id):
    path = pathlib.Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("this system has no licence texts")
    text = path.read_text()
    other = "Copyright (c) 2020 Someone\n" + re.sub(r"\bLICENSE\b", "LICENCE", text.upper()).replace("\n\n", "\n \n")
    out = {r.doc_id: r.license_id for r in licenses.scan(make([(1, text), (2, other), (3, text + " and more")])).collect()}
    assert out == {1: license_id, 2: license_id, 3: None}


# packing


def check_packing(out, rows, capacity=1024):
    tokenizer = encoder(PATH).whole
    want = collections.Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        a, b, k = 0, min(len(ids), len(ids) % capacity or capacity), 0
        while a < len(ids):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
            a, b, k = b, b + capacity, k + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in out) / capacity


def test_packing_places_everything(make, prose):
    rows = awkward(prose) + [(50 + i, prose(i, 20 + 13 * (i % 40))) for i in range(200)]
    bins, least = check_packing(packing.pack(make(rows)).collect(), rows)
    assert bins <= 1.03 * least + 1


def test_packing_tree(make, prose):
    """Many small batches: the tree of rounds must come close to packing all at once."""
    rows = [(i, prose(i, 10 + 7 * (i % 50))) for i in range(300)]
    bins, least = check_packing(packing.pack(make(rows), batch_items=16, group_items=40).collect(), rows)
    assert bins <= 1.08 * least + 1
    assert packing.pack(make([])).count() == 0


def test_packing_of_bins_that_fit_with_nothing(make, prose):
    """Every document fills more than half: all bins are items of each round, none can be joined, rounds end."""
    rows = [(i, prose(i, 300)) for i in range(60)]
    bins, _ = check_packing(packing.pack(make(rows), batch_items=4, group_items=10).collect(), rows)
    assert bins == 60


def test_packing_null_and_large_ids(make, prose):
    rows = [(None, prose(1, 90)), (None, None), (2**60 + 1, prose(2, 40)), (-5, prose(3, 700)), (-5, "x")]
    check_packing(packing.pack(make(rows)).collect(), rows)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit(lengths):
    bins, at, fill = packing.best_fit(np.array(lengths, np.int64), 64)
    assert all(fill <= 64) and fill.sum() == sum(lengths)
    assert sum(2 * fill <= 64) <= 1  # two bins at most half full would have been one
    for b in range(len(fill)):
        spans = sorted((at[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b)
        assert [s for s, _ in spans] == np.cumsum([0] + [n for _, n in spans])[:-1].tolist()


# pages

PAGE = '<html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body><nav><a href=1>Home</a></nav><div class="ad">Buy now, it is cheap and good.</div>{}<footer>&copy; x</footer></body></html>'


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (PAGE.format("<article><h1>Big &amp; small</h1><p><b>First  part.<br><p>Second\n\tpart &eacute;&#33;</p></article>"), "Big & small First part. Second part é!"),
        (PAGE.format('<main><h2>Head</h2><div><p>Some words in a row, with more to say.</p><p>And yet more words, as said.</p></div><aside>Aside</aside><section class="comments"><p>A reader says a lot of things here.</p></section></main>'), "Head Some words in a row, with more to say. And yet more words, as said."),
        (PAGE.format("<article><h1>Only</h1></article>"), "Only"),
        (PAGE.format('<div class="page"><form>Mail <input></form><div id="cookie-notice">We use cookies.</div><article><p>Body <i>in</i>line.</p><ul><li>one<li>two</ul></article></div>'), "Body inline. one two"),
        ("no tags a < b", "no tags a < b"),
        ("", ""),
        (None, ""),
        ("<p>", ""),
        ("<!-- only a comment", ""),
        ("<script>x", ""),
    ],
)
def test_main_text(html, text):
    assert html_density.main_text(html) == text


def test_extract_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE.format("<article><p>é ok.</p></article>"), "x"), (1, "u", None, "x"), (2, None, "<p>" * 20000 + "deep.", "x")], "page_id long, url string, html string, text string")
    assert sorted(tuple(r) for r in html_density.extract(pages).collect() if r.page_id == 1) == [(1, "u", "", 0), (1, "u", "é ok.", 5)]
    assert html_density.extract(pages.where("false")).count() == 0 and html_density.extract(pages).where("page_id = 2").first().text == "deep."


# licences


def test_license_dress(spark, make):
    mit = dict(licenses.KNOWN[::-1])["MIT"]
    dressed = "Copyright (c) 2020 Somebody Else\n\n" + re.sub(r"\s+", "\n  * ", licenses._MIT.upper()).replace("SUBLICENSE", "Sublicence").replace('"', "“")
    rows = [(1, dressed), (2, licenses._MIT + " extra"), (3, "Prose.\nReleased under the MIT  licence\n"), (4, None), (5, "…!"), (6, licenses._GPL.replace("https", "http")), (3, "All rights reserved!")]
    out = sorted(((r.doc_id, r.license_id, r.line_licenses, r.digest is None) for r in licenses.scan(make(rows)).collect()), key=str)
    assert mit and out == sorted([(1, "MIT", None, False), (2, None, None, False), (3, None, "MIT,all-rights-reserved", False), (3, "all-rights-reserved", "MIT,all-rights-reserved", False), (4, None, None, True), (5, None, None, True), (6, "GPL-3.0-or-later", None, False)], key=str)
    assert licenses.scan(make([])).count() == 0
    own = licenses.known_digests(spark, spark.createDataFrame([("mine", "My  TERMS")], "license_id string, text string"))
    assert licenses.scan(make([(1, "my terms!")]), own).first().license_id == "mine"


# decontamination


def brute_leaks(texts, items, share=0.8):
    cut = lambda t: re.findall(r"[^\x00-\x20!-/:-@\[-`{-\x7f]+", lower(t or ""))
    out = {}
    for d, t in texts:
        words, hits = cut(t), set()
        for i, s in items:
            w = cut(s)
            if not w:
                continue
            lines = [x for x in s.split("\n") if cut(x)]
            parts = [cut("\n".join(lines[:-1] or lines)), cut(lines[-1])]
            span = 2 * len(w)
            if len(set(w) & set(words)) < share * len(set(w)) / 2:
                continue
            for j in range(max(1, len(words) - span + 1)):
                passage = words[j : j + span]
                for p in parts:  # question and answer must both stand in the passage
                    k = min(5, len(p))
                    want = {tuple(p[m : m + k]) for m in range(len(p) - k + 1)}
                    have = {tuple(passage[m : m + k]) for m in range(len(passage) - k + 1)}
                    if len(want & have) < share * len(want) - 1e-9:
                        break
                else:
                    hits.add(i)
                    break
        out.setdefault(d, set()).update(hits)
    return out


def test_decontamination(spark, make, prose):
    items = [(i, prose(1000 + i, 15 + i)) for i in range(40)] + [(90, None), (91, " "), (92, "just four short words"), (93, prose(1000, 20) + "\n" + prose(1001, 9))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(200 + i, prose(i, 150) + " " + (items[i][1] if i % 2 else " ".join(items[i][1].split()[: len(items[i][1].split()) // 2])) + " " + prose(i + 500, 150)) for i in range(40)]
    rows += awkward(prose) + [(300, "Just four, short WORDS!"), (301, prose(1, 70) + " " + items[5][1].upper().replace(" ", " , ") + " end")]
    rows += [(302, prose(8, 40) + " " + prose(1000, 20) + " " + prose(9, 40)), (303, prose(8, 40) + " " + prose(1000, 20) + " " + prose(1001, 9))]
    got = {r.doc_id: set(r.item_ids) for r in decontam.decontaminate(make(rows), bench).collect()}
    assert got == brute_leaks(rows, items)
    assert 93 not in got[302] and 93 in got[303]  # the question alone is no leak
    twice = make([*rows, (None, rows[1][1]), (300, None), (301, rows[3][1])])
    one, many = (sorted(map(str, decontam.decontaminate(twice, bench, **how).collect())) for how in ({}, {"block_items": 7}))
    assert one == many and len(one) == len(rows) + 3
    none = decontam.decontaminate(make([(1, "a")]), bench.where("false")).first()
    assert not none.contaminated and none.item_ids == [] and decontam.decontaminate(make([]), bench).count() == 0


def test_wand_equals_scan(prose):
    texts = [(i, prose(i, 12 + i % 20, 90)) for i in range(120)]
    words = [decontam._words([t])[0] for _, t in texts]
    df = collections.Counter(int(x) for w in words for x in np.unique(w).view(np.int64))
    index = decontam.build_index(texts, len(texts), float(np.mean([len(w) for w in words])), max(map(len, words)), df, 0.8)
    dense = np.zeros((len(index.terms), len(index.items)))
    for t in range(len(index.terms)):
        dense[t, index.posting[index.heads[t] : index.heads[t + 1]]] = index.impact[index.heads[t] : index.heads[t + 1]]
    rng = np.random.default_rng(3)
    for _ in range(200):
        base = np.flatnonzero(dense[:, rng.integers(len(index.items))])
        q = np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.integers(0, len(index.terms), 12)]))
        assert decontam.block_max_wand(index, q) == np.flatnonzero(dense[q].sum(0) >= index.threshold).tolist()


def test_toxicity_learns_planted_pairs_with_production_settings(spark, make, prose):
    """Two insults and two groups: only some pairs are toxic, no word tells anything by itself."""
    rows, toxic, rng = [], {}, np.random.default_rng(3)
    for i in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append((i, f"{prose(i, 12, 500)} {('dolt', 'knave')[a]} {('northmen', 'southmen')[b]}"))
        toxic[i] = int(a == b)
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    machine = toxicity.train(make(rows), labels, toxicity.remainder(3) != 1)
    held = [i for i in toxic if zlib.crc32(str(i).encode()) % 3 == 1]

    def right(m):
        out = {r.doc_id: r.score for r in toxicity.scores(make(rows), m).collect()}
        return sum((out[i] >= 0.5) == (toxic[i] == 1) for i in held) / len(held)

    assert right(machine) > 0.95 and right(replace(machine, v=np.zeros_like(machine.v))) < 0.6
