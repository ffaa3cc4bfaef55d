"""Toxicity, quality, PII, HTML and language: held-out accuracy and edge cases."""

from __future__ import annotations

import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionflow.llm import boosting, html_text, language, pii, quality, toxicity
from sessionflow.llm.common import held_out, least_by_hash, maybe_among

SF = "/root/testdata/sf0.01"


def _held_out_accuracy(spark, module, label, modulus, remainder):
    # sf0.1: 800 to 1,300 held-out rows; smaller tables hold out too few to tell
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = held_out(F.col("doc_id"), modulus, remainder)
    model = module.fit(docs, labels, held)
    rows = docs.join(labels, "doc_id").where(held).select(
        module.score(model, F.col("text")).alias("s"), F.col(label).alias("y")
    ).collect()
    return np.mean([(r.s >= 0.5) == (r.y == 1) for r in rows])


def test_quality_held_out(spark):
    assert _held_out_accuracy(spark, quality, "quality", 3, 1) >= 0.97


def test_toxicity_held_out(spark):
    assert _held_out_accuracy(spark, toxicity, "toxic", 5, 0) >= 0.93


def test_scores_of_edge_rows(spark, edge_docs, no_docs, labels, small_docs):
    held = F.lit(False)
    for module in (quality, toxicity):
        model = module.fit(small_docs, labels, held)
        rows = edge_docs.select(module.score(model, F.col("text")).alias("s")).collect()
        assert len(rows) == 10 and all(0 <= r.s <= 1 for r in rows)
        assert no_docs.select(module.score(model, F.col("text"))).count() == 0
        none = module.fit(no_docs, labels.limit(0), held)
        assert all(abs(r[0] - 0.5) < 1e-6 for r in edge_docs.select(module.score(none, F.col("text"))).collect())
        one = labels.select("doc_id", F.lit(1).alias("quality"), F.lit(1).alias("toxic"))
        assert small_docs.limit(3).select(module.score(module.fit(small_docs, one, held), F.col("text"))).first()[0] > 0.99


def test_disguised_words_are_restored(spark, small_docs):
    reader = toxicity.Model(toxicity.trigram_counts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))).reader()
    for disguised in ("1d10t", "idiooooot", "i.d.i.o.t", "id!ot", "i d i o t"):
        assert "idiot" in reader.words(f"you {disguised} and them"), disguised
    assert reader.words("plain words, stay &&& as they are!") >= {"plain", "words", "stay", "are"}


@pytest.fixture(scope="module")
def corpus_reader(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return toxicity.Model(toxicity.trigram_counts(docs), words=toxicity.vocabulary(docs)).reader()


def test_long_disguises_are_restored(corpus_reader):
    reader = corpus_reader
    assert "idiot" in reader.words("you idi" + "o" * 60 + "t and them")
    for sign in "._":
        for n in (1, 4, 9):
            joined = sign.join("the are such a".split() * n + "1d10t and all".split())
            assert {"idiot", "such", "the"} <= reader.words(joined), joined
            assert {"such", "idiot"} <= set(reader.text(joined).split())
    assert "idiot" in reader.words("they_are_an_1d10t")
    assert reader.text("a r e s t u p i d") == "are stupid"
    assert {"the", "stupid"} <= reader.words("t h e s t u p i d")
    assert "idiot" in reader.words("i d i o t")
    assert reader.words("q" * 50_000 + "1x" * 50_000 + "ab" * 50_000)  # linear time


@pytest.mark.parametrize(
    "glued",
    ["badidiot", "stupididiot", "theyarestupididiots", "theyarestupidandtheyaresuchidiotsandbad",
     "theyarestupidandtheyaresuchidiotsandtrash", "theyarestupidandtheyaresuchidiotstheyallareidiot"],
)
def test_glued_words_are_split_at_any_length(corpus_reader, glued):
    wanted = {w for w in ("idiot", "stupid") if w in glued}
    assert wanted <= corpus_reader.words(f"so {glued} here")
    assert wanted <= corpus_reader.words(" ".join(glued))


def test_viterbi_equals_enumeration(spark, small_docs):
    speller = toxicity.Speller(toxicity.trigram_counts(small_docs))
    r = random.Random(4)
    for _ in range(150):
        token = "".join(r.choice("aeidt0134$!.|x_") for _ in range(r.randint(1, 6)))
        totals = {}
        for parts in itertools.product(*speller._lattice(token)):
            word = "".join(letters for letters, _ in parts)
            total = speller.costs(word)[-1] + sum(price for _, price in parts)
            totals[word] = min(total, totals.get(word, math.inf))
        assert totals[speller.restore(token)] <= min(totals.values()) + 1e-9, token


def test_split_equals_enumeration(spark, small_docs):
    words = {"the": 2.0, "he": 4.0, "then": 4.5, "in": 3.0, "no": 3.5, "nothing": 6.0, "thing": 5.0, "hen": 7.0, "a": 3.0}
    reader = toxicity.Reader(toxicity.Speller(toxicity.trigram_counts(small_docs)), words)
    r = random.Random(7)

    def price(parts):
        total, at, spelled = -toxicity.GLUE_COST, 0, reader._speller.costs("".join(parts))
        for p in parts:
            other = toxicity.OTHER_COST + spelled[at + len(p)] - spelled[at]
            total += toxicity.GLUE_COST + min(words.get(p, math.inf), other)
            at += len(p)
        return total

    for _ in range(150):
        letters = "".join(r.choice(["the", "no", "thing", "in", "x", "e", "n", "a"]) for _ in range(r.randint(1, 4)))[:10]
        if letters in words:
            continue
        every = [
            [letters[i:j] for i, j in zip((0, *cut), (*cut, len(letters)))]
            for k in range(len(letters))
            for cut in itertools.combinations(range(1, len(letters)), k)
        ]
        assert abs(price(reader._unglued(letters).split()) - min(map(price, every))) < 1e-9, letters


def test_split_rows_equal_single_splits(corpus_reader, small_docs):
    words = {w for d in small_docs.collect() for w in re.findall(r"[^\W\d_]+", d.text.lower())}
    words |= {a + b for a, b in zip(sorted(words)[::7], sorted(words)[::5])}
    words = {w for w in words if w not in corpus_reader._words}
    corpus_reader._parted.clear()
    corpus_reader._unglue_all(words)
    found = dict(corpus_reader._parted)
    assert len(found) > 1000 and any(" " in v for v in found.values())
    assert found == {w: corpus_reader._split(w) for w in found}


def test_remembered_tokens_read_as_new_ones(corpus_reader, small_docs, monkeypatch):
    texts = [d.text for d in small_docs.orderBy("doc_id").limit(60).collect()]
    texts += ["", None, " \n ", "s p a c e d f.o.o.d h-e-l-l-o!", "thething thething, (thething) thething***", "a" * 300,
              "heeello heeello. x" + "the" * 40 + " m² 4pples, İx ΣΑΣ\u2028v1agra", "the " * 200 + "th3 thing"]
    read = corpus_reader._readings

    def slow(text):
        low = (text or "").lower()
        out = {w for t in low.split() for w in " ".join(read(t)).split()}
        for run in toxicity._SPACED.findall(low):
            letters = run[::2]
            plain = toxicity._PLAIN.fullmatch(letters)
            more = [] if plain and not toxicity._RUN.search(plain[1]) else [corpus_reader._joined(letters)]
            out.update(" ".join([*read(letters), *more]).split())
        return out

    want = [slow(t) for t in texts]
    assert any(len(w) > 50 for w in want)
    monkeypatch.setattr(toxicity, "READ_CHARS", 4000)
    monkeypatch.setattr(toxicity, "CACHE_PARTED", 100)
    for most in (0, 300, 10**6):  # never, sometimes and always remembered
        monkeypatch.setattr(toxicity, "CACHE_WORDS", most)
        corpus_reader._forget()
        corpus_reader._parted.clear()
        for _ in range(2):
            assert list(corpus_reader.words_of(texts)) == want
        # a token is remembered once, by its hash
        assert len(corpus_reader._read) == len(corpus_reader._keys) == len(np.unique(corpus_reader._keys))


def test_a_word_is_read_once_whatever_signs_stand_around_it(corpus_reader):
    corpus_reader._forget()
    texts = ["stupididiot stupididiot, \u00abstupididiot\u00bb stupididiot***", "stupididiot: the... -the-"]
    assert list(corpus_reader.words_of(texts)) == [{"stupid", "idiot"}, {"stupid", "idiot", "the"}]
    assert len(corpus_reader._read) == 2


def test_words_of_all_lengths_are_split_at_once(corpus_reader, monkeypatch):
    r, calls, rows = random.Random(3), [], toxicity.Reader._split_rows
    words = {"".join(r.choices(["the", "th", "ing", "stupid", "\u00df", "\u00bd", "\U00010330", "a", "x"], k=n)) for n in range(1, 14) for _ in range(30)}
    words -= set(corpus_reader._words)
    monkeypatch.setattr(toxicity.Reader, "_split_rows", lambda self, *a: calls.append(1) or rows(self, *a))
    for most, times in ((10_000, 1), (50, None)):
        monkeypatch.setattr(toxicity, "MATRIX_ROWS", most)
        calls.clear()
        corpus_reader._parted.clear()
        corpus_reader._unglue_all(words)
        assert corpus_reader._parted == {w: corpus_reader._split(w) for w in words}
        assert times is None or len(calls) == times
    assert any(" " in w for w in corpus_reader._parted.values()) and len(set(map(len, words))) > 20


def test_signs_that_tokens_hold_are_found_as_by_patterns(small_docs):
    texts = [d.text.lower() for d in small_docs.limit(50).collect()]
    texts += ["", " ", "a", "aaa", "aab (aaab) x*y 'q' m\u00b2, \u0663 \u00bd \u2028_a_ a_ $a a$ aa\u00e9\u00e9\u00e9. a.b \u3042\u3044!", "s p a c e d", "i.d i", "a b c", " a b"]
    hint = re.compile(r"[ .\-_*](?:[^\W_]|[@$!|+(<\u20ac])[ .\-_*](?:[^\W_]|[@$!|+(<\u20ac])(?![^\W_])")
    for text in texts:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = toxicity._kinds()[points]
        found = [(text[i:j], p) for i, j, p in zip(*(x.tolist() for x in toxicity._tokens(points, kinds)))]
        plain = [toxicity._PLAIN.fullmatch(t) for t in text.split()]
        plain = [m if m and not toxicity._RUN.search(m[1]) else None for m in plain]
        assert found == [(m[1], True) if m else (t, False) for t, m in zip(text.split(), plain)]
        assert bool(len(toxicity._maybe_spaced(kinds))) == bool(hint.search(text))


def test_tally_equals_plain_sums():
    words, r = ["a", "bb", "ccc", "dd", "e"], np.random.default_rng(1)
    tally, want = toxicity.Tally(2), {}
    for _ in range(20):
        some = np.sort(r.choice(5, r.integers(0, 5), replace=False))
        text, n, m = " ".join(words[i] for i in some), r.integers(0, 9, len(some)), r.integers(0, 9, len(some))
        end = np.cumsum([len(words[i]) + 1 for i in some]).astype(int) - 1
        start = end - [len(words[i]) for i in some] if len(some) else end
        tally.add(text, some.astype(np.uint64), start, end, n, m)
        for i, x, y in zip(some, n, m):
            old = want.get(words[i], (0, 0))
            want[words[i]] = (old[0] + x, old[1] + y)
    got = tally.taken("w", "n", "m")
    assert {w: (n, m) for w, n, m in zip(*(c.to_pylist() for c in got.values()))} == want
    assert [len(c) for c in tally.taken("w", "n", "m").values()] == [0, 0, 0]


def test_toxicity_fit_does_not_depend_on_the_order_of_repeated_ids(spark, small_docs, labels):
    twice = small_docs.unionByName(small_docs.withColumn("text", F.concat(F.lit("other words before "), "text")))
    found = []
    for n in (1, 7):
        model = toxicity.fit(twice.repartition(n), labels, F.lit(False))
        found.append((model.bias, model.weights, model.words))
    assert found[0] == found[1]


def test_toxicity_learns_from_every_row(spark):
    # a word of those ids only whose hashes are greatest, and one of texts without a label
    ids = [r[0] for r in spark.range(24_000).orderBy(F.xxhash64("id")).collect()]
    rows = [(i, f"stay here number {'abcdefghij'[i % 10] * 2}" + (" lastword" if n >= 20_000 and i % 2 else "")) for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows + [(-i, "nolabel text") for i in range(1, 101)], "doc_id long, text string")
    labels = docs.where("doc_id >= 0").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels, F.lit(False))
    assert {"lastword", "nolabel", "stay"} <= set(model.words) and model.weights["lastword "] > 0
    scored = toxicity.scored(docs, labels, F.lit(False), keep=["doc_id"])
    assert scored.columns == ["doc_id", "score"] and scored.count() == 24_100
    joined = scored.join(docs.select("doc_id", toxicity.score(model, F.col("text")).alias("s")), "doc_id")
    assert joined.where("abs(score - s) > 1e-4").count() == 0
    assert scored.join(docs.where("text like '%lastword'"), "doc_id").agg(F.min("score")).first()[0] > 0.5


def test_vocabulary_and_features_equal_plain_counts(spark, small_docs):
    texts = [r.text for r in small_docs.collect()] + [None, "", "ab" * 13 + " x1y, É-É é", "a b  a"] * 4
    counts = Counter(w for t in texts for w in {x for x in re.split(r"[\W\d_]+", (t or "").lower()) if 0 < len(x) <= 24})
    found = toxicity.vocabulary(spark.createDataFrame([(t,) for t in texts], "text string"))
    kept = {w: n for w, n in counts.items() if n >= 4}
    assert set(found) == set(kept)
    assert all(abs(found[w] + np.log(n / sum(kept.values()))) < 1e-9 for w, n in kept.items())
    read = [" ".join(sorted(set((t or "").split()))) for t in texts]
    every = [{f"{w} " for w in t.split()} | {w[:n] for w in t.split() for n in toxicity.PREFIXES if len(w) >= n} for t in read]
    chosen = sorted(set().union(*every))[::3]
    doc, held = toxicity.Holder(chosen).of(read)
    got = [set() for _ in read]
    for d, f in zip(doc.tolist(), held.tolist(), strict=True):
        got[d].add(chosen[f])
    assert got == [e & set(chosen) for e in every]


def test_rows_that_are_among_ids_stay(spark):
    ids = spark.range(0, 3000, 3).select(F.col("id").alias("doc_id"))
    kept = {r[0] for r in maybe_among(spark.range(30_000).select(F.col("id").alias("doc_id")), ids, "doc_id").collect()}
    assert kept >= set(range(0, 3000, 3)) and len(kept) < 6000


def test_signs_at_a_words_end_are_read(spark):
    known = spark.createDataFrame([("the dumbass will kill that ass of an idiot, all scum! stay here",)] * 300, "text string")
    reader = toxicity.Model(toxicity.trigram_counts(known), words=toxicity.vocabulary(known)).reader()
    for disguised, word in (("a$$", "ass"), ("idio+", "idiot"), ("dumba$$!", "dumbass"), ("ki||,", "kill"), ("1dio+.", "idiot")):
        assert word in reader.words(f"you {disguised} there") and word in reader.text(disguised).split(), disguised
    for spaced in ("i d i o t,", "i d ! o t", '"i d i o t"', "(i d i 0 t!)", "i.d.i.o.t.", "i d i o +", "an i d i o t, a"):
        assert "idiot" in reader.words(f"you {spaced}"), spaced
    assert "scum" in reader.words("all s c u m.") and "scum" in reader.text("all s c u m.").split()
    for plain in ("stay!", "idiot!!!", "all|", "kill?!"):
        assert reader.words(plain) == {plain.strip("!|?")}, plain
    assert reader.words("100$ 5€ 18+ 7! 250") == set()
    reader.words("! " * 50_000 + "!." * 50_000 + "x")  # linear time


def _brute_spans(text):
    patterns = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    out = []
    for kind, pattern in patterns:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    r = random.Random(1)
    for _ in range(4000):
        t = "".join(r.choice("ab@..-1 2+%50()9é") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == _brute_spans(t), t
    pii.base_spans("a" * 300_000 + "@" + "9" * 300_000)  # linear time


def test_pii_rows(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").unionByName(edge_docs.select("text"))
    model = pii.fit(docs)
    for r in docs.select("text", pii.find(model, F.col("text")).alias("f")).collect():
        base = [(s.kind, s.start, s.stop) for s in r.f.base]
        spans = [(s.kind, s.start, s.stop) for s in r.f.spans]
        assert base == _brute_spans(r.text or "") and set(base) <= set(spans)
    clean = {r.doc_id: r.t for r in edge_docs.select("doc_id", pii.redact(model, F.col("text")).alias("t")).collect()}
    assert clean[1].startswith("The cat") and "<email>" in clean[1] and "example" not in clean[1]
    assert clean[None] == "no id, call <phone> or <card> now" and clean[3] is None and clean[4] == ""
    assert pii.fit(no_docs).trees is None and no_docs.select(pii.find(pii.Model(), F.col("text"))).count() == 0


def test_disguised_data_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text")
    planted = [
        ("email", "write to {} for more", [f"nina.k{i} [at] shop{i} [dot] com" for i in range(40)]),
        ("email", "write to {} for more", [f"nina{i}(at)shop{i}.org" for i in range(40)]),
        ("ip", "the host {} is down", [f"10[.]{i}[.]7[.]{i + 3}" for i in range(40)]),
        ("card", "paid by card {} today", ["4111.1111.1111.1111", "5500_0000_0000_0004", "4012/8888/8888/1881"]),
    ]
    clean = ["paid by card 4111.1111.1111.1112 today", "the host 10[.]999[.]7[.]3 is down", "1. 2. 3. 4 are steps"]
    rows = [(k, f.format(s), s) for k, f, every in planted for s in every] + [("", t, "") for t in clean]
    added = spark.createDataFrame(rows, "kind string, text string, span string").coalesce(2)
    # common in the corpus, which must not keep them from being found
    model = pii.fit(docs.unionByName(added.select("text")))
    got = added.select("*", pii.find(model, F.col("text")).alias("f"), pii.redact(model, F.col("text")).alias("t")).collect()
    missed = [r.text for r in got if r.kind and (r.span in r.t or f"<{r.kind}>" not in r.t)]
    assert len(missed) <= 0.02 * len(rows), (missed, model.thresholds)
    assert [r.t for r in got if not r.kind] == clean


def test_least_by_hash_equals_the_whole_sort(spark):
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    every = [r.id for r in rows.orderBy("h").collect()]
    for limit in (1, 7, 300, 2400, 6000):
        assert [r.id for r in least_by_hash(rows, "h", limit, "id").collect()] == every[:limit]
    assert least_by_hash(rows.limit(0), "h", 5).count() == 0
    # beyond the line nothing is sorted: what one task gathers does not follow the table
    plan = least_by_hash(rows, "h", 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan


def test_pii_fit_counts_copies_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text")
    model = pii.fit(docs)
    assert model.trees is not None and set(model.thresholds) <= set(pii.KINDS)
    hot = spark.createDataFrame([("call 4111 1111 1111 1112 or 999.1.1.1 now",)], "text string")
    hot = hot.crossJoin(spark.range(3000)).select("text")
    first, second = pii.fit(docs.unionByName(hot.limit(1))), pii.fit(docs.unionByName(hot))
    assert first.thresholds == second.thresholds


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.fit(x[:1000], y[:1000])
    assert ((model.probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95
    assert boosting.fit(x[:5], np.ones(5)).trees == []


def test_html_marginals_equal_enumeration():
    from itertools import product

    model = html_text.default_model()
    nodes, _ = html_text.parse("<body><nav><a>x</a></nav><article><p>Some text here.<p>b</article>")
    score = html_text.node_features(nodes) @ model.weights
    total, content = 0.0, np.zeros(len(nodes))
    for labels in product(range(3), repeat=len(nodes)):
        p = float(np.exp(sum(score[i, v] for i, v in enumerate(labels)) - score.max(1).sum()))
        for i, n in enumerate(nodes[1:], 1):
            kind = html_text._KIND.get(n.tag, html_text.N_KINDS - 1)
            p *= model.edges[kind][labels[n.parent]][labels[i]]
        total += p
        content += p * (np.array(labels) == html_text.CONTENT)
    assert np.allclose(content / total, model.marginals(nodes), atol=1e-6)


def test_html_held_out_layouts():
    model = html_text.default_model()
    right = total = 0
    for page in html_text.labelled_pages(120, seed=99):
        nodes, blocks = html_text.parse(page)
        y, p = html_text.labels_of(nodes), model.marginals(nodes)
        right += sum((p[n] > 0.5) == (y[n] == html_text.CONTENT) for n, _ in blocks)
        total += len(blocks)
    assert right / total > 0.97


def test_html_rows(spark):
    pages = [
        (1, "u", "<html><body><nav><ul><li><a>m</a></li></ul></nav><article><h1>T &amp; x</h1><p><b>One,\n two.<br><p>Three&nbsp;four."
                 "<div class='ad'>Buy now.</div><section class=comments><p>I disagree, sir.</p></section></article><footer>&copy; f</footer>"),
        (2, "u", None), (3, None, ""), (4, "u", "<script>var a = '<p>no</p>';</script>"), (None, "u", "plain text, no tags at all here."),
        (6, "u", "<p title='>x"), (7, "u", "<article>" + "<p>Long text, again and again.</p>" * 3000 + "</article>"),
        (8, "u", "<" * 2000 + "a href='" * 3000),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("q"))
    got = {r.page_id: r for r in html_text.extract_pages(frame).collect()}
    assert got[1].text == "T & x\nOne, two.\nThree four."
    assert got[2].text == got[3].text == got[4].text == "" and got[2].n_chars == 0
    assert got[None].text == "plain text, no tags at all here." and got[7].text.count("\n") == 2999
    assert html_text.extract_pages(frame.limit(0)).count() == 0


def _open_elements(tags):
    """What is open after ``tags`` (start tags, or names with a slash), by walking the stack."""
    stack = []
    for tag in tags:
        if tag[0] == "/":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] == tag[1:]:
                    del stack[i:]
                    break
                if tag[1:] not in html_text.BLOCK and stack[i] in html_text.BLOCK:
                    break
            continue
        if tag in html_text._ENDS_P:
            block = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] in html_text.BLOCK), None)
            if block is not None and stack[block] == "p":
                del stack[block:]
        ends, within = html_text._IMPLIED.get(tag, ((), ()))
        container = max((i for i, x in enumerate(stack) if x in within), default=-1)
        behind = [i for i, x in enumerate(stack) if x in ends and i > container]
        if behind:
            del stack[behind[0] :]
        stack.append(tag)
    return stack


def test_html_open_elements_equal_a_walk():
    r = random.Random(3)
    names = ["div", "p", "li", "ul", "b", "a", "table", "tr", "td", "tbody", "dl", "dt", "dd", "span", "h1"]
    for _ in range(600):
        tags = [r.choice(["", "", "/"]) + r.choice(names) for _ in range(r.randint(1, 30))]
        page = "".join(f"<{t}>" for t in tags) + "<div id=x>"
        nodes, _ = html_text.parse(page)
        stack = _open_elements([*tags, "div"])
        path, at = [], len(nodes) - 1
        while at > 0:
            path.append(nodes[at].tag)
            at = nodes[at].parent
        assert path[::-1] == [x for x in stack if x in html_text.BLOCK], tags


def test_html_parses_broken_markup_in_linear_time():
    n = 200_000
    for page in ("<b>" * n + "</div>" * n, "<div>" * n + "<li>x" * n, "<b><div>" + "<i>" * n + "</b>" * n):
        began = time.monotonic()
        html_text.parse(page)
        assert time.monotonic() - began < 10


def test_html_keeps_text_of_formulas_and_fallbacks(spark):
    page = ("<html><body><nav><ul><li><a>m</a></li></ul></nav><article><h1>Title</h1><p>The energy is <math><mi>E</mi><mo>=</mo><mn>5</mn></math> here, as is known."
            "<noscript><p>Text without scripts, in full.</p></noscript><object><p>A <object>nested</object> table of values, in words.</p></object>"
            "<p>The end, after all of it.</article></body></html>")  # fmt: skip
    text = html_text.extract_pages(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first().text
    for kept in ("is E=5 here", "Text without scripts, in full.", "A nested table of values, in words.", "The end, after all of it."):
        assert kept in text, (kept, text)


def test_language_rows(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = language.identify_corpus(docs, pages)
    assert found.count() == docs.count() + pages.count()
    right = found.join(docs.select("doc_id", F.col("lang").alias("y")), "doc_id").agg(F.avg((F.col("lang") == F.col("y")).cast("int"))).first()[0]
    assert right > 0.97
    odd = pages.limit(0).unionByName(
        spark.createDataFrame([(1, None, None), (2, "no address", "<html lang=de>"), (None, "//h.example", "")], "page_id long, url string, html string")
    )
    rows = language.identify_corpus(edge_docs, odd).collect()
    assert len(rows) == 13 and all(r.lang in ("en", "de") and 0 < r.confidence <= 1 for r in rows)
    none = language.identify_corpus(no_docs, odd).collect()
    assert len(none) == 3 and all(r.lang is None and r.confidence == 0 for r in none)


def test_language_evidence_is_exact(spark):
    counts = language.language_counts(spark.createDataFrame([("x", "ab"), ("y", None), (None, "q")], "lang string, text string"))
    grams, starts = language._trigrams(["ab", ""])
    assert list(counts) == ["x", "y"] and counts["x"].sum() == 4 and counts["y"].sum() == 2
    assert starts.tolist() == [0, 4] and len(grams) == 6


def test_markup_and_addresses(spark):
    pages = [
        (1, "https://shop.example.co.uk/a", "<meta content='fr-FR' http-equiv=Content-Language><p>caf&eacute; &#x64;&amp;e <script>let x</script>", "fr", "example.co.uk", "caf\u00e9 d&e"),
        (2, "//www.example.com", '<html class=x LANG="de-AT"><b>na&iuml;ve', "de", "example.com", "na\u00efve"),
        (3, "http://u:p@Sub.Host.Example.DE:80/x", '<meta http-equiv="content-language" content="es">', "es", "example.de", ""),
        (4, "com.au", "plain", None, None, "plain"),
    ]
    rows = spark.createDataFrame([p[:3] for p in pages], "id long, url string, html string").select(
        "id", language.declared_language(F.col("html")).alias("said"),
        language.visible_text(F.col("html")).alias("text"), *language.address(F.col("url")),
    )
    for r, (_, _, _, said, domain, text) in zip(rows.orderBy("id").collect(), pages, strict=True):
        assert (r.said, r.domain, " ".join(r.text.split())) == (said, domain, text)


def test_language_posterior_equals_direct_sums(spark, small_docs):
    """Every number of the fusion again, on 60 rows in plain Python."""
    r = random.Random(5)
    labelled = [(d.lang, d.text) for d in small_docs.limit(40).collect()]
    hosts = [None, "a.x.de", "b.x.de", "y.fr", "z.co.uk", "one.alone.es"]
    rows = []
    for i, d in enumerate(small_docs.orderBy(F.desc("doc_id")).limit(60).collect()):
        host = r.choice(hosts)
        said = r.choice([None, None, "de", "fr", "xx"])
        text = r.choice([d.text, d.text[: r.randint(0, 40)], "", None])
        parts = (None, None) if host is None else (".".join(host.split(".")[-2:]), host.split(".")[-1])
        rows.append((i, text, said, host, *parts))
    frame = spark.createDataFrame(rows, "id long, text string, declared string, host string, domain string, suffix string")
    labels = spark.createDataFrame(labelled, "lang string, text string")
    got = {x.id: x for x in language.identify(frame, labels, ["id"]).collect()}

    langs, n = sorted({lang for lang, _ in labelled}), toxicity.SYMBOLS
    counts = {lang: np.zeros((n, n, n)) for lang in langs}
    for lang, text in labelled:
        codes = [0, 0, *toxicity._codes(text).tolist(), 0, 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            counts[lang][a, b, c] += 1

    def log_p(tri, a, b, c):
        uni = tri.sum((0, 1)) + 1.0
        p1 = uni[c] / uni.sum()
        p2 = (tri[:, b, c].sum() + 10 * p1) / (tri[:, b].sum() + 10)
        return math.log((tri[a, b, c] + 10 * p2) / (tri[a, b].sum() + 10))

    liks = []
    for _, text, *_ in rows:
        if not text:
            liks.append([0.0] * len(langs))
            continue
        codes = [0, 0, *toxicity._codes(text).tolist(), 0, 0]
        grams = list(zip(codes, codes[1:], codes[2:]))
        memo = {g: [log_p(counts[lang], *g) for lang in langs] for g in set(grams)}
        scale = min(len(grams), language.EFFECTIVE_TRIGRAMS) / len(grams)
        liks.append([scale * sum(memo[g][k] for g in grams) for k in range(len(langs))])
    guess = [None if not any(v) else max(range(len(langs)), key=lambda k: (v[k], -k)) for v in liks]

    def seen(at, value, skip):
        out = [0.0] * len(langs)
        for j, row in enumerate(rows):
            if j != skip and guess[j] is not None and (at is None or row[at] == value):
                out[guess[j]] += 1
        return out

    for i, row in enumerate(rows):
        every = seen(None, None, i)
        whole = seen(None, None, None)
        prior = [(v + 1) / (sum(whole) + len(langs)) for v in every]
        for at in (5, 4, 3):  # suffix, domain, host
            own = seen(at, row[at], i) if row[at] is not None else [0.0] * len(langs)
            prior = [(v + language.SMOOTHING * p) / (sum(own) + language.SMOOTHING) for v, p in zip(own, prior, strict=True)]
        trust = [0.0] * len(langs)
        if row[2] is not None:
            said = seen(2, row[2], i)
            trust = [math.log((v + (2.0 if row[2] == lang else 0.2)) / (w + language.SMOOTHING)) for v, lang, w in zip(said, langs, whole, strict=True)]
        score = [a + math.log(b) + c for a, b, c in zip(liks[i], prior, trust, strict=True)]
        best = max(range(len(langs)), key=lambda k: (score[k], -k))
        share = 1 / sum(math.exp(v - score[best]) for v in score)
        assert got[i].lang == langs[best], i
        assert abs(got[i].confidence - share) < 1e-3, i


def test_language_held_out(spark):
    """Languages of documents whose labels the counts have not seen."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = held_out(F.col("doc_id"), 5, 0)
    none = F.lit(None).cast("string")
    rows = docs.where(held & (F.length("text") > 0)).select(
        "doc_id", "text", none.alias("declared"), F.col("source").alias("host"), none.alias("domain"), none.alias("suffix")
    )
    found = language.identify(rows, docs.where(~held).select("lang", "text"), ["doc_id"])
    right = found.join(docs.select("doc_id", F.col("lang").alias("y")), "doc_id").agg(F.avg((F.col("lang") == F.col("y")).cast("int"))).first()[0]
    print("held-out language accuracy", right)
    assert right > 0.97


def test_quality_score_is_the_log_density_gap():
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.4).astype(int)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) + y[:, None] * 0.7
    shrink, diagonal = 0.1, 0.05
    model = quality.Discriminant.fit(x, y, shrink, diagonal)
    pooled = sum((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in (0, 1)) / len(x)
    dense = []
    for c in (0, 1):
        own = x[y == c]
        keep = (1 - shrink) * len(own) / (len(own) + 5)
        cov = keep * np.cov(own.T, bias=True) + (1 - keep) * pooled
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + (x.var(0).mean() * 1e-3 + 1e-6) * np.eye(5)
        away = x - own.mean(0)
        dense.append(math.log(len(own) / len(x)) - np.linalg.slogdet(cov)[1] / 2 - (away * np.linalg.solve(cov, away.T).T).sum(1) / 2)
    want = 1 / (1 + np.exp(dense[0] - dense[1]))
    assert np.allclose(model.scores(x), want, atol=1e-9)


def test_pii_query_columns_equal_the_patterns(spark):
    import hashlib

    from sessionflow.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.queries()["op8_pii"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        base = _brute_spans(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert set(listed) <= set(spans)
        order = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)
