import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwick.llm import language_id, licence_scan, quality_rules, url_filter
from tarnwick.llm import textkernel as tk


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t.1", max_size=30)), max_size=12))
def test_token_kernel(texts):
    h, row = tk.token_hashes(pa.array(texts, pa.string()))
    import re

    words = [(w, r) for r, t in enumerate(texts) for w in re.split("[ \t\n\f\r]+", (t or "").lower()) if w]
    assert row.tolist() == [r for _, r in words]
    known = {}
    assert all(known.setdefault(w, x) == x for (w, _), x in zip(words, h.tolist()))
    assert len(set(known.values())) == len(known)
    assert tk.token_counts(pa.array(texts, pa.string())).tolist() == [sum(r == k for _, r in words) for k in range(len(texts))]


def test_language_on_held_out_text(spark, make_prose):
    rows = [(i, make_prose(lang, 60, i), lang) for i in range(60) for lang in ("en", "de", "fr")]
    net = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=400)
    held = [(i, make_prose(lang, 50, 1000 + i), lang) for i in range(20) for lang in ("en", "de", "fr")]
    held += [(99, "0123456789 9876 1234567 33 " * 20, "und"), (98, None, "und"), (97, "", "und")]
    out = language_id.identify(spark.createDataFrame(held, "doc_id long, text string, lang string"), net).collect()
    right = [r["lang_id"]["language"] == r["lang"] for r in out]
    assert sum(right) / len(right) > 0.95
    assert all(not r["lang_id"]["accepted"] and r["lang_id"]["language"] == "und" for r in out if r["doc_id"] in (97, 98, 99))


def test_every_label_becomes_a_class(spark, make_prose):
    rows = [(make_prose("en", 30, 0), "en")] * 300 + [(make_prose("en", 30, i), "en") for i in range(40)] + [(make_prose("fr", 30, 1), "fr"), (None, "xx"), ("text", None)]
    net = language_id.train(spark.createDataFrame(rows, "text string, lang string"), max_rows=4, steps=10)
    assert net.classes == ["en", "fr", "und"]


def test_a_long_text_is_read_a_slice_at_a_time(make_prose):
    net = language_id.ByteConvNet(["en", "und"], seed=1)
    text = make_prose("en", 5000, 3) + "é" * 7
    whole = language_id.scores(net, pa.array([text, "a", None]))
    import numpy as np

    old, tk.SLICE_BYTES = tk.SLICE_BYTES, 4 * language_id.WINDOW
    try:
        assert np.allclose(language_id.scores(net, pa.array([text, "a", None])), whole)
    finally:
        tk.SLICE_BYTES = old


def test_language_edges(spark, docs):
    net = language_id.train(docs, steps=30)
    out = language_id.identify(docs, net)
    assert out.count() == docs.count() and out.columns == [c for c in docs.columns]
    empty = language_id.train(docs.limit(0), steps=2)
    assert empty.classes == ["und"] and language_id.identify(docs.limit(0), empty).count() == 0


def test_network_agrees_with_a_plain_convolution():
    net = language_id.ByteConvNet(["a", "b"], seed=1)
    x, row, size = language_id.windows(pa.array(["Hello, wörld " * 30, "", None, "x"]))
    assert row.tolist() == [0, 0, 3] and size.sum() == len(("Hello, wörld " * 30).encode()) + 1
    import numpy as np

    for k in range(len(x)):
        want = []
        for c, b in zip(net.conv, net.bias):
            z = [sum(c[o][x[k, p + o]] for o in range(len(c))) + b for p in range(language_id.WINDOW)]
            want.append(np.maximum(np.max(z, 0), 0))
        assert net.pooled(x[k : k + 1])[0] == pytest.approx(np.concatenate(want), abs=1e-5)


def test_matching_statistics_by_brute_force():
    import random

    r = random.Random(2)
    texts = [[r.randrange(4) for _ in range(r.randint(1, 12))] for _ in range(5)]
    a = licence_scan.SuffixAutomaton(texts)
    runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(30):
        q = [r.randrange(5) for _ in range(20)]
        for k, (n, s) in enumerate(a.matching_statistics(q)):
            assert n == max((m for m in range(k + 2) if m == 0 or tuple(q[k + 1 - m : k + 1]) in runs), default=0)
            if n:
                own = {(t, e) for t, x in enumerate(texts) for e in range(n, len(x) + 1) if x[e - n : e] == q[k + 1 - n : k + 1]}
                assert own <= set(a.occurs[s])


def test_licence_scan(spark, docs):
    mit = licence_scan.TEMPLATES["MIT"]
    words = mit.split()
    rows = [(1, "intro text here. " + mit + " outro"), (2, " ".join(words[:20] + ["CHANGED"] + words[20:]).upper()), (3, "nothing to see"), (4, None), (5, ""), (6, " ".join(words[:10])), (6, "word " * 30_000 + mit), (None, mit)]
    found = licence_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("licence = 'MIT'").collect()
    assert sorted((r["doc_id"] or 0, r["coverage"]) for r in found) == [(0, 1.0), (1, 1.0), (2, 1.0), (6, 1.0)]
    assert {r["doc_id"]: r["start"] for r in found}[6] == 30_000
    assert licence_scan.scan(docs.limit(0)).count() == 0 and licence_scan.scan(docs, {}).count() == 0


def brute_chains(matches, gap):
    """The best chain of all, by looking at every pair of matches, again and again; spans found are not crossed."""
    out, taken, left = [], [], sorted(set(matches))
    while left:
        best = []
        for i, (a, b, n) in enumerate(left):
            top = (n, -1)
            for j, (x, y, m) in enumerate(left[:i]):
                over = max(0, x + m - a, y + m - b)
                if x < a and y < b and over < n and a - (x + m) <= gap and not any(x < e <= a for e in taken) and best[j][0] + n - over > top[0]:
                    top = (best[j][0] + n - over, j)
            best.append(top)
        k = max(range(len(left)), key=lambda i: (best[i][0], -i))
        chain = []
        while k >= 0:
            chain.append(left[k])
            k = best[k][1]
        out.append(chain[::-1])
        first, last = chain[-1][0], max(a + n for a, _, n in chain)
        taken.append(last)
        left = [x for x in left if x[0] + x[2] <= first or x[0] >= last]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 12), st.integers(1, 6)), max_size=25), st.integers(0, 8))
def test_chains_by_brute_force(matches, gap):
    assert sorted(licence_scan.chains(matches, gap)) == sorted(brute_chains(matches, gap))


def test_many_notices_in_one_text():
    import time

    notice = licence_scan.TEMPLATES["all-rights-notice"] + " "
    own = licence_scan.Scanner(licence_scan.TEMPLATES)
    began = time.perf_counter()
    for text in (notice * 10_000, (licence_scan.TEMPLATES["MIT"] + " ") * 300):
        found = own.scan(pa.array([text]))
        assert len(found) in (10_000, 300)
    assert time.perf_counter() - began < 30


def test_short_and_nested_templates():
    own = licence_scan.Scanner(licence_scan.TEMPLATES)
    found = own.scan(pa.array(["words. All rights reserved. more words", licence_scan.TEMPLATES["all-rights"], "all rights"]))
    assert sorted((r, own.names[k], a, b) for r, k, a, b, _ in found) == [(0, "all-rights-notice", 1, 4), (1, "all-rights", 0, 15), (1, "all-rights-notice", 0, 3)]
    nested = licence_scan.Scanner({"B": "p q r s", "A": "p q r s t u"})
    assert sorted(x[1:] for x in nested.scan(pa.array(["x p q r s t u y"]))) == [(0, 1, 5, 4), (1, 1, 7, 6)]


def test_decision_list():
    import numpy as np

    r = np.random.default_rng(0)
    x = {"a": r.random(600), "b": r.random(600)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["b"] > 0.93)
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(600, bool)
    for rule in rules:
        hit |= quality_rules.covers(rule, x)
    assert (hit == bad).mean() > 0.98
    assert quality_rules.learn(x, np.zeros(600, bool)) == [] and quality_rules.learn({}, np.zeros(0, bool)) == []
    assert quality_rules.learn({"a": np.zeros(0)}, np.zeros(0, bool)) == []


def test_quality_rules_in_spark(spark, docs, make_prose):
    rows = [(i, make_prose("en", 50, i) if i % 4 else "$$$ *** " * 30 + make_prose("en", 10, i), 1 if i % 4 else 0) for i in range(80)]
    own = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = own.select("doc_id", "quality").union(spark.createDataFrame([(None, 0), (3, None), (9999, 0)], "doc_id long, quality int"))
    rules = quality_rules.learn_from(own, labels)
    out = quality_rules.judge(own, rules).collect()
    assert all(r["keep"] == (r["quality"] == 1) for r in out)
    edge = {r["doc_id"]: (r["rule"], r["keep"]) for r in quality_rules.judge(docs.drop("n_chars"), rules).select("doc_id", "rule", "keep").collect()}
    assert edge[200] == (-1, False) and edge.keys() == {r["doc_id"] for r in docs.collect()}
    assert quality_rules.judge(docs.limit(0), []).count() == 0
    assert quality_rules.learn_from(docs.limit(0), labels) == []


def brute_learn(x, bad, seed=5):
    """learn() in plain Python: every threshold of every statistic is tried anew for each condition."""
    import math

    import numpy as np

    r, rules, left = np.random.default_rng(seed), [], np.arange(len(bad))
    holds = lambda c, i: x[c[0]][i] > c[2] if c[1] else x[c[0]][i] <= c[2]
    while bad[left].any() and not bad[left].all():
        mixed = r.permutation(left).tolist()
        kinds = [[i for i in mixed if bad[i]], [i for i in mixed if not bad[i]]]
        grow = [i for k in kinds for i in k[: -(-2 * len(k) // 3)]]
        prune = [i for k in kinds for i in k[-(-2 * len(k) // 3) :]]
        rule, own = [], grow
        while not all(bad[i] for i in own):
            base, best = math.log2(sum(bool(bad[i]) for i in own) / len(own)), (1e-9, None)
            for f in x:
                values = sorted({float(x[f][i]) for i in own})
                top = (-1.0, None)
                for above in (False, True):
                    top = (-1.0, None)
                    for a, b in zip(values, values[1:]):
                        hit = [i for i in own if holds((f, above, (a + b) / 2), i)]
                        p = sum(bool(bad[i]) for i in hit)
                        gain = p * (math.log2(p / len(hit)) - base) if p else -1.0
                        if gain > top[0] + 1e-12:
                            top = (gain, (f, above, (a + b) / 2))
                    if top[0] > best[0] + 1e-9:
                        best = top
            if best[1] is None:
                break
            rule.append(best[1])
            own = [i for i in own if holds(best[1], i)]
        if not rule:
            break

        def worth(k):
            hit = [i for i in prune if all(holds(c, i) for c in rule[:k])]
            p = sum(bool(bad[i]) for i in hit)
            return (2 * p - len(hit)) / len(hit) if hit else -1.0

        rule = rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]
        hit = [i for i in left if all(holds(c, i) for c in rule)]
        if len(hit) < 3 or sum(bool(bad[i]) for i in hit) / len(hit) < 0.95:
            break
        rules.append(tuple(rule))
        left = np.array([i for i in left if i not in set(hit)], int)
    return rules


def test_learning_by_brute_force():
    import numpy as np

    found = 0
    for seed in range(5):
        r = np.random.default_rng(seed)
        x = {"a": np.round(r.random(120), 2), "b": np.round(r.random(120), 1), "c": r.random(120)}
        bad = ((x["a"] > 0.7) & (x["b"] < 0.6)) | (x["c"] > 0.9)
        got = [tuple((c.feature, c.above, c.threshold) for c in rule) for rule in quality_rules.learn(x, bad)]
        assert got == [tuple((f, above, pytest.approx(t)) for f, above, t in rule) for rule in brute_learn(x, bad)]
        found += len(got)
    assert found >= 3


def test_a_contradicting_label_counts_as_bad(spark):
    docs = spark.createDataFrame([(k, "word " * 20 if k % 2 else "#### " * 20, 1) for k in range(60)], "doc_id long, body string, rule int")
    labels = docs.selectExpr("doc_id", "doc_id % 2 as quality").union(docs.selectExpr("doc_id", "1"))
    rules = quality_rules.learn_from(docs, labels, text_col="body")
    assert {r["doc_id"] % 2 for r in quality_rules.judge(docs, rules, "body").where("keep").collect()} == {1}
    assert quality_rules.learn_from(docs, labels.limit(0), text_col="body") == []


def test_statistics(spark):
    row = quality_rules.statistics(spark.createDataFrame([("AB| 1!\nab ab",)], "text string")).first()["stats"]
    assert (row["chars"], row["words"], row["distinct_words"]) == (12, 4, 0.75)
    assert [round(row[k] * 12) for k in ("breaks", "bars", "bangs", "capitals", "digits", "symbols")] == [1, 1, 1, 2, 1, 0]


@pytest.mark.parametrize(("pattern", "url", "hit"), [
    ("||ads.example^", "http://x.ads.example/a", True), ("||ads.example^", "http://badads.example/a", False), ("/pixel.gif|", "http://a/pixel.gif", True), ("/pixel.gif|", "http://a/pixel.gifs", False),
    ("|http://a", "http://a.b", True), ("|http://a", "x|http://a", False), ("/a*b^", "http://h/a123b", True), ("", "http://a", False), ("x+y", "http://X+Y/", True),
])
def test_patterns(pattern, url, hit):
    import re

    rule = url_filter.compile_rule(0, pattern)
    assert bool(re.search(rule.regex, url.lower())) == hit
    assert not hit or set(rule.tokens) <= set(re.findall(url_filter.TOKEN, url.lower()))


def test_url_filter_against_all_rules(spark):
    import re

    rules = url_filter.compile_rules((*url_filter.DEFAULT_RULES, "||site.com^", "@@/good/", "*", "a"))
    urls = [(i, u) for i, u in enumerate(["http://site.com/ads/1", "http://site.com/good/ads/", "http://x.org/", None, "", "HTTP://CASINO/A", "not a url", "http://a.b/" + "long/" * 20_000 + "ads/x"])]
    df = spark.createDataFrame([*urls, urls[0], (None, "http://x.org/")], "page_id long, url string")
    index = url_filter.rarest_tokens(df.selectExpr("lower(url) as u"), url_filter.compile_rules(("/good/ads/", "||site.com^", "*")))
    assert {t: [r.rule_id for r in own] for t, own in index.items()} == {"good": [0], "site": [1], None: [2]}
    got = {(r["page_id"], r["url"]): (r["blocked"], r["rules"]) for r in url_filter.filter_urls(df.selectExpr("*", "1 token", "2 regex", "3 rule_id"), rules).collect()}
    assert len(got) == len(urls) + 1 and url_filter.filter_urls(df, rules).count() == len(urls) + 2
    for (_, u), (blocked, found) in got.items():
        hits = [r for r in rules if u is not None and re.search(r.regex, u.lower())]
        assert found == [r.rule_id for r in hits] and blocked == (any(r.block for r in hits) and all(r.block for r in hits))
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
    assert not any(r["blocked"] for r in url_filter.filter_urls(df, []).collect())
