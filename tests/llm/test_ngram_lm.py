import math
import random
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tarnwick.llm import ngram_lm, queries
from tarnwick.llm import textkernel as tk


def brute(texts, alpha=0.5):
    """log_prob and longest context of every text, by counts of all grams of the others."""
    words, out = [t.lower().split() for t in texts], []
    for own, w in enumerate(words):
        others = [x for k, x in enumerate(words) if k != own]
        grams = {}
        for x in others:
            for i in range(len(x)):
                for j in range(i + 1, len(x) + 1):
                    grams[tuple(x[i:j])] = grams.get(tuple(x[i:j]), 0) + 1
        logs, longest = 0.0, 0
        for j, token in enumerate(w):
            p, k = max(grams.get((token,), 0), 1) / (sum(map(len, others)) + 1), 0
            while k < j and grams.get(tuple(w[j - k - 1 : j]), 0):
                k += 1
            if k:
                p = (grams.get(tuple(w[j - k : j + 1]), 0) + alpha * p) / (grams[tuple(w[j - k : j])] + alpha)
            logs, longest = logs + math.log(p), max(longest, k)
        out.append((len(w), pytest.approx(logs), longest))
    return out


@pytest.mark.parametrize("more", [{}, {"shard_tokens": 60, "bucket_runs": 50}])
def test_each_text_by_the_others(spark, more):
    r = random.Random(5)
    base = [r.choice("abcdef") for _ in range(70)]
    texts = [" ".join(base), " ".join(base), " ".join(base[5:60]), " ".join([*base[:33], "Z", *base[33:]]), " ".join([*base[20:50], "y", *base[20:50]])]
    texts += ["q " * 40, "q " * 23, "never seen", "B", "c"] + [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 40))) for _ in range(8)]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(98, None, 1), (99, "", 1), (97, " \n", 1)]
    got = {x["doc_id"]: (x["n_tokens"], x["log_prob"], x["longest_context"]) for x in ngram_lm.score_each(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3), **more).collect()}
    want = brute(texts)
    assert sorted(got) == list(range(len(texts)))
    for k, x in enumerate(want):
        assert got[k] == x


def test_packed_hashes():
    for h in ([5], [1, 2, 3], [0, 2**48 - 1, 2**63], [7, 2**48 + 6], [0, 2**64 - 1]):
        a = np.array(h, np.uint64)
        assert ngram_lm.unpacked_hashes(ngram_lm.packed_hashes(a)).tolist() == h


def test_a_long_text_that_others_have(spark):
    """20,000 words, which the corpus holds whole, in part and with changes."""
    r = random.Random(9)
    words = [f"w{r.randrange(300)}" for _ in range(20_000)]
    changed = list(words)
    for k in range(50, 20_000, 997):
        changed[k] = f"new{k}"
    rows = [(0, " ".join(words)), (1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[4000:9000]))]
    got = {x["doc_id"]: x for x in ngram_lm.score_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["longest_context"] == got[1]["longest_context"] == 19_999 and got[0]["log_prob"] == got[1]["log_prob"]
    assert got[2]["longest_context"] == 996 and got[3]["longest_context"] == 4999


def test_scores_of_one_text_none_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    assert [x["doc_id"] for x in ngram_lm.score_each(df).collect()] == [1, 1]
    assert ngram_lm.score_each(df.limit(0)).count() == 0
    assert ngram_lm.score_each(df.limit(1)).first()["log_prob"] == 0.0


def test_op9_scores_the_documents(spark, tmp_path):
    docs = spark.createDataFrame([(7, "a b c"), (8, "a b d")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(x[0] for x in queries.op9_lm_scoring(spark, str(tmp_path)).collect()) == [7, 8]


def test_a_round_works_out_once_what_it_asked_for(monkeypatch):
    texts = ["a b c a b d e a b", "b c a b d e a", "e a b a b d e"]
    hashes, row = tk.token_hashes(pa.array(texts))
    shard = ngram_lm.Shard([0, 1, 2], np.bincount(row).astype(np.int64), hashes)
    known, calls = ngram_lm.Known(shard), []
    plain = ngram_lm.Shard._asked
    monkeypatch.setattr(ngram_lm.Shard, "_asked", lambda self, known: calls.append(1) or plain(self, known))
    for _ in ngram_lm.ROUNDS:
        h, n = ngram_lm._request(shard, known)
        assert (h[1:] > h[:-1]).all()
        told = pa.table({"kind": pa.array([0, 1], pa.int32()), "bucket": pa.array([0, 0], pa.int32()), "data": pa.array([ngram_lm._pack(known), ngram_lm._pack(n.astype(np.uint32))], pa.binary())})
        calls.clear()
        out = ngram_lm._take((pa.scalar(0),), pa.table({"shard": [0], "texts": pa.array([ngram_lm._pack(shard)], pa.binary())}), told)
        assert len(calls) == 1
        known = ngram_lm._unpack(out.column("state")[0].as_py())


def test_shuffle_files_go_with_their_round(spark, monkeypatch):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        x = blocks.getAllBlocks()
        return {n for n in (x.apply(k).name() for k in range(x.length())) if n.startswith("shuffle_")}

    before, left = files(), []

    def look():
        end = time.time() + 5
        while files() - before and time.time() < end:
            time.sleep(0.1)
        left.append(len(files() - before))

    monkeypatch.setattr(ngram_lm, "gc", SimpleNamespace(collect=look))  # called after each write, before the driver's garbage is collected
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(setting)
    ngram_lm.score_each(spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string").repartition(2))
    assert len(left) > len(ngram_lm.ROUNDS) and not any(left)
    assert spark.conf.get(setting) == old


def test_what_two_copies_ask_for_is_little():
    """Disk of a round is what it asks for: lengths up to DENSE for all, then only where copies part."""
    r = random.Random(3)
    words = [f"w{r.randrange(300)}" for _ in range(3000)]
    hashes, row = tk.token_hashes(pa.array([" ".join(words), " ".join(words), " ".join(words[:1000])]))
    shard = ngram_lm.Shard([0, 1, 2], np.bincount(row).astype(np.int64), hashes)
    known, asked = ngram_lm.Known(shard), 0
    for _ in ngram_lm.ROUNDS:
        h, n = ngram_lm._request(shard, known)
        asked += len(h)
        shard.answer(known, n.astype(np.int64))
    assert asked < 4 * len(words)
    _, search = shard.deep(known)
    assert len(search.doubling[0]) < 20


def test_argsort():
    r = np.random.default_rng(1)
    near = (np.uint64(1) << np.uint64(63)) + r.integers(0, 9, 500).astype(np.uint64)
    for key in (near, np.r_[near[:40], r.integers(0, 2**63, 5000, dtype=np.uint64)], r.integers(0, 2**20, 3000), np.zeros(1, np.uint64), near[:0]):
        assert (key[ngram_lm._argsort(key)] == np.sort(key)).all()
