import math

import pytest
from pyspark.sql import functions as F

from chronoloom.llm import mixing as M
from chronoloom.llm.queries import tokenizer_path
from tests.conftest import rows

DOC = "doc_id bigint, source string, text string, id string, n_tokens string, repeats string"
TARGET = "source string, target_share double, max_repeats int"


def run(spark, docs, targets, **kw):
    d = spark.createDataFrame([(*x, "clash", "clash", "clash") for x in docs], DOC)
    t = spark.createDataFrame(targets, TARGET)
    return M.mix(d, t, id="doc_id", source="source", text="text", tokenizer=tokenizer_path(), **kw)


def some(n, start, source, words=20):
    return [(start + i, source, "word " * (words + i % 7)) for i in range(n)]


def test_token_counts_and_whole_texts(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("a b " * 50_000,), ("<|endoftext|>",)], "t string")
    got = [r["n_tokens"] for r in M.token_counts(df, "t", tokenizer_path()).collect()]
    assert got[:3] == [2, 0, 0] and got[3] >= 100_000 and got[4] > 1


def test_shares_and_caps(spark):
    docs = some(300, 0, "Big-Source") + some(40, 1000, "small_source ") + some(20, 2000, "rare") + [(5000, None, "x"), (5001, "big_source", None), (5002, "other", "x y"), (5003, "big_source", "")]
    chosen, shares = run(spark, docs, [("big_source", 0.6, 1), ("small_source", 0.3, 3), ("rare", 0.1, 4), ("absent", 0.0, 1)], docs_per_block=16)
    s = {r["source"]: r for r in shares.collect()}
    for name, want in (("big_source", 0.6), ("small_source", 0.3), ("rare", 0.1)):
        assert abs(s[name]["actual_share"] - want) < 0.01 and s[name]["most_repeats"] <= s[name]["max_repeats"]
    assert s["absent"]["documents"] == 0
    got = chosen.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and not {5000, 5001, 5002, 5003} & {r["doc_id"] for r in got}
    assert s["small_source"]["tokens"] == sum(r["n_tokens"] * r["repeats"] for r in got if r["source"] == "small_source")


def test_blocks_do_not_change_the_mix(spark):
    docs = some(120, 0, "a") + some(30, 500, "b")
    t = [("a", 0.5, 1), ("b", 0.5, 3)]
    picks = [rows(run(spark, docs, t, docs_per_block=n)[0], "doc_id", "repeats") for n in (1, 10, 10**6)]
    assert picks[0] == picks[1] == picks[2] and picks[0] != rows(run(spark, docs, t, seed=2)[0], "doc_id", "repeats")


def test_too_large_a_budget_flattens(spark):
    docs = some(100, 0, "a") + some(10, 500, "b")
    t = [("a", 0.2, 2), ("b", 0.8, 2)]
    total = sum(r["n_tokens"] for r in M.token_counts(spark.createDataFrame(docs, "i bigint, s string, t string"), "t", tokenizer_path()).collect())
    s = {r["source"]: r for r in run(spark, docs, t, budget_tokens=int(1.5 * total))[1].collect()}
    assert s["b"]["most_repeats"] <= 2 and s["b"]["weight"] < 0.8 and abs(s["a"]["weight"] + s["b"]["weight"] - 1) < 1e-9
    assert abs(s["b"]["weight"] * 1.5 * total - 2 * sum(r["n_tokens"] for r in M.token_counts(spark.createDataFrame(docs[100:], "i bigint, s string, t string"), "t", tokenizer_path()).collect())) < 2


def test_bisection():
    p, q = {"a": 0.9, "b": 0.1}, {"a": 0.5, "b": 0.5}
    assert M.mixture(p, q, 0.0)["a"] == pytest.approx(0.9) and M.mixture(p, q, 1.0)["a"] == pytest.approx(0.5)
    assert M.mixture(p, q, 0.5)["a"] == pytest.approx(3 / 4)  # p^0.5 normalised: ordinary temperature mixing
    a = M.bisect_exponent(p, q, entropy_at_least=0.6)
    assert M.entropy(M.mixture(p, q, a)) == pytest.approx(0.6, abs=1e-9)
    assert M.bisect_exponent(p, q, entropy_at_least=math.log(2) + 1) == 1.0


def test_empty_and_bounds(spark):
    chosen, shares = run(spark, [], [("a", 1.0, 1)])
    assert chosen.count() == 0 and rows(shares, "source", "actual_share", "documents") == [("a", 0.0, 0)]
    chosen, shares = run(spark, some(3, 0, "a"), [])
    assert chosen.count() == 0 and shares.count() == 0
    with pytest.raises(ValueError):
        run(spark, some(3, 0, "a"), [("a", 0.5, 1), ("b", 0.5, 1)], max_targets=1)
    chosen, _ = run(spark, some(9, 0, "a"), [("a", 1.0, None)])
    assert chosen.agg(F.max("repeats"), F.count("*")).first() == (1, 9)


def test_the_registered_mixes_bisect(spark, data):
    import os

    from chronoloom.llm import queries as Q

    data = data.replace("sf0.001", "sf0.01")
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    full = {r["source"]: r for r in Q.p8_shares(spark, data).collect()}
    for query in (Q.p8_budget, Q.p8_entropy):
        got = {r["source"]: r for r in query(spark, data).collect()}
        w = {s: r["weight"] for s, r in got.items() if r["weight"] > 0}
        assert sum(w.values()) == pytest.approx(1) and w.keys() == {s for s, r in full.items() if r["weight"] > 0}
        # Weights lie on the line from the natural shares to the targets, and at neither end.
        assert any(abs(w[s] - full[s]["weight"]) > 1e-4 for s in w)
        assert all(r["most_repeats"] <= r["max_repeats"] for r in got.values())
        if query is Q.p8_entropy:
            assert M.entropy(w) == pytest.approx(2.3, abs=1e-6)
        else:
            tokens = sum(r["tokens"] for r in got.values())
            assert any(r["tokens"] > 0.98 * r["weight"] * tokens and r["most_repeats"] == r["max_repeats"] for r in got.values())
    for query in (Q.p8_audit, Q.p8_audit_budget):
        for r in query(spark, data).collect():
            assert r["within_caps"] and r["on_weight"] and r["as_reported"]
