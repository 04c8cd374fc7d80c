"""Length profile against brute force."""

import random

import numpy as np

from sparkpairs.operators import lengths


def literal_packing(ls, M):
    packed, cur = 0, 0
    for x in sorted(ls):
        if cur + min(x, M) <= M:
            cur += min(x, M)
        else:
            packed, cur = packed + 1, min(x, M)
    return packed + (cur > 0)


def hist(spark, ls):
    df = spark.createDataFrame([(int(x),) for x in ls], "length long")
    return lengths.length_histogram(df)


def test_packing_matches_literal_loop(spark):
    rng = random.Random(5)
    for case in range(6):
        M = rng.choice([16, 50, 768])
        ls = [rng.choice([0, rng.randint(1, M), rng.randint(1, 3 * M)]) for _ in range(rng.randint(1, 300))]
        r = lengths.packing_efficiency(hist(spark, ls), M).first()
        assert r.sequences_with_packing == literal_packing(ls, M), (case, M)
        assert r.sequences_without_packing == len(ls)


def test_truncation_curve(spark):
    rng = random.Random(1)
    ls = [rng.randint(1, 3000) for _ in range(500)]
    curve = {r.max_len: r for r in lengths.truncation_curve(hist(spark, ls)).collect()}
    grid = sorted(set(list(range(512, min(max(ls) + 512, 8192), 256)) + [768]))
    assert sorted(curve) == grid
    for m in grid:
        tt = sum(max(0, x - m) for x in ls)
        assert curve[m].truncated_tokens == tt
        assert curve[m].truncated_samples == sum(x > m for x in ls)
        assert abs(curve[m].truncation_percentage - tt / sum(ls) * 100) < 1e-9


def test_summary_matches_numpy(spark):
    rng = random.Random(2)
    ls = [rng.randint(1, 5000) for _ in range(777)]
    s = lengths.length_summary(hist(spark, ls)).first()
    a = np.array(ls)
    assert s.n == 777 and s.min_length == a.min() and s.max_length == a.max()
    assert abs(s.mean - a.mean()) < 1e-9 and abs(s.std - a.std()) < 1e-6
    assert abs(s.median - np.median(a)) < 1e-9
    assert abs(s.p95 - np.percentile(a, 95)) < 1e-9 and abs(s.p99 - np.percentile(a, 99)) < 1e-9


def test_bins_and_boxplot(spark):
    ls = list(range(1, 101)) + [1000]
    bins = lengths.length_bins(hist(spark, ls)).orderBy("bin").collect()
    assert len(bins) == 50 and sum(b.cnt for b in bins) == 101
    counts, _ = np.histogram(ls, bins=50)
    assert [b.cnt for b in bins] == list(counts)
    box = lengths.length_boxplot(hist(spark, ls)).first()
    q1, q3 = np.percentile(ls, [25, 75])
    assert box.n_outliers == 1 and box.whisker_hi == 100 and box.whisker_lo == 1
    assert abs(box.q1 - q1) < 1e-9 and abs(box.q3 - q3) < 1e-9


def test_optimal_and_advice(spark):
    ls = [100] * 90 + [2000] * 10
    h = hist(spark, ls)
    opt = lengths.optimal_max_length(lengths.truncation_curve(h)).first()
    grid = sorted(set(list(range(512, min(max(ls) + 512, 8192), 256)) + [768]))

    def brute(th):
        for m in grid:
            if sum(max(0, x - m) for x in ls) / sum(ls) * 100 <= th:
                return m
        return max(grid)

    assert (opt.optimal_1pct, opt.optimal_5pct) == (brute(1.0), brute(5.0))
    adv = lengths.length_advice(h).first()
    expected = "keep" if brute(1.0) == brute(5.0) == 768 else ("change" if brute(1.0) == brute(5.0) else "choose")
    assert adv.recommendation == expected
    goals = (adv.conservative_max_length, adv.balanced_max_length)
    assert adv.recommended_max_length == (adv.current_max_length if adv.current_max_length in goals else goals[1])
    # the configured length already meets the stricter goal: nothing else is recommended
    assert lengths.length_advice(h, goals[0]).first().recommended_max_length == goals[0]
    assert adv.packing_recommended == (adv.packing_improvement > 1.2)


def test_tokenizer_udf(spark):
    df = spark.createDataFrame([("a b c",), ("one two",)], "text string")

    def factory():
        return lambda texts: [len(t.split()) for t in texts]

    got = [r.length for r in lengths.token_lengths(df, "text", factory).collect()]
    assert got == [3, 2]


def test_single_value_and_empty(spark):
    one = hist(spark, [42] * 5)
    assert [b.cnt for b in lengths.length_bins(one).orderBy("bin").collect()][0] == 5
    s = lengths.length_summary(one).first()
    assert (s.n, s.std, s.median) == (5, 0.0, 42.0)
    assert lengths.packing_efficiency(one, 768).first().sequences_with_packing == 1
    empty = lengths.length_histogram(spark.createDataFrame([], "length long"))
    assert lengths.length_summary(empty).first().n is None
    assert lengths.truncation_curve(empty).count() == 1          # only the configured length
    assert lengths.packing_efficiency(empty, 768).first().with_packing is None


def packing_loop(values, m):
    packed = cur = 0
    for v in sorted(values):
        v = min(v, m)
        if cur + v <= m:
            cur += v
        else:
            packed, cur = packed + 1, v
    return packed + (cur > 0)


def test_packing_at_every_length_equals_the_loop(spark):
    rng = random.Random(4)
    for values in ([rng.randint(1, 3000) for _ in range(700)], [0] * 20 + [5] * 900 + [768] * 7 + [9000] * 40, [1], [0, 0]):
        h = hist(spark, values)
        sizes = [1, 7, 512, 768, 2048, 8192]
        grid = spark.createDataFrame([(m,) for m in sizes + [512]], "max_len long")
        got = {r.max_length: r for r in lengths.packing_report(h, grid).collect()}
        assert sorted(got) == sizes
        for m in sizes:
            tokens, n = sum(min(v, m) for v in values), packing_loop(values, m)
            assert (got[m].sequences_with_packing, got[m].sequences_without_packing) == (n, len(values))
            assert got[m].with_packing == (tokens / (n * m) if n else None) and got[m].without_packing == tokens / (len(values) * m)
    report = lengths.packing_at_advised_lengths(hist(spark, [600] * 50 + [3000]), 768).collect()
    assert {tuple(r[f"is_{u}"] for u in ("configured", "1pct", "5pct")) for r in report} == {(True, False, False), (False, True, False), (False, False, True)} \
        or sum(r.is_configured for r in report) == 1
    assert sum(r.is_1pct for r in report) == sum(r.is_5pct for r in report) == 1
