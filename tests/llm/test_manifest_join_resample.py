"""Operators 11 to 13 against brute force, their SQL and edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from sparkpairs.llm import chosen_path, merkle, resample
from sparkpairs.llm.ordered import numbered

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, _h double, part string, digest string, node string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, " \t\n", "one", "One", "one two", "ONE  two", "a b " * 5000, "a b " * 5000, "é É ünï 日本語 x", "tie tie", "tie tie",
         "word. Word, (word)! naïve café 12 ½ it's"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 4 else i, None if i % 4 == 0 else f"s{i % 3}", None, i, t, 0.5, "x", "y", "z") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (5, "s2", "en", 1, "other text of one id", 0.5, "x", "y", "z"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["op11_merkle", "op12_near_copies", "op13_resample"])
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ["documents", "benchmark"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    q = con.execute(E.oracle_sql()[name])
    at = [[d[0] for d in q.description].index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in q.fetchall())


def test_numbered_by_group_with_equal_keys(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else f"g{i % 3}", i // 50, "x") for i in range(300)], "g string, v int, _part string")
    got = numbered(df, [F.asc_nulls_first("g"), F.asc("v")], "pos", group="g", size="n").collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append((r.pos, r.v))
        assert r.n == 100 and r._part == "x"
    assert all(sorted(p for p, _ in rows) == list(range(100)) for rows in by.values())
    assert all([v for _, v in sorted(rows)] == sorted(v for _, v in rows) for rows in by.values())


# ---------------------------------------------------------------- 11
def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root, and for each leaf its levels of (left, right)."""
    paths = [[] for _ in nodes]
    of = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            run = of[i] // 16 * 16
            p.append(("".join(nodes[run:of[i]]), "".join(nodes[of[i] + 1:run + 16])))
        nodes = [H("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]
        of = [x // 16 for x in of]
    return nodes[0], paths


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    trees = []
    for g in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        members = sorted(groups[g], key=lambda m: m[:3])
        trees.append((members, *tree([m[2] for m in members])))
    root, top = tree([t[1] for t in trees])
    out = []
    for (members, subroot, paths), above in zip(trees, top, strict=True):
        for (_, _, d, r), path in zip(members, paths, strict=True):
            path = path + above
            folded = d
            if r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                folded = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text))
            for left, right in path:
                folded = H(left + folded + right)
            out.append((r.doc_id, d, subroot, root, H("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(map(repr, out))


def manifest(df):
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    p = merkle.proofs(df, {"text": F.when(tampered, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))})
    return sorted(repr(tuple(r)) for r in p.collect())


def test_manifest_of_odd_rows(odd, none):
    assert manifest(odd) == brute_manifest(odd.collect())
    assert manifest(none) == []
    one = odd.where("doc_id = 3")
    assert manifest(one) == brute_manifest(one.collect())


def test_manifest_of_more_rows_than_a_block(spark):
    n = merkle.BLOCK + 300  # one source spans two blocks, another one has a single row more than a run
    df = spark.range(n + 17).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, "a").otherwise("b").alias("source"),
                                    F.lit(None).cast("string").alias("lang"), F.col("id").alias("n_chars"), F.concat(F.lit("T"), "id").alias("text"))
    assert manifest(df) == brute_manifest(df.collect())


def test_manifest_of_more_groups_than_a_block(spark):
    df = spark.range(merkle.BLOCK + 5).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"),
                                              F.lit("x").alias("lang"), F.col("id").alias("n_chars"), F.lit("Same").alias("text"))
    assert manifest(df) == brute_manifest(df.collect())


# ---------------------------------------------------------------- 12
def shingle_set(text, width=2):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_near(rows):
    sets = [shingle_set(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    out = []
    for i, r in enumerate(rows):
        c = least.get(find(i))
        out.append((r.doc_id, len(sets[i]), c, None if r.doc_id is None or c is None else r.doc_id == c))
    return sorted(map(repr, out))


def near(df):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in chosen_path.link(df).collect())


def test_near_copies_of_odd_rows(odd, none):
    assert near(odd) == brute_near(odd.collect())
    assert near(none) == []


def crowd(rng, n, edits):
    """Copies of one text, each with some words replaced, around the threshold."""
    base = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, len(w), rng.integers(0, edits)):
            w[at] = f"v{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_crowds_and_strangers_lose_no_link(spark):
    rng = np.random.default_rng(5)
    texts = crowd(rng, 500, 14) + crowd(rng, 40, 30) + [" ".join(f"x{i}" for i in rng.integers(0, 400, 60)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    assert near(df) == brute_near(df.collect())


def test_trees_reach_the_target_recall():
    """Pairs exactly at the threshold meet in a branch of the stated depth as often as promised."""
    rng = np.random.default_rng(3)
    trees, pairs = 6, 400
    met = 0
    for _ in range(pairs):
        a = rng.integers(0, 2**16, chosen_path.TOKENS).astype(np.uint16)
        b = a.copy()
        b[rng.permutation(chosen_path.TOKENS)[:26]] ^= 1
        found = False
        for r in chosen_path.mix(rng.integers(0, 2**63, trees, dtype=np.uint64)):
            shared = np.array([r])
            for _ in range(chosen_path.DEPTH):
                kids = [set(chosen_path.branches(np.tile(x, (len(shared), 1)), shared, 80)[1].tolist()) for x in (a, b)]
                shared = np.array(sorted(kids[0] & kids[1]), np.uint64)
                if not len(shared):
                    break
            found |= bool(len(shared))
        met += found
    lost = 0.0
    for _ in range(chosen_path.DEPTH):
        lost = math.exp(lost - 1)
    assert abs(met / pairs - (1 - lost ** trees)) < 0.06
    assert lost ** chosen_path.trees_for(0.9999) <= 1e-4


def test_sketch_estimates_the_similarity():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, 400, dtype=np.uint64) for _ in range(60)]
    both = [np.concatenate([sets[0][:356], s[:44]]) for s in sets[1:]]  # 356 of 444 are shared: about 0.8
    sk = chosen_path.sketches(chosen_path.tokens([np.sort(sets[0]), *map(np.sort, both)])).view(np.uint64)
    d = chosen_path._differing(sk[:1], sk[1:])[0]
    assert (d <= chosen_path.most_differing(80)).all()
    far = chosen_path.sketches(chosen_path.tokens(sets)).view(np.uint64)
    assert (chosen_path._differing(far[:1], far[1:])[0] > chosen_path.most_differing(80)).all()


# ---------------------------------------------------------------- 13
def feature_words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def grams(words, n):
    return [b" ".join(words[i:i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute_resample(rows, target, s):
    def counts(texts):
        return Counter(zlib.crc32(g) % s.buckets for t in texts for g in grams(feature_words(t), s.max_n))

    c, t = counts(r.text for r in rows), counts(target)
    sum_s, sum_t = sum(c.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum_s + s.buckets) / ((c[b] + 1) * (sum_t + s.buckets)))) for b in range(s.buckets)]
    out = []
    for r in rows:
        w = feature_words(r.text)
        f = grams(w, s.max_n)
        weight = sum(gain[zlib.crc32(g) % s.buckets] for g in f)
        h = int(hashlib.sha256(f"{s.seed}:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([r.doc_id, len(w), len(f), weight, score, None])
    drawn = sorted((x for x in out if x[1] >= s.min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2]))
    for i, x in enumerate(drawn[:s.percent * len(drawn) // 100]):
        x[5] = i + 1
    return sorted(repr(tuple(x)) for x in out)


@pytest.mark.parametrize("max_n", [1, 3])
def test_resample_equals_brute_force(spark, odd, max_n):
    s = resample.ResampleSettings(max_n=max_n, buckets=500, min_words=3, percent=60)
    target = ["One two a b", None, "", "É b a"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted(repr(tuple(r)) for r in resample.resample(odd, bench, s).collect())
    assert got == brute_resample(odd.collect(), target, s)


def test_resample_of_empty_tables(odd, none):
    assert resample.resample(none, odd).count() == 0
    assert resample.resample(odd, none).count() == odd.count()


def test_parts_of_long_texts_count_like_the_whole(monkeypatch):
    text = ("Some words, of  a text that is cut " * 50).encode()
    want = Counter(map(zlib.crc32, grams(feature_words(text.decode()), 3)))
    for part in (7, 64, 1000):
        monkeypatch.setattr(resample, "PART", part)
        parts = list(resample.features(text, 3))
        assert sum((Counter(c) for _, c in parts), Counter()) == want and sum(n for n, _ in parts) == len(feature_words(text.decode()))


def test_gain_table_maps_every_byte():
    keep = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        assert resample.TABLE[b] == (low if low in keep else 32)


#: One row on a side: totals of the budget tree.
NESTED_LOOPS = {"op6_mixing"}


@pytest.mark.parametrize("name", ["op1_topk", "op2_chat_trees", "op5_simhash", "op6_mixing", "op11_merkle", "op12_near_copies", "op13_resample"])
def test_no_cartesian(spark, name):
    plan = E.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and ("NestedLoopJoin" not in plan or name in NESTED_LOOPS)


def test_features_are_counted_a_bounded_number_at_a_time(spark):
    """Distinct words of many short texts do not gather in a worker."""
    total = np.zeros(50, np.int64)
    resample._add(total, list(range(120)))
    assert total.tolist() == [3] * 20 + [2] * 30
    rows = [(" ".join(f"w{i}x{j}" for j in range(2000)),) for i in range(60)]  # more than COUNT_AT
    assert resample.COUNT_AT < 60 * 2000
    want = Counter(zlib.crc32(w.encode()) % 50 for (t,) in rows for w in t.split())
    s = resample.ResampleSettings(buckets=50)
    got = {r.bucket: r.n for r in resample.bucket_counts(spark.createDataFrame(rows, "text string"), s).collect()}
    assert got == want
