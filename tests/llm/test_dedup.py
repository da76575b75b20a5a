import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import exact_dedup, mixing, simhash, substring_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, *more):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *[0] * len(more)) for i, t, s in rows], ", ".join([SCHEMA, *[f"{c} int" for c in more]]))


def mixed(seed=0, n=300):
    rng = random.Random(seed)
    pool = ["", "a", "é" * 40, "ab" * 33, "x" * 64, "x" * 65, "x" * 128, "y" + "x" * 127] + ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    return [(i, rng.choice([None, *pool]), "s") for i in range(n)]


@pytest.mark.parametrize(("block", "salts"), [(16, 1), (16, 4), (3, 7), (16384, 32)])
def test_exact_groups_against_brute_force(spark, block, salts):
    rows = mixed()
    found = exact_dedup.exact_groups(documents(spark, rows, "uid", "block", "level", "name"), block_bytes=block, salts=salts).collect()
    texts = {i: t or "" for i, t, _ in rows}
    same = {}
    for i, t in texts.items():
        same.setdefault(t, []).append(i)
    assert len(found) == len(rows)
    for r in found:
        group = same[texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), r.doc_id == max(group))
        assert r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_exact_ties_nulls_and_empty(spark):
    df = documents(spark, [(1, "a", "s"), (1, "a", "s"), (None, "a", "s"), (None, None, "s"), (2, "long" * 20_000, "s"), (3, "long" * 20_000, "s")], "copy")
    found = exact_dedup.exact_groups(df, block_bytes=64).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in found) == sorted([("1", "1", 3, True), ("1", "1", 3, False), ("None", "1", 3, False), ("None", "None", 1, True), ("2", "3", 2, False), ("3", "3", 2, True)])
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns and kept.count() == 3
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0 and exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_mixing_rates_and_repeats(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else None) for i in range(6000)]
    df = documents(spark, rows, "copy", "source2")
    out = mixing.poisson_mix(df, weights={"hot": 1.0, None: 3.0, "absent": 9.0}, rows=8000).toPandas()
    assert sorted(out.columns) == sorted(df.columns)
    share = out["source"].isna().mean()
    assert abs(len(out) - 8000) < 400 and abs(share - 0.75) < 0.02
    times = out.groupby("doc_id").size().reindex(range(6000), fill_value=0)
    hot = times[[i % 3 != 0 for i in range(6000)]]
    assert abs(hot.mean() - 0.5) < 0.05 and abs(hot.var() - 0.5) < 0.08  # Poisson: the variance is the mean
    assert (out.groupby("doc_id")["copy"].max() == out.groupby("doc_id").size()).all()
    again = mixing.poisson_mix(df.repartition(7), weights={"hot": 1.0, None: 3.0}, rows=8000).toPandas()
    assert sorted(zip(again.doc_id, again["copy"])) == sorted(zip(out.doc_id, out["copy"]))
    assert list(out.doc_id) != sorted(out.doc_id)


def test_mixing_at_high_rates(spark):
    docs = spark.createDataFrame([(k, "x", "rare" if k == 0 else "often") for k in range(40)], "doc_id bigint, text string, source string")
    found = dict(tuple(r) for r in mixing.poisson_mix(docs, weights={"rare": 1.0, "often": 1.0}, rows=200_000).groupBy("source").count().collect())
    assert abs(found["rare"] - 100_000) < 2_000 and abs(found["often"] - 100_000) < 2_000


def test_mixing_edges(spark):
    assert mixing.poisson_mix(documents(spark, []).limit(0)).count() == 0
    same = documents(spark, [(None, None, "a")] * 3 + [(5, "x", "b")] * 2)
    n = {r["doc_id"]: r["n"] for r in mixing.poisson_mix(same, rows=500).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n[None] % 3 == 0 and n[5] % 2 == 0
    one = documents(spark, [(1, "x", "a")])
    big = mixing.poisson_mix(one, rows=20_000).count()  # a rate that a double's exponential can't hold
    assert abs(big - 20_000) < 1000
    assert mixing.poisson_mix(one, weights={}).count() == 0


def brute_components(fps):
    values = np.array(fps, np.uint64)
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(values)):
        for b in np.flatnonzero(np.bitwise_count(values[a + 1 :] ^ values[a]) <= 4) + a + 1:
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(values))]


def near_fingerprints(seed, n, spread):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 12))]
    out = []
    for _ in range(n):
        x = rng.choice(centres)
        for k in rng.sample(range(64), rng.randint(0, spread)):
            x ^= 1 << k
        out.append(x)
    return out


@pytest.mark.parametrize(("seed", "spread", "block"), [(0, 4, 4096), (1, 3, 5), (2, 8, 2), (3, 2, 3)])
def test_components_against_brute_force(spark, seed, spread, block):
    fps = sorted(set(near_fingerprints(seed, 250, spread)))
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) * 2 for f in fps], "node bigint, w0 bigint").repartition(3)
    found = {r.node: r.root for r in simhash.components(simhash._links(table, block, simhash.RULE_BITS)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    root = brute_components(fps)
    for a in range(len(fps)):
        group = [signed[b] for b in range(len(fps)) if root[b] == root[a]]
        assert found.get(signed[a], signed[a]) == (min(group) if len(group) > 1 else signed[a])


def test_linked_fingerprints_share_a_key():
    rng = random.Random(5)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randint(1, 4)):
            b ^= 1 << k
        keys, owner = simhash.pair_keys(np.array([a, b], np.uint64).view(np.int64))
        assert set(keys[owner == 0]) & set(keys[owner == 1])


def test_codewords():
    parity, errors, many = simhash._golay_errors()
    assert set(many) <= {1, 6} and (many == 6).sum() == 1771  # perfect: three errors have five words of four beside them
    words = (np.arange(4096) << 11) | parity
    gaps = np.bitwise_count(words[1:] ^ words[0])
    assert gaps.min() == 7


def brute_fingerprint(text):
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "A b C", "É a\x0bB\x0cc d e", "the cat sat on the mat " * 9, "x " * 70_000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_near_duplicates(spark):
    base = "w1 w2 w3 w4 w5 w6 w7 w8 w9".split() * 30
    base = [f"{w}{k}" for k, w in enumerate(base)]
    near = [*base[:-1], "other"]
    rows = [(9, " ".join(base), "s"), (4, " ".join(near), "s"), (7, " ".join(base), "s"), (1, None, "s"), (2, "", "s"), (3, "something else entirely is written here", "s"), (4, " ".join(near), "s"), (None, " ".join(base), "s")]
    df = documents(spark, rows, "component_id", "fp")
    out = simhash.near_duplicates(df).collect()
    near_bits = bin(brute_fingerprint(" ".join(base)) ^ brute_fingerprint(" ".join(near))).count("1")
    assert near_bits <= 4
    assert {(r.doc_id, r.component_id) for r in out} == {(9, 4), (4, 4), (7, 4), (1, 1), (2, 1), (3, 3), (None, 4)} and len(out) == 8
    assert {r.doc_id: r.fingerprint for r in out}[1] == "0" * 16
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_near_dedup_drops_rows_not_ids(spark):
    texts = ["".join(f"{t}{k} " for k in range(60)) for t in "abcd"]
    rows = [(2, texts[0], "s"), (5, texts[0], "s"), (None, texts[0], "s"), (5, texts[1], "s"), (8, texts[1], "s"), (None, texts[2], "s"), (None, texts[3], "s"), (None, texts[3], "s")]
    for df in (documents(spark, rows, "uid"), documents(spark, rows).repartition(3).cache()):
        kept = simhash.near_dedup(df)
        assert kept.columns == df.columns
        assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("2", texts[0]), ("5", texts[1]), ("None", texts[2]), ("None", texts[3])])


def jaccard(a, b, size=5):
    x, y = ({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_near_dedup_by_jaccard(spark):
    """Pairs of any similarity: those well above 0.8 are found, those well below are left alone, and of those at 0.8 or more hardly any is lost."""
    rng = random.Random(8)
    rows, pairs = [], []
    for k in range(240):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        other = edited(base, rng, rng.randint(0, 1 + len(base) // 25))
        rows += [(2 * k, " ".join(base), "s"), (2 * k + 1, " ".join(other), "s")]
        pairs.append(jaccard(rows[-2][1], rows[-1][1]))
    kept = {r.doc_id for r in simhash.near_dedup(documents(spark, rows)).collect()}
    assert {2 * k for k in range(240)} <= kept
    gone = [2 * k + 1 not in kept for k in range(240)]
    assert all(g for g, j in zip(gone, pairs) if j >= 0.88) and not any(g for g, j in zip(gone, pairs) if j < 0.7)
    near = [g for g, j in zip(gone, pairs) if j >= 0.8]
    assert len(near) > 80 and sum(near) / len(near) >= 0.93


def test_one_large_group_of_near_copies(spark):
    """Thousands of different near copies of one text, in keys that are dealt out in blocks, leave one row."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows = [(k, " ".join(edited(base, rng, 2)), "s") for k in range(1200)] + [(5000, " ".join(base[::-1]), "s")]
    for block in (4096, 64):
        assert sorted(r.doc_id for r in simhash.near_dedup(documents(spark, rows).repartition(5).cache(), block=block).collect()) == [0, 5000]


def test_wide_fingerprints():
    text = "the cat sat on the mat and saw a dog " * 40_000
    found = simhash.wide_fingerprint(text, 5, 16)
    hashes = np.unique(simhash.shingle_hashes(text, 5))
    spread = simhash._spread(hashes, 16)
    bits = np.unpackbits(spread.view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little").sum(0) * 2 > len(hashes)
    assert (np.unpackbits(found.view(np.uint8), bitorder="little") == bits).all()
    assert not simhash.wide_fingerprint(None, 5, 16).any() and (simhash.wide_fingerprint("One  two", 5, 4) == simhash.wide_fingerprint("one two", 5, 16)[:4]).all()


def test_hot_keys_join_like_others(spark):
    from loomgrid.llm.common import join_counted

    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 7, id) as k", "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.col("k") * 2)
    found = join_counted(rows, table, "k")
    assert found.columns == ["k", "id", "m"] and found.count() == 5000 and found.where("m != k * 2").isEmpty()


def test_units():
    text = "a b c d e\n short \nOne two three four five six seven eight. Nine ten eleven twelve thirteen fourteen fifteen sixteen."
    found = list(substring_dedup.units(text))
    assert [text[a:b] for a, b, _ in found] == ["a b c d e", " short ", text.split("\n")[2], "One two three four five six seven eight.", "Nine ten eleven twelve thirteen fourteen fifteen sixteen."]
    assert [text[a:b] for a, b, _ in substring_dedup.units(text, line_words=5, sentence_words=99)] == ["a b c d e", text.split("\n")[2]]
    assert list(substring_dedup.units(None)) == [] == list(substring_dedup.units(""))
    assert substring_dedup.without("ab\ncd\nef", [(3, 5)]) == "ab\nef" and substring_dedup.without("abcdef", [(1, 3), (2, 4)]) == "aef"


def test_substring_against_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randint(3, 9))) + "." for _ in range(25)]
    rows = [(rng.randint(0, 40) if k else None, None if k == 5 else "\n".join(rng.choice(["", " "]) + " ".join(rng.choice(pool) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 6))), "s") for k in range(80)]
    df = documents(spark, rows, "digest", "start", "uid").coalesce(1)
    found = {(r.uid, r.start, r.end) for r in substring_dedup.removed_units(df).collect()}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, wanted = {}, set()
    for k in order:
        for start, end, unit in sorted(substring_dedup.units(rows[k][1])):
            seen.setdefault(unit, []).append((k, start, end))
    for places in seen.values():
        wanted |= set(places[1:])
    ids = {r["u"]: r["k"] for r in df.withColumn("u", F.monotonically_increasing_id()).withColumn("k", F.monotonically_increasing_id()).select("u", "k").collect()}
    assert {(ids[u], a, b) for u, a, b in found} == wanted
    out = substring_dedup.dedup_units(df)
    assert out.count() == 80 and "removed_spans" in out.columns
    texts = [t if t is None else substring_dedup.without(t, [(a, b) for u, a, b in wanted if u == k]) for k, (_, t, _) in enumerate(rows)]
    assert sorted(map(str, texts)) == sorted(str(r.text) for r in out.collect())
    assert substring_dedup.removed_units(df.limit(0)).count() == 0
