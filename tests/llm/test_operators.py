"""The training-data operators against brute force, on small fixtures with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadtime.llm import common, components, fingerprint, jaccard_join, mixing, neighbours, packing, quality, queries, secrets, sharding, shingles, toxicity, url_filter

WORDS = [a + b for a in "ka lo mi nu pe ra so tu vi xa".split() for b in "den fog hal jin kom lur mar nis pol qur".split()]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, n int, sid string, kind int, rank int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(3, 120)) for _ in range(60)]
    texts = list(base)
    for t in base[:25]:  # near copies, some beyond the limit
        words = t.split(" ")
        for _ in range(rng.randint(1, 3)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    texts += [base[0]] * 30 + [base[1].upper(), None, "", "  \n\t ", "one", "one two", "One TWO", "é ü ß 中文 text here", prose(rng, 4000)]
    passage = prose(rng, 40)
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(20)]
    return texts


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", f"src{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or ""), "x", 1, "s", 2, 3) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def linked(texts, ids, percent=80):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, d in enumerate(ids)]


def test_shingles_equal_brute_force():
    texts = corpus()
    got = list(shingles.shingle_sets(pa.array(texts).slice(2)))
    seen = {}
    for t, s in zip(texts[2:], got):
        own = shingle_set(t)
        assert len(own) == len(s) and (np.diff(s.astype(object)) > 0).all()
        assert seen.setdefault(frozenset(own), s.tobytes()) == s.tobytes()
    assert len({s.tobytes() for s in got}) == len(seen)
    assert list(shingles.shingle_sets(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("short, block", [(64, 1_500_000), (3, 1_500_000), (3, 40), (64, 90)])
def test_jaccard_components(spark, monkeypatch, short, block):
    monkeypatch.setattr(jaccard_join, "SHORT", short)  # 3: most columns are long or marked ones
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # 40: groups fall into many tiles
    texts = corpus()
    ids = [900 - 3 * i for i in range(len(texts))]
    ids[70:73] = [None, None, ids[5]]
    got = jaccard_join.jaccard_components(frame(spark, texts, ids)).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r[:3])
    assert sorted(map(key, got)) == sorted(map(key, linked(texts, ids)))


def test_jaccard_edges(spark):
    empty = frame(spark, ["a"]).filter("false")
    assert jaccard_join.jaccard_components(empty).count() == 0 and jaccard_join.one_of_each(empty).count() == 0
    df = frame(spark, ["a b c d e f", "a b c d e f", None, "a b c d e f", "z"], [4, 4, 5, 2, 9])
    left = jaccard_join.one_of_each(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 5, 9]
    doubled = frame(spark, ["a b c d e f", "a b c d e f", "q w e r t y"], [1, 1, 3])
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(doubled).collect()) == [1, 3]


@pytest.mark.parametrize("chunk", [components.CHUNK, 7])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(4)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7), (None, 3)]
    edges += [(5000, x) for x in range(4000, 4300)] + [(2000 - i, 2001 + i) for i in range(30)] + [(2000 - i, 2002 + i) for i in range(30)]  # a hub, and a long path
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = components.connected_components(df).collect()
    root = {}

    def top(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    assert len(got) == len(root) and dict(map(tuple, got)) == {v: top(v) for v in root}
    assert components.connected_components(df.filter('false')).count() == 0


def test_fingerprints(spark):
    texts = corpus()
    ids = [5 * i for i in range(len(texts))]
    rows = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(frame(spark, texts, ids), rows_per_range=13).collect()}
    assert len(rows) == len(texts)
    order = sorted(ids, reverse=True)
    text = {i: t or "" for i, t in zip(ids, texts)}
    errors = []
    for k, i in enumerate(order):
        own, after = text[i], text[order[(k + 1) % len(order)]]
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        for other, got in ((edited, r["near_edited"]), (after, r["near_next"])):
            a, b = shingle_set(own), shingle_set(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            errors.append(abs(exact - got))
            if len(a | b) <= fingerprint.K:
                assert got == pytest.approx(exact)
        assert r["n_shingles"] == pytest.approx(len(shingle_set(own)), rel=0.35)
    assert max(errors) < 0.2
    assert len({r["fingerprint"] for r in rows.values()}) == len({frozenset(shingle_set(t)) for t in texts})
    odd = frame(spark, ["x", None, "y"], [None, 1, 1])
    assert fingerprint.edited_fingerprints(odd).count() == 3 and fingerprint.edited_fingerprints(odd.filter("false")).count() == 0


def test_sketches_merge(spark):
    rng = random.Random(3)
    a, b = prose(rng, 700), prose(rng, 500)
    sets = list(shingles.shingle_sets(pa.array([a, b, a + " . " + b])))
    sa, sb = fingerprint.sketch(sets[0]), fingerprint.sketch(sets[1])
    both = fingerprint.merge(sa, sb)
    union = fingerprint.sketch(np.union1d(sets[0], sets[1]))
    assert (both == union).all() and (fingerprint.decode(fingerprint.encode(sa)) == sa).all()
    assert fingerprint.containment(sa, both) > 0.85 and fingerprint.resemblance(sa, sa) == 1
    prints = fingerprint.fingerprints(frame(spark, [a, b, None])).withColumn("g", F.lit(1))
    assert fingerprint.merged(prints, ["g"]).first()["fingerprint"] == fingerprint.encode(union)


def test_sharding(spark):
    rng = random.Random(2)
    rows = [(i if i % 50 else None, rng.choice([None, "", "t" * (i % 9), "ü"]), "en", "hot" if i % 3 else rng.choice(["a", "b", None]), 0, "x", 1, "s", 2, 3) for i in range(2000)]
    rows += rows[:7]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS), 24).collect()
    count = collections.Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and set(count) == set(range(24)) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s]))
    for source in ("hot", "a", "b", None):
        own = collections.Counter(r["shard"] for r in got if r["source"] == source)
        assert all(abs(own.get(s, 0) - sum(own.values()) / 24) < 2 for s in range(24))
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_shards_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, f"k{rng.randrange(9)}", rng.choice(["hot"] * 5 + ["a", None])) for i in range(700)]
    table = common.materialize(spark.createDataFrame(rows, "doc_id long, v string, source string"), "s")
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.stratified_shards(table, 7).collect()}
    by = collections.defaultdict(list)
    for r in table.select("*", F.xxhash64("doc_id", "v", "source", F.lit(17)).alias("h")).collect():
        by["null" if r.source is None else f"={r.source}"].append((unsigned(r.h), r.doc_id))
    every = []
    for stratum, own in by.items():
        every += [(int((2 * k + 1) / (2 * len(own)) * 2.0**53), stratum, k, d) for k, (_, d) in enumerate(sorted(own))]
    want, n = {}, len(every)
    for place, (*_, d) in enumerate(sorted(every)):
        shard = place * 7 // n
        want[d] = (shard, place - -(-shard * n // 7))
    assert got == want


def test_ranks_of_a_hot_key(spark):
    df = common.materialize(spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id"), "t")
    got = common.ranked(df, ["k"], [F.col("id")], F.xxhash64("id"), "r", per_bucket=100).groupBy("k").agg(F.count("*").alias("n"), F.min("r").alias("a"), F.max("r").alias("b"), F.count_distinct("r").alias("d"), F.max("r_n").alias("m"))
    assert got.filter("a <> 0 or b <> n - 1 or d <> n or m <> n").isEmpty()


def unsigned(x):
    return x % 2**64


def edf(blocks, weights):
    """Sources slot by slot: of those whose next block is released the one due first, in phases that end with a source's last block."""
    left, order = dict(blocks), []
    while left:
        active = sorted(left, key=lambda s: (-weights[s], s))
        total, given, t = sum(weights[s] for s in active), dict.fromkeys(active, 0), 0
        while all(left[s] > given[s] for s in active):
            ready = [(-(-(given[s] + 1) * total // weights[s]), i, s) for i, s in enumerate(active) if given[s] * total // weights[s] <= t]
            s = min(ready)[2]
            given[s] += 1
            order.append(s)
            t += 1
        left = {s: left[s] - given[s] for s in active if left[s] > given[s]}
    return order


def plain_mix(hashed, weights, block_rows, default=1):
    """Rows (source, hash, row) in their order, by sorting and by ``edf``."""
    by = collections.defaultdict(list)
    for source, h, row in hashed:
        by[source].append((unsigned(h), row))
    blocks = {s: [sorted(r, key=lambda x: x[0])[at : at + block_rows] for at in range(0, len(r), block_rows)] for s, r in by.items()}
    key = lambda s: "null" if s is None else f"={s}"
    name = {key(s): s for s in blocks}
    order = edf({key(s): len(b) for s, b in blocks.items()}, {key(s): weights.get(s, default) for s in blocks})
    taken = {s: iter(b) for s, b in blocks.items()}
    return [row for tag in order for _, row in next(taken[name[tag]])]


def test_mixing(spark):
    sizes, weights = {"a": 900, "b": 300, "c": 500, None: 64}, {"a": 5, "b": 3, "c": 1}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    table = common.materialize(spark.createDataFrame(rows, "doc_id long, source string"), "m")
    got = mixing.mixed(table, weights, block_rows=10).collect()
    assert len(got) == len(rows) and len({r["place"] for r in got}) == len(rows)
    blocks = sorted({(r["slot"], r["source"]) for r in got}, key=lambda b: b[0])
    assert [b[0] for b in blocks] == list(range(len(blocks)))
    left = {s: -(-n // 10) for s, n in sizes.items()}
    start, at = 0, collections.Counter()
    for slot, source in blocks:  # deviation from the share stays under a block in every phase
        active = {s for s in left if left[s] > 0}
        total = sum(weights.get(s, 1) for s in active)
        at[source] += 1
        for s in active:
            assert abs(at[s] - (slot + 1 - start) * weights.get(s, 1) / total) < 1
        if at[source] == left[source]:
            left = {s: left[s] - at[s] for s in left}
            start, at = slot + 1, collections.Counter()
    hashed = [(r.source, r.h, (r.doc_id, r.source)) for r in table.select("*", F.xxhash64("doc_id", F.lit(29)).alias("h")).collect()]
    assert [(r.doc_id, r.source) for r in sorted(got, key=lambda r: r["place"])] == plain_mix(hashed, weights, 10)
    assert mixing.mixed(spark.createDataFrame([], "doc_id long, source string"), weights).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(spark.createDataFrame([(1, "a")], "doc_id long, source string"), {"a": 0})


def test_mixed_rows_keep_their_columns(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i if i % 11 else None, f"t{i}" if i % 13 else None, rng.choice(["hot"] * 6 + ["a", "b", None]), i, "x", 1.5, "z", 3, 4, 5) for i in range(1500)] + [(1, "dup", "a", 0, "x", 1.0, "z", 1, 2, 3)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, block long, slot string, place double, start string, total int, low int, t int").repartition(5)
    weights = {"a": 3, "hot": 30_001}
    out = mixing.ordered(df, weights, block_rows=8)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    table = common.materialize(df, "x")
    hashed = [(r.source, r.h, (r.doc_id, r.text, r.source)) for r in table.select("doc_id", "text", "source", F.xxhash64("doc_id", "text", F.lit(29)).alias("h")).collect()]
    assert [(r.doc_id, r.text, r.source) for r in out.collect()] == plain_mix(hashed, weights, 8)
    mixed = mixing.mixed(table, weights, block_rows=8, keys=("doc_id", "text"))
    assert mixed.columns == [f"{c}_before" if c in ("block", "slot", "place") else c for c in df.columns] + ["block", "slot", "place"]
    assert mixing.ordered(df.filter("false"), weights).count() == 0 and mixing.ordered(df.limit(1), weights).count() == 1
    many = spark.range(600).selectExpr("id AS doc_id", "'x' AS text", "concat('s', id % 140) AS source")
    monkeypatch.setattr(mixing, "SOURCES", 16)
    assert mixing.ordered(many, {"s1": 4, "s139": 7}, block_rows=2).select("doc_id").distinct().count() == 600


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = corpus() + ["it's WE'LL <|endoftext|> \x85 İ ﬁ 'S x'ts", "é" * 3000]
    got = packing.pack_documents(frame(spark, texts), path, length=64).collect()
    plain = Tokenizer.from_file(path)
    want = []
    for d, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, p, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 64))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [p[0] for p in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 64
    lengths, bins = sorted((w[3] for w in want), reverse=True), []
    for n in lengths:  # best fit, falling, one by one
        fit = [i for i, g in enumerate(bins) if g >= n]
        best = min(fit, key=lambda i: bins[i], default=None)
        if best is None:
            bins.append(64 - n)
        else:
            bins[best] -= n
    assert len(by) == len(bins)
    assert packing.pack_documents(frame(spark, ["a"]).filter("false"), path).count() == 0


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.COM/en/7x?q#f", "https://h.example.com/en/8", "x", None, "://", "ftp://h.net?x=/de/", "http://a.net/de/1", "http://b.example.net/de/81", "http://xnet/de/", "http://é.org/es/a", "http://u:p@Q.com:80/en/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([("h.net", 1)] * 40 + [("x.net", 0)] * 40 + [(None, 1), ("y.net", None)], "host string, bad long")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df, outcomes).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in range(6)] == [("a.example.com", "/en/7x"), ("h.example.com", "/en/8"), ("", ""), ("", ""), ("", ""), ("h.net", "")]
    assert [got[i]["rule"] for i in range(11)] == ["example.com/en/7", "com/en/", None, None, None, None, "net/de/", "example.net/de/8", None, "org/es/", None]
    assert [got[i]["verdict"] for i in (0, 1, 5, 6, 7, 9)] == ["allow", "block", "block", "allow", "block", "block"]
    assert url_filter.filter_urls(df, outcomes.filter("false")).count() == 11


def test_secrets(spark):
    rng = random.Random(9)
    texts, want = [], set()
    for i in range(120):
        t = prose(rng, 30)
        kind = i % 6
        if kind < 2:
            key = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) if kind else "".join(rng.choice("0123456789abcdef") for _ in range(24))
            lead = t + (" " if kind else " password=")
            t, start = lead + key + " " + prose(rng, 20), len(lead)
            want.add((i, start, hashlib.sha256(key.encode()).hexdigest()))
        elif kind == 2:
            t += " " + "".join(rng.choice("0123456789") for _ in range(16)) + " " + prose(rng, 10)
        elif kind == 3:
            t += " see /img/a9" + "".join(rng.choice("abcdef") for _ in range(16)) + "/x " + prose(rng, 10)
        texts.append(t)
    texts += [None, "", "é" * 50]
    df = frame(spark, texts)
    forest = secrets.learn(df)
    found = secrets.scan(df, forest).collect()
    assert {(r["doc_id"], r["start"], r["value_sha256"]) for r in found if r["is_secret"]} == want and len(found) > len(want)
    masked = {r["doc_id"]: r for r in secrets.redacted(df, forest).collect()}
    hit = {d: (s, h) for d, s, h in want}
    for d, t in enumerate(texts):
        if d in hit:
            assert masked[d]["text"].startswith(t[: hit[d][0]] + secrets.MASK) and masked[d]["n_chars"] == len(masked[d]["text"])
        else:
            assert masked[d]["text"] == t
    assert secrets.scan(df.filter("false"), forest).count() == 0
    plan = secrets.scan(df, forest)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert secrets.learn(df.filter("false")).trees == ()


def test_secrets_in_spaced_assignments(spark):
    rng = random.Random(10)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHJKLMNPQRabcdefghijkmn23456789+/"]
    texts = []
    for i in range(240):  # what the forest learns from, with words assigned alike
        value = rng.choice(["x", "z"]) + "".join(rng.choice(alphabets[i % 3]) for _ in range(25)) if i % 2 else rng.choice(WORDS) + rng.choice(WORDS)
        texts.append(f"{prose(rng, 20)} {rng.choice(['password', 'api_key', 'token', 'note', 'title'] if i % 2 == 0 else ['password', 'api_key', 'token'])} {'=:'[i % 4 // 2]} {value} {prose(rng, 10)}")
    lines = [
        ('password = "', "hunter2xyz9"), ("password: ", "hunter2xyz9"), ("secret: ", "9f8a-7b6c-5d4e-3f2a"), ('aws_secret_access_key = "', "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
        ('token = "', "AbCdEfGhIjKlMnOpQrStUvWx"), ("env: password =      ", "9f8a7b6c5d4e3f2a9f8a"), ("api_key\t:\t'", "abcdefabcdef0123456/QRSTUVw2"),
    ]
    ids = range(1000, 1000 + len(lines))
    forest = secrets.learn(frame(spark, texts))
    df = frame(spark, [f"{prose(rng, 8)} {lead}{value}" for lead, value in lines], ids)
    found = {(r["doc_id"], r["value_sha256"]): r["is_secret"] for r in secrets.scan(df, forest).collect()}
    for i, (_, value) in zip(ids, lines):
        assert found.get((i, hashlib.sha256(value.encode()).hexdigest())), value
    masked = {r["doc_id"]: r["text"] for r in secrets.redacted(df, forest).collect()}
    assert all(masked[i].endswith(lead + secrets.MASK) for i, (lead, _) in zip(ids, lines))
    plain = frame(spark, [f"{prose(rng, 8)} title: {rng.choice(WORDS)}{rng.choice(WORDS)} {prose(rng, 8)}" for _ in range(20)])
    assert not any(r["is_secret"] for r in secrets.scan(plain, forest).collect())


def test_url_sql_and_frequent_hosts(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    want = con.execute(url_filter.oracle_sql()).fetchall()
    got = queries.op3_url_filter(spark, sf)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "bad_rate", "bad_bound"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    rows = [(i, "http://hot.bad/x" if i % 3 else f"http://h{i}.bad/x") for i in range(3000)] + [(None, None), (7, "http://hot.bad/x"), (7, "http://hot.bad/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([("hot.bad", 1)] * 60 + [("ok.fine", 0)] * 60, "host string, bad long")
    found = url_filter.filter_urls(pages, outcomes).collect()
    assert len(found) == len(rows) and all(r.verdict == "block" and r.bad_bound > 0.5 for r in found if r.host == "hot.bad") and url_filter.filter_urls(pages.filter("false"), outcomes).count() == 0


def plain_features(language, value, before, after):
    """FEATURES one by one, by loops."""
    n, low = len(value), value.lower()
    alnum = lambda a: a.isascii() and a.isalpha()
    digit = lambda a: a in "0123456789"
    steps = list(zip(value, value[1:]))
    rest, at, words = 0, 0, sorted(language.words, key=lambda w: (-len(w), w))
    while at < n:  # what no frequent word covers, from the left, the longest word first
        hit = next((w for w in words if low.startswith(w, at)), None)
        rest, at = (rest, at + len(hit)) if hit else (rest + 1, at + 1)
    last = re.findall(r"[^\W\d_]+", before)
    first = re.findall(r"[^\W\d_]+", after)
    keyword = re.search(r"(password|passwd|passphrase|pass|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer)[^A-Za-z0-9]*$", before, re.I)
    per, steps_n = max(n, 1), max(n - 1, 1)
    return [
        n, sum(map(digit, value)) / per, sum("A" <= a <= "Z" for a in value) / per, sum(alnum(a) and digit(b) or digit(a) and alnum(b) for a, b in steps) / steps_n,
        sum(low[i : i + 2] in language.pairs for i in range(n - 1)) / steps_n, (n - rest) / per, float(bool(re.search(r"[/\\@.]$", before) or re.match(r"[/\\@]|\.[A-Za-z]", after))),
        float(bool(keyword)), float(bool(re.search(r"[=:][ \t\"']*$", before))), float(bool(last) and last[-1].lower() in language.words), float(bool(first) and first[0].lower() in language.words),
        len(set(value)) / per, sum("a" <= a <= "z" and "A" <= b <= "Z" or "A" <= a <= "Z" and "a" <= b <= "z" for a, b in steps) / steps_n,
    ]


def test_secret_candidates_and_features_equal_brute_force(spark):
    rng = random.Random(12)
    letters = "abcdefXYZ0123456789_"
    texts = [None, "", "x", "token=" + "q7" * 5, "é token: 'aaaaaaaa' é \\tokens a1b2c3d4e5f6g7h8 user@ABCDEFGHIJKLMNOP.com"]
    for _ in range(60):
        made = [rng.choice([prose(rng, 3), "key = " + "".join(rng.choice(letters) for _ in range(rng.randint(8, 40))), "".join(rng.choice(letters) for _ in range(20)), "a/b/" + "k9" * 10 + "/c", "\n"]) for _ in range(rng.randint(1, 12))]
        texts.append(rng.choice([" ", "\t", ", "]).join(made))
    df = frame(spark, texts)
    language = secrets.learn_language(df)
    words = collections.Counter(w for t in texts for w in re.findall(r"(?<![^\W_])(?<!_)[^\W\d_]{3,12}(?![^\W_])(?!_)", (t or "").lower()))
    pairs = collections.Counter()
    for w, k in words.items():
        for a, b in zip(w, w[1:]):
            pairs[a + b] += k
    assert language.words == tuple(sorted(words, key=lambda w: (-words[w], w))[:400]) and language.pairs == tuple(sorted(pairs, key=lambda p: (-pairs[p], p))[:150])
    found = secrets.candidates(df)
    got = found.withColumn("c", F.struct("value", "before", "after")).withColumn("x", F.expr(secrets._features(language))).collect()
    pattern = re.compile(r"(?<![A-Za-z0-9_])(?:(?=[A-Za-z0-9_+/\-]{8})[A-Za-z0-9_+/\-]{8,}|(?=[A-Za-z_]*[0-9])[A-Za-z0-9_]{16,}|[A-Z0-9]{16,}(?![A-Za-z0-9_]))")
    want = []
    for d, t in enumerate(texts):
        at, before = 0, 0
        while t and at < len(t):  # the first kind of candidate stands after an assignment only
            hit = pattern.match(t, at)
            value = hit and hit[0]
            if value and not re.search(r"[=:][ \t]{0,48}[\"']?$", t[:at]):
                hit = re.compile(r"(?=[A-Za-z_]*[0-9])[A-Za-z0-9_]{16,}|[A-Z0-9]{16,}(?![A-Za-z0-9_])").match(t, at) if not re.match(r"[A-Za-z0-9_]", t[at - 1 : at]) else None
                value = hit and hit[0]
            if value:
                want.append((d, at, value, t[before:at][-48:], None))
                before, at = at, at + len(value)
            else:
                at += 1
    assert sorted((r.doc_id, r.start, r.value, r.before) for r in got) == sorted(w[:4] for w in want) and len(want) > 100
    for r in got:
        assert r.x == pytest.approx(plain_features(language, r.value, r.before, r.after)), r.value


def test_secrets_take_time_in_proportion(spark):
    """Thousands of candidates in a text, and one candidate of 100 kB."""
    import time

    many = " ".join(f"token = a{i:07d}bcdefgh" for i in range(5000))
    long = "password=" + "a1Bc" * 25_000
    df = frame(spark, [many, long, "see 1234567890123456 there", None])
    forest = secrets.learn(df)
    start = time.time()
    assert secrets.scan(df, forest).groupBy("doc_id").count().collect() and time.time() - start < 60
    masked = {r.doc_id: r.text for r in secrets.redacted(df, secrets.Forest(("1d",), forest.language)).collect()}
    assert masked[0] == " ".join(["token = " + secrets.MASK] * 5000) and masked[1] == "password=" + secrets.MASK and masked[3] is None and time.time() - start < 120


def test_forest_learns_labelled_findings(spark):
    """Trained on half of planted findings with their true labels, judged on the other half: keys without a keyword before them against ids, hashes in paths and long words."""
    rng = random.Random(20)
    rows = []
    for i in range(800):
        secret = i % 2
        value = "".join(rng.choice("abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(32)) if secret else rng.choice(["order_" + "".join(rng.choice("0123456789") for _ in range(14)), "".join(rng.choice(WORDS) for _ in range(4)) + str(i), "".join(rng.choice("0123456789") for _ in range(20))])
        rows.append((f"{prose(rng, 12)} {value} {prose(rng, 8)}", value, secret))
    df = frame(spark, [r[0] for r in rows])
    truth = {r[1]: r[2] for r in rows}
    found = common.materialize(secrets.candidates(df), "f")
    label = spark.createDataFrame(list(truth.items()), "value string, label int")
    forest = secrets.learn(df, found.filter("doc_id < 400").join(label, "value").select("value", "before", "after", "label"))
    judged = [(r.is_secret, rows[r.doc_id][2]) for r in secrets.scan(df, forest, found=found.filter("doc_id >= 400")).collect()]
    caught = sum(1 for got, want in judged if got and want)
    assert caught / 200 > 0.95 and caught / sum(g for g, _ in judged) > 0.95  # of all planted ones, a few without digits are no candidates


def labelled(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        words = prose(rng, rng.randint(20, 120)).split(" ")
        toxic, good = rng.random() < 0.4, rng.random() < 0.6
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["zzgrim", "zzgrab", "zzgrot"]) + rng.choice(["", "ler", "tas"])
        text = " ".join(words) if good else " ".join(w + "$$$ %%%" for w in words)
        rows.append((text, int(good), int(toxic)))
    return rows


def test_classifiers_on_rows_not_seen(spark):
    rows = labelled(1, 420)
    docs = frame(spark, [r[0] for r in rows] + [None, ""])
    labels = spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(rows)] + [(None, 1, 1), (3, None, None), (10**6, 1, 0)], "doc_id long, quality int, toxic int")
    out = {zlib.crc32(str(i).encode()) % 5 == 0: i for i in range(20)}
    for label, got in ((1, quality.scores(docs, quality.train(docs, labels, 200))), (2, toxicity.scores(docs, toxicity.train(docs, labels, (200, 200), steps=200)))):
        seen = {r["doc_id"]: r for r in got.collect()}
        assert len(seen) == len(rows) + 2 and all(0 <= r["score"] <= 1 for r in seen.values())
        held = [i for i in range(len(rows)) if seen[i]["held_out"]]
        assert all(seen[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(len(rows))) and len(held) > 40
        assert np.mean([seen[i]["predicted"] == rows[i][label] for i in held]) > 0.9, label
    assert quality.kept(docs, quality.train(docs, labels, 200)).columns == docs.columns
    none = labels.filter("false")
    assert quality.scores(docs, quality.train(docs, none)).filter("score = 0.5").count() == len(rows) + 2
    assert toxicity.scores(docs, toxicity.train(docs, none)).count() == len(rows) + 2 and out


def test_scores_equal_brute_force_on_odd_rows(spark):
    import zstandard

    rows = labelled(2, 300)
    texts = [r[0] for r in rows] + [None, "", rows[0][0], "\x00", "a" * 3_000_000, "wort " * 50_000]
    ids = [*range(len(rows)), None, 900, 0, 901, 902, 903]
    docs = frame(spark, texts, ids).withColumns({"score": F.lit("s"), "predicted": F.lit("p"), "held_out": F.lit("h"), "y": F.lit(1)})
    labels = spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, 120)
    pair = [zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_dict_id=False) for d in (model.good, model.bad)]

    def by_size(text):
        raw = (text or "").encode()
        good, bad = (sum(len(c.compress(raw[at : at + quality.PIECE])) for at in range(0, max(1, len(raw)), quality.PIECE)) for c in pair)
        x, knots = (bad - good) / (bad + good), model.knots
        k = max(i for i, a in enumerate(knots[:-1]) if a <= x)
        return model.scores[k] + (model.scores[k + 1] - model.scores[k]) * (x - knots[k]) / (knots[k + 1] - knots[k])

    got = quality.scores(docs, model).collect()
    assert sorted((str(r.doc_id), round(r.score, 9), r.predicted) for r in got) == sorted((str(d), round(by_size(t), 9), int(by_size(t) >= 0.3)) for d, t in zip(ids, texts))
    kept = quality.kept(docs, model)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t in zip(ids, texts) if by_size(t) >= 0.3)
    net = toxicity.train(docs, labels, (150, 100), steps=60)
    found = toxicity.scores(docs, net).collect()
    assert len(found) == len(texts) and {r.held_out for r in found if r.doc_id is None} == {False} and len({r.score for r in found if r.doc_id in (None, 900)}) == 1
    seen = {r.doc_id: r.score for r in found}
    for d, t in list(zip(ids, texts))[:12]:
        assert seen[d] == pytest.approx(1 / (1 + np.exp(-(net.slope * plain_logit(net, re.sub(r"[^0-9A-Za-z\x80-\uffff]+", " ", t).strip()) + net.offset))), abs=1e-4)
    assert quality.scores(docs.filter("false"), model).count() == 0 and toxicity.scores(docs.filter("false"), net).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = prose(rng, 400_000)
    texts = [long, long.replace(WORDS[0], WORDS[1], 3), "x" * 2_000_000, None]
    df = frame(spark, texts)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    prints = {r.doc_id: r for r in fingerprint.edited_fingerprints(df).collect()}
    assert [prints[i].n_chars for i in range(4)] == [len(t or "") for t in texts] and prints[1].near_next > 0.9


def test_registered_queries_cover_their_tables(spark):
    sf = "/root/testdata/sf0.001"
    n = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages")}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for name in ("op2_fingerprint", "op4_jaccard_join", "op5_mixing", "op6_toxicity", "op8_quality", "op10_sharding"):
        got = queries.QUERIES[name](spark, sf).collect()
        assert sorted(r.doc_id for r in got) == sorted(docs), name
    found = queries.op1_secrets(spark, sf).collect()
    assert found and all(hashlib.sha256(docs[r.doc_id][r.start : r.start + r.length].encode()).hexdigest() == r.value_sha256 for r in found)
    assert {r.doc_id for r in queries.op9_packing(spark, sf).collect()} == set(docs) and n["documents"] == len(docs)
    near = queries.op7_neighbours(spark, sf).collect()
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert {r.query_id for r in near} == {v for v in vectors if v % 20 == 0} and all(r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-9) for r in near)


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: rng.normal(size=s) * 0.5 for k, s in toxicity._shapes(1, 1).items() if k not in ("word", "gram")}
    x, live, y, weight = rng.normal(size=(3, 5, toxicity.WIDTH)), np.arange(5) < np.array([[5], [3], [1]]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, g, dx = toxicity._forward_backward(p, x, live, y, weight)
    for k, at in (("Wf", (2, 9)), ("Ub", (1, 20)), ("v", (3,)), ("w", (12,)), ("bf", (17,)), ("Uf", (0, 3))):
        old, e = p[k][at], 1e-3
        p[k][at] = old + e
        up = toxicity._forward_backward(p, x, live, y, weight)[0]
        p[k][at] = old - e
        down = toxicity._forward_backward(p, x, live, y, weight)[0]
        p[k][at] = old
        assert (up - down) / (2 * e) == pytest.approx(g[k][at], rel=2e-2, abs=1e-4)


def test_windows_cover_every_word():
    at = np.array([0, 0, 1, 33, 33 + 32, 200])
    first, size, text = toxicity.windows_of(at)
    seen = {i for f, n in zip(first, size) for i in range(f, f + n)}
    assert seen == set(range(200)) and set(text.tolist()) == {1, 2, 3, 4} and (size <= toxicity.WINDOW).all()


def plain_logit(net, text):
    """The largest logit of a text's windows, by loops over words: states of the runs that cover them, then attention within each window."""
    words = text.split(" ")
    w, which, at = toxicity.read_words(*shingles.text_bytes(pa.array([text])))
    x = net.inputs(*net.rows(w))[which].astype(np.float64)
    n, H, sigmoid = len(words), toxicity.HIDDEN, lambda z: 1 / (1 + np.exp(-z))

    def run(k, order):
        h, found = np.zeros(H), {}
        for i in order:
            g = x[i] @ net.p["W" + k] + net.p["b" + k]
            hu = h @ net.p["U" + k]
            z, r = sigmoid(g[:H] + hu[:H]), sigmoid(g[H : 2 * H] + hu[H : 2 * H])
            h = z * h + (1 - z) * np.tanh(g[2 * H :] + r * hu[2 * H :])
            found[i] = h
        return found

    states = {}
    for lo in range(0, n, toxicity.SEGMENT):
        hi = min(lo + toxicity.SEGMENT, n)
        forward = run("f", range(max(0, lo - toxicity.WARM), hi))
        back = run("b", range(min(n, hi + toxicity.WARM) - 1, lo - 1, -1))
        states |= {i: np.concatenate([forward[i], back[i]]) for i in range(lo, hi)}
    best = -np.inf
    for first in range(max(1, n - toxicity.WINDOW + 1)):
        own = np.array([states[i] for i in range(first, min(n, first + toxicity.WINDOW))])
        weight = np.exp(own @ net.p["v"])
        best = max(best, float((weight / weight.sum()) @ own @ net.p["w"] + net.p["c"][0]))
    return best


def test_texts_are_scored_at_every_start(monkeypatch):
    rng, draw = np.random.default_rng(2), random.Random(2)
    texts = [prose(draw, n) for n in (1, 31, 32, 33, 40, 95, 96, 97, 128, 200, 333)]
    w = toxicity.read_words(*shingles.text_bytes(pa.array(texts)))[0]
    grams = np.unique(w.grams)
    net = toxicity.Network(w.hashes[::2], grams, {k: rng.normal(size=s).astype(np.float32) for k, s in toxicity._shapes(len(w.hashes[::2]), len(grams)).items()})
    want = [plain_logit(net, t) for t in texts]
    for block, memo in ((4096, 200_000), (3, 10)):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        monkeypatch.setattr(toxicity, "MEMO", memo)
        for _ in range(2):  # the second time most words are known
            assert net.text_logits(*shingles.text_bytes(pa.array([*texts, ""]))) == pytest.approx([*want, toxicity.NO_WORDS], abs=1e-4)


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 1.5, size=(1500, 1))
    x[100:140] = x[100]
    rows = [(i, v.tolist(), "z", 1) for i, v in enumerate(x)]
    rows += [(None, x[0].tolist(), "z", 1), (2000, None, "z", 1), (2020, [0.0] * 24, "z", 1), (2040, [None] + [1.0] * 23, "z", 1), (2060, [float("nan")] * 24, "z", 1), (2080, [1.0], "z", 1), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string, rank int")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -score))[:20]
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
        assert [f[0] for f in found] == list(range(1, 21)) and np.allclose([score[v] for _, v, _ in found], [s for *_, s in found], atol=1e-12)
        assert [v for _, v, _ in found] == [v for _, v in sorted((-s, v) for _, v, s in found)]
    assert hits / (20 * len(got)) >= 0.9
    monkeypatch.setattr(neighbours, "PART_ROWS", 100)  # many parts, and salted ones; the same answers, from a sample smaller than the table too
    again = {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()}
    assert again == {(q, n, v, round(score, 9)) for q, found in got.items() for n, v, score in found}
    sampled, hits = collections.defaultdict(set), 0
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, sample_rows=300).collect():
        sampled[r["query_id"]].add(r["vec_id"])
    for q, found in sampled.items():
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(len(x)), -score))[:20].tolist()) & found)
    assert hits / (20 * len(got)) >= 0.9
    few = neighbours.nearest(df.filter("vec_id < 4"), F.col("vec_id") % 20 == 0).collect()
    assert [r["rank"] for r in few] == [1, 2, 3]
    assert neighbours.nearest(df.filter("vec_id = 0"), F.col("vec_id") == 0).count() == 0 and neighbours.nearest(df.filter("false"), F.lit(True)).count() == 0
