"""Sharding and resampling: brute force in plain Python and the defined edge cases."""
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from runlens.llm import oracles, queries as Q, resample as R, sharding as S
from conftest import SF_SMALL

ODD = [(1, "Call me"), (2, None), (3, ""), (4, " \t\n"), (5, "naïve Straße 漢字"), (5, "naïve Straße 漢字"), (6, "word " * 30_000),
       (None, "no id"), (None, None), (7, "A b\nc\n\nD e\nf g h\n"), (7, "x")]


def jump(key, shards):
    """The published algorithm."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def key_of(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:16], 16)


def sharded(rows, shards):
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        want.append((jump(key_of(d), shards), key_of(d), len(raw) + 8, zlib.crc32(raw), repr(d), d))
    seen = Counter()
    for shard, _, size, crc, _, d in sorted(want):
        yield d, size, crc, "key", shard, seen[shard], jump(key_of(d), shards + 1)
        seen[shard] += 1


SHARD_NAMES = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def compared(df, want, names):
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted(want, key=repr)


def odd_docs(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr(
        "*", "1 AS shard", "'x' AS slot", "2 AS size", "3 AS key", "4 AS row", "5 AS line", "6 AS n_words", "7 AS eligible").repartition(3)


@pytest.mark.parametrize("shards", [1, 2, 24, 1000])
def test_jump(spark, shards):
    got = spark.range(400).select("id", S.shard_of(F.col("id"), shards).alias("shard")).collect()
    assert [r.shard for r in got] == [jump(key_of(r.id), shards) for r in got]


def test_jump_beyond_the_first_steps(spark, monkeypatch):
    monkeypatch.setattr(S, "STEPS", 2)
    got = spark.range(200).select("id", S.shard_of(F.col("id"), 50).alias("shard")).collect()
    assert [r.shard for r in got] == [jump(key_of(r.id), 50) for r in got]
    with pytest.raises(ValueError):
        S.shard_of(F.col("id"), 0)


def test_sharding(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Q.QUERIES["op11_sharding"](spark, SF_SMALL)
    compared(got, sharded(rows, 24), SHARD_NAMES)
    moved = {r.shard: r for r in S.growth(got).collect()}
    assert sum(r.n_rows for r in moved.values()) == len(rows)
    assert sum(r.moved_rows for r in moved.values()) == sum(jump(key_of(d), 25) == 24 for d, _ in rows)
    S.write_shards(docs, str(tmp_path / "shards"), 3)
    back = [[(r.doc_id, r.text) for r in S.read_shard(spark, str(tmp_path / "shards"), k).collect()] for k in range(3)]
    slots = {(w[4], w[5]): w[0] for w in sharded(rows, 3)}
    assert [[d for d, _ in b] for b in back] == [[slots[k, i] for i in range(len(b))] for k, b in enumerate(back)]
    assert sorted(x for b in back for x in b) == sorted(rows)


def test_sharding_edges(spark):
    compared(S.assign(odd_docs(spark), 3), sharded(ODD, 3), SHARD_NAMES)
    whole = S.assign(odd_docs(spark), 3, rows=True)
    assert {r.row.row for r in whole.collect()} == {4} and whole.count() == len(ODD)
    assert S.assign(odd_docs(spark).where("1 = 0")).count() == 0
    hot = S.assign(spark.range(500).selectExpr("7L AS doc_id", "'same' AS text"), 5).collect()         # one key
    assert len({r.shard for r in hot}) == 1 and sorted(r.slot for r in hot) == list(range(500))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i:i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def resampled(rows, targets, rule):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % rule.buckets for t in texts for f in features(t, rule.words)[1])

    s, t = counts(x for _, x in rows), counts(targets)
    big, small = rule.buckets + sum(s.values()), rule.buckets + sum(t.values())
    out = []
    for d, text in rows:
        words, found = features(text, rule.words)
        buckets = [zlib.crc32(f.encode()) % rule.buckets for f in found]
        gains = [math.floor(1000 * math.log((t[b] + 1) * big / ((s[b] + 1) * small))) for b in buckets]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{rule.seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= rule.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    rank = {id(r): i + 1 for i, r in enumerate(able[:rule.percent * len(able) // 100])}
    return [(*r, rank.get(id(r))) for r in out]


NAMES = ("doc_id", "n_words", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("words", [1, 3])
def test_resampling(spark, words):
    docs, target = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    rows, wanted = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]
    rule = R.Rule(words=words)
    compared(R.resample(docs, target, rule), resampled(rows, wanted, rule), NAMES)
    if words == 1:
        compared(Q.QUERIES["op13_resampling"](spark, SF_SMALL), [(r[0], *r[2:]) for r in resampled(rows, wanted, rule)],
                 ("doc_id", "n_features", "weight", "score", "rank"))


@pytest.mark.parametrize("words", [1, 2, 4])
def test_resampling_edges(spark, words):
    target = spark.createDataFrame([("call x",), (None,), ("h\nd E",)], "text string")
    rule = R.Rule(words=words, buckets=50, percent=50, least_words=1)
    compared(R.resample(odd_docs(spark), target, rule), resampled(ODD, ["call x", None, "h\nd E"], rule), NAMES)
    compared(R.resample(odd_docs(spark), target.where("1 = 0"), rule), resampled(ODD, [], rule), NAMES)
    assert R.resample(odd_docs(spark).where("1 = 0"), target, rule).count() == 0


def test_runs_across_lines():
    lines = [[b"a", b"b"], [], [b"c"], [b"d", b"e", b"f"], []]
    words = [w for line in lines for w in line]
    inside = [r for line in lines for r in R.runs_inside(line, 3)]
    every = R.runs_inside(words, 3)
    assert Counter(R.runs_across(lines, 3)) + Counter(inside) == Counter(every)


@pytest.mark.parametrize("name", ["op11_sharding", "op13_resampling"])
def test_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    cur = con.execute(oracles.ORACLES[name])
    names = [d[0] for d in cur.description]
    compared(Q.QUERIES[name](spark, SF_SMALL), cur.fetchall(), names)


def test_sharding_runs_no_python(spark):
    plan = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(S.shard_of(F.col("doc_id"), 24))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
