"""The operators on Spark: brute force on small tables, and the edge cases that their docstrings define."""
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from runlens.llm import (_components, ann, bpe, chat, decontaminate as D, langid, neardup as N, pii, queries as Q, token_shards as T,
                         urlfilter as U, wordpiece as W)

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = [(1, "Call +1 (542) 555-3599 or a.b@mail.example.com"), (2, None), (3, ""), (4, " \t\n"), (5, "naïve Straße 漢字 'tis"),
       (5, "naïve Straße 漢字 'tis"), (6, "word " * 30_000), (None, "no id"), (7, "x"), (8, "12 34 !!")]


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns named like the operators' own."""
    return (spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
            .select("doc_id", "text", F.lit("en").alias("lang"), F.lit(1).alias("row"), F.lit("b").alias("base"), F.lit(0.5).alias("score"),
                    F.lit(7).alias("n_tokens"), F.lit(True).alias("kept"), F.length("text").cast("long").alias("n_chars")))


def empty(df):
    return df.where("1 = 0")


def keyed(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def texts():
    return sorted(((d, t or "") for d, t in ODD), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# ------------------------------------------------------------------ 9: byte BPE

def test_byte_bpe_round_trip(spark, docs, rows):
    import base64

    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def want(pairs):
        for d, t in pairs:
            ids = library.encode_ordinary(t or "")
            yield d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert keyed(Q.QUERIES["op9_byte_bpe"](spark, SF_SMALL).collect(), *names) == sorted(want(rows), key=repr)
    assert keyed(bpe.round_trip(odd_docs(spark), RANKS).collect(), *names) == sorted(want(ODD), key=repr)
    encoded = bpe.encode(odd_docs(spark), RANKS)
    assert keyed(bpe.decode(encoded, RANKS).collect(), "doc_id", "bytes") == sorted(((d, bytearray(t.encode())) for d, t in texts()), key=repr)
    assert bpe.encode(empty(odd_docs(spark)), RANKS).count() == 0


# ------------------------------------------------------------------ 7: word pieces

def test_word_piece_counts(spark, rows):
    first, rest = map(set, W.pieces_of_ranks(RANKS))

    def length(word):
        at = n = 0
        while at < len(word):
            at = next(e for e in range(len(word), at, -1) if word[at:e] in (rest if at else first))
            n += 1
        return n

    seen = {}
    want = []
    for d, t in rows[:60]:
        words = re.findall("[^\x20\x09-\x0D]+", t or "")
        own = [seen.setdefault(w, length(w.encode())) for w in words]
        want.append((d, len(words), sum(own), 0, max(own, default=0)))
    names = ("doc_id", "n_words", "n_tokens", "n_unknown", "longest_word")
    got = {r.doc_id: tuple(r) for r in Q.QUERIES["op7_word_pieces"](spark, SF_SMALL).select(*names).collect()}
    assert len(got) == len(rows) and [got[w[0]] for w in want] == want
    odd = {(r.doc_id, r.n_words) for r in W.token_counts(odd_docs(spark), RANKS).collect()}
    assert odd == {(d, len(t.split())) for d, t in texts()}
    assert W.token_counts(empty(odd_docs(spark)), RANKS).count() == 0


# ------------------------------------------------------------------ 3: token shards

def _shard_rows(pairs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(WORDS)
    at = 0
    for d, t in pairs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        yield d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)


def test_token_shards(spark, docs, rows, monkeypatch):
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    want = list(_shard_rows(sorted(rows)))
    assert keyed(Q.QUERIES["op3_token_shards"](spark, SF_SMALL).collect(), *names) == sorted(want, key=repr)
    for docs_in_part in (7, 50):                                 # several ranges and shards
        monkeypatch.setattr(T, "PART_DOCS", docs_in_part)
        shards = T.write_shards(docs, WORDS)
        assert shards.count() >= len(rows) // docs_in_part // 2
        assert keyed(T.read_documents(shards).collect(), *names) == sorted(want, key=repr)
    control = [(1, "hello <|endoftext|> world"), (2, "<|ENDOFTEXT|> x <|startoftext|>é"), (3, "漢 <|endoftext|>")]
    marked = T.write_shards(spark.createDataFrame(control, "doc_id long, text string"), WORDS)
    assert keyed(T.read_documents(marked).collect(), *names) == sorted(_shard_rows(control), key=repr)
    assert next(_shard_rows(control))[2] == 4                    # three ids and the end
    odd = T.write_shards(odd_docs(spark), WORDS)
    by_id = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert keyed(T.read_documents(odd).collect(), *names) == sorted(_shard_rows(by_id), key=repr)
    places = keyed(T.token_occurrences(odd, 1).collect(), "doc_id", "place")      # the end id of every document
    assert places == sorted(((d, n - 1) for d, _, n, _ in _shard_rows(by_id)), key=repr)
    assert T.read_documents(T.write_shards(empty(docs), WORDS)).count() == 0


# ------------------------------------------------------------------ 6: language identification

def test_language_of_held_out_documents(spark):
    got = Q.QUERIES["op6_language"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, docs):
    model = langid.fit(docs, train_docs=40)
    assert set(model.languages) == {"en", "fr", "de", "es"}
    got = langid.predict(odd_docs(spark), model).collect()
    und = {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (8, "und", 0.0)}
    assert len(got) == len(ODD) and und == {tuple(r) for r in got if r.lang_pred == "und"}
    kept = langid.keep_identified(odd_docs(spark), model)
    assert kept.columns == odd_docs(spark).columns
    assert keyed(kept.collect(), "doc_id") == sorted(((r.doc_id,) for r in got if r.score >= max(1.2 / 4, 0.01)), key=repr)
    signs = spark.createDataFrame([(1, "² ½"), (2, "① Ⅷ"), (3, "٣ 12"), (4, "ª é")], "doc_id long, text string")
    assert {r.doc_id for r in langid.predict(signs, model).collect() if r.lang_pred == "und"} == {1, 2, 3}
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.fit(nothing) is None and langid.fit(empty(docs)) is None
    assert {r.lang_pred for r in langid.predict(docs.limit(3), None).collect()} == {"und"}
    assert langid.predict(empty(docs), model).count() == 0


def test_decontamination_plan(spark, docs, monkeypatch):
    """One Python operator and no exchange, whatever the number of blocks."""
    monkeypatch.setattr(D, "BLOCK_BYTES", 500)
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    assert len(D.benchmark_blocks(bench.union(bench), 10)) == len(D.benchmark_blocks(bench, 10)) > 5
    for df in (D.contamination(docs, bench), D.remove_passages(docs, bench)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_language_under_one_doc_id(spark):
    """A language whose rows share a doc_id is sampled by their texts; rows that repeat count once."""
    texts = [(8, f"le chat numéro {i} dort dans la maison", "fr") for i in range(300)] + [(8, "copie de la page", "fr")] * 300
    texts += [(9 + i, f"the cat number {i} sleeps in the house", "en") for i in range(0, 900) if zlib.crc32(str(9 + i).encode()) % 4 != 2]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    assert zlib.crc32(b"8") % 4 != 2
    model = langid.fit(docs, train_docs=50)
    assert model.languages == ["en", "fr"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs.limit(301), model).collect()}
    assert got[8] == "fr"


def test_language_labels_without_bound(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    labelled = docs.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("x"), "doc_id")).otherwise(F.col("lang")))
    assert len(langid.fit(labelled, 20).languages) == 3


def test_language_learns_from_no_held_out_document(spark, docs):
    """Wrong labels on every held-out document change nothing."""
    wrong = docs.withColumn("lang", F.when(langid.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    a, b = langid.fit(docs, 30), langid.fit(wrong, 30)
    assert a.languages == b.languages and all(np.array_equal(a.weights[n], b.weights[n]) for n in a.weights)


# ------------------------------------------------------------------ 1: decontamination

def _contaminated(pairs, items, window):
    wins = {}
    for item, text in items:
        w = D.words_of(text)
        for i in range(max(1, len(w) - window + 1) if w and item is not None else 0):
            wins.setdefault(tuple(w[i:i + window]), set()).add(item)
    sizes = sorted({len(k) for k in wins})
    for d, t in pairs:
        w, hit, own = D.words_of(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if ids := wins.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    own |= ids
        yield d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit)


_FOUND = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination(spark, rows, monkeypatch):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(_contaminated(rows, items, 10), key=repr)
    assert any(r[-1] for r in want)
    assert keyed(Q.QUERIES["op1_decontamination"](spark, SF_SMALL).collect(), *_FOUND) == want
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)                  # the benchmark in several blocks
    assert keyed(Q.QUERIES["op1_decontamination"](spark, SF_SMALL).collect(), *_FOUND) == want


def test_decontamination_edges(spark):
    items = [(1, "word word word"), (2, None), (3, "!!"), (None, "naïve Straße"), (4, "NAÏVE"), (4, "straße 漢字 tis"), (5, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("n_hit", F.lit(1))
    docs = odd_docs(spark)
    assert keyed(D.contamination(docs, bench, 2).collect(), *_FOUND) == sorted(_contaminated(ODD, items, 2), key=repr)
    assert {r.n_hit for r in D.contamination(docs, empty(bench), 2).collect()} == {0}
    assert D.contamination(empty(docs), bench, 2).count() == 0
    cleaned = D.remove_passages(docs, bench, 2).collect()
    assert not any(r[-1] for r in _contaminated([(r.doc_id, r.text) for r in cleaned], items, 2))
    assert {r.doc_id for r in cleaned} == {1, 2, 3, 4, 5, 8, None}          # 6 and 7 consist of passages only
    same = {r.doc_id: r for r in cleaned}
    assert same[1].text == ODD[0][1] and same[2].text is None and same[5].n_chars == len(same[5].text)


def test_cutting_searches_what_joins(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "z a a b c b c y"), (2, "a b d c")], "doc_id long, text string")
    got = {r.doc_id: r.text.split() for r in D.remove_passages(docs, bench, 3).collect()}
    assert got == {1: ["z", "y"], 2: ["a", "b", "d", "c"]}


def test_cutting_by_blocks_is_cutting_at_once(spark, monkeypatch):
    w = [f"w{i}" for i in range(1, 30)]
    items = [(1, " ".join(w[:15])), (2, " ".join(w[9:22])), (3, "a b c d e f g h i j"), (4, " ".join(w[22:24] * 5)), (5, " ".join(f"q{i}" for i in range(10)))]
    inner = f"a b c {items[4][1]} d e f g h i j"                 # joins to item 3 when item 5 is cut
    rows = [(1, " ".join(["x", *w[:22], "y"])), (2, f"x, {inner} - y"), (3, inner), (4, None), (5, "a b c"), (5, "a b c"),
            (6, f"{' '.join(w[:15])}; {items[2][1]}. {items[4][1]} end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")

    def got():
        return keyed(D.remove_passages(docs, bench, 10).collect(), "doc_id", "text", "n_chars")

    want = got()
    assert dict((i, t) for i, t, _ in want) == {1: "x  y", 2: "x,  - y", 4: None, 5: "a b c", 6: " end"}
    monkeypatch.setattr(D, "BLOCK_BYTES", 30)
    assert len(D.benchmark_blocks(bench, 10)) > 5
    assert got() == want
    full, table = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    parts = D.remove_passages(full, table, 10).collect()
    monkeypatch.setattr(D, "BLOCK_BYTES", 2 << 20)
    assert keyed(parts, *full.columns) == keyed(D.remove_passages(full, table, 10).collect(), *full.columns)


# ------------------------------------------------------------------ 10: near duplicates

def _sets(pairs, words):
    for d, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        yield d, {tuple(w[j:j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def _components_of(pairs, words, percent):
    sets = list(_sets(pairs, words))
    up = {d: d for d, _ in sets if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    return sorted(((d, len(x), d if d is None else root(d)) for d, x in sets), key=repr)


@pytest.mark.parametrize("words,percent,block", [(3, 85, 1 << 19), (5, 80, 1 << 19), (3, 85, 600), (2, 60, 3000)])
def test_near_duplicates(spark, monkeypatch, words, percent, block):
    import random
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ä", "B"]
    pairs = []
    for size, copies in ((2, 3), (5, 6), (30, 12), (120, 25), (120, 6), (400, 25), (30, 1), (120, 1)):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            share = rng.choice([0, 0, .005, .01, .02, .04])
            pairs.append((len(pairs), " ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base)))
    pairs += [(900, None), (901, ""), (902, " \t"), (903, "x"), (904, "X"), (905, "a b"), (None, "a b"), (3, pairs[40][1]), pairs[5], pairs[5]]
    rng.shuffle(pairs)
    monkeypatch.setattr(N, "BLOCK_SHINGLES", block)
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3).withColumn("component", F.lit(1)).withColumn("digest", F.lit("x"))
    got = N.near_duplicates(docs, N.Rule(words, percent)).collect()
    assert keyed(got, "doc_id", "n_shingles", "component_id") == _components_of(pairs, words, percent)
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in got)


def test_near_duplicates_of_the_table(spark, rows):
    got = Q.QUERIES["op10_near_duplicates"](spark, SF_SMALL).collect()
    assert keyed(got, "doc_id", "n_shingles", "component_id") == _components_of(rows, 3, 85)


def test_one_of_each_group_stays(spark):
    kept = N.keep_one(odd_docs(spark).union(odd_docs(spark).withColumn("doc_id", F.col("doc_id") + 100)), N.Rule())
    assert kept.columns == odd_docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 7, 8, 102, 103, 104]
    small = spark.createDataFrame([(1, "a b c"), (2, "A b c"), (3, "d")], "doc_id int, text string")      # another integer type
    assert sorted(r.doc_id for r in N.keep_one(small).collect()) == [1, 3]
    assert N.keep_one(empty(odd_docs(spark))).count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(i, 100) for i in range(101, 130)] + [(200, 200)]
    got = {tuple(r) for r in _components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(i, 100) for i in range(100, 130)}


# ------------------------------------------------------------------ 4: personal data

def test_base_data_of_the_table(spark, rows):
    got = {r.doc_id: r for r in Q.QUERIES["op4_personal_data"](spark, SF_SMALL).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        base = pii.base_spans(t or "")
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        r = got[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_bootstrapping_reaches_unseen_identifiers(spark):
    """Words around e-mails carry trust to keys in their company, and from there to new places; other tokens stay."""
    texts = [f"please write to u{i}@mail.example.com today" for i in range(30)]
    texts += [f"please write to password=ab{i}c{1000 + i}d00f today" for i in range(8)]          # company of the seeds
    texts += [f"zz{i} qq{i} password=ff{i}e{2000 + i}d11a yy{i}" for i in range(8)]               # only the key is known
    texts += [f"build number r{i}a-{30000 + i}-x00 done" for i in range(8)]                       # nothing is known
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_found for r in pii.personal_data(docs).collect()}
    assert [got[i] for i in range(30, 46)] == [1] * 16 and not any(got[i] for i in (*range(30), *range(46, 54)))
    red = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert red[0] == "please write to [EMAIL] today" and red[38] == "zz0 qq0 password=[ID] yy0" and red[46] == texts[46]


def test_short_identifiers_behind_a_trusted_key(spark):
    """Short tokens teach nothing, but a trusted key introduces them; elsewhere they stay."""
    texts = [f"account={100000 + i}@mail.example.com ok" for i in range(30)]
    texts += [f"please take account=ab{i:02}c{1000 + i}d00f today" for i in range(8)]
    texts += ["please take account=12345678 today", "passport account=C0123456 x", "number 12345678 stays", "account=1234 is too short"]
    texts += [f"write to k{i}@mail.example.com account=zz{i:02}y{3000 + i}d77a" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    red = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert red[38] == "please take account=[ID] today" and red[39] == "passport account=[ID] x"
    assert red[40] == texts[40] and red[41] == texts[41]


def _graph(texts):
    """The scoring in plain Python: pattern -> (confidence, support) after the last round."""
    edges, seeds = set(), set()
    for t in texts:
        base = pii.base_spans(t)
        for s, k, e in base:
            seeds.add((k, t[s:e]))
            edges |= {((k, t[s:e]), p) for p in pii.patterns(t, s, e)}
        for s, e in pii.other_tokens(t, base):
            if e - s >= pii.LEARNING:
                edges |= {(("id", t[s:e]), p) for p in pii.patterns(t, s, e)}
    score = {i: float(i in seeds) for i, _ in edges}
    for _ in range(pii.ROUNDS):
        by = {}
        for i, p in edges:
            by.setdefault(p, []).append(score.get(i, 0.0))
        trust = {p: (sum(x) / (len(x) + pii.SHRINK), len(x)) for p, x in by.items()}
        doubt = {}
        for i, p in edges:
            doubt[i] = doubt.get(i, 1.0) * (1 - trust[p][0])
        score = {i: 1.0 if i in seeds else 1 - d for i, d in doubt.items()}
    return {p: x for p, x in trust.items() if x[0] >= pii.CONFIDENCE and x[1] >= pii.SUPPORT}


def test_graph_equals_plain_python(spark, docs, rows):
    found = pii.candidates(docs, ["doc_id"])
    want = _graph([t or "" for _, t in rows])
    assert all(abs(c - pii.CONFIDENCE) > 1e-6 for c, _ in want.values())
    got = {r.pattern: (r.confidence, r.support) for r in pii.trusted_patterns(found).collect()}
    assert set(got) == set(want) and all(abs(got[p][0] - want[p][0]) < 1e-9 and got[p][1] == want[p][1] for p in want)
    spans = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    for d, t in rows:
        base = pii.base_spans(t or "")
        more = [f"id:{s}:{e}" for s, e in pii.other_tokens(t or "", base) if set(pii.patterns(t, s, e)) & set(want)]
        assert sorted(x for x in spans[d].split(",") if x.startswith("id:")) == sorted(more)


def test_personal_data_edges(spark):
    long_part = spark.createDataFrame([(1, "x 1.2.3." + "9" * 5000 + " y"), (2, "1.2.3." + "0" * 5000 + "7")], "doc_id long, text string")
    assert {r.doc_id: r.n_ip for r in pii.personal_data(long_part).collect()} == {1: 0, 2: 1}
    docs = odd_docs(spark)
    got = pii.personal_data(docs).collect()
    assert sorted((r.doc_id or -1, r.spans) for r in got if r.spans) == [(1, "phone:5:22,email:26:46")] and len(got) == len(ODD)
    red = pii.redacted(docs)
    assert red.columns == docs.columns
    back = {r.doc_id: r for r in red.collect()}
    assert back[1].text == "Call [PHONE] or [EMAIL]" and back[1].n_chars == 23 and back[2].text is None and back[6].text == ODD[6][1]
    assert pii.personal_data(empty(docs)).count() == 0 and pii.redacted(empty(docs)).count() == 0


# ------------------------------------------------------------------ 2: nearest neighbours

def _brute_nearest(ids, x, queries, k):
    for q in queries:
        score = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)).tolist() if i != q][:k]
        yield int(ids[q]), [int(ids[i]) for i in order], [float(score[i]) for i in order]


def test_recall_of_nearest(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = {}
    for r in Q.QUERIES["op2_nearest"](spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    found = total = 0
    for q, best, _ in _brute_nearest(ids, x, np.flatnonzero(ids % 20 == 0).tolist(), 20):
        own = sorted(got.pop(q))
        assert [n for n, _, _ in own] == list(range(1, 21)) and q not in {v for _, v, _ in own}
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        assert all(abs(s - float(x[ids == q][0] @ x[ids == v][0])) < 1e-12 for _, v, s in own)
        found += len(set(best) & {v for _, v, _ in own})
        total += 20
    assert not got and found / total >= 0.9


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0]), (4, [-2.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0]),
            (8, [nan, 1.0]), (9, [inf, 0.0]), (10, [None, 1.0]), (11, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit(1)).withColumn("query", F.lit("x"))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=3).collect()
    assert keyed(got, "query_id", "rank", "vec_id", "score") == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.5), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert len(ann.nearest(df, F.col("vec_id") % 20 == 0, k=50).collect()) == 5 + 5       # all candidates
    assert ann.nearest(empty(df), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id in (5, 7)"), F.lit(True)).count() == 0


def test_a_hot_vector_is_spread_over_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 50)
    rng = np.random.default_rng(3)
    x = np.concatenate((np.tile(rng.normal(size=4), (200, 1)), rng.normal(size=(200, 4))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q, best, _ in _brute_nearest(np.arange(400), x, [0, 50, 100, 150], 5):
        assert [v for _, v in sorted(got[q])] == best


def _share_scored(index, queries):
    """Part of the rows that lie in leaves which a query visits."""
    import itertools
    seen = [sum(int(index.held[leaf]) for leaf in itertools.islice(index.tree.visit(q), index.tree.visits)) for q in queries]
    return sum(seen) / len(seen) / int(index.held.sum())


def test_the_tree_grows_with_the_table(spark, monkeypatch):
    """Over a clustered table of ten times the rows a smaller share of them is scored, at the same recall; no leaf stays large."""
    monkeypatch.setattr(ann, "CELL_ROWS", 400)
    monkeypatch.setattr(ann, "PART_ROWS", 50)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(400, 8)) * 4
    x = centres[rng.integers(0, 400, 20_000)] + rng.normal(size=(20_000, 8)) * 0.4
    x[::7] = x[0]                                               # a hot vector, which no split parts
    x[::7] *= 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = [q for q in range(0, 20_000, 200) if q % 7]
    share, recall, index = {}, {}, None
    for rows in (2_000, 20_000):
        index = ann.build(df.where(F.col("vec_id") < rows), F.col("vec_id") % 200 == 0, 10, sample=400)
        own = [q for q in queries if q < rows]
        share[rows] = _share_scored(index, x[own])
        got = {}
        for r in ann.search(index, 10).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        best = {q: set(b) for q, b, _ in _brute_nearest(np.arange(rows), x[:rows], own, 10)}
        recall[rows] = sum(len(best[q] & got[q]) for q in own) / (10 * len(own))
    hot = index.tree.assign(x[:1])[0]
    assert sorted(index.held.tolist())[-2] <= 3 * 400 and index.held[hot] >= 20_000 // 7
    assert sorted(index.tree.visit(x[3])) == list(range(index.tree.leaves)) and index.held.sum() == 20_000
    assert share[20_000] < 0.7 * share[2_000] and min(recall.values()) >= 0.9, (share, recall)


def test_the_tree_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 50)
    monkeypatch.setattr(ann, "PART_ROWS", 10)
    monkeypatch.setattr(ann, "LEAF_SAMPLE", 20)
    monkeypatch.setattr(ann, "MAX_LEAVES", 90)
    x = np.random.default_rng(2).normal(size=(3000, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.build(df, F.col("vec_id") % 100 == 0, 5, sample=100)
    assert index.tree.leaves <= 2 * 90 and index.held.max() > 50 and ann.search(index, 5).count() == 150


@pytest.mark.parametrize("cell_rows", [4096, 40])
def test_copies_of_a_vector_take_one_place(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(ann, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    x[7] *= 9                                                    # a best neighbour of many, in 30 copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * 2 + [(7, x[7].tolist())] * 28 + [(8, (x[8] * (1 + j / 40)).tolist()) for j in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (0, 20, 40):
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float(np.dot(v, x[q])))
        want = sorted(best, key=lambda i: (-best[i], i))[:20]
        assert [v for _, v, _ in sorted(got[q])] == want
        assert all(abs(s - best[v]) < 1e-12 for _, v, s in got[q])


# ------------------------------------------------------------------ 5: URL filter

def test_url_filter_equals_its_sql(spark):
    import duckdb

    from tools.oracle_check import rows_of
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF_SMALL}/pages.parquet'")
    cur = con.execute(E.oracle_sql()["op5_url_filter"])
    df = Q.QUERIES["op5_url_filter"](spark, SF_SMALL)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want and any("true" in r for r in want)


def test_url_filter_edges(spark):
    captures = spark.createDataFrame(
        [(1, "http://A.b.example.com./x", "2024-02-10"), (1, "http://A.b.example.com./x", "2024-02-10"), (2, "https://u@b.example.com", "2024-02-10"),
         (3, "http://b.example.com:80/", "2024-02-29"), (4, "http://b.example.com/", "2024-03-01"), (5, "http://b.example.com/", "2024-01-31"),
         (6, None, "2024-02-10"), (7, "no url", "2024-02-10"), (8, "http://b.example.com/", None), (9, "http://localhost/", "2025-02-10"),
         (10, "http://notb.example.com/", "2024-02-10"), (11, "http://b.example.com/", "2024-04-05"), (None, "http://b.example.com", "2024-04-06")],
        "page_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date")).withColumn("entry", F.lit("x")).withColumn("month", F.lit(1))
    listings = spark.createDataFrame(
        [("B.example.com", "2024-02-01", True), ("b.example.com.", "2024-02-01", True), ("b.example.com", "2024-03-01", False),
         ("b.example.com", "2024-04-05", False), ("b.example.com", "2024-04-05", True), ("localhost", "2023-01-01", True),
         ("a.b.example.com", "2024-02-10", True), (None, "2024-01-01", True), ("", "2024-01-01", True), ("example.com", None, True)],
        "entry string, listed_on string, added boolean").withColumn("listed_on", F.col("listed_on").cast("date")).withColumn("host", F.lit("x"))
    got = keyed(U.judge(captures, listings).collect(), "page_id", "blocked", "n_active", "entry")
    assert got == sorted([(1, True, 2, "a.b.example.com")] * 2 + [
        (2, True, 1, "b.example.com"), (3, True, 1, "b.example.com"), (4, False, 0, None), (5, False, 0, None), (6, False, 0, None), (7, False, 0, None),
        (8, False, 0, None), (9, True, 1, "localhost"), (10, False, 0, None), (11, True, 1, "b.example.com"), (None, True, 1, "b.example.com")], key=repr)
    assert U.filter_captures(captures, listings).count() == 6
    assert not any(r.blocked for r in U.judge(captures, empty(listings)).collect()) and U.judge(empty(captures), listings).count() == 0


# ------------------------------------------------------------------ 8: chat formatting

def _conversations(turns):
    by = {}
    for c, t, r, x in sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    for c, own in by.items():
        loss = "".join(x for r, x in own if r == "assistant")
        yield (c, len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest(), len(loss),
               hashlib.sha256(loss.encode()).hexdigest())


_READ = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def test_chat_format_of_the_table(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, i, r, "\\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))]
    assert keyed(Q.QUERIES["op8_chat_format"](spark, SF_SMALL).collect(), *_READ) == sorted(_conversations(turns), key=repr)


def test_chat_format_edges(spark, monkeypatch):
    turns = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, None, None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a:#<\n\\"),
             (None, 0, "user", "x"), (None, 1, "assistant", ""), (2, 0, "assistant", "long " * 200_000), (3, 5, "a:\n### b", "</turn>\n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)).withColumn("loss", F.lit(1))
    formatted = chat.format_conversations(df)
    assert keyed(chat.read_back(formatted).collect(), *_READ) == sorted(_conversations(turns), key=repr)
    assert chat.format_conversations(empty(df)).count() == 0 and chat.read_back(empty(formatted)).count() == 0
    with pytest.raises(chat.TemplateError):
        chat.format_conversations(df, "{{ open('x') }}")


@pytest.mark.parametrize("source", [
    "<{% set a = 'x' %}{% for m in turns %}{{ loop.index0 }}{{ a }}{% if loop.first %}^{% endif %}{% generation %}{{ m.text }}{% endgeneration %}"
    "{{ ',' if not loop.last else '.' }}{% endfor %}>", chat.DEFAULT, "{% for m in turns %}{{ m.role }}{% endfor %}|{% for m in turns %}{{ m.text }}{% endfor %}",
    "{% if true %}{% for m in turns %}[{{ m.text }}]{% endfor %}{% endif %}"])
def test_turns_rendered_by_many_tasks_make_the_same_text(spark, monkeypatch, source):
    import runlens.operators._plan as plan
    monkeypatch.setattr(plan, "ranges_for", lambda df, n=None: 9)
    monkeypatch.setattr(chat, "PIECE", 40)
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t} é") for c, n in ((1, 120), (2, 1), (None, 3), (3, 2)) for t in range(n)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    pieces = {}
    for r in sorted(chat.format_conversations(df, source).collect(), key=lambda r: (str(r.conv_id), r.piece)):
        text, loss = pieces.get(r.conv_id, ("", []))
        pieces[r.conv_id] = (text + r.formatted, loss + [(x.start + len(text), x.end + len(text)) for x in r.loss])
    # A second loop over the turns of a stream finds none left.
    for conv, (text, loss) in pieces.items():
        own = [{"role": r, "text": x} for c, _, r, x in turns if c == conv]
        assert (text, loss) == chat.template(source).render(iter(own))


# ------------------------------------------------------------------ registration

def test_queries_are_registered():
    names = E.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and "pipeline" not in E.oracle_sql()
