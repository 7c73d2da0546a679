"""The operators' kernels against plain restatements, the named libraries or exact round trips (no Spark)."""
import base64
import itertools
import random
import re

import numpy as np
import pytest
import public_tokenizers as P

from runlens.llm import ann, bpe, chat, decontaminate as D, langid, neardup as N, pii, token_shards as T, wordpiece as W
from runlens.llm._slices import distinct, slice_keys

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


def _random_text(rng, alphabet, most):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, most)))


# ------------------------------------------------------------------ slices

def test_slice_keys_tell_slices_apart():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 3_000_000).astype(np.uint8)
    cut = np.unique(np.concatenate(([0, len(data)], rng.integers(0, len(data), 200_000))))
    starts, ends = cut[:-1], cut[1:]
    contents = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
    keys = slice_keys(data, starts, ends).tolist()
    assert len(set(keys)) == len(set(contents)) == len(set(zip(keys, contents)))
    model, number = distinct(data, starts, ends)
    assert [contents[i] for i in model[number].tolist()] == contents


def test_slices_longer_than_the_power_table_keep_their_key():
    data = np.tile(np.frombuffer(b"abcde", dtype=np.uint8), 1_200_000)
    n = 2_500_000
    a, b = slice_keys(data, np.array([0, 3_000_000]), np.array([n, 3_000_000 + n]))
    assert a == b
    assert slice_keys(data, np.array([1]), np.array([1 + n]))[0] != a


# ------------------------------------------------------------------ byte BPE

@pytest.fixture(scope="module")
def library():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(library):
    codec, rng = bpe.ByteBpe(RANKS), random.Random(3)
    alphabet = list("ab  '\n\tstmdrevl1 9²Ⅷ.,!\0é漢 \u2003\u3000😀'")
    for _ in range(150):
        texts = [_random_text(rng, alphabet, 40) for _ in range(20)]
        ids, counts, offsets = codec.encode(texts)
        at = 0
        for text, n in zip(texts, counts.tolist()):
            assert ids[at:at + n].tolist() == library.encode_ordinary(text)
            assert codec.decode(ids[at:at + n].tolist()).decode() == text
            assert all(0 <= o < len(text) for o in offsets[at:at + n].tolist())
            at += n


@pytest.mark.parametrize("text", ["", "a" * 5000, "ab" * 3000, " " * 3000 + "x", "ß" * 2000, "it's we'll I'M 's", "\r\n\r\n x"])
def test_bpe_long_slices_and_edges(library, text):
    assert bpe.ByteBpe(RANKS).encode([text])[0].tolist() == library.encode_ordinary(text)


def test_bpe_code_point_classes_are_the_librarys(library):
    """Every assigned code point between letters and between blanks."""
    codec = bpe.ByteBpe(RANKS)
    points = [chr(i) for i in itertools.chain(range(0x3000), range(0x1F000, 0x1F900))]
    text = "".join(f"a{c}b {c}1{c} " for c in points)
    assert codec.encode([text])[0].tolist() == library.encode_ordinary(text)


# ------------------------------------------------------------------ word pieces

def _greedy(word, first, rest):
    at = count = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (rest if at else first)), None)
        if end is None:
            return -1
        at, count = end, count + 1
    return count


def test_word_piece_lengths_are_greedy():
    rng = random.Random(1)
    piece = lambda most: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, most)))
    for _ in range(200):
        first, rest = {piece(5) for _ in range(rng.randint(1, 8))}, {piece(5) for _ in range(rng.randint(1, 12))}
        automaton = W.LongestMatch(first, rest)
        for _ in range(40):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14)))
            assert automaton.length(word) == _greedy(word, first, rest)


def test_word_pieces_of_the_public_vocabulary_cover_every_word():
    first, rest = map(set, W.pieces_of_ranks(RANKS))
    automaton = W.LongestMatch(*W.pieces_of_ranks(RANKS))
    for word in ["the", "Straße", "漢字", "x" * 3000, "password=bea36800c98e", "\0"]:
        assert automaton.length(word.encode()) == _greedy(word.encode(), first, rest) > 0


# ------------------------------------------------------------------ wavelet matrix and word tokenizer

@pytest.mark.parametrize("bits,n", [(1, 70), (3, 0), (3, 1), (5, 200), (16, 5000), (17, 300)])
def test_wavelet_matrix_answers_like_the_sequence(bits, n):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, min(1 << bits, 40), n).astype(np.uint16 if bits <= 16 else np.uint32)
    matrix = T.WaveletMatrix.build(ids, bits)
    assert np.array_equal(matrix.unpack(), ids)
    assert np.array_equal(matrix.access(np.arange(n)), ids)
    for token in range(min(1 << bits, 12)):
        assert matrix.count(token) == (ids == token).sum()
        assert matrix.count(token, n // 3, n // 2) == (ids[n // 3:n // 2] == token).sum()
        assert matrix.rank(token, n // 2) == (ids[:n // 2] == token).sum()
        assert np.array_equal(matrix.locate(token), np.flatnonzero(ids == token))
    keys, lengths, again = T.open_image(T.pack_image([None, 5], [n // 2, n - n // 2], ids, bits))
    assert keys == [None, 5] and lengths.tolist() == [n // 2, n - n // 2] and np.array_equal(again.unpack(), ids)


def test_word_tokenizer_equals_the_library():
    tok, rng = T.WordTokenizer(WORDS), random.Random(2)
    alphabet = list("abÄßÿ×÷µºª²¼ \t\n\x1c\x85\xa0\xad'''stmdrevl19.,!<|>éŒ漢İΣ")
    texts = [_random_text(rng, alphabet, 30) for _ in range(2000)]
    texts += [f"a{chr(i)}b {chr(i)} 1{chr(i)}'{chr(i)}" for i in range(256)] + ["", "<|endoftext|> x", "it's 's ''s we'll've"]
    for text, ids in zip(texts, tok.encode(texts)):
        assert ids.tolist() == tok.tokenizer.encode(text, add_special_tokens=False).ids, text


# ------------------------------------------------------------------ FM-index

def test_suffix_array_is_sorted():
    rng = random.Random(5)
    for _ in range(150):
        t = list(itertools.chain.from_iterable(
            [rng.randint(1, 4) for _ in range(rng.randint(0, 12))] * rng.randint(1, 3) + [0] for _ in range(rng.randint(1, 6))))
        key = lambda p: (t[p:t.index(0, p) + 1], p)
        assert D.suffix_array(np.array(t, dtype=np.int32)).tolist() == sorted(range(len(t)), key=key)


def _windows_found(texts, items, window):
    found = {}
    for item, text in items:
        w = D.words_of(text)
        for i in range(max(1, len(w) - window + 1) if w and item is not None else 0):
            found.setdefault(tuple(w[i:i + window]), set()).add(item)
    for text in texts:
        w, hit, own = D.words_of(text), set(), set()
        for key, ids in found.items():
            for i in range(len(w) - len(key) + 1):
                if tuple(w[i:i + len(key)]) == key:
                    hit.update(range(i, i + len(key)))
                    own |= ids
        yield len(w), len(hit), sorted(own)


def test_windows_are_found_in_whole_and_cut_shards(monkeypatch):
    rng = random.Random(7)
    vocabulary = ["the", "of", "a", "Ünder", "b1", "c", "zz"]
    for _ in range(120):
        window = rng.choice([1, 2, 3, 4])
        monkeypatch.setattr(D, "SHARD_WORDS", rng.choice([8, 20, 1 << 20]))
        monkeypatch.setattr(D, "SLICE_BYTES", rng.choice([10, 50, 1 << 20]))
        line = lambda most, v: " ".join(rng.choice(v) for _ in range(rng.randint(1, most)))
        items = [(rng.choice([1, 2, 3, 12, None]), rng.choice([None, "", line(6, vocabulary[:5])])) for _ in range(4)]
        texts = [rng.choice([None, "", "!!", line(40, vocabulary)]) for _ in range(6)]
        hits = D.Hits(texts, D.Phrases(items, window))
        assert list(zip(*(c.tolist() for c in hits.counts()), hits.items())) == list(_windows_found(texts, items, window))
        for raw, spans, n in zip(hits.raw, hits.spans(), hits.counts()[1].tolist()):
            assert sum(len(D.words_of(raw[a:b].decode())) for a, b in spans) == n


# ------------------------------------------------------------------ odd sketches

def test_sketch_estimates_similarity():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.85, 0.95, 1.0):
        off = []
        for _ in range(25):
            common = rng.integers(0, 1 << 63, int(1000 * share), dtype=np.uint64)
            rest = lambda: rng.integers(0, 1 << 63, 1000 - len(common), dtype=np.uint64)
            a, b = np.concatenate((common, rest())), np.concatenate((common, rest()))
            sketch = [N.odd_sketch(N.minhash(x)).view(np.uint64) for x in (a, b)]
            off.append(N.similarity(sketch[0], sketch[1][None])[0] - len(common) / (2000 - len(common)))
        assert abs(np.mean(off)) < 0.03 and np.abs(off).max() < 0.2


def test_bands_rarely_miss():
    for words, percent in ((3, 85), (5, 80), (2, 60)):
        rule = N.Rule(words, percent)
        bands, rows = rule.bands
        assert bands * rows <= N.SAMPLES and (1 - (percent / 100) ** rows) ** bands <= 1e-6
        assert 0 < rule.tie < percent / 100


def test_exact_links_connect_what_is_linked():
    rng = random.Random(9)
    for _ in range(60):
        sets = [np.array(sorted(rng.sample(range(14), rng.randint(1, 12))), dtype=np.uint64) for _ in range(rng.randint(2, 14))]
        forest, truth = N._Forest(), N._Forest()
        links = N.exact_links(list(range(len(sets))), sets, 70)
        assert len(links) < len(sets)
        for a, b in links:
            forest.join(a, b)
        for (i, a), (j, b) in itertools.combinations(enumerate(map(set, (s.tolist() for s in sets))), 2):
            if 100 * len(a & b) >= 70 * len(a | b):
                truth.join(i, j)
        assert [forest.root(i) for i in range(len(sets))] == [truth.root(i) for i in range(len(sets))]


# ------------------------------------------------------------------ personal data

_PLAIN = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _plain_spans(text):
    out = []
    for kind, pattern in enumerate(_PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            double = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            if [True, kind != 1 or all(int(x) <= 255 for x in m.group().split(".")),
                    14 <= len(digits) <= 19 and double % 10 == 0, 10 <= len(digits) <= 15][kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    for alphabet, most in (("ab.@-+1234 0(%_é٣", 40), ("0123456789  -.+", 60)):
        for _ in range(8000):
            text = _random_text(rng, alphabet, most)
            assert pii.base_spans(text) == _plain_spans(text), text


def test_long_runs_of_digits_are_linear():
    import time
    text = "7" * 1_000_000 + " " + "1." * 200_000
    began = time.perf_counter()
    assert not [x for x in pii.base_spans(text) if x[1] == 1 and x[0] < 1_000_000]
    assert time.perf_counter() - began < 3
    assert pii.base_spans("10.0.0.256 1.2.3.4.5.6.7.8 0300.1.1.1 0001.1.1.1")[:3] == [(11, 1, 18), (19, 1, 26), (38, 1, 48)]


def _thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_made_to_share_a_polynomial():
    """Different words with one slice key: the benchmark keeps both, shingles tell them apart."""
    from runlens.llm._slices import slice_keys
    a, b = _thue_morse(10)
    data = np.frombuffer(f"{a} {b}".encode(), dtype=np.uint8)
    keys = slice_keys(data, np.array([0, 1025]), np.array([1024, 2049]))
    assert keys[0] == keys[1]
    items = [(1, f"{a} one two"), (2, f"{b} one two"), (3, "plain words here")]
    phrases = D.Phrases(items, 3)
    texts = [f"x {a} one two y", f"{b} one two", f"{a} two", "plain words here"]
    found = D.Hits(texts, phrases)
    assert found.found.tolist() and {tuple(phrases.items[w]) for w in found.found.tolist()} == {(1,), (2,), (3,)}
    sets = N.shingle_sets([f"u v {a}", f"u v {b}", f"u v {a}"], 3)
    assert np.array_equal(sets[0], sets[2]) and not np.intersect1d(sets[0], sets[1]).size


def test_slice_table_with_more_slices_than_slots(monkeypatch):
    from runlens.llm._slices import SliceTable
    monkeypatch.setattr(SliceTable, "BYTES", 1 << 16)
    words = [f"w{i}".encode() for i in range(700_000)]
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum(list(map(len, words)))
    values, sizes = SliceTable(np.dtype(np.int32)).values(
        data, np.concatenate(([0], ends[:-1])), ends, lambda some: [np.array([int(x[1:])], dtype=np.int32).tobytes() for x in some])
    assert values.tolist() == list(range(700_000)) and set(sizes.tolist()) == {1}


def test_patterns_and_tokens_around_identifiers():
    text = 'call of password=bea36800c98e14 then token = "1beb58b8af68" me a@b.cd 12'
    tokens = pii.other_tokens(text, pii.base_spans(text))
    assert [text[a:b] for a, b in tokens] == ["bea36800c98e14", "1beb58b8af68"]
    assert pii.patterns(text, *tokens[0]) == ["key password=", "before of", "before call of", "behind then"]
    assert pii.patterns(text, *tokens[1]) == ["before =", "before token =", "behind me"]
    assert pii.patterns("x", 0, 1) == []
    assert pii.redact_text("a b c", [(0, "id", 3), (2, "email", 3)]) == "[ID] c"


# ------------------------------------------------------------------ language identification

def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    w = {"embed": rng.normal(0, .5, (256, langid.DIM)), "dense": rng.normal(0, .3, (langid.FILTERS * 3, 3)), "bias": np.zeros(3)}
    for k in langid.WIDTHS:
        w[f"conv{k}"], w[f"bias{k}"] = rng.normal(0, .3, (k * langid.DIM, langid.FILTERS)), np.full(langid.FILTERS, 0.1)
    x, y, weight = rng.integers(97, 123, (5, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.ones(5)

    def loss():
        p = langid.Model(["a", "b", "c"], w).probabilities(x)
        return -np.log(p[np.arange(5), y]).mean()

    grads = langid._gradients(w, x, y, weight)
    for name in ("embed", "dense", "bias", "conv2", "conv4", "bias3"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), w[name].shape)
        kept, step = w[name][at], 1e-4
        w[name][at] = kept + step
        up = loss()
        w[name][at] = kept - step
        down = loss()
        w[name][at] = kept
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-4), name


def test_windows_cover_the_whole_text():
    for n in (0, 1, 255, 256, 257, 1000):
        data = bytes(range(1, 256)) * 4
        assert langid.windows_of(data[:n]).tobytes().rstrip(b"\0") == data[:n]


# ------------------------------------------------------------------ nearest neighbours

def test_tree_reaches_every_leaf_and_every_vector():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 12))
    x[:400] = x[0]                                              # many equal vectors
    tree = ann.fit_tree(x, float(np.sqrt((x * x).sum(axis=1)).max()))
    leaf = tree.assign(x)
    assert sorted(tree.visit(x[3])) == list(range(tree.leaves)) and set(leaf.tolist()) <= set(range(tree.leaves))
    assert len(set(leaf[:400].tolist())) == 1
    visits = ann.calibrate(tree, x, 10)
    assert 1 <= visits <= tree.leaves


def test_cells_hold_whole_small_leaves_and_split_large_ones(monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 10)
    first, cells = ann._cells(np.array([4, 5, 3, 35, 0, 2]))
    assert first.tolist() == [0, 0, 1, 2, 6, 6] and cells.tolist() == [1, 1, 1, 4, 1, 1]


# ------------------------------------------------------------------ chat templates

def test_escape_is_reversible_and_free_of_marks():
    rng = random.Random(6)
    for _ in range(3000):
        text = _random_text(rng, "\\#<:\nhlcn>/é ", 30)
        said = chat.escape(text)
        assert chat.unescape(said) == text and not set("#<:\n") & set(said)


def test_default_template_round_trip():
    turns = [{"role": "user", "text": "\\### Assistant: </turn> ok"}, {"role": "assistant", "text": "a:b\n#x</turn>\\n"},
             {"role": "", "text": ""}, {"role": "assistant", "text": ""}, {"role": "a:\n</turn>\n### b", "text": "</turn>\n### c:\n"}]
    text, spans = chat.template(chat.DEFAULT).render(turns)
    assert chat.read_turns(text) == [(t["role"], t["text"]) for t in turns]
    assert [chat.unescape(text[a:b]) for a, b in spans] == [turns[1]["text"]]
    pieces = list(chat.template(chat.DEFAULT).pieces(turns, limit=1))
    assert len(pieces) == len(turns) and "".join(p for p, _ in pieces) == text


def test_template_language():
    source = ("{# c #}{% set a = 2 * 3 %}{% if 1 < 2 and not false %}x{{ 'A' ~ 1 | default(3) }}{% else %}y{% endif %}"
              "{% for m in turns %}{{ m.role|title }}{{ ', ' if not loop.last else '.' }}{% endfor %}{{ a }}{{ gone }}{{ turns }}")
    compiled = chat.Template(source.replace("{{ turns }}", ""))
    assert compiled.render([{"role": "user"}, {"role": "x"}])[0] == "xA1User, X.6"
    assert chat.fold(chat.parse("{% if 2 > 1 %}a{{ 1 + 1 }}{% else %}{{ b }}{% endif %}c")) == ("block", (("text", "a2c"),))
    folded = chat.fold(chat.parse("{% if false %}a{% elif b %}c{% else %}d{% endif %}"))
    assert folded == ("block", (("if", ((("name", "b"), ("block", (("text", "c"),))),), ("block", (("text", "d"),))),))


@pytest.mark.parametrize("bad", ["{{ a. }}", "{% for %}", "{{ x|os }}", "{% if a %}", "{{ a() }}", "{{ 'a' * 9 }}", "{{ }}",
                                 "{% import x %}", "{% generation %}{% for x in y %}{% endfor %}{% endgeneration %}"])
def test_templates_outside_the_language_are_refused(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad)


def test_templates_cannot_leave_their_data():
    assert chat.Template("{{ turns.__class__ }}{{ a.__init__ }}").render([])[0] == ""


# ------------------------------------------------------------------ slice table

@pytest.mark.parametrize("collide", [False, True])
def test_slice_table_gives_each_slice_its_value(monkeypatch, collide):
    from runlens.llm import _slices
    if collide:                                     # every key the same: the bytes decide
        monkeypatch.setattr(_slices, "slice_keys", lambda data, starts, ends: np.zeros(len(starts), dtype=np.uint64))
    rng = random.Random(8)
    table, made = _slices.SliceTable(np.int32), []

    def make(slices):
        made.extend(slices)
        return [np.array(list(x) * 2, dtype=np.int32).tobytes() for x in slices]

    for small in (False, True):                     # a table that starts over with every batch
        monkeypatch.setattr(_slices.SliceTable, "BYTES", 10 if small else 1 << 20)
        for _ in range(20):
            words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 4))).encode() for _ in range(50)]
            data = np.frombuffer(b"".join(words), dtype=np.uint8)
            ends = np.cumsum([len(w) for w in words])
            ids, sizes = table.values(data, ends - [len(w) for w in words], ends, make)
            assert ids.tolist() == [b for w in words for b in list(w) * 2] and sizes.tolist() == [2 * len(w) for w in words]
        if not small and not collide:
            assert len(made) == len(set(made)) <= 30
    assert table.values(data, ends[:0], ends[:0], make)[0].tolist() == []
