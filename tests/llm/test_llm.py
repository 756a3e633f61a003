"""The training-data operators: brute force, round trips, held-out accuracy, odd tables."""

import collections
import dataclasses
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from callweave.llm import ann, brown, dedup, graph, jaccard, license, packing, quality, shard, spm, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, s int, row int, group int, label int, size int"
SPACE, WORD = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, 2, 3, 4, 5, 6) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(150)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    out = []
    for i in range(60):
        t = text(r.choice([1, 3, 6, 20, 60, 120]))
        out.append(t)
        if i % 3 == 0:
            w = t.split(" ")
            for _ in range(r.randint(1, 4)):
                x = list(w)
                for _ in range(max(1, len(x) // 30)):
                    x[r.randrange(len(x))] = r.choice(vocabulary)
                out.append("  ".join(x) if r.random() < 0.3 else " ".join(x).upper())
                out.append(t)
    passage = text(60)
    out += [passage + " " + text(4) for _ in range(80)]
    out += [None, "", "   \n", "a", "A", text(30_000), "x" * 50_000, "word " * 500]
    return [(i, t) for i, t in enumerate(out)] + [(3, out[3]), (None, "lost one"), (None, out[0])]


def near(rows):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = WORD.findall((t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
        sets[k] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    groups = collections.defaultdict(list)
    for k in sets:
        groups[top(k)].append(rows[k][0])
    small = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted((str(rows[k][0]), len(sets[k]), str(small[top(k)])) for k in sets)


@pytest.mark.parametrize("common,wide,rounds,chunk", [(24, 32, 3, 60_000), (4, 0, 0, 10), (10_000, 0.5, 1, 25), (8, 1000, 0, 60_000)])
def test_jaccard(spark, rows, monkeypatch, common, wide, rounds, chunk):
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "WIDE", wide)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "AGAIN", rounds // 2)
    monkeypatch.setattr(jaccard, "CHUNK_SETS", chunk)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "PART", 8)
    got = jaccard.near_duplicates(docs(spark, rows)).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == near(rows)


@pytest.mark.parametrize("held", [3, 1_000_000])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "HELD", held)
    r = random.Random(8)
    path = [(k, k + 1) for k in range(1000, 1060)]
    edges = path + [(2000, k) for k in range(2001, 2080)] + [(3080 - k, 3090) for k in range(60)] + [(r.randrange(150), r.randrange(150)) for _ in range(110)]
    edges = [(-x, -y) if k % 2 else (x, y) for k, (x, y) in enumerate(edges)] + path[::2] + [(7, 7), (9999, 9999)]
    r.shuffle(edges)
    of = {x: x for e in edges for x in e}
    for _ in of:
        for x, y in edges:
            of[x] = of[y] = min(of[x], of[y])
    linked = {x for x, y in edges if x != y} | {y for x, y in edges if x != y}
    got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert sorted((x.node, x.label) for x in got) == sorted((x, of[x]) for x in linked)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_t_occurrence():
    r = np.random.default_rng(1)
    sets = [np.sort(r.permutation(40)[:34]).astype(np.uint64) for _ in range(60)]
    want = {(i, j) for j in range(60) for i in range(j) if 7 * len(np.intersect1d(sets[i], sets[j])) >= 3 * (len(sets[i]) + len(sets[j]))}
    sets = [s.astype(np.int64) for s in sets]
    got = jaccard.t_occurrence(sets)
    assert {(i, j) for i, j, _ in got} == want and want
    assert all(o == len(np.intersect1d(sets[i], sets[j])) for i, j, o in got)
    tree = jaccard.t_occurrence(sets, forest=True)
    root = list(range(60))
    for links in (tree, got):
        before = len(set(root))
        for i, j, _ in links:
            root = [root[i] if x == root[j] else x for x in root]
    assert len(tree) == 60 - before and len(set(root)) == before  # a forest that joins all that links join


def test_dedup(spark, rows):
    got = dedup.exact_dedup(docs(spark, rows)).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(SPACE.sub(" ", t or "").encode()).hexdigest()].append(i)
    want = sorted((str(i), str(min((x for x in g if x is not None), default=None)), len(g), h) for h, g in groups.items() for i in g)
    assert sorted((str(x.doc_id), str(x.keep_id), x.group_size, x.text_sha256) for x in got) == want
    assert sum(x.kept for x in got) == len(groups)
    data = random.Random(2).randbytes(100_000)
    assert dedup.cuts(data)[-1] == len(data) and set(dedup.cuts(b"zz" + data)) & {c + 2 for c in dedup.cuts(data)}


def test_shard(spark, rows):
    got = shard.shard_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(x.grown_shard in (x.shard, 8) for x in got)
    for s in range(8):
        mine = sorted(x.slot for x in got if x.shard == s)
        assert mine == list(range(len(mine)))
    assert {(x.size, x.text_crc32) for x in got} == {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows}
    with pytest.raises(ValueError):
        shard.rendezvous(None, [0.0])
    import xxhash

    def winner(key, weights):  # recomputed with the hash library
        u = lambda i: ((xxhash.xxh64_intdigest(i.to_bytes(4, "little"), xxhash.xxh64_intdigest(key.encode(), 42)) >> 11) + 0.5) / (1 << 53)
        return max((-w / math.log(u(i)), i) for i, w in enumerate(weights) if w > 0)[1]

    assert all(x.shard == winner("\0null" if x.doc_id is None else str(x.doc_id), [1.0] * 8) and x.grown_shard == winner("\0null" if x.doc_id is None else str(x.doc_id), [1.0] * 9) for x in got)
    weights = [1.0, 3.0, 0.0, 0.5]
    many = shard.shard(spark.range(3000), "id", weights, [1.0, 3.0, 0.0, 1.5]).collect()
    assert all(x.shard == winner(str(x.id), weights) for x in many)
    share = collections.Counter(x.shard for x in many)
    assert share[2] == 0 and abs(share[1] / 3000 - 3 / 4.5) < 0.05 and abs(share[3] / 3000 - 0.5 / 4.5) < 0.03
    assert all(x.grown_shard in (x.shard, 3) for x in many)  # the shard that gained weight only takes keys


def test_packing(spark, rows):
    enc = tokens.encoder(tokens.default_path())
    want = {}
    for i, t in rows:
        ids = enc.encode(t) + bytes(4)
        for k, (s, n) in enumerate(packing.split(len(ids) // 4)):
            want.setdefault((i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])), 0)
            want[i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])] += 1
    got = packing.pack_documents(docs(spark, rows)).collect()
    assert collections.Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    by = collections.defaultdict(list)
    for x in got:
        by[x.sequence_id].append((x.offset, x.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.LENGTH
    whole = collections.defaultdict(list)
    for x in packing.pack_matrices(docs(spark, rows)).collect():
        ids, at = np.frombuffer(x.ids, "<u4"), np.frombuffer(x.positions, "<u4")
        assert len(ids) == len(at) == packing.LENGTH and x.cu_seqlens[-1] == x.n_tokens
        for d, s, lo, hi in zip(x.doc_ids, x.starts, x.cu_seqlens[:-1], x.cu_seqlens[1:], strict=True):
            assert at[lo:hi].tolist() == list(range(hi - lo))
            whole[d].append((s, ids[lo:hi].tobytes()))
    one = {i: t for i, t in rows if i not in (3, None)}
    assert all(b"".join(p for _, p in sorted(whole[i])) == enc.encode(t) + bytes(4) for i, t in one.items())


def test_fits():
    r = np.random.default_rng(3)
    for _ in range(30):
        sizes = r.integers(1, 100, r.integers(1, 80))
        plain = packing.best_fit_decreasing(sizes, 100)
        free, order = [], np.argsort(-sizes, kind="stable")
        for i in order:
            fit = [b for b, f in enumerate(free) if f >= sizes[i]]
            b = min(fit, key=lambda b: free[b]) if fit else len(free)
            free[b : b + 1] = [(free[b] if fit else 100) - sizes[i]]
        bins = packing.local_search(sizes, 100)
        assert plain.max() + 1 == len(free) and np.bincount(bins, sizes).max() <= 100 and bins.max() <= plain.max() + 1
        assert set(bins) == set(range(bins.max() + 1))
    sizes = np.array([6, 5, 5, 4, 3, 3, 2, 2])  # a worse start than best fit's is mended
    bins = packing.LocalSearch(sizes, np.array([0, 1, 2, 3, 1, 2, 0, 3]), 10).run()
    assert len(set(bins)) == 3 and np.bincount(bins, sizes).max() == 10
    sizes = np.minimum(r.exponential(600, 4000).astype(int) + 1, 2047)
    start = packing.best_fit(sizes)
    search = packing.LocalSearch(sizes, start)
    bins, least = search.run(), -(-sizes.sum() // 2048)
    assert search.emptied > 3 and search.moves and search.swaps and search.pairs  # the search does the work
    assert np.bincount(bins, sizes).max() <= 2048 and len(set(bins.tolist())) == start.max() + 1 - search.emptied <= 1.004 * least
    assert packing.local_search(sizes).max() + 1 <= 1.003 * least


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    for x in ["", " a", "it's  two", "a\n b", "é ☃ <|endoftext|> z", "x" * 3000]:
        assert np.frombuffer(tokens.encoder(tokens.default_path()).encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_sentencepiece(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.default_path())
    c = spm.codec(spm.default_path())
    odd = [t or "" for _, t in rows] + ["a  b", " x ", "▁a▁", "☃\x00é", "    deep"]
    assert [np.frombuffer(i, "<u4").tolist() for i in c.encode(odd)] == sp.encode(odd)
    merged = {x.doc_id: x.ids for x in spm.encode_documents(docs(spark, rows[:40]), kind_of=None).collect()}
    assert all(np.frombuffer(merged[i], "<u4").tolist() == sp.encode(t or "") for i, t in rows[:40])
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(open(spm.default_path(), "rb").read())
    proto.trainer_spec.model_type = spm.UNIGRAM
    uni = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    some = [(i, t) for i, t in rows if len(t or "") < 3000] + [(900, "a  b"), (901, "☃\x00é ☃"), (902, "unbelievable tokenization of antidisestablishmentarianism")]
    got = {x.doc_id: (np.frombuffer(x.ids, "<u4").tolist(), x.decoded) for x in spm.encode_documents(docs(spark, some)).collect() if x.doc_id not in (3, None)}
    assert all(got[i] == (uni.encode(t or ""), t or "") for i, t in some if i in got)
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(60_000))
    assert spm.codec(spm.default_path(), spm.UNIGRAM).decode(spm.codec(spm.default_path(), spm.UNIGRAM).encode([long])[0]) == long
    got = spm.encoding_digest(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(x.round_trip for x in got)
    v = spm.Vocabulary(("<unk>", "▁", "a", "b", "▁a", "ab", "ba", "▁ab"), (0.0, -2.0, -3.0, -3.0, -2.5, -2.0, -4.0, -5.0), (False,) + (True,) * 7, (-1,) * 256, 0, spm.UNIGRAM)
    code = spm.Codec(v)

    def best(s):
        if not s:
            return 0.0
        return max(v.scores[v.pieces.index(s[:k])] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in v.pieces)

    for s in ["ab", "aab", "abba", "bbb ab", "a"]:
        ids = np.frombuffer(code.encode([s])[0], "<u4")
        assert code.decode(ids.tobytes()) == s
        assert sum(v.scores[i] for i in ids) == pytest.approx(sum(best(u) for u in code.units(s)))


def test_sentencepiece_reads_the_vocabulary_once():
    """Words are encoded without going through the pieces or bytes again, whatever their lengths and characters."""

    class Counted(tuple):
        read = 0

        def __iter__(self):
            Counted.read += 1
            return super().__iter__()

    v = spm.Vocabulary.load(spm.default_path(), spm.UNIGRAM)
    plain = spm.Codec(v)
    code = spm.Codec(dataclasses.replace(v, plain=Counted(v.plain), byte=Counted(v.byte)))
    seen, texts = Counted.read, ["words of several lengths", "☃\x00é ☃☃ 日本語 \U0001f600"]
    assert code.encode(texts) == plain.encode(texts)
    assert Counted.read == seen


def test_sentencepiece_decodes_rows_together():
    """Rows of any ids, empty ones among them, are decoded together as their pieces say."""
    code, r = spm.codec(spm.default_path(), spm.UNIGRAM), np.random.default_rng(3)
    raw = code.raw.to_pylist()
    rows = [[], *[r.integers(0, len(raw), n).tolist() for n in (1, 0, 2, 300)], [code.v.unknown], [code.v.byte[0xC3]], []]
    joined = [b"".join(raw[i] for i in x).decode("utf-8", "replace") for x in rows]
    ids = [np.array(x, "<u4").tobytes() for x in rows]
    assert code.decode_all(ids) == [t.removeprefix(" ") for t in joined]
    assert code.decode_all([]) == [] and code.decode_all([b""]) == [""]


def test_brown(spark, rows):
    got = brown.score_documents(docs(spark, rows)).collect()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = [(i, [*WORD.findall((t or "").translate(low)), None]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = collections.Counter(w for i, ws in split if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for i, ws in split)
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 4)) for x in got) == want
    assert all(math.isfinite(x.score) and x.score < 0 for x in got)


@pytest.mark.parametrize("sent", [25, 150_000])
def test_brown_score_is_the_model(spark, rows, monkeypatch, sent):
    monkeypatch.setattr(brown, "SENT_WORDS", sent)
    df = docs(spark, rows)
    (m, _), own = brown.fit(df), lambda w: np.frombuffer(w.encode(), np.uint8)
    assert len(m.sent.keys) == min(sent, len(m.sent.keys)) > 10  # words are sent however many there are
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = [(i, WORD.findall((t or "").translate(low))) for i, t in rows]
    train = [ws for i, ws in split if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    c = collections.Counter(w for ws in train for w in ws)
    hashed = {w: int(brown.words(own(w), np.array([0, len(own(w))]))[0][0]) for _, ws in split for w in ws}
    place = {int(h): k for k, h in enumerate(m.sent.keys)}
    shape = {w: int(brown.shape(own(w), np.array([0]), np.array([len(own(w))]))[0]) for w in hashed}
    at = {w: int(m.sent.classes[place[hashed[w]]]) if hashed[w] in place else int(m.sent.shapes[shape[w]]) for w in hashed}
    k, add = brown.CLASSES, brown.ADD
    pairs = collections.Counter(p for ws in train for p in zip([0, *map(at.get, ws)], [*map(at.get, ws), 0], strict=True))
    total = collections.Counter(a for (a, _), n in pairs.items() for _ in range(n))
    trans = lambda a, b: math.log10((pairs[a, b] + add) / (total[a] + add * k))
    unit = collections.Counter({("end",): len(train)})
    for w, n in c.items():
        unit[(w,) if hashed[w] in place else ("shape", shape[w])] += n
    of = {("end",): 0, **{("shape", x): int(m.sent.shapes[x]) for x in range(brown.SHAPES)}, **{(w,): at[w] for w in c if hashed[w] in place}}
    sums = collections.Counter()
    for u, cls in of.items():
        sums[cls] += unit[u] + add
    mass, kinds = collections.Counter(), collections.Counter()
    for w, n in c.items():
        if hashed[w] not in place:
            mass[shape[w]] += n
            kinds[shape[w]] += 1

    def word(w):
        if hashed[w] in place:
            return math.log10((c[w] + add) / sums[at[w]])
        x = shape[w]
        return math.log10((unit["shape", x] + add) / sums[at[w]]) + math.log10((c[w] + add) / (mass[x] + add * (kinds[x] + 1)))

    want = [(str(i), round(sum(trans(a, b) for a, b in zip([0, *map(at.get, ws)], [*map(at.get, ws), 0], strict=True)) + sum(map(word, ws)) + math.log10((len(train) + add) / sums[0]), 3)) for i, ws in split]
    assert sorted((str(x.doc_id), round(x.score, 3)) for x in brown.score_documents(df).collect()) == sorted(want)
    for a in range(k):  # what follows any class, unseen words and all, sums to one
        if any(cls == a for cls in of.values()):
            rest = sum(unit[u] + add for u, cls in of.items() if cls == a) / sums[a]
            assert rest == pytest.approx(1)
        assert sum(10 ** trans(a, b) for b in range(k)) == pytest.approx(1)
    for x in mass:
        assert sum(c[w] + add for w in c if hashed[w] not in place and shape[w] == x) + add == pytest.approx(mass[x] + add * (kinds[x] + 1))


def test_reassigned_words_join_their_like():
    pairs = np.zeros((4, 4))
    pairs[1, 2] = pairs[2, 1] = 100
    pairs[3, 3], pairs[1, 1] = 200, 5
    pairs[3, 1] = pairs[1, 3] = pairs[3, 2] = pairs[2, 3] = 20
    context = np.zeros((2, 8), np.int64)
    context[0, 1], context[0, 4 + 1] = 20, 20  # stands between words of class 1, as class 2's do
    context[1, 2], context[1, 4 + 2] = 20, 20
    assert brown.best_classes(context, np.array([20, 20]), np.array([3, 3]), pairs).tolist() == [2, 1]


def test_exchange_parts_alternating_words():
    b = np.zeros((7, 7))
    for x in (0, 1, 2):
        for y in (3, 4, 5):
            b[x, y] = b[y, x] = 10
    at = brown.exchange(b, 3, fixed=6)
    assert len({*at[:3]}) == len({*at[3:6]}) == 1 and at[0] != at[3]


def test_ann(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((400, 16)) + 4 * r.standard_normal((10, 16))[r.integers(0, 10, 400)]
    x[50:70] = x[50]
    v = [(i, x[i].tolist(), 0) for i in range(400)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] + [1.0] * 15, 0), (904, [1.0, 2.0], 0), (905, [], 0)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, rank int")
    got = collections.defaultdict(list)
    for row in ann.knn(df.filter("vec_id % 20 = 0"), df, 10).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    hits = 0
    for q in range(0, 400, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(400), d))[:10]
        hits += len({i for i, _ in got[q]} & set(want.tolist()))
        assert all(s == pytest.approx(d[i]) for i, s in got[q]) and len(got[q]) == 10
    assert hits >= 0.9 * 200 and set(got) == set(range(0, 400, 20))


def test_quality(spark):
    r = random.Random(4)
    good = lambda: " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8))) for _ in range(80)) + "."
    bad = lambda: " ".join(r.choice(["$$$", "%%%", "BUY!!", "click", "###"]) for _ in range(80))
    y = [i % 3 != 0 for i in range(240)]
    d = docs(spark, [*[(i, good() if g else bad()) for i, g in enumerate(y)], (999, None), (998, ""), (None, "x")])
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(y)] + [(1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(d, labels).collect()
    assert len(got) == 243 and all(0 <= x.score <= 1 and x.predicted == (x.score >= quality.CUT) for x in got)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 240]
    assert sum(x.predicted == y[x.doc_id] for x in held) >= 0.95 * len(held) > 0
    assert all(math.isfinite(x.score) for x in quality.score_documents(d, labels.limit(0)).collect())


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software"
    cases = {"Text here\nReleased under the MIT License.": ["MIT"], "Licensed under the Apache License,\nVersion 2.0.": ["Apache-2.0"], mit: [], "No. All rights reserved.": ["Proprietary"], "": [], None: []}
    got = license.scan_licenses(docs(spark, list(enumerate(cases)))).collect()
    assert {x.doc_id: list(x.licenses) for x in got} == dict(enumerate(cases.values()))


def test_empty(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for got in (jaccard.near_duplicates(none), dedup.exact_dedup(none), shard.shard_documents(none), packing.pack_documents(none), packing.pack_matrices(none), spm.encoding_digest(none), brown.score_documents(none), quality.score_documents(none, labels), license.scan_licenses(none)):
        assert got.count() == 0
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.knn(v, v).count() == 0


def test_pipeline_stages(spark, rows, tmp_path):
    d = docs(spark, [r for r in rows if r[0] is not None])
    d.select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, f in corpus_pipeline.STAGES[:-1]:
        at = f(spark, at, str(tmp_path))
        assert at.columns == corpus_pipeline.COLUMNS
        at.cache()
    kept = [(x.doc_id, x.text) for x in at.collect()]
    comps = {i: c for i, _, c in near(kept)}
    assert all(i == c for i, c in comps.items()) and len(kept) > 10


def test_pipeline_keeps_rows_of_null_and_repeated_ids(spark, rows, tmp_path):
    few = docs(spark, [(3, "a X"), (5, "a X"), (5, "z Y"), (None, "q one"), (None, "q two"), (None, "q  two"), (None, "z Y")])
    assert sorted((str(x.doc_id), SPACE.sub(" ", x.text)) for x in corpus_pipeline.drop_copies(spark, few, "").collect()) == [("3", "a X"), ("5", "z Y"), ("None", "q one"), ("None", "q two")]
    at = corpus_pipeline.drop_copies(spark, docs(spark, rows), "")
    plain = lambda t: SPACE.sub(" ", t or "")
    first = [(x.doc_id, x.text) for x in at.collect()]
    assert sorted(plain(t) for _, t in first) == sorted({plain(t) for _, t in rows}) and (None, "lost one") in first
    left = [(x.doc_id, x.text) for x in corpus_pipeline.drop_near_copies(spark, at, "").collect()]
    groups = {(c, n > 0 or i) for i, n, c in near([(k, t) for k, (_, t) in enumerate(first)])}
    assert len(left) == len(groups) and len(near(left)) == len({(c, i) for i, _, c in near([(k, t) for k, (_, t) in enumerate(left)])})
    assert (None, "lost one") in left


def test_jaccard_counts_shared_shingles_of_long_lists(spark, monkeypatch):
    def sets(texts):
        for i, t in enumerate(texts.to_pylist()):
            yield i, np.array(sorted(map(int, (t or "").split())), np.uint64)

    monkeypatch.setattr(jaccard, "_sets", sets)
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    monkeypatch.setattr(jaccard, "AGAIN", 0)
    monkeypatch.setattr(jaccard, "WIDE", 1)
    line = lambda *parts: " ".join(str(x) for p in parts for x in p)
    both = [*range(1000, 1011), 2000, *range(5000, 5074)]  # 11 in short lists, one in a long list, 74 behind the prefix
    a, b = line(both, range(100, 114)), line(both, range(200, 214))
    other = [line([2000], range(9000 + 100 * k, 9099 + 100 * k)) for k in range(5)]
    got = jaccard.near_duplicates(docs(spark, list(enumerate([a, b, *other])))).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(0, 0), (1, 0)] + [(k, k) for k in range(2, 7)]


def test_ann_verifies_a_third_at_most():
    r = np.random.default_rng(9)
    x = r.standard_normal((6000, 64)) + 0.6 * r.standard_normal((40, 64))[r.integers(0, 40, 6000)]
    index, hits = ann.Index(np.arange(6000), x), 0
    for q in range(0, 6000, 200):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(index.search(q, x[q], 10)[0].tolist()) & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 300 and index.verified <= 30 * 6000 / 3


def test_ann_ties_and_lengths(spark):
    rows = [(i, [1.0, float(i % 3), 0.0]) for i in range(60)] + [(100 + i, [float(i + 1)] * 5) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.knn(df.filter("vec_id in (0, 100)"), df, 10).orderBy("query_id", "rank").collect()
    assert [(g.vec_id, g.score) for g in got if g.query_id == 0] == [(i, 0.0) for i in range(3, 33, 3)]
    assert [(g.rank, g.vec_id) for g in got if g.query_id == 100] == [(1, 101), (2, 102), (3, 103)]


def test_ann_repeated_ids(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((60, 8))
    v = [(i, x[i].tolist()) for i in range(60) for _ in range(30 if i == 7 else 2)] + [(8, (x[8] + 50).tolist())]
    x[7] = x[0] + 1e-3
    v = [(i, x[7].tolist() if i == 7 else e) for i, e in v]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").coalesce(1)
    got = [(g.vec_id, g.score) for g in ann.knn(df.filter("vec_id = 0"), df, 10).orderBy("rank").collect()]
    x[8] = min(x[8].tolist(), (x[8] + 50).tolist())
    d = np.sqrt(((x - x[0]) ** 2).sum(1))
    want = [int(i) for i in np.argsort(d) if i][:10]
    assert len({i for i, _ in got}) == 10 and len({i for i, _ in got} & set(want)) >= 9 and all(s == pytest.approx(d[i]) for i, s in got)


MIT = """MIT License

Copyright (c) 2020 A B

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""
BSD = """Copyright (c) 2020, A B

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


LGPL = GPL.replace("This program", "This library").replace("version 3", "version 2.1").replace("GNU General", "GNU Lesser General").replace("GNU\n    General", "GNU\n    Lesser General").replace("the\n    GNU", "the\n    GNU")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def test_whole_notices(spark):
    cases = {MIT: ["MIT"], MIT.replace("\n", "\r\n"): ["MIT"], GPL: ["GPL-3.0"], BSD: ["BSD-3-Clause"], BSD.rsplit("\n\n", 1)[0]: ["BSD-2-Clause"], BSD + "\n\n" + BSD.rsplit("\n\n", 1)[0]: ["BSD-2-Clause", "BSD-3-Clause"], GPL.replace("version 3", "version 2"): ["GPL-2.0"], LGPL: ["LGPL-2.1"], MPL: ["MPL-2.0"], "word " * 200_000 + "\n\n" + MIT + "\n" + MIT: ["MIT"], APACHE: ["Apache-2.0"]}
    got = license.scan_licenses(docs(spark, list(enumerate(cases)))).collect()
    assert {x.doc_id: list(x.licenses) for x in got} == dict(enumerate(cases.values()))


def test_pipeline_run(spark, rows, tmp_path):
    plain = lambda t: SPACE.sub(" ", t or "")
    for name, some in (("full", [*rows[:40], (None, "a b c"), (None, "other text"), (1, ""), (None, None), (2, " ")]), ("empty", [])):
        docs(spark, some).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        groups = near([(k, t) for k, (_, t) in enumerate(some)])
        want = len({c for _, n, c in groups if n}) + len({plain(some[int(k)][1]) for k, n, _ in groups if not n})
        assert sum(x.piece == 0 for x in got) == want
    kept = corpus_pipeline.keep_good(spark, docs(spark, rows[:5]), str(tmp_path / "full"))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")] and kept.count() == 5  # further columns stay


def test_quality_sample(spark):
    rows = [(1, "a good text here"), (1, "a good text here"), (2, "x" * 40_000), (4, "second of four"), (4, "first of four"), (6, None), (7, "   "), (8, "bad one")]
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 1, 0), (4, 1, 0), (6, 1, 0), (7, 0, 0), (8, 0, 0), (None, 0, 0), (8, 5, 0)], "doc_id long, quality int, toxic int")
    train = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5}
    got = {y: sorted(t.decode() for t in s) for y, s in quality.sample(docs(spark, rows), labels).items()}
    want = {1: [t for i, t in {*rows} if i in (1, 4) and i in train], 0: [t for i, t in rows if i == 8 and i in train]}
    assert got == {y: sorted(s) for y, s in want.items()}  # a label given twice counts once, long and blank texts not
    m = quality.fit(docs(spark, rows), labels)
    out = quality.score(docs(spark, [(1, "word " * 100_000), (2, None), (3, "")]).withColumnRenamed("key", "score"), m).collect()
    assert len(out) == 3 and all(0 <= x.score <= 1 for x in out)


def test_write_matrices(spark, rows, tmp_path):
    few = docs(spark, rows[:30])
    packing.write_matrices(few, str(tmp_path / "m"))
    got = {(x.sequence_id, bytes(x.ids)) for x in spark.read.parquet(str(tmp_path / "m")).collect()}
    assert got == {(x.sequence_id, bytes(x.ids)) for x in packing.pack_matrices(few).collect()} and got


def test_jaccard_clusters_of_one_list(spark):
    """Two clusters of near copies, whose members share a list with a text of neither."""
    for size in (3, 60, 200):
        r = random.Random(5)
        word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
        passage, left, right = ([word() for _ in range(40)] for _ in range(3))
        rows = [(f"{k}", " ".join([*passage, *side, *[word() for _ in range(3)]])) for k, side in ((a, b) for b in (left, right) for a in range(size))]
        rows.append(("x", " ".join([*passage, *[word() for _ in range(6)]])))
        rows = [(i, t) for i, (_, t) in enumerate(rows)]
        got = jaccard.near_duplicates(docs(spark, rows))
        assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got.collect()) == near(rows)
