"""Cross-tokenizer alignment, SimHash near-duplicates and the source divergence audit against brute force."""

import collections
import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from callweave.llm import align, divergence, simhash, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, unit string, fp long, row int, term string, n int, block int, vector int, deal int, `group` int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def docs(spark, rows):
    """(doc_id, text, lang, source) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "u", 2, 3, "t", 4, 5, 6, 7, 8) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdeéßЖ日") for _ in range(r.randint(1, 6))) for _ in range(120)] + ["it's", "<|endoftext|>", "<s>", "<0x41>", "don't", "12,5", "¼", "Äh", "İ", "👍🏽"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    out = [(i, text(r.choice([1, 2, 3, 8, 40, 100])), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "é", None])) for i in range(70)]
    base = text(300).split(" ")
    for i in range(40):  # near copies, of which many share fingerprint bits
        w = list(base)
        for _ in range(i % 5):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append((100 + i, (" " if i % 2 else "\n").join(w), "en", "a"))
    odd = [None, "", " ", "   \n\t ", "a", "A", "A b", "two  blanks and\ttab\r\n  ends ", " lead", "x▁y z", "\x00 nul \x1c sep \x85 next", text(8000), "y" * 20_000, "Word " * 700, "日本語" * 50]
    out += [(200 + i, t, "de", "b") for i, t in enumerate(odd)]
    return out + [out[0], (3, "other words here", "en", "a"), (None, "lost one", "en", "c"), (None, out[5][1], None, None), (300, None, "xx", "lonely"), (301, "one two", "yy", "p"), (302, "", "yy", "q")]


def joined(texts, name, path):
    """Tokens of each text as the libraries give them: (ids, bytes)."""
    if name == "a":
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        byte, piece = tokens._bytes_of(), {i: p for p, i in t.get_vocab().items()}
        ids = [t.encode(" " + x, add_special_tokens=False).ids for x in texts]
        return [(i, [bytes(byte[c] for c in piece[k]) for k in i]) for i in ids]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = lambda k: bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode()
    return [(i, list(map(raw, i))) for i in map(sp.encode, texts)]


def alignment(rows):
    import public_tokenizers as P

    texts = [t or "" for _, t, *_ in rows]
    found, count = [], collections.Counter()
    for t, (a, ra), (b, rb) in zip(texts, joined(texts, "a", P.path("byte_bpe_50k.json")), joined(texts, "b", P.path("piece_bpe_32k.model")), strict=True):
        if not t or b"".join(ra) != (" " + t).encode() or b"".join(rb) != (" " + t).encode():
            found.append(None)
            continue
        at, groups, links, i, j = 0, [], [], 0, 0
        ends_a, ends_b = (list(itertools.accumulate(map(len, r))) for r in (ra, rb))
        for e in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links.append((a[x - 1], b[y - 1]))
            i, j, at = x, y, e
        assert at == len((" " + t).encode())
        count.update(links)
        found.append((len(a), len(b), groups, links))
    most = collections.Counter()
    for (_, y), c in count.items():
        most[y] = max(most[y], c)
    zero = (0, 0, 0, 0, 0, 0, "")
    return sorted(((r[0], *(zero if f is None else (f[0], f[1], len(f[2]), len(f[3]), sum(count[p] == most[p[1]] for p in f[3]), sum(count[p] for p in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()))) for r, f in zip(rows, found, strict=True)), key=str)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("block", [1 << 24, 2000])
def test_align(spark, rows, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK_BYTES", block)
    got = align.align(docs(spark, rows).repartition(3))
    assert sorted((tuple(r) for r in got.select(NAMES).collect()), key=str) == alignment(rows)
    assert {t for n, t in got.dtypes if n not in ("doc_id", "groups_sha256")} == {"bigint"}


def block_of(n, kinds, cuts):
    """What meets for a block: documents of n pieces in all, cut at `cuts`, and a table of `kinds` pieces."""
    unit = pa.array([f" word{i}" for i in range(kinds)])
    number = np.random.default_rng(5).integers(0, kinds, n)
    lists = pa.ListArray.from_arrays(pa.array([0, *cuts, n], pa.int32()), unit.take(pa.array(number)))
    docs = pa.table({"doc_id": pa.array(range(len(cuts) + 1), pa.int64()), "units": lists})
    sums = {c: pa.array(np.arange(kinds) * k) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_best", "count_sum"), 1)}
    return docs, pa.table({"unit": unit, **sums, "groups": pa.array([f"{i}|{i}" for i in range(kinds)])}), number


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_align_documents_in_slices(monkeypatch, size):
    """Documents come out the same however their pieces are sliced, a document over many slices and batches too."""
    monkeypatch.setattr(align, "SLICE_BYTES", size, raising=False)
    cuts = [1, 2, 300, 310, 311]
    docs, table, number = block_of(400, 50, cuts)
    for some in (docs, pa.concat_tables([docs.slice(0, 3), docs.slice(3, 0), docs.slice(3)]), docs.slice(0, 0)):
        got = align._told(some, table).to_pydict()
        edges = list(itertools.pairwise([0, *cuts, 400]))[: some.num_rows]
        assert got["groups_sha256"] == [hashlib.sha256(";".join(f"{i}|{i}" for i in number[a:b]).encode()).hexdigest() for a, b in edges]
        for k, c in ((1, "n_a"), (2, "n_b"), (3, "n_groups"), (3, "n_links"), (4, "n_best"), (5, "count_sum")):
            assert got[c] == [k * int(number[a:b].sum()) for a, b in edges]


def test_align_holds_little_beside_a_block():
    """A block's documents are put together without a copy of the block and with nothing wide for each of its pieces."""
    docs, table, _ = block_of(1_500_000, 2_000, range(1000, 1_500_000, 1000))
    before = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(before)
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        align._told(docs, table)
        held = tracemalloc.get_traced_memory()[1] + pool.max_memory()
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(before)
    assert held < 1.5 * docs.nbytes


def test_align_unforeseen_texts(spark, rows, monkeypatch):
    """Texts that turn out not to be given back leave the counts, however they are told."""
    monkeypatch.setattr(align, "MARK", "\x7f\x7f")
    monkeypatch.setattr(align.spm, "SPACE", "▁")
    some = [(1, "plain words", "en", "a"), (2, "plain x▁y words", "en", "a"), (None, "also ▁ odd", "en", "a")]
    real = align.encoded

    def encoded(units, *paths):
        with monkeypatch.context() as m:
            m.setattr(align, "MARK", "▁")
            return real(units, *paths)

    monkeypatch.setattr(align, "encoded", encoded)
    got = align.align(docs(spark, some))
    monkeypatch.setattr(align, "MARK", "▁")
    assert sorted((tuple(r) for r in got.select(NAMES).collect()), key=str) == alignment(some)


def test_align_no_rows(spark):
    assert align.align(docs(spark, [])).collect() == []
    assert [tuple(r)[1:] for r in align.align(docs(spark, [(1, None, "en", "a")])).select(NAMES).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def simhash_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints):
    """The component of each of some fingerprints, by all pairs."""
    label = {p: p for p in prints}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 2:
                label[top(a)] = top(b)
    return {p: top(p) for p in prints}


@pytest.mark.parametrize("crowd", [64, 2])
def test_simhash(spark, rows, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    prints = [simhash_of(t) for _, t, *_ in rows]
    label = linked(set(prints))
    first = {}
    for (i, *_), p in zip(rows, prints, strict=True):
        first[label[p]] = min([x for x in (i, first.get(label[p])) if x is not None], default=None)
    want = sorted(((i, f"{p:016x}", first[label[p]]) for (i, *_), p in zip(rows, prints, strict=True)), key=str)
    got = simhash.near_duplicates(docs(spark, rows))
    assert sorted((tuple(r) for r in got.select("doc_id", "fingerprint", "component_id").collect()), key=str) == want
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


@pytest.mark.parametrize("crowd", [10_000, 3, 1])
def test_links_of_dense_fingerprints(spark, monkeypatch, crowd):
    """Clusters so dense that most keys are crowded, and fingerprints just too far apart."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(3)
    prints = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(25):
            y = x
            for b in r.sample(range(64), r.choice([1, 2, 3, 4])):
                y ^= 1 << b
            prints.add(y)
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    got = [(signed[a], signed[b]) for a, b in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    label = linked(prints)
    mine = {p: p for p in prints}
    for _ in prints:
        for a, b in got:
            mine[a] = mine[b] = min(mine[a], mine[b])
    assert len(set(mine.values())) == len(set(label.values()))
    assert {frozenset(p for p in prints if mine[p] == x) for x in mine.values()} == {frozenset(p for p in prints if label[p] == x) for x in label.values()}


def audit(rows):
    by, df = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOWER))
        by[lang, source].update(found)
        df[lang].update(set(found))
    kept = {lang: {t for t, n in c.items() if n >= 3} for lang, c in df.items()}
    n = {g: sum(x for t, x in c.items() if t in kept[g[0]]) for g, c in by.items()}
    p = lambda g, t: 1 + 10**9 * (by[g][t] + 1) // (n[g] + len(kept[g[0]]))
    out = []
    for lang, source in list(by):
        g, v = (lang, source), len(kept[lang])
        pairs = [(sum((p(g, t) - p((lang, o), t)) ** 2 // p((lang, o), t) for t in kept[lang]), o) for x, o in by if x == lang and o != source]
        whole = sum(x for k, x in n.items() if k[0] == lang)
        terms = []
        for t in kept[lang]:
            q = 1 + 10**9 * (sum(by[k][t] for k in by if k[0] == lang) + 1) // (whole + v)
            if by[g][t] and p(g, t) > q:
                terms.append(((p(g, t) - q) ** 2 // q, t))
        for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
            out += [(lang, source, part, o, x, k + 1) for k, (x, o) in enumerate(sorted(found, key=lambda y: (-y[0], y[1].encode()))[:most])]
    return sorted(out)


@pytest.mark.parametrize("held,sent", [(400_000, 100_000), (20, 0)])
def test_audit(spark, rows, monkeypatch, held, sent):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "SENT_GROUPS", sent)
    got = divergence.audit(docs(spark, rows).repartition(3))
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == audit(rows)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_audit_bounds(spark):
    """No rows; terms in two documents only; over 200 terms; counts whose product with the unit leaves 64 bits."""
    assert divergence.audit(docs(spark, [])).collect() == []
    few = [(1, "a b", "en", "x"), (2, "a b", "en", "y")]
    assert sorted(tuple(r) for r in divergence.audit(docs(spark, few)).collect()) == audit(few) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    letters = "abcdefghijklmnopqrst"
    many = [(i, " ".join(a + b for a in letters for b in letters if s == "x" or a < "d"), "en", s) for i, s in enumerate(["x", "x", "x", "y", "y", "y"])]
    got = sorted(tuple(r) for r in divergence.audit(docs(spark, many)).collect())
    assert got == audit(many) and sum(r[2] == "term" for r in got) > 200
    big = spark.range(1).select(divergence.share(divergence.F.lit(10**15), divergence.F.lit(3 * 10**15), divergence.F.lit(7)))
    assert big.first()[0] == 1 + 10**9 * (10**15 + 1) // (3 * 10**15 + 7)
