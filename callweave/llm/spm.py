"""SentencePiece encoding and decoding in batched numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from callweave.llm.common import mix

U64 = np.uint64
SPACE = "▁"
CACHE_WORDS, BATCH_CELLS = 250_000, 1 << 18
UNIGRAM, BPE = 1, 2
_BASE = U64(0x9E3779B97F4A7C15)
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
FAR = np.int64(1) << np.int64(60)
_FIRST = U64(64 - 20)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores; kind UNIGRAM or BPE; byte[i] is the id of byte i or -1; unknown the id of no piece."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    plain: tuple[bool, ...]
    byte: tuple[int, ...]
    unknown: int
    kind: int
    prefix: bool = True

    @classmethod
    def load(cls, path: str, kind: int | None = None) -> Vocabulary:
        """From a model file whose normaliser is the identity without white-space removal; with `kind`, its pieces and
        scores as those of a model of that kind."""
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(raw)
        if proto.normalizer_spec.name not in ("identity", "") or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only the identity normaliser is supported")
        n = sp.get_piece_size()
        pieces = tuple(sp.id_to_piece(i) for i in range(n))
        byte = {p: i for i, p in enumerate(pieces) if sp.is_byte(i)}
        plain = tuple(not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n))
        return cls(pieces, tuple(sp.get_score(i) for i in range(n)), plain, tuple(byte.get(f"<0x{b:02X}>", -1) for b in range(256)), sp.unk_id(), kind or (BPE if proto.trainer_spec.model_type == BPE else UNIGRAM), proto.normalizer_spec.add_dummy_prefix)


class Codec:
    """Words of one length advance together. The hashes of all their substrings are probed in the sorted hashes of the
    pieces once, which gives a lattice of piece ids; ids come from it by Viterbi for unigram models, with vectorised
    maxima and backpointers (of equal sums the longer last piece wins), and by vectorised lowest-rank merges for BPE
    models, whose ids a maximal sum of scores doesn't give."""

    def __init__(self, v: Vocabulary):
        self.v = v
        ids = np.array([i for i, ok in enumerate(v.plain) if ok and v.pieces[i]])
        keys = np.array([self._hash(v.pieces[i]) for i in ids], U64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.maybe = np.zeros(1 << 20, bool)  # by a key's first 20 bits: has any piece such a key
        self.maybe[keys >> _FIRST] = True
        if len(keys) > 1 and (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.longest = max((len(v.pieces[i]) for i in ids), default=1)
        score = np.array(v.scores, np.float64)
        self.score = np.append(score, -np.inf)  # the last one is that of id -1, of no piece
        self.worst = min((score[i] for i, ok in enumerate(v.plain) if ok), default=0.0) - 10.0
        self.by_byte = min(v.byte) >= 0
        self.rank = np.empty(len(score), np.int64)
        self.rank[np.lexsort((np.arange(len(score)), -score))] = np.arange(len(score))
        raw = [bytes([v.byte.index(i)]) if i in v.byte else (b"" if not ok else p.replace(SPACE, " ").encode()) for i, (p, ok) in enumerate(zip(v.pieces, v.plain, strict=True))]
        raw[v.unknown] = " ⁇ ".encode()
        self.raw = pa.array(raw, pa.large_binary())
        self.whole = min((len(p) for i, p in enumerate(v.pieces) if v.plain[i] and SPACE in p[1:] and p.strip(SPACE)), default=0)
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _hash(s: str) -> int:
        h = np.zeros(1, U64)
        for c in s:
            h = h * _BASE + U64(ord(c) + 1)
        return int(mix(h)[0])

    def lattice(self, w: np.ndarray) -> np.ndarray:
        """[word, start, length - 1] -> id of that piece, or -1."""
        m, n = w.shape
        top = min(n, self.longest)
        out = np.full((m, n, top), -1, np.int64)
        h = np.zeros((m, n), U64)
        for k in range(top):
            h = h[:, : n - k] * _BASE + (w[:, k:] + 1).astype(U64)
            key = mix(h).ravel()
            some = np.flatnonzero(self.maybe[key >> _FIRST])  # most substrings end here
            at = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
            is_piece = self.keys[at] == key[some]
            word, start = np.divmod(some[is_piece], n - k)
            out[word, start, k] = self.ids[at[is_piece]]
        return out

    def merges(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece id or -1) of the symbols left when no merge is left; the merge of lowest rank goes
        first, the leftmost of equals. Only the prices beside a merge are made anew."""
        t = self.lattice(w)
        m, n = w.shape
        top = t.shape[2]
        rank = np.where(t >= 0, self.rank[t], FAR)
        end = np.tile(np.arange(1, n + 2), (m, 1))  # of the symbol that starts at a place; n + 1 past the last
        prev = np.tile(np.arange(-1, n), (m, 1))  # the symbol before a place
        alive = np.ones((m, n), bool)
        p = np.full((m, n), FAR)  # of merging a symbol with the next
        if top > 1:
            p[:, : n - 1] = rank[:, : n - 1, 1]
        left = np.arange(m)

        def price(a: np.ndarray, e: np.ndarray) -> np.ndarray:
            size = e - a
            got = rank[left, np.maximum(a, 0), np.minimum(size, top) - 1]
            return np.where((a >= 0) & (e <= n) & (size <= top), got, FAR)

        while len(left):
            at = p.argmin(1)
            go = p[np.arange(len(left)), at] < FAR
            if not go.all():
                left, at, p = left[go], at[go], p[go]
            row = np.arange(len(left))
            second = end[left, at]
            third = end[left, second]
            end[left, at] = third
            prev[left, third] = at
            alive[left, second] = False
            p[row, second] = FAR
            p[row, at] = price(at, end[left, third])
            before = prev[left, at]
            cost, has = price(before, third), before >= 0
            p[row[has], before[has]] = cost[has]
        row, start = np.nonzero(alive)
        stop = end[row, start]
        return row, start, stop, np.where(stop - start <= top, t[row, start, np.minimum(stop - start, top) - 1], -1)

    def viterbi(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece id or -1) of the pieces of the best path of each word, in order."""
        t = self.lattice(w)
        m, n = w.shape
        gain = self.score[t]
        gain[:, :, 0] = np.where(t[:, :, 0] >= 0, gain[:, :, 0], self.worst)
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((m, n + 1), np.int64)
        for e in range(1, n + 1):
            size = np.arange(min(e, t.shape[2]), 0, -1)
            reach = best[:, e - size] + gain[:, e - size, size - 1]
            back[:, e] = size[reach.argmax(1)]
            best[:, e] = reach.max(1)
        rows, stop, found = np.arange(m), np.full(m, n), []
        while len(rows):
            start = stop - back[rows, stop]
            found.append((rows, start, stop))
            rows, stop = rows[start > 0], start[start > 0]
        row, start, stop = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((start, row))
        row, start, stop = row[order], start[order], stop[order]
        return row, start, stop, t[row, start, stop - start - 1]

    def words(self, units: Iterable[str]) -> dict[str, bytes]:
        """Ids of each unit as little-endian unsigned 32-bit integers."""
        by: dict[int, list[str]] = {}
        for u in units:
            by.setdefault(len(u), []).append(u)
        out: dict[str, bytes] = {"": b""}
        run = self.merges if self.v.kind == BPE else self.viterbi
        for n, group in by.items():
            if not n:
                continue
            step = max(1, BATCH_CELLS // (n * min(n, self.longest)))
            for i in range(0, len(group), step):
                some = group[i : i + step]
                w = np.frombuffer("".join(some).encode("utf-32-le"), "<u4").reshape(len(some), n)
                row, start, stop, got = run(w)
                edge = np.searchsorted(row, np.arange(len(some) + 1))
                raw, at = got.astype("<u4").tobytes(), (4 * edge).tolist()
                for k, u in enumerate(some):
                    out[u] = raw[at[k] : at[k + 1]]
                odd = np.unique(row[got < 0]).tolist()  # words with characters that no piece has
                if odd:
                    edge, start, stop, got = edge.tolist(), start.tolist(), stop.tolist(), got.tolist()
                for k in odd:
                    ids: list[int] = []
                    for j in range(edge[k], edge[k + 1]):
                        if got[j] >= 0:
                            ids.append(got[j])
                        elif self.by_byte:
                            ids += [self.v.byte[b] for b in some[k][start[j] : stop[j]].encode()]
                        elif not ids or ids[-1] != self.v.unknown or self.v.kind == BPE:
                            ids.append(self.v.unknown)
                    out[some[k]] = np.array(ids, "<u4").tobytes()
        return out

    def units(self, text: str) -> list[str]:
        """Runs that no piece and no merge crosses: a word with the white-space mark before it."""
        if not text:
            return []
        line = (SPACE if self.v.prefix else "") + text.replace(" ", SPACE)
        return [line] if self.whole else _UNITS.findall(line)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.units(t or "") for t in texts]
        new = set().union(*split) - self.cache.keys()
        got = self.words(new)
        if len(self.cache) + len(got) > CACHE_WORDS:
            known = {u: self.cache[u] for s in split for u in s if u in self.cache}
            self.cache = {}
            look = known | got
        else:
            self.cache |= got
            look = self.cache
        out = [b"".join(map(look.__getitem__, s)) for s in split]
        if look is not self.cache and len(got) <= CACHE_WORDS:
            self.cache = got
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, the mark put before the first word left out."""
        return self.decode_all([ids])[0]

    def decode_all(self, ids: list[bytes]) -> list[str]:
        """The text of each row's ids; the pieces of all rows are looked up at once and lie joined then."""
        got = self.raw.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        edge = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids], dtype=np.int64)])
        at = np.frombuffer(got.buffers()[1], np.int64)[edge].tolist()
        data = memoryview(got.buffers()[2] or b"")
        texts = [str(data[a:b], "utf-8", "replace") for a, b in pairwise(at)]
        return [t[1:] if self.v.prefix and t[:1] == " " else t for t in texts]


@lru_cache(maxsize=2)
def codec(path: str, kind: int | None = None) -> Codec:
    return Codec(Vocabulary.load(path, kind))


def encode_documents(docs: DataFrame, path: str | None = None, kind_of: int | None = UNIGRAM) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (the text those ids give back) of every row; null
    text is empty and has no ids. Distinct words of a batch are encoded once; nothing is shuffled. `kind_of` says how
    ids come from the pieces: UNIGRAM by Viterbi over their scores, BPE by merges, None as the model file says."""
    path = path or default_path()
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, kind_of)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ids = c.encode(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(c.decode_all(ids), pa.string())], schema=kind)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def encoding_digest(docs: DataFrame, path: str | None = None, kind_of: int | None = UNIGRAM) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (unsigned), round_trip (the decoded text is the text) of every row: encode_documents'
    results summed up where they are made."""
    path = path or default_path()
    kind = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, kind_of)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                texts = whole.column(1).slice(at, 512).to_pylist()
                ids = c.encode(texts)
                cols = [[len(i) // 4 for i in ids], [zlib.crc32(i) for i in ids], [d == (t or "") for d, t in zip(c.decode_all(ids), texts, strict=True)]]
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(at, 512).cast(pa.int64()), *[pa.array(x, t) for x, t in zip(cols, kind.types[1:], strict=True)]], schema=kind)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
