"""A compressed full-text index (FM-index, Ferragina and Manzini 2000) over a shard of short texts, in numpy.

The shard's Burrows-Wheeler transform is kept as bits with sampled counts; backward search runs for many
patterns at once. Texts end with code 0, which no pattern contains, so no match spans two texts."""

from __future__ import annotations

import io

import numpy as np

U1 = np.uint64(1)


def code_points(texts: list[str]) -> np.ndarray:
    """All texts one after another as uint32 code points, each followed by 0."""
    return np.frombuffer(("\0".join(t.replace("\0", "�") for t in texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)


class Alphabet:
    """Dense codes for the code points of a shard: 0 is the end of a text; rare ones beyond 61 share the last code,
    which makes matches looser, never fewer; 62 stands for what the shard lacks and never occurs."""

    def __init__(self, points: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            points, counts = np.unique(points, return_counts=True)
        keep = points != 0
        order = np.argsort(-counts[keep], kind="stable")
        top = np.sort(points[keep][order[:61]])
        self.points, self.size = top, 64
        self.all = np.sort(points[keep])

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Codes of code points; 62 where the shard lacks the point."""
        lut = np.full(0x110000, 62, np.uint8)
        lut[self.all] = 63
        lut[self.points] = np.arange(1, len(self.points) + 1, dtype=np.uint8)
        lut[0] = 0
        return lut[points]


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes, each read up to its text's end; equal suffixes in any order. Ten codes are
    packed into the first key, then ranks are doubled for the suffixes that are still tied."""
    n = len(codes)
    ends = np.flatnonzero(codes == 0)
    left = (ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)).astype(np.int32)  # codes before the end
    key = codes.astype(np.uint64)
    h = 10
    for j in range(1, h):
        nxt = np.zeros(n, np.uint64)
        nxt[:-1] = key[1:]
        key = (codes.astype(np.uint64) << np.uint64(6 * j)) | nxt
        key[codes == 0] = 0
    sa = np.argsort(key).astype(np.int32)
    ks = key[sa]
    new = np.ones(n, bool)
    new[1:] = ks[1:] != ks[:-1]
    del key, ks
    rank = np.empty(n, np.int32)
    first = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0)).astype(np.int32)
    rank[sa] = first
    del first
    while True:
        size_one = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~size_one)  # places in sa that are tied
        open_ = open_[left[sa[open_]] >= h]  # those that ended are equal, not tied
        if not len(open_):
            return sa
        pos = sa[open_]
        second = np.where(left[pos] >= h, rank[np.minimum(pos + h, n - 1)], -1).astype(np.int64)
        pair = rank[pos].astype(np.int64) * (n + 1) + second + 1
        o = np.argsort(pair, kind="stable")
        # a tied group with ended and open suffixes: ended ones have equal keys below; they keep the front places
        pos, pair = pos[o], pair[o]
        groups = rank[pos]
        starts = np.ones(len(pos), bool)
        starts[1:] = groups[1:] != groups[:-1]
        begin = np.flatnonzero(starts)
        length = np.diff(np.append(begin, len(pos)))
        # the open suffixes of a group take its last places
        gsize = np.bincount(np.cumsum(new) - 1)
        gid = (np.cumsum(new) - 1)[groups[begin]]
        at0 = groups[begin] + gsize[gid] - length
        places = np.repeat(at0, length) + np.arange(len(pos)) - np.repeat(begin, length)
        # the ended ones of the group move to the front
        mixed = np.flatnonzero(gsize[gid] != length)
        for g in mixed:
            a, b = groups[begin[g]], groups[begin[g]] + gsize[gid[g]]
            ended = sa[a:b][left[sa[a:b]] < h].copy()
            sa[a : a + len(ended)] = ended
        sa[places] = pos
        fresh = np.ones(len(pos), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        new[places[fresh]] = True
        rank[pos] = places[np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0))]
        h *= 2


class FMIndex:
    """The BWT as a bit vector for each code, with counts sampled every 64 places, and the text of each place. Stored
    it takes six bits and three bytes a place."""

    def __init__(self, points: np.ndarray, bwt: np.ndarray, doc: np.ndarray) -> None:
        self.alphabet = Alphabet.__new__(Alphabet)
        self.alphabet.points, self.alphabet.all, self.alphabet.size = points[0], points[1], 64
        self.bwt, self.doc, self.n = bwt, doc, len(bwt)
        blocks = self.n // 64 + 1
        total = np.bincount(bwt, minlength=64)
        self.before = np.concatenate([[0], np.cumsum(total)[:-1]]).astype(np.int64)
        # for each code that occurs a bit vector and its count before each word; the others share an empty row
        used = np.flatnonzero(total)
        self.row = np.zeros(64, np.int64)
        self.row[used] = np.arange(1, len(used) + 1) * blocks
        self.bits = np.zeros((len(used) + 1, blocks), np.uint64)
        self.counts = np.zeros((len(used) + 1, blocks), np.int32)
        hit = np.zeros(blocks * 64, bool)
        for r, c in enumerate(used, 1):
            np.equal(bwt, c, out=hit[: self.n])
            self.bits[r] = np.packbits(hit, bitorder="little").view(np.uint64)
            n = np.bitwise_count(self.bits[r])
            np.cumsum(n[:-1], out=self.counts[r, 1:])
        self.bits, self.counts = self.bits.ravel(), self.counts.ravel()
        self._lo, self._hi = self._heads()

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.bits, self.counts, self.doc, self.bwt, self._lo, self._hi))

    def _heads(self) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of all patterns of three codes, so that a search starts at its fourth."""
        lo, hi = np.zeros(1, np.int64), np.full(1, self.n, np.int64)
        for _ in range(3):  # prepend every code; the newest is the highest digit
            c = np.repeat(np.arange(64), len(lo))
            lo, hi = self.step(c, np.tile(lo, 64), np.tile(hi, 64))
        return lo, hi

    @classmethod
    def build(cls, texts: list[str]) -> "FMIndex":
        points = code_points(texts)
        alphabet = Alphabet(points)
        codes = alphabet.codes(points)
        sa = suffix_array(codes)
        doc_of = np.cumsum(codes == 0) - (codes == 0)
        return cls((alphabet.points, alphabet.all), codes[sa - 1], doc_of[sa].astype(np.int32))

    def width(self) -> int:
        """Bytes of the largest text number; three as long as there are less than 16.7 million texts."""
        return 3 if not len(self.doc) or int(self.doc.max()) < 1 << 24 else 4

    def dump(self) -> bytes:
        """BWT at six bits and the text numbers at as many bytes a place as they need."""
        out = io.BytesIO()
        pad = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        pad[: self.n] = self.bwt
        planes = np.stack([np.packbits((pad >> j) & 1, bitorder="little") for j in range(6)])
        np.savez(out, top=self.alphabet.points, all=self.alphabet.all, n=np.array([self.n]), planes=planes, doc=np.stack([(self.doc >> s).astype(np.uint8) for s in range(0, 8 * self.width(), 8)]))
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> "FMIndex":
        z = np.load(io.BytesIO(blob))
        n, planes = int(z["n"][0]), z["planes"]
        bwt = np.zeros(planes.shape[1] * 8, np.uint8)
        for j in range(6):
            bwt |= np.unpackbits(planes[j], bitorder="little") << j
        d = z["doc"]
        doc = np.zeros(d.shape[1], np.int32)
        for i, plane in enumerate(d):
            doc |= plane.astype(np.int32) << (8 * i)
        return cls((z["top"], z["all"]), bwt[:n], doc)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of code c among the first i places of the BWT."""
        at = self.row[c] + (i >> 6)
        m = (U1 << (i & 63).astype(np.uint64)) - U1
        m &= self.bits[at]
        return self.counts[at] + np.bitwise_count(m)

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: intervals of cP from those of P."""
        base = self.before[c]
        return base + self.rank(c, lo), base + self.rank(c, hi)

    def factors(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cut patterns, from their ends, into factors: each is extended backward until at most `most` places match.
        Patterns lie in codes[start:end]. Returns pattern number, interval lo and hi, and length of each factor; the
        unfinished head of a pattern is left out."""
        k = len(start)
        out = []
        p = end.astype(np.int64)  # place behind the next code to read
        live = np.flatnonzero(p - start >= 3)
        lo, hi, since = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int32)

        def begin(who: np.ndarray) -> None:
            """Read the last three codes at once."""
            q = p[who]
            word = (codes[q - 3].astype(np.int64) << 12) | (codes[q - 2].astype(np.int64) << 6) | codes[q - 1]
            lo[who], hi[who], since[who] = self._lo[word], self._hi[word], 3
            p[who] = q - 3

        begin(live)
        while len(live):
            small = hi[live] - lo[live] <= most
            if small.any():
                d = live[small]
                out.append((d, lo[d], hi[d], since[d].copy()))
                again = d[p[d] - start[d] >= 3]
                begin(again)
                # those just begun are looked at in the next turn
                go = live[~small]
                live = np.concatenate([go[p[go] > start[go]], again])
                step = go[p[go] > start[go]]
            else:
                live = live[p[live] > start[live]]
                step = live
            if len(step):
                q = p[step] - 1
                lo[step], hi[step] = self.step(codes[q], lo[step], hi[step])
                p[step] = q
                since[step] += 1
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z, z
        return tuple(np.concatenate(x) for x in zip(*out))
