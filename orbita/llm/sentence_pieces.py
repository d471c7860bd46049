"""SentencePiece encoding and decoding: Viterbi, batched in numpy.

Distinct words of equal length advance together.  Hashes of all their
substrings (from prefix hashes) probe the sorted hashes of the pieces at once.
Then, position by position, a vectorised maximum over the lengths of the last
piece finds the best way to each position and stores its back-pointer.

* Unigram models: a piece adds its score.
* BPE models: a step from one piece to the next is worth 0 if both stay side by
  side when the two are merged from characters, and minus infinity if a merge
  would cross between them.  Whether one does is read from the pieces' own
  histories (``_apart``).  Merges work locally, so the ids of the whole are the one
  way whose steps are all possible: the maximum has no ties, and it is what the
  merges give.  This needs pieces that are made of better ones, which is checked;
  for other models the merges themselves are made, round by round.

Both give the ids that the sentencepiece library gives.  Time and memory are
linear in the length of a word, for models of the first two kinds.

Texts are cut into words where no piece can cross: before a run of spaces and
around newlines (checked against the pieces).  A bounded dictionary in each
worker keeps words that were seen.

Defined results: null or empty text has no ids and decodes to the empty string;
of ways of equal score the one whose last piece starts first wins (unigram);
repeated rows are encoded each; empty tables give no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Candidates for marks before which no piece goes on.
MARKS = ".,;:!?%#$&*|\"()"
CACHED = 300_000
MEMO = 20  # bits of a place in the table of pairs of pieces
NORMAL, UNKNOWN, BYTE = 1, 2, 6
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Pieces:
    """A model: pieces as (text, score, kind) with the library's kinds; unigram or BPE."""

    def __init__(self, pieces: list[tuple[str, float, int]], unigram: bool, dummy_prefix: bool = True):
        self.unigram, self.dummy = unigram, dummy_prefix
        self.pieces = pieces
        texts = [(p, i) for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _ in texts):
            raise ValueError("pieces cross word ends")
        if any(kind in (4, 5) for *_, kind in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.longest = max((len(p) for p, _ in texts), default=1)
        keys = np.array([self._hash(p) for p, _ in texts], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        if len(keys) > 1 and (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.ids = np.array([i for _, i in texts], np.int64)[order]
        self.scores = np.array([pieces[i][1] for _, i in texts])[order]
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.low = min((s for _, s, k in pieces if k == NORMAL), default=0.0) - 10.0  # as the library scores unknown characters
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        back = {i: b for b, i in self.bytes.items()}
        self.surface = [bytes([back[i]]) if i in back else p.replace(SPACE, " ").encode() if k == NORMAL else b"" for i, (p, _, k) in enumerate(pieces)]
        if self.pieces and not self.bytes:
            self.surface[self.unknown] = " ⁇ ".encode()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words = self._cuts([p for p, _ in texts])
        self.chained = not unigram and self._histories([texts[i][0] for i in order])

    @classmethod
    def load(cls, model: bytes) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        if m.trainer_spec.model_type not in (1, 2) or m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only unigram and BPE models with identity normalisation")
        return cls([(p.piece, p.score, p.type) for p in m.pieces], m.trainer_spec.model_type == 1, m.normalizer_spec.add_dummy_prefix)

    @staticmethod
    def _cuts(pieces: list[str]) -> re.Pattern:
        """Words: cut before spaces, around newlines, and before marks that in no piece follow another kind of character."""
        marks = set(MARKS)
        while bad := {c for p in pieces for a, c in zip(p, p[1:], strict=False) if c in marks and a != SPACE and a not in marks}:
            marks -= bad
        m = re.escape("".join(sorted(marks)))
        return re.compile(rf" *[^ \n{m}]+| *[{m}][^ \n]*| *\n| +" if marks else r" *[^ \n]+| *\n| +")

    def _hash(self, text: str) -> np.uint64:
        out = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in _mixed(np.array([ord(c) for c in text])):
                out = out * _BASE + x
        return out

    def _probe(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, characters) -> where[w, i, n - 1]: slot of the piece of length n from i, and its score; -1 and -inf if none."""
        count, size = codes.shape
        longest = min(self.longest, size)
        where = np.full((count, size, longest), -1, np.int32)
        score = np.full((count, size, longest), -np.inf)
        if not len(self.keys):
            return where, score
        mixed = _mixed(codes)
        run = np.zeros((count, size), np.uint64)
        for n in range(1, longest + 1):
            run = run[:, : size - n + 1] * _BASE + mixed[:, n - 1 :]
            at = np.minimum(np.searchsorted(self.keys, run), len(self.keys) - 1)
            hit = self.keys[at] == run
            where[:, : size - n + 1, n - 1] = np.where(hit, at, -1)
            score[:, : size - n + 1, n - 1] = np.where(hit, self.scores[at], -np.inf)
        return where, score

    def _viterbi(self, score: np.ndarray) -> np.ndarray:
        """ends[w, i]: where the piece that starts at i ends; 0 where none starts."""
        count, size, longest = score.shape
        score = score.copy()
        score[:, :, 0] = np.where(np.isinf(score[:, :, 0]), self.low, score[:, :, 0])
        best = np.full((count, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((count, size + 1), np.int32)
        for j in range(1, size + 1):
            n = np.arange(min(longest, j), 0, -1)  # the longest first, so the earliest start wins ties
            found = best[:, j - n] + score[:, j - n, n - 1]
            pick = found.argmax(1)
            best[:, j], back[:, j] = found[np.arange(count), pick], n[pick]
        return self._back(back)

    def _histories(self, texts: list[str]) -> bool:
        """How each piece is merged from characters; False if a piece is made of worse ones.

        Kept are both edges: the symbols that stand at the piece's end (side 0) or at its start
        (side 1), from a character up to the piece, as (hash, length, score).
        """
        count, deep = len(texts), self.longest + 1
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(deep, _BASE)])
        self.edge_hash, self.edge_length, self.edge_score = np.zeros((2, count, deep), np.uint64), np.ones((2, count, deep), np.int64), np.full((2, count, deep), -np.inf)
        self.depth = np.ones((2, count), np.int64)
        self.reached = np.array([len(t) == 1 for t in texts], bool)
        self.memo_pair, self.memo_apart = np.full(1 << MEMO, -1, np.int64), np.zeros(1 << MEMO, bool)
        slot = {t: i for i, t in enumerate(texts)}
        by_size: dict[int, list[int]] = defaultdict(list)
        for i, t in enumerate(texts):
            by_size[len(t)].append(i)
        for size in sorted(by_size):
            if size == 1:
                continue
            rows = [(i, x, y, ord(t[k - 1]), ord(t[k])) for i in by_size[size] for t in (texts[i],) for k in range(1, size) for x, y in ((slot.get(t[:k], -1), slot.get(t[k:], -1)),) if (k == 1 or x >= 0 and self.reached[x]) and (k == size - 1 or y >= 0 and self.reached[y])]
            if not rows:
                continue
            own, left, right, last, first = np.array(rows).T
            ok = self._apart(left, right, last, first, False)
            own, left, right = own[ok], left[ok], right[ok]
            for part in (left, right):
                if (self.scores[part[(part >= 0) & self._long(part)]] < self.scores[own[(part >= 0) & self._long(part)]]).any():
                    return False
            self.reached[own] = True
            for side, part in enumerate((right, left)):
                known = part >= 0
                depth = np.where(known, self.depth[side, part], 1)
                for held in (self.edge_hash, self.edge_length, self.edge_score):
                    held[side, own[known]] = held[side, part[known]]
                self.depth[side, own] = depth + 1
                self.edge_hash[side, own, depth] = self.keys[own]
                self.edge_length[side, own, depth] = size
                self.edge_score[side, own, depth] = self.scores[own]
        return True

    def _long(self, slots: np.ndarray) -> np.ndarray:
        """Pieces of more than one character (only these are merged)."""
        return self.depth[0, slots] > 1

    def _apart(self, left: np.ndarray, right: np.ndarray, last: np.ndarray, first: np.ndarray, whole: bool = True) -> np.ndarray:
        """Whether no merge crosses between two pieces (slots; -1: a lone character) while they are made.

        ``last`` and ``first`` are the characters that meet.  Merges are made from the best score down, the
        left one of equals first.  With ``whole`` the two finished pieces must not merge either.
        """
        out, live = np.ones(len(left), bool), np.arange(len(left))
        at = [np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)]
        depth = [np.where(s >= 0, self.depth[k, s], 1) for k, s in enumerate((left, right))]
        slots, base = [left, right], [_mixed(last), _mixed(first)]
        while len(live):
            hashes = [np.where(at[k] == 0, base[k], self.edge_hash[k, slots[k], at[k]]) for k in (0, 1)]
            both = hashes[0] * self.power[np.where(at[1] == 0, 1, self.edge_length[1, slots[1], at[1]])] + hashes[1]
            where = np.minimum(np.searchsorted(self.keys, both), len(self.keys) - 1)
            cross = np.where(self.keys[where] == both, self.scores[where], -np.inf)
            more = [at[k] + 1 < depth[k] for k in (0, 1)]
            own = [np.where(more[k], self.edge_score[k, slots[k], np.minimum(at[k] + 1, depth[k] - 1)], -np.inf) for k in (0, 1)]
            done = ~more[0] & ~more[1]
            joined = (cross > own[0]) & (cross >= own[1]) & (whole | ~done)
            out[live[joined]] = False
            go = ~(joined | done)
            ahead = own[0] >= own[1]
            at = [(at[0] + ahead)[go], (at[1] + ~ahead)[go]]
            live, depth, slots, base = live[go], [d[go] for d in depth], [s[go] for s in slots], [b[go] for b in base]
        return out

    def _steps(self, left: np.ndarray, right: np.ndarray, last: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``_apart``, for pairs of pieces seen lately from a table of fixed size."""
        pair = left * len(self.keys) + right
        at = (pair.astype(np.uint64) * _MIX >> np.uint64(64 - MEMO)).astype(np.int64)
        lone = (left < 0) | (right < 0)
        out = self.memo_apart[at]
        new = np.flatnonzero((self.memo_pair[at] != pair) | lone)
        if len(new):
            out[new] = self._apart(left[new], right[new], last[new], first[new])
            kept = new[~lone[new]]
            self.memo_pair[at[kept]], self.memo_apart[at[kept]] = pair[kept], out[kept]
        return out

    def _chain(self, codes: np.ndarray, where: np.ndarray) -> np.ndarray:
        """ends[w, i], as of ``_viterbi``, where steps between pieces are possible or not."""
        count, size = codes.shape
        longest = where.shape[2]
        usable = (where >= 0) & self.reached[where]
        usable[:, :, 0] = True
        back, slot = np.zeros((count, size + 1), np.int64), np.full((count, size + 1), -1, np.int64)
        for j in range(1, size + 1):
            n = np.arange(min(longest, j), 0, -1)
            found = np.where(usable[:, j - n, n - 1], 0.0, -np.inf)
            rows, cols = np.nonzero((found == 0) & (j - n > 0)[None, :])
            i = j - n[cols]
            step = self._steps(slot[rows, i], where[rows, i, n[cols] - 1].astype(np.int64), codes[rows, i - 1], codes[rows, i])
            found[rows[~step], cols[~step]] = -np.inf
            pick = found.argmax(1)
            back[:, j], slot[:, j] = n[pick], where[np.arange(count), j - n[pick], n[pick] - 1]
        return self._back(back)

    @staticmethod
    def _back(back: np.ndarray) -> np.ndarray:
        """Back-pointers (length of the last piece up to each position) -> ends[w, i]."""
        count, size = back.shape[0], back.shape[1] - 1
        ends = np.zeros((count, size), np.int32)
        at, rows = np.full(count, size), np.arange(count)
        while (at > 0).any():
            live = at > 0
            begin = at - np.where(live, back[rows, at], 0)
            ends[rows[live], begin[live]] = at[live]
            at = np.where(live, begin, 0)
        return ends

    def _merges(self, score: np.ndarray) -> np.ndarray:
        count, size, longest = score.shape
        flat = np.concatenate([score, np.full((count, size, 1), -np.inf)], 2)
        ends = np.tile(np.arange(1, size + 1, dtype=np.int32), (count, 1))
        alive, start = np.arange(count), np.arange(size)
        out = np.zeros((count, size), np.int32)
        while len(alive):
            nxt = np.take_along_axis(ends, np.minimum(ends, size - 1), 1)  # end of the neighbour
            n = np.where((ends > 0) & (ends < size) & (nxt > 0), np.minimum(nxt - start, longest + 1), longest + 1)
            pair = np.take_along_axis(flat, (n - 1)[:, :, None], 2)[:, :, 0]
            pick = pair.argmax(1)
            rows = np.arange(len(alive))
            live = pair[rows, pick] > -np.inf
            out[alive[~live]] = ends[~live]
            rows, pick = rows[live], pick[live]
            middle = ends[rows, pick]
            ends[rows, pick] = ends[rows, middle]
            ends[rows, middle] = 0
            alive, ends, flat = alive[live], ends[live], flat[live]
        return out

    def segment(self, words: list[str]) -> list[bytes]:
        """ids of each word; words of equal length advance together."""
        by_size: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            by_size[len(w)].append(i)
        out: list = [b""] * len(words)
        for size, members in by_size.items():
            block = max(1, 200_000 // (size * min(size, self.longest)))
            for at in range(0, len(members), block):
                some = members[at : at + block]
                codes = np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), size)
                where, score = self._probe(codes)
                ends = self._viterbi(score) if self.unigram else self._chain(codes, where) if self.chained else self._merges(score)
                rows, begins = np.nonzero(ends)
                slots = where[rows, begins, ends[rows, begins] - begins - 1]
                ids = np.where(slots >= 0, self.ids[slots] if len(self.ids) else -1, -1)
                raw = ids.astype("<u4").tobytes()
                cuts = np.searchsorted(rows, np.arange(len(some) + 1))
                bad = set(rows[slots < 0].tolist())
                edges = (cuts * 4).tolist()
                for k, i in enumerate(some):
                    out[i] = raw[edges[k] : edges[k + 1]]
                for k in bad:
                    own = slice(cuts[k], cuts[k + 1])
                    out[some[k]] = self._fallback(words[some[k]], ids[own], begins[own]).astype("<u4").tobytes()
        return out

    def _fallback(self, word: str, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Characters that are no piece become bytes, or the unknown id (once for a run, in unigram models)."""
        out: list[int] = []
        for i, b in zip(ids.tolist(), begins.tolist(), strict=True):
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[x] for x in word[b].encode()]
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
        return np.array(out, np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids as little-endian unsigned 32-bit numbers."""
        self._turn()
        cut = [self.words.findall((" " if self.dummy else "") + t) if t else [] for t in texts]
        known = self.known
        codes = [list(map(known.get, c)) for c in cut]
        gaps = [(k, [i for i, x in enumerate(c) if x is None]) for k, c in enumerate(codes) if None in c]
        if gaps:
            new = list({cut[k][i] for k, at in gaps for i in at})
            old = self.older
            fresh = [w for w in new if w not in old]
            known.update((w, old[w]) for w in new if w in old)
            known.update(zip(fresh, self.segment([w.replace(" ", SPACE) for w in fresh]), strict=True))
            for k, at in gaps:
                c, w = codes[k], cut[k]
                for i in at:
                    c[i] = known[w[i]]
        return [b"".join(c) for c in codes]

    def _turn(self) -> None:
        """Words not seen since the last turn but one are forgotten."""
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


_models: dict[int, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    """One for each worker process and model."""
    key = zlib.crc32(model)
    if key not in _models:
        _models[key] = Pieces.load(model)
    return _models[key]


def encoded(docs: DataFrame, model_path: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_pieces, pieces_crc32 (of the ids as unsigned 32-bit numbers), decoded_same (the ids decode to the text), and ids."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, n_pieces long, pieces_crc32 long, decoded_same boolean" + ", ids array<int>" * keep_ids

    def run(batches):
        m = pieces(model.value)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                some = b.slice(at, 128)
                texts = [t or "" for t in some.column(1).to_pylist()]
                codes = m.encode(texts)
                cols = [some.column(0), pa.array([len(c) // 4 for c in codes], pa.int64()), pa.array([zlib.crc32(c) for c in codes], pa.int64()), pa.array([m.decode(c) == t for c, t in zip(codes, texts, strict=True)])]
                if keep_ids:
                    offsets = np.cumsum([0, *(len(c) // 4 for c in codes)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(codes), "<u4").astype(np.int32))))
                yield pa.record_batch(cols, names=["doc_id", "n_pieces", "pieces_crc32", "decoded_same", "ids"][: len(cols)])

    return docs.selectExpr("cast(doc_id as long) as doc_id", f"`{text}` as text").mapInArrow(run, schema)
