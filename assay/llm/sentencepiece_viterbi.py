"""SentencePiece encoding and decoding: streaming Viterbi.

The best segmentation of a text into vocabulary pieces (greatest sum of the pieces' scores; ties go to the longer last piece) is found
left to right over a stream of bytes of any length. A position is settled once all that a piece from it may span has come, so only a window as long as the
longest piece stays open. Ids are committed up to the last boundary that the backpointer paths of all open positions go through, and what
stands behind it is carried on. Within the bytes that are there, all stretches between boundaries that no piece spans go in lockstep.

No piece has the white-space mark inside, so all paths meet before each word: a word's ids, once committed, hold wherever it stands again, and each
distinct word (with the marks before it) of a worker goes through the stream once.

The vocabulary file is a byte-fallback model, given by path and read on the driver; its bytes travel with the job. A mark character
that a text itself holds is encoded by its bytes, so decoding returns every text exactly.

Defined results: null and empty texts have no ids, and decode to the empty text; null ids of rows stay null; repeated rows each give their own
row; texts are read whole; extra columns are not read.
"""

from __future__ import annotations

import struct
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, portions, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
#: A byte that UTF-8 never has stands for a mark that the text itself holds.
OWN_MARK = 0xFE
#: Bytes that go into the stream at once.
STEP = 1 << 18
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(buf: bytes):
    """Field numbers and values of a protocol-buffer message."""
    at = 0
    while at < len(buf):
        key, at = _varint(buf, at)
        kind = key & 7
        if kind == 0:
            v, at = _varint(buf, at)
        elif kind == 1:
            v, at = buf[at : at + 8], at + 8
        elif kind == 5:
            v, at = buf[at : at + 4], at + 4
        else:
            n, at = _varint(buf, at)
            v, at = buf[at : at + n], at + n
        yield key >> 3, v


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


class Vocabulary:
    """Pieces, scores and a byte trie of a model."""

    def __init__(self, model: bytes):
        pieces: list[tuple[bytes, float, int]] = []
        for number, v in _fields(model):
            if number == 1:
                f = dict(_fields(v))
                pieces.append((f.get(1, b""), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        self.scores = np.array([s for _, s, _ in pieces])
        self.byte_id = np.zeros(256, np.int32)
        self.bytes: list[bytes] = []
        normal = []
        for i, (p, s, kind) in enumerate(pieces):
            if kind == BYTE:
                value = int(p[3:5], 16)
                self.byte_id[value] = i
                self.bytes.append(bytes([value]))
            else:
                self.bytes.append(b"" if kind in (UNKNOWN, CONTROL, UNUSED) else p.replace(MARK, b" "))
                if kind in (NORMAL, USER) and p:
                    normal.append((p, i))
                    if MARK in p.lstrip(MARK[:1] + MARK[1:2] + MARK[2:3]):
                        raise ValueError(f"piece {i} has the white-space mark inside: words do not part its texts")
        self.unknown = min(self.scores[i] for _, i in normal) - UNKNOWN_PENALTY
        self.longest = max(len(p) for p, _ in normal)
        children: list[dict[int, int]] = [{}]
        final = [-1]
        for p, i in normal:
            node = 0
            for b in p:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    final.append(-1)
                node = children[node][b]
            final[node] = i
        self.children, self.final = children, np.array(final, np.int32)
        self.next = np.zeros((len(children), 256), np.int32)
        for node, c in enumerate(children):
            for b, to in c.items():
                self.next[node, b] = to
        self.cache: dict[bytes, np.ndarray] = {}

    def spell(self, raw: bytes) -> list[int]:
        """Byte pieces of an unknown character."""
        return [int(self.byte_id[b]) for b in (MARK if raw == bytes([OWN_MARK]) else raw)]


class StreamingViterbi:
    """Segments a stream of normalised bytes. feed() and finish() give what is committed: ids (-2 for an unknown character), and where each piece ends in the stream."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.base = 0  # stream position of the first byte that is not committed
        self.held = b""

    def feed(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        self.held += data
        return self._commit(len(self.held) - self.v.longest - 4)

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        return self._commit(len(self.held))

    def _commit(self, settled: int) -> tuple[np.ndarray, np.ndarray]:
        """Commits what all paths over the first `settled` bytes share."""
        none = np.zeros(0, np.int32), np.zeros(0, np.int64)
        if settled <= 0:
            return none
        b = np.frombuffer(self.held, np.uint8)
        s, e, i = edges(self.v, b, settled)
        piece, start, free = best_paths(self.v, s, e, i, len(b))
        if settled < len(b):
            to = self._meeting(start, np.unique(e[e >= settled]).tolist())
        else:
            to = len(b)
        if not to:
            return none
        ids, ends = walked(piece, start, free, to)
        self.held = self.held[to:]
        self.base += to
        return ids, ends + (self.base - to)

    @staticmethod
    def _meeting(start: np.ndarray, open_: list[int]) -> int:
        """The last boundary that the paths to all open positions go through."""
        paths = set(open_)
        while len(paths) > 1:
            last = max(paths)
            paths.discard(last)
            paths.add(int(start[last]))
        return paths.pop() if paths else 0


_WIDTH = np.ones(256, np.int64)
_WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:0xF8] = 2, 3, 4


def edges(v: Vocabulary, b: np.ndarray, settled: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, id) of all pieces that begin before `settled`; a character that is no piece is one of id -2."""
    at = np.flatnonzero((b[:settled] & 0xC0) != 0x80)
    single = np.zeros(len(b), bool)
    node, start = np.zeros(len(at), np.int32), at
    starts, ends, ids = [], [], []
    for k in range(v.longest):
        alive = start + k < len(b)
        start, node = start[alive], node[alive]
        node = v.next[node, b[start + k]]
        alive = node > 0
        start, node = start[alive], node[alive]
        if not len(start):
            break
        piece = v.final[node]
        hit = piece >= 0
        starts.append(start[hit])
        ends.append(start[hit] + k + 1)
        ids.append(piece[hit])
        single[start[hit][_WIDTH[b[start[hit]]] == k + 1]] = True
    rest = at[~single[at]]
    starts.append(rest)
    ends.append(np.minimum(rest + _WIDTH[b[rest]], len(b)))
    ids.append(np.full(len(rest), -2, np.int32))
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)


def best_paths(v: Vocabulary, s: np.ndarray, e: np.ndarray, i: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each position the id and the start of the last piece of the best path to it, and whether no piece spans it."""
    score = np.where(i >= 0, v.scores[np.maximum(i, 0)], v.unknown)
    # each stretch between two positions that no piece spans is a problem of its own, and all go in lockstep by their depth
    cover = np.zeros(n + 2, np.int64)
    wide = e - s > 1
    np.add.at(cover, s[wide] + 1, 1)
    np.add.at(cover, e[wide], -1)
    free = np.cumsum(cover[:n]) == 0
    free[0] = True
    origin = np.maximum.accumulate(np.where(free, np.arange(n), 0))
    depth = e - origin[s]
    order = np.lexsort((s, e, depth))
    s, e, i, score, depth = s[order], e[order], i[order], score[order], depth[order]
    best = np.zeros(n + 1)
    piece, start = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int64)
    cuts = np.flatnonzero(np.diff(depth)) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(s)]])):
        ss, ee = s[lo:hi], e[lo:hi]
        # a stretch begins at 0, whatever the one before it came to
        c = np.where(free[ss], 0.0, best[ss]) + score[lo:hi]
        group = np.concatenate([[0], np.flatnonzero(np.diff(ee)) + 1])
        top = np.maximum.reduceat(c, group)
        size = np.diff(np.concatenate([group, [len(ee)]]))
        winner = np.flatnonzero(c == np.repeat(top, size))
        which = np.repeat(np.arange(len(group)), size)[winner]
        winner = winner[np.concatenate([[True], np.diff(which) > 0])]
        end = ee[winner]
        best[end] = top
        piece[end], start[end] = i[lo:hi][winner], ss[winner]
    return piece, start, free


def walked(piece: np.ndarray, start: np.ndarray, free: np.ndarray, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and ends of the pieces on the best path up to a boundary, all stretches walked back together."""
    begin = np.flatnonzero(free[:to])
    pos = np.concatenate([begin[1:], [to]])
    out = np.zeros(to + 1, bool)
    while len(pos):
        out[pos] = True
        pos = start[pos]
        go = pos > begin
        pos, begin = pos[go], begin[go]
    ends = np.flatnonzero(out)
    return piece[ends], ends


def normal_bytes(text: str) -> bytes:
    """The text as the vocabulary sees it: marks for spaces, one of them in front."""
    return MARK + text.encode("utf-8", "replace").replace(MARK, bytes([OWN_MARK])).replace(b" ", MARK)


def stream_ids(v: Vocabulary, parts: list[bytes], step: int = STEP) -> list[np.ndarray]:
    """The ids of each part of one stream. Parts begin with a mark, and none ends with one, so that no piece spans two."""
    data, stream = b"".join(parts), StreamingViterbi(v)
    got = [stream.feed(data[at : at + step]) for at in range(0, len(data), step)] + [stream.finish()]
    ids, ends = (np.concatenate(x) for x in zip(*got))
    edge = np.searchsorted(ends, np.cumsum([len(p) for p in parts]), "right")
    out = np.split(ids, edge[:-1]) if len(parts) else []
    for k in np.unique(np.searchsorted(edge, np.flatnonzero(ids == -2), "right")).tolist():
        # unknown characters are spelled in bytes
        first = edge[k - 1] if k else 0
        spelled: list[int] = []
        for n in range(first, edge[k]):
            begin = ends[n - 1] if n else 0
            spelled += v.spell(data[begin : ends[n]]) if ids[n] == -2 else [int(ids[n])]
        out[k] = np.array(spelled, np.int32)
    return out


CACHED_WORDS = 150_000
CACHED_BYTES = 64


def words_of(text: str) -> list[bytes]:
    """The parts of a text's bytes: each a run of marks and the word behind it; marks at the end are a part of their own."""
    data = (b" " + text.encode("utf-8", "replace").replace(MARK, bytes([OWN_MARK]))).split(b" ")[1:]
    out, run = [], 1
    for n, w in enumerate(data):
        if w or n == len(data) - 1:
            out.append(MARK * run + w)
            run = 1
        else:
            run += 1
    return out


def encode_batch(v: Vocabulary, texts: list[str | None]) -> list[np.ndarray]:
    """Ids of each text. Words that this worker has seen are looked up; the table of them is emptied when it is full. Long ones are not kept in it."""
    if len(v.cache) > CACHED_WORDS:
        v.cache.clear()
    split = [words_of(t) if t else () for t in texts]
    new = list(dict.fromkeys(w for words in split for w in words if w not in v.cache))
    # a part that is nothing but marks could share a piece with the marks of a next one: it ends a stream of its own
    ending = [w for w in new if w.endswith(MARK)]
    known = {w: stream_ids(v, [w])[0] for w in ending}
    inner = [w for w in new if not w.endswith(MARK)]
    known |= zip(inner, stream_ids(v, inner))
    v.cache.update((w, ids) for w, ids in known.items() if len(w) <= CACHED_BYTES)
    out = []
    for words in split:
        ids = [v.cache[w] if w in v.cache else known[w] for w in words]
        out.append(np.concatenate(ids) if ids else np.zeros(0, np.int32))
    return out


def decode(v: Vocabulary, ids) -> str:
    data = b"".join(map(v.bytes.__getitem__, ids))
    return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def load_model(spark, path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


ENCODED = "doc_id long, n_ids long, ids array<int>, decoded_sha256 string, exact boolean"


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ids, their number, a digest of the text decoded from them, and whether it equals the source."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one vocabulary file

    def run(batch):
        v = vocabulary(shared.value)
        for lo, part in portions(batch.column("text").to_pylist(), 128):
            ids = encode_batch(v, part)
            ends = np.cumsum([0, *map(len, ids)])
            digests, exact = [], []
            for t, x in zip(part, ids):
                back = decode(v, x.tolist())
                digests.append(sha256(back.encode("utf-8", "replace")).hexdigest())
                exact.append(back == (t or ""))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
            yield {"doc_id": batch.column("doc_id").slice(lo, len(part)), "n_ids": np.diff(ends), "ids": lists, "decoded_sha256": digests, "exact": exact}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, ENCODED)


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), load_model(spark))
