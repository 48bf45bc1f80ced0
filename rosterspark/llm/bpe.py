"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation (operator 13).

Texts are cut into the matches of the tokenizer's split pattern without a
regular expression.  A table gives each code point's class (letter, number,
white space, other); comparing an array with itself shifted gives the symbols
that need to look ahead (the last white space before a word, an apostrophe
before a contraction's letters).  What remains is an automaton of eight states
whose transitions are functions on the states.  Composition of functions is
associative, so the scan runs over blocks: every block composes the functions
of its 64 symbols, a doubling scan over the blocks gives the state at the start
of each, and a second pass tells at which code points a token starts.  The
slices between starts go through a cache to pair merging by rank; ids of a
document are gathered from the cache's pool.  ``offsets`` holds the first byte
of each token, so ``decode`` places every token's bytes by itself and a part of
the ids can be turned back into its span of the text.

``encode(docs)`` returns doc_id, ids (array<int>), offsets (array<long>),
``decode(encoded)`` doc_id and body (bytes), ``digests(encoded)`` the counts
and hashes of both.  A row in gives a row out: no shuffle.

Defined cases: a null text is empty; an empty text has no ids; a null doc_id
stays null; repeated rows are encoded each; an empty table gives no rows;
further columns are left out.  Bytes that are not UTF-8 become U+FFFD.  Texts
of any length: a text over ``WINDOW`` code points is encoded window by window,
each cut at a token start.  Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import expand, list_array, pair, starts_of
from rosterspark.session import ship_package

WINDOW = 1 << 18  # code points that are scanned at once
SLOTS = 1 << 20  # of the cache; half of them may be taken by slices whose ids are kept
CACHE_BYTES = 15  # longest slice that is kept
AT_ONCE = 1 << 13  # slices that are merged at once
NO_PAIR = 1 << 40  # rank of a pair that does not merge
BLOCK = 64  # code points whose functions one step of the scan over blocks stands for

LETTER, NUMBER, OTHER, SPACE, END = range(5)
#: Letters and numbers of Unicode 16 that Python 3.13's tables (15.1) lack, and white space.
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
               (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
               (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
               (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
               (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
               (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
WHITE = [(9, 13), (32, 32), (133, 133), (160, 160), (5760, 5760), (8192, 8202), (8232, 8233), (8239, 8239), (8287, 8287),
         (12288, 12288)]

# symbols of the automaton: a class with what follows it
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_JOIN, S_LAST, S_WHITE, S_END = range(9)
# states: what is open before a code point
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, JOINING, IN_WHITE, ONE_MORE, TWO_MORE = range(8)
STATES = 8


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _classes() -> np.ndarray:
    """Class of each code point; the last entry is the end of a text."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER), (WHITE, SPACE)):
        for a, b in ranges:
            out[a:b + 1] = kind
    return np.append(out, np.uint8(END))


@cache
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token starts) by symbol * STATES + state."""
    step, start = np.zeros((9, STATES), np.uint8), np.ones((9, STATES), np.uint8)
    step[S_LETTER] = IN_LETTERS
    step[S_LETTER, TWO_MORE], step[S_LETTER, ONE_MORE] = ONE_MORE, FRESH
    start[S_LETTER, [IN_LETTERS, JOINING, ONE_MORE, TWO_MORE]] = 0
    step[S_NUMBER], step[S_OTHER] = IN_NUMBERS, IN_OTHER
    start[S_NUMBER, [IN_NUMBERS, JOINING]] = 0
    start[S_OTHER, [IN_OTHER, JOINING]] = 0
    for symbol, state in ((S_SHORT, ONE_MORE), (S_LONG, TWO_MORE)):  # a contraction, unless the apostrophe belongs to what is open
        step[symbol] = state
        step[symbol, [IN_OTHER, JOINING]] = IN_OTHER
        start[symbol, [IN_OTHER, JOINING]] = 0
    step[S_JOIN], step[S_LAST], step[S_END] = JOINING, FRESH, FRESH
    step[S_WHITE] = IN_WHITE
    start[S_WHITE, IN_WHITE] = 0
    return step.ravel(), start.ravel()


def _symbols(cps: np.ndarray) -> np.ndarray:
    """Symbols of code points; texts end with 0x110000."""
    kind = _classes()[cps]
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_END], np.uint8)[kind]
    after = np.append(kind[1:], np.uint8(END))
    last = (kind == SPACE) & (after != SPACE) & (after != END)
    out[last] = S_LAST
    out[last & (cps == 32)] = S_JOIN
    at = np.flatnonzero(cps == 39)
    if len(at):
        following = np.append(cps, np.full(2, 0x110000, cps.dtype))
        a, b = following[at + 1], following[at + 2]
        out[at[np.isin(a, [ord(c) for c in "stmd"])]] = S_SHORT
        out[at[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = S_LONG
    return out


def token_starts(cps: np.ndarray) -> np.ndarray:
    """Whether a token starts at each code point (ends of texts, 0x110000, count as starts)."""
    step, start = _automaton()
    n = len(cps)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, S_END, np.uint8)
    padded[:n] = _symbols(cps)
    symbols = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T) * np.uint8(STATES)
    whole = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], blocks, axis=1)  # function of each block: state in, state out
    for k in range(BLOCK):
        whole = step[symbols[k] + whole]
    before, h = whole, 1  # functions of all blocks up to each one, by doubling
    while h < blocks:
        before = np.concatenate([before[:, :h], np.take_along_axis(before[:, h:], before[:, :-h], axis=0)], axis=1)
        h *= 2
    state = np.concatenate([[FRESH], before[FRESH, :-1]]).astype(np.uint8)
    out = np.empty((BLOCK, blocks), np.uint8)
    for k in range(BLOCK):
        at = symbols[k] + state
        out[k] = start[at]
        state = step[at]
    return out.T.reshape(-1)[:n].astype(bool)


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of least rank (leftmost first) is merged until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def pair_at(i):
        j = ends[i]
        r = ranks.get(piece[i:ends[j]]) if j < n else None
        if r is not None:
            heapq.heappush(heap, (r, i, ends[j]))

    heap: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        pair_at(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = ends[i]
        if not alive[i] or j >= n or ends[j] != end:  # one of the two has been merged since
            continue
        alive[j], ends[i] = False, end
        if end < n:
            before[end] = i
        pair_at(i)
        if before[i] >= 0:
            pair_at(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:ends[i]]])
        i = ends[i]
    return out


def merge_many(body: bytes, begins: np.ndarray, lens: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """As ``merge_pairs`` for many short slices, one merge of every slice at a time: (ids, one row a slice; number of ids)."""
    width = int(lens.max())
    data = np.frombuffer(body, np.uint8)
    raw = data[np.minimum(begins[:, None] + np.arange(width), len(data) - 1)]
    out, counts = vocab.single[raw], lens.copy()
    ranks = np.full((len(lens), width), NO_PAIR)
    ranks[:, :-1] = vocab.first_ranks[raw[:, :-1], raw[:, 1:]]
    ranks[np.arange(width) >= lens[:, None] - 1] = NO_PAIR
    rows, ids = np.arange(len(lens)), out.copy()  # slices that still merge, and their tokens
    columns = np.arange(width)
    while True:
        best = ranks.argmin(axis=1)  # the leftmost of least rank
        merged = ranks[np.arange(len(rows)), best]
        on = merged != NO_PAIR
        if not on.all():
            out[rows[~on]] = ids[~on]
            rows, ids, ranks, best, merged = rows[on], ids[on], ranks[on], best[on], merged[on]
        if not len(rows):
            return out, counts
        me = np.arange(len(rows))
        source = np.minimum(columns + (columns > best[:, None]), width - 1)  # the second token of the pair goes
        ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
        ranks[:, -1] = NO_PAIR
        ids[me, best] = merged
        counts[rows] -= 1
        n = counts[rows]
        before, after = np.maximum(best - 1, 0), np.minimum(best + 1, width - 1)
        ranks[me, best] = np.where(best + 1 < n, vocab.pair_ranks(merged, ids[me, after]), NO_PAIR)
        left = best > 0
        ranks[me[left], before[left]] = vocab.pair_ranks(ids[me, before], merged)[left]


class Vocabulary:
    """Ranks, and the pool of ids of slices met so far."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, r in self.ranks.items():
            tokens[r] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.starts = starts_of(self.lens)[:-1]
        pairs = {self.ranks[t[:k]] << 32 | self.ranks[t[k:]]: r for t, r in self.ranks.items() for k in range(1, len(t))
                 if t[:k] in self.ranks and t[k:] in self.ranks}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.first_ranks = self.pair_ranks(np.repeat(self.single, 256), np.tile(self.single, 256)).reshape(256, 256)
        written = [b"%d " % i for i in range(len(tokens))]
        self.written = np.frombuffer(b"".join(written), np.uint8)
        self.written_lens = np.array([len(t) for t in written], np.int64)
        self.written_starts = starts_of(self.written_lens)[:-1]
        self.forget()

    def forget(self):
        self.keys, self.place = np.zeros((2, SLOTS), np.uint64), np.zeros(SLOTS, np.int64)
        self.known = 0
        self.pool, self.edges = array("q"), array("q", [0])

    def ids_of(self, body: bytes, begins: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slices of ``body`` in a row, number of ids of each slice)."""
        if self.known > SLOTS // 2 or len(self.pool) > 8 * SLOTS:
            self.forget()
        at = np.empty(len(begins), np.int64)
        short = lens <= CACHE_BYTES
        key = _keys(body, begins[short], lens[short])
        found = self._find(*key)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            order = missing[np.lexsort((key[1][missing], key[0][missing]))]
            new = np.concatenate([[True], (key[0][order[1:]] != key[0][order[:-1]]) | (key[1][order[1:]] != key[1][order[:-1]])])
            first, where = order[new], np.flatnonzero(short)
            places = self._merge_all(body, begins[where[first]], lens[where[first]])
            self._add(key[0][first], key[1][first], places)
            found[order] = places[np.cumsum(new) - 1]
        at[short] = found
        long = np.flatnonzero(~short)  # their ids stay in the pool until it is emptied, but are not looked up again
        at[long] = [self._merge(body[x:x + n]) for x, n in zip(begins[long].tolist(), lens[long].tolist())]
        bounds = np.frombuffer(self.edges, np.int64)
        first = bounds[at]
        counts = bounds[at + 1] - first
        ids = np.frombuffer(self.pool, np.int64)[expand(first, counts)] if len(at) else np.zeros(0, np.int64)
        del bounds  # an array cannot grow while it is looked at
        return ids, counts

    def _merge_all(self, body: bytes, begins: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Adds the ids of short slices to the pool, merging all of them at once; their places."""
        first = len(self.edges) - 1
        whole = np.fromiter((self.ranks.get(body[x:x + n], -1) for x, n in zip(begins.tolist(), lens.tolist())), np.int64, len(lens))
        for k in range(0, len(lens), AT_ONCE):
            part = slice(k, k + AT_ONCE)
            ids, counts = merge_many(body, begins[part], lens[part], self)
            keep, known = np.arange(ids.shape[1]) < counts[:, None], whole[part] >= 0
            ids[known, 0] = whole[part][known]
            keep[known] = np.arange(ids.shape[1]) < 1
            self.pool.frombytes(ids[keep].tobytes())
            self.edges.frombytes((np.cumsum(np.where(known, 1, counts)) + self.edges[-1]).tobytes())
        return np.arange(first, first + len(lens))

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the token that the pair of tokens merges to, ``NO_PAIR`` where none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], NO_PAIR)

    def _merge(self, piece: bytes) -> int:
        """Adds the ids of a slice to the pool; their place."""
        self.pool.extend(merge_pairs(piece, self.ranks))
        self.edges.append(len(self.pool))
        return len(self.edges) - 2

    def _find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Places of short slices by open addressing, -1 for those not met so far."""
        out = np.full(len(k1), -1, np.int64)
        slot = (pair(k1, k2) % np.uint64(SLOTS)).astype(np.int64)
        todo = np.arange(len(k1))
        while len(todo):
            held = self.keys[1][slot]
            same = (held == k2[todo]) & (self.keys[0][slot] == k1[todo])
            out[todo[same]] = self.place[slot[same]]
            more = ~same & (held != 0)
            todo, slot = todo[more], (slot[more] + 1) % SLOTS
        return out

    def _add(self, k1, k2, places) -> None:
        slots = (pair(k1, k2) % np.uint64(SLOTS)).tolist()
        if self.known + len(slots) > 3 * SLOTS // 4:  # looked up by this window alone
            return
        self.known += len(slots)
        for a, b, slot, place in zip(k1.tolist(), k2.tolist(), slots, places.tolist()):
            while self.keys[1, slot]:
                slot = (slot + 1) % SLOTS
            self.keys[0, slot], self.keys[1, slot], self.place[slot] = a, b, place


#: Keeps the first 0 to 8 bytes of a little-endian word.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _keys(body: bytes, begins: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of up to 15 bytes as two words: the bytes, and the length in the last byte."""
    words = np.ndarray((len(body) + 8,), "<u8", body + bytes(16), strides=(1,))
    k1 = words[begins] & KEEP[np.minimum(lens, 8)]
    k2 = words[np.minimum(begins + 8, len(body))] & KEEP[np.maximum(lens - 8, 0)] | lens.astype(np.uint64) << np.uint64(56)
    return k1, k2


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encode_window(texts: list[str], vocab: Vocabulary, cut: bool):
    """(ids, lens of tokens in bytes, ids of each text, code points used).

    With ``cut`` the one text goes on: what follows its last token start is left, for the token may be longer.
    """
    joined = "".join(texts)
    lens = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    cps = np.insert(flat, np.cumsum(lens), 0x110000)
    starts = np.flatnonzero(token_starts(cps))
    used = len(joined)
    if cut:
        safe = starts[starts < len(joined) - 4]  # symbols look two code points ahead
        if len(safe) < 2:
            return None
        used = int(safe[-1])
        starts = safe
    sizes = np.ones(len(cps), np.int64)
    for bound in (0x80, 0x800, 0x10000):
        sizes += cps >= bound
    sizes[cps == 0x110000] = 0
    at = starts_of(sizes)[starts]
    body = joined.encode()
    real = cps[starts[:-1]] != 0x110000
    begins = at[:-1][real]
    ids, counts = vocab.ids_of(body, begins, at[1:][real] - begins)
    text_of = np.searchsorted(np.cumsum(lens + 1), starts[:-1][real], side="right")
    per_text = np.bincount(text_of, weights=counts, minlength=len(texts)).astype(np.int64)
    return ids, per_text, used


def encode_texts(texts: list[str], vocab: Vocabulary):
    """Ids of each of some texts, one array after the other, and how many each has."""
    out, counts, waiting, size = [], [], [], 0

    def flush():
        nonlocal waiting, size
        if waiting:
            ids, per_text, _ = _encode_window(waiting, vocab, False)
            out.append(ids)
            counts.extend(per_text.tolist())
            waiting, size = [], 0

    for t in texts:
        if len(t) <= WINDOW:
            if size + len(t) > WINDOW:
                flush()
            waiting.append(t)
            size += len(t)
            continue
        flush()
        at, width, n = 0, WINDOW, 0
        while at < len(t):
            done = _encode_window([t[at:at + width]], vocab, at + width < len(t))
            if done is None:  # a token longer than the window
                width *= 2
                continue
            out.append(done[0])
            n += len(done[0])
            at, width = at + done[2], WINDOW
        counts.append(n)
    flush()
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.array(counts, np.int64)


def encode(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """(doc_id, ids, offsets): the text's tokens and the first byte of each."""
    path = vocabulary_path or default_vocabulary()
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for part in _parts(batch):
                texts = [b.decode("utf-8", "replace") for b in part.column(1).to_pylist()]
                ids, counts = encode_texts(texts, vocab)
                before = starts_of(vocab.lens[ids])[:-1]
                edges = starts_of(counts)[:-1]
                first = before[np.minimum(edges, max(0, len(before) - 1))] if len(before) else np.zeros(len(counts), np.int64)
                offsets = before - np.repeat(first, counts)
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(ids, counts, pa.int32()),
                                                  list_array(offsets, counts, pa.int64())], names=["doc_id", "ids", "offsets"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>")


def _parts(batch: pa.RecordBatch, limit: int = 1 << 20):
    """Runs of rows with about ``limit`` bytes of text (a longer text is a run by itself)."""
    column = batch.column(1)
    sizes = pc.binary_length(column).to_pylist()
    begin, total = 0, 0
    for k, n in enumerate(sizes):
        if k > begin and total + n > limit:
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def decode_ids(ids: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> bytes:
    """The bytes of a run of tokens; offsets (of any base) say where each token's bytes stand."""
    if not len(ids):
        return b""
    lens = vocab.lens[ids]
    out = np.zeros(int(offsets[-1] + lens[-1] - offsets[0]), np.uint8)
    out[expand(offsets - offsets[0], lens)] = vocab.bytes[expand(vocab.starts[ids], lens)]
    return out.tobytes()


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a list column."""
    bounds = column.offsets.to_numpy()
    return column.values.to_numpy(), bounds


def decode(encoded: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """(doc_id, body): the bytes that ids and offsets stand for."""
    path = vocabulary_path or default_vocabulary()

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            (ids, at), (offsets, at2) = _lists(batch.column(1)), _lists(batch.column(2))
            bodies = [decode_ids(ids[at[k]:at[k + 1]], offsets[at2[k]:at2[k + 1]], vocab) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], names=["doc_id", "body"])

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(run, "doc_id long, body binary")


def digests(encoded: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded documents, which are decoded for it."""
    path = vocabulary_path or default_vocabulary()

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            (ids, at), (offsets, at2) = _lists(batch.column(1)), _lists(batch.column(2))
            named, decoded = [], []
            for k in range(batch.num_rows):
                mine = ids[at[k]:at[k + 1]]
                written = vocab.written[expand(vocab.written_starts[mine], vocab.written_lens[mine])].tobytes()
                named.append(hashlib.sha256(written[:-1]).hexdigest())
                decoded.append(hashlib.sha256(decode_ids(mine, offsets[at2[k]:at2[k + 1]], vocab)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(named), pa.array(decoded)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
