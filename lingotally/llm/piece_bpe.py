"""SentencePiece BPE, encoded in vectorised merge rounds and decoded by table.

A text becomes " " + text with every space as U+2581 (what models without a normaliser do). It is cut in
front of every run of U+2581: where no piece holds U+2581 after another character, no merge crosses there.
Distinct words are encoded once per batch and remembered per Python worker (``CACHE`` of them, and those of a batch).
Their ids as text and their decoded texts are cut out of one long text of all new words.

Encoding keeps the symbols of all words in flat numpy arrays, with the rank of the merge that each symbol
would make with the next one of its word. A round takes the least rank of every word, merges its leftmost
non-overlapping places at once, drops the second halves, renews the ranks beside a merge and sets words
without a merge aside; it ends when no word is left. The library merges one pair at a time, best score
first and leftmost among equals. Merging all places of a rank at once gives the same pieces unless a merged
piece could at once merge again at the same or a better rank; the vocabulary tells for which pieces that
can be (``hasty``). Of these only the leftmost place is merged in a round, and words above ``LONG`` symbols
that meet them are merged from a heap, in the library's order.

Words above ``LONG`` symbols are first cut between characters that stand side by side in no piece.
Symbols that are no piece become bytes, or the unknown id (one for a run) in models without bytes.

Defined results: null and empty texts give no ids and decode to an empty text; repeated rows are encoded
each; a null id passes through; an empty table gives an empty result; other columns are ignored. Any text
is taken whole, memory is that of an Arrow batch.
"""

from __future__ import annotations

import heapq
import re
import sys
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "▁"
LONG = 64
CACHE = 500_000
NONE = np.iinfo(np.int32).max
ENCODED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
DIGEST = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_text", T.StringType()),
    T.StructField("decoded", T.StringType())])


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        shift += 7
        at += 1
        if raw[at - 1] < 128:
            return value, at


def message(raw: bytes) -> dict[int, list]:
    """Fields of a protocol buffer message: number -> values (whole numbers or bytes)."""
    out, at = {}, 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at:at + size], at + size
        out.setdefault(key >> 3, []).append(value)
    return out


# Field numbers and piece types of the public model format (fixed values).
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MODEL_TYPE, BPE = 3, 2
UNKNOWN_SURFACE = 44
CHARSMAP, DUMMY_PREFIX, NO_EXTRA_SPACES, ESCAPE_SPACES = 2, 3, 4, 5


class Vocabulary:
    """Pieces, merges and settings of a model file."""

    def __init__(self, raw: bytes):
        model = message(raw)
        trainer, rule = message(model[TRAINER][0]), message(model[NORMALIZER][0])
        rows = [message(p) for p in model[PIECES]]
        kinds = [r.get(TYPE, [NORMAL])[0] for r in rows]
        self.pieces = [r[PIECE][0].decode("utf-8") for r in rows]
        plain = (trainer.get(MODEL_TYPE, [1])[0] == BPE and not rule.get(CHARSMAP, [b""])[0]
                 and rule.get(ESCAPE_SPACES, [1])[0] and not rule.get(NO_EXTRA_SPACES, [1])[0]
                 and set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE})
        if not plain or any(SPACE in p.lstrip(SPACE) for p, k in zip(self.pieces, kinds) if k == NORMAL):
            raise ValueError("only BPE models without normaliser, own symbols and pieces across words are read")
        self.prefix = bool(rule.get(DUMMY_PREFIX, [1])[0])
        self.surface = trainer.get(UNKNOWN_SURFACE, [" ⁇ ".encode()])[0]
        self.unknown = kinds.index(UNKNOWN)
        self.control = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i, k in enumerate(kinds) if k == BYTE}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        # what a piece adds to a text, None where that depends on its neighbours
        self.shown = [p.replace(SPACE, " ") if k == NORMAL else None for p, k in zip(self.pieces, kinds)]
        self.digits = [str(i) for i in range(len(self.pieces))]
        self.digit_size = np.array([len(d) for d in self.digits], dtype=np.int64)
        # the same as bytes, and how many characters they begin
        self.raw = [p.replace(SPACE, " ").encode() if k == NORMAL else self.surface if k == UNKNOWN
                    else bytes([self.byte_of[i]]) if k == BYTE else b""
                    for i, (p, k) in enumerate(zip(self.pieces, kinds))]
        self.raw_size = np.array([sum(b & 0xC0 != 0x80 for b in x) for x in self.raw], dtype=np.int64)
        self._merges([(p, float(np.frombuffer(r[SCORE][0], dtype="<f4")[0]) if SCORE in r else 0.0, i)
                      for i, (p, r, k) in enumerate(zip(self.pieces, rows, kinds)) if k == NORMAL])

    def _merges(self, normal: list[tuple[str, float, int]]) -> None:
        """Symbols (ids, then characters that are no piece) and the merge table, by left and right symbol."""
        symbols = {p: i for p, _, i in normal}
        self.n_pieces = len(self.pieces)
        for p, _, _ in normal:
            for c in p:
                symbols.setdefault(c, self.n_pieces + len(symbols) - len(normal))
        self.symbol = symbols
        self.of_code = np.full(sys.maxunicode + 1, -1, dtype=np.int32)
        single = {c: i for c, i in symbols.items() if len(c) == 1}
        self.of_code[[ord(c) for c in single]] = list(single.values())
        self.n_symbols = max([self.n_pieces, *(s + 1 for s in symbols.values())])
        order = {s: r for r, s in enumerate(sorted({s for _, s, _ in normal}, reverse=True))}
        rank_of = {i: order[s] for _, s, i in normal}
        pairs, sides = {}, set()
        self.hasty = np.zeros(self.n_symbols, dtype=bool)
        for p, _, i in normal:
            sides.update(zip(p, p[1:]))
            for cut in range(1, len(p)):
                left, right = symbols.get(p[:cut]), symbols.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left * self.n_symbols + right] = (rank_of[i], i)
                    for half in (left, right):  # would this half, just merged, merge on before its equals?
                        self.hasty[half] |= rank_of.get(half, -1) >= rank_of[i]
        self.sides = sides
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int32)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int32)
        self._table: dict[tuple[int, int], tuple[int, int]] | None = None
        self._slots()

    def _slots(self) -> None:
        """Hash table of the merges, a quarter full at most; a taken slot passes on to the next."""
        size = 1 << max(4, 2 + len(self.keys).bit_length())
        self.shift, self.last = np.uint64(65 - size.bit_length()), size - 1
        self.slot_key, self.slot_at = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int32)
        at, rest = self._slot(self.keys), np.arange(len(self.keys))
        while len(rest):
            free = self.slot_key[at] < 0
            _, one = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[one]
            self.slot_key[at[won]], self.slot_at[at[won]] = self.keys[rest[won]], rest[won]
            more = np.ones(len(rest), dtype=bool)
            more[won] = False
            rest, at = rest[more], at[more] + 1 & self.last

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def table(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left, right) -> (rank, piece), made when first asked for."""
        if self._table is None:
            left, right = np.divmod(self.keys, self.n_symbols)
            self._table = dict(zip(zip(left.tolist(), right.tolist()), zip(self.ranks.tolist(), self.made.tolist())))
        return self._table

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of merging neighbours; rank ``NONE`` where they do not merge. Negative symbols never do."""
        rank, piece = np.full(len(left), NONE, dtype=np.int32), np.full(len(left), -1, dtype=np.int32)
        able = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[able].astype(np.int64) * self.n_symbols + right[able]
        at = self._slot(key)
        while len(able):
            found = self.slot_key[at]
            hit = found == key
            merge, to = self.slot_at[at[hit]], able[hit]
            rank[to], piece[to] = self.ranks[merge], self.made[merge]
            on = np.flatnonzero(~hit & (found >= 0))
            able, key, at = able[on], key[on], at[on] + 1 & self.last
        return rank, piece


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def _one_by_one(v: Vocabulary, symbols: list[int]) -> list[int]:
    """Best rank first, leftmost among equals, from a heap: the order that the library merges in."""
    n = len(symbols)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int, int]] = []
    merges = v.table()

    def offer(a: int, b: int) -> None:
        found = merges.get((symbols[a], symbols[b]))
        if found:
            heapq.heappush(heap, (found[0], a, symbols[a], symbols[b], found[1]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, a, left, right, piece = heapq.heappop(heap)
        b = after[a] if alive[a] else n
        if b >= n or symbols[a] != left or symbols[b] != right:
            continue
        symbols[a], alive[b], after[a] = piece, False, after[b]
        if after[b] < n:
            before[after[b]] = a
            offer(a, after[a])
        if before[a] >= 0:
            offer(before[a], a)
    return [s for s, on in zip(symbols, alive) if on]


def _flat(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Symbols of all words, the size of each word, and the characters that are no symbol (symbol -1 - place)."""
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbols = v.of_code[code]
    odd = np.flatnonzero(symbols < 0)
    strange, place = np.unique(code[odd], return_inverse=True)
    symbols[odd] = -1 - place
    return symbols, np.fromiter(map(len, words), dtype=np.int64, count=len(words)), [chr(c) for c in strange.tolist()]


def _cut_long(v: Vocabulary, words: list[str], size: np.ndarray) -> np.ndarray:
    """Numbers of the pieces of work: words, those above ``LONG`` cut between characters that no piece joins."""
    start = np.cumsum(size) - size
    new = np.zeros(int(size.sum()), dtype=bool)
    new[start] = True
    for i in np.flatnonzero(size > LONG).tolist():
        w, at = words[i], start[i]
        new[at + 1:at + len(w)] = [p not in v.sides for p in zip(w, w[1:])]
    return np.cumsum(new)


def merge_rounds(v: Vocabulary, symbols: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Symbols after all merges, negative where a symbol was swallowed; ``part`` ascends, merges stay inside it."""
    done = np.full(len(symbols), np.iinfo(np.int32).min, dtype=np.int32)
    place = np.arange(len(symbols))
    symbols = symbols.copy()
    ends = np.append(part[1:] != part[:-1], True) if len(part) else np.zeros(0, dtype=bool)
    rank, piece = v.look_up(symbols, np.append(symbols[1:], -1)) if len(part) else (symbols, symbols)
    rank[ends] = NONE
    while len(symbols):
        start = np.flatnonzero(np.concatenate(([True], ends[:-1])))
        size = np.diff(np.append(start, len(symbols)))
        least = np.minimum.reduceat(rank, start)
        # words without a merge are done
        active = np.repeat(least != NONE, size)
        if not active.all():
            rest = ~active
            done[place[rest]] = symbols[rest]
            symbols, place, rank, piece, ends = (x[active] for x in (symbols, place, rank, piece, ends))
            if not len(symbols):
                break
            size, least = size[least != NONE], least[least != NONE]
            start = np.cumsum(size) - size
        hit = rank == np.repeat(least, size)
        # of overlapping places every second one, from the left
        edge = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
        at = np.flatnonzero(hit)
        at = at[(at - edge[np.searchsorted(edge, at, side="right") - 1]) % 2 == 0]
        hasty = v.hasty[piece[at]]
        if hasty.any():
            word = np.searchsorted(start, at, side="right") - 1
            first = np.ones(len(at), dtype=bool)
            first[1:] = word[1:] != word[:-1]
            mixed = np.unique(word[hasty])  # equal ranks may make several pieces: the whole word waits
            long = mixed[size[mixed] > LONG]
            at = at[(first | ~np.isin(word, mixed)) & ~np.isin(word, long)]
            for w in long.tolist():
                a, b = start[w], start[w] + size[w]
                out = _one_by_one(v, symbols[a:b].tolist())
                done[place[a:a + len(out)]] = out
            if len(long):
                keep = ~np.repeat(np.isin(np.arange(len(size)), long), size)
                at = np.searchsorted(np.flatnonzero(keep), at)
                symbols, place, rank, piece, ends = (x[keep] for x in (symbols, place, rank, piece, ends))
        if not len(at):
            continue
        symbols[at] = piece[at]
        ends[at] = ends[at + 1]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        now = np.cumsum(keep)[at] - 1
        symbols, place, rank, piece, ends = (x[keep] for x in (symbols, place, rank, piece, ends))
        beside = np.zeros(len(symbols) + 1, dtype=bool)
        beside[now] = beside[now - 1] = True  # the last place takes what is left of the first
        touched = np.flatnonzero(beside[:-1])
        right = np.minimum(touched + 1, len(symbols) - 1)
        rank[touched], piece[touched] = v.look_up(symbols[touched], symbols[right])
        rank[touched[ends[touched]]] = NONE
    return done


def encode_flat(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words (a run of U+2581, if any, and what follows it), and how many each word has."""
    symbols, size, strange = _flat(v, words)
    done = merge_rounds(v, symbols, _cut_long(v, words, size))
    left = done != np.iinfo(np.int32).min
    owner, done = np.repeat(np.arange(len(words)), size)[left], done[left]
    odd = np.flatnonzero((done < 0) | (done >= v.n_pieces))
    if len(odd):
        names = {s: c for c, s in v.symbol.items() if s >= v.n_pieces}
        kinds, place = np.unique(done[odd], return_inverse=True)
        spelled = [[v.id_of_byte[b] for b in (strange[-1 - s] if s < 0 else names[s]).encode("utf-8")]
                   if v.id_of_byte else [v.unknown] for s in kinds.tolist()]
        most = max(map(len, spelled))
        table = np.array([ids + [-1] * (most - len(ids)) for ids in spelled], dtype=np.int32)[place]
        times = np.ones(len(done), dtype=np.int64)
        times[odd] = (table >= 0).sum(axis=1)
        at = (np.cumsum(times) - times)[odd]
        owner, done = np.repeat(owner, times), np.repeat(done, times)
        for k in range(most):
            full = table[:, k] >= 0
            done[at[full] + k] = table[full, k]
    return done, np.bincount(owner, minlength=len(words))


def encode_words(v: Vocabulary, words: list[str]) -> list[list[int]]:
    """Ids of every word."""
    ids, size = encode_flat(v, words)
    flat, ends = ids.tolist(), np.cumsum(size).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def cut(v: Vocabulary, text: str | None) -> list[str]:
    if not text:
        return []
    spaced = text.replace(" ", SPACE)
    return WORD.findall(SPACE + spaced if v.prefix else spaced)


def _pieces_of(whole: str, ends: np.ndarray, gap: int = 0) -> list[str]:
    """Stretches of a text up to each end, without the last ``gap`` characters."""
    at = ends.tolist()
    return [whole[a:b - gap] for a, b in zip([0, *at], at)]


def worded(v: Vocabulary, words: list[str]) -> list[tuple[str, str]]:
    """Per word its ids as text, and the text they decode to inside a text."""
    if not words:
        return []
    ids, size = encode_flat(v, words)
    last = np.cumsum(size)
    flat = ids.tolist()
    ends = np.cumsum(v.digit_size[ids] + 1)[last - 1]
    written = _pieces_of(",".join([v.digits[i] for i in flat]) + ",", ends, gap=1)
    # words hold whole characters, so the bytes of all words are UTF-8, cut where a word's last character ends
    shown = _pieces_of(b"".join([v.raw[i] for i in flat]).decode("utf-8"), np.cumsum(v.raw_size[ids])[last - 1])
    return list(zip(written, shown))


class Memory:
    """What a worker remembers of distinct words: the ids as text, and the text they decode to inside a text."""

    def __init__(self, v: Vocabulary, most: int = CACHE):
        self.v, self.most = v, most
        self.words: dict[str, tuple[str, str]] = {}

    def learn(self, split: list[list[str]]) -> list[list[tuple[str, str]]]:
        """What is known of every word."""
        flat = list(chain.from_iterable(split))
        own = list(map(self.words.get, flat))
        missing = [i for i, x in enumerate(own) if x is None]
        new = list(dict.fromkeys([flat[i] for i in missing]))
        made = dict(zip(new, worded(self.v, new)))
        for i in missing:
            own[i] = made[flat[i]]
        if len(self.words) + len(made) > self.most:
            self.words = dict(zip(flat, own))
        else:
            self.words.update(made)
        ends = np.cumsum([len(words) for words in split]).tolist()
        return [own[a:b] for a, b in zip([0, *ends], ends)]


def numbers(own: list[tuple[str, str]]) -> list[int]:
    """Ids of words, from their text."""
    return list(map(int, ",".join([x[0] for x in own]).split(","))) if own else []


def one_unknown(v: Vocabulary, ids: list[int]) -> list[int]:
    """In models without bytes a run of unknown characters is one id."""
    return ids if v.id_of_byte else [x for k, x in enumerate(ids) if x != v.unknown or not k or ids[k - 1] != x]


def encode_batch(memory: Memory, texts: list[str | None]) -> list[list[int]]:
    """Ids of every text, without begin or end."""
    known = memory.learn([cut(memory.v, t) for t in texts])
    return [one_unknown(memory.v, numbers(own)) for own in known]


def decode(v: Vocabulary, ids: list[int], first: bool = True) -> str:
    """Text of any ids: runs of bytes as UTF-8 (U+FFFD for each byte that is not), the added space left out
    (``first``: the ids begin the text)."""
    first = first and v.prefix
    plain = [v.shown[i] for i in ids]
    if None not in plain:
        text = "".join(plain)
        return text[1:] if first and text.startswith(" ") else text
    out: list[str] = []
    run = bytearray()

    def flush() -> None:
        if run:
            out.append(_utf8(bytes(run)))
            run.clear()

    for i in ids:
        if i in v.byte_of:
            run.append(v.byte_of[i])
            continue
        flush()
        first = first and not any(out)
        if i in v.control:
            continue
        piece = v.surface.decode() if i == v.unknown else v.pieces[i]
        if first and i != v.unknown and piece.startswith(SPACE):
            piece, first = piece[1:], False
        out.append(piece if i == v.unknown else piece.replace(SPACE, " "))
    flush()
    return "".join(out)


def _utf8(raw: bytes) -> str:
    """Valid characters, and U+FFFD for every other byte."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(raw[at:at + e.start].decode("utf-8") + "�")
            at += e.start + 1
    return "".join(out)


@lru_cache(maxsize=4)
def memory_of(path: str) -> Memory:
    return Memory(vocabulary(path))


def tokens(path: str):
    """Function from a text column to its ids and the text they decode to. ``path``: model file, on every worker."""

    @F.pandas_udf(ENCODED)
    def run(texts: pd.Series) -> pd.DataFrame:
        memory = memory_of(path)
        ids = encode_batch(memory, texts.tolist())
        return pd.DataFrame({"ids": ids, "decoded": [decode(memory.v, x) for x in ids]}, columns=ENCODED.names)

    return run


def token_text(path: str):
    """Function from a text column to the number of ids, the ids as decimal text joined by commas, and the decoded
    text: both put together from those of distinct words."""

    @F.pandas_udf(DIGEST)
    def run(texts: pd.Series) -> pd.DataFrame:
        memory = memory_of(path)
        v = memory.v
        rows = []
        for own in memory.learn([cut(v, t) for t in texts]):
            if v.id_of_byte:  # a word ends no run of the next one's bytes, as that begins with U+2581
                ids = ",".join([x[0] for x in own])
                rows.append((ids.count(",") + 1 if own else 0, ids,
                             decode(v, numbers(own[:1])) + "".join([x[1] for x in own[1:]])))
            else:
                ids = one_unknown(v, numbers(own))
                rows.append((len(ids), ",".join(map(str, ids)), decode(v, ids)))
        return pd.DataFrame(rows, columns=DIGEST.names)

    return run


def tokenized(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, decoded."""
    t: Column = F.col(f"`{text}`")
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), tokens(path)(t).alias("made")).select("doc_id", "made.*")
