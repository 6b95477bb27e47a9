"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

Encoding.  A text is cut into pre-tokens; each pre-token's bytes go through a transducer
that holds a window of bytes.  ``MergeTable.lookahead`` is computed from the merge list: to
know whether a merge happens across byte position q, it suffices to see that many bytes to
the right of q.  For merge ``u+v`` of rank r the right-hand need is

    need(u+v) = |v| + max(need(r') : rank r' < r, left part of r' on the right spine of v)

because only an earlier merge that takes a suffix token of ``v`` across its right end can
keep ``v`` from forming.  A boundary with ``lookahead`` bytes behind it is final, so the
tokens before it are emitted and their bytes forgotten: memory is a constant number of
bytes whatever the length of the text.  Short pieces are remembered in a table of two generations,
so a worker's memory is bounded and frequent pieces stay; those of a group of texts that it does not
hold are merged together, a merge of each in every round.

Decoding.  Token ids become bytes, and an incremental UTF-8 state machine turns bytes into
text, carrying at most three bytes of an open character between blocks; invalid sequences
become U+FFFD as in the public library.

Cases: null and empty texts give no ids and decode to ""; null id arrays decode to "";
unknown ids raise; repeated rows are encoded alike; other columns are passed through, and a
column that already has the output's name is replaced.
"""

from __future__ import annotations

import codecs
import functools
import gc
import heapq
import json
import string
import struct
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import column, extended

TOKENIZER = "byte_bpe_50k.json"
# Fixed value: the public byte-level pre-token pattern.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A cut before this space never changes the pre-tokens.
SAFE_CUT = r"(?<=\S) (?=\S)"
BLOCK_CHARS = 1 << 16
MEMO_PIECE_CHARS = 64
# Of a generation; a worker holds two.
MEMO_ENTRIES = 1 << 18
MEMO_PRETOKENS = 1 << 16
# Characters of the texts whose pieces are merged together.
GROUP_CHARS = 1 << 21
SHORT_BYTES = 64
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1
NO_MERGE = 1 << 62
NO_RANK = np.int32((1 << 31) - 1)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """Vocabulary, ranked merges and the sufficient lookahead of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        self.token_bytes = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if all(c in alphabet for c in t)}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        # (left id, right id) -> rank and merged id in one integer; NO_MERGE for pairs without a merge
        self.merges = {vocab[a] << ID_BITS | vocab[b]: rank << ID_BITS | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.lookahead = sufficient_lookahead(pairs)
        self.sorted_pairs = np.array(sorted(self.merges), np.int64)
        merges = [self.merges[p] for p in self.sorted_pairs.tolist()]
        self.sorted_ranks = np.array([m >> ID_BITS for m in merges], np.int32)
        self.merged = np.array([m & ID_MASK for m in sorted(merges)], np.int32)  # by rank
        # ranks of the pairs of bytes
        one = np.array(self.byte_id, np.int32)
        self.byte_ranks = self._ranked(np.repeat(one, 256), np.tile(one, 256))

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one byte string (lowest rank first, leftmost first)."""
        ids = [self.byte_id[b] for b in data]
        return self._merge_short(ids) if len(ids) <= SHORT_BYTES else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        ranks = [get(a << ID_BITS | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NO_MERGE:
            i = ranks.index(best)
            ids[i] = best & ID_MASK
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << ID_BITS | ids[i + 1], NO_MERGE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << ID_BITS | ids[i], NO_MERGE)
        return ids

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.sorted_pairs):
            return np.full(len(left), NO_RANK, np.int32)
        pair = left.astype(np.int64) << ID_BITS | right
        at = np.minimum(np.searchsorted(self.sorted_pairs, pair), len(self.sorted_pairs) - 1)
        return np.where(self.sorted_pairs[at] == pair, self.sorted_ranks[at], NO_RANK)

    def merge_all(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of many short texts that are not empty: in each round every one merges its best
        pair, the same steps as ``merge``."""
        out: list[bytes] = [b""] * len(pieces)
        data = "".join(pieces).encode()
        chars = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(data, np.uint8)
        if len(raw) == chars.sum():
            sizes = chars
        else:  # bytes of each text from the bytes that begin a character
            begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            sizes = np.diff(begins[np.append(0, np.cumsum(chars))])
        ids = np.array(self.byte_id, np.int32)[raw]
        names = np.arange(len(pieces), dtype=np.int32)
        ranks = np.append(self.byte_ranks[raw[:-1].astype(np.int32) << 8 | raw[1:]], NO_RANK)
        ranks[np.cumsum(sizes) - 1] = NO_RANK  # a pair never spans two texts
        while len(names):
            first = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(ranks, first)
            going = best != NO_RANK
            if not going.all():
                done, packed = ~going, ids.astype("<i4").tobytes()
                start = 4 * first[done]
                for name, i, j in zip(names[done].tolist(), start.tolist(), (start + 4 * sizes[done]).tolist()):
                    out[name] = packed[i:j]
                stays = np.repeat(going, sizes)
                ids, ranks, names, sizes, best = ids[stays], ranks[stays], names[going], sizes[going], best[going]
                if not len(names):
                    break
            piece = np.repeat(np.arange(len(names), dtype=np.int32), sizes)
            found = np.flatnonzero(ranks == best[piece])
            at = found[np.append(True, np.diff(piece[found]) > 0)]  # the leftmost of each text
            ids[at] = self.merged[best]
            left = np.ones(len(ids), bool)
            left[at + 1] = False
            ids, ranks, piece, sizes = ids[left], ranks[left], piece[left], sizes - 1
            at = at - np.arange(len(at))  # each text before has lost an id
            # the pairs that the new ids are part of
            near = np.concatenate([at, at[(at > 0) & (piece[at - 1] == piece[at])] - 1])
            ranks[near] = NO_RANK
            near = near[near + 1 < len(ids)]
            near = near[piece[near] == piece[near + 1]]
            ranks[near] = self._ranked(ids[near], ids[near + 1])
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank and merged id, position, pair) over a linked list."""
        get, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found, i, pair) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (found := get(pair := a << ID_BITS | b))]
        heapq.heapify(heap)
        while heap:
            found, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] < 0 or ids[i] << ID_BITS | ids[j] != pair:
                continue
            ids[i], ids[j] = found & ID_MASK, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if more := get(pair := ids[i] << ID_BITS | ids[k]):
                    heapq.heappush(heap, (more, i, pair))
            if (h := before[i]) >= 0 and (more := get(pair := ids[h] << ID_BITS | ids[i])):
                heapq.heappush(heap, (more, h, pair))
        return [t for t in ids if t >= 0]


def sufficient_lookahead(pairs: list[tuple[str, str]]) -> int:
    """Bytes to the right of a position that decide whether a merge crosses it (see above)."""
    need_by_left: dict[str, int] = {}
    right_part: dict[str, str] = {}
    most = 0
    for left, right in pairs:
        blocked, tail = 0, right
        while tail:
            blocked = max(blocked, need_by_left.get(tail, 0))
            tail = right_part.get(tail, "")
        need = len(right) + blocked
        need_by_left[left] = max(need_by_left.get(left, 0), need)
        right_part.setdefault(left + right, right)
        most = max(most, need)
    return most


class Transducer:
    """Feed bytes of one pre-token; get the ids that can't change any more."""

    def __init__(self, table: MergeTable):
        self.table, self.window = table, bytearray()
        self.step = 4 * max(table.lookahead, 64)

    def feed(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.step):
            self.window += data[at:at + self.step]
            if len(self.window) >= self.step:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        limit, done = len(self.window) - self.table.lookahead, 0
        for t in self.table.merge(bytes(self.window)):
            size = len(self.table.token_bytes[t])
            if done + size > limit:
                break
            done += size
            yield t
        del self.window[:done]

    def flush(self) -> Iterator[int]:
        yield from self.table.merge(bytes(self.window))
        self.window.clear()


class _Memo(dict):
    """Piece -> its ids as packed 32-bit integers; short pieces only, bounded.

    A piece is what stands between two single spaces; the space before it belongs to it.  A
    cut before a space with no white space beside it never changes the pre-tokens, so pieces
    are encoded one by one.  A piece that is empty or has white space at an end gives None.
    ``MEMO_ENTRIES`` pieces are a generation; the one before is kept for what is used again.
    """

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.older = codec, {}

    def renew(self, most: int) -> None:
        """A table of ``most`` pieces becomes the older generation."""
        if len(self) >= most:
            self.older = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes | None:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        if (ids := self.older.get(piece)) is None:
            if piece.isalpha() and len(piece) <= MEMO_PIECE_CHARS:  # one pre-token of letters
                ids = self.codec.pack(self.codec.table.merge(b" " + piece.encode()))
            else:
                ids = self.codec.pretokens(" " + piece)
        if len(piece) <= MEMO_PIECE_CHARS:
            self.renew(2 * MEMO_ENTRIES)
            self[piece] = ids
        return ids


class _Pretokens(dict):
    """Pre-tokens that are no word after a space: bounded too."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, pretoken: str) -> bytes:
        if len(self) >= MEMO_PRETOKENS:
            self.clear()
        ids = self[pretoken] = self.codec.pack(self.codec.table.merge(pretoken.encode()))
        return ids


class Codec:
    """Encoder and decoder of one tokenizer file; one per worker process."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.memo, self.others = _Memo(self), _Pretokens(self)
        self.pretoken, self.cut = regex.compile(PRETOKEN), regex.compile(SAFE_CUT)
        self.special = regex.compile("|".join(map(regex.escape, self.table.special))) if self.table.special else None

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}i", *ids)

    def learn(self, texts: list[str]) -> None:
        """Fill the table of short pieces with those of some texts that it does not hold, merged together."""
        self._known(list({p for text in texts for p in text.split(" ")}))

    def _known(self, pieces: list[str]) -> list[bytes | None]:
        """The packed ids of distinct pieces; None where a text can't be cut at the piece."""
        memo = self.memo
        memo.renew(MEMO_ENTRIES)
        found = list(map(memo.get, pieces))
        fresh = [p for p, ids in zip(pieces, found) if ids is None]
        if older := memo.older:
            known = list(filter(older.__contains__, fresh))
            memo.update(zip(known, map(older.__getitem__, known)))
            fresh = list(filterfalse(older.__contains__, fresh))
        self._learn(fresh)
        return [memo[p] if ids is None else ids for p, ids in zip(pieces, found)]

    def _learn(self, fresh: list[str]) -> None:
        memo, others = self.memo, self.others
        words = {p for p in fresh if p.isalpha() and len(p) <= MEMO_PIECE_CHARS}
        mixed = [p for p in filterfalse(words.__contains__, fresh)
                 if p and len(p) <= MEMO_PIECE_CHARS and not p[0].isspace() and not p[-1].isspace()]
        # a cut before each of these spaces never changes the pre-tokens
        parts = self.pretoken.findall(" " + " ".join(mixed)) if mixed else []
        words.update(w for t in parts if t[0] == " " and (w := t[1:]).isalpha() and w not in memo)
        memo.update(zip(words, self.table.merge_all([" " + w for w in words])))
        signs = list({t for t in parts if t not in others and (t[0] != " " or not t[1:].isalpha())})
        if len(others) + len(signs) > MEMO_PRETOKENS:
            others.clear()
        others.update(zip(signs, self.table.merge_all(signs)))
        starts = [i for i, t in enumerate(parts) if t[0] == " "]
        coded = [memo[t[1:]] if t[0] == " " and t[1:].isalpha() else others[t] for t in parts]
        for piece, i, j in zip(mixed, starts, [*starts[1:], len(parts)]):
            memo[piece] = b"".join(coded[i:j])

    def pretokens(self, text: str) -> bytes:
        """Packed ids of a text, one pre-token after the other."""
        out = []
        for m in self.pretoken.finditer(text):
            start, end = m.span()
            if end - start > MEMO_PIECE_CHARS:
                out.append(self._long(text, start, end))
            elif (piece := m.group())[0] == " " and piece[1:].isalpha():
                out.append(self.memo[piece[1:]])
            else:
                out.append(self.others[piece])
        return b"".join(out)

    def _long(self, text: str, start: int, end: int) -> bytes:
        """Packed ids of one long pre-token, emitted as they get stable."""
        stream, out = Transducer(self.table), []
        for at in range(start, end, BLOCK_CHARS):
            out += stream.feed(text[at:min(end, at + BLOCK_CHARS)].encode())
        return self.pack([*out, *stream.flush()])

    def _block(self, block: str) -> bytes:
        first, *rest = block.split(" ")
        if first and not first[-1].isspace() or not rest:
            try:
                return b"".join([self.pretokens(first), *map(self.memo.__getitem__, rest)])
            except TypeError:  # a piece is None: the block can't be cut at every space
                pass
        return self.pretokens(block)

    def _plain(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text without special tokens, block by block."""
        start = 0
        while len(text) - start > BLOCK_CHARS and (found := self.cut.search(text, start + BLOCK_CHARS)):
            yield self._spaced(text[start:found.start()], start)
            start = found.start()
        yield self._spaced(text[start:], start)

    def _spaced(self, block: str, start: int) -> bytes:
        """A block after the first begins with the space before its first piece."""
        if start and (found := self.cut.search(block, 1)):
            head = self.pretokens(block[:found.start()])
            try:
                return head + b"".join(map(self.memo.__getitem__, block[found.start() + 1:].split(" ")))
            except TypeError:
                return self.pretokens(block)
        return self._block(block)

    def encode_blocks(self, text: str) -> Iterator[bytes]:
        at = 0
        if self.special is not None:
            for m in self.special.finditer(text):
                yield from self._plain(text[at:m.start()])
                yield np.array([self.table.special[m.group()]], "<i4").tobytes()
                at = m.end()
        yield from self._plain(text[at:] if at else text)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text (int32); none for null."""
        return np.frombuffer(b"".join(self.encode_blocks(text or "")), "<i4")

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Packed ids of each text; texts are taken in groups of bounded size."""
        group, chars = [], 0
        for text in texts:
            group.append(text or "")
            chars += len(group[-1])
            if chars >= GROUP_CHARS:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        """Texts of one block without special tokens are cut into pieces and put together again as columns."""
        special = list(self.table.special)
        plain = [len(t) <= BLOCK_CHARS and not any(map(t.__contains__, special)) for t in texts]
        split = pc.split_pattern(pa.array([t for t, p in zip(texts, plain) if p], pa.string()), " ")
        bounds, pieces = split.offsets.to_numpy(), split.values.dictionary_encode()
        of, pieces = pieces.indices.to_numpy(), pieces.dictionary
        # letters and the signs behind them are two pre-tokens
        stems = pc.ascii_rtrim(pieces, string.punctuation)
        ended = pc.and_(pc.ascii_is_alpha(stems), pc.less_equal(pc.binary_length(pieces), MEMO_PIECE_CHARS))
        words = pc.if_else(ended, stems, pieces).dictionary_encode()
        signs = pc.if_else(ended, pc.ascii_ltrim(pieces, string.ascii_letters), "").dictionary_encode()
        known = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        apart = np.fromiter((ids is None for ids in known), bool, len(known))
        known = [b"" if ids is None else ids for ids in known]
        two = np.stack([words.indices.to_numpy(), signs.indices.to_numpy() + len(known)])[:, of]
        known += [self.others[t] if t else b"" for t in signs.dictionary.to_pylist()]
        whole = np.append(0, np.cumsum(apart[two[0]]))
        two[:, bounds[:-1]] = len(known)  # no space stands before a text's first piece
        sizes = np.fromiter(map(len, [*known, b""]), np.int64, len(known) + 1) // 4
        two = two.T.ravel()
        starts, sizes = (np.cumsum(sizes) - sizes)[two], sizes[two]
        ends = np.append(0, np.cumsum(sizes))
        flat = np.frombuffer(b"".join(known), "<i4")
        coded = flat[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        at, ends, whole = 0, (4 * ends[2 * bounds]).tolist(), whole[np.stack([bounds[:-1] + 1, bounds[1:]])].T.tolist()
        for text, p in zip(texts, plain):
            if not p:
                yield b"".join(self.encode_blocks(text))
                continue
            first, space, _ = text.partition(" ")
            (before, after), i, j = whole[at], ends[at], ends[at + 1]
            at += 1
            if space and (before != after or not first or first[-1].isspace()):
                yield self.pretokens(text)  # it can't be cut at every space
            else:
                yield self.pretokens(first) + coded[i:j]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, special ones included."""
        machine, lookup, out = codecs.getincrementaldecoder("utf-8")("replace"), self.table.token_bytes, []
        for at in range(0, len(ids), BLOCK_CHARS):
            out.append(machine.decode(b"".join(map(lookup.__getitem__, ids[at:at + BLOCK_CHARS].tolist()))))
        out.append(machine.decode(b"", True))
        return "".join(out)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    tool = Codec(path)
    gc.freeze()  # collections need not walk its tables
    return tool


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _replaced(df: DataFrame, dropped: str, name: str, kind: T.DataType) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name not in (dropped, name)]
    return T.StructType([*kept, T.StructField(name, kind, False)])


def encode_documents(df: DataFrame, text_col: str = "text", ids_col: str = "ids",
                     tokenizer_path: str | None = None) -> DataFrame:
    """Replace the text column by the text's token ids (array of int)."""
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            texts = column(batch, text_col).to_pylist()
            ids = list(tool.encode_all(texts))
            offsets = np.zeros(len(ids) + 1, "i4")
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            kept = [n for n in batch.schema.names if n not in (text_col, ids_col)]
            yield extended(batch, kept, {ids_col: pa.ListArray.from_arrays(pa.array(offsets), flat)})

    return df.mapInArrow(run, _replaced(df, text_col, ids_col, T.ArrayType(T.IntegerType())))


def decode_documents(df: DataFrame, ids_col: str = "ids", text_col: str = "text",
                     tokenizer_path: str | None = None) -> DataFrame:
    """Replace the ids column by the text that the ids stand for."""
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            none = np.zeros(0, "i4")
            texts = [tool.decode(none if x.values is None else x.values.to_numpy()) for x in column(batch, ids_col)]
            kept = [n for n in batch.schema.names if n not in (text_col, ids_col)]
            yield extended(batch, kept, {text_col: pa.array(texts, pa.string())})

    return df.mapInArrow(run, _replaced(df, ids_col, text_col, T.StringType()))


def round_trip(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    ids = encode_documents(docs.select("doc_id", "text"), tokenizer_path=tokenizer_path)
    digest = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    back = decode_documents(digest, text_col="decoded", tokenizer_path=tokenizer_path)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
