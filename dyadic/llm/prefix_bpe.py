"""Byte-level BPE by dynamic programming over prefixes.

Of every prefix of a byte string exactly one token can be the last one of the
prefix's encoding: the token t that ends there and fits behind the last token of
the prefix without t. Two tokens fit when merging their joined bytes gives these
two back. So one token per prefix holds the whole encoding (walk back from the
end), an append only adds entries, and after an edit the entries before it stay,
those behind it are computed anew until they have agreed with the old ones over
the longest token's length.

Whether two tokens fit is read off their merge trees: the edge tokens on both sides
of the joint live from their own rank to their parent's rank, and the tokens fit if
no merge across the joint falls due while both of its sides live.

Texts are first cut by the pattern; each match is encoded by itself. Within a
worker, prefixes of short matches share their entries in a table of bounded size.

Vocabulary: the lines of a rank file (base64 token, rank), read by the driver and
broadcast; ``MAX_VOCABULARY_BYTES`` bounds the file. Every byte has to be a token, and
every longer token the merge of two lower ones (checked on loading).

Defined cases: null texts count as empty; the empty text has no tokens; equal rows
give equal results; ids may be null or repeated; other columns are not read; empty
tables give empty results; texts are worked on whole, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_VOCABULARY_BYTES = 64 << 20
#: matches up to so many bytes share prefixes in the table; the table is emptied beyond so many entries
SHORT, ENTRIES = 64, 500_000
_NEVER = 1 << 62


class _Memo(dict):
    """Answers of ``ask`` by key, emptied when they are too many."""

    def __init__(self, ask, most: int):
        super().__init__()
        self._ask, self._most = ask, most

    def __missing__(self, key):
        if len(self) > self._most:
            self.clear()
        self[key] = answer = self._ask(key)
        return answer


class Vocabulary:
    """Tokens by id, merge trees, and ``fits[a << 32 | b]``: whether token b may follow token a inside one match."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        if len(self.tokens) < len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks have to be distinct and every byte a token")
        self.longest = max(map(len, ranks))
        self.packed = {i: i.to_bytes(4, "little") for i in self.tokens}
        self.fits = _Memo(self._fits, 4 * ENTRIES)
        self._left: dict[int, int] = {}
        self._right: dict[int, int] = {}
        for token, i in ranks.items():
            if len(token) > 1:
                halves = merge_by_rank(token, ranks, i)
                if len(halves) != 2:
                    raise ValueError(f"token {i} is no merge of two lower tokens")
                self._left[i], self._right[i] = ranks[halves[0]], ranks[halves[1]]

    @classmethod
    def parse(cls, lines: bytes) -> Vocabulary:
        pairs = (line.split() for line in lines.splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    @staticmethod
    def _edge(token: int, child: dict[int, int]) -> list[tuple[int, int]]:
        """Tokens on one edge of a merge tree, each with the rank at which it is merged away."""
        edge, until = [(token, _NEVER)], token
        while (token := child.get(token, -1)) >= 0:
            edge.append((token, until))
            until = token
        return edge

    def _fits(self, key: int) -> bool:
        right = self._edge(key & 0xFFFFFFFF, self._left)
        for x, x_until in self._edge(key >> 32, self._right):
            for y, y_until in right:
                due = self.ids.get(self.tokens[x] + self.tokens[y])
                # of equal ranks the leftmost merge comes first
                if due is not None and due < x_until and due <= y_until:
                    return False
        return True


def merge_by_rank(data: bytes, ranks: dict[bytes, int], below: int = _NEVER) -> list[bytes]:
    """The plain definition: the lowest ranked pair is merged, leftmost first, until none is left."""
    parts = [data[k:k + 1] for k in range(len(data))]
    while len(parts) > 1:
        due = [ranks.get(x + y, _NEVER) for x, y in zip(parts, parts[1:])]
        k = min(range(len(due)), key=due.__getitem__)
        if due[k] >= below:
            break
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return parts


class PrefixCoder:
    """Encodes byte strings and texts; ``last`` lists hold the last token of every prefix but the empty one."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.matches = regex.compile(pattern)
        self._prefixes: dict[bytes, tuple[int, bytes]] = {}
        self._texts: dict[str, bytes] = {}

    # -- one match -------------------------------------------------------

    def extend(self, last: list[int], data: bytes, stop: int | None = None) -> None:
        """Append to ``last`` the entries of the prefixes of ``data`` from len(last) + 1 to ``stop`` bytes."""
        ids, fits, longest = self.vocabulary.ids, self.vocabulary.fits, self.vocabulary.longest
        for end in range(len(last) + 1, (len(data) if stop is None else stop) + 1):
            for begin in range(max(0, end - longest), end):
                token = ids.get(data[begin:end])
                if token is not None and (not begin or fits[last[begin - 1] << 32 | token]):
                    last.append(token)
                    break

    def reencode(self, last: list[int], data: bytes, at: int, removed: int, inserted: bytes) -> tuple[list[int], int]:
        """Entries of ``data`` with ``removed`` bytes from ``at`` on replaced by ``inserted``, and how many of them
        were computed anew."""
        new = data[:at] + inserted + data[at + removed:]
        out, shift, clean = last[:at], removed - len(inserted), at + len(inserted)
        agreed = 0
        while len(out) < len(new) and agreed < self.vocabulary.longest:
            self.extend(out, new, len(out) + 1)
            n = len(out)
            agreed = agreed + 1 if n > clean and out[-1] == last[n + shift - 1] else 0
        computed = len(out) - min(at, len(out))
        return out + last[len(out) + shift:], computed

    def tokens_of(self, last: list[int] | np.ndarray) -> list[int]:
        """The encoding that the entries hold."""
        out, end, tokens = [], len(last), self.vocabulary.tokens
        while end:
            out.append(int(last[end - 1]))
            end -= len(tokens[out[-1]])
        return out[::-1]

    def _short(self, data: bytes) -> bytes:
        """Packed ids of a short match; the table has the last token and the packed ids of every prefix met so far."""
        table, ids, fits, packed = (self._prefixes, self.vocabulary.ids, self.vocabulary.fits, self.vocabulary.packed)
        longest = self.vocabulary.longest
        have = len(data)
        while have and data[:have] not in table:
            have -= 1
        for end in range(have + 1, len(data) + 1):
            for begin in range(end - longest if end > longest else 0, end):
                token = ids.get(data[begin:end])
                if token is not None:
                    if not begin:
                        table[data[:end]] = token, packed[token]
                        break
                    before, shorter = table[data[:begin]]
                    if fits[before << 32 | token]:
                        table[data[:end]] = token, shorter + packed[token]
                        break
        return table[data][1]

    def _match(self, match: str) -> bytes:
        data = match.encode()
        if len(data) > SHORT:
            last: list[int] = []
            self.extend(last, data)
            return np.array(self.tokens_of(last), "<u4").tobytes()
        for table in (self._prefixes, self._texts):
            if len(table) > ENTRIES:
                table.clear()
        found = self._texts[match] = self._short(data)
        return found

    # -- texts -----------------------------------------------------------

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known, match = self._texts, self._match
        return b"".join([known.get(m) or match(m) for m in self.matches.findall(text)])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def prefixes(self, text: str, start: int = 0) -> tuple[list[int], list[list[int]]]:
        """Start characters of the matches from ``start`` on, and the entries of each."""
        starts, entries = [], []
        for m in self.matches.finditer(text, start):
            last: list[int] = []
            self.extend(last, m.group().encode())
            starts.append(m.start())
            entries.append(last)
        return starts, entries

    def edit_text(self, text: str, starts: list[int], entries: list[list[int]], at: int, removed: int,
                  inserted: str) -> tuple[str, list[int], list[list[int]]]:
        """Text, starts and entries after an edit. Matches that end two characters before it stay (no alternative of
        the pattern looks further), as do those behind it once a new match starts where an old one did."""
        new = text[:at] + inserted + text[at + removed:]
        ends = [*starts[1:], len(text)]
        keep = int(np.searchsorted(ends, at - 2, side="right"))
        out_starts, out = starts[:keep], entries[:keep]
        shift, clean = removed - len(inserted), at + len(inserted)
        where = {s: k for k, s in enumerate(starts)}
        pos = ends[keep - 1] if keep else 0
        while pos < len(new):
            old = where.get(pos + shift) if pos >= clean else None
            if old is not None:
                return (new, out_starts + [s - shift for s in starts[old:]], out + entries[old:])
            m = self.matches.match(new, pos)
            data, last = m.group().encode(), []
            k = where.get(pos) if pos < at else None
            if k is not None:  # the match that the edit falls into: its entries before the edit stay
                last = entries[k][:min(len(new[pos:at].encode()), len(data))]
            self.extend(last, data)
            out_starts.append(pos)
            out.append(last)
            pos = m.end()
        return new, out_starts, out


_coders: dict[tuple[str, str], PrefixCoder] = {}


def _coder(shipped: Broadcast, pattern: str) -> PrefixCoder:
    """The worker's coder; its tables live as long as the worker."""
    digest, lines = shipped.value
    key = (digest, pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = PrefixCoder(Vocabulary.parse(lines), pattern)
    return _coders[key]


def ship_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The rank file at ``path`` (a file of the driver), broadcast behind a check of its size."""
    with open(path, "rb") as f:
        lines = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(lines) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast((hashlib.sha256(lines).hexdigest(), lines))


def _texts(column: pa.Array, step: int = 256) -> Iterator[str]:
    for a in range(0, len(column), step):
        for text in column.slice(a, step).to_pylist():
            yield text or ""


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Per document its id, n_tokens, ids_sha256 and decoded_sha256 (the ids are decoded again)."""
    shipped = ship_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shipped, pattern)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in _texts(batch.column(1)):
                packed = coder.encode(text)
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(packed)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
                                   pa.array(decoded, pa.string())],
                                  names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


_STORED = "{i} long, text string, ids array<long>, starts array<int>, last binary"


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, text, ids, and what ``reencode`` needs: the matches' start characters and the last token
    of every prefix (little-endian 32-bit, a match after the other)."""
    shipped = ship_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shipped, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                yield _stored_rows(coder, part.column(0), [(t, *coder.prefixes(t)) for t in _texts(part.column(1))], id_col)

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, _STORED.format(i=f"`{id_col}`"))


def _stored_rows(coder: PrefixCoder, ids: pa.Array, rows: list[tuple], id_col: str) -> pa.RecordBatch:
    tokens = [[t for last in entries for t in coder.tokens_of(last)] for _, _, entries in rows]
    last = [np.concatenate([np.array(e, "<u4") for e in entries] or [np.zeros(0, "<u4")]).tobytes()
            for _, _, entries in rows]
    return pa.record_batch([ids, pa.array([t for t, _, _ in rows], pa.string()), pa.array(tokens, pa.list_(pa.int64())),
                            pa.array([s for _, s, _ in rows], pa.list_(pa.int32())), pa.array(last, pa.binary())],
                           names=[id_col, "text", "ids", "starts", "last"])


def reencode(edits: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``encode`` with the columns ``at``, ``removed`` (characters) and ``inserted`` after that edit; an append
    has ``at`` = length of the text. Null edits leave the row as it is; ``at`` and ``removed`` beyond the text end at it."""
    shipped = ship_vocabulary(edits.sparkSession, path)

    def edited(coder: PrefixCoder, r: dict) -> tuple:
        text, starts, flat = r["text"] or "", r["starts"] or [], np.frombuffer(r["last"] or b"", "<u4").tolist()
        ends = [*starts[1:], len(text)]
        entries, pos = [], 0
        for s, e in zip(starts, ends):
            n = len(text[s:e].encode())
            entries.append(flat[pos:pos + n])
            pos += n
        if r["at"] is None:
            return text, starts, entries
        at = min(max(r["at"], 0), len(text))
        removed = min(max(r["removed"] or 0, 0), len(text) - at)
        return coder.edit_text(text, starts, entries, at, removed, r["inserted"] or "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shipped, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                yield _stored_rows(coder, part.column(0), [edited(coder, r) for r in part.to_pylist()], id_col)

    rows = edits.select(F.col(id_col).cast("long").alias(id_col), "text", F.col("starts").cast("array<int>").alias("starts"),
                        "last", F.col("at").cast("long").alias("at"), F.col("removed").cast("long").alias("removed"),
                        F.col("inserted").cast("string").alias("inserted"))
    return rows.mapInArrow(run, _STORED.format(i=f"`{id_col}`"))


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Per row its id and ``decoded``, the bytes of ``ids`` (null ids: empty)."""
    shipped = ship_vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shipped, pattern)
        for batch in batches:
            out = [coder.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    rows = encoded.select(F.col(id_col).cast("long").alias(id_col), F.col("ids").cast("array<long>").alias("ids"))
    return rows.mapInArrow(run, f"`{id_col}` long, decoded binary")
