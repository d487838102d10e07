"""Cheapest repair of conversations, by dynamic programming over persistent audits.

A conversation's rows in order of their turns (null turns first; equal turns by role and
digest of the text) are edited so that the initials of the roles read ``(s?(ua)+)?``:
Keep (K, free), Rerole to user or assistant (R, 2), Delete (D, 3; the only choice for
blank rows and repeats) and Insert an empty user or assistant row (I, 2); truncated rows
that stay cost 1 more. The audit is the string of the edits' initials; of equally cheap
audits the least string is taken.

A state of the program is the initial of the last role (or none), and holds the cheapest
audit of the rows so far. Audits share their prefixes as linked nodes. A node has its
parent, its ancestors at distances 1, 2, 4, ... and a rolling hash of its string, so two
audits of equal cost are compared by searching their longest common prefix among the
ancestors; that the hashes told the truth is verified on the nodes that are not shared.
Two equally cheap audits of the same rows are never prefixes of each other (what one has
more would be inserts, which cost), so the smaller prefix stays the smaller whole.

For the same reason a piece of a conversation is summed up by its cheapest audits from
each state to each state, and pieces join like matrices. Conversations are therefore
dealt by ranges of (conversation, turn, role, digest): those that lie inside one task are
finished there, in pieces of ``PIECE`` rows; those at a task's first or last row, which
may go on in the next one and may be of any size, become a row of such sums per task
and are joined. Their repaired text is hashed in one pass over their sorted rows, which
holds one row at a time (a SHA-256 can only be computed in order).

Faults of a row, the first of: blank (no character but blanks and \\t-\\r), duplicate (role
and text seen earlier in the conversation), truncated (the last such character is none of
``.!?``).

Defined cases: null roles and texts count as one blank; rows without conversation id are
one conversation; null turns come first and are left out of ``gaps``; a conversation
without rows has zeros, an empty audit and the hash of the empty string; equal rows are
repeats; columns other than the four are not read; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

STATES = ("", "s", "u", "a")
FOLLOWS = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
BLANK = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: rows of a piece, and so the nodes that are held at a time
PIECE = 4096
ROWS_PER_TASK = 50_000

Best = dict[tuple[str, str], tuple[int, str]]


class Audits:
    """Strings that share their prefixes: node 0 is the empty one, every other one a parent and a mark."""

    BASE, MODULUS = 1_000_003, (1 << 61) - 1

    def __init__(self):
        self.parent, self.mark, self.depth, self.hash = [0], [""], [0], [0]
        self.up: list[list[int]] = [[]]
        self._proved: set[tuple[int, int]] = set()

    def add(self, parent: int, mark: str) -> int:
        node = len(self.parent)
        self.parent.append(parent)
        self.mark.append(mark)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * self.BASE + ord(mark)) % self.MODULUS)
        up = [parent]
        while len(up) <= len(self.up[up[-1]]):
            up.append(self.up[up[-1]][len(up) - 1])
        self.up.append(up)
        return node

    def at_depth(self, node: int, depth: int) -> int:
        over = self.depth[node] - depth
        while over:
            j = over.bit_length() - 1
            node = self.up[node][j]
            over -= 1 << j
        return node

    def string(self, node: int) -> str:
        marks = []
        while node:
            marks.append(self.mark[node])
            node = self.parent[node]
        return "".join(reversed(marks))

    def same(self, a: int, b: int) -> bool:
        """Whether two strings of one length are equal, by their marks down to what they share."""
        key, met = (a, b), []
        while a != b and (a, b) not in self._proved:
            if self.mark[a] != self.mark[b]:
                return False
            met.append((a, b))
            a, b = self.parent[a], self.parent[b]
        if met:
            self._proved.add(key)
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the string of a comes before that of b."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.at_depth(a, depth), self.at_depth(b, depth)
        if self.hash[x] == self.hash[y]:
            if self.same(x, y):
                return self.depth[a] < self.depth[b]
            return self.string(a) < self.string(b)
        for j in range(len(self.up[x]) - 1, -1, -1):
            if j < len(self.up[x]):
                p, q = self.up[x][j], self.up[y][j]
                if self.hash[p] != self.hash[q]:
                    x, y = p, q
        if not self.same(self.parent[x], self.parent[y]):  # two strings with one hash
            return self.string(a) < self.string(b)
        return self.mark[x] < self.mark[y]


def _offer(cells: dict[str, tuple[int, int]], audits: Audits, state: str, cost: int, parent: int, mark: str) -> bool:
    """Put parent + mark into the state's cell if it is cheaper, or as cheap and smaller."""
    held = cells.get(state)
    if held and held[0] < cost:
        return False
    node = audits.add(parent, mark)
    if held and held[0] == cost and not audits.less(node, held[1]):
        return False
    cells[state] = cost, node
    return True


def _inserted(cells: dict[str, tuple[int, int]], audits: Audits) -> dict[str, tuple[int, int]]:
    again = True
    while again:
        again = False
        for state, (cost, node) in list(cells.items()):
            again |= _offer(cells, audits, "a" if state == "u" else "u", cost + INSERT, node, "I")
    return cells


def piece_audits(rows: list[tuple[str, str]], begins: Iterable[str] = STATES) -> Best:
    """Cheapest (cost, audit) from each begin state to each state for some rows (initial, fault)."""
    out: Best = {}
    for begin in begins:
        audits = Audits()
        cells = _inserted({begin: (0, 0)}, audits)
        for initial, fault in rows:
            new: dict[str, tuple[int, int]] = {}
            for state, (cost, node) in cells.items():
                _offer(new, audits, state, cost + DELETE, node, "D")
                if fault not in ("blank", "duplicate"):
                    stay = cost + (TRUNCATED if fault else 0)
                    if (state, initial) in FOLLOWS:
                        _offer(new, audits, initial, stay, node, "K")
                    _offer(new, audits, "a" if state == "u" else "u", stay + REROLE, node, "R")
            cells = _inserted(new, audits)
        for state, (cost, node) in cells.items():
            out[begin, state] = cost, audits.string(node)
    return out


def joined(left: Best, right: Best) -> Best:
    """Cheapest audits of two pieces in a row."""
    out: Best = {}
    for (begin, middle), (cost, audit) in left.items():
        for end in STATES:
            if (middle, end) in right:
                more, tail = right[middle, end]
                held = out.get((begin, end))
                if not held or cost + more < held[0] or cost + more == held[0] and audit + tail < held[1]:
                    out[begin, end] = cost + more, audit + tail
    return out


def joined_all(pieces: list[Best]) -> Best:
    """Neighbours are joined level by level, so a long audit is copied once a level."""
    while len(pieces) > 1:
        pieces = [joined(*pieces[k:k + 2]) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
    return pieces[0] if pieces else {(s, s): (0, "") for s in STATES}


def cheapest(best: Best) -> tuple[int, str]:
    """Cost and audit of a whole conversation: nothing is left, or it ends with the assistant."""
    return min(best[e] for e in (("", ""), ("", "a")) if e in best)


def edited(audit: Iterable[str], rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired rows."""
    state = ""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit != "D":
            state = role[:1] if edit == "K" else "a" if state == "u" else "u"
            yield edit, role if edit == "K" else ROLES[state], text


class _Digest:
    """SHA-256 of the repaired rows ``role:text``, joined by newlines."""

    def __init__(self):
        self.sha, self.sep = hashlib.sha256(), ""

    def add(self, role: str, text: str) -> None:
        self.sha.update(f"{self.sep}{role}:{text}".encode())
        self.sep = "\n"


class _Run:
    """Figures of consecutive rows of one conversation, and their pieces."""

    def __init__(self, begins: tuple[str, ...]):
        self.first_begins, self.begins = begins, STATES
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.low_turn = None
        self.first_role = self.last_role = None
        self.rows: list[tuple[str, str]] = []
        self.pieces: list[Best] = []

    def add(self, turn: int | None, role: str, text: str, repeat: bool) -> None:
        said = text.strip(BLANK)
        fault = "blank" if not said else "duplicate" if repeat else "truncated" if said[-1] not in ".!?" else ""
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        initial = role[:1]
        if self.last_role is None:
            self.first_role, self.first_turn = initial, turn
        elif self.last_role + initial not in LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.low_turn = turn if self.low_turn is None else self.low_turn
        self.last_role, self.last_turn = initial, turn
        self.rows.append((initial, fault))
        if len(self.rows) == PIECE:
            self._piece()

    def _piece(self) -> None:
        self.pieces.append(piece_audits(self.rows, STATES if self.pieces else self.first_begins))
        self.rows = []

    def best(self) -> Best:
        if self.rows:
            self._piece()
        return joined_all(self.pieces)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, 1024).columns))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """(conversation, its rows) of sorted rows; the rows are taken while they pass by."""
    rows = _rows(batches)
    row = next(rows, None)
    while row is not None:
        conv = row[0]

        def same() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == conv:
                yield row
                row = next(rows, None)

        group = same()
        yield conv, group
        for _ in group:  # what the caller left
            pass


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
_INNER = RESULT + ", edge boolean"
_EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(),
             "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)],
                           names=[n for n, _ in fields])


def _whole(group: Iterator[tuple]) -> tuple:
    """Result of a conversation that lies inside one task."""
    run, seen, kept = _Run(("",)), set(), []
    for _, turn, role, digest, text, gone in group:
        if not gone:
            run.add(turn, role, text, (role, digest) in seen)
            seen.add((role, digest))
            kept.append((role, text))
    if not kept:
        return _EMPTY
    cost, audit = cheapest(run.best())
    digest = _Digest()
    for _, role, text in edited(audit, iter(kept)):
        digest.add(role, text)
    gaps = run.last_turn - run.low_turn + 1 - run.turns if run.turns else 0
    return gaps, run.blank, run.duplicate, run.truncated, run.illegal, cost, audit, digest.sha.hexdigest()


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the conversations inside a task; the ids of its first and its last one as edges."""
    out, held, first = [], None, True
    for conv, group in _grouped(batches):
        if held is not None:
            out.append(held)
        held = (conv, *(_EMPTY if first else _whole(group)), first)
        first = False
        if len(out) >= 1000:
            yield _batch(out, _INNER)
            out = []
    if held is not None:
        out.append((held[0], *_EMPTY, True))
    if out:
        yield _batch(out, _INNER)


_SUMS = ("conv_id long, head_role string, head_digest string, n long, blank long, duplicate long, truncated long, illegal long, first_role string, "
         "last_role string, turns long, low_turn long, first_turn long, last_turn long, ends array<string>, "
         "costs array<long>, audits array<string>")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation that has rows in a task."""
    for conv, group in _grouped(batches):
        run, n, before, head = _Run(STATES), 0, None, ("", "")
        for _, turn, role, digest, text, gone, later in group:
            if not gone:
                head = head if n else (role, digest)
                run.add(turn, role, text, later or (turn, role, digest) == before)
                before, n = (turn, role, digest), n + 1
        best = run.best()
        ends = sorted(best)
        yield _batch([(conv, *head, n, run.blank, run.duplicate, run.truncated, run.illegal, run.first_role, run.last_role,
                       run.turns, run.low_turn, run.first_turn, run.last_turn, [f"{s},{e}" for s, e in ends],
                       [best[e][0] for e in ends], [best[e][1] for e in ends])], _SUMS)


_AUDITED = RESULT.rpartition(",")[0]


def _one_audit(table: pa.Table) -> pa.Table:
    """Joins the sums of a conversation (at most one per task) in the order of their first rows."""
    rows = table.to_pylist()
    parts = sorted((r for r in rows if r["n"]), key=lambda r: (r["first_turn"] is not None, r["first_turn"] or 0,
                                                              r["head_role"], r["head_digest"]))
    if not parts:
        return pa.Table.from_batches([_batch([(rows[0]["conv_id"], *_EMPTY[:-1])], _AUDITED)])
    best = joined_all([{tuple(e.split(",")): (c, a) for e, c, a in zip(r["ends"], r["costs"], r["audits"])} for r in parts])
    total = {c: sum(r[c] for r in parts) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    for a, b in zip(parts, parts[1:]):
        total["illegal"] += a["last_role"] + b["first_role"] not in LEGAL
        total["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    low = [r["low_turn"] for r in parts if r["low_turn"] is not None]
    gaps = max(r["last_turn"] for r in parts if r["last_turn"] is not None) - min(low) + 1 - total["turns"] if low else 0
    return pa.Table.from_batches([_batch([(rows[0]["conv_id"], gaps, total["blank"], total["duplicate"], total["truncated"],
                                           total["illegal"], *cheapest(best))], _AUDITED)])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation from its audit (first) and its rows, one row at a time."""
    for conv, group in _grouped(batches):
        digest = _Digest()
        for _, role, text in edited(next(group)[-1], ((r[2], r[4]) for r in group if not r[5])):
            digest.add(role, text)
        yield _batch([(conv, digest.sha.hexdigest())], "conv_id long, repaired_sha256 string")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = "conv_id long, ord long, edit string, role string, text string"
    for conv, group in _grouped(batches):
        out = []
        for k, row in enumerate(edited(next(group)[-1], ((r[2], r[4]) for r in group if not r[5]))):
            out.append((conv, k, *row))
            if len(out) == 1024:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)


ORDER = ["conv_id", "turn", "role", "digest"]


def ordered_rows(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """The columns that the passes read; ``gone`` marks rows that only stand for their conversation."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                filled("role").alias("role"), F.sha2(filled("text"), 256).alias("digest"),
                                filled("text").alias("text"), gone.alias("gone"))


def _ranged(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)


def _tasks(rows: DataFrame) -> int:
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_TASK))


def _with_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one task (which reads them as a stream)."""
    lead = audits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"),
                         F.lit("").alias("text"), F.lit(False).alias("gone"), F.lit(0).alias("kind"), "audit")
    both = lead.unionByName(rows.select("conv_id", "turn", "role", "digest", "text", "gone", F.lit(1).alias("kind"),
                                        F.lit("").alias("audit")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").select(
        "conv_id", "turn", "role", "digest", "text", "gone", "audit")


def repair(rows: DataFrame) -> DataFrame:
    """One row (``RESULT``) per conversation of ``ordered_rows``."""
    n = _tasks(rows)
    inside = stored(_ranged(rows, n).mapInArrow(_inside, _INNER), "inside")
    # at most two conversations a task
    edges = F.broadcast(inside.where("edge").select(F.col("conv_id").alias("e")).distinct())
    rest = rows.join(edges, F.col("conv_id").eqNullSafe(F.col("e")), "left_semi")
    when = F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    first = (rest.where("not gone").groupBy("conv_id", "role", "digest").agg(F.min(when)["turn"].alias("first_turn"))
             .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first_turn"))
    flagged = rest.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                        & (F.col("digest") == F.col("d")), "left").select(
        *rest.columns, (~F.col("turn").eqNullSafe(F.col("first_turn"))).alias("later"))
    sums = stored(_ranged(flagged, n).mapInArrow(_sums, _SUMS), "sums")
    audits = stored(sums.groupBy("conv_id").applyInArrow(_one_audit, _AUDITED), "audits")
    digests = _with_audits(rest, audits).mapInArrow(_hashed, "conv_id long, repaired_sha256 string").withColumnRenamed(
        "conv_id", "c")
    across = audits.join(digests, F.col("conv_id").eqNullSafe(F.col("c")))
    return inside.where("not edge").select(*_COLUMNS).unionByName(across.select(*_COLUMNS))


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, ord (from 0), edit (K, R or I), role and text, from ``ordered_rows`` and the
    rows of ``repair``."""
    return _with_audits(rows, audits).mapInArrow(_edits, "conv_id long, ord long, edit string, role string, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """``ordered_rows`` with faults by the checksum of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text,
    2 takes its ``.!?``, 3 repeats it, 4 sets its role to user (nulls count as one blank)."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text, role = filled("text"), filled("role")
    rows = conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault < 2, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        fault.alias("fault"), F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return ordered_rows(rows, F.col("fault") == 0)
