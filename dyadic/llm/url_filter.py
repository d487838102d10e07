"""URL rules as one bit-parallel wildcard automaton.

Every rule becomes a glob over the canonical URL; all globs are packed into the
bits of a multiword Shift-And mask, and one pass over the characters of a batch
of URLs advances every glob of every URL at once. A glob is made of literal
characters, ``*`` (any run of characters) and ``**host`` style gaps written as
``%`` (any run without ``/``), so a rule cannot match a host name that only
occurs inside a path.

Canonical URL: ``.`` + host + path. Host: after the first ``://`` up to ``/``,
``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or
the end.

Defined cases: a null URL or one without ``://`` has an empty host and path and
fits no rule; a URL that fits no rule gets ``default``; of several fitting rules
the longest wins, of equally long ones the first listed; characters that no rule
names are one class; long URLs are stepped to their end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER

ANY, NO_SLASH = "*", "%"


class Gap(Enum):
    """The gaps of a glob; in a text glob they are written ``*`` and ``%``."""
    ANY = ANY
    NO_SLASH = NO_SLASH


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> tuple:
        """Host and path are literal, whatever characters they have."""
        return (Gap.NO_SLASH, ".", *self.host, *self.path, Gap.ANY)


class GlobAutomaton:
    """Shift-And over W 64-bit words for a list of globs."""

    def __init__(self, globs: list[str | tuple]):
        literals, any_loop, slash_free, last = [], [], [], []
        for g in globs:
            gap_any = gap_free = False
            first = True
            for ch in g if isinstance(g, tuple) else [Gap(ch) if ch in (ANY, NO_SLASH) else ch for ch in g]:
                if ch is Gap.ANY:
                    gap_any = True
                elif ch is Gap.NO_SLASH:
                    gap_free = True
                else:
                    # bit i: literal i matched; the loop bits of i tell what may follow before literal i
                    literals.append((ch, first))
                    any_loop.append(gap_any)
                    slash_free.append(gap_free)
                    gap_any = gap_free = first = False
            # a closing literal state; a trailing * lets it hold to the end
            last.append((len(literals) - 1, gap_any))
        self.n = len(literals)
        self.words = max(1, -(-self.n // 64))
        alphabet = sorted({ch for ch, _ in literals} | {"/"})
        self.codes = np.array([ord(ch) for ch in alphabet], dtype=np.uint32)
        self.slash = alphabet.index("/")
        self.match = np.zeros((len(alphabet) + 1, self.words), np.uint64)
        for i, (ch, _) in enumerate(literals):
            self.match[alphabet.index(ch), i // 64] |= np.uint64(1 << (i % 64))
        bits = lambda which: self._mask([i for i in range(self.n) if which(i)])
        #: literals that a glob may start with; those that may start at any later point too
        self.start = bits(lambda i: literals[i][1])
        self.start_any = bits(lambda i: literals[i][1] and any_loop[i])
        self.start_free = bits(lambda i: literals[i][1] and slash_free[i])
        #: states that wait before literal i + 1 across a gap
        self.hold_any = bits(lambda i: i + 1 < self.n and not literals[i + 1][1] and any_loop[i + 1])
        self.hold_free = bits(lambda i: i + 1 < self.n and not literals[i + 1][1] and slash_free[i + 1])
        self.inner = bits(lambda i: not literals[i][1])
        self.final = last
        self.final_hold = self._mask([i for i, trailing in last if trailing])

    def _mask(self, which: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in which:
            out[i // 64] |= np.uint64(1 << (i % 64))
        return out

    def classes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Character classes of all texts in one array, and where each text begins."""
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.codes, flat), len(self.codes) - 1)
        cls = np.where(self.codes[at] == flat, at, len(self.codes)).astype(np.int32)
        return cls, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def run(self, texts: list[str]) -> np.ndarray:
        """Boolean (text, glob): does the glob match the whole text?"""
        cls, begin = self.classes(texts)
        length = np.diff(begin)
        order = np.argsort(-length, kind="stable")
        length, begin = length[order], begin[:-1][order]
        state = np.zeros((len(texts), self.words), np.uint64)
        free = np.ones(len(texts), bool)  # no slash read so far: gaps without slash before the first literal still open
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(length[0]) if len(texts) else 0):
            live = int(np.searchsorted(-length, -step, side="left"))
            c = cls[begin[:live] + step]
            d = state[:live]
            shifted = d << one
            shifted[:, 1:] |= d[:, :-1] >> top
            shifted &= self.inner
            entry = self.start if step == 0 else self.start_any
            begins = np.where(free[:live, None], entry | self.start_free, entry)
            slash = c == self.slash
            keep = d & (self.hold_any | self.final_hold)
            keep |= np.where(slash[:, None], np.uint64(0), d & self.hold_free)
            state[:live] = ((shifted | begins) & self.match[c]) | keep
            free[:live] &= ~slash
        out = np.zeros((len(texts), len(self.final)), bool)
        for g, (i, _) in enumerate(self.final):
            out[order, g] = (state[:, i // 64] >> np.uint64(i % 64)) & one == one
        return out


def _judge(rules: tuple[Rule, ...], default: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = GlobAutomaton([r.glob for r in rules])
        rank = sorted(range(len(rules)), key=lambda g: -len(rules[g].name))
        names = np.array([r.name for r in rules] + [None], dtype=object)
        verdicts = np.array([r.verdict for r in rules] + [default], dtype=object)
        for pdf in batches:
            hits = automaton.run(("." + pdf["host"] + pdf["path"]).tolist())
            best = np.full(len(pdf), len(rules))
            for g in reversed(rank):
                best[hits[:, g]] = g
            pdf["rule"], pdf["verdict"] = names[best], verdicts[best]
            yield pdf

    return run


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id",
                url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.expr("locate('://', u)")
    rest = F.when(at > 0, F.expr("substring(u, locate('://', u) + 3)")).otherwise(F.lit(""))
    parts = (pages.select(F.col(id_col).alias("page_id"), url.alias("u"))
             .select("page_id", F.regexp_extract(rest, r"^[^?#]*", 0).alias("r"))
             .select("page_id", F.translate(F.substring_index("r", "/", 1), UPPER, UPPER.lower()).alias("host"), "r")
             .select("page_id", "host", F.expr("substring(r, length(host) + 1)").alias("path")))
    kind = parts.schema["page_id"].dataType.simpleString()
    return parts.mapInPandas(_judge(tuple(rules), default),
                             f"page_id {kind}, host string, path string, rule string, verdict string")
