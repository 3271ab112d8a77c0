"""URL rules as one bit-parallel wildcard automaton (Shift-And over several 64-bit words)."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """host/path: fits the host and all its subdomains where the URL's path starts with the rule's."""

    text: str
    verdict: str


@dataclass(frozen=True)
class Glob:
    """A glob over host + path: `*` any run without `/`, `**` any run, `?` one byte but `/`, a backslash the next byte as
    it is."""

    pattern: str
    verdict: str


#: The method's own globs for URLs that no rule fits; the first that matches decides, else DEFAULT.
GLOBS = (
    Glob("ads.**", "block"),
    Glob("**.ads.**", "block"),
    Glob("**/login**", "block"),
    Glob("**.exe", "block"),
    Glob("**.zip", "block"),
)
DEFAULT = "allow"


class Automaton:
    """All globs in one row of bits: bit i of a glob is set once its first i + 1 elements have matched.

    For an element `*` the bit stays set over the bytes of its class, and it is also set as soon as the element before
    it is, as a run may be empty.  One step for a byte c is  D = ((D << 1 | first) & B[c]) | (D & S[c]), then closing.
    """

    def __init__(self, patterns: list[str]):
        self.ends, first, masks, stays, skips = [], [], [], [], []
        for pattern in patterns:
            elements = self._parse(pattern.encode())
            # A leading element keeps `empty prefix` as a bit of its own, so that a first `*` may match nothing.
            first.append(len(masks))
            masks.append(np.zeros(256, bool)), stays.append(np.zeros(256, bool)), skips.append(False)
            for chars, star in elements:
                masks.append(np.zeros(256, bool) if star else chars)
                stays.append(chars if star else np.zeros(256, bool))
                skips.append(star)
            self.ends.append(len(masks) - 1)
        self.width = width = max(1, -(-len(masks) // 64))
        self.B, self.S = self._pack(masks, width), self._pack(stays, width)
        self.skip = self._bits([i for i, s in enumerate(skips) if s])
        self.start = self._close(self._bits(first)[None, :])
        self.closing = max([1] + [self._run(skips)])

    @staticmethod
    def _parse(pattern: bytes) -> list[tuple[np.ndarray, bool]]:
        every = np.ones(256, bool)
        no_slash = every.copy()
        no_slash[ord("/")] = False
        out, i = [], 0
        while i < len(pattern):
            if pattern[i : i + 2] == b"**":
                out.append((every, True))
                i += 2
                continue
            literal = pattern[i : i + 1] == b"\\" and i + 1 < len(pattern)
            i += literal
            c = b"" if literal else pattern[i : i + 1]
            one = np.zeros(256, bool)
            one[pattern[i]] = True
            out.append((no_slash, True) if c == b"*" else (no_slash, False) if c == b"?" else (one, False))
            i += 1
        return out

    @staticmethod
    def _run(skips: list[bool]) -> int:
        longest = run = 0
        for s in skips:
            run = run + 1 if s else 0
            longest = max(longest, run)
        return longest

    @staticmethod
    def _pack(rows: list[np.ndarray], width: int) -> np.ndarray:
        table = np.zeros((256, width), np.uint64)
        for i, row in enumerate(rows):
            table[row, i // 64] |= np.uint64(1 << (i % 64))
        return table

    def _bits(self, at: list[int]) -> np.ndarray:
        out = np.zeros(self.width, np.uint64)
        for i in at:
            out[i // 64] |= np.uint64(1 << (i % 64))
        return out

    @staticmethod
    def _shift(d: np.ndarray) -> np.ndarray:
        out = d << np.uint64(1)
        out[:, 1:] |= d[:, :-1] >> np.uint64(63)
        return out

    def _close(self, d: np.ndarray) -> np.ndarray:
        """Sets the bit of every `*` whose element before it is set; runs of `*` need as many rounds."""
        for _ in range(getattr(self, "closing", 8)):
            d = d | (self._shift(d) & self.skip)
        return d

    def match(self, urls: list[bytes]) -> np.ndarray:
        """A row for each URL, a column for each glob: whether the whole URL matches.

        Long URLs cost only their own bytes: they are stepped through in order of length, and the ended ones drop out.
        """
        sizes = np.array([*map(len, urls)], np.int64)
        order = np.argsort(-sizes, kind="stable")
        text = np.frombuffer(b"".join(urls), np.uint8)
        starts = (np.cumsum(sizes) - sizes)[order]
        d = np.repeat(self.start, len(urls), axis=0)
        ordered = sizes[order]
        longest = int(ordered[0]) if len(urls) else 0
        for t in range(longest):
            n = int(np.searchsorted(-ordered, -t, side="left"))
            c = text[starts[:n] + t]
            now = d[:n]
            now = (self._shift(now) & self.B[c]) | (now & self.S[c])
            d[:n] = self._close(now)
        out = np.zeros((len(urls), len(self.ends)), bool)
        for k, end in enumerate(self.ends):
            out[order, k] = (d[:, end // 64] >> np.uint64(end % 64)) & np.uint64(1) == 1
        return out


def escaped(text: str) -> str:
    """A text as a glob that fits just it."""
    return re.sub(r"([*?\\])", r"\\\1", text)


def host_and_path(url: str = "url"):
    """Columns (host, path): host after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path then
    up to `?`, `#` or the end.  A null or a text without `://` gives two empty strings."""
    c = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(c, "://") > 0, F.expr(f"substring(coalesce({url}, ''), instr(coalesce({url}, ''), '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: list[Rule], globs: tuple[Glob, ...] = GLOBS, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict for every row; only page_id and url are read.

    Of the rules that fit, the longest text wins (the first given among equally long ones).  Where none fits, rule is
    null and the first matching glob decides, else the default.  The canonical URL is the host with A-Z lower-cased and
    the path as it stands; rules are texts, not globs.  Null and empty URLs have an empty host and path; repeated rows are
    judged each for itself; URLs may be of any length; an empty table gives an empty one.
    """
    ranked = sorted(rules, key=lambda r: -len(r.text))
    patterns = [p for r in ranked for p in (f"{escaped(r.text)}**", f"*.{escaped(r.text)}**")] + [g.pattern for g in globs]

    def run(batches):
        automaton = Automaton(patterns)
        names = pa.array([r.text for r in ranked] + [None], pa.string())
        verdicts = pa.array([r.verdict for r in ranked] + [g.verdict for g in globs] + [default], pa.string())
        for batch in batches:
            hosts, paths = batch.column("host").cast(pa.binary()).to_pylist(), batch.column("path").cast(pa.binary()).to_pylist()
            hit = automaton.match([h + p for h, p in zip(hosts, paths)])
            n = len(ranked)
            fits = np.concatenate([hit[:, : 2 * n : 2] | hit[:, 1 : 2 * n : 2], hit[:, 2 * n :], np.ones((len(hit), 1), bool)], axis=1)
            first = fits.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), names.take(pa.array(np.minimum(first, n))), verdicts.take(pa.array(first))],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    host, path = host_and_path()
    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
