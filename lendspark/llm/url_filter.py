"""URL rules as one bit-parallel wildcard automaton.

Every rule is a glob over the canonical url (``.`` + host + path): ``*`` is any
run of bytes without ``/``, ``**`` any run of bytes. All globs are laid out side
by side in multiword Shift-And masks: a glob of m literal bytes owns m + 1 bits,
bit i meaning "the first i literals are matched". One byte of input moves all
globs at once: ``D = ((D << 1) & match[c]) | (D & loop[c])`` with carries between
words. The simulation runs over all urls of an Arrow batch in lockstep; a url
whose states are all absorbing or dead leaves the lockstep early.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# fixed values: kinds of hosts and paths that a text corpus leaves out
UNWANTED = ["*.ads-*/**", "*.ad-*/**", "*.adult-*/**", "*-adult.*/**", "*.casino*/**", "*-casino.*/**", "*.poker*/**",
            "*.free-bets.*/**", "*.betting*/**", "*.xxx/**", "*.torrent*/**", "*.tracker*/**", "**/wp-admin/**",
            "**/wp-login*", "**/login/**", "**/signup/**", "**/cart/**", "**/checkout/**", "**/tag/*/page/*", "**/feed/*.xml",
            "**.exe", "**.apk", "**.torrent", "**/cgi-bin/**"]


def site_rule(verdict: str, rule: str) -> tuple[str, str, str]:
    """(verdict, name, glob) of a rule ``host/path``: its host and all
    subdomains, every path that begins with the rule's."""
    return verdict, rule, "*." + rule + "**"


class WildcardAutomaton:
    """Shift-And masks of all globs."""

    def __init__(self, globs: list[str]) -> None:
        parsed = [self._parse(g) for g in globs]
        bits = sum(len(lits) + 1 for lits, _ in parsed)
        self.words = max(1, -(-bits // 64))
        self.match = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.absorb = np.zeros(self.words, np.uint64)
        self.accept = []
        at = 0
        for lits, loops in parsed:
            self.start[at >> 6] |= self._bit(at)
            for i, c in enumerate(lits):
                self.match[c, (at + i + 1) >> 6] |= self._bit(at + i + 1)
            for i, kind in loops.items():
                self.loop[:, (at + i) >> 6] |= self._bit(at + i)
                if kind == "*":
                    self.loop[ord("/"), (at + i) >> 6] &= ~self._bit(at + i)
                elif i == len(lits):
                    self.absorb[(at + i) >> 6] |= self._bit(at + i)
            self.accept.append(at + len(lits))
            at += len(lits) + 1

    @staticmethod
    def _bit(i: int) -> np.uint64:
        return np.uint64(1) << np.uint64(i & 63)

    @staticmethod
    def _parse(glob: str) -> tuple[list[int], dict[int, str]]:
        lits: list[int] = []
        loops: dict[int, str] = {}
        data = glob.encode()
        i = 0
        while i < len(data):
            if data[i:i + 2] == b"**":
                loops[len(lits)] = "**"
                i += 2
            elif data[i:i + 1] == b"*":
                loops.setdefault(len(lits), "*")
                i += 1
            else:
                lits.append(data[i])
                i += 1
        return lits, loops

    def run(self, urls: list[bytes]) -> np.ndarray:
        """Boolean matrix (urls, globs): which globs match each whole url."""
        n = len(urls)
        length = np.fromiter((len(u) for u in urls), np.int64, n)
        buf = np.frombuffer(b"".join(urls) + b"\0", np.uint8)
        begin = np.concatenate(([0], np.cumsum(length)[:-1])) if n else np.zeros(0, np.int64)
        final = np.tile(self.start, (n, 1))
        live = np.argsort(-length, kind="stable")      # longest first
        state = final[live]
        pos = 0
        while len(live):
            active = int(np.searchsorted(-length[live], -pos, side="left"))
            if active < len(live):                      # these have ended
                final[live[active:]] = state[active:]
                live, state = live[:active], state[:active]
                continue
            c = buf[begin[live] + pos]
            moved = state << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            state = (moved & self.match[c]) | (state & self.loop[c])
            pos += 1
            if pos % 8 == 0:                            # decided before their end
                done = ~(state & ~self.absorb).any(axis=1)
                if done.any():
                    final[live[done]] = state[done]
                    live, state = live[~done], state[~done]
        out = np.zeros((n, len(self.accept)), bool)
        for k, b in enumerate(self.accept):
            out[:, k] = (final[:, b >> 6] & self._bit(b)) != 0
        return out


def url_verdicts(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id",
                 url_col: str = "url", default: str = "allow", unwanted: list[str] | None = None) -> DataFrame:
    """One row per input row: (id, host, path, rule, verdict, unwanted).

    ``rules``: (verdict, name, glob). The matching rule with the longest name
    decides; of equally long ones ``block`` before others, then the earlier.
    No rule: ``block`` if one of the globs ``unwanted`` matches, else ``default``, and a
    null rule. ``unwanted`` names the first of its globs that matches, else null, with or
    without a rule. All globs, of rules and of the list, are one automaton. Host: after the first ``://`` up to
    ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``,
    ``#`` or the end. A null url, an empty one and one without ``://`` have an
    empty host and path; so no site rule fits. Repeated rows and null ids are
    kept; other columns are not read. An empty table gives an empty result.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rest = F.expr("CASE WHEN instr(u, '://') > 0 THEN substring(u, instr(u, '://') + 3) ELSE '' END")
    pages = (df.select(F.col(id_col).alias("k"), F.col(url_col).alias("u"))
             .select("k", F.coalesce(rest, F.lit("")).alias("r"))
             .select("k", F.regexp_extract("r", r"(?s)^([^/?#]*)", 1).alias("h"),
                     F.regexp_extract("r", r"(?s)^[^/?#]*([^?#]*)", 1).alias("p"))
             .select("k", F.translate("h", UPPER, LOWER).alias("h"), "p"))
    kind = df.schema[id_col].dataType.simpleString()
    order = sorted(range(len(rules)), key=lambda i: (len(rules[i][1]), rules[i][0] == "block", -i))
    names = [r[1] for r in rules]
    verdicts = [r[0] for r in rules] + [default]
    unwanted = list(unwanted or [])
    globs = [r[2] for r in rules] + unwanted

    def decide(batches):
        auto = WildcardAutomaton(globs)
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            hit = auto.run([("." + h + p).encode() for h, p in zip(hosts, paths)])
            best = np.full(len(hosts), len(names), np.int64)
            for i in order:
                best[hit[:, i]] = i
            best = best.tolist()
            listed = hit[:, len(names):]
            first = np.where(listed.any(axis=1), listed.argmax(axis=1), -1).tolist() if unwanted else [-1] * len(hosts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2),
                 pa.array([names[i] if i < len(names) else None for i in best], pa.string()),
                 pa.array(["block" if i == len(names) and f >= 0 else verdicts[i] for i, f in zip(best, first)], pa.string()),
                 pa.array([unwanted[f] if f >= 0 else None for f in first], pa.string())],
                names=[id_col, "host", "path", "rule", "verdict", "unwanted"])

    return pages.mapInArrow(decide, f"`{id_col}` {kind}, host string, path string, "
                                    "rule string, verdict string, unwanted string")
