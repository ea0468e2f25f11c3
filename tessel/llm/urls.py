"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed into one multiword Shift-And automaton: every literal byte of every rule owns a
bit, `*` is a self-loop on the bit before it, and one step of the automaton advances all rules at once:
D = ((D << 1 | starts) & mask[byte]) | (D & loops). URLs are run side by side, a batch of them as the
rows of one array of 64-bit words, so a step is a few array operations whatever the number of rules.

The automaton reads the canonical URL: "." + host + 0xFF + path, where 0xFF (no byte of UTF-8) parts host and path. A
domain rule `com` with the path `/en/` is the glob `*.com<FF>/en/*`; it fits the host itself and all
subdomains. Of the domain rules that fit, the longest decides; where none fits, the general globs do (any
fit blocks), and else the URL is allowed.

Defined cases: a null url, or one without `://`, has an empty host and path and no rule, and is allowed; repeated rows and null
ids give one result row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

MARK = b"\xff"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


class ShiftAnd:
    """All globs at once. A glob is bytes with `*` for any run of bytes (escaped by nothing: rules have no literal `*`)."""

    def __init__(self, globs: list[bytes]):
        starts, loops, accepts, place = [], [], [], 0
        literal: list[tuple[int, int]] = []
        for glob in globs:
            # one bit stands before the first literal: set at the start, kept if the glob begins with `*`
            starts.append(place)
            if glob.startswith(b"*"):
                loops.append(place)
            for byte in glob.lstrip(b"*").replace(b"**", b"*"):
                if byte == ord("*"):
                    loops.append(place)
                else:
                    place += 1
                    literal.append((place, byte))
            accepts.append(place)
            place += 1
        self.words = max(1, -(-place // 64))
        bits = lambda places: self._mask(places)
        self.start, self.loop = bits(starts), bits(loops)
        self.mask = np.stack([bits([p for p, b in literal if b == byte]) for byte in range(256)])
        self.accepts = [(p // 64, np.uint64(p % 64)) for p in accepts]

    def _mask(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for p in places:
            out[p // 64] |= np.uint64(1 << p % 64)
        return out

    def fits(self, texts: list[bytes]) -> np.ndarray:
        """texts x globs: whether the whole text fits the glob. Longer texts run on alone after shorter ones end."""
        n = len(texts)
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        offsets = np.zeros(n, np.int64)
        joined = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        offsets[1:] = np.cumsum(lengths)[:-1]
        state = np.repeat(self.start[None, :], n, 0)
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for step in range(int(lengths[0]) if n else 0):
            while live and lengths[live - 1] <= step:
                live -= 1
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= self.mask[joined[offsets[:live] + step]]
            state[:live] = moved | (now & self.loop)
        out = np.zeros((n, len(self.accepts)), bool)
        for k, (word, bit) in enumerate(self.accepts):
            out[order, k] = (state[:, word] >> bit) & one == one
        return out


_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path, without query and fragment."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2].partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.encode().translate(_UPPER).decode(), slash + path


def judge(pages: DataFrame, rules: list[Rule], block_globs: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", batch: int = 4096) -> DataFrame:
    """page_id, host, path, rule, verdict. block_globs are (glob over "." + host, glob over path). Narrow: no shuffle; the automaton's size depends on the rules alone."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    globs = [b"*." + r.host.encode() + MARK + r.path.encode() + b"*" for r in ranked] + [host.encode() + MARK + path.encode() for host, path in block_globs]

    def run(batches):
        automaton = ShiftAnd(globs)
        for arrow in batches:
            hosts, paths, names, verdicts = [], [], [], []
            urls = arrow.column("url").to_pylist()
            for at in range(0, len(urls), batch):
                parts = [split_url(u) for u in urls[at : at + batch]]
                fits = automaton.fits([b"." + h.encode() + MARK + p.encode() for h, p in parts])
                for (host, path), row in zip(parts, fits):
                    known = row[: len(ranked)] if host or path else ()
                    first = next((r for r, fit in zip(ranked, known) if fit), None)
                    hosts.append(host)
                    paths.append(path)
                    names.append(first and first.name)
                    verdicts.append(first.verdict if first else "block" if (host or path) and row[len(ranked) :].any() else "allow")
            yield pa.RecordBatch.from_arrays([arrow.column("page_id"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
