"""URL filters: all glob rules run at once over each canonical URL as one bit-parallel Shift-And automaton.

A URL is reduced to ``host`` + newline + ``path`` (neither can hold a newline, see `canonical`).  Every rule is a
glob over that string: ``?`` stands for one character and ``*`` for any number.  The rules' characters are laid
side by side as bits of one state of several 64-bit words; for each byte of the URL the state is shifted, entered
at every rule's first bit and masked with the bits that accept the byte, while bits before a ``*`` stay.  Texts are
stepped through together, a column of bytes at a time, so a step costs a few array operations for all of them.

A rule (host, path) holds for the host and its subdomains and for paths that start with its own, so it becomes
two globs, one with ``*.`` before the host.  Of the rules that hold, the longest wins.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and gets the default
verdict; repeated rows are judged one by one; an empty table gives no rows; other columns are not read; a URL of any
length is judged whole; of rules of equal length the first listed wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import U64, Texts, column, texts_of
from .workspace import prepared

CUT = "\n"


@dataclass(frozen=True)
class Rule:
    """A rule by host and path, or (``glob``) a pattern over host, a newline and path."""

    verdict: str
    host: str = ""
    path: str = ""
    glob: str = ""

    @property
    def name(self) -> str:
        return self.glob.replace(CUT, "") if self.glob else self.host + self.path

    def globs(self) -> list[str]:
        if self.glob:
            return [self.glob]
        return [f"{start}{escaped(self.host)}{CUT}{escaped(self.path)}*" for start in ("", "*.")]


#: Rules of the contract, by host and path.
CONTRACT = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: What judges a URL that none of those fits: link farms, shop and log-in pages, and files that hold no text.
GENERAL = tuple(Rule("block", glob=g) for g in ("*spam*\n*", "*cheap-*\n*", "*casino*\n*", "*\n*/cart/*", "*\n*/login*", "*\n*/wp-admin/*", "*\n*.exe", "*\n*.zip", "*\n*.jp?g", "*\n*.png"))
DEFAULT = "allow"


def escaped(literal: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in literal)


class Automaton:
    """All globs in one multiword Shift-And machine over UTF-8 bytes."""

    def __init__(self, globs: list[str]):
        masks: list[np.ndarray | None] = []  # by bit: the bytes it accepts
        first, stay, accept, wide = [], [], [], []
        for g in globs:
            states: list[tuple[np.ndarray, bool]] = []  # (bytes, whether any bytes may come before)
            loose, raw, k = False, g.encode(), 0
            while k < len(raw):
                c = raw[k]
                if c == 0x2A:
                    loose = True
                else:
                    ok = np.zeros(256, bool)
                    if c == 0x3F:  # the first byte of a character; the others follow it
                        ok[:0x80] = ok[0xC0:] = True
                        wide.append(len(masks) + 1 + len(states))
                    else:
                        k += c == 0x5C
                        ok[raw[k]] = True
                    states.append((ok, loose))
                    loose = False
                k += 1
            # Bit 0 of a rule is its start, which is on before the first byte; bit j is "j characters seen".
            first.append(len(masks))
            stay += [loose_after for _, loose_after in states] + [loose]
            masks += [None, *(ok for ok, _ in states)]
            accept.append(len(masks) - 1)
        self.n, self.words = len(globs), max(1, -(-len(masks) // 64))
        self.table = np.zeros((256, self.words), U64)
        self.start, self.stay = np.zeros(self.words, U64), np.zeros(self.words, U64)
        self.accept = np.array(accept, np.int64)
        #: Bits of ``?``, which stay while a character goes on.
        self.wide = np.zeros(self.words, U64)
        for bit in wide:
            self.wide[bit >> 6] |= U64(1 << (bit & 63))
        for bit, ok in enumerate(masks):
            if ok is not None:
                self.table[ok, bit >> 6] |= U64(1 << (bit & 63))
            if stay[bit]:
                self.stay[bit >> 6] |= U64(1 << (bit & 63))
        for bit in first:
            self.start[bit >> 6] |= U64(1 << (bit & 63))

    def match(self, texts: Texts) -> np.ndarray:
        """Texts by globs: which match from end to end."""
        out = np.zeros((texts.n, self.n), bool)
        size = np.diff(texts.offsets)
        order = np.argsort(-size, kind="stable")
        at, left = texts.offsets[:-1][order], size[order]
        state = np.tile(self.start, (texts.n, 1))
        step, live = 0, int((left > 0).sum())
        while live:
            now = state[:live]
            moved = now << U64(1)
            moved[:, 1:] |= now[:, :-1] >> U64(63)
            byte = texts.data[at[:live] + step]
            moved &= self.table[byte]
            moved |= now & self.stay
            if (goes_on := (byte & 0xC0) == 0x80).any():
                moved[goes_on] |= now[goes_on] & self.wide
            state[:live] = moved
            step += 1
            live = int(np.searchsorted(-left, -step, "left"))  # texts longer than step
        words, bits = self.accept >> 6, (self.accept & 63).astype(U64)
        out[order] = (state[:, words] >> bits) & U64(1) != 0
        return out


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path): host is after the first ``://`` up to ``/?#``, A-Z lower-cased; path then up to ``?#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(host, upper, upper.lower()), path


def judge(pages: DataFrame, rules: tuple[Rule, ...] = CONTRACT, general: tuple[Rule, ...] = GENERAL, *, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, glob): the longest rule that fits, else the longest general glob.

    ``glob`` names the general rule that gave the verdict.  Newlines inside a host or path become spaces for
    matching, as the newline parts the two.
    """
    every = [*rules, *general]
    globs = [(k, g) for k, r in enumerate(every) for g in r.globs()]
    length = np.array([len(r.name) * 2 * len(every) - k for k, r in enumerate(every)])  # longer first, then earlier
    owner = np.array([k for k, _ in globs])

    def best(hit: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The winning rule among ``which`` for each text, or -1."""
        if not len(which):
            return np.full(len(hit), -1)
        score = np.where(hit[:, which], length[which], -1)
        top = score.argmax(axis=1)
        return np.where(score[np.arange(len(hit)), top] >= 0, which[top], -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton([g for _, g in globs])
        for batch in batches:
            for texts in texts_of(column(batch, "__mx_key")):
                found = machine.match(texts)
                hit = np.zeros((texts.n, len(every)), bool)
                for k in range(len(globs)):
                    hit[:, owner[k]] |= found[:, k]
                own, other = best(hit, np.arange(len(rules))), best(hit, np.arange(len(rules), len(every)))
                name = lambda k: every[k].name if k >= 0 else None
                verdict = [every[a if a >= 0 else b].verdict if max(a, b) >= 0 else default for a, b in zip(own.tolist(), other.tolist(), strict=True)]
                glob = [name(b) if a < 0 else None for a, b in zip(own.tolist(), other.tolist(), strict=True)]
                rows = batch.slice(texts.first, texts.n).select([0, 1, 2])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([name(k) for k in own.tolist()], pa.string()), pa.array(verdict, pa.string()), pa.array(glob, pa.string())], names=["id", "host", "path", "rule", "verdict", "glob"])

    pages = prepared(pages, id=id_col, url=url_col)
    host, path = canonical(F.col("url"))
    flat = pages.withColumn("there", F.coalesce(F.instr("url", "://") > 0, F.lit(False))).select("id", host.alias("host"), path.alias("path"), "there")
    flat = flat.select("id", "host", "path", F.when(F.col("there"), F.concat(F.translate("host", CUT, " "), F.lit(CUT), F.translate("path", CUT, " "))).alias("__mx_key"))
    kind = pages.schema["id"].dataType.simpleString()
    return flat.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, glob string").withColumnRenamed("id", id_col)


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
