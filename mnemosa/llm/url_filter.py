"""URL filters: all glob rules at once, as a bit-parallel automaton over each canonical URL.

The canonical URL is the host, A-Z lower-cased, and the path: no scheme, query or
fragment.  In a glob, ** is any run, * any run without a slash, ? one character
other than a slash, and a backslash takes the next character as it is; the whole
canonical URL must fit.  A host rule (host, path) is two globs: its host or any
subdomain, and a path that begins with the rule's.

Each glob is a row of bits, one for each place between its characters, and all
rows stand side by side in 64-bit words.  A byte of the URL moves every place of
every glob at once: shifted places that the byte may enter, plus places with a
star that it may stay in.  numpy does this for all URLs of a batch, byte by byte.
Rules stand in the order of precedence, so the lowest accepting bit is the answer:
host rules before globs, the longest first, then the first given.

The rules travel to all tasks as masks of 32 bytes a place; MOST_PLACES bounds them
(32 MB), and larger sets are refused with an error.  Tasks work through them in
blocks of BLOCK_WORDS words, so a batch's states stay small however many rules.

Defined cases: a null url, or one without ://, has an empty host and path; it fits
the empty glob only.  A URL that fits no rule has the `otherwise` verdict.  Rows
with null or repeated page_id are judged each; an empty table gives no rows.  No
rules at all are allowed.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import flat, pieces

MOST_PLACES, BLOCK_WORDS, FEW = 1 << 20, 64, 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str
    globs: tuple[str, ...]
    of_host: bool = False


def quoted(text: str) -> str:
    """text as a glob that only fits itself."""
    return re.sub(r"([*?\\])", r"\\\1", text)


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains, and paths that begin with `path`."""
    own = quoted(host + path) + "**"
    return Rule(verdict, host + path, (own, "*." + own), True)


def glob_rule(verdict: str, glob: str) -> Rule:
    return Rule(verdict, glob, (glob,))


#: The production rules: hosts by contract, then globs for what no host rule decides.
HOST_RULES = (
    host_rule("allow", "org", "/"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
)
GLOB_RULES = tuple(
    glob_rule("block", g)
    for g in ("", "/**", "*casino*/**", "*cheap-pills*/**", "*spam-farm*/**", "*adult*/**", "**/login**", "**/signup**", "**/cart**", "**/wp-admin/**", "**/tag/*/page/*", "**.zip", "**.exe", "**.jp?g", "*.example.net/*/1??", "m.*/??/*/")
) + (glob_rule("allow", "m.*.example.net/en/*/"),)


def _symbols(glob: str) -> list[tuple[str, int]]:
    """The glob as (kind, byte): star, deep (any run), one (a character) or byte."""
    found, i = [], 0
    while i < len(glob):
        c, i = glob[i], i + 1
        if c == "*":
            deep = glob[i : i + 1] == "*"
            i += deep
            found.append(("deep" if deep else "star", 0))
        elif c == "?":
            found.append(("one", 0))
        else:
            if c == "\\" and i < len(glob):
                c, i = glob[i], i + 1
            found += [("byte", b) for b in c.encode()]
    return found


class Block:
    """Masks of some globs: places a byte enters, places it stays in, first and last places, and each last place's rule."""

    def __init__(self, globs: Sequence[tuple[list, int]]):
        n = sum(1 + sum(k in ("byte", "one") for k, _ in s) for s, _ in globs)
        enter, stay = np.zeros((256, n), bool), np.zeros((256, n), bool)
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        self.rule, at = np.full(-(-n // 64) * 64, -1, np.int64), 0
        for symbols, rule in globs:
            first[at] = True
            for kind, byte in symbols:
                if kind == "star":
                    stay[np.arange(256) != ord("/"), at] = True
                elif kind == "deep":
                    stay[:, at] = True
                else:
                    at += 1
                    if kind == "byte":
                        enter[byte, at] = True
                    else:  # a first byte of a character, then what follows it
                        enter[:128, at] = enter[192:, at] = True
                        enter[ord("/"), at] = False
                        stay[128:192, at] = True
            last[at], self.rule[at] = True, rule
            at += 1
        self.enter, self.stay, self.first, self.last = (self._packed(x) for x in (enter, stay, first[None], last[None]))

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
        packed = np.packbits(bits, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view("<u8").astype(np.uint64)

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The first rule that each text fits, or -1; the longest texts come first."""
        state = np.repeat(self.first, len(starts), 0)
        one, top = np.uint64(1), np.uint64(63)
        longest = int(lengths[0]) if len(lengths) else 0
        active, j = len(starts), 0
        alive = np.searchsorted(-lengths, -np.arange(longest), "left")  # texts longer than j
        while j < longest and (active := int(alive[j])) > FEW:
            now, byte = state[:active], data[starts[:active] + j]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= self.enter[byte]
            now &= self.stay[byte]
            now |= moved
            j += 1
        if j < longest:  # a few long texts: one integer each holds all words
            enter, stay = ([int.from_bytes(row.astype("<u8").tobytes(), "little") for row in m] for m in (self.enter, self.stay))
            for r in range(active):
                now = int.from_bytes(state[r].astype("<u8").tobytes(), "little")
                for b in data[starts[r] + j : starts[r] + lengths[r]].tobytes():
                    now = ((now << 1) & enter[b]) | (now & stay[b])
                state[r] = np.frombuffer(now.to_bytes(state.shape[1] * 8, "little"), "<u8")
        state &= self.last
        word = (state != 0).argmax(1)
        found = state[np.arange(len(state)), word]
        low = found & (~found + one)
        bit = np.frexp(low.astype(np.float64))[1] - 1
        return np.where(found != 0, self.rule[word * 64 + np.maximum(bit, 0)], -1)


class Automaton:
    """Rules in the order of precedence, as blocks of masks."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = sorted(rules, key=lambda r: (not r.of_host, -len(r.name)))
        self.blocks: list[Block] = []
        places, total, held = 0, 0, []
        for k, rule in enumerate(self.rules):
            for glob in rule.globs:
                symbols = _symbols(glob)
                n = 1 + sum(kind in ("byte", "one") for kind, _ in symbols)
                total += n
                if total > MOST_PLACES:
                    raise ValueError(f"the rules have more than {MOST_PLACES} places")
                if held and places + n > BLOCK_WORDS * 64:
                    self.blocks.append(Block(held))
                    places, held = 0, []
                held.append((symbols, k))
                places += n
        if held:
            self.blocks.append(Block(held))

    def first_fit(self, texts: pa.Array) -> np.ndarray:
        """For each text the place of its rule in `rules`, or -1."""
        data, offsets = flat(texts)
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        found = np.full(len(lengths), -1)
        for block in self.blocks:  # a rule of an earlier block goes before all of a later one
            order = order[found[order] < 0]
            found[order] = block.run(data, offsets[order], lengths[order])
        return found


def canonical(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    rest = "CASE WHEN contains(url, '://') THEN substring(url, locate('://', url) + 3) ELSE '' END"
    at = pages.selectExpr("cast(page_id as bigint) page_id", f"{rest} rest")
    host = F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, UPPER.lower())
    return at.select("page_id", host.alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def judge(pages: DataFrame, rules: Sequence[Rule] = HOST_RULES + GLOB_RULES, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule (of a host, else null), verdict, and glob (that decided, else null): a row a row, without a shuffle."""
    automaton = Automaton(rules)
    ordered = automaton.rules
    verdicts = np.array([*(r.verdict for r in ordered), otherwise], object)
    names = np.array([*(r.name for r in ordered), None], object)
    of_host = np.array([*(r.of_host for r in ordered), True])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "whole"):
                k = automaton.first_fit(batch.column("whole"))
                by_host = of_host[k]
                rule, glob = np.where(by_host, names[k], None), np.where(by_host, None, names[k])
                out = [*(batch.column(c) for c in ("page_id", "host", "path")), *(pa.array(x, pa.string()) for x in (rule, verdicts[k], glob))]
                yield pa.record_batch(out, ["page_id", "host", "path", "rule", "verdict", "glob"])

    at = canonical(pages).withColumn("whole", F.concat("host", "path"))
    return at.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, glob string")


def as_regex(glob: str) -> str:
    """The glob as a regular expression of its own, for the SQL and the tests."""
    parts = {"star": "[^/]*", "deep": r"[\s\S]*", "one": "[^/]"}
    out, held = "", b""
    for kind, byte in [*_symbols(glob), ("end", 0)]:
        if kind == "byte":
            held += bytes([byte])
        else:
            out, held = out + re.escape(held.decode()) + parts.get(kind, ""), b""
    return out


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    hosts = ", ".join(f"({quote(r.verdict)}, {quote(r.name)}, {quote(r.name.split('/', 1)[0])}, {quote('/' + r.name.split('/', 1)[1])})" for r in HOST_RULES)
    ordered = Automaton(GLOB_RULES).rules
    fits = lambda r: f"regexp_full_match(host || path, {quote(as_regex(r.name))})"
    glob = " ".join(f"WHEN {fits(r)} THEN {quote(r.name)}" for r in ordered)
    verdict = " ".join(f"WHEN {quote(r.name)} THEN {quote(r.verdict)}" for r in ordered)
    return rf"""
WITH rules(verdict, rule, h, p) AS (VALUES {hosts}),
rest AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fit AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM u, rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
g AS (SELECT u.*, rule, verdict, CASE WHEN rule IS NULL THEN CASE {glob} END END AS "glob" FROM u LEFT JOIN fit USING (r))
SELECT page_id, host, path, rule, coalesce(verdict, CASE g."glob" {verdict} END, 'allow') AS verdict, g."glob" FROM g
"""


SQL = _sql()
