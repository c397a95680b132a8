"""URL filters: all wildcard rules at once by a bit-parallel automaton over each canonical URL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): a host with its subdomains, and the start of a path. The longest that fits wins.
Rule = tuple[str, str, str]
#: Rules of the URL filter's query. Fixed values.
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Globs that block an URL to which no rule fits, whatever the case of ASCII letters: `*` is a run without `/` and `?`, `**` any
#: run, `?` one character, a backslash makes the next character plain. They are held against `.host/path?query`.
GLOBS = (
    "*.bet/**", "*.casino/**", "*.porn/**", "*.sex/**", "*.xxx/**", "*.*casino*.*/**", "*.*porn*.*/**", "*.adserver.*/**", "*.doubleclick.*/**",
    "**/wp-login.php**", "**/wp-admin/**", "**/xmlrpc.php**", "**/cgi-bin/**", "**/login", "**/login/**", "**/login\\?**", "**/logout**", "**/signin**", "**/signup**", "**/register\\?**", "**/cart/**", "**/checkout/**",
    "**.apk", "**.avi", "**.bin", "**.css", "**.dmg", "**.exe", "**.gif", "**.gz", "**.iso", "**.jpeg", "**.jpg", "**.js", "**.mov", "**.mp3", "**.mp4", "**.png", "**.rar", "**.svg", "**.tar", "**.woff", "**.zip",
    "**\\?**sessionid=**", "**\\?**phpsessid=**", "**;jsessionid=**", "**\\?**replytocom=**", "**\\?**add-to-cart=**",
)
#: Bits of automaton state that a step holds at once, for as many URLs as that allows.
STATE_BITS = 1 << 25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def rule_name(rule: Rule) -> str:
    return rule[1] + rule[2]


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z in lower case), path and query (with its `?`) of an URL; empty where it is null or has no `://`."""
    part = lambda i: F.coalesce(F.regexp_extract(url, _URL, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2), part(3)


def tokens(glob: str) -> list[str]:
    """A glob's pieces: `**`, `*`, `?`, or a plain character behind a backslash."""
    out, i = [], 0
    while i < len(glob):
        if glob[i] == "\\" and i + 1 < len(glob):
            out.append(glob[i : i + 2])
            i += 2
        elif glob.startswith("**", i):
            out.append("**")
            i += 2
        else:
            out.append(glob[i] if glob[i] in "*?" else "\\" + glob[i])
            i += 1
    return out


def plain(text: str) -> str:
    """A glob that is only this text."""
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def rule_glob(rule: Rule) -> str:
    """A rule as a glob: `*` can't leave the host, as that ends at the first `/`."""
    return f"*.{plain(rule[1])}{plain(rule[2])}**"


class Automaton:
    """Shift-And over many globs: a bit for each byte that a glob wants, and one before it.

    A step moves all bits up by one, keeps those whose byte is read, and those that a star (or the rest of a `?`'s
    character) lets stay: next = (now << 1) & here[byte] | now & stay[byte]. States are rows of 64-bit words.
    """

    def __init__(self, globs: list[tuple[str, bool]]):
        """globs: (glob, whether ASCII letters match in either case)."""
        here, stay, start, ends = [], [], [], []  # for each bit: sets of bytes; the first and last bit of each glob
        anything, run = set(range(256)), set(range(256)) - {ord("/"), ord("?")}
        rest = set(range(0x80, 0xC0))
        for glob, fold in globs:
            start.append(len(here))
            here.append(set())
            stay.append(set())
            for token in tokens(glob):
                if token in ("*", "**"):
                    stay[-1] = stay[-1] | (anything if token == "**" else run)
                elif token == "?":
                    here.append(anything - rest)
                    stay.append(rest)
                else:
                    for byte in token[1].encode():
                        c = chr(byte)
                        here.append({byte, ord(c.lower()), ord(c.upper())} if fold and byte < 128 else {byte})
                        stay.append(set())
            ends.append(len(here) - 1)
        self.words = max(1, -(-len(here) // 64))
        self.here, self.stay = self._masks(here), self._masks(stay)
        self.start = self._word(start)
        self.ends = ends

    def _word(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for bit in bits:
            out[bit // 64] |= np.uint64(1 << bit % 64)
        return out

    def _masks(self, sets: list[set[int]]) -> np.ndarray:
        out = np.zeros((256, self.words), dtype=np.uint64)
        for bit, of in enumerate(sets):
            for byte in of:
                out[byte, bit // 64] |= np.uint64(1 << bit % 64)
        return out

    def _run(self, flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The last states of texts, which stand in `flat` from `begin` on, longest first."""
        state = np.tile(self.start, (len(begin), 1))
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")  # texts that are longer than a step's number
        for step, n in enumerate(active):
            byte = flat[begin[:n] + step]
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = moved & self.here[byte] | now & self.stay[byte]
        return state

    def match(self, texts: pa.Array) -> np.ndarray:
        """Which globs each text (none null) matches as a whole, as a matrix of booleans."""
        length = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1])
        begin = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts)].astype(np.int64)
        flat = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, dtype=np.uint8)
        order = np.argsort(-length.astype(np.int64), kind="stable")
        out = np.zeros((len(texts), len(self.ends)), dtype=bool)
        step = max(1, STATE_BITS // (64 * self.words))
        for at in range(0, len(order), step):
            rows = order[at : at + step]
            state = self._run(flat, begin[rows], length[rows].astype(np.int64))
            for i, bit in enumerate(self.ends):
                out[rows, i] = (state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).astype(bool)
        return out


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, globs: tuple[str, ...] = GLOBS, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """For each row of pages: page_id, host, path, rule, verdict, wildcard.

    rule is the longest (by characters of host and path; then by host, then block before allow) of `rules` that fits the
    host or a parent of it and starts the path, as host and path together; else null. verdict is the rule's; without one it is
    block if one of `globs` matches `.host/path?query`, else allow. wildcard is the first glob that matches, else null, also where
    a rule decides. Host and path are cut as they stand: no port, escape or dot is changed, only A-Z of the host.

    Null urls, and those without `://`, have an empty host and path, and so no rule; of globs only those that match a
    single dot can match. Repeated rows and ids each give a row; other columns aren't read. All rules are one automaton
    whose masks go with the tasks: its size is that of the two parameters. Nothing is shuffled.
    """
    ranked = sorted(rules, key=lambda r: (-len(rule_name(r)), -len(r[1]), r[0] != "block", r))
    machine = Automaton([(rule_glob(r), False) for r in ranked] + [(g, True) for g in globs])
    names = np.array([*map(rule_name, ranked), None], dtype=object)
    verdicts = np.array([r[0] for r in ranked] + ["allow"], dtype=object)
    glob_names = np.array([*globs, None], dtype=object)
    host, path, query = parts(F.col(url))
    cut = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.concat(F.lit("."), host, path, query).alias("canonical"))
    kind = dict(cut.dtypes)["page_id"]

    def first(matched: np.ndarray) -> np.ndarray:
        """The first column that is true, or their number."""
        return np.where(matched.any(axis=1), matched.argmax(axis=1), matched.shape[1]) if matched.shape[1] else np.zeros(len(matched), dtype=int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matched = machine.match(batch.column("canonical").cast(pa.string()))
            by_rule, by_glob = first(matched[:, : len(ranked)]), first(matched[:, len(ranked) :])
            verdict = np.where((by_rule == len(ranked)) & (by_glob < len(globs)), "block", verdicts[by_rule])
            columns = [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(names[by_rule], pa.string()), pa.array(verdict, pa.string()), pa.array(glob_names[by_glob], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict", "wildcard"])

    return cut.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, wildcard string")


def _regex(glob: str) -> str:
    """A glob as a regular expression without regard to case in ASCII."""
    out = []
    for token in tokens(glob):
        if token in ("*", "**", "?"):
            out.append({"*": "[^/?]*", "**": "(?s:.)*", "?": "(?s:.)"}[token])
        else:
            c = token[1]
            out.append(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else "\\" + c if c.isascii() and not c.isalnum() else c)
    return "".join(out)


def oracle(rules: tuple[Rule, ...] = RULES, globs: tuple[str, ...] = GLOBS) -> str:
    """DuckDB SQL of judge() over pages: rules by suffix and prefix, globs by regular expressions."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    part = lambda i: f"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\\?[^#]*)?', {i}), '')"
    rule_rows = ", ".join(f"({quoted(v)}, {quoted(h)}, {quoted(p)})" for v, h, p in rules)
    glob_rows = ", ".join(f"({i}, {quoted(g)}, {quoted(_regex(g))})" for i, g in enumerate(globs))
    return f"""WITH rules(verdict, rule_host, rule_path) AS (VALUES {rule_rows}), globs(n, wildcard, pattern) AS (VALUES {glob_rows}),
cut AS (SELECT page_id, translate({part(1)}, '{UPPER}', '{LOWER}') AS host, {part(2)} AS path, {part(3)} AS query, row_number() OVER () AS id FROM pages),
fit AS (SELECT id, arg_max(struct_pack(rule := rule_host || rule_path, verdict := verdict), [length(rule_host || rule_path), length(rule_host), (verdict = 'block')::INT]) AS best FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1),
hit AS (SELECT id, arg_min(wildcard, n) AS wildcard FROM cut JOIN globs ON regexp_full_match('.' || host || path || query, pattern) GROUP BY 1)
SELECT page_id, host, path, best.rule AS rule, CASE WHEN best IS NOT NULL THEN best.verdict WHEN wildcard IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, wildcard FROM cut LEFT JOIN fit ON fit.id = cut.id LEFT JOIN hit ON hit.id = cut.id"""
