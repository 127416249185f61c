"""Secret scans with multipart credential linking.

Three base kinds (assignments, access identifiers, long hex strings) are reported on
their own. Weak candidates are not: a bare secret-like string, an endpoint or a short
identifier is common in clean text. They are reported only when complementary parts
co-occur: candidates of a text are interval-joined within scopes (a scope is a run of
lines without an empty line between, further cut to ``reach`` characters), and a weak
secret needs an access identifier, or an endpoint with an identifier, in its scope. User data
inside an endpoint (``user:password@``) are its identifier and its secret: such an endpoint is
a complete group by itself, and one for the random strings around it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from equityspark.llm import common

KINDS = ("assign", "access", "hex")  # fixed order of the base kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{32}")
WORDS = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)

# weak parts: reported only when linked
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9_])(?:client_?id|user(?:name)?|account|access_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
USER = re.compile(r"[a-z0-9+]+://([^\s\"'<>/?#@:]+):([^\s\"'<>/?#@]+)@", re.I | re.A)  # user data of an endpoint
ENDPOINT = re.compile(r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|s3)://[^\s\"'<>]{4,}", re.I | re.A)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start, then kind as listed."""
    out = []
    if WORDS.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if HEX_RUN.search(text):
        # a run found here is widened to the whole match of the pattern
        at = 0
        while m := HEX_RUN.search(text, at):
            whole = HEX.match(text, m.start())
            out.append((whole.start(), whole.end(), "hex"))
            at = whole.end()
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _scopes(text: str) -> np.ndarray:
    """Start of every scope: the text's start and the end of each empty line."""
    return np.array([0, *[m.end() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]], np.int64)


def linked_spans(text: str, base: list[tuple[int, int, str]], reach: int = 400) -> list[tuple[int, int, str]]:
    """Weak candidates with a complementary part in their scope and reach.

    weak_secret: a mixed string of 20 or more characters near an access identifier or near an
    endpoint with an identifier, and the password inside an endpoint; weak_identifier,
    weak_endpoint: the other parts of a group that holds a secret.
    """
    ends = [(m.start(), m.end(), "weak_endpoint") for m in ENDPOINT.finditer(text)] if "://" in text else []
    idents = [(m.start(), m.end(), "weak_identifier") for m in IDENTIFIER.finditer(text)] if "=" in text or ":" in text else []
    with_user = [(e, m) for e in ends if (m := USER.match(text, e[0], e[1]))]
    own, users = [e for e, _ in with_user], [m for _, m in with_user]
    idents = sorted(idents + [(m.start(1), m.end(1), "weak_identifier") for m in users])
    if not base and not (ends and idents):
        return []
    taken = sorted((s, e) for s, e, _ in base)
    t0, t1 = np.array([s for s, _ in taken], np.int64), np.array([e for _, e in taken], np.int64)

    def free(s: int, e: int) -> bool:
        i = int(np.searchsorted(t1, s, side="right"))
        return i == len(t0) or t0[i] >= e

    secrets = [(m.start(), m.end(), "weak_secret") for m in WEAK_SECRET.finditer(text)]
    starts = np.array([a for a, _, _ in ends], np.int64)

    def outside(s: int) -> bool:
        i = int(np.searchsorted(starts, s, side="right"))
        return i == 0 or ends[i - 1][1] <= s

    secrets = [s for s in secrets if free(s[0], s[1]) and outside(s[0])]
    strong = [s for s in base if s[2] in ("assign", "hex")]
    access = [s for s in base if s[2] == "access"]
    scopes = _scopes(text)

    def near(left: list, right: list) -> tuple[np.ndarray, np.ndarray]:
        """Interval join: which parts of each side have one of the other in their scope, starts at most ``reach`` apart.

        The partners of a left part are one range of ``right``, kept as a start and an end mark.
        """
        hit, marks = np.zeros(len(left), bool), np.zeros(len(right) + 1, np.int64)
        right_at = np.array([r[0] for r in right], np.int64)
        for i, x in enumerate(left):
            k = int(np.searchsorted(scopes, x[0], side="right"))
            lo = max(int(scopes[k - 1]), x[0] - reach)
            hi = min(int(scopes[k]) - 1 if k < len(scopes) else len(text), x[0] + reach)
            a, z = np.searchsorted(right_at, [lo, hi + 1])
            if a < z:
                hit[i] = True
                marks[a] += 1
                marks[z] -= 1
        return hit, np.cumsum(marks)[:-1] > 0

    def those(parts: list, hit: np.ndarray) -> list:
        return [x for x, h in zip(parts, hit, strict=True) if h]

    found = set()
    for left, right in ((secrets, access), (idents, strong), (ends, sorted(strong + access))):
        found.update(those(left, near(left, right)[0]))
    # an endpoint and a random string alone say nothing: an identifier completes the group
    whole = those(ends, near(ends, idents)[0])
    with_secret, near_end = near(whole, secrets)
    whole, weak = those(whole, with_secret), those(secrets, near_end)
    whole = sorted({*whole, *own})
    found.update((m.start(2), m.end(2), "weak_secret") for m in users)
    found.update(whole + weak + those(idents, near(whole, idents)[1]))
    return sorted(s for s in found if free(s[0], s[1]))


def scan(docs: DataFrame, reach: int = 400) -> DataFrame:
    """Add ``spans`` (array of kind, start, end in code points; end exclusive) to every row.

    By start, then base kinds as listed, then linked weak parts. Null and empty texts have
    no spans; repeated rows are scanned alike. The column ``text`` is scanned and dropped,
    other columns are kept; a column named ``spans`` is replaced.
    """
    df = common.passable(docs.drop("spans"))
    keep = [c for c in df.columns if c != "text"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in common.blocks(batches):
            out = []
            for t in b.column("text").to_pylist():
                base = base_spans(t) if t else []
                more = linked_spans(t, base, reach) if t else []
                rank = {k: i for i, k in enumerate(KINDS)}
                out.append([{"kind": k, "start": s, "end": e} for s, e, k in sorted([*base, *more], key=lambda x: (x[0], rank.get(x[2], 3), x[2]))])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out, kind)], names=[*keep, "spans"])

    return df.mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes if c != "text"], "spans array<struct<kind: string, start: bigint, `end`: bigint>>"]))
