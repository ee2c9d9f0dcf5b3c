"""Secret scans with a random forest that removes false positives.

Candidates come from patterns of known key shapes and of quoted or bare values
after words such as ``token =``, whole at any length. Each candidate gets features of its length,
of its character classes and the transitions between them, of how much of it
dictionary words cover (the whole words of a tokenizer's vocabulary, if its path is given), of the path it was found in and of the neighbouring
words. A forest of decision trees trained from labelled findings scores it;
candidates under ``threshold`` are false positives.

Labelled findings are made by ``labelled_findings`` from a fixed seed: random
keys after words that name secrets, against placeholders, words, checksums,
identifiers and paths. ``train`` also takes a table of findings
(candidate, path, before, after, label), of which it uses the ``MOST_ROWS`` with the
smallest hash.

Defined results: a null or empty text has no findings; a null path is an empty
path; repeated rows get equal results; a null id is kept; an empty table gives
an empty result; other columns play no part.
"""

from __future__ import annotations

import json
import math
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import text_of

MOST_ROWS = 20_000
CONTEXT = 48
SHAPES = {
    "aws-key-id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github-token": r"\bgh[pousr]_[0-9A-Za-z]{30,}+\b",
    "slack-token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}\b",
    "google-key": r"\bAIza[0-9A-Za-z_-]{35}",
    "stripe-key": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}+\b",
    "jwt": r"\beyJ[0-9A-Za-z_-]{8,}+\.eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+",
    "private-key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "assigned": r"(?ai:(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth(?:orization)?|credential)s?)[\"']?[ \t]*+(?::=|=>|=|:)[ \t]*+[\"']?(?P<value>[^\s\"'<>,;]{6,}+)",
}
FINDER = re.compile("|".join(f"(?P<k{i}>{p})" for i, p in enumerate(SHAPES.values())))
KINDS = list(SHAPES)
#: What any of the shapes holds; texts without it are passed over by the JVM.
HINT = r"(?i)akia|asia|gh[pousr]_|xox[abprs]-|aiza|[sr]k_(?:live|test)_|eyj|private key|token|secret|passw|pwd|key|auth|credential"
WORDS = "about access account admin after again alpha apple base before beta black blue change check client code config connect data database debug default delete demo description dev disable document domain dummy empty enable encode error example fake false file first fixture folder function global green group hello here home host house index input insert invalid item key language last layer letter level list local login main manager master message method missing mode module monkey name network none null number object option output page parameter password path placeholder please port private production public query random read record remote replace request required result return right root sample schema secret select server service session setting simple source staging start state status string super system table temp test text this time token true type undefined unknown update user value variable version welcome with word world write xxxx your".split()
NAMES_SECRET = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "auth", "credential", "private")
#: Words, whole, beside values that are no secrets.
NAMES_OTHER = frozenset(("example", "sample", "test", "dummy", "placeholder", "sha", "md", "checksum", "hash", "commit", "revision", "uuid", "digest", "integrity", "etag", "fingerprint"))
PATHS_OTHER = ("test", "spec", "fixture", "example", "sample", "mock", "doc", "vendor", "lock")


@cache
def _dictionary(path: str | None):
    """An automaton of the words of ``path`` (a tokenizer's vocabulary of whole words), or of ``WORDS``: ASCII letters, four or more."""
    import ahocorasick

    words = set(WORDS)
    if path:
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ends = [w.removesuffix("</w>") for w in vocabulary if w.endswith("</w>")]
        words |= set(ends or (w.lstrip("\u0120\u2581") for w in vocabulary))
    found = ahocorasick.Automaton()
    for w in words:
        if len(w) >= 4 and w.isascii() and w.isalpha() and w.islower():
            found.add_word(w, len(w))
    found.make_automaton()
    return found


def covered(text: str, path: str | None = None) -> float:
    """The part of ``text`` that words of the dictionary cover, each place counted once."""
    low = text.lower()
    if not low.isascii():
        low = "".join(c if c.isascii() else "\x00" for c in low)
    spans, total, last = sorted((end - n + 1, end + 1) for end, n in _dictionary(path).iter(low)), 0, 0
    for a, b in spans:
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total / max(1, len(low))


def classes(text: str) -> np.ndarray:
    return np.array([0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in text], np.int64)


def features(candidate: str, path: str, before: str, after: str, dictionary: str | None = None) -> list[float]:
    n = len(candidate)
    kinds = classes(candidate)
    moves = np.bincount(kinds[:-1] * 4 + kinds[1:], minlength=16) / max(1, n - 1)
    counts = np.unique(list(candidate), return_counts=True)[1] / n
    entropy = float(-(counts * np.log2(counts)).sum())
    low = candidate.lower()
    vowels = sum(c in "aeiou" for c in low) / n
    hexed = sum(c in "0123456789abcdef" for c in low) / n
    runs = max((len(m[0]) for m in re.finditer(r"(.)\1*", candidate, re.S)), default=0) / n
    near, tail, place = before.lower(), after.lower(), path.lower()
    last = re.findall(r"[a-z_]+", near)[-2:]
    return [
        math.log2(n), entropy, entropy / math.log2(max(2, n)), covered(candidate, dictionary), vowels, hexed, runs,
        *(np.bincount(kinds, minlength=4) / n).tolist(),
        *moves.tolist(),
        float((kinds[:-1] != kinds[1:]).mean()) if n > 1 else 0.0,
        float(any(w in p for p in last for w in NAMES_SECRET)),
        float(any(w in near for w in NAMES_SECRET)),
        float(not NAMES_OTHER.isdisjoint(re.findall("[a-z]+", f"{near} {tail}"))),
        float(any(w in place for w in PATHS_OTHER)),
        float(any(x in candidate for x in ("${", "{{", "<", "%(", "$(", "()"))),
        float("." in candidate or "/" in candidate),
    ]


def labelled_findings(n: int = 3000, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """(candidate, path, before, after, label): the same for the same seed."""
    rng = random.Random(seed)
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    draw = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    real_paths = ["", "src/main.py", "config/settings.yaml", "deploy/prod.env", "src7", "app/server.js"]
    other_paths = ["tests/test_login.py", "docs/example.md", "fixtures/sample.json", "package-lock.json"]
    fillers = ["the value of", "and in", "set", "config", "please use", "le la de", "der die das", "ihanou ertion"]
    found = []
    for i in range(n):
        name = rng.choice(NAMES_SECRET)
        before = f"{rng.choice(fillers)} {name}{rng.choice([' = ', '=', ': '])}{rng.choice(['', chr(34), chr(39)])}"
        after = rng.choice(['"', "'", " end", "", " and then"])
        if i % 2:
            value = rng.choice([
                lambda: draw("0123456789abcdef", rng.choice([32, 40, 64])),
                lambda: draw(low + low.upper() + digits, rng.randint(16, 48)),
                lambda: draw(low + low.upper() + digits + "+/", rng.choice([24, 40, 44])) + "=",
                lambda: "AKIA" + draw(low.upper() + digits, 16),
                lambda: "ghp_" + draw(low + low.upper() + digits, 36),
                lambda: draw(low + low.upper() + digits + "!@#$%^&*", rng.randint(10, 20)),
            ])()
            found.append((value, rng.choice(real_paths), before, after, 1))
            continue
        value = rng.choice([
            lambda: rng.choice(["_", "-", ""]).join(rng.sample(WORDS, rng.randint(2, 4))),
            lambda: rng.choice("xX*0.#") * rng.randint(6, 40),
            lambda: "${" + draw(low.upper(), rng.randint(4, 12)) + "}",
            lambda: ".".join(rng.sample(WORDS, rng.randint(2, 4))) + rng.choice(["", "()"]),
            lambda: rng.choice(WORDS) + draw(digits, rng.randint(1, 4)),
            lambda: draw("eaiounrst", rng.randint(6, 16)),
            lambda: "changeme" + draw(digits, rng.randint(0, 3)),
            lambda: rng.choice(["your", "my", "<your", "insert", "enter"]) + rng.choice("-_") + rng.choice("-_").join(rng.sample(WORDS, 2)) + rng.choice(["", "-here", "_here", ">"]),
            lambda: rng.choice(["process.env.", "os.environ.", "self.", "config.", "settings."]) + "_".join(rng.sample(WORDS, 2)).upper(),
            lambda: "".join(w.capitalize() for w in rng.sample(WORDS, rng.randint(2, 4))) + rng.choice(["", "()", "Id"]),
            lambda: "1234567890abcdef"[: rng.randint(6, 16)],
            lambda: "-".join(draw("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
            lambda: draw("0123456789abcdef", rng.choice([32, 40, 64])),
        ])()
        if re.fullmatch(r"[0-9a-f]{32,64}|[0-9a-f-]{36}", value):  # these are told by their neighbours
            before = f"{rng.choice(fillers)} {rng.choice(['sha256', 'commit', 'checksum', 'md5 hash', 'uuid', 'etag'])} {rng.choice(['token', 'key'])}{rng.choice(['=', ': '])}"
        found.append((value, rng.choice(real_paths + other_paths), before, after, 0))
    return found


class Forest:
    """Decision trees on bootstrap rows with a random choice of features at each split; leaves hold the share of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 9, least: int = 4, seed: int = 11, dictionary: str | None = None):
        self.trees, self.dictionary = [], dictionary
        rng = np.random.default_rng(seed)
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[rows], y[rows], depth, least, rng))

    @staticmethod
    def _split(x: np.ndarray, y: np.ndarray, rng: np.random.Generator):
        best = (0.0, -1, 0.0)
        n, ones = len(y), y.sum()
        impurity = ones * (n - ones) / n
        for f in rng.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            if not len(at):
                continue
            k, left = at + 1, c[at]
            gain = impurity - left * (k - left) / k - (ones - left) * (n - k - ones + left) / (n - k)
            b = int(gain.argmax())
            if gain[b] > best[0] + 1e-9:
                best = (float(gain[b]), int(f), float((v[at[b]] + v[at[b] + 1]) / 2))
        return best[1:]

    def _grow(self, x, y, depth, least, rng):
        """Arrays of feature (-1 for a leaf), threshold, left child, right child, value."""
        nodes: list[list[float]] = []
        work = [(np.arange(len(y)), 0, -1, 0)]
        while work:
            rows, level, parent, side = work.pop()
            me = len(nodes)
            nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
            if parent >= 0:
                nodes[parent][2 + side] = me
            if level == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
                continue
            f, t = self._split(x[rows], y[rows], rng)
            if f < 0:
                continue
            nodes[me][:2] = [f, t]
            low = x[rows, f] <= t
            work += [(rows[low], level + 1, me, 0), (rows[~low], level + 1, me, 1)]
        table = np.array(nodes)
        return table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (open_ := feature[at] >= 0).any():
                rows = np.flatnonzero(open_)
                f = feature[at[rows]]
                at[rows] = np.where(x[rows, f] <= threshold[at[rows]], left[at[rows]], right[at[rows]])
            total += value[at]
        return total / len(self.trees)


def train(findings: DataFrame | list | None = None, dictionary: str | None = None) -> Forest:
    """A forest from labelled findings: rows of (candidate, path, before, after, label), or those made here.

    ``dictionary`` is the path of a tokenizer file whose whole words serve as dictionary, here and on executors.
    """
    if isinstance(findings, DataFrame):
        few = findings.select("candidate", "path", "before", "after", "label").orderBy(F.xxhash64("candidate", "before", "after"), "candidate", "before", "after").limit(MOST_ROWS)
        findings = [tuple(r) for r in few.collect()]
    rows = findings or labelled_findings()
    x = np.array([features(c, p or "", b or "", a or "", dictionary) for c, p, b, a, _ in rows])
    return Forest(x, np.array([r[4] for r in rows], np.float64), dictionary=dictionary)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each candidate."""
    found = []
    for m in FINDER.finditer(text):
        group = m.lastgroup if m.lastgroup != "value" else None
        kind = "assigned" if group is None or m["value"] is not None else KINDS[int(group[1:])]
        found.append((kind, *(m.span("value") if m["value"] is not None else m.span())))
    return found


def findings_in(text: str, path: str, forest: Forest, threshold: float) -> tuple[int, list[tuple[str, int, int, float]]]:
    """Number of candidates, and (kind, start, end, score) of those that stay."""
    spans = candidates(text)
    if not spans:
        return 0, []
    x = np.array([features(text[a:b], path, text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], forest.dictionary) for _, a, b in spans])
    scores = np.round(forest.score(x), 6)
    # a private key's header is a finding whatever it is made of
    return len(spans), [(k, a, b, float(s)) for (k, a, b), s in zip(spans, scores, strict=True) if s >= threshold or k == "private-key"]


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, n_candidates, n_secrets, top_score and findings (kind:start:end, in order)."""

    def run(batches):
        for b in batches:
            columns = ([], [], [], [])
            for text, path in zip(b.column(1), b.column(2), strict=True):
                n, found = findings_in(text.as_py(), path.as_py(), forest, threshold) if text.is_valid else (0, [])
                row = (n, len(found), max((f[3] for f in found), default=0.0), ",".join(f"{k}:{a}:{e}" for k, a, e, _ in found))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.string())], ["id", "n_candidates", "n_secrets", "top_score", "findings"])

    path = text_of(path_col).cast("string") if path_col else F.lit("")
    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.when(text.rlike(HINT), text).alias("text"), path.alias("path"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_candidates long, n_secrets long, top_score double, findings string").withColumnRenamed("id", id_col)
