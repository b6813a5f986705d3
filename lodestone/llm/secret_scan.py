"""Secret scans: pattern candidates, then a random forest against false positives.

Candidates of a whole text are (a) values assigned to a name that speaks of a
key, token, password or the like, at least ``least_value`` characters, (b) runs of at
least ``least_run`` key characters with a digit or with several changes of case, (c)
private-key headers and signed web tokens, (d) what is told in prose after such a name
("the password is ..."), at least ``least_value`` characters with a letter and with a
digit or sign inside, (e) passwords of URLs with a user.  Overlapping candidates are
merged into the longest.

The forest sees a candidate's length, its transitions between character classes
and their entropy, how much of it dictionary words cover, words of its path, and
the neighbouring words, the assigned name among them; it is trained from labelled
findings.  A candidate's path is the row's, with the last file name that its text
mentions shortly before it.  ``labelled`` may be any such findings; the default
makes a fixed set by rules: real-looking secrets, assigned or told in prose, and
false alarms both bare (checksums, commits, card numbers, ids, file paths,
identifiers) and assigned to names that speak of keys (cache keys, public keys,
token counts, authors, digests, placeholders).

Defined cases: null and empty texts have no candidate; candidates in rows that
repeat an id are all reported; a null id or path stays null and counts as no
path; a text of any length is searched to its end; other columns are not read, so
their names can't clash; an empty table gives no rows."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import id_longs, id_text

_NAMED = r"(?:key|token|secret|passw(?:or)?d|pwd|credential|auth)"
LEAST_VALUE = 6
LEAST_RUN = 16
_USER = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]{1,20}://[^\s/:@\"'<>]{0,64}:([^\s/@\"'<>]{3,})@")
_INSIDE = re.compile(r"(?=.*[A-Za-z])(?=.*[\d!@#$%^&*+~?])")
_CASES = re.compile(r"[a-z](?=[A-Z])")
_FILE = re.compile(r"[\w./\-]*\.(?:env|py|js|ts|json|ya?ml|toml|ini|cfg|conf|md|rst|lock|txt|xml|properties|sh|tf|pem|ipynb)\b")
_KNOWN = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+")
_DIGIT = re.compile(r"\d")
#: Shapes of provider keys, by rule name.
_RULES = [
    ("private_key", re.compile(r"-----BEGIN .*")),
    ("web_token", re.compile(r"eyJ.*\..*")),
    ("cloud_key_id", re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}")),
    ("forge_token", re.compile(r"gh[pousr]_[A-Za-z0-9]{30,}")),
    ("chat_token", re.compile(r"xox[abprs]-[A-Za-z0-9\-]{10,}")),
    ("payment_key", re.compile(r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}")),
    ("map_key", re.compile(r"AIza[0-9A-Za-z_\-]{30,}")),
]
_GOOD = ("key", "token", "secret", "password", "passwd", "pwd", "credential", "auth", "api", "access", "bearer", "login")
_NOT = ("hash", "sha", "md", "digest", "checksum", "cache", "etag", "idempotency", "public", "primary", "foreign", "count", "length", "limit", "type", "name", "author", "authors", "authority", "tokenizer", "tokens", "keyboard", "keyword", "keywords", "secretary", "monkey", "id", "fingerprint", "index", "sort", "partition", "version", "expires", "url", "path", "file")
_BAD = ("example", "sample", "dummy", "test", "placeholder", "commit", "sha", "md5", "checksum", "hash", "digest", "integrity", "uuid", "guid", "revision", "id", "phone", "card", "version")
_BAD_PATH = ("test", "example", "sample", "fixture", "mock", "doc", "lock", "vendor", "node_modules")
AROUND, FAR = 48, 200  # characters read for neighbouring words, and for a file name
_LETTERS = re.compile(r"[a-z]+")


@functools.lru_cache(16)
def _run(least: int) -> re.Pattern:
    return re.compile(rf"[A-Za-z0-9+/_\-]{{{least},}}={{0,2}}")


@functools.lru_cache(16)
def _assigned(least: int) -> re.Pattern:
    return re.compile(rf"{_NAMED}\w{{0,20}}[\"']?\s{{0,3}}(?::=|=>|[:=])\s{{0,3}}[\"']?([^\s\"'`;,<>]{{{least},}})", re.IGNORECASE)


@functools.lru_cache(16)
def _told(least: int) -> re.Pattern:
    return re.compile(rf"\b(?:{_NAMED}s?|passphrase|passcode|login)\s{{1,3}}(?:(?:is|was|are|as|with|of)\s{{1,3}})?[\"'`]?(?=([^\s\"'`;,<>]{{{least},}}))", re.IGNORECASE)


def candidates(text: str, least_run: int = LEAST_RUN, least_value: int = LEAST_VALUE) -> list[tuple[int, int, str]]:
    """(start, end, rule), in order and without overlaps."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "assigned") for m in _assigned(least_value).finditer(text)]
    if "://" in text and "@" in text:
        found += [(m.start(1), m.end(1), "url") for m in _USER.finditer(text)]
    for m in _told(least_value).finditer(text):
        value = m[1].rstrip(".:)")  # what ends a sentence
        if len(value) >= least_value and _INSIDE.match(value):
            found.append((m.start(1), m.start(1) + len(value), "told"))
    found += [
        (m.start(), m.end(), "run") for m in _run(least_run).finditer(text) if _DIGIT.search(m[0]) or len(_CASES.findall(m[0])) >= 4
    ]
    if "-----BEGIN" in text or "eyJ" in text:
        found += [(m.start(), m.end(), "run") for m in _KNOWN.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for s, e, rule in sorted(found, key=lambda x: (x[0], -x[1])):
        if out and s < out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e, out[-1][2])
            continue
        out.append((s, e, rule))
    return [(s, e, next((n for n, p in _RULES if p.fullmatch(text[s:e])), rule)) for s, e, rule in out]


class Words(frozenset):
    """A dictionary that knows its longest word."""

    @property
    def longest(self) -> int:
        return max(map(len, self), default=0)


def dictionary(model_file: str | None) -> Words:
    """Words of at least 4 letters of a public vocabulary."""
    if not model_file:
        return Words()
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
    words = (lib.id_to_piece(i).lstrip("▁").lower() for i in range(lib.get_piece_size()))
    return Words(w for w in words if len(w) >= 4 and w.isalpha() and w.isascii())


def coverage(value: str, words: frozenset[str], longest: int) -> float:
    """Share of the characters covered by dictionary words, longest first."""
    low, i, covered = value.lower(), 0, 0
    if not low or not words:
        return 0.0
    while i < len(low):
        for n in range(min(longest, len(low) - i), 3, -1):
            if low[i : i + n] in words:
                covered += n
                i += n
                break
        else:
            i += 1
    return covered / len(low)


def path_of(path: str | None, before: str) -> str:
    """The row's path and the last file name in the text before."""
    named = _FILE.findall(before)
    return " ".join(x for x in (path, named[-1] if named else None) if x)


_CLASS = {c: k for k, cs in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits)) for c in cs}
FEATURES = 30


def features(value: str, before: str, after: str, path: str | None, words: frozenset[str], longest: int = 16) -> list[float]:
    n = max(len(value), 1)
    kinds = [_CLASS.get(c, 3) for c in value]
    moves = np.zeros(16)
    for a, b in zip(kinds, kinds[1:]):
        moves[4 * a + b] += 1
    counts: dict[str, int] = {}
    for c in value:
        counts[c] = counts.get(c, 0) + 1
    p = np.array(list(counts.values()) or [1]) / n
    step = sum(1 for a, b in zip(value, value[1:]) if ord(b) - ord(a) in (0, 1)) / n
    low = value.lower()
    near = set(_LETTERS.findall(before.lower())) | set(_LETTERS.findall(after.lower()))
    close = _LETTERS.findall(before.lower()[-24:])
    where = (path or "").lower()
    return [
        float(len(value)), *(moves[[0, 5, 10, 2, 8, 6, 9, 1, 4]] / n).tolist(),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, float(-(p * np.log2(p)).sum()), len(counts) / n, step,
        kinds.count(2) / n, kinds.count(1) / n, kinds.count(3) / n,
        float(all(c in "0123456789abcdef" for c in low)), float(low.isdigit()),
        coverage(value, words, longest), float(value[:1] in "$<{%" or "${" in value),
        float(any(w in close[-2:] for w in _GOOD) or any(w in x for x in close[-2:] for w in _GOOD[:7])),
        float(sum(w in near for w in _GOOD)), float(sum(w in near for w in _BAD)),
        float(any(w in where for w in _BAD_PATH)), float(any(w in low for w in ("example", "sample", "test", "changeme", "your", "xxxx", "dummy"))),
        float(before.rstrip(" \"'").endswith(("=", ":"))), float(after[:1] == "@" and "://" in before),
        float(any(w in _NOT for w in close[-3:])),
        max((n for n in (len(x) for x in _LETTERS.findall(low))), default=0) / n,
    ]


def labelled_findings(n: int = 2400, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, label) made by rules."""
    r = random.Random(seed)

    def pick(chars, k):
        return "".join(r.choice(chars) for _ in range(k))

    def word(k=None):
        return "".join(r.choice(["th", "er", "in", "on", "re", "an", "la", "que", "en", "sch", "tion", "ing", "st", "de"]) for _ in range(k or r.randint(1, 4)))

    def prose(k):
        return " ".join(word() for _ in range(k))

    hexa, b64 = "0123456789abcdef", string.ascii_letters + string.digits
    names = ["token", "api_key", "secret", "password", "passwd", "access_token", "client_secret", "auth_token", "db_password", "SECRET_KEY", "apiKey"]
    out = []
    for _ in range(n * 2 // 5):
        kind = r.randrange(8)
        name, op, quote = r.choice(names), r.choice([" = ", "=", ": ", ":", " := "]), r.choice(['"', "'", ""])
        before, after = f"{prose(4)} {name}{op}{quote}", f"{quote} {prose(3)}"
        if kind == 0:
            value = pick(hexa, r.choice([32, 40, 64]))
        elif kind == 1:
            value = pick(hexa, r.randint(12, 24))
        elif kind == 2:
            value = r.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16)
            if r.random() < 0.7:
                before, after = prose(5) + " ", " " + prose(4)
        elif kind == 3:
            value = r.choice(["ghp_", "gho_", "ghs_"]) + pick(b64, 36)
            if r.random() < 0.5:
                before, after = prose(5) + " ", " " + prose(4)
        elif kind == 4:
            value = r.choice(["sk_live_", "rk_live_", "xoxb-", "AIza"]) + pick(b64, r.randint(24, 35))
            if r.random() < 0.5:
                before, after = prose(5) + " ", " " + prose(4)
        elif kind == 5:
            value = pick(b64 + "+/", r.choice([32, 40, 44]))
        elif kind == 6:
            value = pick(b64 + "!@#%^*_-", r.randint(8, 20))
        else:
            value = "eyJ" + pick(b64, 20) + "." + pick(b64 + "_-", 40) + "." + pick(b64 + "_-", 43)
            if r.random() < 0.5:
                before, after = "Authorization: Bearer ", " " + prose(2)
        if kind in (0, 1, 5, 6) and r.random() < 0.25:  # told in prose
            before, after = f"{prose(3)} {r.choice(['the api key is', 'my password is', 'use the token', 'login with password', 'secret key', 'access token'])} ", f" {prose(3)}"
        if kind == 6 and r.random() < 0.3:  # of a user in a URL
            value = r.choice([value.replace("@", "a").replace("#", "b"), word(2) + pick(string.digits, r.randint(1, 4)) + word(1)])
            before, after = f"{prose(3)} {r.choice(['postgres', 'https', 'mysql', 'redis', 'amqp', 'ftp'])}://{r.choice(['admin', 'root', 'app', word()])}:", f"@{word()}.{r.choice(['internal', 'com', 'local'])}:5432/{word()}"
        out.append((value, before, after, r.choice(["src/app.py", "config/prod.env", "web/page.html", ""]), 1))
    for _ in range(n - n * 2 // 5):
        kind = r.randrange(18)
        name, op, quote = r.choice(names), r.choice([" = ", "=", ": "]), r.choice(['"', "'", ""])
        before, after, path = f"{prose(4)} ", f" {prose(4)}", r.choice(["src/app.py", "docs/guide.md", "package-lock.json", "tests/test_app.py", ""])
        if kind == 0:
            value = r.choice(["YOUR_API_KEY", "your-secret-here", "changeme", "xxxxxxxxxxxxxxxx", "example_token", "<password>", "placeholder", "dummy-secret-value1"])
            before = f"{prose(3)} {name}{op}{quote}"
        elif kind == 1:
            value = r.choice(["${", "$", "{{", "%("]) + pick(string.ascii_uppercase, r.randint(5, 12)) + r.choice(["}", "", "}}", ")s"])
            before = f"{prose(3)} {name}{op}{quote}"
        elif kind == 2:
            value, before = pick(hexa, 40), f"{prose(3)} {r.choice(['commit', 'revision', 'sha', 'parent'])} "
        elif kind == 3:
            value, before = pick(hexa, r.choice([32, 64])), f"{prose(3)} {r.choice(['md5', 'sha256', 'checksum', 'digest', 'hash'])}{r.choice([': ', '=', ' '])}"
        elif kind == 4:
            value = "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
            before = f"{prose(3)} {r.choice(['id', 'uuid', 'guid', 'request', word()])}{r.choice([': ', '=', ' '])}"
        elif kind == 5:
            value = pick(string.digits, r.choice([16, 16, 17, 18, 20]))
        elif kind == 6:
            value = "/".join([word(), word(), word() + pick(string.digits, 2)]) + "/" + word(4)
        elif kind == 7:
            value = "".join(word(2).capitalize() for _ in range(3)) + pick(string.digits, 1)
        elif kind == 8:
            value = f"{r.choice(['getUser', 'os.environ.get', 'load', 'read'])}({word()})" if r.random() < 0.5 else "_".join(word(2) for _ in range(3))
            before = f"{prose(3)} {name}{op}"
        elif kind == 9:
            value, before = "sha512-" + pick(b64 + "+/", 86) + "==", f"{prose(2)} integrity: {quote}"
        elif kind == 10:
            value = word(3) if r.random() < 0.6 else word(2) + "," + word(2)
            before = f"{prose(3)} {name}{op}"
        elif kind in (11, 12):  # names that speak of keys, values that are none
            value = r.choice([pick(hexa, 32), pick(hexa, 40), pick(hexa, 64), pick(b64 + "+/", 44), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))])
            named = r.choice(["cache_key", "token_hash", "key_sha256", "key_fingerprint", "idempotency_key", "public_key", "password_md5", "etag_key", "authority_id", "key_id", "token_digest", "sort_key", "partition_key", "author_id"])
            before = f"{prose(3)} {named}{op}{quote}"
        elif kind == 13:
            value = r.choice([pick(string.digits, r.randint(6, 10)), word(2) + "-" + word(2), word(2) + "_" + word(1) + pick(string.digits, 2), word(1) + "." + word(2)])
            named = r.choice(["token_count", "tokens_limit", "primary_key", "foreign_key", "keyboard_type", "tokenizer", "author", "authors", "keywords", "secretary", "token_type", "key_length", "keyword_index"])
            before = f"{prose(3)} {named}{op}{quote}"
        elif kind == 14:  # keys of documentation and runs that only look random
            value = r.choice(["AKIA" + pick(string.ascii_uppercase, 9) + "EXAMPLE", "0123456789abcdef" * 2, pick("0", 20) + "1", "abcdefghijklmnop1234", "deadbeef" * r.randint(2, 5), "sk_test_" + "x" * 20, "a1b2c3d4e5f6a1b2c3d4", "xxxx-xxxx-xxxx-1234"])
            before, path = f"{prose(3)} {name}{op}{quote}", r.choice([path, "docs/example.md", "tests/fixtures.json"])
        elif kind == 16:  # told in prose, and no secret
            value = r.choice([word(2) + pick(string.digits, r.randint(1, 2)), f"v{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 20)}", word(1) + "-" + pick(string.digits, 2) + word(1), word(2) + "?", "#" + pick(string.digits, 3) + word(1), f"{word(2)}/{pick(string.digits, 4)}", word(2) + "!"])
            before = f"{prose(3)} {r.choice(['the token', 'key', 'password', 'login with', 'secret is', 'tokens of', 'auth'])} "
        elif kind == 17:  # users in URLs without a password of their own
            value = r.choice(["password", "pass", "<password>", "${DB_PASS}", "xxxx", "***", "changeme", "secret", "PASSWORD", "$PW"])
            before, after = f"{prose(3)} {r.choice(['postgres', 'https', 'mysql', 'redis'])}://{r.choice(['user', 'username', 'admin'])}:", f"@{r.choice(['host', 'localhost', 'example.com'])}:5432/db"
        else:  # identifiers with changes of case
            value = word(1) + "".join(word(r.randint(1, 2)).capitalize() for _ in range(5))
            if r.random() < 0.4:
                before = f"{prose(3)} {name}{op}"
        out.append((value, before, after, path, 0))
    return out


class Forest:
    """A random forest of binary splits, fitted on quantile cuts of features."""

    def __init__(self, trees: int = 40, depth: int = 9, least: int = 4, seed: int = 3):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.nodes: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.trees):
            rows = rng.integers(0, len(y), len(y))
            tree: list[list[float]] = []
            self._grow(x[rows], y[rows], 0, rng, tree)
            self.nodes.append(tuple(np.array([n[k] for n in tree]) for k in range(5)))
        return self

    def _grow(self, x, y, depth, rng, tree) -> int:
        me, share = len(tree), float(y.mean())
        tree.append([-1, 0.0, 0, 0, share])
        if depth >= self.depth or len(y) < 2 * self.least or share in (0.0, 1.0):
            return me
        best = (2 * share * (1 - share) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5) + 1), replace=False):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 13))):
                left = x[:, f] <= cut
                n = int(left.sum())
                if min(n, len(y) - n) < self.least:
                    continue
                a, b = y[left].mean(), y[~left].mean()
                g = (n * 2 * a * (1 - a) + (len(y) - n) * 2 * b * (1 - b)) / len(y)
                if g < best[0]:
                    best = (g, int(f), float(cut))
        if best[1] < 0:
            return me
        left = x[:, best[1]] <= best[2]
        tree[me][0], tree[me][1] = best[1], best[2]
        tree[me][2] = self._grow(x[left], y[left], depth + 1, rng, tree)
        tree[me][3] = self._grow(x[~left], y[~left], depth + 1, rng, tree)
        return me

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth + 1):
                f = feature[at].astype(np.int64)
                go = f >= 0
                side = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], left[at], right[at]).astype(np.int64)
                at = np.where(go, side, at)
            total += share[at]
        return total / max(1, len(self.nodes))


def train(labelled: list[tuple[str, str, str, str, int]], words: frozenset[str]) -> Forest:
    longest = max(map(len, words), default=0)
    x = np.array([features(v, b, a, path_of(p, b), words, longest) for v, b, a, p, _ in labelled])
    return Forest().fit(x, np.array([float(t[4]) for t in labelled]))


_SCHEMA = "doc_id long, finding long, rule string, first_char long, end_char long, secret_sha256 string, score double, is_secret boolean"


def scan_secrets(docs: DataFrame, *, model_file: str | None = None, labelled: list | None = None, id_col: str = "doc_id", text_col: str = "text",
                 path_col: str | None = None, threshold: float = 0.5, least_run: int = LEAST_RUN, least_value: int = LEAST_VALUE) -> DataFrame:
    """One row for each candidate: its place, rule, hash, score and verdict.  The
    secret itself is never in the result."""
    words = dictionary(model_file)
    forest, longest = train(labelled if labelled is not None else labelled_findings(), words), words.longest

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        for pdf in batches:
            found, x = [], []
            for key, text, path in zip(id_longs(pdf["__id"]), pdf["__text"].tolist(), pdf["__path"].tolist()):
                for k, (s, e, rule) in enumerate(candidates(text or "", least_run, least_value)):
                    value = text[s:e]
                    found.append([key, k, rule, s, e, hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()])
                    x.append(features(value, text[max(0, s - AROUND) : s], text[e : e + AROUND], path_of(path, text[max(0, s - FAR) : s]), words, longest))
            score = forest.scores(np.array(x).reshape(-1, FEATURES))
            out = pd.DataFrame([[*f, float(p), bool(p >= threshold)] for f, p in zip(found, score)], columns=names)
            out["doc_id"] = pd.array(out["doc_id"].tolist(), dtype="Int64")
            yield out

    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    rows = docs.select(id_text(F.col(id_col)).alias("__id"), F.col(text_col).alias("__text"), path.alias("__path"))
    return rows.mapInPandas(run, _SCHEMA)
