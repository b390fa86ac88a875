"""Secret scan: candidates by pattern, false positives removed by a random forest.

Patterns find strings that may be credentials. A forest trained on labelled findings then looks at
length, character transitions, dictionary coverage, path and neighbouring words. The dictionary is
counted from all documents. What a neighbouring or path word says is learned: words are hashed, and
each bucket has the log-odds of standing beside a secret among the findings.
"""

from __future__ import annotations

import math
import random
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import raw, slices, strings

TREES, DEPTH, CUT = 60, 12, 0.5
#: Words that the dictionary keeps, documents that hold a kept word at least, and words that a task counts before it passes its sums on.
DICTIONARY_WORDS, DICTIONARY_HOLDING, COUNTED_WORDS = 20_000, 3, 200_000
WORD = re.compile(r"\b[a-z]{4,20}\b")
TEXT_PIECE = 1 << 20

#: Fixed patterns: kinds of candidates, tried in this order; the group holds the secret.
PATTERNS: dict[str, str] = {
    "private_key": r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}?-----END [A-Z ]{0,20}PRIVATE KEY-----)",
    "aws_key_id": r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b",
    "github_token": r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b",
    "slack_token": r"\b(xox[abprs]-[A-Za-z0-9-]{10,})",
    "google_key": r"\b(AIza[0-9A-Za-z_-]{35})",
    "jwt": r"\b(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
    "assignment": r"(?i:(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential)[a-z0-9_.-]{0,40}[\"']?\s{0,3}(?::=|=>|=|:)\s{0,3}[\"']?)([^\s\"'`<>,;]{8,})",
    "connection": r"(?:\b[a-z][a-z0-9+.-]{1,20}://[^\s/@:\"'<>]{0,60}:)([^\s/@\"']{4,}?)(?=@[A-Za-z0-9\[])",
    "opaque": r"(?<![A-Za-z0-9+/_.-])((?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{24,}={0,2})(?![A-Za-z0-9+/_=-]|\.[A-Za-z0-9+/_=-])",
}
#: What every candidate but an opaque one holds, in the simpler language of Arrow's matcher, to choose the texts that are searched.
PREFILTER = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----|AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|eyJ|(?i:(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential)[a-z0-9_.-]{0,40}[\"']?\s{0,3}[:=])|://[^\s/@:\"'<>]{0,60}:[^\s/@\"']{4,}@"
OPAQUE_CHARS = 24
OPAQUE = np.zeros(256, bool)
OPAQUE[list((string.ascii_letters + string.digits + "+/_-").encode())] = True
FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))

#: Fixed words that the dictionary always has: common ones, and what placeholders are made of.
COMMON = "the and for you your this that with from have are not was but all can has user admin name value change changeme example sample test password secret token key access default string here insert none null true false config local host server client demo dummy placeholder foo bar baz qwerty letmein welcome enter please replace data file path http https www com org net".split()

FEATURES = (
    "length", "entropy", "transitions", "digits", "upper", "lower", "marks", "hexadecimal", "distinct", "longest_run", "dictionary", "path", "near_most", "near_least", "key_sum", "key_least", "reference", "uuid", "separators",
    "assignment", "opaque", "known_format", "connection", "inner_digits",
)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words beside a candidate are those of an identifier, too; buckets of their hashes, and findings that a bucket needs to say something.
NEIGHBOUR = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
SLOTS, BUCKETS, BUCKET_HOLDING = ("key", "near", "path"), 4096, 8
SHAPES = ("code", "environment", "yaml", "json", "log", "connection", "known", "bare")


def dictionary(docs: DataFrame, most: int = DICTIONARY_WORDS, text_col: str = "text") -> list[str]:
    """Words of 4 to 20 ASCII letters that most documents hold (three at least), at most ``most``, by how many and in order.

    Every row is counted, each word once a text; words that tie where ``most`` would be passed are left
    out together. ``most`` bounds what the driver receives, beside a row for each different count. A
    task sends the sums of about ``COUNTED_WORDS`` different words at a time, so its memory is bounded.
    """
    store = Scratch(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[str] = Counter()
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in strings(batch.column(0)).to_pylist():
                held: set[str] = set()
                at = 0
                while at < len(text):  # a piece ends at a space
                    end = text.find(" ", at + TEXT_PIECE)
                    end = len(text) if end < 0 else end
                    held.update(WORD.findall(text[at:end]))
                    at = end
                sums.update(held)
                if len(sums) > COUNTED_WORDS:
                    yield packed()
                    sums.clear()
        yield packed()

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    sums = store.written(parts.where(F.col("n") >= DICTIONARY_HOLDING), "dictionary")
    cut = total = 0
    for n, words in sorted(((r.n, r.words) for r in sums.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True):
        total += words
        if total > most:
            cut = n
            break
    found = sums.where(F.col("n") > cut).collect()
    store.clear()
    return [r.word for r in sorted(found, key=lambda r: (-r.n, r.word))]


def automaton(words: Sequence[str]) -> ahocorasick.Automaton:
    """Finds the words of the dictionary, and the common ones, in a string."""
    found = ahocorasick.Automaton()
    for w in (*COMMON, *words):
        if len(w) > 2:
            found.add_word(w, len(w))
    found.make_automaton()
    return found


def neighbours(left: str, right: str, path: str) -> dict[str, list[int]]:
    """Buckets of the three words before a candidate, of the others within 40 characters, and of its path."""
    buckets = lambda words: [zlib.crc32(w.lower().encode()) % BUCKETS for w in words]
    before = NEIGHBOUR.findall(left[-40:])
    return {"key": buckets(before[-3:]), "near": buckets(before[:-3] + NEIGHBOUR.findall(right[:40])), "path": buckets(NEIGHBOUR.findall(path))}


def log_odds(findings: Sequence[tuple]) -> dict[str, np.ndarray]:
    """For each slot and bucket: log-odds of a secret among the findings whose neighbours fall there; 0 where they are few."""
    out = {}
    near = [(neighbours(*f[2:5]), f[5]) for f in findings]
    for slot in SLOTS:
        seen = np.zeros((2, BUCKETS))
        for words, secret in near:
            seen[secret, list(set(words[slot]))] += 1
        total = np.maximum(np.bincount([f[5] for f in findings], minlength=2), 1)[:, None]
        share = (seen + 1) / (total + 2)
        out[slot] = np.where(seen.sum(axis=0) >= BUCKET_HOLDING, np.log(share[1] / share[0]), 0.0)
    return out


def features(value: str, kind: str, left: str, right: str, path: str, words: ahocorasick.Automaton, odds: dict[str, np.ndarray]) -> list[float]:
    """Numbers that describe a candidate, its path and the words on either side (40 characters or more are given)."""
    n = max(len(value), 1)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in value]
    count = {k: kinds.count(k) / n for k in "dulm"}
    freq = [c / n for c in Counter(value).values()]
    run = longest = 1
    for a, b in zip(value, value[1:], strict=False):
        run = run + 1 if a == b or abs(ord(a) - ord(b)) == 1 else 1
        longest = max(longest, run)
    covered = np.zeros(n, bool)
    for end, size in words.iter(value.lower()[:n]):
        covered[end + 1 - size : end + 1] = True
    said = {slot: odds[slot][found] if found else np.zeros(1) for slot, found in neighbours(left, right, path).items()}
    inner = sum(kinds[i] == "d" and set(kinds[i + 1 :]) & {"u", "l"} != set() for i in range(len(kinds)))
    return [
        float(n), -sum(f * math.log2(f) for f in freq), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, count["d"], count["u"], count["l"], count["m"],
        float(all(c in string.hexdigits for c in value)), len(set(value)) / n, longest / n, float(covered.mean()), float(said["path"].sum()),
        float(said["near"].max()), float(said["near"].min()), float(said["key"].sum()), float(said["key"].min()),
        float(value[:1] in "$<{[%(") + float("(" in value), float(UUID.fullmatch(value) is not None), float(value.count("/") + value.count(".")) / n, float(kind == "assignment"), float(kind == "opaque"), float(kind not in ("assignment", "opaque", "connection")), float(kind == "connection"), inner / n,
    ]


def labelled_findings(rows: int = 6000, seed: int = 7, words: Sequence[str] = (), shapes: Sequence[str] = SHAPES) -> list[tuple[str, str, str, str, str, int]]:
    """(value, kind, left, right, path, is secret): labelled findings made by rule from a seed.

    The tables hold no labelled findings, so these stand in; ``train`` takes any others. Secrets are
    random strings, pass phrases and passwords as people make them, in ``shapes`` where such stand, and
    known formats. Harmless are random strings that are no secrets (checksums, revisions, UUIDs, cache
    names, even where a key word is near) and values of key words that are not random (placeholders,
    references to variables, calls, phrases, identifiers, paths, counting and repeated characters).
    ``words`` (the dictionary) are what phrases are made of.
    """
    rng = random.Random(seed)
    of = lambda chars, lo, hi: "".join(rng.choices(chars, k=rng.randint(lo, hi)))
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    pool = [*("the river moved under old stone and cloud north value result error handler service account update".split()), *list(words)[:2000]]
    some = lambda lo, hi: [rng.choice(pool) for _ in range(rng.randint(lo, hi))]
    spoken = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(2, 3))) + rng.choice(["", "r", "n", "t", "s"])
    name = lambda: rng.choice([spoken(), spoken(), rng.choice(pool)])
    key_words = ["token", "secret", "password", "api_key", "access_key", "client_secret", "db_password", "auth_token", "private_key", "passwd", "secret_key", "credential", "pwd", "apikey", "app.password", "smtp_pass_secret"]
    harmless_keys = ["commit", "sha256", "sha1", "checksum", "md5", "uuid", "etag", "digest", "revision", "build", "hash", "integrity", "nonce", "guid", "version"]
    random_values = [
        lambda: of(hexes, 32, 64), lambda: of(hexes, 20, 32), lambda: of(alnum, 16, 48), lambda: of(hexes.upper(), 40, 40), lambda: of(alnum + "!@#$%^&*", 10, 24), lambda: of(alnum + "+/", 40, 88), lambda: of(alnum + "-_", 20, 64), lambda: of(alnum, 10, 16),
        lambda: of(string.ascii_uppercase + string.digits, 16, 32), lambda: "-".join(of(alnum, 4, 6) for _ in range(rng.randint(3, 6))), lambda: vendor(),
    ]
    vendor = lambda: rng.choice(["-", "_"]).join([rng.choice(["sk", "pk", "rk", "pat", "key", "tok"]), *rng.choice([[], ["live"], ["prod"], ["proj"], ["v1"]]), of(alnum, 18, 40)])
    leet = str.maketrans("aeios", "43105")
    made_values = [
        lambda: "-".join([name(), name().capitalize()]) + of(string.digits, 1, 2) + name() + rng.choice("!?#$&"), lambda: (name() + of(string.digits, 1, 3)) * 2, lambda: name().capitalize().translate(leet) + name().capitalize().translate(leet) + of(string.digits + "!#", 0, 2),
        lambda: name().capitalize() + of("!#$%&", 1, 1) + of(string.digits, 2, 4) + name(), lambda: of(string.digits, 1, 3) + name().capitalize() + of(string.digits, 1, 3) + name(), lambda: name().capitalize() + name().capitalize() + of(string.digits, 1, 2) + of("!@#$", 1, 2),
    ]
    holders = ["changeme", "your_token_here", "EXAMPLEKEY", "placeholder", "password123", "insert-key-here", "none_value", "default_password", "<your-api-key>", "REPLACE_ME", "xxxxxxxx", "not-a-secret", "mysecretpassword", "password", "secret", "your-password", "example"]
    plain_values = [
        lambda: rng.choice(holders) + of("0123456789x", 0, 3), lambda: rng.choice("xX*0.-") * rng.randint(8, 40), lambda: "-".join(w.lower() for w in some(2, 5)) + of(string.digits, 0, 2), lambda: "${" + "_".join(w.upper() for w in some(2, 3)) + "}", lambda: "{{" + ".".join(some(2, 3)) + "}}",
        lambda: "0123456789abcdef"[: rng.randint(8, 16)] * rng.randint(1, 3), lambda: "abcdefghijklmnopqrstuvwxyz"[: rng.randint(8, 26)], lambda: rng.choice(["os.environ[", "getenv(", "config.get(", "process.env.", "settings.", "self._"]) + "_".join(some(1, 2)),
        lambda: "_".join(some(2, 7)) + rng.choice(["", "_v2", "_id"]), lambda: "".join(w.capitalize() for w in some(2, 5)), lambda: "/".join(["", *some(2, 4)]) + rng.choice(["", ".txt", ".pem"]), lambda: "https://" + ".".join(some(2, 3)) + "/" + some(1, 1)[0],
    ]
    digests = [lambda: of(hexes, 40, 40), lambda: of(hexes, 64, 64), lambda: of(hexes, 32, 32), lambda: f"{of(hexes, 8, 8)}-{of(hexes, 4, 4)}-{of(hexes, 4, 4)}-{of(hexes, 4, 4)}-{of(hexes, 12, 12)}", lambda: of(alnum + "+/", 43, 43) + "=", lambda: "sha512-" + of(alnum + "+/", 80, 86)]
    known = [
        lambda: ("aws_key_id", "AKIA" + of(string.ascii_uppercase + string.digits, 16, 16)), lambda: ("github_token", "ghp_" + of(alnum, 36, 36)), lambda: ("slack_token", "xoxb-" + of(string.digits, 10, 12) + "-" + of(alnum, 24, 24)), lambda: ("google_key", "AIza" + of(alnum, 35, 35)),
        lambda: ("jwt", f"eyJ{of(alnum, 20, 40)}.eyJ{of(alnum, 30, 80)}.{of(alnum, 30, 43)}"),
    ]
    before = {
        "code": lambda k: rng.choice(["", "const ", "self.", "let "]) + rng.choice([k, re.sub(r"_(.)", lambda m: m[1].upper(), k)]) + rng.choice([' = "', " = '", " := ", ' => "']), "environment": lambda k: rng.choice(["export ", "", "ENV ", "set "]) + re.sub(r"\W", "_", k).upper() + rng.choice(["=", "='", '="']),
        "yaml": lambda k: "  " * rng.randint(0, 3) + k.replace("_", rng.choice("_-.")) + ": ", "json": lambda k: f'"{k}": "', "log": lambda k: rng.choice(["INFO request ", "WARN retry with ", "login ", "args "]) + rng.choice(["", "--", "user=7 "]) + k + "=",
    }
    paths = ["core/io.c", "web/app.js", "app/settings.py", "deploy/prod.env", "lib/main.go", "", "blog/post", "site7"]
    out = []
    for i in range(rows):
        left, right, path, secret = " ".join(some(0, 6)), " ".join(some(0, 6)), rng.choice(paths), i % 2
        shape, draw = rng.choice(shapes), rng.random()
        kind = shape if shape == "connection" else "opaque" if shape in ("known", "bare") else "assignment"
        if shape == "connection":
            value = rng.choice([*random_values[1:3], *made_values, lambda: of(alnum, 8, 16)])() if secret else rng.choice([lambda: rng.choice([*holders, "pass", "user", "root", "admin"]), *plain_values[3:5], lambda: "<" + some(1, 1)[0] + ">", lambda: rng.choice("x*") * rng.randint(4, 10)])()
            value = re.sub(r"[/@\"'\s]", "", value)
            left += " " + rng.choice(["postgres", "mysql", "redis", "amqp", "mongodb", "https", "ftp"]) + "://" + rng.choice(["admin", "app", "root", "user", "svc", ""]) + ":"
            right = "@" + ".".join(some(1, 3)) + "/" + right
        elif shape in ("known", "bare"):
            if secret and shape == "known":
                kind, value = rng.choice(known)()
                if draw < 0.2:  # an issuer's format counts, however plain what follows its mark
                    at = rng.randint(0, 10)
                    value = value[:4] + rng.choice([(string.ascii_uppercase * 2)[at : at + 16], of(alnum, 2, 4) * 10, string.digits * 2])
            elif secret and draw < 0.45:
                value = vendor()
            elif secret:
                value, left = rng.choice([lambda: of(alnum + "_-", 28, 60), lambda: of(hexes, 32, 64), lambda: of(alnum, 24, 40)])(), left + " " + rng.choice(["bearer ", "key ", "token ", "secret is ", "Authorization: Bearer ", "password "])
            elif draw < 0.8:
                value, near = rng.choice(digests)(), rng.choice([*harmless_keys, "", ""])
                left, right = (left + " " + near + rng.choice([" ", ": ", "=", ' = "']), right) if rng.random() < 0.7 else (left, f" {near} {right}")
            else:
                value = rng.choice(plain_values[2:])() + "-".join(some(3, 5)) + of(string.digits, 1, 2)
        elif secret:
            value, left = rng.choice(random_values if draw < 0.65 else made_values)(), left + " " + before[shape](rng.choice(key_words))
        elif draw < 0.7:
            value, left = rng.choice(plain_values)(), left + " " + before[shape](rng.choice(key_words))
        elif draw < 0.85:  # a key word is near, the value belongs to a harmless one
            value, left = rng.choice(digests)(), left + " " + before[shape](rng.choice(["token", "secret", "key"]) + "_" + rng.choice(harmless_keys))
        else:
            kind, value, left = "opaque", rng.choice(digests)(), left + " " + before[shape](rng.choice(harmless_keys))
        if not secret and shape != "connection" and rng.random() < 0.3 or secret and rng.random() < 0.03:
            path = rng.choice(["tests/fixtures/keys.txt", "docs/example.md", "package.lock", "samples/config.ini"])
        if shape != "connection" and rng.random() < 0.1:
            value += rng.choice([")", "]", ".", "!"])
        out.append((value, kind, left, right, path, secret))
    return out


def split(x: np.ndarray, y: np.ndarray, able: Sequence[int]) -> tuple[float, int, float]:
    """(gain in Gini impurity, feature, threshold) of the best split of rows among the features ``able``; gain 0 if there is none."""
    best = (0.0, 0, 0.0)
    parent = y.mean() * (1 - y.mean())
    for f in able:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(at):
            continue
        low, high = ones[at - 1] / at, (ones[-1] - ones[at - 1]) / (len(y) - at)
        gain = parent - (at * low * (1 - low) + (len(y) - at) * high * (1 - high)) / len(y)
        k = int(gain.argmax())
        if gain[k] > best[0] + 1e-12:
            best = (float(gain[k]), int(f), float((v[at[k]] + v[at[k] - 1]) / 2))
    return best


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> list:
    """A tree as nested lists: [share] for a leaf, [feature, threshold, low, high] for a split by Gini impurity."""
    if depth == 0 or len(y) < 6 or y.min() == y.max():
        return [float(y.mean())]
    gain, feature, threshold = split(x, y, rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False))
    if not gain:
        return [float(y.mean())]
    side = x[:, feature] <= threshold
    return [feature, threshold, _grow(x[side], y[side], rng, depth - 1), _grow(x[~side], y[~side], rng, depth - 1)]


def train(findings: list[tuple] | None = None, words: Sequence[str] = (), trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> dict:
    """A random forest from labelled findings (bootstrap rows, random features at every split), the words it knows and what neighbouring words say."""
    rows = labelled_findings(words=words) if findings is None else findings
    known = automaton(words)
    # what words say to a row that trains is learned from the other half, so that no row's label speaks through its own words
    halves = [[r for i, r in enumerate(rows) if i // 2 % 2 == h] for h in (0, 1)]
    said = [log_odds(h) for h in halves]
    rows = halves[0] + halves[1]
    x = np.array([features(*r[:5], known, said[1 - h]) for h in (0, 1) for r in halves[h]])
    y = np.array([float(r[5]) for r in rows])
    forest = []
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        pick = rng.integers(0, len(y), len(y))
        forest.append(_grow(x[pick], y[pick], rng, depth))
    return {"forest": forest, "words": list(words), "odds": log_odds(rows)}


def probability(forest: list, x: list[float]) -> float:
    """Mean over trees of the share of secrets in the candidate's leaf."""
    total = 0.0
    for node in forest:
        while len(node) > 1:
            node = node[2] if x[node[0]] <= node[1] else node[3]
        total += node[0]
    return total / len(forest)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every candidate, left to right without overlaps."""
    out = []
    for m in FINDER.finditer(text):
        kind = m.lastgroup
        inner = m.re.groupindex[kind] + 1
        end = m.end(inner)
        while kind == "assignment" and end - m.start(inner) > 8 and text[end - 1] in ".!?)]}*#&%$":
            end -= 1
        out.append((m.start(inner), end, kind))
    return out


_known: list[tuple] = []


def _words_of(model: dict) -> ahocorasick.Automaton:
    """The model's automaton, built once a process."""
    if not _known or _known[0][0] != (len(model["words"]), hash(tuple(model["words"]))):
        _known[:] = [((len(model["words"]), hash(tuple(model["words"]))), automaton(model["words"]))]
    return _known[0][1]


def _spans(text: str, path: str, model: dict, known: ahocorasick.Automaton) -> list[tuple[int, int, str, float]]:
    return [(a, b, kind, probability(model["forest"], features(text[a:b], kind, text[max(0, a - 60) : a], text[b : b + 60], path, known, model["odds"]))) for a, b, kind in candidates(text)]


def _searched(texts: pa.LargeStringArray) -> list[int]:
    """Numbers of the texts that can have a candidate: a known mark, or a long run that holds a digit."""
    some = pc.match_substring_regex(texts, PREFILTER).to_numpy(zero_copy_only=False).copy()
    for at, piece in slices(texts):
        data, offsets = raw(piece)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], OPAQUE[data].view(np.int8), [0]))))
        start, end = edge[::2], edge[1::2]
        digits = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
        hit = start[(end - start >= OPAQUE_CHARS) & (digits[end] > digits[start])]
        # a run may reach over the end of a text: every text that it touches is searched
        last = end[(end - start >= OPAQUE_CHARS) & (digits[end] > digits[start])] - 1
        for a, b in zip(np.searchsorted(offsets, hit, side="right") - 1, np.searchsorted(offsets, last, side="right") - 1, strict=True):
            some[at + a : at + b + 1] = True
    return np.flatnonzero(some).tolist()


def scan(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", cut: float = CUT) -> DataFrame:
    """One row per candidate: doc_id, start, end (characters), kind, score, secret.

    Whole texts are searched. ``secret`` is whether the forest's probability reaches ``cut``. Null
    texts have no candidates; a null or missing path counts as empty. Rows with null or repeated
    identifiers are searched like others. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words_of(shared.value)
        for batch in batches:
            texts, rows = strings(batch.column(1), lower=False), []
            for i in _searched(texts):
                rows += [(batch.column(0)[i].as_py(), *s) for s in _spans(texts[i].as_py(), batch.column(2)[i].as_py() or "", shared.value, known)]
            if rows:
                cols = list(zip(*rows, strict=True))
                score = np.array(cols[4])
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3]), pa.array(score), pa.array(score >= cut)], names=["doc_id", "start", "end", "kind", "score", "secret"])

    path = F.col(path_col).cast("string") if path_col and path_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"), path.alias("path")).mapInArrow(scanned, "doc_id long, start long, end long, kind string, score double, secret boolean")


def redact(docs: DataFrame, model: dict, text_col: str = "text", path_col: str | None = "source", cut: float = CUT) -> DataFrame:
    """``docs`` with every secret replaced by ``[SECRET:kind]``; rows and other columns stay as they are.

    Whole texts are searched, as ``scan`` does. Null text stays null and an empty one empty, whatever the
    identifier, which is not read. Repeated rows are redacted each, to equal texts. A candidate whose
    score equals ``cut`` is a secret. An empty table gives an empty table of the same columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at, path_at = names.index(text_col), names.index(path_col) if path_col in names else None

    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words_of(shared.value)
        for batch in batches:
            texts, new = strings(batch.column(at), lower=False), {}
            for i in _searched(texts):
                text = texts[i].as_py()
                path = batch.column(path_at)[i].as_py() if path_at is not None else None
                for a, b, kind, score in reversed(_spans(text, str(path or ""), shared.value, known)):
                    if score >= cut:
                        text = f"{text[:a]}[SECRET:{kind}]{text[b:]}"
                        new[i] = text
            column = batch.column(at)
            if new:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(new)] = True
                column = pc.replace_with_mask(column, pa.array(mask), pa.array([new[i] for i in sorted(new)], column.type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], column, *batch.columns[at + 1 :]], names=names)

    return docs.mapInArrow(redacted, docs.schema)
