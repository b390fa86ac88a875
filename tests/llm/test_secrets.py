"""The secret forest: other findings than it learned from, splits and votes by brute force, and the dictionary."""

import base64
import hashlib
import random
import re
import string
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sentrel.llm import secret_scan
from sentrel.llm._text import strings

PROSE = "morning window garden letter market season bridge engine forest doctor winter silver paper answer river stone captain village music station".split()

#: A dictionary that is not what the lines are made of, but for a few words.
OTHERS = "about after before between country family friend little mother never number people school should through under water where world write station music river".split()


def lines(n=1200, seed=99):
    """(text, value, is secret): lines of configuration, code, logs and prose, made apart from the generator that trains."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    b64 = lambda k: base64.b64encode(rng.randbytes(k)).decode().rstrip("=")
    hexed = lambda k: rng.randbytes(k).hex()
    prose = lambda k: " ".join(rng.choices(PROSE, k=k))
    secret = [
        lambda: ("export GITLAB_TOKEN={}", "glpat" + pick(string.ascii_letters + string.digits, 20)), lambda: ("  password: {}", pick(string.ascii_letters + string.digits + "#%", 14)), lambda: ('"client_secret": "{}",', hexed(16)),
        lambda: ("curl -H 'Authorization: Bearer {}' https://host/api", b64(30).replace("+", "-").replace("/", "_")), lambda: ("aws_secret_access_key = {}", b64(30)), lambda: ("key id {} was used", "AKIA" + pick(string.ascii_uppercase + string.digits, 16)),
        lambda: ("MAIL_PASSWD='{}'", pick(string.ascii_letters + string.digits, 12)), lambda: (prose(4) + " api-key={} " + prose(3), hexed(20)), lambda: ("jdbc.password={}", pick(string.ascii_letters + string.digits + "!@", 18)), lambda: ("const authToken = \"{}\";", pick(string.ascii_letters + string.digits, 32)),
    ]
    plain = [
        lambda: ("Merge commit {} into main", hexed(20)), lambda: ("{}  release.tar.gz sha256", hashlib.sha256(rng.randbytes(4)).hexdigest()), lambda: ('  "id": "{}",', str(uuid.UUID(bytes=rng.randbytes(16)))), lambda: ("password: {}", rng.choice(["<enter-password>", "your-password-here", "changeme123", "********"])),
        lambda: ("token = {}", rng.choice(["os.getenv('TOKEN_NAME')", "request.headers.get(name)", "${CI_JOB_TOKEN}", "self.settings.token_value"])), lambda: ("the secret: {}", "-".join(rng.choices(PROSE, k=3))), lambda: ("api_key: {}", "_".join(rng.choices(PROSE, k=2)) + "_key"),
        lambda: ("etag: {}", hexed(16)), lambda: ("integrity sha512-{}", b64(64)), lambda: ("see {} for more", "/".join(rng.choices(PROSE, k=4)) + "/v2/item10"), lambda: ("password_file = {}", "/etc/" + "/".join(rng.choices(PROSE, k=2)) + ".txt"), lambda: ("request {} took 3 ms", f"{hexed(4)}-{hexed(2)}-{hexed(2)}-{hexed(2)}-{hexed(6)}"),
    ]
    out = []
    for i in range(n):
        shape, value = rng.choice(secret if i % 2 else plain)()
        out.append((f"{prose(rng.randint(0, 5))}\n{shape.format(value)}\n{prose(rng.randint(0, 5))}", value, i % 2))
    return out


def test_precision_and_recall_on_lines_of_another_generator():
    model, known = secret_scan.train(words=OTHERS), secret_scan.automaton(OTHERS)
    outcome = Counter()
    for text, value, secret in lines():
        flagged = [text[a:b] for a, b, _, score in secret_scan._spans(text, "", model, known) if score >= secret_scan.CUT]
        hit = any(len(set(f)) > 1 and (f in value or value in f) for f in flagged)
        outcome["tp" if hit else "fn"] += secret
        outcome["fp"] += bool(flagged) and not secret
        outcome["raw"] += bool(secret_scan.candidates(text)) and not secret
    precision, recall = outcome["tp"] / (outcome["tp"] + outcome["fp"]), outcome["tp"] / (outcome["tp"] + outcome["fn"])
    print(f"precision {precision:.3f}, recall {recall:.3f}, candidates of harmless lines {outcome['raw']}, left {outcome['fp']}")
    assert precision >= 0.9 and recall >= 0.9
    assert outcome["fp"] < 0.25 * outcome["raw"]  # false positives that patterns alone would give


def test_forest_on_new_findings():
    model, known = secret_scan.train(), secret_scan.automaton([])
    rows = secret_scan.labelled_findings(800, seed=123)
    right = [(secret_scan.probability(model["forest"], secret_scan.features(*r[:5], known, model["odds"])) >= secret_scan.CUT) == bool(r[5]) for r in rows]
    assert np.mean(right) >= 0.95


def test_split_equals_all_splits():
    rng = np.random.default_rng(5)
    for _ in range(20):
        x = rng.integers(0, 6, (25, 4)).astype(float)
        y = (rng.random(25) < 0.2 + 0.1 * x[:, 2]).astype(float)
        gini = lambda v: v.mean() * (1 - v.mean()) if len(v) else 0.0
        every = [(gini(y) - (s.sum() * gini(y[s]) + (~s).sum() * gini(y[~s])) / 25, f, t) for f in range(4) for t in np.unique(x[:, f])[:-1] for s in [x[:, f] <= t]]
        gain, feature, threshold = secret_scan.split(x, y, range(4))
        assert gain == pytest.approx(max(e[0] for e in every))
        side = x[:, feature] <= threshold
        assert gini(y) - (side.sum() * gini(y[side]) + (~side).sum() * gini(y[~side])) / 25 == pytest.approx(gain)
    assert secret_scan.split(np.ones((9, 2)), np.arange(9) % 2.0, range(2))[0] == 0


def test_votes_equal_routing_of_the_training_rows():
    rng = np.random.default_rng(2)
    x = rng.random((300, len(secret_scan.FEATURES)))
    y = (x[:, 3] + x[:, 5] > 1).astype(float)
    tree = secret_scan._grow(x, y, np.random.default_rng(0), 6)

    def shares(node, rows):
        if len(node) == 1:
            assert node[0] == pytest.approx(y[rows].mean())
            return dict.fromkeys(rows.tolist(), node[0])
        side = x[rows, node[0]] <= node[1]
        return shares(node[2], rows[side]) | shares(node[3], rows[~side])

    want = shares(tree, np.arange(300))
    assert [secret_scan.probability([tree, [0.5]], list(r)) for r in x] == pytest.approx([(want[i] + 0.5) / 2 for i in range(300)])


def test_dictionary_counts_every_text(spark, monkeypatch):
    rows = [("Alpha alpha beta, gamma!",), ("alpha beta",), ("ALPHA beta x9y",), (None,), ("",), ("gamma " * 3,), ("gamma",), ("word1 abcd_efgh",) * 1, ("zeta " * 400_000,)]
    df = spark.createDataFrame(rows, "text string").repartition(4)
    want = Counter(w for (t,) in rows for w in set(re.findall(r"\b[a-z]{4,20}\b", (t or "").lower())))
    assert secret_scan.dictionary(df) == [w for w, n in sorted(want.items(), key=lambda p: (-p[1], p[0])) if n >= 3]
    monkeypatch.setattr(secret_scan, "COUNTED_WORDS", 1)
    assert secret_scan.dictionary(df, most=1) == []  # two words tie for the only place
    more = df.union(spark.createDataFrame([("beta",)], "text string"))
    assert secret_scan.dictionary(more, most=1) == secret_scan.dictionary(more, most=2) == ["beta"]
    assert secret_scan.dictionary(df.where("false")) == []


PROBES = [("db.password=correct-Horse7battery!", "correct-Horse7battery"), ("password = hunter2hunter2", "hunter2hunter2"), ("take sk-proj-Ab3dEf6hIj9lMn2pQr5tUv8x and go", "sk-proj-Ab3d"), ("postgres://admin:S3cr3tP4ss@host/db", "S3cr3tP4ss")]


@pytest.mark.parametrize("words", [(), OTHERS])
def test_secrets_that_people_make(words):
    model, known = secret_scan.train(words=words), secret_scan.automaton(words)
    for text, value in PROBES:
        (found,) = secret_scan._spans(text, "", model, known)
        print(text, found)
        assert value in text[found[0] : found[1]] and found[3] >= secret_scan.CUT, text
        assert secret_scan._searched(strings(pa.array([text]), lower=False)) == [0]
    for text in ("postgres://admin:${DB_PASS}@host/db", "redis://user:password@localhost", "password = changeme123", "at http://host:8080/a@b"):
        assert not [f for f in secret_scan._spans(text, "", model, known) if f[3] >= secret_scan.CUT], text


@pytest.mark.parametrize("shape", secret_scan.SHAPES[:-2])
def test_a_shape_that_was_not_learned(shape):
    """Trained without one shape of line, the forest still tells secrets of that shape apart."""
    others = [s for s in secret_scan.SHAPES if s != shape]
    model, known = secret_scan.train(secret_scan.labelled_findings(4000, shapes=others), trees=30), secret_scan.automaton([])
    rows = secret_scan.labelled_findings(600, seed=321, shapes=[shape])
    flagged = [secret_scan.probability(model["forest"], secret_scan.features(*r[:5], known, model["odds"])) >= secret_scan.CUT for r in rows]
    hits = sum(f and r[5] for f, r in zip(flagged, rows, strict=True))
    print(shape, f"precision {hits / max(sum(flagged), 1):.3f}, recall {hits / 300:.3f}")
    assert hits / max(sum(flagged), 1) >= 0.85 and hits / 300 >= 0.8
