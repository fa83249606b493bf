"""Secret scan against a plain reading of the contract and entropies of every window, and on awkward tables."""

import hashlib
import random
import re
import string
from collections import Counter
from math import log2

from windvane.llm import secret_scan

SCHEMA = "doc_id long, text string, spans string, n_hex string, start string, kind string"
NAMES = ["password", "passwd", "secret", "token", "api_key", "apikey"]


def base(text):
    """Leftmost non-overlapping matches per kind, character by character."""
    out = []
    at = 0
    while at < len(text):
        name = next((n for n in NAMES if text[at : at + len(n)].isascii() and text[at : at + len(n)].lower() == n), None)
        end = None
        if name:
            i = at + len(name)
            i += text[i : i + 1] in ('"', "'") and text[i : i + 1] != ""
            while text[i : i + 1] == " ":
                i += 1
            if text[i : i + 1] in (":", "="):
                i += 1
                while text[i : i + 1] == " ":
                    i += 1
                i += text[i : i + 1] in ('"', "'") and text[i : i + 1] != ""
                j = i
                while j < len(text) and text[j] in string.ascii_letters + string.digits + "+/_.=-":
                    j += 1
                if j > i:
                    end = j
                    if j - i >= 6:
                        out.append((at, 0, end))
        at = end or at + 1
    for kind, first, inside, least in ((1, "AKIA", string.ascii_uppercase + string.digits, 20), (2, "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            j = at + len(first)
            if text[at:j] == first:
                while j < len(text) and text[j] in inside:
                    j += 1
                if j > at + len(first):
                    if j - at >= least:
                        out.append((at, kind, j))
                    at = j
                    continue
            at += 1
    return sorted(out)


def entropy(text, found):
    """Stretches of windows that pass, each window's entropy counted anew."""
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        own = m.group()
        if any(s < m.end() and m.start() < e for s, _, e in found) or any(re.fullmatch(p, own) for p in secret_scan.ALLOWED):
            continue
        if any(re.search(rf"(?:{p})\Z", text[max(0, m.start() - 240) : m.start()]) for p in secret_scan.ALLOWED_AFTER):
            continue
        good = []
        for i in range(len(own) - 19):
            window = own[i : i + 20]
            bits = -sum(k / 20 * log2(k / 20) for k in Counter(window).values())
            if not re.search("[0-9]", window) or not re.search("[A-Za-z]", window):
                continue
            least = 3.0 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", window) else 3.75 if window.isalnum() else 3.9
            if bits >= least - 1e-6:
                good.append(i)
        for i in good:
            if out and out[-1][0] >= m.start() and m.start() + i <= out[-1][2]:
                out[-1] = (out[-1][0], 3, m.start() + i + 20)
            else:
                out.append((m.start() + i, 3, m.start() + i + 20))
    return out


def listed(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def piece(rng):
    letters = string.ascii_letters + string.digits
    some = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    return rng.choice([
        lambda: rng.choice(NAMES + ["PassWord", "API_Key", "toKen", "ſecret", "mytoken"]) + rng.choice(["", '"', "'"]) + rng.choice(["", " ", "  "]) + rng.choice("=:;")
        + rng.choice(["", " ", "   "]) + rng.choice(["", '"', "'"]) + some(letters + "+/_.=-", rng.randint(0, 12)),
        lambda: "token=token: " + some(letters, 8),
        lambda: "AKIA" + some(string.ascii_uppercase + string.digits, rng.choice([0, 3, 15, 16, 30])),
        lambda: some("0123456789abcdef", rng.choice([20, 23, 24, 40])),
        lambda: some("0123456789ABCDEF", rng.choice([19, 20, 32])),
        lambda: some(letters, rng.choice([19, 20, 25, 60])),
        lambda: some(letters + "+/", rng.choice([20, 44, 90])) + "==",
        lambda: "sha256-" + some(letters, 44), lambda: "https://host/" + some(letters, 30), lambda: "commit: " + some("0123456789ABCDEF", 40),
        lambda: "the-quick-brown-fox-2024-jumps", lambda: "donaudampfschifffahrtsgesellschaft", lambda: "12345678901234567890123456", lambda: "example" + some(letters, 30),
        lambda: "9f1c2d3e-aaaa-bbbb-cccc-0123456789ab", lambda: "aaaaaaaaaaaaaaaaaaaaaaa1", lambda: "éü\U0001f600", lambda: "\n", lambda: some("abc ", 9),
    ])()


def texts():
    rng = random.Random(11)
    out = [rng.choice(["", " "]).join(piece(rng) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    return [None, "", *out, "x " * 40_000 + "token = abcdef", "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(50_000)), *out[:10]]


def test_equals_plain_reading(spark):
    docs = list(enumerate(texts())) + [(None, "secret: abcdefg")]
    frame = spark.createDataFrame([(*d, "a", "b", "c", "d") for d in docs], SCHEMA)
    found = sorted((tuple(r) for r in secret_scan.secret_digests(frame).collect()), key=lambda r: (r[0] is None, r[0]))
    want = []
    for i, text in docs:
        own = base(text or "")
        counts = [sum(k == kind for _, k, _ in own) for kind in range(3)]
        want.append((i, *counts, hashlib.sha256(listed(own).encode()).hexdigest(), listed(own + entropy(text or "", own))))
    assert found == want
    assert all(sum(r[k] for r in want) > 20 for k in (1, 2, 3)) and sum("entropy" in r[5] for r in want) > 40


def test_spans_and_own_allow_list(spark):
    key = "q8Zr2LmX0vTfK3yWb7NcHs"
    frame = spark.createDataFrame([(1, f"see {key} here"), (2, f"sha256:{key}")], "doc_id long, text string")
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secret_scan.secret_spans(frame).collect()}
    assert spans == {1: [(4, "entropy", 26)], 2: []}
    own = secret_scan.Scanner(allowed=("q8Z.*",), allowed_after=())
    assert all(not r["spans"] for r in secret_scan.secret_spans(frame, own).collect())


def test_empty_table(spark):
    assert secret_scan.secret_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
