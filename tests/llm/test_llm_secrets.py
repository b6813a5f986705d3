"""Secret scans from whole texts to verdicts, and candidates against brute force."""

import random
import string

import pytest

from lodestone.llm import secret_scan as secrets

from .test_llm_filters import FINDINGS

P = pytest.importorskip("public_tokenizers")


def test_findings_end_to_end(spark):
    """Whole texts through candidates and forest, labelled by hand."""
    rows = [(i, before + value + after, path) for i, (before, value, after, path, _) in enumerate(FINDINGS)]
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, path string"), model_file=P.path("piece_bpe_32k.model"), path_col="path").collect()
    said = {i: [r for r in got if r.doc_id == i and r.is_secret] for i in range(len(rows))}
    true = [i for i, f in enumerate(FINDINGS) if f[4]]
    caught = 0
    for i in true:
        before, value = FINDINGS[i][:2]
        caught += any(r.first_char < len(before) + len(value) and r.end_char > len(before) for r in said[i])
    false = sum(bool(said[i]) for i in range(len(rows)) if i not in true)
    assert caught >= 0.9 * len(true) and false <= 2


def test_secrets_told_in_prose_and_in_urls():
    found = lambda t: [(t[s:e], r) for s, e, r in secrets.candidates(t)]
    assert found("my password is hV8!kq2Zp0.") == [("hV8!kq2Zp0", "told")]
    assert found("login password w9Lz!4kVq8 works") == [("w9Lz!4kVq8", "told")]
    assert found("password Tr0ub4dor&3, once") == [("Tr0ub4dor&3", "told")]
    assert found("see postgres://admin:hunter2pass@host/db") == [("hunter2pass", "url")]
    assert found("a token ring and a password reset") == found("http://host:80/a@b") == found("") == []
    # the same value twice, and one that two rules find
    assert found("password x1y2z3 password x1y2z3") == [("x1y2z3", "told")] * 2
    assert found("password is abc123def456ghi7") == [("abc123def456ghi7", "told")]
    assert len(secrets.candidates("password a1" + "b" * 200_000)) == 1


def _brute(text):
    """Runs, told values and passwords of URLs, by trying every place."""
    keyed = string.ascii_letters + string.digits + "+/_-"
    ends = set(string.whitespace) | set("\"'`;,<>")
    out, i = [], 0
    while i < len(text):  # runs
        j = i
        while j < len(text) and text[j] in keyed:
            j += 1
        if j - i >= 16:
            e = j
            while e < len(text) and e - j < 2 and text[e] == "=":
                e += 1
            run = text[i:e]
            if any(c.isdigit() for c in run) or sum(a.islower() and b.isupper() for a, b in zip(run, run[1:])) >= 4:
                out.append((i, e))
        i = max(j, i + 1)
    low, names = text.lower(), ["key", "token", "secret", "passwd", "password", "pwd", "credential", "auth"]
    names = [*names, *[n + "s" for n in names], "passphrase", "passcode", "login"]
    for i in range(len(text)):
        for n in names:
            if low.startswith(n, i) and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] == "_")):
                rest = text[i + len(n) :]
                gap = len(rest) - len(rest.lstrip())
                if not 1 <= gap <= 3:
                    continue
                for verb in ("", "is", "was", "are", "as", "with", "of"):
                    s = i + len(n) + gap
                    if verb:
                        if not low.startswith(verb, s):
                            continue
                        more = text[s + len(verb) :]
                        gap2 = len(more) - len(more.lstrip())
                        if not 1 <= gap2 <= 3:
                            continue
                        s += len(verb) + gap2
                    if s < len(text) and text[s] in "\"'`":
                        s += 1
                    e = s
                    while e < len(text) and text[e] not in ends:
                        e += 1
                    value = text[s:e]
                    if len(value) < 6:
                        continue
                    value = value.rstrip(".:)")
                    if len(value) >= 6 and any(c in string.ascii_letters for c in value) and any(c.isdigit() or c in "!@#$%^&*+~?" for c in value):
                        out.append((s, s + len(value)))
    merged = []
    for s, e in sorted(set(out), key=lambda x: (x[0], -x[1])):
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged


def test_candidates_equal_brute_force():
    rng = random.Random(9)
    bits = ["password", "token ", "secrets", "login", " is ", "  ", " was ", "a1b2c3", "hello", "x9!", "Zz", "\"", "'", ".", ")", ",", "AbCdEfGhIjKlMnOpQr", "0123456789abcdef", "+/", "_", "\n", "key", "monkey", "passphrase", "ü7", "with "]
    for _ in range(4000):
        text = "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 12)))
        assert [(s, e) for s, e, _ in secrets.candidates(text)] == _brute(text), text
