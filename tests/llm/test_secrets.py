import random
import re

import pytest

from kinetable.llm import secrets as S

PATTERNS = {
    "assign": (r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32),
}


def plain(text):
    out = []
    for k, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def texts():
    rng = random.Random(0)
    parts = ["password", "PassWd", "token", "secret", "api_key", "ApiKey", "=", ":", " ", '"', "'", "\n", "abc", "AKIA", "A1" * 7, "deadbeef" * 4, "0" * 31, "é", "ſecret", "toKen", ".", "word", "-", "f" * 32]
    return ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(1500)]


def test_base_spans_equal_the_patterns():
    for t in [*texts(), "", "é" * 50, "password: token 'abcdefgh1'", "token=" + "x" * 7, "token=" + "x" * 8]:
        assert [(s.kind, s.start, s.end) for s in S.scan_text(t) if s.kind != "random"] == plain(t)


@pytest.mark.parametrize("text", ["a" * 25, "x " * 30, "é" + "a" * 20 + "é", "a" * 19 + "." + "b" * 21, "", "a" * 20])
def test_runs(text):
    assert S._runs(text, 20) == [m.span() for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text)]


@pytest.mark.parametrize("name", ["hex", "base32", "base36", "base62", "base64", "letters"])
def test_battery_holds_its_level_on_random_runs(name):
    rng = random.Random(1)
    runs = ["".join(rng.choices(S.ALPHABETS[name], k=rng.randint(24, 60))) for _ in range(1000)]
    assert sum(S.battery(r, name) < 0.01 for r in runs) <= 25
    words = ["".join(rng.choices(["the", "tion", "and", "ing", "her", "ent"], k=16)) for _ in range(200)]
    assert sum(S.battery(w, "letters") < 0.01 for w in words) > 190
    assert S.battery("ab" * 20, "hex") < 1e-6 and S.battery("0123456789abcdef" * 3, "hex") < 0.01


def test_infer():
    got = [S.infer(x) for x in ("0123", "12ab", "12AB", "abcz", "XYZ7", "XYZ9", "a1z", "aB", "aB1", "aB1/", "aB1_", "a/_", "a~")]
    assert got == [None, "hex", "HEX", "letters", "base32", "BASE36", "base36", "Letters", "base62", "base64", "base64url", None, None]


def test_step_up():
    # 90 runs of text and 10 with tiny chances: the ten are found, and only those.
    counts = {(1, b): 30 for b in (1, 3, 5)} | {(1, 200): 10}
    least = S.cut_offs(counts)
    assert 5 < least[1] <= 200 and least[0] == S.LAST_BIN + 1


def test_random_runs_are_found_and_words_are_not(spark):
    rng = random.Random(5)
    words = ["the", "tion", "and", "ing", "her", "ent", "es", "or", "th"]
    rows, planted = [], {}
    for i in range(200):
        w = ["".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(80)]
        if i % 10 == 0:
            planted[i] = "".join(rng.choices(S.ALPHABETS["base62"], k=48))
            w.insert(rng.randrange(80), planted[i])
        rows.append((i, " ".join(w), "x"))
    rows += [(500, None, "x"), (501, "", "x"), (None, rows[0][1], "x"), (0, rows[0][1], "x")]
    got = S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == len(rows)
    hit = {r.doc_id: [s for s in r.spans] for r in got if r.doc_id is not None}
    found = sum(any(rows[i][1][s.start : s.end] == k for s in hit[i]) for i, k in planted.items())
    assert found >= 18
    assert sum(len(v) for i, v in hit.items() if i not in planted) <= 2
    assert hit[500] == hit[501] == []
    assert S.find_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_of_two_encodings_and_runs_around_spans_are_judged_by_parts():
    rng = random.Random(3)
    key = "".join(rng.choices(S.ALPHABETS["base62"], k=40))
    spans = lambda t: [(s.kind, t[s.start : s.end]) for s in S.scan_text(t)]
    assert spans("see io/my-app/" + key + " there") == [("random", key)]
    assert spans("é io+my_app-" + key) == [("random", key)]
    access = "AKIA" + "B7" * 8
    assert spans(access + "/" + key) == [("access", access), ("random", key)]
    assert spans(key + "_" + access + "-" + key + "/x") == [("random", key), ("access", access), ("random", key)]
    assert spans("deadbeef" * 4 + "Z" + "deadbeef" * 4) == [("hex", "deadbeef" * 4)] * 2
    assert spans("token=" + key + "/" + key[:19]) == [("assign", "token=" + key + "/" + key[:19])]
    assert spans("a/b-" + "1" * 30) == spans("1" * 30) == []
    long = ("io/my-app/" + key + " ") * 3000 + "é" + "secret=" + key
    assert spans(long) == [("random", key)] * 3000 + [("assign", "secret=" + key)]


def plain_parts(text, taken):
    """Runs and parts by a walk over the code points."""
    inside = [c.isascii() and (c.isalnum() or c in "+/-_") for c in text]
    spans = {i for a, b in taken for i in range(a, b)}
    out, a = [], 0
    while a < len(text):
        b = a
        while b < len(text) and inside[b]:
            b += 1
        if b - a >= 20:
            if not spans & set(range(a, b)) and not (set("+/") & set(text[a:b]) and set("-_") & set(text[a:b])):
                out.append((a, b))
            else:
                x = a
                for i in range(a, b + 1):
                    if i == b or i in spans or text[i] in "+/-_":
                        if i - x >= 20:
                            out.append((x, i))
                        x = i + 1
        a = b + 1
    return [(a, b) for a, b in out if not text[a:b].isdigit()]


def test_whole_scan_by_brute_force(spark):
    """Every run of a corpus by plain loops, and the step-up over sorted p-values."""
    rng = random.Random(11)
    key = lambda n: "".join(rng.choices(S.ALPHABETS["base62"], k=n))
    rows = []
    for i in range(120):
        w = ["".join(rng.choices(["the", "tion", "and", "ing", "her", "ent", "es", "or", "/", "-"], k=rng.randint(1, 12))) for _ in range(60)]
        if i % 6 == 0:
            w.insert(3, rng.choice(["", "io/my-app/", "AKIA" + "C3" * 8 + "_", "password: abc123xyz "]) + key(rng.choice([30, 44, 100])))
        rows.append((i, " ".join(w)))
    judged = []
    for i, t in rows:
        base = plain(t)
        parts = plain_parts(t, [(a, b) for _, a, b in base])
        letters = [0] * 128
        for c in t:
            letters[ord(c)] += 1
        for a, b in parts:
            for c in t[a:b]:
                letters[ord(c)] -= 1
        for a, b in parts:
            e = S.infer(t[a:b])
            judged.append((i, a, b, S.text_chance(t[a:b], e, S.np.array(letters)), S.battery(t[a:b], e)))
    want = {(i, kind, a, b) for i, t in rows for kind, a, b in plain(t)}
    for low, high in zip((0, *S.LENGTH_CLASSES), S.LENGTH_CLASSES, strict=False):
        own = sorted((j for j in judged if low <= j[2] - j[1] < high), key=lambda j: j[3])
        n = max((k for k, j in enumerate(own, 1) if j[3] * len(own) <= S.FALSE_SHARE * k), default=0)
        want |= {(i, "random", a, b) for i, a, b, _, even in own[:n] if even >= S.ALPHA}
    got = S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, s.kind, s.start, s.end) for r in got for s in r.spans} == want
    assert sum(k == "random" for _, k, _, _ in want) >= 12


def test_redact():
    spans = [S.Span("hex", 2, 5), S.Span("assign", 0, 4), S.Span("hex", 8, 9)]
    assert S.redact("0123456789", spans) == "[secret]567[secret]9"
