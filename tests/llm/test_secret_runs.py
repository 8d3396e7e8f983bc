"""Runs without a digit, and runs that reach out of a base span."""

import random
import string

from tracelens.llm import secret_scan

r = random.Random(6)
draw = lambda letters, n: "".join(r.choices(letters, k=n))
KEYS = [draw(string.ascii_letters + string.digits, 20) for _ in range(300)]
G = secret_scan.learn({"assign": KEYS}, ["".join(r.choices(["inter", "nation", "al", "counter", "revolution", "ary", "ise"], k=4)) for _ in range(300)])


def test_letter_only_credentials_are_scored():
    letters = [draw(string.ascii_letters, 20) for _ in range(50)]
    assert sum(G.accepts(x) for x in letters) >= 40
    assert not G.accepts("internationalrevolutionary")
    assert secret_scan.redacted(f"key {next(filter(G.accepts, letters))} end", G) == "key [format] end"


def test_rest_of_a_run_after_a_base_span_is_scored():
    tail = next(filter(G.accepts, (draw(string.ascii_lowercase, 1) + draw(string.ascii_letters + string.digits, 23) for _ in range(50))))
    text = "AKIA" + draw(string.ascii_uppercase, 16) + tail
    spans = secret_scan.all_spans(f"x {text} y", G)
    assert ("access" in {k for _, _, k in spans}) and max(e for _, e, _ in spans) == 2 + len(text)
    assert text[-12:] not in secret_scan.redacted(f"x {text} y", G)
    assert secret_scan.all_spans("password=abcdefgh12abcdefgh", G) == [(0, 27, "assign")]
