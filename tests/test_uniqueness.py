"""Uniqueness against all other tests of the requirement, by brute force."""

import difflib
import random

from loomtrace.operators import quality as Q

SCHEMA = "test_id string, requirement_id string, test_title string, test_steps array<string>, expected_result string"


def brute(rows):
    text = lambda r: ((r[2] or "").lower(), " ".join(x.lower() for x in r[3] or []), (r[4] or "").lower())
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    out = {}
    for r in rows:
        seen = [(round(sum(w * ratio(a, b) for w, a, b in zip((0.3, 0.5, 0.2), text(r), text(o))), 6), o[0]) for o in rows if o[0] != r[0] and (o[1] or "") == (r[1] or "")]
        out[r[0]] = max(seen, default=(0.0, None))
    return out


def check(spark, rows, **kw):
    want = brute(rows)
    got = {r["test_id"]: (r["max_similarity"], r["similar_to"], r["uniqueness"]) for r in Q.uniqueness(spark.createDataFrame(rows, SCHEMA), **kw).collect()}
    assert got.keys() == want.keys()
    assert {k: v[:2] for k, v in got.items()} == want and all(abs(1 - m - u) < 1e-9 for m, _, u in got.values())


def test_best_partner_far_away_in_title_order(spark):
    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows = [(f"t{i:02}", "q", f"{chr(97 + i % 26)}{i:02} {words(3)}", [words(4), words(4)], words(3)) for i in range(50)]
    rows += [("first", "q", "aaa", ["open the list", "press the key"], "the list is shown"), ("last", "q", "zzz", ["open the list", "press the key"], "the list is shown")]
    check(spark, rows)
    check(spark, rows, rows_per_block=7)


def test_equals_brute_force(spark):
    r = random.Random(11)
    verbs, nouns = ["open", "Close", "check", "enter", "delete"], ["list", "page", "record", "field", "report"]
    step = lambda: f"{r.choice(verbs)} the {r.choice(nouns)} and {r.choice(verbs)} it"
    rows = []
    for i in range(70):
        steps = r.choice([None, [], [step() for _ in range(r.randrange(1, 12))]])
        rows.append((f"t{i}", r.choice(["q", "q", "q", "p", None, f"own{i}"]), r.choice([None, "", step()]), steps, r.choice([None, step()])))
    check(spark, rows)
    check(spark, rows, rows_per_block=5)
